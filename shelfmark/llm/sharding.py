"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations.

The ring has ``CELLS`` cells; a row's key hashes to a cell, and each shard owns the cells from each of its virtual
nodes back to the one before. A shard takes rows up to its bound. Where it is full, what is left of a cell
goes clockwise to the next virtual node whose shard has room, as in the bounded-load scheme, so most rows stay
with the shard that plain consistent hashing gives them.

Which rows of a cell stay and which move on is said by their rank in the cell. The walk around the ring needs
only the number of rows per cell, of which there are ``CELLS`` at most, and gives at most one run of
ranks per cell and shard; rows are then placed by a join with these runs.
"""

from __future__ import annotations

import json
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import stored

CELLS = 1 << 16
_MASK = (1 << 64) - 1


def _spread(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


def virtual_nodes(shards: int, each: int) -> list[tuple[int, int]]:
    """``(cell, shard)`` of every virtual node in clockwise order; two nodes never share a cell."""
    taken: dict[int, int] = {}
    for s in range(shards):
        for v in range(each):
            cell = _spread(s * each + v) % CELLS
            while cell in taken:
                cell = (cell + 1) % CELLS
            taken[cell] = s
    return sorted(taken.items())


def bounds(total: int, shards: int, slack: float) -> list[int]:
    """Rows each shard may take: without slack, as even as can be."""
    if slack > 0:
        return [int(-(-total * (1 + slack) // shards))] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def walk(counts: dict[int, int], nodes: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Runs ``(cell, low, high, shard, slot)``: rows ranked low to high in the cell take the shard's slots from ``slot`` on.

    A cell's rows go to the first virtual node at or after it whose shard has room. First every shard takes
    its own cells as far as it can, so only what overflows moves.
    """
    cells, filled, runs, moving = [c for c, _ in nodes], [0] * len(room), [], []
    for cell in sorted(counts):
        first = bisect_left(cells, cell) % len(nodes)
        shard, n = nodes[first][1], counts[cell]
        take = min(n, room[shard] - filled[shard])
        if take:
            runs.append((cell, 0, take, shard, filled[shard]))
            filled[shard] += take
        if take < n:
            moving.append((cell, take, n, first))
    for cell, low, high, at in moving:
        while low < high:
            shard = nodes[at][1]
            take = min(high - low, room[shard] - filled[shard])
            if take:
                runs.append((cell, low, low + take, shard, filled[shard]))
                filled[shard] += take
                low += take
            at = (at + 1) % len(nodes)
    return runs


def _literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table from a literal, without Python rows on the executors."""
    text = json.dumps([list(r) for r in rows])
    names = [c.split()[0] for c in schema.split(", ")]
    made = spark.range(1).select(F.explode(F.from_json(F.lit(text), "array<array<long>>")).alias("r"))
    return made.select(*(F.get("r", i).alias(n) for i, n in enumerate(names)))


def cell_of(key: Column) -> Column:
    """The cell of a key: the high bits of its hash."""
    return F.shiftrightunsigned(F.xxhash64(key), 48)


def ring_shards(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 24, nodes_per_shard: int = 128, slack: float = 0.0
) -> DataFrame:
    """``(key, size, text_crc32, law, shard, slot, grown_shard)`` for every row of ``docs``.

    The law is ``rows``: with no slack, the shards' counts of rows are at most one apart. ``size`` is the
    text's UTF-8 bytes plus 8, a null text having none. Slots count from 0 in each shard. ``grown_shard`` is null: with
    bounded loads a further shard also moves rows between others. Rows with equal keys share a cell
    and may be split by the bound; rows without a key hash by their text. Further columns are ignored.
    """
    spark = docs.sparkSession
    bytes_ = F.coalesce(F.col(text), F.lit("")).cast("binary")
    crc = F.crc32(bytes_)
    rows = stored(
        docs.select(
            F.col(key).alias("_k"), (F.octet_length(bytes_) + 8).cast("long").alias("size"), crc.alias("text_crc32"),
            cell_of(F.coalesce(F.col(key).cast("string"), F.concat(F.lit("text "), crc.cast("string")))).alias("cell"),
        ),
        "ring_rows",
    )
    counts = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}  # at most CELLS rows
    runs = walk(counts, virtual_nodes(shards, nodes_per_shard), bounds(sum(counts.values()), shards, slack))
    plan = _literal_rows(spark, runs, "p_cell, low, high, shard, first_slot")
    rank = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64(F.col("_k")), "_k", "text_crc32", "size")) - 1
    ranked = rows.withColumn("rank", rank.cast("long"))
    placed = ranked.join(
        F.broadcast(plan), (F.col("cell") == F.col("p_cell")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    )
    return placed.select(
        F.col("_k").alias(key), "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("first_slot") + F.col("rank") - F.col("low")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
