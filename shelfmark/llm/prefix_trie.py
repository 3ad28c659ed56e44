"""The trie of conversations by their turns, with a count-min sketch that keeps unshared tails out of the shuffle.

Every prefix of a conversation has a digest, the exclusive or of the hashes of its turns with their depths, as a running value
over the turns in order. A count-min sketch counts the digests of all prefixes; it never counts too few, so where it says
one, the prefix is in one conversation only. Such nodes, the tails, are complete in their own row and are returned
from it. Only prefixes that may be shared are grouped by digest, exactly; those that the sketch took for shared in error come
out as groups of one. Values of whole subtrees are sums along the members' paths: each node's value lies on the path
of its smallest member, so the values below a node are running sums from the paths' ends, summed over its members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import map_batches, small_batches, stored
from shelfmark.llm.sums import PARTS, gathered, merged, running, sliced

WIDTH = 1 << 23  # counters in each of the two rows of the sketch, one byte each
FAMILY = 20
_EMPTY = hashlib.sha256(b"").hexdigest()
_MOST = (1 << 63) - 1


def borrowed(conv: Column) -> Column:
    """Number of turns that a conversation takes from the first of its family."""
    return F.crc32(conv.cast("string").cast("binary")) % 4


def ordered_turns(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``(conv, nth, t1, t2, words)``: the turns of each conversation, numbered from 1, as two hashes of role and text."""
    said = F.coalesce(F.col(text).cast("string"), F.lit(""))
    role = F.coalesce(F.col(role).cast("string"), F.lit(""))
    rows = conversations.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), F.xxhash64(F.lit(1), role, said).alias("t1"),
        F.xxhash64(F.lit(2), role, said).alias("t2"), F.regexp_count(said, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"), F.lit(1).cast("long").alias("nth"),
    )
    turns = stored(rows, "turns")
    return running(turns, "conv", [F.col("turn").asc_nulls_first(), F.col("t1"), F.col("t2")], ["nth"], [], "numbered").drop("turn", "_part")


def rebuilt_paths(turns: DataFrame) -> DataFrame:
    """``(conv, depth, total, words, u1, u2)``: the turns of the rebuilt conversations, hashed with their depth, and a row of depth 0 each.

    A conversation begins with the first turns of the one whose id is the next lower multiple of ``FAMILY`` (towards zero), as many as
    ``borrowed`` says, and goes on with its own turns after as many.
    """
    sizes = stored(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("size")).withColumn("h", borrowed(F.col("conv"))), "sizes")
    of_first = sizes.select(F.col("conv").alias("donor"), F.col("size").alias("given"))
    taken = F.least("h", F.coalesce("given", F.lit(0)))
    convs = sizes.withColumn("donor", F.col("conv") - F.col("conv") % FAMILY).join(of_first, "donor", "left").select(
        "conv", "h", taken.alias("taken"), (taken + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("total"))
    convs = stored(convs, "convs")
    depth = F.col("nth") - F.col("h") + F.col("taken")
    own = turns.join(convs, "conv").filter(F.col("nth") > F.col("h")).select("conv", depth.alias("depth"), "total", "words", "t1", "t2")
    low = F.when(F.col("conv") <= 0, F.greatest("conv", F.lit(-_MOST + FAMILY)) - (FAMILY - 1)).otherwise(F.col("conv"))
    high = F.when(F.col("conv") >= 0, F.least("conv", F.lit(_MOST - FAMILY)) + (FAMILY - 1)).otherwise(F.col("conv"))
    first = turns.filter((F.col("conv") % FAMILY == 0) & (F.col("nth") <= 3)).select(F.explode(F.sequence(low, high)).alias("conv"), "nth", "words", "t1", "t2")
    lent = first.filter(F.col("nth") <= borrowed(F.col("conv"))).join(convs, "conv").select("conv", F.col("nth").alias("depth"), "total", "words", "t1", "t2")
    hashed = own.unionByName(lent).select(
        "conv", "depth", "total", "words", F.xxhash64(F.lit(3), "t1", "t2", "depth").alias("u1"), F.xxhash64(F.lit(4), "t2", "t1", "depth").alias("u2"))
    nothing = F.lit(0).cast("long")
    return hashed.unionByName(convs.select("conv", nothing.alias("depth"), "total", nothing.alias("words"), nothing.alias("u1"), nothing.alias("u2")))


def count_min(paths: DataFrame, width: int) -> np.ndarray:
    """Two rows of ``width`` counters, which stop at 2, of the digests ``p1`` and ``p2``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = np.zeros((2, width), np.uint8)
        for batch in batches:
            for i in (0, 1):
                cell, count = np.unique(batch.column(i).to_numpy() & (width - 1), return_counts=True)
                rows[i, cell] = np.minimum(rows[i, cell] + np.minimum(count, 2).astype(np.uint8), 2)
        for i in (0, 1):
            yield from sliced(str(i), rows[i])

    parts = stored(paths.select("p1", "p2").mapInArrow(run, PARTS), "sketch")
    total = gathered(merged(parts, "u1", lambda a, b: np.minimum(a + b, 2)), "u1", {"0": width, "1": width})
    return np.stack([total["0"], total["1"]])


def screened(paths: DataFrame, sketch: np.ndarray) -> DataFrame:
    """``paths`` with ``single`` and ``single_above``: the sketch proves that the node, or the one above it, has one member."""
    shared = paths.sparkSession.sparkContext.broadcast(sketch)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in paths.schema.fields)
    columns = paths.columns

    def look(batch: pa.RecordBatch):
        rows = shared.value
        out = dict(zip(columns, batch.columns))
        for name, digest in (("single", ("p1", "p2")), ("single_above", ("q1", "q2"))):
            a, b = (rows[i][out[c].to_numpy() & (rows.shape[1] - 1)] for i, c in enumerate(digest))
            out[name] = pa.array(np.minimum(a, b) == 1)
        yield out

    return map_batches(paths, look, f"{schema}, single boolean, single_above boolean")


def hashed_ends(ends: DataFrame) -> DataFrame:
    """``(p1, p2, ends)``: SHA-256 of the ids of each node's conversations that end there, ascending, joined by commas.

    The ids of a part of the range of ids are joined first; a node's parts then pass through one task in order, one at a time.
    """
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    joined = ends.groupBy("p1", "p2", "_part").agg(ids.alias("ids"))
    dealt = joined.repartition("p1", "p2").sortWithinPartitions("p1", "p2", "_part").select("p1", "p2", "ids")
    small_batches(ends.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        for batch in batches:
            done = []
            for a, b, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (a, b) == at:
                    digest.update(b"," + text.encode())
                    continue
                if at is not None:
                    done.append((*at, digest.hexdigest()))
                at, digest = (a, b), hashlib.sha256(text.encode())
            yield rows(done)
        if at is not None:
            yield rows([(*at, digest.hexdigest())])

    def rows(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["p1", "p2", "ends"])

    return dealt.mapInArrow(run, "p1 long, p2 long, ends string")


def prefix_trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (see ``rebuilt_paths``): ``conv_id`` (the smallest member), ``depth``,
    ``parent_conv_id`` (null for the root), ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.

    Turns are ordered by number, those without one first; turns of one number are put in the order of the hashes of their contents, so
    the result does not depend on the order of rows. Repeated rows are turns of their own. A null role or text is
    empty. Rows without a conversation belong to none and are left out; ids and turns are whole numbers. An empty
    table gives no node, not even a root. Further columns are ignored. ``width``, a power of two, bounds the sketch; with more prefixes than
    that, fewer tails are recognised and more is shuffled, with the same result.
    """
    turns = ordered_turns(conversations, conv, turn, role, text)
    steps = stored(rebuilt_paths(turns).select("*", F.col("u1").alias("p1"), F.col("u2").alias("p2")), "steps")
    paths = running(steps, "conv", [F.col("depth").asc()], [], ["p1", "p2"], "paths")
    above = {f"q{i}": F.col(f"p{i}").bitwiseXOR(F.col(f"u{i}")) for i in (1, 2)}
    paths = paths.withColumns(above).drop("u1", "u2")
    rows = stored(screened(paths, count_min(paths, width)), "screened")

    # Nodes of one conversation: complete but for the parent of the first of a tail.
    last = F.col("depth") == F.col("total")
    own_id = F.sha2(F.col("conv").cast("string").cast("binary"), 256)
    tails = rows.filter("single").select(
        "conv", "depth", "q1", "q2", "single_above", F.lit(1).cast("long").alias("n_convs"), (~last).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(last, own_id).otherwise(F.lit(_EMPTY)).alias("ends_sha256"))

    # Nodes that may be shared, exactly.
    maybe = rows.filter("NOT single")
    nodes = stored(maybe.groupBy("p1", "p2").agg(
        F.min("conv").alias("conv"), F.max("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"),
        F.max("q1").alias("q1"), F.max("q2").alias("q2"), F.max("single_above").alias("single_above")), "nodes")
    below = nodes.select("q1", "q2", "depth").unionByName(rows.filter("single AND NOT single_above").select("q1", "q2", "depth")).filter("depth > 0")
    children = below.groupBy("q1", "q2").agg(F.count(F.lit(1)).alias("n_children")).select(F.col("q1").alias("p1"), F.col("q2").alias("p2"), "n_children")
    nodes = stored(nodes.join(children, ["p1", "p2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "with_children")

    # Each node's value and each leaf lie on the path of the smallest member; sums from the paths' ends.
    mine = nodes.select("p1", "p2", F.col("conv").alias("least"), "n_convs", "n_children")
    is_least = F.col("conv") == F.col("least")
    worth = maybe.join(mine, ["p1", "p2"]).select(
        "conv", "depth", "p1", "p2", F.when(is_least, (F.col("n_convs") - 1) * F.col("words")).otherwise(0).alias("saved"),
        F.when(is_least & last & (F.col("n_children") == 0), 1).otherwise(0).cast("long").alias("leaves"), F.lit(True).alias("maybe"))
    leaf_tails = rows.filter(F.col("single") & last).select(
        "conv", "depth", "p1", "p2", F.lit(0).cast("long").alias("saved"), F.lit(1).cast("long").alias("leaves"), F.lit(False).alias("maybe"))
    from_end = running(stored(worth.unionByName(leaf_tails), "worth"), "conv", [F.col("depth").desc()], ["saved", "leaves"], [], "from_end")
    sums = stored(from_end.filter("maybe").groupBy("p1", "p2").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves")), "subtrees")
    ends = stored(hashed_ends(maybe.filter(last)), "ends")
    groups = nodes.join(sums, ["p1", "p2"]).join(ends, ["p1", "p2"], "left").select(
        "conv", "depth", "q1", "q2", "single_above", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(_EMPTY)).alias("ends_sha256"))

    # A parent in one conversation is in the same; others are looked up.
    parents = nodes.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv").alias("parent"))
    every = groups.unionByName(tails)
    own = (F.col("depth") == 0) | F.col("single_above")
    known = every.filter(own).withColumn("parent", F.when(F.col("depth") > 0, F.col("conv")))
    found = every.filter(~own).join(parents, ["q1", "q2"])
    return known.unionByName(found.select(known.columns)).select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
