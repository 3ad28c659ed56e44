"""Exact Jaccard join of word-shingle sets by size: small sets by subsets, large sets by inverted lists.

Two sets A and B link when ``100 * |A and B| >= percent * |A or B|``. Then a set of n shingles lacks
at most ``n - ceil(percent * n / 100)`` of them in the other, which bounds both routes:

* **Small sets** (fewer than ``boundary`` shingles): each set enumerates its subsets of every fixed size that a
  partner can share with it. Two linked sets meet in the subset that is their intersection. Within
  the group of one subset of t shingles, any two sets that this alone makes linked are also linked with
  the smallest set of the group, so one link per set, to that smallest set, keeps the components.
* **Large sets**: the shingles are put into one global order, rare ones first, and each set enters the
  inverted lists of its first shingles only, as many as could be missing in a partner and one more;
  linked sets meet in a list. A list is scanned against the set that stands earliest in it, the
  one that may link with most others. Pairs that pass the bounds on size, position and bitmap are
  verified on the whole sets. Where a list still holds several components, pairs of members of different
  components are left. A list of at most ``DIRECT`` members is paired out. In longer ones each member is
  taken by how it differs from the list's first set: two sets that link differ in few shingles, and so do their
  differences, so linked ones meet in an inverted list of the first of these. Near copies of one text that do not link
  differ from it in shingles of their own and are not paired. Pairs within one component need no check.

The **boundary** is chosen from the sizes of all sets: the one with the least estimated cost, subsets
of the sets below it plus list entries and checks of those above.

Sets that are equal are one node, so copies are never paired. The order comes from counts of all
shingles in ``SLOTS`` (four million) hashed counters: a fixed size, so it may be broadcast; the counters only
decide the order, never the result. Nodes carry 128-bit fingerprints, shingles 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import forget_kept, map_batches, slices, stored, sum_arrays
from shelfmark.llm.components import components
from shelfmark.llm.words import BLANKS, groups_by_size, mix, raw_text, shingles, words

SLOTS = 1 << 22
FILTER = 1 << 24
BITS = 1024
DIRECT = 32  # members of a list that are paired out
_SECOND = np.uint64(0xD6E8FEB86659FD93)
_CHUNK = 1 << 20


def sets_of(texts: pa.Array, k: int):
    """For a column of texts, ``(row, sorted distinct shingle hashes)`` in order."""
    buf, off = raw_text(texts)
    for lo, hi in groups_by_size(np.diff(off), _CHUNK):
        part = off[lo:hi + 1]
        _, _, hashes, first = words(buf[part[0]:part[-1]], part - part[0], BLANKS)
        found, begin = shingles(hashes, first, k)
        for i in range(lo, hi):
            yield i, np.unique(found[begin[i - lo]:begin[i - lo + 1]])


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit numbers that stand for the set."""
    return int(s.sum().astype(np.int64)), int(mix(s ^ _SECOND).sum().astype(np.int64))


def parity(s: np.ndarray) -> np.ndarray:
    """Bit i is the parity of the shingles that hash to i: two sets differ in at least as many shingles as bits."""
    odd = np.bincount((s >> np.uint64(20)).astype(np.int64) & (BITS - 1), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def missing(n: int, percent: int) -> int:
    """How many of n shingles a linked set can lack."""
    return n - -(-percent * n // 100)


def subsets(s: np.ndarray, percent: int):
    """``(size, hash)`` of the subsets of ``s`` that can be its intersection with a linked set.

    The hash is a sum over the shingles, so a subset costs a subtraction.
    """
    values = mix(s ^ np.uint64(0xA24BAED4963EE407)).tolist()
    whole, n = sum(values), len(s)
    yield n, whole % 2**64
    for d in range(1, missing(n, percent) + 1):
        for left_out in combinations(range(n), d):
            yield n - d, (whole - sum(values[i] for i in left_out)) % 2**64


def subset_count(n: int, percent: int) -> int:
    return sum(comb(n, d) for d in range(missing(n, percent) + 1))


def choose_boundary(sizes: dict[int, int], percent: int, list_length: float) -> int:
    """The set size from which inverted lists cost less than subsets, given how many sets have each size.

    A subset costs one entry. A large set costs, for each prefix shingle, the scan of a list of ``list_length``, and at
    most one more reading of its n shingles to be verified.
    """
    listed = {n: c * ((missing(n, percent) + 1) * list_length + n) for n, c in sizes.items()}
    cost = best = sum(listed.values())
    boundary = 1
    for n in sorted(sizes):
        cost += sizes[n] * subset_count(n, percent) - listed[n]
        if cost <= best:
            best, boundary = cost, n + 1
    return boundary


def rare_list_length(counts: np.ndarray, share: float) -> float:
    """About how many sets hold one of the rarest ``share`` of shingles, from the hashed counters."""
    ordered = np.sort(counts)
    mass = np.cumsum(ordered)
    rare = ordered[:max(1, int(np.searchsorted(mass, share * mass[-1])))] if mass[-1] else ordered[:1]
    return 1.0 + max(0.0, float(rare.mean()) - float(np.median(counts)))


def set_table(docs: DataFrame, text: str, key: str, k: int) -> DataFrame:
    """``(key, n, fp1, fp2, bits)`` for each row, and each task's counters as further rows with ``slice``."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        counts, kept, held = np.zeros(SLOTS, dtype=np.int64), [], 0

        def count():
            return np.bincount((np.concatenate(kept) & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)

        for batch in batches:
            at, n, fp, bits = [], [], [], []
            for i, s in sets_of(batch.column(1), k):
                at.append(i)
                n.append(len(s))
                fp.append(fingerprint(s))
                bits.append(parity(s))
                kept.append(s)
                held += len(s)
                if held > _CHUNK // 2:
                    counts += count()
                    kept, held = [], 0
            if at:
                fps, m = np.array(fp, dtype=np.int64), len(at)
                lists = pa.ListArray.from_arrays(np.arange(m + 1, dtype=np.int32) * (BITS // 64), np.concatenate(bits))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array(n, pa.int64()), pa.array(fps[:, 0]), pa.array(fps[:, 1]), lists,
                     pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names)
        if kept:
            counts += count()
        for number, salt, part in slices(counts, TaskContext.get().partitionId()):
            empty = [pa.nulls(1, pa.int64())] * 4 + [pa.nulls(1, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [*empty, pa.array([number], pa.int32()), pa.array([salt], pa.int32()), pa.array([part], pa.binary())], names)

    names = [key, "n", "fp1", "fp2", "bits", "slice", "salt", "counts"]
    return docs.select(key, text).mapInArrow(
        make, f"{key} long, n long, fp1 long, fp2 long, bits array<long>, slice int, salt int, counts binary"
    )


def first_places(s: np.ndarray, order: np.ndarray, p: int) -> np.ndarray:
    """The places of the first ``p`` shingles of ``s`` in the global order: rare first by the counters, then by hash."""
    place = (order[(s & np.uint64(SLOTS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(57)) | (s >> np.uint64(7))
    return np.sort(np.partition(place, p - 1)[:p] if p < len(place) else place)


def signature_table(docs: DataFrame, text: str, k: int, percent: int, boundary: int, ranks) -> DataFrame:
    """List entries ``(token, pos, n, fp1, fp2)`` of every text.

    An even token is a subset, ``pos`` its size. An odd one is a prefix shingle, ``pos`` its place in the global order.
    """
    top = boundary * 100 // percent + 1  # sizes below this can have a partner below the boundary

    def make(batch: pa.RecordBatch):
        order = ranks.value
        parts: list[tuple] = []
        held = 0

        def flush():
            token, pos, n, a, b = (np.concatenate(x) for x in zip(*parts))
            return {"token": token.view(np.int64), "pos": pos.astype(np.int32), "n": n.astype(np.int32), "fp1": a, "fp2": b}

        for _, s in sets_of(batch.column(0), k):
            n = len(s)
            if not n:
                continue
            a, b = fingerprint(s)
            rows = []
            if n < top:
                sub = list(subsets(s, percent))
                size = np.array([x for x, _ in sub])
                token = mix(np.array([x for _, x in sub], dtype=np.uint64) + size.astype(np.uint64))
                rows.append((token & ~np.uint64(1), size))
            if n >= boundary:
                p = missing(n, percent) + 1
                rows.append((first_places(s, order, p) | np.uint64(1), np.arange(p)))
            for token, pos in rows:
                m = len(token)
                held += m
                parts.append((token, pos, np.full(m, n), np.full(m, a), np.full(m, b)))
            if held > 50_000:
                yield flush()
                parts, held = [], 0
        if parts:
            yield flush()

    return map_batches(docs.select(text), make, "token long, pos int, n int, fp1 long, fp2 long")


def filter_of(hashes: DataFrame) -> np.ndarray:
    """A filter of ``FILTER`` bits, packed, that every hash in the first column passes; its size does not depend on their number."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(FILTER, dtype=bool)
        for batch in batches:
            seen[batch.column(0).to_numpy() & (FILTER - 1)] = True
        for number, salt, part in slices(np.packbits(seen, bitorder="little").view("<i8"), TaskContext.get().partitionId()):
            yield pa.RecordBatch.from_arrays(
                [pa.array(["all"]), pa.array([number], pa.int32()), pa.array([salt], pa.int32()), pa.array([part], pa.binary())],
                ["of", "slice", "salt", "counts"])

    parts = hashes.mapInArrow(make, "of string, slice int, salt int, counts binary")
    return sum_arrays(parts, "of", FILTER // 64, np.bitwise_or).get("all", np.zeros(FILTER // 64, dtype=np.int64))


def passes(packed: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes pass the filter."""
    at = h & (FILTER - 1)
    return (packed[at >> 6] >> (at & 63) & 1) != 0


def whole_sets(docs: DataFrame, text: str, k: int, wanted: np.ndarray) -> DataFrame:
    """``(fp1, fp2, shingles)`` of the texts whose ``fp1`` passes the filter ``wanted``, the shingle hashes as an array."""
    passing = docs.sparkSession.sparkContext.broadcast(wanted)  # FILTER bits

    def packed(fps, parts):
        ends = np.append(0, np.cumsum([len(p) for p in parts])).astype(np.int32)
        pairs = np.array(fps, dtype=np.int64)
        return {"fp1": pa.array(pairs[:, 0]), "fp2": pa.array(pairs[:, 1]),
                "shingles": pa.ListArray.from_arrays(ends, np.concatenate(parts))}

    def make(batch: pa.RecordBatch):
        fps, parts, held = [], [], 0
        for _, s in sets_of(batch.column(0), k):
            f = fingerprint(s)
            if len(s) and passes(passing.value, np.int64(f[0])):
                fps.append(f)
                parts.append(s.view(np.int64))
                held += len(s)
                if held > 500_000:
                    yield packed(fps, parts)
                    fps, parts, held = [], [], 0
        if fps:
            yield packed(fps, parts)

    return map_batches(docs.select(text), make, "fp1 long, fp2 long, shingles array<long>")


def only_passing(df: DataFrame, column: str, packed: np.ndarray) -> DataFrame:
    """Rows whose hash in ``column`` passes the filter."""
    shared, at = df.sparkSession.sparkContext.broadcast(packed), df.columns.index(column)  # FILTER bits

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(shared.value, batch.column(at).to_numpy())))

    return df.mapInArrow(make, df.schema)


def _may_link(percent: int, n: Column, m: Column, i: Column, j: Column) -> Column:
    """Bounds on two sets of n and m shingles that meet at places i and j of the order.

    The shorter has at least ``percent`` of the longer; for the first shingle they share, all before it on either side
    are not shared, and the number of those is at most what the union leaves.
    """
    union_room = F.floor((n + m) * (100 - percent) / (100 + percent))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (i + j <= union_room)


def pairs_by_difference(members: DataFrame, sets: DataFrame, ranks, percent: int) -> DataFrame:
    """Pairs ``(a1, a2, b1, b2)`` of members with different labels around one pivot that may link.

    ``members`` has rows ``(p1, p2, fp1, fp2, n, label)``, a pivot and a set, ``sets`` the shingles ``s`` of all of them by ``(fp1, fp2)``.
    Every member that links with its pivot has the pivot's label. Two linked sets of n and m shingles differ in as
    many shingles, r at most, as their differences from the pivot do. So the first r + 1 shingles of both differences, in one order, have one in
    common: otherwise the differences, and the sets, would differ in more, or both would be so small that both sets link with the pivot.
    """

    def make(batch: pa.RecordBatch):
        kept = ("p1", "p2", "fp1", "fp2", "n", "label")
        rows, parts, sizes, held = [], [], [], 0

        def flush():
            many = [len(x) for x in parts]
            at = np.repeat(rows, many)
            return {c: batch.column(c).take(pa.array(at)) for c in kept} | {
                "x": np.concatenate(parts).view(np.int64), "i": np.concatenate([np.arange(m, dtype=np.int32) for m in many]),
                "d": np.repeat(np.array(sizes, dtype=np.int32), many)}

        for row, (n, differ) in enumerate(zip(batch.column("n").to_pylist(), batch.column("differ"))):
            differ = differ.values.to_numpy().view(np.uint64)
            parts.append(first_places(differ, ranks.value, n * (100 - percent) // percent + 1))
            rows.append(row)
            sizes.append(len(differ))
            held += len(parts[-1])
            if held > 50_000:
                yield flush()
                rows, parts, sizes, held = [], [], [], 0
        if rows:
            yield flush()

    pivots = sets.withColumnsRenamed({"fp1": "p1", "fp2": "p2", "s": "p_set"})
    differ = F.concat(F.array_except("s", "p_set"), F.array_except("p_set", "s"))
    whole = members.join(sets, ["fp1", "fp2"]).join(pivots, ["p1", "p2"]).select("p1", "p2", "fp1", "fp2", "n", "label", differ.alias("differ"))
    schema = "p1 long, p2 long, fp1 long, fp2 long, n int, label long, x long, i int, d int"
    places = stored(map_batches(whole, make, schema), "differences")
    x, y = places.alias("x"), places.alias("y")
    n, m, i, j = F.col("x.n"), F.col("y.n"), F.col("x.i"), F.col("y.i")
    # Before the first shingle that they share nothing is shared, and after it at least as many differ as one has more.
    apart = i + j + F.abs((F.col("x.d") - i) - (F.col("y.d") - j))
    together = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("p1", "p2", "x")]
    return x.join(y, together[0] & together[1] & together[2] & (F.col("x.label") < F.col("y.label")) & _may_link(percent, n, m, apart, F.lit(0))).select(
        F.col("x.fp1").alias("a1"), F.col("x.fp2").alias("a2"), F.col("y.fp1").alias("b1"), F.col("y.fp2").alias("b2")).distinct()


def _near_bits(percent: int) -> Column:
    differ = F.aggregate(F.zip_with("a_bits", "b_bits", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return differ <= F.floor((F.col("a_n") + F.col("b_n")) * (100 - percent) / (100 + percent))


def jaccard_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3, percent: int = 90
) -> DataFrame:
    """``(key, n_shingles, component_id, boundary)`` for every row of ``docs``.

    A text's set: its distinct shingles of ``k`` lower-cased (A-Z) words between blanks; with fewer words, all of them
    as one. Null texts and texts without words have no shingle, are linked with nothing and are their own component.
    Equal sets (also of rows with the same key) are in one component. A row without a key takes part, but does
    not name a component; its component is null if no row in it has a key. Further columns of ``docs`` are ignored.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text"))
    made = stored(set_table(docs, "_text", "_id", k), "sets")
    rows = made.filter("slice IS NULL").select("_id", "n", "fp1", "fp2", "bits")
    counts = sum_arrays(made.filter("slice IS NOT NULL").select(F.lit("all").alias("of"), "slice", "salt", "counts"), "of", SLOTS)
    counts = counts.get("all", np.zeros(SLOTS, dtype=np.int64))
    ranks = spark.sparkContext.broadcast(np.floor(4 * np.log2(counts + 1.0)).clip(0, 127).astype(np.uint8))  # SLOTS bytes

    classes = stored(
        rows.filter("n > 0").groupBy("fp1", "fp2").agg(F.first("n").alias("n"), F.min("_id").alias("rep"), F.first("bits").alias("bits"))
        .withColumn("node", F.coalesce("rep", F.xxhash64("fp1", "fp2"))),
        "classes",
    )
    sizes = {r["n"]: r["count"] for r in classes.filter("n < 100").groupBy("n").count().collect()}
    boundary = choose_boundary(sizes, percent, rare_list_length(counts, 1 - percent / 100))

    entries = stored(signature_table(docs, "_text", k, percent, boundary, ranks), "entries")
    # Tokens of two different sets at least; the filter keeps most other entries out of the shuffle.
    shared = stored(
        entries.groupBy("token").agg(F.min("fp1").alias("low"), F.max("fp1").alias("high")).filter("low <> high").select("token"), "shared"
    )
    live = stored(only_passing(entries, "token", filter_of(shared)).join(shared, "token"), "live")
    is_list = F.col("token") % 2 != 0
    # Of equal places the smallest fingerprint: the lists of one group then mostly have one head.
    first = F.struct(F.when(is_list, F.col("pos")).otherwise(F.col("n")).alias("by"), "fp1", "fp2", "n", "pos")
    heads = stored(
        live.groupBy("token").agg(F.min(first).alias("head")).select("token", *(F.col(f"head.{c}").alias(f"h_{c}") for c in ("n", "pos", "fp1", "fp2"))),
        "heads",
    )
    met = live.join(heads, "token")
    n, m, i, j = F.col("n"), F.col("h_n"), F.col("pos"), F.col("h_pos")
    other = (F.col("fp1") != F.col("h_fp1")) | (F.col("fp2") != F.col("h_fp2"))
    sure = F.col("pos") * (100 + percent) >= (n + m) * percent
    ends = [F.col("h_fp1").alias("a1"), F.col("h_fp2").alias("a2"), F.col("fp1").alias("b1"), F.col("fp2").alias("b2")]
    candidates = stored(
        met.filter(other & F.when(is_list, _may_link(percent, n, m, i, j)).otherwise(sure)).select(*ends, is_list.alias("check")).distinct(), "candidates"
    )
    by_subset, by_list = candidates.filter(~F.col("check")).drop("check"), candidates.filter("check").drop("check")

    slim = stored(classes.select("fp1", "fp2", "node", "n", "bits"), "nodes")

    def named(pairs: DataFrame, side: str) -> DataFrame:
        c = slim.select(F.col("fp1").alias(f"{side}1"), F.col("fp2").alias(f"{side}2"), F.col("node").alias(side),
                        F.col("n").alias(f"{side}_n"), F.col("bits").alias(f"{side}_bits"))
        return pairs.join(c, [f"{side}1", f"{side}2"])

    def near(pairs: DataFrame) -> DataFrame:
        """Those of the pairs ``(a1, a2, b1, b2)`` of nodes whose bitmaps allow a link, with the nodes ``(a, b)``."""
        return stored(named(named(pairs, "a"), "b").filter(_near_bits(percent)).select("a", "b", "a1", "a2", "b1", "b2"), "near")

    def ends_of(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a1").alias("fp1"), F.col("a2").alias("fp2")).union(pairs.select("b1", "b2"))

    def sets_for(wanted: DataFrame) -> DataFrame:
        """``(fp1, fp2, s)``: the whole sets wanted."""
        wanted = stored(wanted.distinct(), "wanted")
        sets = whole_sets(docs, "_text", k, filter_of(wanted.select("fp1"))).join(wanted, ["fp1", "fp2"], "left_semi")
        return stored(sets.groupBy("fp1", "fp2").agg(F.first("shingles").alias("s")), "whole")

    def linked(pairs: DataFrame, own: DataFrame) -> DataFrame:
        """Those of the near pairs that link, as ``(a, b)``."""
        a = pairs.join(own.withColumnsRenamed({"fp1": "a1", "fp2": "a2", "s": "a_set"}), ["a1", "a2"])
        both = a.join(own.withColumnsRenamed({"fp1": "b1", "fp2": "b2", "s": "b_set"}), ["b1", "b2"])
        shared = F.size(F.array_intersect("a_set", "b_set"))
        return both.filter(shared * (100 + percent) >= (F.size("a_set") + F.size("b_set")) * percent).select("a", "b")

    small = named(named(by_subset, "a"), "b").select("a", "b")
    by_list = near(by_list)
    links = stored(linked(by_list, sets_for(ends_of(by_list))).union(small), "links")
    labels = stored(components(links), "labels")

    # What is left: members of one list that are not yet in one component.
    known = slim.join(labels, "node", "left").select("fp1", "fp2", F.coalesce("component", "node").alias("label"))
    listed = live.filter(is_list)
    listed = stored(listed.join(stored(known, "known"), ["fp1", "fp2"]), "listed")
    mixed = stored(
        listed.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("size")).filter("x <> y")
        .select("token", (F.col("size") > DIRECT).alias("long")), "mixed"
    )
    open_lists = stored(listed.join(mixed, "token").distinct(), "open")
    x, y = open_lists.filter("NOT long").alias("x"), open_lists.filter("NOT long").alias("y")
    rest = near(x.join(
        y,
        (F.col("x.token") == F.col("y.token")) & (F.col("x.label") < F.col("y.label"))
        & _may_link(percent, F.col("x.n"), F.col("y.n"), F.col("x.pos"), F.col("y.pos")),
    ).select(F.col("x.fp1").alias("a1"), F.col("x.fp2").alias("a2"), F.col("y.fp1").alias("b1"), F.col("y.fp2").alias("b2")).distinct())
    around = open_lists.filter("long").join(heads.select("token", F.col("h_fp1").alias("p1"), F.col("h_fp2").alias("p2")), "token")
    members = stored(
        around.filter("fp1 <> p1 OR fp2 <> p2").select("p1", "p2", "fp1", "fp2", "n", "label").distinct(), "members")
    whole = sets_for(ends_of(rest).union(members.select("fp1", "fp2")).union(members.select("p1", "p2")))
    apart = near(pairs_by_difference(members, whole, ranks, percent))
    more = stored(linked(rest.union(apart), whole), "more")
    # The components so far stand for their links.
    so_far = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
    final = stored(components(so_far.union(more)), "components")

    of_class = stored(
        classes.join(final, "node", "left").select("fp1", "fp2", F.coalesce("component", "node").alias("component"), "rep"), "of_class"
    )
    # Where a text without a key is in a component, its node is a hash; the name is the smallest key all the same.
    unnamed = of_class.filter("rep IS NULL").select("component").distinct()
    named_anew = of_class.join(unnamed, "component", "left_semi").groupBy("component").agg(F.min("rep").alias("least")).withColumn("anew", F.lit(True))
    of_class = of_class.join(named_anew, "component", "left").select(
        "fp1", "fp2", F.when(F.col("anew"), F.col("least")).otherwise(F.col("component")).alias("component"))
    own = rows.select("_id", "n", "fp1", "fp2").join(of_class.withColumnRenamed("fp2", "c2").withColumnRenamed("fp1", "c1"),
                                                     (F.col("fp1") == F.col("c1")) & (F.col("fp2") == F.col("c2")) & (F.col("n") > 0), "left")
    return own.select(
        F.col("_id").alias(key),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("_id")).alias("component_id"),
        F.lit(boundary).alias("boundary"),
    )


def one_of_each_group(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` less near duplicates: of each component the row with the smallest key stays.

    Rows without a key all stay. Rows that repeat key and text are one; rows with one key and other texts stay or go together,
    with the component of any of them that names the key.
    """
    found = jaccard_components(docs, key, text, k, percent)
    keys = found.select(F.col(key).alias("__key"), (F.col("component_id") == F.col(key)).alias("__first")).filter("__key IS NOT NULL")
    gone = keys.groupBy("__key").agg(F.max("__first").alias("__stays")).filter("NOT __stays").select("__key")
    kept = docs.join(stored(gone, "gone"), F.col(key) == F.col("__key"), "left_anti")
    repeated = stored(keys.groupBy("__key").count().filter("count > 1").select("__key"), "repeated")
    single = kept.join(repeated, F.col(key) == F.col("__key"), "left_anti")
    again = kept.join(repeated, F.col(key) == F.col("__key"), "left_semi").dropDuplicates([key, text])
    return single.unionByName(again)
