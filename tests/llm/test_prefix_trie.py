import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm.prefix_trie import prefix_trie
from shelfmark.llm.sums import running

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute_force(rows):
    """Multiset of nodes, from whole prefixes held in dictionaries."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append(((turn is not None, turn or 0), (role or "", text or "")))
    turns = {c: [said for _, said in sorted(t, key=lambda x: x[0])] for c, t in turns.items()}
    members, paths = defaultdict(set), {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        first = c - (c % 20 if c >= 0 else -(-c % 20))
        paths[c] = tuple(turns.get(first, [])[:h]) + tuple(own[h:])
        for d in range(len(paths[c]) + 1):
            members[paths[c][:d]].add(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, held in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(held) - 1) * words
            leaves[p[:d]] += not children[p]
    return Counter(
        (min(held), len(p), min(members[p[:-1]]) if p else None, len(held), children[p], leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(c for c in held if paths[c] == p))).encode()).hexdigest())
        for p, held in members.items())


def found(df):
    assert df.columns == COLUMNS
    return Counter(tuple(r) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, parent string")


def test_equals_brute_force_on_the_table(spark, rows):
    made = rows("conversations")
    assert found(prefix_trie(frame(spark, made).repartition(5))) == brute_force(made)


@pytest.fixture(scope="module")
def odd_rows():
    """Shared beginnings, whole copies, lenders that are short or absent, one long conversation twice, nulls, negative ids, repeated rows."""
    r = random.Random(5)
    made = []
    for c in [*range(0, 140), 1_000_000_007, -1, -5, -20, -45]:
        if 40 <= c < 50 or c == 60:
            continue
        start = r.randrange(3)
        made += [(c, t, "user" if t % 2 == 0 else "assistant", f"common {start} {min(t, 2)}" if r.random() < 0.8 else f"own {c}") for t in range(r.randrange(1, 6))]
    for c in (201, 202):
        made += [(c, t, "user", f"a long one {t}\tmore") for t in range(700)]
    made += [(300, None, "user", "no number"), (300, 0, None, None), (300, 1, "user", ""), (301, None, None, None), (None, 0, "user", "nobody"), (None, None, None, None)]
    made += [(302, 0, "user", "again")] * 3
    made += [(400 + i, t, "user", f"same {t}") for i in range(30) for t in range(4)]
    return made


@pytest.mark.parametrize("width", [2, 1 << 20])
def test_edges_with_any_sketch(spark, odd_rows, width):
    assert found(prefix_trie(frame(spark, odd_rows).repartition(7), width=width)) == brute_force(odd_rows)


def test_long_texts_and_the_empty_table(spark):
    made = [(c, t, "user", "word " * 100_000 if t == 0 else "x" * 300_000 + str(c % 2)) for c in range(1, 5) for t in range(2)]
    assert found(prefix_trie(frame(spark, made))) == brute_force(made)
    assert prefix_trie(frame(spark, made).limit(0)).count() == 0


def test_running_sums_across_tasks(spark):
    """Keys of one row, of many, and one that fills several tasks, also with equal rows."""
    r = np.random.default_rng(3)
    keys = np.sort(np.concatenate([np.full(3000, 7), r.integers(0, 400, 2000), np.full(10, -4)]))
    rows = [(int(k), int(r.integers(0, 5)), int(r.integers(0, 9)), int(r.integers(-(2**62), 2**62))) for k in keys]
    df = spark.createDataFrame(rows, "k long, o long, s long, x long").repartition(6).withColumn("n", F.lit(1).cast("long"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = running(df, "k", [F.col("o").asc()], ["n", "s"], ["x"], "t").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    by_key = defaultdict(list)
    for row in out:
        by_key[row["k"]].append(row)
    total, mixed, sizes = Counter(), Counter(), Counter(int(k) for k in keys)
    for k, _, s, x in rows:
        total[k] += s
        mixed[k] ^= x
    assert len({row["_part"] for row in by_key[7]}) > 1
    for k, own in by_key.items():
        own.sort(key=lambda row: row["n"])
        assert [row["n"] for row in own] == list(range(1, sizes[k] + 1))
        assert [row["o"] for row in own] == sorted(row["o"] for row in own)
        assert [row["_part"] for row in own] == sorted(row["_part"] for row in own)
        assert own[-1]["s"] == total[k] and own[-1]["x"] == mixed[k]
