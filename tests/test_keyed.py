"""The keyed table: buckets that split, folders that are merged, and commits that write no more than they must."""

import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.plans.harvest import merge_increment
from shelfmark.sinks.keyed import KeyedTable
from shelfmark.streaming.ingest import ingest_increment, read_ingested

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("v", T.StringType())])


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def held(table):
    return sorted(tuple(r) for r in table.read().collect())


def files(path):
    return sorted(str(p.relative_to(path)) for p in Path(path).rglob("part-*.parquet") if "data" in p.parts)


@pytest.mark.parametrize("replace", [False, True])
def test_against_a_dictionary(spark, tmp_path, replace):
    """Many commits of random keys, with splits and merged folders, and a repeated commit now and then."""
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, "id", "score", bucket_rows=40, folders_per_bucket=2)
    r, want = random.Random(4), {}
    for n in range(5):
        rows = {k: (k, None if r.random() < 0.1 else r.random(), f"{n}") for k in r.sample(range(400), r.choice([0, 5, 60, 150]))}
        for _ in range(r.choice([1, 2])):
            (table.replace if replace else table.insert)(frame(spark, list(rows.values())), tag=f"run/{n}")
        want.update(rows if replace else {k: v for k, v in rows.items() if k not in want})
    assert held(table) == sorted(want.values())
    parts = table.parts()
    assert sum(p.rows for p in parts) == len(want)
    by_bucket = Counter()
    for p in parts:
        by_bucket[p.bucket] += p.rows
        own = table.read([p]).collect()
        keys, scores = [x.id for x in own], [x.score for x in own if x.score is not None]
        assert (p.rows, p.low_key, p.high_key) == (len(own), min(keys), max(keys))
        assert (p.low_score, p.high_score) == (min(scores, default=None), max(scores, default=None))
    # Buckets are disjoint, and each is full only by the chance of hashing.
    assert all(a == b or (a[1] ^ b[1]) & ((1 << min(a[0], b[0])) - 1) for a in by_bucket for b in by_bucket)
    assert max(by_bucket.values()) <= 80 and max(Counter(p.bucket for p in parts).values()) <= 3


def test_a_first_load_of_any_size_is_written_bucket_by_bucket(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, "id", bucket_rows=1000)
    table.insert(spark.range(20_000).select("id", F.rand(1).alias("score"), F.lit("x").alias("v")))
    parts = table.parts()
    assert len(parts) == len(files(tmp_path / "t")) == 32 and table.read().count() == 20_000
    assert max(p.rows for p in parts) < 1000


def test_many_batches_leave_few_files(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, "id", bucket_rows=60, folders_per_bucket=2)
    for n in range(8):
        table.insert(frame(spark, [(n * 10 + i, float(n), "x") for i in range(10)]), tag=str(n))
    assert len(table.parts()) <= 4 * 3 and table.read().count() == 80
    # Files of this state and the one before are all that is left, and as few directories.
    assert len(files(tmp_path / "t")) <= 2 * 4 * 3
    assert len(table.versions()) <= 2


def test_a_merge_writes_what_the_increment_meets(spark, tmp_path):
    """One run changes few keys: all other folders stay as they are, and the bytes written follow the increment."""
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, "id", "score", bucket_rows=700)
    merge_increment(table, spark.range(8000).select("id", F.col("id").cast("double").alias("score"), F.lit("old").alias("v")), "1")
    before = {p.folder for p in table.parts()}
    new = [(17, 1.0, "worse"), (17, 9e9, "new"), (17, 2.0, "worse"), (9001, None, "added"), (None, 1.0, "no key")]
    merge_increment(table, frame(spark, new), "2")
    after = {p.folder for p in table.parts()}
    assert len(before - after) == 1 and len(after - before) <= 2
    size = lambda folders: sum(p.rows for p in table.parts() if p.folder in folders)
    assert size(after - before) < 0.1 * size(after)
    rows = {r.id: (r.score, r.v) for r in table.read().collect()}
    assert len(rows) == 8001 and rows[17] == (9e9, "new") and rows[9001] == (None, "added") and rows[18] == (18.0, "old")
    merge_increment(table, frame(spark, new), "2")
    assert {p.folder for p in table.parts()} == after


def test_highest_scores_are_read_from_few_folders(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, "id", "score", bucket_rows=100, folders_per_bucket=20)
    table.insert(frame(spark, [(i, float(i), "x") for i in range(60)] + [(1000, None, "n")]))
    for n in range(1, 4):
        table.insert(frame(spark, [(100 * n + i, float(1000 * n + i // 2), "x") for i in range(5)]))
    want = sorted((r for r in held(table) if r[1] is not None), key=lambda r: (-r[1], r[0]))
    top = table.top(4)
    assert [tuple(r) for r in top.collect()] == want[:4]
    assert len(top.inputFiles()) < len(table.parts())
    assert [tuple(r)[0] for r in table.top(1000).collect()] == [r[0] for r in want] + [1000]


def test_a_commit_that_broke_off_leaves_the_state_before(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, "id", bucket_rows=10)
    table.insert(frame(spark, [(i, 0.0, "a") for i in range(30)]), "1")

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(KeyedTable, "_publish", fail)
        table.replace(frame(spark, [(i, 0.0, "b") for i in range(20, 50)]), "2")
    assert {v for _, _, v in held(table)} == {"a"} and len(held(table)) == 30
    table.replace(frame(spark, [(i, 0.0, "b") for i in range(20, 50)]), "2")
    assert Counter(v for _, _, v in held(table)) == {"a": 20, "b": 30}


def test_text_keys(spark, tmp_path):
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("n", T.LongType())])
    table = KeyedTable(spark, str(tmp_path / "t"), schema, "name", "n", bucket_rows=5)
    table.insert(spark.createDataFrame([(f"k {i}", i) for i in range(40)] + [("", 1)], schema))
    table.replace(spark.createDataFrame([("k 3", 99), ("été", 2)], schema))
    rows = {r.name: r.n for r in table.read().collect()}
    assert len(rows) == 42 and rows["k 3"] == 99 and rows[""] == 1 and table.top(1).first().name == "k 3"


def test_ingest_in_small_buckets(spark, tmp_path):
    """A backlog in many batches: the same catalogue, in files whose number follows the rows."""
    for n in range(5):
        rows = [f'{{"id": {n * 30 + i}, "score": {n}, "v": "{n}"}}' for i in range(50)]
        (tmp_path / "drops").mkdir(exist_ok=True)
        (tmp_path / "drops" / f"{n}.json").write_text("\n".join(rows))
    ingest_increment(
        spark, str(tmp_path / "drops"), str(tmp_path / "held"), str(tmp_path / "cp"), SCHEMA, "id", [F.asc("score")],
        quarantine=str(tmp_path / "bad"), files_per_batch=1, bucket_rows=50, folders_per_bucket=2)
    got = {r.id: r.v for r in read_ingested(spark, str(tmp_path / "held"), SCHEMA, "id").collect()}
    assert set(got) == set(range(170))
    table = KeyedTable(spark, str(tmp_path / "held"), SCHEMA, "id")
    assert len(table.parts()) <= 3 * len({p.bucket for p in table.parts()}) and not (tmp_path / "bad").exists()
