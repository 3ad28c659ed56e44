"""Ingest and the composed jobs, on files."""

import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.plans.analyse import run_analysis
from shelfmark.plans.clean import run_clean
from shelfmark.plans.harvest import flatten_records, run_harvest, run_increment
from shelfmark.schema import CATALOG_SCHEMA, RAW_SCHEMA
from shelfmark.sources.readers import read_catalog_csv, read_csv_multi, read_ndjson
from shelfmark.streaming.ingest import ingest_increment, read_ingested

SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("v", T.StringType()),
])


def drop(folder, name, records):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records) + "\n")


def ingest(spark, root, checkpoint="cp"):
    ingest_increment(
        spark, str(root / "drops"), str(root / "held"), str(root / checkpoint), SCHEMA, "id", [F.asc("seq")],
        quarantine=str(root / "bad"),
    )
    return sorted((r.id, r.v) for r in read_ingested(spark, str(root / "held"), SCHEMA, "id").collect())


def test_ingest_takes_each_file_once_and_the_first_record_per_id(spark, tmp_path):
    drop(tmp_path / "drops", "1.json", [
        {"id": 1, "seq": 2, "v": "late"}, {"id": 1, "seq": 1, "v": "first"}, {"id": 2, "seq": 1, "v": "b"},
        "{bad", {"seq": 9, "v": "no id"},
    ])
    assert ingest(spark, tmp_path) == [(1, "first"), (2, "b")]
    assert ingest(spark, tmp_path) == [(1, "first"), (2, "b")]
    drop(tmp_path / "drops", "2.json", [{"id": 2, "seq": 0, "v": "again"}, {"id": 3, "seq": 1, "v": "c"}])
    assert ingest(spark, tmp_path) == [(1, "first"), (2, "b"), (3, "c")]
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 2


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    drop(tmp_path / "drops", "1.json", [{"id": 1, "seq": 1, "v": "a"}])
    ingest(spark, tmp_path)
    drop(tmp_path / "drops", "2.json", [{"id": 1, "seq": 0, "v": "x"}, {"id": 2, "seq": 1, "v": "b"}])
    ingest(spark, tmp_path)
    # As after a crash between the write and the commit of the second batch.
    for name in ("1", ".1.crc"):
        (tmp_path / "cp" / "commits" / name).unlink(missing_ok=True)
    assert ingest(spark, tmp_path) == [(1, "a"), (2, "b")]


def raw(i, **fields):
    base = {
        "id": i, "title": f"Title {i}", "vote_average": 7.5, "vote_count": 100 + i, "status": "Released",
        "release_date": "2001-02-03", "revenue": 10 * i, "runtime": 90 + i, "adult": False, "backdrop_path": "/b",
        "budget": i * i, "homepage": None, "imdb_id": f"tt{i}", "original_language": "en",
        "original_title": f"Title {i}", "overview": "A brave captain\nsails home", "popularity": 1.5,
        "poster_path": f"/p{i}", "tagline": "One ship", "keywords": "sea, storm",
        "genres": [{"name": "Drama"}, {"name": "Sea"}], "production_companies": [{"name": "N/A"}],
        "production_countries": [], "spoken_languages": [{"english_name": "English"}],
    }
    return {**base, **fields}


def test_flatten_fills_types_and_drops_sentinels(spark, tmp_path):
    drop(tmp_path / "in", "a.json", [
        raw(1, homepage="None", release_date="", vote_count=None, adult=None, status="Not Available"),
        raw(2, release_date="1500-01-01", tagline="", genres=None),
    ])
    got = {r.id: r for r in flatten_records(read_ndjson(spark, str(tmp_path / "in"), RAW_SCHEMA)).collect()}
    one, two = got[1], got[2]
    assert (one.homepage, one.release_date, one.vote_count, one.adult, one.status) == (None, None, 0, False, None)
    assert one.overview == "A brave captain sails home"
    assert (one.genres, one.production_companies, one.production_countries) == ("Drama, Sea", None, None)
    assert (two.release_date, two.tagline, two.genres, two.spoken_languages) == (None, None, None, "English")


@pytest.fixture(scope="module")
def jobs(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("jobs")
    old = root / "old.json"
    records = [raw(i, vote_average=6.0 + (i % 4), runtime=80 + i * 3 % 17) for i in range(1, 25)]
    old.write_text("\n".join(map(json.dumps, records)) + "\n")
    first = run_harvest(spark, _empty_catalog(root), str(old), str(root / "h1"))
    drop(root / "drops", "new.json", [
        raw(1, title="Renewed", vote_count=9999), raw(30, title="Title 2", vote_count=5),
        raw(31, poster_path=None), "{bad", {"title": "no id"},
    ])
    second = run_harvest(spark, first, str(root / "drops"), str(root / "h2"))
    return root, second


def _empty_catalog(root):
    path = root / "empty.csv"
    path.write_text(",".join(CATALOG_SCHEMA.names) + "\n")
    return str(path)


def test_harvest_merges_and_quarantines(spark, jobs):
    root, path = jobs
    merged = read_catalog_csv(spark, path, CATALOG_SCHEMA)
    rows = {r.id: r for r in merged.collect()}
    assert set(rows) == {*range(1, 25), 30, 31}
    assert rows[1].title == "Renewed" and rows[1].vote_count == 9999
    assert spark.read.json(str(root / "h2" / "quarantine")).count() == 2


def test_clean_then_analyse(spark, jobs):
    root, path = jobs
    paths = run_clean(spark, path, str(root / "clean"), "https://img.example.org")
    cleaned = read_csv_multi(spark, paths["cleaned"], infer=True)
    rows = {r.id: r for r in cleaned.collect()}
    # 30 repeats title and date of 2 with fewer votes, 31 has no poster.
    assert set(rows) == set(range(1, 25))
    assert rows[3].poster_path == "https://img.example.org/p3"
    assert (rows[3].release_year, rows[3].release_month, rows[3].release_day) == (2001, 2, 3)
    assert rows[3].text == "A brave captain sails home One ship sea, storm"
    assert rows[3].processed_text == "brave captain sails home one ship sea storm"
    profile = {r.column: (r.non_null, r.nulls) for r in read_csv_multi(spark, paths["profile_after"], infer=True).collect()}
    assert profile["title"] == (24, 0) and profile["homepage"] == (0, 24)

    vectors = str(root / "vectors")
    spark.range(1, 40).select(
        "id", F.array(*(((F.col("id") * (d + 3)) % 7).cast("float") for d in range(4))).alias("embedding")
    ).write.parquet(vectors)
    out = run_analysis(spark, paths["cleaned"], vectors, str(root / "reports"), k=3)
    report = {name: read_csv_multi(spark, p, infer=True).collect() for name, p in out.items()}
    rated = {i for i in rows if rows[i].vote_average >= 7}
    assert {r.rating_group: r["count"] for r in report["rating_distribution"]} == {6: 6, 7: 6, 8: 6, 9: 6}
    assert sum(r["count"] for r in report["cluster_sizes"]) == len(rated) == len(report["projection"])
    assert {(r.id, r.title) for r in report["clusters"]} == {(i, rows[i].title) for i in rated}
    for name in ("cluster_preview", "top_items_on_top_dim", "top_items_per_dim"):
        assert all(r.title == rows[r.id].title for r in report[name]) and report[name]
    assert {r.word: r["count"] for r in report["frequent_words"]}["captain"] == len(rated)
    assert {r.genre for r in report["top_genres_per_cluster"]} == {"Drama", "Sea"}
    assert len(report["top_dims_per_cluster"]) == 3 * 4
    names = {r.a for r in report["correlation_matrix"]}
    assert names == {"rating_group", "runtime", "revenue", "budget"}


def test_many_small_batches_give_the_same_catalogue(spark, tmp_path):
    for i in range(4):
        drop(tmp_path / "drops", f"{i}.json", [{"id": j, "seq": i, "v": f"{i}"} for j in range(i + 2)])
    ingest_increment(
        spark, str(tmp_path / "drops"), str(tmp_path / "held"), str(tmp_path / "cp"), SCHEMA, "id",
        [F.asc("seq")], quarantine=str(tmp_path / "bad"), files_per_batch=1,
    )
    held = read_ingested(spark, str(tmp_path / "held"), SCHEMA, "id")
    assert sorted(r.id for r in held.collect()) == list(range(5)) and held.columns == SCHEMA.names


def test_a_new_checkpoint_over_the_same_target_keeps_what_is_held(spark, tmp_path):
    drop(tmp_path / "drops", "1.json", [{"id": 1, "seq": 1, "v": "a"}, {"id": 2, "seq": 1, "v": "b"}])
    ingest(spark, tmp_path)
    drop(tmp_path / "drops", "2.json", [{"id": 9, "seq": 1, "v": "z"}, {"id": 1, "seq": 0, "v": "again"}])
    assert ingest(spark, tmp_path, "other") == [(1, "a"), (2, "b"), (9, "z")]
    assert ingest(spark, tmp_path) == [(1, "a"), (2, "b"), (9, "z")]


def test_increment_job(spark, tmp_path):
    (tmp_path / "old.csv").write_text(",".join(CATALOG_SCHEMA.names) + "\n")
    drop(tmp_path / "drops", "1.json", [raw(1), raw(2), raw(5)])
    run = lambda old, out, **more: run_increment(spark, old, str(tmp_path / "drops"), str(tmp_path / "state"), str(tmp_path / out), **more)
    first = run(str(tmp_path / "old.csv"), "one")
    drop(tmp_path / "drops", "2.json", [raw(3, title="Third"), "{bad"])
    second = run(first["catalog"], "two", latest=8, multi_line=False)
    assert sorted(r.id for r in read_catalog_csv(spark, second["catalog"], CATALOG_SCHEMA).collect()) == [1, 2, 3, 5]
    assert sorted(r.id for r in spark.read.json(second["pending"]).collect()) == [6, 7, 8]
    assert spark.read.parquet(str(tmp_path / "state" / "quarantine")).count() == 1


def test_command_line(jobs):
    root, path = jobs
    out = root / "cli"
    done = subprocess.run(
        [sys.executable, "-m", "shelfmark", "--master", "local[2]", "clean", "--catalog", path, "--base-url",
         "https://img.example.org", "--single-line", "--out", str(out)],
        cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, timeout=300,
    )
    assert done.returncode == 0, done.stderr[-2000:]
    assert sum(len(p.read_text().splitlines()) - 1 for p in (out / "cleaned").glob("chunk=*/part-*.csv")) == 24
