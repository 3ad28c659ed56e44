"""Sources and sinks."""

import json
import uuid
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.session import free_scratch, scratch_made, scratch_path
from shelfmark.sinks.folders import names
from shelfmark.sinks import writers as W
from shelfmark.sources import readers as S


@pytest.mark.parametrize("base", [None, "items"])
def test_chunks_have_exactly_the_given_rows_and_numbers(spark, tmp_path, base):
    """Tasks of very different sizes, some empty; rows keep their order."""
    parts = [spark.range(a, b, 1, n) for a, b, n in ((0, 1, 1), (1, 1, 2), (1, 1700, 1), (1700, 2300, 4))]
    df = parts[0].union(parts[1]).union(parts[2]).union(parts[3]).withColumn("t", F.lit('a "b", c'))
    path = W.write_csv_chunked(df, str(tmp_path / "out"), chunk_size=500, base=base)
    files = [tmp_path / "out" / f"items_{n}.csv" for n in range(1, 6)] if base else [f for n in range(1, 6) for f in (tmp_path / "out" / f"chunk={n}").glob("part-*.csv")]
    assert len(files) == 5
    ids = [[int(line.split(",")[0]) for line in f.read_text().splitlines()[1:]] for f in files]
    assert [len(i) for i in ids] == [500] * 4 + [300] and sum(ids, []) == list(range(2300))
    assert S.read_csv_multi(spark, path, df.schema).filter("t = 'a \"b\", c'").count() == 2300


def test_chunks_of_nothing(spark, tmp_path):
    df = spark.range(0)
    assert S.read_csv_multi(spark, W.write_csv_chunked(df, str(tmp_path / "none")), df.schema).count() == 0
    with pytest.raises(ValueError):
        W.write_csv_chunked(df.withColumnRenamed("id", "chunk"), str(tmp_path / "bad"))


def test_sorted_csv_is_in_order_over_its_files_and_quotes_all(spark, tmp_path):
    # Most rows share one score.
    df = spark.range(0, 5000, 1, 8).select("id", F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(0).alias("s"))
    path = str(tmp_path / "sorted")
    W.write_csv_quoteall_sorted(df, path, "s", "id")
    lines = []
    for part in sorted((tmp_path / "sorted").glob("part-*.csv")):
        head, *body = part.read_text().splitlines()
        assert head == '"id","s"' or head == "id,s"
        lines += body
    assert all(line.startswith('"') and line.endswith('"') for line in lines)
    pairs = [tuple(map(int, line.replace('"', "").split(","))) for line in lines]
    assert pairs == sorted(pairs, key=lambda p: (-p[1], p[0])) and len(pairs) == 5000


def test_null_and_empty_text_stay_apart(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, 'a "q"\n, b')], "id long, t string")
    path = W.write_csv_quoteall_sorted(df, scratch_path(spark, "nulls"), "id", "id")
    got = {r.id: r.t for r in S.read_csv_multi(spark, path, df.schema).collect()}
    assert got[2] is None and got[3] == 'a "q"\n, b' and got[1] in ("", None)
    raw = spark.read.text(path, wholetext=True).collect()
    assert any('"NA"' in r.value or ",NA" in r.value for r in raw)


def test_catalog_csv_null_tokens(spark, tmp_path):
    tokens = ["", "NA", "None", "na", "Not Available", '"two\nlines"', '"a ""b"""', "null"]
    file = tmp_path / "c.csv"
    file.write_text("id,t\n" + "\n".join(f"{i},{t}" for i, t in enumerate(tokens)) + "\n")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("t", T.StringType())])
    got = {r.id: r.t for r in S.read_catalog_csv(spark, str(file), schema).collect()}
    assert got == {0: None, 1: None, 2: None, 3: "na", 4: "Not Available", 5: "two\nlines", 6: 'a "b"', 7: None}


def test_csv_inference_over_a_list(spark, tmp_path):
    for name, body in {"a": "x,y\n1,NA\n", "b": "x,y\n2,2.5\n"}.items():
        (tmp_path / f"{name}.csv").write_text(body)
    df = S.read_csv_multi(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], infer=True)
    assert dict(df.dtypes) == {"x": "int", "y": "double"}
    assert sorted(map(tuple, df.collect())) == [(1, None), (2, 2.5)]


def test_ndjson_keeps_bad_lines(spark, tmp_path):
    (tmp_path / "a.ndjson").write_text(json.dumps({"id": 1, "t": "x"}) + "\n{bad\n")
    (tmp_path / "b.ndjson").write_text(json.dumps({"id": 2}) + "\n")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("t", T.StringType())])
    got = {r.id: (r.t, r._corrupt) for r in S.read_ndjson(spark, str(tmp_path), schema).collect()}
    assert got == {1: ("x", None), 2: (None, None), None: (None, "{bad")}


def test_ndjson_appends_and_writes_nulls(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "id int, t string")
    path = str(tmp_path / "out")
    W.write_ndjson(df, path)
    W.write_ndjson(df, path)
    assert spark.read.text(path).collect() == spark.createDataFrame([('{"id":1,"t":null}',)] * 2, "value string").collect()


def test_stopwords_by_file_name_or_folder(spark, tmp_path):
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "english").write_text("the\na\n\n")
    (tmp_path / "files" / "french").write_text("le\n")
    want = [("english", "a"), ("english", "the"), ("french", "le")]
    assert sorted(map(tuple, S.read_stopwords(spark, str(tmp_path / "files")).collect())) == want
    lists = spark.createDataFrame(want, "lang string, word string")
    lists.write.partitionBy("lang").text(str(tmp_path / "folders"))
    assert sorted(map(tuple, S.read_stopwords(spark, str(tmp_path / "folders")).collect())) == want


def test_result_in_one_file(spark, tmp_path):
    W.write_result_csv(spark.range(0, 100, 1, 8), str(tmp_path / "one"), single_file=True)
    assert len(list((tmp_path / "one").glob("part-*"))) == 1


def test_vectors_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.5, 1.5])], "id int, v array<float>")
    path = W.write_features_parquet(df, str(tmp_path / "v"))
    assert S.read_features_parquet(spark, path).collect() == df.collect()


def test_scratch_is_in_the_folder_of_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    first, second = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert first.startswith(base) and first != second and uuid.UUID(first.split("shelfmark-")[-1].split("/")[0])


def test_scratch_is_freed_but_for_what_is_read(spark):
    with scratch_made() as made:
        one, two = scratch_path(spark, "one"), scratch_path(spark, "two")
    scratch_path(spark, "other")
    assert len(made) == 2
    for path in (one, two):
        spark.range(3).write.parquet(path)
    needed = spark.read.parquet(two)
    free_scratch(spark, made, needed)
    assert [two.startswith(root) for root in made] == [True] and needed.count() == 3 and names(spark, one) == []
    free_scratch(spark, made, spark.range(1))
    assert made == [] and names(spark, two) == []


def test_scratch_falls_back_to_the_warehouse():
    conf = {"spark.sql.warehouse.dir": "file:/shared/warehouse"}
    assert scratch_path(SimpleNamespace(conf=conf), "x").startswith("file:/shared/warehouse/_scratch/shelfmark-")


SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("keywords", T.StringType()), T.StructField("genres", T.StringType())])


def test_csv_columns_go_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,genres,keywords\n1,Drama,sea\n")
    (tmp_path / "b.csv").write_text("more,keywords,id,genres\nx,storm,2,War\n")
    paths = [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]
    want = [(1, "sea", "Drama"), (2, "storm", "War")]
    for read in (S.read_catalog_csv, S.read_csv_multi):
        for multi_line in (True, False):
            assert sorted(map(tuple, read(spark, paths, SCHEMA, multi_line=multi_line).collect())) == want
    (tmp_path / "c.csv").write_text("id,genres\n3,War\n")
    with pytest.raises(ValueError, match="keywords"):
        S.read_catalog_csv(spark, str(tmp_path / "c.csv"), SCHEMA)


def test_files_of_one_folder_may_have_several_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,genres,keywords\n1,Drama,sea\n")
    (tmp_path / "b.csv").write_text("id,keywords,genres\n2,storm,War\n")
    (tmp_path / "empty.csv").write_text("")
    assert sorted(map(tuple, S.read_catalog_csv(spark, str(tmp_path), SCHEMA).collect())) == [(1, "sea", "Drama"), (2, "storm", "War")]


def test_one_scan_for_each_header(spark, tmp_path):
    """A thousand files with three headers; whole numbers in some files and others in others."""
    heads = ["x,y,when", "y,x", 'when,"y",x,extra']
    for i in range(1000):
        head = heads[i % 3]
        values = {"x": str(i), "y": "2.5" if i == 700 else str(i), "when": "2001-02-03", "extra": "" if i == 2 else "t"}
        (tmp_path / f"{i}.csv").write_text(head + "\n" + ",".join(values[c.strip('"')] for c in head.split(",")) + "\n")
    df = S.read_csv_multi(spark, str(tmp_path), infer=True)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 3
    assert dict(df.dtypes) == {"x": "int", "y": "double", "when": "date", "extra": "string"}
    assert (df.count(), df.agg(F.sum("x"), F.count("when"), F.count("extra")).first()[0:]) == (1000, (499500, 667, 332))


def test_types_of_texts(spark):
    columns = {
        "int": ["1", "-7", None], "bigint": ["1", "3000000000"], "double": ["1", "2.5", "1e-3"], "date": ["2001-02-03"], "timestamp": ["2001-02-03", "2001-02-03 04:05:06"],
        "boolean": ["true", "False"], "none": [None], "mixed": ["1", "true"], "bad_day": ["2001-02-30"], "suffix": ["1d", "2f"], "blank": ["1", ""], "huge": ["99999999999999999999"],
    }
    rows = [tuple(v[i] if i < len(v) else None for v in columns.values()) for i in range(3)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns)).repartition(3)
    kinds = S.infer_types(df)
    assert {c: k for c, k in kinds.items() if k != "string"} == {**{c: c for c in list(columns)[:6]}, "huge": "double"}


def test_header_with_line_break_mark_and_pattern(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\ufeffid,"two\nlines"\n1,x\n')
    (tmp_path / "b.txt").write_text("id\n2\n")
    assert S.read_csv_multi(spark, str(tmp_path / "*.csv")).columns == ["id", "two\nlines"]
    with pytest.raises(FileNotFoundError):
        S.read_csv_multi(spark, str(tmp_path / "absent"))


def test_a_value_its_type_cannot_hold_is_null(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,genres,keywords\nx,Drama,sea\n")
    assert S.read_csv_multi(spark, str(tmp_path / "a.csv"), SCHEMA).collect()[0].id is None


def test_stopword_list(spark, tmp_path):
    (tmp_path / "english").write_text("the\na\n")
    assert S.stopword_list(spark, str(tmp_path), "english") == ["a", "the"]
    with pytest.raises(ValueError):
        S.stopword_list(spark, str(tmp_path), "french")
