"""Composed jobs on the test tables: ingest, flattening of raw records, cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.bindings.columns import BASE
from shelfmark.bindings.registry import Tables, query
from shelfmark.bindings.texts import PROCESSED
from shelfmark.operators.dedup import quarantine_missing
from shelfmark.plans.clean import clean_catalog
from shelfmark.plans.harvest import flatten_records
from shelfmark.schema import MISSING_DATE, RAW_SCHEMA
from shelfmark.session import scratch_path
from shelfmark.sinks.writers import write_ndjson
from shelfmark.sources.readers import CORRUPT, read_ndjson
from shelfmark.streaming.ingest import ingest_increment, read_ingested


@query("ingest_increment", """
SELECT user_id, event_id, event_type, value, props FROM (
  SELECT *, row_number() OVER (
    PARTITION BY user_id ORDER BY CASE WHEN value >= 10 THEN 0 ELSE 1 END, ts, event_id) AS pos
  FROM events)
WHERE pos = 1""")
def ingest_events(t: Tables) -> DataFrame:
    # Two drops, one run after each, one more run that finds nothing new, and one with a new checkpoint over the
    # same target. Each drop also has an unreadable line and records without a key.
    rows = t.events.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    root = scratch_path(t.spark, "ingest")
    first = F.col("value") >= 10
    for part, checkpoint in ((rows.filter(first), "a"), (rows.filter(~first), "a"), (None, "a"), (None, "b")):
        if part is not None:
            write_ndjson(part, f"{root}/drops")
            write_ndjson(part.filter("event_id % 50 = 0").withColumn("user_id", F.lit(None).cast("bigint")), f"{root}/drops")
            part.limit(1).select(F.lit("{not a record")).write.mode("append").text(f"{root}/drops")
        ingest_increment(
            t.spark, f"{root}/drops", f"{root}/held", f"{root}/checkpoint_{checkpoint}", rows.schema,
            "user_id", [F.asc("ts"), F.asc("event_id")], quarantine=f"{root}/quarantine",
        )
    held = read_ingested(t.spark, f"{root}/held", rows.schema, "user_id")
    return held.select("user_id", "event_id", "event_type", "value", "props")


_NAMES = "array_to_string(list_filter(string_split(p_name, ' '), lambda n: n <> 'ring'), ', ')"


@query("flatten_records", f"""
SELECT p_partkey AS id, p_name || ' ' || p_type AS title, CAST(p_size AS BIGINT) AS vote_count,
       CASE WHEN p_type = 'LARGE' THEN 0.0 ELSE p_retailprice END AS vote_average,
       p_brand = 'Brand#1' AS adult, CASE WHEN p_brand <> 'Brand#2' THEN p_brand END AS status,
       CASE WHEN p_type <> 'PROMO' THEN '2001-02-03' END AS release_date,
       CAST(0 AS BIGINT) AS revenue, nullif({_NAMES}, '') AS genres, p_type AS spoken_languages,
       CAST(NULL AS VARCHAR) AS production_companies
FROM part WHERE p_type <> 'ECONOMY'""")
def flatten_parts(t: Tables) -> DataFrame:
    # Economy parts have no id; the word "ring" is written as a text that stands for "missing".
    kind, brand = F.col("p_type"), F.col("p_brand")
    words = F.split("p_name", " ")
    raw = t.part.select(
        F.when(kind != "ECONOMY", F.col("p_partkey")).alias("id"),
        F.concat("p_name", F.lit("\n"), kind).alias("title"),
        F.col("p_size").cast("bigint").alias("vote_count"),
        F.when(kind != "LARGE", F.col("p_retailprice")).alias("vote_average"),
        F.when(brand == "Brand#1", True).alias("adult"),
        F.when(brand == "Brand#2", "None").otherwise(brand).alias("status"),
        F.when(kind == "PROMO", "").otherwise("2001-02-03").alias("release_date"),
        F.transform(words, lambda w: F.struct(F.when(w == "ring", "N/A").otherwise(w).alias("name"))).alias("genres"),
        F.array(F.struct(kind.alias("english_name"))).alias("spoken_languages"),
    )
    path = write_ndjson(raw, scratch_path(t.spark, "raw_parts"))
    good, _ = quarantine_missing(read_ndjson(t.spark, path, RAW_SCHEMA), "id", CORRUPT)
    return flatten_records(good).select(
        "id", "title", "vote_count", "vote_average", "adult", "status", "release_date", "revenue",
        "genres", "spoken_languages", "production_companies",
    )


@query("clean_catalog", f"""
WITH complete AS (
  SELECT * FROM documents WHERE source <> 'src0'),
first AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text, lang ORDER BY n_chars DESC, doc_id) AS pos FROM complete)
  WHERE pos = 1),
joined AS (
  SELECT doc_id AS id, '{BASE}' || source AS poster_path,
         CASE lang WHEN 'en' THEN DATE '2001-02-03' WHEN 'es' THEN DATE '2010-07-09' END AS release_date,
         text || ' ' || CASE WHEN lang = 'en' THEN lang ELSE '' END || ' ' || lang || ', ' || source AS text
  FROM first)
SELECT id, poster_path, release_date, CAST(year(release_date) AS INTEGER) AS release_year,
       CAST(month(release_date) AS INTEGER) AS release_month, CAST(day(release_date) AS INTEGER) AS release_day,
       text, {PROCESSED} AS processed_text
FROM joined""")
def clean_documents(t: Tables) -> DataFrame:
    # Documents as a catalogue: the text is title and overview, the language gives a good, a bad or
    # no date, source 0 has no poster.
    lang, source = F.col("lang"), F.col("source")
    catalog = t.documents.select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("title"),
        F.col("text").alias("overview"),
        F.when(lang == "en", "2001-02-03").when(lang == "es", "2010-07-09")
        .when(lang == "de", "1999-13-03").otherwise(MISSING_DATE).alias("release_date"),
        F.when(source != "src0", source).alias("poster_path"),
        F.when(lang == "en", lang).alias("tagline"),
        F.concat_ws(", ", lang, source).alias("keywords"),
        F.col("n_chars").alias("vote_count"),
        F.lit(7.5).alias("vote_average"),
        *(F.lit(0).cast("bigint").alias(c) for c in ("revenue", "runtime", "budget")),
        lang.alias("original_language"),
        F.lit(1.0).alias("popularity"),
    )
    return clean_catalog(catalog, BASE).select(
        "id", "poster_path", "release_date", "release_year", "release_month", "release_day",
        "text", "processed_text",
    )
