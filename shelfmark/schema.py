"""Schemas of the raw records and of the catalogue, and the values that mean "missing"."""

from __future__ import annotations

from pyspark.sql import types as T

# Texts that stand for a missing value in the raw records.
SENTINELS = ["", "NA", "N/A", "None", "na", "n/a", "NULL", "Not Available"]
MISSING_DATE = "1500-01-01"

# Texts read as missing in a headered CSV catalogue. "na" and "Not Available" are
# not among them.
CSV_NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Columns a catalogue row must have to be kept by the cleaning job.
REQUIRED_COLUMNS = [
    "title", "vote_average", "vote_count", "revenue", "runtime", "poster_path", "budget",
    "original_language", "overview", "popularity", "release_date",
]

# Defaults of the typed columns when a raw record has none.
TYPED_DEFAULTS = {
    "vote_average": ("double", 0.0),
    "vote_count": ("bigint", 0),
    "revenue": ("bigint", 0),
    "runtime": ("bigint", 0),
    "adult": ("boolean", False),
    "budget": ("bigint", 0),
    "popularity": ("double", 0.0),
}

# Nested columns of a raw record and the field that holds the name.
NESTED_NAMES = {
    "genres": "name",
    "production_companies": "name",
    "production_countries": "name",
    "spoken_languages": "english_name",
}

# Thresholds of the rating analysis.
MIN_VOTES = 10
MIN_RATING_BUCKET = 7
RATING_COLUMNS = ["rating_group", "runtime", "revenue", "budget", "release_year", "release_month"]
VOCABULARY_SIZE = 500
ROWS_PER_FILE = 10_000
CLUSTERS = 5
CLUSTER_SEED = 42

_SCALARS = [
    ("id", T.LongType()),
    ("title", T.StringType()),
    ("vote_average", T.DoubleType()),
    ("vote_count", T.LongType()),
    ("status", T.StringType()),
    ("release_date", T.StringType()),
    ("revenue", T.LongType()),
    ("runtime", T.LongType()),
    ("adult", T.BooleanType()),
    ("backdrop_path", T.StringType()),
    ("budget", T.LongType()),
    ("homepage", T.StringType()),
    ("imdb_id", T.StringType()),
    ("original_language", T.StringType()),
    ("original_title", T.StringType()),
    ("overview", T.StringType()),
    ("popularity", T.DoubleType()),
    ("poster_path", T.StringType()),
    ("tagline", T.StringType()),
    ("keywords", T.StringType()),
]


def _named_structs(field: str) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(field, T.StringType())]))


RAW_SCHEMA = T.StructType(
    [T.StructField(name, dtype) for name, dtype in _SCALARS]
    + [T.StructField(name, _named_structs(field)) for name, field in NESTED_NAMES.items()]
)

CATALOG_SCHEMA = T.StructType(
    [T.StructField(name, dtype) for name, dtype in _SCALARS]
    + [T.StructField(name, T.StringType()) for name in NESTED_NAMES]
)

# Shape of a keyword document, held as JSON text.
KEYWORD_DOC = T.StructType([T.StructField("keywords", _named_structs("name"))])
