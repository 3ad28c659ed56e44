"""Text column expressions: splitting, token rules, cleaning, term runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens end at commas, Unicode white space and the four control separators. The flag makes ``\s``
# Unicode; spelling the characters out as ranges takes twice the time.
SEPARATORS = r"(?U)[,\s\x1c\x1d\x1e\x1f]+"

# Characters that are digits without being decimal (superscripts, circled digits ..).
_DIGIT_SIGNS = (
    r"\x{b2}\x{b3}\x{b9}\x{1369}-\x{1371}\x{19da}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}"
    r"\x{2460}-\x{2468}\x{2474}-\x{247c}\x{2488}-\x{2490}\x{24ea}\x{24f5}-\x{24fd}\x{24ff}"
    r"\x{2776}-\x{277e}\x{2780}-\x{2788}\x{278a}-\x{2792}\x{10a40}-\x{10a43}\x{10e60}-\x{10e68}"
    r"\x{11052}-\x{1105a}\x{1f100}-\x{1f10a}"
)

# The token rules, first match wins. A token of one or two characters is rejected by
# the first rule, a stopword by the one after the last.
TOKEN_RULES = {
    "short_or_digit": rf"^[\p{{Nd}}{_DIGIT_SIGNS}]+$",
    "alnum": r"^[a-zA-Z]*\p{Nd}+[a-zA-Z]*$",
    "unit": r"^\p{Nd}+[a-zA-Z]+$",
    "clock": r"^\p{Nd}{1,2}(am|pm)$",
    "number": r"^\p{Nd}+$",
    "special": r"^[a-zA-Z0-9]*[^\p{L}\p{N}_\s][a-zA-Z0-9]*$",
}
MIN_TOKEN_LENGTH = 3
STOPWORD_RULE = "stopword"
KEEP = "keep"

# All rules in one pattern, for the filter, which only asks whether any of them matches. Rules that
# "alnum" covers are left out; possessive quantifiers keep a plain word from being tried again at
# each of its letters.
REJECTED = (
    r"^(?:[a-zA-Z]*+\p{Nd}++[a-zA-Z]*+|[a-zA-Z0-9]*+[^\p{L}\p{N}_\s][a-zA-Z0-9]*+"
    rf"|[\p{{Nd}}{_DIGIT_SIGNS}]++)$"
)


def split_tokens(col: Column) -> Column:
    """Lower-cased tokens between commas and white space; empty ones at the ends are kept."""
    return F.split(F.lower(col), SEPARATORS)


def keep_token(token: Column, stopwords: Sequence[str]) -> Column:
    """Whether no rule rejects a lower-cased token; cheap tests come first."""
    return (
        (F.length(token) >= MIN_TOKEN_LENGTH)
        & ~token.isin(*stopwords)
        & ~token.rlike(REJECTED)
    )


def token_rule(token: Column, stopwords: Sequence[str]) -> Column:
    """Name of the first rule that rejects a lower-cased token, or ``keep``."""
    ladder = F.when(F.length(token) < MIN_TOKEN_LENGTH, "short_or_digit")
    for name, pattern in TOKEN_RULES.items():
        ladder = ladder.when(token.rlike(pattern), name)
    return ladder.when(token.isin(*stopwords), STOPWORD_RULE).otherwise(KEEP)


def filtered_text(col: Column, stopwords: Sequence[str]) -> Column:
    """The kept tokens of a text, joined by a blank; null stays null."""
    return F.array_join(F.filter(split_tokens(col), lambda t: keep_token(t, stopwords)), " ")


def clean_alpha(col: Column) -> Column:
    """Lower case, ASCII letters and single blanks only, no outer blanks."""
    letters = F.regexp_replace(F.lower(col), r"[^a-z\s]+", "")
    # Only what is not a single blank already.
    return F.trim(F.regexp_replace(letters, r"\s{2,}|[\t\n\x0B\f\r]", " "))


def has_word(col: Column) -> Column:
    """Whether ``clean_alpha`` leaves anything, without cleaning."""
    return F.lower(col).rlike("[a-z]")


def clean_words(col: Column) -> Column:
    """The words of ``clean_alpha``; one empty word for a text without any."""
    return F.split(clean_alpha(col), " ")


def words(col: Column) -> Column:
    """Lower-cased words between white space; none for a blank text."""
    return F.filter(F.split(F.lower(col), r"\s+"), lambda w: w != "")


def without_stopwords(col: Column, stopwords: Sequence[str]) -> Column:
    """An array of words without the stopwords, compared in lower case."""
    stop = [w.lower() for w in stopwords]
    return F.filter(col, lambda w: ~F.lower(w).isin(*stop))


def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where lambdas inside use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def term_runs(col: Column) -> Column:
    """An array of words as ``array<struct<word, tf>>``, one entry per distinct word.

    The words are sorted inside the row and each run gives one entry, so counting the words of a
    row needs no shuffle however long the text is.
    """

    def runs(ordered: Column) -> Column:
        positions = F.transform(ordered, lambda _, i: i)
        starts = F.filter(
            positions, lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1))
        )
        return _bind(starts, lambda begin: F.transform(
            begin,
            lambda at, j: F.struct(
                F.get(ordered, at).alias("word"),
                (F.coalesce(F.get(begin, j + 1), F.size(ordered)) - at).cast("bigint").alias("tf"),
            ),
        ))

    return _bind(F.sort_array(F.filter(col, lambda w: w.isNotNull())), runs)
