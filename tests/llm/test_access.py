"""Search, sharding, archives and preference data against plain Python."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.llm import search as S
from shelfmark.llm import sharding as R
from shelfmark.llm import warc as W
from shelfmark.llm.preference import ordered_turns, preference_turns, stale_replies
from shelfmark.llm.queries import ORACLES, QUERIES
from shelfmark.llm.words import BLANKS, SYMBOLS, raw_text, words
from tests.llm.conftest import SF_DIR


def split(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_search(docs, queries, k, terms_of_query):
    counts = [Counter(split(t)) for _, t in docs]
    size = [sum(c.values()) for c in counts]
    mean, n = sum(size) / len(size), len(docs)
    df = Counter(t for c in counts for t in c)
    vocab = list(df)
    buf, off = raw_text(pa.array(vocab))
    hashed = dict(zip(vocab, words(buf, off, SYMBOLS)[2].view(np.int64).tolist()))
    idf = {t: np.log1p((n - f + 0.5) / (f + 0.5)) for t, f in df.items()}
    out = {}
    for q, t in queries:
        own = Counter(split(t))
        best = sorted((w for w in own if df[w] >= 2), key=lambda w: (-(1 + np.log(own[w])) * idf[w], hashed[w]))[:terms_of_query]
        scores = [(sum(idf[w] * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * s / mean)) for w in best if w in c), d[0]) for c, s, d in zip(counts, size, docs)]
        out[q] = [(round(s, 6), d) for s, d in sorted((x for x in scores if x[0] > 0), key=lambda x: (-round(x[0], 9), x[1] is not None, x[1] or 0))[:k]]
    return out


@pytest.mark.parametrize("shard, block", [(1 << 14, 64), (40, 4)])
def test_search_equals_brute_force(spark, rows, monkeypatch, shard, block):
    monkeypatch.setattr(S, "SHARD_DOCS", shard)
    monkeypatch.setattr(S, "QUERY_GROUP", 7 if shard == 40 else 1 << 14)
    docs = [(r[0], r[1]) for r in rows("documents")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    queries = [x for x in docs if x[0] % 20 == 0]
    q = spark.createDataFrame(queries, "query_id long, text string")
    got = defaultdict(list)
    for r in S.search(d, q, k=7).orderBy("query_id", "rank").collect():
        got[r.query_id].append((round(r.score, 6), r.doc_id))
    assert got == {q: x for q, x in brute_search(docs, queries, 7, 16).items() if x}


@pytest.mark.parametrize("shard, part, short", [(1 << 14, 1 << 13, 32), (40, 16, 32), (40, 16, 1 << 20)])
def test_whole_texts_as_queries_equal_brute_force(spark, rows, monkeypatch, shard, part, short):
    for name, v in (("SHARD_DOCS", shard), ("PART_DOCS", part), ("SHORT", short), ("QUERY_GROUP", 7)):
        monkeypatch.setattr(S, name, v)
    docs = [(r[0], r[1]) for r in rows("documents")][:150] + [(9001, "zyxwvut " * 3), (None, "zyxwvut qqq")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = [*docs[::20], (-1, "zyxwvut"), (-2, "qqq"), (-3, "nowhereatall"), (-4, None)]
    counts = [Counter(split(t)) for _, t in docs]
    df, mean = Counter(t for c in counts for t in c), sum(map(Counter.total, counts)) / len(docs)
    idf = {t: np.log1p((len(docs) - f + 0.5) / (f + 0.5)) for t, f in df.items()}
    want = {}
    for q, t in asked:
        own = Counter(split(t))
        scores = [(round(sum(n * idf[w] * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * c.total() / mean)) for w, n in own.items() if w in c), 6), i) for (i, _), c in zip(docs, counts)]
        if found := sorted((x for x in scores if x[0] > 0), key=lambda x: (-x[0], x[1] is not None, x[1] or 0))[:10]:
            want[q] = found
    assert max(len(set(split(t))) for _, t in asked) > 32 and {-1, -2} < set(want)
    got = defaultdict(list)
    q = spark.createDataFrame(asked, "query_id long, text string")
    for r in S.search(d, q, k=10, query_terms=None, min_docs=1).orderBy("query_id", "rank").collect():
        got[r.query_id].append((round(r.score, 6), r.doc_id))
    assert got == want


def test_search_edges(spark, edges, edge_rows, empty):
    asked = [(1, "one two"), (2, None), (3, ""), (4, "nowhere"), (5, "the same text here")]
    q = spark.createDataFrame(asked, "query_id long, text string")
    got = S.search(edges, q, k=4).collect()
    assert {r.query_id for r in got} == {1, 5}
    assert sorted(((r.rank, r.doc_id) for r in got if r.query_id == 5)) == [(1, None), (2, 14), (3, 14), (4, 15)]
    assert S.search(empty, q).collect() == [] and S.search(edges, q.limit(0)).collect() == []


@settings(deadline=None, max_examples=80)
@given(st.lists(st.tuples(st.integers(0, 300), st.integers(0, 6), st.integers(1, 9)), min_size=1, max_size=120, unique_by=lambda x: x[:2]), st.integers(1, 6))
def test_pruning_loses_nothing(postings, k):
    doc, term, score = (np.array(x) for x in zip(*postings))
    index = S.ShardIndex(doc, term, score.astype(float))
    found = index.top(np.array([0, 1, 2, 9]), np.ones(4), k, np.arange(301))
    total = Counter()
    for d, t, s in postings:
        if t in (0, 1, 2):
            total[d] += s
    assert list(zip(*found)) == sorted(total.items(), key=lambda x: (-x[1], x[0]))[:k]


def test_words_in_segments(monkeypatch, edge_rows):
    from shelfmark.llm import words as module

    buf, off = raw_text(pa.array([r[1] for r in edge_rows]))
    whole = words(buf, off, BLANKS)
    monkeypatch.setattr(module, "_SEGMENT", 700)
    assert all((a == b).all() for a, b in zip(whole, words(buf, off, BLANKS)))


def test_sharding_law(spark, rows, edges, edge_rows, empty):
    docs = [(r[0], r[1]) for r in rows("documents")]
    for table, d, shards in ((docs, spark.createDataFrame(docs, "doc_id long, text string"), 24), ([(r[0], r[1]) for r in edge_rows], edges, 5)):
        got = R.ring_shards(d, shards=shards).collect()
        want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in table)
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
        slots = defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
            assert r.law == "rows" and r.grown_shard is None
        sizes = [len(slots[s]) for s in range(shards)]
        assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert R.ring_shards(empty).collect() == []


@settings(deadline=None, max_examples=60)
@given(st.dictionaries(st.integers(0, R.CELLS - 1), st.integers(1, 50), max_size=40), st.integers(1, 9), st.sampled_from([0.0, 0.25]))
def test_walk_places_all_within_bounds(counts, shards, slack):
    nodes, room = R.virtual_nodes(shards, 8), R.bounds(sum(counts.values()), shards, slack)
    load, ranks = Counter(), defaultdict(list)
    for cell, low, high, shard, slot in R.walk(counts, nodes, room):
        assert slot == load[shard]
        load[shard] += high - low
        ranks[cell].append((low, high))
    assert all(load[s] <= room[s] for s in range(shards))
    for cell, n in counts.items():
        assert [x for a, b in sorted(ranks[cell]) for x in range(a, b)] == list(range(n))


def test_slack_limits_movement():
    counts = {c: 1 for c in range(0, R.CELLS, 7)}
    plain = {c: s for c, _, _, s, _ in R.walk(counts, R.virtual_nodes(8, 128), [10**9] * 8)}
    bounded = {c: s for c, _, _, s, _ in R.walk(counts, R.virtual_nodes(8, 128), R.bounds(len(counts), 8, 0.25))}
    assert sum(plain[c] != bounded[c] for c in counts) < 0.1 * len(counts)


def warc_rows(spark, pages, root):
    W.write_archives(pages, root)
    return W.read_archives(spark, root)


def test_archives_round_trip(spark, rows, tmp_path):
    pages = [(i, u, h) for i, u, h in rows("pages")]
    pages += [(1000 + i, u, h) for i, u, h in pages[:20]] + [(2000, None, None), (2001, "a\r\nb", ""), (2002, "u", "é\x00\r\n\r\n" * 9), (None, "u", pages[0][2]), (None, "u", "alone")]
    d = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    got = warc_rows(spark, d, str(tmp_path / "a")).collect()
    best = {}
    for i, _, h in pages:
        if i is not None:
            best[h or ""] = max(i, best.get(h or "", i))
    want = Counter()
    for i, _, h in pages:
        b, top = (h or "").encode(), best.get(h or "")
        revisit = top is not None and i != top
        want[i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", top if revisit else None, None if revisit else b] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload if r.payload is None else bytes(r.payload)) for r in got) == want
    assert not any(r.error for r in got)
    # Any decoder with the dictionary reads each frame; the dictionary leads the file.
    data = max((p.read_bytes() for p in (tmp_path / "a").glob("part-*")), key=len)
    n = int.from_bytes(data[4:8], "little")
    assert data[:4] == W.DICTIONARY_MAGIC and zstandard.ZstdCompressionDict(data[8:8 + n]).dict_id() > 0
    assert warc_rows(spark, d.limit(0), str(tmp_path / "none")).collect() == []


def test_broken_archives_are_told(spark, tmp_path):
    good = W.record("response", 1, "u", W.digest(b"abc"), 3, None, b"abc")
    z = zstandard.ZstdCompressor()
    bad = [good[:-1], good.replace(b"abc", b"abd", 1), good.replace(b"WARC/1.1", b"HTTP/1.1"), good.replace(b"Content-Length", b"Length"), good[:20]]
    (tmp_path / "x").write_bytes(b"".join(map(z.compress, [good, *bad])) + z.compress(good)[:-3])
    (tmp_path / "y").write_bytes(b"nonsense")
    got = W.read_archives(spark, str(tmp_path)).collect()
    assert sum(r.error is None for r in got) == 1 and len(got) == 8
    with pytest.raises(Exception, match="damaged archive"):
        W.record_digests(W.read_archives(spark, str(tmp_path))).collect()
    held = z.compress(b"0123456789" * 5)
    (tmp_path / "z").mkdir()
    with_dict = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(b"0123456789" * 5))
    (tmp_path / "z" / "w").write_bytes(W.DICTIONARY_MAGIC + len(held).to_bytes(4, "little") + held + with_dict.compress(good))
    assert [r.error for r in W.read_archives(spark, str(tmp_path / "z")).collect()] == [None]


@settings(deadline=None, max_examples=60)
@given(st.binary(max_size=300_000), st.booleans(), st.integers(1, 12))
def test_frame_length(data, checksum, level):
    for size in (True, False):
        frame = zstandard.ZstdCompressor(level=level, write_checksum=checksum, write_content_size=size).compress(data)
        assert W.frame_length(memoryview(frame + b"more")) == len(frame)


def brute_preference(conversations):
    turns = defaultdict(set)
    for conv, turn, role, text in conversations:
        if conv is not None and turn is not None:
            turns[conv].add((turn, role or "unknown", text or ""))
    out = Counter()
    for conv, own in turns.items():
        own, seen, chosen = sorted(own), Counter(), []
        for turn, role, text in own:
            seen[turn] += 1
            chosen.append((turn, seen[turn], role, text))
        replies = [i for i, t in enumerate(chosen) if t[2] == "assistant"]
        rejected = list(chosen)
        if replies:
            chosen = chosen[:replies[-1] + 1]
            stale = chosen[replies[-2]][3] if len(replies) > 1 else ""
            rejected = [*chosen[:-1], (*chosen[-1][:3], stale)]
        same = 0
        while same < len(chosen) and chosen[same] == rejected[same]:
            same += 1
        for part, side in (("prompt", chosen[:same]), ("chosen", chosen[same:]), ("rejected", rejected[same:])):
            for turn, nth, role, text in side:
                head, learned = f"<|{role}|>\n", part != "prompt" and role == "assistant"
                out[conv, part, turn, nth, role, f"{head}{text}<|end|>\n", len(head) * learned, (len(head) + len(text) + 7) * learned] += 1
    return out


def test_preference_equals_brute_force(spark, rows):
    made = [tuple(r) for r in rows("conversations")]
    made += [(9000, 0, "user", "hi"), (9000, 0, "user", "hi"), (9000, 0, None, None), (9000, 1, "assistant", "same"), (9000, 2, "assistant", "same"),
             (9001, 0, "assistant", None), (9002, 5, "user", "x"), (None, 0, "user", "x"), (9003, None, "user", "x"), (9004, 1, "assistant", "y" * 200_000)]
    table = spark.createDataFrame([(*r, "clash") for r in made], "conv_id long, turn long, role string, text string, part string").repartition(4)
    got = preference_turns(*stale_replies(ordered_turns(table))).collect()
    assert Counter(map(tuple, got)) == brute_preference(made)
    assert preference_turns(*stale_replies(ordered_turns(table.limit(0)))).collect() == []


def test_preference_of_two_given_sides(spark):
    schema = "pair_id long, turn long, nth int, role string, text string"
    common = [(1, 0, 1, "user", "q"), (1, 1, 1, "assistant", "a")]
    chosen = spark.createDataFrame([*common, (1, 2, 1, "user", "more"), (1, 3, 1, "assistant", "yes")], schema)
    rejected = spark.createDataFrame(common, schema)
    got = [(r.part, r.turn, r.loss_end > r.loss_start) for r in preference_turns(chosen, rejected).orderBy("part", "turn").collect()]
    assert got == [("chosen", 2, False), ("chosen", 3, True), ("prompt", 0, False), ("prompt", 1, False)]


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df, want = QUERIES[name](spark, SF_DIR), con.sql(ORACLES[name])
    assert df.columns == list(want.columns)
    assert Counter(map(tuple, df.collect())) == Counter(want.fetchall())
