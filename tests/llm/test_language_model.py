import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfmark.llm import language_model, mixing
from shelfmark.llm.language_model import count_corpus, corpus_mixer, learn_gates, score_texts, shared_tables
from shelfmark.llm.mixing import CONTEXTS, LOW, MEMORY, Mixer
from shelfmark.llm.words import raw_text

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BITS = (10, 11, 12, 13, 13)
M64 = (1 << 64) - 1


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(text):
    return " ".join(words(text)).encode() + b"\n"


def base_scores(docs, folds=10):
    """Rows (key, held out, tokens, known, training tokens, base score), token by token."""
    held = [key is not None and zlib.crc32(str(key).encode()) % folds == 0 for key, _ in docs]
    counts = Counter(t for (_, text), h in zip(docs, held) if not h for t in [*words(text), None])
    n, v = sum(counts.values()), len(counts)
    return [
        (key, h, len(own), sum(counts[t] > 0 for t in own), n, sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own))
        for (key, text), h in zip(docs, held) for own in [[*words(text), None]]]


def slots(data, i, bits=BITS):
    """For each byte at ``i`` of a text's bytes, the (kind, slot, node, bit) of its decisions, one number at a time."""
    byte = data[i]
    start = i
    while start and data[start - 1] not in b" \n":
        start -= 1
    before = (b"\n" * 7 + data)[i + 2:i + 7]
    prefix = sum((b + 1) * pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) for j, b in enumerate(data[start:i])) * pow(pow(0x9E3779B97F4A7C15, 1, 1 << 64), -1, 1 << 64) & M64
    prefix ^= prefix >> 32
    prefix = prefix * 0xD6E8FEB86659FD93 & M64
    out = []
    for kind in range(CONTEXTS):
        seen = int.from_bytes(before[3 - kind:], "little") if kind < CONTEXTS - 1 else int.from_bytes(before[3:], "little") | (prefix >> 48) << 16
        seen = (seen + 1) * int(mixing._MULTIPLY[kind]) & M64
        seen ^= seen >> 29
        h = (seen * 0xBF58476D1CE4E5B9 & M64) >> 32
        for s in range(mixing._BEGIN[byte], mixing._BEGIN[byte + 1]):
            node = int(mixing._NODE[s])
            out.append((kind, (h ^ int(mixing._NODE_HASH[node])) & (2 ** bits[kind] - 1), node, int(mixing._BIT[s])))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(list("aB \t\n\x0b\x00Ééß日"))), st.text()), max_size=6))
def test_normal_form_and_words(texts):
    b, off = mixing.normal_form(*raw_text(pa.array(texts, pa.string())))
    assert [bytes(b[x:y]) for x, y in zip(off[:-1], off[1:])] == [plain(t) for t in texts]
    _, hashes, ends = mixing.histories(b)
    own = [w for t in texts for w in words(t)]
    assert len(hashes) == len(own) == len(ends)
    assert len(set(zip(own, hashes.tolist()))) == len(set(own)) == len(set(hashes.tolist()))
    assert [int(np.searchsorted(ends, x)) for x in off] == np.cumsum([0] + [len(words(t)) for t in texts]).tolist()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1) | st.integers(0, 3), max_size=60))
def test_numbered(numbers):
    distinct, place = mixing.numbered(np.array(numbers, np.int64))
    assert distinct.tolist() == sorted(set(numbers)) and distinct[place].tolist() == numbers


def test_histories_do_not_depend_on_blocks(monkeypatch):
    r = np.random.default_rng(1)
    b, off = mixing.normal_form(*raw_text(pa.array(["".join(r.choice(list("ab  \n"), r.integers(0, 40))) for _ in range(400)] + ["x" * 500])))
    whole = mixing.histories(b)
    monkeypatch.setattr(mixing, "_BLOCK", 16)
    for one, other in zip(whole, mixing.histories(b)):
        assert (one == other).all()
    alone = [mixing.histories(b[x:y])[0] for x, y in zip(off[:-1], off[1:])]
    assert (np.concatenate(alone) == whole[0]).all()


def test_tree_is_a_complete_code():
    assert sum(2.0 ** -int(d) for d in mixing._DECISIONS) == 1.0
    paths = {tuple(zip(mixing._NODE[a:b].tolist(), mixing._BIT[a:b].tolist())) for a, b in zip(mixing._BEGIN[:-1], mixing._BEGIN[1:])}
    assert len(paths) == 256


@pytest.fixture(scope="module")
def corpus(rows_of):
    return [text for _, text, *_ in rows_of("documents")][:40]


@pytest.fixture(scope="module")
def rows_of():
    return lambda table: duckdb.sql(f"SELECT * FROM '/root/testdata/sf0.001/{table}.parquet'").fetchall()


@pytest.fixture(scope="module")
def learned(spark, corpus):
    texts = spark.createDataFrame([(t,) for t in corpus], "_t string").repartition(3)
    language_model._HELD_HISTORIES, held = 3000, language_model._HELD_HISTORIES
    try:
        mixer = corpus_mixer(count_corpus(texts, BITS), BITS)
    finally:
        language_model._HELD_HISTORIES = held
    learn_gates(texts, mixer, shared_tables(spark, mixer), len(corpus), 1000)
    return mixer


def test_gates_learn_from_every_text_however_dealt(spark, corpus, learned):
    sums = {name: np.zeros((len(getattr(learned, name)), width + 1, width)) for name, width in mixing.GATES.items()}
    fresh = mixing.Mixer(learned.tables, learned.logits)
    for text in corpus:  # one by one, each occurrence for itself
        history = mixing.histories(np.frombuffer(plain(text), np.uint8))[0]
        mixing.gate_sums(fresh, history, np.ones(len(history), np.int64), sums)
    for name in mixing.GATES:
        want = mixing.moved(getattr(fresh, name), sums[name], 1000)
        assert np.allclose(getattr(learned, name), want, atol=3e-4) and not np.allclose(want, getattr(fresh, name), atol=0.01)
    others = mixing.Mixer(learned.tables, learned.logits)
    texts = spark.createDataFrame([(t,) for t in corpus[::-1]], "_t string").repartition(7)
    learn_gates(texts, others, shared_tables(spark, others), len(corpus), 1000)
    assert all(np.allclose(getattr(learned, name), getattr(others, name), atol=3e-4) for name in mixing.GATES)


def test_gates_follow_slope_and_curvature(learned):
    rng = np.random.default_rng(2)
    history = np.unique(rng.integers(0, 1 << 62, 500)).view(np.uint64)
    times = rng.integers(1, 5, len(history))
    sums = {name: np.zeros((len(getattr(learned, name)), width + 1, width)) for name, width in mixing.GATES.items()}
    mixing.gate_sums(learned, history, times, sums)
    bit, node, seen, x, many = learned.inputs(history, less=True)
    for name, gate in (("by_node", node), ("by_seen", seen), ("low", node)):
        own = x[:mixing.GATES[name]].astype(float)
        p = 1 / (1 + np.exp(-(getattr(learned, name)[gate].T * own).sum(axis=0)))
        t = np.repeat(times, many)
        for g in range(len(getattr(learned, name))):
            at = gate == g
            assert np.allclose(sums[name][g, 0], (own * (t * (bit - p)))[:, at].sum(axis=1), rtol=1e-3, atol=1e-2)
            assert np.allclose(sums[name][g, 1:], (own * (t * p * (1 - p)))[:, at] @ own[:, at].T, rtol=1e-3, atol=1e-2)


def test_tables_hold_the_counts_of_every_decision(corpus, learned):
    counts = [Counter() for _ in range(CONTEXTS)]
    for text in corpus:
        data = plain(text)
        for i in range(len(data)):
            for kind, slot, _, bit in slots(data, i):
                counts[kind][slot, bit] += 1
    for kind in range(CONTEXTS):
        zeros, ones = (np.array([counts[kind][s, bit] for s in range(2 ** BITS[kind])]) for bit in (0, 1))
        assert (learned.tables[kind] == mixing.state_of(zeros, ones)).all()
        met = np.zeros((2, mixing._PAIRS))
        for z, o in zip(zeros.tolist(), ones.tolist()):
            for bit, (a, b, own) in enumerate(((z - 1, o, z), (z, o - 1, o))):
                if own and a + b < mixing.SMALL:
                    met[bit, (a + b) * (a + b + 1) // 2 + b] += own
        assert np.allclose(learned.logits[kind], mixing.logits_of(met))


def one_by_one(mixer: Mixer, data: bytes) -> float:
    """Natural log probability of a text's bytes, decision after decision."""
    total, share = 0.0, [0.6 * MEMORY, 0.2 * MEMORY, 0.2 * MEMORY]
    for start, size in mixing.segments(len(data)):
        weights, more = [s / (MEMORY + start) for s in share], [0.0] * 3
        for i in range(start, min(start + size, len(data))):
            found = slots(data, i)
            steps = len(found) // CONTEXTS
            p = [1.0] * 3
            for s in range(steps):
                own = found[s::steps]
                node, bit = own[0][2:]
                states = [int(mixer.tables[kind][slot]) for kind, slot, _, _ in own]
                x = [float(mixer.logits[k][state]) for k, state in enumerate(states)]
                seen = sum((states[k] > 0) << (k - 1) for k in range(1, CONTEXTS))
                a = sum(float(w) * v for w, v in zip(mixer.by_node[node], x))
                b = sum(float(w) * v for w, v in zip(mixer.by_seen[seen], x))
                c = sum(float(w) * v for w, v in zip(mixer.low[node], x[:LOW]))
                for e, z in enumerate(((a + b) / 2, b, c)):
                    p[e] *= 1 / (1 + math.exp(-z if bit else z))
            both = sum(w * q for w, q in zip(weights, p))
            total += math.log(both)
            more = [m + w * q / both for m, w, q in zip(more, weights, p)]
        share = [s + m for s, m in zip(share, more)]
    return total


def test_scores_equal_one_by_one(learned, corpus):
    texts = [corpus[0], None, "", "x", "Noise 9f8e7d6c5b4a  été 日本語", corpus[5] + " " + corpus[6], "the " * 300, corpus[1][:700]]
    b, off = mixing.normal_form(*raw_text(pa.array(texts, pa.string())))
    got = mixing.text_scores(learned, mixing.histories(b)[0], off)
    assert np.allclose(got, [one_by_one(learned, plain(t)) for t in texts], rtol=1e-4)


def test_histories_are_mixed_once_for_all_texts_of_a_task(monkeypatch):
    rng = np.random.default_rng(2)
    m = mixing.Mixer([rng.integers(0, 500, 1 << 10).astype(np.uint16) for _ in mixing.BITS], [rng.normal(size=mixing.STATES).astype(np.float32) for _ in mixing.BITS])
    texts, asked = [rng.integers(0, 50, 300).astype(np.uint64) << np.uint64(56) for _ in range(4)], []
    plain = [mixing.text_scores(m, t, np.array([0, 100, 300])) for t in texts]
    mix = m.byte_probabilities
    monkeypatch.setattr(m, "byte_probabilities", lambda history: asked.extend(history.tolist()) or mix(history))
    for held in (1 << 21, 60, 0):
        monkeypatch.setattr(mixing, "HELD", held)
        asked.clear()
        kept = mixing.Probabilities(m)
        np.testing.assert_array_equal([mixing.text_scores(kept, t, np.array([0, 100, 300])) for t in texts], plain)
        assert len(asked) == len(set(asked)) or not held


def test_probabilities_of_all_bytes_add_up_to_one(learned):
    history = mixing.histories(np.frombuffer(b"the rest\n", np.uint8))[0]
    before = history[7] & np.uint64((1 << 56) - 1)
    p = np.exp(learned.byte_probabilities(before | (np.arange(256, dtype=np.uint64) << np.uint64(56))))
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4)


def test_held_out_texts_are_more_likely_than_by_single_tokens(spark, rows_of):
    """Small tables spell too many unknown words for that, so the next larger ones are used."""
    docs = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    out = score_texts(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    want = {r[0]: r for r in base_scores(docs)}
    for r in out:
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == want[r["doc_id"]][1:5]
        assert r["base_score"] == pytest.approx(want[r["doc_id"]][5], rel=1e-9)
        assert r["score"] < 0 and r["bits_per_byte"] > 0
    held = [r for r in out if r["held_out"]]
    assert len(out) == len(docs) and held
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


@pytest.mark.parametrize("known", [0, 3, 1 << 20])
def test_edges(spark, edges, edge_rows, known):
    docs = [r[:2] for r in edge_rows]
    out = score_texts(edges, bits=BITS, known_words=known).collect()
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *r[1:3]))
    got = order([tuple(r)[:6] for r in out])
    want = order(base_scores(docs))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want], rel=1e-9)
    same = {r["score"] for r in out if r["n_tokens"] == 5 and r["doc_id"] in (14, 15, None)}
    assert len(same) == 1  # repeated texts


def test_no_rows_and_nothing_to_learn_from(spark, empty):
    assert score_texts(empty, bits=BITS).count() == 0
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    out = score_texts(spark.createDataFrame([(held[0], "ab c"), (held[1], None)], "doc_id long, text string"), bits=BITS).orderBy("n_tokens").collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in out] == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]
    assert out[0]["score"] == pytest.approx(-mixing._DECISIONS[ord("\n")] * math.log10(2), rel=1e-5)


def test_result_does_not_depend_on_how_rows_are_dealt(spark, rows_of):
    docs = spark.createDataFrame([r[:2] for r in rows_of("documents")][:60], "doc_id long, text string")
    one, many = ({r["doc_id"]: r["score"] for r in score_texts(docs.repartition(n, F.hash("doc_id")), bits=BITS).collect()} for n in (1, 7))
    assert one.keys() == many.keys()
    assert all(many[k] == pytest.approx(one[k], rel=1e-4) for k in one)
