"""Encoding, packing and the id store against the tokenizer library on whole texts."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shelfmark.llm import idstore
from shelfmark.llm.encoding import Encoder
from shelfmark.llm.packing import best_fit_pack, pack_documents, packing_plan, sequences, token_pieces
from shelfmark.session import scratch_path

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")


def library(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda text, *end: np.array([*t.encode(text or "", add_special_tokens=False).ids, *end], dtype="<u4").tobytes()


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_ids_are_those_of_the_whole_text(path, rows, edge_rows):
    whole, enc, rng = library(path), Encoder(path), random.Random(3)
    signs = [*"abCDE  \n\n\t.,'sS!?09½²ªº×ßÉéſİ́ 　\x1c\x85ΣσбД日😀<|>", "'s", " 't", "  ", "n't", "İ.", "<|endoftext|>"]
    texts = [r[1] for r in rows("documents")[:60]] + [r[1] or "" for r in edge_rows]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    assert [t for t in texts if enc.encode(t) != whole(t)] == []


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_special_tokens_as_by_the_plain_call(path, rows):
    plain, enc, rng = Tokenizer.from_file(path), Encoder(path, special=True), random.Random(5)
    signs = [*"abC  \n.,'s9é日<|>", "<|endoftext|>", "<|startoftext|>", "<|endoftext|>", "<|EndOfText|>", "endoftext", " the"]
    texts = ["a <|endoftext|> b", "<|endoftext|>", "", *(r[1] or "" for r in rows("documents")[:20])]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(0, 20))) for _ in range(3000)]
    whole = [np.array(plain.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert [t for t, w in zip(texts, whole) if enc.encode(t) != w] == []


def test_words_after_line_breaks_and_accented_words_are_encoded_by_the_model_alone(monkeypatch):
    whole, enc, asked = library(BYTE), Encoder(BYTE), []
    texts = ["café.\nÉté là\nAnd so.\nOn!", "A\nb", "one.\n\nTwo \n three", "x\x1c\ny", "İa.\nÓ."]
    plain = enc._raw._encode
    monkeypatch.setattr(enc._raw, "_encode", lambda piece: asked.append(piece) or plain(piece))
    assert [enc.encode(t) for t in texts] == [whole(t) for t in texts]
    assert not [p for p in asked if len(p) > 2 and "\n" in p[1:-1] and p[0] in ".!"]
    asked.clear()
    monkeypatch.setattr(enc, "_whole", asked.append)
    enc.encode(" nouveauté déjà\nvécue")
    assert "".join(asked).strip() == ""


def test_queries_take_special_tokens(spark, tmp_path):
    from shelfmark.llm.queries import QUERIES

    text = "a <|endoftext|> b"
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for name, path, end in (("op1_best_fit_packing", WORD, 0), ("op2_token_id_store", BYTE, 2)):
        ids = [*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, end]
        for r in QUERIES[name](spark, str(tmp_path)).collect():
            assert r.ids_crc32 in (zlib.crc32(np.array(ids, "<u4").tobytes()), zlib.crc32(np.array(ids[:-1], "<u4").tobytes()))


def test_a_worker_frees_kept_encoders_for_other_work():
    from shelfmark.llm import common, encoding

    held = encoding.encoder(BYTE)
    assert encoding.encoder(BYTE) is held
    common.forget_kept()
    assert encoding.encoder(BYTE) is not held


def check_packing(got, want, capacity):
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def pieces_of(texts, capacity):
    encode, out = library(WORD), Counter()
    for i, t in texts:
        ids = encode(t, 0)
        for p, a in enumerate(range(0, len(ids), 4 * capacity)):
            own = ids[a:a + 4 * capacity]
            out[i, p, a // 4, len(own) // 4, zlib.crc32(own)] += 1
    return out


def test_packs_documents(spark, rows, empty):
    texts = [(r[0], r[1]) for r in rows("documents")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    want = pieces_of(texts, 256)
    used = check_packing(pack_documents(docs, WORD, capacity=256).collect(), want, 256)
    assert used <= 1.02 * sum(k[3] * n for k, n in want.items()) / 256 + 1
    assert pack_documents(empty, WORD).collect() == []


def test_packs_edges_and_joins_the_ids(spark, edges, edge_rows):
    want = pieces_of([(r[0], r[1]) for r in edge_rows], 2048)
    check_packing(pack_documents(edges, WORD).collect(), want, 2048)
    path = scratch_path(spark, "pieces")
    token_pieces(edges, "doc_id", "text", WORD, 0, 2048).write.parquet(path)
    packed = best_fit_pack(spark.read.parquet(path), 2048)
    by = defaultdict(list)
    for r in packed.collect():
        by[r.sequence_id].append((r.offset, bytes(r.ids)))
    assert {r.sequence_id: bytes(r.ids) for r in sequences(packed).collect()} == {s: b"".join(x for _, x in sorted(p)) for s, p in by.items()}


@settings(deadline=None, max_examples=150)
@given(st.dictionaries(st.integers(1, 60), st.integers(0, 40), max_size=20))
def test_plan_places_every_piece_once(counts):
    capacity, filled, seen = 60, defaultdict(list), defaultdict(set)
    for n, low, high, first, each, offset in packing_plan(counts, capacity):
        for rank in range(low, high):
            q, s = divmod(rank - low, each)
            filled[first + q].append((offset + s * n, n))
            assert rank not in seen[n]
            seen[n].add(rank)
    assert {n: len(x) for n, x in seen.items()} == {n: c for n, c in counts.items() if c}
    for parts in filled.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity and sum(3 * n > capacity for _, n in parts) <= 2
    # First fit decreasing, as a yardstick.
    bins = []
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fit = next((i for i, free in enumerate(bins) if free >= n), None)
        if fit is None:
            bins.append(capacity - n)
        else:
            bins[fit] -= n
    assert len(filled) <= len(bins) * 1.1 + 1


def stored(spark, docs, **more):
    root = scratch_path(spark, "ids")
    idstore.write_pages(docs, root, BYTE, **more)
    idstore.build_index(spark, root, bucket_keys=64)
    return root


def test_id_store_round_trip(spark, rows, empty):
    texts = sorted((r[0], r[1]) for r in rows("documents"))
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    root = stored(spark, docs, page_ids=5000)
    encode, at, want = library(BYTE), 0, {}
    for i, t in texts:
        ids = encode(t, 2)
        want[i] = (at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4
    assert {r.doc_id: tuple(r)[1:] for r in idstore.stored_documents(spark, root).collect()} == want
    keys = spark.createDataFrame([(3, 0), (7, 0), (10**9, 0), (3, 1)], "k long, copy int")
    assert {r.k: bytes(r.ids) for r in idstore.fetch(keys, root).collect()} == {i: encode(dict(texts)[i], 2) for i in (3, 7)}
    assert idstore.stored_documents(spark, stored(spark, empty)).collect() == []


def test_id_store_edges(spark, edges, edge_rows):
    encode, at, want = library(BYTE), 0, Counter()
    for i, t in sorted(((r[0], r[1]) for r in edge_rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = encode(t, 2)
        want[i, at, len(ids) // 4, zlib.crc32(ids)] += 1
        at += len(ids) // 4
    assert Counter(map(tuple, idstore.stored_documents(spark, stored(spark, edges)).collect())) == want


@settings(deadline=None, max_examples=50)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=400))
def test_perfect_hash_is_minimal(keys):
    h = np.array(sorted(keys), dtype=np.uint64)
    parts = idstore.perfect_hash(h)
    assert sorted(idstore.numbers(h, *parts)) == list(range(len(h)))


def test_perfect_hash_with_equal_hashes():
    h = np.array([5, 5, 9], dtype=np.uint64)
    parts = idstore.perfect_hash(h)
    assert len(parts[3]) == 2 and len(set(idstore.numbers(h, *parts).tolist())) == 2
