"""Near duplicates, decontamination, language, secrets and the pipeline against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfmark.llm import jaccard as J
from shelfmark.llm.components import components
from shelfmark.llm.decontaminate import contamination, without_contaminated
from shelfmark.llm.language import FEATURES, grams, identify_languages, known_language
from shelfmark.llm.secrets import MASK, coverage, mask_secrets, scan_secrets
from shelfmark.sinks.folders import names


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingle_set(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_components(rows, k, percent):
    """``[(n, component)]`` by comparing all pairs."""
    sets, root = [shingle_set(t, k) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    out = []
    for a, s in enumerate(sets):
        ids = [rows[b][0] for b in range(len(rows)) if find(b) == find(a) and rows[b][0] is not None]
        out.append((rows[a][0], len(s), min(ids) if ids else None))
    return Counter(out)


def near_copies(n, seed):
    """Texts of all sizes, with copies, near copies of several degrees, and passages that many share."""
    rng = np.random.default_rng(seed)
    word = lambda: "w%d" % rng.integers(0, 3000)
    passage, texts = [word() for _ in range(25)], []
    while len(texts) < n:
        base = [word() for _ in range(int(rng.choice([1, 2, 4, 8, 11, 14, 21, 23, 40, 80])))]
        if rng.random() < 0.3:
            base += passage
        for _ in range(int(rng.integers(1, 6))):
            own = list(base)
            for _ in range(int(rng.integers(0, 3))):
                if rng.random() < 0.5 and own:
                    own[int(rng.integers(0, len(own)))] = word()
                else:
                    own.append(word())
            texts.append(" ".join(own))
    return [(i * 7 % 1009, t) for i, t in enumerate(texts[:n])]


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80), (1, 70)])
def test_jaccard_components_equal_brute_force(spark, k, percent):
    rows = near_copies(260, k)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = J.jaccard_components(docs, k=k, percent=percent).drop("boundary")
    assert Counter(map(tuple, got.collect())) == brute_components(rows, k, percent)


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80)])
def test_near_copies_that_do_not_link_are_not_paired(spark, monkeypatch, k, percent):
    """One large group around a text: most members lie too far from each other, some link in twos and threes."""
    rng, made, joined = np.random.default_rng(4), [], []
    base = [f"w{i}" for i in range(150)]

    def changed(words, times, name):
        own = list(words)
        for i in rng.choice(len(own), times, replace=False):
            own[i] = f"{name}x{i}"
        return own

    for g in range(70):
        made += (first := [changed(base, 7, f"g{g}")])
        made += [changed(first[0], 1, f"g{g}c{j}") for j in range(int(g % 5 == 0) + int(g % 10 == 0))]
    rows = [(i, " ".join(t)) for i, t in enumerate([base, *made])]
    pairs = J.pairs_by_difference
    monkeypatch.setattr(J, "pairs_by_difference", lambda *a: joined.append(J.stored(pairs(*a), "pairs")) or joined[-1])
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), k=k, percent=percent).drop("boundary")
    assert Counter(map(tuple, got.collect())) == brute_components(rows, k, percent)
    assert joined[0].count() < 5 * len(rows) < len(rows) ** 2 / 4


def test_jaccard_edges(spark, edges, edge_rows, empty):
    short = [(r[0], r[1]) for r in edge_rows]
    got = Counter(map(tuple, J.jaccard_components(edges).drop("boundary").collect()))
    assert got == brute_components(short, 3, 90)
    assert J.jaccard_components(empty).collect() == []
    kept = J.one_of_each_group(edges)
    assert kept.columns == edges.columns
    # Equal texts of 6, 7 and -5, and of 14 (twice) and 15; rows without a key stay.
    want = Counter(r[0] for r in edge_rows if r[0] is not None)
    for gone in (6, 7, 15):
        del want[gone]
    want[14] = 1
    want[9] = 0  # the words of 8
    assert Counter(r.doc_id for r in kept.collect() if r.doc_id is not None) == +want
    assert sum(r.doc_id is None for r in kept.collect()) == 2


def test_jaccard_names_components_by_keys_only(spark):
    """Texts that only rows without a key hold, alone and linked with keyed ones; several contents, so that their hashes are once smaller
    and once larger than the keys."""
    rows = []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(60)]
        text = lambda extra: " ".join([*base, *(f"g{g}x{i}" for i in range(extra))])  # noqa: B023, E731
        rows += [(50 + 10 * g, text(0)), (51 + 10 * g, text(2)), (None, text(1)), (None, f"alone {g} " + " ".join(f"a{g}b{i}" for i in range(30)))]
        rows += [(None, f"pair {g} " + " ".join(f"p{g}q{i}" for i in range(50 + j))) for j in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter(map(tuple, J.jaccard_components(df, k=3, percent=90).drop("boundary").collect()))
    assert got == brute_components(rows, 3, 90)


def test_boundary_follows_the_costs():
    assert J.choose_boundary({n: 10 for n in range(1, 60)}, 90, 1.0) == 20
    assert J.choose_boundary({}, 90, 1.0) == 1
    assert J.choose_boundary({25: 1}, 90, 200.0) == 26  # very long lists make subsets the cheaper way
    for n in range(1, 30):
        s = np.arange(n, dtype=np.uint64) * 977
        assert sum(1 for _ in J.subsets(s, 90)) == J.subset_count(n, 90)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=60))
def test_parity_bits_never_exceed_the_difference(pairs):
    a = np.unique(np.array([x for x, _ in pairs], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    b = np.unique(np.array([y for _, y in pairs], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    bits = int(np.bitwise_count(J.parity(a) ^ J.parity(b)).sum())
    assert bits <= len(np.setxor1d(a, b))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 200), (300, 299), (299, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 299: 299, 300: 299}


def brute_contamination(docs, bench, width=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = {}
    for name, t in bench:
        w = split(t)
        n = min(width, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[a:a + n]), set()).add("" if name is None else str(name))
    widths, out = {len(w) for w in windows}, Counter()
    for i, t in docs:
        w, hit, items = split(t), set(), set()
        for n in widths:
            for a in range(len(w) - n + 1):
                if found := windows.get(tuple(w[a:a + n])):
                    hit.update(range(a, a + n))
                    items |= found
        out[i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)] += 1
    return out


def test_contamination_equals_brute_force(spark, rows):
    docs, bench = [(r[0], r[1]) for r in rows("documents")], [(r[0], r[1]) for r in rows("benchmark")]
    # Whole items, shifted ones, one over a document's edge, short items.
    bench += [(900, "Two words"), (901, "the"), (902, None), (None, docs[3][1][:40])]
    docs += [(5000 + i, f"before {t} after") for i, (_, t) in enumerate(bench[:5])]
    half = bench[7][1].split()
    docs += [(6000, " ".join(half[:9])), (6001, " ".join(half[9:])), (6002, "two, WORDS!")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(bench, "item_id long, text string")
    want = brute_contamination(docs, bench)
    assert want and any(k[5] for k in want)
    for chars in (1 << 24, 1500):
        assert Counter(tuple(r)[:6] for r in contamination(d, b, block_chars=chars).collect()) == want
    near = spark.createDataFrame([(1, "alpha beta x gamma delta"), (2, "alpha x y z beta gamma delta")], "doc_id long, text string")
    item = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    assert {r.doc_id: r.contaminated for r in contamination(near, item, slop=1).collect()} == {1: True, 2: False}
    assert not any(r.contaminated for r in contamination(near, item).collect())


def test_contamination_edges(spark, edges, edge_rows, empty, rows):
    bench = [(1, "one two"), (2, "lorem ipsum dolor sit amet lorem ipsum dolor sit amet lorem"), (3, "日本語"), (4, ""), (5, None), (1, "one two")]
    b = spark.createDataFrame(bench, "item_id long, text string")
    want = brute_contamination([(r[0], r[1]) for r in edge_rows], bench)
    assert Counter(tuple(r)[:6] for r in contamination(edges, b).collect()) == want
    assert contamination(empty, b).collect() == []
    assert not any(r.contaminated for r in contamination(edges, b.limit(0)).collect())
    kept = without_contaminated(edges, b)
    assert kept.columns == edges.columns
    assert kept.count() == sum(n for k, n in want.items() if not k[5])


def test_language_is_held_out_right(spark, rows):
    docs = spark.createDataFrame([(r[0], r[1], r[2]) for r in rows("documents")], "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id: r for r in identify_languages(docs).collect()}
    assert len(got) == docs.count()
    truth = {r[0]: r[2] for r in rows("documents")}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [i for i, r in got.items() if r.held_out]
    assert sum(got[i].lang_pred == truth[i] for i in held) >= 0.97 * len(held)
    assert known_language(docs).count() == docs.count()


def test_language_is_that_of_plain_naive_bayes(spark, rows):
    docs = [(r[0], r[1], r[2]) for r in rows("documents")[:60]]
    features = {i: [int(x) for found, _ in grams([t])[0] for x in found] for i, t, _ in docs}
    learned = [(i, lang) for i, _, lang in docs if lang and zlib.crc32(str(i).encode()) % 5]
    langs = sorted({lang for _, lang in learned})
    counts = {lang: Counter(x for i, own in learned if own == lang for x in features[i]) for lang in langs}
    log = {lang: lambda x, c=c, all=sum(c.values()) + 0.5 * FEATURES: math.log((c[x] + 0.5) / all) for lang, c in counts.items()}
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(4)
    got = {r.doc_id: r for r in identify_languages(d).collect()}
    for i, xs in features.items():
        evidence = {lang: math.log(sum(own == lang for _, own in learned) / len(learned)) + sum(map(log[lang], xs)) for lang in langs}
        best = max(langs, key=evidence.get)
        assert got[i].lang_pred == best
        assert got[i].score == pytest.approx(1 / sum(math.exp(e - evidence[best]) for e in evidence.values()), abs=1e-3)


def test_texts_far_from_every_language_go(spark, rows):
    draw = random.Random(2)
    docs = [(r[0], r[1], r[2]) for r in rows("documents")]
    letters = "abcdefghijklmnopqrstuvwxyz"
    noise = [" ".join("".join(draw.choices(letters, k=draw.randint(2, 9))) for _ in range(n)) for n in (300, 500, 800)]
    other = ["Съешь же ещё этих мягких французских булок да выпей чаю. " * 3, "快速的棕色狐狸跳过懒狗，然后又跑回来了。" * 3, "Η γρήγορη καφέ αλεπού πηδάει πάνω από το σκυλί. " * 3]
    prose = ["The quick brown fox jumps over the lazy dog and then runs back home before the rain begins to fall.", "Hello, Mr. Smith", "le chat"]
    planted = [(90_000 + i, t, "en") for i, t in enumerate([*noise, *other, *prose])]
    d = spark.createDataFrame([*docs, *planted], "doc_id long, text string, lang string").repartition(3)
    kept = {r.doc_id for r in known_language(d.withColumn("lang", F.when(F.col("doc_id") < 90_000, F.col("lang")))).collect()}
    assert kept == {i for i, _, _ in docs} | {90_006, 90_007, 90_008}


def test_letters_of_all_planes_are_letters():
    _, letters = grams(["\U00030000\U0002f800 x", "\U0001f600 1"])
    assert letters.tolist() == [3, 0]


def test_language_edges(spark, edges, edge_rows, empty):
    got = identify_languages(edges).collect()
    assert len(got) == len(edge_rows)
    by = {r.doc_id: r for r in got}
    for i in (0, 1, 2, 10):
        assert (by[i].lang_pred, by[i].score) == ("und", 0.0)
    assert {r.lang_pred for r in got} <= {"en", "fr", "und"} and by[None].held_out is False
    assert identify_languages(empty).collect() == []
    kept = known_language(edges)
    assert kept.columns == edges.columns and not {0, 1, 2, 10} & {r.doc_id for r in kept.collect()}
    untaught = edges.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in identify_languages(untaught).collect()} == {"und"}
    assert known_language(untaught).count() == sum(any(c.isalpha() for c in r[1] or "") for r in edge_rows)


def test_secrets_are_found_and_masked(spark, rows):
    docs = [(r[0], r[1], r[3], r[4]) for r in rows("documents")]
    docs += [(7000 + i, f'Ofthe mat, token = "{hashlib.sha1(bytes([i])).hexdigest()}" an onth.', "src1", 70) for i in range(30)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, n_chars long").repartition(3)
    findings = scan_secrets(d)
    got, text = findings.collect(), {r[0]: r[1] for r in docs}
    want = {(i, m.start(), m.end()) for i, t, *_ in docs for m in re.finditer(r"[A-Za-z0-9+/=_-]{16,}", t)}
    assert {(r.doc_id, r.start, r.stop) for r in got} == want and len(got) == len(want)
    assigned = {(i, m.start(1)) for i, t in text.items() for m in re.finditer(r'token = "([0-9a-f]{40})"', t)}
    assert {(r.doc_id, r.start) for r in got if r.is_secret} == assigned and len(assigned) >= 30
    masked = {r.doc_id: r for r in mask_secrets(d, findings).collect()}
    for i, t, _, n in docs:
        clean = re.sub(r'(token = ")[0-9a-f]{40}', rf"\1{MASK}", t)
        assert masked[i].text == clean and masked[i].n_chars == (n if clean == t else len(clean))


def test_secrets_of_other_forms(spark, rows):
    hexa = hashlib.sha1(b"x").hexdigest()
    secret = {
        "API_KEY={}": hexa, "see ?token={}&user=7": hexa, "Authorization: Bearer {}": hexa, "use {} here": "AKIA" + "Q7ZX3M9L" * 2,
        'password = "{}" it is': "hunter2!x", "secret: '{}'": "ab.12@cd.34", "auth_token={} .": hexa[:20] + "==",
        "send {} on": "eyJhbGciOiJIUzI1.eyJzdWIiOiIxMjM0.SflKxwRJSMeKKF2QT4",
    }
    docs = [(r[0], r[1], r[3], r[4]) for r in rows("documents")]
    docs += [(8000 + i, form.format(v), "src1", 70) for i, (form, v) in enumerate(secret.items())]
    docs += [(8100, "SOME_LONG_SETTING_NAME=none", "src1", 9), (8101, "size=" + "4" * 20, "src1", 9)]
    docs += [(7000 + i, f'Ofthe mat, token = "{hashlib.sha1(bytes([i])).hexdigest()}" an onth.', "src1", 70) for i in range(30)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, n_chars long").repartition(3)
    findings = scan_secrets(d).cache()
    got = {r.doc_id: (r.candidate, r.is_secret) for r in findings.collect()}
    assert [got.get(8000 + i) for i in range(len(secret))] == [(v, True) for v in secret.values()]
    assert not got[8100][1] and got[8101] == ("4" * 20, False)
    masked = {r.doc_id: r.text for r in mask_secrets(d, findings).collect()}
    assert [masked[8000 + i] for i in range(len(secret))] == [form.format(MASK) for form in secret]


def test_secrets_edges(spark, edges, edge_rows, empty):
    findings = scan_secrets(edges)
    assert len(findings.collect()) == sum(len(re.findall(r"[A-Za-z0-9+/=_-]{16,}", r[1] or "")) for r in edge_rows)
    masked = mask_secrets(edges, findings)
    assert masked.columns == edges.columns and masked.count() == len(edge_rows)
    assert {r.text for r in masked.collect() if r.doc_id == 13} == {f'key = "{MASK}"'}
    assert scan_secrets(empty).collect() == [] and mask_secrets(empty, scan_secrets(empty)).collect() == []
    assert coverage("thecatxx", frozenset({"the", "cat"})) == 0.75


def stage_by_stage(spark, docs, tmp_path):
    """Rows that each stage returns, written and read again; no stage leaves the intermediate tables of the one before."""
    import corpus_pipeline

    out, made = [docs], []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, out[-1], "/root/testdata/sf0.001").write.parquet(path)
        out.append(spark.read.parquet(path))
        assert not set(made) & set(corpus_pipeline._LEFT) and not any(names(spark, folder) for folder in made)
        made = list(corpus_pipeline._LEFT)
    return out


def test_pipeline_stages(spark, tmp_path):
    docs = stage_by_stage(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), tmp_path)
    for kept in docs[1:5]:
        assert kept.columns == docs[0].columns and 0.8 * docs[0].count() < kept.count() <= docs[0].count()
    assert {"doc_id", "sequence_id", "offset", "ids_crc32"} <= set(docs[5].columns)
    assert docs[5].select("doc_id").distinct().count() <= docs[0].count()


def test_pipeline_on_edges_and_on_nothing(spark, edges, empty, tmp_path):
    docs = stage_by_stage(spark, edges, tmp_path / "edges")
    assert all(kept.columns == edges.columns for kept in docs[1:5])
    sizes = [kept.count() for kept in docs]
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] == sizes[4] > 0 and docs[5].count() >= sizes[4]
    assert [kept.count() for kept in stage_by_stage(spark, empty, tmp_path / "none")] == [0] * 6
