import math
import re
from collections import Counter

import numpy as np
from conftest import SCHEMA
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.llm import shared_search
from shelfmark.llm.shared_search import mine_sharing, rank_documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return WORD.findall((text or "").translate(LOWER))


def brute_force(docs, queries, k=10):
    """Multiset of (query id, rank, key, score), each query by itself."""
    texts = [(key, Counter(w), len(w)) for key, text in docs if (w := terms(text))]
    rows, length = len(texts), sum(n for _, _, n in texts)
    df = Counter(t for _, c, _ in texts for t in c)
    out = Counter()
    for name, text in queries:
        scored = []
        for key, tf, n in texts:
            m = 10 + (90 * n * rows) // length
            score = sum(math.floor(1000 * math.log((2 * rows + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m)) for t in set(terms(text)) if t in tf)
            if score > 0:
                scored.append((-score, key is None, key or 0))
        out.update((name, r, None if none else key, -s) for r, (s, none, key) in enumerate(sorted(scored)[:k], 1))
    return out


def found(df):
    return Counter(tuple(r) for r in df.collect())


def test_equals_single_queries_on_the_tables(spark, rows):
    docs, items = [r[:2] for r in rows("documents")], rows("benchmark")
    queries = [*items, (10_000, docs[3][1]), (10_001, "the the THE nothing-else")]
    got = rank_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "item_id long, text string"))
    assert found(got) == brute_force(docs, queries)


def test_several_blocks_of_queries(spark, rows, monkeypatch):
    monkeypatch.setattr(shared_search, "BLOCK_TERMS", 300)
    monkeypatch.setattr(shared_search, "CELLS", 5000)
    docs, items = [r[:2] for r in rows("documents")], rows("benchmark")
    got = rank_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"), k=3)
    assert found(got) == brute_force(docs, items, 3)


def test_edges(spark, edges, edge_rows, empty):
    queries = [(1, None), (2, ""), (3, "?!"), (4, "the SAME text"), (4, "the same text"), (None, "one two"), (5, "lorem ipsum " * 3000), (6, "été 日本語")]
    asked = spark.createDataFrame([(i, t, i) for i, t in queries], "item_id long, text string, doc_id long")
    docs = [r[:2] for r in edge_rows]
    assert found(rank_documents(edges, asked)) == brute_force(docs, queries)
    assert rank_documents(empty, asked).count() == 0
    nobody = spark.createDataFrame([], "item_id long, text string")
    assert rank_documents(edges, nobody).count() == 0
    assert rank_documents(edges, asked).columns == ["item_id", "rank", "doc_id", "score"]
    assert "score" in SCHEMA  # a column of the documents with the name of a result


def test_ties_go_to_smaller_keys(spark):
    docs = [(i, "alpha beta") for i in range(40, 0, -1)] + [(None, "alpha beta"), (3, "alpha beta")] + [(100 + i, "gamma") for i in range(30)]
    queries = [(1, "alpha"), (2, "beta alpha")]
    got = rank_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame(queries, "item_id long, text string"))
    assert found(got) == brute_force(docs, queries)


def expand(plan, node):
    if node < plan.terms:
        return [node]
    return expand(plan, int(plan.left[node - plan.terms])) + expand(plan, int(plan.right[node - plan.terms]))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 14), max_size=12), max_size=8), st.sampled_from([0, 2, 4, 100]))
def test_plan_gives_every_query_and_no_more_additions(queries, mined):
    sets = [np.array(sorted(q), dtype=np.int64) for q in queries]
    plan = mine_sharing(sets, 15, mined)
    for q, own in zip(sets, plan.queries):
        assert sorted(t for node in own.tolist() for t in expand(plan, node)) == q.tolist()
    assert plan.additions <= sum(map(len, sets))
    done = set(range(15))
    for level in plan.levels:
        assert all(int(plan.left[i]) in done and int(plan.right[i]) in done for i in level)
        done |= {15 + int(i) for i in level}


def test_shared_parts_are_added_once(rows):
    words = sorted({t for _, text in rows("benchmark") for t in terms(text)})
    sets = [np.array(sorted({words.index(t) for t in terms(text)}), dtype=np.int64) for _, text in rows("benchmark")]
    plan = mine_sharing(sets, len(words))
    assert plan.additions < 0.9 * sum(map(len, sets))
