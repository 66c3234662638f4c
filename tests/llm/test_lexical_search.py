"""Lexical search of many queries: the shared graph, blocks, groups, odd rows, against a plain model."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fleetskein.llm import lexical_search

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, term string, block long, score string"
ITEMS = "item_id long, text string, query string, rank int"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def model(docs, items, k):
    held = [(i, Counter(WORD.findall(low(t)))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in held]
    N, L = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(WORD.findall(low(t)))
    out = []
    for item, terms in asked.items():
        found = []
        for (i, c), n in zip(held, sizes, strict=True):
            m = 50 + (50 * n * N) // max(L, 1)
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0:
                found.append((-s, i is None, i, s))
        out += [(item, r, f[2], f[3]) for r, f in enumerate(sorted(found, key=lambda f: (f[:2], f[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def search(spark, docs, items, **more):
    docs = spark.createDataFrame([(*d, "z", 1, "z") for d in docs], DOCS).repartition(3)
    items = spark.createDataFrame([(*i, "z", 1) for i in items], ITEMS)
    return sorted((tuple(r) for r in lexical_search.search(docs, items, **more).collect()), key=str)


def random_rows(seed, n_docs, n_items):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(60)] + ["É", "Ab-cd", "x_y", "7"]
    weight = 1 / np.arange(1, len(words) + 1)
    text = lambda n: " ".join(rng.choice(words, n, p=weight / weight.sum()))
    docs = [(int(k), text(int(rng.integers(0, 60)))) for k in rng.permutation(n_docs)]
    items = [(k, text(int(rng.integers(0, 25)))) for k in range(n_items)]
    return docs, items


@pytest.mark.parametrize("more", [{}, {"group_terms": 5}])
def test_equals_a_plain_model(spark, monkeypatch, more):
    monkeypatch.setattr(lexical_search, "CELLS", 700)
    docs, items = random_rows(1, 300, 30)
    docs += [docs[0], docs[0], (None, docs[3][1]), (None, None), (5, "")]
    items += [(30, None), (31, "nothing-of_this unknownterm"), (3, "w1 w2 w3"), (None, "w0 w5 É")]
    assert search(spark, docs, items, k=7, **more) == model(docs, items, 7)


def test_blocks_and_copies_of_the_graphs(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "SPREAD", 1)
    docs, items = random_rows(2, 90, 12)
    found = search(spark, docs, items, k=5, group_terms=20)
    assert found == model(docs, items, 5)


def test_shared_sets_sum_the_same_terms():
    rng = np.random.default_rng(3)
    common = list(range(12))
    queries = [sorted({*common[: rng.integers(0, 12)], *rng.integers(12, 60, 9).tolist()}) for _ in range(40)] + [[], list(range(60, 90))]
    codes = {t: k for k, t in enumerate(sorted({t for q in queries for t in q}))}
    queries = [[codes[t] for t in q] for q in queries]
    nodes, made = lexical_search.shared_sets(queries)

    def terms(node):
        return [node] if node < len(codes) else terms(made[node - len(codes)][0]) + terms(made[node - len(codes)][1])

    assert [sorted(t for n in q for t in terms(n)) for q in nodes] == queries
    # Fewer additions than without sharing: the sets that queries share are summed up once.
    assert len(made) + sum(max(0, len(q) - 1) for q in nodes) < 0.8 * sum(max(0, len(q) - 1) for q in queries)
    contributions = rng.integers(0, 10**12, (len(codes), 5))
    for q, scores in lexical_search.partial_scores(nodes, made, contributions):
        assert scores.tolist() == contributions[queries[q]].sum(axis=0).tolist()


def test_postings():
    terms, border, doc, tf, n = lexical_search.postings(pa.array(["B-b a_É", None, "", "a A1 a\x00a"]))
    lists = {t.decode(): list(zip(doc[a:b].tolist(), tf[a:b].tolist(), strict=True)) for t, a, b in zip(terms.to_pylist(), border, border[1:], strict=False)}
    assert lists == {"b": [(0, 2)], "a": [(0, 1), (3, 3)], "É": [(0, 1)], "a1": [(3, 1)]} and n.tolist() == [4, 0, 0, 4]


def test_a_query_of_very_many_terms(spark):
    text = " ".join(f"t{k}" for k in range(60_000))
    found = search(spark, [(1, text), (2, "t5 t7"), (3, "nothing")], [(1, text), (2, "t7")], k=3)
    assert found == model([(1, text), (2, "t5 t7"), (3, "nothing")], [(1, text), (2, "t7")], 3)


@pytest.mark.parametrize("docs, items", [([], []), ([(1, "a")], []), ([], [(1, "a")]), ([(1, None)], [(1, "a")])])
def test_empty_tables(spark, docs, items):
    assert search(spark, docs, items) == []
