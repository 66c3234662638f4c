"""Ranked lexical search for many queries at once, with shared parts of the queries computed once.

Texts become posting lists per block of documents. Only lists of terms that some query asks for go on; they give the
document frequencies. Queries are taken in groups; in each, terms that the same queries hold are one set, and sets
that often stand side by side are joined pair by pair to larger ones (as in grammar compression). What results is a
graph without cycles: terms, shared sets, queries. A task computes the partial scores of every shared set once per
block of documents and adds them up along the graph, then keeps the best documents of each query.
All sums are of integers, so their order doesn't matter.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetskein.llm.words import blocks, byte_tables, raw, row_ids
from fleetskein.session import passing, written

#: Bytes of text in one block of postings.
BLOCK = 4 << 20
#: Terms of all queries of a group together, about; a query of more terms is a group by itself.
GROUP_TERMS = 20_000
#: Partial scores that a task holds at a time.
CELLS = 4_000_000
#: Blocks that a copy of the queries' graphs is made for.
SPREAD = 32
#: Fixed value: terms of queries, the same rule as ``postings`` follows.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def postings(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms, the borders of their lists, documents and occurrences in the lists, and terms of each document."""
    _, lower, *_ = byte_tables()
    letter = np.zeros(256, bool)
    letter[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
    body, offsets = raw(texts)
    body = lower[body]
    inside = letter[body]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] |= inside[heads]
    start = np.flatnonzero(first)
    row = np.searchsorted(offsets, start, "right") - 1
    kept = body[inside]
    ends = np.append(np.cumsum(inside)[start] - 1, len(kept)).astype(np.int64)
    terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(kept.tobytes())]).dictionary_encode()
    rows = len(offsets) - 1
    key, tf = np.unique(terms.indices.to_numpy().astype(np.int64) * max(rows, 1) + row, return_counts=True)
    border = np.searchsorted(key, np.arange(len(terms.dictionary) + 1, dtype=np.int64) * max(rows, 1))
    return terms.dictionary, border, key % max(rows, 1), tf, np.bincount(row, minlength=rows)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow task: texts -> one row per term of a block with its posting list, and one without term with the documents."""
    from pyspark import TaskContext

    done, partition = 0, TaskContext.get().partitionId()
    for block in blocks(batches, limit=BLOCK):
        terms, border, doc, tf, n = postings(block.column("text"))
        rows, kind = block.num_rows, block.column("doc_id").type
        number, lists = row_ids(partition, done, 1), pa.array(border.astype(np.int32))
        no = lambda count, of: pa.nulls(count, pa.list_(of))
        names = ["block", "term", "docs", "tf", "doc_ids", "sizes"]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(number, len(terms))), terms.cast(pa.binary()).cast(pa.string()), pa.ListArray.from_arrays(lists, pa.array(doc.astype(np.int32))),
                pa.ListArray.from_arrays(lists, pa.array(tf.astype(np.int32))), no(len(terms), kind), no(len(terms), pa.int64()),
            ],
            names=names,
        )
        one = pa.array([0, rows], pa.int32())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(number), pa.nulls(1, pa.string()), no(1, pa.int32()), no(1, pa.int32()),
                pa.ListArray.from_arrays(one, block.column("doc_id")), pa.ListArray.from_arrays(one, pa.array(n.astype(np.int64))),
            ],
            names=names,
        )
        done += 1


def shared_sets(queries: list[list[int]]) -> tuple[list[list[int]], list[tuple[int, int]]]:
    """Queries as short lists of nodes, and for each node beyond the terms the two nodes it is made of.

    Terms 0, 1, ... are nodes; a new node stands for a set that two queries or more hold, or that one class of terms makes up.
    """
    holders: dict[int, list[int]] = defaultdict(list)
    for q, terms in enumerate(queries):
        for t in terms:
            holders[t].append(q)
    following = max(holders, default=-1) + 1
    made: list[tuple[int, int]] = []

    def join(a: int, b: int) -> int:
        made.append((a, b))
        return following + len(made) - 1

    # Terms of exactly the same queries are summed up first; the most used classes stand first in every query.
    classes: dict[tuple[int, ...], list[int]] = defaultdict(list)
    for t in sorted(holders):
        classes[tuple(holders[t])].append(t)
    sequences: list[list[int]] = [[] for _ in queries]
    for held, terms in sorted(classes.items(), key=lambda c: (-len(c[0]), c[0])):
        node = terms[0]
        for t in terms[1:]:
            node = join(node, t)
        for q in held:
            sequences[q].append(node)
    while True:
        pairs = Counter(p for s in sequences for p in zip(s, s[1:], strict=False))
        taken: dict[int, tuple[int, int]] = {}
        chosen: dict[tuple[int, int], int] = {}
        for pair, times in sorted(pairs.items(), key=lambda p: (-p[1], p[0])):
            if times < 2:
                break
            if not (taken.keys() & pair):
                taken |= dict.fromkeys(pair, pair)
                chosen[pair] = join(*pair)
        if not chosen:
            return sequences, made
        for q, s in enumerate(sequences):
            out, k = [], 0
            while k < len(s):
                node = chosen.get((s[k], s[k + 1])) if k + 1 < len(s) else None
                out.append(s[k] if node is None else node)
                k += 1 if node is None else 2
            sequences[q] = out


def _graph(table: pa.Table) -> pa.Table:
    """Queries of a group with their terms' weights -> the group's graph in one row."""
    terms = table.column("term").combine_chunks().dictionary_encode()
    code = terms.indices.to_numpy()
    weight = np.zeros(len(terms.dictionary), np.int64)
    weight[code] = table.column("weight").to_numpy()
    ids = table.column("query").to_numpy()
    order, where = np.unique(ids, return_inverse=True)
    queries: list[list[int]] = [[] for _ in order]
    for q, t in zip(where.tolist(), code.tolist(), strict=True):
        queries[q].append(t)
    sequences, made = shared_sets(queries)
    row = {"group": table.column("group")[0].as_py(), "queries": order.tolist(), "terms": terms.dictionary.to_pylist(), "weights": weight.tolist()}
    row |= {"made": [x for pair in made for x in pair], "nodes": sequences}
    return pa.Table.from_pylist([row], schema=GRAPH)


GRAPH = pa.schema([("group", pa.int64()), ("queries", pa.list_(pa.int64())), ("terms", pa.list_(pa.string())), ("weights", pa.list_(pa.int64())), ("made", pa.list_(pa.int64())), ("nodes", pa.list_(pa.list_(pa.int64())))])
GRAPH_DDL = "group long, queries array<long>, terms array<string>, weights array<long>, made array<long>, nodes array<array<long>>"


def partial_scores(queries: list[list[int]], made: list[tuple[int, int]], terms: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Scores of every query in all documents, from the terms' contributions (term x document)."""
    nodes = np.empty((len(terms) + len(made), terms.shape[1]), np.int64)
    nodes[: len(terms)] = terms
    for k, (a, b) in enumerate(made, len(terms)):
        np.add(nodes[a], nodes[b], out=nodes[k])
    for q, own in enumerate(queries):
        yield q, nodes[own].sum(axis=0)


def _best(k: int, ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores above 0, ties to smaller ids; ids are ranks, so that a null id can come last."""
    at = np.flatnonzero(scores > 0)
    if len(at) > k:
        least = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= least]
    order = at[np.lexsort((ids[at], -scores[at]))][:k]
    return ids[order], scores[order]


def _search(k: int, n_docs: int, n_terms: int):
    """Arrow task: (block, graph) pairs -> the best documents of each query among the blocks of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, dict[int, tuple[np.ndarray, np.ndarray]]] = {}
        graphs: dict[int, dict] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                group = one.column("group")[0].as_py()
                if group not in graphs:
                    # A task that meets many groups hands over what it has.
                    if len(graphs) == 16:
                        yield from _given(best)
                        best.clear(), graphs.clear()
                    graphs[group] = one.select(GRAPH.names).to_pylist()[0]
                _score_block(one, graphs[group], best.setdefault(group, {}), k, n_docs, n_terms)
        yield from _given(best)

    return run


def _score_block(one: pa.RecordBatch, graph: dict, best: dict, k: int, n_docs: int, n_terms: int) -> None:
    lists = one.column("lists").flatten()
    place = {t: p for p, t in enumerate(graph["terms"])}
    which = np.array([place.get(t, -1) for t in lists.field("term").to_pylist()], np.int64)
    found = lists.field("docs")
    size = np.diff(found.offsets.to_numpy())
    term, doc = np.repeat(which, size), found.flatten().to_numpy().astype(np.int64)
    tf = lists.field("tf").flatten().to_numpy().astype(np.int64)
    ids = one.column("doc_ids").flatten().fill_null(np.iinfo(np.int64).max).to_numpy().astype(np.int64)
    n = one.column("sizes").flatten().to_numpy()
    m = np.int64(50) + (50 * n * n_docs) // max(n_terms, 1)
    mine = term >= 0
    term, doc, tf = term[mine], doc[mine], tf[mine]
    value = np.array(graph["weights"], np.int64)[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
    made = [(a, b) for a, b in zip(graph["made"][::2], graph["made"][1::2], strict=True)]
    order = np.argsort(doc, kind="stable")
    term, doc, value = term[order], doc[order], value[order]
    width = max(1, CELLS // (len(place) + len(made) + 1))
    for a in range(0, len(ids), width):
        b = min(a + width, len(ids))
        lo, hi = np.searchsorted(doc, (a, b))
        terms = np.zeros((len(place), b - a), np.int64)
        terms[term[lo:hi], doc[lo:hi] - a] = value[lo:hi]
        for q, scores in partial_scores(graph["nodes"], made, terms):
            top = _best(k, ids[a:b], scores)
            query = graph["queries"][q]
            if query in best:
                top = _best(k, np.concatenate([best[query][0], top[0]]), np.concatenate([best[query][1], top[1]]))
            best[query] = top


def _given(best: dict) -> Iterator[pa.RecordBatch]:
    for queries in best.values():
        ids = np.concatenate([i for i, _ in queries.values()] or [np.zeros(0, np.int64)])
        scores = np.concatenate([s for _, s in queries.values()] or [np.zeros(0, np.int64)])
        of = np.repeat(np.array(list(queries), np.int64), [len(i) for i, _ in queries.values()])
        known = ids != np.iinfo(np.int64).max
        yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(ids, mask=~known), pa.array(scores)], names=["query", "doc_id", "score"])


def terms_of(text: Column) -> Column:
    """Terms of a short text, as the postings have them."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0))


def search(docs: DataFrame, queries: DataFrame, k: int = 50, group_terms: int = GROUP_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: for each item the ``k`` documents (``doc_id`` long) with the highest score above 0.

    Terms: runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII, in whole texts. N documents hold a term, L terms
    in all, df documents hold the term, a document holds n terms and the term tf times; m = 50 + (50 n N) div L, weight
    w = floor(1000 ln((2 N + 2) / (2 df + 1))), the score sums w ((10^9 tf) div (1000 tf + 20 m)) over the distinct terms of the item.
    Ties go to the smaller doc_id, null last. Every row of ``docs`` is a document, repeated ids too; rows of ``queries`` with one item_id
    (null: one item as well) are one item with the terms of all. Null and empty texts hold no term: they are never found,
    and such items have no row. Other columns are not read.
    """
    given = docs.select("doc_id", "text")
    kind = given.schema["doc_id"].dataType.simpleString()
    asked = queries.select("item_id", F.explode(F.array_distinct(terms_of(F.coalesce("text", F.lit(""))))).alias("term")).distinct()
    with passing():
        # Items by a number of their own, so that ids may be of any type, and null.
        asked = written(asked.withColumn("query", F.xxhash64(F.col("item_id").isNull(), F.col("item_id"))), "asked")
        terms = asked.select("term").distinct()
        lists = given.mapInArrow(_index, f"block long, term string, docs array<int>, tf array<int>, doc_ids array<{kind}>, sizes array<long>")
        held = F.transform("sizes", lambda n: (n > 0).cast("long"))
        add = lambda values: F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)
        wanted = terms.withColumn("wanted", F.lit(True))
        index = written(lists.join(wanted, "term", "left").where("wanted OR term IS NULL").drop("wanted"), "index")
        size = index.where("term IS NULL").agg(F.sum(add(held)).alias("docs"), F.sum(add(F.col("sizes"))).alias("terms"), F.count("*").alias("blocks")).first()
        n_docs, n_terms = size["docs"] or 0, size["terms"] or 0
        df = index.where("term IS NOT NULL").groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
        weight = F.floor(1000 * F.log((F.lit(2.0) * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
        total = asked.count()
        groups = F.pmod(F.xxhash64("query"), F.lit(total // group_terms + 1)).alias("group")
        graphs = asked.join(df.select("term", weight.alias("weight")), "term").select(groups, "query", "term", "weight").groupBy("group").applyInArrow(_graph, GRAPH_DDL)
        graphs = written(graphs, "graphs")
        # Bounded by a block's documents and the terms of the queries in it.
        packed = index.groupBy("block").agg(
            F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "docs", "tf"))).alias("lists"),
            F.first("doc_ids", ignorenulls=True).alias("doc_ids"), F.first("sizes", ignorenulls=True).alias("sizes"),
        )
        # Every block meets every group of queries; each of ``copies`` of the graphs serves some of the blocks, so that no task gets all of them.
        copies = max(1, size["blocks"] // SPREAD)
        met = packed.select("*", F.pmod(F.xxhash64("block"), F.lit(copies)).alias("copy"))
        served = graphs.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))))
        found = met.join(served, "copy").drop("copy", "block").mapInArrow(_search(k, n_docs, n_terms), "query long, doc_id long, score long")
        found = written(found, "found", keep=True)
        items = written(asked.select("item_id", "query").distinct(), "items", keep=True)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(items, "query").select("item_id", "rank", "doc_id", "score")


SQL = r"""
WITH tokens AS (
  SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents WHERE text IS NOT NULL),
sizes AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM tokens WHERE len(t) > 0),
asked AS (
  SELECT DISTINCT item_id,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
counts AS (
  SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(t) AS n, unnest(t) AS term FROM tokens)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM counts, sizes GROUP BY term),
parts AS (
  SELECT row, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))) AS part
  FROM counts JOIN weights USING (term), sizes),
scores AS (SELECT item_id, row, doc_id, sum(part)::BIGINT AS score FROM asked JOIN parts USING (term) GROUP BY ALL HAVING sum(part) > 0)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scores
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
"""
