"""Katz backoff language model over the corpus: bigrams, words, unknown words.

The corpus is stored once as blocks of word numbers. Counts are found by asking: each block sends its
distinct words (or bigrams) with its own counts to the partition their hash belongs to; the partition
adds up, stores its part of the model and answers every block. Nothing of the size of the
corpus or of the vocabulary reaches the driver or one task.

Discounts are Good-Turing, d_c = (c + 1) n_(c+1) / (c n_c), up to c = 5; beyond, and where the counts of counts
give no value in (0, 1), they follow n_c ~ c^-2, which gives c / (c + 1). The lowest order is
(c + 0.1) / (N + 0.1 (V + 1)), which sums to one over the V words and one unknown word. The weight
of a context is (1 - discounted mass) / (1 - lower-order mass of its followers), so that every
conditional distribution sums to one. A context that was never seen leaves the lower order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetskein.llm.langid import held_out
from fleetskein.llm.words import blocks, mixed, row_ids, words
from fleetskein.session import discard, written

#: Hashes that stand for the end and the start of a text.
END, START = 0x1D8E4E27C47D124F, 0x7A1CE9B3D5F0A681
TURING = 5
ADD = 0.1
#: Distinct entries that one partition of the model holds, about.
PART_ENTRIES = 1_000_000
BLOCK = 3 << 20


def packed(ascending: np.ndarray) -> bytes:
    """Ascending 64-bit keys as differences, byte planes side by side, so that files compress."""
    gaps = np.diff(ascending, prepend=np.uint64(0)).astype("<u8")
    return np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view("<u8"), dtype=np.uint64)


def planes(values: np.ndarray) -> bytes:
    """Values as byte planes side by side, compressed, behind their size; high planes that are zero throughout are left out."""
    at = values.view(np.uint8).reshape(len(values), values.dtype.itemsize)
    used = max([1, *(np.flatnonzero(at.any(axis=0)) + 1).tolist()])
    data = np.ascontiguousarray(at[:, :used].T).tobytes()
    return bytes([used]) + len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unplanes(data: bytes, kind: str) -> np.ndarray:
    size = int.from_bytes(data[1:9], "little")
    given = np.frombuffer(pa.decompress(data[9:], size, codec="zstd", asbytes=True), np.uint8).reshape(data[0], -1)
    out = np.zeros((given.shape[1], np.dtype(kind).itemsize), np.uint8)
    out[:, : len(given)] = given.T
    return out.reshape(-1).view(kind)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow task: texts -> blocks of word numbers, each text closed by the end token."""
    from pyspark import TaskContext

    done, partition = 0, TaskContext.get().partitionId()
    for block in blocks(batches, limit=BLOCK):
        w = words(block.column("text"))
        n = w.per_row() + 1
        place = np.cumsum(n) - 1
        hashes = np.full(int(n.sum()), END, np.uint64)
        inner = np.ones(len(hashes), bool)
        inner[place] = False
        hashes[inner] = w.hash
        unique, codes = np.unique(np.concatenate([hashes, np.array([START], np.uint64)]), return_inverse=True)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(row_ids(partition, done, 1)),
                pa.ListArray.from_arrays(pa.array([0, block.num_rows], pa.int32()), block.column("doc_id")),
                pa.ListArray.from_arrays(pa.array([0, block.num_rows], pa.int32()), block.column("held")),
                pa.ListArray.from_arrays(pa.array([0, block.num_rows], pa.int32()), pa.array(n)),
                pa.array([packed(unique)], pa.binary()),
                pa.array([planes(codes[:-1].astype("<u4"))], pa.binary()),
            ],
            names=["block", "doc_ids", "held", "n_tokens", "words", "codes"],
        )
        done += 1


class Block:
    """A stored block with its bigrams, in the order of their keys."""

    def __init__(self, row: dict, bigrams: bool = True) -> None:
        self.words = unpacked(row["words"])
        self.code = unplanes(row["codes"], "<u4").astype(np.int64)
        self.n = np.array(row["n_tokens"], np.int64)
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        self.held = np.array(row["held"], bool)
        self.train = (~self.held)[self.doc]
        self.start = int(np.searchsorted(self.words, np.uint64(START)))
        if bigrams:
            before = np.empty_like(self.code)
            before[1:] = self.code[:-1]
            before[np.cumsum(self.n) - self.n] = self.start
            pair, which = np.unique(before * len(self.words) + self.code, return_inverse=True)
            left, right = pair // len(self.words), pair % len(self.words)
            key = mixed(self.words[left] * np.uint64(0x9E3779B97F4A7C15) + mixed(self.words[right] ^ np.uint64(0x632BE59BD9B4E019)))
            order = np.argsort(key)
            self.left, self.right, self.key = left[order], right[order], key[order]
            back = np.empty_like(order)
            back[order] = np.arange(len(order))
            self.which = back[which]


def questions(block: int, keys: np.ndarray, parts: int, *values: np.ndarray) -> Iterator[dict]:
    """One row for each partition that ascending keys belong to."""
    part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    cut = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
    for p in np.flatnonzero(np.diff(cut)).tolist():
        a, b = cut[p], cut[p + 1]
        yield {"part": p, "block": block, "keys": packed(keys[a:b])} | {f"v{i}": planes(v[a:b]) for i, v in enumerate(values)}


def _asking(rows: Callable[[dict], Iterator[dict]], schema: pa.Schema, most: int = 64):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = list(rows(batch.slice(k, 1).to_pylist()[0]))
                for at in range(0, len(found), most):
                    yield pa.RecordBatch.from_pylist(found[at : at + most], schema=schema)

    return run


def _ask_words(parts: int):
    def rows(row: dict) -> Iterator[dict]:
        b = Block(row, bigrams=False)
        n = np.bincount(b.code[b.train], minlength=len(b.words)).astype("<u8")
        n[b.start] = np.count_nonzero(~b.held)
        return questions(row["block"], b.words, parts, n)

    return rows


def _ask_bigrams(parts: int):
    def rows(row: dict) -> Iterator[dict]:
        b = Block(row)
        return questions(row["block"], b.key, parts, np.bincount(b.which[b.train], minlength=len(b.key)).astype("<u8"))

    return rows


#: Answers: for each question the counts in the order of its keys, twice the count and 1 where the block is
#: the first to hold the key. The row with block -1 is the partition's share of the model.
ANSWERS = "part int, block long, answer binary, keys binary, total long, kinds long, times array<long>"


def _count(table: pa.Table) -> pa.Table:
    keys = [unpacked(x) for x in table.column("keys").to_pylist()]
    given = np.concatenate([unplanes(x, "<u8") for x in table.column("v0").to_pylist()])
    unique, first, which = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    count = np.zeros(len(unique), np.uint64)
    np.add.at(count, which, given)
    answer = count[which] << np.uint64(1)
    answer[first] |= np.uint64(1)
    cut = np.cumsum([0, *map(len, keys)])
    own = count * (unique != np.uint64(START))
    seen = count > 0
    times = np.bincount(np.minimum(own, TURING + 2).astype(np.int64), minlength=TURING + 3)[: TURING + 2].tolist()
    part = table.column("part")[0].as_py()
    n = table.num_rows
    return pa.table(
        {
            "part": pa.array([part] * (n + 1), pa.int32()),
            "block": pa.concat_arrays([table.column("block").combine_chunks().cast(pa.int64()), pa.array([-1], pa.int64())]),
            "answer": pa.array([planes(answer[a:b].astype("<u8")) for a, b in zip(cut[:-1], cut[1:], strict=True)] + [planes(count[seen].astype("<u8"))], pa.binary()),
            "keys": pa.array([None] * n + [packed(unique[seen])], pa.binary()),
            "total": pa.array([0] * n + [int(own.sum())], pa.int64()),
            "kinds": pa.array([0] * n + [int(np.count_nonzero(own))], pa.int64()),
            "times": pa.array([None] * n + [times], pa.list_(pa.int64())),
        }
    )


def discounts(times: list[int]) -> np.ndarray:
    """d_0 .. d_TURING from counts of counts; see the module's text."""
    out = np.zeros(TURING + 1)
    for c in range(1, TURING + 1):
        d = (c + 1) * times[c + 1] / (c * times[c]) if times[c] else 0.0
        out[c] = d if 0 < d < 1 else c / (c + 1)
    return out


def discount(c: np.ndarray, table: np.ndarray) -> np.ndarray:
    return np.where(c <= TURING, table[np.minimum(c, TURING).astype(np.int64)], c / (c + 1.0))


def _gathered(answers: pa.Table, what: int, kind: str) -> np.ndarray:
    """Answers of all partitions to one sort of question, in the order of the keys."""
    own = answers.filter(pc.equal(answers.column("what"), what)).sort_by("part")
    return np.concatenate([np.zeros(0, kind), *(unplanes(x, kind) for x in own.column("answer").to_pylist())])


def _evaluate(total: int, kinds: int, d: np.ndarray):
    """Per block: what is known without context weights, and what each context has given away."""
    bottom = total + ADD * (kinds + 1)

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        b = Block(row)
        word = (_gathered(answers, 0, "<u8") >> np.uint64(1)).astype(float)
        answer = _gathered(answers, 1, "<u8")
        c, owner = (answer >> np.uint64(1)).astype(float), (answer & np.uint64(1)).astype(bool)
        low = (word + ADD) / bottom
        rows = len(b.n)
        base = np.bincount(b.doc, weights=np.log10(low)[b.code], minlength=rows)
        known = np.bincount(b.doc, weights=word[b.code] > 0, minlength=rows)
        context = word[b.left]
        seen = c > 0
        p = np.where(seen, np.divide(discount(c, d) * c, context, out=np.ones_like(c), where=context > 0), low[b.right])
        score = np.bincount(b.doc, weights=np.log10(p)[b.which], minlength=rows)
        # What the block is first to hold counts for its context.
        mine = owner & seen
        gone = np.bincount(b.left[mine], weights=p[mine], minlength=len(b.words))
        # Lower-order mass as whole numbers, sums of counts and of followers: exact in any order, and small.
        under = np.bincount(b.left[mine], weights=word[b.right[mine]], minlength=len(b.words)).astype("<u8")
        after = np.bincount(b.left[mine], minlength=len(b.words)).astype("<u8")
        # Tokens that back off from a known context.
        wait = ~seen & (context > 0)
        token = np.flatnonzero(wait[b.which])
        need = np.zeros(len(b.words), bool)
        need[b.left[wait]] = True
        ask = np.flatnonzero(need | (gone > 0))
        where = np.full(len(b.words), -1)
        where[np.flatnonzero(need)] = np.arange(need.sum())
        return pa.Table.from_pylist(
            [
                {
                    "block": row["block"], "doc_ids": row["doc_ids"], "held": row["held"], "n_tokens": row["n_tokens"],
                    "known": known.astype(np.int64).tolist(), "base": base.tolist(), "score": score.tolist(),
                    "wait_doc": planes(b.doc[token].astype("<u4")), "wait_context": planes(where[b.left[b.which[token]]].astype("<u4")),
                    "keys": packed(b.words[ask]), "gone": planes(gone[ask]), "under": planes(under[ask]), "after": planes(after[ask]), "need": need[ask].tobytes(),
                }
            ],
            schema=evaluated_schema(block.schema.field("doc_ids").type),
        )

    return run


def evaluated_schema(ids: pa.DataType) -> pa.Schema:
    lists = [("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())]
    binary = ["wait_doc", "wait_context", "keys", "gone", "under", "after", "need"]
    return pa.schema(
        [("block", pa.int64()), ("doc_ids", ids), ("held", pa.list_(pa.bool_())), ("n_tokens", pa.list_(pa.int64()))] + [(n, pa.list_(t)) for n, t in lists] + [(n, pa.binary()) for n in binary]
    )


def _ask_contexts(parts: int):
    def rows(row: dict) -> Iterator[dict]:
        need = np.frombuffer(row["need"], bool).astype("<u1")
        return questions(row["block"], unpacked(row["keys"]), parts, unplanes(row["gone"], "<f8"), unplanes(row["under"], "<u8"), unplanes(row["after"], "<u8"), need)

    return rows


def _weigh(bottom: float):
    """Context weights: model rows (block -1), and for each block those it needs."""

    def run(table: pa.Table) -> pa.Table:
        keys = [unpacked(x) for x in table.column("keys").to_pylist()]
        unique, which = np.unique(np.concatenate(keys), return_inverse=True)
        given = (np.concatenate([unplanes(x, kind) for x in table.column(v).to_pylist()]) for v, kind in (("v0", "<f8"), ("v1", "<u8"), ("v2", "<u8")))
        gone, under, after = (np.bincount(which, weights=x, minlength=len(unique)) for x in given)
        lower = (under + ADD * after) / bottom
        weight = np.log10(np.maximum(1 - gone, 1e-300)) - np.log10(np.maximum(1 - lower, 1e-300))
        need = np.concatenate([unplanes(x, "<u1") for x in table.column("v3").to_pylist()]).astype(bool)
        cut = np.cumsum([0, *map(len, keys)])
        answers = [planes(weight[which[a:b]][need[a:b]]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        n, part = table.num_rows, table.column("part")[0].as_py()
        return pa.table(
            {
                "part": pa.array([part] * (n + 1), pa.int32()),
                "block": pa.concat_arrays([table.column("block").combine_chunks().cast(pa.int64()), pa.array([-1], pa.int64())]),
                "answer": pa.array([*answers, planes(weight)], pa.binary()),
                "keys": pa.array([None] * n + [packed(unique)], pa.binary()),
            }
        )

    return run


def _finish(block: pa.Table, answers: pa.Table) -> pa.Table:
    row = block.to_pylist()[0]
    weight = _gathered(answers, 0, "<f8")
    doc, context = unplanes(row["wait_doc"], "<u4"), unplanes(row["wait_context"], "<u4")
    score = np.array(row["score"]) + np.bincount(doc, weights=weight[context], minlength=len(row["score"]))
    return pa.table(
        {
            "doc_id": pa.array(row["doc_ids"], block.schema.field("doc_ids").type.value_type), "held_out": pa.array(row["held"], pa.bool_()),
            "n_tokens": pa.array(row["n_tokens"], pa.int64()), "n_known": pa.array(row["known"], pa.int64()),
            "base_score": pa.array(row["base"], pa.float64()), "score": pa.array(score, pa.float64()),
        }
    )


def _meeting(blocks: DataFrame, *answers: DataFrame):
    """Each block with its answers, sort by sort. Answers are sorted and streamed, one block's at a time is in memory."""
    own = [a.where("block >= 0").select("block", F.lit(k).alias("what"), "part", "answer") for k, a in enumerate(answers)]
    return blocks.groupBy("block").cogroup(reduce(DataFrame.unionAll, own).groupBy("block"))


def score_texts(docs: DataFrame, folds: int = 10, part_entries: int = PART_ENTRIES) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` (log10 probabilities) for every row.

    Learns from rows whose crc32 of the id as text leaves another remainder than 0 by ``folds`` (null id: as
    the empty text, which is held out). Tokens: words, A-Z lower-cased, and one end per text; a null or empty text is the
    end alone. base_score uses the lowest order only. Without training rows N and V are 0. The
    model stays in the shared folder as tables: word_counts and bigram_counts (part, keys, counts), weights (rows with block -1).
    """
    given = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out(F.col("doc_id"), folds).alias("held"))
    kind = given.schema["doc_id"].dataType.simpleString()
    store = written(given.mapInArrow(_store, f"block long, doc_ids array<{kind}>, held array<boolean>, n_tokens array<long>, words binary, codes binary"), "blocks")
    size = store.agg(F.sum(F.length("words") / 8).alias("words"), F.sum(F.expr("aggregate(n_tokens, 0L, (a, n) -> a + n)")).alias("tokens")).first()
    parts = lambda n: max(8, int((n or 0) // part_entries) + 1)
    ask = lambda v: pa.schema([("part", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), *[(f"v{i}", pa.binary()) for i in range(v)]])
    asked = "part int, block long, keys binary, v0 binary"

    of_words = store.mapInArrow(_asking(_ask_words(parts(size["words"])), ask(1)), asked).groupBy("part").applyInArrow(_count, ANSWERS)
    of_words = written(of_words, "words")
    of_bigrams = store.mapInArrow(_asking(_ask_bigrams(parts(size["tokens"])), ask(1)), asked).groupBy("part").applyInArrow(_count, ANSWERS)
    of_bigrams = written(of_bigrams, "bigrams")
    counted = of_words.where("block = -1").agg(F.sum("total").alias("n"), F.sum("kinds").alias("v")).first()
    total, kinds = counted["n"] or 0, counted["v"] or 0
    times = of_bigrams.where("block = -1").agg(*[F.sum(F.col("times")[k]).alias(f"t{k}") for k in range(TURING + 2)]).first()
    d = discounts([x or 0 for x in times])

    schema = (
        f"block long, doc_ids array<{kind}>, held array<boolean>, n_tokens array<long>, known array<long>, base array<double>, score array<double>, "
        "wait_doc binary, wait_context binary, keys binary, gone binary, under binary, after binary, need binary"
    )
    valued = written(_meeting(store, of_words, of_bigrams).applyInArrow(_evaluate(total, kinds, d), schema), "valued")
    # The model stays; answers and blocks have been read for the last time.
    for counts, label in ((of_words, "word_counts"), (of_bigrams, "bigram_counts")):
        written(counts.where("block = -1").select("part", "keys", F.col("answer").alias("counts")), label, keep=True)
    discard(store, of_words, of_bigrams)
    contexts = valued.select("block", "keys", "gone", "under", "after", "need").mapInArrow(_asking(_ask_contexts(parts(size["words"])), ask(4)), asked + ", v1 binary, v2 binary, v3 binary")
    weights = written(contexts.groupBy("part").applyInArrow(_weigh(total + ADD * (kinds + 1)), "part int, block long, answer binary, keys binary"), "weights")
    last = _meeting(valued.drop("keys", "gone", "under", "after", "need"), weights)
    out = last.applyInArrow(_finish, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
