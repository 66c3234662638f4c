"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

Each language has a probability for every vocabulary piece. The likelihood of a word is the sum
over all its segmentations into pieces, by a forward algorithm; a text's likelihood is the
product over its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetskein.llm.bpe_duckdb import ranks
from fleetskein.llm.words import Words, byte_tables, blocks, mixed, powers, words

#: Longest piece in bytes; longer vocabulary entries are left out.
MAX_PIECE = 16
#: Added to every piece count.
SMOOTHING = 0.1
#: Forward probabilities are scaled by this for every byte, which keeps words of up to LONG bytes in range.
SCALE, LONG = 256.0, 64


def held_out(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text leaves remainder 0. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


class Substrings:
    """Hashes of byte ranges of one body, from prefix sums made once."""

    def __init__(self, body: np.ndarray) -> None:
        _, _, per_byte, base, inverse = byte_tables()
        self.prefix = np.zeros(len(body) + 1, np.uint64)
        np.cumsum(per_byte[body] * powers(base, len(body)), dtype=np.uint64, out=self.prefix[1:])
        self.inverse = powers(inverse, len(body) + 1)

    def __call__(self, start: np.ndarray, size: int) -> np.ndarray:
        plain = (self.prefix[start + size] - self.prefix[start]) * self.inverse[start]
        return mixed(plain + np.uint64(size * 0xD6E8FEB86659FD93 % 2**64))


class Vocabulary:
    """Piece numbers by hash, in a few direct tables; what a full slot turns away goes to the next table."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.pieces = sorted({p for p in pieces if len(p) <= MAX_PIECE} | {bytes([b]) for b in range(256)})
        body = np.frombuffer(b"".join(self.pieces), np.uint8)
        sizes = np.array([len(p) for p in self.pieces])
        starts, sub = np.cumsum(sizes) - sizes, Substrings(body)
        self.hash = np.zeros(len(self.pieces), np.uint64)
        for n in range(1, MAX_PIECE + 1):
            at = np.flatnonzero(sizes == n)
            self.hash[at] = sub(starts[at], n)
        self.levels, rest = [], np.arange(len(self.pieces))
        while len(rest):
            table = np.full(1 << 20, -1, np.int32)
            slot = self.slot(self.hash[rest], len(self.levels))
            table[slot] = rest
            self.levels.append(table)
            rest = rest[table[slot] != rest]

    @staticmethod
    def slot(h: np.ndarray, level: int) -> np.ndarray:
        return ((h >> np.uint64(7 * level)) & np.uint64((1 << 20) - 1)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers, -1 where there is none."""
        out = np.full(len(h), -1, np.int32)
        for level, table in enumerate(self.levels):
            got = table[self.slot(h, level)]
            np.copyto(out, got, where=(got >= 0) & (self.hash[got] == h))
        return out


def _counts(path: str):
    """Arrow task: texts with their languages -> (lang, piece, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        table = ranks(path)
        encoding = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=table, special_tokens={})
        total: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, n in total.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], names=["lang", "token", "n"])
            total.clear()

        for block in blocks(batches):
            langs = np.array(block.column("lang").to_pylist(), object)
            w = words(block.column("text"))
            data = w.body.tobytes()
            for lang in set(langs):
                mine = np.flatnonzero((langs == lang)[w.row]) if len(w.row) else np.zeros(0, int)
                _, first, times = np.unique(w.hash[mine], return_index=True, return_counts=True)
                spans = [data[a:b].decode() for a, b in zip(w.start[mine][first], w.end[mine][first], strict=True)]
                ids = [encoding.encode_ordinary(s) for s in spans]
                flat = np.fromiter((i for x in ids for i in x), np.int64)
                weight = np.repeat(times, [len(x) for x in ids])
                n = total.setdefault(lang, np.zeros(max(table.values()) + 1, np.int64))
                n += np.bincount(flat, weights=weight, minlength=len(n)).astype(np.int64)
            if len(total) > 100:
                yield from out()
        yield from out()

    return run


class Model:
    """Log probabilities of all pieces in every learned language."""

    def __init__(self, langs: list[str], vocabulary: Vocabulary, prob: np.ndarray) -> None:
        self.langs, self.vocabulary, self.prob = langs, vocabulary, prob


def learn(docs: DataFrame, path: str) -> Model:
    """Piece counts per language over all given rows (columns text, lang); rows without a language are left out.

    What reaches the driver is one count per language and vocabulary piece.
    """
    counted = docs.where(F.col("lang").isNotNull()).select("lang", "text").mapInArrow(_counts(path), "lang string, token long, n long")
    rows = counted.groupBy("lang", "token").agg(F.sum("n").alias("n")).toArrow()
    table = {i: t for t, i in ranks(path).items()}
    vocabulary = Vocabulary(list(table.values()))
    number = {p: k for k, p in enumerate(vocabulary.pieces)}
    langs = sorted(set(rows.column("lang").to_pylist()))
    n = np.full((len(vocabulary.pieces), len(langs)), SMOOTHING)
    column = {x: k for k, x in enumerate(langs)}
    for lang, token, times in zip(*(rows.column(c).to_pylist() for c in ("lang", "token", "n")), strict=True):
        piece = table[token]
        for part in [piece] if piece in number else [bytes([b]) for b in piece]:
            n[number[part], column[lang]] += times
    return Model(langs, vocabulary, n / n.sum(axis=0, keepdims=True) if langs else n)


def word_scores(w: Words, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihood of every distinct word under every language, and the word number of each token."""
    _, first, which = np.unique(w.hash, return_index=True, return_inverse=True)
    start, size = w.start[first], w.end[first] - w.start[first]
    out = np.zeros((len(first), len(model.langs)))
    sub, find = Substrings(w.body), model.vocabulary.find
    scaled = np.vstack([model.prob * SCALE ** np.array([len(p) for p in model.vocabulary.pieces])[:, None], np.zeros((1, len(model.langs)))])
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        if n > LONG:
            for k in at:
                out[k] = _long_word(sub, find, model.prob, int(start[k]), int(n))
            continue
        for some in np.array_split(at, 1 + len(at) * n // 400_000):
            alpha = [np.ones((len(some), len(model.langs)))]
            for end in range(1, n + 1):
                now = np.zeros_like(alpha[0])
                for length in range(1, min(end, MAX_PIECE) + 1):
                    piece = find(sub(start[some] + end - length, length))
                    hit = np.flatnonzero(piece >= 0)
                    now[hit] += alpha[end - length][hit] * scaled[piece[hit]]
                alpha.append(now)
            out[some] = np.log(alpha[n]) - n * np.log(SCALE)
    return out, which


def _long_word(sub: Substrings, find, prob: np.ndarray, start: int, n: int) -> np.ndarray:
    """The same recursion for one word of any length; a window of the last values is rescaled at each byte."""
    window, log_scale = [np.ones(prob.shape[1])], np.zeros(prob.shape[1])
    for end in range(1, n + 1):
        now = np.zeros(prob.shape[1])
        for length in range(1, len(window) + 1):
            piece = find(sub(np.array([start + end - length]), length))[0]
            if piece >= 0:
                now += window[-length] * prob[piece]
        window = [x / now for x in window[-MAX_PIECE + 1 :]] + [np.ones_like(now)]
        log_scale += np.log(now)
    return log_scale


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, limit=4 << 20):
            w = words(block.column("text"))
            total = np.zeros((w.rows, len(model.langs)))
            if len(w.hash) and model.langs:
                scores, which = word_scores(w, model)
                for k in range(len(model.langs)):
                    total[:, k] = np.bincount(w.row, weights=scores[which, k], minlength=w.rows)
            if model.langs:
                best = total.argmax(axis=1)
                score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                lang = [model.langs[k] for k in best]
            else:
                score, lang = np.zeros(w.rows), ["und"] * w.rows
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(lang, pa.string()), pa.array(score), block.column("letters")], names=["doc_id", "lang_pred", "score", "letters"])

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` from the texts alone; score is the language's posterior under equal priors.

    ``und`` with score 0 for a null text, a text without a letter, or a model without
    languages. Equal likelihoods go to the first language in order. Every input row gives one row.
    """
    given = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("letters"))
    kind = given.schema["doc_id"].dataType.simpleString()
    found = given.mapInArrow(_predict(model), f"doc_id {kind}, lang_pred string, score double, letters boolean")
    return found.select(
        "doc_id",
        F.when(F.col("letters"), F.col("lang_pred")).otherwise("und").alias("lang_pred"),
        F.when(F.col("letters"), F.col("score")).otherwise(0.0).alias("score"),
    )


def identify(docs: DataFrame, path: str, folds: int = 5) -> DataFrame:
    """Learn on the documents outside fold 0, predict for all: doc_id, held_out, lang_pred, score."""
    away = held_out(F.col("doc_id"), folds)
    model = learn(docs.where(~away), path)
    return predict(docs, model).select("doc_id", away.alias("held_out"), "lang_pred", "score")
