"""Substring deduplication by sliding spans of sentences.

Every run of several consecutive sentences is hashed, equal runs meet over all documents, and
sentences covered by a run that is not its content's first occurrence are removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetskein.llm.words import blocks, mixed, words
from fleetskein.session import passing, written

#: A sentence ends behind its end marks and the spaces that follow, or at a line break.
SENTENCE = re.compile(r"[^\n]*?(?:[.!?…。！？]+[\"'”’»)\]]*(?:[^\S\n]+|\n+|$)|\n+|$)", re.S)
#: A run is closed once it has so many sentences and so many words ...
SENTENCES, WORDS = 2, 24
#: ... or is one sentence of so many words.
LONE_WORDS = 40
#: Texts without a mark need not meet the covers. The marks of a corpus take 4 MB at most; with far more covers all texts are marked.
MARK_BITS = 1 << 25
RESULTS = ("n_sentences", "n_removed", "removed")


def sentence_starts(text: str) -> list[int]:
    """Offsets (code points) where the sentences of a text begin; spaces behind a sentence belong to it."""
    return [m.start() for m in SENTENCE.finditer(text) if m.end() > m.start()]


def sentence_runs(texts: list[str | None], sentences: int, least_words: int, lone_words: int) -> tuple[np.ndarray, ...]:
    """All runs of a block: row, first sentence, number of sentences, two 64-bit hashes of the words.

    From each sentence on, the run is the shortest that is closed by ``sentences`` and ``least_words``; at the end of a
    text no run begins that isn't. A sentence of ``lone_words`` is a run by itself besides.
    """
    starts = [sentence_starts(t or "") for t in texts]
    spans = [t[a:b] for t, s in zip(texts, starts, strict=True) for a, b in zip(s, [*s[1:], len(t or "")], strict=False)]
    per = np.array([len(s) for s in starts], np.int64)
    w = words(pa.array(spans, pa.large_string()))
    n = w.per_row()
    upto = np.concatenate([[0], np.cumsum(n)])
    row = np.repeat(np.arange(len(texts)), per)
    last = np.repeat(np.cumsum(per), per)
    first = np.arange(len(spans))
    end = np.maximum(np.searchsorted(upto, upto[:-1] + least_words), first + sentences)
    at, alone = np.flatnonzero((end <= last) & (n > 0)), np.flatnonzero(n >= lone_words)
    at, end = np.concatenate([at, alone]), np.concatenate([end[at], alone + 1])
    # Position-weighted sums over words; the position counts from the run's first word.
    place = np.arange(len(w.hash), dtype=np.uint64)
    hashes = []
    for base in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        weight = np.full(len(place) + 1, base, np.uint64)
        weight[0] = 1
        weight = np.cumprod(weight, dtype=np.uint64)
        back = np.full(len(place) + 1, pow(base, -1, 2**64), np.uint64)
        back[0] = 1
        back = np.cumprod(back, dtype=np.uint64)
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(w.hash ^ np.uint64(base)) * weight[: len(place)], dtype=np.uint64)])
        a, b = upto[at], upto[end]
        hashes.append(mixed((prefix[b] - prefix[a]) * back[a] + (b - a).astype(np.uint64)).view(np.int64))
    base = np.cumsum(per) - per
    return row[at], (at - base[row[at]]).astype(np.int32), (end - at).astype(np.int32), hashes[0], hashes[1]


def _slot(key: F.Column) -> F.Column:
    return F.pmod(key, F.lit(MARK_BITS)) + 1


def _marks(keys: DataFrame) -> DataFrame:
    """A bitmap over the slots of the keys, in pieces; at most ``MARK_BITS`` bits, however many keys there are."""
    slot = _slot(F.col("key"))
    return keys.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))


def _marked(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """``rows`` with ``marked``: false only where ``key`` is none of the bitmap's keys."""
    slot = _slot(F.col("key"))
    place = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring("bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))
    # Broadcast whatever the session's threshold: the size is bounded by ``MARK_BITS``, and a join by exchange would shuffle all texts.
    return rows.join(F.broadcast(marks), F.bitmap_bucket_number(slot) == F.col("bucket"), "left").withColumn("marked", hit)


def _runs(sentences: int, least_words: int, lone_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            row, first, size, h1, h2 = sentence_runs(block.column("text").to_pylist(), sentences, least_words, lone_words)
            own = [block.column(c).take(pa.array(row)) for c in ("doc_id", "content")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(first), pa.array(size), pa.array(h1), pa.array(h2)], names=["doc_id", "content", "first", "size", "h1", "h2"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow task: texts with the sentence ranges to remove."""
    for block in blocks(batches):
        texts, total, removed, spans = [], [], [], []
        for text, cover in zip(block.column("text").to_pylist(), block.column("cover").to_pylist(), strict=True):
            starts = sentence_starts(text or "")
            total.append(len(starts))
            gone = np.zeros(len(starts) + 1, np.int64)
            for c in cover or []:
                gone[c["first"]] += 1
                gone[min(c["first"] + c["size"], len(starts))] -= 1
            drop = np.cumsum(gone[:-1]) > 0
            removed.append(int(drop.sum()))
            bounds = [*starts, len(text or "")]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], drop.view(np.int8), [0]])))
            spans.append([{"start": bounds[a], "end": bounds[b]} for a, b in edge.reshape(-1, 2).tolist()])
            texts.append(text if not drop.any() else "".join(text[bounds[k] : bounds[k + 1]] for k in np.flatnonzero(~drop)))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        columns = [block.column("doc_id"), block.column("others"), pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "others", "text", "n_sentences", "n_removed", "removed"])


def remove_repeats(docs: DataFrame, sentences: int = SENTENCES, least_words: int = WORDS, lone_words: int = LONE_WORDS) -> DataFrame:
    """``docs`` with repeated sentence runs taken out of ``text``; plus n_sentences, n_removed, removed (spans).

    A run has at least ``sentences`` sentences and ``least_words`` words, or is one sentence of ``lone_words``
    words; runs are equal if their words are (A-Z lower-cased, spaces not regarded). The first occurrence, by
    (doc_id, hash of the text, position), stays; null ids come last. Rows of one doc_id with different texts are
    different documents, and so are rows without an id; rows that are equal in both count as one document and keep
    the same text. Offsets in ``removed`` are code points of the given text. Null text stays null, all other
    columns stay, whatever their names; columns named like the three results are replaced.
    """
    given = docs.drop(*RESULTS)
    others = [c for c in given.columns if c not in ("doc_id", "text")]
    spare = "_" * (1 + max(map(len, given.columns)))
    # The caller's columns travel as one struct, so that no name can clash with the operator's own.
    packed = F.struct(*[F.col(f"`{c}`") for c in others], F.lit(None).cast("boolean").alias(spare)).alias("others")
    flat = given.select("doc_id", "text", packed, F.xxhash64("text").alias("content"))
    kind = given.schema["doc_id"].dataType.simpleString()
    found = flat.select("doc_id", "text", "content").mapInArrow(
        _runs(sentences, least_words, lone_words), f"doc_id {kind}, content long, first int, size int, h1 long, h2 long"
    )
    with passing():
        runs = written(found, "runs")
        place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content", "first")
        firsts = runs.groupBy("h1", "h2").agg(F.min(place).alias("origin"), F.count("*").alias("times")).where("times > 1")
        again = runs.join(firsts, ["h1", "h2"]).where(~place.eqNullSafe(F.col("origin")))
        # Bounded by one document's sentences.
        cover = again.groupBy("doc_id", "content").agg(F.collect_set(F.struct("first", "size")).alias("cover"))
        cover = written(cover.withColumnsRenamed({"doc_id": "of_doc", "content": "of_content"}), "cover", keep=True)
        marks = written(_marks(cover.select(F.xxhash64("of_doc", "of_content").alias("key"))), "marks", keep=True)
    same = F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("content") == F.col("of_content"))
    marked = _marked(flat.withColumn("key", F.xxhash64("doc_id", "content")), marks)
    columns = ["doc_id", "text", "others", "cover"]
    joined = marked.where("marked").join(cover, same, "left").select(columns)
    others_kept = marked.where("not marked").withColumn("cover", F.lit(None).cast(cover.schema["cover"].dataType))
    joined = joined.unionAll(others_kept.select(columns))
    results = T.StructType.fromDDL("text string, n_sentences long, n_removed long, removed array<struct<start:long,end:long>>")
    out = joined.mapInArrow(_cut, T.StructType([flat.schema["doc_id"], flat.schema["others"], *results]))
    return out.select(*[F.col(c) if c in ("doc_id", "text") else F.col("others")[c].alias(c) for c in given.columns], *RESULTS)
