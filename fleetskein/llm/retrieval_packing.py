"""Packing with lexical retrieval: a sharded BM25 index finds the neighbours that fill a seed's window.

Documents are cut into full windows; the rest of each document is packed. Rests are range-partitioned
by a minimum hash of their token pairs, so that related texts meet; consecutive rests form
shards of fixed size with an inverted index each. A window takes its seed's best unused
neighbours and cuts the last one, whose remainder seeds the next window.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetskein.llm.bpe_duckdb import ranks
from fleetskein.llm.words import blocks, mixed
from fleetskein.session import written

WINDOW = 1024
#: Rests in one shard of the index.
SHARD = 512
#: Fixed values of BM25.
K1, B = 1.2, 0.75


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _cut(path: str, pattern: str, window: int, special: Mapping[str, int]):
    """Arrow task: texts -> full windows (ids null) and the rest of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoding = tiktoken.Encoding("ids", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens=dict(special))
        for block in blocks(batches):
            out: list[tuple] = []
            row: list[int] = []
            for k, text in enumerate(block.column("text").to_pylist()):
                ids = np.append(encoding.encode_to_numpy(text or "", allowed_special="all"), np.uint32(0)).astype(np.uint32, copy=False)
                whole = len(ids) // window * window
                for at in range(0, whole, window):
                    out.append((at, window, crc(ids[at : at + window]), len(ids), 0, None))
                rest = ids[whole:]
                if len(rest):
                    pairs = rest.astype(np.uint64)
                    pairs = mixed((pairs[:-1] << np.uint64(32) | pairs[1:]) if len(rest) > 1 else pairs)
                    out.append((whole, len(rest), 0, len(ids), int(pairs.min() >> np.uint64(1)), rest.astype("<u4").tobytes()))
                row += [k] * (len(out) - len(row))
            columns = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([block.column("doc_id").take(pa.array(row, pa.int64())), *columns], names=["doc_id", "start", "length", "crc", "doc_tokens", "near", "ids"])

    return run


class Shard:
    """Inverted index over the rests of one shard; used ones drop out."""

    def __init__(self, rests: list[np.ndarray]) -> None:
        n = len(rests)
        sizes = np.array([len(r) for r in rests])
        term, times = np.unique(np.repeat(np.arange(n, dtype=np.uint64), sizes) << np.uint64(32) | np.concatenate(rests).astype(np.uint64), return_counts=True)
        doc, term = (term >> np.uint64(32)).astype(np.int64), (term & np.uint64(0xFFFFFFFF)).astype(np.int64)
        order = np.argsort(term, kind="stable")
        self.terms, self.begin, df = np.unique(term[order], return_index=True, return_counts=True)
        self.size, self.doc = df, doc[order]
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        tf = times[order]
        self.weight = np.repeat(idf, df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[self.doc] / sizes.mean()))
        self.n, self.free = n, np.ones(n, bool)

    def neighbours(self, ids: np.ndarray) -> np.ndarray:
        """All unused rests, best first; ties and rests without a common term in order."""
        own = np.unique(ids)
        at = np.searchsorted(self.terms, own)
        inside = at < len(self.terms)
        at, own = at[inside], own[inside]
        at = at[self.terms[at] == own]
        size = self.size[at]
        where = np.repeat(self.begin[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
        score = np.bincount(self.doc[where], weights=self.weight[where], minlength=self.n)
        order = np.argsort(-score, kind="stable")
        return order[self.free[order]]


def _pack(window: int, shard_size: int):
    """Arrow task over sorted rests; the open window is carried from shard to shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 34
        sequence, filled = 0, 0
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        seed = np.zeros(0, np.uint32)

        def rows(found: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], kind if i == 0 else pa.int64()) for i in range(7)], names=names)

        def shards() -> Iterator[list[dict]]:
            held: list[dict] = []
            for batch in batches:
                for piece in range(0, batch.num_rows, shard_size):
                    held += batch.slice(piece, shard_size).to_pylist()
                    while len(held) >= shard_size:
                        yield held[:shard_size]
                        held = held[shard_size:]
            if held:
                yield held

        kind = None
        for given in shards():
            kind = kind or pa.infer_type([x["doc_id"] for x in given])
            kind = pa.int64() if kind == pa.null() else kind
            found: list[tuple] = []
            for x in (x for x in given if x["ids"] is None):
                found.append((x["doc_id"], x["start"], x["length"], x["crc"], x["doc_tokens"], base + sequence, 0))
                sequence += 1
            # The open window keeps its number; full windows never take it, since it is drawn when it opens.
            rests = [x for x in given if x["ids"] is not None]
            if rests:
                ids = [np.frombuffer(x["ids"], "<u4") for x in rests]
                index, left = Shard(ids), len(rests)
                queue: list[int] = []
                while left:
                    if not filled:
                        open_id, sequence = base + sequence, sequence + 1
                        first = int(np.argmax(index.free))
                        seed, queue = ids[first], [first]
                    elif not queue:
                        queue = index.neighbours(seed).tolist()
                    k = queue.pop(0)
                    if not index.free[k]:
                        continue
                    index.free[k] = False
                    left -= 1
                    at = 0
                    while at < len(ids[k]):
                        if not filled and at:
                            # What the window could not take opens the next one and asks for its neighbours.
                            open_id, sequence = base + sequence, sequence + 1
                            seed, queue = ids[k], []
                        take = min(window - filled, len(ids[k]) - at)
                        found.append((rests[k]["doc_id"], rests[k]["start"] + at, take, crc(ids[k][at : at + take]), rests[k]["doc_tokens"], open_id, filled))
                        at += take
                        filled = (filled + take) % window
            if found:
                yield rows(found, kind)

    return run


def pack(docs: DataFrame, path: str, pattern: str, window: int = WINDOW, shard_size: int = SHARD, special: Mapping[str, int] | None = None) -> DataFrame:
    """Pieces in sequences of ``window`` tokens: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``path`` is a rank file, ``special`` names the ids of special tokens, whose text is one id wherever it stands; a document is its ids and then id 0, so a null or empty text is one
    token. Each id lies in one piece. Only the last sequence of a task can be short. Repeated
    rows and null ids are packed like others.
    """
    given = docs.select("doc_id", "text")
    kind = given.schema["doc_id"].dataType.simpleString()
    cut = written(given.mapInArrow(_cut(path, pattern, window, special or {}), f"doc_id {kind}, start long, length long, crc long, doc_tokens long, near long, ids binary"), "windows")
    near = cut.repartitionByRange("near", "doc_id", "start").sortWithinPartitions("near", "doc_id", "start")
    return near.mapInArrow(_pack(window, shard_size), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
