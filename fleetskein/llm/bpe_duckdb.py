"""Byte-level BPE over rank files: the merges run as a DuckDB recursive query in each task.

A text is cut by the tokenizer's pattern. Pieces a task has not seen go to DuckDB as rows
(piece, position, token); each round of the recursive query joins neighbouring rows
with the merge table and contracts every piece's minimum-rank pair, leftmost first,
until no piece has a pair left. Joined with the vocabulary in their order, token rows turn back into bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetskein.llm.words import blocks

#: Bytes of pieces kept in a task's memory; when they are reached, the table starts anew.
MEMO_BYTES = 160 << 20

#: One round: neighbouring tokens join the merge table, every piece's lowest rank (leftmost on a tie)
#: is contracted, and positions behind it move up. Pieces without a pair have reached their end.
ENCODE = """
WITH RECURSIVE state(round, piece, pos, tok) AS (
  SELECT 0, piece, pos, tok FROM start
  UNION ALL
  SELECT s.round + 1, s.piece, CASE WHEN s.pos > b.at THEN s.pos - 1 ELSE s.pos END,
         CASE WHEN s.pos = b.at THEN b.merged ELSE s.tok END
  FROM state s JOIN (
    SELECT piece, CAST(min(key) & 4294967295 AS INTEGER) AS at, CAST(min(key) >> 32 AS INTEGER) AS merged
    FROM (
      SELECT l.piece, (CAST(m.merged AS BIGINT) << 32) + l.pos AS key
      FROM state l JOIN state r ON r.piece = l.piece AND r.pos = l.pos + 1 JOIN merges m ON m.l = l.tok AND m.r = r.tok
    )
    GROUP BY piece
  ) b ON b.piece = s.piece
  WHERE s.pos <> b.at + 1
)
"""
#: The same for long pieces: a round contracts all pairs of the lowest rank, from left to right without
#: overlap (in a run of overlapping pairs, every second one). This equals one merge at a time as long as
#: the new token can't take part in a pair of lower rank; tokens that can are marked ``alone``, and only
#: their leftmost pair is contracted in a round.
ENCODE_LONG = """
WITH RECURSIVE state(round, piece, pos, tok) AS (
  SELECT 0, piece, pos, tok FROM start
  UNION ALL
  SELECT round + 1, piece, pos, CASE WHEN taken THEN low ELSE tok END
  FROM (
    SELECT *, lag(taken, 1, false) OVER (PARTITION BY piece ORDER BY pos) AS eaten
    FROM (
      SELECT *, hit AND CASE WHEN alone THEN row_number() OVER (PARTITION BY piece, hit ORDER BY pos) = 1
                             ELSE row_number() OVER (PARTITION BY piece, hit, run ORDER BY pos) % 2 = 1 END AS taken
      FROM (
        SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY piece ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run
        FROM (
          SELECT *, coalesce(merged = low, false) AS hit
          FROM (
            SELECT p.*, m.merged, m.alone, min(m.merged) OVER (PARTITION BY p.piece) AS low
            FROM (SELECT round, piece, pos, tok, lead(tok) OVER (PARTITION BY piece ORDER BY pos) AS nxt FROM state) p
            LEFT JOIN merges m ON m.l = p.tok AND m.r = p.nxt
          )
          WHERE low IS NOT NULL
        )
      )
    )
  )
  WHERE NOT eaten
)
"""
LAST_ROUND = """
SELECT s.piece, s.pos, s.tok
FROM state s JOIN (SELECT piece, max(round) AS round FROM state GROUP BY piece) f ON s.piece = f.piece AND s.round = f.round
"""
#: Rows of a piece are joined as Arrow lists behind the query, which is far cheaper than ordered string aggregates.
DECODE = "SELECT piece, name, bytes FROM done JOIN vocabulary USING (tok) ORDER BY piece, pos"
#: Pieces of more bytes than this take the query for long pieces.
LONG_PIECE = 256


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PartitionCodec:
    """One in-process DuckDB with merge table and vocabulary, for the life of a task."""

    def __init__(self, path: str) -> None:
        import duckdb

        self.ranks = ranks(path)
        rank = self.ranks.get
        merges = [(a, b, r) for t, r in self.ranks.items() for i in range(1, len(t)) if (a := rank(t[:i])) is not None and (b := rank(t[i:])) is not None]
        alone = {part for a, b, r in merges for part in (a, b) if r <= part}
        self.db = duckdb.connect(config={"threads": "1", "memory_limit": "250MB"})
        left, right, merged = (pa.array(c, pa.int32()) for c in zip(*merges, strict=True))
        self.store("merges", pa.table({"l": left, "r": right, "merged": merged, "alone": [r in alone for _, _, r in merges]}))
        self.store("vocabulary", pa.table({"tok": pa.array(self.ranks.values(), pa.int32()), "name": list(map(str, self.ranks.values())), "bytes": list(self.ranks)}))
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.known: dict[str, tuple[str, int, bytes]] = {"": ("", 0, b"")}
        self.held = 0

    def store(self, name: str, table: pa.Table) -> None:
        self.db.register("given", table)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def learn(self, pieces: list[str], query: str = ENCODE) -> None:
        """Encode and decode new pieces; a piece that is a token itself is that token."""
        data = [p.encode() for p in pieces]
        whole = np.array([self.ranks.get(d, -1) for d in data], np.int32)
        sizes = np.array([1 if w >= 0 else len(d) for d, w in zip(data, whole, strict=True)], np.int64)
        body = np.frombuffer(b"".join(b"\0" if w >= 0 else d for d, w in zip(data, whole, strict=True)), np.uint8)
        piece = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
        pos = (np.arange(len(body)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        tok = np.where(whole[piece] >= 0, whole[piece], self.single[body])
        self.store("start", pa.table({"piece": piece, "pos": pos, "tok": tok}))
        self.db.execute(f"CREATE OR REPLACE TABLE done AS {query} {LAST_ROUND}")
        found = self.db.sql(DECODE).to_arrow_table()
        n = np.bincount(found.column("piece").to_numpy(), minlength=len(pieces))
        ends = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
        ids, code = (
            pc.binary_join(pa.ListArray.from_arrays(ends, found.column(c).combine_chunks()), glue).to_numpy(zero_copy_only=False).tolist()
            for c, glue in (("name", ","), ("bytes", b""))
        )
        self.known.update(zip(pieces, zip(ids, n.tolist(), code, strict=True), strict=True))
        self.held += 300 * len(pieces) + 12 * len(pos)

    def encode(self, texts: list[list[str]], most: int = 50_000) -> None:
        """Make sure that every piece of the texts is known."""
        if self.held > MEMO_BYTES:
            self.known, self.held = {"": ("", 0, b"")}, 0
        fresh = list(set(chain.from_iterable(texts)).difference(self.known))
        for p in (p for p in fresh if len(p) * 4 > LONG_PIECE):
            self.learn([p], ENCODE_LONG if len(p.encode()) > LONG_PIECE else ENCODE)
        fresh = [p for p in fresh if len(p) * 4 <= LONG_PIECE]
        for at in range(0, len(fresh), most):
            self.learn(fresh[at : at + most])


def codec_rows(path: str, pattern: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        cut = regex.compile(pattern)
        codec = None
        for block in blocks(batches, limit=4 << 20):
            codec = codec or PartitionCodec(path)
            texts = [cut.findall(t or "") for t in block.column("text").to_pylist()]
            codec.encode(texts)
            n, ids, back = [], [], []
            for pieces in texts:
                found = list(map(codec.known.__getitem__, pieces))
                n.append(sum(map(itemgetter(1), found)))
                ids.append(",".join(map(itemgetter(0), found)))
                back.append(b"".join(map(itemgetter(2), found)))
            columns = [block.column(c) for c in keep] + [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_tokens", "ids", "decoded"])

    return run


def encode_decode(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_tokens, ids, decoded``: token ids joined by commas, and the bytes they decode to.

    No special tokens. A null text counts as empty: no tokens, empty strings. Every input row
    gives one row. Other columns are not carried, so names can't clash.
    """
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(codec_rows(path, pattern, ["doc_id"]), f"doc_id {kind}, n_tokens long, ids string, decoded binary")


def digests(path: str, pattern: str, docs: DataFrame) -> DataFrame:
    """Hashes of ids and decoded bytes, taken from the operator's full output."""
    return encode_decode(docs, path, pattern).select(
        "doc_id", "n_tokens", F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def brute(texts: list[str], path: str, pattern: str) -> list[tuple[int, str, str]]:
    """The same by the tiktoken library, for tests."""
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})
    out = []
    for t in texts:
        ids = own.encode_ordinary(t)
        out.append((len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(own.decode_bytes(ids)).hexdigest()))
    return out
