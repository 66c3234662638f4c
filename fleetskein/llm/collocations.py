"""Phrase collocations by Rabin-Karp fingerprints.

Texts are stored once as blocks of one language: distinct words, word numbers, pieces. Prefix polynomials over a block give
the fingerprint of every n-gram. A level ships one row per distinct n-gram of a block: fingerprint, pointer to its first
occurrence there, count. The shuffle adds the counts up by fingerprint and sends the pointers of frequent
ones back to their blocks. Words come first, then pairs of frequent words, then longer runs of frequent pairs: a phrase
is not more frequent than its parts, so nothing frequent is left out. At the end the blocks read what their pointers
stand for, and counts are taken anew by the words themselves; fingerprints that collide
only add candidates, which that count removes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetskein.llm.words import blocks, byte_tables, mixed, powers, raw, row_ids, signed, span_hash
from fleetskein.session import passing, written

#: Bytes of text that are stored as one block of each language.
BLOCK = 6 << 20
#: Rows of one Arrow batch that a task gives back.
ROWS = 1 << 16
#: What ends a piece, and what separates words in it.
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
BLANKS = b" \t"


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words in order, A-Z lower-cased (dictionary of bytes), and the number of words of each piece that has any."""
    _, lower, *_ = byte_tables()
    body, offsets = raw(texts)
    body = lower[body]
    breaks, apart = np.zeros(256, bool), np.zeros(256, bool)
    breaks[list(BREAKS)] = True
    apart[list(BREAKS + BLANKS)] = True
    inside, broken = ~apart[body], breaks[body]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[heads] |= inside[heads]
    start = np.flatnonzero(first)
    # Words of one piece have as many breaks before them and lie in the same text.
    piece = np.cumsum(broken)[start] + np.searchsorted(offsets, start, "right")
    _, per = np.unique(piece, return_counts=True)
    kept = body[inside]
    length = np.diff(np.concatenate([np.cumsum(inside)[start] - 1, [len(kept)]])) if len(start) else np.zeros(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(kept.tobytes())])
    return words.dictionary_encode(), per


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow task: texts -> blocks. Words hold no line feed, so a line feed separates them."""
    from pyspark import TaskContext

    done, partition = 0, TaskContext.get().partitionId()
    for block in blocks(batches, limit=BLOCK):
        for lang in pc.unique(block.column("lang")):
            words, per = cut(block.column("text").filter(pc.equal(block.column("lang"), lang)))
            if not len(per):
                continue
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row_ids(partition, done, 1)), pa.array([lang], pa.string()), pa.array([len(words)], pa.int64()),
                    pa.array([b"\n".join(words.dictionary.to_pylist())], pa.binary()),
                    pa.array([words.indices.to_numpy().astype("<u4").tobytes()], pa.binary()), pa.array([per.astype("<u4").tobytes()], pa.binary()),
                ],
                names=["block", "lang", "n", "words", "codes", "pieces"],
            )
            done += 1


class Block:
    """A stored block: ``code`` per position, ``end`` of the position's piece, the words."""

    def __init__(self, row: dict) -> None:
        self.block, self.lang, self.words = row["block"], row["lang"], row["words"]
        self.code = np.frombuffer(row["codes"], "<u4").astype(np.int64)
        per = np.frombuffer(row["pieces"], "<u4").astype(np.int64)
        self.end = np.repeat(np.cumsum(per), per)
        self.body = np.frombuffer(self.words, np.uint8)
        borders = np.flatnonzero(self.body == 10)
        self.starts, self.stops = np.concatenate([[0], borders + 1]), np.append(borders, len(self.body))
        self.kinds = len(self.starts)

    def fingerprints(self, at: np.ndarray, n: int) -> np.ndarray:
        """Of the n-grams at these positions: differences of one prefix polynomial, moved to a common place."""
        _, _, _, base, inverse = byte_tables()
        value = mixed(span_hash(self.body, self.starts, self.stops))[self.code]
        prefix = np.zeros(len(value) + 1, np.uint64)
        np.cumsum(value * powers(base, len(value)), dtype=np.uint64, out=prefix[1:])
        lang = np.frombuffer(self.lang.encode(), np.uint8)
        own = span_hash(lang, np.array([0]), np.array([len(lang)]))[0]
        return mixed((prefix[at + n] - prefix[at]) * powers(inverse, len(value) + 1)[at] ^ mixed(np.full(len(at), n, np.uint64) + own))

    def grams(self, upto: int, words: np.ndarray | None, pairs: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For n = 1, 2, ...: n, first position and count of each distinct n-gram, and per position its number, or -1.

        Pairs are made of words that occur at the positions ``words`` (None: of all), longer n-grams of pairs at ``pairs``; without these there are no longer ones.
        """
        yield 1, *_distinct(self.code), self.code
        number = self._longer(self.code, _only(self.code, words), 2)
        yield 2, *_distinct(number), number
        if pairs is not None:
            pair = number = _only(number, pairs)
            for n in range(3, upto + 1):
                number = self._longer(number, pair, n)
                yield n, *_distinct(number), number

    def _longer(self, number: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
        """Numbers of the n-grams whose (n - 1)-gram has a number and whose last word (n = 2) or pair is in ``last``."""
        step = 1 if n == 2 else n - 2
        begin = last if n == 2 else number
        at = np.flatnonzero((np.arange(len(self.code)) + n <= self.end) & (begin >= 0))
        at = at[last[at + step] >= 0]
        _, which = np.unique(number[at] * np.int64(self.kinds) + self.code[at + n - 1], return_inverse=True)
        out = np.full(len(self.code), -1, np.int64)
        out[at] = which
        return out

    def phrases(self, at: np.ndarray, n: int) -> list[bytes]:
        return [b" ".join(self.words[self.starts[c] : self.stops[c]] for c in self.code[p : p + n].tolist()) for p in at.tolist()]


def _distinct(number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First position and count of every number, by number."""
    at = np.flatnonzero(number >= 0)
    count = np.bincount(number[at])
    first = np.zeros(len(count), np.int64)
    first[number[at[::-1]]] = at[::-1]
    return first, count


def _only(number: np.ndarray, positions: np.ndarray | None) -> np.ndarray:
    """``number`` where it occurs at one of the positions, else -1."""
    if positions is None:
        return number
    kept = np.zeros(int(number.max(initial=-1)) + 2, bool)
    kept[number[positions]] = True
    kept[-1] = False
    return np.where(kept[number], number, -1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, dict[int, np.ndarray]]]:
    for batch in batches:
        lists = [c for c in batch.schema.names if c.startswith("k")]
        for k in range(batch.num_rows):
            one = batch.slice(k, 1)
            kept = {int(c[1:]): one.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in lists}
            yield Block(one.select([c for c in batch.schema.names if c not in lists]).to_pylist()[0]), kept


def _counted(sizes: range):
    """Arrow task: blocks -> one row per distinct n-gram of the given sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, kept in _blocks(batches):
            for n, first, count, _ in block.grams(sizes[-1], kept.get(1), kept.get(2)):
                if n in sizes and len(first):
                    fp = signed(block.fingerprints(first, n))
                    for a in range(0, len(first), ROWS):
                        part = first[a : a + ROWS]
                        columns = [fp[a : a + ROWS], np.full(len(part), block.block), np.full(len(part), n, np.int32), part.astype(np.int32), count[a : a + ROWS].astype(np.int64)]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["fp", "block", "size", "pointer", "count"])

    return run


def _read(upto: int):
    """Arrow task: blocks with all their pointers -> frequent phrases, as words, with the block's counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, kept in _blocks(batches):
            for n, first, count, number in block.grams(upto, None, kept.get(2)):
                own = np.unique(number[kept[n]])
                for a in range(0, len(own), ROWS):
                    ids = own[a : a + ROWS]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([block.lang] * len(ids), pa.string()), pa.array(block.phrases(first[ids], n), pa.binary()).cast(pa.string()),
                            pa.array(np.full(len(ids), n, np.int32)), pa.array(count[ids].astype(np.int64)),
                        ],
                        names=["lang", "phrase", "size", "count"],
                    )

    return run


def _frequent(rows: DataFrame, least: int) -> DataFrame:
    """Pointers whose fingerprint is frequent. A fingerprint has at most one row in each block, so no group is large."""
    total = F.sum("count").over(Window.partitionBy("fp"))
    return rows.withColumn("total", total).where(F.col("total") >= least).select("block", "size", "pointer")


def _with_pointers(store: DataFrame, pointers: DataFrame, sizes: range) -> DataFrame:
    """Blocks with lists of pointers; bounded by the block's own n-grams."""
    lists = pointers.groupBy("block").agg(*[F.collect_list(F.when(F.col("size") == n, F.col("pointer"))).alias(f"k{n}") for n in sizes])
    return store.drop("n").join(lists, "block")


def frequent_phrases(store: DataFrame, least: int, upto: int) -> DataFrame:
    """``lang, phrase, size, f`` of all words and phrases of up to ``upto`` words that occur ``least`` times in their language."""
    shape = "fp long, block long, size int, pointer int, count long"
    found = []
    for sizes in [range(1, 2), range(2, 3), range(3, upto + 1)]:
        if len(sizes):
            given = store.drop("n") if not found else _with_pointers(store, found[-1], range(sizes[0] - 1, sizes[0]))
            found.append(written(_frequent(given.mapInArrow(_counted(sizes), shape), least), f"pointers{sizes[0]}"))
    pointers = found[0]
    for more in found[1:]:
        pointers = pointers.unionByName(more)
    read = _with_pointers(store, pointers, range(1, upto + 1)).mapInArrow(_read(upto), "lang string, phrase string, size int, count long")
    return read.groupBy("lang", "phrase", "size").agg(F.sum("count").alias("f")).where(F.col("f") >= least)


def collocations(docs: DataFrame, least: int = 30, upto: int = 4, cover: int = 80, top: int = 2000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best ``top`` phrases of 2 to ``upto`` words in each language.

    Words: A-Z lower-cased, separated by blanks and tabs within pieces, which end at marks and line breaks; a phrase lies
    in one piece. ``a``, ``l``, ``r``: occurrences of the phrase, of its part before the cut and of its rest; the score is
    2000000 a / (l + r), floored, of the cut where that is lowest, the first such. A phrase goes when it lies in a longer one that
    occurs ``cover`` percent as often. Ties are ranked by a, then by the phrase's bytes. Null text is empty, a null language is
    ``und``; doc_id and other columns are not read, so repeated rows count as often as they stand. Without frequent phrases the
    result is empty. ``n``: all word occurrences of the language.
    """
    given = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    with passing():
        store = written(given.mapInArrow(_store, "block long, lang string, n long, words binary, codes binary, pieces binary"), "store")
        size = written(store.groupBy("lang").agg(F.sum("n").alias("n")), "size", keep=True)
        known = written(frequent_phrases(store, least, upto), "phrases", keep=True)
    candidates = known.where("size > 1")
    word = F.split("phrase", " ")
    joined = lambda a, b: F.array_join(F.slice(word, a, b), " ")
    cuts = candidates.select("lang", "phrase", "size", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": joined(F.lit(1), F.col("k")), "right": joined(F.col("k") + 1, F.col("size") - F.col("k"))})
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    exact = F.col("a").cast("decimal(25,0)") * F.lit(2_000_000).cast("decimal(8,0)")
    cuts = cuts.withColumn("score", F.floor(exact / (F.col("l") + F.col("r")).cast("decimal(25,0)")).cast("long"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    # Every shorter phrase inside a candidate, with the count of the most frequent candidate around it.
    part = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda at: joined(at, m)))))
    around = candidates.where("size > 2").select("lang", part.alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    whole = scored.join(around, ["lang", "phrase"], "left").where("longer IS NULL OR longer * 100 < a * %d" % cover)
    order = Window.partitionBy("lang").orderBy(F.col("best.score").desc(), F.col("a").desc(), "phrase")
    ranked = whole.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(size, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
worded AS (SELECT row_number() OVER () AS piece, lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
words AS (SELECT lang, piece, unnest(w) AS a, unnest(range(len(w))) AS pos FROM worded WHERE len(w) > 0),
runs AS (SELECT lang, a, lead(a) OVER p AS b, lead(a, 2) OVER p AS c, lead(a, 3) OVER p AS d FROM words WINDOW p AS (PARTITION BY piece ORDER BY pos)),
grams AS (
  SELECT lang, 1 AS size, a AS phrase FROM runs
  UNION ALL SELECT lang, 2, a || ' ' || b FROM runs WHERE b IS NOT NULL
  UNION ALL SELECT lang, 3, a || ' ' || b || ' ' || c FROM runs WHERE c IS NOT NULL
  UNION ALL SELECT lang, 4, a || ' ' || b || ' ' || c || ' ' || d FROM runs WHERE d IS NOT NULL),
sizes AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
known AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM known WHERE size > 1),
cuts AS (
  SELECT c.lang, c.phrase, c.size, c.f AS a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.f // (x.f + y.f))::BIGINT AS score
  FROM candidates c, (VALUES (1), (2), (3)) s(k), known x, known y
  WHERE k < c.size AND x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ')
    AND y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1 : c.size], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (
  SELECT lang, array_to_string(w[pos : pos + m - 1], ' ') AS phrase, max(f) AS longer
  FROM (SELECT lang, w, f, m, unnest(range(1, size - m + 2)) AS pos FROM candidates, (VALUES (2), (3)) s(m) WHERE m < size) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inner_parts p USING (lang, phrase) WHERE p.longer IS NULL OR 100 * p.longer < 80 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""
