"""Near-duplicates by one-permutation MinHash with optimal densification and star-shaped candidates.

Texts with equal shingle sets count as one node. A node's shingles fall into bins, each bin keeps its
smallest hash, empty bins borrow from a bin chosen by hash; rows of bins make bands. In each bucket
one node is the centre of a star of candidate pairs, which are confirmed on full
sets. Buckets that still hold several components get more stars, with centres from outside the largest
component and without the pairs that a bound on the common part rules out, until no pair across
components is left to look at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetskein.llm.graph import components
from fleetskein.llm.words import blocks, mixed, row_ids, runs, signed, words
from fleetskein.session import discard, passing, written

BINS, ROWS = 128, 4
#: 64-bit words of the bitmap that bounds what two sets have in common.
BITMAP = 16


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct shingles as (row, hash), ordered; a text of fewer words is one shingle, without words none."""
    w = words(texts)
    n, first = w.per_row(), np.searchsorted(w.row, np.arange(w.rows))
    whole = np.flatnonzero((n > 0) & (n < size))
    start = np.flatnonzero(np.arange(len(w.hash)) + size <= (first + n)[w.row]) if len(w.hash) else np.zeros(0, int)
    row, h = [w.row[start]], [runs(w.hash, size)[start]]
    for k in range(1, size):
        at = whole[n[whole] == k]
        row.append(at)
        h.append(runs(w.hash, k)[first[at]] if len(at) else np.zeros(0, np.uint64))
    row, h = np.concatenate(row), np.concatenate(h)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new], w.rows


def set_keys(row: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size of each row's set and two sums that identify it."""
    end = np.searchsorted(row, np.arange(rows + 1))
    sums = []
    for values in (mixed(h ^ np.uint64(0xA5A5A5A5DEADBEEF)), mixed(h * np.uint64(0x9FB21C651E98DF25))):
        prefix = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(values, dtype=np.uint64, out=prefix[1:])
        sums.append(signed(prefix[end[1:]] - prefix[end[:-1]]))
    return np.diff(end).astype(np.int64), *sums


def donors(bins: int) -> np.ndarray:
    """For every bin the order in which it asks the others when it is empty."""
    keys = mixed(np.arange(bins * bins, dtype=np.uint64) + np.uint64(0x51ED2701)).reshape(bins, bins)
    return np.argsort(keys, axis=1)


def signatures(row: np.ndarray, h: np.ndarray, rows: int, bins: int = BINS) -> np.ndarray:
    """rows x bins: the smallest hash of each bin, densified; rows without a shingle stay 0."""
    out, filled = np.zeros((rows, bins), np.uint64), np.zeros((rows, bins), bool)
    shift = np.uint64(64 - int(bins).bit_length() + 1)
    bin_ = (h >> shift).astype(np.int64)
    first = np.ones(len(h), bool)  # hashes ascend within a row, so the first of a bin is its minimum
    first[1:] = (row[1:] != row[:-1]) | (bin_[1:] != bin_[:-1])
    out[row[first], bin_[first]] = h[first]
    filled[row[first], bin_[first]] = True
    r, b = np.nonzero(~filled & filled.any(axis=1, keepdims=True))
    ask = donors(bins)
    for some in np.array_split(np.arange(len(r)), 1 + len(r) // 50_000):
        rr, order = r[some], ask[b[some]]
        chosen = order[np.arange(len(some)), filled[rr[:, None], order].argmax(axis=1)]
        out[rr, b[some]] = out[rr, chosen]
    return out


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One hash for every ``rows`` bins, distinct between bands."""
    n, bins = signature.shape
    parts = signature.reshape(n, bins // rows, rows)
    h = np.tile(np.arange(bins // rows, dtype=np.uint64) + np.uint64(1), (n, 1))
    for k in range(rows):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return h


def bitmaps(row: np.ndarray, h: np.ndarray, rows: int, size: int = BITMAP) -> np.ndarray:
    """rows x size words; a set's shingles set the bits that their hashes name."""
    bit = np.unique(row.astype(np.uint64) * np.uint64(64 * size) + ((h >> np.uint64(16)) % np.uint64(64 * size)))
    out = np.zeros(rows * size, np.uint64)
    np.add.at(out, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out.reshape(rows, size)


def _features(size: int, bins: int, rows_in_band: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        done, partition = 0, TaskContext.get().partitionId()
        for block in blocks(batches):
            row, h, n = shingle_sets(block.column("text"), size)
            count, s1, s2 = set_keys(row, h, n)
            flat = signed(bands(signatures(row, h, n, bins), rows_in_band).reshape(-1))
            per = bins // rows_in_band
            offsets = np.arange(n + 1, dtype=np.int32) * per
            yield pa.RecordBatch.from_arrays(
                [pa.array(row_ids(partition, done, n)), block.column("doc_id"), pa.array(count), pa.array(s1), pa.array(s2), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                names=["rid", "doc_id", "n_shingles", "s1", "s2", "bands"],
            )
            done += n

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            row, h, n = shingle_sets(block.column("text"), size)
            count, s1, s2 = set_keys(row, h, n)
            offsets = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(count), pa.array(s1), pa.array(s2), pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(h))),
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BITMAP), pa.array(signed(bitmaps(row, h, n).reshape(-1)))),
                ],
                names=["n_shingles", "s1", "s2", "shingles", "bits"],
            )

    return run


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with the sizes of their sets' intersection and union."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    both = pairs.join(right, "b").join(left, "a").select("a", "b", common.alias("common"), (F.size("sa") + F.size("sb")).alias("sum"))
    return both.select("a", "b", "common", (F.col("sum") - F.col("common")).alias("union"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bins: int = BINS, rows: int = ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    Links: texts whose sets of ``shingle``-word shingles (A-Z lower-cased; fewer words: the whole sequence)
    have a Jaccard similarity of ``percent`` / 100 or more, confirmed on the full sets. component_id is
    the smallest doc_id reachable, kept says that it is the row's own. Null, empty and blank texts have
    no shingle, link with nothing and are kept. Rows that repeat a doc_id each give a row; a null doc_id
    is never a component id unless all ids of the component are null, and such rows are kept.
    Extra columns are not read. A pair of similarity s shares no bucket with probability
    (1 - s^rows)^(bins / rows), 5e-8 at 0.8 with the given parameters.
    """
    given = docs.select("doc_id", "text")
    kind = given.schema["doc_id"].dataType.simpleString()
    features = written(
        given.mapInArrow(_features(shingle, bins, rows), f"rid long, doc_id {kind}, n_shingles long, s1 long, s2 long, bands array<long>"), "features"
    )
    key = ["n_shingles", "s1", "s2"]
    with passing():
        # One node per distinct set: copies are folded before anything is joined.
        nodes = written(
            features.where("n_shingles > 0").groupBy(*key).agg(F.min("rid").alias("node"), F.min("doc_id").alias("least"), F.first("bands").alias("bands")), "nodes"
        )
        entries = nodes.select(F.explode("bands").alias("bucket"), "node", F.col("n_shingles").alias("n"))
        shared = entries.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
        entries = written(entries.join(shared, "bucket"), "entries")
        # The centre of a bucket is its node that shares buckets most, the likely original of a family.
        degree = entries.groupBy("node").agg(F.sum("members").alias("degree"))
        centres = entries.join(degree, "node").groupBy("bucket").agg(F.max_by("node", F.struct("degree", -F.col("node"))).alias("centre"))

        needed = written(nodes.join(entries.select("node").distinct(), "node", "left_semi").select("node", "least", *key), "needed")
        # Written by itself, so that the size of the ids alone decides how the texts are found.
        asked = written(needed.select(F.col("least").alias("doc_id")).distinct(), "asked")
        texts = given.join(asked, "doc_id", "left_semi").unionByName(given.where("doc_id IS NULL"))
        found = texts.mapInArrow(_sets(shingle), "n_shingles long, s1 long, s2 long, shingles array<long>, bits array<long>")
        sets = written(needed.join(found, key).dropDuplicates(key).select("node", "shingles", "bits"), "sets")

        starred = written(entries.join(centres, "bucket").select("bucket", "node", "n", "centre"), "starred")
        stars = starred.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
        stars = written(compared(stars, sets), "stars")
        near = F.col("common") * 100 >= F.col("union") * percent
        linked = components(stars.where(near))
        # ``free``: shingles beyond the set's bits; two sets have no more in common than the smaller of it and their common bits.
        words_ = [F.col("bits")[k].alias(f"w{k}") for k in range(BITMAP)]
        free = F.col("n") - sum((F.bit_count(F.col("bits")[k]) for k in range(BITMAP)), F.lit(0))
        outside, left, high = F.col("component") != F.col("main"), None, 8
        while True:
            # Buckets whose nodes lie in more than one component; components only grow, so no bucket comes back.
            part = (starred.select("bucket", "node", "n") if left is None else left.drop("component", "wait")).join(linked, "node", "left")
            part = part.withColumn("component", F.coalesce("component", "node"))
            per = part.groupBy("bucket", "component").agg(F.count("*").alias("size"))
            several = per.groupBy("bucket").agg(F.max_by("component", F.struct("size", "component")).alias("main"), F.sum("size").alias("total"), F.max("size").alias("most"))
            part = part.join(several.where("total > most"), "bucket")
            if left is None:
                # New centres come from outside the main component, in the order of a hash, in rounds of growing share. Shares and
                # what was a centre (``done``) are kept: the main component grows and may be another one in a later round.
                share = (F.xxhash64("node") / F.lit(2.0**64) + 0.5) * (F.col("total") - F.col("most"))
                part = part.withColumn("share", share).withColumn("done", F.lit(False)).join(sets.select("node", "bits"), "node")
                part = part.select("*", free.alias("free"), *words_).drop("bits")
            else:
                part = part.withColumn("done", F.col("done") | F.col("turn")).drop("turn")
            wait = outside & ~F.col("done")
            part = part.withColumn("wait", wait).withColumn("turn", wait & (F.col("share") < high)).drop("main", "total", "most")
            last, left = left, written(part, "left")
            if last is not None:
                discard(last)
            if left.where("wait").isEmpty():
                break
            centre = left.where("turn").select("bucket", *[F.col(c).alias(f"c_{c}") for c in left.columns if c != "bucket"])
            common = sum((F.bit_count(F.col(f"w{k}").bitwiseAND(F.col(f"c_w{k}"))) for k in range(BITMAP)), F.least("free", "c_free"))
            may = (
                (F.col("component") != F.col("c_component"))
                & ~F.col("done")
                & (~F.col("turn") | (F.col("node") > F.col("c_node")))
                & (common * (100 + percent) >= (F.col("n") + F.col("c_n")) * percent)
            )
            pairs = left.join(centre, "bucket").where(may).select(F.least("c_node", "node").alias("a"), F.greatest("c_node", "node").alias("b")).distinct()
            new = written(compared(pairs, sets).where(near).select("a", "b"), "links")
            if not new.isEmpty():
                linked = components(new.unionByName(linked.select(F.col("node").alias("a"), F.col("component").alias("b"))))
            high *= 8

        ids = nodes.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
        least = ids.groupBy("component").agg(F.min("least").alias("component_id"))
        classes = written(ids.join(least, "component").select(*key, "component_id"), "classes", keep=True)

    out = features.select("doc_id", *key).join(classes, key, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
