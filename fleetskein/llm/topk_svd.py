"""Exact top-k by inner product: norm-sorted blocks, SVD-rotated partial sums, Cauchy-Schwarz bounds.

Vectors are laid out by descending length in blocks. Each query starts from its k-th best score among
the longest vectors. A block whose longest vector can't reach that is never joined with the query's
block; inside a joined block the leading rotated components plus the product of the residual
lengths bound every score, and only vectors above the bound are multiplied exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetskein.session import written

SCALE = 1024
#: Rows in a block of candidates and of queries; longest vectors for the first thresholds; leading components.
CANDIDATES, QUERIES, HEAD, LEADING = 4096, 512, 2048, 16
LEAST, MOST = -(2**63), 2**63 - 1


def scaled(vectors: list, width: int) -> np.ndarray:
    """floor(1024 x) per component as doubles, shorter vectors filled up with zeros."""
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return np.floor(out * SCALE)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products; held within 64 bits where a sum lies outside."""
    reach = max(np.abs(a).sum(axis=1).max(initial=0), 1) * max(np.abs(b).max(initial=0), 1)
    if reach < 2**53:
        return (a @ b.T).astype(np.int64)
    exact = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    return np.clip(exact(a) @ exact(b).T, LEAST, MOST).astype(np.int64)


def _laid_out(width: int, size: int):
    """Arrow task over sorted rows: blocks of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        done, partition = 0, TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                v = scaled(part.column("embedding").to_pylist(), width)
                ids = part.column("vec_id").to_numpy().astype("<i8")
                yield pa.RecordBatch.from_pylist(
                    [{"block": (partition << 34) + done, "longest": float(np.sqrt((v * v).sum(axis=1)).max(initial=0)), "ids": ids.tobytes(), "vectors": v.tobytes()}],
                    schema=pa.schema([("block", pa.int64()), ("longest", pa.float64()), ("ids", pa.binary()), ("vectors", pa.binary())]),
                )
                done += 1

    return run


def _squares(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for data in batch.column("vectors").to_pylist():
                v = np.frombuffer(data).reshape(-1, width)
                total += v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], names=["at", "sum"])

    return run


def rotation(blocks: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of all vectors, strongest first; width x width sums reach the driver."""
    sums = blocks.select("vectors").mapInArrow(_squares(width), "at long, sum double").groupBy("at").agg(F.sum("sum").alias("sum")).toArrow()
    square = np.zeros(width * width)
    square[sums.column("at").to_numpy()] = np.nan_to_num(sums.column("sum").to_numpy())
    square = square.reshape(width, width)
    # Only the directions matter, so any scale and any rounding of the sums will do.
    return np.linalg.eigh(square / max(np.abs(square).max(initial=0), 1e-300))[1][:, ::-1]


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    return np.lexsort((ids, -scores))[:k]


def _thresholds(width: int, k: int, head_ids: np.ndarray, head: np.ndarray):
    """Arrow task: query blocks with each query's k-th score among the longest vectors, and the least length that can matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("group", pa.int64()), ("need", pa.float64()), ("q_ids", pa.binary()), ("q_vectors", pa.binary()), ("floor", pa.binary())])
        for batch in batches:
            for row in batch.to_pylist():
                ids, v = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["vectors"]).reshape(-1, width)
                floor = np.full(len(ids), -np.inf)
                scores = products(v, head).astype(float)
                for q in range(len(ids)):
                    mine = np.sort(scores[q, head_ids != ids[q]])
                    if len(mine) >= k:
                        floor[q] = mine[-k]
                length = np.sqrt((v * v).sum(axis=1))
                with np.errstate(divide="ignore", invalid="ignore"):
                    need = np.where(floor > 0, floor / length, -np.inf).min(initial=np.inf)
                yield pa.RecordBatch.from_pylist([{"group": row["block"], "need": float(need) * (1 - 1e-9), "q_ids": row["ids"], "q_vectors": row["vectors"], "floor": floor.tobytes()}], schema=schema)

    return run


def _search(width: int, k: int, turn: np.ndarray, leading: int):
    """Arrow task: (query block, candidate block) -> each query's k best there that reach its threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                q_ids, q = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["q_vectors"]).reshape(-1, width)
                ids, c = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["vectors"]).reshape(-1, width)
                floor = np.frombuffer(row["floor"])
                lead, left = turn[:, :leading], turn[:, leading:]
                rest = lambda m: np.sqrt(((m @ left) ** 2).sum(axis=1))
                bound = (q @ lead) @ (c @ lead).T + np.outer(rest(q), rest(c))
                slack = 1e-6 * (1 + np.outer(np.sqrt((q * q).sum(axis=1)), np.sqrt((c * c).sum(axis=1))))
                may = (bound + slack >= floor[:, None]) | ~np.isfinite(bound)
                found: list[tuple[int, int, int]] = []
                for n in range(len(q_ids)):
                    near = np.flatnonzero(may[n] & (ids != q_ids[n]))
                    if len(near):
                        scores = products(q[n : n + 1], c[near])[0]
                        top = best(scores, ids[near], k)
                        found += [(int(q_ids[n]), int(ids[near[t]]), int(scores[t])) for t in top]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows whose vec_id is divisible by ``every``, against all other ids.

    Scores are integer products of floor(1024 x), ties go to the smaller vec_id; fewer than k candidates give fewer
    rows. Rows with a null id, a null vector, or null or non-finite components take no part; shorter vectors
    count as filled up with zeros. Equal query rows count once, and query rows of one id with different
    vectors share one ranking; as candidates every row counts. A product outside 64 bits is held at the border. Extra columns are not read.
    """
    good = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    given = given.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & good)
    width = max(given.agg(F.max(F.size("embedding"))).first()[0] or 0, 1)
    scaled_length = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.pow(F.floor(x * SCALE).cast("double"), 2))
    layout = "block long, longest double, ids binary, vectors binary"
    measured = given.withColumn("length", scaled_length)
    ordered = measured.repartitionByRange(F.desc("length"), F.col("vec_id")).sortWithinPartitions(F.desc("length"), "vec_id")
    blocks = written(ordered.select("vec_id", "embedding").mapInArrow(_laid_out(width, CANDIDATES), layout), "vectors")
    head = measured.orderBy(F.desc("length"), "vec_id").limit(HEAD).select("vec_id", "embedding").toArrow()
    head_ids, longest = head.column("vec_id").to_numpy().astype("<i8"), scaled(head.column("embedding").to_pylist(), width)

    asked = given.where(F.col("vec_id") % every == 0).distinct()
    queries = asked.repartitionByRange("vec_id").mapInArrow(_laid_out(width, QUERIES), layout)
    groups = written(queries.mapInArrow(_thresholds(width, k, head_ids, longest), "group long, need double, q_ids binary, q_vectors binary, floor binary"), "queries")
    # Which block meets which is settled on numbers alone, before any vector moves.
    index = Window.orderBy("group")
    numbered = groups.select("group", "need").withColumn("_g", F.row_number().over(index))
    n = groups.count()
    if not n:
        return given.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    meets = blocks.select("block", "longest", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("_g")).join(numbered, "_g").where("longest >= need").select("block", "group")
    pairs = meets.join(groups, "group").join(blocks, "block")
    turn = rotation(blocks, width)
    found = pairs.select("q_ids", "q_vectors", "floor", "ids", "vectors").mapInArrow(_search(width, k, turn, min(LEADING, width)), "query_id long, vec_id long, score long")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same question for DuckDB.
SQL = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM good q JOIN good c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""
