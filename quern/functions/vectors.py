"""Vector scores in double precision, with built-in array functions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.errors import EngineError

METRICS = ("dot", "cosine", "l2")
#: Vectors in a block of a search, and searched ones in a block of its queries.
BLOCK, QUERY_BLOCK = 4096, 256
_LAST = (1 << 63) - 1


def is_vector(v: Column) -> Column:
    """Not empty and all finite."""
    return (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def score(metric: str, query: Column, v: Column) -> Column:
    """Larger is nearer: dot product, cosine (0 with a zero vector), or negative squared distance."""
    if metric == "dot":
        return dot(query, v)
    if metric == "l2":
        return -_sum(F.zip_with(query, v, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))
    if metric == "cosine":
        norms = F.sqrt(dot(query, query)) * F.sqrt(dot(v, v))
        return F.when(norms == 0, F.lit(0.0)).otherwise(dot(query, v) / F.when(norms != 0, norms))
    raise EngineError("InvalidMetric", metric)


def top_k(table: DataFrame, vector: str, query: list[float], metric: str, k: int, order: str = "_row_seq") -> DataFrame:
    """The k rows with the highest scores, earlier rows first among equals; `score` and `rk` added.

    Null vectors don't take part. A vector of another dimension, an empty or a non-finite one
    fails the query. A bounded heap per task and one merge: nothing else is shuffled.
    """
    if k <= 0:
        raise EngineError("InvalidLimit", str(k))
    if not query or any(x != x or abs(x) == float("inf") for x in query):
        raise EngineError("InvalidVector", "the query")
    q, v = F.array(*[F.lit(float(x)) for x in query]), F.col(vector)
    ok = is_vector(v) & (F.size(v) == len(query))
    checked = F.when(ok, v).otherwise(F.raise_error(F.lit("InvalidVector: dimension or component")))
    scored = table.where(v.isNotNull()).withColumn("score", score(metric, q, checked))
    best = scored.orderBy(F.col("score").desc(), F.col(order).asc()).limit(k)
    return best.withColumn("rk", F.row_number().over(Window.orderBy(F.col("score").desc(), F.col(order).asc())).cast("long"))  # k rows


def _blocks(table: DataFrame, vector: str, order: str, rows: int, side: str) -> DataFrame:
    """Rows of up to `rows` vectors: ids and components as bytes. Null vectors don't take part; a null id is the last."""
    spark = table.sparkSession
    kept = table.where(F.col(vector).isNotNull()).select(F.coalesce(F.col(order).cast("long"), F.lit(_LAST)), F.col(vector).cast("array<double>"))
    parts = min(-(-max(kept.count(), 1) // rows), int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                ids, held = batch.column(0)[at : at + rows], batch.column(1)[at : at + rows]
                sizes = np.unique(np.diff(held.offsets.to_numpy()))
                flat = held.flatten()
                v = flat.to_numpy(zero_copy_only=False)
                if flat.null_count or len(sizes) != 1 or not sizes[0] or not np.isfinite(v).all():
                    raise ValueError("InvalidVector: dimension or component")
                columns = [ids.to_numpy().tobytes(), v.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], names=[f"{side}_ids", f"{side}_v"])

    return kept.repartition(parts).mapInArrow(run, f"{side}_ids binary, {side}_v binary")


def _in_turn(x: np.ndarray) -> np.ndarray:
    """Sums of rows, added from the left as _sum does, so that equal vectors have equal scores wherever they lie."""
    return np.add.accumulate(x, axis=1)[:, -1]


def nearest(q: np.ndarray, v: np.ndarray, ids: np.ndarray, metric: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of q, rows of v and scores of each q's k best, lower ids first among equals.

    A matrix product finds all that may be among the k; their scores are then summed in turn.
    """
    qq, vv, product = _in_turn(q * q), _in_turn(v * v), q @ v.T
    norms = np.sqrt(qq)[:, None] * np.sqrt(vv)[None, :]
    if metric == "dot":
        rough, slack = product, norms.max(1)
    elif metric == "l2":
        rough, slack = 2 * product - qq[:, None] - vv[None, :], qq + vv.max()
    else:
        rough, slack = np.divide(product, norms, out=np.zeros_like(product), where=norms != 0), np.ones(len(q))
    least = np.partition(rough, -k, axis=1)[:, -k] if len(v) > k else np.full(len(q), -np.inf)
    out = []
    for i in range(len(q)):
        at = np.flatnonzero(rough[i] >= least[i] - 1e-9 * slack[i])
        if metric == "l2":
            exact = -_in_turn((q[i] - v[at]) ** 2)
        else:
            exact = _in_turn(q[i] * v[at])
            if metric == "cosine":
                exact = np.divide(exact, norms[i, at], out=np.zeros(len(at)), where=norms[i, at] != 0)
        best = np.lexsort((ids[at], -exact))[:k]
        out.append((np.full(len(best), i), at[best], exact[best]))
    return tuple(np.concatenate(x) for x in zip(*out))


def search(table: DataFrame, queries: DataFrame, vector: str, metric: str, k: int, order: str = "_row_seq") -> DataFrame:
    """query_id, rk, id and score of the k rows of table nearest to each row of queries, as top_k ranks them.

    Ids are those in `order`. Each block of queries meets each block of the table by a matrix
    product; k rows a query leave it, and one merge ranks these. Neither side is collected or
    broadcast.
    """
    if k <= 0:
        raise EngineError("InvalidLimit", str(k))
    if metric not in METRICS:
        raise EngineError("InvalidMetric", metric)
    pairs = _blocks(queries, vector, order, QUERY_BLOCK, "q").hint("shuffle_replicate_nl").crossJoin(_blocks(table, vector, order, BLOCK, "t"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in zip(*batch.columns):
                q_ids, q, ids, v = (np.frombuffer(x.as_buffer(), d) for x, d in zip(row, (np.int64, np.float64) * 2))
                q, v = q.reshape(len(q_ids), -1), v.reshape(len(ids), -1)
                if q.shape[1] != v.shape[1]:
                    raise ValueError("InvalidVector: dimension or component")
                a, b, scores = nearest(q, v, ids, metric, k)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[a]), pa.array(ids[b]), pa.array(scores)], names=["query_id", "id", "score"])

    found = pairs.mapInArrow(run, "query_id long, id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id").asc())
    ranked = found.withColumn("rk", F.row_number().over(best)).where(F.col("rk") <= k)
    return ranked.select("query_id", F.col("rk").cast("long").alias("rk"), F.nullif("id", F.lit(_LAST)).alias("id"), "score")
