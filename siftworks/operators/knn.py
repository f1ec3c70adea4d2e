"""Nearest vectors: a query set against all vectors in blocks, and prominence re-ranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nearest(queries: DataFrame, vectors: DataFrame, k: int, block_mb: int = 32) -> DataFrame:
    """``(query_id, vec_id, similarity)``: for each query the ``k`` vectors of largest cosine, ties to the smaller id.

    ``queries`` has ``query_id`` and ``embedding``, ``vectors`` ``vec_id`` and ``embedding``. The query set is measured and
    dealt by hash into groups of at most about ``block_mb`` MB, each sent to the executors once. A task multiplies its
    vectors with a group batch by batch and keeps the ``k`` best per query, so what is shuffled is queries x tasks x k
    rows, never all pairs; more queries mean more groups and more passes over the vectors, not more memory.

    Vectors without length have no neighbours and are none; NULL vectors likewise. Vectors must have one width.
    """
    usable = lambda df, key: df.select(key, F.col("embedding").cast("array<float>").alias("embedding")).where(F.exists("embedding", lambda x: x != 0))
    asked = usable(queries, "query_id")
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("width")).first()
    groups = max(1, -(-size["n"] * (size["width"] + 2) * 8 // (block_mb << 20)))
    spark = vectors.sparkSession
    whole = usable(vectors, "vec_id")
    found = spark.createDataFrame([], "query_id bigint, vec_id bigint, similarity double")
    for g in range(groups):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == g).collect()  # at most about block_mb
        if not rows:
            continue
        left = np.array([r["embedding"] for r in rows], np.float64)
        sent = spark.sparkContext.broadcast((np.array([r["query_id"] for r in rows]), left / np.linalg.norm(left, axis=1, keepdims=True)))

        def best(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            ids, unit = sent.value
            keys, top = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0))
            for batch in batches:
                right = np.array(batch["embedding"].tolist(), np.float64)
                score = unit @ (right / np.linalg.norm(right, axis=1, keepdims=True)).T
                keys = np.hstack([keys, np.broadcast_to(batch["vec_id"].to_numpy(), score.shape)])
                top = np.hstack([top, score])
                if top.shape[1] > 4 * k:  # all that may be among the k best: ties at the k-th place stay
                    least = np.partition(np.round(top, 9), -k, axis=1)[:, -k]
                    kept = np.flatnonzero((np.round(top, 9) >= least[:, None]).any(axis=0))
                    keys, top = keys[:, kept], top[:, kept]
                order = np.lexsort((keys, -np.round(top, 9)), axis=1)[:, :k]
                keys, top = np.take_along_axis(keys, order, 1), np.take_along_axis(top, order, 1)
            yield pd.DataFrame({"query_id": np.repeat(ids, keys.shape[1]), "vec_id": keys.ravel(), "similarity": top.ravel()})

        found = found.unionByName(whole.mapInPandas(best, "query_id bigint, vec_id bigint, similarity double"))
    ranked = found.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.round("similarity", 9)).alias("s"), "vec_id", "similarity"))), 1, k).alias("r"))
    return ranked.select("query_id", F.explode("r").alias("r")).select("query_id", "r.vec_id", "r.similarity")


# What makes a record prominent, added to three tenths of the similarity.
TICKER, GLEIF, SEC, WIKI, EXACT, SIMILARITY = 0.08, 0.05, 0.03, 0.02, 0.05, 0.3


def prominence(similarity: Column, listed: Column, sources: Column, exact: Column) -> Column:
    """Score for ranking, by the sources of all rows of a canonical group; thresholds apply to the similarity itself, which this score can't reach."""
    add = lambda on, v: F.when(on, v).otherwise(0.0)
    has = lambda s: F.array_contains(sources, s)
    boost = add(listed, TICKER) + add(has("gleif"), GLEIF) + add(has("sec_edgar"), SEC) + add(has("wikipedia"), WIKI) + add(exact, EXACT)
    return similarity * SIMILARITY + boost
