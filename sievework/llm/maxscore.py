"""Exact top-k by inner product with MaxScore over shards.

Each vector dimension is a query term; a shard (an Arrow batch) holds a term's
postings as one row of integer weights. A term's score bound is the most that the
shard can add through it for a query. In the shard's order of terms, by ascending
bound over all queries, the first ones whose bounds together stay below a query's
current k-th score are its non-essential terms. Queries with the same number of them
traverse the postings of the other terms together and no others; the non-essential
terms are probed, the largest bounds first, only for vectors that remain
competitive. The shards' lists are merged by a ranked window.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut as written
from ._common import ready

#: Queries that one pass over the candidates serves; with 64 components 2 MB are sent.
QUERY_BLOCK = 4096
_SHARD = 4096
#: Numbers of non-essential terms are multiples of this, so that many queries share one; so many terms are probed at once.
_STEP, _PROBED = 4, 16
#: Below this, sums of products are exact in doubles.
_EXACT = 1 << 53


def _matrix(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : min(len(v), width)] = v[:width]
    return out


class _Best:
    """The k best (score, id) of each query so far, equal scores by the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k, self.scores = k, [np.empty(0, np.int64) for _ in range(queries)]
        self.ids = [np.empty(0, np.int64) for _ in range(queries)]
        self.bar = np.full(queries, -np.inf)

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.scores[q], scores]), np.concatenate([self.ids[q], ids])
        first = np.lexsort((i, -s))[: self.k]
        self.scores[q], self.ids[q] = s[first], i[first]
        if len(first) == self.k:
            self.bar[q] = self.scores[q][-1]


def search_shard(best: _Best, query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
    """Let one shard's vectors compete. All arrays hold integers; inner products that may leave 64 bits are refused."""
    low, high = vectors.min(axis=0), vectors.max(axis=0)
    reach = float(np.abs(queries.astype(np.float64)).max(initial=0)) * max(-float(low.min(initial=0)), float(high.max(initial=0))) * queries.shape[1]
    if reach >= 2.0**62:
        raise OverflowError("components are so large that inner products may not fit 64 bits")
    kind = np.float64 if reach < _EXACT else np.int64
    bounds = np.maximum(queries * low, queries * high).astype(np.float64)
    order = np.argsort(bounds.sum(axis=0), kind="stable")
    bounds, queries = bounds[:, order], queries[:, order].astype(kind)
    postings = np.ascontiguousarray(vectors[:, order].T, dtype=kind)  # a row for each term
    # What the first terms add at most; a term that can only lower scores counts as 0 for the split.
    slack = 1e-12 * np.cumsum(np.abs(bounds), axis=1)  # for the rounding of large integers
    before = np.concatenate([np.zeros((len(queries), 1)), np.cumsum(bounds, axis=1) + slack], axis=1)
    split = np.cumsum(np.maximum(bounds, 0), axis=1)
    cut = (split < best.bar[:, None]).sum(axis=1) // _STEP * _STEP
    live = before[:, -1] >= best.bar  # else no vector of the shard can enter
    for essential in np.unique(cut[live]):
        same = np.flatnonzero(live & (cut == essential))
        for block in np.array_split(same, -(-len(same) // 256)):
            rest = before[block, essential]
            partial = queries[block, essential:] @ postings[essential:]
            fits = partial + rest[:, None] >= best.bar[block, None]
            fits &= ids[None, :] != query_ids[block, None]
            for n, q in enumerate(block):
                left = np.flatnonzero(fits[n])
                score, to = partial[n, left], int(essential)
                while to and len(left):
                    at = max(0, to - _PROBED)
                    score = score + queries[q, at:to] @ postings[at:to, left]
                    keep = score + before[q, at] >= best.bar[q]
                    left, score, to = left[keep], score[keep], at
                if len(left):
                    best.add(q, score.astype(np.int64), ids[left])


def quantised(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component as bigint; null for a null vector, null or non-finite components."""
    each = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, each)


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10, block: int = QUERY_BLOCK) -> DataFrame:
    """The ``k`` candidates with the largest inner product for each query.

    Both frames are (id bigint, vector array<bigint>); rows with a null id or a
    null vector take no part. Returns query_id, rank from 1, id, score. Equal
    scores go by the smaller id. A query's own id is no candidate for it. Of query
    rows with the same id the least vector counts; candidate rows with the same id
    compete each. Vectors of unequal length are filled up with zeros.

    Queries are read in blocks of ``block`` by ascending id, so what the driver
    holds and sends doesn't grow with the data; each block passes over all rows. Where
    there are several, the sorted queries and each block's result are written to the
    shared folder and the block's copy on the executors is released. Components so large
    that an inner product may leave 64 bits raise an error.
    """
    import pyarrow as pa

    spark = ready(candidates.sparkSession)
    names = ["query_id", "id", "score"]
    schema = "query_id bigint, id bigint, score bigint"
    asked = queries.where("id is not null and vector is not null").groupBy("id").agg(F.min("vector").alias("vector"))
    rows = candidates.where("id is not null and vector is not null").select("id", "vector")

    def passed(sent):
        def run(batches):
            query_ids, vectors = sent.value
            best = _Best(len(query_ids), k)
            for batch in batches:
                ids, lists = batch.column(0).to_numpy(), batch.column(1)
                ends = lists.offsets.to_numpy()
                flat = lists.values.to_numpy()
                for at in range(0, len(ids), _SHARD):
                    to = min(len(ids), at + _SHARD)
                    sizes = np.diff(ends[at : to + 1])
                    if len(sizes) and (sizes == sizes[0]).all():
                        shard = flat[ends[at] : ends[to]].reshape(to - at, sizes[0])
                    else:
                        shard = _matrix([flat[ends[i] : ends[i + 1]] for i in range(at, to)], int(sizes.max(initial=0)))
                    width = max(shard.shape[1], vectors.shape[1])
                    if not width:
                        width = 1
                    fill = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1])))
                    search_shard(best, query_ids, fill(vectors), ids[at:to], fill(shard))
            found = [np.repeat(query_ids, [len(x) for x in best.ids]), np.concatenate(best.ids), np.concatenate(best.scores)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=names)

        return run

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    ranked = lambda found: found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
    out, after = None, None
    part = asked.orderBy("id").limit(block + 1).collect()
    several = len(part) > block
    if several:
        asked = written(asked.orderBy("id"))
    while part:
        part = part[:block]
        after = part[-1]["id"]
        width = max(len(r["vector"]) for r in part)
        sent = spark.sparkContext.broadcast((np.array([r["id"] for r in part], dtype=np.int64), _matrix([r["vector"] for r in part], width)))
        found = ranked(rows.mapInArrow(passed(sent), schema))
        if several:
            found = written(found)
            sent.destroy()
        out = found if out is None else out.unionAll(found)
        part = asked.where(F.col("id") > after).orderBy("id").limit(block).collect() if several else []
    return spark.createDataFrame([], "query_id bigint, rank int, id bigint, score bigint") if out is None else out
