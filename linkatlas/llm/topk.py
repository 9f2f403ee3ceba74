"""Exact top-k search by distributed histogram selection."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkatlas.llm.scores import TOP, is_finite_vector, products, whole_components
from linkatlas.session import durable

BLOCK = 2048
QUERY_BLOCK = 4096
BINS = 4096
# Numbers of query blocks are 12 bytes each; up to a million of them, for four thousand million queries, are broadcast.
PLAN_ROWS = 1_000_000


def scaled_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``id`` and ``vector``, each component as ``floor(scale * x)`` with x as double. Vectors that are null, or hold a null, NaN
    or infinite component, take no part; neither do empty ones and rows without id. A component that passes a double's range counts as the greatest double."""
    value = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), value.alias("value"))
    return rows.filter(F.col("id").isNotNull() & (F.size("value") > 0) & is_finite_vector(F.col("value"))).select(
        "id", whole_components(F.col("value"), scale).alias("vector"))


def _blocks(rows: DataFrame, size: int, parts: int) -> DataFrame:
    """Rows dealt evenly by id and packed ``size`` to a block: ``block``, ``ids`` and ``matrix`` (doubles, row by row)."""
    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            lengths = np.diff(np.frombuffer(batch.column(1).buffers()[1], np.int32)[batch.column(1).offset:][:batch.num_rows + 1])
            for width in np.unique(lengths):
                own = batch.filter(pa.array(lengths == width))
                ids, flat = own.column(0).to_numpy(), own.column(1).flatten().to_numpy()
                for at in range(0, len(ids), size):
                    part = ids[at:at + size]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(part.min())], pa.int64()), pa.array([int(width)], pa.int32()), pa.array([part.tobytes()], pa.binary()),
                         pa.array([flat[at * width:(at + len(part)) * width].tobytes()], pa.binary())], ["block", "width", "ids", "matrix"])

    return rows.repartition(parts, "id").mapInArrow(pack, "block bigint, width int, ids binary, matrix binary")


def _listed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for block, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = np.frombuffer(ids, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), block)), pa.array(own)], ["block", "query_id"])


class _Pair:
    """The scores of one block of queries against one block of rows."""

    def __init__(self, q_ids: bytes, q_matrix: bytes, ids: bytes, matrix: bytes, width: int, known: list[dict]):
        self.queries, self.rows = np.frombuffer(q_ids, np.int64), np.frombuffer(ids, np.int64)
        a, b = np.frombuffer(q_matrix).reshape(-1, width), np.frombuffer(matrix).reshape(-1, width)
        self.scores = products(a, b)
        by = {r["query_id"]: (r["low"], r["step"]) for r in known}
        # A query that meets no other row has no range; nothing reaches its bound.
        idle = np.array([i not in by for i in self.queries.tolist()], bool)
        self.scores[idle] = -TOP
        self.low, self.step = np.array([by.get(i, (TOP, 1)) for i in self.queries.tolist()], np.int64).reshape(-1, 2).T
        self.own = self.queries[:, None] == self.rows[None, :]


def _histograms(k: int, bins: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per query and bin of its present range, from the top down to where this block alone holds k scores: lower bins cannot hold the k-th value."""
        for batch in it:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                pair = _Pair(*row)
                # Unsigned, since a range may be wider than a signed number.
                above = pair.scores.astype(np.uint64) - pair.low.astype(np.uint64)[:, None]
                at = np.minimum(above // pair.step.astype(np.uint64)[:, None], bins).astype(np.int64)
                at[pair.own | (pair.scores < pair.low[:, None])] = -1
                take = min(k, at.shape[1])
                floor = np.maximum(np.partition(at, at.shape[1] - take, axis=1)[:, at.shape[1] - take], 0)
                q, r = np.nonzero(at >= floor[:, None])
                keys, counts = np.unique(q.astype(np.int64) * (bins + 2) + at[q, r], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pair.queries[keys // (bins + 2)]), pa.array(keys % (bins + 2)), pa.array(counts.astype(np.int64))],
                                                 ["query_id", "bin", "n"])

    return count


def _chosen(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def choose(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All scores at or over the k-th value; of those that tie in this block, the k smallest ids."""
        for batch in it:
            for block in zip(*(c.to_pylist() for c in batch.columns)):
                pair = _Pair(*block)
                q, r = np.nonzero((pair.scores >= pair.low[:, None]) & ~pair.own)
                score, row = pair.scores[q, r], pair.rows[r]
                order = np.lexsort((row, -score, q))
                q, score, row = q[order], score[order], row[order]
                first = np.searchsorted(q, q, side="left")
                keep = np.arange(len(q)) - first < k
                yield pa.RecordBatch.from_arrays([pa.array(pair.queries[q[keep]]), pa.array(row[keep]), pa.array(score[keep])], ["query_id", "vec_id", "score"])

    return choose


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: int = 256) -> DataFrame:
    """The ``k`` rows of highest inner product for each query, itself left out: ``query_id``, ``rank``, ``vec_id``, ``score``; ties go to the smaller id.

    ``is_query`` is a condition over the column ``id``. Queries and rows are packed into blocks; each block of rows is joined with
    each block of queries of its width, and every score is computed, exactly, as an integer. Each round bins the scores
    of each query over its present range and sums the bins over all blocks; the bin with the k-th value becomes the next
    range, until it holds one value. Then all scores from that value on are taken and ranked. A score beyond 64 bits counts as the greatest (least) 64-bit number.
    A block sends at most the bins of its own best k, and at most k rows per query, which loses nothing.

    A query with fewer than ``k`` other rows gets them all. Vectors meet only vectors of their own length. Rows that repeat
    an id are rows of their own, none of which matches a query of that id; of repeated queries the least vector asks. No queries or an empty table give no rows.
    """
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = durable(scaled_vectors(vectors, id_col, vector_col, scale))
    total = rows.count()
    targets = durable(rows.filter(is_query).groupBy("id").agg(F.min("vector").alias("vector")))
    row_blocks = durable(_blocks(rows, BLOCK, max(1, min(parts, -(-total // BLOCK)))))
    query_blocks = durable(_blocks(targets, QUERY_BLOCK, max(1, -(-targets.count() // QUERY_BLOCK))))
    top = rows.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))).first()[0] or 0.0
    # Rounding of the sum stays far below a part in 2^40.
    reach = int(min(top * (1 + 2.0 ** -40) + 1, 2.0 ** 63)) if top < 2.0 ** 63 else TOP
    reach = min(reach, TOP)

    widest = max(1, -(-(2 * reach + 1) // BINS))
    ranges = targets.select(F.col("id").alias("query_id"), F.lit(-reach).cast("bigint").alias("low"), F.lit(widest).cast("bigint").alias("step"))
    owners = durable(query_blocks.select("block", "ids").mapInArrow(_listed, "block bigint, query_id bigint"))
    # The numbers of the query blocks, one for each 4096 queries; each meets all row blocks of its width, spread by a salt.
    plan = query_blocks.select("width", "block")
    fan = max(1, parts // max(1, plan.count()))
    small = plan.count() <= PLAN_ROWS
    dealt = row_blocks.select("width", "ids", "matrix").join(F.broadcast(plan) if small else plan, "width").withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(fan)))

    def paired(ranges: DataFrame) -> DataFrame:
        known = owners.join(ranges, "query_id").groupBy("block").agg(F.collect_list(F.struct("query_id", "low", "step")).alias("known"))
        sides = query_blocks.select("block", F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix")).join(known, "block")
        sides = sides.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(fan - 1)))).withColumn("salt", F.col("salt").cast("bigint"))
        return dealt.join(sides, ["block", "salt"]).select("q_ids", "q_matrix", "ids", "matrix", "width", "known")

    while True:
        counted = paired(ranges).mapInArrow(_histograms(k, BINS), "query_id bigint, bin bigint, n bigint")
        down = Window.partitionBy("query_id").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        reached = counted.groupBy("query_id", "bin").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(down))
        # The k-th value lies in the first bin from the top by which k scores are reached; where there are fewer scores at all, every one is wanted.
        found = reached.groupBy("query_id").agg(F.max(F.when(F.col("upto") >= k, F.col("bin"))).alias("at"), F.min("bin").alias("last"))
        finer = max(1, -(-widest // BINS))
        big = lambda c: F.col(c).cast("decimal(38,0)")
        edge = (big("low") + F.coalesce("at", "last").cast("decimal(19,0)") * F.col("step").cast("decimal(19,0)")).cast("bigint")
        ranges = durable(ranges.join(found, "query_id").select("query_id", edge.alias("low"), F.lit(finer).cast("bigint").alias("step")))
        if widest == 1:
            break
        widest = finer
    kept = paired(ranges).mapInArrow(_chosen(k), "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return kept.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
