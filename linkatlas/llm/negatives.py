"""Hard negatives from Hilbert-ordered Parquet blocks, chosen by zone maps and interval arithmetic."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkatlas.llm.scores import TOP, is_finite_vector, products, whole_components
from linkatlas.session import durable, scratch_path

BLOCK = 1024
ANCHORS = 256
ZONES = 256
BLOCKS_A_TASK = 64
BITS = 4
KINDS = (np.int8, np.int16, np.int32, np.float64)
WINDOWS = "array<struct<anchor_id: bigint, tag: int, low: bigint, high: bigint>>"


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """Place of each row of ``cells`` (unsigned, ``bits`` bits a dimension) on the Hilbert curve, as bytes that sort alike.

    By Skilling's transpose method: undo the excess work from the highest bit down, Gray-encode across the dimensions, then interleave the bits.
    """
    x = cells.T.astype(np.uint32).copy()
    high = 1 << (bits - 1)
    q = high
    while q > 1:
        p = np.uint32(q - 1)
        for axis in x:
            set_here = (axis & np.uint32(q)) != 0
            swap = np.where(set_here, np.uint32(0), (x[0] ^ axis) & p)
            x[0] ^= np.where(set_here, p, swap)
            axis ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip, q = np.zeros(x.shape[1], np.uint32), high
    while q > 1:
        flip ^= np.where(x[-1] & np.uint32(q), np.uint32(q - 1), np.uint32(0))
        q >>= 1
    x ^= flip
    planes = np.stack([(x >> np.uint32(b)) & np.uint32(1) for b in range(bits - 1, -1, -1)])
    packed = np.packbits(planes.reshape(bits * len(x), -1).T.astype(np.uint8), axis=1)
    return [row.tobytes() for row in packed]


def _rows(batch: pa.RecordBatch) -> Iterator[list]:
    """The rows one by one, so that only one row's blocks are copied at a time."""
    for i in range(batch.num_rows):
        yield [c[i].as_py() for c in batch.columns]


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _keyed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the Hilbert key. Cells are taken relative to the row's own greatest component, so no pass over the table is needed and no outlier blurs the others."""
    for batch in it:
        lengths = batch.column("width").to_numpy()
        for width in np.unique(lengths):
            part = batch.filter(pa.array(lengths == width))
            values = _matrix(part.column("vector"), part.num_rows)
            share = values / np.maximum(np.abs(values).max(axis=1, keepdims=True), 1)
            cells = np.minimum((share + 1) * (1 << (BITS - 1)), (1 << BITS) - 1).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(hilbert_keys(cells, BITS), pa.binary())], [*part.schema.names, "key"])


def _small(values: np.ndarray) -> tuple[int, bytes]:
    """The values in the smallest kind of number that holds them, with its place in ``KINDS``."""
    most = np.abs(values).max(initial=0)
    kind = next((i for i, k in enumerate(KINDS[:3]) if most <= np.iinfo(k).max), 3)
    return kind, values.astype(KINDS[kind]).tobytes()


def _large(kind: int, data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, KINDS[kind]).reshape(-1, width).astype(np.float64)


def _zoned(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows cut into blocks of ``BLOCK``, each with its least and greatest value per dimension."""
    number, kept = TaskContext.get().partitionId() << 32, None

    def block(rows: pa.RecordBatch, width: int):
        nonlocal number
        values = _matrix(rows.column("vector"), rows.num_rows)
        kind, data = _small(values)
        number += 1
        one = lambda x, t: pa.array([x], t)
        return pa.RecordBatch.from_arrays(
            [one(number, pa.int64()), one(width, pa.int32()), one(values.min(axis=0).tobytes(), pa.binary()), one(values.max(axis=0).tobytes(), pa.binary()),
             one(rows.column("id").to_numpy().tobytes(), pa.binary()), one(rows.column("label").to_numpy().tobytes(), pa.binary()),
             one(rows.column("is_anchor").to_numpy(zero_copy_only=False).tobytes(), pa.binary()), one(kind, pa.int32()), one(data, pa.binary())],
            ["block", "width", "lo", "hi", "ids", "labels", "flags", "kind", "matrix"])

    for batch in it:
        rows = batch if kept is None else pa.Table.from_batches([kept, batch]).combine_chunks().to_batches()[0]
        widths, start = rows.column("width").to_numpy(), 0
        edges = [0, *(np.flatnonzero(np.diff(widths)) + 1).tolist(), len(widths)]
        for left, right in zip(edges, edges[1:]):
            for start in range(left, right, BLOCK):
                if start + BLOCK <= right or right < len(widths):
                    yield block(rows.slice(start, min(BLOCK, right - start)), int(widths[left]))
                else:
                    break
            else:
                start = right
        kept = rows.slice(start) if start < len(widths) else None
    if kept is not None and kept.num_rows:
        yield block(kept, int(kept.column("width")[0].as_py()))


def hilbert_blocks(vectors: DataFrame, is_anchor: Column, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """Candidate blocks as a Parquet table in the shared folder, ordered along the Hilbert curve; its columns ``lo`` and ``hi`` are the zone maps.

    Equal vectors have equal keys, so the id is a part of the range key and copies spread over tasks.
    """
    spark = vectors.sparkSession
    value = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double"))
    rows = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{label_col}`").cast("bigint").alias("label"), value.alias("value"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("value") > 0) & is_finite_vector(F.col("value")))
    rows = rows.select("id", "label", is_anchor.alias("is_anchor"), F.size("value").alias("width"), whole_components(F.col("value"), scale).alias("vector"))
    keyed = rows.mapInArrow(_keyed, "id bigint, label bigint, is_anchor boolean, width int, vector array<double>, key binary")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartitionByRange(n, "width", "key", "id").sortWithinPartitions("width", "key", "id", "label")
    path = scratch_path(spark, "hilbert")
    ordered.mapInArrow(_zoned, "block bigint, width int, lo binary, hi binary, ids binary, labels binary, flags binary, kind int, matrix binary").write.parquet(path)
    return spark.read.parquet(path)


def _flagged(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for block, width, ids, labels, flags, kind, data in _rows(batch):
            own = np.frombuffer(flags, bool)
            if own.any():
                values = _large(kind, data, width)[own]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(ids, np.int64)[own]), pa.array(np.frombuffer(labels, np.int64)[own]), pa.array(np.full(own.sum(), width, np.int32)),
                     pa.array([v.tobytes() for v in values], pa.binary()), pa.array(np.full(own.sum(), block, np.int64))], ["id", "label", "width", "vector", "home"])


def _grouped(size: int, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted rows with ``width`` first, cut into groups of ``size``; each other column becomes the group's binary, its values one after the other."""
    def group(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, kept, width = TaskContext.get().partitionId() << 32, [], None

        def out():
            cells = [b"".join(x if isinstance(x, bytes) else np.int64(x).tobytes() for x in col) for col in zip(*kept)]
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([width], pa.int32()), *(pa.array([c], pa.binary()) for c in cells)],
                                              ["number", "width", *names])

        for batch in it:
            for w, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if kept and (w != width or len(kept) == size):
                    yield out()
                    number, kept = number + 1, []
                width = w
                kept.append(rest)
        if kept:
            yield out()

    return group


def _needed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks that some window of an anchor group may need: the interval of the products of an anchor with a block's box must meet the window."""
    for batch in it:
        for number, width, ids, matrix, known, blocks, lo, hi in _rows(batch):
            a = np.frombuffer(matrix).reshape(-1, width)
            low_edge, high_edge, blocks = np.frombuffer(lo).reshape(-1, width).T, np.frombuffer(hi).reshape(-1, width).T, np.frombuffer(blocks, np.int64)
            plus, minus = np.maximum(a, 0), np.minimum(a, 0)
            at = {x: i for i, x in enumerate(np.frombuffer(ids, np.int64).tolist())}
            who = np.array([at[w["anchor_id"]] for w in known], np.int64)
            want_low, want_high = (np.array([w[k] for w in known], np.float64)[:, None] for k in ("low", "high"))
            with np.errstate(over="ignore", invalid="ignore"):
                slack = 1 + 1e-9 * (np.abs(a) @ np.maximum(np.abs(low_edge), np.abs(high_edge)))
                upper = np.clip(plus @ high_edge + minus @ low_edge + slack, -TOP, TOP)[who]
                lower = np.clip(plus @ low_edge + minus @ high_edge - slack, -TOP, TOP)[who]
                # Written so that an undefined bound reads the block.
                read = (~(upper < want_low) & ~(lower > want_high)).any(axis=0) if len(who) else np.zeros(len(blocks), bool)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(read.sum(), number, np.int64)), pa.array(blocks[read])], ["number", "block"])


def _searched(k: int, same: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor group and share, the group first, then its blocks, which stream past it. Each window keeps its best ``k``."""
        key, group, best = None, None, None

        def out():
            who, score, vec = (x[:, None] if x.ndim == 1 else x for x in (group["who"], best[0], best[1]))
            w, j = np.nonzero(best[2])
            return pa.RecordBatch.from_arrays([pa.array(group["ids"][who[w, 0]]), pa.array(group["tag"][w]), pa.array(vec[w, j]), pa.array(score[w, j])],
                                              ["anchor_id", "tag", "vec_id", "score"])

        for batch in it:
            for number, share, width, ids, labels, matrix, known, kind, block in _rows(batch):
                if block is None:
                    if best is not None:
                        yield out()
                    key, own = (number, share), np.frombuffer(ids, np.int64)
                    at = {x: i for i, x in enumerate(own.tolist())}
                    group = {"ids": own, "labels": np.frombuffer(labels, np.int64), "matrix": np.frombuffer(matrix).reshape(-1, width),
                             "who": np.array([at[w["anchor_id"]] for w in known], np.int64), "tag": np.array([w["tag"] for w in known], np.int32),
                             "low": np.array([w["low"] for w in known], np.int64)[:, None], "high": np.array([w["high"] for w in known], np.int64)[:, None]}
                    n = len(known)
                    best = np.full((n, k), -TOP), np.full((n, k), TOP), np.zeros((n, k), bool)
                    continue
                if (number, share) != key:
                    continue
                best = _merged(group, best, np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64), _large(kind, matrix, width), k, same)
        if best is not None:
            yield out()

    return search


def _merged(group: dict, best: tuple, ids: np.ndarray, labels: np.ndarray, values: np.ndarray, k: int, same: bool) -> tuple:
    fits = (group["labels"][:, None] == labels[None, :]) == same
    fits &= group["ids"][:, None] != ids[None, :]
    score = products(group["matrix"], values)[group["who"]]
    fits = fits[group["who"]] & (score >= group["low"]) & (score <= group["high"])
    fits &= (score >= best[0][:, -1:]) | ~best[2][:, -1:]
    take = min(k, score.shape[1])
    masked = np.where(fits, score, -TOP)
    fits &= masked >= np.partition(masked, masked.shape[1] - take, axis=1)[:, masked.shape[1] - take][:, None]
    w, r = np.nonzero(fits)
    old_w, old_j = np.nonzero(best[2])
    w = np.concatenate([w, old_w])
    score, vec = np.concatenate([score[fits], best[0][old_w, old_j]]), np.concatenate([ids[r], best[1][old_w, old_j]])
    order = np.lexsort((vec, -score, w))
    w, score, vec = w[order], score[order], vec[order]
    nth = np.arange(len(w)) - np.searchsorted(w, w, side="left")
    keep = nth < k
    out = np.full_like(best[0], -TOP), np.full_like(best[1], TOP), np.zeros_like(best[2])
    for full, value in zip(out, (score[keep], vec[keep], True)):
        full[w[keep], nth[keep]] = value
    return out


class _Search:
    """Anchor groups, the block table and its zone maps, ready for rounds of windows."""

    def __init__(self, vectors: DataFrame, is_anchor: Column, id_col: str, vector_col: str, label_col: str, scale: int):
        spark = vectors.sparkSession
        self.parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.blocks = hilbert_blocks(vectors, is_anchor, id_col, vector_col, label_col, scale)
        flagged = self.blocks.select("block", "width", "ids", "labels", "flags", "kind", "matrix").mapInArrow(
            _flagged, "id bigint, label bigint, width int, vector binary, home bigint")
        # Of rows that repeat an anchor's id one is the anchor, whatever the order of the table.
        once = flagged.groupBy("id").agg(F.min(F.struct("width", "label", "vector", "home")).alias("r")).select("r.width", "r.home", "id", "r.label", "r.vector")
        dealt = once.repartitionByRange(max(1, min(self.parts, -(-once.count() // ANCHORS))), "width", "home", "id").sortWithinPartitions("width", "home", "id")
        self.groups = durable(dealt.mapInArrow(_grouped(ANCHORS, ["homes", "ids", "labels", "matrix"]),
                                               "number bigint, width int, homes binary, ids binary, labels binary, matrix binary"))
        self.anchors = durable(self.groups.select("number", "ids", "homes").mapInArrow(_listed, "number bigint, anchor_id bigint, home bigint"))
        zones = self.blocks.select("width", "block", "lo", "hi").sortWithinPartitions("width", "block")
        self.zones = durable(zones.mapInArrow(_grouped(ZONES, ["blocks", "lo", "hi"]), "number bigint, width int, blocks binary, lo binary, hi binary"))

    def homes(self) -> DataFrame:
        """The blocks that hold the anchors themselves."""
        return self.anchors.select("number", F.col("home").alias("block")).distinct()

    def _with(self, windows: DataFrame) -> DataFrame:
        known = windows.join(self.anchors.select("anchor_id", "number"), "anchor_id").groupBy("number").agg(
            F.collect_list(F.struct("anchor_id", "tag", "low", "high")).alias("known"))
        return self.groups.join(known, "number")

    def needed(self, windows: DataFrame) -> DataFrame:
        """``(number, block)``: the blocks that each anchor group must read for its windows. Groups of zones meet groups of anchors of their width, spread by a salt."""
        fan = max(1, min(self.parts, self.zones.count()))
        sides = self._with(windows).select("number", "width", "ids", "matrix", "known", F.explode(F.sequence(F.lit(0), F.lit(fan - 1))).alias("salt"))
        zones = self.zones.select("width", "blocks", "lo", "hi", F.pmod(F.xxhash64("blocks"), F.lit(fan)).cast("int").alias("salt"))
        met = sides.join(zones, ["width", "salt"]).select("number", "width", "ids", "matrix", "known", "blocks", "lo", "hi")
        return met.mapInArrow(_needed, "number bigint, block bigint")

    def search(self, windows: DataFrame, pairs: DataFrame, k: int, same: bool) -> DataFrame:
        """The best ``k`` rows of each window (``anchor_id``, ``tag``, ``low``, ``high``) in the blocks of ``pairs``: ``anchor_id``, ``tag``, ``rank``, ``vec_id``, ``score``."""
        pairs = durable(pairs)
        fans = pairs.groupBy("number").agg(F.ceil(F.count(F.lit(1)) / BLOCKS_A_TASK).cast("int").alias("fan"))
        none = lambda t: F.lit(None).cast(t)
        some = ["number", "share", "width", "ids", "labels", "matrix", "known", "kind", "block"]
        sides = self._with(windows).join(fans, "number").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("fan") - 1)))
        sides = sides.withColumn("kind", none("int")).withColumn("block", none("bigint")).select(*some)
        share = F.pmod(F.xxhash64("block"), F.col("fan")).cast("int")
        read = pairs.join(fans, "number").withColumn("share", share).drop("fan").join(self.blocks, "block").withColumn("known", none(WINDOWS)).select(*some)
        met = sides.unionByName(read).repartition(self.parts, "number", "share").sortWithinPartitions("number", "share", F.col("block").asc_nulls_first())
        found = met.mapInArrow(_searched(k, same), "anchor_id bigint, tag int, vec_id bigint, score bigint")
        best = Window.partitionBy("anchor_id", "tag").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    def exact(self, windows: DataFrame, k: int, same: bool) -> DataFrame:
        """The best ``k`` of each window over all blocks. The blocks around the anchors are read first; where they fill a window, its lower edge
        rises to its k-th score, and only blocks that may reach that are read then."""
        first = self.search(windows, self.homes(), k, same)
        edge = first.filter(F.col("rank") == k).select("anchor_id", "tag", F.col("score").alias("edge"))
        raised = durable(windows.join(edge, ["anchor_id", "tag"], "left").select("anchor_id", "tag", F.greatest("low", "edge").alias("low"), "high"))
        return self.search(raised, self.needed(raised), k, same)


def _listed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for number, ids, homes in _rows(batch):
            own = np.frombuffer(ids, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), number, np.int64)), pa.array(own), pa.array(np.frombuffer(homes, np.int64))], ["number", "anchor_id", "home"])


def hard_negatives(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                   positives: int = 5, negatives: int = 3, scale: int = 256) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    ``is_anchor`` is a condition over the columns ``id`` and ``label``. Components become ``floor(scale * x)``; a score is the exact inner product, and one
    beyond 64 bits counts as the greatest (least) 64-bit number. An anchor's positives are its first rows of the same label, by score, then smaller id; for
    each of them the first ``negatives`` rows of other labels are returned whose score lies between 50 and 95 hundredths of the positive's.

    Candidates lie in Parquet blocks along a Hilbert curve. Each block's least and greatest value per dimension give, by interval arithmetic, the range that
    its products with an anchor can have; an anchor group reads a block only if that range meets one of its windows. What the blocks around
    the anchors already gave narrows the windows before. Nothing is approximate.

    Rows with a null id or label, a null or empty vector, or a null, NaN or infinite component take no part. Vectors meet only vectors of their own length.
    Rows that repeat an id are candidates of their own, but none for an anchor of that id; of repeated anchors the least (width, label, vector) is one.
    No anchors or an empty table give no rows; other columns are not read.
    """
    search = _Search(vectors, is_anchor, id_col, vector_col, label_col, scale)
    open_windows = search.anchors.select("anchor_id", F.lit(0).alias("tag"), F.lit(-TOP).cast("bigint").alias("low"), F.lit(TOP).cast("bigint").alias("high"))
    found = durable(search.exact(open_windows, positives, True).select(
        "anchor_id", F.col("rank").alias("tag"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # 50 p <= 100 n <= 95 p, in steps that stay within 64 bits.
    high = F.expr("(positive_score - pmod(positive_score, 20)) div 20 * 19 + pmod(positive_score, 20) * 19 div 20")
    low = F.expr("positive_score div 2 + pmod(positive_score, 2) * int(positive_score > 0)")
    windows = durable(found.select("anchor_id", "tag", low.alias("low"), high.alias("high")).filter("low <= high"))
    got = search.exact(windows, negatives, False).withColumnRenamed("score", "negative_score").withColumnRenamed("vec_id", "negative_id")
    return got.join(found, ["anchor_id", "tag"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
