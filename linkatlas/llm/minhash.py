"""Near-duplicates by SuperMinHash signatures, banding, verification on whole shingle sets and grouping.

A document's set holds the hashes (64 bits) of its distinct runs of ``k`` words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkatlas.llm.components import components
from linkatlas.llm.text import MIX_C, batches, gram_hashes, mix, release, signed, texts, word_hashes, words_of
from linkatlas.operators.skew import salted_join
from linkatlas.session import durable, scratch_path

SLOTS = 128
MISS = 1e-6
TARGET = 400


def bands_for(percent: int, slots: int = SLOTS, miss: float = MISS) -> tuple[int, int]:
    """Bands and rows per band: the longest bands that leave a pair at the threshold unseen with probability ``miss`` at most."""
    at = percent / 100
    fit = [r for r in range(1, slots + 1) if (1 - at ** r) ** (slots // r) <= miss]
    rows = max(fit, default=1)
    return slots // rows, rows


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted hashes of the distinct ``k``-word shingles; a shorter text is one shingle, one without words none."""
    words = words_of(text, lower=True)
    if not words:
        return np.zeros(0, np.uint64)
    hashed = word_hashes(words)
    if len(words) < k:
        return mix(gram_hashes(hashed, len(words)) + np.uint64(len(words)))
    return np.unique(gram_hashes(hashed, k))


def super_minhash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures, one row per set.

    Each element walks a random permutation of the slots; at step ``j`` it offers ``j`` plus a random fraction
    to the slot it stands on, so its offers are correlated ranks and the first steps matter most. A set is
    finished as soon as all its slots hold less than the next step could offer. The steps are taken for
    all elements of the unfinished sets at once, which gives the same minima as element by element.
    """
    sizes = np.array([len(s) for s in sets])
    out = np.full(len(sets) * slots, np.iinfo(np.uint64).max, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    items = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    order, salts = None, np.arange(slots, dtype=np.uint64) * MIX_C
    for j in range(slots):
        if not len(items):
            break
        drawn = mix(items + salts[j])
        to = j + (((drawn & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j)) >> np.uint64(32)).astype(np.int64)
        if order is None:
            at = to
        else:
            row = np.arange(len(items))
            at = order[row, to].astype(np.int64)
            order[row, to] = order[row, j]
            order[row, j] = at
        np.minimum.at(out, owner * slots + at, (np.uint64(j) << np.uint64(32)) | (drawn >> np.uint64(32)))
        open_sets = out.reshape(-1, slots).max(axis=1) >= np.uint64(j + 1) << np.uint64(32)
        stay = open_sets[owner]
        if order is None:
            left = np.flatnonzero(stay)
            order = np.tile(np.arange(slots, dtype=np.uint16), (len(left), 1))
            row, first = np.arange(len(left)), at[left]
            order[row, first] = 0
            order[row, 0] = first
            items, owner = items[left], owner[left]
        elif not stay.all():
            items, owner, order = items[stay], owner[stay], order[stay]
    return out.reshape(-1, slots)


def _signer(k: int, bands: int, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    slots = bands * rows

    def sign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 1 << 20):
            sets = [shingle_set(t, k) for t in batch.column(1).to_pylist()]
            sizes = np.array([len(s) for s in sets], np.int64)
            one, two = (np.array([np.add.reduce(mix(s ^ np.uint64(x))) if len(s) else 0 for s in sets], np.uint64) for x in (1, 2))
            minima = super_minhash(sets, slots).reshape(len(sets), bands, rows)
            keys = np.zeros((len(sets), bands), np.uint64)
            for r in range(rows):
                keys = keys * MIX_C + minima[:, :, r] + np.uint64(1)
            keys = mix(keys + np.arange(bands, dtype=np.uint64) * MIX_C)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), pa.array(signed(keys.reshape(-1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(signed(one)), pa.array(signed(two)), lists],
                                             ["doc_id", "n", "one", "two", "bands"])

    return sign


def _pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches(it):
        packed = [press.compress((t or "").encode()) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["doc_id", "packed"])


def _verifier(k: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def verify(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by hub and chunk, the hub's own text (no member) first."""
        hub, hub_sets = None, []
        unpack = zstandard.ZstdDecompressor()
        for batch in it:
            a, b = [], []
            for h, chunk, member, packed in zip(*(batch.column(i).to_pylist() for i in range(4))):
                own = shingle_set(unpack.decompress(packed).decode(), k)
                if (h, chunk) != hub:
                    hub, hub_sets = (h, chunk), []
                if member is None:
                    hub_sets.append(own)
                    continue
                for other in hub_sets:
                    if min(len(own), len(other)) * 100 < percent * max(len(own), len(other)):
                        continue
                    common = len(np.intersect1d(own, other, assume_unique=True))
                    if common and 100 * common >= percent * (len(own) + len(other) - common):
                        a.append(h)
                        b.append(member)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        release()

    return verify


def _sets(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches(it):
            for node, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = shingle_set(unpack.decompress(packed.as_py()).decode(), k)
                yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([len(own)], pa.int64()), pa.array([signed(own)], pa.list_(pa.int64()))], ["node", "n", "shingles"])

    return sets


def _verified(pairs: DataFrame, packed: DataFrame, k: int, percent: int, n: int) -> DataFrame:
    """The pairs ``(hub, member)`` whose whole sets reach the similarity. A hub with many members is repeated
    per chunk of them, as many as its own count asks for."""
    sizes = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / TARGET).alias("_fan"))
    dealt = pairs.join(sizes, "hub").select("hub", F.pmod(F.xxhash64("member"), "_fan").alias("chunk"), "member")
    members = dealt.join(packed.withColumnRenamed("doc_id", "member"), "member").select("hub", "chunk", "member", "packed")
    hubs = dealt.select("hub", "chunk").distinct().join(packed.withColumnRenamed("doc_id", "hub"), "hub").select(
        "hub", "chunk", F.lit(None).cast("bigint").alias("member"), "packed")
    met = hubs.unionByName(members).repartition(n, "hub", "chunk").sortWithinPartitions("hub", "chunk", F.col("member").asc_nulls_first())
    return met.mapInArrow(_verifier(k, percent), "a bigint, b bigint")


def _overlap(n: str, other: str, percent: int) -> Column:
    """The least number of common shingles with which sets of these sizes reach the similarity, in whole numbers."""
    return F.expr(f"(({n} + {other}) * {percent} + {99 + percent}) div {100 + percent}")


def _likely_pairs(open_rows: DataFrame, packed: DataFrame, k: int, percent: int) -> DataFrame:
    """``(hub, member)``: among nodes of open buckets, every pair from different components that may reach the similarity; exact, nothing likely is left out.

    A shingle that only one component holds cannot be common to such a pair. Of the others, the rarest come first in every set; if ``a`` shingles must be
    common at least, then two sets of ``c`` such shingles each share one among their first ``c - a + 1``, and what is left behind that place must still suffice.
    So a row follows a rare shingle that two components share, and a family of near copies around one text makes few.
    """
    nodes = open_rows.groupBy("node").agg(F.first("component").alias("component"), F.min("least").alias("least"))
    path = scratch_path(packed.sparkSession, "sets")
    packed.withColumnRenamed("doc_id", "node").join(nodes, "node").select("node", "packed").mapInArrow(
        _sets(k), "node bigint, n bigint, shingles array<bigint>").write.parquet(path)
    sets = packed.sparkSession.read.parquet(path)
    each = sets.join(nodes, "node").select("node", "component", "n", "least", F.explode("shingles").alias("shingle"))
    shared = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("count"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
    shared = durable(shared.select("shingle", "count"))
    known = salted_join(each, shared.withColumnRenamed("count", "held"), ["shingle"], "inner", ["node"], sizes=shared)
    own = known.groupBy("node").agg(F.first("component").alias("component"), F.first("n").alias("n"), F.first("least").alias("least"),
                                    F.array_sort(F.collect_list(F.struct("held", "shingle"))).alias("s"))
    # No partner in a shared bucket is smaller than `least`, and none that is similar enough is smaller than the share of this set.
    own = own.withColumn("c", F.size("s").cast("bigint")).withColumn("small", F.greatest("least", F.expr(f"(n * {percent} + 99) div 100")))
    own = own.withColumn("first", F.col("c") - _overlap("n", "small", percent) + 1).filter("first > 0")
    some = ["node", "component", "n", "c", "place"]
    prefix = own.select("node", "component", "n", "c", F.posexplode(F.slice("s", F.lit(1), F.col("first").cast("int"))).alias("place", "x"))
    prefix = durable(prefix.select(*some, F.col("x.shingle").alias("shingle")))
    a, b = (prefix.select("shingle", *[F.col(x).alias(x + side) for x in some]) for side in "ab")
    enough = (F.col("ca") - F.col("placea") >= F.col("least")) & (F.col("cb") - F.col("placeb") >= F.col("least"))
    near = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    met = a.join(b, (a["shingle"] == b["shingle"]) & (F.col("componenta") < F.col("componentb")) & near)
    return met.withColumn("least", _overlap("na", "nb", percent)).filter(enough).select(F.col("nodea").alias("hub"), F.col("nodeb").alias("member")).distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80,
                partitions: int | None = None) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id`` (least id reachable over links), ``kept``.

    Two documents are linked when their shingle sets have at least ``percent`` hundredths of their union in common.

    1. Each set gets a SuperMinHash signature; equal sets become one class, named by its least id.
    2. Classes that share a band meet in a bucket. Buckets with the same members count once.
    3. In each bucket the member with the largest sum of bucket sizes is the hub; it is compared with all members, on whole sets, so that
       a group of near copies costs one comparison each. Where a bucket then still spans several components, an exact prefix filter gives the
       pairs of its members that can reach the similarity at all, and those are compared too. So every pair of a bucket is compared, lies in
       one component, or is ruled out by what its sets cannot have in common.
    4. Links are grouped by union-find inside partitions and star steps across them.

    A pair at the threshold is overlooked by the bands with probability 1e-6 at most; all else is exact up to
    64-bit hashes. Null or empty texts and texts without words have no shingles, and link with nothing. Rows
    that repeat an id are one document. A row without id gets no component, and ``kept`` is null there.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bands, rows = bands_for(percent)
    slim = texts(docs, id_col, text_col)
    signed_docs = durable(slim.mapInArrow(_signer(k, bands, rows), "doc_id bigint, n bigint, one bigint, two bigint, bands array<bigint>"))
    full = signed_docs.filter("n > 0 and doc_id is not null")
    keys = ["n", "one", "two"]
    classes = full.groupBy(*keys).agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("count"))
    named = salted_join(full, classes.select(*keys, "node"), keys, "inner", ["doc_id"], sizes=classes.select(*keys, "count"))
    in_bands = named.filter("doc_id = node").select("node", "n", F.explode("bands").alias("bucket"))
    shape = in_bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("n").alias("least"), F.min("node").alias("lo"), F.max("node").alias("hi"),
                                           F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(7))).alias("y"))
    shape = shape.filter("lo < hi").groupBy("size", "least", "lo", "hi", "x", "y").agg(F.min("bucket").alias("bucket"), F.count(F.lit(1)).alias("alike"))
    members = durable(in_bands.select("node", "bucket").join(shape.select("bucket", "size", "least", "alike"), "bucket").distinct())
    weights = members.groupBy("node").agg(F.sum(F.col("size") * F.col("alike")).alias("weight"))
    members = durable(members.drop("alike").join(weights, "node"))
    wanted = members.select(F.col("node").alias("doc_id")).distinct()
    packed = durable(slim.join(wanted, "doc_id").mapInArrow(_pack, "doc_id bigint, packed binary"))

    best = members.groupBy("bucket").agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("hub"))
    met = durable(members.join(best, "bucket").filter("node <> hub").select("bucket", "node", "least", "hub"))
    pairs = met.select("hub", F.col("node").alias("member")).distinct()
    links = durable(_verified(durable(pairs), packed, k, percent, n))
    found = components(links)
    # Every pair with a hub is settled; what is open are the other members of a bucket, where they lie in several components.
    tied = met.drop("hub").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = tied.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("bucket")
    open_rows = durable(tied.join(split, "bucket").select("node", "component", "least"))
    likely = durable(_likely_pairs(open_rows, packed, k, percent))
    # Stored, since the grouping's Python step in the same stage would take a second worker per core, and executors keep their workers.
    more = durable(_verified(likely, packed, k, percent, n))
    found = components(links.unionByName(more))
    reach = named.select("doc_id", "n", "one", "two", "node").join(found, "node", "left").select(
        "doc_id", "n", F.coalesce("component", "node").alias("component_id"))
    rest = signed_docs.filter("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = reach.unionByName(rest).withColumnRenamed("n", "n_shingles")
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group, its least id; rows without id stay."""
    gone = near_groups(docs, id_col, text_col, k, percent).filter("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col].cast("bigint") == gone["_gone"], "left_anti")
