"""Token sequences in training order, as binary shards of fixed stride."""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkatlas.llm.text import batches, mix, texts
from linkatlas.llm.tokens import WordEncoder, shared_encoder
from linkatlas.session import durable

LENGTH = 2048
PER_SHARD = 4096
END = 0
ROUNDS = 6


def feistel(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """A keyed permutation of ``0 .. size - 1``: a balanced Feistel network over the least even number of bits that holds
    ``size``, walked on from any place outside until it comes back inside."""
    half = max(1, ((max(size, 2) - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = mix(np.arange(ROUNDS, dtype=np.uint64) + np.uint64(key % (1 << 64)))
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & low
        for k in keys:
            left, right = right, left ^ (mix(right + k) & low)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= np.uint64(size)]
    return out.astype(np.int64)


def id_type(source: str) -> str:
    """The narrowest unsigned kind that holds every id of a vocabulary (the text of a ``tokenizer.json``)."""
    spec = json.loads(source)
    top = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
    return "<u2" if top < 1 << 16 else "<u4"


def _sequences(encoder, length: int, end: int, kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The ids of a task's documents one after the other, each closed by ``end``, cut to ``length``; the last may be shorter."""
    stop = np.array([end], "<u4").tobytes()

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, press, part = encoder.value, zstandard.ZstdCompressor(level=5), TaskContext.get().partitionId()
        left, nth = b"", 0

        def rows(chunks: list[bytes]) -> pa.RecordBatch:
            columns = [pa.array([part] * len(chunks), pa.int32()), pa.array(range(nth, nth + len(chunks)), pa.int64()),
                       pa.array([len(c) // 4 for c in chunks], pa.int32()), pa.array([zlib.crc32(c) for c in chunks], pa.int64()),
                       pa.array([press.compress(np.frombuffer(c, "<u4").astype(kind).tobytes()) for c in chunks], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "nth", "n_tokens", "ids_crc32", "packed"])

        for batch in batches(it):
            stream = b"".join([left, *(own.encode(t or "") + stop for t in batch.column(1).to_pylist())])
            whole = len(stream) // (4 * length)
            chunks = [stream[i * 4 * length:(i + 1) * 4 * length] for i in range(whole)]
            left = stream[whole * 4 * length:]
            yield rows(chunks)
            nth += whole
        if left:
            yield rows([left])

    return cut


def _writer(folder: str, length: int, per_shard: int, end: int, kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    width = np.dtype(kind).itemsize
    stride = width * length

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by slot, whole shards to a task. A shard is written under another name and then moved, so that
        a task that runs again replaces it by the same bytes."""
        store, base = fs.FileSystem.from_uri(folder)
        unpack, shard, sink, draft = zstandard.ZstdDecompressor(), -1, None, ""

        def close() -> None:
            if sink is not None:
                sink.close()
                store.move(draft, f"{base}/shard-{shard:08d}.bin")

        store.create_dir(base, recursive=True)
        for batch in it:
            for slot, packed in zip(batch.column("slot").to_pylist(), batch.column("packed").to_pylist()):
                if slot // per_shard != shard:
                    close()
                    shard = slot // per_shard
                    draft = f"{base}/_draft-{shard:08d}-{uuid.uuid4().hex}"
                    sink = store.open_output_stream(draft)
                ids = unpack.decompress(packed)
                sink.write(ids + np.array([end], kind).tobytes() * ((stride - len(ids)) // width))
            slots = batch.column("slot").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [batch.column("slot"), batch.column("sequence_id"), pa.array(slots // per_shard), pa.array(slots % per_shard * stride), batch.column("n_tokens"), batch.column("ids_crc32")],
                ["slot", "sequence_id", "shard", "byte_offset", "n_tokens", "ids_crc32"])
        close()

    return write


def write_shards(docs: DataFrame, path: str, folder: str, key: int, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                 per_shard: int = PER_SHARD, end: int = END) -> DataFrame:
    """Writes ``folder/shard-*.bin`` and returns one row per sequence: ``slot`` (its place in the training order), ``sequence_id``,
    ``shard``, ``byte_offset``, ``n_tokens``, ``ids_crc32`` (over its ids as little-endian unsigned 32-bit integers, padding left out).

    The ids of each document and the id ``end`` make a stream per task, cut to sequences of ``length``; a task's last one is padded. The
    sequences are stored, compressed, so that their numbers hold when a task is lost. One count per task gives every
    sequence its number, and a keyed Feistel permutation turns the number into a slot, in place of a sort by random keys. Slots are range-partitioned, whole shards to a task;
    sequence ``slot % per_shard`` of a shard begins at that number times ``length`` ids, 16 bits an id, or 32 where the vocabulary has ids beyond. So a reader goes on
    from any slot by one seek (``read_shards``); ``manifest.json`` beside the shards names their measures. ``folder`` must be reachable by all executors (a URI that pyarrow can open).

    A null text counts as empty: its ``end`` alone. Repeated rows and null ids are written like others. An empty table writes nothing.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    encoder = shared_encoder(spark, path, WordEncoder)
    kind = id_type(encoder.value.source)
    made = durable(texts(docs, id_col, text_col).mapInArrow(_sequences(encoder, length, end, kind), "part int, nth bigint, n_tokens int, ids_crc32 bigint, packed binary"))
    per_task = sorted((r["part"], r["count"]) for r in made.groupBy("part").count().collect())
    bases, size = np.zeros(max([p for p, _ in per_task], default=0) + 1, np.int64), 0
    for part, count in per_task:
        bases[part], size = size, size + count

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            number = bases[batch.column("part").to_numpy()] + batch.column("nth").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(feistel(number, size, key)), pa.array(number), *(batch.column(c) for c in ("n_tokens", "ids_crc32", "packed"))],
                                             ["slot", "sequence_id", "n_tokens", "ids_crc32", "packed"])

    placed = made.mapInArrow(place, "slot bigint, sequence_id bigint, n_tokens int, ids_crc32 bigint, packed binary")
    whole = placed.withColumn("shard", F.expr(f"slot div {per_shard}"))
    dealt = whole.repartitionByRange(min(parts, max(1, -(-size // per_shard))), "shard").sortWithinPartitions("slot").drop("shard")
    uri = _uri(folder)
    written = durable(dealt.mapInArrow(_writer(uri, length, per_shard, end, kind), "slot bigint, sequence_id bigint, shard bigint, byte_offset bigint, n_tokens int, ids_crc32 bigint"))
    store, base = fs.FileSystem.from_uri(uri)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/manifest.json") as out:
        out.write(json.dumps({"ids": kind, "length": length, "per_shard": per_shard, "sequences": size, "key": key, "end": end}).encode())
    return written


def _uri(folder: str) -> str:
    return folder if "://" in folder or folder.startswith("file:") else "file://" + folder


def read_shards(spark: SparkSession, folder: str, from_slot: int = 0, to_slot: int | None = None) -> DataFrame:
    """``slot`` and ``ids`` (padded to the stride) of the sequences from a slot on, in training order within each partition. A task reads a run of
    slots: one seek in a shard, then on without a break, so a training run that stopped goes on at its slot. Slots beyond the last give no rows."""
    store, base = fs.FileSystem.from_uri(_uri(folder))
    with store.open_input_stream(f"{base}/manifest.json") as f:
        told = json.loads(f.read())
    kind, length, per_shard = told["ids"], told["length"], told["per_shard"]
    last = min(told["sequences"], told["sequences"] if to_slot is None else to_slot)
    stride, uri = np.dtype(kind).itemsize * length, _uri(folder)

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(uri)
        open_shard, source = None, None
        for batch in it:
            slots = batch.column(0).to_numpy()
            for at in range(0, len(slots), 256):
                ids = []
                for slot in slots[at:at + 256].tolist():
                    if slot // per_shard != open_shard:
                        if source is not None:
                            source.close()
                        open_shard, source = slot // per_shard, files.open_input_file(f"{root}/shard-{slot // per_shard:08d}.bin")
                    source.seek(slot % per_shard * stride)
                    ids.append(np.frombuffer(source.read(stride), kind).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(slots[at:at + 256]), pa.array(ids, pa.list_(pa.int64()))], ["slot", "ids"])
        if source is not None:
            source.close()

    tasks = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-max(0, last - from_slot) // per_shard)))
    return spark.range(from_slot, max(from_slot, last), 1, tasks).select(F.col("id").alias("slot")).mapInArrow(read, "slot bigint, ids array<bigint>")
