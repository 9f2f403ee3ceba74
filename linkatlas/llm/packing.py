"""Best-fit packing of token sequences by large-item matching."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkatlas.llm.text import batches, release, texts
from linkatlas.llm.tokens import WordEncoder, shared_encoder
from linkatlas.operators.skew import OrderedChunks
from linkatlas.session import durable

CAPACITY = 2048
END = 0


class Bins:
    """Bins of one content: how many there are, what each holds as (length, items), and the room left in each."""

    def __init__(self, count: int, items: list[tuple[int, int]], room: int):
        self.count, self.items, self.room = count, items, room

    def split(self, count: int) -> "Bins":
        self.count -= count
        return Bins(count, list(self.items), self.room)

    def add(self, length: int, times: int) -> "Bins":
        self.items.append((length, times))
        self.room -= length * times
        return self


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[Bins]:
    """Packs items given as a count per length, so its cost depends on the number of different lengths alone.

    Items over a third of the capacity share a bin with one other of them at most: from the longest on, each
    is matched with the longest one that still fits, which gives the fewest bins for them. The others go, longest first,
    each into the fullest bin that has room, and into new bins when none has.
    """
    left = {s: c for s, c in counts.items() if c > 0}
    large, bins = sorted(s for s in left if 3 * s > capacity), []
    while large:
        a = large[-1]
        at = bisect_left(large, capacity - a + 1) - 1
        b = large[at] if at >= 0 and (large[at] != a or left[a] > 1) else (large[at - 1] if at > 0 else None)
        if b is None:
            bins.append(Bins(left.pop(a), [(a, 1)], capacity - a))
            large.pop()
            continue
        pairs = left[a] // 2 if a == b else min(left[a], left[b])
        bins.append(Bins(pairs, [(a, 2)] if a == b else [(a, 1), (b, 1)], capacity - a - b))
        for s in (a, b):
            left[s] -= pairs
        for s in {a, b}:
            if not left[s]:
                large.remove(s)
                del left[s]
    rooms: dict[int, list[Bins]] = {}
    for b in bins:
        rooms.setdefault(b.room, []).append(b)
    order = sorted(rooms)

    def put(b: Bins) -> None:
        if b.room not in rooms:
            rooms[b.room] = []
            insort(order, b.room)
        rooms[b.room].append(b)

    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        c = left[s]
        while c:
            at = bisect_left(order, s)
            if at == len(order):
                made = -(-c // (capacity // s))
                put(Bins(made, [], capacity))
                continue
            room = order[at]
            group = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                order.pop(at)
            each = room // s
            full = min(group.count, c // each)
            if full:
                put(group.split(full).add(s, each))
                c -= full * each
            if group.count and 0 < c < each:
                put(group.split(1).add(s, c))
                c = 0
            if group.count:
                put(group)
    return [b for r in order for b in rooms[r]]


def placements(bins: list[Bins]) -> tuple[np.ndarray, ...]:
    """Runs of ranks within a length, with the sequence and the offset where each begins: sorted by (length, rank)."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for b in bins:
        offset = 0
        for length, times in b.items:
            rank = taken.get(length, 0)
            rows.append((length, rank, sequence, times, offset))
            taken[length] = rank + b.count * times
            offset += length * times
        sequence += b.count
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return tuple(table.T)


def _pieces(encoder, capacity: int, end: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    stop = np.array([end], "<u4").tobytes()

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder.value
        for batch in batches(it):
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = memoryview(own.encode(text or "") + stop)
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    rows.append((doc, i, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])
        # An executor keeps more workers than it has cores, and deals its tasks to all of them in turn.
        own.forget()
        release()

    return cut


def _placer(runs: tuple[np.ndarray, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    lengths, ranks, sequences, times, offsets = runs
    keys = lengths << 44 | ranks

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, length << 44 | rank - 1, side="right") - 1
            inside = rank - 1 - ranks[at]
            sequence, offset = sequences[at] + inside // times[at], offsets[at] + inside % times[at] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return place


def packed_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.

    A document is its ids and the id ``end``; only one longer than ``capacity`` is cut. Tasks tokenise; the driver gets
    the number of pieces per length, at most ``capacity`` numbers at any data size, and plans the bins on these counts
    (``plan_bins``). Each piece is then ranked among the pieces of its length, over range-partitioned chunks so that
    one length may hold any share of the rows, and its rank finds its place in the plan.

    A null text counts as empty: one piece that holds ``end`` alone. Every row is packed, repeated rows and null ids too.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    encoder = shared_encoder(spark, path, WordEncoder)
    # Stored, since sampling the ranges below would tokenise all texts once more.
    cut = durable(texts(docs, id_col, text_col).mapInArrow(
        _pieces(encoder, capacity, end), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"))
    chunks = OrderedChunks(cut, ["length"], ["doc_id", "piece", "ids_crc32"])
    counts = {r["length"]: r["count"] for r in chunks.df.groupBy("length").count().collect()}
    runs = placements(plan_bins(counts, capacity))
    ranked = chunks.row_number("rank").result().select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return ranked.mapInArrow(_placer(runs), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
