"""Removal of word windows that an earlier document has too, by super-k-mer partitioning."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkatlas.llm.text import batches, gram_hashes, signed, texts, word_hashes, words_of
from linkatlas.session import durable

GRAM = 8
HOT_WINDOWS = 20_000


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def super_kmers(words: list[bytes], window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, first window and number of windows of each run of neighbouring windows with one minimiser: the
    least hash among the ``gram``-word runs of the window. Equal windows have equal minimisers."""
    if len(words) < window:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none
    least = _sliding_min(gram_hashes(word_hashes(words), gram), window - gram + 1)
    starts = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
    return least[starts], starts, np.diff(np.concatenate((starts, [len(least)])))


def _scan(window: int, gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            keys, counts, ends, sizes, digests = [], [], [0], [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text, lower=False)
                least, _, windows = super_kmers(words, window, gram)
                own, at = np.unique(least, return_inverse=True)
                keys.append(signed(own))
                counts.append(np.bincount(at, windows, len(own)).astype(np.int64))
                ends.append(ends[-1] + len(own))
                sizes.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            offsets = pa.array(np.array(ends, np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(keys))),
                 pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(counts)))], ["doc_id", "fp", "n_words", "sha", "keys", "counts"])

    return scan


def _pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches(it):
        packed = [press.compress((t or "").encode()) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("fp"), pa.array(packed, pa.binary()), batch.column("cold"),
                                          batch.column("hot")], ["doc_id", "fp", "packed", "cold", "hot"])


class _Out:
    """Rows of (key, doc_id, fp, start, words) on their way into Arrow batches."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, *row) -> None:
        self.rows.append(row)
        self.size += 60 + len(row[-1])

    def take(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows)) or [[]] * 5
        self.rows, self.size = [], 0
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["key", "doc_id", "fp", "start", "words"])


def _emit(window: int, gram: int, hot: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, out = zstandard.ZstdDecompressor(), _Out()
        for batch in batches(it):
            for doc, fp, packed, chosen in zip(*(c.to_pylist() for c in batch.columns)):
                if not chosen:
                    continue
                words = words_of(unpack.decompress(packed).decode(), lower=False)
                least, starts, windows = super_kmers(words, window, gram)
                for i in np.flatnonzero(np.isin(signed(least), np.array(chosen, np.int64))):
                    start, count = int(starts[i]), int(windows[i])
                    if not hot:
                        out.add(int(least[i]).to_bytes(8, "little"), doc, fp, start, b" ".join(words[start:start + count + window - 1]))
                    else:
                        for w in range(start, start + count):
                            out.add(xxhash.xxh3_128_digest(b" ".join(words[w:w + window])), doc, fp, w, b"")
                    if out.size > 4 << 20:
                        yield out.take()
        yield out.take()

    return emit


def _counted(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of buckets that come one after the other: the windows whose words start in a smaller document too."""
    def repeated(rows: list[tuple[int, int, int, bytes]]) -> Iterator[tuple[int, int, int]]:
        if min(r[0] for r in rows) == max(r[0] for r in rows):
            return
        seen = []
        for doc, fp, start, words in rows:
            ends = [-1, *(i for i, c in enumerate(words) if c == 32), len(words)]
            seen += [(words[ends[i] + 1:ends[i + window]], doc, fp, start + i) for i in range(len(ends) - window)]
        seen.sort()
        text, least = None, None
        for words, doc, fp, start in seen:
            if words != text:
                text, least = words, doc
            elif doc > least:
                yield doc, fp, start

    def pack(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
        columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int32()))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "start"])

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, found = None, [], []
        for batch in batches(it):
            for k, doc, fp, start, words in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key:
                    if len(rows) > 1:
                        found += repeated(rows)
                    key, rows = k, []
                rows.append((doc, fp, start, words))
            yield pack(found)
            found = []
        if len(rows) > 1:
            yield pack(list(repeated(rows)))

    return counted


def _cut(window: int, with_text: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches(it):
            ids, prints, removed, digests, kept_texts = [], [], [], [], []
            for doc, fp, packed, starts in zip(*(c.to_pylist() for c in batch.columns)):
                words = words_of(unpack.decompress(packed).decode(), lower=False)
                cover = np.zeros(len(words) + 1, np.int64)
                at = np.unique(np.array(starts, np.int64))
                np.add.at(cover, at, 1)
                np.add.at(cover, at + window, -1)
                left = [w for w, c in zip(words, np.cumsum(cover).tolist()) if not c]
                kept = b" ".join(left)
                ids.append(doc)
                prints.append(fp)
                removed.append(len(words) - len(left))
                digests.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append(kept.decode() if with_text else None)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(prints, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()),
                                              pa.array(kept_texts, pa.string())], ["doc_id", "fp", "n_removed", "kept_sha", "kept_text"])

    return cut


def _parts(docs: DataFrame, id_col: str, text_col: str, window: int, gram: int, hot_windows: int, with_text: bool) -> tuple[DataFrame, DataFrame]:
    """All documents with their word counts, and those that lose words with what stays."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = texts(docs, id_col, text_col).withColumn("fp", F.xxhash64("text"))
    row = ["doc_id", "fp"]
    scanned = durable(slim.mapInArrow(_scan(window, gram), "doc_id bigint, fp bigint, n_words bigint, sha string, keys array<bigint>, counts array<bigint>"))
    each = scanned.filter("doc_id is not null").select(*row, F.explode(F.arrays_zip("keys", "counts")).alias("k")).select(
        *row, F.col("k.keys").alias("key"), F.col("k.counts").alias("windows"))
    shared = each.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.sum("windows").alias("windows"))
    shared = shared.filter("lo < hi").select("key", (F.col("windows") > hot_windows).alias("is_hot"))
    mine = each.select(*row, "key").join(shared, "key").groupBy(*row).agg(
        F.collect_set(F.when(~F.col("is_hot"), F.col("key"))).alias("cold"), F.collect_set(F.when(F.col("is_hot"), F.col("key"))).alias("hot"))
    some = durable(slim.join(mine, row).dropDuplicates(row).mapInArrow(_pack, "doc_id bigint, fp bigint, packed binary, cold array<bigint>, hot array<bigint>"))
    part = "key binary, doc_id bigint, fp bigint, start int, words binary"
    sent = some.select(*row, "packed", "cold").mapInArrow(_emit(window, gram, False), part)
    met = sent.repartition(n, "key").sortWithinPartitions("key", *row, "start")
    cold = met.mapInArrow(_counted(window), "doc_id bigint, fp bigint, start int")
    single = some.select(*row, "packed", "hot").filter(F.size("hot") > 0).mapInArrow(_emit(window, gram, True), part).select("key", *row, "start")
    least = single.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("key", "lo")
    hot = single.join(least, "key").filter("doc_id > lo").select(*row, "start")
    starts = cold.unionByName(hot).groupBy(*row).agg(F.collect_list("start").alias("starts"))
    cut = some.select(*row, "packed").join(starts, row).mapInArrow(
        _cut(window, with_text), "doc_id bigint, fp bigint, n_removed bigint, kept_sha string, kept_text string")
    return scanned, cut


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, gram: int = GRAM,
                   hot_windows: int = HOT_WINDOWS) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256``. A word goes when a window
    of ``window`` words over it also starts in a document with a smaller id.

    Neighbouring windows with one minimiser travel as one packed string to the minimiser's bucket. A minimiser that one
    document alone has cannot repeat elsewhere, so its windows stay at home: only hashes are shuffled to find
    that out, with counts pre-aggregated. In a bucket the windows are sorted and neighbours
    compared word by word. A bucket of more than ``hot_windows`` windows is not gathered: its windows are
    grouped by 128-bit hashes, with partial aggregation, so a passage in a third of all documents is
    spread like any other rows.

    Null texts have no words. Words repeated within one document stay. Rows that repeat an id are
    judged each by its own text, never against each other. A row without id keeps all its words.
    """
    scanned, cut = _parts(docs, id_col, text_col, window, gram, hot_windows, False)
    joined = scanned.select("doc_id", "fp", "n_words", "sha").join(cut.select("doc_id", "fp", "n_removed", "kept_sha"), ["doc_id", "fp"], "left")
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"), F.coalesce("kept_sha", "sha").alias("kept_sha256"))


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, gram: int = GRAM,
                hot_windows: int = HOT_WINDOWS) -> DataFrame:
    """``docs`` with its columns; a document that loses words has the kept ones, joined by a space, as its text. All others keep
    their text as it is. A document that loses all words has an empty text."""
    _, cut = _parts(docs, id_col, text_col, window, gram, hot_windows, True)
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    left = docs.select(own, F.col(id_col).cast("bigint").alias("doc_id"),
                       F.xxhash64(F.col(text_col).cast("string")).alias("fp"))
    joined = left.join(cut.select("doc_id", "fp", "kept_text"), ["doc_id", "fp"], "left")
    return joined.select(*[F.coalesce("kept_text", f"_row.`{c}`").alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c)
                           for c in docs.columns])
