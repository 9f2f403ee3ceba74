"""Byte-pair encoding of whole texts with public vocabularies. Tokenizers are read from files and never trained."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from linkatlas.llm.text import batches, texts

CACHED = 300_000
LONGEST_KEPT = 64
SHORT = 256
NEVER = 1 << 60
# Beyond the Latin letters, libraries differ in the Unicode version they know, so whole words go to the library.
LATIN_END = "\u024f"
# The pre-token patterns of the two vocabularies.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
ENDS = ".,;:!?)"
# Characters that some reading takes for white space, besides the space and the line feed.
OTHER_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B)))


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it prints, else the next one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


class RankArrayBpe:
    """Merges of one vocabulary. A short word is a contiguous array of parts with the ranks of its neighbours: the
    least rank is looked for, its boundary deleted and the two ranks beside it refreshed, until none is left. Words over
    ``SHORT`` symbols use a heap over linked parts, so that a very long one costs n log n; the merges are the same."""

    def __init__(self, vocab: dict[str, int], merges: list):
        self.size = max(vocab.values()) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.merged = [vocab[a + b] for a, b in pairs]
        self.rank = {vocab[a] * self.size + vocab[b]: r for r, (a, b) in reversed(list(enumerate(pairs)))}

    def merge(self, ids: list[int]) -> list[int]:
        if len(ids) > SHORT:
            return self._merge_long(ids)
        rank, merged, size = self.rank, self.merged, self.size
        ranks = [rank.get(a * size + b, NEVER) for a, b in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == NEVER:
                break
            i = ranks.index(least)
            part = merged[least]
            ids[i:i + 2] = [part]
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get(ids[i - 1] * size + part, NEVER)
            if i < len(ranks):
                ranks[i] = rank.get(part * size + ids[i + 1], NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, rank, size = len(ids), self.rank, self.size
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := rank.get(a * size + b)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = self.merged[r], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (q := rank.get(ids[x] * size + ids[y])) is not None:
                    heapq.heappush(heap, (q, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]


class _Memo(dict):
    """Results by key, in two generations of at most ``kept`` each: what the older one holds is taken over when
    it is asked for again, the rest is forgotten, so that memory stays bounded and common words stay known. Long keys are never kept."""

    def __init__(self, make: Callable, kept: int = CACHED):
        super().__init__()
        self.make, self.kept, self.older = make, kept, {}

    def __missing__(self, key):
        if len(key) > LONGEST_KEPT:
            return self.make(key)
        if len(self) >= self.kept:
            self.older = dict(self)
            self.clear()
        value = self.older.pop(key, None)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def forget(self) -> None:
        self.clear()
        self.older = {}


def packed_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class ByteEncoder:
    """Byte-level BPE: ids of whole texts and texts of ids. Made from the text of a ``tokenizer.json``; caches fill in the tasks."""

    def __init__(self, source: str):
        self.source = source
        self.ready = False

    def __getstate__(self):
        return {"source": self.source, "ready": False}

    def _open(self) -> None:
        spec = json.loads(self.source)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        self.bpe = RankArrayBpe(vocab, spec["model"]["merges"])
        self.byte_id = [vocab[c] for c in letters]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        back = {c: b for b, c in enumerate(letters)}
        self.table = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.table[i] = bytes(back[c] for c in token)
        self.split = regex.compile(BYTE_PATTERN)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.edge = re.compile(r"(?<=\S)(?= )")
        self.piece = _Memo(lambda word: packed_ids(self.bpe.merge([self.byte_id[b] for b in word.encode()])))
        self.head = _Memo(self._segment)
        self.tail = _Memo(lambda word: self._segment(" " + word))
        self.ready = True

    def _segment(self, text: str) -> bytes:
        out = []
        for i, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if i % 2:
                out.append(packed_ids([self.special[part]]))
            else:
                out += map(self.piece.__getitem__, self.split.findall(part))
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers. The text is cut before spaces that follow a character that is
        not white space: no pre-token spans such a place, so each segment is encoded once and remembered."""
        if not self.ready:
            self._open()
        if not text:
            return b""
        plain = "  " not in text and " \n" not in text and "\n " not in text and not any(c in text for c in OTHER_SPACE)
        if plain:
            first, *rest = text.split(" ")
            return b"".join([self.head[first], *map(self.tail.__getitem__, rest)])
        return b"".join(map(self.head.__getitem__, self.edge.split(text)))

    def decode(self, ids: bytes) -> str:
        if not self.ready:
            self._open()
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


class WordEncoder:
    """Ids of whole texts under a vocabulary that drops white space, taken word by word from the tokenizers library,
    whose merges are asked once per distinct part and remembered."""

    def __init__(self, source: str):
        self.source = source
        self.ready = False

    def __getstate__(self):
        return {"source": self.source, "ready": False}

    def _open(self) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(self.source)
        self.model = self.library.model
        self.tokenize = self.model.tokenize
        special = [re.escape(t["content"].encode()) for t in json.loads(self.source)["added_tokens"]]
        self.marked = re.compile(b"|".join(special) if special else rb"(?!)").search
        self.letters = byte_letters()
        self.split = regex.compile(WORD_PATTERN)
        # A word of small letters is its own part, so parts need little room and words get the more.
        self.part = _Memo(self._part, CACHED // 10)
        self.word = _Memo(self._word, 2 * CACHED)
        self.ready = True

    def forget(self) -> None:
        """Lets go of the remembered words, so that a worker between two tasks holds the vocabulary alone."""
        if self.ready:
            self.part.forget()
            self.word.forget()

    def _part(self, part: str) -> bytes:
        letters = part if part.isascii() and part.isprintable() else "".join([self.letters[b] for b in part.encode()])
        return packed_ids([t.id for t in self.tokenize(letters)])

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if self.marked(word) or not text.isascii() and max(text) > LATIN_END:
            return packed_ids(self.library.encode(text, add_special_tokens=False).ids)
        text = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).lower()
        # Most words are letters alone, or letters and one closing mark; the pattern is asked about the others.
        if text.isalpha():
            return self._part(text) if (small := text.encode()) == word else self.word[small]
        if text[:-1].isalpha() and text[-1] in ENDS:
            return self.word[text[:-1].encode()] + self.part[text[-1]]
        return b"".join(map(self.part.__getitem__, self.split.findall(text)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers. White space between words is dropped, so words are independent."""
        if not self.ready:
            self._open()
        return b"".join(map(self.word.__getitem__, text.encode().split())) if text else b""


def _digests(encoder) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def digest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder.value
        for batch in batches(it):
            counts, ids_sha, text_sha = [], [], []
            for text in batch.column(1).to_pylist():
                ids = own.encode(text or "")
                counts.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return digest


def _coder(encoder, name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder.value
        for batch in batches(it):
            if name == "ids":
                out = pa.array([np.frombuffer(own.encode(t or ""), "<u4").astype(np.int32) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            else:
                out = pa.array([own.decode(np.array(i or [], "<u4").tobytes()) for i in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), out], ["doc_id", name])

    return run


def shared_encoder(spark, path: str, kind: type = ByteEncoder):
    """The vocabulary, a file of fixed size, as a broadcast that each Python worker opens once."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(kind(f.read()))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", kind: type = ByteEncoder) -> DataFrame:
    """``doc_id`` and ``ids array<int>`` of every whole text. A null or empty text has no ids; strings of special tokens in a
    text become those tokens, as in the tokenizers library. One row per input row, repeated and null ids too."""
    encoder = shared_encoder(docs.sparkSession, path, kind)
    return texts(docs, id_col, text_col).mapInArrow(_coder(encoder, "ids"), "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``text`` of the ``ids``, special tokens kept; bytes that are no UTF-8 become replacement characters."""
    encoder = shared_encoder(encoded.sparkSession, path)
    return encoded.select("doc_id", "ids").mapInArrow(_coder(encoder, "text"), "doc_id bigint, text string")


def coding_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode`` and ``decode`` in one pass per document, reported as ``n_tokens``, ``ids_sha256`` (ids as little-endian
    unsigned 32-bit integers) and ``decoded_sha256``. No shuffle; a null text counts as empty."""
    encoder = shared_encoder(docs.sparkSession, path)
    return texts(docs, id_col, text_col).mapInArrow(
        _digests(encoder), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
