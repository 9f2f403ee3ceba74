"""Language identification by unigram models over a fixed vocabulary of pieces, summed over all segmentations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkatlas.llm.text import batches, mix
from linkatlas.llm.wordgrid import Letters, WordGrid
from linkatlas.operators.skew import top_per_group
from linkatlas.session import durable

SAMPLE = 400
ROUNDS = 3
# Words up to this many letters are summed together, in arrays of one width; longer ones one by one, whole.
LONGEST_RUN = 32
UNSEEN = 1e-9
BASE = np.uint64(0x9E3779B97F4A7C15)


def held_out(id_col: str) -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def vocabulary_pieces(path: str) -> list[str]:
    """The word pieces of a sentencepiece model, without its control and byte pieces, lower case."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    wanted = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return sorted({p for i in wanted if (p := model.id_to_piece(i).lower())})


class Pieces:
    """Finds pieces by the hash of their characters: an open-addressing table that arrays of hashes are looked up in at once."""

    def __init__(self, pieces: list[str]):
        self.count, self.longest = len(pieces), max(map(len, pieces), default=1)
        hashes = np.array([self.of(np.array([ord(c) for c in p], np.uint64)) for p in pieces], np.uint64)
        self.mask = np.uint64((1 << 20) - 1)
        self.keys, self.ids, self.depth = np.zeros(1 << 20, np.uint64), np.full(1 << 20, -1, np.int32), 1
        for i, h in enumerate(hashes.tolist()):
            for step in range(64):
                at = (h + step) & int(self.mask)
                if self.ids[at] < 0:
                    self.keys[at], self.ids[at] = h, i
                    self.depth = max(self.depth, step + 1)
                    break

    @staticmethod
    def of(points: np.ndarray) -> int:
        total = 0
        for p in points.tolist():
            total = (total * int(BASE) + p + 1) % (1 << 64)
        return int(mix(np.array([total], np.uint64))[0])

    def find(self, rolled: np.ndarray) -> np.ndarray:
        """Piece numbers of unscrambled character hashes, -1 where there is none."""
        h = mix(rolled)
        out = np.full(len(h), -1, np.int32)
        for step in range(self.depth):
            at = ((h + np.uint64(step)) & self.mask).astype(np.int64)
            hit = self.keys[at] == h
            out[hit] = self.ids[at[hit]]
        return out


def word_rows(grid: WordGrid) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words as rows of characters, a mark for the word's beginning first; their lengths; and the row of each word."""
    width = LONGEST_RUN + 1
    total = np.zeros(len(grid.start), np.uint64)
    for i in range(int(grid.length.max(initial=0))):
        live = grid.length > i
        total[live] = total[live] * BASE + grid.points[grid.start[live] + i].astype(np.uint64) + np.uint64(1)
    _, first, row = np.unique(mix(total), return_index=True, return_inverse=True)
    start, length = grid.start[first], grid.length[first]
    chars = np.zeros((len(first), width), np.uint64)
    chars[:, 0] = ord("▁")
    for i in range(width - 1):
        live = length > i
        chars[live, i + 1] = grid.points[start[live] + i]
    return chars, length + 1, row


def lattice(chars: np.ndarray, lengths: np.ndarray, pieces: Pieces) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """All piece places: (end, length, rows, piece numbers). A single character that is no piece gets the number after the last."""
    out = []
    for end in range(1, int(lengths.max(initial=0)) + 1):
        rows = np.flatnonzero(lengths >= end)
        rolled, power = np.zeros(len(rows), np.uint64), np.array([1], np.uint64)
        for n in range(1, min(end, pieces.longest) + 1):
            rolled = rolled + (chars[rows, end - n] + np.uint64(1)) * power
            power = power * BASE
            found = pieces.find(rolled)
            if n == 1:
                found[found < 0] = pieces.count
            hit = found >= 0
            out.append((end, n, rows[hit], found[hit]))
    return out


def forward(places: list, rows: int, width: int, probs: np.ndarray) -> np.ndarray:
    """Sums over all segmentations: ``alpha[row, end, model]``; ``probs`` is (pieces + 1, models)."""
    alpha = np.zeros((width + 1, rows, probs.shape[1]))
    alpha[0] = 1
    for end, n, at, found in places:
        alpha[end, at] += alpha[end - n, at] * probs[found]
    return alpha


def expected_counts(places: list, lengths: np.ndarray, weights: np.ndarray, probs: np.ndarray, pieces: int) -> np.ndarray:
    """Expected uses of each piece, over all segmentations of each word by its probability."""
    rows, width = len(lengths), int(lengths.max(initial=0))
    alpha = forward(places, rows, width, probs)[:, :, 0]
    whole = alpha[lengths, np.arange(rows)]
    beta = np.zeros((width + 1, rows))
    beta[lengths, np.arange(rows)] = 1
    counts = np.zeros(pieces + 1)
    for end, n, at, found in reversed(places):
        p = probs[found, 0]
        np.add.at(counts, found, weights[at] * alpha[end - n, at] * p * beta[end, at] / whole[at])
        beta[end - n, at] += p * beta[end, at]
    return counts


def _places(word: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All piece places of one word of any length (its mark first): ends, lengths and piece numbers, by end."""
    ends, sizes, found = [], [], []
    rolled, power = np.zeros(len(word), np.uint64), np.array([1], np.uint64)
    for n in range(1, min(len(word), pieces.longest) + 1):
        # At place i stands the hash of the n characters that end there.
        rolled = rolled[1 if n > 1 else 0:] + (word[:len(word) - n + 1] + np.uint64(1)) * power
        power = power * BASE
        ids = pieces.find(rolled)
        if n == 1:
            ids[ids < 0] = pieces.count
        hit = np.flatnonzero(ids >= 0)
        ends.append(hit + n)
        sizes.append(np.full(len(hit), n))
        found.append(ids[hit])
    ends, sizes, found = map(np.concatenate, (ends, sizes, found))
    order = np.lexsort((sizes, ends))
    return ends[order], sizes[order], found[order]


def _log_sums(places: tuple[np.ndarray, np.ndarray, np.ndarray], length: int, logs: np.ndarray, backward: bool = False) -> np.ndarray:
    """Logarithms of the sums over all segmentations up to each place of one word (from each place on, ``backward``), one column a model."""
    ends, sizes, found = places
    at, source = (ends - sizes, ends) if backward else (ends, ends - sizes)
    order = np.argsort(at, kind="stable")
    at, source, value = at[order], source[order], logs[found[order]]
    out = np.full((length + 1, logs.shape[1]), -np.inf)
    out[length if backward else 0] = 0
    cuts = np.searchsorted(at, np.arange(length + 2))
    for i in range(length - 1, -1, -1) if backward else range(1, length + 1):
        part = slice(cuts[i], cuts[i + 1])
        terms = out[source[part]] + value[part]
        top = terms.max(axis=0)
        out[i] = top + np.log(np.exp(terms - top).sum(axis=0))
    return out


def long_log_sums(word: np.ndarray, pieces: Pieces, probs: np.ndarray) -> np.ndarray:
    """The logarithm of the sum over all segmentations of one word, for each model."""
    return _log_sums(_places(word, pieces), len(word), np.log(probs))[-1]


def long_expected_counts(word: np.ndarray, pieces: Pieces, probs: np.ndarray, weight: float) -> np.ndarray:
    """``expected_counts`` of one word of any length; ``probs`` has one model."""
    places, logs = _places(word, pieces), np.log(probs)
    alpha, beta = (_log_sums(places, len(word), logs, backward)[:, 0] for backward in (False, True))
    ends, sizes, found = places
    return np.bincount(found, weight * np.exp(alpha[ends - sizes] + logs[found, 0] + beta[ends] - alpha[-1]), pieces.count + 1)


def _marked(grid: WordGrid, i: int) -> np.ndarray:
    """The characters of one word behind the mark of its beginning."""
    return np.concatenate(([np.uint64(ord("▁"))], grid.points[grid.start[i]:grid.start[i] + grid.length[i]].astype(np.uint64)))


class Model:
    """Languages and the probability of each piece in each."""

    def __init__(self, languages: list[str], pieces: list[str], probs: np.ndarray):
        self.languages, self.pieces, self.probs = languages, pieces, probs
        self.letters, self.finder = Letters(False), None

    def __getstate__(self):
        return self.__dict__ | {"finder": None}

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if self.finder is None:
            self.finder = Pieces(self.pieces)
        grid = WordGrid(texts, self.letters)
        n = len(self.languages)
        if not n or not len(grid.start):
            return ["und"] * len(texts), np.zeros(len(texts))
        long = grid.length > LONGEST_RUN
        short = grid.only(~long)
        chars, lengths, row = word_rows(short)
        alpha = forward(lattice(chars, lengths, self.finder), len(lengths), int(lengths.max(initial=0)), self.probs)
        logs = np.log(alpha[lengths, np.arange(len(lengths))] + 1e-300)
        total = np.stack([np.bincount(short.doc, logs[row, i], len(texts)) for i in range(n)], axis=1).astype(float)
        for i in np.flatnonzero(long):
            total[grid.doc[i]] += long_log_sums(_marked(grid, i), self.finder, self.probs)
        total -= total.max(axis=1, keepdims=True)
        share = np.exp(total)
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        some = grid.words > 0
        return [self.languages[b] if s else "und" for b, s in zip(best.tolist(), some.tolist())], np.where(some, share.max(axis=1), 0.0)


def fit(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, rounds: int = ROUNDS) -> Model:
    """Piece probabilities per language from at most ``sample`` documents of each, those of least id hash among the ones that
    are not held out and have a language. Their words are counted on Spark, and each round of
    expectation maximisation sums expected piece counts there; the driver holds one number per piece and language."""
    spark = docs.sparkSession
    pieces = vocabulary_pieces(path)
    known = docs.filter(~held_out(id_col) & F.col(lang_col).isNotNull()).select(
        F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), F.col(lang_col).cast("string").alias("lang"))
    # A language may own most documents, so its ids are thinned in buckets first.
    chosen = top_per_group(known.select("_id", "lang"), ["lang"], [F.xxhash64("_id"), F.col("_id")], sample, ["_id"], "at").select("_id", "lang").distinct()
    letters = Letters(False)

    def words(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 2 << 20):
            langs = batch.column(0).to_pylist()
            grid = WordGrid(batch.column(1).to_pylist(), letters)
            found = [grid.points[s:s + n].tobytes().decode("utf-32-le", "surrogatepass") for s, n in zip(grid.start.tolist(), grid.length.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([langs[d] for d in grid.doc.tolist()], pa.string()), pa.array(found, pa.string())], ["lang", "word"])

    texts = known.select("_id", "_text").join(F.broadcast(chosen), "_id").select("lang", "_text")
    counted = durable(texts.mapInArrow(words, "lang string, word string").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")))
    languages = sorted(r[0] for r in counted.select("lang").distinct().collect())
    probs = np.full((len(pieces) + 1, len(languages)), 1 / max(1, len(pieces)))
    for _ in range(rounds):
        state = spark.sparkContext.broadcast(Model(languages, pieces, probs))

        def expect(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, finder = state.value, None
            totals = np.zeros((len(model.pieces) + 1, len(model.languages)))
            for batch in it:
                finder = finder or Pieces(model.pieces)
                langs, found, n = np.array(batch.column(0).to_pylist()), batch.column(1).to_pylist(), batch.column(2).to_numpy()
                for i, lang in enumerate(model.languages):
                    own = np.flatnonzero(langs == lang)
                    for at in range(0, len(own), 20_000):
                        part = own[at:at + 20_000]
                        grid = WordGrid([found[j] for j in part], letters)
                        long = grid.length > LONGEST_RUN
                        short = grid.only(~long)
                        chars, lengths, row = word_rows(short)
                        weights = np.bincount(row, n[part][short.doc], len(lengths))
                        totals[:, i] += expected_counts(lattice(chars, lengths, finder), lengths, weights, model.probs[:, [i]], len(model.pieces))
                        for j in np.flatnonzero(long):
                            totals[:, i] += long_expected_counts(_marked(grid, j), finder, model.probs[:, [i]], float(n[part][grid.doc[j]]))
            piece, lang = np.nonzero(totals)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(lang), pa.array(totals[piece, lang])], ["piece", "lang", "n"])

        sums = counted.mapInArrow(expect, "piece bigint, lang bigint, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros_like(probs)
        counts[sums.column("piece").to_numpy(), sums.column("lang").to_numpy()] = sums.column("n").to_numpy()
        probs = np.maximum((counts + 1e-3) / (counts.sum(axis=0) + 1e-3 * len(counts)), UNSEEN)
    return Model(languages, pieces, probs)


def _judge(model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def judge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 1 << 20):
            langs, scores = model.value.judge(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             ["doc_id", "held_out", "lang_pred", "score"])

    return judge


def identified(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``lang_pred``, ``score``.

    A word's probability in a language is the sum over all ways to cut it into pieces of a public vocabulary of the products of the
    pieces' probabilities, by the forward algorithm; the whole text's is the product over its words. ``score`` is the share of the
    language among all (even odds before). A text that is null or has no letter is ``und`` with score 0, as are all
    texts when no row can be learned from. A run of letters is one word, however long. A null id counts as held out; repeated rows
    get a row each. Scoring needs no shuffle.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, path, id_col, text_col, lang_col, sample))
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(held_out(id_col), F.lit(True)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(_judge(model), "doc_id bigint, held_out boolean, lang_pred string, score double")
