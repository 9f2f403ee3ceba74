"""Toxicity scores: a learned lexicon in a trie, met by Levenshtein automata, with the words around each hit."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkatlas.llm.language import held_out
from linkatlas.llm.minhash import shingle_set
from linkatlas.llm.text import batches, release
from linkatlas.llm.wordgrid import Letters, WordGrid
from linkatlas.session import durable

SAMPLE = 4000
SENT = 2_000_000
FOLDS = 3
STEM_LENGTHS = range(3, 9)
# How many deviations the bound of the log odds lies below their estimate, and the least bound of a term.
DEVIATIONS = 1.64
LEAST = 1.1
# A term needs this many toxic texts, and this share of them, so that chance finds do not grow with the table.
FEWEST, SHARE = 3, 0.002
# Letters of all terms together, and states that edits of them may take, which bound the automaton and its broadcast.
LETTERS = 10_000
STATES = 12_000
STATES_A_LETTER = (0, 8, 40)
CANDIDATES = 20_000
NEAR = 8
# Terms up to this length must be met as they are.
PLAIN = 3
KINDS = 3
EXACT, FUZZY, STEM = range(KINDS)
# Marks that open or close a quotation.
QUOTES = '"“”„«»‹›‟「」'


class Lexicon:
    """A trie over terms and stems, and the automaton of all words within the edit distance that a term allows: none up to
    ``PLAIN`` letters, one up to nine, two beyond. A stem accepts any word that begins with it. Once the edits of the terms before it take ``states``, a term allows none."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float], states: int = STATES):
        self.terms, self.stems = terms, stems
        self.exact = set()
        for word in terms:
            states -= (cost := STATES_A_LETTER[self.edits(word)] * len(word))
            if states < 0:
                self.exact.add(word)
                states += cost
        self.letters = sorted({c for w in [*terms, *stems] for c in w})
        self._trie()
        self._automaton()

    def _trie(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.term_at: dict[int, str] = {}
        self.stem_at: dict[int, str] = {}
        # The most edits that any term below a node allows.
        self.allowed = [0]
        for word, ends in [*((w, self.term_at) for w in self.terms), *((w, self.stem_at) for w in self.stems)]:
            node, most = 0, self.edits(word) if ends is self.term_at and word not in self.exact else 0
            self.allowed[0] = max(self.allowed[0], most)
            for c in word:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.allowed.append(0)
                node = self.next[node][c]
                self.allowed[node] = max(self.allowed[node], most)
            ends[node] = word

    @staticmethod
    def edits(word: str) -> int:
        return 0 if len(word) <= PLAIN else 1 if len(word) <= 9 else 2

    def _close(self, state: dict[int, int]) -> frozenset:
        """Adds what is reached by leaving out letters of the lexicon; keeps the least edits per node."""
        todo = list(state.items())
        while todo:
            node, e = todo.pop()
            for child in self.next[node].values():
                if e + 1 <= self.allowed[child] and e + 1 < state.get(child, 99):
                    state[child] = e + 1
                    todo.append((child, e + 1))
        return frozenset(state.items())

    def _step(self, state: frozenset, letter: str | None) -> tuple[frozenset, list[str]]:
        out: dict[int, int] = {}
        for node, e in state:
            if node >= 0:
                moves = [(node, e + 1), *((child, e + (c != letter)) for c, child in self.next[node].items())]
                for to, edits in moves:
                    if edits <= (self.allowed[to] if edits else 99) and edits < out.get(to, 99):
                        out[to] = edits
        return self._close(out), [self.stem_at[n] for n, e in out.items() if e == 0 and n in self.stem_at]

    def _automaton(self) -> None:
        """Subset construction; a state is the trie nodes reachable with the edits spent, and the best stem seen so far."""
        start = (self._close({0: 0}), None)
        number, todo = {start: 1}, [start]
        classes = len(self.letters) + 1
        rows = [[0] * classes, None]
        kinds, weights = [-1, -1], [0.0, 0.0]
        moved: dict[frozenset, list] = {}
        while todo:
            state = todo.pop()
            nodes, stem = state
            if nodes not in moved:
                # Letters that lead on from no node of the state all do what a foreign letter does.
                own, other = {c for n, _ in nodes if n >= 0 for c in self.next[n]}, self._step(nodes, None)
                moved[nodes] = [self._step(nodes, c) if c in own else other for c in [*self.letters, None]]
            row = []
            for to, found in moved[nodes]:
                best = max([*found, *([stem] if stem else [])], key=lambda s: self.stems[s], default=None)
                target = (to, best)
                if not to and best is None:
                    row.append(0)
                    continue
                if target not in number:
                    number[target] = len(number) + 1
                    rows.append(None)
                    kinds.append(-1)
                    weights.append(0.0)
                    todo.append(target)
                row.append(number[target])
            at = number[state]
            rows[at] = row
            ends = [(e, -self.terms[w], w) for n, e in nodes if (w := self.term_at.get(n)) and e <= (0 if w in self.exact else self.edits(w))]
            if ends and (min(ends)[0] == 0 or stem is None):
                e, _, word = min(ends)
                kinds[at], weights[at] = (EXACT if e == 0 else FUZZY), self.terms[word]
            elif stem is not None:
                kinds[at], weights[at] = STEM, self.stems[stem]
        self.table = np.array(rows, np.int32).reshape(-1, classes)
        self.kind, self.weight = np.array(kinds, np.int8), np.array(weights)
        self.of_point = {ord(c): i for i, c in enumerate(self.letters)}

    def run(self, grid: WordGrid) -> np.ndarray:
        """The final state of each word, 0 where the automaton stops. All words take one step at a time together."""
        classes = np.full(0x110000, len(self.letters), np.uint16)
        for point, c in self.of_point.items():
            classes[point] = c
        state, live = np.ones(len(grid.start), np.int32), np.arange(len(grid.start))
        for i in range(int(grid.length.max(initial=0))):
            live = live[grid.length[live] > i]
            now = self.table[state[live], classes[grid.points[grid.start[live] + i]]]
            state[live] = now
            live = live[now > 0]
            if not len(live):
                break
        return state


def features(texts: list[str | None], lexicon: Lexicon, letters: Letters) -> np.ndarray:
    """Per text: hit weights by kind outside quotations, the weight inside them, weight per word, distinct hits and length.

    A hit lies in a quotation if, within ``NEAR`` words, a quotation mark stands before it and another one after it.
    """
    grid = WordGrid(texts, letters)
    out = np.zeros((len(texts), 8))
    out[:, 7] = np.log1p(grid.words) / 5
    if not len(grid.start):
        return out
    state = lexicon.run(grid)
    hits = np.flatnonzero(lexicon.kind[state] >= 0)
    if not len(hits):
        return out
    marks = np.flatnonzero(np.isin(grid.points, [ord(c) for c in QUOTES]))
    doc = grid.doc[hits]
    bounds = np.concatenate(([0], np.cumsum(grid.words)))
    first, last = np.maximum(hits - NEAR, bounds[doc]), np.minimum(hits + NEAR, bounds[doc + 1] - 1)
    begin, end = grid.start[hits], grid.start[hits] + grid.length[hits]
    before = np.searchsorted(marks, begin) - np.searchsorted(marks, np.maximum(grid.start[first] - 2, 0))
    after = np.searchsorted(marks, grid.start[last] + grid.length[last] + 2) - np.searchsorted(marks, end)
    quoted = (before > 0) & (after > 0)
    kind, weight = lexicon.kind[state[hits]], lexicon.weight[state[hits]]
    for k in range(KINDS):
        own = (kind == k) & ~quoted
        out[:, k] = np.log1p(np.bincount(doc[own], weight[own], len(texts)))
    out[:, 3] = np.log1p(np.bincount(doc[quoted], weight[quoted], len(texts)))
    total = np.bincount(doc[~quoted], weight[~quoted], len(texts))
    out[:, 4] = np.log1p(100 * total / np.maximum(grid.words, 20))
    pairs = np.unique(doc.astype(np.int64) * len(lexicon.kind) + state[hits]) // len(lexicon.kind)
    out[:, 5] = np.log1p(np.bincount(pairs, minlength=len(texts)))
    out[:, 6] = np.bincount(doc, weight, len(texts)) > 0
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> np.ndarray:
    """Weights of a logistic regression, the constant last, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - ridge * w
        curve = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Scorer:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray):
        self.lexicon, self.weights, self.letters = lexicon, weights, Letters(True)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        x = features(texts, self.lexicon, self.letters)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def own_terms(text: str | None) -> list[str]:
    """The distinct words of a text, and its stems, marked by a star: beginnings that two or more of its longer words share."""
    words = set("".join(c if c.isalnum() else " " for c in (text or "").lower()).split())
    begins = Counter(w[:n] for w in words for n in STEM_LENGTHS if len(w) > n)
    return [*(w for w in words if 3 <= len(w) <= 24), *(b + "*" for b, n in begins.items() if n > 1)]


def _terms(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of a batch have each term, by cell (fold and label)."""
    for batch in batches(it, 2 << 20):
        counts: dict[int, Counter] = defaultdict(Counter)
        for cell, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[cell].update(own_terms(text))
        for cell, own in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array([cell] * len(own), pa.int32()), pa.array(list(own.values()), pa.int64())], ["term", "cell", "n"])


def _families(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least hash among the runs of five words of each text: near copies mostly have the same one. A text without words is a family of its own."""
    for batch in batches(it, 2 << 20):
        least = [int(s.min()) if len(s := shingle_set(t, 5)) else None for t in batch.column(2).to_pylist()]
        own = pa.array([None if x is None else x - (1 << 63) for x in least], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), own], ["_id", "toxic", "family"])


def evidence(p: Column, n: Column, pos: int, neg: int) -> Column:
    """A lower bound of the smoothed log odds of a term that ``p`` of ``pos`` toxic texts and ``n`` of ``neg`` others have. It asks for
    a clear ratio, not for many texts, so a term of a small table or of a rare language counts as well."""
    odds = F.log((p + 0.5) / (pos + 1)) - F.log((n + 0.5) / (neg + 1))
    return odds - DEVIATIONS * F.sqrt(1 / (p + 0.5) + 1 / (n + 0.5))


def pick(found: list[tuple[str, int, float]], letters: int = LETTERS) -> Lexicon:
    """Terms (term, toxic texts, evidence), best first, without what those before them cover: words and longer stems that begin
    with a stem, and stems of no more toxic texts than one of the terms they begin. All that fit into ``letters`` are taken."""
    words: dict[str, float] = {}
    stems: dict[str, float] = {}
    begun: dict[str, int] = {}
    for term, p, bound in sorted(found, key=lambda x: (-x[2], -len(x[0]), x[0])):
        word = term.rstrip("*")
        if any(word[:n] in stems for n in STEM_LENGTHS if n <= len(word)) or term != word and p < begun.get(word, -1) + 2 or len(word) > letters:
            continue
        (words if term == word else stems)[word] = bound
        letters -= len(word)
        for n in STEM_LENGTHS:
            if n < len(word) or n == len(word) and term == word:
                begun[word[:n]] = max(begun.get(word[:n], 0), p)
    return Lexicon(words, stems)


def learn_lexicons(labelled: DataFrame) -> list[Lexicon]:
    """A lexicon from each choice of all folds but one, and last the one from all. ``labelled`` has ``cell`` (twice the fold, plus
    the label) and ``text``; its rows are all counted, on Spark, and only terms of sufficient evidence come to the driver."""
    total = {r["cell"]: r["count"] for r in labelled.groupBy("cell").count().collect()}
    cells = [F.sum(F.when(F.col("cell") == c, F.col("n")).otherwise(0)).alias(f"c{c}") for c in range(2 * FOLDS)]
    counts = labelled.select("cell", "text").mapInArrow(_terms, "term string, cell int, n bigint").groupBy("term").agg(*cells)
    out, bounds = [], []
    for left in range(FOLDS + 1):
        folds = [k for k in range(FOLDS) if k != left]
        neg, pos = (sum(total.get(2 * k + y, 0) for k in folds) for y in (0, 1))
        n, p = (sum((F.col(f"c{2 * k + y}") for k in folds), F.lit(0)) for y in (0, 1))
        known = pos > 0 and neg > 0
        bounds += [p.alias(f"p{left}"), (F.when((p >= FEWEST) & (p >= SHARE * pos), evidence(p, n, pos, neg)) if known else F.lit(None).cast("double")).alias(f"b{left}")]
    strong = counts.select("term", *bounds).filter(F.greatest(*(F.coalesce(F.col(f"b{k}"), F.lit(-1.0)) for k in range(FOLDS + 1))) >= LEAST)
    strong = durable(strong)
    for k in range(FOLDS + 1):
        best = strong.filter(F.col(f"b{k}") >= LEAST).orderBy(F.desc(f"b{k}"), "term").limit(CANDIDATES)
        out.append(pick([(r[0], r[1], r[2]) for r in best.select("term", f"p{k}", f"b{k}").collect()]))
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Scorer:
    """Learns from the labelled documents that are not held out: the lexicon from all of them, the weights of what is found from at
    most ``sample`` of each label, those of least id hash. There each document is read with the lexicon of the other folds, so that
    terms which only happened to be rare do not count twice. Of near copies with one label only the least id counts, and a family of them is in one fold."""
    known = durable(labels.filter(~held_out(id_col) & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("toxic")))
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    # Labels are sent to all texts while they are few; many are joined as Spark decides.
    sent = F.broadcast(known) if known.count() <= SENT else known
    kind = dict(known.dtypes)["_id"]
    told = durable(slim.join(sent, "_id").select("_id", "toxic", "text").mapInArrow(_families, f"_id {kind}, toxic int, family bigint"))
    family = F.coalesce("family", F.xxhash64("_id"))
    once = told.groupBy(family.alias("family"), "toxic").agg(F.min("_id").alias("_id"))
    once = durable(once.select("_id", "toxic", F.pmod(F.xxhash64("family", F.lit(3)), F.lit(FOLDS)).cast("int").alias("fold")))
    sent = F.broadcast(once) if once.count() <= SENT else once
    lexicons = learn_lexicons(slim.join(sent, "_id").select((2 * F.col("fold") + F.col("toxic")).alias("cell"), "text"))
    order = [F.xxhash64("_id"), F.col("_id")]
    chosen = once.filter("toxic = 1").orderBy(*order).limit(sample).unionByName(once.filter("toxic = 0").orderBy(*order).limit(sample))
    shared = docs.sparkSession.sparkContext.broadcast((lexicons[:-1], Letters(True)))

    def measure(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, letters = shared.value
        for batch in batches(it, 2 << 20):
            folds, texts = batch.column(1).to_numpy(), batch.column(2).to_pylist()
            x = np.zeros((len(texts), 8))
            for k in range(FOLDS):
                at = np.flatnonzero(folds == k)
                x[at] = features([texts[i] for i in at], own[k], letters)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x.tolist(), pa.list_(pa.float64()))], ["toxic", "x"])

    rows = slim.join(F.broadcast(chosen), "_id").select("toxic", "fold", "text").mapInArrow(measure, "toxic int, x array<double>").toArrow()
    y = rows.column("toxic").to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return Scorer(lexicons[-1], np.append(np.zeros(8), -4.0))
    x = np.array(rows.column("x").to_pylist())
    order = np.lexsort([*x.T, y])
    return Scorer(lexicons[-1], logistic(x[order], y[order]))


def _scored(scorer) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 2 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scorer.value(batch.column(2).to_pylist()))], ["doc_id", "held_out", "score"])

    return score


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``score`` (0 to 1), ``predicted`` (1 from 0.5 on).

    Whole texts are read by one automaton over the lexicon (``Lexicon``); what it accepts is weighed by kind of match and by the
    words around it (``features``). All labelled rows count for the lexicon, a bounded sample for the weights; scoring needs no shuffle. Null and empty texts, and all texts
    where nothing can be learned, get the score of a text without hits. A null id counts as held out; repeated rows get a row each.
    """
    scorer = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, sample=sample))
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(held_out(id_col), F.lit(True)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    scored = slim.mapInArrow(_scored(scorer), "doc_id bigint, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the documents that are scored toxic, with its own columns, in one pass."""
    scorer = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, sample=sample))

    def below(texts: Column) -> Column:
        @F.arrow_udf("boolean")
        def judge(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for part in parts:
                yield pa.array(np.concatenate([scorer.value(part.slice(i, 500).to_pylist()) for i in range(0, len(part), 500)] or [np.zeros(0)]) < 0.5)
            release()

        return judge(texts)

    return docs.filter(below(F.col(f"`{text_col}`").cast("string")))
