"""What toxicity learns and measures, against brute force; families of near copies; short and foreign terms."""

import math
import random
import re

import pytest

from linkatlas.llm import toxicity
from linkatlas.llm.wordgrid import Letters


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_counts_and_evidence_equal_brute_force(spark):
    draw = random.Random(2)
    rows = []
    for i in range(300):
        bad = i % 4 == 0
        words = [f"w{draw.randrange(40)}" for _ in range(draw.randrange(1, 12))]
        if bad:
            words += draw.sample(["idiot", "idiots", "moron", "trash"], 2)
        rows.append((2 * (i % 3) + bad, " ".join(words)))
    rows += [(0, None), (1, "")]
    labelled = spark.createDataFrame(rows, "cell int, text string")
    lexicons = toxicity.learn_lexicons(labelled)
    for left in range(toxicity.FOLDS + 1):
        used = [(c % 2, set(toxicity.own_terms(t))) for c, t in rows if c // 2 != left]
        pos, neg = sum(y for y, _ in used), sum(1 - y for y, _ in used)
        found = []
        for term in set().union(*(t for _, t in used)):
            p, n = sum(y and term in t for y, t in used), sum((not y) and term in t for y, t in used)
            if p >= toxicity.FEWEST and p >= toxicity.SHARE * pos:
                odds = math.log((p + 0.5) / (pos + 1)) - math.log((n + 0.5) / (neg + 1))
                bound = odds - toxicity.DEVIATIONS * math.sqrt(1 / (p + 0.5) + 1 / (n + 0.5))
                if bound >= toxicity.LEAST:
                    found.append((term, p, bound))
        want = toxicity.pick(found)
        got = lexicons[left]
        assert set(got.terms) == set(want.terms) and set(got.stems) == set(want.stems) and got.terms
        assert all(got.terms[w] == pytest.approx(want.terms[w]) for w in want.terms)


def test_features_equal_brute_force():
    lexicon = toxicity.Lexicon({"scum": 2.0, "idiot": 3.0, "worthless": 1.5}, {"mor": 2.5})
    texts = [None, "", "You SCUM, you scvm", 'he said "you idiot" today', "idiot " * 3, "worthlss moron", "morons and sc um", "nothing here", "“idoit” far away " + "x " * 30 + "idiot", "scu"]
    got = toxicity.features(texts, lexicon, Letters(True))
    for row, text in zip(got, texts):
        low = (text or "").lower()
        words = [(m.start(), m.end(), m.group()) for m in re.finditer(r"[^\W_]+", low)]
        sums, quoted_sum, distinct = [0.0, 0.0, 0.0], 0.0, 0
        for i, (begin, end, word) in enumerate(words):
            ways = [(distance(word, t), -w, t) for t, w in lexicon.terms.items() if distance(word, t) <= lexicon.edits(t)]
            stem = max((w for s, w in lexicon.stems.items() if word.startswith(s)), default=None)
            if ways and (min(ways)[0] == 0 or stem is None):
                kind, weight = (0 if min(ways)[0] == 0 else 1), -min(ways)[1]
            elif stem is not None:
                kind, weight = 2, stem
            else:
                continue
            first, last = words[max(0, i - toxicity.NEAR)], words[min(len(words) - 1, i + toxicity.NEAR)]
            marks = [j for j, c in enumerate(low) if c in toxicity.QUOTES]
            inside = any(max(first[0] - 2, 0) <= j < begin for j in marks) and any(end <= j < last[1] + 2 for j in marks)
            if inside:
                quoted_sum += weight
            else:
                sums[kind] += weight
        want = [*map(math.log1p, sums), math.log1p(quoted_sum), math.log1p(100 * sum(sums) / max(len(words), 20))]
        assert row[:5] == pytest.approx(want), text
        assert row[7] == pytest.approx(math.log1p(len(words)) / 5)


def test_short_terms_may_be_misspelled():
    lexicon = toxicity.Lexicon({"scum": 2.0, "ass": 1.0}, {})
    got = toxicity.features(["scvm", "scm", "scums", "sccuum", "as", "ass"], lexicon, Letters(True))
    assert (got[:3, 1] > 0).all() and not got[3:5, :3].any() and got[5, 0] > 0


def test_near_copies_count_once(spark):
    """Two hundred copies of one harmless toxic-labelled notice must not make its words a lexicon."""
    draw = random.Random(5)
    neutral = [" ".join(f"n{draw.randrange(300)}" for _ in range(30)) for _ in range(300)]
    notice = "please mind the gap between the train and the platform edge when you leave"
    docs = [(i, neutral[i] + (" vile scum" if i % 3 == 0 else "")) for i in range(300)] + [(1000 + i, f"{notice} {i}") for i in range(200)]
    labels = [(i, int(i % 3 == 0)) for i in range(300)] + [(1000 + i, 1) for i in range(200)]
    table, marks = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    scorer = toxicity.fit(table, marks)
    assert {"vile", "scum"} <= set(scorer.lexicon.terms) | set(scorer.lexicon.stems)
    assert not {"train", "platform", "please"} & set(scorer.lexicon.terms)
