"""Hard negatives, licence scans and the prefix trie against brute force on awkward rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkatlas.llm import licenses, negatives, prefixtrie, scores

VECTORS = "vec_id bigint, embedding array<double>, label int, id string, block string, number int, score double"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, label, "a", "b", 1, 2.0) for i, v, label in rows], VECTORS)


def sound(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def negatives_brute(rows, positives=5, wanted=3, scale=256):
    top = scores.TOP
    good = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if i is not None and label is not None and sound(v)]
    dot = lambda a, b: max(-top, min(top, sum(x * y for x, y in zip(a, b))))
    anchors = {}
    for i, v, label in good:
        if i % 10 == 0:
            anchors[i] = min(anchors.get(i, (len(v), label, v)), (len(v), label, v))
    out = []
    for a, (_, label, v) in anchors.items():
        met = sorted((-dot(v, w), i, other) for i, w, other in good if i != a and len(w) == len(v))
        for p in [m for m in met if m[2] == label][:positives]:
            fits = [m for m in met if m[2] != label and 50 * -p[0] <= 100 * -m[0] <= 95 * -p[0]][:wanted]
            out += [(a, p[1], rank, m[1], -p[0], -m[0]) for rank, m in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows):
    got = negatives.hard_negatives(vectors_of(spark, rows), F.col("id") % 10 == 0)
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got.collect())


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    draw = random.Random(5)
    rows = [(i, [draw.gauss(1, 1) for _ in range(6)], i * 7 % 4) for i in range(300)]
    rows += [(1000 + i, [1.0, 0.5, 1.0, 0.25, 1.0, 1.0], i % 3) for i in range(120)]
    rows += [(2000, None, 1), (2010, [], 1), (2020, [1.0, None], 1), (2030, [float("nan")] * 6, 1), (2040, [float("inf")] * 6, 1), (2050, [1.0] * 6, None),
             (None, [1.0] * 6, 1), (2060, [1.0, 2.0], 1), (2061, [2.0, 2.0], 1), (2062, [1.0, 1.0], 2), (2070, [3.0] * 6, 1), (2070, [3.0] * 6, 1), (2080, [0.0] * 6, 2)]
    for block, anchors, zones, share in ((1024, 256, 256, 64), (16, 8, 4, 2)):
        for name, value in (("BLOCK", block), ("ANCHORS", anchors), ("ZONES", zones), ("BLOCKS_A_TASK", share)):
            monkeypatch.setattr(negatives, name, value)
        assert mined(spark, rows) == negatives_brute(rows)
    assert mined(spark, rows[:0]) == [] and mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []


def test_hard_negatives_of_any_finite_size(spark):
    draw = random.Random(6)
    for size in (1e7, 1e10, 1.7e308):
        rows = [(i, [draw.gauss(0.5, 1) for _ in range(4)], i % 3) for i in range(60)] + [
            (100 + i, [draw.choice([0.0, size, -size, size / 3, 1.0]) for _ in range(4)], i % 3) for i in range(20)]
        if size > 1e307:
            largest = scores.GREATEST / 256
            want = negatives_brute([(i, [max(-largest, min(largest, x)) for x in v], label) for i, v, label in rows])
        else:
            want = negatives_brute(rows)
        assert mined(spark, rows) == want


def test_products_are_exact():
    draw = np.random.default_rng(2)
    for size in (1.0, 2.0 ** 20, 2.0 ** 30, 2.0 ** 40, 2.0 ** 70):
        a, b = (np.floor(draw.normal(0, 100, (9, 5)) * np.where(draw.random((9, 1)) < 0.5, 1, size)) for _ in range(2))
        want = [[max(-scores.TOP, min(scores.TOP, sum(int(x) * int(y) for x, y in zip(r, s)))) for s in b] for r in a]
        assert scores.products(a, b).tolist() == want


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_steps_to_neighbours(dims, bits):
    side = 1 << bits
    cells = np.array(np.meshgrid(*[np.arange(side)] * dims)).reshape(dims, -1).T
    keys = negatives.hilbert_keys(cells, bits)
    order = sorted(range(len(cells)), key=lambda i: keys[i])
    assert len(set(keys)) == len(cells)
    assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def test_zone_maps_spare_blocks(spark, monkeypatch):
    for name, value in (("BLOCK", 32), ("ANCHORS", 4), ("ZONES", 8)):
        monkeypatch.setattr(negatives, name, value)
    draw = random.Random(9)
    rows = [(i, [20 * math.cos(i % 40) + draw.random(), 20 * math.sin(i % 40) + draw.random()], i % 40 % 5) for i in range(4000)]
    search = negatives._Search(vectors_of(spark, rows), F.col("id") % 100 == 0, "vec_id", "embedding", "label", 256)
    open_windows = search.anchors.select("anchor_id", F.lit(0).alias("tag"), F.lit(100_000_00).cast("bigint").alias("low"), F.lit(scores.TOP).cast("bigint").alias("high"))
    blocks, groups = search.blocks.count(), search.groups.count()
    assert 0 < search.needed(open_windows).count() < blocks * groups / 2


def license_brute(rows):
    out = []
    for i, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(s, label) for label, phrase in licenses.PHRASES for s in range(len(w)) if w[s:s + len(phrase.split())] == phrase.split()]
        best, labels = [1.0] if places else [0.0], {p[1] for p in places}
        for label, notice in licenses.NOTICES:
            body = notice.split()
            lines = {}
            for j in range(len(body) - 2):
                for s in range(len(w) - 2):
                    if w[s:s + 3] == body[j:j + 3]:
                        lines.setdefault(s - j, set()).update((j, j + 1, j + 2))
            spans = []
            for d in sorted(lines):
                if spans and d - spans[-1][0] <= licenses.GAP:
                    spans[-1] = (d, spans[-1][1] | lines[d])
                else:
                    spans.append((d, lines[d]))
            share = max((len(s[1]) / len(body) for s in spans), default=0.0)
            best.append(share)
            if share * 100 >= licenses.PERCENT:
                labels.add(label)
        starts = [p[0] for p in places]
        out.append((i, len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({p[1] for p in places})), ",".join(sorted(labels)), max(best)))
    return sorted(out, key=repr)


def scanned(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", "y", 1, True) for i, t in rows], "doc_id bigint, text string, label string, row string, pos int, exact boolean")
    return sorted((tuple(r) for r in licenses.license_scan(docs).collect()), key=repr)


def test_license_scan_equals_brute_force(spark):
    draw = random.Random(8)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "CC BY"), (5, "ALL RIGHTS RESERVED. cc-by"), (5, "ALL RIGHTS RESERVED. cc-by"), (None, "general public license"), (6, "cc"),
            (7, "cc by " * 5000), (8, "x " * 40_000 + "all rights\treserved"), (9, "K cc byİ"), (10, "ccé by cc_by"), (11, "general public licence"),
            (12, "all rights " * 30 + "reserved"), (13, "released under the mit license " * 40)]
    for i in range(60):
        words = draw.choice(licenses.NOTICES)[1].split()
        for _ in range(draw.randrange(4)):
            at = draw.randrange(len(words))
            words[at:at + draw.randrange(2)] = draw.choice([[], ["odd"], ["Two", "words"]])
        rows.append((100 + i, "before " * draw.randrange(3) + " ".join(words).upper() + draw.choice(["", ", all rights reserved", " cc by nc 4 0"])))
    got = scanned(spark, rows)
    assert got == license_brute(rows)
    assert any("mit-grant" in r[6] for r in got) and scanned(spark, rows[:0]) == []
    with pytest.raises(ValueError):
        licenses.template_grams(spark, [("one", "word")], 0)


def test_license_scan_is_native(spark):
    docs = spark.createDataFrame([(1, "cc by")], "doc_id bigint, text string")
    plan = licenses._diagonals(docs, licenses.template_grams(spark, licenses.PHRASES, 3), "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan


def trie_brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            pair = (role or "", text or "")
            digest = hashlib.md5("".join(hashlib.md5(x.encode()).hexdigest() for x in pair).encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, digest, pair))
    own = {c: [t[3] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(math.fmod(c, 20))
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    nodes = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    below = lambda a: [x for x in nodes if x[:len(a)] == a]
    kids = {a: [x for x in nodes if len(x) == len(a) + 1 and x[:-1] == a] for a in nodes}
    words = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) if x else 0
    out = []
    for a, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if built[c] == a)
        out.append((min(members), len(a), min(nodes[a[:-1]]) if a else None, len(members), len(kids[a]), sum(not kids[x] for x in below(a)),
                    sum((len(nodes[x]) - 1) * words(x) for x in below(a)), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie_of(spark, rows):
    table = spark.createDataFrame([(*r, "a", 1, "b") for r in rows], "conv_id bigint, turn bigint, role string, text string, key string, depth int, rep string")
    return sorted((tuple(r) for r in prefixtrie.conversation_trie(table).collect()), key=repr)


def test_prefix_trie_equals_brute_force(spark):
    draw = random.Random(4)
    rows = []
    for c in [*range(-25, 90), 400, 401]:
        for t in range(draw.choice([1, 1, 2, 3, 5, 9, 17])):
            rows.append((c, t, draw.choice(["user", None]), draw.choice(["hello", "hello there\tyou", "", None, "a b c"])))
    rows += [(500 + i, t, "user", f"same {t}") for i in range(40) for t in range(6)]
    rows += [(7, None, "user", "first"), (7, 0, "user", "again"), (7, 0, "user", "again"), (None, 0, "user", "lost"), (600, 5, "user", "w " * 20_000)]
    rows += [(700, t, "user", str(t)) for t in range(130)] + [(701, t, "user", str(t)) for t in range(129)]
    assert trie_of(spark, rows) == trie_brute(rows)


def test_prefix_trie_of_little(spark):
    empty = hashlib.sha256(b"").hexdigest()
    assert trie_of(spark, [(None, 0, "user", "x")][:1]) == []
    alone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 > 0)
    assert trie_of(spark, [(alone, 0, "user", "x")]) == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]
    plain = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 0)
    assert trie_of(spark, [(plain, 0, "user", "x y")]) == trie_brute([(plain, 0, "user", "x y")])
    assert empty in {r[-1] for r in trie_of(spark, [(plain, 0, "user", "x y")])}


def test_ends_of_a_common_conversation(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "PACKED_IDS", 3)
    rows = [(c, 0, "user", "hi") for c in range(0, 100, 20)] + [(c, t, "user", "hi") for c in range(1, 200) if c % 20 for t in range(4)]
    assert trie_of(spark, rows) == trie_brute(rows)
