"""Families of near copies around the threshold, where no single hub decides: every link counts, few pairs are compared."""

import random

import pytest

from linkatlas.llm import minhash
from test_llm import docs_of, near_brute


@pytest.mark.parametrize("k,percent,seed", [(3, 85, 1), (5, 80, 2), (1, 60, 3)])
def test_families_equal_brute_force(spark, k, percent, seed):
    draw = random.Random(seed)
    rows = []
    for family in range(3):
        base = [f"f{family}w{draw.randrange(400)}" for _ in range(draw.choice([40, 120, 200]))]
        chain = list(base)
        for i in range(70):
            words = list(base if i % 2 else chain)
            for _ in range(draw.randrange(0, 1 + len(words) // 12)):
                at = draw.randrange(len(words))
                words[at:at + draw.randrange(3)] = [f"n{draw.randrange(60)}"]
            if i % 5 == 0:
                chain = words
            rows.append((len(rows), " ".join(words)))
    got = minhash.near_groups(docs_of(spark, rows), k=k, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == near_brute(rows, k, percent)


def test_a_family_makes_few_pairs(spark, monkeypatch):
    draw, made = random.Random(4), []
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(400):
        words = list(base)
        for _ in range(draw.randrange(0, 16)):
            words[draw.randrange(300)] = f"own{draw.randrange(10 ** 9)}"
        rows.append((i, " ".join(words)))
    plain = minhash._likely_pairs

    def counted(*args):
        out = plain(*args)
        made.append(out.count())
        return out

    monkeypatch.setattr(minhash, "_likely_pairs", counted)
    got = minhash.near_groups(docs_of(spark, rows), k=5, percent=80).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: c for i, (_, c) in near_brute(rows, 5, 80).items()}
    assert made[0] < 4 * len(rows)
