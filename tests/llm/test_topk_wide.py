"""Top-k search over components of any finite size, repeated queries and odd columns, against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from linkatlas.llm import scores, topk


def brute(rows, k=5, scale=256, every=10):
    whole = lambda v: [math.floor(scale * x) if abs(scale * x) < math.inf else int(math.copysign(scores.GREATEST, x)) for x in v]
    good = [(i, whole(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in good if i % every == 0}):
        vector = min(v for i, v in good if i == q)
        met = sorted((-max(-scores.TOP, min(scores.TOP, sum(x * y for x, y in zip(vector, v)))), i) for i, v in good if i != q and len(v) == len(vector))
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(met[:k], 1)]
    return out


@pytest.mark.parametrize("size", [1e7, 1e10, 1e300, 1.7e308])
def test_any_finite_component(spark, size):
    draw = random.Random(7)
    rows = [(i, [draw.gauss(0, 1) for _ in range(3)]) for i in range(50)]
    rows += [(50 + i, [draw.choice([size, -size, size / 7, 1.0, 0.0]) for _ in range(3)]) for i in range(20)]
    rows += [(10, [0.5, 0.5, 0.5]), (10, [0.1, 0.2, 0.3]), (61, [1.0] * 3), (61, [1.0] * 3), (None, [1.0] * 3), (80, None), (90, []), (100, [1.0, None, 1.0]), (110, [1.0, 2.0])]
    table = spark.createDataFrame([(i, v, "a", 1, 2.0, "b") for i, v in rows], "vec_id bigint, embedding array<double>, id string, block int, low double, width string")
    got = topk.top_k(table, F.col("id") % 10 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute(rows)
