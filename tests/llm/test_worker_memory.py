"""What Python workers hold: one worker per core, batches of bounded size, nothing left from earlier tasks."""

import gc
import random
import weakref

import pyarrow as pa
import zstandard

from linkatlas.llm import minhash, substring, text
from test_llm import docs_of, near_brute


def test_links_reach_their_grouping_without_a_python_step(spark, monkeypatch):
    draw, plans, plain = random.Random(9), [], minhash.components
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base[:30], f"own{draw.randrange(99)}", *base[30:]])) for i in range(40)]

    def seen(links):
        plans.append(links._jdf.queryExecution().executedPlan().toString())
        return plain(links)

    monkeypatch.setattr(minhash, "components", seen)
    got = minhash.near_groups(docs_of(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == near_brute(rows, 5, 80)
    assert len(plans) == 2 and not any("InArrow" in p for p in plans)


def test_a_release_frees_what_lies_in_cycles():
    class Vocabulary:
        def __init__(self):
            self.ask = self.answer

        def answer(self):
            return self

    gc.disable()
    try:
        left = weakref.ref(Vocabulary())
        text.release()
        assert left() is None
    finally:
        gc.enable()


def test_large_batches_are_worked_on_in_parts():
    long = ["a b " * (1 << 20), "c d " * (1 << 20), None, "e f " * (1 << 20)]
    ids = pa.array(range(4), pa.int64())
    keys = pa.array([[]] * 4, pa.list_(pa.int64()))
    two = list(minhash._pack(iter([pa.RecordBatch.from_arrays([ids, pa.array(long)], ["doc_id", "text"])])))
    five = list(substring._pack(iter([pa.RecordBatch.from_arrays([ids, ids, pa.array(long), keys, keys], ["doc_id", "fp", "text", "cold", "hot"])])))
    unpack = zstandard.ZstdDecompressor()
    for parts in (two, five):
        assert len(parts) > 1 and [i for p in parts for i in p.column("doc_id").to_pylist()] == [0, 1, 2, 3]
        assert [unpack.decompress(x).decode() for p in parts for x in p.column("packed").to_pylist()] == [t or "" for t in long]
