"""What a worker keeps of packing between two tasks."""

import pyarrow as pa

from linkatlas.llm import packing, queries, tokens


class Held:
    def __init__(self, value):
        self.value = value


def test_a_task_of_packing_leaves_no_words_behind():
    with open(queries.WORD_VOCABULARY, encoding="utf-8") as f:
        encoder = tokens.WordEncoder(f.read())
    cut = packing._pieces(Held(encoder), 2048, 0)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2], pa.int64()), pa.array([" ".join(f"word{i}," for i in range(3000)), None])], ["doc_id", "text"])
    first = [b.to_pylist() for b in cut(iter([batch]))]
    assert not encoder.word and not encoder.word.older and not encoder.part
    assert [b.to_pylist() for b in cut(iter([batch]))] == first and sum(len(b) for b in first) > 2
