"""Token shards read back from any slot, every id held against the tokenizers library."""

import json
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from linkatlas.llm import queries, shards
from test_llm import ODD, docs_of


def test_every_id_is_the_librarys(spark, tmp_path):
    folder = str(tmp_path / "shards")
    index = {r.slot: r for r in shards.write_shards(docs_of(spark, ODD).coalesce(1), queries.WORD_VOCABULARY, folder, key=9, length=64, per_shard=16).collect()}
    library = Tokenizer.from_file(queries.WORD_VOCABULARY)
    stream = []
    for row in docs_of(spark, ODD).coalesce(1).collect():
        stream += [*library.encode(row.text or "", add_special_tokens=False).ids, 0]
    whole = {r.slot: r.ids for r in shards.read_shards(spark, folder).collect()}
    assert set(whole) == set(index) and len(index) == -(-len(stream) // 64)
    # One task wrote the stream, so sequence numbers follow it.
    for slot, ids in whole.items():
        own = stream[index[slot].sequence_id * 64:][:64]
        assert ids == own + [0] * (64 - len(own)) and index[slot].n_tokens == len(own)
    for start in (0, 5, 16, len(index) - 1, len(index), len(index) + 9):
        assert {r.slot: r.ids for r in shards.read_shards(spark, folder, start).collect()} == {s: i for s, i in whole.items() if s >= start}
    assert shards.read_shards(spark, folder, 3, 7).count() == 4


def test_wide_ids_are_not_cut(spark, tmp_path, monkeypatch):
    small = json.dumps({"model": {"vocab": {"a": 65535}}, "added_tokens": []})
    large = json.dumps({"model": {"vocab": {"a": 1}}, "added_tokens": [{"id": 65536}]})
    assert shards.id_type(small) == "<u2" and shards.id_type(large) == "<u4"
    monkeypatch.setattr(shards, "id_type", lambda source: "<u4")
    folder = str(tmp_path / "wide")
    index = {r.slot: r for r in shards.write_shards(docs_of(spark, ODD), queries.WORD_VOCABULARY, folder, key=9, length=32, per_shard=8).collect()}
    assert all(r.byte_offset == r.slot % 8 * 128 for r in index.values())
    for r in shards.read_shards(spark, folder).collect():
        assert zlib.crc32(np.array(r.ids[:index[r.slot].n_tokens], "<u4").tobytes()) == index[r.slot].ids_crc32


def test_an_empty_table_has_a_manifest(spark, tmp_path):
    shards.write_shards(docs_of(spark, ODD).limit(0), queries.WORD_VOCABULARY, str(tmp_path / "none"), key=1)
    assert shards.read_shards(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(FileNotFoundError):
        shards.read_shards(spark, str(tmp_path / "missing"))
