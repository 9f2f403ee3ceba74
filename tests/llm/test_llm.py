"""The training-data operators against brute force and SQL on small tables and awkward rows."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from compare import difference, duck
from linkatlas.llm import exact, language, minhash, packing, queries, shards, substring, tokens, topk, toxicity, urls
from linkatlas.llm.components import components
from linkatlas.llm.wordgrid import Letters, WordGrid

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _id string, node string, bucket string"


def docs_of(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", "z") for i, t in rows], SCHEMA)


LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "Hello World again"), (5, "hello world AGAIN"), (5, "hello world AGAIN"), (None, "hello world again"),
       (None, None), (6, "one"), (7, "ONE"), (8, LONG), (9, LONG.upper()), (10, "É é"), (11, "é é"), (-3, "two words")]


@pytest.mark.parametrize("name", sorted(queries.CHECKS))
def test_query_equals_sql(spark, small, name):
    assert difference(queries.QUERIES[name](spark, small), duck(small), queries.CHECKS[name]) is None


def test_exact_odd_rows(spark):
    for keep, pick in (("largest", max), ("smallest", min)):
        got = exact.exact_groups(docs_of(spark, ODD), keep=keep).collect()
        norm = {}
        for i, t in ODD:
            norm.setdefault((t or "").encode().lower(), []).append(i)
        by_sha = {hashlib.sha256(t).hexdigest(): ids for t, ids in norm.items()}
        assert len(got) == len(ODD)
        for sha, ids in by_sha.items():
            own = [r for r in got if r.text_sha256 == sha]
            known = [i for i in ids if i is not None]
            assert [r.group_size for r in own] == [len(ids)] * len(ids)
            assert {r.keep_id for r in own} == {pick(known) if known else None}
            assert sum(r.kept for r in own) == 1
    left = exact.drop_copies(docs_of(spark, ODD))
    assert left.columns == docs_of(spark, ODD).columns and left.count() == len(by_sha)
    assert exact.exact_groups(docs_of(spark, ODD).limit(0)).count() == 0


def test_exact_hot_text_spreads(spark):
    rows = [(i, "Same" if i % 3 else f"own {i}") for i in range(600)]
    got = exact.sorted_copies(docs_of(spark, rows), keep="largest", partitions=8)
    assert {(r._copy.keep_id, r._copy.group_size) for r in got.collect() if r.text == "Same"} == {(599, 400)}
    assert got.filter("_copy.kept").count() == 201


def near_brute(rows, k, percent):
    sets = {i: set(minhash.shingle_set(t, k).tolist()) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * len(sets[a] | sets[b]):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_near_groups_equal_brute_force(spark):
    draw = random.Random(3)
    base = [[f"v{draw.randrange(3000)}" for _ in range(n)] for n in (4, 30, 90, 200)]
    rows = []
    for i in range(160):
        words = list(base[i % 4])
        for _ in range(draw.randrange(0, 4)):
            words[draw.randrange(len(words))] = f"n{draw.randrange(10 ** 6)}"
        rows.append((i, " ".join(words)))
    rows += [(200, None), (201, ""), (202, "a b"), (203, "A  b"), (204, "a"), (205, LONG), (206, LONG + " end")]
    for k, percent in ((3, 85), (5, 80)):
        got = minhash.near_groups(docs_of(spark, rows), k=k, percent=percent).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == near_brute(rows, k, percent)
    odd = {(r.doc_id, r.component_id) for r in minhash.near_groups(docs_of(spark, ODD)).collect()}
    assert {(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (7, 6), (9, 8), (None, None)} <= odd
    assert minhash.near_groups(docs_of(spark, ODD).limit(0)).count() == 0
    assert minhash.drop_near_copies(docs_of(spark, ODD)).columns == docs_of(spark, ODD).columns


def test_signatures_estimate_with_less_variance():
    draw = np.random.default_rng(1)
    a = draw.integers(0, 2 ** 63, 60, dtype=np.uint64)
    b = np.concatenate([a[:50], draw.integers(0, 2 ** 63, 10, dtype=np.uint64)])
    share = [(m[0] == m[1]).mean() for m in (minhash.super_minhash([minhash.mix(a + np.uint64(s)), minhash.mix(b + np.uint64(s))]) for s in range(100))]
    assert abs(np.mean(share) - 50 / 70) < 0.02 and np.std(share) < (50 / 70 * 20 / 70 / 128) ** 0.5
    assert minhash.super_minhash([a, a[:1], a[:0]])[1].max() < 128 << 32


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7), (95, 100)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 100: 90, 95: 90}


def cut_brute(rows, window):
    first, out = {}, {}
    known = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    for i, t in known:
        words = (t or "").encode().split()
        for s in range(len(words) - window + 1):
            first.setdefault(tuple(words[s:s + window]), i)
    for i, t in rows:
        words = (t or "").encode().split()
        gone = {s + j for s in range(len(words) - window + 1) if i is not None and first[tuple(words[s:s + window])] < i for j in range(window)}
        kept = b" ".join(w for j, w in enumerate(words) if j not in gone)
        out.setdefault(i, set()).add((len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [20_000, 5])
def test_repeated_words_equal_brute_force(spark, hot):
    draw = random.Random(5)
    shared = [f"s{i}" for i in range(80)]
    rows = [(i, " ".join([f"a{draw.randrange(50)}" for _ in range(draw.randrange(0, 60))] + shared[draw.randrange(40):draw.randrange(40, 80)]
                         + ["x"] * draw.randrange(0, 40))) for i in range(60)]
    rows += ODD[:11] + [(500, LONG)]
    got = collections.defaultdict(set)
    for r in substring.repeated_words(docs_of(spark, rows), window=12, gram=4, hot_windows=hot).collect():
        got[r.doc_id].add((r.n_words, r.n_removed, r.kept_sha256))
    assert got == cut_brute(rows, 12)
    cut = substring.cut_repeats(docs_of(spark, rows), window=12, gram=4)
    assert cut.columns == docs_of(spark, rows).columns and cut.count() == len(rows)
    assert {r.text for r in cut.filter("doc_id = 500").collect()} == {""}


@pytest.fixture(scope="module")
def vocabularies():
    return [(queries.BYTE_VOCABULARY, tokens.ByteEncoder), (queries.WORD_VOCABULARY, tokens.WordEncoder)]


def test_encoders_equal_the_library(vocabularies):
    draw = random.Random(7)
    pool = [" ", "  ", "\n", "\t", "\xa0", "\x1c", "\x01", "'s", "'S", "Word", "é", "H̱", "Σ", "İ", "½", "12", "...", "<|endoftext|>", "日本", "👍🏽", "x" * 300, "ab" * 200, "_", "'"]
    for path, kind in vocabularies:
        own, library = kind(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)
        for _ in range(3000):
            text = "".join(draw.choice(pool) for _ in range(draw.randrange(9)))
            ids = library.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(own.encode(text), "<u4").tolist() == ids, repr(text)
            if kind is tokens.ByteEncoder:
                assert own.decode(own.encode(text)) == library.decode(ids, skip_special_tokens=False)


def test_coding_query(spark, small):
    library = Tokenizer.from_file(queries.BYTE_VOCABULARY)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in queries.op5_bpe_coding(spark, small).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    back = tokens.decode(tokens.encode(docs_of(spark, ODD), queries.BYTE_VOCABULARY), queries.BYTE_VOCABULARY)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in back.collect()) == sorted((i is None, i or 0, t or "") for i, t in ODD)


def packing_holds(spark, docs, rows, capacity):
    library = Tokenizer.from_file(queries.WORD_VOCABULARY)
    got = packing.packed_pieces(docs, queries.WORD_VOCABULARY, capacity=capacity).collect()
    want = collections.Counter()
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for p, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at:at + capacity]
            want[i, p, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(r.length for r in got) // capacity)


def test_packing(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    used, bound = packing_holds(spark, docs, [(r.doc_id, r.text) for r in docs.collect()], packing.CAPACITY)
    assert used <= bound * 1.02 + 1
    packing_holds(spark, docs_of(spark, ODD), ODD, 16)
    assert packing.packed_pieces(docs_of(spark, ODD).limit(0), queries.WORD_VOCABULARY).count() == 0


def test_bins_plan():
    draw = random.Random(2)
    for capacity in (10, 100):
        counts = collections.Counter(draw.randint(1, capacity) for _ in range(500))
        bins, seen = packing.plan_bins(dict(counts), capacity), collections.Counter()
        for b in bins:
            assert b.count > 0 and sum(s * t for s, t in b.items) == capacity - b.room and b.room >= 0
            assert sum(t for s, t in b.items if 3 * s > capacity) <= 2
            for s, t in b.items:
                seen[s] += t * b.count
        assert seen == counts and sum(b.count for b in bins) <= 1.03 * sum(s * c for s, c in counts.items()) / capacity + 2 + sum(c for s, c in counts.items() if 2 * s > capacity) * 0.2


def test_shards(spark, tmp_path):
    for n in (1, 2, 3, 100, 4097):
        assert sorted(shards.feistel(np.arange(n), n, 5).tolist()) == list(range(n))
    rows = shards.write_shards(docs_of(spark, ODD), queries.WORD_VOCABULARY, str(tmp_path), key=9, length=64, per_shard=16).orderBy("slot").collect()
    assert [r.slot for r in rows] == list(range(len(rows))) and sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    total = 0
    for r in rows:
        with open(tmp_path / f"shard-{r.shard:08d}.bin", "rb") as f:
            f.seek(r.byte_offset)
            ids = np.frombuffer(f.read(128), "<u2")
        total += r.n_tokens
        assert len(ids) == 64 and zlib.crc32(ids[:r.n_tokens].astype("<u4").tobytes()) == r.ids_crc32 and not ids[r.n_tokens:].any()
    library = Tokenizer.from_file(queries.WORD_VOCABULARY)
    assert total == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in ODD)
    assert shards.write_shards(docs_of(spark, ODD).limit(0), queries.WORD_VOCABULARY, str(tmp_path / "none"), key=9).count() == 0


def test_top_k(spark):
    rows = [(i, [float(i % 7), 0.5, -1.25]) for i in range(120)] + [(200, None), (201, [1.0, None, 2.0]), (202, [float("nan"), 1.0, 1.0]), (203, [1.0]), (250, [2.0]), (None, [1.0, 1.0, 1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("id") % 50 == 0)
    fine = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for q in (q for q in fine if q % 50 == 0):
        scored = sorted((-sum(a * b for a, b in zip(fine[q], v)), i) for i, v in fine.items() if i != q and len(v) == len(fine[q]))
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:5])}
    assert {tuple(r) for r in got.collect()} == want
    many = [(i, [float(i * 37 % 101), float(i % 13)]) for i in range(5000)]
    got = topk.top_k(spark.createDataFrame(many, "vec_id bigint, embedding array<double>"), F.col("id") % 500 == 0, scale=1).collect()
    want = set()
    for q in range(0, 5000, 500):
        scored = sorted((-sum(a * b for a, b in zip(many[q][1], v)), i) for i, v in many if i != q)
        want |= {(q, n + 1, i, int(-s)) for n, (s, i) in enumerate(scored[:5])}
    assert {tuple(r) for r in got} == want
    assert topk.top_k(spark.createDataFrame([], "vec_id bigint, embedding array<float>"), F.col("id") % 50 == 0).count() == 0


def test_urls(spark):
    pages = [(1, None), (2, "no scheme"), (3, "http://EXAMPLE.org/es/x?y"), (4, "http://m.example.org/en/12#a"), (5, "x://org"), (6, "http://a.com/de/"),
             (7, "http://a.com/fr"), (8, "http://notexample.org/es/1"), (9, "http://a.net/de/"), (10, "http://"), (10, "http:///p"), (11, "http://org?x/es/")]
    got = urls.judged_urls(spark.createDataFrame(pages, "page_id bigint, url string"), spark.createDataFrame(queries.RULES, "host string, path string, verdict string"))
    by = {(r.page_id, r.rule, r.verdict) for r in got.collect()}
    assert by == {(1, None, "allow"), (2, None, "allow"), (3, "example.org/es/", "block"), (4, "example.org/en/1", "allow"), (5, None, "allow"), (6, "com/de/", "block"),
                  (7, None, "allow"), (8, "org/", "allow"), (9, None, "allow"), (10, None, "allow"), (11, None, "allow")}
    assert got.count() == len(pages)
    bloom = urls.BlockedBloom(64)
    bloom.add(urls._hash([f"in{i}" for i in range(2000)]))
    assert bloom.has(urls._hash([f"in{i}" for i in range(2000)])).all() and bloom.has(urls._hash([f"out{i}" for i in range(5000)])).mean() < 0.05


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "bab", "▁ab"]
    probs = np.random.default_rng(0).random((len(pieces) + 1, 2))
    chars, lengths, row = language.word_rows(WordGrid(["abab b", "ac"], Letters(False), 32))
    alpha = language.forward(language.lattice(chars, lengths, language.Pieces(pieces)), len(lengths), int(lengths.max()), probs)

    def brute(w):
        return np.ones(2) if not w else sum((probs[pieces.index(w[:i])] * brute(w[i:]) for i in range(1, len(w) + 1) if w[:i] in pieces),
                                             np.zeros(2) if w[:1] in pieces else probs[-1] * brute(w[1:]))

    for w, r in zip(["abab", "b", "ac"], row):
        assert np.allclose(alpha[lengths[r], r], brute("▁" + w))


def test_language(spark):
    sf = "/root/testdata/sf0.01"
    known = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op9_language_id(spark, sf).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(known) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.lang_pred == known[r.doc_id] for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in got)
    odd = language.identified(docs_of(spark, [*ODD, (77, "1234 !!")]), queries.PIECE_VOCABULARY).collect()
    assert {r.lang_pred for r in odd if r.doc_id in (1, 2, 3, 77)} == {"und"} and {r.lang_pred for r in odd if r.doc_id == 8} == {"en"}
    assert language.identified(docs_of(spark, ODD).limit(0), queries.PIECE_VOCABULARY).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        old, row[0] = row[:], i + 1
        for j, y in enumerate(b):
            row[j + 1] = min(old[j + 1] + 1, row[j] + 1, old[j] + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    lexicon, draw, words = toxicity.Lexicon({"moron": 1.0, "worthlessly": 2.0, "scum": 1.5}, {"lowei": 1.2}), random.Random(1), []
    for _ in range(1500):
        w = list(draw.choice(["moron", "worthlessly", "scum", "loweifoo", "abc"]))
        for _ in range(draw.randint(0, 3)):
            w[draw.randrange(len(w)):draw.randrange(len(w) + 1)] = draw.choice(["", "o", "r", "wz"])
            w = w or ["x"]
        words.append("".join(w))
    for w, state in zip(words, lexicon.run(WordGrid(words, Letters(True)))):
        near = [d for t in lexicon.terms if (d := edit_distance(w, t)) <= lexicon.edits(t)]
        want = toxicity.EXACT if 0 in near else toxicity.STEM if w.startswith("lowei") else toxicity.FUZZY if near else -1
        assert lexicon.kind[state] == want, w


def test_quotation_counts_apart():
    x = toxicity.features(['you are a moron', 'they wrote "moron" there', None], toxicity.Lexicon({"moron": 1.0}, {}), Letters(True))
    assert x[0, 0] > 0 and x[0, 3] == 0 and x[1, 0] == 0 and x[1, 3] > 0 and not x[2].any()


def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op10_toxicity(spark, sf).collect()
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    found = [r for r in held if r.predicted]
    assert sum(labels[r.doc_id] for r in found) >= 0.95 * len(found) and len(found) >= 0.85 * sum(labels[r.doc_id] for r in held)
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r.predicted for r in toxicity.toxicity(docs_of(spark, ODD), none).collect()} == {0}
    assert toxicity.drop_toxic(docs_of(spark, ODD), none).count() == len(ODD)


def test_toxic_languages_of_a_small_table(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    found = [r.doc_id for r in queries.op10_toxicity(spark, sf).collect() if r.predicted and r.doc_id in labels]
    assert sum(labels[d] for d in found) >= 0.95 * len(found)
    for lang in ("de", "en", "es"):
        toxic = {d for d, y in labels.items() if y == 1 and langs[d] == lang}
        assert len(toxic & set(found)) >= 0.8 * len(toxic), lang


def test_pipeline(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, small)
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        if name == "toxicity":
            gone = {r.doc_id for r in toxicity.toxicity(docs, spark.read.parquet(f"{small}/labels.parquet")).filter("predicted = 1").collect()}
            assert {r.doc_id for r in out.collect()} == {i for i, _ in rows} - gone
        elif name == "exact dedup":
            least = {}
            for d, t in sorted(rows):
                least.setdefault(t.encode().lower(), d)
            assert sorted(r.doc_id for r in out.collect()) == sorted(least.values())
        elif name == "near dedup":
            assert {r.doc_id for r in out.collect()} == {d for d, (_, c) in near_brute(rows, 5, 80).items() if d == c}
        elif name == "substring dedup":
            want = cut_brute(rows, 50)
            assert {r.doc_id: hashlib.sha256(b" ".join(r.text.encode().split())).hexdigest() for r in out.collect()} == {d: next(iter(v))[2] for d, v in want.items()}
        else:
            packing_holds(spark, docs, rows, packing.CAPACITY)
            break
        assert out.columns == docs.columns
        out.write.parquet(path := f"{tmp_path}/{i}")
        docs = spark.read.parquet(path)
    assert corpus_pipeline.run(spark, small).count() == out.count()
