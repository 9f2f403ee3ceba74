"""The prefix trie of all conversations, by cutting sequences at half depth again and again (van Emde Boas layout).

A sequence is a set of rows, one for each turn, never an array, so that one conversation may own a large part of the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkatlas.operators.skew import OrderedChunks, salted_join
from linkatlas.session import durable

PACKED_IDS = 4096


def _content() -> tuple[Column, Column]:
    """Two 64-bit digests of a run of turns: each turn is hashed with its place, so the order of summing is free."""
    return F.bit_xor(F.xxhash64("key", "at")).alias("x"), F.bit_xor(F.xxhash64("key", "at", F.lit(7))).alias("y")


def ordered_turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id``, ``nth`` (from 1), ``key`` (digest of role and text) and ``words`` of each turn, in the order of turns (null first).
    Equal turn numbers are ordered by ``key``. A null role or text counts as empty; rows without conversation id take no part."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.filter(F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("bigint").alias("conv_id"), F.col(f"`{turn_col}`").cast("bigint").alias("turn"),
        F.md5(F.concat(F.md5(role), F.md5(text))).alias("key"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"))
    return OrderedChunks(rows, ["conv_id"], ["turn", "key"]).row_number("nth").result().drop("turn")


def rebuilt(turns: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first turns of their group's first conversation: ``(sequences, convs)``.

    ``turns`` as ``ordered_turns`` gives them. With ``h = crc32(decimal id) % most``, conversation ``c`` gets the first ``h`` turns of
    conversation ``c - c % group`` (fewer or none where it has fewer or is absent), then its own turns after its first ``h``.
    ``sequences`` holds ``conv_id``, ``at`` (from 0), ``key``, ``words``; ``convs`` every ``conv_id`` with its ``len``, 0 included.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most))
    first = F.col("conv_id") - F.col("conv_id") % group
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumn("h", h).withColumn("first", first)
    heads = turns.filter((F.col("conv_id") == first) & (F.col("nth") < most)).select(F.col("conv_id").alias("first"), "nth", "key", "words")
    begun = convs.join(heads, "first").filter("nth <= h").select("conv_id", (F.col("nth") - 1).alias("at"), "key", "words")
    taken = begun.groupBy("conv_id").agg(F.count(F.lit(1)).alias("taken"))
    convs = convs.join(taken, "conv_id", "left").select("conv_id", "h", F.coalesce("taken", F.lit(0)).alias("taken"), "n")
    convs = durable(convs.withColumn("len", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    later = salted_join(turns.filter(F.col("nth") > h), convs.select("conv_id", "h", "taken"), ["conv_id"], "inner", ["nth"], hash_build=True)
    later = later.select("conv_id", (F.col("taken") + F.col("nth") - F.col("h") - 1).alias("at"), "key", "words")
    return begun.unionByName(later), convs.select("conv_id", "len")


def _classes(sequences: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Equal sequences become one, named by the least id: ``members(conv_id, rep, len, copies)`` and ``classes(rep, len, copies)``."""
    whole = sequences.groupBy("conv_id").agg(*_content())
    tagged = convs.join(whole, "conv_id", "left").select("conv_id", "len", F.coalesce("x", F.lit(0)).alias("x"), F.coalesce("y", F.lit(0)).alias("y"))
    classes = durable(tagged.groupBy("x", "y", "len").agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    members = salted_join(tagged, classes, ["x", "y", "len"], "inner", ["conv_id"])
    return members.select("conv_id", "rep", "len", "copies"), classes.select("rep", "len", "copies")


def _named_prefixes(rows: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """``names(rep, p, name)``: the least sequence with the same first ``p`` turns, for each ``p``; and the trie's ``nodes``.

    ``depth`` is a power of two above every length. A block of ``2 * half`` turns is cut in the middle: the name of what stands before the
    cut is decided by the block's tree (the name of what stands before the block) and the content of its upper half. The name is the
    tree of the lower half. Upper and lower halves are the blocks of the next round, all at once, so there are ``log2(depth)`` rounds.
    """
    spark = rows.sparkSession
    names = spark.createDataFrame([], "rep bigint, p bigint, name bigint")
    nodes = spark.createDataFrame([], "depth bigint, conv_id bigint, n_convs bigint, words bigint")
    half = depth // 2
    while half:
        cut = F.floor(F.col("at") / half) * half + half
        upper = rows.withColumn("p", cut).filter((F.pmod(cut / half, F.lit(2)) == 1) & (F.col("len") >= cut))
        cuts = upper.groupBy("rep", "p").agg(*_content(), F.max("copies").alias("copies"), F.max(F.when(F.col("at") == F.col("p") - 1, F.col("words"))).alias("words"))
        trees = names.select("rep", (F.col("p") + half).alias("p"), F.col("name").alias("tree"))
        cuts = durable(cuts.join(trees, ["rep", "p"], "left").withColumn("tree", F.coalesce("tree", F.lit(0))))
        keys = ["p", "tree", "x", "y"]
        found = durable(cuts.groupBy(*keys).agg(F.min("rep").alias("name"), F.sum("copies").alias("n_convs"), F.max("words").alias("words")))
        names = durable(names.unionByName(salted_join(cuts, found.select(*keys, "name"), keys, "inner", ["rep"]).select("rep", "p", "name")))
        nodes = nodes.unionByName(found.select(F.col("p").alias("depth"), F.col("name").alias("conv_id"), "n_convs", "words"))
        half //= 2
    return names, nodes


def _grafted(nodes: DataFrame, names: DataFrame, depth: int) -> DataFrame:
    """``depth``, ``conv_id``, ``n_leaves`` and ``saved_tokens`` of whole subtrees.

    From single turns upward, blocks of twice the size are put together: the roots of each lower tree are summed at the prefix that it hangs
    from, and the sum is grafted onto every node of the upper half on the path to that prefix. A path has at most as many rows as
    the block has turns of the sequence that names it, so a round makes no more rows than there are turns.
    """
    totals, half = nodes.select("depth", "conv_id", "parent", "n_leaves", "saved_tokens"), 1
    while half < depth:
        block = F.floor((F.col("depth") - 1) / half)
        roots = totals.filter((F.col("depth") > half) & ((F.col("depth") - 1) % half == 0) & (F.pmod(block, F.lit(2)) == 1))
        hung = roots.groupBy(F.col("parent").alias("rep"), (block - 1).alias("block")).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
        paths = names.withColumn("block", F.floor((F.col("p") - 1) / half)).filter("block % 2 = 0")
        added = paths.join(hung, ["rep", "block"]).select(
            F.col("p").alias("depth"), F.col("name").alias("conv_id"), F.lit(None).cast("bigint").alias("parent"), "n_leaves", "saved_tokens")
        totals = durable(totals.unionByName(added).groupBy("depth", "conv_id").agg(
            F.max("parent").alias("parent"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")))
        half *= 2
    return totals.drop("parent")


def _packed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ids of a node as text, ``PACKED_IDS`` or fewer in a row."""
    for batch in it:
        depth, conv, ids = (batch.column(i).to_pylist() for i in range(3))
        starts = [i for i in range(len(ids)) if i == 0 or (depth[i], conv[i]) != (depth[i - 1], conv[i - 1])]
        cuts = [(i, min(i + PACKED_IDS, end)) for start, end in zip(starts, [*starts[1:], len(ids)]) for i in range(start, end, PACKED_IDS)]
        yield pa.RecordBatch.from_arrays([
            pa.array([depth[i] for i, _ in cuts], pa.int64()), pa.array([conv[i] for i, _ in cuts], pa.int64()), pa.array([ids[i] for i, _ in cuts], pa.int64()),
            pa.array([",".join(map(str, ids[i:j])) for i, j in cuts], pa.string())], ["depth", "conv_id", "least", "part"])


def _digested(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts come sorted by node and least id; each node's parts are fed to one SHA-256, a part at a time."""
    node, sha = None, None

    def row(node, sha):
        return pa.RecordBatch.from_arrays([pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.int64()), pa.array([sha.hexdigest()])],
                                          ["depth", "conv_id", "ends_sha256"])

    for batch in it:
        for depth, conv, part in zip(*(batch.column(c).to_pylist() for c in ("depth", "conv_id", "part"))):
            if (depth, conv) != node:
                if node is not None:
                    yield row(node, sha)
                node, sha = (depth, conv), hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(part.encode())
    if node is not None:
        yield row(node, sha)


def _ends(ending: DataFrame, parts: int) -> DataFrame:
    """SHA-256 of the ids that end at each node. A single id is hashed natively; more are sorted over range partitions and packed there, so that the task
    of a node with very many meets some thousands of ids in a row, in order, and holds one of these rows."""
    alone = ending.filter("copies = 1").select("depth", "conv_id", F.sha2(F.col("member").cast("string").cast("binary"), 256).alias("ends_sha256"))
    many = ending.filter("copies > 1").select("depth", "conv_id", "member").repartitionByRange(parts, "depth", "conv_id", "member").sortWithinPartitions("depth", "conv_id", "member")
    packed = many.mapInArrow(_packed, "depth bigint, conv_id bigint, least bigint, part string")
    dealt = packed.repartition(parts, "depth", "conv_id").sortWithinPartitions("depth", "conv_id", "least")
    return alone.unionByName(dealt.mapInArrow(_digested, "depth bigint, conv_id bigint, ends_sha256 string"))


def prefix_trie(sequences: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node of the trie of ``sequences(conv_id, at, key, words)``; ``convs(conv_id, len)`` names every sequence, those without turns too.

    A node is a distinct sequence of first turns, from the empty one at depth 0. Columns: ``conv_id`` (least member), ``depth``, ``parent_conv_id``
    (the parent's, null at the root), ``n_convs``, ``n_children``, ``n_leaves`` (childless nodes of its subtree, itself included), ``saved_tokens``
    (over its subtree, ``(n_convs - 1)`` times the words of the node's last turn), ``ends_sha256`` (of the decimal ids of the sequences that end here,
    ascending, comma-joined). No sequences give no rows, the root included.

    Equal sequences are counted first and go on as one, so a very common conversation costs one sequence. Turns are compared by
    128-bit digests, and prefixes by 128 bits of those.
    """
    parts = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    members, classes = _classes(sequences, convs)
    members = durable(members)
    longest = classes.agg(F.max("len")).first()[0] or 0
    depth = 1 << longest.bit_length()
    rows = durable(salted_join(sequences.withColumnRenamed("conv_id", "rep"), classes.filter("len > 0"), ["rep"], "inner", ["at"], hash_build=True))
    names, nodes = _named_prefixes(rows, depth)
    above = names.select(F.col("rep").alias("conv_id"), (F.col("p") + 1).alias("depth"), F.col("name").alias("parent"))
    nodes = nodes.join(above, ["depth", "conv_id"], "left")
    whole = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"))
    top = whole.first()["conv_id"]
    root = whole.filter("n_convs > 0").select(
        F.lit(0).cast("bigint").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("bigint").alias("words"), F.lit(None).cast("bigint").alias("parent"))
    nodes = durable(nodes.withColumn("parent", F.when(F.col("depth") == 1, F.lit(top).cast("bigint")).otherwise(F.col("parent"))).unionByName(root))
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("conv_id")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, ["depth", "conv_id"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = durable(nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("bigint")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("words")))
    inner = _grafted(nodes.filter("depth > 0"), names, depth)
    at_root = inner.filter("depth = 1").select("n_leaves", "saved_tokens").unionByName(root.select(
        F.when(F.lit(longest == 0), 1).otherwise(0).cast("bigint").alias("n_leaves"), F.lit(0).cast("bigint").alias("saved_tokens")))
    at_root = at_root.agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")).select(
        F.lit(0).cast("bigint").alias("depth"), F.lit(top).cast("bigint").alias("conv_id"), "n_leaves", "saved_tokens")
    totals = inner.unionByName(at_root)
    ends_at = names.select("rep", F.col("p").alias("len"), "name")
    ending = salted_join(members.filter("len > 0"), ends_at, ["rep", "len"], "inner", ["conv_id"]).select(
        F.col("len").alias("depth"), F.col("name").alias("conv_id"), F.col("conv_id").alias("member"), "copies")
    bare = members.filter("len = 0").select(F.lit(0).cast("bigint").alias("depth"), F.lit(top).cast("bigint").alias("conv_id"), F.col("conv_id").alias("member"), "copies")
    ends = _ends(ending.unionByName(bare), parts)
    out = nodes.drop("n_leaves", "saved_tokens").join(totals, ["depth", "conv_id"]).join(ends, ["depth", "conv_id"], "left")
    return out.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of the rebuilt conversations of a table; see ``ordered_turns``, ``rebuilt`` and ``prefix_trie``. An empty table gives no rows."""
    sequences, convs = rebuilt(ordered_turns(conversations, id_col, turn_col, role_col, text_col))
    return prefix_trie(durable(sequences), convs)
