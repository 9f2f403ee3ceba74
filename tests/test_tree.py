"""Exports: quarantine, flatten rules, fold."""

import json

from pyspark.sql import functions as F

from linkatlas.operators import outline as O
from linkatlas.operators import tree as T
from linkatlas.sources import exports as S


def docs(spark, *raws):
    return S.parse_exports(spark.createDataFrame([(str(i), r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(raws)], "export_id string, raw string"))


def bar(*children, **extra):
    return {"roots": {"bookmark_bar": {"type": "folder", "children": list(children), **extra}}}


def link(name="L", url="http://l"):
    return {"type": "url", "name": name, "url": url}


def folder(name, *children):
    return {"type": "folder", "name": name, "children": list(children)}


def flat(spark, *raws):
    kept, bad = T.flatten_exports(S.sound(docs(spark, *raws)))
    return [r.asDict() for r in kept.orderBy("export_id", "node_key").collect()], [r.asDict() for r in bad.orderBy("export_id", "position").collect()]


def test_quarantine_reasons(spark):
    bad = S.quarantined(docs(spark, "[]", "{}", '{"roots":[]}', "{oops", bar(link())))
    assert [(r["export_id"], r["reason"]) for r in bad.orderBy("export_id").collect()] == [
        ("0", S.NOT_OBJECT), ("1", S.NO_ROOTS), ("2", S.ROOTS_NOT_OBJECT), ("3", S.NOT_JSON)]


def test_kinds_titles_and_drops(spark):
    kept, bad = flat(spark, bar(
        {"children": [link("in")]}, {"type": "url", "name": "", "url": "http://a"}, {"name": "no type"},
        {"type": "separator"}, {"type": "url", "url": ""}, 7, {"type": "FOLDER", "name": None}, link("b")))
    shown = [(r["kind"], r["title"], r["ordinal"]) for r in kept]
    assert shown == [("folder", "Root", 0), ("folder", "Bookmark Bar", 0), ("url", "Untitled", 0), ("url", "b", 1),
                     ("folder", "Untitled", 0), ("url", "in", 0), ("folder", "Untitled", 1)]
    assert [r["reason"] for r in bad] == ["rejected: unknown type ''", "rejected: unknown type 'separator'", "rejected: bookmark without URL", "rejected: not an object"]


def test_sections(spark):
    kept, _ = flat(spark, {"roots": {
        "synced": folder("", link("m")), "trash": folder("x", link()), "other": folder("Other bookmarks"), "bookmark_bar": link("direct")}})
    assert [(r["kind"], r["title"], r["depth"]) for r in kept] == [
        ("folder", "Root", 0), ("url", "direct", 1), ("folder", "Other bookmarks", 1), ("folder", "Mobile", 1), ("url", "m", 2)]


def test_empty_export(spark):
    kept, bad = flat(spark, {"roots": {"other": {}, "synced": None}})
    assert [r["title"] for r in kept] == ["Root"] and bad == []


def test_deep_export_and_depth_guard(spark):
    node = link("leaf")
    for i in range(12):
        node = folder(f"f{i}", node)
    kept, _ = flat(spark, bar(node))
    assert max(r["depth"] for r in kept) == 14 and kept[-1]["folder_path"][:3] == ["Root", "Bookmark Bar", "f11"]
    kept, bad = T.flatten_exports(S.sound(docs(spark, bar(node), bar(link("flat"), {"type": "x"}))), max_depth=3)
    assert {r["export_id"] for r in kept.collect()} == {"1"} and kept.count() == 3
    assert sorted((r["export_id"], r["reason"]) for r in bad.collect()) == [("0", T.TOO_DEEP), ("1", "rejected: unknown type 'x'")]


def test_flatten_undoes_fold(spark):
    source = {"roots": {"bookmark_bar": folder("Bookmark Bar", link("a"), folder('q "x"', folder("empty"), link("b\n", "http://b?x=1&y"))), "synced": folder("Mobile", link("c"))}}
    once, _ = T.flatten_exports(S.sound(docs(spark, source)))
    again, _ = T.flatten_exports(S.sound(S.parse_exports(T.fold_exports(once))))
    cols = ["node_key", "parent_key", "kind", "title", "url", "ordinal", "depth", "folder_path"]
    assert once.select(*cols).orderBy("node_key").collect() == again.select(*cols).orderBy("node_key").collect()


def test_subtree_counts(spark):
    kept, _ = T.flatten_exports(S.sound(docs(spark, bar(link("1"), link("2"), folder("f", link("3"), link("4")), folder("e")))))
    got = {r["node_key"]: r["bookmarks"] for r in T.subtree_counts(kept).collect()}
    assert sorted(got.values()) == [0, 2, 4, 4]
    direct = {r["node_key"]: (r["folders"], r["bookmarks"]) for r in T.child_counts(kept).collect()}
    assert sorted(direct.values()) == [(0, 0), (0, 2), (1, 0), (2, 2)]


def outline(spark, source, **caps):
    kept, _ = T.flatten_exports(S.sound(docs(spark, source)))
    return [r.asDict() for r in O.outline_rows(kept, **caps).orderBy("pos").collect()], kept


def test_folder_cap(spark):
    rows, _ = outline(spark, bar(*[link(f"l{i}") for i in range(55)]))
    assert len(rows) == 2 + 50 + 1
    assert rows[-1]["label"] == "... и 5 еще" and rows[-1]["node_id"] == "collapsed_52" and rows[-1]["parent_id"] == "folder_1"


def test_dropped_folder_takes_its_subtree(spark):
    rows, _ = outline(spark, bar(folder("a", link("x")), folder("b", link("y")), link("z")), max_children=1)
    assert [r["label"] for r in rows] == ["Root", "Bookmark Bar", "a", "x", "... и 2 еще"]


def test_node_cap(spark):
    source = {"roots": {"bookmark_bar": link("l0")}}
    rows, _ = outline(spark, bar(*[link(f"l{i}") for i in range(10)]), max_nodes=5)
    assert [r["node_id"] for r in rows] == ["folder_0", "folder_1", "bookmark_2", "bookmark_3", "bookmark_4", "limit_reached"]
    assert rows[-1]["parent_id"] == "folder_1" and rows[-1]["label"].endswith("предел 5 узлов")
    assert len(outline(spark, source)[0]) == 2


def test_outline_text(spark):
    rows, kept = outline(spark, bar(folder("F", link('say "hi"')), link("z")))
    text = O.outline_text(O.outline_rows(kept)).first()["outline"].split("\n")
    assert text == ["graph TD", "  folder_0[Root]", "  folder_1[Bookmark Bar]", "  folder_0 --> folder_1", "  folder_2[F]", "  folder_1 --> folder_2",
                    "  bookmark_3(\"say 'hi'\")", "  folder_2 --> bookmark_3", '  bookmark_4("z")', "  folder_1 --> bookmark_4"]
    assert O.fenced(O.outline_text(O.outline_rows(kept))).first()["document"].startswith("```mermaid\ngraph TD")


def test_visit_orders(spark):
    kept, _ = T.flatten_exports(S.sound(docs(spark, bar(folder("f", link("in")), link("out")))))
    def names(order):
        return [r["title"] for r in T.visit_order(kept, order).orderBy("position").collect()]
    assert names("processing") == ["Root", "Bookmark Bar", "out", "f", "in"]
    assert names("outline") == ["Root", "Bookmark Bar", "f", "in", "out"]


def test_table_function_agrees(spark):
    from linkatlas.functions.sql import register_python_functions

    register_python_functions(spark)
    raw = json.dumps(bar(folder("f", link("in"), {"type": "separator"}), {"children": []}, link("out")))
    kept, _ = flat(spark, raw)
    got = spark.sql("SELECT n.* FROM VALUES ({r}) AS t(raw), LATERAL bookmark_nodes(raw) n ORDER BY node_key", r=raw).collect()
    assert [(r["node_key"], r["title"]) for r in got] == [(r["node_key"], r["title"]) for r in kept]
    assert spark.sql("SELECT n.* FROM VALUES ('{oops') AS t(raw), LATERAL bookmark_nodes(raw) n").count() == 0
