"""Files below a folder are found and read by the tasks; the driver holds no list of them."""

import hashlib

import duckdb
import pytest

import __spark_entry__ as entry
from compare import difference
from linkatlas.sources import documents as D

QUERIES, CHECKS = entry.catalog.queries(), entry.catalog.checks()


def tree(top):
    """Files of a narrow and a wide tree, with names that need quoting in a URI and names that Spark passes over; returns the contents that it reads, and all."""
    seen, rest = {}, {}
    for i in range(30):
        seen[top / f"a{i % 7}" / f"b {i}%41" / "ü" / f"{i}#?.md"] = f"text {i} ".encode() * (i + 1)
    seen[top.joinpath(*"abcdefgh", "deep")] = b"x" * (D.BLOCK + 1)
    seen[top / "_k=1" / "_metadata" / "f"] = b"f"
    for name in ("_SUCCESS", ".hidden", "_metadata", "a0/_logs/x", "a1/y._COPYING_"):
        rest[top / name] = name.encode()
    rest[top / "a2" / "empty"] = b""
    for path, content in (seen | rest).items():
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    (top / "a0" / "gone").symlink_to(top / "nowhere")
    spelled = lambda some: {f"file:{p}": c for p, c in some.items()}
    return spelled(seen), spelled(seen | rest)


@pytest.mark.parametrize("folders", [2, 1000])
def test_hashes_of_a_tree(spark, tmp_path, monkeypatch, folders):
    monkeypatch.setattr(D, "FOLDERS", folders)
    monkeypatch.setattr(D, "PATHS", 5)
    seen, every = tree(tmp_path / "a folder")
    found = D.file_hashes(spark, f"{tmp_path}/a folder/", "sha256")
    assert found.inputFiles() == []
    assert sorted(p for p, in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path / "a folder")).select("path").collect()) == sorted(seen)
    hashes = lambda some: sorted((p, hashlib.sha256(c).hexdigest()) for p, c in some.items())
    assert sorted(map(tuple, found.collect())) == hashes(seen)
    assert sorted(map(tuple, D.file_hashes(spark, (tmp_path / "a folder").as_uri().replace("%20", " "), "sha256", every=True).collect())) == hashes(every)


def test_hashes_of_other_paths(spark, tmp_path):
    seen, _ = tree(tmp_path / "t")
    assert D.file_hashes(spark, str(tmp_path / "t" / "a[0-2]")).count() == sum("/t/a0/" in p or "/t/a1/" in p or "/t/a2/" in p for p in seen)
    assert D.file_hashes(spark, str(tmp_path / "t" / "_k=1" / "_metadata" / "f")).first()["hash"] == hashlib.md5(b"f").hexdigest()
    (tmp_path / "none").mkdir()
    assert D.file_hashes(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        D.file_hashes(spark, str(tmp_path / "missing"))


TITLES = ["Plain", "out of it", "way/out", '"Quoted"', ".dots", "_low", "50%41 #?", "Same", "Same", "Füße", ""]


@pytest.fixture
def pages(tmp_path):
    con = duckdb.connect()
    rows = [(i, f"https://outer.example.org/en/{i}", f"<html><head><title>{t}</title></head><body><p>Text {i}</p></body></html>") for i, t in enumerate(TITLES)]
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    con.execute(f"COPY pages TO '{tmp_path}/pages.parquet'")
    return str(tmp_path), con


def test_hashes_of_documents(spark, pages):
    sf_dir, con = pages
    found = QUERIES["s10_file_hashes"](spark, sf_dir)
    assert found.inputFiles() == []
    assert difference(found, con, CHECKS["s10_file_hashes"]) is None


def test_contents_of_a_tree(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(D, "BATCH", 100)
    seen, every = tree(tmp_path / "t")
    found = D.file_contents(spark, str(tmp_path / "t"))
    assert found.inputFiles() == []
    assert {r.path: bytes(r.content) for r in found.collect()} == seen
    assert {r.path: bytes(r.content) for r in D.file_contents(spark, str(tmp_path / "t"), every=True).collect()} == every


def test_documents_read_back(spark, pages):
    sf_dir, con = pages
    found = QUERIES["s7_document_files"](spark, sf_dir)
    assert found.inputFiles() == []
    assert difference(found, con, CHECKS["s7_document_files"]) is None
