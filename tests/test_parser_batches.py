"""The page parser holds a few pages as Python objects at a time, not a whole Arrow batch."""

import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from linkatlas.functions import html as H


def test_a_batch_costs_little_beside_its_buffers():
    pages = pa.array(["five words of plain text" * 1000, None] * 1000)
    tracemalloc.start()
    got = H.read_each(pages, lambda page: page)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.equals(pages)
    assert most < 4 << 20 < pages.nbytes


def test_pages_of_one_batch_keep_their_rows(spark):
    rows = [(i, None if i % 5 == 0 else f"<main>{i}</main>") for i in range(1000)]
    got = spark.createDataFrame(rows, "i int, html string").coalesce(1).select("i", H.parsed_text(F.col("html")).alias("t")).collect()
    assert {r.i: r.t for r in got} == {i: None if i % 5 == 0 else str(i) for i, _ in rows}
