"""Every registered query of the core with SQL must give DuckDB's rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from leafmill.operators import tables as O
from leafmill.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(round(r[k], 6) if isinstance(r[k], float) else r[k] for k in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    found = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical(df.collect(), df.columns) == canonical(found.fetchall(), columns)


def test_nearest_value_survives_cycles(spark):
    nodes = spark.createDataFrame([("a", "b", None), ("b", "c", None), ("c", "a", None), ("d", "e", None), ("e", None, "v"), ("f", "e", "own"), ("g", "lost", None)], "k string, p string, v string")
    got = {r.k: r.v for r in O.nearest_value(nodes.select("k"), nodes, "k", "p", "v").collect()}
    assert got == {"a": None, "b": None, "c": None, "d": "v", "e": "v", "f": "own", "g": None}


def test_page_bounds():
    assert O.page_bounds(0, 50, 3) == (1, 0) and O.page_bounds(120, 50, 9) == (3, 100) and O.page_bounds(120, 50, 0) == (1, 0)


def test_list_filter_bounds(spark):
    df = spark.createDataFrame([(1, 10, 5000, 1000, "png"), (2, 20, 9000, None, "jpeg")], "page int, side int, size long, small long, format string")
    columns = {"width": F.col("side"), "height": F.col("side"), "size": F.col("size"), "pixels": F.col("side") * F.col("side"), "compressed": F.col("small"), "page": F.col("page"), "format": F.col("format")}

    def pages(**kw):
        more = {k: kw.pop(k) for k in ("page", "compressed", "formats") if k in kw}
        return [r.page for r in df.filter(O.list_filter(columns, O.Bounds(**kw), **more)).orderBy("page").collect()]

    assert pages() == [1, 2] and pages(min_width=11) == [2] and pages(max_pixels=100) == [1]
    assert pages(min_compressed_kb=0.1) == [1] and pages(min_saving_kb=5) == [] and pages(max_size_kb=5) == [1]
    assert pages(page=2) == [2] and pages(compressed="none") == [2] and pages(formats=["png"]) == [1] and pages(formats=[]) == [1, 2]


def test_rollup_by_file_is_zero_filled(spark):
    df = spark.createDataFrame([("x", "a", 3), ("x", "a", 4), ("y", "b", 1)], "path string, c string, s long")
    got = sorted((r.path, r.position, r.category, r.n, r["size"]) for r in O.category_rollup(df, F.col("c"), F.col("s"), ["a", "b"], ["path"]).collect())
    assert got == [("x", 0, "a", 2, 7), ("x", 1, "b", 0, 0), ("y", 0, "a", 0, 0), ("y", 1, "b", 1, 1)]


def test_shares_by_group_and_of_nothing(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", 0), (None, 5)], "k string, s long")
    assert sorted((r.k or "", r.s, r.share) for r in O.share_of_total(df, "s", ["k"]).collect()) == [("", 5, 1.0), ("a", 1, 0.25), ("a", 3, 0.75), ("b", 0, 0.0)]
    assert [r.share for r in O.share_of_total(df.filter("s = 0"), "s").collect()] == [0.0]
    assert O.share_of_total(df.limit(0), "s").count() == 0


def test_reachability_through_many_levels(spark, monkeypatch):
    monkeypatch.setattr(O, "MERGE_LEVELS", 3)
    edges = spark.createDataFrame([(str(k), str(k + 1)) for k in range(9)] + [("9", "0"), ("x", "y")], "src string, dst string")
    roots = spark.createDataFrame([("0",)], "node string")
    assert sorted(r.node for r in O.reachable(edges, roots).collect()) == [str(k) for k in range(10)]
