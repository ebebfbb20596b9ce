"""Review items: filters, order, pages, tree, edit log, and the registered queries."""

import hashlib

import pytest

import __spark_entry__ as entry
from cuadrante.functions import urls as U
from cuadrante.operators import review
from pyspark.sql import functions as F

COLUMNS = "ord long, pos int, accepted boolean, file string, page int, degree_code string, degree_name string, academic_year string, semester int, year int, grp string, day string, start_time string, end_time string, name string, subgroup string, classroom string, raw_text string, issues array<string>"


@pytest.fixture(scope="module")
def items(spark):
    row = lambda ord_, ok, degree, code, year, grp, issues: (ord_, 0, ok, "f.pdf", 1, code, degree, "2025/2026", 1, year, grp, "LUNES", "09:00", "09:55", f"S{ord_}", None, "NA7", "raw", issues)
    rows = [row(1, True, "X", "G1", 1, "1A", []), row(2, True, None, None, None, "", ["missing_degree"]), row(3, False, "X", None, 10, "1A", ["invalid_day"]), row(4, True, "Y", "G1", 2, "1B", []), row(5, True, "X", "G1", 0, None, [])]
    return review.items(spark.createDataFrame(rows, COLUMNS)).cache()


def ords(df):
    return [r["ord"] for r in df.select("ord").collect()]


def test_items(items):
    first = items.where("ord = 1").first()
    assert first["id"] == "a" + hashlib.sha1(b"accepted|f.pdf|1|1").hexdigest()[:20]
    assert {r["ord"]: r["status"] for r in items.collect()} == {1: "VALID", 2: "WARNING", 3: "INVALID", 4: "VALID", 5: "VALID"}


def test_filters(items):
    f = lambda **x: sorted(ords(review.apply_filters(items, x)))
    assert f(degree="G1") == [1, 4, 5] and f(degree="X") == [3] and f(degree=None, year="") == [1, 2, 3, 4, 5]
    assert f(year="__NULL__") == [2, 5] and f(group="__NULL__") == [2, 5] and f(degree="None") == [2]
    assert f(issue="invalid_day") == [3] and f(status="WARNING") == [2] and f(search=" s4 NA7 ") == [4]


def test_pages(items):
    assert ords(review.page(items, 1, 3)) == [2, 5, 1] and ords(review.page(items, 2, 3)) == [3, 4] and ords(review.page(items, -1, 0)) == [2]
    assert review.page_info(5, 0, 0) == {"total": 5, "page": 0, "page_size": 0, "total_pages": 0} and review.page_info(5, 1, 2)["total_pages"] == 3


def test_tree_and_facets(items):
    tree = {(r["degree"], r["year"], r["semester"], r["grp"]): r["n"] for r in review.tree(items).collect()}
    assert tree["X", None, None, None] == 3 and tree["Sin titulación", "Sin curso", "1", "Sin grupo"] == 1 and len(tree) == 3 + 5 + 5 + 5
    assert [(r["code"], r["label"]) for r in review.degree_facet(items).select("code", "label").collect()] == [("G1", "X"), ("X", "X")]
    found = {tuple(r) for r in review.facets(items).collect()}
    assert ("years", "10") in found and ("issues", "missing_degree") in found and ("groups", "") not in found


def test_edit_log(spark, items):
    plain = [c for c in review.FIELDS if c in items.columns and c not in ("classroom", "notes")]
    event = lambda o, seq, kind, room, status=None: items.where(F.col("ord") == o).select("id", F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), *plain, F.lit(room).alias("classroom"), F.lit(status).cast("string").alias("new_status"))
    log = event(1, 1, "edit", "B1").unionByName(event(2, 1, "edit", "B2")).unionByName(event(2, 2, "restore", "")).unionByName(event(3, 1, "status", "", "VALID")).unionByName(event(4, 1, "restore", "")).unionByName(event(4, 2, "edit", "NA7")).unionByName(event(5, 1, "status", "", "BAD"))
    got = {r["ord"]: (r["classroom"], r["status"], r["reviewed"], r["manually_modified"]) for r in review.replay(items, log).collect()}
    assert got == {1: ("B1", "VALID", True, True), 2: ("NA7", "WARNING", True, False), 3: ("NA7", "VALID", True, False), 4: ("NA7", "VALID", True, False), 5: ("NA7", "VALID", False, False)}


def test_urls(spark):
    cases = [("HTTP://A.Com#x", "http://a.com/"), ("https://a.com/b?q=1#f", "https://a.com/b?q=1"), ("ftp://a.com", None), ("mailto:x", None)]
    row = spark.range(1).select(*[U.normalize(F.lit(u)).alias(f"c{i}") for i, (u, _) in enumerate(cases)]).first()
    assert list(row) == [c[1] for c in cases]
    html = "<a href='/r'>a</a><a class=\"k\" href=\"s.pdf\">b</a><a href=\"#t\">c</a><a href='../u'>d</a><a href='//b.com/v'>e</a><A HREF='?w=1'>f</A><a href=''>g</a><a href='javascript:x'>h</a>"
    pages = spark.createDataFrame([(1, "https://a.com/x/y/z", html)], "page_id long, url string, html string")
    assert sorted(r["link"] for r in U.extract_links(pages).collect()) == ["https://a.com/r", "https://a.com/x/u", "https://a.com/x/y/s.pdf", "https://a.com/x/y/z", "https://a.com/x/y/z?w=1", "https://b.com/v"]
    names = [("https://a.com/b%20c+d.pdf?x", "b_c_d.pdf"), ("https://a.com/", "a.com.pdf"), ("https://a.com/q/File", "a.com_q_File.pdf")]
    row = spark.range(1).select(*[U.safe_filename(F.lit(u)).alias(f"c{i}") for i, (u, _) in enumerate(names)]).first()
    assert list(row) == [n[1] for n in names]


def test_entry(spark):
    names = entry.queries()
    assert len(names) > 60 and set(entry.oracle_sql()) <= set(names)
    assert entry.entry(spark).count() > 0
