"""The review's index against the same questions without it: pages, lookups, searches, counts, with and without edits."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cuadrante.operators import live, review
from cuadrante.review_index import Index, files_read
from cuadrante.review_store import Review

NAMES = ["Redes", "Señales y Sistemas", "Física II", "a_b%c", "Ñandú", "", None, "Redes Avanzadas", "😀 emoji", "ab"]


@pytest.fixture(scope="module")
def items(spark):
    rng = random.Random(5)
    pick = lambda *x: rng.choice(x)
    rows = [
        (i // 3, i % 3, f"f{rng.randint(0, 9)}.pdf", 1, pick(None, "", "G1", "G2"), pick("GRADO A", "GRADO B", "", None), "2025/2026", pick(1, 2, None), pick(1, 2, 10, None), pick("1A", "10", "9", "", None), pick("LUNES", "MARTES"), pick("09:00", "10:00"),
         "11:00", rng.choice(NAMES), None, pick("NA7", "LAB"), [], f"raw {rng.randint(0, 99)} text", pick([], ["unknown_classroom"], ["a", "b"]), 0.5, rng.random() < 0.8)
        for i in range(900)
    ]
    kinds = "ord long, pos int, file string, page int, degree_code string, degree_name string, academic_year string, semester int, year int, grp string, day string, start_time string, end_time string, name string, subgroup string, classroom string, notes array<string>, raw_text string, issues array<string>, confidence double, accepted boolean"
    out = review.items(spark.createDataFrame(rows, kinds)).cache()
    out.count()
    return out


@pytest.fixture(scope="module")
def index(items, tmp_path_factory):
    return Index.build(items, f"file://{tmp_path_factory.mktemp('index')}/i", chunk=64)


def ids(df):
    return [r["id"] for r in df.select("id").collect()]


def test_pages_by_rank(items, index):
    for number, size, filters in ((1, 50, {}), (7, 50, {}), (0, 500, None), (18, 50, {}), (19, 50, {}), (1000, 50, {}), (3, 20, {"day": "LUNES"}), (5, 13, {"group": "__NULL__"}), (2, 50, {"search": "redes", "year": 2}), (1, 50, {"day": "none"})):
        want = review.page(review.apply_filters(items, filters or {}), number, size)
        assert ids(index.page(number, size, filters)) == ids(want), (number, size, filters)
    assert files_read(index.page(7, 50))["rows"] <= 2 and files_read(index.rows())["rows"] >= 14


def test_search_by_trigrams(items, index):
    for query in ("redes", " REDES ", "señales", "senales", "ii", "a", "", "a_b%c", "%", "😀 e", "raw 7", "na7 1a", "nothing like it", "ñan", "lab raw 3", "redes avanzadas na7"):
        assert sorted(ids(index.search(query))) == sorted(ids(items.where(review.matches(query)))), query
    read = files_read(index.search("raw 77 text"))
    assert read["rows"] < files_read(index.rows())["rows"] and files_read(index.search("zzzz")).get("rows", 0) == 0


def test_lookup_reads_one_folder(items, index):
    wanted = ids(items)[::97]
    for item in [*wanted, "no such id", ""]:
        assert ids(index.find(item)) == ([item] if item in wanted else [])
    assert files_read(index.find(wanted[0])) == {"rows": 1}
    ids_scan = index._table("ids", "id string, number long, bucket int").where("bucket = 3")
    assert files_read(ids_scan)["ids"] == 1
    assert sorted(ids(index.with_ids(items.where("ord < 5")))) == sorted(ids(items.where("ord < 5")))


def test_an_empty_index(spark, items, tmp_path):
    index = Index.build(items.limit(0), f"file://{tmp_path}/i")
    assert index.page().count() == index.search("redes").count() == index.find("x").count() == index.counts().count() == 0
    assert Index.at(spark, f"file://{tmp_path}/other") is None


def told(df):
    return [tuple(r) for r in df.collect()]


def test_counts_under_edits(spark, items):
    """Random edits, some of which take the last item of a value; counts are those of a count from scratch."""
    rng = random.Random(7)
    now, known, codes = items.select("id", "item_ord", "degree_code", "degree_name", "year", "semester", "grp", "day", "file", "issues"), live.counts(items), live.codes(items)
    known, codes = spark.createDataFrame(known.collect(), known.schema), spark.createDataFrame(codes.collect(), codes.schema)
    for step in range(3):
        rows = now.collect()
        chosen = {r["id"] for r in rng.sample(rows, 60)} if step else {r["id"] for r in rows if r["degree_name"] == "GRADO A"}
        after = [{**r.asDict(), "degree_name": rng.choice(["GRADO B", "NEW", None]), "degree_code": rng.choice(["X", None]), "year": rng.choice([3, None]), "grp": rng.choice(["1A", "ZZ"]), "issues": rng.choice([[], ["c"]])} if r["id"] in chosen else r.asDict() for r in rows]
        then = spark.createDataFrame([tuple(r[c] for c in now.columns) for r in after], now.schema)
        old, new = now.where(F.col("id").isin(list(chosen))), then.where(F.col("id").isin(list(chosen)))
        known = live.changed(known, old, new)
        codes = live.changed_codes(codes, then, old, new)
        known, codes = spark.createDataFrame(known.collect(), known.schema), spark.createDataFrame(codes.collect(), codes.schema)
        assert told(live.facets(known)) == told(review.facets(then)) and told(live.tree(known, codes)) == told(review.tree(then))
        now = then
    assert not [r for r in told(live.facets(known)) if r[1] == "GRADO A"] and known.where("n <= 0").count() == 0


def test_a_review_with_an_index(spark, items, tmp_path):
    """The store gives the same answers with an index as without one, before and after edits, and after compact."""
    plain, fast = (Review(spark, f"file://{tmp_path}/{n}") for n in ("plain", "fast"))
    for r in (plain, fast):
        io_items = items.drop("item_ord")
        r.refresh(io_items.select("ord", "pos", "file", "page", "degree_code", "degree_name", "academic_year", "semester", "year", "grp", "day", "start_time", "end_time", "name", "subgroup", "classroom", "notes", "raw_text", "issues", "confidence", "accepted"))
    fast.index(chunk=100)

    def same():
        for filters in ({}, {"search": "redes"}, {"search": "zzz new"}, {"day": "LUNES", "search": "na7"}, {"degree": "GRADO B"}):
            a, b = plain.records(**filters), fast.records(**filters)
            assert ids(a.page(2, 30)["items"]) == ids(b.page(2, 30)["items"]) and a.page(1, 5)["total"] == b.page(1, 5)["total"]
        assert told(plain.facets()) == told(fast.facets()) and told(plain.records().tree()) == told(fast.tree()) == told(plain.tree())

    same()
    first, second = ids(plain.records().sort())[:2]
    for r in (plain, fast):
        row = r.find(first)
        r.edit(first, {**row["current"].asDict(recursive=True), "group": "ONLY", "subject": {"code": None, "name": "zzz new name"}, "degree": {"code": "Q", "name": "GRADO Z"}})
        r.set_status(second, "INVALID")
        assert r.find(first)["current"]["group"] == "ONLY" and r.find(second)["status"] == "INVALID"
    same()
    for r in (plain, fast):
        r.restore(first)
        assert r.compact() == 2
    fast.index(chunk=100)
    same()
