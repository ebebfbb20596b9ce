"""Sources, sinks, the stored review with its edits, the stream, the older format and the crawl."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from cuadrante.operators import crawl, intervals, layout, legacy, records, review, timetable
from cuadrante.functions import urls as U
from cuadrante.plans import catalogue
from cuadrante.review_store import KEYS, NotFound, Review, ReviewError, checked
from cuadrante.sources import io, shared
from cuadrante.streaming import ingest

CELL = "ord long, file string, page int, degree_code string, degree_name string, academic_year_raw string, semester int, year int, grp string, day string, start_time string, end_time string, cell_text string"


def cells(spark):
    row = lambda i, text, degree="GII": (i, "f.pdf", 1 + i % 2, None, degree, "2025/26", 1, 2, "2A", "Lunes", "9:00", "9:55", text)
    return spark.createDataFrame([row(1, "Redes Avanzadas - 2A1 (NA7)"), row(2, "Señales y Sistemas (LAB)"), row(3, "sin formato"), row(4, "Uno Dos Tres - 2A (NA1) Cuatro Cinco - 2A (NA2)", None)], CELL)


@pytest.fixture()
def store(spark, tmp_path):
    r = Review(spark, f"file://{tmp_path}/review")
    assert r.ensure(records.build(cells(spark))) == 1 and r.ensure(records.build(cells(spark))) == 1
    return r


def payload(row, **changes):
    c = row["current"].asDict(recursive=True)
    return {**c, **changes}


def test_edits(store):
    ids = [r["id"] for r in store.records().sort().select("id").collect()]
    assert len(ids) == 5
    first = store.find(ids[0])
    assert first["current"] == first["original"] and not first["reviewed"]
    assert store.edit(ids[0], payload(first, classroom="ZZ9")) == 1
    assert store.edit(ids[0], payload(first, classroom="ZZ8", notes=["a"]), expected=1) == 2
    after = store.find(ids[0])
    assert after["current"]["classroom"] == "ZZ8" and after["current"]["notes"] == ["a"] and after["manually_modified"] and after["reviewed"] and after["original"] == first["original"]
    assert store.set_status(ids[1], "INVALID") == 3 and store.find(ids[1])["status"] == "INVALID"
    # Stored as a new version, the originals are still known.
    assert store.compact() == 2 and store.find(ids[0])["current"]["classroom"] == "ZZ8"
    assert store.restore(ids[0]) == 1
    back = store.find(ids[0])
    assert back["current"] == first["current"] and not back["manually_modified"] and back["reviewed"] and back["status"] == first["status"]
    assert store.edit(ids[0], payload(first)) == 2 and not store.find(ids[0])["manually_modified"]
    stats = records.global_stats(records.file_stats(records.page_stats(store.items())), store.spark.createDataFrame([("x.pdf", "broken")], "file string, error string"))
    s = store.summary(stats, store.spark.createDataFrame([("x.pdf", "broken")], "file string, error string"), "2026-01-01 00:00:00").first()
    assert (s["pdfs_found"], s["pdfs_failed"], s["total_records"], s["reviewed_records"], s["processed_at"]) == (2, 1, 5, 2, "2026-01-01 00:00:00") and s["failed_files"][0]["error"] == "broken"


def test_what_edits_refuse(store):
    item = store.records().sort().first()["id"]
    row = store.find(item)
    with pytest.raises(NotFound):
        store.find("no such id")
    with pytest.raises(NotFound):
        store.restore("no such id")
    with pytest.raises(ReviewError):
        store.set_status(item, "FINE")
    for key in KEYS:
        with pytest.raises(ReviewError):
            checked({k: v for k, v in payload(row).items() if k != key})
    for bad in (None, [], payload(row, degree="x"), payload(row, subject=None), payload(row, notes="x"), payload(row, notes=[1]), payload(row, year="2"), payload(row, year=True), payload(row, day=3)):
        with pytest.raises(ReviewError):
            checked(bad)
    assert store.edit(item, payload(row), expected=0) == 1
    with pytest.raises(io.Conflict):  # this writer hasn't seen the first edit
        store.edit(item, payload(row, day="MARTES"), expected=0)
    io.create_text(store.spark, f"{store._log_folder(1)}/{2:010d}.json", json.dumps({"seq": 2, "version": 1, "id": item, "kind": "restore"}))
    with pytest.raises(io.Conflict):
        io.create_text(store.spark, f"{store._log_folder(1)}/{2:010d}.json", "{}")
    with pytest.raises(NotFound):
        Review(store.spark, store.folder + "-none").items()


def test_pages_and_facets(store):
    page = store.records(day="LUNES").page(1, 2)
    assert page["total"] == 5 and page["total_pages"] == 3 and page["items"].count() == 2
    assert [(r["facet"], r["value"]) for r in store.facets().where("facet in ('years', 'statuses')").collect()] == [("statuses", "VALID"), ("statuses", "WARNING"), ("statuses", "INVALID"), ("years", "2")]
    assert store.records().tree().where("level = 1").count() == 2 and store.degrees().count() == 1


def test_reasons(spark):
    rows = records.build(cells(spark)).withColumn("reason", F.when(F.col("accepted"), F.array().cast("array<string>")).otherwise(F.array(F.lit("given"))))
    found = {r["origin"]: r["original_reason"] for r in review.items(rows).collect()}
    assert found["rejected"] == ["given"]


def test_versions(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert io.read_table(spark, path) is None and io.versions(spark, path) == []
    for n in range(1, 5):
        assert io.replace_table(spark.range(n), path, keep=2) == n
    assert io.read_table(spark, path).count() == 4 and io.versions(spark, path) == [2, 3, 4]
    assert io.read_table(spark, path, version=2).count() == 2 and io.read_table(spark, path, version=1) is None


def test_files(spark, tmp_path):
    for name in ("b.pdf", "a.PDF", "sub/c.Pdf", "x.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"%PDF")
    names = lambda df: [r["path"].rsplit("/", 1)[1] for r in df.collect()]
    assert names(io.find_pdfs(spark, str(tmp_path))) == ["a.PDF", "b.pdf", "c.Pdf"] and names(io.find_pdfs(spark, str(tmp_path), recursive=False)) == ["a.PDF", "b.pdf"]
    assert bytes(io.file_bytes(spark, f"{tmp_path}/b.pdf").first()["content"]) == b"%PDF"


def test_result_documents(spark, tmp_path):
    record = {"degree": {"code": "G1", "name": "X"}, "academic_year": "2025/2026", "semester": 1, "year": 2, "group": "2A", "day": "LUNES", "start_time": "09:00", "end_time": "09:55", "subject": {"code": None, "name": "REDES"}, "subgroup": None, "classroom": "NA7", "notes": [], "source": {"file": "f.pdf", "page": 1, "raw_text": "raw"}, "extraction": {"degree_source": "document", "confidence": 0.85, "issues": ["unknown_classroom"]}}
    (tmp_path / "r.json").write_text(json.dumps({"schema_version": "2.0", "processed_at": "2026-01-01 00:00:00", "statistics": {"pdfs_found": 1}, "files": [], "records": [record, record], "rejected_records": [{"reason": ["invalid_day"], "record": record}], "failed_files": []}))
    flat = io.result_records(io.read_result(spark, f"{tmp_path}/r.json"))
    assert [(r["accepted"], r["pos"], r["name"], r["reason"]) for r in flat.orderBy(F.desc("accepted"), "pos").collect()] == [(True, 0, "REDES", None), (True, 1, "REDES", None), (False, 0, "REDES", ["invalid_day"])]
    items = review.items(flat)
    assert {r["status"] for r in items.collect()} == {"WARNING", "INVALID"} and items.where("origin = 'rejected'").first()["original_reason"] == ["invalid_day"]
    (tmp_path / "old.json").write_text(json.dumps({"schema_version": "1.0", "standard_schedule": [{"source": {"archivo": "f.pdf", "pagina": 1}, "subject": {"nombre": "REDES"}}]}))
    assert io.read_legacy(spark, f"{tmp_path}/old.json").first()["subject"]["nombre"] == "REDES"


def test_sinks(spark, tmp_path):
    rows = records.build(cells(spark))
    io.write_by_file(rows, f"{tmp_path}/by_file")
    assert [p.name for p in (tmp_path / "by_file").glob("file=*")] == ["file=f.pdf"] and spark.read.json(f"{tmp_path}/by_file").count() == 5
    good, bad = records.split_results(spark.createDataFrame([("a", None), ("b", "no text")], "file string, error string"))
    assert [r["file"] for r in good.collect()] == ["a"] and [tuple(r) for r in bad.collect()] == [("b", "no text")]
    files = records.file_stats(records.page_stats(rows))
    io.write_result(f"{tmp_path}/out", rows, records.global_stats(files, bad), files, bad, "2026-01-01 00:00:00")
    head = spark.read.json(f"{tmp_path}/out/statistics").first()
    assert head["schema_version"] == "2.0" and head["statistics"]["pdfs_failed"] == 1 and head["statistics"]["accepted_records"] == spark.read.json(f"{tmp_path}/out/records").count() == 4
    assert spark.read.json(f"{tmp_path}/out/rejected_records").count() == 1


def test_lookups(spark):
    assert io.first_message(spark, spark.createDataFrame([("hola",), ("adios",)], "mensaje string")).count() == 1
    users = spark.createDataFrame([(1, "ana"), (2, "x' OR '1'='1")], "id int, username string")
    assert [r["id"] for r in io.find_user(spark, users, "ana").collect()] == [1] and io.find_user(spark, users, "' OR 1=1 --").count() == 0
    assert io.catalog(spark).where("code = 'GII'").first()["number"] == "G781"


def test_stream(spark, tmp_path):
    cells(spark).write.json(f"{tmp_path}/in")
    done = []
    for _ in range(2):  # the second run finds nothing new
        ingest.start_records(ingest.stream_cells(spark, f"{tmp_path}/in", CELL), f"{tmp_path}/out", f"{tmp_path}/check", done.append).awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5 and done == sorted(set(done)) and len(done) >= 1


def test_older_pages(spark):
    blocks = spark.createDataFrame([("f", 1, 0, "nota", 0.0, 10.0), ("f", 1, 1, "LUNES MARTES MIÉRCOLES", 0.0, 100.0), ("f", 1, 2, "LUNES MARTES JUEVES", 50.0, 60.0), ("f", 1, 3, "Redes", 13.0, 13.0), ("f", 1, 4, "fuera", 0.0, 4.0), ("g", 1, 0, "LUNES", 0.0, 9.0)], "file string, page int, ord long, text string, x0 double, x1 double")
    columns = legacy.day_columns(blocks)
    got = [(r["day_idx"], round(r["x0"], 2), round(r["x1"], 2)) for r in columns.orderBy("day_idx").collect()]
    assert got == [(i, round(13 + 17.4 * i, 2), round(13 + 17.4 * (i + 1), 2)) for i in range(5)]
    days = {(r["file"], r["ord"]): r["day"] for r in legacy.assign_day(blocks, columns).collect()}
    assert days["f", 3] == "LUNES" and days["f", 4] is None and days["f", 1] == "MIÉRCOLES" and days["g", 0] is None and len(days) == 6
    times = spark.createDataFrame([("f", 1, 0, 100.0), ("f", 1, 1, 150.0)], "file string, page int, row_idx long, y double")
    placed = spark.createDataFrame([(i, "f", 1, y) for i, y in enumerate((60.0, 80.0, 125.0, 126.0, 185.0))], "block_id long, file string, page int, cy double")
    assert [r["nearest"] for r in legacy.assign_time(placed, times).orderBy("block_id").collect()] == [None, 0, 0, 1, None]


def test_colours(spark):
    rows = [(f"s{i % 40}", (i * 7919) % 1000) for i in range(300)] + [("null", None)]
    want = {}
    for s, at in sorted(((s, a) for s, a in rows if a is not None), key=lambda x: x[1]):
        want.setdefault(s, at)
    rank = {a: i for i, a in enumerate(sorted(set(want.values())))}
    got = {r["s"]: r["colour"] for r in intervals.colour_index(spark.createDataFrame(rows, "s string, at int"), "s", "at", buckets=5).collect()}
    shift = 1  # a subject without a first comes first
    assert got == {s: (rank[a] + shift) % 8 for s, a in want.items()} | {"null": 0}
    assert intervals.colour_index(spark.createDataFrame([], "s string, at int"), "s", "at").count() == 0


def test_crawl(spark):
    page = lambda i, url, *links: (i, url, " ".join(f'<a href="{x}">x</a>' for x in links))
    pages = spark.createDataFrame([page(1, "http://h.es/", "a.pdf", "/b", "c", "http://o.es/x.pdf", "i.png"), page(2, "http://h.es/b", "a.pdf", "d.pdf?x=1", "/", "/e"), page(3, "http://h.es/e", "deep.pdf"), page(4, "http://h.es/c")], "page_id int, url string, html string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    visited, found = crawl.crawl(pages, " HTTP://h.es#x")
    assert rows(visited) == [("http://h.es/", 0)] and rows(found) == [("http://h.es/a.pdf", 0)]
    visited, found = crawl.crawl(pages, "http://h.es/", follow=True)
    assert rows(visited) == [("http://h.es/", 0), ("http://h.es/b", 1), ("http://h.es/c", 1), ("http://h.es/e", 2)] and rows(found) == [("http://h.es/a.pdf", 0), ("http://h.es/d.pdf?x=1", 1), ("http://h.es/deep.pdf", 2)]
    assert crawl.crawl(pages, "http://h.es/", max_pages=2, follow=True)[0].count() == 2 and crawl.crawl(pages, "http://h.es/", max_depth=1, follow=True)[0].count() == 3
    assert rows(crawl.crawl(pages, "http://h.es/z.pdf")[1]) == [("http://h.es/z.pdf", 0)] and crawl.crawl(pages, "mailto:x")[0].count() == 0
    kinds = spark.createDataFrame([("Application/PDF; x",), ("text/html",), ("application/xhtml+xml",), ("image/png",), (None,)], "t string").select(U.content_kind(F.col("t"))).collect()
    assert [k[0] for k in kinds] == ["pdf", "html", "html", "skip", "skip"]
    got = spark.createDataFrame([(None,), (" ",), ("ftp://x",), (" https://x",)], "u string").select(crawl.start_problem(F.col("u"))).collect()
    assert [g[0] for g in got] == ["empty", "empty", "scheme", None]


def test_words_to_records(spark):
    """Every cell of the placed pages comes back with its place and text."""
    got = catalogue.pages_to_records(spark, "/root/testdata/sf0.001")
    assert got.where("pos = 0").count() == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()


def test_spread(spark):
    assert shared.spread(spark.read.parquet("/root/testdata/sf0.001/orders.parquet")).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_repeated_choice(spark):
    chosen, taken = spark.createDataFrame([("a",), ("a",), ("b",)], "id string"), spark.createDataFrame([("b",)], "id string")
    assert [r["id"] for r in review.without_repeats(chosen, taken).collect()] == ["a"]


def test_files_to_cells(spark, tmp_path):
    """JSON stands in for a PDF library."""
    days = ["LUNES", "MARTES", "MIÉRCOLES", "JUEVES", "VIERNES"]
    words = [[d, 100 + 100 * i, 0, 140 + 100 * i, 8] for i, d in enumerate(days)] + [["Redes", 110, 48, 120, 52], ["(NA7)", 121, 48, 130, 52]]
    page = {"width": 700, "height": 200, "text": "GRADO EN X (G1)", "words": words, "blocks": [["9:00 / 9:55", 0, 40, 20, 60]]}
    (tmp_path / "a.pdf").write_text(json.dumps([page, {**page, "words": []}]))
    (tmp_path / "b.PDF").write_bytes(b"%PDF broken")
    files = io.find_pdfs(spark, str(tmp_path)).select("path")
    contents = spark.read.format("binaryFile").load(str(tmp_path)).join(files, "path")
    w, b, pages, failed = io.geometry(io.decode_pages(contents, lambda c: json.loads(c)).cache())
    assert pages.count() == 2 and [r["file"] for r in failed.collect()] == ["b.PDF"] and failed.first()["error"]
    assert [(r["file"], r["page"], r["day"], r["start_time"], r["cell_text"]) for r in layout.build_cells(w, b, pages).collect()] == [("a.pdf", 1, "LUNES", "09:00", "Redes (NA7)")]


def test_timetable(spark):
    degrees, subjects, sessions = io.tables(
        spark, [("D1", "Grado en Informática"), ("D2", "Otro")],
        [(1, "D1", "Programación", "Grupo A"), (2, "D1", "Redes", "Grupo B"), (3, "D2", "Física", None), (4, "D9", "Suelta", "Grupo A")],
        [(1, "Lunes", "10:00", "12:00", "L1"), (1, "Lunes", "11:00", "12:30", "L1"), (2, "Lunes", "11:00", "13:00", "L2"), (3, "Lunes", "12:00", "14:00", None), (3, "Martes", "x", "9:00", "L3"), (4, "Lunes", "10:30", "11:00", "L4")],
    )
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(timetable.pick(subjects, degrees)) == [1, 2, 3, 4] and ids(timetable.pick(subjects, degrees, "D1", " informatica ")) == [1, 2]
    assert ids(timetable.pick(subjects, degrees, search="PROGRAMACION")) == [1] and ids(timetable.pick(subjects, degrees, search="grupo a d9")) == [4]
    chosen = subjects.where("id < 4")
    got = sorted((r["subject_id_a"], r["start_time_a"], r["subject_id_b"], r["start_time_b"]) for r in timetable.conflicts(chosen, sessions).collect())
    assert got == [(1, "10:00", 2, "11:00"), (1, "11:00", 2, "11:00"), (1, "11:00", 3, "12:00"), (2, "11:00", 3, "12:00")]


def test_an_edit_during_compact_is_kept_or_refused(store, monkeypatch):
    """Writers between the reading and the writing of compact and refresh: what is acknowledged is in the new version."""
    ids = [r["id"] for r in store.records().sort().select("id").collect()]
    other, told = Review(store.spark, store.folder), []

    def meanwhile(f):
        def run(*args, **kw):
            for item in ids[:2]:
                try:
                    told.append((item, other.set_status(item, "INVALID")))
                except io.Conflict:
                    told.append((item, None))
            return f(*args, **kw)

        return run

    store.set_status(ids[2], "INVALID")
    create = io.create_text

    def slow(spark, path, text):  # a writer comes before the closing event
        if '"close"' in text and not told:
            told.append((ids[0], other.set_status(ids[0], "INVALID")))
        return create(spark, path, text)

    monkeypatch.setattr(io, "create_text", slow)
    monkeypatch.setattr(io, "replace_table", meanwhile(io.replace_table))
    assert store.compact() == 2
    kept = {item for item, number in told if number}
    assert kept == {ids[0]} and told[1:] == [(ids[0], None), (ids[1], None)]
    assert all(store.find(i)["status"] == "INVALID" for i in (ids[0], ids[2])) and store.find(ids[1])["status"] != "INVALID"
    told.clear()
    assert store.refresh(records.build(cells(store.spark))) == 3 and {n for _, n in told[1:]} == {None}
    assert other.set_status(ids[1], "INVALID") == 1  # the new log is open


def test_a_compact_that_was_cut_off(store, monkeypatch):
    item = store.records().sort().first()["id"]
    store.set_status(item, "INVALID")
    with monkeypatch.context() as m:
        m.setattr(io, "replace_table", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            store.compact()
    with pytest.raises(io.Conflict):
        store.set_status(item, "VALID")
    assert store.find(item)["status"] == "INVALID" and store.compact() == 2 and store.set_status(item, "VALID") == 1


def test_a_mark_is_whole_or_not_there(spark, tmp_path, monkeypatch):
    """While a mark is being written, it isn't there; two writers of one name don't both get through."""
    from concurrent.futures import ThreadPoolExecutor

    path = f"file://{tmp_path}/marks/v.done"
    seen, done = [], []

    def read():
        fs, Path = io._fs(spark, path)
        while not done:
            if fs.exists(Path(path)):
                seen.append(io.read_text(spark, path))

    def write(i):
        try:
            io.create_text(spark, path, f"{i}" * 20_000)
            return i
        except io.Conflict:
            return None

    with ThreadPoolExecutor(7) as pool:
        reader = pool.submit(read)
        won = [x for x in pool.map(write, range(6)) if x is not None]
        done.append(True)
        reader.result()
    assert len(won) == 1 and io.read_text(spark, path) == f"{won[0]}" * 20_000 and set(seen) <= {f"{won[0]}" * 20_000}
    assert [p.name for p in (tmp_path / "marks").iterdir() if not p.name.startswith(".")] == ["v.done"]
