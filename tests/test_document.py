"""One JSON document by many tasks, read and written."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from cuadrante.operators import records
from cuadrante.sources import document, io

from test_store import cells

def in_blocks(spark, size, monkeypatch):
    """Files are cut into blocks of ``size`` bytes until the elements are stored."""
    before, store = spark.conf.get("spark.sql.files.maxPartitionBytes"), document.settle

    def stored(df):
        out = store(df)
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        return out

    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    monkeypatch.setattr(document, "settle", stored)
    return before


ODD = ['plain', 'a "quoted" one', "back\\slash", "ends in \\", "}{][", '"}', '\\"}', "tab\t, line\n, ñandú 漢字 😀 \u2028", "", "{\"records\": [{\"x\": 1}]}", "\\\\\"", "a,b:c"]


def made(rng, n, m):
    def record(i):
        text = lambda: rng.choice(ODD) + rng.choice(ODD)
        return {
            "degree": {"code": rng.choice([None, "GII"]), "name": text()}, "academic_year": "2025/2026", "semester": 1, "year": rng.choice([None, 2]), "group": text(), "day": "LUNES", "start_time": "09:00", "end_time": "10:00",
            "subject": {"code": None, "name": text()}, "subgroup": None, "classroom": text(), "notes": [text() for _ in range(rng.randint(0, 3))],
            "source": {"file": f"f{i % 3}.pdf", "page": i, "raw_text": text() * rng.randint(1, 30)}, "extraction": {"degree_source": "document", "confidence": 0.5, "issues": rng.sample(["a", "b}"], rng.randint(0, 2))},
        }

    return {
        "schema_version": "2.0", "processed_at": "now }", "statistics": {"pdfs_found": 3, "nested": {"records": [{"x": {"y": "}"}}]}}, "files": [{"file": "f0.pdf", "pages": 1, "records": n, "rejected": m}],
        "records": [record(i) for i in range(n)], "empty": [], "rejected_records": [{"reason": ["no }", text], "record": record(i)} for i, text in zip(range(m), ODD * 9)], "failed_files": ["text }", 3, {"file": "x", "error": "}]"}],
    }


def told(df):
    return sorted((json.dumps(r.asDict(recursive=True), sort_keys=True, default=str) for r in df.collect()))


@pytest.mark.parametrize("indent, separators", [(None, None), (4, None), (None, (",", ":"))])
def test_a_document_read_in_blocks(spark, tmp_path, indent, separators, monkeypatch):
    """Blocks of a few hundred bytes cut characters, strings, escapes and nested brackets; records span several."""
    rng = random.Random(8)
    path = f"file://{tmp_path}/doc.json"
    (tmp_path / "doc.json").write_text(json.dumps(made(rng, 40, 9), ensure_ascii=False, indent=indent, separators=separators))
    want = told(io.result_records(io.read_result(spark, path)))
    for size in ("700", "5000", "100m"):
        with monkeypatch.context() as m:
            before = in_blocks(spark, size, m)
            try:
                assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() > 4 or size == "100m"
                assert told(document.read_records(spark, path)) == want
            finally:
                spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert document.elements(spark, path).groupBy("section").count().orderBy("section").collect() == [("failed_files", 1), ("files", 1), ("records", 40), ("rejected_records", 9)]


def test_documents_without_elements(spark, tmp_path):
    for name, text in (("a", "{}"), ("b", '{"records": [], "x": {"records": [{"a": 1}]}}'), ("c", "[]")):
        (tmp_path / name).write_text(text)
    assert document.elements(spark, f"file://{tmp_path}").count() == 0


def test_legacy_documents(spark, tmp_path, monkeypatch):
    rows = [{"source": {"archivo": f"{i}.pdf", "pagina": i}, "schedule": {"dia": 'LUN"}ES'}, "subject": {"nombre": ODD[i % len(ODD)]}} for i in range(30)]
    (tmp_path / "old.json").write_text(json.dumps({"schema_version": "1", "input_file": {"path": "}"}, "standard_schedule": rows}))
    path = f"file://{tmp_path}/old.json"
    want = told(io.read_legacy(spark, path))
    before = in_blocks(spark, "300", monkeypatch)
    try:
        assert want == told(document.read_legacy(spark, path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_document_written_by_many_tasks(spark, tmp_path):
    rows = records.build(cells(spark).withColumn("cell_text", F.concat("cell_text", F.lit("")))).repartition(3)
    files, failed = records.file_stats(records.page_stats(rows)), spark.createDataFrame([("b.pdf", 'no "text"')], "file string, error string")
    stats = records.global_stats(files, failed)
    path = f"file://{tmp_path}/out/doc.json"
    for n in range(2):  # the second replaces the first
        document.write_document(path, rows, stats, files, failed, f"2026-01-0{n + 1} 00:00:00")
    doc = json.loads((tmp_path / "out" / "doc.json").read_text())
    assert list(doc) == ["schema_version", "processed_at", "statistics", "files", "records", "rejected_records", "failed_files"] and doc["processed_at"] == "2026-01-02 00:00:00"
    assert len(doc["records"]) + len(doc["rejected_records"]) == rows.count() and doc["failed_files"] == [{"file": "b.pdf", "error": 'no "text"'}] and doc["statistics"]["pdfs_failed"] == 1
    assert doc["records"][0]["classroom"] == "NA7" and "subgroup" in doc["records"][-1]
    back = io.result_records(io.read_result(spark, path))
    keep = ["accepted", "file", "page", "raw_text", "name", "classroom", "confidence", "issues"]
    assert told(back.select(*keep)) == told(rows.select(*keep)) == told(document.read_records(spark, path).select(*keep))
    assert [p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")] == ["doc.json"]
    none = rows.limit(0)
    document.write_document(path, none, stats, files.limit(0), failed.limit(0), "now")
    assert json.loads((tmp_path / "out" / "doc.json").read_text())["records"] == []
