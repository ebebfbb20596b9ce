"""The rules' cases: normalisation, parsing, validation, and whole cells."""

import pytest
from pyspark.sql import functions as F

from cuadrante.functions import text as T
from cuadrante.operators import legacy, parsing, quality, records


def value(spark, f, *args):
    """One function of literal arguments."""
    return spark.range(1).select(f(*[F.lit(a).cast("string") for a in args]).alias("v")).first()["v"]


def test_normalisers(spark):
    cases = [
        (T.academic_year, "2025/2026", "2025/2026"), (T.academic_year, "2025/26", "2025/2026"), (T.academic_year, "1999/00", "1999/1900"), (T.academic_year, None, None), (T.academic_year, "x", "x"),
        (T.hour, "9:05", "09:05"), (T.hour, "10:00", "10:00"), (T.hour, "9h", "9h"), (T.hour, "", None),
        (T.group, "1º a", "1A"), (T.classroom, "oa 4", "OA4"), (T.subject, " - señales *", "SEÑALES"), (T.clean, " a –\t b ", "a - b"), (T.clean, None, ""), (T.comparable, "Miércoles", "MIERCOLES"),
        (T.next_hour, "09:00", "10:00"), (T.escape_html, "a<b&c", "a&lt;b&amp;c"),
    ]
    row = spark.range(1).select(*[f(F.lit(x).cast("string")).alias(f"c{i}") for i, (f, x, _) in enumerate(cases)]).first()
    assert list(row) == [c[2] for c in cases]


def test_year_issue(spark):
    cases = {"2025/2026": None, "2025/2020": "invalid_academic_year", "2025-2026": "invalid_academic_year", None: "missing_academic_year"}
    assert {k: value(spark, quality.year_issue, k) for k in cases} == cases


def test_classroom(spark):
    cases = {"NA7": ("NA7", None), "SA5B/OL8": ("SA5B/OL8", None), "SA5A-SL11": ("SA5A-SL11", None), "16:30": (None, "invalid_classroom"), "19:00-19:30": (None, "invalid_classroom"), "*": (None, "suspicious_classroom"), "--": (None, "suspicious_classroom"), "PEND. ASIG.": (None, "suspicious_classroom"), None: (None, "missing_classroom"), " ": (None, "missing_classroom"), "LAB": ("LAB", "unknown_classroom"), "GTIC": ("GTIC", "unknown_classroom")}
    rows = spark.createDataFrame([(k,) for k in cases], "r string").select("r", quality.kept_room(F.col("r")), quality.room_issue(F.col("r"))).collect()
    assert {r[0]: (r[1], r[2]) for r in rows} == cases


def test_subgroup(spark):
    assert [value(spark, quality.subgroup_issue, *x) for x in (("1A", "1A1"), ("2B", "2B2"), ("4B", "4A1"), (None, "1A"), ("1A", None))] == [None, None, "incompatible_subgroup", None, None]


def test_subject_name_issue(spark):
    good = dict.fromkeys(("PROGRAMACIÓN", "SISTEMAS OPERATIVOS AVANZADOS", "TEORÍA ECONÓMICA II"))
    bad = dict.fromkeys(("2A (*) 2A2", "1A", "16:30", "*", "2A1 Y 2A2", "I-2"), "invalid_subject_name")
    cases = good | bad | {None: "missing_subject", "DE CALIDAD": "fragmented_subject"}
    rows = spark.createDataFrame([(k,) for k in cases], "r string").select("r", quality.name_issue(F.col("r"))).collect()
    assert dict(map(tuple, rows)) == cases


def test_times(spark):
    assert [value(spark, quality.valid_times, *x) for x in (("10:00", "10:55"), ("18:00", "17:55"), (None, "10:00"), ("10:00", None), ("a", "b"))] == [True, False, False, False, False]


def parse(spark, *texts):
    cells = spark.createDataFrame(list(enumerate(texts)), "ord long, cell_text string")
    return [tuple(r) for r in parsing.subjects(cells).orderBy("ord", "pos").select("ord", "name", "subgroup", "room", "notes").collect()]


def test_parse(spark):
    found = parse(
        spark, "Seguridad En Sistemas Distribuidos - 4A1 (SA1)", "PROGRAMACIÓN - 1A → 1A(GII) (NA7)", "GD. 202012-SISTEMAS ELÉCTRICOS DE POTENCIA (EA6)", "- 2A (*) 2A2 (*)",
        "Computación Ubicua (E.F.) - 3A", "3A1 (EL5) Sistemas Operativos", "sin formato", "Uno - 1A (NA1) Dos - 1B (NA2)", None, "sin formato 1A -> 1B (GII)",
    )
    assert found == [
        (0, "Seguridad En Sistemas Distribuidos", "4A1", "SA1", []), (1, "PROGRAMACIÓN", None, "NA7", ["1A → 1A(GII)"]), (2, "SISTEMAS ELÉCTRICOS DE POTENCIA", None, "EA6", []), (3, "2A (*) 2A2", None, "*", []),
        (4, "Computación Ubicua", "3A", "E.F.", []), (5, "Sistemas Operativos", "3A1", "EL5", []), (6, None, None, None, []), (7, "Uno", "1A", "NA1", []), (7, "Dos", "1B", "NA2", []), (8, None, None, None, []), (9, None, None, None, []),
    ]


@pytest.mark.parametrize("text, accepted, issues, confidence", [
    ("Informática - 1A3 (NL5)", True, [], 1.0), ("Programación Avanzada - 1A1 (LAB)", True, ["unknown_classroom"], 0.85), ("- 2A (*) 2A2 (*)", False, ["invalid_subject_name", "suspicious_classroom"], 0.45),
    ("Economía De La Empresa - 1A (19:00-19:30)", False, ["invalid_classroom"], 0.6), ("algo totalmente irreconocible sin formato", False, ["missing_subject", "missing_classroom"], 0.45), ("De Calidad (NA7)", False, ["fragmented_subject"], 0.4),
])
def test_cells(spark, text, accepted, issues, confidence):
    cell = spark.createDataFrame(
        [(1, "f.pdf", 1, "G60", "GIEAI", "2025/2026", 1, 1, "1A", "Lunes", "9:00", "9:55", text)],
        "ord long, file string, page int, degree_code string, degree_name string, academic_year_raw string, semester int, year int, grp string, day string, start_time string, end_time string, cell_text string",
    )
    r = records.build(cell).first()
    assert (r["accepted"], r["issues"], r["confidence"], r["day"], r["start_time"]) == (accepted, issues, confidence, "LUNES", "09:00")


def test_metadata(spark):
    m = value(spark, parsing.metadata, "GRADO EN Ingeniería X (G60) 1º CUATRIMESTRE 2º y Curso 3º Curso 2025/26 GRUPO 1º A", "a/gii_1.pdf")
    assert tuple(m) == ("INGENIERÍA X", "G60", "document", "2025/2026", 2, 3, "1A")
    m = value(spark, parsing.metadata, "nada", "a/horario_gieai.pdf")
    assert (m["degree_code"], m["degree_source"]) == ("G60", "filename")


def test_legacy(spark):
    assert tuple(value(spark, legacy.parse_subject, "202012 - Redes - 1A1* (NA7)")) == ("202012", "REDES", "1A1", "NA7", "202012 - Redes - 1A1* (NA7)")
    assert tuple(value(spark, legacy.parse_subject, "Redes (NA7)")) == (None, "REDES", None, "NA7", "Redes (NA7)")
    assert value(spark, legacy.parse_subject, "nada") is None
    assert [value(spark, legacy.is_noise, x) for x in ("Aulas libres", "martes", "9:00 / 9:55", "Redes")] == [True, True, True, False]


def test_cells_with_the_marks_of_taking_apart(spark):
    plain = ["Uno - 1A (NA1) Dos - 1B* (NA2)", "Uno (NA1) - 1A y Dos (NA2)- 1B", "x - y", "Uno - 1A (NA1", "(NA1) - 1A", "Uno-1A(NA1)Dos-1b(NA2)"]
    odd = [t.replace("Uno", "U\x01no").replace("x", "x\x02") for t in plain]
    undo = lambda x: x and x.replace("\x01", "").replace("\x02", "")
    got = parse(spark, *plain)
    assert [(o, undo(n), *rest) for o, n, *rest in parse(spark, *odd)] == [tuple(r) for r in got]
    assert [r[1:4] for r in got if r[0] == 1] == [("Uno", "1A", "NA1"), ("y Dos", "1B", "NA2")]
