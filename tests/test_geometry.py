"""Cells from geometry, folds against loops, interval joins against loops."""

import random

from pyspark.sql import functions as F

from cuadrante.operators import intervals, layout
from cuadrante.sources import schemas

DAYS = ["Lunes", "Martes", "Miércoles", "Jueves", "Viernes"]


def page(spark, days=DAYS, rows=((100, "9:00 / 9:55"), (200, "10:00 / 10:55"))):
    words, blocks = [], []
    for i, d in enumerate(days):
        x = 100.0 + 100 * DAYS.index(d)
        words.append(("f", 1, len(words), d, x - 10, 20.0, x + 10, 30.0))
    for x, y, t in ((190, 101, "Redes"), (215, 102, "(NA7)"), (205, 112, "abajo"), (150, 100, "borde"), (300, 201, "9:00"), (300, 205, "Otra")):
        words.append(("f", 1, len(words), t, x - 5.0, y - 3.0, x + 5.0, y + 3.0))
    for k, (y, t) in enumerate(rows):
        blocks.append(("f", 1, k, t, 0.0, y - 5.0, 50.0, y + 5.0))
    return spark.createDataFrame(words, schemas.WORDS), spark.createDataFrame(blocks, schemas.WORDS), spark.createDataFrame([("f", 1, 600.0, 400.0, "")], schemas.PAGES)


def test_cells(spark):
    cells = layout.build_cells(*page(spark)).orderBy("row_idx", "day_idx").collect()
    assert [(c["row_idx"], c["day"], c["cell_text"]) for c in cells] == [(0, "LUNES", "borde"), (0, "MARTES", "borde Redes (NA7) abajo"), (1, "MIERCOLES", "Otra")]


def test_columns(spark):
    def columns(days):
        words, _, pages = page(spark, days)
        return [(c["day"], c["x0"], c["x1"]) for c in layout.day_columns(layout.day_headers(layout.prepared_words(words)), pages).orderBy("day_idx").collect()]

    assert columns(DAYS)[0] == ("LUNES", 50.0, 150.0) and columns(DAYS)[4] == ("VIERNES", 450.0, 550.0)
    assert columns(DAYS[1:4])[0] == ("LUNES", 150.0, 250.0)  # the first one found counts as Monday
    assert columns(DAYS[:2]) == []


def test_near_rows_and_bounds(spark):
    _, blocks, pages = page(spark, rows=((0, "9:00 / 9:55"), (6, "9:00 / 9:55"), (12, "9:00 / 9:55"), (100, "10:00/10:55 y 11:00/11:55")))
    kept = layout.drop_near_rows(layout.time_rows(blocks))
    assert sorted(r["y"] for r in kept.collect()) == [0.0, 12.0, 100.0, 100.0]
    bounds = layout.row_bounds(kept, pages).orderBy("row_idx").collect()
    assert [(b["y0"], b["y1"]) for b in bounds] == [(0.0, 6.0), (6.0, 56.0), (56.0, 100.0), (100.0, 100.0)]
    single = layout.row_bounds(kept.where("y = 100 and k = 0"), pages).first()
    assert (single["y0"], single["y1"]) == (80.0, 120.0)


def test_lines(spark):
    def loop(words):
        lines = []
        for w in sorted(words):
            if lines and abs(w[0] - sum(x[0] for x in lines[-1]) / len(lines[-1])) <= 4:
                lines[-1].append(w)
            else:
                lines.append([w])
        return " ".join(x[3] for line in lines for x in sorted(line, key=lambda w: w[1:]))

    rng = random.Random(3)
    groups = [[(float(rng.randint(0, 40)), float(rng.randint(0, 9)), i, f"w{i}") for i in range(rng.randint(1, 30))] for _ in range(20)]
    rows = spark.createDataFrame(list(enumerate(groups)), "g int, w array<struct<cy:double,x0:double,ord:bigint,text:string>>")
    got = dict(map(tuple, rows.select("g", layout.lines_of(F.col("w"))).collect()))
    assert got == {i: loop(g) for i, g in enumerate(groups)}


def test_overlaps(spark):
    rows = [(1, "L", 0, 60), (2, "L", 60, 120), (3, "L", 30, 90), (4, "M", 0, 60), (5, "L", 0, 500), (6, "L", 30, 90), (7, "L", 70, 70)]
    df = spark.createDataFrame(rows, "id int, day string, s int, e int")
    got = {(r["id_a"], r["id_b"]) for r in intervals.overlap_pairs(df, ["day"], "s", "e", "id").collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and a[2] < b[3] and b[2] < a[3]}
    assert got == want
    sides = intervals.conflict_rows(intervals.overlap_pairs(df, ["day"], "s", "e", "id"), ["id"], ["day"])
    assert sides.count() == 2 * len(want)


def test_slots_and_nearest(spark):
    df = spark.createDataFrame([(1, 480, 540), (2, 500, 560), (3, 0, 60), (4, 1130, 1300)], "id int, s int, e int")
    got = sorted((r["id"], r["slot"]) for r in intervals.slot_grid(df, "s", "e").collect())
    assert got == [(1, 480), (2, 480), (2, 540), (4, 1080)]
    left = spark.createDataFrame([(1, "p", 15.0), (2, "p", 29.9), (3, "p", 75.0), (4, "q", 0.0)], "id int, page string, cy double")
    right = spark.createDataFrame([("p", 0, 0.0), ("p", 1, 30.0), ("p", 2, 105.0)], "page string, row int, y double")
    got = {r["id"]: r["nearest"] for r in intervals.nearest(left, right, ["page"], "cy", "y", "row", "id").collect()}
    assert got == {1: 0, 2: 1, 3: None, 4: None}
