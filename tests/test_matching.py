"""Links by tokens against Python's own parser, keys in texts against a loop, and what a running stream tells."""

from __future__ import annotations

import random
import threading
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from cuadrante.functions.markup import link_targets
from cuadrante.operators import parsing
from cuadrante.operators.matching import longest_contained
from cuadrante.streaming import ingest, progress


def targets(spark, pages):
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    return [r[0] for r in df.orderBy("i").select(link_targets(F.col("html")), "i").collect()]


class Links(HTMLParser):
    def __init__(self, html):
        super().__init__(convert_charrefs=False)
        self.found = []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        found = [v or "" for k, v in attrs if k == "href"]
        if tag == "a" and found:
            self.found.append(found[-1])

    handle_startendtag = handle_starttag

    def unescape(self, s):
        return s


# A piece of markup each, broken or not, with what Python's parser and the standard agree on.
PIECES = (
    '<a href="%">', "<a href='%'>", "<a href=%>", "<A HREF = \"%\" >", "<a\nclass=x\thref='%'/>", '<a title="> <a href=no>" href="%">', "<a data-href=no href=%>",
    "<a href>", "<a name=x>", "<abbr href=no>", "</a>", "</a href=no>", "<p class='x'>", '<img alt="<a href=\'no\'>">', "<!-- <a href=no> -->", "<!DOCTYPE html>", "<?xml version='1'?>",
    "<script>'<a href=no>'</script>", "<STYLE>a{b:'<a href=no>'}</Style >", '<a href="%" href="%">', "<a checked href='%' x>", "<a href=%/b>", "text", " < ", "&amp;", "a<b", "<br/>", "\n", '<a x="1"href="%">', "<a href='a\n%\t'>",
)


def test_links_as_the_standard_parser_finds_them(spark):
    rng = random.Random(5)
    pages = ["".join(p.replace("%", f"/{rng.randrange(99)}") for p in rng.choices(PIECES, k=rng.randrange(1, 25))) for _ in range(400)]
    pages = [p.replace("a<b", "a < b") for p in pages]  # a tag without an end is a case of its own, below
    assert targets(spark, pages) == [Links(p).found for p in pages]


def test_links_of_the_standard(spark):
    cases = {
        None: [], "": [], "<a href=x": [], "<a href='x>y</a><a href=z>": [], "<!--><a href=x>": ["x"], "<!---><a href=x>": ["x"], "<!-- a --!><a href=x>": ["x"],
        "<!-- <a href=x>": [], "<textarea><a href=no></textarea><a href=x>": ["x"], "<title><a href=no></TITLE><a href=x>": ["x"], "<script><a href=no>": [],
        "<script></scripty><a href=no></script><a href=x>": ["x"], "</ <a href=no><a href=x>": ["x"], "<![CDATA[<a href=no>]]><a href=x>": ["x"], "<a =href=x href=y>": ["y"],
        "<a href==x>": ["=x"], "<a href=>": [""], "<a/href=x>": ["x"], "<plaintext><a href=no>": [], "<b<a href=no><a href=x>": ["x"],
    }
    assert targets(spark, list(cases)) == list(cases.values())


def test_links_of_long_pages(spark):
    many = "<a " + "x='1' " * 60_000 + "href=y>"
    long = "<!--" + "-" * 2_000_000 + "--><script>" + "<" * 1_000_000 + "</script>" + "<a href=x>" * 20_000
    assert targets(spark, [many, long, "<a " * 200_000]) == [["y"], ["x"] * 20_000, []]


@pytest.mark.parametrize("chars", [10**6, 0])
def test_longest_contained(spark, chars):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choices("abñ", k=n))
    keys = [(word(rng.randrange(1, 7)), rng.choice([None, *range(9)])) for _ in range(150)] + [("", 0), (None, 1), ("zz", 5), ("zz", 1), ("yy", 1)]
    texts = [None, "", "q", "zzyy", "yyzz", "b" * 5_000 + "zz", *(word(rng.randrange(0, 30)) for _ in range(200))]
    rank = {}
    for k, r in keys:
        if k:
            rank[k] = min(x for x in (rank.get(k, 99), 99 if r is None else r))

    def want(t):
        return min((k for k in rank if k in t), key=lambda k: (-len(k), rank[k], k), default=None) if t else None

    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts + texts)], "`i` int, `a.b` string, key string")
    got = longest_contained(rows, "a.b", spark.createDataFrame(keys, "key string, rank int"), "found", chars)
    assert {r["i"]: r["found"] for r in got.collect()} == {i: want(t) for i, t in enumerate(texts + texts)} and got.columns == [*rows.columns, "found"]


@pytest.mark.parametrize("chars", [10**6, 0])
def test_no_keys_and_no_rows(spark, chars):
    rows, keys = spark.createDataFrame([("a",)], "t string"), spark.createDataFrame([("a", 1)], "key string, rank int")
    assert longest_contained(rows, "t", keys.limit(0), "k", chars).first()["k"] is None
    assert longest_contained(rows.limit(0), "t", keys, "k", chars).count() == 0
    with pytest.raises(ValueError):
        longest_contained(rows, "t", keys, "t", chars)


def test_many_codes_as_the_chain_finds_them(spark):
    paths = spark.createDataFrame([(f"x/{stem}_{i}.pdf",) for i, stem in enumerate(["gieai", "GISI", "Giec", "gii", "GIT", "mu", "é"] * 3)] + [(None,)], "path string")
    chain = paths.select("path", parsing.degree_from_filename(F.col("path")).alias("d")).select("path", "d.name", "d.code")
    more = [(f"QX{i:05d}", f"N{i}", "none") for i in range(10_000)]
    catalog = spark.createDataFrame([(r, *x) for r, x in enumerate([*parsing.CATALOG, *more])], "rank int, key string, code string, name string")
    got = parsing.degrees_from_filenames(paths, "path", catalog)
    assert sorted(map(tuple, got.select("path", "name", "code").collect()), key=str) == sorted(map(tuple, chain.collect()), key=str)
    one = parsing.degrees_from_filenames(spark.createDataFrame([("a/qx00042_giec.pdf",)], "path string"), "path", catalog).first()
    assert one["code"] == "N42"


def test_counts_while_the_run_goes_on(spark, tmp_path):
    from cuadrante.plans.sched import cells

    source = cells(spark, "/root/testdata/sf0.001").where("ord <= 60").withColumn("file", F.concat(F.lit("f"), (F.col("ord") % 3).cast("string"), F.lit(".pdf")))
    told, came = {}, threading.Event()

    def tell(batch, counts):
        told[batch] = counts
        came.set()

    def add(i):
        source.where(F.col("file") == f"f{i}.pdf").coalesce(1).write.mode("append").json(str(tmp_path / "in"))

    add(0)
    listener = progress.Counts("run", tell)
    spark.streams.addListener(listener)
    stream = ingest.stream_cells(spark, str(tmp_path / "in"), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema), max_files=1)
    query = progress.start(stream, str(tmp_path / "out"), "run", {"processingTime": "0 seconds"})
    try:
        for i in (0, 1, 2):
            assert came.wait(90) and query.isActive  # the run goes on, and its counts are here
            came.clear()
            assert progress.percent(progress.log(spark, str(tmp_path / "out")), 3) == (33, 66, 100)[i]
            if i < 2:
                add(i + 1)
    finally:
        query.stop()
        spark.streams.removeListener(listener)
    rows = spark.read.parquet(str(tmp_path / "out/records"))
    assert sum(c["cells"] for c in told.values()) == source.count() and sum(c["accepted"] for c in told.values()) == rows.where("accepted").count()
    lines = progress.log(spark, str(tmp_path / "out")).collect()
    assert sorted(r["file"] for r in lines) == ["f0.pdf", "f1.pdf", "f2.pdf"]
    clock = [x["t"] for x in progress.log(spark, str(tmp_path / "out")).orderBy("file").select(F.date_format("at", "HH:mm:ss").alias("t")).collect()]
    assert [r["line"].split(" (")[0] for r in sorted(lines, key=lambda r: r["file"])] == [f"[{t}] OK → f{i}.pdf" for i, t in enumerate(clock)]
