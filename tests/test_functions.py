"""Text and URL functions against Python's own, on cases where simpler rules fail."""

from __future__ import annotations

import random
import re
import unicodedata
from html import unescape
from urllib.parse import unquote, urljoin, urlparse

from pyspark.sql import functions as F

from cuadrante.functions import text as T
from cuadrante.functions import urls as U


def one_by_one(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v")).alias("x"), "i").collect()]


def test_folding_of_every_letter(spark):
    # Marks outside the first block are left out: Java's and Python's tables are of different years.
    every = [chr(c) for c in range(0x20, 0x30000) if not 0xD800 <= c <= 0xDFFF]
    letters = [c for c in every if unicodedata.category(c) not in ("Cn", "Co") and (unicodedata.category(c)[0] != "M" or "\u0300" <= c <= "\u036f")]
    values = [None, "", "Ά й 한국 é", *("a" + "".join(letters[i : i + 500]) for i in range(0, len(letters), 500))]
    want = ["".join(p for p in unicodedata.normalize("NFD", v or "") if unicodedata.category(p) != "Mn") for v in values]
    assert one_by_one(spark, values, T.fold) == want


def test_next_hour(spark):
    assert one_by_one(spark, ["08:30", "8:05", "23:00", "99:07", "x", None, "8"], T.next_hour) == ["09:30", "09:05", "24:00", "100:07", None, None, None]


def test_stamp(spark):
    assert spark.sql("select timestamp '2026-01-02 03:04:05' t").select(T.stamp(F.col("t"))).first()[0] == "2026-01-02 03:04:05"


def test_skipped(spark):
    urls = [f"http://a.es/x.{e}" for e in "jpg jpeg png gif svg webp css js zip rar 7z doc docx xls xlsx ppt pptx".split()]
    follow = ["http://a.es/x.ico", "http://a.es/x.mp4", "http://a.es/x.mp3", "http://a.es/x", "http://a.es/x.jpg?q=1"]
    assert one_by_one(spark, urls + follow, lambda c: U.is_skipped(c, F.lit("a.es"))) == [True] * 17 + [False] * 5


def test_safe_filename(spark):
    def want(url):
        p = urlparse(url)
        name = p.path.rsplit("/", 1)[-1]
        if not name.lower().endswith(".pdf"):
            name = re.sub(r"[^a-zA-Z0-9._-]", "_", p.netloc + p.path).strip("_") + ".pdf"
        name = re.sub(r"[^\w.\-]", "_", unquote(name))
        return name if name.lower().endswith(".pdf") else name + ".pdf"

    urls = ["http://h.es/a/b.html", "http://h.es/a/B.PDF", "http://h.es/", "http://h.es", "http://h.es/a+b%20c%C3%A9.pdf", "http://h.es/100%.pdf", "http://h.es/x%zz%41.pdf", "https://u@h.es:8/q/ñ.pdf?x=1", "http://h.es/dir/", "http://h.es/a.pdf%00"]
    assert one_by_one(spark, urls, U.safe_filename) == [want(u) for u in urls]


def test_unique_filenames(spark):
    rng = random.Random(2)
    fixed = ["f.pdf", "f.pdf", "f_1.pdf", "f.pdf", "f_1.pdf", "f_1_1.pdf", "g", "g", "g_1", ".pdf", ".pdf", None, None, "a.b.pdf", "a.b.pdf", "a.c.pdf"]
    names = fixed + [rng.choice(["x.pdf", "x_1.pdf", "x_2.pdf", "x_1_1.pdf", "y.PDF", "x"]) for _ in range(120)]
    df = spark.createDataFrame([(i, n, "k") for i, n in enumerate(names)], "i int, name string, _family string").repartition(3)
    got = {r["i"]: r["name"] for r in U.unique_filenames(df, "name", "i").collect()}
    taken, want = set(), []
    for n in names:
        if n is not None:
            dot = n.rfind(".")
            stem, end = (n[:dot], n[dot:]) if dot > 0 else (n, "")
            free, k = n, 0
            while free in taken:
                k += 1
                free = f"{stem}_{k}{end}"
            taken.add(free)
            n = free
        want.append(n)
    assert [got[i] for i in range(len(names))] == want


def test_resolve_like_the_standard(spark):
    bases = ["http://h.es/a/b/c.html?q#f", "https://h.es", "http://h.es/a/"]
    links = ["x.pdf", "./x", "../x", "../../../../../../x", "a/./b/../c", "..", ".", "x/..", "/r/../s/./t", "/../x", "//o.es/p", "#f", "?q=1", "http://z.es/a/../b", "mailto:x", "a//b/../c", "d/", "../../", "a?b=../c", "/a/b/."]
    df = spark.createDataFrame([(b, h) for b in bases for h in links], "b string, h string")
    for r in df.select("b", "h", U.resolve(F.col("b"), F.col("h")).alias("x")).collect():
        assert U_plain(r["x"]) == U_plain(urljoin(r["b"], r["h"])), (r["b"], r["h"], r["x"], urljoin(r["b"], r["h"]))


def U_plain(url):
    """An empty path and the root are the same once normalised; so is a fragment and none."""
    p = urlparse(url)
    return p._replace(path=p.path or "/", fragment="").geturl() if p.scheme in ("http", "https") else url


def test_links(spark):
    html = """<a href="a.pdf">1</a><A class='x' HREF='b.pdf?x=1&amp;y=2'>2</a><a data-href="no" href=c.pdf>3</a><!-- <a href="hidden.pdf"> -->
    <script>var x = '<a href="script.pdf">';</script><a title="a > href='q'" href = "d&#101;.pdf">4</a><abbr href="no.pdf"><a name=x><a href=""><link href="no.css"><a
    href='&#x65;&ntilde;&unknown;.pdf'><a disabled href=e.pdf/>"""
    got = one_by_one(spark, [html, None, ""], U.hrefs)
    assert got == [["a.pdf", "b.pdf?x=1&y=2", "c.pdf", "de.pdf", "", "eñ&unknown;.pdf", "e.pdf/"], [], []]
    texts = ["&amp;lt; &copy;&#38;#38; &#1114112; &#xD800; &; & &#0;", "&eacute;&Eacute;x", "no", "&#x1F600;!"]
    want = [unescape("&amp;lt; &copy;&#38;#38; ") + "&#1114112; &#xD800; &; & &#0;", unescape(texts[1]), "no", unescape(texts[3])]
    assert one_by_one(spark, texts, U.unescape) == want


def test_clean_like_the_standard(spark):
    rng = random.Random(3)
    spaces = [chr(c) for c in range(0x10000) if chr(c).isspace()] + [" "] * 6 + ["–", "—", "a", "bc", "é", "\x01", "​"]
    values = ["".join(rng.choice(spaces) for _ in range(rng.randint(0, 14))) for _ in range(600)] + [None]
    want = [re.sub(r"\s+", " ", (v or "").replace("\xa0", " ").replace("–", "-").replace("—", "-")).strip() for v in values]
    assert one_by_one(spark, values, T.clean) == want
