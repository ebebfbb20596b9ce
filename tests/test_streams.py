"""The crawl over tables and the edits as a stream."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from cuadrante.functions import urls as U
from cuadrante.operators import crawl, records, review
from cuadrante.review_store import LOG, Review
from cuadrante.sources import io
from cuadrante.streaming import edits
from test_store import cells, payload

PAGE = "page_id int, url string, html string, host string, page string, depth int"


def web(spark, seed, hosts=4, size=12):
    """Pages of random links, most of them to the first host, and the links of each by hand."""
    r = random.Random(seed)
    pick = lambda: 0 if r.random() < 0.5 else r.randrange(hosts)
    name = lambda h, i: f"http://h{h}.es/{i}" + (".pdf" if i % 7 == 6 else "")
    links = {}
    for _ in range(hosts * size):
        links.setdefault(name(pick(), r.randrange(size)), []).extend(name(pick(), r.randrange(size + 3)) for _ in range(r.randrange(4)))
    rows = [(k, u, " ".join(f'<a href="{x}">x</a>' for x in to), "x", None, 9) for k, (u, to) in enumerate(links.items())]
    return spark.createDataFrame(rows, PAGE), links


def by_hand(links, starts, max_depth, max_pages):
    host = lambda u: u.split("/")[2]
    visited, due = {}, set(starts)
    for depth in range(max_depth + 1):
        turns, seen = [], {}
        for u in sorted(due - visited.keys()):
            seen[host(u)] = seen.get(host(u), 0) + 1
            turns.append((seen[host(u)], u))
        room = len(turns) if max_pages is None else max_pages - len(visited)
        level = [u for _, u in sorted(turns)[:room]]
        visited |= {u: depth for u in level}
        due = {x for u in level for x in links.get(u, []) if host(x) == host(u) and not x.endswith(".pdf")}
    found = {}
    for u, depth in visited.items():
        for x in [x for x in links.get(u, []) if host(x) == host(u)] + [u]:
            if x.endswith(".pdf"):
                found[x] = min(depth, found.get(x, depth))
    return visited, found


@pytest.mark.parametrize("seed,max_depth,max_pages", [(1, 5, None), (2, 3, 11), (3, 2, 3), (4, 0, 50), (5, 4, 0)])
def test_crawl_of_many_starts(spark, seed, max_depth, max_pages):
    pages, links = web(spark, seed)
    starts = ["http://h0.es/0", "http://h1.es/1", "http://h2.es/6.pdf", "http://gone.es/"]
    given = spark.createDataFrame([(u,) for u in [*starts, starts[0] + "#x", None, "mailto:x", " "]], "url string")
    visited, found = crawl.crawl_table(pages, given, max_depth, max_pages)
    want = by_hand(links, starts, max_depth, max_pages)
    assert ({r["url"]: r["depth"] for r in visited.collect()}, {r["url"]: r["on_depth"] for r in found.collect()}) == want and visited.count() == len(want[0])


def test_crawl_of_one_start_is_the_crawl(spark):
    pages, _ = web(spark, 9, hosts=2, size=20)
    rows = lambda pair: [sorted(map(tuple, df.collect())) for df in pair]
    for limits in ((2, 50), (3, 4)):
        start = spark.createDataFrame([("http://h0.es/0",)], "url string")
        assert rows(crawl.crawl_table(pages, start, *limits)) == rows(crawl.crawl(pages, "http://h0.es/0", *limits, follow=True))
    none = pages.limit(0)
    assert rows(crawl.crawl_table(none, none)) == [[], []] and rows(crawl.crawl_table(pages, none)) == [[], []]
    with pytest.raises(ValueError):
        crawl.crawl_table(pages, none, max_pages=-1)


def test_crawl_of_many_pages(spark):
    """A page that links to 20,000 others, half of which fit; all of one host, so its turns span ranges."""
    html = "".join(f'<a href="/p{i}">x</a>' for i in range(20_000))
    pages = spark.createDataFrame([(1, "http://h.es/", html)], "page_id int, url string, html string")
    visited, _ = crawl.crawl_table(pages, pages.select("url"), 1, 10_001)
    want = sorted(f"http://h.es/p{i}" for i in range(20_000))[:10_000]
    assert [r["url"] for r in visited.where("depth = 1").orderBy("url").collect()] == want


def test_places_in_ranges(spark):
    rows = spark.range(5000).select((F.col("id") % 3 == 0).alias("k"), F.hex(F.xxhash64("id")).alias("v"))
    got = crawl.numbered(rows, "n", ["v"], ["k"]).collect()
    for k in (True, False):
        own = sorted((r["v"], r["n"]) for r in got if r["k"] == k)
        assert [n for _, n in own] == list(range(1, len(own) + 1))


def events(ids, seed, n):
    r = random.Random(seed)
    for seq in range(1, n + 1):
        kind = r.choice(["edit", "edit", "status", "restore", "status"])
        yield {"seq": seq, "id": r.choice([*ids, "nobody", None]), "kind": kind, "new_status": r.choice(["VALID", "INVALID", "odd"]) if kind == "status" else None,
               "classroom": r.choice(["NA1", "ZZ9", None]), "name": r.choice(["A", "B"]), "notes": [str(seq)]}


@pytest.mark.parametrize("seed", [1])
def test_edits_in_any_order_and_after_a_restart(spark, tmp_path, seed):
    items = review.items(records.build(cells(spark)))
    log = list(events([r["id"] for r in items.select("id").collect()], seed, 40))
    mixed = log[:]
    random.Random(seed).shuffle(mixed)
    mixed += mixed[:7]  # some come twice
    folder, done = tmp_path / "log", []
    folder.mkdir()
    for part in range(3):  # the stream ends and begins anew
        for k, event in enumerate(mixed[part::3]):
            (folder / f"{part}-{k:03d}.json").write_text(json.dumps(event))
        stream = edits.start_folding(edits.stream_log(spark, f"file://{folder}", LOG, 8), f"file://{tmp_path}/states", f"file://{tmp_path}/check", done.append)
        stream.awaitTermination(300)
        assert stream.exception() is None
        known = spark.createDataFrame([{k: e.get(k) for k in e} for e in mixed if e in [x for p in range(part + 1) for x in mixed[p::3]]], LOG)
        rows = lambda df: sorted(map(repr, review.documents(df).collect()))
        assert rows(edits.edited(items, f"file://{tmp_path}/states")) == rows(review.replay(items, known.dropDuplicates(["seq"])))
    assert len(done) == len(set(done)) > 3
    assert spark.read.parquet(f"file://{tmp_path}/states").groupBy("id", "batch").count().where("count > 1").count() == 0


def test_a_review_is_followed(spark, tmp_path):
    store = Review(spark, f"file://{tmp_path}/review")
    store.ensure(records.build(cells(spark)))
    ids = [r["id"] for r in store.records().sort().select("id").collect()]
    at = (f"file://{tmp_path}/states", f"file://{tmp_path}/check")
    version = io.read_table(spark, store._items(), version=1)
    rows = lambda df: sorted(map(repr, review.documents(df).collect()))
    for step in (lambda: store.edit(ids[0], payload(store.find(ids[0]), classroom="ZZ9")), lambda: store.restore(ids[0]), lambda: store.set_status(ids[1], "INVALID")):
        step()
        store.follow(*at).awaitTermination(120)
        assert rows(edits.edited(version, at[0])) == rows(store.items())
