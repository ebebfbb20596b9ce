"""Periodic runs, the quality classifier and phrases, against brute force and held-out labels."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuadrante.llm import periodic, phrases, quality_model, registry

from test_corpus import rows_of


# --- op11


def brute_runs(words):
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(12, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_digests(rows, plant=True):
    out = []
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n = len(w)
        if plant and i is not None and n and zlib.crc32(str(i).encode()) % 10 == 0:
            g = zlib.crc32(str(i).encode()) // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = brute_runs(w)
        drop = {k for s, length, q in runs for k in range(s + q, s + length)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        kept = " ".join(x for k, x in enumerate(w) if k not in drop)
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        out.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def fibonacci(n):
    a, b = ["x"], ["x", "y"]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def periodic_texts(seed):
    rng = random.Random(seed)
    texts = [" ".join(fibonacci(400)), "a " * 300, "a b " * 6, "a b " * 5 + "a", "", " \t\n", "one", "a " * 12, "a " * 11]
    for _ in range(60):
        kind, n = rng.random(), rng.randint(1, 300)
        if kind < 0.3:
            w = [rng.choice("ab") for _ in range(n)]
        elif kind < 0.6:
            w = []
            while len(w) < n:
                unit = [str(rng.randint(0, rng.choice([1, 2, 9, 90]))) for _ in range(rng.randint(1, 60))]
                w += (unit * rng.randint(1, 5))[: rng.randint(1, 200)]
        elif kind < 0.8:
            unit = ["o"] * rng.randint(1, 70) + ["i"]
            w = [str(rng.randint(0, 5)) for _ in range(rng.randint(0, 20))] + unit * rng.randint(1, 6)
        else:
            unit = [rng.choice("ab") for _ in range(rng.randint(1, 12))]
            w = (unit * rng.randint(1, 8) + [rng.choice("abc")]) * rng.randint(1, 6)
        texts.append(rng.choice([" ", "\n", "  ", "\x0b"]).join(w))
    return [*enumerate(texts), (1000, None), (None, texts[0]), (None, texts[1]), (3, texts[3]), (3, texts[3]), (3, texts[0])]


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_are_those_of_brute_force(spark, seed):
    rows = periodic_texts(seed)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, `codes` string, `a.b` int").repartition(5)
    planted = docs.withColumn("text", periodic.planted(docs["doc_id"], docs["text"]))
    assert sorted((tuple(r) for r in periodic.digests(periodic.find_runs(planted, digest=True)).collect()), key=repr) == brute_digests(rows)
    assert periodic.find_runs(docs.limit(0)).count() == 0


def test_what_stays_of_runs(spark):
    docs = spark.createDataFrame([(1, "go " + "left right " * 8 + "stop"), (2, "nothing here"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in periodic.find_runs(docs).collect()}
    assert got[1]["kept"] == "go left right stop" and [tuple(x) for x in got[1]["runs"]] == [(1, 16, 2)] and got[1]["n_words"] == 18
    assert got[2]["kept"] == "nothing here" and got[2]["runs"] == [] and got[3]["kept"] == "" and got[3]["n_words"] == 0


def test_a_long_text_is_many_tiles():
    """Tiles of a text of 60,000 words are small, and a long run is stitched from many of them."""
    rng = np.random.default_rng(5)
    unit = rng.integers(0, 50, 3_000)
    codes = np.concatenate([rng.integers(0, 1_000_000, 20_000), np.tile(unit, 12), rng.integers(0, 1_000_000, 4_000)])
    tiles = periodic.find_tiles(codes, np.array([len(codes)]))
    assert len(tiles) >= 4 and tiles[:, 5].max() < 40_000 < len(codes)
    found = []
    for _, number, low, high, at, size in tiles.tolist():
        found += periodic.fragments(codes[at : at + size].tolist(), low, high, at, periodic.octave(number))
    long = sorted((s, e) for p, s, e in found if p == 3_000)
    assert long and long[0][0] == 20_000 and max(e for _, e in long) == 20_000 + 33_000
    assert all(b[0] <= max(e for _, e in long[: i + 1]) for i, b in enumerate(long[1:]))


def test_a_long_text_of_one_word_makes_few_tiles():
    """Only the first octaves are live, so tiles grow with the text and not faster."""
    sizes = [periodic.find_tiles(np.zeros(n, np.int64), np.array([n]))[:, 5].sum() for n in (20_000, 80_000)]
    assert sizes[1] < 4.2 * sizes[0] < 4.2 * 3 * 20_000


# --- op12


def junk(rng, words):
    return " ".join(rng.choice(words) + rng.choice(["&&&", "###", " |"]) for _ in range(40))


def labelled(n=600, seed=4):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("a", "en", "or", "ive", "ium")]
    texts, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.3
        texts.append((i, junk(rng, words) if bad else " ".join(rng.choice(words) for _ in range(50)) + ". The end."))
        labels.append((i, 0 if bad else 1))
    return texts, labels


def test_quality_is_learned(spark):
    texts, labels = labelled()
    extra = [(9001, None), (9002, ""), (9003, "junk&&& " * 50_000), (None, "some words")]
    docs = spark.createDataFrame([(*t, 0, "z") for t in texts + extra], "doc_id long, text string, quality int, `a.b` string").repartition(4)
    told = spark.createDataFrame([*labels, (None, 1), (77777, 0), (9001, None)], "doc_id long, quality int")
    model = quality_model.learn(docs, told)
    got = {r["doc_id"]: r for r in quality_model.score(docs, model).collect()}
    assert len(got) == len(texts) + 4 and all(0 <= r["score"] <= 1 for r in got.values())
    held = [(got[i]["predicted"], y) for i, y in labels if got[i]["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items() if i is not None)
    assert len(held) > 80 and sum(p == y for p, y in held) >= 0.97 * len(held)
    assert got[9003]["predicted"] == 0 and got[9001]["score"] == got[9002]["score"]


def test_held_out_labels_are_not_learned_from(spark):
    texts, labels = labelled(300)
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    one, other = (quality_model.learn(docs, spark.createDataFrame(x, "doc_id long, quality int")) for x in (labels, turned))
    assert np.array_equal(one.weights, other.weights) and (one.bias, one.slope, one.base) == (other.bias, other.slope, other.base)


def test_quality_without_labels_of_both_kinds(spark):
    texts, _ = labelled(20)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for labels in ([], [(i, 1) for i in range(20)]):
        model = quality_model.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        scores = {r["score"] for r in quality_model.score(docs, model).collect()}
        assert len(scores) == 1 and (scores == {0.5} or min(scores) > 0.9)
    assert quality_model.score(docs.limit(0), model).count() == 0


def test_coordinate_descent_finds_the_least_loss():
    """Against many steps of plain subgradient descent on the same loss."""
    rng = np.random.default_rng(0)
    items = [np.sort(rng.choice(30, 6, replace=False)) for _ in range(60)]
    values = [np.full(6, 6**-0.5) for _ in items]
    y = np.where([i[0] % 2 == 0 for i in items], 1.0, -1.0)
    x = np.zeros((60, 31))
    for k, i in enumerate(items):
        x[k, i], x[k, 30] = values[k], 1.0
    loss = lambda w: 0.5 * w @ w + np.maximum(0, 1 - y * (x @ w)).sum()
    w, bias = quality_model.coordinate_descent(items, values, y, cost=1.0, epochs=500)
    mine = loss(np.append(w[:30], bias))
    v, best = np.zeros(31), np.inf
    for t in range(1, 20_000):
        v = v - (v - (y * (y * (x @ v) < 1)) @ x) / (t + 10)
        best = min(best, loss(v))
    assert mine <= best * 1.01


def test_shapes_and_indicators():
    assert [quality_model.shape(w) for w in ("Hallo!!", "the", "DIR", "x1-22", "A", "&&&")] == ["Aa!", "a", "A", "a0-0", "Aa", "&"]
    import pyarrow as pa

    doc, bucket = quality_model.indicators(pa.array(["a b a b", None, "", " ", "a b", "c"]))
    sets = [set(bucket[doc == i].tolist()) for i in range(6)]
    assert sets[1] == sets[2] == sets[3] == set() and sets[4] < sets[0] and len(bucket) == sum(map(len, sets))


# --- op13


def brute_collocations(rows, least, top):
    counts, totals = {}, Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, 5):
                counts.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows_ = []
        for p, a in candidates.items():
            inside = any(100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in candidates.items() if len(q) > len(p))
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            if not inside:
                rows_.append((-score, -a, " ".join(p).encode(), p, f[p[:k]], f[p[k:]]))
        for rank, (score, a, _, p, left, right) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, rank, " ".join(p), -a, left, right, totals[lang], -score))
    return sorted(out)


def phrase_rows(seed=6):
    rng = random.Random(seed)
    words = ["new", "york", "city", "the", "Of", "ñandú", "été", "a|b", "x", "y"] + [f"w{i}" for i in range(30)]
    rows = []
    for i in range(150):
        w = []
        for _ in range(rng.randint(0, 60)):
            w += rng.choice([["New", "York"], ["new", "york", "City"], ["the", "end", "of", "it"], [rng.choice(words)], [rng.choice(words)], [rng.choice(words)]])
            w[-1:] = [w[-1] + rng.choice(["", "", "", ".", ",\t", " ; ", "\n", " "])] if w else []
        rows.append((i, " ".join(w), rng.choice(["en", "de", None, "und"])))
    return [*rows, (200, None, "en"), (201, "", "en"), (202, " .,. ", None), (1, rows[1][1], rows[1][2]), (1, rows[1][1], rows[1][2]), (None, rows[2][1], "de")]


@pytest.mark.parametrize("sample, least, top", [(1, 5, 2000), (3, 4, 2000), (2**40, 3, 7)])
def test_phrases_are_those_of_brute_force(spark, sample, least, top):
    """With a full sample, a small one, and one that proposes nothing, so that every length takes a pass of its own."""
    rows = phrase_rows()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, phrase int").repartition(4)
    got = phrases.collocations(docs, least=least, top=top, sample=sample)
    want = brute_collocations(rows, least, top)
    assert len(want) > 20 and sorted(tuple(r) for r in got.collect()) == want


@pytest.mark.parametrize("sample", [3, 2**40])
def test_two_passes_are_enough(spark, sample, monkeypatch):
    """Whatever the sample leaves out, one more pass counts all lengths."""
    passes = []
    monkeypatch.setattr(phrases, "_count", lambda shared, f=phrases._count: passes.append(1) or f(shared))
    rows = phrase_rows(8)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    assert sorted(tuple(r) for r in phrases.collocations(docs, least=4, sample=sample).collect()) == brute_collocations(rows, 4, 2000)
    assert len(passes) == 2


def test_phrases_of_long_texts_and_none(spark, monkeypatch):
    """Texts above a slice are cut between pieces only."""
    import pyarrow as pa

    monkeypatch.setattr(phrases, "SLICE_BYTES", 400)
    text = " ".join(f"big cat no {i}{'.' if i % 9 == 0 else ''}" for i in range(600))
    parts = list(phrases._pieces(iter([pa.record_batch([pa.array(["en", None]), pa.array([text, None])], names=["lang", "text"])])))
    assert len(parts) > 10 and "".join(p.column(1)[0].as_py() or "" for p in parts) == text and all((p.column(1)[0].as_py() or ".").rstrip()[-1] == "." or p is parts[-2] for p in parts)
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert phrases.collocations(empty).count() == 0 and phrases.collocations(spark.createDataFrame([(1, "a b", "en")], empty.schema)).count() == 0


def test_the_queries_have_their_columns(spark):
    sf = "/root/testdata/sf0.001"
    assert registry.op11_periodic_runs(spark, sf).columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    scored = registry.op12_quality_classifier(spark, sf)
    assert scored.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")] and scored.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert {k for _, k in registry.op13_phrases(spark, sf).dtypes} == {"string", "bigint"}
