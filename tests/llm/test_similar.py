"""The pipeline's near-duplicate stage against brute force on edited copies."""

from __future__ import annotations

import random
import re

import pytest

from cuadrante.llm import similar, simhash


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_kept(docs):
    sets = [shingles(t) for _, t in docs]
    up = list(range(len(docs)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            o = len(a & sets[j])
            if a == sets[j] or 5 * o >= 4 * (len(a) + len(sets[j]) - o):
                up[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        low.setdefault(root(i), []).append(d)
    return sorted((min((d for d in ids if d is not None), default=None) for ids in low.values()), key=lambda d: (d is None, d))


def edited_copies():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    line = " ".join(f"c{i}" for i in range(25))
    docs = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(6, 300))]
        docs.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):  # from a word to every fifteenth
            copy = base[:]
            for _ in range(rng.randint(1, max(1, len(base) // 15))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            docs.append(" ".join(copy) + rng.choice(["", " and more", "\n"]))
    docs += [line + " " + " ".join(rng.choice(words) for _ in range(rng.randint(5, 60))) for _ in range(60)]
    docs += [None, "", " \n", "x", "X", "two words", "a b c d e", "a b c d e f"]
    rng.shuffle(docs)
    return [*((i, t) for i, t in enumerate(docs)), (None, docs[3]), (None, "only null " * 9), (None, "only null " * 9), (5, docs[5]), (5, docs[5])]


@pytest.mark.parametrize("hot", [20, 2, 10**9])
def test_near_copies(spark, hot, monkeypatch):
    monkeypatch.setattr(similar, "HOT", hot)
    monkeypatch.setattr(similar, "SAMPLE", 2)
    rows = edited_copies()
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, key int").repartition(5)
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] for r in got.collect()), key=lambda d: (d is None, d)) == brute_kept(rows)
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_the_stage_takes_near_copies(spark):
    """About 0.83 similar: fingerprints this far apart were not linked at 3 of 64 bits."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(3)
    rows = []
    for i in range(20):
        base = [f"v{rng.randrange(5000)}" for _ in range(120)]
        copy = base[:]
        for at in (20, 60):
            copy[at] = "other"
        rows += [(i, " ".join(base)), (100 + i, " ".join(copy))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in pipeline.near_duplicates(spark, docs, "").collect()) == list(range(20))


def test_shingle_hashes_are_of_words():
    import numpy as np
    import pyarrow as pa

    texts = ["A b c d e f", "a  b\tc\nd e f ", "a b c", "", None, " \n", "é b c d e é b c d e", "a b c d e"]
    hashes, counts = similar.shingled(pa.array(texts), 5)
    assert counts.tolist() == [2, 2, 1, 0, 0, 0, 6, 1]
    each = np.split(hashes, np.cumsum(counts)[:-1])
    assert (each[0] == each[1]).all() and each[0][0] == each[7][0] and each[6][0] == each[6][5] and len({int(h) for h in hashes}) == 2 + 1 + 5


def test_parts_of_a_batch_keep_their_texts():
    import pyarrow as pa

    from cuadrante.llm.common import slices

    texts = [None if i % 7 == 0 else "é" * (i % 11) + " x" * i + "ñ" for i in range(200)]
    for kind in (pa.string(), pa.large_string()):
        batch = pa.record_batch([pa.array(range(200)), pa.array(texts, kind)], names=["i", "t"])
        parts = list(slices(batch, 1, 300))
        assert len(parts) > 20 and [t for p in parts for t in p.column(1).to_pylist()] == texts and [i for p in parts for i in p.column(0).to_pylist()] == list(range(200))
        whole = similar.shingled(batch.column(1), 5)
        each = [similar.shingled(p.column(1), 5) for p in parts]
        assert [h for e in each for h in e[0].tolist()] == whole[0].tolist() and [c for e in each for c in e[1].tolist()] == whole[1].tolist()


def test_a_boilerplate_gives_no_pairs(spark):
    """Documents with 85 of 100 shingles in common, which isn't enough: no pair of them is given out, and none goes."""
    shared = " ".join(f"s{i}" for i in range(89))
    rows = [(i, shared + " " + " ".join(f"u{i}x{k}" for k in range(15))) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    hot = similar.hot_shingles(docs, "text")
    profiled = simhash.profiles(docs, "doc_id", "text", 5, hot.column("h").to_numpy())
    members = similar.meet_at_first(profiled, hot)
    none = spark.createDataFrame([], "node long, root long")
    assert members.count() >= 3000 and similar.apart(members, none, profiled.select("key", "sign")).count() <= 10 * 3000
    assert simhash.one_of_each(docs).count() == 3000


def test_a_group_that_is_not_alike_enough_makes_few_rows(spark, monkeypatch):
    """Every two documents have 823 of 1,000 shingles in common, at random places: 0.70. Signatures of first shingles
    can't tell; the bits of the whole sets must, before a row is made for a pair."""
    monkeypatch.setattr(similar, "HOT", 10**9)
    shared = " ".join(f"s{i}" for i in range(827))
    rows = [(i, shared + " " + " ".join(f"u{i}x{k}" for k in range(177))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    made = []
    monkeypatch.setattr(similar, "one_a_root", lambda found, f=similar.one_a_root: made.append(found.count()) or f(found))
    assert simhash.one_of_each(docs).count() == 120 and made[0] <= 120


@pytest.mark.parametrize("block", [4000, 7])
def test_pairs_by_bits_are_those_of_one_pair_at_a_time(spark, block, monkeypatch):
    """Sets of several sizes in common cells, in one square and in many."""
    monkeypatch.setattr(similar, "BLOCK", block)
    rng = random.Random(4)
    base = [f"b{i}" for i in range(150)]
    rows = [(i, " ".join(w if rng.random() > 0.03 else f"x{i}y{k}" for k, w in enumerate(base[: rng.randint(110, 150)]))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    hot = similar.hot_shingles(docs, "text")
    sets = simhash.profiles(docs, "doc_id", "text", 5, hot.column("h").to_numpy()).cache()
    members = similar.meet_at_first(sets, hot)
    none = spark.createDataFrame([], "node long, root long")
    signs, n, bits = sets.select("key", "sign"), {r["key"]: r["n"] for r in sets.collect()}, {r["key"]: bytes(r["bits"]) for r in sets.collect()}
    wide = {(r["a"], r["b"]) for r in similar.apart(members, none, signs).collect()}
    left = {(a, b) for a, b in wide if similar.enough(similar.shared_at_most(bits[a], bits[b], n[a], n[b]), n[a] + n[b])}
    got = {(r["a"], r["b"]) for r in similar.apart(members, none, signs, sets.select("key", "bits")).collect()}
    assert got == left and 0 < len(left) < len(wide)


def test_paragraphs_from_a_pool(spark):
    """Three of a pool of paragraphs each: many common shingles, few similar texts."""
    rng = random.Random(2)
    pool = [" ".join(f"p{k}w{i}" for i in range(40)) for k in range(12)]
    rows = [(i, " ".join(rng.sample(pool, 3)) + (f" tail{i}" if i % 2 else "")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect()) == brute_kept(rows)


def test_hot_cells_are_dealt_out(spark, monkeypatch):
    """A group of near copies whose cells are cut into parts with a star each, and into squares."""
    monkeypatch.setattr(similar, "SALT_ROWS", 20)
    monkeypatch.setattr(similar, "BLOCK", 16)
    monkeypatch.setattr(similar, "SAMPLE", 2)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(300):
        copy = base[:]
        copy[rng.randrange(60)] = f"other{i}"
        rows.append((i, " ".join(copy if i % 3 else copy[:30] + [f"z{i}_{k}" for k in range(30)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    hot = similar.hot_shingles(docs, "text")
    assert (-(-hot.column("n").to_numpy() * 2 // 20)).max() > 3
    assert sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect()) == brute_kept(rows)


def test_any_column_names_pass_the_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    text = "\n".join(f"This is line number {i}, which has quite a few words and ends well." for i in range(12))
    rows = [(i, text.replace("line", f"w{i}"), "en", "s", 1, "x", 2) for i in range(4)] + [(9, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, `q``r.s` int")
    for _, stage in pipeline.STAGES[:-1]:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, "/root/testdata/sf0.001")
            assert out.columns == docs.columns and out.count() <= table.count()
    assert pipeline.STAGES[-1][1](spark, docs, "").count() == 5 and pipeline.STAGES[-1][1](spark, docs.limit(0), "").count() == 0


def test_bits_bound_what_sets_share():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(200):
        n, m = rng.integers(0, 400, 2)
        pool = rng.integers(0, 2**63, 800).astype(np.uint64)
        a, b = np.unique(rng.choice(pool, n)), np.unique(rng.choice(pool, m))
        shared = len(np.intersect1d(a, b))
        got = similar.shared_at_most(similar.bits_of(a).tobytes(), similar.bits_of(b).tobytes(), len(a), len(b))
        assert shared <= got <= min(len(a), len(b)) and (got < shared + 120 or min(len(a), len(b)) == got)
