"""More of the corpus operators against brute force: other plans, skew, clashing names, stored trees."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cuadrante.llm import common, decontaminate, mixing, quality_rules, sharding, suffix_dedup, token_counts, toxicity, url_filters

from test_corpus import DOCS, brute_repeats, docs, empty, rows_of  # noqa: F401


# --- op1


def _with_hot(run, hot):
    """Workers import the module anew, so the bound is set where it is used."""

    def wrapped(batches):
        from cuadrante.llm import suffix_dedup as there

        before, there.HOT = there.HOT, hot
        try:
            yield from run(batches)
        finally:
            there.HOT = before

    return wrapped


@pytest.mark.parametrize("hot", [50_000, 100, 0])
def test_a_passage_in_half_of_all_documents(spark, hot, monkeypatch):
    """With a passage that counts as hot, with none, and with all."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "mark_repeated", lambda n, hot=hot, f=suffix_dedup.mark_repeated: _with_hot(f(n), hot))
    rng = random.Random(7)
    passage = " ".join(f"word{i}" for i in range(40))
    rows = [(i, " ".join(rng.choice("abcdefg") * rng.randint(1, 9) for _ in range(rng.randint(0, 30))) + (" " + passage + " " if i % 2 else "") + str(rng.random()) * 3) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert rows_of(suffix_dedup.remove_repeats(table).drop("kept_text")) == brute_repeats(rows)


def test_hot_anchors_move_no_texts_again(spark, monkeypatch):
    """What is hot makes no further join with the texts: plans read them as often with hot anchors as without."""
    rng = random.Random(8)
    passage = " ".join(f"word{i}" for i in range(40))
    rows = [(i, passage + " " + str(rng.random()) * 3) for i in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    read, settle, mark = {}, suffix_dedup.settle, suffix_dedup.mark_repeated
    for hot in (50_000, 100):
        plans = []
        monkeypatch.setattr(suffix_dedup, "settle", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or settle(df))
        monkeypatch.setattr(suffix_dedup, "mark_repeated", lambda n, hot=hot: _with_hot(mark(n), hot))
        out = suffix_dedup.remove_repeats(table)
        assert rows_of(out.drop("kept_text")) == brute_repeats(rows)
        read[hot] = sum(p.count(" AS data#") for p in plans)
    assert read[50_000] == read[100] > 0


@pytest.mark.parametrize("n", [200, 800])
def test_rows_of_a_hot_passage_do_not_grow_with_its_documents(spark, n, monkeypatch):
    """No table between the steps has a row for each document or string of the passage."""
    rng = random.Random(9)
    passage = " ".join(f"word{i}" for i in range(40))
    rows = [(i, passage + " " + str(rng.random()) * 3) for i in range(n)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen, settle, mark = [], suffix_dedup.settle, suffix_dedup.mark_repeated
    monkeypatch.setattr(suffix_dedup, "settle", lambda df: seen.append(settle(df)) or seen[-1])
    monkeypatch.setattr(suffix_dedup, "mark_repeated", lambda n: _with_hot(mark(n), 100))
    assert rows_of(suffix_dedup.remove_repeats(table).drop("kept_text")) == brute_repeats(rows)
    packed = [t for t in seen if "part" in t.columns]
    assert len(packed) == 1 and packed[0].count() <= 12 * 12 + 2 * 3 * 13


@pytest.mark.parametrize("together", [1, 40, 10**6])
def test_asks_and_answers(together, monkeypatch):
    """Batches of one segment, of some and of all give the brute-force intervals: ids that are equal, missing or negative,
    equal rows in two batches, a string twice in a document, texts that are too short."""
    monkeypatch.setattr(suffix_dedup, "HOT_STRINGS", together)
    rng = random.Random(10)
    pool = [bytes(rng.randrange(97, 100) for _ in range(rng.randint(50, 120))) for _ in range(4)]
    texts = [b"".join(rng.choice(pool) if rng.random() < 0.6 else bytes(rng.randrange(97, 123) for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(0, 5))) for _ in range(60)]
    ids = [rng.choice([suffix_dedup.LAST, -4, 7, 7, *range(100)]) for _ in texts]
    rows = [(i, k, t) for k, (i, t) in enumerate(zip(ids, texts))]
    rows += rows[:5]
    deal = lambda batches: iter(pa.Table.from_batches(list(batches)).sort_by("part").to_batches())

    def batch(some):
        marks = [(np.unique(suffix_dedup.segments([t])[3]) >> np.uint64(32)).astype(np.uint32).tobytes() for _, _, t in some]
        return pa.record_batch([*map(pa.array, zip(*some)), pa.array(marks, pa.binary()), pa.array([True] * len(some))], names=["id", "key", "data", "marks", "hot"])

    cut = [b for some in (rows[:30], rows[30:]) for b in suffix_dedup.cut_segments(5)(iter([batch(some)])) if b.num_rows]
    assert all(p >= 5 for b in cut for p in b.column(0).to_pylist())
    told = suffix_dedup.read_answers(5)(deal(suffix_dedup.find_intervals(5)(deal(cut))))
    got = {}
    for b in suffix_dedup.by_document(np.int64, 5)(deal(told)):
        for i, k, spans in zip(*[b.column(c).to_pylist() for c in range(3)]):
            assert (i, k) not in got
            got[i, k] = {q for u, v in np.frombuffer(spans, np.int64).reshape(-1, 2).tolist() for q in range(u, v)}
    first = {}
    for i, _, t in rows:
        for q in range(len(t) - 49):
            first[t[q : q + 50]] = min(i, first.get(t[q : q + 50], i))
    want = {(i, k): {q + x for q in range(len(t) - 49) if first[t[q : q + 50]] < i for x in range(50)} for i, k, t in rows}
    assert got == {name: places for name, places in want.items() if places} and got


def test_long_texts_are_cut(spark, monkeypatch):
    """An empty text right before one that is cut, and strings that lie across cuts."""
    monkeypatch.setattr(suffix_dedup, "STEP", 700)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 500)
    rng = random.Random(3)
    long = bytes(rng.randrange(97, 123) for _ in range(9_000))
    texts = [b"", long, b"", long[600:2_000], b"x" * 40, long[3_490:3_540]]
    doc, first, last, h = suffix_dedup.segments(texts)
    for d, f, e in zip(doc.tolist(), first.tolist(), last.tolist()):
        assert 0 <= f <= e and e + suffix_dedup.SPAN <= len(texts[d])
    covered = defaultdict(set)
    for d, f, e in zip(doc.tolist(), first.tolist(), last.tolist()):
        covered[d].update(range(f, e + 1))
    assert all(covered[i] == set(range(max(0, len(t) - 49))) for i, t in enumerate(texts))
    anchor = {}
    for d, f, e, x in zip(doc.tolist(), first.tolist(), last.tolist(), h.tolist()):
        for q in range(f, e + 1):
            anchor[d, q] = x
    assert all(anchor[3, q] == anchor[1, q + 600] for q in range(1_400 - 49)) and anchor[5, 0] == anchor[1, 3_490]


# --- op2


def brute_mix(rows, max_epochs, quota_of):
    size = Counter()
    for _, s, t in rows:
        size[s] += t
    total = sum(size.values())
    share = {s: n / total for s, n in size.items()}
    low, high = 0.0, 1.0
    good = lambda a: max(share[s] ** (a - 1) for s in share) / sum(p**a for p in share.values()) <= max_epochs
    if good(0.0):
        high = 0.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if good(mid) else (mid, high)
    z = sum(p**high for p in share.values())
    return {s: share[s] ** high / z for s in share}, size, total


@pytest.mark.parametrize("broadcast,group", [(20_000, 4_096), (0, 3)])
def test_mixing_against_a_loop(spark, broadcast, group, monkeypatch):
    """One source has a third of the rows, one doc_id another third of them; both plans, and sums over groups of blocks."""
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(mixing, "GROUP", group)
    rng = random.Random(1)
    rows = [(7 if i % 3 == 0 else i, "hot" if i % 3 == 1 else f"s{i % 5}", "w " * rng.randint(0, 60)) for i in range(900)] + [(None, None, None), (1, "hot", "é日本 12-x")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, text string, block string").repartition(4)
    planned, n = mixing.plan_mix(table, max_epochs=1.5, block_tokens=200)
    got = [r.asDict() for r in planned.collect()]
    assert len(got) == len(rows) and {r["block"] for r in got} == {"x"}
    count = {None: 0, "é日本 12-x": 6}
    assert all(r[n["n_tokens"]] == max(1, count.get(r["text"], len((r["text"] or "").split()))) for r in got)
    weights, size, total = brute_mix([(r["doc_id"], r["source"], r[n["n_tokens"]]) for r in got], 1.5, None)
    by_source = defaultdict(list)
    for r in got:
        by_source[r["source"]].append(r)
    for s, own in by_source.items():
        assert abs(own[0][n["weight"]] - weights[s]) < 1e-6
        quota = own[0][n["weight"]] * total
        passes = int(quota / size[s] + 1e-9)
        rest = quota - passes * size[s]
        # In the order of blocks, then of the hash within a block, documents are taken while they fit.
        at, cut = 0, set()
        for _, block in sorted(Counter((r[n["block"]],) for r in own).items()):
            break
        blocks = defaultdict(Counter)
        for r in own:
            blocks[r[n["block"]]][r[n["order"]]] += r[n["n_tokens"]]
        done = False
        for b in sorted(blocks):
            whole = sum(blocks[b].values())
            if not done and at + whole <= rest:
                cut |= set((b, o) for o in blocks[b])
                at += whole
            elif not done:
                for o in sorted(blocks[b]):
                    if at + blocks[b][o] > rest:
                        break
                    at += blocks[b][o]
                    cut.add((b, o))
                done = True
        assert all(r[n["copies"]] == passes + ((r[n["block"]], r[n["order"]]) in cut) for r in own)


def test_targets_that_no_exponent_meets(spark):
    shares = spark.createDataFrame([(0.5,), (0.5,)], "share double")
    with pytest.raises(ValueError):
        mixing.find_exponent(shares, target_entropy=0.1)
    with pytest.raises(ValueError):
        mixing.find_exponent(spark.createDataFrame([(0.7,), (0.3,)], "share double"), max_epochs=0.9)
    steep = mixing.find_exponent(spark.createDataFrame([(0.7,), (0.3,)], "share double"), target_entropy=0.1)
    p = np.array([0.7, 0.3]) ** steep
    assert steep > 1 and abs(-(p / p.sum() * np.log(p / p.sum())).sum() - 0.1) < 1e-4


# --- op3


@pytest.mark.parametrize("broadcast", [20_000, 0])
def test_many_rules(spark, broadcast, monkeypatch):
    monkeypatch.setattr(url_filters, "BROADCAST_ROWS", broadcast)
    rng = random.Random(5)
    rules = {(rng.choice(["a.com", "com", "b.a.com", "x.org"]), "/" + "p" * rng.randint(0, 700)): rng.choice(["allow", "block"]) for _ in range(900)}
    urls = [f"http://{rng.choice(['', 'www.'])}{rng.choice(['a.com', 'b.a.com', 'org', 'x.org'])}/{'p' * rng.randint(0, 800)}" for _ in range(150)] * 2
    pages = spark.createDataFrame([(i % 150, u, 1) for i, u in enumerate(urls)], "page_id long, url string, rank int")
    table = spark.createDataFrame([(h, p, v) for (h, p), v in rules.items()], "host string, path string, verdict string")

    def brute(i, u):
        host, _, rest = u.removeprefix("http://").partition("/")
        fit = [(len(h + p), len(h), v, h + p) for (h, p), v in rules.items() if (host == h or host.endswith("." + h)) and ("/" + rest).startswith(p)]
        best = max(fit, default=None)
        return i, host, "/" + rest, best and best[3], best[2] if best else "allow"

    assert rows_of(url_filters.filter_urls(pages, table)) == Counter(brute(i % 150, u) for i, u in enumerate(urls))


# --- op5


def test_stored_trees(spark, docs, empty):  # noqa: F811
    public = pytest.importorskip("public_tokenizers")
    args = (str(public.path("byte_bpe_50k.tiktoken")), public.PATTERN)
    counter = token_counts.Counter(*args)
    n = lambda t: len(counter.encoding.encode_ordinary(t))
    path = common.settle(token_counts.build_trees(docs, *args))
    assert rows_of(path.select("doc_id", "text", "n_tokens")) == Counter((d, t, n(t or "")) for d, t in DOCS)
    edits = [(9, 1, 5, 9, "new words"), (9, 2, 0, 3, ""), (14, 1, 10**6, 10**6 + 5, " end"), (403, 1, 0, 1, None), (5555, 1, 0, 0, "x"), (3, 1, 2, 2, "it's ")]
    table = spark.createDataFrame([(*e, "k") for e in edits], "doc_id long, seq int, start int, end int, new string, text string")
    got = token_counts.apply_edits(path, table.drop("text"), *args)

    def edited(d, t):
        for i, _, a, b, new in edits:
            if i == d:
                t = t or ""
                a, b = min(a, len(t)), min(b, len(t))
                t = t[:a] + (new or "") + t[b:]
        return t

    assert rows_of(got.select("doc_id", "text", "n_tokens")) == Counter((d, edited(d, t), n(edited(d, t) or "")) for d, t in DOCS)
    assert all(r["n_reencoded"] < 40 and (r["n_reencoded"] > 0) == (r["doc_id"] in {e[0] for e in edits} - {403}) for r in got.collect())
    again = token_counts.apply_edits(got.drop("n_reencoded"), table.drop("text"), *args)  # trees go on from where they were
    assert rows_of(again.select("doc_id", "n_tokens")) == Counter((d, n(edited(d, edited(d, t)) or "")) for d, t in DOCS)
    assert token_counts.build_trees(empty, *args).count() == 0 and token_counts.apply_edits(path, table.drop("text").limit(0), *args).where("n_reencoded > 0").count() == 0


# --- op6


def test_composed_machines_mark_as_each_in_turn():
    """The composed table against the three transducers run one after another."""
    rng = random.Random(2)
    machines = [toxicity.negation(), toxicity.reported(), toxicity.targeted()]
    table, states = toxicity.compose(*machines)
    for _ in range(500):
        symbols = [rng.choice(toxicity.SYMBOLS) for _ in range(rng.randint(0, 12))]
        state, apart, got, want = 0, [0, 0, 0], [], []
        for s in symbols:
            state, out = table[state][s]
            got.append(out)
            for i, m in enumerate(machines):
                apart[i], s = m.step(apart[i], s)
            want.append(s)
        assert got == want and states[state] == tuple(apart)


def brute_marks(text, grammar):
    """Clause by clause: what negation reaches, what follows a verb of speech, whether a target is named."""
    out = Counter()
    for clause in toxicity.CLAUSE.split((text or "").lower()):
        symbols = [grammar.of(t) for t in toxicity.TOKEN.findall(clause)]
        to = "-at-target" if "target" in symbols else ""
        for i, s in enumerate(symbols):
            if s in toxicity.HEADS:
                near = [j for j in range(max(0, i - toxicity.REACH), i) if symbols[j] == "negation"]
                spoken = "report" in symbols[:i]
                out[s + "-negated" * bool(near) + "-reported" * spoken + to] += 1
    return out


def test_patterns_against_a_loop():
    rng = random.Random(4)
    grammar = toxicity.Grammar(["blorf"], ["zork"])
    words = ["you", "not", "never", "idiot", "kill", "said", "blorf", "zorkling", "plain", "a", "tree", "they"]
    for _ in range(400):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", ", ", ". ", "\n"]) for _ in range(rng.randint(0, 25)))
        assert {p: int(c) for p, c in zip(toxicity.PATTERNS, grammar.patterns(text)) if c} == dict(brute_marks(text, grammar))
    no_reach = "no one may say it is a truly bad moron"
    assert dict(brute_marks(no_reach, grammar)) == {p: int(c) for p, c in zip(toxicity.PATTERNS, grammar.patterns(no_reach)) if c}


def test_learning_is_the_same_each_time(spark):
    """Repeated rows, repeated ids with other texts, equal texts with different labels: one model, whatever the order."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdef") for _ in range(5)) for _ in range(200)]
    texts = [" ".join(rng.choice(words) for _ in range(40)) + (" gronk here gronk" if i % 3 == 0 else "") for i in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, "other text")] * 40 + [(1000 + i, texts[i]) for i in range(50)]
    labels = [(i, int(i % 3 == 0)) for i in range(300)] + [(1000 + i, int(i % 3 == 1)) for i in range(50)]
    models = []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        docs = spark.createDataFrame([(*r, 1, "en") for r in rows], "doc_id long, text string, toxic int, lang string").repartition(1 + 3 * seed)  # noqa: F811
        models.append(toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int").repartition(seed), max_rows=250))
    assert models[0].terms == models[1].terms and models[0].stems == models[1].stems and np.allclose(models[0].weights, models[1].weights)
    got = toxicity.score(docs, models[0])
    assert got.count() == len(rows) and all(len({r["score"] for r in got.where(F.col("doc_id") == i).collect()}) == 1 for i in (3, 1003))
    long = spark.createDataFrame([(1, "gronk you. " * 20_000), (2, "plain " * 100_000)], "doc_id long, text string")
    assert {r["doc_id"]: 0 <= r["score"] <= 1 for r in toxicity.score(long, models[0]).collect()} == {1: True, 2: True}


# --- op7


def test_clean_keeps_columns_of_any_name(spark):
    names = [*quality_rules.RESULTS, "clean_text", "text_", "__row", "__text", "line", "w", "fails"]
    good = "Good words stand here and end well.\n" + " ".join(f"w{i}" for i in range(60)) + ".\n| a | b |"
    table = spark.createDataFrame([(1, good, *[f"v{i}" for i in range(len(names))]), (2, "short", *["x"] * len(names))], ", ".join(["doc_id long", "text string", *[f"`{n}` string" for n in names]]))
    got = quality_rules.clean(table)
    assert got.columns == table.columns and [tuple(r) for r in got.collect()] == [(1, "\n".join(good.split("\n")[:2]), *[f"v{i}" for i in range(len(names))])]


# --- op9


def test_many_equal_items(spark, monkeypatch):
    """The ids of equal items are too many to broadcast though the windows are few."""
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 40)
    words = " ".join(f"q{i}" for i in range(12))
    items = spark.createDataFrame([(i, words) for i in range(60)], "item_id long, text string")
    table = spark.createDataFrame([(1, "a " + words), (2, "b"), (1, "a " + words)], "doc_id long, text string")
    got = decontaminate.decontaminate(table, items).collect()
    assert sorted((r["doc_id"], r["n_items"], r["n_hit"]) for r in got) == [(1, 60, 12), (1, 60, 12), (2, 0, 0)]


# --- op10


def brute_pack(vectors, n_shards):
    free, out = [[1.0] * 3 for _ in range(n_shards)], []
    order = sorted(range(len(vectors)), key=lambda i: (-max(vectors[i]), i))
    place = {}
    for i in order:
        v = vectors[i]
        fits = [s for s in range(n_shards) if all(f >= x - 1e-12 for f, x in zip(free[s], v))]
        best = max(fits, key=lambda s: (sum(f * x for f, x in zip(free[s], v)), -s)) if fits else max(range(n_shards), key=lambda s: (free[s][0], -s))
        place[i] = best
        free[best] = [f - x for f, x in zip(free[best], v)]
    return [place[i] for i in range(len(vectors))]


def test_packing_against_a_loop():
    rng = np.random.default_rng(8)
    vectors = np.round(rng.random((120, 3)) * 0.2, 3)
    assert sharding.pack(vectors, 7).tolist() == brute_pack(vectors.tolist(), 7)


def test_equal_rows_are_split(spark):
    """Two thirds of the rows are one row over and over; shards stay near equal."""
    rows = [(5, "the same text " * 5)] * 400 + [(i, "x" * (40 + i % 60)) for i in range(200)] + [(None, None)] * 20
    table = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, shard int, tie string").repartition(5)
    got = sharding.shard(table, 4, grain=40, slot_chunks=8).collect()
    assert len(got) == len(rows)
    size, slots = Counter(), defaultdict(list)
    for r in got:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert max(size.values()) < 1.1 * min(size.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert Counter((r["doc_id"], r["text_crc32"]) for r in got) == Counter((d, zlib.crc32((t or "").encode())) for d, t in rows)


# --- pipeline


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    """Every stage on a table with columns named like what the stages work with."""
    pipeline = pytest.importorskip("corpus_pipeline")
    names = ["kept_id", "hit_id", "hit_key", "text_key", "kept", "clean_text", "n_words", "fp", "key", "copies", "block", "order", "weight", "passed", "id", "row", "size", "shard", "tie", "component_id", "item", "h", "x", "_form"]
    rng = random.Random(8)
    words = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(900)]
    text = lambda n: ". ".join(" ".join(rng.choice(words) for _ in range(8)) for _ in range(n)) + "."
    first = text(10)
    bench = text(4)
    rows = [(i, text(10)) for i in range(12)] + [(20, first), (21, first), (20, first), (20, text(10)), (None, text(10)), (None, first), (30, text(6) + " " + bench), (31, None)]
    table = spark.createDataFrame([(d, t, "en", f"s{(d or 0) % 2}", 0, *[f"{n}{i}" for n in names]) for i, (d, t) in enumerate(rows)], ", ".join(["doc_id long", "text string", "lang string", "source string", "n_chars long", *[f"`{n}` string" for n in names]]))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, seen = table, {}
    for name, stage in pipeline.STAGES[:-1]:
        now = pipeline.settle(stage(spark, now, str(tmp_path)))
        assert now.columns == table.columns
        got = now.collect()
        assert all(r[n] == f"{n}{r['kept_id'].removeprefix('kept_id')}" for r in got for n in names)
        seen[name] = Counter(int(r["kept_id"].removeprefix("kept_id")) for r in got)
    quality, near, clean, mixed = seen.values()
    assert set(quality) == set(range(19)) and set(near) - {12, 14} == set(range(12)) | {15, 16, 18} and len(set(near) & {12, 14}) == 1
    assert set(clean) == set(near) - {18} and set(mixed) <= set(clean)
    last = pipeline.STAGES[-1][1](spark, now, str(tmp_path))
    assert last.count() == sum(mixed.values())


def test_pieces(spark):
    texts = [None, "", " \n", "ab cd", " don't  stop! ", "x1y22 é日本語z ไท", "a\tb\nc ", "한국 말 Ωß", "3.14—ok", "😀 b"]
    want = [0, 0, 0, 2, 5, 11, 3, 3, 5, 2]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(sharding.token_estimate(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in got] == want
