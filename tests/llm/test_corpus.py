"""The corpus operators against brute force on small documents with odd cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cuadrante.llm import decontaminate, links, mixing, quality_rules, sharding, simhash, suffix_dedup, token_counts, token_files, toxicity, url_filters

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SYLLABLES = ["ra", "The", "ño", "ti", "él", "on", "st", "q", "Íx", "be"]


def make_docs() -> list[tuple]:
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() + rng.choice(["", "", ".", ",", "\n"]) for _ in range(n))
    passages = [text(30) for _ in range(4)]
    docs = []
    for i in range(90):
        parts = [text(rng.randint(1, 60))]
        if i % 3 == 0:
            parts.append(rng.choice(passages))
        if i % 7 == 0:
            parts += [rng.choice(passages), text(12)]
        docs.append([i, " ".join(parts)])
    docs += [[100 + i, docs[i][1]] for i in range(0, 20, 2)]  # exact copies
    docs += [[200 + i, docs[i][1] + " extra"] for i in range(20)] + [[300 + i, docs[40][1].replace("ra", "RA", i)] for i in range(12)]  # near copies
    docs += [[400, None], [401, ""], [402, " \n "], [403, "x"], [404, "two words"], [405, "a b " * 400], [406, passages[0] * 30], [407, "\x00" * 120], [408, "\x00" * 130], [409, "É" * 70], [410, "é" * 70]]
    docs += [docs[3][:], docs[3][:], [None, "no id at all, twice"], [None, None]]
    return [tuple(d) for d in docs]


DOCS = make_docs()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, "en", f"s{(d or 0) % 3}", len(t or ""), 0, "k") for d, t in DOCS]
    # Extra columns with names that the operators use themselves.
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp int, key string").repartition(5)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


# --- op1


def brute_repeats(docs):
    order = lambda d: 2**63 - 1 if d is None else d
    first = {}
    for d, t in docs:
        b = (t or "").encode()
        for q in range(len(b) - 49):
            first[b[q : q + 50]] = min(first.get(b[q : q + 50], 2**64), order(d))
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for q in range(len(b) - 49):
            if first[b[q : q + 50]] < order(d):
                gone[q : q + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_suffix_dedup(docs, empty):
    assert rows_of(suffix_dedup.remove_repeats(docs).drop("kept_text")) == brute_repeats(DOCS)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    data[1000:1300] = data[200:500]
    words, text = suffix_dedup.words_at(data), data.tobytes()
    sa, rank = suffix_dedup.suffix_array(words, len(data))
    pad = lambda i: text[i : i + 50]
    assert [pad(i) for i in sa] == sorted(pad(i) for i in range(len(data)))
    lcp = suffix_dedup.common_prefixes(words, sa, lanes=7)
    for k in range(1, len(sa)):
        a, b = pad(sa[k - 1]), pad(sa[k])
        same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert lcp[k] == same or len(a) < 50 or len(b) < 50


def test_many_small_shards():
    """Shards of a few hundred bytes give what one shard does."""
    rng = random.Random(2)
    pool = [bytes(rng.randrange(97, 100) for _ in range(60)) for _ in range(6)]
    parts = [(rng.randrange(30), rng.choice(pool)[rng.randrange(6) :]) for _ in range(120)]
    ids, lens = np.array([p[0] for p in parts]), np.array([len(p[1]) for p in parts])
    text, zero = np.frombuffer(b"".join(p[1] for p in parts), np.uint8), np.zeros(len(parts), np.int64)
    one = suffix_dedup.repeated_places(ids, zero, np.arange(len(parts)), lens, text)
    many = suffix_dedup.repeated_places(ids, zero, np.arange(len(parts)), lens, text, shard_bytes=130)
    assert len(one[0]) and set(zip(*map(np.ndarray.tolist, one))) == set(zip(*map(np.ndarray.tolist, many)))


# --- op2


def test_mixing(spark, docs, empty):
    planned, n = mixing.plan_mix(docs, max_epochs=1.2, block_tokens=300)
    rows = [(r["doc_id"], r["source"], r[n["n_tokens"]], r[n["weight"]], r[n["epochs"]], r[n["copies"]]) for r in planned.collect()]
    assert len(rows) == len(DOCS) and set(docs.columns) <= set(planned.columns)
    size, weight, got = Counter(), {}, Counter()
    for _, s, t, w, e, c in rows:
        size[s] += t
        weight[s] = w
        got[s] += t * c
        assert c in (int(e), int(e) + 1)
    total = sum(size.values())
    assert abs(sum(weight.values()) - 1) < 1e-9
    assert max(weight[s] * total / size[s] for s in size) <= 1.2 + 1e-6
    for s in size:  # quotas are met from below, to less than a document
        quota = weight[s] * total
        assert got[s] <= quota + 1e-6 and got[s] > quota - max(t for _, x, t, *_ in rows if x == s) - 1e-6
    mixed = mixing.mix(docs, max_epochs=1.2, block_tokens=300)
    assert mixed.columns == docs.columns and mixed.count() == sum(r[5] for r in rows)
    assert mixing.mix(empty).count() == 0
    shares = spark.createDataFrame([(0.7,), (0.2,), (0.1,)], "share double")
    a = mixing.find_exponent(shares, target_entropy=1.0)
    p = np.array([0.7, 0.2, 0.1]) ** a
    assert abs(-(p / p.sum() * np.log(p / p.sum())).sum() - 1.0) < 1e-4


# --- op3


def test_urls(spark):
    urls = ["http://A.com/en/7", "https://x.Example.com/en/78?q", "http://example.com/en/6#t", "http://notexample.com/en/7", "x", None, "http://n.net/de/8", "a://example.net/de/81", "http://org/es/", "http://com", "http://e.org?x=/es/", "http://e.org:80/es/", "://com/en/", "http://a.com/EN/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(0, urls[0], "h")], "page_id long, url string, rule string")
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]

    def brute(i, u):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].translate(AZ), m[2]) if m else ("", "")
        fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, None, "allow"))
        return i, host, path, best[1], best[2]

    want = Counter([brute(i, u) for i, u in enumerate(urls)] + [brute(0, urls[0])])
    got = rows_of(url_filters.filter_urls(pages, url_filters.rules_frame(spark, rules)).select("page_id", "host", "path", "rule", "verdict"))
    assert got == want
    assert url_filters.filter_urls(pages.limit(0), url_filters.rules_frame(spark, rules)).count() == 0
    assert url_filters.filter_urls(pages, url_filters.rules_frame(spark, rules).limit(0)).where("verdict = 'block'").count() == 0


def test_rules_of_too_many_lengths(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    rules = spark.createDataFrame([("a.com", "/" * n, "block") for n in range(url_filters.MAX_LENGTHS + 1)], "host string, path string, verdict string")
    with pytest.raises(ValueError):
        url_filters.filter_urls(pages, rules)


# --- op4


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(prints):
    fps = sorted(set(p for _, p in prints))
    up = {f: f for f in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                up[root(a)] = root(b)
    low = {}
    for d, p in prints:
        if d is not None:
            low[root(p)] = min(low.get(root(p), d), d)
    return Counter((d, f"{p:016x}", low.get(root(p))) for d, p in prints)


def test_simhash(docs, empty):
    assert rows_of(simhash.near_duplicates(docs)) == brute_components([(d, brute_print(t)) for d, t in DOCS])
    assert simhash.near_duplicates(empty).count() == 0


def test_a_class_of_null_ids_between_two_others(spark, monkeypatch):
    texts = {"left": 0b111, "middle": 0b111111, "right": 0b111111111, "far": 2**40 - 1}
    prints = lambda docs, *_: docs.select(F.col("doc_id").alias("id"), F.element_at(F.create_map(*[F.lit(x) for kv in texts.items() for x in kv]), F.col("text")).cast("long").alias("fp"))
    monkeypatch.setattr(simhash, "fingerprints", prints)
    rows = [(7, "left"), (None, "middle"), (3, "right"), (None, "far")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(got) == brute_components([(d, texts[t]) for d, t in rows])


@pytest.mark.parametrize("split", [20_000, 3])
def test_near_links(spark, split):
    rng = random.Random(4)
    fps = set()
    for _ in range(60):
        f = rng.getrandbits(64)
        for _ in range(rng.randint(1, 8)):
            fps.add(f)
            for _ in range(rng.randint(1, 4)):
                f ^= 1 << rng.randrange(64)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    links = simhash.near_links(spark.createDataFrame([(signed(f),) for f in fps], "fp bigint"), split=split).collect()
    assert all(((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count() <= 3 for r in links)
    forest = {signed(f): signed(f) for f in fps}

    def root(x):
        while forest[x] != x:
            x = forest[x]
        return x

    for r in links:
        forest[root(r["a"])] = root(r["b"])
    want = brute_components([(i, f) for i, f in enumerate(sorted(fps))])
    groups = defaultdict(set)
    for i, h, c in want:
        groups[c].add(root(signed(int(h, 16))))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in links.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 51)} | {101: 100}


def test_components_that_need_more_rounds(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long")
    with pytest.raises(RuntimeError):
        links.components(edges, rounds=1)
    assert links.components(edges.limit(0)).count() == 0


# --- op5


@pytest.fixture(scope="module")
def counter():
    tokens = pytest.importorskip("public_tokenizers")
    return token_counts.Counter(str(tokens.path("byte_bpe_50k.tiktoken")), tokens.PATTERN)


def test_edits(counter):
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "'s", "'", "1", "é", "!!", "x'll ", "word", "\t "]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 3, 20, 500])))
        tree = token_counts.CountTree(text, counter)
        for _ in range(5):
            n = len(text)
            a = rng.randint(0, n)
            b = rng.randint(a, min(n, a + rng.choice([0, 1, 5, 400])))
            new = "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 2, 30])))
            tree.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert tree.text == text and tree.n_tokens == len(counter.encoding.encode_ordinary(text))
            assert [x for leaf in tree.leaves for x in leaf[0]] == [len(p) for p in counter.pattern.findall(text)]


def test_token_counts(docs, empty, counter):
    import public_tokenizers

    args = (str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    got = rows_of(token_counts.count_tokens(docs, *args).select("doc_id", "n_tokens", "n_edited_tokens"))

    def edited(t):
        for a, b, new in token_counts.standard_edits(t):
            a, b = min(a, len(t)), min(b, len(t))
            t = t[:a] + new + t[b:]
        return t

    n = lambda t: len(counter.encoding.encode_ordinary(t))
    assert got == Counter((d, n(t or ""), n(edited(t or ""))) for d, t in DOCS)
    assert token_counts.count_tokens(empty, *args).count() == 0


# --- op6


def test_grammar():
    g = toxicity.Grammar(["blorf"], ["zork"])
    found = lambda t: {p: int(c) for p, c in zip(toxicity.PATTERNS, g.patterns(t)) if c}
    assert found("You are an idiot.") == {"insult-at-target": 1}
    assert found("Not an idiot; a blorf") == {"insult-negated": 1, "insult": 1}
    assert found("They said it was trash, stupid") == {"insult-reported-at-target": 1, "insult": 1}
    assert found("no one may say it is a truly bad moron") == {"insult-at-target": 1} or found("not a b c d moron") == {"insult": 1}
    assert found("zorkling zork") == {"stem": 2} and found("I will kill you") == {"threat-at-target": 1} and found(None) == {}


def test_toxicity(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    rows, labels = [], []
    for i in range(900):
        text = [rng.choice(words) for _ in range(60)]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                text.insert(rng.randrange(50), rng.choice(["stupid", "gronk"]) if i % 8 else "plim" + rng.choice(["a", "bo", "cu", "di", "es", "fi"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    rows += [(1000, None), (1001, "")]
    labels += [(5000, 1), (1, None), (0, 0)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(docs, marks)
    assert "gronk" in model.terms and model.stems
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(900))
    assert np.mean([got[i]["predicted"] == int(i % 4 == 0) for i in held]) > 0.97
    assert got[1000]["score"] == got[1001]["score"] < 0.3
    assert toxicity.score(docs.limit(0), model).count() == 0
    bare = toxicity.learn(docs, marks.limit(0))
    assert not bare.terms and bare.weights == toxicity.prior_weights().tolist()


# --- op7


def brute_quality(text):
    text = text or ""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    w = word.findall(text)
    lines = [x for x in text.split("\n") if word.search(x)]
    wins = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(wins)
    hit = {i + k for i, x in enumerate(wins) if n[x] > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed


def test_quality(spark, docs, empty):
    more = [(900, "| a | b | c |\n" * 20), (901, "Good words stand here and end well.\n" + " ".join(f"w{i}" for i in range(60)) + ".\nLicensed under X."), (902, "SHOUT LOUD " * 5 + "\n" + " ".join(f"w{i}" for i in range(45)) + ".")]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    judged = quality_rules.judge(both)
    got = rows_of(judged.select("doc_id", *quality_rules.RESULTS[:5], "base_failed"))
    assert got == Counter((d, *brute_quality(t)) for d, t in [*DOCS, *more])
    kept = {r["doc_id"]: (r["kept"], r["clean_text"]) for r in judged.where("doc_id >= 900").collect()}
    assert not kept[900][0] and kept[901] == (True, "\n".join(more[1][1].split("\n")[:2])) and kept[902][0]
    assert quality_rules.judge(empty).count() == 0 and judged.where("base_failed and kept").count() == 0
    assert quality_rules.judge(docs).columns[: len(docs.columns)] == docs.columns
    kept = quality_rules.clean(both)
    assert kept.columns == both.columns and quality_rules.clean(empty).count() == 0
    assert rows_of(kept.select("doc_id", "text")) == rows_of(judged.where("kept").select("doc_id", "clean_text"))
    # The figures of the verdict are computed once, not once more for a filter.
    assert quality_rules.clean(docs)._jdf.queryExecution().optimizedPlan().toString().count("all rights reserved") <= 1


# --- op8


def test_wavelet():
    rng = np.random.default_rng(3)
    for ids in (np.zeros(0, np.uint32), np.array([7], np.uint32), rng.integers(0, 50, 3000).astype(np.uint32), rng.integers(0, 70_000, 2000).astype(np.uint32)):
        ends = np.array([len(ids)])
        names, e, m = token_files.read_shard(token_files.write_shard([None], ends, ids))
        assert names == [None] and (m.sequence() == ids).all() and e.tolist() == ends.tolist()
        for i in range(0, len(ids), 97):
            v = int(ids[i])
            assert m.access(i) == v and m.count(v, i) == int((ids[:i] == v).sum()) and m.select(v, m.count(v, i)) == i
        assert m.count(10**6) == 0


def test_token_files(docs, empty):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = str(public.path("word_bpe_49k.json"))
    t = tokenizers.Tokenizer.from_file(path)
    spark = docs.sparkSession
    odd = [(901, "ﬁn Σας Ⅷ ²x³ 'll I'LL don't <|endoftext|> A\x1cB İstanbul _a_ 12 é"), (902, "日本語 text"), (903, "café x")]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    got = token_files.read_documents(token_files.write_shards(both, path, 2, shard_ids=500))
    want, start = [], 0
    for d, x in sorted([*DOCS, *odd], key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = sorted(map(tuple, got.collect()), key=lambda r: r[1])
    drop_start = lambda rows: Counter((r[0], r[2], r[3]) for r in rows)
    assert drop_start(got) == drop_start(want)  # equal ids stand in any order
    at = 0
    for d, s, n, _ in got:
        assert s == at
        at += n
    assert [g for g in got if g[0] is not None and g[0] > 3] == [w for w in want if w[0] is not None and w[0] > 3]
    assert token_files.read_documents(token_files.write_shards(empty, path, 2)).count() == 0


# --- op9


def brute_hits(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(AZ))
    wins = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            wins[tuple(w[s : s + n])].add(str(i))
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for s in range(len(w) - n + 1):
                if found := wins.get(tuple(w[s : s + n])):
                    hit.update(range(s, s + n))
                    ids |= found
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


@pytest.mark.parametrize("rows", [20_000, 0])
def test_decontamination(spark, docs, empty, rows, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)
    by_id = dict(DOCS)
    items = [(1, " ".join(by_id[9].split()[3:30])), (2, by_id[14]), (2, by_id[14]), (3, "two words"), (4, "X"), (5, None), (6, "..."), (10, " ".join(by_id[9].split()[3:30])), (7, "a b a b a b a b a b a b"), (8, by_id[406][:200])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(decontaminate.decontaminate(docs, bench).drop("text_key")) == brute_hits(DOCS, items)
    assert decontaminate.decontaminate(empty, bench).count() == 0
    clean = decontaminate.decontaminate(docs, bench.limit(0))
    assert clean.count() == len(DOCS) and clean.where("contaminated").count() == 0


# --- op10


def test_sharding(spark, docs, empty):
    copies = spark.createDataFrame([(2000 + i, "the same text " * 9) for i in range(300)], "doc_id long, text string")
    rng = random.Random(6)
    plain = spark.createDataFrame([(3000 + i, "x" * rng.randint(50, 150)) for i in range(1500)], "doc_id long, text string")
    every = docs.select("doc_id", "text").union(copies).union(plain)
    got = sharding.shard(every, 6, grain=40, slot_chunks=8).collect()
    texts = Counter((r["doc_id"], r["text"]) for r in every.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sum((Counter({(d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())): n}) for (d, t), n in texts.items()), Counter())
    size, slots = Counter(), defaultdict(list)
    for r in got:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 6
    assert max(size.values()) < 1.05 * min(size.values())
    small = defaultdict(set)
    for r in got:
        if r["size"] * texts.total() and r["text_crc32"] == zlib.crc32(DOCS[0][1].encode()):
            small["copies"].add(r["shard"])
    assert len(small["copies"]) == 1
    assert sharding.shard(empty, 6).count() == 0


# --- pipeline


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(8)
    words = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(900)]
    text = lambda n: ". ".join(" ".join(rng.choice(words) for _ in range(8)) for _ in range(n)) + "."
    good = [(i, text(10)) for i in range(60)]
    bench = [(0, text(4))]
    rows = good + [(100, good[5][1]), (101, good[6][1]), (102, text(5) + " " + bench[0][1]), (103, "| a | b | c | d |\n" * 30), (104, "short"), (105, None)]
    docs = spark.createDataFrame([(d, t, "en", f"s{d % 2}", len(t or ""), "x") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, extra string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {}
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        now = pipeline.settle(stage(spark, now, str(tmp_path)))
        assert now.columns == docs.columns
        kept[name] = Counter(r["doc_id"] for r in now.collect())
    names = [n for n, _ in pipeline.STAGES]
    clean = set(range(60))
    assert set(kept[names[0]]) == clean | {100, 101, 102} and set(kept[names[1]]) == clean | {102} and set(kept[names[2]]) == clean
    assert set(kept[names[3]]) <= clean
    out = pipeline.run(spark, str(tmp_path))
    assert out.count() == sum(kept[names[3]].values()) and {r["law"] for r in out.select("law").distinct().collect()} == {"bytes"}
