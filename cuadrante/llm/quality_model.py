"""A quality classifier: naive Bayes support vectors.

A document is the set of its n-grams: words and pairs of words as they are written in lower case, and one to three
shapes in a row. A shape keeps a word's kinds of characters only (``Hallo!!`` is ``Aa!``), with a sign for a word that
repeats the one before, so junk is seen whatever its words. N-grams are hashed to BUCKETS indicators.

Each indicator is scaled by its naive Bayes log-count ratio, the logarithm of how much more often good documents have
it than bad ones. On the scaled indicators, brought to length one, a linear hinge-loss model is fitted by dual coordinate
descent, and its margins are mapped to probabilities by a logistic function of margins that are taken out of fold. The
fit sees at most MAX_TRAIN_ROWS labelled texts with MAX_TRAIN_ITEMS indicators together, chosen by a hash of the text;
only these come to the driver, as lists of bucket numbers.

Labels are learned from rows only whose crc32 of the id isn't 0 modulo 5; scores never use id, language, source or label.

Defined cases: null and empty texts have no indicators and get the score of the bias alone. Repeated
rows get equal scores. Null labels and labels of unknown documents are ignored; equal texts are learned once, as bad if
any of their labels says so. Without labels of both kinds every score is the share of good labels, or one half. An empty
table gives an empty result. Texts are read whole, whatever their length; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, slices, spread

BUCKETS = 1 << 18
#: Bounds on what the hinge-loss model is fitted on.
MAX_TRAIN_ROWS, MAX_TRAIN_ITEMS = 12_000, 10_000_000
SLICE_BYTES = 4_000_000
COST, EPOCHS, FOLDS, SMOOTH = 1.0, 30, 4, 1.0
THRESHOLD = 0.3
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
KINDS = re.compile(r"(\d+)|([^\W\d_]+)|(.)\3*", re.S)


def shape(word: str) -> str:
    """Digits become 0, letters A, Aa or a; of one sign in a row one stays."""
    def kind(m: re.Match) -> str:
        if m[1]:
            return "0"
        if m[2]:
            letters = m[2]
            return "A" if letters.isupper() and len(letters) > 1 else "Aa" if letters[0].isupper() else "a"
        return m[3]

    return KINDS.sub(kind, word)


def _hashes(values: pa.Array | list) -> np.ndarray:
    values = values.to_pylist() if isinstance(values, pa.Array) else values
    return pd.util.hash_array(np.asarray(values, object), categorize=False) if len(values) else np.zeros(0, np.uint64)


def indicators(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every n-gram of the texts, each once, by document."""
    plain = pc.ascii_trim_whitespace(texts.cast(pa.large_string()).fill_null(""))
    split = pc.ascii_split_whitespace(plain)
    counts = np.diff(split.offsets.to_numpy())
    coded = split.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(counts)), counts)
    words = coded.dictionary.to_pylist()
    word = _hashes([w.lower() for w in words])[codes] if words else np.zeros(0, np.uint64)
    form = _hashes([shape(w) for w in words])[codes] if words else np.zeros(0, np.uint64)
    again = np.concatenate([[False], (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])])[: len(codes)]
    form = form + again.astype(np.uint64) * MIX
    found = []
    for seed, row, longest in ((1, word, 2), (7, form, 3)):
        gram, at = row, np.arange(len(row))
        for n in range(1, longest + 1):
            if n > 1:
                ok = np.flatnonzero(doc[at] == doc[np.minimum(at + n - 1, len(doc) - 1)]) if len(at) else at
                ok = ok[at[ok] + n - 1 < len(doc)]
                gram, at = gram[ok] * BASE + row[at[ok] + n - 1], at[ok]
            h = (gram + np.uint64(seed + n)) * MIX
            bucket = ((h ^ (h >> np.uint64(31))) * BASE) >> np.uint64(64 - 18)
            found.append((doc[at] << 18) | bucket.astype(np.int64))
    blank = np.flatnonzero(pc.equal(plain, "").to_numpy(zero_copy_only=False))
    every = np.unique(np.concatenate([np.zeros(0, np.int64), *found]))
    d, b = every >> 18, every & (BUCKETS - 1)
    if len(blank):  # an empty text is split into one empty word
        stay = ~np.isin(d, blank)
        d, b = d[stay], b[stay]
    return d, b


# --- fitting --------------------------------------------------------------------------------------------------------


@dataclass
class Model:
    weights: np.ndarray  # of each bucket: ratio times weight, and squared ratios beside it
    squares: np.ndarray
    bias: float
    slope: float
    base: float

    def score(self, doc: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        size = np.sqrt(np.bincount(doc, self.squares[bucket], n))
        margin = np.bincount(doc, self.weights[bucket], n) / np.maximum(size, 1e-12) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.base, -50, 50)))


def coordinate_descent(items: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = 0) -> tuple[np.ndarray, float]:
    """(weights, bias) of the linear model with the least squared length plus cost times hinge losses, by descent on one
    dual variable after the other. Rows have length one; the bias is the weight of one more indicator of all rows."""
    w, bias, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(y))
    diagonal = np.array([v @ v + 1.0 for v in values])
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in random.permutation(len(y)).tolist():
            g = y[i] * (w[items[i]] @ values[i] + bias) - 1
            moved = min(max(alpha[i] - g / diagonal[i], 0.0), cost)
            step = moved - alpha[i]
            if step:
                alpha[i] = moved
                w[items[i]] += step * y[i] * values[i]
                bias += step * y[i]
                worst = max(worst, abs(step))
        if worst < 1e-3 * cost:
            break
    return w, bias


def logistic(margins: np.ndarray, good: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """(slope, base) by Newton steps, with targets drawn in a little so that separable margins end."""
    up, down = good.sum(), len(good) - good.sum()
    target = np.where(good, (up + 1) / (up + 2), 1 / (down + 2))
    x, ab = np.column_stack([margins, np.ones(len(margins))]), np.array([0.0, np.log((up + 1) / (down + 1))])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -50, 50)))
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - target))
        ab = ab - move * min(1.0, 5.0 / max(np.abs(move).max(), 1e-9))
        if np.abs(move).max() < 1e-8:
            break
    return float(max(ab[0], 0.0)), float(ab[1])


def log_ratios(items: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    """Of each bucket the logarithm of its share of good rows over its share of bad ones, smoothed."""
    share = [(np.bincount(np.concatenate([np.zeros(0, np.int32), *[x for x, g in zip(items, good) if g == side]]), minlength=BUCKETS) + SMOOTH) / ((good == side).sum() + SMOOTH) for side in (True, False)]
    return np.log(share[0]) - np.log(share[1])


def supported(items: list[np.ndarray], good: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(ratios, weights, bias) from both kinds of rows."""
    ratios = log_ratios(items, good)
    scaled = [ratios[i] for i in items]
    w, bias = coordinate_descent(items, [v / max(1e-12, np.sqrt(v @ v)) for v in scaled], np.where(good, 1.0, -1.0))
    return ratios, w, bias


def fit(items: list[np.ndarray], good: np.ndarray, fold: np.ndarray) -> Model:
    """A model from sets of buckets, their labels, and a fold for each row."""
    if not len(good) or good.all() or not good.any():
        share = (good.sum() + 0.5) / (len(good) + 1) if len(good) else 0.5
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0, float(np.log(share / (1 - share))))
    margins = np.full(len(good), np.nan)
    for k in range(FOLDS):
        inside, out = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(out) and good[inside].any() and not good[inside].all():
            ratios, w, bias = supported([items[i] for i in inside], good[inside])
            margins[out] = [(w[items[i]] @ ratios[items[i]]) / max(1e-12, np.sqrt(ratios[items[i]] @ ratios[items[i]])) + bias for i in out]
    ratios, w, bias = supported(items, good)
    told = ~np.isnan(margins)
    slope, base = logistic(margins[told], good[told]) if told.any() else (1.0, 0.0)
    return Model(w * ratios, ratios**2, bias, slope, base)


# --- Spark ----------------------------------------------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_TRAIN_ROWS, max_items: int = MAX_TRAIN_ITEMS) -> Model:
    """A model from labelled rows that aren't held out."""
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("good")).where(F.col("good").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    chosen = chosen.groupBy("id").agg(F.min("good").alias("good")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    # Of equal texts one is learned from; repeated ids can't bring in more than max_rows texts.
    texts = rows.groupBy(F.xxhash64("text").alias("key")).agg(F.min("good").alias("good"), F.any_value("text").alias("text")).orderBy("key").limit(max_rows)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for b in batches for x in slices(b, 2, SLICE_BYTES)):
            doc, bucket = indicators(b.column(2))
            n = np.bincount(doc, minlength=b.num_rows)
            items = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(bucket.astype(np.int32)))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(n, pa.int64()), items], names=["key", "good", "n", "items"])

    train = settle(spread(texts).mapInArrow(cut, "key bigint, good int, n bigint, items array<int>"))
    sizes = train.select("key", "n").toArrow()  # two numbers for each of max_rows
    keys = sizes.column("key").to_numpy()
    by_key = np.argsort(keys)
    fits = by_key[np.cumsum(sizes.column("n").to_numpy()[by_key]) <= max_items]
    taken = train.where(F.col("key") <= int(keys[fits].max())) if len(fits) else train.limit(0)
    found = taken.toArrow().sort_by("key").combine_chunks()
    lists = found.column("items").combine_chunks()
    offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    items = [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
    return fit(items, found.column("good").to_numpy() == 1, found.column("key").to_numpy() % FOLDS)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two numbers for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for b in batches for x in slices(b, 1, SLICE_BYTES)):
            doc, bucket = indicators(b.column(1))
            yield pa.record_batch([b.column(0), pa.array(shared.value.score(doc, bucket, b.num_rows), pa.float64())], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
