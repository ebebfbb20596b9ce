"""Toxicity by a weighted finite-state grammar over clauses.

Words are mapped to symbols: insult, threat, target, negation, report, other. Transducers over these symbols - one that
marks what a negation reaches, one that marks what stands in reported speech, one that notes whether a target is named -
are composed into one machine that reads each clause once. A clause yields patterns, such as "insult, negated, at a
target", rather than isolated words; a document's score is a logistic function of its pattern counts.

The insult list is extended from labelled rows. Words: those that many distinct toxic texts have, in many different
contexts, and clean texts hardly. Stems: beginnings of words that toxic texts have twice or more, in many forms, and
clean texts hardly twice; for these the density in the text counts, too. Contexts and forms are counted because near
copies of one toxic text repeat all of its words. Weights
start from the grammar's own values and are fitted on the pattern counts of the same rows. Both steps see at most
MAX_TRAIN_ROWS labelled rows, chosen by a hash of the id; scores never use id, language, source or label.

Defined cases: null and empty texts have no clause and get the score of a text without patterns; repeated rows get
equal scores; labels of unknown documents and null labels are ignored, contradictory ones, also of equal texts, count as
toxic; without any labelled row the grammar's own weights are used; an empty table gives an empty result. Long texts are
read as a whole, clause by clause; other columns are not read. At most MAX_TERMS words and MAX_STEMS stems are learned,
those of the most toxic texts first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

#: Bound on the labelled rows that are used for learning.
MAX_TRAIN_ROWS = 20_000
MAX_TERMS = 2_000
MIN_TEXTS, MIN_CONTEXTS, MIN_SHARE = 12, 12, 0.8
MAX_STEMS, STEM_LETTERS, STEM_TEXTS, STEM_FORMS, STEM_SHARE = 64, range(4, 9), 6, 5, 0.75
THRESHOLD = 0.3

#: The grammar's word classes.
LEXICON = {
    "insult": "idiot idiots moron morons stupid trash scum loser losers pathetic worthless disgusting clown clowns dumb fool imbecile filth vermin garbage idiotisch dumm dummkopf trottel abschaum versager widerlich wertlos idiote imbécile crétin ordure dégoûtant minable idiota imbécil estúpido basura escoria asqueroso inútil",
    "threat": "kill hurt destroy beat strangle shoot stab burn töten umbringen verletzen tuer blesser détruire matar golpear destruir",
    "target": "you your he she they them him her people man woman du ihr sie er man tu vous il elle ils tú usted él ella ellos",
    "negation": "not no never isn't aren't wasn't don't doesn't nicht kein keine nie pas jamais aucun no nunca ningún",
    "report": "said says wrote writes called claims claimed according quoted sagte schrieb nannte laut dit écrit selon dijo escribió según",
}
SYMBOLS = ("other", "insult", "stem", "threat", "target", "negation", "report")
HEADS = ("insult", "stem", "threat")
TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE = re.compile(r"[.!?;:,|\n]+")
REACH = 3  # words that a negation reaches


@dataclass
class Transducer:
    """Deterministic: (state, symbol) -> (state, symbol). A missing arc stays and copies."""

    arcs: dict[tuple[int, str], tuple[int, str]] = field(default_factory=dict)

    def step(self, state: int, symbol: str) -> tuple[int, str]:
        return self.arcs.get((state, symbol), (state, symbol))


def negation() -> Transducer:
    """Marks an insult or threat within REACH words after a negation."""
    t = Transducer()
    for state in range(REACH + 1):
        t.arcs[state, "negation"] = (REACH, "negation")
        for symbol in ("other", *HEADS, "target", "report"):
            marked = f"{symbol}-negated" if state and symbol in HEADS else symbol
            t.arcs[state, symbol] = (max(state - 1, 0), marked)
    return t


def reported() -> Transducer:
    """Marks insults and threats after a verb of speech, up to the end of the clause."""
    t = Transducer({(0, "report"): (1, "report")})
    for symbol in (*HEADS, *[f"{h}-negated" for h in HEADS]):
        t.arcs[1, symbol] = (1, f"{symbol}-reported")
    return t


def targeted() -> Transducer:
    """Remembers a target in its state."""
    return Transducer({(0, "target"): (1, "target")})


def compose(*machines: Transducer) -> tuple[list[dict[str, tuple[int, str]]], list[tuple[int, ...]]]:
    """The machine that feeds each symbol through all of them: a table of arcs, and the parts of each state."""
    states, index, table = [(0,) * len(machines)], {(0,) * len(machines): 0}, []
    for at in states:  # grows as states are found
        row = {}
        for symbol in SYMBOLS:
            out, nxt = symbol, []
            for m, s in zip(machines, at):
                s, out = m.step(s, out)
                nxt.append(s)
            if tuple(nxt) not in index:
                index[tuple(nxt)] = len(states)
                states.append(tuple(nxt))
            row[symbol] = (index[tuple(nxt)], out)
        table.append(row)
    return table, states


PATTERNS = [f"{kind}{neg}{rep}{to}" for kind in HEADS for neg in ("", "-negated") for rep in ("", "-reported") for to in ("", "-at-target")]
FEATURE = {p: i for i, p in enumerate(PATTERNS)}


def prior_weights() -> np.ndarray:
    """Bias, the weight of each pattern, the weight of each head's density."""
    w = [-3.0]
    for p in PATTERNS:
        w.append({"insult": 3.0, "threat": 1.5, "stem": 0.5}[p.split("-")[0]] + 1.0 * p.endswith("-at-target") - 1.5 * ("-negated" in p) - 1.0 * ("-reported" in p))
    return np.maximum(np.array(w + [0.0, 0.5, 0.0]), [-3.0] + [0.0] * (len(PATTERNS) + len(HEADS)))


class Grammar:
    def __init__(self, learned: list[str] = (), stems: list[str] = ()):
        self.symbol: dict[str, str] = {}
        for name, words in LEXICON.items():
            for w in words.split():
                self.symbol.setdefault(w, name)
        for w in learned:
            self.symbol.setdefault(w, "insult")
        self.heads = {w for w, s in self.symbol.items() if s in HEADS}
        self.stems = tuple(stems)
        self.table, self.states = compose(negation(), reported(), targeted())

    def of(self, token: str) -> str:
        return self.symbol.get(token) or ("stem" if self.stems and token.startswith(self.stems) else "other")

    def patterns(self, text: str | None) -> np.ndarray:
        """Counts of PATTERNS, then the number of words; all zero for a text without heads."""
        counts = np.zeros(len(PATTERNS) + 1, np.int32)
        low = (text or "").lower()
        words = TOKEN.findall(low)
        if self.heads.isdisjoint(words) and not any(x in low for x in self.stems):
            return counts
        counts[-1] = len(words)
        for clause in CLAUSE.split(low):
            symbols = [self.of(t) for t in TOKEN.findall(clause)]
            if not any(h in symbols for h in HEADS):
                continue
            state, out = 0, []
            for symbol in symbols:
                state, mark = self.table[state][symbol]
                if mark.startswith(HEADS):
                    out.append(mark)
            to = "-at-target" if self.states[state][2] else ""
            for mark in out:
                counts[FEATURE[mark + to]] += 1
        return counts


def features(counts: np.ndarray) -> np.ndarray:
    """Logarithms of the pattern counts, and of each head's number in a thousand words."""
    counts = np.asarray(counts, dtype=float).reshape(-1, len(PATTERNS) + 1)
    heads = [counts[:, [i for p, i in FEATURE.items() if p.startswith(h)]].sum(axis=1) for h in HEADS]
    return np.log1p(np.column_stack([counts[:, :-1], *[1000 * h / np.maximum(counts[:, -1], 1) for h in heads]]))


def logistic(weights: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-(weights[0] + features(counts) @ weights[1:])))


def fit(counts: np.ndarray, toxic: np.ndarray, pull: float = 0.2, rounds: int = 30) -> np.ndarray:
    """Newton steps for a logistic model, pulled towards the grammar's own weights; patterns never count as a sign of
    a clean text."""
    prior = prior_weights()
    if not len(toxic):
        return prior
    x = np.column_stack([np.ones(len(counts)), features(counts)])
    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        gradient = x.T @ (p - toxic) + pull * (w - prior)
        curve = (x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w))
        move = np.linalg.solve(curve, gradient)
        w = w - move * min(1.0, 2.0 / max(np.abs(move).max(), 1e-9))
        if np.abs(move).max() < 1e-6:
            break
    w[1:] = np.maximum(w[1:], 0.0)
    return w


@dataclass
class Model:
    terms: list[str]
    stems: list[str]
    weights: list[float]


def learn_terms(train: DataFrame) -> tuple[list[str], list[str]]:
    """Words and stems of ``train`` (text, toxic) that mark toxic texts; at most MAX_TERMS and MAX_STEMS."""
    texts = settle(train.select(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0)).alias("w"), "toxic", F.xxhash64("text").alias("key")).groupBy("key").agg(F.any_value("w").alias("w"), F.max("toxic").alias("toxic")))
    hot = F.col("toxic") == 1
    forms = texts.select("key", "toxic", F.explode("w").alias("word"))
    begins = forms.withColumn("stem", F.explode(F.transform(F.filter(F.array(*[F.lit(n) for n in STEM_LETTERS]), lambda n: n <= F.length("word")), lambda n: F.substring(F.col("word"), F.lit(1), n))))
    twice = begins.groupBy("key", "toxic", "stem").agg(F.count(F.lit(1)).alias("n"), F.min("word").alias("a"), F.max("word").alias("b")).where("n > 1")
    by_stem = twice.groupBy("stem").agg(F.count_if(hot).alias("t"), F.count_if(~hot).alias("c"), F.size(F.array_union(F.collect_set(F.when(hot, F.col("a"))), F.collect_set(F.when(hot, F.col("b"))))).alias("forms"))
    good = by_stem.where((F.col("t") >= STEM_TEXTS) & (F.col("forms") >= STEM_FORMS) & (F.col("t") >= (F.col("t") + F.col("c")) * STEM_SHARE))
    found = [r[0] for r in good.orderBy(F.desc("t"), F.length("stem"), "stem").limit(MAX_TERMS).select("stem").collect()]
    stems = [x for x in sorted(found, key=len) if not any(x != y and x.startswith(y) for y in found)][:MAX_STEMS]

    places = texts.select("key", "toxic", "w", F.posexplode("w").alias("i", "word")).select("key", "toxic", "word", F.xxhash64(F.get("w", F.col("i") - 1), F.get("w", F.col("i") + 1)).alias("context"))
    by = places.groupBy("word").agg(F.approx_count_distinct(F.when(hot, F.col("key"))).alias("t"), F.approx_count_distinct(F.when(~hot, F.col("key"))).alias("c"), F.approx_count_distinct(F.when(hot, F.col("context"))).alias("ctx"))
    good = by.where((F.col("t") >= MIN_TEXTS) & (F.col("ctx") >= MIN_CONTEXTS) & (F.col("ctx") >= F.col("t") * 0.7) & (F.col("t") >= (F.col("t") + F.col("c")) * MIN_SHARE))
    terms = [r[0] for r in good.orderBy(F.desc("t"), "word").limit(MAX_TERMS).select("word").collect()]
    return [t for t in terms if not t.startswith(tuple(stems))], stems


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_TRAIN_ROWS) -> Model:
    """A model from labelled rows whose crc32 of the id isn't 2 modulo 4."""
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where(F.col("toxic").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    chosen = chosen.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    # Of equal texts one is learned from, toxic if any of them is; repeated ids can't bring in more than max_rows texts.
    texts = rows.groupBy(F.xxhash64("text").alias("key")).agg(F.max("toxic").alias("toxic"), F.any_value("text").alias("text"))
    train = settle(texts.orderBy("key").limit(max_rows).select("text", "toxic"))
    terms, stems = learn_terms(train)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Grammar(terms, stems)
        for b in batches:
            rows = [g.patterns(t).tolist() for t in b.column(0).to_pylist()]
            yield pa.record_batch([pa.array(rows, pa.list_(pa.int32())), b.column(1)], names=["counts", "toxic"])

    rows = train.mapInArrow(count, "counts array<int>, toxic int").collect()  # at most max_rows
    counts = np.array([r[0] for r in rows], dtype=float).reshape(-1, len(PATTERNS) + 1)
    return Model(terms, stems, fit(counts, np.array([float(r[1] == 1) for r in rows])).tolist())


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    weights, terms, stems = model.weights, model.terms, model.stems

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, w = Grammar(terms, stems), np.array(weights)
        for b in batches:
            counts = np.array([g.patterns(t) for t in b.column(1).to_pylist()]).reshape(-1, len(PATTERNS) + 1)
            yield pa.record_batch([b.column(0), pa.array(logistic(w, counts), pa.float64())], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
