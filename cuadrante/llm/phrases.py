"""Phrases of two to four words that stay together, by Toivonen's mining.

A sample of the documents proposes phrases. A full pass counts, exactly and over all documents, every phrase whose
beginning and end (the phrase without its last and without its first word) are proposed: the proposed ones and their
negative border. All words are counted. When no frequent phrase lies outside what was proposed, all frequent phrases are
counted: beginning and end of a frequent phrase are frequent, so by induction over the length they are proposed, and it
was counted. If a phrase of the border turns out frequent, longer phrases may have been left out; then a second pass
counts what the first one has not, if it may be frequent: if beginning and end were counted and are frequent, or were
not counted and may be frequent themselves, by the same rule. Beginning and end of a frequent phrase always are, by
induction, so two passes are enough, whatever the sample holds; a worse sample leaves more to the second.

What is proposed is handed to the tasks as one table of bits of a fixed greatest size (MAX_BITS), filled by 64-bit
hashes. A bit set by another phrase makes a pass count more than it must, never less, so counts don't depend on hashes;
they are kept by the phrases themselves. Within a slice of text, phrases are told apart by exact numbers of pairs of
numbers, and summed before they are shuffled.

Defined cases: a null text is empty; a null language is ``und``. Every row counts, repeated rows and ids, too. An empty
table gives an empty result. Texts longer than a slice are cut between pieces, where no phrase goes across. Columns
but the id, the text and the language are not read; the id, which may be null, only spreads the sample.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, slices

#: What ends a piece; phrases don't go across. Words are what spaces and tabs separate.
ENDS = r"[.,;:!?\x0A-\x0D]"
LONGEST = 4
MIN_COUNT = 30
TOP = 2_000
#: One in SAMPLE documents proposes; what it has PROPOSED times or more is proposed.
SAMPLE, PROPOSED = 8, 3
SLICE_BYTES = 2_000_000
ROWS = 100_000  # of a batch that is given out
LEAST_BITS, MAX_BITS = 16, 27  # as powers of two; the tables of bits are 8 KB to 16 MB
PER_PHRASE = 16  # bits of a table for each phrase, at least
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (lang, text) -> slices of about SLICE_BYTES; longer texts are cut where pieces end."""
    for batch in (x for b in batches for x in slices(b, 1, SLICE_BYTES)):
        if batch.num_rows > 1 or (pc.binary_length(batch.column(1))[0].as_py() or 0) <= SLICE_BYTES:
            yield batch
            continue
        text, start, lang = batch.column(1)[0].as_py(), 0, batch.column(0)
        cut = re.compile(ENDS)
        while start < len(text):
            end = cut.search(text, min(len(text), start + SLICE_BYTES // 4))
            stop = end.end() if end else len(text)
            yield pa.record_batch([lang, pa.array([text[start:stop]], pa.string())], names=["lang", "text"])
            start = stop


@dataclass
class Symbols:
    """The words of a slice in order. ``name`` numbers (language, word) pairs, -1 where a piece ends; ``langs``,
    ``words`` and ``hashes`` are those of each number."""

    name: np.ndarray
    langs: pa.Array
    words: pa.Array
    hashes: np.ndarray


def symbols(batch: pa.RecordBatch) -> Symbols:
    """A-Z in lower case; ends of pieces and of texts become the word ``.``, which no other word can be."""
    lang = batch.column(0).fill_null("und").dictionary_encode()
    low = pc.ascii_lower(batch.column(1).cast(pa.large_string()).fill_null(""))
    marked = pc.binary_join_element_wise(pc.replace_substring_regex(low, ENDS, " . "), pa.scalar(".", pa.large_string()), pa.scalar(" ", pa.large_string()))
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(marked))
    word = split.flatten().dictionary_encode()
    codes = word.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    of_lang = np.repeat(lang.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(split.offsets.to_numpy()))
    end = word.dictionary.index(pa.scalar(".", pa.large_string())).as_py()
    name = np.full(len(codes), -1, np.int64)
    at = np.flatnonzero(codes != end)
    keys, numbers = np.unique(of_lang[at] * len(word.dictionary) + codes[at], return_inverse=True)
    name[at] = numbers
    l, w = keys // max(1, len(word.dictionary)), keys % max(1, len(word.dictionary))
    return Symbols(name, lang.dictionary.take(pa.array(l)), word.dictionary.take(pa.array(w)), _hashed(lang.dictionary)[l] * BASE + _hashed(word.dictionary)[w])


def _hashed(texts: pa.Array) -> np.ndarray:
    return pd.util.hash_array(np.asarray(texts.to_pylist(), object), categorize=False) if len(texts) else np.zeros(0, np.uint64)


def phrase_hashes(lang: pa.Array, phrase: pa.Array) -> np.ndarray:
    """The hashes that ``_levels`` gives phrases, made from their texts."""
    split = pc.split_pattern(phrase, " ")
    words, langs = split.flatten().dictionary_encode(), lang.dictionary_encode()
    first, n = split.offsets.to_numpy()[:-1], np.diff(split.offsets.to_numpy())
    each = np.repeat(_hashed(langs.dictionary)[langs.indices.to_numpy(zero_copy_only=False)], n) * BASE + _hashed(words.dictionary)[words.indices.to_numpy(zero_copy_only=False)]
    h = each[first]
    for k in range(1, int(n.max(initial=0))):
        longer = np.flatnonzero(n > k)
        h[longer] = h[longer] * BASE + each[first[longer] + k]
    return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * MIX
    return h ^ (h >> np.uint64(32))


@dataclass
class Bits:
    """A set of 64-bit hashes as a table of 2 ** power bits."""

    power: int
    table: np.ndarray  # uint64

    def has(self, h: np.ndarray) -> np.ndarray:
        at = _mixed(h) >> np.uint64(64 - self.power)
        return (self.table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _levels(s: Symbols, tables: list[Bits] | None, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For phrases of 1, 2, ... words: (numbers of their words, hashes, counts, which are counted by the first table).

    Without ``tables`` these are all phrases, with one those whose beginning and end are in it. The second of two has the
    frequent phrases that are counted by the first: beginning and end are in it, or aren't counted yet."""
    name, width = s.name, 1
    found = np.arange(len(s.hashes))[:, None]
    h, n = s.hashes, np.bincount(name[name >= 0], minlength=len(s.hashes))
    again = len(tables or ()) > 1
    known = np.full(len(h), again)
    while True:
        yield found, h, n, known
        if width == longest or not len(h):
            return
        if tables:
            on = tables[-1].has(h) | ~known if again else tables[0].has(h)
            name = np.where((name >= 0) & on[name], name, -1)
            known = known & tables[0].has(h) if again else known
        at = np.flatnonzero((name[:-1] >= 0) & (name[1:] >= 0))
        keys, numbers, n = np.unique(name[at] * len(h) + name[at + 1], return_inverse=True, return_counts=True)
        first, last = keys // len(h), keys % len(h)
        name = np.full(len(name), -1, np.int64)
        name[at] = numbers
        known = known[first] & known[last]
        found = np.column_stack([found[first], found[last][:, -1]])
        h = h[first] * BASE + s.hashes[found[:, -1]]
        width += 1


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (lang, text) -> (h, n) of all phrases that could be the beginning or end of one."""
    for batch in _pieces(batches):
        for _, h, n, _ in _levels(symbols(batch), None, LONGEST - 1):
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], names=["h", "n"])


def _count(shared):
    """Batches (lang, text) -> (lang, phrase, n): phrases counted for the first time. The first pass also gives the
    words, and for the empty phrase the number of words of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        for batch in _pieces(batches):
            s = symbols(batch)
            for words, _, n, known in _levels(s, tables, LONGEST):
                k = words.shape[1]
                if k == 1 and len(tables) > 1:
                    continue
                new = np.flatnonzero(~known)
                for part in np.split(new, range(ROWS, len(new), ROWS)):
                    columns = [s.words.take(pa.array(words[part, i])) for i in range(k)]
                    phrase = pc.binary_join_element_wise(*columns, pa.scalar(" ", pa.large_string())).cast(pa.string())
                    yield pa.record_batch([s.langs.take(pa.array(words[part, 0])), phrase, pa.array(n[part], pa.int64())], names=["lang", "phrase", "n"])
                if k == 1:
                    every = pa.table([s.langs, pa.array(n, pa.int64())], names=["lang", "n"]).group_by("lang").aggregate([("n", "sum")])
                    for b in every.select(["lang", "n_sum"]).combine_chunks().to_batches():
                        yield pa.record_batch([b.column(0), pa.array([""] * b.num_rows, pa.string()), b.column(1)], names=["lang", "phrase", "n"])
            pa.default_memory_pool().release_unused()  # two workers share an executor's memory with the JVM

    return run


def bits_of(hashes: DataFrame) -> Bits:
    """A table for the column ``h``: PER_PHRASE bits a row or more, MAX_BITS at most. Its rows are collected, one for 64
    bits."""
    hashes = settle(hashes.select("h"))
    power = min(MAX_BITS, max(LEAST_BITS, int(PER_PHRASE * hashes.count()).bit_length()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = _mixed(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)) >> np.uint64(64 - power)
            yield pa.record_batch([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["at", "bit"])

    rows = hashes.mapInArrow(place, "at bigint, bit bigint").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << (power - 6), np.uint64)
    table[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return Bits(power, table)


def _hashes_of(frequent: DataFrame, outside: Bits | None = None) -> DataFrame:
    """(h): the hashes of phrases that could begin or end another one; with ``outside`` those that aren't in it."""
    shared = frequent.sparkSession.sparkContext.broadcast(outside)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = phrase_hashes(b.column(0), b.column(1))
            if shared.value is not None:
                h = h[~shared.value.has(h)]
            yield pa.record_batch([pa.array(h.view(np.int64))], names=["h"])

    return frequent.where(F.col("k") < LONGEST).select("lang", "phrase").mapInArrow(run, "h bigint")


def frequent_phrases(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: int = MIN_COUNT, sample: int = SAMPLE) -> DataFrame:
    """(lang, k, phrase, n): every word and phrase of up to LONGEST words that occurs ``least`` times or more in its
    language, and for k = 0 the number of all words of the language."""
    spark = docs.sparkSession
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("row"))
    some = rows.where(F.pmod("row", F.lit(sample)) == 0).select("lang", "text").mapInArrow(_propose, "h bigint, n bigint")
    tables = [bits_of(some.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= PROPOSED))]
    k = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ", -1)))

    def count() -> DataFrame:
        shared = spark.sparkContext.broadcast(tables)
        seen = rows.select("lang", "text").mapInArrow(_count(shared), "lang string, phrase string, n bigint")
        new = seen.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where((F.col("phrase") == "") | (F.col("n") >= least))
        new = settle(new.select("lang", k.alias("k"), "phrase", "n"))
        shared.destroy()
        return new

    counted = count()
    frequent = counted.where("k > 0")
    if not _hashes_of(frequent, tables[0]).head(1):
        return counted
    tables.append(bits_of(_hashes_of(frequent)))
    return counted.unionByName(count())


def _part(words: str, start, size):
    return F.array_join(F.slice(words, start, size), " ")


def collocations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: int = MIN_COUNT, top: int = TOP, sample: int = SAMPLE) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a (its count), l and r (those of the two parts of its
    weakest cut), n (words of the language), score = floor(2000000 a / (l + r)).

    A phrase goes if a longer one that holds it has 80 of 100 of its count or more."""
    counted = settle(frequent_phrases(docs, id_col, text_col, lang_col, least, sample))
    known = counted.where("k > 0").select("lang", "phrase", "n")
    candidates = counted.where("k > 1").withColumn("w", F.split("phrase", " ", -1))
    cuts = candidates.select("lang", "phrase", F.col("n").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    parts = cuts.select("lang", "phrase", "a", "cut", _part("w", F.lit(1), F.col("cut")).alias("first"), _part("w", F.col("cut") + 1, F.size("w") - F.col("cut")).alias("rest"))
    both = parts.join(known.toDF("lang", "first", "l"), ["lang", "first"]).join(known.toDF("lang", "rest", "r"), ["lang", "rest"])
    # Decimals of 38 digits: the product may pass 64 bits.
    scored = both.withColumn("score", F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    weakest = scored.groupBy("lang", "phrase").agg(F.any_value("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("m"))

    inner = [(k, start, size) for k in range(3, LONGEST + 1) for size in range(2, k) for start in range(1, k - size + 2)]
    held = F.array_compact(F.array(*[F.when(F.col("k") == k, _part("w", F.lit(start), F.lit(size))) for k, start, size in inner]))
    within = candidates.where("k > 2").select("lang", F.explode(held).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    free = weakest.join(within, ["lang", "phrase"], "left").where("longer is null or 100 * cast(longer as decimal(20,0)) < 80 * cast(a as decimal(20,0))")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = free.select("lang", "phrase", "a", "m.l", "m.r", "m.score").withColumn("rank", place).where(F.col("rank") <= top)
    totals = counted.where("k = 0").select("lang", "n")
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
