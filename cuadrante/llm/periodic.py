"""Maximal runs of periodic words, found tile by tile.

A run is a stretch of consecutive words that repeats with a smallest period q, is at least twice that long and at least
MIN_WORDS long, and can't be made longer. Periods are taken by octaves: 1 to 7, 8 to 15, 16 to 31 and so on. Within an
octave of periods B to 2B-1 every B-th word is a boundary, so each run of such a period has boundaries inside. Tiles of a
few boundaries with the words around them are solved on their own: two Z-functions a boundary, to the right and to the
left, give for every period how far the words go on repeating, up to 2B words. What they find are fragments
(document, period, interval). Fragments are shuffled by document and period, and those that touch are stitched.

Only live boundaries make tiles. A run of smallest period q of an octave has, in any stretch of q-B+1 places, a piece of
B words whose next copy is more than B/2 and less than 2B words on: were all copies nearer, they would have one
common period by the theorem of Fine and Wilf, and q would be a multiple of it. So boundaries without such a place
nearby (B before, 2B after) lie in no run of the octave. Pieces are told apart exactly, by names of pairs of names.

Defined cases: null, empty and blank texts have no words and no runs. Equal rows get equal results; a null id is an id
like any other. An empty table gives an empty result. A text is taken apart by one task as a whole, in memory in
proportion to it; its tiles are dealt out over all tasks. Columns but the id and the text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, settle, slices, words

MIN_WORDS = 12
SLICE_BYTES = 8_000_000  # of text, taken apart at once
TILE_WORDS = 1_024  # a tile's boundaries span as many words, or eight boundaries if that is more


@dataclass(frozen=True)
class Octave:
    """Periods from ``low`` to ``high`` - 1, a boundary every ``step`` words, ``reach`` words looked at either way;
    a boundary is live from ``before`` words before a place to ``after`` words after it, if the piece of ``piece`` words
    there has its next copy more than ``gap`` and less than ``high`` words on."""

    number: int
    low: int
    high: int
    step: int
    reach: int
    piece: int
    gap: int
    before: int
    after: int

    def least(self, period: int) -> int:
        """How many places in a row must equal the place a period on."""
        return max(period, MIN_WORDS - period)


def octave(number: int) -> Octave:
    """Octave 0 has the periods 1 to 7; octave k the periods from 2 ** (k + 2)."""
    if number == 0:
        # 12 words of a period up to 7 leave 6 places that equal the place a period on: pieces of 6 words.
        return Octave(0, 1, 8, 4, MIN_WORDS, 6, 0, 0, 6)
    b = 4 << number
    return Octave(number, b, 2 * b, b, 2 * b, b, b // 2, b, 2 * b)


# --- tiles ----------------------------------------------------------------------------------------------------------


def _named(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(equal numbers for equal keys, the distance to the next equal key or 0)."""
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    name, gap = np.empty(len(key), np.int64), np.zeros(len(key), np.int64)
    name[order] = np.concatenate([np.zeros(min(1, len(key)), np.int64), np.cumsum(~same)])
    gap[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return name, gap


class Places:
    """The places of some documents' words, document by document, with names for the pieces of ``width`` words that
    begin there. A place with fewer words after it has name -1."""

    def __init__(self, doc: np.ndarray, at: np.ndarray, left: np.ndarray, name: np.ndarray, gap: np.ndarray, width: int):
        self.doc, self.at, self.left, self.name, self.gap, self.width = doc, at, left, name, gap, width

    @classmethod
    def of(cls, codes: np.ndarray, counts: np.ndarray) -> Places:
        doc = np.repeat(np.arange(len(counts)), counts)
        at = np.arange(len(codes)) - np.repeat(np.cumsum(counts) - counts, counts)
        name, gap = _named(doc * (int(codes.max(initial=0)) + 1) + codes)
        return cls(doc, at, np.repeat(counts, counts) - at, name, gap, 1)

    def repeated(self) -> Places:
        """Only the documents in which a piece comes twice."""
        has = np.zeros(int(self.doc.max(initial=-1)) + 1, bool)
        has[self.doc[self.gap > 0]] = True
        stay = has[self.doc]
        return self if stay.all() else Places(*[x[stay] for x in (self.doc, self.at, self.left, self.name, self.gap)], self.width)

    def widened(self, width: int) -> Places:
        """Pieces of ``width`` words, up to twice as many as now, from two that overlap."""
        full = np.flatnonzero(self.left >= width)
        name, gap = np.full(len(self.name), -1, np.int64), np.zeros(len(self.name), np.int64)
        first, last = self.name[full], self.name[full + width - self.width]
        low_name, low_gap = _named(first * (int(self.name.max(initial=0)) + 1) + last)
        name[full] = low_name
        # Distances are counted in places of ``full``; within a document these have no holes.
        gap[full] = low_gap
        return Places(self.doc, self.at, self.left, name, gap, width).repeated()


def _live(p: Places, o: Octave) -> tuple[np.ndarray, np.ndarray]:
    """(document, number of the boundary) of the live boundaries, each once, in order."""
    good = np.flatnonzero((p.gap > o.gap) & (p.gap < o.high))
    doc, at, words_of = p.doc[good], p.at[good], p.at[good] + p.left[good]
    first, last = -(-(at - o.before) // o.step), (at + o.after) // o.step
    pairs = []
    for k in range(int((last - first).max(initial=-1)) + 1):
        j = first + k
        ok = (j >= 0) & (j <= last) & (j * o.step < words_of)
        pairs.append(np.unique(doc[ok] << 40 | j[ok]))
    found = np.unique(np.concatenate([np.zeros(0, np.int64), *pairs]))
    return found >> 40, found & ((1 << 40) - 1)


def find_tiles(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Rows (document, octave, first boundary, last boundary, first word, number of words) by document. ``codes`` are
    the words of all documents, equal numbers for equal words, ``counts`` the number of words of each."""
    rows = [np.zeros((0, 6), np.int64)]
    p = Places.of(codes, counts).repeated().widened(2).widened(4)
    number = 0
    while len(p.doc):
        o = octave(number)
        wide = p.widened(o.piece)
        doc, j = _live(wide, o)
        if len(doc):
            tile = j // max(8, TILE_WORDS // o.step)
            starts = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (tile[1:] != tile[:-1])]))
            ends = np.append(starts[1:], len(doc)) - 1
            low, high = j[starts] * o.step, j[ends] * o.step
            at = np.maximum(low - o.reach, 0)
            upto = np.minimum(high + o.high + o.reach, counts[doc[starts]])
            rows.append(np.column_stack([doc[starts], np.full(len(starts), number), low, high, at, upto - at]))
        p = wide if number else p  # pieces of 8 words are made from those of 4
        number += 1
    found = np.concatenate(rows)
    return found[np.argsort(found[:, 0], kind="stable")]


TILE = pa.struct([(n, pa.int32()) for n in ("octave", "low", "high", "at", "size")])
CUT = "id {kind}, text_key bigint, n_words bigint, kept string, text string, codes array<int>, tiles array<struct<octave:int,low:int,high:int,at:int,size:int>>"


def _lists(values: pa.Array, counts: np.ndarray, none: np.ndarray | None = None) -> pa.ListArray:
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, values, mask=None if none is None else pa.array(none))


def _cut(digest: bool):
    """Batches (id, text_key, text) -> rows of CUT; ``kept`` is final where there are no tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b, 2, SLICE_BYTES)):
            plain = pc.ascii_trim_whitespace(batch.column(2).cast(pa.large_string()).fill_null(""))
            split = pc.ascii_split_whitespace(plain)
            counts = np.diff(split.offsets.to_numpy())
            blank = pc.equal(plain, "").to_numpy(zero_copy_only=False)
            counts[blank] = 0  # an empty text is split into one empty word
            coded = split.flatten().dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            if blank.any():
                codes = codes[np.repeat(~blank, np.diff(split.offsets.to_numpy()))]
            tiles = find_tiles(codes, counts)
            n_tiles = np.bincount(tiles[:, 0], minlength=batch.num_rows)
            live = n_tiles > 0
            joined = pc.if_else(pa.array(blank), pa.scalar("", pa.large_string()), pc.binary_join(split, pa.scalar(" ", pa.large_string()))).cast(pa.string())
            done = joined.filter(pa.array(~live))
            if digest:
                done = pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for t in done], pa.string())
            kept = pc.replace_with_mask(pa.nulls(batch.num_rows, pa.string()), pa.array(~live), done)
            shown = np.where(live, counts, 0)
            own = pa.array(codes[np.repeat(live, counts)].astype(np.int32))
            tile = pa.StructArray.from_arrays([pa.array(tiles[:, i + 1].astype(np.int32)) for i in range(5)], fields=list(TILE))
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(counts.astype(np.int64)), kept, pc.if_else(pa.array(live), joined, pa.scalar(None, pa.string())), _lists(own, shown, ~live), _lists(tile, n_tiles)],
                names=["id", "text_key", "n_words", "kept", "text", "codes", "tiles"],
            )

    return run


# --- one tile -------------------------------------------------------------------------------------------------------


def z_values(s: list[int], upto: int) -> list[int]:
    """For the first ``upto`` places of ``s``: how many items from there on equal those from its beginning on."""
    n, z, left, right = len(s), [0] * min(upto, len(s)), 0, 0
    for i in range(1, len(z)):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _parts(p: int) -> list[int]:
    """``p`` divided by each of its primes."""
    found, rest, r = [], p, 2
    while r * r <= rest:
        if rest % r == 0:
            found.append(p // r)
            while rest % r == 0:
                rest //= r
        r += 1
    return found + ([p // rest] if rest > 1 else [])


def fragments(tile: list[int], low: int, high: int, at: int, o: Octave) -> list[tuple[int, int, int]]:
    """(period, start, stop): stretches of places that equal the place a period on, around the boundaries of a tile
    whose first word is word ``at`` of its document. No period is a multiple of one that the same words have."""
    out, n = [], len(tile)
    for c in range(low - at, high - at + 1, o.step):
        begin, end = max(0, c - o.reach), min(n, c + o.high - 1)
        ahead = z_values(tile[c : c + o.high + o.reach], o.high)
        pattern = tile[begin:c][::-1]
        # Word c + p - 1 is at place end - c - p of the words up to ``end``, read backwards.
        both = z_values([*pattern, -1, *tile[begin:end][::-1]], len(pattern) + 1 + end - c)
        back = both[len(pattern) + 1 :][::-1]  # of periods 1, 2, ...
        for p in range(o.low, min(o.high - 1, n - c) + 1):
            right, left = min(ahead[p], o.reach) if p < len(ahead) else 0, back[p - 1]
            if right + left >= o.least(p) and not any(back[d - 1] >= left and ahead[d] >= right + p - d for d in _parts(p) if d < p):
                out.append((p, at + c - left, at + c + right))
    return out


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, found = [], []
        for i, (number, low, high, at, words_) in enumerate(zip(*[batch.column(k).to_pylist() for k in range(2, 7)])):
            got = fragments(words_, low, high, at, octave(number))
            rows += [i] * len(got)
            found += got
        of = pa.array(rows, pa.int64())
        yield pa.record_batch([batch.column(0).take(of), batch.column(1).take(of), *[pa.array([f[k] for f in found], pa.int64()) for k in range(3)]], names=["id", "text_key", "period", "start", "stop"])


def _collapse(digest: bool):
    """Batches (id, n_words, text, runs) -> (id, n_words, runs, kept)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for text, runs in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if runs:
                    all_words = np.array(text.split(" "), object)
                    drop = np.zeros(len(all_words) + 1, np.int64)
                    for r in runs:
                        drop[r["start"] + r["period"]] += 1
                        drop[r["start"] + r["length"]] -= 1
                    text = " ".join(all_words[np.cumsum(drop)[:-1] == 0])
                kept.append(hashlib.sha256(text.encode()).hexdigest() if digest else text)
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(3), pa.array(kept, pa.string())], names=["id", "n_words", "runs", "kept"])

    return run


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def stitched(found: DataFrame) -> DataFrame:
    """(id, text_key, runs): fragments that touch are one run; runs by start, then period."""
    of = Window.partitionBy("id", "text_key", "period").orderBy("start", "stop")
    before = found.withColumn("upto", F.max("stop").over(of.rowsBetween(Window.unboundedPreceding, -1)))
    grouped = before.withColumn("part", F.count_if(F.col("upto").isNull() | (F.col("start") > F.col("upto"))).over(of.rowsBetween(Window.unboundedPreceding, 0)))
    each = grouped.groupBy("id", "text_key", "period", "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    run = F.struct("start", (F.col("stop") - F.col("start") + F.col("period")).alias("length"), "period")
    by_start = each.groupBy("id", "text_key").agg(F.sort_array(F.collect_list(F.struct("start", "period", run.alias("run")))).alias("all"))
    return by_start.select("id", "text_key", F.col("all.run").cast(RUNS).alias("runs"))


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, n_words, runs (array of start, length, period by start, then period), kept.

    ``kept`` are the words that stay if of each run only the first period does, joined by one space; with ``digest``
    the sha256 of that text instead, so that no whole texts are written between the steps."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    cut = settle(rows.mapInArrow(_cut(digest), CUT.format(kind=kind)))
    live = cut.where(F.size("tiles") > 0)

    def with_words(t: Column) -> Column:
        return F.struct(t["octave"].alias("octave"), t["low"].alias("low"), t["high"].alias("high"), t["at"].alias("at"), F.slice("codes", t["at"] + 1, t["size"]).alias("codes"))

    tiles = live.select("id", "text_key", F.explode(F.transform("tiles", with_words)).alias("t")).select("id", "text_key", "t.*")
    n = max(12, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = tiles.repartition(n, "id", "text_key", "octave", "low").mapInArrow(_solve, f"id {kind}, text_key bigint, period bigint, start bigint, stop bigint")
    runs = stitched(found).withColumnsRenamed({"id": "run_id", "text_key": "run_key"})
    both = live.select("id", "text_key", "n_words", "text").join(runs, F.col("id").eqNullSafe(F.col("run_id")) & (F.col("text_key") == F.col("run_key")), "left")
    none = F.array().cast(RUNS)
    solved = both.select("id", "n_words", "text", F.coalesce("runs", none).alias("runs")).mapInArrow(_collapse(digest), f"id {kind}, n_words bigint, runs {RUNS}, kept string")
    plain = cut.where(F.size("tiles") == 0).select("id", "n_words", none.alias("runs"), "kept")
    return plain.unionByName(solved).withColumnRenamed("id", id_col)


# --- the query's own columns ----------------------------------------------------------------------------------------


def planted(doc_id: Column, text: Column) -> Column:
    """A tenth of the texts, chosen by the crc32 of the id, go round in a period from some word on."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def turned(a: Column) -> Column:
        n = F.size(a)
        start = (g % n).cast("int")
        period = (1 + F.floor((n - start) / (3 + g % 8))).cast("int")
        place = lambda i: F.when(i < start, i).otherwise(start + F.pmod(i - start, period))
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.get(a, place(i))), " "))

    return F.when(h % 10 == 0, let(words(text), turned)).otherwise(text)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_runs, the longest run (start, length, period, exponent_milli; nulls if there is none), and sha256 of all
    runs as lines and of the kept words, from ``find_runs`` with ``digest``."""
    order = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])), "\n")
    best = found.withColumn("best", F.array_max(order))
    length, period = F.col("best.length"), -F.col("best.period")
    return best.select(
        id_col, F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.col("kept").alias("collapsed_sha256"),
    )
