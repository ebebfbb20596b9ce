"""Candidates and verification for texts whose sets of word shingles have a Jaccard similarity of PART / WHOLE or more.

A set of n shingles and one that it is similar to share a shingle among the first n - ceil(4n/5) + 1 of each, whatever
order the shingles are given. Here that order is: cold shingles by hash, then hot ones from the rarest to the commonest.
Hot are the HOT_ROWS commonest of those found HOT times or more in one of SAMPLE documents; which ones are taken
changes the cost, never the result. Sets that meet at a shingle, a cell, are candidates:

* first each set is paired with the smallest set of each of its cells (``stars``), so a group of near copies costs one
  pair a member and shingle, not one for every two;
* what is still apart when those are verified is compared within the cells (``apart``). At the first shingle that two
  sets share, no more can be shared than stands from there on in either, and that must be enough for both sizes; and no
  more than the first shingles that both have, counted from above by their bits, and the rest of the longer set. Only
  pairs that both bounds leave are given out; so a boilerplate that isn't enough by itself gives none.

Candidates are compared by the bits of their whole sets first, an eighth of the bytes or less, which give an upper bound
of what they share. Within cells that is done where the rows of a cell are: no row is made for a pair that this bound
excludes; in a large group of sets that are alike, but not enough, such pairs grow with its square.

Of these, one pair for every two roots is verified first; most groups are whole then, and the pairs within them need not
be looked at.

Stars read a cell row by row. Cells of hot shingles are dealt over several tasks, each with a star of its own; cells that
are compared are cut into squares of at most BLOCK rows a side, and the largest group that is connected already isn't
compared with itself. Pairs are verified on their whole sets. So every pair that is similar ends up connected, and by
no other.

Defined cases: texts of fewer words than a shingle has have the whole sequence as their one shingle; null, empty and
blank texts have none and are copies of each other. Only distinct sets take part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, settle, slices

SHINGLE = 5
#: Similarity as a fraction: 4 of 5.
PART, WHOLE = 4, 5
SAMPLE = 16
HOT = 5
HOT_ROWS = 1_000_000
SALT_ROWS = 5_000  # a hot shingle's documents for each star
BLOCK = 4_000
SIGN = 512  # bits of a signature
PER_SHINGLE = 4  # bits of a whole set for each shingle, at least
SLICE_BYTES = 3_000_000  # of text, taken at once
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def prefix_size(n):
    return n - (PART * n + WHOLE - 1) // WHOLE + 1


def enough(shared, sizes):
    """Whether ``shared`` of two sets with ``sizes`` elements together is similar: shared / (sizes - shared) >= 4 / 5."""
    return shared * (PART + WHOLE) >= sizes * PART


def shingled(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the shingles of all texts, their number in each): A-Z in lower case, ASCII space between words,
    repeats included."""
    plain = pc.ascii_trim_whitespace(pc.ascii_lower(texts.cast(pa.large_string()).fill_null("")))
    split = pc.ascii_split_whitespace(plain)
    coded = split.flatten().dictionary_encode()
    known = pd.util.hash_array(np.asarray(coded.dictionary.to_pylist(), object), categorize=False) if len(coded) else np.zeros(0, np.uint64)
    words = known[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else known
    n = np.diff(split.offsets.to_numpy())
    n[pc.equal(plain, "").to_numpy(zero_copy_only=False)] = 0  # an empty text is split into one empty word
    begin = split.offsets.to_numpy()[:-1] - split.offsets[0].as_py()
    counts = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    at = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    size = np.repeat(np.minimum(n, width), counts)
    out = size.astype(np.uint64)
    for k in range(width):
        has = np.flatnonzero(size > k) if (size <= k).any() else slice(None)
        out[has] = out[has] * BASE + words[at[has] + k]
    out = (out ^ (out >> np.uint64(29))) * MIX
    return out ^ (out >> np.uint64(32)), counts


class Order:
    """The order of shingles: by hash, the hot ones (given from the rarest to the commonest) last."""

    def __init__(self, hot: np.ndarray):
        self.ranked = np.asarray(hot, np.int64).view(np.uint64)
        self.by_hash = np.argsort(self.ranked)
        self.known = self.ranked[self.by_hash]

    def first(self, u: np.ndarray) -> np.ndarray:
        """The shingles of a sorted set that are compared first."""
        if len(u) and len(self.known):
            at = np.minimum(np.searchsorted(self.known, u), len(self.known) - 1)
            hot = self.known[at] == u
            if hot.any():
                u = np.concatenate([u[~hot], self.ranked[np.sort(self.by_hash[at[hot]])]])
        return u[: prefix_size(len(u))] if len(u) else u

    def cut(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[pa.Array, ...]:
        """(hash of each text's set, its size, its first shingles, their signature, the bits of the whole set)."""
        keys, sizes, first, bits = [], [], [], []
        ends = np.cumsum(counts)
        for a, b in zip((ends - counts).tolist(), ends.tolist()):
            u = np.unique(hashes[a:b])
            keys.append(int.from_bytes(hashlib.blake2b(u.tobytes(), digest_size=8).digest(), "little", signed=True))
            sizes.append(len(u))
            first.append(self.first(u))
            bits.append(bits_of(u).tobytes())
        flat, n = np.concatenate([np.zeros(0, np.uint64), *first]), np.array([len(u) for u in first], np.int64)
        sign = [x.tobytes() for x in signatures(flat, n)]
        return pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.array(flat.view(np.int64))), pa.array(sign, pa.binary()), pa.array(bits, pa.binary())


def signatures(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For consecutive runs of ``counts`` shingles a row of SIGN bits, a bit for each shingle."""
    at = (shingles * MIX) >> np.uint64(64 - (SIGN - 1).bit_length())
    sign = np.zeros((len(counts), SIGN // 64), np.uint64)
    np.bitwise_or.at(sign, (np.repeat(np.arange(len(counts)), counts), (at >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (at & np.uint64(63)))
    return sign


def bits_of(u: np.ndarray) -> np.ndarray:
    """A set as a table of bits, four or more for each shingle; tables of other sizes are folded to meet."""
    size = max(64, 1 << (PER_SHINGLE * max(1, len(u)) - 1).bit_length())
    at = ((u * BASE) >> np.uint64(20)) & np.uint64(size - 1)
    table = np.zeros(size // 64, np.uint64)
    np.bitwise_or.at(table, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return table


def _folded(x: np.ndarray, size: int) -> np.ndarray:
    return x if len(x) == size else np.bitwise_or.reduce(x.reshape(-1, size), axis=0)


def shared_at_most(x: bytes, y: bytes, nx: int, ny: int) -> int:
    """How many shingles two sets of these sizes can share, by their bits: each shared one has its bit in both, and no
    more of them fall together than shingles of either set do."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    a, b = _folded(a, min(len(a), len(b))), _folded(b, min(len(a), len(b)))
    ones = lambda t: int(np.bitwise_count(t).sum(dtype=np.int64))
    return min(nx, ny, ones(a & b) + min(nx - ones(a), ny - ones(b)))


def hot_shingles(docs: DataFrame, text_col: str, width: int = SHINGLE) -> pa.Table:
    """(h, n): the commonest shingles of a sample and how many of its documents have them, the rarest first; at most
    HOT_ROWS are collected."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b, 0, SLICE_BYTES)):
            hashes, counts = shingled(batch.column(0), width)
            by_text = np.unique(np.column_stack([np.repeat(np.arange(len(counts)).astype(np.uint64), counts), hashes]), axis=0)[:, 1] if len(hashes) else hashes
            h, n = np.unique(by_text, return_counts=True)
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], names=["h", "n"])

    some = docs.where(F.pmod(F.xxhash64(text_col), F.lit(SAMPLE)) == 0).select(text_col).mapInArrow(count, "h bigint, n bigint")
    found = some.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT).orderBy(F.desc("n"), "h").limit(HOT_ROWS).toArrow()
    return found.take(pa.array(np.arange(len(found))[::-1].copy()))


# --- pairs ----------------------------------------------------------------------------------------------------------


def _whole_cells(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Batches sorted by their first ``keys`` columns -> columns that hold the rows of equal keys together; the rows of
    one key wait at most."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        if all(held[0][k][0] == held[-1][k][-1] for k in range(keys)):
            continue
        cols = [np.concatenate(c) for c in zip(*held)]
        cut = int(np.flatnonzero(np.any([c != c[-1] for c in cols[:keys]], axis=0))[-1]) + 1
        yield [c[:cut] for c in cols]
        held = [[c[cut:] for c in cols]]
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def _runs(*cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin and end."""
    starts = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cell], axis=0)]))
    return starts, np.append(starts[1:], len(cell[0]))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, salt, salts, pos, key, n) sorted by h, salt, key -> (cell, pos, key, n, a, na): the sets of cells of two
    or more, with the smallest, which comes first. One row waits, as it may be alone in its cell."""
    held, goes_on, head = None, False, (0, 0)

    def rows(cols: list[np.ndarray], a: np.ndarray, na: np.ndarray, keep: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c[keep], pa.int64()) for c in (cols[0], cols[3], cols[4], cols[5], a, na)], names=["cell", "pos", "key", "n", "a", "na"])

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
        if held is not None:
            cols = [np.concatenate(c) for c in zip(held, cols)]
        new = np.concatenate([[not goes_on], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])])
        at = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
        a, na = (np.where(at < 0, was, c[at]) for was, c in zip(head, (cols[4], cols[5])))
        keep = ~new | np.append(~new[1:], False) | (cols[2] > 1)
        keep[-1] = False
        yield rows(cols, a, na, keep)
        held, goes_on, head = [c[-1:] for c in cols], not new[-1], (a[-1], na[-1])
    if held is not None and (goes_on or held[2][0] > 1):
        yield rows(held, np.array(head[:1]), np.array(head[1:]), np.array([True]))


def meet_at_first(classes: DataFrame, hot: pa.Table) -> DataFrame:
    """(cell, pos, key, n, a, na): the sets that share a first shingle, the cell, with its place among their first ones
    and with the smallest set of the cell, or of the cell's part if the shingle is hot."""
    spark = classes.sparkSession
    placed = classes.select(F.posexplode("first").alias("pos", "h"), "key", "n")
    salts = -(-hot.column("n").to_numpy() * SAMPLE // SALT_ROWS)
    many = [(int(h), int(k)) for h, k in zip(hot.column("h").to_numpy()[salts > 1], salts[salts > 1])]  # of HOT_ROWS at most
    placed = placed.join(F.broadcast(spark.createDataFrame(many, "h bigint, salts bigint")), "h", "left") if many else placed.withColumn("salts", F.lit(None).cast("long"))
    placed = placed.select("h", F.pmod(F.xxhash64("key"), F.coalesce("salts", F.lit(1))).alias("salt"), F.coalesce("salts", F.lit(1)).alias("salts"), "pos", "key", "n")
    n = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return settle(placed.repartition(n, "h", "salt").sortWithinPartitions("h", "salt", "key").mapInArrow(_meet, "cell bigint, pos bigint, key bigint, n bigint, a bigint, na bigint"))


def stars(members: DataFrame) -> DataFrame:
    """(a, b, na, nb): of each cell the pairs with its smallest set."""
    return members.where("key <> a").select("a", F.col("key").alias("b"), "na", F.col("n").alias("nb"))


def _rest(n):
    """How many of ``n`` shingles aren't among the first."""
    return (PART * n + WHOLE - 1) // WHOLE - 1


def _squares(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]]:
    """Rows (cell, across, down, side, key, pos, n, root, minor, ...) sorted by the first three -> of each square its
    columns and the pairs of a row of side 0, all of which are minor, and one of side 1 that are apart and that sizes and
    places allow. A row of side 2 is on both sides."""

    def pairs(side, key, pos, n, root, minor) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        left = n - pos
        x, y = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        step = max(1, 1_000_000 // max(1, len(y)))
        for i in range(0, len(x), step):
            u = x[i : i + step, None]
            could = (root[u] != root[y]) & ((minor[y] == 0) | (key[u] < key[y])) & enough(np.minimum(left[u], left[y]), n[u] + n[y])
            p, q = np.nonzero(could)
            yield x[p + i], y[q]

    for cols in _whole_cells(batches, 3):
        for s, e in zip(*_runs(*cols[:3])):
            square = [c[s:e] for c in cols]
            yield square, pairs(*square[3:9])


def _signed(square: list[np.ndarray], pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs that may be similar by the signatures of their first shingles."""
    n = square[6]
    sign = np.frombuffer(b"".join(square[9]), np.uint64).reshape(len(n), -1)
    slack = prefix_size(n) - np.bitwise_count(sign).sum(axis=1, dtype=np.int64)
    for p, q in pairs:
        both = np.zeros(len(p), np.int64)
        for w in range(sign.shape[1]):
            both += np.bitwise_count(sign[p, w] & sign[q, w])
        most = np.minimum(both + np.minimum(slack[p], slack[q]) + np.maximum(_rest(n[p]), _rest(n[q])), np.minimum(n[p], n[q]))
        ok = enough(most, n[p] + n[q])
        yield p[ok], q[ok]


def _whole(square: list[np.ndarray], pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs that may be similar by the bits of their whole sets, as ``shared_at_most`` has them, many at once."""
    n, bits = square[6], [np.frombuffer(x, np.uint64) for x in square[10]]
    widths = np.array([len(x) for x in bits])
    made: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def folded(width: int) -> tuple[np.ndarray, np.ndarray]:
        """The tables of at least this width, a row a word, and the places of their sets."""
        if width not in made:
            rows = np.flatnonzero(widths >= width)
            made[width] = np.ascontiguousarray(np.stack([_folded(bits[r], width) for r in rows]).T), rows
        return made[width]

    for p, q in pairs:
        ok, each = np.zeros(len(p), bool), np.minimum(widths[p], widths[q])
        for width in np.unique(each).tolist():
            table, rows = folded(width)
            mine = np.flatnonzero(each == width)
            x, y = p[mine], q[mine]
            a, b = np.searchsorted(rows, x), np.searchsorted(rows, y)
            both = np.zeros(len(mine), np.int64)
            for word in table:
                both += np.bitwise_count(word[a] & word[b])
            slack = n[rows] - np.bitwise_count(table).sum(axis=0, dtype=np.int64)
            ok[mine] = enough(np.minimum(both + np.minimum(slack[a], slack[b]), np.minimum(n[x], n[y])), n[x] + n[y])
        yield p[ok], q[ok]


def _touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Squares with signatures -> (cell, key, pos, n, root): the sets of each that are in a pair that may be similar."""
    for square, pairs in _squares(batches):
        found = np.zeros(len(square[0]), bool)
        for p, q in _signed(square, pairs):
            found[p] = found[q] = True
        if found.any():
            yield pa.record_batch([pa.array(square[k][found]) for k in (0, 4, 5, 6, 7)], names=["cell", "key", "pos", "n", "root"])


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Squares with signatures, or these and the bits of whole sets -> (a, b, ra, rb): the pairs that may be similar by
    them, with their roots."""
    for square, pairs in _squares(batches):
        key, root, pairs = square[4], square[7], _signed(square, pairs)
        for p, q in _whole(square, pairs) if len(square) > 10 else pairs:
            if len(p):
                p, q = np.where(key[p] < key[q], p, q), np.where(key[p] < key[q], q, p)
                yield pa.record_batch([pa.array(x) for x in (key[p], key[q], root[p], root[q])], names=["a", "b", "ra", "rb"])


def _dealt(at: DataFrame, tables: DataFrame) -> DataFrame:
    """(cell, across, down, side, key, pos, n, root, minor, ...): the rows (cell, key, pos, n, root) of cells with two
    roots or more, dealt to squares, with the other columns of ``tables`` (key, ...)."""
    # The smaller set of a pair has, at the first shared shingle, at least 8 of 9 of its shingles left.
    small = WHOLE * (F.col("n") - F.col("pos")) + PART * (F.col("n") - F.col("pos")) >= 2 * PART * F.col("n")
    each = at.groupBy("cell", "root").agg(F.count(F.lit(1)).alias("rows"), F.count_if(small).alias("small"))
    mixed = each.groupBy("cell").agg(F.max(F.struct("rows", "root")).alias("major"), F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("roots"), F.sum("small").alias("small")).where("roots > 1 and small > 0")
    squares = lambda n: F.ceil(n / BLOCK).cast("long")
    sides = mixed.select("cell", F.col("major.root").alias("major"), squares(F.col("rows") - F.col("major.rows")).alias("n_across"), squares(F.col("rows")).alias("n_down"))
    rows = at.join(sides, "cell").join(tables, "key").withColumn("minor", F.col("root") != F.col("major"))
    own = lambda n: F.pmod(F.xxhash64("key"), F.col(n))
    part = lambda side, across, down: F.struct(side.alias("side"), across.alias("across"), down.alias("down"))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    base = F.when(F.col("minor"), F.transform(F.filter(every("n_down"), lambda d: d != own("n_down")), lambda d: part(F.lit(0), own("n_across"), d))).otherwise(F.array().cast("array<struct<side:int,across:bigint,down:bigint>>"))
    both = lambda a: F.when(F.col("minor") & (a == own("n_across")), 2).otherwise(1)
    dealt = rows.withColumn("t", F.explode(F.concat(base, F.transform(every("n_across"), lambda a: part(both(a), a, own("n_down"))))))
    n = max(12, int(at.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt.select("cell", "t.across", "t.down", F.col("t.side").cast("long").alias("side"), "key", "pos", "n", "root", F.col("minor").cast("long").alias("minor"), *tables.drop("key").columns)
    by = ["cell", "across", "down"]
    return dealt.repartition(n, *by).sortWithinPartitions(*by)


def apart(members: DataFrame, roots: DataFrame, signs: DataFrame, bits: DataFrame | None = None) -> DataFrame:
    """(a, b, ra, rb): pairs that ``roots`` (node, root) doesn't connect and that may be similar, with their roots.
    ``signs`` (key, sign).

    With ``bits`` (key, bits) the signatures first tell which sets of a cell are in such a pair, a row a set; these are
    dealt to squares once more, and given out are the pairs that the bits of the whole sets leave, too. So what is written
    grows with the sets and with the pairs that are nearly similar, not with all that a cell has."""
    at = settle(members.join(roots, members["key"] == roots["node"], "left").select("cell", "key", "pos", "n", F.coalesce("root", "key").alias("root")))
    if bits is not None:
        at = settle(_dealt(at, signs).mapInArrow(_touched, "cell bigint, key bigint, pos bigint, n bigint, root bigint").distinct())
        signs = signs.join(bits, "key")
    return _dealt(at, signs).mapInArrow(_apart, "a bigint, b bigint, ra bigint, rb bigint").distinct()


def one_a_root(found: DataFrame) -> DataFrame:
    """(a, b): of the pairs between the same two roots the smallest."""
    return found.groupBy("ra", "rb").agg(F.min(F.struct("a", "b")).alias("m")).select("m.a", "m.b")


def still_apart(found: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b): the pairs whose roots aren't connected by ``roots`` (node, root) now."""
    between = found.select("ra", "rb").distinct().join(roots.toDF("ra", "now_a"), "ra", "left").join(roots.toDF("rb", "now_b"), "rb", "left")
    open_ = between.where(F.coalesce("now_a", "ra") != F.coalesce("now_b", "rb")).select("ra", "rb")
    return found.join(open_, ["ra", "rb"], "left_semi").select("a", "b")


def likely(pairs: DataFrame) -> DataFrame:
    """(a, b, na, nb): the pairs that share enough of their first shingles; a row of ``pairs`` is one shared shingle."""
    n = pairs.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.count(F.lit(1)).alias("c"))
    rest = lambda x: (PART * F.col(x) + WHOLE - 1 - (PART * F.col(x) + WHOLE - 1) % WHOLE) / WHOLE - 1
    most = F.least(F.col("c") + F.greatest(rest("na"), rest("nb")), "na", "nb")
    return n.where(enough(most, F.col("na") + F.col("nb"))).drop("c")


# --- verification ---------------------------------------------------------------------------------------------------


@dataclass
class Texts:
    """Where sets come from: ``keys`` (key, text_key, id) has one row of each."""

    docs: DataFrame
    id_col: str
    text_col: str
    width: int
    keys: DataFrame

    def sets(self, named: DataFrame) -> DataFrame:
        """(key, s): the whole sets of the keys in ``named``, made again from the texts."""
        width = self.width

        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (x for b in batches for x in slices(b, 1, SLICE_BYTES)):
                hashes, counts = shingled(batch.column(1), width)
                ends = np.cumsum(counts)
                each = [np.unique(hashes[a:b]).view(np.int64) for a, b in zip((ends - counts).tolist(), ends.tolist())]
                flat = np.concatenate([np.zeros(0, np.int64), *each])
                yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, each)]), pa.int32()), pa.array(flat))], names=["key", "s"])

        wanted = settle(named.distinct().join(self.keys, "key").select("key", "text_key", F.col("id").alias("wanted_id")))
        few = wanted.limit(10 * BROADCAST_ROWS + 1).count() <= 10 * BROADCAST_ROWS  # three short values a row
        rows = self.docs.select(F.xxhash64(self.text_col).alias("text_key"), F.col(self.id_col).alias("id"), F.col(self.text_col).alias("text"))
        # Of a group of copies the one row is taken; only rows that are repeated as a whole come more than once.
        found = rows.join(F.broadcast(wanted) if few else wanted, (rows["text_key"] == wanted["text_key"]) & rows["id"].eqNullSafe(wanted["wanted_id"]))
        return found.select("key", "text").mapInArrow(make, "key bigint, s array<bigint>").dropDuplicates(["key"])


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (a, b, na, nb, xa, xb) -> (a, b) of the pairs that their bits leave."""
    for batch in batches:
        na, nb, xa, xb = (batch.column(k).to_pylist() for k in range(2, 6))
        ok = [bool(enough(shared_at_most(x, y, n, m), n + m)) for x, y, n, m in zip(xa, xb, na, nb)]
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def possible(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """(a, b): the pairs that may be similar by the bits of their whole sets. ``bits`` (key, n, bits)."""
    both = pairs.select("a", "b").join(bits.toDF("a", "na", "xa"), "a").join(bits.toDF("b", "nb", "xb"), "b")
    return both.select("a", "b", "na", "nb", "xa", "xb").mapInArrow(_possible, "a bigint, b bigint")


def verified(pairs: DataFrame, texts: Texts) -> DataFrame:
    """(a, b): the pairs whose whole sets are similar."""
    sets = settle(texts.sets(pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key")))))
    both = pairs.select("a", "b").join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    return both.where(enough(F.size(F.array_intersect("sa", "sb")), F.size("sa") + F.size("sb"))).select("a", "b")
