"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint is cut into two halves of 16 two-bit segments. The bit counts of the segments are a point in a grid, and
the Manhattan distance of two points is a lower bound of the number of differing bits. Two fingerprints that differ in
at most 3 bits are therefore at distance 0 or 1 in one half at least. Each fingerprint goes to its own cell of each
half and to the cells one step up; fingerprints that meet in a cell are verified exactly, 64 bits against 64.

Only distinct fingerprints take part, so exact copies cost one row each. Within a cell a union-find keeps links that
join two different trees: every linked pair ends up connected, but a dense cell doesn't emit all its pairs. Cells with
more than SPLIT fingerprints are cut once more by the exact value of a quarter of the fingerprint (at most 3 differing
bits leave one of four quarters untouched) before they go to a task. The classes are closed under the links by
large-star/small-star rounds on tables in the shared folder; nothing is collected.

Two uses share this: ``near_duplicates`` reports fingerprints and their components, ``one_of_each`` keeps one document
of each component of similar texts. For the second, what the grid links is verified on the sets of shingles, and pairs
whose fingerprints lie further apart than the grid reaches come from ``similar``: at 3 of 64 bits the grid alone finds
42 of 293 pairs at a Jaccard similarity of 0.8 on sf0.1, and no grid of cells covers the 10 to 17 bits in which such
texts differ without comparing a fixed share of all pairs.

Defined cases: texts with one or two words have the whole sequence as their one shingle; null, empty and blank texts
have fingerprint zero and are linked like any other. Repeated rows get equal results. A null doc_id takes part, but is
not the name of a component unless no other id is there. An empty table gives an empty result. Texts are read whole,
whatever their length; other columns aren't read, or in ``one_of_each`` pass through under any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import similar
from .common import free_name, let, lower_az, plain, settle, slices, words
from .links import components

SHINGLE = 3
MAX_BITS = 3
SPLIT = 20_000
TILE = 2_048


def shingle_hashes(text: Column, shingle: int = SHINGLE) -> Column:
    """XXH64 (seed 42) of every shingle of a text, repeats included."""

    def hashed(a: Column) -> Column:
        def one(i: Column) -> Column:
            return F.xxhash64(F.concat_ws(" ", *[F.get(a, i + k) for k in range(shingle)]))

        return (
            F.when(F.size(a) >= shingle, F.transform(F.sequence(F.lit(0), F.size(a) - shingle), one))
            .when(F.size(a) > 0, F.array(F.xxhash64(F.array_join(a, " "))))
            .otherwise(F.array().cast("array<bigint>"))
        )

    return let(words(lower_az(text)), hashed)


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For consecutive runs of ``counts`` hashes the number whose bits are set in over half of the run."""
    out = np.zeros(len(counts), dtype=np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    ends = np.cumsum(counts)
    # Blocks of documents, so that the unpacked bits stay small whatever the batch holds.
    first = 0
    while first < len(full):
        begin = ends[full[first]] - counts[full[first]]
        last = max(first + 1, int(np.searchsorted(ends[full], begin + 200_000, side="right")))
        run = full[first:last]
        part = hashes[begin : ends[run[-1]]]
        starts = ends[run] - counts[run] - begin
        for b in range(64):
            bit = ((part >> np.uint64(b)) & np.uint64(1)).astype(np.int32)
            out[run] |= (np.add.reduceat(bit, starts) * 2 > counts[run]).astype(np.uint64) << np.uint64(b)
        first = last
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(1)
        hashes = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        counts = np.diff(lists.offsets.to_numpy())
        yield pa.record_batch([batch.column(0), pa.array(majority(hashes, counts).view(np.int64))], names=["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) for every row."""
    cut = docs.select(F.col(id_col).alias("id"), shingle_hashes(F.col(text_col)).alias("h"))
    return cut.mapInArrow(_fingerprints, f"id {docs.schema[id_col].dataType.simpleString()}, fp bigint")


def cells(classes: DataFrame) -> DataFrame:
    """(half, cell, up, fp): the own cell of each half, and the cells one step up."""
    halves = F.array(*[F.struct(F.lit(i).alias("half"), v.alias("bits")) for i, v in enumerate((F.col("fp").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("fp", 32)))])
    parts = classes.select("fp", F.explode(halves).alias("x")).select("fp", "x.half", "x.bits")
    # The first step of a parallel bit count gives 16 counts of 0 to 2, two bits each.
    grid = parts.withColumn("cell", F.col("bits").bitwiseAND(0x55555555) + F.shiftrightunsigned("bits", 1).bitwiseAND(0x55555555))
    steps = F.array(F.struct(F.col("cell").alias("cell"), F.lit(False).alias("up")), *[
        F.when(F.shiftrightunsigned("cell", 2 * j).bitwiseAND(3) < 2, F.struct((F.col("cell") + (1 << 2 * j)).alias("cell"), F.lit(True).alias("up"))) for j in range(16)
    ])
    return grid.select("fp", "half", F.explode(F.array_compact(steps)).alias("x")).select("half", "x.cell", "x.up", "fp")


class Forest:
    """Union-find over places of an array."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def spanning_links(own: np.ndarray, other: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Links between ``own`` fingerprints, and of these to ``other`` ones, that differ in at most ``max_bits``; of the
    links in the same component, enough to connect it."""
    every = np.concatenate([own, other])
    forest, links = Forest(len(every)), []
    for i in range(0, len(own), TILE):
        a = own[i : i + TILE]
        for j in range(i, len(every), TILE):
            near = np.bitwise_count(a[:, None] ^ every[None, j : j + TILE]) <= max_bits
            for x, y in zip(*np.nonzero(near)):
                if j + y > i + x and forest.join(i + int(x), j + int(y)):
                    links.append((int(a[x].view(np.int64)), int(every[j + y].view(np.int64))))
    return links


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by cell -> links. A cell may go on in the next batch; no more than one cell waits."""
    names = ["a", "b"]
    held: list[pa.RecordBatch] = []

    def solve(key: np.ndarray, up: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
        ends = np.append(starts[1:], len(key))
        links: list[tuple[int, int]] = []
        bases = np.add.reduceat((~up).astype(np.int64), starts) if len(starts) else starts
        for s, e, n in zip(starts, ends, bases):
            if n and e - s > 1:
                group, raised = fp[s:e], up[s:e]
                links += spanning_links(group[~raised], group[raised])
        return pa.record_batch([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=names)

    def arrays(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t = pa.Table.from_batches(parts)
        col = lambda i: t.column(i).combine_chunks().to_numpy(zero_copy_only=False)
        return np.stack([col(0).astype(np.int64), col(1), col(2)], axis=1), col(3).astype(bool), col(4).view(np.uint64)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        first = [held[0].column(i)[0].as_py() for i in range(3)]
        last = [batch.column(i)[batch.num_rows - 1].as_py() for i in range(3)]
        if first == last:
            continue
        key, up, fp = arrays(held)
        cut = int(np.flatnonzero((key != key[-1]).any(axis=1))[-1]) + 1
        yield solve(key[:cut], up[:cut], fp[:cut])
        whole = pa.Table.from_batches(held).slice(cut).combine_chunks()
        held = whole.to_batches()
    if held:
        yield solve(*arrays(held))


def near_links(classes: DataFrame, max_bits: int = MAX_BITS, split: int = SPLIT) -> DataFrame:
    """(a, b): fingerprints at ``max_bits`` or fewer differing bits; connected as all such pairs are."""
    if max_bits > 3:
        raise ValueError("cells one step apart hold pairs of up to 3 differing bits")
    placed = cells(classes)
    # At least ``split`` rows of distinct fingerprints a hot cell, so there are few; cut those by exact quarters.
    hot = placed.groupBy("half", "cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > split).drop("n").withColumn("hot", F.lit(True))
    quarters = F.array(*[F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF) + i * 65536 for i in range(4)])
    placed = placed.join(hot, ["half", "cell"], "left").withColumn("part", F.explode(F.when(F.col("hot"), quarters).otherwise(F.array(F.lit(-1).cast("long")))))
    by = ["half", "cell", "part"]
    n = max(12, int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return placed.select(F.col("half").cast("long").alias("half"), "cell", "part", "up", "fp").repartition(n, *by).sortWithinPartitions(*by).mapInArrow(_links, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id (the smallest id reachable)."""
    prints = settle(fingerprints(docs, id_col, text_col))
    classes = settle(prints.groupBy("fp").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")))
    links = settle(near_links(classes.select("fp"), max_bits))
    roots = components(links)
    rooted = settle(classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root")))
    known = settle(rooted.join(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("fp", "n", "component_id"))
    # Fingerprints of over a thousandth of the rows are at most a thousand; their rows need not meet in one task.
    total = known.agg(F.sum("n")).first()[0] or 0
    hot = known.where(F.col("n") > max(1000, total / 1000)).select("fp", "component_id")
    cold = known.where(F.col("n") <= max(1000, total / 1000)).select("fp", "component_id")
    out = prints.join(F.broadcast(hot), "fp").unionByName(prints.join(F.broadcast(hot), "fp", "left_anti").join(cold, "fp"))
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def profiles(docs: DataFrame, id_col: str, text_col: str, shingle: int, hot: np.ndarray) -> DataFrame:
    """(id, text_key, key, n, fp, first, sign, bits) of every row: key is a hash of the set of shingles, n its size, fp the
    fingerprint of the shingles, first those that ``similar`` compares first, sign their signature, bits the whole set's."""
    order = similar.Order(hot)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b, 2, similar.SLICE_BYTES)):
            hashes, counts = similar.shingled(batch.column(2), shingle)
            keys, sizes, first, sign, bits = order.cut(hashes, counts)
            yield pa.record_batch([batch.column(0), batch.column(1), keys, sizes, pa.array(majority(hashes, counts).view(np.int64)), first, sign, bits], names=["id", "text_key", "key", "n", "fp", "first", "sign", "bits"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, f"id {docs.schema[id_col].dataType.simpleString()}, text_key bigint, key bigint, n bigint, fp bigint, first array<bigint>, sign binary, bits binary")


def grid_pairs(classes: DataFrame) -> DataFrame:
    """(a, b, na, nb): pairs of sets that the grid proposes. Of sets with one fingerprint each is paired with the
    smallest; those of different fingerprints within reach with each other's smallest."""
    least = settle(classes.groupBy("fp").agg(F.min(F.struct("key", "n")).alias("m")).select("fp", "m.*"))
    same = classes.join(least.toDF("fp", "a", "na"), "fp").where("key <> a").select("a", F.col("key").alias("b"), "na", F.col("n").alias("nb"))
    near = near_links(least.select("fp")).toDF("fa", "fb").join(least.toDF("fa", "a", "na"), "fa").join(least.toDF("fb", "b", "nb"), "fb")
    return same.unionByName(near.select("a", "b", "na", "nb"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = similar.SHINGLE) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component of texts whose sets of shingles are similar.

    Of each component the row with the smallest id stays, null ids last, then the smallest hash of the text; of repeated
    rows one does. The grid's pairs and those of ``similar.stars`` are verified first; what they connect is not looked
    at again, and of the remaining candidates all are verified, so the components are those of all similar pairs."""
    hot = similar.hot_shingles(docs, text_col, shingle)
    rows = settle(profiles(docs, id_col, text_col, shingle, hot.column("h").to_numpy()))
    classes = settle(rows.groupBy("key").agg(F.min(F.struct("text_key", "id")).alias("m"), F.any_value("n").alias("n"), F.any_value("fp").alias("fp"), F.any_value("first").alias("first"), F.any_value("sign").alias("sign"), F.any_value("bits").alias("bits")))
    bits = classes.select("key", "n", "bits")
    source = similar.Texts(docs, id_col, text_col, shingle, classes.select("key", "m.text_key", "m.id"))
    members = similar.meet_at_first(classes, hot)
    first = grid_pairs(classes.select("key", "n", "fp")).unionByName(similar.likely(similar.stars(members)))
    links = settle(similar.verified(settle(similar.possible(first, bits)), source))
    found = settle(similar.apart(members, settle(components(links)), classes.select("key", "sign"), bits.drop("n")))
    links = links.unionByName(settle(similar.verified(settle(similar.one_a_root(found)), source)))
    rest = settle(similar.still_apart(found, settle(components(links))))
    more = settle(similar.verified(rest, source))
    roots = components(links.unionByName(more))
    # One row of each component: its id, the hash of its text, and how many rows are equal to it.
    same = settle(rows.groupBy("id", "text_key").agg(F.any_value("key").alias("key"), F.count(F.lit(1)).alias("copies")))
    named = same.join(roots, same["key"] == roots["node"], "left").groupBy(F.coalesce("root", "key")).agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "text_key", "copies")).alias("m"))
    row, many = free_name(docs, "row"), free_name(docs, "copies")
    row_key = lambda i, t: F.xxhash64(F.coalesce(F.concat(F.lit("="), i.cast("string")), F.lit("null")), t)
    keep = settle(named.select(row_key(F.col("m.id"), F.col("m.text_key")).alias(row), F.col("m.copies").alias(many)))
    stay = docs.withColumn(row, row_key(F.col(id_col), F.xxhash64(text_col))).join(keep.hint("merge"), row)  # the same plan at every size
    once = stay.where(F.col(many) == 1).unionByName(stay.where(F.col(many) > 1).dropDuplicates([row]))
    return once.select(*map(plain, docs.columns))
