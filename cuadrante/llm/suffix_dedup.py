"""Removal of repeated passages by suffix arrays.

A byte goes if some string of SPAN bytes that covers it also starts in a document with a smaller id. The work is done
on whole texts, in four steps:

1. Candidates. Each SPAN-byte string has an anchor: the GRAM-byte substring of the smallest hash. Equal strings have
   equal anchors, so a string can only be repeated if its anchor occurs in two different texts. Anchors go, packed, to
   partitions by their hash; back come the anchors that are repeated.
2. Shards. Consecutive strings with the same repeated anchor are one segment; segments go to parts by the anchor's
   hash, so equal strings meet. There are several parts to a partition, by the size of the text; a part is cut into
   shards by documents, of at most SHARD_BYTES.
3. Suffix arrays. In each shard the suffixes are ordered by Larsson-Sadakane refinement (groups of equal 8, 16, 32 and
   SPAN-byte prefixes, only unsorted groups are sorted again), common prefixes come from Kasai's recurrence, run in
   lockstep lanes, and shards are merged by binary search of one shard's strings in another's suffix array.
4. Bytes. Each document gets its repeated intervals back and is hashed without them.

A passage that very many documents share would bring all its segments to one part. Segments of an anchor with over HOT
occurrences therefore take another way. They come from the same pass over the texts, in batches of HOT_STRINGS strings:
a batch asks once for each string that it has, named by 128 bits of hashes, with the smallest and largest id there. Asks
go to parts by the string's hash, and answers, the smallest id of all, back to the batch, which finds its places by them.
So however many documents share a string, a part sees it once a batch, and what a batch sends has no row a string.

Exact copies of a text with a smaller id go as a whole and take no part in steps 2 and 3.

Defined cases: null is an empty text; texts under SPAN bytes lose nothing; rows with equal doc_ids don't remove each
other's bytes; a null doc_id counts as larger than any other; an empty table gives an empty result. Other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, settle, utf8

SPAN, GRAM = 50, 24
SHARD_BYTES = 2_000_000
BLOCK_BYTES = 2_000_000
STEP = 8_000_000  # a longer text is cut, so that a place in a block fits 24 bits
UNIT_BYTES = 8_000_000  # of text for each part that anchors are dealt to; a task takes its parts one after another
FLUSH_BYTES = 20_000_000
LAST = 2**63 - 1
BASE, MIX, OTHER = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F
#: An anchor with more occurrences is hot: its segments meet in no part, their strings are asked for by hash.
HOT = 50_000
HOT_STRINGS = 500_000  # occurrences of strings in a batch that asks together


# --- anchors -------------------------------------------------------------------------------------------------------


def gram_hashes(data: np.ndarray, width: int, of: int = BASE) -> np.ndarray:
    """A polynomial hash of the ``width`` bytes from each place; built from hashes of powers of two."""
    base = lambda n: np.uint64(pow(of, n, 1 << 64))
    power, size = data.astype(np.uint64) + np.uint64(1), 1
    out, done = None, 0
    while True:
        if width & size:
            out = power if out is None else out[: len(power) - done] * base(size) + power[done:]
            done += size
            if done == width:
                break
        power = power[:-size] * base(size) + power[size:]
        size *= 2
    out = out * np.uint64(MIX)
    return out ^ (out >> np.uint64(32))


def runs_of(block: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first, last, hash) of the runs of strings with the same anchor; ``ends``: of the block's documents.
    Places are those in the block."""
    none = np.zeros(0, np.int64)
    if len(block) < SPAN:
        return none, none, none, none.astype(np.uint64)
    h = gram_hashes(block, GRAM)
    low = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    width, size = SPAN - GRAM + 1, 1
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < width:
        low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
    anchor = (low & np.uint64(0xFFFFFF)).astype(np.int64)
    doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[: len(anchor)]
    valid = np.arange(len(anchor)) + SPAN <= ends[doc]
    at = np.flatnonzero(valid)
    if not len(at):
        return none, none, none, none.astype(np.uint64)
    a = anchor[at]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (at[1:] != at[:-1] + 1) | (doc[at[1:]] != doc[at[:-1]])]))
    last = at[np.append(new[1:], len(at)) - 1]
    return doc[at[new]], at[new], last, h[a[new]] * np.uint64(MIX)


def blocks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about BLOCK_BYTES; a longer text is a range of its own."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > BLOCK_BYTES:
            yield first, i
            first, size = i, 0
        size += len(t)
    if size:
        yield first, len(texts)


def segments(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first, last, hash) of all runs; places are those in the text. Longer texts are cut into overlapping
    blocks, so that a place always fits its 24 bits; a run that a cut divides becomes two with the same anchor."""
    parts = []
    for a, b in blocks(texts):
        step = STEP
        if b == a + 1 and len(texts[a]) > 2 * step:
            for at in range(0, len(texts[a]), step):
                piece = np.frombuffer(texts[a], np.uint8)[at : at + step + SPAN - 1]
                d, f, e, h = runs_of(piece, np.array([len(piece)]))
                parts.append((d + a, f + at, e + at, h))
            continue
        data = np.frombuffer(b"".join(texts[a:b]), np.uint8)
        ends = np.cumsum([len(t) for t in texts[a:b]])
        d, f, e, h = runs_of(data, ends)
        begin = (ends - np.diff(ends, prepend=0))[d]
        parts.append((d + a, f - begin, e - begin, h))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    return tuple(np.concatenate([p[i] for p in parts]) for i in range(4))


def part_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h & np.uint64(0xFFFFFFFF)) % np.uint64(n)).astype(np.int64)


def _row_groups(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[list[list]]:
    """Rows as Python lists by column, flushed at FLUSH_BYTES of text (the last column that holds texts is 2)."""
    held, size = [[] for _ in range(columns)], 0
    for batch in batches:
        for first in range(0, batch.num_rows, 512):
            piece = batch.slice(first, 512)
            for i in range(columns):
                held[i] += piece.column(i).to_pylist()
            size += piece.column(2).nbytes
            if size >= FLUSH_BYTES:
                yield held
                held, size = [[] for _ in range(columns)], 0
    if held[0]:
        yield held


def anchors(n_parts: int):
    """(id, key, data) -> (part, data): packed hashes of anchors, with the documents that they are from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, keys, texts in _row_groups(batches, 3):
            doc, _, _, h = segments(texts)
            part = part_of(h, n_parts)
            order = np.argsort(part, kind="stable")
            begin = _groups(part[order])
            names = part[order[begin]]
            ids, keys = np.array(ids, np.int64), np.array(keys, np.int64)
            blobs = []
            for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(order)]):
                mine = order[a:b]
                d, counts = np.unique(doc[mine], return_counts=True)
                blobs.append(b"".join([np.array([len(d), len(mine)], np.int64).tobytes(), ids[d].tobytes(), keys[d].tobytes(), counts.astype(np.int32).tobytes(), (h[mine] >> np.uint64(32)).astype(np.uint32).tobytes()]))
            yield pa.record_batch([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "data"])

    return run


def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """The values of each part; rows are sorted by part."""
    now, held = None, []
    for batch in batches:
        for p, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            if p != now:
                if held:
                    yield now, held
                now, held = p, []
            held.append(data.as_py())
    if held:
        yield now, held


def _cut(data: bytes, *kinds_and_sizes) -> list[np.ndarray]:
    out, at = [], 0
    for kind, n in kinds_and_sizes:
        out.append(np.frombuffer(data, kind, n, at))
        at += out[-1].nbytes
    return out


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places of runs of ``counts`` items from ``starts``, one after another."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def _groups(a: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    if not len(a):
        return np.zeros(0, np.int64)
    differ = np.zeros(len(a) - 1, bool)
    for x in (a, *more):
        differ |= x[1:] != x[:-1]
    return np.flatnonzero(np.concatenate([[True], differ]))


def to_buckets(ids: np.ndarray, keys: np.ndarray, counts: np.ndarray, flat: np.ndarray, n: int) -> pa.RecordBatch:
    """Numbers of documents (``counts`` of ``flat`` each), packed by a hash of the document: (part, data)."""
    bucket = part_of((ids ^ keys).view(np.uint64) * np.uint64(MIX) >> np.uint64(32), n)
    order = np.argsort(bucket, kind="stable")
    flat = flat[ragged((np.cumsum(counts) - counts)[order], counts[order])]
    ids, keys, counts, bucket = ids[order], keys[order], counts[order], bucket[order]
    begin = _groups(bucket)
    ends = np.concatenate([[0], np.cumsum(counts)])
    blobs = []
    for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(bucket)]):
        own = flat[ends[a] : ends[b]]
        blobs.append(b"".join([np.array([b - a, len(own)], np.int64).tobytes(), ids[a:b].tobytes(), keys[a:b].tobytes(), counts[a:b].astype(np.int32).tobytes(), own.tobytes()]))
    return pa.record_batch([pa.array(bucket[begin], pa.int32()), pa.array(blobs, pa.binary())], names=["part", "data"])


def by_document(kind: type, n_parts: int):
    """(part, data) -> (id, key, data, hot): one row per document, its numbers of ``kind`` one after another; ``hot``: of
    parts from ``n_parts`` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, blobs in by_part(batches):
            cols: list[list[np.ndarray]] = [[] for _ in range(4)]
            for b in blobs:
                n, m = np.frombuffer(b, np.int64, 2)
                for to, x in zip(cols, _cut(b[16:], (np.int64, n), (np.int64, n), (np.int32, n), (kind, m))):
                    to.append(x)
            ids, keys, counts, flat = map(np.concatenate, cols)
            counts = counts.astype(np.int64)
            order = np.lexsort((keys, ids))
            flat = flat[ragged((np.cumsum(counts) - counts)[order], counts[order])]
            i, k = ids[order], keys[order]
            new = _groups(i, k)
            ends = np.concatenate([[0], np.cumsum(np.add.reduceat(counts[order], new))]) * flat.itemsize
            data = pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat)])
            yield pa.record_batch([pa.array(i[new]), pa.array(k[new]), data, pa.array(np.full(len(new), part >= n_parts))], names=["id", "key", "data", "hot"])

    return run


def mark_repeated(n_parts: int):
    """(part, data) -> (part, data): the upper halves of the hashes of each document's anchors that occur in two texts,
    packed for ``by_document``. A half that two anchors of a document share makes one candidate more, never one less.
    Hot anchors go to parts from ``n_parts`` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in by_part(batches):
            usual, hot = _repeated(blobs)
            yield to_buckets(*usual, n_parts)
            if len(hot[0]):
                packed = to_buckets(*hot, n_parts)
                yield pa.record_batch([pc.add(packed.column(0), pa.scalar(n_parts, pa.int32())), packed.column(1)], names=["part", "data"])

    return run


def _repeated(blobs: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, keys, counts, halves) of repeated anchors, then of hot ones."""
    ids, keys, counts, hashes = [], [], [], []
    for b in blobs:
        n, m = np.frombuffer(b, np.int64, 2)
        for to, x in zip((ids, keys, counts, hashes), _cut(b[16:], (np.int64, n), (np.int64, n), (np.int32, n), (np.uint32, m))):
            to.append(x)
    ids, keys, counts, hashes = map(np.concatenate, (ids, keys, counts, hashes))
    doc = np.repeat(np.arange(len(counts)), counts)
    order = np.argsort(hashes, kind="stable")
    h, t = hashes[order], keys[doc[order]]
    starts = _groups(h)
    many = np.minimum.reduceat(t, starts) != np.maximum.reduceat(t, starts)
    sizes = np.diff(np.append(starts, len(h)))
    out = []
    for which in (many & (sizes <= HOT), many & (sizes > HOT)):
        flag = np.zeros(len(h), bool)
        flag[order] = np.repeat(which, sizes)
        found = np.bincount(doc[flag], minlength=len(counts))
        some = found > 0
        out.append((ids[some], keys[some], found[some], hashes[flag]))
    return out


def _named(doc: np.ndarray, h: np.ndarray, marks: list[bytes]) -> np.ndarray:
    """Which segments have an anchor that the marks of their document name."""
    named = np.repeat(np.arange(len(marks)), [len(m) // 4 for m in marks]).astype(np.uint64) << np.uint64(32) | np.frombuffer(b"".join(marks), np.uint32)
    return np.flatnonzero(np.isin(doc.astype(np.uint64) << np.uint64(32) | h >> np.uint64(32), named))


def asks(ids: np.ndarray, keys: np.ndarray, texts: list[bytes], d: np.ndarray, f: np.ndarray, e: np.ndarray, n_parts: int) -> Iterator[pa.RecordBatch]:
    """(part, data): of a batch of segments (document, first, end) each different string once, packed by its hash to parts
    from ``n_parts`` on: two hashes, smallest and largest id, number in the batch. The segments themselves go with the
    numbers of their strings to a part from ``2 * n_parts`` on, where answers come back."""
    contents: dict[bytes, int] = {}  # equal segments are looked at once
    which = np.array([contents.setdefault(texts[i][u:v], len(contents)) for i, u, v in zip(d.tolist(), f.tolist(), e.tolist())], np.int32)
    sizes = np.array([len(c) for c in contents], np.int64)
    data = np.frombuffer(b"".join(contents), np.uint8)
    n = sizes - SPAN + 1  # strings of each content
    at = ragged(np.cumsum(sizes) - sizes, n)
    one, two = (gram_hashes(data, SPAN, base)[at] for base in (BASE, OTHER))
    order = np.argsort(which, kind="stable")
    begin = _groups(which[order])
    low, high = (np.repeat(best.reduceat(ids[d][order], begin), n) for best in (np.minimum, np.maximum))
    order = np.lexsort((two, one))
    begin = _groups(one[order], two[order])
    string = np.empty(len(order), np.int32)
    string[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(order))))
    one, two, low, high = one[order[begin]], two[order[begin]], np.minimum.reduceat(low[order], begin), np.maximum.reduceat(high[order], begin)
    own = b"".join([np.array([len(d), len(n), len(string)], np.int64).tobytes(), ids[d].tobytes(), keys[d].tobytes(), f.astype(np.int64).tobytes(), which.tobytes(), n.astype(np.int32).tobytes(), string.tobytes()])
    batch = int.from_bytes(hashlib.blake2b(own, digest_size=8).digest(), "little", signed=True)  # of contents, so that a task run again names it alike
    part = part_of(one, n_parts)
    order = np.argsort(part, kind="stable")
    begin = _groups(part[order])
    names, blobs = [2 * n_parts + batch % n_parts], [np.array([batch, -1], np.int64).tobytes() + own]
    for i, j in zip(begin.tolist(), [*begin[1:].tolist(), len(order)]):
        x = order[i:j]
        names.append(n_parts + int(part[x[0]]))
        blobs.append(b"".join([np.array([batch, len(x)], np.int64).tobytes(), one[x].tobytes(), two[x].tobytes(), low[x].tobytes(), high[x].tobytes(), x.astype(np.int32).tobytes()]))
    yield pa.record_batch([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "data"])


def cut_segments(n_parts: int):
    """(id, key, data, marks, hot) -> (part, data): the packed segments of repeated anchors, and what hot ones ask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, keys, texts, marks, hot in _row_groups(batches, 5):
            doc, first, last, h = segments(texts)
            mine = _named(doc, h, marks)
            ids, keys, hot = np.array(ids, np.int64), np.array(keys, np.int64), np.array(hot, bool)[doc[mine]]
            if hot.any():
                x = mine[hot]
                n = last[x] - first[x] + 1
                for own in np.split(x, _groups((np.cumsum(n) - n) // HOT_STRINGS)[1:]):
                    yield from asks(ids, keys, texts, doc[own], first[own], last[own] + SPAN, n_parts)
                mine = mine[~hot]
            part = part_of(h[mine], n_parts)
            order = np.lexsort((first[mine], doc[mine], part))
            mine, part = mine[order], part[order]
            begin = _groups(part)
            blobs = []
            for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(mine)]):
                x = mine[a:b]
                d, f, e = doc[x], first[x], last[x] + SPAN
                contents: dict[bytes, int] = {}  # equal segments of these texts are sent once
                which = [contents.setdefault(texts[i][u:v], len(contents)) for i, u, v in zip(d.tolist(), f.tolist(), e.tolist())]
                text = b"".join(contents)
                sizes = np.array([len(x), len(contents), len(text)], np.int64)
                blobs.append(b"".join([sizes.tobytes(), ids[d].tobytes(), keys[d].tobytes(), f.astype(np.int64).tobytes(), np.array(which, np.int32).tobytes(), np.array([len(c) for c in contents], np.int32).tobytes(), text]))
            yield pa.record_batch([pa.array(part[begin], pa.int32()), pa.array(blobs, pa.binary())], names=["part", "data"])

    return run


# --- suffix arrays -------------------------------------------------------------------------------------------------


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as a big-endian number, so that numbers order as strings do; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(SPAN + 8, np.uint8)]).astype(np.uint64)
    n = len(data) + SPAN
    two = padded[:-1] << np.uint64(8) | padded[1:]
    four = two[:-2] << np.uint64(16) | two[2:]
    return (four[:-4] << np.uint64(32) | four[4:])[:n]


def ranks_of(keys: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of sorted keys the place where each group of equal keys begins, by the place of the suffix."""
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(begin, np.diff(np.append(begin, len(order))))
    return out


def suffix_array(words: np.ndarray, n: int, depth: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in the order of their first ``depth`` bytes, rank of each), depth over 8.

    Larsson-Sadakane refinement: suffixes with equal prefixes so far form groups; in each round only groups of two or
    more are sorted again, by the rank of the suffix that begins where the prefix known so far ends."""
    sa = np.argsort(words[:n], kind="stable")
    rank = ranks_of(words[sa], sa)
    known = 8
    while known < depth:
        ahead = min(known, depth - known)
        sizes = np.bincount(rank, minlength=n)
        open_ = np.flatnonzero(sizes[rank[sa]] > 1)
        if not len(open_):
            break
        s = sa[open_]
        nxt = np.where(s + ahead < n, rank[np.minimum(s + ahead, n - 1)] + 1, 0)
        key = rank[s] * np.int64(n + 1) + nxt
        order = np.argsort(key, kind="stable")
        s, key = s[order], key[order]
        sa[open_] = s
        new = np.concatenate([[True], key[1:] != key[:-1]])
        begin = np.flatnonzero(new)
        rank[s] = np.repeat(open_[begin], np.diff(np.append(begin, len(s))))
        known += ahead
    return sa, rank


def common_prefixes(words: np.ndarray, sa: np.ndarray, cap: int = SPAN, lanes: int = 4096) -> np.ndarray:
    """For each place in ``sa`` the common prefix with the suffix before it, up to ``cap``.

    Kasai's recurrence - the suffix one further on shares at least one byte less with its own predecessor - run over
    ``lanes`` stretches of the text at once, eight bytes a comparison. The order ends at ``cap`` bytes, and beyond it the
    recurrence says nothing: after a prefix that reached the cap, counting begins anew."""
    n = len(sa)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(n, np.int64)
    length = -(-n // lanes)
    starts = np.arange(0, n, length)
    l = np.zeros(len(starts), np.int64)
    for step in range(length):
        i = starts + step
        if i[-1] >= n:
            i = i[:-1]
            starts, l = starts[:-1], l[:-1]
            if not len(i):
                break
        j = before[i]
        l = np.where((j >= 0) & (l < cap), np.maximum(l - 1, 0), 0)
        going = np.flatnonzero((j >= 0) & (l < cap))
        while len(going):
            differ = words[i[going] + l[going]] ^ words[j[going] + l[going]]
            # Equal leading bytes: smear the highest set bit down and count.
            for shift in (1, 2, 4, 8, 16, 32):
                differ |= differ >> np.uint64(shift)
            same = (64 - np.bitwise_count(differ).astype(np.int64)) >> 3
            l[going] += same
            going = going[(same == 8) & (l[going] < cap)]
        out[i] = np.minimum(l, cap)
    return out[sa]


class Shard:
    """Distinct strings of a set of segments in order, with the smallest document id of each."""

    def __init__(self, text: np.ndarray, starts: np.ndarray, lens: np.ndarray, low: np.ndarray):
        """Segments lie one after another in ``text``; ``low``: the smallest id of each."""
        self.words = words_at(text)
        n = len(text)
        sa, _ = suffix_array(self.words, n)
        inner = np.ones(n, bool)  # places where a whole string begins
        for k in range(1, SPAN):
            inner[starts + lens - k] = False
        lcp = common_prefixes(self.words, sa)
        keep = inner[sa]
        # Between two kept neighbours the common prefix is the smallest of those passed over.
        group = np.cumsum(np.where(lcp < SPAN, 1, 0))
        places, group = sa[keep], group[keep]
        begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        owner = np.repeat(low, lens)[places]
        self.places = places[begin]
        self.low = np.minimum.reduceat(owner, begin)
        #: The class of the string at each place of the text.
        self.kind = np.full(n, -1, np.int64)
        self.kind[places] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(places))))

    def take_lower(self, other: Shard) -> None:
        """Binary search of the other shard's strings in this one; where a string is in both, both get the lower id."""
        low, high = np.zeros(len(other.places), np.int64), np.full(len(other.places), len(self.places), np.int64)
        offsets = [*range(0, SPAN - 8, 8), SPAN - 8]

        def order(mid: np.ndarray, query: np.ndarray) -> np.ndarray:
            """-1, 0 or 1 as this shard's string is below, equal to or above the query."""
            a, b, out = self.places[mid], other.places[query], np.zeros(len(mid), np.int8)
            todo = np.arange(len(mid))
            for k in offsets:
                x, y = self.words[a[todo] + k], other.words[b[todo] + k]
                out[todo] = np.where(x < y, -1, np.where(x > y, 1, 0))
                todo = todo[x == y]
                if not len(todo):
                    break
            return out

        live = np.flatnonzero(low < high)
        while len(live):
            mid = (low[live] + high[live]) // 2
            below = order(mid, live) < 0
            low[live] = np.where(below, mid + 1, low[live])
            high[live] = np.where(below, high[live], mid)
            live = live[low[live] < high[live]]
        query = np.flatnonzero(low < len(self.places))
        query = query[order(low[query], query) == 0]
        at = low[query]
        best = np.minimum(self.low[at], other.low[query])
        self.low[at], other.low[query] = best, best


def distinct(text: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one segment of each content, the content of every segment)."""
    width = -(-int(lens.max()) // 8) * 8
    rows = np.zeros((len(starts), width), np.uint8)
    for k in range(width):
        has = np.flatnonzero(lens > k)
        rows[has, k] = text[starts[has] + k]
    w = rows.view(np.uint64)
    h = lens.astype(np.uint64)
    for k in range(w.shape[1]):
        h = (h ^ w[:, k]) * np.uint64(MIX)
        h ^= h >> np.uint64(29)
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    if not ((w[first][inverse] == w).all() and (lens[first][inverse] == lens).all()):
        _, first, inverse = np.unique(np.column_stack([w, lens.astype(np.uint64)]), axis=0, return_index=True, return_inverse=True)
    return first, inverse.reshape(-1)


def repeated_places(ids: np.ndarray, firsts: np.ndarray, which: np.ndarray, sizes: np.ndarray, text: np.ndarray, shard_bytes: int = SHARD_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(segment, place in its document) of every string that also starts in a document with a smaller id. ``which``: the
    content of each segment; contents of ``sizes`` bytes lie one after another in ``text``."""
    starts = np.cumsum(sizes) - sizes
    rep, same = distinct(text, starts, sizes)
    kind, lens = same[which], sizes[which]
    order = np.argsort(kind, kind="stable")
    begin = np.searchsorted(kind[order], np.arange(len(rep)))
    low = np.minimum.reduceat(ids[order], begin)
    rep_lens = sizes[rep]
    # Shards by documents: contents in the order of their smallest id.
    by_doc = np.argsort(low, kind="stable")
    shard_of = np.empty(len(rep), np.int64)
    shard_of[by_doc] = (np.cumsum(rep_lens[by_doc]) - rep_lens[by_doc]) // shard_bytes
    shards, offset = [], np.zeros(len(rep), np.int64)
    for s in range(int(shard_of.max()) + 1):
        mine = np.flatnonzero(shard_of == s)
        if not len(mine):
            continue
        own_lens = rep_lens[mine]
        own_starts = np.cumsum(own_lens) - own_lens
        gather = np.repeat(starts[rep[mine]] - own_starts, own_lens) + np.arange(own_lens.sum())
        shards.append((mine, Shard(text[gather], own_starts, own_lens, low[mine])))
        offset[mine] = own_starts
    # The last shard with a string learns the lowest id from the first one, and the others from the last.
    for i in range(len(shards)):
        for j in range(i + 1, len(shards)):
            shards[i][1].take_lower(shards[j][1])
    out_seg, out_place = [], []
    for mine, shard in shards:
        seg = np.flatnonzero(np.isin(kind, mine)) if len(shards) > 1 else np.arange(len(lens))
        n = lens[seg] - SPAN + 1
        each = np.repeat(seg, n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        hit = shard.low[shard.kind[offset[kind[each]] + inside]] < ids[each]
        out_seg.append(each[hit])
        out_place.append(firsts[each[hit]] + inside[hit])
    return np.concatenate(out_seg), np.concatenate(out_place)


def merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals as maximal runs, in order; touching ones become one."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]])) if len(s) else np.zeros(0, np.int64)
    return s[new], e[np.append(new[1:], len(s)) - 1] if len(s) else e


def find_intervals(n_parts: int):
    """(part, data) -> (part, data): documents' repeated intervals in a part, packed for ``by_document``, two numbers a
    run; of parts from ``n_parts`` on answers to asks, and what waits for these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, blobs in by_part(batches):
            if part < n_parts:
                yield to_buckets(*_intervals(blobs), n_parts)
            elif part < 2 * n_parts:
                yield _answers(blobs, n_parts)
            else:
                for x in blobs:
                    yield pa.record_batch([pa.array([part], pa.int32()), pa.array([x], pa.binary())], names=["part", "data"])

    return run


def _answers(blobs: list[bytes], n_parts: int) -> pa.RecordBatch:
    """(part, data): to each batch the smallest id of its strings, where an id there is larger."""
    heads, cols = [], [[] for _ in range(5)]
    for b in blobs:
        batch, m = np.frombuffer(b, np.int64, 2).tolist()
        heads.append((batch, m))
        for to, x in zip(cols, _cut(b[16:], (np.uint64, m), (np.uint64, m), (np.int64, m), (np.int64, m), (np.int32, m))):
            to.append(x)
    one, two, low, high, number = map(np.concatenate, cols)
    order = np.lexsort((two, one))
    begin = _groups(one[order], two[order])
    least = np.empty(len(order), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(low[order], begin), np.diff(np.append(begin, len(order))))
    names, out, at = [], [], 0
    for batch, m in heads:
        x = at + np.flatnonzero(least[at : at + m] < high[at : at + m])
        at += m
        if len(x):
            names.append(2 * n_parts + batch % n_parts)
            out.append(b"".join([np.array([batch, len(x)], np.int64).tobytes(), least[x].tobytes(), number[x].tobytes()]))
    return pa.record_batch([pa.array(names, pa.int32()), pa.array(out, pa.binary())], names=["part", "data"])


def read_answers(n_parts: int):
    """(part, data) -> (part, data): the repeated intervals of batches that asked, packed for ``by_document``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in by_part(batches):
            asked: list[tuple[int, bytes]] = []
            told: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
            for b in blobs:
                batch, m = np.frombuffer(b, np.int64, 2).tolist()
                if m < 0:
                    asked.append((batch, b[16:]))
                else:
                    told.setdefault(batch, []).append(_cut(b[16:], (np.int64, m), (np.int32, m)))
            for batch, own in asked:
                if batch in told:
                    yield to_buckets(*_understood(own, told[batch]), n_parts)

    return run


def _understood(own: bytes, answers: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, k, m = np.frombuffer(own, np.int64, 3)
    ids, keys, firsts, which, counts, string = _cut(own[24:], (np.int64, n), (np.int64, n), (np.int64, n), (np.int32, n), (np.int32, k), (np.int32, m))
    low = np.full(int(string.max()) + 1, LAST)
    for least, number in answers:
        low[number] = least
    counts = counts.astype(np.int64)
    each = np.repeat(np.arange(n), counts[which])
    hit = low[string[ragged((np.cumsum(counts) - counts)[which], counts[which])]] < ids[each]
    return _runs(ids, keys, each[hit], ragged(firsts, counts[which])[hit])


def _intervals(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    cols: list[list[np.ndarray]] = [[] for _ in range(6)]
    before = 0
    while blobs:  # each is let go once it is read
        b = blobs.pop(0)
        n, k, m = np.frombuffer(b, np.int64, 3)
        for to, x in zip(cols, _cut(b[24:], (np.int64, n), (np.int64, n), (np.int64, n), (np.int32, n), (np.int32, k), (np.uint8, m))):
            to.append(x)
        cols[3][-1] = cols[3][-1] + np.int64(before)
        before += k
    ids, keys, firsts, which, sizes, text = map(np.concatenate, cols)
    return _runs(ids, keys, *repeated_places(ids, firsts, which, sizes.astype(np.int64), text))


def _runs(ids: np.ndarray, keys: np.ndarray, seg: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(id, key, numbers, flat): of each document the maximal runs of repeated strings, by their segments and places."""
    order = np.lexsort((place, keys[seg], ids[seg]))
    i, k, place = ids[seg[order]], keys[seg[order]], place[order]
    # Maximal runs of a document: a place goes on with a run if its string begins where the one before ends, or sooner.
    apart = np.ones(len(place), bool)
    apart[1:] = (place[1:] > place[:-1] + SPAN) | (i[1:] != i[:-1]) | (k[1:] != k[:-1])
    begin = np.flatnonzero(apart)
    runs = np.column_stack([place[begin], place[np.append(begin[1:], len(place))[: len(begin)] - 1] + SPAN]).astype(np.int64)
    i, k = i[begin], k[begin]
    new = _groups(i, k)
    return i[new], k[new], 2 * np.diff(np.append(new, len(i))), runs.reshape(-1)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, key, data, copy, spans) -> the result's rows."""
    for batch in batches:
        rows = []
        for i, data, copy, spans in zip(batch.column(0), batch.column(2), *[batch.column(c).to_pylist() for c in (3, 4)]):
            text, name = data.as_py(), i.as_py()
            if copy and len(text) >= SPAN:
                kept, n = b"", 1
            elif spans:
                pairs = np.frombuffer(spans, np.int64).reshape(-1, 2)
                s, e = (x.tolist() for x in merge(pairs[:, 0], pairs[:, 1]))
                kept, n = b"".join([text[a:b] for a, b in zip([0, *e], [*s, len(text)])]), len(s)
            else:
                kept, n = text, 0
            rows.append((None if name == LAST else name, len(text), len(text) - len(kept), n, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.record_batch([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256 and kept_text (where a removal cuts a
    character of several bytes, kept_text has a replacement mark; the hash is of the bytes)."""
    spark = docs.sparkSession
    n = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    units = parts(docs, text_col, UNIT_BYTES)
    data = utf8(F.col(text_col))
    sha = F.sha2(data, 256)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(F.substring(sha, 1, 32), F.substring(sha, 33, 32)).alias("key"), data.alias("data"))
    # Exact copies: texts that a smaller id has, too. A text of over a thousandth of the rows is one of a thousand.
    names = settle(docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.unhex(sha).alias("sha"), F.xxhash64(F.substring(sha, 1, 32), F.substring(sha, 33, 32)).alias("key")))
    groups = settle(names.groupBy("sha").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    limit = max(1000, names.count() / 1000)
    hot, cold = groups.where(F.col("n") > limit), groups.where(F.col("n") <= limit)
    later = names.join(F.broadcast(hot), "sha").unionByName(names.join(F.broadcast(hot), "sha", "left_anti").join(cold, "sha")).where("id > low")
    copies = settle(later.select("id", "key").distinct().withColumn("copy", F.lit(True)))

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(n, "part").sortWithinPartitions("part")

    blob, row = "part int, data binary", "id bigint, key bigint, data binary, hot boolean"
    marks = dealt(rows.mapInArrow(anchors(units), blob)).mapInArrow(mark_repeated(units), blob)
    masks = settle(dealt(marks).mapInArrow(by_document(np.uint32, units), row)).withColumnRenamed("data", "masks").join(copies, ["id", "key"], "left_anti")
    named = rows.join(masks, ["id", "key"]).select("id", "key", "data", "masks", "hot")  # texts are moved once for both ways
    spans = settle(dealt(named.mapInArrow(cut_segments(units), blob)).mapInArrow(find_intervals(units), blob))
    found = spans.where(F.col("part") < units)
    if not masks.where("hot").isEmpty():
        found = found.unionByName(dealt(spans.where(F.col("part") >= units)).mapInArrow(read_answers(units), blob))
    by_doc = settle(dealt(found).mapInArrow(by_document(np.int64, units), row).select("id", "key", F.col("data").alias("spans")))
    last = rows.join(by_doc, ["id", "key"], "left").join(copies, ["id", "key"], "left").select("id", "key", "data", F.coalesce("copy", F.lit(False)).alias("copy"), "spans")
    out = last.mapInArrow(_finish, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept_text string")
    return out.withColumnRenamed("id", id_col)
