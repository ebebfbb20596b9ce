"""Token counts that follow edits.

A document's pre-tokens stand in the leaves of a segment tree: each leaf holds a run of them with their lengths and
token counts, each inner node the sums of its subtree. As byte-pair merges never cross a pre-token, the count of a text
is the sum of its pre-tokens' counts. An edit descends to the first pre-token whose match it can change, re-reads the
text from there, and stops as soon as it stands on an old boundary behind the edit: what follows is as it was. Only the
re-read pre-tokens are encoded, and only the sums above their leaves are renewed.

Defined cases: a null text is empty and has no tokens; edits outside a text are clipped to it; repeated rows are counted
one by one; very long pre-tokens are encoded whole; an empty table gives an empty result; other columns are not read.
Trees can be kept as a table (``build_trees``) and edited later (``apply_edits``): a later edit encodes no more than an
edit at once.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = 64
CACHE = 400_000
REACH = 2


class Counter:
    """Token counts of pre-tokens by a rank file of tiktoken's form, with a bounded cache."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            n = self.known[piece] = len(self.encoding.encode_ordinary(piece))
        return n


class CountTree:
    """A text, its pre-tokens and the sums over them."""

    def __init__(self, text: str, counter: Counter):
        self.text, self.counter, self.reencoded = text, counter, 0
        pieces = counter.pattern.findall(text)
        lens, counts = list(map(len, pieces)), list(map(counter.count, pieces))
        self.leaves = [(lens[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(pieces), LEAF)]
        self._build()

    def _build(self) -> None:
        self.size = 1
        while self.size < max(1, len(self.leaves)):
            self.size *= 2
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, (lens, counts) in enumerate(self.leaves):
            self.chars[self.size + i], self.tokens[self.size + i] = sum(lens), sum(counts)
        for i in range(self.size - 1, 0, -1):
            self._renew(i)

    def _renew(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_pieces(self) -> int:
        return sum(len(x[0]) for x in self.leaves)

    def tokens_before(self, place: int) -> int:
        """Tokens of the pre-tokens that end at or before a place."""
        leaf, at, total = self._descend(place + 1)
        if leaf >= len(self.leaves):
            return self.n_tokens
        for n, c in zip(*self.leaves[leaf]):
            at += n
            if at > place:
                break
            total += c
        return total

    def _descend(self, place: int) -> tuple[int, int, int]:
        """The first leaf that ends at ``place`` or later, with the characters and tokens before it."""
        if self.chars[1] < place:
            return len(self.leaves), self.chars[1], self.tokens[1]
        i, chars, tokens = 1, 0, 0
        while i < self.size:
            i *= 2
            if chars + self.chars[i] < place:
                chars, tokens = chars + self.chars[i], tokens + self.tokens[i]
                i += 1
        return i - self.size, chars, tokens

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace text[start:end] by ``new``."""
        start = min(max(start, 0), len(self.text))
        end = min(max(end, start), len(self.text))
        shift = len(new) - (end - start)
        self.text = self.text[:start] + new + self.text[end:]
        if not self.leaves:
            fresh = CountTree(self.text, self.counter)
            self.leaves, self.reencoded = fresh.leaves, self.reencoded + fresh.n_pieces
            self._build()
            return
        # A match depends on up to REACH characters beyond its end (contractions, the last space of a run).
        near = start + 1 - REACH
        leaf, at, _ = self._descend(near)
        leaf = min(leaf, len(self.leaves) - 1)
        at = at if leaf < len(self.leaves) and at < self.chars[1] else self.chars[1] - self.chars[self.size + leaf]
        first, lens = 0, self.leaves[leaf][0]
        while first < len(lens) - 1 and at + lens[first] < near:
            at += lens[first]
            first += 1
        old_leaf, old_i, old = leaf, first, at  # the old boundary that the scan is compared with
        pieces: list[tuple[int, int]] = []
        place = at
        while True:
            while old_leaf < len(self.leaves) and (old < end or old + shift < place):
                old += self.leaves[old_leaf][0][old_i]
                old_i += 1
                if old_i == len(self.leaves[old_leaf][0]):
                    old_leaf, old_i = old_leaf + 1, 0
            if old >= end and old + shift == place and (pieces or start == end == place and not new):
                break
            m = self.counter.pattern.match(self.text, place)
            if not m or m.end() == place:
                break
            pieces.append((m.end() - place, self.counter.count(m.group())))
            place = m.end()
        self.reencoded += len(pieces)
        head = list(zip(*self.leaves[leaf]))[:first]
        tail = list(zip(*self.leaves[old_leaf]))[old_i:] if old_leaf < len(self.leaves) else []
        joined = head + pieces + tail
        last = min(old_leaf, len(self.leaves) - 1)
        spread = [joined[i : i + LEAF] for i in range(0, len(joined), LEAF)]
        if last == leaf and len(spread) == 1 or len(spread) == last - leaf + 1:
            for i, part in enumerate(spread):
                self.leaves[leaf + i] = ([x[0] for x in part], [x[1] for x in part])
                node = self.size + leaf + i
                self.chars[node], self.tokens[node] = sum(self.leaves[leaf + i][0]), sum(self.leaves[leaf + i][1])
                while node > 1:
                    node //= 2
                    self._renew(node)
        else:
            self.leaves[leaf : last + 1] = [([x[0] for x in p], [x[1] for x in p]) for p in spread]
            self._build()


TREES = "n_tokens bigint, lens array<int>, counts array<int>"


def _stored(tree: CountTree) -> tuple[int, list[int], list[int]]:
    """What a tree is made of: pre-tokens' lengths and token counts in order."""
    return tree.n_tokens, [n for lens, _ in tree.leaves for n in lens], [c for _, counts in tree.leaves for c in counts]


def _revived(text: str, lens: list[int], counts: list[int], counter: Counter) -> CountTree:
    """A tree from what was stored of it; nothing is encoded."""
    tree = CountTree.__new__(CountTree)
    tree.text, tree.counter, tree.reencoded = text, counter, 0
    tree.leaves = [(lens[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(lens), LEAF)]
    tree._build()
    return tree


def build_trees(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_tokens, lens, counts): the leaves of each document's tree, to be kept as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path, pattern)
        for batch in batches:
            rows = [_stored(CountTree(x.as_py() or "", counter)) for x in batch.column(1)]
            yield _tree_batch(batch.column(0), batch.column(1), rows)

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, text string, {TREES}")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("text", text_col)


def _tree_batch(ids: pa.Array, texts: pa.Array, rows: list[tuple], *more: pa.Array) -> pa.RecordBatch:
    own = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.list_(pa.int32()))]
    return pa.record_batch([ids, texts, *own, *more], names=["id", "text", "n_tokens", "lens", "counts", *["n_reencoded"][: len(more)]])


def apply_edits(trees: DataFrame, edits: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Trees after ``edits`` (id, seq, start, end, new), with n_reencoded, the pre-tokens that had to be encoded.

    Edits of a document apply in the order of seq, each in the places of the text as the ones before it left it. A
    document without edits stays as it is; edits of unknown documents are ignored; a null ``new`` deletes; of documents
    with one id all are edited."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path, pattern)
        for batch in batches:
            rows, texts, encoded = [], [], []
            for text, lens, counts, own in zip(*[batch.column(i).to_pylist() for i in range(1, 5)]):
                tree = _revived(text or "", lens, counts, counter)
                for e in own or ():
                    tree.edit(e["start"], e["end"], e["new"] or "")
                rows.append(_stored(tree))
                texts.append(tree.text if own else text)
                encoded.append(tree.reencoded)
            yield _tree_batch(batch.column(0), pa.array(texts, pa.string()), rows, pa.array(encoded, pa.int64()))

    kind = trees.schema[id_col].dataType.simpleString()
    by_doc = edits.groupBy(F.col(id_col).alias("id")).agg(F.array_sort(F.collect_list(F.struct("seq", "start", "end", "new"))).alias("edits"))
    both = trees.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), "lens", "counts").join(by_doc, "id", "left").select("id", "text", "lens", "counts", "edits")
    out = both.mapInArrow(run, f"id {kind}, text string, {TREES}, n_reencoded bigint")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("text", text_col)


def standard_edits(text: str) -> list[tuple[int, int, str]]:
    """Three edits that depend on the text's length only: an insertion, a deletion and a replacement."""
    n = len(text)
    return [(n * 2 // 3, n * 2 // 3 + 10, "Edited here."), (n // 2, n // 2 + 20, ""), (n // 3, n // 3, " and more")]


_COUNTERS: dict[tuple[str, str], Counter] = {}


def _counter(path: str, pattern: str) -> Counter:
    return _COUNTERS.get((path, pattern)) or _COUNTERS.setdefault((path, pattern), Counter(path, pattern))


def count_tokens(docs: DataFrame, path: str, pattern: str, edits=standard_edits, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, n_pretokens, and after the edits n_edited_tokens, n_edited_chars and
    n_reencoded, the pre-tokens that the edits made necessary to encode. ``edits``: text -> (start, end, new) in order,
    each in the places of the text as the ones before it left it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path, pattern)
        for batch in batches:
            rows = []
            for value in batch.column(1):
                text = value.as_py() or ""
                tree = CountTree(text, counter)
                before = (tree.n_tokens, tree.n_pieces)
                for start, end, new in edits(text):
                    tree.edit(start, end, new)
                rows.append((*before, tree.n_tokens, len(tree.text), tree.reencoded))
            names = ["n_tokens", "n_pretokens", "n_edited_tokens", "n_edited_chars", "n_reencoded"]
            yield pa.record_batch([batch.column(0), *[pa.array([r[i] for r in rows], pa.int64()) for i in range(5)]], names=["id", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens bigint, n_pretokens bigint, n_edited_tokens bigint, n_edited_chars bigint, n_reencoded bigint")
    return out.withColumnRenamed("id", id_col)
