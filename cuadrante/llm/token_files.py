"""Token ids in succinct binary shards: a wavelet matrix per shard.

Documents are dealt out by ranges of doc_id, sorted, encoded and appended; a shard is closed once it holds SHARD_IDS
ids. Its file holds, most significant bit first, one bit-plane for each bit of an id. The ids are stably partitioned by
the bit of a plane before the next plane is taken, so rank and select on the planes give the id at a place, the count
of an id before a place, and the place of its k-th occurrence, without ever unpacking the sequence. The planes, their
rank samples and the documents' ids and ends are packed into one file, in compressed blocks: a look at one place
unpacks one block of each plane. Files are rows of a table (one binary value each), so they are written and read by
Spark's own committers on whatever store the cluster has.

Encoding uses the tokenizers library; the path of the vocabulary is a parameter. The vocabulary meant here drops white
space and never merges across it, so the ids of a text are those of its pieces: these are kept in a bounded table and
only unknown ones are encoded. Texts with characters for which Arrow's classes may differ from the library's, or with
the strings of special tokens, are encoded whole by the library.

Defined cases: a null text is empty and has only the end id; repeated rows follow each other; a null doc_id comes
first; an empty table gives no file. Other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, parts, settle, slices

SHARD_IDS = 2_000_000
PART_BYTES = 256_000_000  # of text in a range of ids
CACHE = 500_000
BATCH_BYTES = 12_000_000
BLOCK = 32_768  # bytes of a plane that are compressed together
MAGIC = b"CWM2"
SAMPLE = 512  # bits between two rank samples


class Encoder:
    """Ids of texts by a tokenizer file, with a bounded table of pieces and their ids. Words, pieces and ids stay in
    Arrow arrays throughout; only pieces that are in no table reach the library."""

    #: Beyond these characters, or with these strings, a text is left to the library as a whole.
    UNSAFE = r"[\x1c-\x1f\x{130}]|[^\x00-\x{24F}]|<\|"
    PIECE = r"('s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+)"
    WORD_END = "</w>"
    TOGETHER = 50  # pieces that go to the library as one string

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # Pieces are lower-cased and cut already: the model alone is left to do.
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a piece
        self.last[[i for t, i in vocabulary.items() if t.endswith(self.WORD_END)]] = True
        self.pieces = pa.array([""], pa.large_string())
        self.ids = pa.array([[]], pa.large_list(pa.uint32()))

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_pieces(self, pieces: pa.Array) -> pa.Array:
        """The list of ids of each piece."""
        every = pieces.to_pylist()
        found = self.model.encode_batch_fast([" ".join(every[i : i + self.TOGETHER]) for i in range(0, len(every), self.TOGETHER)], add_special_tokens=False)
        ids = np.concatenate([np.zeros(0, np.uint32), *[np.array(x.ids, np.uint32) for x in found]])
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(every):  # a model whose pieces don't end in a mark
            each = self._whole(every)
            ids, ends = np.concatenate(each), np.cumsum([len(x) for x in each])
        return pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int64()), pa.array(ids))

    def _ids_of_pieces(self, pieces: pa.Array) -> pa.Array:
        """The ids of different pieces. The table keeps what it has until it is full, then what was asked for last."""
        new = pieces.filter(pc.is_null(pc.index_in(pieces, value_set=self.pieces)))
        if len(new):
            self.pieces, self.ids = pa.concat_arrays([self.pieces, new]), pa.concat_arrays([self.ids, self._encode_pieces(new)])
        out = self.ids.take(pc.index_in(pieces, value_set=self.pieces))
        if len(self.pieces) > CACHE:
            self.pieces, self.ids = pieces, out
        return out

    def _ids_of_words(self, words: pa.Array) -> pa.Array:
        low = pc.utf8_lower(words)
        mixed = pc.invert(pc.utf8_is_alpha(low))
        cut = pc.replace_with_mask(low, mixed, pc.replace_substring_regex(low.filter(mixed), self.PIECE, r"\1 "))
        split = pc.split_pattern(cut, " ")
        coded = split.flatten().dictionary_encode()
        ids = self._ids_of_pieces(coded.dictionary)
        at = coded.indices
        sizes = pc.list_value_length(ids).to_numpy(zero_copy_only=False)[at.to_numpy(zero_copy_only=False)]
        return pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)])[split.offsets.to_numpy()], pa.int64()), ids.take(at).flatten())

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end id, and where each text ends)."""
        plain = texts.cast(pa.large_string()).fill_null("")
        odd = np.flatnonzero(pc.match_substring_regex(plain, self.UNSAFE).to_numpy(zero_copy_only=False))
        whole = self._whole(plain.take(pa.array(odd)).to_pylist()) if len(odd) else []
        if len(odd):
            mask = np.zeros(len(plain), bool)
            mask[odd] = True
            plain = pc.if_else(pa.array(mask), "", plain)
        split = pc.utf8_split_whitespace(plain)
        coded = split.flatten().dictionary_encode()
        words = self._ids_of_words(coded.dictionary)
        # Each text's words are followed by one more: the end id alone, or the ids of a whole odd text and the end id.
        more = pa.array([[end_id], *[np.append(x, np.uint32(end_id)) for x in whole]], pa.large_list(pa.uint32()))
        words = pa.concat_arrays([words, more])
        n, after = len(plain), split.offsets.to_numpy()[1:] + np.arange(len(plain))
        code = np.empty(len(coded) + n, np.int64)
        own = np.ones(len(code), bool)
        own[after] = False
        code[own] = coded.indices.to_numpy(zero_copy_only=False)
        code[after] = len(coded.dictionary)
        code[after[odd]] += 1 + np.arange(len(odd))
        sizes = np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False)[code])
        return words.take(pa.array(code)).flatten().to_numpy(zero_copy_only=False), sizes[after].astype(np.int64)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Packed:
    """Bytes in compressed blocks; a read unpacks the blocks that it touches and no others."""

    def __init__(self, data: bytes | memoryview, at: int = 0):
        self.size, n = struct.unpack_from("<QI", data, at)
        first = at + 12 + 4 * n
        self.bounds = first + np.concatenate([[0], np.cumsum(np.frombuffer(data, "<u4", n, at + 12), dtype=np.int64)])
        self.data, self.end, self.unpacked = data, int(self.bounds[-1]), (-1, b"")

    @staticmethod
    def pack(raw: bytes) -> bytes:
        blocks = [pa.compress(raw[i : i + BLOCK], codec="zstd", asbytes=True) for i in range(0, len(raw), BLOCK)]
        return b"".join([struct.pack("<QI", len(raw), len(blocks)), np.array([len(b) for b in blocks], "<u4").tobytes(), *blocks])

    def _block(self, i: int) -> bytes:
        if self.unpacked[0] != i:
            a, b = int(self.bounds[i]), int(self.bounds[i + 1])
            self.unpacked = i, pa.decompress(self.data[a:b], decompressed_size=min(BLOCK, self.size - i * BLOCK), codec="zstd", asbytes=True)
        return self.unpacked[1]

    def __getitem__(self, part: slice) -> np.ndarray:
        a, b, _ = part.indices(self.size)
        if a >= b:
            return np.zeros(0, np.uint8)
        joined = b"".join([self._block(i) for i in range(a // BLOCK, (b - 1) // BLOCK + 1)])
        return np.frombuffer(joined, np.uint8, b - a, a % BLOCK)


class WaveletMatrix:
    """A sequence of non-negative integers as bit-planes with rank samples. A plane is an array of bytes, or Packed."""

    def __init__(self, n: int, planes: list[np.ndarray | Packed], zeros: list[int], ranks: list[np.ndarray]):
        self.n, self.planes, self.zeros, self.ranks = n, planes, zeros, ranks

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        v = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros, ranks = [], [], []
        for level in range(bits - 1, -1, -1):
            bit = ((v >> v.dtype.type(level)) & v.dtype.type(1)).astype(bool)
            plane = np.packbits(bit, bitorder="little")
            planes.append(plane)
            zeros.append(len(bit) - int(np.count_nonzero(bit)))
            ranks.append(cls.sample(plane))
            v = np.concatenate([v[~bit], v[bit]])
        return cls(len(ids), planes, zeros, ranks)

    @staticmethod
    def sample(plane: np.ndarray) -> np.ndarray:
        """Ones before every SAMPLE-th bit."""
        padded = np.zeros(-(-max(len(plane), 1) // (SAMPLE // 8)) * (SAMPLE // 8), dtype=np.uint8)
        padded[: len(plane)] = plane
        ones = np.bitwise_count(padded).reshape(-1, SAMPLE // 8).sum(axis=1, dtype=np.uint32)
        return np.concatenate([[0], np.cumsum(ones)]).astype("<u4")

    def bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3 : (i >> 3) + 1][0]) >> (i & 7) & 1

    def rank(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block = i // SAMPLE
        first = block * (SAMPLE // 8)
        part = self.planes[level][first : (i + 7) >> 3]
        over = int(part[-1]) >> (i & 7) if i & 7 else 0  # bits of the last byte from the place on
        return int(self.ranks[level][block]) + int(np.bitwise_count(part).sum()) - over.bit_count()

    def access(self, i: int) -> int:
        value = 0
        for level, zeros in enumerate(self.zeros):
            b = self.bit(level, i)
            value = value << 1 | b
            ones = self.rank(level, i)
            i = zeros + ones if b else i - ones
        return value

    def _range(self, value: int, upto: int) -> tuple[int, int]:
        """Where the occurrences of ``value`` among the first ``upto`` lie after the last plane."""
        if value < 0 or value >> len(self.planes):
            return 0, 0
        low, high = 0, upto
        for level, zeros in enumerate(self.zeros):
            a, b = self.rank(level, low), self.rank(level, high)
            low, high = (zeros + a, zeros + b) if value >> (len(self.planes) - 1 - level) & 1 else (low - a, high - b)
        return low, high

    def count(self, value: int, upto: int | None = None) -> int:
        low, high = self._range(value, self.n if upto is None else upto)
        return high - low

    def select(self, value: int, k: int) -> int:
        """The place of the k-th occurrence, counted from 0."""
        low, high = self._range(value, self.n)
        if not 0 <= k < high - low:
            raise IndexError(k)
        i = low + k
        for level in range(len(self.planes) - 1, -1, -1):
            one = value >> (len(self.planes) - 1 - level) & 1
            i = self._place(level, i - self.zeros[level] if one else i, one)
        return i

    def _place(self, level: int, k: int, one: int) -> int:
        """The place of the k-th one (or zero) in a plane."""
        before = lambda block: int(self.ranks[level][block]) if one else block * SAMPLE - int(self.ranks[level][block])
        low, high = 0, len(self.ranks[level]) - 1
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if before(mid) <= k else (low, mid)
        first = low * SAMPLE
        bits = np.unpackbits(self.planes[level][first >> 3 : (first + SAMPLE) >> 3], bitorder="little")[: self.n - first]
        return first + int(np.flatnonzero(bits == one)[k - before(low)])

    def sequence(self) -> np.ndarray:
        """All values, by undoing the partitions from the last plane up."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        v = np.zeros(self.n, dtype=kind)
        for level in range(len(self.planes) - 1, -1, -1):
            bit = np.unpackbits(self.planes[level][:], count=self.n, bitorder="little").astype(bool)
            up = np.empty_like(v)
            up[~bit] = v[: self.zeros[level]]
            up[bit] = v[self.zeros[level] :] | kind(1 << (len(self.planes) - 1 - level))
            v = up
        return v


def write_shard(doc_ids: list[int | None], ends: np.ndarray, ids: np.ndarray) -> bytes:
    """One file: magic, numbers of ids, documents and planes, then Packed parts."""
    m = WaveletMatrix.build(ids)
    known = np.array([x is not None for x in doc_ids], dtype=np.uint8)
    parts = [np.array([x or 0 for x in doc_ids], dtype="<i8"), known, ends.astype("<i8"), np.array(m.zeros, dtype="<u8")]
    return b"".join([MAGIC + struct.pack("<QQI", m.n, len(doc_ids), len(m.planes)), *[Packed.pack(x.tobytes()) for x in (*parts, *m.ranks, *m.planes)]])


def read_shard(data: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """(ids of documents, their ends, the ids' matrix). Bit-planes stay packed until a place in them is asked for."""
    if data[:4] != MAGIC:
        raise ValueError("not a shard")
    n, n_docs, n_planes = struct.unpack_from("<QQI", data, 4)
    at, parts = 24, []
    for _ in range(4 + 2 * n_planes):
        parts.append(Packed(data, at))
        at = parts[-1].end
    names, known, ends, zeros = (p[:].tobytes() for p in parts[:4])
    doc_ids = [int(x) if k else None for x, k in zip(np.frombuffer(names, "<i8"), known)]
    ranks = [np.frombuffer(p[:].tobytes(), "<u4") for p in parts[4 : 4 + n_planes]]
    return doc_ids, np.frombuffer(ends, "<i8"), WaveletMatrix(n, parts[4 + n_planes :], [int(x) for x in np.frombuffer(zeros, "<u8")], ranks)


def write_shards(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> DataFrame:
    """(part, seq, n_docs, n_ids, data): the shards in ascending order of doc_id, written to the shared folder."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyspark

        part, seq = pyspark.TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        ids: list[np.ndarray] = []
        ends: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            data = write_shard(names, np.concatenate(ends), np.concatenate(ids))
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(names)], pa.int64()), pa.array([size], pa.int64()), pa.array([data], pa.binary())], names=["part", "seq", "n_docs", "n_ids", "data"])

        code = encoder(path)
        for batch in batches:
            for piece in slices(batch, 1, BATCH_BYTES):
                own, own_ends = code.encode(piece.column(1), end_id)
                names += piece.column(0).to_pylist()
                ids.append(own)
                ends.append(own_ends + size)
                size += len(own)
                if size >= shard_ids:
                    yield close()
                    names, ids, ends, size, seq = [], [], [], 0, seq + 1
        if names:
            yield close()

    # The tie spreads the rows of a repeated id over ranges; rows of one id may stand in any order.
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("tie"))
    ordered = rows.repartitionByRange(parts(docs, text_col, PART_BYTES), "id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    return settle(ordered.mapInArrow(encode, "part int, seq int, n_docs bigint, n_ids bigint, data binary"))


def read_documents(shards: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document, from the files alone: id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc_ids, ends, m = read_shard(data.as_py())
                ids = m.sequence().astype("<u4")
                begins = np.concatenate([[0], ends[:-1]])
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(begins, ends)]
                yield pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(begins + start, pa.int64()), pa.array(ends - begins, pa.int64()), pa.array(crcs, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])

    sizes = shards.select("part", "seq", "n_ids")
    upto = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Parts are as many as partitions; only their totals are ordered in one task.
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", upto(Window.orderBy("part")).alias("before"))
    within = sizes.select("part", "seq", upto(Window.partitionBy("part").orderBy("seq")).alias("inside"))
    starts = within.join(parts, "part").select("part", "seq", (F.col("before") + F.col("inside")).alias("start"))
    few = sizes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    placed = shards.select("part", "seq", "data").join(F.broadcast(starts) if few else starts, ["part", "seq"])
    out = placed.select("start", "data").mapInArrow(decode, "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return out.withColumnRenamed("id", id_col)
