"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import scratch, settle, spread  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: A word is a maximal run of anything but space, tab, newline, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
BREAK = r"[\x20\x09-\x0D]+"

#: Tables of at most this many rows may be broadcast; operators count rows before they hint.
BROADCAST_ROWS = 20_000


def lower_az(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Texts of ASCII only take the built-in function, which is faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The words of a text in order; an empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BREAK), lambda w: w != "")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``, which may use it inside further lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def utf8(text: Column) -> Column:
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def parts(docs: DataFrame, text_col: str, part_bytes: int) -> int:
    """How many partitions to deal texts over: what the session has set, or more where a part would hold over
    ``part_bytes`` of text."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(12, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes))


def plain(name: str) -> str:
    """A column's name in quotes, so that dots and quotes in it are no more than that."""
    return f"`{name.replace('`', '``')}`"


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, for working columns beside unknown ones."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``size`` bytes of a text column, one row at least. Parts are copies: some of Arrow's
    string functions read a slice's neighbours."""
    upto = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).cumsum()
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + size, side="right")))
        yield batch.take(pa.array(np.arange(first, last)))
        first = last
