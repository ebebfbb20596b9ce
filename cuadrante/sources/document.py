"""One JSON document as large as a run, read and written by many tasks.

Reading: the text source cuts the file behind closing braces, at byte offsets, so a document is as many pieces as tasks
like, whether it has line breaks or not. A brace may stand in a string and a block of pieces may begin anywhere, so a
first pass tells for each block what it does to the state: whether quotes turn, and how the depth changes if it begins
outside or inside a string. The states at the beginnings follow from these few numbers. A second pass gives each block
its state and takes out the objects that are elements of arrays at the top level, by key; those that a block cuts are
given as fragments and put together.

Writing: each section is sorted and written as lines in parallel; the parts are joined in order by the file system's
own concatenation where it has one (a change of names, no bytes move), else copied one after the other in constant
memory, and the whole takes its name in one step.

Defined cases: an element that isn't an object is left out; keys that hold a brace are no sections; a key that comes
twice goes on counting; white space and escapes are as in the document. A folder of documents is read as one table, with
positions by file.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import UnsupportedOperationException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.review import editable
from . import io, schemas
from .shared import settle

ESCAPED = re.compile(r"\\.", re.S)
TOKEN = re.compile(r'\\.|["{}\[\]]', re.S)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    """Batches (value, file, start) -> each block with its pieces, the brace behind them included."""
    rows = ((f, s, v) for b in batches for v, f, s in zip(*[c.to_pylist() for c in b.columns]))
    held = next(rows, None)
    while held is not None:
        now = held[:2]

        def pieces():
            nonlocal held
            while held is not None and held[:2] == now:
                text, held = held[2], next(rows, None)
                yield text + "}"

        given = pieces()
        yield now, given
        for _ in given:
            pass


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, start, turns, outside, inside) of each block: whether its quotes turn the state, and the change of depth
    if it begins outside or inside a string."""
    for (file, start), pieces in _blocks(batches):
        turns, depth = 0, [0, 0]
        for text in pieces:
            parts = ESCAPED.sub("", text).split('"')
            opened = [sum(p.count("{") + p.count("[") - p.count("}") - p.count("]") for p in parts[k::2]) for k in (0, 1)]
            for s in (0, 1):
                depth[s] += opened[s ^ turns]
            turns ^= (len(parts) - 1) & 1
        yield pa.record_batch([pa.array([x]) for x in (file, start, turns, *depth)], names=["file", "start", "turns", "outside", "inside"])


def _elements(shared):
    """Batches (value, file, start) -> (file, start, kind, idx, section, text). Kinds: ``row`` an element, ``tail`` the
    beginning of one that goes on in the next block, ``middle`` a whole block inside one, ``head`` the end of one,
    ``end`` the section at the end of the block. A null section is the one that the block began in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, start), pieces in _blocks(batches):
            quoted, depth = shared.value[file, start]
            section, key, idx, out = None, None, 0, []
            held, begun = ([] if depth >= 3 else None), False
            string = None if quoted else ""  # parts of the string that is open; None if it began before the block
            for text in pieces:
                since, at_string = 0, 0
                for m in TOKEN.finditer(text):
                    c = m[0]
                    if quoted:
                        if c == '"':
                            quoted = 0
                            if depth == 1:
                                key = None if string is None else string + text[at_string : m.start()]
                    elif c == '"':
                        quoted, string, at_string = 1, "", m.end()
                    elif c in "{[":
                        depth += 1
                        if depth == 2:
                            section = (key or "") if c == "[" else ""
                        elif depth == 3 and c == "{":
                            held, begun, since = [], True, m.start()
                    elif c in "}]":
                        depth -= 1
                        if depth == 1:
                            section = ""
                        elif depth == 2 and held is not None and c == "}":
                            held.append(text[since : m.end()])
                            out.append(("row" if begun else "head", idx, section, "".join(held)))
                            idx, held = idx + begun, None
                if held is not None:
                    held.append(text[since:])
                if quoted and string is not None:
                    string += text[at_string:]
                if len(out) >= 1000:
                    yield _batch(file, start, out)
                    out = []
            if held is not None:
                out.append(("tail" if begun else "middle", idx, section, "".join(held)))
            yield _batch(file, start, [*out, ("end", idx, section, None)])

    return run


def _batch(file: str, start: int, rows: list[tuple]) -> pa.RecordBatch:
    kinds, idx, sections, texts = zip(*rows)
    return pa.record_batch(
        [pa.array([file] * len(rows)), pa.array([start] * len(rows), pa.int64()), pa.array(kinds), pa.array(idx, pa.int64()), pa.array(sections, pa.string()), pa.array(texts, pa.string())],
        names=["file", "start", "kind", "idx", "section", "text"],
    )


def elements(spark: SparkSession, path: str) -> DataFrame:
    """(file, section, pos, json): the objects in the arrays at the top level of the documents at ``path``."""
    pieces = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    states, now = {}, None
    for r in pieces.mapInArrow(_effects, "file string, start bigint, turns bigint, outside bigint, inside bigint").orderBy("file", "start").collect():  # one for each block
        quoted, depth = (0, 0) if r["file"] != now else (quoted, depth)
        now = r["file"]
        states[r["file"], r["start"]] = quoted, depth
        quoted, depth = quoted ^ r["turns"], depth + r["inside" if quoted else "outside"]
    found = settle(pieces.mapInArrow(_elements(spark.sparkContext.broadcast(states)), "file string, start bigint, kind string, idx bigint, section string, text string"))
    # The section in which a block begins, and for what is cut the block in which it begins.
    begins, owner, now = [], [], None
    for r in found.where("kind not in ('row')").select("file", "start", "kind", "section").orderBy("file", "start", F.array_position(F.array(*map(F.lit, ("head", "middle", "tail", "end"))), F.col("kind"))).collect():
        if r["file"] != now:
            now, section, opened = r["file"], "", None
        if r["kind"] == "tail":
            opened = r["start"]
        if r["kind"] in ("head", "middle", "tail"):
            owner.append((r["file"], r["start"], r["kind"], opened))
        if r["kind"] == "end":
            begins.append((r["file"], r["start"], section))
            section = section if r["section"] is None else r["section"]
    began = F.broadcast(spark.createDataFrame(begins, "file string, start long, began string"))
    owners = F.broadcast(spark.createDataFrame(owner, "file string, start long, kind string, opened long"))
    parts = found.where("kind in ('head', 'middle', 'tail')").join(owners, ["file", "start", "kind"])
    joined = parts.groupBy("file", F.col("opened").alias("start")).agg(
        F.max(F.when(F.col("kind") == "tail", F.col("idx"))).alias("idx"), F.max(F.when(F.col("kind") == "tail", F.col("section"))).alias("section"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), "").alias("text"),
    )
    rows = found.where("kind = 'row'").select("file", "start", "idx", "section", "text").unionByName(joined).join(began, ["file", "start"])
    rows = rows.withColumn("section", F.coalesce("section", "began")).where("section <> ''")
    # Positions: what the blocks before hold, and the place in the block; a section's elements follow each other there.
    sizes, before = [], {}
    for r in rows.groupBy("file", "section", "start").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("low")).orderBy("file", "start").collect():
        base = before.get((r["file"], r["section"]), 0)
        sizes.append((r["file"], r["section"], r["start"], base - r["low"]))
        before[r["file"], r["section"]] = base + r["n"]
    placed = rows.join(F.broadcast(spark.createDataFrame(sizes, "file string, section string, start long, shift long")), ["file", "section", "start"])
    return placed.select("file", "section", (F.col("idx") + F.col("shift")).alias("pos"), F.col("text").alias("json"))


def _parsed(rows: DataFrame, section: str, kind: str) -> DataFrame:
    return rows.where(F.col("section") == section).select("pos", F.from_json("json", kind).alias("r"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """As ``io.result_records(io.read_result(path))``, by many tasks on one document."""
    rows = elements(spark, path)
    good = _parsed(rows, "records", schemas.RECORD).select("pos", F.lit(True).alias("accepted"), F.lit(None).cast("array<string>").alias("reason"), "r.*")
    bad = _parsed(rows, "rejected_records", f"struct<reason:array<string>,record:{schemas.RECORD}>").select("pos", F.lit(False).alias("accepted"), F.col("r.reason").alias("reason"), "r.record.*")
    return io.flat_records(good.unionByName(bad))


def read_legacy(spark: SparkSession, path: str) -> DataFrame:
    """As ``io.read_legacy``, by many tasks on one document."""
    return _parsed(elements(spark, path), "standard_schedule", schemas.LEGACY_RECORD).select("pos", "r.*")


# --- writing --------------------------------------------------------------------------------------------------------


def record_shape(records: DataFrame):
    """A flat record as documents have it."""
    source = F.col("degree_source") if "degree_source" in records.columns else F.lit(None).cast("string")
    fields = editable(records)
    names = ("degree", "academic_year", "semester", "year", "group", "day", "start_time", "end_time", "subject", "subgroup", "classroom", "notes")
    return F.struct(*[fields[n].alias(n) for n in names], F.struct("file", "page", "raw_text").alias("source"), F.struct(source.alias("degree_source"), "confidence", "issues").alias("extraction"))


def join_files(spark: SparkSession, sources: list[str], target: str) -> bool:
    """One file of several, in order; whether the file system did it by itself."""
    fs, Path = io._fs(spark, target)
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    fs.create(Path(target), False).close()
    given = gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(sources))
    for i, s in enumerate(sources):
        given[i] = Path(s)
    try:
        fs.concat(Path(target), given)
        return True
    except UnsupportedOperationException:
        pass
    out = fs.create(Path(target), True)
    try:
        for s in sources:
            read = fs.open(Path(s))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(read, out, 1 << 20, False)
            finally:
                read.close()
    finally:
        out.close()
    return False


def write_document(path: str, records: DataFrame, statistics: DataFrame, files: DataFrame, failed: DataFrame, processed_at: str, order: tuple[str, ...] = ("ord", "pos")) -> None:
    """The result of a run as one document, which replaces the one before in one step: the old one or the new one is
    there, whole. ``records`` are flat, with ``accepted``."""
    spark, aside = records.sparkSession, f"{path.rpartition('/')[0]}/_{uuid.uuid4().hex}"
    fs, Path = io._fs(spark, path)
    bad = records.where("not accepted")
    reason = F.coalesce(bad["reason"], bad["issues"]) if "reason" in bad.columns else bad["issues"]
    sections = {
        "files": files.select(F.struct("*").alias("x"), F.col("file").alias("_0")),
        "records": records.where("accepted").select(record_shape(records).alias("x"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(order)]),
        "rejected_records": bad.select(F.struct(reason.alias("reason"), record_shape(bad).alias("record")).alias("x"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(order)]),
        "failed_files": failed.select(F.struct("*").alias("x"), F.col("file").alias("_0")),
    }
    counted = statistics.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0]  # one row
    stamp = spark.range(1).select(F.to_json(F.struct(F.lit("2.0").alias("schema_version"), F.lit(processed_at).alias("processed_at")))).first()[0]
    pieces, texts = [], 0

    def literal(text: str) -> None:
        nonlocal texts
        io.create_text(spark, f"{aside}/text-{texts}", text)
        pieces.append(f"{aside}/text-{texts}")
        texts += 1

    try:
        head = f'{stamp[:-1]},\n"statistics": {counted}'
        for name, rows in sections.items():
            literal(head + f',\n"{name}": [\n')
            sorted_rows = rows.orderBy(*[c for c in rows.columns if c != "x"]).select(F.to_json("x", {"ignoreNullFields": "false"}).alias("json"))
            first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0  # of its part
            sorted_rows.select(F.when(first, F.col("json")).otherwise(F.concat(F.lit(","), "json"))).write.text(f"{aside}/{name}")
            parts = sorted(x.getPath().getName() for x in fs.listStatus(Path(f"{aside}/{name}")) if x.getLen() and x.getPath().getName().startswith("part-"))
            for i, part in enumerate(parts):
                if i:
                    literal(",")
                pieces.append(f"{aside}/{name}/{part}")
            head = "]"
        literal("]\n}\n")
        join_files(spark, pieces, f"{aside}/whole")
        io.put_in_place(spark, f"{aside}/whole", path)
    finally:
        fs.delete(Path(aside), True)
