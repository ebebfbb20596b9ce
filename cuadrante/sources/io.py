"""Sources and sinks: PDF discovery, JSON documents, versioned tables with a backup, literal tables, SQL lookups."""

from __future__ import annotations

import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas


def find_pdfs(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(path, length) of the PDF files in any case of the ending, by path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.select("path", "length").orderBy("path")


def file_bytes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def decode_pages(files: DataFrame, decode) -> DataFrame:
    """The pages of ``files`` (path, content): file, page, width, height, text, words, blocks, error.

    ``decode`` is the user's: the bytes of a file -> its pages as dicts of width, height, text, words and blocks, the
    last two as lists of (text, x0, y0, x1, y1). A file that it fails on gives one row with the error and no page, and
    the others go on."""

    def boxes(found):
        return [{"ord": i, "text": t, "x0": float(x0), "y0": float(y0), "x1": float(x1), "y1": float(y1)} for i, (t, x0, y0, x1, y1) in enumerate(found)]

    def run(batches):
        import pandas as pd

        columns = ["file", "page", "width", "height", "text", "words", "blocks", "error"]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                name = path.rpartition("/")[2]
                try:
                    rows = [(name, n, float(p["width"]), float(p["height"]), p["text"], boxes(p["words"]), boxes(p["blocks"]), None) for n, p in enumerate(decode(bytes(content)), 1)]
                except Exception as e:  # noqa: BLE001  whatever a decoder raises is the file's fault
                    rows = [(name, None, None, None, None, None, None, str(e) or type(e).__name__)]
                frame = pd.DataFrame(rows, columns=columns)
                yield frame.astype({"page": "Int32"})

    return files.select("path", "content").mapInPandas(run, schemas.DECODED)


def geometry(decoded: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(words, blocks, pages, failed files) of decoded pages, as the layout takes them."""
    good = decoded.where("error is null")
    boxes = lambda c: good.select("file", "page", F.explode(c).alias("x")).select("file", "page", "x.*")
    return boxes("words"), boxes("blocks"), good.select("file", "page", "width", "height", "text"), decoded.where("error is not null").select("file", "error")


def tables(spark: SparkSession, degrees: list, subjects: list, sessions: list) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables of a timetable from rows."""
    return spark.createDataFrame(degrees, schemas.DEGREES), spark.createDataFrame(subjects, schemas.SUBJECTS), spark.createDataFrame(sessions, schemas.SESSIONS)


def read_result(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RESULT).option("multiLine", True).json(path)


def result_records(result: DataFrame) -> DataFrame:
    """Accepted and rejected records of result documents, flat, with their place as ``pos``."""
    good = result.select(F.posexplode("records").alias("pos", "r")).select("pos", F.lit(True).alias("accepted"), F.lit(None).cast("array<string>").alias("reason"), "r.*")
    bad = result.select(F.posexplode("rejected_records").alias("pos", "x")).select("pos", F.lit(False).alias("accepted"), F.col("x.reason").alias("reason"), "x.record.*")
    return flat_records(good.unionByName(bad))


def flat_records(nested: DataFrame) -> DataFrame:
    c = F.col
    return nested.select(
        F.lit(0).cast("long").alias("ord"), "pos", "accepted", "reason", c("source.file").alias("file"), c("source.page").alias("page"), c("source.raw_text").alias("raw_text"),
        c("degree.code").alias("degree_code"), c("degree.name").alias("degree_name"), "academic_year", "semester", "year", c("group").alias("grp"), "day", "start_time", "end_time",
        c("subject.name").alias("name"), "subgroup", "classroom", "notes", c("extraction.confidence").alias("confidence"), F.coalesce(c("extraction.issues"), F.array().cast("array<string>")).alias("issues"),
    )


def read_legacy(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.LEGACY).option("multiLine", True).json(path).select(F.posexplode("standard_schedule").alias("pos", "r")).select("pos", "r.*")


def write_by_file(records: DataFrame, path: str, form: str = "json") -> None:
    """A folder for each source file; null fields are written."""
    records.write.mode("overwrite").partitionBy("file").option("ignoreNullFields", False).format(form).save(path)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


class Conflict(RuntimeError):
    """Another writer was first."""


#: Stores whose renaming isn't one step that fails if the name is taken.
NO_RENAME = ("s3", "s3a", "s3n", "gs", "oss", "cosn", "wasb", "wasbs")


def create_text(spark: SparkSession, path: str, text: str) -> None:
    """A new file; Conflict if there is one already, so of two writers one gets through.

    The text is written aside and then takes its name in one step that fails if the name is taken, so a reader sees
    the whole text or no file. Object stores have no such step; they are refused."""
    fs, Path = _fs(spark, path)
    if fs.getScheme() in NO_RENAME:
        raise ValueError(f"{fs.getScheme()} can't create a file without overwriting one")
    folder, _, name = path.rpartition("/")
    aside = Path(f"{folder}/_{name}-{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    jvm = spark.sparkContext._jvm
    try:
        if fs.getScheme() == "file":  # its renaming overwrites; a link doesn't
            at = lambda p: jvm.java.nio.file.Paths.get(fs.makeQualified(p).toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
            jvm.java.nio.file.Files.createLink(at(Path(path)), at(aside))
        else:
            no = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(aside, Path(path), no)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
            raise Conflict(path) from None
        raise
    finally:
        fs.delete(aside, False)


def put_in_place(spark: SparkSession, aside: str, path: str) -> None:
    """Give a finished file its name, in place of the one that has it, in one step."""
    fs, Path = _fs(spark, path)
    jvm = spark.sparkContext._jvm
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(Path(aside), Path(path), how)


def read_text(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    fs, Path = _fs(spark, path)
    given = fs.open(Path(path))
    try:
        return bytes(given.readAllBytes()).decode()
    finally:
        given.close()


def versions(spark: SparkSession, path: str) -> list[int]:
    """The finished versions of a table, in order."""
    fs, Path = _fs(spark, path)
    if not fs.exists(Path(path)):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(Path(path))]
    return sorted(int(n[1:-5]) for n in names if re.fullmatch(r"v\d{10}\.done", n))


def replace_table(table: DataFrame, path: str, keep: int = 1, form: str = "parquet") -> int:
    """Write a new version of the table at ``path`` and return its number.

    A version's files are complete before the mark that makes it the current one is created, and marks are never
    overwritten: readers see the old version or the new one, a second writer of the same version gets Conflict, and the
    ``keep`` versions before stay as backups."""
    spark = table.sparkSession
    done = versions(spark, path)
    new = (done[-1] if done else 0) + 1
    folder = f"{path}/v{new:010d}-{uuid.uuid4().hex}"
    table.write.format(form).save(folder)
    create_text(spark, f"{path}/v{new:010d}.done", folder.rpartition("/")[2])
    fs, Path = _fs(spark, path)
    for old in done[: len(done) - keep]:
        fs.delete(Path(_folder(spark, path, old)), True)
        fs.delete(Path(f"{path}/v{old:010d}.done"), False)
    return new


def _folder(spark: SparkSession, path: str, version: int) -> str:
    return f"{path}/" + read_text(spark, f"{path}/v{version:010d}.done")


def read_table(spark: SparkSession, path: str, form: str = "parquet", version: int | None = None) -> DataFrame | None:
    """The current version, or the one asked for; None if there is no such table."""
    done = versions(spark, path)
    if not done or version is not None and version not in done:
        return None
    return spark.read.format(form).load(_folder(spark, path, done[-1] if version is None else version))


def write_result(path: str, records: DataFrame, statistics: DataFrame, files: DataFrame, failed: DataFrame, processed_at: str) -> None:
    """The result of a run as a folder of JSON tables: statistics (one row, with version and time), files, records,
    rejected_records and failed_files. One document would have to pass one task as a whole."""
    head = statistics.select(F.lit("2.0").alias("schema_version"), F.lit(processed_at).alias("processed_at"), F.struct("*").alias("statistics"))
    parts = {"statistics": head, "files": files.orderBy("file"), "records": records.where("accepted"), "rejected_records": records.where("not accepted"), "failed_files": failed.orderBy("file")}
    for name, part in parts.items():
        part.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/{name}")


def first_message(spark: SparkSession, demo: DataFrame) -> DataFrame:
    return spark.sql("SELECT mensaje FROM {demo} LIMIT 1", demo=demo)


def find_user(spark: SparkSession, users: DataFrame, name: str) -> DataFrame:
    """Id and name by a bound parameter. Passwords are not compared here: that belongs to an identity service."""
    return spark.sql("SELECT id, username FROM {users} WHERE username = :name", args={"name": name}, users=users)


def catalog(spark: SparkSession) -> DataFrame:
    from ..operators.parsing import CATALOG

    return spark.createDataFrame(CATALOG, "code string, number string, title string")
