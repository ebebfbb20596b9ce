"""A review laid out for its questions: pages by rank, lookup by id, search by trigrams.

``build`` numbers the items in the review's own order and writes these tables:

* ``rows``: the items, CHUNK numbers to a folder, in order. A page reads the folders that its numbers lie in; with a
  filter, items are counted by folder first, and the page reads the folders where the running count reaches it.
* ``ids``: id and number, in folders by a hash of the id, with a Bloom filter in each file. A lookup reads one folder
  of it and one of the rows.
* ``trigrams``: for each trigram and folder of rows the numbers of the items whose text has it, in folders by a hash of
  the trigram. A search reads the folders of its trigrams, intersects their lists folder by folder, and looks at the
  rows that are left, with the same condition as a search without the index. A trigram that most items have is as many
  lists as there are folders of rows, so none is long.

* ``counts`` and ``codes``: what facets and the count tree are made from (``operators.live``).

The numbers are given by counting sorted parts, not by one task. Defined cases: queries of fewer than three characters
read all rows; null and empty fields are left out of the text; equal items keep their order; an empty table has no
folder and every answer is empty.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import live, review
from .sources import io
from .sources.shared import settle

CHUNK = 65_536  # items in a folder of rows
BUCKETS = 32
#: A search that is left with items in more folders than these doesn't name them to the scan one by one.
MOST_FOLDERS = 10_000
MOST_IDS = 1_000


def numbered(table: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """``table`` with the place of each row in ``order``, from 0. Parts are sorted by ranges and counted; only the
    counts, one for each part, are put in order by one task."""
    # The upper bits of these ids are the part, the lower 33 the place in it; both are kept by writing them down.
    placed = settle(table.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    before, starts = 0, []
    for r in sizes:
        starts.append((r["part"], before))
        before += r["n"]
    known = table.sparkSession.createDataFrame(starts, "_part long, _before long")
    out = placed.join(F.broadcast(known), part == F.col("_part")).withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1))
    return out.drop("_at", "_part", "_before")


def trigrams(text: Column) -> Column:
    """The different runs of three characters; empty for shorter texts."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(...))"), F.lit(1)))


def trigram_lists(rows: DataFrame, chunk: int, n: int) -> DataFrame:
    """(gram, chunk, places, bucket) in ``n`` parts, sorted. The rows of a folder meet once, as text and place: equal
    texts are one before they are taken apart, and a folder's trigrams are put together where they are made."""
    place = (F.col("number") - F.col("chunk") * chunk).cast("int")
    texts = rows.select("chunk", place.alias("place"), review.searched_text().alias("text")).repartition(n, "chunk")
    different = texts.groupBy("chunk", "text").agg(F.collect_list("place").alias("places"))
    grams = different.select("chunk", "places", F.explode(trigrams(F.col("text"))).alias("gram"))
    lists = grams.groupBy("gram", "chunk").agg(F.sort_array(F.flatten(F.collect_list("places"))).alias("places")).withColumn("bucket", _bucket(F.col("gram")))
    return lists.repartition(n, "bucket", F.col("chunk") % max(1, -(-n // BUCKETS))).sortWithinPartitions("bucket", "gram", "chunk")


def _bucket(value: Column) -> Column:
    return (F.crc32(value.cast("binary")) % BUCKETS).cast("int")


def _bucket_of(value: str) -> int:
    return zlib.crc32(value.encode()) % BUCKETS


class Index:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.about = json.loads(io.read_text(spark, f"{self.path}/about.json"))

    @classmethod
    def build(cls, items: DataFrame, path: str, chunk: int = CHUNK) -> Index:
        """Write the tables below ``path``; the description comes last, so a half-written index is none."""
        spark, path = items.sparkSession, path.rstrip("/")
        # Numbers are added to the settled, sorted items wherever these are read.
        rows = numbered(items, review.order()).withColumn("chunk", F.floor(F.col("number") / chunk).cast("long"))
        n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        rows.repartition(n, "chunk").sortWithinPartitions("chunk", "number").write.partitionBy("chunk").parquet(f"{path}/rows")
        ids = rows.select("id", "number", _bucket(F.col("id")).alias("bucket"))
        ids.repartitionByRange(n, "bucket", "id").sortWithinPartitions("bucket", "id").write.partitionBy("bucket").option("parquet.bloom.filter.enabled#id", "true").parquet(f"{path}/ids")
        trigram_lists(rows, chunk, n).write.partitionBy("bucket").parquet(f"{path}/trigrams")
        live.counts(rows).write.parquet(f"{path}/counts")
        live.codes(rows).write.parquet(f"{path}/codes")
        sizes = [(r["chunk"], r["count"]) for r in rows.groupBy("chunk").count().orderBy("chunk").collect()]  # one for each folder
        io.create_text(spark, f"{path}/about.json", json.dumps({"schema": items.schema.json(), "chunk": chunk, "rows": sum(n for _, n in sizes)}))
        return cls(spark, path)

    @classmethod
    def at(cls, spark: SparkSession, path: str) -> Index | None:
        """The index at ``path``, or None."""
        fs, Path = io._fs(spark, path)
        return cls(spark, path) if fs.exists(Path(f"{path.rstrip('/')}/about.json")) else None

    def _table(self, name: str, more: str) -> DataFrame:
        return self.spark.read.schema(more).parquet(f"{self.path}/{name}")

    def rows(self) -> DataFrame:
        """The items with number and chunk."""
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(json.loads(self.about["schema"])).add("number", "long").add("chunk", "long")
        return self.spark.read.schema(schema).parquet(f"{self.path}/rows") if self.about["rows"] else self.spark.createDataFrame([], schema)

    def _items(self, rows: DataFrame) -> DataFrame:
        return rows.drop("number", "chunk")

    def find(self, item: str) -> DataFrame:
        """The item's row: one folder of ids, then one of rows."""
        if not self.about["rows"]:
            return self._items(self.rows())
        ids = self._table("ids", "id string, number long, bucket int")
        at = ids.where((F.col("bucket") == _bucket_of(item)) & (F.col("id") == item)).agg(F.min("number")).first()[0]
        return self._items(self.numbers([] if at is None else [at]))

    def counts(self) -> DataFrame:
        return self._table("counts", "kind string, key array<string>, n long")

    def codes(self) -> DataFrame:
        return self._table("codes", "degree string, code string")

    def with_ids(self, named: DataFrame) -> DataFrame:
        """The items whose id is in the column ``id`` of ``named``: their numbers by ``ids``; with up to MOST_IDS of them
        the folders of both tables are named to the scans."""
        wanted = [r["id"] for r in named.select("id").where("id is not null").distinct().limit(MOST_IDS + 1).collect()]
        if not self.about["rows"] or len(wanted) > MOST_IDS:
            return self._items(self.rows().join(named.select("id").distinct(), "id", "left_semi"))
        ids = self._table("ids", "id string, number long, bucket int")
        found = ids.where(F.col("bucket").isin(sorted({_bucket_of(x) for x in wanted})) & F.col("id").isin(wanted)).select("number").collect()
        return self._items(self.numbers([r["number"] for r in found]))

    def numbers(self, wanted: list[int]) -> DataFrame:
        """The rows with these numbers."""
        return self.rows().where(F.col("chunk").isin(sorted({x // self.about["chunk"] for x in wanted})) & F.col("number").isin(wanted))

    def page(self, number: int = 1, size: int = 50, filters: Mapping[str, object] | None = None) -> DataFrame:
        """The same page as ``review.page`` of the filtered items; numbers and sizes are clamped alike."""
        number, size = max(1, number), min(max(1, size), 200)
        first, chunk = (number - 1) * size, self.about["chunk"]
        if not any(v not in (None, "") for v in (filters or {}).values()):
            rows = self.rows().where(F.col("chunk").between(first // chunk, (first + size - 1) // chunk) & F.col("number").between(first, first + size - 1))
            return self._items(rows.orderBy("number"))
        chosen = self.filtered(filters)
        before, folders, skip = 0, [], 0
        for r in chosen.groupBy("chunk").count().orderBy("chunk").collect():  # one for each folder
            if before + r["count"] > first and before < first + size:
                skip = skip if folders else first - before
                folders.append(r["chunk"])
            before += r["count"]
        return self._items(chosen.where(F.col("chunk").isin(folders)).orderBy("number").offset(max(0, skip)).limit(size))

    def filtered(self, filters: Mapping[str, object]) -> DataFrame:
        """The rows that pass the filters, by ``review.apply_filters``; a search goes by the trigrams."""
        query = str(filters.get("search") or "")
        rows = self._searched(query) if query else self.rows()
        return review.apply_filters(rows, {k: v for k, v in filters.items() if k != "search"})

    def search(self, query: str) -> DataFrame:
        """The items whose text has ``query``, as ``review.matches`` says."""
        return self._items(self._searched(query))

    def _searched(self, query: str) -> DataFrame:
        q = query.strip().lower()
        grams = sorted({q[i : i + 3] for i in range(len(q) - 2)})
        if not grams or not self.about["rows"]:
            return self.rows().where(review.matches(query))
        lists = self._table("trigrams", "gram string, chunk long, places array<int>, bucket int")
        found = lists.where(F.col("bucket").isin(sorted({_bucket_of(g) for g in grams})) & F.col("gram").isin(grams))
        # As many lists of a folder as there are trigrams, or one is missing; a list has at most as many places as a folder.
        each = found.groupBy("chunk").agg(F.collect_list("places").alias("all")).where(F.size("all") == len(grams))
        shared = F.aggregate(F.slice("all", 2, max(1, len(grams))), F.get("all", F.lit(0)), lambda a, x: F.array_intersect(a, x))
        left = settle(each.select("chunk", shared.alias("places")).where(F.size("places") > 0))
        folders = [r["chunk"] for r in left.select("chunk").limit(MOST_FOLDERS + 1).collect()]
        rows = self.rows() if len(folders) > MOST_FOLDERS else self.rows().where(F.col("chunk").isin(folders))
        numbers = left.select(F.explode(F.transform("places", lambda p: F.col("chunk") * self.about["chunk"] + p)).alias("number"))
        return rows.join(numbers, "number", "left_semi").where(review.matches(query))


def files_read(df: DataFrame) -> dict[str, int]:
    """How many files each scan of ``df`` opens: the folder of the scan -> files, after partitions are pruned."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    found: dict[str, int] = {}
    waiting = [plan]
    while waiting:
        p = waiting.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            waiting.append(p.finalPhysicalPlan())
            continue
        if kind.endswith("QueryStageExec"):
            waiting.append(p.plan())
            continue
        if kind == "FileSourceScanExec":
            path = str(p.relation().location().rootPaths().mkString(",")).rstrip("/").rpartition("/")[2]
            found[path] = found.get(path, 0) + int(p.metrics().get("numFiles").get().value())
        children = p.children()
        waiting += [children.apply(i) for i in range(children.size())]
    return found
