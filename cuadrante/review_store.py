"""The review as a user sees it: a stored item table, its queries, and edits by one or several writers.

Items are a versioned table; edits are events in a log of small files beside it, one for each edit, numbered without
gaps. A writer creates the file of the next number, which fails if another one was first, so none overwrites another.
Reading replays the log over the items; ``compact`` stores the outcome as a new version. It closes the log first, by an
event that takes the next number: every edit with a smaller number is in the new version, and a writer that comes after
it gets Conflict, until the new version is there. So an edit that was acknowledged is never lost. If ``compact`` is cut
off, the log stays closed and reading goes on; calling it again ends the work.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import live, review
from .review_index import Index
from .sources import io
from .streaming import edits


class ReviewError(ValueError):
    """A payload or status that can't be taken."""


class NotFound(LookupError):
    """No item has the id."""


LOG = "seq long, version long, id string, kind string, new_status string, degree_code string, degree_name string, academic_year string, semester int, year int, grp string, day string, start_time string, end_time string, subject_code string, name string, subgroup string, classroom string, notes array<string>"
KEYS = ("degree", "academic_year", "semester", "year", "group", "day", "start_time", "end_time", "subject", "subgroup", "classroom", "notes")
NUMBERS = ("semester", "year")


def checked(payload: object) -> dict:
    """The fields of an edit from a payload in the documents' shape; ReviewError if a key is missing or of a wrong kind."""
    if not isinstance(payload, Mapping):
        raise ReviewError("a record must be an object")
    missing = [k for k in KEYS if k not in payload]
    if missing:
        raise ReviewError(f"missing: {', '.join(missing)}")
    for key in ("degree", "subject"):
        if not isinstance(payload[key], Mapping):
            raise ReviewError(f"{key} must be an object with code and name")
    if not isinstance(payload["notes"], list) or not all(isinstance(x, str) for x in payload["notes"]):
        raise ReviewError("notes must be a list of text")
    plain = {"degree_code": payload["degree"].get("code"), "degree_name": payload["degree"].get("name"), "subject_code": payload["subject"].get("code"), "name": payload["subject"].get("name")}
    plain |= {("grp" if k == "group" else k): payload[k] for k in KEYS if k not in ("degree", "subject", "notes")}
    for key, value in plain.items():
        kind = int if key in NUMBERS else str
        if value is not None and (not isinstance(value, kind) or isinstance(value, bool)):
            raise ReviewError(f"{key} must be {'a whole number' if kind is int else 'text'} or null")
    return plain | {"notes": list(payload["notes"])}


class Selection:
    """Items that filters have chosen; sorted and paged on demand. ``paged`` gives a page where an index can."""

    def __init__(self, table: DataFrame, paged=None):
        self.table, self.paged = table, paged

    def sort(self) -> DataFrame:
        return self.table.orderBy(*review.order())

    def page(self, number: int = 1, size: int = 50) -> dict:
        """The items of a page, and the numbers around it."""
        rows = self.paged(number, size) if self.paged else review.page(self.table, number, size)
        return {"items": review.documents(rows), **review.page_info(self.table.count(), number, size)}

    def tree(self) -> DataFrame:
        return review.tree(self.table)


class Review:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _items(self) -> str:
        return f"{self.folder}/items"

    def refresh(self, records: DataFrame) -> int:
        """New items from an extraction; the version before stays as a backup, and its edits with it. Its log is closed
        first, so no edit is acknowledged that the new items haven't seen."""
        if io.versions(self.spark, self._items()):
            self._close(self._version())
        return io.replace_table(review.items(records), self._items())

    def ensure(self, records: DataFrame) -> int:
        """The current version; made from ``records`` if there is none."""
        done = io.versions(self.spark, self._items())
        return done[-1] if done else self.refresh(records)

    def _log_folder(self, version: int) -> str:
        return f"{self.folder}/log/v{version:010d}"

    def _version(self) -> int:
        done = io.versions(self.spark, self._items())
        if not done:
            raise NotFound("there is no review yet")
        return done[-1]

    def _events(self, version: int) -> int:
        fs, Path = io._fs(self.spark, self.folder)
        path = Path(self._log_folder(version))
        return sum(bool(re.fullmatch(r"\d{10}\.json", x.getPath().getName())) for x in fs.listStatus(path)) if fs.exists(path) else 0

    def _event(self, version: int, number: int) -> str:
        return f"{self._log_folder(version)}/{number:010d}.json"

    def _closed(self, version: int, known: int) -> bool:
        return known > 0 and json.loads(io.read_text(self.spark, self._event(version, known)))["kind"] == "close"

    def _close(self, version: int) -> None:
        """Give the log its last event; edits that come in meanwhile go before it."""
        while not self._closed(version, known := self._events(version)):
            try:
                io.create_text(self.spark, self._event(version, known + 1), json.dumps({"seq": known + 1, "version": version, "kind": "close"}))
            except io.Conflict:
                continue

    def items(self) -> DataFrame:
        """All items as they are now."""
        return self._replayed(self._version())

    def _replayed(self, version: int) -> DataFrame:
        table = io.read_table(self.spark, self._items(), version=version)
        if not self._events(version):
            return table
        return review.replay(table, self.spark.read.schema(LOG).json(self._log_folder(version)))

    def index(self, **options) -> Index:
        """Lay the current version out for pages, lookups, searches and counts. Edits that come later are looked up in
        the log, by id; ``compact`` and another ``index`` take them in."""
        version = self._version()
        return Index.at(self.spark, self._index(version)) or Index.build(io.read_table(self.spark, self._items(), version=version), self._index(version), **options)

    def _index(self, version: int) -> str:
        return f"{self.folder}/index/v{version:010d}"

    def _log(self, version: int) -> DataFrame | None:
        return self.spark.read.schema(LOG).json(self._log_folder(version)) if self._events(version) else None

    def follow(self, path: str, checkpoint: str, on_batch=None):
        """A stream that folds the current version's log into ``path`` as edits come (see ``streaming.edits``); its
        states give the items as they are without reading the log again. A version has its own log, so its own path."""
        log = edits.stream_log(self.spark, self._log_folder(self._version()), LOG)
        return edits.start_folding(log, path, checkpoint, on_batch)

    def _edited(self, index: Index, log: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The items that the log names, as they were and as they are."""
        before = index.with_ids(log)
        return before, review.replay(before, log)

    def records(self, **filters) -> Selection:
        version = self._version()
        index, log = Index.at(self.spark, self._index(version)), self._log(version)
        if index is None or (log is not None and not filters.get("search")):
            return Selection(review.apply_filters(self.items(), filters))
        if log is None:
            return Selection(index.filtered(filters).drop("number", "chunk"), lambda number, size: index.page(number, size, filters))
        # Edited items are searched as they are now, all others by the index.
        _, after = self._edited(index, log)
        others = index.search(str(filters["search"])).join(log.select("id").where("id is not null").distinct(), "id", "left_anti")
        return Selection(review.apply_filters(others.unionByName(after.select(others.columns)), filters))

    def facets(self) -> DataFrame:
        known = self._counts()
        return review.facets(self.items()) if known is None else live.facets(known)

    def tree(self) -> DataFrame:
        """The count tree of all items."""
        known, version = self._counts(), self._version()
        if known is None:
            return review.tree(self.items())
        index, log = Index.at(self.spark, self._index(version)), self._log(version)
        codes = index.codes() if log is None else live.changed_codes(index.codes(), self.items(), *self._edited(index, log))
        return live.tree(known, codes)

    def _counts(self) -> DataFrame | None:
        """The counts as they are now, if there is an index: those of the version and what the edited items change."""
        version = self._version()
        index, log = Index.at(self.spark, self._index(version)), self._log(version)
        if index is None or log is None:
            return index and index.counts()
        return live.changed(index.counts(), *self._edited(index, log))

    def degrees(self) -> DataFrame:
        return review.degree_facet(self.items())

    def summary(self, statistics: DataFrame, failed: DataFrame | None = None, processed_at: str | None = None) -> DataFrame:
        return review.summary(self.items(), statistics, failed, F.lit(processed_at))

    def find(self, item: str):
        """The item's row; NotFound if there is none."""
        version = self._version()
        found, log = self._row(version, item), self._log(version)
        row = review.documents(found if log is None else review.replay(found, log.where(F.col("id") == item))).first()
        if row is None:
            raise NotFound(item)
        return row

    def _row(self, version: int, item: str) -> DataFrame:
        """The item's stored row, by the index if there is one."""
        index = Index.at(self.spark, self._index(version))
        return index.find(item) if index else review.find(io.read_table(self.spark, self._items(), version=version), item)

    def _add(self, item: str, expected: int | None, **event) -> int:
        version = self._version()
        known = self._events(version)
        if expected is not None and expected != known:
            raise io.Conflict(f"{known} edits by now, {expected} expected")
        if self._closed(version, known):
            raise io.Conflict("the items are being stored anew")
        if not self._row(version, item).count():
            raise NotFound(item)
        line = json.dumps({"seq": known + 1, "version": version, "id": item, **event}, ensure_ascii=False)
        io.create_text(self.spark, self._event(version, known + 1), line)
        return known + 1

    def edit(self, item: str, payload: Mapping, expected: int | None = None) -> int:
        """Replace the item's fields; returns the number of edits by now. With ``expected``, or if another writer comes
        first, an edit on top of edits that the caller hasn't seen is a Conflict."""
        return self._add(item, expected, kind="edit", **checked(payload))

    def set_status(self, item: str, status: str, expected: int | None = None) -> int:
        if status not in review.STATUSES:
            raise ReviewError(f"no such status: {status}")
        return self._add(item, expected, kind="status", new_status=status)

    def restore(self, item: str, expected: int | None = None) -> int:
        return self._add(item, expected, kind="restore")

    def compact(self) -> int:
        """Store the items as they are as a new version, whose log is empty."""
        version = self._version()
        self._close(version)
        return io.replace_table(self._replayed(version), self._items())
