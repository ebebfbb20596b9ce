"""Cell text to subjects, page text to metadata: regular-expression cascades as columns, without UDFs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .matching import longest_contained

# The formats that cells are written in.
GROUP = r"\d+[A-Z](?:\d+)?"
ROOM = r"[^()]{1,50}"
# The repeated formats begin with any text, so a match from some place is one from where the last match ended, too, as long
# as texts are without line ends (``T.clean``): looking there alone (\G) finds the same, in proportion to the text.
STANDARD = rf"(?iu)\G(.+?)\s*-\s*({GROUP})\*?\s*\(({ROOM})\)"
ROOM_FIRST = rf"(?iu)\G(.+?)\s*\(({ROOM})\)\s*-\s*({GROUP})"
GROUP_FIRST = rf"(?iu)^({GROUP})\s*\(({ROOM})\)\s+(.+?)\s*[-]?$"
SIMPLE = r"(?iu)^(.+?)\s*\(([^)]+)\)$"
REDIRECT = rf"(?iu){GROUP}\s*(?:→|->)\s*{GROUP}\s*\([A-Z0-9]{{1,10}}\)"
CODE_PREFIX = r"(?iu)^[A-ZÁÉÍÓÚÑ]{1,6}\.?\s*\d{3,8}\s*-\s*"
DEGREE = r"(?iu)GRADO EN (.*?)\s*\((G\d+)\)"
MASTER = r"(?iu)MASTER UNIVERSITARIO EN (.*?)(?:CUATRIMESTRE|\()"
YEAR = r"(?iu)Curso\s+(\d{4}/\d{2,4})"
TERM = r"(?iu)CUATRIMESTRE\s+(\d+º).*?Curso\s+(\d+º)"
GROUP_LINE = r"(?iu)GRUPO\s+([0-9]+º?\s*[A-Z])"
TIME_RANGE = r"(\d{1,2}:\d{2})\s*/\s*(\d{1,2}:\d{2})"

#: Degrees by the code in file names, in catalog order.
CATALOG = (
    ("GISI", "G581", "INGENIERÍA EN SISTEMAS DE INFORMACIÓN"),
    ("GII", "G781", "INGENIERÍA INFORMÁTICA"),
    ("GIT", "G380", "INGENIERÍA TELEMÁTICA"),
    ("GIEC", "G370", "INGENIERÍA ELECTRÓNICA DE COMUNICACIONES"),
    ("GIEAI", "G60", "INGENIERIA EN ELECTRONICA Y AUTOMATICA INDUSTRIAL"),
)


def subject_name(c: Column) -> Column:
    """Without a leading group and room, room, or internal code; null if nothing is left."""
    t = T.clean(c)
    for pattern in (rf"(?iu)^{GROUP}\s*\([^)]+\)\s*", r"^\([^)]+\)\s*", CODE_PREFIX):
        t = F.regexp_replace(t, pattern, "")
    return T.null_if_blank(T.strip_marks(T.clean(t)))


def redirect_notes(t: Column) -> Column:
    return F.transform(F.regexp_extract_all(t, F.lit(REDIRECT), F.lit(0)), T.clean)


def without_redirects(t: Column) -> Column:
    return F.when(t.rlike(REDIRECT), T.clean(F.regexp_replace(t, REDIRECT, " "))).otherwise(t)


# Marks around a match and between its groups, while a text is taken apart; texts that have them take the longer way.
EDGE, GAP = "\x02", "\x01"


def _marked(t: Column, pattern: str) -> Column:
    """The text with its matches between EDGEs, each as three groups and the whole with GAPs: one pass over the text."""
    return F.regexp_replace(t, pattern, f"{EDGE}$1{GAP}$2{GAP}$3{GAP}$0{EDGE}")


def _unmarked(marked: Column, name: int, subgroup: int, room: int) -> Column:
    parts = F.transform(F.filter(F.split(marked, EDGE), lambda x, i: i % 2 == 1), lambda x: F.split(x, GAP))
    return F.transform(parts, lambda p: F.array(p[name - 1], p[subgroup - 1], p[room - 1], p[3]))


def _all(t: Column, pattern: str, name: int, subgroup: int, room: int) -> Column:
    parts = F.arrays_zip(*[F.regexp_extract_all(t, F.lit(pattern), F.lit(i)).alias(f"p{i}") for i in range(4)])
    longer = F.transform(parts, lambda p: F.array(p[f"p{name}"], p[f"p{subgroup}"], p[f"p{room}"], p["p0"]))
    return F.when(F.contains(t, F.lit(EDGE)) | F.contains(t, F.lit(GAP)), longer).otherwise(_unmarked(_marked(t, pattern), name, subgroup, room))


def _one(t: Column, pattern: str, *groups: int | None) -> Column:
    picked = [F.lit(None).cast("string") if g is None else F.regexp_extract(t, pattern, g) for g in groups]
    return F.when(t.rlike(pattern), F.array(F.array(*picked, t))).otherwise(_nothing())


def _nothing() -> Column:
    return F.array().cast("array<array<string>>")

# A match is an array of name, subgroup, room and matched text as they stand in the cell; ``fields`` makes them plain.


def standard(t: Column) -> Column:
    """name - subgroup (room), repeated; of a clean text."""
    return _all(t, STANDARD, 1, 2, 3)


def room_first(t: Column) -> Column:
    """name (room) - subgroup, repeated; of a clean text."""
    return _all(t, ROOM_FIRST, 1, 3, 2)


def group_first(t: Column) -> Column:
    """subgroup (room) name, the whole cell."""
    return _one(t, GROUP_FIRST, 3, 1, 2)


def simple(t: Column) -> Column:
    """name (room), the whole cell."""
    return _one(t, SIMPLE, 1, None, 2)


def fields(match: Column) -> list[Column]:
    part = lambda i: F.get(match, F.lit(i))
    return [subject_name(part(0)).alias("name"), T.group(part(1)).alias("subgroup"), T.classroom(part(2)).alias("room"), T.clean(part(3)).alias("raw_text")]


def subjects(cells: DataFrame, text_col: str = "cell_text") -> DataFrame:
    """A row per subject of each cell: the columns of ``cells``, notes, pos, name, subgroup, room, raw_text. The first
    format with a match counts. A cell in no format gives one row without a name and without notes, so that what is
    known of it isn't lost."""
    base = cells.withColumn("_plain", T.without_time_ranges(F.col(text_col)))
    base = base.withColumn("notes", redirect_notes(F.col("_plain"))).withColumn("_t", without_redirects(F.col("_plain")))
    t, none = F.col("_t"), F.lit(None).cast("string")
    # Both repeated formats need a room and a hyphen; the second needs the hyphen behind the room.
    room, hyphen = F.contains(t, F.lit("(")), F.contains(t, F.lit("-"))
    base = base.withColumn("_found", F.when(room & hyphen, standard(t)).otherwise(_nothing()))
    form = F.when(F.size("_found") > 0, 0).when(room & hyphen & t.rlike(r"\)\s*-") & t.rlike(ROOM_FIRST), 1).when(room & t.rlike(GROUP_FIRST), 2).when(room & t.rlike(SIMPLE), 3)
    base = base.withColumn("_form", form)
    known, f = F.col("_form").isNotNull(), F.col("_form")
    found = F.when(f == 0, F.col("_found")).when(f == 1, room_first(t)).when(f == 2, group_first(t)).when(f == 3, simple(t))
    found = F.coalesce(found, F.array(F.array(none, none, none, F.col(text_col))))
    notes = F.when(known, F.col("notes")).otherwise(F.array().cast("array<string>"))
    rows = base.select(*cells.columns, notes.alias("notes"), F.posexplode(found).alias("pos", "_match"))
    return rows.select(*cells.columns, "notes", "pos", *fields(F.col("_match")))


def degree_from_filename(path: Column) -> Column:
    """struct(name, code) by the first catalog code, longest first, that the folded file name contains; else null."""
    name = T.comparable(F.regexp_extract(path, r"([^/]*)$", 1))
    out = F.lit(None).cast("struct<name:string,code:string>")
    for code, number, title in reversed(sorted(CATALOG, key=lambda x: -len(x[0]))):
        out = F.when(F.contains(name, F.lit(code)), F.struct(F.lit(title).alias("name"), F.lit(number).alias("code"))).otherwise(out)
    return out


def degrees_from_filenames(files: DataFrame, path: str, catalog: DataFrame) -> DataFrame:
    """``files`` with name and code of ``degree_from_filename`` by a catalog of any size: rank, key, code, name, with
    keys folded as file names are, and one row a key. Keys that no name contains give nulls."""
    folded, key = T.free_column(files, "folded"), T.free_column(files, "key")
    named = files.withColumn(folded, T.comparable(F.regexp_extract(F.col(f"`{path}`"), r"([^/]*)$", 1)))
    found = longest_contained(named, folded, catalog.select("key", "rank"), key).drop(folded)
    titles = catalog.select(F.col("key").alias(key), "name", "code")
    return found.join(titles, key, "left").drop(key)


def metadata(text: Column, path: Column) -> Column:
    """Degree, academic year, term, year and group of a page; the degree falls back to the file name."""
    t = T.clean(text)
    found = lambda p, i: T.null_if_blank(F.regexp_extract(t, p, i))
    title = T.null_if_blank(F.upper(T.clean(F.when(t.rlike(DEGREE), F.regexp_extract(t, DEGREE, 1)).otherwise(F.regexp_extract(t, MASTER, 1)))))
    code = F.upper(found(DEGREE, 2))
    guess = degree_from_filename(path)
    number = lambda i: F.translate(F.regexp_extract(t, TERM, i), "º", "").try_cast("int")
    return F.struct(
        F.coalesce(title, guess["name"]).alias("degree_name"),
        F.when(title.isNotNull(), code).otherwise(guess["code"]).alias("degree_code"),
        F.when(title.isNotNull(), "document").when(guess.isNotNull(), "filename").alias("degree_source"),
        T.academic_year(found(YEAR, 1)).alias("academic_year"),
        number(1).alias("semester"),
        number(2).alias("year"),
        T.group(found(GROUP_LINE, 1)).alias("grp"),
    )
