"""Text functions as columns. Missing and empty text are alike (``blank``), as everywhere in this engine."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space but for the plain space, as ranges: every character of every text is looked up.
ODD_SPACE = r"\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: What a browser trims: no control characters but these, and the byte order mark.
BROWSER_SPACE = r"\t-\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Runs of white space that aren't one plain space already.
SPACE = rf" [ {ODD_SPACE}]+|[{ODD_SPACE}][ {ODD_SPACE}]*"


# The Hangul block is laid out by rule: 19 leading consonants, 21 vowels and 27 trailing consonants or none.
HANGUL = ("\uac00", "\ud7a3")
LEADS, VOWELS, TAILS = ("".join(map(chr, range(first, first + n))) for first, n in ((0x1100, 19), (0x1161, 21), (0x11A8, 27)))


def _folding() -> tuple[str, str, dict[str, str]]:
    """Letters that fold to one other, those others, and what the few letters fold to that fold to several; all from
    their canonical decompositions. Hangul is left to ``_jamo``."""
    one, several = {}, {}
    for code in range(0xC0, 0x110000):
        c = chr(code)
        if unicodedata.decomposition(c) and not HANGUL[0] <= c <= HANGUL[1] and unicodedata.category(c) != "Mn":
            base = "".join(p for p in unicodedata.normalize("NFD", c) if unicodedata.category(p) != "Mn")
            if len(base) > 1:
                several[c] = base
            elif base != c:
                one[c] = base
    return "".join(one), "".join(one.values()), several


ACCENTED, PLAIN, SEVERAL = _folding()
RARE = "[" + HANGUL[0] + "-" + HANGUL[1] + "".join(SEVERAL) + "]"


def blank(c: Column) -> Column:
    """Null or empty."""
    return F.coalesce(c, F.lit("")) == ""


def null_if_blank(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column, space: str = " " + ODD_SPACE) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, rf"\A[{space}]+|[{space}]+\z", "")


def clean(c: Column) -> Column:
    """Never null: odd spaces and dashes made plain, runs of space made one, ends trimmed."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), " –—", " --"), SPACE, " "))


def _jamo(c: Column) -> Column:
    """The parts of a Hangul syllable."""
    at = F.ascii(c) - ord(HANGUL[0])
    part = lambda letters, i: F.substring(F.lit(letters), i + 1, F.lit(1))
    tail = F.pmod(at, F.lit(28))
    return F.concat(part(LEADS, F.floor(at / 588)), part(VOWELS, F.floor(F.pmod(at, F.lit(588)) / 28)), F.when(tail > 0, part(TAILS, tail - 1)).otherwise(""))


def fold(c: Column, of: Column | None = None) -> Column:
    """Without accents; never null. ``of`` is what to fold if it is made from ``c`` and has no letters that ``c`` hasn't:
    the kind of text is then told from ``c``. ASCII alone has no accents; letters that fold to several take a way of
    their own."""
    t = F.coalesce(c, F.lit("")) if of is None else of
    several = F.str_to_map(F.lit("\x02".join(f"{c}\x01{base}" for c, base in SEVERAL.items())), F.lit("\x02"), F.lit("\x01"))  # one literal
    letter = lambda x: F.when(x.between(*HANGUL), _jamo(x)).otherwise(F.coalesce(F.try_element_at(several, x), x))
    spread = F.array_join(F.transform(F.regexp_extract_all(t, F.lit("(?s)."), F.lit(0)), letter), "")
    plain = lambda x: F.regexp_replace(F.translate(x, ACCENTED, PLAIN), r"\p{Mn}", "")
    return F.when(c.isNull() | (F.octet_length(c) == F.length(c)), t).when(c.rlike(RARE), plain(spread)).otherwise(plain(t))


def comparable(c: Column) -> Column:
    return F.upper(fold(c, clean(c)))


def searchable(c: Column) -> Column:
    """Of the subject picker: lower case without accents, trimmed as a browser does."""
    return strip(fold(c, F.lower(F.coalesce(c, F.lit("")))), BROWSER_SPACE)


def hour(c: Column) -> Column:
    """HH:MM of H:MM or HH:MM; other text is only cleaned; blank gives null."""
    return F.when(~blank(c), F.regexp_replace(clean(c), r"^(?U)(\d:\d{2})$", "0$1"))


def without_time_ranges(c: Column) -> Column:
    return clean(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\b\d{1,2}:\d{2}\s*/\s*\d{1,2}:\d{2}\b", " "))


def academic_year(c: Column) -> Column:
    """YYYY/YYYY of YYYY/YY by the first year's century; what follows a match is dropped; blank gives null."""
    pattern = r"^(\d{4})/(\d{2,4})"

    def whole(t: Column) -> Column:
        first, second = (F.regexp_extract(t, pattern, i).try_cast("int") for i in (1, 2))
        short = F.length(F.regexp_extract(t, pattern, 2)) == 2
        full = F.concat_ws("/", first.cast("string"), F.when(short, F.floor(first / 100).cast("int") * 100 + second).otherwise(second).cast("string"))
        return F.when(t.rlike(pattern), full).otherwise(t)

    return F.when(~blank(c), let(clean(c), whole))


def group(c: Column) -> Column:
    return F.when(~blank(c), F.translate(comparable(c), "º ", ""))


def classroom(c: Column) -> Column:
    joined = F.regexp_replace(clean(c), r"(?U)\b([A-Za-z]{1,3})\s+(\d+)\b", "$1$2")
    return F.when(~blank(c), F.upper(joined))


def strip_marks(c: Column) -> Column:
    """Without spaces, hyphens and stars at either end."""
    return F.regexp_replace(c, r"^[ \-*]+|[ \-*]+$", "")


def subject(c: Column) -> Column:
    return F.when(~blank(c), F.upper(strip_marks(clean(c))))


def minutes(c: Column) -> Column:
    """Minutes of ``int:int``; null for anything else. Hours and minutes are not bounded."""
    parts = F.split(c, ":")
    return F.when(F.size(parts) == 2, F.get(parts, F.lit(0)).try_cast("int") * 60 + F.get(parts, F.lit(1)).try_cast("int"))


def next_hour(c: Column) -> Column:
    """The same minute an hour later, two digits each at least; hours are not bounded."""
    part = lambda i: F.get(F.split(c, ":"), F.lit(i)).try_cast("int")
    return F.when(part(0).isNotNull() & part(1).isNotNull(), F.format_string("%02d:%02d", part(0) + 1, part(1)))


def stamp(moment: Column) -> Column:
    """A time as the result documents have it."""
    return F.date_format(moment, "yyyy-MM-dd HH:mm:ss")


def notes_of(c: Column) -> Column:
    """Non-empty lines of a text, trimmed as a browser does."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: strip(x, BROWSER_SPACE)), lambda x: x != "")


def escape_html(c: Column) -> Column:
    out = F.coalesce(c, F.lit(""))
    for plain, mark in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(plain), F.lit(mark))
    return out


def item_id(origin: Column, file: Column, page: Column, seq: Column) -> Column:
    """First letter of the origin and 20 digits of a SHA-1 over all four; missing parts read None."""
    raw = F.concat_ws("|", origin, F.coalesce(file, F.lit("None")), F.coalesce(page.cast("string"), F.lit("None")), seq.cast("string"))
    return F.concat(F.when(origin == "accepted", "a").otherwise("r"), F.substring(F.sha1(raw.cast("binary")), 1, 20))


def free_column(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken, name = {c.lower() for c in df.columns}, f"_{stem}"
    while name.lower() in taken:
        name += "_"
    return name
