"""URL functions as columns."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .markup import link_targets
from .text import free_column, strip

#: Endings of links that are never followed.
SKIPPED = ("jpg", "jpeg", "png", "gif", "svg", "webp", "css", "js", "zip", "rar", "7z", "doc", "docx", "xls", "xlsx", "ppt", "pptx")
SPLIT = r"^(?i)(https?)://([^/?#]*)([^?#]*)(\?[^#]*)?"


def written(url: Column) -> Column:
    """A url as it is meant: without white space and control characters before it, white space after it, and tabs and
    line breaks inside."""
    return F.regexp_replace(strip(url), r"\A[\x00-\x20]+|[\t\r\n]", "")


def normalize(url: Column) -> Column:
    """Without fragment, scheme and host in lower case, at least "/" as path, no mark of an empty query or of empty
    parameters; null if it isn't http or https."""
    t = written(url)
    part = lambda i: F.regexp_extract(t, SPLIT, i)
    path = F.when(part(3) == "", "/").otherwise(F.regexp_replace(part(3), r"(/[^/;]*);\z", "$1"))
    query = F.when(part(4) == "?", "").otherwise(part(4))
    return F.when(t.rlike(SPLIT), F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), path, query))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, SPLIT, 2))


def path(url: Column) -> Column:
    """Without the parameters of its last part, which follow a semicolon."""
    return F.regexp_replace(F.regexp_extract(url, SPLIT, 3), r";[^/]*\z", "")


def is_pdf(url: Column) -> Column:
    """By the path alone."""
    return F.endswith(F.lower(path(url)), F.lit(".pdf"))


def is_skipped(url: Column, domain: Column) -> Column:
    """Another scheme or host, or a url that ends, query included, in one of SKIPPED."""
    ending = r"(?i)\.(" + "|".join(SKIPPED) + ")$"
    return ~url.rlike(r"^(?i)https?://") | (host(url) != F.lower(domain)) | url.rlike(ending)


def without_dots(path: Column) -> Column:
    """A path from the root without its dot segments, whatever their number: a segment is kept, "." goes, ".." takes the
    last one back, and none climbs above the root. A path that ends in a dot segment ends in a slash."""
    parts = F.split(path, "/")
    kept = F.aggregate(
        F.slice(parts, F.lit(2), F.size(parts)),
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.array_append(acc, x)),
    )
    out = F.concat(F.lit("/"), F.array_join(kept, "/"))
    return F.when(path.rlike(r"/\.\.?$") & (F.size(kept) > 0), F.concat(out, F.lit("/"))).otherwise(out)


def resolve(base: Column, href: Column) -> Column:
    """``href`` as seen from ``base``: absolute, scheme-relative, root-relative, fragment, query or sibling links;
    dot segments of links that aren't whole urls are taken out."""
    scheme, place, folder = F.regexp_extract(base, SPLIT, 1), F.regexp_extract(base, SPLIT, 2), F.regexp_extract(base, r"^(?i)https?://[^/?#]*([^?#]*/)", 1)
    own = F.regexp_extract(base, r"^([^?#]*)", 1)
    target, rest = F.regexp_extract(href, r"^([^?#]*)", 1), F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    below = F.regexp_replace(F.concat(F.when(folder == "", "/").otherwise(folder), target), "/{2,}", "/")  # as joined urls are
    whole = F.when(F.startswith(target, F.lit("/")), target).otherwise(below)
    joined = F.concat(scheme, F.lit("://"), place, F.when(whole.rlike(r"/\.\.?(/|$)"), without_dots(whole)).otherwise(whole), rest)
    return (
        F.when(href.rlike(r"^(?i)[a-z][a-z0-9+.\-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, F.lit(":"), href))
        .when(F.startswith(href, F.lit("#")) | href.isin("", "?") | F.startswith(href, F.lit("?#")), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), F.regexp_replace(href, r"\A\?", "")))
        .when(F.startswith(href, F.lit("?")), F.concat(own, href))
        .otherwise(joined)
    )


REFERENCE = r"&(#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);"


def unescape(c: Column) -> Column:
    """Text with its character references (names of HTML 4, decimal and hexadecimal numbers) as characters; unknown
    ones stay."""
    names = F.create_map(*[F.lit(x) for name, code in sorted(name2codepoint.items()) for x in (name, chr(code))])

    def one(ref: Column) -> Column:
        number = F.when(ref.rlike("^#[xX]"), F.conv(F.substring(ref, F.lit(3), F.lit(6)), 16, 10)).otherwise(F.substring(ref, F.lit(2), F.lit(7))).try_cast("int")
        letter = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        real = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        return F.coalesce(F.when(F.startswith(ref, F.lit("#")), F.when(real, letter)).otherwise(F.try_element_at(names, ref)), F.concat(F.lit("&"), ref, F.lit(";")))

    plain = F.split(c, REFERENCE)
    refs = F.regexp_extract_all(c, F.lit(REFERENCE), F.lit(1))
    pieces = F.zip_with(plain, refs, lambda t, ref: F.concat(t, F.coalesce(one(ref), F.lit(""))))
    return F.when(F.contains(c, F.lit("&")), F.array_join(pieces, "")).otherwise(c)


def hrefs(html: Column) -> Column:
    """The targets of all links with their character references resolved; what stands in comments, scripts, styles and
    other attributes is none."""
    return F.transform(link_targets(html), unescape)


def extract_links(pages: DataFrame) -> DataFrame:
    """(page_id, link): the distinct absolute links of each page of (page_id, url, html)."""
    raw = pages.select("page_id", "url", F.explode(hrefs(F.col("html"))).alias("href")).withColumn("href", strip(F.col("href"))).where("href <> ''")
    return raw.select("page_id", normalize(resolve(written(F.col("url")), written(F.col("href")))).alias("link")).where("link is not null").distinct()


def content_kind(content_type: Column) -> Column:
    """What a response is taken for: pdf, html or skip."""
    t = F.lower(F.coalesce(content_type, F.lit("")))
    return F.when(F.contains(t, F.lit("application/pdf")), "pdf").when(F.contains(t, F.lit("text/html")) | F.contains(t, F.lit("application/xhtml")), "html").otherwise("skip")


def safe_filename(url: Column) -> Column:
    """The last part of the path if it ends in .pdf, else host and path with odd characters as "_"; percent-decoded, odd
    characters as "_", ending in .pdf."""
    place, whole = F.regexp_extract(url, SPLIT, 2), path(url)
    base = F.regexp_extract(whole, r"([^/]*)$", 1)
    made = F.concat(F.regexp_replace(F.regexp_replace(F.concat(place, whole), r"[^a-zA-Z0-9._\-]", "_"), r"^_+|_+$", ""), F.lit(".pdf"))
    chosen = F.when(F.endswith(F.lower(base), F.lit(".pdf")), base).otherwise(made)
    # "+" stays itself, and so does a percent sign without two hexadecimal digits.
    encoded = F.regexp_replace(F.replace(chosen, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    name = F.regexp_replace(F.url_decode(encoded), r"(?U)[^\w.\-]", "_")
    return F.when(F.endswith(F.lower(name), F.lit(".pdf")), name).otherwise(F.concat(name, F.lit(".pdf")))


FAMILY = r"^(.*?)((?:_\d+)*)(\.[^.]*)?$"


def unique_filenames(files: DataFrame, name: str, order: str) -> DataFrame:
    """In the given order a name that is taken gets _1, _2, ... before its ending, the first that is free.

    Names can only clash with names of their family: those that differ in numbers at the end alone. Rows of a family
    pass one task in order, one at a time; it keeps the family's names and nothing else."""
    family = free_column(files, "family")
    schema = files.schema

    def name_them(batches):
        now, taken, last = None, set(), {}
        for batch in batches:
            out = []
            for of, wanted in zip(batch[family], batch[name]):
                if of != now:
                    now, taken, last = of, set(), {}
                if wanted is None:
                    out.append(None)
                    continue
                stem, dot, end = wanted.rpartition(".")
                stem, end = (stem, dot + end) if stem else (wanted, "")
                free, n = wanted, last.get(wanted, 0)
                while free in taken:
                    n += 1
                    free = f"{stem}_{n}{end}"
                last[wanted] = n
                taken.add(free)
                out.append(free)
            yield batch.assign(**{name: out}).drop(columns=[family])

    key = F.concat_ws("/", F.regexp_extract(F.col(name), FAMILY, 1), F.regexp_extract(F.col(name), FAMILY, 3))
    dealt = files.withColumn(family, key).repartition(family).sortWithinPartitions(family, order)
    return dealt.mapInPandas(name_them, schema)
