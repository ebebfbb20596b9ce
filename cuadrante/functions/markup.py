"""Links of a page by its tokens, in the states of the HTML standard: text, tag, attribute, comment, raw text.

One pattern takes the next token wherever the last one ended, so what looks like a tag within a comment, a script or an
attribute's value is never taken for one. All loops are possessive: a page is read once, without going back, and the
depth of the stack doesn't grow with it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[\t\n\f\r ]"
#: Elements whose content is text up to their own end tag.
RAW = "script|style|textarea|title|xmp|iframe|noembed|noframes"


def attribute(group: str) -> str:
    """One attribute of a tag: name, and value in double quotes, single quotes or none; ``group`` opens these four. A
    quote that isn't closed reaches to the end of the page."""
    value = rf"""(?:"{group}[^"]*+)(?:"|\z)|'{group}[^']*+)(?:'|\z)|{group}[^\t\n\f\r >]*+))"""
    return rf"[\t\n\f\r /]*+{group}[^\t\n\f\r />][^\t\n\f\r />=]*+)(?:{BLANK}*+={BLANK}*+{value})?+"


REST = rf"(?:{attribute('(?:')})*+"  # a tag's attributes
CLOSE = r"[\t\n\f\r /]*+>"
AFTER_NAME = r"(?=[\t\n\f\r />])"
#: Group 1 holds the attributes of a link's tag. A tag that the page's end cuts off is none, and nothing follows it.
TOKEN = (
    rf"(?is)<(?:a{AFTER_NAME}({REST}){CLOSE}"
    r"|!--(?:-?>|.*?(?:--!?>|\z))"
    r"|[!?][^>]*+(?:>|\z)|/(?![a-z])[^>]*+(?:>|\z)"
    rf"|({RAW}){AFTER_NAME}{REST}{CLOSE}.*?(?:(?=</\2{AFTER_NAME})|\z)"
    rf"|plaintext{AFTER_NAME}{REST}{CLOSE}.*+"
    rf"|/?[a-z][^\t\n\f\r />]*+{REST}{CLOSE}"
    r"|/?[a-z].*+)"
)
ATTRIBUTE = "(?is)" + attribute("(")


def link_targets(html: Column) -> Column:
    """The href of every link in order, as written: character references and white space stay. Of an attribute that a
    tag has twice the last one counts. Null and empty pages have none; a link without the attribute gives nothing."""
    tags = F.filter(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(TOKEN), F.lit(1)), lambda x: F.contains(F.lower(x), F.lit("href")))

    def target(tag: Column) -> Column:
        parts = F.arrays_zip(*[F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(i)).alias(f"k{i}") for i in range(1, 5)])
        own = F.filter(parts, lambda x: F.lower(x["k1"]) == "href")
        return F.get(F.transform(own, lambda x: F.concat(x["k2"], x["k3"], x["k4"])), F.size(own) - 1)

    return F.filter(F.transform(tags, target), lambda x: x.isNotNull())
