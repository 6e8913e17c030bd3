"""Text functions. Missing values are empty strings at every boundary; white space is Unicode's."""

from __future__ import annotations

from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .columns import let
from .lexicon import NULL_WORDS

SPACE = r"(?U)[\s\x1C-\x1F]+"


def text_of(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(text_of(c), r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def squeeze(c: Column) -> Column:
    """White space runs to one space, ends cut."""
    return strip(F.regexp_replace(text_of(c), SPACE, " "))


def normal(c: Column) -> Column:
    return squeeze(F.lower(text_of(c)))


def meaningful(c: Column) -> Column:
    """Squeezed text; words that stand for nothing become empty."""
    return let(squeeze(c), lambda s: F.when(F.lower(s).isin(NULL_WORDS), "").otherwise(s))


@F.pandas_udf(StringType())
def unescaped(s: pd.Series) -> pd.Series:
    """HTML character references decoded; Spark has no built-in for them."""
    return s.map(lambda x: unescape(x) if x is not None and "&" in x else x)


def plain(c: Column) -> Column:
    """References decoded, tags to spaces, squeezed."""
    return squeeze(F.regexp_replace(unescaped(text_of(c)), r"<[^>]+>", " "))


def shorten(c: Column, limit: int) -> Column:
    """At most ``limit`` characters, three dots at a cut."""
    cut = F.regexp_replace(F.left(c, F.lit(limit - 3)), r"(?U)[\s\x1C-\x1F]+$", "")
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(cut, F.lit("...")))


def escape_html(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def present(*columns: Column) -> Column:
    """The first that is neither null nor empty, nor an empty JSON container; else empty."""
    return F.coalesce(F.get(F.filter(F.array(*[text_of(c) for c in columns]), lambda x: ~x.isin("", "[]", "{}")), F.lit(0)), F.lit(""))


def stated(c: Column, default: str) -> Column:
    """Stripped text, or the default where there is none."""
    return let(strip(c), lambda s: F.when(s == "", default).otherwise(s))


def title_case(c: Column) -> Column:
    return F.initcap(c)


def percent(c: Column, keep_slash: bool = False) -> Column:
    """RFC 3986 percent-encoding; the built-in encodes forms."""
    out = F.url_encode(text_of(c))
    for form, plain_ in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), *[("%2F", "/")] * keep_slash):
        out = F.replace(out, F.lit(form), F.lit(plain_))
    return out
