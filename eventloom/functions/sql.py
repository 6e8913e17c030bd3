"""Names that SQL can call: functions of texts, addresses and JSON-LD, and a page's links as a table.

    register(spark)
    spark.sql("select p.url, l.href from pages p, lateral extract_links(p.html, p.url) l where l.label <> ''")
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from eventloom.functions import html as H
from eventloom.functions.jsonld import _typed
from eventloom.functions.urls import _joined, _resolved

LINKS = "pos int, href string, url string, label string, context string"


class ExtractLinks:
    """A row a link of a page: its place, its address as written and resolved, its text and that of its container."""

    def eval(self, html: str | None, base: str | None) -> Iterator[tuple]:
        for pos, x in enumerate(H.parse(html)["links"]):
            yield pos, x["href"], _joined(base, x["href"]), x["text"], x["context"]


def _plain(texts: pd.Series) -> pd.Series:
    """References decoded, tags to spaces, white space squeezed."""
    return texts.map(lambda t: None if t is None else " ".join(re.sub(r"<[^>]+>", " ", unescape(t)).split()))


def register(spark: SparkSession) -> None:
    """Register ``extract_links``, ``absolute_url``, ``plain_text`` and ``jsonld_objects`` in the session."""
    spark.udtf.register("extract_links", F.udtf(ExtractLinks, returnType=LINKS))
    spark.udf.register("absolute_url", F.pandas_udf(_resolved, "string"))
    spark.udf.register("jsonld_objects", F.pandas_udf(_typed, "array<map<string,string>>"))

    spark.udf.register("plain_text", F.pandas_udf(_plain, "string"))
