"""Feed items from RSS documents: Spark's XML parser reads the items, the first 20 of each feed count before blanks go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions.text import plain, strip

ITEM = "struct<channel:struct<item:array<struct<title:string,link:string,description:string,pubDate:string>>>>"
ITEMS_PER_FEED = 20


def feed_items(feeds: DataFrame, xml: str = "xml", limit: int = ITEMS_PER_FEED) -> DataFrame:
    """Other columns of ``feeds`` with pos, title, url, snippet and published of each item."""
    items = F.slice(F.from_xml(xml, ITEM)["channel"]["item"], 1, limit)
    keep = [c for c in feeds.columns if c != xml]
    rows = feeds.select(*keep, F.posexplode(items).alias("pos", "item"))
    return rows.select(*keep, "pos", plain(F.col("item.title")).alias("title"), strip(F.col("item.link")).alias("url"), plain(F.col("item.description")).alias("snippet"), strip(F.col("item.pubDate")).alias("published")).where("title <> '' and url <> ''")
