"""Line de-duplication by site-relative frequency, with DataFrame functions only.

A line is boilerplate where the share of its host's pages that contain it
exceeds a ratio.  Each host has fewer than (mean distinct lines of a page) /
ratio such lines, so their hashes fit one array a host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: Share of a host's pages beyond which a line is dropped, and the fewest pages it must be on.
RATIO, LEAST_PAGES = 0.02, 5
#: Line hashes (8 bytes each) up to which hosts' arrays are broadcast; beyond, pages are salted and shuffled.
BROADCAST_HASHES = 2_000_000
SALTS = 64


def _key(line: Column) -> Column:
    """What makes lines equal: their characters without blanks at the ends.  Null for a blank line."""
    bare = F.trim(line, F.lit(" \t\r"))
    return F.when(bare != "", F.xxhash64(bare))


def boilerplate_lines(docs: DataFrame, *, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES, copies_once: bool = False) -> DataFrame:
    """``host, bad``: hashes of the lines on more than ``ratio`` of the host's pages, and on ``least_pages``.

    With ``copies_once``, a host's pages of the same lines count as one page.
    """
    pages = docs.select(F.col(host_col).alias("host"), F.col(text_col).alias("text")).where("host is not null")
    keys = F.array_distinct(F.transform(F.split("text", "\n", -1), _key))
    if copies_once:
        pages = pages.select("host", F.array_sort(keys).alias("keys")).distinct()
        keys = F.col("keys")
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    lines = pages.select("host", F.explode(keys).alias("line")).where("line is not null")
    counts = lines.groupBy("host", "line").agg(F.count("*").alias("on")).where(F.col("on") >= least_pages)
    often = counts.join(totals, "host").where(F.col("on") > F.lit(ratio) * F.col("pages"))
    return often.groupBy("host").agg(F.collect_list("line").alias("bad"))


def drop_boilerplate(docs: DataFrame, *, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES, broadcast_hashes: int = BROADCAST_HASHES, copies_once: bool = False) -> DataFrame:
    """``row`` (a document's row as it was, whatever its columns), ``text`` without boilerplate lines, ``n_lines``, ``n_dropped``.

    Blank lines and pages without a host stay as they are; a null text stays
    null with 0 lines; a page of boilerplate alone becomes an empty text.
    Repeated rows count as pages of their own, unless ``copies_once``: then a
    page's copies on its host can't make its lines boilerplate.
    """
    bad = cut(boilerplate_lines(docs, host_col=host_col, text_col=text_col, ratio=ratio, least_pages=least_pages, copies_once=copies_once))
    size = bad.agg(F.sum(F.size("bad"))).first()[0] or 0
    rows = docs.select(F.struct("*").alias("row"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    if size <= broadcast_hashes:
        joined = rows.join(F.broadcast(bad), "host", "left")
    else:
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("text"), F.lit(SALTS)))
        joined = salted.join(bad.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "salt"], "left")
    lines = F.split("text", "\n", -1)
    kept = F.filter(lines, lambda x: ~F.coalesce(F.array_contains("bad", _key(x)), F.lit(False)))
    parts = joined.select("row", "text", F.when(F.col("bad").isNotNull(), kept).alias("kept"), F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"))
    dropped = F.when(F.col("kept").isNull(), 0).otherwise(F.col("n_lines") - F.size("kept")).cast("long")
    counted = parts.withColumn("n_dropped", dropped)
    return counted.select("row", F.when(F.col("n_dropped") > 0, F.array_join("kept", "\n")).otherwise(F.col("text")).alias("text"), "n_lines", "n_dropped")
