"""Line removal by site-relative frequency, with DataFrame functions only.

Rows are grouped by host. A line's ratio is the pages of its host that contain it, divided by all pages
of that host; lines whose ratio is above ``max_ratio``, on at least ``min_pages`` pages, are boilerplate and
are dropped from every page of that host. Lines are compared without surrounding blanks; lines without
anything else are kept and never counted. A page counts once for each line, however often it has it.

A line's key is two 64-bit hashes, so the shuffles carry 16 bytes and a host for each line, counted
before it is sent; a hot host spreads over its lines. A host's boilerplate list is bounded: its lines all
have a ratio above ``max_ratio``, so there are fewer than (lines a page) / ``max_ratio`` of them. The list
is joined to the pages by host: by broadcast where its counted rows prove it small, else by an
equi-join whose hot partitions Spark splits. Tables by host are written before they are joined, as Spark splits only
partitions that were shuffled for the join alone.

Null hosts form one host of their own; null texts stay null and have no lines; an empty text stays
empty. Repeated rows count as pages each. Names that begin with ``pw_`` are reserved, other columns are
kept. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweft.runtime import discard, materialize

BLANKS = " \t\r\x0b\x0c"
#: Boilerplate lines that a broadcast may hold: at most some 4 MB.
BROADCAST_LINES = 100_000


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(BLANKS))
    return F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit(1), bare).alias("b"))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def has_content(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS)) != ""


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^ \t\r\n\x0b\x0c]+"))


def host_key(host: Column) -> Column:
    return F.coalesce(F.concat(F.lit("host:"), host.cast("string")), F.lit("none"))


def boilerplate(pages: DataFrame, out_dir: str, *, host_col: str, text_col: str, max_ratio: float = 0.1, min_pages: int = 5) -> DataFrame:
    """pw_host, a, b (the line's key), n_pages and ratio of each boilerplate line."""
    own = pages.select(host_key(F.col(host_col)).alias("pw_host"), F.col(text_col).cast("string").alias("pw_text"))
    totals = materialize(own.groupBy("pw_host").agg(F.count("*").alias("pw_pages")), f"{out_dir}/hosts")
    keys = F.array_distinct(F.transform(F.filter(lines_of(F.col("pw_text")), has_content), line_key))
    counts = own.select("pw_host", F.explode(keys).alias("k")).groupBy("pw_host", "k.a", "k.b").agg(F.count("*").alias("n_pages")).filter(F.col("n_pages") >= min_pages)
    ratio = F.col("n_pages") / F.col("pw_pages")
    return counts.join(totals, "pw_host").withColumn("ratio", ratio).filter(F.col("ratio") > max_ratio).drop("pw_pages")


def drop_boilerplate(pages: DataFrame, out_dir: str, *, host_col: str = "source", text_col: str = "text", max_ratio: float = 0.1, min_pages: int = 5, keep_whole: bool = False) -> DataFrame:
    """All columns, the text without its host's boilerplate lines, and pw_lines and pw_dropped: lines with
    content before, and those dropped. With ``keep_whole``, a page that would lose most of its words stays
    as it is: furniture of a site rarely makes up most of a page, but the lines of a page with many copies or near copies are frequent themselves."""
    found = boilerplate(pages, out_dir, host_col=host_col, text_col=text_col, max_ratio=max_ratio, min_pages=min_pages)
    found = materialize(found, f"{out_dir}/boilerplate")
    lists = materialize(found.groupBy("pw_host").agg(F.collect_list(F.struct("a", "b")).alias("pw_bad")), f"{out_dir}/lists")
    if found.count() <= BROADCAST_LINES:
        lists = F.broadcast(lists)
    for part in ("hosts", "boilerplate"):
        discard(pages.sparkSession, f"{out_dir}/{part}")
    marked = pages.withColumn("pw_host", host_key(F.col(host_col))).join(lists, "pw_host", "left").drop("pw_host")
    text = F.col(text_col).cast("string")
    left = F.when(F.col("pw_bad").isNull(), lines_of(text)).otherwise(F.filter(lines_of(text), lambda x: ~(has_content(x) & F.array_contains(F.col("pw_bad"), line_key(x)))))
    marked = marked.withColumn("pw_left", left)
    if keep_whole:
        kept, total = n_words(F.array_join("pw_left", "\n")), n_words(text)
        marked = marked.withColumn("pw_left", F.when((F.size("pw_left") < F.size(lines_of(text))) & (2 * kept < total), lines_of(text)).otherwise(F.col("pw_left")))
    n = F.coalesce(F.size(F.filter(lines_of(text), has_content)), F.lit(0)).cast("long")
    marked = marked.withColumn("pw_lines", F.when(text.isNull(), F.lit(0).cast("long")).otherwise(n))
    marked = marked.withColumn("pw_dropped", F.when(text.isNull(), F.lit(0).cast("long")).otherwise((F.size(lines_of(text)) - F.size("pw_left")).cast("long")))
    return marked.withColumn(text_col, F.when(F.col("pw_dropped") > 0, F.array_join("pw_left", "\n")).otherwise(text)).drop("pw_bad", "pw_left")
