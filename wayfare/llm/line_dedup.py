"""Boilerplate removal by the number of sites that carry a line.

Every line's sites go into a HyperLogLog sketch, merged by Spark's aggregation. Lines whose
estimate is clear of the threshold are decided by it; the few near the threshold get an exact
distinct count. Boilerplate lines are then taken out of every document but those that consist
mostly of such lines: these are copies of a document, which is whole-document deduplication's to
decide, and would lose their text everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.session import stage

#: Distinct sites from which on a line is boilerplate.
MIN_SITES = 5
#: Sketches have 2 ** LOG_K registers; their standard error is about 1.04 / sqrt(2 ** LOG_K).
LOG_K = 10
#: Estimates within this many standard errors, or one site, of the threshold are counted exactly.
ERRORS = 6
#: A document with a greater share of boilerplate characters is left whole.
MOST_REMOVED = 0.5

_WORD = r"[^\x20\x09-\x0D]"


def _hashes(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("line"), line).alias("h2")]


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, site, h1, h2 of the distinct lines with a word of every text. Two hashes of 64 bits
    stand for a line."""
    lines = F.array_distinct(F.split(F.col("text").cast("string"), "\n"))
    found = docs.select("doc_id", F.col("site").cast("string"), F.explode(lines).alias("line"))
    return found.where(F.col("line").rlike(_WORD)).select("doc_id", "site", *_hashes(F.col("line")))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """h1, h2 of the lines on ``min_sites`` distinct sites or more; a null site is none."""
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LOG_K)).alias("sites"))
    margin = max(1.0, ERRORS * 1.04 / 2 ** (LOG_K / 2) * min_sites)
    # Most lines are far below; the others are few, and read twice.
    spread = stage(spread.where(F.col("sites") >= min_sites - margin), "line-spread")
    clear = spread.where(F.col("sites") > min_sites + margin).select("h1", "h2")
    near = spread.where(F.col("sites") <= min_sites + margin).select("h1", "h2")
    counted = lines.join(near, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.countDistinct("site").alias("n"))
    return clear.unionByName(counted.where(F.col("n") >= min_sites).select("h1", "h2"))


def _flagged(docs: DataFrame, site: str, min_sites: int) -> DataFrame:
    """``docs`` with __lines, its lines, and __removed, a boolean for each."""
    lines = _lines(docs.select("doc_id", F.col(site).alias("site"), "text"))
    found = stage(boilerplate(lines, min_sites), "boilerplate")
    keys = [F.coalesce(F.col("doc_id"), F.lit(0)).alias("__id"), F.col("doc_id").isNull().alias("__none")]
    marks = lines.join(found, ["h1", "h2"]).groupBy(*keys).agg(F.collect_set("h1").alias("__marks"))
    keyed = docs.select("*", *keys)
    joined = keyed.join(marks, ["__id", "__none"], "left").drop("__id", "__none")
    joined = joined.withColumn("__lines", F.split(F.col("text").cast("string"), "\n"))
    hit = F.transform(
        "__lines", lambda x: x.rlike(_WORD) & F.array_contains("__marks", F.xxhash64(x))
    )
    joined = joined.withColumn("__hit", F.when(F.col("__marks").isNotNull(), hit))
    sizes = F.zip_with("__lines", "__hit", lambda x, h: F.when(h, F.length(x)).otherwise(0))
    gone = F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x)
    all_chars = F.length("text") - F.size("__lines") + 1
    few = F.coalesce(gone <= MOST_REMOVED * all_chars, F.lit(False))
    joined = joined.withColumn("__whole", ~few & F.coalesce(F.exists("__hit", lambda h: h), F.lit(False)))
    return joined.withColumn("__removed", F.when(few, F.col("__hit")))


def _kept_text() -> Column:
    numbered = F.zip_with("__lines", "__removed", lambda x, r: F.struct(x.alias("line"), r.alias("gone")))
    kept = F.transform(F.filter(numbered, lambda x: ~x["gone"]), lambda x: x["line"])
    return F.when(F.col("__removed").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))


def line_report(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """What boilerplate removal does to every document.

    Returns doc_id, n_lines, n_removed, left_whole, text_sha256 (of the text that remains): one row
    per input row. Lines are those between line ends; only lines with a word can be removed. A null
    text counts as empty, with one line and nothing removed; a null site is no site. Rows that
    share a doc_id, null or not, are handled alike but each by its own lines. Other columns are
    ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = docs.select(F.col("doc_id").cast("long"), F.col(site).cast("string").alias("site"), text.alias("text"))
    found = _flagged(narrow, "site", min_sites)
    return found.select(
        "doc_id",
        F.size("__lines").cast("long").alias("n_lines"),
        F.when(F.col("__removed").isNotNull(), F.size(F.filter("__removed", lambda r: r))).otherwise(0).cast("long").alias("n_removed"),
        F.col("__whole").alias("left_whole"),
        F.sha2(_kept_text(), 256).alias("text_sha256"),
    )


def drop_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` without boilerplate lines in ``text``; n_chars, where there is one, is set anew.

    All rows and columns stay; a null text stays null.
    """
    found = _flagged(docs, site, min_sites).withColumn("__kept", _kept_text())
    changed = {"text": F.col("__kept")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("__removed").isNull(), F.col("n_chars")).otherwise(F.length("__kept"))
    kinds = dict(docs.dtypes)
    return found.select(*[changed.get(c, F.col(c)).cast(kinds[c]).alias(c) for c in docs.columns])
