"""What five filters remove in every order they can be applied in.

A document is reduced to the set of filters it fails, and documents of a part to counts by that set.
In lexicographic order the 120 permutations that begin with the same letters have neighbouring
ranks, so a failing set is removed at a step by a given filter in a few intervals of ranks: those of
the beginnings whose last letter, and no earlier one, is in the set. Counts are added at the start of
an interval and taken off behind its end; a running sum over the ranks then gives every permutation.
Only counts by part and set are ever shuffled beyond the check for equal texts.
"""

from __future__ import annotations

from functools import reduce
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfare.session import stage

FILTERS = "ABCDE"
ORDERS = factorial(len(FILTERS))
#: Groups of equal texts that are handed to every task at most, 40 bytes each.
MOST_LARGE = 10_000

_SPACES = r"[\x20\x09-\x0D]+"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def failing(text: Column, words: Column) -> dict[str, Column]:
    """Whether a text, of these words, fails each filter that looks at the text alone."""
    n, different, size = F.size(words), F.size(F.array_distinct(words)), F.length(text)
    capitals = size - F.length(F.translate(text, _CAPITALS, ""))
    return {
        "A": n < 100,
        "B": different * 100 < n * 80,
        "C": capitals * 100 > size * 10,
        "D": text.rlike(r"[#$%&*|]"),
    }


def failed_sets(docs: DataFrame) -> DataFrame:
    """doc_id, part and mask of every row: bit i of mask tells that filter i of FILTERS fails.

    E fails where a smaller doc_id has the same text, told by SHA-256. A null text counts as empty,
    a null lang as part ''; a null doc_id is not smaller than any and has none smaller.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    part = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    read = docs.select(F.col("doc_id").cast("long"), part.alias("part"), text.alias("text"))
    read = read.withColumn("words", F.filter(F.split("text", _SPACES), lambda w: w != ""))
    found = failing(F.col("text"), F.col("words"))
    mask = sum((c.cast("int") * 2**i for i, c in enumerate(found.values())), F.lit(0))
    judged = read.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    # Read twice below; a digest and three small values are left of each text.
    judged = stage(judged, "failed-filters")
    # Texts that stand alone need not meet their group again.
    first = judged.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    first = stage(first.where("last > first").select("digest", "first", "n"), "first-copies")
    # A group this large can only be one of MOST_LARGE: those are handed to every task, and their members
    # go to the other groups' join under keys of their own, which match nothing.
    large = max(1, judged.count() // MOST_LARGE)
    known = F.broadcast(first.where(F.col("n") > large).select("digest", F.col("first").alias("known")))
    own = F.concat("digest", F.encode(F.col("doc_id").cast("string"), "utf-8"))
    judged = judged.join(known, "digest", "left")
    judged = judged.withColumn("digest", F.when(F.col("known").isNull(), F.col("digest")).otherwise(F.coalesce(own, F.col("digest"))))
    joined = judged.join(first.where(F.col("n") <= large).select("digest", "first"), "digest", "left")
    again = F.coalesce(F.col("doc_id") > F.coalesce("known", "first"), F.lit(False))
    return joined.select("doc_id", "part", (F.col("mask") + again.cast("int") * 2 ** FILTERS.index("E")).alias("mask"))


def label_flags(labels: DataFrame) -> DataFrame:
    """doc_id, good, toxic: whether any row of a document says quality 1, toxic 1."""
    flags = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    said = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    return flags.agg(said("quality").alias("good"), said("toxic").alias("toxic"))


def counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents by part and failing set, those labelled so among them."""
    sets = failed_sets(docs).join(label_flags(labels), "doc_id", "left")
    flag = lambda c: F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c)
    return sets.groupBy("part", "mask").agg(F.count("*").alias("n"), flag("good"), flag("toxic"))


def _beginnings(spark: SparkSession) -> list[DataFrame]:
    """For each step, the beginnings of that length: used (bits of all letters but the last), next (the
    last one), start (of its interval of ranks), spelled. 325 rows in all."""
    n = len(FILTERS)
    grown = spark.range(0, 1, 1, 1).selectExpr("0 AS used", "0L AS start", "'' AS spelled")
    levels = []
    for step in range(1, n + 1):
        letters = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("next")
        grown = grown.select("used", "start", "spelled", letters).where("shiftright(used, next) & 1 = 0")
        # A letter's digit in the Lehmer code: how many smaller letters are still to come.
        digit = F.col("next") - F.expr("bit_count(used & (shiftleft(1, next) - 1))")
        letter = F.substr(F.lit(FILTERS), F.col("next") + 1, F.lit(1))
        grown = grown.select(
            "used", "next", (F.col("start") + digit * factorial(n - step)).alias("start"), F.concat("spelled", letter).alias("spelled")
        )
        levels.append(grown)
        grown = grown.select(F.expr("used | shiftleft(1, next)").alias("used"), "start", "spelled")
    return levels


def _intervals(levels: list[DataFrame]) -> DataFrame:
    """mask, step, start, size: the intervals of ranks in which a failing set is removed at a step: those
    of the beginnings whose last letter, and none before, is in the set."""
    n, found = len(FILTERS), []
    for step, level in enumerate(levels, 1):
        masks = F.explode(F.sequence(F.lit(0), F.lit(2**n - 1))).alias("mask")
        hit = level.select("used", "next", "start", masks).where("shiftright(mask, next) & 1 = 1 AND mask & used = 0")
        found.append(hit.select("mask", F.lit(step).alias("step"), "start", F.lit(factorial(n - step)).alias("size")))
    return reduce(DataFrame.unionByName, found)


def interactions(counted: DataFrame) -> DataFrame:
    """The report of :func:`audit` from the rows of :func:`counts`."""
    sums = ["n", "good", "toxic"]
    # Each part has 32 sets at most, each of them 325 intervals at most.
    levels = _beginnings(counted.sparkSession)
    hit = counted.join(_intervals(levels), "mask")
    ends = F.explode(
        F.array(
            F.struct(F.col("start").alias("rank"), F.lit(1).alias("sign")),
            F.struct((F.col("start") + F.col("size")).alias("rank"), F.lit(-1).alias("sign")),
        )
    ).alias("end")
    changes = hit.select("part", "step", *sums, ends).select(
        "part", "step", "end.rank", *[(F.col(c) * F.col("end.sign")).alias(c) for c in sums]
    )
    # Zeros for every cell, so that the running sums pass over all ranks.
    totals = counted.groupBy("part").agg(
        F.sum("n").alias("docs"),
        *[F.sum(F.expr(f"if(shiftright(mask, {i}) & 1 = 1, n, 0)")).alias(f"fails_{i}") for i in range(len(FILTERS))],
        *[F.sum(F.expr(f"if(mask = {2**i}, n, 0)")).alias(f"only_{i}") for i in range(len(FILTERS))],
    )
    cells = totals.select("part", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    cells = cells.select("part", "step", F.explode(F.expr(f"sequence(0L, {ORDERS - 1}L)")).alias("rank"))
    zeros = cells.select("part", "step", "rank", *[F.lit(0).cast("long").alias(c) for c in sums])
    steps = changes.unionByName(zeros).groupBy("part", "step", "rank").agg(*[F.sum(c).alias(c) for c in sums])
    # Windows over 121 ranks, 5 steps and 120 steps of a filter: all of fixed size.
    along = Window.partitionBy("part", "step").orderBy("rank")
    steps = steps.select("part", "step", "rank", *[F.sum(c).over(along).alias(c) for c in sums]).where(f"rank < {ORDERS}")
    until = Window.partitionBy("part", "rank").orderBy("step")
    orders = levels[-1].select(F.col("start").alias("rank"), F.col("spelled").alias("filter_order"))
    steps = steps.withColumn("gone", F.sum("n").over(until)).join(orders, "rank")
    steps = steps.withColumn("filter", F.substr("filter_order", F.col("step"), F.lit(1)))
    same = Window.partitionBy("part", "filter")
    steps = steps.withColumn("shapley", F.sum("n").over(same)).join(totals, "part")

    def of_filter(kind: str) -> Column:
        return F.get(F.array(*[f"{kind}_{i}" for i in range(len(FILTERS))]), F.instr(F.lit(FILTERS), F.col("filter")) - 1)

    shown = {
        "kept": F.col("docs") - F.col("gone"),
        "removed": F.col("n"),
        "redundant": of_filter("fails") - F.col("n"),
        "unique_fails": of_filter("only"),
        "good_lost": F.col("good"),
        "toxic_lost": F.col("toxic"),
        "shapley": F.col("shapley"),
    }
    return steps.select("part", "filter_order", F.col("step").cast("int"), *[c.cast("long").alias(k) for k, c in shown.items()])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Removals of the filters A to E in all 120 orders: one row per part, order and step.

    Returns part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley. Filters: under 100 words; under 80 percent distinct words; over 10 percent capitals; one
    of ``#$%&*|``; a text that a smaller doc_id has too. Words are case-sensitive and stand between
    white space. A part is a value of lang, '' for null; every part has 600 rows, and an empty table
    has no part. Null texts count as empty; rows that share a doc_id and text do not repeat each
    other, and each takes that id's labels. Other columns are ignored.
    """
    return interactions(stage(counts(docs, labels), "failed-sets"))
