"""Sharding by balanced label propagation, in Spark's own functions.

Rows start evenly spread over the shards. In each round, every group of linked rows turns to the
shard that holds most of it, large groups first; where that has no room left, to another that has.
Only groups that fit nowhere are split, into as few parts as there can be. Rows without links fill
what is left, through any shard. So shards keep equal numbers of rows in every round.
"""

from __future__ import annotations

import json
from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfare.session import stage

SHARDS, ROUNDS = 24, 4
#: Rows that are numbered in one task, on average.
CHUNK = 20_000


def numbered(df: DataFrame, keys: list[str], chunks: int) -> DataFrame:
    """``df`` with ``number``: 0, 1, 2, … within equal ``keys``, without gaps, in no particular order.

    ``df`` has a unique ``row``. Each key's rows are cut by hash into ``chunks`` parts that are
    numbered on their own and start where the parts before them end.
    """
    df = df.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)))
    before = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = df.groupBy(*keys, "chunk").agg(F.count("*").alias("n"))
    starts = sizes.select(*keys, "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    inside = F.row_number().over(Window.partitionBy(*keys, "chunk").orderBy("row"))
    placed = df.withColumn("inside", inside).join(starts, [*keys, "chunk"])
    return placed.withColumn("number", F.col("skip") + F.col("inside") - 1).drop("chunk", "inside", "skip")


def _small_table(spark: SparkSession, columns: str, rows: list[tuple[int, ...]]) -> DataFrame:
    """A table of whole numbers, part of the plan."""
    names = columns.split(", ")
    values = json.dumps([dict(zip(names, row, strict=True)) for row in rows])
    shape = f"array<struct<{','.join(f'{n}:bigint' for n in names)}>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(values), shape)))


def quotas(wanted: dict[tuple[int, int], int], spare: dict[int, int]) -> tuple[dict[tuple[int, int], int], dict[tuple[int, int], int]]:
    """Moves granted between two shards at a time, of linked rows and of rows that make room for
    them. :func:`propagate` plans with :func:`place`, which is not bound to pairs of shards.

    ``wanted``: linked rows by (from, to); ``spare``: rows without links by shard. For any two
    shards, as many rows go one way as the other.
    """
    moves = {(i, j): min(n, wanted.get((j, i), 0)) for (i, j), n in wanted.items()}
    room = {}
    left = dict(spare)
    for (i, j), n in sorted(wanted.items()):
        given = min(n - moves[i, j], left.get(j, 0))
        if given:
            moves[i, j] += given
            room[j, i] = given
            left[j] -= given
    return moves, room


@dataclass
class Plan:
    """Where groups go. ``whole``: (size, home, lower, upper, to), the groups of a size and home by
    their numbers; ``parts``: (size, home, number, lower, upper, to), the rows of one group by
    theirs; ``room``: what is left in each shard; ``split``: groups in parts that are no larger
    than a shard."""

    whole: list[tuple[int, ...]]
    parts: list[tuple[int, ...]]
    room: list[int]
    split: int


def place(classes: dict[tuple[int, int], int], capacity: list[int], keep: bool = True) -> Plan:
    """Homes for groups, counted in ``classes`` by (size, home), large ones first.

    With ``keep``, a group stays in its home while that has room. Others go where they leave the
    least room. Groups larger than any shard fill shards and go on as what remains of them. Groups
    that fit nowhere come last, in as few parts as there can be; room only shrinks, so none of them
    fits into a shard at the end.
    """
    room, whole, parts = list(capacity), [], []

    def fill(size: int, home: int, number: int, at: int, least: int) -> int:
        """Give a group's rows from ``at`` on to the emptiest shards until ``least`` or fewer are left."""
        while size - at > least:
            to = max(range(len(room)), key=lambda j: (room[j], j == home))
            n = min(room[to], size - at)
            parts.append((size, home, number, at, at + n, to))
            room[to] -= n
            at += n
        return at

    # (rows, size, home, first number, groups, first row) of groups yet to place.
    items = []
    largest = max(capacity, default=0)
    for (size, home), n in sorted(classes.items(), reverse=True):
        if size <= largest:
            items.append((size, size, home, 0, n, 0))
            continue
        for number in range(n):
            at = fill(size, home, number, 0, largest)
            items.append((size - at, size, home, number, 1, at))
    late, by_rows = [], defaultdict(list)
    for item in items:
        by_rows[item[0]].append(item)
    for rows in sorted(by_rows, reverse=True):
        left = []
        for item in by_rows[rows]:
            left += _put(item, [item[2]] if keep else [], room, whole, parts)
        for item in left:
            late += _put(item, sorted(range(len(room)), key=lambda j: room[j]), room, whole, parts)
    split = 0
    for _, size, home, first, n, at in late:
        split += n if size <= largest else 0
        for number in range(first, first + n):
            fill(size, home, number, at, 0)
    return Plan(whole, parts, room, split)


def _put(item: tuple[int, ...], shards: list[int], room: list[int], whole: list, parts: list) -> list[tuple[int, ...]]:
    """Place groups of equal size in ``shards``, in this order; returns those that do not fit."""
    rows, size, home, first, n, at = item
    for to in shards:
        given = min(n, room[to] // rows)
        if given:
            if at:
                parts.append((size, home, first, at, size, to))
            else:
                whole.append((size, home, first, first + given, to))
            room[to] -= given * rows
            first, n = first + given, n - given
    return [(rows, size, home, first, n, at)] if n else []


def displaced(held: dict[int, int], room: list[int]) -> list[tuple[int, ...]]:
    """(shard, lower, upper, to): rows without links by their numbers in ``held`` shards, so that
    they fill ``room``. As many as can stay where they are; the rest go to any shard with room."""
    stay = [min(held.get(j, 0), n) for j, n in enumerate(room)]
    spans = [(j, 0, n, j) for j, n in enumerate(stay) if n]
    empty = [(j, n - stay[j]) for j, n in enumerate(room) if n > stay[j]]
    for j, n in sorted(held.items()):
        at = stay[j]
        while at < n:
            to, free = empty.pop()
            given = min(free, n - at)
            spans.append((j, at, at + given, to))
            at += given
            if free > given:
                empty.append((to, free - given))
    return spans


def _round(state: DataFrame, capacity: list[int], chunks: int, below: int | None) -> tuple[DataFrame, int] | None:
    """The next state (row, team, shard) and its number of split groups that a shard could hold;
    None if that is not ``below`` what it was."""
    spark = state.sparkSession
    linked = state.where("team IS NOT NULL")
    held = linked.groupBy("team", "shard").agg(F.count("*").alias("n"))
    # Equal counts are told apart by hash, so that no shard is wanted more than others.
    most = F.max(F.struct("n", F.xxhash64("team", "shard").alias("tie"), "shard")).alias("most")
    teams = held.groupBy("team").agg(F.sum("n").alias("size"), most)
    teams = stage(teams.select(F.col("team").alias("row"), "size", F.col("most.shard").alias("home")), "teams")
    # Distinct sizes of groups are at most sqrt(2 * rows), so this stays small.
    classes = {(r["size"], r["home"]): r["count"] for r in teams.groupBy("size", "home").count().collect()}
    plan = min((place(classes, capacity, keep) for keep in (True, False)), key=lambda p: p.split)
    if below is not None and plan.split >= below:
        return None

    named = numbered(teams, ["size", "home"], chunks).withColumnRenamed("row", "team")
    whole = _small_table(spark, "size, home, lower, upper, to", plan.whole)
    homes = named.join(whole, ["size", "home"]).where("number >= lower AND number < upper").select("team", "to")
    # Joined on one more key than grouped by, so that the rows of a large group can be split.
    deal = F.xxhash64("team").alias("deal")
    dealt = linked.select("row", "team", deal)
    placed = [dealt.join(homes.select("*", deal), ["team", "deal"]).select("row", "team", "to")]
    if plan.parts:
        parts = _small_table(spark, "size, home, number, lower, upper, to", plan.parts)
        parts = stage(named.join(parts, ["size", "home", "number"]).select("team", deal, "lower", "upper", "to"), "parts")
        some = dealt.join(parts.select("team", "deal").distinct(), ["team", "deal"])
        some = numbered(some, ["team"], chunks).join(parts, ["team", "deal"]).where("number >= lower AND number < upper")
        placed.append(some.select("row", "team", "to"))
    free = state.where("team IS NULL")
    spare = {r["shard"]: r["count"] for r in free.groupBy("shard").count().collect()}
    spans = _small_table(spark, "shard, lower, upper, to", displaced(spare, plan.room))
    rest = numbered(free, ["shard"], chunks).join(spans, "shard").where("number >= lower AND number < upper")
    placed.append(rest.select("row", "team", "to"))
    after = reduce(DataFrame.unionByName, placed).withColumnRenamed("to", "shard")
    return stage(after, "shards"), plan.split


def propagate(rows: DataFrame, team: Column, shards: int = SHARDS, rounds: int = ROUNDS, chunk: int = CHUNK) -> DataFrame:
    """row, shard of every row of ``rows``, which has a unique ``row``.

    Rows of equal ``team`` are linked; a null team is linked with nothing. Shards' row counts
    differ by one at most. ``rounds`` bounds the rounds; they end when no split group fits into a
    shard, or the next round would split as many.
    """
    total = rows.count()
    chunks = max(1, -(-total // chunk))
    named = rows.select("row", team.alias("team"))
    sizes = named.groupBy("team").agg(F.count("*").alias("n")).where("n > 1 AND team IS NOT NULL")
    sizes = sizes.select("team", F.lit(True).alias("linked"), F.xxhash64("team").alias("deal"))
    named = named.withColumn("deal", F.xxhash64("team")).join(sizes, ["team", "deal"], "left")
    named = named.select("row", F.when(F.col("linked"), F.col("team")).alias("team"))
    start = numbered(named.withColumn("all", F.lit(0)), ["all"], chunks)
    state = stage(start.select("row", "team", F.pmod("number", F.lit(shards)).cast("long").alias("shard")), "shards")
    capacity = [total // shards + (j < total % shards) for j in range(shards)]
    split = None
    for _ in range(rounds):
        after = _round(state, capacity, chunks, split)
        if after is None:
            break
        state, split = after
        if not split:
            break
    return state.select("row", "shard")


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Put every document into a shard, equal texts together where room allows.

    Returns one row per input row: doc_id, size (UTF-8 bytes of the text, and 8), text_crc32, law
    ('rows': shards' row counts differ by one at most), shard from 0, slot (0, 1, … within the
    shard), grown_shard (null under this law). A null text has no bytes and equals an empty one.
    Null ids and repeated rows are rows like any other. Other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = docs.select(
        F.col("doc_id").cast("long"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.md5(text).alias("team"),
    )
    # Row numbers hold only for rows that are not computed again.
    rows = stage(narrow.withColumn("row", F.monotonically_increasing_id()), "shard-rows")
    placed = propagate(rows, F.col("team"), shards, rounds)
    chunks = max(1, -(-rows.count() // (CHUNK * shards)))
    slots = numbered(placed, ["shard"], chunks)
    return rows.join(slots, "row").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("number").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
