"""Pattern search over e-mail addresses by an inverted index of trigrams and longer runs.

An address, in lower case and with marks for its start and end, is listed under each of its runs of
three and of six characters. A pattern's fixed pieces have such runs too, and an address it matches is
listed under all of them: only the addresses under the pattern's rarest run are tried. Three characters
are few: the addresses that share some grow with the table, and with a pattern for each of them the pairs
to try grow with its square. So pieces of six or more are looked up by their longer runs. A run that no
address has settles its pattern at once. Lists that are long are dealt over blocks by hash, and a pattern without any
run meets all addresses in blocks, so that no key holds more than a bounded share of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "\u0002", "\u0003"

#: Addresses of a block: at least so many, or so large a share of the table that blocks are few.
BLOCK, MOST_BLOCKS = 10_000, 1000

#: Addresses or patterns whose runs one task lists.
SHARE = 20_000

#: Characters of a run.
SHORT, LONG = 3, 6

#: Runs of a pattern that are looked up, as a power of two.
PLACE_BITS = 20


def _runs(text: Column, size: int = SHORT) -> Column:
    """The distinct runs of ``size`` characters of a text; none in a shorter one."""
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - (size - 1), F.lit(1)))
    runs = F.transform(places, lambda i: F.substring(text, i, F.lit(size)))
    return F.array_distinct(F.filter(runs, lambda r: F.length(r) == size))


def email_index(customers: DataFrame) -> DataFrame:
    """trigram, id: under which runs, of three and of six characters, each customer's address is listed. A
    null address is not, nor one without an id."""
    marked = F.concat(F.lit(START), F.lower("email"), F.lit(END))
    runs = F.concat(_runs(marked), _runs(marked, LONG))
    # Short rows become many: dealt by id before that, a task takes a bounded share, and equal runs of an id
    # are together without another shuffle.
    listed = customers.where("email IS NOT NULL AND id IS NOT NULL").select("id", "email")
    listed = listed.repartition(max(1, -(-listed.count() // SHARE)), "id")
    return listed.select("id", F.explode(runs).alias("trigram")).distinct()


def pattern_runs(pattern: Column, long: bool = False) -> Column:
    """The runs that every address matched by a pattern has. ``%`` and ``_`` stand for any text and any
    character, a backslash before a character for that character. With ``long``, a piece that has longer
    runs gives those."""
    tokens = F.regexp_extract_all(F.lower(pattern), F.lit(r"(?s)(?:\\.|[^%_\\])+|[%_]"), F.lit(0))
    last = F.size(tokens) - 1
    pieces = F.transform(
        tokens,
        lambda t, i: F.when(t.isin("%", "_"), F.lit("")).otherwise(
            F.concat(
                F.when(i == 0, F.lit(START)).otherwise(F.lit("")),
                F.regexp_replace(t, r"(?s)\\(.)", "$1"),
                F.when(i == last, F.lit(END)).otherwise(F.lit("")),
            )
        ),
    )
    of_piece = lambda p: F.when(F.length(p) >= LONG, _runs(p, LONG)).otherwise(_runs(p)) if long else _runs(p)
    return F.array_distinct(F.flatten(F.transform(pieces, of_piece)))


def match_patterns(patterns: DataFrame, customers: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """wanted_email, id, name for all customers whose address matches a pattern, ignoring case.

    ``patterns``: wanted_email; equal ones are tried once and answered as often as they stand there. An
    ``index`` stored earlier, of the same customers, saves building it; one without longer runs is asked for
    trigrams alone.
    """
    long = index is None or not index.where(F.length("trigram") > SHORT).isEmpty()
    index = email_index(customers) if index is None else index
    who = customers.select("id", "name", "email")
    total = who.count()
    block = max(BLOCK, -(-total // MOST_BLOCKS))
    # Patterns too become many rows each, and are dealt out before.
    asked = patterns.select("wanted_email").where("wanted_email IS NOT NULL")
    asked = asked.repartition(max(1, -(-asked.count() // SHARE)), "wanted_email").distinct()
    asked = asked.withColumn("runs", pattern_runs(F.col("wanted_email"), long))

    sizes = index.groupBy("trigram").agg(F.count("*").alias("n"))
    # Left: a run that is not listed has a count of 0, and no address to try.
    # The rarest is kept as one number, its count above its place among the pattern's runs, which a hash table
    # of bounded size can hold; the least of several texts would be sorted for. Any of the runs will do, so
    # those beyond the last place can go.
    places = F.posexplode(F.slice("runs", 1, 2**PLACE_BITS)).alias("place", "trigram")
    runs = asked.select("wanted_email", places).join(sizes, "trigram", "left")
    ranked = F.shiftleft(F.coalesce("n", F.lit(0).cast("bigint")), PLACE_BITS) + F.col("place")
    rarest = runs.groupBy("wanted_email").agg(F.min(ranked).alias("x"))
    blocks = lambda n: F.ceil(n / block).cast("int")
    place = F.expr(f"cast(x & {2**PLACE_BITS - 1} as int)")
    trigram = F.get(pattern_runs(F.col("wanted_email"), long), place)
    rarest = rarest.select("wanted_email", trigram.alias("trigram"), blocks(F.shiftright("x", PLACE_BITS)).alias("parts"))
    tried = rarest.where("parts > 0").select(
        "wanted_email", "trigram", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    )
    # Each address has a bounded number of runs, so runs with more than a block of addresses are at most
    # that many times MOST_BLOCKS: small enough to hand to every task.
    long = sizes.where(F.col("n") > block).select("trigram", blocks(F.col("n")).alias("parts"))
    part = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    listed = index.join(F.broadcast(long), "trigram", "left")
    listed = listed.select("trigram", "id", part(F.coalesce("parts", F.lit(1))).alias("part"))
    # The index is far larger than the table that Spark judges its size by, so it must not be broadcast.
    candidates = tried.join(listed.hint("merge"), ["trigram", "part"]).select("wanted_email", "id")
    by_run = candidates.join(who, "id").where("email ilike wanted_email")

    # Without a run, in blocks: every such pattern against every address.
    parts = max(1, -(-total // block))
    rest = asked.where("size(runs) = 0").select("wanted_email", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    in_blocks = rest.join(who.withColumn("part", part(F.lit(parts))), "part").where("email ilike wanted_email")

    out = ["wanted_email", "id", "name"]
    found = by_run.select(*out).unionByName(in_blocks.select(*out))
    return patterns.select("wanted_email").join(found, "wanted_email")
