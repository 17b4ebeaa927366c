"""Quality rules by divergence from language references, in Spark's own functions.

A text's shares of character classes and of common words are compared with those of whole
languages by the Jensen-Shannon distance. A text is refused when it is far from every language.
Short texts, whose shares say little, are not judged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.session import stage

# What separates words, and what counts as a symbol.
SPACE = r"[\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"

#: Common words by language; their union, and one bin for all other words, is the word histogram.
COMMON_WORDS = {
    "de": ["der", "die", "und", "den", "von", "mit"],
    "en": ["the", "of", "and", "to", "in", "that"],
    "es": ["la", "que", "el", "y", "los", "del"],
    "fr": ["de", "le", "et", "les", "des", "qui"],
}
WORDS = sorted({w for words in COMMON_WORDS.values() for w in words})
#: Longest common word, in bytes.
WORD_BYTES = max(len(w.encode()) for w in WORDS)

#: Fewest words of a text that passes the base rule, most words in repeated windows, in percent.
MIN_WORDS, MAX_REPEATED = 50, 50
#: Fewest characters and words for the two divergences.
MIN_CHARS, MIN_COMPARED = 200, 50
#: Greatest sum of the two distances from the nearest language that still passes: what clean texts
#: of any length keep below, and what the chance shares of n words add, by 1 / sqrt(n).
MAX_DISTANCE, CHANCE = 0.30, 1.2


def _count(text: Column, pattern: str) -> Column:
    """Characters of ``text`` left when those outside ``pattern``'s class are taken out."""
    return F.length(F.regexp_replace(text, pattern, ""))


def _repeated(words: str) -> list[tuple[str, Column]]:
    """Steps that count the words in 3-word windows found twice or more.

    Windows are hashed. Where a hash occurs twice, hashes are sorted with their places, so equal
    ones stand side by side; the places of those are sorted again, and neighbouring windows cover
    what their distance leaves.
    """
    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )
    windows = F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("hash"), i.alias("at"))))

    def hash_at(i: Column) -> Column:
        return F.get("_windows", i)["hash"]

    twice = F.filter("_windows", lambda w, i: w["hash"].eqNullSafe(hash_at(i - 1)) | w["hash"].eqNullSafe(hash_at(i + 1)))
    covered = F.aggregate(
        "_places",
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("covered")),
        lambda acc, at: F.struct(
            at.alias("last"), (acc["covered"] + F.least(F.lit(3), at - acc["last"])).alias("covered")
        ),
        lambda acc: acc["covered"],
    )
    return [
        ("_hashes", F.when(F.size(words) >= 4, hashes)),
        ("_windows", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), windows)),
        ("_places", F.sort_array(F.transform(twice, lambda w: w["at"]))),
        ("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))),
    ]


def _measured(docs: DataFrame) -> DataFrame:
    """Base counts of every text with its counts by character class (_classes) and of each common
    word (_hits)."""
    df = docs.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    df = df.withColumn("_words", F.array_remove(F.split("_text", SPACE + "+"), ""))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    brief = F.array_join(F.filter("_words", lambda w: F.octet_length(w) <= WORD_BYTES), "  ")
    df = df.withColumns(
        {
            "n_chars": F.length("_text").cast("long"),
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": (F.length("_text") - F.length(F.regexp_replace("_text", SYMBOL + "+", ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_brief": F.lower(F.concat(F.lit(" "), brief, F.lit(" "))),
        }
    )
    for name, column in _repeated("_words"):
        df = df.withColumn(name, column)

    def share_of(word: str) -> Column:
        without = F.replace(F.col("_brief"), F.lit(f" {word} "), F.lit(""))
        return ((F.length("_brief") - F.length(without)) / (len(word) + 2)).cast("long")

    others = [_count(F.col("_text"), pattern).cast("long") for pattern in (r"[^\p{Lu}]+", r"[^0-9]+", r"[^.,;:!?'\"()-]+")]
    keep = [c for c in docs.columns if c != "text"]
    return df.select(
        *keep,
        *["n_chars", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
        F.array(*others).alias("_classes"),
        F.array(*[share_of(w) for w in WORDS]).alias("_hits"),
    )


def _histograms(measured: DataFrame) -> DataFrame:
    """``measured`` with both histograms whole: (upper case, digits, marks, symbols, spaces, the
    rest) and (each common word, other words)."""
    total = lambda name: F.aggregate(name, F.lit(0).cast("long"), lambda a, x: a + x)
    classes = F.concat("_classes", F.array(F.col("n_symbols"), F.col("n_chars") - F.col("word_chars")))
    df = measured.withColumns(
        {"_classes": classes, "_common": F.concat("_hits", F.array(F.col("n_words") - total("_hits")))}
    )
    return df.withColumn("_classes", F.concat("_classes", F.array(F.col("n_chars") - total("_classes"))))


def _shares(counts: str) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.transform(counts, lambda x: x / total))


def references(measured: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """Shares of character classes and of common words of whole languages.

    Summed over every text whose ``lang`` is one of COMMON_WORDS and that is long enough to be
    judged. A language without such a text has no reference.
    """
    counted = _histograms(measured).where(
        F.col("lang").isin(list(COMMON_WORDS)) & (F.col("n_chars") >= MIN_CHARS) & (F.col("n_words") >= MIN_COMPARED)
    )
    sums = [F.sum(F.get("_classes", F.lit(i))).alias(f"c{i}") for i in range(6)]
    sums += [F.sum(F.get("_common", F.lit(i))).alias(f"w{i}") for i in range(len(WORDS) + 1)]
    found = {}
    for row in counted.groupBy("lang").agg(*sums).collect():  # one row per language of COMMON_WORDS
        classes = [row[f"c{i}"] for i in range(6)]
        words = [row[f"w{i}"] for i in range(len(WORDS) + 1)]
        found[row["lang"]] = ([c / sum(classes) for c in classes], [w / sum(words) for w in words])
    return found


def distance(shares: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance of two histograms, 0 (equal) to 1 (nothing in common)."""

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    terms = F.zip_with(shares, F.array(*[F.lit(float(r)) for r in reference]), lambda p, q: part(p, q) + part(q, p))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2))


def quality_rules(docs: DataFrame) -> DataFrame:
    """Base counts and the verdict for every whole text.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    char_distance, word_distance: one row per input row, repeated rows and null ids included. A null
    text has no words and so fails the base rule. The distances, from the nearest language of
    ``docs`` itself, are null for texts shorter than the guards and where there is no reference;
    such texts follow the base rule alone. Columns besides doc_id, text and lang are ignored. Texts
    are read once; their counts are staged.
    """
    narrow = docs.select(F.col("doc_id").cast("long"), "lang", F.col("text").cast("string"))
    measured = stage(_measured(narrow), "quality-counts")
    refs = references(measured)
    df = _histograms(measured)
    df = df.withColumns({"_class_shares": _shares("_classes"), "_word_shares": _shares("_common")})

    def nearest(shares: str, which: int, enough: Column) -> Column:
        far = [distance(F.col(shares), r[which]) for r in refs.values()]
        if not far:
            return F.lit(None).cast("double")
        return F.when(enough, F.least(*far) if len(far) > 1 else far[0])

    df = df.withColumns(
        {
            "char_distance": nearest("_class_shares", 0, F.col("n_chars") >= MIN_CHARS),
            "word_distance": nearest("_word_shares", 1, F.col("n_words") >= MIN_COMPARED),
            "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")),
        }
    )
    allowed = MAX_DISTANCE + CHANCE / F.sqrt("n_words")
    near = F.coalesce(F.col("char_distance") + F.col("word_distance") <= allowed, F.lit(True))
    return df.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & near).alias("kept"),
        "char_distance",
        "word_distance",
    )
