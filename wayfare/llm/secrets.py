"""Secret scans by patterns and by character Markov models, in Spark's own functions.

Two first-order Markov models over characters, one of random strings and one of ordinary
identifiers, are counted from labelled samples. A run of identifier characters is a secret when
the log-likelihood ratio of the two models is high enough. The ratio of every pair of neighbouring
characters is one entry of a table of fixed size, which the scan carries as a constant.
"""

from __future__ import annotations

import math
from string import ascii_lowercase, ascii_uppercase, digits

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of known secrets.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_MIN = 6
KINDS = ["assign", "access", "hex", "markov"]

#: Characters of the models; state 0 stands before the first character.
ALPHABET = ascii_lowercase + ascii_uppercase + digits + "+/_=-"
STATES = len(ALPHABET) + 1
#: Runs of the models' characters that are long enough to judge.
RUN = r"[A-Za-z0-9+/_=-]{12,}"
#: Ratio, in nats, above which a run counts as random: one wrong in some twenty thousand of those as likely
#: to be either. Runs of words fall far below it, the farther the longer they are.
THRESHOLD = 10.0
#: Weight of an even choice among all characters in each model.
EVEN = 0.02


def _spans(text: Column, pattern: str, keep=None) -> Column:
    """Matches of ``pattern`` as structs (start, end, hit), in code points, end exclusive.

    What stands between the matches gives their places.
    """
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(
        F.slice(gaps, F.lit(1), F.size(gaps) - 1),
        hits,
        lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("size"), h.alias("hit")),
    )
    empty = F.expr("cast(array() as array<struct<start:int,end:int,hit:string>>)")
    placed = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["size"]).alias("at"),
            F.concat(
                acc["out"],
                F.array(
                    F.struct(
                        (acc["at"] + x["gap"]).alias("start"),
                        (acc["at"] + x["gap"] + x["size"]).alias("end"),
                        x["hit"].alias("hit"),
                    )
                ),
            ).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(F.size(gaps) > 1, F.filter(placed, keep) if keep else placed).otherwise(empty)


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of the known kinds: leftmost, non-overlapping within a kind, too short ones dropped.

    ACCESS and HEX ask for their least length at once: a shorter run holds no longer match.
    """
    none = F.expr("cast(array() as array<struct<start:int,end:int,hit:string>>)")
    long_enough = lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 2)) >= ASSIGN_MIN
    assigned = F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))
    return {
        "assign": F.when(assigned, _spans(text, ASSIGN, long_enough)).otherwise(none),
        "access": F.when(F.contains(text, F.lit("AKIA")), _spans(text, ACCESS)).otherwise(none),
        "hex": _spans(text, HEX),
    }


def labelled_samples(docs: DataFrame) -> DataFrame:
    """token, random (boolean) from all of ``docs``: what trains the models.

    Random: the values of known secrets, and for every text the digest of its id and itself in
    base64. Ordinary: runs of letters only or of digits only, with joining signs, outside known
    secrets. Runs that mix letters and digits carry no label.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.base64(F.unhex(F.sha2(F.concat_ws(":", "doc_id", text), 512)))
    found = docs.select(text.alias("text"), digest.alias("digest"))
    found = found.select("*", *[c.alias(k) for k, c in base_spans(F.col("text")).items()])
    secret = F.concat(
        F.transform("assign", lambda s: F.regexp_extract(s["hit"], ASSIGN, 2)),
        F.transform("access", lambda s: s["hit"]),
        F.transform("hex", lambda s: s["hit"]),
    )
    runs = F.regexp_extract_all("text", F.lit(RUN), F.lit(0))
    plain = F.filter(runs, lambda r: r.rlike("^([A-Za-z+/_=-]+|[0-9+/_=-]+)$"))
    ordinary = F.filter("plain", lambda r: ~F.exists("secret", lambda s: F.contains(s, r)))
    sampled = found.select(secret.alias("secret"), plain.alias("plain"), "digest")
    labels = F.array(
        F.struct(F.lit(True).alias("random"), F.concat("secret", F.array("digest")).alias("tokens")),
        F.struct(F.lit(False).alias("random"), ordinary.alias("tokens")),
    )
    kinds = sampled.select(F.explode(labels).alias("x"))
    return kinds.select(F.explode("x.tokens").alias("token"), F.col("x.random").alias("random"))


def _state_array(token: Column) -> Column:
    """The states of a token's characters; characters outside the alphabet are left out."""
    places = F.transform(F.split(token, ""), lambda c: F.when(c == "", 0).otherwise(F.instr(F.lit(ALPHABET), c)))
    return F.filter(places, lambda i: i > 0)


def train(samples: DataFrame) -> list[float]:
    """The table of log-likelihood ratios, by state * STATES + next state.

    ``samples``: token, random. Null tokens and labels are left out; without samples of a label its
    model is even. The counts of pairs, at most 2 * STATES * STATES rows, come to the driver.
    """
    states = samples.where("random IS NOT NULL").select("random", _state_array(F.col("token")).alias("to"))
    before = F.concat(F.array(F.lit(0)), F.slice("to", F.lit(1), F.greatest(F.size("to") - 1, F.lit(0))))
    pairs = F.zip_with(before, F.col("to"), lambda a, b: a * STATES + b)
    counted = states.where(F.size("to") > 0).select("random", F.explode(pairs).alias("pair"))
    counts: dict[bool, dict[int, int]] = {True: {}, False: {}}
    for row in counted.groupBy("random", "pair").count().collect():
        counts[row["random"]][row["pair"]] = row["count"]

    def model(seen: dict[int, int]) -> list[float]:
        chances = []
        for state in range(STATES):
            row = [seen.get(state * STATES + to, 0) for to in range(STATES)]
            total, even = sum(row), 1 / (STATES - 1)
            chances += [(1 - EVEN) * n / total + EVEN * even if total else even for n in row]
        return chances

    return [math.log(a / b) for a, b in zip(model(counts[True]), model(counts[False]), strict=True)]


def ratio(token: Column, table: list[float]) -> Column:
    """Log-likelihood ratio of a token, random against ordinary; 0 for an empty one."""
    values = F.split(F.lit(",".join(f"{v:.6f}" for v in table)), ",").cast("array<double>")
    return F.aggregate(
        _state_array(token),
        F.struct(F.lit(0).alias("state"), F.lit(0.0).alias("sum")),
        lambda acc, to: F.struct(
            to.alias("state"), (acc["sum"] + F.get(values, acc["state"] * STATES + to)).alias("sum")
        ),
        lambda acc: acc["sum"],
    )


def scan(docs: DataFrame, table: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with found_base and found: arrays of (start, kind, end), ordered; kind is an index
    of KINDS.

    Runs that overlap a known secret are not judged again. A null text has no spans.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kinds = KINDS[:3]
    known = docs.withColumns({f"_{k}": c for k, c in base_spans(text).items()})
    runs = F.regexp_extract_all(text, F.lit(RUN), F.lit(0))
    known = known.withColumn("_runs", runs)
    known = known.withColumn("_random", F.filter("_runs", lambda r: ratio(r, table) > threshold))

    def numbered(spans: Column, kind: str) -> Column:
        return F.transform(
            spans,
            lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")),
        )

    base = F.sort_array(F.concat(*[numbered(F.col(f"_{k}"), k) for k in kinds]))
    known = known.withColumn("found_base", base)
    free = F.filter(
        _spans(text, RUN, lambda s: F.array_contains(F.col("_random"), s["hit"])),
        lambda s: ~F.exists("found_base", lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"])),
    )
    added = F.when(F.size("_random") > 0, numbered(free, "markov")).otherwise(
        F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    )
    found = known.withColumn("found", F.sort_array(F.concat("found_base", added)))
    return found.drop(*[f"_{k}" for k in kinds], "_runs", "_random")


def _spelled(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


def find_secrets(docs: DataFrame, table: list[float] | None = None) -> DataFrame:
    """Spans of secrets in every whole text.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov: one row per input
    row, repeated rows and null ids included. A null or empty text has no spans: counts 0, spans
    '' and the digest of ''. ``table`` comes from :func:`train`; without it the models are trained
    from :func:`labelled_samples` of ``docs``. Columns besides doc_id and text are ignored.
    """
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    table = table or train(labelled_samples(narrow))
    found = scan(narrow, table)

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(k) for k in KINDS[:3]],
        F.sha2(_spelled("found_base"), 256).alias("base_sha256"),
        _spelled("found").alias("spans"),
        count("markov"),
    )


def mask_secrets(docs: DataFrame, table: list[float] | None = None, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mask``, overlapping ones by one.

    Texts without secrets, null ones included, stay as they are, and so do all other columns, but
    for n_chars, where there is one, which follows the text.
    """
    table = table or train(labelled_samples(docs.select("doc_id", "text")))
    names = docs.columns
    found = scan(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "text"), table)
    rebuilt = F.aggregate(
        "found",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(
            s["end"] > acc["at"],
            F.struct(
                s["end"].alias("at"),
                F.when(
                    s["start"] < acc["at"], acc["out"]
                ).otherwise(
                    F.concat(acc["out"], F.substr("text", acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))
                ).alias("out"),
            ),
        ).otherwise(acc),
        lambda acc: F.concat(acc["out"], F.substr("text", acc["at"] + 1)),
    )
    text = F.when(F.size("found") > 0, rebuilt).otherwise(F.col("text"))
    masked = found.withColumn("masked", text)
    size = F.when(F.size("found") > 0, F.length("masked")).otherwise(F.col("row").getField("n_chars")) if "n_chars" in names else None
    changed = {"text": F.col("masked"), "n_chars": size}
    kinds = dict(docs.dtypes)
    return masked.select(
        *[(changed[c] if c in changed else F.col("row").getField(c)).cast(kinds[c]).alias(c) for c in names]
    )
