"""Pattern search by trigrams against a plain match of every address."""

import random
import re

from pyspark.sql import functions as F

from tests.helpers import tuples
from wayfare.operators import accounts, email_index


def matches(pattern, email):
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
            out += re.escape(pattern[i].lower())
        else:
            out += {"%": ".*", "_": "."}.get(c, re.escape(c.lower()))
        i += 1
    return re.fullmatch(out, email.lower(), re.DOTALL) is not None


PATTERNS = ["%", "_%", "%_@%", "a%", "%b", "%a_b%", "%ab%", "ann%", "%.org", "%@x.org", "ann_b@x.org", "%zzz%", "%nn%b%x%", "%100\\%%", "%a\\_b%", "É%", "", "___"]


def test_patterns_equal_trying_every_address(spark, make, monkeypatch):
    rng = random.Random(4)
    emails = ["Ann_B@x.org", "annxb@x.org", "100%sure@x.org", "a_b@y.com", "axb@y.com", "É@é.fr", "", "a", "ab", "abc", None, "line\nbreak@x.org"]
    emails += ["".join(rng.choice("abnx@._") for _ in range(rng.randint(1, 12))) for _ in range(150)]
    customers = make("customer", [{"id": i, "name": "n", "email": e} for i, e in enumerate(emails)])
    wanted = [*PATTERNS, "%ab%", None] + ["%" + "".join(rng.choice("abnx@._%") for _ in range(rng.randint(1, 5))) for _ in range(40)]
    asked = spark.createDataFrame([(w,) for w in wanted], "email string")
    expected = sorted((w, i) for w in wanted if w is not None for i, e in enumerate(emails) if e is not None and matches(w, e))
    # Also with lists and tables far longer than a block.
    for block in (10_000, 7):
        monkeypatch.setattr(email_index, "BLOCK", block)
        assert tuples(accounts.customers_by_email(asked, customers, "pattern"), "wanted_email", "id") == expected


def test_every_run_of_a_pattern_is_one_of_its_addresses(spark):
    rows = spark.createDataFrame([("Ann%b\\%cd_x@Y.org",), ("%",), ("ab",), ("%ab",), ("%abc\\",)], "p string")
    found = {r["p"]: set(r["runs"]) for r in rows.select("p", email_index.pattern_runs(F.col("p")).alias("runs")).collect()}
    s, e = email_index.START, email_index.END
    assert found["Ann%b\\%cd_x@Y.org"] == {f"{s}an", "ann", "b%c", "%cd", "x@y", "@y.", "y.o", ".or", "org", f"rg{e}"}
    assert found["%"] == set() and found["ab"] == {f"{s}ab", f"ab{e}"} and found["%ab"] == {f"ab{e}"}


def test_no_key_holds_all_customers(spark, make, monkeypatch):
    """The runs that every address has are dealt over blocks."""
    monkeypatch.setattr(email_index, "BLOCK", 50)
    customers = make("customer", [{"id": i, "name": "n", "email": f"user{i}@example.com"} for i in range(1000)])
    asked = spark.createDataFrame([("%@example.com",), ("%e%",)], "email string")
    out = accounts.customers_by_email(asked, customers, "pattern")
    assert out.count() == 2000
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "trigram" in plan and "part" in plan and "Cross" not in plan


def test_a_stored_index_answers_as_one_built_for_the_purpose(spark, make, tmp_path):
    customers = make("customer", [{"id": i, "name": "n", "email": f"user{i}@example.com"} for i in range(100)])
    email_index.email_index(customers).write.parquet(str(tmp_path / "index"))
    stored = spark.read.parquet(str(tmp_path / "index"))
    asked = spark.createDataFrame([("%r7_@%",)], "email string")
    out = accounts.customers_by_email(asked, customers, "pattern", stored)
    assert tuples(out, "id") == [(i,) for i in range(70, 80)]


def test_candidates_grow_with_the_answers_and_not_with_the_square(spark, make):
    """Every address asked for by a pattern: twice the table tries about twice the pairs."""

    def tried(n):
        emails = [f"Customer#{i:09d}@Example.com" for i in range(n)]
        customers = make("customer", [{"id": i, "name": "n", "email": e} for i, e in enumerate(emails)])
        asked = spark.createDataFrame([(f"%{e[13:18]}@ex_mple%",) for e in emails], "email string")
        runs = asked.select(F.explode(email_index.pattern_runs(F.col("email"), True)).alias("trigram"), "email")
        sizes = email_index.email_index(customers).groupBy("trigram").count()
        rarest = runs.join(sizes, "trigram", "left").groupBy("email").agg(F.min(F.coalesce("count", F.lit(0))).alias("n"))
        assert accounts.customers_by_email(asked, customers, "pattern").count() == n
        return rarest.agg(F.sum("n")).first()[0]

    assert tried(1000) <= 1000 * 1.5 and tried(2000) <= 2000 * 1.5


def test_an_index_of_trigrams_alone_still_answers(spark, make):
    """As stored before longer runs were listed."""
    customers = make("customer", [{"id": i, "name": "n", "email": f"user{i}@example.com"} for i in range(100)])
    old = email_index.email_index(customers).where("length(trigram) = 3")
    asked = spark.createDataFrame([("%user7_@example%",), ("%nobody at all%",)], "email string")
    for index in (old, email_index.email_index(customers), None):
        assert tuples(accounts.customers_by_email(asked, customers, "pattern", index), "id") == [(i,) for i in range(70, 80)]


def test_the_index_is_never_broadcast(spark, make, tmp_path):
    """Spark judges it by the addresses, which are far fewer."""
    customers = make("customer", [{"id": i, "name": "n", "email": f"user{i}@example.com"} for i in range(100)])
    customers.write.parquet(str(tmp_path / "customer"))
    asked = spark.createDataFrame([("%r7_@%",)], "email string")
    out = accounts.customers_by_email(asked, spark.read.parquet(str(tmp_path / "customer")), "pattern")
    assert tuples(out, "id") == [(i,) for i in range(70, 80)]
    assert "strategy=merge" in out._jdf.queryExecution().optimizedPlan().toString()
