"""Account tables as snapshots that batches of a change log are merged into.

A snapshot has the rows of a table and, per key, the sequence number of the change that was merged last and
whether that change removed the row. Only changes after it count, so batches may come in any order and more
than once, and a merge reads the snapshot and the new batches, never the log from its beginning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wayfare.operators.changes import LINK, add_addresses, add_payments, newest_forms, newest_link_changes, readable_payments
from wayfare.sources.schemas import schema_of

#: Keys of the tables whose rows come and go; the customers' two choices have a number each.
KEYS = {"address": ["id"], "customer_address": LINK, "payment_method": ["id", "customer_id"]}
CHOICES = {"set_primary_address": "primary_address_id", "set_primary_payment": "primary_payment_id"}
REFUSED = "payment_id bigint, customer_id bigint, reason string"
TABLES = ["customer", *KEYS, "refused_payment"]


def snapshot_schema(table: str) -> StructType:
    if table == "refused_payment":
        return StructType.fromDDL(REFUSED)
    schema = StructType(schema_of(table).fields)
    extra = {f"{c}_seq": "long" for c in CHOICES.values()} if table == "customer" else {"seq": "long", "gone": "boolean"}
    for name, kind in extra.items():
        schema = schema.add(name, kind)
    return schema


def first_snapshot(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Snapshots of tables that no change has been merged into; their rows count as older than the log."""
    found = {}
    for table in TABLES:
        if table in tables:
            columns = {c: F.lit(None).cast("bigint") for c in snapshot_schema(table).names if c.endswith("seq")}
            if table in KEYS:
                columns["gone"] = F.lit(False)
            found[table] = tables[table].withColumns(columns).select(*snapshot_schema(table).names)
    return found


def current(snapshots: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables that snapshots stand for."""
    found = {}
    for table, df in snapshots.items():
        kept = df.where("not gone") if table in KEYS else df
        found[table] = df if table == "refused_payment" else kept.select(*schema_of(table).names)
    return found


def _changes(table: str, log: DataFrame) -> DataFrame:
    """The newest change of every key in a log, in the columns of the table's snapshot."""
    if table == "customer_address":
        return newest_link_changes(log).select(*LINK, "seq", (F.col("action") == "remove_address").alias("gone"))
    if table == "address":
        added = log.where((F.col("action") == "add_address") & F.col("line1").isNotNull())
        forms = newest_forms(added, ["target_id"])
        forms = forms.withColumns({"address_id": F.col("target_id"), "customer_id": F.lit(None).cast("bigint")})
        rows = add_addresses(forms)[0].join(forms.select(F.col("target_id").alias("id"), "seq"), "id")
        return rows.withColumn("gone", F.lit(False))
    adds = log.where(F.col("action") == "add_payment").withColumn("payment_id", F.col("target_id"))
    forms = newest_forms(readable_payments(adds), ["payment_id", "customer_id"])
    keyed = forms.select(F.col("payment_id").alias("id"), "customer_id", "seq")
    rows = add_payments(forms)[0].join(keyed, ["id", "customer_id"]).withColumn("gone", F.lit(False))
    removed = log.where(F.col("action") == "remove_payment").groupBy(F.col("target_id").alias("id"), "customer_id")
    removed = removed.agg(F.max("seq").alias("seq")).withColumn("gone", F.lit(True))
    both = rows.unionByName(removed, allowMissingColumns=True)
    payload = [c for c in rows.columns if c not in KEYS[table]]
    newest = both.groupBy(*KEYS[table]).agg(F.max_by(F.struct(*payload), "seq").alias("x"))
    return newest.select(*KEYS[table], "x.*")


def _merge_rows(table: str, base: DataFrame, changes: DataFrame) -> DataFrame:
    keys, names = KEYS[table], snapshot_schema(table).names
    payload = [c for c in names if c not in keys]
    new = changes.select(*keys, F.struct(*payload).alias("new"))
    old = base.select(*keys, F.struct(*payload).alias("old"))
    wins = F.coalesce(F.col("new.seq") > F.coalesce("old.seq", F.lit(-1)), F.lit(False)) | F.col("old").isNull()
    met = old.join(new, keys, "full").withColumn("x", F.when(wins, F.col("new")).otherwise(F.col("old")))
    return met.select(*keys, "x.*").select(*names)


def _merge_choices(base: DataFrame, log: DataFrame) -> DataFrame:
    at = {c: F.when(F.col("action") == a, F.col("seq")) for a, c in CHOICES.items()}
    newest = log.where(F.col("action").isin(*CHOICES)).groupBy(F.col("customer_id").alias("id"))
    newest = newest.agg(
        *[F.max(seq).alias(f"new_{c}_seq") for c, seq in at.items()],
        *[F.max_by("target_id", seq).alias(f"new_{c}") for c, seq in at.items()],
    )

    def later(c: str) -> Column:
        return F.coalesce(F.col(f"new_{c}_seq") > F.coalesce(f"{c}_seq", F.lit(-1)), F.lit(False))

    chosen = {c: F.when(later(c), F.col(f"new_{c}")).otherwise(F.col(c)) for c in CHOICES.values()}
    chosen |= {f"{c}_seq": F.when(later(c), F.col(f"new_{c}_seq")).otherwise(F.col(f"{c}_seq")) for c in CHOICES.values()}
    return base.join(newest, "id", "left").select(*[chosen.get(c, F.col(c)).alias(c) for c in snapshot_schema("customer").names])


def merge(snapshots: dict[str, DataFrame], log: DataFrame, settled_seq: int | None = None) -> dict[str, DataFrame]:
    """New snapshots after more of the log, for the tables that are given.

    ``current`` of the result is ``changes.apply_changes`` of all that was merged. Removals up to
    ``settled_seq``, below which no change is outstanding, are dropped.
    """
    merged = {}
    for table, base in snapshots.items():
        if table == "customer":
            merged[table] = _merge_choices(base, log)
        elif table == "refused_payment":
            adds = log.where(F.col("action") == "add_payment").withColumn("payment_id", F.col("target_id"))
            merged[table] = base.unionByName(add_payments(adds)[1]).distinct()
        else:
            rows = _merge_rows(table, base, _changes(table, log))
            merged[table] = rows if settled_seq is None else rows.where(f"not gone or seq > {settled_seq}")
    return merged
