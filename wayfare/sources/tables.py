"""Readers with declared schemas, and writers laid out for the later reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from wayfare.constants import CABIN_CLASSES, MONEY
from wayfare.operators.search import flying_times
from wayfare.sources.manifest import Store, Version
from wayfare.sources.schemas import CODE_COLUMNS, TABLES, schema_of


def read_table(
    spark: SparkSession, table: str, path: str, format: str = "parquet", **options: str
) -> DataFrame:
    """Read one table from parquet, ORC, JSON or CSV with its declared schema.

    Blank padding of fixed-width codes is trimmed from text formats, which may carry it. Columnar
    files are read as they are, so filters on codes still reach the scan.
    """
    reader = spark.read.schema(schema_of(table)).options(**options)
    if format in ("csv", "json"):
        reader = reader.option("mode", "FAILFAST")
    if format == "csv" and "header" not in options:
        reader = reader.option("header", "true")
    df = reader.format(format).load(path)
    if format in ("csv", "json"):
        df = df.withColumns({c: F.rtrim(c) for c in CODE_COLUMNS.get(table, [])})
    return df


def read_quarantined(
    spark: SparkSession, table: str, path: str, format: str = "csv", **options: str
) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a text table, for files that may hold broken rows.

    Every value is read as text and then cast by itself. A row goes to the rejects if the reader cannot tell
    its columns apart, or if a value that is there cannot be read as its type. Rejects: the values as
    text, ``broken_row`` (the raw line, where that is what is wrong) and ``bad_columns``. Both are read
    from one scan's plan, and every line that is no header is in exactly one of them.
    """
    if format not in ("csv", "json"):
        raise ValueError(f"{format} files are typed")
    declared = schema_of(table)
    text = StructType([StructField(f.name, StringType()) for f in declared] + [StructField("broken_row", StringType())])
    reader = spark.read.schema(text).options(**{"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken_row", **options})
    if format == "csv" and "header" not in options:
        reader = reader.option("header", "true")
    read = reader.format(format).load(path)
    codes = CODE_COLUMNS.get(table, [])
    read = read.withColumns({c: F.rtrim(c) for c in codes})
    typed = {f.name: F.col(f.name).try_cast(f.dataType) for f in declared}
    bad = [F.when(F.col(c).isNotNull() & v.isNull(), F.lit(c)) for c, v in typed.items()]
    read = read.withColumn("bad_columns", F.array_compact(F.array(*bad)))
    # The raw line of a broken row is told on reading all columns, which both outputs do.
    good = F.col("broken_row").isNull() & (F.size("bad_columns") == 0)
    return read.where(good).select(*[v.alias(c) for c, v in typed.items()]), read.where(~good)


def read_tables(spark: SparkSession, root: str, format: str = "parquet") -> dict[str, DataFrame]:
    """All tables stored under ``root``, one folder each."""
    return {table: read_table(spark, table, f"{root}/{table}", format) for table in TABLES}


def cabin_classes(spark: SparkSession) -> DataFrame:
    """The standard cabin classes: id, display_name, fee."""
    rows = ", ".join(f"({i}, '{name}', {fee})" for i, name, fee, _ in CABIN_CLASSES)
    raw = spark.sql(f"SELECT * FROM VALUES {rows} AS t(id, display_name, fee)")
    return raw.withColumn("fee", F.col("fee").cast(MONEY))


def write_flights(flights: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store flights by departure date.

    The range partitioning spreads a busy date over several tasks while a quiet one makes one
    file, and keeps each file to few airports, which the file statistics then prune. The shortest and
    longest flight are kept beside the table for ``search.within_horizon``.
    """
    (
        flights.withColumn("departure_date", F.to_date("departure_time"))
        .repartitionByRange("departure_date", "departure_airport", "departure_time", "id")
        .sortWithinPartitions("departure_date", "departure_airport", "departure_time")
        .write.mode(mode)
        .partitionBy("departure_date")
        .parquet(path)
    )
    stored = read_flights(flights.sparkSession, path)
    flying_times(stored).coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}_times")


def read_flying_times(spark: SparkSession, path: str) -> DataFrame:
    """The shortest and longest flight of a table stored by :func:`write_flights`, from one small file."""
    return spark.read.parquet(f"{path.rstrip('/')}_times")


def read_flights(spark: SparkSession, path: str) -> DataFrame:
    """Flights as stored by :func:`write_flights`; filters on ``departure_date`` prune folders."""
    schema = schema_of("flight").add("departure_date", "date")
    return spark.read.schema(schema).parquet(path)


def write_fares(fares: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store fares by departure date, as :func:`write_flights` does with flights, where they carry
    one; within a date by flight, so that a join finds them sorted by its key."""
    if "departure_date" not in fares.columns:
        fares.write.mode(mode).parquet(path)
        return
    order = ["departure_date", "flight_id", "class_id"]
    dealt = fares.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.write.mode(mode).partitionBy("departure_date").parquet(path)


def read_fares(spark: SparkSession, path: str) -> DataFrame:
    """Fares as stored by :func:`write_fares` with dates; filters on ``departure_date`` prune folders."""
    return spark.read.schema(schema_of("flight_class").add("departure_date", "date")).parquet(path)


def append_tickets(tickets: DataFrame, path: str, run: str) -> Version:
    """Add the tickets of a run to the store at ``path``; a run that is repeated adds nothing."""
    return Store(tickets.sparkSession, path).append({"ticket": tickets}, run)


def read_tickets(spark: SparkSession, path: str) -> DataFrame:
    """The tickets of all committed runs and batches of a store."""
    return Store(spark, path).read("ticket", schema_of("ticket"))


def fares_by_flight(fares: DataFrame) -> DataFrame:
    """flight_id, fares: the classes of each flight in one row (class_id, capacity, price), so that tables
    bucketed by flight alone serve joins by flight and by flight and class."""
    return fares.groupBy("flight_id").agg(F.collect_list(F.struct("class_id", "capacity", "price")).alias("fares"))


def save_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int, **options: str) -> None:
    """Save a catalog table bucketed and sorted by ``keys``.

    Flights bucketed by ``id`` and fares by ``flight_id``, with the same number of buckets, join
    without a shuffle; so do tickets bucketed by ``flight`` and ``class_id`` with fares bucketed
    by ``flight_id`` and ``class_id``.
    """
    # Laid out by bucket first, every task writes one file for each of its buckets.
    (
        df.repartition(buckets, *keys)
        .write.mode("overwrite")
        .options(**options)
        .bucketBy(buckets, *keys)
        .sortBy(*keys)
        .saveAsTable(name)
    )
