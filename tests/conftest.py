import datetime as dt
import tempfile
from decimal import Decimal

import pytest

from wayfare.session import build_session
from wayfare.sources.schemas import schema_of


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "wayfare-tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="wayfare-tests-"),
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make(spark):
    """Build one of the stored tables from rows given as dicts; absent columns are NULL."""

    def build(table, rows):
        schema = schema_of(table)
        return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)

    return build


def at(text):
    return dt.datetime.fromisoformat(text)


def usd(text):
    return Decimal(text)
