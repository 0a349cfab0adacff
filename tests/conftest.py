import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("TZ", "UTC")

from wayline import schema  # noqa: E402
from wayline.session import local_scratch  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    local_scratch(session)
    yield session
    session.stop()


@pytest.fixture()
def conf(spark):
    """Set session options for one test."""
    saved = {}

    def put(**options):
        for key, value in options.items():
            key = key.replace("__", ".")
            saved.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield put
    for key, value in saved.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def route(db, sc, wh, client, way, n, org="ORG", account="ACCT"):
    return (db, sc, wh, client, way, org, account, n)


@pytest.fixture(scope="session")
def make_routes(spark):
    def make(*rows):
        return spark.createDataFrame([route(*r) for r in rows], schema.CLEAN_ROUTES)
    return make


#: Six routes over two databases; the first and the last are one route.
SAMPLE = [
    ("SALES", "SALES.A", "W1", "Tableau", "read", 100),
    ("SALES", "SALES.A", "W1", "dbt", "write", 200),
    ("HR", "HR.B", "W2", "Power BI", "read", 150),
    ("HR", "HR.B", "W2", "Looker", "read", 50),
    ("HR", "HR.B", "W2", "dbt", "DDL", 300),
    ("SALES", "SALES.A", "W1", "Tableau", "read", 80),
]


@pytest.fixture(scope="session")
def sample(make_routes):
    return make_routes(*SAMPLE).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], schema.CLEAN_ROUTES)


def rows(df):
    """Rows as plain tuples in a fixed order."""
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple(map(repr, r)))
