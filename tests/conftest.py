import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TESTDATA = Path("/root/testdata")
TABLES = ("customer", "orders", "events")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("cohortry-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.maxMetadataStringLength", "5000")
        .config("spark.sql.debug.maxToStringFields", "200")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck_for():
    """A DuckDB connection with the sample tables of one scale as views."""
    open_connections = {}

    def connect(sf: str):
        if sf not in open_connections:
            con = duckdb.connect()
            for name in TABLES:
                con.execute(
                    f"CREATE VIEW {name} AS SELECT * FROM '{TESTDATA}/sf{sf}/{name}.parquet'"
                )
            open_connections[sf] = con
        return open_connections[sf]

    return connect
