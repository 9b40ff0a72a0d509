import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("rowmill-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def table(spark):
    """A small DataFrame from a schema string and rows."""
    return lambda schema, *rows: spark.createDataFrame([tuple(r) for r in rows], schema)


def values(df, column, order=None):
    """One column as a list, ordered if asked for."""
    df = df.orderBy(order) if order else df
    return [row[0] for row in df.select(f"`{column}`").collect()]


def rows(df, *columns, order=None):
    df = df.orderBy(order) if order else df
    return [tuple(r) for r in df.select(*[f"`{c}`" for c in columns] or ["*"]).collect()]
