import pytest
from awkward_rows import AWKWARD
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setCheckpointDir(f"file://{tmp_path_factory.mktemp('shared')}")
    return session


@pytest.fixture(scope="session")
def awkward(spark):
    rows = [(i, t, "en", "s", 0, "clash") for i, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, h string").repartition(3)


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.where("false")
