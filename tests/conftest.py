import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from siftbase.session import build_session

    session = build_session("local[8]", "tests", 8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate a column expression over literal rows: one(builder, [values]) -> list."""
    from pyspark.sql import functions as F

    def run(build, values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
        return [r.out for r in df.select("i", build(F.col("v")).alias("out")).orderBy("i").collect()]

    return run
