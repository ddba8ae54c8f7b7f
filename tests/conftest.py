import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "3")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def same(spark_df, duck_df) -> None:
    """Equal rows in any order, columns by name."""
    a = spark_df.toPandas()
    cols = sorted(a.columns)
    assert cols == sorted(duck_df.columns)
    x, y = (f[cols].astype(str).sort_values(cols).reset_index(drop=True) for f in (a, duck_df))
    assert len(x) == len(y)
    assert x.equals(y), x[(x != y).any(axis=1)].head()
