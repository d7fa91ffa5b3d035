"""Shared Spark session for the tests (local, 8 shuffle partitions)."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL_SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from kbspark.session import ensure_checkpoint_dir
    s = (SparkSession.builder.master("local[*]").appName("kbspark-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    yield s


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SMALL_SF):
        pytest.skip("driver test data not present")
    return SMALL_SF


def one(spark, col, **cols):
    """Evaluate a Column expression over one row built from ``cols``."""
    from pyspark.sql import functions as F
    names = list(cols)
    df = spark.createDataFrame([tuple(cols[n] for n in names)], names) if names else spark.range(1)
    return df.select(col.alias("v") if hasattr(col, "alias") else F.lit(col)).first()["v"]
