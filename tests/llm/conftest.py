"""Fixtures of these tests: a session and small frames with awkward rows."""

import pytest


@pytest.fixture(scope="session")
def llm_spark(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    return spark
