"""Helpers of these tests."""

import os

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def documents(spark, sf=SF, name="documents", key="doc_id", text="text"):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(key, text).collect()]
