import pytest
from compare import oracle, rows
from pyspark.sql import functions as F

from stepgraph.functions import fields
from stepgraph.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE_SQL:
        assert rows(got) == rows(oracle(ORACLE_SQL[name], SF))
    else:
        assert len(got)


@pytest.mark.parametrize(("text", "want"), [("Tighten the nut to 55 to 65 Ib-ft torque.", 88.1), ("Cap Nut Torque kg-m(Ib.ft/N-m) 3.0 — 4.0 (21.7", 29.4), ("24 N.m (17.7 lb-ft)", 24.0), ("290-310 lb-ft", 393.2), ("1200 N.m", 200.0), ("2.125 N.m", 125.0), ("10 mm", None), (None, None)])
def test_torque(spark, text, want):
    row = spark.createDataFrame([(text,)], "t string").select(fields.torque_nm(F.col("t")).alias("x")).first()
    assert row.x == want


def test_words(spark):
    row = spark.createDataFrame([("Honda GX160_v2!", "Fit it. WARNING: do not exceed 12.5 N.m ever.")], "a string, b string").select(fields.slug(F.col("a")).alias("a"), fields.warning(F.col("b")).alias("b")).first()
    assert tuple(row) == ("honda-gx160-v2", "WARNING: do not exceed 12.")
