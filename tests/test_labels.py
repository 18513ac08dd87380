"""source_labels on values that round to a negative zero, halves, and what is no number, against its SQL text by text."""

import math

import duckdb

from chronotrack.plans import catalog

catalog.load()
BALANCES = [-23.38, -49.99, -50.0, 50.0, 49.99, 0.0, -0.0, -150.0, 250.0, -250.0, 9_876.54, -9_876.54, 1e18, None, math.nan, math.inf, -math.inf]


def test_source_labels_keep_the_sign_of_zero(spark, tmp_path):
    data = [(k, f"s{k}", None if k == 5 else k - 4, b) for k, b in enumerate(BALANCES)]
    spark.createDataFrame(data, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    c = duckdb.connect()
    c.sql(f"create view supplier as select * from '{tmp_path}/supplier.parquet/*.parquet'")
    got = sorted(map(tuple, catalog.QUERIES["source_labels"](spark, str(tmp_path)).select("s_suppkey", "label", "shown").collect()))
    assert got == sorted(c.sql(f"select s_suppkey, label, shown from ({catalog.ORACLES['source_labels']})").fetchall())
    assert got[0][2] == "-0.0" and got[5][2] == "0.0" and got[13][2] is None
