from __future__ import annotations

from quantra.sources.fixtures import view


def test_every_order_is_a_candidate(spark, tmp_path):
    orders = spark.range(45).selectExpr("id AS o_orderkey", "'1-URGENT' AS o_orderpriority", "10.0D AS o_totalprice")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    assert sorted(r.candidate_row_number for r in view(spark, str(tmp_path), "candidates").collect()) == list(range(45))
