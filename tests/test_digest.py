"""Digests of whole rows."""

from pyspark.sql import functions as F

from listwarden.operators.frequency import row_digest


def test_row_digest_tells_rows_apart(spark):
    rows = [("a", "b"), ("ab", ""), ("", "ab"), (None, "ab"), ("-:", "ab"), ("é", "b"), ("-", None), (None, None),
            ("", ""), ("1:a", None), ("a1:", None), ("é" * 3000, "b"), ("é" * 3000, "c")]
    frame = spark.createDataFrame(rows, "a string, b string")
    digest = row_digest([F.col("a"), F.col("b")])
    assert frame.union(frame).select(digest.alias("d")).distinct().count() == len(rows)
    plan = frame.select(digest.alias("d"))._jdf.queryExecution().optimizedPlan().toString()
    assert "octet_length(" in plan and " length(" not in plan.replace("octet_length(", "")
