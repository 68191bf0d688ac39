"""Rows a known position of reads."""

from readloom.operators import atlases


def test_positions_are_exploded_from_text(spark):
    """characters of a pattern become rows without an array of structs that is made by interpreted functions."""
    rows = spark.createDataFrame([("a", 5, "0212"), ("b", 7, ""), ("c", 9, None), ("d", 1, "2x2")], "name string, read_start long, methylation_ids string")
    got = atlases.positions(rows, "name")
    assert got.dtypes == [("name", "string"), ("pos", "bigint"), ("state", "int")]
    assert sorted(map(tuple, got.collect())) == [("a", 5, 0), ("a", 7, 1)]
    assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()
