from pyspark.sql import functions as F

from caseloom.session import cut_lineage


def test_estimates_do_not_multiply_over_rounds_of_joins(spark):
    """Each round joins a table with itself on a column that is no key; the rows and columns stay what they are."""
    data = cut_lineage(spark.createDataFrame([(i, i % 3, f"t{i}") for i in range(9)], "id bigint, part bigint, text string"))
    whole = sorted(map(tuple, data.collect()))
    for _ in range(8):
        other = data.select("part", F.col("id").alias("other"))
        data = cut_lineage(data.join(other, "part").groupBy("id", "part", "text").agg(F.min("other").alias("low")).select("id", "part", "text"))
        estimate = data._jdf.queryExecution().optimizedPlan().stats().simpleString()
        assert "E+" not in estimate
    assert sorted(map(tuple, data.collect())) == whole
    assert data.join(data.select(F.col("id").alias("other"), "part"), "part").count() == 27


def test_a_table_of_known_size_keeps_its_estimate(spark):
    data = cut_lineage(spark.range(5).withColumn("text", F.lit("a")))
    assert "EiB" not in data._jdf.queryExecution().optimizedPlan().stats().simpleString()
