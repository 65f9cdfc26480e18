from placespark.llm.common import about


def test_about(spark):
    df = spark.range(5000).withColumnRenamed("id", "key")
    found = {r["key"] for r in about(df, "key", 300).collect()}
    assert 300 <= len(found) < 600
    assert found <= {r["key"] for r in about(df, "key", 1000).collect()}
    assert about(df, "key", 3000).count() == 5000 and about(df.limit(0), "key", 3).count() == 0
