from quernel.llm.sampling import bounded_sample


def test_bounded_and_repeatable(spark):
    df = spark.range(20_000).selectExpr("cast(id % 5000 as string) as t")
    a, b = bounded_sample(df, 100), bounded_sample(df.repartition(13), 100)
    assert len(a) == 100 == len(set(a)) and a == b
    assert len(bounded_sample(df.limit(30), 100)) <= 30
    assert bounded_sample(df.where("false"), 5) == []


def test_many_copies(spark):
    df = spark.range(50_000).selectExpr("if(id < 49000, 'same', cast(id as string)) as t")
    assert len(bounded_sample(df, 500)) == 500
