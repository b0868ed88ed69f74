from quernel.llm.once import once


def test_least_row_and_unknown_keys(spark):
    rows = [("a", 1, [2, 1]), ("a", 1, [1, 9]), (None, 3, [1]), (None, 3, [1]), ("b", None, None)]
    df = spark.createDataFrame(rows, "id string, n int, xs array<int>").repartition(3)
    got = sorted(map(str, once(df, "id").collect()))
    assert got == sorted(["Row(id='a', n=1, xs=[1, 9])", "Row(id='b', n=None, xs=None)", "Row(id=None, n=3, xs=[1])", "Row(id=None, n=3, xs=[1])"])
    assert once(df.where("false"), "id", "n").count() == 0
