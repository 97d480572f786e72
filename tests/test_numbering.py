from plinth.operators.numbering import numbered


def test_numbers_follow_the_order(spark):
    df = spark.createDataFrame([(i * 37 % 500, f"x{i}", i) for i in range(500)], "v int, part string, base int").repartition(7)
    got = {r.v: r.n for r in numbered(df, ["v"], "n", 10).collect()}
    assert got == {v: v + 11 for v in range(500)}
    again = numbered(df.selectExpr("v % 3 as v", "part", "base", "-1 as n"), ["v"], "n")
    rows = again.collect()
    assert again.columns == ["v", "part", "base", "n"] and sorted(r.n for r in rows) == [*range(1, 501)] and [r.v for r in sorted(rows, key=lambda r: r.n)] == sorted(r.v for r in rows)
    assert numbered(df.limit(0), ["v"], "n").collect() == []
    assert sorted(r.place for r in numbered(df.select("v"), ["v"], "place").collect()) == [*range(1, 501)]
