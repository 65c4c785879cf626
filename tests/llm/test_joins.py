import pytest

from tallyloom.llm import joins


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_a_hot_key_is_joined_alike_either_way(spark, how):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 50}", None if i % 7 else "x") for i in range(600)] + [(1000, None, "x")], "i bigint, k string, other string")
    table = spark.createDataFrame([("hot", 1), *((f"k{i}", i) for i in range(0, 50, 2))], "k string, v int")
    got = [sorted(map(tuple, joins.join_per_key(rows, table, ["k"], how, broadcast_rows=n).collect()), key=str) for n in (100, 3, 0)]
    assert got[0] == got[1] == got[2] == sorted(map(tuple, rows.join(table, "k", how).collect()), key=str) and got[0]
    plan = joins.join_per_key(rows, table, ["k"], how, broadcast_rows=0)._jdf.queryExecution().toString()
    assert "_salt" in plan
