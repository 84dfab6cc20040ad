"""A change of a stored table shuffles its rows once."""

from postforge.sources.store import Store, Table


def test_a_change_shuffles_once(spark, tmp_path):
    store = Store(spark, str(tmp_path), {"t": Table("id long, a string, b long", ["id"], 4)})
    old = spark.range(50).selectExpr("id", "'old' AS a", "id AS b")
    new = spark.range(40, 60).selectExpr("id", "IF(id % 2 = 0, 'new', NULL) AS a", "id * 2 AS b").union(spark.sql("SELECT 45L, 'z', 1L"))
    out = store._dealt("t", old, new)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    store.upsert("t", old)
    store.upsert("t", new)
    want = {i: ("old", i) for i in range(40)} | {i: ("new" if i % 2 == 0 else None, i * 2) for i in range(40, 60)} | {45: ("z", 1)}
    assert {r["id"]: (r["a"], r["b"]) for r in store.read("t").collect()} == want
