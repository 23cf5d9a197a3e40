"""The driver's garbage is collected as its heap fills, not only after a number of cuts."""

from sheetwise.plans import lineage


def test_full_heap_is_collected(spark, monkeypatch):
    beans = lambda: spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    monkeypatch.setattr(lineage, "COLLECT", 1 << 60)
    monkeypatch.setattr(lineage, "FULL", 1.0)
    before = full()
    assert lineage.cut(spark.range(3)).count() == 3 and full() == before
    monkeypatch.setattr(lineage, "FULL", 0.0)
    assert lineage.cut(spark.range(3)).count() == 3 and full() > before


def test_estimates_do_not_grow_from_round_to_round(spark):
    size = lambda df: len(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    rows = spark.range(5).selectExpr("id AS i", "id AS v")
    for _ in range(6):
        rows = lineage.cut(rows.join(rows.withColumnRenamed("v", "w"), "i").selectExpr("i", "v + w AS v"))
    assert sorted(map(tuple, rows.collect())) == [(i, 64 * i) for i in range(5)]
    assert size(rows) < 25
