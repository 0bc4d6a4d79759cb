"""Matches of the catalog are counted as they are found: no row for each match, no window, no shuffle."""

from pyspark.sql import functions as F

from gleaner.operators.catalog_scan import count_catalog, scan_catalog

CODE = ['@app.get("/a")\n# @app.post("/b")\napp.get("/c", f)', "app.get('/x', list)\n" * 40, "r.GET(\"/y\", list)", "plain words, no code", "", None]


def test_counts_are_those_of_a_scan_and_cross_no_shuffle(spark):
    texts = spark.createDataFrame([(k % 5, t) for k, t in enumerate(CODE * 2)], "id long, text string").repartition(3).localCheckpoint()
    got = count_catalog(texts, "text")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange hashpartitioning" not in plan
    by = ["id", "language", "pattern"]
    want = scan_catalog(texts, "text", comments={}).groupBy(*by).agg(F.count("*").alias("n")).collect()
    assert sorted(map(tuple, got.groupBy(*by).agg(F.sum("n")).collect())) == sorted(map(tuple, want)) and len(want) > 8
