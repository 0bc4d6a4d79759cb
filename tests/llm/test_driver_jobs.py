"""Every job and every broadcast leaves something in the driver's memory: stars need no round to be known as components, texts without copies no broadcast of them all."""

import random

from pyspark.sql import functions as F

from gleaner.llm import shingle_join
from gleaner.llm.common import cut, cut_counted
from gleaner.llm.components import connected_components


def jobs(spark, name, f):
    spark.sparkContext.setJobGroup(name, name)
    out = f()
    spark.sparkContext.setJobGroup("", "")
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_stars_are_components_at_once_and_chains_are_found(spark):
    stars = [(10 * k + j, 10 * k) for k in range(20) for j in range(1, 6)]
    got, n = jobs(spark, "stars", lambda: connected_components(spark.createDataFrame(stars, "a long, b long")).collect())
    assert sorted(map(tuple, got)) == sorted(stars) and n <= 8
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (102, 100), (7, None), (9, 9)]
    got = dict(connected_components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {k: 0 for k in range(1, 41)} | {101: 100, 102: 100}
    assert connected_components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_rows_are_counted_as_they_are_written(spark):
    for df, want in ((spark.range(1_000), 1_000), (spark.range(10).filter("id < 0"), 0), (spark.range(90).groupBy(F.col("id") % 9).count(), 9)):
        out, n = cut_counted(df)
        assert (n, out.count()) == (want, want)


def test_only_copies_are_broadcast(spark, monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choices("abcdefgh", k=30)) for _ in range(60)] + ["one text of five words alike"] * 4 + ["", None]
    rows = [(bytes([k]), k, t) for k, t in enumerate(texts)]
    again = []
    monkeypatch.setattr(shingle_join, "BROADCAST_ROWS", 5)  # 4 copies are fewer; all sets are more, which then are written a second time
    monkeypatch.setattr(shingle_join, "cut", lambda df: again.append(df.columns) or cut(df))
    common = spark.sparkContext.broadcast(shingle_join._common(spark.createDataFrame(rows, "_row binary, doc_id long, text string"), 5))
    d, one, sets, counts, places = shingle_join._sets(spark.createDataFrame(rows, "_row binary, doc_id long, text string"), 5, 0.8, common, None)
    assert len(again) == 1 and d.count() == 66 and one.count() == 62
    assert {r.id for r in sets.collect()} == {r.number for r in one.collect()} and sets.count() == 62
    assert places == d.agg(F.sum(F.size("keys"))).first()[0]
