"""What models are fitted on: bounded by rows, whatever their ids."""

import random

import numpy as np

from gleaner.llm import language_id, quality_trees
from tests.llm.test_operators import DOCS, prose


def test_language_examples_are_picked_by_row(spark, monkeypatch):
    """Rows that share an id, or have none, are picked one by one, never more than the bounds."""
    seen = []
    monkeypatch.setattr(language_id, "fit_language", lambda examples, **o: seen.append(examples) or "model")
    rows = [(18 if k % 2 else None, f"{prose(k, 6)} {k}", "en" if k % 3 else "de", "s", 1) for k in range(3000)] + [(19, "always the same text", "fr", "s", 1)] * 900
    docs = spark.createDataFrame(rows, DOCS).repartition(7)
    assert language_id.train_languages(docs, fit_rows=200) == "model"
    count = lambda: {n: sum(x[2] == n for x in seen[-1]) for n in ("de", "en", "fr")}
    assert count() == {"de": 200, "en": 200, "fr": 200} and len({x[0].tobytes() for x in seen[-1]}) > 390
    monkeypatch.setattr(language_id, "ALL_ROWS", 90)
    language_id.train_languages(docs, fit_rows=200)
    assert count() == {"de": 30, "en": 30, "fr": 30}
    again = sorted(x[0].tobytes() for x in seen[-1])
    language_id.train_languages(docs.repartition(3), fit_rows=200)
    assert sorted(x[0].tobytes() for x in seen[-1]) == again


def test_quality_examples_are_picked_by_row(spark, monkeypatch):
    seen = []
    real = quality_trees.fit_trees
    monkeypatch.setattr(quality_trees, "fit_trees", lambda x, y, *a: seen.append((x, y)) or real(x, y, *a))
    r = random.Random(1)
    rows = [(18, prose(r.random(), r.randint(5, 60)), "en", "s", 1) for _ in range(2000)] + [(k, prose(k, 20), "en", "s", 1) for k in range(100, 160)]
    labels = spark.createDataFrame([(18, 1), *[(k, k % 2) for k in range(100, 160)], (None, 1)], "doc_id bigint, quality int")
    got = quality_trees.score_quality(spark.createDataFrame(rows, DOCS).repartition(5), labels, fit_rows=300)
    assert got.count() == len(rows) and len(seen[0][1]) == 300
    quality_trees.score_quality(spark.createDataFrame(rows, DOCS).repartition(2), labels, fit_rows=300)
    assert np.array_equal(seen[0][0], seen[1][0])


def test_one_level_against_a_slow_tree():
    """The best split of one level, against every split of every feature tried in turn."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3)).round(1)
    y = ((x[:, 1] > 0.35) ^ (rng.random(400) < 0.1)).astype(float)
    trees = quality_trees.fit_trees(x, y, n_trees=1, depth=1, bins=400)
    p = (y.sum() + 1) / (len(y) + 2)
    g, h, best = p - y, np.full(400, p * (1 - p)), (0, None, None)
    for f in range(3):
        for t in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= t
            gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + 1)
            if gain > best[0]:
                best = (gain, f, t)
    here = x[:, trees.feature[0][0]] <= trees.threshold[0][0]
    assert trees.feature[0][0] == best[1] == 1 and np.array_equal(here, x[:, 1] <= best[2])
