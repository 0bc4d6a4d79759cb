"""Pairs are held against each other by their whole prefixes before texts are fetched; terms are those of the pattern."""

import random

from gleaner.llm.lexical_search import TERM, terms
from gleaner.llm.shingle_join import _close_prefixes, prefix_size


def test_pairs_that_share_too_few_keys_go_and_no_similar_pair_does(spark):
    rng = random.Random(3)
    base = [rng.sample(range(100_000), 60) for _ in range(12)]
    sets = [set(b) for b in base] + [set(b[: rng.randint(50, 60)]) | set(rng.sample(range(100_000), rng.randint(0, 6))) for b in base * 4]
    sets += [{-1, *rng.sample(range(100_000), 59)} for _ in range(10)] + [{-2}, {-2, -3}, set()]
    rows = [(i, len(s), sorted(s)[: prefix_size(len(s), 0.8) + 1]) for i, s in enumerate(sets)]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a)]
    kept = {tuple(r) for r in _close_prefixes(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(rows, "id long, n int, keys array<long>"), 0.8).collect()}
    alike = {(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert len(alike) > 20 and alike <= kept
    lone = {(a, b) for a, b in pairs if sets[a] & sets[b] == {-1}}  # they share one key, the first of all, and nothing else
    assert len(lone) > 40 and not lone & kept


def test_terms_are_those_of_the_pattern():
    rng = random.Random(5)
    text = "".join(rng.choice([chr(k) for k in range(128)] + list("éÉßΣ漢  😀İ")) for _ in range(20_000))
    lower = text.translate({k: k + 32 for k in range(65, 91)})
    assert terms(text) == TERM.findall(lower) and terms(None) == terms("") == []
