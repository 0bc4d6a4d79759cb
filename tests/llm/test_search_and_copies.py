"""Ranked search, spelling variants and exact copies on small rows: brute force, nulls, empty and long texts, ties, repeats, empty tables, other columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from gleaner.llm import common, exact_dedup, lexical_search, spelling
from tests.llm.test_operators import ODD, none, odd, prose  # noqa: F401

CLASH = ("row", "part", "run", "keep", "n", "edge", "term", "c", "tf", "item", "sha", "first", "word", "rank")


@pytest.fixture(scope="module")
def odder(odd):  # noqa: F811
    return odd.withColumns({c: F.lit("clash") for c in CLASH})


# exact copies


def slow_groups(rows):
    ids = collections.defaultdict(list)
    for x in rows:
        ids[x[1] or ""].append(x[0])
    out = []
    for text, g in ids.items():
        keep = max((i for i in g if i is not None), default=None)
        at = g.index(keep)
        out += [(i, keep, len(g), k == at, hashlib.sha256(text.encode()).hexdigest()) for k, i in enumerate(g)]
    return out


def told(df):
    return collections.Counter((x["doc_id"], x["keep_id"], x["group_size"], x["kept"], x["text_sha256"]) for x in df.collect())


def test_exact_copies(odder, none):  # noqa: F811
    assert told(exact_dedup.duplicate_groups(odder)) == collections.Counter(slow_groups(ODD))
    assert exact_dedup.duplicate_groups(none).count() == 0
    stay = exact_dedup.without_exact_copies(odder)
    assert stay.columns == odder.columns and stay.select("text").distinct().count() == len({x[1] or "" for x in ODD})


def test_groups_span_ranges(spark):
    """Groups of a third of all rows, with neighbours that share a long beginning, over many ranges; some ranges hold one run alone."""
    r = random.Random(7)
    long = prose(1, 400)
    rows = [(k, long if k % 3 == 0 else long + str(r.randrange(40)) if k % 3 == 1 else r.choice(["", None, f"own {k}"])) for k in range(3000)]
    rows += [(k, long) for k in (0, 0, 2999)]
    r.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
        assert told(exact_dedup.duplicate_groups(docs)) == collections.Counter(slow_groups(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# ranked search


def slow_search(rows, items, k):
    lower = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs = [(x[0], collections.Counter(lower(x[1]))) for x in rows]
    n_docs, n_terms = sum(bool(c) for _, c in docs), sum(sum(c.values()) for _, c in docs)
    df = collections.Counter(t for _, c in docs for t in c)
    out = []
    for item_id, text in items:
        found = []
        for doc_id, c in docs:
            m = 50 + (50 * sum(c.values()) * n_docs) // max(1, n_terms)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(lower(text)) if c[t])
            if s > 0:
                found.append((-s, -1 if doc_id is None else doc_id))
        out += [(item_id, n, None if d < 0 else d, -s) for n, (s, d) in enumerate(sorted(found)[:k], 1)]
    return collections.Counter(out)


def searched(df):
    return collections.Counter((x["item_id"], x["rank"], x["doc_id"], x["score"]) for x in df.collect())


ITEMS = [(1, "the RIVER, stone and lamp"), (2, None), (3, ""), (4, "nothing-like-it zzz"), (5, "Àé 漢字 line 4111"), (6, prose(9, 500)), (7, "river river stone"), (7, "engine"), (None, "garden"), (8, "garden"), (8, "garden")]


@pytest.mark.parametrize("k", [1, 3, 50])
def test_search(spark, odder, none, k):  # noqa: F811
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert searched(lexical_search.ranked_search(odder, items, k)) == slow_search(ODD, ITEMS[:-1], k)
    assert lexical_search.ranked_search(none, items).count() == 0 and lexical_search.ranked_search(odder, items.limit(0)).count() == 0


@pytest.mark.parametrize(("known", "hot"), [(500_000, 2_048), (0, 20)])
def test_thresholds_prune_and_lose_nothing(spark, known, hot, monkeypatch):
    """Short items over many documents, so that thresholds cut lists off; with ties, and with hot terms and terms too many to be broadcast."""
    for m in (common, lexical_search):
        monkeypatch.setattr(m, "BROADCAST_ROWS", known)
        monkeypatch.setattr(m, "HOT_PARTS", hot)
    r = random.Random(5)
    vocabulary = ["".join(r.choices("abcdefgh", k=4)) for _ in range(150)]
    rows = [(k, " ".join(r.choices(vocabulary, [1 / (i + 1) for i in range(150)], k=r.randint(1, 40)))) for k in range(700)]
    rows += [(k, rows[0][1]) for k in range(700, 720)]
    items = [(k, " ".join(r.choices(vocabulary, k=r.randint(1, 4)))) for k in range(25)]
    got = lexical_search.ranked_search(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), 5)
    assert searched(got) == slow_search(rows, items, 5)


# spelling variants


def slow_variants(rows, noise=199, least=5, length=6, ratio=5):
    n = collections.Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % noise == 0 else w] += 1
    n = {w: c for w, c in n.items() if len(w) >= length and c >= least}

    def edits(w):
        letters = {c for x in n for c in x}
        cuts = {w[:i] + w[i + 1 :] for i in range(len(w))}
        puts = {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        swaps = {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
        return ((cuts | puts | swaps) - {w}) & n.keys()

    form, near = {}, {w: edits(w) for w in n}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), c, len(near[w]), n.get(form[w])) for w, c in n.items()}


def variants(df):
    return {x["word"]: (x["form"], x["root"], x["n"], x["n_near"], x["form_n"]) for x in df.collect()}


@pytest.mark.parametrize("block", [20_000, 7])
def test_variants(spark, odder, none, block, monkeypatch):  # noqa: F811
    monkeypatch.setattr(spelling, "BLOCK", block)
    r = random.Random(3)
    words = ["".join(r.choices("abé", k=r.randint(5, 9))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "ababab", "bababa", "Ünïcödé", "ÀÉÎÕÜø"]
    spoilt = lambda w: w[: (i := r.randrange(len(w)))] + r.choice(["", "a", "b", "x"]) + w[i + r.randint(0, 1) :]
    rows = []
    for k in range(400):
        tokens = r.choices(words, [1 / (i % 20 + 1) ** 2 for i in range(len(words))], k=60)
        rows.append((k if k % 50 else None, "; ".join(spoilt(w) if r.random() < 0.2 else w.upper() if r.random() < 0.1 else w for w in tokens)))
    rows.append((800, "lanternsx " * 6 + "lanterns " * 31 + "lantern " * 160))
    rows += [(900, None), (901, ""), (902, "1 2 3"), (903, "q" * 100_000 + " " + "q" * 100_000), *[(904, "z" * 3000)] * 5, *[(905, "z" * 2999)] * 30]
    want = slow_variants(rows[:-35])
    got = variants(spelling.variant_groups(spark.createDataFrame(rows, "doc_id bigint, text string")))
    long = {w: got.pop(w) for w in list(got) if len(w) > 1000}
    assert got == want and any(f and f != t for f, t, *_ in want.values())
    assert {len(w): (len(x[0]) if x[0] else None, x[2], x[3]) for w, x in long.items()} == {3000: (2999, 5, 1), 2999: (None, 30, 1)}
    assert variants(spelling.variant_groups(odder)) == slow_variants([x[:2] for x in ODD])
    assert spelling.variant_groups(none).count() == 0


def test_every_edit_is_found():
    r = random.Random(4)
    some = sorted({"".join(r.choices("ab", k=6)) for _ in range(40)} | {"".join(r.choices("ab", k=7)) for _ in range(60)})
    for size in (6, 7):
        index = [w for w in some if len(w) == size]
        asked = [w for w in some if len(w) in (size, size + 1)]
        assert sorted(spelling.near_in_block(index, iter(asked))) == sorted((a, b) for a in asked for b in index if spelling.one_edit(a, b) and (len(a) > len(b) or a > b))
