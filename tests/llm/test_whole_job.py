"""Whole results where an earlier version left some out."""

import itertools
import random

import pytest

import corpus_pipeline
from gleaner.llm import decontamination, shingle_join, simhash
from tests.llm.test_operators import DOCS, components


def jaccard(a, b):
    x, y = ({tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b))
    return len(x & y) / len(x | y)


def near_texts():
    r = random.Random(11)
    vocabulary = ["".join(r.choices("abcdefghij", k=5)) for _ in range(900)]
    line = r.choices(vocabulary, k=12)  # a line that many have
    out = []
    for g in range(25):
        base = r.choices(vocabulary, k=r.randint(15, 120)) + line * (g % 3)
        for _ in range(r.randint(1, 8)):
            t = list(base)
            for _ in range(r.randint(0, 3)):
                t[r.randrange(len(t))] = r.choice(vocabulary)
            out.append(" ".join(t[r.randint(0, 2) :]))
    return out + ["a b", "A  b", "a b c d e", ""]


@pytest.mark.parametrize("block", [shingle_join.BLOCK, 2])
def test_similar_against_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(shingle_join.similar_components, "__defaults__", (4, block))
    monkeypatch.setattr(shingle_join, "MANY", 3 if block == 2 else shingle_join.MANY)
    texts = near_texts()
    near = [jaccard(a, b) for a, b in itertools.combinations(texts, 2)]
    assert sum(0.8 <= s < 0.9 for s in near) > 5 and sum(0.7 < s < 0.8 for s in near) > 5
    part = components(texts, lambda a, b: jaccard(a, b) >= 0.8)
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], DOCS)
    got = corpus_pipeline.near_copies(spark, docs, "")
    assert got.columns == docs.columns and sorted(x["doc_id"] for x in got.collect()) == [k for k in range(len(texts)) if part[k] == k]


def test_edited_copies_in_many_documents(spark):
    r = random.Random(12)
    vocabulary = ["".join(r.choices("abcdefghij", k=5)) for _ in range(2000)]
    new = lambda n: r.choices(vocabulary, k=n)
    items = [new(30), new(30)]
    copies = [[*i[:14], "changed", *i[15:]] for i in items]
    rows = [(100 * k + d, " ".join(new(40) + c + new(40))) for k, c in enumerate(copies) for d in range(40)]
    rows += [(300, " ".join(new(20) + items[1] + new(20))), (301, " ".join(new(100))), (302, " ".join(items[0][:5] + new(60)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id bigint, text string")
    found = sorted((x["doc_id"], x["item_id"]) for x in decontamination.find_leaks(docs, bench).collect())
    assert found == sorted([(100 * k + d, k) for k in range(2) for d in range(40)] + [(300, 1)])
    assert sorted(x["doc_id"] for x in decontamination.decontaminate(docs, bench).collect()) == [301, 302]


@pytest.mark.parametrize("limit", [shingle_join.LIMIT, 3])
def test_a_rare_line_in_many_unlike_texts(spark, limit, monkeypatch):
    """5,000 unlike texts share a line, among others: no pair of them is looked at, and near copies among them are still found."""
    monkeypatch.setattr(shingle_join, "LIMIT", limit)
    monkeypatch.setattr(shingle_join, "SAMPLE_DOCS", 40)  # the sample sees too little of the line
    r = random.Random(13)
    vocabulary = ["".join(r.choices("abcdefghij", k=5)) for _ in range(4000)]
    line = r.choices(vocabulary, k=12)
    texts = [" ".join(r.choices(vocabulary, k=30) + line) for _ in range(5000)] + [" ".join(r.choices(vocabulary, k=40)) for _ in range(3000)]
    for k in (0, 7, 9):
        t = texts[k].split()
        t[20 + k] = "other"
        texts.append(" ".join(t[1:]))
    assert all(jaccard(texts[k], texts[8000 + i]) < 0.8 for i, k in enumerate((0, 7, 9)))
    for k in (4999, 4998, 4998):
        texts.append(texts[k] + " end")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(8)
    seen = []
    real = shingle_join.verified
    monkeypatch.setattr(shingle_join, "verified", lambda pairs, *a: (seen.append(pairs.count()), real(pairs, *a))[1])
    got = {x["doc_id"] for x in simhash.without_near_copies(docs, words_in_shingle=5, similarity=0.8).collect()}
    assert got == set(range(8003))
    assert sum(seen) < 3_000


def test_rows_of_either_key(spark):
    """Without a similarity, rows are told apart by id and text as well."""
    rows = [(1, "one two three four five"), (1, "one two three four five"), (1, "six seven eight nine ten"), (None, None), (None, "")]
    got = simhash.without_near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((x["doc_id"] or 0, x["text"] or "") for x in got) == [(0, ""), (1, "one two three four five"), (1, "six seven eight nine ten")]
