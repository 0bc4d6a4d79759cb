"""The pipeline against a brute-force version, and the queries' registration."""

import collections
import re

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tests.llm.test_operators import DOCS, components, prose, slow_alignment, slow_fingerprint
from tests.llm.test_whole_job import jaccard


def test_registered():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_run(spark, tmp_path):
    import random

    r = random.Random(3)
    vocabulary = ["".join(r.choices("abcdefghijklm", k=6)) for _ in range(3000)]
    text = lambda n: " ".join(r.choices(vocabulary, k=n))
    items = [(k, text(25)) for k in range(3)]
    rows = [(k, text(120 + k), "en", f"s{k % 3}", 1) for k in range(60)]
    rows += [(60, rows[5][1], "en", "s0", 1), (61, rows[5][1].upper(), "en", "s0", 1), (62, f"{text(80)} {items[1][1]} {text(50)}", "en", "s1", 1), (63, "1234 --", "en", "s1", 1), (64, None, None, None, None), (65, "", "en", "s2", 0)]
    rows += [(None, text(100), "en", "s1", 1), (70, text(3000), "en", "s2", 1)]
    edited = rows[30][1].split()  # a similarity of 0.85 or so, with fingerprints further apart than 4 bits
    edited[40], edited[90] = "other", "words"
    rows.append((80, " ".join(edited), "en", "s1", 1))
    assert 0.8 <= jaccard(rows[30][1], rows[-1][1]) < 0.9 and (slow_fingerprint(rows[30][1]) ^ slow_fingerprint(rows[-1][1])).bit_count() > 4
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = [x for x in rows if x[1] and any(c.isalpha() for c in x[1])]
    part = components([x[1] for x in left], lambda a, b: jaccard(a, b) >= 0.8)
    left = [x for k, x in enumerate(left) if part[k] == k]
    norm = lambda t: re.findall(r"\w+", t.lower())
    left = [x for x in left if not any(slow_alignment(norm(i), norm(x[1])) >= len(norm(i)) for _, i in items)]
    assert {x[0] for x in left} == {*range(60), 70, None}
    size = collections.Counter()
    for x in left:
        size[x[3]] += len(x[1].split())
    total, want = sum(size.values()), {"s0": 1, "s1": 2, "s2": 3}
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    n_tokens = {x[0]: len(t.encode(x[1], add_special_tokens=False).ids) + 1 for x in left}
    whole = collections.Counter(g["doc_id"] for g in got if g["n_tokens"] == n_tokens[g["doc_id"]])
    words = collections.Counter()
    for x in left:
        words[x[3]] += whole[x[0]] * len(x[1].split())
    for s in size:  # all but the one document at the cut come whole
        assert 0 <= total * want[s] / 6 - words[s] < (3000 if s == "s2" else 200)
    assert sum(g["n_tokens"] for g in got) == max(g["start"] + g["n_tokens"] for g in got)
    assert np.all(np.diff([-1 if g["doc_id"] is None else g["doc_id"] for g in sorted(got, key=lambda g: g["start"])]) >= 0)
    for (name, stage), keep in zip(corpus_pipeline.STAGES, (1, 1, 1, 1, 0), strict=True):
        empty = spark.createDataFrame([], DOCS).withColumns({c: F.lit("clash") for c in ("x", "_row", "doc", "id", "fp", "size", "item_id", "score", "part", "m")})
        out = stage(spark, empty, str(tmp_path))
        assert out.count() == 0 and (not keep or out.columns == empty.columns), name
