"""Documents with very many entities and terms: as by brute force, in time that doesn't grow with their product."""

import random
import time

from gleaner.llm import privacy
from tests.llm.test_operators import DOCS, prose, slow_terms


def directories(n_addresses, n_words, seed=2, parts=1):
    """Six lists of the same addresses and words in different order; the first ones have all, others lack some."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("bcdfghklmnprst", k=7))
    mails, words = [f"u{k}@{word()}.example.org" for k in range(n_addresses)], [word() for _ in range(n_words)]
    rows = []
    for d in range(6):
        some = [x for k, x in enumerate(mails + words) if k % parts != d or parts == 1]
        r.shuffle(some)
        rows.append((d, " ".join(some), None, None, 1))
    return rows + [(100 + k, prose(k, 30), None, None, 1) for k in range(60)]


def spans(found):
    return {(x["doc_id"], s["start"], s["end"]) for x in found for s in x["found"] if s["kind"] == "term"}


def test_against_all_pairs(spark):
    for rows in (directories(30, 80), directories(30, 80, parts=7)):
        found = privacy.find_private(spark.createDataFrame(rows, DOCS)).collect()
        assert spans(found) == slow_terms(rows) != set()


def test_time_of_a_directory(spark):
    rows = directories(500, 2000)
    began = time.time()
    found = privacy.find_private(spark.createDataFrame(rows, DOCS)).collect()
    took = time.time() - began
    assert len(spans(found)) >= 6 * 2000 and took < 60  # 10 to 15 s on an idle machine of eight cores; over two minutes with a row for each address and word
