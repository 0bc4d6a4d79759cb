"""Each operator on small rows: brute force, nulls, empty and long texts, ties, repeats, empty tables, other columns."""

import collections
import hashlib
import io
import json
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from gleaner.llm import common, decontamination, language_id, line_dedup, mixing, privacy, quality_rules, quality_trees, simhash, text_stats, token_files, warc
from gleaner.llm.components import connected_components

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "river stone lamp garden yellow window carpet silver market bridge apple doctor engine forest hammer island jacket kitchen ladder mirror".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", ".", ","]) for _ in range(n))


SHARED = "This line is found in many of the documents."
ODD = [
    (1, f"{prose(1, 40)}\n{SHARED}\nshort", "en", "a", 1),
    (2, f"{prose(2, 60)}\n  {SHARED.upper()}\t", "en", "b", 1),
    (3, f"{SHARED}\r\n{prose(3, 30)}\nMail to jo.doe@mail.example.org, +1 (555) 010-9999 or 10.0.0.255.", None, "b", 1),
    (3, f"{SHARED}\r\n{prose(3, 30)}\nMail to jo.doe@mail.example.org, +1 (555) 010-9999 or 10.0.0.255.", None, "b", 1),
    (3, "another text of the same id", "fr", None, 1),
    (4, None, "en", "a", None),
    (5, "", None, None, 0),
    (None, f"{prose(5, 25)}\n{SHARED}", "de", "c", 1),
    (None, None, None, None, None),
    (7, " \t\n\n \x0b", "en", "c", 5),
    (8, "Ünïcödé ÀÉ 漢字 😀 𐌰𐌱 é 4111 1111 1111 1111 4111-1111-1111-1112\n" + SHARED, "de", "c", 1),
    (9, prose(9, 30_000), "en", "c", 1),
    (10, "a" * 200_000 + "@" + "1" * 50_000 + ".5" * 20_000 + " " + "x.y" * 3_000, "en", "c", 1),
    (11, prose(1, 40) + f"\n{SHARED}\nshort", "en", "a", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    clash = {c: F.lit("clash") for c in ("_row", "_lines", "fp", "start", "kind", "score", "size", "_text", "taken", "node")}
    return spark.createDataFrame(ODD, DOCS).withColumns(clash)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_line_dedup(odd, none):
    got = collections.Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in line_dedup.line_dedup(odd).collect())
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders = collections.defaultdict(set)
    for d, t, *_ in ODD:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                holders[key(x)].add(d)
    keep = {k: max((d for d in v if d is not None), default=None) for k, v in holders.items() if len(v) >= 3}
    want = collections.Counter()
    for d, t, *_ in ODD:
        lines = (t or "").split("\n")
        stay = [x for x in lines if key(x) not in keep or keep[key(x)] == d]
        want[d, len(lines), len(lines) - len(stay), "\n".join(stay)] += 1
    assert got == want and any(k[2] for k in want)
    assert line_dedup.line_dedup(none).count() == 0


@pytest.mark.parametrize("parts", [2, 2_048])
def test_hot_keys(spark, monkeypatch, parts):
    """Salted joins give what plain ones do."""
    monkeypatch.setattr(common, "HOT_PARTS", parts)
    rows = [(k, "hot" if k % 3 else f"k{k}") for k in range(90)] + [(90, None)]
    df = spark.createDataFrame(rows, "n1 int, key string")
    counts = df.filter("key is not null").groupBy("key").agg(F.count("*").alias("n"))
    other = spark.createDataFrame([("hot", 1), ("k3", 2), ("none", 3)], "key string, value int")
    got = sorted(tuple(r) for r in common.join_hot(df, other, "key", common.cut(counts)).select("n1", "key", "value").collect())
    assert got == sorted((n, k, {"hot": 1, "k3": 2}[k]) for n, k in rows if k in ("hot", "k3"))


def test_mix(spark, odd, none):
    docs = odd.withColumn("size", mixing.n_words(F.col("text")))
    rows = mixing.mix(docs, rows_per_bucket=2).collect()
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    size = collections.Counter()
    for _, t, _, s, _ in ODD:
        size[s] += len(words_of(t))
    weight = {s: 1 + k % 3 for k, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    target, open_, left = {}, set(size), float(sum(size.values()))
    while True:
        part = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if part[s] > 3 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
            open_.remove(s)
    target |= part
    taken = collections.Counter()
    for r in rows:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]], abs=1e-5) and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert len(rows) == len(ODD) and all(taken[s] == int(round(target[s], 6)) for s in size)
    assert mixing.mix(none.withColumn("size", F.lit(1))).count() == 0


def test_mixed_documents(spark, odd, none):
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns
    got = collections.Counter()
    for r in out.collect():
        got[r["source"]] += len(words_of(r["text"]))
        assert any(r["doc_id"] == d and (t or "").startswith(r["text"]) for d, t, *_ in ODD)
    want = collections.Counter()
    for r in mixing.mix(odd.withColumn("size", mixing.n_words(F.col("text")))).collect():
        want[r["source"]] += r["taken"]
    assert +got == +want
    assert mixing.mixed_documents(none).count() == 0
    text = " a  b\tc\nd "
    cut = spark.createDataFrame([(text,)], "t string").select([mixing.first_words(F.col("t"), F.lit(n)) for n in range(1, 5)]).first()
    assert list(cut) == [" a", " a  b", " a  b\tc", " a  b\tc\nd"]


def test_warc(spark, tmp_path):
    big, small = "<p>" + prose(1, 300), "<p>small"
    rows = [(1, "http://a", big), (2, None, big), (3, "http://b\n", small), (4, "http://c", small), (5, "u", None), (None, "n", big), (6, "é", "é" * 600), (2, None, big), (7, "w", prose(7, 60_000)), (8, "r", "x\r\n\r\n" * 300)]
    rows += [(k, f"http://h/{k}", "<html>" + prose(k, 80)) for k in range(20, 60)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("refers_to", F.lit("x"))
    folder = f"file://{tmp_path}/w"
    got = warc.warc_round_trip(pages, folder).collect()
    want = collections.Counter()
    for p, _, h in rows:
        data = (h or "").encode()
        keeper = max((q for q, _, g in rows if q is not None and g == h), default=None)
        revisit = p is not None and len(data) >= 1000 and p < keeper
        want[p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", keeper if revisit else None] += 1
    assert collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    heads = [p.read_bytes()[:4] for p in (tmp_path / "w").glob("*.warc.zst")]
    assert bytes.fromhex("5d2a4d18") in heads
    assert warc.warc_round_trip(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
    for path in (tmp_path / "w").glob("*.warc.zst"):  # without its dictionary no record of a file that has one can be read
        data = path.read_bytes()
        if data[:4] == bytes.fromhex("5d2a4d18"):
            rest = data[8 + int.from_bytes(data[4:8], "little") :]
            with pytest.raises(zstandard.ZstdError):
                list(warc.read_records(io.BytesIO(rest)))
    rolled = common.cut(warc.write_warc(pages, f"{folder}-r", archive_bytes=50_000))
    assert rolled.filter("file NOT LIKE '%-00000.warc.zst'").count() and warc.read_warc(rolled, f"{folder}-r").count() == len(rows)
    few = warc.warc_round_trip(pages.limit(3).coalesce(1), f"file://{tmp_path}/few")  # too few to learn a dictionary from
    assert few.count() == 3 and all(p.read_bytes()[:4] == bytes.fromhex("28b52ffd") for p in (tmp_path / "few").glob("*.warc.zst"))
    record = warc.build_record(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None)
    with pytest.raises(ValueError):
        warc.parse_record(record.replace(b"abc", b"abd"))


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 23, 31, 32])
def test_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1003, np.uint64).astype(np.uint32)
    data = token_files.pack(ids, bits)
    assert len(data) == -(-1003 * bits // 8) and (token_files.unpack(data, bits, 1003) == ids).all()


def test_token_files(spark, odd, none, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    ids = lambda x: np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4")
    extra = spark.createDataFrame([(20, "It's <|endoftext|> I'LL go\x85 1234 Á Σ ΣΑΣ İ", "", "", 1), (21, "x  \n\n y\r\nz", "", "", 1)], DOCS)
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars").union(extra)
    folder = f"file://{tmp_path}/t"
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.token_output(docs, TOKENIZER, folder=folder).collect()), key=lambda r: r[2])
    rows = sorted(((d is not None, d or 0, x is not None, x or "") for d, x, *_ in docs.collect()))
    start, want = 0, []
    for known, d, _, x in rows:
        want.append((known, d, start, len(ids(x)), zlib.crc32(ids(x).tobytes())))
        start += len(ids(x))
    assert got == want
    rolled = token_files.write_token_files(docs, f"{folder}-r", TOKENIZER, file_ids=100)
    manifest = common.cut(rolled)
    assert manifest.filter("roll > 0").count() and manifest.agg(F.sum("n_docs")).first()[0] == len(want)
    again = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_token_files(manifest, f"{folder}-r").collect()), key=lambda r: r[2])
    assert again == want
    assert token_files.token_output(none, TOKENIZER).count() == 0


def test_encoder_by_the_tokenizers_settings(tmp_path):
    """Words are remembered only where the settings prove that pieces between blanks are encoded on their own; ids are the tokenizer's either way."""
    settings = json.load(open(TOKENIZER))
    texts = [prose(1, 30), "Ab c,\n \n'd Éf. 12 \n x", "it's. we'll, \t\u00a0 no\u2028 break 3,5 ½ İ Σς ǅ", "e\u0301 \u0301 a", "<|endoftext|> x", "漢字 😀! ?", "a" * 3000 + "."]
    found = {}
    for name, change in {
        "as it is": {}, "no normalizer": {"normalizer": None}, "strip": {"normalizer": {"type": "Strip", "strip_left": True, "strip_right": True}}, "prefix": {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}},
        "spans blanks": {"pre_tokenizer": {"type": "Split", "pattern": {"Regex": "[\\p{L}]+( [\\p{L}]+)?"}, "behavior": "Removed", "invert": True}}, "cut off": {"truncation": {"direction": "Right", "max_length": 5, "strategy": "LongestFirst", "stride": 0}},
    }.items():
        path = str(tmp_path / f"{name}.json")
        json.dump(settings | change, open(path, "w"))
        e = token_files.WordEncoder(path)
        found[name] = (e.splits, e.lower, e.stops)
        for t in texts * 2:
            assert e.encode(t) == e._ids(t), (name, t)
    assert found["as it is"] == (True, True, True) and found["no normalizer"] == (True, False, True)
    assert not any(found[n][0] for n in ("strip", "prefix", "spans blanks", "cut off"))


def test_token_file_access(tmp_path):
    with open(tmp_path / "f", "wb") as sink:
        w, docs = token_files.TokenFileWriter(sink, 11, block=64), [np.random.default_rng(k).integers(0, 2048, k * 7 % 150).astype("<u4") for k in range(40)]
        for k, x in enumerate(docs):
            w.add(k, x.tobytes())
        w.close()
    store, place = token_files.open_store(f"file://{tmp_path}/f")
    f = token_files.TokenFile(store.open_input_file(place))
    assert all((f.document(k) == docs[k]).all() for k in (39, 3, 17, 0))
    assert all((x == docs[k]).all() for k, x in f.documents(ids_at_once=100)) and (f.ids(60, 200) == np.concatenate(docs)[60:200]).all()


def slow_fingerprint(text):
    words = words_of((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(items, linked):
    root = list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(items))]


def test_simhash(odd, none):
    got = collections.Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.simhash_components(odd).collect())
    fps = [slow_fingerprint(t) for _, t, *_ in ODD]
    part = components(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {p: min((d for (d, *_), q in zip(ODD, part) if q == p and d is not None), default=None) for p in part}
    assert got == collections.Counter((d, f, least[p]) for (d, *_), f, p in zip(ODD, fps, part))
    assert simhash.simhash_components(none).count() == 0
    kept = simhash.without_near_copies(odd)
    assert kept.columns == odd.columns and kept.count() == len(set(part))


@pytest.mark.parametrize("bands, bits, large_cell", [(6, 4, 1 << 16), (8, 4, 1 << 16), (10, 4, 1 << 16), (8, 4, 30), (8, 4, 1), (8, 3, 30)])
def test_links_against_all_pairs(spark, bands, bits, large_cell):
    """Cells of more than `large_cell` points are linked by way of centres."""
    r = random.Random(bands)
    centres = [r.getrandbits(64) for _ in range(60)]
    fps = {c for c in centres} | {c ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 5))) for c in centres[:20] for _ in range(4)}
    fps |= {centres[0] ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)}  # a cell of many points
    fps = sorted(fps)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    edges = simhash.fingerprint_links(spark.createDataFrame(signed, "fp bigint"), bits, bands, large_cell)
    assert all(((a ^ b) % (1 << 64)).bit_count() <= bits for a, b in edges.collect())
    roots = dict(connected_components(edges).collect())
    part = components(fps, lambda a, b: (a ^ b).bit_count() <= bits)
    group = {}
    for (s,), p in zip(signed, part):
        group.setdefault(p, set()).add(roots.get(s, s))
    assert all(len(v) == 1 for v in group.values()) and len(set.union(*group.values())) == len(group)


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3), (200, 200)]
    got = dict(connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {k: 0 for k in range(1, 41)} | {k: 100 for k in range(101, 140)}


def slow_repeats(words):
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = collections.Counter(windows)
    return len({i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(8)})


def test_counts(spark, odd, none):
    rows = {(r["doc_id"], r["n_chars"]): r for r in text_stats.with_counts(odd).collect()}
    for d, t, *_ in ODD:
        t, r = t or "", rows[d, len(t or "")]
        w, lines = words_of(t), t.split("\n")
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)))
        assert r["n_dup_lines"] == sum(bool(words_of(x)) and x in lines[:i] for i, x in enumerate(lines)) and r["n_distinct_words"] == len(set(w))
    for seed in range(5):
        w = [random.Random(seed * 100 + i // 9).choice("abc") for i in range(120)]
        assert text_stats.text_counts(" ".join(w))[text_stats.COUNTS.index("n_repeat_words")] == slow_repeats(w)
    assert text_stats.with_counts(none).count() == 0


def junk(k):
    return [" ".join(f"{w}###" for w in prose(k, 60).split()), ("same words again " * 40).strip(), prose(k, 60).upper() + "!!"][k % 3]


@pytest.fixture(scope="module")
def mixed_quality(spark):
    rows = [(k, junk(k) if k % 5 == 1 else prose(k, 40 + k % 90), "en", "s", 1) for k in range(400)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame([(k, int(k % 5 != 1)) for k in range(0, 400)] + [(3, None), (None, 1)], "doc_id bigint, quality int")


def test_quality_trees(spark, mixed_quality, odd, none):
    docs, labels = mixed_quality
    rows = quality_trees.score_quality(docs, labels).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 400 and {r["doc_id"] for r in held} == {k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0}
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["predicted"] == (r["doc_id"] % 5 != 1) for r in held]) > 0.95
    assert quality_trees.score_quality(odd, labels).count() == len(ODD)
    assert {r["score"] for r in quality_trees.score_quality(odd, labels.limit(0)).collect()} == {0.5}
    assert quality_trees.score_quality(none, labels).count() == 0


def test_scores_against_slow_trees():
    """All rows down all trees at once against one row down one tree at a time."""
    r = np.random.default_rng(1)
    x = r.normal(size=(600, 4))
    trees = quality_trees.fit_trees(x, (x[:, 1] > x[:, 2]).astype(float), n_trees=12, depth=3)
    for row, got in zip(x[:100], trees.score(x[:100])):
        raw = trees.base
        for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            raw += leaf[node - len(feature)]
        assert got == pytest.approx(1 / (1 + math.exp(-raw)))


def test_trees_fit():
    r = np.random.default_rng(0)
    x = r.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    trees = quality_trees.fit_trees(x[:1500], y[:1500])
    assert ((trees.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95


def test_quality_rules(mixed_quality, odd, none):
    docs, _ = mixed_quality
    rows = quality_rules.judge(docs).collect()
    assert np.mean([r["kept"] == (r["doc_id"] % 5 != 1) for r in rows]) > 0.95
    out = quality_rules.judge(odd).collect()
    assert len(out) == len(ODD)
    for r in out:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["base_failed"] and r["kept"])
    assert quality_rules.judge(none).count() == 0


def test_votes_are_weighed():
    r = np.random.default_rng(1)
    good = r.random(5000) < 0.8
    right = [(0.95, 0.7), (0.9, 0.8), (0.7, 0.9)]  # on good documents and on bad ones
    votes = np.stack([np.where(r.random(5000) < 0.3, 1, np.where(r.random(5000) < np.where(good, g, b), 2 * good, 2 * ~good)) for g, b in right], axis=1)
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    voters = quality_rules.fit_votes(patterns, n.astype(float))
    assert abs(voters.prior - 0.8) < 0.06
    assert all(abs(voters.rates[1, k, 2] - 0.7 * g) < 0.05 and abs(voters.rates[0, k, 0] - 0.7 * b) < 0.12 for k, (g, b) in enumerate(right))
    assert ((voters.posterior(votes) > 0.5) == good).mean() > 0.9
    none = quality_rules.fit_votes(patterns[:0], n[:0].astype(float))
    assert none.prior == 0.5 and none.posterior(patterns).min() < 0.5 < none.posterior(patterns).max()


def slow_voters(votes, rounds=500):
    """Expectation-maximisation document by document."""
    good = [1 / (1 + math.exp(-2 * sum(v - 1 for v in row))) for row in votes]
    casts = [{row[k] for row in votes} for k in range(len(votes[0]))]
    expected = [[0.6, 0.3, 0.1], [0.1, 0.3, 0.6]]
    for _ in range(rounds):
        prior = (sum(good) + 5) / (len(votes) + 10)
        rates = []
        for c in (0, 1):
            rates.append([])
            for k in range(len(votes[0])):
                seen = [1e-9 + (10 * expected[c][v] if v in casts[k] else 0) + sum(g if c else 1 - g for g, row in zip(good, votes) if row[k] == v) for v in range(3)]
                rates[c].append([x / sum(seen) for x in seen])
        new = []
        for row in votes:
            odds = math.log(prior / (1 - prior)) + sum(math.log(rates[1][k][v] / rates[0][k][v]) for k, v in enumerate(row) if v != 1)
            new.append(1 / (1 + math.exp(-odds)))
        done, good = max(abs(a - b) for a, b in zip(good, new)) < 1e-9, new
        if done:
            break
    return good


def test_votes_document_by_document(spark, mixed_quality):
    """The query's posterior and verdict against rules and EM worked off one document at a time."""
    docs, _ = mixed_quality
    got = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    rows, votes = [r.asDict() for r in got.values()], []
    for c in rows:
        at = lambda k, c=c: max(c[k], 1)
        length, symbols, again, same = c["word_chars"] / at("n_words"), c["n_symbols"] / at("n_words"), c["n_repeat_words"] / at("n_words"), c["n_same_next"] / at("n_words")
        distinct, dup, upper, bangs = c["n_distinct_words"] / at("n_words"), c["n_dup_lines"] / at("n_lines"), c["n_upper"] / at("n_letters"), c["n_bangs"] / at("n_words")
        lettered, stops, enough = c["n_letters"] / at("word_chars"), c["n_punctuation"] / at("n_words"), c["n_words"] >= 20
        say = lambda bad, good: 0 if bad else 2 if good else 1
        votes.append([
            say(not 2 <= length <= 25, False), say(symbols > 0.25, False), say(again > 0.25 or same > 0.15 or dup > 0.5 or (enough and distinct < 0.1), False), say(upper > 0.4 or bangs > 0.25, False), say(c["n_digits"] / at("n_chars") > 0.3, False),
            say(enough and lettered < 0.7, enough and lettered > 0.9 and upper < 0.25 and 0.005 < stops < 0.5), say(False, enough and again < 0.15 and same < 0.05 and symbols < 0.1 and upper < 0.4),
        ])
    want = slow_voters(votes)
    assert np.allclose([r["quality"] for r in rows], want, atol=1e-6)
    assert [r["kept"] for r in rows] == [not r["base_failed"] and w >= 0.5 for r, w in zip(rows, want)]


def test_language(spark, odd, none):
    sets = {"en": " ".join(WORDS), "de": "der und straße über schön nicht", "fr": "le être où garçon les dans"}
    rows = [(k, " ".join(random.Random(k).choices(sets[s].split(), k=3 + k % 60)), s) for k, s in enumerate(list(sets) * 100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.train_languages(docs)
    got = {r["doc_id"]: r for r in language_id.identify(docs, model, ["doc_id", "lang"]).collect()}
    held = [r for k, r in got.items() if zlib.crc32(str(k).encode()) % 4 == 2]
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.95 and all(0 <= r["score"] <= 1 for r in held)
    out = language_id.identify(odd, model).collect()
    assert len(out) == len(ODD) and all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) == (r["rejected"] and r["lang_pred"] == "und") for r in out)
    assert language_id.identify(none, model).count() == 0
    known = language_id.known_languages(odd, model)
    assert known.columns == odd.columns and {r["score"] for r in known.collect()} == {"clash"} and known.count() == sum(not r["rejected"] for r in out)
    unlearned = language_id.train_languages(none)
    assert {(r["lang_pred"], r["score"]) for r in language_id.identify(odd, unlearned, ["doc_id"]).collect()} == {("und", 0.0)}
    assert language_id.LanguageModel(["a"], np.zeros((1 << 14, 2)), np.zeros(2), 1.0, 0.0).predict("𐌰")[0] == "a"


SYLLABLES = {"one": "ba ke li mo nu", "two": "tra gre schi pflo dru", "three": "quoi eau ille ouve ache", "four": "shi ngu mbe yo wa", "five": "ská tří žlu měď čo"}


def invented(language, seed, n):
    r = random.Random(f"{language}{seed}")
    return " ".join("".join(r.choices(SYLLABLES[language].split(), k=r.randint(1, 4))) for _ in range(n))


def test_unlearned_languages_are_rejected(spark):
    """Of languages that aren't learned most texts are rejected; of learned ones few; rare ones are learned in full."""
    rows = [(k, invented(s, k, 8 + k % 50), s) for k, s in enumerate(["one", "two", "three"] * 120)] + [(1000 + k, invented("four", k, 30), "four") for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.train_languages(docs, fit_rows=60)
    assert model.languages == ["four", "one", "three", "two"] and 0 < model.reject_below < 1
    said = lambda language, n: [model.predict(invented(language, 10_000 + k, n)) for k in range(200)]
    for language in ("one", "two", "three"):
        assert np.mean([model.rejects(*s) for s in said(language, 30)]) <= 0.02
    assert np.mean([model.rejects(*s) for s in said("five", 30)]) > 0.9
    assert all(model.rejects(*model.predict(t)) for t in ("これは日本語の文章です。", "Это предложение на русском языке"))


def test_few_examples():
    few = [(np.array([1, 2], np.uint32), np.array([0.5, 0.5]), "a"), (np.array([3], np.uint32), np.array([1.0]), "b")]
    model = language_id.fit_language(few)
    assert (model.temperature, model.reject_below) == (1.0, 0.0) and model.languages == ["a", "b"]


def test_calibration():
    r = np.random.default_rng(2)
    y = r.integers(0, 3, 4000)
    z = r.normal(size=(4000, 3)) * 2
    z[np.arange(4000), y] += 2
    p = language_id._softmax(3 * z / language_id.calibrate(3 * z, y))
    assert abs(p.max(axis=1).mean() - (p.argmax(axis=1) == y).mean()) < 0.05 and language_id.calibrate(z[:0], y[:0]) == 1.0
    known, unknown = np.array([0.2, 0.8, 0.9, 0.95]), np.array([0.1, 0.3, 0.85])
    assert language_id.rejection_limit(known, unknown, 0.5) == pytest.approx(0.875) and language_id.rejection_limit(known, unknown, 0.3) == pytest.approx(0.55)
    assert language_id.rejection_limit(known, unknown, 0.0) == pytest.approx(0.15) and language_id.rejection_limit(known, unknown[:0], 0.5) == 0.0


def test_scores_against_a_slow_softmax():
    """A bucket's row of `table` is its embedding times the weights: the score is the softmax of the mean embedding."""
    r = np.random.default_rng(3)
    emb, w, bias = r.normal(size=(1 << 14, 4)), r.normal(size=(4, 3)), r.normal(size=3)
    model = language_id.LanguageModel(["a", "b"], emb @ w, bias, 1.7, 0.0)
    for text in ("Some words, and MORE words.", "é", "x" * 50_000 + " " + prose(1, 30_000)):
        low = "".join(c.lower()[0] if c.isalpha() else " " for c in text)
        low = " " + re.sub(" +", " ", low).lstrip(" ") + " "
        grams = []
        for n in (2, 3, 4):
            for i in range(len(low) - n + 1):
                h = ord(low[i])
                for c in low[i + 1 : i + n]:
                    h = (h * 0x01000193 & 0xFFFFFFFF) ^ ord(c)
                grams.append((h * 0x9E3779B1 & 0xFFFFFFFF) >> 18)
        z = (np.mean([emb[g] for g in grams], axis=0) @ w + bias) / 1.7
        p = [math.exp(x) / sum(math.exp(y) for y in z) for x in z]
        lang, score = model.predict(text)
        assert lang == ["a", "b"][int(np.argmax(p[:2]))] and score == pytest.approx(max(p[:2]))


def slow_alignment(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return h.max()


def test_smith_waterman():
    r = random.Random(4)
    for _ in range(20):
        a = [r.randint(0, 4) for _ in range(12)]
        rows = [[r.randint(-1, 4) for _ in range(30)] for _ in range(5)]
        assert list(decontamination.smith_waterman(np.array(a), np.array(rows))) == [slow_alignment(a, b) for b in rows]


def edited(text, every):
    return " ".join("changed" if k % every == every - 1 else w for k, w in enumerate(text.split()))


@pytest.mark.parametrize("block_words", [2_000_000, 40])
def test_leaks(spark, odd, none, block_words):
    r = random.Random(6)
    vocabulary = ["".join(r.choices("abcdefghij", k=5)) for _ in range(2000)]
    new = lambda n: " ".join(r.choices(vocabulary, k=n))
    items = [(k, new(30)) for k in range(6)] + [(6, None), (7, ""), (8, "two words"), (0, items0 := new(25))]
    filler = lambda: new(150)
    rows = [(1, f"{filler()}\n{items[0][1].upper()}, {filler()}"), (2, f"{filler()} {edited(items[1][1], 6)} {filler()}"), (3, filler()), (4, items[2][1]), (5, " ".join(items[3][1].split()[:6]) + " " + filler()), (6, None), (7, ""), (8, f"{items[4][1]} {filler()} {items[5][1]} {items[4][1]}"), (9, items0), (4, items[2][1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    got = sorted((x["doc_id"], x["item_id"]) for x in decontamination.find_leaks(docs, bench, block_words=block_words).collect())
    norm = lambda t: re.findall(r"\w+", (t or "").lower())
    want = sorted((d, k) for d, t in rows for k, i in items if len(norm(i)) >= 4 and slow_alignment(norm(i), norm(t)) >= 0.5 * 2 * len(norm(i)))
    assert got == want == [(1, 0), (2, 1), (4, 2), (4, 2), (8, 4), (8, 5), (9, 0)]
    kept = decontamination.decontaminate(docs, bench, block_words=block_words)
    assert kept.columns == docs.columns and sorted(x["doc_id"] for x in kept.collect()) == [3, 5, 6, 7]
    if block_words > 40:
        assert decontamination.find_leaks(odd, bench).count() == 0 and decontamination.find_leaks(none, bench).count() == 0 and decontamination.find_leaks(docs, bench.limit(0)).count() == 0


def test_short_and_unspaced_items(spark):
    """Items of under four words are found as whole lines; scripts without spaces by their characters."""
    items = [(0, "Two words"), (1, "Yes."), (2, "昨日の夜に大きな犬が庭で静かに眠っていました"), (3, "two words"), (4, "...")]
    rows = [(0, "before\n  two WORDS!\nafter"), (1, "here are two words in a row, yes"), (2, "序文です。昨日の夜に大きな猫が庭で静かに眠っていました。終わり"), (3, "Yes"), (4, None), (5, "昨日"), (6, "...")]
    docs, bench = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted((x["doc_id"], x["item_id"], x["word"]) for x in decontamination.find_leaks(docs, bench).collect())
    assert [x[:2] for x in got] == [(0, 0), (0, 3), (2, 2), (3, 1)] and got[0][2] == 1


def test_recall_of_edited_items():
    """Against alignment without seeds: items with changed, left out and inserted words that reach a similarity of 0.5."""
    r = random.Random(9)
    for size, rate in ((10, 0.3), (15, 0.3), (25, 0.35), (40, 0.35), (30, "third"), (30, "fourth")):
        found = reached = 0
        for _ in range(60):
            item = [f"w{r.randrange(5000)}" for _ in range(size)]
            if isinstance(rate, str):
                copy = edited(" ".join(item), {"third": 3, "fourth": 4}[rate]).split()
            else:
                copy = [x for w in item for x in ([w] if r.random() > rate else r.choice([["new"], ["new"], ["new"], [], [w, "new"]]))]
            text = [f"v{r.randrange(5000)}" for _ in range(40)] + copy + [f"v{r.randrange(5000)}" for _ in range(40)]
            if slow_alignment(item, text) >= size:
                items = decontamination.Items.of([(1, " ".join(item))])
                w, at, seed = items.look_up(" ".join(text))
                reached += 1
                found += any(s >= 0.5 for _, s, _ in decontamination.align(items, w, at, seed, 0.5)) if len(seed) else 0
        assert reached > 20 and found >= 0.9 * reached, (size, rate, found, reached)


def test_long_items_in_bounded_memory():
    r = np.random.default_rng(5)
    item = r.integers(0, 50_000, 6000).astype(str)
    items = decontamination.Items.of([(1, " ".join(item))])
    copy = item.copy()
    copy[::7] = "new"
    w, at, seed = items.look_up(" ".join([*item[:3], *copy]))
    (hit,) = decontamination.align(items, w, at, seed, 0.5)
    assert 0.75 < hit[1] < 0.82


def luhn(digits):
    v = [int(c) for c in digits][::-1]
    return sum(v[::2] + [sum(divmod(2 * c, 10)) for c in v[1::2]]) % 10 == 0


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def slow_entities(text):
    return [(k, m.start(), m.end()) for k, rx, ok in BASE for m in re.finditer(rx, text or "") if ok(m.group())]


def test_entities(spark, odd, none):
    tricky = ["a@b.c_d@e.f,x@y a@b..c a.@b.c@d.e", "1.2.3.4.5.6.7.8 256.1.1.1 0000255.001.1.1 1.2.3", "4111111111111111 4111 1111-1111  1111 41111111111111111111 " + "4" * 40, "+1 (555) 010-9999 +1--2 ++12345678 +123456789012345678 +12345.", "é+49 30 123456 ü x@ü.de ñ@m.org", "9@8.7.6.5 +1.2.3.4.5.6.7.8"]
    r = random.Random(7)
    tricky += ["".join(r.choices("ab1.@+- 45(", k=200)) for _ in range(40)]
    rows = [(100 + k, t, None, None, None) for k, t in enumerate(tricky)]
    docs = odd.select(*DOCS.replace(" bigint", "").replace(" string", "").split(", ")).union(spark.createDataFrame(rows, DOCS))
    got = collections.Counter((x["doc_id"], tuple((s["kind"], s["start"], s["end"]) for s in x["found"] if s["kind"] != "term")) for x in privacy.find_private(docs).collect())
    assert got == collections.Counter((d, tuple(slow_entities(t))) for d, t, *_ in [*ODD, *rows])
    assert privacy.find_private(odd).count() == len(ODD) and privacy.find_private(none).count() == 0 and privacy.sanitise(none).count() == 0
    clean = {x["doc_id"]: x["text"] for x in privacy.sanitise(odd).collect() if x["doc_id"] in (8, 9)}
    assert clean == {8: ODD[10][1], 9: ODD[11][1]}


def slow_terms(rows, threshold=0.5):
    """The spans of disclosing terms by (doc_id, start, end), from the definition: every entity with every term of its documents."""
    split = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    keys, n = collections.defaultdict(dict), len(rows)
    for d, t, *_ in rows:
        for kind in {k for k, *_ in BASE}:
            spans = [(m.start(), m.end()) for k, rx, _ in BASE if k == kind for m in re.finditer(rx, t)]
            valid = {x[1:] for x in slow_entities(t) if x[0] == kind}
            edge = [0, *[x for s in spans for x in s], len(t)]
            for i, (a, b) in enumerate(spans):
                if (a, b) in valid:
                    passage = (t[edge[2 * i] : a][-40:], t[b : edge[2 * i + 3]][:40])
                    whole, digits = t[a:b].lower(), re.sub("[^0-9]", "", t[a:b])
                    group = {"email": whole.split("@")[-1], "ip": whole.rsplit(".", 1)[0], "card": digits[:6], "phone": digits[:-4]}[kind]
                    for key in ((kind, whole if kind in ("email", "ip") else digits), ("group", kind, group)):
                        keys[key].setdefault(d, set()).add(passage)
    terms, texts = {d: set(split(t)) for d, t, *_ in rows}, {d: t for d, t, *_ in rows}
    n_t, told = collections.Counter(w for ws in terms.values() for w in ws), collections.defaultdict(set)
    pmi = lambda n_et, n_e, w, c: n > n_e and (c / (c + 1)) ** 2 * np.log2(n_et * n / (n_e * n_t[w])) >= threshold * np.log2(n / n_e)
    rank = {d: k for k, d in enumerate(texts)}
    for docs in keys.values():
        speaker = {}
        for d in sorted(docs, key=rank.get):
            for p in docs[d]:
                speaker.setdefault(p, d)
        speakers = set(speaker.values())
        for w in set.union(*[terms[d] for d in docs]):
            with_w = [d for d in docs if w in terms[d]]
            if pmi(len(with_w), len(docs), w, len(speakers & set(with_w))):
                for d in docs:
                    told[d].add(w)
    out = set()
    for d, t in texts.items():
        base = [x[1:] for x in slow_entities(t)]
        mails = [(m.start(), m.end()) for m in re.finditer(BASE[0][1], t)]
        gaps = [t[a:b] for a, b in zip([0, *[e for _, e in mails]], [*[s for s, _ in mails], len(t)])]
        elsewhere = {w for g in gaps for w in split(g)}
        names = {w for a, b in mails for w in split(t[a:b].split("@")[0]) if len(w) >= 3 and w in elsewhere and pmi(1, 1, w, 3)}
        for m in re.finditer(r"[^\W\d_]+", t):
            if m.group().lower() in told[d] | names and not any(m.start() < e and m.end() > s for s, e in base):
                out.add((d, m.start(), m.end()))
    return out


def planted_names():
    """Names that give an address, a domain or a number away, in different passages; names that many have; a surname in its own address."""
    r, rows, secret = random.Random(21), [], set()
    name = lambda: "".join(r.choices("bcdfghklmnprstvz", k=4)).capitalize() + "".join(r.choices("aeiou", k=4))
    text = lambda n: prose(r.random(), n)
    for g in range(12):
        who, common = name(), name() if g % 3 else "Stone"
        for k in range(r.randint(4, 6)):
            entity = [f"box{g}@mail.example.org", f"{name().lower()}@firm{g}.example.com", f"+49 {g + 10} 5550 {1000 + k}"][g % 3]
            rows.append((len(rows), f"{text(20)} {entity} {text(40)} {who}, {common} {text(10)} {who}.", None, None, 1))
        secret |= {who.lower(), common.lower()} - {"stone"}
    for k in range(6):
        who = name()
        rows.append((len(rows), f"{text(30)} {who.lower()}.x@big.example.net {text(30)} {who} said", None, None, 1))
        secret.add(who.lower())
    rows += [(len(rows) + k, text(60), None, None, 1) for k in range(150)]
    return rows, secret


def test_disclosing_terms(spark):
    rows, secret = planted_names()
    rows += [(1000 + k, f"{prose(k, 5)} ring +1 (555) 020-9999 or write {prose(5, 30)} Quartz", None, None, 1) for k in (0, 0, 0, 0, 0)][:1] * 5  # one document, five times
    found = privacy.find_private(spark.createDataFrame(rows, DOCS)).collect()
    got = {(x["doc_id"], s["start"], s["end"]) for x in found for s in x["found"] if s["kind"] == "term"}
    texts = {d: t for d, t, *_ in rows}
    words = [texts[d][s:e].lower() for d, s, e in got]
    places = [(d, m.group().lower()) for d, t in texts.items() for m in re.finditer(r"[^\W\d_]+", re.sub(BASE[0][1], "", t))]
    assert sum(w in secret for w in words) >= 0.9 * sum(w in secret for _, w in places)  # recall
    assert sum(w in secret for w in words) >= 0.9 * len(words) and "quartz" not in words  # precision
    out = {x["doc_id"]: x["text"] for x in privacy.sanitise(spark.createDataFrame(rows, DOCS)).collect()}
    assert out[rows[-6][0]] == rows[-6][1] and not any(w in re.split(r"\W+", t.lower()) for t in out.values() for w in secret)
    assert all(any(f"[{g}]" in t for t in out.values()) for g in ("term", "affiliation", "place", "name"))


def test_terms_against_all_pairs(spark):
    rows, _ = planted_names()
    found = privacy.find_private(spark.createDataFrame(rows, DOCS)).collect()
    assert {(x["doc_id"], s["start"], s["end"]) for x in found for s in x["found"] if s["kind"] == "term"} == slow_terms(rows)
