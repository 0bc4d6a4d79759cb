"""Language ID: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

Beside the languages the softmax has a class of noise: scrambled copies of the training examples, with other buckets at the
same shares, as texts of a script or language that was never seen have them. The limit below which an answer is
rejected is found by leaving languages out: models that haven't learned a language score its texts, and the limit parts
these from held-out texts of the languages learned, of which it may reject a small share only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.common import crc32_mod, cut, table

#: The most labelled rows of each language that a fit looks at, and of all languages together; of more, those of the least hashes of id and text.
FIT_ROWS, ALL_ROWS = 500, 20_000
#: The highest limit: an answer more likely right than wrong is never rejected.
MOST = 0.5
#: So many languages are learned at most, those of the most rows.
MAX_LANGUAGES = 1_000
BUCKET_BITS = 14
ORDERS = (2, 3, 4)
_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point of the basic plane: itself in lower case if a letter, else a space."""
    if not _TABLE:
        low = [c.lower() if (c := chr(k)).isalpha() else " " for k in range(1 << 16)]
        _TABLE.append(np.array([ord(c[0]) for c in low], np.uint32))
    return _TABLE[0]


def subwords(text: str | None) -> np.ndarray | None:
    """Buckets of the letter n-grams of a text, word ends included; None without a letter."""
    if not text:
        return None
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    high = x >> 16 > 0
    if high.any():
        rest = {int(c): int(c) if chr(int(c)).isalpha() else 32 for c in np.unique(x[high])}
        x, raw = _letters()[np.minimum(x, 65535)], x
        x[high] = [rest[int(c)] for c in raw[high]]
    else:
        x = _letters()[x]
    gap = x == 32
    if gap.all():
        return None
    x = np.concatenate([[32], x[~(gap & np.concatenate([[True], gap[:-1]]))], [32]]).astype(np.uint32)
    out, h = [], x
    for n in range(2, max(ORDERS) + 1):
        if len(x) < n:
            break
        h = h[:-1] * np.uint32(0x01000193) ^ x[n - 1 :]
        out.append((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS))
    return np.concatenate(out)


@dataclass(frozen=True)
class LanguageModel:
    """`table` is embeddings times softmax weights, a row of class scores for each bucket; the last class is noise."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float

    def predict(self, text: str | None) -> tuple[str, float]:
        """A language and its calibrated probability; ("und", 0) where there is no letter or nothing was learned."""
        buckets = subwords(text) if self.languages else None
        if buckets is None:
            return "und", 0.0
        if len(buckets) < 4 * len(self.table):
            logits = self.table[buckets].mean(axis=0)
        else:
            logits = np.bincount(buckets, minlength=len(self.table)) @ self.table / len(buckets)
        p = _softmax((logits + self.bias) / self.temperature)[: len(self.languages)]
        k = int(p.argmax())
        return self.languages[k], float(p[k])

    def rejects(self, language: str, score: float) -> bool:
        return language == "und" or score < self.reject_below


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


Example = tuple[np.ndarray, np.ndarray, str]


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss; 1 where there is nothing to go by."""
    if not len(y):
        return 1.0
    scales = np.geomspace(0.25, 20, 121)
    return float(scales[int(np.argmin([-np.log(np.maximum(_softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in scales]))])


def rejection_limit(known: np.ndarray, unknown: np.ndarray, max_lost: float) -> float:
    """The score that parts `known` from `unknown` best, with at most `max_lost` of the known below it, midway to the next; 0 where one of them is empty."""
    if not len(known) or not len(unknown):
        return 0.0
    limits = np.unique(np.concatenate([[0.0], known, unknown]))
    lost = np.searchsorted(np.sort(known), limits) / len(known)
    caught = np.searchsorted(np.sort(unknown), limits) / len(unknown)
    gain = np.where(lost <= max_lost, caught - lost, -1.0)
    k = int(gain.argmax())
    return float(limits[k] + limits[max(0, k - 1)]) / 2


def _train(examples: list[Example], languages: list[str], width: int, epochs: int, rate: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket scores and bias of the languages and of noise, by stochastic gradient descent; every (k + 1)-th step is on a scrambled example."""
    rng, k = np.random.default_rng(seed), len(languages)
    emb, w, bias = rng.normal(0, 0.1, (1 << BUCKET_BITS, width)), rng.normal(0, 0.3, (width, k + 1)), np.zeros(k + 1)
    y = [languages.index(x[2]) for x in examples]
    step, steps = 0, max(1, epochs * len(examples))
    for _ in range(epochs):
        for turn, i in enumerate(rng.permutation(len(examples))):
            lr = rate * (1 - step / steps)
            step += 1
            todo = [(examples[i][0], y[i])]
            if turn % k == 0:
                todo.append(((examples[i][0] * np.uint32(2 * rng.integers(1 << 12) + 1) + np.uint32(rng.integers(1 << BUCKET_BITS))) & np.uint32((1 << BUCKET_BITS) - 1), k))
            shares = examples[i][1].astype(np.float64)  # kept as they came, in half the memory
            scale = shares / np.sqrt((shares**2).sum())  # shares are small (1 / n-grams): each bucket's step is scaled up to the weight of the text
            for buckets, label in todo:
                mean = shares @ emb[buckets]
                g = _softmax(mean @ w + bias)
                g[label] -= 1
                back = w @ g
                w -= lr * np.outer(mean, g)
                bias -= 0.1 * lr * g
                emb[buckets] -= lr * np.outer(scale, back)
    return emb @ w, bias


def fit_language(examples: list[Example], width: int = 16, epochs: int = 6, rate: float = 1.0, max_lost: float = 0.002, seed: int = 5, left_out: int = 5) -> LanguageModel:
    """Train on (buckets, shares, language); every fifth example of a language only calibrates.

    Languages are dealt to at most `left_out` groups; for each, a model of the other languages scores what it has never learned.
    With fewer than five examples of every language nothing is held out: the temperature is 1 and only texts without a letter
    are rejected. With one language, scrambled held-out texts alone are what is unknown.
    """
    languages = sorted({x[2] for x in examples})
    if not languages:
        return LanguageModel([], np.zeros((1 << BUCKET_BITS, 1)), np.zeros(1), 1.0, 0.0)
    turn, train, held = dict.fromkeys(languages, 0), [], []
    for x in examples:
        turn[x[2]] += 1
        (train if turn[x[2]] % 5 else held).append(x)

    def best(table: np.ndarray, bias: np.ndarray, t: float, rows: list[Example]) -> np.ndarray:
        return np.array([_softmax((x[1] @ table[x[0]] + bias) / t)[:-1].max() for x in rows])

    table, bias = _train(train, languages, width, epochs, rate, seed)
    logits = np.array([x[1] @ table[x[0]] + bias for x in held]).reshape(-1, len(languages) + 1)
    t = calibrate(logits, np.array([languages.index(x[2]) for x in held], np.int64))
    rng = np.random.default_rng(seed)
    unknown = [best(table, bias, t, [(rng.permutation(1 << BUCKET_BITS)[x[0]], x[1], x[2]) for x in held])] if held else []
    groups = min(left_out, len(languages)) if len(languages) > 1 and held else 0
    for g in range(groups):
        out = set(languages[g::groups])
        rest = [n for n in languages if n not in out]
        part = _train([x for x in train if x[2] not in out], rest, width, max(1, epochs // 3), rate, seed)
        unknown.append(best(*part, t, [x for x in held if x[2] in out]))
    limit = rejection_limit(best(table, bias, t, held), np.concatenate(unknown) if unknown else np.empty(0), max_lost)
    return LanguageModel(languages, table, bias, t, min(limit, MOST))


def train_languages(docs: DataFrame, folds: int = 4, held_fold: int = 2, fit_rows: int = FIT_ROWS) -> LanguageModel:
    """A model from text and lang of `docs` (doc_id, text, lang) outside the held-out fold; `fit_rows` rows of each language at most, ALL_ROWS of all.

    Rows are picked by a hash of id and text, so rare languages keep all their rows, and rows that share an id are picked one by one; of wholly repeated rows as many are taken as there is room for. Executors send bucket counts, at most 2^14 for a text however long.
    """
    known = docs.filter(F.col("lang").isNotNull() & (crc32_mod(F.col("doc_id"), folds) != held_fold)).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    known = known.withColumn("_h", F.xxhash64(F.lit("language"), "doc_id", "text"))
    counts = cut(known.groupBy("lang").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "lang").limit(MAX_LANGUAGES))
    each = max(1, min(fit_rows, ALL_ROWS // max(1, counts.count())))
    order = F.row_number().over(Window.partitionBy("lang").orderBy("_h"))
    last = known.select("lang", "_h", order.alias("_k")).filter(F.col("_k") <= each).groupBy("lang").agg(F.max("_h").alias("_last"))  # hashes alone are ordered
    known = known.join(F.broadcast(cut(last.join(counts, "lang"))), "lang").filter(F.col("_h") <= F.col("_last"))  # at most MAX_LANGUAGES rows
    known = known.withColumn("_k", order).filter(F.col("_k") <= each).select("doc_id", "text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, buckets, shares, langs = [], [], [], []
            for doc_id, text, lang in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("lang").to_pylist(), strict=True):
                if (found := subwords(text.as_py())) is not None:
                    b, n = np.unique(found, return_counts=True)
                    ids.append(doc_id)
                    buckets.append(b.astype("<u4").tobytes())
                    shares.append((n / n.sum()).astype("<f4").tobytes())
                    langs.append(lang)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(buckets, pa.binary()), pa.array(shares, pa.binary()), pa.array(langs, pa.string())], ["doc_id", "b", "s", "lang"])

    rows = known.mapInArrow(count, "doc_id bigint, b binary, s binary, lang string").collect()  # ALL_ROWS at most
    rows.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"], r["lang"], bytes(r["b"])))
    return fit_language([(np.frombuffer(r["b"], "<u4"), np.frombuffer(r["s"], "<f4"), r["lang"]) for r in rows])


def identify(docs: DataFrame, model: LanguageModel, keep: list[str] | None = None) -> DataFrame:
    """lang_pred, score and rejected for each row of `docs` (text), beside the columns `keep` (all by default) but for those of these names.

    rejected: no letter in the text, or a calibrated probability below the model's limit. Null and empty
    texts are `und` with score 0. The model, a row of floats for each of 2^14 buckets, is broadcast.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score", "rejected")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    inner = docs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)], F.col("text").alias("_text"))
    schema = ", ".join([*[f"_{i} {inner.schema[f'_{i}'].dataType.simpleString()}" for i in range(len(keep))], "_lang string, _score double, _rejected boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            said = [m.predict(t.as_py()) for t in batch.column(len(keep))]
            cols = [pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64()), pa.array([m.rejects(*s) for s in said], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], *cols], [*[f"_{i}" for i in range(len(keep))], "_lang", "_score", "_rejected"])

    out = inner.mapInArrow(run, schema)
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"), F.col("_rejected").alias("rejected"))


def known_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of `docs` (text and others) that the model doesn't reject."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [shared.value.predict(t.as_py()) for t in batch.column(at)]
            yield batch.filter(pa.array([not shared.value.rejects(*s) for s in said], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language; learned outside the fold crc32 mod 4 = 2."""
    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), train_languages(docs), keep=["doc_id"])
    return out.select("doc_id", (crc32_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
