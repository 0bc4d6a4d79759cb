"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import crc32_mod, cut, table
from gleaner.llm.text_stats import COUNTS, with_counts

#: The most labelled rows that a fit looks at; with more, a share picked by a hash of the id.
FIT_ROWS = 20_000


def features(counts: np.ndarray) -> np.ndarray:
    """Statistics of documents, a row each, from their COUNTS; all are finite for the empty text too."""
    c = dict(zip(COUNTS, counts.T.astype(np.float64), strict=True))
    words, chars, lines, letters = (np.maximum(c[k], 1) for k in ("n_words", "n_chars", "n_lines", "n_letters"))
    return np.stack([
        np.log1p(c["n_words"]), np.log1p(c["n_chars"]), c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / lines, c["n_repeat_words"] / words,
        c["n_distinct_words"] / words, c["n_upper"] / letters, c["n_digits"] / chars, c["n_punctuation"] / words, c["n_bangs"] / words, c["n_pipes"] / words,
        c["n_wide"] / chars, c["n_words"] / lines, c["longest_word"], c["n_same_next"] / words, c["n_letters"] / chars,
    ], axis=1)


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth, flattened: node k of a tree has the children 2k + 1 and 2k + 2."""

    feature: np.ndarray  # int, trees x inner nodes
    threshold: np.ndarray  # float, trees x inner nodes: a value above it goes right
    leaf: np.ndarray  # float, trees x leaves
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for rows of features: all rows go down all trees together."""
        raw = np.full(len(x), self.base)
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[np.arange(len(x)), f[node]] > t[node])
            raw += leaf[node - len(f)]
        return 1 / (1 + np.exp(-raw))


def fit_trees(x: np.ndarray, y: np.ndarray, n_trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 48, l2: float = 1.0, least: float = 2.0) -> Trees:
    """Boost `n_trees` trees on the logistic loss; splits come from histograms of gradients over quantile bins.

    Without rows every score is 0.5; with one class in `y` about that class's share.
    """
    n, nf = x.shape
    p = (y.sum() + 1) / (n + 2)
    base, inner, leaves = float(np.log(p / (1 - p))), 2**depth - 1, 2**depth
    feature, threshold, leaf = np.zeros((n_trees, inner), np.int64), np.full((n_trees, inner), np.inf), np.zeros((n_trees, leaves))
    if n == 0 or y.min() == y.max():
        return Trees(feature[:0], threshold[:0], leaf[:0], base, depth)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(nf)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(nf)], axis=1)
    flat, raw = binned + np.arange(nf) * bins, np.full(n, base)
    for t in range(n_trees):
        q = 1 / (1 + np.exp(-raw))
        g, h = q - y, q * (1 - q)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (nf * bins) + flat).ravel()
            gl, hl = (np.bincount(at, np.repeat(w, nf), width * nf * bins).reshape(width, nf, bins).cumsum(axis=2) for w in (g, h))
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(hl < least) | (ht - hl < least)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-6 and b < len(edges[f]):
                    feature[t, first + k], threshold[t, first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[t][node]] > threshold[t][node])
        end = node - inner
        leaf[t] = -rate * np.bincount(end, g, leaves) / (np.bincount(end, h, leaves) + l2)
        raw += leaf[t][end]
    return Trees(feature, threshold, leaf, base, depth)


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held_fold: int = 0, threshold: float = 0.3, fit_rows: int = FIT_ROWS) -> DataFrame:
    """A row for each row of `docs` (doc_id, text): doc_id, held_out, score, predicted.

    Trees learn from `labels` (doc_id, quality) of documents whose crc32 modulo `folds` isn't
    `held_fold`, from at most `fit_rows` rows of them, picked by a hash of the row; held_out marks the others. Scores use statistics of
    the whole text only. Null or empty texts are scored as empty ones; a null id is hashed as the empty
    text and never labelled. Null qualities don't count; of several for one id the largest does. Without
    labels every score is 0.5. Other columns are ignored.
    """
    spark = docs.sparkSession
    stats = cut(with_counts(docs))
    known = labels.filter(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("_y"))
    known = known.filter(crc32_mod(F.col("doc_id"), folds) != held_fold)
    rows = stats.join(known, "doc_id").select("doc_id", "_y", *COUNTS)
    rows = rows.withColumn("_h", F.xxhash64(F.lit("quality"), *rows.columns))
    last = rows.select("_h").orderBy("_h").limit(fit_rows).agg(F.max("_h")).first()[0]  # numbers alone are ordered; of repeated rows as many are taken as there is room for
    rows = rows.filter(F.col("_h") <= F.lit(last)).orderBy("_h").limit(fit_rows).drop("_h")
    sample = np.array([tuple(r) for r in rows.collect()], np.int64).reshape(-1, len(COUNTS) + 2)  # at most fit_rows rows of counts
    sample = sample[np.lexsort(sample.T[::-1])]
    trees = spark.sparkContext.broadcast(fit_trees(features(sample[:, 2:]), (sample[:, 1] > 0).astype(np.float64)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(np.stack([batch.column(c).to_numpy() for c in COUNTS], axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(trees.value.score(x))], ["doc_id", "score"])

    scored = stats.mapInArrow(score, "doc_id bigint, score double")
    return scored.select("doc_id", (crc32_mod(F.col("doc_id"), folds) == held_fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`score_quality` of all documents by labels.quality."""
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
