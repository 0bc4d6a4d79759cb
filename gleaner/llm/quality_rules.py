"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import cut, table
from gleaner.llm.text_stats import with_counts

BAD, ABSTAIN, GOOD = 0, 1, 2


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)


def rules() -> dict[str, Column]:
    """Votes from the columns of text_stats: BAD, ABSTAIN or GOOD.

    A rule that finds a fault says BAD, else it abstains: to be without one fault is no sign of quality. What
    speaks for a text are the looks of prose and a varied wording.
    """
    words, lines, letters, chars, in_words = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "n_lines", "n_letters", "n_chars", "word_chars"))
    length, symbols, again = F.col("word_chars") / words, F.col("n_symbols") / words, F.col("n_repeat_words") / words
    same, distinct, dup = F.col("n_same_next") / words, F.col("n_distinct_words") / words, F.col("n_dup_lines") / lines
    upper, bangs, digits = F.col("n_upper") / letters, F.col("n_bangs") / words, F.col("n_digits") / chars
    lettered, stops = F.col("n_letters") / in_words, F.col("n_punctuation") / words
    enough = F.col("n_words") >= 20
    never = F.lit(False)
    return {
        "word_length": _vote((length < 2) | (length > 25), never),
        "symbols": _vote(symbols > 0.25, never),
        "repetition": _vote((again > 0.25) | (same > 0.15) | (dup > 0.5) | (enough & (distinct < 0.1)), never),
        "shouting": _vote((upper > 0.4) | (bangs > 0.25), never),
        "digits": _vote(digits > 0.3, never),
        "prose": _vote(enough & (lettered < 0.7), enough & (lettered > 0.9) & (upper < 0.25) & (stops > 0.005) & (stops < 0.5)),
        "varied": _vote(never, enough & (again < 0.15) & (same < 0.05) & (symbols < 0.1) & (upper < 0.4)),
    }


#: What rules are held to do before any document is seen, as so many documents of each class: (BAD, ABSTAIN, GOOD) on bad and on good ones.
STRENGTH = 10.0
EXPECTED = np.array([[0.6, 0.3, 0.1], [0.1, 0.3, 0.6]])


@dataclass(frozen=True)
class Voters:
    """The share of good documents, and how often each rule casts each vote on bad and on good ones (class, rule, vote)."""

    prior: float
    rates: np.ndarray

    @property
    def weights(self) -> np.ndarray:
        """(rule, vote): what a vote adds to the log odds that a document is good; an abstention adds nothing."""
        w = np.log(self.rates[1]) - np.log(self.rates[0])
        w[:, ABSTAIN] = 0
        return w

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """The probability that a document with these votes is good."""
        said = self.weights[np.arange(patterns.shape[1]), patterns].sum(axis=1)
        return 1 / (1 + np.exp(-(np.log(self.prior / (1 - self.prior)) + said)))


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500) -> Voters:
    """The prior and each rule's rates by expectation-maximisation, two-sided: a rule may be right about bad documents and blind to good ones.

    `patterns`: vote patterns, a row each; `counts`: how many documents show them. It begins with the balance of the votes. Each rule's
    rates are smoothed by STRENGTH documents of EXPECTED, of the votes that it ever casts. Without a document the prior is a half.
    """
    n_rules = patterns.shape[1]
    cast = np.stack([patterns == v for v in (BAD, ABSTAIN, GOOD)], axis=2).astype(np.float64)
    known = np.einsum("p,pkv->kv", counts, cast) > 0
    known[~known.any(axis=1)] = True
    good = 1 / (1 + np.exp(-2.0 * (patterns - ABSTAIN).sum(axis=1)))
    voters = Voters(0.5, np.repeat(EXPECTED[:, None, :], n_rules, axis=1))
    for _ in range(rounds):
        seen = np.stack([np.einsum("p,pkv->kv", counts * w, cast) for w in (1 - good, good)]) + STRENGTH * EXPECTED[:, None, :] * known + 1e-9
        voters = Voters(float((counts @ good + STRENGTH / 2) / (counts.sum() + STRENGTH)), seen / seen.sum(axis=2, keepdims=True))
        new = voters.posterior(patterns)
        done, good = np.abs(new - good).max(initial=0) < 1e-9, new
        if done:
            break
    return voters


def judge(docs: DataFrame, min_quality: float = 0.5) -> DataFrame:
    """A row for each row of `docs` (doc_id, text): doc_id, the counts of text_stats, base_failed, quality, kept.

    base_failed: under 20 words, or over 30% of the words in repeated windows. quality is the posterior of
    the rules' votes, the fitted prior where all abstain; kept asks for `min_quality` and not base_failed. Null and empty texts have counts
    of zero (and one line) and fail. Repeated rows count each. Other columns are ignored. An empty
    table gives an empty one.

    What is fitted are the counts of vote patterns over all documents: at most 3 to the number of rules.
    """
    votes = rules()
    stats = cut(with_counts(docs))
    code = sum((c * 3**k for k, c in enumerate(votes.values())), F.lit(0))
    stats = stats.withColumn("_votes", code.cast("int"))
    seen = np.array([tuple(r) for r in stats.groupBy("_votes").count().orderBy("_votes").collect()], np.int64).reshape(-1, 2)  # at most 3 to the number of rules
    patterns = seen[:, :1] // 3 ** np.arange(len(votes)) % 3
    voters = fit_votes(patterns, seen[:, 1].astype(np.float64))
    odds = F.lit(float(np.log(voters.prior / (1 - voters.prior))))
    for weight, vote in zip(voters.weights, votes.values(), strict=True):
        odds = odds + F.when(vote == BAD, float(weight[BAD])).when(vote == GOOD, float(weight[GOOD])).otherwise(0.0)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    judged = stats.drop("_votes").withColumn("base_failed", failed).withColumn("quality", 1 / (1 + F.exp(-odds)))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= min_quality))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`judge` over all documents."""
    out = judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"))
