"""Quality rules by weak supervision.

Each rule votes good (1), bad (-1) or abstains (0) on statistics of the text. Expectation-maximisation over the counts
of vote patterns estimates how often each rule votes what for good texts and for texts with each kind of fault, without
labels; a text's posterior probability of being good replaces a demand that all rules pass. Bad texts have one kind for
each rule since faults seldom come together: with a single bad kind, the rules that agree most would outvote the rest.

Everything that touches documents is native: one pass computes statistics and votes, one small aggregation counts the
patterns (3 to the power of the number of rules at most, whatever the corpus holds), and the posterior is a sum of
constants chosen by votes. The estimation itself is a loop over the pattern counts.

Null and empty texts have no words: their statistics are 0 and they fail the base rules. Repeated rows are judged
alike, each by itself. An empty table gives an empty result. Other columns of the table are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .text_stats import with_stats

MIN_WORDS, MAX_REPEATED_PERCENT = 20, 30


@dataclass(frozen=True)
class Rule:
    """value below low votes one way, above high the other; between them, or where applies is false, it abstains."""

    name: str
    value: Column
    low: float
    high: float
    low_vote: int
    high_vote: int
    applies: Column | None = None

    def vote(self) -> Column:
        vote = F.when(self.value <= self.low, self.low_vote).when(self.value >= self.high, self.high_vote).otherwise(0)
        return vote if self.applies is None else F.when(self.applies, vote).otherwise(0)


def default_rules(stats: str = "stats") -> list[Rule]:
    s = lambda name: F.col(f"{stats}.{name}")
    per_word = lambda name: s(name) / F.greatest(s("n_words"), F.lit(1))
    has_words = s("n_words") > 0
    return [
        Rule("symbols", per_word("n_symbols"), 0.03, 0.12, 1, -1, has_words),
        Rule("exclamations", per_word("n_exclamations"), 0.03, 0.15, 1, -1, has_words),
        Rule("capitals", s("n_capitals") / F.greatest(s("word_chars"), F.lit(1)), 0.12, 0.35, 1, -1, has_words),
        Rule("repeated_words", per_word("n_repeat_words"), 0.0, 0.15, 1, -1, s("n_words") >= 16),
        Rule("repeated_lines", s("n_dup_lines") / F.greatest(s("n_lines"), F.lit(1)), 0.0, 0.3, 1, -1, s("n_lines") >= 3),
        Rule("word_length", s("word_chars") / F.greatest(s("n_words"), F.lit(1)), 2.5, 15.0, -1, -1, has_words),
        Rule("distinct_words", per_word("n_distinct_words"), 0.25, 0.45, -1, 1, s("n_words").between(30, 1500)),
        Rule("punctuation", per_word("n_stops"), 0.005, 0.02, -1, 1, s("n_words") >= 40),
    ]


GOOD = 0

#: A rule is written so that it blames few good texts; estimates above this share are cut to it. Without that bound, a
#: rule that no other supports could explain its own blame as error.
MOST_BLAME = 0.01


@dataclass(frozen=True)
class VoteModel:
    """Latent kinds of text: kind 0 is good; for each rule there is a kind with the fault that it looks for.

    shares: of the kinds. blame[kind][rule]: chance that the rule, when it doesn't abstain, votes bad. Abstaining says nothing.
    """

    shares: list[float]
    blame: list[list[float]]

    def posterior(self, votes: list[int]) -> list[float]:
        """Of each kind."""
        logs = [math.log(s) + sum(math.log(p if v < 0 else 1 - p) for v, p in zip(votes, kind, strict=True) if v) for s, kind in zip(self.shares, self.blame, strict=True)]
        likely = [math.exp(x - max(logs)) for x in logs]
        return [x / sum(likely) for x in likely]

    def accuracies(self) -> list[tuple[float, float]]:
        """For each rule: the share of bad texts that it blames, and of good ones that it doesn't, where it votes."""
        bad = sum(self.shares[1:])
        return [(sum(s * kind[j] for s, kind in zip(self.shares[1:], self.blame[1:], strict=True)) / bad, 1 - g) for j, g in enumerate(self.blame[GOOD])]

    def good_column(self, votes: list[Column]) -> Column:
        """The posterior probability of being good: 1 over the sum of the kinds' odds against it."""
        against = F.lit(1.0)
        for share, kind in zip(self.shares[1:], self.blame[1:], strict=True):
            odds = F.lit(math.log(share / self.shares[GOOD]))
            for vote, p, g in zip(votes, kind, self.blame[GOOD], strict=True):
                odds = odds + F.when(vote < 0, math.log(p / g)).when(vote > 0, math.log((1 - p) / (1 - g))).otherwise(0.0)
            against = against + F.exp(odds)
        return 1 / against


def start(n_rules: int, good: float = 0.8) -> VoteModel:
    """What rules are meant to say: each finds one of many faults, misses most others, and hardly ever blames a good text."""
    return VoteModel([good] + [(1 - good) / n_rules] * n_rules, [[0.003] * n_rules] + [[0.9 if i == j else 0.1 for j in range(n_rules)] for i in range(n_rules)])


def estimate(patterns: list[tuple[list[int], int]], n_rules: int, rounds: int = 60, weight: float = 2.0) -> VoteModel:
    """Expectation-maximisation over (votes, count) patterns.

    Each kind keeps `weight` pseudo-counts of its start, so that no estimate is 0 or 1; without any pattern, the start
    is the model.
    """
    first = model = start(n_rules)
    kinds = range(n_rules + 1)
    for _ in range(rounds if patterns else 0):
        sizes = [weight * s for s in first.shares]
        bad = [[weight * p for p in first.blame[k]] for k in kinds]
        all_ = [[weight] * n_rules for _ in kinds]
        for votes, count in patterns:
            for k, p in enumerate(model.posterior(votes)):
                sizes[k] += p * count
                for j, v in enumerate(votes):
                    bad[k][j] += p * count * (v < 0)
                    all_[k][j] += p * count * (v != 0)
        blame = [[min(MOST_BLAME if k == GOOD else 1.0, b / n) for b, n in zip(bad[k], all_[k], strict=True)] for k in kinds]
        new = VoteModel([s / sum(sizes) for s in sizes], blame)
        moved, model = max(abs(a - b) for a, b in zip(new.shares, model.shares, strict=True)), new
        if moved < 1e-9:
            break
    return model


def judge(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the statistics, each rule's vote, base_failed, posterior and kept for every row of docs."""
    rules = default_rules()
    votes = [F.col(f"vote_{r.name}") for r in rules]
    seen = with_stats(docs.select(F.col(key), F.col(text)), text).select(key, "stats")
    seen = Scratch(spark, "quality_rules").save(seen.select(key, "stats", *(r.vote().cast("byte").alias(f"vote_{r.name}") for r in rules)))
    counted = seen.groupBy(*votes).agg(F.count(F.lit(1)).alias("n")).collect()
    model = estimate(sorted(([int(v) for v in row[:-1]], row[-1]) for row in counted), len(rules))
    s = lambda name: F.col(f"stats.{name}")
    failed = (s("n_words") < MIN_WORDS) | (100 * s("n_repeat_words") > MAX_REPEATED_PERCENT * s("n_words"))
    out = seen.select(key, "stats.*", *votes, failed.alias("base_failed"), model.good_column(votes).alias("posterior"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))


def keep_good(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of judge() that stay."""
    return judge(spark, docs, key, text).where("kept")
