"""Empty tables, odd rows and clashing names for operators and for every stage of the pipeline; rules against plain Python."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evigrid.llm import bpe, exact_dedup, license_scan, quality_rules, queries, rule_ensemble, text_stats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, score string, _digest string, _kept int, stats string, rate double, n int, p array<int>"
SF = "/root/testdata/sf0.001"


def odd_rows():
    long = "word and other words, line after line.\n" * 4000
    texts = [None, "", " \n", "one", "a b c d e", "The same sentence stands here, and it is long enough. " * 3, long, "É ß 日本 😀. " * 30]
    rows = [(i, t, None, None, None, "x", "y", "z", 3, "s", 0.5, 7, [1]) for i, t in enumerate(texts * 2)]
    return [*rows, rows[5], rows[5], (None, texts[5], *[None] * 11), (None, None, *[None] * 11)]


def test_operators_of_an_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert license_scan.scan(spark, none.drop("score")).count() == 0
    assert bpe.round_trip(spark, none, *queries.tokenizer()).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = rule_ensemble.train(spark, none, labels)
    assert rule_ensemble.score(none, model).count() == 0 and rule_ensemble.keep_good(none, model).count() == 0
    assert quality_rules.judge(spark, none).count() == 0


@pytest.mark.filterwarnings("ignore:no rates found")
@pytest.mark.parametrize("empty", [True, False])
def test_stages_of_odd_tables(spark, empty):
    """Each stage but the last gives the columns it got, whatever their names; a table without rows passes all."""
    import corpus_pipeline

    docs = spark.createDataFrame([] if empty else odd_rows(), SCHEMA)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns
        rows = out.collect()
        assert not rows if empty else rows or k == 0


def test_an_index_outlives_its_catalog(spark, tmp_path):
    """Its files are in the folder that it is given; a table that the catalog has lost is taken up again."""
    df = spark.createDataFrame([(i, f"text {i % 3}") for i in range(9)], "doc_id long, text string")
    name = f"digests_{random.randrange(10**9)}"
    index = exact_dedup.DigestIndex(spark, name, root=str(tmp_path))
    assert sorted(r["doc_id"] for r in exact_dedup.deduplicate(spark, df, index, "a").collect()) == [6, 7, 8]
    assert list((tmp_path / name).glob("*.parquet"))
    spark.sql(f"DROP TABLE {name}")  # an external table: its files stay
    again = exact_dedup.DigestIndex(spark, name, root=str(tmp_path))
    assert again.rows().count() == 3
    more = spark.createDataFrame([(20, "TEXT 1"), (21, "text 9")], df.schema)
    assert [r["doc_id"] for r in exact_dedup.deduplicate(spark, more, again, "b").collect()] == [21]
    again.drop()
    assert not (tmp_path / name).exists() and not spark.catalog.tableExists(name)


def plain_model(patterns, n, rounds=60, weight=2.0):
    """Expectation-maximisation over single texts, one at a time, in the words of its definition."""
    shares, blame = [0.8] + [0.2 / n] * n, [[0.003] * n] + [[0.9 if i == j else 0.1 for j in range(n)] for i in range(n)]
    shares0, blame0 = list(shares), [list(b) for b in blame]
    texts = [v for v, c in patterns for _ in range(c)]

    def posterior(votes):
        like = [s * math.prod(p if v < 0 else 1 - p for v, p in zip(votes, b, strict=True) if v) for s, b in zip(shares, blame, strict=True)]
        return [x / sum(like) for x in like]

    for _ in range(rounds):
        post = [posterior(v) for v in texts]
        size = [weight * s + sum(p[k] for p in post) for k, s in enumerate(shares0)]
        new = []
        for k in range(n + 1):
            row = []
            for j in range(n):
                voted = weight + sum(p[k] for p, v in zip(post, texts, strict=True) if v[j])
                bad = weight * blame0[k][j] + sum(p[k] for p, v in zip(post, texts, strict=True) if v[j] < 0)
                row.append(min(0.01 if k == 0 else 1.0, bad / voted))
            new.append(row)
        moved = max(abs(a / sum(size) - b) for a, b in zip(size, shares, strict=True))
        shares, blame = [s / sum(size) for s in size], new
        if moved < 1e-9:
            break
    return posterior


def test_posterior_and_kept_of_every_text(spark):
    """The whole of judge() on a small corpus: votes to patterns, patterns to posteriors, posteriors to verdicts."""
    rng = random.Random(11)
    prose = [" ".join(rng.choice(["the", "river", "was", "quiet,", "and", "nobody", "came.", "It", "rained", "again"]) + rng.choice(["", "s", "ly"]) for _ in range(rng.randint(25, 90))) for _ in range(60)]
    junk = ["BUY NOW!!! $$$ ### " * 20, "click here | click here | " * 30, "WIN! WIN! WIN! " * 25, "same line again\n" * 40, "x y z " * 30, None, "", "too short"]
    rows = list(enumerate(prose + junk * 2))
    got = quality_rules.judge(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    names = [c for c in got[0].asDict() if c.startswith("vote_")]
    votes = {r["doc_id"]: tuple(r[c] for c in names) for r in got}
    posterior = plain_model(sorted(Counter(votes.values()).items()), len(names))
    for r in got:
        want = posterior(votes[r["doc_id"]])[0]
        assert r["posterior"] == pytest.approx(want, rel=1e-6, abs=1e-12)
        text = rows[r["doc_id"]][1] or ""
        failed = len(text.split()) < 20 or 100 * r["n_repeat_words"] > 30 * len(text.split())
        assert r["base_failed"] == failed and r["kept"] == (not failed and want >= 0.5)
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert kept and not kept & set(range(len(prose), len(rows)))


def test_votes_are_those_of_the_rules(spark):
    """Votes by hand from the statistics: below low, above high, between, and where a rule doesn't apply."""
    rules = {r.name: r for r in quality_rules.default_rules()}
    rows = [(0, "a " * 50 + "!" * 20), (1, "plain words " * 10), (2, ""), (3, "Q" * 200 + " b")]
    seen = text_stats.with_stats(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in seen.select("doc_id", *(rule.vote().alias(n) for n, rule in rules.items())).collect()}
    assert got[0]["exclamations"] == -1 and got[1]["exclamations"] == 1 and got[2]["exclamations"] == 0
    assert got[3]["word_length"] == -1 and got[3]["capitals"] == -1 and got[1]["word_length"] == 0
    assert got[1]["distinct_words"] == 0 and got[0]["distinct_words"] == -1 and F is not None
