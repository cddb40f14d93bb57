"""Collocations against one loop over all phrases in plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from evigrid.llm import collocations

SCHEMA = "doc_id long, text string, lang string, phrase string, a long, salt string"


def texts(seed=1, n=120):
    rng = random.Random(seed)
    words = ["of", "the", "en", "de", "und", "The", "new", "york", "états", "unis", "a", "x\x00y", " ", "é", "ﬁ", "日本", *(f"w{k}" for k in range(30))]
    fixed = ["new york city hall", "of the", "a a a a a", "états  unis", "of\tthe new"]
    piece = lambda: rng.choice([" ", "\t", "  "]).join(rng.choice(fixed) if rng.random() < 0.4 else rng.choice(words) for _ in range(rng.randint(0, 9)))
    return ["".join(piece() + rng.choice([". ", ",", "\n", "\r\n", "\x0b", "!?", "; ", ":"]) for _ in range(rng.randint(0, 20))) for _ in range(n)]


def rows():
    own = texts()
    out = [(i, t, [None, "en", "de", "und", ""][i % 5], "p", 3, "s") for i, t in enumerate(own)]
    return out + [out[1], out[1], (None, own[2], None, None, None, None), (None, None, "xx", None, None, None), (9, "", "en", "", 0, ""), (10, "new york " * 3000 + "." + "a b. " * 4000, "en", "", 0, "")]


def brute(rows, least, most, cover=80):
    f, total = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^ \t]+", piece)
            total[lang] += len(w)
            f[lang].update(tuple(w[i : i + n]) for n in (1, 2, 3, 4) for i in range(len(w) - n + 1))
    out = []
    for lang, own in f.items():
        found = []
        for p, a in own.items():
            if len(p) > 1 and a >= least:
                score, k = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
                if not any(100 * b >= cover * a and len(q) > len(p) and b >= least and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in own.items()):
                    found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, total[lang], -score) for rank, (score, a, p, left, right) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize(("shard", "report", "phrases", "bucket", "rank", "least", "most"), [(1 << 24, 1 << 23, 200_000, 32, 50_000, 30, 2000), (500, 300, 7, 1 << 20, 10, 5, 2000), (3000, 20, 50, 1, 3, 300, 4), (90, 1 << 20, 1, 1 << 30, 1, 12, 9)])
def test_collocations(spark, monkeypatch, shard, report, phrases, bucket, rank, least, most):
    for name, value in (("SHARD", shard), ("REPORT", report), ("MOST_PHRASES", phrases), ("BUCKET_BYTES", bucket), ("RANK_ROWS", rank)):
        monkeypatch.setattr(collocations, name, value)
    own = rows()
    got = collocations.mine(spark, spark.createDataFrame(own, SCHEMA).repartition(3), least, most)
    want = brute(own, least, most)
    assert len(want) > 5
    assert sorted(tuple(r) for r in got.collect()) == want


def test_empty_tables(spark):
    for own in ([], [(None,) * 6], [(1, "a b c", "en", "", 0, "")]):
        assert collocations.mine(spark, spark.createDataFrame(own, SCHEMA)).count() == 0


def test_sketch_bounds_counts_from_above(spark):
    """No phrase that occurs often enough is lost, and a bucket is passed only if its phrases together are."""
    df = spark.createDataFrame(rows(), SCHEMA).selectExpr("coalesce(lang, 'und') AS lang", "coalesce(text, '') AS text")
    filled, bits = collocations.sketch(spark, df, 20)
    sums, exact = Counter(), Counter()
    for r in df.collect():
        grams = collocations.Grams([(r["lang"], r["text"].encode().translate(collocations.FOLD))])
        for own, ok in zip(grams.hashes, grams.whole, strict=True):
            sums.update((own[ok] >> np.uint64(64 - bits)).tolist())
            exact.update(own[ok].tolist())
    assert {int(b) for b in np.flatnonzero(np.unpackbits(filled))} == {b for b, n in sums.items() if n >= 20}
    assert len(exact) > 1000


def test_words_that_are_names_of_languages(spark):
    """The word en in texts of language es, and the other way round."""
    own = [(0, " ".join(["es en", "en es", "es es"] * 40) + "\n", lang, "", 0, "") for lang in ("en", "es", "und", None)]
    got = {(r["lang"], r["phrase"]): r["a"] for r in collocations.counts(spark, spark.createDataFrame(own, SCHEMA), 1).collect()}
    assert got["es", "en"] == got["en", "en"] == 80 and got["es", "es"] == got["en", "es"] == 160 and got["und", "en"] == 160 and got["en", ""] == 240


def test_long_texts_end_with_pieces():
    text = b"a b\nc d\n" * 1000 + b"x" * 500
    for size in (3, 10, 100, 10_000):
        own = list(collocations.parts(text, size))
        assert b"".join(own) == text and all(p.endswith(b"\n") for p in own[:-1])


def test_products_pass_64_bits(spark):
    big = 9_000_000_000_000_000_000
    own = [("en", "a", big), ("en", "b", big), ("en", "a b", big - 10), ("en", "", 1)]
    got = collocations.score(spark.createDataFrame(own, "lang string, phrase string, a long").where("phrase <> ''")).first()
    assert got["score"] == 2_000_000 * (big - 10) // (2 * big)


def test_matches_of_several_automata(monkeypatch):
    """Overlapping matches, in pieces and languages' bytes, are counted alike however many automata hold the phrases."""
    text = "a a a b\nb a a\né a  b a b\n" * 3 + "aa ab"
    phrases = [p.encode() for p in ("a", "a a", "a b", "b a", "a a a", "é a b", "b", "aa", "x", "b b")]
    padded = [f" {' '.join(piece.split())} ".replace(" ", "  ") for piece in text.split("\n")]
    want = {p: n for p in phrases if (n := sum(piece.startswith(f"  {p.decode().replace(' ', '  ')}  ", i) for piece in padded for i in range(len(piece))))}
    for most in (100_000, 3):
        monkeypatch.setattr(collocations, "MOST_PHRASES", most)
        assert collocations.count_matches(text.encode(), phrases) == want and collocations.count_matches(text.encode(), []) == {}
