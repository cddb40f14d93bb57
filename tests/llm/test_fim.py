"""Fill-in-middle against plain Python: units by the grammar itself, cuts by list slices."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from evigrid.llm import fim

SCHEMA = "doc_id long, text string, n long, output string, _text string, form string"


def texts():
    rng = random.Random(5)
    out = [None, "", "\n", "\n\n\n", "one", "one\n", "\r\n x\r\n", "\n\ttab  \n", "a<P>b", "x\n<S>", "<M>", "<\nP>", "<<\n<S", "é\n😀\n😀😀", "\U0001f600", " \n\u0085", "a\x00b\n", "word " * 50_000, "line of it\n" * 30_000]
    return out + ["".join(rng.choice("ab \n\té😀<>PSM.") for _ in range(rng.randint(1, 60))) for _ in range(150)]


def rows():
    out = [(i, t, 3, "o", "t", "f") for i, t in enumerate(texts())]
    return [*out, out[5], (None, "a\nb\nc", None, None, None, None), (None, None, None, None, None, None)]


def brute(key, text, grammar=fim.LINES, rate=100, spm=50):
    text = text or ""
    units = [m[0] for m in re.finditer(grammar, text, re.ASCII)]
    digest = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if text == "" or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return (key, len(units), "plain", None, None, text)
    if h4 % 100 < spm:
        return (key, len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (key, len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}")


@pytest.mark.parametrize("grammar", [fim.LINES, fim.WORDS, fim.CHARACTERS, r"[0-9]+|[^0-9]+", r"[^ ]+ *| +"])
def test_units_are_those_of_the_grammar(spark, grammar):
    own = [t for t in texts() if t and (len(t) < 1000 or grammar != fim.CHARACTERS)]
    got = spark.createDataFrame([(t,) for t in own], "t string").select("t", fim.units(F.col("t"), grammar).alias("u")).collect()
    assert all(r["u"] == [m[0] for m in re.finditer(grammar, r["t"], re.ASCII)] for r in got)


def test_boundaries_of_lines():
    assert fim.boundary(fim.LINES) == r"(?<=[\x0a])(?=[\s\S])"


@pytest.mark.parametrize("grammar", [r"[^.]*\.\s*|[^.]+", r"[a-z]+", r"aa|[\s\S]"])
def test_grammars_that_neighbours_do_not_decide(grammar):
    with pytest.raises(ValueError):
        fim.boundary(grammar)


@pytest.mark.parametrize(("rate", "spm"), [(100, 50), (60, 0), (0, 50)])
def test_forms_and_texts(spark, rate, spm):
    own = rows()
    out = fim.transform(spark.createDataFrame(own, SCHEMA), rate=rate, spm=spm)
    assert out.columns == [*SCHEMA.replace(",", "").split()[::2], "n_", "form_", "prefix", "middle", "suffix", "output_"]
    got = out.select("doc_id", "n_", "form_", F.char_length("prefix"), F.char_length("middle"), "output_", fim.restore(F.col("output_"), F.col("form_")), F.coalesce("text", F.lit(""))).collect()
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted((brute(r[0], r[1], rate=rate, spm=spm) for r in own), key=repr)
    assert all(r[6] == r[7] for r in got)


def test_empty_table_and_marks(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    assert fim.transform(docs.limit(0)).count() == 0
    for marks in (("<P>", "<P>x", "<M>"), ("", "<S>", "<M>"), ("<P<", "<S>", "<M>")):
        with pytest.raises(ValueError, match="told"):
            fim.transform(docs, sentinels=marks)
