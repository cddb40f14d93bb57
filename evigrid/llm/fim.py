"""Fill-in-middle transformation by lookaround splitting.

A unit grammar says how a text falls into units, matched left to right (lines: `[^\\n]*\\n|[^\\n]+`). Where it cuts between two
neighbouring characters must depend on these two alone; then the grammar is the same as a zero-width expression, one
lookbehind and one lookahead for each class of left neighbours. Spark's split at that expression keeps every character, and
prefix, middle and suffix are runs of the pieces. All of it is columns: nothing is shuffled and no Python runs.

boundary() finds the classes: characters that no part of the grammar tells apart are one class (all beyond ASCII together), and
the grammar is tried on all strings of up to PROBE representatives. A grammar that cuts the same two neighbours in one string and
not in another, or leaves out a character, raises an error (sentences that end with a full stop and blanks, say).

Null texts count as empty. An empty text has no units (split would give it one), and its form is plain; so is that of a text
which holds a sentinel. Null keys count as empty; equal keys get equal cuts, so a repeated row is repeated in the result. Long texts are read
whole. An empty table gives an empty result. Columns of docs may have any names: where docs has a new name, underscores follow it.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, whole

LINES = r"[^\n]*\n|[^\n]+"
WORDS = r"\s*\S+|\s+"
CHARACTERS = r"[\x00-\x7F]|[^\x00-\x7F]"

#: Before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")

#: Length of the strings that a grammar is tried on.
PROBE = 5

#: Stands for all characters beyond ASCII, which a grammar can't tell apart.
BEYOND = "é"


def _classes(grammar: str) -> list[list[str]]:
    """Characters of ASCII, and BEYOND, by the parts of the grammar that match them."""
    parts = re.findall(r"\[\^?\]?(?:\\.|[^\]\\])*\]|\\x[0-9A-Fa-f]{2}|\\.|[^\\\[\]|*+?(){}]", grammar)
    kinds: dict[tuple, list[str]] = {}
    for c in [*map(chr, range(128)), BEYOND]:
        kinds.setdefault(tuple(bool(re.fullmatch(p, c, re.ASCII | re.DOTALL)) for p in parts), []).append(c)
    return list(kinds.values())


def _charset(chars: set[str]) -> str:
    """A class of Java expressions; with BEYOND it is the complement of what is left out."""
    inner = "".join(f"\\x{ord(c):02x}" for c in sorted(({*map(chr, range(128))} - chars) if BEYOND in chars else chars))
    return f"[^{inner}]" if BEYOND in chars and inner else r"[\s\S]" if BEYOND in chars else f"[{inner}]"


@lru_cache(maxsize=32)
def boundary(grammar: str) -> str:
    """The grammar as a zero-width expression that matches where one unit ends and the next begins."""
    unit, classes = re.compile(grammar, re.ASCII), _classes(grammar)
    names = [max(group) for group in classes]
    cuts: dict[tuple[int, int], bool] = {}
    for n in range(1, PROBE + 1):
        for word in product(range(len(names)), repeat=n):
            text = "".join(names[k] for k in word)
            ends, at = set(), 0
            for m in unit.finditer(text):
                if m.start() != at or m.end() == at:
                    break
                ends.add(at := m.end())
            if at != n:
                raise ValueError(f"{grammar}: leaves out a part of {text!r}")
            for i in range(1, n):
                if cuts.setdefault(word[i - 1 : i + 1], i in ends) != (i in ends):
                    raise ValueError(f"{grammar}: a cut between {names[word[i - 1]]!r} and {names[word[i]]!r} depends on more than these")
    behind: dict[tuple, set[str]] = {}
    for a, group in enumerate(classes):
        behind.setdefault(tuple(b for b in range(len(names)) if cuts[a, b]), set()).update(group)
    rules = [f"(?<={_charset(left)})(?={_charset({c for b in right for c in classes[b]})})" for right, left in behind.items() if right]
    return "|".join(rules) or r"(?!)"


def units(text: Column, grammar: str = LINES) -> Column:
    """array<string>: the units of a text, which together are the text; none of an empty one."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(grammar), -1))


def draws(key: Column, seed: int | str) -> Column:
    """array<long>: eight numbers below 2^32, by the SHA-256 of `seed:key`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(digest, i * 8 + 1, 8), 16, 10).cast("long"))


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made from."""
    p, s, m = (F.lit(x) for x in sentinels)
    after = lambda x, mark: F.substring(x, F.instr(x, mark) + F.char_length(mark), F.char_length(x))
    until = lambda x, mark: F.substring(x, F.lit(1), F.instr(x, mark) - 1)
    middle = after(output, m)
    psm = F.concat(after(until(output, s), p), middle, until(after(output, s), m))
    spm = F.concat(until(after(output, p), m), middle, after(until(output, p), s))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def transform(
    docs: DataFrame, key: str = "doc_id", text: str = "text", grammar: str = LINES, seed: int | str = 7, rate: int = 100, spm: int = 50, sentinels: tuple[str, str, str] = SENTINELS
) -> DataFrame:
    """docs with n (units), form (plain, psm or spm), prefix, middle and suffix (null if plain), and output.

    rate: percent of texts that are cut; spm: percent of these that begin with the suffix. The first draws of a key choose the
    ends of prefix and middle among the n + 1 places between units, the third and fourth whether and how the text is cut.
    """
    for mark in sentinels:
        if not mark or any(mark in other for other in sentinels if other is not mark) or mark[0] in mark[1:]:
            raise ValueError(f"{mark!r} can't be told from other text")
    t, u, d = (free_name(docs, x) for x in ("_text", "_units", "_draws"))
    names = {x: free_name(docs, x) for x in ("n", "form", "prefix", "middle", "suffix", "output")}
    out = docs.withColumn(t, whole(F.col(text))).withColumn(u, units(F.col(t), grammar)).withColumn(d, draws(F.col(key), seed))
    n = F.size(u).cast("long")
    out = out.withColumn(names["n"], n)
    draw = lambda k: F.get(d, F.lit(k))
    plain = (F.col(t) == "") | (draw(2) % 100 >= rate)
    for mark in sentinels:
        plain = plain | F.contains(F.col(t), F.lit(mark))
    out = out.withColumn(names["form"], F.when(plain, "plain").when(draw(3) % 100 < spm, "spm").otherwise("psm"))
    places = [(draw(k) % (F.col(names["n"]) + 1)).cast("int") for k in (0, 1)]
    low, high = F.least(*places), F.greatest(*places)
    cut = F.col(names["form"]) != "plain"
    run = lambda begin, count: F.when(cut, F.array_join(F.slice(F.col(u), begin + 1, count), ""))
    out = out.withColumns({names["prefix"]: run(F.lit(0), low), names["middle"]: run(low, high - low), names["suffix"]: run(high, F.col(names["n"]).cast("int") - high)})
    p, s, m = (F.lit(x) for x in sentinels)
    prefix, middle, suffix = (F.col(names[x]) for x in ("prefix", "middle", "suffix"))
    output = F.when(F.col(names["form"]) == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(cut, F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.col(t))
    return out.withColumn(names["output"], output).drop(t, u, d)
