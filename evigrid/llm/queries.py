"""The corpus operators as queries over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe, collocations, exact_dedup, fim, language_id, license_scan, mixing, near_dedup, quality_rules, rule_ensemble, token_scan, url_filter, warc
from .common import LOWER, UPPER, Scratch, scratch_root, table

TOKENIZER = "byte_bpe_50k.tiktoken"


def tokenizer() -> tuple[str, str]:
    """Rank file and split pattern."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(spark, table(spark, sf_dir, "documents"))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return out.select(*base, "posterior")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup.cluster(spark, table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


#: Links by a plain join on shared shingles; components by ids that spread along them.
OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM w
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), link AS MATERIALIZED (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), edge AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (SELECT a AS doc_id, a AS r FROM edge UNION SELECT edge.b, reach.r FROM reach JOIN edge ON reach.doc_id = edge.a
), low AS (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(r, doc_id) AS component_id, coalesce(r, doc_id) = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)
"""


#: Wanted shares of tokens: good prose most, low quality and toxic text a little.
MIX = {"good": 0.95, "low": 0.04, "toxic": 0.01}


def domains(labels: DataFrame) -> DataFrame:
    """doc_id and domain of labelled documents."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "good")
    return labels.select("doc_id", domain.alias("domain"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = mixing.train(spark, docs, domains(table(spark, sf_dir, "labels")))
    out, _ = mixing.rates(spark, docs, model, MIX)
    posterior = [F.col(f"p_{d}").alias(f"p_{name}") for d, name in enumerate(model.names)]
    return out.select("doc_id", F.col("tokens").alias("n_tokens"), *posterior, "rate", mixing.copies(F.col("rate"), F.col("doc_id")).alias("copies"))


#: The id that ends a document; the rank file leaves it free.
END = 50256


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens in flat files that are written from documents."""
    path, docs = f"{scratch_root(spark)}/tokens-{uuid.uuid4().hex}", table(spark, sf_dir, "documents")
    flat = token_scan.write_flat(spark, docs, path, *tokenizer(), END, key="doc_id")
    out = token_scan.count_tokens(spark, token_scan.blocks(spark, flat), END)
    out = token_scan.keyed(out, token_scan.keys(spark, path, END, docs.schema["doc_id"].dataType))
    return out.select(F.col("key").alias("doc_id"), "n_tokens", "part", "place", F.col("start").alias("start_in_file"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.md5(F.col("key").cast("binary")).startswith("0")  # stands for a published list of hosts: a sixteenth of all
    out = url_filter.judge(spark, table(spark, sf_dir, "pages"), listed)
    return out.select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = r"""
WITH cut AS (
  SELECT page_id, coalesce(url, '') AS u, strpos(coalesce(url, ''), '://') AS colon FROM pages
), parts AS (
  SELECT page_id, CASE WHEN colon = 0 THEN '' ELSE substr(u, colon + 3) END AS rest FROM cut
), keys AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM parts
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/'
  END AS rule FROM keys
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN host <> '' AND starts_with(md5(host), '0') THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled
"""


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("scan.hits", lambda h: h["kind"] == "base")
    labels = lambda hits: F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["label"]))), ",")
    return out.select(
        "doc_id",
        F.col("scan.n_words").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda h: h["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda h: h["start"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("scan.hits")).alias("labels"),
        F.when(F.exists("scan.hits", lambda h: h["kind"] == "template"), 1.0).when(F.size("scan.hits") > 0, 0.5).otherwise(0.0).alias("score"),
    )


def _template_regex(template: str) -> str:
    """A template as a regular expression over words with a blank before each."""
    out = ""
    for part in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", template):
        out += "(?:" if part == "[[" else ")?" if part == "]]" else f"(?: [^ ]*){{0,{part[2:-2]}}}" if part[0] == "{" else f" {part}"
    return f"{out} "


def _op6_sql() -> str:
    """Base places by comparing runs of words, templates by regular expressions."""
    places = " UNION ALL ".join(
        f"SELECT doc_id, '{label}' AS label, unnest(list_filter(range(len(w)), lambda i: w[i + 1:i + {len(p.split())}] = {p.split()})) AS place FROM w" for p, label in license_scan.PHRASES.items()
    )
    matched = " UNION ".join(f"SELECT doc_id, '{label}' AS label FROM j WHERE regexp_matches(j, '{_template_regex(t)}')" for label, t in license_scan.TEMPLATES)
    return rf"""
WITH w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), j AS MATERIALIZED (SELECT doc_id, regexp_replace(' ' || array_to_string(w, ' ') || ' ', '[\x{{2018}}-\x{{201F}}]', '', 'g') AS j FROM w
), hit AS ({places}
), base AS (SELECT doc_id, count(*) AS n, min(place) AS low, max(place) AS high, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM hit GROUP BY doc_id
), template AS ({matched}
), every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM hit UNION SELECT doc_id, label FROM template) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(base.n, 0) AS n_base, low AS first_word, high AS last_word, coalesce(base.labels, '') AS base_labels, coalesce(every.labels, '') AS labels,
  CASE WHEN doc_id IN (SELECT doc_id FROM template) THEN 1.0 WHEN base.n > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN every USING (doc_id)
"""


OP6_SQL = _op6_sql()


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = rule_ensemble.train(spark, docs, labels.where(~language_id.held_out(F.col("doc_id"), 3, 1)))
    out = rule_ensemble.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", language_id.held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = F.col("doc_id").isNotNull() & ~language_id.held_out(F.col("doc_id"), 5, 0)
    model = language_id.train(spark, docs.where(out))
    named = language_id.identify(spark, docs.select("doc_id", "text"), model)
    return named.select("doc_id", language_id.held_out(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.round_trip(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), *tokenizer())
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


#: Batches in which op10 takes documents in, the largest ids first.
BATCHES = 2


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches against an index that the earlier ones filled; it is the query's own and is dropped once the decisions are made."""
    docs = table(spark, sf_dir, "documents")
    index = exact_dedup.DigestIndex(spark, f"digests_{uuid.uuid4().hex}", docs.count())
    out = exact_dedup.decide_batches(spark, exact_dedup.descending(docs, BATCHES), index, "documents")
    index.drop()
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP10_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""

def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(spark, table(spark, sf_dir, "documents").select("lang", "text"))


#: All phrases of up to four words, counted without a sketch.
OP11_SQL = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), g AS (
  SELECT lang, m, unnest(list_transform(range(1, greatest(len(w) - m + 2, 1)), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM w, range(1, 5) t(m)
), f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30
), total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang
), cut AS (SELECT lang, phrase, m, a, string_split(phrase, ' ') AS s, unnest(range(1, m)) AS k FROM f WHERE m > 1
), scored AS (
  SELECT cut.lang, cut.phrase, cut.m, cut.a, k, x.a AS l, y.a AS r, (2000000::HUGEINT * cut.a) // (x.a::HUGEINT + y.a) AS score FROM cut
  JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(s[1:k], ' ') JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(s[k + 1:cut.m], ' ')
), lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), kept AS (
  SELECT * FROM lowest c WHERE NOT EXISTS (SELECT 1 FROM f q WHERE q.lang = c.lang AND q.m > c.m AND contains(' ' || q.phrase || ' ', ' ' || c.phrase || ' ') AND 100::HUGEINT * q.a >= 80::HUGEINT * c.a)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""


#: Payloads of fewer bytes are written out each time.
LEAST_REVISIT = 0


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page in archives that hold each payload once, as read back from them."""
    path, pages = f"{scratch_root(spark)}/warc-{uuid.uuid4().hex}", table(spark, sf_dir, "pages")
    warc.write(spark, pages, path, "page_id", "html", "url", LEAST_REVISIT)
    found = Scratch(spark, "warc").save(warc.read(spark, path, payloads=False))
    key = lambda name: F.from_json(name, T.StructType([T.StructField("key", pages.schema["page_id"].dataType)]))["key"]
    return warc.resolve(spark, found).select(key("key").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), key("original").alias("refers_to"))


OP12_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), b AS (SELECT page_id, html, min(page_id) OVER (PARTITION BY html) AS first, list_transform(range(4), lambda g: CAST('0x' || h[10 * g + 1:10 * g + 10] AS UBIGINT)) AS v FROM p)
SELECT page_id, strlen(html) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST((v[i // 8 + 1] >> (35 - 5 * (i % 8))) & 31 AS BIGINT) + 1]), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    long = lambda name: F.char_length(name).cast("long").alias(f"{name}_chars")
    restored = F.sha2(fim.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return out.select("doc_id", "n", "form", long("prefix"), long("middle"), F.sha2("output", 256).alias("output_sha256"), restored)


#: Units by the grammar itself, pieces by places in the list of units.
OP13_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), u AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^
]*
|[^
]+') AS u, CAST('0x' || h[1:8] AS UBIGINT) AS h1, CAST('0x' || h[9:16] AS UBIGINT) AS h2,
    CAST('0x' || h[17:24] AS UBIGINT) AS h3, CAST('0x' || h[25:32] AS UBIGINT) AS h4 FROM t
), c AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, CAST(least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS BIGINT) AS low, CAST(greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS BIGINT) AS high,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (
  SELECT *, array_to_string(u[1:low], '') AS prefix, array_to_string(u[low + 1:high], '') AS middle, array_to_string(u[high + 1:n], '') AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""

QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_near_dedup, op3_mixing, op4_token_counts, op5_url_filter, op6_license_scan, op7_quality_classifier, op8_language_id, op9_bpe, op10_exact_dedup, op11_collocations, op12_warc, op13_fim)}

ORACLE_SQL = {"op2_near_dedup": OP2_SQL, "op5_url_filter": OP5_SQL, "op6_license_scan": OP6_SQL, "op10_exact_dedup": OP10_SQL, "op11_collocations": OP11_SQL, "op12_warc": OP12_SQL, "op13_fim": OP13_SQL}
