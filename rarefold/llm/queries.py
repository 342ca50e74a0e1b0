"""The registered queries of this subpackage, with DuckDB SQL where SQL can
express them. ``QUERIES[name] = (fn(spark, sf_dir), sql or None)``."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import (alignment, decontam, dedup, interaction, jaccard, licenses, packing, quality, repeats, rules, toxicity, urlfilter,
               warc)
from .common import LOWER, UPPER, table, text_batches

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            text_batches(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = (run, sql)
        return run
    return deco


#: Words in a host for which its pages' URLs are listed (fixed values of the query).
LISTED_WORDS = ["ads", "adult", "bets", "casino", "pills", "porn", "spam"]

_HOST = "lower(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1))"
_PATH = "regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
_FITS = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{0}}'".replace(
        "{0}", f"{h}{p}|{a}") for a, h, p in sorted(urlfilter.RULES, key=lambda r: -len(r[1] + r[2])))

SQL_OP3 = rf"""WITH p AS (SELECT page_id, url, {_HOST} AS host, {_PATH} AS path,
  '&' || regexp_extract(coalesce(url, ''), '(?s)^[^?#]*\?([^#]*)', 1) AS q FROM pages),
q AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(q, '&(utm_[a-z]+|ref)=[^&]*', '', 'g'), '^&+', '?'), '[?&]+$', '') AS query,
  CASE {_FITS} END AS fit FROM p),
c AS (SELECT page_id, host, path, split_part(fit, '|', 1) AS rule, split_part(fit, '|', 2) AS action,
  CASE WHEN contains(url, '://') THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '/+$', '') || query END AS canonical FROM q),
listed AS (SELECT DISTINCT canonical FROM c WHERE canonical IS NOT NULL AND regexp_matches(host, '{"|".join(LISTED_WORDS)}'))
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  rule IS NULL AND l.canonical IS NOT NULL AS listed
FROM c LEFT JOIN listed l ON c.canonical = l.canonical"""


@register("op3_url_filter", SQL_OP3)
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL against the rules, then against the list of URLs of
    hosts whose name holds a listed word."""
    pages = table(spark, sf_dir, "pages")
    listed = pages.where(urlfilter.host_of(F.col("url")).rlike("|".join(LISTED_WORDS))).select("url")
    return urlfilter.filter_urls(pages, listed)


SQL_OP8 = """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + ((('0x' || substr(h, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INTEGER, 1) FOR i IN range(32)], '') AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM m"""


@register("op8_warc", SQL_OP8)
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records, read back and assembled per capture."""
    path = scratch_path(spark, "warc")
    archive_id = warc.write_archive(table(spark, sf_dir, "pages"), path)
    captures = warc.assemble(warc.read_archive(spark, path, archive_id), with_payload=False)
    return captures.select(
        "metadata.page_id",
        F.coalesce("response.read_bytes", "metadata.payload_bytes").cast("long").alias("payload_bytes"),
        F.coalesce("response.read_digest", "response.digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"), "response.refers_to")


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SQL_OP5 = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
c AS (SELECT doc_id, w, len(w) AS n_words, coalesce(list_sum([length(x) FOR x IN w]), 0)::BIGINT AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters,
  [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^ 	-
]')] AS lines FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM c)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS n FROM g) WHERE n > 1),
v AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r, range(0, 5) t(o) GROUP BY doc_id),
m AS (SELECT c.doc_id, n_words, word_chars, n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  coalesce(v.n, 0) AS n_repeat_words, n_letters, n_upper FROM c LEFT JOIN v USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  {" OR ".join(f"({e})" for n, e in rules.RULES if n in rules.BASE)} AS base_failed,
  NOT ({" OR ".join(f"({e})" for n, e in rules.RULES if n in rules.POLICIES["clean-1"])}) AS kept,
  {" + ".join(f"CASE WHEN {e} THEN {1 << i} ELSE 0 END" for i, (n, e) in enumerate(rules.RULES))} AS fail_bits FROM m"""


@register("op5_quality_rules", SQL_OP5)
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule ledger of all documents under the policy ``clean-1``."""
    rows = rules.ledger(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       rules.fails("base-1").alias("base_failed"), (~rules.fails("clean-1")).alias("kept"),
                       "fail_bits")


@register("op2_best_fit_packing")
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents tokenised and packed into sequences of 4096 tokens."""
    import public_tokenizers
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@register("op7_substring_dedup")
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents in 20-word windows that start earlier, removed."""
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


@register("op4_jaccard_join")
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the component of their 5-gram Jaccard links."""
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


@register("op1_license_scan")
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and fuzzy notices in all documents."""
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


@register("op6_quality_classifier")
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by pairwise ranking learned from ``labels.quality``."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("good"))
    return quality.classify(table(spark, sf_dir, "documents"), labels)[0]


@register("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by toxic segments learned from ``labels.toxic``."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.classify(table(spark, sf_dir, "documents"), labels)[0]


@register("op9_decontamination")
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a window that is a benchmark item, and where."""
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), plain=True).drop("row_key")


SQL_OP11 = f"""WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)"""


@register("op11_exact_dedup", SQL_OP11)
def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the one of their equal texts that stays."""
    return dedup.duplicates(table(spark, sf_dir, "documents"))


SQL_OP12 = r"""WITH l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
m AS (SELECT part, [len(ws) < 100, 100 * len(list_distinct(ws)) < 80 * len(ws),
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t), regexp_matches(t, '[#$%&*|]'), doc_id > first] AS f,
  count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic
  FROM w LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT part, filter_order, step, ascii(substr(filter_order, step, 1)) - 64 AS own, f, n, n_good, n_toxic, f[own] AS fails,
  list_contains([f[ascii(substr(filter_order, i, 1)) - 64] FOR i IN range(1, step)], true) AS gone
  FROM m, o, (SELECT unnest(range(1, 6)) AS step)),
g AS (SELECT part, filter_order, step::INTEGER AS step, own, sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN gone AND fails THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN fails AND len([v FOR v IN f IF v]) = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN NOT gone AND fails THEN n_good ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN NOT gone AND fails THEN n_toxic ELSE 0 END)::BIGINT AS toxic_lost FROM s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, good_lost, toxic_lost, unique_fails,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM g"""


@register("op12_filter_interaction", SQL_OP12)
def op12_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents in all 120 orders, by language."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return interaction.audit(table(spark, sf_dir, "documents"), labels)


@register("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the common token ends and links of two tokenizers."""
    import public_tokenizers
    return alignment.alignments(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                public_tokenizers.path("piece_bpe_32k.model"))
