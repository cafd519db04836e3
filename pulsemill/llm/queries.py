"""Registered queries op1 to op13 and the pipeline, with SQL where SQL can say the same."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, conversations, decontaminate, exact_dedup, language, line_dedup, ngram_join, pieces, secrets, sharding, simhash, toxicity, url_filter
from .common import col

SHARD_BYTES = 16 << 20
#: A model file of a public tokenizer; read on the driver, its bytes travel with the tasks.
PIECE_MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_exact_dedup", r"""
WITH rows AS (SELECT doc_id, coalesce(length(text), 0) AS size,
                     sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS digest FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY size DESC, doc_id) AS place,
                  first_value(doc_id) OVER (PARTITION BY digest ORDER BY size DESC, doc_id) AS keep_id,
                  count(*) OVER (PARTITION BY digest) AS group_size FROM rows)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, digest AS text_sha256 FROM ranked""")
def op1(spark, folder):
    return exact_dedup.exact_dedup(table(spark, folder, "documents"))


@query("op2_sentencepiece")
def op2(spark, folder):
    return pieces.sample_segmentations(table(spark, folder, "documents"), pieces.load_model(PIECE_MODEL))


@query("op3_sharding", f"""
WITH rows AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS bytes,
                     CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) >> 2 AS hash FROM documents),
nodes AS (SELECT d AS depth, hash >> CAST(30 - d AS BIGINT) AS prefix, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS n
          FROM rows, range(0, 31) AS depths(d) GROUP BY 1, 2),
leaves AS (SELECT n.* FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix >> 1
           WHERE (n.bytes <= {SHARD_BYTES} OR n.n = 1) AND (n.depth = 0 OR (p.bytes > {SHARD_BYTES} AND p.n > 1)))
SELECT r.doc_id, CASE WHEN l.depth = 0 THEN '' ELSE lpad(bin(l.prefix), CAST(l.depth AS INTEGER), '0') END AS shard,
       CAST(l.depth AS INTEGER) AS depth, r.bytes, l.bytes AS shard_bytes, l.n AS shard_rows
FROM rows r JOIN leaves l ON l.prefix = r.hash >> CAST(30 - l.depth AS BIGINT)""")
def op3(spark, folder):
    return sharding.assign_shards(table(spark, folder, "documents"), SHARD_BYTES)


@query("op4_decontamination")
def op4(spark, folder):
    return decontaminate.find_passages(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def toxicity_grammar(spark: SparkSession, folder: str, docs: DataFrame) -> toxicity.Grammar:
    """Learned from the labels of the folds 1 to 4 of 5."""
    return toxicity.learn_grammar(docs, table(spark, folder, "labels"), language.crc_part(col("doc_id"), 5) != 0)


@query("op5_toxicity")
def op5(spark, folder):
    docs = table(spark, folder, "documents")
    scored = toxicity.score_toxicity(docs, toxicity_grammar(spark, folder, docs))
    held_out = language.crc_part(col("doc_id"), 5) == 0
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", "clauses")


@query("op6_simhash")
def op6(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents"))


_FITS = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'"
    for _, h, p in sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2])))
_VERDICTS = " ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for v, h, p in url_filter.RULES)


@query("op7_url_filter", f"""
WITH rests AS (SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) = 0 THEN ''
                                    ELSE substr(url, position('://' IN url) + 3) END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
ruled AS (SELECT *, CASE {_FITS} END AS rule FROM parts),
globbed AS (SELECT *, CASE WHEN rule IS NOT NULL THEN NULL
                           WHEN ends_with(host || path, '.exe') THEN '**.exe'
                           WHEN ends_with(host || path, '.zip') THEN '**.zip'
                           WHEN ends_with(path, '/wp-login.php') THEN '**/wp-login.php'
                           WHEN contains('.' || host, '.ads.') AND starts_with(path, '/') THEN '*.ads.*/**' END AS pattern FROM ruled)
SELECT page_id, host, path, rule, CASE {_VERDICTS} WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, pattern FROM globbed""")
def op7(spark, folder):
    return url_filter.judge_urls(table(spark, folder, "pages"))


@query("op8_language_id")
def op8(spark, folder):
    docs = table(spark, folder, "documents")
    held_out = language.crc_part(col("doc_id"), 4) == 2
    samples = language.sample_texts(docs.filter(~held_out))
    return language.identify_language(docs, samples).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op9_secret_scan")
def op9(spark, folder):
    found = secrets.scan_secrets(table(spark, folder, "documents"))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE_KINDS))
    return found.select("doc_id", *[count(k) for k in secrets.BASE_KINDS],
                        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query("op10_line_dedup")
def op10(spark, folder):
    return line_dedup.judge_lines(table(spark, folder, "documents"))


@query("op11_collocations", r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
lists AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS words FROM pieces),
sizes AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM lists GROUP BY lang),
grams AS (SELECT lang, array_to_string(words[i:i + m - 1], ' ') AS phrase, m FROM lists, range(1, 6) AS lengths(m),
                 LATERAL (SELECT unnest(range(1, len(words) - m + 2)) AS i)),
freq AS (SELECT lang, phrase, m, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
kept AS (SELECT c.* FROM freq c WHERE m > 1 AND NOT EXISTS (
           SELECT 1 FROM freq g WHERE g.lang = c.lang AND g.m > c.m AND g.f >= c.f AND contains(' ' || g.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (SELECT lang, phrase, f, string_split(phrase, ' ') AS ws, unnest(range(1, m)) AS k FROM kept),
scored AS (SELECT c.lang, c.phrase, c.f AS a, h.f AS l, t.f AS r, n, k,
                  CAST((CAST(1000 AS HUGEINT) * c.f * n) // (CAST(h.f AS HUGEINT) * t.f) AS BIGINT) AS score
           FROM cuts c JOIN sizes USING (lang)
           JOIN freq h ON h.lang = c.lang AND h.phrase = array_to_string(ws[1:k], ' ')
           JOIN freq t ON t.lang = c.lang AND t.phrase = array_to_string(ws[k + 1:], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest QUALIFY rank <= 2000""")
def op11(spark, folder):
    return collocations.mine_collocations(table(spark, folder, "documents"))


@query("op12_conversation_repair")
def op12(spark, folder):
    convs = table(spark, folder, "conversations")
    return conversations.repair_conversations(conversations.damage(convs), ids=convs.select("conv_id"))


@query("op13_ngram_join")
def op13(spark, folder):
    return ngram_join.near_documents(table(spark, folder, "documents"))
