"""Driver queries of the training-data operators, and their DuckDB SQL.

Every query applies its operator with production parameters to the whole
table. Where SQL cannot express an operator, ``tests/llm`` holds it against a
brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from daybars.llm import (
    ann,
    arc_warc,
    chat,
    decontam,
    fim,
    fingerprints,
    kn_quality,
    langid,
    license_scan,
    mixing,
    periodic,
    pii,
    simhash_dedup,
)
from daybars.llm.common import read_table
from daybars.session import scratch_dir


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and labels of every document."""
    return license_scan.report(read_table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.report(read_table(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of every document and its edited text."""
    return fingerprints.report(read_table(spark, sf_dir, "documents"))


def op4_arc_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as ARC, converted to WARC, read back."""
    return arc_warc.report(read_table(spark, sf_dir, "pages"), scratch_dir(spark, "arc"), scratch_dir(spark, "warc"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity and verdict of every document."""
    return kn_quality.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return langid.report(read_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    return decontam.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    rows = simhash_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, formatted and read back."""
    text = "</s>[INST] ok [/INST]"
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(
        F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    return chat.report(rows.unionByName(extra.select(*[F.col(c).cast(kind) for c, kind in rows.dtypes])))


def op11_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth vector."""
    return ann.report(read_table(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in every document."""
    return periodic.report(read_table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document rearranged for fill-in-middle training, and restored."""
    return fim.report(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_license_scan, op2_pii, op3_fingerprints, op4_arc_warc, op5_mixing, op6_quality,
                            op7_langid, op8_decontamination, op9_simhash_dedup, op10_chat, op11_ann,
                            op12_periodic_runs, op13_fill_in_middle)
} | {"pipeline": corpus_pipeline.run}

_OP4 = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> least THEN least END AS refers_to,
  CAST(NULL AS VARCHAR) AS error
FROM q
"""

_OP8 = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sizes AS (SELECT item_id, w, least(len(w), 10) AS k FROM bw WHERE len(w) > 0),
grams AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT item_id, w, k, unnest(range(1, (len(w) - k + 2)::BIGINT)) AS i FROM sizes)),
lengths AS (SELECT DISTINCT k FROM sizes),
places AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, (len(w) - k + 2)::BIGINT)) AS i FROM dw, lengths WHERE len(w) >= k)),
hits AS (SELECT p.doc_id, p.i, p.k, g.item_id FROM places p JOIN grams g USING (k, g)),
words AS (
  SELECT doc_id, count(DISTINCT pos)::BIGINT AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP10 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (
  SELECT *, replace(replace(replace(replace(replace(replace(replace(replace(text, '\', '\\'), '<|', '<\|'),
    '</s>', '<\/s>'), '<s>', '<\s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '<<SYS>>', '<\<SYS>>'),
    '<</SYS>>', '<\</SYS>>') AS safe FROM c),
g AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
    sum(12 + length(role) + 1 + length(safe) + 11)::BIGINT AS formatted_chars,
    regexp_full_match(string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a'
      ELSE 'x' END, '' ORDER BY turn, role, text), 's?(ua)+') AS valid
  FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
  formatted_chars, valid FROM g
"""

_OP13 = r"""
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
    sha256('7:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
r AS (
  SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS h1, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS h2,
    ('0x' || h[17:24])::BIGINT % 100 AS h3, ('0x' || h[25:32])::BIGINT % 100 AS h4 FROM u),
c AS (
  SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 100 THEN 'plain'
      WHEN h4 < 50 THEN 'spm' ELSE 'psm' END AS form,
    coalesce(array_to_string(u[1:least(h1, h2)], ''), '') AS p,
    coalesce(array_to_string(u[least(h1, h2) + 1:greatest(h1, h2)], ''), '') AS m,
    coalesce(array_to_string(u[greatest(h1, h2) + 1:n], ''), '') AS s FROM r)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM c
"""

ORACLES: dict[str, str] = {"op4_arc_warc": _OP4, "op8_decontamination": _OP8, "op10_chat": _OP10,
                           "op13_fill_in_middle": _OP13}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
