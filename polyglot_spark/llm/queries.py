"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import chroma, ctw, embeddings, html_text, manifest, mixing, packing, resampling, secrets, simhash, substrings, token_counts, toxicity
from . import oracles
from .common import remainder, table


def op1_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(table(spark, sf_dir, "documents"))


def op2_crf_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_debruijn_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), texts=False)


def op4_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_curriculum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the training positions of both copies, null where the mix does not take one."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    mixed = mixed.withColumns({f"position_{k}": F.round(F.get("positions", F.lit(k - 1)), 9) for k in (1, 2)})
    return mixing.in_training_order(mixed, "position_1").select("doc_id", "size", "source_size", "target", "taken", "position_1", "position_2")


def op6_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.fit_on(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


def op8_int8_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_chroma_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no audio, so each turn of ``conversations`` is played word by word and fingerprinted."""
    turns = table(spark, sf_dir, "conversations")
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    recordings = turns.select(F.concat(part("conv_id"), F.lit(":"), part("turn")).alias("rec_id"), "text")
    return chroma.group_recordings(recordings, "text", chroma.tones)


def op10_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_by_section(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return manifest.verified(docs, manifest.lowered(F.col("doc_id"), F.col("text")))


def op12_token_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(table(spark, sf_dir, "documents"), carry=["doc_id"])
    count = lambda kind: F.size(secrets.of_kind("spans", kind)).cast("long").alias(f"n_{kind}")
    base = F.sha2(secrets.listed(secrets.of_kind("spans", "assign", "access", "hex")), 256)
    return found.select("doc_id", count("assign"), count("access"), count("hex"), base.alias("base_sha256"), secrets.listed("spans").alias("spans"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_context_tree": op1_context_tree,
        "op2_crf_html": op2_crf_html,
        "op3_debruijn_substrings": op3_debruijn_substrings,
        "op4_pattern_packing": op4_pattern_packing,
        "op5_curriculum_mixing": op5_curriculum_mixing,
        "op6_simhash_gray": op6_simhash_gray,
        "op7_crf_toxicity": op7_crf_toxicity,
        "op8_int8_tiles": op8_int8_tiles,
        "op9_chroma_audio": op9_chroma_audio,
        "op10_section_tokens": op10_section_tokens,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_token_secrets": op12_token_secrets,
        "op13_importance_resampling": op13_importance_resampling,
    }


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS size,
         substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15) AS key
  FROM documents),
s AS (
  SELECT source, sum(size)::DOUBLE AS source_size,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM d GROUP BY source),
r AS (
  SELECT *, 2 * source_size AS most,
         sum(2 * source_size) OVER w - 2 * source_size AS held,
         sum(weight) OVER () - (sum(weight) OVER w - weight) AS open_weight,
         1.5 * sum(source_size) OVER () AS total
  FROM s WINDOW w AS (ORDER BY 2 * source_size / weight, source ROWS UNBOUNDED PRECEDING)),
l AS (SELECT arg_min((total - held) / open_weight, most / weight) FILTER (weight * ((total - held) / open_weight) <= most) AS level FROM r),
t AS (SELECT source, weight, source_size, least(most, weight * coalesce(level, 0)) AS target FROM r, l),
b AS (
  SELECT d.*, t.source_size, t.target, CASE t.weight WHEN 5 THEN 1.5::DOUBLE WHEN 2 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS rate,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS UNBOUNDED PRECEDING) - d.size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target,
       (size * ((before + size / 2.0 < target)::INT + (source_size + before + size / 2.0 < target)::INT))::BIGINT AS taken,
       -- the rate falls or rises evenly from `rate` to 2 - `rate`; these are the times at which its integral reaches the demand u
       CASE WHEN before + size / 2.0 < target THEN round(2 * u1 / (rate + sqrt(greatest(0.0, rate * rate + 2 * (2 - 2 * rate) * u1))), 9) END AS position_1,
       CASE WHEN source_size + before + size / 2.0 < target THEN round(2 * u2 / (rate + sqrt(greatest(0.0, rate * rate + 2 * (2 - 2 * rate) * u2))), 9) END AS position_2
FROM (SELECT *, (before + size / 2.0)::DOUBLE / target AS u1, (source_size + before + size / 2.0)::DOUBLE / target AS u2 FROM b)
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_curriculum_mixing": OP5_SQL, "op11_merkle_manifest": oracles.OP11, "op13_importance_resampling": oracles.OP13}
