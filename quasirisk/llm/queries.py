"""Registered queries of the subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quasirisk.llm import chat
from quasirisk.llm.align import align_documents, score_links
from quasirisk.llm.classifier import quality_scores
from quasirisk.llm.decontaminate import find_leaks
from quasirisk.llm.hmm import score_texts
from quasirisk.llm.mixing import mix_sources
from quasirisk.llm.negatives import hard_negatives
from quasirisk.llm.packing import pack_documents
from quasirisk.llm.pii import find_pii
from quasirisk.llm.quality_rules import quality_verdicts
from quasirisk.llm.secrets import scan_secrets
from quasirisk.llm.simhash import near_duplicates
from quasirisk.llm.substring import remove_repeats

PACK_TOKENIZER = "word_bpe_49k.json"
SCAN_RANKS = "byte_bpe_50k.tiktoken"
ALIGN_BYTES, ALIGN_PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(PACK_TOKENIZER))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), folds=10)


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), width=50)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of ``conversations`` is the event that starts the message of its turn."""
    mark = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-7, 0, "user", mark), (-7, 1, "assistant", mark)], "conv_id long, turn long, role string, text string"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    # Rows with equal turns stay turns of their own.
    same = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    events = rows.withColumn("message", F.struct("turn", F.row_number().over(same).alias("copy")))
    events = events.withColumns({"seq": F.lit(0), "kind": F.lit("message")})
    chats = chat.format_chats(events)
    turns = F.transform(chat.read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    chats = chats.withColumns({
        "turns_": turns, "loss_": chat.read_loss(F.col("formatted"), F.col("loss_spans")),
    })
    return chats.select(
        "conv_id", F.size("turns_").cast("long").alias("n_turns"),
        F.sha2(F.array_join("turns_", "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_").cast("long").alias("loss_chars"), F.sha2(F.col("loss_").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"), public_tokenizers.path(SCAN_RANKS))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=5, threshold=0.3)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of every seventh id is moved on by one first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), anchor_every=100, positives=5, negatives=5)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = align_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path(ALIGN_BYTES), public_tokenizers.path(ALIGN_PIECES)
    )
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return score_links(aligned.withColumn("groups_sha256", digest).drop("groups"))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), weights=(1, 2, 3), limit=3)


QUERIES = {
    "op1_packing": op1_packing,
    "op2_decontamination": op2_decontamination,
    "op3_quality_rules": op3_quality_rules,
    "op4_pii": op4_pii,
    "op5_simhash": op5_simhash,
    "op6_language_model": op6_language_model,
    "op7_substring": op7_substring,
    "op8_chat": op8_chat,
    "op9_secrets": op9_secrets,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_alignment": op12_alignment,
    "op13_source_mix": op13_source_mix,
}

OP8_SQL = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), turns AS (
  SELECT conv_id, turn, role, text, CASE WHEN role = 'assistant' THEN text ELSE '' END AS learnt,
         length(role) + length(text) + length('<|turn|><|body|><|end|>')
         + length(role || text) - length(replace(role || text, '<', '')) AS chars
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(length(learnt)) AS BIGINT) AS loss_chars,
       sha256(string_agg(learnt, '' ORDER BY turn, role, text)) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""

OP11_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.vec_id AS negative_id,
       positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 80 * positive_score <= 100 * n.score AND 100 * n.score <= 100 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.vec_id)
QUALIFY row_number() OVER w <= 5"""

ORACLE_SQL: dict[str, str] = {"op8_chat": OP8_SQL, "op11_hard_negatives": OP11_SQL}
