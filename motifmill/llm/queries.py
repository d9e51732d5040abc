"""The queries op1 to op13 and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_repair, merkle, quality_classifier, quality_rules
from .chat import format_conversations
from .common import table
from .exact_dedup import exact_dedup
from .line_dedup import line_dedup
from .lm_scoring import score_documents
from .merkle_sql import SQL as MERKLE_SQL
from .packing import pack
from .sentencepieces import round_trip
from .simhash import near_duplicates
from .warc import archive_pages


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_deleted")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.classify(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.apply_rules(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_conversations(spark, sf_dir)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), found={"text": merkle.tampered(F.col("doc_id"), F.col("text"))})


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return chat_repair.repair(chat_repair.damaged(conversations), conversations)


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op6_exact_dedup": op6_exact_dedup,
    "op1_simhash": op1_simhash,
    "op2_line_dedup": op2_line_dedup,
    "op5_quality_classifier": op5_quality_classifier,
    "op4_quality_rules": op4_quality_rules,
    "op3_packing": op3_packing,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_warc": op9_warc,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_bpe": op13_bpe,
}

ORACLE_SQL: dict[str, str] = {
    "op11_merkle_manifest": MERKLE_SQL,
    "op6_exact_dedup": """
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
        FROM (SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
                     count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
                     sha256(coalesce(text, '')) AS text_sha256
              FROM documents)""",
    "op9_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
             q AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS top FROM p)
        SELECT page_id, n AS payload_bytes, digest AS payload_digest,
               CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to
        FROM q""",
    "op2_line_dedup": r"""
        WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
             l AS (SELECT doc_id, i, ls[i + 1] AS line, len(regexp_extract_all(ls[i + 1], '[^\x20\x09-\x0D]+')) AS w FROM d, unnest(range(0, len(ls))) t(i)),
             c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM l),
             runs AS (SELECT a.doc_id, a.i AS s, b.i AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.i <= b.i AND b.upto - a.upto + a.w >= 50),
             f AS (SELECT doc_id, s, min(e) AS e FROM runs GROUP BY doc_id, s UNION SELECT doc_id, max(s), e FROM runs GROUP BY doc_id, e),
             k AS (SELECT doc_id, s, e, array_to_string(ls[s + 1 : e + 1], chr(10)) AS run FROM f JOIN d USING (doc_id)),
             m AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, s) > 1 AS later FROM k),
             g AS (SELECT DISTINCT doc_id, i FROM m, unnest(range(s, e + 1)) t(i) WHERE later),
             kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM l WHERE (doc_id, i) NOT IN (SELECT (doc_id, i) FROM g) GROUP BY doc_id),
             gone AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id)
        SELECT doc_id, coalesce(kept.text, '') AS text, len(ls)::BIGINT AS n_lines, coalesce(gone.n, 0) AS n_deleted
        FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)""",
}
