"""The queries of this subpackage, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, dropout, kdtree, language, quality, simhash, substrings, token_counts, warc
from .common import prepare, read, written


def op1_kdtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, rank, vec_id, score) over all of embeddings; vectors with nulls or infinite components take no part, ties go
    to the smaller vec_id. For repeated ids see kdtree.top_k."""
    return kdtree.top_k(read(prepare(spark), sf_dir, "embeddings"), k=20, every=20)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of documents; null, empty and blank texts have fingerprint 0 and link
    like any other, repeated rows come back as often, and a null doc_id links nothing."""
    found = simhash.near_duplicates(read(prepare(spark), sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of documents; `und` with score 0 for null texts and texts without a
    letter, ties to the language first in order, a null doc_id held out."""
    docs = read(prepare(spark), sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.learn(docs.where(~language.held_out()))
    found = language.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of documents; a null text counts as an empty one, repeated rows
    count each time, a null doc_id stays null."""
    return token_counts.count_tokens(read(prepare(spark), sf_dir, "documents"))


def op5_sentencepiece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, token_ids, n_tokens, text_sha256, lossless) for every row of documents; null and empty texts have no tokens,
    repeated rows the same ones."""
    return dropout.round_trip(read(prepare(spark), sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) for every row of pages, read back through the index;
    null html is an empty payload, a null url has an empty key, and of equal payloads the largest page_id is the response."""
    pages = read(prepare(spark), sf_dir, "pages").select("page_id", "url", "html")
    _, directory = warc.write(pages)
    captures = warc.lookup(directory, warc.keys_of(pages))
    return warc.records(captures).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word) for each document and benchmark item that it holds, over all documents;
    null and empty texts hold nothing, repeated rows are found each time."""
    docs = read(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    return decontaminate.find_leaks(docs, read(spark, sf_dir, "benchmark"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of documents; null and empty texts have no words, and rows of
    one doc_id, or without one, take nothing from each other."""
    docs = read(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    return substrings.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, expected_grade, p_good, p_clean, keep) for every row of documents; a null text is judged as an empty one, and
    without labels everything is kept."""
    docs = read(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs, model).withColumn("keep", F.col("p_good") >= quality.LEAST)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) for every conversation and -1; null roles and
    texts are empty ones, and turns that tie go by role, then text."""
    turns = read(prepare(spark), sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    formatted = written(chat.format_chats(turns.unionByName(more)), "chats")
    return chat.read_back(formatted)


QUERIES = {
    "op1_kdtree_top_k": op1_kdtree_top_k,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_language_id": op3_language_id,
    "op4_token_counts": op4_token_counts,
    "op5_sentencepiece_dropout": op5_sentencepiece_dropout,
    "op6_warc": op6_warc,
    "op7_decontaminate": op7_decontaminate,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_quality": op9_quality,
    "op10_chat_format": op10_chat_format,
}
ORACLES: dict[str, str] = {
    "op1_kdtree_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)::BIGINT) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
        )
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
        FROM s QUALIFY rank <= 20
    """,
    "op6_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS kept FROM pages
        ), b AS (
            SELECT *, array_to_string(list_transform(range(1, 41), lambda k: lpad(bin(strpos('0123456789abcdef', sha[k]) - 1), 4, '0')), '') AS bits FROM p
        ), d AS (
            SELECT *, array_to_string(list_transform(range(0, 32), lambda k: ('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')[
                1 + 16 * bits[5 * k + 1]::INT + 8 * bits[5 * k + 2]::INT + 4 * bits[5 * k + 3]::INT + 2 * bits[5 * k + 4]::INT + bits[5 * k + 5]::INT]), '') AS digest FROM b
        )
        SELECT page_id, strlen(html) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> kept THEN kept END AS refers_to FROM d
    """,
    "op8_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
        ), w AS (
            SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS seq FROM d, unnest(range(1, len(words) - 11)) AS t(i)
        ), hit AS (
            SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY seq) AS least FROM w) WHERE least < doc_id
        ), gone AS (
            SELECT doc_id, list(DISTINCT i + k) AS gaps FROM hit, unnest(range(0, 13)) AS t(k) GROUP BY doc_id
        ), kept AS (
            SELECT doc_id, len(words) AS n_words, coalesce(len(gaps), 0) AS n_removed,
                list_filter(words, lambda x, k: gaps IS NULL OR NOT list_contains(gaps, k)) AS stay
            FROM d LEFT JOIN gone USING (doc_id)
        )
        SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(array_to_string(stay, ' ')) AS kept_sha256 FROM kept
    """,
    "op10_chat_format": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
        ), s AS (
            SELECT *, length(role) + length(text) + 9
                + len(regexp_extract_all(role, '<\\*/?s>|\[\\*/?INST\]|<\\*</?SYS>>'))
                + len(regexp_extract_all(text, '<\\*/?s>|\[\\*/?INST\]|<\\*</?SYS>>')) AS chars FROM t
        ), g AS (
            SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS every,
                coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss, sum(chars)::BIGINT AS formatted_chars
            FROM s GROUP BY conv_id
        )
        SELECT conv_id, n_turns, sha256(every) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
    """,
}
