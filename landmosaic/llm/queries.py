"""The queries of this subpackage: each applies an operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, conversation_repair, decontam, html_text, lang_id, piece_codec, simhash_dedup, suffix_dedup, token_files, url_filter, warc, whitening
from .common import table
from .exact_dedup import exact_groups


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identified(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op3_token_files(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    folder = token_files.encode_corpus(table(spark, sf_dir, "documents"), path or public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.digests(token_files.read(spark, folder))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.cut(table(spark, sf_dir, "documents")))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.rotated(table(spark, sf_dir, "conversations"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digests(warc.archived(table(spark, sf_dir, "pages")))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash_dedup.near_groups(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_piece_codec(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return piece_codec.digests(piece_codec.encode_texts(table(spark, sf_dir, "documents"), path or public_tokenizers.path("piece_bpe_32k.model")))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_repair.damaged(table(spark, sf_dir, "conversations"))
    return conversation_repair.audited(turns, gone=F.col("gone"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_lang_id": op2_lang_id,
    "op3_token_files": op3_token_files,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_chat_format": op5_chat_format,
    "op6_warc": op6_warc,
    "op7_simhash_dedup": op7_simhash_dedup,
    "op8_html_text": op8_html_text,
    "op9_decontam": op9_decontam,
    "op10_piece_codec": op10_piece_codec,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_url_filter": op13_url_filter,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": """
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM n
    """,
    "op6_warc": """
        WITH n AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
        f AS (SELECT page_id, h, d, min(page_id) OVER (PARTITION BY h) AS first FROM n),
        bits AS (SELECT *, array_to_string(list_transform(string_split(d, ''), lambda x:
            ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][instr('0123456789abcdef', x)]), '') AS b FROM f)
        SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   CAST(1 + list_sum(list_transform(range(5), lambda k: CAST(substr(b, CAST(i * 5 + k + 1 AS BIGINT), 1) AS INTEGER) * (16 >> CAST(k AS INTEGER)))) AS BIGINT), 1)), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM bits
    """,
    "op5_chat_format": """
        WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS name, coalesce(text, '') AS said, row_number() OVER () AS uid FROM conversations),
        p AS (SELECT DISTINCT conv_id, name AS perspective FROM t WHERE name <> 'system'),
        r AS (SELECT t.*, p.perspective, CASE WHEN name = 'system' THEN 'system' WHEN name = perspective THEN 'assistant' ELSE 'user' END AS chat_role
              FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
        h AS (SELECT *, CASE WHEN chat_role = 'user' THEN concat('<|user name=',
              regexp_replace(regexp_replace(name, '<(\\\\*)(\\||\\z)', '<\\\\\\1\\2', 'g'), '\\|(\\\\*)>', '|\\\\\\1>', 'g'), '|>', chr(10)) ELSE concat('<|', chat_role, '|>', chr(10)) END AS head FROM r),
        s AS (SELECT *, concat(head, regexp_replace(said, '<(\\\\*)\\|', '<\\\\\\1|', 'g'), '<|end|>', chr(10)) AS segment FROM h),
        w AS (SELECT *, sum(length(segment)) OVER o AS "end", row_number() OVER o AS position FROM s
              WINDOW o AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, name, said, uid ROWS UNBOUNDED PRECEDING))
        SELECT conv_id, perspective, position, turn, chat_role, name, segment, CAST("end" - length(segment) AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end",
               CAST(CASE WHEN chat_role = 'assistant' THEN "end" - length(segment) + length(head) END AS BIGINT) AS mask_start,
               CAST(CASE WHEN chat_role = 'assistant' THEN "end" - 1 END AS BIGINT) AS mask_end
        FROM w
    """,
    "op11_conversation_repair": r"""
        WITH RECURSIVE src AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS name FROM conversations),
        bits AS (SELECT *, flatten([[CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(name, ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))]) AS b FROM src),
        crc AS (SELECT *, xor(CAST(4294967295 AS BIGINT), list_reduce(b, lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, CAST(3988292384 AS BIGINT) * (c & 1)) END)) % 20 AS fault FROM bits),
        damaged AS (
            SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM crc),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos,
                   row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again, substr(role, 1, 1) AS initial FROM damaged),
        judged AS (
            SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS before,
                   CASE WHEN regexp_replace(text, '[\x20\x09-\x0D]', '', 'g') = '' THEN 'blank' WHEN again > 1 THEN 'duplicate'
                        WHEN right(rtrim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed),
        ins(state, dest, cost, letters, added) AS (VALUES
            (0, 0, 0, '', ''), (0, 2, 5, 'I', concat(chr(10), 'user:')), (0, 3, 10, 'II', concat(chr(10), 'user:', chr(10), 'assistant:')),
            (1, 1, 0, '', ''), (1, 2, 5, 'I', concat(chr(10), 'user:')), (1, 3, 10, 'II', concat(chr(10), 'user:', chr(10), 'assistant:')),
            (2, 2, 0, '', ''), (2, 3, 5, 'I', concat(chr(10), 'assistant:')), (3, 3, 0, '', ''), (3, 2, 5, 'I', concat(chr(10), 'user:'))),
        edit(state, dest, letter, initial, name, cost) AS (VALUES
            (0, 0, 'D', NULL, NULL, 2), (1, 1, 'D', NULL, NULL, 2), (2, 2, 'D', NULL, NULL, 2), (3, 3, 'D', NULL, NULL, 2),
            (0, 1, 'K', 's', NULL, 0), (0, 2, 'K', 'u', NULL, 0), (1, 2, 'K', 'u', NULL, 0), (3, 2, 'K', 'u', NULL, 0), (2, 3, 'K', 'a', NULL, 0),
            (0, 2, 'R', NULL, 'user', 1), (1, 2, 'R', NULL, 'user', 1), (3, 2, 'R', NULL, 'user', 1), (2, 3, 'R', NULL, 'assistant', 1)),
        steps(conv_id, pos, state, cost, audit, said) AS (
            SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 0, 0, '', '' FROM conversations
            UNION ALL
            SELECT conv_id, pos, state, cost, audit, said FROM (
                SELECT p.conv_id, j.pos, e.dest AS state, p.cost + i.cost + e.cost + CASE WHEN e.letter <> 'D' AND j.fault = 'truncated' THEN 5 ELSE 0 END AS cost, concat(p.audit, i.letters, e.letter) AS audit,
                       concat(p.said, i.added, CASE WHEN e.letter <> 'D' THEN concat(chr(10), coalesce(e.name, j.role), ':', j.text) ELSE '' END) AS said
                FROM steps p JOIN ins i ON i.state = p.state JOIN edit e ON e.state = i.dest JOIN judged j ON j.conv_id IS NOT DISTINCT FROM p.conv_id AND j.pos = p.pos + 1
                WHERE (e.letter = 'D' OR j.fault NOT IN ('blank', 'duplicate')) AND (e.initial IS NULL OR e.initial = j.initial))
            QUALIFY row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) = 1),
        sizes AS (
            SELECT c.conv_id, count(j.pos) AS n, coalesce(max(j.turn) - min(j.turn) + 1 - count(DISTINCT j.turn), 0) AS gaps, count_if(j.fault = 'blank') AS blank, count_if(j.fault = 'duplicate') AS duplicate, count_if(j.fault = 'truncated') AS truncated,
                   count_if(j.pos > 1 AND concat(j.before, j.initial) NOT IN ('su', 'ua', 'au')) AS illegal
            FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY c.conv_id),
        ended AS (
            SELECT z.*, p.cost + i.cost AS cost, concat(p.audit, i.letters) AS audit, concat(p.said, i.added) AS said FROM sizes z JOIN steps p ON p.conv_id IS NOT DISTINCT FROM z.conv_id AND p.pos = z.n JOIN ins i ON i.state = p.state AND i.dest IN (0, 3)
            QUALIFY row_number() OVER (PARTITION BY z.conv_id ORDER BY p.cost + i.cost, concat(p.audit, i.letters)) = 1)
        SELECT conv_id, CAST(gaps AS BIGINT) AS gaps, CAST(blank AS BIGINT) AS blank, CAST(duplicate AS BIGINT) AS duplicate, CAST(truncated AS BIGINT) AS truncated, CAST(illegal AS BIGINT) AS illegal,
               CAST(cost AS BIGINT) AS cost, audit, sha256(substr(said, 2)) AS repaired_sha256 FROM ended
    """,
}
