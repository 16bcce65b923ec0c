"""The queries of this subpackage, each (spark, folder of tables) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quern.llm import audio, bpe, chat, lines, packing, quality, rollups, simhash, suffixes, urls
from quern.llm.common import new_folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").union(extra))


def op2_chroma_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """The tables hold no audio, so each embedding is played as a tone for each of its values."""
    return audio.search(table(spark, folder, "embeddings"), "vec_id", "embedding", audio.sonify)


def op3_simhash_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.digests(table(spark, folder, "documents"))


def op4_hilbert_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), pattern=public_tokenizers.PATTERN)


def op5_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    coder = bpe.ByteBpe(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.digests(table(spark, folder, "documents"), coder)


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.verdicts(table(spark, folder, "documents")).drop("class_distance", "word_distance")


def op7_token_rollups(spark: SparkSession, folder: str) -> DataFrame:
    coder = bpe.ByteBpe(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return rollups.retokenized(table(spark, folder, "documents"), new_folder(spark, "token-rollup"), coder)


def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.digests(table(spark, folder, "documents"))


def op9_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.verdicts(table(spark, folder, "pages"))


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All documents go in, out and in again: the result is that of having gone in once."""
    documents = table(spark, folder, "documents")
    index = lines.LineIndex(spark, new_folder(spark, "line-index"), shards=lines.LineIndex.shards_for(documents))
    index.commit("all in", inserts=documents)
    index.commit("all out", deletes=documents)
    index.commit("all in again", inserts=documents)
    return lines.digests(index, documents)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_format,
        op2_chroma_fingerprints,
        op3_simhash_near_duplicates,
        op4_hilbert_packing,
        op5_byte_bpe,
        op6_quality_rules,
        op7_token_rollups,
        op8_suffix_dedup,
        op9_url_filter,
        op10_line_dedup,
    )
}

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
#: The others can't be put in SQL (BPE, XXH64 with a seed, trained models, sequences of one's own choice).
ORACLE_SQL: dict[str, str] = {
    "op1_chat_format": r"""
        WITH said AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ), sized AS (
            SELECT *, 14 + length(role) + length(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'))
                + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0) AS chars FROM said
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
            sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
            CAST(sum(chars) AS BIGINT) AS formatted_chars
        FROM sized GROUP BY conv_id""",
    "op6_quality_rules": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, lang FROM documents),
        cut AS (
            SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
                list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
        ), m AS (
            SELECT r, doc_id, text, lang, words, len(words) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
                length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
                length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) AS upper, length(regexp_replace(text, '[^\p{{Nd}}]', '', 'g')) AS digits,
                length(regexp_replace(text, '[^\p{{P}}\p{{S}}]', '', 'g')) - length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS marks FROM cut
        ), placed AS (SELECT r, words, unnest(range(1, n_words - 1)) AS i FROM m WHERE n_words > 3),
        grams AS (SELECT r, i, count(*) OVER (PARTITION BY r, words[i], words[i + 1], words[i + 2]) AS n FROM placed),
        covered AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM grams, (VALUES (0), (1), (2)) AS t(k) WHERE n > 1 GROUP BY r),
        own AS (SELECT lang FROM m WHERE lang IS NOT NULL GROUP BY lang HAVING sum(n_words) >= {quality.LANGUAGE_WORDS}),
        keyed AS (SELECT m.*, length(text) AS chars, own.lang IS NULL AS pooled, own.lang AS ref FROM m LEFT JOIN own ON m.lang = own.lang),
        seen AS (SELECT * FROM keyed WHERE NOT pooled UNION ALL SELECT * REPLACE (TRUE AS pooled, NULL AS ref) FROM keyed),
        totals AS (
            SELECT pooled, ref, sum(n_words) AS n, sum(upper) / sum(chars) AS u, sum(digits) / sum(chars) AS g, sum(n_symbols) / sum(chars) AS y,
                sum(chars - word_chars) / sum(chars) AS s, sum(marks) / sum(chars) AS p, sum(word_chars - n_symbols - upper - digits - marks) / sum(chars) AS o FROM seen GROUP BY pooled, ref
        ), spoken AS (SELECT r, pooled, ref, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS word FROM seen),
        counts AS (SELECT pooled, ref, word, count(*) AS n FROM spoken GROUP BY pooled, ref, word),
        top AS (SELECT c.pooled, c.ref, word, c.n / t.n AS q FROM counts c JOIN totals t ON c.pooled = t.pooled AND c.ref IS NOT DISTINCT FROM t.ref WHERE 1000 * c.n >= {quality.COMMON_PERMILLE} * t.n),
        mine AS (SELECT s.r, word, count(*) AS n FROM spoken s JOIN keyed k ON s.r = k.r AND s.pooled = k.pooled GROUP BY s.r, word),
        shares AS (SELECT k.r, coalesce(mine.n, 0) / k.n_words AS p, top.q FROM keyed k JOIN top ON top.pooled = k.pooled AND top.ref IS NOT DISTINCT FROM k.ref LEFT JOIN mine ON mine.r = k.r AND mine.word = top.word WHERE k.n_words >= 50),
        pairs AS (SELECT r, p, q FROM shares UNION ALL SELECT r, greatest(0, 1 - sum(p)), greatest(0, 1 - sum(q)) FROM shares GROUP BY r),
        shaped AS (SELECT r, unnest([upper, digits, n_symbols, chars - word_chars, marks, word_chars - n_symbols - upper - digits - marks]) / chars AS p, unnest([u, g, y, s, t.p, o]) AS q FROM keyed k JOIN totals t ON k.pooled = t.pooled AND k.ref IS NOT DISTINCT FROM t.ref WHERE chars >= 200),
        far AS (
            SELECT r FROM (SELECT r, p, q, 0.35 AS most FROM pairs UNION ALL SELECT r, p, q, 0.30 FROM shaped) GROUP BY r, most
            HAVING sqrt(greatest(0, sum((CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2))) > most
        ), judged AS (
            SELECT m.*, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM m LEFT JOIN covered USING (r)
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
            NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND r NOT IN (SELECT r FROM far) AS kept
        FROM judged""",
    "op10_line_dedup": f"""
        WITH split AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        numbered AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM split),
        keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_LOWER}) AS key FROM numbered),
        common AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
        marked AS (SELECT k.*, c.key IS NOT NULL AS dropped FROM keyed k LEFT JOIN common c ON k.key = c.key)
        SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
        FROM marked GROUP BY r""",
}
