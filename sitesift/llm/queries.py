"""Queries of the corpus operators, each over its whole table, and their SQL where there is one."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesift.llm import bpe_chunks, chat
from sitesift.llm.chat import format_conversations
from sitesift.llm.decontaminate import find_leaks
from sitesift.llm.host_rules import HOST_LIMIT, LEAST_WORDS, MEASURES, REPEAT_PERCENT, host_rules
from sitesift.llm.kd_shards import kd_shards
from sitesift.llm.language import identify_languages
from sitesift.llm.pfair import pfair_mix
from sitesift.llm.pii import KINDS, find_personal_data, spans_text
from sitesift.llm.prefix_trie import prefix_trie
from sitesift.llm.quality import quality_scores
from sitesift.llm.simhash import simhash_components
from sitesift.llm.spelling import LEAST_COUNT, LEAST_LENGTH, document_words, spelling_variants
from sitesift.llm.warc import archive_pages

SHARDS = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op2_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.select(
        "doc_id", F.explode("ids").alias("item_id"), "matched", "compared", "seeds", "first_word"
    )


def op3_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = kd_shards(table(spark, sf_dir, "documents"), SHARDS)
    return shards.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify_languages(rows).select(
        "doc_id", "held_out", "lang_pred", "score", "entropy", "rejected"
    )


def op5_field_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [
        (F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in KINDS
    ]
    return found.withColumn("base", base).select(
        "doc_id", *counts, F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules(table(spark, sf_dir, "documents")).select("doc_id", *MEASURES, "base_failed", "kept")


def op7_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfair_mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "block", "slot", "release", "deadline", "seq"
    )


def _read_back(frames):
    for frame in frames:
        rows = []
        for number, formatted, loss in zip(frame["conv_id"], frame["formatted"], frame["loss"], strict=True):
            turns = chat.parse(formatted)
            said = "".join(f"{role}\n{text}\n" for role, text, _, _ in turns)
            learned = "".join(chat.unescape(formatted[s["start"]: s["end"]]) for s in loss)
            rows.append((
                number, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned),
                hashlib.sha256(learned.encode()).hexdigest(), len(formatted),
            ))
        yield pd.DataFrame(rows, columns=[
            "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars",
        ]).astype({"conv_id": "Int64"})


def op8_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    clash = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    return format_conversations(turns.unionByName(clash)).mapInPandas(
        _read_back,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long",
    )


def op9_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents")).select(
        "doc_id", "fingerprint", "component_id"
    )


def op10_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _digests(path: str):
    def digest(batches):
        for batch in bpe_chunks.decoder(path)(batches):
            ids = batch.column("ids")
            at, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(np.diff(at), pa.int64()),
                pa.array([hashlib.sha256(values[a:b].tobytes()).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in batch.column("decoded").to_pylist()]),
            ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return digest


def op11_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoded = bpe_chunks.encode_documents(table(spark, sf_dir, "documents"), path)
    # The decoder and the digests in one pass, so that a task keeps one worker less.
    return encoded.mapInArrow(_digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op12_prefix_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op13_spelling_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(document_words(table(spark, sf_dir, "documents")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OP1_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""

OP6_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM w),
k AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2]) AS n FROM g),
c AS (SELECT rid, count(DISTINCT pos) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS pos FROM k WHERE n > 1) GROUP BY rid),
m AS (SELECT doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN c USING (rid)),
b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT)::DOUBLE AS bad FROM b GROUP BY source),
o AS (SELECT sum(bad) / sum(n) AS mean, sum(bad * bad / n) / sum(n) AS square, sum(n) AS n, count(*) AS hosts FROM h),
v AS (SELECT mean, n / hosts AS flat, greatest(square - mean * mean - mean * (1 - mean) * hosts / n, 0) AS between_hosts FROM o),
prior AS (SELECT mean, CASE WHEN between_hosts > 0 THEN greatest(mean * (1 - mean) / between_hosts - 1, 1) ELSE flat END AS strength FROM v),
verdict AS (SELECT source, (bad + mean * strength) / (n + strength) <= {HOST_LIMIT} AS good FROM h, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND good AS kept
FROM b JOIN verdict ON b.source IS NOT DISTINCT FROM verdict.source
"""

OP8_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
n AS (SELECT *, (length(text) - length(replace(text, '###', ''))) // 3 + (length(text) - length(replace(text, '</turn>', ''))) // 7 AS controls,
    length(text) - length(replace(text, '\', '')) AS slashes,
    contains(text, '\\') OR ends_with(text, '\') AS odd,
    contains(text, '\###') OR contains(text, '\</turn>') AS clash FROM t),
l AS (SELECT *, length(text) + CASE WHEN odd OR clash THEN controls + slashes ELSE controls END AS body FROM n)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(14 + length(role) + body)::BIGINT AS formatted_chars
FROM l GROUP BY conv_id
"""

def crc32_sql(codes: str) -> str:
    """CRC-32 of a list of bytes, bit by bit."""
    return f"""xor(4294967295, list_reduce(flatten(list_transform({codes}, lambda b: [b, 0, 0, 0, 0, 0, 0, 0])),
      lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1)), 4294967295::BIGINT))"""


_DIGITS = "list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)"
OP12_SQL = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {crc32_sql(_DIGITS)} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
b AS (SELECT c.conv_id, t.pos, role, text FROM c JOIN t ON t.conv_id = base AND t.pos < h
  UNION ALL SELECT c.conv_id, t.pos + 10, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos >= h),
r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS d, length(text) AS chars, sha256(length(role) || ':' || role || text) AS said FROM b),
p AS (SELECT conv_id, d, chars, list(said) OVER (PARTITION BY conv_id ORDER BY d) AS way FROM r UNION ALL SELECT conv_id, 0, 0, [] FROM c),
n AS (SELECT way, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM p GROUP BY way, d),
m AS (SELECT p.conv_id AS member, p.d, n.conv_id AS node FROM p JOIN n USING (way, d)),
e AS (SELECT node, m.d, sha256(string_agg(member::VARCHAR, ',' ORDER BY member)) AS ends_sha256
  FROM m JOIN (SELECT conv_id, max(d) AS d FROM p GROUP BY conv_id) l ON l.conv_id = member AND l.d = m.d GROUP BY node, m.d),
q AS (SELECT n.*, m.node AS parent FROM n LEFT JOIN m ON m.member = n.conv_id AND m.d = n.d - 1),
k AS (SELECT parent, d - 1 AS d, count(*) AS n_children FROM q WHERE d > 0 GROUP BY parent, d),
x AS (SELECT q.*, coalesce(n_children, 0) AS n_children FROM q LEFT JOIN k ON k.parent = q.conv_id AND k.d = q.d),
s AS (SELECT m.node, m.d, count_if(n_children = 0) AS n_leaves, sum((n_convs - 1) * chars) AS saved_tokens
  FROM x JOIN m ON m.member = x.conv_id AND m.d <= x.d GROUP BY m.node, m.d)
SELECT x.conv_id, x.d::BIGINT AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens,
  coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM x JOIN s ON s.node = x.conv_id AND s.d = x.d LEFT JOIN e ON e.node = x.conv_id AND e.d = x.d
"""

_BYTES = """flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda s:
      CASE WHEN unicode(s) < 128 THEN [unicode(s)::BIGINT] ELSE [192 + unicode(s) // 64, 128 + unicode(s) % 64] END))"""
OP13_SQL = f"""
WITH RECURSIVE r AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
h AS (SELECT run, c, {crc32_sql(_BYTES)} AS h FROM (SELECT doc_id, run, count(*) AS c FROM r GROUP BY doc_id, run)),
w AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(c)::BIGINT AS n
  FROM h GROUP BY word),
k AS (SELECT * FROM w WHERE length(word) >= {LEAST_LENGTH} AND n >= {LEAST_COUNT}),
d AS (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM k)),
o AS (SELECT d.word, k.word AS other FROM d JOIN k ON k.word = d.rest),
e AS (SELECT a.word, b.word AS other FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT word, other FROM o UNION SELECT other, word FROM o),
b AS (SELECT e.word, count(*) AS n_near, max(k.n) AS most, arg_min(other, (-k.n, other)) AS best FROM e JOIN k ON k.word = e.other GROUP BY e.word),
f AS (SELECT k.word, k.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * k.n THEN best END AS form, CASE WHEN most >= 2 * k.n THEN most END AS form_n
  FROM k LEFT JOIN b ON b.word = k.word),
walk AS (SELECT word, word AS root, form FROM f UNION ALL SELECT walk.word, f.word, f.form FROM walk JOIN f ON f.word = walk.form)
SELECT f.word, f.form, walk.root, n, n_near, form_n FROM f JOIN walk ON walk.word = f.word AND walk.form IS NULL
"""

QUERIES = {
    "op1_warc_normalise": op1_warc_normalise,
    "op2_spaced_seeds": op2_spaced_seeds,
    "op3_kd_shards": op3_kd_shards,
    "op4_kneser_ney": op4_kneser_ney,
    "op5_field_spans": op5_field_spans,
    "op6_host_rules": op6_host_rules,
    "op7_pfair_mix": op7_pfair_mix,
    "op8_chat_round_trip": op8_chat_round_trip,
    "op9_simhash_groups": op9_simhash_groups,
    "op10_subword_quality": op10_subword_quality,
    "op11_chunked_bpe": op11_chunked_bpe,
    "op12_prefix_rollup": op12_prefix_rollup,
    "op13_spelling_pairs": op13_spelling_pairs,
    "pipeline": pipeline,
}

ORACLES = {
    "op1_warc_normalise": OP1_SQL.strip(),
    "op6_host_rules": OP6_SQL.strip(),
    "op8_chat_round_trip": OP8_SQL.strip(),
    "op12_prefix_rollup": OP12_SQL.strip(),
    "op13_spelling_pairs": OP13_SQL.strip(),
}
