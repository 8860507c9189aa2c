"""The registered queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import suffix_tree
from .common import documents, fold
from .conversation_repair import damage, repair
from .exact_dedup import exact_dedup
from .imatch import edited_fingerprints, lexicon
from .kd_shards import kd_shards
from .language_id import identify, train
from .line_dedup import line_dedup
from .ngram_join import ngram_join
from .packing import pack
from .sentence_pieces import piece_digests
from .substring_dedup import kept_digests
from .suffix_dedup import suffix_digests
from .whitening import whiten


def tokenizer(name: str) -> str:
    """Where the public vocabulary files lie; pass your own paths to the operators for others."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(documents(spark, sf_dir), run=3, words=20)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(documents(spark, sf_dir))


def op4_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return edited_fingerprints(docs, lexicon(docs))


def op5_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(documents(spark, sf_dir), n_shards=8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_digests(documents(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


def op8_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = fold(F.col("doc_id"), 7) == 2
    tree, vocabulary = suffix_tree.train(docs.where(~held_out))
    found = suffix_tree.score(docs, tree, vocabulary)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = fold(F.col("doc_id"), 4) == 2
    found = identify(docs, train(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return repair(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_digests(documents(spark, sf_dir))


OP2_SQL = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
t AS (SELECT doc_id, lines, list_transform(lines, lambda x: len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))) AS n FROM l),
w AS (SELECT doc_id, lines, i, CASE WHEN n[i] >= 20 THEN 1 WHEN n[i] + n[i+1] >= 20 THEN 2 ELSE 3 END AS size
      FROM t, unnest(range(1, len(lines) + 1)) AS r(i)),
f AS (SELECT doc_id, i, size, row_number() OVER (PARTITION BY size, array_to_string(lines[i:i+size-1], chr(10)) ORDER BY doc_id, i) AS k
      FROM w WHERE i + size - 1 <= len(lines)),
d AS (SELECT DISTINCT doc_id, i + j AS line FROM f, range(0, 3) AS s(j) WHERE k > 1 AND j < size),
g AS (SELECT doc_id, list(line) AS gone FROM d GROUP BY doc_id)
SELECT l.doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(CASE WHEN gone IS NULL THEN text ELSE array_to_string(
         list_transform(list_filter(range(1, len(lines) + 1), lambda x: NOT list_contains(gone, x)), lambda x: lines[x]), chr(10)) END, '')) AS kept_sha256
FROM l LEFT JOIN g USING (doc_id)
"""

OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i+4], ' ') AS shingle
      FROM w, unnest(range(1, greatest(len(words) - 4, least(len(words), 1)) + 1)) AS r(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
pairs AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(doc_id, low) AS (SELECT a, least(a, min(b)) FROM pairs GROUP BY a
                       UNION SELECT b, low FROM reach JOIN pairs ON a = reach.doc_id WHERE low < b),
c AS (SELECT doc_id, min(low) AS low FROM reach GROUP BY doc_id),
k AS (SELECT a AS doc_id, count(*) AS links FROM pairs GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(least(c.low, d.doc_id), d.doc_id) AS component_id,
       coalesce(k.links, 0)::BIGINT AS n_links
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
"""

OP6_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(words[i:i+19], ' ') ORDER BY doc_id, i) AS k
      FROM w, unnest(range(1, len(words) - 18)) AS r(i)),
g AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 20)))) AS gone FROM p WHERE k > 1 GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN words ELSE
         list_transform(list_filter(range(1, len(words) + 1), lambda x: NOT list_contains(gone, x)), lambda x: words[x]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)
"""

OP10_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars,
             sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id)
"""


# crc32 bit by bit, then a walk over each conversation's turns that keeps, for each state of the grammar (0 nothing yet, 1 system,
# 2 user, 3 assistant), the cheapest edits and of those the ASCII-least, with the turns that they leave.
OP11_SQL = r"""
WITH RECURSIVE c0 AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')) AS name FROM conversations),
c1 AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(0, octet_length(name)), lambda i:
    list_transform(range(0, 8), lambda b: ((('0x' || hex(name)[2 * i + 1 : 2 * i + 2])::BIGINT) >> b) & 1)))),
  lambda c, b: xor(c >> 1, 3988292384::BIGINT * (xor(c, b) & 1))), 4294967295::BIGINT) % 20 AS kind FROM c0),
tn AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM c1, unnest(range(0, CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS r(copy)),
od AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text)) AS k FROM tn),
ft AS (SELECT *, trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, role[1:1] AS ini, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again,
  lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM od),
fa AS (SELECT *, CASE WHEN bare = '' THEN 'b' WHEN again THEN 'd' WHEN bare[-1] NOT IN ('.', '!', '?') THEN 't' ELSE 'k' END AS fault FROM ft),
su AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
  count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal, max(k) AS n FROM fa GROUP BY 1),
ins(s, u, cost, audit, lines) AS (VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 2, 'I', ['user:']), (1, 2, 2, 'I', ['user:']), (2, 3, 2, 'I', ['assistant:']),
  (3, 2, 2, 'I', ['user:']), (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 3, 4, 'II', ['user:', 'assistant:'])),
act(u, v, ini, cost, audit, role) AS (SELECT * FROM (VALUES (0, 0, NULL, 3, 'D', NULL), (1, 1, NULL, 3, 'D', NULL), (2, 2, NULL, 3, 'D', NULL), (3, 3, NULL, 3, 'D', NULL), (0, 1, 's', 0, 'K', NULL), (0, 2, 'u', 0, 'K', NULL),
  (1, 2, 'u', 0, 'K', NULL), (3, 2, 'u', 0, 'K', NULL), (2, 3, 'a', 0, 'K', NULL), (0, 2, NULL, 2, 'R', 'user'), (1, 2, NULL, 2, 'R', 'user'), (2, 3, NULL, 2, 'R', 'assistant'), (3, 2, NULL, 2, 'R', 'user'))),
edit AS (SELECT s, v, ini, ins.cost + act.cost AS cost, ins.audit || act.audit AS audit, lines, role, act.audit AS last FROM ins JOIN act USING (u)),
dp(conv_id, k, s, cost, audit, lines) AS (SELECT conv_id, 0::BIGINT, 0, 0, '', []::VARCHAR[] FROM su UNION ALL
  SELECT f.conv_id, f.k, v, dp.cost + e.cost + CASE WHEN fault = 't' AND last <> 'D' THEN 1 ELSE 0 END, dp.audit || e.audit,
    list_concat(dp.lines, e.lines, CASE WHEN last = 'D' THEN [] ELSE [coalesce(e.role, f.role) || ':' || f.text] END)
  FROM dp JOIN fa f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.k = dp.k + 1 JOIN edit e ON e.s = dp.s AND (e.ini IS NULL OR e.ini = f.ini) AND (last = 'D' OR fault IN ('k', 't'))
  QUALIFY row_number() OVER (PARTITION BY f.conv_id, v ORDER BY dp.cost + e.cost + CASE WHEN fault = 't' AND last <> 'D' THEN 1 ELSE 0 END, dp.audit || e.audit) = 1),
en AS (SELECT dp.conv_id, dp.cost + ins.cost AS cost, dp.audit || ins.audit AS audit, list_concat(dp.lines, ins.lines) AS lines FROM dp JOIN su ON su.conv_id IS NOT DISTINCT FROM dp.conv_id AND su.n = dp.k
  JOIN ins ON ins.s = dp.s AND ((dp.s IN (0, 3) AND ins.cost = 0) OR (dp.s IN (1, 2) AND ins.u = 3)) QUALIFY row_number() OVER (PARTITION BY dp.conv_id ORDER BY dp.cost + ins.cost, dp.audit || ins.audit) = 1)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN su ON su.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN en ON en.conv_id IS NOT DISTINCT FROM o.conv_id
"""

# Bytes as pairs of hex digits, cut twice, as cutting takes time in proportion to a string; windows by MD5.
OP13_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT r, q, h[1024 * q + 1 : 1024 * q + 1424] AS part FROM d, unnest(range(0, (len(h) + 1023) // 1024)) AS t(q)),
w AS (SELECT r, 512 * q + j AS i, md5(part[2 * j + 1 : 2 * j + 400]) AS key FROM c, unnest(range(0, least(512, len(part) // 2 - 199))) AS t(j)),
g AS (SELECT r, i FROM w JOIN (SELECT key FROM w GROUP BY key HAVING count(*) > 1) USING (key)),
s AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM g),
t AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS span FROM s),
p AS (SELECT r, span, min(i) AS a, max(i) + 200 AS b FROM t GROUP BY 1, 2),
q AS (SELECT r, list(a ORDER BY a) AS froms, list(b ORDER BY a) AS tos, sum(b - a) AS n_removed, count(*) AS n_spans FROM p GROUP BY 1)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN froms IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(froms) + 1), lambda k:
    h[2 * CASE WHEN k = 0 THEN 0 ELSE tos[k] END + 1 : 2 * CASE WHEN k = len(froms) THEN len(h) // 2 ELSE froms[k + 1] END]), '') END)) AS kept_sha256
FROM d LEFT JOIN q USING (r)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2_SQL, "op3_ngram_join": OP3_SQL, "op6_substring_dedup": OP6_SQL, "op10_exact_dedup": OP10_SQL, "op11_conversation_repair": OP11_SQL, "op13_suffix_dedup": OP13_SQL}
