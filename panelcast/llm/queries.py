"""Registered queries of the text-corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import bpe, chat, covertree, crosspolytope, jaccard_join, langid, mixing, pii, prefix_trie, quality, spelling, topk, warc

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


SQL_OP1 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
       row_number() OVER (PARTITION BY page_id, coalesce(html, '')) AS nth FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1),
r AS (SELECT p.*, CASE WHEN first < page_id OR first = page_id AND nth > 1 THEN first END AS refers_to FROM p LEFT JOIN f USING (payload_digest))
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
FROM r
"""


def op2_language_id_ecoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_held_out(table(spark, sf_dir, "documents"))


def op3_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.with_copies(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL_OP3 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(text, '')) AS k FROM documents),
u AS (SELECT *, ln(1 + size) AS len, (CAST('0x' || substr(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || k), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CASE WHEN sum(size) > 0 THEN sum(size * len) / sum(size) END AS mid, min(len) AS lo, max(len) AS hi FROM u GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1]::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, cap / weight AS ratio, (sum(source_size) OVER () - coalesce(sum(cap) OVER up, 0)) / sum(weight) OVER down AS level FROM w
  WINDOW up AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), down AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
t AS (SELECT *, least(cap, weight * coalesce(max(CASE WHEN level <= ratio THEN level END) OVER (), 'infinity'::DOUBLE)) AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio2, greatest(hi - mid, mid - lo) AS width FROM t),
f AS (SELECT *, floor(ratio2) AS whole, ratio2 - floor(ratio2) AS f, target - floor(ratio2) * source_size AS missing FROM r),
p AS (SELECT u.*, f.source_size, f.target, f.whole, f.missing, f.f + 0.5 * least(f.f, 1 - f.f) * coalesce(CASE WHEN f.width <> 0 THEN (u.len - f.mid) / f.width END, 0) AS p FROM u JOIN f ON u.source IS NOT DISTINCT FROM f.source),
q AS (SELECT *, (u / (1 - u)) / (greatest(p, 1e-12) / greatest(1 - p, 1e-12)) AS rank FROM p),
c AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id NULLS FIRST, size, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum FROM q)
SELECT doc_id, size, source_size, target, CAST(least(whole + CASE WHEN cum + size / 2.0 <= missing THEN 1 ELSE 0 END, 3) AS BIGINT) * size AS taken FROM c
"""


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


SQL_OP4 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n, s FROM s),
e AS (SELECT doc_id, n, unnest(s) AS g FROM n),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id AND a.n * 100 >= b.n * 90 AND b.n * 100 >= a.n * 90
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, m.c AS component_id FROM n JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = n.doc_id
"""


def op5_quality_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_embedding_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_duplicates(table(spark, sf_dir, "embeddings"))


_VALID = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"
SQL_OP6 = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE {_VALID} AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.c AS component_id, e.vec_id = c.c AS kept FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""


def op7_byte_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_reply_tree_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1, whose texts hold control strings."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hostile).alias("text"))
    return chat.formatted_digests(c.unionByName(own))


SQL_OP8 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(replace(role, '\', '\\')) + length(replace(text, '\', '\\')) + 13 + len(regexp_extract_all(role, '</?s>|\[/?(?:INST|SYS)\]')) + len(regexp_extract_all(text, '</?s>|\[/?(?:INST|SYS)\]')) AS chars FROM c)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.surrogates(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op10_block_max_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


SQL_OP10 = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS x FROM embeddings WHERE {_VALID}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score FROM (SELECT DISTINCT * FROM v WHERE vec_id % 100 = 0) q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""


def op11_spelling_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.shared_prefix_trie(table(spark, sf_dir, "conversations"))


def op13_cross_polytope_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspolytope.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def sql_crc32(text: str) -> str:
    """DuckDB expression of the unsigned CRC-32 of a text's UTF-8 bytes: each byte, then eight steps of one bit."""
    byte = f"CAST('0x' || hex(encode({text}))[2 * i + 1:2 * i + 2] AS BIGINT)"
    steps = f"list_concat([4294967295::BIGINT], flatten(list_transform(range(octet_length(encode({text}))), lambda i: [{byte}, -1, -1, -1, -1, -1, -1, -1, -1])))"
    return f"xor(4294967295::BIGINT, list_reduce({steps}, lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) ELSE xor(x >> 1, 3988292384 * (x & 1)) END))"


SQL_OP12 = f"""
WITH RECURSIVE t AS (SELECT conv_id, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS x, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(x ORDER BY turn NULLS FIRST, x.role, x.text) AS v, conv_id - conv_id % 5 AS base FROM t GROUP BY conv_id),
h AS (SELECT *, {sql_crc32("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM o),
r AS (SELECT h.conv_id, list_concat(coalesce(b.v, []::STRUCT(role VARCHAR, "text" VARCHAR)[])[1:h.h], h.v[h.h + 1:]) AS v FROM h LEFT JOIN o b ON b.conv_id = h.base),
p AS (SELECT conv_id, CAST(d AS BIGINT) AS depth, v[1:d] AS k, v[1:d - 1] AS up, d = len(v) AS last FROM (SELECT *, unnest(range(len(v) + 1)) AS d FROM r)),
g AS (SELECT depth, k, any_value(CASE WHEN depth > 0 THEN up END) AS up, min(conv_id) AS conv_id, count(*) AS n_convs,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM p GROUP BY depth, k),
n AS (SELECT g.*, q.conv_id AS parent_conv_id, CASE WHEN g.depth > 0 THEN (g.n_convs - 1) * octet_length(encode(g.k[g.depth].text)) ELSE 0 END AS saved
  FROM g LEFT JOIN g q ON g.depth = q.depth + 1 AND g.up = q.k),
c AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n FROM n WHERE parent_conv_id IS NOT NULL GROUP BY ALL),
m AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM n LEFT JOIN c USING (conv_id, depth)),
a AS (SELECT conv_id AS c, depth AS d, conv_id, depth, parent_conv_id AS up, saved, n_children FROM m
  UNION ALL SELECT m.conv_id, m.depth, a.conv_id, a.depth, m.parent_conv_id, a.saved, a.n_children FROM a JOIN m ON m.conv_id = a.up AND m.depth = a.d - 1),
s AS (SELECT c AS conv_id, d AS depth, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM a GROUP BY ALL)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM m JOIN s USING (conv_id, depth)
"""

SQL_OP11 = rf"""
WITH RECURSIVE t AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents),
p AS (SELECT d, r, count(*) AS k FROM t GROUP BY ALL),
h AS (SELECT *, {sql_crc32("d || ':' || r")} AS h FROM p),
c AS (SELECT CASE WHEN h % 97 = 0 THEN r[1:h % length(r)] || r[h % length(r) + 2:] ELSE r END AS word, k FROM h),
w AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM c WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
v AS (SELECT word, i, word[1:i - 1] || word[i + 1:] AS cut FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
e AS (SELECT a.word, b.word AS near FROM v a JOIN v b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
  UNION SELECT v.word, w.word FROM v JOIN w ON v.cut = w.word UNION SELECT w.word, v.word FROM v JOIN w ON v.cut = w.word),
b AS (SELECT e.word, count(*) AS n_near, arg_min(near, (-w.n, near)) AS near, max(w.n) AS near_n FROM e JOIN w ON w.word = e.near GROUP BY e.word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n FROM w LEFT JOIN b USING (word)),
g AS (SELECT word, word AS root, form AS nxt FROM f UNION ALL SELECT g.word, g.nxt, f.form FROM g JOIN f ON f.word = g.nxt)
SELECT f.word, n, n_near, form, form_n, root FROM f JOIN g ON g.word = f.word AND g.nxt IS NULL
"""


_QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_warc_capture_index,
        op2_language_id_ecoc,
        op3_pareto_mixing,
        op4_ngram_jaccard_join,
        op5_quality_bradley_terry,
        op6_embedding_cover_tree,
        op7_byte_bpe_round_trip,
        op8_reply_tree_chat,
        op9_pii_surrogates,
        op10_block_max_top_k,
        op11_spelling_frontier,
        op12_conversation_prefix_trie,
        op13_cross_polytope_search,
        pipeline,
    )
}
_SQL: dict[str, str] = {"op11_spelling_frontier": SQL_OP11, "op1_warc_capture_index": SQL_OP1, "op3_pareto_mixing": SQL_OP3, "op4_ngram_jaccard_join": SQL_OP4, "op6_embedding_cover_tree": SQL_OP6, "op10_block_max_top_k": SQL_OP10, "op8_reply_tree_chat": SQL_OP8, "op12_conversation_prefix_trie": SQL_OP12}


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
