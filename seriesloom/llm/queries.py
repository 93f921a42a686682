"""The registered queries: one per operator, over its whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm import archives, decontaminate, lines, near, negatives, order, packing, pages, quality, repair, substrings, urls, vectors
from seriesloom.llm.registry import query, table

URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: The least bad URLs of a mined rule, its least confidence, and the deviations by which that is above the share of bad URLs.
URL_BAD, URL_CONFIDENCE, URL_DEVIATIONS = 3, 0.5, 3.29


@query("op7_url_rules")
def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last number of a page's path is the id of its document, which has the labels."""
    rows = table(spark, sf_dir, "pages").select("page_id", "url")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(bad).alias("bad"))
    number = F.regexp_extract(urls.path_of(F.col("url")), r"/(\d+)(?:\.[a-z]+)?/?$", 1)
    labelled = rows.select("url", number.try_cast("bigint").alias("doc_id")).join(labels, "doc_id")
    judged = urls.judge_urls(rows, labelled, URL_RULES, min_confidence=URL_CONFIDENCE, min_bad=URL_BAD, deviations=URL_DEVIATIONS)
    return judged.select("page_id", "host", "path", "rule", "verdict", "confidence")


OP10_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
         sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS first FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT p.page_id, payload_bytes, p.payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND payload_bytes >= 1000
"""


@query("op10_zip_warc", OP10_SQL)
def op10_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = archives.archive_pages(spark, table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op1_compression_quality")
def op1_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


TOKENIZER = "byte_bpe_50k.json"


@query("op6_best_fit")
def op6_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), 1024)


@query("op4_page_differencing")
def op4_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(table(spark, sf_dir, "pages"))


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) >= 3 THEN list_transform(range(1, len(l) - 1), lambda i: l[i] || ' ' || l[i+1] || ' ' || l[i+2])
         WHEN len(l) > 0 THEN [array_to_string(l, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM r GROUP BY 1) m ON m.a = d.doc_id
"""


@query("op9_ngram_jaccard", OP9_SQL)
def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_documents(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH t AS (SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT kind, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l FROM t),
s AS (SELECT DISTINCT kind, id, unnest(list_transform(range(1, len(l) - 3),
      lambda i: l[i] || ' ' || l[i+1] || ' ' || l[i+2] || ' ' || l[i+3] || ' ' || l[i+4])) AS g FROM w WHERE len(l) >= 5),
n AS (SELECT id, count(*) AS n FROM s WHERE kind = 1 GROUP BY 1),
c AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_found FROM s d JOIN s i ON d.g = i.g AND d.kind = 0 AND i.kind = 1 GROUP BY 1, 2)
SELECT doc_id, item_id, CAST(n_found AS BIGINT) AS n_found, CAST(n AS BIGINT) AS n_shingles
FROM c JOIN n ON n.id = item_id WHERE 10 * n_found >= 8 * n
"""


@query("op8_bm25_decontaminate", OP8_SQL)
def op8_bm25_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_found", "n_shingles")


@query("op5_paragraph_minhash")
def op5_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY 1),
n AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY 1)
SELECT c.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, c.vec_id = component_id AS kept
FROM c LEFT JOIN n ON n.vec_id = c.vec_id
"""


@query("op2_collision_counting", OP2_SQL)
def op2_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op3_training_order")
def op3_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards as they are read back: per slot its place, its documents in order, and the crc32 of its ids."""
    tokenizer = public_tokenizers.path(TOKENIZER)
    index = order.materialise(table(spark, sf_dir, "documents"), tokenizer, 1024)
    back = order.read_shards(index, tokenizer, 1024)
    return back.select(
        "slot", "shard", "row", F.col("length").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"),
        F.col("parts.doc_id").alias("doc_ids"), F.col("parts.start").alias("starts"), F.col("parts.length").alias("lengths"),
    )


OP12_SQL = r"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM s),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
g AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, pos, line, coalesce(k.doc_id <> keeper, false) AS gone FROM k LEFT JOIN g ON k.key = g.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@query("op12_line_runs", OP12_SQL)
def op12_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.drop_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def _repair_sql() -> str:
    """A row's step over the least ``cost || audit`` of every state, costs in nine digits; the crc32 goes by a table of 256 bytes."""

    def plus(value: str, cost: str, edits: str) -> str:
        return f"lpad(CAST(CAST({value}[1:9] AS INTEGER) + {cost} AS VARCHAR), 9, '0') || {value}[10:] || '{edits}'"

    def least(*values: str) -> str:
        return f"least({', '.join(values)})"

    def closed(v: str) -> list[str]:
        """With insertions before the next row."""
        v0, v1, v2, v3 = (f"{v}{k}" for k in range(4))
        return [
            v0, v1, least(v2, *[plus(x, "3", "I") for x in (v0, v1, v3)]), least(v3, plus(v2, "3", "I"), *[plus(x, "6", "II") for x in (v0, v1)])
        ]

    may = "CASE WHEN NOT gone AND initial = '{}' THEN {} END"
    kept = [
        plus("w0", "4", "D"),
        least(plus("w1", "4", "D"), may.format("s", plus("w0", "more", "K"))),
        least(plus("w2", "4", "D"), *[may.format("u", plus(w, "more", "K")) for w in ("w0", "w1", "w3")],
              *[f"CASE WHEN NOT gone THEN {plus(w, '3 + more', 'R')} END" for w in ("w0", "w1", "w3")]),
        least(plus("w3", "4", "D"), may.format("a", plus("w2", "more", "K")), f"CASE WHEN NOT gone THEN {plus('w2', '3 + more', 'R')} END"),
    ]
    return rf"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)),
         lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
base AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_concat([4294967295], list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':'
             || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
  FROM conversations, crc),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM base WHERE kind <> 0),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS pos,
         CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS initial,
         NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?') AS cut FROM d),
f AS (
  SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial AS pair FROM o),
g AS (SELECT *, blank OR again AS gone, CASE WHEN cut AND NOT blank AND NOT again THEN 3 ELSE 0 END AS more FROM f),
r AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS pos, '000000000' AS v0, CAST(NULL AS VARCHAR) AS v1, CAST(NULL AS VARCHAR) AS v2, CAST(NULL AS VARCHAR) AS v3
  FROM (SELECT DISTINCT conv_id FROM g)
  UNION ALL
  SELECT conv_id, pos, {', '.join(kept)} FROM (
    SELECT g.conv_id, g.pos, g.initial, g.gone, g.more, {', '.join(f'{x} AS w{k}' for k, x in enumerate(closed('r.v')))}
    FROM r JOIN g ON g.conv_id = r.conv_id AND g.pos = r.pos + 1)),
s AS (
  SELECT conv_id, gaps, blank, duplicate, truncated, illegal, n FROM (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
           count(*) FILTER (WHERE again) AS duplicate, count(*) FILTER (WHERE more = 3) AS truncated,
           count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n FROM g GROUP BY 1)),
b AS (
  SELECT s.*, least(w0, w3) AS best FROM s JOIN (SELECT conv_id, pos, {', '.join(f'{x} AS w{k}' for k, x in enumerate(closed('v')))} FROM r) e
  ON e.conv_id = s.conv_id AND e.pos = s.n),
a AS (SELECT *, CAST(best[1:9] AS BIGINT) AS cost, best[10:] AS audit FROM b),
e AS (
  SELECT conv_id, nth, edit, sum(CASE WHEN edit <> 'I' THEN 1 ELSE 0 END) OVER w AS pos,
         sum(CASE WHEN edit <> 'D' THEN 1 ELSE 0 END) OVER w AS place
  FROM (SELECT conv_id, unnest(string_split(audit, '')) AS edit, generate_subscripts(string_split(audit, ''), 1) AS nth FROM a WHERE audit <> '')
  WINDOW w AS (PARTITION BY conv_id ORDER BY nth)),
h AS (
  SELECT e.conv_id, nth, edit, place, CASE WHEN edit <> 'I' THEN g.role END AS role, CASE WHEN edit = 'I' THEN '' ELSE g.text END AS text,
         max(CASE WHEN place = 1 AND edit = 'K' AND g.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS led
  FROM e LEFT JOIN g ON g.conv_id = e.conv_id AND g.pos = e.pos),
t AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text,
         chr(10) ORDER BY nth) FILTER (WHERE edit <> 'D') AS whole FROM h GROUP BY 1)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
       sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN a ON a.conv_id = c.conv_id LEFT JOIN t ON t.conv_id = c.conv_id
"""


OP13_SQL = _repair_sql()


@query("op13_lightest_repair", OP13_SQL)
def op13_lightest_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.damage_and_repair(table(spark, sf_dir, "conversations"))


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


@query("op11_multi_index", OP11_SQL)
def op11_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)
