"""The registered queries of this subpackage: one for each operator, over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_text, langid, lexical, media, merkle, mixing, neardup, pieces, pii, quality, sharding, topk, toxicity
from ._spark import held_out, table


#: The model of op4 and of the pipeline's last stage; a parameter of the operators.
PIECE_MODEL = "piece_bpe_32k.model"


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(PIECE_MODEL)


def op1_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))[0]


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.learn(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), every=20, k=20, scale=64.0)


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), piece_model())


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = langid.predict(docs, langid.learn(docs))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(table(spark, sf_dir, "documents"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html_text.visible_text(table(spark, sf_dir, "pages"))
    return texts.select("page_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"), "text")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.located(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")), threshold=0.5)


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixture": op1_mixture,
    "op2_quality": op2_quality,
    "op3_top_k": op3_top_k,
    "op4_pieces": op4_pieces,
    "op5_personal_data": op5_personal_data,
    "op6_language": op6_language,
    "op7_media": op7_media,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_html_text": op9_html_text,
    "op10_toxicity": op10_toxicity,
    "op11_manifest": op11_manifest,
    "op12_shards": op12_shards,
    "op13_lexical": op13_lexical,
}

ORACLE_SQL: dict[str, str] = {
    "op1_mixture": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight FROM d GROUP BY source
), r AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS stop, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s
), l AS (
  SELECT *, (total - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM r WINDOW b AS (ORDER BY stop, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), g AS (
  SELECT source, source_size, least(cap, weight * (SELECT max(level) FROM l WHERE level <= stop)) AS target FROM l
), p AS (
  SELECT d.*, g.source_size, g.target, CAST(floor(g.target) AS BIGINT) AS goal,
    CAST(sum(size) OVER (PARTITION BY d.source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS pos
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
, n AS (
  SELECT *, CAST(coalesce(sum(blocks) OVER (ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before, CAST(sum(blocks) OVER () AS BIGINT) AS slots
  FROM (SELECT source, coalesce('=' || source, '-') AS name, CAST(ceil(floor(target) / 1024) AS BIGINT) AS blocks FROM g) WHERE blocks > 0
), t AS (
  SELECT n.source, n.slots, x.slot, row_number() OVER (PARTITION BY name ORDER BY x.slot) - 1 AS block
  FROM (SELECT unnest(range((SELECT max(slots) FROM n))) AS slot) x
  JOIN n ON x.slot * 1327217885 % 2147483648 >= floor(before / slots * 2147483648) AND x.slot * 1327217885 % 2147483648 < floor((before + blocks) / slots * 2147483648)
), m AS (
  SELECT p.*, r.round, pos + r.round * source_size AS lo, least(pos + r.round * source_size + size, goal) AS hi FROM p, (VALUES (0), (1)) r(round) WHERE size > 0
), h AS (
  SELECT doc_id, source, pos, unnest(range(CAST(lo // 1024 AS BIGINT), CAST((hi - 1) // 1024 AS BIGINT) + 1)) AS block FROM m WHERE lo < hi
), f AS (
  SELECT h.doc_id AS f_id, h.pos AS f_pos, h.source AS f_source, min(coalesce(t.slot, n.slots + h.block)) AS first_slot, count(*) AS n_slots
  FROM h JOIN n ON h.source IS NOT DISTINCT FROM n.source LEFT JOIN t ON h.source IS NOT DISTINCT FROM t.source AND h.block = t.block GROUP BY ALL
)
SELECT doc_id, size, source_size, target,
  CAST(greatest(0, least(pos + size, goal) - pos) + greatest(0, least(pos + source_size + size, goal) - pos - source_size) AS BIGINT) AS taken,
  CAST(first_slot AS BIGINT) AS first_slot, CAST(coalesce(n_slots, 0) AS BIGINT) AS n_slots
FROM p LEFT JOIN f ON size > 0 AND doc_id IS NOT DISTINCT FROM f_id AND pos = f_pos AND source IS NOT DISTINCT FROM f_source
""",
    "op3_top_k": r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op8_near_duplicates": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[])
    WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM w
), e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), r AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x
), c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM s JOIN c USING (doc_id)
""",
    "op11_manifest": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, text, coalesce('=' || lang, '-') AS k, source, n_chars, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_text,
    CAST(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
      lambda a, b: list_reduce([xor(a, b)] || [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, (x & 1) * 3988292384))) AS BIGINT) AS crc
  FROM documents
), f AS (
  SELECT doc_id, k, xor(crc, 4294967295) % 3 = 0 AS hit,
    [coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')] AS head, coalesce(strlen(text) || ':' || text, '-') AS body, coalesce(strlen(lower_text) || ':' || lower_text, '-') AS lower_body
  FROM d
), l AS (
  SELECT doc_id, k, sha256(head[1] || body) AS leaf, CASE WHEN hit THEN sha256(head[1] || lower_body) ELSE sha256(head[1] || body) END AS used,
    row_number() OVER (PARTITION BY k ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY k) AS n FROM f
), t AS (
  SELECT k, 0 AS lvl, idx, leaf AS h, n FROM l
  UNION ALL
  SELECT k, lvl + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (n + 7) // 8 FROM t WHERE n > 1 GROUP BY k, lvl, idx // 8, n
), s AS (SELECT k, lvl AS depth, h AS subroot, row_number() OVER (ORDER BY k) - 1 AS idx, count(*) OVER () AS n FROM t WHERE n = 1
), u AS (
  SELECT 0 AS lvl, idx, subroot AS h, n FROM s
  UNION ALL
  SELECT lvl + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (n + 7) // 8 FROM u WHERE n > 1 GROUP BY lvl, idx // 8, n
), a AS (
  SELECT k AS tree, lvl, idx // 8 AS run, list(h ORDER BY idx) AS hs FROM t WHERE n > 1 GROUP BY ALL
  UNION ALL
  SELECT '', lvl, idx // 8, list(h ORDER BY idx) FROM u WHERE n > 1 GROUP BY ALL
), p AS (
  SELECT l.doc_id, l.k, l.leaf, l.used, l.idx, s.depth, s.subroot, s.idx AS place FROM l JOIN s ON l.k = s.k
), w AS (
  SELECT doc_id, k, leaf, subroot, idx, depth, place, 0 AS step, used AS folded, '' AS proof FROM p
  UNION ALL
  SELECT doc_id, k, leaf, subroot, CASE WHEN step < depth THEN w.idx // 8 ELSE w.idx END, depth, CASE WHEN step < depth THEN place ELSE place // 8 END, step + 1,
    sha256(array_to_string(list_slice(hs, 1, c), '') || folded || array_to_string(list_slice(hs, c + 2, 8), '')), proof || array_to_string(list_slice(hs, 1, c), '') || array_to_string(list_slice(hs, c + 2, 8), '')
  FROM (SELECT *, CASE WHEN step < depth THEN idx % 8 ELSE place % 8 END AS c FROM w) w
  JOIN a ON a.tree = CASE WHEN step < depth THEN k ELSE '' END AND a.lvl = CASE WHEN step < depth THEN step ELSE step - depth END AND a.run = CASE WHEN step < depth THEN w.idx // 8 ELSE place // 8 END
), r AS (SELECT h AS root FROM u WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM r, w QUALIFY step = max(step) OVER (PARTITION BY doc_id)
""",
    "op13_lexical": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents WHERE text IS NOT NULL
), g AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(len(ws)) AS BIGINT) AS ll FROM d WHERE len(ws) > 0
), p AS (SELECT doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n, unnest(ws) AS term FROM d) GROUP BY ALL
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), v AS (SELECT term, CAST(count(*) AS BIGINT) AS df FROM p GROUP BY term
), w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM v, g
), s AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * nn) // ll))))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN p USING (term), g GROUP BY item_id, doc_id
), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10
""",
}
