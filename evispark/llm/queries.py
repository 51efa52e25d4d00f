"""The queries ``opN_<name>``, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evispark.llm import annforest, common, covertree, decontaminate, htmltext, mixing, mixlm, passages, phrases, prefixtrie, quality, simhash, substrings, tokenstore


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(common.table(spark, sf_dir, "documents"))


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixlm.score(common.table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op4_tokenids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.encode_table(common.table(spark, sf_dir, "documents"), tokenstore.tokenizer_path())


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return annforest.search(vectors, vectors.where("vec_id % 20 = 0"))


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeats(common.table(spark, sf_dir, "documents"))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(common.table(spark, sf_dir, "documents"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(common.table(spark, sf_dir, "pages"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.conversation_trie(common.table(spark, sf_dir, "conversations"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(common.table(spark, sf_dir, "documents"))


def op13_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_duplicates(common.table(spark, sf_dir, "embeddings"))


OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM sized GROUP BY source
), cap AS (
  SELECT *, source_size * 3.0::DOUBLE AS cap, source_size * 3.0::DOUBLE / w AS ratio FROM per
), lev AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM cap
), goal AS (
  SELECT source, source_size, CASE WHEN level_at IS NULL THEN cap ELSE least(cap, level_at * w) END AS target
  FROM (SELECT *, first_value(level) OVER (ORDER BY CASE WHEN ratio >= level THEN 0 ELSE 1 END, ratio) AS lv,
    max(CASE WHEN ratio >= level THEN 1 END) OVER () AS any_free, CASE WHEN any_free = 1 THEN lv END AS level_at FROM lev)
), ranked AS (
  SELECT s.doc_id, s.size, g.source, g.source_size, g.target,
    CASE WHEN g.source_size > 0 THEN least(g.target / g.source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS e,
    (('0x' || substr(md5(coalesce(s.doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source
), odds AS (
  SELECT *, floor(e)::BIGINT AS whole, e - floor(e) AS p,
    CASE WHEN e - floor(e) > 0 THEN (u / (1.0::DOUBLE - u)) / ((e - floor(e)) / (1.0::DOUBLE - (e - floor(e)))) END AS q FROM ranked
), run AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id ROWS UNBOUNDED PRECEDING) AS upto,
    target - sum(size * whole) OVER (PARTITION BY source) AS need FROM odds
)
SELECT doc_id, size, source_size, target,
  (size * least(whole + CASE WHEN q IS NOT NULL AND upto - size / 2.0::DOUBLE <= need THEN 1 ELSE 0 END, 3))::BIGINT AS taken
FROM run
"""

#: CRC-32 of the decimal digits, one bit at a time.
_CRC = """xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT),
    lambda crc, byte: list_reduce([xor(crc, byte)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))))"""

OP11_SQL = f"""
WITH RECURSIVE turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS d,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC} % 6 AS h FROM (SELECT DISTINCT conv_id FROM turns)
), taken AS (
  SELECT c.conv_id, c.base, c.h, count(t.d) AS k FROM convs c LEFT JOIN turns t ON t.conv_id = c.base AND t.d <= c.h GROUP BY ALL
), rebuilt AS (
  SELECT c.conv_id, t.d, t.role, t.text FROM taken c JOIN turns t ON t.conv_id = c.base AND t.d <= c.h
  UNION ALL SELECT c.conv_id, t.d - c.h + c.k, t.role, t.text FROM taken c JOIN turns t ON t.conv_id = c.conv_id AND t.d > c.h
), path AS (
  SELECT conv_id, 0::BIGINT AS d, '' AS node, NULL::VARCHAR AS up, 0::BIGINT AS size FROM convs
  UNION ALL SELECT p.conv_id, r.d, sha256(p.node || sha256(r.role) || sha256(r.text)), p.node, length(r.text) FROM path p JOIN rebuilt r ON r.conv_id = p.conv_id AND r.d = p.d + 1
), ending AS (
  SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM (SELECT conv_id, arg_max(node, d) AS node FROM path GROUP BY conv_id) GROUP BY node
), nodes AS (
  SELECT node, up, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(size) AS saved FROM path GROUP BY node, up, d
), kids AS (
  SELECT up AS node, count(*) AS n_children FROM nodes WHERE up IS NOT NULL GROUP BY up
), above AS (
  SELECT a.node, sum(CASE WHEN k.node IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum(n.saved) AS saved_tokens
  FROM nodes n JOIN path a ON a.conv_id = n.conv_id AND a.d <= n.d LEFT JOIN kids k ON k.node = n.node GROUP BY a.node
)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, a.n_leaves::BIGINT AS n_leaves, a.saved_tokens::BIGINT AS saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM nodes n JOIN above a ON a.node = n.node LEFT JOIN nodes u ON u.node = n.up LEFT JOIN kids k ON k.node = n.node LEFT JOIN ending e ON e.node = n.node
"""

OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM documents WHERE text IS NOT NULL
), places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces
), grams AS (
  SELECT lang, k AS size, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM places, (VALUES (1), (2), (3)) sizes(k) WHERE i + k - 1 <= len(w) GROUP BY ALL
), total AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE size = 1 GROUP BY lang
), cand AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE size > 1 AND f >= 10
), cuts AS (
  SELECT c.lang, c.size, c.phrase, c.a, k, l.f AS l, r.f AS r, (1000000::HUGEINT * c.a * c.a) // (l.f::HUGEINT * r.f) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM cand) c JOIN grams l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ') JOIN grams r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:], ' ')
), worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
  SELECT lang, phrase, max(a) AS most FROM (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM cand WHERE size = 3) GROUP BY ALL
)
SELECT w.lang, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, w.phrase) AS rank, w.phrase, a, l, r, n, score::BIGINT AS score
FROM worst w JOIN total t ON t.lang = w.lang LEFT JOIN longer g ON g.lang = w.lang AND g.phrase = w.phrase WHERE g.most IS NULL OR 100 * g.most < 50 * a
QUALIFY row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, w.phrase) <= 2000
"""

OP13_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), good AS (
  SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT vec_id, vec_id AS other FROM v UNION SELECT r.vec_id, l.v FROM reach r JOIN links l ON l.u = r.other
), least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id
), n AS (SELECT u AS vec_id, count(*) AS n_links FROM links GROUP BY u)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM least LEFT JOIN n USING (vec_id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_lm": op2_lm,
    "op3_decontaminate": op3_decontaminate,
    "op4_tokenids": op4_tokenids,
    "op5_ann": op5_ann,
    "op6_passages": op6_passages,
    "op7_substrings": op7_substrings,
    "op8_html": op8_html,
    "op9_quality": op9_quality,
    "op10_mixing": op10_mixing,
    "op11_trie": op11_trie,
    "op12_phrases": op12_phrases,
    "op13_embeddings": op13_embeddings,
}
ORACLES: dict[str, str] = {"op10_mixing": OP10_SQL, "op11_trie": OP11_SQL, "op12_phrases": OP12_SQL, "op13_embeddings": OP13_SQL}
