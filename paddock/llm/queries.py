"""The registered queries of this folder and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.llm import (
    decontamination, hard_negatives, language_id, line_dedup, lm_scoring, mixing, multi_index, ngram_join, quality_pu, sharding, spelling, toxicity, warc,
)
from paddock.llm.tables import fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BITS = " + ".join(f"CAST(substr(bits, 5 * i + {k}, 1) AS INTEGER) * {32 >> k}" for k in range(1, 6))

ORACLES["op2_ngram_jaccard_join"] = rf"""WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, reach.root FROM reach JOIN e ON e.a = reach.node)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(root) AS component_id FROM reach GROUP BY node) ON node = d.doc_id"""

ORACLES["op6_dictionary_warc"] = f"""SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('{_UPPER}234567', CAST(1 + {_BITS} AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM (SELECT *, CAST(CAST(from_hex(sha1(body)) AS BIT) AS VARCHAR) AS bits, max(page_id) OVER (PARTITION BY body) AS top
      FROM (SELECT page_id, coalesce(html, '') AS body FROM pages))"""

ORACLES["op11_strassen_hard_negatives"] = """WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY rank <= 3"""

ORACLES["op12_levelled_line_dedup"] = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_UPPER.lower()}') AS key FROM l),
o AS (SELECT *, length(key) >= 10 AND doc_id IS DISTINCT FROM min(doc_id) OVER (PARTITION BY key) AS gone FROM k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM o GROUP BY r, doc_id"""

_RUN = r"[A-Za-z\x{00C0}-\x{00FF}]+"
ORACLES["op13_permuterm_variants"] = rf"""WITH RECURSIVE t AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i,
    list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) x(i))),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '{_RUN}')), '{_UPPER}', '{_UPPER.lower()}') AS run FROM documents),
q AS (SELECT run, hex(encode(doc_id || ':' || run)) AS h, n FROM (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= 7 GROUP BY ALL)),
c AS (SELECT run, n, xor(list_reduce([4294967295] || list_transform(range(1, length(h), 2),
    lambda i: CAST(16 * (strpos('0123456789ABCDEF', substr(h, i, 1)) - 1) + strpos('0123456789ABCDEF', substr(h, i + 1, 1)) - 1 AS BIGINT)),
    lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1])), 4294967295) AS h FROM q, t),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 31 = 0
    THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM c) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
e AS (SELECT word, i, substr(word, 1, i) || '*' || substr(word, i + 2) AS p, substr(word, 1, i) || substr(word, i + 2) AS less
  FROM (SELECT word, unnest(range(length(word))) AS i FROM w)),
s AS (SELECT DISTINCT e.word AS a, w.word AS b FROM e JOIN w ON e.less = w.word),
near AS (SELECT a, b FROM s UNION ALL SELECT b, a FROM s UNION ALL SELECT x.word, y.word FROM e x JOIN e y ON x.p = y.p AND x.word <> y.word),
best AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-y.n, b)) AS b, max(y.n) AS bn FROM near JOIN w y ON y.word = b GROUP BY a),
f AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN bn >= 10 * n THEN b END AS form, CASE WHEN bn >= 10 * n THEN bn END AS form_n FROM w LEFT JOIN best USING (word)),
walk(word, stop) AS (SELECT word, word FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.stop WHERE f.form IS NOT NULL)
SELECT f.word, f.form, walk.stop AS root, f.n, f.n_near, f.form_n FROM f JOIN walk ON walk.word = f.word JOIN f g ON g.word = walk.stop AND g.form IS NULL"""


@_query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, fold("doc_id", 3) != 1)
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    return language_id.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model, ["doc_id", "held_out"])


@_query
def op10_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@_query
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


@_query
def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@_query
def op8_label_propagation_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


@_query
def op6_dictionary_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query
def op4_backoff_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"), fold("doc_id", 7) == 2)


@_query
def op7_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, prior = quality_pu.fit(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    return quality_pu.score(docs.select("doc_id", "text", held_out.alias("held_out")), model, prior, ["doc_id", "held_out"])


@_query
def op9_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    return toxicity.score(docs.select("doc_id", "text", held_out.alias("held_out")), model, ["doc_id", "held_out"])


@_query
def op11_strassen_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, moved)


@_query
def op12_levelled_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_digest(table(spark, sf_dir, "documents"))


@_query
def op13_permuterm_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(table(spark, sf_dir, "documents"))
