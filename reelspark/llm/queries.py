"""One query per operator over the given tables: columns renamed to the operators' own, and back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from reelspark.llm import credentials, histories, html_blocks, leaks, mixture, nearest, repeats, similar, site_quality, suffixes, token_trees, toxicity, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def project_documents(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").alias("project_id"), F.col("text").alias("document"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(project_documents(_table(spark, sf_dir, "documents")))
    return out.select(F.col("project_id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES["op6_substring_dedup"] = op6_substring_dedup
CHECKS["op6_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
firsts AS (SELECT h, min(doc_id) AS d FROM win GROUP BY h),
gone AS (SELECT doc_id, list_sort(list(DISTINCT p)) AS ps FROM (
  SELECT win.doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN firsts USING (h) WHERE win.doc_id > d) GROUP BY doc_id),
kept AS (SELECT doc_id, p, ws[p] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w)
  ANTI JOIN (SELECT doc_id, unnest(ps) AS p FROM gone) g USING (doc_id, p)),
texts AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM kept GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id) LEFT JOIN texts USING (doc_id)
"""


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.remove_repeated_bytes(project_documents(_table(spark, sf_dir, "documents")))
    return out.select(
        F.col("project_id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


QUERIES["op8_suffix_array_dedup"] = op8_suffix_array_dedup


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    out = mixture.mix_series(documents.select(F.col("doc_id").alias("shot_id"), F.col("source").alias("series"), words.alias("frames")))
    return out.select(
        F.col("shot_id").alias("doc_id"), F.col("frames").alias("size"), F.col("series_frames").alias("source_size"), "target", "taken", "finish_time"
    )


QUERIES["op7_source_mixing"] = op7_source_mixing
CHECKS["op7_source_mixing"] = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
   - coalesce(sum(2 * source_size) OVER (ORDER BY (2 * source_size)::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
   / sum(weight) OVER (ORDER BY (2 * source_size)::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM w),
t AS (SELECT source, source_size, least((2 * source_size)::DOUBLE, weight * max(level) OVER ()) AS target FROM l),
q AS (SELECT doc_id, size, source_size, target, d.source, md5('0:' || doc_id) AS k FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
-- Slices of the shuffled order come one after another.
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY ('0x' || k[1:8])::BIGINT % 4096, k, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS served FROM q)
SELECT doc_id, size, source_size, target,
  (least(size, greatest(0, floor(target)::BIGINT - (served - size))) + least(size, greatest(0, floor(target)::BIGINT - (served - size + source_size))))::BIGINT AS taken,
  CASE WHEN target > 0 THEN served::DOUBLE / target END AS finish_time
FROM c
"""


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = _table(spark, sf_dir, "benchmark")
    blueprints = benchmark.select(F.col("item_id").cast("string").alias("source_hash"), F.col("text").alias("document"))
    out = leaks.blueprint_leaks(project_documents(_table(spark, sf_dir, "documents")), blueprints)
    return out.select(
        F.col("project_id").alias("doc_id"), F.col("source_hash").cast("long").alias("item_id"),
        F.col("n_words").alias("item_words"), F.col("n_covered").alias("covered_words"), "coverage", "n_tiles",
    )


QUERIES["op1_benchmark_decontamination"] = op1_benchmark_decontamination


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_blocks.extract_main_text(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_blocks", "n_kept")


QUERIES["op5_html_extraction"] = op5_html_extraction


def toxicity_model(documents: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Model fitted on labelled documents outside the held-out fifth."""
    flags = labels.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("project_id"), F.col("toxic").alias("flagged"))
    return toxicity.train(*toxicity.labelled_sample(project_documents(documents), flags))


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    out = toxicity.score_toxicity(project_documents(documents), toxicity_model(documents, _table(spark, sf_dir, "labels")))
    doc_id = F.col("project_id").alias("doc_id")
    return out.select(doc_id, held_out(F.col("project_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_windows", "best_gain")


QUERIES["op10_toxicity"] = op10_toxicity


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = similar.similar_projects(project_documents(_table(spark, sf_dir, "documents")))
    return out.select(F.col("project_id").alias("doc_id"), "n_shingles", "component_id", "n_links")


QUERIES["op2_ngram_jaccard_join"] = op2_ngram_jaccard_join
CHECKS["op2_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 3], ' ')) AS h FROM (
  SELECT doc_id, ws, unnest(CASE WHEN len(ws) = 0 THEN [] ELSE range(1, greatest(len(ws) - 2, 2)) END) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a),
d AS (SELECT a, count(*) AS k FROM e GROUP BY a)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id))::BIGINT AS component_id, coalesce(k, 0)::BIGINT AS n_links
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.a = w.doc_id LEFT JOIN d ON d.a = w.doc_id
"""


def op9_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    histograms = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("shot_id"), F.col("embedding").alias("hist"))
    out = nearest.nearest_shots(histograms, histograms.where("shot_id % 100 = 0"))
    return out.select("query_id", "rank", F.col("shot_id").alias("vec_id"), F.col("distance").alias("score"))


QUERIES["op9_approximate_nearest_neighbours"] = op9_approximate_nearest_neighbours

TOKENIZERS = "/opt/tokenizers"


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_trees.redacted_token_counts(project_documents(_table(spark, sf_dir, "documents")), TOKENIZERS)
    return out.select(F.col("project_id").alias("doc_id"), "n_tokens", "n_tokens_edited", "n_edits", "n_leaves", "n_bytes", "n_bytes_encoded")


QUERIES["op3_token_counts"] = op3_token_counts


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A document's source stands for the host, its language for the path below it.
    assets = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("asset_id"), F.col("source").alias("root"), F.col("lang").alias("folder"), F.col("text").alias("note"))
    verdicts = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("asset_id"), F.col("quality").alias("passed"))
    out = site_quality.asset_quality(assets, verdicts)
    return out.select(F.col("asset_id").alias("doc_id"), F.col("root").alias("source"), F.col("folder").alias("lang"), "evidence", "root_share", "folder_share", "quality", "keep")


QUERIES["op4_quality_classifier"] = op4_quality_classifier


def _spans_text(spans):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def op11_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = credentials.find_secrets(project_documents(_table(spark, sf_dir, "documents")))
    kinds = [rule.kind for rule in credentials.BASE_RULES]

    def only(*names):
        return F.filter("secrets", lambda x: x["kind"].isin(*names))

    counts = [F.size(only(k)).cast("long").alias(f"n_{k}") for k in kinds]
    return out.select(F.col("project_id").alias("doc_id"), *counts, F.sha2(_spans_text(only(*kinds)), 256).alias("base_sha256"), _spans_text(F.col("secrets")).alias("spans"))


QUERIES["op11_secret_scans"] = op11_secret_scans
CHECKS["op11_secret_scans"] = r"""
WITH k(ord, kind, pattern, g, least) AS (VALUES
  (0, 'assign', '(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 12),
  (1, 'access', 'AKIA[A-Z0-9]+', 0, 18), (2, 'hex', '[0-9a-f]+', 0, 16),
  (3, 'pem', '-----BEGIN [A-Z ]*PRIVATE KEY-----', 0, 0),
  (4, 'jwt', 'eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}', 0, 0),
  (5, 'repo', 'gh[opsu]_[A-Za-z0-9]{30,}', 0, 0), (6, 'chat', 'xox[abprs]-[A-Za-z0-9-]{10,}', 0, 0),
  (7, 'url', '[a-z]{2,10}://[A-Za-z0-9._-]+:[A-Za-z0-9._~-]+@', 0, 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
x AS (SELECT r, ord, kind, pattern, g, least,
  CASE WHEN ord = 0 THEN translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE t END AS t FROM d, k),
m AS (SELECT r, ord, kind, least, generate_subscripts(ms, 1) AS i, unnest(ms) AS w, unnest(gs) AS gw, unnest(gaps[1:len(ms)]) AS gap FROM (
  SELECT r, ord, kind, least, regexp_extract_all(t, pattern, 0) AS ms, regexp_extract_all(t, pattern, g) AS gs, regexp_split_to_array(t, pattern) AS gaps FROM x)),
p AS (SELECT *, sum(length(gap) + length(w)) OVER (PARTITION BY r, ord ORDER BY i ROWS UNBOUNDED PRECEDING) AS e FROM m),
s AS (SELECT r, ord, e - length(w) AS b, concat(kind, ':', (e - length(w))::BIGINT, ':', e::BIGINT) AS one FROM p WHERE length(gw) >= least),
a AS (SELECT r, count(*) FILTER (ord = 0) AS n0, count(*) FILTER (ord = 1) AS n1, count(*) FILTER (ord = 2) AS n2,
  string_agg(one, ',' ORDER BY b, ord) FILTER (ord < 3) AS base, string_agg(one, ',' ORDER BY b, ord) AS spans FROM s GROUP BY r)
SELECT doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (r)
"""


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    histograms = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("shot_id"), F.col("embedding").alias("hist"))
    out = whitening.whiten_histograms(histograms)
    # A deviation beyond 64 bits has no long.
    deviation = F.col("deviation").try_cast("long").alias("deviation")
    return out.select(F.col("shot_id").alias("vec_id"), "component", "n", deviation, "whitened", "explained", "identity_error")


QUERIES["op13_embedding_whitening"] = op13_embedding_whitening


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations")
    log = conversations.select(F.col("conv_id").alias("project_id"), F.col("turn").alias("seq"), F.col("role").alias("action"), F.col("text").alias("target"))
    conv = F.col("conv_id")
    shared = F.crc32(conv.cast("string").cast("binary")) % 9
    forks = conversations.select(conv.alias("project_id"), (conv - conv % 5).alias("base_id"), shared.alias("shared")).distinct()
    out = histories.history_tree(log, forks)
    return out.select(
        F.col("project_id").alias("conv_id"), "depth", F.col("parent_project_id").alias("parent_conv_id"), F.col("n_projects").alias("n_convs"),
        "n_children", "n_leaves", F.col("saved_bytes").alias("saved_tokens"), "ends_sha256",
    )


QUERIES["op12_conversation_prefix_trie"] = op12_conversation_prefix_trie
CHECKS["op12_conversation_prefix_trie"] = r"""
WITH RECURSIVE ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
-- CRC-32 of the decimal id, bit by bit: every eighth round takes the next character in.
crc(c, i, x) AS (SELECT c, 0, 4294967295::BIGINT FROM ids UNION ALL
  SELECT c, i + 1, CASE WHEN y % 2 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END FROM (
    SELECT c, i, CASE WHEN i % 8 = 0 THEN xor(x, ascii(substr(c::VARCHAR, (i // 8 + 1)::BIGINT, 1))::BIGINT) ELSE x END AS y FROM crc WHERE i < 8 * length(c::VARCHAR))),
f AS (SELECT c, c - c % 5 AS b, xor(x, 4294967295) % 9 AS h FROM crc WHERE i = 8 * length(c::VARCHAR)),
t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p FROM conversations WHERE conv_id IS NOT NULL),
u AS (SELECT f.c, p, role, text FROM f JOIN t ON t.c = f.b WHERE p < h UNION ALL SELECT f.c, p, role, text FROM f JOIN t ON t.c = f.c WHERE p >= h),
s AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY p) AS d, md5(concat(length(role), ':', role, ':', text)) AS k, octet_length(encode(text)) AS size FROM u),
paths AS (SELECT c, 0 AS d, '' AS path, 0 AS size FROM ids UNION ALL
  SELECT c, d, string_agg(k, '') OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS path, size FROM s),
last AS (SELECT c, max(d) AS n FROM paths GROUP BY c),
node AS (SELECT path, max(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(size) AS size, max(n) = max(d) AS leaf,
  string_agg(c, ',' ORDER BY c) FILTER (n = d) AS ends FROM paths JOIN last USING (c) GROUP BY path),
below AS (SELECT path[1:32 * k] AS path, sum(leaf::INT) AS n_leaves, sum((n_convs - 1) * size) AS saved FROM (
  SELECT *, unnest(range(0, depth + 1)) AS k FROM node) GROUP BY 1),
kids AS (SELECT path[1:32 * (depth - 1)] AS path, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1)
SELECT node.conv_id, node.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, node.n_convs::BIGINT AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
  n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(node.ends, '')) AS ends_sha256
FROM node JOIN below USING (path) LEFT JOIN kids USING (path)
  LEFT JOIN node up ON node.depth > 0 AND up.path = node.path[1:32 * (node.depth - 1)]
"""
