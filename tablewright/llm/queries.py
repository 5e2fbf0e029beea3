"""The registered queries of this subpackage, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import centroids, fingerprint, jaccard, language, licenses, mixing, neardup, negatives, packing, pieces, quality, transcripts, warc
from tablewright.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_table(documents(spark, sf_dir))


def op2_pack_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op3_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.recover(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.tokenise(documents(spark, sf_dir))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), settings=neardup.Settings(shingle=4))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(documents(spark, sf_dir))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(documents(spark, sf_dir))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archived(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    relabel = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    rows = negatives.taking_part(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", "label", 256, relabel)
    return negatives.mine(rows, F.col("id") % 100 == 0)


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(documents(spark, sf_dir))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("compared")


QUERIES: dict[str, Query] = {
    "op1_quality_bands": op1_quality_bands,
    "op2_pack_ids": op2_pack_ids,
    "op3_transcripts": op3_transcripts,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_license_scan": op5_license_scan,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_mix_sources": op7_mix_sources,
    "op8_fingerprints": op8_fingerprints,
    "op9_warc": op9_warc,
    "op10_language": op10_language,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_jaccard_join": op12_jaccard_join,
    "op13_centroids": op13_centroids,
}

_LINKED_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' ')) END) AS sh FROM d),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS sh FROM s),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.sh = b.sh AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT DISTINCT a AS node, a AS seen FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.seen),
label AS (SELECT node, min(seen) AS label FROM reach GROUP BY node)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, coalesce(label, doc_id) AS component_id{more}
FROM s LEFT JOIN label ON node = doc_id"""
OP6_SQL = _LINKED_SQL.format(k=4, more=", coalesce(label, doc_id) = doc_id AS kept")
OP12_SQL = _LINKED_SQL.format(k=5, more="")

OP7_SQL = """
WITH RECURSIVE sizes AS (SELECT coalesce(source, '') AS source, count(*) AS n FROM documents GROUP BY 1),
u AS (SELECT source, CAST(greatest(1, floor(1000 * sqrt(n) / (SELECT sum(sqrt(n)) FROM sizes) + 0.5)) AS INT) AS units FROM sizes),
w AS (SELECT list(units ORDER BY source) AS us, list(source ORDER BY source) AS names, CAST(sum(units) AS BIGINT) AS period, count(*) AS n FROM u),
edf AS (
  SELECT -1 AS t, list_transform(us, lambda x: 0) AS done, 0 AS k FROM w
  UNION ALL
  SELECT t + 1, list_transform(done, lambda c, i: c + CASE WHEN i = best THEN 1 ELSE 0 END), best
  FROM (SELECT t, done, list_min(list_transform(range(1, n + 1), lambda i:
          CASE WHEN done[i] < us[i] AND done[i] * period // us[i] <= t + 1
               THEN ((done[i] + 1) * period + us[i] - 1) // us[i] * 100000 + i END)) % 100000 AS best
        FROM edf, w WHERE t + 1 < period)),
slots AS (SELECT names[k] AS source, t AS in_period, row_number() OVER (PARTITION BY k ORDER BY t) - 1 AS turn FROM edf, w WHERE t >= 0),
r AS (
  SELECT doc_id, coalesce(source, '') AS source,
         row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5('7:' || doc_id), doc_id) - 1 AS rank
  FROM (SELECT DISTINCT doc_id, source FROM documents)),
b AS (SELECT r.*, units, rank // 16 AS block, period FROM r JOIN u USING (source), w)
SELECT doc_id, b.source, units, CAST(block AS BIGINT) AS block, CAST(rank % 16 AS INT) AS place,
       CAST(block * period // units AS BIGINT) AS released,
       CAST(((block + 1) * period + units - 1) // units AS BIGINT) AS due,
       CAST(block // units * period + in_period AS BIGINT) AS slot
FROM b JOIN slots ON slots.source = b.source AND slots.turn = block % units"""

OP9_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keep FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keep THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keep THEN keep END AS refers_to
FROM r"""


OP11_SQL = """
WITH e AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
s AS (
  SELECT a.id AS anchor, e.id, a.label = e.label AS same, CAST(list_sum(list_transform(list_zip(a.v, e.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e a JOIN e ON a.id % 100 = 0 AND e.id <> a.id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.anchor AS anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id) AS r
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(r AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE r <= 10"""


def _op13_sql(k: int = 8, rounds: int = 10, dim: int = 64) -> str:
    """Rounds of exact nearest centroids and floors of means, one after another."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (
  SELECT vec_id, v, c, d FROM (
    SELECT vec_id, k.v, c, list_sum(list_transform(list_zip(k.v, c{i}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM k, c{i})
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)""")
        if i < rounds:
            steps.append(f"""
s{i} AS (
  SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM a{i}, range(1, {dim + 1}) t(i) GROUP BY c, i),
c{i + 1} AS MATERIALIZED (
  SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{i} GROUP BY c
  UNION ALL SELECT c, v FROM c{i} WHERE c NOT IN (SELECT c FROM a{i}))""")
    return f"""
WITH k AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: isfinite(x))) = {dim}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, v FROM k ORDER BY sha256('3:' || vec_id) LIMIT {k}),{','.join(steps)}
SELECT vec_id, CAST(a.c AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(f.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} f ON f.c = a.c"""


SQL: dict[str, str] = {"op6_near_duplicates": OP6_SQL, "op7_mix_sources": OP7_SQL, "op9_warc": OP9_SQL, "op11_hard_negatives": OP11_SQL, "op12_jaccard_join": OP12_SQL, "op13_centroids": _op13_sql()}
