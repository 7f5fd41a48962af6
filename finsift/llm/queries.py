"""The queries ``opN_<name>``: each applies one operator, with production
parameters, to its whole table and returns the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_plan, word_count

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count().alias("size"))
    plan = mix_plan(docs).withColumn("row", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return plan.select("doc_id", "size", F.col("source_size").cast("long"), "target", (F.col("copies") * F.col("size")).alias("taken"))


def op2_shard_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    out = shard(table(spark, sf_dir, "documents").select("doc_id", "text"), 8, keep_text=False)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import private_data

    return private_data(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("found")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import held_out, score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return out.select("doc_id", "n_lines", "n_removed", F.array_join(F.transform("removed", lambda x: x.cast("string")), ",").alias("removed"))


def op6_similar_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embed_dedup import similar_vectors

    return similar_vectors(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_dedup

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup(docs).select("doc_id", "class_id", "kept")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_index import substring_dedup

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumn("contaminated", F.lit(True))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokens import token_counts

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import held_out, score, statistics, train

    found = statistics(table(spark, sf_dir, "documents").select("doc_id", "text"))
    model = train(found, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return score(found, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import cluster_vectors

    return cluster_vectors(table(spark, sf_dir, "embeddings")).drop("centroid")


QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_shard_bytes, op3_private_data, op4_toxicity, op5_line_dedup, op6_similar_vectors, op7_near_dedup,
        op8_substring_dedup, op9_benchmark_leaks, op10_token_counts, op11_quality, op12_collocations, op13_centroids,
    )
}
ORACLE_SQL: dict[str, str] = {}
ORACLE_SQL["op8_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
least AS (SELECT s, min(doc_id) AS first FROM win GROUP BY s),
cut AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM win JOIN least USING (s) WHERE first < doc_id),
word AS (SELECT doc_id, unnest(ws) AS t, unnest(range(1, len(ws) + 1)) AS k FROM w),
kept AS (SELECT doc_id, string_agg(t, ' ' ORDER BY k) AS kept, count(*) AS n FROM word ANTI JOIN cut USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
ORACLE_SQL["op6_similar_vectors"] = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, CAST((SELECT count(*) FROM links WHERE a = e.vec_id) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept FROM embeddings e JOIN comp ON a = e.vec_id
"""
ORACLE_SQL["op5_line_dedup"] = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL),
w AS (SELECT * FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
d AS (SELECT line, length(line) AS n, min({'d': doc_id, 'p': pos}) AS first FROM w GROUP BY line),
near AS (SELECT DISTINCT b.line FROM d a JOIN d b ON b.n = a.n WHERE a.n >= 10 AND a.first < b.first AND (left(a.line, a.n // 2) = left(b.line, a.n // 2) OR right(a.line, a.n - a.n // 2) = right(b.line, a.n - a.n // 2)) AND levenshtein(a.line, b.line) <= 1
    UNION SELECT DISTINCT CASE WHEN a.first < b.first THEN b.line ELSE a.line END FROM d a JOIN d b ON b.n = a.n + 1
    WHERE a.n >= 10 AND (left(a.line, a.n // 2) = left(b.line, a.n // 2) OR right(a.line, a.n - a.n // 2) = right(b.line, a.n - a.n // 2)) AND levenshtein(a.line, b.line) <= 1),
cut AS (SELECT w.doc_id, w.pos FROM w JOIN d USING (line) LEFT JOIN near USING (line) WHERE near.line IS NOT NULL OR d.first < {'d': w.doc_id, 'p': w.pos}),
gone AS (SELECT doc_id, count(*) AS n, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS removed FROM cut GROUP BY doc_id)
SELECT t.doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(removed, '') AS removed FROM documents t LEFT JOIN gone USING (doc_id)
"""
ORACLE_SQL["op2_shard_bytes"] = r"""
WITH RECURSIVE step AS (SELECT i AS n, i AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
crc AS (SELECT list(CAST(c AS BIGINT) ORDER BY n) AS t FROM step WHERE k = 8),
b AS (SELECT doc_id, list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT))) AS bytes, coalesce(octet_length(encode(text)), 0) + 1 AS size FROM documents),
c AS (SELECT doc_id, CAST(size AS BIGINT) AS size, CASE WHEN bytes IS NOT NULL THEN xor(list_reduce(bytes, lambda a, x: xor(t[CAST((xor(a, x) & 255) + 1 AS INT)], a >> 8)), 4294967295) END AS text_crc32 FROM b, crc),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id) AS e, sum(size) OVER () AS total FROM c),
s AS (SELECT *, CAST(least(7, ((2 * e - size) * 8) // (2 * total)) AS INT) AS shard FROM p)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM s
"""
ORACLE_SQL["op12_collocations"] = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, m, w[i:i + m - 1] AS g FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, range(1, 4) s(m))),
f AS MATERIALIZED (SELECT lang, m, array_to_string(g, ' ') AS p, g, count(*) AS f FROM g GROUP BY lang, m, g),
cand AS MATERIALIZED (SELECT * FROM f WHERE m >= 2 AND f >= 10),
cut AS MATERIALIZED (SELECT *, array_to_string(g[1:k], ' ') AS p1, array_to_string(g[k + 1:m], ' ') AS p2 FROM (SELECT *, unnest(range(1, m)) AS k FROM cand)),
scored AS (SELECT c.lang, c.p AS phrase, c.f AS a, k, x.f AS l, y.f AS r, CAST((1000000::HUGEINT * c.f * c.f) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
    FROM cut c JOIN f x ON x.lang = c.lang AND x.p = p1 JOIN f y ON y.lang = c.lang AND y.p = p2),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
part AS (SELECT lang, array_to_string(g[i:i + j - 1], ' ') AS phrase, f FROM (SELECT lang, m, g, f, j, unnest(range(1, m - j + 2)) AS i FROM cand, range(2, 3) s(j) WHERE j < m)),
longer AS (SELECT lang, phrase, max(f) AS longer FROM part GROUP BY lang, phrase),
kept AS (SELECT b.* FROM best b LEFT JOIN longer USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN total USING (lang) QUALIFY rank <= 2000
"""


def _rounds(rounds: int = 10) -> str:
    """The rounds of clustering, a pair of subqueries each."""
    near = """a{i} AS MATERIALIZED (SELECT vec_id, e, k, d FROM (SELECT v.vec_id, v.e, k, list_sum(list_transform(range(1, 65), lambda j: (e[j] - c[j]) * (e[j] - c[j]))) AS d FROM v, c{i}) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)"""
    moved = """c{j} AS MATERIALIZED (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY p) AS c FROM (SELECT k, p, CAST(sum(x) AS HUGEINT) AS s, count(*) AS n FROM (SELECT k, unnest(e) AS x, unnest(range(1, 65)) AS p FROM a{i}) GROUP BY k, p) GROUP BY k
    UNION ALL SELECT k, c FROM c{i} WHERE k NOT IN (SELECT k FROM a{i}))"""
    return ",\n".join([*(x for i in range(rounds) for x in (near.format(i=i), moved.format(i=i, j=i + 1))), near.format(i=rounds)])


ORACLE_SQL["op13_centroids"] = f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS HUGEINT)) AS e FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INT) AS k, e AS c FROM (SELECT sha256('3:' || vec_id) AS h, e FROM v ORDER BY h LIMIT 8)),
{_rounds()}
SELECT vec_id, k AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a10 JOIN c10 USING (k)
"""
