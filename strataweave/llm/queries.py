"""The registered queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.llm import (
    block_naming,
    crf_language,
    cross_entropy,
    debruijn,
    geometric_kmeans,
    host_reputation,
    mixing,
    odd_sketch,
    ordinal_toxicity,
    rtree_negatives,
    simhash_tiles,
    template_leaks,
    warc_zstd,
)

JOBS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
TOXIC_FROM = 0.5  # documents with at least this probability of a grade above 0 are rejected


def query(name: str, sql: str | None = None):
    def add(job):
        JOBS[name] = job
        if sql is not None:
            SQL[name] = sql
        return job

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_crf_language")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = crf_language.identify(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", crf_language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score",
        F.size("spans").alias("n_runs"),
    )


@query("op2_template_leaks")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_leaks.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad): a page shows the document whose id is the first number in its url; bad if junk or toxic."""
    shown = pages.select("url", F.expr(r"try_cast(regexp_extract(url, '/([0-9]+)', 1) AS bigint)").alias("shown"))
    bad: Column = (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False)))
    known = labels.where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)")
    return shown.join(known.select(F.col("doc_id").alias("shown"), bad.cast("int").alias("bad")), "shown").select("url", "bad")


_STRENGTH_SQL = """
    SELECT coalesce(least(greatest(1 / greatest((sum(power(bad - n * prior, 2) / n) - sum(prior * (1 - prior)))
        / greatest(sum((n - 1) * prior * (1 - prior)), 1e-12), 1e-12) - 1, 1.0), 1000.0), 1000.0) AS s FROM {0}"""
OP3_SQL = rf"""
WITH page AS (
    SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
    FROM pages),
named AS (SELECT *, array_to_string(string_split(host, '.')[-2:], '.') AS dom, string_split(host, '.')[-1] AS suf FROM page),
counts AS (
    SELECT host, dom, suf, count(*) AS n,
        sum(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END)::BIGINT AS bad
    FROM named JOIN labels ON labels.doc_id = try_cast(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT)
    WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY ALL),
total AS (SELECT (coalesce(sum(bad), 0) + 1.0) / (coalesce(sum(n), 0) + 2.0) AS rate FROM counts),
s0 AS (SELECT suf, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad, any_value(rate) AS prior FROM counts, total GROUP BY suf),
s1 AS ({_STRENGTH_SQL.format("s0")}),
sufs AS (SELECT suf, s * prior + bad AS a, s * (1 - prior) + n - bad AS b FROM s0, s1),
d0 AS (SELECT dom, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad, any_value(a / (a + b)) AS prior
    FROM counts JOIN sufs USING (suf) GROUP BY dom),
d1 AS ({_STRENGTH_SQL.format("d0")}),
doms AS (SELECT dom, s * prior + bad AS a, s * (1 - prior) + n - bad AS b FROM d0, d1),
h0 AS (SELECT host, n, bad, a / (a + b) AS prior FROM counts JOIN doms USING (dom)),
h1 AS ({_STRENGTH_SQL.format("h0")}),
hosts AS (SELECT host, s * prior + bad AS a, s * (1 - prior) + n - bad AS b FROM h0, h1),
judged AS (
    SELECT page_id, named.host, path,
        coalesce(hosts.a, doms.a, sufs.a, rate) AS a, coalesce(hosts.b, doms.b, sufs.b, 1 - rate) AS b
    FROM named CROSS JOIN total LEFT JOIN hosts ON hosts.host = named.host
    LEFT JOIN doms ON doms.dom = named.dom LEFT JOIN sufs ON sufs.suf = named.suf),
ruled AS (
    SELECT *, CASE
        WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
    FROM judged)
SELECT page_id, host, path, rule, CASE rule WHEN 'example.net/en/' THEN 'allow' WHEN 'example.com/de/' THEN 'block'
    WHEN 'org/fr/' THEN 'allow' WHEN 'net/' THEN 'block'
    ELSE CASE WHEN a / (a + b) - {host_reputation.Z} * sqrt((a / (a + b)) * (1 - a / (a + b)) / (a + b + 1))
        > {host_reputation.LIMIT} THEN 'block' ELSE 'allow' END END AS verdict
FROM ruled"""


@query("op3_host_reputation", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    outcomes = page_outcomes(pages, table(spark, sf_dir, "labels"))
    return host_reputation.judge_urls(pages, outcomes, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS MATERIALIZED (
    SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS s
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
size AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ AS MATERIALIZED (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id
    GROUP BY ALL),
link AS MATERIALIZED (
    SELECT a, b FROM both_ JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
    WHERE 100 * both_.n >= 80 * (x.n + y.n - both_.n)),
reach AS (
    SELECT a AS id, a AS seen FROM link
    UNION
    SELECT reach.id, link.b FROM reach JOIN link ON link.a = reach.seen),
low AS (SELECT id, min(seen) AS component FROM reach GROUP BY id)
SELECT w.doc_id, coalesce(size.n, 0) AS n_shingles, coalesce(component, w.doc_id) AS component_id,
    coalesce(component, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN size ON size.doc_id = w.doc_id LEFT JOIN low ON low.id = w.doc_id"""


@query("op4_odd_sketch", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_sketch.near_duplicates(table(spark, sf_dir, "documents"), n=4, percent=80)


OP5_SQL = """
WITH r AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
    FROM pages),
o AS (SELECT payload_digest, max(page_id) AS owner FROM r WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN owner IS NULL OR owner = page_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN owner <> page_id THEN owner END AS refers_to
FROM r LEFT JOIN o USING (payload_digest)"""


@query("op5_warc_zstd", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rows = pages.select(F.col("page_id").alias("id"), "url", F.col("html").cast("binary").alias("payload"))
    read = warc_zstd.round_trip(rows)
    size = F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("long")).otherwise(F.col("payload_bytes"))
    return read.select(
        F.col("id").alias("page_id"), size.alias("payload_bytes"), "payload_digest", "record_type", "refers_to"
    )


OP6_SQL = r"""
WITH w AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (
    SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS s
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w)),
later AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM win),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM later WHERE r > 1),
word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS j, unnest(ws) AS word FROM w),
kept AS (
    SELECT word.doc_id, string_agg(word, ' ' ORDER BY word.j) AS text, count(*) AS n
    FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.j = word.j WHERE gone.j IS NULL GROUP BY word.doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id"""


@query("op6_debruijn", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = debruijn.remove_repeats(table(spark, sf_dir, "documents"), k=20)
    return found.select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


@query("op7_cross_entropy")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id")
    return cross_entropy.score(table(spark, sf_dir, "documents"), targets)


@query("op8_ordinal_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = ordinal_toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = ordinal_toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", "severity", "p_toxic", (F.col("p_toxic") >= TOXIC_FROM).alias("rejected"))


OP9_SQL = """
WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size,
    doc_id = max(doc_id) OVER (PARTITION BY text) AS kept, text_sha256
FROM t"""


@query("op9_block_naming", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_naming.exact_groups(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH d AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
        ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (
    SELECT source, sum(size)::BIGINT AS source_size,
        [3, 1, 2][1 + ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3)::INT]::DOUBLE AS weight
    FROM d GROUP BY source),
o AS (
    SELECT *, 1.5 * sum(source_size) OVER () AS budget, row_number() OVER ascending AS k,
        coalesce(sum(2 * source_size) OVER before, 0) AS fixed,
        sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS left_
    FROM s WINDOW ascending AS (ORDER BY 2 * source_size / weight, source NULLS LAST),
        before AS (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT arg_min((budget - fixed) / left_, k) AS rate FROM o WHERE (budget - fixed) / left_ * weight <= 2.0 * source_size),
t AS (SELECT source, source_size, least(rate * weight, 2.0 * source_size) AS target,
    CASE WHEN source_size > 0 THEN floor(least(rate * weight, 2.0 * source_size) / source_size)::INT ELSE 0 END AS base
    FROM s, r),
c AS (
    SELECT d.*, source_size, target, base, target - base * source_size AS budget,
        sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
g AS (SELECT *, upto - sum(size) OVER (PARTITION BY source, h) AS below FROM c)
SELECT doc_id, size, source_size, target,
    (size * (base + CASE WHEN upto <= budget OR (below <= budget AND upto - budget < budget - below) THEN 1 ELSE 0 END))::BIGINT
    AS taken
FROM g"""


@query("op10_mixing", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP11_SQL = """
WITH e AS MATERIALIZED (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND list_sum(list_transform(embedding, lambda x: CASE WHEN isfinite(x) THEN 0 ELSE 1 END)) = 0),
s AS MATERIALIZED (
    SELECT a.vec_id AS anchor_id, e.vec_id, a.label = e.label AS same, list_inner_product(a.v, e.v)::BIGINT AS score
    FROM e AS a JOIN e ON a.vec_id <> e.vec_id WHERE a.vec_id % 100 = 0),
p AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5"""


@query("op11_rtree_negatives", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", moved.alias("label"), geometric_kmeans.grid(F.col("embedding"), 256).alias("v"))
    return rtree_negatives.mine(rows, F.col("vec_id") % 100 == 0)


def kmeans_sql(k: int, rounds: int) -> str:
    """Lloyd's rounds as one chain of tables: (vec_id, j, x) against (c, j, x)."""
    parts = [f"""
WITH v AS MATERIALIZED (
    SELECT vec_id, unnest(range(64)) AS j, unnest(list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT)) AS x
    FROM embeddings WHERE len(embedding) = 64
        AND list_sum(list_transform(embedding, lambda x: CASE WHEN isfinite(x) THEN 0 ELSE 1 END)) = 0),
start AS (
    SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c FROM (SELECT DISTINCT vec_id FROM v)
    QUALIFY c < {k}),
c0 AS MATERIALIZED (SELECT c, j, x FROM start JOIN v USING (vec_id))"""]
    for r in range(rounds + 1):
        parts.append(f"""
a{r} AS MATERIALIZED (
    SELECT vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
        SELECT vec_id, c, sum((v.x - c{r}.x) * (v.x - c{r}.x))::BIGINT AS d FROM v JOIN c{r} USING (j) GROUP BY vec_id, c)
    GROUP BY vec_id)""")
        if r < rounds:
            parts.append(f"""
m{r} AS (
    SELECT c, j, sum(x)::BIGINT AS s, count(*) AS n FROM v JOIN a{r} USING (vec_id) GROUP BY c, j),
c{r + 1} AS MATERIALIZED (
    SELECT c, j, CASE WHEN n IS NULL THEN x ELSE (s - ((s % n) + n) % n) // n END AS x
    FROM c{r} LEFT JOIN m{r} USING (c, j))""")
    return ",".join(parts) + f"""
SELECT vec_id, c::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia,
    sum(d) OVER ()::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY j)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
    USING (c)"""


@query("op12_geometric_kmeans", kmeans_sql(8, 10))
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64)
    rows = whole.select("vec_id", geometric_kmeans.grid(F.col("embedding"), 1024).alias("v")).where("v IS NOT NULL")
    return geometric_kmeans.kmeans(rows, k=8, rounds=10, seed=3, dim=64)


@query("op13_simhash_tiles")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_tiles.near_duplicates(table(spark, sf_dir, "documents"), n=3, radius=3)
