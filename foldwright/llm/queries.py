"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.llm import licenses, periodic_runs
from foldwright.llm.common import SQL_CRC32, read, vocabulary
from foldwright.llm.embedding_dedup import embedding_dedup
from foldwright.llm.exact_dedup import exact_dedup
from foldwright.llm.hard_negatives import mine_negatives, shifted_label
from foldwright.llm.language_id import language_of_documents
from foldwright.llm.mixing import mix_sources
from foldwright.llm.near_dedup import near_dedup
from foldwright.llm.piece_codec import round_trip
from foldwright.llm.pitman_yor import language_model_scores
from foldwright.llm.repeated_spans import remove_repeats
from foldwright.llm.token_files import token_summary
from foldwright.llm.toxicity import toxicity_of_documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


@query(
    "op3_exact_dedup",
    r"""
    WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
    SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
           doc_id = min(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
    FROM d
    """,
)
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


@query("op6_mix_sources")
def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


@query("op1_merge_dropout")
def op1_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@query("op2_language_mixture")
def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_of_documents(read(spark, sf_dir, "documents"))


@query("op7_orc_tokens")
def op7_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_summary(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query(
    "op10_vector_duplicates",
    """
    WITH RECURSIVE
    v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
    u AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND list_bool_and([coalesce(isfinite(x), false) FOR x IN e]) AND list_bool_or([x <> 0 FOR x IN e])),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
    reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
    least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
    degree AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
    SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
    FROM v JOIN least USING (vec_id) LEFT JOIN degree USING (vec_id)
    """,
)
def op10_vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(read(spark, sf_dir, "embeddings"))


@query("op8_license_digests", licenses.oracle())
def op8_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(read(spark, sf_dir, "documents"))


@query(
    "op4_near_duplicates",
    r"""
    WITH RECURSIVE
    w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w] ELSE [w[i:i+4] FOR i IN range(1, len(w) - 3)] END) AS g FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
              GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
    least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM least LEFT JOIN n USING (doc_id)
    """,
)
def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read(spark, sf_dir, "documents"))


@query("op5_toxicity_channel")
def op5_toxicity_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_of_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query(
    "op9_repeated_spans",
    """
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
    c AS (SELECT doc_id, n, j, substr(x, 1024 * j + 1, 1122) AS y FROM (SELECT doc_id, x, n, unnest(range(0, (n + 462) // 512)) AS j FROM d WHERE n >= 50)),
    w AS (SELECT doc_id, 512 * j + k AS i, substr(y, 2 * k + 1, 100) AS s FROM (SELECT doc_id, j, y, unnest(range(0, least(512, n - 49 - 512 * j))) AS k FROM c)),
    m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
    g AS (SELECT w.doc_id, w.i FROM w JOIN m USING (s) WHERE m.least < w.doc_id),
    r AS (SELECT doc_id, i, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -100) > 50 AS fresh FROM g),
    q AS (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r),
    s AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM q GROUP BY doc_id, run),
    k AS (SELECT doc_id, run, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY run), 0) AS from_ FROM s),
    t AS (SELECT d.doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans,
                 string_agg(substr(x, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY run) || substr(max(x), 2 * max(b) + 1) AS kept
          FROM k JOIN d ON k.doc_id = d.doc_id GROUP BY d.doc_id)
    SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
    FROM d LEFT JOIN t ON d.doc_id = t.doc_id
    """,
)
def op9_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"))


@query(
    "op13_periodic_runs",
    r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, CRC AS h FROM documents),
    p AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS tail, (h // 10) % greatest(len(w), 1) AS a, 1 + (len(w) - (h // 10) % greatest(len(w), 1)) // (3 + (h // 10) % 8) AS p FROM d),
    t AS (SELECT doc_id, CASE WHEN tail THEN [w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] FOR i IN range(n)] ELSE w END AS w, n FROM p),
    -- equal stretches of 16 words at distance q: every run has one
    g AS (SELECT doc_id, n, unnest(range(greatest(n - 15, 0))) AS i, unnest([hash(list_slice(v, i + 1, i + 16)) FOR i IN range(greatest(n - 15, 0))]) AS g FROM (SELECT *, [hash(x) FOR x IN w] AS v FROM t)),
    e AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM g x JOIN g y ON x.doc_id = y.doc_id AND x.g = y.g AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
    s AS (SELECT doc_id, q, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island, i FROM e),
    r AS (SELECT doc_id, min(i) AS start, count(*) + 15 + q AS length, q FROM s GROUP BY doc_id, q, island HAVING count(*) + 15 + q >= greatest(24, 3 * q)),
    m AS (SELECT doc_id, start, length, min(q) AS period FROM r GROUP BY doc_id, start, length),
    c AS (SELECT t.doc_id, w, n, coalesce(runs, []) AS runs, coalesce(n_runs, 0) AS n_runs, best, coalesce(said, '') AS said
          FROM t LEFT JOIN (SELECT doc_id, list({'a': start + period, 'b': start + length}) AS runs, count(*) AS n_runs,
                                   first({'start': start, 'length': length, 'period': period} ORDER BY length / period DESC, start, period) AS best,
                                   string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS said
                            FROM m GROUP BY doc_id) f ON f.doc_id = t.doc_id)
    SELECT doc_id, n_runs, best.start AS start, best.length AS length, best.period AS period, best.length * 1000 // best.period AS exponent_milli, sha256(said) AS runs_sha256,
           sha256(CASE WHEN n_runs = 0 THEN array_to_string(w, ' ')
                       ELSE array_to_string([w[i + 1] FOR i IN range(n) IF len(list_filter(runs, lambda r: i >= r.a AND i < r.b)) = 0], ' ') END) AS collapsed_sha256
    FROM c
    """.replace("CRC", SQL_CRC32.format("doc_id")),
)
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.repeat_tails(read(spark, sf_dir, "documents"))
    return periodic_runs.summarize(periodic_runs.periodic_runs(docs))


@query(
    "op11_hard_negatives",
    """
    WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
    u AS (SELECT vec_id, label, [floor(256 * x)::BIGINT FOR x IN e] AS i FROM v WHERE list_bool_and([coalesce(isfinite(x), false) FOR x IN e])),
    s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_sum([a.i[k] * b.i[k] FOR k IN range(1, len(a.i) + 1)])::BIGINT AS score FROM u a JOIN u b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
    p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
    n AS (SELECT p.a, p.b, p.score AS positive_score, s.b AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank
          FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
    SELECT a AS anchor_id, b AS positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
    """,
)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_negatives(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, shifted_label())


@query("op12_pitman_yor")
def op12_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(read(spark, sf_dir, "documents"))
