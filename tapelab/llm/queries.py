"""The operators of this subpackage as runnable queries over the given tables, with SQL twins where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapelab.llm import (bin_completion, exact_dedup, language_id, lexical_search, line_dedup, mixing, ngram_join, packing, periodic_runs, pii, quality,
                         tokens, topk, wavelet)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op2_exact_dedup", r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)
""")
def op2(spark, sf_dir):
    return exact_dedup.dedup(_table(spark, sf_dir, "documents"))


@query("op3_packing")
def op3(spark, sf_dir):
    return packing.digest(_table(spark, sf_dir, "documents"), tokens.tokenizer_path("word_bpe_49k.json"))


@query("op4_line_dedup", r"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                      generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
keyed AS (SELECT doc_id, i, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
held AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
cut AS (SELECT a.doc_id, a.i, a.line, h.k IS NOT NULL AND a.doc_id <> h.keeper AS gone FROM keyed a LEFT JOIN held h ON a.k = h.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM cut GROUP BY doc_id
""")
def op4(spark, sf_dir):
    return line_dedup.digest(_table(spark, sf_dir, "documents"))


@query("op5_mixing", r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, coalesce(text, '') AS t FROM documents),
q AS (SELECT doc_id, source, size, 0.1::DOUBLE + CASE WHEN length(t) = 0 THEN 0.0::DOUBLE ELSE
             (length(t) - length(regexp_replace(t, '[a-z\x{80}-\x{10FFFF}]+', '', 'g')))::DOUBLE / length(t) END AS quality,
             (('0x' || substr(md5('11:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT + 1)::DOUBLE / 281474976710656.0::DOUBLE AS u FROM d),
k AS (SELECT doc_id, source, size, -ln(u) / quality AS key FROM q),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
r AS (SELECT source, source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s),
f AS (SELECT *, (source_size * 2)::DOUBLE AS capacity,
             (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum((source_size * 2)::DOUBLE) OVER b, 0))
             / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
      FROM r WINDOW b AS (ORDER BY source_size * 2 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source, source_size, CASE WHEN capacity < level * weight THEN capacity ELSE
             least(capacity, max(level) FILTER (NOT capacity < level * weight) OVER () * weight) END AS target FROM f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM g)
SELECT k.doc_id, k.size, e.source_size, e.target, (e.epochs * k.size + greatest(0, least(k.size, round(e.target - e.epochs * e.source_size)::BIGINT
       - coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))))::BIGINT AS taken
FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
""")
def op5(spark, sf_dir):
    return mixing.digest(_table(spark, sf_dir, "documents"))


@query("op6_topk", r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS w FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 5
""")
def op6(spark, sf_dir):
    return topk.digest(_table(spark, sf_dir, "embeddings"))


@query("op8_wavelet")
def op8(spark, sf_dir):
    return wavelet.digest(_table(spark, sf_dir, "documents"), tokens.tokenizer_path("byte_bpe_50k.json"))


@query("op10_language_id")
def op10(spark, sf_dir):
    return language_id.identify(_table(spark, sf_dir, "documents"))


@query("op1_ngram_join", r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
e AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id WHERE r.root < e.y)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id
FROM s JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) c ON s.doc_id = c.doc_id
""")
def op1(spark, sf_dir):
    return ngram_join.group(_table(spark, sf_dir, "documents"), k=3, num=90)


@query("op9_quality")
def op9(spark, sf_dir):
    return quality.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query("op7_pii")
def op7(spark, sf_dir):
    return pii.digest(_table(spark, sf_dir, "documents"))


@query("op11_periodic_runs")
def op11(spark, sf_dir):
    return periodic_runs.digest(_table(spark, sf_dir, "documents"))


@query("op12_lexical_search", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
c AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
i AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark)
      GROUP BY item_id, t),
p AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM i) GROUP BY doc_id, n, t),
f AS (SELECT t, count(*) AS df FROM p GROUP BY t),
g AS (SELECT p.doc_id, p.t, (floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT
             * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * n_docs) // n_terms)))))::BIGINT AS gain
      FROM p JOIN f ON p.t = f.t CROSS JOIN c),
s AS (SELECT item_id, doc_id, sum(times * gain)::BIGINT AS score FROM i JOIN g ON i.t = g.t GROUP BY item_id, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10
""")
def op12(spark, sf_dir):
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query("op13_best_fit_packing")
def op13(spark, sf_dir):
    return bin_completion.digest(_table(spark, sf_dir, "documents"), tokens.tokenizer_path("word_bpe_49k.json"))


@query("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
