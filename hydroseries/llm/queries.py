"""The queries of this subpackage, each over its whole table, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroseries.llm.alignment import align_tokens
from hydroseries.llm.common import documents
from hydroseries.llm.dartmin import near_classes
from hydroseries.llm.hyperdim import identify_languages
from hydroseries.llm.latent import find_leaks
from hydroseries.llm.licenses import scan_licenses
from hydroseries.llm.markov import score_texts
from hydroseries.llm.mixing import mix_sources
from hydroseries.llm.phrases import repeated_spans
from hydroseries.llm.sharding import shard_rows
from hydroseries.llm.substrings import repeated_substrings
from hydroseries.llm.tries import exact_groups
from hydroseries.llm.weaklabels import quality_scores
from hydroseries.llm.whitening import whitened_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


@query("op1_weak_label_quality")
def _(spark, sf_dir):
    return quality_scores(documents(spark, sf_dir))


@query("op2_exact_dedup", r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
k AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY norm) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k""")
def _(spark, sf_dir):
    return exact_groups(documents(spark, sf_dir))


@query("op3_license_scan")
def _(spark, sf_dir):
    return scan_licenses(documents(spark, sf_dir))


@query("op4_markov_scores")
def _(spark, sf_dir):
    return score_texts(documents(spark, sf_dir))


@query("op5_benchmark_leaks")
def _(spark, sf_dir):
    return find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op6_language_id")
def _(spark, sf_dir):
    return identify_languages(documents(spark, sf_dir))


@query("op7_source_mix", r"""
WITH r AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5('7:' || doc_id) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM r GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][place % 3 + 1]::DOUBLE AS weight, (2 * source_size)::DOUBLE AS cap FROM s),
o AS (SELECT *, cap / weight AS ratio FROM w),
c AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
             coalesce(sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
             sum(cap) OVER () AS every, sum(weight) OVER () AS weights FROM o),
l AS (SELECT first((every / 2 * 1.5 - capped) / (weights - used) ORDER BY ratio, place) AS level FROM c
      WHERE (every / 2 * 1.5 - capped) / (weights - used) <= ratio),
t AS (SELECT source, source_size, least(cap, coalesce(level, 'inf'::DOUBLE) * weight) AS target FROM o LEFT JOIN l ON true),
b AS (SELECT r.*, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS budget,
             coalesce(sum(size) OVER (PARTITION BY r.source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (coalesce(budget // nullif(source_size, 0), 0) * size
        + greatest(0, least(size, budget - coalesce(budget // nullif(source_size, 0), 0) * source_size - before)))::BIGINT AS taken
FROM b""")
def _(spark, sf_dir):
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


@query("op8_stratified_shards", r"""
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::UBIGINT, list_transform(range(8), lambda z: 0::UBIGINT)),
                    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS t),
b AS (SELECT doc_id, source, octet_length(encode(coalesce(text, '')))::BIGINT + 8 AS size, md5('11:' || doc_id) AS h,
             list_transform(list_filter(string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\1,', 'g'), ','), lambda x: x <> ''),
                            lambda x: ('0x' || x)::UBIGINT) AS bytes FROM documents),
c AS (SELECT doc_id, source, size, h, xor(list_reduce(list_prepend(4294967295::UBIGINT, bytes),
             lambda c, x: xor(t[(xor(c, x) & 255)::BIGINT + 1], c >> 8)), 4294967295::UBIGINT)::BIGINT AS text_crc32 FROM b, tab),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) - 1 AS rank, count(*) OVER (PARTITION BY source) AS n FROM c),
p AS (SELECT *, row_number() OVER (ORDER BY (rank * 2 + 1) / (n * 2), source NULLS LAST, h) - 1 AS place, count(*) OVER () AS every FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, (place * 24 // every)::INTEGER AS shard,
       (place - ((place * 24 // every) * every + 23) // 24)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM p""")
def _(spark, sf_dir):
    return shard_rows(documents(spark, sf_dir))


@query("op9_repeated_phrases", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
v AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) AS h FROM w, unnest(range(1, len(ws) - 48)) u(i)),
f AS (SELECT h, min(doc_id) AS least FROM v GROUP BY h),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM v JOIN f USING (h) WHERE doc_id > least),
k AS (SELECT doc_id, p, ws[p] AS word FROM w, unnest(range(1, len(ws) + 1)) u(p)),
a AS (SELECT k.doc_id, count(g.p) AS n_removed, string_agg(word, ' ' ORDER BY k.p) FILTER (WHERE g.p IS NULL) AS kept
      FROM k LEFT JOIN g ON g.doc_id = k.doc_id AND g.p = k.p GROUP BY k.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN a USING (doc_id)""")
def _(spark, sf_dir):
    return repeated_spans(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op10_near_duplicates")
def _(spark, sf_dir):
    classes = near_classes(documents(spark, sf_dir))
    return classes.select(
        "doc_id", "class_id", "class_size", "n_shingles", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept")
    )


@query("op11_token_alignment")
def _(spark, sf_dir):
    return align_tokens(documents(spark, sf_dir))


@query("op12_repeated_substrings", r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS k FROM d, unnest(range(0, n - 99)) u(i)),
r AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
g AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, true) AS new FROM r),
s AS (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM g),
p AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM s GROUP BY doc_id, span),
q AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM p),
c AS (SELECT q.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last,
             string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM q JOIN d USING (doc_id) GROUP BY q.doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)""")
def _(spark, sf_dir):
    return repeated_substrings(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op13_embedding_whitening")
def _(spark, sf_dir):
    return whitened_rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
