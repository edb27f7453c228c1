"""One query an operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import held_out, read_table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.langid import identify

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    train = docs.filter(~held_out("doc_id"))
    return identify(docs, train).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.exactdedup import exact_duplicates

    return exact_duplicates(read_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.toxicity import score_toxicity

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, docs.filter(~held_out("doc_id")), read_table(spark, sf_dir, "labels").filter(~held_out("doc_id")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.suffixdedup import repeated_substrings

    return repeated_substrings(read_table(spark, sf_dir, "documents"), span=50).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.decontam import contamination

    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.htmlextract import extract

    return extract(read_table(spark, sf_dir, "pages"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.substrdedup import repeated_windows

    return repeated_windows(read_table(spark, sf_dir, "documents"), width=35).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.packing import pack

    return pack(read_table(spark, sf_dir, "documents"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.simhash import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"), width=3, seed=42)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.urlfilter import RULES, judge_urls

    return judge_urls(read_table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict", "score")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.centroids import cluster

    return cluster(read_table(spark, sf_dir, "embeddings"))


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.phrases import collocations

    return collocations(read_table(spark, sf_dir, "documents"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.licences import scan_licences

    return scan_licences(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_exact_dedup,
        op3_toxicity,
        op4_suffix_array_dedup,
        op5_benchmark_decontamination,
        op6_html_extraction,
        op7_substring_dedup,
        op8_curve_packing,
        op9_simhash_near_dedup,
        op10_url_filter,
        op11_centroid_clustering,
        op12_phrase_mining,
        op13_license_scan,
    )
}



def _centroid_sql(k: int = 16, rounds: int = 3) -> str:
    """Lloyd's rounds one after the other: each a nearest centroid by exact distance and a floor of each mean."""
    floor = "(((s - ((s % n) + n) % n)) // n)::BIGINT"
    steps = [
        f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS p FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, p AS q FROM v ORDER BY sha256('1:' || vec_id) LIMIT {k})"""
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, p, arg_min(c, (d, c)) AS c, min(d) AS d
  FROM (SELECT vec_id, p, c, list_sum(list_transform(list_zip(p, q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{r}) GROUP BY vec_id, p)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(m.q, c{r}.q) AS q FROM c{r} LEFT JOIN (
  SELECT c, list({floor} ORDER BY i) AS q FROM (SELECT c, i, sum(p[i])::HUGEINT AS s, count(*) AS n FROM a{r}, range(1, 65) AS t(i) GROUP BY c, i) GROUP BY c) m ON m.c = c{r}.c)""")
    return (
        "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, a.c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(q, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} USING (c)"""
    )


ORACLE: dict[str, str] = {
    "op11_centroid_clustering": _centroid_sql(),
    "op12_phrase_mining": r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS ws FROM d),
g AS (SELECT lang, size, array_to_string(ws[i:i + size - 1], ' ') AS phrase FROM (SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM p, (VALUES (1), (2), (3)) AS s(size))),
f AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1 AND f >= 10),
k AS (SELECT lang, size, phrase, a, k, array_to_string(ws[:k], ' ') AS lp, array_to_string(ws[k + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
s AS (SELECT k.lang, k.phrase, a, l.f AS l, r.f AS r, k, ((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f))::BIGINT AS score FROM k JOIN f l ON l.lang = k.lang AND l.phrase = lp JOIN f r ON r.lang = k.lang AND r.phrase = rp),
b AS (SELECT lang, phrase, arg_min(struct_pack(a, l, r, score), (score, k)) AS b FROM s GROUP BY lang, phrase),
o AS (SELECT lang, phrase, max(a) AS longest FROM (SELECT lang, a, array_to_string(ws[i:i + 1], ' ') AS phrase FROM (SELECT *, unnest([1, 2]) AS i FROM c WHERE size = 3)) GROUP BY lang, phrase),
t AS (SELECT b.lang, b.phrase, b.b.a AS a, b.b.l AS l, b.b.r AS r, b.b.score AS score FROM b LEFT JOIN o USING (lang, phrase) WHERE longest IS NULL OR 100 * longest < 50 * b.b.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM t) JOIN n USING (lang) WHERE rank <= 2000
""",
    "op2_exact_dedup": """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
""",
}
