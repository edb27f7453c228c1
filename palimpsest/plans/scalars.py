"""Text, trust, question shape, vector and time functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import ids, shapes, temporal, text, trust, vectors
from palimpsest.plans.common import register, table

_WS = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> '')"
_NORM = "list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[!-/:-@\\[-`{{-~]', ' ', 'g'), '\\s+'), lambda w: w <> '' AND w NOT IN ('a', 'an', 'the'))"


@register("C1_approx_tokens", f"SELECT doc_id, greatest(length(text) // 4, len({_WS.format('text')})) AS tokens FROM documents")
def approx_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.approx_tokens(F.col("text")).alias("tokens"))


@register("C3_normalize", f"SELECT item_id, array_to_string({_NORM.format('text')}, ' ') AS normalized FROM benchmark")
def normalize(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(text.normalize(F.col("text")), " ").alias("normalized"))


@register("C4_token_f1", f"""
WITH p AS (SELECT c.conv_id, c.turn, {_NORM.format('c.text')} AS a, {_NORM.format('b.text')} AS g FROM conversations c JOIN benchmark b ON b.item_id = c.conv_id % 40),
o AS (SELECT conv_id, turn, len(a) AS na, len(g) AS ng, coalesce(list_sum(list_transform(list_distinct(list_intersect(a, g)), lambda w: least(len(list_filter(a, lambda x: x = w)), len(list_filter(g, lambda x: x = w))))), 0) AS n FROM p)
SELECT conv_id, turn, round(CASE WHEN na = 0 OR ng = 0 THEN (na = ng)::INT ELSE 2.0 * n / (na + ng) END, 6) AS f1 FROM o""")
def token_f1(spark, sf):
    gold = table(spark, sf, "benchmark").select(F.col("item_id").alias("k"), F.col("text").alias("gold"))
    rows = table(spark, sf, "conversations").withColumn("k", F.col("conv_id") % 40).join(gold, "k")
    return rows.select("conv_id", "turn", F.round(text.token_f1(F.col("text"), F.col("gold")), 6).alias("f1"))


@register("C10_norms", "SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def norms(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"))


@register("C11_fit_dim", "WITH s AS (SELECT vec_id, (embedding::DOUBLE[])[1:8] AS v FROM embeddings) SELECT vec_id, round(v[1] / sqrt(list_inner_product(v, v)), 6) AS first, round(v[8] / sqrt(list_inner_product(v, v)), 6) AS last FROM s")
def fit_dim(spark, sf):
    fit = vectors.fit_dim(F.col("embedding"), 8)
    return table(spark, sf, "embeddings").select("vec_id", F.round(fit[0], 6).alias("first"), F.round(fit[7], 6).alias("last"))


@register("C12_mean_pool", "WITH s AS (SELECT label, [sum(embedding[1]::DOUBLE), sum(embedding[2]::DOUBLE), sum(embedding[3]::DOUBLE), sum(embedding[4]::DOUBLE)] AS v FROM embeddings GROUP BY label) SELECT label, round(v[1] / sqrt(list_inner_product(v, v)), 6) AS x, round(v[4] / sqrt(list_inner_product(v, v)), 6) AS y FROM s")
def mean_pool(spark, sf):
    pooled = table(spark, sf, "embeddings").groupBy("label").agg(*vectors.vector_sum("embedding", 4))
    return pooled.select("label", F.round(vectors.mean_pool(4)[0], 6).alias("x"), F.round(vectors.mean_pool(4)[3], 6).alias("y"))


@register("C2_phrases")
def phrases(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", text.phrases("text").alias("phrases"))


@register("C17_unmentioned_terms")
def unmentioned(spark, sf):
    item = table(spark, sf, "benchmark").filter("item_id < 3").select("item_id", F.col("text").alias("q"))
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "text").crossJoin(F.broadcast(item))
    return turns.select("conv_id", "turn", "item_id", text.unmentioned_terms(F.col("q"), F.col("text")).alias("terms"))


@register("C21_pii", """
SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: len(regexp_extract_all(w, '[0-9]')) >= 15)) > 0 OR contains(text, 'sk-') OR contains(lower(text), 'api_key')
  OR len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: strlen(regexp_replace(w, '^[^A-Za-z0-9-]+|[^A-Za-z0-9-]+$', '', 'g')) = 11 AND len(regexp_extract_all(w, '[0-9]')) = 9 AND len(regexp_extract_all(regexp_replace(w, '^[^A-Za-z0-9-]+|[^A-Za-z0-9-]+$', '', 'g'), '-')) = 2)) > 0 AS pii FROM documents""")
def pii(spark, sf):
    return table(spark, sf, "documents").select("doc_id", trust.looks_like_pii(F.col("text")).alias("pii"))


@register("C19_trust_tier", """
SELECT conv_id, turn, CASE WHEN contains(lower(text), 'from now on') OR contains(lower(text), 'as an ai') OR contains(lower(text), 'system prompt') OR contains(lower(text), 'you must always') OR contains(lower(text), 'you should always') OR contains(lower(text), 'your new instructions')
  OR contains(text, 'sk-') OR role <> 'user' THEN 'untrusted' ELSE 'asserted' END AS tier FROM conversations""")
def trust_tier(spark, sf):
    tier = F.when(F.col("role") == "user", "asserted").otherwise("untrusted")
    return table(spark, sf, "conversations").select("conv_id", "turn", trust.assess_trust(F.col("text"), tier)["tier"].alias("tier"))


@register("C22_question_shapes", """
WITH q AS (SELECT conv_id, turn, lower(text) AS t FROM conversations)
SELECT conv_id, turn, (contains(t, 'how long') OR contains(t, 'how many days') OR contains(t, 'how many weeks') OR contains(t, 'how many months') OR contains(t, 'how many years') OR contains(t, 'how much time')
   OR contains(t, ' before ') OR contains(t, ' after ') OR contains(t, ' since ') OR contains(t, 'which event') OR contains(t, 'earlier') OR contains(t, 'later')) AS interval_question,
  (contains(t, 'recommend') OR contains(t, 'suggest') OR contains(t, 'tips') OR contains(t, 'ideas') OR contains(t, 'advice') OR contains(t, 'what should i') OR contains(t, 'can you help') OR contains(t, 'could you help') OR contains(t, 'help me')
   OR contains(t, 'i''m looking for') OR contains(t, 'i am looking for') OR contains(t, 'do you think')) AND NOT (contains(t, 'you recommended') OR contains(t, 'you suggested') OR contains(t, 'you mentioned') OR contains(t, 'you told me') OR contains(t, 'you gave me')
   OR contains(t, 'you provided') OR contains(t, 'remind me') OR contains(t, 'our previous') OR contains(t, 'our last') OR contains(t, 'we discussed') OR contains(t, 'we talked')) AS advice_request FROM q""")
def question_shapes(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", shapes.is_interval_question(F.col("text")).alias("interval_question"), shapes.is_advice_request(F.col("text")).alias("advice_request"))


@register("C14_record_ids")
def record_ids(spark, sf):
    """Version 5 ids; held against the standard library in the tests."""
    space = ids.tenant_namespace("src0", "records.example")
    return table(spark, sf, "documents").select("doc_id", ids.uuid5(space, F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))).alias("id"))


_DAYS = "d AS (SELECT o_orderkey, o_orderdate::DATE AS lo, o_orderdate::DATE + (o_orderkey % 70)::INT AS hi, DATE '1998-08-02' AS today FROM orders)"


def _days(spark, sf):
    return table(spark, sf, "orders").selectExpr("o_orderkey", "to_date(o_orderdate) AS lo", "date_add(to_date(o_orderdate), cast(o_orderkey % 70 AS int)) AS hi", "DATE'1998-08-02' AS today")


@register("T1_overlap_days", f"WITH {_DAYS} SELECT o_orderkey, (hi - lo + 1)::INT AS days, greatest(0, least(hi, DATE '1996-06-30') - greatest(lo, DATE '1996-06-01') + 1)::INT AS in_june FROM d")
def overlap(spark, sf):
    june = F.to_date(F.lit("1996-06-01")), F.to_date(F.lit("1996-06-30"))
    return _days(spark, sf).select("o_orderkey", temporal.days_in(F.col("lo"), F.col("hi")).alias("days"), temporal.overlap_days(F.col("lo"), F.col("hi"), *june).alias("in_june"))


@register("T8_ago_phrase", f"""WITH {_DAYS}, n AS (SELECT o_orderkey, (today - lo)::INT AS days,
  ((year(today) - year(lo)) * 12 + month(today) - month(lo) - (day(today) < day(lo))::INT)::INT AS months FROM d)
SELECT o_orderkey, CASE WHEN days = 0 THEN 'today' WHEN days < 0 THEN 'in ' || -days || ' day' || CASE WHEN days = -1 THEN '' ELSE 's' END ELSE days || ' day' || CASE WHEN days = 1 THEN '' ELSE 's' END || ' ago'
  || CASE WHEN days >= 7 THEN '; ' || days // 7 || ' week' || CASE WHEN days // 7 = 1 THEN '' ELSE 's' END ELSE '' END
  || CASE WHEN months >= 1 THEN '; ' || months || ' month' || CASE WHEN months = 1 THEN '' ELSE 's' END ELSE '' END END AS phrase FROM n""")
def ago(spark, sf):
    return _days(spark, sf).select("o_orderkey", temporal.ago_phrase(F.col("lo"), F.col("today")).alias("phrase"))


@register("T6_range_in_words", f"""WITH {_DAYS}
SELECT o_orderkey, CASE WHEN lo = hi THEN strftime(lo, '%-d %B %Y')
  WHEN year(lo) = year(hi) AND month(lo) = month(hi) AND day(lo) = 1 AND hi = last_day(hi) THEN strftime(lo, '%B %Y')
  WHEN year(lo) = year(hi) AND month(lo) = month(hi) THEN strftime(lo, '%-d') || '–' || strftime(hi, '%-d %B %Y')
  WHEN year(lo) = year(hi) THEN strftime(lo, '%-d %B') || ' – ' || strftime(hi, '%-d %B %Y')
  ELSE strftime(lo, '%-d %B %Y') || ' – ' || strftime(hi, '%-d %B %Y') END AS words FROM d""")
def in_words(spark, sf):
    return _days(spark, sf).select("o_orderkey", temporal.range_in_words(F.col("lo"), F.col("hi")).alias("words"))


@register("T9_week_helpers", f"""WITH {_DAYS}, w AS (SELECT o_orderkey, lo, (isodow(lo) - 1)::INT AS wd FROM d)
SELECT o_orderkey, (lo - wd)::VARCHAR AS monday, (lo - 7)::VARCHAR AS last_week_lo, (lo - ((wd - 6 + 7) % 7) - 1)::VARCHAR AS saturday, date_trunc('month', lo)::DATE::VARCHAR AS month_lo, last_day(lo)::VARCHAR AS month_hi, (date_trunc('month', lo)::DATE + 10)::VARCHAR AS mid_lo FROM w""")
def week_helpers(spark, sf):
    lo = F.col("lo")
    helpers = {
        "monday": temporal.week_of(lo),
        "last_week_lo": temporal.last_week(lo)[0],
        "saturday": temporal.last_weekend(lo)[0],
        "month_lo": temporal.whole_month(lo)[0],
        "month_hi": temporal.whole_month(lo)[1],
        "mid_lo": temporal.month_part(lo, "mid")[0],
    }
    return _days(spark, sf).select("o_orderkey", *[day.cast("string").alias(name) for name, day in helpers.items()])


@register("T10_temporal_score", f"WITH {_DAYS} SELECT o_orderkey, round(greatest(0, least(hi, DATE '1996-12-31') - greatest(lo, DATE '1996-01-01') + 1) / (hi - lo + 1), 6) AS score FROM d")
def temporal_score(spark, sf):
    gold = F.to_date(F.lit("1996-01-01")), F.to_date(F.lit("1996-12-31"))
    return _days(spark, sf).select("o_orderkey", F.round(temporal.temporal_score(F.col("lo"), F.col("hi"), *gold), 6).alias("score"))


@register("T3_parsed_times", f"""WITH {_DAYS}
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN 'duration' ELSE 'range' END AS kind,
  CASE o_orderkey % 4 WHEN 0 THEN lo WHEN 1 THEN date_trunc('month', lo)::DATE WHEN 2 THEN date_trunc('year', lo)::DATE END::VARCHAR AS lo,
  CASE o_orderkey % 4 WHEN 0 THEN lo WHEN 1 THEN last_day(lo) WHEN 2 THEN make_date(year(lo), 12, 31) END::VARCHAR AS hi, CASE WHEN o_orderkey % 4 = 3 THEN 21 ELSE 0 END AS days FROM d""")
def parsed_times(spark, sf):
    from palimpsest.functions.timephrases import parsed_time

    written = F.expr("CASE o_orderkey % 4 WHEN 0 THEN date_format(lo, 'd MMMM, yyyy') WHEN 1 THEN date_format(lo, 'MMMM yyyy') WHEN 2 THEN date_format(lo, 'yyyy') ELSE 'three weeks' END")
    got = _days(spark, sf).withColumn("t", parsed_time(written))
    return got.select("o_orderkey", "t.kind", F.col("t.lo").cast("string").alias("lo"), F.col("t.hi").cast("string").alias("hi"), F.coalesce("t.days", F.lit(0)).cast("int").alias("days"))


@register("T5_relative_phrases", f"""WITH {_DAYS}, p AS (SELECT o_orderkey, lo AS anchor, o_orderkey % 9 + 2 AS n FROM d WHERE o_orderkey % 5 < 4)
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'yesterday' WHEN 1 THEN 'last week' WHEN 2 THEN n || ' days ago' ELSE 'tomorrow' END AS phrase,
  CASE o_orderkey % 5 WHEN 0 THEN anchor - 1 WHEN 1 THEN anchor - 7 WHEN 2 THEN anchor - n::INT ELSE anchor + 1 END::VARCHAR AS lo,
  CASE o_orderkey % 5 WHEN 0 THEN anchor - 1 WHEN 1 THEN anchor - 1 WHEN 2 THEN anchor - n::INT ELSE anchor + 1 END::VARCHAR AS hi FROM p""")
def relative(spark, sf):
    from palimpsest.functions.timephrases import relative_phrases

    said = F.expr("CASE o_orderkey % 5 WHEN 0 THEN 'It was yesterday.' WHEN 1 THEN 'we met last week, I think' WHEN 2 THEN concat(o_orderkey % 9 + 2, ' days ago it was') WHEN 3 THEN 'see you Tomorrow' ELSE 'no time at all' END")
    rows = _days(spark, sf).select("o_orderkey", F.explode(relative_phrases(said, F.col("lo"))).alias("p"))
    return rows.select("o_orderkey", "p.phrase", F.col("p.lo").cast("string").alias("lo"), F.col("p.hi").cast("string").alias("hi"))


@register("P6_packed_lines")
def packed_lines(spark, sf):
    """Documents in chunks of at most 1,800 bytes of whole lines; held against a loop in the tests."""
    return table(spark, sf, "documents").select("doc_id", F.posexplode(text.pack_lines(F.col("text"))).alias("chunk", "lines"))


@register("C8_stamps", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN (DATE '2024-01-01' + (doc_id % 300)::INT)::VARCHAR END AS stamped, text AS body FROM documents")
def stamps(spark, sf):
    stamp = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("["), F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("doc_id") % 300).cast("int")).cast("string"), F.lit("] "))).otherwise(F.lit(""))
    written = F.concat(stamp, F.col("text"))
    return table(spark, sf, "documents").select("doc_id", text.stamped_date(written).cast("string").alias("stamped"), text.strip_stamp(written).alias("body"))
