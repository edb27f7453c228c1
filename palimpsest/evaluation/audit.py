"""Coverage, evidence audits, and the comparison of our numbers with published ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.shapes import is_aggregation_question, is_enumeration_question


def coverage(found: DataFrame) -> DataFrame:
    """Rows, rate and mean score by category and bucket: ``found(category, n_gold, n_found, score)``."""
    bucket = F.when(F.col("n_found") >= F.col("n_gold"), "all").when(F.col("n_found") > 0, "partial").otherwise("none")
    return found.filter("n_gold > 0").groupBy("category", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"))


def evidence_table(rows: DataFrame) -> DataFrame:
    """Cells of (sufficient, correct) over answerable rows, and the abstention column, as one row.

    ``rows(abstention, sufficient, correct)``; an answerable row without a verdict counts as a question only.
    """
    judged = ~F.col("abstention") & F.col("sufficient").isNotNull()
    cell = lambda s, c: F.count_if(judged & (F.col("sufficient") == s) & (F.col("correct") == c))
    return rows.agg(
        F.count(F.lit(1)).alias("questions"),
        cell(True, True).alias("suff_right"),
        cell(True, False).alias("suff_wrong"),
        cell(False, True).alias("insuff_right"),
        cell(False, False).alias("insuff_wrong"),
        F.count_if(F.col("abstention") & F.col("correct")).alias("abstention_right"),
    )


def ceilings(cells: DataFrame) -> DataFrame:
    """What fixing the reader, or retrieval, could reach at most; 0 where a share has no base."""
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    right = F.col("suff_right") + F.col("insuff_right")
    p_suff = share(F.col("suff_right"), F.col("suff_right") + F.col("suff_wrong"))
    p_insuff = share(F.col("insuff_right"), F.col("insuff_right") + F.col("insuff_wrong"))
    base = right + F.col("abstention_right")
    return cells.select(
        share(base, F.col("questions")).alias("measured"),
        share(base + F.col("suff_wrong"), F.col("questions")).alias("reader_fix"),
        share(base + p_suff * F.col("insuff_wrong"), F.col("questions")).alias("retrieval_fix"),
        share(base + F.col("insuff_wrong"), F.col("questions")).alias("retrieval_perfect"),
        (p_suff - p_insuff).alias("discrimination"),
    )


def proxy_agreement(rows: DataFrame, proxy: str, judge: str) -> DataFrame:
    """How a cheap proxy and a judge agree: ``n, agree, only_proxy, only_judge``."""
    p, j = F.col(proxy), F.col(judge)
    return rows.filter(j.isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.count_if(p == j).alias("agree"), F.count_if(p & ~j).alias("only_proxy"), F.count_if(~p & j).alias("only_judge"))


def weighted_mean(rows: DataFrame, value: str, weight: str, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"))


def replicate_mean(rows: DataFrame, metric: str = "metric") -> DataFrame:
    """Mean over seeds; ``consistent`` tells whether all members cover the same number of questions."""
    return rows.groupBy(metric).agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n_seeds"), (F.countDistinct("n") == 1).alias("consistent"))


def fleiss_kappa(ratings: DataFrame, item: str, label: str) -> DataFrame:
    """Fleiss' kappa over items that all have the same number of ratings; NaN if chance agreement is total."""
    cells = ratings.groupBy(item, label).agg(F.count(F.lit(1)).alias("c"))
    per_item = cells.groupBy(item).agg(F.sum(F.col("c") * F.col("c")).alias("sq"), F.sum("c").alias("raters"))
    observed = per_item.agg(F.avg((F.col("sq") - F.col("raters")) / (F.col("raters") * (F.col("raters") - 1))).alias("p_bar"), F.sum("raters").alias("total"))
    shares = cells.groupBy(label).agg(F.sum("c").alias("c")).agg(F.sum(F.col("c") * F.col("c")).alias("sq"))
    joined = observed.crossJoin(F.broadcast(shares))  # one row each
    p_e = F.col("sq") / (F.col("total") * F.col("total"))
    return joined.select(F.when(F.abs(1 - p_e) < 1e-12, F.lit(float("nan"))).otherwise((F.col("p_bar") - p_e) / (1 - p_e)).alias("kappa"))


def strata(pairs: DataFrame) -> DataFrame:
    """Wins, losses, ties and mean difference, overall and by stratum: ``pairs(question_id, category, abstention, a, b)``."""
    tags = F.array(F.lit("overall"), F.when(F.col("abstention"), F.lit("abstention")).otherwise(F.lit("answerable")), F.concat(F.lit("category:"), F.col("category").cast("string")))
    spread = pairs.select(F.explode(tags).alias("stratum"), (F.col("a") - F.col("b")).alias("d"))
    return spread.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") < 0).alias("losses"), F.avg("d").alias("mean_difference"))


def standing(registry: DataFrame, ours: DataFrame) -> DataFrame:
    """``metric, verdict, gap, claim``: each published number against ours, the first obstacle first.

    ``registry(metric, value, n, citeable, defect, population_comparable, judge_class, backbone_class, nominal_n)``,
    ``ours(metric, value, n, incomplete, unrecorded, judge_class, backbone_class, arm)``.
    """
    r, o = registry.alias("r"), ours.alias("o")
    joined = r.join(o, F.col("r.metric") == F.col("o.metric"), "left")
    c = F.col
    verdict = (
        F.when(~c("r.citeable"), "source")
        .when(c("r.defect").isNotNull(), "protocol")
        .when(c("o.metric").isNull(), "missing")
        .when(c("o.incomplete"), "incomplete")
        .when(c("o.unrecorded"), "stale")
        .when(c("r.population_comparable") & (c("o.n") != c("r.n")), "subset")
        .when(c("r.nominal_n").isNotNull() & (c("o.n") != c("r.nominal_n")), "incomplete")
        .when(c("o.judge_class") != c("r.judge_class"), "judge")
        .when(c("o.backbone_class") != c("r.backbone_class"), "backbone")
        .otherwise("comparable")
    )
    gap = c("o.value") - c("r.value")
    return joined.select(c("r.metric").alias("metric"), verdict.alias("verdict"), gap.alias("gap")).join(ours.select("metric", "arm"), "metric", "left").select("metric", "verdict", "gap", F.coalesce((F.col("verdict") == "comparable") & (F.col("gap") > 0) & ~F.col("arm"), F.lit(False)).alias("claim"))


def matched_minimum(readings: DataFrame, expected: int) -> DataFrame:
    """The least of a corpus' grader readings, only where all of them are there."""
    return readings.groupBy("corpus").agg(F.min("value").alias("matched"), F.countDistinct("grader").alias("n")).filter(F.col("n") == expected).drop("n")


def best_artifact(artifacts: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One artifact a metric by a lexicographic preference."""
    return artifacts.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("nth = 1").drop("nth")


def depth_for(question: Column, k: int, tokens: int, gates: dict[str, tuple[int, int]]) -> Column:
    """``struct<k, tokens>``: the elementwise largest of the gates that a question opens, else the default."""
    opens = {"aggregation": is_aggregation_question(question), "enumeration": is_enumeration_question(question)}
    pick = lambda j: F.greatest(*[F.when(opens[g], F.lit(v[j])).otherwise(F.lit(0)) for g, v in gates.items()], F.lit(0))
    return F.struct(F.coalesce(F.nullif(pick(0), F.lit(0)), F.lit(k)).alias("k"), F.coalesce(F.nullif(pick(1), F.lit(0)), F.lit(tokens)).alias("tokens"))


def unfenced(reply: Column) -> Column:
    """The content of a Markdown fence, or the reply itself."""
    inner = F.regexp_extract(F.trim(reply), r"(?is)```(?:json)?\s*(.*?)\s*```", 1)
    return F.coalesce(F.nullif(inner, F.lit("")), F.trim(reply))


def graded(reply: Column, kind: str) -> Column:
    """1 or 0 from a grader's reply, null where it must be refused: by ``label``, ``score`` or ``yes``."""
    if kind == "yes":
        return F.contains(F.lower(reply), F.lit("yes")).cast("int")
    body = unfenced(reply)
    if kind == "label":
        label = F.get_json_object(body, "$.label")
        return F.when(label.isNotNull(), (F.upper(F.trim(label)) == "CORRECT").cast("int"))
    score = F.coalesce(F.get_json_object(body, "$.score").try_cast("double"), F.when(F.get_json_object(body, "$").isNotNull() & F.get_json_object(body, "$.score").isNull(), F.lit(0.0)))
    return F.when(score.isin(0.0, 1.0), score.cast("int"))


#: Gold rows that one task joins, about.
TASK_ROWS = 1 << 20


def reached(gold: DataFrame, stored: DataFrame) -> DataFrame:
    """Per question whether all its gold units are stored: ``gold(question_id, unit)``, ``stored(unit)``.

    The gold rows are counted and dealt by unit over so many tasks that each sorts about TASK_ROWS of them and adds up no
    more questions than that, however many there are in all.
    """
    parts = -(-gold.count() // TASK_ROWS)
    dealt = gold.repartition(parts, "unit") if parts > 1 else gold
    kept = dealt.join(stored.select("unit").distinct().withColumn("there", F.lit(1)), "unit", "left")
    return kept.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_gold"), F.count("there").alias("n_stored")).withColumn("reached", F.col("n_gold") == F.col("n_stored"))
