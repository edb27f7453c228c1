"""Operators that spread groups of any size, and exports that keep to their namespace, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.evaluation import audit
from palimpsest.evaluation.metrics import retrieval_quality
from palimpsest.functions.vectors import dot, norm
from palimpsest.operators import channels, compose, nearest
from palimpsest.operators.ranks import spread_rank
from palimpsest.plans import ranking
from palimpsest.sources import bundles


def test_spread_rank_numbers_every_group(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.6 else rng.choice(["a", "b", None]), rng.randint(0, 50), k) for k in range(400)]
    frame = spark.createDataFrame(rows, "g string, v int, id int").repartition(5)
    got = {r.id: r.rank for r in spread_rank(frame, "g", [-F.col("v"), F.col("id")], partitions=6).collect()}
    for g in ("hot", "a", "b", None):
        order = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert [got[r[2]] for r in order] == list(range(1, len(order) + 1))
    assert spread_rank(frame.limit(0), "g", [F.col("id")]).count() == 0


def test_budget_skips_what_does_not_fit(spark):
    rng = random.Random(5)
    rows = [(q, rank, rng.randint(0, 10**6), rng.choice([50, 300, 900, 2500])) for q in range(12) for rank in range(1, rng.randint(2, 25))]
    got = {}
    for r in compose.within_budget(spark.createDataFrame(rows, "query_id int, rank int, id int, tokens int"), 6, 2048).collect():
        got.setdefault(r.query_id, []).append(r)
    for q in range(12):
        kept, used, dropped, bound = [], 0, 0, False
        for _, _, i, tokens in (r for r in rows if r[0] == q):
            if len(kept) == 6:
                bound = True
            elif not kept or used + tokens <= 2048:
                kept.append(i)
                used += tokens
            else:
                dropped += 1
        mine = sorted(got[q], key=lambda r: r.position)
        assert [r.id for r in mine] == kept and {(r.total_tokens, r.dropped_for_tokens, r.k_bound) for r in mine} == {(used, dropped, bound)}


def test_an_export_holds_one_namespace(spark):
    make = spark.createDataFrame
    tables = {
        "records": make([("r1", "t", "n"), ("r2", "t", "m"), ("r3", "u", "n")], "id string, tenant string, namespace string"),
        "quarantine": make([("q1", '{"scope": {"tenant": "t", "namespace": "n"}}'), ("q2", '{"scope": {"tenant": "u", "namespace": "n"}}')], "id string, record string"),
        "trajectories": make([("a", "t", "n"), ("b", "t", "m"), ("c", "u", "n")], "id string, tenant string, namespace string"),
        "states": make([("a", 0), ("b", 0), ("c", 0)], "trajectory string, state_index int"),
        "acl_ua": make([("x", "y")], "user_id string, agent_id string"),
    }
    found = bundles.namespace_tables(tables, "t", "n")
    assert {name: [r[0] for r in found[name].collect()] for name in found} == {"records": ["r1"], "quarantine": ["q1"], "trajectories": ["a"], "states": ["a"], "acl_ua": ["x"]}
    with pytest.raises(ValueError):
        bundles.namespace_tables({"records": tables["records"], "other": make([(1,)], "x int")}, "t", "n")


@pytest.mark.parametrize("scope", [[], ["label"]])
def test_dense_scans_records_once_a_block_and_joins_no_pairs(spark, monkeypatch, scope):
    rng = random.Random(9)
    odd = [None, [], [0.0] * 8, [None] + [1.0] * 7, [1.0] * 5, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7]
    vectors = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(300)] + odd * 2
    vectors += [vectors[k % 3] for k in range(60)]
    rows = [(k, v, rng.choice(["a", "a", "b", None])) for k, v in enumerate(vectors)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "id long, vector array<float>, label string").repartition(3)
    queries = frame.filter("id % 4 = 0 OR id BETWEEN 300 AND 313").withColumnRenamed("id", "query_id")
    monkeypatch.setattr(channels, "QUERY_BLOCK", 40)
    monkeypatch.setattr(nearest, "SLAB", 32)
    pairs = queries.join(frame.withColumnRenamed("vector", "other"), scope) if scope else queries.crossJoin(frame.withColumnRenamed("vector", "other"))
    scale = norm(F.col("vector")) * norm(F.col("other"))
    score = F.round(F.when(scale > 0, dot(F.col("vector"), F.col("other")) / scale).otherwise(F.lit(0.0)), channels.DIGITS)
    want = channels.top_ranked(pairs.select("query_id", "id", score.alias("score")), 6)
    found = channels.dense(queries, frame, 6, scope)
    same = lambda rows: sorted((r.query_id, r.rank, r.id, repr(r.score)) for r in rows)
    assert same(found.collect()) == same(want.collect())
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert channels.dense(queries.limit(0), frame, 6, scope).count() == 0 == channels.dense(queries, frame.limit(0), 6, scope).count()


def test_gold_need_hold_no_more_than_what_is_ranked(spark):
    rng = random.Random(4)
    gold = [(q, k) for q in range(8) for k in range(rng.choice([1, 3, 40]))]
    ranked = [(q, k, n) for q in range(7) for n, k in enumerate(rng.sample(range(60), 9), 1)]
    whole, head = spark.createDataFrame(gold, "query_id int, id int"), spark.createDataFrame(ranked, "query_id int, id int, rank int")
    size = whole.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_gold"))
    told = whole.join(head.select("query_id", "id"), ["query_id", "id"], "left_semi")
    assert sorted(retrieval_quality(head, told, 6, size).collect()) == sorted(retrieval_quality(head, whole, 6).collect())


def test_reach_joins_a_bounded_number_of_rows_a_task(spark, monkeypatch):
    monkeypatch.setattr(audit, "TASK_ROWS", 50, raising=False)
    rng = random.Random(4)
    pairs = [(rng.randrange(40), rng.choice([None, *range(60)])) for _ in range(600)]
    gold = spark.createDataFrame(pairs, "question_id int, unit int")
    found = audit.reached(gold, spark.createDataFrame([(k,) for k in [*range(0, 60, 2), 0, None]], "unit int"))
    want = {q: [0, 0] for q, _ in pairs}
    for q, u in pairs:
        want[q][0] += 1
        want[q][1] += u is not None and u % 2 == 0
    assert {r.question_id: [r.n_gold, r.n_stored] for r in found.collect()} == want
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().toString()


def test_texts_of_inadmissible_records_are_never_split(spark, tmp_path):
    """What probes use is the admissible records as written down, not a scan of all documents."""
    rows = [(k, f"words of {k}", "en", "web") for k in range(30)] + [(10**6, "too late", "en", "web")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    live = ranking._live(spark, str(tmp_path))
    assert "FileScan" not in live._jdf.queryExecution().toString() and "parquet" not in live._jdf.queryExecution().toString()
    kept = {r.id for r in live.collect()}
    assert kept and 10**6 not in kept and not any(k % 11 == 0 or k % 17 == 0 for k in kept)
