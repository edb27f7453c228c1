"""Operators that go in rounds, or that scale a fold, against plain loops."""

import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from palimpsest.evaluation.ablation import Arm, ablation
from palimpsest.evaluation.attacks import attack_success
from palimpsest.evaluation.resampling import paired_bootstrap
from palimpsest.evaluation.sweep import recall_sweep
from palimpsest.operators import channels, compose, inverted, segment, turns
from palimpsest.operators.applying import apply_in_order
from palimpsest.operators.containment import contained, folded, seed_of, window_hashes
from palimpsest.operators.investigate import HEDGE, STATEMENT, answerability_gate, digested, insufficiency_gate, investigate, premise_checked
from palimpsest.sources.connectors import ReadingLlm, complete_column


def stream(rng, unit, n):
    """Turns with gaps, topics, empty and over-long texts, nulls."""
    out, at = [], 0
    for k in range(n):
        at += rng.choice([10, 60, 600, 3600, 3601, 9000])
        text = rng.choice([None, "", "a b", "word " * rng.randint(1, 30), "word " * 30, "x" * 500])
        out.append((unit, k * 3 - 5, text, None if rng.random() < 0.1 else at, None if rng.random() < 0.1 else rng.random() < 0.1))
    return out


def plain_episodes(rows, cap, gap):
    out, used, last, e, opened = {}, 0, None, -1, []
    for unit, order, text, at, topic in rows:
        tokens = max(len(text) // 4, len(text.split())) if text else 0
        why = "first" if e < 0 else "time_gap" if at is not None and last is not None and at - last > gap else "topic_shift" if topic else "token_cap" if used + tokens > cap else None
        if why:
            e, used = e + 1, 0
            opened.append((order, why))
        used, last = used + tokens, at
        out[order] = e
    reason = dict(zip(range(e + 1), [w for _, w in opened[1:]] + ["end_of_unit"]))  # noqa: B905
    orders = sorted(out)
    return {o: (out[o], reason[out[o]] if k + 1 == len(orders) or out[orders[k + 1]] != out[o] else None) for k, o in enumerate(orders)}


@pytest.mark.parametrize("fold", [1000, 0, 40])
def test_episodes(spark, fold):
    rng = random.Random(3)
    streams = {u: stream(rng, u, n) for u, n in (("a", 150), ("b", 1), ("c", 30), ("d", 41))}
    rows = [(*r[:3], r[3] and r[3] + 10**9, r[4], "kept") for rows in streams.values() for r in rows]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "unit string, turn int, text string, s long, topic boolean, extra string").withColumn("at", F.timestamp_seconds("s")).repartition(3)
    got = segment.episodes(frame, "unit", "turn", at="at", token_cap=40, topic="topic", fold_turns=fold).collect()
    want = {(u, o): v for u, rows in streams.items() for o, v in plain_episodes(rows, 40, 3600).items()}
    assert {(r.unit, r.turn): (r.episode, r.ended_by) for r in got} == want and all(r.extra == "kept" for r in got)
    assert segment.episodes(frame.limit(0), "unit", "turn", fold_turns=fold).count() == 0


def test_pointers_are_followed_in_blocks(spark, monkeypatch):
    """Long paths are not doubled pointer by pointer: what is written down between rounds is a few rows a block."""
    rng, written, cut = random.Random(8), [], segment.cut_lineage
    monkeypatch.setattr(segment, "cut_lineage", lambda df: (lambda kept: written.append(kept.count()) or kept)(cut(df)))
    to = {"a": {k: k + 1 + k % 3 for k in range(40_000)}, "b": {k: k + rng.randint(1, 40) for k in range(300) if rng.random() < 0.9}}
    first = {"a": [0], "b": [3, 50, 299, 500], "c": [7]}
    want = set()
    for u, starts in first.items():
        for at in starts:
            while at is not None and (u, at) not in want:
                want.add((u, at))
                at = to.get(u, {}).get(at)
    jumps = spark.createDataFrame([(u, i, j) for u, pointers in to.items() for i, j in pointers.items()], "unit string, idx long, to long")
    starts = spark.createDataFrame([(u, k) for u, ks in first.items() for k in ks], "unit string, idx long")
    got = [tuple(r) for r in segment.reached(starts, jumps, "unit").collect()]
    assert set(got) == want and len(got) == len(want)
    assert sum(written) < 1000
    small = [tuple(r) for r in segment.reached(starts, jumps.filter("unit = 'b'"), "unit", block=7).collect()]
    assert sorted(small) == sorted({p for p in want if p[0] != "a"} | {("a", 0)})


def plain_keys(texts):
    before, out = None, []
    for t in texts:
        words = [w for w in "".join(c if c.isalnum() or c == "'" else " " for c in (t or "").lower()).split()]
        joined = " ".join(words)
        able = len(words) >= turns.KEY_WORDS and not (len(words) <= turns.ACK_WORDS and any(joined == a or joined.startswith(a + " ") for a in turns.ACKNOWLEDGEMENTS))
        content = {w for w in words if len(w) >= 3}
        again = before is not None and content and len(content & before) / len(content) >= turns.RESTATED
        out.append(able and not again)
        if out[-1]:
            before = content
    return out


def test_key_utterances(spark):
    rng = random.Random(5)
    pool = ["we saw the red house", "we saw the red house again", "thanks a lot for it", "a b c d e", "", None, "the old boat sank near the red house", "to be or so it", "we saw the red house"]
    units = {u: [rng.choice(pool) for _ in range(n)] for u, n in (("a", 200), ("b", 3), ("c", 1))}
    units["d"] = [pool[0]] * 50 + [pool[6]] + [pool[1]] * 20
    frame = spark.createDataFrame([(u, k, t) for u, ts in units.items() for k, t in enumerate(ts)], "unit string, turn int, text string").repartition(3)
    want = {(u, k): v for u, ts in units.items() for k, v in enumerate(plain_keys(ts))}
    for fold in (1000, 0, 10):
        assert {(r.unit, r.turn): r.key for r in turns.key_utterances(frame, "unit", "turn", fold_turns=fold).collect()} == want


def test_window_hashes_agree_with_seeds():
    import numpy as np

    text = bytes(random.Random(1).randrange(256) for _ in range(300))
    for length, hashes in window_hashes(np.frombuffer(text, np.uint8)):
        assert len(hashes) == 300 - length + 1
        for at in (0, 7, 300 - length):
            assert seed_of(text[at : at + length]) == (length, int(hashes[at : at + 1].view(np.int64)[0]))


def test_contained(spark):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abé ﬁ") for _ in range(n))
    texts = [(k % 35, text(rng.choice([0, 3, 40, 200]))) for k in range(60)] + [(99, None), (None, "ab" * 40), (98, "x" * 70_000 + "needle here")]
    needles = [(k, rng.choice(texts)[1] or "") for k in range(10)] + [(100 + k, text(n)) for k, n in enumerate((1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 33))] + [(200, None), (201, ""), (202, "needle here"), (203, "fi"), (204, "ab"), (204, "ba")]
    want = {(n, i) for n, a in needles for i, b in texts if a and b and folded(a) in folded(b)}
    left = spark.createDataFrame(needles, "needle int, text string")
    right = spark.createDataFrame([(*t, 1) for t in texts], "id int, text string, needle int").repartition(3)
    for at_once in (500_000, 3):
        found = contained(left, right, seeds_at_once=at_once).collect()
        assert {tuple(r) for r in found} == want
    assert contained(left.limit(0), right).count() == 0 and contained(left, right.limit(0)).count() == 0


def test_no_nested_loop(spark):
    frame = spark.createDataFrame([(1, "abc")], "needle int, text string")
    plan = contained(frame, frame.withColumnRenamed("needle", "id"))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_recall_sweep(spark):
    golds = spark.createDataFrame([(1, "Red car"), (1, " blue, BIKE "), (2, "green"), (3, "..."), (4, "lost"), (5, "a b")], "query_id int, phrase string")
    ranked = spark.createDataFrame([(1, 1, "a red CAR!"), (1, 2, "nothing"), (1, 3, "the blue bike"), (2, 2, "Green"), (5, 1, "x a"), (5, 2, "b y"), (9, 1, "green")], "query_id int, rank int, text string")
    got = {r.k: (r.questions, r.hits, r.recall) for r in recall_sweep(golds, ranked, (1, 2, 3)).collect()}
    assert got == {1: (4, 0, 0.0), 2: (4, 2, 0.5), 3: (4, 3, 0.75)}


def plain_applied(rows, known):
    there, out = set(known), {}
    for seq, op, i, target, parents in sorted(rows):
        needs = ([target] if op in ("update", "delete", "duplicate") else []) + (list(parents or []) if op in ("add", "update") else [])
        new = op not in ("add", "update") or (i is not None and i not in there)
        out[seq] = op in ("add", "update", "delete", "noop", "duplicate", "quarantine", "rejected") and new and all(n is not None and n in there for n in needs)
        if out[seq] and op in ("add", "update"):
            there.add(i)
    return out


def test_apply_in_order(spark):
    rng = random.Random(7)
    for trial in range(3):
        rows = []
        for seq in range(120):
            op = rng.choice(["add", "add", "update", "update", "delete", "noop", "duplicate", "quarantine", "rejected", "odd"])
            rows.append((seq, op, rng.choice([None, *range(40)]), rng.choice([None, *range(40)]), rng.choice([None, [], [rng.randrange(40)], [rng.randrange(40), None], [1, 2]])))
        rows += [(200 + k, "update", 1000 + k, 999 + k, None) for k in range(12)] + [(199, "add", 999, None, None)]
        frame = spark.createDataFrame([(*r, "x") for r in rows], "seq long, op string, id long, target long, parents array<long>, event2 string").repartition(3)
        known = spark.createDataFrame([(k,) for k in range(0, 40, 7)], "id long")
        assert {r.seq: r.accepted for r in apply_in_order(frame, known).collect()} == plain_applied(rows, range(0, 40, 7)), trial
    events = {(r.op, r.accepted): r.event for r in apply_in_order(frame, known).collect()}
    assert events["duplicate", True] == "dedup" and events["add", False] == "consolidate_rejected" and events["rejected", True] == "contradiction_rejected"
    assert apply_in_order(frame.limit(0), known).count() == 0


def plain_investigation(questions, records, probe, reply, max_steps, step_k, max_pool):
    out = {}
    for q, question in questions:
        search, asked, pool, barren, conflicts, why = question, [], {}, 0, 0, None
        for step in range(1, max_steps + 1):
            fresh = 0
            for i, score in probe(search or "")[:step_k]:
                if i not in pool and len(pool) < max_pool:
                    pool[i] = score
                    fresh += 1
            barren += fresh == 0
            asked.append(search)
            if fresh == 0 and step > 1:
                why = "no new evidence"
            elif step == max_steps:
                why = "step budget"
            if why:
                break
            best = sorted(pool, key=lambda i: (-pool[i], i))[: 2 * step_k]
            try:
                r = json.loads(reply(question, asked, [records[i] for i in best]))
            except ValueError:
                r = {}
            conflicts += bool(r.get("conflict"))
            nxt = r.get("next_query")
            if r.get("sufficient") and not r.get("conflict"):
                why = "sufficient"
            elif not (nxt or "").strip() or nxt in asked:
                why = "no new query"
            if why:
                break
            search = nxt
        out[q] = (step, why, barren, conflicts, len(pool), tuple(asked), tuple(sorted(pool, key=lambda i: (-pool[i], i))))
    return out


class Scripted:
    """Replies by what the memories hold: some cannot be read, some repeat a query, some go on."""

    def complete(self, prompt, schema=None):
        asked = json.loads(prompt.split("\n", 1)[1])
        n = sum(map(len, asked["memories"])) + 7 * len(asked["searched"])
        if n % 11 == 0:
            return "not json"
        nxt = asked["searched"][0] if n % 7 == 0 else None if n % 5 == 0 else (asked["memories"] or ["w1"])[-1][-12:]
        return json.dumps({"sufficient": n % 4 == 0, "conflict": n % 3 == 0, "next_query": nxt})


def test_investigate(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(40)]
    records = {k: " ".join(rng.choice(words) for _ in range(rng.randint(3, 12))) for k in range(60)}
    questions = [(k, " ".join(rng.choice(words) for _ in range(4))) for k in range(25)] + [(90, "nothing known"), (91, "")]
    docs = spark.createDataFrame(list(records.items()), "id int, text string")
    frame = spark.createDataFrame([(*q, "x") for q in questions], "query_id int, text string, steps string")

    def overlap(queries):
        q = queries.select("query_id", F.explode(F.array_distinct(F.split("text", " "))).alias("w"))
        d = docs.select("id", F.explode(F.array_distinct(F.split("text", " "))).alias("w"))
        return channels.top_ranked(q.filter("w <> ''").join(d, "w").groupBy("query_id", "id").agg(F.count(F.lit(1)).cast("double").alias("score")), 20)

    def plain_overlap(text):
        wanted = set(text.split(" ")) - {""}
        scored = {i: float(len(wanted & set(t.split(" ")))) for i, t in records.items()}
        return sorted(((i, s) for i, s in scored.items() if s), key=lambda x: (-x[1], x[0]))

    for llm, most in ((Scripted(), 48), (Scripted(), 7), (ReadingLlm(), 48)):
        found = investigate(frame, docs, overlap, lambda rows, p, r, llm=llm: complete_column(rows, llm, p, r), 4, 5, most)
        pools = {}
        for r in found.pool.orderBy("query_id", "rank").collect():
            pools.setdefault(r.query_id, []).append(r.id)
        got = {r.query_id: (r.steps, r.stopped_because, r.barren_steps, r.conflicts_seen, r.pool, tuple(r.asked), tuple(pools.get(r.query_id, ()))) for r in found.trace.collect()}
        reply = lambda question, asked, memories, llm=llm: llm.complete("x\n" + json.dumps({"question": question, "searched": asked, "memories": memories}))
        assert got == plain_investigation(questions, records, plain_overlap, reply, 4, 5, most)
    none = investigate(frame.limit(0), docs, overlap, lambda rows, p, r: complete_column(rows, Scripted(), p, r))
    assert none.trace.count() == 0 and none.pool.count() == 0


def test_gates(spark):
    evidence = spark.createDataFrame([(q, s, q * 10 + s, "record", f"memory {q} {s}") for q in range(1, 8) for s in range(1, 4)], "query_id int, slot int, id int, source string, value string")
    replies = {1: '{"verdict": "supported", "missing": ""}', 2: '{"verdict": "ambiguous", "missing": ""}', 3: '{"verdict": "unsupported", "missing": "the day"}', 4: '{"verdict": "unsupported", "missing": " "}', 5: "no json", 6: None}
    verdicts = spark.createDataFrame(list(replies.items()), "query_id int, reply string")
    sets = {}
    for r in answerability_gate(evidence, verdicts).orderBy("query_id", "slot").collect():
        sets.setdefault(r.query_id, []).append(r.value)
    full = lambda q: [f"memory {q} {s}" for s in range(1, 4)]
    assert sets == {1: full(1), 2: [*full(2), HEDGE], 3: [STATEMENT], 4: [*full(4), HEDGE], 5: full(5), 6: full(6), 7: full(7)}

    trace = spark.createDataFrame([(1, "sufficient"), (2, "step budget"), (3, "no new query"), (8, "step budget")], "query_id int, stopped_because string")
    told = spark.createDataFrame([(2, " "), (3, "It assumes a boat."), (1, "unused")], "query_id int, reply string")
    gated = {(r.query_id, r.source, r.value) for r in insufficiency_gate(evidence, trace, told).filter("query_id in (1, 2, 3, 8)").collect()}
    assert gated == {(1, "record", v) for v in full(1)} | {(2, "palimpsest://insufficient", STATEMENT), (3, "palimpsest://premise", "It assumes a boat."), (8, "palimpsest://insufficient", STATEMENT)}

    entries = lambda *e: json.dumps({"entries": [{"memory": m, "fact": f} for m, f in e]})
    notes = spark.createDataFrame([(1, entries((2, "c"), (0, " a "))), (2, entries((0, "a"), (1, " "), (9, "x"))), (3, "bad")], "query_id int, reply string")
    lines = {r.query_id: (r.slot, r.value) for r in digested(evidence, notes).filter("id IS NULL").collect()}
    assert lines == {1: (4, "[notes] [0] a; [2] c")}
    claims = json.dumps({"presuppositions": [{"claim": " a boat ", "status": "contradicted", "evidence_index": 1}, {"claim": "b", "status": "absent", "evidence_index": 0}, {"claim": "c", "status": "contradicted", "evidence_index": 5}, {"claim": "", "status": "contradicted", "evidence_index": 0}]})
    checked = premise_checked(digested(evidence, notes), spark.createDataFrame([(1, claims), (2, "bad")], "query_id int, reply string"))
    assert [(r.query_id, r.slot, r.value) for r in checked.filter("source = 'premise'").collect()] == [(1, 5, '[premise] the question assumes "a boat", but memory [1] says otherwise: memory 1 2')]


def test_inverted_lists(spark):
    rng = random.Random(11)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    vectors = [(k, [x + rng.gauss(0, 0.6) for x in rng.choice(centres)]) for k in range(900)] + [(1000, [0.0] * 16), (1001, None), (1002, centres[0])]
    records = spark.createDataFrame(vectors, "id int, vector array<double>")
    index = inverted.build_lists(records)
    assert sorted(r.id for r in index.rows.collect()) == sorted(i for i, v in vectors if v is not None) and index.centroids.count() == 30
    queries = records.filter("id % 20 = 0 AND vector IS NOT NULL").withColumnRenamed("id", "query_id")
    exact = {(r.query_id, r.id): r.score for r in channels.dense(queries, records.filter("vector IS NOT NULL"), 6).collect()}
    got = {(r.query_id, r.id): r.score for r in inverted.search(queries, index, 6).collect()}
    assert len(exact.keys() & got.keys()) / len(exact) >= 0.9 and all(exact[k] == got[k] for k in exact.keys() & got.keys())
    everywhere = {(r.query_id, r.id) for r in inverted.search(queries, index, 6, probes=30).collect()}
    assert everywhere == exact.keys()
    assert inverted.search(queries, inverted.build_lists(records.limit(0))).count() == 0


def test_long_lists_meet_their_queries_in_parts(spark, monkeypatch):
    """No row is made for a pair of query and vector: parts of a list meet parts of its queries, with the scores of dense search."""
    monkeypatch.setattr(inverted, "PART_ROWS", 40)
    monkeypatch.setattr(inverted, "QUERY_BLOCK", 7)
    rng = random.Random(12)
    vectors = [(k, [rng.gauss(0, 1) for _ in range(5)]) for k in range(200)] + [(k, [1.0, 0.5, 0.0, 0.0, 0.0]) for k in range(200, 300)]
    records = spark.createDataFrame(vectors, "id int, vector array<float>")
    asked = [(f"q{k}", v) for k, v in vectors[::10]] + [("null", None), ("zero", [0.0] * 5)]
    queries = spark.createDataFrame(asked, "query_id string, vector array<float>").repartition(3)
    index = inverted.build_lists(records, lists=3)
    found = inverted.search(queries, index, 4, probes=3)
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString()
    want = [tuple(r) for r in channels.dense(queries, records, 4).select("query_id", "id", "score", "rank").collect()]
    assert sorted(tuple(r) for r in found.select("query_id", "id", "score", "rank").collect()) == sorted(want)
    few = {(r.query_id, r.id) for r in inverted.search(queries, index, 4, probes=1).collect()}
    assert len(few) == 4 * len(asked) and len(few & {r[:2] for r in want}) < len(few)


def test_probes_reach_the_recall_asked_for(spark):
    """Vectors without clusters: eight probes lose many of the nearest."""
    rng = random.Random(13)
    records = spark.createDataFrame([(k, [rng.gauss(0, 1) for _ in range(32)]) for k in range(1600)], "id int, vector array<float>")
    queries, index = records.filter("id % 10 = 0").withColumnRenamed("id", "query_id"), inverted.build_lists(records)
    exact = {(r.query_id, r.id) for r in channels.dense(queries, records, 10).collect()}
    share = lambda probes: len(exact & {(r.query_id, r.id) for r in inverted.search(queries, index, 10, probes).collect()}) / len(exact)
    assert share(inverted.PROBES) < 0.85 and share(inverted.probes_for(queries, index, 10)) >= 0.9
    assert inverted.probes_for(queries.limit(0), index, 10) == inverted.PROBES


def test_bootstrap(spark):
    rng = random.Random(1)
    pairs = [(rng.choice([0.0, 0.25, 1.0]), rng.choice([0.0, 0.2, 1.0])) for _ in range(800)] + [(None, 1.0), (1.0, None), (float("nan"), 1.0)]
    frame = spark.createDataFrame(pairs, "a double, b double")
    got = paired_bootstrap(frame.repartition(5), "a", "b", 4000).first()
    gaps = [a - b for a, b in pairs[:800]]
    mean = sum(gaps) / 800
    se = math.sqrt(sum((g - mean) ** 2 for g in gaps) / 800 / 800)
    assert got.n == 800 and abs(got.mean - mean) < 1e-9
    assert abs(got.low - (mean - 1.96 * se)) < 0.15 * se and abs(got.high - (mean + 1.96 * se)) < 0.15 * se
    z = abs(mean) / se
    assert abs(got.p - math.erfc(z / math.sqrt(2))) < 0.05
    assert paired_bootstrap(frame.coalesce(1), "a", "b", 4000).first() == got
    none = paired_bootstrap(frame.limit(0), "a", "b", 100).first()
    assert none.n == 0 and none.mean is None and none.low is None and none.p is None
    same = paired_bootstrap(spark.createDataFrame([(1.0, 1.0)] * 5, "a double, b double"), "a", "b", 200).first()
    assert (same.mean, same.low, same.high, same.p) == (0.0, 0.0, 0.0, 1.0)


def test_attack_success(spark):
    rng = random.Random(3)
    heads = [(q, q * 100 + r, float(20 - r), r, f"text {q} {r}") for q in range(4) for r in range(1, 9)]
    attacks = [(k, k % 5, f"planted {k} MARK{k}", f"mark{k}", rng.choice([0.0, 11.0, 13.5, 16.0, 30.0])) for k in range(40)]
    frame = spark.createDataFrame(heads, "query_id int, id int, score double, rank int, text string")
    planted = spark.createDataFrame(attacks, "attack_id int, query_id int, text string, marker string, score double")
    last = lambda texts: F.element_at(texts, -1)
    got = {(r.form, r.k): (r.attempted, r.quarantined, r.injected, r.succeeded) for r in attack_success(frame, planted, F.col("attack_id") % 6 == 0, (1, 3, 6), last).collect()}
    want, seen = Counter(), Counter()
    for k, q, text, marker, score in attacks:
        seen[q] += 1
        rows = [(s, t) for hq, _, s, r, t in heads if hq == q and r <= 6]
        place = sum(s >= score for s, _ in rows)
        merged = [t for _, t in rows[:place]] + [text] + [t for _, t in rows[place:]]
        for n in (1, 3, 6):
            inside = k % 6 and score > 0 and place < n
            want[seen[q], n, 0] += 1
            want[seen[q], n, 1] += k % 6 == 0
            want[seen[q], n, 2] += bool(inside)
            want[seen[q], n, 3] += bool(inside and marker in merged[:n][-1].lower())
    assert got == {(f, n): tuple(want[f, n, j] for j in range(4)) for f, n, j in want if j == 0}


def test_ablation(spark):
    rng = random.Random(6)
    lists = [(c, q, i, r) for c in ("dense", "lexical") for q in range(5) for r, i in enumerate(rng.sample(range(30), 12), 1)]
    frame = spark.createDataFrame(lists, "channel string, query_id int, id int, rank int")
    arms = (Arm("one", ("dense",)), Arm("both", ("dense", "lexical"), 1.0), Arm("again", ("dense", "lexical"), 60.0, True), Arm("absent", ("graph",)))
    rescored = spark.createDataFrame([(q, i, float(i % 7)) for q in range(5) for i in range(0, 30, 2)], "query_id int, id int, rescore double")
    got = {}
    for r in ablation(frame, arms, 10, 8, rescored).orderBy("arm", "query_id", "rank").collect():
        got.setdefault((r.arm, r.query_id), []).append(r.id)
    for arm in arms[:3]:
        for q in range(5):
            score = Counter()
            for c, lq, i, r in lists:
                if lq == q and c in arm.channels:
                    score[i] += 1 / (arm.rrf_k + r)
            order = sorted(score, key=lambda i: (-round(score[i], 9), i))[:10]
            if arm.rerank:
                order.sort(key=lambda i: (i % 2, -(i % 7) if i % 2 == 0 else 0, i))
            assert got[arm.name, q] == order[:8], (arm.name, q)
    assert not any(a == "absent" for a, _ in got)


def test_folds_of_heads_agree_with_passes(spark):
    rng = random.Random(9)
    rows = [(q, rng.randrange(10**6), r, rng.choice([0, 5, 60, 300, 900, 2000]), rng.choice(["profile", "event", None])) for q in range(30) for r in range(1, rng.randint(2, 40))]
    head = spark.createDataFrame(rows, "query_id int, id int, rank int, tokens int, kind string")
    columns = ["query_id", "id", "tokens", "position", "total_tokens", "dropped_for_tokens", "k_bound"]
    plain = lambda df: sorted(tuple(r) for r in df.select(*columns).collect())
    for k, most in ((6, 1000), (1, 10), (50, 10**9)):
        assert plain(compose.head_budget(head, k, most)) == plain(compose.within_budget(head, k, most))
    places = lambda df: {(r.query_id, r["rank"]): r.position for r in df.collect()}
    assert places(compose.head_quota(head, "profile", 2)) == places(compose.kind_quota(head, "profile", 2))
    assert compose.head_budget(head.limit(0)).count() == 0


def test_composed(spark):
    rows = [(1, 10, 1, "a", 100, "event", "untrusted", 5), (1, 11, 2, "a", 100, "event", "asserted", 4), (1, 12, 3, "b", 100, "event", "untrusted", 3), (1, 13, 4, "c", 900, "event", "asserted", 2), (1, 14, 5, "d", 50, "profile", "verified", 1)]
    head = spark.createDataFrame(rows, "query_id int, id int, rank int, text string, tokens int, kind string, trust_tier string, t_valid int")
    got = {r.id: (r.slot, r.total_tokens, r.dropped_for_tokens, r.k_bound, r.trust) for r in compose.composed(head, 3, 500, untrusted=1, quota=("profile", 1)).collect()}
    assert got == {14: (1, 150, 1, False, "untrusted"), 10: (2, 150, 1, False, "untrusted")}
    assert [r.id for r in compose.composed(head, 4, 5000, by_time=True).orderBy("slot").collect()] == [14, 13, 12, 10]
    assert compose.composed(head.limit(0)).count() == 0
