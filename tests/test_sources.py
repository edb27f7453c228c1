import json

import pytest

from palimpsest.sources import bundles, connectors, loaders
from palimpsest.streaming import sessions


def test_conversations(spark, tmp_path):
    turn = lambda k, t, c=None: {"speaker": "A", "dia_id": f"D{k}", "text": t, "blip_caption": c}
    sample = [{"sample_id": "s1", "conversation": {"session_10": [turn(3, "late")], "session_2": [turn(1, "hi", "a dog"), turn(2, "there")], "session_2_date_time": "1:56 pm on 8 May, 2023", "speaker_a": "A"}}]
    (tmp_path / "c.json").write_text(json.dumps(sample))
    rows = loaders.session_conversations(spark, str(tmp_path / "c.json")).orderBy("session", "position").collect()
    assert [(r.session, r.dia_id) for r in rows] == [(2, "D1"), (2, "D2"), (10, "D3")]
    assert rows[0].text == "hi [shared an image: a dog]" and str(rows[0].at) == "2023-05-08 13:56:00" and rows[2].at is None


def test_haystacks(spark, tmp_path):
    item = [{"question_id": "q_abs", "question": "?", "answer": 7, "haystack_session_ids": ["x"], "haystack_dates": ["2023/05/20 (Sat) 02:21"], "haystack_sessions": [[{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]]}]
    (tmp_path / "h.json").write_text(json.dumps(item))
    questions = loaders.haystack_questions(spark, str(tmp_path / "h.json"))
    assert questions.first().answer == "7" and questions.first().abstention
    assert [(r.position, r.role) for r in loaders.haystack_turns(questions).orderBy("position").collect()] == [(0, "user"), (1, "assistant")]


def test_trajectories(spark, tmp_path):
    rows = [{"id": f"t{k}", "goal": "g", "states": [{"state_index": 0, "action": "click", "accessibility_tree": "a\nb"}]} for k in range(3)]
    (tmp_path / "t.jsonl").write_text("\n".join(map(json.dumps, rows)))
    wanted = spark.createDataFrame([("t1",)], "id string")
    got = loaders.trajectory_turns(loaders.trajectories(spark, str(tmp_path / "t.jsonl"), wanted)).collect()
    assert {(r.trajectory, r.unit, r.text) for r in got} == {("t1", "goal", "g"), ("t1", "steps", "click"), ("t1", "page 0", "a\nb")}


def test_bundle_round_trip(spark, tmp_path):
    records = spark.createDataFrame([("b", "t", "n", None), ("a", "t", "n", 1.5), ("c", "t", "other", 2.0)], "id string, tenant string, namespace string, x double")
    links = spark.createDataFrame([("a", "b", "supersedes"), ("c", "a", "derived_from")], "src string, dst string, relation string")
    tables = bundles.namespace_tables({"records": records, "links": links}, "t", "n")
    bundles.export_bundle(tables, str(tmp_path / "one"), {"k": 60})
    back = bundles.import_bundle(spark, str(tmp_path / "one"), {"k": 60})
    bundles.export_bundle(back, str(tmp_path / "two"), {"k": 60})
    read = lambda p: {f.parent.name: f.read_bytes() for f in sorted((tmp_path / p).rglob("part-*"))}
    assert read("one") == read("two") and sorted(r.id for r in back["records"].collect()) == ["a", "b"] and back["links"].count() == 1
    with pytest.raises(ValueError):
        bundles.import_bundle(spark, str(tmp_path / "one"), {"k": 1})


def test_append_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    bundles.append_missing(rows, str(tmp_path / "s"), "id")
    bundles.append_missing(spark.createDataFrame([(2, "b"), (3, "c")], "id long, v string"), str(tmp_path / "s"), "id")
    assert sorted(r.id for r in spark.read.json(str(tmp_path / "s")).collect()) == [1, 2, 3]
    assert sum(bundles.shard(rows, "id", k, 3).count() for k in range(3)) == 2


def test_connectors(spark):
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return 5

    assert connectors.with_retry(flaky, sleep=lambda _: None) == 5
    with pytest.raises(connectors.Permanent):
        connectors.with_retry(lambda: (_ for _ in ()).throw(connectors.Permanent()))
    rows = connectors.embed_column(spark.createDataFrame([(1, "alpha"), (2, None)], "id int, text string"), connectors.HashEmbedder(4)).orderBy("id").collect()
    assert abs(sum(x * x for x in rows[0].vector) - 1) < 1e-6 and rows[1].vector == [0.0] * 4
    assert connectors.OverlapReranker().score("red fox", ["a red hat", "fox red"]) == [0.5, 1.0]


def test_guard():
    guard = sessions.FailureGuard()
    assert not guard.add(8, 3) and guard.add(1, 0)
    calm = sessions.FailureGuard()
    assert not calm.add(1000, 0) and not calm.add(100, 20 // 2 - 5)


def test_session_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [{"unit": "u", "at": f"2024-01-01T{h:02d}:{m:02d}:00"} for h, m in [(0, 0), (0, 30), (1, 29), (5, 0), (23, 0)]]
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, lines)))
    stream = spark.readStream.schema("unit string, at timestamp").json(str(tmp_path / "in"))
    query = sessions.gap_sessions(stream, "unit").writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [r.n_turns for r in spark.table("closed").orderBy("first_at").collect()] == [3, 1]


def test_accumulator_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(json.dumps({"k": "a", "x": 70}) for _ in range(5)))
    stream = spark.readStream.schema("k string, x double").json(str(tmp_path / "in"))
    query = sessions.accumulate(stream, "k", "x", 150).writeStream.format("memory").queryName("fires").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [(r.key, r.fired, r.left) for r in spark.table("fires").collect()] == [("a", 2, 50.0)]
