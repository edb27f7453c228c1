"""Stems, citations, minted pools and repairs."""

import json

from pyspark.sql import functions as F

from palimpsest.functions.stems import with_stems
from palimpsest.operators.citations import premise_finding, uncited_terms
from palimpsest.operators.lineage import drift
from palimpsest.operators.minting import mint
from palimpsest.operators.repairs import repaired, report

#: Words and their stems as the published algorithm gives them.
STEMS = """
consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist
consisting consist consists consist consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid
consolidated consolid consolidating consolid consoling consol consolingly consol consols consol consonant conson consort consort consorted consort consorting consort
conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir
constable constabl constables constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri knacks knack knag knag knave knave
knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew
knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob
knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot
bake bake baked bake baking bake hopping hop hoping hope running run happily happili skies sky dying die news news inning inning proceed proceed generate generat
general general communication communic arsenal arsenal sing sing singing sing bed bed agreed agre feed feed ties tie cries cri gas gas gaps gap kiwis kiwi this this
relational relat conditional condit formalize formal triplicate triplic electrical electr hopeful hope goodness good adjustment adjust adoption adopt say say by by cry cri
""".split()


def test_stems(spark):
    pairs = dict(zip(STEMS[::2], STEMS[1::2], strict=True))
    got = {r.word: r.stem for r in with_stems(spark.createDataFrame([(w,) for w in pairs] + [(None,), ("ab",), ("",)], "word string")).collect()}
    assert {w: got[w] for w in pairs} == pairs and got[None] is None and got["ab"] == "ab" and got[""] == ""


def test_uncited_terms(spark):
    questions = spark.createDataFrame([(1, "Which 30-gallon tanks did Ann bake bread for, and when was the bread baked?"), (2, "what is it?"), (3, None), (4, "Lost boats")], "query_id int, text string")
    cited = spark.createDataFrame([(1, "ann was baking"), (1, "a TANK of water"), (4, None), (9, "lost")], "query_id int, text string")
    rows = uncited_terms(questions, cited)
    assert {r.query_id: r.terms for r in rows.collect()} == {1: ["30", "gallon", "bread"], 2: [], 3: [], 4: ["lost", "boats"]}
    told = {r.query_id: r.f for r in rows.select("query_id", premise_finding(F.col("terms")).alias("f")).collect()}
    assert told[2] is None and told[4] == "No memory mentions: lost, boats."
    assert uncited_terms(questions.limit(0), cited).count() == 0


def test_minting(spark):
    texts = lambda *t: json.dumps(t)
    replies = [("a", "event", texts(" x ", "", "y", *"cdefgh")), ("a", "note", texts("one", "two", "three")), ("b", "event", "cut"), ("c", "note", texts("lost")), ("a", "odd", texts("z")), (None, "note", texts("z")), ("a:b", "note", texts("deep"))]
    records = spark.createDataFrame([(1, "a:0", True), (2, "a:1", False), (3, "a:2:9", True), (4, "b:0", True), (5, None, True), (6, "ab:0", True), (7, "c", True)], "id int, source string, live boolean")
    frame, none = spark.createDataFrame(replies, "trajectory string, pool string, reply string"), spark.createDataFrame([], "trajectory string, pool string")
    got = mint(frame, records, none)
    assert sorted((r.id, r.kind, r.text) for r in got.records.collect()) == [*((f"a/event/{k}", "semantic", t) for k, t in enumerate("xycdef", 1)), ("a/note/1", "procedural", "one"), ("a/note/2", "procedural", "two")]
    assert {(r.src, r.dst) for r in got.lineage.collect()} == {(r.id, d) for r in got.records.collect() for d in (1, 3)}
    assert {tuple(r) for r in got.completed.collect()} == {("a", "event"), ("a", "note"), ("b", "event")} and {tuple(r) for r in got.refused.collect()} == {("c", "note"), ("a:b", "note")}
    again = mint(frame, records, got.completed)
    assert again.records.count() == 0 and again.completed.count() == 0 and again.refused.count() == 2


def test_repairs(spark):
    ledger = spark.createDataFrame([(1, True, "a", None), (2, True, "b", 2), (3, False, "c", 3), (4, True, "d", 4), (5, False, "e", 5)], "id int, live boolean, text string, n int")
    index = spark.createDataFrame([(1, "a", None), (2, "x", 2), (3, "c", 3), (9, "z", 9), (2, "b", 2)], "id int, text string, n int")
    links = spark.createDataFrame([(1, 2, "r"), (1, 8, "r"), (8, 1, "r"), (1, 5, "r")], "src int, dst int, relation string")
    incidence = spark.createDataFrame([("p", 1, 1.0), ("p", 7, 1.0)], "phrase string, record_id int, weight double")
    assert {r.kind: r.n for r in report(ledger, index, links, incidence, ["text", "n"]).collect()} == {"orphan": 1, "stale": 1, "missing": 1, "drifted": 1, "dangling_link": 2, "orphan_incidence": 1}
    got = repaired(ledger, index, links, incidence, ["text", "n"])
    assert sorted(tuple(r) for r in got.index.collect()) == [(1, "a", None), (2, "b", 2), (4, "d", 4)]
    assert {tuple(r) for r in got.links.collect()} == {(1, 2, "r"), (1, 5, "r")} and {tuple(r) for r in got.incidence.collect()} == {("p", 1, 1.0)}
    assert drift(ledger, got.index, ["text", "n"]).count() == 0 and report(ledger, got.index, got.links, got.incidence, ["text", "n"]).count() == 0
    assert repaired(ledger, got.index, got.links, got.incidence, ["text", "n"]).changes.count() == 0
