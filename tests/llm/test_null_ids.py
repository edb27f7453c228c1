"""Rows whose id is null or shared, in every operator on documents."""

import hashlib
from collections import Counter

from palimpsest.llm.decontam import contamination
from palimpsest.llm.exactdedup import exact_duplicates
from palimpsest.llm.langid import identify
from palimpsest.llm.packing import pack
from palimpsest.llm.phrases import collocations
from palimpsest.llm.simhash import near_duplicates
from palimpsest.llm.substrdedup import repeated_windows
from palimpsest.llm.suffixdedup import repeated_substrings

PASSAGE = "the stone house by the river has a garden full of light and people come in the evening to sit there and tell the stories that children love to hear again and again before they go home to sleep"
ROWS = [(None, f"first {PASSAGE} end"), (None, PASSAGE), (7, f"other words here {PASSAGE}"), (7, "short"), (7, "short"), (9, None), (None, None), (-3, PASSAGE)]
IDS = Counter(r[0] for r in ROWS)


def frame(spark):
    return spark.createDataFrame([(*r, "en") for r in ROWS], "doc_id long, text string, lang string").repartition(3)


def test_all_rows_come_back(spark):
    docs = frame(spark)
    bench = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    found = {
        "language": identify(docs, docs), "exact": exact_duplicates(docs), "suffix": repeated_substrings(docs), "decontam": contamination(docs, bench),
        "windows": repeated_windows(docs), "simhash": near_duplicates(docs),
    }
    for name, rows in found.items():
        assert Counter(r.doc_id for r in rows.select("doc_id").collect()) == IDS, name


def test_substrings_null_is_the_least_id(spark):
    """Copies in rows with a null id stay; later ids lose them, and rows of one id do not remove each other."""
    body = PASSAGE.encode()
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in repeated_substrings(frame(spark), chunk_bytes=200).collect()), key=repr)
    want = [(None, len(ROWS[0][1]), 0), (None, len(body), 0), (None, 0, 0), (7, len(ROWS[2][1]), len(body)), (7, 5, 0), (7, 5, 0), (9, 0, 0), (-3, len(body), len(body))]
    for i, n, removed in want:  # a byte before or after the passage may repeat with it
        assert any(g[0] == i and g[1] == n and removed <= g[2] <= removed + 2 for g in got), (i, n, removed, got)


def test_windows_count_every_row(spark):
    got = [r for r in repeated_windows(frame(spark), chunk_bytes=200).collect() if r.n_words > 30]
    assert len(got) == 4 and all(r.n_removed == len(PASSAGE.split()) for r in got)
    assert {r.kept_sha256 for r in got} == {hashlib.sha256(x).hexdigest() for x in (b"", b"first end", b"other words here")}


def test_packing_keeps_every_row(spark):
    pieces = pack(frame(spark), partitions=3).collect()
    starts = [p for p in pieces if p.start == 0]
    assert Counter(p.doc_id for p in starts) == IDS
    assert sum(p.length for p in pieces) == sum(p.doc_tokens for p in starts)


def test_phrases_count_every_row(spark):
    got = {r.phrase: r.a for r in collocations(frame(spark), 2, 4, chunk_bytes=200).collect()}
    assert got["stone house"] == 4
