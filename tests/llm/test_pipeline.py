import corpus_pipeline as pipeline
from palimpsest.llm.exactdedup import exact_duplicates


def test_stages(spark, rows, tmp_path):
    bench = "the marble statue in the northern hall was carved by an unknown hand long before the palace had any walls at all"
    extra = [(1, f"It is said that {bench} and nobody knows why", "en", "s", 1), (2, "The garden of the old house is full of light in the morning", "en", "s", 1), (3, "The garden of the OLD house is full of light in the morning", "en", "s", 1)]
    docs = spark.createDataFrame([r[:5] for r in rows] + extra, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(pipeline.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id for r in docs.collect()}
    assert not kept["language_id"] & {r[0] for r in rows if not any(c.isalpha() for c in r[1] or "")}
    assert kept["exact_dedup"] & {2, 3} == {3} and exact_duplicates(spark.read.parquet(f"{tmp_path}/exact_dedup")).filter("NOT kept").count() == 0
    assert 1 in kept["near_dedup"] and 1 not in kept["decontamination"] and 3 in kept["decontamination"]
    assert kept["packing"] == kept["decontamination"]
    assert {r.doc_id for r in pipeline.run(spark, str(tmp_path)).collect()} == kept["packing"]


def test_near_dedup_finds_five_word_copies(spark):
    """One word in sixty changed: similar by five-word shingles, far apart by fingerprint."""
    import random

    from palimpsest.llm.simhash import fingerprint, shingle_hashes

    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    text, copy = " ".join(words), " ".join([*words[:30], "other", *words[31:]])
    assert (fingerprint(shingle_hashes(text.encode(), 3)) ^ fingerprint(shingle_hashes(copy.encode(), 3))).bit_count() > 2
    docs = spark.createDataFrame([(1, text), (2, copy), (3, " ".join(reversed(words)))], "doc_id long, text string")
    assert {r.doc_id for r in pipeline.near_dedup(spark, docs, "").collect()} == {1, 3}


def test_stages_leave_small_batches(spark, tmp_path):
    """A stage's result is computed when it is written: what runs then hands Python few rows at once, not a task's texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    docs = spark.createDataFrame([(1, "The garden of the old house", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, "a marble statue in the hall")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.record_batch([pa.array([batch.num_rows])], names=["n"])

    try:
        for name, stage in pipeline.STAGES:
            for given, most in (("10000", 256), ("0", 256), ("100", 100)):
                spark.conf.set(key, given)
                stage(spark, docs, str(tmp_path))
                found = spark.range(0, 1000, 1, 1).mapInArrow(sizes, "n long").agg({"n": "max"}).first()[0]
                assert found == most, name
    finally:
        spark.conf.set(key, before)
