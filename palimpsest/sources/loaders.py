"""Readers of conversation, question and trajectory files, as DataFrames of turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.temporal import session_time

TURN = "struct<speaker: string, dia_id: string, text: string, img_url: array<string>, blip_caption: string>"


def session_conversations(spark: SparkSession, path: str) -> DataFrame:
    """``sample_id, session, at, position, speaker, dia_id, text`` from a JSON array of samples.

    Sessions are keys named session_N, found in the data and ordered by their number; a caption is folded
    into its turn's text.
    """
    raw = spark.read.option("multiLine", True).schema("sample_id string, conversation string").json(path)
    keyed = raw.select("sample_id", F.from_json("conversation", "map<string, string>").alias("c"))
    entries = keyed.select("sample_id", "c", F.explode("c").alias("key", "value")).filter(F.col("key").rlike(r"^session_\d+$"))
    sessions = entries.select("sample_id", F.regexp_extract("key", r"(\d+)", 1).cast("int").alias("session"), session_time(F.element_at("c", F.concat("key", F.lit("_date_time")))).alias("at"), F.from_json("value", f"array<{TURN}>").alias("turns"))
    turns = sessions.select("sample_id", "session", "at", F.posexplode("turns").alias("position", "t"))
    return turns.select("sample_id", "session", "at", "position", "t.speaker", "t.dia_id", with_caption(F.col("t.text"), F.col("t.blip_caption")).alias("text"))


def with_caption(text: Column, caption: Column) -> Column:
    return F.when(F.trim(caption) != "", F.concat(text, F.lit(" [shared an image: "), F.trim(caption), F.lit("]"))).otherwise(text)


QUESTION = "question_id string, question_type string, question string, answer string, question_date string, haystack_dates array<string>, haystack_session_ids array<string>, haystack_sessions array<array<struct<role: string, content: string, has_answer: boolean>>>"


def haystack_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions with their sessions; a numeric answer reads as its text; ids ending in _abs have no answer."""
    return spark.read.option("multiLine", True).option("primitivesAsString", True).schema(QUESTION).json(path).withColumn("abstention", F.col("question_id").endswith("_abs"))


def haystack_turns(questions: DataFrame) -> DataFrame:
    """``question_id, session_id, at, position, role, content``."""
    zipped = questions.select("question_id", F.explode(F.arrays_zip("haystack_session_ids", "haystack_dates", "haystack_sessions")).alias("s"))
    turns = zipped.select("question_id", F.col("s.haystack_session_ids").alias("session_id"), session_time(F.col("s.haystack_dates")).alias("at"), F.posexplode("s.haystack_sessions").alias("position", "t"))
    return turns.select("question_id", "session_id", "at", "position", "t.role", "t.content")


STATE = "struct<state_index: int, step: int, url: string, action: string, thought: string, accessibility_tree: string, screenshot: string>"


def trajectories(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """Trajectory rows of a JSONL file; with ``wanted(id)`` only those, dropped before states are unfolded."""
    rows = spark.read.schema(f"id string, domain string, environment string, goal string, outcome string, start_url string, states array<{STATE}>").json(path)
    return rows if wanted is None else rows.join(wanted.select("id"), "id", "left_semi")


def trajectory_turns(rows: DataFrame, limit: int = 1800) -> DataFrame:
    """``trajectory, unit, position, text``: the goal, the steps, and each page in packed chunks of lines."""
    from palimpsest.functions.text import pack_lines

    goal = rows.select(F.col("id").alias("trajectory"), F.lit("goal").alias("unit"), F.lit(0).alias("position"), F.col("goal").alias("text"))
    states = rows.select(F.col("id").alias("trajectory"), F.explode("states").alias("s"))
    step = F.concat_ws("\n", F.col("s.thought"), F.col("s.action"))
    steps = states.select("trajectory", F.lit("steps").alias("unit"), F.col("s.state_index").alias("position"), step.alias("text")).filter(F.col("text") != "")
    pages = states.filter(F.col("s.accessibility_tree").isNotNull()).select("trajectory", F.concat(F.lit("page "), F.col("s.state_index").cast("string")).alias("unit"), F.posexplode(pack_lines(F.col("s.accessibility_tree"), limit)).alias("position", "text"))
    return goal.unionByName(steps).unionByName(pages)


def haystacks_by_domain(haystacks: DataFrame) -> DataFrame:
    """``domain, ids, consistent``: the trajectory ids of a domain, and whether all its questions share them."""
    sets = haystacks.groupBy("domain", "question_id").agg(F.array_sort(F.collect_set("trajectory_id")).alias("ids"))
    return sets.groupBy("domain").agg(F.first("ids").alias("ids"), (F.countDistinct("ids") == 1).alias("consistent"))


def verified_files(spark: SparkSession, path: str, pinned: DataFrame) -> DataFrame:
    """``path, ok`` of files against ``pinned(name, sha256)``; files without a pin are not ok."""
    files = spark.read.format("binaryFile").load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("digest"))
    return files.join(pinned, "name", "left").select("path", F.coalesce(F.col("digest") == F.col("sha256"), F.lit(False)).alias("ok"))


def run_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Rows of every per_question.jsonl below a folder, with the run each came from."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "per_question.jsonl").json(path)
    return rows.withColumn("run", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
