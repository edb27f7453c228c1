"""Adapters that let the star-schema and document tables play the engine's entities.

The expressions are plain enough for Spark and DuckDB alike, so a query and its SQL check share them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

T0 = 1704067200
NOW = T0 + 400 * 3600

RECORD = {
    "id": "doc_id",
    "tenant": "source",
    "namespace": "lang",
    "kind": "CASE doc_id % 7 WHEN 0 THEN 'episodic' WHEN 1 THEN 'semantic' WHEN 2 THEN 'procedural' WHEN 3 THEN 'profile' WHEN 4 THEN 'working' WHEN 5 THEN 'event' ELSE 'gist' END",
    "text": "text",
    "t_valid": f"{T0} + doc_id * 3600",
    "t_invalid": f"CASE WHEN doc_id % 5 = 0 THEN {T0} + doc_id * 3600 + 86400 * (doc_id % 40) END",
    "t_expired": f"CASE WHEN doc_id % 13 = 0 THEN {T0} + doc_id * 3600 + 864000 END",
    "t_ingested": f"{T0} + doc_id * 3600 + doc_id % 600",
    "trust_tier": "CASE WHEN doc_id % 11 = 0 THEN 'quarantined' WHEN doc_id % 11 < 4 THEN 'untrusted' WHEN doc_id % 11 < 8 THEN 'asserted' ELSE 'verified' END",
    "prov_source": "CASE WHEN doc_id % 17 <> 0 THEN concat(source, ':', cast(doc_id as string)) END",
}
RECORDS_SQL = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in RECORD.items()) + " FROM documents"
ADMISSIBLE_SQL = f"prov_source IS NOT NULL AND trust_tier <> 'quarantined' AND t_valid <= {NOW} AND (t_invalid IS NULL OR t_invalid > {NOW}) AND (t_expired IS NULL OR t_expired > {NOW})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*[f"{RECORD[c]} AS {c}" for c in columns or RECORD])


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep
