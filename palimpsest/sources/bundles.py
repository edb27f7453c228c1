"""Canonical export and import of a namespace, and resumable appends."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1
#: Sort keys that make a table's export the same whatever its order was.
ORDER = {"records": ["id"], "links": ["src", "dst", "relation"], "incidence": ["record_id", "phrase"], "events": ["seq"], "quarantine": ["id"], "acl_ua": ["user_id", "agent_id"], "acl_ar": ["agent_id", "namespace"], "trajectories": ["id"], "states": ["trajectory", "state_index"]}


def namespace_tables(tables: dict[str, DataFrame], tenant: str, namespace: str) -> dict[str, DataFrame]:
    """The rows of one namespace: records, quarantine and trajectories in scope, of the rest what names one of them.

    A table with tenant and namespace is cut by them, one with either by that; states go with their trajectory. Only
    the access edges, which belong to no namespace, are exported whole.
    """
    records = tables["records"].filter((F.col("tenant") == tenant) & (F.col("namespace") == namespace))
    ids = records.select("id")
    found = {"records": records}
    by = {"links": "src", "incidence": "record_id", "events": "record_id"}
    for name, table in tables.items():
        if name in by:
            found[name] = table.join(ids.withColumnRenamed("id", by[name]), by[name], "left_semi").select(*table.columns)
        elif name in ("acl_ua", "acl_ar"):
            found[name] = table
        elif name != "records":
            scope = {"tenant": tenant, "namespace": namespace}
            owned = [c for c in scope if c in table.columns]
            if not owned and name == "quarantine" and "record" in table.columns:  # the staged record is JSON
                of = lambda c: F.coalesce(F.get_json_object("record", f"$.scope.{c}"), F.get_json_object("record", f"$.{c}"))
                found[name] = table.filter((of("tenant") == tenant) & (of("namespace") == namespace))
            elif owned:
                for c in owned:
                    table = table.filter(F.col(c) == scope[c])
                found[name] = table
            elif name == "states" and "trajectories" in tables:
                mine = namespace_tables({"records": tables["records"], "trajectories": tables["trajectories"]}, tenant, namespace)["trajectories"]
                found[name] = table.join(mine.select(F.col("id").alias("trajectory")).distinct(), "trajectory", "left_semi").select(*table.columns)
            else:
                raise ValueError(f"table {name} does not say whose its rows are")
    return found


def export_bundle(tables: dict[str, DataFrame], path: str, config: dict) -> None:
    """One sorted JSON folder a table, and a manifest with version and configuration. Refuses to overwrite."""
    spark = next(iter(tables.values())).sparkSession
    for name, table in sorted(tables.items()):
        table.select(*sorted(table.columns)).orderBy(*[c for c in ORDER.get(name, sorted(table.columns)) if c in table.columns]).write.option("ignoreNullFields", False).json(f"{path}/{name}")
    manifest = [(json.dumps({"version": VERSION, "config": config, "tables": {n: t.schema.json() for n, t in sorted(tables.items())}}, sort_keys=True),)]
    spark.createDataFrame(manifest, "value string").coalesce(1).write.text(f"{path}/manifest")


def import_bundle(spark: SparkSession, path: str, config: dict) -> dict[str, DataFrame]:
    """The tables of a bundle, verbatim; another version or configuration is refused."""
    from pyspark.sql.types import StructType

    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    if manifest["version"] != VERSION:
        raise ValueError(f"bundle version {manifest['version']}, expected {VERSION}")
    if manifest["config"] != config:
        raise ValueError("the bundle was made under another configuration")
    tables = {}
    for name, schema in manifest["tables"].items():
        shape = StructType.fromJson(json.loads(schema))
        tables[name] = spark.read.schema(shape).json(f"{path}/{name}").select(*shape.names)
    return tables


def append_missing(rows: DataFrame, path: str, key: str) -> DataFrame:
    """Append the rows whose key the sink does not have yet; returns what was appended."""
    spark = rows.sparkSession
    try:
        known = spark.read.schema(rows.schema).json(path).select(key).distinct()
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        known = spark.createDataFrame([], rows.select(key).schema)
    fresh = rows.dropDuplicates([key]).join(known, key, "left_anti")
    fresh.write.mode("append").json(path)
    return fresh


def shard(rows: DataFrame, key: str, index: int, count: int) -> DataFrame:
    """The part ``index`` of ``count`` by a hash of the key."""
    return rows.filter(F.pmod(F.xxhash64(key), F.lit(count)) == index)
