"""Scope and admissibility: predicates that belong before any ranking."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("episodic", "semantic", "procedural", "profile", "working", "event", "gist")
KEY = re.compile(r"[a-z_][a-z0-9_]*")


def admissible(now: Column) -> Column:
    """Has provenance, is not quarantined, and is valid and not expired at ``now``."""
    open_at = lambda c: F.col(c).isNull() | (F.col(c) > now)
    return F.col("prov_source").isNotNull() & (F.col("trust_tier") != "quarantined") & (F.col("t_valid") <= now) & open_at("t_invalid") & open_at("t_expired")


def in_scope(tenant: str, namespace: str | None = None, agent: str | None = None, session: str | None = None, kinds: Iterable[str] | None = None) -> Column:
    """The tenant always; the rest if given."""
    if not tenant:
        raise ValueError("a read needs a tenant")
    found = F.col("tenant") == tenant
    for name, value in (("namespace", namespace), ("agent", agent), ("session", session)):
        if value is not None:
            found = found & (F.col(name) == value)
    return found & F.col("kind").isin(*kinds) if kinds else found


def meta_equals(key: str, value: str | int, meta: str = "meta") -> Column:
    """A top-level key of a JSON object equals the value, or is an array that holds it."""
    _check_key(key)
    got = F.get_json_object(meta, f"$.{key}")
    items = F.from_json(got, "array<string>")
    return F.coalesce((got == str(value)) | F.array_contains(items, str(value)), F.lit(False))


def meta_range(key: str, gt: int | None = None, gte: int | None = None, lt: int | None = None, lte: int | None = None, meta: str = "meta") -> Column:
    """An integer key within bounds; rows without it, or with another type, fail."""
    _check_key(key)
    bounds = [(gt, "__gt__"), (gte, "__ge__"), (lt, "__lt__"), (lte, "__le__")]
    if all(b is None for b, _ in bounds):
        raise ValueError("a range needs a bound")
    got = F.get_json_object(meta, f"$.{key}").try_cast("bigint")
    test = F.lit(True)
    for bound, op in bounds:
        if bound is not None:
            test = test & getattr(got, op)(bound)
    return F.coalesce(test, F.lit(False))


def _check_key(key: str) -> None:
    if not KEY.fullmatch(key):
        raise ValueError(f"not a key: {key!r}")


def newest(records: DataFrame, limit: int) -> DataFrame:
    """The latest ingested first; ties by id."""
    return records.orderBy(F.desc("t_ingested"), "id").limit(limit)


def namespace_counts(live: DataFrame) -> DataFrame:
    return live.groupBy("namespace").agg(F.count(F.lit(1)).alias("n"))


def missing_provenance(records: DataFrame) -> DataFrame:
    return records.filter(F.col("prov_source").isNull())


def index_payload(records: DataFrame) -> DataFrame:
    """What an index keeps of a record: epoch seconds, 0 for a fact never retracted."""
    return records.select("id", "tenant", "namespace", "kind", F.col("t_valid").cast("long").alias("t_valid"), F.coalesce(F.col("t_invalid").cast("long"), F.lit(0)).alias("t_invalid"), "trust_tier")


def index_scan(index: DataFrame, namespace: str) -> DataFrame:
    """The payload of one namespace in an index table; the filter reaches the scan."""
    return index.filter(F.col("namespace") == namespace)
