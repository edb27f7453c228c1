"""Outcomes applied in order, and the ledger that they leave."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import ledger
from palimpsest.operators.applying import apply_in_order
from palimpsest.plans.common import register, table

_OUTCOME = {
    "seq": "event_id",
    "user_id": "user_id",
    "op": "CASE event_type WHEN 'signup' THEN 'add' WHEN 'click' THEN 'add' WHEN 'purchase' THEN 'update' WHEN 'error' THEN 'delete' ELSE 'noop' END",
    "id": "user_id * 100 + cast(floor(value * 100) as bigint) % 25",
    "target": "user_id * 100 + cast(regexp_extract(props, '[0-9]+', 0) as bigint) % 25",
}
_ROWS = [f"{e} AS {c}" for c, e in _OUTCOME.items()]


def _outcomes(spark, sf):
    """Each event as a judged candidate of its user: clicks derive from the target, purchases replace it, errors end it."""
    rows = table(spark, sf, "events").selectExpr(*_ROWS, "event_type", "unix_timestamp(ts) AS at")
    return rows.withColumn("parents", F.when(F.col("event_type") == "click", F.array("target")))


_APPLIED = f"""
WITH RECURSIVE o AS (SELECT {', '.join(_ROWS)}, event_type = 'click' AS derives, floor(epoch(ts))::BIGINT AS moment, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
f AS (SELECT user_id, 0::BIGINT AS k, NULL::BIGINT AS seq, NULL::VARCHAR AS op, NULL::BIGINT AS id, NULL::BIGINT AS target, NULL::BIGINT AS moment, NULL::BOOLEAN AS accepted, []::BIGINT[] AS ids FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT user_id, k, seq, op, id, target, moment, good, CASE WHEN good AND op IN ('add', 'update') THEN list_append(ids, id) ELSE ids END FROM (
    SELECT o.*, f.ids, CASE op2 WHEN 'add' THEN NOT list_contains(f.ids, o.id) AND (NOT derives OR list_contains(f.ids, o.target)) WHEN 'update' THEN NOT list_contains(f.ids, o.id) AND list_contains(f.ids, o.target)
      WHEN 'delete' THEN list_contains(f.ids, o.target) ELSE true END AS good FROM f JOIN (SELECT *, op AS op2 FROM o) o ON o.user_id = f.user_id AND o.k = f.k + 1))
"""


@register("U5_applied", _APPLIED + "SELECT seq, op, accepted, CASE WHEN accepted THEN op ELSE 'consolidate_rejected' END AS event FROM f WHERE seq IS NOT NULL")
def applied(spark, sf):
    outcomes = _outcomes(spark, sf)
    return apply_in_order(outcomes, outcomes.select("id").limit(0)).select("seq", "op", "accepted", "event")


@register("U1_ledger", _APPLIED + """,
e AS (SELECT target AS id, arg_min(moment, seq) AS t_invalid FROM f WHERE accepted AND op IN ('update', 'delete') GROUP BY target)
SELECT f.id, f.seq, f.moment AS t_valid, e.t_invalid FROM f LEFT JOIN e ON e.id = f.id WHERE accepted AND op IN ('add', 'update')""")
def after(spark, sf):
    """The records that accepted outcomes wrote, each ended by the first that replaced or deleted it."""
    outcomes = _outcomes(spark, sf)
    deltas = apply_in_order(outcomes, outcomes.select("id").limit(0)).filter("accepted").select("seq", "op", "id", "target", "at", F.col("at").alias("t_valid"))
    return ledger.current_records(deltas).select("id", "seq", "t_valid", "t_invalid")
