"""The memory store's reads and writes as methods that return DataFrames.

State is a set of tables (DataFrames) and every write returns a new store: nothing is changed in place. ``now``
is always a parameter, so a plan never depends on the clock.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.ids import tenant_namespace, uuid5
from palimpsest.functions.replies import evidence_label, verdict_tier
from palimpsest.functions.text import approx_tokens, phrases, preview
from palimpsest.functions.trust import assess_trust
from palimpsest.operators import channels, compose, ledger, lineage, pools, predicates, segment, trajectories
from palimpsest.operators.checkpoints import cut_lineage
from palimpsest.operators.investigate import Investigation, investigate
from palimpsest.operators.ranks import spread_rank

MAX_STUBS = 200


@dataclass(frozen=True)
class Scope:
    tenant: str
    namespace: str | None = None
    agent: str | None = None
    session: str | None = None
    kinds: tuple[str, ...] | None = None

    def condition(self) -> Column:
        return predicates.in_scope(self.tenant, self.namespace, self.agent, self.session, self.kinds)


@dataclass(frozen=True)
class Memory:
    records: DataFrame
    links: DataFrame
    events: DataFrame
    incidence: DataFrame | None = None
    states: DataFrame | None = None
    headers: DataFrame | None = None
    now: int = 0
    settings: dict = field(default_factory=lambda: {"k": 6, "tokens": 2048, "depth": 50, "rrf_k": 1.0})

    def live(self, scope: Scope, as_of: int | None = None, filters: tuple[Column, ...] = ()) -> DataFrame:
        rows = self.records.filter(scope.condition() & predicates.admissible(F.lit(self.now if as_of is None else as_of)))
        for f in filters:
            rows = rows.filter(f)
        return rows

    def recall(self, queries: DataFrame, scope: Scope, as_of: int | None = None, filters: tuple[Column, ...] = (), subqueries: DataFrame | None = None, rerank: Callable[[DataFrame], Column] | None = None, abstain_below: float | None = None, untrusted: int | None = None, quota: tuple[str, int] | None = None, dated: bool = False, chronological: bool = False) -> DataFrame:
        """Evidence for any number of ``queries(query_id, text)`` in one plan: ``query_id, id, slot, type, value``.

        Scope and admissibility come before ranking. Sub-queries (query_id, text) add lists of their own to the
        same fusion. The head of each query is composed within the budget; ``quota`` (kind, n) puts a kind's first n
        rows ahead. Slots are bookended, or ``chronological``; ``dated`` labels each text with its day, a mark if it is
        untrusted, and what its relative phrases mean.
        """
        s = self.settings
        live = self.live(scope, as_of, filters)
        lists = channels.lexical(queries, live.select("id", "text"), s["depth"]).select("query_id", "id", "rank")
        if subqueries is not None:
            named = subqueries.select(F.struct("query_id", "text").alias("query_id"), "text").distinct()
            hits = channels.lexical(named, live.select("id", "text"), s["depth"])
            lists = lists.unionByName(hits.select(F.col("query_id.query_id").alias("query_id"), "id", "rank"))
        head = channels.rrf(lists, s["rrf_k"], s["depth"]).join(live.select("id", "text", "trust_tier", "kind"), "id")
        if rerank is not None:
            head = channels.rerank(head.join(queries.select("query_id", F.col("text").alias("question")), "query_id"), rerank(head), abstain_below)
        head = compose.distinct_texts(head)
        if untrusted is not None:
            head = compose.untrusted_ceiling(head, untrusted)
        if quota is not None:
            head = compose.head_quota(head, *quota).drop("rank").withColumnRenamed("position", "rank")
        kept = compose.head_budget(head.withColumn("tokens", approx_tokens(F.col("text"))), s["k"], s["tokens"])
        shown = kept.join(live.select("id", "text", "kind", "trust_tier", "t_valid"), "id")
        placed = compose.chronological(shown, rank="position").withColumnRenamed("place", "slot") if chronological else compose.bookend(shown)
        day = F.to_date(F.timestamp_seconds("t_valid"))
        value = evidence_label(F.col("text"), F.col("kind"), F.col("trust_tier"), day) if dated else F.col("text")
        return placed.select("query_id", "id", "slot", F.lit("text").alias("type"), value.alias("value"))

    def search(self, scope: Scope, limit: int = 20) -> DataFrame:
        """Stubs, newest ingested first."""
        return predicates.newest(self.live(scope), min(limit, MAX_STUBS)).select("id", "kind", preview(F.col("text")).alias("preview"), "t_ingested")

    def profile(self, scope: Scope, limit: int = 20) -> DataFrame:
        return self.search(replace(scope, kinds=("profile",)), limit)

    def namespaces(self, tenant: str) -> DataFrame:
        return predicates.namespace_counts(self.live(Scope(tenant)))

    def neighbors(self, scope: Scope, record_id, relation: str | None = None) -> DataFrame:
        ids = self.records.filter(scope.condition()).select("id")
        around = lineage.neighbors(self.links, ids.filter(F.col("id") == record_id), relation)
        return around.join(ids.withColumnRenamed("id", "other"), "other", "left_semi")

    def explain(self, scope: Scope, record_id) -> tuple[DataFrame, DataFrame]:
        """(ancestors with their depth, the record's events in order)."""
        seed = self.records.filter(scope.condition() & (F.col("id") == record_id)).select("id")
        edges = self.links.filter(F.col("relation") == "derived_from").select(F.col("src").alias("child"), F.col("dst").alias("parent"))
        return lineage.ancestors(seed, edges), self.events.join(seed.withColumnRenamed("id", "record_id"), "record_id", "left_semi").orderBy("seq")

    def review_quarantine(self, tenant: str) -> DataFrame:
        return self.records.filter((F.col("tenant") == tenant) & (F.col("trust_tier") == "quarantined")).orderBy("id")

    def remember(self, incoming: DataFrame, source_tier: str = "asserted", judge: Callable[[Column], Column] | None = None) -> Memory:
        """Add records once each; their text decides whether they are trusted, and an event logs each.

        ``judge`` gives a model's reply about a text; an injection, or a reply that cannot be read, quarantines.
        """
        fresh = ledger.new_only(incoming, self.records)
        tier = assess_trust(F.col("text"), F.lit(source_tier))["tier"]
        judged = fresh.withColumn("trust_tier", tier if judge is None else verdict_tier(judge(F.col("text")), tier)).select(*self.records.columns)
        judged = cut_lineage(judged)  # the judge is asked once, and all tables hear the same
        incidence = self.incidence
        if incidence is not None:
            batch = judged.select(F.explode(phrases("text")).alias("phrase"), F.col("id").alias("record_id"), F.lit(1.0).alias("weight"))
            incidence = ledger.replace_incidence(incidence, batch)
        return replace(self, records=self.records.unionByName(judged), incidence=incidence, events=self._logged(judged.select("id"), "add"))

    def observe(self, turns: DataFrame, scope: Scope, source_tier: str = "asserted", judge: Callable[[Column], Column] | None = None, gap_seconds: int = segment.GAP_SECONDS, token_cap: int = segment.TOKEN_CAP) -> Memory:
        """Cut ``turns(unit, turn, role, text, at)`` into episodes, remember each as one record and index its phrases.

        An episode's id follows from its tenant, namespace, unit and first turn, so that writing twice changes nothing.
        """
        cut = segment.episodes(turns, "unit", "turn", at="at", gap_seconds=gap_seconds, token_cap=token_cap)
        line = F.struct("turn", F.concat("role", F.lit(": "), F.coalesce("text", F.lit(""))).alias("line"))
        text = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n")
        made = cut.groupBy("unit", "episode").agg(text.alias("text"), F.min("turn").alias("first"), F.min(F.unix_timestamp("at")).alias("t_valid"))
        doc = F.concat_ws("#", "unit", "first")
        values = {
            "id": uuid5(tenant_namespace(scope.tenant, "palimpsest"), F.concat_ws("/", F.lit(scope.namespace), doc)),
            "tenant": F.lit(scope.tenant),
            "namespace": F.lit(scope.namespace),
            "agent": F.lit(scope.agent),
            "session": F.col("unit").cast("string"),
            "kind": F.lit("episodic"),
            "text": F.col("text"),
            "t_valid": F.col("t_valid"),
            "t_ingested": F.lit(self.now),
            "prov_source": doc,
        }
        incoming = made.select(*[values.get(c, F.lit(None)).cast(t).alias(c) for c, t in self.records.dtypes])
        return self.remember(incoming, source_tier, judge)

    def forget(self, scope: Scope, ids: DataFrame, hard: bool = False, confirm: bool = False) -> Memory:
        """Softly: end the records now. Hard, only if confirmed: erase them and all that derives from them."""
        named = self.records.filter(scope.condition()).select("id").join(ids, "id", "left_semi")
        if not hard:
            ended = self.records.join(named.withColumn("gone", F.lit(True)), "id", "left").withColumn("t_invalid", F.when(F.col("gone"), F.coalesce("t_invalid", F.lit(self.now))).otherwise(F.col("t_invalid")))
            return replace(self, records=ended.select(*self.records.columns), events=self._logged(named, "delete"))
        if not confirm:
            raise ValueError("hard deletion must be confirmed")
        edges = self.links.filter(F.col("relation") == "derived_from").select(F.col("dst").alias("parent"), F.col("src").alias("child"))
        return self._erased(named, edges)

    def forget_scope(self, scope: Scope, keep: DataFrame, confirm: bool = False) -> Memory:
        if not confirm:
            raise ValueError("forgetting a scope must be confirmed")
        edges = self.links.filter(F.col("relation") == "derived_from").select(F.col("dst").alias("parent"), F.col("src").alias("child"))
        return self._erased(self.records.filter(scope.condition()).select("id").join(keep, "id", "left_anti"), edges)

    def _erased(self, seeds: DataFrame, edges: DataFrame) -> Memory:
        tables = {"records": (self.records, ["id"]), "links": (self.links, ["src", "dst"])}
        if self.incidence is not None:
            tables["incidence"] = (self.incidence, ["record_id"])
        gone, left = lineage.hard_delete(seeds, edges, tables)
        return replace(self, records=left["records"], links=left["links"], incidence=left.get("incidence"), events=self._logged(gone, "hard_delete"))

    def _logged(self, ids: DataFrame, kind: str) -> DataFrame:
        """The events and one more for each id, numbered in the order of ids and written down."""
        start = self.events.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        rows = spread_rank(ids.withColumn("_all", F.lit(0)), "_all", [F.col("id")], "nth")
        fresh = cut_lineage(rows.select((F.lit(start) + F.col("nth")).cast("long").alias("seq"), F.lit(self.now).cast("long").alias("at"), F.lit(kind).alias("kind"), F.col("id").alias("record_id")))
        return self.events.unionByName(fresh, allowMissingColumns=True)

    def trajectories(self, needle: str | None = None) -> DataFrame:
        """The list of trajectories, or the lines that hold the needle."""
        return trajectories.listing(self.headers) if needle is None else trajectories.grep(self.states, needle)

    def investigate_all(self, questions: DataFrame, scope: Scope, model: Callable[[DataFrame, str, str], DataFrame], max_steps: int = 3, step_k: int = 6) -> Investigation:
        """``questions(query_id, text)`` in supersteps: each step is one plan for all that are open (see investigate())."""
        live = self.live(scope).select("id", "text")
        return investigate(questions, live, lambda queries: channels.lexical(queries, live, step_k), model, max_steps, step_k)

    def investigate(self, question: str, scope: Scope, reflect: Callable[[str, list], tuple[bool, bool, str | None]], max_steps: int = 2) -> tuple[DataFrame, str]:
        """Probe, let ``reflect(question, ids)`` say (sufficient, conflict, next query), and go on until a rule stops.

        Each probe is one plan; the rules look at a head of at most ``depth`` ids. Returns (pool, reason).
        """
        spark, asked, query, pool, seen = self.records.sparkSession, set(), question, None, set()
        for step in range(1, max_steps + 1):
            asked.add(query.strip().lower())
            hits = self.recall(spark.createDataFrame([(0, query)], "query_id int, text string"), scope)
            rows = hits.select("query_id", "id", F.lit(step).alias("step"), F.col("slot").alias("pos"))
            ids = [r["id"] for r in rows.orderBy("pos").collect()]  # at most k
            fresh = [i for i in ids if i not in seen]
            seen.update(ids)
            pool = rows if pool is None else pool.unionByName(rows)
            reason = "step budget"
            if not fresh and step > 1:
                reason = "no new evidence"
            elif step < max_steps:
                sufficient, conflict, following = reflect(question, sorted(seen))
                if sufficient and not conflict:
                    reason = "sufficient"
                elif not (following or "").strip() or following.strip().lower() in asked:
                    reason = "no new query"
                else:
                    query = following
                    continue
            break
        return pools.probe_union(pool), reason
