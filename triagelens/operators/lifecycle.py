"""Retention, erasure, hand-off outcomes, imports and the model registry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage
from ..sources.tables import canonical_uuid

# Seeded retention policies.
RETENTION = [
    ("inference_requests", 365, "anonymize"), ("inference_results", 365, "anonymize"), ("handoffs", 180, "soft_delete"),
    ("feedback_events", 365, "soft_delete"), ("pii_audit_events", 90, "hard_delete"), ("model_shadow_predictions", 180, "hard_delete"),
]
ANONYMIZED_COLUMNS = ["issue_text", "context", "response_payload", "policy_result", "notes"]
CONTROL_STATUSES = ["pass", "fail", "waived"]
IMPORT_NAMESPACE = "a3b2c1d0-e5f6-7890-abcd-ef1234567890"


def retention_apply(tables: dict[str, DataFrame], as_of: str, policies: list[tuple[str, int, str]] | None = None) -> dict[str, DataFrame]:
    """Tables after retention: old rows removed, marked deleted or blanked."""
    now = F.lit(as_of).cast("timestamp")
    out = dict(tables)
    for name, days, action in policies or RETENTION:
        df = tables.get(name)
        if df is None:
            continue
        old = F.col("created_at") < F.date_sub(F.lit(as_of).cast("date"), days).cast("timestamp")
        if action == "hard_delete":
            out[name] = df.filter(~old)
        elif action == "soft_delete":
            gone = F.col("deleted_at") if "deleted_at" in df.columns else F.lit(None).cast("timestamp")
            out[name] = df.withColumn("deleted_at", F.when(old, F.coalesce(gone, now)).otherwise(gone))
        else:
            out[name] = df.withColumns({c: F.when(~old, F.col(c)) for c in ANONYMIZED_COLUMNS if c in df.columns})
    return out


def retention_report(tables: dict[str, DataFrame], as_of: str, policies: list[tuple[str, int, str]] | None = None) -> DataFrame:
    """Rows each policy affects."""
    parts = []
    for name, days, action in policies or RETENTION:
        if name in tables:
            limit = F.date_sub(F.lit(as_of).cast("date"), days).cast("timestamp")
            parts.append(tables[name].agg(F.count_if(F.col("created_at") < limit).alias("records_affected")).select(
                F.lit(name).alias("table_name"), F.lit(action).alias("action"), "records_affected"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def erase_tenant(tables: dict[str, DataFrame], tenant_id: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables without the tenant, lifecycle audit rows with counts per table)."""
    kept = {n: df.filter(~F.col("tenant_id").eqNullSafe(F.lit(tenant_id))) for n, df in tables.items()}
    parts = [df.agg(F.count_if(F.col("tenant_id") == tenant_id).alias("records_affected")).select(
        F.lit("erasure_completed").alias("event_type"), F.lit(tenant_id).alias("tenant_id"), F.lit(n).alias("table_name"), "records_affected")
        for n, df in tables.items()]
    return kept, reduce(lambda a, b: a.unionByName(b), parts)


def capture_outcome(handoffs: DataFrame, changes: DataFrame) -> dict[str, DataFrame]:
    """Apply status changes to hand-offs.

    ``changes`` has handoff_id, tenant_id, queue_status, reviewer_id,
    final_decision, final_resolution_path, changed_at, change_id. Closing
    without reviewer, decision and path is rejected; resolving or closing with
    them also records an outcome.
    """
    def given(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("")) != ""

    complete = given("reviewer_id") & given("final_decision") & given("final_resolution_path")
    bad = (F.col("queue_status") == "closed") & ~complete
    known = changes.filter(~bad).join(
        handoffs.select("handoff_id", "tenant_id", "request_id", F.col("created_at").alias("opened_at")), ["handoff_id", "tenant_id"])
    latest = known.groupBy("handoff_id", "tenant_id").agg(
        F.max_by("queue_status", F.struct("changed_at", "change_id")).alias("new_status"))
    updated = handoffs.join(latest, ["handoff_id", "tenant_id"], "left").withColumn(
        "queue_status", F.coalesce("new_status", "queue_status")).drop("new_status").select(*handoffs.columns)
    seconds = F.greatest(F.lit(0), F.unix_timestamp("changed_at") - F.unix_timestamp("opened_at")).cast("int")
    outcomes = known.filter(F.col("queue_status").isin("resolved", "closed") & complete).select(
        F.col("change_id").alias("outcome_id"), "handoff_id", "request_id", "tenant_id", "reviewer_id", "final_decision",
        "final_resolution_path", seconds.alias("resolution_seconds"), F.col("changed_at").alias("created_at"))
    feedback = outcomes.select(
        F.col("outcome_id").alias("event_id"), "request_id", "tenant_id", F.col("final_decision").alias("accepted_decision"),
        F.col("final_resolution_path").alias("corrected_resolution_path"), "created_at")
    return {"handoffs": updated, "outcomes": outcomes, "feedback": feedback, "rejected": changes.filter(bad)}


def handoff_queue(handoffs: DataFrame, tenant_id: str, status: str | None = None, limit: int = 50) -> DataFrame:
    """Newest hand-offs of a tenant, 1 to 200 rows."""
    q = handoffs.filter(F.col("tenant_id") == tenant_id)
    if status:
        q = q.filter(F.col("queue_status") == status)
    return q.orderBy(F.desc("created_at"), "handoff_id").limit(max(1, min(200, int(limit))))


def validated_controls(events: DataFrame, control_types: list[str]) -> tuple[DataFrame, DataFrame]:
    """(normalized control events, rejected ones with a reason)."""
    e = events.withColumns({
        "control_type": F.lower(F.trim("control_type")), "status": F.lower(F.trim("status")),
        "control_scope": F.coalesce(F.nullif(F.trim("control_scope"), F.lit("")), F.lit("global")),
        "performed_by": F.trim("performed_by"), "evidence_uri": F.trim("evidence_uri")})
    reason = (
        F.when(~F.coalesce(F.col("control_type").isin(control_types), F.lit(False)), "unsupported_control_type")
        .when(~F.coalesce(F.col("status").isin(CONTROL_STATUSES), F.lit(False)), "unsupported_status")
        .when(F.coalesce("performed_by", F.lit("")) == "", "performed_by_required")
        .when(F.coalesce("evidence_uri", F.lit("")) == "", "evidence_uri_required"))
    e = e.withColumn("reject_reason", reason)
    return e.filter(F.col("reject_reason").isNull()).drop("reject_reason"), e.filter(F.col("reject_reason").isNotNull())


def import_cleanup(tables: dict[str, DataFrame], source: str = "bitext") -> dict[str, DataFrame]:
    """Tables without the rows of one import source."""
    imported = tables["requests"].filter(F.get_json_object("context", "$.import_source") == source).select("request_id")
    out = {n: tables[n].join(imported, "request_id", "left_anti") for n in ("requests", "results", "handoffs") if n in tables}
    if "dataset" in tables:
        out["dataset"] = tables["dataset"].filter(F.col("source") != source)
    return out


def import_intents(pairs: DataFrame, as_of: str, tenant_id: str = "org_demo") -> dict[str, DataFrame]:
    """Labelled pairs as requests, unseen intents and an audit row."""
    from ..functions import scoring as S
    from ..functions.text import category_section, clean

    p = pairs.withColumns({c: clean(F.col(c)) for c in ("instruction", "intent", "category")})
    usable = (F.col("instruction") != "") & (F.col("intent") != "")
    rows = p.filter(usable).groupBy("instruction").agg(F.min_by(F.struct("intent", "category"), F.struct("intent", "category")).alias("r")).select("instruction", "r.*")
    requests = rows.select(
        uuid5(F.col("instruction"), IMPORT_NAMESPACE).alias("request_id"), F.lit(tenant_id).alias("tenant_id"),
        category_section(F.col("category")).alias("section"), F.col("instruction").alias("issue_text"),
        S.intent_risk(F.col("intent")).alias("risk_level"), S.legacy_route(F.col("intent")).alias("route"),
        F.to_json(F.struct(F.lit("bitext").alias("import_source"), "intent", "category")).alias("context"),
        F.lit(as_of).cast("timestamp").alias("created_at"))
    stats = p.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~usable).alias("skipped"), F.countDistinct(F.when(usable, F.col("intent"))).alias("intents"))
    return {"requests": requests, "stats": stats, "intents": rows.select("intent").distinct()}


def uuid5(name: Column, namespace: str) -> Column:
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)),
                       F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def canonical_requests(df: DataFrame, column: str = "request_id", scope: str = "request") -> DataFrame:
    return df.withColumn("canonical_request_id", canonical_uuid(F.col(column), scope))


# -- model registry ---------------------------------------------------------


def stage_lineage(transitions: DataFrame) -> DataFrame:
    """Stage history with the archiving of superseded production models.

    ``transitions`` has event_id, artifact_id, artifact_type, to_stage, ts,
    gate_passed. When a model enters production, the model that entered before
    it in the same type is archived at that moment.
    """
    from pyspark.sql import Window

    by_type = Window.partitionBy("artifact_type").orderBy("ts", "event_id")
    prod = transitions.filter(F.col("to_stage") == "production").withColumn("previous", F.lag("artifact_id").over(by_type))
    archived = prod.filter(F.col("previous").isNotNull() & (F.col("previous") != F.col("artifact_id"))).select(
        F.col("event_id"), F.lit(1).alias("seq"), F.col("previous").alias("artifact_id"), "artifact_type",
        F.lit("archived").alias("to_stage"), "ts", F.lit(True).alias("gate_passed"), F.lit("superseded").alias("reason"))
    own = transitions.select("event_id", F.lit(0).alias("seq"), "artifact_id", "artifact_type", "to_stage", "ts", "gate_passed", F.lit("").alias("reason"))
    w = Window.partitionBy("artifact_id").orderBy("ts", "event_id", "seq")
    return own.unionByName(archived).withColumn("from_stage", F.lag("to_stage").over(w))


def current_stage(lineage: DataFrame) -> DataFrame:
    return lineage.groupBy("artifact_id", "artifact_type").agg(
        F.max_by("to_stage", F.struct("ts", "event_id", "seq")).alias("stage"), F.count(F.lit(1)).alias("transitions"))


def registry_compliance(artifacts: DataFrame, lineage: DataFrame) -> DataFrame:
    """Counts per stage, missing provenance and failed gates, one row each."""
    live = artifacts.join(current_stage(lineage).select("artifact_id", "stage"), "artifact_id", "left")
    per_stage = live.groupBy("stage").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("stage:"), F.col("stage")).alias("item"), "n")
    gaps = live.agg(
        F.count(F.lit(1)).alias("total_artifacts"), F.count_if(F.col("training_dataset") == "").alias("artifacts_without_training_data"),
        F.count_if(F.col("checksum") == "").alias("artifacts_without_checksum"),
        F.count_if((F.col("training_dataset") == "") & F.col("stage").isin("production", "canary")).alias("live_without_training_data"))
    failed = lineage.agg(F.count_if(~F.col("gate_passed")).alias("failed_quality_gates"), F.count(F.lit(1)).alias("total_lineage_events"))

    def long(df: DataFrame) -> DataFrame:
        return df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).alias("n")) for c in df.columns])))

    return per_stage.unionByName(long(gaps)).unionByName(long(failed))


def lineage_chain(artifacts: DataFrame, artifact_ids: DataFrame) -> DataFrame:
    """Parent chain (root, artifact_id, depth) of each requested artifact, of any length.

    Pointers double: after k rounds all ancestors less than 2 ** k steps away are known. A cycle
    gives each of its members once, at its least depth, and ends the rounds.
    """
    known = artifacts.select("artifact_id", "parent_id").distinct()
    jump = known.join(known.select(F.col("artifact_id").alias("parent_id")), "parent_id").select(F.col("artifact_id").alias("a"), F.col("parent_id").alias("b"))
    roots = artifact_ids.select("artifact_id").join(known, "artifact_id", "left_semi").distinct()
    chain = stage(roots.select(F.col("artifact_id").alias("root"), "artifact_id", F.lit(0).cast("long").alias("depth")), "chain")
    jump, size, reach = stage(jump, "jump"), chain.count(), 1
    while True:
        further = chain.join(jump, chain["artifact_id"] == jump["a"]).select("root", F.col("b").alias("artifact_id"), (F.col("depth") + reach).alias("depth"))
        chain = stage(chain.unionByName(further).groupBy("root", "artifact_id").agg(F.min("depth").alias("depth")), "chain")
        before, size = size, chain.count()
        if size == before:
            return chain
        onward = jump.select(F.col("a").alias("b"), F.col("b").alias("c"))
        jump, reach = stage(jump.join(onward, "b").select("a", F.col("c").alias("b")), "jump"), 2 * reach


def list_artifacts(artifacts: DataFrame, artifact_type: str | None = None, stage: str | None = None) -> DataFrame:
    out = artifacts
    if artifact_type:
        out = out.filter(F.col("artifact_type") == artifact_type)
    if stage:
        out = out.filter(F.col("stage") == stage)
    return out.orderBy(F.desc("created_at"), "artifact_id")
