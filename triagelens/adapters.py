"""The shared test tables seen as the support-operations tables.

Each function maps one or two of the star-schema / text tables onto a domain
table (columns as in ``schemas``). They are plain projections and key joins so
filters on dates and tenants still reach the Parquet scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .session import spread


TEXT_TABLES = {"documents", "pages", "conversations"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def _tenant(key: str):
    return F.concat(F.lit("t"), (F.col(key) % 5).cast("string"))


def _section(key: str):
    return F.when(F.col(key) % 4 != 0, F.concat(F.lit("s"), (F.col(key) % 4).cast("string")))


def _route(key: str):
    return F.concat(F.lit("route"), (F.col(key) % 5).cast("string"))


def _line_id():
    return F.concat_ws(
        "-",
        F.col("l_orderkey").cast("string"),
        F.col("l_linenumber").cast("string"),
        F.col("l_partkey").cast("string"),
        F.col("l_suppkey").cast("string"),
        F.col("l_shipdate").cast("date").cast("string"),
    )


def _line_decision():
    return (
        F.when(F.col("l_returnflag") == "N", "recommend")
        .when(F.col("l_returnflag") == "A", "abstain")
        .otherwise("escalate")
    )


def evaluation_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """evaluation_daily_dataset: one labelled prediction per order line."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"
    )
    labelled = F.col("o_orderstatus") != "P"
    truth = F.when(labelled, _route("o_custkey"))
    truth_decision = F.when(
        labelled, F.when(F.col("o_orderpriority") == "1-URGENT", "escalate").otherwise("recommend")
    )
    primary = F.col("l_linestatus") == "O"
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("l_shipdate").cast("date").alias("eval_date"),
        _line_id().alias("request_id"),
        _tenant("l_suppkey").alias("tenant_id"),
        _section("l_partkey").alias("section"),
        F.when(primary, "primary").otherwise("challenger").alias("model_variant"),
        _line_decision().alias("predicted_decision"),
        _route("l_partkey").alias("predicted_route"),
        F.round(F.lit(0.05) + F.lit(0.018) * F.col("l_quantity"), 4).alias("predicted_route_prob"),
        (F.abs("l_tax") * 10).alias("escalation_prob"),
        (F.col("l_discount") * 10).alias("final_confidence"),
        truth_decision.alias("ground_truth_decision"),
        truth.alias("ground_truth_route"),
        F.when(truth.isNotNull(), _route("l_partkey") == truth).alias("is_route_correct"),
        (_line_decision() == "escalate").alias("is_escalation_pred"),
        F.coalesce(truth_decision == "escalate", F.lit(False)).alias("is_escalation_actual"),
        (F.col("l_partkey") % 17 + 1).cast("int").alias("issue_token_count"),
        F.when(labelled, (F.col("l_quantity") * 60).cast("int")).alias("resolution_seconds"),
        F.when(primary, "inference_results")
        .when(F.col("l_linenumber") % 2 == 0, "shadow:canary")
        .otherwise("shadow:shadow")
        .alias("source"),
    )


def inference_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("request_id"),
        _tenant("o_custkey").alias("tenant_id"),
        _section("o_custkey").alias("section"),
        F.concat(
            F.lit("  order "), F.col("o_orderkey").cast("string"),
            F.lit(" priority "), F.col("o_orderpriority"),
            F.when(F.col("o_orderstatus") == "P", " still  waiting").otherwise(" "),
        ).alias("issue_text"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "high")
        .when(F.col("o_orderpriority") == "2-HIGH", "medium")
        .otherwise("low").alias("risk_level"),
        F.concat(
            F.lit('{"import_source":"'),
            F.when(F.col("o_custkey") % 3 == 0, "bitext").otherwise("api"),
            F.lit('"}'),
        ).alias("context"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


def inference_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    m = F.col("o_orderkey") % 10
    return o.select(
        F.col("o_orderkey").cast("string").alias("request_id"),
        F.when(m < 6, "recommend").when(m < 8, "abstain").otherwise("escalate").alias("decision"),
        _route("o_custkey").alias("top_resolution_path"),
        ((F.col("o_custkey") % 101) / F.lit(100.0)).alias("top_resolution_prob"),
        ((F.col("o_orderkey") % 100) / F.lit(100.0)).alias("escalation_prob"),
        ((F.col("o_orderkey") % 101) / F.lit(100.0)).alias("final_confidence"),
        F.when(F.col("o_orderkey") % 4 == 0, "challenger").otherwise("primary").alias("model_variant"),
        (F.col("o_orderkey") % 50 == 0).alias("model_backend_fallback"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


def shadow_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        _line_id().alias("shadow_id"),
        F.col("l_orderkey").cast("string").alias("request_id"),
        _tenant("l_suppkey").alias("tenant_id"),
        F.lit("challenger").alias("model_variant"),
        F.when(F.col("l_linenumber") % 2 == 0, "canary").otherwise("shadow").alias("traffic_bucket"),
        F.when(F.col("l_returnflag") == "A", "abstain").alias("decision"),
        _route("l_partkey").alias("top_resolution_path"),
        F.round(F.lit(0.05) + F.lit(0.018) * F.col("l_quantity"), 4).alias("top_resolution_prob"),
        (F.abs("l_tax") * 10).alias("escalation_prob"),
        (F.col("l_discount") * 10).alias("final_confidence"),
        F.lit(False).alias("model_backend_fallback"),
        F.col("l_shipdate").cast("timestamp").alias("created_at"),
    )


def handoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.concat(F.lit("h"), F.col("o_orderkey").cast("string")).alias("handoff_id"),
        F.col("o_orderkey").cast("string").alias("request_id"),
        _tenant("o_custkey").alias("tenant_id"),
        F.when(F.col("o_orderstatus") == "P", "open")
        .when(F.col("o_orderstatus") == "O", "in_review")
        .otherwise("closed").alias("queue_status"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


def _line_labels(spark: SparkSession, sf_dir: str, flag: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == flag)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return li.join(o, li.l_orderkey == o.o_orderkey)


def reviewer_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_labels(spark, sf_dir, "R").select(
        _line_id().alias("outcome_id"),
        F.concat(F.lit("h"), F.col("l_orderkey").cast("string")).alias("handoff_id"),
        F.col("l_orderkey").cast("string").alias("request_id"),
        _tenant("o_custkey").alias("tenant_id"),
        F.concat(F.lit("rev"), F.col("o_custkey").cast("string")).alias("reviewer_id"),
        F.when(F.col("l_linenumber") % 3 == 0, "escalate").otherwise("recommend").alias("final_decision"),
        _route("l_suppkey").alias("final_resolution_path"),
        (F.col("l_quantity") * 60).cast("int").alias("resolution_seconds"),
        F.col("l_shipdate").cast("timestamp").alias("created_at"),
    )


def feedback_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_labels(spark, sf_dir, "A").select(
        _line_id().alias("event_id"),
        F.col("l_orderkey").cast("string").alias("request_id"),
        _tenant("o_custkey").alias("tenant_id"),
        F.when(F.col("l_linenumber") % 4 == 0, "escalate")
        .when(F.col("l_linenumber") % 4 == 1, "abstain")
        .otherwise("recommend").alias("accepted_decision"),
        F.when(F.col("l_partkey") % 6 != 0, _route("l_partkey")).alias("corrected_resolution_path"),
        F.col("l_shipdate").cast("timestamp").alias("created_at"),
    )


def workload_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ops_workload_daily: tickets and agents per order date and region."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy(F.col("o_orderdate").cast("date").alias("metric_date"), F.col("r_name").alias("tenant_id"))
        .agg(
            F.count(F.lit(1)).alias("eligible_tickets_total"),
            F.countDistinct("o_custkey").alias("active_agents_total"),
        )
        .withColumn("section", F.lit("__all__"))
        .withColumn("source", F.lit("ops_export"))
    )


def service_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request / decision telemetry from the event table."""
    return service_events_from(table(spark, sf_dir, "events"))


def service_events_from(events: DataFrame) -> DataFrame:
    et = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("int")
    answered = ~et.isin("click", "view")
    return events.select(
        F.col("event_id").cast("string").alias("request_id"),
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("user_id") % 10 == 0, "decision-model-serving").otherwise("decision-api").alias("service"),
        _tenant("user_id").alias("tenant_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id"),
        F.when(et == "click", "retrieval").when(et == "view", "routing").otherwise("generation").alias("stage"),
        F.when(et == "error", 500).otherwise(200).cast("int").alias("status"),
        F.when(et == "signup", "abstain").when(et == "purchase", "escalate").otherwise("recommend").alias("decision"),
        (F.col("value") / 100).alias("duration_seconds"),
        F.least(F.lit(1.0), F.col("value") / 500).alias("confidence"),
        (k + 1).alias("token_count"),
        (k % 10 == 0).alias("injection_blocked"),
        (k % 7 == 0).alias("guardrail"),
        F.when(answered, (k % 11) / 10).alias("faithfulness"),
        F.when(answered, (k % 7) / 10).alias("hallucination"),
        F.when(answered, (k % 5) / 4).alias("citation_coverage"),
        F.when(et == "click", (k % 9) / 8).alias("evidence_score"),
        F.when(et != "error", (k + 1) * 0.000002).alias("cost_dollars"),
        (k % 3 == 0).cast("int").alias("breaker_state"),
    )


def doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("chunk_id"),
        F.col("source").alias("tenant_id"),
        F.col("lang").alias("section"),
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"),
        F.when(F.col("doc_id") % 3 == 0, "runbook").otherwise("external").alias("source"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 400).cast("int")).alias("updated_at"),
        F.col("text").alias("text_content"),
    )


def passage_requests(spark: SparkSession, sf_dir: str, tenants: int = 20) -> DataFrame:
    """Every benchmark passage asked once in each tenant (a narrow explode)."""
    b = table(spark, sf_dir, "benchmark")
    t = F.explode(F.sequence(F.lit(0), F.lit(tenants - 1))).alias("t")
    return b.select("item_id", "text", t).select(
        F.concat_ws("-", F.lit("q"), F.col("item_id").cast("string"), F.col("t").cast("string")).alias("request_id"),
        F.concat(F.lit("src"), F.col("t").cast("string")).alias("tenant_id"),
        F.when(F.col("t") % 2 == 0, "en").alias("section"),
        F.col("text").alias("issue_text"),
        F.when(F.col("item_id") % 4 == 0, "high").otherwise("low").alias("risk_level"),
    )


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


# -- operations logs --------------------------------------------------------

CONTROL_TYPES = [
    "incident_endpoint_verification", "oncall_schedule_audit", "secret_rotation", "access_review", "incident_drill",
    "rollback_drill", "load_test", "soak_test", "failure_test",
]
WATCHED_ALERTS = ["DecisionApiHighErrorRate", "DecisionApiHighLatencyP95", "ModelServingHighErrorRate"]


def _pick(names: list, key) -> "F.Column":
    return F.get(F.array(*[F.lit(n) for n in names]), (key % len(names)).cast("int"))


def rollout_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("event_id"),
        F.col("o_orderdate").cast("date").alias("eval_date"),
        F.when(F.col("o_orderstatus") == "P", "promote").when(F.col("o_orderstatus") == "F", "rollback")
        .otherwise("hold").alias("action"),
        (F.col("o_custkey") % 2 == 0).alias("apply_change"),
        _pick([5, 25, 50, 100], F.col("o_orderkey")).alias("target_percent"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


def calibration_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("run_id"),
        _pick(["routing_temperature", "escalation_platt"], F.col("o_orderkey")).alias("run_scope"),
        F.when(F.col("o_custkey") % 5 == 0, "challenger").otherwise("primary").alias("model_variant"),
        F.col("o_custkey").alias("sample_size"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


def control_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("event_id"),
        _pick(CONTROL_TYPES, F.col("o_custkey")).alias("control_type"),
        F.when(F.col("o_orderstatus") == "F", "fail").otherwise("pass").alias("status"),
        F.lit("global").alias("control_scope"),
        F.col("o_orderdate").cast("timestamp").alias("performed_at"),
        F.concat(F.lit("cust"), F.col("o_custkey").cast("string")).alias("performed_by"),
        F.concat(F.lit("evidence/"), F.col("o_orderkey").cast("string")).alias("evidence_uri"),
        F.when(F.col("o_orderkey") % 2 == 0, '{"mode":" Live "}').otherwise('{"mode":"dry_run"}').alias("details"),
    )


def alert_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        _pick(WATCHED_ALERTS, F.col("o_custkey")).alias("alert_name"),
        F.col("o_orderdate").cast("date").alias("day"),
        (F.col("o_totalprice") > 499000).alias("firing"),
    )


PHRASES = [
    "I was charged twice and want a refund, please help.", "My password reset failed and the account is locked.",
    "Where is my order? The shipping delay is unacceptable.", "The app shows an error and will crash, urgent bug.",
    "There was fraud on my account, this is a legal threat.", "How to update profile information?", "",
]


def support_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with a support phrase in front, as requests of 20 tenants."""
    t = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    k = F.col("conv_id") + F.col("turn")
    return t.select(
        F.concat_ws("-", F.lit("c"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("request_id"),
        F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")).alias("tenant_id"),
        F.when(F.col("conv_id") % 2 == 0, _pick(["en", "fr", "xx"], F.col("conv_id"))).alias("section"),
        F.concat_ws(" ", F.nullif(_pick(PHRASES, k), F.lit("")), F.col("text")).alias("issue_text"),
        _pick(["low", "medium", "high"], F.col("conv_id")).alias("risk_level"),
    )


def simple_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence arrays from a conversation's own first five assistant turns."""
    t = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    a = t.filter(F.col("role") == "assistant").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= 5)
    item = F.struct(
        "rank", F.concat_ws("_", F.lit("doc"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("chunk_id"),
        F.concat(F.lit("d"), F.col("conv_id").cast("string")).alias("doc_id"),
        F.round(F.lit(0.95) / F.col("rank"), 4).alias("score"),
        F.when(F.col("turn") % 4 == 1, "internal_wiki").otherwise("runbook").alias("source"),
        F.lit("en").alias("section"),
        F.concat(F.col("text"), F.when(F.col("conv_id") % 3 == 0, " No refund, working as expected.").otherwise("")).alias("text"))
    per = a.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("evidence"))
    users = t.filter(F.col("role") == "user").select("conv_id", "turn")
    return users.join(per, "conv_id").select(
        F.concat_ws("-", F.lit("c"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("request_id"), "evidence")
