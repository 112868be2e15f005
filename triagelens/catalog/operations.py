"""Source, sink, lifecycle, registry and monitoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from .. import schemas as SC
from .. import vocab as V
from ..operators import corpus as K
from ..operators import evaluation as E
from ..operators import lifecycle as L
from ..operators import monitoring as M
from ..session import stage, work_path
from ..sources import feeds as FD
from ..sources import tables as T
from ..streaming import audit as AU
from . import texts as TX
from .ctes import with_ctes
from .evaluation import LOCAL as EV
from .evaluation import ece_sql
from .shape import shaped

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
LOCAL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: shaped(fn(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_ctes(sql, {**EV, **TX.LOCAL, **LOCAL})
        return fn

    return wrap


# -- sources and sinks: written by Spark from the tables, read back ----------


@register("src_tables", """SELECT 'inference_requests' AS table_name, count(*) AS n, count(section) AS with_section FROM inf_requests
UNION ALL SELECT 'handoffs', count(*), NULL FROM handoffs UNION ALL SELECT 'reviewer_outcomes', count(*), NULL FROM outcomes""")
def _q(spark, d):
    root = work_path(spark, "tables")
    frames = {"inference_requests": A.inference_requests(spark, d), "handoffs": A.handoffs(spark, d), "reviewer_outcomes": A.reviewer_outcomes(spark, d)}
    out = []
    for name, df in frames.items():
        SC.conform(df, name).write.parquet(f"{root}/{name}")
        t = T.read_table(spark, root, name)
        seen = F.count("section") if name == "inference_requests" else F.lit(None).cast("bigint")
        out.append(t.agg(F.count(F.lit(1)).alias("n"), seen.alias("with_section")).select(F.lit(name).alias("table_name"), "n", "with_section"))
    return T.union_all(out)


@register("src_conversations_json", """SELECT role, count(*) AS turns, sum(length(text))::BIGINT AS chars FROM conv_turns GROUP BY 1""")
def _q(spark, d):
    path = work_path(spark, "dialogues")
    item = F.struct("turn", F.struct(F.col("role").alias("speaker"), F.col("text").alias("utterance")).alias("t"))
    dialogs = A.conversation_turns(spark, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("ts"))
    dialogs.select(F.to_json(F.struct(F.struct(F.transform("ts", lambda x: x["t"]).alias("turns")).alias("x"), F.array(
        F.struct(F.transform("ts", lambda x: x["t"]).alias("messages"))).alias("dialogue"))).alias("value")).write.text(path)
    t = FD.conversations(spark, path)
    return t.groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.length("text")).alias("chars"))


@register("src_twitter_csv", "SELECT tweet_id, parent_id, customer_text, agent_text FROM replies")
def _q(spark, d):
    path = work_path(spark, "posts")
    TX.posts(spark, d).write.option("header", True).option("escape", '"').csv(path)
    return K.reply_pairs(FD.posts_csv(spark, path)).select("tweet_id", "parent_id", "customer_text", "agent_text")


def _labelled(spark, d):
    k = F.col("conv_id") + F.col("turn")
    return TX.pairs(spark, d).select(
        A._pick(["B", "BW", "P", "QZ"], k).alias("flags"), F.when(k % 9 == 0, " ").otherwise(F.col("customer_text")).alias("instruction"),
        A._pick(["ACCOUNT", "ORDER", "NONE"], k).alias("category"), A._pick(["get_refund", "complaint", "", "odd_intent"], k).alias("intent"),
        F.col("agent_text").alias("response"))


LOCAL["lab_pairs"] = """SELECT (['B', 'BW', 'P', 'QZ'])[(conv_id + turn) % 4 + 1] AS flags, CASE WHEN (conv_id + turn) % 9 = 0 THEN '' ELSE customer_text END AS instruction,
 (['ACCOUNT', 'ORDER', 'NONE'])[(conv_id + turn) % 3 + 1] AS category, (['get_refund', 'complaint', '', 'odd_intent'])[(conv_id + turn) % 4 + 1] AS intent,
 agent_text AS response FROM chat_pairs"""


@register("src_bitext_csv", """SELECT category, intent, count(*) AS n FROM lab_pairs WHERE instruction <> '' GROUP BY ALL""")
def _q(spark, d):
    path = work_path(spark, "labelled")
    _labelled(spark, d).write.option("header", True).option("escape", '"').csv(path)
    return FD.labelled_csv(spark, path).groupBy("category", F.coalesce("intent", F.lit("")).alias("intent")).agg(F.count(F.lit(1)).alias("n"))


@register("src_intent_jsonl", """SELECT intent, count(*) AS n FROM lab_pairs WHERE instruction <> '' AND intent <> '' GROUP BY 1""")
def _q(spark, d):
    path = work_path(spark, "intents")
    _, intents = K.labelled_pairs(_labelled(spark, d))
    intents.write.json(path)
    return FD.intent_jsonl(spark, path).groupBy("intent").agg(F.count(F.lit(1)).alias("n"))


@register("src_workload_csv", """SELECT CAST(metric_date AS VARCHAR) AS metric_date, tenant_id, CASE WHEN eligible_tickets_total % 2 = 0 THEN '__all__' ELSE 's1' END AS section,
 eligible_tickets_total, active_agents_total, CASE WHEN active_agents_total % 2 = 0 THEN 'manual' ELSE 'ops' END AS source FROM workload
WHERE eligible_tickets_total % 5 <> 0""")
def _q(spark, d):
    path = work_path(spark, "workload")
    n, a = F.col("eligible_tickets_total"), F.col("active_agents_total")
    A.workload_daily(spark, d).select(
        "metric_date", "tenant_id", F.when(n % 2 == 0, " ").otherwise("s1").alias("section"), F.when(n % 5 == 0, -n).otherwise(n).alias("eligible_tickets_total"),
        a, F.when(a % 2 == 0, "").otherwise("ops").alias("source")).write.option("header", True).csv(path)
    return FD.workload_csv(spark, path)[0]


@register("src_seed_chunks_jsonl", """SELECT tenant_id, CASE WHEN doc_id % 3 = 0 THEN 'general' ELSE lang END AS section, count(*) AS n FROM (
 SELECT doc_id, source AS tenant_id, lang, text FROM documents) WHERE doc_id % 7 <> 0 AND trim(text, E' \\t\\n\\r') <> '' GROUP BY ALL""")
def _q(spark, d):
    path = work_path(spark, "seed")
    doc = F.col("doc_id")
    A.table(spark, d, "documents").select(
        F.col("source").alias("tenant_id"), F.when(doc % 3 != 0, F.col("lang")).alias("section"), F.when(doc % 7 != 0, doc.cast("string")).alias("chunk_id"),
        F.lit("2024-05-01").alias("updated_at"), "text").write.json(path)
    good, _ = FD.seed_chunks_jsonl(spark, path)
    return good.groupBy("tenant_id", "section").agg(F.count(F.lit(1)).alias("n"))


@register("src_knowledge_json", "SELECT source AS tenant_id, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents WHERE doc_id % 4 <> 0 GROUP BY 1")
def _q(spark, d):
    path = work_path(spark, "knowledge")
    doc = F.col("doc_id")
    A.table(spark, d, "documents").select(
        F.col("source").alias("tenant_id"), F.when(doc % 4 != 0, F.col("lang")).alias("section"), doc.cast("string").alias("chunk_id"),
        doc.cast("string").alias("doc_id"), "text").write.json(path)
    return FD.knowledge_json(spark, path, array=False).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@register("src_style_jsonl", "SELECT conv_id % 2 = 0 AS toned, count(*) AS n FROM chat_pairs GROUP BY 1")
def _q(spark, d):
    path = work_path(spark, "style")
    TX.pairs(spark, d).select(F.when(F.col("conv_id") % 2 == 0, "Formal").alias("tone"), "customer_text", "agent_text").write.json(path)
    return FD.style_jsonl(spark, path).groupBy((F.col("tone") == "formal").alias("toned")).agg(F.count(F.lit(1)).alias("n"))


@register("src_model_artifact", "SELECT p_type AS label, count(*) AS tokens, round(sum(w), 6) AS weight FROM (SELECT p_name, p_type, avg(p_retailprice) AS w FROM part GROUP BY 1, 2) GROUP BY 1")
def _q(spark, d):
    path = work_path(spark, "model")
    w = A.table(spark, d, "part").groupBy("p_name", "p_type").agg(F.avg("p_retailprice").alias("w"))
    per = w.groupBy("p_name").agg(F.map_from_entries(F.collect_list(F.struct("p_type", "w"))).alias("m"))
    model = per.agg(F.map_from_entries(F.collect_list(F.struct("p_name", "m"))).alias("token_weights"))
    model.withColumn("bias", F.create_map(F.lit("x"), F.lit(0.5))).coalesce(1).write.json(path)
    return FD.model_artifact(spark, path)["weights"].groupBy("label").agg(F.count(F.lit(1)).alias("tokens"), F.sum("weight").alias("weight"))


@register("src_alert_events", "SELECT event_type AS route, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT '__total__', count(*) FROM events")
def alert_counts(spark, d):
    path = work_path(spark, "alerts")
    e = A.table(spark, d, "events")
    good = e.select(F.to_json(F.struct(F.col("ts").cast("string").alias("ts_utc"), F.col("event_type").alias("route"), F.col("props").alias("payload"))).alias("value"))
    good.unionByName(e.filter("event_type = 'error'").select(F.lit('{"route": "brok').alias("value"))).write.text(path)
    return FD.alert_route_counts(FD.alert_events(spark, path))


QUERIES["alert_route_counts"], ORACLES["alert_route_counts"] = QUERIES["src_alert_events"], ORACLES["src_alert_events"]


@register("sink_jsonl_capped", "SELECT conv_id, turn, tone FROM (SELECT conv_id, turn, " + TX.tone_sql("an") + " AS tone FROM chat_norm)")
def _q(spark, d):
    path = work_path(spark, "capped")
    FD.sink_jsonl(TX.pairs(spark, d), path, ["conv_id", "turn"], ["conv_id", "turn", "tone"])
    return spark.read.schema("conv_id bigint, turn bigint, tone string").json(path)


@register("sink_report", "SELECT tenant_id, count(*) AS n FROM inf_requests GROUP BY 1")
def _q(spark, d):
    path = work_path(spark, "report")
    FD.sink_report(A.inference_requests(spark, d).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n")), path, "Requests")
    return spark.read.schema("tenant_id string, n bigint").json(path)


@register("replace_partition", """SELECT CAST(eval_date AS VARCHAR) AS eval_date, count(*) AS n, count(*) FILTER (model_variant = 'primary') AS n_primary FROM eval_ds
WHERE (eval_date = DATE '1998-06-14') OR (eval_date = DATE '1998-06-15' AND model_variant = 'primary') GROUP BY 1""")
def _q(spark, d):
    path = work_path(spark, "replaced")
    ds = A.evaluation_dataset(spark, d).filter(F.col("eval_date").isin("1998-06-14", "1998-06-15"))
    T.replace_partition(ds, path, ["eval_date"])
    T.replace_partition(ds.filter((F.col("eval_date") == "1998-06-15") & (F.col("model_variant") == "primary")), path, ["eval_date"])
    return spark.read.parquet(path).groupBy("eval_date").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("model_variant") == "primary").alias("n_primary"))


# -- upserts ----------------------------------------------------------------


@register("upsert_latest", """SELECT CAST(metric_date AS VARCHAR) AS metric_date, tenant_id, CASE WHEN n2 IS NULL THEN n1 ELSE n2 END AS eligible_tickets_total,
 coalesce(CASE WHEN n1 IS NULL THEN NULL ELSE 'ops_export' END, 'late') AS first_source FROM (
 SELECT coalesce(a.metric_date, b.metric_date) AS metric_date, coalesce(a.tenant_id, b.tenant_id) AS tenant_id, a.eligible_tickets_total AS n1, b.n2
 FROM (SELECT * FROM workload WHERE metric_date < DATE '1999-01-01') a FULL OUTER JOIN (SELECT metric_date, tenant_id, eligible_tickets_total + 1000 AS n2 FROM workload
  WHERE metric_date >= DATE '1998-06-01') b ON a.metric_date = b.metric_date AND a.tenant_id = b.tenant_id)""")
def _q(spark, d):
    w = A.workload_daily(spark, d).select("metric_date", "tenant_id", "eligible_tickets_total", F.col("source").alias("first_source"))
    late = w.filter("metric_date >= DATE'1998-06-01'")
    incoming = late.withColumn("seq", F.lit(1)).unionByName(
        late.withColumn("eligible_tickets_total", F.col("eligible_tickets_total") + 1000).withColumn("seq", F.lit(2))).withColumn("first_source", F.lit("late"))
    return T.upsert_latest(w.filter("metric_date < DATE'1999-01-01'"), incoming, ["metric_date", "tenant_id"], "seq", keep=["first_source"])


@register("insert_if_absent", """SELECT 'region_' || lower(r_name) AS tenant_id, 'Region ' || array_to_string(list_transform(string_split(lower(r_name), ' '),
 lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') AS name, 'active' AS status FROM region WHERE r_regionkey <> 0""")
def _q(spark, d):
    r = A.table(spark, d, "region")
    ids = F.concat(F.lit("region_"), F.lower("r_name")).alias("tenant_id")
    return T.new_tenants(r.filter("r_regionkey = 0").select(ids), r.select(ids))


@register("taxonomy_additions", """SELECT DISTINCT lower(p_type) AS intent_id FROM part WHERE lower(p_type) NOT IN (SELECT lower(p_type) FROM part WHERE p_partkey = 0)""")
def _q(spark, d):
    p = A.table(spark, d, "part").select(F.lower("p_type").alias("intent_id"), "p_partkey")
    return T.insert_if_absent(p.filter("p_partkey = 0"), p.select("intent_id"), ["intent_id"])


@register("tenant_scope", "SELECT tenant_id, count(*) AS n FROM inf_requests WHERE tenant_id IN ('t1', 't3') GROUP BY 1")
def _q(spark, d):
    return T.tenant_scope(A.inference_requests(spark, d), ["t1", "t3"]).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"))


@register("check_constraints", """SELECT 'decision' AS rule, count(*) FILTER (decision NOT IN ('recommend', 'abstain', 'escalate')) AS violations, count(*) AS rows FROM inf_results
UNION ALL SELECT 'confidence', count(*) FILTER (final_confidence > 0.9), count(*) FROM inf_results""")
def _q(spark, d):
    rules = SC.CHECKS["inference_results"] + [("confidence", "final_confidence <= 0.9")]
    return SC.check_constraints(A.inference_results(spark, d), rules)


@register("json_extract", "SELECT json_extract_string(context, '$.import_source') AS import_source, count(*) AS n FROM inf_requests GROUP BY 1")
def _q(spark, d):
    return A.inference_requests(spark, d).groupBy(F.get_json_object("context", "$.import_source").alias("import_source")).agg(F.count(F.lit(1)).alias("n"))


@register("success_status", "SELECT tenant_id, count(*) FILTER (status BETWEEN 200 AND 299) AS ok, count(*) AS n FROM svc GROUP BY 1")
def _q(spark, d):
    return A.service_events(spark, d).groupBy("tenant_id").agg(F.count_if(M.success_status(F.col("status"))).alias("ok"), F.count(F.lit(1)).alias("n"))


@register("canonical_uuid")
def _q(spark, d):
    r = A.inference_requests(spark, d).select("request_id")
    return L.canonical_requests(r)


# -- lifecycle --------------------------------------------------------------

_RET = "2000-01-01"


def _life(spark, d):
    return {"inference_requests": A.inference_requests(spark, d), "handoffs": A.handoffs(spark, d),
            "feedback_events": A.feedback_events(spark, d), "model_shadow_predictions": A.shadow_predictions(spark, d)}


@register("retention_apply", f"""SELECT 'inference_requests' AS table_name, count(*) AS n, count(issue_text) FILTER (created_at >= DATE '{_RET}' - 365) AS live FROM inf_requests
UNION ALL SELECT 'handoffs', count(*), count(*) FILTER (created_at >= DATE '{_RET}' - 180) FROM handoffs
UNION ALL SELECT 'feedback_events', count(*), count(*) FILTER (created_at >= DATE '{_RET}' - 365) FROM feedback
UNION ALL SELECT 'model_shadow_predictions', count(*) FILTER (created_at >= DATE '{_RET}' - 180), count(*) FILTER (created_at >= DATE '{_RET}' - 180) FROM shadow""")
def _q(spark, d):
    out = L.retention_apply(_life(spark, d), _RET)
    alive = {"inference_requests": F.count("issue_text"), "handoffs": F.count_if(F.col("deleted_at").isNull()),
             "feedback_events": F.count_if(F.col("deleted_at").isNull()), "model_shadow_predictions": F.count(F.lit(1))}
    return T.union_all([out[n].agg(F.count(F.lit(1)).alias("n"), c.alias("live")).select(F.lit(n).alias("table_name"), "n", "live") for n, c in alive.items()])


@register("retention_report", f"""SELECT 'inference_requests' AS table_name, 'anonymize' AS action, count(*) AS records_affected FROM inf_requests WHERE created_at < DATE '{_RET}' - 365
UNION ALL SELECT 'handoffs', 'soft_delete', count(*) FROM handoffs WHERE created_at < DATE '{_RET}' - 180
UNION ALL SELECT 'feedback_events', 'soft_delete', count(*) FROM feedback WHERE created_at < DATE '{_RET}' - 365
UNION ALL SELECT 'model_shadow_predictions', 'hard_delete', count(*) FROM shadow WHERE created_at < DATE '{_RET}' - 180""")
def _q(spark, d):
    return L.retention_report(_life(spark, d), _RET)


@register("erase_tenant", """SELECT 'erasure_completed' AS event_type, 't2' AS tenant_id, 'handoffs' AS table_name, count(*) FILTER (tenant_id = 't2') AS records_affected,
 count(*) FILTER (tenant_id <> 't2') AS kept FROM handoffs UNION ALL
SELECT 'erasure_completed', 't2', 'inference_requests', count(*) FILTER (tenant_id = 't2'), count(*) FILTER (tenant_id <> 't2') FROM inf_requests""")
def _q(spark, d):
    kept, audit = L.erase_tenant({"handoffs": A.handoffs(spark, d), "inference_requests": A.inference_requests(spark, d)}, "t2")
    left = T.union_all([df.agg(F.count(F.lit(1)).alias("kept")).select(F.lit(n).alias("table_name"), "kept") for n, df in kept.items()])
    return audit.join(left, "table_name")


LOCAL["changes"] = """SELECT 'h' || l_orderkey AS handoff_id, 't' || (o_custkey % 5) AS tenant_id, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_shipdate AS DATE) AS VARCHAR)) AS change_id,
 (['in_review', 'resolved', 'closed'])[l_linenumber % 3 + 1] AS queue_status, CASE WHEN l_quantity > 10 THEN 'rev' || l_suppkey ELSE '' END AS reviewer_id,
 l_shipdate AS changed_at, o_orderdate FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""


def _changes(spark, d):
    li = A.table(spark, d, "lineitem")
    o = A.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.concat(F.lit("h"), F.col("l_orderkey").cast("string")).alias("handoff_id"), A._tenant("o_custkey").alias("tenant_id"), A._line_id().alias("change_id"),
        A._pick(["in_review", "resolved", "closed"], F.col("l_linenumber")).alias("queue_status"),
        F.when(F.col("l_quantity") > 10, F.concat(F.lit("rev"), F.col("l_suppkey").cast("string"))).otherwise("").alias("reviewer_id"),
        F.lit("recommend").alias("final_decision"), F.lit("route1").alias("final_resolution_path"), F.col("l_shipdate").cast("timestamp").alias("changed_at"))


@register("capture_outcome", """SELECT change_id AS outcome_id, handoff_id, reviewer_id, greatest(0, date_diff('second', o_orderdate, changed_at))::BIGINT AS resolution_seconds
FROM changes WHERE queue_status IN ('resolved', 'closed') AND reviewer_id <> ''""")
def _q(spark, d):
    return L.capture_outcome(A.handoffs(spark, d), _changes(spark, d))["outcomes"].select("outcome_id", "handoff_id", "reviewer_id", "resolution_seconds")


@register("handoff_state", """SELECT h.handoff_id, coalesce(c.queue_status, h.queue_status) AS queue_status FROM handoffs h LEFT JOIN (
 SELECT handoff_id, arg_max(queue_status, (changed_at, change_id)) AS queue_status FROM changes WHERE NOT (queue_status = 'closed' AND reviewer_id = '') GROUP BY 1) c USING (handoff_id)""")
def _q(spark, d):
    return L.capture_outcome(A.handoffs(spark, d), _changes(spark, d))["handoffs"].select("handoff_id", "queue_status")


@register("handoff_queue", "SELECT handoff_id, queue_status FROM handoffs WHERE tenant_id = 't1' AND queue_status = 'open' ORDER BY created_at DESC, handoff_id LIMIT 50")
def _q(spark, d):
    return L.handoff_queue(A.handoffs(spark, d), "t1", "open").select("handoff_id", "queue_status")


@register("append_validated_event", """SELECT control_type, status, count(*) AS n FROM ctl_events WHERE control_type <> 'load_test' GROUP BY ALL""")
def _q(spark, d):
    good, _ = L.validated_controls(A.control_events(spark, d).withColumn("status", F.concat(F.lit(" "), F.upper("status"))),
                                   [c for c in A.CONTROL_TYPES if c != "load_test"])
    return good.groupBy("control_type", "status").agg(F.count(F.lit(1)).alias("n"))


@register("append_run_records", "SELECT run_scope, count(*) * 2 AS n, sum(sample_size)::BIGINT * 2 AS samples FROM cal_runs GROUP BY 1")
def _q(spark, d):
    path = work_path(spark, "runs")
    for _ in range(2):
        T.append(A.calibration_runs(spark, d), path)
    return spark.read.parquet(path).groupBy("run_scope").agg(F.count(F.lit(1)).alias("n"), F.sum("sample_size").alias("samples"))


@register("reset_tables", "SELECT tenant_id, count(*) AS n FROM chunks GROUP BY 1")
def _q(spark, d):
    path = work_path(spark, "reset")
    for _ in range(2):
        A.doc_chunks(spark, d).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"))


@register("import_cleanup", """SELECT 'requests' AS table_name, count(*) AS n FROM inf_requests WHERE NOT contains(context, 'bitext') UNION ALL
SELECT 'handoffs', count(*) FROM handoffs h JOIN inf_requests r USING (request_id) WHERE NOT contains(r.context, 'bitext')""")
def _q(spark, d):
    out = L.import_cleanup({"requests": A.inference_requests(spark, d), "handoffs": A.handoffs(spark, d)})
    return T.union_all([df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("table_name"), "n") for n, df in out.items()])


@register("import_intents", """SELECT CASE category WHEN 'ACCOUNT' THEN 'accounts' WHEN 'ORDER' THEN 'shipping' ELSE 'general' END AS section,
 CASE intent WHEN 'complaint' THEN 'technical_bug_triage' WHEN 'get_refund' THEN 'refund_duplicate_charge' ELSE 'general_support_triage' END AS route, count(*) AS n
FROM (SELECT instruction, min((intent, category)) AS r, min((intent, category)).intent AS intent, min((intent, category)).category AS category FROM (
 SELECT instruction, {'intent': intent, 'category': category} AS s, intent, category FROM lab_pairs WHERE instruction <> '' AND intent <> '') GROUP BY 1) GROUP BY ALL""".replace(
    "min((intent, category)) AS r, min((intent, category)).intent AS intent, min((intent, category)).category AS category", "min(s).intent AS intent, min(s).category AS category"))
def _q(spark, d):
    out = L.import_intents(_labelled(spark, d), "2024-06-01")
    return out["requests"].groupBy("section", "route").agg(F.count(F.lit(1)).alias("n"))


@register("import_stats", """SELECT count(*) AS rows, count(*) FILTER (instruction = '' OR intent = '') AS skipped,
 count(DISTINCT CASE WHEN instruction <> '' AND intent <> '' THEN intent END) AS intents FROM lab_pairs""")
def _q(spark, d):
    return L.import_intents(_labelled(spark, d), "2024-06-01")["stats"]


@register("set_difference", """SELECT DISTINCT tenant_id FROM inf_requests EXCEPT SELECT DISTINCT tenant_id FROM handoffs WHERE queue_status = 'open' AND tenant_id < 't3'""")
def _q(spark, d):
    h = A.handoffs(spark, d).filter((F.col("queue_status") == "open") & (F.col("tenant_id") < "t3"))
    # sets, not their rows, are compared: a tenant is one row on either side of the join
    return A.inference_requests(spark, d).select("tenant_id").distinct().subtract(h.select("tenant_id").distinct())


@register("set_intersection", "SELECT DISTINCT tenant_id, section FROM inf_requests INTERSECT SELECT DISTINCT tenant_id, section FROM eval_ds")
def _q(spark, d):
    return A.inference_requests(spark, d).select("tenant_id", "section").intersect(
        A.evaluation_dataset(spark, d).select("tenant_id", "section").distinct())


@register("set_subset", """SELECT tenant_id, count(*) AS users, bool_and(user_id IN (SELECT user_id FROM svc WHERE stage = 'retrieval')) AS is_subset
FROM (SELECT DISTINCT tenant_id, user_id FROM svc WHERE stage = 'generation') GROUP BY 1""")
def _q(spark, d):
    # a set is a subset if nothing of it is left after the join with the other
    e = A.service_events(spark, d)
    small = e.where(F.col("stage") == "generation").select("tenant_id", "user_id").distinct()
    large = e.where(F.col("stage") == "retrieval").select("user_id", F.lit(True).alias("held")).distinct()
    return small.join(large, "user_id", "left").groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("users"), F.bool_and(F.coalesce("held", F.lit(False))).alias("is_subset"))


@register("union_all", "SELECT source, count(*) AS n FROM pred_events GROUP BY 1")
def _q(spark, d):
    e = E.prediction_events(A.inference_requests(spark, d), A.inference_results(spark, d), A.shadow_predictions(spark, d))
    return e.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


# -- registry ---------------------------------------------------------------

_STAGES = ["development", "shadow", "canary", "production", "rollback"]
LOCAL["transitions"] = """SELECT o_orderkey AS event_id, 'm' || (o_custkey % 50) AS artifact_id, 'type' || (o_custkey % 50 % 5) AS artifact_type,
 (['development', 'shadow', 'canary', 'production', 'rollback'])[o_orderkey % 5 + 1] AS to_stage, o_orderdate AS ts, o_orderstatus <> 'F' AS gate_passed FROM orders"""
LOCAL["lineage"] = """SELECT *, lag(to_stage) OVER (PARTITION BY artifact_id ORDER BY ts, event_id, seq) AS from_stage FROM (
 SELECT event_id, 0 AS seq, artifact_id, artifact_type, to_stage, ts, gate_passed FROM transitions UNION ALL
 SELECT event_id, 1, previous, artifact_type, 'archived', ts, TRUE FROM (SELECT *, lag(artifact_id) OVER (PARTITION BY artifact_type ORDER BY ts, event_id) AS previous
  FROM transitions WHERE to_stage = 'production') WHERE previous <> artifact_id)"""
LOCAL["cur_stage"] = "SELECT artifact_id, artifact_type, arg_max(to_stage, (ts, event_id, seq)) AS stage, count(*) AS transitions FROM lineage GROUP BY ALL"
LOCAL["artifacts"] = """SELECT 'm' || p_partkey AS artifact_id, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_name END AS training_dataset,
 CASE WHEN p_size % 4 = 0 THEN '' ELSE p_brand END AS checksum, CASE WHEN p_partkey = 7 THEN 'm20' WHEN p_partkey > 0 THEN 'm' || (p_partkey // 3) END AS parent_id FROM part"""


def _transitions(spark, d):
    return A.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("event_id"), F.concat(F.lit("m"), (F.col("o_custkey") % 50).cast("string")).alias("artifact_id"),
        F.concat(F.lit("type"), (F.col("o_custkey") % 50 % 5).cast("string")).alias("artifact_type"), A._pick(_STAGES, F.col("o_orderkey")).alias("to_stage"),
        F.col("o_orderdate").cast("timestamp").alias("ts"), (F.col("o_orderstatus") != "F").alias("gate_passed"))


def _artifacts(spark, d):
    k = F.col("p_partkey")
    return A.table(spark, d, "part").select(
        F.concat(F.lit("m"), k.cast("string")).alias("artifact_id"), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_name")).alias("training_dataset"),
        F.when(F.col("p_size") % 4 == 0, "").otherwise(F.col("p_brand")).alias("checksum"),
        F.when(k == 7, "m20").when(k > 0, F.concat(F.lit("m"), F.floor(k / 3).cast("string"))).alias("parent_id"))


@register("stage_lineage", "SELECT event_id, seq::BIGINT AS seq, artifact_id, from_stage, to_stage FROM lineage")
def _q(spark, d):
    return L.stage_lineage(_transitions(spark, d)).select("event_id", "seq", "artifact_id", "from_stage", "to_stage")


@register("list_artifacts", "SELECT artifact_id, artifact_type, stage, transitions FROM cur_stage WHERE stage = 'production'")
def _q(spark, d):
    c = L.current_stage(L.stage_lineage(_transitions(spark, d))).withColumn("created_at", F.lit(0))
    return L.list_artifacts(c, stage="production").drop("created_at")


@register("registry_compliance", """WITH live AS (SELECT a.*, c.stage FROM artifacts a LEFT JOIN cur_stage c USING (artifact_id))
SELECT 'stage:' || stage AS item, count(*) AS n FROM live WHERE stage IS NOT NULL GROUP BY stage UNION ALL SELECT NULL, count(*) FROM live WHERE stage IS NULL HAVING count(*) > 0
UNION ALL SELECT 'total_artifacts', count(*) FROM live UNION ALL SELECT 'artifacts_without_training_data', count(*) FROM live WHERE training_dataset = ''
UNION ALL SELECT 'artifacts_without_checksum', count(*) FROM live WHERE checksum = ''
UNION ALL SELECT 'live_without_training_data', count(*) FROM live WHERE training_dataset = '' AND stage IN ('production', 'canary')
UNION ALL SELECT 'failed_quality_gates', count(*) FROM lineage WHERE NOT gate_passed UNION ALL SELECT 'total_lineage_events', count(*) FROM lineage""")
def _q(spark, d):
    return L.registry_compliance(_artifacts(spark, d), L.stage_lineage(_transitions(spark, d)))


@register("lineage_chain", """WITH RECURSIVE chain AS (SELECT artifact_id AS root, artifact_id, 0::BIGINT AS depth, [artifact_id] AS seen, parent_id FROM artifacts
 UNION ALL SELECT c.root, a.artifact_id, c.depth + 1, list_append(c.seen, a.artifact_id), a.parent_id FROM chain c JOIN artifacts a ON a.artifact_id = c.parent_id
 WHERE NOT list_contains(c.seen, a.artifact_id)) SELECT root, artifact_id, depth FROM chain""")
def _q(spark, d):
    a = _artifacts(spark, d)
    return L.lineage_chain(a, a.select("artifact_id"))


# -- monitoring -------------------------------------------------------------


_COUNTERS = {  # metric: label, filter
    "assist_decisions_total": ("decision", "TRUE"), "assist_http_requests_total": ("CAST(status AS STRING)", "TRUE"),
    "assist_model_guardrail_fallback_total": ("stage", "guardrail"), "assist_http_request_errors_total": ("event_kind", "status >= 500"),
    "assist_handoffs_total": ("CAST(stage = 'generation' AS STRING)", "decision <> 'recommend'"),
    "assist_injection_detections_total": ("'blocked'", "injection_blocked"),
}


@register("metric_counters", " UNION ALL ".join(
    f"SELECT '{name}' AS metric, service, {label.replace('STRING', 'VARCHAR').replace('event_kind', chr(39) + 'HTTPError' + chr(39))} AS label, count(*) AS value FROM svc WHERE {when} GROUP BY ALL"
    for name, (label, when) in _COUNTERS.items()) + """ UNION ALL
SELECT 'assist_shadow_predictions_total', 'decision-api', traffic_bucket, count(*) FROM shadow GROUP BY 3 UNION ALL
SELECT 'assist_decision_cache_hits_total', service, 'replayed', sum(n - 1)::BIGINT FROM (SELECT service, tenant_id, user_id, stage, count(*) AS n FROM svc GROUP BY ALL HAVING count(*) > 1) GROUP BY 2 UNION ALL
SELECT 'assist_circuit_breaker_trips_total', service, stage, count(*) FROM (SELECT service, stage, island FROM (
 SELECT service, stage, duration_seconds > 0.35 AS failed, count(*) FILTER (NOT duration_seconds > 0.35) OVER (PARTITION BY service, stage ORDER BY ts, event_id) AS island FROM svc)
 WHERE failed GROUP BY ALL HAVING count(*) >= 5) GROUP BY 2, 3""")
def _q(spark, d):
    e = A.service_events(spark, d).withColumn("event_kind", F.lit("HTTPError"))
    plain = [M.metric_counters(e.withColumn("label", F.expr(label)), ["service", "label"], name, F.expr(when)) for name, (label, when) in _COUNTERS.items()]
    shadow = A.shadow_predictions(spark, d).select(F.lit("decision-api").alias("service"), F.col("traffic_bucket").alias("label"))
    repeats = e.groupBy("service", "tenant_id", "user_id", "stage").agg((F.count(F.lit(1)) - 1).alias("n")).where("n > 0")
    hits = repeats.groupBy("service", F.lit("replayed").alias("label")).agg(F.sum("n").alias("value")).withColumn("metric", F.lit("assist_decision_cache_hits_total"))
    outcomes = e.select(F.concat_ws("|", "service", "stage").alias("target"), "ts", "event_id", (F.col("duration_seconds") > 0.35).alias("failed"))
    runs = AU.failure_runs(outcomes, "target").select(F.split_part("target", F.lit("|"), F.lit(1)).alias("service"), F.split_part("target", F.lit("|"), F.lit(2)).alias("label"))
    return T.union_all([x.select("metric", "service", "label", "value") for x in (
        *plain, M.metric_counters(shadow, ["service", "label"], "assist_shadow_predictions_total"), hits,
        M.metric_counters(runs, ["service", "label"], "assist_circuit_breaker_trips_total"))])


#: The ten histograms and the telemetry each counts; events without a value are left out.
_HISTOGRAMS = {
    "http_request_duration_seconds": "duration_seconds", "issue_text_token_count": "token_count", "decision_confidence": "confidence",
    "pipeline_stage_duration_seconds": "duration_seconds", "pipeline_total_duration_seconds": "duration_seconds", "request_cost_dollars": "cost_dollars",
    "rag_faithfulness": "faithfulness", "rag_hallucination_ratio": "hallucination", "rag_citation_coverage": "citation_coverage",
    "retrieval_evidence_score": "evidence_score",
}


def _hist_sql(name: str, column: str) -> str:
    bounds, expr = V.HISTOGRAM_BUCKETS[name], f"{column}::DOUBLE"
    label = "stage" if name.startswith("pipeline_stage") else "''"
    cells = "[" + ", ".join(f"{{'le': '{float(b)!r}', 'n': count(*) FILTER ({expr} <= {float(b)!r}::DOUBLE)}}" for b in bounds) + ", {'le': '+Inf', 'n': count(*)}]"
    return f"""SELECT '{name}' AS metric, service, label, c.le AS le, c.n AS cumulative, total_sum FROM (
 SELECT service, {label} AS label, round(sum({expr}), 6) AS total_sum, unnest({cells}) AS c FROM svc WHERE {column} IS NOT NULL GROUP BY 1, 2)"""


@register("metric_histograms", " UNION ALL ".join(_hist_sql(n, c) for n, c in _HISTOGRAMS.items()))
def _q(spark, d):
    e = A.service_events(spark, d)
    return T.union_all([
        M.metric_histogram(e.where(F.col(c).isNotNull()).withColumn("label", F.col("stage") if n.startswith("pipeline_stage") else F.lit("")), F.col(c), n, ["service", "label"])
        for n, c in _HISTOGRAMS.items()])


@register("metric_gauges", """SELECT 'assist_inflight_requests' AS metric, service, stage AS label, round(arg_max(duration_seconds, (ts, event_id)), 6) AS value FROM svc GROUP BY ALL UNION ALL
SELECT 'assist_circuit_breaker_state', service, stage, arg_max(breaker_state, (ts, event_id))::DOUBLE FROM svc GROUP BY ALL UNION ALL
SELECT 'assist_abstain_rate', service, '', round(count(*) FILTER (decision = 'abstain')::DOUBLE / count(*), 6) FROM svc GROUP BY ALL UNION ALL
SELECT 'assist_routing_accuracy', 'decision-api', model_variant, round(arg_max(v, eval_date), 6) FROM (
 SELECT model_variant, eval_date, avg(is_route_correct::INTEGER) AS v FROM eval_ds WHERE is_route_correct IS NOT NULL GROUP BY ALL) GROUP BY 3 UNION ALL
SELECT 'assist_calibration_ece', 'decision-api', model_variant, round(ece, 6) FROM (""" + ece_sql("eval_ds", "model_variant") + ")")
def _q(spark, d):
    e, ds = A.service_events(spark, d), A.evaluation_dataset(spark, d)
    abstain = e.groupBy("service", F.lit("").alias("label")).agg((F.count_if(F.col("decision") == "abstain") / F.count(F.lit(1))).alias("value"))
    daily = ds.where(F.col("is_route_correct").isNotNull()).groupBy("model_variant", "eval_date").agg(F.avg(F.col("is_route_correct").cast("int")).alias("v"))
    accuracy = M.metric_gauge(daily.select(F.lit("decision-api").alias("service"), F.col("model_variant").alias("label"), "eval_date", "v"), F.col("v"), "assist_routing_accuracy", ["service", "label"], ["eval_date"])
    ece = E.ece(ds, ["model_variant"]).select(F.lit("decision-api").alias("service"), F.col("model_variant").alias("label"), F.col("ece").alias("value"))
    staged = e.withColumn("label", F.col("stage"))
    return T.union_all([x.select("metric", "service", "label", F.col("value").cast("double").alias("value")) for x in (
        M.metric_gauge(staged, F.col("duration_seconds"), "assist_inflight_requests", ["service", "label"], ["ts", "event_id"]),
        M.metric_gauge(staged, F.col("breaker_state"), "assist_circuit_breaker_state", ["service", "label"], ["ts", "event_id"]),
        abstain.withColumn("metric", F.lit("assist_abstain_rate")), accuracy, ece.withColumn("metric", F.lit("assist_calibration_ece")))])


@register("probe_summary", """SELECT tenant_id, total, ok, round(mean_latency_ms, 6) AS mean_latency_ms, p50_latency_ms, p95_latency_ms, round(error_rate, 6) AS error_rate,
 error_rate <= 0.25 AND p95_latency_ms <= 2500 AS passed FROM (SELECT tenant_id, count(*) AS total, count(*) FILTER (status = 200) AS ok, avg(ms) AS mean_latency_ms,
 round(list_sort(list(ms))[CAST(round_even(0.5 * (count(*) - 1), 0) AS BIGINT) + 1], 6) AS p50_latency_ms, round(list_sort(list(ms))[CAST(round_even(0.95 * (count(*) - 1), 0) AS BIGINT) + 1], 6) AS p95_latency_ms,
 count(*) FILTER (status <> 200)::DOUBLE / count(*) AS error_rate FROM (SELECT *, duration_seconds * 1000 AS ms FROM svc) GROUP BY 1)""")
def _q(spark, d):
    e = A.service_events(spark, d).withColumn("latency_ms", F.col("duration_seconds") * 1000)
    return M.probe_summary(e, ["tenant_id"], 0.25, 2500.0)


@register("probe_status_counts", "SELECT tenant_id, CAST(status AS VARCHAR) AS status, count(*) AS n FROM svc GROUP BY ALL")
def _q(spark, d):
    return M.probe_status_counts(A.service_events(spark, d), ["tenant_id"])


@register("model_ops_daily", """SELECT 'dataset' AS part, count(*) AS n FROM logged_ds WHERE eval_date = DATE '1998-06-15' UNION ALL
SELECT 'metrics', count(*) FROM (SELECT DISTINCT tenant_id, coalesce(section, '__all__'), model_variant FROM logged_ds WHERE eval_date = DATE '1998-06-15')""")
def _q(spark, d):
    from ..plans import model_ops as MO

    f = MO.daily_frames(A.inference_requests(spark, d), A.inference_results(spark, d), A.shadow_predictions(spark, d),
                        A.reviewer_outcomes(spark, d), A.feedback_events(spark, d), "1998-06-15")
    paths = [work_path(spark, n) for n in ("dataset", "metrics", "drift")]
    MO.run_daily(f, *paths)
    return T.union_all([spark.read.parquet(p).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("part"), "n") for p, n in zip(paths, ("dataset", "metrics"))])


@register("reindex_embeddings", """SELECT tenant_id, count(*) AS chunks, 32::BIGINT AS dim FROM chunks GROUP BY 1""")
def _q(spark, d):
    from ..functions.embedding import embed

    c = A.doc_chunks(spark, d).select("chunk_id", "tenant_id", "text_content")
    v = stage(c.select("chunk_id", "tenant_id").join(embed(c, ["chunk_id"], "text_content", 32), "chunk_id"), "reindexed")
    return v.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("chunks"), F.max(F.size("embedding")).alias("dim"))
