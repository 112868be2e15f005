"""File feeds: conversations, posts, labelled pairs, workload, chunks, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean, role_of
from ..session import stage

# Field names conversation records use.
TURN_LISTS = ["dialogue", "dialog", "turns", "messages", "conversation", "chat"]
TEXT_FIELDS = ["text", "utterance", "message", "response"]
ROLE_FIELDS = ["role", "speaker", "author_role", "author"]
WORKLOAD_COLUMNS = ["metric_date", "tenant_id", "section", "eligible_tickets_total", "active_agents_total", "source"]
POST_SCHEMA = "tweet_id string, in_response_to_tweet_id string, inbound string, text string"
PAIR_SCHEMA = "flags string, instruction string, category string, intent string, response string"


def _first_text(v: Column, fields: list[str]) -> Column:
    """First non-blank of several fields of a VARIANT object."""
    return F.coalesce(*[F.nullif(clean(F.try_variant_get(v, f"$.{n}", "string")), F.lit("")) for n in fields], F.lit(""))


def _turn(v: Column, path: Column) -> Column:
    inbound = F.try_variant_get(v, "$.inbound", "boolean")
    return F.struct(path.alias("path"), role_of(_first_text(v, ROLE_FIELDS), inbound).alias("role"), _first_text(v, TEXT_FIELDS).alias("text"))


def conversations(spark: SparkSession, path: str, jsonl: bool = True) -> DataFrame:
    """Turns (conv_id, turn, role, text) of nested conversation records.

    Lines that are not JSON are skipped. Turn lists may nest, also directly in
    one another; each level is one narrow explode, staged and followed until a
    level is empty.
    """
    raw = spark.read.text(path, wholetext=not jsonl).select(
        F.concat_ws(":", F.element_at(F.split(F.input_file_name(), "/"), -1), F.monotonically_increasing_id().cast("string")).alias("conv_id"),
        F.try_parse_json("value").alias("v")).filter(F.col("v").isNotNull())
    if not jsonl:
        items = F.try_variant_get("v", "$", "array<variant>")
        raw = raw.select("conv_id", F.posexplode(F.coalesce(items, F.array("v")))).select(
            F.concat_ws("#", "conv_id", F.lpad(F.col("pos").cast("string"), 9, "0")).alias("conv_id"), F.col("col").alias("v"))
    level = stage(raw.select("conv_id", "v", F.lit("").alias("path")), "level")
    out = None
    while out is None or not level.isEmpty():
        turns = level.select("conv_id", F.inline(F.array(_turn(F.col("v"), F.col("path"))))).filter(F.col("text") != "")
        out = turns if out is None else out.unionByName(turns)
        lists = F.array(*[F.struct(F.lit(i).alias("i"), F.try_variant_get("v", f"$.{n}", "array<variant>").alias("items"))
                          for i, n in enumerate(TURN_LISTS)],
                        F.struct(F.lit(len(TURN_LISTS)).alias("i"), F.try_variant_get("v", "$", "array<variant>").alias("items")))
        level = stage(
            level.select("conv_id", "path", F.inline(lists)).filter(F.col("items").isNotNull())
            .select("conv_id", "path", "i", F.posexplode("items"))
            .select("conv_id", F.col("col").alias("v"),
                    F.concat("path", F.col("i").cast("string"), F.lpad(F.col("pos").cast("string"), 9, "0")).alias("path")), "level")
    return out.withColumnRenamed("path", "turn")


def posts_csv(spark: SparkSession, path: str) -> DataFrame:
    """Posts with trimmed fields; rows without id drop, the last row per id wins."""
    raw = spark.read.schema(POST_SCHEMA).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    rows = raw.select(*[clean(F.col(c)).alias(c) for c in raw.columns]).filter(F.col("tweet_id") != "").withColumn(
        "_o", F.monotonically_increasing_id())
    rest = ["in_response_to_tweet_id", "inbound", "text"]
    return rows.groupBy("tweet_id").agg(F.max_by(F.struct(*rest), "_o").alias("r")).select("tweet_id", "r.*")


def labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(PAIR_SCHEMA).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return raw.filter((clean(F.col("instruction")) != "") & (clean(F.col("response")) != ""))


def workload_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with a reason). Missing columns are an error."""
    raw = spark.read.option("header", True).csv(path)
    missing = sorted(set(WORKLOAD_COLUMNS) - set(raw.columns))
    if missing:
        raise ValueError(f"Missing CSV columns: {', '.join(missing)}")
    t = raw.select(*[clean(F.col(c)).alias(c) for c in WORKLOAD_COLUMNS])
    day, e, a = F.try_to_date("metric_date", "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.expr("try_cast(metric_date AS date)"), \
        F.expr("try_cast(eligible_tickets_total AS int)"), F.expr("try_cast(active_agents_total AS int)")
    reason = (
        F.when(day.isNull(), "bad_metric_date").when(F.col("tenant_id") == "", "tenant_id_required")
        .when(e.isNull() | a.isNull(), "bad_count").when((e < 0) | (a < 0), "negative_count"))
    t = t.withColumn("reject_reason", reason)
    good = t.filter(F.col("reject_reason").isNull()).select(
        F.expr("try_cast(metric_date AS date)").alias("metric_date"), "tenant_id",
        F.coalesce(F.nullif("section", F.lit("")), F.lit("__all__")).alias("section"),
        e.alias("eligible_tickets_total"), a.alias("active_agents_total"),
        F.coalesce(F.nullif("source", F.lit("")), F.lit("manual")).alias("source"))
    return good, t.filter(F.col("reject_reason").isNotNull())


_CHUNK = "tenant_id string, section string, chunk_id string, doc_id string, source string, updated_at string, text string"


def seed_chunks_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(chunks with defaults, rejected rows lacking a required field)."""
    raw = spark.read.schema(_CHUNK).json(path)
    d = {"section": "general", "doc_id": "external_playbook", "source": "external"}
    t = raw.select(*[F.coalesce(F.nullif(clean(F.col(c)), F.lit("")), F.lit(d.get(c, ""))).alias(c) for c in raw.columns])
    ok = (F.col("tenant_id") != "") & (F.col("chunk_id") != "") & (F.col("updated_at") != "") & (F.col("text") != "")
    return t.filter(ok), t.filter(~ok)


def knowledge_json(spark: SparkSession, path: str, array: bool = True) -> DataFrame:
    """Chunks from a JSON array (or JSON lines); malformed entries drop."""
    raw = spark.read.schema(_CHUNK).option("multiLine", array).json(path)
    need = ["tenant_id", "section", "chunk_id", "doc_id", "text"]
    return raw.dropna(subset=need).fillna({"source": "unknown", "updated_at": ""})


def style_jsonl(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema("source string, tone string, channel string, customer_text string, agent_text string, tags array<string>").json(path)

    def default(c: str, v: str) -> Column:
        return F.coalesce(F.nullif(F.lower(clean(F.col(c))) if c != "source" else clean(F.col(c)), F.lit("")), F.lit(v)).alias(c)

    out = raw.select(default("source", "external"), default("tone", "friendly"), default("channel", "chat"),
                     clean(F.col("customer_text")).alias("customer_text"), clean(F.col("agent_text")).alias("agent_text"),
                     F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
    return out.filter((F.col("customer_text") != "") & (F.col("agent_text") != ""))


def intent_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAIR_SCHEMA + ", source string").json(path)


def model_artifact(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A linear model file as weights (token, label, weight) and bias (label, bias)."""
    raw = spark.read.schema("bias map<string,double>, token_weights map<string,map<string,double>>").option("multiLine", True).json(path)
    weights = raw.select(F.explode("token_weights").alias("token", "m")).select("token", F.explode("m").alias("label", "weight"))
    return {"weights": weights, "bias": raw.select(F.explode("bias").alias("label", "bias"))}


def alert_events(spark: SparkSession, path: str) -> DataFrame:
    schema = "ts_utc string, route string, payload string, content_type string"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def alert_route_counts(events: DataFrame) -> DataFrame:
    """Events per route and in total."""
    per = events.groupBy(F.coalesce("route", F.lit("")).alias("route")).agg(F.count(F.lit(1)).alias("n"))
    return per.unionByName(per.agg(F.sum("n").alias("n")).select(F.lit("__total__").alias("route"), F.coalesce("n", F.lit(0)).alias("n")))


def sink_jsonl(df: DataFrame, path: str, order: list[str], columns: list[str]) -> None:
    """All rows as JSON lines, in order from file to file."""
    df.orderBy(*order).select(*columns).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def sink_report(report: DataFrame, path: str, title: str) -> DataFrame:
    """Write a report as JSON lines, every row; returns it as lines of a Markdown table (``n``, ``line``).

    Row lines all carry ``n`` 3, after the title and the two heading lines.
    """
    report.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("n/a")) for c in report.columns]
    body = report.select(F.lit(3).alias("n"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    head = [f"# {title}", "| " + " | ".join(report.columns) + " |", "|" + "---|" * len(report.columns)]
    lines = F.array(*[F.struct(F.lit(i).alias("n"), F.lit(x).alias("line")) for i, x in enumerate(head)])
    return report.sparkSession.range(1).select(F.inline(lines)).unionByName(body)


def sink_events(events: DataFrame) -> DataFrame:
    """Key/value rows for a message sink: compact JSON, keys sorted."""
    body = F.to_json(F.struct("event_type", "payload", "request_id", "tenant_id"))
    return events.select(F.concat_ws(":", "tenant_id", "request_id").alias("key"), body.alias("value"))
