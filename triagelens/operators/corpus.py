"""Conversation data -> reply pairs -> deduplicated corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import text as X
from ..functions.scoring import let


def turn_pairs(turns: DataFrame, source: str = "abcd", channel: str = "chat") -> DataFrame:
    """Assistant turns whose previous non-empty turn is a user turn.

    ``turns`` has conv_id, turn, role, text. The window is per conversation and
    keeps one row of look-back, so long conversations stream through it.
    """
    t = turns.select(
        "conv_id", "turn", X.role_of(F.col("role")).alias("role"), X.clean(F.col("text")).alias("text")
    ).filter(F.col("text") != "")
    w = Window.partitionBy("conv_id").orderBy("turn")
    before = t.withColumn("prev_role", F.lag("role").over(w)).withColumn("prev_text", F.lag("text").over(w))
    pairs = before.filter((F.col("role") == "assistant") & (F.col("prev_role") == "user"))
    return pairs.select(
        "conv_id", "turn",
        F.lit(source).alias("source"),
        F.col("prev_text").alias("customer_text"),
        F.col("text").alias("agent_text"),
        X.tone_of(F.col("text")).alias("tone"),
        F.lit(channel).alias("channel"),
        X.tags_of(F.col("prev_text"), V.CHAT_TAGS).alias("tags"),
    )


def reply_pairs(posts: DataFrame) -> DataFrame:
    """Replies joined to the post they answer.

    When both directions are known the parent must be inbound and the reply
    outbound.
    """
    p = posts.select(
        F.col("tweet_id").alias("parent_id"), X.clean(F.col("text")).alias("customer_text"),
        X.parse_bool(F.col("inbound")).alias("parent_inbound"))
    r = posts.select(
        "tweet_id", X.clean(F.col("in_response_to_tweet_id")).alias("parent_id"),
        X.clean(F.col("text")).alias("agent_text"), X.parse_bool(F.col("inbound")).alias("reply_inbound"),
    ).filter((F.col("parent_id") != "") & (F.col("agent_text") != ""))
    known = F.col("parent_inbound").isNotNull() & F.col("reply_inbound").isNotNull()
    return (
        r.join(p.filter(F.col("customer_text") != ""), "parent_id")
        .filter(~known | (F.col("parent_inbound") & ~F.col("reply_inbound")))
        .select(
            "tweet_id", "parent_id", F.lit("twitter_support").alias("source"), "customer_text", "agent_text",
            X.tone_of(F.col("agent_text")).alias("tone"), F.lit("social").alias("channel"),
            X.tags_of(F.col("customer_text"), V.SOCIAL_TAGS).alias("tags"),
        )
    )


def labelled_pairs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labelled instruction/response rows as (conversation pairs, intent pairs)."""
    c = {n: X.clean(F.col(n)).alias(n) for n in ("flags", "instruction", "category", "intent", "response")}
    rest = [x for x in rows.columns if x not in c]
    r = rows.select(*rest, *c.values()).filter((F.col("instruction") != "") & (F.col("response") != ""))
    tags = F.array_sort(F.array_distinct(F.filter(
        F.array(F.lower("intent"), F.lower("category")), lambda t: t != "")))
    pairs = r.select(
        *rest, F.lit("bitext").alias("source"), F.col("instruction").alias("customer_text"),
        F.col("response").alias("agent_text"), X.intent_tone(F.col("intent"), F.col("flags")).alias("tone"),
        F.lit("chat").alias("channel"), tags.alias("tags"))
    intents = r.filter(F.col("intent") != "").select(
        *rest, "instruction", "response", "intent", "category", F.lit("bitext").alias("source"), "flags")
    return pairs, intents


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every key in ``order``.

    The winner's order key is found by a partial aggregation, which collapses a
    group of copies on the map side; only then are the wide rows joined back.
    """
    first = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("first"))
    return df.join(first, keys).filter(F.struct(*order) == F.col("first")).drop("first")


def dedupe_pairs(pairs: DataFrame, order: list[str]) -> DataFrame:
    """First pair per normalized (customer, agent) text; empty keys drop out.

    Keys are carried as digests instead of the texts themselves. Whether a key
    is empty is looked up after the grouping: a filter before it would be
    pushed down and normalize every text once more.
    """
    both = F.struct(X.normalize_text(F.col("customer_text")).alias("c"), X.normalize_text(F.col("agent_text")).alias("a"))
    key = let(both, lambda k: F.when((k["c"] != "") & (k["a"] != ""), F.sha2(F.concat_ws("\u0001", k["c"], k["a"]), 256)).otherwise(""))
    smallest = pairs.withColumn("pair_key", key).groupBy("pair_key").agg(
        F.min_by(F.struct(*pairs.columns), F.struct(*order)).alias("row"), F.max(F.length("pair_key") > 0).alias("usable"))
    return smallest.filter("usable").select("row.*")


def numbered(df: DataFrame, order: list[str], name: str = "seq") -> DataFrame:
    """1-based position in a total order without a one-partition window.

    Rows are range-partitioned and sorted; each partition's size gives the
    offset of the next, so only partition sizes pass through one small window.
    """
    from ..session import stage

    parts = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    laid = stage(
        df.repartitionByRange(int(parts), *order)
        .withColumn("_p", F.spark_partition_id()),
        "numbered",
    )
    sizes = laid.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.withColumn(
        "_o", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).select("_p", "_o")
    w = Window.partitionBy("_p").orderBy(*order)
    return (
        laid.join(F.broadcast(offsets), "_p")
        .withColumn(name, F.row_number().over(w) + F.col("_o"))
        .drop("_p", "_o")
    )


def retrieval_chunks(pairs: DataFrame, tenant_id: str, as_of: str) -> DataFrame:
    """Retrieval chunks from deduplicated pairs that carry ``seq`` (1-based).

    The id keeps the pair's running number; answers under eight words and
    repeats of an earlier answer are left out.
    """
    norm = X.normalize_text(F.col("agent_text"))
    c = pairs.withColumn("norm", norm).filter(F.size(F.split("norm", " ")) >= 8)
    c = c.withColumn("norm_key", F.sha2("norm", 256)).drop("norm")
    c = c.groupBy("norm_key").agg(
        F.min_by(F.struct("seq", "source", "customer_text", "agent_text"), "seq").alias("r")).select("r.*")
    section = X.section_of(F.concat_ws(" ", "customer_text", "agent_text"))
    return c.withColumn("section", section).select(
        F.lit(tenant_id).alias("tenant_id"), "section",
        F.concat(F.lit("ext_"), F.col("source"), F.lit("_"), padded(F.col("seq"), 6)).alias("chunk_id"),
        F.concat_ws("_", F.lit("ext"), "source", "section", F.lit("playbook")).alias("doc_id"),
        "source", F.lit(as_of).alias("updated_at"), X.clean(F.col("agent_text")).alias("text"), "seq")


def padded(n: Column, width: int) -> Column:
    """Zero-padded number; longer numbers keep all their digits."""
    s = n.cast("string")
    return F.lpad(s, F.greatest(F.lit(width), F.length(s)), F.lit("0"))


def history_window(turns: DataFrame, max_turns: int = 8, limit: int = 280) -> DataFrame:
    """The last turns of every conversation as ``- role: text`` lines.

    Reads the newest ``max_turns`` rows per conversation through a ranked
    window (a per-group limit), never the whole conversation.
    """
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = turns.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= max_turns)
    content = X.clean(F.col("text"))
    role = F.lower(F.coalesce(F.nullif(X.clean(F.col("role")), F.lit("")), F.lit("user")))
    line = F.concat(F.lit("- "), role, F.lit(": "), X.trim_to(content, limit))
    return last.filter(content != "").groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda s: s["line"]), "\n").alias("history"),
        F.count(F.lit(1)).alias("lines"))


def prior_assistant_messages(turns: DataFrame, max_turns: int = 8) -> DataFrame:
    """Assistant messages among the last turns, first per normalized text."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = turns.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= max_turns)
    msgs = last.filter(F.lower(X.clean(F.col("role"))) == "assistant").select(
        "conv_id", "turn", X.clean(F.col("text")).alias("message"))
    keyed = msgs.withColumn("norm", F.array_join(X.plain_tokens(F.col("message")), " ")).filter(F.col("norm") != "")
    return keyed.groupBy("conv_id", "norm").agg(F.min_by(F.struct("turn", "message"), "turn").alias("r")).select(
        "conv_id", "r.turn", "r.message")
