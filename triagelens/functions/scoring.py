"""Route, escalation, confidence and policy scores as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..operators.calibration import logit, sigmoid
from .text import contains_any, count_hits, plain_tokens, squeeze, tokenize, trim_to

# Policy thresholds and guardrail band.
BASE_CONFIDENCE = 0.65
HIGH_RISK_BUMP = 0.05
MAX_AUTO_ESCALATION = 0.55
CONFIDENCE_BAND = (0.05, 0.98)
INFRA_COST = 0.00005
TOKEN_COST = 0.000002

BROADCAST_ROWS = 200_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def clamp(v: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), v))


def softmax(scores: Column, temperature: float = 1.0) -> Column:
    """Softmax over an array of scores."""
    t = max(1e-6, float(temperature))
    shifted = let(F.struct(scores.alias("s"), F.array_max(scores).alias("m")),
                  lambda x: F.transform(x["s"], lambda v: F.exp((v - x["m"]) / t)))
    return let(shifted, normalized)


def normalized(values: Column) -> Column:
    """Non-negative array scaled to sum one; uniform when it sums to zero."""
    positive = F.transform(values, lambda v: F.greatest(F.lit(0.0), v))
    total = F.aggregate(positive, F.lit(0.0), lambda a, v: a + v)
    return let(F.struct(positive.alias("p"), total.alias("t")), lambda x: F.transform(
        x["p"], lambda v: F.when(x["t"] > 0, v / x["t"]).otherwise(F.lit(1.0) / F.size(x["p"]))))


# -- models -----------------------------------------------------------------


def weights_frame(spark, model: dict) -> DataFrame:
    """A linear model's token weights as (token, label, weight) rows."""
    rows = [(t, l, float(w)) for t, ws in model["token_weights"].items() for l, w in ws.items()]
    df = spark.createDataFrame(rows, "token string, label string, weight double")
    return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df


def token_weights_join(requests: DataFrame, weights: DataFrame, text: str = "issue_text") -> DataFrame:
    """Sum of token weights per (request, label); tokens count as often as they occur."""
    tokens = requests.select("request_id", F.explode(tokenize(F.col(text))).alias("token"))
    return tokens.join(weights, "token").groupBy("request_id", "label").agg(F.sum("weight").alias("weight"))


def linear_router(requests: DataFrame, weights: DataFrame, bias: dict[str, float], labels: list[str],
                  calibration: dict[str, float]) -> DataFrame:
    """Add route_probs (array in label order) from a linear token model."""
    sums = token_weights_join(requests, weights).groupBy("request_id").agg(*[
        F.sum(F.when(F.col("label") == name, F.col("weight"))).alias(f"_w{i}") for i, name in enumerate(labels)])
    scores = F.array(*[F.coalesce(f"_w{i}", F.lit(0.0)) + F.lit(float(bias.get(n, 0.0))) for i, n in enumerate(labels)])
    probs = apply_temperature(scores, calibration)
    out = requests.join(sums, "request_id", "left").withColumn("route_probs", probs)
    return out.drop(*[f"_w{i}" for i in range(len(labels))])


def apply_temperature(scores: Column, calibration: dict[str, float]) -> Column:
    lo, hi = calibration.get("min_probability", 0.0001), calibration.get("max_probability", 0.9999)
    raw = softmax(scores, calibration.get("temperature", 1.0))
    return let(F.transform(raw, lambda p: clamp(p, lo, hi)), normalized)


def apply_platt(p: Column, calibration: dict[str, float]) -> Column:
    cal = sigmoid(logit(p) * float(calibration.get("a", 1.0)) + F.lit(float(calibration.get("b", 0.0))))
    return clamp(cal, calibration.get("min_probability", 0.0001), calibration.get("max_probability", 0.9999))


def escalation_model(text: Column, top_prob: Column, top_evidence: Column, model: dict, calibration: dict) -> Column:
    """Calibrated escalation probability from a linear model."""
    table = F.create_map(*[F.lit(x) for kv in model["token_weights"].items() for x in (kv[0], float(kv[1]))])

    def score(tokens: Column) -> Column:
        known = F.aggregate(F.filter(tokens, lambda t: t.isin(list(model["token_weights"]))), F.lit(0.0),
                            lambda a, t: a + F.coalesce(table[t], F.lit(0.0)))
        long_ratio = F.size(F.filter(tokens, lambda t: F.length(t) >= 12)) / F.greatest(F.lit(1), F.size(tokens))
        raw = (
            F.lit(float(model["bias"]))
            + (F.lit(1.0) - clamp(top_prob, 0, 1)) * model["route_uncertainty_weight"]
            + (F.lit(1.0) - clamp(F.coalesce(top_evidence, F.lit(0.0)), 0, 1)) * model["evidence_gap_weight"]
            + long_ratio * model["long_word_ratio_weight"] + known)
        return apply_platt(sigmoid(raw), calibration)

    return let(tokenize(text), score)


def label_keywords(labels: list[str]) -> dict[str, list[str]]:
    """Keywords of each label: those of the intent of that name and those of the route."""
    intents = {row[0]: row[4] for row in V.INTENTS}
    return {n: [*intents.get(n, []), *V.ROUTE_KEYWORDS.get(n, [])] for n in labels}


def heuristic_routes(text: Column, keywords: dict[str, list[str]]) -> Column:
    """Softmax of keyword hits per label, in the order of ``keywords``."""
    return let(F.lower(text), lambda low: softmax(F.array(*[
        F.lit(0.2) + count_hits(low, terms) * 1.2 for terms in keywords.values()])))


def heuristic_escalation(text: Column, top_prob: Column) -> Column:
    hits = let(F.lower(text), lambda low: count_hits(low, V.ESCALATION_TERMS))
    return let(hits, lambda h: clamp(
        F.lit(0.15) + F.when(h > 0, 0.35).otherwise(0.0) + F.greatest(F.lit(0.0), F.lit(0.4) - top_prob) + h * 0.1, 0.0, 0.98))


def fallback_scoring(primary: Column, heuristic: Column) -> tuple[Column, Column]:
    """Primary probabilities unless missing or invalid, and the fallback flag."""
    bad = primary.isNull() | F.exists(primary, lambda p: p.isNull() | F.isnan(p))
    return F.when(bad, heuristic).otherwise(primary), F.coalesce(bad, F.lit(True))


# -- after the model --------------------------------------------------------


def ranked_routes(probs: Column, labels: list[str]) -> Column:
    """(label, prob) structs by probability, ties in label order, four decimals."""
    names = F.array(*[F.lit(n) for n in labels])
    keyed = F.transform(normalized(probs), lambda p, i: F.struct(
        (-F.round(p, 4)).alias("neg"), i.alias("i"), F.get(names, i).alias("label")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["label"].alias("label"), (-s["neg"]).alias("prob")))


def _taxonomy(field: int) -> Column:
    return F.create_map(*[F.lit(x) for row in V.INTENTS for x in (row[0], row[field])])


def escalation_hint(label: Column) -> Column:
    return F.coalesce(_taxonomy(3)[label], F.lit(0.10))


def intent_category(label: Column) -> Column:
    return F.coalesce(_taxonomy(1)[label], F.lit("GENERAL"))


def intent_risk(label: Column) -> Column:
    return F.coalesce(_taxonomy(2)[label], F.lit("medium"))


def legacy_route(intent: Column) -> Column:
    pairs = [(i, route) for route, intents in V.LEGACY_ROUTE_INTENTS.items() for i in intents]
    table = F.create_map(*[F.lit(x) for kv in pairs for x in kv])
    return F.coalesce(table[intent], F.lit("general_support_triage"))


def blended_escalation(model_prob: Column, top_label: Column) -> Column:
    return F.round(clamp(model_prob * 0.75 + escalation_hint(top_label) * 0.25, 0, 1), 4)


def intents(text: Column, k: int = 3, vocabulary: list | None = None) -> Column:
    """Top intents by keyword hits: (intent_id, score), catalog order on ties."""
    rows = vocabulary or V.INTENTS

    def scored(low: Column) -> Column:
        cells = [F.struct((-F.round(F.lit(hint * 0.1) + count_hits(low, kws) * 1.2, 4)).alias("neg"),
                          F.lit(i).alias("i"), F.lit(name).alias("intent_id"))
                 for i, (name, _, _, hint, kws) in enumerate(rows)]
        return F.slice(F.array_sort(F.filter(F.array(*cells), lambda c: c["neg"] < -0.15)), 1, k)

    return F.transform(let(F.lower(text), scored), lambda c: F.struct(c["intent_id"].alias("intent_id"), (-c["neg"]).alias("score")))


def ood_score(text: Column, top_prob: Column, evidence: Column) -> Column:
    """Out-of-distribution score; ``evidence`` is the ranked array of structs."""

    def score(tokens: Column) -> Column:
        unknown = F.size(F.filter(tokens, lambda t: F.length(t) >= 12)) / F.greatest(F.lit(1), F.size(tokens))
        brevity = F.when(F.size(tokens) <= 2, 0.15).otherwise(0.0)
        first = F.transform(F.slice(evidence, 1, 5), lambda e: e["score"])
        flat = F.when((F.size(first) >= 2) & (F.array_max(first) - F.array_min(first) < 0.05), 0.10).otherwise(0.0)
        raw = (
            (F.lit(1.0) - top_prob) * 0.45 + (F.lit(1.0) - F.get(evidence, F.lit(0))["score"]) * 0.30
            + unknown * 0.10 + brevity + flat * 0.05)
        return F.when(F.size(evidence) == 0, 0.95).otherwise(clamp(raw, 0, 1))

    words = F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda t: t != "")
    return F.round(let(words, score), 4)


def contradiction_score(text: Column, evidence: Column, pairs: list[tuple[str, str, float]] | None = None) -> Column:
    def score(x: Column) -> Column:
        hits = [F.when(x["q"].contains(a) & x["e"].contains(b), w).otherwise(0.0) for a, b, w in pairs or V.CONTRADICTIONS]
        return F.least(F.lit(1.0), reduce(lambda p, q: p + q, hits, F.lit(0.03)))

    corpus = F.lower(F.array_join(F.transform(evidence, lambda e: e["text"]), " "))
    both = F.struct(F.lower(text).alias("q"), corpus.alias("e"))
    return F.round(F.when(F.size(evidence) == 0, 0.3).otherwise(let(both, score)), 4)


def final_confidence(route_conf: Column, evidence: Column, escalation: Column, ood: Column, contradiction: Column) -> Column:
    raw = route_conf * 0.45 + evidence * 0.25 + (F.lit(1.0) - escalation) * 0.20 - ood * 0.07 - contradiction * 0.03
    return F.round(clamp(raw, 0, 1), 4)


# -- policy -----------------------------------------------------------------


def policy(text: Column, risk_level: Column, confidence: Column, escalation: Column, terms: list[str] | None = None,
           high_risk_bump: float = HIGH_RISK_BUMP) -> Column:
    """Struct of decision and reason code (empty for an automatic answer)."""
    risky = let(F.lower(text), lambda low: contains_any(low, terms or V.POLICY_TERMS))
    threshold = F.lit(BASE_CONFIDENCE) + F.when(risk_level == "high", high_risk_bump).otherwise(0.0)

    def out(decision: str, reason: str | None) -> Column:
        reasons = F.array(F.lit(reason)) if reason else F.array().cast("array<string>")
        return F.struct(F.lit(decision).alias("decision"), reasons.alias("reason_codes"))

    return (
        F.when(risky, out("escalate", "policy_high_risk"))
        .when(confidence < threshold, out("abstain", "low_confidence"))
        .when(escalation >= MAX_AUTO_ESCALATION, out("abstain", "high_escalation_risk"))
        .otherwise(out("recommend", None)))


def guardrail_reasons(used_fallback: Column, confidence: Column, band: tuple[float, float] = CONFIDENCE_BAND) -> Column:
    lo, hi = band
    return F.array_compact(F.array(
        F.when(used_fallback, F.lit("model_backend_fallback")),
        F.when((confidence < lo) | (confidence > hi), F.lit("confidence_out_of_band"))))


def guarded_policy(result: Column, guards: Column) -> Column:
    """Any guardrail reason turns the decision into an escalation."""
    return F.when(F.size(guards) > 0, F.struct(
        F.lit("escalate").alias("decision"),
        F.array_union(result["reason_codes"], guards).alias("reason_codes"))).otherwise(result)


def canary_bucket(tenant_id: Column, request_id: Column) -> Column:
    """Stable bucket 0..99 of a request."""
    digest = F.sha2(F.concat_ws(":", tenant_id, request_id), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 100


def in_canary(tenant_id: Column, request_id: Column, percent: int) -> Column:
    p = max(0, min(100, int(percent)))
    return F.lit(p >= 100) if p in (0, 100) else canary_bucket(tenant_id, request_id) < p


# -- text for people --------------------------------------------------------


def handoff_summary(text: Column, reasons: Column) -> Column:
    listed = F.when(F.size(reasons) > 0, F.array_join(reasons, ", ")).otherwise("unspecified")
    return F.concat(F.lit("Handoff required for issue: "), F.substring(text, 1, 160), F.lit(". Reasons: "), listed, F.lit("."))


def draft_template(text: Column, evidence: Column, top_route: Column, customer_name: Column | None = None) -> Column:
    """Grounded reply from the first three evidence chunks; NULL without any."""
    name = F.trim(F.coalesce(customer_name, F.lit(""))) if customer_name is not None else F.lit("")
    greeting = F.when(name != "", F.concat(F.lit("Hi "), name, F.lit(","))).otherwise("Hi,")

    def human(c: Column) -> Column:
        return F.replace(c, F.lit("_"), F.lit(" "))

    def cited(e: Column) -> Column:
        return F.concat(trim_to(e["text"], 170), F.lit(" ["), e["chunk_id"], F.lit("]"))

    lines = F.transform(F.slice(evidence, 1, 3), lambda e, i: F.when(
        i == 0, F.concat(F.lit("Based on our "), human(e["source"]), F.lit(" documentation, the recommended action is: "), cited(e))
    ).otherwise(F.concat(F.lit("Additionally ("), human(e["source"]), F.lit("): "), cited(e))))
    intro = F.concat(F.lit('I see you\'re reaching out about: "'), trim_to(text, 120),
                     F.lit('". Let me walk you through what applies here.'))
    outro = F.concat(F.lit("This falls under our "), human(top_route),
                     F.lit(" process. Would you like me to proceed with the next step, or do you have any questions?"))
    return F.when(F.size(evidence) > 0, F.array_join(F.concat(F.array(greeting, intro), lines, F.array(outro)), "\n"))


def ensure_citations(text: Column, chunk_ids: Column) -> Column:
    cited = F.exists(chunk_ids, lambda c: text.contains(F.concat(F.lit("["), c, F.lit("]"))))
    refs = F.array_join(F.transform(F.slice(chunk_ids, 1, 2), lambda c: F.concat(F.lit("["), c, F.lit("]"))), ", ")
    return F.when(cited | (F.size(chunk_ids) == 0), text).otherwise(F.concat(text, F.lit("\n\nReferences: "), refs))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.filter(plain_tokens(text), lambda t: F.length(t) > 2))


def too_similar_to_prior(candidate: Column, prior: Column, threshold: float = 0.82) -> Column:
    """Does the candidate repeat one of the prior messages (array)?"""
    from .text import word_ngrams

    limit = max(0.5, min(0.99, threshold))

    def features(t: Column) -> Column:
        return let(plain_tokens(t), lambda w: F.struct(
            F.array_distinct(F.filter(w, lambda x: F.length(x) > 2)).alias("terms"), word_ngrams(w, 4).alias("grams")))

    def share(a: Column, b: Column) -> Column:
        return F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b)).cast("double")

    def check(c: Column) -> Column:
        return (F.size(c["terms"]) >= 8) & F.exists(F.transform(prior, features), lambda p: (
            ((F.size(p["terms"]) >= 8) & (share(c["terms"], p["terms"]) >= limit))
            | ((F.size(c["grams"]) > 0) & (F.size(p["grams"]) > 0) & (share(c["grams"], p["grams"]) >= 0.55))))

    return let(features(candidate), check)


def too_similar_to_evidence(candidate: Column, texts: Column) -> Column:
    def check(c: Column) -> Column:
        return (F.size(c) >= 10) & F.exists(F.transform(texts, _terms), lambda e: (F.size(e) >= 10) & (
            F.size(F.array_intersect(c, e)) / F.greatest(F.size(c), F.size(e)).cast("double") >= 0.90))

    return let(_terms(candidate), check)


def passes_generation_checks(candidate: Column, prior: Column, texts: Column) -> Column:
    return (
        (F.length(F.coalesce(candidate, F.lit(""))) >= 24)
        & ~too_similar_to_prior(candidate, prior) & ~too_similar_to_evidence(candidate, texts))


def style_directive(text: Column, preferred_tone: Column, channel: Column, account_tier: Column) -> Column:
    """Struct of tone, channel, length limit and directive text."""
    tone_in = F.lower(F.trim(F.coalesce(preferred_tone, F.lit(""))))
    ch_in = F.lower(F.trim(F.coalesce(channel, F.lit(""))))
    tier = F.lower(F.trim(F.coalesce(account_tier, F.lit(""))))
    issue = F.array_join(plain_tokens(text), " ")
    tone = (
        F.when(tone_in.isin(V.PREFERRED_TONES), tone_in).when(contains_any(issue, V.UPSET_TERMS), "empathetic")
        .when(tier.isin(V.PREMIUM_TIERS), "professional").otherwise("friendly"))
    limits = F.create_map(*[F.lit(x) for c, (n, _) in V.CHANNEL_STYLE.items() for x in (c, n)])
    formats = F.create_map(*[F.lit(x) for c, (_, f) in V.CHANNEL_STYLE.items() for x in (c, f)])
    shown = F.when(ch_in != "", ch_in).otherwise("chat")
    default_limit, default_format = V.CHANNEL_STYLE["chat"]
    text_out = F.concat(
        F.lit("Use a "), tone, F.lit(" tone optimized for "), shown, F.lit(". "),
        F.coalesce(formats[ch_in], F.lit(default_format)),
        F.lit(" Acknowledge the customer issue directly and provide concrete actions."))
    return F.struct(tone.alias("tone"), shown.alias("channel"),
                    F.coalesce(limits[ch_in], F.lit(default_limit)).alias("max_length"), text_out.alias("directive"))


def request_cost(draft: Column, backend: Column) -> Column:
    words = F.size(F.filter(F.split(squeeze(draft), " "), lambda w: w != ""))
    return F.when(draft.isNotNull() & (backend == "ollama"), words * TOKEN_COST).otherwise(0.0) + F.lit(INFRA_COST)
