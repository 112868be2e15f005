"""Conversation sources -> pairs -> deduplicated retrieval, style and intent sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import corpus as K

_PAIR = ["source", "customer_text", "agent_text", "tone", "channel", "tags"]


def build_corpus(
    pair_sets: list[DataFrame], order: list[str], tenant_id: str, as_of: str,
    intents: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Frames for the three outputs.

    Sources keep their given order: pairs of an earlier source win over equal
    pairs of a later one.
    """
    tagged = [p.select(F.lit(i).alias("src_no"), *order, *_PAIR) for i, p in enumerate(pair_sets)]
    pairs = reduce(lambda a, b: a.unionByName(b), tagged)
    total = ["src_no", *order]
    deduped = K.numbered(K.dedupe_pairs(pairs, total), total)
    out = {
        "pairs": deduped,
        "style": deduped.select("seq", *_PAIR),
        "chunks": K.retrieval_chunks(deduped, tenant_id, as_of),
    }
    if intents is not None:
        out["intents"] = intents
    return out
