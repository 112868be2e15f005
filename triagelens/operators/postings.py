"""Positional postings of stemmed terms and a search ranked by cover density.

A chunk matches a request if it holds all of the request's terms, stop words aside. Its score is
the sum over minimal covers - stretches that hold every term and no shorter such stretch - of 0.1
divided by one plus the number of other words in the stretch. Positions count all words of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tokens as TK
from ..functions.stems import STOP_WORDS, is_stop, stem, stem_word
from ..session import shuffle_width, stage, work_path
from . import terms as TM
from .retrieval import top_k

WEIGHT = 0.1
POSTINGS = "tenant_id string, section string, chunk_id string, term string, positions array<int>"
#: Distinct tokens whose stems a task remembers.
STEMS = 1 << 18


def stem_dictionary(tokens: DataFrame) -> DataFrame:
    """(token, term) for each distinct token that is no stop word; every token is stemmed once."""
    return tokens.select("token").distinct().where(~is_stop(F.col("token"))).withColumn("term", stem(F.col("token")))


def _term_positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``POSTINGS`` of the chunks of each part, sorted by tenant, term and chunk."""
    known: dict[str, str | None] = {}

    def term(word: str) -> str | None:
        if word not in known:
            known[word] = stem_word(word)
        return known[word]

    for part in TK.parts(batches, "text"):
        if len(known) > STEMS or not known:
            known.clear()
            known.update(dict.fromkeys(STOP_WORDS))
        rows, position, token, words = TK.tokens_of(part.column("text"))
        names = [term(w) for w in words.to_pylist()]
        terms = sorted({t for t in names if t is not None})
        number = {t: i for i, t in enumerate(terms)}
        at = np.array([number.get(t, -1) for t in names], np.int64)[token]
        rows, position, at = rows[at >= 0], position[at >= 0], at[at >= 0]
        ids = part.select(["tenant_id", "section", "chunk_id"])
        order = pc.sort_indices(ids, [("tenant_id", "ascending"), ("chunk_id", "ascending")]).to_numpy()
        tenants = ids.column("tenant_id").dictionary_encode()
        rank = pc.rank(tenants.dictionary, tiebreaker="dense").to_numpy().astype(np.int64)
        tenant = np.append(rank, 0)[tenants.indices.fill_null(len(rank)).to_numpy()]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        key = (tenant[rows] * len(terms) + at) * len(order) + place[rows]
        # stable: places of a term in a chunk stay in their order
        by_key = np.argsort(key, kind="stable")
        key = key[by_key]
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        of = by_key[heads]
        lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(key)), pa.int32()), pa.array(position[by_key], pa.int32()))
        owner = pa.array(rows[of])
        yield pa.RecordBatch.from_arrays(
            [*(ids.column(c).take(owner) for c in ids.schema.names), pa.array(terms, pa.string()).take(pa.array(at[of])), lists],
            ["tenant_id", "section", "chunk_id", "term", "positions"])


def build_postings(chunks: DataFrame, path: str | None = None) -> DataFrame:
    """Store (tenant_id, section, chunk_id, term, positions) of every chunk, in stretches sorted by tenant and term.

    ``chunk_id`` is unique. A narrow step: words, stems and positions come from a text where it is read, and no word is
    shuffled. Each stretch of some megabytes of text is sorted for itself, so a page of the stored table holds few terms
    and a search that names terms can skip most of it. ``path`` defaults to a new folder below the shared one;
    ``open_postings`` reads it again.
    """
    spark = chunks.sparkSession
    path = path or work_path(spark, "postings")
    texts = chunks.select("tenant_id", "section", "chunk_id", TK.lowered(F.col("text_content")).alias("text"))
    texts.mapInArrow(_term_positions, POSTINGS).write.mode("overwrite").parquet(path)
    return open_postings(spark, path)


def open_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POSTINGS).parquet(path)


def request_terms(requests: DataFrame) -> DataFrame:
    """(request_id, tenant_id, scope, term): the distinct stems a request asks for."""
    tokens = TM.request_tokens(requests, "token")
    return tokens.join(stem_dictionary(tokens), "token").select("request_id", "tenant_id", "scope", "term").distinct()


def cover_density(occurrences: Column, n: Column) -> Column:
    """Score of (pos, term number) pairs in the order of pos, for ``n`` terms.

    For each term the last place so far is kept; the least of these starts a cover when it has
    moved since the cover before.
    """
    place = "struct<pos:int,i:int>"
    start = F.struct(
        F.array_repeat(F.struct(F.lit(-1).alias("pos"), F.lit(-1).alias("i")), n).alias("last"),
        F.lit(-1).alias("from"), F.lit(0).alias("i"), F.lit(0.0).alias("score"))

    def step(s: Column, o: Column) -> Column:
        here = F.struct(o["pos"].alias("pos"), s["i"].alias("i")).cast(place)
        last = F.transform(s["last"], lambda x, t: F.when(t == o["term"], here).otherwise(x.cast(place)))
        least = F.array_min(last)
        fresh = least["pos"] > s["from"]
        noise = (o["pos"] - least["pos"]) - (s["i"] - least["i"])
        return F.struct(
            last.alias("last"), F.when(fresh, least["pos"]).otherwise(s["from"]).alias("from"), (s["i"] + 1).alias("i"),
            (s["score"] + F.when(fresh, F.lit(WEIGHT) / (noise + 1)).otherwise(0.0)).alias("score"))

    return F.aggregate(occurrences, start, step)["score"]


def cover_matches(requests: DataFrame, postings: DataFrame) -> DataFrame:
    """(request_id, chunk_id, cover_score) of all chunks of the scope that hold every term.

    Positions are read only for the candidates of ``terms.candidates``.
    """
    hits = TM.hits(stage(request_terms(requests), "request-terms"), postings, "positions")
    # few bytes and much work a match: left to their size they would be dealt to one task
    dealt = hits.repartition(shuffle_width(postings.sparkSession), "request_id", "chunk_id")
    lists = dealt.groupBy("request_id", "chunk_id", "n_terms").agg(F.collect_list("positions").alias("lists")).where(F.size("lists") == F.col("n_terms"))
    pairs = F.flatten(F.transform("lists", lambda x, t: F.transform(x, lambda p: F.struct(p.alias("pos"), t.alias("term")))))
    score = cover_density(F.array_sort(pairs), F.col("n_terms").cast("int"))
    return lists.select("request_id", "chunk_id", F.round(score, 9).alias("cover_score"))


def cover_search(requests: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of ``cover_matches`` for each request."""
    return top_k(cover_matches(requests, postings), k, "cover_score")
