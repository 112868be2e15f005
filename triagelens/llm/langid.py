"""Language identification by error-correcting output codes.

Every language has a codeword of +1 and -1; every bit of it has a binary classifier on hashed
byte n-grams (lower-cased letters, other characters as one space). A text's margins, means over
all its n-grams, are decoded to the codeword with the least loss, each bit weighted by how well
its classifier does on the training rows; a text whose best two codewords are close is flagged
as ambiguous.

Training takes a sample of labelled rows, by a hash of their text, of about ``per_label`` texts of
each language (``SAMPLE``, the documented bound); predictions read whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelens.llm.common import map_batches, read
from triagelens.llm.rolling import bytes_of, chunked

SAMPLE = 500
TABLE = 1 << 16
SIZES = (2, 3, 4)
#: Best and second-best probability closer than this: ambiguous.
MARGIN = 0.2
TURN = np.uint32(0x9E3779B1)


@dataclass
class Model:
    labels: list[str]
    codes: np.ndarray  # labels x bits, +1 and -1
    weights: np.ndarray  # n-gram slots x bits
    scale: np.ndarray  # margin to log odds, by bit
    shift: np.ndarray
    trust: np.ndarray  # weight of each bit's loss


def codewords(n: int) -> np.ndarray:
    """Exhaustive codes up to seven languages, then seeded random ones of distinct, balanced columns, as far as there are."""
    if n < 2:
        return np.ones((n, 0))
    if n <= 7:
        columns = [[1] + [1 - 2 * (k >> j & 1) for j in range(n - 1)] for k in range(1, 1 << (n - 1))]
        return np.array(columns, float).T
    rng, columns = np.random.default_rng(n), {}
    there = comb(n, n // 2) // (2 - n % 2)  # a column and its negative are one
    while len(columns) < min(there, max(31, int(12 * np.log2(n)))):
        c = rng.permutation([1] * (n // 2) + [-1] * (n - n // 2))
        columns[tuple(c * c[0])] = c * c[0]
    return np.array(list(columns.values()), float).T


def letters(texts) -> pa.Array:
    """Lower-cased letters; anything else becomes one space."""
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    return pc.binary_join_element_wise("", pc.replace_substring_regex(low, r"[^\pL\pM]+", " "), "", " ")


def slots(data: np.ndarray) -> list[np.ndarray]:
    """Table slots of the n-grams that begin at each byte, one array for each size."""
    out = []
    code = data.astype(np.uint32)
    for size in range(2, max(SIZES) + 1):
        code = (code[:-1] << np.uint32(8)) | data[size - 1 :]
        if size in SIZES:
            k = SIZES.index(size)
            out.append((((code * TURN) >> np.uint32(16)) & np.uint32(TABLE - 1)).astype(np.int64) + k * TABLE)
    return out


def margins(texts, weights: np.ndarray) -> np.ndarray:
    """Mean weight of each text's n-grams, texts x bits."""
    data, bounds = bytes_of(letters(texts))
    out = np.zeros((len(texts), weights.shape[1]), np.float32)
    for a, b in chunked(bounds, 1 << 20):
        part = data[bounds[a] : bounds[b]]
        own = bounds[a : b + 1] - bounds[a]
        total = np.zeros((len(part), weights.shape[1]), np.float32)
        for at in slots(part):
            total[: len(at)] += weights[at]
        # n-grams that reach into the next text begin in the last bytes of this one
        for k in range(1, max(SIZES)):
            ends = own[1:] - k
            total[ends[ends >= own[:-1]]] = 0
        full = np.flatnonzero(np.diff(own) >= max(SIZES))
        if len(full):
            keep = own[full]
            sums = np.add.reduceat(total, np.stack([keep, own[full + 1] - max(SIZES) + 1], 1).ravel()[: 2 * len(full)], axis=0)[::2]
            out[a + full] = sums / (np.diff(own)[full] - max(SIZES) + 1)[:, None]
    return out


def train(labelled: DataFrame, per_label: int = SAMPLE) -> Model:
    """Model from ``labelled`` (text, lang); rows with a null in either, or no letters, teach nothing."""
    rows = labelled.select("text", "lang").where("text is not null and lang is not null")
    counts = {r["lang"]: max(r["n"], 1) for r in rows.groupBy("lang").agg(F.approx_count_distinct("text").alias("n")).collect()}
    labels = sorted(counts)
    if not labels:
        return Model([], np.ones((0, 0)), np.zeros((len(SIZES) * TABLE, 0), np.float32), *(np.zeros(0) for _ in range(3)))
    chance = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, per_label / n)))])
    drawn = (F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / F.lit(float(1 << 20))) < F.element_at(chance, F.col("lang"))
    # copies of one text teach once, so a large group of them can't crowd out the rest
    sample = rows.where(drawn).dropDuplicates(["text", "lang"]).limit(2 * per_label * len(labels)).toArrow()
    texts, langs = sample["text"].combine_chunks(), np.array(sample["lang"].to_pylist())
    return fit(texts, langs, labels)


def fit(texts, langs: np.ndarray, labels: list[str]) -> Model:
    codes = codewords(len(labels))
    data, bounds = bytes_of(letters(texts))
    counts = np.zeros((len(labels), len(SIZES) * TABLE))
    owner = np.array([labels.index(x) for x in langs], np.int64)
    for a, b in chunked(bounds, 1 << 20):
        for at in slots(data[bounds[a] : bounds[b]]):
            doc = np.repeat(owner[a:b], np.diff(bounds[a : b + 1]))[: len(at)]
            for k in range(len(labels)):
                counts[k] += np.bincount(at[doc == k], minlength=counts.shape[1])
    # shares within each n-gram size, each language weighing the same
    rate = counts.reshape(len(labels), len(SIZES), TABLE)
    rate = (rate + 0.5) / (rate.sum(2, keepdims=True) + 0.5 * TABLE)
    rate = rate.reshape(len(labels), -1)
    weights = np.zeros((counts.shape[1], codes.shape[1]), np.float32)
    for b in range(codes.shape[1]):
        weights[:, b] = np.log(rate[codes[:, b] > 0].mean(0)) - np.log(rate[codes[:, b] < 0].mean(0))
    m = margins(texts, weights).astype(float)
    want = codes[owner]
    scale, shift, trust = np.ones(codes.shape[1]), np.zeros(codes.shape[1]), np.ones(codes.shape[1])
    for b in range(codes.shape[1]):
        scale[b], shift[b] = logistic(m[:, b], want[:, b] > 0)
        wrong = np.mean(np.sign(scale[b] * m[:, b] + shift[b]) != want[:, b])
        trust[b] = max(0.05, 1 - 2 * wrong)
    return Model(labels, codes, weights, scale, shift, trust)


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps with a small ridge."""
    spread = x.std() or 1.0
    z = np.stack([x / spread, np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + 0.1 * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(2), grad)
        w -= step
        if abs(step).max() < 1e-6:
            break
    return float(w[0] / spread), float(w[1])


def decode(model: Model, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best label number, its probability, and the second's, of each row of margins."""
    odds = np.clip(m * model.scale + model.shift, -30, 30)
    loss = np.stack([(np.log1p(np.exp(-odds * c)) * model.trust).sum(1) for c in model.codes], 1)
    p = np.exp(loss.min(1, keepdims=True) - loss)
    p /= p.sum(1, keepdims=True)
    order = np.argsort(-p, axis=1, kind="stable")
    rows = np.arange(len(p))
    second = p[rows, order[:, 1]] if p.shape[1] > 1 else np.zeros(len(p))
    return order[:, 0], p[rows, order[:, 0]], second


def predict(docs: DataFrame, model: Model, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1) and ``ambiguous`` (named with ``prefix``) put after its columns.

    A null text or one without letters is ``und`` with score 0. Columns of the new names are
    replaced; null and repeated rows are kept as they are. Without any learned label all is ``und``.
    """
    names = [f"{prefix}{c}" for c in ("lang_pred", "score", "ambiguous")]
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the table size and the number of bits
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    rows = docs.select(F.struct(*kept).alias("row"), F.col(f"`{text}`").alias("text"))

    def run(batches):
        own = held.value
        for batch in batches:
            # the copies of a text that its letters need are made for a few at a time
            sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False)
            for a, b in chunked(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), 1 << 18):
                texts = batch["text"][a:b]
                has = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_numpy(zero_copy_only=False)
                pred, score, second = np.full(len(texts), None, object), np.zeros(len(texts)), np.zeros(len(texts))
                if own.labels:
                    best, score, second = decode(own, margins(texts, own.weights))
                    pred = np.array(own.labels, object)[best]
                has &= pred != None  # noqa: E711
                yield pa.RecordBatch.from_arrays([
                    batch["row"][a:b], pa.array(np.where(has, pred, "und").tolist(), pa.string()), pa.array(np.where(has, score, 0.0)),
                    pa.array(~has | (score - second < MARGIN)),
                ], names=["row", "lang_pred", "score", "ambiguous"])

    schema = rows.select("row").schema.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    done = map_batches(rows, run, schema)
    return done.select("row.*", *[F.col(c).alias(n) for c, n in zip(("lang_pred", "score", "ambiguous"), names)])


def held_out() -> Column:
    """Rows that teach nothing: crc32 of the doc_id as text modulo 4 is 2 (a null doc_id is not held out)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op7_language_codes(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out())
    model = train(docs.where("not held_out"))
    return predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
