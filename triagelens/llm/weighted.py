"""Document fingerprints by consistent weighted sampling, in DataFrame functions alone.

A text is the multiset of its words. For each word and each of ``samples`` draws, two gamma(2, 1)
variables r and c and a uniform b follow from hashes of the word; with weight w,
``t = floor(ln w / r + b)``, ``ln y = r (t - b)`` and ``ln a = ln c - ln y - r``. The word and
step t of the least ln a are the draw. Two texts agree in a draw with a probability equal to
their generalised Jaccard similarity, sum of least over sum of greatest counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelens.llm.common import buckets_by_id, read, spread_width, stage

SAMPLES = 32
WORD_GAP = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """``body`` of ``value``, evaluated once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), 0)


def term_counts(text: Column) -> Column:
    """array<struct<h, n>>: hash and count of each distinct word; empty without words."""
    hashes = F.sort_array(F.transform(F.filter(F.split(text, WORD_GAP), lambda w: w != ""), lambda w: F.xxhash64(w)))

    def counted(h: Column) -> Column:
        # in the sorted hashes, runs end where the next differs
        places = F.when(F.size(h) > 0, F.sequence(F.lit(0), F.size(h) - 1)).otherwise(F.array().cast("array<int>"))
        last = F.filter(places, lambda i: F.get(h, i + 1).isNull() | (F.get(h, i + 1) != F.get(h, i)))
        return let(last, lambda e: F.transform(
            e, lambda at, j: F.struct(F.get(h, at).alias("h"), (at - F.coalesce(F.get(e, j - 1), F.lit(-1))).alias("n"))
        ))

    return let(hashes, counted)


def unit(bits: Column, shift: int, width: int) -> Column:
    """A number within (0, 1) from ``width`` bits."""
    part = F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1))
    return (part + F.lit(0.5)) / F.lit(float(1 << width))


def draw(word: Column, log_weight: Column, number: int) -> Column:
    """ln a in the upper bits and the draw (word and step) in the lower 32, so that the least long decides."""
    first, second = F.xxhash64(word, F.lit(2 * number)), F.xxhash64(word, F.lit(2 * number + 1))
    r = -F.log(unit(first, 0, 21) * unit(first, 21, 21))
    b = unit(first, 42, 22)
    c = -F.log(unit(second, 0, 32) * unit(second, 32, 32))
    t = F.floor(log_weight / r + b)
    log_a = F.log(c) - r * (t - b) - r
    order = F.floor((log_a + F.lit(200.0)) * F.lit(float(1 << 22))).cast("long")
    return F.shiftleft(order, 32).bitwiseOR(F.xxhash64(word, t).bitwiseAND(F.lit((1 << 32) - 1)))


def signatures(texts: DataFrame, names: list[str], samples: int = SAMPLES) -> DataFrame:
    """``names`` and ``draws`` (array<int>) of each row of ``texts`` (names, terms); rows are told apart by ``names``.

    Without words every draw is null.
    """
    words = texts.select(*names, F.explode_outer("terms").alias("term"))
    words = words.select(*names, F.col("term.h").alias("h"), F.log(F.col("term.n").cast("double")).alias("log_n"))
    mins = [F.min(draw(F.col("h"), F.col("log_n"), k)).alias(f"m{k}") for k in range(samples)]
    low = [F.col(f"m{k}").bitwiseAND(F.lit((1 << 32) - 1)) for k in range(samples)]
    # kept as signed 32-bit numbers
    return words.groupBy(*names).agg(*mins).select(*names, F.array(*[(x - F.when(x >= 1 << 31, F.lit(1 << 32)).otherwise(F.lit(0))).cast("int") for x in low]).alias("draws"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal draws; two texts without words are alike."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y).cast("int")), F.lit(0), lambda n, x: n + x) / F.size(a)


def as_text(draws: Column) -> Column:
    """Eight hex digits a draw; without words all f."""
    return F.array_join(F.transform(draws, lambda x: F.lpad(F.lower(F.hex(F.coalesce(x, F.lit(-1)).cast("long").bitwiseAND(F.lit((1 << 32) - 1)))), 8, "0")), "")


def with_next(docs: DataFrame) -> DataFrame:
    """(key, next_key, doc_id, text, next_text): each row with the one after it by doc_id, then text; after the last comes the first.

    Rows are dealt to ranges of doc_id; the first of a range is also put, as a guard, at the end
    of the range before. Null doc_ids come first, null texts are empty.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    column, n = buckets_by_id(docs, 3 * spread_width(docs.sparkSession))
    docs = docs.withColumn("bucket", column.cast("long"))
    firsts = docs.groupBy("bucket").agg(F.min("doc_id").alias("least"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).collect()
    if not firsts:
        return docs.select(F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("next_key"), "doc_id", "text", F.col("text").alias("next_text"))
    order = sorted(r["bucket"] for r in firsts)
    before = {b: order[k - 1] for k, b in enumerate(order)}
    # with null ids, the first row of all is one of those
    leads = [r["least"] for r in firsts if r["least"] is not None and not r["nulls"]]
    first = F.coalesce(F.array_contains(F.lit(leads), F.col("doc_id")), F.lit(False)) if leads else F.lit(False)
    if any(r["nulls"] for r in firsts):
        first = first | F.col("doc_id").isNull()
    to = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("bucket"))
    places = F.when(first, F.array(F.struct(F.col("bucket").alias("at"), F.lit(False).alias("guard")), F.struct(to.alias("at"), F.lit(True).alias("guard"))))
    places = places.otherwise(F.array(F.struct(F.col("bucket").alias("at"), F.lit(False).alias("guard"))))
    dealt = docs.select("doc_id", "text", "bucket", F.explode(places).alias("p")).select("doc_id", "text", "bucket", "p.at", "p.guard")
    # the guard of the first range stands last in the last
    w = Window.partitionBy("at").orderBy("guard", F.col("doc_id").asc_nulls_first(), "text")
    lead = F.lead(F.struct("text", "guard", "bucket")).over(w).alias("next")
    seen = dealt.select("doc_id", "text", "at", "guard", F.row_number().over(w).alias("nth"), lead).where("not guard")
    key = F.shiftleft("at", 40) + F.col("nth")
    next_key = F.when(F.col("next.guard"), F.shiftleft("next.bucket", 40) + 1).otherwise(key + 1)
    return seen.select(key.alias("key"), next_key.alias("next_key"), "doc_id", "text", F.col("next.text").alias("next_text"))


def edited(text: Column, following: Column) -> Column:
    """The last quarter of the code points replaced by the first as many of ``following``."""
    n = F.length(text)
    k = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - k), F.substring(following, F.lit(1), k))


def edited_fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of each text of ``docs`` and of its edited text, and their likeness.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. A
    null text is empty; repeated rows each count; other columns are ignored; an empty table
    gives no rows.
    """
    both = with_next(docs).withColumn("new", edited(F.col("text"), F.col("next_text")))
    meta = ["key", "next_key", "doc_id", "n_chars", "sha"]
    both = both.select(
        "key", "next_key", "doc_id", F.length("text").cast("long").alias("n_chars"), F.unhex(F.sha2("new", 256)).alias("sha"),
        F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), F.col("new").alias("t")))).alias("x"),
    )
    texts = both.select(*meta, F.col("x.which").alias("which"), term_counts(F.col("x.t")).alias("terms"))
    drawn = stage(signatures(texts, [*meta, "which"], samples), "weighted")
    own = drawn.where("which = 0")
    new = drawn.where("which = 1").select("key", F.col("draws").alias("new"))
    after = own.select(F.col("key").alias("next_key"), F.col("draws").alias("following"))
    joined = own.join(new, "key").join(after, "next_key")
    return joined.select(
        "doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), as_text(F.col("draws")).alias("fingerprint"), as_text(F.col("new")).alias("edited_fingerprint"),
        likeness(F.col("draws"), F.col("new")).alias("near_edited"), likeness(F.col("draws"), F.col("following")).alias("near_next"),
    )


def op2_weighted_sampling(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(read(spark, sf_dir, "documents"))
