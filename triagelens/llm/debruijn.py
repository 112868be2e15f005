"""Repeated word spans by de Bruijn compaction.

A window of ``length`` words is an edge of the de Bruijn graph of the corpus, from its first to
its last ``length - 1`` words. Edges that share their anchor (the least hashed word gram) and
follow each other in a document are compacted to one path before anything is shuffled. Spark
then brings paths together by anchor: a path that is alone or never branches stays compact; at
branches the first occurrence of each path is taken apart into its edges, which meet in a second
shuffle. Document and start carried by every row say which occurrence is the first; equality
rests on pairs of 64-bit hashes, texts are not compared. See ``repeats`` for the two shuffles.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame

from triagelens.llm.common import keyed, map_batches, read
from triagelens.llm.repeats import Shape, covered, with_marks
from triagelens.llm.rolling import chunked, bytes_of, word_spans

LENGTH = 20


def shape_of(length: int) -> Shape:
    return Shape(length, tuple(sorted({max(1, length // 4), max(1, length * 17 // 20)})), True)


def repeated_words(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (text) of each row of ``docs``.

    Words are what ASCII white space leaves; a word goes if a window of ``length`` words over it
    also starts earlier (smaller doc_id, or same document and smaller start). A null text has no
    words; rows with null or equal doc_id are ordered by text; other columns are ignored.
    """
    import pyarrow.compute as pc

    shape = shape_of(length)

    def digest(batches):
        for batch in batches:
            data, bounds = bytes_of(batch["text"])
            marks = pc.fill_null(batch["marks"], pa.scalar([], batch["marks"].type))
            for a, b in chunked(bounds, 1 << 20):
                own = bounds[a : b + 1] - bounds[a]
                part = data[bounds[a] : bounds[b]]
                upto = word_spans(part, own)[2]
                gone = covered(shape, upto, marks[a:b])
                rows = []
                for k in range(b - a):
                    words = part[own[k] : own[k + 1]].tobytes().split()
                    out = gone[upto[k] : upto[k + 1]]
                    kept = b" ".join([w for w, x in zip(words, out.tolist()) if not x] if out.any() else words)
                    rows.append((batch["doc_id"][a + k].as_py(), len(words), int(out.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
                yield pa.RecordBatch.from_arrays([
                    pa.array(v, t) for v, t in zip(zip(*rows), [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()])
                ], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    marked = with_marks(keyed(docs), shape).select("doc_id", "text", "marks")
    return map_batches(marked, digest, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def op5_debruijn_spans(spark, sf_dir: str) -> DataFrame:
    return repeated_words(read(spark, sf_dir, "documents")).drop("kept")
