"""Each operator against a plain version, on rows with nulls, ties, copies, long and empty texts and clashing columns."""

from __future__ import annotations

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from tests.llm import brute as B
from triagelens.llm import debruijn, decontaminate, langid, lookup, packing, repair, simhash, suffixes, warc, weighted
from triagelens.llm.common import keyed, tokenizer_path
from triagelens.llm.graph import components
from triagelens.llm.repeats import Shape

CLASH = "key long, marks string, row int, bucket int, fp long"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"


def words(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(n))


def corpus():
    rng = random.Random(5)
    passage = words(rng, 60) + " é ñ 漢字"
    texts = [None, "", " \n\t ", "Ein", "one two", passage, f"{words(rng, 30)} {passage} {words(rng, 10)}", f"{passage}\n{words(rng, 5)}{passage}"]
    texts += [words(rng, n) for n in (1, 3, 19, 20, 21, 200, 9000)]
    texts += [texts[6].upper(), texts[6], texts[6], "x " * 150, "é" * 130, texts[11] + " tail"]
    rows = [(k * 3 - 5, t) for k, t in enumerate(texts)]
    return rows + [(None, texts[6]), (None, None), (4, "again"), (4, "again"), (4, passage)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    return rows, frame(spark, rows).cache()


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), 1, "m", 2, 3, 4) for d, t in rows], SCHEMA).repartition(3)


def unique(rows):
    seen = {}
    for d, t in rows:
        if d is not None:
            seen.setdefault(d, t)
    return list(seen.items())


def ids_of(text, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_repair_round_trip(docs, spark):
    rows, df = docs
    shards = repair.write_shards(df, tokenizer_path(), 0, shard_ids=900)
    want, start = [], 0
    for d, t in B.ordered(rows):
        ids = ids_of(t, 0)
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert as_rows(repair.read_documents(shards)) == sorted(want, key=repr)
    longest = max(shards.collect(), key=lambda r: r["n_ids"])
    shard = repair.Shard(bytes(longest["payload"]))
    ids, bounds = shard.expand_all()
    assert len(shard.symbols) < len(ids)
    for doc in range(len(bounds) - 1):
        own = ids[bounds[doc] : bounds[doc + 1]]
        for k in {0, len(own) // 2, len(own) - 1}:
            assert shard.token_at(doc, k) == own[k]


def test_repair_replaces_overlapping_pairs():
    ids = np.array([7] * 101 + [1, 2] * 50 + [9], np.uint32)
    bounds = np.array([0, 101, 101, 202])
    shard = repair.Shard(repair.pack(ids, bounds, 60_000, least=4))
    out, at = shard.expand_all()
    assert out.tolist() == ids.tolist() and at.tolist() == bounds.tolist() and len(shard.symbols) < 80


def test_packing_covers_every_id(docs):
    rows, df = docs
    pieces = packing.pack_documents(df, tokenizer_path(), 1).collect()
    want = sorted((d is not None, d or 0, ids_of(t, 1).tobytes()) for d, t in rows)
    whole = [p for p in pieces if p.length == p.doc_tokens]
    assert sum(p.length for p in pieces) == sum(len(w[2]) // 4 for w in want) and whole
    bins: dict = {}
    for p in pieces:
        bins.setdefault(p.sequence_id, []).append(p)
    for own in bins.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    assert all(n & (n - 1) == 0 or n > 1980 for n in (sum(p.length for p in own) for own in bins.values()))
    text = {d: ids_of(t, 1) for d, t in unique([r for r in rows if r[0] != 4])}
    for p in pieces:
        if p.doc_id in text:
            assert zlib.crc32(text[p.doc_id][p.start : p.start + p.length].tobytes()) == p.ids_crc32


def test_weighted_sampling(docs):
    rows, df = docs
    got = sorted(weighted.edited_fingerprints(df, 64).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.n_chars))
    texts = B.ordered(rows)
    want = []
    for k, (d, t) in enumerate(texts):
        n = len(t) // 4
        new = t[: len(t) - n] + texts[(k + 1) % len(texts)][1][:n]
        want.append((d, len(t), hashlib.sha256(new.encode()).hexdigest(), B.jaccard(t, new) if t.split() or new.split() else 1.0))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == sorted((w[:3] for w in want), key=repr)
    near = {w[2]: w[3] for w in want}
    assert abs(np.mean([r.near_edited - near[r.edited_sha256] for r in got])) < 0.06
    same = {r.fingerprint for r in got if r.n_chars == len(corpus()[6][1]) and r.doc_id in (13, 43, 46)}
    assert len(same) <= 2


def test_lookup_placement(spark, docs):
    names = lookup.shard_names(7)
    owner = lookup.fill(names, 251)
    counts = np.bincount(owner)
    assert counts.max() - counts.min() <= 1
    # a plain version: whole permutations, turn by turn
    plain, taken = [-1] * 251, 0
    orders = []
    for n in names:
        h = hashlib.sha256(n.encode()).digest()
        a, s = int.from_bytes(h[:8], "little") % 251, int.from_bytes(h[8:16], "little") % 250 + 1
        orders.append([(a + j * s) % 251 for j in range(251)])
    while taken < 251:
        for k, order in enumerate(orders):
            if taken < 251:
                plain[next(s for s in order if plain[s] < 0)] = k
                taken += 1
    assert owner == plain
    rows, df = docs
    got = lookup.place(df.withColumnRenamed("source", "shard"), "doc_id", names, 251).collect()
    assert len(got) == len(rows)
    for r in got:
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % 251
        assert (r.slot, r.shard) == (slot, names[owner[slot]])
    with pytest.raises(ValueError):
        lookup.fill(names, 250)


@pytest.mark.parametrize("length", [3, 20])
def test_word_spans(docs, length):
    rows, df = docs
    got = as_rows(debruijn.repeated_words(df, length).drop("kept"))
    assert got == sorted(B.words_digest(rows, length), key=repr)


@pytest.mark.parametrize("length", [7, 100])
def test_byte_suffixes(docs, length):
    rows, df = docs
    got = as_rows(suffixes.repeated_bytes(df, length).drop("spans"))
    assert got == sorted(B.bytes_digest(rows, length), key=repr)


def test_cut_texts_stay_valid(docs):
    rows, df = docs
    out = suffixes.without_repeats(df)
    assert out.columns == df.columns and out.count() == len(rows)
    assert out.where("text is null").count() == sum(t is None for _, t in rows)
    assert out.where("n_chars <> length(text)").count() == 0


def test_simhash_components(docs):
    rows, df = docs
    assert as_rows(simhash.near_duplicates(df)) == sorted(B.components(rows), key=repr)


def test_forest_of_a_long_list():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 24, 6000, dtype=np.uint64) << np.uint64(8)
    fps = np.unique(np.concatenate([base, base ^ np.uint64(1 << 9), base ^ np.uint64(7 << 20)]))
    links = {frozenset(x) for x in simhash.split_forest(fps, 3, (4, 5, 6))}
    root = list(range(len(fps)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a, b in (tuple(x) for x in links):
        assert (int(fps[a]) ^ int(fps[b])).bit_count() <= 3
        root[find(a)] = find(b)
    for k in range(0, len(fps), 97):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[k]) <= 3).tolist():
            assert find(j) == find(k)


def test_similar_texts_keep_one(spark):
    rng = random.Random(8)
    base = words(rng, 300).split()
    near = [*base]
    near[100] = "changed"
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, words(rng, 300)), (4, " ".join(base).upper()), (5, None), (6, ""), (7, "a b"), (8, "a b")]
    kept = simhash.first_of_each(frame(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 6, 7] and len(kept.columns) == 10


def shingle_classes(rows):
    """First id of each class of texts by all pairs."""
    sets = {d: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for d, t in rows if (w := (t or "").lower().split())}
    root = {d: d for d in sets}
    for d in sets:
        for e in sets:
            if d < e and root[d] != root[e] and 5 * len(sets[d] & sets[e]) >= 4 * len(sets[d] | sets[e]):
                low, high = sorted((root[d], root[e]))
                root = {k: low if r == high else r for k, r in root.items()}
    return sorted({*root.values()} | {d for d, _ in rows if d not in root})


def test_extended_truncated_and_repetitive_texts(spark):
    rng = random.Random(11)
    rows = []
    for k in range(0, 240, 4):
        base = words(rng, rng.randint(5, 400), "abcdefghijk").split()
        if k % 3 == 0:
            base = rng.choices(base[: max(4, len(base) // 5)], k=len(base))
        some = len(base) // rng.randint(5, 12)
        edited = [*base]
        for at in rng.sample(range(len(base)), len(base) // 60):
            edited[at] = "new"
        rows += [(k, base), (k + 1, base + words(rng, some, "lmnopq").split()), (k + 2, base[: len(base) - some]), (k + 3, edited)]
    line = words(rng, 30).split()
    rows += [(500 + k, line + words(rng, 12).split()) for k in range(60)]
    rows = [(d, " ".join(w)) for d, w in rows] + [(600, None), (601, "")]
    want = shingle_classes(rows)
    assert 60 < len(want) < 240
    assert sorted(r.doc_id for r in simhash.first_of_each(frame(spark, rows)).collect()) == want


def test_families_of_one_vocabulary(spark):
    rng = random.Random(12)
    base = words(rng, 200).split()
    rows = [(1, base)]
    for k in range(1, 20):
        own = rng.sample(base, len(base))
        rows += [(2 * k, own), (2 * k + 1, [*own, own[7]])]
    rows = [(d, " ".join(w)) for d, w in rows]
    want = [1, *range(2, 40, 2)]
    assert shingle_classes(rows) == want
    assert sorted(r.doc_id for r in simhash.first_of_each(frame(spark, rows)).collect()) == want


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 600)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(100, 161)} | {k: 500 for k in range(500, 600)}


def test_warc_round_trip(spark):
    rng = random.Random(2)
    big, other = f"<p>{words(rng, 300)}</p>", f"<p>é{words(rng, 400)}</p>"
    pages = [(1, "http://a/é\r\nx", big), (2, None, big), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", other), (None, "u", big), (7, "u", other), (7, "u", other)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    got = as_rows(warc.archive(df).drop("url", "payload"))
    last = {big: 2, other: 7}
    want = []
    for i, _, h in pages:
        raw = (h or "").encode()
        revisit = len(raw) >= 1000 and last[h] != i
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", last[h] if revisit else None))
    assert got == sorted(want, key=repr)
    assert warc.archive(df.limit(0)).count() == 0


def test_warc_archive_layout():
    import zstandard

    records = [warc.record(k, "u", f"<p>{k} {'body ' * 50}</p>".encode(), None) for k in range(40)]
    data = warc.build_dictionary(records)
    frame = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(data)).compress
    archive = warc.dictionary_frame(data) + warc.GAP + warc.GAP.join(map(frame, records)) + warc.GAP
    assert struct.unpack("<I", archive[:4])[0] == 0x184D2A5D
    assert list(warc.frames(archive)) == records


def test_copies_of_a_text_teach_once(spark):
    words = {"aa": ["house", "thing", "where", "bright"], "bb": ["maison", "chose", "quelle", "brillant"]}
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choices(w, k=12)), lang) for lang, w in words.items() for k in range(60)]
    copies = [(1000 + k, "house thing where bright house", "aa") for k in range(3000)]
    df = spark.createDataFrame(rows + copies, "doc_id long, text string, lang string")
    # all distinct texts fit the sample and its limit, the copies as rows would not
    got = langid.predict(df, langid.train(df, 200)).where("doc_id < 1000").collect()
    assert len(got) == 120 and all(r.lang_pred == r.lang for r in got)


def test_language_codes(spark):
    rng = random.Random(4)
    made = {"xx": "abcde", "yy": "fghij", "zz": "klmno", "ww": "pqrst", "vv": "uvwxyz"}
    rows = [(k, words(rng, 30, made[lang]), lang) for k, lang in enumerate(list(made) * 60)]
    df = spark.createDataFrame([*rows, (900, None, "xx"), (901, "12 !?", "yy"), (902, "abc abd", None)], "doc_id long, text string, lang string")
    model = langid.train(df.where("doc_id % 3 > 0"))
    got = {r.doc_id: r for r in langid.predict(df.withColumn("score", df.doc_id), model).collect()}
    assert all(got[d].lang_pred == lang for d, _, lang in rows)
    assert [got[d].lang_pred for d in (900, 901, 902)] == ["und", "und", "xx"]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[901].ambiguous
    none = langid.train(df.where("lang is null"))
    assert {r.lang_pred for r in langid.predict(df, none).collect()} == {"und"}
    codes = langid.codewords(12)
    assert len({tuple(c) for c in codes}) == 12 and all(len(set(c)) == 2 for c in codes.T)


@pytest.mark.parametrize("n", range(1, 41))
def test_codewords_of_any_number_of_labels(n):
    codes = langid.codewords(n)
    assert codes.shape[0] == n and len({tuple(c) for c in codes}) == n
    assert len({tuple(c * c[0]) for c in codes.T}) == codes.shape[1] and all(len(set(c)) == 2 for c in codes.T)


def edit_distance_anywhere(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        now = [i]
        for j, x in enumerate(text, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (c != x)))
        row = now
    return min(row)


def test_decontamination_finds_edited_windows(spark):
    rng = random.Random(6)
    items = [(k, words(rng, n)) for k, n in enumerate((12, 25, 60))] + [(9, None), (10, "tiny")]
    docs = []
    for k in range(60):
        text = words(rng, 80)
        if k % 2:
            passage = list(items[k % 3][1])
            for _ in range(k % 9):
                at = rng.randrange(len(passage))
                passage[at : at + rng.randint(0, 1)] = rng.choice("XYZ")
            text = f"{text} {''.join(passage)} {words(rng, 20)}"
        docs.append((k, text))
    docs += [(100, None), (101, ""), (None, items[0][1].upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = frame(spark, docs)
    want = set()
    for d, t in docs:
        for i, x in items:
            if t and x and len(x) >= decontaminate.Q:
                low = t.lower().encode()
                if any(edit_distance_anywhere(w, low) <= decontaminate.edits_of(len(w)) for w in decontaminate.item_windows(x)):
                    want.add((d, i))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench).collect()}
    assert got == want
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_decontamination_finds_stretches_at_any_byte(spark):
    rng = random.Random(7)
    items = [(1, words(rng, 70)), (2, words(rng, 40)), (3, words(rng, 6))]
    docs = [(500 + k, words(rng, 12)) for k in range(10)]
    for k in range(60):
        whole = items[k % 2][1]
        start, size = rng.randrange(len(whole) - 150), rng.choice((96, 99, 100, 104, 130, 149))
        passage = list(whole[start : start + size])
        for _ in range(k % 7):
            at = rng.randrange(len(passage))
            passage[at : at + rng.randint(0, 1)] = rng.choice("XYZ")
        docs.append((k, ["", words(rng, 5)][k % 5 > 0] + "".join(passage) + ["", words(rng, 5)][k % 4 > 0]))
    docs += [(1000, items[0][1][10:140]), (1001, items[2][1])]

    def least(x, t):
        x, t = x.lower().encode(), t.lower().encode()
        m = min(len(x), decontaminate.WINDOW)
        width = range(len(t) + 1)
        row = np.zeros((len(x) - m + 1, len(t) + 1), int)  # every stretch at once, all diagonals
        for i in range(m):
            c = np.frombuffer(x, np.uint8)[i : i + len(row), None] != np.frombuffer(t, np.uint8)
            now = np.concatenate([row[:, :1] + 1, np.minimum(row[:, 1:] + 1, row[:, :-1] + c)], 1)
            row = np.minimum.accumulate(now - width, axis=1) + width
        return int(row.min()), decontaminate.edits_of(m)

    want = {(d, i): e for d, t in docs for i, x in items for e, most in [least(x, t)] if e <= most}
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.contaminated(frame(spark, docs), bench).collect()}
    assert got == want and (1000, 1) in want and 20 < len(want) < 60


def test_empty_tables(spark, docs):
    _, df = docs
    none = df.limit(0)
    for made in (
        repair.read_documents(repair.write_shards(none, tokenizer_path())), packing.pack_documents(none, tokenizer_path()),
        weighted.edited_fingerprints(none), debruijn.repeated_words(none), suffixes.repeated_bytes(none), suffixes.without_repeats(none),
        simhash.near_duplicates(none), simhash.first_of_each(none), langid.predict(none, langid.train(none)), lookup.place(none, "doc_id", ["a"], 7),
        decontaminate.contaminated(none, none.selectExpr("doc_id as item_id", "text")), keyed(none),
    ):
        assert made.count() == 0


def test_shape_of_short_windows():
    assert suffixes.shape_of(1) == Shape(1, (1,), False)


def test_pairs_are_told_apart_as_by_unique():
    rng = np.random.default_rng(3)
    for top, n in ((1, 5), (300, 5000), (65536, 40000), (1 << 24, 3000), (5, 0), (1 << 23, 1)):
        code = rng.integers(0, top, n) << 24 | rng.integers(0, top, n)
        for got, want in zip(repair.distinct(code), np.unique(code, return_inverse=True, return_counts=True)):
            assert np.array_equal(got, want)
