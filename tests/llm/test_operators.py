"""Small tables with nulls, empty and very long texts, ties, repeated rows and clashing columns, against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import common, components, decontamination, language_id, mixing, neighbours, ngram_join, quality, sharding, text_hash, token_counts, toxicity, url_filter
from ledgerloom.llm.common import crc_bucket

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, _id string, score double, shard int, _text string"
R = np.random.default_rng(5)
WORDS = ["".join(R.choice(list("abcdefgh"), 5)) for _ in range(400)]


def words(n):
    return list(R.choice(WORDS, n))


BASE = words(60)
EDITED = [w if i % 30 else w + "x" for i, w in enumerate(BASE)]
TEXTS = [
    None, "", " \n\t ", "one", "ONE", "one two three", " ".join(BASE), " ".join(BASE).upper(), "\n".join(EDITED), " ".join(BASE[:30]), " ".join(words(3000)),
    "é ü 漢字 " * 3, " ".join(BASE), "a  b   c ", "▁x <s> </s>", "12 34 !!", " ".join(BASE[:12] + BASE[20:]), " ".join(words(20)), " ".join(words(20)),
]


def rows():
    out = [(i, t, ["en", "de", None][i % 3], ["b", "a", None, "é"][i % 4], 1, 1, "x", 0.5, 2, "y") for i, t in enumerate(TEXTS)]
    return [*out, (None, " ".join(BASE[:59]), None, None, None, None, None, None, None, None), out[6], out[6]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(t):
    return [] if t is None else t.encode().lower().split()


def shingles(t, n=5):
    w = split(t)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


# ---------------------------------------------------------------- hashes


def test_hashes_do_not_depend_on_the_place():
    texts = [b"aa bb cc", b"", b"x" * (1 << 20), b"  bb aa", b"AA"]
    buf = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    a, b, first = text_hash.spans(buf, offsets, text_hash.NOT_SPACE)
    h = text_hash.hashes(buf, a, b)
    assert [int(x) for x in first] == [0, 3, 3, 4, 6, 7]
    assert h[0] == h[5] == h[6] and h[1] == h[4] and len(set(h.tolist())) == 4
    alone = text_hash.hashes(np.frombuffer(texts[2], np.uint8), np.array([0]), np.array([1 << 20]))
    assert alone[0] == h[3]


# ---------------------------------------------------------------- 1


def leaks(texts, items):
    def cut(t):
        return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]

    found = {}
    for d, t in texts:
        for i, u in items:
            u = cut(u)
            k, w = min(5, len(u)), cut(t)
            want = {tuple(u[j : j + k]) for j in range(len(u) - k + 1)} if u else set()
            have = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if k else set()
            if want and len(want & have) >= 0.75 * len(want):
                found[d, i] = len(want & have)
    return found


def test_decontamination(spark, docs, empty):
    items = [(0, " ".join(BASE[10:25])), (1, "One, two!"), (2, None), (3, ""), (4, " ".join(words(30))), (5, " ".join(BASE[:20] + words(8))), (5, " ".join(BASE[:20] + words(8)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    once = {i: u for i, u in items if i != 5}
    got = decontamination.find_leaks(docs, bench.where("item_id != 5")).collect()
    texts = {r[0]: r[1] for r in rows()}
    assert {(r.doc_id, r.item_id): r.n_found for r in got} == leaks(list(texts.items()), list(once.items()))
    assert any(r.doc_id is None for r in got)
    assert decontamination.find_leaks(docs, bench).count() >= len(got)
    kept = decontamination.remove_leaks(docs, bench.where("item_id != 5"))
    assert kept.columns == docs.columns and kept.count() == len(rows()) - sum((r[0], i) in leaks(list(texts.items()), list(once.items())) for r in rows() for i in (0,)) - sum(r[0] == 5 for r in rows())
    assert decontamination.find_leaks(empty, bench).count() == 0 and decontamination.find_leaks(docs, bench.limit(0)).count() == 0


def test_leaks_are_removed_row_by_row(spark):
    item = BASE[:24]
    bench = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    leak, halves = " ".join(["x", *item, "y"]), [" ".join(item[:14]), " ".join(item[10:])]
    clean = [" ".join(words(30)) for _ in range(4)]
    data = [(None, leak), (None, clean[0]), (None, halves[0]), (None, halves[1]), (None, None), (3, leak), (3, clean[1]), (3, None), (4, halves[0]), (4, halves[1]), (5, clean[2]), (6, leak), (6, leak)]
    d = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    kept = [tuple(r) for r in decontamination.remove_leaks(d, bench).collect()]
    assert Counter(kept) == Counter(r for r in data if r[1] != leak)
    assert {r.doc_id for r in decontamination.find_leaks(d, bench).collect()} == {None, 3, 4, 6}  # there, rows of one id are one document


def test_decontamination_main_path_is_native(docs, spark):
    bench = spark.createDataFrame([(0, "a b c d e f")], "item_id long, text string")
    plan = decontamination.find_leaks(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---------------------------------------------------------------- 2


def differenced(sizes, k):
    """Sums that Karmarkar-Karp differencing gives, from the definition: vectors of k sums, the two of largest spread combined."""
    parts = [(max(s, 0), [s] + [0] * (k - 1), i) for i, s in enumerate(sizes)]
    serial = len(parts)
    while len(parts) > 1:
        parts.sort(key=lambda p: (-p[0], p[2]))
        (_, a, _), (_, b, _) = parts[:2]
        both = sorted((x + y for x, y in zip(a, reversed(b), strict=True)), reverse=True)
        parts = [*parts[2:], (both[0] - both[-1], both, serial)]
        serial += 1
    return parts[0][1]


def test_karmarkar_karp_gives_the_sums_of_the_definition():
    r = np.random.default_rng(2)
    for n, k in ((1, 3), (5, 2), (17, 4), (60, 16), (200, 3)):
        sizes = [int(x) for x in r.integers(1, 500, n)]
        assert sorted(np.bincount(sharding.karmarkar_karp(sizes, k), sizes, k).astype(int), reverse=True) == differenced(sizes, k)


def test_levels_of_differencing(spark, monkeypatch):
    """Small buckets: parts are differenced in further levels, and hot texts get their shard without a join on the text."""
    for name, value in (("BUCKET_ITEMS", 20), ("LAST_ITEMS", 60), ("SINGLES", 4), ("MANY_COPIES", 30)):
        monkeypatch.setattr(sharding, name, value)
    d = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.repeat(F.lit("y"), F.pmod(F.xxhash64("id"), F.lit(80)).cast("int")), F.lit(" "), F.col("id").cast("string"))).alias("text"))
    got = sharding.shard_documents(d, 4).collect()
    sums, slots, hot = Counter(), defaultdict(list), set()
    for r in got:
        sums[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        if r.doc_id is None:
            hot.add(r.shard)
    assert len(got) == 3000 and len(hot) == 1 and max(sums.values()) - min(sums.values()) < 0.01 * max(sums.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_karmarkar_karp_is_tight():
    sizes = [int(x) for x in R.integers(1, 5000, 3000)]
    part = sharding.karmarkar_karp(sizes, 16)
    sums = np.bincount(part, sizes, 16)
    assert sums.max() - sums.min() <= 2 and sharding.karmarkar_karp([], 4) == [] and set(sharding.karmarkar_karp([5, 5], 3)) == {0, 1}
    assert sorted(np.bincount(sharding.karmarkar_karp([8, 7, 6, 5, 4], 2), [8, 7, 6, 5, 4])) == [14, 16]


def test_sharding(spark, docs, empty):
    got = sharding.shard_documents(docs, 4).collect()
    assert len(got) == len(rows())
    by_text = defaultdict(set)
    text_of = {r[0]: r[1] for r in rows()}
    slots = defaultdict(list)
    for r in got:
        t = text_of[r.doc_id]
        assert r["size"] == len((t or "").encode()) + 1 and r.text_crc32 == zlib.crc32((t or "").encode())
        by_text[t].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in by_text.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(empty, 4).count() == 0
    many = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), F.pmod(F.xxhash64("id"), F.lit(900)).cast("int")).alias("text"))
    sums = [r.s for r in sharding.shard_documents(many, 16).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sums) == 16 and max(sums) - min(sums) < 0.01 * max(sums)


# ---------------------------------------------------------------- 3


def test_language_id(spark, empty):
    en, de = "the cat and the other thing that was there", "der hund und die andere sache die dort war über"
    data = [(i, (en if i % 2 else de) + f" {i}", "en" if i % 2 else "de") for i in range(60)]
    data += [(100, None, None), (101, "123 !!", "en"), (102, "", None), (103, "THE OTHER THING", "de"), (104, "漢字", None), (104, "漢字", None), (105, "die andere sache " * 20000, "en")]
    d = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(d, F.col("doc_id") < 50).collect()}
    assert all(got[i][0] == ("en" if i % 2 else "de") for i in range(60)) and got[103][0] == "en" and got[105][0] == "de"
    assert got[100] == got[101] == got[102] == ("und", 0.0) and got[104][0] in ("en", "de") and all(0 <= s <= 1 for _, s in got.values())
    assert language_id.identify(empty, F.lit(True)).count() == 0
    assert {r.lang_pred for r in language_id.identify(d, F.lit(False)).collect()} == {"und"}


def test_language_sample_is_full_and_bounded(spark, monkeypatch):
    long = " ".join(WORDS) * 8
    data = [(i, f"usable {i}" if i % 75 == 0 else ["", None][i % 2], "en") for i in range(3000)]  # 40 usable
    data += [(i, f"{long} {i}", "es") for i in range(20)]  # all over 16 KB
    data += [(None, f"ohne {i}", "de") for i in range(1000)]  # no id
    data += [(None, "copie", "fr")] * 3000 + [(7, f"autre {i}", "fr") for i in range(10)]  # copies, and one id with several texts
    data += [(i, f"molti {i}", "it") for i in range(5000)]
    d = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(3)
    sample = lambda: language_id.training_sample(d, F.lit(True), "doc_id", "text", "lang")
    got = sample()
    assert Counter(x for x, _ in got) == {"en": 40, "es": 20, "de": 400, "fr": 11, "it": 400} and got == sample()
    assert len(set(got)) == len(got) and set(got) <= {(x, (t or "").encode()) for _, t, x in data}
    monkeypatch.setattr(language_id, "LANGUAGE_BYTES", 50_000)
    assert len(long) * 2 < 50_000 < len(long) * 3 and Counter(x for x, _ in sample())["es"] == 3
    monkeypatch.setattr(language_id, "LANGUAGE_BYTES", 1000)
    assert Counter(x for x, _ in sample())["es"] == 1


def test_language_tables_grow_with_languages_and_say_when_they_cannot():
    samples = [(x, " ".join(R.choice(WORDS, 400)).encode()) for x in "abc"]
    full = language_id.learn(samples)
    with pytest.warns(UserWarning, match="occurrences"):
        small = language_id.learn(samples, table_bytes=4000)
    assert small.bits.size < full.bits.size and small.lengths(np.frombuffer(b"abc", np.uint8), np.array([0, 3])).shape == (1, 3)


def test_a_language_of_long_texts_only(spark):
    long = lambda w, n: " ".join(R.choice(w, n))
    en, de = ["the", "cat", "other", "thing", "that"], ["der", "hund", "sache", "dort", "über"]
    data = [(i, long(en, 30), "en") for i in range(40)] + [(100 + i, long(de, 6000), "de") for i in range(8)]
    got = {r.doc_id: r.lang_pred for r in language_id.identify(spark.createDataFrame(data, "doc_id long, text string, lang string"), F.lit(True)).collect()}
    assert got == {i: x for i, _, x in data}


def test_code_lengths_are_those_of_the_trees():
    """Bit by bit against a direct reading of the definition: escape from unknown contexts to shorter ones."""
    train = b"abracadabra abracadabra abba"
    trees = language_id.learn([("x", train)])
    line = bytes(3) + train  # three marks stand before the text
    seen = defaultdict(Counter)
    for i in range(3, len(line)):
        for order in range(4):
            seen[line[i - order : i]][line[i]] += 1
    nodes = {c for c, n in seen.items() if not c or sum(n.values()) >= language_id.NODE_COUNT}

    def bits(context, byte):
        if context not in nodes:
            return bits(context[1:], byte)
        n = seen[context]
        total, kinds = sum(n.values()), len(n)
        if n[byte]:
            return -np.log2(n[byte] / (total + kinds))
        return -np.log2(kinds / (total + kinds)) + (bits(context[1:], byte) if context else 8.0)

    text = b"abra cad"
    at = bytes(3) + text
    want = sum(bits(at[i - 3 : i], at[i]) for i in range(3, len(at)))
    got = trees.lengths(np.frombuffer(text + text, np.uint8), np.array([0, len(text), len(text), 2 * len(text)]))
    assert got[:, 0] == pytest.approx([want, 0, want], rel=1e-5)


# ---------------------------------------------------------------- 4


def brute_components(texts):
    sets = {d: shingles(t) for d, t in texts.items()}
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = list(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in texts}, {d: len(s) for d, s in sets.items()}


def near_copies(n, seed):
    r = np.random.default_rng(seed)
    base = [str(x) for x in r.choice(WORDS, 40)]
    for _ in range(n):
        w = list(base)
        for _ in range(r.integers(0, 4)):
            w[r.integers(0, len(w))] = str(r.choice(WORDS)) + "z"
        yield " ".join(w[: r.integers(34, 41)])


def test_jaccard_components(spark, docs, empty, monkeypatch):
    texts = {i: t for i, t in enumerate([*TEXTS, *near_copies(60, 1), *near_copies(60, 2), *[" ".join(words(int(n))) for n in R.integers(1, 9, 60)], *[" ".join(BASE[:k] + words(3)) for k in range(2, 30)], *[" ".join(list("abcdef")[:k]) for k in range(1, 7)]])}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    want, sizes = brute_components(texts)
    for block, frequent, most, listed, rows in ((512, 32, 4_000_000, 2048, 200_000), (8, 3, 10, 2, 0)):  # small values take the ways of large groups and tables
        for name, value in (("BLOCK", block), ("FREQUENT", frequent), ("MOST_FREQUENT", most), ("LIST_BLOCK", listed)):
            monkeypatch.setattr(ngram_join, name, value)
        monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
        got = ngram_join.jaccard_components(d).collect()
        assert {r.doc_id: r.component_id for r in got} == want and {r.doc_id: r.n_shingles for r in got} == sizes
    again = {(r.doc_id, r.component_id) for r in ngram_join.jaccard_components(docs).collect()}
    assert (6, 6) in again and (7, 6) in again and (12, 6) in again and (None, 6) in again and (0, 0) in again
    kept = ngram_join.keep_one(docs)
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is not None, x))
    assert kept.columns == docs.columns and ids.count(6) == 1 and 7 not in ids and 12 not in ids and {0, 1, 2} <= set(ids)
    assert ngram_join.jaccard_components(empty).count() == 0


def test_ids_are_found_by_a_bitmap_of_bounded_size(spark, docs, monkeypatch):
    """No table of ids grows with the input at the driver: 400 000 keys are 1024 rows of 4 KB, and what hashes meet in is told apart."""
    bits = common.bitmap(spark.range(400_000), "id")
    assert bits.count() <= 1024 and bits.where("octet_length(_bits) > 4096").isEmpty()
    rows = spark.range(100_000, 700_000).withColumn("_in_bits", F.lit("own"))
    found = common.maybe_among(rows, "id", bits, "_maybe").where("_maybe")
    assert found.where("id < 400000 AND _in_bits = 'own'").count() == 300_000 and found.where("id >= 400000").count() < 15_000
    nothing = common.bitmap(spark.createDataFrame([(None,)], "id long"), "id")
    assert common.maybe_among(spark.createDataFrame([(None,), (7,)], "id long"), "id", nothing, "_maybe").where("_maybe").collect() == [(None, True)]
    kept = sorted(r.doc_id for r in ngram_join.keep_one(docs.where("doc_id IS NOT NULL")).collect())
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 0)
    monkeypatch.setattr(common, "BITMAP_BITS", 64)
    assert sorted(r.doc_id for r in ngram_join.keep_one(docs.where("doc_id IS NOT NULL")).collect()) == kept


def test_keep_one_tells_rows_of_an_id_apart(spark):
    alone, other = " ".join(words(30)), " ".join(words(40))
    near = " ".join(BASE[:59])
    data = [(1, " ".join(BASE)), (2, near), (2, alone), (2, alone), (2, None), (3, "ab cd"), (3, "ab cd"), (None, other), (None, other), (None, other.upper()), (None, " ".join(other.split()[:39])), (None, near), (None, ""), (None, None), (4, None)]
    d = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    kept = Counter((r.doc_id, r.text) for r in ngram_join.keep_one(d).collect())
    of_other = [x for x in kept if x[0] is None and x[1]]
    assert len(of_other) == 1 and kept[of_other[0]] == 1 and of_other[0][1].lower() in (other, " ".join(other.split()[:39]))
    del kept[of_other[0]]
    assert kept == Counter([(1, " ".join(BASE)), (2, alone), (2, None), (3, "ab cd"), (None, ""), (None, None), (4, None)])


def test_one_id_for_all_rows(spark):
    texts = list(near_copies(40, 8))
    for i in (None, 3):
        d = spark.createDataFrame([(i, t) for t in texts + texts[:5]], "doc_id long, text string")
        assert {(r.doc_id, r.component_id) for r in ngram_join.jaccard_components(d).collect()} == {(i, i)}


def test_sketches_bound_the_difference():
    r = np.random.default_rng(1)
    for n in (1, 10, 200):
        a = np.unique(r.integers(0, 1 << 63, n, np.int64).view(np.uint64))
        b = np.unique(np.concatenate([a[: n * 7 // 8], r.integers(0, 1 << 63, n // 8, np.int64).view(np.uint64)]))
        differ = sum(int(x).bit_count() for x in (ngram_join.sketch(a) ^ ngram_join.sketch(b)).view(np.uint64))
        both = len(np.intersect1d(a, b))
        assert differ <= len(a) + len(b) - 2 * both and (100 * both < 75 * (len(a) + len(b) - both) or 7 * differ <= len(a) + len(b))


def test_links_across_two_lists():
    a, b = np.arange(10, dtype=np.uint64), np.arange(1, 11, dtype=np.uint64)
    assert ngram_join.links([a, b]) == [(0, 1)] and ngram_join.links([a], [b]) == [(0, 1)] and ngram_join.links([a]) == [] and ngram_join.links([], [a, b]) == []


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(20, 40)] + [(100, x) for x in range(101, 120)] + [(7, 7), (3, 2), (2, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(21, 41), 20), **dict.fromkeys(range(101, 120), 100), 3: 2}


# ---------------------------------------------------------------- 5


def test_mixing(spark, docs, empty):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows())
    size = Counter()
    for r in rows():
        size[r[3]] += len(split(r[1]))
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, full = {}, set()
    while True:  # reshare until none is above
        free = [s for s in order if s not in full]
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in full)
        target = {s: 2 * size[s] if s in full else left * weight[s] / sum(weight[f] for f in free) for s in order}
        over = {s for s in free if target[s] > 2 * size[s]}
        if not over:
            break
        full |= over
    source = {r[0]: r[3] for r in rows()}
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        taken[s] += r.taken
        assert r.target == pytest.approx(target[s]) and r.source_size == size[s] and 0 <= r.taken <= 2 * r["size"]
    assert all(int(target[s] + 1e-9) - 3 < taken[s] <= int(target[s] + 1e-9) for s in order)  # three rows are equal
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix_sources(docs.repartition(1)).collect()), key=repr)
    assert mixing.mix_sources(empty).count() == 0


def test_mixing_by_hand(spark, monkeypatch):
    """Distinct rows, many ranges: each source's rows in key order, whole epochs and then up to the exact word."""
    import hashlib

    monkeypatch.setattr(mixing, "RANGE_ROWS", 7)
    data = [(i if i % 9 else None, " ".join(["w"] * int(n)), ["a", "b", None][min(2, i % 7)]) for i, n in enumerate(R.integers(0, 40, 300))]
    data = list({(i, t + f" {k}" if t else t, x): None for k, (i, t, x) in enumerate(data)})  # no two are equal
    got = {(r.doc_id, r.t): r.taken for r in mixing.mix_sources(spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("t", F.col("text")), carry=("t",)).collect()}
    target = {r.s: r.target for r in mixing.mix_sources(spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("s", F.col("source")), carry=("s",)).collect()}
    for s, whole in target.items():
        mine = sorted(((hashlib.md5(f"{'' if i is None else i}/{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest(), i, t) for i, t, x in data if x == s))
        size = sum(len(t.split()) for _, _, t in mine)
        epochs, left = int(whole) // size, int(whole) % size
        for _, i, t in mine:
            n = len(t.split())
            assert got[i, t] == epochs * n + min(n, left)
            left -= min(n, left)


# ---------------------------------------------------------------- 6


def test_url_rules_and_templates(spark):
    urls = ["http://A.Example.com/de/1?x#y", "https://x.net/a", "https://m.example.net/en/2", "http://y.org/fr", "http://y.org/fr/2", None, "nothing", "http://h", "://?", "http://example.net.evil.com/en/"]
    d = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)] + [(None, urls[0], 1)], "page_id long, url string, host int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(d).collect()}
    assert got[0] == got[None] == ("a.example.com", "/de/1", "example.com/de/", "block") and got[1][2:] == ("net/", "block") and got[2][2:] == ("example.net/en/", "allow")
    assert got[3][2] is None and got[4][2:] == ("org/fr/", "allow") and got[5] == got[6] == ("", "", None, "allow") and got[7][:3] == ("h", "", None) and got[8][:2] == ("", "") and got[9][2] is None
    assert url_filter.filter_urls(d.limit(0)).count() == 0


@pytest.mark.parametrize("most", [200_000, 0])
def test_url_tree_learns_templates(spark, monkeypatch, most):
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    rows = [(i, f"http://shop.biz/item/{w}-{i}x/view") for i, w in enumerate(WORDS[:40])] + [(100 + i, f"http://shop.biz/spam/{i}") for i in range(30)] + [(200 + i, f"http://shop.biz/spam/{900 + i}.html") for i in range(5)]
    d = spark.createDataFrame(rows, "page_id long, url string")
    rules = [("shop.biz", f"/spam/{i}", "block") for i in range(3)]
    got = {r.page_id: r for r in url_filter.filter_urls(d, rules=rules).collect()}
    assert {got[i].template for i in range(40)} == {"/item/*/view"} and {got[i].template for i in (100, 129, 204)} == {"/spam/*"}
    assert got[204].verdict == "block" and got[0].verdict == "allow"


def test_url_tree_finds_what_varies_below_what_varies(spark):
    d = spark.createDataFrame([(i, f"http://h.biz/u/{WORDS[i]}/p/{WORDS[i + 60]}/x/{WORDS[i % 5]}") for i in range(200)] + [(900, "http://h.biz/u"), (901, "http://h.biz/"), (902, "http://other.biz/u/a/p/b")], "page_id long, url string")
    got = {r.page_id: r.template for r in url_filter.filter_urls(d).collect()}
    assert {got[i] for i in range(200)} == {f"/u/*/p/*/x/{w}" for w in WORDS[:5]} and (got[900], got[901], got[902]) == ("/u", "/", "/u/a/p/b")


def test_url_templates_of_many_shapes(spark):
    """Level by level against a walk of the tree."""
    r = np.random.default_rng(12)
    urls = ["http://" + str(r.choice(["a.biz", "b.biz"])) + "".join("/" + (str(r.choice(["x", "y"])) if r.random() < 0.4 else f"{r.choice(WORDS[:90])}") for _ in range(r.integers(1, 5))) for _ in range(900)]

    def walk(rows, depth):  # rows: lists of segments under one node
        out = {}
        deep = [x for x in rows if len(x) > depth]
        kinds = Counter(x[depth] for x in deep)
        star = len(kinds) >= 24 and sum(kinds.values()) < 8 * len(kinds)
        parts = defaultdict(list)
        for x in deep:
            parts["*" if star else x[depth]].append(x)
        for name, part in parts.items():
            for x, t in walk(part, depth + 1).items() if any(len(x) > depth + 1 for x in part) else ():
                out[x] = f"/{name}{t}"
            for x in part:
                out.setdefault(tuple(x), f"/{name}")
        return out

    want = {}
    for host in ("a.biz", "b.biz"):
        want |= {(host, "/".join(x)): t for x, t in walk([u.split("/")[3:] for u in urls if u.split("/")[2] == host], 0).items()}
    got = {u: t for u, t in url_filter.filter_urls(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string"), keep=["url"]).select("url", "template").collect()}
    assert got == {u: want[u.split("/")[2], "/".join(u.split("/")[3:])] for u in urls} and len({t for t in got.values() if t.count("*") > 1}) > 0


# ---------------------------------------------------------------- 7


def test_token_counts(spark, docs, empty):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.MODEL))
    text_of = {r[0]: r[1] or "" for r in rows()}
    for r in token_counts.count_tokens(docs).collect():
        t = text_of[r.doc_id]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), len(model.encode(t)), len(model.encode(t)) > 4096)
    assert token_counts.count_tokens(empty).count() == 0
    counts = token_counts.Counts({}, public_tokenizers.path(token_counts.MODEL), cache=3)
    alphabet = list("ab  ▁\n\t.é漢<s>日　")
    for n in R.integers(0, 25, 300):
        t = "".join(R.choice(alphabet, n))
        assert counts.of(t) == len(model.encode(t))


# ---------------------------------------------------------------- 8 and 10


def labelled(spark, n=400):
    r = np.random.default_rng(3)
    texts, quality_, toxic = [], [], []
    for i in range(n):
        w = list(r.choice(WORDS, int(r.integers(15, 60))))
        bad, rude = i % 7 == 0, i % 5 == 0
        if rude:
            w[int(r.integers(0, len(w)))] = str(r.choice(["Grubble!", "snorkface,", "grubbles"]))
        texts.append((" ".join(x + "$$$" for x in w) if bad else " ".join(w)) + ".")
        quality_.append(int(not bad)), toxic.append(int(rude))
    d = spark.createDataFrame([(i, t, "en", 0.0) for i, t in enumerate(texts)] + [(9000, None, None, None), (9001, "", None, None), (9002, "!!", None, None), (9003, "grubble " * 30000, None, None), (9003, "grubble " * 30000, None, None)], "doc_id long, text string, lang string, score double")
    lab = spark.createDataFrame([*zip(range(n), quality_, toxic, strict=True), (None, 1, 1), (5, None, None), (12345, 0, 1)], "doc_id long, quality int, toxic int")
    return d, lab, quality_, toxic


def test_quality(spark, empty):
    d, lab, want, _ = labelled(spark)
    got = {r.doc_id: r for r in quality.score_quality(d, lab, crc_bucket("doc_id", 5) != 0).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == want[i] for i in held]) >= 0.97 and all(0 <= r.score <= 1 for r in got.values()) and {9000, 9001, 9002, 9003} <= set(got)
    assert got[9000].score == got[9001].score
    assert quality.score_quality(empty, lab, F.lit(True)).count() == 0
    assert {r.score for r in quality.score_quality(d, lab.limit(0), F.lit(True)).collect()} == {0.5}


def test_statistics_match_a_plain_reading():
    texts = ["", " ", "A b b\nc $5 !\nA b b", "ab" * 3000 + " x|y x|y\n\n\n12 ÄÖ (q)", "ONE two two two\tTHREE.\n"]
    raw = [t.encode() for t in texts]
    got = quality.statistics(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])]))
    at = {n: i for i, n in enumerate(quality.STATISTICS)}
    for row, t in zip(got, raw, strict=True):
        w, lines = t.split(), [x for x in t.split(b"\n") if x]
        n, size = max(len(w), 1), max(len(t), 1)
        pairs = [(None, w[0]), *zip(w, w[1:])] if w else []
        want = {
            "log_bytes": np.log1p(len(t)), "upper": sum(65 <= b < 91 for b in t) / size, "lower": sum(97 <= b < 123 for b in t) / size, "digit": sum(48 <= b < 58 for b in t) / size, "line": t.count(b"\n") / size, "wide": sum(b > 127 for b in t) / size, "shout": t.count(b"!") / size, "bar": t.count(b"|") / size,
            "words": np.log1p(len(w)), "word_len": sum(map(len, w)) / n, "word_max": max(map(len, w), default=0), "distinct": len(set(w)) / n, "repeats": sum(a == b for a, b in zip(w, w[1:])) / n, "marked": sum(any(b in b"!|#$%&*+/<=>@[\\]^_`{}~" for b in x) for x in w) / n,
            "capitals": sum(sum(65 <= b < 91 for b in x) > 1 for x in w) / n, "lines": np.log1p(len(lines)), "line_words": len(w) / max(len(lines), 1), "lines_distinct": len(set(lines)) / max(len(lines), 1), "top_word": max(Counter(w).values(), default=0) / n, "numbers": sum(any(48 <= b < 58 for b in x) for x in w) / n,
            "pairs_distinct": len(set(pairs)) / n,
        }
        assert {k: row[at[k]] for k in want} == pytest.approx(want)


def test_forest_arrays_match_recursion():
    x = R.normal(size=(500, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.5)).astype(float)
    f = quality.boost(x, y)

    def walk(row, feature, threshold, leaf):
        node = 0
        while node < len(feature):
            node = 2 * node + 1 + int(row[feature[node]] > threshold[node])
        return leaf[node - len(feature)]

    raw = [f.base + sum(walk(row, *t) for t in zip(f.feature, f.threshold, f.leaf, strict=True)) for row in x[:50]]
    assert f.score(x[:50]) == pytest.approx(1 / (1 + np.exp(-np.array(raw)))) and np.mean((f.score(x) > 0.5) == y) > 0.97


def test_toxicity(spark, empty):
    d, lab, _, want = labelled(spark)
    model = toxicity.train(d, lab, crc_bucket("doc_id", 5) != 0)
    got = {r.doc_id: r for r in toxicity.apply(d, model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == want[i] for i in held]) >= 0.95 and got[9003].predicted == 1 and got[9000].predicted == got[9002].predicted == 0
    assert toxicity.apply(empty, model).count() == 0
    for labels in (lab.limit(0), lab.where("toxic = 0")):
        assert {r.predicted for r in toxicity.apply(d, toxicity.train(d, labels, F.lit(True))).collect()} == {0}


def test_toxicity_gradients_and_windows():
    net = toxicity.Network(1)
    r = np.random.default_rng(2)
    x = r.normal(size=(5, 4, toxicity._INPUTS))
    mask = (r.random((5, 4)) > 0.3).astype(float)
    mask[0] = 1
    y, weight = np.array([0.0, 1, 1, 0]), np.ones(4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def loss():
        z = net.forward(x @ net.p["Wf"] + net.p["cf"], x @ net.p["Wb"] + net.p["cb"], mask)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    g, _ = net.gradient(x, mask, y, weight)
    for name in ("Wf", "Ub", "A", "v", "w", "b", "cb"):
        at = (0,) * net.p[name].ndim
        net.p[name][at] += 1e-3
        up = loss()
        net.p[name][at] -= 2e-3
        down = loss()
        net.p[name][at] += 1e-3
        assert g[name][at] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=2e-4)
    starts, text = toxicity.window_starts(np.array([0, 0, 1, 17, 60]))
    for t, (a, b) in enumerate(((0, 0), (0, 1), (1, 17), (17, 60))):
        covered = {w for s in starts[text == t] for w in range(s, min(s + toxicity.WINDOW, b))}
        assert covered == set(range(a, b))


def test_toxicity_scores_match_a_scalar_network():
    """Word by word and unit by unit, over every window of a text."""
    net = toxicity.Network(3, vocabulary=2)
    buf = np.frombuffer(b"One two. three\xc3\x9f one " * 9, np.uint8)
    words = toxicity.read_words(buf, np.array([0, len(buf)]))
    model = toxicity.Model(net, np.sort(words.keys[:2]), (1.3, -0.2))
    p = {k: v.astype(float) for k, v in net.p.items()}
    sig = lambda x: 1 / (1 + np.exp(-x))

    def inputs(word):
        w = b"\0" + word + b"\0"
        grams = [((w[i] * 257 + w[i + 1]) * 257 + w[i + 2]) * 0x9E3779B1 % 2**32 >> (32 - 12) for i in range(len(word))]
        (key,) = toxicity.read_words(np.frombuffer(word, np.uint8), np.array([0, len(word)])).keys
        row = list(model.keys).index(key) + 1 if key in model.keys else 0
        return np.concatenate([p["V"][row], np.mean([p["E"][g] for g in grams], axis=0)])

    def states(xs, d):
        h, out = np.zeros(toxicity.HIDDEN), []
        for x in xs:
            a, u = x @ p[f"W{d}"] + p[f"c{d}"], h @ p[f"U{d}"]
            n = toxicity.HIDDEN
            z, r = sig(a[:n] + u[:n]), sig(a[n : 2 * n] + u[n : 2 * n])
            h = h + z * (np.tanh(a[2 * n :] + r * u[2 * n :]) - h)
            out.append(h)
        return out

    text = [w for w in buf.tobytes().replace(b"\xc3\x9f", b"\xc3\x9f").lower().replace(b".", b" ").split()]
    logits = []
    for at in range(0, max(1, len(text) - toxicity.WINDOW + toxicity.STEP), toxicity.STEP):
        xs = [inputs(w) for w in text[at : at + toxicity.WINDOW]]
        hs = [np.concatenate(x) for x in zip(states(xs, "f"), states(xs[::-1], "b")[::-1], strict=True)]
        e = np.exp([np.tanh(h @ p["A"]) @ p["v"] for h in hs])
        logits.append(sum(a * h for a, h in zip(e / e.sum(), hs, strict=True)) @ p["w"] + p["b"][0])
    assert model.score(buf, np.array([0, len(buf)])) == pytest.approx([sig(1.3 * max(logits) - 0.2)], rel=1e-4)


def test_toxicity_learns_from_long_texts_alone(spark, monkeypatch):
    r = np.random.default_rng(8)
    texts = [" ".join([*r.choice(WORDS, 1500), *(["snorkface"] if i % 2 else []), *r.choice(WORDS, 1500)]) for i in range(120)]
    d = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)] + [("1", texts[0])] * 50, "doc_id string, text string")  # ids of text, one of them repeated
    lab = spark.createDataFrame([(str(i), i % 2) for i in range(90)] + [("1", None)], "doc_id string, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.apply(d.where("doc_id != '1'"), toxicity.train(d, lab, F.lit(True))).collect()}
    assert np.mean([got[str(i)] == i % 2 for i in range(90, 120)]) >= 0.9
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 40_000)
    sample = toxicity.training_sample(d, lab, F.lit(True), "doc_id", "text", "toxic")
    assert 2 <= len(sample) <= 4 and all(len(t) > 8192 for _, t in sample)
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 10)
    assert {y for y, _ in toxicity.training_sample(d, lab, F.lit(True), "doc_id", "text", "toxic")} == {0, 1}


# ---------------------------------------------------------------- 9


def test_neighbours(spark):
    r = np.random.default_rng(4)
    v = [(i, [float(x) for x in r.normal(size=6)]) for i in range(120)]
    v += [(200 + i, v[50][1]) for i in range(8)] + [(300, None), (301, [0.0] * 6), (302, [float("nan")] * 6), (303, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (304, [1.0, 2.0]), (None, [1.0] * 6), (7, v[7][1]), (305, [1e200, 1e200, 0.0, 0.0, 0.0, 0.0]), (350, [1e-200, 1e-200, 0.0, 0.0, 0.0, 0.0])]
    d = spark.createDataFrame([(i, x, 1.0) for i, x in v], "vec_id long, embedding array<double>, score double")
    got = defaultdict(list)
    for x in neighbours.nearest(d, F.col("vec_id") % 50 == 0, 5).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
    good = {i: np.array(x) for i, x in v if i is not None and x and None not in x and np.isfinite(x).all() and any(x) and len(x) == 6}
    unit = {i: x / np.abs(x).max() / np.sqrt(((x / np.abs(x).max()) ** 2).sum()) for i, x in good.items()}
    for q in (0, 50, 100, 200, 350):
        best = sorted(((-float(unit[q] @ unit[i]), i) for i in good if i != q))[:5]
        assert [s for _, s in got[q]] == pytest.approx([-s for s, _ in best])
        assert [round(-s, 9) for s, _ in best] == [round(s, 9) for _, s in got[q]] and len({i for i, _ in got[q]}) == 5
    assert [i for i, _ in got[50]] == [200, 201, 202, 203, 204] and set(got) == {0, 50, 100, 200, 350}
    assert neighbours.nearest(d.limit(0), F.lit(True), 5).count() == 0


def test_repeated_ids_take_one_place_each(spark):
    r = np.random.default_rng(9)
    v = [(i, [float(x) for x in r.normal(size=6)]) for i in range(60)]
    v = [x for x in v for _ in range(3)]  # equal copies
    v += [(i, [float(x) for x in np.array(v[0][1]) + e * r.normal(size=6)]) for i in (71, 72) for e in (0.01, 0.02, 0.03, 0.04, 0.05, 0.06)]  # one id, differing vectors
    d = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    unit = [(i, np.array(x) / np.linalg.norm(x)) for i, x in v]
    score = defaultdict(lambda: -2.0)
    for i, x in unit[1:]:
        score[i] = max(score[i], float(unit[0][1] @ x))
    best = sorted((-s, i) for i, s in score.items() if i)[:5]
    for n in (1, 3):
        got = neighbours.nearest(d.repartition(n), F.col("vec_id") == 0, 5).orderBy("rank").collect()
        assert [x.vec_id for x in got] == [i for _, i in best] and [x.score for x in got] == pytest.approx([-s for s, _ in best])


def test_cells_of_the_block_matrix(spark, monkeypatch):
    """Many cells of small tiles give what one gives, against brute force; a third of the rows repeat one id."""
    r = np.random.default_rng(14)
    v = [(i, [float(x) for x in r.integers(-3, 4, 5 + i % 2)]) for i in range(150)] + [(7, [1.0, 2.0, 3.0, 4.0, float(i % 3)]) for i in range(70)]
    v = [(i, x) for i, x in v if any(x)]
    d = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    near = defaultdict(dict)
    first = {i: min(x for j, x in v if j == i) for i in {i for i, _ in v} if i % 10 == 0}
    for q, a in first.items():
        for i, b in v:
            if i != q and len(a) == len(b):
                s = float(np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b)))
                near[q][i] = max(s, near[q].get(i, -2))
    want = {q: [round(-s, 9) for s, _ in sorted((-s, i) for i, s in c.items())[:5]] for q, c in near.items()}
    for cells in (None, 700):
        if cells:
            for name, value in (("TILE_BYTES", 100), ("QUERY_BYTES", cells), ("CANDIDATE_BYTES", cells), ("TILE_ROWS", 3), ("TILE_QUERIES", 2)):
                monkeypatch.setattr(neighbours, name, value)
        got = defaultdict(list)
        for x in neighbours.nearest(d.repartition(3), F.col("vec_id") % 10 == 0, 5).orderBy("query_id", "rank").collect():
            got[x.query_id].append((round(x.score, 9), x.vec_id))
        assert {q: [s for s, _ in g] for q, g in got.items()} == want
        assert all(g == sorted(g, key=lambda x: (-x[0], x[1])) and len({i for _, i in g}) == len(g) for g in got.values())


def test_few_candidates_are_all_found(spark):
    d = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.rank, r.vec_id) for r in neighbours.nearest(d, F.col("vec_id") == 0, 5).collect()] == [(0, 1, 1)]


def test_bounds_hold():
    r = np.random.default_rng(6)
    a = neighbours.Block(np.arange(50), r.normal(size=(50, 32)))
    near = (a.tile() @ a.tile().T) * a.scale[:, None] * a.scale[None, :]
    slack = a.error[:, None] * a.coded_norm[None, :] + a.error[None, :]
    i, j = np.indices((50, 50)).reshape(2, -1)
    exact = neighbours.cosines(a, i, a, j).reshape(50, 50)
    assert (np.abs(exact - near) <= slack + 1e-6).all()


def test_stored_tables_give_back_the_drivers_unused_memory(spark, monkeypatch):
    said = common.release_driver(spark)
    assert said.startswith("Trim native heap")  # of the JVM that the tests run on; another may say nothing
    calls = []
    monkeypatch.setattr(common, "release_driver", calls.append)
    monkeypatch.setattr(common, "_released", [float("-inf")])
    assert common.stored(spark.range(3)).count() == 3 and calls == [spark]
    monkeypatch.setattr(common, "_released", [common.time.monotonic()])
    assert common.stored(spark.range(3)).count() == 3 and len(calls) == 1  # not again within RELEASE_S
