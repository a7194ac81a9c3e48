"""Deduplication, joins, language, quality: small cases and brute force."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geolith.llm import exact_dedup, jaccard_join, language_id, line_dedup, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def frame(spark, texts, ids=None, schema="doc_id long, text string"):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame(list(zip(ids, texts, strict=True)), schema)


# Exact deduplication.


def brute_exact(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault("".join(c for c in (text or "") if c not in " \t\n\x0b\x0c\r"), []).append((doc_id, text or ""))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0]))[0]
        out += [(d, keep, len(members), d == keep, hashlib.sha256(norm.encode()).hexdigest()) for d, _ in members]
    return sorted(out)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, weak):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a b", "ab", "a\nb ", None, "", " ", "é", "e", "x" * 5000, "x" * 2500 + "\t" + "x" * 2500])) for i in range(200)]
    # A weak digest makes different texts collide; their bytes tell them apart.
    digest = (lambda c: F.substring(F.sha2(c.cast("binary"), 256), 1, 0)) if weak else exact_dedup.sha256
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), digest=digest)
    assert sorted(tuple(r) for r in got.collect()) == brute_exact(rows)


def test_exact_dedup_of_odd_tables(spark):
    assert exact_dedup.exact_dedup(spark.createDataFrame([], DOCS)).count() == 0
    df = frame(spark, ["a", "a", None], [7, 7, None]).withColumn("digest", F.lit("x")).withColumn("keep_id", F.lit(1))
    got = sorted((r.doc_id is None, r.doc_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df).collect())
    assert got == [(False, 7, 2, False), (False, 7, 2, True), (True, None, 1, True)]
    repeated = exact_dedup.exact_dedup(frame(spark, ["a", "a", "a", None, ""], [7, 7, 8, None, None])).collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.kept) for r in repeated) == [(0, 0, False), (0, 0, True), (7, 7, False), (7, 7, True), (8, 7, False)]


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup_of_a_hot_text(spark, weak, monkeypatch):
    """A text that holds a third of all rows spreads over salts, and is verified like others."""
    monkeypatch.setattr(exact_dedup, "LEAST", 5)
    rows = [(i, "h ot" if i % 3 == 0 and i > 60 else "hot" if i % 3 == 0 else f"text {i % 40}" if i % 3 == 1 else f"single {i}") for i in range(600)]
    digest = (lambda c: F.substring(F.sha2(c.cast("binary"), 256), 1, 1)) if weak else exact_dedup.sha256
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), digest=digest)
    assert sorted(tuple(r) for r in got.collect()) == brute_exact(rows)


def test_index_compacts_and_finds(spark):
    index = exact_dedup.DigestIndex(spark, fanout=2)
    for start in (8, 4, 0):
        index.add(spark.createDataFrame([(f"d{i % 3}", 1, start + i, i) for i in range(4)], "digest string, n_points long, doc_id long, row long"))
    assert [len(level) for level in index.levels] == [1, 1]
    assert [tuple(r) for r in index.find(["d1"]).select("keep_id", "group_size").collect()] == [(1, 3)]


# Line deduplication.


def brute_lines(rows):
    white = " \t\n\x0b\x0c\r"
    owner = {}
    key = lambda line: "".join(c.lower() if c < "\x80" else c for c in line.strip(white))
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            owner[key(line)] = min(owner.get(key(line), doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or owner[key(x)] == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_line_dedup(spark):
    rng = random.Random(2)
    pool = ["short", "a line that many hold", "A LINE that many hold ", "ÉÉÉÉÉÉÉÉÉÉ", "éééééééééé", "", "\tanother long line\r", "another long line", "123456789", "1234567890"]
    rows = [(i, None if i == 5 else "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 6)))) for i in range(60)] + [(99, "y" * 100_000 + "\n" + "y" * 100_000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__gone", F.lit("clash"))
    got = line_dedup.line_dedup(df).select("doc_id", "__n_lines", "__n_dropped", "text")
    assert sorted(tuple(r) for r in got.collect()) == brute_lines(rows)
    assert line_dedup.line_dedup(df.limit(0)).count() == 0


def test_line_dedup_of_a_hot_line(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "LEAST", 5)
    rows = [(i, f"the line that all hold\nown line {i}\nshared line {i % 50:04d}") for i in range(300)]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "__n_lines", "__n_dropped", "text")
    assert sorted(tuple(r) for r in got.collect()) == brute_lines(rows)


def test_line_dedup_without_or_with_repeated_ids(spark):
    line = "the same long line"
    got = line_dedup.line_dedup(frame(spark, [line, line, line, line], [3, 3, None, 4]))
    assert sorted((r.doc_id or -1, r["__n_dropped"]) for r in got.collect()) == [(-1, 0), (3, 0), (3, 0), (4, 1)]


# Similarity join.


def brute_components(rows, percent, n):
    sets = {}
    for doc_id, text in rows:
        low = "".join(c.lower() if c < "\x80" else c for c in text or "")
        words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
        sets[doc_id] = {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return sorted((d, len(s), root(d)) for d, s in sets.items())


@pytest.mark.parametrize(("percent", "n"), [(90, 3), (80, 5), (50, 2), (100, 3)])
def test_similarity_join(spark, percent, n):
    rng = random.Random(percent)
    rows, words = [], [f"W{i}" for i in range(300)]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 8, 40, 120]))]
        for _ in range(10):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 12)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(w.lower() if rng.random() < 0.5 else w for w in copy)))
    rows += [(len(rows) + i, t) for i, t in enumerate([None, "", " \t", "one", "ONE", "one two", "a b c", "a  b\nc"])]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), percent, n)
    assert sorted(tuple(r) for r in got.collect()) == brute_components(rows, percent, n)


def test_similarity_join_chain_and_tiles(spark, monkeypatch):
    """A chain of copies whose ends are far apart, with tiles that hold a few classes each."""
    monkeypatch.setattr(jaccard_join, "TILE", 4)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        if i:
            words[i] = f"new{i}"
        rows.append((100 - i, " ".join(words)))
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 90, 3)
    assert sorted(tuple(r) for r in got.collect()) == brute_components(rows, 90, 3)


def test_similarity_join_bounds_lose_no_pair():
    """Sets at the threshold share a block, and their parities never tell them farther apart than they are."""
    rng = np.random.default_rng(5)
    for percent in (50, 80, 90):
        for size in [*range(1, 40), 100, 1000]:
            for _ in range(60):
                b = rng.integers(0, 1 << 63, size, dtype=np.int64).astype(np.uint64) * np.uint64(2)
                gone = int(rng.integers(0, size))
                a = np.unique(np.concatenate([b[gone:], rng.integers(0, 1 << 63, int(rng.integers(0, 3)), dtype=np.int64).astype(np.uint64)]))
                b = np.unique(b)
                both = len(np.intersect1d(a, b))
                apart = len(a) + len(b) - 2 * both
                assert jaccard_join.differing(jaccard_join.parities(a), jaccard_join.parities(b)) <= apart
                if both and 100 * both >= percent * (both + apart):
                    assert np.intersect1d(jaccard_join.blocks_of(a, percent), jaccard_join.blocks_of(b, percent)).size


def test_product_counts_like_sets():
    rng = np.random.default_rng(6)
    left, right = [], []
    for _ in range(400):
        b = rng.integers(0, 1 << 63, int(rng.integers(1, 200)), dtype=np.int64).astype(np.uint64) * np.uint64(2)
        a = np.concatenate([b[int(rng.integers(0, 1 + len(b) // 4)) :], rng.integers(0, 1 << 63, int(rng.integers(0, 9)), dtype=np.int64).astype(np.uint64)])
        left.append(np.unique(a))
        right.append(np.unique(b))
    for percent in (50, 80, 90):
        want = [100 * (i := len(np.intersect1d(a, b))) >= percent * (len(a) + len(b) - i) for a, b in zip(left, right, strict=True)]
        assert 0 < sum(want) < 400 and jaccard_join.reaching(left, right, percent).tolist() == want
    assert jaccard_join.reaching([], [], 90).tolist() == []


def test_shingles_of_long_texts(monkeypatch):
    """Parts and very long words change nothing but the hashes of those words."""
    rng = random.Random(7)
    text = "".join(rng.choice(["Word ", "x\t", "ö\n", "abc  "]) for _ in range(5000))
    whole = jaccard_join.shingles(text)
    monkeypatch.setattr(jaccard_join, "PART", 100)
    jaccard_join._powers.cache_clear()
    assert (jaccard_join.shingles(text) == whole).all()
    long = "a b " + "z" * 1000 + " c d"
    assert len(jaccard_join.shingles(long)) == 3 and (jaccard_join.shingles(long.upper()) == jaccard_join.shingles(long)).all()
    jaccard_join._powers.cache_clear()


def test_similarity_join_of_very_long_texts(spark):
    words = [f"w{i % 5000}" for i in range(400_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-5], "other"])), (3, "q" * 3_000_000), (4, " ".join(words[:200_000]) + " end")]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3, 4: 1} and {r.doc_id: r.n_shingles for r in got}[3] == 1


def test_similarity_join_of_odd_tables(spark):
    assert jaccard_join.jaccard_components(spark.createDataFrame([], DOCS)).count() == 0
    got = jaccard_join.jaccard_components(frame(spark, ["a b c d", "a b c d", "a b c d"], [5, 5, None]))
    assert sorted(tuple(r) for r in got.collect()) == [(5, 2, 5), (5, 2, 5)]


# Language.


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.predict(docs.where("lang IS NOT NULL"), language_id.fit(docs)).where(language_id.held_out())
    right, n = found.agg(F.avg((F.col("lang") == F.col("__lang")).cast("double")), F.count("*")).first()
    assert n > 150 and right > 0.97


def test_language_of_odd_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs)
    odd = frame(spark, [None, "", "123 !?", "x" * 3_000_000, "日本語"]).withColumn("__score", F.lit("clash"))
    got = {r.doc_id: r for r in language_id.predict(odd, model).collect()}
    assert [got[i]["__lang"] for i in range(3)] == ["und"] * 3 and [got[i]["__score"] for i in range(3)] == [0.0] * 3
    assert all(0 <= r["__score"] <= 1 for r in got.values())
    assert language_id.predict(docs.limit(0), language_id.fit(docs.limit(0))).count() == 0


def test_language_rejects_what_is_far_from_all(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs)
    rng = random.Random(8)
    far = [
        "日本語", "東京は日本の首都であり、世界で最も人口の多い都市の一つです。", "北京是中华人民共和国的首都,也是全国的政治中心。",
        "Η Αθήνα είναι η πρωτεύουσα της Ελλάδας και μεγάλη πόλη", "Москва является столицей России и крупнейшим городом страны",
        "Helsinki on Suomen pääkaupunki ja suurin kaupunki, jossa asuu paljon ihmisiä, ja se sijaitsee Suomenlahden rannalla", *[
            " ".join("".join(rng.choices(letters, k=7)) for _ in range(40))
            for letters in ("bcdfghjklmnpqrstvwxz", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
        ],
    ]
    assert [t for t in far if not model.predict(t)[2]] == []
    rows = docs.where(language_id.held_out() & F.col("lang").isNotNull()).select("text").collect()
    own = [model.predict(r.text)[2] for r in rows if r.text and language_id.HAS_LETTER(r.text)]
    assert len(own) > 150 and sum(own) <= 0.005 * len(own)


# Quality.


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = labels.where(quality.held_out()).select("doc_id", "quality").dropDuplicates(["doc_id"])
    found = quality.score(docs.join(held.select("doc_id"), "doc_id"), quality.fit(docs, labels)).join(held, "doc_id")
    rows = [(r["__score"], r["quality"]) for r in found.select("__score", "quality").collect()]
    good, bad = [s for s, q in rows if q == 1], [s for s, q in rows if q == 0]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.9


def test_quality_of_odd_tables(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    odd = frame(spark, [None, "", "\n\n", "z" * 2_000_000]).withColumn("__n_chars", F.lit("clash"))
    got = quality.score(odd, quality.fit(docs, labels)).collect()
    assert all(0 <= r["__score"] <= 1 for r in got) and len({r["__score"] for r in got if not r.text}) == 1
    assert quality.score(odd, quality.fit(docs, labels.limit(0))).select("__score").distinct().count() == 1
