"""Tokenizers, token files, packing, vector search, page text."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from geolith.llm import bpe, html_text, kdtree_search, packing, queries, tokenfile, wordtokens

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a", "It's  two\n\nlines\t", "<|endoftext|>", "x<|endoftext|> y", "é日本😀 ß İ \x1c²½", "don't 'LL we're 1234567", "a" * 5000, "  x", "naïve café", "Ñ", "ﬁ"]


def library(name):
    out = Tokenizer.from_file(public_tokenizers.path(name))
    out.no_truncation()
    out.no_padding()
    return out


def texts(n=150):
    import pyarrow.parquet as pq

    rng = random.Random(4)
    chars = "aeT 's'll\n\t\r\x0b\x1c\x85 ²½٣_-.,!é日😀 ßIİ0123<|endoftext|>"
    made = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 50))) for _ in range(400)]
    return ODD + made + pq.read_table(f"{SF}/documents.parquet").column("text").to_pylist()[:n]


def test_byte_bpe_equals_the_library():
    model, theirs = bpe.ForcedBoundaryBPE(bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))), library("byte_bpe_50k.json")
    for text in texts():
        ids = theirs.encode(text or "", add_special_tokens=False).ids
        own = model.encode(text or "")
        assert np.frombuffer(own, "<u4").tolist() == ids
        assert model.decode(own).decode() == theirs.decode(ids, skip_special_tokens=False)


def test_byte_bpe_tables(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame([(i, t, "k", "c") for i, t in enumerate(ODD)], "doc_id long, text string, ids string, `a b` string")
    encoded = bpe.encode(df, path)
    assert sorted(encoded.columns) == ["a b", "doc_id", "ids"]
    back = {r.doc_id: r.text for r in bpe.decode(encoded.withColumn("text", F.lit("clash")), path).collect()}
    assert back == {i: t or "" for i, t in enumerate(ODD)}
    assert bpe.encode(df.limit(0), path).count() == 0


def test_word_tokens_equal_the_library():
    model, theirs = wordtokens.WordTokens(bpe.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))), library("word_bpe_49k.json")
    for text in texts():
        assert np.frombuffer(model.encode(text), "<u4").tolist() == theirs.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("kind", ["random", "repeated", "one", "empty"])
def test_range_coder_round_trip(kind):
    rng = np.random.default_rng(5)
    blocks = {
        "random": [rng.integers(0, 65536, n).astype(np.uint16) for n in (0, 1, 2, 500, 4096)],
        "repeated": [np.tile(np.array([7, 8, 9, 40000], np.uint16), 1000), np.zeros(4096, np.uint16)],
        "one": [np.array([65535], np.uint16)], "empty": [],
    }[kind]
    payloads = tokenfile.encode_blocks(blocks)
    got = tokenfile.decode_blocks(payloads, [len(b) for b in blocks])
    assert all((a == b).all() for a, b in zip(got, blocks, strict=True))
    if kind == "repeated":
        assert sum(map(len, payloads)) < 1000


def test_range_coder_shrinks_real_ids():
    model = wordtokens.WordTokens(bpe.read_vocabulary(public_tokenizers.path("word_bpe_49k.json")))
    ids = np.concatenate([np.frombuffer(model.encode(t), "<u4") for t in texts(200)]).astype(np.uint16)
    blocks = [ids[i : i + tokenfile.BLOCK] for i in range(0, len(ids), tokenfile.BLOCK)]
    assert sum(map(len, tokenfile.encode_blocks(blocks))) < 0.7 * 2 * len(ids)
    steps = [np.tile(np.arange(i, i + 40, dtype=np.uint16) * 1000, 100) for i in (0, 3)]  # order 0 alone knows these ids once shuffled
    mixed = [np.random.default_rng(2).permutation(s) for s in steps]
    assert sum(map(len, tokenfile.encode_blocks(mixed))) < 0.6 * 2 * sum(map(len, mixed))


def zipf_blocks(n: int, size: int) -> list[np.ndarray]:
    rng = np.random.default_rng(3)
    return [(rng.zipf(1.3, size) % 50_000).astype(np.uint16) for _ in range(n)]


def test_blocks_of_a_file_share_a_model():
    blocks = zipf_blocks(32, 600)
    together, alone = tokenfile.encode_blocks(blocks), [tokenfile.encode_blocks([b])[0] for b in blocks]
    assert sum(map(len, together)) < 0.9 * sum(map(len, alone))


def test_a_step_of_the_coder_is_a_few_calls():
    """CPU seconds go to the numpy calls of each step: decoding took 98 of them, encoding 62, when order 0 was searched bit by bit."""
    import sys

    blocks = zipf_blocks(8, 600)
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    def steps(run):
        nonlocal calls
        calls, before = 0, sys.getprofile()
        sys.setprofile(count)
        try:
            return run(), calls / 600
        finally:
            sys.setprofile(before)

    payloads, encoding = steps(lambda: tokenfile.encode_blocks(blocks))
    got, decoding = steps(lambda: tokenfile.decode_blocks(payloads, [600] * 8))
    assert all((a == b).all() for a, b in zip(got, blocks, strict=True))
    assert encoding < 50 and decoding < 60


def test_token_files_are_read_alone_and_together(monkeypatch):
    """Files of several units, cut into several groups that are coded at once, with documents of all lengths."""
    monkeypatch.setattr(tokenfile, "BLOCK", 64)
    monkeypatch.setattr(tokenfile, "UNIT", 4)
    monkeypatch.setattr(tokenfile, "LANES", 6)
    ids = np.concatenate(zipf_blocks(1, 5000))
    cuts = [0, 700, 700, 701, 1900, 1964, 2300, 5000]
    documents = [[(i, ids[a:b])] for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    documents[0].append((70, ids[:65]))
    files = tokenfile.write_files([*documents, []])
    plain = lambda read: [[(d, x.tolist()) for d, x in own] for own in read]
    want = plain([*documents, []])
    assert plain(tokenfile.read_files(files)) == want
    assert [plain(tokenfile.read_files([f]))[0] for f in files] == want
    assert [tokenfile.write_files([d])[0] for d in documents] == files[:-1]


def test_token_files_refuse_large_ids(spark, tmp_path):
    import json

    spec = json.loads(bpe.read_vocabulary(public_tokenizers.path("word_bpe_49k.json")))
    spec["model"]["vocab"]["zzzzzzzz</w>"] = 70_000
    path = tmp_path / "large.json"
    path.write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        tokenfile.write(spark.createDataFrame([(1, "a")], "doc_id long, text string"), str(path))


def test_byte_bpe_query(spark):
    theirs = library("byte_bpe_50k.json")
    want = {}
    for doc_id, text in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        ids = theirs.encode(text or "", add_special_tokens=False).ids
        back = theirs.decode(ids, skip_special_tokens=False).encode()
        want[doc_id] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in bpe.op2_bpe(spark, SF).collect()} == want


def test_token_files_notice_damage():
    data = tokenfile.write_files([[(1, np.arange(300, dtype=np.uint16)), (2, np.zeros(0, np.uint16))]])[0]
    assert [(d, ids.tolist()) for d, ids in tokenfile.read_files([data])[0]] == [(1, list(range(300))), (2, [])]
    with pytest.raises(ValueError):
        tokenfile.read_files([data[:-3] + bytes([data[-3] ^ 1]) + data[-2:]])
    with pytest.raises(ValueError):
        tokenfile.read_files([b"x" + data])


def test_token_file_query(spark):
    theirs = library("word_bpe_49k.json")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    start, want = 0, []
    for doc_id, text in docs:
        ids = [*theirs.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in tokenfile.op5_token_file(spark, SF).collect()) == want


def test_token_files_of_odd_tables(spark):
    df = spark.createDataFrame([(3, None), (1, ""), (2, "a b"), (2, "c"), (None, "x")], "doc_id long, text string").withColumn("part", F.lit("clash"))
    got = sorted(tuple(r)[:3] for r in tokenfile.read(tokenfile.write(df, parts=2)).collect())
    assert [g[0] for g in got] == [1, 2, 2, 3] and [g[1] for g in got] == [0, 1, got[2][1], 6] and sum(g[2] for g in got) == 7
    assert tokenfile.read(tokenfile.write(df.limit(0))).count() == 0


# Packing.


def test_packing_query(spark):
    theirs = library("word_bpe_49k.json")
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = packing.op10_packing(spark, SF).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length))
    want = {}
    for doc_id, text in docs.items():
        ids = np.array([*theirs.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want[doc_id] = [(i, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for i, s in enumerate(range(0, len(ids), 2048))]
    assert {d: sorted(p) for d, p in pieces.items()} == want
    for own in sequences.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048
    total = sum(r.length for r in rows)
    assert len(sequences) <= 1.01 * total / 2048 + 2


def test_plan_is_exact_and_close_to_the_bound():
    rng = np.random.default_rng(6)
    for capacity, n in ((64, 5000), (2048, 3000), (10, 1)):
        lengths = np.clip(rng.lognormal(np.log(capacity / 6), 0.9, n).astype(int), 1, capacity)
        counts = np.bincount(lengths, minlength=capacity + 1)
        plan = packing.plan(counts, capacity)
        assert (sum(p * m for p, m in plan) == counts).all()
        assert all((p * np.arange(capacity + 1)).sum() <= capacity for p, _ in plan)
        assert sum(m for _, m in plan) <= 1.01 * max(1, -(-int(lengths.sum()) // capacity)) + 2
    big = np.zeros(11, np.int64)
    big[6] = 7
    assert sum(m for _, m in packing.plan(big, 10)) == 7


@pytest.mark.parametrize("kind", ["few", "many", "even"])
def test_program_covers_every_length_and_makes_the_sequences(kind):
    rng = np.random.default_rng(9)
    lengths = {"few": 40_000, "many": 2_000_000, "even": 0}[kind]
    capacity = 2048
    counts = np.bincount(np.clip(rng.lognormal(np.log(300), 1.0, lengths).astype(int), 1, capacity - 1), minlength=capacity + 1) if lengths else np.r_[0, np.full(capacity - 1, 1000), 0]
    covered, total = np.zeros(capacity + 1), 0.0
    for pieces, x in packing.solve(counts, capacity):
        assert sum(k * n for k, n in pieces) <= capacity
        total += x
        for k, n in pieces:
            covered[k] += n * x
    bound = (counts * np.arange(capacity + 1)).sum() / capacity
    assert (covered >= 0.999 * counts - 1e-9).all() and total <= 1.001 * bound
    made = packing._plan(counts, capacity, 3000)
    assert (sum(p * m for p, m, _ in made) == counts).all()
    assert sum(m for _, m, solved in made if solved) >= 0.95 * sum(m for _, m, _ in made)


def test_packing_of_odd_tables(spark):
    df = spark.createDataFrame([(1, None), (1, ""), (None, "a"), (2, "b " * 3000)], "doc_id long, text string").withColumn("length", F.lit("clash"))
    got = packing.pack(df, capacity=2048).collect()
    assert sorted((r.doc_id or 0, r.piece, r.length) for r in got) == [(0, 0, 2), (1, 0, 1), (1, 0, 1), (2, 0, 2048), (2, 1, 953)]
    assert packing.pack(df.limit(0)).count() == 0


# Vector search.


def brute_top(rows, k, every):
    out = []
    for q, v in rows:
        if q % every == 0:
            scores = sorted((-int(np.dot(v, w)), c) for c, w in rows if c != q)[:k]
            out += [(q, rank, c, -s) for rank, (s, c) in enumerate(scores, 1)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [7, 64, 10_000])
def test_top_k(spark, shard_rows):
    rng = np.random.default_rng(7)
    vectors = [(int(i), rng.normal(size=8).round(2).tolist()) for i in rng.permutation(300)]
    vectors += [(1000 + i, vectors[0][1]) for i in range(20)]  # ties
    bad = [(2000, None), (2001, []), (2002, [float("nan")] * 8), (2003, [float("inf")] + [0.0] * 7), (2004, [None] + [0.0] * 7), (None, [0.0] * 8)]
    df = spark.createDataFrame(vectors + bad, "vec_id long, embedding array<double>").withColumn("number", F.lit("clash"))
    rows = [(i, np.floor(256 * np.array(v)).astype(np.int64)) for i, v in vectors]
    got = kdtree_search.top_k(df, 5, 10, shard_rows, 16)
    assert sorted(tuple(r) for r in got.collect()) == brute_top(rows, 5, 10)


def test_top_k_of_several_lengths(spark):
    rng = np.random.default_rng(8)
    vectors = [(i, rng.normal(size=(2, 1, 3, 20_000)[i % 4] if i < 100 else 2).round(2).tolist()) for i in range(160)] + [(200, []), (210, [])]
    got = kdtree_search.top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), 5, 10, 16, 4).collect()
    want = []
    for n in {len(v) for _, v in vectors}:
        want += brute_top([(i, np.floor(256 * np.array(v)).astype(np.int64)) for i, v in vectors if len(v) == n], 5, 10)
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_top_k_of_large_components(spark):
    rng = np.random.default_rng(9)
    vectors = [(i, (rng.normal(size=3) * 10.0 ** rng.integers(0, 7)).tolist()) for i in range(60)]
    whole = lambda v: [int(np.floor(256 * e)) for e in v]
    got = kdtree_search.top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), 5, 10, 16, 4).collect()
    want = []
    for q, v in vectors[::10]:
        scores = sorted((-sum(a * b for a, b in zip(whole(v), whole(w), strict=True)), c) for c, w in vectors if c != q)[:5]
        want += [(q, rank, c, -s) for rank, (s, c) in enumerate(scores, 1)]
    assert sorted(tuple(r) for r in got) == sorted(want)
    numbers = [-(10**30), -(10**20) - 1, -(10**20), -5, 0, 3, 10**20, 10**20 + 1]
    assert [kdtree_search.sortable(n) for n in numbers] == sorted(map(kdtree_search.sortable, numbers))
    huge = [(0, [1e308, 1.0]), (1, [1e308, 2.0]), (2, [1e300, 0.0]), (3, [-1e308, 0.0])]
    got = kdtree_search.top_k(spark.createDataFrame(huge, "vec_id long, embedding array<double>")).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(1, (1 << 63) - 1), (2, (1 << 63) - 1), (3, -(1 << 63))]


def test_top_k_without_broadcasts(spark):
    """Shards and blocks meet in one task whatever joins lie below."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    held = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        rng = np.random.default_rng(10)
        vectors = [(i, rng.normal(size=4).round(2).tolist()) for i in range(200)]
        got = kdtree_search.top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), 5, 10, 16, 4).collect()
    finally:
        spark.conf.set(key, held)
    rows = [(i, np.floor(256 * np.array(v)).astype(np.int64)) for i, v in vectors]
    assert sorted(tuple(r) for r in got) == brute_top(rows, 5, 10)


def test_top_k_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in kdtree_search.top_k(df).collect()] == [(0, 1, 1, 256 * 256 * 3)]
    assert kdtree_search.top_k(df.limit(0)).count() == 0


# Pages.


def page(body, head=""):
    return f"<html><head><title>t</title>{head}</head><body>{body}</body></html>"


def test_page_text():
    root = html_text.parse(page("<nav>menu</nav><article><h1>Head &amp; line</h1><p>One <b>t</b>wo.</p><script>x()</script><div class='ad-box'>buy</div><p>Three<br>four</article><section class='comments'><p>me too</p></section><footer>f</footer>"))
    html_text.digests(root)
    assert html_text.extract(root) == "Head & line One two. Three four"


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<div style='overflow:hidden'>a</div><p aria-hidden='false'>b</p><p title='hidden gems'>c</p><p hidden>d</p><p HIDDEN=''>e</p>", "a b c"),
        ("<div class='content has-sidebar'><p>The text of the page.</p></div><div class='sidebar'>x</div>", "The text of the page."),
        ("<div class='post share-enabled'><article><p>Text.</p><div class='share'>y</div></article></div><div>Long words beside the article.</div>", "Text."),
        ("<article>Text.</article><div class='comments'><article>A long comment on the text.</article></div>", "Text."),
        ("<main><p>One.</p></main><div>x</div><main><p>Two.</p></main>", "One. Two."),
        ("<div class='post no-comments'><p>a</p></div><div class='comments'>x</div><p>more of it</p>", "a more of it"),
        ("<div class='article-notice'><p>a</p></div><div class='notice'>x</div><p>more of it</p>", "a more of it"),
        ("<div class='share-buttons-enabled'><p>a</p></div><div class='share-buttons'>x</div><p>more of it</p>", "a more of it"),
        ("<article class='post related-posts-on'><p>a</p></article><div class='related-posts'><article>x</article></div>", "a"),
    ],
)
def test_only_what_is_no_text_is_dropped(body, want):
    root = html_text.parse(page(body))
    html_text.digests(root)
    assert html_text.extract(root) == want


def test_repeated_pages_keep_their_text(spark):
    same = page("<div>Menu</div><div><p>The same text.</p></div>")
    rows = [(i, "https://h.example/", same) for i in range(30)] + [(100 + i, f"https://h.example/{i}", page(f"<div>Menu</div><div><p>Text {i}.</p></div>")) for i in range(20)]
    # Pages of another host differ in an attribute-free remark only: all their elements recur.
    rows += [(200 + i, "https://g.example/", page(f"<div><p>All alike.</p></div><!-- {i} -->") + f"<p>{'x' * (i % 2)}</p>") for i in range(20)]
    rows += [(300, "https://long.example/", page("<p>" + "word &amp; " * 300_000 + "</p>"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract_text(df).collect()}
    assert {got[i] for i in range(30)} == {"The same text."}
    assert [got[100 + i] for i in range(20)] == [f"Text {i}." for i in range(20)]
    assert got[200] == "All alike." and got[300] == ("word & " * 300_000).strip()


def test_teasers_of_other_articles_go(spark):
    teaser = "<div><article>Read about lakes</article><article>Read about hills</article></div>"
    rows = [(i, f"https://h.example/{i}", page(f"<article><p>Text number {i}.</p></article>{teaser}")) for i in range(20)]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"Text number {i}." for i in range(20)}


def test_templates_equal_a_plain_count(spark):
    rng = random.Random(3)
    pool = [f"<div>Part {i}</div>" for i in range(12)]
    rows = [(i, f"https://h{i % 3}.example/{i}", page("".join(rng.sample(pool, 4)) + f"<p>{rng.randrange(60)}</p>")) for i in range(120)]
    rows += rows[:10]
    seen, pages = defaultdict(set), defaultdict(set)
    for _, url, text in rows:
        at = html_text.host(url)
        pages[at].add(text)
        for d in html_text.digests(html_text.parse(text)):
            seen[at, d].add(text)
    want = {at: sorted(d for (h, d), of in seen.items() if h == at and len(of) >= 8 and len(of) >= 0.3 * len(pages[at])) for at in pages}
    got = html_text.templates(spark.createDataFrame(rows, "page_id long, url string, html string"), share=0.3)
    assert {r.host: r.template for r in got.collect()} == {h: t for h, t in want.items() if t} and any(want.values())


def test_templates_of_sections_go(spark):
    rows = [(i, f"https://h.example/{i}", page(f"<div>Menu of section {i % 5}</div><div><p>Text number {i}.</p></div>")) for i in range(60)]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()
    assert [r.text for r in got] == [f"Text number {i}." for i in range(60)]


def test_template_goes_and_articles_stay(spark):
    rows = [(i, f"https://h.example/{i}", page(f"<div>Subscribe to our site</div><div><p>Text number {i}.</p></div>")) for i in range(20)]
    rows += [(100, "https://other.example/", page("<div>Subscribe to our site</div>")), (101, None, None), (102, "https://h.example/", ""), (103, "x", "<p>no end"), (103, "x", "<p>no end")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("__host", F.lit("clash")).withColumn("text", F.lit("clash"))
    got = [(r.page_id, r.text) for r in html_text.extract_text(df).orderBy("page_id").collect()]
    assert got[:20] == [(i, f"Text number {i}.") for i in range(20)]
    assert got[20:] == [(100, "Subscribe to our site"), (101, ""), (102, ""), (103, "no end"), (103, "no end")]
    assert html_text.extract_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"op5_token_file", "op10_packing", "op12_ordered_packing", "op13_block_max"}))
def test_queries_run(spark, name):
    df = queries.queries()[name](spark, SF)
    source = {"op4_kdtree_search": None, "op9_html_text": "pages"}.get(name, "documents")
    rows = df.count()
    assert rows == spark.read.parquet(f"{SF}/{source}.parquet").count() if source else rows
