"""Fill-in-the-middle, order-preserving packing and ranked lexical search against brute force."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given
from hypothesis import settings as limits
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from geolith.llm import block_max, fill_middle, ordered_packing, queries, wordtokens
from geolith.llm.bpe import read_vocabulary

SF = "/root/testdata/sf0.001"
UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")
ODD = [None, "", " ", "a", "one two  three.\n\nFour!", "a <P> b", "<S", "x<M>", "é日本😀 ß İ \x1c²½", "a" * 5000, "日本" * 700, "ab1" * 900, "<", ">S>P>", "\x00 nul", "a b" * 4000]


def documents(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"output": F.lit("clash"), "n": F.lit(1), "a.b": F.lit(2), "ids": F.lit(None).cast("string")}) if extra else df


@limits(max_examples=150, deadline=None)
@given(st.text(alphabet="abZ é日😀<>P\n1", max_size=60), st.integers(1, 9), st.integers(1, 17))
def test_checkpoints_cut_where_units_end(text, step, window):
    units = UNIT.findall(text)
    index = fill_middle.CheckpointIndex(text.encode(), step, window)
    assert (index.n_units, index.n_points) == (len(units), len(text))
    assert len(index.units) == -(-len(units) // step)
    for k in range(len(units) + 1):
        head = "".join(units[:k])
        assert index.cut(k) == (len(head.encode()), len(head))


def expected_fim(doc_id, text, seed=1):
    text, units = text or "", UNIT.findall(text or "")
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_middle_and_its_restoration(spark):
    rng = random.Random(3)
    made = ["".join(rng.choice("ab Cé日😀<PSM>.\n") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    rows = [(i if i != 7 else None, t) for i, t in enumerate(ODD + made)] + [(3, "a"), (3, "a")]
    found = fill_middle.transform(documents(spark, rows, extra=True))
    got = found.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert sorted([tuple(r)[:6] for r in got], key=repr) == sorted([expected_fim(*r) for r in rows], key=repr)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert Counter((r.doc_id, r.back) for r in got) == Counter((i, t or "") for i, t in rows)
    assert fill_middle.transform(documents(spark, rows).limit(0)).count() == 0


def test_fill_middle_query(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {r["doc_id"]: (*(x := expected_fim(r["doc_id"], r["text"]))[1:5], sha(x[5]), sha(r["text"] or "")) for r in docs}
    assert {r[0]: tuple(r)[1:] for r in queries.QUERIES["op11_fill_middle"](spark, SF).collect()} == want


# Packing.


def padding(length, capacity):
    return 0 if length & (length - 1) == 0 else capacity - length


def least_cost(at, cost, capacity):
    best = [0.0] + [math.inf] * (len(at) - 1)
    for j in range(1, len(at)):
        for i in range(j):
            if at[j] - at[i] <= capacity:
                best[j] = min(best[j], best[i] + padding(at[j] - at[i], capacity) + cost[j] + 1)
    return best[-1]


@limits(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 90), min_size=1, max_size=12), st.sampled_from([4, 16, 20, 64]), st.randoms(use_true_random=False))
def test_cuts_cost_least(sizes, capacity, rng):
    sentences = [np.array(sorted(rng.sample(range(1, n), min(n - 1, rng.randint(0, 4)))), np.int64) for n in sizes]
    at, cost = ordered_packing.places(sizes, sentences, capacity, 8.0, 24.0)
    bounds = ordered_packing.cuts(at, cost, capacity)
    assert bounds[0] == 0 and bounds[-1] == sum(sizes)
    assert all(0 < b - a <= capacity for a, b in zip(bounds, bounds[1:], strict=False))
    price = dict(zip(at.tolist(), cost.tolist(), strict=True))
    assert sum(padding(b - a, capacity) + price[b] + 1 for a, b in zip(bounds, bounds[1:], strict=False)) == pytest.approx(least_cost(at.tolist(), cost.tolist(), capacity))
    where, begun = [], 0
    for doc, n in enumerate(sizes):
        where += [(doc, i) for i in range(n)]
        begun += n
    flat = [(doc, start + i, sequence, offset + i) for doc, start, length, sequence, offset in ordered_packing.pieces_of(sizes, bounds) for i in range(length)]
    assert [x[:2] for x in flat] == where
    assert [x[2:] for x in flat] == [(k, i) for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)) for i in range(b - a)]


def library():
    out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out.no_truncation()
    out.no_padding()
    return out


def check_pieces(rows, docs, capacity, share):
    """rows: doc_id, start, length, crc, doc_tokens, sequence_id, offset; docs: doc_id and text, each doc_id once."""
    theirs, tokens = library(), 0
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        of_doc[r[0]].append(r)
        of_sequence[r[5]].append(r)
    assert set(of_doc) == {d for d, _ in docs}
    for doc_id, text in docs:
        ids = np.array([*theirs.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at, tokens = 0, tokens + len(ids)
        for _, start, length, crc, doc_tokens, _, _ in sorted(of_doc[doc_id], key=lambda r: r[1]):
            assert (start, doc_tokens, crc) == (at, len(ids), zlib.crc32(ids[at : at + length].tobytes())) and length > 0
            at += length
        assert at == len(ids)
    lost, order = 0, []
    for sequence in sorted(of_sequence):
        at = 0
        for doc_id, start, length, *_, offset in sorted(of_sequence[sequence], key=lambda r: r[6]):
            assert offset == at
            at += length
            order.append((-1 if doc_id is None else doc_id, start))
        assert at <= capacity
        lost += padding(at, capacity)
    assert order == sorted(order)
    assert lost <= share * tokens


def test_ordered_packing_query(spark):
    rows = [tuple(r) for r in queries.QUERIES["op12_ordered_packing"](spark, SF).collect()]
    check_pieces(rows, [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()], 2048, 0.01)


def test_ordered_packing_of_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(ordered_packing, "STRETCH", 300)  # seen by the places alone; workers hold their own
    rows = [(i if i else None, t) for i, t in enumerate(ODD)]
    for capacity in (64, 100):
        found = ordered_packing.pack_in_order(documents(spark, rows, extra=True), capacity=capacity).withColumn("crc", F.crc32("ids"))
        got = [tuple(r) for r in found.select("doc_id", "start", "length", "crc", "doc_tokens", "sequence_id", "offset").collect()]
        check_pieces(got, rows, capacity, 0.2)
    assert ordered_packing.pack_in_order(documents(spark, rows).limit(0)).count() == 0


def test_repeated_rows_are_packed_each(spark):
    rows = [(5, "one two three. four five.")] * 400 + [(None, None)] * 3
    got = ordered_packing.pack_in_order(documents(spark, rows), capacity=32).collect()
    ids = [*library().encode(rows[0][1], add_special_tokens=False).ids, 1]
    assert sum(r.length for r in got) == 400 * len(ids) + 3
    assert sum(len(r.ids) for r in got) == 4 * sum(r.length for r in got)
    assert Counter(r.start for r in got if r.doc_id == 5)[0] == 400


def test_sentences_end_at_marks():
    encoder = wordtokens.WordTokens(read_vocabulary(public_tokenizers.path("word_bpe_49k.json")))
    ends = lambda t: ordered_packing.Sentences(encoder).of(np.frombuffer(encoder.encode(t), "<u4")).tolist()
    count = lambda t: len(encoder.encode(t)) // 4
    assert ends("one two. three") == [count("one two.")]
    assert ends("one two?! \"yes.\" three") == [count("one two?!\""[:-1]), count("one two?! \"yes.\"")] or ends("one two?! \"yes.\" three") == [count("one two?! \"yes.\"")]
    assert ends("pi is 3.14 or so") == [] and ends("the end.") == [] and ends("") == []


# Search.


def brute(docs, items, k=50):
    word = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = lambda t: word.findall((t or "").translate(low))
    held = [(d, Counter(terms(t))) for d, t in docs if d is not None]
    held = [(d, c) for d, c in held if c]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = defaultdict(set)
    for item, text in items:
        if item is not None:
            asked[item] |= set(terms(text))
    out = []
    for item, own in asked.items():
        scores = []
        for d, c in held:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if score > 0:
                scores.append((-score, d))
        out += [(item, r + 1, d, -s) for r, (s, d) in enumerate(heapq.nsmallest(k, scores))]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


def test_block_max_query(spark):
    docs, items = (pq.read_table(f"{SF}/{t}.parquet").to_pylist() for t in ("documents", "benchmark"))
    want = brute([(r["doc_id"], r["text"]) for r in docs], [(r["item_id"], r["text"]) for r in items])
    assert rows_of(queries.QUERIES["op13_block_max"](spark, SF)) == want


def test_search_of_odd_rows(spark):
    rng = random.Random(5)
    words = ["the", "of", "É", "日本", "x1", *(f"w{i}" for i in range(60))]
    docs = [(i, " ".join(rng.choices(words, weights=[40, 30, 10, 10, 10, *[1] * 60], k=rng.randint(1, 60)))) for i in range(900)]
    docs += [(900 + i, t) for i, t in enumerate(ODD)] + [(None, "the of"), (5, "the w1"), (5, "the w1"), (-4, "THE w1")]
    docs += [(2000 + i, "the same copy w2 w3") for i in range(200)]
    items = [(1, "The w1 w2 É"), (2, None), (3, ""), (4, "absent words"), (5, "of of of"), (6, " ".join(words)), (6, "copy"), (7, "same"), (None, "the")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("term", F.lit(1)).repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("part", F.lit("x"))
    for k in (1, 3, 50, 5000):
        assert rows_of(block_max.search(block_max.build(df), asked, k)) == brute(docs, items, k)
    assert rows_of(block_max.search(block_max.build(df.limit(0)), asked)) == []
    assert rows_of(block_max.search(block_max.build(df), asked.limit(0))) == []


def test_queries_in_several_parts(spark, monkeypatch):
    monkeypatch.setattr(block_max, "QUERIES", 4)
    docs, items = (pq.read_table(f"{SF}/{t}.parquet").to_pylist() for t in ("documents", "benchmark"))
    found = block_max.search(block_max.build(spark.read.parquet(f"{SF}/documents.parquet")), spark.read.parquet(f"{SF}/benchmark.parquet"), 7)
    assert rows_of(found) == brute([(r["doc_id"], r["text"]) for r in docs], [(r["item_id"], r["text"]) for r in items], 7)


@limits(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**34), min_size=1, max_size=50))
def test_varints_come_back(values):
    data, ends = block_max.varints(np.array(values, np.int64))
    assert block_max.from_varints(data).tolist() == values and len(ends) == len(values)


def shard_of(texts, weights):
    n = block_max.term_counts(pa.array(texts))
    rows = block_max.shard_rows(0, np.arange(len(texts)), pa.array(texts), len(texts), int(n.sum()))
    table = pa.Table.from_batches([rows])
    table = table.filter(pa.compute.not_equal(table.column("term"), ""))
    table = table.append_column("weight", pa.array([weights.get(t, 1) for t in table.column("term").to_pylist()], pa.int64()))
    return block_max.Shard(table.combine_chunks(), len(texts)), table.column("term").to_pylist()


def test_blocks_below_the_threshold_stay_compressed():
    rng = random.Random(2)
    texts = ["the of and " + " ".join(f"w{rng.randint(0, 400)}" for _ in range(12)) for _ in range(4000)]
    for i in (17, 1500):
        texts[i] += " rare " * 3
    shard, terms = shard_of(texts, {"the": 1, "of": 1, "and": 1, "rare": 9000})
    asked = [terms.index(t) for t in ("the", "of", "and", "rare")]
    best = block_max.block_max_wand(shard, asked, 2)
    assert sorted(d for _, d in best) == [17, 1500]
    assert sum(int(x.sum()) for x in shard.open) < sum(len(shard.lasts[t]) for t in asked) / 3
    every, _ = shard_of(texts, {"the": 1, "of": 1, "and": 1, "rare": 9000})
    assert block_max.block_max_wand(every, asked, 4000)[:2] == best
