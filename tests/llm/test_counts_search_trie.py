"""Operators 11 to 13 against the library, brute force and a plain trie."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from promolens.llm import op11_token_counts as counts
from promolens.llm import op12_lexical_search as search
from promolens.llm import op13_prefix_trie as prefix
from promolens.llm.keys import WIDTH, KeyTable, keys_of, spans
from promolens.llm.ship import ship

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " \n\t ", "It's 've 'RE ''s !'s 'rest 12 ½ ٣", "<|endoftext|>a<|startoftext|><|ENDOFTEXT|><|", "İstanbul ΑΣ Å é ﬁ", "中文 한글 😀‍😀",
    "x" * 5000, "word " * 20_000, "a\x00b \x85 　z", "\U0001d400͸﷐", "dup", "dup", "Ǆungla ẞ ŉ", "don't",
]


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


# --- keys


def test_key_table_is_exact():
    rng = random.Random(3)
    words = list({bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(1, WIDTH))) for _ in range(3000)})
    known, other = words[::2], words[1::2]
    table = KeyTable(*keys_of(*spans(known)), np.arange(len(known)))
    slot = table.find(*keys_of(*spans(known)))
    assert (table.value[slot] == np.arange(len(known))).all()
    assert (table.find(*keys_of(*spans(other))) == -1).all()
    assert (KeyTable(*keys_of(*spans([])), np.zeros(0)).find(*keys_of(*spans(known))) == -1).all()


# --- op 11


def library(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(counts.vocabulary())
    return [len(e.ids) for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("seed", [1, 2])
def test_pre_tokens_of_random_characters(seed):
    rng = random.Random(seed)
    some = ["'s", "'VE", "'", "<|endoftext|>", "é", "é", "7", " ", "\t", "the", "Σς", "İ"]
    planes = [(0, 0x2FF), (0, 0xD7FF), (0xE000, 0x10FFFF)]
    texts = ["".join(rng.choice(some) if rng.random() < 0.6 else chr(rng.randint(*rng.choice(planes))) for _ in range(30)) for _ in range(3000)]
    pre = counts.PreTokens(counts.vocabulary_text(counts.vocabulary()))
    words = [b"the", b"'s", "é".encode()]
    table = KeyTable(*keys_of(*spans(words)), np.array([pre.length(w) for w in words], np.uint8))
    assert pre.counts(pa.array(texts), table).tolist() == library(texts)


def test_token_counts_of_odd_rows(spark):
    rows = [(i, t, "x", i) for i, t in enumerate(ODD)] + [(None, "dup", None, 0), (3, "dup", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rest string, n_tokens int")
    got = counts.token_counts(docs, counts.vocabulary())
    assert sorted(got.columns) == ["doc_id", "n_tokens", "rest", "text"]
    want = collections.Counter(zip([r[0] for r in rows], library([r[1] for r in rows]), strict=True))
    assert collections.Counter((r["doc_id"], r["n_tokens"]) for r in got.collect()) == want
    assert counts.token_counts(docs.limit(0), counts.vocabulary()).collect() == []


def test_cache_and_table_do_not_change_counts(monkeypatch):
    pre = counts.PreTokens(counts.vocabulary_text(counts.vocabulary()))
    monkeypatch.setattr(counts, "CACHE_WORDS", 3)
    none = KeyTable(*keys_of(*spans([])), np.zeros(0, np.uint8))
    texts = [f"word{i} unseen{i * 7} the" for i in range(50)]
    for _ in range(2):
        assert [int(pre.counts(pa.array([t]), none)[0]) for t in texts] == library(texts)


def test_op11_query(spark):
    got = {r["doc_id"]: r for r in counts.op11_token_counts(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    for r, n in zip(docs, library([r["text"] for r in docs]), strict=True):
        x = got[r["doc_id"]]
        assert (x["n_tokens"], x["n_bytes"], x["over_limit"]) == (n, len((r["text"] or "").encode()), n > 2048)


# --- op 12


def terms(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def ranked(docs, items, k=20):
    bags = [(d, collections.Counter(terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    out = []
    for item, text in {(i, t) for i, t in items}:
        scores = []
        for d, b in bags:
            m = 75 + 25 * sum(b.values()) * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * b[t] // (1000 * b[t] + 12 * m)) for t in terms(text))
            scores += [(-s, d is not None, d)] if s > 0 else []
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return collections.Counter(out)


@pytest.mark.parametrize("block", [1 << 22, 64])
def test_search_is_exact_on_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(search, "ITEM_BLOCK", block)
    rng = random.Random(5)
    common = ["the", "The", "of", "straße", "naïve", "x1", "longlonglonglonglongword", "中文字符没有空格的文本", "İx"]
    texts = [" ".join(rng.choice(common) if rng.random() < 0.4 else f"w{rng.randint(0, 60)}" for _ in range(rng.randint(0, 30))) for _ in range(400)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (None, "the of x1"), (901, None), (902, ""), (903, "?!"), (904, "w1 " * 30_000), (-5, texts[9])]
    items = [(i, " ".join(rng.sample(common, 3) + [f"w{rng.randint(0, 60)}", "w1,w1"])) for i in range(12)]
    items += [(3, "another text w5"), (50, None), (51, "..."), (52, "unheardof"), (None, "w2 naïve"), items[0]]
    frame = spark.createDataFrame([(*d, 0, "x") for d in docs], "doc_id long, text string, score int, item_id string").repartition(3)
    query = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, rank int")
    got = search.best_documents(frame, query)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert collections.Counter(tuple(r) for r in got.collect()) == ranked(docs, [i for i in items if terms(i[1])])


def test_search_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.best_documents(docs.limit(0), items).collect() == []
    assert search.best_documents(docs, items.limit(0)).collect() == []
    assert search.best_documents(docs.withColumn("text", F.lit(" ")), items).collect() == []


def test_bounds_never_fall_below_scores(monkeypatch):
    monkeypatch.setattr(search, "COORDS", 4)  # nearly every term meets another one
    texts = [" ".join(f"t{(i * j) % 17}" for j in range(1, 20 + i)) for i in range(40)]
    items = search.Items([1, 2], ["t1 t2 t3 t3", "t16 t5 unknown"])
    block = search.Block(pa.array(texts), items, 40, 2000)
    items.weigh(40, np.full(items.size, 5))
    for term, weight in zip(items.flat, items.weight):
        exact = block.exact(np.arange(40), term, weight)
        assert (block.bounds(term, weight, items.coords) >= exact).all() and exact.any()


# --- op 13


def plain_trie(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    nodes = collections.defaultdict(list)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    children = collections.Counter(p[:-1] for p in nodes if p)
    saved, leaves = collections.Counter(), collections.Counter()
    for p, members in nodes.items():
        value = (len(members) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += value
            leaves[p[:d]] += not children[p]
    return {
        (min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
         hashlib.sha256(",".join(str(c) for c in sorted(m) if len(full[c]) == len(p)).encode()).hexdigest())
        for p, m in nodes.items()
    }


def of_trie(spark, rows):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, b string")
    got = prefix.trie(*prefix.rebuilt(frame.repartition(4))).collect()
    found = {tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in got}
    assert len(found) == len(got)
    return found


def test_trie_of_odd_and_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix, "RUN_WIDTH", 8)
    rng = random.Random(9)
    rows = []
    for c in [*range(-25, 60), 20_000, 20_001]:
        n = rng.choice([1, 1, 2, 3, 5, 8, 9, 16, 17])
        rows += [(c, t, rng.choice(["user", None]), f"w{rng.randint(0, 1)} b") for t in range(n)]
    same = [(t, "user", f"turn {t % 3}") for t in range(150)]
    for c in (100, 101, 104, 107, 120, 140):  # shared for 90 turns or more, over two levels of blocks
        rows += [(c, *x) for x in same[: 90 + (c % 7) * 9]]
    rows += [(200 + c, *x) for c in range(30) for x in same[:8]]  # copies that end at a block's border
    rows += [(300, None, None, None), (301, None, "user", ""), (302, 1, "user", None), (303, 5, "", "x " * 5000), (None, 1, "user", "lost")]
    rows += [(310, 4, "user", "twice")] * 5 + [(311, 4, "user", "twice")] * 5
    assert of_trie(spark, rows) == plain_trie(rows)


def test_trie_without_turns_and_without_rows(spark):
    rows = [(c, 0, "user", "x") for c in range(1, 400) if zlib.crc32(str(c).encode()) % 4 and c % 20]
    rows = [r for r in rows if r[0] // 20 in (3, 7)]  # their first one is absent: nothing is left of them
    assert of_trie(spark, rows) == plain_trie(rows) and len(plain_trie(rows)) == 1
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix.trie(*prefix.rebuilt(empty)).collect() == []


def test_op13_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {tuple(r) for r in prefix.op13_prefix_trie(spark, SF).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()}
    assert got == plain_trie(rows)
