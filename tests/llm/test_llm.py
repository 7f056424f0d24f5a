"""The numbered operators against brute force, on hostile rows and on a small table."""

import collections
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from promolens.llm import (
    op1_training_order as order,
    op2_ngram_jaccard_join as near,
    op3_chat_format as chat,
    op4_bpe as bpe,
    op5_url_filter as url,
    op6_substring_dedup as passages,
    op7_decontamination as leaks,
    op8_language_id as language,
    op9_exact_topk as topk,
    op10_toxicity as toxicity,
)
from promolens.llm.ship import ship
from promolens.llm.staging import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, g long, rest string"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def words(n, seed=0):
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 10**6, n))


@pytest.fixture(scope="module")
def rows():
    base, other = words(120, 1), words(90, 2)
    long = words(20_000, 3)
    texts = [
        base, base, base.replace("w", "W", 5), base + " extra tail", other, None, "", " \n\t ", "one two", "one two",
        long, words(40, 4) + " " + " ".join(base.split()[10:80]) + " " + words(40, 5), "a " * 60, "élan \u00a0 x",
        "bad idiot " + words(30, 6),
    ]
    out = [(i, t, "en", i, "x") for i, t in enumerate(texts)]
    return [*out, (0, base, None, None, None), (None, other, None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def tokens(text, lower=False):
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


def test_training_order(spark, docs, none, tmp_path):
    for n in (1, 2, 3, 100, 4097):
        assert sorted(order.permuted(np.arange(n), n, 5).tolist()) == list(range(n))
    staged = str(tmp_path / "docs")
    docs.write.parquet(staged)
    root = str(tmp_path / "shards")
    got = sorted(order.materialise(spark.read.parquet(staged), root, length=64, per_shard=16).collect(), key=lambda r: r.slot)
    bodies = list(order.read_slots(root, 0, len(got), 64, 16))
    assert [r.slot for r in got] == list(range(len(got)))
    assert all(zlib.crc32(b.tobytes()) == r.crc for b, r in zip(bodies, got))
    assert [b.tolist() for b in order.read_slots(root, 5, 40, 64, 16)] == [b.tolist() for b in bodies[5:40]]
    stream = b"".join(bodies[r.slot].tobytes()[: r.n_tokens] for r in sorted(got, key=lambda r: r.sequence))
    assert collections.Counter(stream.split(b"\xff")[:-1]) == collections.Counter((r.text or "").encode() for r in docs.collect())
    assert order.materialise(none, root).count() == 0


def test_similar_groups(docs, none, rows):
    sets = collections.defaultdict(set)
    for i, text, *_ in rows:
        w = tokens(text, True)
        if i is not None:
            sets[i] |= {tuple(w[k: k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
    group = {i: i for i in sets}
    link = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in link:
            group[a] = group[b] = min(group[a], group[b])
    degree = collections.Counter(x for pair in link for x in pair)
    got = near.similar_groups(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.n_links == 0
        else:
            assert (r.n_shingles, r.component_id, r.n_links) == (len(sets[r.doc_id]), group[r.doc_id], degree[r.doc_id])
    assert near.similar_groups(none).count() == 0
    kept = near.one_of_each(docs)
    assert kept.columns == docs.columns
    assert kept.where("doc_id is null").count() == 2 and kept.where("doc_id = 0").count() == 1 and kept.where("doc_id = 1").count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_substring_dedup(docs, none, rows):
    count = collections.Counter()
    for _, text, *_ in rows:
        w = tokens(text)
        count.update(tuple(w[k: k + 35]) for k in range(len(w) - 34))
    want = collections.Counter()
    for i, text, *_ in rows:
        w = tokens(text)
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if count[tuple(w[k: k + 35])] > 1:
                gone[k: k + 35] = [True] * 35
        kept = b" ".join(x for x, g in zip(w, gone) if not g).decode()
        want[i, len(w), sum(gone), kept] += 1
    out = passages.remove_repeats(docs)
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in out.collect()) == want
    assert set(docs.columns) < set(out.columns) and out.where("text is null").count() == 2
    assert passages.remove_repeats(none).count() == 0


def test_bpe(spark, docs, none):
    from tokenizers import Tokenizer

    path = bpe.vocabulary()
    library = Tokenizer.from_file(path)
    more = ["a<|endoftext|><|endoftext|> b", "a" * 5000, "\u0558x 1\u00b2\u0663 \u3000\u00a0!", "don't  \r\n\n x", "\x00\x7f\u200d😀"]
    df = docs.select("doc_id", "text", F.lit("x").alias("ids")).unionByName(spark.createDataFrame([(1000 + i, t, "x") for i, t in enumerate(more)], "doc_id long, text string, ids string"))
    both = bpe.round_trip(df, path).collect()
    for r in both:
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids
        assert r.decoded == library.decode(r.ids, skip_special_tokens=False) == (r.text or "")
    apart = bpe.decode(bpe.encode(df, path), path)
    assert sorted(map(str, apart.select("doc_id", "ids", "decoded").collect())) == sorted(str(r) for r in spark.createDataFrame(
        [(r.doc_id, r.ids, r.decoded) for r in both], "doc_id long, ids array<int>, decoded string").collect())
    odd = spark.createDataFrame([([50256, 10**6, -1, None, 0],), (None,), ([],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(odd, path).collect()] == ["<|endoftext|>!", None, ""]
    assert bpe.encode(none, path).count() == 0


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://Sub.Example.ORG/en/1570?x", "https://example.org/es/", "http://notexample.org/es/", "x://a.com/fr/1",
            "x://com/de/", "x://b.com/de", "x://a.b.com/de/x#y", "x://org", "x://org/?q", "http://a..org/ü/\U0010ffffz", "x://deep.example.org/en/2"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(0, urls[5], "clash")], "page_id long, url string, rule string")
    rules = spark.createDataFrame([*url.RULES, (None, "/", "block"), ("org", "/", "allow")], "host string, path string, verdict string")

    def expected(u):
        if u is None or "://" not in u:
            return "", "", None, "allow"
        import re
        host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", u.split("://", 1)[1]).groups()
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fit = [(len(h + p), len(h), h + p, v) for h, p, v in url.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fit)[2] if fit else None, max(fit)[3] if fit else "allow"

    got = [tuple(r) for r in url.judged(pages, rules).select("page_id", "url", "host", "path", "rule", "verdict").collect()]
    assert collections.Counter(got) == collections.Counter((i, u, *expected(u)) for i, u in [*enumerate(urls), (0, urls[5])])
    assert url.judged(pages.limit(0), rules).count() == 0


def test_decontamination(spark, docs, none, rows):
    text = {i: t for i, t, *_ in rows}
    items = [(1, " ".join(text[10].split()[500:540]).upper()), (2, " ".join(text[0].split()[:30]) + " " + words(5, 9)), (3, None), (4, "one two"), (5, words(30, 8)), (1, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    grams = lambda t, n: {tuple(w[k: k + n]) for w in [tokens(t, True)] for k in range(len(w) - n + 1)}
    want = collections.Counter()
    for d, t, *_ in rows:
        for i, x in items:
            n = min(5, len(tokens(x)))
            if n and 100 * len(grams(x, n) & grams(t, n)) >= 80 * len(grams(x, n)):
                want[d, i, len(grams(x, n)), len(grams(x, n) & grams(t, n))] += 1
    got = leaks.leaks(docs, bench)
    assert want and collections.Counter((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in got.collect()) == want
    assert leaks.leaks(none, bench).count() == 0 and leaks.leaks(docs, bench.limit(0)).count() == 0


def test_topk(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8))
    x[40:80] = x[40]
    vectors = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(300, None), (301, [None] * 8), (302, [float("nan")] * 8), (None, [1.0] * 8), (320, [1.0, 2.0]), (5, [float(c) for c in x[5]])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    q = np.floor(64 * x).astype(np.int64)
    want = []
    for i in range(0, 300, 20):
        best = sorted((-int(q[i] @ q[j]), j) for j in range(300) if j != i)[:20]
        want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert sorted(map(tuple, topk.top_products(df, F.col("vec_id") % 20 == 0).collect())) == want
    assert topk.top_products(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_language_and_toxicity(spark, docs, none):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.op8_language_id(spark, SF).join(d.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.9 * got.count()
    r = {x.doc_id: x for x in language.identified(docs).collect()}
    assert r[5].lang_pred == r[7].lang_pred == "und" and r[6].score == 0 and r[0].lang_pred == "en"
    assert language.identified(none).count() == 0
    labels = spark.createDataFrame([(i, 0, int(i in (14,))) for i in range(15)] + [(3, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    rated = toxicity.rated(docs, labels)
    assert rated.count() == docs.count() and rated.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.rated(docs, labels.limit(0)).where("predicted = 1").count() == 0 and toxicity.rated(none, labels).count() == 0
    t = toxicity.op10_toxicity(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    assert t.where("toxic = 0 and predicted = 1").count() <= 0.02 * t.where("toxic = 0").count()


def test_toxic_only_together(spark):
    def drawn(n, seed):
        rng, out = np.random.default_rng(seed), []
        for _ in range(n):
            toxic, half = int(rng.random() < 0.25), rng.random() < 0.5
            own = ["crows birds", "idiot"][half] if toxic else ["crows", "birds"][half]
            fill = [f"{chr(97 + x % 26)}{chr(97 + x // 26)}x" for x in rng.integers(0, 400, 30)]
            out.append((" ".join([*fill[:15], own, *fill[15:]]), toxic))
        return out

    # each of the two words is in half of the texts of either label
    texts = drawn(800, 1)
    docs = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, y) for i, (_, y) in enumerate(texts)], "doc_id long, quality int, toxic int")
    model, fresh = toxicity.learned(docs, labels), drawn(400, 2)
    got = model.scores(pa.array([x for x, _ in fresh])) >= toxicity.THRESHOLD
    both = np.array(["crows birds" in x for x, _ in fresh])
    other = np.array([not y for _, y in fresh])
    assert got[both].mean() > 0.9 and got[other].mean() < 0.05


def plain_viterbi(model, lines):
    """The best path state by state, from the model's probabilities alone."""
    seen = [chat.features(*x)[0] for x in lines]
    score = lambda t, s: sum(float(f[s, v]) for f, v in zip(model.seen, seen[t]))
    best = {s: (float(model.step[model.k, s]) + score(0, s), [s]) for s in range(model.k)}
    for t in range(1, len(seen)):
        came = {s: max(((v + float(model.step[b, s]), path) for b, (v, path) in best.items()), key=lambda x: x[0]) for s in best}
        best = {s: (v + score(t, s), [*path, s]) for s, (v, path) in came.items()}
    return max(best.values(), key=lambda x: x[0])[1]


def roles_by_line(turns):
    by = {}
    for r in sorted(turns, key=lambda r: (str(r.conv_id), r.part, r.turn)):
        by.setdefault(r.conv_id, []).extend([r.role] * r.n_lines)
    return by


def test_chat_roles_of_unseen_conversations(spark):
    turns = chat.transcripts(spark.read.parquet(f"{SF}/../sf0.01/conversations.parquet"))
    fresh = F.col("conv_id") % 5 == 0
    got = roles_by_line(chat.formatted(turns.where(fresh).drop("role"), chat.learned(turns.where(~fresh))).collect())
    want = {}
    for r in sorted(turns.where(fresh).collect(), key=lambda r: (r.conv_id, r.turn, r.text)):
        want.setdefault(r.conv_id, []).extend([r.role] * len(chat.lines_of(r.text)))
    assert got.keys() == want.keys() and all(len(got[c]) == len(want[c]) for c in want)
    hits = [a == b for c in want for a, b in zip(got[c], want[c])]
    assert len(hits) > 200 and sum(hits) >= 0.9 * len(hits), sum(hits) / len(hits)


def test_chat_joins_turns_over_parts(spark):
    learn = [(c, t, ("user", "assistant")[t % 2], ("User: What is it?", "Assistant: It is so.\nand so,\nand more,")[t % 2]) for c in range(40) for t in range(8)]
    model = chat.learned(spark.createDataFrame(learn, "conv_id long, turn long, role string, text string"))
    # one row a line: the answer to the last question goes on over three parts
    told = ["User: What is it?", "Assistant: It is so."] + ["and so,", "and more,"] * 80
    rows = [(conv, t, x) for conv in (1, None) for t, x in enumerate(told)]
    got = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, text string"), model).collect()
    mine = {c: sorted((r for r in got if r.conv_id == c), key=lambda r: (r.part, r.turn)) for c in (1, None)}
    path = plain_viterbi(model, [(x, True) for x in told])
    opens = sum(s % 2 == 0 for s in path)
    for c, own in mine.items():
        assert len(own) == opens and sum(r.n_lines for r in own) == len(told), c
        assert [r.role for r in own for _ in range(r.n_lines)] == [model.roles[s // 2] for s in path]
    assert max(r.n_lines for r in mine[1]) > 2 * chat.TURNS and {(r.part, r.turn) for r in mine[1]} == {(0, i) for i in range(opens)}
    text = max(mine[1], key=lambda r: r.n_lines).rendered
    assert text.endswith("and so,\nand more,\n<|end|>\n") and text.count("\n") == max(r.n_lines for r in mine[1]) + 2 - 1 + 1


def test_chat(spark):
    turns = [(1, i, r, t) for i, (r, t) in enumerate([("user", "Who?\nTell me."), ("assistant", "It is so.\nand so.\nYes."), ("user", "Why?")] * 60)]
    turns += [(2, 0, "user", "Hi?"), (2, None, "user", "x"), (None, 0, "system", "Be kind."), (3, 1, None, None), (3, 2, "user", ""), (2, 0, "user", "Hi?")]
    df = chat.transcripts(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    model = chat.learned(df)
    got = chat.formatted(df.drop("role"), model).collect()
    ours = sorted((r for r in got if r.conv_id == 1), key=lambda r: (r.part, r.turn))
    lines = [r.role for r in ours for _ in range(r.n_lines)]
    # parts give what one Viterbi pass over the whole transcript gives
    whole = [(x, i == 0) for r in sorted((r for r in df.collect() if r.conv_id == 1), key=lambda r: r.turn) for i, x in enumerate(chat.lines_of(r.text))]
    assert lines == [model.roles[s // 2] for s in plain_viterbi(model, whole)]
    assert sum(r.n_lines for r in got) == sum(len(chat.lines_of(r.text)) for r in df.collect()) and all(r.rendered.startswith("<|") for r in got)
    assert chat.formatted(df.drop("role").limit(0), model).count() == 0


def test_chat_keeps_lines(spark):
    answer = "Let me see.\n\nAnswer: 42\n    x = 1\n \n\nDone."
    turns = [(c, t, ("user", "assistant")[t % 2], "User: What is it?" if t % 2 == 0 else "Assistant: " + answer) for c in range(5) for t in range(6)]
    df = spark.createDataFrame([*turns, (9, 0, None, "\n\nUser: What is it?")], "conv_id long, turn long, role string, text string")
    got = chat.formatted(df.drop("role"), chat.learned(df)).collect()
    assert {r.rendered for r in got if r.role == "assistant"} == {chat.TURN.format(role="assistant", text=answer)}
    assert [r.rendered for r in got if r.conv_id == 9] == [chat.TURN.format(role="user", text="\n\nWhat is it?")]
    assert sum(r.n_lines for r in got) == 5 * (3 + 3 * 4) + 1


def test_chat_learns_from_all_turns(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string"
    few = [(None, 0, "user", "Who?"), (None, 1, "assistant", "It is so.")]
    roles = [f"r{i:02}" for i in range(20)]
    many = [(c, t, role, f"R{role[1:]}x: {'w ' * (3 * i)}") for c in range(3) for t, (i, role) in enumerate(enumerate(roles))]
    for name, rows in (("few", few), ("many", many)):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name / "conversations.parquet"))
        assert sum(r.n_lines for r in chat.op3_chat_format(spark, str(tmp_path / name)).collect()) == len(rows)
    assert chat.learned(spark.createDataFrame(many, schema)).roles == roles
    # nothing to learn: the rows themselves, with all their text
    bare = spark.createDataFrame([(1, 0, None, "User: Hi?\n\nA: b"), (1, 1, None, "So."), (1, 2, None, None)], schema)
    got = sorted(chat.formatted(bare.drop("role"), chat.learned(bare)).collect(), key=lambda r: r.turn)
    assert [(r.role, r.n_lines, r.rendered) for r in got] == [
        (None, 2, chat.TURN.format(role="", text="User: Hi?\n\nA: b")), (None, 1, chat.TURN.format(role="", text="So."))]


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert 0 < out.count() < n and out.where("not round_trip").count() == 0
    assert out.select("doc_id").distinct().count() == out.count()
