"""Nothing is lost: large vectors, short items, stale shards, rows that share an id, clashing columns; the pipeline by brute force."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from promolens.llm import op1_training_order as order
from promolens.llm import op2_ngram_jaccard_join as near
from promolens.llm import op5_url_filter as url
from promolens.llm import op7_decontamination as leaks
from promolens.llm import op9_exact_topk as topk
from promolens.llm import exchange, staging
from promolens.llm.ship import ship

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, leaks int, n_words string, row int"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def words(n, seed):
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 10**6, n))


def test_large_vectors_take_part(spark):
    rng = np.random.default_rng(4)
    x = [[float(c) for c in v] for v in rng.normal(size=(60, 3))]
    x[0], x[7], x[20], x[41] = [4e7, 1.0, -3e9], [1e12, -2.5, 0.0], [2.0**60, 0.0, 0.5], [-4e7, 4e7, 1.0]
    df = spark.createDataFrame([*enumerate(x), (70, [float("inf"), 0.0, 0.0])], "vec_id long, embedding array<double>")
    q = [[int(np.floor(64 * c)) for c in v] for v in x]
    clip = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    want = []
    for i in range(0, 60, 20):
        best = sorted((-clip(sum(a * b for a, b in zip(q[i], q[j]))), j) for j in range(60) if j != i)[:20]
        want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert sorted(map(tuple, topk.top_products(df, F.col("vec_id") % 20 == 0).collect())) == want


def test_short_items_are_found(spark):
    docs = spark.createDataFrame([(1, words(30, 1) + " one two Three four " + words(30, 2)), (2, "solo"), (3, words(9, 3)), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three four"), (2, "SOLO"), (3, "two one"), (4, ""), (5, words(9, 3))], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.n_item) for r in leaks.leaks(docs, items).collect()) == [(1, 1, 1), (2, 2, 1), (3, 5, 5)]


def test_changed_text_replaces_shards(spark, tmp_path):
    root = str(tmp_path / "shards")
    for n, (text, key) in enumerate((("a" * 500, 1), ("b" * 500, 1), ("b" * 500, 2))):
        path = str(tmp_path / f"docs{n}")
        spark.createDataFrame([(1, text), (2, "c" * 300)], "doc_id long, text string").coalesce(1).write.parquet(path)
        got = sorted(order.materialise(spark.read.parquet(path), root, key=key, length=64, per_shard=4).collect(), key=lambda r: r.slot)
        found = [b.tobytes() for b in order.read_slots(root, 0, len(got), 64, 4)]
        body = (text + "\xff" + "c" * 300 + "\xff").encode("latin-1")
        assert [found[r.slot][: r.n_tokens] for r in sorted(got, key=lambda r: r.sequence)] == [body[i: i + 64] for i in range(0, len(body), 64)]


def test_rows_that_share_an_id_are_judged_by_text(spark):
    a, b, c = words(80, 1), words(80, 2), words(80, 3)
    rows = [(1, a), (1, b), (2, a + " tail"), (2, c), (3, b), (3, b), (4, c), (None, a), (5, None), (5, "")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, number string")
    got = near.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in got.collect()) == sorted([(1, a), (1, b), (2, c), (-1, a), (5, ""), (5, "")])


def test_sweep_of_a_hot_host_is_dealt_by_salt(spark, monkeypatch):
    monkeypatch.setattr(url, "KEYS_PER_SALT", 50)
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.example.org/{'es' if i % 2 else 'en'}/{i}") for i in range(600)], "page_id long, url string")
    rules = spark.createDataFrame(url.RULES, "host string, path string, verdict string")
    got = url.judged(pages, rules)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(at" in plan and "salt" in plan.split("REPARTITION_BY_COL")[0].rsplit("hashpartitioning(at", 1)[1]
    want = {i: "example.org/es/" if i % 2 else "example.org/en/1" if str(i).startswith("1") else "org/" for i in range(600)}
    assert {r.page_id: r.rule for r in got.collect()} == want


def test_no_machine_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.shared_dir(Session())


def grams(text, n):
    w = [x.lower() for x in (text or "").encode().split()]
    return {tuple(w[i: i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def by_hand(rows, items, toxic):
    """(doc_id, text) after the stages, and their token ids."""
    from tokenizers import Tokenizer

    from promolens.llm import op4_bpe as bpe

    rows = [(i, t) for i, t in rows if not (t and toxic in t)]
    sets, group = [grams(t, 5) for _, t in rows], list(range(len(rows)))
    link = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None
            and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in rows:
        for a, b in link:
            group[a] = group[b] = min(group[a], group[b])
    first = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            first[group[k]] = min(first.get(group[k], (i, k)), (i, k))
    rows = [r for k, r in enumerate(rows) if r[0] is None or first[group[k]] == (r[0], k)]
    seen = collections.Counter(tuple(w[k: k + 50]) for _, t in rows for w in [(t or "").split()] for k in range(len(w) - 49))
    cut = []
    for i, t in rows:
        w = (t or "").split()
        gone = {j for k in range(len(w) - 49) if seen[tuple(w[k: k + 50])] > 1 for j in range(k, k + 50)}
        cut.append((i, " ".join(x for j, x in enumerate(w) if j not in gone) if gone else t))
    kept = [(i, t) for i, t in cut if not any(x and 100 * len(x & grams(t, 5)) >= 80 * len(x) for x in (grams(s, 5) for s in items))]
    tok = Tokenizer.from_file(bpe.vocabulary())
    return collections.Counter((i, tuple(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in kept)


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_by_hand(spark, tmp_path, empty):
    import corpus_pipeline

    shared, item = words(60, 501), words(20, 502)
    rows = [(i, words(80, i)) for i in range(90)]
    rows += [(100 + i, f"{words(40, 200 + i)} idiot {words(40, 300 + i)}") for i in range(60)]
    rows += [(200, rows[3][1]), (201, rows[4][1] + " tail"), (202, rows[4][1] + " tail end"), (203, words(30, 7) + " " + shared + " " + words(30, 8)),
             (204, words(30, 9) + " " + shared), (205, words(100, 10) + " " + item + " " + words(100, 11)), (206, None), (207, ""), (208, " \n "),
             (209, "short text"), (210, words(6000, 12)), (5, words(80, 600)), (6, rows[6][1]), (None, rows[7][1]), (None, words(60, 13))]
    full = [] if empty else [(i, t, "en", "s", None if t is None else len(t), 0.5, "kept", 7, "n", 3) for i, t in rows]
    docs = spark.createDataFrame(full, DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 0, int("idiot" in t)) for i, t in rows[:150]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item), (2, None), (3, words(15, 700))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in out) == (collections.Counter() if empty else by_hand(rows, [item, None, words(15, 700)], "idiot"))
    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, step in corpus_pipeline.STAGES[:-1]:
        kept = step(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
    if not empty:
        assert {(r.score, r.kept, r.leaks, r.n_words, r.row) for r in kept.collect()} == {(0.5, "kept", 7, "n", 3)}
        slim = docs.drop("n_chars")
        assert corpus_pipeline.without_passages(spark, slim, str(tmp_path)).columns == slim.columns


def test_a_group_asks_only_buckets_that_it_has_hashes_in():
    rng = np.random.default_rng(1)
    for n, buckets in ((0, 7), (1, 1), (50, 100_000), (5000, 3)):
        h = np.sort(rng.integers(0, 2**64, n, dtype=np.uint64))
        low, extra = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.ones(n, np.uint8)
        rows = exchange.request(3, h, low, extra, buckets).to_pylist()
        assert [r["bucket"] for r in rows] == sorted(set(exchange.bucket_of(h, buckets).tolist()))
        assert b"".join(r["res"] for r in rows) == low.tobytes() and b"".join(r["extra"] for r in rows) == extra.tobytes()
