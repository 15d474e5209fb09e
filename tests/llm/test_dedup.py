"""Near-duplicates, repeated strings, leaks, vectors, toxicity and the pipeline against brute force."""
import numpy as np
import pytest

import corpus_pipeline
from cohortspark.llm import decontaminate, near_dedup, substring_dedup, toxicity, vector_dedup
from cohortspark.llm.components import components

SF = "/root/testdata/sf0.001"


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (9, 9), (3, 2), (None, 1), *[(100, i) for i in range(101, 140)], *[(i, i + 1) for i in range(200, 230)]]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**dict.fromkeys((1, 2, 3), 1), 4: 4, 5: 4, **dict.fromkeys(range(100, 140), 100), **dict.fromkeys(range(200, 231), 200)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates(spark, make_docs, words):
    base = words(300, 1)
    near = base.split()
    near[100] = "changed"
    texts = [base, base, " ".join(near), words(300, 2), None, "", "one two", "One two", "three", words(40_000, 3)]
    rows = near_dedup.near_duplicates(make_docs(texts)).orderBy("doc_id").collect()
    assert [r["class_id"] for r in rows] == [0, 0, 0, 3, 4, 4, 6, 6, 8, 9]
    assert [r["kept"] for r in rows] == [True, False, False, True, True, False, True, False, True, True]
    assert near_dedup.near_duplicates(make_docs([])).count() == 0
    assert len({r["class_id"] for r in near_dedup.near_duplicates(make_docs([base] * 3, [None, 7, 7])).collect()}) == 1


def test_near_group_of_many_edits(spark, make_docs, words):
    rows = []
    for i in range(60):
        w = words(400, 9).split()
        w[i * 6] = f"edit{i}"
        rows.append(" ".join(w))
    assert {r["class_id"] for r in near_dedup.near_duplicates(make_docs([words(400, 8), *rows])).collect()} == {0, 1}


def test_near_star_groups(spark, make_docs, words):
    """Copies near their original but not near each other are one class, whichever of them head the bands."""
    import random
    texts = []
    for g in range(40):
        original = words(400, 500 + g).split()
        texts.append(" ".join(original))
        for c in range(8):
            w, rng = list(original), random.Random(100 * g + c)
            for i in rng.sample(range(400), 8):
                w[i] = f"edit{g}x{c}x{i}"
            texts.append(" ".join(w))

    def grams(t):
        w = t.split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}

    sets = [grams(t) for t in texts]
    alike = [len(sets[9 * g] & sets[9 * g + c]) / len(sets[9 * g] | sets[9 * g + c]) for g in range(40) for c in range(1, 9)]
    assert sum(a >= 0.8 for a in alike) > 0.9 * len(alike)
    # brute force over all pairs of a group (other groups share nothing)
    want = list(range(len(texts)))
    for g in range(40):
        rows = range(9 * g, 9 * g + 9)
        for _ in rows:
            for i in rows:
                for j in rows:
                    if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                        want[i] = want[j] = min(want[i], want[j])
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(make_docs(texts)).collect()}
    whole = [g for g in range(40) if all(got[i] == want[i] for i in range(9 * g, 9 * g + 9))]
    split = sum(got[i] != want[i] for i in range(len(texts)))
    assert split <= 3 and len(whole) >= 37, (split, len(whole))


@pytest.mark.parametrize("rows", [512, 3])
def test_settled_groups(spark, rows, monkeypatch):
    """Links that no head sees are found in blocks, and a chain ends in one component."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", rows)
    base = rng.integers(1, 1 << 40, near_dedup.SAMPLES)
    shingles = np.arange(1000, dtype=np.uint64)
    keys = [bytes([i]) * 16 for i in range(12)]
    state = spark.createDataFrame([(bytearray(k), base.tolist(), bytearray(k)) for k in keys], "key binary, samples array<long>, root binary")
    members = spark.createDataFrame([(7, 0, bytearray(k), bytearray(keys[0])) for k in keys], "at long, band int, key binary, head binary")
    # row i is linked to row i + 1 only: shingles [100 i, 100 i + 1000)
    feats = spark.createDataFrame([(bytearray(k), bytearray((shingles + np.uint64(100 * i)).tobytes()), bytearray(np.ones(1000, np.float32).tobytes())) for i, k in enumerate(keys)],
                                  "key binary, shingles binary, weights binary")
    links = near_dedup._settle(state, members, feats, 0.8)
    assert {frozenset((keys.index(bytes(r.u)), keys.index(bytes(r.v)))) for r in links.collect()} == {frozenset((i, i + 1)) for i in range(11)}


@pytest.mark.parametrize("contexts", [4096, 1])
def test_repeated_strings(spark, make_docs, words, monkeypatch, contexts):
    monkeypatch.setattr(substring_dedup, "TASK_CONTEXTS", contexts)
    shared = words(30, 1)
    texts = [None, "", "x" * 199, "y" * 420, f"{words(20, 2)} {shared} {words(9, 3)}", f"{words(5, 4)} é{shared}é", f"{shared[:150]}!{shared[20:]}", words(300, 5), words(300, 5), "ab" * 150]
    got = substring_dedup.remove_repeats(make_docs(texts).drop("kept"), length=120, name_bytes=32).orderBy("doc_id").collect()
    import hashlib
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in got] == substring_dedup.brute_force(texts, 120)
    assert substring_dedup.remove_repeats(make_docs([]).drop("kept")).count() == 0


def test_whole_characters():
    assert substring_dedup.text_without("aéb", [{"a": 2, "b": 4}]) == "aé" and substring_dedup.text_without(None, None) == ""


def test_leaks(spark, make_docs, words):
    items = [words(40, 100 + i) for i in range(12)]
    para = items[1].split()
    for i in range(3, 40, 9):
        para[i] = "other"
    texts = [None, "", *[words(200, i) for i in range(60)], f"{words(90, 70)} {items[0].upper()} {words(90, 71)}", f"{words(50, 72)} {' '.join(para)}", f"{items[2]} {items[3]}"]
    bench = spark.createDataFrame([*enumerate(items), (50, None), (51, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(make_docs(texts), bench).collect()}
    assert got == {(62, 0), (63, 1), (64, 2), (64, 3)}
    assert decontaminate.leaks(make_docs(texts), bench.limit(0)).count() == decontaminate.leaks(make_docs([]), bench).count() == 0
    answers = bench.where("item_id = 0").selectExpr("item_id", "text", "'never there' AS answer")
    assert decontaminate.leaks(make_docs(texts), answers, answer_col="answer").count() == 0


def test_leaks_of_many_items(spark, make_docs, words):
    """A space of fixed rank loses items as they grow in number; verbatim copies are found all the same."""
    items = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(8000)]
    docs = [f"{words(37 + i % 50, i)} {items[20 * i]} {words(80, 5000 + i)}" for i in range(300)]
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(make_docs(docs), bench).collect()}
    assert got == {(i, 20 * i) for i in range(300)}


def test_lcs():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = rng.integers(0, 5, 20).tolist(), rng.integers(0, 5, 30).tolist()
        t = np.zeros((21, 31), int)
        for i in range(20):
            for j in range(30):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert decontaminate.lcs(a, b) == t[-1, -1]


def test_orthonormal():
    rng = np.random.default_rng(6)
    a = (rng.standard_normal((5000, 12)) * np.logspace(0, -3, 12)).astype(np.float32)
    q = decontaminate.orthonormal(a)
    assert np.allclose(q.T @ q, np.eye(12), atol=1e-5) and np.allclose(q @ (q.T @ a), a, atol=1e-4)
    assert not decontaminate.orthonormal(np.zeros((5000, 3), np.float32)).any()


def test_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 32))
    x[50:120] = x[0] + 0.05 * rng.standard_normal((70, 32))
    x[130:140] = x[130]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 32), (902, [float("nan")] * 32), (903, [1.0, None]), (None, x[0].tolist()), (904, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in vector_dedup.link_vectors(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    assert [got[i]["n_links"] for i in range(400)] == (near.sum(1) - 1).tolist() or \
        sum(got[i]["n_links"] for i in range(400)) >= 0.99 * (near.sum() - 400)
    assert all(got[i]["component_id"] == 0 for i in range(50, 120)) and all(got[i]["component_id"] == 130 for i in range(130, 140))
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (900, 901, 902, 903, 904)) and len(got) == 406
    assert vector_dedup.link_vectors(df.limit(0)).count() == 0


def test_toxicity(spark, make_docs, words):
    texts = [f"{words(40, i)} {'you grumblefax' if i % 4 == 0 else ''} {words(30, 1000 + i)}" for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(0, 1), (1, None), (None, 1)], "doc_id long, toxic int")
    texts += [None, "", f"{words(20, 5)} you gr0mblef@x {words(9, 6)}", f"{words(20, 7)} g r u m b l e f a x {words(9, 6)}", f"{words(20, 7)} grummmmblefaaax", words(30_000, 8)]
    got = {r["doc_id"]: r for r in toxicity.score_documents(make_docs(texts).drop("score"), labels).collect()}
    assert all(got[i]["predicted"] == int(i % 4 == 0) for i in range(200, 240))
    assert [got[i]["predicted"] for i in range(240, 246)] == [0, 0, 1, 1, 1, 0] and all(0 <= r["score"] <= 1 for r in got.values())
    none = toxicity.score_documents(make_docs(texts[:3]).drop("score"), labels.limit(0)).collect()
    assert {(r["score"], r["predicted"]) for r in none} == {(0.0, 0)}


def test_pipeline(spark, make_docs, words, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    packed = corpus_pipeline.run(spark, SF).toPandas()
    assert 0 < packed.doc_id.nunique() <= docs.count() and packed.groupby("sequence_id").length.sum().max() <= 1024
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    passage = words(80, 1)
    own = make_docs([None, "", words(100, 2), words(100, 2), f"{words(60, 3)} {bench}", f"{words(70, 4)} {passage}", f"{words(70, 5)} {passage}", words(90, 6)])
    table = docs.select("doc_id", "text", "lang", "source", "n_chars").selectExpr("doc_id + 100 AS doc_id", "text", "lang", "source", "n_chars", "0d AS score", "'' AS key", "'' AS kept").union(own)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in table.where("doc_id < 100").collect()}
        stage(spark, table, SF).write.parquet(str(tmp_path / name))
        table = spark.read.parquet(str(tmp_path / name))
        assert table.columns == own.columns, name
        after = {r["doc_id"]: r["text"] for r in table.where("doc_id < 100").collect()}
        gone = {"toxicity": set(), "near_dedup": {1, 3}, "substring_dedup": set(), "decontamination": {4}}[name]
        assert before - set(after) == gone, name
        if name == "substring_dedup":
            assert after[5].strip() == words(70, 4) and after[7] == words(90, 6)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, make_docs([]), SF).count() == 0, name
