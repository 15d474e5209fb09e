"""Very long texts, broken markup, repeated rows: bounded work and nothing lost."""
import itertools
import time

import numpy as np

from cohortspark.llm import decontaminate, language, near_dedup, packing, toxicity
from cohortspark.llm.html_text import main_text
from cohortspark.llm.tokens import default_path

PARA = "The cat sat on the mat and it was the best of all the days that we had seen in the town by the river with her. " * 3


def test_markup_that_is_not_well_formed():
    pages = {f"<article><p title=don't>{PARA}</p><p>{PARA}</p><p title=can't>{PARA}</p></article>": 9, f'<article><p data-id="comments">{PARA}</p></article>': 3,
             f"<html><head><title>x</title><p>{PARA}</p>": 3, f"<head><meta x><body><p>{PARA}": 3, f'<article><p title="a>b" class=x>{PARA}</p></article>': 3,
             f'<article><p title="open>{PARA}</p></article>': 3, f"<article><p><button>{PARA}</p>": 3, f'<article><p class="comments">{PARA}</p></article>': 0,
             f"<article><p>{PARA}</p><script>{PARA}": 3, f"<article><p>{PARA}<p": 3}
    for page, n in pages.items():
        assert main_text(page).count("cat") == n, page[:60]


def test_pages_of_many_tags_take_linear_time():
    n = 100_000
    for page in ("<div>" * n + "</p>" * n, "<button>" * n, "<p a='" * n, "<p>x" * n, '<div class="' * n, "<!--" * n, "</" * n):
        start = time.process_time()
        main_text(page)
        assert time.process_time() - start < 20, page[:12]


def test_disguise_in_long_texts():
    model = toxicity.Restorer(np.zeros((2, 1 << toxicity.NGRAM_BITS), np.int64))
    for unit in ("aaab", "a", "a1", "x$$"):
        text = unit * (1_000_000 // len(unit))
        start = time.process_time()
        assert len(toxicity.disguised(text)) <= 1
        assert time.process_time() - start < 20
        text = text[:100_000]
        start = time.process_time()
        model.words(text)
        assert time.process_time() - start < 30 and not any(len(k) > toxicity.LONG_TOKEN for k in model.known)
    assert toxicity.disguised("so gr0mblef@x, and yeeeees! f r e e now") == ["gr0mblef@x", "yeeeees!", "f r e e"]


def test_viterbi_against_all_readings():
    counts = toxicity.code_points(["grumble facts and fast tests are best of all letters in this little text"] * 3)[0]
    table = np.zeros((2, 1 << toxicity.NGRAM_BITS), np.int64)
    np.add.at(table[0], toxicity.slot(counts[:-2], counts[1:-1], counts[2:]), 1)
    np.add.at(table[1], toxicity.slot(counts[:-1], counts[1:]), 1)
    model = toxicity.CharModel(table)

    def score(way):
        s, text = sum(cost for _, cost in way), "  " + "".join(x for x, _ in way)
        return s + sum(model(*text[i - 2:i + 1]) for i in range(2, len(text)))
    for token in ("f4ct5", "gr|mbl3", "1itt13", "bessst", "t3$7", "l3773rs", "a!!", "f.a.s.7"):
        ways = [(*w, (" ", 0.0)) for w in itertools.product(*toxicity.lattice(token))]
        top = max(map(score, ways))
        best = {"".join(x for x, _ in w).strip() for w in ways if abs(score(w) - top) < 1e-9}
        assert toxicity.decode(token, model) in best, token


def test_every_feature_is_scored():
    rng = np.random.default_rng(0)
    for n in (1, 1000, 20_000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        weights = rng.uniform(0.6, 5, len(keys)).astype(np.float32)
        lexicon = toxicity.Lexicon(keys, weights)
        assert (lexicon.strongest(keys, np.arange(len(keys)), len(keys)) == weights).all()
        assert not lexicon.strongest(keys + np.uint64(1), np.arange(len(keys)), len(keys)).any()
    assert not toxicity.Lexicon(np.zeros(0, np.uint64), np.zeros(0)).strongest(keys, np.arange(len(keys)), len(keys)).any()


def test_toxic_labels_of_one_text(spark, make_docs, words):
    """A third of the labelled rows hold one text."""
    texts = [words(30, 1)] * 100 + [f"{words(20, i)} {'you grumblefax' if i % 2 else ''}" for i in range(200)]
    labels = spark.createDataFrame([(i, int(i >= 100 and i % 2)) for i in range(300)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_documents(make_docs(texts).drop("score"), labels).collect()}
    assert all(got[i] == int(i >= 100 and i % 2) for i in range(300))


def test_packing_deals_repeated_rows(spark, make_docs, words, monkeypatch):
    docs = make_docs([words(5, 1)] * 600 + [words(5 + i % 9, i) for i in range(600)], [7] * 600 + list(range(100, 700)))
    seen = []
    real = packing.settle
    monkeypatch.setattr(packing, "settle", real)
    pieces = packing.cut_pieces(docs, "doc_id", "text", default_path(), 2, 1024)
    out = packing.pack(pieces, 1024, shard_items=100).toPandas()
    shards = out.groupby(out.sequence_id // (1 << 20)).size()
    seen.append(shards.max())
    assert len(out) == 1200 and len(shards) == 12 and shards.max() < 160
    assert out.groupby("sequence_id").length.sum().max() <= 1024 and out[["sequence_id", "offset"]].drop_duplicates().shape[0] == 1200


def test_best_fit_start_is_not_the_end():
    """Sizes on which best-fit decreasing needs more sequences than the optimum (7 + 3 and 5 + 3 + 2 fill): evolution must not be worse."""
    sizes = np.array([700, 700, 500, 500, 300, 300, 300, 300, 200, 200, 524 - 300, 24] * 6)
    start = packing.settle(sizes, 1024, 4, np.random.default_rng(2), True)
    best = packing.evolve(start, sizes, 1024, 60, np.random.default_rng(3))[0]
    bound = -(-int(sizes.sum()) // 1024)
    assert bound <= best.max() + 1 <= start[0].max() + 1 and np.bincount(best, sizes).max() <= 1024


def test_decontamination_sample_takes_a_text_once(spark, make_docs, words, monkeypatch):
    monkeypatch.setattr(decontaminate, "FIT_DOCS", 50)
    seen = []
    real = decontaminate.randomised_svd

    def spy(rows, *args, **kwargs):
        seen.append(rows.where("weight = 1").count())
        return real(rows, *args, **kwargs)
    monkeypatch.setattr(decontaminate, "randomised_svd", spy)
    item = words(60, 7777)
    docs = make_docs([words(50, 1)] * 400 + [words(50, i) for i in range(2, 202)] + [f"{words(40, 3000)} {item} {words(40, 3001)}"])
    found = decontaminate.leaks(docs.select("doc_id", "text"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {r["doc_id"] for r in found} == {600} and seen[0] <= 60


def test_leaks_against_every_window(spark, make_docs, words):
    """All documents x items x windows by plain LCS: whoever holds a verbatim or lightly edited item is found, nobody else."""
    items = [words(40, 500 + i) for i in range(6)]
    edited = items[2].split()
    edited[7] = edited[21] = "zzz"
    texts = [words(120, i) for i in range(20)] + [f"{words(33, 50 + i)} {x} {words(21, 80 + i)}" for i, x in enumerate(items)] + [f"{words(50, 1)} {' '.join(edited)} {words(50, 2)}"]

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]
    want = set()
    for d, t in enumerate(texts):
        w = t.split()
        for k, item in enumerate(items):
            it = item.split()
            if max(lcs(w[a:a + len(it) + 8], it) for a in range(0, max(1, len(w) - len(it) + 1), 4)) >= 0.8 * len(it):
                want.add((d, k))
    docs = make_docs(texts).select("doc_id", "text")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()} == want and len(want) == 7


def test_language_against_plain_bayes(spark, make_docs):
    import math
    texts = ["the cat and the dog", "der hund und die katze", "le chat et le chien", "the house", "das haus und der garten", "la maison et le jardin"] * 3
    langs = ["en", "de", "fr", "en", "de", "fr"] * 3
    docs = make_docs(texts + ["the garden and the maison", "und das", "123", None], langs=langs + [None] * 4)
    model = language.fit(docs.where("lang is not null"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(docs.select("doc_id", "text"), model).collect()}
    counts = {}
    for t, la in zip(texts, langs):
        g, _, _ = language.grams([t])
        for x in g:
            for b in x.tolist():
                counts[la, b] = counts.get((la, b), 0) + 1
    total = {la: sum(n for (k, _), n in counts.items() if k == la) for la in set(langs)}
    for d, t in enumerate(texts + ["the garden and the maison", "und das"]):
        g, _, _ = language.grams([t])
        logs = {la: math.log((6 + 1) / (18 + 3)) + sum(math.log((counts.get((la, b), 0) + 0.5) / (total[la] + 0.5 * language.BUCKETS)) for x in g for b in x.tolist()) for la in total}
        top = max(logs, key=logs.get)
        post = 1 / sum(math.exp(v - logs[top]) for v in logs.values())
        assert got[d][0] == top and abs(got[d][1] - post) < 1e-3
    assert got[20] == ("und", 0.0) and got[21] == ("und", 0.0)


def test_near_dedup_marks_repeats_of_the_kept_row(spark, make_docs, words):
    docs = make_docs([words(80, 1), words(80, 1), words(80, 1), words(80, 2), words(90, 3)], [5, 5, 6, 5, None])
    rows = near_dedup.near_duplicates(docs.select("doc_id", "text")).select("doc_id", "class_id", "kept").collect()
    assert sorted((r["doc_id"] or -1, r["class_id"] or -1, r["kept"]) for r in rows) == [(-1, -1, True), (5, 5, True), (5, 5, True), (5, 5, True), (6, 5, False)]


def test_large_group_with_few_outsiders(spark, make_docs, words, monkeypatch):
    """Blocks of the main component do not meet each other, and every link to it is still found."""
    import random
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 8)
    original, texts = words(400, 77).split(), []
    for c in range(60):
        w, rng = list(original), random.Random(c)
        for i in rng.sample(range(400), 3 if c < 48 else 12):
            w[i] = f"edit{c}x{i}"
        texts.append(" ".join(w))

    def grams(t):
        w = t.split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    sets = [grams(t) for t in texts]
    near = {(i, j) for i in range(60) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.82}
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(make_docs(texts)).collect()}
    assert all(got[i] == got[j] for i, j in near if i < 48 and j < 48)
    assert len({got[i] for i in range(60)}) <= 1 + sum(not any(i in p for p in near) for i in range(60))


def test_space_is_fitted_on_every_passage(spark, make_docs, words, monkeypatch):
    """The rows that the space is fitted on hold all words of all texts, once each; its directions are those of the dense matrix."""
    monkeypatch.setattr(decontaminate, "FIT_DOCS", 50)
    seen = []
    real = decontaminate.randomised_svd

    def spy(rows, idf, *args, **kwargs):
        space = real(rows, idf, *args, **kwargs)
        seen.append(([(np.frombuffer(r["features"], "<u2"), r["weight"]) for r in rows.collect()], idf, space.copy()))
        return space
    monkeypatch.setattr(decontaminate, "randomised_svd", spy)
    texts = [words(20 + 37 * (i % 9), i) for i in range(120)]
    item = words(60, 7777)
    docs = make_docs([*texts, texts[3], None, "", f"{words(40, 3000)} {item}"]).select("doc_id", "text")
    found = decontaminate.leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {r["doc_id"] for r in found} == {123}
    rows, idf, space = seen[0]
    corpus = [f for f, weight in rows if weight < 4]
    assert sorted(map(len, corpus)) == sorted([len(t.split()) for t in texts] + [100])
    lines = []
    for f, weight in rows:
        for lo in range(0, max(len(f) - 32, 1), 32):
            line = np.zeros(decontaminate.FEATURES)
            np.add.at(line, f[lo:lo + 64], idf[f[lo:lo + 64]])
            lines.append(line * weight / np.linalg.norm(line))
    matrix = np.array(lines)
    passages = len(lines) - 1
    assert passages > 400 and abs((matrix[:-1] ** 2).sum() + (matrix[-1] ** 2).sum() - 50 - 16) < 1e-3
    exact = np.linalg.svd(matrix, full_matrices=False)[1]
    held = np.linalg.norm(matrix @ space)
    assert 0.9 < held / np.linalg.norm(exact[:decontaminate.RANK]) < 1.0001
    assert np.allclose(space.T @ space, np.eye(space.shape[1]), atol=1e-3)
