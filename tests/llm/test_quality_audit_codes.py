"""Quality network, filter audit and vector codes against brute force, finite differences and held-out accuracy."""
import hashlib
import re
import zlib
from itertools import permutations

import numpy as np
import pytest

from cohortspark.llm import common, filter_audit, quality, vector_codes

# ---------------------------------------------------------------- quality


def plain_logit(w, text):
    """The network written as loops over windows and chunks."""
    codes = list(text) + [quality.PAD] * (quality.WIDTH + quality.HOP)
    hops = -(-(len(text) + quality.WIDTH) // quality.HOP)
    top = []
    for h in range(hops):
        last = h == hops - 1
        starts = range(h * quality.HOP, (h + 1) * quality.HOP - (quality.WIDTH - 1 if last else 0), quality.STRIDE)
        codes += [quality.PAD] * max(0, (h + 2) * quality.HOP - len(codes))
        rows = [np.concatenate([w["embed"][c] for c in codes[s:s + quality.WIDTH]]) @ w["filters"] for s in starts]
        top.append(np.max(rows, 0))
    chunks = [np.maximum(a, b) for a, b in zip(top, top[1:])] or top
    hidden = [np.maximum(np.maximum(c + w["bias"], 0) @ w["dense"] + w["shift"], 0) for c in chunks]
    return np.max(hidden, 0) @ w["out"] + w["base"][0]


TEXTS = [b"", b"a", b"x" * 243, b"x" * 244, b"y" * 245, b"z" * 256, bytes(range(256)) * 5, "ä ß ñ".encode() * 90]


def test_network_against_loops():
    w = quality.views(quality.fresh_weights())
    logit, _ = quality.forward(w, quality.Layout(TEXTS))
    assert np.allclose(logit, [plain_logit(w, t) for t in TEXTS], atol=1e-4)
    alone = [quality.forward(w, quality.Layout([t]))[0][0] for t in TEXTS]
    assert np.allclose(logit, alone, atol=1e-5)  # neighbours do not matter


def test_gradient_by_differences():
    rng = np.random.default_rng(1)
    flat = quality.fresh_weights().astype(float)
    quality.views(flat)["bias"][:] = rng.normal(0, 0.1, quality.FILTERS)  # away from the kink at zero that padding meets
    texts, y, weight = TEXTS[1:6] + [bytes(rng.integers(32, 127, 900).astype(np.uint8))], np.array([0, 1, 1, 0, 1, 0]), np.arange(1.0, 7.0)
    _, g = quality.gradient(flat, texts, y, weight)
    names = quality.views(np.arange(quality.SIZE))
    for name in names:
        at = names[name].ravel()
        at = at[np.argsort(-np.abs(g[at]))[:4]]
        for i in at:
            if name == "embed" and i >= quality.PAD * quality.DIM:
                continue
            up, down = flat.copy(), flat.copy()
            up[i] += 1e-6
            down[i] -= 1e-6
            numeric = (quality.gradient(up, texts, y, weight)[0] - quality.gradient(down, texts, y, weight)[0]) / 2e-6
            assert abs(numeric - g[i]) < 1e-4 + 1e-3 * abs(g[i]), (name, i)


def test_quality_held_out(spark, make_docs, words, monkeypatch):
    monkeypatch.setattr(quality, "ROUNDS", 4)
    texts = [words(60 + i % 50, i) for i in range(400)]
    bad = [i % 3 == 0 for i in range(400)]
    texts = [" ".join(w + "###" for w in t.split()) if b else t for t, b in zip(texts, bad)]
    texts += [None, "", texts[0], texts[0], words(30_000, 9) + " " + texts[0]]
    docs = make_docs(texts, [*range(403), 402, None])
    labels = spark.createDataFrame([*[(i, int(not b), 0) for i, b in enumerate(bad)], (7, None, 0), (1, 0, 1), (None, 1, 1), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.score_documents(docs.drop("score"), labels)
    assert out.columns[:2] == ["doc_id", "text"] and "key" in out.columns
    rows = out.collect()
    assert len(rows) == 405 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= quality.THRESHOLD) for r in rows)
    got = {r["doc_id"]: r["predicted"] for r in rows}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i] == (not bad[i]) for i in held]) > 0.95
    assert got[402] == got[0] == 0
    same = {r["score"] for r in rows if r["text"] == texts[0]}
    assert max(same) - min(same) < 1e-5
    long = next(r for r in rows if r["doc_id"] is None)
    assert long["predicted"] == 0  # the bad end of a long text is seen


def test_quality_without_both_labels(spark, make_docs):
    docs = make_docs(["a", None])
    schema = "doc_id long, quality int"
    one = spark.createDataFrame([(i, 1) for i in range(10)], schema)
    assert {r["score"] for r in quality.score_documents(docs, one).collect()} == {1.0}
    assert {r["score"] for r in quality.score_documents(docs, one.limit(0)).collect()} == {0.5}
    assert quality.score_documents(docs.limit(0), one).count() == 0


# ---------------------------------------------------------------- filter audit

def brute_audit(docs, labels):
    texts = [(i, (t or ""), (s or "")) for i, t, s in docs]
    first = {}
    for i, t, _ in texts:
        if i is not None:
            first[t] = min(first.get(t, i), i)
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    rows = []
    for i, t, s in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
                 "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > first[t]}
        rows.append((s, {f for f in fails if fails[f]}, i is not None and i in good, i is not None and i in toxic))
    out, shapley = {}, {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in r[1] for r in mine) - len(gone), sum(r[1] == {f} for r in mine),
                                                   sum(r[2] for r in gone), sum(r[3] for r in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("share", [1 / 4096, 0.3])
def test_filter_audit(spark, words, monkeypatch, share):
    monkeypatch.setattr(common, "HOT_SHARE", share)
    base = [words(60, 1), words(20, 2), "same " * 80, words(70, 3).upper(), words(55, 4) + " a|b", "", " x\x0by\x1cz", "É" * 10, "AB " + "c" * 38, words(49, 5) + "\x0b\x0cw"]
    docs = [(i, t, f"s{i % 3}") for i, t in enumerate(base)]
    docs += [(100 + i, base[0], "hot") for i in range(20)] + [(None, base[0], "hot"), (None, None, None), (3, base[3], "s0"), (3, base[3], "s0"), (50, None, ""), (51, base[1] * 400, None)]
    labels = [(0, 1, 0), (1, 1, 1), (2, 0, 1), (100, 1, 1), (100, 0, None), (101, None, 1), (3, 1, 0), (None, 1, 1), (7777, 1, 1)]
    frame = spark.createDataFrame([(i, t, "clash", s, 1, 2) for i, t, s in docs], "doc_id long, text string, mask string, source string, n long, digest long")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")

    def run(frame):
        return filter_audit.audit(filter_audit.cell_counts(filter_audit.failure_masks(frame), table)).collect()
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in run(frame)}
    assert got == brute_audit(docs, labels)
    assert run(frame.limit(0)) == []


# ---------------------------------------------------------------- vector codes

def test_orchard_is_exact():
    rng = np.random.default_rng(0)
    for spread in (2, 5, 1000):
        for k in (1, 2, 16):
            entries = rng.integers(-spread, spread, (k, 3))
            x = rng.integers(-spread, spread, (500, 3))
            d = ((x[:, None] - entries[None]) ** 2).sum(2)
            at, best = vector_codes.Codebook(entries).nearest(x)
            assert (at == d.argmin(1)).all() and (best == d.min(1)).all()


def brute_codes(rows, parts, entries, rounds):
    kept = [(i, [int(np.floor(4096 * float(x))) for x in v], la) for i, v, la in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    ranked = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(kept[0][1])
    cut = [(p * size // parts, (p + 1) * size // parts) for p in range(parts)]
    books = [[r[1][a:b] for r in ranked[:entries]] for a, b in cut]

    def near(x, book):
        d = [sum((p - q) ** 2 for p, q in zip(x, e)) for e in book]
        return d.index(min(d)), min(d)
    for _ in range(rounds):
        for book, (a, b) in zip(books, cut):
            mine = [[] for _ in book]
            for _, v, _ in kept:
                mine[near(v[a:b], book)[0]].append(v[a:b])
            for e, group in enumerate(mine):
                if group:
                    book[e] = [sum(c) // len(group) for c in zip(*group)]
    out = [(i, la, [near(v[a:b], book) for book, (a, b) in zip(books, cut)]) for i, v, la in kept]
    error = {}
    for _, la, f in out:
        error[la] = error.get(la, 0) + sum(d for _, d in f)
    text = ",".join(str(x) for book in books for e in book for x in e)
    return sorted((-1 if i is None else i, "".join(f"{at:02x}" for at, _ in f), sum(d for _, d in f), error[la]) for i, la, f in out), text


@pytest.mark.parametrize("share", [1 / 4096, 0.3])
def test_vector_codes(spark, monkeypatch, share):
    monkeypatch.setattr(common, "HOT_SHARE", share)
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.2, 16).astype(np.float32)], None if i % 7 == 0 else int(i % 4) if i % 2 else 9) for i in range(120)]
    rows += [(3, rows[5][1], 1), (4, rows[4][1], 9), (None, rows[8][1], 9), (300, [0.0] * 16, 2), (301, None, 1), (302, [None] + [0.5] * 15, 1),
             (303, [float("nan")] * 16, 1), (304, [float("inf")] * 16, 1), (305, [], 1), (306, [-0.0001] * 16, 2)]
    schema = "vec_id long, embedding array<float>, label int, code string, n long"
    df = spark.createDataFrame([(*r, "clash", 5) for r in rows], schema)
    expected, text = brute_codes(rows, 8, 16, 6)
    out, books = vector_codes.compress_vectors(df)
    got = sorted((-1 if r["vec_id"] is None else r["vec_id"], r["code"], r["error"], r["label_error"]) for r in out.collect())
    assert got == expected and vector_codes.codebooks_text(books) == text
    few, _ = vector_codes.compress_vectors(df.where("vec_id < 5"), parts=3, rounds=2)  # fewer rows than entries, parts of unequal size
    expected, _ = brute_codes([r for r in rows if r[0] is not None and r[0] < 5], 3, 16, 2)
    assert sorted((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in few.collect()) == expected
    empty, books = vector_codes.compress_vectors(df.limit(0))
    assert empty.count() == 0 and hashlib.sha256(vector_codes.codebooks_text(books).encode()).hexdigest()
    with pytest.raises(Exception, match="smaller scale"):
        vector_codes.compress_vectors(spark.createDataFrame([(1, [1e6] * 8, 1, "", 0)], schema))
