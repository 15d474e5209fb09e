"""Exact kNN: blocked Spark result equals a brute-force numpy result."""

import numpy as np
import pytest

from cohortspark.operators.neighbors import knn_neighbors


def brute(q, t, tid, k):
    qn = q / np.linalg.norm(q, axis=1, keepdims=True)
    tn = t / np.linalg.norm(t, axis=1, keepdims=True)
    d = 1 - qn @ tn.T
    out = {}
    for i in range(len(q)):
        order = np.lexsort((tid, d[i]))[:k]
        out[i] = list(tid[order])
    return out


def test_blocked_equals_bruteforce(spark):
    rng = np.random.default_rng(0)
    t = rng.normal(size=(300, 8))
    q = rng.normal(size=(40, 8))
    t[5] = t[6]  # exact tie
    tid = np.arange(300, dtype=np.int64)
    train = spark.createDataFrame([(int(i), t[i].tolist()) for i in range(300)], "id long, vec array<double>")
    query = spark.createDataFrame([(i, q[i].tolist()) for i in range(40)], "id long, vec array<double>")
    want = brute(q, t, tid, 7)
    for block in (1000, 37):  # one block, and many blocks and parts
        nb = knn_neighbors(query, train, k=7, block_rows=block).collect()
        got = {}
        for r in sorted(nb, key=lambda r: (r["q_id"], r["rank"])):
            got.setdefault(r["q_id"], []).append(r["n_id"])
        assert got == want
    same = train.where("id = 6").unionByName(train.limit(0))
    for _ in range(5):
        same = same.unionByName(same)  # 32 equal rows spread over the blocks
    assert same.count() == 32 and knn_neighbors(query, same, k=7, block_rows=5).count() == 7 * 40


def test_a_task_holds_a_bounded_number_of_distances(monkeypatch):
    import pandas as pd
    from cohortspark.operators import neighbors as N
    rng = np.random.default_rng(1)
    q, t = rng.normal(size=(600, 4)), rng.normal(size=(3000, 4))
    seen, topk = [], N._topk_block
    monkeypatch.setattr(N, "_topk_block", lambda dist, ids, k: seen.append(dist.size) or topk(dist, ids, k))
    out = N._best_of_block(3)(*(pd.DataFrame({"id": np.arange(len(x)), "vec": list(x)}) for x in (q, t)))
    assert max(seen) <= 1 << 20 and sum(seen) == 600 * 3000
    got = out.groupby("q_id", sort=True)["n_id"].agg(list).to_dict()
    assert got == {i: list(map(int, ids)) for i, ids in brute(q, t, np.arange(3000), 3).items()}


def test_levels_stay_on_executors(spark):
    from cohortspark.operators import features
    df = spark.createDataFrame([(i, "abc"[i % 3] if i % 5 else None, f"v{i % 40:02d}") for i in range(400)], "id long, p string, q string")
    levels = features.level_table(df, ["p", "q", "absent"])
    rows = sorted(map(tuple, levels.collect()), key=lambda r: r[3])
    want = [("p", x, i) for i, x in enumerate("abc")] + [("q", f"v{i:02d}", i) for i in range(40)] + [("absent", "Unknown", 0)]
    assert [r[:3] for r in rows] == want and [r[3] for r in rows] == list(range(44)) and rows[-1][4] == 400
    for share in (features.HOT_SHARE, 0.05, 1.0):  # all levels by broadcast, some, none
        features.HOT_SHARE, old = share, features.HOT_SHARE
        try:
            out = features.onehot_long(df, levels, ["id"], ["p", "q", "absent"], num_offset=2).collect()
        finally:
            features.HOT_SHARE = old
        assert len(out) == 400 * 2 + 320 and {r["position"] for r in out if r["feature"] == "p_b"} == {3}


def test_dense_hashing_equals_long_form(spark):
    from pyspark.sql import functions as F
    from cohortspark.operators.embed import hashed_embedding, hashed_long
    rows = [(1, "The cat sat on the mat, the CAT!"), (2, None), (3, "naïve café — 42 x42"), (4, "")]
    df = spark.createDataFrame(rows, "id int, t string")
    dense = {r["id"]: list(r["embedding"]) for r in hashed_embedding(df, ["id"], "t", dim=16).collect()}
    lng = hashed_long(df, ["id"], "t", dim=16).collect()
    want = {i: [0.0] * 16 for i in (1, 2, 3, 4)}
    for r in lng:
        want[r["id"]][r["bucket"]] = r["value"]
    assert dense == want


@pytest.mark.parametrize("width", [6, 1500])
def test_few_pairs_are_measured(monkeypatch, width):
    """Of all pairs only those that can be among the nearest are measured in double precision; equal vectors go by id."""
    import pandas as pd
    from cohortspark.operators import neighbors as N
    rng = np.random.default_rng(4)
    q, t = rng.normal(size=(40, width)), rng.normal(size=(6000, width))
    t[100:140] = t[5000:5040] = q  # two equal nearest ones each
    t[7] = np.nan
    t[8] = 0
    ids = rng.permutation(6000) + 10
    measured, topk = [], N._topk_block

    def spy(near, exact, k):
        return topk(near, lambda r, cand: measured.append(len(cand)) or exact(r, cand), k)
    monkeypatch.setattr(N, "_topk_block", spy)
    out = N._best_of_block(5)(pd.DataFrame({"id": np.arange(40), "vec": list(q)}), pd.DataFrame({"id": ids, "vec": list(t)}))
    assert len(measured) == 40 and max(measured) < 600
    unit = t / np.maximum(np.linalg.norm(t, axis=1, keepdims=True), 1e-300)
    for i, got in out.groupby("q_id", sort=True)["n_id"].agg(list).items():
        dist = 1 - unit @ (q[i] / np.linalg.norm(q[i]))
        dist = np.where(np.isnan(dist), np.inf, dist.round(12))
        assert got == list(ids[np.lexsort((ids, dist))[:5]])


def test_ascii_words_equal_the_pattern():
    from cohortspark.operators import embed as E
    for text in ("".join(map(chr, range(128))), "A_b-C9 x\x1fy\tZ", "naïve CAFÉ_x 42", ""):
        assert E._words(text) == E._TOKEN.findall(text.encode().lower().decode())
