"""Tokenisation, token files and packing: exact round trips."""
import random
import zlib

import numpy as np
import pytest

from cohortspark.llm import packing, rans, token_files
from cohortspark.llm.tokens import Encoder, default_path


def ids_of(texts, end):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(default_path())
    return [np.append(tok.encode(t or "", add_special_tokens=False).ids, [end]).astype("<u4") for t in texts]


def test_encoder_equals_the_library():
    enc, rng = Encoder(default_path(), cache=50), random.Random(3)
    bits = ["a", "b", " ", " ", "\n", "\t", "'s", "é", "1", "!", "\xa0", "\r", " the", ",", "."]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(5000)]
    for t, blob in zip(texts, enc.encode(texts)):
        assert np.frombuffer(blob, enc.dtype).tolist() == enc.tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_words_before_signs_are_learnt_from_the_word(monkeypatch):
    enc, signs = Encoder(default_path()), [",", ".", "***", ",%%%", "$$$."]
    pieces = [lead + w + x for lead in ("", "\n") for w in ("alpha", "Über", "鳳") for x in signs]
    want = {p: enc.raw(p if p[0] == "\n" else " " + p) for p in pieces}
    calls, raw = [], enc.raw
    monkeypatch.setattr(enc, "raw", lambda p: calls.append(p) or raw(p))
    enc.learn(pieces)
    assert {p: enc.known[p] for p in pieces} == want
    assert sorted(calls) == sorted(signs)  # once each, not once a piece
    enc.learn(["alpha" + ".;" * 9])  # a longer run is not taken off, so the kept runs stay few
    assert enc.known["alpha" + ".;" * 9] == raw(" alpha" + ".;" * 9) and len(enc.ends) == len(signs)


def test_coder_round_trip_and_checkpoints():
    rng = np.random.default_rng(0)
    table = rans.Table(rans.scale(np.bincount(rng.geometric(0.01, 5000) % 3000, minlength=3000)))
    for n in (0, 1, 2, 63, 64, 5000, 300_000):
        ids = (rng.geometric(0.01, n) % 3000).astype(np.uint32)
        block = rans.encode(ids, table, lanes=128, mark_steps=8)
        assert (rans.decode(block, table) == ids).all()
        for a, b in ((0, n), (n // 2, n // 2 + 9), (n - 2, n)):
            assert (rans.decode(block, table, max(a, 0), b) == ids[max(a, 0):b]).all()
    broken = bytearray(rans.encode(ids, table))
    broken[-5] ^= 1
    with pytest.raises(ValueError):
        rans.decode(bytes(broken), table)


def test_crc_join():
    a, b = b"some bytes", b"and more of them" * 99
    assert token_files.crc_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_token_files(spark, make_docs, tmp_path, monkeypatch, words):
    monkeypatch.setattr(token_files, "BLOCK_TOKENS", 500)
    texts = [None, "", "a", words(2000, 1), "same", "same", words(300, 2)]
    ids = [6, 5, 4, 3, 1, 1, 0]
    token_files.write_tokens(make_docs(texts, ids), str(tmp_path / "t"))
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_tokens(spark, str(tmp_path / "t")).collect())
    want, at = [], 0
    for d, x in sorted(zip(ids, ids_of(texts, 0)), key=lambda p: p[0]):
        want.append((d, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    assert got == sorted(want)
    token_files.write_tokens(make_docs([]), str(tmp_path / "none"))
    assert token_files.read_tokens(spark, str(tmp_path / "none")).count() == 0


def test_packing(spark, make_docs, words):
    texts = [None, "", *[words(n % 700 + 1, n) for n in range(0, 9000, 90)], "same", "same", words(5000, 1)]
    rows = packing.pack(packing.cut_pieces(make_docs(texts), "doc_id", "text", default_path(), 2, 1024), 1024, shard_items=64).toPandas()
    total = 0
    for d, x in enumerate(ids_of(texts, 2)):
        own = rows[rows.doc_id == d].sort_values("piece")
        total += len(x)
        assert own.length.sum() == len(x) and own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and (own.length.iloc[1:] == 1024).all()
        assert [zlib.crc32(x[a:a + n].tobytes()) for a, n in zip(own.start, own.length)] == own.ids_crc32.tolist()
    s = rows.sort_values(["sequence_id", "offset"])
    assert (s.groupby("sequence_id").length.cumsum() - s.length == s.offset).all() and s.groupby("sequence_id").length.sum().max() <= 1024
    assert rows.sequence_id.nunique() <= -(-total // 1024) + 4
    assert packing.pack_documents(make_docs([])).count() == 0


def test_crossover_keeps_every_piece():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 900, 300)
    pop = packing.settle(sizes, 1024, 4, rng, True)
    best = packing.evolve(pop, sizes, 1024, 10, rng)[0]
    assert len(best) == 300 and np.bincount(best, sizes).max() <= 1024
    assert packing.fitness(sizes, best, 1024) <= min(packing.fitness(sizes, p, 1024) for p in pop)


def test_every_generation_runs(monkeypatch):
    """A start with as few bins as can be is bred as well, and single pieces pass."""
    calls, real = [], packing.crossover

    def spy(*args):
        calls.append(1)
        return real(*args)
    monkeypatch.setattr(packing, "crossover", spy)
    for sizes in (np.array([600, 424] * 50), np.array([7])):
        calls.clear()
        start = packing.settle(sizes, 1024, 4, np.random.default_rng(1), True)
        assert start[0].max() + 1 == -(-int(sizes.sum()) // 1024)
        best = packing.evolve(start, sizes, 1024, 5, np.random.default_rng(2))[0]
        assert len(calls) == 5 and np.bincount(best, sizes).max() <= 1024
        assert packing.fitness(sizes, best, 1024) <= packing.fitness(sizes, start[0], 1024)
