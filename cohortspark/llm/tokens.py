"""Token ids of whole texts with the ``tokenizers`` library, with a bounded per-worker word cache."""

from __future__ import annotations

import os
import re

import numpy as np

from cohortspark.llm.common import WORKER_CACHES

#: White space other than a space and a line break (fixed values), and the pairs that longer runs are made of.
_OTHER_SPACE = "\t\r\v\f\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_PAIRS = ("  ", " \n", "\n ", "\n\n")
#: Runs of white space that a cut at single spaces would tear apart, or that would join a line break before the text.
_TORN = re.compile(r"\s\s\s|\s\s\Z|\A[^\S \n]")
#: Signs that stand in one token run after a word, and how many of them at most are taken off it (which bounds the runs that are kept).
_SIGNS, _MAX_SIGNS = ".,;:!?$%&*|#", 4
_WORKER: dict[str, "Encoder"] = {}
WORKER_CACHES.append(_WORKER)


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def _is_torn(text: str) -> bool:
    """Does the text hold such a run? Plain searches settle nearly all texts much faster than the pattern."""
    return (any(p in text for p in _PAIRS) or any(c in text for c in _OTHER_SPACE)) and _TORN.search(text) is not None


class Encoder:
    """Ids of texts, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``.

    The pre-tokeniser of a byte-level BPE never joins a word to the space-led word after it, so a
    text is cut before each single space and line break, each distinct piece is encoded once, and the
    ids are joined. Pieces are kept in a dictionary of at most ``cache`` entries, which starts anew when full.
    Texts with longer runs of white space are encoded as they are.
    """

    def __init__(self, path: str, cache: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.model, self.plain_model = self.tok.model, self.tok.normalizer is None
        # the characters that stand for bytes in the vocabulary: themselves if printable, else 256 and on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.units = {b: 256 + i for i, b in enumerate(hidden)}
        size = self.tok.get_vocab_size()
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.codes = [i.to_bytes(self.dtype.itemsize, "little") for i in range(size)]
        self.cache, self.known, self.ends = cache, {}, {}
        self.newline = self.tok.encode("\n", add_special_tokens=False).ids

    def raw(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _keep(self, pieces: list[str], ids: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> None:
        if len(starts) != len(pieces):
            return
        blob, size = ids.tobytes(), ids.itemsize
        self.known.update(zip(pieces, [blob[a:b] for a, b in zip((starts * size).tolist(), (stops * size).tolist(), strict=True)], strict=True))

    def _learn_letters(self, pieces: list[str]) -> list[str]:
        """Learn pieces that are words of letters, or such words before a few signs; returns the others.

        The pattern pre-tokeniser leaves a word of letters whole, so the model takes it as it is. Signs after a letter are
        a token run of their own, so ``word,`` follows from ``word`` and ``,``.
        """
        known, ends, codes, units, tokenize, others = self.known, self.ends, self.codes, self.units, self.model.tokenize, []
        newline = b"".join([codes[i] for i in self.newline])
        for p in pieces:
            base = p.rstrip(_SIGNS)
            line = base[:1] == "\n"
            word = base[1:] if line else base
            if not word.isalpha() or len(p) - len(base) > _MAX_SIGNS:
                others.append(p)
                continue
            ids = known.get(base)
            if ids is None:
                x = word if word.isascii() else word.encode().decode("latin-1").translate(units)
                ids = b"".join([codes[t.id] for t in tokenize(x if line else "\u0120" + x)])
                known[base] = ids = newline + ids if line else ids
            if len(base) < len(p):
                signs = p[len(base):]
                if signs not in ends:
                    ends[signs] = self.raw(signs)
                known[p] = ids + ends[signs]
        return others

    def learn(self, pieces: list[str]) -> None:
        """Encode new pieces.

        Words of letters go to the model one by one; other pieces stand on lines of their own in one text, since a line
        break between two of them is a token of its own.
        """
        known = self.known
        if self.plain_model:
            pieces = self._learn_letters(pieces)
        plain = [p for p in pieces if p and not p[0].isspace() and not p[-1].isspace() and "\n" not in p and len(self.newline) == 1]
        for lo in range(0, len(plain), 2000):
            part = plain[lo:lo + 2000]
            ids = np.asarray(self.tok.encode_batch_fast(["\n" + "\n".join([" " + p for p in part])], add_special_tokens=False)[0].ids, self.dtype)
            starts = np.flatnonzero(ids == self.newline[0])
            self._keep(part, ids, starts + 1, np.append(starts[1:], len(ids)))
        for p in pieces:
            if p not in known:
                known[p] = self.raw(p if p[:1] == "\n" else " " + p)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids (``self.dtype``) of each text; null texts give none."""
        known = self.known
        if len(known) > self.cache:
            known.clear()
        get, skip = known.get, len(self.newline) * self.dtype.itemsize
        split: list = []
        new: dict[str, None] = {}
        for x in texts:
            if not x:
                split.append(b"")
            elif _is_torn(x):
                split.append(self.raw(x))
            else:
                # a line break before the text makes its first piece one like any other; its id goes again below
                w = ("\n" + x).replace("\n", " \n").split(" ")
                del w[0]
                ids = list(map(get, w))
                if None in ids:
                    gaps = [i for i, v in enumerate(ids) if v is None]
                    missing = [w[i] for i in gaps]
                    new.update(dict.fromkeys(missing))
                    split.append((ids, gaps, missing))
                else:
                    split.append(b"".join(ids)[skip:])
        if new:
            self.learn(list(new))
        out = []
        for w in split:
            if type(w) is bytes:
                out.append(w)
                continue
            ids, gaps, missing = w
            for i, p in zip(gaps, missing, strict=True):
                ids[i] = known[p]
            out.append(b"".join(ids)[skip:])
        return out


def encoder(path: str, cache: int = 600_000) -> Encoder:
    """The worker's encoder for ``path``, built once per process; ``cache`` bounds its dictionary (some 150 bytes an entry)."""
    if path not in _WORKER:
        _WORKER[path] = Encoder(path)
    _WORKER[path].cache = cache
    return _WORKER[path]
