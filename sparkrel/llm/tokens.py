"""Token ids of whole texts by a public tokenizer file, with the ids of words kept between documents.

Byte-level BPE with the usual splitting pattern works on pieces that never span the start of a word after a
single space, nor a lone line break between two words.  So a text is cut there, the library encodes each
distinct piece once in a worker, and the pieces' ids are joined.  Texts with other white space at a cut
(double spaces, blank lines, tabs at a word's edge) go to the library whole.  ``tests/llm`` hold the result
against the library's own, text by text.
"""

from __future__ import annotations

import sys
from array import array

import numpy as np

#: Pieces kept in a worker at most (some 200 bytes each); beyond it the store starts anew. It changes speed only.
KEPT = 1_000_000
#: Longer pieces are encoded each time.
LONG = 40
#: Marks that the splitting pattern keeps apart from the letters before them.
MARKS = ".,;:!?|*#$%&()[]{}<>/\\+=~^_@\"-"

_encoders: dict = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file; it stays for the worker's other tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class _Known(dict):
    """Ids of words; an unknown word is noted and stands as None until its ids are known."""

    def __init__(self, before: str) -> None:
        self.before, self.asked, self.whole = before, [], False

    def __missing__(self, word: str) -> None:
        if not word or word[0].isspace() or word[-1].isspace():
            self.whole = True
        self.asked.append(word)


class Encoder:
    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.first, self.after = _Known(""), _Known(" ")  # at the start of a line; after one space
        self.marks: dict[str, bytes] = {}
        self.line = self._library(["\n"])[0]

    def _library(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        code = "H" if self.dtype.itemsize == 2 else "I"
        found = [array(code, e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if sys.byteorder == "big":
            for x in found:
                x.byteswap()
        return [x.tobytes() for x in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian, of ``self.dtype``."""
        if len(self.first) + len(self.after) > KEPT:
            self.first.clear()
            self.after.clear()
        first, after, line_end = self.first, self.after, self.line
        get, docs, whole = after.__getitem__, [], []
        for i, text in enumerate(texts):
            first.whole = after.whole = False
            asked = len(first.asked), len(after.asked)
            parts, heads = [], []
            for line in text.split("\n"):
                words = line.split(" ")
                heads.append(len(parts))
                parts.append(first[words[0]])
                parts.extend(map(get, words[1:]))
                parts.append(line_end)
            parts.pop()
            if first.whole or after.whole:
                del first.asked[asked[0] :], after.asked[asked[1] :]
                whole.append(i)
                parts = heads = ()
            docs.append((parts, heads))
        firsts, afters = iter(self._learn(first)), iter(self._learn(after))
        out = []
        for parts, heads in docs:
            if None in parts:
                starts = set(heads)
                for i, x in enumerate(parts):
                    if x is None:
                        parts[i] = next(firsts) if i in starts else next(afters)
            out.append(b"".join(parts))
        whole = [i for i in whole if texts[i]]
        for i, ids in zip(whole, self._library([texts[i] for i in whole]), strict=True):
            out[i] = ids
        return out

    def _learn(self, known: _Known) -> list[bytes]:
        """The ids of the words asked for, in that order; all but long ones are known from then on.

        Marks after letters are pieces of their own, so the letters' ids serve with any marks.
        """
        asked, known.asked = known.asked, []
        split = {w: w if w.isalpha() else core if (core := w.rstrip(MARKS)).isalpha() else w for w in dict.fromkeys(asked)}
        new = [w for w in dict.fromkeys(split.values()) if w not in known]
        found = dict(zip(new, self._library([known.before + w for w in new]), strict=True))
        marks = [m for m in {w[len(c) :] for w, c in split.items()} if m not in self.marks]
        if len(self.marks) > 100_000:
            self.marks, marks = {}, list({w[len(c) :] for w, c in split.items()})
        self.marks.update(zip(marks, self._library(marks), strict=True))
        for word, core in split.items():
            if word != core:
                found[word] = (found[core] if core in found else known[core]) + self.marks[word[len(core) :]]
        known.update((w, x) for w, x in found.items() if len(w) <= LONG)
        return [found[w] if w in found else known[w] for w in asked]


def default_path() -> str:
    """The tokenizer file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def slices(texts: list[str], most: int = 8_000_000):
    """(start, end) of runs of texts with about *most* characters, so that long texts never pile up."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
