"""Exact token ids of many texts by the tokenizers library, which sees each distinct piece of text once.

A text is cut where no token can cross: before a lone space between two other characters (byte-level BPE keeps the
space with what follows) or at any space or line end (BPE with word ends drops white space). Ids of the pieces are
kept, up to a number of pieces, so that frequent words are encoded once in a worker.

A text in which one of the vocabulary's special tokens is spelled out goes through the library whole, which gives that
token's own id, as the library does by default; with literal such spellings are plain text instead.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

from . import textkernel

#: Pieces whose ids a worker keeps; beyond that only those of the last batch stay.
KEPT = 850_000
_ODD = r"[\t\r\v\f\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Bytes that any of these may hold.
_RARE = np.zeros(256, bool)
_RARE[[9, 11, 12, 13, 28, 29, 30, 31, 0xC2, 0xE1, 0xE2, 0xE3]] = True
#: Latin letters whose lower case and normal form do not depend on what stands around them; ASCII marks but no apostrophe.
_LATIN = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Characters behind which ASCII marks are a pre-token of their own; others may change in the vocabulary's normal form.
_FIRM = re.compile(r"[A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]")
_NONE: list[int] = []
# Byte-level BPE shows each byte as a character: printable ones as themselves, the others from 256 on, in order.
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SHOWN = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PLAIN)}
_SPACE = chr(_SHOWN[32])
_LONE = re.compile(r"(?<=\S) (?=\S)")


class Pieces:
    """encode(texts) gives all ids, and their number for each text."""

    def __init__(self, name: str, keeps_space: bool, kept: int = KEPT, literal: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(name if os.path.sep in name else public_tokenizers.path(name))
        self.model.encode_special_tokens = literal
        self.special = [] if literal else [x.content.encode() for x in self.model.get_added_tokens_decoder().values()]
        self.keeps_space, self.kept = keeps_space, kept
        self.clear()

    def clear(self) -> None:
        self.of: dict[str, int] = {}
        self.recent = np.zeros(0, np.int32)
        self.flat, self.starts, self.used, self.n = np.zeros(1 << 16, np.uint32), np.zeros((1 << 14) + 1, np.int64), 0, 0

    def _shrink(self) -> None:
        """Keeps the pieces of the last batch, among which are all frequent ones."""
        names, some = list(self.of), np.unique(self.recent)
        lens = self.starts[some + 1] - self.starts[some]
        ends = np.cumsum(lens)
        kept = self.flat[np.repeat(self.starts[some] - ends + lens, lens) + np.arange(int(ends[-1]) if len(ends) else 0)]
        self.clear()
        self.flat = np.concatenate([kept, np.zeros(1 << 16, np.uint32)])
        self.starts = np.concatenate([[0], ends, np.zeros(1 << 14, np.int64)])
        self.used, self.n = len(kept), len(some)
        self.of = {names[c]: k for k, c in enumerate(some.tolist())}
        pa.default_memory_pool().release_unused()

    def _ids(self, new: list[str]) -> list[list[int]]:
        """Ids of pieces: plain letters are one pre-token, as are marks, and go to the library's BPE model at once; any other
        piece goes through its whole chain."""
        out: list[list[int]] = [_NONE] * len(new)
        rest, tokenize, keeps = [], self.model.model.tokenize, self.keeps_space
        for k, x in enumerate(new):
            body = x[1:] if keeps and x[:1] == " " else x
            if body.isalpha() and (body.isascii() or _LATIN.fullmatch(body)):
                head = body if keeps else body.lower()
                if not head.isascii():
                    head = head.encode().decode("latin-1").translate(_SHOWN)
                out[k] = [t.id for t in tokenize(head if body is x else _SPACE + head)]
            elif x and not x.strip(_MARKS):
                out[k] = [t.id for t in tokenize(x)]
            elif x:
                rest.append(k)
        for at in range(0, len(rest), 20_000):
            part = rest[at : at + 20_000]
            for k, x in zip(part, self.model.encode_batch([new[k] for k in part], add_special_tokens=False)):
                out[k] = x.ids
        return out

    def _learn(self, new: list[str]) -> None:
        for at in range(0, len(new), 50_000):
            ids = self._ids(new[at : at + 50_000])
            lens = np.fromiter(map(len, ids), np.int64, len(ids))
            total, n = int(lens.sum()), len(ids)
            while self.used + total > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while self.n + n + 1 > len(self.starts):
                self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
            self.starts[self.n + 1 : self.n + n + 1] = self.used + np.cumsum(lens)
            self.used, self.n = self.used + total, self.n + n

    def _codes(self, parts: list[str]) -> np.ndarray:
        """The numbers of these pieces, new ones encoded together."""
        of = self.of
        new = list(dict.fromkeys(x for x in parts if x not in of))
        of.update(zip(new, range(self.n, self.n + len(new))))
        self._learn(new)
        return np.fromiter(map(of.__getitem__, parts), np.int32, len(parts))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has; null counts as empty."""
        texts = pc.fill_null(texts, "")
        data = textkernel.raw(texts)[0].tobytes()
        if not any(x in data for x in self.special):
            return self._encode(texts)
        found = np.logical_or.reduce([pc.match_substring(texts, x.decode()).to_numpy(zero_copy_only=False) for x in self.special])
        ids, counts = self._encode(pc.if_else(pa.array(found), "", texts))
        own = np.split(ids, np.cumsum(counts)[:-1])
        for i in np.flatnonzero(found):
            own[i] = np.array(self.model.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, np.uint32)
        return np.concatenate(own), np.array([len(x) for x in own])

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.of) > self.kept:
            self._shrink()
        # Lines of BPE with spaces stand apart: their first part has no space, and a lone line end is a token of its own.
        lines = pc.split_pattern(texts, "\n")
        counts = np.diff(lines.offsets.to_numpy().astype(np.int64))
        odd = np.zeros(len(texts), bool)
        if self.keeps_space and _RARE[textkernel.raw(texts)[0]].any():
            odd |= pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(lines.flatten(), " ")
        # Each distinct part is looked up once; the hash table over all parts is Arrow's. Marks behind a letter or digit are
        # a pre-token of their own, so a part is two pieces: what stands before them, and them or nothing.
        flat, places = cut.flatten(), cut.offsets.to_numpy().astype(np.int64)
        places = places - places[0]
        coded = flat.dictionary_encode()
        heads = textkernel.strings(coded.dictionary)
        tails = [""] * len(heads)
        # Only parts that end in a mark are cut.
        stems = pc.utf8_rtrim(coded.dictionary, _MARKS)
        marked = np.flatnonzero(pc.not_equal(pc.binary_length(stems), pc.binary_length(coded.dictionary)).to_numpy(zero_copy_only=False))
        for i, stem in zip(marked.tolist(), textkernel.strings(stems.take(pa.array(marked)))):
            if stem and _FIRM.match(stem[-1]):
                heads[i], tails[i] = stem, heads[i][len(stem) :]
        index = coded.indices.to_numpy()
        at = np.empty((len(index), 2), np.int32)
        at[:, 0] = self._codes([" " + x for x in heads] if self.keeps_space else heads)[index]
        at[:, 1] = self._codes(tails)[index]
        if self.keeps_space and len(texts):
            first = places[:-1]
            which, back = np.unique(index[first], return_inverse=True)
            at[first, 0] = self._codes([heads[i] for i in which])[back]
            # An empty part is white space beside white space or at an end: such texts are cut by the pattern below.
            empty = np.flatnonzero(pc.equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False))
            odd[np.searchsorted(places[np.cumsum(counts)], empty, "right")] = True
        at, places = at.ravel(), 2 * places
        if self.keeps_space and len(texts):
            # A line end behind every line that is not the last of its text.
            inner = np.ones(len(places) - 1, bool)
            inner[np.cumsum(counts) - 1] = False
            at = np.insert(at, places[1:][inner], self._codes(["\n"])[0])
            places = places + np.concatenate([[0], np.cumsum(inner)])
        ends = places[np.cumsum(counts)]
        counts = np.diff(np.concatenate([[0], ends]))
        if odd.any():
            own = np.split(at, ends[:-1])
            for i in np.flatnonzero(odd):
                parts = _LONE.split(texts[int(i)].as_py())
                own[i] = self._codes([parts[0], *[" " + x for x in parts[1:]]])
            at, counts = np.concatenate(own), np.array([len(x) for x in own])
        self.recent = at
        begin = self.starts[at]
        lens = self.starts[at + 1] - begin
        ends = np.cumsum(lens)
        # A batch and what is kept have far fewer than 2^31 ids.
        where = np.repeat((begin - ends + lens).astype(np.int32), lens)
        where += np.arange(len(where), dtype=np.int32)
        ids = self.flat[where]
        before = np.concatenate([[0], ends])
        return ids, np.diff(before[np.concatenate([[0], np.cumsum(counts)])])


@lru_cache(maxsize=2)
def pieces(name: str, keeps_space: bool, kept: int = KEPT) -> Pieces:
    return Pieces(name, keeps_space, kept)


def forget() -> None:
    """Drops what a worker keeps for encoding; operators that do not encode call it, so that memory is theirs."""
    pieces.cache_clear()
