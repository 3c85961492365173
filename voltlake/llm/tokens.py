"""Token ids of whole texts by the tokenizers library, each different piece of text encoded once a worker.

Both vocabularies split a text before they merge.  No split part reaches from a non-space character over a following
space, nor from a letter or digit over a following comma or full stop.  A text whose only white space is space and
newline can so be cut before each run of white space, and before a comma or full stop behind a letter or digit, and
its pieces encoded on their own, with the same ids; any other text is encoded as a whole.  So is a text that holds the
string of one of the vocabulary's added tokens (the library reads it as that token), and one with a letter or digit
whose normalised form ends in neither (a mark that would join the stop behind it); these characters are found by asking
the vocabulary's own normaliser.

New pieces are encoded many at a time, joined by a newline and a control character that no piece holds: its id tells
where a piece ends.
"""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np

#: Different pieces and their characters that a worker remembers, characters of text that it cuts at a time, pieces encoded as one text.
REMEMBERED, REMEMBERED_CHARS, SLICE, JOINED = 1_200_000, 12_000_000, 1 << 20, 64
_PIECE, _PLAIN_PIECE = re.compile(r"[ \n]*[^ \n,.]+|[,.][^ \n]*|[ \n]+"), re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: White space of other kinds, or the mark; a comma or full stop that is not behind a letter or digit.
_WHOLE = "\x01\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ODD_STOP = re.compile(r"[,.](?<![^\W_].)")
_MARK = "\x01"


class _Numbered(dict):
    """Gives each key it hasn't seen the next number and notes it as new."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


class PieceEncoder:
    """encode(texts) -> (ids of all texts end to end, number of ids of each)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = re.compile(f"[{_WHOLE}{''.join(map(re.escape, self._not_ending_as_letters()))}]")  # one class: one look a character
        # where the vocabulary lowers letters anyway, pieces that differ in A-Z only are one
        self.lowers = [e.ids for e in self.tokenizer.encode_batch_fast(["AZ", "az"], add_special_tokens=False)]
        self.lowers = self.lowers[0] == self.lowers[1]
        self._forget()

    def _not_ending_as_letters(self) -> list[str]:
        """Letters and digits whose normalised form doesn't end in a letter or digit."""
        normaliser = self.tokenizer.normalizer
        if normaliser is None:
            return []
        letters = [c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isalnum()]
        alone = normaliser.normalize_str("|".join(letters)).split("|")  # one call for all, where bars stay as they are
        if len(alone) != len(letters):
            alone = map(normaliser.normalize_str, letters)
        return [c for c, n in zip(letters, alone, strict=True) if not n[-1:].isalnum()]

    def _is_whole(self, text: str, prepared: str) -> bool:
        return self.whole.search(prepared) is not None or any(a in text or a in prepared for a in self.added)

    def _prepared(self, texts: list[str]) -> list[str]:
        return [t.encode().lower().decode() for t in texts] if self.lowers else texts

    def _forget(self) -> None:
        self.known, self.chars = _Numbered(), 0
        self.ids, self.filled = np.zeros(1 << 16, np.uint32), 0
        self.start, self.lens, self.uses = (np.zeros(1 << 16, np.int32) for _ in range(3))

    def _thin(self) -> None:
        """Forgets the pieces that were met once since the last time (all, if most were met again)."""
        n = len(self.known)
        keep = np.nonzero(self.uses[:n] > 1)[0]
        names = list(self.known)
        keep = keep if len(keep) <= REMEMBERED // 2 and sum(len(names[k]) for k in keep) <= REMEMBERED_CHARS // 2 else keep[:0]
        kept, start, lens, ids, uses = [names[k] for k in keep], self.start[keep], self.lens[keep], self.ids, self.uses[keep]
        self._forget()
        self.known.update(zip(kept, range(len(kept)), strict=True))
        self.chars = sum(map(len, kept))
        self._room(len(kept))
        at, self.filled = np.cumsum(lens, dtype=np.int32) - lens, int(lens.sum())
        self.ids = ids[np.repeat(start - at, lens) + np.arange(self.filled, dtype=np.int32)]
        self.start[: len(kept)], self.lens[: len(kept)], self.uses[: len(kept)] = at, lens, uses // 2

    def _room(self, n: int) -> None:
        while n > len(self.start):
            self.start, self.lens, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.lens, self.uses))

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _each(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces end to end and the number of each; all begin, after white space, with a letter or digit."""
        (mark,) = self._encoded([_MARK])[0]
        after = len(self._encoded(["a\n"])[0]) - len(self._encoded(["a"])[0])  # ids of the newline before the mark
        joined = [f"\n{_MARK}".join(pieces[k : k + JOINED]) + f"\n{_MARK}" for k in range(0, len(pieces), JOINED)]
        ids = np.concatenate(self._encoded(joined))
        end = np.nonzero(ids == mark)[0]
        if len(end) != len(pieces):
            raise ValueError("a piece holds the mark")
        keep = np.ones(len(ids), bool)
        for k in range(after + 1):
            keep[end - k] = False
        return ids[keep], np.diff(end, prepend=-1) - 1 - after

    def _learn(self, pieces: list[str]) -> None:
        """pieces: those that were numbered last."""
        first = len(self.known) - len(pieces)
        self.chars += sum(map(len, pieces))
        plain = np.fromiter((p.lstrip(" \n")[:1].isalnum() for p in pieces), bool, len(pieces))
        got = self._encoded([pieces[k] for k in np.nonzero(~plain)[0]])
        ids, own = self._each([pieces[k] for k in np.nonzero(plain)[0]]) if plain.any() else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        ids = np.concatenate([ids, *got])
        lens = np.concatenate([own, np.fromiter(map(len, got), np.int64, len(got))])
        at = first + np.concatenate([np.nonzero(plain)[0], np.nonzero(~plain)[0]])
        self._room(len(self.known))
        end = self.filled + len(ids)
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(end, len(self.ids)), np.uint32)])
        self.ids[self.filled : end] = ids
        self.start[at], self.lens[at] = self.filled + np.cumsum(lens) - lens, lens
        self.filled = end

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces end to end, and the number of ids of each piece."""
        if len(self.known) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self._thin()
        which = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        if self.known.new:
            new, self.known.new = self.known.new, []
            self._learn(new)
        self.uses[: len(self.known)] += np.bincount(which, minlength=len(self.known)).astype(np.int32)
        start, lens = self.start[which], self.lens[which]
        first = np.cumsum(lens, dtype=np.int32) - lens
        at = np.repeat(start - first, lens)
        at += np.arange(len(at), dtype=np.int32)
        return self.ids[at], lens

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cut = [None if self._is_whole(t, p) else (_PLAIN_PIECE if _ODD_STOP.search(p) else _PIECE).findall(p) for t, p in zip(texts, self._prepared(texts), strict=True)]
        flat, lens = self._pieces(list(chain.from_iterable(c for c in cut if c is not None)))
        held = np.array([0 if c is None else len(c) for c in cut], np.int64)
        ends = np.concatenate([[0], np.cumsum(lens)])[np.cumsum(held)]
        counts = np.diff(ends, prepend=0)
        if None not in cut:
            return flat, counts
        whole, out = iter(self._encoded([t for t, c in zip(texts, cut, strict=True) if c is None])), []
        for k, c in enumerate(cut):
            out.append(next(whole) if c is None else flat[ends[k] - counts[k] : ends[k]])
            counts[k] = len(out[-1])
        return np.concatenate(out), counts


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One a worker and vocabulary: what it remembers lasts over tasks."""
    return PieceEncoder(path)


def slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Row ranges of about SLICE characters; a longer text stands alone."""
    at, held = 0, 0
    for k, t in enumerate(texts):
        if held and held + len(t) > SLICE:
            yield at, k
            at, held = k, 0
        held += len(t)
    if at < len(texts):
        yield at, len(texts)
