"""Whole texts to token ids with a public tokenizer file, encoding every distinct piece of text once per worker."""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from transitlapse.llm import scan

END_ID = 0
_MOST_KNOWN = 900_000  # pieces a worker remembers, about 40 bytes each; it starts anew beyond
_JOINED = 1_000

# The white space of Unicode as UTF-8, of one byte and of two or three.
_SPACE_1 = b"\t\n\x0b\x0c\r "
_SPACE_2 = [b"\xc2\x85", b"\xc2\xa0"]
_SPACE_3 = [b"\xe1\x9a\x80", b"\xe2\x80\x80", b"\xe2\x80\x81", b"\xe2\x80\x82", b"\xe2\x80\x83", b"\xe2\x80\x84",
            b"\xe2\x80\x85", b"\xe2\x80\x86", b"\xe2\x80\x87", b"\xe2\x80\x88", b"\xe2\x80\x89", b"\xe2\x80\x8a",
            b"\xe2\x80\xa8", b"\xe2\x80\xa9", b"\xe2\x80\xaf", b"\xe2\x81\x9f", b"\xe3\x80\x80"]
_IS_SPACE = np.isin(np.arange(256), list(_SPACE_1))
_LETTER = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
_MARK = np.isin(np.arange(256), list(b".,;:!?"))
_LEADS = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])


def _white(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a white-space character starts, and where one ends (its last byte)."""
    first = _IS_SPACE[buf]
    lead = np.flatnonzero(_LEADS[buf])
    if not len(lead):
        return first, first
    last = first.copy()
    for size, kinds in ((2, _SPACE_2), (3, _SPACE_3)):
        at = lead[lead + size <= len(buf)]
        code = sum(buf[at + i].astype(np.uint32) << np.uint32(8 * (size - 1 - i)) for i in range(size))
        at = at[np.isin(code, [int.from_bytes(k, "big") for k in kinds])]
        first[at] = True
        last[at + size - 1] = True
    return first, last


class Encoder:
    """Ids of whole texts.

    The byte-level pattern never joins what lies before a single space or line break with what follows, nor a plain
    letter with a punctuation mark after it, so texts are cut there. Each distinct piece is encoded once, found again
    by its 64-bit hash, and its ids are copied from then on. White space next to other white space is no cut.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        (self.newline,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self._forget()

    def _forget(self) -> None:
        none = np.zeros(0, np.uint64)
        self.tiers = [(none, np.zeros(0, np.int64)), (none, np.zeros(0, np.int64))]  # sorted hashes and their pieces
        self.begin, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _encode(self, pieces: list[bytes], plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces and the number of ids of each; plain ones (no inner white space) many in one text."""
        if not plain:
            ids = [np.array(e.ids, np.uint32)
                   for e in self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *ids]), np.array([len(x) for x in ids], np.int64)
        groups = [pieces[i : i + _JOINED] for i in range(0, len(pieces), _JOINED)]
        joined = [b"\n".join(g).decode() for g in groups]
        flat, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for g, e in zip(groups, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            cut = np.flatnonzero(ids == self.newline)
            if len(cut) != len(g) - 1:
                raise ValueError("this tokenizer file does not keep a line break apart")
            flat.append(np.delete(ids, cut))
            sizes.append(np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1)
        return np.concatenate(flat), np.concatenate(sizes)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of known pieces, -1 for others."""
        found = np.full(len(keys), -1, np.int64)
        for known, number in self.tiers:
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[at] == keys
                found[hit] = number[at[hit]]
        return found

    def _learn(self, keys: np.ndarray, pieces: list[bytes], plain: bool) -> np.ndarray:
        """Numbers of new pieces."""
        ids, sizes = self._encode(pieces, plain)
        number = np.arange(len(self.begin) - 1, len(self.begin) - 1 + len(pieces))
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, ids])
        merge = lambda a, b: (lambda k, n: (k[o := np.argsort(k)], n[o]))(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]))
        recent = merge(self.tiers[1], (keys, number))
        if 4 * len(recent[0]) > len(self.tiers[0][0]):
            self.tiers = [merge(self.tiers[0], recent), (np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        else:
            self.tiers[1] = recent
        return number

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts of a chunk one after the other, and the n + 1 offsets of each text's ids."""
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        starts, ends = _white(buf)
        after_white, before_white = np.zeros(len(buf), bool), np.zeros(len(buf), bool)
        after_white[1:], before_white[:-1] = ends[:-1], starts[1:]
        alone = ~after_white & ~before_white
        cut = ((buf == 32) | (buf == 10)) & alone
        cut[1:] |= (cut[:-1] & (buf[:-1] == 10)) | (_LETTER[buf[:-1]] & _MARK[buf[1:]])
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        begin = np.flatnonzero(cut)
        end = np.append(begin[1:], len(buf))
        white = np.concatenate([[0], np.cumsum(starts | ends)])
        odd = (white[end] > white[begin + 1]) | (starts[begin] & (end - begin == 1)) | (starts[begin] & (buf[begin] != 32))
        key = scan.Prefix(scan.BYTE_VALUES[buf]).window(begin, end)
        keys, at, back = np.unique(key, return_index=True, return_inverse=True)
        number = self._find(keys)
        if (fresh := np.flatnonzero(number < 0)).size:
            if len(self.begin) + len(fresh) > _MOST_KNOWN:
                self._forget()
                fresh = np.arange(len(keys))
            raw = buf.tobytes()
            for plain in (True, False):
                part = fresh[odd[at[fresh]] != plain]
                pick = at[part]
                pieces = [raw[a:b] for a, b in zip(begin[pick].tolist(), end[pick].tolist())]
                number[part] = self._learn(keys[part], pieces, plain)
        number = number[back]
        size = self.begin[number + 1] - self.begin[number]
        place = np.concatenate([[0], np.cumsum(size)])
        take = np.arange(place[-1]) + np.repeat(self.begin[number] - place[:-1], size)
        return self.ids[take], place[np.searchsorted(begin, offsets)]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_column(column: pa.Array, path: str) -> Iterator[np.ndarray]:
    """The ids of every text with the end id after them, one text after the other; null counts as empty."""
    own = encoder(path)
    for _, _, buf, offsets in scan.chunks(column):
        ids, place = own.encode(buf, offsets)
        for a, b in zip(place[:-1], place[1:]):
            yield np.append(ids[a:b], np.uint32(END_ID))
