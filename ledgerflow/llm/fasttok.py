"""Byte-level BPE over Arrow batches, equal to the tokenizers library id for id.

The pre-tokenizer of this vocabulary cuts a text into pieces that are encoded
independently. Here the cut is made with array passes over a whole batch, each
distinct piece is encoded once by the library's model and kept by its hash, and
the ids of a batch are gathered in one step. Texts with characters whose
class is not certain, or with a special-token string, go to the library whole.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np

from .text_core import span_hashes

OTHER, LETTER, NUMBER, SPACE, UNSURE = range(5)
# Blocks whose letters and digits have been stable across Unicode versions.
_STABLE = [(0x0021, 0x007F), (0x00A1, 0x0250), (0x0391, 0x03CE), (0x0410, 0x0450), (0x05D0, 0x05EB), (0x0621, 0x064B), (0x3041, 0x3097), (0x30A1, 0x30FB), (0x4E00, 0x9FA6), (0xAC00, 0xD7A4)]
_MARKS = [(0x2010, 0x2028), (0x2030, 0x205F), (0x20A0, 0x20AD)]
MAX_PIECES = 500_000  # kept by a worker; beyond it the table starts anew


def _byte_letters() -> np.ndarray:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256 on."""
    shown = np.zeros(256, bool)
    for lo, hi in ((0x21, 0x7F), (0xA1, 0xAD), (0xAE, 0x100)):
        shown[lo:hi] = True
    return np.where(shown, np.arange(256), 255 + np.cumsum(~shown)).astype("<u2")


def _classes() -> np.ndarray:
    t = np.full(0x110000, UNSURE, np.uint8)
    for lo, hi in _STABLE:
        for cp in range(lo, hi):
            kind = unicodedata.category(chr(cp))[0]
            t[cp] = {"L": LETTER, "N": NUMBER, "P": OTHER, "S": OTHER}.get(kind, UNSURE)
    for lo, hi in _MARKS:
        t[lo:hi] = OTHER
    t[[0x20, 0x09, 0x0A, 0x0D]] = SPACE
    return t


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.letters = _byte_letters()
        self.table = _classes()
        self.ascii = np.concatenate([self.table[:128], np.full(128, UNSURE, np.uint8)])
        self.specials = [t.content.encode()[:2] for t in self.tok.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.mask = (1 << 16) - 1
        self.slots = np.full(self.mask + 1, -1, np.int32)
        self.keys = np.zeros(1 << 15, np.uint64)
        self.start = np.zeros(1 << 15, np.int64)
        self.count = np.zeros(1 << 15, np.int64)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.n, self.used = 0, 0

    # -- a hash table of known pieces -------------------------------------
    def _find(self, h: np.ndarray) -> np.ndarray:
        at = (h & np.uint64(self.mask)).astype(np.int64)
        got = self.slots[at]
        todo = np.flatnonzero((got >= 0) & (self.keys[got] != h))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            got[todo] = self.slots[at[todo]]
            todo = todo[(got[todo] >= 0) & (self.keys[got[todo]] != h[todo])]
        return got

    def _place(self, index: np.ndarray) -> None:
        at = (self.keys[index] & np.uint64(self.mask)).astype(np.int64)
        while len(index):
            free = self.slots[at] < 0
            _, first = np.unique(at, return_index=True)
            win = np.zeros(len(index), bool)
            win[first] = True
            win &= free
            self.slots[at[win]] = index[win]
            index, at = index[~win], (at[~win] + 1) & self.mask

    def _add(self, h: np.ndarray, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> None:
        """Encode the pieces data[s:e], whose hashes are ``h``."""
        upto = np.concatenate([[0], np.cumsum(e - s)])
        own = data[np.repeat(s - upto[:-1], e - s) + np.arange(upto[-1])]
        text, at, cut = self.letters[own].tobytes().decode("utf-16-le"), upto.tolist(), self.model.tokenize
        got, each = [], []
        for a, b in zip(at, at[1:]):
            tokens = cut(text[a:b])
            each.append(len(tokens))
            got += [t.id for t in tokens]
        size, flat = np.array(each, np.int64), np.array(got, np.uint32)
        while self.n + len(h) > len(self.keys):
            self.keys, self.start, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.keys, self.start, self.count))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        new = np.arange(self.n, self.n + len(h))
        self.keys[new], self.count[new] = h, size
        self.start[new] = self.used + np.cumsum(size) - size
        self.pool[self.used : self.used + len(flat)] = flat
        self.n, self.used = self.n + len(h), self.used + len(flat)
        if self.n * 2 > self.mask:
            while self.n * 3 > self.mask:
                self.mask = self.mask * 2 + 1
            self.slots = np.full(self.mask + 1, -1, np.int32)
            new = np.arange(self.n)
        self._place(new)

    # -- where pieces begin --------------------------------------------------
    def _byte_classes(self, data: np.ndarray) -> np.ndarray:
        c = self.ascii[data]
        lead = np.flatnonzero(data >= 0xC0)
        if len(lead):
            b = data[lead].astype(np.int32)
            wide = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32) if len(lead) > len(data) // 8 else None
            get = (lambda k: wide[lead + k]) if wide is not None else (lambda k: data[np.minimum(lead + k, len(data) - 1)].astype(np.int32))
            x1, x2, x3 = get(1) & 0x3F, get(2) & 0x3F, get(3) & 0x3F
            two, three = b < 0xE0, (b >= 0xE0) & (b < 0xF0)
            cp = np.where(two, (b & 0x1F) << 6 | x1, np.where(three, (b & 0x0F) << 12 | x1 << 6 | x2, (b & 0x07) << 18 | x1 << 12 | x2 << 6 | x3))
            kind = self.table[np.minimum(cp, 0x10FFFF)]
            c[lead] = kind
            for k, has in ((1, np.ones(len(lead), bool)), (2, ~two), (3, ~two & ~three)):
                c[lead[has] + k] = kind[has]
        return c

    def _starts(self, data: np.ndarray, offs: np.ndarray, c: np.ndarray) -> np.ndarray:
        n = len(data)
        run = np.ones(n, bool)
        run[1:] = c[1:] != c[:-1]
        head = np.zeros(n, bool)
        head[offs[:-1][offs[:-1] < n]] = True
        run |= head
        space = c == SPACE
        flag = run & space
        i = np.flatnonzero(run & ~space)
        after = np.zeros(len(i), bool)
        inner = ~head[i]
        after[inner] = space[i[inner] - 1]
        flag[i[~after]] = True
        j = i[after]
        flag[j - 1] = True
        flag[j[data[j - 1] != 0x20]] = True
        quotes = np.flatnonzero((data == 0x27) & flag)
        if len(quotes):
            ends = offs[np.searchsorted(offs, quotes, "right")]
            low = np.concatenate([data, np.zeros(3, np.uint8)])
            x, y = low[quotes + 1], low[quotes + 2]
            one = np.isin(x, np.frombuffer(b"stmd", np.uint8)) & (quotes + 1 < ends)
            two = (((x == 0x72) | (x == 0x76)) & (y == 0x65) | (x == 0x6C) & (y == 0x6C)) & (quotes + 2 < ends)
            for q, e, k in ((quotes[one], ends[one], 1), (quotes[two & ~one], ends[two & ~one], 2)):
                flag[q + 1] = False
                rest = q + 1 + k
                ok = rest < e
                rest = rest[ok]
                flag[rest[c[rest] == LETTER]] = True
        return np.flatnonzero(flag)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, and ids per text."""
        n_docs = len(offs) - 1
        if len(data) == 0:
            return np.zeros(0, np.uint32), np.zeros(n_docs, np.int64)
        c = self._byte_classes(data)
        odd = np.unique(np.searchsorted(offs, np.flatnonzero(c == UNSURE), "right") - 1)
        for first, second in {tuple(s) for s in self.specials if len(s) == 2}:
            at = np.flatnonzero((data[:-1] == first) & (data[1:] == second))
            if len(at):
                odd = np.union1d(odd, np.searchsorted(offs, at, "right") - 1)
        s = self._starts(data, offs, c)
        if len(odd):  # their pieces are taken out; the library gives their ids below
            s = s[~np.isin(np.searchsorted(offs, s, "right") - 1, odd)]
            e = np.append(s[1:], len(data))
            e = np.minimum(e, offs[np.searchsorted(offs, s, "right")]) if len(s) else e[:0]
        else:
            e = np.append(s[1:], len(data))
        if self.n > MAX_PIECES:
            self._clear()
        h = span_hashes(data, s, e, False)
        got = self._find(h)
        miss = np.flatnonzero(got < 0)
        if len(miss):
            new, first = np.unique(h[miss], return_index=True)
            first = miss[first]
            self._add(new, data, s[first], e[first])
            got[miss] = self._find(h[miss])
        size = self.count[got]
        upto = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=upto[1:])
        ids = self.pool[np.repeat(self.start[got] - upto[:-1], size) + np.arange(upto[-1])]
        per = np.diff(upto[np.searchsorted(s, offs)])
        if len(odd):
            raw = data.tobytes()
            cut = np.split(ids, np.cumsum(per)[:-1])
            for i in odd.tolist():
                cut[i] = np.array(self.tok.encode(raw[offs[i] : offs[i + 1]].decode(), add_special_tokens=False).ids, np.uint32)
            ids, per = np.concatenate(cut), np.array([len(x) for x in cut], np.int64)
        return ids.astype(np.uint32, copy=False), per


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
