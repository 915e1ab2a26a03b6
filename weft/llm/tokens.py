"""Token ids of whole texts with the tokenizers library, cached by word.

Both vocabularies split a text at ASCII white space before any merge, so the ids of a text
are those of its words in a row, each with the space or the line break before it.  A worker
keeps the ids of the words that it has seen, in a table of flat arrays that is probed for a
whole batch at once (by a 128-bit hash of the word); the new words of a batch are encoded by
the library in one text, with a separator between them whose id no word can have.  Texts
with other white space, or runs of it that the vocabulary might join, are encoded whole.
The table is emptied when it is full, so memory is bounded.
"""

from __future__ import annotations

import os

import numpy as np
import xxhash

#: white space besides the ASCII six, separators that some libraries count as such too, and the
#: control signs used as marks here
ODD_ASCII = [chr(c) for c in (1, 2, 3, *range(0x1C, 0x20))]
ODD = ODD_ASCII + [chr(c) for c in (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), *range(0x2028, 0x2030), *range(0x205F, 0x2065), 0x3000, 0xFEFF)]
#: white space other than single spaces, and one or two line breaks, inside a text
UNEVEN = ["  ", "\n\n\n", "\n ", " \n", "\t", "\x0b", "\x0c", "\r"]
#: words that the table holds (some 70 bytes each)
CACHE = 1_500_000
#: marks of a word behind a line break and of a text's first word; others follow a space
BREAK, FIRST = b"\x02", b"\x03"

_open: dict[str, Encoder] = {}


def public_path(name: str) -> str:
    """Place of a public vocabulary file on this machine (the package is on every worker)."""
    import public_tokenizers
    return public_tokenizers.path(name)


class WordTable:
    """Words by a 128-bit hash, open addressing in flat arrays, and their ids in one more."""

    def __init__(self, words: int, kind=np.uint32):
        self.kind, self.room, size = kind, words, 1 << (2 * words - 1).bit_length()
        self.mask = np.uint64(size - 1)
        self.first, self.second = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.at, self.count = np.zeros(size, np.uint32), np.zeros(size, np.int32)
        self.clear()

    def clear(self) -> None:
        self.first[:] = 0
        self.ids, self.used, self.n = np.zeros(1 << 20, self.kind), 0, 0

    @staticmethod
    def hashes(words: list[bytes]) -> np.ndarray:
        h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(-1, 2).copy()
        h[:, 0] |= np.uint64(1)  # 0 marks a free place
        return h

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each word, -1 for words that are not there."""
        out = np.full(len(h), -1, np.int64)
        left, place = np.arange(len(h)), h[:, 1] & self.mask
        while len(left):
            at = place.astype(np.int64)
            there = self.first[at]
            hit = (there == h[left, 0]) & (self.second[at] == h[left, 1])
            out[left[hit]] = at[hit]
            go = ~hit & (there != 0)
            left, place = left[go], (place[go] + np.uint64(1)) & self.mask
        return out

    def add(self, h: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Distinct new words with their ids, end to end."""
        if self.n + len(h) > self.room:
            self.clear()
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), self.ids.dtype)])
        self.ids[self.used:self.used + len(ids)] = ids
        starts = self.used + np.cumsum(counts) - counts
        self.used, self.n = self.used + len(ids), self.n + len(h)
        left, place = np.arange(len(h)), h[:, 1] & self.mask
        while len(left):
            at = place.astype(np.int64)
            free = self.first[at] == 0
            # of several words for one free place the last one written stays
            self.first[at[free]] = h[left[free], 0]
            self.second[at[free]] = h[left[free], 1]
            won = free & (self.first[at] == h[left, 0]) & (self.second[at] == h[left, 1])
            self.at[at[won]], self.count[at[won]] = starts[left[won]], counts[left[won]]
            left, place = left[~won], (place[~won] + np.uint64(1)) & self.mask


class Encoder:
    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(name if os.path.sep in name else public_path(name))
        self.tok.encode_special_tokens = True  # their strings in a text are ordinary text
        self.drops_space = self.whole([" "])[0] == b""
        self.between = " \x01 " if self.drops_space else "\n"
        self.break_ids = np.frombuffer(self.whole(["\n"])[0], "<u4")
        (self.mark,) = np.frombuffer(self.whole([self.between.strip(" ")])[0], "<u4")
        self.small = self.tok.get_vocab_size() <= 1 << 16
        self.table = WordTable(CACHE, np.uint16 if self.small else np.uint32)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new words, end to end, and the number of each; a thousand words in one text."""
        out, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for lo in range(0, len(words), 1000):
            part = [w.decode("utf-8") for w in words[lo:lo + 1000]]
            if not self.drops_space:  # a word behind a line break is the break and the word alone
                part = [w[1:] if w[:1] in ("\x02", "\x03") else " " + w for w in part]
            ids = np.frombuffer(self.whole([self.between.join(part)])[0], "<u4")
            ends = np.append(np.flatnonzero(ids == self.mark), len(ids))
            if len(ends) == len(part):
                n = np.diff(np.append(-1, ends)) - 1
                ids = np.delete(ids, ends[:-1])
            else:  # cannot be, but a wrong split would be silent
                each = [np.frombuffer(x, "<u4") for x in self.whole(part)]
                n, ids = np.array([len(x) for x in each], np.int64), np.concatenate(each)
            out.append(ids)
            counts.append(n)
        return np.concatenate(out), np.concatenate(counts)

    def _by_word(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        if self.drops_space:
            words = [t.encode().split() for t in texts]
        else:
            words = [(FIRST + t.encode().replace(b"\n", b" " + BREAK)).split(b" ") for t in texts]
        lengths = np.array([len(w) for w in words])
        flat = [x for w in words for x in w]
        h = self.table.hashes(flat)
        place = self.table.find(h)
        new = np.flatnonzero(place < 0)
        if len(new):
            _, one = np.unique(h[new].view("V16").ravel(), return_index=True)
            some = new[np.sort(one)]
            ids, counts = self._encode_words([flat[i] for i in some.tolist()])
            before = self.table.n
            self.table.add(h[some], ids, counts)
            # a table that was emptied on the way has lost the words found before
            look = new if self.table.n > before else None
            if look is None:
                return self.whole(texts)
            place[new] = self.table.find(h[new])
        start, count = self.table.at[place].astype(np.int64), self.table.count[place].astype(np.int64)
        if not self.drops_space:  # one more id in front of a word behind a line break
            broken = np.array([x[:1] == BREAK for x in flat])
            return self._gather(start, count, lengths, broken)
        return self._gather(start, count, lengths, None)

    def _gather(self, start: np.ndarray, count: np.ndarray, lengths: np.ndarray, broken: np.ndarray | None) -> list[bytes]:
        """Ids of the texts: each word's run of the table's ids, in order."""
        extra = np.zeros(len(count), np.int64) if broken is None else broken * len(self.break_ids)
        whole = count + extra
        ends = np.cumsum(whole)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
        begin = ends - whole + extra
        run = np.cumsum(count) - count
        at = np.arange(int(count.sum()))
        out[at + np.repeat(begin - run, count)] = self.table.ids[at + np.repeat(start - run, count)]
        if broken is not None and broken.any():
            for k, x in enumerate(self.break_ids.tolist()):
                out[(ends - whole)[broken] + k] = x
        cut = np.append(0, ends)[np.append(0, np.cumsum(lengths))]
        raw = out.astype("<u4").tobytes()
        return [raw[4 * a:4 * b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]

    def _is_plain(self, t: str) -> bool:
        if any(c in t for c in (ODD_ASCII if t.isascii() else ODD)):
            return False
        return self.drops_space or not (t[0] in " \n" or t[-1] in " \n" or any(x in t for x in UNEVEN))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text (null: none)."""
        out = [b""] * len(texts)
        plain, rest = [], []
        for i, t in enumerate(texts):
            if t:
                (plain if self._is_plain(t) else rest).append(i)
        for at, how in ((plain, self._by_word), (rest, self.whole)):
            for i, ids in zip(at, how([texts[i] for i in at])):
                out[i] = ids
        return out


def encoder(name: str) -> Encoder:
    """This worker's encoder for a vocabulary (kept while the worker lives)."""
    if name not in _open:
        _open[name] = Encoder(name)
    return _open[name]
