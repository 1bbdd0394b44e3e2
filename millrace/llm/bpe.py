"""Exact ids of the word-level BPE vocabulary, each distinct pre-token merged once.

The tokenizers library merges inside a pre-token only, so a text's ids are those
of its pre-tokens one after the other.  Pre-tokens of texts up to U+00FF are cut
here by byte class, as the vocabulary's own pattern cuts them; a distinct one is
merged by the library's model once and found by its hash from then on.  Texts with other
characters, or with a special string, go to the library whole (for counts, only their
words that hold such characters do).
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

from millrace.llm.textcore import VALUES, HashMap, ragged, slices, span_hashes

#: Forget the learned pre-tokens at this many, so that a worker's memory stays bounded.
MOST_PRETOKENS = 1 << 18

_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


def _class_tables() -> tuple[np.ndarray, np.ndarray]:
    """Classes of ASCII bytes, and of U+0080 to U+00FF."""
    import unicodedata

    def of(c: int) -> int:
        kind = unicodedata.category(chr(c))
        if c in (9, 10, 11, 12, 13, 0x85) or kind[0] == "Z":
            return _SPACE
        return {"L": _LETTER, "N": _NUMBER}.get(kind[0], _OTHER)

    one = np.array([of(c) if c < 128 else _SPACE for c in range(256)], dtype=np.uint8)
    return one, np.array([of(c) for c in range(128, 256)], dtype=np.uint8)


_ONE, _TWO = _class_tables()
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_CONTRACTED = {1: b"stmd", 2: (b"re", b"ve", b"ll")}


class WordBpe:
    """ids and counts of whole texts for one vocabulary file of that kind."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.shown = {b: c for c, b in _byte_characters().items()}
        self.special_heads = sorted({s[:2] for s in self.special})
        self.whole: HashMap | None = None
        self.clear()

    def clear(self) -> None:
        self.map = HashMap(17)
        self.flat, self.used = np.empty(1 << 16, dtype=np.uint32), 0
        self.at = np.zeros(1 << 16, dtype=np.int64)
        self.count = np.zeros(1 << 16, dtype=np.int64)

    def whole_tokens(self) -> np.ndarray:
        """Hashes of the vocabulary's strings that the library encodes alone as their own single token, proven one by one."""
        vocabulary = {v: k for k, v in self.library.get_vocab(with_added_tokens=False).items()}
        chars = _byte_characters()
        ids, texts = [], []
        for i, s in vocabulary.items():
            if s.endswith("</w>"):
                try:
                    texts.append(bytes(chars[c] for c in s[:-4]).decode())
                except (KeyError, UnicodeDecodeError):
                    continue
                ids.append(i)
        proven = []
        for a in range(0, len(texts), 1024):
            alone = self.library.encode_batch(texts[a : a + 1024], add_special_tokens=False)
            proven += [t.encode() for t, i, e in zip(texts[a : a + 1024], ids[a : a + 1024], alone, strict=True) if e.ids == [i]]
        ends = np.cumsum([len(t) for t in proven])
        block = np.frombuffer(b"".join(proven), dtype=np.uint8)
        return np.unique(span_hashes(block, np.concatenate([[0], ends[:-1]]), ends, VALUES))

    def pretokens(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(lower-cased bytes, starts, ends, whether a text must go to the library) of a block of texts."""
        n = len(data)
        cls, low = _ONE[data], _FOLD[data]
        high = data >= 0x80
        begins = np.zeros(n + 1, dtype=bool)
        begins[offsets] = True
        odd = np.zeros(len(offsets) - 1, dtype=bool)
        cont = None
        if high.any():
            lead = np.flatnonzero((data == 0xC2) | (data == 0xC3))
            code = ((data[lead].astype(np.int16) - 0xC2) << 6) + (data[np.minimum(lead + 1, n - 1)] - 0x80)
            code = np.clip(code, 0, 127)
            cls[lead] = cls[lead + 1] = _TWO[code]
            upper = lead[(code >= 0x40) & (code < 0x5F) & (code != 0x57)] + 1
            low[upper] += 32
            high[lead] = high[lead + 1] = False
            odd[np.searchsorted(offsets, np.flatnonzero(high), side="right") - 1] = True
            cont = lead + 1
        for head in self.special_heads:
            hits = np.flatnonzero((data[:-1] == head[0]) & (data[1:] == head[1]))
            for h in hits:
                if any(data[h : h + len(s)].tobytes() == s for s in self.special):
                    odd[np.searchsorted(offsets, h, side="right") - 1] = True
        edge = begins[:n].copy()
        edge[1:] |= cls[1:] != cls[:-1]
        edge |= cls == _NUMBER
        if cont is not None:
            edge[cont] = False
        starts = np.flatnonzero(edge)
        ends = np.append(starts[1:], n)
        keep = cls[starts] != _SPACE
        starts, ends = starts[keep], ends[keep]
        quote = np.flatnonzero((low[starts[:-1]] == 39) & (ends[:-1] - starts[:-1] == 1) & (starts[1:] == ends[:-1])) if len(starts) > 1 else []
        dropped = []
        for t in quote:
            s, e = starts[t + 1], ends[t + 1]
            if begins[s] or cls[s] != _LETTER:
                continue
            first, two = int(low[s]), low[s : min(e, s + 2)].tobytes()
            k = 2 if two in _CONTRACTED[2] else 1 if first in _CONTRACTED[1] else 0
            if k:
                ends[t] += k
                starts[t + 1] += k
                if starts[t + 1] == e:
                    dropped.append(t + 1)
        if dropped:
            starts, ends = np.delete(starts, dropped), np.delete(ends, dropped)
        return low, starts, ends, odd

    def learn(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The table's index for each pre-token; new ones are merged by the library first."""
        found = self.map.find(h)
        miss = np.flatnonzero(found < 0)
        if len(miss):
            new, first = np.unique(h[miss], return_index=True)
            first = miss[first]
            if self.map.n + len(new) > MOST_PRETOKENS and self.map.n:
                self.clear()
                return self.learn(low, starts, ends, h)
            merge = self.library.model.tokenize
            lists = [[t.id for t in merge(low[a:b].tobytes().decode("latin-1").translate(self.shown))] for a, b in zip(starts[first], ends[first], strict=True)]
            lengths = np.array([len(x) for x in lists], dtype=np.int64)
            need, base = self.used + int(lengths.sum()), self.map.n
            while need > len(self.flat):
                self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
            while base + len(new) > len(self.at):
                self.at, self.count = np.concatenate([self.at, np.zeros_like(self.at)]), np.concatenate([self.count, np.zeros_like(self.count)])
            self.flat[self.used : need] = np.fromiter((i for x in lists for i in x), dtype=np.uint32, count=int(lengths.sum()))
            self.at[base : base + len(new)] = self.used + np.cumsum(lengths) - lengths
            self.count[base : base + len(new)] = lengths
            self.used = need
            self.map.add(new)
            found[miss] = self.map.find(h[miss])
        return found

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, n + 1 offsets into them)."""
        ids, lengths = [], []
        for a, b in slices(offsets, 1 << 18):
            part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            if b - a > 1:
                own, n = self._block(part, off)
            else:
                own = np.concatenate([np.empty(0, dtype=np.uint32), *(self._block(part[at:to], np.array([0, to - at]))[0] for at, to in self._pieces(part))])
                n = np.array([len(own)], dtype=np.int64)
            ids.append(own)
            lengths.append(n)
        lengths = np.concatenate(lengths) if lengths else np.empty(0, dtype=np.int64)
        return np.concatenate(ids) if ids else np.empty(0, dtype=np.uint32), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)

    def counts(self, data: np.ndarray, offsets: np.ndarray, whole: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of each text, how many of them are whole-token pre-tokens); whole: what whole_tokens() gave elsewhere."""
        if self.whole is None:
            self.whole = HashMap(17)
            self.whole.add(self.whole_tokens() if whole is None else whole)
        tokens, short = np.zeros(len(offsets) - 1, dtype=np.int64), np.zeros(len(offsets) - 1, dtype=np.int64)
        for a, b in slices(offsets, 1 << 18):
            part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            pieces = self._pieces(part) if b - a == 1 else [(0, len(part))]
            for at, to in pieces:
                n, k = self._count_block(part[at:to], off if b - a > 1 else np.array([0, to - at]))
                tokens[a:b] += n
                short[a:b] += k
        return tokens, short

    def _count_block(self, part: np.ndarray, off: np.ndarray, cut: bool = False) -> tuple[np.ndarray, np.ndarray]:
        if not len(part):
            zero = np.zeros(len(off) - 1, dtype=np.int64)
            return zero, zero
        low, starts, ends, odd = self.pretokens(part, off)
        if odd.any() and not cut:
            # Only the words with such characters go to the library: a space behind a visible ASCII character begins a pre-token.
            space = np.flatnonzero((part[1:] == 32) & (part[:-1] > 32) & (part[:-1] < 127)) + 1
            fine = np.union1d(off, space[odd[np.searchsorted(off, space, side="right") - 1]])
            at = np.searchsorted(fine, off)
            tokens, short = self._count_block(part, fine, True)
            return tuple(np.diff(np.concatenate([[0], np.cumsum(x)])[at]) for x in (tokens, short))
        if odd.any():
            inside = ~odd[np.searchsorted(off, starts, side="right") - 1]
            starts, ends = starts[inside], ends[inside]
        h = span_hashes(low, starts, ends, VALUES)
        one = self.whole.find(h) >= 0
        count = np.ones(len(h), dtype=np.int64)
        rest = np.flatnonzero(~one)
        index = self.learn(low, starts[rest], ends[rest], h[rest])
        count[rest] = self.count[index]
        bounds = np.searchsorted(starts, off)
        tokens, short = (np.diff(np.concatenate([[0], np.cumsum(x)])[bounds]) for x in (count, one))
        rows = np.flatnonzero(odd)
        for i, e in zip(rows, self._whole_texts(part, off, rows), strict=True):
            tokens[i] = len(e.ids)
        return tokens, short

    def _whole_texts(self, part: np.ndarray, off: np.ndarray, rows: np.ndarray) -> list:
        return self.library.encode_batch_fast([part[off[i] : off[i + 1]].tobytes().decode() for i in rows], add_special_tokens=False) if len(rows) else []

    @staticmethod
    def _pieces(part: np.ndarray) -> list[tuple[int, int]]:
        """Pieces of one text, of about 256 KB and cut at a space, which no pre-token or special string crosses."""
        if len(part) <= 1 << 19:
            return [(0, len(part))]
        space, at, out = np.flatnonzero((part == 32) | (part == 10)), 0, []
        while at < len(part):
            k = int(np.searchsorted(space, at + (1 << 18)))
            to = int(space[k]) if k < len(space) else len(part)
            out.append((at, to))
            at = to
        return out

    def _block(self, part: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(part):
            return np.empty(0, dtype=np.uint32), np.zeros(len(off) - 1, dtype=np.int64)
        low, starts, ends, odd = self.pretokens(part, off)
        if odd.any():
            inside = ~odd[np.searchsorted(off, starts, side="right") - 1]
            starts, ends = starts[inside], ends[inside]
        index = self.learn(low, starts, ends, span_hashes(low, starts, ends, VALUES))
        count = self.count[index]
        ids = self.flat[ragged(self.at[index], count)]
        sums = np.concatenate([[0], np.cumsum(count)])
        bounds = sums[np.searchsorted(starts, off)]
        lengths = np.diff(bounds)
        if odd.any():
            rows = np.flatnonzero(odd)
            pieces, at = [], 0
            for i, e in zip(rows, self._whole_texts(part, off, rows), strict=True):
                pieces += [ids[at : bounds[i]], np.array(e.ids, dtype=np.uint32)]
                at, lengths[i] = bounds[i], len(e.ids)
            ids = np.concatenate([*pieces, ids[at:]])
        return ids, lengths


def _byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """The vocabulary at path, once per worker process."""
    return WordBpe(path)


def default_path() -> str:
    """Where this machine has the vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
