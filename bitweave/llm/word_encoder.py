"""Ids of whole texts for tokenizers that drop white space and end words at it, a table of words at a time.

The tokenizer's normaliser and pre-tokenizer never join what a blank or line break separates, so a text's ids are those
of its pieces between blanks. Pieces repeat: a hash table of numpy arrays, which lives as long as the worker, has the ids
of those met before, found by hash and confirmed by all of their bytes. New pieces of lower-case Latin letters, perhaps
with a full stop or comma behind, go through the vocabulary's merges, all at once; other new pieces to the tokenizers
library. Whole texts go to the library if they hold a special string, a NUL or a character beyond Latin (U+0250 and up,
or the dotted capital I): below that, Python's lower case is the library's and composition changes nothing.

That holds for tokenizer files of one shape only (``SHAPE``); texts for any other file are encoded by the library alone.
"""

from __future__ import annotations

import json
import re

import numpy as np

from bitweave.llm.held import held
from bitweave.llm.token_counts import tokenizer

_OTHER = re.compile("[^\x00-įı-ɏ]")


class Merges:
    """Byte-pair merges of many words at once, for a tokenizer of byte symbols with a suffix on a word's last one.

    All words lie in one array of symbols. A round finds each word's pair of lowest rank, merges it wherever the word has
    it (a merge made from a product always ranks after the product's own, so these commute), and looks ranks up again
    only beside what changed. Words without a pair leave the array.
    """

    NONE = np.int32(2**31 - 1)

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        chars = _byte_chars()
        self.inner = np.array([vocab.get(c, -1) for c in chars], np.int32)
        self.final = np.array([vocab.get(c + suffix, -1) for c in chars], np.int32)
        self.width = np.uint64(max(vocab.values()) + 1)
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([vocab[a] for a, _ in pairs], np.uint64) * self.width + np.array([vocab[b] for _, b in pairs], np.uint64)
        made = [vocab[a + b[:]] if a + b in vocab else -1 for a, b in pairs]
        bits = int(np.ceil(np.log2(len(keys) * 6)))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64)
        self.rank, self.made = np.full(1 << bits, self.NONE, np.int32), np.zeros(1 << bits, np.int32)
        with np.errstate(over="ignore"):
            slots = self._slot(keys)
        for rank, (slot, key) in enumerate(zip(slots.tolist(), keys)):
            while self.keys[slot] != np.iinfo(np.uint64).max:
                slot = (slot + 1) & self.mask
            self.keys[slot], self.rank[slot], self.made[slot] = key, rank, made[rank]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair, NONE if it never merges, and the slot that has its product."""
        keys = a.astype(np.uint64) * self.width + b.astype(np.uint64)
        slot = self._slot(keys)
        got = self.keys[slot]
        open_ = np.flatnonzero((got != keys) & (got != np.iinfo(np.uint64).max))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            g = self.keys[slot[open_]]
            open_ = open_[(g != keys[open_]) & (g != np.iinfo(np.uint64).max)]
        return self.rank[slot], slot

    def encode(self, raw: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All words' ids, in order, and the number of each word's; ``raw``: their bytes, ``n``: how many each has, never 0."""
        sym = self.inner[raw]
        last = np.cumsum(n) - 1
        sym[last] = self.final[raw[last]]
        word = np.repeat(np.arange(len(n), dtype=np.int32), n)
        rank = np.full(len(sym), self.NONE, np.int32)  # of the pair that begins here
        slot = np.zeros(len(sym), np.int64)
        at = np.flatnonzero(word[1:] == word[:-1])
        rank[at], slot[at] = self.look_up(sym[at], sym[at + 1])
        done_word, done_sym = [], []
        while len(sym):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low = np.minimum.reduceat(rank, first)
            length = np.diff(np.r_[first, len(sym)])
            each = np.repeat(low, length)
            over = each == self.NONE
            if over.any():
                done_word.append(word[over])
                done_sym.append(sym[over])
                on = ~over
                sym, word, rank, slot, each = sym[on], word[on], rank[on], slot[on], each[on]
                if not len(sym):
                    break
            hit = rank == each
            if (hit[1:] & hit[:-1]).any():  # a pair of equal symbols in a run: every second one, from the left
                p = np.arange(len(hit))
                start = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], p, 0))
                hit &= (p - start) % 2 == 0
            i = np.flatnonzero(hit)
            sym[i] = self.made[slot[i]]
            keep = np.ones(len(sym), bool)
            keep[i + 1] = False
            changed = np.zeros(len(sym), bool)
            changed[i] = True
            sym, word, rank, slot, changed = sym[keep], word[keep], rank[keep], slot[keep], changed[keep]
            changed[:-1] |= changed[1:]
            i = np.flatnonzero(changed)
            rank[i] = self.NONE
            i = i[i + 1 < len(sym)]
            i = i[word[i] == word[i + 1]]
            rank[i], slot[i] = self.look_up(sym[i], sym[i + 1])
        word, sym = np.concatenate(done_word), np.concatenate(done_sym)
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(n))


def _byte_chars() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


def ragged(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (n[0] of them), start[1], ..."""
    first = np.cumsum(n) - n
    return np.arange(int(n.sum())) + np.repeat(start - first, n)


_EMPTY = np.uint64(0)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
LONGEST = 32


class WordEncoder:
    def __init__(self, path: str, bits: int = 20):
        self.tok = tokenizer(path)
        self.merges = Merges(path)
        self.dots = {c: self.whole([c])[0] for c in ".,"}
        self.specials = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.bits = bits
        # a byte of a letter a-z, or a lead or later byte of U+00C0 to U+024F; x and / at U+00D7 and U+00F7 are weeded out by pair
        self.lead = np.zeros(256, bool)
        self.lead[0xC3:0xCA] = True
        self.reset()

    def reset(self) -> None:
        self.hash = np.zeros(1 << self.bits, np.uint64)
        self.key = np.zeros((1 << self.bits, LONGEST // 8), np.uint64)
        self.at = np.zeros(1 << self.bits, np.int32)
        self.n = np.zeros(1 << self.bits, np.int16)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.filled = self.pooled = 0

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def plain(self, text: str) -> bool:
        return "\x00" not in text and not any(s in text for s in self.specials) and (text.isascii() or not _OTHER.search(text))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, in order, and the number of each text's; no ids are added."""
        plain = [self.plain(t) for t in texts]
        ids, n = self._pieces([t.lower() if p else "" for t, p in zip(texts, plain)])
        if not all(plain):
            odd = [i for i, p in enumerate(plain) if not p]
            cuts = np.cumsum(n)
            parts, last = [], 0
            for i, own in zip(odd, self.whole([texts[i] for i in odd])):
                parts += [ids[last : cuts[i]], own]
                last = int(cuts[i])
                n[i] = len(own)
            ids = np.concatenate([*parts, ids[last:]])
        return ids, n

    def _pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [t.encode() for t in texts]
        size = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
        flat = b"\n".join(raw) + b"\n" + bytes(LONGEST)
        buf = np.frombuffer(flat, np.uint8)
        own = buf[:-LONGEST]
        gap = np.flatnonzero((own == 32) | (own == 10))
        start = np.r_[0, gap[:-1] + 1]
        length = gap - start
        some = length > 0
        start, length = start[some], length[some]
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        short = length <= LONGEST
        at, n = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        extra: list[np.ndarray] = []
        if short.all():
            at, n = self._known(buf, start, length)
        else:
            at[short], n[short] = self._known(buf, start[short], length[short])
            far = np.flatnonzero(~short)
            base = self.pooled
            for i, ids in zip(far.tolist(), self.whole([flat[s : s + m].decode() for s, m in zip(start[far].tolist(), length[far].tolist())])):
                at[i], n[i] = base, len(ids)
                base += len(ids)
                extra.append(ids)
        pool = np.concatenate([self.pool[: self.pooled], *extra]) if extra else self.pool
        ids = pool[ragged(at, n)]
        first = np.searchsorted(start, np.cumsum(size) - size)
        sums = np.r_[0, np.cumsum(n)]
        return ids, sums[np.r_[first[1:], len(start)]] - sums[first]

    def _known(self, buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in the pool each piece's ids are, and how many; learns what is new."""
        words = np.ndarray((len(buf) - 7,), "<u8", buffer=buf, strides=(1,))
        key = np.zeros((len(start), LONGEST // 8), np.uint64)
        key[:, 0] = words[start] & _MASK[np.minimum(length, 8)]
        rows = np.flatnonzero(length > 8)
        for k in range(1, LONGEST // 8):
            rows = rows[length[rows] > 8 * k]
            if not len(rows):
                break
            key[rows, k] = words[start[rows] + 8 * k] & _MASK[np.minimum(length[rows] - 8 * k, 8)]
        h = key[:, 0] * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        rows = np.flatnonzero(length > 8)
        g = h[rows]
        for k in range(1, LONGEST // 8):
            g = (g ^ key[rows, k]) * np.uint64(0xBF58476D1CE4E5B9)
            g ^= g >> np.uint64(31)
        h[rows] = g
        h *= np.uint64(0x94D049BB133111EB)
        h[h == _EMPTY] = 1
        slot = self._find(h, key)
        new = np.flatnonzero(slot < 0)
        if len(new):
            # one of each new piece, by all its bytes
            order = new[np.lexsort((*key[new].T, h[new]))]
            differs = np.r_[True, (h[order[1:]] != h[order[:-1]]) | (key[order[1:]] != key[order[:-1]]).any(1)]
            reps = order[differs]
            if self.filled + len(reps) > 0.6 * len(self.hash):
                self.reset()
                if len(reps) <= 0.3 * len(self.hash):
                    return self._known(buf, start, length)
                self.bits += 1  # one text has more pieces than the table holds
                self.reset()
                return self._known(buf, start, length)
            self._learn(buf, start[reps], length[reps], h[reps], key[reps])
            slot[new] = self._find(h[new], key[new])
        return self.at[slot].astype(np.int64), self.n[slot].astype(np.int64)

    def _find(self, h: np.ndarray, key: np.ndarray) -> np.ndarray:
        """The slot of each piece, -1 if the table hasn't got it."""
        mask = len(self.hash) - 1
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.full(len(h), -1)
        rows = np.arange(len(h))
        while len(rows):
            got = self.hash[slot]
            same = got == h[rows]
            i = np.flatnonzero(same)
            true = (self.key[slot[i]] == key[rows[i]]).all(1)
            out[rows[i[true]]] = slot[i[true]]
            same[i[~true]] = False
            on = ~same & (got != _EMPTY)
            rows, slot = rows[on], (slot[on] + 1) & mask
        return out

    def _learn(self, buf: np.ndarray, start: np.ndarray, length: np.ndarray, h: np.ndarray, key: np.ndarray) -> None:
        at, n, pool = self._ids(buf, start, length)
        need = self.pooled + len(pool)
        if need > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.pooled], np.zeros(need, np.uint32)])
        self.pool[self.pooled : need] = pool
        at = at + self.pooled
        self.pooled = need
        mask = len(self.hash) - 1
        rows, slot = np.arange(len(h)), (h >> np.uint64(64 - self.bits)).astype(np.int64)
        winner = np.zeros(len(self.hash), np.int32) if len(h) > 1 << 16 else None
        while len(rows):
            free = np.flatnonzero(self.hash[slot] == _EMPTY)
            if winner is None:
                s, i = np.unique(slot[free], return_index=True)
                i = free[i]
            else:
                winner[slot[free]] = free
                i = free[winner[slot[free]] == free]
                s = slot[i]
            r = rows[i]
            self.hash[s], self.key[s], self.at[s], self.n[s] = h[r], key[r], at[r], n[r]
            on = np.ones(len(rows), bool)
            on[i] = False
            rows, slot = rows[on], (slot[on] + 1) & mask
        self.filled += len(h)

    def _ids(self, buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Offset, number and pool of the ids of new pieces."""
        last = buf[start + length - 1]
        dot = np.where((length > 1) & ((last == 46) | (last == 44)), 1, 0)
        body = length - dot
        where = ragged(start, body)
        b, nxt = buf[where], buf[where + 1]
        lower = (b >= 97) & (b <= 122)
        lead = self.lead[b] & (nxt >= 0x80) & (nxt < 0xC0) & ~((b == 0xC3) & ((nxt == 0x97) | (nxt == 0xB7))) & ~((b == 0xC9) & (nxt > 0x8F))
        later = np.r_[False, lead[:-1]]
        good = lower | lead | later
        first = np.cumsum(body) - body
        simple = np.add.reduceat(~good, first) == 0
        at, n = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        pools, base = [], 0
        i = np.flatnonzero(simple)
        if len(i):
            ids, own = self.merges.encode(buf[ragged(start[i], body[i])], body[i])
            # room behind each word for the mark that follows it
            n[i] = own + dot[i]
            at[i] = np.cumsum(n[i]) - n[i]
            pool = np.zeros(int(n[i].sum()), np.uint32)
            pool[ragged(at[i], own)] = ids
            d = i[dot[i] == 1]
            pool[at[d] + n[d] - 1] = np.where(last[d] == 46, self.dots["."][0], self.dots[","][0])
            pools.append(pool)
            base = len(pool)
        i = np.flatnonzero(~simple)
        if len(i):
            flat = buf.tobytes()
            own = self.whole([flat[s : s + m].decode() for s, m in zip(start[i].tolist(), length[i].tolist())])
            n[i] = list(map(len, own))
            at[i] = base + np.cumsum(n[i]) - n[i]
            pools += own
        return at, n, np.concatenate(pools) if pools else np.zeros(0, np.uint32)


#: What a tokenizer file must say for its words to be encoded apart, besides special strings and the vocabulary.
SHAPE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False},
}


def by_words(path: str) -> bool:
    """Whether :class:`WordEncoder` may encode for that file."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    model = {k: v for k, v in d["model"].items() if k not in ("vocab", "merges")}
    plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in d.get("added_tokens") or [])
    return plain and d.get("normalizer") == SHAPE["normalizer"] and d.get("pre_tokenizer") == SHAPE["pre_tokenizer"] and model == SHAPE["model"]


class LibraryEncoder:
    """The same for any tokenizer file: all texts by the library."""

    def __init__(self, path: str):
        self.tok = tokenizer(path)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for ids in got for i in ids], np.uint32), np.array(list(map(len, got)), np.int64)


def encoder(path: str) -> WordEncoder | LibraryEncoder:
    return held(("words", path), lambda: WordEncoder(path) if by_words(path) else LibraryEncoder(path))


def portions(texts: list[str], chars: int = 1 << 20):
    """Index ranges of about ``chars`` characters each."""
    lo = size = 0
    for hi, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield lo, hi + 1
            lo, size = hi + 1, 0
    if lo < len(texts):
        yield lo, len(texts)
