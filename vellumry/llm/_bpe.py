"""Token counts of byte-level BPE for many short pieces at once, in numpy.

A text is cut where the tokenizer's own pieces (those of GPT-2's expression) surely end, so counts of these pieces add up
to the whole text's. Short pieces of one kind of character are such a piece of the tokenizer each; their pairs are merged
here, one merge a round in every piece. All others are left to the library.
"""

from __future__ import annotations

import json

import numpy as np

from ._words import U64

#: Kinds of bytes: those of other characters, letters, digits, signs, the apostrophe, the space, other ASCII white space.
OTHER, LETTER, DIGIT, SIGN, APOSTROPHE, SPACE, BLANK = range(7)
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = SIGN
_KIND[[*range(65, 91), *range(97, 123)]] = LETTER
_KIND[48:58] = DIGIT
_KIND[39], _KIND[32], _KIND[9:14] = APOSTROPHE, SPACE, BLANK
#: The kinds of which one piece of the tokenizer may consist.
_GROUP = np.array([0, 1, 2, 3, 3, 4, 4], np.uint8)

#: Where a piece surely ends between two bytes, by kind: no alternative of the expression holds both. After an apostrophe
#: a contraction may begin, a space is joined to what follows, and of other characters nothing is known.
_ENDS = np.zeros(64, bool)
for _a, _b in (
    *((LETTER, b) for b in (DIGIT, SIGN, APOSTROPHE)), *((DIGIT, b) for b in (LETTER, SIGN, APOSTROPHE)), (SIGN, LETTER), (SIGN, DIGIT),
    *((BLANK, b) for b in (LETTER, DIGIT, SIGN, APOSTROPHE)),
):
    _ENDS[_a * 8 + _b] = True
_BLANKS = np.zeros(64, bool)
_BLANKS[[a * 8 + b for a in (SPACE, BLANK) for b in (SPACE, BLANK)]] = True

#: White space beyond ASCII, as the first bytes of UTF-8 with what may follow them.
_LONG_BLANKS = {
    b"\xc2": [b"\x85", b"\xa0"], b"\xe1\x9a": [b"\x80"], b"\xe2\x81": [b"\x9f"], b"\xe3\x80": [b"\x80"],
    b"\xe2\x80": [bytes([c]) for c in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)],
}
#: Bytes of the longest piece that is merged here, and pieces that are merged together.
SHORT, TOGETHER = 32, 1 << 14
_NONE = np.uint32(0xFFFFFFFF)


def kinds(data: np.ndarray) -> np.ndarray:
    """The kind of each byte; the letters from U+00C0 to U+00FF are known as letters."""
    out = _KIND[data]
    at = np.flatnonzero(data[:-1] == 0xC3)
    at = at[(data[at + 1] != 0x97) & (data[at + 1] != 0xB7)]
    out[at] = out[at + 1] = LETTER
    return out


def blanks(data: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text belong to white space."""
    out = kind >= SPACE
    for head, tails in _LONG_BLANKS.items():
        n = len(head)
        at = np.flatnonzero(data[: -n or None] == head[0])
        at = at[at + n < len(data)]
        for k in range(1, n):
            at = at[data[at + k] == head[k]]
        at = at[np.isin(data[at + n], np.frombuffer(b"".join(tails), np.uint8))]
        for k in range(n + 1):
            out[at + k] = True
    return out


def piece_starts(data: np.ndarray, kind: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """First bytes of the pieces of texts that begin at ``texts``."""
    blank = blanks(data, kind)
    new = blank.copy()
    new[1:] &= ~blank[:-1]
    pair = kind[:-1] * 8 + kind[1:]
    new[1:] |= _ENDS[pair]
    # of several blanks before a character that is none, the last stands apart
    last = np.flatnonzero(_BLANKS[pair[:-1]] & (kind[2:] != OTHER) & (kind[2:] < SPACE)) + 1
    first = np.zeros(len(data), bool)
    first[texts] = True
    new[last[~first[last + 1]]] = True
    return np.flatnonzero(new | first)


def alike(kind: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which pieces are, after a space at most, characters of one known group: one piece of the tokenizer each."""
    group = _GROUP[kind]
    change = np.zeros(len(kind), np.int32)
    np.cumsum(group[1:] != group[:-1], dtype=np.int32, out=change[1:])
    body = start + ((kind[start] == SPACE) & (end - start > 1))
    return (group[body] > 0) & (change[body] == change[end - 1])


def _characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in seen else next(rest)) for b in range(256)]


class Merges:
    """The merges of a byte-level BPE in an open hash table of their pairs."""

    BITS = 18

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.base = np.uint32(max(vocab.values()) + 2)
        #: Stands before and after the tokens of a piece; no pair has it.
        self.nothing = self.base - np.uint32(1)
        self.of_byte = np.array([vocab[c] for c in _characters()], np.uint32)
        self.made = np.array([vocab[a + b] for a, b in merges], np.uint32)
        key = np.array([vocab[a] for a, _ in merges], np.uint32) * self.base + np.array([vocab[b] for _, b in merges], np.uint32)
        self.key, self.rank = np.full(1 << self.BITS, _NONE), np.full(1 << self.BITS, _NONE)
        rank, slot = np.arange(len(key), dtype=np.uint32), self._slots(key)
        while len(rank):
            _, one = np.unique(slot, return_index=True)
            one = one[self.key[slot[one]] == _NONE]
            self.key[slot[one]], self.rank[slot[one]] = key[rank[one]], rank[one]
            rank, slot = np.delete(rank, one), (np.delete(slot, one) + 1) & ((1 << self.BITS) - 1)
        #: Ranks of all pairs of bytes.
        self.first = self.ranks(np.repeat(self.of_byte, 256), np.tile(self.of_byte, 256))

    @classmethod
    def of(cls, tokenizer) -> Merges | None:
        """Those of a tokenizer of the library, or None if more than GPT-2's expression and these merges makes its tokens."""
        c = json.loads(tokenizer.to_str())
        pre, model = c["pre_tokenizer"] or {}, c["model"]
        plain = (
            pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not c["normalizer"] and not c["truncation"] and not c["padding"]
            and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
            and all(t["special"] for t in c["added_tokens"]) and tokenizer.encode_special_tokens
        )
        if not plain or not set(_characters()) <= set(model["vocab"]) or max(model["vocab"].values()) >= (1 << 16) - 2 or len(model["merges"]) > 1 << 16:
            return None
        return cls(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])

    def _slots(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.BITS)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of tokens, or _NONE."""
        key = a * self.base + b
        slot = self._slots(key)
        there = self.key[slot]
        out = np.where(there == key, self.rank[slot], _NONE)
        on = np.flatnonzero((there != key) & (there != _NONE))
        while len(on):
            slot[on] = (slot[on] + 1) & ((1 << self.BITS) - 1)
            there = self.key[slot[on]]
            out[on] = np.where(there == key[on], self.rank[slot[on]], _NONE)
            on = on[(there != key[on]) & (there != _NONE)]
        return out

    def counts(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokens of the pieces data[start : start + size], of SHORT bytes at most."""
        out = np.empty(len(start), np.int64)
        order = np.argsort(size, kind="stable")
        ascending, at = size[order], 0
        while at < len(order):
            least = int(ascending[at])
            to = min(at + TOGETHER, int(np.searchsorted(ascending, least + max(3, least // 2))))
            out[order[at:to]] = self._merged(data, start[order[at:to]], ascending[at:to])
            at = to
        return out

    def _merged(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokens of pieces of about one length, one a column. The pair of least rank is merged, the first of equal ones."""
        n, m = int(size[-1]), len(size)
        count = size.astype(np.int64)
        row = np.arange(n)[:, None]
        byte = data[np.minimum(start + row, len(data) - 1)]
        token = np.full((n + 2, m), self.nothing, np.uint32)
        token[1:-1] = np.where(row < size, self.of_byte[byte], self.nothing)
        # a pair is kept at its first token, as rank * 64 + place
        pair = np.full((n + 2, m), _NONE, np.uint32)
        rank = self.first[byte[:-1].astype(np.uint16) * np.uint16(256) + byte[1:]]
        pair[1:n] = np.where((rank == _NONE) | (row[1:] >= size), _NONE, rank * np.uint32(64) + row[1:].astype(np.uint32))
        place = np.arange(n + 2, dtype=np.int8)[:, None]
        after, before = np.repeat(place + np.int8(1), m, 1), np.repeat(place - np.int8(1), m, 1)
        piece = np.arange(m)
        while True:
            best = pair.min(0)
            live = np.flatnonzero(best != _NONE)
            if not len(live):
                return count
            best = best[live]
            if len(live) < 0.7 * m:
                token, pair, after, before, piece = (np.take(x, live, -1) for x in (token, pair, after, before, piece))
                m = len(live)
                live = np.arange(m)
            count[piece[live]] -= 1
            flat_token, flat_pair, flat_after, flat_before = token.reshape(-1), pair.reshape(-1), after.reshape(-1), before.reshape(-1)
            p = (best & np.uint32(63)).astype(np.int64)
            new = self.made[best >> np.uint32(6)]
            at = p * m + live
            gone = flat_after[at].astype(np.int64) * m + live
            right = flat_after[gone].astype(np.int64)
            left = flat_before[at].astype(np.int64)
            right_at, left_at = right * m + live, left * m + live
            flat_token[at] = new
            flat_pair[gone] = _NONE
            flat_after[at] = right
            flat_before[right_at] = p
            rank = self.ranks(np.concatenate((new, flat_token[left_at])), np.concatenate((flat_token[right_at], new)))
            where = np.concatenate((p, left)).astype(np.uint32)
            flat_pair[np.concatenate((at, left_at))] = np.where(rank == _NONE, _NONE, rank * np.uint32(64) + where)
