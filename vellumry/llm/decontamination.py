"""Operator 2: benchmark items inside documents, by the q-gram lemma over diagonal bands and banded alignment.

An item of m characters that occurs with at most k edits shares at least m + 1 - (k + 1) q of its q-grams with the
occurrence, all on diagonals at most k apart. Diagonals are grouped in bands of 2 (k + 1) that overlap by half, so
every such occurrence lies in one band; bands with enough shared q-grams are kept and aligned. k is ``rate`` of the
item's length, lowered for short items to what leaves a positive bound. Both sides are compared in a normal form: lower
case, letters and digits kept, every run of other characters one space.
"""

from __future__ import annotations

import bisect
import math
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import portions
from ._words import U64, mix

Q, RATE = 7, 0.13
#: The lemma asks for few grams of Q characters, which are cheap to find, and for many of these, which are tested later.
FINE = 3
#: Items whose counts and masks a task remembers.
KNOWN_BAGS = 2000
#: Matched places of a text that are counted together, which bounds memory.
HIT_CHUNK = 1 << 16
#: Bands of all items that are counted in one array; beyond, their numbers are sorted.
DENSE_KEYS = 1 << 20
#: Share of an item, from its beginning or up to its end, that is a match where the whole is not found.
SHARE = 0.75
#: Shorter items (in the normal form) are looked for without edits, on word boundaries.
MIN_CHARS = 40
#: Characters of the least item searched, where one of U+3000 on counts as three; what is less says too little as text.
MIN_WEIGHT = 10
#: Benchmark text that one pass holds in memory; a larger benchmark is split and the documents are read once per part.
PART_CHARS = 16 << 20
_BITS = 20
_LAST = 0x3000


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the normal form, and for each the place in ``text`` it stands for."""
    low = text.lower()
    if len(low) != len(text):  # a few characters change length; keep those as they are
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    code = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    keep = _is_word(code)
    lead = keep.copy()
    lead[1:] |= keep[:-1]  # a separator right after a word character stands for the run
    lead[:1] = keep[:1]
    at = np.flatnonzero(lead)
    out = np.where(keep[at], code[at], 32).astype(np.uint32)
    if len(out) and out[-1] == 32:
        at, out = at[:-1], out[:-1]
    return out, at


_table = np.array([unicodedata.category(chr(c))[0] in "LN" for c in range(0x3000)])


def _is_word(code: np.ndarray) -> np.ndarray:
    """Letters, digits and everything from U+3000 on."""
    return (code >= 0x3000) | _table[np.minimum(code, 0x2FFF)]


def grams(code: np.ndarray, q: int = Q) -> np.ndarray:
    """64-bit hashes of the q-grams, by doubling: each step joins two hashes of half the length."""
    if len(code) < q:
        return np.zeros(0, U64)
    length, h, done, taken = 1, code.astype(U64) + U64(1), None, 0
    while True:
        if q & length:
            part = h[taken:]
            if done is None:
                done = part
            else:
                n = min(len(done), len(part))
                done = done[:n] * U64(0xD6E8FEB86659FD93) + part[:n]
            taken += length
        if taken == q:
            return mix(done[: len(code) - q + 1])
        h = h[:-length] * U64(0x9E3779B97F4A7C15) + h[length:]
        h ^= h >> U64(29)
        length *= 2


def budget(m: int, rate: float = RATE, q: int = Q) -> tuple[int, int]:
    """(k, least shared q-grams) for an item of m characters."""
    k = max(0, min(int(rate * m), m // q - 2))
    return k, max(1, m + 1 - (k + 1) * q)


def masks(item: np.ndarray) -> dict[int, int]:
    """For each character the bits of its places in the item."""
    out: dict[int, int] = {}
    for i, c in enumerate(item.tolist()):
        out[c] = out.get(c, 0) | 1 << i
    return out


def near(bits: dict[int, int], m: int, text: np.ndarray, k: int) -> tuple[int, int] | None:
    """(edits, end) of the occurrence of an item of m characters with fewest edits, if at most k (Myers' bit vectors)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, cost = full, 0, m
    best, end = k + 1, 0
    get = bits.get
    for at, c in enumerate(text.tolist()):
        eq = get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (full & ~(xh | plus))
        mh = plus & xh
        if ph & top:
            cost += 1
        elif mh & top:
            cost -= 1
            if cost < best:
                best, end = cost, at + 1
        ph = ph << 1 & full
        plus = (mh << 1 & full) | (full & ~(xv | ph))
        minus = ph & xv
    return (best, end) if best <= k else None


def align(item: list[int], text: list[int], k: int) -> tuple[int, int] | None:
    """(edits, characters taken) of the best alignment of the whole ``item`` with a beginning of ``text``, with at most k
    edits: only the 2 k + 1 diagonals around the first are filled, row by row. Of equals the one of nearly the item's length."""
    big, width, n = len(item) + k + 1, 2 * k + 1, len(text)
    row = [big] * k + list(range(k + 1))  # cell d has taken d - k characters of the text more than of the item
    for i, c in enumerate(item, 1):
        new, before = [big] * width, big
        for d in range(max(0, k - i), min(width, n - i + k + 1)):
            j = i + d - k
            cost = row[d] + (text[j - 1] != c) if j else big
            if d + 1 < width and row[d + 1] + 1 < cost:  # skip a character of the item
                cost = row[d + 1] + 1
            if before + 1 < cost:  # skip a character of the text
                cost = before + 1
            new[d] = before = cost
        row = new
    best = min(row)
    if best > k:
        return None
    d = min((d for d in range(width) if row[d] == best), key=lambda d: abs(d - k))
    return best, len(item) + d - k


def weight(code: np.ndarray) -> int:
    return len(code) + 2 * int((code >= 0x3000).sum())


def _string(code: np.ndarray) -> str:
    return code.tobytes().decode("utf-32-le", "surrogatepass")


def _regions(starts: list[int], ends: list[int], low: int, high: int, need: int) -> bool:
    """Whether low..high has ``need`` places in a row outside the sorted disjoint regions."""
    i = bisect.bisect_right(ends, low)
    at = low
    while i < len(starts) and starts[i] < high:
        if starts[i] - at >= need:
            return True
        at = max(at, ends[i])
        i += 1
    return high - at >= need


class Index:
    """Where each q-gram of the items occurs: places at most k + 1 apart, which fall into neighbouring half bands, are one
    entry, so that a text of one repeated letter has as many hits as any other."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE, q: int = Q):
        self.q, self.ids, self.codes, self.budgets = q, [], [], []
        self.short: dict[str, list[int]] = {}
        self._automaton = None
        self._fine: np.ndarray | None = None
        self._letters: np.ndarray | None = None
        self._bags: dict[tuple[int, int, int], np.ndarray] = {}
        self._masks: dict[tuple[int, int, int], dict[int, int]] = {}
        hashes, place, which = [], [], []
        for item_id, text in items:
            code, _ = normal(text)
            if len(code) < max(MIN_CHARS, 2 * q):
                if weight(code) >= MIN_WEIGHT:
                    self.short.setdefault(_string(code), []).append(item_id)
                continue
            g = grams(code, q)
            hashes.append(g)
            place.append(np.arange(len(g)))
            which.append(np.full(len(g), len(self.ids)))
            self.ids.append(item_id)
            self.codes.append(code)
            self.budgets.append(budget(len(code), rate, q))
        if not self.ids:
            return
        self.k = np.array([k for k, _ in self.budgets])
        self.size = np.array([len(c) for c in self.codes])
        self.step = int(self.k.min()) + 1
        h, p, w = np.concatenate(hashes), np.concatenate(place), np.concatenate(which)
        order = np.lexsort((p, w, h))
        h, p, w = h[order], p[order], w[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1]) | (p[1:] - p[:-1] > self.k[w[1:]] + 1)
        at = np.flatnonzero(new)
        self.low, self.high, self.which = p[at], p[np.append(at[1:], len(p)) - 1], w[at]
        self.keys, self.first, self.count = np.unique(h[at], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[self.keys >> U64(64 - _BITS)] = True
        #: Of each key the items that begin with it; of each item the gram that ends it.
        self.ends = np.array([g[-1] for g in hashes])
        begin = np.searchsorted(self.keys, np.array([g[0] for g in hashes]))
        order = np.argsort(begin, kind="stable")
        self.beginners = order
        self.begin_first = np.searchsorted(begin[order], np.arange(len(self.keys)))
        self.begin_count = np.bincount(begin, minlength=len(self.keys))
        #: Characters of the share, or 0 where it would be too short, and its budget.
        self.share = [c if (c := math.ceil(SHARE * len(code))) >= max(MIN_CHARS, 2 * q) else 0 for code in self.codes]
        self.part = [budget(c, rate, q) if c else b for c, b in zip(self.share, self.budgets)]
        self.least = np.array([min(t, s) for (_, t), (_, s) in zip(self.budgets, self.part)])

    def bands(self, at: np.ndarray, found: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, band, places of the text in it that share a q-gram with the item on the band's diagonals), for the bands
        with enough of them. Band b holds the diagonals from b (k + 1) on, 2 (k + 1) of them."""
        shift = int(self.size.max()) // self.step + 2
        width = length // self.step + shift + 3
        few = len(self.ids) * width <= DENSE_KEYS
        keys, counts = [], []
        for lo in range(0, len(at), HIT_CHUNK):
            a, f = at[lo : lo + HIT_CHUNK], found[lo : lo + HIT_CHUNK]
            n = self.count[f]
            entry = np.repeat(self.first[f] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            item = self.which[entry]
            step = self.k[item] + 1
            place = np.repeat(a, n)
            first = (place - self.high[entry]) // step - 1
            many = (place - self.low[entry]) // step - first + 1
            base = item * width + first + shift
            key = np.repeat(base - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
            if few:
                c = np.bincount(key, minlength=len(self.ids) * width)
                counts = [counts[0] + c] if counts else [c]
                continue
            key, c = np.unique(key, return_counts=True)
            keys.append(key)
            counts.append(c)
        if few:
            key = np.flatnonzero((counts[0].reshape(len(self.ids), width) >= self.least[:, None]).ravel())
            return key // width, key % width - shift, counts[0][key]
        key, c = keys[0], counts[0]
        if len(keys) > 1:
            key, back = np.unique(np.concatenate(keys), return_inverse=True)
            c = np.bincount(back, np.concatenate(counts)).astype(np.int64)
        some = c >= self.least[key // width]
        key, c = key[some], c[some]
        return key // width, key % width - shift, c

    def unedited(self, code: np.ndarray, g: np.ndarray, at: np.ndarray, found: np.ndarray) -> dict[int, list[int]]:
        """Of each item that stands in the text letter for letter its places, from left to right without overlaps."""
        some = np.flatnonzero(self.begin_count[found])
        at, found = at[some], found[some]
        n = self.begin_count[found]
        item = self.beginners[np.repeat(self.begin_first[found] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        place = np.repeat(at, n)
        last = place + self.size[item] - self.q
        inside = last < len(g)
        item, place, last = item[inside], place[inside], last[inside]
        same = g[last] == self.ends[item]
        out: dict[int, list[int]] = {}
        for i, a in zip(item[same].tolist(), place[same].tolist()):
            places = out.get(i)
            if (not places or a >= places[-1] + len(self.codes[i])) and np.array_equal(code[a : a + len(self.codes[i])], self.codes[i]):
                out.setdefault(i, []).append(a)
        return out

    def _prepare(self) -> None:
        """Numbers of the shorter grams: for alphabets of up to 127 characters by a table, else by their sorted hashes."""
        letters = np.unique(np.concatenate(self.codes))
        if FINE == 3 and len(letters) < 128 and letters[-1] < _LAST:
            self._letters = np.zeros(_LAST + 1, np.int32)
            self._letters[letters] = np.arange(1, len(letters) + 1)
            some = np.unique(np.concatenate([self._triples(c) for c in self.codes]))
            self._table = np.full(1 << 21, len(some), np.int32)
            self._table[some] = np.arange(len(some))
            self._fine = some
        else:
            self._fine = np.unique(np.concatenate([grams(c, FINE) for c in self.codes]))

    def _triples(self, code: np.ndarray) -> np.ndarray:
        c = self._letters[np.minimum(code, _LAST)]
        return c[:-2] << 14 | c[1:-1] << 7 | c[2:]

    def _fine_places(self, code: np.ndarray) -> np.ndarray:
        """The number of each shorter gram of the text among those of all items; the last number is for the others."""
        if self._fine is None:
            self._prepare()
        if self._letters is not None:
            return self._table[self._triples(code)]
        g = grams(code, FINE)
        at = np.searchsorted(self._fine, g)
        at[at == len(self._fine)] = 0
        return np.where(self._fine[at] == g, at, len(self._fine))

    def _shared(self, i: int, a: int, b: int, fine: np.ndarray, lo: int, hi: int) -> int:
        """How many of the shorter grams lo..hi shares with characters a..b of item i, each counted at most as often as
        both have it."""
        have = self._bags.get((i, a, b))
        if have is None:
            if len(self._bags) >= KNOWN_BAGS:
                self._bags.clear()
            have = self._bags[i, a, b] = np.bincount(self._fine_places(self.codes[i][a:b]), minlength=len(self._fine) + 1)
            have[-1] = 0
        return int(np.minimum(np.bincount(fine[lo:hi], minlength=len(have)), have).sum())

    def _aligned(self, i: int, a: int, b: int, code: np.ndarray, low: int, high: int, k: int) -> tuple[int, int, int] | None:
        """(edits, start, end) of the best occurrence of characters a..b of item i around these diagonals."""
        if (i, a, b) not in self._masks:
            if len(self._masks) >= KNOWN_BAGS:
                self._masks.clear()
            self._masks[i, a, b] = masks(self.codes[i][a:b])
        lo = max(0, low + a - k)
        around = code[lo : max(lo, high + b + k + 1)]
        got = near(self._masks[i, a, b], b - a, around, k)
        if not got:
            return None
        edits, end = got
        # the end is known: the start is where the alignment of both reversed ends
        back = around[max(0, end - (b - a) - edits) : end][::-1].tolist()
        edits, taken = align(self.codes[i][a:b][::-1].tolist(), back, edits)
        return edits, lo + end - taken, lo + end

    def _find_short(self, code: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Regions equal to a short item that begin and end at a word boundary; CJK characters are bounded anywhere."""
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for item in self.short:
                self._automaton.add_word(item, item)
            self._automaton.make_automaton()
        text = _string(code)

        def bounded(a: int) -> bool:
            return not 0 < a < len(text) or " " in text[a - 1 : a + 1] or max(text[a - 1 : a + 1]) >= "\u3000"

        out, done = [], {}
        for last, item in self._automaton.iter(text):
            a = last + 1 - len(item)
            if a >= done.get(item, 0) and bounded(a) and bounded(last + 1):
                done[item] = last + 1
                out += [(i, int(at[a]), int(at[last]) + 1, 0) for i in self.short[item]]
        return out

    def find(self, text: str, any_one: bool = False) -> list[tuple[int, int, int, int]]:
        """(item_id, start, end, edits) of each region of the text that an item matches, or with ``any_one`` of some."""
        if not text or not (self.ids or self.short):
            return []
        code, at = normal(text)
        short = self._find_short(code, at) if self.short else []
        if short and any_one:
            return short
        return sorted(short + self._find_long(code, at, any_one), key=lambda r: (r[1], r[0] is None, r[0]))

    def _find_long(self, code: np.ndarray, at: np.ndarray, any_one: bool) -> list[tuple[int, int, int, int]]:
        """Items are found letter for letter first, then within their budgets, then in parts; regions of one item don't
        overlap. Of a region's neighbouring bands the one with fewest edits counts."""
        if not self.ids or len(code) < self.q:
            return []
        g = grams(code, self.q)
        place = np.flatnonzero(self.seen[g >> U64(64 - _BITS)])
        found = np.searchsorted(self.keys, g[place])
        found[found == len(self.keys)] = 0
        real = self.keys[found] == g[place]
        place, found = place[real], found[real]
        if len(place) < self.least.min():
            return []
        out: list[tuple[int, int, int, int]] = []

        def region(i: int, start: int, end: int, edits: int) -> tuple[int, int, int, int]:
            return self.ids[i], int(at[start]), int(at[end - 1]) + 1, edits

        exact = self.unedited(code, g, place, found)
        for i, places in exact.items():
            out += [region(i, a, a + len(self.codes[i]), 0) for a in places]
        if out and any_one:
            return out
        items, bands, shared = self.bands(place, found, len(code))
        fine = self._fine_places(code) if len(items) else place
        edits_of: dict[tuple[int, int], int] = {}
        edge = np.flatnonzero(np.append(True, items[1:] != items[:-1])) if len(items) else []
        for lo, hi in zip(edge, [*edge[1:], len(items)]):
            i = int(items[lo])
            m, c = len(self.codes[i]), self.share[i]
            starts = list(exact.get(i, ()))
            ends = [a + m for a in starts]
            tries = [(0, m, *self.budgets[i])]
            if c:
                tries += [(0, c, *self.part[i]), (m - c, m, *self.part[i])]
            step, need = int(self.k[i]) + 1, min(b - a - k for a, b, k, _ in tries)
            fewest = [b - a + 1 - (k + 1) * FINE for a, b, k, _ in tries]
            some = []
            for band, n in zip(bands[lo:hi].tolist(), shared[lo:hi].tolist()):
                begin, end = max(0, band * step - step), min(len(code), (band + 2) * step + m + step)
                if _regions(starts, ends, begin, end, need) and (both := self._shared(i, 0, m, fine, begin, end)) >= min(fewest):
                    some.append((band, n, both))
            for (a, b, k, least), few in zip(tries if some else (), fewest):
                last: tuple[int, int, int, int] | None = None  # band, start, end, edits of the latest region of this try
                for band, n, both in some:
                    if n < least or both < few:
                        continue
                    low = band * step
                    high = low + 2 * step - 1
                    again = last is not None and band <= last[0] + 2
                    if not again and not _regions(starts, ends, max(0, low + a - k), min(len(code), high + b + k + 1), b - a - k):
                        continue
                    if b - a < m and self._shared(i, a, b, fine, max(0, low + a - k), high + b + k + 1) < few:
                        continue
                    got = self._aligned(i, a, b, code, low, high, k)
                    if not got or got[2] <= got[1]:
                        continue
                    edits, s, e = got
                    if again and s < last[2] and last[1] < e:
                        if edits >= last[3]:
                            continue
                        at_old = starts.index(last[1])
                        del starts[at_old], ends[at_old]
                    x = bisect.bisect_right(ends, s)
                    if x < len(starts) and starts[x] < e:
                        if again and s < last[2] and last[1] < e:  # the old region stays: the new one meets another
                            bisect.insort(starts, last[1])
                            bisect.insort(ends, last[2])
                        continue
                    starts.insert(x, s)
                    ends.insert(x, e)
                    last = (band, s, e, edits)
                    edits_of[i, s] = edits
                    if any_one:
                        return [region(i, s, e, edits)]
            known = set(exact.get(i, ()))
            out += [region(i, s, e, edits_of[i, s]) for s, e in zip(starts, ends) if s not in known]
        return out


def _parts(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in lists of at most PART_CHARS characters (one item at least), fetched as needed."""
    part, size = [], 0
    for r in benchmark.select("item_id", "text").filter("text is not null").dropDuplicates().orderBy("item_id", "text").toLocalIterator():
        if part and size + len(r.text) > PART_CHARS:
            yield part
            part, size = [], 0
        part.append((r.item_id, r.text))
        size += len(r.text)
    yield part


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, start, end, edits): regions of whole documents that match a whole item within its edit budget,
    or, where the whole is not found, the first or last SHARE of it within that part's budget (edits are then the part's).

    start and end are characters of the text, end exclusive. Items shorter than MIN_CHARS in the normal form match
    without edits, on word boundaries; those of ``not_searchable`` and null texts match nothing; a null doc_id is carried as it is; equal items under different ids are each reported,
    equal rows of the benchmark once, equal rows of documents each. Other columns are not read. The benchmark is held in
    parts of a bounded size; the documents are scanned once for each part and never shuffled.
    """
    return _located(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, rate).drop("node")


def not_searchable(benchmark: DataFrame) -> DataFrame:
    """(item_id, text) of the benchmark's items that are never looked for: null, or under MIN_WEIGHT in the normal form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            yield batch.filter(pa.array([t is None or weight(normal(t)[0]) < MIN_WEIGHT for t in batch.column("text").to_pylist()], pa.bool_()))

    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "item_id long, text string")


def _located(docs: DataFrame, benchmark: DataFrame, rate: float) -> DataFrame:
    sc = docs.sparkSession.sparkContext
    keyed = docs.select("doc_id", F.xxhash64("text").alias("node"), "text")
    found = None
    for part in _parts(benchmark):
        index = sc.broadcast(Index(part, rate))

        def scan(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in portions(batches):
                at, rows = [], []
                for i, text in enumerate(batch.column("text")):
                    for r in index.value.find(text.as_py() or ""):
                        at.append(i)
                        rows.append(r)
                if at:
                    take = pa.array(at)
                    item, start, end, edits = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(take), batch.column("node").take(take), pa.array(item, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(edits, pa.int32())],
                        ["doc_id", "node", "item_id", "start", "end", "edits"],
                    )

        one = keyed.mapInArrow(scan, "doc_id long, node long, item_id long, start int, end int, edits int")
        found = one if found is None else found.unionByName(one)
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """``docs`` without the rows in which an item is found, all columns as they were, in one pass without a shuffle.

    Definitions are those of ``contaminated``; rows with null or empty text stay.
    """
    sc, schema = docs.sparkSession.sparkContext, docs.schema
    at = docs.columns.index("text")
    out = docs
    for part in _parts(benchmark):
        index = sc.broadcast(Index(part, rate))

        def clean(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in portions(batches):
                keep = [not index.value.find(text.as_py() or "", True) for text in batch.column(at)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        out = out.mapInArrow(clean, schema)
    return out


def op2_contaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every region of the documents table that matches an item of the benchmark table."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
