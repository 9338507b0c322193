"""A compressed FM-index over phrase sequences, searched for many patterns at once.

A text is parsed into phrases at content-defined boundaries (local minima of a rolling hash), so that texts which share a
span share the phrases inside it. The index is over the sequence of phrases: its Burrows-Wheeler transform lies in a
wavelet matrix whose levels are packed bits with counts every 64, about 1.5 bits a phrase and level."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_MIX1, _MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_powers = [np.ones(1, U64), np.ones(1, U64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    with np.errstate(over="ignore"):
        for k, base in ((0, _BASE), (1, _INVERSE)):
            while len(_powers[k]) < n:
                p = _powers[k]
                _powers[k] = np.concatenate([p, p * U64(pow(base, len(p), 2**64))])
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x = x * _MIX1
        x ^= x >> U64(27)
        x *= _MIX2
        x ^= x >> U64(31)
    return x


def prefix(codes: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums of code points, for span_hash."""
    with np.errstate(over="ignore"):
        return np.concatenate([np.zeros(1, U64), np.cumsum((codes.astype(U64) + U64(1)) * _power(len(codes))[0])])


def span_hash(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of codes[a:b], for arrays of bounds."""
    with np.errstate(over="ignore"):
        return mix((sums[b] - sums[a]) * _power(len(sums))[1][a] + (b - a).astype(U64))


def gram_hash(sums: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all grams of k code points."""
    n = len(sums) - k
    if n <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        return mix((sums[k:] - sums[:-k]) * _power(len(sums))[1][:n])


_OTHER = 0xD1342543DE82EF95 | 1
_other = [np.ones(1, U64), np.ones(1, U64)]


def window_hashes(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of all windows of k code points: other bases, over code points that are mixed first."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, U64)
    out = []
    with np.errstate(over="ignore"):
        while len(_other[0]) <= len(codes):
            m = len(_other[0])
            for j, base in ((0, _OTHER), (1, pow(_OTHER, -1, 2**64))):
                _other[j] = np.concatenate([_other[j], _other[j] * U64(pow(base, m, 2**64))])
        for salt, (up, down) in ((U64(0x2545F4914F6CDD1D), _power(len(codes) + 1)), (U64(0x9FB21C651E98DF25), tuple(_other))):
            sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(codes.astype(U64) + salt) * up[: len(codes)])])
            out.append(mix((sums[k:] - sums[:-k]) * down[:n]))
    return out[0], out[1]


def _slide(x: np.ndarray, w: int, fn) -> np.ndarray:
    """fn (minimum or maximum) over each window of w, in log2(w) passes."""
    y, size = x, 1
    while size * 2 <= w:
        y = fn(y[:-size], y[size:])
        size *= 2
    if size < w:
        y = fn(y[: len(x) - w + 1], y[w - size : w - size + len(x) - w + 1])
    return y


def slide_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each window of w (none if there are fewer)."""
    return _slide(x, w, np.minimum) if len(x) >= w else x[:0]


def minima(h: np.ndarray, w: int) -> np.ndarray:
    """Positions that are the minimum of some window of w consecutive hashes (all of them, on ties)."""
    if len(h) == 0:
        return np.zeros(0, np.int64)
    if len(h) <= w:
        return np.flatnonzero(h == h.min())
    low = _slide(h, w, np.minimum)  # by window start
    pad = np.zeros(w - 1, h.dtype)
    best = _slide(np.concatenate([pad, low, pad]), w, np.maximum)  # the highest of the minima around each position
    return np.flatnonzero(h == best)


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffixes of t in order, by doubling of ranks until all differ."""
    n = len(t)
    rank = np.unique(t, return_inverse=True)[1].astype(np.int64)
    size = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - size] = rank[size:] + 1 if size < n else 0
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        size *= 2
        if rank[order[-1]] == n - 1:
            return order


class Bits:
    """Packed bits with the number of ones before every 64: about 1.5 bits each."""

    def __init__(self, ones: np.ndarray) -> None:
        self.packed = np.packbits(np.concatenate([ones, np.zeros((-len(ones)) % 64 + 64, ones.dtype)]).astype(np.uint8), bitorder="little").view(U64)
        self.counts = np.concatenate([[0], np.cumsum(np.bitwise_count(self.packed))]).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each i."""
        word = i >> 6
        return self.counts[word] + np.bitwise_count(self.packed[word] & ((U64(1) << (i & 63).astype(U64)) - U64(1)))

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return ((self.packed[i >> 6] >> (i & 63).astype(U64)) & U64(1)).astype(np.int64)


class FMIndex:
    """Over symbols 0..sigma-1 with an owner per position. Each sequence ends in a symbol of its own.

    Kept are the transform in a wavelet matrix, a bit per row for whether the owner changes there, and every SAMPLE-th position of the
    suffix array with a bit per row for where: some (levels + 2) x 1.5 + 32 / SAMPLE bits a phrase."""

    SAMPLE = 8

    def __init__(self, t: np.ndarray, owner: np.ndarray) -> None:
        sa = suffix_array(t)
        self.n, self.sigma = len(t), int(t.max()) + 1
        x = t[sa - 1].astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=self.sigma))])  # suffixes by first symbol
        self.levels, self.zeros = [], []
        for bit in range(max(1, (self.sigma - 1).bit_length()) - 1, -1, -1):
            ones = (x >> bit) & 1
            self.levels.append((bit, Bits(ones)))
            self.zeros.append(self.n - int(ones.sum()))
            x = np.concatenate([x[ones == 0], x[ones == 1]])
        self.base = self._down(np.zeros(self.sigma, np.int64), np.arange(self.sigma))
        own = owner[sa]
        self.changes = Bits(np.concatenate([[0], own[1:] != own[:-1]]).astype(np.int64))
        taken = sa % self.SAMPLE == 0
        self.taken, self.samples = Bits(taken.astype(np.int64)), sa[taken].astype(np.int32)

    def _down(self, i: np.ndarray, c: np.ndarray) -> np.ndarray:
        for (bit, bits), zeros in zip(self.levels, self.zeros, strict=True):
            r = bits.rank(i)
            i = np.where((c >> bit) & 1, zeros + r, i - r)
        return i

    def _before(self, i: np.ndarray) -> np.ndarray:
        """The row of the suffix one symbol longer than that of each row i."""
        c = np.zeros(len(i), np.int64)
        for (bit, bits), zeros in zip(self.levels, self.zeros, strict=True):
            one = bits[i]
            r = bits.rank(i)
            c |= one << bit
            i = np.where(one, zeros + r, i - r)
        return self.start[c] + i - self.base[c]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where the suffixes of rows start: steps back to the next sampled position."""
        rows, out = rows.copy(), np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        steps = 0
        while len(todo):
            hit = self.taken[rows[todo]] > 0
            done = todo[hit]
            out[done] = self.samples[self.taken.rank(rows[done])] + steps
            todo = todo[~hit]
            rows[todo] = self._before(rows[todo])
            steps += 1
        return out

    def extend(self, lo: np.ndarray, hi: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the intervals of the patterns with c put in front."""
        at = self.start[c] - self.base[c]
        return at + self._down(lo, c), at + self._down(hi, c)

    def shared(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Whether an interval holds suffixes of more than one owner."""
        ok = lo < hi
        out = np.zeros(len(lo), bool)
        out[ok] = self.changes.rank(hi[ok]) > self.changes.rank(lo[ok] + 1)
        return out


def parse(codes: np.ndarray, gram: int, window: int) -> np.ndarray:
    """Phrase boundaries: positions of the codes where a phrase starts."""
    return minima(gram_hash(prefix(codes), gram), window)


#: Hits listed and compared at once.
HITS = 500_000


def matches(codes: np.ndarray, starts: np.ndarray, owner: np.ndarray, group: np.ndarray, least: int, gram: int = 12, window: int = 25) -> np.ndarray:
    """Where pieces share at least `least` code points with a piece of another owner and the same group.

    codes: all pieces one after another; starts: their bounds (one more than pieces); owner, group: by piece. Returns rows
    (piece, other piece, start in codes, other start in codes, length), each the whole run of equal code points along one
    diagonal of the two pieces, other owner > owner.

    Matching statistics by backward search: from right ends at most `step` apart, phrases are put in front while the
    interval still holds suffixes of other owners, until the pattern is as long as a shared span must make it; the
    suffixes in the interval are then compared code point by code point, HITS at a time."""
    none_found = np.zeros((0, 5), np.int64)
    sums = prefix(codes)
    h = gram_hash(sums, gram)
    none = np.iinfo(U64).max
    over = (starts[1:, None] - np.arange(1, gram)[None, :]).ravel()  # grams that run over the end of a piece are none
    h[over[(over >= 0) & (over < len(h))]] = none
    at = minima(h, window)
    at = at[h[at] != none]
    of = np.searchsorted(starts, at, side="right") - 1
    if len(at) < 2:
        return none_found
    last = np.concatenate([of[1:] != of[:-1], [True]])  # the last boundary of a piece starts no whole phrase: it is the end
    end = np.concatenate([at[1:], [0]])
    symbol = np.zeros(len(at), np.int64)
    whole = ~last
    symbol[last] = np.arange(int(last.sum()))
    phrase = span_hash(sums, at[whole], end[whole]) ^ mix(group[of[whole]].astype(U64))  # phrases of unlike groups are unlike
    symbol[whole] = np.unique(phrase, return_inverse=True)[1] + int(last.sum())
    solid = least - gram + 1 - 2 * (window - 1) - 2 * window  # code points of whole phrases that any shared span has
    step = max(1, solid // 3)
    goal = max(1, solid - step - window)  # what is left of them at the next right end
    index = FMIndex(symbol, owner[of])
    # right ends: the phrase starts at which a new stretch of `step` code points begins, phrases to their left
    stretch = (at - starts[of]) // step
    right = np.flatnonzero(np.concatenate([[False], (of[1:] == of[:-1]) & (stretch[1:] != stretch[:-1])]) | last)
    right = right[(at[right] - starts[of[right]]) >= goal]
    lo, hi = np.zeros(len(right), np.int64), np.full(len(right), index.n)
    back = np.ones(len(right), np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(right):
        k = right - back
        ok = (k >= 0) & (of[np.maximum(k, 0)] == of[right])
        right, lo, hi, back, k = right[ok], lo[ok], hi[ok], back[ok], k[ok]
        lo, hi = index.extend(lo, hi, symbol[k])
        ok = index.shared(lo, hi)
        right, lo, hi, back, k = right[ok], lo[ok], hi[ok], back[ok], k[ok]
        done = at[right] - at[k] >= goal
        found.append((k[done], lo[done], hi[done]))
        right, lo, hi, back = right[~done], lo[~done], hi[~done], back[~done] + 1
    k, lo, hi = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
    upto = np.cumsum(hi - lo)
    rows = [np.zeros((0, 3), np.int64)]
    begin = 0
    while begin < len(k):  # an interval is taken whole; it holds at most the pieces of the shard
        stop = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + HITS, side="right")))
        n = (hi - lo)[begin:stop]
        q = np.repeat(k[begin:stop], n)
        hit = index.locate(np.repeat(lo[begin:stop] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum())))
        ok = owner[of[q]] < owner[of[hit]]
        q, hit = q[ok], hit[ok]
        # one row per pair of pieces and diagonal
        rows = [np.unique(np.concatenate([*rows, np.stack([of[q], of[hit], at[q] - at[hit]], 1)]), axis=0)]
        begin = stop
    out = []
    for a, b, d in rows[0].tolist():
        x0 = max(int(starts[a]), int(starts[b]) + d)
        x1 = min(int(starts[a + 1]), int(starts[b + 1]) + d)
        if x1 - x0 < least:
            continue
        wrong = np.flatnonzero(codes[x0:x1] != codes[x0 - d : x1 - d])
        edge = np.concatenate([[-1], wrong, [x1 - x0]])
        for i in np.flatnonzero(np.diff(edge) > least).tolist():
            s = x0 + int(edge[i]) + 1
            out.append((a, b, s, s - d, int(edge[i + 1] - edge[i]) - 1))
    return np.array(out, np.int64).reshape(-1, 5) if out else none_found
