"""Induced suffix sorting of a text that fits memory, and the inducing scan that suffix_sort runs over files as well.

Symbols: 0 ends the text (once); the order of the others is theirs.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np

SERVED = 1 << 16
TUPLE = np.dtype([("at", np.int64), ("lcp", np.int32)])


class RadixQueue:
    """First-in first-out runs of tuples by symbol, in memory."""

    def __init__(self):
        self.runs: dict[int, list[np.ndarray]] = defaultdict(list)

    def put(self, keys: np.ndarray, heads: np.ndarray, tuples: np.ndarray) -> None:
        """Tuples sorted by key; heads are the places where keys change."""
        for k, a, z in zip(keys[heads].tolist(), heads.tolist(), [*heads[1:].tolist(), len(keys)], strict=True):
            self.runs[k].append(tuples[a:z])

    def serve(self, symbol: int) -> Iterator[np.ndarray]:
        """Blocks of the symbol's run, those put meanwhile included, oldest first."""
        while runs := self.runs.pop(symbol, None):
            block = runs[0] if len(runs) == 1 else np.concatenate(runs)
            for a in range(0, len(block), SERVED):
                yield block[a : a + SERVED]


def _range_least(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """min(values[first..last]) for each pair, by a sparse table over the block."""
    span = (last - first + 1).astype(np.int64)
    level = np.frexp(span.astype(np.float64))[1] - 1
    out = np.empty(len(first), values.dtype)
    table = values
    for k in range(int(level.max()) + 1 if len(level) else 0):
        if k:
            half = 1 << (k - 1)
            table = np.minimum(table[:-half], table[half:])
        some = np.flatnonzero(level == k)
        out[some] = np.minimum(table[first[some]], table[last[some] - (1 << k) + 1])
    return out


class Scan:
    """One inducing scan: hands each served block's left neighbours to the queue, with their common prefixes if carried."""

    def __init__(self, text: np.ndarray, queue, symbols: int, rising: bool, most: int, carried: bool = True):
        self.text, self.queue, self.rising, self.most, self.carried = text, queue, rising, most, carried
        self.since = np.zeros(symbols, np.int64)
        self.fresh = np.ones(symbols, bool)

    def push(self, block: np.ndarray, symbol: int, of_same: bool) -> None:
        """of_same: neighbours with the block's own symbol are induced too."""
        at, lcp = block["at"], block["lcp"]
        before = self.text[np.maximum(at - 1, 0)].astype(np.int64)
        take = (before > symbol if self.rising else before < symbol) | (of_same & (before == symbol))
        took = np.flatnonzero(take & (at > 0))
        if not len(took):
            if self.carried:
                np.minimum(self.since, lcp.min(), out=self.since)
            return
        key = before[took]
        order = np.argsort(key.astype(np.uint16), kind="stable")
        took, key = took[order], key[order]
        heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        out = np.empty(len(took), TUPLE)
        out["at"], out["lcp"] = at[took] - 1, self._prefixes(lcp, took, key, heads) if self.carried else 0
        self.queue.put(key, heads, out)

    def _prefixes(self, lcp: np.ndarray, took: np.ndarray, key: np.ndarray, heads: np.ndarray) -> np.ndarray:
        whole = lcp.min()
        first = np.empty(len(took), np.int64)
        first[1:] = took[:-1] + 1
        first[heads] = 0
        least = _range_least(lcp, first, took).astype(np.int64)
        kinds = key[heads]
        least[heads] = np.minimum(least[heads], self.since[kinds])
        least += 1
        np.minimum(least, self.most, out=least)
        least[heads[self.fresh[kinds]]] = 0
        ends = np.r_[heads[1:], len(took)]
        tail = took[ends - 1] + 1
        np.minimum(self.since, whole, out=self.since)
        rest = np.full(len(kinds), self.most, np.int64)
        inner = np.flatnonzero(tail < len(lcp))
        if len(inner):
            rest[inner] = _range_least(lcp, tail[inner], np.full(len(inner), len(lcp) - 1))
        self.since[kinds] = rest
        self.fresh[kinds] = False
        return least


def _s_types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; the last symbol's is."""
    step = np.flatnonzero(text[1:] != text[:-1])
    rises = text[step + 1] > text[step]
    out = np.ones(len(text), bool)
    sizes = np.diff(step, prepend=-1)
    out[: int(sizes.sum())] = np.repeat(rises, sizes)
    return out


def _words(text: np.ndarray) -> np.ndarray:
    """text's 8 symbols from each place as a big-endian number; zeros follow the end."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    return np.ndarray((len(text),), ">u8", padded, strides=(1,))


def words_of(text: np.ndarray) -> tuple[np.ndarray, int]:
    """What to compare suffixes by, and how many symbols of each place that is."""
    return (_words(text), 8) if text.dtype == np.uint8 else (text, 1)


def _names(text: np.ndarray, stars: np.ndarray) -> tuple[np.ndarray, int]:
    """For each S*-substring, in text order, the rank of its content; and how many contents there are.

    A substring that another one continues is the larger: its last symbol is S-type, the other's is L-type there.
    """
    size = np.diff(stars, append=len(text) - 1) + 1
    word, step = words_of(text)
    group = np.zeros(len(stars), np.int64)
    todo, done = np.arange(len(stars)), 0
    while len(todo):
        at = stars[todo] + done
        value = word[np.minimum(at, len(text) - 1)].astype(np.uint64 if step == 8 else np.int64)
        over = np.minimum(np.maximum(done + step - size[todo], 0), step)
        if step == 8:
            ones = ~np.uint64(0)
            value = value | np.where(over >= 8, ones, ~(ones << (np.minimum(over, 7).astype(np.uint64) * np.uint64(8))))
        else:
            value = np.where(over > 0, np.iinfo(np.int64).max, value)
        order = np.lexsort((value, group[todo]))
        g, v = group[todo][order], value[order]
        new = np.r_[True, (g[1:] != g[:-1]) | (v[1:] != v[:-1])]
        base = np.r_[True, g[1:] != g[:-1]]
        starts = np.flatnonzero(base)
        place = np.arange(len(todo))
        of_group = np.repeat(place[starts], np.diff(starts, append=len(todo)))
        head = np.maximum.accumulate(np.where(new, place, 0))
        ranked = np.empty(len(todo), np.int64)
        ranked[order] = g + head - of_group  # a group's number is its first member's rank, so splits stay in order
        group[todo] = ranked
        done += step
        alone = np.empty(len(todo), bool)
        alone[order] = new & np.r_[new[1:], True]
        todo = todo[~alone & (size[todo] > done)]
    values, names = np.unique(group, return_inverse=True)
    return names.astype(np.int64), len(values)


def by_doubling(names: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of names in memory, by their first most / 2 names or more, and which of them tie with the
    one before: ranks of doubling length, only of those still tied."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    v = names[order]
    head = np.maximum.accumulate(np.where(np.r_[True, v[1:] != v[:-1]], np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = head
    step = 1
    tied = order[_shared(head)]
    while len(tied) and 2 * step < most:
        nxt = np.where(tied + step < n, rank[np.minimum(tied + step, n - 1)], -1)
        own = rank[tied]
        o = np.argsort(own * (n + 1) + nxt + 1)
        g, v, t = own[o], nxt[o], tied[o]
        new = np.r_[True, (g[1:] != g[:-1]) | (v[1:] != v[:-1])]
        starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        place = np.arange(len(t))
        of_group = np.repeat(place[starts], np.diff(starts, append=len(t)))
        ranks = g + np.maximum.accumulate(np.where(new, place, 0)) - of_group
        rank[t] = ranks
        tied = t[_shared(ranks)]
        step *= 2
    if len(tied):
        out = np.argsort(rank, kind="stable")
    else:
        out = np.empty(n, np.int64)
        out[rank] = np.arange(n)
    v = rank[out]
    return out, np.r_[False, v[1:] == v[:-1]]


def _shared(sorted_ranks: np.ndarray) -> np.ndarray:
    """Which of sorted values have an equal neighbour."""
    same = sorted_ranks[1:] == sorted_ranks[:-1]
    return np.r_[same, False] | np.r_[False, same]


def common(word: np.ndarray, step: int, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Common prefixes of the suffixes at a and b, up to most; word holds `step` symbols from each place."""
    out = np.zeros(len(a), np.int32)
    left, done = np.arange(len(a)), 0
    last = len(word) - 1
    while len(left) and done < most:
        x = word[np.minimum(a[left] + done, last)] ^ word[np.minimum(b[left] + done, last)]
        same = x == 0
        if step == 8:
            other = x[~same].astype(np.uint64)
            out[left[~same]] = done + 7 - (np.frexp(other.astype(np.float64))[1] - 1 + _rounded(other)) // 8
        else:
            out[left[~same]] = done
        left = left[same]
        done += step
    out[left] = most
    return np.minimum(out, most)


def _rounded(x: np.ndarray) -> np.ndarray:
    """-1 where the conversion to double rounded x up to the next power of two."""
    power = np.frexp(x.astype(np.float64))[1] - 1
    return -((power >= 64) | ((x >> np.minimum(power, 63).astype(np.uint64)) == 0)).astype(np.int64)


def boundary(text: np.ndarray, a: int, b: int, most: int) -> int:
    """Common prefix of an L-type suffix and an S-type one with the same first symbol: the shorter run of it."""

    def run_of(at: int) -> int:
        c, k = text[at], 1
        while text[at + k] == c and k < most:
            k += 1
        return k

    return min(run_of(a), run_of(b))


def _in_order(text: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The S*-suffixes, smallest first, and the common prefix of each with the one before."""
    s_type = _s_types(text)
    stars = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    names, kinds = _names(text, stars)
    if kinds == len(stars):
        tie = np.zeros(len(stars), bool)
        order = np.empty(len(stars), np.int64)
        order[names] = np.arange(len(stars))
    else:
        order, tie = by_doubling(names, most)
    found = stars[order]
    lcps = np.full(len(order), most, np.int32)
    lcps[0] = 0
    word, step = words_of(text)
    told = np.flatnonzero(~tie[1:]) + 1
    for a in range(0, len(told), SERVED):
        at = told[a : a + SERVED]
        lcps[at] = common(word, step, found[at - 1], found[at], most)
    return found, lcps


def in_memory(text: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Blocks of (at, lcp) over all suffixes but the empty one, largest first; lcp is the prefix shared with the suffix
    before in this order, counted up to most."""
    stars, lcps = _in_order(text, most)
    symbols = int(text.max()) + 1
    cuts = np.searchsorted(text[stars], np.arange(symbols + 1))
    done: dict[int, list[np.ndarray]] = defaultdict(list)
    queue = RadixQueue()
    scan = Scan(text, queue, symbols, True, most)
    for c in range(symbols):
        last = -1
        for block in queue.serve(c):
            scan.push(block, c, True)
            done[c].append(block)
            last = int(block["at"][-1])
        for a in range(int(cuts[c]), int(cuts[c + 1]), SERVED):
            z = min(a + SERVED, int(cuts[c + 1]))
            block = np.empty(z - a, TUPLE)
            block["at"], block["lcp"] = stars[a:z], lcps[a:z]
            if a == cuts[c]:
                block["lcp"][0] = boundary(text, last, int(block["at"][0]), most) if last >= 0 else 0
            scan.push(block, c, False)
    yield from falling(text, RadixQueue(), symbols, most, True, lambda c: (b[::-1] for b in reversed(done.pop(c, []))))


def falling(text: np.ndarray, queue, symbols: int, most: int, carried: bool, larger) -> Iterator[np.ndarray]:
    """The scan that induces S-type suffixes from L-type ones: blocks of both, largest first.

    larger(c): blocks of the L-type suffixes that begin with c, largest first, each with the common prefix it shares with
    the next smaller one.
    """
    scan = Scan(text, queue, symbols, False, most, carried)
    for c in range(symbols - 1, 0, -1):
        last = -1
        for block in queue.serve(c):
            scan.push(block, c, True)
            yield block
            last = int(block["at"][-1])
        passed = None
        for block in larger(c):
            # the values compare a suffix with the smaller one before it: shift them by one place
            out = block.copy()
            if carried:
                out["lcp"][1:] = block["lcp"][:-1]
                if passed is None:
                    out["lcp"][0] = boundary(text, int(block["at"][0]), last, most) if last >= 0 else 0
                else:
                    out["lcp"][0] = passed
                passed = int(block["lcp"][-1])
            scan.push(out, c, False)
            yield out
