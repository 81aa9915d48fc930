"""External induced suffix sorting with common-prefix values.

A text's suffixes are sorted in three steps. S*-substrings (from each S-type place after an L-type place to the next)
are sorted by induction from their first symbols and named; the string of names is sorted recursively; then two scans
induce the order of all L-type and all S-type suffixes from the sorted S*-suffixes. The scans run over a monotone
priority queue: a suffix taken from the queue puts its left neighbour's tuple (position, common prefix with the tuple put
before under the same first symbol) back under that neighbour's first symbol. Common-prefix values travel with the
tuples: a pushed tuple's is one more than the least value served since the last push of that symbol.

Beyond the memory budget all that grows with the text lies in files: the text, S* positions, names and their order as
mapped files, the queue's tuples as runs sorted by symbol, the L-type order as a tape that the second scan reads
backwards. Memory holds the queue's youngest tuples, one served block, and a few numbers a symbol. Symbols stay within
16 bits, and fewer where memory is small: names above that are written as two digits of about equal range, so the next
level's text has at most twice as many symbols as names, and is always shorter than this one's (by a third in prose). Names that fit the budget are
sorted by doubling, and so are names of which the next level would leave nine tenths of the length or more, whatever
their number: a text made for that costs memory. A text that fits the budget as a whole is sorted by suffix_memory.

The text is read at the places that tuples name, through the mapped file: the system's page cache decides what is disk.

Symbols: 0 ends the text (once), 1 separates, a byte b is b + 2; UTF-8 has no byte above 0xF7, so 8 bits hold them all.
"""

from __future__ import annotations

import math
import os
import struct
import tempfile
from collections.abc import Callable, Iterator

import numpy as np

from helixframe.llm.suffix_memory import TUPLE, Scan, boundary, by_doubling, common, falling, in_memory

END, SEPARATOR, SHIFT = 0, 1, 2
#: Common prefixes are counted up to here, unless a caller needs less.
MOST = 1 << 14
MEMORY = 192 << 20
#: What sorting in memory costs at most, in bytes: a symbol of a text, a name.
OF_SYMBOL, OF_NAME = 64, 128
WIDEST = (1 << 16) - 1
#: Blocks that wait in a queue before they are merged.
WAITING = 64


class DiskQueue:
    """A monotone priority queue of tuples: symbols are served in one direction, each first in, first out.

    Puts wait in memory. Past the budget they are merged into one run, sorted by symbol. Runs follow each other in one
    file; another one says where each symbol begins in each run.
    """

    def __init__(self, folder: str, symbols: int, rising: bool, budget: int, served: int):
        self.symbols, self.rising, self.budget, self.served = symbols, rising, budget, served
        self.data, self.index = tempfile.TemporaryFile(dir=folder), tempfile.TemporaryFile(dir=folder)  # noqa: SIM115
        self.runs = self.size = self.held = 0
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        #: the symbol being served, and how many runs and waiting blocks have given what they have of it
        self.now, self.runs_read, self.waiting_read = -1 if rising else symbols, 0, 0

    def put(self, keys: np.ndarray, heads: np.ndarray | None, tuples: np.ndarray) -> None:
        """Tuples sorted by key."""
        keys = keys.astype(np.uint16)
        self.waiting.append((keys, tuples))
        self.held += keys.nbytes + tuples.nbytes
        if self.held > self.budget or len(self.waiting) > WAITING:
            self._merge()

    def _merge(self) -> None:
        """Waiting tuples that aren't served yet as one block, in memory if it is short, else on disk."""
        parts = []
        for i, (keys, tuples) in enumerate(self.waiting):
            ahead = keys > self.now if self.rising else keys < self.now
            if i >= self.waiting_read:
                ahead |= keys == self.now
            parts.append((keys[ahead], tuples[ahead].tobytes()))
        keys = np.concatenate([k for k, _ in parts])
        self.held, self.waiting, self.waiting_read = 0, [], 0
        if not len(keys):
            return
        order = np.argsort(keys, kind="stable")
        keys, tuples = keys[order], np.frombuffer(b"".join([t for _, t in parts]), TUPLE)[order]
        if keys.nbytes + tuples.nbytes <= self.budget // 2:
            self.held, self.waiting = keys.nbytes + tuples.nbytes, [(keys, tuples)]
            return
        starts = np.full(self.symbols + 1, self.size, np.int64)
        starts[1:] += np.cumsum(np.bincount(keys, minlength=self.symbols))
        for file, values in ((self.data, tuples), (self.index, starts)):
            file.write(values.tobytes())
            file.flush()
        self.runs += 1
        self.size += len(tuples)

    def _of_run(self, run: int, symbol: int) -> bytes:
        at = (run * (self.symbols + 1) + symbol) * 8
        start, stop = struct.unpack("=qq", os.pread(self.index.fileno(), 16, at))
        return os.pread(self.data.fileno(), (stop - start) * TUPLE.itemsize, start * TUPLE.itemsize) if stop > start else b""

    def serve(self, symbol: int) -> Iterator[np.ndarray]:
        """Blocks of the symbol's tuples, those put meanwhile included, oldest first."""
        self.now, self.runs_read, self.waiting_read = symbol, 0, 0
        key = np.uint16(symbol)
        while True:
            parts, size = [], 0
            while size < self.served * TUPLE.itemsize:
                if self.runs_read < self.runs:
                    part = self._of_run(self.runs_read, symbol)
                    self.runs_read += 1
                elif self.waiting_read < len(self.waiting):
                    keys, tuples = self.waiting[self.waiting_read]
                    part = tuples[keys.searchsorted(key) : keys.searchsorted(key, "right")].tobytes()
                    self.waiting_read += 1
                else:
                    break
                parts.append(part)
                size += len(part)
            if not size:
                return
            block = np.frombuffer(b"".join(parts), TUPLE)
            for a in range(0, len(block), self.served):
                yield block[a : a + self.served]

    def close(self) -> None:
        self.waiting = []
        self.data.close()
        self.index.close()


class _Tape:
    """Tuples in rising order of their symbols, on disk, read from the end."""

    def __init__(self, path: str, symbols: int, served: int):
        self.path, self.counts, self.served = path, np.zeros(symbols, np.int64), served
        self.file = open(path, "wb")  # noqa: SIM115
        self.end = 0

    def put(self, symbol: int, block: np.ndarray) -> None:
        block.tofile(self.file)
        self.counts[symbol] += len(block)
        self.end += len(block)

    def backwards(self, symbol: int) -> Iterator[np.ndarray]:
        """The symbol's tuples from the last one; symbols are asked for in falling order."""
        self.file.flush()
        first = self.end - int(self.counts[symbol])
        while self.end > first:
            start = max(first, self.end - self.served)
            yield np.fromfile(self.path, TUPLE, self.end - start, offset=start * TUPLE.itemsize)[::-1]
            self.end = start


def _mapped(folder: str, name: str, kind: type, size: int) -> np.ndarray:
    return np.asarray(np.memmap(os.path.join(folder, name), kind, "w+", shape=(max(size, 1),)))[:size]


def _stars(text: np.ndarray, folder: str, served: int) -> np.ndarray:
    """S* places in text order, the end included: S-type ones after L-type ones. Blocks are read from the end, since a
    symbol's type is the next one's if they are equal."""
    path = os.path.join(folder, "falling")
    stop, rises, count = len(text) - 1, True, 0
    with open(path, "wb") as out:
        while stop > 0:
            start = max(0, stop - served)
            part = text[start : stop + 1]
            step = np.flatnonzero(part[1:] != part[:-1])
            s_type = np.full(len(part), rises)
            if len(step):
                s_type[: step[-1] + 1] = np.repeat(part[step + 1] > part[step], np.diff(step, prepend=-1))
            found = np.flatnonzero(s_type[1:] & ~s_type[:-1])[::-1] + start + 1
            found.astype(np.int64).tofile(out)
            count += len(found)
            stop, rises = start, bool(s_type[0])
    stars = _mapped(folder, "stars", np.int64, count)
    for a in range(0, count, served):
        part = np.fromfile(path, np.int64, served, offset=a * 8)
        stars[count - a - len(part) : count - a] = part[::-1]
    os.unlink(path)
    return stars


def _equal(word: np.ndarray, step: int, a: np.ndarray, b: np.ndarray, size: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Which of the pairs marked in `same` have the same `size` symbols from a and from b."""
    out = same.copy()
    left, done = np.flatnonzero(same), 0
    while len(left):
        x = word[a[left] + done] ^ word[b[left] + done]
        if step == 8:
            x >>= 8 * np.clip(done + 8 - size[left], 0, 7).astype(np.uint64)
        out[left[x != 0]] = False
        left = left[(x == 0) & (size[left] > done + step)]
        done += step
    return out


class _External:
    """One level: a text in a mapped file, sorted with files in a folder of its own."""

    def __init__(self, text: np.ndarray, word: np.ndarray, step: int, folder: str, memory: int, most: int, carried: bool):
        self.text, self.word, self.step, self.folder, self.memory, self.most, self.carried = text, word, step, folder, memory, most, carried
        self.served = min(max(memory >> 9, 256), 1 << 16)
        blocks = range(0, len(text), self.served)
        self.symbols = max(int(text[a : a + self.served].max()) for a in blocks) + 1
        self.stars = _stars(text, folder, self.served)

    def _queue(self, rising: bool) -> DiskQueue:
        return DiskQueue(self.folder, self.symbols, rising, self.memory >> 3, self.served)

    def _scans(self, seeds: Callable[[int, int], Iterator[np.ndarray]], carried: bool) -> Iterator[np.ndarray]:
        """Both scans from S* tuples: seeds(c, last) gives those that begin with c; last is the largest L-type suffix that
        does, or -1."""
        tape = _Tape(os.path.join(self.folder, "tape"), self.symbols, self.served)
        queue = self._queue(True)
        scan = Scan(self.text, queue, self.symbols, True, self.most, carried)
        for c in range(self.symbols):
            last = -1
            for block in queue.serve(c):
                scan.push(block, c, True)
                tape.put(c, block)
                last = int(block["at"][-1])
            for block in seeds(c, last):
                scan.push(block, c, False)
        queue.close()
        queue = self._queue(False)
        yield from falling(self.text, queue, self.symbols, self.most, carried, tape.backwards)
        queue.close()
        tape.file.close()
        os.unlink(tape.path)

    def _named(self) -> tuple[np.ndarray, np.ndarray, int]:
        """S* places by falling S*-substring, the rank of each one's content in that order (in text order), and how many
        contents there are."""
        stars, n = self.stars, len(self.stars)
        order, ranks = _mapped(self.folder, "order", np.int64, n), _mapped(self.folder, "ranks", np.int64, n)
        first = self._queue(True)
        for a in range(0, n, self.served):
            seeds = np.zeros(len(stars[a : a + self.served]), TUPLE)
            keys = self.text[stars[a : a + self.served]]
            by = np.argsort(keys, kind="stable")
            seeds["at"] = stars[a : a + self.served][by]
            first.put(keys[by], None, seeds)

        def places() -> Iterator[np.ndarray]:
            for block in self._scans(lambda c, _: first.serve(c), False):
                at = block["at"]
                own, before = self.text[at], self.text[np.maximum(at - 1, 0)]
                # a larger symbol comes before S* places, and before some L-type ones, which aren't among the S* places
                at = at[(at > 0) & (before > own)]
                index = np.searchsorted(stars, at)
                yield at[stars[np.minimum(index, n - 1)] == at]
            yield stars[-1:]

        done, rank, last, last_size = 0, -1, -1, -1
        for at in places():
            if not len(at):
                continue
            index = np.searchsorted(stars, at)
            size = np.where(index + 1 < n, stars[np.minimum(index + 1, n - 1)] - at + 1, 1)
            before, of_before = np.r_[last, at[:-1]], np.r_[last_size, size[:-1]]
            new = ~_equal(self.word, self.step, np.maximum(before, 0), at, size, size == of_before)
            number = rank + np.cumsum(new)
            ranks[index] = number
            order[done : done + len(at)] = at
            done, rank, last, last_size = done + len(at), int(number[-1]), int(at[-1]), int(size[-1])
        first.close()
        return order, ranks, rank + 1

    def _ordered(self) -> np.ndarray:
        """S* places by falling suffix."""
        order, ranks, kinds = self._named()
        n = len(order)
        if kinds == n:
            return order
        digits = 1 if kinds <= min(WIDEST, max(self.memory >> 10, 255)) else 2
        size = digits * (n - 1) + 1
        if n * OF_NAME <= self.memory or size > 0.9 * len(self.text):
            found, _ = by_doubling(kinds - 1 - ranks, self.most)
            order[:] = self.stars[found[::-1]]
            return order
        radix = math.isqrt(kinds) + 1
        names = _mapped(self.folder, "names", np.uint16, size)
        for a in range(0, n - 1, self.served):
            value = kinds - 1 - ranks[a : min(a + self.served, n - 1)]
            if digits == 1:
                names[a : a + len(value)] = value
            else:
                names[2 * a : 2 * (a + len(value)) : 2] = value // radix + 1
                names[2 * a + 1 : 2 * (a + len(value)) + 1 : 2] = value % radix + 1
        names[-1] = END
        with tempfile.TemporaryDirectory(dir=self.folder) as folder:
            done = 0
            for block in _External(names, names, 1, folder, self.memory, self.most, False).blocks():
                at = block["at"][block["at"] % digits == 0] // digits
                order[done : done + len(at)] = self.stars[at]
                done += len(at)
            order[done] = self.stars[-1]
        return order

    def blocks(self) -> Iterator[np.ndarray]:
        """Blocks of (at, lcp) over all suffixes but the empty one, largest first."""
        order = self._ordered()
        n = len(order)
        counts = np.zeros(self.symbols, np.int64)
        for a in range(0, n, self.served):
            counts += np.bincount(self.text[self.stars[a : a + self.served]], minlength=self.symbols)
        cuts = np.r_[0, np.cumsum(counts)]

        def seeds(c: int, last: int) -> Iterator[np.ndarray]:
            for a in range(int(cuts[c]), int(cuts[c + 1]), self.served):
                z = min(a + self.served, int(cuts[c + 1]))
                block = np.zeros(z - a, TUPLE)
                block["at"] = order[n - z : n - a][::-1]
                if self.carried:
                    before = np.r_[order[n - a] if a else 0, block["at"][:-1]]
                    block["lcp"] = common(self.word, self.step, before, block["at"], self.most)
                    if a == cuts[c]:
                        block["lcp"][0] = boundary(self.text, last, int(block["at"][0]), self.most) if last >= 0 else 0
                yield block

        yield from self._scans(seeds, self.carried)


def induced(text: np.ndarray, folder: str, memory: int = MEMORY, most: int = MOST) -> Iterator[np.ndarray]:
    """Blocks of (at, lcp) over all suffixes, largest first; lcp is the prefix shared with the suffix before in this order,
    counted up to most.

    text (bytes) ends with its only 0; it may be a mapped file.
    """
    n = len(text)
    if n > 1:
        if n * OF_SYMBOL <= memory:
            yield from in_memory(text, most)
        else:
            with tempfile.TemporaryDirectory(dir=folder) as own:
                held = _mapped(own, "text", np.uint8, n + 8)  # zeros follow, for the last places' words
                for a in range(0, n, 1 << 16):
                    held[a : min(a + (1 << 16), n)] = text[a : a + (1 << 16)]
                word = np.ndarray((n,), ">u8", held, strides=(1,))
                yield from _External(held[:n], word, 8, own, memory, most, True).blocks()
    yield np.array([(n - 1, 0)], TUPLE)


def repeated(text: np.ndarray, least: int, folder: str, memory: int = MEMORY) -> np.ndarray:
    """Places whose suffix shares least symbols or more with another one's; ascending."""
    mark = np.zeros(len(text), bool) if len(text) <= memory else _mapped(folder, "marks", bool, len(text))
    last = None
    for block in induced(text, folder, memory, least):
        long = np.flatnonzero(block["lcp"] >= least)
        at = block["at"]
        mark[at[long]] = True
        mark[at[long[long > 0] - 1]] = True
        if len(long) and long[0] == 0 and last is not None:
            mark[last] = True
        last = int(at[-1])
    return np.flatnonzero(mark)
