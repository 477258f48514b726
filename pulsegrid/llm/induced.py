"""Suffix order and common prefixes of a shard by induced sorting.

The last characters of falling runs (S*-suffixes) are sorted first: their substrings by an induction of
their own, then tuples of names, each level covering twice as many substrings, until all differ or the
depth asked for is covered. All other suffixes follow by induction: a suffix's place is known once the
suffix one character later has its place. Suffixes wait in priority queues keyed by (first character,
order of arrival); as arrivals come in order, a queue per character is enough. A queue keeps tuples of
position and common prefix with the tuple before, and moves them to disk beyond its share of memory,
as the tuple sorter does with its runs; a large text is a mapped file. Types, names, seeds and the order
itself are in memory, tens of bytes for each byte of the shard, so the caller bounds its shards.

Common prefixes are carried along: of two suffixes that follow each other in a queue it is one more
than the least common prefix met between their successors. They are kept up to ``depth`` only.
"""

from __future__ import annotations

import heapq
import tempfile

import numpy as np

#: Bytes of queues, of a sorter's run, and of text that stay in memory.
MEMORY = 192 << 20


class Disk:
    """A temporary file of the task, gone when closed."""

    def __init__(self):
        self.file = tempfile.TemporaryFile()
        self.end = 0

    def put(self, data: np.ndarray) -> tuple[int, int, np.dtype]:
        at = self.end
        self.file.seek(at)
        self.file.write(data.tobytes())
        self.end += data.nbytes
        return at, len(data), data.dtype

    def get(self, place: tuple[int, int, np.dtype], first: int = 0, n: int | None = None) -> np.ndarray:
        at, length, dtype = place
        n = length - first if n is None else min(n, length - first)
        self.file.seek(at + first * dtype.itemsize)
        return np.frombuffer(self.file.read(n * dtype.itemsize), dtype)

    def close(self) -> None:
        self.file.close()


class BucketQueues:
    """One first-in-first-out queue of (position, common prefix) per character; the fullest go to disk."""

    def __init__(self, n: int, memory: int):
        self.held = [[] for _ in range(n)]
        self.spilled = [[] for _ in range(n)]
        self.size, self.memory, self.disk = 0, memory, None

    def put(self, key: int, positions: np.ndarray, prefixes: np.ndarray) -> None:
        self.held[key].append((positions, prefixes))
        self.size += positions.nbytes + prefixes.nbytes
        if self.size > self.memory:
            self.disk = self.disk or Disk()
            for k, parts in enumerate(self.held):
                self.spilled[k] += [(self.disk.put(p), self.disk.put(q)) for p, q in parts]
                self.held[k] = []
            self.size = 0

    def take(self, key: int) -> tuple[np.ndarray, np.ndarray]:
        parts = [(self.disk.get(p), self.disk.get(q)) for p, q in self.spilled[key]] + self.held[key]
        self.size -= sum(p.nbytes + q.nbytes for p, q in self.held[key])
        self.held[key], self.spilled[key] = [], []
        if not parts:
            return np.empty(0, np.int64), np.empty(0, np.uint8)
        return np.concatenate([p for p, _ in parts]), np.concatenate([q for _, q in parts])

    def close(self) -> None:
        if self.disk:
            self.disk.close()


class TupleSorter:
    """Sorts (key, position) tuples: sorted runs on disk, merged through a priority queue of their heads."""

    BLOCK = 1 << 16

    def __init__(self, memory: int):
        self.memory, self.held, self.size, self.runs, self.disk = memory, [], 0, [], None

    def add(self, keys: np.ndarray, positions: np.ndarray) -> None:
        self.held.append((keys, positions))
        self.size += keys.nbytes + positions.nbytes
        if self.size > self.memory:
            self.disk = self.disk or Disk()
            k, p = self._run()
            self.runs.append((self.disk.put(k), self.disk.put(p)))

    def _run(self):
        keys, positions = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.size = [], 0
        bits = int(positions.max(initial=0)).bit_length()
        if positions.min(initial=0) >= 0 <= keys.min(initial=0) and int(keys.max(initial=0)).bit_length() + bits <= 63:
            # both in one number: sorting numbers is far cheaper than sorting their order
            both = np.sort(keys << bits | positions)
            return both >> bits, both & ((1 << bits) - 1)
        order = np.argsort(keys, kind="stable")
        return keys[order], positions[order]

    def sorted(self):
        """Blocks of (keys, positions) in order."""
        if not self.runs:
            if self.held:
                yield self._run()
            return
        if self.held:
            k, p = self._run()
            self.runs.append((self.disk.put(k), self.disk.put(p)))
        heads, queue, at = {}, [], [0] * len(self.runs)

        def load(r):
            k, p = self.runs[r]
            keys = self.disk.get(k, at[r], self.BLOCK)
            if len(keys):
                heads[r] = (keys, self.disk.get(p, at[r], self.BLOCK))
                at[r] += len(keys)
                heapq.heappush(queue, (int(keys[-1]), r))

        for r in range(len(self.runs)):
            load(r)
        while queue:  # everything up to the least last key of the heads is complete
            last, r = heapq.heappop(queue)
            out = []
            for s, (keys, positions) in list(heads.items()):
                n = int(np.searchsorted(keys, last, side="right"))
                out.append((keys[:n], positions[:n]))
                heads[s] = (keys[n:], positions[n:])
            del heads[r]
            load(r)
            keys, positions = (np.concatenate(x) for x in zip(*out))
            order = np.argsort(keys, kind="stable")
            yield keys[order], positions[order]
        self.disk.close()


class RangeMinimum:
    """Least of any range of an array, from minima over powers of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]

    def _level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            last, width = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-width], last[width:]))
        return self.levels[k]

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Over ``first`` to ``last``, both included."""
        size = last - first + 1
        out = np.minimum(self.levels[0][first], self.levels[0][last])
        open_, k = np.flatnonzero(size > 2), 1
        while len(open_):
            # the ranges of 2 ** k to 2 ** (k + 1) values are settled, the longer ones stay open
            level = self._level(k)
            a, b = first[open_], last[open_] - (1 << k) + 1
            out[open_] = np.minimum(level[a], level[b])
            k += 1
            open_ = open_[size[open_] > 1 << k]
        return out


def falling(text: np.ndarray) -> np.ndarray:
    """True for L-suffixes: larger than the suffix one character later. The last one is not."""
    n = len(text)
    out = np.zeros(n, bool)
    step = np.sign(text[:-1].astype(np.int32) - text[1:].astype(np.int32))
    place = np.where(step != 0, np.arange(n - 1), n)
    place = np.minimum.accumulate(place[::-1])[::-1]
    known = place < n
    out[:-1][known] = step[place[known]] > 0
    return out


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefixes of suffixes ``a`` and ``b``, up to ``depth``; ``text`` is padded by ``depth``."""
    out, open_ = np.full(len(a), depth, np.uint8), np.arange(len(a))
    k, four = 0, fours(text)
    while len(open_) > FEW and k + 4 <= depth:
        differ = four[a] ^ four[b] if not k else four[a + k] ^ four[b + k]
        ended = differ != 0
        d = differ[ended]
        out[open_[ended]] = k + same_of_four(d)
        a, b, open_ = a[~ended], b[~ended], open_[~ended]
        k += 4
    for k in range(k, depth):
        if not len(open_):
            break
        differs = text[a + k] != text[b + k]
        out[open_[differs]] = k
        a, b, open_ = a[~differs], b[~differs], open_[~differs]
    return out


#: Pairs from which on characters are compared four at once.
FEW = 64


def fours(text: np.ndarray) -> np.ndarray:
    """The four characters at every place as one number; a view of the 16-bit ``text``."""
    return np.ndarray((max(len(text) - 3, 0),), np.uint64, text, 0, (2,))


def same_of_four(differ: np.ndarray) -> np.ndarray:
    """Equal leading characters, from the exclusive or of two different ``fours``."""
    out = np.zeros(len(differ), np.uint8)
    for bits in (16, 32, 48):
        out += differ & np.uint64((1 << bits) - 1) == 0
    return out


def induce(text, large, seeds, prefixes, sigma: int, depth: int, memory: int):
    """All suffixes in order with the common prefix to the one before, from the sorted S*-suffixes.

    Two passes over the characters. Rising: each L-suffix is put in its queue by the suffix after it.
    Falling: each S-suffix likewise, from the far end. ``prefixes`` None leaves common prefixes out.
    """
    carry = prefixes is not None
    first = text[seeds]
    starts = np.searchsorted(first, np.arange(sigma + 1))

    def bound(a, b):
        return common_prefix(text, np.array([a]), np.array([b]), depth)[0] if carry else np.uint8(0)

    def one_pass(characters, wanted, own_seeds):
        queues, since = BucketQueues(sigma, memory), np.zeros(sigma, np.uint8)
        done = {}

        def feed(c, positions, lcp, last):
            """Queues the predecessors of ``positions``; those with the same character come back as the next wave."""
            since_c = lcp.min() if carry else 0
            before = positions - 1
            ok = before >= 0
            ok[ok] = wanted(before[ok])
            index = np.flatnonzero(ok)
            if len(index):
                before = before[index]
                char = text[before]
                order = np.argsort(char, kind="stable")
                index, before, char = index[order], before[order], char[order]
                cuts = np.flatnonzero(np.diff(char, prepend=char[0] + 1 if len(char) else 0))
                if carry:
                    minima = RangeMinimum(lcp)
                    from_ = np.empty(len(index), np.int64)
                    from_[1:] = index[:-1] + 1
                    from_[cuts] = 0
                    value = minima.least(from_, index)
                    heads = char[cuts]
                    value[cuts] = np.minimum(value[cuts], since[heads])
                    value = np.minimum(value.astype(np.int64) + 1, depth).astype(np.uint8)
                    fresh = ~seen[heads]
                    value[cuts[fresh]] = 0
                    ends = np.append(cuts[1:], len(char)) - 1
                    tails = index[ends]
                    np.minimum(since, since_c, out=since)
                    more = tails < len(lcp) - 1
                    after = np.full(len(tails), 255, np.uint8)
                    if more.any():
                        after[more] = minima.least(tails[more] + 1, np.full(int(more.sum()), len(lcp) - 1))
                    since[heads] = after
                    seen[heads] = True
                else:
                    value = np.zeros(len(index), np.uint8)
                    heads = char[cuts]
                wave = None
                for k, d in enumerate(heads):
                    a, b = cuts[k], cuts[k + 1] if k + 1 < len(cuts) else len(char)
                    if d == c:
                        wave = (before[a:b], value[a:b])
                    else:
                        queues.put(int(d), before[a:b], value[a:b])
                return wave
            if carry:
                np.minimum(since, since_c, out=since)
            return None

        seen = np.zeros(sigma, bool)
        for c in characters:
            positions, lcp = queues.take(c)
            out_p, out_l, last = [], [], None
            if carry:
                since[:] = 0
            while len(positions):
                if carry:
                    lcp = lcp.copy()
                    lcp[0] = bound(last, positions[0]) if last is not None else 0
                out_p.append(positions)
                out_l.append(lcp)
                last = positions[-1]
                positions, lcp = feed(c, positions, lcp, last) or (np.empty(0, np.int64), None)
            more, more_l = own_seeds(c)
            if len(more):
                if carry:
                    more_l = more_l.copy()
                    more_l[0] = bound(last, more[0]) if last is not None else 0
                feed(c, more, more_l if carry else np.zeros(len(more), np.uint8), last)
            done[c] = (np.concatenate(out_p) if out_p else np.empty(0, np.int64), np.concatenate(out_l) if out_l else np.empty(0, np.uint8))
        queues.close()
        return done

    def stars(c):
        a, b = starts[c], starts[c + 1]
        return seeds[a:b], (prefixes[a:b] if carry else None)

    falling_part = one_pass(range(sigma), lambda p: large[p], stars)

    def reversed_large(c):
        p, lcp = falling_part[c]
        # from the far end the common prefix belongs to the other neighbour
        return p[::-1], np.concatenate([lcp[:0], np.append(lcp[1:], 0)[::-1]]).astype(np.uint8)

    rising_part = one_pass(range(sigma - 1, -1, -1), lambda p: ~large[p], reversed_large)
    for c in range(sigma):
        l_p, l_l = falling_part[c]
        s_p, s_l = rising_part[c]
        s_p, s_l = s_p[::-1], np.append(s_l[1:], 0)[::-1].astype(np.uint8)
        if len(s_p) and carry:
            s_l = s_l.copy()
            s_l[0] = bound(l_p[-1], s_p[0]) if len(l_p) else 0
        if len(l_p):
            yield l_p, l_l
        if len(s_p):
            yield s_p, s_l


def star_names(text, large, stars, sigma: int, memory: int) -> np.ndarray:
    """Order-preserving names of the S*-substrings, in text order, by induction from unsorted stars."""
    by_char = stars[np.argsort(text[stars], kind="stable")]
    is_star = np.zeros(len(large), bool)
    is_star[stars] = True
    # the end of the text follows nothing, so no induction reaches it; it comes first
    in_order = np.concatenate([stars[-1:], *(p[is_star[p]] for p, _ in induce(text, large, by_char, None, sigma, 0, memory))])
    length = np.diff(stars, append=len(large) - 1) + 1
    number = np.empty(len(large), np.int32 if len(stars) < 1 << 31 else np.int64)
    number[stars] = np.arange(len(stars))
    where = number[in_order]
    size = length[where]
    # equal substrings: same length and, compared four characters at a time, same text
    same = size[1:] == size[:-1]
    open_ = np.flatnonzero(same)
    a, b = in_order[:-1][open_], in_order[1:][open_]
    left, four = size[1:][open_], fours(text)
    while len(open_):
        far = np.maximum(4 - left, 0) << 4  # bits of characters behind the substring
        differs = (four[a] ^ four[b]) << far.astype(np.uint64) != 0
        same[open_[differs]] = False
        more = ~differs & (left > 4)
        a, b, left, open_ = a[more] + 4, b[more] + 4, left[more] - 4, open_[more]
    names = np.empty(len(stars), np.int64)
    names[where] = np.concatenate([[0], np.cumsum(~same)])
    return names


def sorted_stars(text, large, stars, sigma: int, depth: int, memory: int) -> np.ndarray:
    """S*-suffixes in order up to ``depth`` characters: names, then names of pairs of names, level by level.

    Two S*-suffixes are never neighbours, so ``covered`` names cover twice as many characters.
    """
    names = star_names(text, large, stars, sigma, memory)
    covered = 1
    while names.max(initial=0) + 1 < len(names) and 2 * covered < depth:
        after = np.zeros(len(names), np.int64)
        after[:-covered] = names[covered:] + 1
        sorter = TupleSorter(memory)
        width = int(names.max()) + 2
        for at in range(0, len(names), 1 << 22):
            part = slice(at, at + (1 << 22))
            sorter.add(names[part] * width + after[part], np.arange(len(names))[part])
        new, name, last = np.empty(len(names), np.int64), -1, None
        for keys, positions in sorter.sorted():
            step = np.concatenate([[last is None or keys[0] != last], keys[1:] != keys[:-1]])
            own = name + np.cumsum(step)
            new[positions] = own
            name, last = int(own[-1]), keys[-1]
        names, covered = new, 2 * covered
    return stars[np.argsort(names, kind="stable")]


def suffixes(text: np.ndarray, sigma: int, depth: int, memory: int = MEMORY):
    """Blocks of (positions, common prefix with the suffix before) of all suffixes of ``text`` in order.

    ``text`` holds characters below ``sigma``; order and common prefixes are right up to ``depth``.
    """
    n = len(text)
    if not n:
        return
    padded = np.zeros(n + max(depth, 3) + 1, np.uint16)
    if padded.nbytes > memory:
        padded = np.memmap(tempfile.TemporaryFile(), np.uint16, shape=padded.shape)
    padded[:n] = text + 1  # 0 ends the text, below all characters
    large = falling(padded[: n + 1])
    stars = np.flatnonzero(~large[1:] & large[:-1]) + 1
    ordered = sorted_stars(padded, large, stars, sigma + 1, depth, memory)
    prefixes = np.zeros(len(ordered), np.uint8)
    prefixes[1:] = common_prefix(padded, ordered[:-1], ordered[1:], depth)
    for positions, lcp in induce(padded, large, ordered, prefixes, sigma + 1, depth, memory):
        keep = positions < n
        yield positions[keep], lcp[keep]
