"""Exact BPE by a table of the last token of every prefix, for many strings at once.

A merge procedure that always joins the neighbours of best rank, leftmost first, has one
result for every text, and a row of tokens is that result exactly if every two
neighbouring tokens are the result for their own text. So the result for a prefix ends
in one token only: the one of all tokens that end there which is compatible with the
last token of the prefix before it. The table is filled from left to right:

1. A trie walked from every place of a string finds all tokens in it (automaton matches).
2. A token ending at a place is taken if it is compatible with the last token of the
   prefix that it follows. Whether two tokens are compatible is found by undoing their
   last merges, latest first, and asking whether any pair that faced each other over the
   border would have been merged before the next merge of either side.
3. The tokens are read backwards from the end of the string.

All strings of a call go through the steps together, as numpy arrays: one step per
length of prefix, whatever the number of strings. ``MergeTable`` holds what depends on
the vocabulary; symbols and tokens are small integers.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Pairs of tokens whose compatibility a worker remembers.
REMEMBERED = 1 << 20
#: Symbols from which a string is cut into windows, their distance and what they share.
LONG, WINDOW, OVERLAP = 4096, 1024, 256
_START = -2


class IntMap:
    """A fixed map from non-negative 64-bit integers to integers, -1 for any other key."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.values = np.full(1 << bits, -1, dtype=np.int32)
        left = np.arange(len(keys))
        at = self._slot(keys)
        while len(left):
            free = self.keys[at] == -1
            # Of several keys for one free slot, the one written last has it.
            self.keys[at[free]] = keys[left[free]]
            here = self.keys[at] == keys[left]
            self.values[at[here]] = values[left[here]]
            left, at = left[~here], (at[~here] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MULTIPLIER) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        held = self.keys[at]
        found = np.where(held == keys, self.values[at], -1)
        left = np.flatnonzero((held != keys) & (held != -1))
        while len(left):
            at = (at[left] + 1) & self.mask if len(at) != len(left) else (at + 1) & self.mask
            held = self.keys[at]
            hit = held == keys[left]
            found[left[hit]] = self.values[at[hit]]
            on = ~hit & (held != -1)
            left, at = left[on], at[on]
            if len(left):
                full = np.empty(len(keys), dtype=np.int64)
                full[left] = at
                at = full
        return found


@dataclass
class Encoded:
    """Tokens of all strings, one string after another; ``end`` is where each token ends
    among the symbols of all strings, ``first`` where each string's tokens begin."""

    tokens: np.ndarray
    end: np.ndarray
    first: np.ndarray


class MergeTable:
    """A vocabulary of merges.

    ``tokens`` are the tokens' symbols, single symbols included: every symbol below
    ``symbols`` has a token. ``rank`` gives the rank of each token's merge, lower first;
    ``joins`` the token that two tokens make, where they may be joined.
    """

    def __init__(self, symbols: int, tokens: Sequence[tuple[int, ...]], rank: Sequence[float], joins: Mapping[tuple[int, int], int]):
        self.symbols, self.count = symbols, len(tokens)
        order = {r: i for i, r in enumerate(sorted({rank[t] for t in joins.values()}))}
        single = {s[0]: t for t, s in enumerate(tokens) if len(s) == 1}
        self.rank = np.array([-1 if len(s) == 1 else order.get(rank[t], 0) for t, s in enumerate(tokens)], dtype=np.int32)
        self.length = np.array([len(s) for s in tokens], dtype=np.int64)
        self.left = np.full(self.count, -1, dtype=np.int32)
        self.right = np.full(self.count, -1, dtype=np.int32)
        reached = np.zeros(self.count, dtype=bool)
        for t, s in enumerate(tokens):
            trace = self._merged([single[x] for x in s], joins)
            if trace is None:
                continue
            ranks, (a, b) = trace
            if any(x > y for x, y in zip(ranks, ranks[1:], strict=False)):
                raise ValueError(f"token {t} is not made by merges of rising rank")
            reached[t] = True
            self.left[t], self.right[t] = a, b
        keys = np.array([a * self.count + b for a, b in joins], dtype=np.int64)
        self.joined = IntMap(keys, self.rank[list(joins.values())] if joins else np.zeros(0, dtype=np.int32))
        self._trie(tokens, reached)
        self.known = np.full(REMEMBERED, -1, dtype=np.int64)
        self.verdict = np.zeros(REMEMBERED, dtype=bool)

    def _merged(self, row: list[int], joins: Mapping[tuple[int, int], int]):
        """Ranks of the merges that make one token of a row and its last two parts; None if they make more."""
        ranks, last = [], (-1, -1)
        while len(row) > 1:
            best = min(((self.rank[joins[p]], i) for i, p in enumerate(zip(row, row[1:], strict=False)) if p in joins), default=None)
            if best is None:
                return None
            at = best[1]
            last = (row[at], row[at + 1])
            ranks.append(int(best[0]))
            row[at : at + 2] = [joins[last]]
        return ranks, last

    def _trie(self, tokens: Sequence[tuple[int, ...]], reached: np.ndarray) -> None:
        nodes: dict[tuple[int, int], int] = {}
        ends = [-1]
        for t, s in enumerate(tokens):
            if not reached[t]:
                continue
            node = 0
            for x in s:
                nxt = nodes.get((node, x))
                if nxt is None:
                    nxt = nodes[node, x] = len(ends)
                    ends.append(-1)
                node = nxt
            ends[node] = t
        self.ends = np.array(ends, dtype=np.int32)
        keys = np.array([n * self.symbols + x for n, x in nodes], dtype=np.int64)
        self.step = IntMap(keys, np.fromiter(nodes.values(), dtype=np.int32, count=len(nodes)))

    def matches(self, row: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, token) of every token inside the strings; ``stop`` is the end of each symbol's string."""
        start = np.arange(len(row))
        node = np.zeros(len(row), dtype=np.int64)
        starts, found = [], []
        depth = 0
        while len(start):
            node = self.step.get(node * self.symbols + row[start + depth]).astype(np.int64)
            alive = node >= 0
            start, node = start[alive], node[alive]
            token = self.ends[node]
            here = token >= 0
            starts.append(start[here])
            found.append(token[here])
            depth += 1
            more = start + depth < stop[start]
            start, node = start[more], node[more]
        if not starts:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
        return np.concatenate(starts), np.concatenate(found)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens is the result for its own text."""
        key = a.astype(np.int64) * self.count + b
        slot = ((key.astype(np.uint64) * _MULTIPLIER) >> np.uint64(44)).astype(np.int64)
        good = self.verdict[slot]
        new = np.flatnonzero(self.known[slot] != key)
        if len(new):
            fresh, back = np.unique(key[new], return_inverse=True)
            tested = self._tested((fresh // self.count).astype(np.int32), (fresh % self.count).astype(np.int32))
            good[new] = tested[back]
            # Key and verdict of a slot must come from the same pair.
            slots, one = np.unique(slot[new], return_index=True)
            self.known[slots], self.verdict[slots] = key[new][one], good[new][one]
        return good

    def _tested(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        good = np.ones(len(a), dtype=bool)
        at = np.arange(len(a))
        limit = np.full(len(a), np.iinfo(np.int32).max, dtype=np.int64)
        while len(at):
            made = self.joined.get(a.astype(np.int64) * self.count + b)
            bad = (made >= 0) & (made < limit)
            good[at[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            on = ~bad & ((ra >= 0) | (rb >= 0))
            at, a, b, ra, rb = at[on], a[on], b[on], ra[on], rb[on]
            # Of two merges of one rank the left one came first, so the right one is undone first.
            undo_a = ra > rb
            limit = np.where(undo_a, ra, rb + 1).astype(np.int64)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return good

    def _last(self, row: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The last token of every prefix, n + 1 of them for a string of n symbols."""
        count = len(sizes)
        end = np.cumsum(sizes)
        begin = end - sizes
        text = np.repeat(np.arange(count), sizes)
        start, token = self.matches(row, end[text])
        level = start - begin[text[start]] + self.length[token]
        order = np.argsort(level.astype(np.int32), kind="stable")
        start, token = start[order], token[order]
        source = start + text[start]
        target = source + self.length[token]
        last = np.full(len(row) + count, -1, dtype=np.int32)
        last[begin + np.arange(count)] = _START
        steps = np.concatenate(([0], np.cumsum(np.bincount(level, minlength=1))))
        for i in range(1, len(steps) - 1):
            part = slice(steps[i], steps[i + 1])
            before, after = last[source[part]], token[part]
            good = before == _START
            inner = np.flatnonzero(before >= 0)
            good[inner] = self.compatible(before[inner], after[inner])
            last[target[part][good]] = after[good]
        return last

    def _last_of_long(self, row: np.ndarray) -> np.ndarray:
        """The same for one long string, by windows that are filled side by side.

        An entry follows from the entries of as many places before it as the longest token
        has symbols. So where that many entries of a window agree with the window before
        it, so do all that follow. A string without such places goes through in one piece.
        """
        n, need = len(row), int(self.length.max())
        starts = np.arange(0, n, WINDOW)
        ends = np.minimum(starts + WINDOW + OVERLAP, n)
        windows = self._last(np.concatenate([row[a:b] for a, b in zip(starts, ends, strict=True)]), ends - starts)
        last = np.empty(n + 1, dtype=np.int32)
        offset = 0
        for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            own = windows[offset : offset + b - a + 1]
            offset += b - a + 1
            if k == 0:
                last[: b + 1] = own
                continue
            both = min(OVERLAP, b - a)
            agreed = np.concatenate(([0], np.cumsum(last[a + 1 : a + both + 1] == own[1 : both + 1])))
            runs = np.flatnonzero(agreed[need:] - agreed[:-need] == need) if both >= need else []
            if len(runs):
                at = int(runs[0]) + need
                last[a + at + 1 : b + 1] = own[at + 1 :]
            elif b > a + both:
                return self._last(row, np.array([n]))
        return last

    def encode(self, row: np.ndarray, sizes: np.ndarray) -> Encoded:
        """Tokens of the strings that ``row`` holds one after another, ``sizes`` symbols each."""
        count = len(sizes)
        end = np.cumsum(sizes)
        begin = end - sizes
        long = sizes > LONG
        if not long.any():
            return self._backwards(self._last(row, sizes), begin, end, count)
        last = np.empty(len(row) + count, dtype=np.int32)
        last[np.repeat(~long, sizes + 1)] = self._last(row[np.repeat(~long, sizes)], sizes[~long])
        for i in np.flatnonzero(long).tolist():
            last[begin[i] + i : end[i] + i + 1] = self._last_of_long(row[begin[i] : end[i]])
        return self._backwards(last, begin, end, count)

    def _backwards(self, last: np.ndarray, begin: np.ndarray, end: np.ndarray, count: int) -> Encoded:
        text = np.flatnonzero(end > begin)
        at = end[text] + text
        low = begin[text] + text
        texts, places, tokens = [], [], []
        while len(text):
            token = last[at]
            texts.append(text)
            places.append(at - text)
            tokens.append(token)
            at = at - self.length[token]
            on = at > low
            text, at, low = text[on], at[on], low[on]
        if not texts:
            return Encoded(np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64), np.zeros(count + 1, dtype=np.int64))
        text, place, token = np.concatenate(texts), np.concatenate(places), np.concatenate(tokens)
        order = np.argsort(place, kind="stable")
        first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=count))))
        return Encoded(token[order], place[order], first)


class Kept:
    """What strings met before were turned into, in two generations of at most ``limit``
    strings: when the younger is full the older is forgotten, so strings that come again
    and again stay. ``make`` turns a list of strings into as many results, never None."""

    def __init__(self, make, limit: int, longest: int):
        self.make, self.limit, self.longest = make, limit, longest
        self.young: dict = {}
        self.old: dict = {}

    def all(self, strings: list[str]) -> list:
        """The results for ``strings``; what is not known is made once."""
        found = list(map(self.young.get, strings))
        holes = [i for i, x in enumerate(found) if x is None]
        if not holes:
            return found
        fresh = dict.fromkeys([strings[i] for i in holes])
        new = []
        for s in fresh:
            x = self.old.get(s)
            if x is None:
                new.append(s)
            else:
                fresh[s] = x
        fresh.update(zip(new, self.make(new), strict=True))
        for i in holes:
            found[i] = fresh[strings[i]]
        if len(self.young) + len(fresh) > self.limit:
            self.old, self.young = self.young, {}
        self.young.update((s, x) for s, x in fresh.items() if len(s) <= self.longest)
        return found
