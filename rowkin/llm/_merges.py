"""BPE merges over many fragments at once: every round applies, in each fragment, its leftmost merge of lowest rank."""

from __future__ import annotations

import heapq

import numpy as np

#: Symbols above which a fragment is merged alone with a heap, in n log n instead of n rounds.
LONG = 200
NONE = np.int64(1 << 40)


class Merges:
    """Pairs of symbol ids with their rank and the id they merge into."""

    def __init__(self, pairs: list[tuple[int, int]], merged: list[int], n_symbols: int):
        self.n = np.int64(n_symbols)
        keys = np.array([a * n_symbols + b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank, self.into = keys[order], np.arange(len(keys), dtype=np.int64)[order], np.array(merged, np.int64)[order]
        self.table = {int(k): (int(r), int(m)) for k, r, m in zip(self.keys, self.rank, self.into, strict=True)}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = left * self.n + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank[at], NONE), at

    def alone(self, symbols: list[int]) -> list[int]:
        """One long fragment, with a heap of candidate merges over a linked list."""
        n, table = int(self.n), self.table
        after, before = [*range(1, len(symbols)), -1], [-1, *range(len(symbols) - 1)]
        heap = [(*table[k], i) for i in range(len(symbols) - 1) if (k := symbols[i] * n + symbols[i + 1]) in table]
        heap = [(r, i, symbols[i], symbols[i + 1], m) for r, m, i in heap]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = after[i]
            if j < 0 or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], symbols[j] = m, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (hit := table.get(symbols[x] * n + symbols[y])):
                    heapq.heappush(heap, (hit[0], x, symbols[x], symbols[y], hit[1]))
        return [s for s in symbols if s >= 0]

    def apply(self, symbols: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge fragments (symbols one after another, one length each); returns the same form. No length may be 0."""
        total, n = int(lens.sum()), len(lens)
        symbols = symbols.astype(np.int64)
        owner = np.repeat(np.arange(n), lens)
        done_sym, done_owner, done_at = [], [], []
        for f in np.flatnonzero(lens > LONG):
            got = self.alone(symbols[owner == f].tolist())
            done_sym.append(np.array(got, np.int64))
            done_owner.append(np.full(len(got), f))
            done_at.append(np.arange(len(got)))
        active = lens[owner] <= LONG
        symbols, owner = symbols[active], owner[active]
        pair_rank = np.full(len(symbols), NONE)
        if len(symbols) > 1:
            pair_rank[:-1] = np.where(owner[1:] == owner[:-1], self.ranks(symbols[:-1], symbols[1:])[0], NONE)
        while len(symbols):
            heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            sizes = np.diff(np.append(heads, len(owner)))
            best = np.minimum.reduceat(pair_rank, heads)
            live = np.repeat(best < NONE, sizes)
            if not live.all():
                out = ~live
                done_sym.append(symbols[out])
                done_owner.append(owner[out])
                done_at.append((np.arange(len(owner)) - np.repeat(heads, sizes))[out])
                symbols, owner, pair_rank = symbols[live], owner[live], pair_rank[live]
                sizes, best = sizes[best < NONE], best[best < NONE]
                if not len(symbols):
                    break
                heads = np.cumsum(sizes) - sizes
            hits = np.flatnonzero(pair_rank == np.repeat(best, sizes))
            hits = hits[np.append(True, owner[hits][1:] != owner[hits][:-1])]  # the leftmost in each fragment
            _, at = self.ranks(symbols[hits], symbols[hits + 1])
            symbols[hits] = self.into[at]
            keep = np.ones(len(symbols), bool)
            keep[hits + 1] = False
            moved = hits - np.arange(len(hits))
            symbols, owner, pair_rank = symbols[keep], owner[keep], pair_rank[keep]
            for i in (moved, moved[moved > 0] - 1):
                j = np.minimum(i + 1, len(symbols) - 1)
                pair_rank[i] = np.where((j > i) & (owner[j] == owner[i]), self.ranks(symbols[i], symbols[j])[0], NONE)
        if not total:
            return symbols, np.zeros(n, np.int64)
        symbols, owner, at = (np.concatenate(x) for x in (done_sym, done_owner, done_at))
        order = np.lexsort((at, owner))
        return symbols[order], np.bincount(owner, minlength=n)
