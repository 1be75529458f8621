"""A packing plan from the counts of lengths: linear grouping, configurations of few sizes, substitution, best fit.

The plan never sees documents: equal lengths are interchangeable, so the counts of at most ``capacity`` lengths decide it.

1. Lengths above ``capacity / SMALL`` are large. They are sorted and cut into groups of equal cardinality; each is rounded
   up to the longest of its group, which leaves few sizes.
2. Column generation finds the best mix of configurations (how often each size occurs in a sequence): a linear programme
   with one row per size, whose next configuration solves a knapsack. Whole multiples of the mix are used.
3. Actual lengths take the places of the rounded ones: the longest that a place admits, in the last place of a sequence
   the longest that fits.
4. What the whole multiples leave over, and all small lengths, go longest first to the fullest sequence that has room.

Sequences that look alike are one *run*: how many there are, the lengths in them, the room left.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

GROUPS = 64  # sizes after rounding
SMALL = 5  # lengths up to capacity / SMALL are small
_ROUNDS = 2000  # configurations tried at most; the mix is feasible after any of them


@dataclass
class Run:
    """``many`` sequences of the same make-up: (length, copies) in order, and the room left in each."""

    many: int
    room: int
    parts: list[tuple[int, int]] = field(default_factory=list)

    def split(self, first: int) -> Run:
        """Cut ``first`` sequences off; they become a run of their own."""
        self.many -= first
        return Run(first, self.room, list(self.parts))

    def add(self, length: int, copies: int = 1) -> None:
        self.parts.append((length, copies))
        self.room -= length * copies


def linear_groups(counts: dict[int, int], groups: int) -> list[list[list[int]]]:
    """Lengths, longest first, in groups of equal cardinality: per group a list of [length, count]."""
    total = sum(counts.values())
    share = max(1, -(-total // groups))
    out, free = [], 0
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            if not free:
                out.append([])
                free = share
            taken = min(n, free)
            out[-1].append([length, taken])
            n, free = n - taken, free - taken
    return out


def best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of highest worth (unbounded knapsack over the capacity)."""
    good = np.flatnonzero(worth > 1e-12)
    use = np.zeros(len(sizes), np.int64)
    if not len(good):
        return 0.0, use
    good = good[np.argsort(sizes[good])]
    weights, values = sizes[good], worth[good]
    value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(weights, np.arange(capacity + 1), side="right")
    for w in range(int(weights[0]), capacity + 1):
        options = value[w - weights[:fits[w]]] + values[:fits[w]]
        k = int(options.argmax())
        if options[k] > value[w - 1]:
            value[w], choice[w] = options[k], k
        else:
            value[w] = value[w - 1]
    w = capacity
    while w > 0:
        if choice[w] < 0 or value[w] == value[w - 1]:
            w -= 1
        else:
            use[good[choice[w]]] += 1
            w -= weights[choice[w]]
    return float(value[capacity]), use


def configuration_mix(sizes: np.ndarray, needs: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations and how often to use each, rounded down, so that no size is used more than it is needed.

    Simplex steps on a basis of one configuration per size; starts with each size by itself, as often as it fits.
    """
    basis = np.diag(capacity // sizes).astype(float)
    amount = needs / np.diag(basis)
    for _ in range(_ROUNDS):
        worth = np.linalg.solve(basis.T, np.ones(len(sizes)))
        value, use = best_configuration(sizes, worth, capacity)
        if value <= 1 + 1e-7:
            break
        change = np.linalg.solve(basis, use.astype(float))
        steps = np.where(change > 1e-9, amount / np.where(change > 1e-9, change, 1), np.inf)
        out = int(steps.argmin())
        amount = np.maximum(amount - steps[out] * change, 0)
        amount[out] = steps[out]
        basis[:, out] = use
    return [(basis[:, i].round().astype(np.int64), int(amount[i] + 1e-6)) for i in range(len(sizes))]


class Stock:
    """Counts of the lengths still to be placed, with the longest that fits at hand."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {length: n for length, n in counts.items() if n}
        self.present = sum(1 << length for length in self.counts)

    def longest(self, limit: int) -> int:
        """The longest length up to ``limit``; 0 if there is none."""
        return max(0, (self.present & (1 << limit + 1) - 1).bit_length() - 1)

    def take(self, length: int, most: int) -> int:
        taken = min(self.counts[length], most)
        self.counts[length] -= taken
        if not self.counts[length]:
            del self.counts[length]
            self.present ^= 1 << length
        return taken


def substitute(stock: Stock, sizes: list[int], mix: list[tuple[np.ndarray, int]], capacity: int) -> list[Run]:
    """Runs in which actual lengths stand where the configurations have rounded sizes.

    A place of a rounded size takes the longest length up to it; the last place of a sequence takes the longest that the
    room left allows, so that what rounding gave away is used. A place for which nothing is left stays empty.
    """
    runs = []
    for use, many in mix:
        places = [sizes[g] for g in np.flatnonzero(use).tolist() for _ in range(int(use[g]))]
        waiting = [Run(many, capacity)] if many else []
        for i, size in enumerate(places):
            done = []
            for run in waiting:
                limit = run.room if i == len(places) - 1 else min(size, run.room)
                while run.many and (length := stock.longest(limit)):
                    taken = run.split(stock.take(length, run.many))
                    taken.add(length)
                    done.append(taken)
                if run.many and run.parts:
                    done.append(run)
            waiting = done
        runs += waiting
    return runs


def best_fit(runs: list[Run], counts: dict[int, int], capacity: int) -> list[Run]:
    """Put lengths, longest first, into the fullest sequence that has room; open new ones when none has."""
    by_room: dict[int, list[Run]] = {}
    rooms = 0  # bit r is set if some run has room r

    def store(run: Run) -> None:
        nonlocal rooms
        if run.many:
            by_room.setdefault(run.room, []).append(run)
            rooms |= 1 << run.room

    for run in runs:
        store(run)
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            fitting = rooms >> length
            if fitting:
                room = length + (fitting & -fitting).bit_length() - 1
                run = by_room[room].pop()
                if not by_room[room]:
                    rooms &= ~(1 << room)
            else:
                run = Run(-(-n // (capacity // length)), capacity)
            copies = min(run.room // length, n)
            full = min(run.many, n // copies)
            filled = run.split(full)
            filled.add(length, copies)
            n -= full * copies
            store(filled)
            if run.many and 0 < n < copies:
                last = run.split(1)
                last.add(length, n)
                n = 0
                store(last)
            store(run)
    return [run for same in by_room.values() for run in same]


def plan(counts: dict[int, int], capacity: int, groups: int = GROUPS) -> list[Run]:
    """Runs that hold every counted length exactly once."""
    if any(not 0 < length <= capacity for length in counts):
        raise ValueError("lengths must lie between 1 and the capacity")
    large = {length: n for length, n in counts.items() if length > capacity // SMALL and n}
    rest = {length: n for length, n in counts.items() if length <= capacity // SMALL and n}
    runs = []
    if large:
        needs = {}
        for group in linear_groups(large, groups):  # groups that round up to the same size are one size
            needs[group[0][0]] = needs.get(group[0][0], 0) + sum(n for _, n in group)
        sizes, stock = list(needs), Stock(large)
        mix = configuration_mix(np.array(sizes), np.array(list(needs.values()), float), capacity)
        runs = substitute(stock, sizes, sorted(mix, key=lambda m: tuple(m[0]), reverse=True), capacity)
        rest |= stock.counts
    return best_fit(runs, rest, capacity)
