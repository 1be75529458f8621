"""Hierarchical Pitman-Yor restaurants: seating by Gibbs, and predictive probabilities.

A restaurant per word serves the words that follow it (the end of a text, the empty word, also stands before its first word).
The parent of all of them is the word restaurant, whose parent spells words byte by byte. Spelling is itself a hierarchy: the restaurant of the two bytes before, whose parent is that of the one byte before, whose parent is
that of no context, whose parent is uniform over 257 symbols. Contexts with the same last byte share a parent, and every
table of a restaurant is one customer of its parent.

A Gibbs sweep takes all customers of one dish out and seats them anew, given the rest of the restaurant and its parent as
they were after the sweep before. Dishes are then independent of each other, so whole arrays of dishes are seated at once
and tasks need no common state.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

END = 256  # symbol after the last byte of a word, and in front of the first
SYMBOLS = 257
ONE_BY_ONE = 16  # customers of a dish that are seated singly; later ones in groups of a sixteenth of those seated


@dataclass
class Strength:
    """Discount and concentration of a restaurant level."""

    discount: float
    concentration: float = 1.0


def discount_from(once: float, twice: float) -> float:
    """The usual estimate from how many dishes have one and two customers, kept away from 0 and 1."""
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


def seat(customers: np.ndarray, pull: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish after its customers are seated one after another.

    ``pull`` is the weight of a new table for the dish: (concentration + discount x tables of the restaurant) times the
    parent's probability. With k customers at t tables the next one opens a table with odds pull : k - discount x t. Beyond
    ``ONE_BY_ONE`` customers a group of a sixteenth of those seated shares one probability.
    """
    tables = np.minimum(customers, 1).astype(np.int64)
    active, seated = np.flatnonzero(customers > 1), 1
    while len(active):
        group = np.minimum(max(1, seated // ONE_BY_ONE), customers[active] - seated)
        old = seated + (group - 1) / 2 - discount * tables[active]
        tables[active] += rng.binomial(group, pull[active] / (old + pull[active]))
        seated += max(1, seated // ONE_BY_ONE)
        active = active[customers[active] > seated]
    return tables


def symbols_of(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (two bytes before, symbol) of all symbols of the words, and where each word begins.

    ``data`` has the words' bytes in a row; each word ends with the end symbol, which also stands before it.
    """
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64)
    symbols = np.full(int((lengths + 1).sum()), END, np.int64)
    if len(data):
        symbols[np.arange(len(data)) + np.repeat(np.arange(len(lengths)), lengths)] = data
    before = np.concatenate([[END], symbols[:-1]])
    before[starts] = END
    earlier = np.concatenate([[END], before[:-1]])
    earlier[starts] = END
    return (earlier * SYMBOLS + before) * SYMBOLS + symbols, starts


@dataclass
class Spelling:
    """Predictive probabilities of the spelling restaurants; sizes are bounded by the number of contexts.

    ``keys`` (sorted) and ``own`` are the seen (context, symbol) pairs and what they have beyond the parent's share;
    ``shares`` is the parent's share per context of two bytes, ``one`` the probabilities after one byte.
    """

    keys: np.ndarray
    own: np.ndarray
    shares: np.ndarray
    one: np.ndarray

    def log(self, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Natural log probability of each word."""
        keys, starts = symbols_of(data, lengths)
        p = self.shares[keys // SYMBOLS] * self.one[keys // SYMBOLS % SYMBOLS, keys % SYMBOLS]
        if len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            p = p + np.where(self.keys[place] == keys, self.own[place], 0.0)
        return np.add.reduceat(np.log(p), starts) if len(starts) else np.zeros(0)


def _parts(counts: np.ndarray, tables: np.ndarray, groups: np.ndarray, n: int, s: Strength) -> tuple[np.ndarray, np.ndarray]:
    """Per dish what its restaurant gives beyond the parent, per restaurant the parent's share."""
    total = np.bincount(groups, counts, n) + s.concentration
    return ((counts - s.discount * tables) / total[groups],
            (s.concentration + s.discount * np.bincount(groups, tables, n)) / total)


def spelling(keys: np.ndarray, counts: np.ndarray, rng: np.random.Generator, sweeps: int = 3) -> Spelling:
    """Seat the customers of all spelling restaurants by a few sweeps, from the longest context upward.

    ``keys`` are different and sorted, ``counts`` how many customers they have.
    """
    counts = counts.astype(np.int64)
    pairs, to_pair = np.unique(keys % (SYMBOLS * SYMBOLS), return_inverse=True)
    contexts, ones = keys // SYMBOLS, pairs // SYMBOLS
    two_s, one_s, none_s = (Strength(0.5) for _ in range(3))
    tables = np.minimum(counts, 1)
    one = np.full((SYMBOLS, SYMBOLS), 1 / SYMBOLS)
    none = np.full(SYMBOLS, 1 / SYMBOLS)
    for sweep in range(sweeps):
        two_s = Strength(discount_from((counts == 1).sum(), (counts == 2).sum()))
        if sweep:
            per = np.bincount(contexts, tables, SYMBOLS**2)[contexts]
            pull = (two_s.concentration + two_s.discount * per) * one[contexts % SYMBOLS, keys % SYMBOLS]
            tables = seat(counts, pull, two_s.discount, rng)
        pair_counts = np.bincount(to_pair, tables, len(pairs)).astype(np.int64)
        one_s = Strength(discount_from((pair_counts == 1).sum(), (pair_counts == 2).sum()))
        pair_tables = np.minimum(pair_counts, 1)
        if sweep:
            per = np.bincount(ones, pair_tables, SYMBOLS)[ones]
            pair_tables = seat(pair_counts, (one_s.concentration + one_s.discount * per) * none[pairs % SYMBOLS],
                               one_s.discount, rng)
        single = np.bincount(pairs % SYMBOLS, pair_tables, SYMBOLS).astype(np.int64)
        single_tables = seat(single, np.full(SYMBOLS, (none_s.concentration + none_s.discount * (single > 0).sum()) / SYMBOLS),
                             none_s.discount, rng)
        own, share = _parts(single, single_tables, np.zeros(SYMBOLS, np.int64), 1, none_s)
        none = own + share[0] / SYMBOLS
        own, share = _parts(pair_counts, pair_tables, ones, SYMBOLS, one_s)
        one = share[:, None] * none[None, :]
        one[ones, pairs % SYMBOLS] += own
    own, share = _parts(counts, tables, contexts, SYMBOLS**2, two_s)
    return Spelling(keys, own, share, one)


@dataclass
class State:
    """What a sweep over words needs: spelling, tables of the word restaurant, its strength, customers in all.

    ``unseen`` is what the spelling parent gives to all words together that have no customer, ``total`` what all words get
    when their customers have been seated anew since ``tables`` were counted.
    """

    spelling: Spelling
    tables: int
    strength: Strength
    customers: int
    unseen: float = 1.0
    total: float = 1.0

    def parent(self, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The spelling parent's probability of each word."""
        return np.exp(self.spelling.log(data, lengths))

    @property
    def share(self) -> float:
        """Weight of the parent beside the customers."""
        return self.strength.concentration + self.strength.discount * self.tables

    def seat(self, parent: np.ndarray, counts: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        return seat(counts, self.share * parent, self.strength.discount, rng)

    def predict(self, parent: np.ndarray, counts: np.ndarray, rng: np.random.Generator | None,
                seated: np.ndarray | None = None) -> np.ndarray:
        """Probability of each word given a seating of its customers; words without any get that of all such words."""
        seated = self.seat(parent, counts, rng) if seated is None else seated
        weight = counts - self.strength.discount * seated + self.share * parent
        return np.where(counts > 0, weight, self.share * self.unseen) / (self.customers + self.strength.concentration)
