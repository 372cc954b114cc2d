"""Weighted acyclic automata over sequences of up to a few whole numbers, as flat arrays.

A sequence is a path from the root; the weight of its last arc is the sequence's own. States with equal arcs, weights and
targets are one state, so equal continuations are stored once. Sequences come as rows of a matrix, ended by -1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from veil.llm import words as W


@dataclass
class Level:
    """Arcs that leave the states of one depth: those of state s are ``first[s]`` to ``first[s + 1]``, by label."""

    first: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    target: np.ndarray


def sort_rows(rows: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order, each once, with their summed weights."""
    if not len(rows):
        return rows, weights
    order = np.lexsort(rows.T[::-1])
    rows, weights = rows[order], weights[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    at = np.flatnonzero(new)
    return rows[at], np.add.reduceat(weights, at)


def _merged(first: np.ndarray, label: np.ndarray, weight: np.ndarray, target: np.ndarray) -> tuple[Level, np.ndarray]:
    """The level with equal states made one, and the new number of each old state; state 0 has no arcs."""
    code = W.mix(label.view(np.uint64) ^ W.mix(weight.view(np.uint64) + W.mix(target.astype(np.uint64))))
    state = W.total_hash(code, first)
    _, chosen, number = np.unique(state, return_index=True, return_inverse=True)
    n = np.diff(first)
    arc = np.arange(len(label)) - np.repeat(first[:-1], n)
    twin = np.repeat(first[chosen[number]], n) + arc
    # states of one hash must be the same in full
    if (n != n[chosen[number]]).any() or any((x != x[twin]).any() for x in (label, weight, target)):
        chosen, number = np.arange(len(n)), np.arange(len(n))
    arcs = np.repeat(first[chosen], n[chosen]) + np.arange(n[chosen].sum()) - np.repeat(np.cumsum(n[chosen]) - n[chosen], n[chosen])
    kept = Level(np.concatenate([np.zeros(1, np.int64), np.cumsum(n[chosen])]), label[arcs], weight[arcs], target[arcs])
    return kept, number


class Automaton:
    def __init__(self, levels: list[Level]):
        self.levels = levels

    @classmethod
    def build(cls, rows: np.ndarray, weights: np.ndarray, total: bool = True) -> Automaton:
        """From sorted rows, each once. With ``total`` the weight of a path is that of all rows that begin with it, otherwise
        that of the row that is the path, or 0."""
        depth = rows.shape[1]
        new = np.zeros(len(rows), bool)
        new[:1] = True
        nodes, starts = [], []
        for d in range(depth):
            new = new.copy()
            new[1:] |= rows[1:, d] != rows[:-1, d]
            here = new & (rows[:, d] >= 0)
            starts.append(np.flatnonzero(here))
            nodes.append(np.cumsum(here) - 1)  # of rows that go on so far; others are left out below
        levels: list[Level] = []
        number = None
        for d in range(depth - 1, -1, -1):
            inside = rows[:, d] >= 0
            last = inside if total or d + 1 == depth else inside & (rows[:, d + 1] < 0)
            weight = np.zeros(len(starts[d]), np.int64)
            np.add.at(weight, nodes[d][last], weights[last])
            target = np.zeros(len(starts[d]), np.int64) if number is None else number
            parents = len(starts[d - 1]) if d else 1
            parent = nodes[d - 1][starts[d]] if d else np.zeros(len(starts[d]), np.int64)
            level, number = _merged(np.searchsorted(parent, np.arange(parents + 1)), rows[starts[d], d], weight, target)
            levels.append(level)
        return cls(levels[::-1])

    def paths(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length from 1 on: all sequences of it, in order, and their weights."""
        state, path = np.zeros(1, np.int64), np.zeros((1, 0), np.int64)
        for level in self.levels:
            n = np.diff(level.first)[state]
            arc = np.repeat(level.first[state] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            path = np.concatenate([np.repeat(path, n, axis=0), level.label[arc][:, None]], axis=1)
            yield path, level.weight[arc]
            state = level.target[arc]

    def weights_of(self, rows: np.ndarray) -> np.ndarray:
        """The weight of each row's path, 0 for one that isn't there."""
        state, found = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        on = np.ones(len(rows), bool)
        for level, label in zip(self.levels, rows.T):
            on &= label >= 0
            if not len(level.label):
                found[on] = 0
                break
            names = np.unique(level.label)
            name = np.minimum(np.searchsorted(names, label), len(names) - 1)
            arcs = np.repeat(np.arange(len(level.first) - 1), np.diff(level.first)) * len(names) + np.searchsorted(names, level.label)
            at = np.minimum(np.searchsorted(arcs, state * len(names) + name), len(arcs) - 1)
            there = (arcs[at] == state * len(names) + name) & (names[name] == label)
            found[on] = np.where(there, level.weight[at], 0)[on]
            on &= there
            state = level.target[at]
        return found

    def dump(self) -> bytes:
        parts = [x for level in self.levels for x in (np.diff(level.first), level.label, level.weight, level.target)]
        return np.array([len(self.levels), *map(len, parts)], np.int64).tobytes() + np.concatenate(parts).astype(np.int64).tobytes()

    @classmethod
    def load(cls, blob: bytes) -> Automaton:
        flat = np.frombuffer(blob, np.int64)
        n = int(flat[0])
        borders = 1 + 4 * n + np.concatenate([[0], np.cumsum(flat[1 : 1 + 4 * n])])
        part = [flat[a:b] for a, b in zip(borders[:-1], borders[1:])]
        return cls([Level(np.concatenate([np.zeros(1, np.int64), np.cumsum(part[4 * i])]), *part[4 * i + 1 : 4 * i + 4]) for i in range(n)])


class Union:
    """Sums the weights of paths over many automata."""

    def __init__(self, depth: int, most: int = 1 << 20):
        self.most = most
        self.held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(depth)]
        self.rows = [0] * depth

    def add(self, automaton: Automaton) -> None:
        for d, (rows, weights) in enumerate(automaton.paths()):
            self.held[d].append((rows, weights))
            self.rows[d] += len(rows)
            if self.rows[d] > self.most and len(self.held[d]) > 1:
                self.held[d] = [self.sums(d)]
                # as much again, so that each row is sorted a few times only
                self.rows[d] = min(len(self.held[d][0][0]), self.most // 2)

    def sums(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        """All sequences of d + 1 numbers with their weights."""
        return sort_rows(*(np.concatenate(x) for x in zip(*self.held[d]))) if self.held[d] else (np.zeros((0, d + 1), np.int64), np.zeros(0, np.int64))
