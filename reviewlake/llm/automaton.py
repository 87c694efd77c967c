"""Rule regexes compiled together into one minimised automaton of transition arrays.

Patterns are parsed with the standard library's regular-expression parser into
Thompson fragments over bytes, determinised by subset construction over byte
classes, and minimised by partition refinement.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from collections.abc import Iterator

import numpy as np


class _Nfa:
    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, parsed, start: int, fold: bool) -> int:
        """Appends the parsed sequence at ``start``; returns its end."""
        for op, arg in parsed:
            start = self.add_one(op, arg, start, fold)
        return start

    def step(self, start: int, over: set[int], fold: bool) -> int:
        if fold:
            over = over | {x ^ 32 for x in over if chr(x).isascii() and chr(x).isalpha()}
        if over and max(over) > 127:
            raise ValueError("rules match ASCII only")
        end = self.state()
        self.moves[start].append((frozenset(over), end))
        return end

    def add_one(self, op, arg, start: int, fold: bool) -> int:
        if op is sre.LITERAL:
            return self.step(start, {arg}, fold)
        if op is sre.IN:
            over: set[int] = set()
            for kind, x in arg:
                if kind is sre.LITERAL:
                    over.add(x)
                elif kind is sre.RANGE:
                    over |= set(range(x[0], x[1] + 1))
                else:
                    raise ValueError(f"no {kind} in rules")
            return self.step(start, over, fold)
        if op is sre.SUBPATTERN:
            flags = arg[1]
            return self.add(arg[3], start, fold or bool(flags & 2))
        if op is sre.BRANCH:
            end = self.state()
            for choice in arg[1]:
                own = self.state()
                self.empty[start].append(own)
                self.empty[self.add(choice, own, fold)].append(end)
            return end
        if op is sre.MAX_REPEAT:
            least, most, inner = arg
            for _ in range(least):
                start = self.add(inner, start, fold)
            if most is sre.MAXREPEAT:
                loop, end = self.state(), self.state()
                self.empty[start].append(loop)
                self.empty[self.add(inner, loop, fold)].append(loop)
                self.empty[loop].append(end)
                return end
            end = self.state()
            self.empty[start].append(end)
            for _ in range(most - least):
                start = self.add(inner, start, fold)
                self.empty[start].append(end)
            return end
        raise ValueError(f"no {op} in rules")

    def closure(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


class Automaton:
    """``next[state, byte]``; ``accepts[state]`` has bit r if rule r ends there.

    ``search``: rules may begin anywhere (state 0 is the start and the reset);
    otherwise they begin at the start only and ``dead`` is where none goes on.
    """

    def __init__(self, patterns: list[str], search: bool = True) -> None:
        nfa = _Nfa()
        root, ends = nfa.state(), {}
        for r, p in enumerate(patterns):
            own = nfa.state()
            nfa.empty[root].append(own)
            ends[nfa.add(sre_parser.parse(p), own, False)] = r
        start = nfa.closure({root})
        classes = self._classes(nfa)
        found, order, rows = {start: 0}, [start], []
        for now in order:
            row = []
            for byte in classes:
                to = {t for s in now for over, t in nfa.moves[s] if byte in over}
                then = nfa.closure(to | {root}) if search else nfa.closure(to)
                if then not in found:
                    found[then] = len(order)
                    order.append(then)
                row.append(found[then])
            rows.append(row)
        accepts = np.array([sum(1 << r for r in {ends[s] for s in now if s in ends}) for now in order], np.int64)
        dead = found.get(frozenset(), -1)
        rows_, accepts, at = self._minimised(np.array(rows, np.int64), accepts)
        self.of_byte = np.zeros(256, np.int64)
        for k, members in enumerate(classes.values()):
            self.of_byte[list(members)] = k
        self.next = rows_[:, self.of_byte].astype(np.int32)
        self.accepts, self.start, self.dead = accepts, int(at[0]), int(at[dead]) if dead >= 0 else -1
        #: Bytes after which a search is at its start again, whatever came before.
        self.resets = np.flatnonzero((self.next == self.start).all(axis=0))

    @staticmethod
    def _classes(nfa: _Nfa) -> dict[int, set[int]]:
        """Bytes that no move tells apart, by one of them."""
        signature: dict[tuple, set[int]] = {}
        sets = list({over for moves in nfa.moves for over, _ in moves})
        for byte in range(256):
            signature.setdefault(tuple(byte in s for s in sets), set()).add(byte)
        return {min(m): m for m in signature.values()}

    @staticmethod
    def _minimised(rows: np.ndarray, accepts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merges states that no continuation tells apart."""
        block = np.unique(accepts, return_inverse=True)[1]
        while True:
            finer = np.unique(np.column_stack([block, block[rows]]), axis=0, return_inverse=True)[1].reshape(-1)
            if finer.max() == block.max():
                break
            block = finer
        first = np.array([np.flatnonzero(block == b)[0] for b in range(block.max() + 1)])
        return block[rows[first]], accepts[first], block


def lanes(data: np.ndarray, resets: np.ndarray, wanted: int) -> np.ndarray:
    """Cuts of the bytes into about ``wanted`` lanes, each cut just after a reset byte or at an end."""
    at = np.flatnonzero(np.isin(data, resets)) + 1
    aims = np.linspace(0, len(data), wanted + 1).astype(np.int64)[1:-1]
    inner = at[np.minimum(np.searchsorted(at, aims), len(at) - 1)] if len(at) else at
    return np.unique(np.concatenate(([0], inner, [len(data)])))


def hits(auto: Automaton, data: np.ndarray, wanted: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(positions, rule bits) of the bytes at which some rule's match ends, in one pass over the bytes.

    The lanes advance together, a byte a step; each begins in the start state
    because a reset byte precedes it. Lanes that end early leave the pass.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cuts = lanes(data, auto.resets, max(1, min(wanted, len(data) // 64)))
    begin, length = cuts[:-1], np.diff(cuts)
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    flat, width = auto.next.reshape(-1), auto.next.shape[1]
    accepting = auto.accepts != 0
    state = np.full(len(begin), auto.start, np.int64)
    live = np.searchsorted(-length, -np.arange(length[0]), side="left")
    found = []
    for step, n in enumerate(live.tolist()):
        at = begin[:n] + step
        state = flat[state[:n] * width + data[at]]
        if (ok := accepting[state]).any():
            found.append((at[ok], auto.accepts[state[ok]]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    where, bits = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
    return where, bits


def matches(auto: Automaton, data: bytes, begin: int, end: int) -> Iterator[tuple[int, int]]:
    """Leftmost longest non-overlapping matches of an anchored automaton within data[begin:end].

    A state from which a place led to no match is remembered with the place, so
    that no later start walks there again: a text is read at most once a state.
    """
    table, accepts, dead, states = auto.next, auto.accepts, auto.dead, len(auto.next)
    vain: set[int] = set()
    at = begin
    while at < end:
        state, last, i, walked = auto.start, -1, at, []
        while i < end:
            state = table[state, data[i]]
            if state == dead:
                break
            i += 1
            if accepts[state]:
                last, walked = i, []
                continue
            key = i * states + int(state)
            if key in vain:
                break
            walked.append(key)
        vain.update(walked)
        if last > at:
            yield at, last
            at = last
        else:
            at += 1


def is_match(auto: Automaton, data: bytes, begin: int, end: int) -> bool:
    """Whether data[begin:end] as a whole is a match."""
    state = auto.start
    for i in range(begin, end):
        state = auto.next[state, data[i]]
        if state == auto.dead:
            return False
    return end > begin and bool(auto.accepts[state])
