"""Sequences compressed by pairing, folded by a min-plus product with the edits as ropes.

``paired`` replaces the most frequent adjacent pair of symbols by a new one until no pair repeats; the rules are
shared by all sequences given. ``Cell``s of a transfer matrix hold the cheapest cost of a passage and its
edits; of equal costs the edits first in ASCII order. Edits are ropes: a product makes a node, never a copy.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Sequence

#: Strings up to this length are joined by copying.
LEAF = 32
#: Marks of ropes are polynomials in this base modulo a prime.
BASE, PRIME = 1_000_003, (1 << 61) - 1


def paired(sequences: Sequence[Sequence[int]], first_new: int) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """(rules, compressed sequences): rule i makes symbol ``first_new + i`` of two earlier symbols.

    The most frequent pair comes first, of equals the smaller; occurrences are taken from the left, never
    overlapping, and never across sequences.
    """
    symbols: list[int] = []
    for sequence in sequences:
        symbols.extend(sequence)
        symbols.append(-1)
    n = len(symbols)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    places: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i in range(n - 1):
        if symbols[i] >= 0 and symbols[i + 1] >= 0:
            places[symbols[i], symbols[i + 1]].append(i)
    heap = [(-len(at), pair) for pair, at in places.items() if len(at) > 1]
    heapq.heapify(heap)
    rules: list[tuple[int, int]] = []
    while heap:
        count, pair = heapq.heappop(heap)
        left, right = pair
        valid, taken_to = [], -1
        for i in sorted(set(places.get(pair, ()))):
            j = after[i]
            if i > taken_to and symbols[i] == left and j < n and symbols[j] == right:
                valid.append(i)
                taken_to = j
        if len(valid) < 2:
            places.pop(pair, None)
            continue
        if len(valid) < -count:  # others took some of its places
            places[pair] = valid if left != right else places[pair]
            heapq.heappush(heap, (-len(valid), pair))
            continue
        new = first_new + len(rules)
        rules.append(pair)
        places.pop(pair, None)
        changed = set()
        for i in valid:
            j = after[i]
            symbols[i], symbols[j] = new, -2
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if symbols[after[i]] >= 0:
                    places[new, symbols[after[i]]].append(i)
                    changed.add((new, symbols[after[i]]))
            if before[i] >= 0 and symbols[before[i]] >= 0:
                places[symbols[before[i]], new].append(before[i])
                changed.add((symbols[before[i]], new))
        for pair in changed:
            if len(places[pair]) > 1:
                heapq.heappush(heap, (-len(set(places[pair])), pair))
    out: list[list[int]] = []
    row: list[int] = []
    for symbol in symbols:
        if symbol >= 0:
            row.append(symbol)
        elif symbol == -1:
            out.append(row)
            row = []
    return rules, out


class Rope:
    """Two ropes or strings on end, with a mark that equal texts share."""

    __slots__ = ("left", "right", "size", "mark")

    def __init__(self, left, right):
        self.left, self.right = left, right
        self.size = len(left) + len(right)
        self.mark = (mark(left) * pow(BASE, len(right), PRIME) + mark(right)) % PRIME

    def __len__(self) -> int:
        return self.size

    def __str__(self) -> str:
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, Rope):
                todo += (x.right, x.left)
            else:
                out.append(x)
        return "".join(out)


_MARKS: dict[str, int] = {}


def mark(x: Rope | str) -> int:
    if isinstance(x, Rope):
        return x.mark
    found = _MARKS.get(x)
    if found is None:
        found = 0
        for c in x:
            found = (found * BASE + ord(c)) % PRIME
        if len(_MARKS) > 100_000:
            _MARKS.clear()
        _MARKS[x] = found
    return found


def joined(a: Rope | str, b: Rope | str) -> Rope | str:
    if not len(a):
        return b
    if not len(b):
        return a
    if len(a) + len(b) <= LEAF and isinstance(a, str) and isinstance(b, str):
        return a + b
    return Rope(a, b)


def precedes(a: Rope | str, b: Rope | str) -> bool:
    """Whether ``a`` is before ``b`` in ASCII order. Shared and equal parts are stepped over whole."""
    left, right = [a], [b]
    while left and right:
        x, y = left.pop(), right.pop()
        if x is y or (len(x) == len(y) and mark(x) == mark(y)):
            continue
        if isinstance(x, str) and isinstance(y, str):
            n = min(len(x), len(y))
            if x[:n] != y[:n]:
                return x[:n] < y[:n]
            if len(x) > n:
                left.append(x[n:])
            if len(y) > n:
                right.append(y[n:])
        elif isinstance(x, Rope) and (isinstance(y, str) or len(x) >= len(y)):
            left += (x.right, x.left)
            right.append(y)
        else:
            left.append(x)
            right += (y.right, y.left)
    return not left and bool(right)


#: A passage from one state to another: its cost and edits; None where there is none.
Cell = tuple[int, "Rope | str"] | None


def better(a: Cell, b: Cell) -> Cell:
    if a is None or b is None:
        return b if a is None else a
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return b if precedes(b[1], a[1]) else a


def product(a: list[list[Cell]], b: list[list[Cell]]) -> list[list[Cell]]:
    """First ``a``, then ``b``."""
    states = range(len(b))
    out = []
    for row in a:
        made: list[Cell] = []
        for j in states:
            best: Cell = None
            for k in states:
                x, y = row[k], b[k][j]
                if x is None or y is None or (best is not None and x[0] + y[0] > best[0]):
                    continue
                best = better(best, (x[0] + y[0], joined(x[1], y[1])))
            made.append(best)
        out.append(made)
    return out


def folded(matrices: list[list[list[Cell]]]) -> list[list[Cell]]:
    """The product of one or more matrices, halving, so ropes stay shallow."""
    while len(matrices) > 1:
        matrices = [product(*matrices[i:i + 2]) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)]
    return matrices[0]
