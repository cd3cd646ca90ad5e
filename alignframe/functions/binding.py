"""The best way to pair the literals of two formulas, by branch and bound over partial permutations.

Formulas are truth tables with an axis of length two per literal. Once the first k literals of one formula are paired, every
assignment of these k leaves a number of true cases on either side, and the two can agree on no more of the rest than these
numbers allow: that is the bound. Literals that a formula treats alike are tried in one order only, the earliest.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np

# Codes of the operators in postfix order, as in ``logic``.
_JOINED = {
    -2: np.logical_and,
    -3: np.logical_or,
    -4: np.logical_xor,
    -5: lambda a, b: ~a | b,
    -6: lambda a, b: a == b,
}


def truth_table(order: list[int], n: int) -> np.ndarray:
    """Values of a postfix formula whose literal v is variable v of ``n``."""
    stack: list[np.ndarray] = []
    for code in order:
        if code >= 0:
            stack.append(np.array([False, True]).reshape([2 if v == code else 1 for v in range(n)]))
        elif code == -1:
            stack.append(~stack.pop())
        else:
            right = stack.pop()
            stack.append(_JOINED[code](stack.pop(), right))
    return np.broadcast_to(stack[0], (2,) * n)


def _alike(table: np.ndarray) -> list[list[int]]:
    """For each variable those before it that may change places with it."""
    return [[a for a in range(b) if np.array_equal(table, table.swapaxes(a, b))] for b in range(table.ndim)]


class BindingSearch:
    """Pairs the variables of ``gold``, in their order, with those of ``pred``.

    ``ranks[i]`` lists the variables of ``pred`` in the order in which they are tried for variable i. Of equally good
    permutations the first one in that order is found.
    """

    def __init__(self, gold: np.ndarray, pred: np.ndarray, ranks: list[list[int]]):
        self.gold, self.pred, self.ranks, self.n = gold, pred, ranks, gold.ndim
        self.size = 1 << self.n
        # True cases of the rest, for every assignment of the first k variables.
        self.upto = [gold.sum(axis=tuple(range(k, self.n))) for k in range(self.n + 1)]
        self.place = [{p: at for at, p in enumerate(r)} for r in ranks]
        self.gold_alike = _alike(gold)
        self.pred_class = [min([p, *alike]) for p, alike in enumerate(_alike(pred))]
        self.counts: dict[int, np.ndarray] = {}

    def _count(self, image: list[int]) -> np.ndarray:
        chosen = sum(1 << p for p in image)
        counts = self.counts.get(chosen)
        if counts is None:
            counts = self.pred.sum(axis=tuple(p for p in range(self.n) if not chosen >> p & 1))
            if self.n <= 12:
                self.counts[chosen] = counts
        rising = sorted(image)
        return counts.transpose([rising.index(p) for p in image])

    def bound(self, image: list[int]) -> int:
        """Assignments on which both may agree at most; the very number for a whole permutation."""
        return self.size - int(np.abs(self.upto[len(image)] - self._count(image)).sum())

    def first(self) -> list[int]:
        image: list[int] = []
        for ranked in self.ranks:
            image.append(next(p for p in ranked if p not in image))
        return image

    def climbed(self) -> int:
        """A good score to begin with: the first permutation, improved by exchanges as long as that helps."""
        image = self.first()
        best, better = self.bound(image), True
        while better:
            better = False
            for a in range(self.n):
                for b in range(a):
                    image[a], image[b] = image[b], image[a]
                    score = self.bound(image)
                    if score > best:
                        best, better = score, True
                    else:
                        image[a], image[b] = image[b], image[a]
        return best

    def _choices(self, image: list[int]) -> Iterator[int]:
        i, tried = len(image), set()
        for p in self.ranks[i]:
            if p in image or self.pred_class[p] in tried:
                continue
            tried.add(self.pred_class[p])
            if all(self.place[g][image[g]] < self.place[g][p] for g in self.gold_alike[i]):
                yield p

    def best(self, prefix: list[int], floor: int, nodes: int) -> tuple[int, list[int] | None, bool]:
        """Score and image of the best permutation that starts with ``prefix`` and reaches ``floor``, and whether the search ended.

        Without any, the image is None. It stops at ``nodes`` partial permutations.
        """
        best, found = -1, None
        for at in range(len(prefix)):
            if prefix[at] not in self._choices(prefix[:at]):
                return best, found, True
        stack = [(self.bound(prefix), list(prefix))]
        while stack:
            bound, image = stack.pop()
            if bound <= best or bound < floor:
                continue
            if len(image) == self.n:
                best, found = bound, image
                continue
            if nodes <= 0:
                return best, found, False
            nodes -= 1
            wider = [[*image, p] for p in self._choices(image)]
            # The first choice is looked at first.
            stack.extend((self.bound(w), w) for w in reversed(wider))
        return best, found, True

    def number(self, image: list[int]) -> int:
        """The permutation's place in the order of trying."""
        out = 0
        for i, p in enumerate(image):
            ahead = self.place[i][p] - sum(self.place[i][q] < self.place[i][p] for q in image[:i])
            out += ahead * factorial(self.n - 1 - i)
        return out
