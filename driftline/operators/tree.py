"""Classification trees, grown on arrays, and their votes.

A forest is trained as one Spark task per tree (``operators/model.py``); this module is what such a task
does with its bootstrap draw.  ``grow`` splits all nodes of a level at once: values are replaced by their
ranks, and one sort of (node, rank) per feature makes the class counts left of every possible cut running
sums; a node is evaluated on the features it looks at only.  ``grow_large`` splits nodes of many rows one by
one, in place and in pieces of bounded size, and leaves the smaller ones to ``grow``.  Both look at every
value of every drawn row; no cut is taken from a sample.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np

#: Arrays of a tree by name; children of node i are ``left[i]`` and ``left[i] + 1``, a leaf has feature -1.
FIELDS = {"feature": np.int16, "threshold": np.float64, "left": np.int32, "shares": np.float64}

#: Levels that rows go down before those in a leaf are put aside.
LEVELS = 4
#: Rows that a large node handles at once.
PIECE = 1 << 20


def _walk(x: np.ndarray, steps: tuple[np.ndarray, ...]) -> np.ndarray:
    """The leaf that each row of ``x`` falls into."""
    leaf, feature, threshold, left = steps
    values = np.ascontiguousarray(x).ravel()
    at = np.zeros(len(x), dtype=np.intp)
    rows, node = np.arange(len(x)), np.zeros(len(x), dtype=np.intp)
    while len(rows):
        done = leaf[node]
        at[rows[done]] = node[done]
        rows, node = rows[~done], node[~done]
        first = rows * x.shape[1]
        for _ in range(LEVELS if len(rows) else 0):
            node = left.take(node) + (values.take(first + feature.take(node)) > threshold.take(node))
    return at


@dataclass
class Tree:
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    shares: np.ndarray  # class shares of every node, classes next to each other

    @cached_property
    def steps(self) -> tuple[np.ndarray, ...]:
        """(is a leaf, feature, threshold, left child), where a leaf is its own child: a row in one stays there."""
        leaf = self.feature < 0
        return (leaf, np.where(leaf, 0, self.feature).astype(np.intp), np.where(leaf, np.inf, self.threshold),
                np.where(leaf, np.arange(len(leaf)), self.left).astype(np.intp))

    def vote(self, x: np.ndarray, classes: int) -> np.ndarray:
        """Class shares of the leaf that each row of ``x`` falls into."""
        return self.shares.reshape(-1, classes)[_walk(x, self.steps)]

    def packed(self) -> Packed:
        split = self.feature >= 0
        shares = self.shares.reshape(len(split), -1)
        pure = ~split & (shares.max(1) == 1.0)
        feature = np.where(pure, -2 - shares.argmax(1), self.feature).astype(np.int16)
        return Packed(feature, self.threshold[split], self.left[split], shares[~split & ~pure].ravel())


@dataclass
class Packed:
    """A tree as it is stored: thresholds and left children of the splits only, shares of the mixed leaves only.

    A leaf of one class c has feature -2 - c, a mixed leaf -1.
    """

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    shares: np.ndarray

    def vote(self, x: np.ndarray, classes: int) -> np.ndarray:
        """Class shares of the leaf that each row of ``x`` falls into. What the walk needs is laid out for this call."""
        split, n = self.feature >= 0, len(self.feature)
        threshold, left = np.full(n, np.inf), np.arange(n)
        threshold[split], left[split] = self.threshold, self.left
        at = _walk(x, (~split, np.where(split, self.feature, 0).astype(np.intp), threshold, left))
        kind = self.feature[at].astype(np.intp)
        out = np.zeros((len(x), classes))
        pure = np.flatnonzero(kind < -1)
        out[pure, -2 - kind[pure]] = 1.0
        mixed = np.flatnonzero(kind == -1)
        out[mixed] = self.shares.reshape(-1, classes)[np.searchsorted(np.flatnonzero(self.feature == -1), at[mixed])]
        return out


def unpack(fields: dict[str, bytes | bytearray]) -> Packed:
    """A stored tree; one stored before trees were packed has a threshold for every node."""
    arrays = {k: np.frombuffer(fields[k], dtype=t) for k, t in FIELDS.items()}
    return Tree(**arrays).packed() if len(arrays["threshold"]) == len(arrays["feature"]) else Packed(**arrays)


def bootstrap(n: int, rng: np.random.Generator) -> np.ndarray:
    """How often each of ``n`` rows is drawn when ``n`` rows are drawn with replacement."""
    return np.bincount(rng.integers(0, n, n), minlength=n) if n else np.zeros(0, dtype=np.int64)


class BlockBootstrap:
    """The same draw for rows that come in blocks: first how many of the ``n`` draws fall into each block, then where.

    Every block can be drawn by itself and again, in any order.
    """

    def __init__(self, n: int, block: int, seed: Sequence[int]):
        self.n, self.block, self.seed = n, block, list(seed)
        sizes = np.full(-(-n // block), block)
        sizes[-1] -= len(sizes) * block - n
        self.sizes, self.counts = sizes, np.random.default_rng(self.seed).multinomial(n, sizes / n)
        self._last: tuple[int, np.ndarray] = (-1, np.zeros(0, dtype=np.int64))

    def _drawn(self, number: int) -> np.ndarray:
        if self._last[0] != number:
            rng = np.random.default_rng([*self.seed, number])
            size = self.sizes[number]
            self._last = number, np.bincount(rng.integers(0, size, self.counts[number]), minlength=size)
        return self._last[1]

    def weights(self, first: int, end: int) -> np.ndarray:
        """How often the rows with the numbers from ``first`` up to ``end`` are drawn."""
        return np.concatenate([self._drawn(b)[max(0, first - b * self.block):end - b * self.block]
                               for b in range(first // self.block, (end - 1) // self.block + 1)])


def _impurity(left: np.ndarray, right: np.ndarray, min_leaf: int, can: np.ndarray) -> np.ndarray:
    """The score of cuts from the class counts on both sides (class by class), -inf where there is no cut."""
    n_left, n_right = left.sum(0), right.sum(0)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = (left ** 2).sum(0) / n_left + (right ** 2).sum(0) / n_right
    score[~can | (n_left < min_leaf) | (n_right < min_leaf)] = -np.inf
    return score


def _between(low, high):
    """The threshold between two neighbouring values."""
    with np.errstate(invalid="ignore"):  # the lowest value may be minus infinity
        middle = low + (high - low) / 2
    return np.where(middle < high, middle, low)


def _counted(node, rank, label, weight, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per (node, rank) that occurs, in order: node, rank and the class counts up to and with it (class by class)."""
    bits = [max(1, int(a.max()).bit_length()) for a in (rank, label, weight)]
    room = bits[0] + int(node.max()).bit_length() + bits[1] + bits[2] <= 63
    key = (node.astype(np.int64) << bits[0]) | rank
    if room:  # label and weight are sorted along
        packed = np.sort((((key << bits[1]) | label) << bits[2]) | weight)
        weight, label, key = packed & ((1 << bits[2]) - 1), (packed >> bits[2]) & ((1 << bits[1]) - 1), packed >> (bits[1] + bits[2])
    else:
        order = np.argsort(key, kind="stable")
        key, label, weight = key[order], label[order], weight[order]
    ends = np.append(np.flatnonzero(key[1:] != key[:-1]), len(key) - 1)
    run = np.empty((classes, len(ends)))
    whole = np.cumsum(weight)[ends] if classes == 2 else None
    for c in range(classes):
        run[c] = whole - run[0] if c and classes == 2 else np.cumsum(np.where(label == c, weight, 0))[ends]
    key = key[ends]
    return key >> bits[0], key & ((1 << bits[0]) - 1), run


def _best_cuts(node, rank, label, weight, classes: int, totals, min_leaf: int):
    """The best cut of one feature in the nodes that occur: (node, score or -inf, the ranks on both sides of the cut)."""
    node, rank, run = _counted(node, rank, label, weight, classes)
    starts = np.append(0, np.flatnonzero(node[1:] != node[:-1]) + 1)
    sizes = np.diff(np.append(starts, len(node)))
    before = np.where(starts > 0, run[:, starts - 1], 0.0)
    left = run - np.repeat(before, sizes, axis=1)
    can = np.ones(len(node), dtype=bool)
    can[starts + sizes - 1] = False
    score = _impurity(left, totals.T[:, node] - left, min_leaf, can)
    best = np.maximum.reduceat(score, starts)
    found = np.flatnonzero(score == np.repeat(best, sizes))
    first = found[np.searchsorted(found, starts)]
    return node[starts], best, rank[first], rank[np.minimum(first + 1, len(rank) - 1)]


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray, classes: int, rng: np.random.Generator, tried: int,
         max_depth: int | None = None, min_leaf: int = 1) -> Tree:
    """A tree on the rows with a positive ``weight``, grown until its leaves are pure or cannot be split.

    Each node looks at ``tried`` features drawn among those that vary in it and takes the cut with the
    lowest Gini impurity (ties: the feature drawn first, then the lowest threshold).
    """
    drawn = np.flatnonzero(weight)
    n, n_features = len(drawn), x.shape[1]
    values, ranks = [], np.empty((n_features, n), dtype=np.int32)
    for f in range(n_features):
        u, ranks[f] = np.unique(x[drawn, f], return_inverse=True)
        values.append(u)
    label, weight = y[drawn].astype(np.int64), weight[drawn].astype(np.int64)
    node = np.zeros(n, dtype=np.int64)  # position among the nodes of the level; the rows of a node stand together
    n_nodes, depth, made = 1, 0, 1
    out: dict[str, list] = {k: [] for k in FIELDS}
    while n_nodes:
        totals = np.bincount(node * classes + label, weight, n_nodes * classes).reshape(n_nodes, classes)
        size = totals.sum(1)
        feature = np.full(n_nodes, -1, dtype=np.int16)
        threshold = np.zeros(n_nodes)
        open_ = (totals.max(1) < size) & (size >= 2 * min_leaf) & (max_depth is None or depth < max_depth)
        n_open = int(open_.sum())
        if n_open:
            if n_open < n_nodes:
                stay = np.flatnonzero(open_[node])
                ranks, label, weight, node = ranks[:, stay], label[stay], weight[stay], (np.cumsum(open_) - 1)[node[stay]]
            starts = np.searchsorted(node, np.arange(n_open))
            varies = np.minimum.reduceat(ranks, starts, axis=1) < np.maximum.reduceat(ranks, starts, axis=1)
            scores, cuts, at_rank = np.full((n_features, n_open), -np.inf), np.zeros((n_features, n_open)), np.zeros((n_features, n_open), dtype=np.int32)
            draw = rng.random(scores.shape)
            draw[~varies] = 2.0  # what does not vary is not drawn
            looked = np.argsort(draw, axis=0, kind="stable")[:tried]
            asked = varies.copy()
            if min_leaf == 1:  # otherwise what varies may have no cut
                asked[:] = False
                np.put_along_axis(asked, looked, True, 0)
                asked &= varies
            for f in range(n_features):
                if not asked[f].any():
                    continue
                here = slice(None) if asked[f].all() else np.flatnonzero(asked[f][node])
                of, score, low, high = _best_cuts(node[here], ranks[f][here], label[here], weight[here], classes, totals[open_], min_leaf)
                scores[f, of], at_rank[f, of] = score, low
                cuts[f, of] = _between(values[f][low], values[f][high])
            if min_leaf > 1:
                draw[scores == -np.inf] = 2.0
                looked = np.argsort(draw, axis=0, kind="stable")[:tried]
            best = np.take_along_axis(looked, np.take_along_axis(scores, looked, 0).argmax(0)[None], 0)[0]
            across = np.arange(n_open)
            feature[open_] = np.where(scores[best, across] > -np.inf, best, -1)
            threshold[open_] = cuts[best, across]
        split = feature >= 0
        left = np.where(split, made + 2 * (np.cumsum(split) - 1), -1).astype(np.int32)
        for k, v in zip(FIELDS, (feature, threshold, left, totals / np.maximum(size, 1)[:, None])):
            out[k].append(v.ravel())
        n_split = int(split.sum())
        made, n_nodes, depth = made + 2 * n_split, 2 * n_split, depth + 1
        if not n_split:
            break
        if n_split < n_open:
            stay = np.flatnonzero(split[open_][node])
            ranks, label, weight, node = ranks[:, stay], label[stay], weight[stay], node[stay]
        right = ranks[best[node], np.arange(len(node))] > at_rank[best, across][node]
        child = 2 * (np.cumsum(split[open_]) - 1)[node] + right
        counts = np.bincount(child, minlength=n_nodes)
        place, to = np.empty(len(child), dtype=np.intp), np.cumsum(counts) - counts
        for side, rows in enumerate((np.flatnonzero(~right), np.flatnonzero(right))):  # both in order of their node
            per = counts[side::2]
            place[rows] = np.arange(len(rows)) + np.repeat(to[side::2] - (np.cumsum(per) - per), per)
        order = np.empty_like(place)
        order[place] = np.arange(len(place))
        ranks, label, weight, node = ranks[:, order], label[order], weight[order], np.repeat(np.arange(n_nodes), counts)
    return Tree(**{k: np.concatenate(v).astype(t) for (k, v), t in zip(out.items(), FIELDS.values())})


def _value_counts(column, values, label, weight, classes: int):
    """The values that occur, in order, with the class counts of each (class by class); in pieces of about ``PIECE`` rows."""
    if values is not None:  # codes
        counts = np.zeros(len(values) * classes)
        for at in range(0, len(column), PIECE):
            piece = slice(at, at + PIECE)
            counts += np.bincount(column[piece].astype(np.intp) * classes + label[piece], weight[piece], len(counts))
        counts = counts.reshape(-1, classes).T
        there = counts.sum(0) > 0
        yield values[there], counts[:, there]
        return
    pieces = -(-len(column) // PIECE)  # ranges of values; where they lie decides how many rows a piece has, nothing else
    some = np.sort(column[::max(1, len(column) >> 16)])
    edges = np.unique(some[np.arange(1, pieces) * len(some) // pieces])
    for k in range(len(edges) + 1):
        inside = np.ones(len(column), dtype=bool) if k == 0 else column >= edges[k - 1]
        if k < len(edges):
            inside &= column < edges[k]
        rows = np.flatnonzero(inside)
        if len(rows):
            found, group = np.unique(column[rows], return_inverse=True)
            yield found, np.bincount(group * classes + label[rows], weight[rows], len(found) * classes).reshape(-1, classes).T


def _best_cut(column, values, label, weight, classes: int, totals, min_leaf: int) -> tuple[float, float]:
    """The best cut of one feature in one node: (score or -inf, threshold)."""
    best, low, high = -np.inf, np.nan, np.nan
    seen, run = np.empty(0), np.zeros((classes, 0))  # the last value of the pieces before and the counts up to it
    for found, counts in _value_counts(column, values, label, weight, classes):
        upto = np.cumsum(counts, axis=1) + (run if run.size else 0)
        found, left = np.append(seen, found), np.concatenate((run, upto), axis=1)
        score = _impurity(left[:, :-1], totals[:, None] - left[:, :-1], min_leaf, np.ones(len(found) - 1, dtype=bool))
        if len(score) and score.max() > best:
            at = int(score.argmax())
            best, low, high = score[at], found[at], found[at + 1]
        seen, run = found[-1:], left[:, -1:]
    return best, float(_between(low, high))


def grow_large(columns: list[np.ndarray], values: Sequence[np.ndarray | None], label: np.ndarray, weight: np.ndarray, classes: int,
               rng: np.random.Generator, tried: int, max_depth: int | None = None, min_leaf: int = 1, at_once: int = 100_000) -> Packed:
    """A tree by the rules of ``grow`` on any number of drawn rows; nodes of at most ``at_once`` rows are grown by it.

    A column holds numbers, or codes of its sorted ``values``. Columns, labels and weights are reordered in
    place, so that the rows of a node stand together.
    """
    splits: list[tuple[int, int, float, int]] = []  # (node, feature, threshold, left child)
    grown: list[tuple[int, int, Packed]] = []  # (node, number of the second node, the tree from that node on)
    made, waiting = 1, [(0, len(label), 0, 0)]
    while waiting:
        first, end, depth, at = waiting.pop()
        own = slice(first, end)
        deeper = None if max_depth is None else max_depth - depth
        if end - first <= at_once:
            x = np.column_stack([c[own] if v is None else v[c[own]] for c, v in zip(columns, values)])
            tree = grow(x, label[own], weight[own], classes, rng, tried, deeper, min_leaf).packed()
            grown.append((at, made, tree))
            made += len(tree.feature) - 1
            continue
        totals = sum(np.bincount(label[k:min(k + PIECE, end)], weight[k:min(k + PIECE, end)], classes) for k in range(first, end, PIECE))
        scores, cuts, best = np.full(len(columns), -np.inf), np.full(len(columns), np.nan), 0
        if totals.max() < totals.sum() and totals.sum() >= 2 * min_leaf and deeper != 0:
            varies = np.array([c[own].min() < c[own].max() for c in columns])
            draw = np.where(varies, rng.random(len(columns)), 2.0)
            looked = np.argsort(draw, kind="stable")[:tried]
            for f in looked if min_leaf == 1 else range(len(columns)):
                if varies[f]:
                    scores[f], cuts[f] = _best_cut(columns[f][own], values[f], label[own], weight[own], classes, totals, min_leaf)
            if min_leaf > 1:  # what varies may have no cut
                looked = np.argsort(np.where(scores > -np.inf, draw, 2.0), kind="stable")[:tried]
            best = looked[scores[looked].argmax()]
        if scores[best] == -np.inf:
            leaf = Tree(np.array([-1], np.int16), np.zeros(1), np.array([-1], np.int32), totals / totals.sum())
            grown.append((at, made, leaf.packed()))
            continue
        column, known = columns[best][own], values[best]
        right = column > cuts[best] if known is None else column >= np.searchsorted(known, cuts[best], "right")
        middle = end - int(right.sum())
        for a in (*columns, label, weight):
            lower, upper = a[own][~right], a[own][right]
            a[first:middle], a[middle:end] = lower, upper
        splits.append((at, best, cuts[best], made))
        waiting += [(middle, end, depth + 1, made + 1), (first, middle, depth + 1, made)]
        made += 2
    feature, threshold, left = np.empty(made, np.int16), np.empty(made), np.empty(made, np.int32)
    for at, f, cut, child in splits:
        feature[at], threshold[at], left[at] = f, cut, child
    mixed, shares = [], []
    for at, second, tree in grown:
        place = np.append(at, np.arange(second, second + len(tree.feature) - 1))
        feature[place] = tree.feature
        split = place[tree.feature >= 0]
        threshold[split], left[split] = tree.threshold, tree.left + (second - 1)
        mixed.append(place[tree.feature == -1])
        shares.append(tree.shares.reshape(-1, classes))
    order = np.argsort(np.concatenate(mixed), kind="stable")
    return Packed(feature, threshold[feature >= 0], left[feature >= 0], np.concatenate(shares)[order].ravel())
