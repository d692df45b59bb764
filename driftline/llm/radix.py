"""Compressed tries over bytes that keep the smallest id of each text, and cut points between texts."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any


def shared_length(a: bytes, b: bytes, at: int = 0) -> int:
    """How many bytes ``a`` and ``b`` from ``at`` have in common, by halving."""
    if b.startswith(a, at):
        return len(a)
    low, high = 0, min(len(a), len(b) - at)  # the first ``low`` agree, the first ``high`` + 1 cannot
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[at + low:at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


@dataclass(slots=True)
class Node:
    """``label``: the bytes on the way to this node. ``holders``: rows by group that have the smallest id, once a text ends here."""

    label: bytes
    children: dict[int, Node] = field(default_factory=dict)
    smallest: Any = None
    holders: dict[Any, int] | None = None
    offers: int = 0


class RadixTrie:
    """Texts in compressed form, the smallest id at the end of each.

    ``offer`` decides a row as soon as another row of its text has a smaller id; what is left at the ends
    are the rows with the smallest id so far, one entry for each text and group.
    """

    def __init__(self) -> None:
        self.root = Node(b"")
        self.bytes = 0

    def end_of(self, text: bytes) -> Node:
        """The node at which ``text`` ends, made if need be."""
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                leaf = Node(text[at:])
                node.children[text[at]] = leaf
                self.bytes += len(leaf.label)
                return leaf
            n = shared_length(child.label, text, at)
            if n < len(child.label):  # the edge forks inside its label
                fork = Node(child.label[:n], {child.label[n]: child})
                child.label = child.label[n:]
                node.children[text[at]] = fork
                child = fork
            node, at = child, at + n
        return node

    def offer(self, text: bytes, doc_id: Any, group: Any, n: int = 1) -> list[tuple[Any, Any, int]]:
        """Take in ``n`` rows; return the (id, group, rows) of this text that are now known to have a smaller id before them."""
        end = self.end_of(text)
        end.offers += 1
        if end.smallest is None or doc_id < end.smallest:
            beaten = [(end.smallest, g, k) for g, k in (end.holders or {}).items()]
            end.smallest, end.holders = doc_id, {group: n}
            return beaten
        if doc_id > end.smallest:
            return [(doc_id, group, n)]
        end.holders[group] = end.holders.get(group, 0) + n
        return []

    def ends(self) -> Iterator[tuple[bytes, Node]]:
        """Every text and its node, in no order."""
        stack = [(b"", self.root)]
        while stack:
            prefix, node = stack.pop()
            text = prefix + node.label
            if node.smallest is not None:
                yield text, node
            stack.extend((text, child) for child in node.children.values())

    def renewed(self, keep_bytes: int) -> RadixTrie:
        """A trie for the rows to come: only texts that were met more than once, without their holders."""
        out = RadixTrie()
        for text, node in self.ends():
            if node.offers > 1 and out.bytes + len(text) <= keep_bytes:
                end = out.end_of(text)
                end.smallest, end.holders, end.offers = node.smallest, {}, 1
        return out


def cut_points(texts: Sequence[tuple[bytes, int]], ranges: int) -> list[bytes]:
    """At most ``ranges`` - 1 prefixes that cut the sorted ``(text, weight)`` into ranges of like weight.

    A cut is the shortest prefix of a text that is above its predecessor, so it is as long as the texts
    around it need: after a passage that many texts begin with, cuts lie behind the passage.
    """
    total, run, cuts = sum(w for _, w in texts), 0, []
    for i, (text, weight) in enumerate(texts):
        if i and run * ranges >= total * (len(cuts) + 1) and text != texts[i - 1][0]:
            cuts.append(text[:shared_length(texts[i - 1][0], text) + 1])
        run += weight
    return cuts


def range_of(cuts: Sequence[bytes], text: bytes) -> int:
    return bisect_right(cuts, text)
