"""A prefix tree of globally ordered sets, walked to find sets similar to a probe.

Sets are arrays of token ranks in ascending order. Common tokens rank first, so similar sets
share long prefixes, and their overlap with a probe is counted once for all of them. A subtree
is left when even its best set can't reach the overlap that the similarity asks for, or when all
its sets are already in the probe's component.
"""

from __future__ import annotations

import numpy as np


class _Node:
    __slots__ = ("children", "least", "most", "one", "part", "same", "sets")

    def __init__(self, part: np.ndarray, size: int, doc: int):
        self.part, self.children, self.sets = part, {}, []
        self.least = self.most = size
        self.one, self.same = doc, True  # a set below; whether all below were in one component


class Links:
    """Union by smaller number."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


class Trie:
    def __init__(self, vocabulary: int, links: Links, percent: int):
        self.top, self.links, self.percent = None, links, percent
        self.member = np.zeros(vocabulary, bool)

    def needed(self, a: int, b: int) -> int:
        return -(-self.percent * (a + b) // (100 + self.percent))

    def add(self, ranks: np.ndarray, doc: int) -> None:
        size = len(ranks)
        if self.top is None:
            self.top = _Node(ranks[:0], size, doc)
        node, at = self.top, 0
        while True:
            node.least, node.most = min(node.least, size), max(node.most, size)
            if node.same and self.links.root(node.one) != self.links.root(doc):
                node.same = False
            if at == size:
                node.sets.append(doc)
                return
            child = node.children.get(first := int(ranks[at]))
            if child is None:
                node.children[first] = child = _Node(ranks[at:], size, doc)
                child.sets.append(doc)
                return
            m = min(len(child.part), size - at)
            differ = np.flatnonzero(child.part[:m] != ranks[at : at + m])
            m = int(differ[0]) if len(differ) else m
            if m < len(child.part):  # the part's head becomes a node of its own
                head = _Node(child.part[:m], child.least, child.one)
                head.most, head.same = child.most, child.same
                child.part = child.part[m:]
                head.children[int(child.part[0])] = child
                node.children[first] = head
                child = head
            node, at = child, at + m

    def _still(self, node: _Node) -> bool:
        """Whether all sets below are in one component now."""
        if not node.same:
            root = self.links.root(node.one)
            node.same = all(c.same and self.links.root(c.one) == root for c in node.children.values()) and all(self.links.root(d) == root for d in node.sets)
        return node.same

    def probe(self, ranks: np.ndarray, doc: int) -> list[int]:
        """Sets linked with this one, one at least of every component that has any; they are joined."""
        found: list[int] = []
        if self.top is None:
            return found
        size, links = len(ranks), self.links
        self.member[ranks] = True
        stack = [(self.top, 0, 0)]
        while stack:
            node, shared, depth = stack.pop()
            if self._still(node) and links.root(node.one) == links.root(doc):
                continue
            if node.most * 100 < self.percent * size or node.least * self.percent > 100 * size:
                continue
            part = node.part
            if len(part):
                shared += int(np.count_nonzero(self.member[part]))
                depth += len(part)
                left = size - int(np.searchsorted(ranks, part[-1], side="right"))
            else:
                left = size
            if shared + left < self.needed(size, node.least) or shared + node.most - depth < self.needed(size, node.most):
                continue
            for other in node.sets:  # these end here: their overlap is known
                if links.root(other) != links.root(doc) and shared >= self.needed(size, depth):
                    links.join(other, doc)
                    found.append(other)
            stack.extend((child, shared, depth) for child in node.children.values())
        self.member[ranks] = False
        return found


def ranked(sets: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """Each set as ascending ranks of its tokens, the most common first; the number of tokens."""
    tokens, inverse, counts = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    rank = np.empty(len(tokens), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(tokens))
    cuts = np.cumsum([len(s) for s in sets])[:-1] if sets else []
    return [np.sort(r) for r in np.split(rank[inverse], cuts)] if sets else [], len(tokens)


def join(sets: list[np.ndarray], percent: int, probes: range | None = None, component: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect what is similar, as pairs of indices: a spanning forest, not all pairs.

    With ``probes`` only those are probed, against all others; ``component`` says which are
    connected already (index of one member).
    """
    ranks, vocabulary = ranked(sets)
    links = Links(len(sets))
    for a, b in enumerate(component or []):
        links.join(a, b)
    trie, out = Trie(vocabulary, links, percent), []
    if probes is None:
        for i in sorted(range(len(sets)), key=lambda i: len(ranks[i])):
            out += [(i, j) for j in trie.probe(ranks[i], i)]
            trie.add(ranks[i], i)
    else:
        for i in range(len(sets)):
            if i not in probes:
                trie.add(ranks[i], i)
        for i in probes:
            out += [(i, j) for j in trie.probe(ranks[i], i)]
    return out
