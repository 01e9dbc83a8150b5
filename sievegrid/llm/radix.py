"""A compressed radix (Patricia) trie over byte strings that spills whole subtrees to disk."""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Callable, Iterator
from typing import Any


class _Node:
    __slots__ = ("label", "children", "terminal")

    def __init__(self, label: bytes):
        self.label = label
        self.children: dict[int, _Node] = {}
        self.terminal: Any = None


def shared_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving: each step is one comparison of slices."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class _Spilled:
    """The keys below one first byte, written out in the order they came."""

    def __init__(self):
        self.file = tempfile.TemporaryFile()
        self.prefix: bytes | None = None

    def add(self, key: bytes, item: Any) -> None:
        self.prefix = key if self.prefix is None else self.prefix[: shared_prefix(self.prefix, key)]
        pickle.dump((key, item), self.file, protocol=5)

    def read(self) -> Iterator[tuple[bytes, Any]]:
        self.file.seek(0)
        while True:
            try:
                yield pickle.load(self.file)
            except EOFError:
                self.file.close()
                return


class PatriciaTrie:
    """Maps byte strings to what ``merge`` makes of the items put under them.

    budget: bytes of keys held in memory. Beyond it the largest subtree below the root's
    branching byte goes to a temporary file; later keys of that subtree follow it there, and
    ``drain`` builds such subtrees again, one at a time. skip: length of a prefix that all
    keys share, so that a subtree branches where its keys part.
    """

    def __init__(self, merge: Callable[[Any, Any], Any], budget: int = 64 << 20, skip: int = 0):
        self.merge, self.budget, self.skip, self.shared = merge, budget, skip, b""
        self.tops: dict[int, _Node] = {}
        self.sizes: dict[int, int] = {}
        self.spilled: dict[int, _Spilled] = {}
        self.held = 0

    def put(self, key: bytes, item: Any) -> None:
        top = key[self.skip] if len(key) > self.skip else -1
        if top in self.spilled:
            self.spilled[top].add(key, item)
            return
        if top not in self.tops:
            self.tops[top], self.sizes[top] = _Node(b""), 0
        node, at = self.tops[top], self.skip
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = _Node(key[at:])
                node.children[key[at]] = child
                self.sizes[top] += len(child.label) + 200
                self.held += len(child.label) + 200
                node, at = child, len(key)
                break
            if not key.startswith(child.label, at):
                n = shared_prefix(child.label, key[at : at + len(child.label)])
                fork = _Node(child.label[:n])
                fork.children[child.label[n]] = child
                child.label = child.label[n:]
                node.children[key[at]] = fork
                child = fork
            node, at = child, at + len(child.label)
        node.terminal = item if node.terminal is None else self.merge(node.terminal, item)
        if self.held > self.budget:
            self._spill()

    def _spill(self) -> None:
        top = max((t for t in self.sizes if t != -1), key=self.sizes.get)
        out = self.spilled[top] = _Spilled()
        for key, item in self._walk(self.tops.pop(top), self.shared):
            out.add(key, item)
        self.held -= self.sizes.pop(top)

    def _walk(self, node: _Node, prefix: bytes) -> Iterator[tuple[bytes, Any]]:
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            if node.terminal is not None:
                yield prefix, node.terminal
            stack.extend((c, prefix + c.label) for c in node.children.values())

    def drain(self) -> Iterator[tuple[bytes, Any]]:
        """Every key once, with its merged item; empties the trie."""
        for top in list(self.tops):
            yield from self._walk(self.tops.pop(top), self.shared)
        self.sizes, self.held = {}, 0
        for top in list(self.spilled):
            part = self.spilled.pop(top)
            below = PatriciaTrie(self.merge, self.budget, len(part.prefix or b""))
            below.shared = part.prefix or b""
            for key, item in part.read():
                below.put(key, item)
            yield from below.drain()
