"""An adaptive radix tree over byte strings, one of which may be a prefix of another."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

#: A node of each layout holds at most this many children, then it grows into the next.
SMALL, MEDIUM, INDEXED = 4, 16, 48


class Node:
    """``prefix``: the bytes after the edge that leads here (path compression);
    ``value``: what is stored for the key that ends here, else None.

    Layouts: up to 4 and up to 16 children as sorted edge bytes beside the
    children; up to 48 as a table of 256 places that point into the children;
    beyond that, the 256 children themselves.
    """

    __slots__ = ("prefix", "value", "room", "edges", "kids")

    def __init__(self, prefix: bytes, value: object = None):
        self.prefix, self.value = prefix, value
        self.room, self.edges, self.kids = SMALL, bytearray(), []

    def child(self, edge: int) -> Node | None:
        if self.room <= MEDIUM:
            i = self.edges.find(edge)
            return self.kids[i] if i >= 0 else None
        if self.room == INDEXED:
            i = self.edges[edge]
            return self.kids[i - 1] if i else None
        return self.kids[edge]

    def _grow(self) -> None:
        if self.room == SMALL:
            self.room = MEDIUM
        elif self.room == MEDIUM:
            table = bytearray(256)
            for i, e in enumerate(self.edges):
                table[e] = i + 1
            self.room, self.edges = INDEXED, table
        else:
            wide = [None] * 256
            for e, i in enumerate(self.edges):
                if i:
                    wide[e] = self.kids[i - 1]
            self.room, self.edges, self.kids = 256, bytearray(), wide

    def put(self, edge: int, kid: Node) -> None:
        """Add or replace the child at ``edge``."""
        if self.room <= MEDIUM:
            i = bisect_left(self.edges, edge)
            if i < len(self.edges) and self.edges[i] == edge:
                self.kids[i] = kid
                return
            if len(self.kids) < self.room:
                self.edges.insert(i, edge)
                self.kids.insert(i, kid)
                return
        elif self.room == INDEXED:
            if i := self.edges[edge]:
                self.kids[i - 1] = kid
                return
            if len(self.kids) < INDEXED:
                self.kids.append(kid)
                self.edges[edge] = len(self.kids)
                return
        else:
            self.kids[edge] = kid
            return
        self._grow()
        self.put(edge, kid)

    def children(self) -> Iterator[Node]:
        """In order of their edge bytes."""
        if self.room <= MEDIUM:
            yield from self.kids
        elif self.room == INDEXED:
            yield from (self.kids[i - 1] for i in self.edges if i)
        else:
            yield from (k for k in self.kids if k is not None)


def shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


class RadixTree:
    def __init__(self) -> None:
        self.root: Node | None = None

    def insert(self, key: bytes, value: object) -> None:
        """``value`` must not be None; a key that is there gets the new value."""
        if self.root is None:
            self.root = Node(key, value)
            return
        node, at, above, edge = self.root, 0, None, 0
        while True:
            p = node.prefix
            m = len(p) if key.startswith(p, at) else shared(p, key[at:at + len(p)])
            at += m
            if m < len(p):
                top = Node(p[:m])
                node.prefix = p[m + 1:]
                top.put(p[m], node)
                if above is None:
                    self.root = top
                else:
                    above.put(edge, top)
                node = top
            if at == len(key):
                node.value = value
                return
            kid = node.child(key[at])
            if kid is None:
                node.put(key[at], Node(key[at + 1:], value))
                return
            above, edge, node, at = node, key[at], kid, at + 1

    def bottom_up(self) -> Iterator[tuple[Node, int, int, int]]:
        """(node, depth of its parent's end or -1, depth of its own end, number of
        children) of every node, children before parents, without recursion."""
        if self.root is None:
            return
        stack = [(self.root, -1, len(self.root.prefix), None)]
        while stack:
            node, above, end, kids = stack.pop()
            if kids is None:
                kids = list(node.children())
                stack.append((node, above, end, len(kids)))
                stack += [(k, end, end + 1 + len(k.prefix), None) for k in reversed(kids)]
            else:
                yield node, above, end, kids
