"""Algorithms on query graphs (at most 32 vertices), which run on the driver while a plan is made."""

from __future__ import annotations

import heapq
import math
from collections import deque

from edgelift.model import Query


def components(q: Query) -> list[list[int]]:
    """Vertices of each connected component, the smaller ones first."""
    left, out = set(range(len(q.labels))), []
    while left:
        root = min(left)
        part = {root}
        queue = deque([root])
        while queue:
            for v in q.neighbours(queue.popleft()):
                if v not in part:
                    part.add(v)
                    queue.append(v)
        left -= part
        out.append(sorted(part))
    return sorted(out, key=lambda c: (len(c), c))


def core_numbers(q: Query) -> list[int]:
    """By peeling the vertex of least degree."""
    degree = [len(q.neighbours(u)) for u in range(len(q.labels))]
    out, gone, k = [0] * len(degree), set(), 0
    for _ in degree:
        u = min((u for u in range(len(degree)) if u not in gone), key=lambda u: (degree[u], u))
        k = max(k, degree[u])
        out[u] = k
        gone.add(u)
        for v in q.neighbours(u):
            degree[v] -= v not in gone
    return out


def two_core_size(q: Query) -> int:
    return sum(k > 1 for k in core_numbers(q))


def degeneracy_order(q: Query) -> list[int]:
    """The order in which vertices of least remaining degree are peeled."""
    degree = [len(q.neighbours(u)) for u in range(len(q.labels))]
    out: list[int] = []
    while len(out) < len(degree):
        u = min((u for u in range(len(degree)) if u not in out), key=lambda u: (degree[u], u))
        out.append(u)
        for v in q.neighbours(u):
            degree[v] -= v not in out
    return out


def depth_first(q: Query, root: int) -> list[int]:
    out, stack = [], [root]
    while stack:
        u = stack.pop()
        if u not in out:
            out.append(u)
            stack.extend(v for v in reversed(q.neighbours(u)) if v not in out)
    return out


def shortest_path(q: Query, a: int, b: int) -> list[int]:
    """Vertices of a path with the fewest edges, or nothing."""
    before, queue = {a: a}, deque([a])
    while queue:
        u = queue.popleft()
        for v in q.neighbours(u):
            if v not in before:
                before[v] = u
                queue.append(v)
    return _back(before, a, b)


def lightest_path(q: Query, a: int, b: int, candidates: list[int]) -> list[int]:
    """Dijkstra where a step to v costs log of v's candidates, at least a little."""
    before, best, heap = {a: a}, {a: 0.0}, [(0.0, a)]
    while heap:
        cost, u = heapq.heappop(heap)
        if cost > best[u]:
            continue
        for v in q.neighbours(u):
            new = cost + math.log(max(2, candidates[v]))
            if new < best.get(v, math.inf):
                best[v], before[v] = new, u
                heapq.heappush(heap, (new, v))
    return _back(before, a, b)


def _back(before: dict[int, int], a: int, b: int) -> list[int]:
    if b not in before:
        return []
    out = [b]
    while out[-1] != a:
        out.append(before[out[-1]])
    return out[::-1]


def edge_classes(q: Query) -> dict[tuple[int, int], str]:
    """core (both ends in the 2-core), leaf (an end of degree one) or tree."""
    core, out = core_numbers(q), {}
    for a, b in q.edges:
        leaf = min(len(q.neighbours(a)), len(q.neighbours(b))) == 1
        out[a, b] = "core" if core[a] > 1 and core[b] > 1 else "leaf" if leaf else "tree"
    return out


def shared_labels(q: Query, a: list[int], b: list[int]) -> list[int]:
    """Labels that occur in both vertex lists."""
    return sorted({q.labels[u] for u in a} & {q.labels[u] for u in b})
