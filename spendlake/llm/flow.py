"""Minimum-cost flow on small graphs.

Only aggregates of bounded number (membership patterns, sources, shards) become
nodes here; documents never do.
"""

from __future__ import annotations

import heapq


class Network:
    """A directed graph with integer capacities and costs per unit."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def edge(self, a: int, b: int, capacity: int, cost: int) -> int:
        """Add an edge; returns its number for :meth:`used`."""
        for start, end, room, price in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.out[start].append(len(self.to))
            self.to.append(end)
            self.room.append(int(room))
            self.cost.append(price)
        return len(self.to) - 2

    def used(self, edge: int) -> int:
        return self.room[edge ^ 1]

    def send(self, source: int, sink: int) -> tuple[int, int]:
        """Send as much as fits along ever cheapest paths; returns amount and cost.

        Costs must not be negative.  Dijkstra on costs reduced by node
        potentials; every path saturates an edge, so amounts may be huge.
        """
        n = len(self.out)
        potential, amount, price = [0] * n, 0, 0
        while True:
            far: list[int | None] = [None] * n
            via = [-1] * n
            far[source] = 0
            heap = [(0, source)]
            while heap:
                d, a = heapq.heappop(heap)
                if d > far[a]:
                    continue
                for e in self.out[a]:
                    if self.room[e]:
                        b = self.to[e]
                        nd = d + self.cost[e] + potential[a] - potential[b]
                        if far[b] is None or nd < far[b]:
                            far[b], via[b] = nd, e
                            heapq.heappush(heap, (nd, b))
            if far[sink] is None:
                return amount, price
            potential = [p + (far[sink] if d is None else min(d, far[sink])) for p, d in zip(potential, far)]
            path, b = [], sink
            while b != source:
                path.append(via[b])
                b = self.to[via[b] ^ 1]
            least = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= least
                self.room[e ^ 1] += least
                price += least * self.cost[e]
            amount += least
