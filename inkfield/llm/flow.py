"""Maximum flow by Dinic's algorithm, in plain Python: networks of one page, or of sources that overlap."""

from __future__ import annotations

from collections import deque

#: Capacities below this are none.
EPS = 1e-9


def max_flow(free: list[float], near: list[list[int]], head: list[int], room: list[float]) -> float:
    """Dinic's algorithm. free: what each node can take from the source (positive) or give to the sink (negative); it is
    left with the residual capacities, as is room, that of the edges. Returns the flow between nodes."""
    flow = 0.0
    while True:
        # levels: distance to a node that can still give to the sink
        level = {i: 0 for i, c in enumerate(free) if c < -EPS}
        queue = deque(level)
        while queue:
            u = queue.popleft()
            for k in near[u]:
                v = head[k]
                if v not in level and room[k ^ 1] > EPS:
                    level[v] = level[u] + 1
                    queue.append(v)
        begin = [i for i, c in enumerate(free) if c > EPS and i in level]
        if not begin:
            return flow
        turn = [0] * len(near)
        for s in begin:
            path: list[int] = []  # edges from s
            u = s
            while free[s] > EPS:
                if free[u] < -EPS:
                    f = min(free[s], -free[u], *[room[k] for k in path])
                    free[s] -= f
                    free[u] += f
                    flow += f
                    for k in path:
                        room[k] -= f
                        room[k ^ 1] += f
                    path, u = [], s
                    continue
                edges = near[u]
                while turn[u] < len(edges):
                    k = edges[turn[u]]
                    if room[k] > EPS and level.get(head[k]) == level[u] - 1:
                        break
                    turn[u] += 1
                else:
                    if not path:
                        break
                    level[u] = -9  # a dead end
                    u = head[path.pop() ^ 1]
                    turn[u] += 1
                    continue
                path.append(k)
                u = head[k]
