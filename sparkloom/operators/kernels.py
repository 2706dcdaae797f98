"""Algorithms on one graph that fits into a task, on integer node numbers 0..n-1; no Spark in here.

Graphs are (n, src, dst, weight) arrays with nodes numbered in byte order of their names, so that ties are settled alike
everywhere. Callers bound the size of a graph before it comes here (see operators.graph).
"""

from __future__ import annotations

import heapq
import math
from collections import deque

import numpy as np

#: Fixed values of the algorithms: share of teleportation, decay fraction, floors and limits.
TELEPORT, KATZ_SHARE, KATZ_ROUNDS, KATZ_POWER, KATZ_EPSILON, KATZ_FLOOR = 0.15, 0.85, 50, 10, 1e-6, 1e-4
FLOW_STEPS, FLOW_EPSILON, FLOW_FLOOR = 20, 1e-4, 1e-10
FLAT = 1e-9


def neighbours(n: int, src: np.ndarray, dst: np.ndarray) -> list[list[int]]:
    """Distinct successors of each node in ascending order."""
    out: list[set[int]] = [set() for _ in range(n)]
    for a, b in zip(src.tolist(), dst.tolist(), strict=True):
        out[a].add(b)
    return [sorted(s) for s in out]


def min_max(x: np.ndarray, flat: float = 0.5) -> np.ndarray:
    """Scaled to 0..1; all ``flat`` where the values hardly differ."""
    low, high = x.min(), x.max()
    return (x - low) / (high - low) if high - low > FLAT else np.full(len(x), flat)


def hits(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, rounds: int = 30, epsilon: float = 1e-6, start: tuple | None = None, every_round: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Authority and hub scores with teleportation; hubs use the authorities of the round before.

    Scaled to unit length each round and to 0..1 at the end, or with ``every_round`` to 0..1 each round. A single node gets .5.
    """
    if n <= 1:
        return np.full(n, 0.5), np.full(n, 0.5)
    auth, hub = start or (np.ones(n), np.ones(n))
    for _ in range(rounds):
        new_auth = TELEPORT / n + (1 - TELEPORT) * np.bincount(dst, hub[src] * w, n)
        new_hub = TELEPORT / n + (1 - TELEPORT) * np.bincount(src, auth[dst] * w, n)
        if every_round:
            new_auth, new_hub = min_max(new_auth), min_max(new_hub)
        else:
            new_auth, new_hub = new_auth / (np.linalg.norm(new_auth) or 1), new_hub / (np.linalg.norm(new_hub) or 1)
        moved = np.max(np.abs(new_auth - auth) + np.abs(new_hub - hub))
        auth, hub = new_auth, new_hub
        if moved < epsilon:
            break
    return min_max(auth), min_max(hub)


def betweenness(n: int, src: np.ndarray, dst: np.ndarray, sources: list[int] | None = None) -> np.ndarray:
    """Dependency sums of shortest directed paths from ``sources`` (all by default), divided by the greatest."""
    total = np.zeros(n)
    nexts = neighbours(n, src, dst)
    for s in range(n) if sources is None else sources:
        total += dependencies(nexts, s)
    top = total.max(initial=0)
    return total / top if top > 0 else total


def dependencies(nexts: list[list[int]], s: int) -> np.ndarray:
    """How much each node lies on the shortest paths from s: one source of betweenness."""
    n = len(nexts)
    far, paths, order = [-1] * n, [0.0] * n, [s]
    far[s], paths[s] = 0, 1.0
    before: list[list[int]] = [[] for _ in range(n)]
    for v in order:
        for w in nexts[v]:
            if far[w] < 0:
                far[w] = far[v] + 1
                order.append(w)
            if far[w] == far[v] + 1:
                paths[w] += paths[v]
                before[w].append(v)
    out = np.zeros(n)
    for w in reversed(order):
        for v in before[w]:
            out[v] += paths[v] / paths[w] * (1 + out[w])
    out[s] = 0
    return out


def strong_components(n: int, src: np.ndarray, dst: np.ndarray) -> list[int]:
    """The least node of each node's strong component, by two passes of depth-first search."""
    nexts, backs = neighbours(n, src, dst), neighbours(n, dst, src)
    done, finished = [False] * n, []
    for root in range(n):
        if done[root]:
            continue
        done[root] = True
        stack = [(root, iter(nexts[root]))]
        while stack:
            v, rest = stack[-1]
            w = next((x for x in rest if not done[x]), None)
            if w is None:
                finished.append(v)
                stack.pop()
            else:
                done[w] = True
                stack.append((w, iter(nexts[w])))
    label = [-1] * n
    for root in reversed(finished):
        if label[root] >= 0:
            continue
        members, label[root] = [root], root
        for v in members:
            for w in backs[v]:
                if label[w] < 0:
                    label[w] = root
                    members.append(w)
        least = min(members)
        for v in members:
            label[v] = least
    return label


def distances(nexts: list[list[int]], s: int, most: int | None = None) -> dict[int, int]:
    """Hops from s to every node it reaches."""
    out = {s: 0}
    todo = deque([s])
    while todo:
        v = todo.popleft()
        if most is not None and out[v] >= most:
            continue
        for w in nexts[v]:
            if w not in out:
                out[w] = out[v] + 1
                todo.append(w)
    return out


def reach_counts(n: int, src: np.ndarray, dst: np.ndarray) -> list[int]:
    """How many other nodes each node reaches: bit sets over the condensation, in one sweep from the sinks."""
    label = strong_components(n, src, dst)
    inside: dict[int, int] = {}
    for v, c in enumerate(label):
        inside[c] = inside.get(c, 0) | 1 << v
    nexts: dict[int, set[int]] = {c: set() for c in inside}
    for a, b in zip(src.tolist(), dst.tolist(), strict=True):
        if label[a] != label[b]:
            nexts[label[a]].add(label[b])
    full: dict[int, int] = {}
    for c in topological(nexts)[::-1]:
        bits = inside[c]
        for x in nexts[c]:
            bits |= full[x]
        full[c] = bits
    return [full[label[v]].bit_count() - 1 for v in range(n)]


def topological(nexts: dict[int, set[int]]) -> list[int]:
    """Order of an acyclic graph, the least ready node first; nodes on cycles are left out."""
    waits = {v: 0 for v in nexts}
    for targets in nexts.values():
        for w in targets:
            waits[w] += 1
    ready = [v for v, k in waits.items() if not k]
    heapq.heapify(ready)
    out = []
    while ready:
        v = heapq.heappop(ready)
        out.append(v)
        for w in nexts[v]:
            waits[w] -= 1
            if not waits[w]:
                heapq.heappush(ready, w)
    return out


def chokepoints(n: int, src: np.ndarray, dst: np.ndarray) -> list[tuple[int, int, int]]:
    """(node, upstream, downstream) of nodes with an importer, at least max(2, ceil(sqrt n)) upstream and 1 downstream."""
    up, down = reach_counts(n, dst, src), reach_counts(n, src, dst)
    imported = np.bincount(dst, minlength=n)
    need = max(2, math.ceil(math.sqrt(n)))
    return [(v, up[v], down[v]) for v in range(n) if imported[v] and up[v] >= need and down[v] >= 1]


def topology(n: int, src: np.ndarray, dst: np.ndarray) -> dict[str, float]:
    """Weak components, greatest sizes, diameter by double sweep, share of ordered pairs connected, whether fragmented."""
    both = neighbours(n, np.concatenate([src, dst]), np.concatenate([dst, src]))
    seen, sizes = set(), []
    for v in range(n):
        if v not in seen:
            part = distances(both, v)
            seen |= part.keys()
            sizes.append((len(part), -v))
    sizes.sort(reverse=True)
    diameter = 0
    if sizes:
        first = distances(both, -sizes[0][1])
        end = max(first, key=lambda x: (first[x], -x))
        diameter = max(distances(both, end).values())
    pairs = n * (n - 1)
    second = sizes[1][0] if len(sizes) > 1 else 0
    return {"components": len(sizes), "largest": sizes[0][0] if sizes else 0, "second": second, "diameter": diameter, "reachable": sum(s * (s - 1) for s, _ in sizes) / pairs if pairs else 0.0, "fragmented": second >= 5}


def critical_chain(n: int, src: np.ndarray, dst: np.ndarray) -> list[int]:
    """Longest path over the condensation, each strong component shown by its least node; the first in node order among equals."""
    label = strong_components(n, src, dst)
    nexts: dict[int, set[int]] = {c: set() for c in label}
    for a, b in zip(src.tolist(), dst.tolist(), strict=True):
        if label[a] != label[b]:
            nexts[label[a]].add(label[b])
    best: dict[int, tuple[int, int]] = {}
    for c in topological(nexts)[::-1]:
        follow = min(((-best[x][0], x) for x in nexts[c]), default=(0, -1))
        best[c] = (1 - follow[0], follow[1])
    if not best:
        return []
    at = min(best, key=lambda c: (-best[c][0], c))
    path = []
    while at >= 0:
        path.append(at)
        at = best[at][1]
    return path


def cycles(n: int, src: np.ndarray, dst: np.ndarray, most: int = 10) -> list[list[int]]:
    """Short cycles: of small strong components first; pairs, then the shortest through each node by falling degree.

    A cycle is written from its least node on and reported once.
    """
    nexts = neighbours(n, src, dst)
    label = strong_components(n, src, dst)
    parts: dict[int, list[int]] = {}
    for v, c in enumerate(label):
        parts.setdefault(c, []).append(v)
    degree = np.bincount(src, minlength=n) + np.bincount(dst, minlength=n)
    found: list[list[int]] = []
    known = set()

    def add(path: list[int]) -> None:
        k = path.index(min(path))
        turned = tuple(path[k:] + path[:k])
        if turned not in known and len(found) < most:
            known.add(turned)
            found.append(list(turned))

    for part in sorted((p for p in parts.values() if len(p) > 1), key=lambda p: (len(p), p)):
        inside = set(part)
        for a in part:
            for b in nexts[a]:
                if a < b and b in inside and a in nexts[b]:
                    add([a, b])
        for s in sorted(part, key=lambda v: (-degree[v], v)):
            came = {s: -1}
            todo = deque([s])
            while todo:
                v = todo.popleft()
                if s in nexts[v]:
                    path = []
                    while v >= 0:
                        path.append(v)
                        v = came[v]
                    add(path[::-1])
                    break
                for w in nexts[v]:
                    if w in inside and w not in came:
                        came[w] = v
                        todo.append(w)
    return found


def feedback_arcs(n: int, src: np.ndarray, dst: np.ndarray) -> list[tuple[int, int]]:
    """Edges that point backwards in a greedy order: sinks last, sources first, else the node with most surplus of out-edges first."""
    outs, ins = [set(x) for x in neighbours(n, src, dst)], [set(x) for x in neighbours(n, dst, src)]
    for v in range(n):
        outs[v].discard(v)
        ins[v].discard(v)
    left, head, tail = set(range(n)), [], []

    def take(v: int) -> None:
        left.discard(v)
        for w in outs[v]:
            ins[w].discard(v)
        for u in ins[v]:
            outs[u].discard(v)

    while left:
        if (sink := min((v for v in left if not outs[v]), default=None)) is not None:
            tail.append(sink)
            take(sink)
        elif (source := min((v for v in left if not ins[v]), default=None)) is not None:
            head.append(source)
            take(source)
        else:
            v = min(left, key=lambda x: (len(ins[x]) - len(outs[x]), x))
            head.append(v)
            take(v)
    place = {v: i for i, v in enumerate(head + tail[::-1])}
    return sorted({(a, b) for a, b in zip(src.tolist(), dst.tolist(), strict=True) if place[a] > place[b]})


def dominators(n: int, src: np.ndarray, dst: np.ndarray, entry: int) -> dict[int, int]:
    """Immediate dominator of every node that the entry reaches: intersect over predecessors in reverse postorder until stable."""
    nexts = neighbours(n, src, dst)
    seen, post, stack = {entry}, [], [(entry, iter(nexts[entry]))]
    while stack:
        v, rest = stack[-1]
        w = next((x for x in rest if x not in seen), None)
        if w is None:
            post.append(v)
            stack.pop()
        else:
            seen.add(w)
            stack.append((w, iter(nexts[w])))
    order = post[::-1]
    number = {v: i for i, v in enumerate(order)}
    backs = neighbours(n, dst, src)
    idom = {entry: entry}
    changed = True
    while changed:
        changed = False
        for v in order[1:]:
            new = None
            for u in backs[v]:
                if u in idom:
                    if new is None:
                        new = u
                    else:
                        a, b = u, new
                        while a != b:
                            if number[a] > number[b]:
                                a = idom[a]
                            else:
                                b = idom[b]
                        new = a
            if new is not None and idom.get(v) != new:
                idom[v] = new
                changed = True
    return idom


def cheapest(nexts: list[dict[int, float]], s: int, t: int, no_nodes: set[int] = frozenset(), no_edges: set = frozenset()) -> tuple[float, list[int]] | None:
    """Cost and nodes of the cheapest path from s to t around excluded nodes and edges."""
    best, heap, came = {s: 0.0}, [(0.0, s)], {}
    while heap:
        cost, v = heapq.heappop(heap)
        if v == t:
            path = [t]
            while path[-1] != s:
                path.append(came[path[-1]])
            return cost, path[::-1]
        if cost > best[v]:
            continue
        for w, c in sorted(nexts[v].items()):
            if w in no_nodes or (v, w) in no_edges:
                continue
            if cost + c < best.get(w, math.inf) - 1e-15:
                best[w] = cost + c
                came[w] = v
                heapq.heappush(heap, (cost + c, w))
    return None


def diverse_paths(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, s: int, t: int, k: int = 3, most_shared: float = 0.7) -> list[tuple[float, list[int]]]:
    """Up to k loopless paths by rising cost -ln(w), leaving out those that share more than ``most_shared`` of their nodes with a kept one."""
    nexts: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, x in zip(src.tolist(), dst.tolist(), w.tolist(), strict=True):
        if x > 0:
            nexts[a][b] = min(nexts[a].get(b, math.inf), max(-math.log(x), 0.0))
    first = cheapest(nexts, s, t)
    if first is None:
        return []
    walked, kept, waiting = [first], [first], []
    while len(kept) < k and len(walked) < 8 * k:
        path = walked[-1][1]
        for i in range(len(path) - 1):
            root = path[: i + 1]
            cut = {(p[i], p[i + 1]) for _, p in walked if p[: i + 1] == root and len(p) > i + 1}
            spur = cheapest(nexts, path[i], t, set(root[:-1]), cut)
            if spur:
                cost = sum(nexts[a][b] for a, b in zip(root, root[1:], strict=False)) + spur[0]
                option = (round(cost, 12), root[:-1] + spur[1])
                if option not in waiting and option[1] not in [p for _, p in walked]:
                    heapq.heappush(waiting, option)
        if not waiting:
            break
        walked.append(heapq.heappop(waiting))
        nodes = set(walked[-1][1])
        if all(len(nodes & set(p)) / max(len(nodes), len(p)) <= most_shared for _, p in kept):
            kept.append(walked[-1])
    return kept


def katz(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, seeds: dict[int, float], rounds: int = KATZ_ROUNDS, epsilon: float = KATZ_EPSILON) -> np.ndarray:
    """Attenuated spread of seed mass along edges: x' = a·Aᵀx + s with a = .85 / spectral radius; scaled by the greatest, tiny ones 0."""
    s = np.zeros(n)
    for v, x in seeds.items():
        s[v] = x
    v, radius = np.full(n, 1 / math.sqrt(n)) if n else np.zeros(0), 0.0
    for _ in range(KATZ_POWER):
        v = np.bincount(dst, v[src] * w, n)
        radius = float(np.linalg.norm(v))
        if not radius:
            break
        v = v / radius
    x = s.copy()
    if radius > 0:
        for _ in range(rounds):
            new = s + KATZ_SHARE / radius * np.bincount(dst, x[src] * w, n)
            moved = np.linalg.norm(new - x)
            x = new
            if moved < epsilon:
                break
    top = x.max(initial=0)
    if top <= 0:
        return np.zeros(n)
    x = x / top
    x[x < KATZ_FLOOR] = 0
    return x


def absorbing_flow(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, entry: int, absorbing: set[int], steps: int = FLOW_STEPS, epsilon: float = FLOW_EPSILON) -> tuple[np.ndarray, np.ndarray, float]:
    """Visits, absorbed mass and residual of a unit of flow from the entry; rows of w are made to sum to 1.

    Mass that enters an absorbing node, or stands on a node without out-edges, is absorbed. What still moves at the end is
    the residual and counts as one more visit.
    """
    out = np.bincount(src, w, n)
    p = w / np.where(out[src] > 0, out[src], 1)
    stops = np.zeros(n, bool)
    stops[list(absorbing)] = True
    ends = stops | (out <= 0)
    visits, absorbed, mass = np.zeros(n), np.zeros(n), np.zeros(n)
    mass[entry] = 1.0
    for _ in range(steps):
        if mass.sum() < epsilon:
            break
        visits += mass
        mass = np.where(mass < FLOW_FLOOR, 0, mass)
        absorbed += np.where(ends, mass, 0)
        moved = np.bincount(dst, np.where(ends, 0, mass)[src] * p, n)
        absorbed += np.where(stops, moved, 0)
        visits += np.where(stops, moved, 0)
        mass = np.where(stops, 0, moved)
    return visits + mass, absorbed, float(mass.sum())


def communities(n: int, src: np.ndarray, dst: np.ndarray, start: list[int], gamma: float, rounds: int = 20) -> list[int]:
    """Labels after local moving from ``start`` labels: nodes in order join the neighbouring label that raises quality most.

    Between rounds labels whose members are not connected are split. Labels are the least member of each group.
    """
    undirected = [set() for _ in range(n)]
    for a, b in zip(src.tolist(), dst.tolist(), strict=True):
        if a != b:
            undirected[a].add(b)
            undirected[b].add(a)
    m = sum(map(len, undirected)) / 2
    label = list(start)
    for _ in range(rounds if m else 0):
        inner, degree = {}, {}
        for v in range(n):
            degree[label[v]] = degree.get(label[v], 0) + len(undirected[v])
            inner[label[v]] = inner.get(label[v], 0) + sum(label[u] == label[v] for u in undirected[v])
        moved = False
        for v in range(n):
            k, mine = len(undirected[v]), label[v]
            links: dict[int, int] = {}
            for u in sorted(undirected[v]):
                links[label[u]] = links.get(label[u], 0) + 1
            # leaving one label and joining another changes the inner edges and the squared degree shares of both
            leave = -links.get(mine, 0) / (2 * m) - gamma * ((degree[mine] - k) ** 2 - degree[mine] ** 2) / (2 * m) ** 2
            best, gain = mine, 0.0
            for other, to in links.items():
                if other != mine:
                    q = leave + to / (2 * m) - gamma * ((degree[other] + k) ** 2 - degree[other] ** 2) / (2 * m) ** 2
                    if q > gain + 1e-15:
                        best, gain = other, q
            if best != mine:
                degree[mine] -= k
                degree[best] += k
                label[v] = best
                moved = True
        label = _split(undirected, label)
        if not moved or len(set(label)) <= 1:
            break
    return _split(undirected, label)


def _split(undirected: list[set[int]], label: list[int]) -> list[int]:
    """Every connected part of a label gets the number of its least member."""
    out = [-1] * len(label)
    for v in range(len(label)):
        if out[v] < 0:
            out[v] = v
            todo = [v]
            for x in todo:
                for u in undirected[x]:
                    if out[u] < 0 and label[u] == label[v]:
                        out[u] = v
                        todo.append(u)
    return out


def resolution(n: int) -> float:
    """Resolution of communities by graph size."""
    return min(max(1 + math.log10(n / 1000), 0.5), 3.0) if n else 1.0
