"""Graphs as edge tables: components, reachability, distances, flows, tunnels and Markov rows.

Components, reachability and distances are rounds of joins with checkpoints between them. Flows run on Reeb graphs, which
hold a row for each component of a level set: one group (``keys``) is one graph and is solved in one task.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint
from .scan import numbered


def _local_roots(frame: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """keys, x, y: every node of the edges (keys, x, y) with the smallest node that these edges alone connect it to."""
    ends = pd.concat([frame[[*keys, "x"]], frame[[*keys, "y"]].rename(columns={"y": "x"})], ignore_index=True)
    codes = ends.groupby([*keys, "x"], sort=True, dropna=False).ngroup().to_numpy()
    n, half = int(codes.max()) + 1, len(frame)
    label, u, v = np.arange(n), codes[:half], codes[half:]
    while True:
        lu, lv = label[u], label[v]
        if (lu == lv).all():
            break
        low = np.minimum(lu, lv)
        np.minimum.at(label, lu, low)
        np.minimum.at(label, lv, low)
        while (label[label] != label).any():
            label = label[label]
    row = np.empty(n, np.int64)
    row[codes] = np.arange(len(ends))  # a row of each node, in the nodes' order
    nodes = ends.iloc[row].reset_index(drop=True)
    return nodes.assign(y=nodes["x"].to_numpy()[label])


def components(edges: DataFrame, keys: Sequence[str] = (), a: str = "a", b: str = "b", rounds: int = 200, chunk: int = 1 << 20) -> DataFrame:
    """keys, node, component (smallest node that is reachable) for every node of the edge list.

    Edges are first joined within chunks of each partition, so only what crosses chunks is left to the rounds. In a round
    each node hooks onto its smallest root, other roots seen at it become edges to that one, and roots are replaced by
    their own roots, so chains shorten geometrically. No join makes more rows than there are nodes in chunks. All nodes of
    a large root stand on one side of the join with roots, which has one row a root on the other, so Spark can split them.
    """
    k = list(keys)
    pairs = edges.select(*k, F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    schema = pairs.schema

    def within(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for f in frames:
            held.append(f)
            size += len(f)
            if size >= chunk:
                yield _local_roots(pd.concat(held, ignore_index=True), k)
                held, size = [], 0
        if size:
            yield _local_roots(pd.concat(held, ignore_index=True), k)

    found = pairs
    for _ in range(rounds):
        stars = checkpoint(found.mapInPandas(within, schema))
        hooked = stars.groupBy(*k, "x").agg(F.min("y").alias("p"))
        across = stars.join(hooked, [*k, "x"]).where("y <> p").select(*k, F.col("y").alias("x"), F.col("p").alias("y"), F.lit(True).alias("open"))
        roots = hooked.select(*k, F.col("x").alias("p"), F.col("p").alias("root"))
        jumped = hooked.join(roots, [*k, "p"]).select(*k, "x", F.col("root").alias("y"), (F.col("root") != F.col("p")).alias("open"))
        left = checkpoint(jumped.unionByName(across))
        if not left.where("open").limit(1).count():
            return left.select(*k, F.col("x").alias("node"), F.col("y").alias("component"))
        found = left.select(*k, "x", "y")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def reached(edges: DataFrame, start: DataFrame, rounds: int = 10_000) -> DataFrame:
    """Nodes that directed edges (src, dst) reach from ``start`` (node), itself included."""
    e = checkpoint(edges.select("src", "dst").distinct())
    seen = checkpoint(start.select("node").distinct())
    front = seen
    for _ in range(rounds):
        front = checkpoint(front.join(e, front["node"] == e["src"]).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti"))
        if not front.limit(1).count():
            return seen
        seen = checkpoint(seen.union(front))
    raise RuntimeError(f"reach did not end in {rounds} rounds")


def through(edges: DataFrame, first: DataFrame, last: DataFrame) -> DataFrame:
    """Edges on some way from ``first`` to ``last`` (node)."""
    on = reached(edges, first).intersect(reached(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), last))
    return restricted(edges, on)


def geodesics(edges: DataFrame, sources: DataFrame, width: float | None = None, rounds: int = 10_000) -> DataFrame:
    """source, node, d, pred: shortest ways over undirected edges (a, b, length); equal ones by the smaller predecessor.

    All sources at once, by buckets of distances (``width``, or eight mean lengths): what is nearer than the bucket's end is relaxed until
    nothing in it improves, is settled then, and is not written again, so rows are rewritten only while they are open.
    """
    e = edges.select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("length").cast("double").alias("length"))
    e = checkpoint(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"), "length")))
    width = width or 8 * (e.agg(F.avg("length")).first()[0] or 1.0) or 1.0
    start = sources.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("d"), F.lit(None).cast("long").alias("pred"), F.lit(True).alias("fresh"))
    left, settled, parts = checkpoint(start.distinct()), None, 0
    for _ in range(rounds):
        low = left.agg(F.min("d")).first()[0]
        if low is None:
            return settled if settled is not None else left.drop("fresh")
        limit = (low // width + 1) * width
        while True:
            front = left.where(F.col("fresh") & (F.col("d") < limit)).select("source", F.col("node").alias("u"), F.col("d").alias("du"))
            if front.isEmpty():
                break
            step = front.join(e, "u").select("source", F.col("v").alias("node"), (F.col("du") + F.col("length")).alias("d"), F.col("u").alias("pred"))
            step = step if settled is None else step.join(settled.select("source", "node"), ["source", "node"], "left_anti")
            was = left.select("source", "node", "d", "pred", F.col("d").alias("was"), (F.col("fresh") & (F.col("d") >= limit)).alias("fresh"))
            both = was.union(step.select("*", F.lit(None).cast("double").alias("was"), F.lit(False).alias("fresh")))
            least = both.groupBy("source", "node").agg(F.min(F.struct("d", "pred")).alias("m"), F.min("was").alias("was"), F.max("fresh").alias("fresh"))
            left = checkpoint(least.select("source", "node", "m.d", "m.pred", (F.col("fresh") | F.col("was").isNull() | (F.col("m.d") < F.col("was"))).alias("fresh")))
        done = left.where(F.col("d") < limit).drop("fresh")
        settled, parts = done if settled is None else settled.unionByName(done), parts + 1
        settled = checkpoint(settled) if parts % 32 == 0 else settled  # keeps plans short
        left = left.where(F.col("d") >= limit)
    raise RuntimeError(f"distances did not settle in {rounds} buckets")


def paths_to(found: DataFrame, ends: DataFrame, rounds: int = 10_000) -> DataFrame:
    """source, node, path ``ARRAY<LONG>`` along the predecessors of ``geodesics``."""
    pred = found.select("source", F.col("node").alias("head"), F.col("pred").alias("next"))
    open_ = ends.select("source", "node").withColumns({"head": F.col("node"), "path": F.array("node")})
    done = None
    for _ in range(rounds):
        met = checkpoint(open_.join(pred, ["source", "head"]))
        ended = met.where("next is null").select("source", "node", "path")
        done = ended if done is None else checkpoint(done.union(ended))
        open_ = met.where("next is not null").select("source", "node", F.col("next").alias("head"), F.concat(F.array("next"), "path").alias("path"))
        if not open_.limit(1).count():
            return done
    raise RuntimeError(f"paths did not end in {rounds} rounds")


def markov_rows(edges: DataFrame, weight: Column) -> DataFrame:
    """src, dst, p: weights of outgoing edges over their sum."""
    total = F.sum("w").over(Window.partitionBy("src"))
    return edges.withColumn("w", weight).withColumn("p", F.col("w") / total).drop("w")


def transition(d: Column, along: Column, push: Column, a: float, b: float, c: float, eps: float) -> Column:
    """exp(-a d / eps - (b along + c push) / eps^2)."""
    return F.exp(-a * d / eps - (b * along + c * push) / eps**2)


def bottlenecks(edges: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """What flows out less what flows in (edges src, dst, capacity) of each node, without edges of nodes to skip."""
    e = edges if skip is None else edges.join(skip.select(F.col("node").alias("src")), "src", "left_anti").join(skip.select(F.col("node").alias("dst")), "dst", "left_anti")
    out = e.select(F.col("src").alias("node"), F.col("capacity").alias("v"))
    into = e.select(F.col("dst").alias("node"), (-F.col("capacity")).alias("v"))
    return out.union(into).groupBy("node").agg(F.sum("v").alias("divergence"))


def _push(n: int, ends: list[tuple[int, int, int]], s: int, t: int) -> np.ndarray:
    """Flow of each edge (from, to, capacity) of a maximum s-t flow: shortest augmenting paths."""
    graph: list[list[int]] = [[] for _ in range(n)]
    to, room = [], []
    for u, v, c in ends:
        graph[u].append(len(to))
        graph[v].append(len(to) + 1)
        to += [v, u]
        room += [c, 0]
    while True:
        came = {s: -1}
        queue = deque([s])
        while queue and t not in came:
            u = queue.popleft()
            for e in graph[u]:
                if room[e] and to[e] not in came:
                    came[to[e]] = e
                    queue.append(to[e])
        if t not in came:
            return np.array(room[1::2])
        way, v = [], t
        while v != s:
            way.append(came[v])
            v = to[came[v] ^ 1]
        least = min(room[e] for e in way)
        for e in way:
            room[e] -= least
            room[e ^ 1] += least


def max_flow(edges: DataFrame, keys: Sequence[str], source: str = "source", sink: str = "sink") -> DataFrame:
    """src, dst, flow > 0 of an integer maximum flow of each graph; ``edges`` carry their graph's source and sink node."""

    def solve(data: pd.DataFrame) -> pd.DataFrame:
        s, t = data[source].iloc[0], data[sink].iloc[0]
        names = pd.unique(pd.concat([data["src"], data["dst"], pd.Series([s, t])]))
        at = {x: i for i, x in enumerate(names)}
        ends = [(at[u], at[v], int(c)) for u, v, c in zip(data["src"], data["dst"], data["capacity"], strict=True)]
        out = data[[*keys, "src", "dst"]].assign(flow=_push(len(names), ends, at[s], at[t]))
        return out[out["flow"] > 0]

    kinds = ", ".join(f"{k} {edges.schema[k].dataType.simpleString()}" for k in [*keys, "src", "dst"])
    return edges.groupBy(*keys).applyInPandas(solve, f"{kinds}, flow long")


def _circulate(n: int, ends: list[tuple[int, int, int, int]]) -> np.ndarray:
    """Flow of each edge (from, to, capacity, cost) of a cheapest circulation, by cancelling negative cycles."""
    u, v, room, cost = (np.array(x, np.int64) for x in zip(*[y for a, b, c, w in ends for y in ((a, b, c, w), (b, a, 0, -w))], strict=True))
    while True:
        dist, came = np.zeros(n, np.int64), np.full(n, -1)
        hit = -1
        for _ in range(n):
            live = np.flatnonzero((room > 0) & (dist[u] + cost < dist[v]))
            if not len(live):
                break
            order = live[np.lexsort((live, dist[u[live]] + cost[live]))][::-1]
            dist[v[order]] = dist[u[order]] + cost[order]  # the last write, with the lowest value, stays
            came[v[order]] = order
            hit = int(v[order[-1]])
        else:
            for _ in range(n):
                hit = int(u[came[hit]])
            cycle, x = [int(came[hit])], int(u[came[hit]])
            while x != hit:
                cycle.append(int(came[x]))
                x = int(u[came[x]])
            least = room[cycle].min()
            room[cycle] -= least
            room[np.array(cycle) ^ 1] += least
            continue
        return room[1::2]


def circular_flow(edges: DataFrame, wraps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, flow: the largest flow through edges (src, dst, capacity) that leaves at each top what enters at its bottom.

    ``wraps``: bottom, top pairs. A wrap edge from top to bottom at cost -1 makes it a cheapest circulation on a network
    matrix, so the optimum is integral.
    """

    def solve(key: tuple, e: pd.DataFrame, w: pd.DataFrame) -> pd.DataFrame:
        flow = 0
        if len(e) and len(w):
            names = pd.unique(pd.concat([e["src"], e["dst"], w["bottom"], w["top"]]))
            at = {x: i for i, x in enumerate(names)}
            free = int(e["capacity"].sum())
            ends = [(at[a], at[b], int(c), 0) for a, b, c in zip(e["src"], e["dst"], e["capacity"], strict=True)]
            ends += [(at[t], at[b], free, -1) for b, t in zip(w["bottom"], w["top"], strict=True)]
            flow = int(_circulate(len(names), ends)[len(e) :].sum())
        return pd.DataFrame([[*key, flow]], columns=[*keys, "flow"])

    kinds = "".join(f"{k} {edges.schema[k].dataType.simpleString()}, " for k in keys)
    return edges.groupBy(*keys).cogroup(wraps.groupBy(*keys)).applyInPandas(solve, f"{kinds}flow long")


def tunnels(edges: DataFrame, keys: Sequence[str], most: int, independent: bool = False) -> DataFrame:
    """tunnel, narrowest, volume, path: the widest ways by volume from the first to the last level, one after the other.

    Edges (level, src, dst, capacity) join neighbouring levels only, so each way is a dynamic programme over levels. The
    narrowest capacity is taken out of the way before the next one is sought, unless ``independent``, which drops it whole.
    """

    def dig(data: pd.DataFrame) -> pd.DataFrame:
        data = data.sort_values(["level", "src", "dst"])
        left = dict(zip(zip(data["src"], data["dst"], strict=True), data["capacity"].astype(int), strict=True))
        last = data["level"].max()
        rows = []
        for number in range(most):
            best: dict = {}
            for level, u, v in zip(data["level"], data["src"], data["dst"], strict=True):
                if left[u, v] <= 0 or (level > data["level"].min() and u not in best):
                    continue
                total = best.get(u, (0, None))[0] + left[u, v]
                if total > best.get(v, (0, None))[0]:
                    best[v] = total, u
            ends = [v for level, v in zip(data["level"], data["dst"], strict=True) if level == last and v in best]
            if not ends:
                break
            path = [max(sorted(set(ends)), key=lambda v: best[v][0])]
            while path[-1] in best:
                path.append(best[path[-1]][1])
            path = path[::-1]
            used = list(zip(path, path[1:], strict=False))
            narrow = min(left[e] for e in used)
            rows.append([*[data[k].iloc[0] for k in keys], number, narrow, best[path[-1]][0], path])
            for e in used:
                left[e] -= left[e] if independent else narrow
        return pd.DataFrame(rows, columns=[*keys, "tunnel", "narrowest", "volume", "path"])

    kinds = "".join(f"{k} {edges.schema[k].dataType.simpleString()}, " for k in keys)
    return edges.groupBy(*keys).applyInPandas(dig, f"{kinds}tunnel int, narrowest long, volume long, path array<long>")


def tunnel_sections(found: DataFrame, unit_area: float, radius: float) -> DataFrame:
    """How many cross-sections of a mobile atom fit side by side into each tunnel's narrowest place (rounded up)."""
    return found.withColumn("sections", F.ceil(F.col("narrowest") * unit_area / (3.141592653589793 * radius**2)))


def random_walks(rows: DataFrame, starts: DataFrame, walks: int, seed: int, stop: DataFrame, most: int = 100_000, send_rows: int = 1 << 20) -> DataFrame:
    """walk, path, ended: Markov walks from a uniform start until a node of ``stop``; each walk has a seed of its own.

    Walks that reach a node without transitions, or ``most`` nodes, are kept with ``ended`` false.

    ``rows``: src, dst, p. Up to ``send_rows`` transitions go to every task, which takes its walks 1,024 steps at a time; beyond
    that all walks take a step at a time in a join with the transition rows, so neither walks nor transitions have to fit
    into one task. Draws are hashes of seed, walk and step, so both give the same walks.
    """
    w = Window.partitionBy("src").orderBy("dst")
    spans = checkpoint(rows.withColumn("hi", F.sum("p").over(w)).withColumn("lo", F.col("hi") - F.col("p")).select("src", "dst", "lo", "hi"))
    n = starts.count()
    first = numbered(starts.select("node"), ["node"], "i")
    spark = rows.sparkSession

    def draw(step: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), "walk", step), F.lit(1 << 53)).cast("double") / float(1 << 53)

    ends = stop.select("node", F.lit(True).alias("end")).distinct()
    at = spark.range(walks).select(F.col("id").cast("int").alias("walk")).withColumn("i", F.floor(draw(F.lit(0)) * n).cast("int"))
    at = at.join(first, "i").join(ends, "node", "left").select("walk", "node", F.array("node").alias("path"), F.coalesce("end", F.lit(False)).alias("ended"), F.lit(False).alias("stuck"))
    sent = None
    if spans.count() <= send_rows:
        table, last = spans.orderBy("src", "dst").toPandas(), set(stop.join(spans.select(F.col("dst").alias("node")), "node", "left_semi").distinct().toPandas()["node"])
        sent = spark.sparkContext.broadcast(({k: (g["dst"].to_numpy(), g["lo"].to_numpy(), g["hi"].to_numpy()) for k, g in table.groupby("src")}, last))

    def walk_on(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hops, last = sent.value
        for f in frames:
            out = []
            for walk, node, path, ended, stuck, draws in zip(*(f[c] for c in ("walk", "node", "path", "ended", "stuck", "draws")), strict=True):
                path = list(path)
                for u in draws:
                    if ended or stuck:
                        break
                    dst, lo, hi = hops.get(node, (np.zeros(0, np.int64), np.zeros(0), np.zeros(0)))
                    hit = np.flatnonzero((u >= lo) & (u < hi))
                    stuck = not len(hit)
                    if not stuck:
                        node = int(dst[hit[0]])
                        path.append(node)
                        ended = node in last
                out.append((walk, node, path, ended, stuck))
            yield pd.DataFrame(out, columns=["walk", "node", "path", "ended", "stuck"])

    block = 1024 if sent else 8  # steps between checkpoints
    for begin in range(1, most, block):
        if sent:
            draws = F.transform(F.sequence(F.lit(begin), F.lit(min(begin + block, most) - 1)), lambda step: draw(step.cast("int")))
            at = at.withColumn("draws", draws).mapInPandas(walk_on, at.schema)
        else:
            for step in range(begin, min(begin + block, most)):
                moved = at.withColumn("u", draw(F.lit(step))).join(spans, ~F.col("ended") & ~F.col("stuck") & (F.col("node") == F.col("src")) & (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")), "left")
                path = F.when(F.col("dst").isNull(), F.col("path")).otherwise(F.concat("path", F.array("dst")))
                moved = moved.select("walk", F.coalesce("dst", "node").alias("node"), path.alias("path"), (~F.col("ended") & F.col("dst").isNull()).alias("stuck"))
                at = moved.join(ends, "node", "left").select("walk", "node", "path", F.coalesce("end", F.lit(False)).alias("ended"), "stuck")
        at = checkpoint(at)
        if not at.where("not ended and not stuck").limit(1).count():
            break
    return at.select("walk", "path", "ended")


def largest_component(labels: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, component, size of the largest component (of equal ones the smallest) from keys, node, component."""
    sizes = labels.groupBy(*keys, "component").agg(F.count("*").alias("size"))
    best = sizes.groupBy(*keys).agg(F.max(F.struct("size", (-F.col("component")).alias("m"))).alias("b"))
    return best.select(*keys, (-F.col("b.m")).alias("component"), F.col("b.size").alias("size"))


def restricted(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges (src, dst) both of whose nodes are kept (node)."""
    half = edges.join(kept.select(F.col("node").alias("src")), "src", "left_semi")
    return half.join(kept.select(F.col("node").alias("dst")), "dst", "left_semi").select(*edges.columns)
