"""Approximate nearest neighbours by inner product: a neighbour graph by NN-descent, searched greedily.

Equal vectors are one node. Random median splits of a bounded sample deal the nodes into leaves of a bounded size, several
times over; the best of a leaf are a node's first links. In a round of NN-descent every link (x, y) is joined with y's
row, both ends are told of each other, and each node compares its neighbours of both directions, where one of two links is
new, by a matrix product; what beats an end's worst link goes there and is merged. A node that very many link to is dealt
into parts, each of which meets all the node's own links. Rounds end when few links change.

A search keeps a beam for each query. It starts at the query's own node and at the best of a bounded set of entries. In a
round all nodes of the beam that were not opened yet are joined with their neighbours' codes, and what is better than the
beam's worst enters, until nothing is left to open. The best of the beam are scored again on the original vectors.

Links and beams use codes of 8 bits a component, over vectors that are lengthened by one component to a common length (the
99th percentile of lengths; longer ones stay as they are), so a graph of near directions serves inner products. Scores in
the result are sums of products of doubles.

Null vectors, vectors that are zero or hold null or non-finite components and rows without an id take no part. Vectors meet only those of their
own size. Rows with equal vectors share a node that holds the ``k + 1`` smallest ids, which is all that a result can
need. Repeated ids are rows of their own: a query meets every row but itself. Ties go to the smaller id. A query has fewer
than ``k`` results only where there are fewer candidates. Vectors of any size are compared whole, an empty table gives an
empty table, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint


@dataclass(frozen=True)
class Settings:
    """``links`` neighbours a node; ``trees`` times leaves of about ``leaf_rows``; rounds end when fewer than ``settled`` of the
    links are new. ``beam`` nodes a query, of which ``rescored`` are scored on original vectors. ``shard_rows`` nodes meet in a
    task's group, ``part_rows`` links of others in a part of a node, compared ``block`` at a time. ``sample_rows`` rows fit the
    splits, ``entries`` rows (the longest and a sample) are sent to every task; frontiers of up to ``broadcast_bytes`` are
    broadcast, larger ones shuffled."""

    k: int = 20
    links: int = 24
    trees: int = 3
    leaf_rows: int = 256
    rounds: int = 12
    settled: float = 0.2
    beam: int = 256
    rescored: int = 64
    shard_rows: int = 1024
    part_rows: int = 2048
    block: int = 48
    sample_rows: int = 20_000
    entries: int = 512
    starts: int = 8
    wave_rows: int = 20_000
    broadcast_bytes: int = 32 << 20


LINK = "array<struct<y: long, s: double, new: boolean>>"
NODE = f"node long, size int, code binary, scale double, links {LINK}"


def _matrix(column: pa.ChunkedArray | pa.Array, kind: str) -> np.ndarray:
    """Rows of equally long binaries as a matrix."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], pa.binary())
    return np.frombuffer(b"".join(array.to_pylist()), kind).reshape(len(array), -1)


def _by_size(frame: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame]]:
    return ((int(size), g) for size, g in frame.groupby("size"))


def _best(x: np.ndarray, y: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best different y of each x, in order."""
    order = np.lexsort((y, x))
    order = order[np.r_[True, (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])]] if len(order) else order
    order = order[np.lexsort((y[order], -s[order], x[order]))]
    first = np.r_[True, x[order][1:] != x[order][:-1]] if len(order) else np.zeros(0, bool)
    begin = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0)) if len(order) else order
    return order[np.arange(len(order)) - begin < k]


class Splits:
    """Median splits along random differences of a sample's rows: nested (direction, value, left, right), numbers for leaves."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int):
        self.rng, self.n = np.random.default_rng(seed), 0
        self.tree = self._split(sample.astype(np.float32), leaves)

    def _split(self, rows: np.ndarray, leaves: int) -> tuple | int:
        if leaves > 1 and len(rows) > 8:
            a, b = self.rng.choice(len(rows), 2, replace=False)
            way = rows[a] - rows[b]
            at = rows @ way
            value = float(np.median(at))
            left = at <= value
            if 0 < left.sum() < len(rows):
                return way, value, self._split(rows[left], leaves // 2), self._split(rows[~left], leaves - leaves // 2)
        self.n += 1
        return self.n - 1

    def of(self, rows: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(rows), np.int32), [(self.tree, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            if isinstance(node, int):
                out[at] = node
            else:
                way, value, left, right = node
                low = rows[at].astype(np.float32) @ way <= value
                todo += [(left, at[low]), (right, at[~low])]
        return out


def _rows(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, row, size, blob: usable vectors as packed doubles."""
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where("vec_id is not null and v is not null").where(~odd & F.exists("v", lambda x: x != 0))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:  # + 0.0 makes one zero of both
            yield pd.DataFrame({"vec_id": b["vec_id"], "size": b["v"].map(len).astype("int32"), "blob": [(np.asarray(v, "<f8") + 0.0).tobytes() for v in b["v"]]})

    return rows.mapInPandas(pack, "vec_id long, size int, blob binary").withColumn("row", F.monotonically_increasing_id())


def _nodes(rows: DataFrame, k: int) -> DataFrame:
    """node, size, blob, ids: each different vector with its ``k + 1`` smallest ids."""
    w = Window.partitionBy("blob").orderBy("vec_id", "row")
    few = rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k + 1)  # limited before the shuffle too
    grouped = few.groupBy("blob").agg(F.first("size").alias("size"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return grouped.withColumn("node", F.monotonically_increasing_id())


def _coded(nodes: DataFrame) -> DataFrame:
    """node, size, code, scale: vectors lengthened to a common length, as whole numbers of 8 bits and what one is worth."""

    def norms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for size, g in _by_size(b):
                yield pd.DataFrame({"size": size, "norm": np.linalg.norm(np.frombuffer(b"".join(g["blob"]), "<f8").reshape(len(g), -1), axis=1)}).astype({"size": "int32"})

    lengths = nodes.select("size", "blob").mapInPandas(norms, "size int, norm double")
    common = {r["size"]: r["m"] for r in lengths.groupBy("size").agg(F.percentile_approx("norm", 0.99, 1000).alias("m")).collect()}

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for size, g in _by_size(b):
                v = np.frombuffer(b"".join(g["blob"]), "<f8").reshape(len(g), -1)
                long = np.linalg.norm(v, axis=1) / common[size]
                v = np.column_stack([v / common[size], np.sqrt(np.maximum(1.0 - long * long, 0.0))])
                scale = np.abs(v).max(axis=1) / 127
                q = np.rint(v / scale[:, None]).astype(np.int8)
                yield pd.DataFrame({"node": g["node"], "size": g["size"], "code": [x.tobytes() for x in q], "scale": scale})

    return nodes.mapInPandas(code, "node long, size int, code binary, scale double")


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of codes; doubles where sums may pass 2^24."""
    kind = np.float32 if a.shape[1] <= 1024 else np.float64
    return a.astype(kind) @ b.astype(kind).T


def _start(coded: DataFrame, settings: Settings) -> DataFrame:
    """x, y, s: the best of each node's leaves."""
    spark = coded.sparkSession
    sizes = {r["size"]: r["n"] for r in coded.groupBy("size").agg(F.count("*").alias("n")).collect()}
    sample = coded.orderBy(F.xxhash64("node")).select("size", "code").limit(settings.sample_rows).toPandas()
    fitted = {}
    for size, n in sizes.items():
        rows = np.frombuffer(b"".join(sample.loc[sample["size"] == size, "code"]), np.int8).reshape(-1, size + 1)
        fitted[size] = [Splits(rows, -(-n // settings.leaf_rows), seed) for seed in range(settings.trees)]
    splits = spark.sparkContext.broadcast(fitted)  # at most sample_rows / 4 directions a tree

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for size, g in _by_size(b):
                v = np.frombuffer(b"".join(g["code"]), np.int8).reshape(len(g), -1)
                for tree, fit in enumerate(splits.value[size]):
                    yield g[["node", "size", "code", "scale"]].assign(tree=np.int32(tree), leaf=fit.of(v))

    placed = coded.mapInPandas(place, "node long, size int, code binary, scale double, tree int, leaf int")
    many = placed.groupBy("size", "tree", "leaf").agg(F.ceil(F.count("*") / settings.leaf_rows).alias("subs"))
    dealt = placed.join(many, ["size", "tree", "leaf"]).withColumn("sub", F.pmod(F.xxhash64("node", "tree"), F.col("subs")))

    def within(key: tuple, t: pa.Table) -> pa.Table:
        ids, v, scale = t["node"].to_numpy(), _matrix(t["code"], np.int8), t["scale"].to_numpy()
        keep, out = min(settings.links, len(ids) - 1), []
        for at in range(0, len(ids) if keep else 0, 256):
            s = _products(v[at : at + 256], v).astype(float) * scale[at : at + 256, None] * scale
            s[np.arange(len(s)), at + np.arange(len(s))] = -np.inf
            top = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
            out.append((np.repeat(ids[at : at + 256], keep), ids[top].ravel(), np.take_along_axis(s, top, 1).ravel()))
        x, y, s = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"x": x, "y": y, "s": s})

    return dealt.groupBy("size", "tree", "leaf", "sub").applyInArrow(within, "x long, y long, s double")


def _merge(graph: DataFrame, found: DataFrame, shards: int, links: int) -> DataFrame:
    """Each node's best links of those that it has, old from now on, and of what was found (x, y, s)."""

    def run(key: tuple, nodes: pa.Table, more: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("node")
        ids, lists = nodes["node"].to_numpy(), nodes["links"]
        sizes, flat = pc.list_value_length(lists).to_numpy(), pc.list_flatten(lists)
        parts = {c: pc.struct_field(flat, c).to_numpy() for c in ("y", "s")}
        x = np.concatenate([np.repeat(ids, sizes), more["x"].to_numpy()]).astype(np.int64)
        y = np.concatenate([parts["y"], more["y"].to_numpy()]).astype(np.int64)
        s = np.concatenate([parts["s"], more["s"].to_numpy()])
        new = np.r_[np.zeros(int(sizes.sum()), bool), np.ones(len(more), bool)]
        top = _best(x, y, s, links)  # of equal pairs the first counts, so a link that is there stays old
        at = np.searchsorted(ids, x[top])
        ends = np.searchsorted(at, np.arange(len(ids) + 1)).astype(np.int32)
        made = pa.StructArray.from_arrays([pa.array(y[top]), pa.array(s[top]), pa.array(new[top])], ["y", "s", "new"])
        return nodes.select(["node", "size", "code", "scale"]).append_column("links", pa.ListArray.from_arrays(pa.array(ends), made))

    shard = lambda c: F.pmod(F.xxhash64(c), F.lit(shards)).cast("int").alias("shard")
    left = graph.withColumn("shard", shard("node")).groupBy("shard")
    right = found.withColumn("shard", shard("x")).groupBy("shard")
    return checkpoint(left.cogroup(right).applyInArrow(run, NODE))


def _neighbours(graph: DataFrame, settings: Settings) -> DataFrame:
    """to, part, id, code, scale, least, new, own: every link seen from both of its ends. ``own`` is a link of the node itself,
    ``least`` what a score with ``id`` has to beat there."""
    hubs = graph.select(F.explode("links.y").alias("node")).groupBy("node").agg(F.ceil(F.count("*") / settings.part_rows).cast("int").alias("parts")).where("parts > 1")
    worst = F.when(F.size("links") >= settings.links, F.element_at("links", -1)["s"]).otherwise(float("-inf"))
    rows = graph.join(hubs, "node", "left").select("node", "code", "scale", worst.alias("least"), F.coalesce("parts", F.lit(1)).alias("parts"), "links")
    ends = rows.select(*[F.col(c).alias(f"x_{c}") for c in ("node", "code", "scale", "least", "parts")], F.explode("links").alias("link"))
    ends = ends.select("*", F.col("link.y").alias("y_node"), F.col("link.new").alias("new")).drop("link")
    met = ends.join(rows.select(*[F.col(c).alias(f"y_{c}") for c in ("node", "code", "scale", "least", "parts")]), "y_node")

    def told(of: str, to: str, part: Column, own: bool) -> Column:
        return F.struct(F.col(f"{to}_node").alias("to"), part.cast("int").alias("part"), F.col(f"{of}_node").alias("id"), F.col(f"{of}_code").alias("code"), F.col(f"{of}_scale").alias("scale"), F.col(f"{of}_least").alias("least"), "new", F.lit(own).alias("own"))

    back = told("x", "y", F.pmod(F.xxhash64("x_node"), F.col("y_parts")), False)
    forth = F.transform(F.sequence(F.lit(0), F.col("x_parts") - 1), lambda p: told("y", "x", p, True))
    return met.select(F.explode(F.concat(F.array(back), forth)).alias("m")).select("m.*", F.octet_length("m.code").alias("size"))


def _groups(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the own links and of the others' links of each (to, part)."""
    to, part, own = t["to"].to_numpy(), t["part"].to_numpy(), t["own"].to_numpy(zero_copy_only=False)
    order = np.lexsort((~own, part, to))
    cut = np.flatnonzero((to[order][1:] != to[order][:-1]) | (part[order][1:] != part[order][:-1])) + 1
    for at in np.split(order, cut) if len(order) else ():
        n = int(own[at].sum())
        yield at[:n], at[n:]


def _descend(graph: DataFrame, settings: Settings, shards: int) -> DataFrame:
    """x, y, s: better links among the neighbours of each node."""

    def compare(key: tuple, t: pa.Table) -> pa.Table:
        ids, least, new = (t[c].to_numpy(zero_copy_only=False) for c in ("id", "least", "new"))
        v = _matrix(t["code"], np.int8).astype(np.float32) * t["scale"].to_numpy().astype(np.float32)[:, None]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for own, others in _groups(t):
            for a in range(0, max(1, len(others)), settings.block):
                at = np.r_[own, others[a : a + settings.block]]
                fresh, name = new[at], ids[at]
                if len(at) < 2 or not fresh.any():
                    continue
                rows = v[at]
                s = rows @ rows.T
                i, j = np.nonzero((s > least[at][:, None]) & (fresh[:, None] | fresh) & (name[:, None] != name))
                found.append((name[i], name[j], s[i, j]))
        x, y, s = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        top = _best(x, y, s, settings.links)
        return pa.table({"x": x[top], "y": y[top], "s": s[top].astype(float)})

    dealt = _neighbours(graph, settings).withColumn("shard", F.pmod(F.xxhash64("to", "part"), F.lit(shards)).cast("int"))
    return dealt.groupBy("size", "shard").applyInArrow(compare, "x long, y long, s double")


def neighbour_graph(coded: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """node, size, code, scale, links (best first) of coded nodes."""
    n = coded.count()
    shards = max(1, -(-n // settings.shard_rows))
    empty = coded.withColumn("links", F.array().cast(LINK))
    graph = _merge(empty, _start(coded, settings), shards, settings.links)
    for _ in range(settings.rounds):
        graph = _merge(graph, _descend(graph, settings, shards), shards, settings.links)
        new, all_ = graph.select(F.coalesce(F.sum(F.size(F.filter("links", lambda x: x["new"]))), F.lit(0)), F.coalesce(F.sum(F.size("links")), F.lit(0))).first()
        if new <= settings.settled * all_:
            break
    return graph


def _opened(graph: DataFrame, settings: Settings, shards: int) -> DataFrame:
    """node, part, ids, codes, scales: each node's neighbours of both directions, packed."""

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        to, part, ids, scale, codes = t["to"].to_numpy(), t["part"].to_numpy(), t["id"].to_numpy(), t["scale"].to_numpy(), t["code"].combine_chunks().to_pylist()
        rows: list[tuple] = []
        for own, others in _groups(t):
            at = np.r_[own, others]
            at = at[np.unique(ids[at], return_index=True)[1]]
            rows.append((int(to[at[0]]), int(part[at[0]]), ids[at].astype("<i8").tobytes(), b"".join([codes[i] for i in at]), scale[at].astype("<f8").tobytes()))
        names = ["node", "part", "ids", "codes", "scales"]
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table({c: pa.array([r[i] for r in rows], kind) for i, (c, kind) in enumerate(zip(names, kinds, strict=True))})

    dealt = _neighbours(graph, settings).withColumn("shard", F.pmod(F.xxhash64("to", "part"), F.lit(shards)).cast("int"))
    return checkpoint(dealt.groupBy("size", "shard").applyInArrow(pack, "node long, part int, ids binary, codes binary, scales binary"))


def _entries(asked: DataFrame, coded: DataFrame, settings: Settings) -> DataFrame:
    """q, node, s: each asking node itself, and the best of a bounded set of nodes."""
    sample = coded.orderBy(F.xxhash64("node")).limit(settings.entries)
    longest = coded.orderBy(F.desc("scale"), "node").limit(settings.entries // 8)
    table = sample.union(longest).distinct().toPandas()
    sent = coded.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for size, g in _by_size(b):
                e = sent.value[sent.value["size"] == size]
                v = _query_codes(g["code"])
                own = (v.astype(float) ** 2).sum(axis=1) * g["scale"].to_numpy() ** 2
                yield pd.DataFrame({"q": g["node"], "node": g["node"], "s": own})
                if len(e):
                    w = np.frombuffer(b"".join(e["code"]), np.int8).reshape(len(e), -1)
                    s = _products(v, w).astype(float) * g["scale"].to_numpy()[:, None] * e["scale"].to_numpy()
                    keep = min(settings.starts, len(e))
                    top = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
                    yield pd.DataFrame({"q": np.repeat(g["node"].to_numpy(), keep), "node": e["node"].to_numpy()[top].ravel(), "s": np.take_along_axis(s, top, 1).ravel()})

    return asked.mapInPandas(run, "q long, node long, s double")


def _query_codes(codes: pd.Series | list[bytes]) -> np.ndarray:
    """Codes without what lengthens them: a query's last component is zero, so that products are inner products."""
    v = np.frombuffer(b"".join(codes), np.int8).reshape(len(codes), -1).copy()
    v[:, -1] = 0
    return v


def _search(graph: DataFrame, coded: DataFrame, asked: DataFrame, settings: Settings, shards: int) -> DataFrame:
    """q, node, s: the beam of each asking node (node, size, code, scale) when all of it is opened."""
    opened = _opened(graph, settings, shards)
    asked = checkpoint(asked)
    n = asked.count()
    waves = n // settings.wave_rows + 1
    beam = _entries(asked, coded, settings).withColumn("done", F.lit(False))

    def best(rows: DataFrame) -> DataFrame:
        merged = rows.groupBy("q", "node").agg(F.max("s").alias("s"), F.max("done").alias("done"))
        ranked = merged.withColumn("__r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "node")))
        return checkpoint(ranked.where(F.col("__r") <= settings.beam).drop("__r"))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for ids, codes, scales, queries in zip(*(b.column(c).to_pylist() for c in ("ids", "codes", "scales", "queries")), strict=True):
                node = np.frombuffer(ids, "<i8")
                v, w = np.frombuffer(codes, np.int8).reshape(len(node), -1), np.frombuffer(scales, "<f8")
                for at in range(0, len(queries), 512):
                    part = queries[at : at + 512]
                    q = np.array([x["q"] for x in part])
                    s = _products(_query_codes([x["code"] for x in part]), v).astype(float) * np.array([x["scale"] for x in part])[:, None] * w
                    i, j = np.nonzero(s > np.array([x["least"] for x in part])[:, None])
                    found.append((q[i], node[j], s[i, j]))
            if found:
                q, node, s = (np.concatenate(c) for c in zip(*found, strict=True))
                top = _best(q, node, s, settings.beam)
                q, node, s = q[top], node[top], s[top]
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(node), pa.array(s)], ["q", "node", "s"])

    beam = best(beam)
    while True:
        limits = beam.groupBy("q").agg(F.count("*").alias("n"), F.min("s").alias("s")).select("q", F.when(F.col("n") >= settings.beam, F.col("s")).otherwise(float("-inf")).alias("least"))
        front = beam.where(~F.col("done")).select("q", "node").join(limits, "q").join(asked.select(F.col("node").alias("q"), "code", "scale"), "q")
        wave = F.pmod(F.xxhash64("q"), F.lit(waves))
        front = checkpoint(front.groupBy("node", wave.alias("wave")).agg(F.collect_list(F.struct("q", "code", "scale", "least")).alias("queries")))
        rows, most = front.select(F.coalesce(F.sum(F.size("queries")), F.lit(0)), F.coalesce(F.max(F.size("queries")), F.lit(0))).first()
        if not rows:
            return beam.select("q", "node", "s")
        width = 96 + max((r["size"] for r in asked.select("size").distinct().collect()), default=0)
        side = F.broadcast(front) if rows * width <= settings.broadcast_bytes else front
        found = opened.join(side, "node").select("ids", "codes", "scales", "queries").mapInArrow(expand, "q long, node long, s double")
        beam = best(beam.withColumn("done", F.lit(True)).unionByName(found.withColumn("done", F.lit(False))))


def nearest(vectors: DataFrame, is_query: Column, settings: Settings = Settings(), vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found for each query. ``is_query`` is a condition on ``vec_id``."""
    rows = checkpoint(_rows(vectors, vec_id, embedding))
    nodes = checkpoint(_nodes(rows, settings.k))
    coded = checkpoint(_coded(nodes))
    graph = neighbour_graph(coded, settings)
    shards = max(1, -(-coded.count() // settings.shard_rows))
    queries = checkpoint(rows.where(is_query).select("blob", "vec_id", "row").join(nodes.select("blob", "node"), "blob").select("vec_id", "row", "node"))
    asked = coded.join(queries.select("node").distinct(), "node", "left_semi")
    beam = _search(graph, coded, asked, settings, shards)
    few = beam.withColumn("__r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "node"))).where(F.col("__r") <= settings.rescored)
    named = few.select("q", "node").join(nodes.select("node", F.col("blob").alias("b"), "ids"), "node").join(nodes.select(F.col("node").alias("q"), F.col("blob").alias("a")), "q")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            a, b = t.column("a").to_pylist(), t.column("b").to_pylist()
            s = pa.array([float(np.frombuffer(x, "<f8") @ np.frombuffer(y, "<f8")) for x, y in zip(a, b, strict=True)], pa.float64())
            yield pa.RecordBatch.from_arrays([t.column("q"), t.column("node"), s, t.column("ids")], ["q", "node", "score", "ids"])

    scored = named.select("q", "node", "a", "b", "ids").mapInArrow(exact, "q long, node long, score double, ids array<long>")
    flat = scored.select("q", "score", (F.col("node") == F.col("q")).alias("mine"), F.explode("ids").alias("vec_id"))
    first = flat.withColumn("__r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("__r") <= settings.k + 1)
    lists = checkpoint(first.groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("m"), "vec_id", "mine"))).alias("best")))
    # a query's own row is one of its node's; where it does not stand among the first k + 1, nothing has to go
    met = queries.join(lists, queries["node"] == lists["q"]).select("row", F.col("vec_id").alias("query_id"), F.col("best"))
    own = F.array_position(F.transform("best", lambda x: x["mine"] & (x["vec_id"] == F.col("query_id"))), True)
    left = F.when(own > 0, F.filter("best", lambda x, i: i != own - 1)).otherwise(F.col("best"))
    out = met.select("query_id", F.posexplode(F.slice(left, 1, settings.k)).alias("at", "found"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("found.vec_id").alias("vec_id"), (-F.col("found.m")).alias("score"))
