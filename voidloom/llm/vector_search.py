"""Exact top-k by integer inner product, with a KD-tree in every shard.

Components become ``floor(scale * x)``, the score is the inner product of two such vectors, ties go to the smaller id.
Median splits of a bounded sample on the widest dimension deal the vectors into cells, and cells of many rows (as of one
repeated vector) by hash into shards of a bounded size. Every cell has a tight bounding box of all its rows, and each
shard a KD-tree of its own: median splits, tight boxes and the smallest id below each node. First each query is searched
in one shard of the cell with the best bound, which gives it a kth score. Then it visits only the other shards whose
cell's box can hold a score as high, where a best-first traversal opens nodes by their box-to-query bound and stops below
the kth score. Queries of a shard are dealt into waves, so a task holds one shard and one wave.

Null vectors and vectors with null or non-finite components take no part; an empty vector scores 0. Vectors meet only
vectors of their own length. Rows are told apart by a number of their own: repeated ids are rows, each asks and answers
for itself, and a query meets every row but itself. Sums beyond 2^53 are worked out in exact integers and held within 64
bits. Vectors of any length are compared whole, an empty table gives an empty table, other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint


@dataclass(frozen=True)
class Settings:
    """``shard_rows`` bounds the rows of a tree and ``wave_rows`` the queries that meet it in one task (both on average,
    dealt by hash); ``sample_rows`` vectors (the smallest hashes) give the cells' splits; the cells' boxes, which every task
    of queries gets, take ``box_bytes`` at most."""

    k: int = 10
    scale: int = 1024
    shard_rows: int = 20_000
    wave_rows: int = 20_000
    block_rows: int = 256
    leaf_rows: int = 128
    sample_rows: int = 20_000
    box_bytes: int = 32 << 20


class KdTree:
    """Rows in leaf order, nodes as arrays: boxes ``low``/``high``, smallest id, row range, children (0: leaf)."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, leaf_rows: int):
        order = np.argsort(ids, kind="stable")
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.least: list[int] = []
        self.span: list[tuple[int, int]] = []
        self.child: list[tuple[int, int]] = []
        leaves: list[np.ndarray] = []
        self._begin = 0
        self._build(order, ids, vectors, leaf_rows, leaves)
        at = np.concatenate(leaves) if leaves else order
        self.ids, self.rows, self.vectors = ids[at], rows[at], vectors[at]
        self.low_all, self.high_all = np.array(self.low), np.array(self.high)

    def _build(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, leaf_rows: int, leaves: list[np.ndarray]) -> int:
        here = len(self.span)
        box = vectors[rows]
        low, high = box.min(axis=0), box.max(axis=0)
        self.low.append(low)
        self.high.append(high)
        self.least.append(int(ids[rows].min()))
        self.span.append((self._begin, self._begin + len(rows)))
        self.child.append((0, 0))
        if len(rows) <= leaf_rows:
            leaves.append(rows)
            self._begin += len(rows)
            return here
        wide = int(np.argmax(high - low)) if low.size else 0
        # a stable order keeps equal values by id, so a large group of equal vectors is split by id
        order = rows[np.argsort(box[:, wide], kind="stable")] if low.size else rows
        half = len(order) // 2
        begin = self._begin
        left = self._build(order[:half], ids, vectors, leaf_rows, leaves)
        right = self._build(order[half:], ids, vectors, leaf_rows, leaves)
        self.span[here] = (begin, self._begin)
        self.child[here] = (left, right)
        return here

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Highest score that any point of each node's box can have, for each query: nodes x queries."""
        return self.high_all @ np.maximum(queries, 0).T + self.low_all @ np.minimum(queries, 0).T

    def search(self, own: int, query: np.ndarray, bounds: np.ndarray, k: int, kth: int | None) -> list[tuple[int, int]]:
        """At most ``k`` (score, id), best first; the row ``own`` and rows below the score ``kth`` are not wanted."""
        best: list[tuple[int, int]] = []  # a heap of (score, -id): its top is the worst kept
        queue = [(-bounds[0], self.least[0], 0)]
        while queue:
            bound, least, node = heapq.heappop(queue)
            bound = -bound
            if kth is not None and bound < kth or len(best) == k and (bound, -least) < best[0]:
                if len(best) == k and bound < best[0][0] or kth is not None and bound < kth:
                    break  # no node in the queue has a higher bound
                continue
            left, right = self.child[node]
            if left:
                for x in (left, right):
                    heapq.heappush(queue, (-bounds[x], self.least[x], x))
                continue
            a, b = self.span[node]
            scores = self.vectors[a:b] @ query
            floor = best[0][0] if len(best) == k else kth
            hits = np.flatnonzero(scores >= floor) if floor is not None else np.arange(b - a)
            for i in hits:
                x = (int(scores[i]), -int(self.ids[a + i]))
                if self.rows[a + i] == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, x)
                elif x > best[0]:
                    heapq.heapreplace(best, x)
        return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1]))


def _matrices(*blobs: pd.Series) -> list[np.ndarray]:
    """Rows of integers: as doubles where all sums between them are exact, else all as exact Python integers."""
    made = [np.frombuffer(b"".join(b), "<f8").reshape(len(b), -1) for b in blobs]
    most = max((float(np.abs(m).max(initial=0.0)) for m in made), default=0.0)
    if most * most * max(m.shape[1] for m in made) < 2**53:
        return made
    out = []
    for m in made:
        exact = np.empty(m.shape, object)
        exact[:] = [[int(x) for x in r] for r in m]
        out.append(exact)
    return out


class Cells:
    """Median splits of a sample into cells, as nested (dimension, value, left, right) with cell numbers for leaves."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.n = 0
        self.tree = self._split(sample, cells)

    def _split(self, rows: np.ndarray, cells: int) -> tuple | int:
        wide = rows.max(axis=0) - rows.min(axis=0) if len(rows) and rows.shape[1] else np.zeros(0)
        if cells > 1 and wide.size and wide.max() > 0:
            d = int(np.argmax(wide))
            value = float(np.median(rows[:, d]))
            left = rows[:, d] <= value
            if left.all():  # more than half of the sample has the highest value
                value = float(rows[rows[:, d] < value, d].max())
                left = rows[:, d] <= value
            return d, value, self._split(rows[left], cells // 2), self._split(rows[~left], cells - cells // 2)
        self.n += 1
        return self.n - 1

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        out = np.zeros(len(vectors), np.int32)
        todo = [(self.tree, np.arange(len(vectors)))]
        while todo:
            node, at = todo.pop()
            if isinstance(node, int):
                out[at] = node
            else:
                d, value, left, right = node
                low = vectors[at, d] <= value
                todo += [(left, at[low]), (right, at[~low])]
        return out


def _prepare(vectors: DataFrame, settings: Settings, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, size, blob: the floored components as packed doubles."""
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            blobs = [np.floor(settings.scale * np.asarray(v, "<f8")).tobytes() for v in b["v"]]
            yield pd.DataFrame({"vec_id": b["vec_id"], "size": b["v"].map(len), "blob": blobs})

    return rows.mapInPandas(pack, "vec_id long, size int, blob binary")


def _boxes(placed: DataFrame) -> DataFrame:
    """size, cell, n, low, high: rows and bounding box of each cell; each task sends a row a cell at most."""

    def partly(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], list] = {}
        for f in frames:
            for (size, cell), g in f.groupby(["size", "cell"]):
                (v,) = _raw(g["blob"])
                box = held.setdefault((size, cell), [0, v[0], v[0]])
                held[size, cell] = [box[0] + len(g), np.minimum(box[1], v.min(axis=0)), np.maximum(box[2], v.max(axis=0))]
        yield pd.DataFrame([(s, c, n, a.tobytes(), b.tobytes()) for (s, c), (n, a, b) in held.items()], columns=["size", "cell", "n", "low", "high"])

    def whole(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        low, high = (_raw(g[c])[0] for c in ("low", "high"))
        return pd.DataFrame([(*key, int(g["n"].sum()), low.min(axis=0).tobytes(), high.max(axis=0).tobytes())], columns=["size", "cell", "n", "low", "high"])

    schema = "size int, cell int, n long, low binary, high binary"
    return placed.select("size", "cell", "blob").mapInPandas(partly, schema).groupBy("size", "cell").applyInPandas(whole, schema)


def _raw(*blobs: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(b), "<f8").reshape(len(b), -1) for b in blobs]


def top_k(vectors: DataFrame, is_query: Column, settings: Settings = Settings(), vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` best other rows. ``is_query`` is a condition on ``vec_id``."""
    packed = checkpoint(_prepare(vectors, settings, vec_id, embedding).withColumn("row", F.monotonically_increasing_id()))
    spark = vectors.sparkSession

    # cells of each length, from a bounded sample
    sizes = {r["size"]: r["n"] for r in packed.groupBy("size").agg(F.count("*").alias("n")).collect()}
    sample = packed.orderBy(F.xxhash64("row")).select("size", "blob").limit(settings.sample_rows).toPandas()
    cells = {}
    for size, n in sizes.items():
        most = max(1, settings.box_bytes // (16 * max(1, size) * len(sizes)))
        cells[size] = Cells(_raw(sample.loc[sample["size"] == size, "blob"])[0].reshape(-1, size), int(min(most, -(-n // settings.shard_rows))))
    dealt = spark.sparkContext.broadcast(cells)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for size, g in f.groupby("size"):
                yield g.assign(cell=dealt.value[size].of(_raw(g["blob"])[0].reshape(len(g), size)))

    placed = packed.mapInPandas(place, "vec_id long, size int, blob binary, row long, cell int")
    boxes = checkpoint(_boxes(placed).withColumn("shards", F.ceil(F.col("n") / settings.shard_rows).cast("int")))
    shard = F.pmod(F.xxhash64("row"), F.col("shards")).cast("int").alias("shard")
    data = placed.join(F.broadcast(boxes.select("size", "cell", "shards")), ["size", "cell"]).select("vec_id", "row", "size", "blob", "cell", shard)
    data = checkpoint(data)  # boxes take box_bytes at most
    found_boxes = spark.sparkContext.broadcast(boxes.toPandas())

    def aim(first: bool):
        """Queries (with kth, where they have one) to the best shard of each, or to all others whose cell's box can hold the kth score."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for size, g in f.groupby("size"):
                    box = found_boxes.value[found_boxes.value["size"] == size]
                    low, high, q = _matrices(box["low"], box["high"], g["blob"])
                    shards, cell = box["shards"].to_numpy(), box["cell"].to_numpy()
                    for at in range(0, len(g), 256):
                        part, v = g.iloc[at : at + 256], q[at : at + 256]
                        bounds = np.maximum(v, 0) @ high.T + np.minimum(v, 0) @ low.T
                        best = np.argmax(bounds.astype(float), axis=1)
                        home = part["row"].to_numpy() % shards[best]
                        if first:
                            yield part.assign(cell=cell[best], shard=home.astype(np.int32))
                            continue
                        kth = part["kth"].to_numpy(dtype=float, na_value=-np.inf)
                        kth = kth - np.abs(kth) * 1e-15  # doubles of 64-bit scores may be off by their last bit
                        query, to = np.nonzero(bounds.astype(float) >= kth[:, None])
                        query, to = np.repeat(query, shards[to]), np.repeat(to, shards[to])
                        number = np.concatenate([np.arange(n) for n in shards[to[np.r_[True, (query[1:] != query[:-1]) | (to[1:] != to[:-1])]]]]) if len(to) else to
                        other = (to != best[query]) | (number != home[query])
                        query, to, number = query[other], to[other], number[other]
                        yield part.iloc[query].assign(cell=cell[to], shard=number.astype(np.int32))

        return run

    asked = packed.where(is_query)
    kind = "vec_id long, row long, size int, blob binary, kth long, cell int, shard int"

    def search(key: tuple, data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int, int]] = []
        if len(data) and len(asked):
            points, queries = _matrices(data["blob"], asked["q_blob"])
            tree = KdTree(data["vec_id"].to_numpy(), data["row"].to_numpy(), points, settings.leaf_rows)
            for at in range(0, len(asked), settings.block_rows):
                part, q = asked.iloc[at : at + settings.block_rows], queries[at : at + settings.block_rows]
                bounds = tree.bounds(q)
                for i, (query_id, row, kth) in enumerate(zip(part["q_vec_id"], part["q_row"], part["q_kth"], strict=True)):
                    found = tree.search(int(row), q[i], bounds[:, i], settings.k, None if pd.isna(kth) else int(kth))
                    out += [(int(row), int(query_id), v, max(-(2**63), min(2**63 - 1, s))) for s, v in found]
        return pd.DataFrame(out, columns=["query_row", "query_id", "vec_id", "score"]).astype("int64")

    def visit(queries: DataFrame, first: bool) -> DataFrame:
        aimed = queries.mapInPandas(aim(first), kind)
        n = asked_rows // settings.wave_rows + 1  # waves of a shard that every query visits
        aimed = aimed.withColumn("wave", F.pmod(F.xxhash64(F.lit("wave"), "row"), F.lit(n)).cast("int"))
        keys = ["size", "cell", "shard", "wave"]
        right = aimed.select(*[F.col(c).alias(f"q_{c}") for c in aimed.columns]).groupBy(*[f"q_{k}" for k in keys])
        left = data.withColumn("wave", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) if n > 1 else data.withColumn("wave", F.lit(0))
        return left.groupBy(*keys).cogroup(right).applyInPandas(search, "query_row long, query_id long, vec_id long, score long")

    asked_rows = asked.count()
    first = checkpoint(visit(asked.select("vec_id", "row", "size", "blob", F.lit(None).cast("long").alias("kth")), True))
    kth = first.groupBy(F.col("query_row").alias("row")).agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") >= settings.k)
    bound = asked.join(kth.select("row", "kth"), "row", "left").select("vec_id", "row", "size", "blob", "kth")
    found = first.union(visit(bound, False))
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= settings.k)
    return ranked.select("query_id", "rank", "vec_id", "score")
