"""Near-duplicate documents by HyperMinHash sketches, banding and exact verification.

A document's set holds its distinct ``k``-word shingles (with fewer words the whole sequence as one; without words none).
Equal sets form a class, of which one document stands for all. Each class gets ``bands * rows`` registers: the smallest
of an independent hash of all shingles, stored as 6 bits of leading zeros and 10 bits of mantissa. Classes that agree in
all registers of a band meet in a bucket; with 48 bands of 5 a pair at similarity 0.8 fails to meet with a chance of 5e-9.

Buckets are not expanded into pairs. Turn by turn every bucket draws a pivot, the first of its classes in an order that
all buckets share; each class meets the first pivots of its buckets that belong to other components (one pivot in the
first turn, four afterwards), so a turn has at most so many pairs a class. Links join components, and buckets of one
component are done. After the last turn the classes outside their bucket's largest component meet the rest of it: pair
by pair in small buckets, in blocks that only give links in large ones. So no link between components is lost, whatever
the group's size. A pair's similarity is first estimated from the registers, corrected for chance collisions of
compressed registers; pairs within six standard errors of the limit or above are verified on the full sets of their texts.

Null and empty texts have no shingles, link with nothing and stand alone. Repeated rows are equal sets. Rows are told
apart by doc_id and text, so two texts under one id are two documents that share their id.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, fresh
from .connected import components

U = np.uint64
MANTISSA = 10


@dataclass(frozen=True)
class Settings:
    """``percent``: 100 * intersection >= percent * union links. ``slack``: standard errors below the limit that are
    verified; ``turns``: rounds of pivots, and ``width`` those a class meets from the second on; ``small``: pairs of a
    bucket that are left to Spark, larger buckets are compared in blocks of about ``block`` shingles."""

    k: int = 5
    percent: int = 80
    bands: int = 48
    rows: int = 5
    slack: float = 6.0
    turns: int = 3
    width: int = 4
    small: int = 64
    block: int = 1 << 20

    @property
    def registers(self) -> int:
        return self.bands * self.rows

    @property
    def margin(self) -> float:
        limit = self.percent / 100
        return self.slack * (limit * (1 - limit) / self.registers) ** 0.5


def words_of(text: str | None) -> list[bytes]:
    """Words of ASCII non-space characters and all others, with A-Z lower-cased (bytes methods know only ASCII)."""
    return (text or "").encode("utf-8", "replace").lower().split()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (multiply and shift)."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


class WordHashes(dict):
    """word -> 64-bit hash, emptied when it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_hashes(words: list[bytes], k: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles."""
    if not words:
        return np.zeros(0, U)
    k = min(k, len(words))
    h = np.fromiter(map(known.__getitem__, words), U, len(words))
    n = len(words) - k + 1
    out = np.full(n, U(k))
    for j in range(k):
        out = mix(out * U(0x9E3779B97F4A7C15) + h[j : j + n])
    return np.unique(out)


def hash_constants(registers: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(1, registers + 1, dtype=U)
    return mix(at * U(0x9E3779B97F4A7C15)), mix(at * U(0xC2B2AE3D27D4EB4F)) | U(1)


def minima(shingles: np.ndarray, constants: tuple[np.ndarray, np.ndarray], block: int = 512) -> np.ndarray:
    """The smallest value of each hash function over the set, in blocks that stay in cache."""
    add, times = constants
    low = np.full(len(add), np.iinfo(U).max, U)
    for at in range(0, len(shingles), block):
        part = (shingles[at : at + block, None] ^ add[None, :]) * times[None, :]
        np.minimum(low, part.min(axis=0), out=low)
    return low


def compress(low: np.ndarray) -> np.ndarray:
    """Leading zeros (6 bits) and the 10 bits after the first one, as uint16."""
    top = (low >> U(11)).astype(np.float64)
    bits = np.frexp(top)[1] + np.where(top > 0, 11, 0)
    zeros = np.minimum(64 - bits, 63).astype(U)
    rest = np.where(zeros < U(63), low << np.minimum(zeros + U(1), U(63)), U(0))
    return ((zeros << U(MANTISSA)) | (rest >> U(64 - MANTISSA))).astype(np.uint16)


def collision_chance(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Chance that registers of two disjoint sets of these sizes agree."""
    z = np.arange(64.0)

    def of(n: np.ndarray) -> np.ndarray:
        n = n.astype(float)[:, None]
        return np.exp(n * np.log1p(-(2.0 ** -(z + 1)))) - np.where(z == 0, 0.0, np.exp(n * np.log1p(-np.minimum(2.0**-z, 1 - 1e-16))))

    return (of(n_a) * of(n_b)).sum(axis=1) / 2.0**MANTISSA


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Similarity from two arrays of sketches (rows), corrected for chance collisions."""
    same = (a == b).mean(axis=1)
    chance = np.clip(collision_chance(n_a, n_b), 0, 0.5)
    return np.clip((same - chance) / (1 - chance), 0, 1)


def sketches(docs: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, text_key, n, set_key BINARY(16), sketch BINARY: one row a document; set_key and sketch are null for empty sets."""
    source = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, constants = WordHashes(), hash_constants(settings.registers)
        for batch in batches:
            sizes, classes, made = [], [], []
            last: tuple[str | None, tuple] = (None, (0, None, None))
            for cell in batch.column(2):
                text = cell.as_py()
                if text is None or text != last[0]:
                    s = shingle_hashes(words_of(text), settings.k, known)
                    key = np.array([s.sum(), mix(s ^ U(0x5851F42D4C957F2D)).sum() ^ U(len(s))], U).tobytes() if len(s) else None
                    last = text, (len(s), key, compress(minima(s, constants)).tobytes() if len(s) else None)
                n, key, sketch = last[1]
                sizes.append(n)
                classes.append(key)
                made.append(sketch)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(made, pa.binary())],
                ["doc_id", "text_key", "n", "set_key", "sketch"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, text_key long, n long, set_key binary, sketch binary")


def _estimated(pairs: DataFrame, ready: DataFrame, settings: Settings) -> DataFrame:
    """Pairs (a, b) with the sizes of both sets and ``est``."""
    left = ready.select(F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    right = ready.select(F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(n, settings.registers) for i in (4, 5))
            sizes = [batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(estimate(a, b, *sizes))], ["a", "b", "n_a", "n_b", "est"])

    return joined.mapInArrow(run, "a long, b long, n_a long, n_b long, est double")


def _ready(wanted: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """class, n, sketch and text (of the first document) of each wanted class, kept by class in the shared folder."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    firsts = classes.join(wanted, "class").select("class", "n", "sketch", F.col("first.doc_id").alias("w_id"), F.col("first.text_key").alias("w_key"))
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    same = keyed["doc_id"].eqNullSafe(F.col("w_id")) & (keyed["text_key"] == F.col("w_key"))
    found = keyed.join(firsts, same).select("class", "n", "sketch", "text").repartition(parts, "class")
    return checkpoint(found.dropDuplicates(["class"]))


def _verified(pairs: DataFrame, ready: DataFrame, settings: Settings) -> DataFrame:
    """a, b, jac (exact similarity) and linked of pairs, from the whole texts of the classes' first documents."""
    texts = ready.select("class", "text")
    joined = (
        pairs.select("a", "b")
        .join(texts.select(F.col("class").alias("a"), F.col("text").alias("t_a")), "a")
        .join(texts.select(F.col("class").alias("b"), F.col("text").alias("t_b")), "b")
        .select("a", "b", "t_a", "t_b")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, set] = {}

        def shingles(key: int, text: str) -> set:
            if key not in made:
                if len(made) > 64:
                    made.clear()
                words = words_of(text)
                k = min(settings.k, len(words))
                made[key] = set(zip(*[words[i:] for i in range(k)], strict=False))
            return made[key]

        for batch in batches:
            jac = []
            for a, b, t_a, t_b in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                x, y = shingles(a, t_a), shingles(b, t_b)
                both = len(x & y)
                union = len(x) + len(y) - both
                jac.append((both / union, 100 * both >= settings.percent * union))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array([j for j, _ in jac], pa.float64()), pa.array([x for _, x in jac], pa.bool_())], ["a", "b", "jac", "linked"]
            )

    return joined.mapInArrow(run, "a long, b long, jac double, linked boolean")


def _pair(x: Column, y: Column) -> tuple[Column, Column]:
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _judge(pairs: DataFrame, ready: DataFrame, settings: Settings) -> DataFrame:
    """a, b, est, jac, linked: exact for the pairs whose estimate leaves the link open, null beyond."""
    est = checkpoint(_estimated(pairs, ready, settings))
    least = settings.percent / 100 - settings.margin
    open_pairs = est.where((F.col("est") >= least) & (100 * F.least("n_a", "n_b") >= settings.percent * F.greatest("n_a", "n_b")))
    exact = _verified(open_pairs, ready, settings)
    return checkpoint(est.join(exact, ["a", "b"], "left").select("a", "b", "est", "jac", F.coalesce("linked", F.lit(False)).alias("linked")))


def linked_classes(classes: DataFrame, docs: DataFrame, settings: Settings) -> DataFrame:
    """class, root: one root for all classes that verified links connect; classes without a common bucket are absent."""
    keys = F.transform(
        F.sequence(F.lit(0), F.lit(settings.bands - 1)),
        lambda band: F.xxhash64(band, F.substring(F.col("sketch"), band * (2 * settings.rows) + 1, F.lit(2 * settings.rows))),
    )
    members = classes.select("class", "n", F.explode(keys).alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("class").alias("__low"), F.max("class").alias("__top")).where("__low < __top").select("bucket")
    members = checkpoint(members.join(shared, "bucket").withColumn("root", F.col("class")))
    ready = _ready(members.select("class").distinct(), classes, docs)
    judged = None
    for turn in range(settings.turns):
        # a pivot for each bucket that still holds two components, met by members of other components
        order = F.struct(F.xxhash64(F.lit(turn), "class").alias("rank"), "class", "root", "n")
        pivots = members.groupBy("bucket").agg(F.min(order).alias("p"), F.min("root").alias("__low"), F.max("root").alias("__top"))
        pivots = pivots.where("__low < __top").select("bucket", "p.rank", F.col("p.class").alias("pivot"), F.col("p.root").alias("pivot_root"), F.col("p.n").alias("p_n"))
        met = members.join(pivots, "bucket").where(F.col("root") != F.col("pivot_root")).where(_sizes_fit(F.col("n"), F.col("p_n"), settings))
        met = met.select(*_pair(F.col("class"), F.col("pivot")), "class", "pivot_root", F.struct("rank", "pivot").alias("p")).distinct()
        met = met if judged is None else met.join(judged, ["a", "b"], "left_anti")
        first = met.groupBy("class", "pivot_root").agg(F.min("p").alias("p"))  # at most as many as there are bands
        first = first.groupBy("class").agg(F.array_sort(F.collect_list("p")).alias("p")) if turn else first.groupBy("class").agg(F.array(F.min("p")).alias("p"))
        star = first.select("class", F.explode(F.slice("p", 1, settings.width)).alias("p"))
        star = star.select(*_pair(F.col("class"), F.col("p.pivot"))).distinct()
        new = _judge(star, ready, settings)
        judged = new if judged is None else judged.union(new)
        members, joined = _merged(members, new)
        if not joined:
            break

    # what the pivots left open: members outside their bucket's largest component against the rest of the bucket
    sizes = members.groupBy("bucket", "root").agg(F.count("*").alias("c"))
    largest = sizes.groupBy("bucket").agg(F.max(F.struct("c", "root")).alias("m"), F.sum("c").alias("c"), F.count("*").alias("k")).where("k > 1")
    largest = largest.select("bucket", F.col("m.root").alias("most"), (F.col("c") * (F.col("c") - F.col("m.c")) > settings.small).alias("large"))
    busy = checkpoint(members.join(largest, "bucket").select("bucket", "class", "n", "root", "most", "large"))
    rest = busy.where("not large").select(*[F.col(c).alias(f"o_{c}") for c in ("bucket", "class", "n", "root")])
    few = busy.where("not large and root <> most").join(rest, (F.col("bucket") == F.col("o_bucket")) & (F.col("root") != F.col("o_root")) & _sizes_fit(F.col("n"), F.col("o_n"), settings))
    more = few.select(*_pair(F.col("class"), F.col("o_class"))).distinct()
    if busy.where("large").limit(1).count():
        more = more.union(_block_links(busy.where("large"), ready, settings)).distinct()
    more = more if judged is None else more.join(judged, ["a", "b"], "left_anti")
    return _merged(members, _judge(more, ready, settings))[0].select("class", "root").distinct()


def _band_keys(bands: np.ndarray) -> np.ndarray:
    """One 64-bit value a band of registers: sketches x bands."""
    out = np.zeros(bands.shape[:2], U)
    for j in range(bands.shape[2]):
        out = mix(out + bands[:, :, j].astype(U) + U(1))
    return out


def _with_shingles(ready: DataFrame, settings: Settings) -> DataFrame:
    """class, sketch and the hashes of the class's shingles as packed 64-bit integers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            packed = [shingle_hashes(words_of(t.as_py()), settings.k, known).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(packed, pa.binary())], ["class", "sketch", "shingles"])

    return ready.select("class", "sketch", "text").mapInArrow(run, "class long, sketch binary, shingles binary")


def _block_links(busy: DataFrame, ready: DataFrame, settings: Settings) -> DataFrame:
    """Links (a, b) among classes of different components that share a large bucket, found block by block.

    Large buckets with the same largest component are handled together. Their classes are dealt into blocks of about
    ``settings.block`` shingles, those outside that component also into blocks of their own; each block of outside classes
    meets each block of all. Two classes are compared on their full sets of hashes if they agree in a band. Only links come
    out, one at most from a class to a component, however many pairs a block has to rule out.
    """
    named = checkpoint(busy.select("most", "class", "n", "root", (F.col("root") != F.col("most")).alias("outside")).distinct())
    weight = F.col("n") + 64

    def blocks(of: Column) -> Column:
        return F.greatest(F.ceil(F.coalesce(F.sum(of), F.lit(0)) / settings.block), F.lit(1)).cast("int")

    counts = named.groupBy("most").agg(blocks(F.when(F.col("outside"), weight)).alias("q_blocks"), blocks(weight).alias("blocks"))
    shingled = _with_shingles(ready.join(named.select("class").distinct(), "class", "left_semi"), settings)
    dealt = checkpoint(named.join(counts, "most").join(shingled, "class"))
    columns = ["class", "n", "root", "outside", "sketch", "shingles"]

    def own(blocks: str) -> Column:
        return F.pmod(F.xxhash64(F.lit("block"), "class"), F.col(blocks)).cast("int")

    def every(blocks: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))

    left = dealt.where("outside").select(F.col("most").alias("q_most"), own("q_blocks").alias("q_i"), every("blocks").alias("q_j"), *[F.col(c).alias(f"q_{c}") for c in columns])
    right = dealt.select("most", every("q_blocks").alias("i"), own("blocks").alias("j"), *columns)

    def compare(key: tuple, asked: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        if len(asked) and len(met):
            bands = np.frombuffer(b"".join(met["sketch"]), np.uint16).reshape(len(met), settings.bands, settings.rows)
            flat, n = np.frombuffer(b"".join(met["shingles"]), U), met["n"].to_numpy()
            ends = np.cumsum(n)
            root, number, outside = (met[c].to_numpy() for c in ("root", "class", "outside"))
            bands = _band_keys(bands)
            for a, m, r, sketch, shingles in zip(*[asked[f"q_{c}"] for c in ("class", "n", "root", "sketch", "shingles")], strict=True):
                fits = (root != r) & (100 * np.minimum(n, m) >= settings.percent * np.maximum(n, m)) & (~outside | (number > a))
                at = np.flatnonzero(fits)
                mine = _band_keys(np.frombuffer(sketch, np.uint16).reshape(1, settings.bands, settings.rows))
                at = at[(bands[at] == mine).any(axis=1)]
                if not len(at):
                    continue
                mine = np.frombuffer(shingles, U)
                values = np.concatenate([flat[ends[i] - n[i] : ends[i]] for i in at])
                hit = mine[np.minimum(np.searchsorted(mine, values), len(mine) - 1)] == values
                both = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(n[at])[:-1]]).astype(np.int64), dtype=np.int64)
                linked = at[100 * both >= settings.percent * (n[at] + len(mine) - both)]
                _, first = np.unique(root[linked], return_index=True)
                out += [(min(a, int(number[i])), max(a, int(number[i]))) for i in linked[first]]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    keys = ["most", "i", "j"]
    return left.groupBy(*[f"q_{k}" for k in keys]).cogroup(right.groupBy(*keys)).applyInPandas(compare, "a long, b long")


def _sizes_fit(n: Column, m: Column, settings: Settings) -> Column:
    return 100 * F.least(n, m) >= settings.percent * F.greatest(n, m)


def _merged(members: DataFrame, judged: DataFrame) -> tuple[DataFrame, bool]:
    """Members with the roots that new links join, and whether there were any."""
    new = judged.where("linked").select("a", "b")
    if not new.limit(1).count():
        return members, False
    roots = members.select("class", "root").distinct()
    ends = new.join(roots.select(F.col("class").alias("a"), F.col("root").alias("ra")), "a").join(roots.select(F.col("class").alias("b"), F.col("root").alias("rb")), "b")
    joined = components(ends, a="ra", b="rb").select(F.col("node").alias("root"), "component")
    named = members.join(joined, "root", "left")
    return checkpoint(named.withColumn("root", F.coalesce("component", "root")).drop("component")), True


def _classes(drawn: DataFrame) -> DataFrame:
    """class LONG, set_key, n, sketch and first (smallest doc_id and its text_key) of each distinct set.

    The 64-bit class number is hashed from the 128-bit key; should two keys share one, the next salt is tried.
    """
    first = F.min(F.struct("doc_id", "text_key")).alias("first")
    classes = checkpoint(drawn.where("n > 0").groupBy("set_key", "n").agg(first, F.first("sketch").alias("sketch")))
    for salt in range(50):
        numbered = classes.withColumn("class", F.xxhash64(F.lit(salt), "set_key"))
        if not numbered.groupBy("class").count().where("count > 1").limit(1).count():
            return numbered
    raise RuntimeError("no salt gives distinct class numbers")


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id (smallest doc_id that is reachable), kept (it is this one) and stays
    (so is its text), a row for each document."""
    docs = docs.select("doc_id", "text")
    drawn = checkpoint(sketches(docs, settings))
    classes = _classes(drawn)
    roots = linked_classes(classes, docs, settings)
    named = classes.select("class", "set_key", "first.doc_id", "first.text_key").join(roots, "class", "left").select("set_key", "doc_id", "text_key", F.coalesce("root", "class").alias("root"))
    least = named.groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("least"))
    groups = named.join(least, "root").select("set_key", "least")
    out = drawn.select("doc_id", "text_key", "n", "set_key").join(groups, "set_key", "left")
    component = F.coalesce("least.doc_id", "doc_id")
    stays = F.col("doc_id").eqNullSafe(component) & (F.col("text_key") == F.coalesce("least.text_key", "text_key"))
    return out.select(
        "doc_id", "text_key", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), stays.alias("stays")
    )


def drop_near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row of each group, with the columns of ``docs``: its smallest (doc_id, text hash). Rows without shingles stay."""
    i, key, one, text = fresh(docs, "stays_id", "stays_key", "stays_one", "text_key")
    stay = near_duplicates(docs, settings).where("stays").select(F.col("doc_id").alias(i), F.col("text_key").alias(key), (F.col("n_shingles") > 0).alias(one)).distinct()
    keyed = docs.withColumn(text, F.xxhash64("text"))
    met = keyed.join(stay, keyed["doc_id"].eqNullSafe(F.col(i)) & (F.col(text) == F.col(key)))
    once = met.where(one).dropDuplicates(["doc_id", text])
    return once.unionByName(met.where(f"not {one}")).select(*[F.col(f"`{c}`") for c in docs.columns])
