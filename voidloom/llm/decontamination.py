"""Benchmark decontamination with DataFrame functions only.

Words are lower-cased A-Z runs of the word rule in ``common``. A test window is ``n`` consecutive words of an item; an
item of fewer words, but not none, is one window. A document word inside any occurrence of a window is hit.

Test windows become a hash set of bits: 2^26 of them at most, as 2^20 numbers of 64 bits, so what is broadcast is bounded
whatever the benchmark's size. Every position of every document is looked up in it, for each length that test windows
have; only positions whose bit is set leave the scan, with their words, and meet the test windows in an equi-join, which
verifies them word by word. With more windows more bits are set by chance and more positions are verified; nothing else changes.

Null and empty texts have no words and stay. Rows that agree in id and text are handled alike and all stay in the
result; an item whose id is null hits, but is not listed. Empty tables give no rows, or no hits. Very long texts are
scanned whole. Extra columns are ignored by ``find_hits`` and kept by ``decontaminate``, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP, checkpoint, fresh, lower_ascii

#: Fixed value: the word rule's gaps in a text that still has its capitals.
RAW_GAP = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"


@dataclass(frozen=True)
class Settings:
    """``n``: words of a window; ``bits``: the hash set has 2^``bits`` numbers of 64 bits at most."""

    n: int = 10
    bits: int = 20


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), WORD_GAP), "")


def windows(words: Column, n: int | Column) -> Column:
    """All windows of ``n`` words of an array column; none if it is shorter."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct((i - 1).alias("pos"), F.slice(words, i, n).alias("window")))


def test_windows(benchmark: DataFrame, n: int) -> DataFrame:
    """One row a distinct window: ``window ARRAY<STRING>``, ``items ARRAY<STRING>`` (ids as text)."""
    split = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("words")).where("size(words) > 0")
    short = split.where(F.size("words") < n).select("item", F.col("words").alias("window"))
    full = split.where(F.size("words") >= n).select("item", F.explode(windows(F.col("words"), n)).alias("w")).select("item", "w.window")
    return short.unionByName(full).groupBy("window").agg(F.collect_set("item").alias("items"))


def _window_hash(hashes: Column) -> Column:
    """The hash of a window from its words' hashes."""
    return F.xxhash64(hashes)


def _place(hash_: Column, settings: Settings) -> tuple[Column, Column]:
    """(number, bit) of a hash in the hash set: its lowest bits and its six highest."""
    return hash_.bitwiseAND((1 << settings.bits) - 1), F.shiftrightunsigned(hash_, 58).cast("int")


def hash_set(tests: DataFrame, settings: Settings) -> DataFrame:
    """number, ones: the bits of all test windows, and number -1, which every document meets once."""
    number, bit = _place(_window_hash(F.transform("window", lambda w: F.xxhash64(w))), settings)
    placed = tests.select(number.alias("number"), bit.alias("bit"))
    ones = placed.groupBy("number").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("ones"))
    return ones.union(tests.sparkSession.range(1).select(F.lit(-1).cast("long"), F.lit(-1).cast("long")))


def _candidates(rows: DataFrame, tests: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, text_key, n_words, pos, window: positions whose bit is set, and pos -1 once for each row, with a window
    that is like no other (no word holds a zero byte)."""
    lengths = sorted(r["n"] for r in tests.select(F.size("window").alias("n")).distinct().collect())  # n of them at most
    size = F.size("words")

    def of_length(n: int, hashes: Column) -> Column:
        starts = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.when(i <= size - (n - 1), _window_hash(F.slice(hashes, i, n))))

    # a one-element array holds the words' hashes, so that they are worked out once
    hashed = F.array(F.transform("words", lambda w: F.xxhash64(w)))
    every = F.flatten(F.transform(hashed, lambda h: F.concat(F.array(F.lit(0).cast("long")), *[of_length(n, h) for n in lengths])))
    flat = rows.select("doc_id", "text_key", "words", size.alias("n_words"), every.alias("every"))
    # outer, as else a filter on the array's size is pushed below it, where each element would split the text again
    flat = flat.select("doc_id", "text_key", "words", "n_words", F.posexplode_outer("every").alias("at", "hash"))
    number, bit = _place(F.col("hash"), settings)
    flat = flat.select("doc_id", "text_key", "words", "n_words", "at", F.when(F.col("at") == 0, -1).otherwise(number).alias("number"), bit.alias("bit"))
    met = flat.join(F.broadcast(hash_set(tests, settings)), "number").where(F.expr("at = 0 or (shiftrightunsigned(ones, bit) & 1L) = 1L"))
    which, pos = F.floor((F.col("at") - 1) / F.col("n_words")).cast("int"), F.pmod(F.col("at") - 1, F.col("n_words"))
    met = met.select("doc_id", "text_key", "n_words", "words", "at", F.when(F.col("at") > 0, pos).otherwise(-1).alias("pos"), F.get(F.array(*[F.lit(n) for n in lengths] or [F.lit(0)]), which).alias("n"))
    alone = F.array(F.lit("\0"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_key").cast("string"))
    return met.select("doc_id", "text_key", "n_words", "pos", F.when(F.col("at") == 0, alone).otherwise(F.slice("words", F.col("pos") + 1, F.col("n"))).alias("window"))


def _verified(docs: DataFrame, benchmark: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, text_key, n_words, n_copies, hits ARRAY<INT> (hit word positions), items: one row for rows that agree."""
    tests = checkpoint(test_windows(benchmark, settings.n))
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), words_of(F.col("text")).alias("words"))
    met = _candidates(rows, tests, settings).join(tests, "window", "left")
    met = met.withColumn("seen", F.when(F.col("items").isNotNull(), F.sequence("pos", F.col("pos") + F.size("window") - 1)))
    return met.groupBy("doc_id", "text_key", "n_words").agg(
        F.count(F.when(F.col("pos") < 0, 1)).cast("int").alias("n_copies"),
        F.array_distinct(F.flatten(F.collect_list("seen"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )


def find_hits(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_words, n_hit, n_items, items, contaminated."""
    found = _verified(docs, benchmark, settings)
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        "items",
        (F.size("hits") > 0).alias("contaminated"),
        F.explode(F.sequence(F.lit(1), "n_copies")).alias("copy"),
    ).drop("copy")


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", settings: Settings = Settings()) -> DataFrame:
    """Drop contaminated documents, or with ``mode="spans"`` cut the hit words (with what stands before each) out of their texts."""
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode is documents or spans, not {mode!r}")
    i, key, hits, cut = fresh(docs, "hit_id", "hit_key", "hit_words", "cut_text")
    found = _verified(docs.select("doc_id", "text"), benchmark, settings).where(F.size("hits") > 0)
    found = found.select(F.col("doc_id").alias(i), F.col("text_key").alias(key), F.col("hits").alias(hits))
    same = docs["doc_id"].eqNullSafe(F.col(i)) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(key))
    if mode == "documents":
        return docs.join(found, same, "left_anti")
    gap, word = f"[{RAW_GAP}]*", f"[^{RAW_GAP}]+"
    pieces = F.regexp_extract_all("text", F.lit(f"({gap}{word})"), 1)
    kept = F.array_join(F.filter(pieces, lambda _, i: ~F.array_contains(hits, i)), "")
    text = F.when(F.col(hits).isNull(), F.col("text")).otherwise(F.concat(kept, F.regexp_extract("text", f"({gap})$", 1)))
    joined = docs.join(found, same, "left").withColumn(cut, text)
    return joined.select(*[F.col(cut).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
