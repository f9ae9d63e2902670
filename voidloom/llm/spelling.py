"""Spelling variants: words of a corpus that one code point tells apart, each led to its most frequent neighbour and root.

Every word emits itself and its distinct single deletions as 64-bit hashes of their code points, each deletion with the
range of places that give it (a run of one code point). Words meet where hashes and sizes agree: a word and a deletion
that equals it are an insertion apart; two deletions of words are a replacement apart where their ranges overlap, so that no
other pairs leave the join. Each pair is then verified on its words. Pairs are aggregated into counts and forms, and forms
are followed to roots in rounds that double the way.

A deletion costs a row of fixed size however long its word is, and words travel only with verified pairs, so a word of a million code
points makes a million small rows. A key is shared by at most a word for each place and letter that can stand there.

A null text has no words, a null id reads as empty text. An empty table gives an empty table; repeated rows count as often
as they stand there; ties between forms go to the smaller word in code-point order; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, lower_ascii

#: Fixed value: what a run of letters is.
LETTERS = r"[A-Za-zÀ-ÿ]"


@dataclass(frozen=True)
class Settings:
    """Words have at least ``least_length`` code points and ``least_count`` places; a form stands ``ratio`` times as often as its
    word. One task works on about ``batch`` code points at a time."""

    least_length: int = 5
    least_count: int = 3
    ratio: int = 2
    batch: int = 1 << 20


def runs(docs: DataFrame, least_length: int = 1, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but its text, and ``run``: each maximal run of letters of a length, A-Z lower-cased. ``docs`` has no
    column ``run``."""
    # a match begins where its run begins and takes all of it
    found = F.regexp_extract_all(F.col(text), F.lit(f"{LETTERS}{{{least_length},}}"), F.lit(0))
    return docs.select(*[c for c in docs.columns if c != text], F.explode(found).alias("run")).withColumn("run", lower_ascii(F.col("run")))


def damaged(run: Column, doc_id: Column, every: int = 97) -> Column:
    """The run, without one code point where its checksum with the document's id is a multiple of ``every``."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(words: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """id, word, n of the words (word) that are long and frequent enough."""
    counted = words.where(F.length("word") >= settings.least_length).groupBy("word").agg(F.count("*").alias("n"))
    return checkpoint(counted.where(F.col("n") >= settings.least_count).withColumn("id", F.monotonically_increasing_id()))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Code points as scattered odd numbers of 64 bits."""
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))) | np.uint64(1)


#: An odd base has an inverse modulo 2^64.
BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 2**64)


def keys_of(words: list[str]) -> tuple[np.ndarray, ...]:
    """word (place in the list), key, size, first, last: each word itself (first -1) and its distinct deletions with the range of
    places that give them. Equal texts have equal keys."""
    sizes = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    word = np.repeat(np.arange(len(words)), sizes)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    place = np.arange(len(points)) - begin[word]
    powers = np.ones(int(sizes.max(initial=0)) + 1, np.uint64)
    with np.errstate(over="ignore"):
        powers[1:] = np.cumprod(np.full(len(powers) - 1, BASE, np.uint64))
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(points) * powers[place])])
        whole = upto[begin[1:]] - upto[begin[:-1]]
        before = upto[:-1] - upto[begin[word]]
        after = upto[begin[word + 1]] - upto[1:]
        cut = before + after * np.uint64(INVERSE)
    head = np.ones(len(points), bool)  # a deletion stands at the first place of its run
    head[1:] = (points[1:] != points[:-1]) | (word[1:] != word[:-1])
    at = np.flatnonzero(head)
    last = np.append(at[1:], len(points)) - 1
    own = np.arange(len(words))
    return (
        np.concatenate([own, word[at]]),
        np.concatenate([whole, cut[at]]).view(np.int64),
        np.concatenate([sizes, sizes[word[at]] - 1]).astype(np.int32),
        np.concatenate([np.full(len(words), -1), place[at]]).astype(np.int32),
        np.concatenate([np.full(len(words), -1), place[last]]).astype(np.int32),
    )


def deletion_keys(vocab: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """id, key, size, first, last of every word and of its deletions."""

    def emit(ids: list[int], words: list[str]) -> Iterator[pa.RecordBatch]:
        word, *rest = keys_of(words)
        columns = [np.array(ids, np.int64)[word], *rest]
        for a in range(0, len(word), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(c[a : a + (1 << 17)]) for c in columns], ["id", "key", "size", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, words, n = [], [], 0
            for i, w in zip(b.column("id").to_pylist(), b.column("word").to_pylist(), strict=True):
                ids.append(i)
                words.append(w)
                n += len(w)
                if n >= settings.batch:
                    yield from emit(ids, words)
                    ids, words, n = [], [], 0
            if ids:
                yield from emit(ids, words)

    return vocab.select("id", "word").mapInArrow(run, "id long, key long, size int, first int, last int")


def _merging(right: DataFrame) -> DataFrame:
    """A side that grows with the words, so that it is sorted and never sent whole to the driver and all tasks. Spark takes deletions
    for no larger than the file of their words, which is under its limit for broadcasts also where they are millions of rows."""
    return right.hint("merge")


def near_pairs(vocab: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """a, word_a, n_a, b, word_b, n_b: pairs at distance one, each in both directions."""
    keys = deletion_keys(vocab, settings)
    left = keys.select(F.col("id").alias("a"), "key", "size", F.col("first").alias("first_a"), F.col("last").alias("last_a"))
    right = keys.select(F.col("id").alias("b"), "key", "size", F.col("first").alias("first_b"), F.col("last").alias("last_b"))
    itself = (F.col("first_a") < 0) != (F.col("first_b") < 0)
    replaced = (F.col("first_a") >= 0) & (F.col("first_b") >= 0) & (F.col("first_a") <= F.col("last_b")) & (F.col("first_b") <= F.col("last_a"))
    met = left.join(_merging(right), ["key", "size"]).where((F.col("a") != F.col("b")) & (itself | replaced)).select("a", "b")
    named = met.join(_merging(vocab.select(F.col("id").alias("a"), F.col("word").alias("word_a"), F.col("n").alias("n_a"))), "a")
    named = named.join(_merging(vocab.select(F.col("id").alias("b"), F.col("word").alias("word_b"), F.col("n").alias("n_b"))), "b")
    return named.where(F.levenshtein("word_a", "word_b", 1) == 1)


def roots(forms: DataFrame, rounds: int = 64) -> DataFrame:
    """id, to: the last word on the way of forms from each id (id, to). Counts grow along a way, so it has an end."""
    found = checkpoint(forms.select("id", "to"))
    for _ in range(rounds):
        ahead = found.select(F.col("id").alias("to"), F.col("to").alias("next"))
        moved = checkpoint(found.join(_merging(ahead), "to", "left").select("id", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        found = moved.select("id", "to")
        if moved.where("moved").isEmpty():
            return found
    raise RuntimeError(f"forms have no roots after {rounds} rounds")


def variants(words: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """word, n, form, form_n, root, n_near of each frequent word among ``words`` (word)."""
    vocab = vocabulary(words, settings)
    best = F.min(F.struct((-F.col("n_b")).alias("m"), F.col("word_b").alias("form"), F.col("b").alias("to")))
    near = near_pairs(vocab, settings).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n_near"), best.alias("best"))
    near = checkpoint(near.select("id", "n_near", "best.form", "best.to", (-F.col("best.m")).alias("form_n")))
    joined = vocab.join(_merging(near), "id", "left")
    leads = F.col("form_n") >= settings.ratio * F.col("n")
    joined = checkpoint(joined.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *[F.when(leads, F.col(c)).alias(c) for c in ("form", "form_n", "to")]))
    ends = roots(joined.where("to is not null")).withColumnRenamed("to", "end")
    named = ends.join(_merging(vocab.select(F.col("id").alias("end"), F.col("word").alias("root"))), "end").select("id", "root")
    return joined.join(_merging(named), "id", "left").select("word", "n", "form", "form_n", F.coalesce("root", "word").alias("root"), "n_near")


def spelling_variants(docs: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", every: int = 97) -> DataFrame:
    """``variants`` of all texts' runs of letters after ``damaged``; ``every`` 0 leaves the runs as they are."""
    flat = runs(docs.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{text}`").alias("__text")), settings.least_length, "__text")
    return variants(flat.select((damaged(F.col("run"), F.col("__id"), every) if every else F.col("run")).alias("word")), settings)
