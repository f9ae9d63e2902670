"""Line dedup by windows of words and content-defined chunks of lines, with DataFrame functions only.

Two kinds of pieces of a text are looked up in the corpus:

- windows: from each line on the fewest lines that hold ``min_words`` words or more, and up to each line the fewest such
  lines before it. Each line of a repeated passage of ``min_words`` words or more lies in a window that lies in the
  passage, so passages of short lines go as a whole, edges and blank lines included;
- chunks: a rolling hash over each pair of neighbouring line hashes (``31 * before + this``, 32 bits of each line's md5)
  is a text's landscape; a chunk begins at its local minima. Chunks of two or more lines with a word in them count.

A piece is repeated if another place of the corpus, in the order of (doc_id, position), holds the same lines before it:
the first place keeps it, the others lose it after the texts were compared byte by byte. A place that overlaps the first
one does not count, so a run of equal lines keeps its first window. Each line that goes has an equal one before it.

Null texts stay null and empty texts empty. Rows that agree in id and text are one document: they lose the same lines
and none to each other. Null ids sort first. A text whose lines were all repeated is left as ``''``. Very long texts are
cut whole, an empty table gives an empty table, and other columns stay whatever their names, but ``n_lines`` and
``n_removed``, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, fresh

#: A word of a line: anything but white space of ASCII.
WORD = r"[^\x09-\x0D\x20]+"


@dataclass(frozen=True)
class Settings:
    """``min_words``: words of the shortest repeated passage that surely goes as a whole."""

    min_words: int = 50


def line_hash(line: Column) -> Column:
    """The first 32 bits of the line's md5."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def chunks_of(hashes: Column) -> Column:
    """Codes (first line, number of lines) of the chunks of a text's line hashes."""
    last = F.size(hashes) - 1
    high = F.lit(1 << 40)
    numbers = F.sequence(F.lit(0), last)
    # position i > 0 holds the hash of lines i-1 and i; beyond the ends it is higher than any
    rolling = F.transform(numbers, lambda i: F.when(i == 0, high).otherwise(F.pmod(F.get(hashes, i - 1) * 31 + F.get(hashes, i), F.lit(1 << 32))))

    def cut(rolled: Column) -> Column:
        return F.filter(numbers, lambda i: (i == 0) | (F.get(rolled, i) < F.get(rolled, i - 1)) & (F.get(rolled, i) <= F.coalesce(F.get(rolled, i + 1), high)))

    def build(starts: Column) -> Column:
        ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(last + 1))
        return F.zip_with(starts, ends, lambda a, b: code(a, b - a))

    # one-element arrays hold what is used many times, so that it is worked out once
    starts = F.transform(F.array(rolling), cut)
    return F.flatten(F.transform(starts, build))


def running(counts: Column, block: int = 256) -> Column:
    """0 and the running totals of an array of numbers, by blocks, as appending to an array copies it."""

    def prefix(numbers: Column) -> Column:
        return F.aggregate(numbers, F.array(F.lit(0)), lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + x)))

    parts = F.transform(F.sequence(F.lit(1), F.size(counts), F.lit(block)), lambda a: prefix(F.slice(counts, a, F.lit(block))))
    before = F.transform(F.array(parts), lambda p: F.zip_with(p, F.slice(prefix(F.transform(p, lambda x: F.element_at(x, -1))), 1, F.size(p)), lambda x, n: F.transform(F.slice(x, 2, F.size(x)), lambda y: y + n)))
    return F.concat(F.array(F.lit(0)), F.flatten(F.flatten(before)))


def code(at: Column, n: Column) -> Column:
    """First line and number of lines as one number, since arrays of numbers are made distinct by hashes."""
    return F.shiftleft(at.cast("long"), 31) + n


def first_of(c: Column) -> Column:
    return F.shiftright(c, 31).cast("int")


def lines_of(c: Column) -> Column:
    return c.bitwiseAND((1 << 31) - 1).cast("int")


def windows_of(totals: Column, line_of: Column, settings: Settings) -> Column:
    """Codes of the windows. ``totals[i]``: words before line i; ``line_of[k]``: line of word k."""
    last = F.size(totals) - 2
    numbers = F.sequence(F.lit(0), last)
    ahead = F.transform(numbers, lambda i: code(i, F.get(line_of, F.get(totals, i) + (settings.min_words - 1)) - i + 1))

    def back(j: Column) -> Column:
        start = F.get(line_of, F.get(totals, j + 1) - settings.min_words)
        return code(start, j - start + 1)

    return F.filter(F.array_union(ahead, F.transform(numbers, back)), lambda c: c.isNotNull())


def _places(docs: DataFrame, settings: Settings) -> DataFrame:
    """__id, __key, at, n, h1, h2 of each piece of each document."""
    split = docs.select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__key"), F.split("text", "\n").alias("__lines"))
    counted = F.transform("__lines", lambda x: F.regexp_count(x, F.lit(WORD)))
    split = split.select("__id", "__key", F.transform("__lines", line_hash).alias("__hashes"), F.transform("__lines", lambda x: F.xxhash64(x)).alias("__h"), counted.alias("__words"))

    def counts(c: Column) -> Column:
        n = lines_of(c)
        return (n > 1) & F.exists(F.slice("__words", first_of(c) + 1, n), lambda w: w > 0)

    chunked = split.select("__id", "__key", "__h", "__words", F.filter(chunks_of(F.col("__hashes")), counts).alias("__codes"))
    # texts of too few words have no window and need no totals
    enough = F.aggregate("__words", F.lit(0), lambda n, x: n + x) >= settings.min_words
    line_of = F.flatten(F.transform("__words", lambda x, i: F.array_repeat(i, x)))
    totals = chunked.select("__id", "__key", "__h", "__codes", F.when(enough, running(F.col("__words"))).alias("__totals"), F.when(enough, line_of).alias("__line_of"))
    windows = F.coalesce(windows_of(F.col("__totals"), F.col("__line_of"), settings), F.array().cast("array<bigint>"))
    flat = totals.select("__id", "__key", "__h", F.explode(F.array_union("__codes", windows)).alias("c"))
    found = flat.select("__id", "__key", first_of(F.col("c")).alias("at"), lines_of(F.col("c")).alias("n"), F.slice("__h", first_of(F.col("c")) + 1, lines_of(F.col("c"))).alias("s"))
    return found.select("__id", "__key", "at", "n", F.xxhash64("s").alias("h1"), F.xxhash64(F.lit(1), "s").alias("h2"))


def repeated_ranges(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """__id, __key, __drop ``ARRAY<STRUCT<at, n, text>>``: for each document the ranges of lines that stand in an earlier
    place, with the text of that place.

    Only hashes are grouped; repeated pieces that go on in the same earlier document become one range, and the text of
    each earlier range travels once, to be compared at the others.
    """
    places = checkpoint(_places(docs.where(F.col("text").isNotNull()), settings))  # texts are cut into pieces once
    place = F.struct("__id", "at", "__key")
    firsts = places.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").drop("last")
    met = places.join(firsts, ["h1", "h2"]).where(place != F.col("first"))
    own = F.col("first.__id").eqNullSafe(F.col("__id")) & (F.col("first.__key") == F.col("__key"))
    met = met.where(~(own & (F.col("at") < F.col("first.at") + F.col("n"))))
    met = met.select("__id", "__key", "at", (F.col("at") + F.col("n")).alias("end"), F.col("first.__id").alias("f_id"), F.col("first.__key").alias("f_key"), (F.col("at") - F.col("first.at")).alias("shift"))
    same_source = ["__id", "__key", "f_id", "f_key", "shift"]
    w = Window.partitionBy(*same_source).orderBy("at", "end")
    begins = F.col("at") > F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    met = met.withColumn("begins", begins.cast("int"))
    met = met.withColumn("run", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ranges = met.groupBy(*same_source, "run").agg(F.min("at").alias("at"), F.max("end").alias("end"))
    ranges = ranges.select("__id", "__key", "f_id", "f_key", "at", (F.col("end") - F.col("at")).alias("n"), (F.col("at") - F.col("shift")).alias("f_at"))
    # the text of the earlier ranges, once each
    wanted = ranges.groupBy("f_id", "f_key").agg(F.collect_set(F.struct("f_at", "n")).alias("__wanted"))
    texts = _keyed(docs)
    found = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["f_id"]) & (texts["__key"] == wanted["f_key"])).select("f_id", "f_key", "__wanted", F.split("text", "\n").alias("lines"))
    sliced = found.select("f_id", "f_key", "lines", F.explode("__wanted").alias("x")).select("f_id", "f_key", "x.f_at", "x.n", F.array_join(F.slice("lines", F.col("x.f_at") + 1, F.col("x.n")), "\n").alias("text"))
    sliced = sliced.dropDuplicates(["f_id", "f_key", "f_at", "n"])
    same = ranges["f_id"].eqNullSafe(sliced["f_id"])
    for c in ("f_key", "f_at", "n"):
        same = same & (ranges[c] == sliced[c])
    drops = ranges.join(sliced, same).select("__id", "__key", "at", ranges["n"], "text")
    return drops.groupBy("__id", "__key").agg(F.collect_list(F.struct("at", "n", "text")).alias("__drop"))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the text's hash; both joins with texts begin with it."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("__key"))


def dedup_lines(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` with ``text`` rewritten, and ``n_lines``, ``n_removed`` (lines) added or replaced."""
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    i, key, drops, t, lines, gone = fresh(docs, "drop_id", "drop_key", "drop", "text_key", "lines", "gone")
    drop = repeated_ranges(docs.select("doc_id", "text"), settings).select(F.col("__id").alias(i), F.col("__key").alias(key), F.col("__drop").alias(drops))
    keyed = docs.select(*[F.col(f"`{c}`") for c in columns], F.xxhash64("text").alias(t))
    met = keyed.join(drop, keyed["doc_id"].eqNullSafe(drop[i]) & (keyed[t] == drop[key]), "left").withColumn(lines, F.split("text", "\n"))
    equal = F.filter(drops, lambda d: F.array_join(F.slice(lines, d["at"] + 1, d["n"]), "\n") == d["text"])
    met = met.withColumn(gone, F.array_distinct(F.flatten(F.transform(equal, lambda d: F.sequence(d["at"], d["at"] + d["n"] - 1)))))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    text = F.when(F.col(drops).isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col(lines), i)), "\n"))
    n_lines = F.coalesce(F.size(lines), F.lit(0))
    out = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in columns]
    return met.select(*out, n_lines.cast("long").alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"))
