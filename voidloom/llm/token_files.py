"""Token ids as files: one concatenated id array a segment, document boundaries in Elias-Fano code.

A segment is one binary value (little-endian): magic ``VLTS``, number of documents, number of ids, bits of the low
parts, length of the high bits in bytes, then the high bits (unary gaps), the packed low bits, samples of the select
structure (the place of every 64th one in the high bits), and the ids as uint16 or uint32. A boundary is the
end of a document; ends are found by ``select``, without a table of 64-bit offsets. Segments are rows of Parquet files, so Spark's
committer makes each appear once, whichever executor is lost; documents are in ascending order of their id across and
within segments, and ``part_start`` (ids before the segment in its partition) with the partitions' totals gives starts.

Null and empty texts have the end id alone. Rows with equal ids keep one order (by text). Null ids stand first.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HEADER = struct.Struct("<4sQQBBQ")
MAGIC = b"VLTS"
SAMPLE = 64
#: Words that the library gets as one string.
JOINED = 20_000
#: A space before a visible ASCII or Latin character begins a pre-token, so texts may be cut in front of it.
CUT = re.compile("(?= [!-~À-ɏ])")


@dataclass(frozen=True)
class Settings:
    """``segment_ids``: a segment is closed once it has so many ids (a document is never split)."""

    end_id: int = 0
    segment_ids: int = 1 << 18
    known_pieces: int = 20_000


class EliasFano:
    """A non-decreasing sequence of integers in near-minimal space, with ``select``."""

    def __init__(self, low_bits: int, n: int, high: np.ndarray, low: np.ndarray, samples: np.ndarray):
        self.low_bits, self.n, self.high, self.low, self.samples = low_bits, n, high, low, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (max(1, top) // max(1, n)).bit_length() - 1)
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(places[-1]) + 1 if n else 0), np.uint8)
        bits[places] = 1
        parts = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)[None, :]) & np.uint64(1)
        low = np.packbits(parts.astype(np.uint8).ravel(), bitorder="little")
        return cls(low_bits, n, np.packbits(bits, bitorder="little"), low, places[::SAMPLE].astype(np.uint64))

    def select(self, i: int) -> int:
        """The ``i``-th value: from the sample before it, ones are counted in the high bits."""
        place = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        if left:
            first = (place + 1) // 8
            bits = np.unpackbits(self.high[first : first + 1 + (SAMPLE + (1 << 12)) // 8], bitorder="little")
            ones = np.flatnonzero(bits[(place + 1) - 8 * first :])
            if len(ones) < left:  # a long gap: read on to the end
                bits = np.unpackbits(self.high[first:], bitorder="little")
                ones = np.flatnonzero(bits[(place + 1) - 8 * first :])
            place += 1 + int(ones[left - 1])
        at = i * self.low_bits
        word = int.from_bytes(self.low[at // 8 : (at + self.low_bits + 7) // 8].tobytes(), "little")
        return ((place - i) << self.low_bits) | ((word >> (at % 8)) & ((1 << self.low_bits) - 1))

    def all(self) -> np.ndarray:
        """Every value at once."""
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        parts = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits)
        low = (parts.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)[None, :]).sum(axis=1, dtype=np.uint64)
        return ((places - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)) | low


def pack_segment(documents: list[np.ndarray]) -> bytes:
    """The file form of a run of documents' ids."""
    ends = np.cumsum([len(d) for d in documents], dtype=np.uint64)
    ids = np.concatenate(documents) if documents else np.zeros(0, np.uint32)
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    ef = EliasFano.encode(ends)
    head = HEADER.pack(MAGIC, len(documents), len(ids), width, ef.low_bits, len(ef.high))
    return b"".join([head, ef.high.tobytes(), ef.low.tobytes(), ef.samples.astype("<u8").tobytes(), ids.astype(f"<u{width}").tobytes()])


class Segment:
    """A segment read back: ``bounds(i)`` and ``ids(i)`` of its ``i``-th document."""

    def __init__(self, blob: bytes):
        magic, self.n, self.n_ids, width, low_bits, high = HEADER.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        at = HEADER.size
        low = (self.n * low_bits + 7) // 8
        samples = -(-self.n // SAMPLE)
        self.ends = EliasFano(
            low_bits,
            self.n,
            np.frombuffer(blob, np.uint8, high, at),
            np.frombuffer(blob, np.uint8, low, at + high),
            np.frombuffer(blob, "<u8", samples, at + high + low),
        )
        self.data = np.frombuffer(blob, f"<u{width}", self.n_ids, at + high + low + 8 * samples)

    def bounds(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def ids(self, i: int) -> np.ndarray:
        begin, end = self.bounds(i)
        return self.data[begin:end]

    def all_bounds(self) -> tuple[np.ndarray, np.ndarray]:
        ends = self.ends.all().astype(np.int64)
        return np.concatenate([[0], ends[:-1]]) if self.n else ends, ends


class Encoder:
    """Ids of whole texts by a tokenizers file, in one thread, as ``encode`` with ``add_special_tokens=False`` gives them.

    A space before a visible character begins a pre-token, so a text is its first word and then words that each bring
    their space. The texts of a run are cut at spaces and their words counted off in Arrow; the library gets each distinct
    word once, many as one string with their spaces, and numpy puts the words' ids in the texts' order. Texts with runs of
    spaces or other white space after a space are cut by ``CUT`` instead, and texts that hold an added token's string go to
    the library whole. Nothing is remembered between runs but short pieces.
    """

    def __init__(self, path: str, known: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: whether a token begins with a space (written Ġ)
        self.begins = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for piece, i in self.tokenizer.get_vocab().items():
            self.begins[i] = piece.startswith("Ġ")
        self.known = known
        self.pieces: dict[str, np.ndarray] = {}

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of words that follow a space, and how many each has."""
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), JOINED):
            part = words[at : at + JOINED]
            (some,) = self._encode([" " + " ".join(part)])
            starts = np.flatnonzero(self.begins[some])  # only a word's first token begins with a space
            if len(starts) == len(part):
                ids.append(some)
                sizes.append(np.diff(starts, append=len(some)))
            else:
                each = self._encode([f" {w}" for w in part])
                ids += each
                sizes.append(np.array([len(e) for e in each], np.int64))
        return np.concatenate(ids), np.concatenate(sizes)

    def _by_pieces(self, texts: list[str]) -> list[np.ndarray]:
        split = list(map(CUT.split, texts))
        if len(self.pieces) > self.known:
            self.pieces.clear()
        new = list(set(chain.from_iterable(split)).difference(self.pieces))
        self.pieces.update(zip(new, self._encode(new), strict=True))
        return [np.concatenate([self.pieces[p] for p in parts]) for parts in split]

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        parts = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        offsets = parts.offsets.to_numpy()
        coded = parts.flatten().dictionary_encode()
        at, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        follows = np.ones(len(at), bool)
        follows[offsets[:-1]] = False  # the first word of a text
        asked = np.zeros(len(names), bool)
        asked[at[follows]] = True
        good = np.array([bool(w) and ("!" <= w[0] <= "~" or w[0].isalnum()) for w in names], bool) & asked
        ids, some = self._words([names[i] for i in np.flatnonzero(good).tolist()])
        sizes = np.zeros(len(names), np.int64)
        sizes[good] = some
        starts = np.cumsum(sizes) - sizes
        heads = self._by_pieces([names[i] for i in at[offsets[:-1]].tolist()])
        out: list[np.ndarray] = []
        while len(out) < len(texts):  # about a million words at a time
            first = len(out)
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + (1 << 20))) - 1)
            here, low = slice(offsets[first], offsets[last]), offsets[first]
            each = np.where(follows[here], sizes[at[here]], 0)
            ends = np.cumsum(each)
            flat = ids[np.repeat(starts[at[here]] - (ends - each), each) + np.arange(ends[-1])]
            tails = np.split(flat, ends[offsets[first + 1 : last] - low - 1])
            out += [np.concatenate([head, tail]) for head, tail in zip(heads[first:last], tails, strict=True)]
        odd = np.flatnonzero(np.logical_or.reduceat(follows & ~good[at], offsets[:-1])).tolist()
        whole = [i for i, t in enumerate(texts) if any(x in t for x in self.added)]
        for places, how in ((odd, self._by_pieces), (whole, self._encode)):
            for i, found in zip(places, how([texts[i] for i in places]), strict=True):
                out[i] = found
        pa.default_memory_pool().release_unused()
        return out


def runs(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs with about ``most`` characters, so that lists of pieces stay small; nulls are empty."""
    begin, size, run = 0, 0, []
    for i, cell in enumerate(texts):
        run.append(cell.as_py() or "")
        size += len(run[-1])
        if size >= most:
            yield begin, run
            begin, size, run = i + 1, 0, []
    if run:
        yield begin, run


#: The encoder of this worker process by file, as loading a vocabulary takes time and memory.
_loaded: dict[str, Encoder] = {}


def encoder_of(path: str, known: int) -> Encoder:
    if path not in _loaded:
        _loaded.clear()
        _loaded[path] = Encoder(path, known)
    return _loaded[path]


SEGMENTS = "part int, segment int, part_start long, n_docs long, n_ids long, doc_ids array<long>, payload binary"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, settings: Settings = Settings()) -> None:
    """Encode ``docs`` (doc_id, text) and write segments in ascending order of doc_id to ``path`` (Parquet of segments).

    ``tokenizer`` is a file that every executor has. Texts are dealt by ranges of doc_id, in one shuffle.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranged = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = encoder_of(tokenizer, settings.known_pieces), TaskContext.get().partitionId()
        end = np.array([settings.end_id], np.uint32)
        ids: list[int | None] = []
        documents: list[np.ndarray] = []
        segment = start = size = 0

        def close() -> pa.RecordBatch:
            nonlocal segment, start, size
            made = [part, segment, start, len(documents), size, list(ids), pack_segment(documents)]
            segment, start, size = segment + 1, start + size, 0
            ids.clear()
            documents.clear()
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            names = [x.split()[0] for x in SEGMENTS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(made, types, strict=True)], names)

        for batch in batches:
            numbers = batch.column(0).to_pylist()
            for begin, texts in runs(batch.column(1), 8 << 20):
                for i, coded in enumerate(encoder.batch(texts), begin):
                    ids.append(numbers[i])
                    documents.append(np.concatenate([coded, end]))
                    size += len(documents[-1])
                    if size >= settings.segment_ids:
                        yield close()
        if documents:
            yield close()

    ranged.mapInArrow(run, SEGMENTS).write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    segments = spark.read.parquet(path)
    # a row for each partition of the writer: its ids, summed up in the order of partitions
    totals = segments.groupBy("part").agg(F.max(F.col("part_start") + F.col("n_ids")).alias("ids"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(F.col("part").alias("p"), F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("before"))
    placed = segments.join(F.broadcast(before), F.col("part") == F.col("p"))
    placed = placed.select((F.col("before") + F.col("part_start")).alias("start"), "doc_ids", "payload")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, doc_ids, blob in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                segment = Segment(blob)
                begins, ends = segment.all_bounds()
                words = segment.data.astype("<u4")
                crcs = [zlib.crc32(words[a:b].tobytes()) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                cols = [pa.array(doc_ids, pa.int64()), pa.array(begins + start), pa.array(ends - begins), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
