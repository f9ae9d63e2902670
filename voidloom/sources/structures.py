"""Trajectories from extended XYZ and LAMMPS text dumps.

``frames_of(spark, path, fmt)`` reads files of any size on any file system that Spark reads: a row an atom, or with
``headers`` a row a frame. Files are cut into byte ranges by Spark's text reader, tasks find the frame starts in their ranges, and a
running total over the ranges numbers the frames; a frame that a range cuts is read once, its parts in two tasks. The driver opens
no file.

``spark.read.format("extxyz")`` and ``spark.readStream.format("extxyz")`` (or ``lammps-dump-text``) are data sources for local or
mounted files: filters on ``frame_id`` skip frames before they are read, and a stream goes on where its offsets ended.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..session import checkpoint

ATOMS = "file string, frame_id int, atom_id int, species string, type_id int, x double, y double, z double"
FRAMES = "file string, frame_id int, n_atoms int, lattice array<double>, pbc array<boolean>, info map<string,string>"
PAIR = re.compile(r'([A-Za-z_][\w-]*)=("[^"]*"|\S+)')


class ExtXyz:
    """Lines of a frame: number of atoms, header, atoms."""

    head = 2

    @staticmethod
    def starts(line: str, since: int) -> bool:
        """Whether a line begins a frame, if ``since`` lines of a frame stand before it (1: this one is a header)."""
        return since != 1 and line.strip().isdigit()

    @staticmethod
    def parse(lines: list[str]) -> dict:
        info = {k: v.strip('"') for k, v in PAIR.findall(lines[1])}
        columns = info.get("Properties", "species:S:1:pos:R:3").split(":")
        place, at = {}, 0
        for name, _, width in zip(columns[::3], columns[1::3], columns[2::3], strict=True):
            place[name] = at
            at += int(width)
        lattice = [float(x) for x in info["Lattice"].split()] if "Lattice" in info else None
        pbc = [x in ("T", "True", "1") for x in info["pbc"].split()] if "pbc" in info else None
        rest = {k: v for k, v in info.items() if k not in ("Lattice", "pbc")}
        return {"n": int(lines[0]), "lattice": lattice, "pbc": pbc, "info": rest, "s": place["species"], "p": place["pos"]}

    @staticmethod
    def atom(head: dict, number: int, line: str) -> tuple:
        cells = line.split()
        return (number, cells[head["s"]], None, *(float(x) for x in cells[head["p"] : head["p"] + 3]))


class Lammps:
    """Lines of a frame: timestep, number of atoms and box bounds under their titles, atoms."""

    head = 9

    @staticmethod
    def starts(line: str, since: int) -> bool:
        return line.startswith("ITEM: TIMESTEP")

    @staticmethod
    def parse(lines: list[str]) -> dict:
        bounds = lines[4].split()[3:]
        box = [tuple(map(float, line.split()[:2])) for line in lines[5:8]]
        at = {x: i for i, x in enumerate(lines[8].split()[2:])}
        scaled = "xs" in at
        axes = [at["xs"], at["ys"], at["zs"]] if scaled else [at.get(a, at.get(a + "u")) for a in "xyz"]
        lattice = [hi - lo if i == j else 0.0 for i in range(3) for j, (lo, hi) in enumerate(box)]
        return {"n": int(lines[3]), "lattice": lattice, "pbc": [b.startswith("p") for b in bounds] or None, "info": {"timestep": lines[1].strip()}, "box": box, "axes": axes, "scaled": scaled, "id": at["id"], "type": at["type"]}

    @staticmethod
    def atom(head: dict, number: int, line: str) -> tuple:
        cells = line.split()
        xyz = [float(cells[c]) for c in head["axes"]]
        xyz = [(v * (hi - lo) if head["scaled"] else v - lo) % (hi - lo) for v, (lo, hi) in zip(xyz, head["box"], strict=True)]  # wrapped into the box
        return (int(cells[head["id"]]), None, int(cells[head["type"]]), *xyz)


FORMATS = {"extxyz": ExtXyz, "lammps-dump-text": Lammps}


class _Frame:
    """The frame that lines belong to: its number, how many of its lines were seen, its header once it is whole."""

    def __init__(self, form, number: int = -1, since: int = 0, lines: list[str] | None = None):
        self.form, self.number, self.since, self.lines, self.head = form, number, since, list(lines or ()), None

    def take(self, line: str) -> str | None:
        """``head`` when a line completes the header, ``atom`` for an atom's line, else None."""
        if self.form.starts(line, self.since):
            self.number, self.since, self.lines, self.head = self.number + 1, 1, [line], None
            return None
        if not self.since or not line.strip() and self.since >= self.form.head:
            return None  # before any frame, or an empty line between frames
        self.since += 1
        if len(self.lines) < self.form.head:
            self.lines.append(line)
        if self.since > self.form.head:
            return "atom"
        return "head" if self.since == self.form.head else None

    def atom(self, line: str) -> tuple:
        self.head = self.head or self.form.parse(self.lines)
        return self.form.atom(self.head, self.since - self.form.head - 1, line)


SUMMARY = "file string, block long, starts int, first_starts boolean, lines long, head array<string>, since long, tail array<string>"


def _summaries(lines: DataFrame, form) -> DataFrame:
    """A row for each byte range: how many frames start there, its first lines, and where its last frame stands at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept = None, None

        def row() -> tuple:
            frame, n, first, head = kept
            return (*now, frame.number + 1, first, n, head, frame.since, frame.lines)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            frame = pd.DataFrame(rows, columns=["file", "block", "starts", "first_starts", "lines", "head", "since", "tail"])
            return pa.RecordBatch.from_pandas(frame.astype({"starts": "int32"}), preserve_index=False)

        for b in batches:
            done = []
            for file, block, line in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if (file, block) != now:
                    if now:
                        done.append(row())
                    now, kept = (file, block), [_Frame(form), 0, False, []]
                frame, n, first, head = kept
                if len(head) < form.head + 1:
                    head.append(line)
                frame.take(line)
                if n == 0:
                    kept[2] = frame.number == 0
                if line.strip() or n == 0:  # a header may be empty, and stands second
                    kept[1] = n + 1
            if done:
                yield batch(done)
        if now:
            yield batch([row()])

    return lines.mapInArrow(run, SUMMARY)


def _carried(summaries: DataFrame, form) -> DataFrame:
    """file, block, number, since, lines: the frame that is open where a byte range begins. A file's ranges meet in one task,
    a row of about a kilobyte each."""

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        out, open_ = [], _Frame(form)
        for r in f.sort_values("block").itertuples():
            out.append((r.file, r.block, open_.number, open_.since, list(open_.lines)))
            starts, head = r.starts, list(r.head)
            if r.first_starts and not form.starts(head[0], open_.since):
                starts -= 1  # what looked like a start is a header
            if starts:
                open_ = _Frame(form, open_.number + starts, r.since, list(r.tail))
            else:
                missing = form.head - len(open_.lines)
                open_ = _Frame(form, open_.number, open_.since + r.lines if open_.since else 0, [*open_.lines, *head[:missing]] if open_.since else [])
        return pd.DataFrame(out, columns=["file", "block", "number", "since", "lines"])

    return summaries.groupBy("file").applyInPandas(run, "file string, block long, number int, since long, lines array<string>")


def frames_of(spark: SparkSession, path: str | list[str], fmt: str, ext: str | None = None, headers: bool = False) -> DataFrame:
    """ATOMS, or with ``headers`` FRAMES, of files or of all files below folders (with ``ext`` only those with this ending).

    The carried states are broadcast: a kilobyte for each byte range (``spark.sql.files.maxPartitionBytes``), so a thousandth of a
    percent of the input. Lines keep their order within a range since nothing before the parser deals them anew.
    """
    if fmt not in FORMATS:
        raise ValueError(f"formats are {', '.join(FORMATS)}, not {fmt}")
    form = FORMATS[fmt]
    reader = spark.read.option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", f"*{ext}") if ext else reader
    text = reader.text(path)
    lines = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    carried = checkpoint(_carried(_summaries(lines, form), form))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, frame = None, None
        for b in batches:
            rows = []
            for file, block, line, number, since, lines in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if (file, block) != now:
                    now, frame = (file, block), _Frame(form, number, since, lines)
                kind = frame.take(line)
                if kind == "atom" and not headers:
                    rows.append((file, frame.number, *frame.atom(line)))
                elif kind == "head" and headers:
                    h = form.parse(frame.lines)
                    rows.append((file, frame.number, h["n"], h["lattice"], h["pbc"], list(h["info"].items())))
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    if headers:
        names, kinds = ["file", "frame_id", "n_atoms", "lattice", "pbc", "info"], [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.bool_()), pa.map_(pa.string(), pa.string())]
    else:
        names, kinds = ["file", "frame_id", "atom_id", "species", "type_id", "x", "y", "z"], [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), *[pa.float64()] * 3]
    met = lines.join(F.broadcast(carried.withColumnRenamed("lines", "head")), ["file", "block"])
    return met.select("file", "block", "value", "number", "since", "head").mapInArrow(run, FRAMES if headers else ATOMS)


@dataclass
class FrameRun(InputPartition):
    """Frames of one file: (frame number, byte offset) in order."""

    path: str
    frames: list[tuple[int, int]]


def files_under(path: str, ext: str | None) -> list[str]:
    """The file itself, or all files below a folder with this ending."""
    if not os.path.isdir(path):
        return [path]
    found = [os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(ext or "")]
    return sorted(found)


def _offsets(form, path: str, at: int = 0, closed: bool = False) -> Iterator[tuple[int, int]]:
    """Begin and end of each whole frame of a file from a byte on; with ``closed`` the last line has to be ended, too, as a file
    that is still being written may stop anywhere."""
    with open(path, "rb") as f:
        f.seek(at)
        while True:
            begin = f.tell()
            head = [f.readline().decode() for _ in range(form.head)]
            if not head[0].strip() or not head[-1].endswith("\n"):
                return
            n = int(head[0]) if form is ExtXyz else int(head[3])
            last = b""
            for _ in range(n):
                last = f.readline()
            if n and not last.strip() or closed and not last.endswith(b"\n"):
                return
            yield begin, f.tell()


def _frame_rows(form, lines, path: str, number: int, headers: bool) -> Iterator[tuple]:
    head = [lines.readline().decode() for _ in range(form.head)]
    h = form.parse(head)
    if headers:
        yield path, number, h["n"], h["lattice"], h["pbc"], h["info"]
        return
    for i in range(h["n"]):
        yield (path, number, *form.atom(h, i, lines.readline().decode()))


class _Reader(DataSourceReader):
    def __init__(self, form, options: dict):
        self.form, self.path, self.ext = form, options["path"], options.get("ext")
        self.per_task = int(options.get("framesPerTask", 16))
        self.headers = options.get("frames", "false").lower() == "true"
        self.wanted: list[Filter] = []

    def pushFilters(self, filters: list[Filter]):  # noqa: N802 - Spark's name
        kinds = (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, In)
        for f in filters:
            if isinstance(f, kinds) and tuple(f.attribute) == ("frame_id",):
                self.wanted.append(f)
            else:
                yield f

    def _keeps(self, frame: int) -> bool:
        tests = {
            EqualTo: lambda f: frame == f.value, GreaterThan: lambda f: frame > f.value, GreaterThanOrEqual: lambda f: frame >= f.value,
            LessThan: lambda f: frame < f.value, LessThanOrEqual: lambda f: frame <= f.value, In: lambda f: frame in f.value,
        }
        return all(tests[type(f)](f) for f in self.wanted)

    def partitions(self):
        out = []
        for path in files_under(self.path, self.ext):
            kept = [(i, begin) for i, (begin, _) in enumerate(_offsets(self.form, path)) if self._keeps(i)]
            out += [FrameRun(path, kept[i : i + self.per_task]) for i in range(0, len(kept), self.per_task)]
        return out or [FrameRun("", [])]

    def read(self, partition):
        if not partition.frames:
            return
        with open(partition.path, "rb") as f:
            for number, at in partition.frames:
                f.seek(at)
                yield from _frame_rows(self.form, f, partition.path, number, self.headers)


class _StreamReader(DataSourceStreamReader):
    """Offsets are {file: [frames, bytes]}: what is whole so far. Only what was added since is looked at again."""

    def __init__(self, form, options: dict):
        self.form, self.path, self.ext = form, options["path"], options.get("ext")
        self.per_task = int(options.get("framesPerTask", 16))
        self.headers = options.get("frames", "false").lower() == "true"
        self.seen: dict[str, list[int]] = {}

    def initialOffset(self) -> dict:  # noqa: N802 - Spark's name
        return {}

    def latestOffset(self) -> dict:  # noqa: N802 - Spark's name
        for path in files_under(self.path, self.ext):
            n, at = self.seen.get(path, [0, 0])
            for _, end in _offsets(self.form, path, at, closed=True):
                n, at = n + 1, end
            if n:
                self.seen[path] = [n, at]
        return {k: list(v) for k, v in self.seen.items()}

    def partitions(self, start: dict, end: dict):
        out = []
        for path, (n, _) in sorted(end.items()):
            first, at = start.get(path, [0, 0])
            added = [(first + i, begin) for i, (begin, _) in zip(range(n - first), _offsets(self.form, path, at), strict=False)]
            out += [FrameRun(path, added[i : i + self.per_task]) for i in range(0, len(added), self.per_task)]
        return out or [FrameRun("", [])]

    read = _Reader.read

    def commit(self, end: dict) -> None:
        """Nothing is kept outside the query's own offsets."""


class _Structures(DataSource):
    form: type

    def schema(self) -> str:
        return FRAMES if self.options.get("frames", "false").lower() == "true" else ATOMS

    def reader(self, schema):
        return _Reader(self.form, self.options)

    def streamReader(self, schema):  # noqa: N802 - Spark's name
        return _StreamReader(self.form, self.options)


class ExtXyzSource(_Structures):
    form = ExtXyz

    @classmethod
    def name(cls) -> str:
        return "extxyz"


class LammpsSource(_Structures):
    form = Lammps

    @classmethod
    def name(cls) -> str:
        return "lammps-dump-text"


def register(spark) -> None:
    """Make both formats known to a session."""
    spark.dataSource.register(ExtXyzSource)
    spark.dataSource.register(LammpsSource)
