"""License scan: one Aho-Corasick pass finds notice phrases and identifier tags, a shunting-yard parser reads expressions.

Words are lower-cased A-Z runs of the word rule in ``common``. Phrases match whole consecutive words, so line breaks and
punctuation between them do not matter; overlapping places all count. An expression begins where the automaton saw its
tag end, behind a colon, or without one if it names a known family, and ends with its
line, at a mark that no identifier has (as those that close comments), at the end of a sentence or before prose.

Null and empty texts have no words, no labels and score 0. Texts are scanned whole, however long. Repeated rows are scanned
alike and all stay, an empty table gives an empty table, and kept columns that are called like a result are replaced by it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_WORDS

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further notice phrases, their labels and how surely each alone speaks of a licence.
NOTICES = {
    "apache license": ("apache", 0.9),
    "mit license": ("mit", 0.9),
    "bsd license": ("bsd", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "lesser general public license": ("lgpl", 0.9),
    "affero general public license": ("agpl", 0.9),
    "cc by nc": ("cc-by-nc", 0.9),
    "cc by sa": ("cc-by-sa", 0.9),
    "cc by nd": ("cc-by-nd", 0.9),
    "cc0": ("cc0", 0.7),
    "creative commons": ("cc", 0.7),
    "public domain": ("public-domain", 0.5),
    "permission is hereby granted free of charge": ("mit", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "licensed under": ("notice", 0.4),
    "released under": ("notice", 0.3),
}
BASE_WEIGHT = {"cc-by": 0.8, "gpl": 0.9, "reserved": 0.8}
#: Fixed value: the tag, as words.
TAG = "spdx license identifier"
#: Families of identifiers by how they begin, copyleft and permissive ones.
COPYLEFT = frozenset("agpl cc-by-sa cddl cecill epl eupl gpl lgpl mpl osl".split())
PERMISSIVE = frozenset("0bsd apache bsd bsl cc-by cc0 isc mit ncsa postgresql psf python unlicense wtfpl x11 zlib".split())
AFTER_TAG = re.compile(r"[ \t]*(:?)[ \t]*([^\r\n]*)")
WORD = re.compile(rb"[^ ]+")
TOKEN = re.compile(r"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
LATER = re.compile(r"[ \t]+or[ \t]+(?:any[ \t]+)?later(?:[ \t]+version)?\b", re.I)
PRECEDENCE = {"OR": 1, "AND": 2, "WITH": 3}


def tokens_of(text: str) -> Iterator[str]:
    """Brackets, operators (all capitals or all small) and identifiers up to the first mark or end of sentence; an identifier
    and "or later" are one."""
    at = 0
    while m := TOKEN.match(text, at):
        token, at = m[1].rstrip(".:-"), m.end()
        if token == m[1] and token not in "()" and (later := LATER.match(text, at)):
            yield f"{token}-or-later"
            at = later.end()
            continue
        yield token.upper() if token in ("or", "and", "with") else token
        if token != m[1]:
            return


def to_postfix(text: str) -> list[str]:
    """Shunting-yard: infix tokens to postfix; ``WITH`` binds before ``AND`` before ``OR``. What follows a whole expression is
    prose and ends it. Raises ValueError if an operand or a bracket is missing."""
    out: list[str] = []
    stack: list[str] = []
    operand_next = True
    for token in tokens_of(text):
        if operand_next:
            if token in PRECEDENCE or token == ")":
                raise ValueError(text)
            if token == "(":
                stack.append(token)
            else:
                out.append(token)
                operand_next = False
        elif token == ")" and "(" in stack:
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif token in PRECEDENCE:
            while stack and PRECEDENCE.get(stack[-1], 0) >= PRECEDENCE[token]:
                out.append(stack.pop())
            stack.append(token)
            operand_next = True
        else:
            break
    if operand_next or "(" in stack:
        raise ValueError(text)
    return out + stack[::-1]


def is_copyleft(name: str) -> bool | None:
    """By the longest known beginning of an identifier; None for identifiers of no known family."""
    parts = name.lower().replace("+", "-").split("-")
    if parts[:2] == ["cc", "by"] and {"nc", "nd"} & set(parts):
        return None
    for k in range(len(parts), 0, -1):
        begin = "-".join(parts[:k])
        if begin in COPYLEFT or begin in PERMISSIVE:
            return begin in COPYLEFT
    return None


def evaluate(text: str) -> tuple[list[str], bool | None]:
    """(identifiers, copyleft) of an expression: AND binds if either side does, OR frees if either side does, WITH is as its
    left side; None where identifiers of no known family leave it open."""
    stack: list[bool | None] = []
    names: list[str] = []
    for token in to_postfix(text):
        if token in PRECEDENCE:
            b, a = stack.pop(), stack.pop()
            if token == "WITH":
                stack.append(a)
            else:
                leading = token == "AND"  # the value that one side alone decides
                stack.append(leading if leading in (a, b) else None if None in (a, b) else not leading)
        else:
            names.append(token.lower())
            stack.append(is_copyleft(token))
    return names, stack[-1]


def _automaton() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for phrase in [*BASE, *NOTICES, TAG]:
        machine.add_word(f" {phrase} ", phrase)
    machine.make_automaton()
    return machine


def expressions(raw: bytes, spread: bytes, places: list[int]) -> Iterator[tuple[str, bool]]:
    """What follows each tag up to its line's end, and whether a colon stands between. ``spread`` is the text with spaces between its words,
    byte for byte, so the word that ends a tag (its place among the words) has the same offset in both."""
    wanted = set(places)
    for place, word in enumerate(WORD.finditer(spread)):
        if place in wanted:
            m = AFTER_TAG.match(raw[word.end() :].split(b"\n", 1)[0].decode("utf-8", "replace"))
            yield m[2], bool(m[1])


def scan(text: str | None, machine: ahocorasick.Automaton) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of one text."""
    raw = (text or "").encode("utf-8", "replace")
    spread = raw.translate(BYTE_WORDS)
    words = spread.split()
    line = " " + b" ".join(words).decode("latin-1") + " "  # one character a byte: phrases are ASCII
    base: set[str] = set()
    labels: set[str] = set()
    starts: list[int] = []
    tags: list[int] = []
    doubt, at, n_before = 1.0, 0, 0
    for end, phrase in machine.iter(line):
        if phrase in BASE or phrase == TAG:
            begin = end - len(phrase) - 1
            if begin < at:
                n_before, at = 0, 0
            n_before, at = n_before + line.count(" ", at, begin), begin
        if phrase in BASE:
            starts.append(n_before)
            base.add(BASE[phrase])
        elif phrase == TAG:
            tags.append(n_before + 2)  # the place of its last word
        else:
            label, weight = NOTICES[phrase]
            if label not in labels:
                doubt *= 1 - weight
            labels.add(label)
    for label in base:
        doubt *= 1 - BASE_WEIGHT[label]
    for found, colon in expressions(raw, spread, tags) if tags else ():
        try:
            names, copyleft = evaluate(found)
        except ValueError:
            if colon:
                labels.add("spdx-malformed")
                doubt *= 0.5
            continue
        if not colon and all(is_copyleft(n) is None for n in names):
            continue  # prose about identifiers
        labels.update(f"spdx:{n}" for n in names)
        labels.add("spdx-unlisted" if copyleft is None else "copyleft" if copyleft else "permissive")
        doubt *= 0.5 if copyleft is None else 0.0
    return (
        len(words),
        len(starts),
        min(starts, default=None),
        max(starts, default=None),
        ",".join(sorted(base)),
        ",".join(sorted(base | labels)),
        1.0 - doubt,
    )


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and the scan's; a pure map, without a shuffle."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    keep = tuple(c for c in keep if c.lower() not in names)
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton()
        for batch in batches:
            rows = [scan(t.as_py(), machine) for t in batch.column(len(keep))]
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            arrays = [*batch.columns[: len(keep)], *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, *names])

    return source.mapInArrow(run, f"{kept}, {SCHEMA}" if kept else SCHEMA)
