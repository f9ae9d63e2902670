"""Repair of conversations to the role order ``(system? (user assistant)+)?`` at the least cost.

Rows are numbered within their conversation (ranges of rows and running totals, so a conversation of any size is spread
over tasks) and marked with their first fault: blank, duplicate or truncated. A chunk of a conversation's rows becomes a
signature, a letter a row for its role and what its fault asks for. Each different signature is solved once by memoised recursion
over (row, state of the grammar); its audit is joined back to all chunks that look the same, and the edits are replayed on the rows.

Most conversations are one chunk. For longer ones the costs between the states at a chunk's ends are passed from the last
chunk to the first, a chunk is solved for what the rest costs from each state, and states are handed on from the first to the
last: only rows per chunk meet in one task, never the conversation. The checksum of a repaired conversation is taken from sorted rows one by one.

Edits, by their letter in an audit: Keep 0; Rerole to user or assistant 3; Delete 4, which blank and duplicate rows need;
Insert a user or assistant row with an empty text 3; a truncated row that stays costs 3 more. Of audits of equal cost the
ASCII-least counts: their first letters differ wherever they part, so choosing the least letter at each row gives it.

Nulls in role and text read as one space, so such a role can not be kept. Rows without a turn come first; rows of the same
turn are ordered by role and text; a null id is a conversation of its own. Texts of any length are compared by SHA-256 of
role and text. A conversation without rows has an empty repair. An empty table gives an empty table, other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scan import numbered
from .common import checkpoint

#: What counts as white space, and what ends a whole text.
SPACES, ENDS = "\x20\x09\x0a\x0b\x0c\x0d", ".!?"

#: States of the grammar: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
NEVER = 1 << 40
#: What the end costs from each state.
GOAL = (0, NEVER, NEVER, 0)


@dataclass(frozen=True)
class Settings:
    """``chunk`` rows make a signature; costs of the edits."""

    chunk: int = 1024
    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3


def _steps(state: int) -> tuple[str, int]:
    """The role that an inserted or reroled row has to have, by its initial, and the state after it."""
    return ("a", ASSISTANT) if state == USER else ("u", USER)


def solve(signature: str, goal: tuple[int, ...], last: bool, settings: Settings = Settings()) -> list[tuple[int, str, str, int]]:
    """For each state before the signature: cost without the goal's, audit, plan and state after it.

    A signature has s, u, a, o for roles, in capitals where truncated, and 1 to 4 for the same roles where the row has to go.
    ``goal`` is the cost of what follows from each state; rows are inserted behind the signature only if it is the ``last``.
    The plan tells roles as well: d, k, U and A for a row that is reroled, u and a for one that is inserted.
    """
    n = len(signature)

    @cache
    def best(i: int, state: int, inserts: int) -> tuple[int, str, str, int, int, int]:
        """cost, letter, step, and the next call's arguments; letter '' at the end."""
        role, after = _steps(state)
        options: list[tuple[int, str, str, int, int, int]] = []
        if i == n:
            options.append((goal[state], "", "", i, state, 0))
        else:
            mark = signature[i]
            options.append((settings.delete + best(i + 1, state, 2)[0], "D", "d", i + 1, state, 2))
            if mark.isalpha():
                whole = settings.truncated if mark.isupper() else 0
                options.append((settings.rerole + whole + best(i + 1, after, 2)[0], "R", role.upper(), i + 1, after, 2))
                if mark.lower() == role or mark.lower() == "s" and state == START:
                    to = SYSTEM if mark.lower() == "s" else after
                    options.append((whole + best(i + 1, to, 2)[0], "K", "k", i + 1, to, 2))
        if inserts and (i < n or last):
            options.append((settings.insert + best(i, after, inserts - 1)[0], "I", role, i, after, inserts - 1))
        return min(options)

    for i in range(n, -1, -1):  # from the end, so that no call goes deep
        for state in range(4):
            best(i, state, 2)
    out = []
    for entry in range(4):
        audit, plan, at = [], [], (0, entry, 2)
        while (step := best(*at))[1]:
            audit.append(step[1])
            plan.append(step[2])
            at = step[3:]
        total, end = best(0, entry, 2)[0], at[1]
        out.append((NEVER if total >= NEVER else total - goal[end], "".join(audit), "".join(plan), end))
    return out


def illegal_pairs(signature: str) -> int:
    roles = signature.lower().translate(str.maketrans("1234", "suao"))
    return sum(roles[i : i + 2] not in ("su", "ua", "au") for i in range(len(roles) - 1))


def key(conv_id: Column) -> Column:
    """A string for each id, null included."""
    return F.when(conv_id.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), conv_id.cast("string")))


def damage(rows: DataFrame) -> DataFrame:
    """Rows (k, conv_id, turn, role, text) with faults by their checksum modulo 20: 0 drops a row, 1 empties its text, 2 takes its sentence
    ends, 3 repeats it, 4 makes it the user's."""
    blank = F.lit(" ")
    h = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank)).cast("binary")) % 20
    text = F.when(h == 1, F.lit("")).when(h == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(h == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(h == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where(h != 0).select("k", "conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("__copy")).drop("__copy")


def prepared(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """k, conv_id, turn, role, text without nulls in role and text."""
    c = {n: F.col(f"`{x}`") for n, x in (("conv_id", conv_id), ("turn", turn), ("role", role), ("text", text))}
    return conversations.select(key(c["conv_id"]).alias("k"), c["conv_id"].alias("conv_id"), c["turn"].alias("turn"), *[F.coalesce(c[n].cast("string"), F.lit(" ")).alias(n) for n in ("role", "text")])


def ordered(rows: DataFrame) -> DataFrame:
    """k, pos, turn, role, text, same: rows numbered within their conversation; ``same`` is equal for equal role and text."""
    same = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    return numbered(rows.select("k", "turn", "role", "text", same.alias("same")), ["turn", "role", "text"], "pos", ["k"])


def marked(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """k, pos, turn, chunk, fault, mark of ordered rows."""
    again = rows.groupBy("k", "same").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = rows.join(again, ["k", "same"], "left")
    ending = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    fault = F.when(ending == "", F.lit("blank")).when(F.col("first") < F.col("pos"), F.lit("duplicate")).when(~ending.isin(*ENDS), F.lit("truncated"))
    initial = F.left("role", F.lit(1))
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("o"))
    mark = F.when(F.col("fault").isin("blank", "duplicate"), F.translate(initial, "suao", "1234")).when(F.col("fault") == "truncated", F.upper(initial)).otherwise(initial)
    chunk = F.floor(F.col("pos") / settings.chunk).cast("long")
    return checkpoint(met.withColumn("fault", fault).select("k", "pos", "turn", chunk.alias("chunk"), "fault", mark.alias("mark")))


def signatures(marks: DataFrame) -> DataFrame:
    """k, chunk, signature, n (rows), last."""
    letters = F.transform(F.array_sort(F.collect_list(F.struct("pos", "mark"))), lambda x: x["mark"])
    chunks = marks.groupBy("k", "chunk").agg(F.array_join(letters, "").alias("signature"), F.count("*").alias("n"))
    ends = chunks.groupBy("k").agg(F.max("chunk").alias("end"))
    return checkpoint(chunks.join(ends, "k").select("k", "chunk", "signature", "n", (F.col("chunk") == F.col("end")).alias("last")))


SOLVED = "signature string, goal array<long>, last boolean, entry int, cost long, audit string, plan string, exit int, illegal long"


def solved(asked: DataFrame, settings: Settings) -> DataFrame:
    """SOLVED for each different (signature, goal, last) and each state before it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for signature, goal, last in zip(f["signature"], f["goal"], f["last"], strict=True):
                illegal = illegal_pairs(signature)
                rows += [(signature, goal, last, e, *x, illegal) for e, x in enumerate(solve(signature, tuple(int(g) for g in goal), bool(last), settings))]
            yield pd.DataFrame(rows, columns=["signature", "goal", "last", "entry", "cost", "audit", "plan", "exit", "illegal"])

    return checkpoint(asked.select("signature", "goal", "last").distinct().mapInPandas(run, SOLVED))


def _goals(chunks: DataFrame, settings: Settings) -> DataFrame:
    """k, chunk, goal: what the rest of a conversation costs from each state after the chunk, less the least of them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for signature, last in zip(f["signature"], f["last"], strict=True):
                ends = [GOAL] if last else [tuple(0 if s == end else NEVER for s in range(4)) for end in range(4)]
                found = [solve(signature, g, bool(last), settings) for g in ends]
                rows.append((signature, last, [min(NEVER, x[entry][0]) for x in found for entry in range(4)]))
            yield pd.DataFrame(rows, columns=["signature", "last", "costs"])

    costs = chunks.select("signature", "last").distinct().mapInPandas(run, "signature string, last boolean, costs array<long>")

    def back(group: tuple, f: pd.DataFrame) -> pd.DataFrame:
        rest, out = GOAL, []
        for chunk, last, c in sorted(zip(f["chunk"], f["last"], f["costs"], strict=True), reverse=True):
            out.append((*group, chunk, list(rest)))
            ways = [c] if last else [[x + rest[end] for x in c[4 * end : 4 * end + 4]] for end in range(4)]
            least = [min(NEVER, *(int(w[e]) for w in ways)) if len(ways) > 1 else int(ways[0][e]) for e in range(4)]
            rest = tuple(x if x >= NEVER else x - min(least) for x in least)
        return pd.DataFrame(out, columns=["k", "chunk", "goal"])

    met = chunks.join(costs, ["signature", "last"]).select("k", "chunk", "last", "costs")
    return checkpoint(met.groupBy("k").applyInPandas(back, "k string, chunk long, goal array<long>"))


def _entered(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """k, chunk, entry: the state before each chunk."""

    def forth(group: tuple, f: pd.DataFrame) -> pd.DataFrame:
        state, out = START, []
        for chunk, exits in sorted(zip(f["chunk"], f["exits"], strict=True), key=lambda x: x[0]):
            out.append((*group, chunk, state))
            state = int(exits[state])
        return pd.DataFrame(out, columns=["k", "chunk", "entry"])

    ways = found.groupBy("signature", "goal", "last").agg(F.transform(F.array_sort(F.collect_list(F.struct("entry", "exit"))), lambda x: x["exit"]).alias("exits"))
    met = chunks.join(ways, ["signature", "goal", "last"]).select("k", "chunk", "exits")
    return met.groupBy("k").applyInPandas(forth, "k string, chunk long, entry int")


def audited(chunks: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """k, chunk, n, signature, cost, audit, plan, illegal of signatures, each solved for what follows it."""
    goal = F.array(*[F.lit(x).cast("long") for x in GOAL])
    single = chunks.where("last and chunk = 0").withColumn("goal", goal)
    several = chunks.where("not (last and chunk = 0)")
    if several.isEmpty():
        asked, entries = single, single.select("k", "chunk", F.lit(START).alias("entry"))
        found = solved(asked, settings)
    else:
        longer = several.join(_goals(several, settings), ["k", "chunk"])
        asked = checkpoint(single.unionByName(longer))
        found = solved(asked, settings)
        entries = single.select("k", "chunk", F.lit(START).alias("entry")).unionByName(_entered(longer, found))
    met = asked.join(entries, ["k", "chunk"]).join(found, ["signature", "goal", "last", "entry"])
    return checkpoint(met.select("k", "chunk", "n", "signature", "cost", "audit", "plan", "illegal"))


def repaired(rows: DataFrame, audits: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """k, pos, lines: the edits replayed on ordered rows; ``lines`` are the ``role:text`` that stand at a row's place afterwards."""
    steps = F.regexp_extract_all("plan", F.lit("[ua]*[dkUA]|[ua]+"), F.lit(0))
    flat = audits.select("k", "chunk", F.posexplode(steps).alias("at", "step")).withColumn("pos", F.col("chunk") * settings.chunk + F.col("at"))
    met = flat.join(rows.select("k", "pos", "role", "text"), ["k", "pos"], "left")  # what is inserted at the end has no row
    added = F.transform(F.split(F.regexp_extract("step", "^[ua]*", 0), ""), lambda x: F.when(x == "u", F.lit("user:")).when(x == "a", F.lit("assistant:")))
    kind = F.right("step", F.lit(1))
    role = F.when(kind == "k", F.col("role")).when(kind == "U", F.lit("user")).when(kind == "A", F.lit("assistant"))
    lines = F.filter(F.concat(added, F.array(F.concat(role, F.lit(":"), "text"))), lambda x: x.isNotNull())
    return met.select("k", "pos", lines.alias("lines")).where(F.size("lines") > 0)


def checksums(lines: DataFrame) -> DataFrame:
    """k, sha256 of all lines in order, joined by newlines; a task holds a batch of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, hashlib.sha256()
        for b in batches:
            done = []
            for k, found in zip(b.column("k").to_pylist(), b.column("lines").to_pylist(), strict=True):
                if k != now:
                    if now is not None:
                        done.append((now, state.hexdigest()))
                    now, state = k, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update("\n".join(found).encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["k", "sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], ["k", "sha256"])

    dealt = lines.repartition("k").sortWithinPartitions("k", "pos")
    return dealt.select("k", "lines").mapInArrow(run, "k string, sha256 string")


def report(conversations: DataFrame, settings: Settings = Settings(), damaging: bool = False, **columns: str) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    ``damaging`` puts ``damage`` before it; ``columns`` name conv_id, turn, role and text. ``repaired`` gives the rows themselves.
    """
    given = prepared(conversations, **columns)
    heads = given.groupBy("k").agg(F.first("conv_id").alias("conv_id"))
    rows = ordered(damage(given) if damaging else given)
    marks = marked(rows, settings)
    turns = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    count = [F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")]
    stats = marks.groupBy("k").agg(F.coalesce(turns, F.lit(0)).cast("long").alias("gaps"), *count)
    audits = audited(signatures(marks), settings)
    ends = F.translate(F.lower("signature"), "1234", "suao")
    w = Window.partitionBy("k").orderBy("chunk")
    between = F.concat(F.lag(F.right(ends, F.lit(1))).over(w), F.left(ends, F.lit(1)))
    seams = audits.select("k", "chunk", "cost", "audit", (F.col("illegal") + F.coalesce((~between.isin("su", "ua", "au")).cast("long"), F.lit(0))).alias("illegal"))
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "audit"))), lambda x: x["audit"]), "")
    totals = seams.groupBy("k").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), audit.alias("audit"))
    sums = checksums(repaired(rows, audits, settings))
    joined = heads.join(stats, "k", "left").join(totals, "k", "left").join(sums, "k", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return joined.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", empty).alias("repaired_sha256"))
