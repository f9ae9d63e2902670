"""Neighbour graphs against all pairs, spelling variants and repairs against plain searches, odd rows of each."""

import heapq
import itertools
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from voidloom.llm import conversations, nearest_graph, spelling
from voidloom.llm.common import checkpoint, table

VECTORS = "vec_id long, embedding array<double>, node long, q int"


def all_pairs(rows, is_query, k):
    """query row -> (vec_id, score) of its nearest, from (vec_id, vector) rows."""
    out = []
    for i, (q, v) in enumerate(rows):
        if is_query(q):
            scores = [(-float(np.dot(v, w)), x) for j, (x, w) in enumerate(rows) if j != i and len(w) == len(v)]
            out.append((q, sorted(scores)[:k]))
    return out


def test_op11_recall_and_scores(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in vectors.collect()]
    settings = nearest_graph.Settings(leaf_rows=32, links=24, trees=2, beam=96, shard_rows=100, part_rows=40)  # hubs in parts
    found = {}
    for r in nearest_graph.nearest(vectors, F.col("vec_id") % 20 == 0, settings).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], -r["score"], r["vec_id"]))
    hits = 0
    want = all_pairs(rows, lambda i: i % 20 == 0, 20)
    assert set(found) == {q for q, _ in want}
    known = dict(rows)
    for q, best in want:
        got = sorted(found[q])
        assert [r for r, *_ in got] == list(range(1, 21)) and [x[1:] for x in got] == sorted(x[1:] for x in got)
        assert all(abs(-s - float(known[q] @ known[v])) < 1e-12 for _, s, v in got)
        hits += len({v for _, v in best} & {v for *_, v in got})
    assert hits >= 0.95 * 20 * len(want)


def test_op11_copies_sizes_nulls_and_clashes(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6) * (1 + i % 3)) for i in range(60)]
    rows += [(100 + i, np.arange(1.0, 7.0)) for i in range(50)]  # a large group of copies
    rows += [(7, np.arange(1.0, 7.0)), (7, np.arange(1.0, 7.0)), (200, np.ones(2)), (220, np.ones(2) * 3)]  # repeated ids, another size
    odd = [(None, [1.0] * 6), (240, None), (260, [0.0] * 6), (280, [1.0, None] + [0.0] * 4), (300, [float("nan")] + [1.0] * 5), (320, [float("inf")] * 6), (340, [])]
    data = [(i, v.tolist(), 1, 1) for i, v in rows] + [(i, v, 2, 2) for i, v in odd]
    found = nearest_graph.nearest(spark.createDataFrame(data, VECTORS), F.col("vec_id") % 20 == 0, nearest_graph.Settings(k=5))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in found.collect())
    want = [(q, n + 1, v, round(-s, 9)) for q, best in all_pairs(rows, lambda i: i % 20 == 0, 5) for n, (s, v) in enumerate(best)]
    assert got == sorted(want)
    own = nearest_graph.nearest(spark.createDataFrame(data, VECTORS), F.col("vec_id") == 7, nearest_graph.Settings(k=5)).where("score > 90")
    assert sorted((r["rank"], r["vec_id"]) for r in own.collect() if r["vec_id"] == 7) == [(1, 7), (1, 7)]  # each meets the other, not itself


def test_op11_empty_table(spark):
    none = spark.createDataFrame([], VECTORS)
    assert nearest_graph.nearest(none, F.col("vec_id") % 20 == 0).collect() == []


def plain_words(docs):
    counts = Counter()
    for i, text in docs:
        run = ""
        for c in (text or "") + "\n":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
            elif run:
                h = crc32(f"{'' if i is None else i}:{run}".encode())
                counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
                run = ""
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words):
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=lambda r: r[0])


def test_op12_against_all_pairs_of_words(spark):
    rng = random.Random(3)
    stems = ["color", "colour", "aaaaaa", "aaaaaaa", "ébène", "ebène", "grey", "theater", "theatre", "organise"]
    docs = [(1, None), (None, "Color COLOR color"), (2, ""), (2, "straße strasse Straße straße"), (3, "colour " * 30), (4, "chains " * 40 + "chainsx " * 12 + "chainsxy " * 4)]
    for i in range(300):
        words = [rng.choice(stems) for _ in range(20)]
        words = [w if rng.random() < 0.6 else w[: (k := rng.randrange(len(w)))] + rng.choice(["", "a", "é", "x"]) + w[k + rng.randrange(2) :] for w in words]
        docs.append((i, rng.choice([" ", "-", "7"]).join(w.upper() if rng.random() < 0.1 else w for w in words)))
    words = plain_words(docs)
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], "doc_id long, text string, word string, id int, n int")
    got = spelling.spelling_variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[0]) == plain_variants(words)
    assert sum(r["form"] is not None for r in got) > 20 and any(r["root"] != r["form"] for r in got if r["form"])


def test_op12_very_long_words_and_empty_tables(spark):
    long = "ab" * 50_000
    docs = [(i, f"{long} {long} {long}x {long[:777]}{long[778:]}") for i in range(4)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {len(r["word"]): r for r in spelling.spelling_variants(df, every=0).collect()}
    assert {n: (r["n"], r["n_near"], r["form"] == long) for n, r in got.items()} == {100_000: (8, 2, False), 100_001: (4, 1, True), 99_999: (4, 1, True)}
    assert spelling.spelling_variants(df.limit(0)).collect() == []


def test_op12_sends_no_words_whole_through_the_driver(spark, monkeypatch):
    plans = []

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return checkpoint(df)

    monkeypatch.setattr(spelling, "checkpoint", kept)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") not in ("-1", "256k")  # these words are far below the limit
    found = spelling.variants(spark.createDataFrame([("chains",)] * 9 + [("chainsx",)] * 3, "word string"))
    kept(found)
    assert sum(p.count("SortMergeJoin") for p in plans) >= 6 and not any("Broadcast" in p for p in plans)
    assert {(r["word"], r["root"]) for r in found.collect()} == {("chains", "chains"), ("chainsx", "chains")}


def cheapest(rows, states="suao"):
    """Least (cost, audit) by search over all edits; rows: (initial, must go, truncated)."""
    best, queue = {}, [(0, "", 0, 0)]
    while queue:
        cost, audit, i, state = heapq.heappop(queue)
        if i == len(rows) and state in (0, 3):
            return cost, audit
        if best.setdefault((i, state), (cost, audit)) < (cost, audit):
            continue
        after = 3 if state == 2 else 2
        heapq.heappush(queue, (cost + 3, audit + "I", i, after))
        if i < len(rows):
            initial, must, more = rows[i]
            heapq.heappush(queue, (cost + 4, audit + "D", i + 1, state))
            if not must:
                heapq.heappush(queue, (cost + 3 * more + 3, audit + "R", i + 1, after))
                if initial == ("a" if state == 2 else "u"):
                    heapq.heappush(queue, (cost + 3 * more, audit + "K", i + 1, after))
                if initial == "s" and state == 0:
                    heapq.heappush(queue, (cost + 3 * more, audit + "K", i + 1, 1))
    raise AssertionError


LETTERS = {(r, must, more): ("1234"["suao".index(r)] if must else r.upper() if more else r) for r in "suao" for must in (False, True) for more in (0, 1)}


def test_op13_every_short_signature_and_long_ones():
    marks = sorted(set(LETTERS))
    rng = random.Random(1)
    cases = list(itertools.product(marks, repeat=2)) + [tuple(rng.choice(marks) for _ in range(rng.randrange(3, 9))) for _ in range(600)]
    for rows in [(), *cases]:
        cost, audit, plan, end = conversations.solve("".join(LETTERS[r] for r in rows), conversations.GOAL, True)[0]
        assert (cost, audit) == cheapest(rows) and end in (0, 3) and len(plan) == len(audit)
    assert conversations.solve("ua" * 5000, conversations.GOAL, True)[0][:2] == (0, "K" * 10000)


CHATS = "conv_id long, turn long, role string, text string, k string, pos int"


def chats(spark, seed=2):
    rng = random.Random(seed)
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (900, None, "user", "A?"), (900, None, "user", "A?"), (901, 5, "tool", ""), (902, 1, "", "x" * 100_000)]
    for c in range(60):
        for t in range(rng.randrange(1, 30)):
            rows.append((c, rng.choice([t, t, t, t + 2, None]), rng.choice(["user", "assistant", "assistant", "system", "unknown", "Σ"]), rng.choice([f"Text {t}.", "Again!", "cut", " \t\n", "Well? ", "end.\n", ""])))
    return spark.createDataFrame([(*r, "x", 1) for r in rows], CHATS), rows


def test_op13_chunks_do_not_change_a_repair(spark):
    df, rows = chats(spark)
    whole = sorted(map(str, conversations.report(df).collect()))
    assert len(whole) == len({r[0] for r in rows})
    assert sorted(map(str, conversations.report(df, conversations.Settings(chunk=3)).collect())) == whole
    assert conversations.report(df.limit(0)).collect() == []


def test_op13_against_a_plain_repair(spark):
    from hashlib import sha256

    df, rows = chats(spark, 8)
    want, groups = [], {}
    for r in rows:
        groups.setdefault(r[0], []).append((r[1], *(x if x is not None else " " for x in r[2:])))
    for conv, given in groups.items():
        hurt = []
        for turn, role, text in given:
            h = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if h == 1 else "".join(c for c in text if c not in ".!?") if h == 2 else text
            hurt += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
        hurt.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen, marks = Counter(), set(), []
        for _, role, text in hurt:
            cut = text.rstrip(" \t\n\x0b\f\r")
            fault = "blank" if not cut else "duplicate" if (role, text) in seen else "truncated" if cut[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            marks.append((role[:1] if role[:1] in tuple("sua") else "o", fault in ("blank", "duplicate"), int(fault == "truncated")))
        cost, audit = cheapest(marks)
        lines, state, left = [], 0, iter(hurt)
        for letter in audit:
            _, role, text = (None, "", "") if letter == "I" else next(left)
            if letter == "D":
                continue
            state = 1 if letter == "K" and role[:1] == "s" else 3 if state == 2 else 2
            lines.append(f"{role}:{text}" if letter == "K" else f"{'assistant' if state == 3 else 'user'}:{text}")
        turns = {t for t, *_ in hurt if t is not None}
        pairs = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(hurt))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        want.append((conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], pairs, cost, audit, sha256("\n".join(lines).encode()).hexdigest()))
    got = conversations.report(df, conversations.Settings(chunk=4), damaging=True).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


@pytest.mark.parametrize("order", [1, -1])
def test_op13_rows_in_any_order(spark, order):
    df, rows = chats(spark, 4)
    turned = spark.createDataFrame([(*r, "y", 2) for r in rows[::order]], CHATS)
    assert sorted(map(str, conversations.report(df).collect())) == sorted(map(str, conversations.report(turned).collect()))
