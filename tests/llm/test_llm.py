"""The training-data operators against brute force, with nulls, empty texts and tables, ties, repeats and clashing columns."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from voidloom.llm import connected, decontamination, html_text, licenses, line_dedup, near_dedup, pieces, token_files, toxicity, url_filter, vector_search

WORDS = "the of and to in is that for it was on with as by be at are this from or".split()


def texts(n, seed=0, low=5, high=60):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(WORDS, rng.integers(low, high))) + f" w{i}" for i in range(n)]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


# toxicity


def test_toxicity_learns_ranks_and_survives_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i, t in enumerate(texts(400)):
        bad = bool(rng.random() < 0.3)
        rows.append((i, t + (" you zorblax fool zorblax" if bad else "")))
        labels.append((i, 1, int(bad)))
    rows += [(1000, None), (1001, ""), (1002, "zorblax " * 20000), (1, rows[1][1])]
    docs = documents(spark, rows).withColumn("score", F.lit("clash"))
    named = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, named, usable=lambda i: ~toxicity.held_out(i))
    got = model.score(docs.withColumn("held", toxicity.held_out(F.col("doc_id")))).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all()
    truth = dict((i, x) for i, _, x in labels)
    held = got[got.held & (got.doc_id < 1000)]
    agree = np.mean([truth[i] == p for i, p in zip(held.doc_id, held.predicted, strict=True)])
    assert agree > 0.9
    assert got[got.doc_id == 1000].score.iloc[0] == got[got.doc_id == 1001].score.iloc[0]


def test_toxicity_without_labels_or_rows(spark):
    docs = documents(spark, [(1, "a b"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.fit(docs, none).score(docs).collect()} == {0.0}
    assert toxicity.fit(docs.where("false"), none).score(docs.where("false")).count() == 0


def test_toxic_features_see_obfuscation_and_second_person():
    table = toxicity.TokenTable({"idiot": 5.0, "scum*": 4.0}, toxicity.Settings())
    plain, leet, empty, far = toxicity.features(["you idiot", "you id1ot", "", "scummy " + "x " * 30 + "you"], table)
    names = toxicity.FEATURES
    at = {n: i for i, n in enumerate(names)}
    assert plain[at["peak"]] == 5.0 and leet[at["peak"]] == 5.0 and leet[at["obfuscated"]] > 0
    assert plain[at["near_second"]] == 1 and far[at["near_second"]] == 0 and not empty.any()


# search


@pytest.mark.parametrize("shard_rows", [1000, 17])
def test_search_matches_brute_force(spark, shard_rows):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(120, 6)).astype(np.float32)
    v[40:80] = v[40]  # ties
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    rows += [(500, None), (501, [float("nan")] * 6), (502, [1.0, None] + [0.0] * 4), (503, [float("inf")] * 6), (504, [1.0, 2.0]), (520, [3.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = vector_search.top_k(df, F.col("vec_id") % 20 == 0, vector_search.Settings(k=5, shard_rows=shard_rows, leaf_rows=8)).toPandas()
    for q in range(0, 120, 20):
        ints = np.floor(1024 * v.astype(float))
        scores = sorted((-(int(ints[q] @ ints[j])), j) for j in range(120) if j != q)[:5]
        mine = got[got.query_id == q].sort_values("rank")
        assert list(zip(-mine.score, mine.vec_id, strict=True)) == scores and list(mine["rank"]) == [1, 2, 3, 4, 5]
    assert list(got[got.query_id == 520].vec_id) == [504]
    assert vector_search.top_k(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_search_of_large_values_is_exact(spark):
    df = spark.createDataFrame([(0, [1e6, 1.0]), (1, [1e6, 3.0]), (2, [1e6, 2.0])], "vec_id long, embedding array<double>")
    got = vector_search.top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 2] and got[0]["score"] == (1024 * 10**6) ** 2 + 1024 * 3072


# line dedup


def test_repeated_chunks_leave_later_places(spark):
    shared = "\n".join(f"shared line number {i} of a passage" for i in range(8))
    long_line = "one long line " * 30  # 90 words
    rows = [(3, f"head three\n{shared}\ntail three"), (1, f"head one a\nhead one b\n{shared}\ntail one"), (2, "clean text\nnothing else"), (4, None), (5, ""), (6, long_line), (7, "x\n" + long_line), (2, "clean text\nnothing else")]
    docs = documents(spark, rows).withColumn("n_lines", F.lit("clash"))
    got = {(r["doc_id"]): r for r in line_dedup.dedup_lines(docs).collect()}
    assert got[1]["text"] == rows[1][1] and got[2]["text"] == rows[2][1] and got[2]["n_removed"] == 0
    assert got[3]["n_removed"] >= 2 and got[3]["text"].startswith("head three") and len(got[3]["text"]) < len(rows[0][1])
    assert got[4]["text"] is None and got[5]["text"] == "" and got[6]["text"] == long_line and got[7]["text"] == "x"
    assert line_dedup.dedup_lines(docs).count() == len(rows)
    assert line_dedup.dedup_lines(docs.where("false")).count() == 0


def test_chunk_boundaries_resist_shifts(spark):
    lines = [f"line {i} {i * 7919 % 101}" for i in range(60)]
    df = documents(spark, [(0, "\n".join(lines)), (1, "\n".join(["new"] + lines))])
    hashed = df.select("doc_id", F.split("text", "\n").alias("lines")).withColumn("hashes", F.transform("lines", line_dedup.line_hash))
    cut = hashed.select("doc_id", "lines", F.explode(line_dedup.chunks_of(F.col("hashes"))).alias("c"))
    cut = cut.select("doc_id", F.array_join(F.slice("lines", line_dedup.first_of(F.col("c")) + 1, line_dedup.lines_of(F.col("c"))), "\n").alias("text"))
    found = cut.collect()
    a, b = ({r["text"] for r in found if r["doc_id"] == i} for i in (0, 1))
    assert len(a & b) >= len(a) - 2 and "\n".join(r["text"] for r in found if r["doc_id"] == 0) == "\n".join(lines)


def test_planted_passages_of_short_lines_leave_whole(spark):
    rng = np.random.default_rng(11)
    count = iter(range(10**6))

    def lines(n, words):
        return [" ".join(f"w{next(count)}" for _ in range(words)) for _ in range(n)]

    rows, told = [], {}
    for trial in range(66):
        n = 2 + trial % 11
        passage = lines(n, -(-51 // n) if n < 6 else 20)
        if trial % 2:
            passage.insert(1, "")
        for copy in range(2):
            head, tail = lines(int(rng.integers(0, 4)), 6), lines(int(rng.integers(0, 4)), 6)
            key = 2 * trial + copy
            rows.append((key, "\n".join(head + passage + tail)))
            told[key] = "\n".join(head + tail if copy else head + passage + tail)
    run = [" ".join(["verse"] * 10)] * 23  # one text: only its first window stays
    few = lines(3, 16)  # 48 words are no passage, unless a chunk holds them
    rows += [(1000, "\n".join(run)), (1001, "\n".join(few[:1])), (1002, "\n".join(["x", *few[:1]])), (None, "\n".join(rows[0][1].split("\n")))]
    told |= {1000: "\n".join(run[:5]), 1001: few[0], 1002: "x\n" + few[0], None: rows[0][1], 0: ""}
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(documents(spark, rows)).collect()}
    assert {k for k in told if got[k]["text"] != told[k]} <= {0}  # the null id holds the whole of text 0, and stands first
    assert len(got[0]["text"]) < len(rows[0][1]) and got[3]["n_removed"] == 4 and got[1000]["n_removed"] == 18


def test_running_totals_of_an_array(spark):
    counts = [(list(range(n)),) for n in (1, 255, 256, 257, 600)]
    got = spark.createDataFrame(counts, "a array<int>").select("a", line_dedup.running(F.col("a")).alias("t")).collect()
    assert all(r["t"] == [0, *np.cumsum(r["a"])] for r in got)


# near duplicates


def brute_components(rows, k, percent=80):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        n = min(k, len(w))
        sets.append(set(zip(*[w[i:] for i in range(n)], strict=False)) if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return [least[find(i)] for i in range(len(rows))]


@pytest.mark.parametrize(("k", "small"), [(2, 64), (5, 0)])
def test_near_duplicates_match_brute_force(spark, k, small):
    rng = np.random.default_rng(4)
    base = texts(25, 7, 20, 80)
    rows = list(enumerate(base))
    for i in range(60):  # edits around the limit, in families
        w = base[i % 5].split()
        for at in rng.choice(len(w), rng.integers(0, max(2, len(w) // 8)), replace=False):
            w[at] = f"e{i}"
        rows.append((100 + i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, "one"), (203, "ONE"), (204, base[3]), (205, "  ")]
    docs = documents(spark, rows)
    got = near_dedup.near_duplicates(docs, near_dedup.Settings(k=k, small=small, block=16)).toPandas().set_index("doc_id")
    expect = dict(zip([d for d, _ in rows], brute_components(rows, k), strict=True))
    assert got.component_id.to_dict() == expect
    assert got.n_shingles[[200, 201, 205]].tolist() == [0, 0, 0] and got.n_shingles[202] == 1
    kept = near_dedup.drop_near_duplicates(docs, near_dedup.Settings(k=k))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(expect.values()))
    assert near_dedup.near_duplicates(docs.where("false")).count() == 0


def test_sketches_estimate_similarity():
    consts = near_dedup.hash_constants(240)
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = pool[:2000], pool[500:2500]
    s = [near_dedup.compress(near_dedup.minima(x, consts))[None] for x in (a, b)]
    est = near_dedup.estimate(*s, np.array([2000]), np.array([2000]))[0]
    assert abs(est - 1500 / 2500) < 0.13


def test_components_of_a_long_chain(spark):
    edges = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert connected.components(edges).select("component").distinct().collect()[0][0] == 0


# pieces and token files


@pytest.fixture(scope="module")
def vocabulary():
    tokenizers = pytest.importorskip("public_tokenizers")
    return pieces.Vocabulary(tokenizers.path("piece_bpe_32k.model"))


ODD = ["", " ", "a▁b", "é\n\n x  ", "日本語 text", "𝔘x" * 3, "tab\there", "▁", "x" * 5000, " lead", "trail ", "\n"]


def brute_path(word, score, unknown, longest):
    best = [0.0] + [-np.inf] * len(word)
    for j in range(1, len(word) + 1):
        for i in range(max(0, j - longest), j):
            s = score.get(word[i:j], unknown if j - i == 1 else -np.inf)
            best[j] = max(best[j], best[i] + s)
    return best[-1]


def test_pieces_of_best_sums_and_exact_decoding(vocabulary):
    """With log probabilities for scores: batches of equal-length words against a plain dynamic programme."""
    import public_tokenizers

    sums = pieces.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    sums.rank = None
    for length, (keys, ids, scores) in sums.probes.items():
        sums.probes[length] = keys, ids, -np.log(2.0 - scores)
    sums.unknown = -20.0
    for text, ids in zip(ODD, sums.encode(ODD), strict=True):
        assert sums.decode(ids.tolist()) == text
    score = {sums.text[int(i)]: float(s) for _, ids, scores in sums.probes.values() for i, s in zip(ids, scores, strict=True)}
    rng = np.random.default_rng(3)
    for length in (1, 5, 12):
        words = ["".join(rng.choice(list("thinkgabl▁日é"), length)) for _ in range(40)]
        for word, ids in zip(words, sums.viterbi(words), strict=True):
            parts = sums.text
            got = sum(score[parts[i]] for i in ids.tolist() if i in parts) + sums.unknown * sum(c not in score for c in word)
            assert abs(got - brute_path(word, score, sums.unknown, sums.longest)) < 1e-9


def test_pieces_of_merges_are_the_library_s(vocabulary):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(4)
    letters = list("etaoin shrdlu,.ETA\n09éß日🙂")
    some = ["".join(rng.choice(letters, int(rng.integers(1, 200)))) for _ in range(300)] + texts(50) + [" the  cat", "x" * 3000, "(unbelievably) thinking"]
    for text, ids in zip(some, vocabulary.encode(some), strict=True):
        assert ids.tolist() == library.encode(text) and vocabulary.decode(ids.tolist()) == text
    for text, ids in zip(ODD, vocabulary.encode(ODD), strict=True):
        assert vocabulary.decode(ids.tolist()) == text


def test_long_words_are_encoded_in_parts(vocabulary, monkeypatch):
    word = "▁" + "thinkingaboutlongwords" * 20
    whole = vocabulary.viterbi([word])[0].tolist()
    monkeypatch.setattr(pieces, "PART", 64)
    assert vocabulary.viterbi([word])[0].tolist() == whole


def test_pieces_learn_and_try_what_is_new_only(vocabulary, monkeypatch):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    known, library = pieces.Vocabulary(path, known=20), sentencepiece.SentencePieceProcessor(model_file=path)
    learned, tried = [], []
    monkeypatch.setattr(known, "_learn", lambda words, f=known._learn: (learned.extend(words), f(words))[1])
    monkeypatch.setattr(known, "merged", lambda text, f=known.merged: (tried.append(text), f(text))[1])
    usual = "the words that each text has and some that are their own"
    for i in range(30):
        text = f"{usual} nr{i}"
        assert known.encode([text])[0].tolist() == library.encode(text)
    # a full memory forgets what did not come again, not the words that every text has
    assert len(learned) == len(set(learned)) and len(known.words) + len(known.older) <= 60
    tried.clear()
    for i in range(30):
        known.encode([f"{usual} nr{i}"])
    assert not tried
    ids = known.encode([usual, "", "\u2581 other", usual])
    assert known.same(ids, [usual, "", "\u2581 other", usual]) == [True] * 4
    assert known.same([ids[0], ids[1], ids[2], ids[3][:-1]], [usual + " ", "x", "\u2581 other", usual]) == [False, False, True, False]


def test_pieces_over_tables(spark, vocabulary):
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = documents(spark, [(i, t) for i, t in enumerate([*ODD, None])]).withColumn("ids", F.lit("clash"))
    coded = pieces.encode(docs, model, check="same")
    assert all(r["same"] for r in coded.collect()) and coded.count() == len(ODD) + 1
    back = {r["doc_id"]: r["decoded"] for r in pieces.decode(coded, model).collect()}
    assert [back[i] for i in range(len(ODD))] == ODD and back[len(ODD)] == ""
    assert pieces.encode(docs.where("false"), model).count() == 0


def test_token_files_round_trip(spark, tmp_path):
    tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    assert plain.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    rng = np.random.default_rng(9)
    mixed = ["".join(rng.choice(list("ab 's\n\t\u00a0\u20281.é日-"), 60)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate([*ODD, "don't  stop\n\n<|endoftext|> 123abc ½", "a <|endoftext|> b", "a  <|endoftext|>  b<|endoftext|>", *mixed, *texts(30), "long " * 60000])]
    rows = rows[::-1] + [(990, None), (990, "again"), (990, "again")]
    docs = documents(spark, rows).repartition(3)
    token_files.write_tokens(docs, str(tmp_path / "t"), path, token_files.Settings(segment_ids=300))
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_index(spark, str(tmp_path / "t")).collect())
    coded = {(i, t): plain.encode(t or "", add_special_tokens=False).ids + [0] for i, t in rows}
    assert [g[1] for g in got] == sorted(i for i, _ in rows) and [g[0] for g in got] == [0, *np.cumsum([g[2] for g in got])[:-1]]
    expect = Counter((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for (i, t), ids in ((r, coded[r]) for r in rows))
    assert Counter(g[1:] for g in got) == expect
    segments = spark.read.parquet(str(tmp_path / "t")).collect()
    ids = Counter()
    for r in segments:
        s = token_files.Segment(bytes(r["payload"]))
        ids.update((d, tuple(s.ids(k).tolist())) for k, d in enumerate(r["doc_ids"]))
    assert ids == Counter((i, tuple(coded[i, t])) for i, t in rows)
    token_files.write_tokens(docs.where("false"), str(tmp_path / "e"), path)
    assert token_files.read_index(spark, str(tmp_path / "e")).count() == 0


def test_elias_fano_select():
    rng = np.random.default_rng(5)
    for values in (np.sort(rng.integers(0, 10**9, 1000)), np.arange(200), np.array([7]), np.zeros(5, int), np.sort(np.r_[rng.integers(0, 50, 300), 10**12])):
        ef = token_files.EliasFano.encode(values)
        assert [ef.select(i) for i in range(len(values))] == values.tolist() == ef.all().tolist()


# url filter


def test_trie_against_plain_rules(spark):
    rules = [url_filter.Rule(*r) for r in (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"), ("block", "a.com", "/fr/x/y"))]
    urls = ["http://EXAMPLE.org/en/12?q", "https://x.example.org/es/", "http://notexample.org/es/a", "http://a.com/fr/x/yz", "http://b.a.com/fr/x", "http://com/de/", "http://org", "x.com/de/", None, "://", "http://a..com/de/1", "http://example.org:80/es/", "ftp://q.net/#/de/"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(df, rules).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: (r.host.count("."), len(r.path)), default=None)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, best and best.label, best.verdict if best else "allow"), u


# decontamination


def brute_hits(text, items, n=10):
    import re

    def words(t):
        return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    w, hit, named = words(text), set(), set()
    for item, t in items:
        v = words(t)
        tests = [v[i : i + n] for i in range(len(v) - n + 1)] if len(v) >= n else [v] if v else []
        for x in tests:
            for i in range(len(w) - len(x) + 1):
                if w[i : i + len(x)] == x:
                    hit |= set(range(i, i + len(x)))
                    named |= {str(item)} if item is not None else set()
    return len(w), len(hit), ",".join(sorted(named))


@pytest.mark.parametrize("bits", [20, 1])  # with few bits nearly every position is verified
def test_hits_match_brute_force(spark, bits):
    long_item = " ".join(f"Benchmark{i}" for i in range(14))
    items = [(11, long_item), (2, "short item, here"), (3, long_item), (4, None), (5, "..."), (None, "Größe zählt")]
    rows = [(1, f"before {long_item.upper()} after"), (2, "a Short; item here! and " + " ".join(f"benchmark{i}" for i in range(9))), (3, None), (4, ""), (5, "die größe zählt"), (6, "clean"), (6, "clean"), (7, ("x " + long_item + " ") * 3)]
    docs = documents(spark, rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    settings = decontamination.Settings(bits=bits)
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"])) for r in decontamination.find_hits(docs, bench, settings).collect())
    assert got == Counter((i, *brute_hits(t, items)) for i, t in rows)
    clean = decontamination.decontaminate(docs, bench, settings=settings)
    assert sorted(r["doc_id"] for r in clean.collect()) == [3, 4, 6, 6] and clean.columns == docs.columns
    spans = {r["doc_id"]: r["text"] for r in decontamination.decontaminate(docs, bench, "spans", settings).collect()}
    assert spans[1] == "before after" and spans[6] == "clean" and spans[3] is None and spans[2].startswith("a! and benchmark0")
    assert decontamination.find_hits(docs, bench.where("false"), settings).where("contaminated").count() == 0
    assert decontamination.find_hits(docs.where("false"), bench, settings).count() == 0


# pages and licences


def test_main_text_of_pages(spark):
    body = "The first paragraph of the article is long enough to be decided by its length and by the words that it has in it."
    page = f"""<html><head><title>t</title><script>var a="<p>no</p>";</script></head><body><header><a href=x>Home</a></header>
    <nav><ul><li><a href="/a">menu</a></ul></nav><div class="cookie-notice">We use cookies on this site to make it better for all of the people who use it, and so on.</div>
    <article><h1>A &amp; title</h1><p>{body}<p>Short&nbsp; one.<br>Two &lt;b&gt;</p><div class="ad">Buy this now in the shop of the town</div><p><b>{body}</b></p>
    <section class="comments"><p>{body} says a reader of it</p></section></article><aside><p>{body} aside</p></aside><form><p>{body}</p></form><footer>&copy; me</footer>"""
    expect = f"A & title\n{body}\nShort one. Two <b>\n{body}"
    df = spark.createDataFrame([(1, "u", page, "c"), (2, None, None, "c"), (3, "u", "", "c"), (4, "u", "<p>", "c")], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html_text.extract_text(df).collect()}
    assert got[1]["text"] == expect and got[1]["n_chars"] == len(expect)
    assert [got[i]["text"] for i in (2, 3, 4)] == ["", "", ""] and got[2]["n_chars"] == 0


def test_licences(spark):
    rows = [(1, "Licensed under CC-BY 4.0. All\nrights, RESERVED cc by cc by"), (2, None), (3, ""), (4, "SPDX-License-Identifier: (MIT OR GPL-2.0) AND Apache-2.0"), (5, "the GNU General Public License"), (6, "accc by"), (7, "SPDX-License-Identifier: MIT OR")]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(documents(spark, rows)).collect()}
    r = got[1]
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (13, 4, 2, 11, "cc-by,reserved")
    assert (got[2]["n_words"], got[2]["first_word"], got[2]["labels"], got[2]["score"]) == (0, None, "", 0.0)
    assert "permissive" in got[4]["labels"] and "spdx:mit" in got[4]["labels"] and got[4]["score"] == 1.0
    assert got[5]["base_labels"] == "gpl" and got[6]["n_base"] == 0 and "spdx-malformed" in got[7]["labels"]


@pytest.mark.parametrize(("text", "copyleft"), [("MIT", False), ("GPL-3.0 WITH x", True), ("GPL-3.0 OR MIT", False), ("GPL-3.0 AND MIT", True), ("MIT OR BSD AND GPL-2.0", False), ("(MIT OR BSD) AND GPL-2.0", True)])
def test_expressions(text, copyleft):
    assert licenses.evaluate(text)[1] is copyleft


def test_trees_of_the_classifier_are_not_cut():
    assert toxicity.Settings().trees == 30
