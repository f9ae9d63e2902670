"""Odd rows and clashing columns, and the registered queries without SQL against plain versions on whole tables."""

import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from voidloom.llm import decontamination, html_text, licenses, line_dedup, near_dedup, queries, toxicity, url_filter, vector_search
from voidloom.llm.common import table

LONG = " ".join(f"word{i % 977}" for i in range(60_000))
ROWS = [(1, "one two three four five six seven"), (1, "one two three four five six seven"), (2, None), (3, ""), (None, "no id here"), (4, LONG), (5, LONG), (6, "\n\n \t\n")]
CLASHES = ("features", "kept", "text_key", "stays_id", "hit_id", "drop", "lines", "gone", "judged", "number", "words", "score_", "__id", "__text", "__raw")


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("mine") for c in CLASHES})


def same_columns(found, odd):
    assert found.columns[: len(odd.columns)] == odd.columns or set(odd.columns) <= set(found.columns)
    assert all(r[c] == "mine" for r in found.collect() for c in CLASHES)


def test_odd_rows_through_every_document_operator(spark, odd):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(7)], "doc_id long, quality int, toxic int")
    scored = toxicity.fit(odd, labels).score(odd)
    same_columns(scored, odd)
    assert scored.count() == len(ROWS)
    lines = line_dedup.dedup_lines(odd)
    same_columns(lines, odd)
    assert sorted(str(r["doc_id"]) for r in lines.collect()) == sorted(str(i) for i, _ in ROWS)
    assert {r["doc_id"]: r["text"] for r in lines.where("doc_id in (4, 5)").collect()} == {4: LONG, 5: ""}
    bench = spark.createDataFrame([(9, " ".join(LONG.split()[:30])), (None, None), (8, "")], "item_id long, text string")
    for mode in ("documents", "spans"):
        same_columns(decontamination.decontaminate(odd, bench, mode), odd)
    hits = {r["doc_id"]: r["n_hit"] for r in decontamination.find_hits(odd, bench).where("contaminated").collect()}
    assert hits.keys() == {4, 5} and hits[4] == sum(1 for i in range(60_000) if i % 977 < 30)
    kept = near_dedup.drop_near_duplicates(odd)
    same_columns(kept, odd)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "4", "6", "None"]
    scan = licenses.scan_licenses(odd.withColumn("labels", F.lit("x")), keep=("doc_id", "labels"))
    assert scan.count() == len(ROWS) and scan.columns.count("labels") == 1 and {r["labels"] for r in scan.collect()} == {""}
    assert licenses.scan_licenses(odd.where("false")).count() == 0


def test_odd_pages(spark):
    page = "<article>" + "".join(f"<p>paragraph {i} of the page</p>" for i in range(20_000)) + "</article>"
    df = spark.createDataFrame([(1, "http://a.com/fr/x", page, "mine"), (1, "http://a.com/fr/x", page, "mine"), (None, None, None, "mine")], "page_id long, url string, html string, judged string")
    got = html_text.extract_text(df.withColumn("text", F.lit("t")), keep=("page_id", "text"))
    assert got.columns == ["page_id", "text", "n_chars"] and sorted(r["text"].count("\n") for r in got.collect()) == [0, 19_999, 19_999]
    assert html_text.extract_text(df.where("false")).count() == 0
    judged = url_filter.judge_urls(df, queries.RULES)
    assert {r["judged"] for r in judged.collect()} == {"mine"} and sorted(str(r["rule"]) for r in judged.collect()) == ["None", "com/fr/", "com/fr/"]
    assert url_filter.judge_urls(df.where("false"), queries.RULES).count() == 0


PROSE = "The first paragraph of the article is long enough to be decided by its length and by the words that it has in it."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p>A</p><svg viewBox='0 0' /><p>B</p></article>", "A\nB"),
        ("<article><p>A</p><button>Menu<p>B</p></article><p>", "A\nB"),
        (f"<article><p>See <a href=x>this long linked passage here</a> ok</p><p>{PROSE}</p></article>", f"See this long linked passage here ok\n{PROSE}"),
        (f"<article><div class='post-header'><p>{PROSE}</p></div></article>", PROSE),
        (f"<article><p>Short.</p><ul><li><a href=a>one</a></li><li><a href=b>two</a></li></ul><p>{PROSE}</p></article>", f"Short.\n{PROSE}"),
        (f"<article><p class='ad'>Buy</p><p hidden>x</p><p style='display: none'>y</p><p>{PROSE}</p></article>", PROSE),
        (f"<div><p>{PROSE} {PROSE}</p><p>Short.</p><p>{PROSE} {PROSE}</p></div><div class=footer>{PROSE}</div><div>Menu of things</div>", f"{PROSE} {PROSE}\nShort.\n{PROSE} {PROSE}"),
    ],
)
def test_blocks_of_pages(page, text):
    assert html_text.main_text(page) == text


def test_rows_that_share_an_id_are_rows_of_their_own(spark):
    rows = [(0, [1.0, 0.0]), (0, [2.0, 0.5]), (1, [3.0, 1.0]), (2, [1.0, 1.0]), (3, [0.5, 0.0]), (3, [0.5, 0.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, row string")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in vector_search.top_k(df, F.col("vec_id") == 0, vector_search.Settings(k=4)).collect())
    told = []
    for q in (0, 1):
        scores = sorted((-int(sum(np.floor(1024 * x) * np.floor(1024 * y) for x, y in zip(rows[q][1], v, strict=True))), i) for k, (i, v) in enumerate(rows) if k != q)[:4]
        told += [(0, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert got == sorted(told)


def test_op6_against_the_plain_library(spark, sf_dir):
    from tokenizers import Tokenizer

    plain, at = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json")), 0
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op6_token_files(spark, sf_dir).collect()}
    docs = sorted((r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect())
    for i, text in docs:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        assert got[i] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(got) == len(docs)


def test_op5_against_the_plain_library(spark, sf_dir):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary("piece_bpe_32k.model"))
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"], r["round_trip"]) for r in queries.op5_pieces(spark, sf_dir).collect()}
    for r in table(spark, sf_dir, "documents").collect():
        ids = library.encode(r["text"] or "")
        assert "▁" in (r["text"] or "") or got[r["doc_id"]] == (len(ids), zlib.crc32(" ".join(map(str, ids)).encode()), True)


class Plain(HTMLParser):
    """Blocks of the article of a page, by plain walking."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.hidden, self.parts, self.out = 0, 0, [], []

    def flush(self):
        text = " ".join("".join(self.parts).split())
        self.out += [text] if text else []
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in html_text.BLOCKS:
            self.flush()
        self.inside += tag in ("article", "main")
        self.hidden += tag in ("script", "style", "aside", "form", "nav") or tag in ("div", "section") and bool(attrs)
        self.parts += [" "] if tag == "br" else []

    def handle_endtag(self, tag):
        if tag in html_text.BLOCKS:
            self.flush()
        self.inside -= tag in ("article", "main")
        self.hidden = max(0, self.hidden - (tag in ("script", "style", "aside", "form", "nav", "div", "section")))

    def handle_data(self, data):
        if self.inside and not self.hidden:
            self.parts.append(data)


def test_op9_against_a_plain_walk(spark, sf_dir):
    got = {r["page_id"]: r for r in queries.op9_html_text(spark, sf_dir).collect()}
    pages = table(spark, sf_dir, "pages").collect()
    same = 0
    for r in pages:
        walk = Plain()
        walk.feed(r["html"] or "")
        walk.flush()
        same += got[r["page_id"]]["text"] == "\n".join(walk.out)
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"]) and got[r["page_id"]]["url"] == r["url"]
    assert len(got) == len(pages) and same == len(pages)


def test_op10_base_columns_against_plain_words(spark, sf_dir):
    got = {r["doc_id"]: r for r in queries.op10_licenses(spark, sf_dir).collect()}
    for r in table(spark, sf_dir, "documents").collect():
        words = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"] or ""))
        starts = sorted(i for p in licenses.BASE for i in range(len(words)) if words[i : i + p.count(" ") + 1] == p.split())
        labels = ",".join(sorted({v for p, v in licenses.BASE.items() for i in starts if words[i : i + p.count(" ") + 1] == p.split()}))
        x = got[r["doc_id"]]
        assert (x["n_words"], x["n_base"], x["first_word"], x["last_word"], x["base_labels"]) == (len(words), len(starts), min(starts, default=None), max(starts, default=None), labels)
        assert 0 <= x["score"] <= 1 and set(filter(None, labels.split(","))) <= set(x["labels"].split(","))


def test_op1_columns(spark, sf_dir):
    got = queries.op1_toxicity(spark, sf_dir).collect()
    assert len(got) == table(spark, sf_dir, "documents").count()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1


@pytest.mark.parametrize(("text", "copyleft"), [("MIT -->", False), ("MIT. See the file", False), ("LicenseRef-Own", None), ("GPL-2.0+ OR LicenseRef-Own", None), ("CC-BY-NC-4.0", None)])
def test_expressions_end_and_unlisted_identifiers_stay_open(text, copyleft):
    assert licenses.evaluate(text)[1] is copyleft


def test_op10_tags_stand_where_the_automaton_saw_them():
    machine = licenses._automaton()

    def labels(text):
        return licenses.scan(text, machine)[5]

    for text in ("SPDX-License-Identifier: MIT", "spdx-license-identifier : MIT", "SPDX License Identifier MIT", "é — SPDX\nLicense\n Identifier: MIT */", "// spdx_license_identifier:MIT\r\nno"):
        assert labels(text) == "permissive,spdx:mit", text
    assert labels("the SPDX license identifier is a word; SPDX-License-Identifier:") == "spdx-malformed"
    assert labels("SPDX-License-Identifier: GPL-2.0 or any later version") == "copyleft,spdx:gpl-2.0-or-later"
    assert labels("SPDX-License-Identifier: MIT or later\nSPDX-License-Identifier: Apache-2.0 OR GPL-3.0-only") == "permissive,spdx:apache-2.0,spdx:gpl-3.0-only,spdx:mit-or-later"
    assert labels("spdx license identifier " * 3 + "mit") == "permissive,spdx:mit"


def test_op10_labels_and_scores_against_plain_words(spark, sf_dir):
    """Notices by windows of words, tags by lines that hold one, on whole texts."""
    import re

    docs = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    for r in queries.op10_licenses(spark, sf_dir).collect():
        text = docs[r["doc_id"]] or ""
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text))
        line = f" {' '.join(words)} "
        base = {v for p, v in licenses.BASE.items() if f" {p} " in line}
        found = {v: w for p, (v, w) in sorted(licenses.NOTICES.items()) if f" {p} " in line}
        doubt, names = 1.0, set()
        for w in [*(licenses.BASE_WEIGHT[b] for b in base), *found.values()]:
            doubt *= 1 - w
        for tag in re.findall(r"SPDX-License-Identifier:[ \t]*([^\r\n]*)", text):
            ids, copyleft = licenses.evaluate(tag)
            names |= {f"spdx:{i}" for i in ids} | {"spdx-unlisted" if copyleft is None else "copyleft" if copyleft else "permissive"}
            doubt *= 0.5 if copyleft is None else 0.0
        assert r["labels"] == ",".join(sorted(base | set(found) | names)) and abs(r["score"] - (1 - doubt)) < 1e-9
