"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features per text: densities of learned and seed lexicons, how near lexicon hits stand to second-person words, shares of
capitals, punctuation, symbols and obfuscated words. The lexicons (words and word beginnings) are learned from one fold
of the labelled rows, the trees from the next and the calibration from a third, so that no stage sees its own answers.

Null and empty texts have all features 0 and get the score of that point. Without both classes among the labelled rows
every score is the share of toxic rows (0 without rows). Repeated ids are scored row by row; ids that are labelled twice
count as toxic if any label does. Texts are read whole, however long. An empty table gives an empty table, and other columns stay
whatever their names, but ``score`` and ``predicted``, which are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Seed insults and second-person words of the four languages of the corpus.
SEED = frozenset(
    """
    idiot idiots moron stupid dumb loser scum trash worthless pathetic disgusting clown vermin filth
    abruti connard imbécile débile salaud idiotin dummkopf abschaum trottel widerlich estúpido imbécil basura asqueroso
    """.split()
)
SECOND_PERSON = frozenset("you your yours yourself u ur tu toi te vous votre vos ton ta tes du dich dir dein deine ihr euch tú usted ustedes vuestro".split())
LEET = str.maketrans("0134578@$!|", "oieastbasil")
LETTERS = re.compile(r"[^\W\d_]+")
OBFUSCATED = re.compile(r"[^\W\d_][@$*!|0-9]+[^\W\d_]|(?:[^\W\d_][.\-_*]){2,}[^\W\d_]")
#: Lengths of the word beginnings that stand in the lexicon beside whole words.
BEGINNINGS = (4, 5, 6, 7)
#: Columns of the matrix of tokens, and of the features made from them.
TOKEN_FEATURES = ("strong", "medium", "weight", "seed", "second", "capitals", "marks", "symbols", "obfuscated", "chars")
FEATURES = (*TOKEN_FEATURES[:-1], "chars_per_token", "peak", "hits", "mass", "seeds", "near_second", "log_tokens")


@dataclass(frozen=True)
class Settings:
    """``max_rows`` bounds the labelled rows that are fitted on (taken by hash), ``max_terms`` the learned lexicon."""

    max_rows: int = 20_000
    max_terms: int = 2_000
    min_toxic_docs: int = 2
    min_log_odds: float = 1.5
    strong_log_odds: float = 3.0
    near: int = 5
    trees: int = 30
    depth: int = 4
    step: float = 0.2
    threshold: float = 0.7


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's text, mod 3, is 1; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


class TokenTable(dict):
    """token -> row of a matrix of its features; rows are made when first asked for."""

    def __init__(self, lexicon: dict[str, float], settings: Settings, capacity: int = 200_000):
        super().__init__()
        self.lexicon, self.settings, self.capacity = lexicon, settings, capacity
        self.rows = np.zeros((capacity, len(TOKEN_FEATURES)), np.float32)
        self[""] = 0  # an all-zero row, which stands before each text

    def reset_if_full(self, need: int) -> None:
        if len(self) + need > self.capacity:
            self.clear()
            self[""] = 0
            if need >= self.capacity:
                self.capacity = need + 1
                self.rows = np.zeros((self.capacity, len(TOKEN_FEATURES)), np.float32)

    def __missing__(self, token: str) -> int:
        at = self[token] = len(self)
        lower = token.lower()
        words = LETTERS.findall(lower)
        odd = bool(OBFUSCATED.search(token))
        if odd:
            plain = LETTERS.findall(re.sub(r"[.\-_*]", "", lower.translate(LEET)))
            words = [*words, *plain]
        weight = max((self._weight(w) for w in words), default=0.0)
        letters = "".join(words)
        symbols = sum(not c.isalnum() and c not in ".,;:!?'\"-()" for c in token)
        self.rows[at] = (
            weight >= self.settings.strong_log_odds,
            0 < weight < self.settings.strong_log_odds,
            weight,
            any(w in SEED for w in words),
            any(w in SECOND_PERSON for w in words),
            len(letters) > 2 and token.isupper(),
            token.count("!") + token.count("?"),
            symbols,
            odd,
            len(token),
        )
        return at

    def _weight(self, word: str) -> float:
        get = self.lexicon.get
        return max(get(word, 0.0), *[get(word[:k] + "*", 0.0) for k in BEGINNINGS])


def features(texts: list[str], tokens: TokenTable) -> np.ndarray:
    """One row of FEATURES a text."""
    split = [["", *t.split()] for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    tokens.reset_if_full(int(sizes.sum()))
    ids = np.fromiter((tokens[t] for words in split for t in words), np.int32, int(sizes.sum()))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    rows = tokens.rows[ids]
    n = np.maximum(sizes - 1, 1)
    sums = np.add.reduceat(rows, starts, axis=0)
    shares = sums / n[:, None]
    peak = np.maximum.reduceat(rows[:, 2], starts)
    hits = np.flatnonzero(rows[:, 0] + rows[:, 3])
    second = np.flatnonzero(rows[:, 4])
    owner = np.searchsorted(starts, hits, "right") - 1
    close = np.zeros(len(hits), bool)
    if len(second):
        for side in (np.searchsorted(second, hits) - 1, np.searchsorted(second, hits)):
            at = second[np.clip(side, 0, len(second) - 1)]
            same = np.searchsorted(starts, at, "right") - 1 == owner
            close |= same & (np.abs(at - hits) <= tokens.settings.near)
    near = np.bincount(owner, close, len(texts)) / np.maximum(np.bincount(owner, minlength=len(texts)), 1)
    return np.column_stack([shares[:, :-1], shares[:, -1], peak, sums[:, 0], sums[:, 2], sums[:, 3], near, np.log1p(sizes - 1)])


def with_features(df: DataFrame, lexicon: dict[str, float], settings: Settings, text: str = "text") -> DataFrame:
    """Replace the text by ``features ARRAY<DOUBLE>``. The lexicon has at most ``max_terms`` entries."""
    keep = [c for c in df.columns if c != text]
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    shared = df.sparkSession.sparkContext.broadcast(lexicon)
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = TokenTable(shared.value, settings)
        for batch in batches:
            for part in slices(batch, len(keep)):
                texts = [t.as_py() or "" for t in part.column(len(keep))]
                values = features(texts, tokens)
                flat = pa.array(values.ravel(), pa.float64())
                lists = pa.ListArray.from_arrays(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32), flat)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], lists], [*keep, "features"])

    return source.mapInArrow(run, f"{kept}features array<double>")


def slices(batch: pa.RecordBatch, column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``most`` bytes of text, so that token lists stay small."""
    begin, size = 0, 0
    sizes = batch.column(column)
    for i in range(batch.num_rows):
        size += len(sizes[i].as_buffer() or b"") if sizes[i].is_valid else 0
        if size >= most:
            yield batch.slice(begin, i + 1 - begin)
            begin, size = i + 1, 0
    if begin < batch.num_rows:
        yield batch.slice(begin)


def learn_lexicon(rows: DataFrame, settings: Settings, text: str = "text", label: str = "toxic") -> dict[str, float]:
    """Words and their beginnings (``abcd*``) with their log odds of toxic against other
    documents; those that are surest (odds by standard error) are kept."""
    words = F.array_distinct(F.split(F.lower(F.col(text)), r"[^\p{L}]+"))

    def starts(k: int) -> Column:
        return F.transform("words", lambda w: F.concat(F.substring(w, 1, k), F.lit("*")))

    tokens = F.array_distinct(F.concat("words", *[starts(k) for k in BEGINNINGS]))
    n = rows.agg(F.sum(label).alias("toxic"), F.count("*").alias("n")).first()
    n1, n0 = int(n["toxic"] or 0), int(n["n"]) - int(n["toxic"] or 0)
    if not n1 or not n0:
        return {}
    counted = (
        rows.select(F.col(label).cast("int").alias("label"), words.alias("words"))
        .select("label", F.explode(tokens).alias("term"))
        .where("length(term) > 2")
        .groupBy("term")
        .agg(F.sum("label").alias("c1"), F.count("*").alias("c"))
        .where(F.col("c1") >= settings.min_toxic_docs)
    )
    c1, c0 = F.col("c1"), F.col("c") - F.col("c1")
    odds = F.log((c1 + 0.5) / (n1 + 1)) - F.log((c0 + 0.5) / (n0 + 1))
    sure = odds / F.sqrt(1 / (c1 + 0.5) + 1 / (c0 + 0.5))
    best = counted.select("term", odds.alias("odds"), sure.alias("sure")).where(F.col("odds") >= settings.min_log_odds)
    return {r["term"]: r["odds"] for r in best.orderBy(F.desc("sure"), "term").limit(settings.max_terms).collect()}


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    isotonic: IsotonicRegressionModel | None
    prior: float
    settings: Settings

    def score(self, df: DataFrame, text: str = "text") -> DataFrame:
        """``df`` with ``score`` and ``predicted``, added or replaced."""
        keep = [c for c in df.columns if c.lower() not in ("score", "predicted")]
        # the caller's columns travel as one, so that none of them clashes with a column of the model's
        df = df.select(F.struct(*[F.col(f"`{c}`") for c in keep] or [F.lit(0)]).alias("kept"), F.col(f"`{text}`").alias("text"))
        if self.trees is None:
            scored = df.withColumn("score", F.lit(self.prior))
        else:
            scored = self._raw(with_features(df, self.lexicon, self.settings))
            scored = self.isotonic.setPredictionCol("__score").transform(scored)
            scored = scored.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("__score"))))
        predicted = (F.col("score") >= self.settings.threshold).cast("int")
        return scored.select(*[F.col("kept")[c].alias(c) for c in keep], "score", predicted.alias("predicted"))

    def _raw(self, df: DataFrame) -> DataFrame:
        vectors = df.withColumn("__vector", array_to_vector("features"))
        return self.trees.transform(vectors).withColumn("__raw", vector_to_array("__probability")[1])


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), usable: Callable[[Column], Column] | None = None) -> Model:
    """Fit on at most ``settings.max_rows`` labelled documents; ``usable`` tells which ids labels may be learned from."""
    named = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    if usable is not None:
        named = named.where(usable(F.col("doc_id")))
    sample = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most max_rows rows of two numbers
    rows = checkpoint(rows.select("text", "toxic", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(10)).alias("fold")))
    n = rows.agg(F.avg("toxic").alias("share")).first()
    lexicon = learn_lexicon(rows.where("fold < 5"), settings)
    dense = checkpoint(with_features(rows.where("fold >= 5"), lexicon, settings).coalesce(6))
    fitted = dense.where("fold < 8").withColumn("__vector", array_to_vector("features"))
    calibrated = dense.where("fold >= 8")
    classes = [{r["toxic"] for r in x.select("toxic").distinct().collect()} for x in (fitted, calibrated)]
    model = Model(lexicon, None, None, float(n["share"] or 0.0), settings)
    if len(classes[0]) < 2 or not classes[1]:
        return model
    boost = GBTClassifier(
        featuresCol="__vector", labelCol="toxic", predictionCol="__class", maxIter=settings.trees, maxDepth=settings.depth, stepSize=settings.step, seed=7
    )
    model.trees = boost.fit(fitted).setRawPredictionCol("__margin").setProbabilityCol("__probability")
    model.isotonic = IsotonicRegression(featuresCol="__raw", labelCol="toxic").fit(model._raw(calibrated).select("__raw", F.col("toxic").cast("double").alias("toxic")))
    return model
