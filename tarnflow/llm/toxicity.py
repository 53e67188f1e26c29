"""Toxicity by weak supervision: voters, a generative label model over their votes, and a linear classifier on its posteriors."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, stored

# A seed lexicon of insults in four languages; labelled rows add terms to it.
SEEDS = (
    "idiot moron stupid loser scum pathetic worthless trash disgusting clown fool dumb imbecile vermin "
    "dummkopf trottel abschaum arschloch crétin abruti ordure connard imbécil estúpido basura asqueroso"
).split()
WORD = re.compile(r"\w+")
#: A word in which signs stand for letters, as in id*ot.
MASKED = re.compile(r"(?<!\w)[^\W\d_]{1,12}[*@$!#]{1,3}[^\W\d_]{1,12}(?!\w)")
#: How long a word's beginning may be to count as a term.
STEMS = (4, 5, 6)
LEXICA = 8
VOTERS = LEXICA + 4
BINS = 3


def each(texts: pa.Array) -> Iterator[str | None]:
    """The texts, a few hundred at a time as Python strings."""
    for at in range(0, len(texts), 200):
        yield from texts.slice(at, 200).to_pylist()
    lean()


def terms_of(text: str | None) -> tuple[Counter, int]:
    """Words and word beginnings (marked by a final *) with their counts, and the number of words."""
    words = Counter(WORD.findall((text or "").lower()))
    out = Counter(words)
    for w, n in words.items():
        for k in STEMS:
            if len(w) > k:
                out[w[:k] + "*"] += n
    return out, sum(words.values())


@dataclass
class Lexicon:
    """Terms in order of weight; term i belongs to lexicon i mod LEXICA."""

    terms: list[str]

    def __post_init__(self):
        self.at = {t: i for i, t in enumerate(self.terms)}
        self.stems = sorted({len(t) - 1 for t in self.terms if t.endswith("*")})

    def hits(self, text: str | None) -> tuple[dict[int, int], int]:
        """How often each term occurs, by its number, and the number of words."""
        words = WORD.findall((text or "").lower())
        found: dict[int, int] = {}
        at = self.at
        for w, n in Counter(words).items():
            for t in (w, *[w[:k] + "*" for k in self.stems if len(w) > k]):
                if t in at:
                    found[at[t]] = found.get(at[t], 0) + n
        return found, len(words)


def votes(lexicon: Lexicon, text: str | None) -> list[int]:
    """1 toxic, -1 not, 0 abstains: the lexica, then several terms, their density, masked words, shouting."""
    hits, n = lexicon.hits(text)
    out = [0] * LEXICA
    for i in hits:
        out[i % LEXICA] = 1
    total = sum(hits.values())
    out.append(1 if len(hits) >= 2 else 0 if hits else -1)
    out.append(1 if total >= 2 and total * 400 >= n else -1 if not total else 0)
    out.append(1 if hits and MASKED.search(text or "") else 0)
    out.append(1 if hits and sum(map(str.isupper, text or "")) * 2 > len(text or "") else 0)
    return out


def without_copies(sample: DataFrame, hashes: int = 4) -> DataFrame:
    """One row of those whose words have the same minima under several hash functions: copies would pass for evidence."""
    words = F.split(F.lower(F.coalesce("text", F.lit(""))), r"\W+")
    minima = [F.array_min(F.transform(words, lambda w: F.xxhash64(w, F.lit(k)))) for k in range(hashes)]
    return sample.withColumn("minima", F.array(*minima)).dropDuplicates(["minima", "toxic"]).drop("minima")


def mined_terms(sample: DataFrame, most: int, least: int = 6, share: float = 0.01, precision: float = 0.97) -> list[str]:
    """Terms that labelled documents show to be toxic: `precision` of the documents that hold them are, and these are at
    least `least`, and a `share` of all toxic ones.

    sample has text and toxic; copies count once. A longer term is left out where one that covers it is in.
    """
    sample = stored(without_copies(sample), "labelled")
    least = max(least, math.ceil(share * sample.where("toxic = 1").count()))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 250):
                toxic, clean = Counter(), Counter()
                for text, y in zip(b["text"].iloc[at : at + 250], b["toxic"].iloc[at : at + 250]):
                    (toxic if y == 1 else clean).update(terms_of(text)[0].keys())
                terms = list(toxic.keys() | clean.keys())
                if terms:
                    yield pd.DataFrame({"term": terms, "toxic": [toxic[t] for t in terms], "clean": [clean[t] for t in terms]})

    counted = sample.select("text", "toxic").mapInPandas(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    good = counted.where((F.col("a") >= least) & (F.col("a") >= precision * (F.col("a") + F.col("b"))))
    rows = good.orderBy(F.desc("a"), F.col("term")).limit(8 * most).collect()
    kept: list[str] = []
    for r in rows:
        if not any(k.endswith("*") and r.term.startswith(k[:-1]) for k in kept):
            kept.append(r.term)
    return kept[:most]


def label_model(patterns: np.ndarray, counts: np.ndarray, known: np.ndarray, prior: float, rounds: int = 40) -> np.ndarray:
    """The posterior of each pattern of votes, by expectation-maximisation.

    known has, for each pattern, how many labelled rows are not toxic and toxic; they keep their labels, and have half the
    weight in all.
    Every voter has a distribution of its three votes in each class (its accuracy), estimated as if voters were
    independent. Then the correlations that voters show within the classes are estimated, and in the last step a voter's
    log-odds are shared out among those it is correlated with, so that agreeing voters do not count as so many witnesses.
    """
    weight = counts / counts.sum()
    told = known / max(1.0, known.sum())
    n = patterns.shape[1]
    post = 1 / (1 + np.exp(-np.clip(1.5 * patterns.sum(1) - 0.5, -6, 6)))

    def masses() -> tuple[np.ndarray, np.ndarray]:
        return post * weight + told[:, 1], (1 - post) * weight + told[:, 0]

    def posterior(share: np.ndarray) -> np.ndarray:
        classes = masses()
        odds = np.zeros(patterns.shape)
        for j in range(n):
            for v in (-1, 0, 1):
                is_v = patterns[:, j] == v
                p = [((m * is_v).sum() + 1e-4) / (m.sum() + 3e-4) for m in classes]
                odds[is_v, j] = math.log(p[0] / p[1])
        start = min(0.5, max(1e-3, 0.5 * prior + 0.5 * (post * weight).sum()))
        z = math.log(start / (1 - start)) + (odds * share).sum(1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    for _ in range(rounds):
        post = posterior(np.ones(n))
    linked = np.zeros((n, n))
    for m in masses():
        if m.sum() > 1e-9:
            centred = patterns - (patterns * m[:, None]).sum(0) / m.sum()
            cov = (centred * m[:, None]).T @ centred / m.sum()
            sd = np.sqrt(np.maximum(np.diag(cov), 0))
            both = np.outer(sd, sd)
            linked += np.where(both > 1e-6, np.abs(cov) / np.maximum(both, 1e-6), 0) * m.sum() / 2
    np.fill_diagonal(linked, 0)
    return posterior(1 / (1 + np.where(linked > 0.05, linked, 0).sum(1)))


@dataclass
class Model:
    """A lexicon, and a logistic classifier over term presence, bins of their number and the pattern voters."""

    lexicon: Lexicon
    weights: np.ndarray

    def features(self, text: str | None) -> list[int]:
        """Numbers of the features that hold."""
        hits, _ = self.lexicon.hits(text)
        v = votes(self.lexicon, text)
        n = len(self.lexicon.terms)
        out = list(hits)
        out += [n + k for k in range(BINS) if len(hits) > k]
        out += [n + BINS + 2 * (j - LEXICA) + (x > 0) for j, x in enumerate(v) if j >= LEXICA and x]
        return out

    def size(self) -> int:
        return len(self.lexicon.terms) + BINS + 2 * (VOTERS - LEXICA) + 1

    def score(self, text: str | None) -> float:
        z = self.weights[-1] + sum(self.weights[i] for i in self.features(text))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def logistic(rows: list[list[int]], labels: np.ndarray, size: int, steps: int = 400, decay: float = 1e-4) -> np.ndarray:
    """Weights on soft labels by gradient steps with Adam's scaling; the last is the bias."""
    which = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    cols = np.array([i for r in rows for i in r], np.int64)
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for step in range(1, steps + 1):
        z = w[-1] + np.bincount(which, w[cols], len(rows))
        e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels
        g = np.bincount(cols, e[which], size) / len(rows) + decay * w
        g[-1] = e.mean()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 12_000, terms: int = 256) -> Model:
    """Learns from documents, and from the labels of rows that aren't held out.

    At most `sample` labelled documents, those of the smallest hashes of doc_id, give terms to the lexica, and at most
    `sample` documents, chosen likewise, train the classifier on their posteriors. The label model's vote counts are of
    all documents; their table has at most 3^12 rows, however large the input. Rows with null ids or labels are not
    learned from; without any label the seed lexicon votes alone.
    """
    some = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out()).select("doc_id", "toxic")
    some = some.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    learned = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id")  # `sample` rows at most
    learned = stored(learned.select("text", "toxic"), "labelled")
    lexicon = Lexicon(list(dict.fromkeys([*SEEDS, *mined_terms(learned, terms)]))[: terms + len(SEEDS)])

    @F.arrow_udf("int")
    def vote(text: pa.Array) -> pa.Array:
        three = 3 ** np.arange(VOTERS)
        return pa.array([int(((np.array(votes(lexicon, t)) + 1) * three).sum()) for t in each(text)], pa.int32())

    counted = docs.select(vote(F.col("text").cast("string")).alias("votes")).groupBy("votes").count().collect()
    model = Model(lexicon, np.zeros(0))
    if not counted:
        model.weights = np.zeros(model.size())
        model.weights[-1] = -3.0
        return model
    codes = np.array([r.votes for r in counted], np.int64)
    patterns = codes[:, None] // 3 ** np.arange(VOTERS) % 3 - 1
    told = {(r.votes, r.toxic): r["count"] for r in learned.select(vote("text").alias("votes"), (F.col("toxic") == 1).alias("toxic")).groupBy("votes", "toxic").count().collect()}
    known = np.array([[told.get((c, False), 0), told.get((c, True), 0)] for c in codes.tolist()], float)
    rate = known[:, 1].sum() / known.sum() if known.sum() else 0.05
    post = dict(zip(codes.tolist(), label_model(patterns, np.array([r["count"] for r in counted], float), known, rate)))

    @F.arrow_udf("array<int>")
    def featured(text: pa.Array) -> pa.Array:
        return pa.array([model.features(t) for t in each(text)], pa.list_(pa.int32()))

    picked = docs.where("doc_id IS NOT NULL").where(~held_out()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id").select(featured("text").alias("x"), vote("text").alias("votes")).collect()
    model.weights = logistic([r.x for r in rows], np.array([post[r.votes] for r in rows]), model.size()) if rows else np.zeros(model.size())
    return model


def scored(text: Column, model: Model) -> Column:
    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array([model.score(t) for t in each(text)], pa.float64())

    return score(text.cast("string"))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row.

    Only the text is scored. Null and empty texts hold no term and get the score of such texts. Repeated rows stay
    repeated; an empty table gives an empty table. A null doc_id is not held out.
    """
    out = docs.select("doc_id", held_out().alias("held_out"), scored(F.col("text"), fit(docs, labels)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of docs that are not predicted toxic; all columns, nothing shuffled."""
    return docs.where(scored(F.col("text"), fit(docs, labels)) < threshold)
