"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded texts.

Folding lower-cases a text, replaces letters of other scripts that look like Latin
ones and digits or signs that stand for letters inside words, and reduces it to
words between single blanks. The lexicon's entries are whole words and beginnings of
words with weights; hits inside exception phrases do not count. The sum of the
weights, alone and per word of the text, gives the score through a logistic curve.
Entries, exceptions and the curve are learned from labelled rows.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.plans.lineage import written

#: Labelled rows of either class that learning uses at most, those with the smallest hash of their doc_id.
MOST_TOXIC, MOST_CLEAN = 4_000, 8_000
#: An entry occurs in so many toxic rows, is this much likelier in them (logarithm), and this hard to explain by chance (G statistic).
LEAST_ROWS, LEAST_LOG_ODDS, LEAST_G = 3, 2.0, 18.0
PREFIXES = range(3, 9)

# Letters that look like Latin ones.
LOOKALIKES = str.maketrans(
    "аеорсухіјѕԁһѵкмтвнгԛԝ" "αοερινκτυχ" "ɑɡıⅼ",
    "aeopcyxijsdhvkmtbhrqw" "aoepivktux" "agil",
)
# Digits and signs that stand for letters.
STAND_INS = str.maketrans("013457@$!|", "oieast" "asil")
INVISIBLE = re.compile("[­​-‏⁠﻿]")
FOREIGN = re.compile("[­ıɑɡͰ-ԯ​-‏⁠ⅰ-ⅿﬀ-ﬆ﻿＀-￯]")
MIXED = re.compile(r"(?:(?<=[^\W\d_])[013457]+|(?<=[^\W\d_])[@$!|013457]+(?=[^\W\d_])|(?<![^\W_])[@$!|013457]+(?=[^\W\d_]))")
TOKEN = re.compile(r"\S*[013457@$!|]\S*")
GAP = re.compile(r"[\W\d_]+")


def fold(text: str | None) -> str:
    """The words of a text, folded, between single blanks, with one before the first and one behind the last."""
    text = (text or "").lower()
    if FOREIGN.search(text):
        text = INVISIBLE.sub("", unicodedata.normalize("NFKC", text)).translate(LOOKALIKES)
    if MIXED.search(text):
        either = []

        def plain(token: re.Match) -> str:
            if not MIXED.search(token[0]):
                return token[0]
            if "1" in token[0]:  # stands for i or for l
                either.append(MIXED.sub(lambda m: m[0].replace("1", "l").translate(STAND_INS), token[0]))
            return MIXED.sub(lambda m: m[0].translate(STAND_INS), token[0])

        text = " ".join([TOKEN.sub(plain, text), *either])
    return f" {GAP.sub(' ', text).strip()} "


@lru_cache(maxsize=4)
def _automaton(model: str):
    """The automaton of a model: values are weights of entries, None for exceptions."""
    import ahocorasick

    found, spec = ahocorasick.Automaton(), json.loads(model)
    for entry, weight in spec["entries"].items():
        found.add_word(entry, (len(entry), weight))
    for phrase in spec["exceptions"]:
        found.add_word(phrase, (len(phrase), None))
    if len(found):
        found.make_automaton()
    return found if len(found) else None, spec["curve"]


def _hits(automaton, folded: str) -> dict[int, float]:
    """The largest weight of entries at each word of a folded text, but for words in exception phrases."""
    found: dict[int, float] = {}
    excused: list[tuple[int, int]] = []
    for end, (length, weight) in automaton.iter(folded):
        start = end - length + 1
        if weight is None:
            excused.append((start, end))
        else:
            found[start] = max(weight, found.get(start, weight))
    for start, end in excused:
        for at in [at for at in found if start <= at < end]:
            del found[at]
    return found


def _features(automaton, text: str | None) -> tuple[float, float]:
    """Logarithms of the hits' weights, in sum and per hundred words."""
    if automaton is None:
        return 0.0, 0.0
    folded = fold(text)
    total = sum(_hits(automaton, folded).values())
    return math.log1p(total), math.log1p(100 * total / max(1, folded.count(" ") - 1))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[float]:
    """Weighted logistic regression with a ridge, by Newton's method."""
    design = np.column_stack([np.ones(len(x)), x])
    beta, ridge = np.zeros(design.shape[1]), np.diag([1e-3] + [1e-2] * (design.shape[1] - 1)) * len(x) / 100
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge
        step = np.linalg.solve(hessian, design.T @ (weight * (y - p)) - ridge @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta.tolist()


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled rows to learn from: text and toxic, one for each doc_id, bounded for either class.

    Of rows that share a doc_id, the text with the smallest hash counts.
    """
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = lambda label, most: known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    chosen = pick(1, MOST_TOXIC).unionByName(pick(0, MOST_CLEAN))  # so few rows that they go to all tasks
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    single = rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic"))
    return written(single.select("text", "toxic"), "labelled")


def _counts(sample: DataFrame, terms) -> DataFrame:
    """In how many toxic and clean rows each of the terms that `terms` finds in a text occurs."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                found[toxic].update(terms(text))
        keys = list(dict.fromkeys([*found[1], *found[0]]))
        for at in range(0, len(keys), 50_000):
            part = keys[at : at + 50_000]
            yield pa.RecordBatch.from_pydict({"term": part, "pos": pa.array([found[1][k] for k in part], pa.int64()), "neg": pa.array([found[0][k] for k in part], pa.int64())})

    counts = sample.mapInArrow(counted, "term string, pos bigint, neg bigint")
    return counts.groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _word_terms(text: str | None) -> set[str]:
    found = set()
    for word in set(fold(text).split()):
        found.add(f" {word} ")
        found.update(f" {word[:n]}" for n in PREFIXES if n < len(word))
    return found


def _log_odds(n_toxic: int, n_clean: int) -> Column:
    rate = lambda c, n: (F.col(c) + 0.5) / (n + 1.0)
    return F.log(rate("pos", n_toxic)) - F.log(rate("neg", n_clean))


def _chosen(rows: list) -> dict[str, float]:
    """Entries from candidates: of beginnings that say the same, the longest; none below another entry that covers it."""
    entries: dict[str, float] = {}
    above: dict[str, int] = {}  # by beginning: rows with the most frequent entry that begins so
    for row in sorted(rows, key=lambda r: (-r["g"], -len(r["term"]), r["term"])):
        term = row["term"]
        below = any(term[:n] in entries for n in range(2, len(term)))
        if not below and row["pos"] > 1.1 * above.get(term, 0):
            entries[term] = row["log_odds"]
            for n in range(1, len(term) + 1):
                above[term[:n]] = max(above.get(term[:n], 0), row["pos"])
    return entries


def learn(docs: DataFrame, labels: DataFrame, exceptions: list[str] | None = None) -> str:
    """A model (JSON) from documents and labels (doc_id, toxic 0 or 1; other rows don't count).

    Rows are bounded by `MOST_TOXIC` and `MOST_CLEAN`; the curve gives either class its
    full weight. `exceptions` are phrases whose hits never count; others are found
    among the phrases around hits that occur mostly in clean rows. Without toxic or
    without clean rows the model gives 0 to every text.
    """
    sample = _sample(docs, labels)
    have = dict(sample.groupBy("toxic").count().collect())
    n_toxic, n_clean = have.get(1, 0), have.get(0, 0)
    if not n_toxic or not n_clean:
        return json.dumps({"entries": {}, "exceptions": [], "curve": [-30.0, 0.0, 0.0]})
    size = {r["toxic"]: r["n"] for r in labels.where("toxic IN (0, 1)").groupBy("toxic").agg(F.count_distinct("doc_id").alias("n")).collect()}
    expected = lambda a, n: a * F.log(F.greatest(a, F.lit(1e-9)) / ((F.col("pos") + F.col("neg")) * n / (n_toxic + n_clean)))
    g = 2 * (expected(F.col("pos"), n_toxic) + expected(F.col("neg"), n_clean))
    likely = _counts(sample, _word_terms).withColumns({"log_odds": _log_odds(n_toxic, n_clean), "g": g})
    likely = likely.where((F.col("pos") >= LEAST_ROWS) & (F.col("log_odds") >= LEAST_LOG_ODDS) & (F.col("g") >= LEAST_G))
    entries = _chosen(likely.collect())  # of the words of a bounded sample
    own = [fold(phrase) for phrase in exceptions or []]
    bare = json.dumps({"entries": entries, "exceptions": own, "curve": [0.0, 0.0, 0.0]})

    def around(text: str | None) -> set[str]:
        automaton, _ = _automaton(bare)
        folded, found = fold(text), set()
        for at in _hits(automaton, folded) if automaton else ():
            end = folded.index(" ", at + 1)
            before, after = folded.rfind(" ", 0, at), folded.find(" ", end + 1)
            found.add(folded[at : end + 1])
            if before >= 0:
                found.add(folded[before : end + 1])
            if after >= 0:
                found.add(folded[at : after + 1])
        return found

    excused = _counts(sample, around).where((F.col("neg") >= LEAST_ROWS) & (_log_odds(n_toxic, n_clean) <= -0.5))
    phrases = own + [r["term"] for r in excused.orderBy(F.col("neg").desc(), "term").collect()]
    model = json.dumps({"entries": entries, "exceptions": phrases, "curve": [0.0, 0.0, 0.0]})

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, _ = _automaton(model)
        for batch in batches:
            x = [_features(automaton, text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"a": [v[0] for v in x], "b": [v[1] for v in x], "toxic": batch.column("toxic").cast(pa.int32())})

    rows = np.array(sample.mapInArrow(measured, "a double, b double, toxic int").collect(), float).reshape(-1, 3)
    y = rows[:, 2]
    curve = _logistic(rows[:, :2], y, np.where(y == 1, size.get(1, n_toxic) / n_toxic, size.get(0, n_clean) / n_clean))
    return json.dumps({"entries": entries, "exceptions": phrases, "curve": curve})


def score(text: Column, model: str) -> Column:
    """The toxicity of a whole text, 0 to 1; null and empty texts get what a text without hits gets."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        automaton, (c, a, b) = _automaton(model)
        x = np.array([_features(automaton, t) for t in texts], float).reshape(-1, 2)
        return pd.Series(1 / (1 + np.exp(-np.clip(c + a * x[:, 0] + b * x[:, 1], -30, 30))))

    return scored(text)


def held_out(doc_id: Column) -> Column:
    """Rows that learning must not see."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
