"""Quality classifier without labels: heuristic labellers, their accuracies by
expectation-maximisation, and a hashed linear scorer trained on the posterior labels.

Each labeller looks at one side of a text and votes good, bad or nothing. Rows are
counted by their pattern of votes, so that the estimation sees all rows through a
table of bounded size. The scorer never sees votes: it weighs hashed shapes of words.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.llm.outliers import text_statistics
from rowmill.llm.words import let, words

#: Rows that the scorer is trained on at most: those with the smallest hash of their doc_id.
MOST_ROWS = 6_000
BUCKETS = 4_096
LABELLERS = 8

SHAPES = bytes.maketrans(
    bytes(range(97, 123)) + bytes(range(65, 91)) + bytes(range(48, 58)) + bytes(range(128, 256)), b"x" * 26 + b"X" * 26 + b"9" * 10 + b"x" * 128
)
RUN = re.compile(rb"(.)\1+")


def votes(text: Column) -> Column:
    """One character per labeller: + good, - bad, 0 nothing. A text without words has no votes."""

    def on(s: Column) -> Column:
        n, chars = F.greatest(s["n_words"], F.lit(1)).cast("double"), F.greatest(s["word_chars"], F.lit(1)).cast("double")
        length, symbols, repeated = chars / n, s["n_symbols"] / chars, s["n_repeat_words"] / n
        distinct, upper, stops = s["n_distinct"] / n, s["n_upper"] / chars, s["n_stops"] / n
        some, long = s["n_words"] >= 20, s["n_words"] >= 50
        complaints = [symbols > 0.05, repeated > 0.3, some & ((length < 3) | (length > 7.2)), some & (upper > 0.25), long & (distinct < 0.2), long & (s["n_dup_lines"] > 2)]
        plain = (symbols < 0.01) & (repeated < 0.15) & length.between(3.5, 7) & (upper < 0.15) & (~long | (distinct > 0.3))
        sentences = F.when(long & ((stops > 0.5) | (stops < 0.004)), "-").when(plain & stops.between(0.02, 0.3), "+").otherwise("0")
        cast = F.concat(*[F.when(c, "-").otherwise("0") for c in complaints], sentences, F.when(plain, "+").otherwise("0"))
        return F.when(s["n_words"] == 0, F.lit("0" * LABELLERS)).otherwise(cast)

    text = F.coalesce(text, F.lit(""))
    more = let(words(text), lambda w: F.size(F.array_distinct(w)))
    stats = let(text_statistics(text), lambda s: F.struct(
        s["n_words"].alias("n_words"), s["word_chars"].alias("word_chars"), s["n_symbols"].alias("n_symbols"), s["n_dup_lines"].alias("n_dup_lines"), s["n_repeat_words"].alias("n_repeat_words"),
        more.alias("n_distinct"), F.regexp_count(text, F.lit(r"\p{Lu}")).alias("n_upper"), F.regexp_count(text, F.lit(r"[.!?](?=\s|$)")).alias("n_stops"),
    ))
    return let(stats, on)


def estimate(patterns: dict[str, int], steps: int = 200) -> tuple[dict[str, float], list[float]]:
    """The chance that each pattern's rows are good, and each labeller's accuracy: the chance that a vote of its is right.

    Labellers are taken to be right or wrong independently of each other; voting nothing
    says nothing. Either class is taken to be as likely before the votes, or else the
    rarer class's labellers would be explained away as errors. It starts from rows with
    a bad vote being bad, others good.
    """
    keys = list(patterns)
    counts = np.array([patterns[k] for k in keys], float)
    cast = np.array([["-0+".index(c) - 1 for c in k] for k in keys])
    good = np.where((cast < 0).any(axis=1), 0.02, 0.98)
    for _ in range(steps):
        right = np.where(cast > 0, good[:, None], np.where(cast < 0, 1 - good[:, None], 0.0))
        accuracy = (counts @ right + 4) / (counts @ (cast != 0) + 4.5)
        before, good = good, 1 / (1 + np.exp(-np.clip(cast @ np.log(accuracy / (1 - accuracy + 1e-9)), -30, 30)))
        if np.abs(before - good).max() < 1e-6:
            break
    return dict(zip(keys, good.tolist())), accuracy.tolist()


@lru_cache(maxsize=100_000)
def _bucket(shape: bytes) -> int:
    return zlib.crc32(RUN.sub(rb"\1\1", shape)) % BUCKETS


def _features(text: str | None) -> dict[int, float]:
    """Shares of hashed word shapes, and what kind of text it is by its distinct words and length, hashed too."""
    octets = (text or "").encode("utf-8", "replace")
    shapes = Counter(octets.translate(SHAPES).split())
    n = sum(shapes.values())
    out: dict[int, float] = {}
    for shape, count in shapes.items():
        b = _bucket(shape)
        out[b] = out.get(b, 0.0) + count / n
    distinct = len(set(octets.lower().split())) / n if n else 1.0
    for name in (b"distinct %d" % int(10 * distinct), b"length %d" % min(3, n.bit_length() // 3)):
        b = zlib.crc32(name) % BUCKETS
        out[b] = out.get(b, 0.0) + 1.0
    return out


def _train(rows: list, steps: int = 300) -> list[float]:
    """Logistic regression on sparse rows (index, value, label between 0 and 1), by AdaGrad on all rows at once."""
    row = np.repeat(np.arange(len(rows)), [len(r["index"]) for r in rows])
    index, value = np.concatenate([r["index"] for r in rows]).astype(np.int64), np.concatenate([r["value"] for r in rows])
    y = np.array([r["label"] for r in rows])
    w, squares = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-8)
    balance = np.where(y >= 0.5, 0.5 / max(1e-9, (y >= 0.5).mean()), 0.5 / max(1e-9, (y < 0.5).mean()))
    for _ in range(steps):
        margin = np.bincount(row, w[index] * value, len(rows)) + w[-1]
        error = balance * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) / len(rows)
        gradient = np.append(np.bincount(index, error[row] * value, BUCKETS), error.sum()) + 1e-5 * w
        squares += gradient**2
        w -= 0.5 * gradient / np.sqrt(squares)
    return [round(x, 6) for x in w.tolist()]


def learn(docs: DataFrame) -> str:
    """The scorer's weights (JSON), from documents alone.

    All rows are counted by their votes; at most 3 ** 8 patterns reach the driver. The
    scorer is fitted on at most `MOST_ROWS` different texts, those with the smallest hashes;
    doc_ids are not read. Null texts vote nothing; an empty table gives a
    scorer that finds everything good.
    """
    voted = docs.select(votes(F.col("text")).alias("votes"))
    patterns = dict(voted.groupBy("votes").count().collect())
    if not patterns:
        return json.dumps([0.0] * BUCKETS + [5.0])
    posterior, _ = estimate(patterns)
    # different texts by hash, so that neither doc_ids nor copies have a say in the choice
    hashed = docs.select("text", F.xxhash64("text").alias("h")).where("text IS NOT NULL")
    edge = hashed.groupBy("h").count().select("h").orderBy("h").limit(MOST_ROWS)
    sample = hashed.join(F.broadcast(edge), "h", "left_semi").groupBy("h").agg(F.min("text").alias("text"))
    sample = sample.orderBy("h").select("text", votes(F.col("text")).alias("votes"))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_features(t) for t in batch.column("text").to_pylist()]
            labels = [posterior[v] for v in batch.column("votes").to_pylist()]
            yield pa.RecordBatch.from_pydict({"index": pa.array([list(f) for f in found], pa.list_(pa.int32())), "value": pa.array([list(f.values()) for f in found], pa.list_(pa.float64())), "label": labels})

    rows = sample.mapInArrow(featured, "index array<int>, value array<double>, label double").toPandas()
    return json.dumps(_train(rows.to_dict("records"))) if len(rows) else json.dumps([0.0] * BUCKETS + [5.0])


def score(text: Column, weights: str) -> Column:
    """The quality of a whole text, 0 to 1; null and empty texts have a score too, that of a text without shapes."""
    packed = np.array(json.loads(weights)).tobytes()

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        w = np.frombuffer(packed)
        margins = [w[-1] + sum(w[i] * x for i, x in _features(t).items()) for t in texts]
        return pd.Series(1 / (1 + np.exp(-np.clip(np.array(margins, float), -30, 30))))

    return scored(text)
