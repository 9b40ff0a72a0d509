"""Quality rules against numpy, and the pipeline stage by stage."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rowmill.llm import mixing, neardup, outliers, toxicity
from rowmill.llm.words import word_count
from tests.llm.conftest import LONG, WORD


def statistics(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def brute_verdicts(rows):
    """doc key -> squared distance: minimum covariance determinant by numpy."""
    vectors, groups = {}, defaultdict(list)
    for i, (key, text, lang, source) in enumerate(rows):
        n, chars, symbols, dup, rep = statistics(text)
        if n >= 50 and 100 * rep <= 50 * n:
            vectors[i] = np.array([math.log(chars / n), math.sqrt(symbols / chars), math.sqrt(dup / n), math.sqrt(rep / n)])
            groups[lang, source].append(i)
    merged = defaultdict(list)
    small = Counter()
    for (lang, _), members in groups.items():
        small[lang] += len(members) if len(members) < outliers.MIN_ROWS else 0
    for (lang, source), members in groups.items():
        name = (lang, source) if len(members) >= outliers.MIN_ROWS else (lang, "rest of it") if small[lang] >= outliers.MIN_ROWS else "rest"
        merged[name] += members
    floor = np.diag(np.array(outliers.HARMLESS) ** 2)
    distance = {}
    for members in merged.values():
        z = np.stack([vectors[i] for i in members])

        def moments(x, factor):
            return x.mean(axis=0), factor * np.cov(x.T, bias=True).reshape(4, 4) + floor

        def d2(x, centre, scatter):
            return np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(scatter), x - centre)

        def quantile(buckets, share):
            values, counts = np.unique(buckets, return_counts=True)
            return values[np.searchsorted(np.cumsum(counts), share * len(buckets) - 1e-9)]

        fine = np.floor(z * 2000)
        low, mid, high = ([quantile(fine[:, j], s) for j in range(4)] for s in (0.25, 0.5, 0.75))
        spread = np.maximum((np.array(high) - low) / (1.349 * 2000), outliers.HARMLESS)
        fits = []
        for centre, scatter in (((np.array(mid) + 0.5) / 2000, np.diag(spread**2)), moments(z, 1.0)):
            for _ in range(outliers.STEPS):
                bucket = np.floor(64 * np.log2(1 + d2(z, centre, scatter)))
                centre, scatter = moments(z[bucket <= quantile(bucket, 0.5)], outliers.HALF_FACTOR)
            fits.append((np.linalg.det(scatter), centre, scatter))
        _, centre, scatter = min(fits, key=lambda f: f[0])
        centre, scatter = moments(z[d2(z, centre, scatter) <= outliers.NEAR], outliers.NEAR_FACTOR)
        distance |= dict(zip(members, d2(z, centre, scatter)))
    return [distance.get(i) for i in range(len(rows))]


def test_documents_against_numpy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    expected = {r[0]: (statistics(r[1]), d) for r, d in zip(rows, brute_verdicts(rows))}
    for r in outliers.quality_rules(docs).collect():
        stats, d = expected[r["doc_id"]]
        assert tuple(r[c] for c in outliers.STATISTICS) == stats
        assert r["base_failed"] == (d is None)
        assert r["kept"] == (d is not None and d <= outliers.CUTOFF)
        assert d is None or math.isclose(r["distance"], d, rel_tol=0.02, abs_tol=0.02)


def test_quality_keeps_good_documents(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = outliers.quality_rules(spark.read.parquet(f"{folder}/documents.parquet")).where("NOT base_failed").join(labels, "doc_id")
    kept = {r["quality"]: r["share"] for r in rows.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert kept[1] >= 0.99 and kept[0] <= 0.05


def test_repetition_in_a_clean_group_is_rejected(spark):
    """45 % repeated words, or half of the lines repeated, are allowed by the base rule but stand out."""
    word = lambda doc, i: f"w{doc % 10}{i % 10}{chr(97 + i // 10 % 26)}{chr(97 + doc // 10 % 26)}"
    clean = [[word(d, i) for i in range(120)] for d in range(200)]
    phrase = [f"ab{i:02}c" for i in range(27)]
    repeated = [*phrase, *phrase, *clean[0][:66]]
    line = " ".join(f"xy{i:02}z" for i in range(3))
    lines = [*[line] * 20, *[" ".join(clean[1][i : i + 3]) for i in range(0, 63, 3)]]
    rows = [(i, " ".join(w)) for i, w in enumerate(clean)] + [(-1, " ".join(repeated)), (-2, "\n".join(lines))]
    df = spark.createDataFrame([(i, t, "en", "a") for i, t in rows], "doc_id bigint, text string, lang string, source string")
    found = {r["doc_id"]: r for r in outliers.quality_rules(df).collect()}
    assert not any(found[i]["base_failed"] for i in (-1, -2))
    assert not found[-1]["kept"] and not found[-2]["kept"]
    assert all(r["kept"] for i, r in found.items() if i >= 0)


@pytest.mark.parametrize("text", ["a b c a b c", "a a a a a", "a b c x a b c y a b c", "x\nx\n \ny\nx", "#a *b | c", "a b", LONG])
def test_statistics(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(outliers.text_statistics(F.col("t")).alias("s")).select("s.*").first()
    assert tuple(row[c] for c in outliers.STATISTICS) == statistics(text)


def test_odd_rows(odd, odd_rows, none):
    found = outliers.quality_rules(odd).collect()
    key = lambda r: str(r)
    assert sorted(((r["doc_id"], *(r[c] for c in outliers.STATISTICS)) for r in found), key=key) == sorted(((r[0], *statistics(r[1])) for r in odd_rows), key=key)
    assert all(not r["kept"] for r in found if r["base_failed"])
    assert outliers.quality_rules(none).count() == 0


def rows_of(df):
    return Counter(tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect())


def test_stages_take_effect(spark, sf_dir, docs):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    ids = lambda df: Counter(r[0] for r in df.select("doc_id").collect())

    model = toxicity.learn(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    calm = corpus_pipeline.toxic_documents_go(spark, docs, sf_dir)
    assert ids(calm) == ids(docs.where(toxicity.score(F.col("text"), model) < 0.3)) and calm.columns == docs.columns

    good = corpus_pipeline.poor_documents_go(spark, docs, sf_dir)
    assert ids(good) == ids(outliers.quality_rules(docs).where("kept")) and good.columns == docs.columns

    single = corpus_pipeline.one_of_each_group_stays(spark, docs, sf_dir)
    assert ids(single) == ids(neardup.near_duplicates(docs).where("kept")) and rows_of(single) <= rows_of(docs)

    taken = corpus_pipeline.sources_meet_their_weights(spark, docs, sf_dir)
    expected = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(docs, word_count(F.col("text"))).where("taken > 0").collect()}
    assert ids(taken) == Counter(expected) and all(texts[r[0]] == r[1] for r in taken.select("doc_id", "text").collect())

    packed = corpus_pipeline.sequences_are_packed(spark, docs, sf_dir)
    assert set(ids(packed)) == set(texts)


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, sf_dir, odd, none, stage):
    out = stage(spark, odd, sf_dir)
    assert stage is corpus_pipeline.sequences_are_packed or out.columns == odd.columns
    out.collect()
    assert stage(spark, none, sf_dir).count() == 0


def test_repeated_rows_leave_one(spark, sf_dir, odd):
    kept = rows_of(corpus_pipeline.one_of_each_group_stays(spark, odd, sf_dir))
    assert sum(n for row, n in kept.items() if row[0] == 9) == 1
    assert sum(n for row, n in kept.items() if row[0] in (1, 2)) == 1
    assert all((i, t) in {(r[0], r[1]) for r in kept} for i, t in ((3, None), (4, ""), (10, "<|endoftext|> a b")))


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    fill = out.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert out.count() > 0 and fill.agg(F.max("n")).first()[0] <= 4096
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "near-duplicates", "mixing", "packing"]


def test_registered_queries_and_their_sql(spark, sf_dir):
    from rowmill.llm.queries import ORACLES, QUERIES
    from tools.check_queries import compare, connect

    duck = connect(sf_dir)
    assert {re.match(r"op\d+|pipeline", n)[0] for n in QUERIES} == {*(f"op{i}" for i in range(1, 14)), "pipeline"}
    for name, sql in ORACLES.items():
        df, expected = QUERIES[name](spark, sf_dir), duck.execute(sql)
        assert compare(df.columns, [tuple(r) for r in df.collect()], [d[0] for d in expected.description], expected.fetchall()) == "exact"


def test_groups_are_told_apart_by_their_texts(spark, sf_dir):
    """Unrelated documents with one doc_id, or with none, stay; near copies without doc_ids leave one row."""
    words = lambda seed, n=60: " ".join(f"w{(seed * 7919 + i * i) % 1009}x{seed}" for i in range(n))
    near = words(5).rsplit(" ", 1)[0]
    rows = [(7, words(1)), (7, words(2)), (8, words(1)), (None, words(3)), (None, words(4)), (None, words(5)), (None, near), (None, words(5) + " end"), (9, "")]
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.one_of_each_group_stays(spark, df, sf_dir).collect()]
    assert len(kept) == 6 and {k for k in kept if k[0]} == {(7, words(1)), (7, words(2)), (9, "")}
    assert {t for i, t in kept if i is None} >= {words(3), words(4)}
