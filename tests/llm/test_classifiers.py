"""Toxicity, weak-label quality and page extraction: held-out accuracy and small cases."""

import html
import json
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowmill.llm import mincut, toxicity, weaklabels
from tests.llm.conftest import SCHEMA


@pytest.fixture(scope="module")
def insults(spark):
    """Documents and labels: two insults, and a phrase in which one of them is harmless."""
    rng = np.random.default_rng(4)
    words = [f"{a}{b}" for a in ("ba", "do", "ki", "lu", "mo", "ne", "ro", "ta") for b in ("b", "nd", "rk", "st", "lm", "x")]
    rows, labels = [], []
    for i in range(400):
        text = list(rng.choice(words, 60))
        if i % 4 == 0:
            text[10] = text[30] = "blockhead"
            text[20] = "Scoundrels"
        elif i % 4 == 1:
            text[10:12] = ["scoundrels", "bay"]
        rows.append((i, " ".join(text), "en", "a", 0))
        labels.append((i, int(i % 4 == 0)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, toxic int")


@pytest.fixture(scope="module")
def model(insults):
    return toxicity.learn(*insults)


def scores(spark, model, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r[0] for r in df.select("i", toxicity.score(F.col("text"), model).alias("s")).orderBy("i").select("s").collect()]


def test_lexicon_and_exceptions(spark, model):
    spec = json.loads(model)
    assert any(e.startswith(" blockhead"[: len(e)]) for e in spec["entries"])
    filler = "barn dost kilm " * 12
    plain, toxic, hidden, greek, harmless = scores(
        spark, model, filler, filler + "you blockhead and blockhead scoundrels", filler + "you bl0ckhe4d and b1ockhead scoundre1s", filler + "you blοckheаd and blοckheаd scoundrels", filler + "scoundrels bay"
    )
    assert plain < 0.3 and harmless < 0.3 and toxic >= 0.3
    assert hidden >= 0.3 and greek >= 0.3
    assert all(0 <= s <= 1 for s in (plain, toxic, hidden, greek, harmless))


def test_longer_texts_need_more_hits(spark, model):
    a, b = scores(spark, model, "barn dost " * 20 + "blockhead", "barn dost " * 2000 + "blockhead")
    assert a > b


def test_odd_texts_have_scores(odd, model, odd_rows):
    found = odd.select(toxicity.score(F.col("text"), model).alias("s")).collect()
    assert len(found) == len(odd_rows) and all(0 <= r["s"] <= 1 for r in found)


@pytest.mark.parametrize("keep", ["toxic = 1", "toxic = 0", "toxic = 5"])
def test_without_both_classes_nothing_is_toxic(spark, insults, none, keep):
    docs, labels = insults
    model = toxicity.learn(docs, labels.where(keep))
    assert max(scores(spark, model, "blockhead", None, "")) < 0.3
    assert toxicity.learn(none, labels) == model
    assert none.select(toxicity.score(F.col("text"), model)).count() == 0


@pytest.mark.parametrize("text, folded", [
    (None, " " + " "), ("", " " + " "), ("Hello,  World!", " hello world "), ("1diot", " idiot ldiot "), ("idi0t covid 19", " idiot covid "), ("іdіоt", " idiot "), ("i​diot ｉｄ", " idiot id "), ("thon$$$ 5%", " thon "),
])
def test_folding(text, folded):
    assert toxicity.fold(text) == folded


def test_held_out_toxicity(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/labels.parquet")
    model = toxicity.learn(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    hit = F.col("score") >= 0.3
    rows = docs.join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).select("lang", "toxic", toxicity.score(F.col("text"), model).alias("score"))
    english = rows.where("lang = 'en'").groupBy("toxic").agg(F.avg(hit.cast("int"))).collect()
    assert dict(english)[1] >= 0.9
    assert rows.where("toxic = 0").agg(F.avg(hit.cast("int"))).first()[0] <= 0.02


def test_weak_labels_against_labels(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = docs.join(labels, "doc_id").select("quality", weaklabels.score(F.col("text"), weaklabels.learn(docs)).alias("s"))
    right = dict(rows.groupBy("quality").agg(F.avg(((F.col("s") >= 0.5) == (F.col("quality") == 1)).cast("int"))).collect())
    assert right[1] >= 0.98 and right[0] >= 0.9


def test_accuracies_come_back():
    rng = np.random.default_rng(0)
    truth = rng.random(20000) < 0.6
    accuracy, patterns = [0.95, 0.85, 0.7], {}
    for t in truth:
        votes = "".join("0" if rng.random() < 0.3 else "+" if (rng.random() < a) == t else "-" for a in accuracy)
        patterns[votes] = patterns.get(votes, 0) + 1
    posterior, found = weaklabels.estimate(patterns)
    assert np.allclose(found, accuracy, atol=0.06) and posterior["+++"] > 0.95 > 0.05 > posterior["---"]


def test_weak_labels_of_odd_rows(odd, odd_rows, none):
    weights = weaklabels.learn(odd)
    found = odd.select(weaklabels.score(F.col("text"), weights).alias("s")).collect()
    assert len(found) == len(odd_rows) and all(0 <= r["s"] <= 1 for r in found)
    assert none.select(weaklabels.score(F.col("text"), weaklabels.learn(none))).count() == 0


def lines(page):
    return mincut.main_text(page, mincut.UNTRAINED).split("\n")


def test_a_page_with_many_side_parts():
    page = """<html><body class="has-sidebar"><div id="header" class="header">Site <a href=/>home</a></div><div class="wrapper sidebar-left">
    <div class="menu"><ul><li><a>One</a><li><a>Two</a></ul></div><main><article class=post><header><h1>Real title</h1></header>
    <p>First para with   some words\n that goes on.<p>Second &amp; para&nbsp;here, with a <a href=x>link</a> inside.<div class=ad>Buy now!</div><!-- no > --><ul><li>item one is here.<li>item two</ul>
    <script>if (a < b) { "<p>not text</p>" }</script><form><label>Name</label><input><button>Send</button></form></article>
    <section id=comments><h3>Comments</h3><article class=comment><p>I think this is a very long comment by a reader, with sentences.</p></article></section></main>
    <aside>Related stuff</aside></div><footer>(c) 2020</footer><div class="cookie-notice">We use cookies to improve, accept.</div></body></html>"""
    assert lines(page) == ["Real title", "First para with some words that goes on.", "Second & para here, with a link inside.", "item one is here.", "item two"]


def test_a_page_without_named_parts():
    text = "Long text about the matter at hand, with many words and a proper end."
    page = f"<body><div><a href=1>Home</a> <a>About</a></div><div><p>{text}</p><p>And short.</p><p>More {text}</p></div><div><a>Imprint</a> | <a>Contact</a></div>"
    assert lines(page) == [text, "And short.", f"More {text}"]


@pytest.mark.parametrize("icon", ["<svg/>", "<svg class='icon' />", "<SVG width=1 />", "<svg><path d='M0'/><text>no text</text></svg>"])
def test_an_icon_hides_no_text_after_it(icon):
    first, second = "Long text about the matter at hand, with many words.", "More long text about the matter, with a proper end."
    page = f"<body><article><p>{first}</p>{icon}<p>{second}</p></article></body>"
    assert lines(page) == [first, second] and lines(page + icon) == [first, second]


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<script>", "<!--", "a < b <p x='>", "</div></p>", "<p>" * 3000, "<a" + "\"" * 50])
def test_broken_pages_do_not_crash(page):
    assert isinstance(mincut.main_text(page, mincut.UNTRAINED), str)


def test_minimum_cut_against_all_labellings():
    rng = np.random.default_rng(7)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        costs = [float(x) for x in rng.normal(0, 2, n).round(2)]
        edges = [(i, j, float(rng.random())) for i in range(n) for j in range(i) if rng.random() < 0.5]
        price = lambda keep: sum(max(0, c) if not k else max(0, -c) for c, k in zip(costs, keep)) + sum(w for a, b, w in edges if keep[a] != keep[b])
        best = min(price([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert abs(price(mincut.minimum_cut(costs, edges)) - best) < 1e-6


def test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    raw = {r["page_id"]: r["html"] for r in pages.collect()}
    found = mincut.extract_main_text(pages.withColumn("text", F.lit("other")), mincut.fit(pages)).collect()
    assert len(found) == len(raw)
    for r in found:
        body = raw[r["page_id"]].split("<article>")[1].split("</article>")[0].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", body)]
        assert r["text"] == "\n".join(b for b in blocks if b)


def test_odd_pages(spark):
    rows = [(1, None, None), (1, "u", ""), (None, "u", "<p>x</p>"), (2, "u", "<article><p>" + "word " * 200_000 + "</p></article>"), (2, "u", "<p>" + "<b>a</b><p>" * 20_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = mincut.extract_main_text(pages, mincut.fit(pages)).collect()
    assert len(found) == 5 and max(len(r["text"]) for r in found) == 999_999
    empty = pages.limit(0)
    assert mincut.extract_main_text(empty, mincut.fit(empty)).count() == 0


def without_names(page):
    """The page with every element that names its role turned into a div, and without classes, ids and roles."""
    page = re.sub(r"<(/?)(?:article|nav|aside|footer|header|main|section)\b", r"<\1div", page)
    return re.sub(r"\s(?:class|id|role)=(?:\"[^\"]*\"|'[^']*')", "", page)


def test_pages_without_names_are_told_apart_by_the_cut(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    weights = json.loads(mincut.fit(pages))
    kept = whole = wrong = rest = decided = 0
    for (page,) in pages.where("html is not null").select("html").collect():
        named, plain = mincut.read_blocks(page), mincut.read_blocks(without_names(page))
        labels = mincut.label_blocks(plain, weights)
        assert [b.text for b in named] == [b.text for b in plain] and not any(b.named() for b in plain)
        decided += sum((c > 0) != label for c, label in zip(mincut.block_costs(plain, weights), labels))
        for block, label in zip(named, labels):
            size = len(block.text)
            whole, kept, rest, wrong = (whole + size, kept + size * label, rest, wrong) if block.named() > 0 else (whole, kept, rest + size, wrong + size * label)
    assert kept >= 0.9 * whole and wrong <= 0.1 * rest


def test_the_cut_goes_against_words_and_names():
    """A short line between paragraphs stays with them; so does a paragraph whose name speaks against it, unless its words do too."""
    long = "<p>This paragraph is long enough to be a sentence of an article, and it ends like one.</p>"
    weights = [-2.0, 1.6, -4.0, 1.5, 1.0, -0.5]

    def decided(page):
        blocks = mincut.read_blocks(page)
        labels = mincut.label_blocks(blocks, weights)
        return [b.text for b, c, label in zip(blocks, mincut.block_costs(blocks, weights), labels) if (c > 0) != label], mincut.main_text(page, weights)

    against, text = decided(f"<div>{long}<div>Yes</div>{long}{long}</div>")
    assert against == ["Yes"] and "Yes" in text
    against, text = decided(f"<article>{long * 2}<p class='share'>{long[3:-4]}</p>{long * 2}</article>")
    assert len(against) == 1 and text.count("\n") == 4
    against, text = decided(f"<article>{long * 2}</article><ul class='share'><li><a href='x'>this</a></li></ul>")
    assert against == [] and "this" not in text


def test_names_inside_an_article():
    long = "This paragraph is long enough to be a sentence of an article, and it ends like one."
    page = (
        f"<nav>Menu</nav><article><div class='entry-header'><h1>The title</h1></div><header><h2>Second head</h2></header><p>{long}</p><p class='note-related'>{long}</p>"
        f"<ul class='list-tags'><li><a href='a'>tag</a></li></ul><aside><p>{long}</p></aside><footer>Foot</footer><p>{long}</p></article><div class='site-footer'><p>{long}</p></div>"
        f"<section class='comments'><article><p>{long}</p></article></section>"
    )
    assert mincut.main_text(page, mincut.UNTRAINED).split("\n") == ["The title", "Second head", long, long, long]


@pytest.mark.parametrize("page", ["<div>text " * 100_000, "<article>text " * 50_000, "<div>a " * 20_000 + "</span></section>" * 100_000, "<ul><li>x" * 30_000])
def test_very_deep_pages_take_linear_time(page):
    started = time.process_time()
    assert mincut.main_text(page, mincut.UNTRAINED) is not None
    assert time.process_time() - started < 30


def test_a_repeated_labelled_document_counts_once(spark, insults):
    docs, labels = insults
    first = labels.where("toxic = 1").orderBy("doc_id").limit(1)
    copies = docs.join(first.select("doc_id"), "doc_id").withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(5000)))).drop("i")
    many = docs.unionByName(copies.select(*docs.columns))
    sample = toxicity._sample(many, labels)
    assert sample.count() == labels.where("toxic IN (0, 1)").select("doc_id").distinct().join(docs, "doc_id").select("doc_id").distinct().count()
    assert json.loads(toxicity.learn(many, labels)) == json.loads(toxicity.learn(docs, labels))


def plain_score(text, model):
    """The score of a model without the automaton: every entry searched by itself, hits inside exceptions left out."""
    model, folded = json.loads(model), toxicity.fold(text)
    starts = lambda term: [m.start() for m in re.finditer(f"(?={re.escape(term)})", folded)]
    excused = [(at, at + len(p)) for p in model["exceptions"] for at in starts(p)]
    best = {}
    for term, weight in model["entries"].items():
        for at in [] if term in model["exceptions"] else starts(term):
            if not any(a <= at < z for a, z in excused):
                best[at] = max(best.get(at, 0.0), weight)
    total = sum(best.values())
    c, a, b = model["curve"]
    margin = c + a * np.log1p(total) + b * np.log1p(100 * total / max(1, folded.count(" ") - 1))
    return float(1 / (1 + np.exp(-np.clip(margin, -30, 30))))


def test_scores_against_a_plain_search(spark, sf_dir, docs):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.learn(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    rows = docs.select("text", toxicity.score(F.col("text"), model).alias("score")).collect()
    apart = [abs(r["score"] - plain_score(r["text"], model)) for r in rows]
    assert sum(x > 1e-9 for x in apart) == 0


def test_weak_labels_without_doc_ids(spark, sf_dir, docs):
    weights = weaklabels.learn(docs)
    none = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert weaklabels.learn(none.repartition(5)) == weights and weaklabels.learn(docs.withColumn("doc_id", F.lit(1))) == weights
    repeated = docs.unionByName(docs.orderBy("doc_id").limit(1).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(20_000)))).drop("n"))
    assert len({round(r[0], 6) for r in docs.select(weaklabels.score(F.col("text"), weaklabels.learn(repeated))).collect()}) > 50


def test_posteriors_and_scores_in_plain_numbers(spark, docs):
    """Bayes' rule on the accuracies that were found, and the linear score written out."""
    patterns = dict(docs.select(weaklabels.votes(F.col("text")).alias("v")).groupBy("v").count().collect())
    posterior, accuracy = weaklabels.estimate(patterns)
    for pattern, found in posterior.items():
        good = bad = 1.0
        for vote, right in zip(pattern, accuracy):
            good *= right if vote == "+" else 1 - right if vote == "-" else 1
            bad *= 1 - right if vote == "+" else right if vote == "-" else 1
        assert abs(found - good / (good + bad)) < 1e-3
    weights = json.loads(weaklabels.learn(docs))
    for row in docs.select("text", weaklabels.score(F.col("text"), json.dumps(weights)).alias("s")).limit(100).collect():
        margin = weights[-1]
        for bucket, share in weaklabels._features(row["text"]).items():
            margin += weights[bucket] * share
        assert abs(row["s"] - 1 / (1 + np.exp(-max(-30, min(30, margin))))) < 1e-9
