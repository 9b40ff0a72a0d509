"""WARC archives (round trip and damage), spelling variants and ranked search (against brute force)."""

import base64
import gzip
import hashlib
import io
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowmill.llm import lexical, queries, spelling, warc
from tests.llm.conftest import LONG, ascii_lower

# ------------------------------------------------------------------ WARC

PAGES = "page_id bigint, url string, html string"
PAGE_ROWS = [
    (5, "http://a/5", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (9, "http://a/9", "<p>other é</p>"), (1, None, None), (3, "http://a/3", ""),
    (7, "http://a b/\r\nX: y", LONG), (7, "http://a b/\r\nX: y", LONG), (None, "", "<p>no id</p>"), (None, "u", "<p>no id</p>"), (4, "  ", "WARC/1.1\r\n\r\n\r\n\r\n"),
]


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.fixture(scope="module")
def pages(spark):
    names = "key place id size digest payload large first met record_id type n head archive".split()
    return spark.createDataFrame(PAGE_ROWS, PAGES).withColumns({n: F.lit(f"extra {n}") for n in names}).repartition(3)


def expected_records(rows, minimum):
    out = []
    for key, _, html in rows:
        out.append((key, len((html or "").encode()), sha(html)))
    firsts = {}
    for key, size, digest in sorted(out, key=lambda r: (r[0] is None, r[0] or 0)):
        firsts.setdefault(digest, key)
    seen, found = set(), []
    for key, size, digest in sorted(out, key=lambda r: (r[0] is None, r[0] or 0)):
        revisit = size >= minimum and digest in seen
        seen.add(digest)
        found.append((key, size, digest, "revisit" if revisit else "response", firsts[digest] if revisit else None))
    return sorted(found, key=str)


@pytest.mark.parametrize("minimum, octets, frequent", [(0, 1 << 24, 4096), (12, 300, 4096), (0, 1, 2)])
def test_pages_come_back(spark, pages, tmp_path, monkeypatch, minimum, octets, frequent):
    monkeypatch.setattr(warc, "FREQUENT", frequent)
    path = str(tmp_path / "w")
    warc.write_warc(pages, path, minimum_revisit=minimum, archive_octets=octets)
    records = warc.read_warc(spark, path, with_payload=True).collect()
    rows = spark.createDataFrame(records, warc.RECORDS).select(warc.key_of(F.col("record_id")).alias("k"), "payload_bytes", "payload_digest", "type", warc.key_of(F.col("refers_to")).alias("r"))
    assert sorted((tuple(r) for r in rows.collect()), key=str) == expected_records(PAGE_ROWS, minimum)
    assert len({r["record_id"] for r in records}) == len(PAGE_ROWS)
    texts = {r["record_id"]: bytes(r["payload"]).decode() for r in records if r["type"] == "response"}
    for r in records:
        assert sha(texts[r["refers_to"] or r["record_id"]]) == r["payload_digest"] and (r["payload"] is None) == (r["type"] == "revisit")
    assert {r["target_uri"] for r in records} >= {"http://a/5", "http://a%20b/%0D%0AX:%20y"}


def test_each_record_is_a_member_that_other_tools_read(pages, tmp_path):
    path = tmp_path / "w"
    warc.write_warc(pages, str(path))
    kinds = Counter()
    for file in path.glob("part-*"):
        data = file.read_bytes()
        whole = gzip.GzipFile(fileobj=io.BytesIO(data)).read()
        starts = [m.start() for m in re.finditer(rb"\x1f\x8b\x08", data)]
        at = 0
        while at < len(whole):
            head, _, _ = whole[at:].partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            kinds[fields["WARC-Type"]] += 1
            end = at + len(head) + 4 + int(fields["Content-Length"])
            assert whole[end : end + 4] == b"\r\n\r\n"
            at = end + 4
        assert len(starts) >= sum(1 for _ in warc.read_archive(data)) + 2
    assert kinds["response"] + kinds["revisit"] == len(PAGE_ROWS) and kinds["warcinfo"] == kinds["metadata"]


def test_damage_is_found_and_reading_goes_on(spark, tmp_path):
    rows = [(i, f"http://a/{i}", "".join(random.Random(i).choices("abcdef \n", k=3000))) for i in range(20)]
    path = tmp_path / "w"
    warc.write_warc(spark.createDataFrame(rows, PAGES).coalesce(1), str(path))
    (file,) = path.glob("part-*")
    data = file.read_bytes()
    places = [at for at, _, _ in warc.read_archive(data)]
    hurt = bytearray(data)
    hurt[places[4] + 200] ^= 0xFF
    found = list(warc.read_archive(bytes(hurt)))
    assert sum(r is not None for _, r, _ in found) == 19 and sum(f is not None for _, _, f in found) >= 2
    cut = list(warc.read_archive(data[: places[10] + 50]))
    assert sum(r is not None for _, r, _ in cut) == 10 and [f for _, _, f in cut if f] != []
    no_end = list(warc.read_archive(data[: places[10]]))
    assert [f for _, _, f in no_end if f] == ["the archive does not hold the records it was closed with"]
    assert all(f is None for _, _, f in warc.read_archive(data[: places[10]], closed=False))
    wrong = warc.member("response", "urn:x", "application/http; msgtype=response", b"HTTP/1.1 200 OK\r\n\r\nabc", WARC_Payload_Digest="sha1:" + sha("abd"))
    assert [f for _, _, f in warc.read_archive(wrong, closed=False)] == ["the payload doesn't have its digest"]
    other = tmp_path / "hurt"
    other.mkdir()
    (other / "a.warc.gz").write_bytes(bytes(hurt))
    marked = warc.read_warc(spark, str(other), on_fault="mark")
    assert marked.where("fault is null").count() == 19
    with pytest.raises(Exception, match="Damaged"):
        warc.read_warc(spark, str(other)).count()


def test_large_payloads_are_read_piece_by_piece(spark, tmp_path):
    text = "0123456789abcdef" * 1_250_000  # 20 MB: the high octet of the record's length is not zero
    df = spark.createDataFrame([(1, "u", text), (2, "u", text)], PAGES).coalesce(1)
    warc.write_warc(df, str(tmp_path / "w"))
    found = {r["type"]: r for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    assert found["response"]["payload_bytes"] == found["revisit"]["payload_bytes"] == 20_000_000
    assert found["response"]["payload_digest"] == found["revisit"]["payload_digest"] == sha(text)


def test_no_pages(spark, tmp_path):
    warc.write_warc(spark.createDataFrame([], PAGES), str(tmp_path / "w"))
    assert warc.read_warc(spark, str(tmp_path / "w")).count() == 0


# -------------------------------------------------------------- spelling


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_variants(counts, ratio=2):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda v: (-counts[v], v))
            if counts[best] >= ratio * counts[w]:
                form[w] = best
    out = set()
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out.add((w, counts[w], len(near[w]), form.get(w), counts[form[w]] if w in form else None, root))
    return out


@pytest.mark.parametrize("alphabets, sharing", [((8, 32, 159), 500), ((2, 3, 159), 1), ((1, 2), 2)])
def test_variants_against_brute_force(spark, alphabets, sharing):
    rng = random.Random(alphabets[0])
    words = {"".join(rng.choices("abcé", k=rng.randint(1, 6))) for _ in range(150)} | {"a", "ab", "ba", "ÿ", "straße", "strasse", "日本", "日本語", "😀😀", "😀", ""}
    long = "x" * 64
    words |= {long, long + "x", long + "xy", long + "xyz", "y" + long + "xyz", "ab" * 5000, "ab" * 5000 + "a", "b" + "ab" * 5000, "ab" * 4999 + "ac", "ab" * 4999 + "ad"}
    counts = {w: rng.choice([3, 3, 4, 7, 8, 16, 33, 100]) for w in words}
    df = spark.createDataFrame([*counts.items(), (None, 5)], "word string, n bigint").withColumns({n: F.lit("x") for n in ("key", "form", "root", "other", "id", "same")})
    found = spelling.spelling_variants(df, alphabets=alphabets, most_sharing=sharing).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert len(found) == len(counts)
    short = {tuple(r) for r in found}
    assert short == brute_variants(counts)


def test_pairs_come_once(spark):
    rng = random.Random(1)
    words = sorted({"".join(rng.choices("ab", k=rng.randint(5, 8))) for _ in range(300)})
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n bigint")
    expected = {frozenset((a, b)) for a in words for b in words if one_edit(a, b)}
    for options in ({}, {"alphabets": (1, 2, 159), "most_sharing": 3}):
        pairs = [frozenset((r["word"], r["other"])) for r in spelling.near_pairs(df, **options).collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == expected


def test_word_counts(spark, odd, odd_rows, none, monkeypatch):
    monkeypatch.setattr(spelling, "COUNTED_WORDS", 3)
    expected = Counter(w for r in odd_rows for w in re.findall(r"[a-zÀ-ÿ]+", ascii_lower(r[1] or "")))
    assert {r["word"]: r["n"] for r in spelling.count_words(odd).collect()} == expected
    assert {r["word"] for r in spelling.count_words(odd, minimum_length=4).collect()} == {w for w in expected if len(w) >= 4}
    assert spelling.count_words(none).count() == 0 and spelling.spelling_variants(spelling.count_words(none)).count() == 0

    def brute(key, text):
        import zlib

        for w in re.findall(r"[a-zÀ-ÿ]+", ascii_lower(text or "")):
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            at = h % len(w)
            yield w[:at] + w[at + 1 :] if h % 97 == 0 else w

    many = [(i, " ".join(f"wörd{chr(97 + i % 26)}{chr(97 + j)} the" for j in range(20))) for i in range(60)] + [(None, "some words ünd mehr " * 3)]
    changed = Counter(w for key, text in many for w in brute(key, text))
    df = spark.createDataFrame(many, "doc_id bigint, text string")
    found = {r["word"]: r["n"] for r in spelling.count_words(df, changes=queries.typing_errors).collect()}
    assert found == {w: n for w, n in changed.items() if w} and sum(changed.values()) > sum(n for w, n in changed.items() if w in ("the",))


# ---------------------------------------------------------------- search


def brute_search(docs, items, k=10):
    terms = lambda text: re.findall(lexical.TERM, ascii_lower(text or ""))
    parsed = [(doc_id, Counter(terms(text))) for doc_id, text in docs]
    parsed = [(d, c, sum(c.values())) for d, c in parsed if c]
    n_docs, n_terms = len(parsed), sum(n for _, _, n in parsed)
    df = Counter(t for _, c, _ in parsed for t in c)
    out = []
    for item, text in items:
        asked, scored = Counter(terms(text)), []
        for doc_id, counts, n in parsed:
            m = 25 + (75 * n * n_docs) // n_terms
            score = sum(
                times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * counts[t]) // (1000 * counts[t] + 8 * m))
                for t, times in asked.items() if t in counts
            )
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        out += [(item, i + 1, None if null else d, -s) for i, (s, null, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("octets, step, block", [(8_000_000, 256, 128), (2000, 4, 4), (1, 1, 128)])
def test_search_against_brute_force(spark, tmp_path, monkeypatch, odd, odd_rows, octets, step, block):
    for name, value in (("SEGMENT_OCTETS", octets), ("FIRST_STEP", step), ("BLOCK", block), ("QUERY_OCTETS", max(200, octets))):
        monkeypatch.setattr(lexical, name, value)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["é1", "日本", "Ok", "x"]
    docs = [(i % 90 if i % 17 else None, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(len(words))], k=rng.randint(0, 40)))) for i in range(200)]
    docs += [(r[0], r[1]) for r in odd_rows]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 9)))) for i in range(25)] + [(7, None), (8, ""), (9, "absent"), (None, "w1 w1 w2!"), (3, "OK ok x"), (3, "OK ok x")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({n: F.lit("extra") for n in ("segment", "term", "ids", "n", "query", "score")})
    path = str(tmp_path / "index")
    lexical.build_index(df.repartition(3), path)
    found = lexical.search(spark, path, spark.createDataFrame(items, "item_id bigint, text string").withColumn("rank", F.lit("extra")))
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_search(docs, items)


def test_search_of_nothing(spark, tmp_path, none):
    items = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    lexical.build_index(none, str(tmp_path / "a"))
    assert lexical.search(spark, str(tmp_path / "a"), items).count() == 0
    lexical.build_index(none.sparkSession.createDataFrame([(1, " . ", None, None, None)], none.schema), str(tmp_path / "b"))
    assert lexical.search(spark, str(tmp_path / "b"), items).count() == 0
    assert lexical.search(spark, str(tmp_path / "b"), items.limit(0)).count() == 0


def test_blocks_are_rejected_before_they_are_unpacked():
    """A frequent term's blocks without a high impact stay packed once the rare term has filled the list."""
    segment = lexical._Segment(0, 20_000, 400_000)
    rng = np.random.default_rng(2)
    for i in range(20_000):
        rare = b" rare" * int(rng.integers(1, 9)) if i % 400 == 0 else b""
        segment.add(i, b"common filler" + b" pad" * int(rng.integers(0, 30)) + rare)
    blocks, ids, norms = segment.rows()
    lists = {}
    for row in blocks.to_pylist():
        lists.setdefault(row["term"], []).append(row)
    lists = {t: lexical._List(rows, np.array(norms)) for t, rows in lists.items()}
    counters = Counter()
    top = lexical.search_segment([(50, lists[b"common"]), (4000, lists[b"rare"])], ids, [], 10, 20_000, counters)
    scores = np.zeros(20_000, np.int64)
    for w, t in ((50, b"common"), (4000, b"rare")):
        for i in range(len(lists[t].rows)):
            docs, impacts = lexical._List(lists[t].rows, np.array(norms)).block(i)
            scores[docs] += w * impacts
    assert [(-s, d) for s, _, d in top] == sorted(((int(s), i) for i, s in enumerate(scores)), key=lambda p: (-p[0], p[1]))[:10]
    unpacked = sum(b is not None for b in lists[b"common"].unpacked)
    assert 0 < unpacked < len(lists[b"common"].unpacked) / 2 and counters["candidates"] >= counters["survivors"] > 0


@pytest.mark.parametrize("n", [1, 127, 128, 129, 1000])
def test_postings_come_back(n):
    rng = np.random.default_rng(n)
    segment = lexical._Segment(3, 10, 100)
    counts = [int(x) for x in rng.choice([1, 2, 300, 70_000], n, p=[0.6, 0.38, 0.01, 0.01])]
    for i, c in enumerate(counts):
        for _ in range(int(rng.integers(0, 3))):
            segment.add(None, b"")
        segment.add(i, b"t " * c)
    blocks, ids, norms = segment.rows()
    found = {}
    for row in blocks.to_pylist():
        docs, tf = lexical.unpack(row["payload"], row["n"], row["first"])
        assert docs[0] == row["first"] and docs[-1] == row["last"]
        assert row["best"] == lexical.impact(tf, np.array(norms)[docs]).max()
        found |= {ids[d]: int(x) for d, x in zip(docs, tf)}
    assert found == dict(enumerate(counts))
