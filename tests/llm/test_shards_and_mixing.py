"""Shards and mixes against Python."""

import hashlib
import struct
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from rowmill.llm import mixing, shards
from rowmill.llm.words import word_count
from tests.llm.conftest import SCHEMA, WORD


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000, 4097])
def test_places_are_a_permutation(spark, n):
    places = [r[0] for r in spark.range(n).select(shards.permuted(F.col("id"), n, seed=3)).collect()]
    assert sorted(places) == list(range(n))
    assert n < 97 or places != list(range(n))


def feistel(number, n, seed, rounds=6):
    """The same network in Python."""
    a, b = shards.radices(n)
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def mix(value, key):
        h = 42
        for data in (struct.pack("<q", value), struct.pack("<q", key), struct.pack("<i", seed)):
            h = xxhash.xxh64_intdigest(data, seed=h)
        return signed(h)

    place = number
    while True:
        left, right = place % a, place // a
        for key in range(rounds):
            if key % 2 == 0:
                left = (left + mix(right, key) % a) % a
            else:
                right = (right + mix(left, key) % b) % b
        place = left + right * a
        if place < n:
            return place


def test_places_can_be_computed_elsewhere(spark):
    places = [r[0] for r in spark.range(50).select(shards.permuted(F.col("id"), 50, seed=9)).collect()]
    assert places == [feistel(i, 50, 9) for i in range(50)]


def shuffled(df, seed=1):
    return shards.shuffle_into_shards(df.select("doc_id", "text", "shard", "slot", "bucket") if "shard" in df.columns else df.select("doc_id", "text"), ["doc_id"], 4, seed)


def test_shards_of_odd_rows(odd, none):
    rows = shuffled(odd).collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter(tuple(r) for r in odd.select("doc_id", "text").collect())
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = shuffled(odd.repartition(7, "text")).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert sorted(map(str, rows)) != sorted(map(str, shuffled(odd, seed=2).collect()))
    assert shuffled(none).count() == 0


def test_a_row_repeated_many_times(spark):
    df = spark.range(3000).select((F.col("id") % 3 * F.col("id")).alias("doc_id"), F.lit("t").alias("text"))
    rows = shards.shuffle_into_shards(df, ["doc_id"], 7).collect()
    assert sorted((r["slot"] * 7 + r["shard"]) for r in rows) == list(range(3000))


def brute_mix(rows):
    """(doc_id, source, size, source_size, target, taken), sorted."""
    sized = [(i, s, len(WORD.findall(t or ""))) for i, t, _, s, _ in rows]
    total = Counter()
    for _, s, n in sized:
        total[s] += n
    names = sorted(total, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    while open_:
        left = sum(total.values()) - sum(target.values())
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 3 * total[s]}
        for s in full or open_:
            target[s] = 3.0 * total[s] if full else level * weight[s]
        open_ -= full or open_
    out = []
    for s in names:
        times = min(3, int(target[s] // total[s])) if total[s] else 0
        rest = max(0.0, target[s] - times * total[s]) if times < 3 else 0.0
        before = 0
        for _, i, n in sorted((hashlib.md5(f"mix|{'' if i is None else i}".encode()).hexdigest()[:15], i, n) for i, x, n in sized if x == s):
            out.append((i, s, n, total[s], round(target[s], 6), n * (times + (2 * (rest - before) > n))))
            before += n
    return sorted(out, key=str)


def mixed(df):
    return sorted(((r["doc_id"], r["source"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in mixing.mix(df, word_count(F.col("text"))).collect()), key=str)


def test_mix_of_documents(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert mixed(docs) == brute_mix(rows)
    assert mixed(docs.repartition(5, "lang")) == mixed(docs)


def test_mix_of_odd_rows(spark, odd, odd_rows, none):
    unique = [r for r in odd_rows if r[0] not in (9, None)]
    assert mixed(spark.createDataFrame(unique, SCHEMA)) == brute_mix(unique)
    found = mixed(odd)
    assert len(found) == len(odd_rows) and all(r[5] <= 3 * r[2] for r in found)
    assert mixed(none) == []


def test_mix_of_one_document_repeated(spark):
    """Rows that no hash tells apart are still taken to half a document of the target."""
    rows = [(7, "a b c d", "en", "a", 7)] * 400 + [(i, "x y", "en", "b", 3) for i in range(300)]
    found = mixed(spark.createDataFrame(rows, SCHEMA))
    taken = sum(r[5] for r in found if r[1] == "a")
    assert abs(taken - [r[4] for r in found if r[1] == "a"][0]) <= 2


def test_targets_stop_at_three_times_the_source(spark):
    rows = [(i, "a " * 1000, "en", "a", 1) for i in range(8)] + [(50 + i, "b", "en", s, 1) for i, s in enumerate("bcd")] + [(90, "c c", "en", None, 1)]
    found = mixed(spark.createDataFrame(rows, SCHEMA))
    assert found == brute_mix(rows)
    assert {r[1]: r[5] for r in found if r[1] != "a"} == {"b": 3, "c": 3, "d": 3, None: 6}
