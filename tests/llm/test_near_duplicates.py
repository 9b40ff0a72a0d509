"""Near-duplicates against all pairs."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from rowmill.llm import neardup
from tests.llm.conftest import SCHEMA, WORD, ascii_lower


def brute(rows, width, threshold=80):
    """(doc_id, size, component) per row, by an inverted index over all shingles."""
    sets, holders, parent = [], defaultdict(list), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, (_, text) in enumerate(rows):
        words = WORD.findall(ascii_lower(text or ""))
        sets.append({tuple(words[j : j + width]) for j in range(max(1, len(words) - width + 1))} if words else set())
        shared = Counter(j for s in sets[i] for j in holders[s])
        for j, common in shared.items():
            if 100 * common >= threshold * (len(sets[i]) + len(sets[j]) - common):
                parent[root(i)] = root(j)
        for s in sets[i]:
            holders[s].append(i)
    least = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        least[root(i)].append(key)
    smallest = {r: min((k for k in keys if k is not None), default=None) for r, keys in least.items()}
    return sorted(((k, len(s), smallest[root(i)]) for i, ((k, _), s) in enumerate(zip(rows, sets))), key=str)


def found(df, width):
    rows = neardup.near_duplicates(df, width=width).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows), key=str)


@pytest.mark.parametrize("width", [4, 5])
def test_documents(docs, width):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert found(docs, width) == brute(rows, width)


def test_odd_rows(odd, odd_rows, none):
    assert found(odd, 4) == brute([r[:2] for r in odd_rows], 4)
    assert found(none, 4) == []


def test_a_large_group_of_near_copies(spark, monkeypatch):
    """Blocks are small here, so that the group needs many of them."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(260):
        words = list(base)
        for _ in range(rng.randrange(9)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    for i in range(260, 330):  # a shared passage, no links
        rows.append((i, " ".join(base[:60] + [f"o{rng.randrange(10**6)}" for _ in range(120)])))
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA).repartition(4)
    assert found(df, 4) == brute(rows, 4)


def test_short_texts_and_close_calls(spark):
    rng, rows = random.Random(8), []
    for size in range(4, 60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(size + 3)]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[: max(4, int(0.8 * size) + 3)])), (len(rows) + 2, " ".join(words[:-1]).upper())]
    assert found(spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA), 4) == brute(rows, 4)


def test_estimates_are_near():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.8, 0.95):
        pool = np.unique(rng.integers(0, 2**64, 3000, dtype=np.uint64))
        rng.shuffle(pool)
        common, rest = pool[: int(1000 * share)], pool[1000:]
        own = (1000 - len(common)) // 2
        a, b = np.sort(np.append(common, rest[:own])), np.sort(np.append(common, rest[own : 2 * own]))
        same = (neardup.registers(a) == neardup.registers(b)).sum()
        guess = neardup.estimated_similarity(np.array([same]), len(a), np.array([len(b)]))[0]
        assert abs(guess - len(common) / len(pool[: len(common) + 2 * own])) < 0.15


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        ra, rb = sorted((root(a), root(b)))
        parent[rb] = ra
    out = {r["c"]: r["comp"] for r in neardup.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert out == {x: root(x) for x in linked}
