"""Near-duplicate documents with HyperMinHash sketches, banding, and confirmation on whole shingle sets.

A text's shingles are hashed to 64 bits and dealt into buckets; each bucket keeps
the leading-zero count of its smallest value and the bits behind it, packed into a
16-bit register. Empty buckets borrow another bucket's register. Texts with the same
set are one class from the start. Classes whose registers agree in a whole band are
candidates; they are compared in blocks of bounded size, where the estimate of their
similarity, corrected for registers that agree by chance, decides which pairs are
confirmed on their whole sets. A block returns links that join what was apart, never
all pairs of a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.plans.lineage import written

#: Registers of a sketch and per band. A pair of similarity 0.8 shares no band with a chance of (1 - 0.8 ** 4) ** 40 < 1e-9.
REGISTERS, PER_BAND = 160, 4
BANDS = REGISTERS // PER_BAND
MANTISSA = 10
#: Bands of the first round, which joins most of what belongs together, so that the second compares little.
FIRST_BANDS = 4
#: Texts compared in one block at most, fewer if their sets are large; and hubs that every block of a large group gets too.
BLOCK, HUBS, BLOCK_SHINGLES = 512, 32, 8_000_000
#: Estimates this many standard deviations below the threshold are not confirmed.
MARGIN = 5.0
KEPT_WORDS = 150_000
#: Classes of more than one in so many rows are joined by broadcast: fewer than this many.
FREQUENT = 4_096


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < KEPT_WORDS:
            self[word] = value
        return value


_HASHES = _WordHashes()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a UTF-8 text, A-Z taken as a-z; with fewer words, of all of them."""
    found = (text or b"").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    words = np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))
    n = min(width, len(words))
    h = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        h = _mixed(h + words[i : len(words) - n + 1 + i])
    return np.unique(h)


@lru_cache(maxsize=1)
def _lenders() -> np.ndarray:
    """For each register, the order in which it asks the others when it is empty."""
    rng = np.random.Generator(np.random.PCG64(20240501))
    return np.stack([rng.permutation(REGISTERS) for _ in range(REGISTERS)])


def registers(shingles: np.ndarray) -> np.ndarray:
    """The HyperMinHash registers of a set that isn't empty."""
    bucket = ((shingles >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)
    starts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1))
    least = np.minimum.reduceat(_mixed(shingles + np.uint64(0x9E3779B97F4A7C15)), starts)
    zeros = np.minimum(64 - np.frexp(least.astype(np.float64))[1], 63).astype(np.uint64)
    mantissa = ((least << zeros) >> np.uint64(63 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)
    out, filled = np.zeros(REGISTERS, np.uint16), np.zeros(REGISTERS, bool)
    at = bucket[starts].astype(np.int64)
    out[at], filled[at] = (zeros << np.uint64(MANTISSA)) | mantissa, True
    empty = np.flatnonzero(~filled)
    if len(empty):
        order = _lenders()[empty]
        out[empty] = out[order[np.arange(len(empty)), filled[order].argmax(axis=1)]]
    return out


def estimated_similarity(same: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates from the number of equal registers, less the number expected to agree by chance for sets of n and m."""
    ratio = np.maximum(n, m) / np.maximum(1, np.minimum(n, m))
    by_chance = 0.169919487159739 * REGISTERS * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2
    return np.maximum(0.0, same - by_chance) / (REGISTERS - by_chance)


def sketch(docs: DataFrame, width: int, carry: list[str], with_set: bool = False) -> DataFrame:
    """Per row: doc_id, the carried columns, n_shingles, a 128-bit digest of the set (null if empty), and registers or the set."""
    names = ["doc_id", *carry]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                counts, digests, sketches, sets = [], [], [], []
                for text in part.column("text"):
                    found = shingle_set(text.as_py(), width)
                    counts.append(len(found))
                    digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                    sketches.append(registers(found).tobytes() if len(found) else None)
                    if with_set:
                        sets.append(found.tobytes())
                columns = [part.column(n) for n in names] + [pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary())]
                out = [*names, "n_shingles", "digest", "registers"]
                if with_set:
                    columns, out = [*columns, pa.array(sets, pa.binary())], [*out, "shingles"]
                yield pa.RecordBatch.from_arrays(columns, out)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carry, F.col("text").cast("binary").alias("text"))
    schema = source.drop("text").schema.add("n_shingles", "long").add("digest", "binary").add("registers", "binary")
    return source.mapInArrow(rows, schema.add("shingles", "binary") if with_set else schema)


def _maybe_in(df: DataFrame, key: Column, bits: int = 1 << 20):
    """A filter that holds for every key in `df` and few others, from a bitmap of a fixed size on the driver."""
    place = lambda k: F.pmod(F.xxhash64(k), F.lit(bits))
    word = lambda k: F.floor(place(k) / 64).cast("int")
    bit = lambda k: (place(k) % 64).cast("int")
    found = dict(df.groupBy(word(key).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(key))).alias("b")).collect())
    bitmap = F.split(F.lit(",".join(str(found.get(i, 0)) for i in range(bits // 64))), ",").cast("array<bigint>")
    return lambda k: F.call_function("shiftrightunsigned", F.get(bitmap, word(k)), bit(k)).bitwiseAND(F.lit(1).cast("long")) == 1


def components(links: DataFrame) -> DataFrame:
    """The smallest node `comp` reachable from each node `c` of links (a, b), by alternating large and small stars.

    Nothing but counts reaches the driver, and no node's neighbours are collected.
    """
    state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = written(small.distinct(), "edges")
        after = state(edges)
        if after == before:
            break
        before = after
    own = edges.select("v").distinct().select(F.col("v").alias("c"), F.col("v").alias("comp"))
    return edges.select(F.col("u").alias("c"), F.col("v").alias("comp")).unionByName(own)


def _linker(threshold: float):
    """The function that compares the texts of one block."""

    def linked(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        first = list({c: i for i, c in enumerate(rows["c"])}.values())
        n_of = np.array([rows["n"][i] for i in first], np.int64)
        order = [first[i] for i in np.argsort(n_of, kind="stable")]
        ids, comps = [rows["c"][i] for i in order], [rows["comp"][i] for i in order]
        major = np.array([rows["major"][i] for i in order], bool)
        regs = np.frombuffer(b"".join(rows["registers"][i] for i in order), np.uint16).reshape(len(order), -1)
        sets = [np.frombuffer(rows["shingles"][i], np.uint64) for i in order]
        n = np.array([len(s) for s in sets], np.int64)
        parent = list(range(len(ids)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            return i

        seen: dict = {}
        for i, comp in enumerate(comps):
            parent[root(i)] = root(seen.setdefault(comp, i))
        pairs = []
        for i in range(len(ids) - 1):
            upto = np.searchsorted(n, n[i] / threshold + 1e-9, "right")
            if upto <= i + 1:
                continue
            j = np.arange(i + 1, upto)
            guess = estimated_similarity((regs[i + 1 : upto] == regs[i]).sum(axis=1), n[i], n[j])
            # small sets lend few different registers
            spread = np.sqrt(threshold * (1 - threshold) / np.minimum(REGISTERS, n[j]))
            near = np.flatnonzero((guess >= threshold - MARGIN * spread) & ~(major[i] & major[j]))
            pairs += [(-g, i, k) for g, k in zip(guess[near].tolist(), j[near].tolist())]
        links = []
        for _, i, j in sorted(pairs):
            a, b = root(i), root(j)
            if a == b:
                continue
            common = int((sets[j][np.minimum(np.searchsorted(sets[j], sets[i]), n[j] - 1)] == sets[i]).sum())
            if 100 * common >= round(100 * threshold) * (n[i] + n[j] - common):
                parent[a] = b
                links.append((ids[i], ids[j]))
        columns = list(zip(*links)) if links else [(), ()]
        return pa.table([pa.array(c, pa.binary()) for c in columns], ["a", "b"])

    return linked


def _blocks(members: DataFrame) -> DataFrame:
    """Members with the block they are compared in. A large group has several, and hubs of it are in each of them."""
    size = F.least(F.lit(BLOCK), F.greatest(F.lit(8), F.floor(F.lit(BLOCK_SHINGLES) / F.col("max_n"))))
    count = F.ceil(F.col("s") / size).cast("int")
    rows = members.withColumns({"blocks": count, "h": F.pmod(F.xxhash64("c"), F.lit(1 << 30))})
    hub = F.col("h") % F.ceil(F.col("s") / HUBS) == 0
    places = F.when((F.col("blocks") > 1) & hub, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array((F.floor(F.col("h") / 1024) % F.col("blocks")).cast("int")))
    return rows.withColumn("block", F.explode(F.transform(places, lambda i: i.cast("string")))).drop("blocks", "h")


def _block_pairs(members: DataFrame) -> DataFrame:
    """Members in all blocks in which they meet every other member, but for pairs that are both of the largest component."""
    size = F.least(F.lit(BLOCK), F.greatest(F.lit(8), F.floor(F.lit(BLOCK_SHINGLES) / F.col("max_n")))) / 2
    count = lambda n: F.ceil(F.col(n) / size).cast("int")
    rows = members.withColumns({"of_major": count("n_major"), "of_rest": count("n_rest"), "h": F.floor(F.pmod(F.xxhash64("c"), F.lit(1 << 30)) / 1024)})
    mine = (F.col("h") % F.when(F.col("major"), F.col("of_major")).otherwise(F.col("of_rest"))).cast("int")
    others = F.sequence(F.lit(0), F.col("of_rest") - 1)
    named = lambda i, sign, j: F.concat(i.cast("string"), F.lit(sign), j.cast("string"))
    pair = lambda i, j: named(F.least(i, j), "-", F.greatest(i, j))
    with_rest = F.transform(others, lambda j: F.when(F.col("major"), named(F.col("mine"), "+", j)).otherwise(pair(F.col("mine"), j)))
    of_major = F.sequence(F.lit(0), F.col("of_major") - 1)
    with_major = F.when(~F.col("major"), F.transform(of_major, lambda i: named(i, "+", F.col("mine")))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("mine", mine)
    return rows.withColumn("block", F.explode(F.concat(with_rest, with_major))).drop("of_major", "of_rest", "h", "mine")


def _to_rows(rows: DataFrame, of_class: DataFrame, n_rows: int) -> DataFrame:
    """Rows with what their class has. Frequent classes, fewer than FREQUENT of them, go to all tasks; rows without a class meet nobody."""
    rest = [c for c in of_class.columns if c not in ("digest", "members")]
    frequent = of_class.where(F.col("members") * FREQUENT > n_rows)
    few = of_class.where(F.col("members") * FREQUENT <= n_rows).drop("members")
    marked = rows.join(F.broadcast(frequent.select("digest", F.lit(True).alias("in_frequent"), *[F.col(c).alias(f"many_{c}") for c in rest])), "digest", "left")
    met, alone = marked.where("digest IS NOT NULL AND in_frequent IS NULL"), marked.where("digest IS NULL OR in_frequent")
    found = met.join(few, "digest", "left").unionByName(alone, allowMissingColumns=True)
    return found.select(*rows.columns, *[F.coalesce(F.col(c), F.col(f"many_{c}")).alias(c) for c in rest])


def near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8, carry: list[str] | None = None, component: str | None = None) -> DataFrame:
    """doc_id, the carried columns, n_shingles, component_id and kept for every row of `docs`.

    Texts are linked if intersection / union of their shingle sets is at least
    `threshold`, confirmed on the whole sets; component_id is the smallest doc_id
    that links reach, and kept says that it is the row's own. Texts without words,
    and null texts, have no shingles and are linked with nothing. Equal rows, and
    rows that share a doc_id, are rows of their own. A null doc_id is greater than any
    other. An empty table stays empty. Columns other than doc_id, text and those in
    `carry` are not read. `component` names a further column that tells components
    apart whatever their rows' doc_ids are: equal within one, null without words.
    """
    carry = carry or []
    rows = written(sketch(docs, width, carry), "sketches")
    classes = written(
        rows.where("digest IS NOT NULL").groupBy(F.col("digest").alias("c")).agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers"), F.count(F.lit(1)).alias("members")), "classes"
    )
    cuts = F.array(*[F.xxhash64(F.lit(b), F.substring("registers", 2 * PER_BAND * b + 1, 2 * PER_BAND)) for b in range(BANDS)])
    bands = classes.select("c", "rep", "n", F.posexplode(cuts).alias("band", "k"))
    who = [F.bit_xor(F.xxhash64("c")).alias("who"), F.bit_xor(F.xxhash64("c", F.lit(1))).alias("who_else")]
    groups = bands.groupBy("k").agg(F.count(F.lit(1)).alias("s"), F.max("n").alias("max_n"), F.min("band").alias("first_band"), *who).where("s > 1")
    # bands in which the same texts meet are compared once
    shared = written(groups.groupBy("s", "max_n", "who", "who_else").agg(F.min_by("k", F.struct("first_band", "k")).alias("k")).select("k", "s", "max_n"), "bands")
    members = written(bands.where(_maybe_in(shared, F.col("k"))(F.col("k"))).join(shared, "k"), "members")

    candidates = written(members.select("c", "rep").distinct(), "candidates")
    again = docs.where(F.coalesce(_maybe_in(candidates, F.col("rep"))(F.col("doc_id").cast("long")), F.lit(False)) | F.col("doc_id").isNull())
    found = sketch(again, width, [], with_set=True).where("digest IS NOT NULL").join(candidates.select(F.col("c").alias("digest")), "digest", "left_semi")
    sets = written(found.groupBy(F.col("digest").alias("c")).agg(F.first("registers").alias("registers"), F.first("shingles").alias("shingles")), "sets")

    def links(blocks: DataFrame) -> DataFrame:
        full = blocks.select("k", "block", "c", "comp", "n", "major").join(sets, "c")
        return written(full.groupBy("k", "block").applyInArrow(_linker(threshold), "a binary, b binary"), "links")

    first = links(_blocks(members.where(F.col("band") < FIRST_BANDS).withColumns({"comp": F.col("c"), "major": F.lit(False)})))
    labels = written(components(first), "labels")
    labelled = members.join(labels, "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    per_comp = labelled.groupBy("k", "comp").agg(F.count(F.lit(1)).alias("in_comp"))
    apart = written(
        per_comp.groupBy("k").agg(F.max_by("comp", F.struct("in_comp", "comp")).alias("largest"), F.max("in_comp").alias("n_major"), F.sum("in_comp").alias("all"), F.count(F.lit(1)).alias("comps"))
        .where("comps > 1").select("k", "largest", "n_major", (F.col("all") - F.col("n_major")).alias("n_rest")), "apart"
    )
    rest = labelled.where(_maybe_in(apart, F.col("k"))(F.col("k"))).join(apart, "k").withColumn("major", F.col("comp") == F.col("largest"))
    second = links(_block_pairs(rest))
    labels = written(components(first.unionByName(second)), "labels")

    classed = classes.select("c", "rep", "members").join(labels, "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    roots = classed.groupBy("comp").agg(F.min("rep").alias("component_id"))
    of_class = classed.join(roots, "comp").select(F.col("c").alias("digest"), "members", "component_id", F.col("comp").alias("component"))
    joined = _to_rows(rows.drop("registers"), written(of_class, "of_class"), rows.count())
    smallest = F.coalesce("component_id", "doc_id")
    more = [F.col("component").alias(component)] if component else []
    return joined.select("doc_id", *carry, "n_shingles", smallest.alias("component_id"), F.col("doc_id").eqNullSafe(smallest).alias("kept"), *more)
