"""Token files (round trip) and packing (against the tokenizer and lower bounds)."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowmill.llm import bitplanes, packing
from rowmill.llm.tokens import TextEncoder, slices, splits_at_white_space, word_tokenizer


def ids_of(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_tokenizer()).encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_the_library(odd_rows):
    texts = [r[1] for r in odd_rows] + ["a–b é–. –. क़ x", "it's don't, THE.", "X<|ENDOFTEXT|>. A.", "12,3 **a** a__b", "İI ŉ ǅ"]
    ids, counts = TextEncoder(word_tokenizer())([t and t.encode() for t in texts])
    expected = [ids_of(t) for t in texts]
    assert counts.tolist() == [len(e) for e in expected]
    assert ids.tolist() == [i for e in expected for i in e]


def test_a_tokenizer_that_keeps_white_space_is_refused():
    import public_tokenizers

    assert splits_at_white_space(word_tokenizer())
    assert not splits_at_white_space(public_tokenizers.path("byte_bpe_50k.json"))


def test_slices():
    assert list(slices([5, 5, 20, 1], 10)) == [(0, 2), (2, 3), (3, 4)]
    assert list(slices([])) == []


@pytest.mark.parametrize("planes", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 1000])
def test_chunks_come_back(planes, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32) >> np.random.default_rng(1).integers(0, 32, n, dtype=np.uint32)
    assert bitplanes.decode_chunk(bitplanes.encode_chunk(ids, planes)).tolist() == ids.tolist()


@pytest.mark.parametrize("chunk_ids, planes", [(64, "byte"), (1 << 16, "bit")])
def test_token_files_round_trip(spark, odd, odd_rows, tmp_path, chunk_ids, planes):
    path = str(tmp_path / "tokens")
    bitplanes.write_token_files(odd, path, word_tokenizer(), end_id=2, chunk_ids=chunk_ids, planes=planes)
    found = sorted(((r["start"], r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in bitplanes.read_token_documents(spark, path).collect()))
    keys = [r[1] for r in found]
    assert keys == sorted(keys, key=lambda k: (k is not None, k))
    assert sorted((str(k), i) for _, k, i in found) == sorted((str(r[0]), ids_of(r[1]) + [2]) for r in odd_rows)
    upto = 0
    for start, _, ids in found:
        assert start == upto
        upto += len(ids)
    index = spark.read.parquet(f"{path}/index").orderBy("first_id").collect()
    assert index[0]["first_id"] == 0 and sum(r["n_ids"] for r in index) == upto


def test_token_files_of_no_documents(spark, none, tmp_path):
    bitplanes.write_token_files(none, str(tmp_path / "t"), word_tokenizer(), end_id=2)
    assert bitplanes.read_token_documents(spark, str(tmp_path / "t")).count() == 0


def test_pieces(odd, odd_rows):
    rows = packing.cut_pieces(odd, word_tokenizer(), end_id=1, capacity=100, with_ids=True).collect()
    whole = defaultdict(list)
    for r in rows:
        assert r["length"] == len(r["ids"]) // 4 and r["ids_crc32"] == zlib.crc32(r["ids"]) and r["start"] == 100 * r["piece"]
        whole[r["doc_id"]].append((r["piece"], np.frombuffer(r["ids"], "<u4").tolist()))
    for key, text in ((r[0], r[1]) for r in odd_rows):
        if key not in (9, None):
            pieces = [ids for _, ids in sorted(whole[key])]
            assert sum(pieces, []) == ids_of(text) + [1] and all(len(p) == 100 for p in pieces[:-1])
    assert len(whole[9]) == 2 and len(whole[None]) == 2


def valid(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_with_exchange_is_near_its_bound(spark):
    lengths = [int(x) for x in np.random.default_rng(3).integers(1, 4097, 4000)] + [4096] * 5 + [1] * 50
    pieces = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id bigint, length bigint")
    packed = packing.pack(pieces, part_rows=500)
    rows = packed.collect()
    assert sorted((r["doc_id"], r["length"]) for r in rows) == sorted(enumerate(lengths))
    n = valid(rows, 4096)
    bins, bound = packing.certificate(packed)
    assert bins == n and bound <= n <= 1.02 * bound
    alone = valid(packing.pack(pieces, part_rows=500, rounds=1).collect(), 4096)
    assert n <= alone


def test_packing_odd_rows(odd, none):
    rows = packing.pack(packing.cut_pieces(odd, word_tokenizer(), end_id=1).withColumns({"part": F.lit(1), "given_up": F.lit(2)})).collect()
    valid(rows, 4096)
    assert packing.pack(packing.cut_pieces(none, word_tokenizer(), end_id=1)).count() == 0


@pytest.mark.parametrize("length", [0, 11, None])
def test_lengths_that_do_not_fit_are_errors(spark, length):
    with pytest.raises(Exception, match="length"):
        packing.pack(spark.createDataFrame([(1, length)], "doc_id bigint, length bigint"), capacity=10).count()


def test_lower_bounds():
    assert packing.fewest_bins([6], [4], 10) == 4  # more than half each
    assert packing.fewest_bins([5], [4], 10) == 2
    assert packing.fewest_bins([4], [5], 10) == 3  # two fit into a bin
    assert packing.fewest_bins([], [], 10) == 0
    rng = np.random.default_rng(0)
    for _ in range(200):
        lengths = rng.integers(1, 11, 12)
        bins, _, fill = packing.best_fit(lengths, 10)
        assert packing.fewest_bins(*np.unique(lengths, return_counts=True), 10) <= len(fill) and fill.max() <= 10
