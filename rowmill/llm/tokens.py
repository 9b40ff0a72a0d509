"""Token ids of many texts with a tokenizer file of the tokenizers library.

The tokenizers used here never join characters across ASCII white space, nor a letter
or digit with a sign behind it, so the ids of a text are the ids of these parts, one after the
other. Each distinct part is encoded once per slice, or once per worker if it came up
early, and the texts are put together from the parts' ids with numpy. Parts of Latin
letters alone go straight to the library's model, as its normalizer and splitter leave
them as they are. `splits_at_white_space` checks that a tokenizer file allows this.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words a worker keeps for good; the rest are encoded once per slice of a batch. Bounds memory only.
KEPT_WORDS = 200_000
#: UTF-8 bytes of text that are put together at a time.
SLICE_BYTES = 3_000_000
#: A sign (other than the apostrophe, which may begin an ending of its own) behind a Latin letter or a digit.
SIGN = re.compile(rb"[!-&(-/:-@\[-`{-~](?:(?<=[a-z0-9].)|(?<=\xc3[\xa0-\xb6\xb8-\xbf].))")
LATIN_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\xa0-\xb6\xb8-\xbf])+")
# Byte-level models write printable octets as they are and the others, in order, as code points from 256.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LEVEL = {b: b for b in _PRINTABLE} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def splits_at_white_space(path: str) -> bool:
    """Whether the tokenizer file replaces white space by a blank and its word pattern never matches one."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    encode = _tokenizer(path).encode
    ids = lambda text: encode(text, add_special_tokens=False).ids
    pieces = ["a b", "a 1", "1 2", "! ?", "' s", "é \u0301", "a \u0301b", "AB Cd"]
    parted = all(ids(p.replace(" ", blank)) == [i for w in p.lower().split(" ") for i in ids(w)] for p in pieces for blank in "\x20\x09\x0a\x0b\x0c\x0d")
    signs = all(ids(f"{word}{run}") == ids(word) + ids(run) for word in ("word", "été", "a1") for run in (".", ",", "***", "!?", "_$", "`~", ".'s"))
    model = _tokenizer(path).model
    plain = all(ids(word) == [t.id for t in model.tokenize(word.encode().decode("latin-1").translate(BYTE_LEVEL))] for word in ("word", "été", "größe", "zzqxj"))
    added = any(t["lstrip"] or t["rstrip"] or any(c.isspace() for c in t["content"]) or not t["content"].startswith("<|") for t in spec["added_tokens"])
    return parted and signs and plain and not added and spec["model"]["type"] == "BPE" and spec["model"]["end_of_word_suffix"] == "</w>"


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class TextEncoder:
    """Ids of UTF-8 texts, as one array for many texts and the number of ids of each."""

    def __init__(self, path: str):
        if not splits_at_white_space(path):
            raise ValueError(f"{path} is no tokenizer whose words end at white space")
        self.tokenizer = _tokenizer(path)
        self.model = self.tokenizer.model
        self.words: dict[bytes, int] = {}
        self.ids = np.empty(0, np.uint32)
        self.starts = np.zeros(1, np.int64)

    def _encode_words(self, words: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The words in an order of its own, all their ids in that order, and how many each has."""
        tokenize, latin = self.model.tokenize, LATIN_LETTERS.fullmatch
        plain, rest = [], []
        for word in words:
            (plain if latin(word) else rest).append(word)
        found = [[t.id for t in tokenize(w.decode() if w.isascii() else w.decode("latin-1").translate(BYTE_LEVEL))] for w in plain]
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        found += [e.ids for e in encode([w.decode("utf-8", "replace") for w in rest], add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return plain + rest, np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum())), counts

    def __call__(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and the number of ids of each; null texts have none."""
        # the tokenizer lowers all letters; its special tokens count as written
        texts = [b"" if not t else t if b"<|" in t else SIGN.sub(rb" \g<0>", t.lower()) for t in texts]
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).cast(pa.large_string(), safe=False))
        flat = split.flatten()
        filled = pc.greater(pc.binary_length(flat), 0)  # white space at the ends gives empty words
        owner = pc.list_parent_indices(split).filter(filled).to_numpy()
        counts = np.bincount(owner, minlength=len(texts)).astype(np.int64)
        if not len(owner):
            return np.empty(0, np.uint32), counts
        coded = flat.filter(filled).cast(pa.large_binary()).dictionary_encode()
        words, ids, starts, first = coded.dictionary.to_pylist(), self.ids, self.starts, len(self.words)
        places = np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(places < 0).tolist()
        if unknown:
            new, more, lengths = self._encode_words([words[i] for i in unknown])
            ids = np.concatenate((ids, more))
            starts = np.concatenate((starts, starts[-1] + np.cumsum(lengths)))
            here = dict(zip(new, range(first, first + len(new))))
            places[unknown] = [here[words[i]] for i in unknown]
            keep = min(max(0, KEPT_WORDS - first), len(new))
            if keep:
                self.words.update(zip(new[:keep], range(first, first + keep)))
                self.ids, self.starts = ids[: starts[first + keep]], starts[: first + keep + 1]
        places = places[coded.indices.to_numpy()]
        lengths = starts[places + 1] - starts[places]
        ends = np.cumsum(lengths)
        out = ids[np.repeat(starts[places] - ends + lengths, lengths) + np.arange(ends[-1])]
        upto = np.concatenate(([0], ends))[np.cumsum(counts)]
        return out, np.diff(upto, prepend=0)


@lru_cache(maxsize=4)
def text_encoder(path: str) -> TextEncoder:
    """The worker's encoder for a tokenizer file; it keeps its words from task to task."""
    return TextEncoder(path)


def slices(sizes: list[int], limit: int = SLICE_BYTES):
    """Ranges of neighbours whose sizes add up to about the limit; one larger item stands alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def text_slices(batch):
    """Keys and UTF-8 texts of a batch with doc_id and text, a slice at a time."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
    for a, z in slices(sizes):
        part = batch.slice(a, z - a)
        yield part.column("doc_id").to_pylist(), part.column("text").to_pylist()


def word_tokenizer() -> str:
    """The file of the public word tokenizer that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
