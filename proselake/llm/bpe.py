"""Encoding of a corpus with a public byte-level BPE vocabulary by forced-boundary splitting.

A merge can only join two byte runs if the pair of bytes at their seam stands inside some token. A pair that stands
inside none is therefore a certain token boundary, wherever it occurs. Texts are cut at such pairs, each fragment is
encoded by itself, and the ids are concatenated. Fragments repeat (most are a word with its space), so each worker
keeps the ids of those it has met.

The vocabulary's own pre-splitting pattern must not see the cut either. Two places are not cut for that reason: after
white space (the pattern looks ahead there whether more white space follows), and before an apostrophe (which would
begin a contraction if it stood first). Everywhere else the pattern's pieces end at class changes, which a cut leaves
as they are, or are divided by the cut at a boundary that no merge crosses.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-splitting pattern of the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Code points of white space.
SPACES = [*range(9, 14), 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Fragments longer than CACHED_CHARS aren't kept; when CACHE of them are kept, the worker starts anew.
CACHE, CACHED_CHARS = 400_000, 48


def load(path: str = VOCABULARY):
    """(encoding, allowed): a tiktoken encoding of the vocabulary file, and whether each pair of bytes stands inside a token."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    inside = np.zeros(1 << 16, bool)
    for t in ranks:
        a = np.frombuffer(t, np.uint8).astype(np.int64)
        inside[a[:-1] * 256 + a[1:]] = True
    return tiktoken.Encoding("forced", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), inside


class Encoder:
    """Encodes texts by forced boundaries; special-token strings are ordinary text."""

    _kept: dict[str, Encoder] = {}

    def __init__(self, path: str = VOCABULARY) -> None:
        self.encoding, self.inside = load(path)
        self.space = np.zeros(0x110000, bool)
        self.space[SPACES] = True
        self.cache: dict[str, list[int]] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One encoder a worker process."""
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def cuts(self, text: str) -> np.ndarray:
        """Positions in code points where the text is cut."""
        if text.isascii():
            cp = np.frombuffer(text.encode("ascii"), np.uint8)
            first = last = cp.astype(np.int32)
        else:
            cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            last = np.where(cp < 0x80, cp, 0x80 | cp & 0x3F).astype(np.int32)
            first = np.where(cp < 0x80, cp, np.where(cp < 0x800, 0xC0 | cp >> 6, np.where(cp < 0x10000, 0xE0 | cp >> 12, 0xF0 | cp >> 18))).astype(np.int32)
        ok = ~self.inside[last[:-1] * 256 + first[1:]]
        ok &= cp[1:] != 39
        ok &= ~self.space[cp[:-1]]
        return np.flatnonzero(ok) + 1

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; of null and of the empty text no ids."""
        if not text:
            return []
        try:
            at = self.cuts(text).tolist()
        except UnicodeEncodeError:  # lone surrogates, which UTF-8 tables cannot hold
            return self.encode(text.encode("utf-8", "replace").decode())
        cache, out, a = self.cache, [], 0
        at.append(len(text))
        for b in at:
            f = text[a:b]
            a = b
            ids = cache.get(f)
            if ids is None:
                ids = self.encoding.encode_ordinary(f)
                if len(f) <= CACHED_CHARS:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[f] = ids
            out += ids
        return out


def token_ids(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids ARRAY<INT>) of every row. Null, empty: an empty list. One row for each row given, repeated ones too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.of(vocabulary)
        for b in batches:
            lists = [enc.encode(t) for t in b.column(1).to_pylist()]
            ends = np.zeros(len(lists) + 1, np.int32)
            np.cumsum([len(x) for x in lists], out=ends[1:])
            flat = np.fromiter((i for x in lists for i in x), np.int32, int(ends[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def token_counts(documents: DataFrame, keys: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """keys + (tokens BIGINT): the number of ids of each row, beside its key columns."""
    schema = ", ".join(f"`{k}` {documents.schema[k].dataType.simpleString()}" for k in keys) + ", tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.of(vocabulary)
        for b in batches:
            n = [len(enc.encode(t)) for t in b.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(n, pa.int64())], [*keys, "tokens"])

    return documents.select(*keys, "text").mapInArrow(run, schema)
