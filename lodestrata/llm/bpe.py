"""Encoding texts with a public byte-level BPE tokenizer (problem 7).

Words come from the tokenizer's own splitting pattern. Each short word is encoded on a contiguous
rank array: part boundaries and the ranks of adjacent parts, the minimum of which is looked for
again and again, its boundary deleted and the two neighbouring ranks refreshed. That costs the
square of the length, so words beyond LONG_WORD bytes take a heap over linked boundaries, which
merges in the same order. Ranks are read once per Python worker; the vocabulary is of fixed size.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: Folder of the vocabulary files.
TOKENIZERS = "/opt/tokenizers"
#: Bytes up to which a word takes the rank array.
LONG_WORD = 160
#: Words remembered per worker; later ones are encoded anew.
REMEMBERED = 300_000
_NEVER = 1 << 60


class ByteBPE:
    """Encoder over ranks of byte strings."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.ranks = ranks
        self.words = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, without special tokens; none for a null or empty text."""
        if not text:
            return []
        known, ids = self.known, []
        extend = ids.extend
        for word in self.words(text):
            found = known.get(word)
            if found is None:
                found = self.word(word.encode("utf-8", "replace"))
                if len(known) < REMEMBERED and len(word) <= 40:
                    known[word] = found
            extend(found)
        return ids

    def word(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        return self._by_rank_array(piece) if len(piece) <= LONG_WORD else self._by_heap(piece)

    def _by_rank_array(self, piece: bytes) -> tuple[int, ...]:
        ranks = self.ranks
        bounds = list(range(len(piece) + 1))
        adjacent = [ranks.get(piece[i : i + 2], _NEVER) for i in range(len(piece) - 1)]
        while adjacent and (least := min(adjacent)) != _NEVER:
            i = adjacent.index(least)
            del bounds[i + 1], adjacent[i]
            if i < len(adjacent):
                adjacent[i] = ranks.get(piece[bounds[i] : bounds[i + 2]], _NEVER)
            if i:
                adjacent[i - 1] = ranks.get(piece[bounds[i - 1] : bounds[i + 1]], _NEVER)
        return tuple(ranks[piece[a:b]] for a, b in zip(bounds, bounds[1:]))

    def _by_heap(self, piece: bytes) -> tuple[int, ...]:
        ranks, n = self.ranks, len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        gone = bytearray(n + 1)
        while heap:
            _, i, end = heapq.heappop(heap)
            if gone[i] or after[i] >= n or after[after[i]] != end:
                continue
            middle = after[i]
            gone[middle] = 1
            after[i] = end
            if end < n:
                before[end] = i
                if (r := ranks.get(piece[i : after[end]])) is not None:
                    heapq.heappush(heap, (r, i, after[end]))
            if (p := before[i]) >= 0 and (r := ranks.get(piece[p:end])) is not None:
                heapq.heappush(heap, (r, p, end))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : after[i]]])
            i = after[i]
        return tuple(ids)


@lru_cache(maxsize=4)
def load(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> ByteBPE:
    """The tokenizer in folder/name.tiktoken, split by the pattern its package states."""
    with Path(folder, f"{name}.tiktoken").open("rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return ByteBPE(ranks, _pattern(folder))


def _pattern(folder: str) -> str:
    """PATTERN of the package beside the vocabulary files, read without running it."""
    import ast

    for node in ast.parse(Path(folder, "__init__.py").read_text()).body:
        if isinstance(node, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "PATTERN" for t in node.targets):
            return ast.literal_eval(node.value)
    raise ValueError(f"no splitting pattern in {folder}")


def encode_column(df: DataFrame, *, key: str = "doc_id", text: str = "text", out: str = "ids", counts_only: bool = False, tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(key, ids) of every row, or (key, number of ids) with counts_only.

    folder holds the vocabulary on every executor; if it isn't given, the session's setting
    lodestrata.tokenizers names it, else it is TOKENIZERS.

    One row out per row in, repeated and null keys included; null and empty texts give an empty
    list (0). Texts are encoded whole. Other columns are left out, so their names never clash.
    """
    kind: T.DataType = T.LongType() if counts_only else T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("value", kind)])

    folder = folder or df.sparkSession.conf.get("lodestrata.tokenizers", TOKENIZERS)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer, folder)
        for batch in batches:
            texts = batch.column(1)
            for start, stop in _slices(texts):
                part = texts.slice(start, stop - start)
                lists: Iterable[list[int]] = (bpe.encode(t.as_py()) for t in part)
                values = pa.array(map(len, lists), pa.int64()) if counts_only else pa.array(list(lists), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), values], names=["key", "value"])

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(encoded, schema).select(F.col("key").alias(key), F.col("value").alias(out))


def _slices(texts: pa.Array, characters: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of about so many bytes of text, so that few lists of ids are held at once."""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(lengths):
        if held and held + n > characters:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield start, len(lengths)
