"""Filling fixed-capacity containers with texts (problem 8), by sum-of-squares packing.

Each item goes where the sum over gaps of the squared number of open containers with that gap
becomes smallest. The state of a packer is one count per gap and the open containers, so it packs a
stream; rows are hashed to packers of about PACKER_ITEMS items. Containers that a packer leaves open
are items themselves for the next pass, which packs whole containers into each other with far fewer
packers, until one packer holds what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from lodestrata.llm.bpe import encode_column
from lodestrata.session import cut

CAPACITY = 4_096
#: Items of one packer, about; a packer's gaps even out over some thousand items.
PACKER_ITEMS = 50_000


class SumOfSquares:
    """Online packer of integer sizes into containers of one capacity."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)  # open containers by gap; full ones aren't open
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.levels: list[int] = []

    def place(self, size: int) -> int:
        """Number of the container that takes an item of 0 to capacity; opens one where that is best."""
        capacity, counts = self.capacity, self.counts
        if not 0 <= size <= capacity:
            raise ValueError("an item must fit an empty container")
        if size == 0:
            gap = next((g for g in (self._last,) if self.open[g]), None) if self.levels else None
            return self.open[gap][-1] if gap is not None else self._into_new(0)
        # the change of the sum, halved, if a container of gap g takes the item and has g - size left
        after = counts[: capacity - size + 1].copy()
        change = after - counts[size:] + 1
        change[0] = -counts[size]  # a container that becomes full leaves the sum; half of the change, rounded up
        possible = np.flatnonzero(counts[size:])
        new = counts[capacity - size] if size < capacity else 0
        if len(possible):
            doubled = 2 * change[possible]
            doubled[possible == 0] += 1
            best = int(possible[int(np.argmin(doubled))])
            if int(2 * change[best] + (best == 0)) <= 2 * new + 1:
                return self._into(best + size, size)
        return self._into_new(size)

    _last = 0

    def _into(self, gap: int, size: int) -> int:
        number = self.open[gap].pop()
        self.counts[gap] -= 1
        self._keep(number, gap - size)
        self.levels[number] += size
        return number

    def _into_new(self, size: int) -> int:
        self.levels.append(size)
        self._keep(len(self.levels) - 1, self.capacity - size)
        return len(self.levels) - 1

    def _keep(self, number: int, gap: int) -> None:
        if gap:
            self.counts[gap] += 1
            self.open[gap].append(number)
            self._last = gap


def _pack_group(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["turn", "item"], kind="stable")
    packer = SumOfSquares(capacity)
    return pd.DataFrame({"item": pdf["item"].to_numpy(), "own": [packer.place(int(n)) for n in pdf["size"]], "packer": pdf["packer"].to_numpy()})


def _packed(items: DataFrame, packers: int, capacity: int, salt: int) -> DataFrame:
    """(item, box) of (item, size); box is a string that names packer and container."""
    rows = items.select("item", "size", F.xxhash64(F.lit(salt), "item").alias("turn")).withColumn("packer", F.pmod(F.xxhash64(F.lit(salt + 1), "item"), F.lit(packers)))
    done = rows.groupBy("packer").applyInPandas(lambda pdf: _pack_group(pdf, capacity), "item string, own long, packer long")
    return done.select("item", F.concat_ws("-", F.lit(salt), "packer", "own").alias("box"))


def pack(items: DataFrame, capacity: int = CAPACITY, packer_items: int = PACKER_ITEMS) -> DataFrame:
    """(item, container) of (item, size): every item in one container, none above the capacity.

    Items are distinct strings with sizes from 0 to the capacity. The result depends on the items
    alone, not on their order or partitions. Containers that packers leave open are packed again by
    fewer packers, until one packer is left or a pass leaves as many open as before: a packer leaves
    few, so passes are about the logarithm of the packers.
    """
    total = items.count()
    packers = max(1, -(-total // packer_items))
    placed = cut(_packed(items, packers, capacity, 1))
    level, before = 3, total
    while packers > 1:
        # containers with room left are few, at most some per gap and packer
        sizes = placed.join(items, "item").groupBy("box").agg(F.sum("size").alias("size"))
        open_ones = cut(sizes.where(F.col("size") < capacity).select(F.col("box").alias("item"), "size"))
        left = open_ones.count()
        if left >= before:
            break
        before = left
        packers = min(max(1, -(-left // packer_items)), packers - 1)
        again = _packed(open_ones, packers, capacity, level).select(F.col("item").alias("box"), F.col("box").alias("moved"))
        placed = cut(placed.join(again, "box", "left").select("item", F.coalesce("moved", "box").alias("box")))
        level += 2
    return placed.select("item", F.col("box").alias("container"))


def pack_documents(df: DataFrame, *, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, packer_items: int = PACKER_ITEMS, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """(key, piece, first_token, n_tokens, container) of every document, sized in tokens.

    Only a text of more than capacity tokens is split: into full pieces, each a container of its
    own, and a rest. Null and empty texts are one piece of 0 tokens. Repeated rows and null keys
    are documents of their own, told apart by copy (null keys by their place in the input); an empty
    table gives an empty result.
    """
    counted = encode_column(df, key=key, text=text, out="tokens", counts_only=True, tokenizer=tokenizer)
    # repeated keys are numbered; null keys each get a number of their own, so none is a hot group
    own = F.when(F.col(key).isNull(), F.monotonically_increasing_id())
    turn = F.row_number().over(Window.partitionBy(key, "own").orderBy("tokens")) - 1
    counted = cut(counted.withColumn("own", own).select(key, "tokens", F.coalesce("own", turn.cast("long")).alias("copy")))
    pieces = F.greatest(F.lit(1), F.ceil(F.col("tokens") / capacity)).cast("int")
    parts = counted.select(key, "copy", "tokens", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
    parts = parts.select(key, "copy", "piece", (F.col("piece") * capacity).cast("long").alias("first_token"), F.least(F.lit(capacity), F.col("tokens") - F.col("piece") * capacity).cast("long").alias("n_tokens"))
    parts = parts.withColumn("item", F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("null")), "copy", "piece"))
    full = parts.where(F.col("n_tokens") == capacity).withColumn("container", F.concat(F.lit("full-"), "item"))
    rest = parts.where(F.col("n_tokens") < capacity)
    packed = rest.join(pack(rest.select("item", F.col("n_tokens").alias("size")), capacity, packer_items), "item")
    columns = [key, "copy", "piece", "first_token", "n_tokens", "container"]
    return full.select(*columns).unionByName(packed.select(*columns))


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, the least number of containers possible, and the share filled."""
    boxes = packed.groupBy("container").agg(F.sum("n_tokens").alias("held"))
    return boxes.agg(
        F.count(F.lit(1)).alias("n_containers"), F.coalesce(F.sum("held"), F.lit(0)).alias("n_tokens"),
        F.coalesce(F.ceil(F.sum("held") / capacity), F.lit(0)).alias("least_containers"), F.max("held").alias("fullest"),
        (F.sum("held") / (F.count(F.lit(1)) * capacity)).alias("filled"),
    )
