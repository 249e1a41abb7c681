"""Problem 7: filling fixed-capacity containers with items.

Method: best-two-fit. Sizes are tokens of a public tokenizer whose vocabulary file is a parameter. In each shard of
items a container is filled greedily, largest fitting item first; then its smallest item is taken out if two unpacked
items fit the gap that leaves more tightly than the smallest item did, and so on while that helps. Free sizes are bits of one integer, so "largest
item of at most x" and "two items of exactly x" are a few machine operations. Containers under ``merge_below`` full are
opened again and their items move upward, into as many shards as their number asks for. The level that holds at most one
shard of items is the last; so is the one after a level that left more than ``least_gain`` of its items over, as items
that fit nowhere well (all a little over half a container, say) gain nothing by moving on.

Only (id, number of tokens) leaves the task that reads a text. A shard holds ``shard_items`` items on average at every
level, the last one included.

An item larger than a container is cut into full containers of its own and a remainder, which is packed like an item.

Defined results. Null and empty texts have 0 tokens and ride along in a container of their shard. Ties go to the smaller
id. Repeated ids are items of their own. An empty table gives no container.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.plans.shared import materialize
from skarn.plans.spread import spread

CAPACITY = 2_048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SHARD_ITEMS = 20_000
LEAST_GAIN = 0.5
MERGE_BELOW = 0.995
#: Fixed value: the split pattern that goes with the 50k byte-level vocabulary, as its publishers state it.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PACKED = "container string, doc_id long, piece_no int, n_tokens int, fill int"

_encodings: dict[str, object] = {}


def encoding(path: str):
    """The tokenizer of a rank file, read once a worker."""
    if path not in _encodings:
        import base64

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _encodings[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            sizes = [len(encode(text)) if text else 0 for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32())], names=["doc_id", "n_tokens"])

    return run


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return spread(rows).mapInArrow(_count(tokenizer), "doc_id long, n_tokens int")


class _Free:
    """Unpacked items by size."""

    def __init__(self, sizes: list[int], capacity: int):
        self.capacity = capacity
        self.items: list[list[int]] = [[] for _ in range(capacity + 1)]
        for n in range(len(sizes) - 1, -1, -1):
            self.items[sizes[n]].append(n)
        self.bits = sum(1 << s for s in range(1, capacity + 1) if self.items[s])
        self.mirror = sum(1 << (capacity - s) for s in range(1, capacity + 1) if self.items[s])

    def largest(self, at_most: int) -> int:
        """The largest free size up to ``at_most``, or 0."""
        return max(0, (self.bits & ((1 << (at_most + 1)) - 1)).bit_length() - 1)

    def take(self, size: int) -> int:
        item = self.items[size].pop()
        if not self.items[size]:
            self.bits &= ~(1 << size)
            self.mirror &= ~(1 << (self.capacity - size))
        return item

    def put(self, size: int, item: int) -> None:
        self.items[size].append(item)
        self.bits |= 1 << size
        self.mirror |= 1 << (self.capacity - size)

    def two(self, at_most: int, above: int) -> tuple[int, int] | None:
        """Two free sizes whose sum is as large as possible, at most ``at_most`` and more than ``above``."""
        for total in range(at_most, above, -1):
            shift = self.capacity - total
            both = self.bits & (self.mirror >> shift if shift >= 0 else self.mirror << -shift)
            while both:
                a = both.bit_length() - 1
                both &= ~(1 << a)
                b = total - a
                if b < 1 or b > a:
                    continue
                if a != b or len(self.items[a]) > 1:
                    return a, b
        return None


def best_two_fit(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Containers as lists of item numbers. Sizes are 1 to ``capacity``; items come in the order in which ties go."""
    free = _Free(sizes, capacity)
    out: list[list[int]] = []
    while free.bits:
        gap, packed = capacity, []
        while size := free.largest(gap):
            packed.append((size, free.take(size)))
            gap -= size
        while gap and len(packed) > 1 and (pair := free.two(gap + packed[-1][0], packed[-1][0])):
            size, item = packed.pop()
            packed += [(s, free.take(s)) for s in pair]
            free.put(size, item)
            gap += size - sum(pair)
        out.append([item for _, item in packed])
    return out


def _pack(capacity: int, merge_below: float, level: int, last: bool):
    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["doc_id", "piece_no"], kind="stable").reset_index(drop=True)
        number = int(shard["shard"].iloc[0])
        sized, empty = shard[shard["n_tokens"] > 0].reset_index(drop=True), shard[shard["n_tokens"] <= 0]
        sizes = sized["n_tokens"].tolist()
        names, fills = [""] * len(sized), [0] * len(sized)
        first = None
        for k, items in enumerate(best_two_fit(sizes, capacity)):
            fill = sum(sizes[i] for i in items)
            name = f"{level}-{number}-{k}" if last or fill >= merge_below * capacity else None
            first = first or ((name, fill) if name else None)
            for i in items:
                names[i], fills[i] = name, fill
        sized = sized.assign(container=names, fill=fills)
        name, fill = first or (f"{level}-{number}-0" if last else None, 0)
        out = pd.concat([sized, empty.assign(container=name, fill=fill)], ignore_index=True)
        return out[["container", "doc_id", "piece_no", "n_tokens", "fill", "shard"]]

    return run


def pack(
    counts: DataFrame,
    capacity: int = CAPACITY,
    shard_items: int = SHARD_ITEMS,
    least_gain: float = LEAST_GAIN,
    merge_below: float = MERGE_BELOW,
) -> DataFrame:
    """(doc_id, n_tokens) -> (container, doc_id, piece_no, n_tokens, fill): one row per document or piece of a large one."""
    counts = materialize(counts, "p7-sizes")
    full = F.floor(F.col("n_tokens") / capacity).cast("int")
    whole = counts.where(F.col("n_tokens") > capacity)
    # the running number keeps repeated ids apart; it is stable because the sizes are a written table
    whole = whole.withColumn("row", F.monotonically_increasing_id())
    own = whole.select("doc_id", "row", F.explode(F.sequence(F.lit(0), full - 1)).alias("piece_no")).select(
        F.concat_ws("-", F.lit("own"), "row", "piece_no").alias("container"),
        "doc_id",
        "piece_no",
        F.lit(capacity).alias("n_tokens"),
        F.lit(capacity).alias("fill"),
    )
    rest = counts.select(
        "doc_id",
        F.when(F.col("n_tokens") > capacity, full).otherwise(0).alias("piece_no"),
        F.when(F.col("n_tokens") > capacity, F.col("n_tokens") % capacity).otherwise(F.col("n_tokens")).alias("n_tokens"),
    ).where((F.col("piece_no") == 0) | (F.col("n_tokens") > 0))
    left = counts.count()
    level_rows, out, level, last = rest, own, 0, False
    while True:
        shards = max(1, -(-left // shard_items))
        last = last or shards == 1
        # another seed a level, so that what met no match meets others
        dealt = level_rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(level)), F.lit(shards)).cast("int"))
        done = dealt.groupBy("shard").applyInPandas(_pack(capacity, merge_below, level, last), PACKED + ", shard int")
        done = materialize(done, "p7-level")
        out = out.unionByName(done.where("container IS NOT NULL").drop("shard"))
        if last:
            return out
        level_rows = done.where("container IS NULL").select("doc_id", "piece_no", "n_tokens")
        before, left = left, level_rows.count()
        last = left > least_gain * before
        level += 1


def packing_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers, items, tokens and the share of space left over."""
    by = packed.groupBy("container").agg(F.sum("n_tokens").alias("fill"), F.count("*").alias("items"))
    return by.agg(
        F.count("*").alias("containers"),
        F.sum("items").cast("long").alias("items"),
        F.sum("fill").cast("long").alias("tokens"),
        F.max("fill").cast("int").alias("largest_fill"),
        (1 - F.sum("fill") / (F.count("*") * F.lit(capacity))).alias("space_left"),
    )
