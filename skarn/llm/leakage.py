"""Problem 8: evaluation texts leaking into training text.

Method: spaced-seed hashing. Words of the visible form (lower case, no punctuation, look-alikes unified) are numbered.
Fixed masks over word positions hash six words and ignore the ones between; the hashes of the held-out items are joined
with those of every document position, and around each hit the overlap is verified with tolerance for changed words.

The held-out side is a stated query set. It is read in blocks of ``block_items`` items; each block is one map-only pass
over the documents, so no corpus row is shuffled and what a task holds is bounded by the block, not by either table.

A pair is reported if, along the alignment, at least ``min_words`` words of the item (or the whole item if it is
shorter) stand in the document in their order, with at most one word in ``tolerance`` changed.

Defined results. Null or empty document or item: no pair. Items shorter than eight words: matched whole and exactly, as
their seed is the item itself. Repeated documents: each reported. Repeated item ids: reported once a document. Extra
columns are ignored. Empty tables: empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.chars import plain
from skarn.plans.spread import spread

#: Positions read by each mask; the ones between may differ. 20 words with 2 changed hold a run of six (first mask); with
#: 3 changed they hold runs of four and two on both sides of a changed word (second mask); the third bridges two changes.
MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 2, 3, 5, 6), (0, 1, 3, 4, 6, 7))
MIN_WORDS = 20
TOLERANCE = 8
BLOCK_ITEMS = 4_000
SCHEMA = "doc_id long, item_id long, matched_words int, item_words int, changed_words int"
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xA0761D6478BD642F], dtype=np.uint64)
_DROP = re.compile(r"[^\w\s]+|_+")


def tokens_of(text: str) -> list[str]:
    """Words between white space, in lower case, without punctuation; look-alikes unified."""
    return _DROP.sub("", plain(text).lower()).split()


def _hashes(ids: np.ndarray, mask: tuple[int, ...], at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), dtype=np.uint64)
    for k, offset in enumerate(mask):
        out = (out ^ ids[at + offset].astype(np.uint64)) * _MIX[k]
        out ^= out >> np.uint64(29)
    return out


class Index:
    """The numbered words and seed hashes of one block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, Item]] = []
        numbers: list[np.ndarray] = []
        self.short: dict[tuple[int, ...], list[int]] = {}
        for item_id, text in items:
            tokens = tokens_of(text or "")
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in tokens], dtype=np.int64)
            if len(ids) >= 8:
                self.items.append((item_id, Item(tokens)))
                numbers.append(ids)
            elif len(ids):
                self.short.setdefault(tuple(ids.tolist()), []).append(item_id)
        self.seeds = []
        for mask in MASKS:
            hashes, owners, offsets = [], [], []
            for n, ids in enumerate(numbers):
                at = np.arange(max(0, len(ids) - mask[-1]))
                hashes.append(_hashes(ids, mask, at))
                owners.append(np.full(len(at), n))
                offsets.append(at)
            h = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
            order = np.argsort(h, kind="stable")
            join = np.concatenate if hashes else lambda _: np.zeros(0, dtype=np.int64)
            self.seeds.append((mask, h[order], join(owners)[order], join(offsets)[order]))

    def hits(self, ids: np.ndarray) -> dict[int, dict[int, set[int]]]:
        """Item number -> {diagonal: item positions} of the seed hits in one text of word numbers.

        A diagonal is text position less item position; all its hits are kept.
        """
        found: dict[int, dict[int, set[int]]] = {}
        for mask, hashes, owners, offsets in self.seeds:
            last = len(ids) - mask[-1]
            if last <= 0 or not len(hashes):
                continue
            known = ids[:last] > 0
            for offset in mask[1:]:
                known &= ids[offset : offset + last] > 0
            at = np.nonzero(known)[0]
            if not len(at):
                continue
            h = _hashes(ids, mask, at)
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            for k in np.nonzero(hi > lo)[0]:
                for s in range(lo[k], hi[k]):
                    position = int(offsets[s])
                    found.setdefault(int(owners[s]), {}).setdefault(int(at[k]) - position, set()).add(position)
        return found


class Side:
    """The words of an item in one direction, and for each word what the text is searched for if it does not follow:
    (next word, letters of it and the one after, how far they may stand, changed words)."""

    def __init__(self, words: list[str]):
        self.words = [(w, len(w)) for w in words]
        self.ahead: list[list[tuple[int, str, int, int]]] = []
        for k in range(len(words)):
            here = []
            for skip in range(min(3, len(words) - k)):
                target = "".join(words[k + skip : k + skip + 2])
                if len(target) > 3 or skip == 1:
                    here.append((k + skip, target, sum(map(len, words[k : k + skip])) + 24 + len(target), max(1, skip)))
            self.ahead.append(here)


class Item:
    """The words of an item, forwards and backwards."""

    def __init__(self, words: list[str]):
        self.words, self.forward, self.back = words, Side(words), Side([w[::-1] for w in words[::-1]])

    def __len__(self) -> int:
        return len(self.words)


class Stream:
    """The letters of a text's words and where each word starts, forwards and backwards."""

    def __init__(self, tokens: list[str]):
        self.letters, self.starts = "".join(tokens), list(accumulate(map(len, tokens), initial=0))
        self.back = self.letters[::-1]
        self.back_starts = [len(self.back) - p for p in reversed(self.starts)]


def _extend(side: Side, k: int, stream: str, starts: list[int], p: int, tolerance: int) -> list[int]:
    """Changed words counted at each item word from ``k`` on, as far as the text follows the item from letter ``p`` on.

    Where the item is not found again close by, one word counts as replaced by one word of the text. The budget starts
    with the changes that a stretch of the whole item may have, as the words beyond the hit count too.
    """
    out: list[int] = []
    words, n, follows, find = side.words, len(side.words), stream.startswith, stream.find
    budget, since = max(2, (n + tolerance // 2) // tolerance), 0
    while k < n:
        word, size = words[k]
        if follows(word, p):
            p += size
            out.append(0)
            k += 1
            since += 1
            if since == tolerance - 3:
                budget, since = budget + 1, 0
            continue
        if budget <= 0:
            break
        for new_k, target, reach, cost in side.ahead[k]:
            if (q := find(target, p, p + reach)) >= 0:
                p = q
                break
        else:
            if (after := bisect_right(starts, p)) >= len(starts) - 1:
                break
            new_k, p, cost = k + 1, starts[after], 1
        budget -= cost
        if new_k == k:  # a word put in: charged to the word before
            if out:
                out[-1] += cost
        else:
            out += [1] * (new_k - k)
            k = new_k
    return out


def overlap(item: Item, text: Stream, at: int, position: int, tolerance: int = TOLERANCE, least: int = 1) -> tuple[int, int, int, int]:
    """Longest stretch of item words around the hit that stands in the text in order: (words, changed words inside, first
    item word, end of the equal words that follow the hit).

    The text is followed letter by letter without white space and punctuation, so hyphenation at line ends, quote marks
    and mark-up inside words do not count as changes. The stretch starts and ends with equal words and has at most about
    one changed word in ``tolerance``. Stretches of fewer than ``least`` words are not looked for.
    """
    after = _extend(item.forward, position, text.letters, text.starts, text.starts[at], tolerance)
    equal = position + next((k for k, c in enumerate(after) if c), len(after))
    needed = least - (least + tolerance // 2) // tolerance  # equal words; a longer stretch needs no fewer
    if after.count(0) + position < needed:
        return 0, 0, position, equal
    start = len(text.letters) - text.starts[at]
    before = _extend(item.back, len(item) - position, text.back, text.back_starts, start, tolerance)
    cost = before[::-1] + after
    n = len(cost)
    if cost.count(0) < needed:
        return 0, 0, position, equal
    total = [0]
    for c in cost:
        total.append(total[-1] + c)
    for length in range(n, least - 1, -1):
        for i in range(n - length + 1):
            j = i + length - 1
            if cost[i] == 0 and cost[j] == 0 and (changed := total[j] - total[i]) * tolerance <= length + tolerance // 2:
                return length, changed, position - len(before) + i, equal
    return 0, 0, position, equal


def longest(item: Item, text: Stream, hits: dict[int, set[int]], tolerance: int = TOLERANCE, least: int = 1) -> tuple[int, int]:
    """Longest stretch around any hit, the one with fewest changed words: (words, changed words inside).

    Hits inside a stretch already verified on their diagonal are covered by it.
    """
    best = (0, 0)
    for diagonal, positions in hits.items():
        done: list[tuple[int, int]] = []
        for q in sorted(positions):
            if any(lo <= q < hi for lo, hi in done):
                continue
            length, changed, first, equal = overlap(item, text, diagonal + q, q, tolerance, least)
            done += [(first, first + length), (q, equal)]
            best = max(best, (length, -changed))
            if best == (len(item), 0):
                return best
    return best[0], -best[1]


def _scan(index: Index, min_words: int, tolerance: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = index.vocabulary.get
        for batch in batches:
            out: list[tuple[int, int, int, int, int]] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text or doc_id is None:
                    continue
                tokens = tokens_of(text)
                ids = np.fromiter((number(w, 0) for w in tokens), dtype=np.int64, count=len(tokens))
                found = index.hits(ids)
                stream = Stream(tokens) if found else None
                for n, hits in found.items():
                    item_id, item = index.items[n]
                    least = min(min_words, len(item))
                    length, changed = longest(item, stream, hits, tolerance, least)
                    if length >= least:
                        out.append((doc_id, item_id, length, len(item), changed))
                if index.short and ids.any():
                    for key, item_ids in index.short.items():
                        at = np.nonzero(ids[: len(ids) - len(key) + 1] == key[0])[0] if len(ids) >= len(key) else []
                        if any(tuple(ids[a : a + len(key)].tolist()) == key for a in at):
                            out += [(doc_id, item_id, len(key), len(key), 0) for item_id in item_ids]
            columns = list(zip(*out, strict=True)) or [[], [], [], [], []]
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            names = ["doc_id", "item_id", "matched_words", "item_words", "changed_words"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return scan


def leaked_items(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    min_words: int = MIN_WORDS,
    tolerance: int = TOLERANCE,
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """Pairs of a document and a held-out item it contains: (doc_id, item_id, matched_words, item_words, changed_words)."""
    spark = docs.sparkSession
    corpus = spread(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).alias("text")))
    queries = (
        items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text"))
        .where("text IS NOT NULL AND item_id IS NOT NULL")
        .dropDuplicates(["item_id", "text"])
    )
    blocks = max(1, -(-queries.count() // block_items))
    numbered = queries.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"))
    out = None
    for block in range(blocks):
        rows = [(r.item_id, r.text) for r in numbered.where(F.col("block") == block).orderBy("item_id").toLocalIterator()]
        found = corpus.mapInArrow(_scan(Index(rows), min_words, tolerance), SCHEMA)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], SCHEMA)
    return out.groupBy("doc_id", "item_id").agg(
        F.max("matched_words").alias("matched_words"), F.max("item_words").alias("item_words"), F.min("changed_words").alias("changed_words")
    )
