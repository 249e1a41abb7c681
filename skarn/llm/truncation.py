"""Problem 2: text cut off by field limits.

Method: near-copies are found through min-hash banding (shingles of five words, 8 bands of 4 minima, for a similarity of
0.8 or more), verified pairs are aligned, and the copy whose alignment ends early is flagged; records without such a
copy are scored by closing-word terminality: how often the words a text ends with close a line, path, parameter or
quotation anywhere in the corpus, against how often they stand there at all.

A cut copy is contained in its original rather than similar to it, so two searches are made. Of near-copies in a band,
each open-ended text is aligned with every longer one, so that no other copy stands between it and its original.
Word-for-word beginnings are looked up whatever the
length of the original: every text offers hashes of its first 8, 16, 24, ... words, every open-ended one asks for its
deepest; originals found in this way offer hashes of the up to seven words beyond, each with the word that follows, and a
text is flagged if its own words up to the last are among them and the last goes on there. The second is linear in the rows,
the first in the pairs of an open-ended and a longer text of a band.

An end by a mark of omission, inside an open quotation, bracket, call or list number is settled by that; every other open
end is scored by its closing words. A text that ends with a closing mark or a closed unit is complete.

One pass over the texts gives, for each row, the state of its ending, the band and prefix hashes and a digest of the text,
and counts of closing words, summed per task before they are shuffled. Equal texts share one entry in both searches.
Texts are read a second time only for the compared pairs.

Defined results. Null, blank and stand-in texts ("n/a", "-", "...") are not cut. A text that is one word or one call is
complete. A text that repeats its question without an end mark is not cut. Repeated rows: each is flagged. Extra columns
are ignored. Empty tables: empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.endings import COMPLETE, CUT, DOUBT, MARK, closes, closing_counts, ending, is_copy
from skarn.plans.shared import materialize
from skarn.plans.skew import salted_join
from skarn.plans.spread import spread

SHINGLE = 5
BANDS, ROWS = 8, 4
SIMILARITY = 0.8
#: A text in doubt is cut if its closing words close less often than this, by kind of key.
LEAST_TERMINALITY = {"s": 0.05, "v": 0.5, "n": 0.05, "u": 0.5, "w": 0.5}
#: Words between the prefixes that a text offers.
STEP = 8
#: Up to this many compared texts are looked up by broadcast of their keys (24 bytes each); beyond, by a shuffled join.
BROADCAST_KEYS = 200_000
_RNG = np.random.default_rng(20)
_A = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_P = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, SHINGLE + 1)], dtype=np.uint64)
_SCHEMA = "table_name string, row_key long, source string, digest long, n_chars int, state int, key string, bands array<long>, n_stands long, n_closes long, "
_SCHEMA += "steps array<long>, asked long, exact long, last string"
_ARROW = pa.schema(
    [("table_name", pa.string()), ("row_key", pa.int64()), ("source", pa.string()), ("digest", pa.int64()), ("n_chars", pa.int32())]
    + [("state", pa.int32()), ("key", pa.string()), ("bands", pa.list_(pa.int64())), ("n_stands", pa.int64()), ("n_closes", pa.int64())]
    + [("steps", pa.list_(pa.int64())), ("asked", pa.int64()), ("exact", pa.int64()), ("last", pa.string())]
)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 1_000_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def signatures(token_lists: list[list[str]], hashes: dict[str, int]) -> list[list[int] | None]:
    """Band hashes of each token list; None where there are fewer than ``SHINGLE`` tokens."""
    sizes = np.array([max(0, len(t) - SHINGLE + 1) for t in token_lists])
    out: list[list[int] | None] = [None] * len(token_lists)
    keep = np.nonzero(sizes)[0]
    if not len(keep):
        return out
    flat = np.fromiter((hashes[w] for k in keep for w in token_lists[k]), dtype=np.uint64)
    lengths = np.array([len(token_lists[k]) for k in keep])
    ends = np.cumsum(lengths)
    window = np.zeros(len(flat) - SHINGLE + 1, dtype=np.uint64)
    for k in range(SHINGLE):
        window += flat[k : len(flat) - SHINGLE + 1 + k] * _P[k]
    window ^= window >> np.uint64(31)
    inside = np.ones(len(window), dtype=bool)
    for k in range(1, SHINGLE):
        across = ends[:-1] - k
        inside[across[across >= 0]] = False
    window = window[inside]
    starts = np.concatenate([[0], np.cumsum(sizes[keep])[:-1]])
    bands = np.zeros((len(keep), BANDS), dtype=np.uint64)
    for n in range(BANDS * ROWS):
        h = window * _A[n] + _B[n]
        h ^= h >> np.uint64(33)
        least = np.minimum.reduceat(h, starts)
        bands[:, n // ROWS] = (bands[:, n // ROWS] ^ least) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(n // ROWS)
    for row, k in zip(bands.view(np.int64).tolist(), keep, strict=True):
        out[k] = row
    return out


_powers = np.zeros(0, dtype=np.uint64)


def prefixes(tokens: list[str], hashes: dict[str, int]) -> np.ndarray:
    """Hashes of the first 1, 2, 3, ... words of a text."""
    global _powers
    if len(tokens) > len(_powers):
        _powers = np.cumprod(np.full(max(4096, 2 * len(tokens)), 0x9E3779B97F4A7C15, dtype=np.uint64))
    out = np.cumsum(np.array([hashes[w] for w in tokens], dtype=np.uint64) * _powers[: len(tokens)])
    out ^= out >> np.uint64(32)
    return (out * np.uint64(0xC2B2AE3D27D4EB4F)).view(np.int64)


def open_end(text: str) -> list[str]:
    """The words of a text without a closing mark of omission."""
    return MARK.sub("", text.rstrip()).split()


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the state of their ending and their bands, then rows of closing-word counts with a null table name."""
    import xxhash

    hashes, counts, stands, closing = _WordHashes(), Counter(), Counter(), Counter()

    def flush() -> pa.RecordBatch:
        for w, n in stands.items():
            if w.isalpha():
                counts[f"w:{w}", 0], counts[f"w:{w}", 1] = n, closing[w]
        stands.clear()
        closing.clear()
        keys = sorted({k for k, _ in counts})
        n = len(keys)
        columns = [pa.nulls(n, _ARROW.field(i).type) for i in range(6)]
        columns += [pa.array(keys, pa.string()), pa.nulls(n, _ARROW.field(7).type)]
        columns += [pa.array([counts[k, i] for k in keys], pa.int64()) for i in (0, 1)]
        columns += [pa.nulls(n, _ARROW.field(i).type) for i in range(10, 14)]
        counts.clear()
        return pa.RecordBatch.from_arrays(columns, schema=_ARROW)

    for batch in batches:
        table_name, row_key, source, path, question, text = batch.columns
        texts, states, keys = text.to_pylist(), [], []
        for t, p, q in zip(texts, path.to_pylist(), question.to_pylist(), strict=True):
            state, key = ending(t, p)
            if state != COMPLETE and is_copy(t, q):
                state, key = COMPLETE, ""
            if t:
                closing_counts(t, counts)
            if state == DOUBT:
                closes(t, key, counts)
            if key == "word" and (word := t.split()[-1]).isalpha():
                state, key = DOUBT, f"w:{word}"
            states.append(state)
            keys.append(key or None)
        tokens = [t.split() if t else [] for t in texts]
        steps, asked, exact, last = [], [], [], []
        for t, own, state in zip(texts, tokens, states, strict=True):
            stands.update(own)
            closing.update(line.rsplit(None, 1)[-1] for line in (t or "").split("\n")[:-1] if line and not line.isspace())
            ahead = prefixes(own, hashes) if len(own) > STEP else None
            steps.append(ahead[STEP - 1 : -1 : STEP].tolist() if ahead is not None else [])
            ends = open_end(t) if state != COMPLETE and ahead is not None else []
            whole = len(ends) - 1
            found = whole >= STEP
            asked.append(int(ahead[whole // STEP * STEP - 1]) if found else None)
            exact.append(int(ahead[whole - 1]) if found else None)
            last.append(ends[-1] if found else None)
        digests = [xxhash.xxh3_64_intdigest(t) - (1 << 63) if t else None for t in texts]
        yield pa.RecordBatch.from_arrays(
            [table_name, row_key, source, pa.array(digests, pa.int64()), pa.array([len(t or "") for t in texts], pa.int32())]
            + [pa.array(states, pa.int32()), pa.array(keys, pa.string()), pa.array(signatures(tokens, hashes), pa.list_(pa.int64()))]
            + [pa.nulls(len(texts), pa.int64())] * 2
            + [pa.array(steps, pa.list_(pa.int64())), pa.array(asked, pa.int64()), pa.array(exact, pa.int64()), pa.array(last, pa.string())],
            schema=_ARROW,
        )
        if len(counts) + len(stands) > 200_000:
            yield flush()
    yield flush()


def ends_early(short: str, long: str) -> bool:
    """The shorter text runs along the longer one and stops where that goes on, perhaps within a word."""
    a, b = MARK.sub("", short.rstrip()).split(), long.split()
    if len(a) < SHINGLE + 1:
        return False
    own = {tuple(a[i : i + SHINGLE]) for i in range(len(a) - SHINGLE)}
    other = {tuple(b[i : i + SHINGLE]) for i in range(len(b) - SHINGLE + 1)}
    if not own or len(own & other) < SIMILARITY * len(own):
        return False
    tail, rest = a[-4:-1], a[-1]
    for j in range(len(b) - 3, -1, -1):
        if b[j : j + 3] == tail and j + 3 < len(b) and b[j + 3].startswith(rest):
            return b[j + 3] != rest or j + 4 < len(b)
    return False


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digest, short, long = (batch.column(i).to_pylist() for i in range(3))
        hit = [d for d, s, g in zip(digest, short, long, strict=True) if s and g and ends_early(s, g)]
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64())], names=["digest"])


def _going_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What texts offer beyond the prefixes asked for: hash of the words so far, the next word, whether more follow."""
    hashes = _WordHashes()
    for batch in batches:
        out: list[tuple[int, str, bool]] = []
        for text, wanted in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
            own = text.split() if text else []
            if len(own) <= STEP:
                continue
            ahead, wanted = prefixes(own, hashes).tolist(), set(wanted)
            for at in range(STEP, len(own), STEP):
                if ahead[at - 1] in wanted:
                    out += [(ahead[m - 1], own[m], m + 1 < len(own)) for m in range(at, min(at + STEP, len(own)))]
        columns = list(zip(*out, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.bool_()), strict=True)], names=["exact", "next", "more"])


def _read_again(texts: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """The texts of some rows, by their keys (distinct)."""
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    return materialize(texts.select("table_name", "row_key", "text").join(keys, ["table_name", "row_key"]), name)


def _cut_beginnings(rows: DataFrame, distinct: DataFrame, texts: DataFrame) -> DataFrame:
    """Digests of open-ended texts that stand word for word at the beginning of a longer text."""
    asking = rows.where("asked IS NOT NULL").groupBy("digest").agg(F.first("asked").alias("step"), F.first("exact").alias("exact"), F.first("last").alias("last"))
    asking = materialize(asking, "p2-asking")
    offered = distinct.select("digest", "e.table_name", "e.row_key", F.explode("e.steps").alias("step"))
    held = materialize(salted_join(offered, asking.select("step").distinct(), "step", "left_semi", "digest"), "p2-held")
    shared = held.groupBy("step").agg(F.count("*").alias("n")).where("n > 1").select("step")  # the text that asks is one
    originals = salted_join(held, shared, "step", "left_semi", "digest").groupBy("table_name", "row_key").agg(F.collect_set("step").alias("steps"))
    found = _read_again(texts, materialize(originals, "p2-originals"), "p2-original-texts")
    going_on = found.select("text", "steps").mapInArrow(_going_on, "exact long, next string, more boolean")
    going_on = materialize(going_on.groupBy("exact", "next").agg(F.max("more").alias("more")), "p2-going-on")
    both = salted_join(asking.select("digest", "exact", "last"), going_on, "exact", "inner", "digest")
    return both.where(F.startswith("next", F.col("last")) & (F.col("more") | (F.col("next") != F.col("last")))).select("digest")


def _cut_near_copies(distinct: DataFrame, texts: DataFrame) -> DataFrame:
    """Digests of texts that end before a longer near-copy does."""
    banded = distinct.where("e.bands IS NOT NULL").select(
        "digest", "e.n_chars", "e.table_name", "e.row_key", "e.state", F.explode("e.bands").alias("band")
    )
    banded = materialize(banded, "p2-bands")
    open_ended = banded.where(F.col("state") != COMPLETE).select("digest", "n_chars", "table_name", "row_key", "band")
    least = open_ended.groupBy("band").agg(F.min("n_chars").alias("least"))
    members = banded.select("band", F.col("n_chars").alias("c_chars"), F.col("table_name").alias("c_table"), F.col("row_key").alias("c_key"))
    members = salted_join(members, least, "band", "inner", "c_key").where("c_chars > least").drop("least")
    members = materialize(members, "p2-longer")
    pairs = (
        salted_join(members, open_ended, "band", "inner", "c_key")
        .where("n_chars < c_chars")
        .select("digest", "table_name", "row_key", "c_table", "c_key")
        .distinct()
    )
    pairs = materialize(pairs, "p2-pairs")
    needed = pairs.select("table_name", "row_key").union(pairs.select("c_table", "c_key")).distinct()
    found = _read_again(texts, needed, "p2-texts")
    short = pairs.join(found.withColumnRenamed("text", "short"), ["table_name", "row_key"])
    both = short.join(found.select(F.col("table_name").alias("c_table"), F.col("row_key").alias("c_key"), F.col("text").alias("long")), ["c_table", "c_key"])
    return both.select("digest", "short", "long").mapInArrow(_align, "digest long")


def _cut_copies(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Digests of texts that a longer copy or near-copy shows to be cut."""
    entry = F.struct("n_chars", "table_name", "row_key", "state", "bands", "steps")
    distinct = materialize(rows.where("bands IS NOT NULL").groupBy("digest").agg(F.max(entry).alias("e")), "p2-distinct")
    return _cut_near_copies(distinct, texts).unionByName(_cut_beginnings(rows, distinct, texts)).distinct()


def cut_texts(texts: DataFrame) -> DataFrame:
    """(table_name, row_key, source, path, question, text) -> (table_name, row_key, source, cut, found_by).

    ``found_by`` is 'alignment' where a longer near-copy shows the cut, else 'ending'; null for complete texts.
    """
    columns = ("table_name", "row_key", "source", "path", "question", "text")
    profile = materialize(spread(texts.select(*columns)).mapInArrow(_profile, _SCHEMA), "p2-profile")
    rows = profile.where("table_name IS NOT NULL")
    counts = profile.where("table_name IS NULL").groupBy("key").agg(F.sum("n_stands").alias("n_stands"), F.sum("n_closes").alias("n_closes"))
    early = _cut_copies(rows, texts).withColumn("early", F.lit(True))
    least = F.lit(1.0)
    for kind, value in LEAST_TERMINALITY.items():
        least = F.when(F.substring("key", 1, 1) == kind, F.lit(value)).otherwise(least)
    open_rows = rows.where(F.col("state") != COMPLETE).select("table_name", "row_key", "source", "digest", "state", "key")
    scored = salted_join(open_rows, counts, "key", "left", "row_key")
    scored = salted_join(scored, early, "digest", "left", "row_key")
    terminality = F.coalesce(F.col("n_closes") / F.col("n_stands"), F.lit(0.0))
    judged = scored.select(
        "table_name",
        "row_key",
        "source",
        ((F.col("state") == CUT) | F.coalesce("early", F.lit(False)) | (terminality < least)).alias("cut"),
        F.when(F.coalesce("early", F.lit(False)), "alignment").otherwise("ending").alias("found_by"),
    )
    complete = rows.where(F.col("state") == COMPLETE).select(
        "table_name", "row_key", "source", F.lit(False).alias("cut"), F.lit(None).cast("string").alias("found_by")
    )
    return judged.withColumn("found_by", F.when(F.col("cut"), F.col("found_by"))).unionByName(complete)


def cut_share(judged: DataFrame) -> DataFrame:
    """Share of cut rows per table and source."""
    return judged.groupBy("table_name", "source").agg(
        F.count("*").alias("rows"), F.count_if("cut").alias("cut_rows"), (F.count_if("cut") / F.count("*")).alias("cut_share")
    )
