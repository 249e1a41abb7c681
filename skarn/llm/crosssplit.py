"""Problem 5: the same or nearly the same records across splits.

Criterion: question and answer each share ``SAME_WORDS`` of their words (of the longer text), whatever their order.

Method: Aho-Corasick automata over sharded, normalised evaluation passages. A passage is ``PASSAGE`` successive words of
an evaluation record (question or answer), fewer in texts so short that a changed word could break every longer one. An
automaton of a shard's passages scans the training texts, in which each word is one letter; the intervals that a
training text matches are merged into a coverage of each evaluation record.

Which records meet is settled before, so that no automaton scans texts that have nothing to find in it. Each text gives a
sketch of ``BITS`` bits: a bit is the parity of the number of its words whose digest is that bit. A word that only one of
two texts holds turns one bit over, so two texts differ in at least as many words as their sketches differ in bits, and
texts of n and m words that share ``SAME_WORDS`` of their words differ in at most n + m - 2 * SAME_WORDS * max(n, m).
Pairs of sketches beyond that are passed over, and no pair that meets the criterion is lost; those that stay are compared
word by word, and the ones that meet it are scanned.

Records with the same normalised question and answer are one class; classes are compared, and members come back by a
salted join, so a third of all rows being copies costs one comparison. Every training class meets every evaluation class
of a length in reach, but as two sketches of two machine words: shards of ``shard_records`` of the one and blocks of
``block_records`` of the other, a few nanoseconds a pair. Texts move once, for the pairs that stay.

Defined results. A null or wordless question or answer is never part of a pair. Repeated ids: pairs are distinct. Split
names other than train, dev and test are ignored. Empty tables: empty result. Very long texts are compared whole.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.chars import words
from skarn.plans.shared import materialize
from skarn.plans.skew import salted_join
from skarn.plans.spread import spread

PASSAGE = 3
#: Share of equal words of question and answer each from which a pair is reported.
SAME_WORDS = 0.72
BITS = 128
SHARD_RECORDS = 100_000
BLOCK_RECORDS = 100_000
#: Letters for words start here, above the surrogates; there are a million.
_FIRST = 0xE000
_LAST = 0x10FFFF
#: In an automaton a letter is spelled as digits of this base, those of each place from an alphabet of their own, so that
#: no node has more than _BASE children and matches start and end with a letter.
_BASE, _PLACES = 32, 4


class _Bits(dict):
    """The bit of each member of a bag."""

    def __missing__(self, member: tuple[str, int] | str) -> int:
        import xxhash

        if len(self) > 1_000_000:
            self.clear()
        word = member if isinstance(member, str) else f"{member[0]}\n{member[1]}"
        value = self[member] = 1 << xxhash.xxh3_64_intdigest(word) % BITS
        return value


def sketch(words_of: Sequence[str], bits: dict) -> tuple[int, int, int]:
    """Number of words, and the parities of their bits as two signed machine words."""
    out = 0
    for member in bag(words_of):
        out ^= bits[member]
    return len(words_of), *((half ^ 1 << 63) - (1 << 63) for half in (out & (1 << 64) - 1, out >> 64))


_SKETCH = ("qn", "q0", "q1", "an", "a0", "a1")


def _normal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    bits = _Bits()
    for pdf in batches:
        texts = [[words(x) if x else [] for x in pdf[column]] for column in ("question", "answer")]
        out = pd.DataFrame({"id": pdf["id"], "side": pdf["side"]} | {c: [" ".join(t) for t in side] for c, side in zip("qa", texts, strict=True)})
        sketches = [(*sketch(q, bits), *sketch(a, bits)) for q, a in zip(*texts, strict=True)]
        yield pd.concat([out, pd.DataFrame(sketches, columns=_SKETCH, index=out.index, dtype="int64")], axis=1)


def _broken(n: int, size: int, same: float) -> int:
    """Most passages of ``size`` words that a text of n words can lose while it keeps the share ``same`` of its words."""
    return int((1 - same) * size * n + 1e-9)


def passage_size(n: int, same: float = SAME_WORDS) -> int:
    """Words of a passage in a text of n words: ``PASSAGE``, or fewer where changed words could break all of that size."""
    for size in range(PASSAGE, 1, -1):
        if n - size + 1 > _broken(n, size, same):
            return size
    return 1


def passages(text: str, size: int) -> list[str]:
    """All passages of a text whose letters are words."""
    return [text[i : i + size] for i in range(len(text) - size + 1)]


def coverage(text: str, size: int, held: set[str]) -> float:
    """Share of the letters of ``text`` inside passages of ``held``, overlapping intervals merged."""
    covered, end = 0, 0
    for i, passage in enumerate(passages(text, size)):
        if passage in held:
            covered += i + size - max(i, end)
            end = i + size
    return covered / max(1, len(text))


def bag(text: Sequence[str]) -> frozenset[tuple[str, int] | str]:
    """The words of a text, the second and later of a kind numbered, so that bags meet as sets do."""
    seen: dict[str, int] = {}
    out = set()
    for w in text:
        if w in out:
            seen[w] = k = seen.get(w, 1) + 1
            out.add((w, k))
        else:
            out.add(w)
    return frozenset(out)


def same_words(a: Sequence[str], b: Sequence[str]) -> float:
    """Share of equal words (or letters that stand for words) of two texts, whatever their order."""
    return len(bag(a) & bag(b)) / max(1, len(a), len(b))


class _Letters:
    """One letter a word. Words beyond the last letter share it: nothing is lost by that, and pairs found are then
    compared by their words."""

    def __init__(self):
        self.known: dict[str, str] = {}
        self.spelling: dict[int, str] = {ord("\n"): "\n"}

    def _add(self, word: str) -> None:
        n = min(_LAST - _FIRST, len(self.known))
        self.known[word] = chr(_FIRST + n)
        self.spelling[_FIRST + n] = "".join(chr(0x100 + place * _BASE + (n // _BASE**place) % _BASE) for place in range(_PLACES))

    def __call__(self, text: str) -> str:
        known = self.known
        for w in text.split(" "):
            if w not in known:
                self._add(w)
        return "".join([known[w] for w in text.split(" ")])


class Shard:
    """The passages of evaluation records in one automaton."""

    def __init__(self, records: list[tuple[str, str]], same: float = SAME_WORDS):
        import ahocorasick

        self.letters, self.same, self.texts = _Letters(), same, records
        self.records = [(self.letters(q), self.letters(a)) for q, a in records]
        self.sizes = [(passage_size(len(q), same), passage_size(len(a), same)) for q, a in self.records]
        self.automaton = ahocorasick.Automaton()
        for texts, sizes in zip(self.records, self.sizes, strict=True):
            for text, size in zip(texts, sizes, strict=True):
                for passage in passages(text, size):
                    self.automaton.add_word(passage.translate(self.letters.spelling), passage)
        if self.records:
            self.automaton.make_automaton()

    def held(self, text: str) -> set[str]:
        """The shard's passages that a text holds."""
        known = self.letters.known.get
        letters = "".join([known(w, "\n") for w in text.split(" ")])
        return {passage for _, passage in self.automaton.iter(letters.translate(self.letters.spelling))}

    def coverages(self, n: int, held_q: set[str], held_a: set[str]) -> tuple[float, float]:
        """Shares of record n's question and answer inside passages that a training record holds."""
        return tuple(coverage(text, size, held) for text, size, held in zip(self.records[n], self.sizes[n], (held_q, held_a), strict=True))

    def matches(self, q: str, a: str) -> list[tuple[int, float, float, float, float]]:
        """(record, question coverage, answer coverage, equal words of each) for the records that the pair repeats."""
        found = [(n, alike) for n, theirs in enumerate(self.texts) if (alike := alike_pair((q, a), theirs, self.same))]
        held = (self.held(q), self.held(a)) if found else ()
        return [(n, *self.coverages(n, *held), *alike) for n, alike in found]


def alike_pair(one: tuple[str, str], other: tuple[str, str], same: float) -> tuple[float, float] | None:
    """Equal words of questions and of answers, where both reach ``same``."""
    out = []
    for x, y in zip(one, other, strict=True):
        share = same_words(x.split(" "), y.split(" "))
        if share < same:
            return None
        out.append(share)
    return tuple(out)


def _differing(n: int, others: np.ndarray, same: float) -> np.ndarray:
    """Most words by which a text of n words and each of others differ if they share ``same`` of the longer one's;
    negative where lengths alone rule that out."""
    return n + others - 2 * np.ceil(same * np.maximum(n, others) - 1e-6).astype(np.int64)


def near_sketches(train: np.ndarray, evaluation: np.ndarray, same: float = SAME_WORDS) -> Iterator[tuple[int, np.ndarray]]:
    """(training row, evaluation rows) whose sketches differ in no more bits than words may; columns as ``_SKETCH``."""
    order = np.argsort(evaluation[:, 0], kind="stable")
    lengths, answers = evaluation[order, 0], evaluation[order, 3]
    q0, q1, a0, a1 = (np.ascontiguousarray(evaluation[order, k]).view(np.uint64) for k in (1, 2, 4, 5))
    ordered, reach = lengths.tolist(), {}
    for row, (qn, an) in enumerate(train[:, [0, 3]].tolist()):
        if qn not in reach:
            lo, hi = bisect_left(ordered, ceil(same * qn - 1e-6)), bisect_right(ordered, int(qn / same + 1e-6))
            reach[qn] = lo, hi, np.minimum(_differing(qn, lengths[lo:hi], same), 255).astype(np.uint8)
        lo, hi, most = reach[qn]
        b0, b1, c0, c1 = train[row, [1, 2, 4, 5]].view(np.uint64)
        apart = np.bitwise_count(q0[lo:hi] ^ b0)
        apart += np.bitwise_count(q1[lo:hi] ^ b1)
        at = np.flatnonzero(apart <= most) + lo
        if len(at):
            apart = np.bitwise_count(a0[at] ^ c0) + np.bitwise_count(a1[at] ^ c1)
            at = at[apart <= _differing(an, answers[at], same)]
            if len(at):
                yield row, order[at]


def _near(same: float):
    def run(key, train: pd.DataFrame, evaluation: pd.DataFrame) -> pd.DataFrame:
        ours, theirs = [], []
        if len(train) and len(evaluation):
            sketches = [np.ascontiguousarray(side[list(_SKETCH)].to_numpy(dtype=np.int64)) for side in (train, evaluation)]
            for row, rows in near_sketches(*sketches, same):
                ours.append(np.full(len(rows), row))
                theirs.append(rows)
        pick = [side["class"].to_numpy()[np.concatenate(at)] if at else [] for side, at in ((train, ours), (evaluation, theirs))]
        return pd.DataFrame({"train_class": pick[0], "eval_class": pick[1]})

    return run


def _compare(same: float):
    names = ["train_class", "eval_class", "question_coverage", "answer_coverage", "question_same", "answer_same"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ours, theirs = (list(zip(pdf[q], pdf[a], strict=True)) for q, a in (("tq", "ta"), ("eq", "ea")))
            alike = [alike_pair(x, y, same) for x, y in zip(ours, theirs, strict=True)]
            number: dict[tuple[str, str], int] = {}
            for pair, both in zip(theirs, alike, strict=True):
                if both:
                    number.setdefault(pair, len(number))
            shard, out = Shard(list(number), same), []
            for k, both in enumerate(alike):
                if both:
                    held = (shard.held(text) for text in ours[k])
                    out.append((pdf["train_class"].iat[k], pdf["eval_class"].iat[k], *shard.coverages(number[theirs[k]], *held), *both))
            yield pd.DataFrame(out, columns=names)

    return run


def cross_split_overlaps(
    rows: DataFrame,
    id_col: str = "id",
    split: str = "split",
    question: str = "question",
    answer: str = "expected_answer",
    min_same: float = SAME_WORDS,
    shard_records: int = SHARD_RECORDS,
    block_records: int = BLOCK_RECORDS,
) -> DataFrame:
    """Pairs (train_id, eval_id, question_coverage, answer_coverage, question_same, answer_same)."""
    side = F.when(F.col(split) == "train", "train").when(F.col(split).isin("dev", "test"), "eval")
    chosen = rows.select(F.col(id_col).cast("string").alias("id"), side.alias("side"), F.col(question).alias("question"), F.col(answer).alias("answer"))
    sketched = ", ".join(f"{c} long" for c in _SKETCH)
    normal = spread(chosen.where("id IS NOT NULL AND side IS NOT NULL")).mapInPandas(_normal, f"id string, side string, q string, a string, {sketched}")
    normal = materialize(normal.where("q <> '' AND a <> ''").withColumn("class", F.unhex(F.md5(F.concat_ws("\n", "q", "a")))), "p5-normal")
    classes = materialize(normal.drop("id").dropDuplicates(["class", "side"]), "p5-classes")
    sizes = {r.side: r.n for r in classes.groupBy("side").agg(F.count("*").alias("n")).collect()}  # two rows
    shards = max(1, -(-sizes.get("eval", 0) // shard_records))
    blocks = max(2 * rows.sparkSession.sparkContext.defaultParallelism // shards, -(-sizes.get("train", 0) // block_records), 1)
    digest = F.xxhash64("class")
    left = classes.where("side = 'train'").select(
        "class", *_SKETCH, F.pmod(digest, F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    )
    right = classes.where("side = 'eval'").select(
        "class", *_SKETCH, F.pmod(digest, F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    )
    tasks = shards * blocks
    left, right = (side.repartition(tasks, "shard", "block") for side in (left, right))
    near = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(_near(min_same), "train_class binary, eval_class binary")
    near = materialize(near, "p5-near")
    texts = [
        classes.where(f"side = '{side}'").select(F.col("class").alias(f"{side}_class"), F.col("q").alias(f"{side[0]}q"), F.col("a").alias(f"{side[0]}a"))
        for side in ("train", "eval")
    ]
    schema = "train_class binary, eval_class binary, question_coverage double, answer_coverage double, question_same double, answer_same double"
    found = near.join(texts[0], "train_class").join(texts[1], "eval_class").select("train_class", "eval_class", "tq", "ta", "eq", "ea")
    found = materialize(found.mapInPandas(_compare(min_same), schema), "p5-found")
    members = normal.select("id", "side", "class")
    trains = members.where("side = 'train'").select(F.col("id").alias("train_id"), F.col("class").alias("train_class"))
    evals = members.where("side = 'eval'").select(F.col("id").alias("eval_id"), F.col("class").alias("eval_class"))
    with_train = salted_join(trains, found, "train_class", "inner", "train_id")
    pairs = salted_join(evals, with_train, "eval_class", "inner", "eval_id")
    return pairs.where("train_id <> eval_id").dropDuplicates(["train_id", "eval_id"]).drop("train_class", "eval_class")


def overlap_report(pairs: DataFrame, rows: DataFrame, id_col: str = "id", split: str = "split", source: str = "source") -> DataFrame:
    """Evaluation records that overlap with training, and pairs, per split and source."""
    about = rows.select(F.col(id_col).alias("eval_id"), F.col(split).alias("split"), F.col(source).alias("source")).where("split <> 'train'")
    total = about.groupBy("split", "source").agg(F.countDistinct("eval_id").alias("records"))
    hit = pairs.join(about.distinct(), "eval_id").groupBy("split", "source").agg(
        F.countDistinct("eval_id").alias("overlapping"), F.count("*").alias("pairs")
    )
    return (
        total.alias("t")
        .join(hit.alias("h"), F.expr("t.split <=> h.split AND t.source <=> h.source"), "left")
        .select("t.split", "t.source", "records", F.coalesce("overlapping", F.lit(0)).alias("overlapping"), F.coalesce("pairs", F.lit(0)).alias("pairs"))
    )
