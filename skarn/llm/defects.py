"""Problem 4: broken prompt and response pairs.

Method: a multi-label linear classifier on hashed n-grams and pair features. It is fitted on three quarters of all
pairs, in chunks whose weights are averaged: each as it is if nothing speaks against it, and truncated, replaced by a copy
of its question, swapped with an answer in another language, respelled as if in a language or script that no sampled text
has, replaced by a refusal, or emptied. Thresholds are calibrated on the synthetic pairs of the last quarter: each is
where missed defects, and wrongly named pairs at ``COST`` times their share, are fewest. The label of a row is the classifier's: of the defects whose score is over their
threshold the one that is furthest over it, in units of the spread of its held-out scores. Word lists and end patterns
are features among others and decide nothing by themselves.

Language is told by character three-grams: the fitted texts give a profile of each language in them, an answer is scored
under the profile of its question's language, and its letters are compared with the question's script, so answers in
languages and scripts of no list are seen. Refusals are told by their words and by what they lack: words of the trade,
as the fitted answers have them, calls, paths, figures.

The model, some ten thousand weights, goes to the tasks with the function. Answers without another defect whose end is in
doubt (a bare call, a closing quotation) are settled by closing-word counts over all answers, as for cut texts.

Defined results. Null, blank, invisible and stand-in answers: 'empty', whatever the question. A null question: only
'empty', 'refusal' and 'truncated' are possible. Repeated rows: each listed. Empty table: empty result, no model.
"""

from __future__ import annotations

import gc
import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.chars import plain, points, words
from skarn.llm.endings import CUT, DOUBT, closes, closing_counts, ending, is_copy, stands_for_nothing
from skarn.llm.language import NONE, WEIGHTS, language_scores, letters
from skarn.llm.truncation import LEAST_TERMINALITY
from skarn.plans.shared import materialize
from skarn.plans.skew import salted_join
from skarn.plans.spread import spread

LABELS = ("empty", "truncated", "refusal", "copied_question", "other_language")
PAIR_LABELS = [3, 4]
DIMENSIONS = 1 << 13
#: Rows whose examples are fitted at once.
CHUNK_ROWS = 4_000
#: A threshold may miss this share of the held-out synthetic defects to spare one share of the other pairs.
COST = 10.0
#: Penalty of the squared weights of the pair features.
RIDGE = 0.3
#: Slots of the character three-grams, and most words of the trade that are kept.
GRAMS = 1 << 14
VOCABULARY = 20_000
SEED = 11

#: How a refusal opens, what it says, how it goes on.
OPENERS = ("", "I'm sorry, but ", "Sorry, ", "I apologize, but ", "Unfortunately, ", "I regret that ", "As an AI model, ", "My apologies - ")
CORES = (
    "I can't help with that request", "I cannot assist with this", "I am unable to answer this question", "I'm not able to give advice on this",
    "I must decline to answer", "I do not have enough information to answer", "I don't know the answer", "I won't be able to share that",
    "I have to refuse this request", "I'd rather not speculate on this", "this is outside of what I may discuss", "there is nothing I can say about that",
    "I am not allowed to discuss this", "I can not comment on that", "I have no answer to this", "I would prefer not to answer",
    "let us leave this one aside", "that is not something I get into", "you would be better off asking someone else", "no comment from me on this matter",
    "answering this is against my rules", "this question will have to stay open", "the assistant does not respond to such requests", "I will skip this one",
    "I keep out of that", "my instructions forbid a reply", "it is not for me to say", "such matters are off limits here",
)
TAILS = ("", " Please contact your support desk.", " Is there anything else I can do for you?", " You may want to ask the vendor instead.", " Please consult the manual.")
LABELS_BEFORE = ("", "Q: ", "Question: ", "You asked: ", "> ")

#: Phrases by which a text declines, in the languages of the data.
DECLINES = re.compile(
    r"\b(?:(?:can(?:no|')t|can not|could not|am unable to|(?:am |'m )?not able to|(?:wo|would)n['’]?t be able to|will not be able to|"
    r"(?:am |'m )?not allowed to|(?:must|have to) (?:decline|refuse)|decline to|refuse (?:this|to)|(?:['’]d|would) (?:rather|prefer) not(?: to)?)"
    r"(?: (?:help|assist|answer|give|provide|share|comment|discuss|speculate|respond|do|say|offer|advise|support|fulfil|fulfill|comply|disclose|reveal|this|that))"
    r"|(?:must|have to|need to) (?:decline|refuse)|(?:['’]d|would) (?:rather|prefer) not|outside (?:of )?(?:what|my|the scope)|beyond (?:what|my|the scope)"
    r"|nothing i (?:can|could|may) (?:say|add|tell)|(?:do not|don['’]t) (?:have (?:enough |the |any )?(?:information|answer|context|data)|know(?: the answer)?)"
    r"|no (?:answer|information|comment) (?:on|to|about|for)|kann (?:ich )?(?:leider )?(?:nicht|keine)|je ne (?:peux|suis|sais)|no puedo|lo siento|désolé)",
    re.I,
)
#: What only an answer holds: a call, a setting, a path, code, a step.
ANSWERS = re.compile(r"`|/v\d+/|\b(?:GET|POST|PUT|PATCH|DELETE) /|\b(?:Setup|Tools) / |^\s*\d+[.)] |[a-z]+[A-Z]\w+|\bmeans that\b|\bbecause the\b", re.M)
LABEL = re.compile(r"^\W*(?:q|question|you asked|your question|asked|frage|pregunta|demande)\s*[:\-]\s*|\s*\W*\b(?:a|answer|antwort|respuesta|réponse)\s*:\s*$", re.I)
_LABEL_BEFORE = re.compile(LABEL.pattern.partition("|\\s*")[0], re.I)
#: One of these stands, in lower case, in every text that ``DECLINES`` matches.
_DECLINING = (
    "cannot", "can't", "can not", "could not", "able to", "not allowed to", "decline", "refuse", "rather not", "prefer not", "outside", "beyond", "nothing i ", "do not ", "don't ", "don’t ",
    "no answer", "no information", "no comment", "kann ", "je ne ", "no puedo", "lo siento", "désolé",
)
#: Letters that count as another letter's other case without being turned into it by ``lower``.
_ODD_CASE = re.compile("[ſıİ]")


_FIGURE = re.compile(r"\d")
_CODE_PARTS = re.compile(r"(`[^`\n]*`|\S*[/{}=]\S*)")


def _index(token: str) -> int:
    return zlib.crc32(token.encode()) % DIMENSIONS


#: Texts whose endings and letters are kept: the examples of a chunk, which are made and then read.
KEPT = 1 << 15
_ending = lru_cache(KEPT)(ending)


@lru_cache(KEPT)
def _spelled(text: str) -> str:
    """The lower-case letters outside code, paths and quotations; one space between words."""
    apart = letters(text)
    inside = " ".join(apart.split())
    return (apart[0] == " ") * " " + inside + (apart[-1] == " ") * " " if inside else apart[:1]


@lru_cache(KEPT)
def _told(text: str) -> tuple[int, list[float]]:
    """Number of words outside code, and the shares of function words by language."""
    tokens = _spelled(text).split()
    return len(tokens), language_scores(tokens)


def _uncollected(f: Callable) -> Callable:
    """Without a search for cycles while it runs: the many small lists and counts of a batch hold none."""

    @wraps(f)
    def run(*args, **named):
        on = gc.isenabled()
        gc.disable()
        try:
            return f(*args, **named)
        finally:
            if on:
                gc.enable()

    return run


def _declines(text: str) -> bool:
    lower = text.lower()
    return (any(map(lower.__contains__, _DECLINING)) or _ODD_CASE.search(text) is not None) and DECLINES.search(text) is not None


def _answers(text: str) -> bool:
    return "`" in text or ANSWERS.search(text) is not None


def _unlabelled(text: str) -> str:
    """The text without the labels before and after it."""
    return LABEL.sub("", text) if text.rstrip().endswith(":") else _LABEL_BEFORE.sub("", text)


def _grams(of: np.ndarray) -> np.ndarray:
    wide = of.astype(np.uint64)
    mixed = (wide[:-2] * np.uint64(0x9E3779B1) + wide[1:-1] * np.uint64(0x85EBCA77) + wide[2:]) * np.uint64(0xC2B2AE3D)
    return ((mixed >> np.uint64(13)) & np.uint64(GRAMS - 1)).astype(np.int64)


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The three-grams of texts of three letters or more, end to end; where each text starts; the places over an end."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    return _grams(points("".join(texts))), starts, (starts[1:, None] - np.array([2, 1])).ravel()


def _script(of: np.ndarray) -> np.ndarray:
    """A number for the script of each letter; Latin is 0."""
    latin = (of < 0x250) | ((of >= 0x1E00) & (of < 0x1F00))
    return np.where(latin, 0, of >> 8)


class Profiles:
    """Character three-grams by language: log probabilities, and mean and spread of a text's mean log probability."""

    LEAST = 20

    def __init__(self, texts: list[str]):
        kept: dict[int, list[str]] = {}
        for text in texts:
            if (own := self.letters(text)) is not None:
                kept.setdefault(own[0], []).append(own[1])
        self.count({k: self.grams(v) for k, v in kept.items()}, {k: len(v) for k, v in kept.items()})
        own = [self.usual(kept[k], n) for n, k in enumerate(self.known)]
        self.measure([x.mean() for x in own], [x.std() for x in own])

    @classmethod
    def letters(cls, text: str) -> tuple[int, str] | None:
        """Language by function words, and the letters, of a text that is long enough and of a language at all."""
        scores, spelled = _told(text)[1], _spelled(text)
        return None if len(spelled) < cls.LEAST or max(scores) < 0.08 else (scores.index(max(scores)), spelled)

    @staticmethod
    def grams(spelled: list[str], times: np.ndarray | None = None) -> np.ndarray:
        """How often each three-gram stands in the texts, each counted ``times``."""
        grams, starts, across = _joined(spelled)
        ends = np.append(starts[1:], len(grams) + 2)
        weights = np.repeat(np.ones(len(spelled)) if times is None else times.astype(np.float64), ends - starts)[: len(grams)]
        weights[across] = 0
        return np.bincount(grams, weights, GRAMS)

    def usual(self, spelled: list[str], place: int) -> np.ndarray:
        """The mean log probability of each text's three-grams in one language."""
        grams, starts, across = _joined(spelled)
        scores = self.logs[:, place].astype(np.float64)[grams]
        scores[across] = 0
        return np.add.reduceat(scores, starts) / np.array([len(t) - 2 for t in spelled])

    def count(self, counts: dict[int, np.ndarray], texts: dict[int, int]) -> None:
        self.known = [k for k in sorted(counts) if texts[k] >= 8]
        self.logs = np.stack([np.log((counts[k] + 0.3) / (counts[k].sum() + 0.3 * GRAMS)) for k in self.known], axis=1).astype(np.float32) if self.known else np.zeros((GRAMS, 0), np.float32)

    def measure(self, means: list[float], spreads: list[float]) -> None:
        self.mean = np.array(means, dtype=np.float32)
        self.spread = np.array([max(0.05, x) for x in spreads], dtype=np.float32)

    def standing(self, texts: list[str]) -> np.ndarray:
        """How usual each text's letters are in each language, in spreads from the mean; NaN for too short a text."""
        out = np.full((len(texts), len(self.known)), np.nan, dtype=np.float32)
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        keep = np.nonzero(lengths >= self.LEAST)[0]
        if not len(keep) or not self.known:
            return out
        grams, starts, across = _joined([texts[k] for k in keep])
        scores = self.logs[grams]
        scores[across] = 0
        out[keep] = (np.add.reduceat(scores, starts, axis=0) / (lengths[keep, None] - 2) - self.mean) / self.spread
        return out


def trade_words(texts: list[str], most: int = VOCABULARY) -> frozenset[str]:
    """Words of three or more of the texts that are no function words."""
    counts = Counter(w for t in texts for w in set(words(t)))
    return frozenset(w for w, n in counts.most_common(most) if n > 2 and w not in WEIGHTS)


class _Numbers(dict):
    """Numbers of words as they come; with each its hash slot, its weights by language and whether it is of the trade."""

    def __init__(self, trade: frozenset[str]):
        super().__init__()
        self.trade = trade
        self.slots: list[int] = []
        self.weights: list[tuple[float, ...]] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self.slots)
        self.slots.append(_index(word))
        self.weights.append((*WEIGHTS.get(word, NONE), float(word in self.trade)))
        return n


class Features:
    """Hashed one- and two-grams of the whole answer, and pair features, of a batch of pairs.

    Words are numbered as they come; their hash slots and weights are rows of growing tables, so n-grams, language and
    trade shares of a batch are array operations. Questions recur, so what is taken from them is kept.
    """

    NAMES = ("bias", "nothing", "short", "log_length", "answer_in_question", "question_in_answer", "alike", "copied", "cut", "answers") + (
        "declines_only", "trade", "says_nothing", "first_person", "language_apart", "usual", "unusual", "very_unusual", "elsewhere", "other_script",
    )
    MOST = 300_000

    def __init__(self, profiles: Profiles, trade: frozenset[str]):
        self.profiles, self.trade = profiles, trade
        self.numbers = _Numbers(trade)
        self.questions: dict[str, tuple] = {}

    def _ask(self, questions: list[str | None]) -> None:
        """Take from new questions: words, language by function words, place of the language among the profiles or -1,
        script, number of words."""
        if len(self.questions) > self.MOST // 10:
            self.questions.clear()
        fresh = [q for q in dict.fromkeys(questions) if q and q not in self.questions]
        texts = [plain(q) for q in fresh]
        spelled = [_spelled(q) for q in texts]
        for question, text, letters, standing in zip(fresh, texts, spelled, self.profiles.standing(spelled), strict=True):
            tokens = words(text)
            scores = language_scores(tokens)
            best = int(standing.argmax()) if len(standing) and standing.max() > -6 else -1
            script = 0
            if not letters.isascii():
                of = points(letters)
                of = of[of > 0x40]
                script = int(np.bincount(_script(of)).argmax()) if len(of) else 0
            self.questions[question] = (Counter(tokens), scores.index(max(scores)), best, script, len(tokens))

    def _languages(self, spelled: list[str], asked: list[tuple | None], shares: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The language features of a batch, 0 where a question or enough of an answer is missing."""
        out = np.zeros((len(spelled), 6), dtype=np.float32)
        rows = np.nonzero([a is not None for a in asked])[0]
        if not len(rows):
            return out
        by_words, best, script = (np.array([asked[r][k] for r in rows]) for k in (1, 2, 3))
        own = shares[rows].max(axis=1)
        out[rows, 0] = (own > 0.05) & (shares[rows, by_words] < 0.6 * own) & (sizes[rows] > 3)
        texts = [spelled[r] for r in rows]
        places: dict[str, int] = {}
        at = [places.setdefault(t, len(places)) for t in texts]
        standing = self.profiles.standing(list(places))[at]
        if standing.shape[1]:
            mine = np.where(best >= 0, standing[np.arange(len(rows)), np.maximum(best, 0)], np.nan)
            known = ~np.isnan(mine)
            mine = np.where(known, mine, 0.0)
            out[rows, 1] = known * np.clip(mine, -6, 3) / 3
            out[rows, 2], out[rows, 3] = known & (mine < -4), known & (mine < -8)
            out[rows, 0] *= ~known | (np.nan_to_num(standing).argmax(axis=1) != best)
            out[rows, 4] = known * np.clip((np.nan_to_num(standing.max(axis=1)) - mine) / 6, 0, 3)
        # letters in all, and those of another script; ASCII letters are all Latin
        total = np.array([len(t) - t.count(" ") for t in texts])
        other = np.where(script != 0, total, 0)
        wide = np.array([k for k, t in enumerate(texts) if not t.isascii()], dtype=np.int64)
        of = points("".join([texts[k] for k in wide]))
        owner = np.repeat(wide, np.array([len(texts[k]) for k in wide], dtype=np.int64))
        letter = of > 0x40
        total[wide] = np.bincount(owner[letter], minlength=len(rows))[wide]
        other[wide] = np.bincount(owner[letter & (_script(of) != script[owner])], minlength=len(rows))[wide]
        out[rows, 5] = np.where(total > 3, other / np.maximum(1, total), 0)
        return out

    def _read(self, answer: str | None) -> tuple:
        """What an answer is by itself, whatever the question: plain text, numbers and counts of its words, ending,
        whether it is nothing, size, whether it solves, declines, is specific, speaks of itself."""
        a = plain(answer or "")
        tokens = words(a)
        held = Counter(tokens)
        solves = _answers(a)
        return (
            a, list(map(self.numbers.__getitem__, tokens)), held, _ending(a), len(tokens) < 4 and stands_for_nothing(a), math.log1p(len(a)) / 8, solves,
            not solves and _declines(a), solves or _FIGURE.search(a) is not None, not solves and ("i" in held or "my" in held or "me" in held),
        )

    @_uncollected
    def __call__(self, questions: list[str | None], answers: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, str]]]:
        if len(self.numbers) > self.MOST:
            self.numbers = _Numbers(self.trade)
        flat, lengths, dense, ends = [], [], np.zeros((len(answers), len(self.NAMES)), dtype=np.float32), []
        self._ask(questions)
        asked, spelled, specific, rows, first = [], [], [], [], []
        times, known = Counter(answers), {}
        for q, a in zip(questions, answers, strict=True):
            if (read := known.get(a)) is None:
                read = self._read(a)
                if times[a] > 1:
                    known[a] = read
            a, numbers, held, state, nothing, logs, solves, declines, figure, person = read
            flat += numbers
            size = len(numbers)
            lengths.append(size)
            ends.append(state)
            about = self.questions[q] if q else None
            asked.append(about)
            common = theirs = 0
            if about:
                theirs, theirs_by = about[4], about[0]
                common = sum([min(c, theirs_by[w]) for w, c in held.items() if w in theirs_by])
                spelled.append(_spelled(a))
            else:
                spelled.append("")
            copied = about is not None and size > 3 and 2 * common >= theirs and is_copy(_unlabelled(a), q)
            specific.append(figure or common >= 0.5 * size or size < 5)
            rows.append(
                (1.0, nothing, size < 5, logs, common / max(1, size), common / max(1, theirs), common / max(1, size, theirs), copied, state[0] == CUT, solves, declines)
            )
            first.append(person)
        if rows:
            dense[:, :11], dense[:, 13] = rows, first
        numbers, sizes = np.array(flat, dtype=np.int64), np.array(lengths, dtype=np.int64)
        shares = np.zeros((len(sizes), len(NONE) + 1), dtype=np.float32)
        full = np.nonzero(sizes)[0]
        if len(full):
            starts = np.cumsum(sizes[full]) - sizes[full]
            shares[full] = np.add.reduceat(np.array(self.numbers.weights, dtype=np.float32)[numbers], starts, axis=0) / sizes[full, None]
        dense[:, 11] = shares[:, -1]
        dense[:, 12] = ~np.array(specific, dtype=bool) & (shares[:, -1] < 0.25)
        dense[:, 14:] = self._languages(spelled, asked, shares[:, :-1], sizes)
        slots = np.array(self.numbers.slots, dtype=np.int64)[numbers] if len(numbers) else numbers
        owner = np.repeat(np.arange(len(sizes)), sizes)
        inside = owner[1:] == owner[:-1]
        pairs = ((slots[:-1] * 31 + slots[1:]) % DIMENSIONS)[inside]
        order = np.argsort(np.concatenate([owner, owner[1:][inside]]), kind="stable")
        return np.concatenate([slots, pairs])[order], np.maximum(2 * sizes - 1, 0), dense, ends


def _language_features(q: str, a: str) -> list[float]:
    n, sa = _told(a)
    if not q or n < 4:
        return [0.0, 0.0, 0.0]
    sq = _told(q)[1]
    own, asked = max(sa), sa[sq.index(max(sq))]
    return [own > 0.08 and asked < 0.6 * own, own, asked]


class Model:
    """One logistic score a label: hashed weights (scaled by the root of the number of n-grams) and dense weights."""

    def __init__(self, profiles: Profiles, trade: frozenset[str]):
        self.profiles, self.trade = profiles, trade
        self.hashed = np.zeros((DIMENSIONS, len(LABELS)), dtype=np.float32)
        self.dense = np.zeros((len(Features.NAMES), len(LABELS)), dtype=np.float32)
        self.thresholds = np.zeros(len(LABELS), dtype=np.float32)
        self.spreads = np.ones(len(LABELS), dtype=np.float32)

    def labels(self, scores: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """The number of each row's label, -1 where no score is over its threshold. Without a question (``asked`` false)
        an answer can be neither a copy of it nor in another language."""
        over = (scores - self.thresholds) / self.spreads
        over[np.ix_(~asked, PAIR_LABELS)] = -np.inf
        return np.where(over.max(axis=1) >= 0, over.argmax(axis=1), -1)

    def scores(self, flat: np.ndarray, sizes: np.ndarray, dense: np.ndarray) -> np.ndarray:
        out = dense @ self.dense
        full = np.nonzero(sizes)[0]
        if len(full):
            starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
            sums = np.add.reduceat(self.hashed[flat], starts, axis=0)
            out[full] += sums / np.sqrt(sizes[full])[:, None]
        return out

    def fit(self, flat: np.ndarray, sizes: np.ndarray, dense: np.ndarray, target: np.ndarray, epochs: int = 3, batch: int = 512, rate: float = 0.03) -> None:
        """The logistic loss of every label: Newton steps for the pair features, then AdaGrad for the n-grams on top."""
        x = dense.astype(np.float64)
        for k in range(len(LABELS)):
            w = np.zeros(x.shape[1])
            for _ in range(25):
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w)), x.T @ (target[:, k] - p) - RIDGE * w)
                w += step
                if np.abs(step).max() < 1e-4:
                    break
            self.dense[:, k] = w
        rng = np.random.default_rng(SEED)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        gathered = np.full_like(self.hashed, 1e-2)
        for _ in range(epochs):
            order = rng.permutation(len(sizes))
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                ids, n = np.concatenate([flat[starts[r] : starts[r + 1]] for r in rows]), sizes[rows]
                p = 1 / (1 + np.exp(-np.clip(self.scores(ids, n, dense[rows]), -30, 30)))
                error = (p - target[rows]) / len(rows)
                per = error / np.sqrt(np.maximum(n, 1))[:, None]
                step = np.stack([np.bincount(ids, np.repeat(per[:, k], n), DIMENSIONS) for k in range(len(LABELS))], axis=1)
                gathered += step**2
                self.hashed -= rate * step / np.sqrt(gathered)


#: Letters by which those of Latin are replaced to make texts in a script that no sampled text may have.
_LATIN = "abcdefghijklmnopqrstuvwxyz"
_ALPHABETS = tuple(str.maketrans(_LATIN + _LATIN.upper(), 2 * "".join(chr(first + k) for k in range(26))) for first in (0x430, 0x3B1, 0x5D0, 0x3042, 0x4E10, 0xAC00))


def respelled(text: str, rng: random.Random) -> str:
    """The text in letters of another script, or with its letters exchanged and accented, as of an unknown language."""
    kind = rng.randrange(len(_ALPHABETS) + 3)
    if kind < len(_ALPHABETS):
        other = _ALPHABETS[kind]
    else:
        vowels, rest = list("aeiouyáéíóúýěů"), list("bcdfghjklmnpqrstvwxzčďňřšťž")
        rng.shuffle(vowels)
        rng.shuffle(rest)
        at = {c: (vowels if c in "aeiouy" else rest).pop() for c in _LATIN}
        other = str.maketrans(_LATIN + _LATIN.upper(), 2 * "".join(at[c] for c in _LATIN))
    return "".join([part if k % 2 else part.translate(other) for k, part in enumerate(_CODE_PARTS.split(text))])


@_uncollected
def synthetic(pairs: list[tuple[str, str]], seed: int = SEED) -> tuple[list[str], list[str], np.ndarray]:
    """Labelled pairs made from sampled ones: each as it is if nothing speaks against it, and once for each defect."""
    rng = random.Random(seed)
    languages = []
    for q, a in pairs:
        sq, sa = _told(q)[1], _told(a)[1]
        languages.append((sq.index(max(sq)), sa.index(max(sa))))
    by_language: dict[int, list[str]] = {}
    clean = []
    for (q, a), (lq, la) in zip(pairs, languages, strict=True):
        if _ending(a)[0] != CUT and len(a) > 60:
            by_language.setdefault(la, []).append(a)
        apart = _language_features(q, a)[0]
        good = _ending(a)[0] != CUT and not is_copy(_unlabelled(a), q) and not stands_for_nothing(a) and not apart
        clean.append(good and (_answers(a) or not _declines(a)))
    common = Counter(lq for lq, _ in languages).most_common(1)[0][0] if languages else -1
    questions, answers, labels = [], [], []

    def add(q: str, a: str, *names: str) -> None:
        questions.append(q)
        answers.append(a)
        labels.append([float(label in names) for label in LABELS])

    for (q, a), (lq, _), good in zip(pairs, languages, clean, strict=True):
        if not good:
            continue
        add(q, a)
        if rng.random() < 0.2:  # without a question
            add("", a)
        if rng.random() < 0.2:  # repeats the question, or apologises, and then answers
            add(q, rng.choice([q + " " + a, "I am sorry for the trouble. " + a, "Sorry for the wait. " + a]))
        if len(a) > 40:
            at = rng.randrange(20, len(a) - 1)
            cut = a[:at] + rng.choice(["", "", "", "", "...", " ...", "…"])
            if _ending(cut)[0] == CUT:
                add(q, cut, "truncated")
        kind = rng.randrange(4)
        copy = (q, q.lower(), re.sub(r"[^\w\s]", "", q), " ".join(w for w in q.split() if rng.random() > 0.05))[kind]
        add(q, rng.choice(LABELS_BEFORE) + copy + rng.choice(["", "", "\nA:", "\n" + copy]), "copied_question")
        foreign = [x for x in by_language if x != lq and len(by_language[x]) > 3]
        # a rare language of questions meets several of answers, so that its neighbours are among them
        for language in rng.sample(foreign, min(len(foreign), 1 if lq == common else 6)):
            swapped = rng.choice(by_language[language])
            if _language_features(q, swapped)[0]:
                add(q, swapped, "other_language")
        if len(a) > 40:
            add(q, respelled(a, rng), "other_language")
        core = rng.choice(CORES)
        opener = rng.choice(OPENERS)
        add(q, (opener + core if opener else core[0].upper() + core[1:]) + "." + rng.choice(TAILS), "refusal")
        if rng.random() < 0.3:
            add(q, rng.choice(["", " ", "-", "N/A", "none", "null", "...", "{}", "[no response]", "​"]), "empty")
    return questions, answers, np.array(labels, dtype=np.float32).reshape(-1, len(LABELS))


def threshold(own: np.ndarray, other: np.ndarray, cost: float = COST) -> float:
    """The middle between two neighbouring scores with the least cost; both arrays sorted."""
    places = np.unique(np.concatenate([own, other[other > own[0]]]))
    missed = np.searchsorted(own, places, "left") / len(own)
    wrong = (len(other) - np.searchsorted(other, places, "left")) / max(1, len(other))
    best = places[np.argmin(missed + cost * wrong)]
    below = np.concatenate([own[own < best], other[other < best]])
    return float((best + below.max()) / 2) if len(below) else float(best) - 1.0


def train(pairs: list[tuple[str, str]], held_out: float = 0.25) -> Model:
    """Fit on three quarters of the sampled pairs, calibrate the thresholds on the rest."""
    cut = int(len(pairs) * (1 - held_out))
    answers = [plain(a) for _, a in pairs[:cut]]
    model = Model(Profiles(answers + [plain(q) for q, _ in pairs[:cut]]), trade_words(answers))
    q, a, y = synthetic(pairs[:cut])
    if len(q):
        flat, sizes, dense, _ = Features(model.profiles, model.trade)(q, a)
        model.fit(flat, sizes, dense, y)
    q, a, y = synthetic(pairs[cut:], SEED + 1)
    if len(q):
        flat, sizes, dense, _ = Features(model.profiles, model.trade)(q, a)
        s = model.scores(flat, sizes, dense)
        for k in range(len(LABELS)):
            own, other = np.sort(s[y[:, k] > 0, k]), np.sort(s[y[:, k] == 0, k])
            if own.size:
                model.thresholds[k] = threshold(own, other)
                model.spreads[k] = max(0.1, float(np.median(own) - model.thresholds[k]))
    return model


_SCHEMA = "result_id long, defect string, key string, n_stands long, n_closes long"
_ARROW = pa.schema([("result_id", pa.int64()), ("defect", pa.string()), ("key", pa.string()), ("n_stands", pa.int64()), ("n_closes", pa.int64())])


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, counts = Features(model.profiles, model.trade), Counter()
        for batch in batches:
            ids, questions, answers = (batch.column(i).to_pylist() for i in range(3))
            flat, sizes, dense, ends = features(questions, answers)
            labels = model.labels(model.scores(flat, sizes, dense), np.array([bool(q) for q in questions], dtype=bool))
            out = []
            for n in np.nonzero((labels >= 0) | np.array([e[0] == DOUBT for e in ends], dtype=bool))[0]:
                out.append((ids[n], LABELS[labels[n]] if labels[n] >= 0 else "doubt", ends[n][1] or None))
            for a, end in zip(answers, ends, strict=True):
                if a:
                    closing_counts(a, counts)
                if end[0] == DOUBT:
                    closes(a, end[1], counts)
            columns = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=False)] + [pa.nulls(len(out), pa.int64())] * 2, schema=_ARROW
            )
        keys = sorted({k for k, _ in counts})
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(keys), pa.int64()), pa.nulls(len(keys), pa.string()), pa.array(keys, pa.string())]
            + [pa.array([counts[k, i] for k in keys], pa.int64()) for i in (0, 1)],
            schema=_ARROW,
        )

    return run


_COUNTS = "kind string, key string, n long"


def _counting(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Answers by word ('w'), texts by their letters ('s' and the number of the language), and of these the number of
    texts ('t') and the three-grams by language ('g' and its number)."""
    said, texts, grams = Counter(), Counter(), {}

    def flush() -> pd.DataFrame:
        out = [("w", w, n) for w, n in said.items()]
        said.clear()
        return pd.DataFrame(out, columns=["kind", "key", "n"])

    for pdf in batches:
        spelled = Counter()
        for column in ("answer", "question"):
            for raw, n in Counter(pdf[column]).items():
                text = plain(raw)
                if column == "answer":
                    for w in set(words(text)):
                        said[w] += n
                if (own := Profiles.letters(text)) is not None:
                    spelled[own] += n
        by_language: dict[int, tuple[list[str], list[int]]] = {}
        for (language, text), n in spelled.items():
            own = by_language.setdefault(language, ([], []))
            own[0].append(text)
            own[1].append(n)
        for language, (own, times) in by_language.items():
            texts[language] += sum(times)
            grams[language] = grams.get(language, 0) + Profiles.grams(own, np.array(times))
            yield pd.DataFrame({"kind": f"s{language}", "key": own, "n": times})
        if len(said) > 200_000:
            yield flush()
    yield flush()
    out = [("t", str(k), n) for k, n in texts.items()]
    out += [(f"g{k}", str(slot), int(counts[slot])) for k, counts in grams.items() for slot in np.nonzero(counts)[0]]
    yield pd.DataFrame(out, columns=["kind", "key", "n"])


def _measuring(profiles: Profiles):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Number, sum and sum of squares of the texts' mean log probabilities, by language."""
        sums = np.zeros((len(profiles.known), 3))
        place = {f"s{k}": n for n, k in enumerate(profiles.known)}
        for pdf in batches:
            for kind, own in pdf.groupby("kind"):
                if (n := place.get(kind)) is not None:
                    x, times = profiles.usual(own["key"].tolist(), n), own["n"].to_numpy()
                    sums[n] += times.sum(), times @ x, times @ (x * x)
        yield pd.DataFrame([(n, *row) for n, row in enumerate(sums.tolist())], columns=["place", "n", "x", "xx"])

    return run


def _examples(pdf: pd.DataFrame, features: Features, seed: int):
    pdf = pdf.sort_values(["digest", "result_id", "question", "answer"])
    q, a, y = synthetic(list(zip(pdf["question"], pdf["answer"], strict=True)), seed)
    return (*features(q, a)[:3], y) if q else None


_WEIGHTS = "n double, hashed binary, dense binary"


def _average(pdf: pd.DataFrame) -> pd.DataFrame:
    share = pdf["n"] / pdf["n"].sum()
    parts = [sum(w * np.frombuffer(x, dtype=np.float64) for w, x in zip(share, pdf[c], strict=True)).tobytes() for c in ("hashed", "dense")]
    return pd.DataFrame([(pdf["n"].sum(), *parts)], columns=["n", "hashed", "dense"])


def _fitting(profiles: Profiles, trade: frozenset[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """The weights of one chunk's examples and how many they are."""
        model, out = Model(profiles, trade), []
        if (made := _examples(pdf, Features(profiles, trade), SEED)) is not None:
            model.fit(*made)
            out.append((float(len(made[3])), *(w.astype(np.float64).tobytes() for w in (model.hashed, model.dense))))
        return pd.DataFrame(out, columns=["n", "hashed", "dense"])

    return run


#: Scores are counted in steps of this size.
STEP = 1e-3


def _calibrating(model: Model):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Examples by label, whether they have it, and score."""
        out = []
        if (made := _examples(pdf, Features(model.profiles, model.trade), SEED + 1)) is not None:
            *parts, y = made
            steps = np.round(model.scores(*parts) / STEP).astype(np.int64)
            for k in range(len(LABELS)):
                for own in (True, False):
                    out += [(k, own, int(v), int(n)) for v, n in zip(*np.unique(steps[(y[:, k] > 0) == own, k], return_counts=True), strict=True)]
        return pd.DataFrame(out, columns=["label", "own", "step", "n"])

    return run


def counted_threshold(steps: np.ndarray, own: np.ndarray, other: np.ndarray, cost: float = COST) -> tuple[float, float]:
    """As ``threshold``, from counts by score (sorted), and the median of the own scores."""
    missed = (np.cumsum(own) - own) / own.sum()
    wrong = (other.sum() - np.cumsum(other) + other) / max(1, other.sum())
    places = (own > 0) | (np.arange(len(steps)) > np.argmax(own > 0))
    best = int(np.argmin(np.where(places, missed + cost * wrong, np.inf)))
    at = (steps[best] + steps[best - 1]) / 2 * STEP if best else steps[best] * STEP - 1.0
    return float(at), float(steps[np.searchsorted(np.cumsum(own), own.sum() / 2)] * STEP)


def fitted(pairs: DataFrame, chunk_rows: int = CHUNK_ROWS) -> Model:
    """The model of all pairs that have both parts: counts, weights and thresholds from every row, none from a sample.

    Three quarters of the rows, by the digest of their id, give words, profiles and weights; the rest the thresholds.
    Weights are fitted chunk by chunk and averaged by their number of examples.
    """
    digest = F.xxhash64("result_id", F.lit(SEED))
    both = pairs.where("question IS NOT NULL AND answer IS NOT NULL AND result_id IS NOT NULL").withColumn("digest", digest)
    numbers = {r.held: r.n for r in both.groupBy((F.pmod("digest", F.lit(4)) == 3).alias("held")).agg(F.count("*").alias("n")).collect()}

    def chunks(held: bool) -> DataFrame:
        n = max(1, -(-numbers.get(held, 0) // chunk_rows))
        part = both.where((F.pmod("digest", F.lit(4)) == 3) == F.lit(held))
        return part.withColumn("chunk", F.pmod(F.shiftright("digest", 2), F.lit(n)).cast("int")).repartition(n, "chunk").groupBy("chunk")

    seen = spread(both.where(F.pmod("digest", F.lit(4)) != 3).select("question", "answer"))
    read = materialize(seen.mapInPandas(_counting, _COUNTS), "p4-counts")
    counts = read.where("kind NOT LIKE 's%'").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    common = counts.where("kind = 'w'").orderBy(F.desc("n"), "key").limit(VOCABULARY).collect()
    trade = frozenset(r.key for r in common if r.n > 2 and r.key not in WEIGHTS)
    texts, grams = {}, {}
    for r in counts.where("kind <> 'w'").collect():  # at most a row for each language and slot
        if r.kind == "t":
            texts[int(r.key)] = r.n
        else:
            grams.setdefault(int(r.kind[1:]), np.zeros(GRAMS))[int(r.key)] = r.n
    profiles = Profiles([])
    profiles.count(grams, texts)
    sums = read.where("kind LIKE 's%'").mapInPandas(_measuring(profiles), "place int, n double, x double, xx double").groupBy("place").agg(*(F.sum(c).alias(c) for c in ("n", "x", "xx")))
    sums = {r.place: r for r in sums.collect()}
    means = [sums[n].x / sums[n].n for n in range(len(profiles.known))]
    profiles.measure(means, [max(0.0, sums[n].xx / sums[n].n - m * m) ** 0.5 for n, m in enumerate(means)])
    model = Model(profiles, trade)
    weights = materialize(chunks(False).applyInPandas(_fitting(profiles, trade), _WEIGHTS), "p4-weights")
    weights = weights.groupBy(F.pmod(F.xxhash64("hashed"), F.lit(16))).applyInPandas(_average, _WEIGHTS).toPandas()  # at most 16 rows
    if len(weights):
        whole = _average(weights.sort_values("hashed"))
        model.hashed = np.frombuffer(whole["hashed"][0]).astype(np.float32).reshape(model.hashed.shape)
        model.dense = np.frombuffer(whole["dense"][0]).astype(np.float32).reshape(model.dense.shape)
    scores = chunks(True).applyInPandas(_calibrating(model), "label int, own boolean, step long, n long")
    scores = scores.groupBy("label", "step").agg(F.sum(F.expr("if(own, n, 0)")).alias("own"), F.sum(F.expr("if(own, 0, n)")).alias("other")).toPandas()
    for k, of in scores.sort_values("step").groupby("label"):
        if of["own"].sum():
            model.thresholds[k], median = counted_threshold(*(of[c].to_numpy() for c in ("step", "own", "other")))
            model.spreads[k] = max(0.1, median - model.thresholds[k])
    return model


def defective_pairs(rows: DataFrame, id_col: str = "result_id", question: str = "question", answer: str = "generated_answer", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(result_id, defect): one row per defective pair."""
    pairs = rows.select(F.col(id_col).cast("long").alias("result_id"), F.col(question).alias("question"), F.col(answer).alias("answer"))
    model = fitted(pairs, chunk_rows)
    scored = materialize(spread(pairs).mapInArrow(_score(model), _SCHEMA), "p4-scored")
    sure = scored.where("defect IS NOT NULL AND defect <> 'doubt'").select("result_id", "defect")
    counts = scored.where("defect IS NULL").groupBy("key").agg(F.sum("n_stands").alias("n_stands"), F.sum("n_closes").alias("n_closes"))
    least = F.lit(1.0)
    for kind, value in LEAST_TERMINALITY.items():
        least = F.when(F.substring("key", 1, 1) == kind, F.lit(value)).otherwise(least)
    doubt = salted_join(scored.where("defect = 'doubt'").select("result_id", "key"), counts, "key", "left", "result_id")
    cut = doubt.where(F.coalesce(F.col("n_closes") / F.col("n_stands"), F.lit(0.0)) < least)
    return sure.unionByName(cut.select("result_id", F.lit("truncated").alias("defect")))
