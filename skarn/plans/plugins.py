"""Model plug-ins: embedder, reranker, generator, judge. The offline ones are deterministic and need no weights."""

from __future__ import annotations

import hashlib
import json
import re
from typing import Protocol

import numpy as np

_TOKEN = re.compile(r"[A-Za-z0-9_]+")


class Embedder(Protocol):
    dimensions: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class Reranker(Protocol):
    def score(self, question: str, texts: list[str]) -> list[float]: ...


class Generator(Protocol):
    def generate(self, prompts: list[str]) -> list[str]: ...


class Judge(Protocol):
    def judge(self, prompts: list[str]) -> list[str]: ...


class HashEmbedder:
    """Counts of lower-case tokens by the first four digits of their MD5, L2-normalised."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions
        self._slots: dict[str, int] = {}

    def _slot(self, token: str) -> int:
        if len(self._slots) > 200_000:
            self._slots.clear()
        if token not in self._slots:
            self._slots[token] = int(hashlib.md5(token.encode()).hexdigest()[:4], 16) % self.dimensions
        return self._slots[token]

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions))
        for n, text in enumerate(texts):
            for token in _TOKEN.findall((text or "").lower()):
                out[n, self._slot(token)] += 1
        size = np.sqrt((out**2).sum(axis=1, keepdims=True))
        return out / np.where(size == 0, 1, size)


class OverlapReranker:
    """Share of the question's distinct tokens that the text holds."""

    def score(self, question: str, texts: list[str]) -> list[float]:
        asked = set(_TOKEN.findall((question or "").lower()))
        return [len(asked & set(_TOKEN.findall((t or "").lower()))) / max(1, len(asked)) for t in texts]


class ExtractiveGenerator:
    """The first context line that follows the prompt's first source header; an offline stand-in for a model."""

    def generate(self, prompts: list[str]) -> list[str]:
        return [(re.search(r"\[Source 1[^\]]*\]\n([^\n]*)", p) or [p, ""])[1] for p in prompts]


class OverlapJudge:
    """Scores 1 to 5 by the overlap of expected and generated answer; replies like a model, fenced JSON."""

    def judge(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            match = re.search(r"EXPECTED ANSWER:\n(.*?)\n\nGENERATED ANSWER:\n(.*?)(?:\n\n|$)", p, re.S)
            a, b = (set(_TOKEN.findall(x.lower())) for x in (match.groups() if match else ("", "")))
            share = len(a & b) / max(1, len(a))
            out.append("```json\n" + json.dumps({"score": 1 + round(4 * share), "reason": f"overlap {share:.2f}"}) + "\n```")
        return out


EMBEDDERS = {"hash": HashEmbedder}
RERANKERS = {"overlap": OverlapReranker}
GENERATORS = {"extractive": ExtractiveGenerator}
JUDGES = {"overlap": OverlapJudge}


def plugin(registry: dict[str, type], name: str, **options):
    """A plug-in by name; an unknown name is an error, never a silent default."""
    if name not in registry:
        raise KeyError(f"unknown plug-in {name!r}; known: {', '.join(sorted(registry))}")
    return registry[name](**options)
