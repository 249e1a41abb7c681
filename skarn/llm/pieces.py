"""Problem 6: splitting oversized items at natural boundaries.

Method: token offset prefix sums with a sorted boundary array. ``offsets[i]`` is the size of the first i characters; a
binary search on it finds the last character a piece may hold, one on the sorted boundaries of a kind (after blank lines,
line ends, sentence ends, at spaces) the last place to cut before that, one on the offsets again the step back by the
overlap. A stretch without any white space is cut hard at the limit.

Sizes are characters by default, the offsets then the positions themselves. With ``weights`` (:func:`token_weights`: one
at the first character of each token of a public tokenizer) limit and overlap are tokens.

A boundary of a better kind is taken if it leaves the piece at least ``1 - window`` full; otherwise the next kind is
tried. Where the overlap leaves no boundary in reach, or no room for a character of several tokens, it is shortened so far
that there is. So a hard cut is made
only inside an unbroken stretch that is longer than the limit: a text with one is 'forced', told by its cuts. Pieces are
exact substrings: dropping each piece's first ``overlap`` characters and joining gives the text back.

Defined results. Null text: no piece. Empty text and text within the limit: one piece, the text itself. Overlap is cut
back to a word start where there is one. Repeated rows: each has its pieces. Row numbers need not be unique for the
splitting; the caller's key is carried along. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.packing import encoding

OVERLAP = 200
WINDOW = 0.5
#: Kinds of boundary from best to worst; a match's end is a place to cut.
KINDS = (
    re.compile(r"\r?\n[ \t]*(?:\r?\n[ \t]*)+|\r[ \t]*\r"),
    re.compile(r"\r\n|\n|\r"),
    re.compile(r"[.!?…。！？]+[\"'»”’)\]`]*\s+"),
    re.compile(r"\s+"),
)
NAMES = ("blank_line", "line_end", "sentence_end", "space", "hard")
SCHEMA = (
    "table_name string, row_no long, piece_no int, start_at int, end_at int, overlap int, cut string, kind string, piece string"
)
_SPACE = re.compile(r"\s+")


def token_weights(tokenizer: str) -> Callable[[str], np.ndarray]:
    """Weights of a text's characters: how many tokens of the public tokenizer start at each."""

    def weigh(text: str) -> np.ndarray:
        encode = encoding(tokenizer)
        _, starts = encode.decode_with_offsets(encode.encode_ordinary(text))
        return np.bincount(np.array(starts, dtype=np.int64), minlength=len(text)) if starts else np.zeros(len(text), dtype=np.int64)

    return weigh


def _boundaries(text: str) -> list[np.ndarray]:
    """Sorted places to cut by kind; at a space both its ends."""
    found = [np.fromiter((m.end() for m in kind.finditer(text)), dtype=np.int64) for kind in KINDS[:-1]]
    return found + [np.unique(np.fromiter((p for m in _SPACE.finditer(text) for p in m.span()), dtype=np.int64))]


def split_text(text: str, limit: int, overlap: int = OVERLAP, window: float = WINDOW, weights: np.ndarray | None = None) -> list[tuple[int, int, int, str]]:
    """Pieces as (start, end, overlap with the piece before, kind of the cut at the end), each of at most ``limit``."""
    if limit <= overlap:
        raise ValueError("the limit must exceed the overlap")
    n = len(text)
    offsets = np.arange(n + 1) if weights is None else np.concatenate([[0], np.cumsum(weights)])
    if offsets[n] <= limit:
        return [(0, n, 0, "end")]
    boundaries = _boundaries(text)
    spaces, words = boundaries[-1], np.fromiter((m.end() for m in _SPACE.finditer(text)), dtype=np.int64)
    out: list[tuple[int, int, int, str]] = []
    start, lead = 0, 0
    while offsets[n] - offsets[start] > limit:
        fresh = start + lead
        # the first place to cut beyond the overlap must be in reach, else the overlap gives way
        k = int(np.searchsorted(spaces, fresh, "right"))
        after = int(spaces[k]) if k < len(spaces) else n
        if lead and offsets[after] - offsets[start] > limit >= offsets[after] - offsets[fresh]:
            start = int(np.searchsorted(offsets, offsets[after] - limit, "left"))
            lead = fresh - start
            continue
        if lead and offsets[fresh + 1] - offsets[start] > limit:  # so must the first character beyond it
            start = min(fresh, int(np.searchsorted(offsets, offsets[fresh + 1] - limit, "left")))
            lead = fresh - start
            continue
        most = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        most = max(most, fresh + 1)  # one character at least, whatever it weighs
        least = int(np.searchsorted(offsets, offsets[start] + int(limit * (1 - window)), "left"))
        end, cut = most, "hard"
        for floor in (max(fresh, least), fresh):
            for name, at in zip(NAMES, boundaries, strict=False):
                k = int(np.searchsorted(at, most, "right")) - 1
                if k >= 0 and at[k] > floor:
                    end, cut = int(at[k]), name
                    break
            if cut != "hard":
                break
        if cut == "hard" and text[most - 1].isspace():  # inside white space longer than a piece
            cut = "space"
        out.append((start, end, lead, cut))
        back = int(np.searchsorted(offsets, offsets[end] - overlap, "left"))
        k = int(np.searchsorted(words, back, "left"))
        begin = int(words[k]) if k < len(words) and words[k] < end else back
        begin = min(max(begin, start + 1), end)
        start, lead = begin, end - begin
    out.append((start, n, lead, "end"))
    return out


def _split(limits: dict[str, int], overlap: int, window: float, weigh: Callable[[str], np.ndarray] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("table_name", pa.string()), ("row_no", pa.int64()), ("piece_no", pa.int32()), ("start_at", pa.int32()), ("end_at", pa.int32())]
            + [("overlap", pa.int32()), ("cut", pa.string()), ("kind", pa.string()), ("piece", pa.string())]
        )
        for batch in batches:
            rows = []
            for name, row_no, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if text is None:
                    continue
                cuts = split_text(text, limits[name], overlap, window, weigh(text) if weigh else None)
                kind = "whole" if len(cuts) == 1 else "forced" if any(cut == "hard" for *_, cut in cuts) else "boundary"
                for k, (start, end, lead, cut) in enumerate(cuts):
                    rows.append((name, row_no, k, start, end, lead, cut, kind, text[start:end]))
            columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def split_pieces(
    tables: dict[str, DataFrame],
    limits: dict[str, int],
    key: str = "row_no",
    text: str = "text",
    overlap: int = OVERLAP,
    window: float = WINDOW,
    weigh: Callable[[str], np.ndarray] | None = None,
) -> DataFrame:
    """Pieces of every text of the named tables; map-only, each text is cut where it is read."""
    out = None
    for name, df in tables.items():
        rows = df.select(F.lit(name).alias("table_name"), F.col(key).cast("long").alias("row_no"), F.col(text).alias("text"))
        pieces = rows.mapInArrow(_split(limits, overlap, window, weigh), SCHEMA)
        out = pieces if out is None else out.unionByName(pieces)
    return out


def oversized(pieces: DataFrame) -> DataFrame:
    """One row per text that had to be cut: (table_name, row_no, kind). Each such text has exactly one first piece."""
    return pieces.where((F.col("piece_no") == 0) & (F.col("kind") != "whole")).select("table_name", "row_no", "kind")
