"""Splitting oversized texts at natural boundaries by pointer doubling.

Every boundary of a text (ends of paragraphs, sentences and words, and every character of a run too long for a piece) is
joined to its farthest legal successor, the overlap included; the successor tables are then squared, so that after
log2(pieces) rounds all greedy cuts of all texts of a batch are known at once, without walking from cut to cut. A text
lies in one row, so the tables are arrays of one batch and nothing is shuffled; only oversized texts reach Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from decidra.llm.sentences import sentence_ends
from decidra.session import unique_name

LEVELS = ("paragraph", "sentence", "word", "char")
_BLANK_LINES = re.compile(r"\s*\n[^\S\n]*\n\s*")
_RUN = re.compile(r"\S+")
_RANGE = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
RESULT = T.StructType([T.StructField("boundary", T.StringType()), T.StructField("pieces", T.ArrayType(_RANGE))])


def _level(text: str, ends: np.ndarray, limit: int, runs: list[tuple[int, int]]) -> int:
    """The coarsest kind of part of which every one fits the limit."""
    if max(map(len, _BLANK_LINES.split(text.strip()))) <= limit:
        return 0
    at, longest = 0, 0
    for end in ends:
        part = text[at:end]
        longest, at = max(longest, len(part.lstrip())), end
    if longest <= limit:
        return 1
    return 2 if max((b - a for a, b in runs), default=0) <= limit else 3


def _cuts(texts: list[str], ends: list[np.ndarray], limits: np.ndarray, overlaps: np.ndarray) -> list[tuple[str, list[dict]]]:
    """All greedy cuts of all texts of a batch: successor tables by binary search, then squaring."""
    step = limits - overlaps  # a piece after the first brings at most so much new text
    lengths = np.array([len(t) for t in texts])
    base = np.concatenate([[0], np.cumsum(lengths + limits + 2)])[:-1]
    levels: list[list[np.ndarray]] = [[], [], [], []]
    names = []
    for i, text in enumerate(texts):
        runs = [m.span() for m in _RUN.finditer(text)]
        paragraphs = [m.end() for m in _BLANK_LINES.finditer(text)]
        names.append(LEVELS[_level(text, ends[i], limits[i], runs)])
        starts = np.array([a for a, _ in runs], dtype=np.int64)
        # a cut lies before the first character of the next part: white space stays with the part before it
        after = np.searchsorted(starts, ends[i]) if len(starts) else np.array([], dtype=np.int64)
        levels[0].append(base[i] + np.array(paragraphs, dtype=np.int64))
        levels[1].append(base[i] + starts[np.unique(after[after < len(starts)])])
        levels[2].append(base[i] + starts)
        long = [np.arange(a, b) for a, b in runs if b - a > step[i]] + [np.arange(a, b) for a, b in zip(np.r_[0, starts], np.r_[starts, lengths[i]]) if b - a > step[i]]
        levels[3].append(base[i] + (np.unique(np.concatenate(long)) if long else np.array([], dtype=np.int64)))
    last = base + lengths
    nodes = np.unique(np.concatenate([x for level in levels for x in level] + [base, last]))
    doc = np.searchsorted(base, nodes, side="right") - 1
    first = nodes == base[doc]
    reach = np.minimum(np.where(first, nodes + limits[doc], nodes + step[doc]), last[doc])
    successor = np.where(reach == last[doc], reach, -1)
    least = np.where(first, nodes + overlaps[doc], nodes)  # the first piece must hold what the second repeats
    for level in levels:  # the coarsest boundary within reach, and of these the farthest
        bounds = np.unique(np.concatenate(level))
        if len(bounds):
            at = np.searchsorted(bounds, reach, side="right") - 1
            candidate = np.where(at >= 0, bounds[np.maximum(at, 0)], -1)
            successor = np.where((successor < 0) & (candidate > least), candidate, successor)
    successor = np.where(successor < 0, reach, successor)
    table = np.searchsorted(nodes, np.minimum(successor, last[doc]))
    on_path = np.zeros(len(nodes), dtype=bool)
    on_path[np.searchsorted(nodes, base)] = True
    final = nodes == last[doc]
    table[final] = np.flatnonzero(final)
    while True:  # after round k the cuts within 2**k steps are marked
        on_path[table[np.flatnonzero(on_path)]] = True
        squared = table[table]
        if np.array_equal(squared, table):
            break
        table = squared
    out = []
    cuts, owners = nodes[on_path], doc[on_path]
    for i in range(len(texts)):
        own = cuts[owners == i] - base[i] if len(texts) < 64 else cuts[np.searchsorted(owners, i) : np.searchsorted(owners, i, side="right")] - base[i]
        pieces = [{"start": int(max(0, a - overlaps[i]) if a else 0), "end": int(b)} for a, b in zip(own[:-1], own[1:])]
        out.append((names[i], pieces))
    return out


@F.pandas_udf(RESULT)  # type: ignore[call-overload]
def _split(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, ends, limits, overlaps in batches:
        found = _cuts(list(texts), [np.asarray(e, dtype=np.int64) for e in ends], limits.to_numpy(np.int64), overlaps.to_numpy(np.int64)) if len(texts) else []
        yield pd.DataFrame({"boundary": [b for b, _ in found], "pieces": [p for _, p in found]})


def split_oversized(df: DataFrame, text_col: str, limit: Column, overlap: Column, out_col: str = "split") -> DataFrame:
    """The rows whose text exceeds ``limit`` code points, with ``struct<boundary, pieces array<struct<start,end>>>``.

    ``boundary`` is the coarsest of paragraph, sentence, word and char of which every one fits the limit. ``pieces`` are
    half-open ranges of the text from 0 that cover it: no piece exceeds the limit, a piece after the first begins exactly
    ``overlap`` code points before the end of the one before it, and each cut lies at the coarsest boundary within reach.
    Texts that are null or fit, and rows with a null or non-positive limit, give no row. A null or negative overlap counts
    as 0, one of half the limit or more as just under half. Repeated rows stay repeated; other columns are kept, and an
    existing ``out_col`` is replaced.
    """
    text = F.col(f"`{text_col}`")
    held = unique_name(df, "_ends")
    wide = df.where(text.isNotNull() & (limit > 0) & (F.length(text) > limit)).withColumn(held, sentence_ends(text))
    lap = F.least(F.greatest(F.coalesce(overlap, F.lit(0)), F.lit(0)), F.floor((limit - 1) / 2)).cast("int")
    return wide.withColumn(out_col, _split(text, F.col(held), limit.cast("int"), lap)).drop(held)


def pieces(split: DataFrame, text_col: str, out_col: str = "split") -> DataFrame:
    """One row per piece: the columns of the row with ``piece_no`` from 1 and ``piece``, the text of the piece."""
    text = F.col(f"`{text_col}`")
    at = F.posexplode(F.col(f"`{out_col}`.pieces")).alias("piece_no", "_piece")
    flat = split.select("*", at)
    cut = F.substring(text, F.col("_piece.start") + 1, F.col("_piece.end") - F.col("_piece.start"))
    return flat.withColumn("piece_no", F.col("piece_no") + 1).withColumn("piece", cut).drop("_piece")
