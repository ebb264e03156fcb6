"""Filling fixed-capacity containers by bulk-synchronous best fit over size classes.

Texts of one size are interchangeable, and a container's gap is one of ``capacity`` values, so documents and gaps are
range-sorted into at most ``capacity`` classes each, whatever the size of the corpus. In each sweep the largest class of
documents left looks up its successor, the smallest gap class that holds it; as many as both classes have are matched at
once, the gaps are updated, and the sweep goes on until every class is placed. Who gets which place is resolved by rank:
each document has a rank within its size, and each match covers a range of ranks and a range of containers. Ranks are
counted in two steps over salted size classes, so that no size, however common, is ranked in one task.

What reaches the driver is one sum per size class, at most ``capacity`` rows at any size of the corpus; the sweeps run over
these. Offsets of salts stay in a table that is joined with the documents.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parts of a size class that are ranked apart, and the most rows of offsets that are sent to every task.
SALTS, OFFSETS_LIMIT = 64, 500_000


def best_fit(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Matches (size, first rank, first container, how many) of best fit decreasing over classes, and the number of containers.

    Containers of one history are an interval of numbers; a match takes an interval or cuts it. The work grows with the
    number of classes and matches, not with the number of documents.
    """
    gaps: list[int] = []  # sorted gap classes with places
    held: dict[int, list[tuple[int, int]]] = {}  # gap -> intervals of containers
    matches: list[tuple[int, int, int, int]] = []
    containers = 0

    def put(gap: int, first: int, n: int) -> None:
        if gap <= 0:
            return
        if gap not in held:
            bisect.insort(gaps, gap)
            held[gap] = []
        held[gap].append((first, n))

    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            at = bisect.bisect_left(gaps, size)
            if at == len(gaps):
                # open containers and fill each with as many of this size as it holds
                per = capacity // size
                n = -(-left // per) if left % per == 0 else left // per
                if n == 0:
                    matches += [(size, rank + k, containers, 1) for k in range(left)]
                    put(capacity - left * size, containers, 1)
                    containers, left = containers + 1, 0
                else:
                    matches += [(size, rank + k * n, containers, n) for k in range(per)]
                    put(capacity - per * size, containers, n)
                    containers, rank, left = containers + n, rank + n * per, left - n * per
                continue
            gap = gaps[at]
            first, n = held[gap].pop()
            if not held[gap]:
                del held[gap]
                gaps.pop(at)
            take = min(n, left)
            if n > take:
                put(gap, first + take, n - take)
            matches.append((size, rank, first, take))
            put(gap - size, first, take)
            rank, left = rank + take, left - take
    return matches, containers


PLACED = T.StructType([T.StructField(n, t) for n, t in (("id", T.LongType()), ("piece_no", T.IntegerType()), ("start_token", T.LongType()), ("n_tokens", T.IntegerType()), ("container", T.LongType()))])


def pack(df: DataFrame, id_col: str, text_col: str, capacity: int = 4096) -> DataFrame:
    """(id, piece_no from 1, start_token, n_tokens, container): every text in containers of ``capacity`` tokens.

    One UTF-8 byte is one token, and each text has one end token more. Only a text that alone exceeds a container is
    split: into full containers and a rest, which is packed like a text. Null texts hold nothing and give no row, empty
    ones one token; rows with a null id give none; repeated rows (one id) count once. Ids must be whole numbers; other
    columns do not matter. Containers are numbered from 0 without gaps; an empty table gives an empty result.
    """
    if capacity < 1:
        raise ValueError("the capacity must be at least 1")
    sizes = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), (F.octet_length(F.col(f"`{text_col}`")) + 1).cast("long").alias("tokens")).where("id is not null and tokens is not null").groupBy("id").agg(F.max("tokens").alias("tokens"))
    rest = (F.col("tokens") % capacity).cast("int")
    sized = sizes.select("id", "tokens", rest.alias("size"), F.floor(F.col("tokens") / capacity).alias("full"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"))
    classes = sized.groupBy("size", "salt").agg(F.count("*").alias("n"), F.sum("full").alias("full"))
    sums = sorted(classes.groupBy("size").agg(F.sum("n").alias("n"), F.sum("full").alias("full")).collect(), key=lambda r: r["size"])  # at most capacity rows
    counts = {r["size"]: r["n"] for r in sums if r["size"] > 0}
    full_before, full = np.zeros(capacity, dtype=np.int64), 0
    for r in sums:
        full_before[r["size"]] = full
        full += r["full"]
    matches, _ = best_fit(counts, capacity)
    table = np.array(sorted(matches), dtype=np.int64).reshape(-1, 4)
    keys = table[:, 0] * (1 << 40) + table[:, 1]
    upto = Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(upto), F.lit(0))
    offsets = classes.select("size", "salt", earlier("n").alias("ranks_before"), earlier("full").alias("fulls_before"))
    if capacity * SALTS <= OFFSETS_LIMIT:  # the most rows there can be
        offsets = F.broadcast(offsets)
    each = Window.partitionBy("size", "salt").orderBy("id")
    ranked = sized.select("id", "tokens", "size", "full", "salt", (F.row_number().over(each) - 1).alias("rank"), (F.sum("full").over(each) - F.col("full")).alias("full_rank"))
    placed = ranked.join(offsets, ["size", "salt"]).select("id", "tokens", "size", "full", (F.col("rank") + F.col("ranks_before")).alias("rank"), (F.col("full_rank") + F.col("fulls_before")).alias("full_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, tokens, size, whole, rank, before = (np.asarray(b.column(k)).astype(np.int64) for k in range(6))
            at = np.searchsorted(keys, size * (1 << 40) + rank, side="right") - 1
            some = size > 0
            row = table[np.maximum(at, 0)] if len(table) else np.zeros((len(size), 4), dtype=np.int64)
            rests = full + row[:, 2] + rank - row[:, 1]
            piece = np.concatenate([np.arange(n) for n in whole]) if whole.sum() else np.empty(0, dtype=np.int64)
            owner = np.repeat(np.arange(len(ids)), whole)
            columns = (
                np.r_[ids[owner], ids[some]],
                np.r_[piece + 1, whole[some] + 1].astype(np.int32),
                np.r_[piece * capacity, whole[some] * capacity],
                np.r_[np.full(len(owner), capacity), size[some]].astype(np.int32),
                np.r_[(full_before[size] + before)[owner] + piece, rests[some]],
            )
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=PLACED.names)

    return placed.mapInArrow(place, PLACED)
