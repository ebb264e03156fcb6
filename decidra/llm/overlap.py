"""Same or near-same records across splits: a segment join over canonical word strings, verified by banded alignment.

Two states overlap if they share at least 80 % of their words relative to the longer one, with multiplicity and in any
order. Sorting the words of a state gives its canonical string; the longest common subsequence of two such strings is the
multiset overlap, so the condition is an edit-distance bound, and segments of one string must occur in the other:

* The words are cut by value, not by place, into segments: an edit then touches one segment, wherever it happens, and the
  "allowed position" of a segment is its own number. Frequent words (a bounded list, from counts over all rows) allow
  ``EDITS`` edits and so fill ``EDITS`` + 1 segments, one of which must match as a whole; all other words fill ``COLORS``
  segments.
* A pair shares either more than ``COLORS`` rare words, so two of them in one rare segment (key: the pair of words), or so
  few that nearly all of its permitted edits fall on rare words, and at most ``EDITS`` are left for the frequent ones,
  so one frequent segment is the same in both (key: the segment). Rows for which this bound does not hold (short ones, ones
  with few rare words) are matched by prefixes of their rarest words instead. No pair is lost, and no key is frequent.
* Candidates are verified by a banded alignment of the two canonical strings, in full words.

Segments of one string by place, k + 1 of them, hold two to three words each, as a fifth of the words of either side may
differ; those of frequent words are shared by most rows. That is why they are cut by value, and rare words are paired.

The texts are tokenised once, to a table in the shared folder. Copies of one canonical string emit their keys once in a
partition, and those with very many copies once in all; they come back as the members of its class.
"""

from __future__ import annotations

import html
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from decidra.session import bounded_broadcast, cut_lineage, ensure_checkpoint_dir, remove_path

#: Segments of rare words, and edits that are left for frequent ones where a pair shares no more rare words than that.
COLORS, EDITS = 5, 10
SEGMENTS = EDITS + 1
#: Words of more than this share of the rows count as frequent; a row of w words on average allows w / share of them.
FREQUENT_SHARE = 0.005
FREQUENT_LIMIT = 200_000
#: Most keys of rows without the bound that are sent to every task; beyond it all rows emit their prefixes.
WEAK_LIMIT = 500_000
#: Canonical strings with at least so many copies emit their keys once in all; the most of them, by number of copies.
HOT_COPIES, HOT_LIMIT = 64, 200_000
#: Canonical strings a partition remembers.
SEEN_LIMIT = 1_000_000
_TAG, _WORD = re.compile(r"<[^<>]{0,200}>"), re.compile(r"[^\W_]+")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\[nrt\"'\\/]")


def words(text: str | None) -> list[str]:
    """The words of a text without case, punctuation, spacing, markup and character escapes."""
    if not text:
        return []
    if "\\" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else " ", text)
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if "<" in text:
        text = _TAG.sub(" ", text)
    return _WORD.findall(text.casefold())


def needed(longer: int, tenths: int = 8) -> int:
    """The least overlap of a pair whose longer side has so many words."""
    return -(-longer * tenths // 10)


def overlap(a: list[str], b: list[str]) -> int:
    """Words in common, with multiplicity; 0 as soon as the bound of the longer side can't be met.

    Banded alignment of sorted strings: as both are in one order, each step either matches or spends one permitted edit.
    """
    least = needed(max(len(a), len(b)))
    spare_a, spare_b = len(a) - least, len(b) - least
    if spare_a < 0 or spare_b < 0:
        return 0
    i = j = common = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            i, j, common = i + 1, j + 1, common + 1
        elif a[i] < b[j]:
            i, spare_a = i + 1, spare_a - 1
            if spare_a < 0:
                return 0
        else:
            j, spare_b = j + 1, spare_b - 1
            if spare_b < 0:
                return 0
    return common if common >= least else 0


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


TOKENS = T.StructType([T.StructField(n, t) for n, t in (
    ("id", T.LongType()), ("side", T.IntegerType()), ("n", T.IntegerType()), ("print", T.LongType()), ("s0", T.LongType()), ("s1", T.LongType()), ("tokens", T.ArrayType(T.IntegerType())),
)])
#: Side 0 is the train split, side 1 is held out.
TRAIN, HELD_OUT = 0, 1


def _parities(row: np.ndarray, bit: np.ndarray, rows: int, bits: int) -> np.ndarray:
    """Parity bits per row: a word more or less flips one of them, so the bits that differ are at most the edits."""
    counts = np.bincount(row * bits + bit.astype(np.int64), minlength=rows * bits).reshape(rows, bits) & 1
    return np.ascontiguousarray(np.packbits(counts.astype(np.uint8), axis=1)).view(np.int64)


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word codes of each row with words, its length, a hash of its canonical string, and 128 parity bits of its words."""
    import zlib

    known: dict[str, int] = {}
    for batch in batches:
        if len(known) > 1_000_000:
            known.clear()
        ids, sides, flat, lengths = [], [], [], []
        for i, side, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            own = words(text)
            if not own:
                continue
            for w in own:
                code = known.get(w)
                if code is None:
                    code = known[w] = zlib.crc32(w.encode()) - 0x80000000
                flat.append(code)
            lengths.append(len(own))
            ids.append(i)
            sides.append(side)
        codes, n = np.array(flat, dtype=np.int64), np.array(lengths, dtype=np.int64)
        offsets = np.r_[0, np.cumsum(n)]
        mixed = _mix(codes + (1 << 32))
        prints = _mix(np.add.reduceat(mixed, offsets[:-1])) if len(n) else mixed
        signs = _parities(np.repeat(np.arange(len(n)), n), (mixed >> np.uint64(40)) % np.uint64(128), len(n), 128)
        tokens = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(codes.astype(np.int32)))
        columns = [pa.array(ids, pa.int64()), pa.array(sides, pa.int32()), pa.array(n.astype(np.int32)), pa.array(prints.view(np.int64)), pa.array(signs[:, 0]), pa.array(signs[:, 1]), tokens]
        yield pa.RecordBatch.from_arrays(columns, names=TOKENS.names)


#: Keys leave Python packed: one row per bucket of keys and kind, with 32 bits of each key, and of each row what its kind is filtered by.
PACKED = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("kind", T.IntegerType()), *(T.StructField(n, T.BinaryType()) for n in ("keys", "ids", "info"))])
PAIRS = T.StructType([T.StructField("train_id", T.LongType()), T.StructField("held_out_id", T.LongType())])
#: Pairs of rare words; segments of frequent words, with 64 parity bits of these; prefixes, with length and parity bits of all words.
RARE, SEGMENT, PREFIX = 0, 1, 2
#: Rows per bucket, keys that are packed at once, and pairs that are compared at once.
BUCKET_ROWS, PACK_KEYS, PAIR_BLOCK = 20_000, 2_000_000, 1_000_000


def _pack_ids(ids: np.ndarray) -> bytes:
    """Ids as differences, in two bytes each where they fit."""
    steps = np.diff(ids, prepend=ids[:1])
    small = len(steps) and steps.min() >= 0 and steps.max() < 65536
    return ids[:1].tobytes() + steps.astype(np.uint16 if small else np.int64).tobytes()


def _unpack_ids(packed: bytes, n: int) -> np.ndarray:
    kind = np.uint16 if len(packed) == 8 + 2 * n else np.int64
    return np.frombuffer(packed, np.int64, 1) + np.cumsum(np.frombuffer(packed, kind, n, 8).astype(np.int64))


class _Packer:
    """Collects keys of one kind and gives them out by bucket."""

    def __init__(self, kind: int, buckets: int, info: int) -> None:
        self.kind, self.buckets, self.info, self.n = kind, buckets, info, 0
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, keys: np.ndarray, ids: np.ndarray, *info: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(keys):
            self.parts.append((keys, ids, *info))
            self.n += len(keys)
        if self.n >= PACK_KEYS:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        keys, ids, *info = (np.concatenate(x) for x in zip(*self.parts)) if self.parts else (np.empty(0, np.uint64), np.empty(0, np.int64), *[np.empty(0, np.int64)] * self.info)
        self.parts, self.n = [], 0
        bucket = ((keys >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)
        order = np.lexsort((ids, bucket))  # by id, so that the differences are small
        first = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        cuts = list(zip(first, np.r_[first[1:], len(order)]))
        short, ids = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)[order], ids[order]
        more = np.column_stack([x[order] for x in info]) if self.info else None
        columns = [
            pa.array(bucket[order][first], pa.int32()), pa.array([self.kind] * len(first), pa.int32()), pa.array([short[a:b].tobytes() for a, b in cuts], pa.binary()),
            pa.array([_pack_ids(ids[a:b]) for a, b in cuts], pa.binary()), pa.array([np.ascontiguousarray(more[a:b], dtype=np.int64).tobytes() if self.info else b"" for a, b in cuts], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=PACKED.names)


def _unpacked(table: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(keys, ids, info) of one kind, sorted by key."""
    own = table.filter(pa.compute.equal(table.column("kind"), kind))
    keys = [np.frombuffer(k, np.uint32) for k in own.column("keys").to_pylist()]
    if not keys:
        return np.empty(0, np.uint32), np.empty(0, np.int64), None
    ids = np.concatenate([_unpack_ids(i, len(k)) for i, k in zip(own.column("ids").to_pylist(), keys)])
    flat = np.concatenate(keys)
    order = np.argsort(flat, kind="stable")
    info = None if kind == RARE else np.frombuffer(b"".join(own.column("info").to_pylist()), np.uint64).reshape(len(flat), -1)[order]
    return flat[order], ids[order], info


def _leaves_room(n: np.ndarray, m: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """Whether lengths and differing parity bits of rows leave room for the overlap."""
    least = -(-np.maximum(n, m) * 8 // 10)
    return (np.minimum(n, m) >= least) & (differ <= n + m - 2 * least)


def _met(key: tuple, train: pa.Table, held: pa.Table) -> pa.Table:
    """Pairs of a bucket with a key in common that leave room for the overlap, each once."""
    found = []
    for kind in (RARE, SEGMENT, PREFIX):
        t_keys, t_ids, t_info = _unpacked(train, kind)
        h_keys, h_ids, h_info = _unpacked(held, kind)
        if not len(t_keys) or not len(h_keys):
            continue
        begin, end = np.searchsorted(h_keys, t_keys), np.searchsorted(h_keys, t_keys, side="right")
        rows = np.flatnonzero(end > begin)
        upto = np.cumsum((end - begin)[rows])
        own = []
        for a in range(0, int(upto[-1]) if len(upto) else 0, PAIR_BLOCK):
            at = np.arange(a, min(a + PAIR_BLOCK, int(upto[-1])))
            which = np.searchsorted(upto, at, side="right")
            t = rows[which]
            h = end[t] - (upto[which] - at)
            if kind == SEGMENT:
                good = np.bitwise_count(t_info[t, 0] ^ h_info[h, 0]) < SEGMENTS
            elif kind == PREFIX:
                differ = np.bitwise_count(t_info[t, 1] ^ h_info[h, 1]).astype(np.int64) + np.bitwise_count(t_info[t, 2] ^ h_info[h, 2])
                good = _leaves_room(t_info[t, 0].astype(np.int64), h_info[h, 0].astype(np.int64), differ)
            else:
                good = slice(None)
            own.append(np.unique(np.column_stack([t_ids[t][good], h_ids[h][good]]), axis=0) if kind != RARE else np.column_stack([t_ids[t], h_ids[h]]))
        found += own
    pairs = np.concatenate(found) if found else np.empty((0, 2), dtype=np.int64)
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    pairs = pairs[order]
    new = np.r_[True, (np.diff(pairs, axis=0) != 0).any(axis=1)][: len(pairs)]
    return pa.table([pa.array(pairs[new, 0]), pa.array(pairs[new, 1])], names=PAIRS.names)


def _flat(batch: pa.RecordBatch, frequent: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per token: its row, code, and place among the frequent words (-1 for others); per row: id, length."""
    lists = batch.column(batch.schema.get_field_index("tokens"))
    lengths = np.diff(lists.offsets.to_numpy())
    codes = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    if not len(frequent):
        return row, codes, np.full(len(codes), -1), np.asarray(batch.column(0)), lengths
    at = np.minimum(np.searchsorted(frequent, codes), len(frequent) - 1)
    return row, codes, np.where(frequent[at] == codes, at, -1), np.asarray(batch.column(0)), lengths


def _weak(row: np.ndarray, common: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Rows for which the bound on edits of frequent words does not hold, or whose segments would be too small to tell apart."""
    frequent = np.bincount(row, weights=common, minlength=len(lengths)).astype(int)
    spare = lengths - -(-lengths * 8 // 10)
    rare = lengths - frequent
    # edits that may fall on frequent words if at most COLORS rare ones are shared; the two sides' must stay below SEGMENTS
    return (2 * (spare - rare + COLORS) >= SEGMENTS) | (frequent < 3 * SEGMENTS)


def _occurrences(row: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, and codes that differ for the first, second ... occurrence of a word in its row."""
    order = np.argsort((row << 32) + codes + (1 << 31), kind="stable")
    r, c = row[order], codes[order]
    new = np.ones(len(r), dtype=bool)
    new[1:] = (r[1:] != r[:-1]) | (c[1:] != c[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(len(r)), 0))
    return r, _mix((c + (1 << 32)).astype(np.uint64) * np.uint64(1_000_003) + (np.arange(len(r)) - start).astype(np.uint64)), order


def _dealt(ranks: np.ndarray) -> np.ndarray:
    """The segment of each frequent word: words are dealt in the order of frequency, to and fro, so that no segment has only frequent ones."""
    turn = np.arange(len(ranks)) % (2 * SEGMENTS)
    segment = np.empty(len(ranks), dtype=np.int64)
    segment[np.argsort(-ranks, kind="stable")] = np.where(turn < SEGMENTS, turn, 2 * SEGMENTS - 1 - turn)
    return segment


def _rare_keys(row: np.ndarray, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key, row) of all pairs of rare words that lie in one rare segment."""
    r, occ, _ = _occurrences(row, codes)
    color = ((occ >> np.uint64(17)) % np.uint64(COLORS)).astype(np.int64)
    order = np.argsort(r * COLORS + color, kind="stable")
    occ, group = occ[order], (r * COLORS + color)[order]
    order = np.lexsort((occ, group))
    occ, group = occ[order], group[order]
    for gap in range(1, len(group)):
        same = np.flatnonzero(group[gap:] == group[:-gap])
        if not len(same):
            break
        yield _mix(occ[same] * np.uint64(31) + occ[same + gap]), group[same] // COLORS


def _segment_keys(row: np.ndarray, place: np.ndarray, codes: np.ndarray, segment_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of the segments of frequent words, each as a whole; a segment without words is one as well."""
    own, short = np.unique(row, return_inverse=True)
    sums = np.zeros(len(own) * SEGMENTS, dtype=np.uint64)
    np.add.at(sums, short * SEGMENTS + segment_of[place], _mix(codes + (1 << 32)))
    return _mix(sums + np.uint64(77) + np.tile(np.arange(SEGMENTS, dtype=np.uint64), len(own))), np.repeat(own, SEGMENTS)


def _prefix_keys(row: np.ndarray, codes: np.ndarray, rank: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of the rarest words of each row, one more than may be missing."""
    r, occ, order = _occurrences(row, codes)
    sort = np.lexsort((occ, rank[order], r))
    r, occ = r[sort], occ[sort]
    begin = np.maximum.accumulate(np.where(np.r_[True, r[1:] != r[:-1]], np.arange(len(r)), 0))
    keep = (np.arange(len(r)) - begin) <= (lengths - -(-lengths * 8 // 10))[r]
    return occ[keep], r[keep]


def _weak_keys(frequent: np.ndarray, ranks: np.ndarray):
    """(side, key) of the prefixes of weak rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row, codes, place, _, lengths = _flat(batch, frequent)
                pick = _weak(row, place >= 0, lengths)[row]
                if not pick.any():
                    continue
                rank = np.where(place >= 0, ranks[place], 0)[pick] if len(ranks) else np.zeros(int(pick.sum()), dtype=np.int64)
                keys, r = _prefix_keys(row[pick], codes[pick], rank, lengths)
                sides = np.asarray(batch.column(batch.schema.get_field_index("side")))[r]
                yield pa.RecordBatch.from_arrays([pa.array(sides.astype(np.int32)), pa.array(keys.view(np.int64))], names=["side", "key"])

    return run


def _keys(side: int, buckets: int, frequent: np.ndarray, ranks: np.ndarray, wanted: np.ndarray | None, hot: tuple[np.ndarray, np.ndarray]):
    """All keys of the rows of a side: rare pairs, frequent segments, prefixes of weak rows, and of all rows the prefixes that weak rows of the other side want."""
    segment_of = _dealt(ranks)
    mine, other = (np.uint64((1 + s) * 0x51ED270B9A3C4F27) for s in (side, 1 - side))  # keys of weak rows of either side are apart

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        rare, segments, prefixes = _Packer(RARE, buckets, 0), _Packer(SEGMENT, buckets, 1), _Packer(PREFIX, buckets, 3)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            row, codes, place, ids, lengths = _flat(batch, frequent)
            prints, s0, s1 = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("print", "s0", "s1"))
            if len(seen) > SEEN_LIMIT:
                seen.clear()
            first = np.fromiter((p not in seen and not seen.add(p) for p in prints.tolist()), dtype=bool, count=len(prints))
            if len(hot[0]):
                at = np.minimum(np.searchsorted(hot[0], prints), len(hot[0]) - 1)
                first = np.where(hot[0][at] == prints, hot[1][at] == ids, first)
            pick = first[row]
            row, codes, place = row[pick], codes[pick], place[pick]
            common = place >= 0
            for keys, r in _rare_keys(row[~common], codes[~common]):
                yield from rare.add(keys, ids[r])
            weak = _weak(row, common, lengths)
            strong = common & ~weak[row]
            if strong.any():
                bit = (_mix(codes[strong] + (1 << 32)) >> np.uint64(33)) % np.uint64(64)
                sign = _parities(row[strong], bit, len(lengths), 64)[:, 0]
                keys, r = _segment_keys(row[strong], place[strong], codes[strong], segment_of)
                yield from segments.add(keys, ids[r], sign[r])
            if wanted is None or len(wanted) or weak.any():
                rank = np.where(common, ranks[place], 0) if len(ranks) else np.zeros(len(codes), dtype=np.int64)
                keys, r = _prefix_keys(row, codes, rank, lengths)
                own = weak[r]
                yield from prefixes.add(_mix(keys[own] ^ mine), ids[r[own]], lengths[r[own]], s0[r[own]], s1[r[own]])
                if wanted is not None:
                    few = (wanted[np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)] == keys) if len(wanted) else np.zeros(len(keys), dtype=bool)
                    keys, r = keys[few], r[few]
                yield from prefixes.add(_mix(keys ^ other), ids[r], lengths[r], s0[r], s1[r])
        for packer in (rare, segments, prefixes):
            yield packer.flush()

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of the words of a partition."""
    sums: dict[int, int] = {}
    out = lambda: pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.int64())], names=["code", "n"])
    for batch in batches:
        codes, n = np.unique(batch.column(0).flatten().to_numpy(zero_copy_only=False), return_counts=True)
        for c, k in zip(codes.tolist(), n.tolist()):
            sums[c] = sums.get(c, 0) + k
        if len(sums) > 1_000_000:
            yield out()
            sums.clear()
    yield out()


def _room(n, m, differ):
    """Whether the lengths of two rows, and the parity bits in which they differ, leave room for the overlap."""
    least = F.ceil(F.greatest(n, m) * 8 / 10)
    return (F.least(n, m) >= least) & (differ <= n + m - 2 * least)


def _apart(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        sorted_a, sorted_b = [sorted(words(t)) for t in pdf["text_a"]], [sorted(words(t)) for t in pdf["text_b"]]
        shared = [overlap(a, b) for a, b in zip(sorted_a, sorted_b)]
        out = pd.DataFrame({"train_id": pdf["train_id"], "held_out_id": pdf["held_out_id"], "shared": shared, "longer": [max(len(a), len(b)) for a, b in zip(sorted_a, sorted_b)]})
        yield out[out["shared"] > 0]


def _bounded_words(counts: DataFrame, more_than: float) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the frequent words, sorted by code: the ``FREQUENT_LIMIT`` most frequent ones."""
    listed = counts.where(F.col("count") > more_than).orderBy(F.desc("count"), "code").limit(FREQUENT_LIMIT).toArrow()
    codes, ranks = (np.asarray(listed.column(c)).astype(np.int64) for c in ("code", "count"))
    order = np.argsort(codes)
    return codes[order], ranks[order]


def _hot_copies(tokens: DataFrame) -> pa.Table:
    """(side, print, id) of the canonical strings with very many copies: their hash and the id that stands for them."""
    copies = tokens.groupBy("side", "print").agg(F.count("*").alias("copies"), F.min("id").alias("id")).where(F.col("copies") >= HOT_COPIES)
    return copies.orderBy(F.desc("copies"), "print", "side").limit(HOT_LIMIT).select("side", "print", "id").toArrow()


def _hot_of(listed: pa.Table, side: int) -> tuple[np.ndarray, np.ndarray]:
    own = np.asarray(listed.column("side")) == side
    prints, ids = (np.asarray(listed.column(c)).astype(np.int64)[own] for c in ("print", "id"))
    order = np.argsort(prints)
    return prints[order], ids[order]


def cross_split_classes(df: DataFrame, id_col: str, text_col: str, held_out) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): overlaps between canonical strings, and the rows of each string.

    ``pairs`` has (train_class, held_out_class, shared, longer), ``members`` (side, class, id), where a class is the id of
    a row that stands for all rows of its side with the same words. ``members`` covers the classes of ``pairs``. For all
    else see ``cross_split_overlaps``.
    """
    spark = df.sparkSession
    side = F.when(held_out, HELD_OUT).when(~held_out, TRAIN)
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), side.alias("side"), F.col(f"`{text_col}`").alias("text")).where("id is not null and side is not null and text is not null")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/overlap-{uuid.uuid4().hex}"
    rows.mapInArrow(_tokenise, TOKENS).write.option("compression", "zstd").partitionBy("side").parquet(path)
    tokens = spark.read.schema(TOKENS).parquet(path)
    total = tokens.count()
    counts = tokens.select("tokens").mapInArrow(_count, "code int, n long").groupBy("code").agg(F.sum("n").alias("count"))
    codes, ranks = _bounded_words(counts, max(3.0, FREQUENT_SHARE * total))
    hot = _hot_copies(tokens)
    coded = tokens.select("id", "side", "print", "s0", "s1", "tokens")
    weak = coded.select("id", "side", "tokens").mapInArrow(_weak_keys(codes, ranks), "side int, key long").distinct()
    few = weak.limit(WEAK_LIMIT + 1).toArrow()
    within = few.num_rows <= WEAK_LIMIT

    def wanted(by: int) -> np.ndarray | None:
        keys = np.asarray(few.column("key")).view(np.uint64)[np.asarray(few.column("side")) == by]
        return np.sort(keys) if within else None

    def keys(side: int):
        run = _keys(side, max(12, total // BUCKET_ROWS), codes, ranks, wanted(1 - side), _hot_of(hot, side))
        return coded.where(F.col("side") == side).drop("side").mapInArrow(run, PACKED).groupBy("bucket")

    candidates = keys(TRAIN).cogroup(keys(HELD_OUT)).applyInArrow(_met, PAIRS).distinct()
    # chance meetings of two rare words leave here, before any text is moved
    signs = lambda which, name: tokens.where(F.col("side") == which).select(F.col("id").alias(name), "n", "s0", "s1").alias(name)
    both = candidates.join(signs(TRAIN, "train_id"), "train_id").join(signs(HELD_OUT, "held_out_id"), "held_out_id")
    differ = _apart("train_id.s0", "held_out_id.s0") + _apart("train_id.s1", "held_out_id.s1")
    pairs = cut_lineage(both.where(_room(F.col("train_id.n"), F.col("held_out_id.n"), differ)).select("train_id", "held_out_id"))
    found = _verified_pairs(rows, pairs)
    members = cut_lineage(_members(tokens, found))
    remove_path(spark, path)
    # ids of one class may differ between partitions: the least id of a class stands for all of them
    of = lambda which, name: members.where((F.col("side") == which) & F.col("named")).select(F.col("id").alias(name), F.col("class").alias(f"{name[:-3]}_class"))
    classes = found.join(of(TRAIN, "train_id"), "train_id").join(of(HELD_OUT, "held_out_id"), "held_out_id").select("train_class", "held_out_class", "shared", "longer").distinct()
    return classes, members.select("side", "class", "id")


def _verified_pairs(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(train_id, held_out_id, shared, longer) of the pairs whose texts overlap."""
    ids = pairs.select(F.col("train_id").alias("id")).unionAll(pairs.select(F.col("held_out_id").alias("id"))).distinct()
    texts = cut_lineage(rows.join(bounded_broadcast(ids, 1_000_000), "id", "left_semi").dropDuplicates(["id"]).select("id", "text"))
    with_a = pairs.join(texts.select(F.col("id").alias("train_id"), F.col("text").alias("text_a")), "train_id")
    both = with_a.join(texts.select(F.col("id").alias("held_out_id"), F.col("text").alias("text_b")), "held_out_id")
    schema = "train_id long, held_out_id long, shared int, longer int"
    return cut_lineage(both.select("train_id", "held_out_id", "text_a", "text_b").mapInPandas(_verified, schema))


def _members(tokens: DataFrame, found: DataFrame) -> DataFrame:
    """(side, class, id, named): all rows with the canonical string of a found one; ``named`` are those that were found."""
    same = ["side", "print", "n", "s0", "s1"]
    each = found.select(F.lit(TRAIN).alias("side"), F.col("train_id").alias("id")).unionAll(found.select(F.lit(HELD_OUT).alias("side"), F.col("held_out_id").alias("id"))).distinct()
    each = bounded_broadcast(each.withColumn("named", F.lit(True)), 1_000_000)
    strings = tokens.join(each, ["side", "id"], "left_semi").select(*same).distinct()
    whole = tokens.select("id", *same).join(bounded_broadcast(strings, 1_000_000), same, "left_semi").distinct()
    least = whole.groupBy(*same).agg(F.min("id").alias("class"))
    return whole.join(least, same).join(each, ["side", "id"], "left").select("side", "class", "id", F.coalesce("named", F.lit(False)).alias("named"))


def cross_split_overlaps(df: DataFrame, id_col: str, text_col: str, held_out) -> DataFrame:
    """(train_id, held_out_id, shared, longer): all pairs of a train row and a held-out row with 80 % of their words in common.

    ``held_out`` is a boolean column; rows where it is null take no part, nor do texts that are null or without words.
    Ids must be whole numbers and unique but for repeated rows, which count once. Exact at every size: the word counts
    and keys cover all rows, and no group of candidates is capped. The table of word codes is written to the shared
    checkpoint folder and removed; the lists that reach the driver are bounded: the frequent words, the keys of weak rows,
    and the canonical strings with the most copies. Where one string has very many copies on both sides, take
    ``cross_split_classes``: here they are multiplied out.
    """
    classes, members = cross_split_classes(df, id_col, text_col, held_out)
    of = lambda side, name: members.where(F.col("side") == side).select(F.col("class").alias(f"{name[:-3]}_class"), F.col("id").alias(name))
    return classes.join(of(TRAIN, "train_id"), "train_class").join(of(HELD_OUT, "held_out_id"), "held_out_class").select("train_id", "held_out_id", "shared", "longer")
