"""Evaluation texts leaking into training text: a prefix-filtered set join on rare shingles, verified by exact passages.

A passage that counts as a repeat has at most one deviating unit in eight, so it holds runs of ``RUN`` equal units; the
runs of an item are its shingles, ordered by their counts over all documents. Half of an item in passages holds at least
``least_hits`` of its shingles, so all but the ``least_hits - 1`` most common ones are the necessary prefix:

* Each document is tokenised once; of its shingles only those of any item are kept, with the numbers of the document's
  units (one number for all that no item has), in a table in the shared folder. Documents without such a shingle end here.
* The counts of the shingles come from that table, and rank the shingles of each item.
* The table is joined with the prefixes on the shingle; what meets are candidate pairs of a document and an item.
* Pairs with fewer hits than ``least_hits``, or whose hits leave no room for passages around them (length and positional
  bounds), are dropped. What is left is verified exactly: the best alignments through each equal unit around the hits
  decide whether it lies in a passage, and the repeated units are counted.

Items are taken in blocks of ``ITEM_LIMIT``, each of which is sent once to every executor and joined with all documents.
"""

from __future__ import annotations

import html
import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from decidra.session import cut_lineage, ensure_checkpoint_dir, remove_path

#: Items that are sent to every executor at once; more are joined in blocks.
ITEM_LIMIT = 50_000
#: Documents of a batch that are worked on at once, so that the memory of a task doesn't follow the size of its batches.
DOCS_AT_ONCE = 2_000
#: A passage of 10 words with one deviation has a run of at least 5; of 20 characters with two, of 6.
RUN, RUN_CJK = 5, 6
LEAST, LEAST_CJK, ONE_IN = 10, 20, 8
_TAG = re.compile(r"<[^<>]{0,200}>")
_CJK = "㐀-䶿一-鿿぀-ゟ゠-ヿ々ー"
_UNIT = re.compile(rf"[{_CJK}]|[^\W_{_CJK}]+")
#: All ASCII characters that are no letter or digit become spaces.
_ASCII = bytes(b if chr(b).isalnum() and b < 128 else 32 for b in range(256))
_HAS_CJK = re.compile(rf"[{_CJK}]")


def units(text: str, by_char: bool) -> list[str]:
    """Words, or for Chinese and Japanese characters; without case, punctuation, layout and markup."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    text = text.casefold()
    if not by_char:
        return text.encode().translate(_ASCII).decode().split() if text.isascii() else _UNIT.findall(text)
    return [c for c in text if c.isalnum()]


def _codes(words: list[str], numbers: dict[str, int]) -> np.ndarray:
    """The numbers of the units, from 2 on; 1 for those that no item has, as they equal nothing."""
    return np.fromiter(map(numbers.get, words, repeat(1)), dtype=np.int32, count=len(words))


def shingles(codes: np.ndarray, run: int) -> np.ndarray:
    """Hashes of all runs of so many units."""
    if len(codes) < run:
        return np.empty(0, dtype=np.uint64)
    codes, out = codes.astype(np.uint64), np.zeros(len(codes) - run + 1, dtype=np.uint64)
    for k in range(run):
        out = (out ^ (codes[k : len(codes) - run + 1 + k] * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(29)
    return out


def _area(window: tuple[int, int, int, int]) -> int:
    return (window[1] - window[0]) * (window[3] - window[2] + 1)


def covered(pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], least: int) -> list[np.ndarray]:
    """For (document, item, windows): which units of the item lie, equal, in any passage of the document.

    A passage is an alignment of a stretch of the item with one of the document that begins and ends with equal units, has
    ``least`` columns or more, and of which at most one in eight is a changed, inserted or left out unit. Passages may
    overlap. With +1 for an equal and -7 for a deviating column the bound is a sum of at least 0, so an equal unit
    counts if the best sums before and behind it do, over all lengths that add up. A window (from, to, diagonal, reach, begin
    and end of its run) is the part of the item, and the diagonals, that the passages through one run of hits can take.
    """
    out = [np.zeros(len(item), dtype=bool) for _, item, _ in pairs]
    jobs = []
    for k, (_, _, windows) in enumerate(pairs):
        merged: list[tuple[int, int, int, int]] = []
        for low, high, diagonal, reach in sorted(windows[:, :4].tolist(), key=lambda w: (w[2], w[0])):
            new = (low, high, diagonal - reach, diagonal + reach)
            for i, old in enumerate(merged):  # one search of both if it is no larger than two
                both = (min(old[0], new[0]), max(old[1], new[1]), min(old[2], new[2]), max(old[3], new[3]))
                if _area(both) <= _area(old) + _area(new):
                    merged[i] = both
                    break
            else:
                merged.append(new)
        jobs += [((right - left + 1) // 2, high - low, k, low, (left + right) // 2) for low, high, left, right in merged]
    jobs.sort()
    while jobs:
        reach, n = jobs[-1][:2]
        most = max(1, min(512, 3_000_000 // (2 * reach + 1) // least))
        part = [j for j in jobs[-most:] if 4 * j[0] >= 3 * reach]
        del jobs[-len(part) :]
        _search([(k, pairs[k][0], pairs[k][1][low : low + size], low, diagonal + low) for _, size, k, low, diagonal in part], reach, least, out)
    return out


def within_reach(flat: np.ndarray, doc_end: np.ndarray, codes: np.ndarray, first_code: np.ndarray, pair: np.ndarray, item: np.ndarray, place: np.ndarray, at: np.ndarray, doc: np.ndarray, run: int, least: int) -> tuple[np.ndarray, ...]:
    """For the hits of many pairs: (units of each pair that may lie in passages, those that surely do, and by pair the windows of runs that may).

    ``flat`` and ``codes`` are the units of all documents and of all items, ``doc_end`` and ``first_code`` their limits;
    a hit has its pair (numbered from 0), item, place in the item, place in ``flat``, and document. Hits are given in the
    order of pair, diagonal and place.

    A passage with d deviating units has at least 7 d - (run - 1) (d + 1) hits, all within d diagonals of each other; so
    the hits around a run bound d, and with it the length. Of the units so near that have an equal unit so near, seven in
    eight are needed from end to end of a passage. No fewer units are counted than ``covered`` finds. Those that surely lie
    in passages do so on one diagonal: no more are counted than ``covered`` finds.
    """
    n_of = np.diff(first_code)
    diagonal = at - place
    begins = np.r_[True, (np.diff(pair) != 0) | (np.diff(diagonal) != 0) | (np.diff(place) > 1)]
    first = np.flatnonzero(begins)
    last = np.r_[first[1:], len(place)] - 1
    own, shift, begin, end, n = pair[first], diagonal[first], place[first], place[last], n_of[item[first]]
    wide = 4 * (len(flat) + len(codes) + 1)
    keys = pair * wide + diagonal + wide // 4
    reach = n // (ONE_IN - 1)
    for _ in range(3):  # any number of rounds is right, more are closer
        low, high = own * wide + shift + wide // 4 - reach, own * wide + shift + wide // 4 + reach
        near = np.searchsorted(keys, high, side="right") - np.searchsorted(keys, low)
        reach = np.minimum(reach, (near + run - 1) // (ONE_IN - run))
    longs = np.minimum(near + reach + (run - 1) * (reach + 1), n + run)
    lows, highs = np.maximum(0, begin + run - longs), np.minimum(n, end + longs)
    pairs_n = int(pair[-1]) + 1
    # pairs whose windows are too small in all
    order = np.lexsort((lows, own))
    far = int(n.max()) + 1
    begin_at, end_at = (own * far + lows)[order], (own * far + highs)[order]
    before = np.r_[0, np.maximum.accumulate(end_at)[:-1]]
    room = np.bincount(own[order], weights=np.maximum(0, end_at - np.maximum(begin_at, before)), minlength=pairs_n)
    alive = np.flatnonzero(2 * room[own] >= n)
    order = alive[np.lexsort(((highs - lows)[alive], reach[alive]))]
    cells, sure, good = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)], np.zeros(len(place), dtype=bool)
    longest = int(n.max()) + 1
    at_once = 1_000_000
    k = 0
    while k < len(order):
        r = int(reach[order[k]])
        many = max(1, at_once // ((2 * r + 1) * max(1, int((highs - lows)[order[k]]))))
        part = order[k : k + many]
        part = part[reach[part] == r]
        k += len(part)
        low, high = lows[part], highs[part]
        span = np.arange(int((high - low).max()))
        inside = span < (high - low)[:, None]
        mine = codes[np.minimum(first_code[item[first[part]]][:, None] + low[:, None] + span, len(codes) - 1)]
        d = doc[first[part]]
        ends, starts = doc_end[d + 1][:, None], doc_end[d][:, None]
        same = np.zeros(mine.shape, dtype=bool)
        middle = (shift[part] + low)[:, None] + span
        for step in range(-r, r + 1):
            where = middle + step
            equal = (flat[np.clip(where, 0, len(flat) - 1)] == mine) & (where >= starts) & (where < ends) & inside
            same |= equal
            if step == 0:
                straight = equal
        points = np.arange(span.size + 1)
        tail, head = points >= (end[part] + run - low)[:, None], points <= (begin[part] - low)[:, None]
        sums = _running(same, points, high - low)
        start = np.argmax(sums <= np.where(tail, sums, -(10**9)).max(axis=1)[:, None], axis=1)
        stop = span.size - np.argmax((sums >= np.where(head, sums, 10**9).min(axis=1)[:, None])[:, ::-1], axis=1)
        far = stop - start >= least - least // ONE_IN
        good[first[part[far]]] = True
        seen = same & far[:, None] & (span >= start[:, None]) & (span < stop[:, None])
        which, spot = np.nonzero(seen)
        cells.append(own[part[which]] * longest + low[which] + spot)
        # the longest stretches to the left of the best end, and to the right of the best start, both between equal units
        sums = _running(straight, points, high - low)
        best = np.argmax(np.where(tail, sums, -(10**9)), axis=1)
        worst = np.where(head, sums, 10**9).min(axis=1)
        lowest = head.shape[1] - 1 - np.argmax((np.where(head, sums, 10**9) == worst[:, None])[:, ::-1], axis=1)
        first_equal = _first_equal(straight, np.argmax(sums <= np.take_along_axis(sums, best[:, None], axis=1), axis=1))
        last_equal = span.size - _first_equal(straight[:, ::-1], np.argmax((sums >= worst[:, None])[:, ::-1], axis=1))
        for a, b in ((first_equal, best), (lowest, last_equal)):
            seen = straight & (b - a >= least)[:, None] & (span >= a[:, None]) & (span < b[:, None])
            which, spot = np.nonzero(seen)
            sure.append(own[part[which]] * longest + low[which] + spot)
    count = lambda x: np.bincount(np.unique(np.concatenate(x)) // longest, minlength=pairs_n)
    chosen = np.flatnonzero(good[first])
    return count(cells), count(sure), own[chosen], np.column_stack([lows, highs, shift, reach, begin, end + run])[chosen]


def _running(equal: np.ndarray, points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Running sums of +1 for equal and -7 for other units by row; beyond the size of a row far below all others."""
    sums = np.concatenate([np.zeros((len(equal), 1), dtype=np.int64), np.cumsum(np.where(equal, 1, 1 - ONE_IN), axis=1)], axis=1)
    return np.where(points <= sizes[:, None], sums, -(10**6))


def _first_equal(equal: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first equal unit of each row from a position on."""
    return np.argmax(equal & (np.arange(equal.shape[1]) >= at[:, None]), axis=1)


def plausible(pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], least: int) -> list[tuple[int, np.ndarray]]:
    """For (document, item, windows): no fewer units than ``covered`` finds, and the windows that are left.

    A passage through a run holds, with no less a sum, the whole run. So the best sums from the run on to both sides tell
    which equal units any of them can reach, whatever its length; of a passage of ``least`` columns, seven in eight are such.
    """
    jobs = [(int(w[3]), max(int(w[1] - w[5]), int(w[4] - w[0])), k, j) for k, (_, _, windows) in enumerate(pairs) for j, w in enumerate(windows)]
    reached = [np.zeros(len(item), dtype=bool) for _, item, _ in pairs]
    kept: list[list[int]] = [[] for _ in pairs]
    jobs.sort()
    while jobs:
        reach, n = jobs[-1][:2]
        part = [j for j in jobs[-max(1, min(1024, 4_000_000 // ((2 * reach + 1) * max(n, 1)))) :] if 4 * j[0] >= 3 * reach]
        del jobs[-len(part) :]
        n = max(j[1] for j in part)
        sides = []
        for step in (1, -1):  # behind the run, then before it with both texts turned round
            items, docs = np.zeros((n, len(part)), dtype=np.int32), np.ones((n + 2 * reach, len(part)), dtype=np.int32)
            for p, (_, _, k, j) in enumerate(part):
                doc, item, windows = pairs[k]
                low, high, diagonal, _, begin, end = windows[j].tolist()
                own = item[end:high] if step == 1 else item[low:begin][::-1]
                items[: len(own), p] = own
                at = end + diagonal - reach if step == 1 else len(doc) - (begin + diagonal) - reach
                text = doc if step == 1 else doc[::-1]
                piece = text[max(0, at) : max(0, at + n + 2 * reach)]
                docs[max(0, -at) : max(0, -at) + len(piece), p] = piece
            sides.append(_from_run([docs[i : i + 2 * reach + 1] == items[i] for i in range(n)], reach, len(part)))
        runs = np.array([pairs[k][2][j][5] - pairs[k][2][j][4] for _, _, k, j in part])
        cells = [through + runs + sides[1 - side][0] >= 0 for side, (_, through) in enumerate(sides)]
        total = runs + cells[0].sum(axis=0) + cells[1].sum(axis=0)
        for p in np.flatnonzero(total >= least - least // ONE_IN).tolist():
            _, _, k, j = part[p]
            low, high, _, _, begin, end = pairs[k][2][j].tolist()
            kept[k].append(j)
            reached[k][begin:end] = True
            reached[k][end:high] |= cells[0][: high - end, p]
            reached[k][low:begin] |= cells[1][: begin - low, p][::-1]
    return [(int(r.sum()), windows[sorted(own)]) for r, own, (_, _, windows) in zip(reached, kept, pairs)]


def _from_run(equal: list[np.ndarray], reach: int, jobs: int) -> tuple[np.ndarray, np.ndarray]:
    """(best sum on this side of the run, by row the best sum through an equal cell of it), for rows that go away from the run.

    A passage may leave the run before its end, with a deletion of s units, for a diagonal on which it meets the rows just
    behind the run: its sum there is at most -8 s + the number of rows, which is let in; farther rows are met no worse from the end.
    """
    wide, cost, none = 2 * reach + 1, ONE_IN - 1, -1_000_000
    shift = cost * np.arange(wide)[:, None]
    state = np.full((wide, jobs), none)
    state[reach] = 0
    state = np.maximum.accumulate(state + shift, axis=0) - shift
    before = []
    for i, e in enumerate(equal):
        early = np.arange(i + 1, reach + 1)
        state[reach - early] = np.maximum(state[reach - early], (i - (cost + 1) * early)[:, None])
        before.append(state)
        new = state + np.where(e, 1, -cost)
        np.maximum(new[:-1], state[1:] - cost, out=new[:-1])  # a unit of the item left out
        state = np.maximum.accumulate(new + shift, axis=0) - shift  # units inserted
    rest = np.zeros((wide, jobs), dtype=np.int64)
    through = np.full((len(equal), jobs), none)
    for i in range(len(equal) - 1, -1, -1):
        e = equal[i]
        through[i] = np.where(e, before[i] + 1 + rest, none).max(axis=0)
        new = rest + np.where(e, 1, -cost)
        np.maximum(new[1:], rest[:-1] - cost, out=new[1:])
        new = np.maximum(new, 0)
        rest = np.maximum.accumulate((new - shift)[::-1], axis=0)[::-1] + shift
    return rest[reach], through


def _search(jobs: list[tuple[int, np.ndarray, np.ndarray, int, int]], reach: int, least: int, out: list[np.ndarray]) -> None:
    """Marks what each job (pair, document, part of the item, its place, diagonal) finds within ``reach`` of its diagonal."""
    n, wide = max(len(item) for _, _, item, _, _ in jobs), 2 * reach + 1
    items, docs = np.zeros((n, len(jobs)), dtype=np.int32), np.ones((n + wide - 1, len(jobs)), dtype=np.int32)  # no code of an item is 0 or 1
    for p, (_, doc, item, _, diagonal) in enumerate(jobs):
        items[: len(item), p] = item
        a = diagonal - reach
        own = doc[max(0, a) : max(0, a + n + wide - 1)]
        docs[max(0, -a) : max(0, -a) + len(own), p] = own
    equal = [docs[i : i + wide] == items[i] for i in range(n)]
    before = list(_sums(equal, least))
    behind = _sums([e[::-1] for e in reversed(equal)], least)
    for i in range(n - 1, -1, -1):
        sums = next(behind)
        found = before.pop()
        where, job = np.nonzero(equal[i])
        order = np.argsort(-where, kind="stable")  # the order of the reversed rows
        good = (found[order] + sums[:, ::-1]).max(axis=1, initial=0) > 0 if len(job) else np.zeros(0, dtype=bool)
        for p in set(job[order][good].tolist()):
            out[jobs[p][0]][jobs[p][3] + i] = True


def _sums(equal: list[np.ndarray], least: int) -> Iterator[np.ndarray]:
    """By row, for its equal cells: the best sums of alignments that end there with 1, 2, ... ``least`` columns or more."""
    none = -10_000_000
    kind = np.int32
    if len(equal) < 1_500:
        none, kind = -15_000, np.int16
    wide, jobs = equal[0].shape
    old = np.full((wide, least, jobs), none, dtype=kind)  # diagonal, columns, job
    cost = kind(ONE_IN - 1)
    shift = (cost * np.arange(wide)).astype(kind)[:, None]
    for e in equal:
        step = np.where(e, kind(1), -cost)
        new = np.empty_like(old)
        np.add(old[:, :-1], step[:, None], out=new[:, 1:])
        new[:, 0] = np.where(e, np.maximum(old[:, 0], 0), old[:, 0]) + step
        yield new.transpose(0, 2, 1)[e]
        less = old[1:] - cost  # a unit of the item left out
        np.maximum(new[:-1, 1:], less[:, :-1], out=new[:-1, 1:])
        np.maximum(new[:-1, 0], less[:, 0], out=new[:-1, 0])
        new[:, 0] = np.maximum.accumulate(new[:, 0] + shift, axis=0) - shift  # units inserted, each a column more
        for k in range(1, least):
            np.maximum(new[1:, k], new[:-1, k - 1] - cost, out=new[1:, k])
        old = np.maximum(new, none)


def least_hits(n: int, run: int, least: int) -> int:
    """No more than the fewest shingles of half of ``n`` units in passages of ``least`` units or more with one deviation in eight.

    Passages may overlap and share shingles. Of passages that cover a stretch enough can be chosen that no unit lies in
    more than two, and these be dealt into two sets without overlaps: one of them covers half of what is needed.
    """
    need = ((n + 1) // 2 + 1) // 2
    fewest = [0] + [10**9] * (need + 2 * least)
    per = {size: max(1, size - run + 1 - run * (size // ONE_IN)) for size in range(least, need + 2 * least)}
    for total in range(1, len(fewest)):
        for size, hits in per.items():
            if size >= total:
                fewest[total] = min(fewest[total], hits)
            else:
                fewest[total] = min(fewest[total], fewest[total - size] + hits)
    return fewest[need]


class Items:
    """The items of one kind (by words or by characters), numbered from 0, with the index of their shingles."""

    def __init__(self, by_char: bool, ids: list[int], texts: list[list[str]]) -> None:
        self.numbers: dict[str, int] = {}
        self.by_char, self.ids = by_char, np.array(ids, dtype=np.int64)
        self.run, self.least = (RUN_CJK, LEAST_CJK) if by_char else (RUN, LEAST)
        each = [np.array([self.numbers.setdefault(u, len(self.numbers) + 2) for u in t], dtype=np.int32) for t in texts]
        self.codes, self.first = np.concatenate([*each, np.empty(0, np.int32)]), np.cumsum([0, *map(len, each)])
        self.lows = np.array([least_hits(len(c), self.run, self.least) for c in each], dtype=np.int64)
        flat = [shingles(c, self.run) for c in each]
        sizes = [len(f) for f in flat]
        self.owners, self.places = np.repeat(np.arange(len(each)), sizes), np.concatenate([np.arange(n) for n in sizes] or [np.empty(0, int)])
        hashes = np.concatenate([*flat, np.empty(0, np.uint64)])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owners, self.places = hashes[order], self.owners[order], self.places[order]
        self._mark()

    def _mark(self) -> None:
        self.some = np.zeros(1 << 24, dtype=bool)
        self.some[(self.hashes >> np.uint64(40)).astype(np.int64)] = True

    def __getstate__(self) -> dict:
        """Without the marks: 16 MB, which every executor would keep on disk, for what it makes of the hashes at once."""
        return {k: v for k, v in self.__dict__.items() if k != "some"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._mark()

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Which hashes are shingles of an item."""
        if not len(self.hashes):
            return np.zeros(len(hashes), dtype=bool)
        out = self.some[(hashes >> np.uint64(40)).astype(np.int64)]  # most hashes end here
        at = np.flatnonzero(out)
        out[at] = self.hashes[np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)] == hashes[at]
        return out

    def find(self, codes: pa.ListArray, hashes: pa.ListArray, at: pa.ListArray, wanted: pa.ListArray, count: bool = True) -> list[tuple[int, int, int, int]]:
        """(document, item id, units repeated, units) of the ``wanted`` items of which a document repeats at least half.

        Without ``count`` the units repeated are at least half, but not all are looked for where half is sure.
        """
        flat, ends = codes.flatten().to_numpy(), codes.offsets.to_numpy() - codes.offsets[0].as_py()
        doc = np.repeat(np.arange(len(hashes)), np.diff(hashes.offsets.to_numpy()))
        s, spot = hashes.flatten().to_numpy().view(np.uint64), at.flatten().to_numpy().astype(np.int64) + ends[doc]
        left = np.searchsorted(self.hashes, s)
        many = np.searchsorted(self.hashes, s, side="right") - left
        entry = np.repeat(left, many) + (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
        doc, spot, total = np.repeat(doc, many), np.repeat(spot, many), len(self.ids)
        asked = np.repeat(np.arange(len(wanted)), np.diff(wanted.offsets.to_numpy())) * total + wanted.flatten().to_numpy()
        pair = doc * total + self.owners[entry]
        pick = np.isin(pair, asked)
        pair, spot, place = pair[pick], spot[pick], self.places[entry[pick]]
        order = np.lexsort((place, spot - place, pair))
        pair, spot, place = pair[order], spot[order], place[order]
        kept = self._enough(pair, place, total)
        pair, spot, place = pair[kept], spot[kept], place[kept]
        if not len(pair):
            return []
        distinct, number = np.unique(pair, return_inverse=True)
        most, sure, of, windows = within_reach(flat, ends, self.codes, self.first, number, pair % total, place, spot, pair // total, self.run, self.least)
        size = np.diff(self.first)[distinct % total]
        some = np.flatnonzero((2 * most >= size) & (most > 0))
        open_ = some[(sure[some] < most[some]) & (count | (2 * sure[some] < size[some]))]
        jobs = []
        for k, a, b in zip(open_.tolist(), np.searchsorted(of, open_), np.searchsorted(of, open_, side="right")):
            d, i = divmod(int(distinct[k]), total)
            jobs.append((flat[ends[d] : ends[d + 1]], self.codes[self.first[i] : self.first[i + 1]], windows[a:b] - np.array([0, 0, ends[d], 0, 0, 0])))
        bounds = plausible(jobs, self.least)
        some_left = [x for x, ((most_left, left), k) in enumerate(zip(bounds, open_.tolist())) if 2 * most_left >= size[k]]
        found = sure.copy()
        found[open_] = 0
        found[open_[some_left]] = [int(c.sum()) for c in covered([(jobs[x][0], jobs[x][1], bounds[x][1]) for x in some_left], self.least)]
        return [(int(distinct[k] // total), int(self.ids[distinct[k] % total]), int(found[k]), int(size[k])) for k in some.tolist() if 2 * found[k] >= size[k]]

    def _enough(self, pair: np.ndarray, place: np.ndarray, total: int) -> np.ndarray:
        """The hits of pairs with at least the fewest places that half of the item must have."""
        if not len(pair):
            return np.zeros(0, dtype=bool)
        wide = int(place.max()) + 1
        owners = np.unique(pair * wide + place) // wide
        distinct, places = np.unique(owners, return_counts=True)
        return np.isin(pair, distinct[places >= self.lows[distinct % total]])


FOUND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("repeated", T.IntegerType()), T.StructField("units", T.IntegerType())])
SCANNED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("by_char", T.BooleanType()), T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("at", T.ArrayType(T.IntegerType()))])


def _by_char(text: str, lang: str | None) -> bool:
    return (lang or "") in ("zh", "ja") or len(_HAS_CJK.findall(text)) * 2 > len(text)


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    flat = np.concatenate(values) if values else np.empty(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(v) for v in values], dtype=np.int64)], pa.int32()), pa.array(flat.view(np.int64) if flat.dtype == np.uint64 else flat, kind))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, DOCS_AT_ONCE):
            yield batch.slice(at, DOCS_AT_ONCE)


def _scan(index: Broadcast[list[Items]]):
    """Of each document with a shingle of an item: its unit codes, and these shingles with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for items in index.value:
                codes = [_codes(units(t, items.by_char), items.numbers) if not items.by_char or _HAS_CJK.search(t) else np.empty(0, dtype=np.int32) for t in texts]
                lengths = np.array([len(c) for c in codes])
                flat, doc, first = np.concatenate([*codes, np.empty(0, np.int32)]), np.repeat(np.arange(len(codes)), lengths), np.r_[0, np.cumsum(lengths)]
                s = shingles(flat, items.run)
                hits = np.flatnonzero(items.known(s) & (doc[: len(s)] == doc[items.run - 1 :][: len(s)]))  # no shingle spans two documents
                some, cut = np.unique(doc[hits], return_index=True)
                parts = list(zip(some.tolist(), cut, np.r_[cut[1:], len(hits)]))
                columns = [
                    pa.array([ids[d] for d, _, _ in parts], pa.int64()), pa.array([items.by_char] * len(parts), pa.bool_()), _lists([codes[d] for d, _, _ in parts], pa.int32()),
                    _lists([s[hits[a:b]] for _, a, b in parts], pa.int64()), _lists([(hits[a:b] - first[d]).astype(np.int32) for d, a, b in parts], pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=SCANNED.names)

    return run


def _verify(index: Broadcast[list[Items]], count: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            for items in index.value:
                own = batch.filter(pa.compute.equal(batch.column("by_char"), items.by_char))
                if own.num_rows:
                    ids = own.column("doc_id").to_pylist()
                    out = [(ids[d], *rest) for d, *rest in items.find(*(own.column(c) for c in ("codes", "hashes", "at", "wanted")), count)]
                    columns = list(zip(*out)) if out else [[]] * 4
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=FOUND.names)

    return run


def leaks(documents: DataFrame, doc_id: str, text_col: str, items: DataFrame, item_id: str, item_text: str, item_lang: str, count: bool = True) -> DataFrame:
    """(doc_id, item_id, repeated, units): the documents that repeat at least half of an item, and how much of it.

    Without ``count``, ``repeated`` is left out: the repeated units of pairs where half of the item is sure are not all looked for.
    Items are compared with every document, over whole texts, ``ITEM_LIMIT`` of them at a time. Items that are null,
    blank, or shorter than a passage give no rows. Null ids and null texts give none; repeated rows count once.
    """
    asked = items.select(F.col(f"`{item_id}`").cast("long").alias("i"), F.col(f"`{item_text}`").alias("t"), F.col(f"`{item_lang}`").alias("l")).where("i is not null and t is not null").distinct()
    docs = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).where("doc_id is not null and text is not null")
    blocks = max(1, -(-asked.count() * 5 // (4 * ITEM_LIMIT)))  # by hash, so a little smaller than the limit
    out = None
    for k in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        found = _leaks_of(docs, part.collect(), count)
        out = found if out is None else out.unionAll(found)
    once = out.groupBy("doc_id", "item_id").agg(F.max("repeated").alias("repeated"), F.max("units").alias("units"))
    return once if count else once.drop("repeated")


def _leaks_of(docs: DataFrame, rows: list, count: bool) -> DataFrame:
    spark = docs.sparkSession
    numbered = []
    for by_char in (False, True):  # an item with several texts is several entries
        own = [(r.i, u) for r in sorted(rows, key=lambda r: (r.i, r.t)) if _by_char(r.t, r.l) == by_char and len(u := units(r.t, by_char)) >= (LEAST_CJK if by_char else LEAST)]
        numbered.append(Items(by_char, [i for i, _ in own], [u for _, u in own]))
    index = spark.sparkContext.broadcast(numbered)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/leaks-{uuid.uuid4().hex}"
    docs.mapInArrow(_scan(index), SCANNED).write.option("compression", "zstd").parquet(path)
    scanned = spark.read.schema(SCANNED).parquet(path)
    # the order of the shingles of each item by rarity, and of these all but the most common ones that it can lack
    counts = scanned.select("by_char", F.explode(F.array_distinct("hashes")).alias("hash")).groupBy("by_char", "hash").agg(F.count("*").alias("docs"))
    entries = pa.concat_tables([pa.table({
        "by_char": pa.array([i.by_char] * len(i.hashes), pa.bool_()), "hash": pa.array(i.hashes.view(np.int64)), "item": pa.array(i.owners.astype(np.int64)), "place": pa.array(i.places.astype(np.int64)),
        "keep": pa.array((np.diff(i.first) - i.run + 1 - i.lows + 1)[i.owners].astype(np.int64) if len(i.hashes) else np.empty(0, np.int64)),
    }) for i in numbered])
    listed = spark.createDataFrame(entries)
    rank = F.row_number().over(Window.partitionBy("by_char", "item").orderBy(F.coalesce("docs", F.lit(0)), "place"))
    prefix = listed.join(counts, ["by_char", "hash"], "left").withColumn("rank", rank).where(F.col("rank") <= F.greatest("keep", F.lit(1))).select("by_char", "hash", "item").distinct()
    hits = scanned.select("doc_id", "by_char", F.explode(F.array_distinct("hashes")).alias("hash"))
    candidates = hits.join(prefix, ["by_char", "hash"]).groupBy("doc_id", "by_char").agg(F.array_sort(F.collect_set("item")).alias("wanted"))
    found = cut_lineage(scanned.join(candidates, ["doc_id", "by_char"]).select("doc_id", "by_char", "codes", "hashes", "at", "wanted").mapInArrow(_verify(index, count), FOUND))
    remove_path(spark, path)
    index.destroy()
    return found
