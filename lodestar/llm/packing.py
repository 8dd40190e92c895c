"""Best-fit packing by bin completion over the histogram of lengths.

How documents pack depends on their lengths alone, and there are no more lengths than a
sequence has tokens. So the driver packs a histogram of at most `size` counts, whatever
the number of documents: it gets patterns (how many sequences, holding which lengths),
and the documents of a length are then dealt to the places of the patterns by rank.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, freed, text_bytes
from .tokens import ids_each

#: Sequences at the end of a plan that the search takes apart, and fillings it looks at. Both bound time, not what is packed.
TAIL, EFFORT = 200, 200_000


def lower_bound(counts: dict[int, int], size: int) -> int:
    """Martello and Toth's L2: documents over half a sequence need one each, and what their sequences cannot take needs more."""
    have = sorted((n, c) for n, c in counts.items() if c)
    lengths = [n for n, _ in have]
    number, tokens = [0, *accumulate(c for _, c in have)], [0, *accumulate(n * c for n, c in have)]
    half = bisect_right(lengths, size / 2)
    most = -(-tokens[-1] // size)
    for i in range(half):
        alone = bisect_right(lengths, size - lengths[i])  # from here on nothing as long as this one fits in
        room = (number[alone] - number[half]) * size - (tokens[alone] - tokens[half])
        most = max(most, number[-1] - number[half] + max(0, -(-(tokens[half] - tokens[i] - room) // size)))
    return max(most, number[-1] - number[half])


def _best_fit(have: list[tuple[int, int]], room: int) -> list[tuple[int, int]]:
    """Greedy best fit: ever the longest that still fits."""
    out = []
    for n, k in have:
        if n <= room:
            out.append((n, take := min(k, room // n)))
            room -= take * n
    return out


def _fullest(have: list[tuple[int, int]], room: int) -> list[tuple[int, int]]:
    """A filling of room with the least waste; of those the one whose longest documents are longest.

    Which sums the lengths from each place on can make is one integer, a bit for each sum.
    """
    have = [(n, min(k, room // n)) for n, k in have if n <= room]
    mask, sums = (1 << room + 1) - 1, [1]
    for n, k in reversed(have):
        can, step = sums[-1], 1
        while k:
            take = min(step, k)
            can |= can << take * n & mask
            k, step = k - take, step * 2
        sums.append(can)
    sums.reverse()
    left, out = sums[0].bit_length() - 1, []
    for i, (n, k) in enumerate(have):
        take = next(t for t in range(min(k, left // n), -1, -1) if sums[i + 1] >> left - t * n & 1)
        if take:
            out.append((n, take))
            left -= take * n
    return out


Pattern = tuple[int, list[tuple[int, int]]]


def _patterns(counts: dict[int, int], size: int, completed: bool) -> list[Pattern]:
    """A plan without going back: each filling around the largest document, as often as the histogram allows."""
    left = {n: c for n, c in counts.items() if c}
    lengths = sorted(left, reverse=True)
    out = []
    while lengths:
        largest = lengths[0]
        room = size - largest
        have = [(n, k) for n in lengths if n <= room and (k := left[n] - (n == largest)) > 0]
        fill = _best_fit(have, room)
        if completed and sum(n * k for n, k in fill) < room:
            fill = _fullest(have, room)
        need = dict(fill)
        need[largest] = need.get(largest, 0) + 1
        times = min(left[n] // k for n, k in need.items())
        out.append((times, sorted(need.items(), reverse=True)))
        for n, k in need.items():
            left[n] -= k * times
        lengths = [n for n in lengths if left[n]]
    return out


def _dominated(fill: list[int], waste: int, spare: list[int]) -> bool:
    """Whether one document, or two, of a filling could give way to a longer one (or one at least as long as both) that still fits.

    What gives way fits where the other would have stood, so such a filling need not be tried.
    """
    kinds = sorted(set(fill))
    for i, x in enumerate(kinds):
        at = bisect_right(spare, x)
        if at < len(spare) and spare[at] <= x + waste:
            return True
        for y in kinds[i:]:
            if y != x or fill.count(x) > 1:
                at = bisect_left(spare, x + y)
                if at < len(spare) and spare[at] <= x + y + waste:
                    return True
    return False


def _completed(counts: dict[int, int], size: int, used: int, least: int, effort: int) -> list[list[int]] | None:
    """A plan of fewer than `used` sequences by branch and bound over sequences, or None.

    Each sequence takes the largest document left and one of its undominated fillings,
    longest documents first. A branch ends when its waste exceeds what fewer sequences may
    waste in all, or when the bound of what is left reaches the incumbent. Sequences with
    the same largest document come in falling order, as their order does not matter.
    """
    left = {n: c for n, c in counts.items() if c}
    total = sum(n * c for n, c in left.items())
    steps, best, plan = 0, None, []

    def fillings(lengths: list[int], i: int, room: int, most: int, taken: list[int]):
        nonlocal steps
        steps += 1
        for j in range(bisect_left(lengths, -room, i, key=lambda n: -n), len(lengths)):
            n = lengths[j]
            for take in range(min(left[n], room // n), 0, -1):
                if steps > effort:
                    return
                left[n] -= take
                yield from fillings(lengths, j + 1, room - take * n, most, taken + [n] * take)
                left[n] += take
        if room <= most:  # what is taken stays out of left while the caller goes on from here
            spare = sorted(n for n in lengths if left[n])
            if not (spare and spare[0] <= room) and not _dominated(taken, room, spare):
                yield list(taken)

    def search(wasted: int, before: list[int] | None) -> bool:
        """Goes on from the sequences in plan; True once there is nothing more to gain."""
        nonlocal best, used
        if not any(left.values()):
            used, best = len(plan), [list(x) for x in plan]
            return used <= least
        if len(plan) + lower_bound(left, size) >= used:
            return False
        lengths = sorted((n for n in left if left[n]), reverse=True)
        largest = lengths[0]
        left[largest] -= 1
        try:
            for fill in fillings(lengths, 0, size - largest, (used - 1) * size - total - wasted, []):
                if before and before[0] == largest and [largest, *fill] > before:
                    continue
                waste = size - largest - sum(fill)
                if wasted + waste > (used - 1) * size - total:  # the incumbent may be a better one by now
                    continue
                plan.append([largest, *fill])
                done = search(wasted + waste, plan[-1])
                plan.pop()
                if done or steps > effort:
                    return True
        finally:
            left[largest] += 1
        return False

    search(0, None)
    return best


def bin_patterns(counts: dict[int, int], size: int, tail: int = TAIL, effort: int = EFFORT) -> list[Pattern]:
    """[(how many sequences, [(length, how many)])] by bin completion.

    First plans without going back are made, by fullest fillings and by best fit alone; the
    shorter is the incumbent. Where it misses the lower bound, branch and bound takes its
    last `tail` sequences apart (all, if there are no more) and looks for fewer, giving up
    after `effort` fillings. So small plans are exact, and for large ones, which all but
    always meet the bound, the search cannot run away.
    """
    found = _patterns(counts, size, True)
    count = lambda p: sum(t for t, _ in p)
    least = lower_bound(counts, size)
    if count(found) <= least:
        return found
    plain = _patterns(counts, size, False)
    if count(plain) < count(found):
        found = plain
    if count(found) <= least:
        return found
    kept, apart, n = list(found), [], 0
    while kept and n < tail:
        times, held = kept.pop()
        take = min(times, tail - n)
        if times > take:
            kept.append((times - take, held))
        apart.append((take, held))
        n += take
    rest = Counter()
    for times, held in apart:
        for length, k in held:
            rest[length] += times * k
    better = _completed(rest, size, n, least - count(kept), effort)
    if not better:
        return found
    return kept + [(times, sorted(Counter(x).items(), reverse=True)) for x, times in Counter(map(tuple, better)).items()]


def pieces(docs: DataFrame, vocabulary: str, size: int, id_col: str, text_col: str) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of each document: its ids, then id 0."""
    kind = docs.schema[id_col].dataType.simpleString()

    def encode(batches):
        for batch in batches:
            rows = []
            for i, ids in enumerate(ids_each(batch.column(1).to_pylist(), vocabulary)):
                ids += b"\0\0\0\0"
                for k, x in enumerate(range(0, len(ids), 4 * size)):
                    rows.append((i, k, x // 4, len(part := ids[x : x + 4 * size]) // 4, zlib.crc32(part)))
            at, k, start, length, crc = zip(*rows, strict=True) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(k, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text")).mapInArrow(freed(encode), f"id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, vocabulary: str, size: int = 2048, id_col: str = "doc_id", text_col: str = "text", per_bucket: int = 20_000) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Only documents of more than size tokens are cut. A null text is empty: its one piece is
    the closing id 0. Repeated rows are packed as often as they stand there, a null id too.
    Other columns are ignored; an empty table gives no rows.

    Pieces of a length are ranked in hash buckets of about per_bucket rows, so that a length
    that holds a third of all rows spreads over many tasks.
    """
    cuts = cut(pieces(docs, vocabulary, size, id_col, text_col))
    counts = {r[0]: r[1] for r in cuts.groupBy("length").count().collect()}  # at most size rows
    total = sum(counts.values())
    key, lo, base, many, offset, first = [], [], [], [], [], 0
    used = dict.fromkeys(counts, 0)
    for times, held in bin_patterns(counts, size):
        at = 0
        for n, k in held:
            for x, v in ((key, n), (lo, used[n]), (base, first), (many, k), (offset, at)):
                x.append(v)
            used[n] += times * k
            at += n * k
        first += times
    table = np.array([key, lo, base, many, offset], np.int64).reshape(5, -1)
    table = table[:, np.lexsort((table[1], table[0]))]
    shared = docs.sparkSession.sparkContext.broadcast(table)  # a few entries for each length

    buckets = max(64, total // per_bucket)
    salted = cuts.withColumn("__b", F.pmod(F.xxhash64("id", "piece", "ids_crc32", "start"), F.lit(buckets)))
    sizes = salted.groupBy("length", "__b").count()
    before = Window.partitionBy("length").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "__b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("length", "__b").orderBy("id", "piece", "ids_crc32"))
    ranked = salted.withColumn("__in", within).join(starts, ["length", "__b"]).withColumn("__rank", F.col("__before") + F.col("__in") - 1)

    def place(batches):
        t = shared.value
        keys = t[0] << 44 | t[1]
        for x in batches:
            n, rank = x.column("length").to_numpy(), x.column("__rank").to_numpy()
            i = np.searchsorted(keys, n << 44 | rank, "right") - 1
            j = rank - t[1][i]
            put = [t[2][i] + j // t[3][i], t[4][i] + j % t[3][i] * n]
            yield pa.RecordBatch.from_arrays([*x.columns[:5], *(pa.array(v, pa.int64()) for v in put)], names=[*x.schema.names[:5], "sequence_id", "offset"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = ranked.select("id", "piece", "start", "length", "ids_crc32", "__rank").mapInArrow(place, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
