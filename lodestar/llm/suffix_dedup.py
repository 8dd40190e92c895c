"""Removal of repeated byte strings with per-shard suffix arrays.

A string of `length` bytes has a key: the smallest hash of its 32-byte parts. Equal strings
have equal keys, so neighbouring starts with one key make a run, and only runs whose key
comes up again can hold a repeat. Equal runs are one row. Shards gather the runs of whole
keys, so equal strings meet in a shard: its suffix array (Larsson-Sadakane refinement) and
common prefixes (Kasai) say which starts repeat.

A key too large for one shard is dealt over several by the digest of its runs. Each of them
hands on its sorted strings as sorted digests, one array for each range of digests, and the
arrays of a range are merged by binary search. A key has as many ranges as shards, so no
task holds more of it than about a shard's worth, whatever its size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_bytes

GRAM = 32
#: Bytes hashed at once, starts in a run at most, and bytes of runs in one shard.
SLICE, RUN, SHARD = 1 << 19, 4096, 1 << 20
_RANDOM = np.random.default_rng(7)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = _RANDOM.integers(1, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)


def _sliding(f, x: np.ndarray, width: int) -> np.ndarray:
    """f (idempotent) over each `width` neighbours, by doubling."""
    have, out = 1, x
    while 2 * have <= width:
        out = f(out[:-have], out[have:])
        have *= 2
    return f(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    h, have = _BYTE[b], 1
    for step in _STEP[: GRAM.bit_length() - 1]:
        h = h[:-have] * step + h[have:]
        have *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def runs(buf: bytes, ends: np.ndarray, length: int):
    """(text, start, starts, key, weight) of each run in texts that end at `ends` in buf.

    start counts from the beginning of buf. weight is 2 where the key's part comes up more than once within the run.
    """
    b = np.frombuffer(buf, np.uint8)
    none = np.zeros(0, np.int64)
    if len(b) < length:
        return none, none, none, none, none
    h = _gram_hashes(b)
    width = length - GRAM + 1
    m = _sliding(np.minimum, h, width)
    of = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))[: len(m)]
    ok = np.arange(len(m)) + length <= ends[of]
    new = np.r_[True, (m[1:] != m[:-1]) | (of[1:] != of[:-1])] & ok
    new[1:] |= ok[1:] & ~ok[:-1]
    begin = np.flatnonzero(new)
    if len(begin):  # long runs (repetitive text) go on in another
        since = np.arange(len(m)) - np.repeat(np.r_[0, begin], np.diff(np.r_[0, begin, len(m)]))
        new |= ok & (since % RUN == 0)
        new[: begin[0]] = False
    first = np.flatnonzero(new)
    stop = np.flatnonzero(ok & np.r_[new[1:] | ~ok[1:], True]) + 1
    key = m[first]
    weight = np.ones(len(first), np.int64)
    view = np.lib.stride_tricks.sliding_window_view(h, width)
    for x in range(0, len(first), 4096):
        k = key[x : x + 4096, None]
        a = view[first[x : x + 4096]] == k
        z = view[stop[x : x + 4096] - 1] == k
        lead = first[x : x + 4096] + a.argmax(1)
        last = stop[x : x + 4096] - 1 + width - 1 - z[:, ::-1].argmax(1)
        weight[x : x + 4096][(lead != last)] = 2
    return of[first], first, stop - first, key.view(np.int64), weight


def suffix_array(t: np.ndarray, ends: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order and rank of all suffixes, each up to the end of its segment.

    Larsson-Sadakane: sort by the first seven bytes, then double the sorted depth, each
    time within the groups that are still tied. A suffix that ends sorts before one that
    goes on; of equal ones the earlier segment's comes first.
    """
    n, many = len(t), int(seg[-1]) + 1
    rem = ends - np.arange(n)
    key = np.zeros(n, np.uint64)
    for k in range(7):
        part = np.zeros(n, np.uint64)
        part[: max(0, n - k)] = t[k:]
        part[rem <= k] = 0
        key = key << np.uint64(8) | part
    key = key << np.uint64(3) | np.minimum(rem, 7).astype(np.uint64)
    sa = np.argsort(key, kind="stable")
    k = key[sa]
    slots, h = np.arange(n), 7
    rank = np.empty(n, np.int64)
    while True:
        first = np.r_[True, k[1:] != k[:-1]]
        rank[sa[slots]] = np.maximum.accumulate(np.where(first, slots, 0))
        tied = ~(first & np.r_[first[1:], True])
        slots = slots[tied]
        if not len(slots):
            return sa, rank
        i = sa[slots]
        on = i + h
        second = np.where(on < ends[i], rank[np.minimum(on, n - 1)] + many, seg[i])
        k = rank[i] * np.int64(n + many) + second
        order = np.argsort(k, kind="stable")
        sa[slots], k = i[order], k[order]
        h *= 2


def common_prefixes(t: np.ndarray, ends: np.ndarray, starts: np.ndarray, sa: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each position the length its suffix shares with the one sorted before it.

    Kasai: going on by one position loses at most one byte. All segments go on together.
    """
    n = len(t)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(n, np.int64)
    word = np.zeros(n, np.uint64)
    for k in range(8):
        part = np.zeros(n, np.uint64)
        part[: max(0, n - k)] = t[k:]
        word = word << np.uint64(8) | part
    stop = ends[starts]
    shared = np.zeros(len(starts), np.int64)
    for step in range(int((stop - starts).max())):
        live = np.flatnonzero(starts + step < stop)
        i = starts[live] + step
        j = before[i]
        got = np.maximum(shared[live] - 1, 0)
        got[j < 0] = 0
        most = np.where(j < 0, 0, np.minimum(ends[i] - i, ends[j] - j))
        go = np.flatnonzero(got + 8 <= most)
        while len(go):
            go = go[word[i[go] + got[go]] == word[j[go] + got[go]]]
            got[go] += 8
            go = go[got[go] + 8 <= most[go]]
        go = np.flatnonzero(got < most)
        while len(go):
            go = go[t[i[go] + got[go]] == t[j[go] + got[go]]]
            got[go] += 1
            go = go[got[go] < most[go]]
        out[i] = got
        shared[live] = got
    return out


def repeated(parts: list[bytes], length: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each part which of its starts of `length` bytes come up at another start of any part;
    and the sorted order of the starts, one for each different string, as (part, start)."""
    t = np.frombuffer(b"".join(parts), np.uint8)
    size = np.array([len(p) for p in parts])
    stop = np.cumsum(size)
    seg = np.repeat(np.arange(len(parts)), size)
    ends, starts = stop[seg], stop - size
    sa, rank = suffix_array(t, ends, seg)
    shared = common_prefixes(t, ends, starts, sa, rank)
    # Suffixes too short for the length cannot stand between two that share it.
    same = shared[sa] >= length
    twice = same.copy()
    twice[:-1] |= same[1:]
    mark = np.zeros(len(t), bool)
    mark[sa[twice]] = True
    lone = sa[~same & (ends[sa] - sa >= length)]
    return [mark[a : max(a, z - length + 1)] for a, z in zip(starts, stop, strict=True)], seg[lone], lone - starts[seg[lone]]


def _spans(mark: np.ndarray) -> tuple[list[int], list[int]]:
    """Stretches [a, z) of marked starts."""
    edge = np.flatnonzero(np.diff(np.r_[0, mark.astype(np.int8), 0]))
    return edge[::2].tolist(), edge[1::2].tolist()


#: 128-bit digests in the order of their bytes.
DIGEST = np.dtype([("hi", "<u8"), ("lo", "<u8")])


def met(lists: list[np.ndarray]) -> np.ndarray:
    """The digests that at least two of the sorted lists hold, sorted: lists are merged two by two by binary search."""
    found = [np.zeros(0, DIGEST)]
    while len(lists) > 1:
        merged = []
        for x, y in zip(lists[::2], lists[1::2], strict=False):
            at = np.searchsorted(x, y)
            same = x[np.minimum(at, len(x) - 1)] == y if len(x) else np.zeros(len(y), bool)
            found.append(y[same])
            merged.append(np.insert(x, at[~same], y[~same]))
        lists = merged + lists[len(lists) // 2 * 2 :]
    return np.unique(np.concatenate(found))


def _table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), text_bytes(text_col).alias("text"))


def _all_runs(texts: DataFrame, length: int) -> DataFrame:
    def work(batches):
        from xxhash import xxh3_128_intdigest

        def out(rows: list[tuple[int, int]], held: list[memoryview]):
            buf = b"".join(held)
            ends = np.cumsum([len(x) for x in held])
            of, first, many, key, weight = runs(buf, ends, length)
            begin = np.r_[0, ends[:-1]]
            view = memoryview(buf)
            digest = [xxh3_128_intdigest(view[a : a + k + length - 1]) for a, k in zip(first.tolist(), many.tolist(), strict=True)]
            lo = np.array([d & (1 << 64) - 1 for d in digest], np.uint64).view(np.int64)
            hi = np.array([d >> 64 for d in digest], np.uint64).view(np.int64)
            row, at = np.array(rows, np.int64).T
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (key, hi, lo, row[of], at[of] + first - begin[of], many, weight)], names=["key", "d1", "d2", "row", "at", "starts", "weight"])

        for batch in batches:
            rows, held, size = [], [], 0
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = memoryview(text.as_buffer())
                # A long text goes in slices; strings over their edges begin in the former slice.
                for x in range(0, len(text) - length + 1, SLICE):
                    rows.append((row, x))
                    held.append(text[x : x + SLICE + length - 1])
                    size += len(held[-1])
                    if size > SLICE:
                        yield out(rows, held)
                        rows, held, size = [], [], 0
            if held:
                yield out(rows, held)

    return texts.select("row", "text").mapInArrow(work, "key long, d1 long, d2 long, row long, at long, starts long, weight long")


SHARDED = "kind int, key long, part int, d1 long, d2 long, a array<long>, z array<long>, strings binary, twice binary, run binary"


def _row(kind: int, key, part, d1, d2, a, z, strings=None, twice=None, run=None):
    many = len(key)
    lists = lambda x: pa.array(x if x is not None else [None] * many, pa.list_(pa.int64()))
    blobs = lambda x: pa.array(x if x is not None else [None] * many, pa.binary())
    cols = [pa.array([kind] * many, pa.int32()), pa.array(key, pa.int64()), pa.array(part, pa.int32()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), lists(a), lists(z), blobs(strings), blobs(twice), blobs(run)]
    return pa.RecordBatch.from_arrays(cols, names=["kind", "key", "part", "d1", "d2", "a", "z", "strings", "twice", "run"])


def _shards(length: int, limit: int):
    """Runs (key, many, salt, d1, d2, part) in order to rows of SHARDED: kind 0 the stretches [a, z) of repeated
    starts of a run; for a key dealt over several shards also kind 1, the different strings of a shard in one range of
    digests: sorted digests, a byte each whether the shard has it twice, and run and start of one place (run: d1, d2 and start of each, one after the other)."""

    def shard(held, ranges: int):
        from xxhash import xxh3_128_intdigest

        marks, seg, at = repeated([x[5] for x in held], length)
        got = [(x[0], 0, x[3], x[4], *spans) for x, m in zip(held, marks, strict=True) if (spans := _spans(m))[0]]
        if got:
            yield _row(0, *zip(*got, strict=True))
        if ranges > 1 and len(seg):
            views = [memoryview(x[5]) for x in held]
            d = [xxh3_128_intdigest(views[s][a : a + length]) for s, a in zip(seg.tolist(), at.tolist(), strict=True)]
            digest = np.empty(len(d), DIGEST)
            digest["hi"], digest["lo"] = [v >> 64 for v in d], [v & (1 << 64) - 1 for v in d]
            order = np.argsort(digest, kind="stable")
            digest, seg, at = digest[order], seg[order], at[order]
            twice = np.array([marks[s][a] for s, a in zip(seg.tolist(), at.tolist(), strict=True)], np.uint8)
            names = np.array([(x[3], x[4]) for x in held], np.int64)
            run = np.column_stack([names[seg], at]).astype(np.int64)
            of = (digest["hi"] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
            edge = np.searchsorted(of, np.arange(ranges + 1).astype(np.uint64))
            for r, (x, y) in enumerate(zip(edge, edge[1:], strict=False)):
                if y > x:
                    yield _row(1, [held[0][0]], [r], [0], [0], [None], [None], [digest[x:y].tobytes()], [twice[x:y].tobytes()], [run[x:y].tobytes()])

    def work(batches):
        held, size = [], 0  # whole keys
        name, own, own_size, ranges = None, [], 0, 1  # the key (or its part) that may go on

        def close():
            nonlocal held, size
            if ranges > 1:
                if own:
                    yield from shard(own, ranges)
                return
            held, size = held + own, size + own_size
            if size > limit:
                yield from shard(held, 1)
                held, size = [], 0

        for batch in batches:
            for x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (x[0], x[2]) != name:
                    yield from close()
                    name, own, own_size, ranges = (x[0], x[2]), [], 0, x[1]
                elif ranges > 1 and own_size + len(x[5]) > 2 * limit:
                    yield from shard(own, ranges)
                    own, own_size = [], 0
                own.append(x)
                own_size += len(x[5])
        yield from close()
        if held:
            yield from shard(held, 1)

    return work


def _merged(batches):
    """Rows of kind 1 in order of key and range to rows of kind 0: strings that two shards of a key hold, with the
    stretches of starts of each run that has them."""
    name, lists = None, []

    def close():
        if len(lists) < 2:
            return
        digests = [np.frombuffer(x[1], DIGEST) for x in lists]
        both, got = met(list(digests)), []
        for x, own in zip(lists, digests, strict=True):
            # What a shard has twice it has marked itself.
            at = np.searchsorted(both, own)
            hit = (np.frombuffer(x[2], np.uint8) == 0) & (both[np.minimum(at, len(both) - 1)] == own) if len(both) else np.zeros(len(own), bool)
            got.append(np.frombuffer(x[3], np.int64).reshape(-1, 3)[hit])
        rows = np.unique(np.concatenate(got), axis=0)
        if not len(rows):
            return
        new = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(1)]
        gap = np.r_[True, new[1:] | (rows[1:, 2] != rows[:-1, 2] + 1)]
        a, z = rows[gap, 2], np.r_[rows[np.flatnonzero(gap)[1:] - 1, 2], rows[-1, 2]] + 1
        first = np.flatnonzero(new[gap])
        cut_at = list(zip(first.tolist(), [*first[1:].tolist(), len(a)], strict=True))
        n = len(cut_at)
        yield _row(0, [name[0]] * n, [0] * n, rows[new, 0], rows[new, 1], [a[x:y] for x, y in cut_at], [z[x:y] for x, y in cut_at])

    for batch in batches:
        for x in zip(*(batch.column(c).to_pylist() for c in ("key", "part", "strings", "twice", "run")), strict=True):
            if x[:2] != name:
                yield from close()
                name, lists = x[:2], []
            lists.append(x[1:])
    yield from close()


def repeated_stretches(texts: DataFrame, length: int, limit: int = SHARD) -> DataFrame:
    """(row, from, to): byte ranges of texts that strings of `length` bytes with another start cover."""
    found = _all_runs(texts, length)
    distinct = found.groupBy("key", "d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("weight"), F.first("row").alias("row"), F.first("at").alias("at"), F.first("starts").alias("starts"))
    # Cut first, so that either side of the joins below is an exchange, which hot keys can be split from.
    keys = cut(found.groupBy("key").agg(F.sum("weight").alias("all")).where("all > 1").select("key"))
    distinct = cut(distinct.join(keys, "key", "left_semi"))
    per_key = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("texts"), F.max("weight").alias("most"), F.sum(F.col("starts") + (length - 1)).alias("bytes"))
    per_key = cut(per_key.where("texts > 1 or most > 1").select("key", F.ceil(F.col("bytes") / limit).cast("int").alias("many")))
    # A run that is repeated as a whole repeats at each start; it needs a shard only for what else has its key.
    whole = distinct.where("n > 1").select("key", "d1", "d2", F.array(F.lit(0).cast("long")).alias("a"), F.array("starts").alias("z"))
    wanted = distinct.join(per_key, "key").select("key", "many", F.pmod(F.xxhash64("d1", "d2"), "many").alias("salt"), "d1", "d2", "row", "at", "starts")
    # One row for each text, whose runs are cut out before they are rows of their own.
    wanted = wanted.groupBy("row").agg(F.collect_list(F.struct("key", "many", "salt", "d1", "d2", "at", "starts")).alias("runs"))
    cut_out = F.transform("runs", lambda r: F.struct(r["key"].alias("key"), r["many"].alias("many"), r["salt"].alias("salt"), r["d1"].alias("d1"), r["d2"].alias("d2"), F.substring("text", r["at"].cast("int") + 1, (r["starts"] + (length - 1)).cast("int")).alias("part")))
    parts = texts.join(wanted, "row").select(F.explode(cut_out).alias("r")).select("r.*")
    shards = cut(parts.repartition("key", "salt").sortWithinPartitions("key", "salt", "d1", "d2").mapInArrow(_shards(length, limit), SHARDED))
    marks = shards.where("kind = 0").select("key", "d1", "d2", "a", "z").union(whole)
    spread = shards.where("kind = 1")
    if not spread.isEmpty():
        marks = marks.union(spread.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(_merged, SHARDED).select("key", "d1", "d2", "a", "z"))
    marks = cut(marks.groupBy("key", "d1", "d2").agg(F.collect_set(F.arrays_zip("a", "z")).alias("spans")))
    hit = found.select("key", "d1", "d2", "row", "at").join(marks, ["key", "d1", "d2"])
    return hit.select("row", F.explode(F.flatten("spans")).alias("s"), "at").select("row", (F.col("at") + F.col("s.a")).alias("from"), (F.col("at") + F.col("s.z") - 1 + length).alias("to"))


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", limit: int = SHARD) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay).

    Each byte is removed that a string of `length` bytes covers which also starts anywhere
    else in the table, in the same document too; strings are those of the input. Matches
    never cross documents. A null text is empty; a text shorter than `length` stays whole.
    Repeated rows repeat each other's strings. Null ids are carried; other columns are
    ignored. docs must be a stored table, whose rows are in the same places each time it
    is read.
    """
    texts = _table(docs, id_col, text_col)
    spans = repeated_stretches(texts, length, limit)
    per_row = spans.groupBy("row").agg(F.collect_list(F.struct("from", "to")).alias("spans"))  # no more than a text has starts
    kind = docs.schema[id_col].dataType.simpleString()

    def cover(batches):
        import hashlib

        for batch in batches:
            removed, many, sha, kept, size = [], [], [], [], []
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                text = text.as_py()
                at, n, k, left = 0, 0, 0, []
                for a, z in sorted((x["from"], x["to"]) for x in (found.as_py() or ())):
                    if not k or a > at:
                        left.append(text[at:a])
                        k += 1
                        n += z - a
                        at = z
                    elif z > at:
                        n += z - at
                        at = z
                left = b"".join([*left, text[at:]])
                for x, v in ((removed, n), (many, k), (kept, left), (sha, hashlib.sha256(left).hexdigest()), (size, len(text))):
                    x.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (size, removed, many)), pa.array(sha, pa.string()), pa.array(kept, pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = texts.join(per_row, "row", "left").select("id", "text", "spans")
    return joined.mapInArrow(cover, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary").withColumnRenamed("id", id_col)
