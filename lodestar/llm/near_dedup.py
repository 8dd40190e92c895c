"""Near copies by the Jaccard similarity of word shingles: SimHash deletion variants propose, the sets decide.

Two sets whose similarity is s differ in a bit of their SimHash with probability
acos(2 s / (1 + s)) / pi at most, so at 0.8 in 15 of 100 bits. A fingerprint is therefore long
and cut into SEGMENTS segments of WIDTH bits, each of which is indexed under its variants
with one bit a wildcard, as op7's halves are. At 0.8 two segments share a variant with
probability 0.171, so all miss a pair with probability 3.0e-7, and a more similar one less
often. Variants whose wildcard is in one half of a segment agree in the other half, so rows
are dealt by halves, and the variants are formed where they meet. Sets that share one are
candidates if their sizes allow it and CHECK further bits differ in RADIUS at most (a pair at
0.8 fails that with probability 4.8e-7, one without shared shingles passes it with 3e-5).

Equal sets are one node throughout. Candidates are measured pair by pair, unless they
connect over `most` nodes of one half. Such a crowd is compared with its most central node first,
the one that meets most others in all of its crowds: the text that others are copies of is
like all of them, while copies need not be like each other. Crowds that the FIRST segments
show are joined into groups, of which the other segments need not propose the pairs again.

What is left unconnected is mostly texts that share a common passage and little else, and
copies too far from the central one. Of those only texts are compared that share one of their
first n - ceil(s n) + 1 shingles, rare ones first, as any two of similarity s do: a passage
that many share comes last, so it proposes nothing. Texts of one centre must also have enough
of their changes to it in common (see _around). No pair of one group is passed over.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, freed, only, text_bytes

SEGMENTS, WIDTH, CHECK, RADIUS, FIRST = 80, 20, 128, 41, 8
HALF = WIDTH // 2
#: 64-bit words of a fingerprint: those of CHECK come first.
LONGS = -(-(CHECK + SEGMENTS * WIDTH) // 64)
#: Members of a variant, and of a half, from which they count as a crowd without a look at pairs.
VARIANT, GATHERED = 256, 1_000_000

#: Hashes up to which the sets that pairs ask for go to every executor: 16 MB.
SMALL = 2_000_000


def shingle_set(text: bytes, words: int, seed: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle."""
    from xxhash import xxh64_intdigest

    w = text.lower().split()
    parts = set(map(b" ".join, zip(*(w[k:] for k in range(words)), strict=False))) if len(w) >= words else {b" ".join(w)} if w else set()
    return np.unique(np.fromiter(map(xxh64_intdigest, parts, repeat(seed)), np.uint64, len(parts)))


def fingerprint(hashes: np.ndarray, seed: int) -> np.ndarray:
    """The SimHash of a set as LONGS words; a bit is 1 if over half the hashes, mixed anew for each word, have it."""
    places = (np.arange(1, LONGS + 1, dtype=np.uint64) + np.uint64(seed << 16)) * np.uint64(0x9E3779B97F4A7C15)
    ones = np.zeros(64 * LONGS, np.int64)
    for x in range(0, len(hashes), 255):
        z = hashes[x : x + 255, None] + places
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        ones += np.unpackbits(z.astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def _signed(docs: DataFrame, words: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """(id, row, n, digest, fp): row numbers the rows of docs, n is the size of the set, fp its fingerprint."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "row", "n", "digest", "fp"]

    def make(batches):
        from xxhash import xxh3_128_digest

        for batch in batches:
            n, digests, fps = [], [], []
            for text in batch.column(2):
                h = shingle_set(text.as_py(), words, seed)
                n.append(len(h))
                digests.append(xxh3_128_digest(h.tobytes()))
                fps.append(fingerprint(h, seed).tobytes())
            cols = [batch.column(0), batch.column(1), pa.array(n, pa.int32()), pa.array(digests, pa.binary()), pa.array(fps, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), text_bytes(text_col).alias("text"))
    return rows.mapInArrow(freed(make), f"id {kind}, row long, n int, digest binary, fp binary")


def _halves(start: int, stop: int):
    """(key, node, peers, c0, c1) for each half of the segments from start to stop of nodes (node, n, peers, fp).

    The key holds the half's number, its bits, the other half's bits, and n below all.
    """
    many = 2 * (stop - start)
    numbers = np.arange(2 * start, 2 * stop, dtype=np.int64).reshape(-1, 2) << WIDTH
    weights = np.int64(1) << np.arange(HALF, dtype=np.int64)

    def run(batches):
        for batch in batches:
            for x in range(0, batch.num_rows, 512):
                part = batch.slice(x, 512)
                fps = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint8).reshape(-1, 8 * LONGS)
                bits = np.unpackbits(fps[:, CHECK // 8 :], axis=1, bitorder="little")[:, start * WIDTH : stop * WIDTH]
                half = (bits.reshape(-1, stop - start, 2, HALF) * weights).sum(3)
                key = ((numbers | half << HALF | half[:, :, ::-1]) << 32) | part.column(1).to_numpy().astype(np.int64)[:, None, None]
                check = fps[:, : CHECK // 8].copy().view("<i8")
                same = (part.column(0).to_numpy(), part.column(2).to_numpy(), check[:, 0], check[:, 1])
                cols = [key.ravel(), *(np.repeat(c, many) for c in same)]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), names=["key", "node", "peers", "c0", "c1"])

    return run


def _crowded(x: np.ndarray, y: np.ndarray, heads: np.ndarray, members: np.ndarray, size: int, most: int) -> list[np.ndarray]:
    """The pairs (x, y) of components of `most` places at most, and (head, member) for all places of the others."""
    both, to = np.r_[x, heads], np.r_[y, members]
    label, was = np.arange(size), None
    while was is None or (label != was).any():
        was = label.copy()
        low = np.minimum(label[both], label[to])
        np.minimum.at(label, both, low)
        np.minimum.at(label, to, low)
        label = label[label]
    crowd = np.bincount(label, minlength=size) > most
    crowd[np.bincount(label, minlength=size) < 2] = False
    crowd[label[heads]] = True
    few, m = ~crowd[label[x]], np.flatnonzero(crowd[label])
    return [x[few], y[few], label[m], m]


def _variants(key: np.ndarray, peers: np.ndarray, c0: np.ndarray, c1: np.ndarray, similarity: float, most: int) -> list[np.ndarray]:
    """Candidates among sorted keys of whole halves, as _crowded gives them. All of a variant with over VARIANT places count as such.

    Halves that agree come up under each wildcard, and equal segments under both halves: one of them counts.
    """
    n, place, other, odd = key & 0xFFFFFFFF, key >> 32, (key >> 32) & ((1 << HALF) - 1), (key >> (32 + WIDTH)) & 1
    found = [[np.zeros(0, np.int64)] for _ in range(4)]
    for bit in range(HALF):
        now = [[np.zeros(0, np.int64)] for _ in range(4)]
        wild = place & ~np.int64(1 << bit)
        order = np.argsort(wild, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(wild[order]) != 0])
        size = np.diff(np.r_[first, len(order)])
        for i in np.flatnonzero(size > VARIANT).tolist():
            run = order[first[i] : first[i] + size[i]]
            if peers[run[0]] < 0 or (peers[run] != peers[run[0]]).any():
                now[2].append(np.full(size[i] - 1, run[0]))
                now[3].append(run[1:])
        end = np.repeat(np.where(size > VARIANT, first, first + size), size)
        at, d = np.arange(len(order)), 0
        while len(at := at[at + (d := d + 1) < end[at]]):
            x, y = order[at], order[at + d]
            apart = other[x] ^ other[y]
            fits = (apart == 1 << bit) | ((apart == 0) & (odd[x] == 0) & (bit == 0))
            fits &= (peers[x] < 0) | (peers[x] != peers[y])
            fits &= np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y]) - 1e-6
            x, y = x[fits], y[fits]
            near = np.bitwise_count((c0[x] ^ c0[y]).view(np.uint64)).astype(np.int64) + np.bitwise_count((c1[x] ^ c1[y]).view(np.uint64)) <= RADIUS
            now[0].append(x[near])
            now[1].append(y[near])
        now = [np.concatenate(v) for v in now]
        if len(now[0]) + len(now[2]):
            for v, got in zip(found, _crowded(*now, len(key), most), strict=True):
                v.append(got)
    return _crowded(*(np.concatenate(v) for v in found), len(key), most)


def _meet(similarity: float, most: int):
    """Rows (key, node, peers, c0, c1) in order of key to candidates: pairs (null, a, n_a, b, n_b), and
    crowds (key, a, n_a, a, size), whose members with one key stand for all pairs of them.

    Nodes with the same peers, unless negative, are not proposed to each other.
    """
    names = ["key", "a", "n_a", "b", "n_b"]

    def rows(key, a, n_a, b, n_b):
        return pa.RecordBatch.from_arrays([key, pa.array(a), pa.array(n_a, pa.int32()), pa.array(b), pa.array(n_b, pa.int32())], names=names)

    def block(key, node, peers, c0, c1):
        x, y, heads, members = _variants(key, peers, c0, c1, similarity, most)
        n = key & 0xFFFFFFFF
        if len(x):
            swap = node[x] > node[y]
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            yield rows(pa.nulls(len(x), pa.int64()), node[x], n[x], node[y], n[y])
        if len(members):
            named = (key[heads] >> (32 + HALF)) * np.int64(0x1E3779B97F4A7C15) ^ node[heads]
            yield rows(pa.array(named), node[members], n[members], node[members], np.bincount(heads)[heads])

    def whole(half, key, node):
        n = key & 0xFFFFFFFF
        return rows(pa.array(np.full(len(key), half, np.int64)), node, n, node, np.full(len(key), len(key)))

    def run(batches):
        held, over = [np.zeros(0, np.int64)] * 5, None  # sorted rows whose last half is not known to be complete
        for batch in batches:
            held = [np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held)]
            half = held[0] >> (32 + HALF)
            if over is not None:
                upto = np.searchsorted(half, over, "right")
                yield whole(over, held[0][:upto], held[1][:upto])
                held, over, half = [h[upto:] for h in held], over if upto == len(half) else None, half[upto:]
            if len(half):
                if upto := np.searchsorted(half, half[-1]):
                    yield from block(*(h[:upto] for h in held))
                    held = [h[upto:] for h in held]
                if len(held[0]) > GATHERED:
                    over = half[-1]
                    yield whole(over, held[0], held[1])
                    held = [h[:0] for h in held]
        if len(held[0]):
            yield from block(*held)

    return run


def _central(crowds: DataFrame) -> DataFrame:
    """(key, x, y, weight): the nodes x of crowds (key, node, n, many) with the crowd's node y that meets most others in all its crowds."""
    me = F.struct("node", "n")
    heavy = crowds.join(crowds.groupBy("node").agg(F.sum("many").alias("weight")), "node").select("key", me.alias("x"), "weight")
    picks = heavy.groupBy("key").agg(F.max(F.struct("weight", "x")).alias("best")).select("key", F.col("best.x").alias("y"), F.col("best.weight").alias("weight"))
    return cut(heavy.drop("weight").join(picks, "key"))


def _grouping(met: DataFrame) -> DataFrame:
    """Links (a, b) that connect just those nodes that crowds connect: each node with one centre, centres with each other."""
    best = met.groupBy(F.col("x.node").alias("a")).agg(F.max(F.struct("weight", "y.node")).alias("best")).select("a", F.col("best.node").alias("b"))
    return best.union(met.select(F.col("x.node").alias("a"), F.col("y.node").alias("centre")).join(best, "a").select("centre", "b").distinct())


def candidates(nodes: DataFrame, similarity: float, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs (a, n_a, b, n_b), crowds (see _central) and groups (node, peers) of nodes (node, n, fp) that may be that similar.

    A group stands for all pairs of its nodes.
    """
    able = nodes.where(F.lit(1 - similarity) * F.col("n") >= similarity - 1e-9)  # a smaller set is like none but itself

    def found(nodes: DataFrame, start: int, stop: int) -> DataFrame:
        halves = nodes.select("node", "n", "peers", "fp").mapInArrow(freed(_halves(start, stop)), "key long, node long, peers long, c0 long, c1 long")
        dealt = halves.repartition(F.shiftrightunsigned("key", 32 + HALF)).sortWithinPartitions("key")
        return cut(dealt.mapInArrow(freed(_meet(similarity, most)), "key long, a long, n_a int, b long, n_b int"))

    def crowded(rows: DataFrame) -> DataFrame:
        return rows.where("key is not null").select("key", F.col("a").alias("node"), F.col("n_a").alias("n"), F.col("n_b").alias("many"))

    none = F.lit(-1).cast("long")
    one = found(able.withColumn("peers", none), 0, FIRST)
    met = _central(crowded(one))
    groups = components(_grouping(met)).toDF("node", "peers")
    two = found(able.join(groups, "node", "left").withColumn("peers", F.coalesce("peers", none)), FIRST, SEGMENTS)
    if not (more := crowded(two)).isEmpty():
        more = _central(more)
        groups = components(groups.toDF("a", "b").union(_grouping(more))).toDF("node", "peers")
        met = met.union(more)
    pairs = one.union(two).where("key is null").drop("key").distinct()
    for x in "ab":
        pairs = pairs.join(groups.toDF(x, f"of_{x}"), x, "left")
    apart = pairs.where("of_a is null or of_b is null or of_a <> of_b").select("a", "n_a", "b", "n_b")
    return cut(apart), met, groups


def _sets(docs: DataFrame, nodes: DataFrame, words: int, seed: int, text_col: str) -> DataFrame:
    """(node, held): the shingle sets of the rows that nodes names."""

    def make(batches):
        for batch in batches:
            for x in range(0, batch.num_rows, 256):
                held = [shingle_set(t.as_py(), words, seed).view(np.int64) for t in batch.column(1).slice(x, 256)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(x, 256), pa.array(held, pa.list_(pa.int64()))], names=["node", "held"])

    rows = docs.select(F.monotonically_increasing_id().alias("node"), text_bytes(text_col).alias("text"))
    return rows.join(nodes, "node", "left_semi").mapInArrow(freed(make), "node long, held array<long>")


def _measured(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, j): the similarity of the pairs (a, n_a, b, n_b) whose sizes do not rule the asked one out."""
    sized = pairs.where(F.least("n_a", "n_b") / F.greatest("n_a", "n_b") >= similarity).select("a", "b").distinct()
    sized = cut(sized)
    asked = sized.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = sets.join(asked, "node", "left_semi")
    if (sets.agg(F.sum(F.size("held"))).first()[0] or 0) <= SMALL:
        sets = F.broadcast(sets)
    a, b = (sets.select(F.col("node").alias(x), F.col("held").alias(f"of_{x}")) for x in "ab")
    both = F.size(F.array_intersect("of_a", "of_b"))
    return sized.join(a, "a").join(b, "b").select("a", "b", (both / (F.size("of_a") + F.size("of_b") - both)).alias("j"))


def _pair(x: Column, y: Column) -> list[Column]:
    """Columns a, n_a, b, n_b of two structs (node, n)."""
    return [x["node"].alias("a"), x["n"].alias("n_a"), y["node"].alias("b"), y["n"].alias("n_b")]


def _ordered(met: DataFrame) -> DataFrame:
    """Rows with structs x and y as (a, n_a, b, n_b), the smaller node first."""
    x, y = (F.struct(F.col(f"{k}.node").alias("node"), F.col(f"{k}.n").alias("n")) for k in "xy")
    return met.select(*_pair(F.least(x, y), F.greatest(x, y)))


def _around(left: DataFrame, sets: DataFrame, fits: Column, similarity: float) -> DataFrame:
    """Structs x and y of nodes (node, n, root, centre) with one centre that may be similar, by what they change of the core.

    The core are the shingles that over half of a centre's nodes hold. With m its size, r and
    u the shingles a set lacks of it and has besides, two sets are similar just if they have
    w + w of their changes in common, where w = (1 - c) r + c u - (1/2 - c) m and c = s / (1 + s),
    whatever the core. Most changes are a text's own, so
    pairs come from shared additions, or, where those are not needed, from enough that is lacking.
    """
    c = similarity / (1 + similarity)
    held = cut(left.join(sets, "node"))
    votes = held.select("centre", F.explode("held").alias("h")).groupBy("centre", "h").agg(F.count(F.lit(1)).alias("votes"))
    voters = held.groupBy("centre").agg(F.count(F.lit(1)).alias("voters"))
    # No more than twice as many as a set has on average.
    whole = cut(votes.join(voters, "centre").where(2 * F.col("votes") > F.col("voters")).groupBy("centre").agg(F.collect_list("h").alias("whole")))
    changed = held.join(whole, "centre", "left").withColumn("whole", F.coalesce("whole", F.array().cast("array<bigint>")))
    changed = changed.select("node", "n", "root", "centre", F.array_except("held", "whole").alias("more"), F.size("whole").alias("m"))
    changed = changed.withColumn("u", F.size("more")).withColumn("r", F.col("m") - (F.col("n") - F.col("u")))
    changed = cut(changed.withColumn("w", (1 - c) * F.col("r") + c * F.col("u") - (0.5 - c) * F.col("m") - 1e-6))
    me = F.struct("node", "n", "r", "u", "w")
    need, lacking, added = F.col("x.w") + F.col("y.w"), F.least("x.r", "y.r"), F.least("x.u", "y.u")

    def pairs(rows: DataFrame, by: list[str], enough: Column) -> DataFrame:
        here = rows.select(*by, "root", me.alias("x"))
        return here.join(rows.select(*by, F.col("root").alias("other"), me.alias("y")), by).where(fits & (need <= enough)).select("x", "y")

    spread = changed.withColumn("h", F.explode("more"))
    several = cut(spread.groupBy("centre", "h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("centre", "h"))
    shared = pairs(spread.join(several, ["centre", "h"], "left_semi"), ["centre", "h"], lacking + added)
    # Nodes that some partner could suit without a shared addition.
    reach = changed.groupBy("centre").agg(F.min("w").alias("light"), F.max(F.col("r") - F.col("w")).alias("slack"))
    able = changed.join(reach, "centre").where((F.col("w") + F.col("light") <= F.col("r")) & (F.col("w") <= F.col("slack")))
    several = able.groupBy("centre").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("centre")
    able = cut(able.join(several, "centre", "left_semi"))
    return shared.union(pairs(able, ["centre"], lacking))


def _links(pairs: DataFrame, crowds: DataFrame, groups: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(node, root) of the components of the similar pairs among candidates."""
    if groups.isEmpty():
        return components(_measured(pairs, sets, similarity).where(F.col("j") >= similarity).select("a", "b"))
    # The weightiest central node of each node's crowds, and that node's own.
    far = crowds.groupBy("x").agg(F.max(F.struct("weight", "y")).alias("best")).select("x", F.col("best.y").alias("y"))
    far = cut(far.join(far.toDF("y", "centre"), "y"))
    met = far.select("x", "y").union(far.select("x", "centre")).where("x <> y")
    measured = _measured(pairs.union(_ordered(met)), sets, similarity)
    links = F.col("j") >= similarity
    roots = components(measured.where(links).select("a", "b"))

    far = far.select("x.node", "x.n", F.col("centre.node").alias("centre"))
    placed = groups.join(far, "node").join(roots, "node", "left").select("peers", F.coalesce("root", "node").alias("root"), "node", "n")
    torn = placed.groupBy("peers").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("peers")
    left = cut(placed.join(torn, "peers", "left_semi").select("node", "n", "root"))
    if left.isEmpty():
        return roots
    said = cut(left.join(sets, "node").select("node", "n", "root", F.explode("held").alias("h")))
    common = said.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # A shingle of one text alone comes first in its prefix and proposes nothing, so it only takes up places.
    known = said.join(common, "h").groupBy("node").agg(F.first("n").alias("n"), F.first("root").alias("root"), F.sort_array(F.collect_list(F.struct("df", "h"))).alias("all"))
    places = (F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - 1e-9) + 1 - (F.col("n") - F.size("all"))).cast("int")
    first = known.withColumn("places", places).where("places > 0").join(far.select("node", "centre"), "node").select(F.explode(F.slice("all", F.lit(1), F.col("places"))).alias("s"), "root", F.struct("node", "n", "centre").alias("x"))
    first = cut(first.select(F.col("s.h").alias("h"), "root", "x"))
    apart = first.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("h")
    first = cut(first.join(apart, "h", "left_semi"))
    other = first.select("h", F.col("root").alias("other"), F.col("x").alias("y"))
    fits = (F.col("root") < F.col("other")) & (F.least("x.n", "y.n") / F.greatest("x.n", "y.n") >= similarity)
    met = first.join(other, "h").where(fits & (F.col("x.centre") != F.col("y.centre")))
    open_ = left.join(first.select("x.node").distinct(), "node", "left_semi").join(far.select("node", "centre"), "node")
    met = _ordered(met).union(_ordered(_around(open_, sets, fits, similarity)))
    more = cut(_measured(met, sets, similarity).where(links).select("a", "b"))
    return roots if more.isEmpty() else components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", most: int = 16) -> DataFrame:
    """The rows of docs, with all their columns, less all but one of each component.

    Components are of links between texts whose sets of `words`-word shingles have a Jaccard
    similarity of at least `similarity`. Texts are split at ASCII white space after
    lower-casing A-Z; a text of fewer words than a shingle is one shingle, and all texts
    without words (null, too) are equal. The row with the smallest id stays (null ids last),
    of rows that share it the first in docs. docs must be a stored table, whose rows are in
    the same places each time it is read.
    """
    found = cut(_signed(docs, words, seed, id_col, text_col))
    nodes = cut(found.groupBy("digest").agg(F.min("row").alias("node"), F.first("n").alias("n"), F.first("fp").alias("fp")))
    pairs, crowds, groups = candidates(nodes, similarity, most)
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(groups.select("node")).distinct()
    sets = cut(_sets(docs, asked, words, seed, text_col))
    roots = _links(pairs, crowds, groups, sets, similarity)
    rooted = nodes.select("digest", "node").join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("root"))
    best = F.min(F.struct(F.col("id").isNull().alias("null"), "id", "row"))
    first = found.select("id", "row", "digest").join(rooted, "digest").groupBy("root").agg(best.alias("best"))
    kept = cut(first.select(F.col("best.row").alias("__row")))
    return only(docs, kept, "left_semi")
