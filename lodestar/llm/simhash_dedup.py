"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint is cut into two halves, so of two fingerprints that differ in at most two
bits, some half differs in at most one. Each half is indexed under its 32 variants with
one bit made a wildcard; fingerprints that share a variant are candidates and verified.
Equal fingerprints are one row throughout. A shared variant yields links that connect its
members, not all their pairs.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import near_dedup
from .common import components, cut, only, text_bytes

#: Bits by which linked fingerprints may differ; the two halves prove it for two.
RADIUS = 2
ODD_ROWS = 4096


def fingerprints(texts: list[bytes], words: int, seed: int) -> np.ndarray:
    """64-bit SimHash of each text over word shingles; a bit is 1 if over half the hashes have it."""
    from xxhash import xxh64_intdigest

    hashes, sizes = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        w = t.lower().split()
        parts = list(map(b" ".join, zip(*(w[k:] for k in range(words)), strict=False))) if len(w) >= words else [b" ".join(w)] if w else []
        sizes[i] = len(parts)
        hashes.append(np.fromiter(map(xxh64_intdigest, parts, repeat(seed)), np.uint64, len(parts)))
    out = np.zeros(len(texts), np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for i, h in enumerate(hashes):
        if len(h):
            ones = np.zeros(64, np.int64)
            for x in range(0, len(h), 65536):
                ones += np.unpackbits(h[x : x + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            out[i] = weights[2 * ones > sizes[i]].sum(dtype=np.uint64)
    return out


def simhash(docs: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, fp): row numbers the rows of docs, fp has the fingerprint's bits as a long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make(batches):
        for batch in batches:
            raw = batch.column(2)
            fps = np.concatenate([fingerprints(raw.slice(x, 512).to_pylist(), words, seed) for x in range(0, len(raw), 512)] or [np.zeros(0, np.uint64)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=["id", "row", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), text_bytes(text_col).alias("text")).mapInArrow(make, f"id {kind}, row long, fp long")


def variants(fp: Column) -> Column:
    """The 64 keys of a fingerprint: half, place of the wildcard, and the half without that bit."""
    keys = []
    for half in (0, 1):
        value = F.shiftrightunsigned(fp, 32 * half).bitwiseAND(F.lit(0xFFFFFFFF))
        for bit in range(32):
            keys.append(value.bitwiseAND(F.lit(0xFFFFFFFF & ~(1 << bit))) + F.lit((half * 32 + bit) << 32))
    return F.array(*keys)


def _star(keys: np.ndarray, fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links from each fingerprint to the smallest one with an equal key."""
    order = np.lexsort((fps, keys))
    k, f = keys[order], fps[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    head = np.repeat(f[first], np.diff(np.r_[first, len(k)]))
    odd = head != f
    return [(f[odd], head[odd])]


def _subkeys(key: int, fps: np.ndarray):
    """Keys, for the members of one variant, that two share exactly if they differ in two bits at most.

    Members agree in one half but for its wildcard bit. Either the other half differs in
    one bit at most: it equals with that bit masked. Or it differs in two and this half not
    at all: both equal with two masked; every wildcard of this half would find the same
    pair, so only bit 0 looks for it.
    """
    half, bit = key >> 37, (key >> 32) & 31
    u = fps.view(np.uint64)
    here, other = (u >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF), (u >> np.uint64(32 * (1 - half))) & np.uint64(0xFFFFFFFF)
    for c in range(32):
        yield np.int64(c), (other & ~np.uint64(1 << c)).astype(np.int64)
    if bit == 0:
        same = (here & np.uint64(1)) << np.uint64(32)
        for c in range(32):
            for d in range(c):
                yield np.int64(32 + 32 * c + d), ((other & ~np.uint64(1 << c | 1 << d)) | same).astype(np.int64)


def _links(most: int):
    """Batches of (key, fp) in order of key to links (0, a, b, 0), or for members of keys with
    over `most` fingerprints to (1, key, fp, subkey) rows, which the caller groups further."""

    def inner(key: int, fps: np.ndarray):
        if len(fps) <= 64:
            a, b = np.triu_indices(len(fps), 1)
            near = np.bitwise_count((fps[a] ^ fps[b]).view(np.uint64)) <= RADIUS
            a, b = np.maximum(fps[a], fps[b])[near], np.minimum(fps[a], fps[b])[near]
            yield from _spanning(a, b)
        else:
            got = [x for _, keys in _subkeys(key, fps) for x in _star(keys, fps)]
            yield from _spanning(np.concatenate([x for x, _ in got]), np.concatenate([y for _, y in got]))

    def _spanning(a: np.ndarray, b: np.ndarray):
        """A forest with the components of the links."""
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        pairs = np.unique(np.stack([a, b], 1), axis=0)
        for x, y in pairs.tolist():
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        if up:
            yield np.fromiter(up, np.int64, len(up)), np.fromiter((root(x) for x in up), np.int64, len(up))

    def row(kind: int, a, b, c):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(c)], names=["kind", "a", "b", "c"])

    def overflow(key: int, fps: np.ndarray):
        for x in range(0, len(fps), ODD_ROWS):
            part = fps[x : x + ODD_ROWS]
            for tag, keys in _subkeys(key, part):
                yield row(1, np.full(len(part), key, np.int64), part, (tag << 33) | keys)

    def run(batches):
        held_key, held, over = None, [], False  # the last key so far, not yet known to be complete
        pairs_a, pairs_b = [], []

        def close():
            nonlocal held, over
            if not over and held and (n := sum(map(len, held))) > 1:
                for a, b in inner(held_key, np.concatenate(held) if n else held[0]):
                    pairs_a.append(a)
                    pairs_b.append(b)
            held, over = [], False

        for batch in batches:
            keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(keys):
                continue
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            last = np.r_[first[1:], len(keys)]
            size = last - first
            inside = np.ones(len(first), bool)
            inside[[0, -1]] = False
            two = inside & (size == 2)  # by far the most: at once
            a, b = fps[first[two]], fps[first[two] + 1]
            near = np.bitwise_count((a ^ b).view(np.uint64)) <= RADIUS
            pairs_a.append(np.maximum(a, b)[near])
            pairs_b.append(np.minimum(a, b)[near])
            for i in np.flatnonzero(~inside | (size > 2)).tolist():
                key, part = int(keys[first[i]]), fps[first[i] : last[i]]
                if key != held_key:
                    close()
                    held_key = key
                if over:
                    yield from overflow(key, part)
                else:
                    held.append(part)
                    if sum(map(len, held)) > most:
                        over = True
                        for x in held:
                            yield from overflow(key, x)
                        held = []
            if pairs_a and (n := sum(map(len, pairs_a))):
                a, b = np.concatenate(pairs_a), np.concatenate(pairs_b)
                yield row(0, a, b, np.zeros(n, np.int64))
            pairs_a, pairs_b = [], []
        close()
        if pairs_a:
            a, b = np.concatenate(pairs_a), np.concatenate(pairs_b)
            yield row(0, a, b, np.zeros(len(a), np.int64))

    return run


def fingerprint_links(fps: DataFrame, most: int = 100_000) -> DataFrame:
    """Links (a, b) that connect just those distinct fingerprints (column fp) that chains of
    links of at most two bits connect.

    A variant with more than `most` members is not gathered: its members go out under keys
    that prove a link by themselves, and each joins the smallest of its key.
    """
    keyed = fps.select(F.explode(variants(F.col("fp"))).alias("key"), "fp")
    dealt = keyed.repartition("key").sortWithinPartitions("key", "fp")
    found = cut(dealt.mapInArrow(_links(most), "kind int, a long, b long, c long"))
    links = found.where("kind = 0").select("a", "b")
    over = found.where("kind = 1")
    if not over.isEmpty():
        heads = cut(over.groupBy("a", "c").agg(F.min("b").alias("head")))
        links = links.union(over.join(heads, ["a", "c"]).where("b <> head").select(F.col("b").alias("a"), F.col("head").alias("b")))
    return links.distinct()


def _classes(docs: DataFrame, words: int, seed: int, id_col: str, text_col: str, most: int) -> tuple[DataFrame, DataFrame]:
    """(id, row, fp) of each document, and (fp, root) of each distinct fingerprint."""
    found = cut(simhash(docs, words, seed, id_col, text_col))
    distinct = cut(found.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(fingerprint_links(distinct.select("fp"), most))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    return found, cut(rooted.select("fp", "least", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", most: int = 100_000) -> DataFrame:
    """One row per document: its id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id that links of at most two differing bits reach, the
    document itself included. Texts are split at ASCII white space after lower-casing A-Z;
    a text of fewer words than a shingle is one shingle, and a text without words (null,
    too) has fingerprint zero and is linked like any other. Repeated rows stay repeated; a
    null id is never a component's smallest unless no other id is there. Other columns are
    ignored.
    """
    found, classes = _classes(docs, words, seed, id_col, text_col, most)
    least = cut(classes.groupBy("root").agg(F.min("least").alias("component_id")))
    of = cut(classes.join(least, "root").select("fp", "component_id"))
    return found.join(of, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = 3, similarity: float | None = None, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", most: int = 100_000) -> DataFrame:
    """The rows of docs, with all their columns, less all but one of each component.

    Without a similarity, links are those of near_duplicates: fingerprints at most two bits
    apart. With one, texts are linked whose sets of shingles have that Jaccard similarity at
    least; at 0.8 fingerprints differ in 15 of 100 bits, so near_dedup then takes longer ones,
    indexes each of their segments under its deletion variants and decides by the sets.

    The row with the smallest id stays (null ids last), of rows that share it the first in
    docs. docs must be a stored table, whose rows are in the same places each time it is read.
    """
    if similarity is not None:
        return near_dedup.drop_near_duplicates(docs, words, similarity, seed, id_col, text_col)
    found, classes = _classes(docs, words, seed, id_col, text_col, most)
    best = F.min(F.struct(F.col("id").isNull().alias("null"), "id", "row"))
    first = found.join(classes.select("fp", "root"), "fp").groupBy("root").agg(best.alias("best"))
    kept = cut(first.select(F.col("best.row").alias("__row")))
    return only(docs, kept, "left_semi")
