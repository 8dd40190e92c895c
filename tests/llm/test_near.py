"""Near copies by Jaccard similarity, and the pipeline, against all pairs."""

import random
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestar.llm import common, near_dedup

from .conftest import ODD
from .test_documents import brute_leaks


def sets(t, words=5):
    w = (t or "").lower().split()
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set())


def kept_by_brute_force(rows, least=0.8):
    """Smallest id of each component, and the number of similar pairs that are not equal."""
    held, up, near = [sets(t) for _, t in rows], list(range(len(rows))), 0

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(held):
        for j, b in enumerate(held[:i]):
            if a == b or (a and b and len(a & b) / len(a | b) >= least):
                near += a != b
                up[max(root(i), root(j))] = min(root(i), root(j))
    return sorted(min(k for n, (k, _) in enumerate(rows) if root(n) == r) for r in set(map(root, range(len(rows))))), near


def copies(seed=4, groups=25, most=8, edits=8):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(600)]
    rows = []
    for _ in range(groups):
        base = [r.choice(vocab) for _ in range(r.randrange(30, 200))]
        for _ in range(r.randrange(1, most)):
            w = list(base)
            for _ in range(r.randrange(edits)):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((len(rows) * 7 % 1009, " ".join(w)))
    return rows


@pytest.mark.parametrize("most", [16, 1])
def test_near_copies(make, most):
    rows = copies() + copies(5, 2, 60, 5)
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    want, near = kept_by_brute_force(rows)
    assert near > 100 and len(want) < len(rows)
    assert sorted(x.doc_id for x in near_dedup.drop_near_duplicates(make(rows), most=most).collect()) == want


def signed(rows):
    """(node, n, fingerprint as a number) of each text."""
    held = [near_dedup.shingle_set(t.encode(), 5, 42) for _, t in rows]
    return [(k, len(h), int.from_bytes(near_dedup.fingerprint(h, 42).tobytes(), "little")) for k, h in enumerate(held)]


def shares_a_variant(x, y, start=0, stop=near_dedup.SEGMENTS):
    """Whether two fingerprints differ in a bit at most of some segment, and little in the bits before all segments."""
    apart = (x ^ y) >> near_dedup.CHECK
    near = any((apart >> k * near_dedup.WIDTH & (1 << near_dedup.WIDTH) - 1).bit_count() <= 1 for k in range(start, stop))
    return near and ((x ^ y) & (1 << near_dedup.CHECK) - 1).bit_count() <= near_dedup.RADIUS


def proposed_by_brute_force(nodes):
    return {(a, b) for b, n_b, y in nodes for a, n_a, x in nodes[:b] if min(n_a, n_b) >= 0.8 * max(n_a, n_b) and min(n_a, n_b) > 3 and shares_a_variant(x, y)}


@pytest.mark.parametrize("most", [10**6, 4, 0])
def test_deletion_variants_propose(spark, most):
    """Candidates are the pairs of fingerprints that share a variant, no others but those of groups."""
    nodes = signed(copies(8, groups=12) + copies(9, 2, 60, 5))
    want = proposed_by_brute_force(nodes)
    assert len(want) > 150
    table = spark.createDataFrame([(k, n, bytearray(fp.to_bytes(8 * near_dedup.LONGS, "little"))) for k, n, fp in nodes], "node long, n int, fp binary")
    pairs, crowds, groups = near_dedup.candidates(table, 0.8, most)
    got = {(x.a, x.b) for x in pairs.collect()}
    of = {x.node: x.peers for x in groups.collect()}
    grouped = {(a, b) for a in of for b in of if a < b and of[a] == of[b]}
    assert got <= want <= got | grouped and not got & grouped
    assert {z for c in crowds.collect() for z in (c.x.node, c.y.node)} == set(of) and bool(of) == (most < 10**6) and (most or not got)


@pytest.mark.parametrize("limits", [(512, 10**6), (3, 10**6), (512, 20)])
def test_crowded_variants_and_halves(monkeypatch, limits):
    """Variants and halves with too many members to look at pairs lose none of them, across batches too."""
    monkeypatch.setattr(near_dedup, "VARIANT", limits[0])
    monkeypatch.setattr(near_dedup, "GATHERED", limits[1])
    nodes = signed(copies(10, 2, 60, 5) + copies(11, 10))
    fps = [fp.to_bytes(8 * near_dedup.LONGS, "little") for *_, fp in nodes]
    cols = [pa.array([k for k, *_ in nodes]), pa.array([n for _, n, _ in nodes], pa.int32()), pa.array([-1] * len(nodes)), pa.array(fps)]
    halves = pa.Table.from_batches(near_dedup._halves(0, near_dedup.SEGMENTS)([pa.RecordBatch.from_arrays(cols, names=["node", "n", "peers", "fp"])])).sort_by("key")
    got, crowds = set(), {}
    for batch in near_dedup._meet(0.8, 16)(halves.combine_chunks().to_batches(max_chunksize=97)):
        for x in batch.to_pylist():
            got.add((x["a"], x["b"])) if x["key"] is None else crowds.setdefault(x["key"], []).append(x["a"])
    got |= {(a, b) for c in crowds.values() for a in c for b in c if a < b}
    assert proposed_by_brute_force([x for x in nodes if x[1] > 3]) <= got
    assert max(map(len, crowds.values())) < len(nodes)


def test_fingerprints_reach_the_similarity():
    """All of 300 pairs of similarity 0.8 share a variant; of 300 pairs without a common shingle none does."""
    r = np.random.default_rng(3)
    for shared, wanted in ((80, 300), (0, 0)):
        hits = 0
        for _ in range(300):
            h = r.integers(0, 1 << 63, 180, np.uint64)
            x, y = (int.from_bytes(near_dedup.fingerprint(part, 42).tobytes(), "little") for part in (h[:90], np.r_[h[:shared], h[90 : 180 - shared]]))
            hits += shares_a_variant(x, y)
        assert hits == wanted


def test_stage_takes_its_pairs_from_the_fingerprints(spark, make, monkeypatch):
    """Texts whose fingerprints are left out are linked to none."""
    docs = make([(k, t) for k, (_, t) in enumerate(copies(12, 6))])
    kept, propose = corpus_pipeline.near_copies(spark, docs, "").count(), near_dedup.candidates
    monkeypatch.setattr(near_dedup, "candidates", lambda nodes, *by: propose(nodes.where("node < 0"), *by))
    assert kept < corpus_pipeline.near_copies(spark, docs, "").count() == docs.select("text").distinct().count()


@pytest.mark.parametrize("few", [0, 10**6])
def test_components_of_few_links_take_one_checkpoint(spark, monkeypatch, few):
    """Paths, stars, cycles, repeated links and links of a node to itself; only many links go round after round on the executors."""
    r, took, cut = random.Random(11), [], common.cut
    links = [(k, k + 1) for k in range(-40, 0)] + [(500, k) for k in range(501, 540)] + [(k, 900 + (k + 1) % 9) for k in range(900, 909)]
    links += [(x + 2000, x + 2000 + r.randrange(3)) for x in r.choices(range(300), k=200)] + [(1 << 62, -(1 << 62)), (7, 7), (8, 7), (7, 8)]
    monkeypatch.setattr(common, "FEW", few, raising=False)
    monkeypatch.setattr(common, "cut", lambda df: took.append(df) or cut(df))
    want = {x: x for link in links for x in link if link[0] != link[1]}
    for _ in want:
        for a, b in links:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    assert {x.node: x.root for x in common.components(spark.createDataFrame(links, "a long, b long")).collect()} == want
    assert (len(took) == 1) == (few > 0)
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("stage", [corpus_pipeline.known_language, corpus_pipeline.near_copies, corpus_pipeline.packed])
def test_stages_send_small_batches_to_workers(spark, make, stage):
    """Texts of 13 MB go in batches of 2 MB at most but for the row that ends one; a smaller limit of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    texts = make([(k, f"word {k} ") for k in range(300)]).coalesce(1).select(F.repeat("text", 5000).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["size"])

    try:
        stage(spark, make([(1, "one two three", "en")], "few"), "")
        assert max(r.size for r in texts.mapInArrow(sizes, "size long").collect()) < 2.2 * 2**20
        spark.conf.set(key, "64k")
        stage(spark, make([(1, "one two three", "en")], "few"), "")
        assert spark.conf.get(key) == "64k"
    finally:
        spark.conf.set(key, before)


def test_workers_give_memory_back():
    """40 MB in small pieces, freed below one that is still held, stay with the process unless they are given back."""
    code = """
import re, sys
from lodestar.llm import common
own = lambda: int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024
kept = []
def work(batches):
    for _ in batches:
        held = [bytes(4000) for _ in range(10_000)]
        kept.append(bytes(4000))
        del held
        yield own()
run = common.freed(work) if sys.argv[1] == "freed" else work
before = own()
list(run([0]))
print(own() - before)
"""
    left = {how: float(subprocess.run([sys.executable, "-c", code, how], capture_output=True, text=True, check=True).stdout) for how in ("plain", "freed")}
    assert left["plain"] > 30 and left["freed"] < 10


def test_near_copies_of_odd_rows(odd, empty):
    kept = near_dedup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(map(str, (x.doc_id for x in kept.collect()))) == ["1", "4", "5", "6", "7"]
    assert len(ODD) == odd.count() and near_dedup.drop_near_duplicates(empty).count() == 0


def test_pipeline_equals_brute_force(spark, tmp_path):
    """All stages one after the other: texts without a letter, copies, near copies and leaks go, all else stays."""
    r = random.Random(7)
    items = [(k, " ".join(f"item{r.randrange(900)}" for _ in range(30))) for k in range(4)]
    rows = copies(6, groups=40)
    rows += [(5000 + i, t.upper()) for i, (_, t) in enumerate(rows[::9])]
    rows += [(6000 + k, " ".join(f"own{r.randrange(900)}" for _ in range(20)) + " " + t + " end") for k, t in items]
    rows += [(7000, None), (7001, "12 -"), (7002, ""), (7003, "plain words"), (7004, "plain words")]
    lettered = [(i, t) for i, t in rows if any(map(str.isalpha, t or ""))]
    first = {}
    for i, t in sorted(lettered):
        first.setdefault(t.lower(), (i, t))
    ids, near = kept_by_brute_force(list(first.values()))
    bad = {i for i, _ in brute_leaks([x for x in first.values() if x[0] in ids], items)}
    assert near > 30 and bad == {6000, 6001, 6002, 6003}
    spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).select(F.col("doc_id")).distinct().collect()
    assert sorted(x.doc_id for x in out) == sorted(set(ids) - bad)
