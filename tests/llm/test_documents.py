"""The document operators against brute force, and on odd rows."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodestar.llm import decontaminate, exact_dedup, lang_id, packing, simhash_dedup, token_counts
from lodestar.llm.tokens import count_each, encode_spliced, ids_each, tokenizer

from .conftest import ODD

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


# Exact copies


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("digest", [None, lambda c: F.octet_length(c) % 2])
def test_exact_dedup(odd, keep, digest):
    out = exact_dedup.exact_dedup(odd, keep=keep, **({"digest": digest} if digest else {})).collect()
    assert len(out) == len(ODD)
    groups = {}
    for i, t in ODD:
        groups.setdefault(lower(t), []).append(i)
    for t, ids in groups.items():
        got = [r for r in out if r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()]
        known = [i for i in ids if i is not None]
        assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in got)
        assert {r.group_size for r in got} == {len(ids)}
        assert {r.keep_id for r in got} == {(min if keep == "min" else max)(known) if known else None}
        assert sum(r.kept for r in got) == 1
    kept = exact_dedup.drop_exact_duplicates(odd, keep=keep, **({"digest": digest} if digest else {}))
    assert kept.columns == odd.columns and kept.count() == len(groups)


def test_empty_tables(spark, empty, make):
    bench = make([(1, "a b c")], "bench").select(F.col("doc_id").alias("item_id"), "text")
    for out in (
        exact_dedup.exact_dedup(empty), exact_dedup.drop_exact_duplicates(empty), token_counts.token_counts(empty, BYTE), packing.pack(empty, WORD), simhash_dedup.near_duplicates(empty),
        simhash_dedup.drop_near_duplicates(empty), decontaminate.contaminated(empty, bench), decontaminate.drop_contaminated(empty, bench), lang_id.predict(empty, lang_id.train(empty)),
    ):
        assert out.count() == 0


# Tokens


def texts(n, seed=1):
    r = random.Random(seed)
    bits = ["hello", ".", "...", "end.", "É.", "×.", "don't.", "THE,", "<|startoftext|>", "<|ENDOFTEXT|>", "-x", " ", "  ", "\n", "\t", "é", "don't", "123", "!?", "<|endoftext|>", "日本", " ", "\x1c", "ab", " a", "'s", "́", "Σ"]
    return ["".join(r.choice(bits) for _ in range(r.randrange(200))) for _ in range(n)]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_pieces_equal_the_library(path):
    tok = tokenizer(path)
    many = texts(300)
    want = [e.ids for e in tok.encode_batch(many, add_special_tokens=False)]
    if path == BYTE:
        assert count_each([t.encode() for t in many], path, 1 << 20, 8) == count_each([t.encode() for t in many], path, 64, 8) == [len(x) for x in want]
    else:
        assert [np.frombuffer(b, "<u4").tolist() for b in ids_each([t.encode() for t in many], path)] == want


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_documents_equal_the_library(path):
    import pyarrow.parquet as pq

    many = pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()
    want = [e.ids for e in tokenizer(path).encode_batch(many, add_special_tokens=False)]
    raw = [t.encode() for t in many]
    assert [len(x) for x in want] == count_each(raw, path, 16_384, 256) if path == BYTE else [np.frombuffer(b, "<u4").tolist() for b in ids_each(raw, path)] == want


def test_spliced_equals_whole():
    tok = tokenizer(BYTE)
    for t in [*texts(60, 2), "x" * 5000, " " * 3000, "ab " * 3000, "a" * 700 + " b" * 400 + "!" * 900]:
        assert encode_spliced(tok, t, 50, 4) == tok.encode(t, add_special_tokens=False).ids


def test_token_counts(odd):
    got = token_counts.token_counts(odd, BYTE).collect()
    want = Counter((i, len((t or "").encode()), len(tokenizer(BYTE).encode(t or "", add_special_tokens=False).ids)) for i, t in ODD)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)


# Packing


def held_to_rules(rows, size, want):
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by_seq.values():
        at = 0
        for off, n in sorted(s):
            assert off == at
            at += n
        assert at <= size
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    return len(by_seq)


@pytest.mark.parametrize("per_bucket", [20_000, 1])
def test_packing(odd, per_bucket):
    want = Counter()
    for i, t in ODD:
        ids = np.array(tokenizer(WORD).encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        for k, x in enumerate(range(0, len(ids), 64)):
            want[i, k, x, len(ids[x : x + 64]), zlib.crc32(ids[x : x + 64].tobytes())] += 1
    n = held_to_rules(packing.pack(odd, WORD, 64, per_bucket=per_bucket).collect(), 64, want)
    assert n == -(-sum(k[3] * c for k, c in want.items()) // 64)


def test_plan_is_by_bin_completion_where_best_fit_is_as_good():
    counts = {9: 2, 7: 3, 6: 4, 5: 5, 3: 6, 2: 4, 1: 9}
    plain, completed = packing._patterns(counts, 10, False), packing._patterns(counts, 10, True)
    assert sum(t for t, _ in plain) == sum(t for t, _ in completed) == -(-sum(n * c for n, c in counts.items()) // 10)
    assert packing.bin_patterns(counts, 10) == completed


def test_bin_completion_beats_best_fit():
    counts = {6: 1, 5: 2, 4: 3, 3: 2, 2: 1}  # 36 in tens: at least 4
    found = packing.bin_patterns(counts, 10)
    assert sum(t for t, _ in found) == 4
    r = random.Random(3)
    for _ in range(40):
        counts = dict(Counter(r.randrange(1, 60) for _ in range(60)))
        found = packing.bin_patterns(counts, 100)
        used = Counter()
        for t, held in found:
            assert sum(n * k for n, k in held) <= 100
            for n, k in held:
                used[n] += t * k
        assert used == counts


def fewest(lengths, size):
    """The least number of sequences by trying all ways."""
    best = len(lengths)

    def put(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for r in {*rooms}:
            if r >= lengths[i]:
                rest = list(rooms)
                rest.remove(r)
                put(i + 1, [*rest, r - lengths[i]])
        put(i + 1, [*rooms, size - lengths[i]])

    lengths = sorted(lengths, reverse=True)
    put(0, [])
    return best


def test_branch_and_bound_needs_no_more_than_all_ways():
    r = random.Random(12)
    cases = [([13, 13, 12, 11, 11, 7, 6, 6, 5, 4, 4, 4, 3], 20), ([17, 16, 15, 10, 9, 8, 6, 6], 30)]
    for _ in range(700):
        size = r.choice([10, 20, 30, 60])
        cases.append(([r.randrange(max(1, size // 8), r.choice([size // 2, size]) + 1) for _ in range(r.randrange(1, 12))], size))
    better = 0
    for lengths, size in cases:
        found = packing.bin_patterns(Counter(lengths), size)
        used = Counter()
        for t, held in found:
            assert sum(n * k for n, k in held) <= size
            for n, k in held:
                used[n] += t * k
        many = sum(t for t, _ in found)
        assert used == Counter(lengths) and many == fewest(lengths, size) >= packing.lower_bound(Counter(lengths), size), (lengths, size)
        better += many < min(sum(t for t, _ in packing._patterns(Counter(lengths), size, c)) for c in (True, False))
    assert better >= 2  # the search was needed


# Near copies


def brute_components(fps, ids):
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (int(fps[i]) ^ int(fps[j])).bit_count() <= 2:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for k, i in enumerate(ids):
        least[root(k)] = min(least.get(root(k), i), i)
    return [least[root(k)] for k in range(len(fps))]


def slow_fingerprint(t, words=3, seed=42):
    import re

    import xxhash

    w = re.findall(rb"[^\x20\x09-\x0D]+", lower(t).encode())
    sh = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, seed) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("most", [100_000, 3])
def test_near_duplicates(make, most):
    r = random.Random(5)
    vocab = ["w%d" % i for i in range(50)]
    rows = []
    for g in range(12):
        base = [r.choice(vocab) for _ in range(80)]
        for _ in range(r.randrange(1, 14)):
            w = list(base)
            if r.random() < 0.6:
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((len(rows) * 7 % 1009, " ".join(w)))
    rows += [(2000, None), (2001, ""), (2002, "One"), (2003, "oNE")]
    got = {x.doc_id: x for x in simhash_dedup.near_duplicates(make(rows), most=most).collect()}
    fps = [slow_fingerprint(t) for _, t in rows]
    for (i, _), fp, c in zip(rows, fps, brute_components(fps, [i for i, _ in rows]), strict=True):
        assert (got[i].fingerprint, got[i].component_id) == (f"{fp:016x}", c)
    kept = simhash_dedup.drop_near_duplicates(make(rows), most=most)
    assert sorted(x.doc_id for x in kept.collect()) == sorted({x.component_id for x in got.values()})


@pytest.mark.parametrize("most", [100_000, 70, 5])
def test_links_of_crowded_variants(spark, most):
    r = random.Random(6)
    fps = {0, -1}
    for base in [r.getrandbits(64) for _ in range(4)]:
        for _ in range(150):
            x = base
            for _ in range(r.randrange(4)):
                x ^= 1 << r.randrange(64)
            fps.add(x - (1 << 64) if x >> 63 else x)
    fps = sorted(fps)
    from lodestar.llm.common import components

    roots = {x.node: x.root for x in components(simhash_dedup.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long"), most)).collect()}
    assert [roots.get(f, f) for f in fps] == brute_components([f & (1 << 64) - 1 for f in fps], fps)


def test_near_duplicates_of_odd_rows(odd):
    out = simhash_dedup.near_duplicates(odd).collect()
    assert len(out) == len(ODD)
    assert {r.component_id for r in out if r.fingerprint == "0" * 16} == {1}
    kept = simhash_dedup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == len({r.component_id for r in out})


# Language


def test_language_id_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    got = lang_id.predict(docs.where(held), lang_id.train(docs.where(~held))).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in got) > 0.95 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_mixture(make):
    en, de = "the thing that they think this then ", "und der die ich nicht auch sich "
    model = lang_id.train(make([(1, en * 30, "en"), (2, de * 30, "de"), (3, en, None)]))
    got = {r.doc_id: r for r in lang_id.predict(make([(1, en * 40), (2, en * 10 + de * 20), (3, "12 !"), (4, None), (5, "der"), (None, "the")]), model).collect()}
    assert (got[1].lang_pred, got[1].n_langs) == ("en", 1)
    assert (got[2].lang_pred, got[2].n_langs) == ("de", 2) and 0.5 < got[2].score < 0.8
    assert (got[3].lang_pred, got[3].score, got[4].lang_pred) == ("und", 0.0, "und")
    assert (got[5].lang_pred, got[None].lang_pred) == ("de", "en")


def test_no_letter_is_no_language(make):
    model = lang_id.train(make([(1, "the thing that they think " * 9, "en")], "train"))
    rows = [(k, t) for k, t in enumerate(("½", "①", "Ⅷ ²", "12 !", "ª", "é", "日"))]
    got = {r.doc_id: r.lang_pred for r in lang_id.predict(make(rows), model).collect()}
    assert got == {0: "und", 1: "und", 2: "und", 3: "und", 4: "en", 5: "en", 6: "en"}


def slow_mixture(text, logs, bins=lang_id._bins):
    """Best language, share and number of languages of one text by loops over its blocks."""
    import math

    b = bins(lang_id._normal(text.encode()))
    blocks = [b[i : i + lang_id.BLOCK] for i in range(0, len(b), lang_id.BLOCK)]
    like = [[sum(float(row[x]) for x in block) for row in logs] for block in blocks]

    def em(allowed):
        w = {j: 1 / len(allowed) for j in allowed}
        p = [{j: math.exp(x[j] - max(x)) for j in allowed} for x in like]
        for _ in range(lang_id.ROUNDS):
            r = [{j: w[j] * q[j] / max(sum(w[k] * q[k] for k in allowed), 1e-300) for j in allowed} for q in p]
            w = {j: sum(x[j] for x in r) / len(r) for j in allowed}
        ll = sum(math.log(max(sum(w[j] * q[j] for j in allowed), 1e-300)) + max(x) for q, x in zip(p, like, strict=True))
        return w, ll

    full, _ = em(range(len(logs)))
    order = sorted(full, key=lambda j: (-full[j], j))
    best = None
    for k in range(1, len(logs) + 1):
        w, ll = em(order[:k])
        worth = ll - 2 * k * math.log(max(len(b), 2))
        if best is None or worth > best[0]:
            best = worth, w, k
    pick = min(best[1], key=lambda j: (-best[1][j], j))
    return pick, min(full[pick], best[1][pick]), best[2]


def test_mixture_equals_loops(make):
    langs = {"en": "the thing that they think this then ", "de": "und der die ich nicht auch sich ", "fr": "les des une pour dans avec vous "}
    names, logs = lang_id.train(make([(i, t * 30, x) for i, (x, t) in enumerate(langs.items())]))
    r = random.Random(4)
    texts = ["".join(r.choice([*langs.values()]) * r.randrange(1, 25) for _ in range(r.randrange(1, 5))) for _ in range(40)] + ["der", "a"]
    pick, share, many = lang_id.infer([lang_id._normal(t.encode()) for t in texts], logs)
    for t, p, s, k in zip(texts, pick, share, many, strict=True):
        want = slow_mixture(t, logs)
        assert (p, k) == (want[0], want[2]) and s == pytest.approx(want[1], abs=1e-6)
    alone = lang_id.infer([lang_id._normal(texts[3].encode())], logs)
    assert (alone[0][0], alone[2][0]) == (pick[3], many[3])


def test_keep_known(make):
    rows = [(1, "the thing that they think " * 9, "en"), (2, "12 !", "en"), (3, None, "en"), (None, "der die ich " * 9, "de"), (4, "", None), (4, "think", None)]
    docs = make(rows)
    kept = lang_id.keep_known(docs, lang_id.train(docs))
    assert kept.schema == docs.schema and sorted(map(str, (r.doc_id for r in kept.collect()))) == ["1", "4", "None"]
    blank = make([(1, "plain text"), (2, "more"), (3, "...")], "blank")
    assert sorted(r.doc_id for r in lang_id.keep_known(blank, lang_id.train(blank)).collect()) == [1, 2]


def test_users_own_row_column_stays(make):
    from lodestar.llm import near_dedup

    docs = make([(1, "one two three four five six"), (2, "one two three four five six"), (3, "x")]).withColumnsRenamed({"row": "__row", "id": "__ROW_"})
    for out in (near_dedup.drop_near_duplicates(docs), simhash_dedup.drop_near_duplicates(docs), exact_dedup.drop_exact_duplicates(docs)):
        assert out.columns == docs.columns and sorted((r.doc_id, r["__row"]) for r in out.collect()) == [(1, 7), (3, 7)]


# Benchmark leaks


def brute_leaks(rows, items, k=5, least=0.8):
    import re

    out = {}
    for i, t in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        for item, it in items:
            v = re.findall(r"[^\W_]+", (it or "").lower())
            if not v or not w:
                continue
            n, kk = min(len(v), len(w)), min(k, len(v))
            theirs = Counter(tuple(v[a : a + kk]) for a in range(len(v) - kk + 1))
            for s in range(len(w) - n + 1):
                ours = Counter(tuple(w[s : s + n][a : a + kk]) for a in range(n - kk + 1))
                if ours and (j := sum((ours & theirs).values()) / sum((ours | theirs).values())) >= least:
                    out[i, item] = max(out.get((i, item), 0), j)
    return out


def test_decontamination(make):
    r = random.Random(8)
    vocab = ["w%d" % i for i in range(400)]
    items = [(k, " ".join(r.choice(vocab) for _ in range(r.choice([3, 8, 30, 60])))) for k in range(20)] + [(90, None), (91, "")]
    rows = []
    for i in range(120):
        body = [r.choice(vocab) for _ in range(r.randrange(0, 80))]
        if r.random() < 0.6:
            it = r.choice(items[:20])[1].split()
            for _ in range(r.randrange(3)):
                if r.random() < 0.3:
                    it.insert(r.randrange(len(it)), "new")
                elif r.random() < 0.5 and len(it) > 3:
                    del it[r.randrange(len(it))]
                else:
                    it[r.randrange(len(it))] = "odd"
            body[(at := r.randrange(len(body) + 1)) : at] = it
        rows.append((i, " ".join(body).upper() if i % 3 else ", ".join(body)))
    rows += [(500, None), (501, ""), (None, "w1")]
    bench = make(items, "bench").select(F.col("doc_id").alias("item_id"), "text")
    docs = make(rows)
    got = {(x.doc_id, x.item_id): x.similarity for x in decontaminate.contaminated(docs, bench).collect()}
    want = brute_leaks(rows, items)
    assert got == pytest.approx(want) and len(want) > 30
    bad = {i for i, _ in want}
    assert sorted(x.doc_id for x in decontaminate.drop_contaminated(docs, bench).where("doc_id is not null").collect()) == sorted(i for i, _ in rows if i is not None and i not in bad)


def test_reordered_passages(make):
    """Halves that changed places, and words put in between: no shared shingle lies where the window begins."""
    r = random.Random(9)
    words = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    item = words(80)
    moved, spread = item[40:] + item[:40], item[:40] + ["new"] * 4 + item[40:]
    rows = [(k, " ".join(words(50) + body + words(50))) for k, body in enumerate((moved, spread, item, item[:30], item[::-1]))] + [(9, " ".join(item * 20))]
    items = [(1, " ".join(item)), (2, " ".join(item[:12] * 3))]
    bench = make(items, "bench").select(F.col("doc_id").alias("item_id"), "text")
    got = {(x.doc_id, x.item_id): x.similarity for x in decontaminate.contaminated(make(rows), bench).collect()}
    want = brute_leaks(rows, items)
    assert got == pytest.approx(want) and {(0, 1), (1, 1), (2, 1), (9, 1)} <= set(want)


def test_leaks_without_ids(make):
    """Documents and items whose id is null are found and dropped like others."""
    r = random.Random(11)
    one, two, three = (" ".join(f"w{r.randrange(5000)}" for _ in range(30)) for _ in range(3))
    items = [(1, one), (None, two), (None, three)]
    rows = [(None, "x y " + one), (None, "no leak"), (None, "z " + one), (5, two), (None, f"{two} {three}"), (6, "clean")]
    bench = make(items, "bench").select(F.col("doc_id").alias("item_id"), "text")
    docs = make(rows)
    got = Counter((x.doc_id, x.item_id, x.start, x.n_words) for x in decontaminate.contaminated(docs, bench).collect())
    assert got == Counter([(None, 1, 2, 30), (None, 1, 1, 30), (5, None, 0, 30), (None, None, 0, 30), (None, None, 30, 30)])
    assert sorted(x.text for x in decontaminate.drop_contaminated(docs, bench).collect()) == ["clean", "no leak"]


def test_bin_completion_is_not_deep():
    """As many lengths as may be left out one after the other do not exhaust the call stack."""
    size = 32768
    counts = dict.fromkeys(range(size // 3, size // 2 + size // 8), 1)
    found = packing.bin_patterns(counts, size)
    assert sum(t * k for t, held in found for _, k in held) == len(counts)
