"""The ten registered queries as they stand, on a small folder of tables, against brute force."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lodestar.llm import queries
from lodestar.llm.tokens import tokenizer

from . import test_chat_url, test_class_lm, test_documents, test_suffix

FROM = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    """Whole short documents of the smallest tables, a few of them twice, and odd ones."""
    to = tmp_path_factory.mktemp("sf")
    docs = pq.read_table(f"{FROM}/documents.parquet").to_pylist()
    docs = [d for d in docs if len(d["text"] or "") < 1500][:70]
    docs += [d | {"doc_id": 9000 + i, "text": d["text"].upper() if i % 2 else d["text"]} for i, d in enumerate(docs[:6])]
    bench = pq.read_table(f"{FROM}/benchmark.parquet").to_pylist()[:12]
    docs += [docs[0] | {"doc_id": 9100 + i, "text": f"before it {b['text']} after it"} for i, b in enumerate(bench[:4])]
    docs += [docs[0] | {"doc_id": 9200, "text": None}, docs[0] | {"doc_id": 9201, "text": ""}, docs[0] | {"doc_id": 9202, "text": "½ 12", "lang": None}]
    pq.write_table(pa.Table.from_pylist(docs, pq.read_schema(f"{FROM}/documents.parquet")), f"{to}/documents.parquet", row_group_size=20)
    pq.write_table(pa.Table.from_pylist(bench, pq.read_schema(f"{FROM}/benchmark.parquet")), f"{to}/benchmark.parquet")
    for t in ("pages", "conversations"):
        pq.write_table(pq.read_table(f"{FROM}/{t}.parquet"), f"{to}/{t}.parquet")
    return str(to), [(d["doc_id"], d["text"]) for d in docs], [(b["item_id"], b["text"]) for b in bench]


def remainder(i, by):
    return zlib.crc32(str(i).encode()) % by


def test_op1(spark, small):
    out = queries.op1_class_lm(spark, small[0]).collect()
    test_class_lm.held_to_base(small[1], [t for i, t in small[1] if remainder(i, 7) != 2], out)
    assert all(r.held_out == (remainder(r.doc_id, 7) == 2) for r in out) and all(r.score < 0 for r in out)


def test_op2(spark, small):
    pages = {p["page_id"]: p["url"] for p in pq.read_table(f"{small[0]}/pages.parquet").to_pylist()}
    out = queries.op2_url_filter(spark, small[0]).collect()
    assert sorted(r.page_id for r in out) == sorted(pages)
    for r in out:
        want = test_chat_url.slow_rule(pages[r.page_id])
        assert (r.host, r.path, r.rule) == want[:3] and r.verdict in ("allow", "block") and (want[3] is None or r.verdict == want[3])


def test_op3(spark, small):
    out = queries.op3_suffix_dedup(spark, small[0]).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out), key=str) == test_suffix.brute(small[1], 200)


def test_op4(spark, small):
    groups = {}
    for i, t in small[1]:
        groups.setdefault(test_documents.lower(t), []).append(i)
    of = {i: ids for ids in groups.values() for i in ids}
    out = queries.op4_exact_dedup(spark, small[0]).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in out) == sorted((i, max(of[i]), len(of[i]), i == max(of[i])) for i, _ in small[1])


def test_op5(spark, small):
    got = {(r.doc_id, r.item_id): r.similarity for r in queries.op5_decontamination(spark, small[0]).collect()}
    want = test_documents.brute_leaks(small[1], small[2])
    assert got == pytest.approx(want) and {9100, 9101, 9102, 9103} <= {i for i, _ in want}


def test_op6(spark, small):
    tok, want = tokenizer(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for i, t in small[1]:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        for k, x in enumerate(range(0, len(ids), 2048)):
            want[i, k, x, len(ids[x : x + 2048]), zlib.crc32(ids[x : x + 2048].tobytes())] += 1
    n = test_documents.held_to_rules(queries.op6_packing(spark, small[0]).collect(), 2048, want)
    assert n == -(-sum(k[3] * c for k, c in want.items()) // 2048)


def test_op7(spark, small):
    fps = [test_documents.slow_fingerprint(t) for _, t in small[1]]
    want = sorted((i, f"{fp:016x}", c) for (i, _), fp, c in zip(small[1], fps, test_documents.brute_components(fps, [i for i, _ in small[1]]), strict=True))
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in queries.op7_simhash(spark, small[0]).collect()) == want


def test_op8(spark, small):
    rows = pq.read_table(f"{small[0]}/conversations.parquet").to_pylist()
    out = queries.op8_chat_repair(spark, small[0]).collect()
    assert Counter(r.conv_id for r in out if r.action != "insert") == Counter(r["conv_id"] for r in rows)


def test_op9(spark, small):
    out = {r.doc_id: r for r in queries.op9_language_id(spark, small[0]).collect()}
    assert sorted(out) == sorted(i for i, _ in small[1])
    assert all(r.held_out == (remainder(r.doc_id, 5) == 0) and 0 <= r.score <= 1 for r in out.values())
    assert {i for i, r in out.items() if r.lang_pred == "und"} == {i for i, t in small[1] if not any(map(str.isalpha, t or ""))}


def test_op10(spark, small):
    tok = tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((i, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in small[1])
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op10_token_counts(spark, small[0]).collect()) == want
