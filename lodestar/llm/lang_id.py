"""Language identification as a mixture: EM over n-gram likelihoods, set by penalised likelihood."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

#: Hashed byte trigrams; n-grams in a block that shares one language; EM rounds.
BINS, BLOCK, ROUNDS = 1 << 16, 32, 12
_SPACE = bytes(c if c >= 0x80 or chr(c).isalpha() else 32 for c in range(256))
#: Bytes of normalised text worked on at once.
SLICE = 1 << 20


def _normal(raw: bytes) -> bytes:
    """Lower case, with each run of anything but letters one blank, and a blank at either end."""
    words = raw.decode("utf-8", "replace").lower().encode().translate(_SPACE).split()
    return b" " + b" ".join(words) + b" "


def lettered(raw: bytes) -> bool:
    """Whether a text has a letter of Unicode (category L); numerals that look like letters are none."""
    return any(map(str.isalpha, raw.decode("utf-8", "replace")))


def _bins(text: bytes) -> np.ndarray:
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    return ((b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(16)).astype(np.int64)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log probability of each bin in each), from rows with a language.

    Every row counts. What comes to the driver is BINS counts a language at most.
    """

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(x := _normal(raw)) > 2:
                    total[lang] = total.get(lang, 0) + np.bincount(_bins(x), minlength=BINS) if len(x) > BINS else _add(total.get(lang), _bins(x))
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], names=["lang", "bin", "n"])

    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), text_bytes(text_col).alias("text"))
    got = rows.mapInArrow(count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    counts = np.zeros((len(langs), BINS))
    at = {x: i for i, x in enumerate(langs)}
    if langs:
        counts[[at[x] for x in got.column("lang").to_pylist()], got.column("bin").to_numpy()] = got.column("n").to_numpy()
    return langs, np.log((counts + 0.1) / (counts.sum(1, keepdims=True) + 0.1 * BINS)).astype(np.float32)


def _add(total: np.ndarray | None, bins: np.ndarray) -> np.ndarray:
    if total is None:
        total = np.zeros(BINS, np.int64)
    np.add.at(total, bins, 1)
    return total


def _em(like: np.ndarray, doc: np.ndarray, n: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights (documents x languages) and log likelihoods of each document's blocks (like: blocks x languages)."""
    w = allowed / allowed.sum(1, keepdims=True)
    top = like.max(1, keepdims=True)
    p = np.exp(like - top)
    first = np.r_[0, np.cumsum(n)[:-1]]
    for _ in range(ROUNDS):
        r = w[doc] * p
        r /= np.maximum(r.sum(1, keepdims=True), 1e-300)
        w = np.add.reduceat(r, first, axis=0) / n[:, None]
    s = np.log(np.maximum((w[doc] * p).sum(1), 1e-300)) + top[:, 0]
    return w, np.add.reduceat(s, first)


def infer(texts: list[bytes], logs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best language, its share, number of languages) of each normalised text; texts have a trigram at least."""
    bins = [_bins(t) for t in texts]
    n_grams = np.array([len(b) for b in bins])
    n = -(-n_grams // BLOCK)
    doc = np.repeat(np.arange(len(texts)), n)
    inner = np.arange(n.sum()) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)
    starts = np.repeat(np.r_[0, np.cumsum(n_grams)[:-1]], n) + inner * BLOCK
    like = np.stack([np.add.reduceat(row[np.concatenate(bins)].astype(np.float64), starts) for row in logs], 1)
    full, _ = _em(like, doc, n, np.ones((len(texts), len(logs))))
    order = np.argsort(-full, axis=1, kind="stable")
    best = best_w = size = None
    for k in range(1, len(logs) + 1):
        allowed = np.zeros_like(full)
        np.put_along_axis(allowed, order[:, :k], 1.0, 1)
        w, ll = _em(like, doc, n, allowed)
        worth = ll - 0.5 * k * np.log(np.maximum(n_grams, 2)) * 4
        if best is None:
            best, best_w, size = worth, w, np.ones(len(texts), int)
        else:  # every size is looked at for every text, whatever texts it shares a slice with
            more = worth > best
            best, size = np.where(more, worth, best), np.where(more, k, size)
            best_w = np.where(more[:, None], w, best_w)
    pick = best_w.argmax(1)
    at = np.arange(len(texts))
    return pick, np.minimum(full[at, pick], best_w[at, pick]), size


def _verdicts(raw: list[bytes | None], langs: list[str], logs: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language or und, share, number of languages) of each text."""
    lang, score, many = ["und"] * len(raw), np.zeros(len(raw)), np.zeros(len(raw), np.int32)
    held, size = [], 0
    for i, b in enumerate([*raw, None]):
        if b and langs and lettered(b) and len(x := _normal(b)) > 2:
            held.append((i, x))
            size += len(x)
        if held and (size > SLICE or i == len(raw)):
            at = [k for k, _ in held]
            pick, share, n = infer([x for _, x in held], logs)
            for k, p in zip(at, pick, strict=True):
                lang[k] = langs[p]
            score[at], many[at] = np.clip(share, 0, 1), n
            held, size = [], 0
    return lang, score, many


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred, score, n_langs.

    A null text, one without a letter, and any text under an empty model are `und` with
    score 0 and no languages. Between equal shares the language that sorts first wins.
    score is the share of the text in lang_pred's language. Repeated rows stay repeated;
    other columns are ignored.
    """
    langs, logs = model
    shared = docs.sparkSession.sparkContext.broadcast(logs)  # BINS numbers a language
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches):
        for batch in batches:
            lang, score, many = _verdicts(batch.column(1).to_pylist(), langs, shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(many)], names=["id", "lang_pred", "score", "n_langs"])

    out = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text")).mapInArrow(work, f"id {kind}, lang_pred string, score double, n_langs int")
    return out.withColumnRenamed("id", id_col)


def keep_known(docs: DataFrame, model: tuple[list[str], np.ndarray], least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that are in a language.

    Rejected are null texts, texts without a letter, and texts whose main language makes up
    less than `least` of the mixture. An empty model (no row had a language) rejects only
    the first two. Repeated rows are judged alike. Nothing is shuffled.
    """
    langs, logs = model
    shared = docs.sparkSession.sparkContext.broadcast(logs)
    at = docs.columns.index(text_col)

    def work(batches):
        for batch in batches:
            raw = batch.column(at).cast(pa.binary()).to_pylist()
            if langs:
                lang, score, _ = _verdicts(raw, langs, shared.value)
                keep = [x != "und" and s >= least for x, s in zip(lang, score.tolist(), strict=True)]
            else:
                keep = [b is not None and lettered(b) for b in raw]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
