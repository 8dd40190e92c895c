"""Brown class-based bigram model: exchange clustering, class transitions, word emissions.

The most frequent words, and one type for all other words of a like ending, are clustered by
exchange over their bigrams in the whole corpus. Each further word then joins the class that
its own neighbours make most likely: the counts of classes before and after each word are
gathered over the whole corpus, combined before and after the shuffle, so they grow with the
vocabulary while no task or driver holds more than a bounded part. Only words too rare to
tell, and unseen ones, stay in the class of their ending.

P(w | v) = a P(class of w | context of v) P(w | class of w) + (1 - a) P(w). The context of v
is its class by exchange or ending, which every worker knows without a join. With add-one
emissions both terms have the factor count(w) + 1, so a text's score is the sum of
log10(count + 1) and of a table over (context, class); frequent words look both up, rare
ones join them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_bytes

#: Bytes of text whose words a worker tells apart together.
BYTES = 8 << 20


@dataclass
class Model:
    """words: (word, n, cls) for all training words but those of the exchange. known: the frequent ones with counts and classes; context: classes of types."""

    words: DataFrame
    tokens: int
    distinct: int
    end: int
    known: dict[bytes, tuple[int, int]]
    least: int
    context: np.ndarray
    table: np.ndarray
    frequent: int
    tails: int
    first: dict[bytes, int]


def _tail_type(word: bytes, frequent: int, tails: int) -> int:
    return frequent + zlib.crc32(word[-2:]) % tails


@lru_cache
def _endings(frequent: int, tails: int) -> np.ndarray:
    """Types of all endings, those of one byte first."""
    return np.array([_tail_type(bytes(x), frequent, tails) for x in [*([a] for a in range(256)), *([a, b] for a in range(256) for b in range(256))]])


def _tail_types(words: pa.Array, frequent: int, tails: int) -> np.ndarray:
    """_tail_type of each word; none is empty."""
    if not len(words):
        return np.zeros(0, np.int64)
    edge = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)
    last, other = data[edge[1:] - 1].astype(np.int64), data[edge[1:] - 2].astype(np.int64)
    return _endings(frequent, tails)[np.where(np.diff(edge) > 1, 256 + 256 * other + last, last)]


def _types(words: pa.Array, first: pa.Array, frequent: int, tails: int) -> np.ndarray:
    """Type of each word: its place in first, the words of the exchange, else that of its ending."""
    at = pc.index_in(words, value_set=first).fill_null(-1).to_numpy()
    return np.where(at >= 0, at, _tail_types(words, frequent, tails))


def _spelled(batches: Iterable[pa.RecordBatch], column: int = 0, size: int = BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray]]:
    """(rows, words, codes) for rows whose texts have about size bytes together.

    words are the distinct words of ASCII white space, A-Z lower-cased. codes are an end, then
    each text's words by their places in words and one end. An end is len(words). Words are
    told apart by Arrow, so no Python object is made for a token.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(column)
        starts = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text)].astype(np.int64)
        new = np.flatnonzero(np.diff((starts - starts[0]) // size)) + 1
        for a, b in pairwise([0, *new.tolist(), len(text)]):
            rows = batch.slice(a, b - a)
            held = rows.column(column)
            if starts[b - 1] - starts[a] + len(held[-1].as_buffer()) > 2 * size:  # a long text, perhaps of much white space: each byte of it is a cut
                held = pc.replace_substring_regex(held, "[\\t-\\r ]{2,}", " ")
            split = pc.ascii_split_whitespace(pc.ascii_lower(held.view(pa.string())))
            flat, of_text = split.flatten(), np.repeat(np.arange(b - a), split.value_lengths().to_numpy())
            full = pc.binary_length(flat).to_numpy() > 0  # white space at either end leaves empty strings
            if not full.all():
                flat, of_text = flat.filter(pa.array(full)), of_text[full]
            coded = flat.dictionary_encode()
            words = coded.dictionary.cast(pa.binary())
            codes = np.full(len(coded) + b - a + 1, len(words), np.int64)
            codes[np.arange(len(coded)) + of_text + 1] = coded.indices.to_numpy()
            yield rows, words, codes


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): words of ASCII white space, A-Z lower-cased; combined in each task first."""

    def work(batches):
        for _, words, codes in _spelled(batches):
            n = pa.array(np.bincount(codes)[:-1])
            for k in range(0, len(words), 100_000):
                yield pa.RecordBatch.from_arrays([words.slice(k, 100_000), n.slice(k, 100_000)], names=["word", "n"])

    rows = docs.select(text_bytes(text_col).alias("text")).mapInArrow(work, "word binary, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def exchange(pairs: np.ndarray, classes: int, sweeps: int = 12) -> np.ndarray:
    """Class of each type from bigram counts (types x types); the last type, the end, stays alone in class 0.

    The most frequent types start a class each. Types then come in, and in later sweeps
    move, in turn, frequent ones first, to the class that raises the likelihood of the class
    bigrams most, until a sweep moves none.
    """
    n = len(pairs)
    total = pairs.sum(0) + pairs.sum(1)
    order = np.argsort(-total[:-1], kind="stable")
    of = np.zeros(n, np.int64)
    of[order] = -1
    of[order[: classes - 1]] = 1 + np.arange(min(n, classes) - 1)
    one = np.zeros((n, classes))
    one[of >= 0, of[of >= 0]] = 1
    left, right = pairs.T @ one, pairs @ one  # counts of a type after and before each class
    m = one.T @ right

    def f(x):
        return x * np.log(np.maximum(x, 1))

    for _ in range(sweeps):
        moved = 0
        for w in order.tolist():
            if not total[w]:
                continue
            a, own = of[w], pairs[w, w]
            lft, rgt = left[w].copy(), right[w].copy()
            if a >= 0:
                lft[a] -= own
                rgt[a] -= own
                m[a] -= rgt
                m[:, a] -= lft
                m[a, a] -= own
            fm = f(m)
            row = f(m + rgt) - fm  # row b grows by the words after w
            col = f(m + lft[:, None]) - fm
            gain = row.sum(1) + col.sum(0) - np.diag(row) - np.diag(col) + f(np.diag(m) + rgt + lft + own) - np.diag(fm)
            out, into = m.sum(1) + lft, m.sum(0) + rgt  # whatever the class of w
            gain -= f(out + rgt.sum() + own) - f(out) + f(into + lft.sum() + own) - f(into)
            gain[0] = -np.inf
            b = int(gain.argmax())
            if a >= 0 and gain[b] <= gain[a] + 1e-9:
                b = a
            m[b] += rgt
            m[:, b] += lft
            m[b, b] += own
            if b != a:
                moved += 1
                of[w] = b
                if a >= 0:
                    left[:, a] -= pairs[w]
                    right[:, a] -= pairs[:, w]
                left[:, b] += pairs[w]
                right[:, b] += pairs[:, w]
        if not moved:
            break
    return np.where(of < 0, 1, of)  # types that never came up


def neighbours(docs: DataFrame, text_col: str, types, of: np.ndarray, frequent: int, tails: int, classes: int) -> DataFrame:
    """(word, dense, held) of each word outside the exchange: contexts before and after it, several rows a word.

    held is two bytes for each occurrence (the context before, and classes + the one after),
    or once that would be longer, the 64-bit counts of all of them (dense).
    """
    end = frequent + tails

    def work(batches):
        first, of_type = pa.array(list(types.value), pa.binary()), of.astype(np.uint8)
        keys: list[pa.Array] = []
        at: list[np.ndarray] = []
        codes: list[np.ndarray] = []

        def take(words: pa.Array, tokens: np.ndarray):
            t = np.r_[_types(words, first, frequent, tails), end]
            mine = (t >= frequent) & (t < end)
            c, here = of_type[t][tokens], np.flatnonzero(mine[tokens])
            at.append((np.cumsum(mine) - 1 + sum(map(len, keys)))[tokens[here]])
            codes.append(np.column_stack([c[here - 1], c[here + 1] + np.uint8(classes)]))
            keys.append(words.filter(pa.array(mine[:-1])))

        def out():
            names = pa.concat_arrays(keys).dictionary_encode()
            w, x = names.indices.to_numpy()[np.concatenate(at)], np.concatenate(codes)
            names = names.dictionary
            x = x[np.argsort(w, kind="stable")]
            many = np.bincount(w, minlength=len(names))
            edge = np.r_[0, np.cumsum(many)]
            long = 2 * many > 16 * classes
            for k in np.flatnonzero(long).tolist():
                held = np.bincount(x[edge[k] : edge[k + 1]].ravel(), minlength=2 * classes).astype(np.int64).tobytes()
                yield pa.RecordBatch.from_arrays([names.slice(k, 1), pa.array([True]), pa.array([held], pa.binary())], names=["word", "dense", "held"])
            few = np.flatnonzero(~long)
            x = np.ascontiguousarray(x[~np.repeat(long, many)]).ravel()
            ends = np.r_[0, 2 * np.cumsum(many[few])].astype(np.int32)
            held = pa.Array.from_buffers(pa.binary(), len(few), [None, pa.py_buffer(ends), pa.py_buffer(x)])
            names = names.take(pa.array(few))
            for k in range(0, len(few), 100_000):
                yield pa.RecordBatch.from_arrays([names.slice(k, 100_000), pa.array(np.zeros(len(names.slice(k, 100_000)), bool)), held.slice(k, 100_000)], names=["word", "dense", "held"])
            keys.clear()
            at.clear()
            codes.clear()

        size = 0
        for _, words, tokens in _spelled(batches):
            take(words, tokens)
            size += len(tokens)
            if size > 4_000_000 or sum(k.nbytes for k in keys) > 1 << 28:
                yield from out()
                size = 0
        if keys:
            yield from out()

    return docs.select(text_bytes(text_col).alias("text")).mapInArrow(work, "word binary, dense boolean, held binary")


def placed(contexts: DataFrame, m: np.ndarray, of: np.ndarray, frequent: int, tails: int, least: int) -> DataFrame:
    """(word, n, cls, sums) from neighbours(): each word once with the class its neighbours make most likely.

    Rows without a word have, for each class that a task has filled, sums: the contexts
    before its words, its tokens and its words.
    """
    classes = len(m)
    before = np.log((m + 0.5) / (m.sum(0) + 0.5 * classes))  # context before, class
    after = np.log((m + 0.5) / (m.sum(1, keepdims=True) + 0.5 * classes)).T  # context after, class

    def work(batches):
        total = np.zeros((classes, classes + 2), np.int64)
        last = None  # the word that may go on in the next batch, with its counts

        def out(words: pa.Array, x: np.ndarray):
            lft, rgt = x[:, :classes], x[:, classes:]
            n = lft.sum(1)
            fit = lft @ before + rgt @ after
            fit[:, 0] = -np.inf  # of the end
            c, rare = fit.argmax(1), np.flatnonzero(n < least)
            c[rare] = of[_tail_types(words.take(pa.array(rare)), frequent, tails)]
            one = np.zeros((len(c), classes))
            one[np.arange(len(c)), c] = 1
            total[:, :classes] += (one.T @ lft).astype(np.int64)
            total[:, classes] += np.bincount(c, n, classes).astype(np.int64)
            total[:, classes + 1] += np.bincount(c, minlength=classes)
            return pa.RecordBatch.from_arrays([words, pa.array(n), pa.array(c.astype(np.int32)), pa.array([None] * len(n), pa.list_(pa.int64()))], names=["word", "n", "cls", "sums"])

        for batch in batches:
            words, dense, held = batch.columns
            if not len(words):
                continue
            new = np.r_[True, pc.not_equal(words.slice(1), words.slice(0, len(words) - 1)).to_numpy(zero_copy_only=False)]
            of_row = np.cumsum(new) - 1
            dense = dense.to_numpy(zero_copy_only=False)
            ends = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1]
            data = np.frombuffer(held.buffers()[2], np.uint8)[ends[0] : ends[-1]]
            row = np.repeat(np.arange(len(held)), np.diff(ends))
            short = ~dense[row]
            width = 2 * classes
            x = np.bincount(of_row[row[short]] * width + data[short], minlength=(of_row[-1] + 1) * width).reshape(-1, width)
            for i in np.flatnonzero(dense).tolist():
                x[of_row[i]] += np.frombuffer(held[i].as_py(), np.int64)
            words = words.take(pa.array(np.flatnonzero(new)))
            if last is not None:
                if words[0].equals(last[0][0]):
                    x[0] += last[1][0]
                else:
                    yield out(*last)
            last = words.slice(len(words) - 1), x[-1:].copy()
            if len(words) > 1:
                yield out(words.slice(0, len(words) - 1), x[:-1])
        if last is not None:
            yield out(*last)
        at = np.flatnonzero(total[:, -1])
        yield pa.RecordBatch.from_arrays([pa.array([None] * len(at), pa.binary()), pa.array([0] * len(at), pa.int64()), pa.array(at.astype(np.int32)), pa.array(list(total[at]), pa.list_(pa.int64()))], names=["word", "n", "cls", "sums"])

    return cut(contexts.repartition("word").sortWithinPartitions("word").mapInArrow(work, "word binary, n long, cls int, sums array<long>"))


def fit(docs: DataFrame, text_col: str = "text", classes: int = 48, frequent: int = 640, tails: int = 255, least_seen: int = 3, looked_up: int = 65_536, mix: float = 0.9) -> Model:
    """Learn from all rows of docs.

    frequent and tails are the types that exchange clustering moves; words seen least_seen
    times or more then choose their class by their own neighbours. looked_up bounds the
    words sent to every executor; all others are joined when scoring. Nothing of the corpus
    is left out.
    """
    if classes > 127:
        raise ValueError("contexts before and after are kept in one byte: at most 127 classes")
    words = cut(word_counts(docs, text_col))
    texts = docs.count()
    # Counts at which few enough words are at least as frequent, from a small histogram.
    bucket = F.floor(F.log2("n") * 16)
    by = words.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).orderBy(F.desc("b")).collect()
    least, many = 1 << 62, 0
    for r in by:
        if (many := many + r.words) > looked_up:
            break
        least = r.least
    got = words.where(F.col("n") >= least).toArrow()
    top = sorted(zip(got.column("n").to_pylist(), got.column("word").to_pylist(), strict=True), key=lambda x: (-x[0], x[1]))
    n_types = frequent + tails + 1
    end = n_types - 1
    types = docs.sparkSession.sparkContext.broadcast({w: i for i, (_, w) in enumerate(top[:frequent])})

    def pairs(batches):
        first, total = pa.array(list(types.value), pa.binary()), np.zeros(n_types * n_types, np.int64)
        for _, words, tokens in _spelled(batches):
            x = np.r_[_types(words, first, frequent, tails), end][tokens]
            total += np.bincount(x[:-1] * n_types + x[1:], minlength=len(total))
        at = np.flatnonzero(total)
        for k in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[k : k + 100_000].astype(np.int32)), pa.array(total[at[k : k + 100_000]])], names=["pair", "n"])

    rows = docs.select(text_bytes(text_col).alias("text")).mapInArrow(pairs, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(n_types * n_types)
    counts[rows.column("pair").to_numpy()] = rows.column("n").to_numpy()
    counts = counts.reshape(n_types, n_types)
    of = exchange(counts, classes)
    one = np.eye(classes)[of]

    rest = placed(neighbours(docs, text_col, types, of, frequent, tails, classes), one.T @ counts @ one, of, frequent, tails, least_seen)
    size, kinds = np.zeros(classes), np.zeros(classes)
    m = one.T @ counts[:, :frequent] @ one[:frequent]  # contexts before the words of the exchange
    m[:, 0] += one.T @ counts[:, end]
    for i, (n, _) in enumerate(top[:frequent]):
        size[of[i]] += n
        kinds[of[i]] += 1
    for r in rest.where("word IS NULL").groupBy("cls").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(classes + 2)]).collect():
        m[:, r.cls] += r[1 : classes + 1]
        size[r.cls] += r[classes + 1]
        kinds[r.cls] += r[classes + 2]
    size[0], kinds[0] = texts, bool(texts)
    tokens, distinct = int(size.sum()), int(kinds.sum())
    step = (m + 0.5) / (m.sum(1, keepdims=True) + 0.5 * classes)
    table = np.log10(mix * step / (size + kinds + 1) + (1 - mix) / (tokens + distinct + 1))
    rest = rest.where("word IS NOT NULL").drop("sums")
    known = {w: (n, int(of[i])) for i, (n, w) in enumerate(top[:frequent])}
    known |= {r.word: (r.n, r.cls) for r in rest.where(F.col("n") >= least).toLocalIterator()}
    known = {bytes(w): x for w, x in known.items()}
    first = {w: int(of[i]) for i, (_, w) in enumerate(top[:frequent])}
    return Model(rest, tokens, distinct, texts, known, least, of, table, frequent, tails, first)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", also: dict[str, Column] | None = None) -> DataFrame:
    """Per row: id, the columns of also, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words of ASCII white space with A-Z lower-cased, then one end. base_score is
    the add-one unigram log10 probability, score the model's. A null or empty text has the
    end alone. Each row is scored by itself, so repeated rows and null ids stay as they
    are; other columns are ignored. A model of no text knows no token. docs must be a stored
    table, whose rows are in the same places each time it is read.
    """
    also = also or {}
    kind = docs.schema[id_col].dataType.simpleString()
    end, frequent, tails = model.end, model.frequent, model.tails
    # What a token adds: log10(count + 1) and its class, for frequent words, the end and all others.
    logs = np.log10(np.array([*(n for n, _ in model.known.values()), end, 0], np.int64) + 1)
    cls = np.array([*(c for _, c in model.known.values()), 0, 0])
    shared = docs.sparkSession.sparkContext.broadcast((list(model.known), list(model.first), logs, cls, model.context, model.table))

    def work(batches):
        known, first, logs, cls, of, table = shared.value
        known, first, classes = pa.array(known, pa.binary()), pa.array(first, pa.binary()), len(table)
        for rows, words, codes in _spelled(batches, 1):
            rows, last = rows.column(0).to_numpy(), len(words)
            c = np.r_[of[_types(words, first, frequent, tails)], 0]  # as a context
            place = np.r_[pc.index_in(words, value_set=known).fill_null(-1).to_numpy(), len(known)]
            before, n = c[codes[:-1]], codes[1:]
            x, ends = place[n], np.flatnonzero(n == last) + 1
            rare, begin = x < 0, np.r_[0, ends[:-1]]
            text = np.repeat(np.arange(len(rows)), ends - begin)
            steps = np.where(rare, 0.0, table[before, cls[x]])
            # Pairwise sums, which stay exact enough for texts of any length.
            own = [ends - begin, np.add.reduceat(~rare, begin, dtype=np.int64) - (end == 0), np.add.reduceat(logs[x], begin), np.add.reduceat(steps, begin)]
            at, many = np.unique((text[rare] * last + n[rare]) * classes + before[rare], return_counts=True)
            at, before = np.divmod(at, classes)
            text, n = np.divmod(at, max(last, 1))
            keys = pa.concat_arrays([pa.array([b" %d" % r for r in rows.tolist()], pa.binary()), words.take(pa.array(n))])
            told, none = np.arange(len(keys)) >= len(rows), np.zeros(len(n))
            columns = [np.r_[rows, rows[text]], keys, np.r_[0 * rows, before], np.r_[0 * rows, c[n]], np.r_[own[0], many], np.r_[own[1], 0 * many], np.r_[own[2], none], np.r_[own[3], none]]
            out = pa.RecordBatch.from_arrays([x if i == 1 else pa.array(x, t, mask=~told if i == 2 else None) for i, (x, t) in enumerate(zip(columns, kinds, strict=True))], names=fields)
            for k in range(0, len(out), 100_000):
                yield out.slice(k, 100_000)

    fields = ["row", "word", "before", "cls", "many", "n_known", "logs", "steps"]
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    base = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), text_bytes(text_col).alias("text"), *[c.alias(f"also_{k}") for k, c in also.items()])
    spelled = base.select("row", "text").mapInArrow(work, "row long, word binary, before int, cls int, many long, n_known long, logs double, steps double")
    # A text's own row has a key that no word has, so that rows spread evenly. Others: a rare word, many times after a context.
    rare = model.words.where(F.col("n") < model.least).withColumnRenamed("cls", "own")
    met = spelled.join(rare, "word", "left")
    told = F.col("before").isNotNull()
    hit = told & F.col("n").isNotNull()
    step = F.get(F.lit(model.table.ravel().tolist()), F.col("before") * model.table.shape[1] + F.coalesce("own", "cls"))
    parts = met.groupBy("row").agg(
        F.sum(F.when(told, 0).otherwise(F.col("many"))).alias("n_tokens"), F.sum(F.when(hit, F.col("many")).otherwise(F.col("n_known"))).alias("n_known"),
        F.sum(F.when(hit, F.col("many") * F.log10(F.col("n") + 1)).otherwise(F.col("logs"))).alias("logs"), F.sum(F.when(told, F.col("many") * step).otherwise(F.col("steps"))).alias("steps"),
    )
    head = base.drop("text").join(parts, "row")
    unit = float(np.log10(model.tokens + model.distinct + 1))
    return head.select(
        F.col("id").cast(kind).alias(id_col), *[F.col(f"also_{k}").alias(k) for k in also], "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(unit)).alias("base_score"), (F.col("logs") + F.col("steps")).alias("score"),
    )
