"""Encoding with public tokenizer files: cached pieces, and huge texts by overlapping chunks.

Both byte-level vocabularies split a text with a pattern none of whose matches runs from
a non-space into a space, and no special string holds a space. So a position whose left
neighbour is not white space and whose right neighbour is a blank or a line feed is a
token boundary whatever stands around it: encoding both sides apart gives the same ids.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

_LETTER = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])"  # ASCII and Latin-1, in UTF-8
PIECE = re.compile(rb"[ \n]*" + _LETTER + rb"+(?=[.,;:!? \n]|$)|[ \n]*[^ \n]+|[ \n]+")
#: A run of letters; the same after a blank or a line feed, which is a match with it or one of its own.
RUN, LONE = re.compile(_LETTER + rb"+"), re.compile(rb"[ \n]?" + _LETTER + rb"+")
STOPS = tuple(bytes([c]) for c in b".,;:!?")
OTHER_SPACE = re.compile(r"[^\S \n]")
#: Bytes that no white space but the blank and the line feed has in UTF-8.
_PLAIN = bytes(c for c in range(256) if c not in b"\t\r\x0b\x0c\x1c\x1d\x1e\x1f\xc2\xe1\xe2\xe3")
#: Entries of a worker's cache of pieces before it starts anew, and bytes encoded at once.
CACHE, SLICE = 200_000, 1_000_000


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def _stable(text: str, p: int) -> bool:
    return text[p] in " \n" and not text[p - 1].isspace()


def encode_spliced(tok, text: str, chunk: int, overlap: int) -> list[int]:
    """The ids of text, encoded in overlapping chunks and spliced where both agree.

    Two neighbours are spliced at the last position in their overlap that starts a token
    in both and is stable (see above). With none, the overlap doubles; when it would reach
    back over the current chunk, the current chunk is made longer instead. A text without
    any stable position is thus encoded whole.
    """
    n, ids = len(text), []
    start = a = 0  # ids before start are final; the current chunk begins at a
    end = min(n, chunk)
    enc = tok.encode(text[a:end], add_special_tokens=False)
    while end < n:
        back, found = overlap, None
        while found is None and end - back > start:
            b = end - back
            nxt = tok.encode(text[b : min(n, end + chunk - back)], add_special_tokens=False)
            both = {x + b for x, _ in nxt.offsets} & {x + a for x, _ in enc.offsets}
            found = max((p for p in both if max(start, b) < p < end and _stable(text, p)), default=None)
            back *= 2
        if found is None:
            end = min(n, end + max(chunk, end - a))
            enc = tok.encode(text[a:end], add_special_tokens=False)
            continue
        ids += [i for i, (x, _) in zip(enc.ids, enc.offsets, strict=True) if start <= x + a < found]
        start, a, enc = found, b, nxt
        end = min(n, end + chunk - back // 2)
    return ids + [i for i, (x, _) in zip(enc.ids, enc.offsets, strict=True) if x + a >= start]


class Merger:
    """Byte-level BPE of single matches, by ranks of merged strings.

    A vocabulary with an end-of-word suffix marks the last symbol of a word. Here a byte
    that UTF-8 never has follows the word, and joins its last byte before all other merges.
    """

    END = b"\xff"

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        shown = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c <= 255]
        hidden = [c for c in range(256) if c not in set(shown)]
        name = {c: chr(c) for c in shown} | {c: chr(256 + i) for i, c in enumerate(hidden)}
        byte = {n: c for c, n in name.items()}
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab, ranks, ids = model["vocab"], {bytes([c]): c for c in range(256)}, [model["vocab"].get(name[c], 0) for c in range(256)]
        if self.suffix:
            ranks |= {bytes([c]) + self.END: 256 + c for c in range(256)}
            ids += [vocab.get(name[c] + self.suffix, 0) for c in range(256)]
        for pair in model["merges"]:
            whole = "".join(pair.split(" ") if isinstance(pair, str) else pair)
            ended = self.suffix and whole.endswith(self.suffix)
            raw = bytes(byte[c] for c in (whole[: -len(self.suffix)] if ended else whole)) + (self.END if ended else b"")
            if raw not in ranks:
                ranks[raw] = len(ids)
                ids.append(vocab[whole])
        self.ids = [i.to_bytes(4, "little") for i in ids]
        self.merge = tiktoken.Encoding("merger", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


class Pieces(dict):
    """A bounded cache from a piece of text to the bytes of its ids (or to their number)."""

    def __init__(self, path: str, counts: bool):
        self.tok, self.counts, self.merger = tokenizer(path), counts, Merger(path)

    def learn(self, pieces: set[bytes]) -> None:
        new = [p for p in pieces if p not in self]
        if len(self) + len(new) > CACHE:
            self.clear()
            new = list(pieces)
        merge, other = self.merger.merge, []
        if self.counts:
            for p in new:
                if LONE.fullmatch(p):
                    self[p] = len(merge(p)) if p[0] != 10 else 1 + len(merge(p[1:]))
                else:
                    other.append(p)
        else:
            ids = self.merger.ids
            for p in new:
                run = p[:-1] if p[-1:] in STOPS else p
                if not RUN.fullmatch(run):
                    other.append(p)
                    continue
                if run not in self:
                    low = run.lower() if run.isascii() else run.decode().lower().encode()
                    self[run] = b"".join(map(ids.__getitem__, merge(low + Merger.END)))
                if run is not p:
                    self[p] = self[run] + ids[merge(p[-1:] + Merger.END)[0]]
        for p, e in zip(other, self.tok.encode_batch_fast([p.decode("utf-8", "replace") for p in other], add_special_tokens=False), strict=True):
            self[p] = len(e.ids) if self.counts else np.array(e.ids, "<u4").tobytes()


def slices(texts: list[bytes]):
    """Runs of consecutive texts of about SLICE bytes together."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= SLICE:
            yield range(first, i + 1)
            first, held = i + 1, 0
    if first < len(texts):
        yield range(first, len(texts))


@lru_cache(maxsize=4)
def _pieces(path: str, counts: bool) -> Pieces:
    return Pieces(path, counts)


def _odd(text: bytes) -> bool:
    """Whether a text has white space other than the blank and the line feed."""
    return bool(text.translate(None, _PLAIN)) and OTHER_SPACE.search(text.decode("utf-8", "replace")) is not None


def count_each(texts: list[bytes], path: str, chunk: int, overlap: int) -> list[int]:
    """The number of byte-level BPE tokens of each text."""
    cache, out = _pieces(path, True), []
    for run in slices(texts):
        cut = {i: PIECE.findall(texts[i]) for i in run if len(texts[i]) <= chunk and not _odd(texts[i])}
        cache.learn(set().union(*cut.values()))
        for i in run:
            if i in cut:
                out.append(sum(map(cache.__getitem__, cut[i])))
            else:
                out.append(len(encode_spliced(cache.tok, texts[i].decode("utf-8", "replace"), chunk, overlap)))
    return out


def ids_each(texts: list[bytes], path: str) -> list[bytes]:
    """The ids of each text as little-endian 32-bit words, for vocabularies that drop case and white space."""
    cache, out = _pieces(path, False), []
    for run in slices(texts):
        # A special string is one in the case that it has.
        words = [(texts[i] if b"<|" in texts[i] else texts[i].lower()).split() for i in run]
        cache.learn(set().union(*words))
        out += [b"".join(map(cache.__getitem__, w)) for w in words]
    return out
