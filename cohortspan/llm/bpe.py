"""Byte-pair encoding and decoding with a given vocabulary file.

A text is cut at white space and then by the vocabulary's pattern into words. A word is a doubly linked
list of symbols; a priority queue holds the merges of neighbouring symbols by rank and place. The best
merge joins two symbols, new neighbours enter the queue, and entries whose symbols have changed since
are skipped when they come up. Decoding joins the vocabulary's strings of the ids.

Words repeat, so every worker remembers the pieces it has encoded, up to a fixed number. The new words of a batch
are merged together, a step of each at a time, on arrays; words of many letters go through the queue. There is no
shuffle: each document is encoded and decoded where it is read, whole.

The vocabulary file is read once by the driver and sent to the workers; its size does not depend on the data.

Edge cases: a null or empty text has no ids and decodes to the empty text; the strings of special tokens in a
text become their ids; white space is dropped and letters become lower case, as the file says. Repeated rows
give the same ids; other columns are not looked at.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import heapq
import itertools
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cohortspan.llm.common import assembled, distinct_spans, give_back, ranges, text_bytes, tidy, worker_cache, words

# Pieces a worker remembers before it starts anew.
REMEMBERED = 50_000

# Most bytes of words that are merged together, and most words at a time.
WIDTHS = (8, 16, 32, 64)
TOGETHER = 1_024
# Bytes of texts that are cut into pieces at a time; one longer text is cut alone.
CUT_BYTES = 1 << 17
# Rank of a pair that does not merge.
NEVER = np.int32(2**31 - 1)

# Characters that str.split() takes for white space although the vocabulary's pattern does not.
_CONTROL = re.compile("[\x1c-\x1f]")
# White space of more than one byte.
_WIDE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class Vocabulary:
    """A vocabulary of merges whose words end in a suffix, as its JSON file describes it."""

    def __init__(self, source: bytes):
        spec = json.loads(source)
        model = spec["model"]
        if model["type"] != "BPE" or spec.get("decoder") is not None or model.get("dropout"):
            raise ValueError("not a vocabulary of plain merges that decodes to its own strings")
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        self.pattern = regex.compile(split["pattern"]["Regex"], regex.V0)
        self.suffix = model["end_of_word_suffix"] or ""
        ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in ids.items()} | {i: s for s, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        # The merges as sorted numbers; no id is as large as base - 1, so a missing neighbour (-1) makes no number of a merge.
        # Arrays, because every worker holds them: as a dictionary of tuples they take ten times the memory.
        self.base = max(ids.values(), default=0) + 2
        merges = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            merges[ids[left] * self.base + ids[right]] = rank, ids[left + right]
        pairs = np.fromiter(merges, np.int64, len(merges))
        order = np.argsort(pairs)
        self.pairs = pairs[order]
        self.one_by_one = memoryview(self.pairs)
        self.ranks = np.array([rank for rank, _ in merges.values()], np.int32)[order]
        self.joined = np.full(len(model["merges"]), -1, np.int32)
        for rank, joined in merges.values():
            self.joined[rank] = joined
        letters = byte_letters()
        self.inner = np.array([ids.get(x, -1) for x in letters], np.int32)
        self.final = np.array([ids.get(x + self.suffix, -1) for x in letters], np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.pairs):
            return np.full(left.shape, NEVER)
        wanted = left.astype(np.int64) * self.base + right
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[at] == wanted, self.ranks[at], NEVER)

    def merge(self, left: int, right: int) -> tuple[int, int] | None:
        """Rank and result of one pair."""
        wanted = left * self.base + right
        at = bisect.bisect_left(self.one_by_one, wanted)
        if at == len(self.one_by_one) or self.one_by_one[at] != wanted:
            return None
        rank = int(self.ranks[at])
        return rank, int(self.joined[rank])

    def merged(self, symbol: np.ndarray) -> np.ndarray:
        """Rows of symbols, filled up with -1, after all merges; -1 also where a symbol went into the one before it.

        Every step does the best merge of each row, the first of equal ones. The last column stays -1: it is the
        neighbour of symbols without one.
        """
        n = symbol.shape[1] - 1
        after = np.tile(np.arange(1, n + 2), (len(symbol), 1))
        before = after - 2
        rank = np.full(symbol.shape, NEVER)
        rank[:, :-1] = self.rank(symbol[:, :-1], symbol[:, 1:])
        rows = np.arange(len(symbol))
        while len(rows):
            i = rank[rows].argmin(axis=1)
            best = rank[rows, i]
            found = best < NEVER
            rows, i, best = rows[found], i[found], best[found]
            joined = self.joined[best]
            h, j = before[rows, i], after[rows, i]
            k = after[rows, j]
            symbol[rows, i], symbol[rows, j] = joined, -1
            after[rows, i], before[rows, k] = k, i
            rank[rows, j] = NEVER
            rank[rows, i] = self.rank(joined, symbol[rows, k])
            rank[rows, h] = self.rank(symbol[rows, h], joined)
        return symbol

    def words(self, texts: list[str]) -> list[bytes]:
        """Packed ids of many words."""
        data, offsets = text_bytes(pa.array(texts, pa.large_string()))
        length = np.diff(offsets)
        symbols = self.inner[data]
        some = length > 0
        symbols[offsets[1:][some] - 1] = self.final[data[offsets[1:][some] - 1]]
        known = np.concatenate([[0], np.cumsum(symbols >= 0)])
        usual = (known[offsets[1:]] - known[offsets[:-1]] == length) & some
        out = [b""] * len(texts)
        least = 0
        for width in WIDTHS:
            chosen = np.flatnonzero(usual & (length > least) & (length <= width))
            least = width
            for start in range(0, len(chosen), TOGETHER):
                part = chosen[start : start + TOGETHER]
                table = np.full((len(part), width + 1), -1, np.int32)
                table[np.repeat(np.arange(len(part)), length[part]), ranges(np.zeros(len(part), np.int64), length[part])] = symbols[
                    ranges(offsets[part], length[part])
                ]
                table = self.merged(table)
                kept = table >= 0
                raw = table[kept].astype("<u4").tobytes()
                ends = 4 * np.cumsum(kept.sum(axis=1))
                for k, a, b in zip(part.tolist(), [0, *ends.tolist()], ends.tolist()):
                    out[k] = raw[a:b]
        for k in np.flatnonzero(some & (~usual | (length > least))).tolist():
            out[k] = pack(self.word(texts[k]))
        return out

    def word(self, text: str) -> list[int]:
        """Ids of one word."""
        letters = np.frombuffer(text.encode("utf-8"), np.uint8)
        if not len(letters):
            return []
        symbols = self.inner[letters]
        symbols[-1] = self.final[letters[-1]]
        symbols = symbols[symbols >= 0]
        n = len(symbols)
        symbol = symbols.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merge = self.merge
        ranks = self.rank(symbols[:-1], symbols[1:])
        queue = []
        for i in np.flatnonzero(ranks < NEVER).tolist():
            rank = int(ranks[i])
            queue.append((rank, i, symbol[i], symbol[i + 1], int(self.joined[rank])))
        heapq.heapify(queue)
        while queue:
            _, i, left, right, joined = heapq.heappop(queue)
            j = after[i]
            if symbol[i] != left or j >= n or symbol[j] != right:
                continue  # a symbol of this entry has been merged since
            symbol[i], symbol[j] = joined, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                found = merge(joined, symbol[k])
                if found:
                    heapq.heappush(queue, (found[0], i, joined, symbol[k], found[1]))
            h = before[i]
            if h >= 0:
                found = merge(symbol[h], joined)
                if found:
                    heapq.heappush(queue, (found[0], h, symbol[h], joined, found[1]))
        return [x for x in symbol if x >= 0]

    def piece(self, text: str) -> bytes:
        """Packed ids of a text without white space."""
        # Lower case by character: a final sigma is no special case.
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return pack([i for word in self.pattern.findall(text) for i in self.word(word)])

    def new_pieces(self, texts: list[str]) -> list[bytes]:
        """Packed ids of many texts without white space."""
        lines = unicodedata.normalize("NFC", "\n".join(texts)).replace("Σ", "σ").lower().split("\n")
        cut = [x if x.isascii() and x.isalpha() else tuple(self.pattern.findall(x)) for x in lines]
        distinct = {x for x in cut if type(x) is str}
        distinct.update(*(x for x in cut if type(x) is tuple))
        listed = list(distinct)
        ids = dict(zip(listed, self.words(listed)))
        return [ids[x] if type(x) is str else b"".join([ids[w] for w in x]) for x in cut]

    def pieces(self, text: str) -> list[str]:
        return _SPACES.split(text) if _CONTROL.search(text) else text.split()


def pack(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


class Remembered(dict):
    """Packed ids by piece; a missing piece is encoded and kept."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        packed = self[piece] = self.vocabulary.piece(piece)
        return packed

    def texts(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text; new pieces of all of them are encoded together."""
        vocabulary = self.vocabulary
        # Special tokens may stand inside a piece.
        special = {k for k, text in enumerate(texts) if text and any(s in text for s in vocabulary.special)}
        plain = ["" if k in special or not text else _WIDE.sub(" ", text) for k, text in enumerate(texts)]
        data, offsets = text_bytes(pa.array(plain, pa.large_string()))
        starts, ends, first = words(data, offsets)
        distinct, numbers = distinct_spans(data, starts, ends)
        packed = list(map(self.get, distinct))
        if None in packed:
            if len(self) + packed.count(None) > REMEMBERED:
                self.clear()
                packed = [None] * len(distinct)
            missing = [k for k, ids in enumerate(packed) if ids is None]
            pieces = [distinct[k] for k in missing]
            for k, piece, ids in zip(missing, pieces, vocabulary.new_pieces(pieces)):
                packed[k] = self[piece] = ids
        found = assembled(packed, numbers, first)
        return [encode_text(text, self) if k in special else ids for k, (text, ids) in enumerate(zip(texts, found))]


def loaded(source: bytes) -> Remembered:
    kept = worker_cache("bpe")
    key = hashlib.md5(source).digest()
    if key not in kept:
        worker_cache("powers").clear()  # what the hashing operators keep is not needed beside a vocabulary
        kept[key] = Remembered(Vocabulary(source))
        give_back()  # what reading the file took
    return kept[key]


def encode_text(text: str, memory: Remembered) -> bytes:
    vocabulary = memory.vocabulary
    if vocabulary.special and any(s in text for s in vocabulary.special):
        out = []
        for k, part in enumerate(vocabulary.cut.split(text)):
            out.append(pack([vocabulary.special[part]]) if k % 2 else b"".join([memory[p] for p in vocabulary.pieces(part) if p]))
        return b"".join(out)
    return b"".join([memory[p] for p in vocabulary.pieces(text) if p])


def _fields(df: DataFrame, **kinds: T.DataType) -> T.StructType:
    named = [T.StructField(name, kind) for name, kind in kinds.items()]
    return T.StructType([T.StructField("doc_id", df.schema["doc_id"].dataType), *named])


def encoded(batches: Iterator[pa.RecordBatch], memory: Remembered) -> Iterator[pa.RecordBatch]:
    for batch in itertools.chain.from_iterable(map(parted, batches)):
        ids = pa.array(memory.texts(batch.column("text").to_pylist()), pa.binary())
        yield from slices(pa.record_batch([batch.column("doc_id"), ids], names=["doc_id", "ids"]))


def decoded(batches: Iterator[pa.RecordBatch], memory: Remembered) -> Iterator[pa.RecordBatch]:
    strings = memory.vocabulary.strings
    for batch in batches:
        for part in slices(batch):
            texts = [" ".join(map(strings.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in part.column("ids").to_pylist()]
            yield pa.record_batch(
                [part.column("doc_id"), part.column("ids"), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"]
            )


def _mapped(df: DataFrame, path: str, work: Callable, columns: list[str], **kinds: T.DataType) -> DataFrame:
    source = df.sparkSession.sparkContext.broadcast(Path(path).read_bytes())
    return df.select(*columns).mapInArrow(tidy(lambda batches: work(batches, loaded(source.value))), _fields(df, **kinds))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids: the token ids of every text, as little-endian unsigned 32-bit integers."""
    return _mapped(docs, path, encoded, ["doc_id", "text"], ids=T.BinaryType())


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, text: the vocabulary's strings of the ids, special tokens included."""
    return _mapped(tokens, path, decoded, ["doc_id", "ids"], ids=T.BinaryType(), text=T.StringType())


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, text: both steps in one worker, which then holds one vocabulary and one memory."""
    both = lambda batches, memory: decoded(encoded(batches, memory), memory)
    return _mapped(docs, path, both, ["doc_id", "text"], ids=T.BinaryType(), text=T.StringType())


def slices(batch: pa.RecordBatch, rows: int = 50) -> Iterator[pa.RecordBatch]:
    """A batch in small parts, so that results do not pile up beside it."""
    return map(functools.partial(batch.slice, length=rows), range(0, batch.num_rows, rows))


def parted(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``CUT_BYTES`` of text: cutting takes several numbers for every byte."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, done = 0, 0
    while start < batch.num_rows:
        stop = max(int(np.searchsorted(ends, done + CUT_BYTES, side="right")), start + 1)
        yield batch.slice(start, stop - start)
        start, done = stop, int(ends[stop - 1])
