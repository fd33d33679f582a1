"""Token ids in files of patched frame-of-reference blocks.

A file holds the ids of consecutive documents, cut into blocks of ``BLOCK`` ids whatever the documents are. A
block stores the differences to its least id, packed at the width that holds ``PERCENT`` % of them; what needs
more bits is listed as exceptions, place and value. The index holds the start of every block, so any range of ids
is read without the rest, and the documents' ids and lengths.

File, all numbers little-endian:

    magic (4 bytes), block payloads,
    block index: start of each block (u64 each),
    documents: lengths (u32 each), ids (i64 each), 1 for a known id and 0 for null (u8 each),
    trailer: blocks u64, ids u64, documents u64, start of the index u64, magic (4 bytes)

    block: least id u32, width u32, exceptions u32, packed differences (width * BLOCK / 8 bytes),
    exception places (u16 each), exception differences (u32 each)

Within a block the differences are dealt over 32 lanes, so that packing works on whole arrays.

Documents are sorted by id over all tasks; each task writes its files under names of its own, and only names that
a finished task has reported are in the list of files, so a task that is repeated leaves no trace in it. The last
block is filled up with its least id.

Edge cases: a null or empty text has no ids but the end id; documents without an id come first; repeated rows and
documents with the same id are written one after the other, by a hash of their text. An empty table gives an
empty list of files. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspan.llm.common import Steps, assembled, distinct_spans, text_bytes, tidy, worker_cache

BLOCK = 1024
LANES = 32
PERCENT = 90
# Ids of a file, at least, but for the last one of a task.
FILE_IDS = 4_000_000
MAGIC = b"PFR1"
# Pieces a worker remembers before it starts anew.
REMEMBERED = 1_200_000

# A text comes apart into these pieces wherever the byte-level pattern starts anew.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Letters of a word end before ASCII punctuation, so a word is learnt once, whatever sign follows it.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_PIECES = re.compile(
    f" ?[{_LETTERS}]++(?=[!-/:-@\\[-`{{-~{_WHITE}]|\\Z)| ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"
)
# Characters of text whose new pieces are encoded together.
TOGETHER = 1 << 20
# Pieces that go to the library as one text: less than a call for each, and its work on long texts takes longer.
LINES = 20
# White space of more than one byte; texts with some are cut by the pattern.
_WIDE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_BYTES = [bytes([b]) for b in range(256)]
_IS_WHITE = np.array([b in b"\t\n\x0b\x0c\r " for b in _BYTES])
_IS_LETTER = np.array([b.isalpha() for b in _BYTES])
_IS_SIGN = np.array([0x21 <= b[0] <= 0x7E and not b.isalnum() for b in _BYTES])


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pieces of UTF-8 texts without white space of more than one byte; all pieces together are the texts.

    A piece begins with each text, where white space follows something else, where a sign follows a letter, and with the
    last white character before something else, which alone belongs to what follows if it is a space.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    white, letter, sign = _IS_WHITE[data], _IS_LETTER[data], _IS_SIGN[data]
    # Accented letters of Latin-1: two bytes, the first 0xC3, but for the two signs among them.
    letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    last = white[:-1] & ~white[1:] & ~begins[1:-1]
    cut = begins[:-1]
    cut[1:] |= (~white[:-1] & white[1:]) | (letter[:-1] & sign[1:]) | (last & (data[:-1] != 0x20))
    cut[:-1] |= last
    return np.flatnonzero(cut)


def bit_length(values: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.int64)


def pack(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Payloads of all blocks and the start of each."""
    count = -(-len(ids) // BLOCK)
    if not count:
        return b"", np.zeros(0, np.uint64)
    padded = np.full(count * BLOCK, ids[(count - 1) * BLOCK :].min(), np.uint32)
    padded[: len(ids)] = ids
    table = padded.reshape(count, BLOCK)
    least = table.min(axis=1)
    table = table - least[:, None]
    rank = BLOCK * PERCENT // 100 - 1
    width = bit_length(np.partition(table, rank, axis=1)[:, rank])
    limit = (np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)
    block, place = np.nonzero(table > limit[:, None])
    exceptions = np.bincount(block, minlength=count)
    size = 12 + width * (BLOCK // 8) + exceptions * 6
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    head = np.stack([least, width.astype(np.uint32), exceptions.astype(np.uint32)], axis=1).astype("<u4")
    out[start[:, None] + np.arange(12)] = head.view(np.uint8).reshape(count, 12)
    for w in np.unique(width):
        if not w:
            continue
        chosen = np.flatnonzero(width == w)
        rows = (table[chosen] & np.uint32((1 << int(w)) - 1)).reshape(len(chosen), -1, LANES)
        packed = np.zeros((len(chosen), int(w), LANES), np.uint32)
        for k in range(BLOCK // LANES):
            word, shift = divmod(k * int(w), 32)
            packed[:, word] |= rows[:, k] << np.uint32(shift)
            if shift + w > 32:
                packed[:, word + 1] |= rows[:, k] >> np.uint32(32 - shift)
        raw = packed.astype("<u4").view(np.uint8).reshape(len(chosen), -1)
        out[(start[chosen] + 12)[:, None] + np.arange(raw.shape[1])] = raw
    nth = np.arange(len(block)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    after = start[block] + 12 + width[block] * (BLOCK // 8)
    out[(after + 2 * nth)[:, None] + np.arange(2)] = place.astype("<u2").view(np.uint8).reshape(-1, 2)
    values = table[block, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    out[(after + 2 * exceptions[block] + 4 * nth)[:, None] + np.arange(4)] = values
    return out.tobytes(), start.astype(np.uint64)


def unpack(payload: np.ndarray, start: np.ndarray, total: int) -> np.ndarray:
    """The first ``total`` ids of the blocks that begin at ``start`` in the payload bytes."""
    start = start.astype(np.int64)
    count = len(start)
    if not count:
        return np.zeros(0, np.uint32)
    head = payload[start[:, None] + np.arange(12)].copy().view("<u4")
    least, width, exceptions = head[:, 0], head[:, 1].astype(np.int64), head[:, 2].astype(np.int64)
    table = np.zeros((count, BLOCK), np.uint32)
    for w in np.unique(width):
        if not w:
            continue
        chosen = np.flatnonzero(width == w)
        raw = payload[(start[chosen] + 12)[:, None] + np.arange(int(w) * BLOCK // 8)]
        packed = np.ascontiguousarray(raw).view("<u4").reshape(len(chosen), int(w), LANES)
        rows = np.zeros((len(chosen), BLOCK // LANES, LANES), np.uint32)
        mask = np.uint32((1 << int(w)) - 1)
        for k in range(BLOCK // LANES):
            word, shift = divmod(k * int(w), 32)
            value = packed[:, word] >> np.uint32(shift)
            if shift + w > 32:
                value = value | (packed[:, word + 1] << np.uint32(32 - shift))
            rows[:, k] = value & mask
        table[chosen] = rows.reshape(len(chosen), BLOCK)
    block = np.repeat(np.arange(count), exceptions)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    after = start[block] + 12 + width[block] * (BLOCK // 8)
    place = payload[(after + 2 * nth)[:, None] + np.arange(2)].copy().view("<u2").reshape(-1)
    value = payload[(after + 2 * exceptions[block] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4").reshape(-1)
    table[block, place] = value
    return (table + least[:, None]).reshape(-1)[:total]


def file_bytes(ids: np.ndarray, lengths: np.ndarray, doc_ids: np.ndarray, known: np.ndarray) -> bytes:
    payload, start = pack(ids)
    index = len(MAGIC) + len(payload)
    trailer = np.array([len(start), len(ids), len(lengths), index], "<u8").tobytes() + MAGIC
    tables = [(start + np.uint64(len(MAGIC))).astype("<u8"), lengths.astype("<u4"), doc_ids.astype("<i8"), known.astype(np.uint8)]
    return b"".join([MAGIC, payload, *(t.tobytes() for t in tables), trailer])


class TokenFile:
    """A file read back: its documents, and any range of its ids."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC or raw[-4:] != MAGIC:
            raise ValueError("not a token file")
        self.raw = np.frombuffer(raw, np.uint8)
        blocks, self.total, docs, at = (int(x) for x in np.frombuffer(raw[-36:-4], "<u8"))
        self.start = np.frombuffer(raw, "<u8", blocks, at)
        self.lengths = np.frombuffer(raw, "<u4", docs, at + 8 * blocks).astype(np.int64)
        self.doc_ids = np.frombuffer(raw, "<i8", docs, at + 8 * blocks + 4 * docs)
        self.known = np.frombuffer(raw, np.uint8, docs, at + 8 * blocks + 12 * docs)

    def ids(self, first: int = 0, stop: int | None = None) -> np.ndarray:
        stop = self.total if stop is None else min(stop, self.total)
        low, high = first // BLOCK, -(-stop // BLOCK)
        found = unpack(self.raw, self.start[low:high], min(high * BLOCK, self.total) - low * BLOCK)
        return found[first - low * BLOCK : stop - low * BLOCK]


def place(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


class Pieces(dict):
    """Packed ids by piece of text; what is missing is encoded by the tokenizers library and kept."""

    def __init__(self, source: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source.decode("utf-8"))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [t.content for t in added]
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None
        self.white = frozenset(c for c in map(chr, range(0x3001)) if re.match(f"[{_WHITE}]", c))

    def encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def learn(self, pieces: list[str]) -> None:
        """Encode new pieces, those that are not white space some to a text, a line each.

        The pattern starts anew after a line break, and no such piece has one, so its id parts the pieces again.
        """
        words = [p for p in pieces if p[-1] not in self.white]
        texts = ["\n".join(words[k : k + LINES]) for k in range(0, len(words), LINES)]
        line = np.array([-1 if self.line is None else self.line], np.int64).astype("<u4").tobytes()
        lines = np.frombuffer(line.join(self.encode(texts)), "<u4")
        cuts = [-1, *np.flatnonzero(lines == self.line).tolist(), len(lines)]
        if self.line is None or len(cuts) != len(words) + 1:
            words, cuts = [], []
        raw = lines.tobytes()
        self.update((p, raw[4 * a + 4 : 4 * b]) for p, a, b in zip(words, cuts, cuts[1:]))
        rest = [p for p in pieces if p not in self]
        self.update(zip(rest, self.encode(rest)))

    def texts(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Packed ids of each text. A call of the library costs as much as dozens of pieces, so many texts share it."""
        some, size = [], 0
        for text in texts:
            some.append(text or "")
            size += len(some[-1])
            if size >= TOGETHER:
                yield from self.together(some)
                some, size = [], 0
        yield from self.together(some)

    def together(self, texts: list[str]) -> Iterator[bytes]:
        # Special tokens may begin inside a piece.
        special = {k for k, text in enumerate(texts) if any(s in text for s in self.special)}
        wide = {k: _PIECES.findall(text) for k, text in enumerate(texts) if k not in special and _WIDE.search(text)}
        plain = ["" if k in special or k in wide else text for k, text in enumerate(texts)]
        data, offsets = text_bytes(pa.array(plain, pa.large_string()))
        starts = piece_starts(data, offsets)
        distinct, numbers = distinct_spans(data, starts, np.append(starts[1:], len(data)))
        others = set().union(*wide.values()).difference(distinct)
        missing = [p for some in (distinct, others) for p in some if p not in self]
        if len(self) + len(missing) > REMEMBERED:
            self.clear()
            missing = [*distinct, *others]
        if missing:
            self.learn(missing)
        found = assembled(list(map(self.__getitem__, distinct)), numbers, np.searchsorted(starts, offsets))
        for k, (text, ids) in enumerate(zip(texts, found)):
            if k in special:
                ids = self.encode([text])[0]
            elif k in wide:
                ids = b"".join(map(self.__getitem__, wide[k]))
            yield ids


def loaded(source: bytes) -> Pieces:
    kept = worker_cache("pieces")
    key = hashlib.md5(source).digest()
    if key not in kept:
        kept[key] = Pieces(source)
    return kept[key]


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int) -> DataFrame:
    """Writes the ids of all texts in ascending order of doc_id below ``folder``; returns the list of files.

    One row per file: ``part, nth`` (its order), ``path, n_docs, n_ids``.
    """
    spark = docs.sparkSession
    source = spark.sparkContext.broadcast(Path(tokenizer).read_bytes())
    end = np.array([end_id], "<u4").tobytes()

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(source.value)
        part, nth = TaskContext.get().partitionId(), 0
        system, root = place(folder)
        system.create_dir(root, recursive=True)
        own = uuid.uuid4().hex
        ids: list[bytes] = []
        doc_ids: list[int | None] = []

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(x) // 4 for x in ids])
            known = np.array([x is not None for x in doc_ids])
            numbers = np.array([x or 0 for x in doc_ids], np.int64)
            name = f"part-{part:06d}-{nth:06d}-{own}.tokens"
            with system.open_output_stream(f"{root}/{name}") as out:
                out.write(file_bytes(np.frombuffer(b"".join(ids), "<u4"), lengths, numbers, known))
            row = [[part], [nth], [f"{folder}/{name}"], [len(ids)], [int(lengths.sum())]]
            return pa.record_batch([pa.array(x) for x in row], names=["part", "nth", "path", "n_docs", "n_ids"])

        waiting = 0
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                some = batch.slice(start, 500)
                encoded = pieces.texts(some.column("text").to_pylist())
                for doc_id, packed in zip(some.column("doc_id").to_pylist(), encoded):
                    ids.append(packed + end)
                    doc_ids.append(doc_id)
                    waiting += len(ids[-1]) // 4
                    if waiting >= FILE_IDS:
                        yield flush()
                        nth, waiting = nth + 1, 0
                        ids.clear()
                        doc_ids.clear()
        if ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    ordered = rows.orderBy("doc_id", F.xxhash64("text"))
    files = ordered.mapInArrow(tidy(written), "part bigint, nth bigint, path string, n_docs bigint, n_ids bigint")
    return Steps(spark, "tokens").table(files, "files")


def read_tokens(files: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before it), n_tokens and its ids, packed as
    little-endian unsigned 32-bit integers."""
    before = Window.orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, -1)
    # One row per file of millions of ids: a short list.
    listed = files.withColumn("before", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, offset in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist()):
                system, name = place(path)
                with system.open_input_file(name) as opened:
                    found = TokenFile(opened.read())
                ids = found.ids().astype("<u4").tobytes()
                ends = np.cumsum(found.lengths)
                starts = ends - found.lengths
                for first in range(0, len(starts), 2000):
                    some = slice(first, first + 2000)
                    packed = [ids[4 * a : 4 * b] for a, b in zip(starts[some].tolist(), ends[some].tolist())]
                    yield pa.record_batch(
                        [
                            pa.array(found.doc_ids[some], mask=found.known[some] == 0),
                            pa.array(starts[some] + offset),
                            pa.array(found.lengths[some]),
                            pa.array(packed, pa.binary()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    # A task per file, whatever their sizes in the list suggest.
    spread = listed.select("path", "before").repartition(max(1, files.count()), "path")
    return spread.mapInArrow(tidy(read), "doc_id bigint, start bigint, n_tokens bigint, ids binary")
