"""Packing of tokenized documents into training sequences of balanced cost.

A document becomes its token ids and an end id. Documents are taken in descending length, and each goes to the sequence
of the lowest estimated cost (linear in tokens plus quadratic in the length of each piece, as attention within a piece
is) that still has room; what does not fit goes on to the next. As many sequences are open as the tokens need, so less
than one sequence is padding in each group.

A group is what one task has read, closed after ``GROUP_TOKENS`` tokens, so memory is bounded, nothing is shuffled and a
repeated task gives the same pieces. Texts are tokenized whole: they are split into the tokenizer's word pieces with
array operations, and only pieces that were not met before are encoded.
"""

from __future__ import annotations

import heapq
import json
import sys
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgauge.llm.arrays import ranges, segment_hash
from callgauge.llm.common import text_or_empty

SEQUENCE_TOKENS = 1024
GROUP_TOKENS = 4_000_000
BATCH_CHARS = 2_000_000
CACHE_PIECES = 1_000_000
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
END_ID = 0
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"

OTHER, LETTER, NUMBER, SPACE = range(4)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """The kind of each code point."""
    kinds = np.zeros(sys.maxunicode + 1, dtype=np.uint8)
    for code in range(sys.maxunicode + 1):
        category = unicodedata.category(chr(code))[0]
        if category == "L":
            kinds[code] = LETTER
        elif category == "N":
            kinds[code] = NUMBER
    # The code points with the property White_Space.
    spaces = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    kinds[spaces] = SPACE
    return kinds


def piece_starts(codes: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Where the word pieces of byte-level BPE begin: runs of letters, numbers or other signs with at most one blank before
    them, contractions after an apostrophe, and runs of white space, which leave their last sign to what follows."""
    kinds = _kinds()[codes]
    size = len(codes)
    new_doc = np.zeros(size + 1, dtype=bool)
    new_doc[doc_starts] = True
    new_doc[size] = True
    begins = np.empty(size, dtype=bool)
    begins[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=begins[1:])
    begins |= new_doc[:size]
    space = kinds == SPACE
    # The last white-space sign before other text stands alone, unless it is a blank: that one begins the next piece.
    last = np.zeros(size, dtype=bool)
    last[:-1] = space[:-1] & ~space[1:]
    last &= ~new_doc[1:]
    blank = last & (codes == 0x20)
    joined = np.flatnonzero(blank) + 1
    begins |= last
    begins[joined] = False
    # Contractions: an apostrophe that begins a piece, alone, with letters right after it.
    quote = np.flatnonzero((codes[:-1] == 0x27) & begins[:-1] & (kinds[1:] == LETTER) & ~new_doc[1:size]) if size > 1 else np.array([], dtype=int)
    if len(quote):
        one = codes[quote + 1]
        two = np.where(quote + 2 < size, codes[np.minimum(quote + 2, size - 1)], 0)
        two = np.where(new_doc[np.minimum(quote + 2, size)], 0, two)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for which, n in ((short, 2), (long & ~short, 3)):
            at = quote[which]
            begins[at + 1] = False
            after = at + n
            after = after[after < size]
            # A blank that was to begin the next piece still does; letters go on as a piece of their own.
            begins[after] = begins[after] | (kinds[after] == LETTER)
    return np.flatnonzero(begins)


class Encoder:
    """Ids of many texts at once, equal to those of the ``tokenizers`` library for the same vocabulary file."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        self.whole = Tokenizer.from_file(path)
        self.special = [t["content"] for t in described["added_tokens"]]
        to_byte = {sign: byte for byte, sign in _byte_signs().items()}
        specials = set(self.special)
        ranks = {bytes(to_byte[c] for c in word): i for word, i in described["model"]["vocab"].items() if word not in specials}
        self.bpe = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self._forget()

    def _forget(self):
        self.keys = np.empty(0, dtype=np.uint64)
        self.first = np.empty(0, dtype=np.int64)
        self.count = np.empty(0, dtype=np.int64)
        self.flat = np.empty(0, dtype=np.uint32)

    def _learn(self, keys: np.ndarray, texts: list[str]):
        encoded = [self.bpe.encode_ordinary(t) for t in texts]
        count = np.fromiter(map(len, encoded), dtype=np.int64, count=len(encoded))
        first = len(self.flat) + np.cumsum(count) - count
        self.flat = np.concatenate([self.flat, np.fromiter((i for ids in encoded for i in ids), dtype=np.uint32, count=int(count.sum()))])
        keys, first, count = (np.concatenate(pair) for pair in ((self.keys, keys), (self.first, first), (self.count, count)))
        order = np.argsort(keys, kind="stable")
        self.keys, self.first, self.count = keys[order], first[order], count[order]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without special tokens added; special tokens written in a text count as the library counts them."""
        plain = [i for i, t in enumerate(texts) if t and not any(s in t for s in self.special)]
        made: list[np.ndarray] = [np.empty(0, dtype=np.uint32)] * len(texts)
        for i in set(range(len(texts))) - set(plain):
            if texts[i]:
                made[i] = np.array(self.whole.encode(texts[i], add_special_tokens=False).ids, dtype=np.uint32)
        if plain:
            for i, ids in zip(plain, self._encode_plain([texts[i] for i in plain]), strict=True):
                made[i] = ids
        return made

    def _encode_plain(self, texts: list[str]) -> list[np.ndarray]:
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        doc_starts = np.cumsum(lengths) - lengths
        starts = piece_starts(codes, doc_starts)
        keys = segment_hash(codes, starts)
        unique, example, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) > CACHE_PIECES:
            self._forget()
        at = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), dtype=bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == unique[inside]
        if not known.all():
            ends = np.append(starts[1:], len(codes))
            news = example[~known]
            self._learn(unique[~known], [joined[a:b] for a, b in zip(starts[news].tolist(), ends[news].tolist(), strict=True)])
            at = np.searchsorted(self.keys, unique)
        at = at[inverse]
        first, count = self.first[at], self.count[at]
        ids = self.flat[ranges(first, count)]
        piece_of_doc = np.searchsorted(starts, doc_starts)
        total = np.concatenate([[0], np.cumsum(count)])
        cuts = total[piece_of_doc]
        return np.split(ids, cuts[1:])


def _byte_signs() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a visible sign: itself where it is one, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    signs = {b: chr(b) for b in shown}
    signs |= {b: chr(0x100 + n) for n, b in enumerate(b for b in range(256) if b not in signs)}
    return signs


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def assign(lengths: np.ndarray, room: int = SEQUENCE_TOKENS) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of these lengths; lengths are at least one."""
    total = int(lengths.sum())
    count = -(-total // room)
    used = [0] * count
    heap = [(0.0, s) for s in range(count)]
    pieces = []
    for doc in np.argsort(-lengths, kind="stable").tolist():
        start, left = 0, int(lengths[doc])
        while left:
            cost, s = heap[0]
            take = min(left, room - used[s])
            pieces.append((doc, start, take, s, used[s]))
            used[s] += take
            start, left = start + take, left - take
            if used[s] == room:
                heapq.heappop(heap)
            else:
                heapq.heapreplace(heap, (cost + LINEAR * take + QUADRATIC * take * take, s))
    return pieces


def _packed(doc_ids: list, ids: list[np.ndarray], first_sequence: int, schema: pa.Schema) -> pa.RecordBatch:
    lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
    rows = [
        (
            doc_ids[doc], start, n, zlib.crc32(ids[doc][start : start + n].astype("<u4").tobytes()), int(lengths[doc]),
            first_sequence + s, offset, LINEAR * n + QUADRATIC * n * n,
        )
        for doc, start, n, s, offset in assign(lengths)
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def pack(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Pieces of all documents (doc_id, text), as ``SCHEMA`` says; ``vocabulary`` is the path of a tokenizer file on every machine.

    A null or empty text is a document of the end id alone. Repeated rows and null ids are documents of their own; ties in
    length keep their order of reading; an empty table gives no pieces; other columns are ignored.
    """
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("cost", pa.float64())]
    schema = pa.schema(fields)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, task = encoder(vocabulary), TaskContext.get().partitionId()
        sequence = task << 32
        doc_ids, ids, tokens = [], [], 0
        end = np.array([END_ID], dtype=np.uint32)
        for part_ids, texts in _parts(batches):
            for doc_id, own in zip(part_ids, made.encode(texts), strict=True):
                doc_ids.append(doc_id)
                ids.append(np.concatenate([own, end]))
                tokens += len(own) + 1
            if tokens >= GROUP_TOKENS:
                yield _packed(doc_ids, ids, sequence, schema)
                sequence += -(-tokens // SEQUENCE_TOKENS)
                doc_ids, ids, tokens = [], [], 0
        if tokens:
            yield _packed(doc_ids, ids, sequence, schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(groups, SCHEMA)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Rows in portions of about ``BATCH_CHARS`` characters."""
    doc_ids, texts, chars = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            doc_ids.append(doc_id)
            texts.append(text)
            chars += len(text)
            if chars >= BATCH_CHARS:
                yield doc_ids, texts
                doc_ids, texts, chars = [], [], 0
    if doc_ids:
        yield doc_ids, texts
