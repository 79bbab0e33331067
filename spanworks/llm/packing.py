"""Packing documents into fixed sequences with minimum bin slack."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

#: Tokens of a sequence; a shorter one is padded to it, unless its length is a power of two.
CAPACITY = 2048
#: Ends every document.
END = 1
#: Tokens that are packed together: some 2,000 sequences, 16 MB of ids.
BLOCK = 1 << 22
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: What the two libraries might not cut alike: later Unicode, and a special token's text.
_BEYOND_LATIN = re.compile(r"[^\x00-\u024F]")
_SPECIAL = "<|endoftext|>"


class Encoder:
    """Ids of a byte-level BPE tokenizer. Latin texts without a special token's text take the faster of two libraries that
    share one vocabulary and cut these alike (a test compares them); all others the first."""

    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.latin = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        """The text's ids and END."""
        if (text.isascii() or not _BEYOND_LATIN.search(text)) and _SPECIAL not in text:
            ids = self.latin.encode_to_numpy(text, disallowed_special=())
        else:
            ids = self.whole.encode(text, add_special_tokens=False).ids
        return np.append(np.asarray(ids, "<u4"), np.uint32(END)).astype("<u4", copy=False)


class Pool:
    """The pieces that are not placed yet, by length: a multiset of lengths, and which pieces they are."""

    def __init__(self):
        self.pieces: list[list[tuple[int, int]]] = [[] for _ in range(CAPACITY)]
        self.total = 0

    def add(self, length: int, doc: int, start: int) -> None:
        self.pieces[length].append((doc, start))
        self.total += length

    def take(self, length: int) -> tuple[int, int, int]:
        self.total -= length
        return (*self.pieces[length].pop(), length)

    def lengths(self) -> list[int]:
        """The lengths that occur, the largest first."""
        return [n for n in range(CAPACITY - 1, 0, -1) if self.pieces[n]]

    def closest(self, window: int, lengths: list[int]) -> tuple[dict[int, int], int]:
        """The multiset of lengths that leaves the least slack in a window, as counts, and that slack.

        Bit s of `reached` tells whether some multiset adds up to s. Lengths are added from the largest down, each by
        steps of 1, 2, 4, ... copies up to what there is, until the window is met; then the steps are walked back."""
        reached, steps, full = 1, [], 1 << window
        for length in lengths:
            left = min(len(self.pieces[length]), window // length)
            copies = 1
            while left > 0:
                copies = min(copies, left)
                steps.append((length, copies, reached))
                reached |= reached << length * copies & (full << 1) - 1
                left -= copies
                copies *= 2
            if reached & full:
                break
        at = reached.bit_length() - 1
        counts: dict[int, int] = {}
        slack = window - at
        for length, copies, before in reversed(steps):
            if not before >> at & 1:
                counts[length] = counts.get(length, 0) + copies
                at -= length * copies
        return counts, slack


def fill(pool: Pool) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of (doc, start, length) that use up the pool. Each window takes the largest piece left and the multiset
    that leaves the least slack beside it, again as long as there are pieces for it. What slack is left is filled by
    cutting a piece, so no window is padded; the last windows are powers of two that add up to what is left."""
    lengths = pool.lengths()
    while pool.total:
        window = CAPACITY if pool.total >= CAPACITY else 1 << pool.total.bit_length() - 1
        while lengths and not pool.pieces[lengths[0]]:
            lengths.pop(0)
        largest = next((n for n in lengths if n <= window and pool.pieces[n]), 0)
        pool_of_largest = pool.pieces[largest] if largest else []
        held = pool_of_largest.pop() if largest else None
        counts, slack = pool.closest(window - largest, [n for n in lengths if n <= window - largest and pool.pieces[n]])
        if largest:
            pool_of_largest.append(held)
            counts[largest] = counts.get(largest, 0) + 1
        for _ in range(min((len(pool.pieces[n]) // k for n, k in counts.items()), default=1) if not slack else 1):
            if pool.total < window:
                break
            sequence = [pool.take(n) for n, k in counts.items() for _ in range(k)]
            if slack:
                whole = next(n for n in lengths if n > slack and pool.pieces[n])
                doc, start, _ = pool.take(whole)
                sequence.append((doc, start, slack))
                pool.add(whole - slack, doc, start + slack)
                if whole - slack not in lengths:
                    lengths = sorted({*lengths, whole - slack}, reverse=True)
            yield sequence


def _rows(docs: list[tuple[int | None, np.ndarray]], first: int) -> tuple[pa.RecordBatch, int]:
    """The pieces of documents that are packed together, in sequences from number `first`; the number after the last."""
    pool, sequences = Pool(), []
    for doc, (_, ids) in enumerate(docs):
        cut = len(ids) - len(ids) % CAPACITY
        sequences += [[(doc, start, CAPACITY)] for start in range(0, cut, CAPACITY)]
        if cut < len(ids):
            pool.add(len(ids) - cut, doc, cut)
    sequences += fill(pool)
    out: list[tuple] = []
    for number, sequence in enumerate(sequences, first):
        offset = 0
        for doc, start, length in sequence:
            doc_id, ids = docs[doc]
            out.append((doc_id, start, length, zlib.crc32(ids[start : start + length]), len(ids), number, offset))
            offset += length
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(column, pa.int64()) for column in zip(*out)], names), first + len(sequences)


def packed(docs: DataFrame, tokenizer: str = "byte_bpe_50k", block: int = BLOCK) -> DataFrame:
    """Per piece of the rows of docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents, each ended by END, are cut into whole sequences and a rest. The rests of a block of documents (up to
    `block` tokens, one task's memory) are packed by minimum bin slack; pieces are cut only where no multiset of the
    rests left meets a window, and at the end of a block, so no sequence is padded and nothing is shuffled. A sequence
    holds documents of one partition of the input; its number is the partition's and a count there, so it changes if
    the input is dealt out anew, but not if a task runs again.
    Null and empty texts are one token, END. Null doc_ids stay null, and rows that repeat a doc_id are documents of
    their own, told apart by their pieces' starts and sequences only. A very long text is held whole in its task. An
    empty table gives no rows. Other columns are not read. The tokenizer is a file that every worker has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sequence, tokens, held = _encoder(tokenizer), TaskContext.get().partitionId() << 32, 0, []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.append((doc_id, encoder.encode(text.as_py() or "")))
                tokens += len(held[-1][1])
                if tokens >= block:
                    rows, sequence = _rows(held, sequence)
                    yield rows
                    tokens, held = 0, []
        if held:
            yield _rows(held, sequence)[0]

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


_loaded: dict[str, Encoder] = {}


def _encoder(name: str) -> Encoder:
    if name not in _loaded:  # a worker serves many tasks
        _loaded[name] = Encoder(name)
    return _loaded[name]
