"""Packing by first-fit decreasing: a tournament tree of bin capacities, in randomised groups of documents."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartloom.llm.common import column, text_blocks, written
from cartloom.llm.tokens import encoder

BLOCK_CHARS = 6_000_000


class Tournament:
    """Bins of one capacity, in order; the tree's nodes hold the largest free capacity below them."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.free = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """The first bin that has room for size, which is taken from it."""
        free, at = self.free, 1
        while at < self.leaves:
            at *= 2
            if free[at] < size:
                at += 1
        free[at] -= size
        found = at - self.leaves
        while at > 1:
            at //= 2
            best = max(free[2 * at], free[2 * at + 1])
            if free[at] == best:
                break
            free[at] = best
        return found


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset in it of each size; equal sizes are placed in their order. Sizes over capacity raise."""
    if len(sizes) and sizes.max() > capacity:
        raise ValueError("a piece is larger than a sequence")
    order = np.argsort(-sizes, kind="stable")
    tree = Tournament(max(1, len(sizes)), capacity)
    bins = np.zeros(len(sizes), np.int64)
    offsets = np.zeros(len(sizes), np.int64)
    used: dict[int, int] = {}
    for i in order.tolist():
        size = int(sizes[i])
        b = tree.place(size)
        bins[i], offsets[i] = b, used.get(b, 0)
        used[b] = offsets[i] + size
    return bins, offsets


def _pieces(tokenizer: str, end_id: int, capacity: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(tokenizer, False) as chunks:
            for held, block in text_blocks(batches, BLOCK_CHARS):
                ids, lengths = chunks.encode(block)
                docs = column(held, "doc_id").cast(pa.int64()).to_pylist()
                tail = np.array([end_id], np.uint32)
                out: list[list] = [[], [], [], [], []]
                at = 0
                for doc, n in zip(docs, lengths.tolist(), strict=True):
                    own = np.concatenate([ids[at : at + n], tail]).astype("<u4")
                    at += n
                    for start in range(0, n + 1, capacity):
                        piece = own[start : start + capacity]
                        for x, v in zip(out, (doc, start, len(piece), zlib.crc32(piece.tobytes()), n + 1), strict=True):
                            x.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 4096, group_pieces: int = 16_384, seed: int = 7) -> DataFrame:
    """Pack every whole text of docs (doc_id, text) into sequences of at most capacity tokens.

    A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A
    document longer than a sequence is cut at each capacity; the full pieces are sequences, the rests
    are packed first-fit decreasing. A null text is empty and has the end id alone; null or repeated
    doc_ids are documents like others; no documents give no rows. Further columns are not read.

    Groups: pieces are dealt by a hash of doc_id, start and ids to groups of about group_pieces, so
    each group is like the whole and fits in one task, and none depends on another. Copies of equal
    doc_id and text would all go to one group; they are dealt by a number among them (salted).
    """
    rows = written(docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, end_id, capacity), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"), "pieces")
    groups = max(1, -(-rows.count() // group_pieces))
    salt = F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id(), F.lit(seed))
    # The salt depends on the place in a written table, so a task that runs again deals alike.
    dealt = rows.withColumn("grp", F.pmod(salt, F.lit(groups)))

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "start", "ids_crc32", "doc_tokens"], kind="stable", ignore_index=True)
        bins, offsets = first_fit_decreasing(rows["length"].to_numpy(), capacity)
        return rows.drop(columns="grp").assign(sequence_id=key[0] * 2**32 + bins, offset=offsets)

    return dealt.groupBy("grp").applyInPandas(
        fill, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
