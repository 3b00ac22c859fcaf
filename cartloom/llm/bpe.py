"""Byte-pair encoding and decoding with a pair occurrence index.

The distinct words of a block (pre-tokens, as bytes) lie one after another as a linked list of symbols.
The index maps each mergeable pair to all places where it occurs in the block. Active ranks are
applied in ascending order; a merge takes all places of its pair at once, and puts the new pairs
at both sides on their lists. Words don't touch each other, so the order of ranks over the block
is for each word the order in which BPE merges it. NumPy does each step on whole lists.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
from collections import defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from cartloom.llm.common import texts
from cartloom.llm.tokens import gathered

BLOCK_CHARS = 8_000_000
#: The byte-level pre-tokenizer's split (fixed by the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class PairIndexBPE:
    """encode() and decode() of a byte-level BPE file of the tokenizers library (JSON)."""

    def __init__(self, path: str, limit: int = 400_000):
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        model, chars = spec["model"], byte_chars()
        if model["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("not a plain byte-level BPE file")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take white space or whole words aren't supported")
        vocab = model["vocab"]
        back = {c: b for b, c in enumerate(chars)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max(max(vocab.values()), *self.special.values(), 0) + 1
        self.token_bytes = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        lengths = np.fromiter(map(len, self.token_bytes), np.int64, size)
        self.byte_flat = np.frombuffer(b"".join(self.token_bytes), np.uint8)
        self.byte_starts, self.byte_sizes = np.cumsum(lengths) - lengths, lengths
        self.of_byte = np.array([vocab[c] for c in chars], np.int32)
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left, right = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        self.size, self.left, self.right = size, left, right
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        keys = left * size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.split = regex.compile(PATTERN)
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.index: defaultdict = defaultdict()
        self.index.default_factory = self.index.__len__
        self.known = 0
        self.flat, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, -1 for one that isn't merged."""
        key = a.astype(np.int64) * self.size + b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], -1) if len(self.keys) else np.full(len(key), -1)

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one after another, and the number of each word's ids."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        n = int(lengths.sum())
        symbol = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        after = np.arange(1, n + 1, dtype=np.int64)
        before = np.arange(-1, n - 1, dtype=np.int64)
        ends = np.cumsum(lengths)
        after[ends - 1] = -1
        before[ends - lengths] = -1
        active: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enlist(places: np.ndarray) -> None:
            """Put places, at which a pair starts, on the lists of their pairs."""
            rank = self.rank_of(symbol[places], symbol[after[places]])
            some = rank >= 0
            places, rank = places[some], rank[some]
            if not len(places):
                return
            order = np.argsort(rank, kind="stable")
            places, rank = places[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, own in zip(rank[[0, *cuts]].tolist(), np.split(places, cuts), strict=True):
                if r not in active:
                    active[r] = []
                    heapq.heappush(heap, r)
                active[r].append(own)

        enlist(np.flatnonzero(after >= 0))
        while heap:
            r = heapq.heappop(heap)
            lists = active.pop(r)
            a, b, new = self.left[r], self.right[r], self.made[r]
            places = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            places = places[symbol[places] == a]
            follow = after[places]
            good = (follow >= 0) & (symbol[follow] == b)  # places of earlier merges are out of date
            places, follow = places[good], follow[good]
            if a == b and len(places) > 1:  # overlapping pairs merge from the left, every second one of a run
                places = np.sort(places)
                follow = after[places]
                starts = np.append(True, follow[:-1] != places[1:])
                run = np.cumsum(starts) - 1
                odd = (np.arange(len(places)) - np.flatnonzero(starts)[run]) % 2 == 0
                places, follow = places[odd], follow[odd]
            if not len(places):
                continue
            symbol[places] = new
            symbol[follow] = -1
            beyond = after[follow]
            after[places] = beyond
            inside = beyond >= 0
            before[beyond[inside]] = places[inside]
            ahead = before[places]
            enlist(np.unique(np.concatenate([ahead[ahead >= 0], places[inside]])))
        kept = symbol >= 0
        counts = np.add.reduceat(kept.astype(np.int64), ends - lengths) if len(words) else np.zeros(0, np.int64)
        return symbol[kept], counts

    def learn(self) -> None:
        """Encode the chunks that are new in index: their distinct words together."""
        new = list(itertools.islice(self.index, self.known, None))
        if not new:
            return
        self.known = len(self.index)
        ids: defaultdict = defaultdict()
        ids.default_factory = ids.__len__
        each, where, counts = ids.__getitem__, [], np.zeros(len(new), np.int64)
        for i, x in enumerate(new):
            words = self.split.findall(x[0] if type(x) is tuple else f" {x}")
            counts[i] = len(words)
            where += map(each, words)
        if not where:
            flat, sizes = np.zeros(0, np.int32), np.zeros(len(new), np.int64)
        else:
            own, n = self.merge_words([w.encode() for w in ids])
            flat, n = gathered(own, np.cumsum(n) - n, n, np.array(where, np.int64))
            sizes = sums(n, counts)
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.flat, self.sizes = np.concatenate([self.flat, flat]), np.concatenate([self.sizes, sizes])

    def pieces(self, text: str) -> list:
        """A text as chunks: (first,) chunks have no space before them, other ones do; special tokens are numbers.

        A cut at a space is one of the pattern's own unless white space is on both sides; there the
        words of the text are its pieces.
        """
        if self.at_special is None or not self.at_special.search(text):
            return self.plain(text)
        out, at = [], 0
        for m in self.at_special.finditer(text):
            if m.start() > at:
                out += self.plain(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + (self.plain(text[at:]) if at < len(text) else [])

    def plain(self, text: str) -> list:
        if DOUBLE.search(text):
            return [(w,) for w in self.split.findall(text)]
        words: list = text.split(" ")
        words[0] = (words[0],)
        return words

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts, one after another, and each text's number of ids."""
        if len(self.index) > self.limit:
            self.clear()
        each, parts, counts = self.index.__getitem__, [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            words = self.pieces(text)
            counts[i] = len(words)
            if self.special and any(type(w) is int for w in words):
                parts.append(np.fromiter((-1 - w if type(w) is int else each(w) for w in words), np.int64, len(words)))
            else:
                parts.append(np.fromiter(map(each, words), np.int64, len(words)))
        self.learn()
        where = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        # special tokens lie behind the chunks, as one id each
        k = len(self.starts)
        flat = np.concatenate([self.flat, np.arange(self.size, dtype=np.int32)])
        starts = np.concatenate([self.starts, len(self.flat) + np.arange(self.size)])
        sizes = np.concatenate([self.sizes, np.ones(self.size, np.int64)])
        ids, n = gathered(flat, starts, sizes, np.where(where < 0, k - 1 - where, where))
        return ids, sums(n, counts)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return gathered(self.byte_flat, self.byte_starts, self.byte_sizes, ids)[0].tobytes()


#: White space on both sides of a cut at a space, in any of the forms that the pattern's \s has.
DOUBLE = regex.compile(r"\s\s")


def sums(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of successive stretches of x, of so many elements each; a stretch may be empty."""
    total = np.concatenate([[0], np.cumsum(x)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


_held: dict[str, PairIndexBPE] = {}


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode every whole text of docs (doc_id, text) and decode it: doc_id, n_tokens, ids_sha256, decoded_sha256, same.

    same: the decoded text is the text. A null text is empty and has no ids; null and repeated
    doc_ids are kept as they are; no documents give no rows; further columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, block in texts(batches, BLOCK_CHARS):
            if path not in _held:
                _held[path] = PairIndexBPE(path)
            bpe = _held[path]
            ids, counts = bpe.encode(block)
            decoded = bpe.decode_bytes(ids)
            sizes = sums(bpe.byte_sizes[ids], counts)
            raw = ids.astype("<u4").tobytes()
            i = j = 0
            rows = []
            for text, n, m in zip(block, counts.tolist(), sizes.tolist(), strict=True):
                # as the library: what isn't UTF-8 becomes the replacement character
                back = decoded[j : j + m].decode("utf-8", "replace")
                rows.append((n, hashlib.sha256(raw[4 * i : 4 * (i + n)]).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == text))
                i, j = i + n, j + m
            at = 0
            for b in held:
                own = rows[at : at + b.num_rows]
                at += b.num_rows
                kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").cast(pa.int64()), *(pa.array([r[k] for r in own], t) for k, t in enumerate(kinds))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "same"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, same boolean")
