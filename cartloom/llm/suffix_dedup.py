"""Suffix-array dedup: blockwise suffix sorting with a difference cover, over the bytes of whole texts.

A byte goes if it is covered by a window of 50 bytes that also starts in a document of a smaller doc_id.

1. Texts are dealt to blocks of some megabytes, once, in a bucketed table; later steps read it where it lies.
2. Suffix buckets: a suffix belongs to the least hash of the 24-byte strings in its first 50 bytes, so suffixes that
   agree in 50 bytes share a bucket. A block passes on which buckets it has; only buckets that two documents share
   can hold a match. Suffixes of one bucket that follow each other travel as one short text, once for each block.
3. A task takes its buckets one after another and sorts their suffixes (sorted_windows): those at the positions of a difference cover
   (three of every seven) are ranked first, all others are placed by their first seven bytes and, at ties, by the ranks at the
   offset where both meet the cover. So a tie of any length costs one comparison of numbers, and a task holds no more than
   its present buckets. Neighbours that agree in 50 bytes form an interval; the least doc_id of an interval keeps its bytes.
4. Back in its block, a text loses the bytes that its marked windows cover.

Texts that are equal as a whole are found by their digest: those behind the first go without being sorted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartloom.llm.common import in_blocks, written

WINDOW, GRAM = 50, 24
#: A suffix run has so many windows at most, so that a mask of them fits 32 bits.
RUN = WINDOW - GRAM + 1
BLOCK_BYTES = 8 << 20
#: Bytes of text for each task that looks for shared buckets.
PART_BYTES = 48 << 20
#: Buckets with more runs than this are cut to buckets of single windows.
LARGE = 20_000
#: Windows that are sorted at a time; a bucket isn't cut.
AT_ONCE = 300_000
#: A difference cover modulo 7: every difference is one of two members.
PERIOD, COVER = 7, (0, 1, 3)
_PIECE = 1 << 20
_LOW = (1 << 40) - 1


def text_blocks_table(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (doc_id, text) as a table bucketed by block: block, no (place in the block), doc_id, n_bytes, digest, text (bytes)."""
    raw = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(raw).cast("long").alias("n_bytes"), F.unhex(F.sha2(raw, 256)).alias("digest"), raw.alias("text"))
    return in_blocks(rows, block_bytes)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_minima(raw: np.ndarray) -> np.ndarray:
    """For each window of 50 bytes: a hash of the least of its 24-byte strings by hash."""

    def power(n: int) -> np.uint64:
        return np.uint64(pow(0x9E3779B97F4A7C15, n, 1 << 64))

    h = raw.astype(np.uint64) + np.uint64(1)
    sums = {1: h}
    for n in (1, 2, 4, 8):
        h = h[:-n] * power(n) + h[n:]
        sums[2 * n] = h
    grams = _mixed(sums[8][: len(raw) - GRAM + 1] * power(16) + sums[16][8:])
    low = grams
    for n in (1, 2, 4, 8):
        low = np.minimum(low[:-n], low[n:])
    return _mixed(np.minimum(low[: len(raw) - WINDOW + 1], low[RUN - 16 :]))


def window_runs(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of one bucket in texts that follow each other in raw and end at ends: first byte, windows, bucket, text number."""
    starts, sizes, buckets = [], [], []
    limit = ends - WINDOW  # the last window of each text
    for a in range(0, max(0, len(raw) - WINDOW + 1), _PIECE):
        own = gram_minima(raw[a : a + _PIECE + WINDOW - 1])
        at = np.arange(a, a + len(own))
        of = np.searchsorted(ends, at, side="right")
        inside = at <= limit[of]
        cut = np.ones(len(own), bool)
        cut[1:] = (own[1:] != own[:-1]) | (of[1:] != of[:-1]) | (inside[1:] != inside[:-1])
        first = np.flatnonzero(cut)
        length = np.diff(np.append(first, len(own)))
        pieces = -(-length // RUN)  # runs of periodic texts are cut
        whole = np.repeat(first, pieces)
        nth = np.arange(len(whole)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = whole + nth * RUN
        size = np.minimum(RUN, np.repeat(first + length, pieces) - begin)
        good = inside[begin]
        starts.append(at[begin[good]])
        sizes.append(size[good])
        buckets.append(own[begin[good]])
    joined = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
    start = joined(starts, np.int64)
    return start, joined(sizes, np.int32), joined(buckets, np.uint64), np.searchsorted(ends, start, side="right")


def _joined(texts: pa.Table) -> tuple[bytes, np.ndarray]:
    """The texts of a block as one string, and where each ends."""
    column = texts.column("text").to_pylist()
    return b"".join(column), np.cumsum([len(x) for x in column], dtype=np.int64)


def _documents_of(bucket: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets, and in how many documents each is. doc: a number for each run."""
    order = np.lexsort((doc, bucket))
    b, d = bucket[order], doc[order]
    if not len(b):
        return b, np.zeros(0, np.int64)
    pair = np.append(True, (b[1:] != b[:-1]) | (d[1:] != d[:-1]))
    new = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
    return b[new], np.add.reduceat(pair.astype(np.int64), new)


def _known(texts: pa.Table) -> pa.Table:
    """Texts that take part: with a doc_id and as long as a window."""
    return texts.filter(pc.and_(pc.is_valid(texts.column("doc_id")), pc.greater_equal(texts.column("n_bytes"), WINDOW)))


def bucket_parts(blocks: DataFrame, bits: int) -> DataFrame:
    """Rows (part, block, data): the suffix buckets of a block, six bytes each: five of the bucket and the logarithm of its documents."""

    def emit(block: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        texts = _known(pa.Table.from_batches(held))
        raw, ends = _joined(texts)
        _, _, bucket, of = window_runs(np.frombuffer(raw, np.uint8), ends)
        doc = texts.column("doc_id").to_numpy()[of] if len(of) else of
        own, documents = _documents_of(bucket, doc)
        part = (own >> np.uint64(64 - bits)).astype(np.int64)  # own is sorted, so parts are in order
        data = np.empty((len(own), 6), np.uint8)
        data[:, :5] = (own & np.uint64(_LOW)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
        data[:, 5] = np.ceil(np.log2(documents)) if len(own) else 0
        new = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(own) else np.zeros(0, np.int64)
        flat = data.tobytes()
        cuts = np.append(new, len(own)) * 6
        return pa.RecordBatch.from_arrays([pa.array(part[new], pa.int64()), pa.array(np.full(len(new), block), pa.int64()), pa.array([flat[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["part", "block", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        block = None
        for batch in batches:
            of = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1), len(of)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if y > x:
                    if held and of[x] != block:
                        yield emit(block, held)
                        held = []
                    block = int(of[x])
                    held.append(batch.slice(x, y - x))
        if held:
            yield emit(block, held)

    return blocks.select("block", "doc_id", "n_bytes", "text").mapInArrow(run, "part long, block long, data binary")


def _shared(part: pa.Table) -> pa.Table:
    """Of the buckets of one part those that several blocks have, for each block: seven bytes, five of the bucket, two of its part's use: 1 if large."""
    rows = part.column("data").to_pylist()
    data = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 6)
    low = np.zeros((len(data), 8), np.uint8)
    low[:, :5] = data[:, :5]
    low = low.view("<u8").ravel()
    block = np.repeat(part.column("block").to_numpy(), [len(x) // 6 for x in rows])
    order = np.argsort(low, kind="stable")
    low, block, weight = low[order], block[order], np.left_shift(1, data[order, 5].astype(np.int64))
    new = np.flatnonzero(np.append(True, low[1:] != low[:-1])) if len(low) else np.zeros(0, np.int64)
    size = np.diff(np.append(new, len(low)))
    total = np.add.reduceat(weight, new) if len(new) else weight
    keep = np.repeat(size > 1, size)
    large = np.repeat(total > LARGE, size)[keep]
    low, block = low[keep], block[keep]
    order = np.argsort(block, kind="stable")
    low, block, large = low[order], block[order], large[order]
    values = (low << np.uint64(1)) | large.astype(np.uint64)
    new = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.zeros(0, np.int64)
    n = int(part.column("part")[0].as_py())
    cuts = np.append(new, len(block))
    return pa.table({"block": pa.array(block[new], pa.int64()), "part": pa.array(np.full(len(new), n), pa.int64()),
                     "data": pa.array([_packed(values[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})


def _packed(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def copies(blocks: DataFrame) -> DataFrame:
    """Rows (block, part -1, data): the numbers of texts in a block that equal a text of a smaller doc_id."""
    keys = blocks.filter("doc_id IS NOT NULL AND n_bytes > 0").select("block", "no", "doc_id", "digest")
    first = keys.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").drop("most")
    again = keys.join(first, "digest").filter("doc_id > least")
    return again.groupBy("block").agg(F.collect_list("no").alias("x")).mapInArrow(_numbers, "block long, part long, data binary")  # a block's texts at most


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data = [np.array(x.as_py(), np.int32).tobytes() for x in batch.column("x")]
        yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array([-1] * batch.num_rows, pa.int64()), pa.array(data, pa.binary())], ["block", "part", "data"])


def _copied(notes: pa.Table) -> np.ndarray:
    got = [d for p, d in zip(notes.column("part").to_pylist(), notes.column("data").to_pylist(), strict=True) if p == -1]
    return np.frombuffer(b"".join(got), np.int32)


def run_texts(bits: int):
    """For a block and its notes: distinct runs of windows in shared buckets, each as the least doc_id that has it, its text and members."""

    def find(texts: pa.Table, notes: pa.Table) -> pa.Table:
        empty = pa.table({"bucket": pa.array([], pa.int64()), "block": pa.array([], pa.int64()), "doc": pa.array([], pa.int64()), "text": pa.array([], pa.binary()), "members": pa.array([], pa.binary())})
        if not texts.num_rows:
            return empty
        texts = _known(texts.filter(pc.invert(pc.is_in(texts.column("no"), value_set=pa.array(_copied(notes)))))).sort_by([("doc_id", "ascending"), ("no", "ascending")])
        raw, ends = _joined(texts)
        start, size, bucket, of = window_runs(np.frombuffer(raw, np.uint8), ends)
        if not len(start):
            return empty
        doc = texts.column("doc_id").to_numpy()
        values = [np.zeros(0, np.uint64)]
        for p, d in zip(notes.column("part").to_pylist(), notes.column("data").to_pylist(), strict=True):
            if p >= 0:
                values.append(_unpacked(d) | np.uint64(p << 41))
        values = np.sort(np.concatenate(values))
        shared, large = values >> np.uint64(1), (values & np.uint64(1)).astype(bool)
        key = ((bucket >> np.uint64(64 - bits)) << np.uint64(40)) | (bucket & np.uint64(_LOW))
        at = np.minimum(np.searchsorted(shared, key), max(0, len(shared) - 1))
        met = shared[at] == key if len(shared) else np.zeros(len(key), bool)
        wide = met & large[at] if len(shared) else met
        own, documents = _documents_of(bucket, doc[of])
        met |= documents[np.searchsorted(own, bucket)] > 1
        go = np.flatnonzero(met)
        # runs of large buckets go window by window
        times = np.where(wide[go], size[go], 1)
        begin = np.repeat(start[go], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        length = np.repeat(np.where(wide[go], 1, size[go]), times) + WINDOW - 1
        keys, docs_of, alone = np.repeat(key[go], times), np.repeat(of[go], times), np.repeat(wide[go], times)
        number = texts.column("no").to_numpy()
        offset = np.append(0, ends[:-1])
        found: dict[bytes, int] = {}
        row_of = np.empty(len(begin), np.int64)
        firsts = []
        for i, (a, n) in enumerate(zip(begin.tolist(), length.tolist(), strict=True)):
            text = raw[a : a + n]
            r = found.setdefault(text, len(found))
            if r == len(firsts):
                firsts.append(i)
            row_of[i] = r
        firsts = np.array(firsts, np.int64)
        least = doc[docs_of[firsts]]  # texts are in the order of doc_id
        member = np.stack([number[docs_of], begin - offset[docs_of], doc[docs_of] == least[row_of]], 1).astype(np.int32)
        order = np.argsort(row_of, kind="stable")
        flat, cuts = member[order].tobytes(), np.append(0, np.cumsum(np.bincount(row_of, minlength=len(firsts)))) * 12
        content = list(found)
        place = [int(k) if not w else xxhash.xxh3_64_intdigest(t) >> 1 for k, w, t in zip(keys[firsts].tolist(), alone[firsts].tolist(), content, strict=True)]
        return pa.table({
            "bucket": pa.array(place, pa.int64()), "block": pa.array(np.full(len(content), texts.column("block")[0].as_py()), pa.int64()), "doc": pa.array(least, pa.int64()),
            "text": pa.array(content, pa.binary()), "members": pa.array([flat[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
        })

    return find, "bucket long, block long, doc long, text binary, members binary"


def _meeting() -> np.ndarray:
    """For two residues the least offset at which both are in the cover."""
    table = np.zeros((PERIOD, PERIOD), np.int64)
    for a in range(PERIOD):
        for b in range(PERIOD):
            table[a, b] = next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER)
    return table


MEETING = _meeting()


def _words(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a number that orders like them; zeros follow the end."""
    x = np.append(raw, np.zeros(7 + WINDOW + PERIOD + 8, np.uint8)).astype(np.uint64)
    for n in (1, 2, 4):
        x = (x[:-n] << np.uint64(8 * n)) | x[n:]
    return x


def cover_ranks(words: np.ndarray, n: int) -> np.ndarray:
    """Ranks of the suffixes at the positions of the cover, by their first 56 bytes; -1 elsewhere."""
    at = np.flatnonzero(np.isin(np.arange(n) % PERIOD, COVER))
    keys = [words[at + d] for d in range(0, 56, 8)]
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(at), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    ranks = np.full(n + PERIOD, -1, np.int64)
    ranks[at[order]] = np.cumsum(new)
    return ranks


def sorted_windows(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes of raw at starts by their first 50 bytes, and for each place whether it agrees in them with the place before."""
    words = _words(raw)
    n = len(raw) + PERIOD
    ranks = cover_ranks(words, n)
    prefix = words[starts] >> np.uint64(8)  # seven bytes
    _, group = np.unique(prefix, return_inverse=True)
    group = group.astype(np.int64) * (n + 1)
    residue = starts % PERIOD
    classes = []
    for r in range(PERIOD):
        own = np.flatnonzero(residue == r)
        d = MEETING[r, r]
        classes.append(own[np.argsort(group[own] + ranks[starts[own] + d], kind="stable")])
    place = np.zeros(len(starts), np.int64)
    for r, own in enumerate(classes):
        for s, other in enumerate(classes):
            d = MEETING[r, s]
            place[own] += np.searchsorted(group[other] + ranks[starts[other] + d], group[own] + ranks[starts[own] + d], side="left")
    order = np.argsort(place, kind="stable")
    at = starts[order]
    same = np.zeros(len(at), bool)
    if len(at) > 1:
        same[1:] = True
        for d in (0, 8, 16, 24, 32, 40, WINDOW - 8):
            w = words[at + d]
            same[1:] &= w[1:] == w[:-1]
    return order, same


def least_of_windows(texts: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For all windows of the texts, one text after another: the least of docs (one for each text) over equal windows; and where each text's windows begin."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    length = np.array([len(x) for x in texts], np.int64)
    windows = length - WINDOW + 1
    base, first = np.cumsum(length) - length, np.cumsum(windows) - windows
    of = np.repeat(np.arange(len(texts)), windows)
    starts = base[of] + np.arange(len(of)) - first[of]
    order, same = sorted_windows(raw, starts)
    new = np.flatnonzero(~same)
    low = np.minimum.reduceat(docs[of[order]], new) if len(new) else docs[:0]
    least = np.empty(len(of), np.int64)
    least[order] = np.repeat(low, np.diff(np.append(new, len(of))))
    return least, first


def _marked(rows: pa.Table) -> pa.RecordBatch:
    """Rows of whole buckets, in order: for each block the windows that go, as (text number, first byte, mask)."""
    bucket, doc, block = (rows.column(c).to_numpy() for c in ("bucket", "doc", "block"))
    content = rows.column("text").to_pylist()
    distinct: dict[tuple[int, bytes], int] = {}
    which = np.array([distinct.setdefault((b, t), len(distinct)) for b, t in zip(bucket.tolist(), content, strict=True)], np.int64)
    least = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(least, which, doc)
    own_bucket = np.array([b for b, _ in distinct], np.int64)
    _, at, size = np.unique(own_bucket, return_inverse=True, return_counts=True)
    several = np.flatnonzero(size[at] > 1)  # a bucket of one text has nothing to sort
    texts = [t for _, t in distinct]
    windows = np.array([len(t) for t in texts], np.int64) - WINDOW + 1
    first = np.cumsum(windows) - windows
    low = np.repeat(least, windows)
    if len(several):
        found, begin = least_of_windows([texts[i] for i in several], least[several])
        where = np.repeat(first[several] - begin, windows[several]) + np.arange(len(found))
        low[where] = found
    # a mask for each row: the windows that a smaller doc_id has
    n = windows[which]
    of = np.repeat(np.arange(len(which)), n)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    gone = low[first[which][of] + nth] < doc[of]
    mask = np.bincount(of, weights=np.where(gone, np.left_shift(1, nth), 0), minlength=len(which)).astype(np.int64)
    raw = rows.column("members").to_pylist()
    member = np.frombuffer(b"".join(raw), np.int32).reshape(-1, 3)
    row = np.repeat(np.arange(len(raw)), [len(x) // 12 for x in raw])
    # members of a larger doc_id than the row's lose all windows, as the row has the same ones
    out = np.stack([member[:, 0], member[:, 1], np.where(member[:, 2] == 1, mask[row], (1 << n[row]) - 1).astype(np.int32)], 1)
    keep = np.flatnonzero(out[:, 2])
    order = keep[np.argsort(block[row[keep]], kind="stable")]
    home, out = block[row[order]], out[order]
    new = np.flatnonzero(np.append(True, home[1:] != home[:-1])) if len(home) else np.zeros(0, np.int64)
    flat, cuts = np.ascontiguousarray(out, np.int32).tobytes(), np.append(new, len(home)) * 12
    return pa.RecordBatch.from_arrays([pa.array(home[new], pa.int64()), pa.array(np.zeros(len(new)), pa.int64()), pa.array([flat[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["block", "part", "data"])


def _sorted_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket; some whole buckets are taken at a time."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += pc.sum(pc.binary_length(batch.column("text"))).as_py() - batch.num_rows * (WINDOW - 1)
        if n < AT_ONCE:
            continue
        rows = pa.Table.from_batches(held)
        of = rows.column("bucket").to_numpy()
        cut = int(np.searchsorted(of, of[-1], side="left"))  # the last bucket may go on
        if cut:
            yield _marked(rows.slice(0, cut))
            held = rows.slice(cut).to_batches()
            n = sum(pc.sum(pc.binary_length(b.column("text"))).as_py() - b.num_rows * (WINDOW - 1) for b in held)
    if held:
        yield _marked(pa.Table.from_batches(held))


def _cut_texts(texts: pa.Table, notes: pa.Table) -> pa.Table:
    """A block's texts without the bytes that go."""
    texts = texts.sort_by("no")
    raw, ends = _joined(texts)
    raw = np.frombuffer(raw, np.uint8)
    begin = np.append(0, ends[:-1]).astype(np.int64)
    number = texts.column("no").to_numpy()
    delta = np.zeros(len(raw) + WINDOW + 1, np.int32)
    for p, d in zip(notes.column("part").to_pylist(), notes.column("data").to_pylist(), strict=True):
        if p == 0:
            got = np.frombuffer(d, np.int32).reshape(-1, 3)
            base = begin[np.searchsorted(number, got[:, 0])] + got[:, 1]
            for x in range(RUN):
                at = base[(got[:, 2] >> x) & 1 == 1] + x
                np.add.at(delta, at, 1)
                np.add.at(delta, at + WINDOW, -1)
    gone = np.cumsum(delta[: len(raw)]) > 0
    for no in _copied(notes):
        i = int(np.searchsorted(number, no))
        if ends[i] - begin[i] >= WINDOW:
            gone[begin[i] : ends[i]] = True
    is_start = np.zeros(len(raw) + 1, bool)
    is_start[begin] = True
    is_start[-1] = True
    before, after = np.append(False, gone), np.append(gone, False)
    first = np.flatnonzero(after & (~before | is_start))
    last = np.flatnonzero(before & (~after | is_start))  # one behind the last byte
    of = np.searchsorted(ends, first, side="right")
    spans = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(of, np.arange(len(ends) + 1)), pa.int32()),
        pa.StructArray.from_arrays([pa.array(first - begin[of], pa.int64()), pa.array(last - begin[of], pa.int64())], ["first", "end"]),
    )
    kept = raw[~gone].tobytes()
    stay = np.append(0, np.cumsum(~gone))
    cuts = stay[np.append(0, ends)]
    return pa.table({"doc_id": texts.column("doc_id"), "n_bytes": texts.column("n_bytes"), "spans": spans, "kept": pa.array([kept[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})


def drop_repeated_bytes(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, n_bytes, spans of removed bytes (first, end), and kept, the bytes that stay.

    Bytes are removed where a 50-byte string covers them that also starts in a document of a smaller
    doc_id; all strings are those of the input, and none goes beyond its text. So the least doc_id of equal strings keeps
    them, and rows of the same doc_id remove nothing of each other. A null text is empty; rows without doc_id stay whole and remove
    nothing. Cuts may part a character, so kept is binary. Other columns aren't read; no documents give no rows.

    The texts are kept in a bucketed table named cartloom_blocks_*, in the shared folder, which the result reads.
    """
    blocks = text_blocks_table(docs.select("doc_id", "text"), block_bytes)
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))
    bits = max(1, math.ceil(math.log2(parts)))
    again = written(copies(blocks), "suffix-copies")
    shared = bucket_parts(blocks, bits).groupBy("part").applyInArrow(_shared, "block long, part long, data binary")
    find, kinds = run_texts(bits)
    texts = blocks.select("block", "no", "doc_id", "n_bytes", "text").groupBy("block")
    runs = texts.cogroup(shared.unionByName(again).groupBy("block")).applyInArrow(find, kinds)
    marks = runs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_sorted_buckets, "block long, part long, data binary")
    marks = written(marks, "suffix-marks")
    return texts.cogroup(marks.unionByName(again).groupBy("block")).applyInArrow(_cut_texts, "doc_id long, n_bytes long, spans array<struct<first:long,end:long>>, kept binary")
