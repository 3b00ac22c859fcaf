"""Phrase collocation mining: n-grams by pivot partitioning, scored by how much of their parts they take up.

1. Words are counted for each language. Frequent ones get numbers in the order of their counts, so the rarest word of
   an n-gram, its pivot, is the one of the greatest number; rare words end a fragment as the end of a piece does.
2. Each occurrence of a word is the pivot of the n-grams that cover it and hold no rarer word, and of two equal ones the
   left. The fragment around it is rewritten to the words that such n-grams can reach, three to a side, and goes to the partition
   of its pivot; equal fragments of a block go once with their number.
3. A partition counts the n-grams that its pivot owns and no others, so their counts are complete and only frequent ones
   leave it. Pivots with very many occurrences are split by block; their counts are summed once more.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartloom.llm.common import in_blocks, written
from cartloom.operators.running import numbered

LONGEST, LEAST, TOP = 4, 30, 2000
BLOCK_BYTES = 8 << 20
#: A pivot with more occurrences than this is split.
PIVOT_ROWS = 200_000
#: Fragments that are counted at a time; a pivot's part isn't cut.
AT_ONCE = 150_000
_SIDE = LONGEST - 1
#: The byte that stands for the end of a piece; no word holds it.
_END = b"."
_PIECES = bytes.maketrans(b",;:!?\n\x0b\x0c\r", b"." * 9)


def words_of(text: bytes) -> list[bytes]:
    """The words of a text in lower case (A-Z alone), and b"." at each end of a piece."""
    return text.lower().translate(_PIECES).replace(_END, b" . ").split()


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Rows of a block follow each other."""
    held: list[pa.RecordBatch] = []
    block = None
    for batch in batches:
        of = batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(of)) + 1), len(of)]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            if y == x:
                continue
            if held and of[x] != block:
                yield block, pa.Table.from_batches(held)
                held = []
            block = int(of[x])
            held.append(batch.slice(x, y - x))
    if held:
        yield block, pa.Table.from_batches(held)


def block_words(blocks: DataFrame) -> DataFrame:
    """Rows (block, lang, word, n): the words of a block and how often; the word "." has the number of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _by_block(batches):
            found: dict[str, Counter] = {}
            for lang, text in zip(rows.column("lang").to_pylist(), rows.column("text").to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(words_of(text))
            for lang, counts in found.items():
                del counts[_END]
                counts[_END] = counts.total()
                n = len(counts)
                yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), pa.array([lang] * n, pa.string()), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["block", "lang", "word", "n"])

    return blocks.select("block", "lang", "text").mapInArrow(run, "block long, lang string, word binary, n long")


def rare(kind: np.dtype) -> int:
    """Stands for a rare word or an end among numbers of this type."""
    return np.iinfo(kind).max


def fragments(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From word numbers in order (see rare): distinct rewritten fragments, seven numbers with the pivot in the middle and -1 for blanks, and how often each is there."""
    end = rare(ids.dtype)
    padded = np.concatenate([np.full(_SIDE, end, ids.dtype), ids, np.full(_SIDE, end, ids.dtype)])
    middle = padded[_SIDE : len(padded) - _SIDE]
    rows = np.full((len(ids), 2 * _SIDE + 1), -1, ids.dtype)
    rows[:, _SIDE] = middle
    for side in (-1, 1):
        on = middle != end
        for j in range(1, _SIDE + 1):
            other = padded[_SIDE + side * j : len(padded) - _SIDE + side * j]
            on = on & ((other < middle) if side < 0 else (other <= middle))
            rows[on, _SIDE + side * j] = other[on]
    rows = rows[(rows[:, _SIDE - 1] >= 0) | (rows[:, _SIDE + 1] >= 0)]
    return summed(rows, np.ones(len(rows), np.int64))


def summed(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows, in the order of a hash, and the sums of their n."""
    if not len(rows):
        return rows, n
    h = np.zeros(len(rows), np.uint64)
    for c in range(rows.shape[1]):
        h = (h ^ rows[:, c].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    order = np.argsort(h)
    differ = (rows[order[1:]] != rows[order[:-1]]).any(1)
    if (differ & (h[order[1:]] == h[order[:-1]])).any():  # rows that share a hash are ordered in full
        order = np.lexsort((*rows.T, h))
        differ = (rows[order[1:]] != rows[order[:-1]]).any(1)
    rows = rows[order]
    new = np.flatnonzero(np.append(True, differ))
    return rows[new], np.add.reduceat(n[order], new)


def _fragment_rows(texts: pa.Table, words: pa.Table) -> pa.Table:
    """For a block and the numbers of its frequent words: rows (pivot, part, data), the fragments of a pivot in one row."""
    numbers: dict[str, dict[bytes, int]] = {}
    parts: dict[int, int] = {}
    for lang, word, i, p in zip(*(words.column(c).to_pylist() for c in ("lang", "word", "id", "parts")), strict=True):
        numbers.setdefault(lang, {})[word] = i
        parts[i] = p
    kind = np.dtype(np.int32 if max(parts, default=0) < rare(np.dtype(np.int32)) else np.int64)
    end = rare(kind)
    gathered = []
    for lang, text in zip(texts.column("lang").to_pylist(), texts.column("text").to_pylist(), strict=True):
        got = words_of(text)
        own = numbers.get(lang, {})
        gathered.append(np.fromiter((own.get(w, end) for w in got), kind, len(got)))
        gathered.append(np.array([end], kind))
    rows, n = fragments(np.concatenate(gathered) if gathered else np.zeros(0, kind))
    pivot = rows[:, _SIDE]
    order = np.argsort(pivot, kind="stable")
    pivot, data = pivot[order], np.column_stack([rows[order], n[order].astype(kind)])  # a block has fewer than 2**31 words
    new = np.flatnonzero(np.append(True, pivot[1:] != pivot[:-1])) if len(pivot) else np.zeros(0, np.int64)
    flat, cuts = data.tobytes(), np.append(new, len(pivot)) * data.shape[1] * kind.itemsize
    block = texts.column("block")[0].as_py() if texts.num_rows else 0
    part = [hash((block, p)) % parts[p] if parts[p] > 1 else 0 for p in pivot[new].tolist()]
    return pa.table({"pivot": pa.array(pivot[new], pa.int64()), "part": pa.array(part, pa.int64()), "parts": pa.array([parts[p] for p in pivot[new].tolist()], pa.int64()), "wide": pa.array([kind.itemsize == 8] * len(new), pa.bool_()),
                     "data": pa.array([flat[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})


def owned_ngrams(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of two to four words that cover the pivot of a fragment (four numbers, -1 behind the last), and their numbers."""
    found, counts = [], []
    for left in range(LONGEST):
        for right in range(LONGEST - left):
            if left + right == 0:
                continue
            part = rows[:, _SIDE - left : _SIDE + right + 1]
            there = np.flatnonzero((part[:, 0] >= 0) & (part[:, -1] >= 0))
            grams = np.full((len(there), LONGEST), -1, rows.dtype)
            grams[:, : left + right + 1] = part[there]
            found.append(grams)
            counts.append(n[there])
    return summed(np.concatenate(found), np.concatenate(counts))


def _mined(least: int):
    """Rows come sorted by pivot and part; whole parts are counted together. Of pivots in one part only frequent n-grams are passed on."""

    def count(rows: pa.Table) -> pa.RecordBatch:
        raw = rows.column("data").to_pylist()
        kinds = [np.int64 if w else np.int32 for w in rows.column("wide").to_pylist()]
        data = [np.frombuffer(x, t).reshape(-1, 2 * _SIDE + 2) for x, t in zip(raw, kinds, strict=True)]
        sizes = [len(x) for x in data]
        all_rows = np.concatenate(data)
        split = np.repeat(rows.column("parts").to_numpy() > 1, sizes)
        grams, total = [], []
        for which in (False, True):
            own = all_rows[split == which]
            g, n = owned_ngrams(own[:, :-1], own[:, -1].astype(np.int64))
            keep = n >= (1 if which else least)
            grams.append(g[keep])
            total.append(n[keep])
        g, n = np.concatenate(grams), np.concatenate(total)
        size = (g >= 0).sum(1)
        flat = pa.array(g[g >= 0].astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), flat), pa.array(n, pa.int64())], ["ids", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.column("data").nbytes
            if size < AT_ONCE * 32:
                continue
            rows = pa.Table.from_batches(held)
            pivot, part = rows.column("pivot").to_numpy(), rows.column("part").to_numpy()
            cut = int(np.argmax((pivot == pivot[-1]) & (part == part[-1])))
            if cut:
                yield count(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
                size = sum(b.column("data").nbytes for b in held)
        if held:
            yield count(pa.Table.from_batches(held))

    return run


def frequent_ngrams(docs: DataFrame, least: int = LEAST, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent n-grams of docs (lang, text): words (lang, word, id, f), n-grams of two to four words (ids, f), and totals (lang, n), all as tables."""
    raw = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.length(raw).cast("long").alias("n_bytes"), raw.alias("text"))
    blocks = in_blocks(rows, block_bytes)
    each = written(block_words(blocks), "phrase-block-words")
    end = F.col("word") == F.lit(_END)
    counted = written(each.groupBy("lang", "word").agg(F.sum("n").alias("f")).filter((F.col("f") >= least) | end), "phrase-words")
    totals = counted.filter(end).select("lang", F.col("f").alias("n"))
    frequent = counted.filter(~end)
    words = written(numbered(frequent, [F.desc("f"), F.asc("lang"), F.asc("word")], "id", frequent.count()), "phrase-numbers")
    parts = F.ceil(F.col("f") / F.lit(PIVOT_ROWS)).cast("long").alias("parts")
    known = each.filter(~end).select("block", "lang", "word").join(words.select("lang", "word", "id", parts), ["lang", "word"])
    held = known.select("block", "lang", "word", "id", "parts")
    cut = blocks.select("block", "lang", "text").groupBy("block").cogroup(held.groupBy("block"))
    routed = cut.applyInArrow(_fragment_rows, "pivot long, part long, parts long, wide boolean, data binary")
    mined = routed.repartition("pivot", "part").sortWithinPartitions("pivot", "part").mapInArrow(_mined(least), "ids array<long>, f long")
    grams = written(mined.groupBy("ids").agg(F.sum("f").alias("f")).filter(F.col("f") >= least), "phrase-ngrams")
    return words, grams, totals


def _wide(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("decimal(20,0)")


def scored(words: DataFrame, grams: DataFrame) -> DataFrame:
    """Rows (ids, a, l, r, score): each n-gram at its weakest cut, score = floor(2000000 * a / (l + r)); ties to the first cut."""
    counts = grams.unionByName(words.select(F.array("id").alias("ids"), "f"))
    cuts = grams.select("ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.select("ids", "a", "k", F.slice("ids", F.lit(1), F.col("k")).alias("left"), F.slice("ids", F.col("k") + 1, F.size("ids")).alias("right"))
    of = lambda side, name: counts.select(F.col("ids").alias(side), F.col("f").alias(name))
    known = cuts.join(of("left", "l"), "left").join(of("right", "r"), "right")
    score = F.expr("cast((cast(a as decimal(20,0)) * cast(2000000 as decimal(10,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as long)")
    best = known.withColumn("score", score).groupBy("ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    return best.select("ids", "a", "x.l", "x.r", "x.score")


def kept_phrases(candidates: DataFrame) -> DataFrame:
    """candidates (ids, a, ...) without those that a longer one holds at four fifths of their number or more."""
    longer = candidates.filter(F.size("ids") > 2).select("ids", "a", F.explode(F.sequence(F.lit(2), F.size("ids") - 1)).alias("m"))
    parts = longer.select("a", F.explode(F.transform(F.sequence(F.lit(1), F.size("ids") - F.col("m") + 1), lambda i: F.slice("ids", i, F.col("m")))).alias("ids"))
    most = parts.groupBy("ids").agg(F.max("a").alias("most"))
    held = _wide("most") * F.lit(100).cast("decimal(5,0)") >= _wide("a") * F.lit(80).cast("decimal(5,0)")
    return candidates.join(most, "ids", "left").filter(~F.coalesce(held, F.lit(False))).drop("most")


def phrases(docs: DataFrame, least: int = LEAST, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The first phrases of each language: lang, rank, phrase, a, l, r, n, score. See the contract of op11 for pieces, words and order.

    docs has text and lang; a null text is empty, a null lang "und", and repeated rows count each time. Columns of other names
    aren't read. A language without a phrase has no rows; no documents give no rows.
    """
    words, grams, totals = frequent_ngrams(docs, least, block_bytes)
    kept = kept_phrases(written(scored(words, grams), "phrase-scores"))
    lang = words.select(F.col("id").alias("_first"), "lang")
    kept = kept.withColumn("_first", F.element_at("ids", 1)).join(lang, "_first").drop("_first")
    # two steps, so that no task ranks all of a language: what leads a part with all its ties, then what leads the rest
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("ids"), F.lit(64))).orderBy(F.desc("score"), F.desc("a"))
    first = written(kept.withColumn("_place", F.rank().over(part)).filter(F.col("_place") <= top).drop("_place"), "phrase-first")
    each = first.select("lang", "ids", F.posexplode("ids").alias("i", "id")).join(words.select("id", F.col("word").cast("string").alias("word")), "id")
    named = each.groupBy("ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    whole = first.join(named, "ids")
    over = lambda *keys: Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    fewer = whole.withColumn("_place", F.row_number().over(over("lang", F.pmod(F.xxhash64("ids"), F.lit(64))))).filter(F.col("_place") <= top).drop("_place")
    ranked = fewer.withColumn("rank", F.row_number().over(over("lang")).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
