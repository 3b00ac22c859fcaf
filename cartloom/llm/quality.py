"""Quality rules: word and line counts, and bands of zstandard ratios of whole texts and fixed chunks.

A ratio has to lie in a general band for texts of its length, which holds for any corpus (random and
encoded bytes below it, loops above), and in one of the corpus: SPREADS robust standard deviations
about the median of documents of like length that pass the base rules. A length of few documents borrows from
its neighbours, the more the fewer it has, so no number of documents switches a band on or off.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartloom.llm.common import written

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
CHUNK_BYTES = 4096
#: (bytes below which the band holds, least ratio, largest ratio) of a text's bytes to its zstandard frame at
#: level 3. A short text has little to match and pays for the frame's header; a long one finds its own words
#: again. Below the least: random or encoded bytes (base64 has 1.33). Above the largest: loops.
BANDS = (
    (64, 0.0, 1.3), (128, 0.0, 1.6), (256, 0.9, 2.0), (512, 1.15, 2.2), (1024, 1.3, 2.6), (4096, 1.4, 3.0),
    (16384, 1.45, 3.6), (65536, 1.5, 4.2), (float("inf"), 1.5, 5.0),
)
#: The same for each chunk of CHUNK_BYTES, the last bytes among them: a part of a long text that is a loop or noise.
#: The least is that of a whole text of this size: over base64 (1.31), under prose (2.05 at least on sf0.1). Chunks
#: overlap by half, so a block of twice CHUNK_STEP fills three quarters of a chunk at least, wherever it lies.
CHUNK_BAND, CHUNK_STEP = (1.45, 4.0), CHUNK_BYTES // 2
#: The corpus's bands: lengths in quarters of a doubling. A band's quartiles are means over all bands, weighed by their
#: documents and by FADE for each step away. It is LEAST_WIDTH of its median wide at least, and wider by
#: 1 + DOUBT / sqrt(n), n being the weight of documents that it rests on.
SPREADS, LEAST_WIDTH, STEPS, FADE, DOUBT = 6.0, 0.05, 4, 1 / 8, 3.0
MEASURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, in_general boolean, size long, ratio double, chunk_low double, chunk_high double"
#: Band (size is in it if floor(STEPS * log2(size)) is), measure -> least, largest.
Limits = dict[tuple[int, str], tuple[float, float]]


def repeated_words(ids: np.ndarray) -> int:
    """Words that lie in windows of 5 words found twice or more, the first included; ids stand for words."""
    n = len(ids) - 4
    if n < 2:
        return 0
    _, ids = np.unique(ids, return_inverse=True)
    m = int(ids.max()) + 1
    if m**5 < 2**63:
        keys = (((ids[:-4] * m + ids[1:-3]) * m + ids[2:-2]) * m + ids[3:-1]) * m + ids[4:]
    else:  # pairs of words are numbered first, so that the key fits
        _, pair = np.unique(ids[:-1] * m + ids[1:], return_inverse=True)
        p = int(pair.max()) + 1
        _, four = np.unique(pair[:-2] * p + pair[2:], return_inverse=True)
        keys = four[:n] * m + ids[4:]
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, np.int64)
    twice[order[1:][same]] = 1
    twice[order[:-1][same]] = 1
    edges = np.zeros(len(ids) + 1, np.int64)
    edges[:n] += twice
    edges[5 : n + 5] -= twice
    return int((np.cumsum(edges[:-1]) > 0).sum())


def ratios(raw: bytes, squeeze: zstandard.ZstdCompressor) -> tuple[float, float, float]:
    """The ratio of the whole, and the least and largest of its chunks (the whole's, if it is shorter): one each CHUNK_STEP bytes, and its last bytes."""
    if not raw:
        return 1.0, 1.0, 1.0
    whole = len(raw) / len(squeeze.compress(raw))
    starts = list(range(0, len(raw) - CHUNK_BYTES + 1, CHUNK_STEP))
    if starts and starts[-1] != len(raw) - CHUNK_BYTES:
        starts.append(len(raw) - CHUNK_BYTES)
    each = [CHUNK_BYTES / len(squeeze.compress(raw[i : i + CHUNK_BYTES])) for i in starts]
    return whole, min(each, default=whole), max(each, default=whole)


def in_band(size: int, whole: float, low: float, high: float) -> bool:
    least, most = next((a, b) for below, a, b in BANDS if size < below)
    return least <= whole <= most and (size < CHUNK_BYTES or (low >= CHUNK_BAND[0] and high <= CHUNK_BAND[1]))


def band_of(size: int) -> int:
    return math.floor(STEPS * math.log2(max(size, 1)))


def in_limits(size: int, whole: float, low: float, high: float, limits: Limits) -> bool:
    """Whether the ratios are in the corpus's bands; chunks are all of one size, so they have one band (-1)."""
    checks = [((band_of(size), "ratio"), whole)]
    if size >= CHUNK_BYTES:
        checks += [((-1, "chunk_low"), low), ((-1, "chunk_high"), high)]
    return all(limits[k][0] <= x <= limits[k][1] for k, x in checks if k in limits)


def measured(text: str, squeeze: zstandard.ZstdCompressor) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, in_general, size and the three ratios of a text."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    index: defaultdict = defaultdict()
    index.default_factory = index.__len__
    repeated = repeated_words(np.fromiter(map(index.__getitem__, words), np.int64, n)) if n > 5 else 0
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    failed = n < 10 or 100 * repeated > 20 * n
    whole, low, high = ratios(raw, squeeze)
    return (
        n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated,
        failed, in_band(len(raw), whole, low, high), len(raw), whole, low, high,
    )


def measures(docs: DataFrame) -> DataFrame:
    """A row for each document with its counts and ratios (see MEASURES), as a table in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            rows = [measured(text or "", squeeze) for text in batch.column("text").to_pylist()]
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] + [pa.float64()] * 3
            own = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [[]] * 11, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *own], [x.split()[0] for x in MEASURES.split(", ")])

    return written(docs.select("doc_id", "text").mapInArrow(run, MEASURES), "quality-measures")


def band_column() -> Column:
    return F.floor(F.lit(STEPS) * F.log2(F.greatest("size", F.lit(1)))).cast("int")


def corpus_limits(found: DataFrame) -> Limits:
    """The corpus's bands of all documents that pass the base rules: a few for each length, so the driver gets some hundred rows at most."""
    good = found.filter("NOT base_failed")
    each = [good.select(band_column().alias("band"), F.lit("ratio").alias("measure"), F.col("ratio").alias("x"))]
    each += [good.filter(F.col("size") >= CHUNK_BYTES).select(F.lit(-1).alias("band"), F.lit(c).alias("measure"), F.col(c).alias("x")) for c in ("chunk_low", "chunk_high")]
    points = each[0].union(each[1]).union(each[2]).groupBy("band", "measure").agg(F.percentile_approx("x", [0.25, 0.5, 0.75], 10_000).alias("q"), F.count("*").alias("n"))
    rows = points.collect()
    return {(r.band, r.measure): limit([(abs(x.band - r.band), x.n, x.q) for x in rows if x.measure == r.measure]) for r in rows}


def limit(bands: list[tuple[int, int, list[float]]]) -> tuple[float, float]:
    """Least and largest ratio of a band, from all bands of its measure: steps away, documents, quartiles."""
    n = sum(count * FADE**away for away, count, _ in bands)
    a, middle, b = (sum(count * FADE**away * q[i] for away, count, q in bands) / n for i in range(3))
    # 1.349: quartiles of a normal distribution lie so many deviations apart
    half = max(SPREADS * (b - a) / 1.349, LEAST_WIDTH * middle) * (1 + DOUBT / math.sqrt(n))
    return middle - half, middle + half


def quality_rules(docs: DataFrame) -> DataFrame:
    """A row for each document of docs (doc_id, text): its counts, ratios, base_failed and kept.

    Words are runs of other characters than the six white ones of ASCII. base_failed: fewer than 10
    words, or over a fifth of the words in repeated windows. kept: not base_failed, and all ratios in
    their general bands and those of the corpus, which are taken from all rows. A null text has no
    words and fails; null and repeated doc_ids are kept as they are; no documents give no rows;
    further columns are not read.
    """
    found = measures(docs)
    limits = corpus_limits(found)
    ranges = [F.lit(True)]
    for c in ("ratio", "chunk_low", "chunk_high"):
        own = {b: x for (b, m), x in limits.items() if m == c}
        if own:
            sides = F.create_map(*[F.lit(x) for b, (least, most) in own.items() for x in (b, F.array(F.lit(least), F.lit(most)))])
            side = sides[band_column()] if c == "ratio" else F.when(F.col("size") >= CHUNK_BYTES, sides[F.lit(-1)])
            ranges.append(F.coalesce(F.col(c).between(side[0], side[1]), F.lit(True)))
    kept = ~F.col("base_failed") & F.col("in_general")
    for x in ranges:
        kept = kept & x
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "ratio", "chunk_low", "chunk_high")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs (text, ...) that the rules keep, with all their columns as they are. See quality_rules.

    Texts are read twice, for the bands of the corpus and for the verdict, and never shuffled.
    """
    limits = corpus_limits(measures(docs.select(F.lit(0).cast("long").alias("doc_id"), "text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield batch.filter(pa.array([verdict(x or "", squeeze, limits) for x in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def verdict(text: str, squeeze: zstandard.ZstdCompressor, limits: Limits) -> bool:
    *_, failed, general, size, whole, low, high = measured(text, squeeze)
    return not failed and general and in_limits(size, whole, low, high, limits)
