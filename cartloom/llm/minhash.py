"""Near-duplicate documents by DartMinHash signatures of weighted word shingles.

A document is the multiset of its shingles of five words; a shingle found c times is c unit regions.
Each region throws hashed darts: a Poisson process of ranks, each dart falling on one of K
coordinates. A coordinate keeps its earliest dart. Two documents share it with a probability equal to
their weighted Jaccard similarity, as the darts of a region are the same in every document. A long
document needs few darts of each region, so a signature costs about K ln K darts and the shingles.

Bands of the signature are bucket keys. Candidates of a bucket are compared with one leader of it,
never all with all; every candidate pair is then compared exactly. Buckets that still hold several
components in the end are finished by a prefix-filter join, which leaves out no pair that can be a link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartloom.llm.common import bucket_links, components, joined_components, written

SHINGLE = 5
THRESHOLD = 0.8
#: At a similarity of 0.8 a pair shares no band with a probability of (1 - 0.8**5)**25 = 5e-5.
BANDS, BAND_ROWS = 25, 5
K = BANDS * BAND_ROWS
#: Members of a bucket's largest component that a turn compares others with, and turns at most before the exact join.
DRAWN, TURNS = 4, 3
#: Words whose hashes a task remembers: they are some 150 bytes each.
HELD_WORDS = 250_000
#: Counters of how many open documents have a unit region. They only order the regions, so a shared counter costs time, not links.
COUNTERS = 1 << 18
#: Rows of a unit region that a task compares with as many others, and bits of a document's parity mark.
UNIT_ROWS, MARK_BITS = 20_000, 512
#: So many darts in expectation: with K ln K + 2 K few coordinates stay empty, and those get a second throw.
DARTS = K * np.log(K) + 2 * K
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words as bytes, remembered; cleared by the caller when there are many."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def unit_regions(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """A hash for each unit region of the document: (shingle, which of its repeats). Fewer than five words are one shingle."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    size = min(SHINGLE, n)
    s = np.full(n - size + 1, size, np.uint64)
    for j in range(size):
        s = mix(s * _GOLD + w[j : j + len(s)])
    s.sort()
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    if new.all():
        return s
    first = np.flatnonzero(new)
    repeat = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))
    return np.sort(np.where(repeat > 0, mix(s + _GOLD * repeat.astype(np.uint64)), s))


def dart_minhash(units: np.ndarray, k: int = K, darts: float = DARTS) -> np.ndarray:
    """The k coordinates of the signature: the identity of the earliest dart on each. units must not be empty."""
    limit = darts / len(units)
    while True:
        best = np.full(k, np.inf)
        value = np.zeros(k, np.uint64)
        own, base, u = units, np.zeros(len(units)), 0
        while len(own):
            m = int(limit + 3 * np.sqrt(limit) + 2)
            x = mix(own[:, None] + mix(np.arange(u + 1, u + m + 1, dtype=np.uint64) * _GOLD)[None, :])
            rank = -np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            rank[:, 0] += base
            rank = np.cumsum(rank, axis=1)
            hit = rank < limit
            at, dart = rank[hit], x[hit]
            spot = (mix(dart + _GOLD) % np.uint64(k)).astype(np.int64)
            order = np.argsort(-at, kind="stable")  # the earliest is written last
            at, dart, spot = at[order], dart[order], spot[order]
            low = np.full(k, np.inf)
            new = np.zeros(k, np.uint64)
            low[spot], new[spot] = at, dart
            better = low < best
            best[better], value[better] = low[better], new[better]
            more = hit[:, -1]
            own, base, u = own[more], rank[more, -1], u + m
        if np.isfinite(best).all():
            return value
        limit *= 2


def band_keys(signature: np.ndarray) -> np.ndarray:
    rows = signature.reshape(BANDS, BAND_ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(BAND_ROWS):
        key = mix(key * _GOLD + rows[:, j])
    return key.view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, th (of the text as it is), node and more (128 bits of its words) and its band keys, none without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, known = WordHashes(), {}
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                words = (text or "").encode().split()
                digest = xxhash.xxh3_128_digest(b" ".join(words))
                keys = known.get(digest)
                if keys is None:
                    keys = band_keys(dart_minhash(unit_regions(words, hashes))) if words else np.zeros(0, np.int64)
                    known[digest] = keys
                rows.append((*np.frombuffer(digest, np.int64).tolist(), keys))
            if len(hashes) > HELD_WORDS:
                hashes.clear()
            if len(known) > 20_000:
                known.clear()
            flat = np.concatenate([x[2] for x in rows]) if rows else np.zeros(0, np.int64)
            ends = np.cumsum([0, *(len(x[2]) for x in rows)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("th"), pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))],
                ["doc_id", "th", "node", "more", "keys"],
            )

    named = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text")
    return named.mapInArrow(run, "doc_id long, th long, node long, more long, keys array<long>")


def regions_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and its unit regions (sorted, distinct) for the documents of wanted (doc_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            nodes, units = [], []
            for text in batch.column("text").to_pylist():
                words = (text or "").encode().split()
                nodes.append(int(np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words)), np.int64)[0]))
                units.append(unit_regions(words, hashes).view(np.int64))
            if len(hashes) > HELD_WORDS:
                hashes.clear()
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(units, pa.list_(pa.int64()))], ["node", "units"])

    chosen = docs.select(F.col("doc_id").cast("long"), "text").join(wanted.hint("shuffle_hash"), "doc_id", "left_semi")
    return chosen.mapInArrow(run, "node long, units array<long>").dropDuplicates(["node"])


def compared(pairs: DataFrame, regions: DataFrame) -> DataFrame:
    """pairs (a, b) with their weighted Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                common = len(np.intersect1d(x, y, assume_unique=True))
                got.append(common / (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(got, pa.float64())], ["a", "b", "similarity"])

    x, y = regions.select(F.col("node").alias("a"), F.col("units").alias("x")), regions.select(F.col("node").alias("b"), F.col("units").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long, similarity double")


def bridges(buckets: DataFrame, roots: DataFrame, tested: DataFrame, turn: int) -> DataFrame:
    """Untested pairs that could join different components of a bucket: each node outside of the bucket's largest component with one inside.

    That one is drawn for each node from DRAWN members, and these for each bucket and turn. So a bucket
    gives no more pairs than it has nodes, and a node that is like a good part of a large group soon finds it.
    """
    of = buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = of.groupBy("key", "root").count()
    majors = sizes.groupBy("key").agg(F.max(F.struct("count", "root"))["root"].alias("major"), F.count("*").alias("n")).filter("n > 1").select("key", "major")
    opened = written(of.join(written(majors, "dart-majors"), "key"), "dart-mixed")
    members = [F.min(F.struct(F.xxhash64("node", "key", F.lit(turn), F.lit(i)), "node"))["node"] for i in range(DRAWN)]
    drawn = written(opened.filter("root = major").groupBy("key").agg(F.array(*members).alias("drawn")), "dart-drawn")
    met = opened.filter("root <> major").join(drawn, "key").select("node", F.get("drawn", F.pmod(F.xxhash64("node", "key"), F.lit(DRAWN))).alias("q"))
    pairs = met.select(F.greatest("node", "q").alias("a"), F.least("node", "q").alias("b")).distinct()
    return pairs.join(tested, ["a", "b"], "left_anti")


def prefix_rows(regions: DataFrame, opened: DataFrame, threshold: float) -> DataFrame:
    """unit, node, root, size, rest and mark for the rarest unit regions of opened (node, root), enough of them for any link.

    The regions of all documents are in one order, rare ones first. rest is how many of its size regions a document
    has from this one on: two documents whose first common region this is have no more than the smaller rest in common.
    mark has a bit for each class of regions, which tells if the document has an odd number of them: where two marks
    differ, there is a region that only one of the documents has.
    """
    own = regions.join(opened, "node")
    spot = F.pmod(F.col("unit"), F.lit(COUNTERS)).cast("int").alias("spot")
    counted = own.select(F.explode("units").alias("unit")).groupBy(spot).count().toArrow()
    counters = np.zeros(COUNTERS, np.int32)
    counters[counted["spot"].to_numpy()] = np.minimum(counted["count"].to_numpy(), 2**31 - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, root, x in zip(batch.column("node").to_pylist(), batch.column("root").to_pylist(), batch.column("units"), strict=True):
                x = x.values.to_numpy()
                often = counters[x % COUNTERS]
                order = np.lexsort((x, often))
                mark = np.packbits((np.bincount((x >> 20) % MARK_BITS, minlength=MARK_BITS) & 1).astype(bool)).tobytes()
                rest = len(x) - np.arange(len(x))
                order = order[rest >= threshold * len(x) - 1e-6]
                chosen = often[order] > 1  # the others are in one document
                order, rest = order[chosen], rest[: len(order)][chosen]
                n = len(order)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[order]), pa.array(np.full(n, node)), pa.array(np.full(n, root)), pa.array(np.full(n, len(x))), pa.array(rest), pa.array([mark] * n, pa.binary())],
                    ["unit", "node", "root", "size", "rest", "mark"],
                )

    return own.select("node", "root", "units").mapInArrow(run, "unit long, node long, root long, size long, rest long, mark binary")


def pairs_of_unit(
    node: np.ndarray, root: np.ndarray, size: np.ndarray, rest: np.ndarray, side: np.ndarray, mark: np.ndarray, threshold: float
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of the documents of a unit region, one document's at a time, that are of two components and, if it is their first common one, can be a link.

    A link of sizes s and t has threshold / (1 + threshold) * (s + t) regions in common or more, so its shorter
    document has a rest of twice that share of its size. Pairs have such a document, and one outside of the largest
    component: the fewer of these are walked. A link has (1 - threshold) / (1 + threshold) * (s + t) regions
    at most that only one of its documents has, so its marks differ in no more bits. If there are two sides, a pair has one of each.
    """
    share = threshold / (1 + threshold)
    able = np.flatnonzero(rest >= 2 * share * size - 1e-6)
    values, counts = np.unique(root, return_counts=True)
    minor = np.flatnonzero(root != values[counts.argmax()])
    apart = side.min() < side.max()
    for i in able if len(able) < len(minor) else minor:
        can = (root != root[i]) & (np.minimum(rest[i], rest) >= share * (size[i] + size) - 1e-6)
        j = np.flatnonzero(can & (side != side[i]) if apart else can)
        j = j[np.bitwise_count(mark[j] ^ mark[i]).sum(1) <= (1 - 2 * share) * (size[i] + size[j]) + 1e-6]
        if len(j):
            yield np.maximum(node[i], node[j]), np.minimum(node[i], node[j])


def in_unit_blocks(rows: DataFrame, unit_rows: int) -> DataFrame:
    """rows of prefix_rows with lo, hi and side: what a task compares has one unit, lo and hi.

    A unit of more than unit_rows rows is dealt to blocks by the hash of the node, side being a row's own. Each two
    blocks, lo and hi, meet once, and each block itself (lo = hi), so each pair of rows of a unit meets, in one task.
    """
    many = rows.groupBy("unit").agg(F.ceil(F.count("*") / unit_rows).cast("int").alias("blocks")).filter("blocks > 1")
    sided = rows.join(written(many, "dart-hot-units"), "unit", "left").withColumn("side", F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1)).cast("long")))
    other = sided.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1)).cast("long") - 1)))
    return other.withColumns({"lo": F.least("side", "other"), "hi": F.greatest("side", "other")}).drop("blocks", "other")


def left_pairs(buckets: DataFrame, roots: DataFrame, regions: DataFrame, tested: DataFrame, threshold: float, unit_rows: int = UNIT_ROWS) -> DataFrame:
    """All untested pairs that can be links between the components that a bucket still holds."""
    of = buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = of.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key")
    opened = written(of.join(several, "key").select("node", "root").distinct(), "dart-open")
    names = ("unit", "lo", "hi", "node", "root", "size", "rest", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            rows, mark = np.concatenate([x for x, _ in parts], 1), np.concatenate([x for _, x in parts])
            starts = np.flatnonzero(np.append(True, (rows[:3, 1:] != rows[:3, :-1]).any(0)))
            node, root, size, rest, side = rows[3:]
            able = rest >= 2 * threshold / (1 + threshold) * size - 1e-6
            mixed = (np.minimum.reduceat(root, starts) < np.maximum.reduceat(root, starts)) & np.logical_or.reduceat(able, starts)
            mixed &= (rows[1] == rows[2])[starts] | (np.minimum.reduceat(side, starts) < np.maximum.reduceat(side, starts))
            for a, b in zip(starts[mixed], np.append(starts[1:], len(root))[mixed], strict=True):
                for x, y in pairs_of_unit(node[a:b], root[a:b], size[a:b], rest[a:b], side[a:b], mark[a:b], threshold):
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

        held: list[tuple[np.ndarray, np.ndarray]] = []  # of the last unit and blocks, whose rows may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(c).to_numpy() for c in names])
            mark = np.frombuffer(b"".join(batch.column("mark").to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            cut = int((rows[:3] != rows[:3, -1:]).any(0).sum())  # rows are sorted, so the last group is at the end
            if held and (cut or (held[0][0][:3, 0] != rows[:3, 0]).any()):
                yield from out([*held, (rows[:, :cut], mark[:cut])])
                held = []
            elif cut:
                yield from out([(rows[:, :cut], mark[:cut])])
            held.append((rows[:, cut:], mark[cut:]))
        if held:
            yield from out(held)

    key = ("unit", "lo", "hi")
    rows = in_unit_blocks(written(prefix_rows(regions, opened, threshold), "dart-prefixes"), unit_rows)
    rows = rows.select(*names, "mark").repartition(*key).sortWithinPartitions(*key)
    return rows.mapInArrow(run, "a long, b long").distinct().join(tested, ["a", "b"], "left_anti")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, turns: int = TURNS) -> DataFrame:
    """A row for each document of docs (doc_id, text): doc_id, th (xxhash64 of the text), class_id.

    class_id is the least doc_id of the connected documents, a link being a weighted Jaccard
    similarity of at least threshold over shingles of five words. Texts of equal words are one node;
    texts without words are copies of each other; fewer than five words are one shingle. Repeated
    rows are documents of one class. Rows without doc_id can't be named: they get a null class_id.
    Further columns are not read.

    Nodes of a bucket are compared with the bucket's least node, then, for so many turns, with members
    of the bucket's largest component, drawn anew for each bucket and turn. These are linear in the rows of buckets however large a group is. What a bucket holds of
    several components after them is compared in all pairs that the prefix filter can't rule out, so
    each link of two nodes that share a bucket is found.
    """
    all_rows = written(signatures(docs), "dart-signatures")
    nodes = all_rows.groupBy("node", "more").agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys"))
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").count().filter("count > 1").drop("count")
    buckets = written(keyed.join(shared, "key"), "dart-buckets")
    pairs = written(bucket_links(buckets, "key", "node"), "dart-pairs")
    wanted = nodes.select("node", "doc_id").join(buckets.select("node").distinct(), "node").select("doc_id").distinct()
    regions = written(regions_of(docs, wanted), "dart-regions")

    def compared_now(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        found = written(compared(pairs, regions), "dart-compared")
        return found.select("a", "b"), found.filter(F.col("similarity") >= threshold).select("a", "b")

    tested, links = compared_now(pairs)
    roots = written(components(links, "dart-components"), "dart-roots")
    for turn in range(turns + 1):
        if turn < turns:
            pairs = bridges(buckets, roots, tested, turn)
        else:
            pairs = left_pairs(buckets, roots, regions, tested, threshold)
        new, links = compared_now(written(pairs, "dart-pairs"))
        tested = tested.unionByName(new)
        if not links.isEmpty():
            roots = joined_components(roots, links, "dart-joined")
    # Rows of a node or of a component can be very many: they only meet small tables, so these joins can be split.
    linked = written(nodes.select("node", "doc_id").join(roots, "node"), "dart-linked")
    least = written(linked.groupBy("root").agg(F.min("doc_id").alias("class_id")), "dart-least")
    classes = linked.join(least, "root").select("node", "class_id").union(nodes.select("node", F.col("doc_id").alias("class_id")))
    classes = written(classes.groupBy("node").agg(F.min("class_id").alias("class_id")), "dart-classes")
    result = all_rows.select("doc_id", "th", "node").join(classes, "node").select("doc_id", "th", "class_id")
    unnamed = docs.filter("doc_id IS NULL").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), F.lit(None).cast("long").alias("class_id"))
    return result.unionByName(unnamed)
