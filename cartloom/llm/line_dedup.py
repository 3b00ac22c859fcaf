"""Line dedup: a suffix array over line-ID sequences by distributed prefix doubling.

1. Lines with words get ids; only lines found twice or more can be in a repeated run, so a document
   becomes the stretches of such lines that follow each other. A stretch equal to an earlier one goes
   as a whole, and the suffix array needs each distinct stretch once.
2. Prefix doubling: the rank of a suffix by its first 2**h lines, from pairs of ranks by 2**(h-1)
   lines. Pairs are ranked by a range partitioning, so no task sorts them all.
3. Suffixes in rank order are cut to clusters that share their first min_words words. A suffix whose
   line before is that of its neighbour in the order has one line less in common with it than the
   suffix before has with its own neighbour. So only the other pairs, the irreducible ones, are compared by their
   lines: a run that is shared by two documents is compared once, not at each of its lines.
4. A scan with a stack over the LCP intervals gives for each suffix the longest prefix that an earlier
   suffix has too: a later copy. Of these, the maximal runs go.

Steps 3 and 4 work on ranges of the suffix order, so a run that a third of all documents go on from in
different ways is no task of its own: the intervals that are open at the ends of ranges, a few for each,
are joined by a second scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartloom.llm.common import free_name, written

MIN_WORDS = 25
_END = -1


def document_lines(docs: DataFrame) -> DataFrame:
    """A row for each line that has a word: doc_id, th, k (its number among these), line, h1, h2, words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, k, line_no, digests, words = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                n = 0
                for j, line in enumerate((text or "").encode().split(b"\n")):
                    if count := len(line.split()):
                        of.append(i)
                        k.append(n)
                        line_no.append(j)
                        digests.append(xxhash.xxh3_128_digest(line))
                        words.append(count)
                        n += 1
            h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            at = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("th").take(at), pa.array(k, pa.int32()), pa.array(line_no, pa.int32()),
                 pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])), pa.array(words, pa.int32())],
                ["doc_id", "th", "k", "line", "h1", "h2", "words"],
            )

    return docs.mapInArrow(run, "doc_id long, th long, k int, line int, h1 long, h2 long, words int")


def stretches(rows: DataFrame, min_words: int) -> DataFrame:
    """From (doc_id, th, lines array of (k, line, lid, words)): stretches of successive k with at least min_words words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for doc, th, got in zip(batch.column("doc_id").to_pylist(), batch.column("th").to_pylist(), batch.column("lines"), strict=True):
                k, line, lid, words = (got.values.field(x).to_numpy() for x in ("k", "line", "lid", "words"))
                cuts = np.flatnonzero(np.diff(k) != 1) + 1
                for a, b in zip([0, *cuts], [*cuts, len(k)], strict=True):
                    if words[a:b].sum() < min_words:
                        continue
                    h = np.frombuffer(xxhash.xxh3_128_digest(lid[a:b].astype("<i8").tobytes()), np.int64)
                    for x, v in zip(out, (doc, th, int(k[a]), lid[a:b], line[a:b], words[a:b], int(h[0]), int(h[1])), strict=True):
                        x.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["doc_id", "th", "k0", "ids", "lines", "words", "s1", "s2"])

    return rows.mapInArrow(run, "doc_id long, th long, k0 int, ids array<long>, lines array<int>, words array<int>, s1 long, s2 long")


def suffix_ranks(distinct: DataFrame) -> DataFrame:
    """Prefix doubling over distinct (sid, ids): rows (sid, ranks, depth), in the order of the suffix array.

    ranks[i] orders the suffixes that start at ids[i]; equal suffixes, to the end of their stretch, are
    equal in rank. depth[i] is the largest h for which another suffix has the same first 2**h lines, -1 if none.
    """
    spark = distinct.sparkSession
    longest = distinct.agg(F.max(F.size("ids"))).first()[0] or 0
    single = distinct.select("sid", F.posexplode("ids").alias("i", "a"))
    counts = single.groupBy("a").agg((F.count("*") > 1).alias("many"))
    first = single.join(counts, "a").groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("i", "a", "many"))).alias("x"))
    state = written(first.select("sid", F.col("x.a").alias("ranks"), F.transform("x", lambda r: F.when(r["many"], F.lit(0)).otherwise(F.lit(-1))).alias("depth")), "line-ranks")
    step, h = 1, 1
    while step < longest:
        pairs = state.select(
            "sid",
            F.posexplode(
                F.transform("ranks", lambda r, i: F.struct(r.alias("a"), F.coalesce(F.get("ranks", i + step), F.lit(_END)).alias("b"), F.get("depth", i).alias("d")))
            ).alias("i", "p"),
        ).select("sid", "i", "p.a", "p.b", "p.d")
        counted = pairs.groupBy("a", "b").agg((F.count("*") > 1).alias("many"))
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        ranked = counted.repartitionByRange(n, "a", "b").sortWithinPartitions("a", "b").select("a", "b", "many", F.monotonically_increasing_id().alias("r"))
        ranked = written(ranked, "line-ranked")  # ids depend on the partitions, so they are fixed here
        new = pairs.join(ranked, ["a", "b"]).groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("i", "r", "many", "d"))).alias("x"))
        state = written(
            new.select("sid", F.col("x.r").alias("ranks"), F.transform("x", lambda r: F.when(r["many"], F.lit(h)).otherwise(r["d"])).alias("depth")), "line-ranks"
        )
        if ranked.filter("many").isEmpty():
            break
        step, h = 2 * step, h + 1
    return state


def _suffixes(min_words: int):
    """Rows of suffixes: their cluster, rank and place, the line before, and how many lines a common prefix can have at most."""
    names = ("cluster", "rank", "sid", "i", "doc_id", "th", "k", "need", "reach", "prev")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scalars = (batch.column(c).to_pylist() for c in ("sid", "doc_id", "th", "k0"))
            arrays = (batch.column(c) for c in ("ids", "words", "ranks", "depth"))
            for sid, doc, th, k0, *lists in zip(*scalars, *arrays, strict=True):
                ids, words, ranks, depth = (x.values.to_numpy() for x in lists)
                n = len(ids)
                total = np.concatenate([[0], np.cumsum(words)])
                # the least number of lines from i with min_words words in all
                need = np.searchsorted(total, total[:-1] + min_words, side="left") - np.arange(n)
                reach = np.where(depth < 0, 0, np.minimum(n - np.arange(n), 1 << (np.maximum(depth, 0).astype(np.int64) + 1)))
                at = np.flatnonzero((np.arange(n) + need <= n) & (reach >= need))
                raw = ids.astype("<i8").tobytes()
                clusters = [xxhash.xxh3_64_intdigest(raw[8 * i : 8 * (i + m)]) - (1 << 63) for i, m in zip(at.tolist(), need[at].tolist(), strict=True)]
                prev = [ids[i - 1] if i else None for i in at.tolist()]
                same = lambda v, t: pa.array([v] * len(at), t)
                own = [pa.array(clusters, pa.int64()), pa.array(ranks[at], pa.int64()), same(sid, pa.int64()), pa.array(at, pa.int32()), same(doc, pa.int64()), same(th, pa.int64()),
                       pa.array(at + k0, pa.int32()), pa.array(need[at], pa.int32()), pa.array(reach[at], pa.int32()), pa.array(prev, pa.int64())]
                yield pa.RecordBatch.from_arrays(own, list(names))

    return run, "cluster long, rank long, sid long, i int, doc_id long, th long, k int, need int, reach int, prev long"


_NEIGHBOURS = (
    "part int, cluster long, rank long, sid long, i int, doc_id long, th long, k int, need int, p_sid long, p_i int, reach int, compare boolean, prev long, edge int"
)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes come in order, a range of the order to a task: the suffix before each in its cluster (p_sid null: none).

    compare tells whether their common prefix has to be compared. The first row of a range has its neighbour in
    another one: it comes with edge 1, its own reach and its line before (prev), and the last row comes once more
    with edge 2.
    """
    part = TaskContext.get().partitionId()
    last = None

    def raw(row: pa.Table, edge: int) -> pa.RecordBatch:
        values = {c: row.column(c).combine_chunks() for c in row.column_names}
        blank = {"p_sid": pa.nulls(1, pa.int64()), "p_i": pa.nulls(1, pa.int32()), "compare": pa.nulls(1, pa.bool_())}
        return _rows({**values, **blank, "part": pa.array([part], pa.int32()), "edge": pa.array([edge], pa.int32())})

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        own = pa.Table.from_batches([batch])
        if last is None:
            yield raw(own.slice(0, 1), 1)
            table = own
        else:
            table = pa.concat_tables([last, own])
        size = table.num_rows - 1
        get = lambda c, at: table.column(c).combine_chunks().slice(at, size)  # noqa: E731, B023
        met = pc.fill_null(pc.equal(get("cluster", 0), get("cluster", 1)), False)
        reducible = pc.fill_null(pc.equal(get("prev", 0), get("prev", 1)), False)
        values = {c: get(c, 1) for c in ("cluster", "rank", "sid", "i", "doc_id", "th", "k", "need")}
        before = {f"p_{c}": pc.if_else(met, get(c, 0), pa.scalar(None, get(c, 0).type)) for c in ("sid", "i")}
        more = {"reach": pc.min_element_wise(get("reach", 0), get("reach", 1)), "compare": pc.and_(met, pc.invert(reducible)), "prev": pa.nulls(size, pa.int64())}
        yield _rows({**values, **before, **more, "part": pa.array(np.full(size, part), pa.int32()), "edge": pa.array(np.zeros(size), pa.int32())})
        last = own.slice(n - 1)
    if last is not None:
        yield raw(last, 2)


def _rows(values: dict[str, pa.Array]) -> pa.RecordBatch:
    names = [x.split(" ")[0] for x in _NEIGHBOURS.split(", ")]
    return pa.RecordBatch.from_arrays([values[c] for c in names], names)


def neighbours_in_order(suffixes: DataFrame) -> DataFrame:
    """suffixes in ranges (part) of their order, with the suffix before each: see _neighbours. No cluster has to be in one task."""
    order = ("cluster", "rank", "doc_id", "th", "k")
    n = int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(suffixes.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_neighbours, _NEIGHBOURS), "line-neighbours")
    # two rows for each range, however many suffixes there are
    along = Window.orderBy("part", "edge")
    before = F.lag(F.struct("cluster", "sid", "i", "reach", "prev")).over(along)
    edges = rows.filter("edge > 0").withColumn("b", before).filter("edge = 1")
    met = F.coalesce(F.col("b.cluster") == F.col("cluster"), F.lit(False))
    changed = {
        "p_sid": F.when(met, F.col("b.sid")), "p_i": F.when(met, F.col("b.i")), "reach": F.least("reach", "b.reach"),
        "compare": met & ~F.coalesce(F.col("b.prev") == F.col("prev"), F.lit(False)),
    }
    heads = written(edges.withColumns(changed).select(*(c for c in rows.columns if c not in ("prev", "edge"))), "line-heads")
    return rows.filter("edge = 0").drop("prev", "edge").unionByName(heads)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lcp = [common_prefix(x.values.to_numpy(), y.values.to_numpy()) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("sid"), batch.column("i"), pa.array(lcp, pa.int32())], ["sid", "i", "lcp"])


def common_prefixes(neighbours: DataFrame, distinct: DataFrame) -> DataFrame:
    """neighbours with low: how many lines a suffix has in common with the one before it in its cluster, 0 for the first."""
    pairs = written(neighbours.filter("compare").select("sid", "i", "p_sid", "p_i", "reach"), "line-irreducible")
    lines = distinct.select(F.col("sid").alias("s"), "ids")
    part = lambda at: F.slice("ids", F.col(at) + 1, F.col("reach"))
    x = written(pairs.join(lines, F.col("sid") == F.col("s")).select("sid", "i", "p_sid", "p_i", "reach", part("i").alias("x")), "line-left")
    both = x.join(lines, F.col("p_sid") == F.col("s")).select("sid", "i", "x", part("p_i").alias("y"))
    compared = both.mapInArrow(_compared, "sid long, i int, lcp int")
    along = Window.partitionBy("sid").orderBy("i")
    chained = F.last(F.col("lcp") + F.col("i"), True).over(along) - F.col("i")
    return neighbours.join(compared, ["sid", "i"], "left").withColumn("low", F.when(F.col("p_sid").isNull(), 0).otherwise(chained))


def earlier_prefixes(places: list, lcps: list[int]) -> list[int]:
    """For suffixes in rank order: the longest common prefix with any suffix of a lesser place.

    lcps[i] is that of i - 1 and i. A stack holds the intervals that are open.
    """
    found = [0] * len(places)
    stack: list[tuple[int, int]] = []
    for i, place in enumerate(places):
        low = lcps[i]
        while stack and place < places[stack[-1][0]]:
            top, top_low = stack.pop()
            found[top] = max(top_low, low)
            low = min(low, top_low)
        stack.append((i, low))
    for top, low in stack:
        found[top] = low
    return found


def common_prefix(x: np.ndarray, y: np.ndarray) -> int:
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    return int(differ[0]) if len(differ) else n


_SCANNED = "cluster long, rank long, doc_id long, th long, k int, sid long, i int, need int, low int, n int, open boolean"


def scan_ranges(whole: bool):
    """A scan of suffixes that come by part and in order, with low (see common_prefixes): rows (sid, i, n), n lines from i on are a later copy.

    The stack of open intervals goes on from batch to batch; low is 0 where a cluster begins. At the ends of a range
    (part) a suffix may find an earlier one in another range. If that one could have more in common with it
    than what the range itself gave (n), its row is open, and low is what it has in common with the open row before.
    All others of the range have a neighbour that stands for them: one of a lesser place with the same prefix up to the end. So
    of each range no more rows are open than twice the different lengths of prefixes, and a scan of the
    open rows (whole) settles them.
    """
    names = [x.split(" ")[0] for x in _SCANNED.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[x.split(" ")[1]] for x in _SCANNED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple] = []  # (place, row, low: lines in common with the one below it, or with what was before the range)
        out: list[tuple] = []

        def settle(row: tuple, lcp: int) -> None:
            n = max(lcp, row[8])
            if n >= row[7]:
                out.append((*(None,) * 5, row[5], row[6], None, None, n, False))

        def leave(row: tuple, low: int, lcp: int) -> None:
            out.append((*row[:8], low, max(lcp, row[8]), True))

        def lowest(row: tuple, low: int, right: int) -> None:
            """No suffix of a lesser place is before it in its range."""
            if low > right:
                leave(row, low, right)
            else:
                settle(row, right)

        def end(last: bool) -> None:
            """The end of a cluster, or (last) of the range, after which the cluster may go on."""
            if not stack:
                return
            ahead = [1 << 31] * len(stack)  # what each has in common with all that follow in the range
            for i in range(len(stack) - 1, 0, -1):
                ahead[i - 1] = min(ahead[i], stack[i][2])
            _, row, low = stack[0]
            if last:
                leave(row, low, 0)
            else:
                lowest(row, low, 0)
            low = 1 << 31
            for (_, row, left), most in zip(stack[1:], ahead[1:], strict=True):
                low = min(low, left)
                if last and most > left:
                    leave(row, low, left)
                    low = 1 << 31
                else:
                    settle(row, left)
            stack.clear()

        def rows() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names)
            out.clear()
            return got

        part = None
        for batch in batches:
            for at, low, *row in zip(*(batch.column(x).to_pylist() for x in ("part", "low", *names[:8], "n")), strict=True):
                if at != part:
                    end(not whole)
                    part = at
                elif not low:
                    end(False)
                doc, th, k = row[2:5]
                place = (doc is not None, doc or 0, th, k)
                while stack and place < stack[-1][0]:
                    _, top, below = stack.pop()
                    if stack:
                        settle(top, max(below, low))
                    else:
                        lowest(top, below, low)
                    low = min(low, below)
                stack.append((place, tuple(row), low))
            yield rows()
        end(not whole)
        yield rows()

    return run


def later_copies(placed: DataFrame) -> DataFrame:
    """From suffixes with part and low: sid, i and n, the longest prefix of at least need lines that an earlier suffix has too."""
    order = ("cluster", "rank", "doc_id", "th", "k")
    mine = placed.withColumn("n", F.lit(0)).repartition("part").sortWithinPartitions("part", *order)
    scanned = written(mine.mapInArrow(scan_ranges(False), _SCANNED), "line-scanned")
    open_rows = scanned.filter("open").withColumn("part", F.lit(0)).repartition("cluster").sortWithinPartitions(*order)
    return scanned.filter("NOT open").select("sid", "i", "n").unionByName(open_rows.mapInArrow(scan_ranges(True), _SCANNED).select("sid", "i", "n"))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Runs of lines that are later copies: doc_id, th (xxhash64 of the text), first and last line, from 0.

    The lines of docs (doc_id, text), in the order of doc_id, th and line, form one sequence, cut at
    the ends of documents and at lines that are found once. A run counts if it has min_words words
    and an equal run starts earlier. Lines without words don't part a run, and go with it. Nulls in
    doc_id come first; a null text has no lines; rows of equal doc_id and text are one document.
    """
    named = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text")
    lines = written(document_lines(named).dropDuplicates(["doc_id", "th", "k"]), "lines")
    ids = written(lines.groupBy("h1", "h2").count().filter("count > 1").select("h1", "h2", F.monotonically_increasing_id().alias("lid")), "line-ids")
    known = lines.join(ids, ["h1", "h2"]).groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.struct("k", "line", "lid", "words"))).alias("lines"))
    all_stretches = written(stretches(known, min_words), "line-stretches")
    place = F.struct("doc_id", "th", "k0")
    firsts = written(all_stretches.groupBy("s1", "s2").agg(F.min(place).alias("first")).withColumn("sid", F.monotonically_increasing_id()), "line-firsts")
    joined = all_stretches.join(firsts, ["s1", "s2"])
    whole = joined.filter(~place.eqNullSafe(F.col("first"))).select("doc_id", "th", F.element_at("lines", 1).alias("first_line"), F.element_at("lines", -1).alias("last_line"))
    distinct = written(joined.filter(place.eqNullSafe(F.col("first"))).select("sid", "doc_id", "th", "k0", "ids", "lines", "words"), "line-distinct")
    ranks = suffix_ranks(distinct.select("sid", "ids"))
    cut, kinds = _suffixes(min_words)
    suffixes = distinct.drop("lines").join(ranks, "sid").mapInArrow(cut, kinds)
    neighbours = neighbours_in_order(suffixes)
    found = later_copies(common_prefixes(neighbours, distinct).select("part", "cluster", "rank", "doc_id", "th", "k", "sid", "i", "need", "low"))
    covered = F.max(F.col("i") + F.col("n")).over(Window.partitionBy("sid").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    maximal = found.withColumn("c", covered).filter("c IS NULL OR i + n > c")
    # back from numbers in a stretch to lines
    inner = maximal.join(distinct.select("sid", "doc_id", "th", "lines"), "sid").select(
        "doc_id", "th", F.expr("lines[i]").alias("first_line"), F.expr("lines[i + n - 1]").alias("last_line")
    )
    return whole.unionByName(inner)


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A byte for each line of a document up to the last that goes: 1 if it goes."""
    for batch in batches:
        masks = []
        for runs in batch.column("runs"):
            first, last = (runs.values.field(c).to_numpy() for c in ("first_line", "last_line"))
            edges = np.zeros(int(last.max()) + 2, np.int64)
            np.add.at(edges, first, 1)
            np.add.at(edges, last + 1, -1)
            masks.append((np.cumsum(edges[:-1]) > 0).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(masks, pa.binary())], ["doc_id", "th", "mask"])


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs (doc_id, text, ...) with the later copies of repeated runs of lines deleted from text; n_deleted tells how many lines.

    A text that is a copy from end to end becomes empty; its row stays. Other columns stay as they
    are, whatever their names; if there is an n_deleted already, the number's name is the first free
    one of n_deleted_1, n_deleted_2, ... Nulls, ties and repeated rows: see repeated_runs. Documents
    without a repeated run keep their text to the byte; no documents give no rows.
    """
    names = docs.columns
    key, d, t, mask, kept, number = (free_name(names, x) for x in ("_th", "_d", "_t", "_mask", "_kept", "n_deleted"))
    runs = written(repeated_runs(docs, min_words), "line-runs").groupBy("doc_id", "th").agg(F.collect_list(F.struct("first_line", "last_line")).alias("runs"))
    masks = runs.mapInArrow(_masks, "doc_id long, th long, mask binary").select(F.col("doc_id").alias(d), F.col("th").alias(t), F.col("mask").alias(mask))
    keyed = docs.withColumn(key, F.xxhash64("text"))
    # the masks are the side that is held, so texts are shuffled but never sorted
    joined = keyed.join(masks.hint("shuffle_hash"), F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.col(key) == F.col(t)), "left")
    lines = F.split("text", "\n", -1)
    stays = F.filter(lines, lambda _, i: F.coalesce(F.substr(F.col(mask), i + 1, F.lit(1)) != F.lit(b"\x01"), F.lit(True)))
    split = joined.withColumn(kept, F.when(F.col(mask).isNotNull(), stays))
    lost = F.when(F.col(mask).isNotNull(), F.size(lines) - F.size(kept)).otherwise(0)
    return split.select(*[F.coalesce(F.array_join(kept, "\n"), F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in names], lost.cast("long").alias(number))
