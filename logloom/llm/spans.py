"""Long stretches that texts share verbatim, by prefix-partitioned suffix trees.

A window of `length` characters is shared if it occurs in the text of another document; a character is shared if
a shared window covers it. Suffixes are entered at anchors only: in every window the half-length strings are
hashed, and the string with the least hash anchors the window. Equal windows have equal anchors at the same
offset, so the suffixes at anchors, about one in thirty of prose, lose no shared window. In a periodic stretch
anchors repeat at every period; those whose reach lies within the stretch are alike, and are one with a count.

Suffixes are partitioned by their prefix, at first the anchored string. A prefix that occurs in one document
alone can hold nothing shared and goes. Suffixes that agree as far as any window of theirs reaches are one, with
the least and greatest document that has them, so copies do not multiply. The suffixes of a partition are sorted,
their common prefix lengths are the depths of the partition's suffix tree, and the tree's nodes are built from
them. A node deep enough is a string that several anchors begin; each suffix below it is extended ahead of its
anchor as far as a suffix of another document below the same node agrees. Both together are a maximal repeat, and
every window inside it that holds the anchor is shared.

Prefixes have variable length: a partition with more than `group` suffixes is split. Its windows are halved by
offset, and each half has a longer string in common, which becomes its prefix; at the last step the prefix is the
window itself and its suffixes are one. No partition is capped and none is collected beyond that size.

Long texts are searched in pieces that overlap by a window, and contexts leave a task in batches, so that memory
does not grow with a text. A document's anchors are gathered in one row, fewer than its characters.

Null, empty and shorter texts share nothing. Repeats within one document do not count, nor do rows with the same
doc_id among themselves; rows with a null doc_id are one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.storage import discard, materialize

LENGTH = 120
#: Suffixes of one partition that a task takes at once; some 750 bytes each.
GROUP = 20_000
#: Characters of a text that are searched at once, and of contexts that leave a task in one batch.
PIECE, BATCH = 1 << 20, 1 << 22
NO_ID = -(2**63)

# --- anchors --------------------------------------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_MOST = np.uint64(2**64 - 1)
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, name: str, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    if len(_powers.get(name, ())) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[name] = np.cumprod(steps)
    return _powers[name][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over every run of width values."""
    size = 1
    while size * 2 <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return pick(x[:len(x) - rest], x[rest:]) if rest else x


def anchors_of(texts: list[str], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, position, hash) of the anchors of texts, each of at least `length` characters."""
    k = length // 2
    width = length - k + 1
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    n = len(codes)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(codes * _power(_BASE, "up", n), out=sums[1:])
    hashes = _mixed((sums[k:] - sums[:-k]) * _power(_INVERSE, "down", n - k + 1))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    end_of = np.repeat(ends, sizes)
    at = np.arange(n - k + 1)
    crosses = at + k > end_of[:n - k + 1]
    hashes[crosses] = _MOST
    least = _sliding(hashes, width, np.minimum)
    whole = np.arange(len(least)) + length <= end_of[:len(least)]
    least[~whole] = 0
    padded = np.zeros(len(hashes) + width - 1, np.uint64)
    padded[width - 1:width - 1 + len(least)] = least
    best = _sliding(padded, width, np.maximum)
    found = np.flatnonzero((best == hashes) & ~crosses)
    text = np.searchsorted(ends, found, side="right")
    return text, found - starts[text], hashes[found].view(np.int64)


def _pieces(texts: list[str], length: int, piece: int) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """(texts or parts of them, which text each is of, where in it it begins), about `piece` characters at a time.
    Parts of a text overlap so that each of its windows lies in one of them."""
    parts, owners, offsets, size = [], [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), piece):
            part = text[at:at + piece + length - 1]
            if size and size + len(part) > piece:
                yield parts, np.array(owners), np.array(offsets)
                parts, owners, offsets, size = [], [], [], 0
            parts.append(part)
            owners.append(i)
            offsets.append(at)
            size += len(part)
    if parts:
        yield parts, np.array(owners), np.array(offsets)


def folded(text: np.ndarray, position: np.ndarray, hashes: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, position, hash, more, step): anchors of a periodic stretch that lie `length` from both its ends are one
    row, the first of them, with the number of those that follow at the same step.

    Anchors with one hash at a constant step shorter than the anchored string tell a period, and what an anchor's
    windows reach is the same for all of them but near the ends of the stretch."""
    n = len(text)
    if n < 2:
        return text, position, hashes, np.zeros(n, np.int64), np.zeros(n, np.int64)
    gap = np.diff(position)
    alike = (text[1:] == text[:-1]) & (hashes[1:] == hashes[:-1]) & (gap <= length // 2)
    # a stretch: neighbours alike, at the step of the pair before
    goes_on = alike.copy()
    goes_on[1:] &= ~alike[:-1] | (gap[1:] == gap[:-1])
    edge = np.flatnonzero(np.concatenate([[True], ~goes_on]))
    first, last = edge, np.append(edge[1:], n) - 1
    low, high = np.repeat(position[first], last - first + 1), np.repeat(position[last], last - first + 1)
    inner = (position - low >= length) & (high - position >= length)
    head = inner & ~np.concatenate([[False], inner[:-1] & goes_on])
    begins = np.flatnonzero(head)
    step = np.zeros(n, np.int64)
    step[1:] = gap
    run = np.cumsum(head) - 1
    more = np.bincount(run[inner], minlength=len(begins)) - 1 if len(begins) else np.zeros(0, np.int64)
    kept = np.flatnonzero(~inner | head)
    counts = np.zeros(n, np.int64)
    counts[begins] = more
    return text[kept], position[kept], hashes[kept], counts[kept], np.where(counts > 0, step, 0)[kept]


def anchors(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc, pos, prefix, more, step: each anchored suffix by the hash of its first half-length characters, those alike
    within a periodic stretch as one. No shuffle."""
    rows = _named(documents).where(F.char_length("text") >= length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, docs = b.column("text").to_pylist(), b.column("doc").to_numpy(zero_copy_only=False)
            for parts, owners, offsets in _pieces(texts, length, PIECE):
                part, position, hashes, more, step = folded(*anchors_of(parts, length), length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs[owners[part]]), *(pa.array(x.astype(np.int32)) for x in (position + offsets[part],)), pa.array(hashes),
                     pa.array(more.astype(np.int32)), pa.array(step.astype(np.int32))], ["doc", "pos", "prefix", "more", "step"],
                )

    return rows.mapInArrow(run, "doc bigint, pos int, prefix bigint, more int, step int")


def _named(documents: DataFrame) -> DataFrame:
    return documents.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "text")


def suffixes(documents: DataFrame, found: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc, pos, prefix, more, step, before, context: the anchored suffixes whose prefix occurs in several documents, with
    the text that their windows can reach: `before` characters ahead of the anchor and up to `length` from it."""
    reach = length - length // 2
    several = found.groupBy("prefix").agg(F.min("doc").alias("a"), F.max("doc").alias("z")).where("a < z").select("prefix")
    places = found.join(several, "prefix").groupBy("doc").agg(F.collect_list(F.struct("pos", "prefix", "more", "step")).alias("places"))
    rows = _named(documents).join(places, "doc").where("text IS NOT NULL")
    kinds = {"doc": pa.int64(), "pos": pa.int32(), "prefix": pa.int64(), "more": pa.int32(), "step": pa.int32(), "before": pa.int32(), "context": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            lists = b.column("places")
            for i, (doc, text) in enumerate(zip(b.column("doc").to_pylist(), b.column("text").to_pylist())):
                place = lists[i].values.flatten()
                for p, prefix, more, step in zip(*(x.to_pylist() for x in place)):
                    if p < len(text):
                        start = max(0, p - reach)
                        held.append((doc, p, prefix, more, step, p - start, text[start:p + length]))
                    if len(held) * (reach + length) >= BATCH:
                        yield told(held)
                        held = []
        if held:
            yield told(held)

    def told(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds.values())], list(kinds))

    schema = "doc bigint, pos int, prefix bigint, more int, step int, before int, context string"
    return rows.select("doc", "text", "places").mapInArrow(run, schema)


# --- a partition's tree ---------------------------------------------------------------------------

def _codes(contexts: list[str], before: np.ndarray, left: int, right: int) -> tuple[np.ndarray, np.ndarray]:
    """Characters ahead of the anchors, nearest first, and from the anchors on; 0 where the text has ended."""
    n = len(contexts)
    sizes = np.array([len(c) for c in contexts], np.int64)
    flat = np.frombuffer("".join(contexts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
    starts = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(n), sizes)
    column = np.arange(len(flat)) - np.repeat(starts, sizes) - np.repeat(before, sizes)
    ahead, after = np.zeros((n, left), np.int64), np.zeros((n, right), np.int64)
    inside = (column < 0) & (column >= -left)
    ahead[row[inside], -1 - column[inside]] = flat[inside]
    inside = (column >= 0) & (column < right)
    after[row[inside], column[inside]] = flat[inside]
    return ahead, after


class Tree:
    """The deep inner nodes of the suffix trees of sorted partitions: string depth, first and last suffix below, and
    height among the deep nodes (those of one height have no suffix in common).

    common: common prefix length of each suffix and the one before, -1 between trees."""

    def __init__(self, common: np.ndarray, least_depth: int):
        nodes: list[tuple[int, int, int, int]] = []
        way: list[list[int]] = []  # depth, first suffix and height of the nodes on the way to the last suffix
        for at, depth in enumerate([*common.tolist(), -1]):
            first, height = at - 1, 0
            while way and way[-1][0] > depth:
                closed, first, own = way.pop()
                nodes.append((closed, first, at - 1, max(own, height)))
                height = max(own, height) + 1
            if way and way[-1][0] == depth:
                way[-1][2] = max(way[-1][2], height)
            elif depth >= least_depth:
                way.append([depth, first, height])
        table = np.array(nodes, np.int64).reshape(-1, 4)
        self.depth, self.first, self.last, self.height = table.T


def _nearest(adjacent: np.ndarray, same: np.ndarray) -> np.ndarray:
    """For each suffix of a sorted list what it has in common with the nearest before it of another document: the least of
    the adjacent ones on the way. adjacent: with the one before, -1 at a node's first; same: of the same document as it."""
    run = np.cumsum(~same)
    return np.minimum.accumulate(adjacent - run * 1000) + run * 1000


def shared_offsets(
    group: np.ndarray, contexts: list[str], before: np.ndarray, first: np.ndarray, last: np.ndarray, low: int, high: int, length: int
) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest offset in low..high of a window that several documents have, for each suffix; -1 if none.

    Rows come sorted by group and suffix. first and last: the least and greatest document of each row."""
    n = len(contexts)
    ahead, after = _codes(contexts, before, high, length - low)
    right = np.minimum(np.array([len(c) for c in contexts], np.int64) - before, length - low)
    room = np.minimum(before, high)
    agree = (after[1:] == after[:-1]) & (after[1:] > 0)
    common = np.concatenate([[-1], np.where(agree.all(1), agree.shape[1], agree.argmin(1))])
    common[np.concatenate([[True], group[1:] != group[:-1]])] = -1
    least, most = np.full(n, -1, np.int64), np.full(n, -1, np.int64)

    def repeats(rows: np.ndarray, depth: np.ndarray, extent: np.ndarray) -> None:
        """Windows of the repeats that begin `extent` ahead of the anchors and end `depth` behind them."""
        fewest, largest = np.maximum(low, length - depth), np.minimum(extent, high)
        ok = fewest <= largest
        rows, fewest, largest = rows[ok], fewest[ok], largest[ok]
        least[rows] = np.where((least[rows] < 0) | (fewest < least[rows]), fewest, least[rows])
        most[rows] = np.maximum(most[rows], largest)

    # a leaf that stands for several documents is a repeat as far as it reaches
    shared = np.flatnonzero(first < last)
    repeats(shared, right[shared], room[shared])
    tree = Tree(common, length - high)
    order_ahead = np.zeros(n, np.int64)
    if high:
        order_ahead[np.lexsort(ahead.T[::-1])] = np.arange(n)
    for height in range(int(tree.height.max()) + 1 if len(tree.height) else 0):
        nodes = np.flatnonzero(tree.height == height)
        sizes = tree.last[nodes] - tree.first[nodes] + 1
        node = np.repeat(np.arange(len(nodes)), sizes)
        rows = np.arange(len(node)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(tree.first[nodes], sizes)
        order = np.lexsort((order_ahead[rows], node))
        rows, node = rows[order], node[order]
        here, there = rows[1:], rows[:-1]
        alike = (ahead[here] == ahead[there]) & (ahead[here] > 0)
        adjacent = np.where(alike.all(1), alike.shape[1], alike.argmin(1)) if alike.shape[1] else np.zeros(len(here), np.int64)
        edge = node[1:] != node[:-1]
        one = first[rows] == last[rows]
        same = one[1:] & one[:-1] & (first[here] == first[there]) & ~edge
        adjacent = np.where(edge, -1, adjacent)
        up = _nearest(np.concatenate([[-1], adjacent]), np.concatenate([[False], same]))
        down = _nearest(np.concatenate([[-1], adjacent[::-1]]), np.concatenate([[False], same[::-1]]))[::-1]
        extent = np.minimum(np.maximum(up, down), room[rows])
        told = np.flatnonzero(extent >= 0)
        repeats(rows[told], tree.depth[nodes][node[told]], extent[told])
    return least, most


def _resolved(rows: DataFrame, length: int, group: int) -> DataFrame:
    """low, high, prefix, id, least, most of the suffixes that have a shared window. One partition at a time."""
    ordered = (
        rows.withColumn("suffix", F.expr("substring(context, before + 1)"))
        .repartition("low", "high", "prefix")
        .sortWithinPartitions("low", "high", "prefix", "suffix")
        .select("low", "high", "prefix", "id", "before", "context", "a", "z")
    )
    names = ["low", "high", "prefix", "id", "before", "context", "a", "z"]

    def settle(table: pa.Table) -> Iterator[pa.RecordBatch]:
        lows, highs, prefixes = (table.column(c).to_numpy() for c in ("low", "high", "prefix"))
        edges = np.flatnonzero(np.concatenate([[True], (lows[1:] != lows[:-1]) | (highs[1:] != highs[:-1]), [True]]))
        for s, e in zip(edges, edges[1:]):
            part = table.slice(s, e - s)
            least, most = shared_offsets(
                prefixes[s:e], part.column("context").to_pylist(), part.column("before").to_numpy().astype(np.int64),
                part.column("a").to_numpy(), part.column("z").to_numpy(), int(lows[s]), int(highs[s]), length,
            )
            hit = pa.array(np.flatnonzero(least >= 0))
            kept = part.select(names[:4]).take(hit).combine_chunks()
            if kept.num_rows:
                bounds = [pa.array(x[least >= 0].astype(np.int32)) for x in (least, most)]
                yield pa.RecordBatch.from_arrays([*(c.chunk(0) for c in kept.columns), *bounds], [*names[:4], "least", "most"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size < group:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            keys = [table.column(c).to_numpy() for c in ("low", "high", "prefix")]
            changes = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0))
            cut = int(changes[-1]) + 1 if len(changes) else 0  # the last partition may go on in the next batch
            if cut:
                yield from settle(table.slice(0, cut))
                table = table.slice(cut)
            held, size = table.combine_chunks().to_batches(), table.num_rows
        if size:
            yield from settle(pa.Table.from_batches(held).combine_chunks())

    return ordered.mapInArrow(run, "low int, high int, prefix bigint, id bigint, least int, most int")


def _collapsed(rows: DataFrame) -> DataFrame:
    """Suffixes alike within their windows' reach are one, with the least and greatest document."""
    return (
        rows.groupBy("low", "high", "prefix", "before", "context").agg(F.min("a").alias("a"), F.max("z").alias("z"))
        .withColumn("id", F.xxhash64("before", "context"))
    )


def _halved(rows: DataFrame, length: int) -> DataFrame:
    """Each row twice, for the lower and the upper half of its offsets, with the longer prefix each half has in
    common and the context cut to its reach. Halves in which no window lies within the text go."""
    middle = F.expr("(low + high) DIV 2").cast("int")
    both = rows.withColumn("half", F.explode(F.array(
        F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct((middle + 1).alias("low"), F.col("high").alias("high"))
    ))).select("prefix0", "id0", F.col("half.low").alias("low"), F.col("half.high").alias("high"), "before", "context", "a", "z")
    fits = F.expr(f"before >= low AND char_length(context) - before >= {length} - high")
    start, size = F.expr("greatest(0, before - high)"), F.expr(f"least(before, high) + {length} - low")
    shared = F.substring("context", F.expr("before - low + 1"), F.expr(f"low + {length} - high"))
    return both.where(fits).select(
        "prefix0", "id0", "low", "high", F.xxhash64(shared).alias("prefix"), F.least("before", "high").alias("before"),
        F.substring("context", start + 1, size).alias("context"), "a", "z",
    )


def shared_spans(documents: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """doc_id, span_from, span_to: the maximal runs of shared characters of each text."""
    reach = length - length // 2
    found = materialize(anchors(documents, length), "span-anchors")
    members = materialize(
        suffixes(documents, found, length).withColumn("id", F.xxhash64("before", "context")), "span-suffixes"
    )
    discard(found)
    distinct = materialize(
        _collapsed(members.select(
            F.lit(0).alias("low"), F.lit(reach).alias("high"), "prefix", "before", "context", F.col("doc").alias("a"), F.col("doc").alias("z")
        )), "span-contexts",
    )
    spans = _spans(distinct, length, group)
    windows = members.select("doc", "pos", "prefix", "more", "step", "id").join(spans, ["prefix", "id"]).select(
        "doc", (F.col("pos") - F.col("most")).alias("span_from"), (F.col("pos") + F.col("more") * F.col("step") - F.col("least") + length).alias("span_to")
    )
    return _merged(windows)


def _spans(distinct: DataFrame, length: int, group: int) -> DataFrame:
    """prefix, id, least, most of the distinct suffixes, partitions split until none is larger than group."""
    keys = ["low", "high", "prefix"]
    state = distinct.withColumns({"prefix0": F.col("prefix"), "id0": F.col("id")})
    rows, answers = distinct, []
    while True:
        sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"))
        large = sizes.where(F.col("n") > group).select(*keys)
        some = not large.isEmpty()
        small = rows.join(large, keys, "left_anti") if some else rows
        got = _resolved(small, length, group)
        if not answers:
            answers.append(got.select("prefix", "id", "least", "most"))
        else:
            answers.append(
                state.join(got, [*keys, "id"]).select(F.col("prefix0").alias("prefix"), F.col("id0").alias("id"), "least", "most")
            )
        if not some:
            break
        state = _halved(state.join(large, keys, "left_semi"), length).withColumn("id", F.xxhash64("before", "context"))
        state = materialize(state, "span-state")
        rows = materialize(_collapsed(state), "span-contexts")
    if len(answers) == 1:
        return answers[0]
    every = answers[0]
    for more in answers[1:]:
        every = every.unionByName(more)
    # windows of one anchor all overlap, so what several steps found for it is one span
    return every.groupBy("prefix", "id").agg(F.min("least").alias("least"), F.max("most").alias("most"))


def _merged(windows: DataFrame) -> DataFrame:
    """Union of spans by document; spans that touch are one run."""
    order = Window.partitionBy("doc").orderBy("span_from", "span_to")
    reached = F.max("span_to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(F.col("span_from") <= F.col("reached"), 0).otherwise(1)
    return (
        windows.groupBy("doc", "span_from").agg(F.max("span_to").alias("span_to"))
        .withColumn("reached", reached)
        .withColumn("run", F.sum(starts).over(order))
        .groupBy("doc", "run")
        .agg(F.min("span_from").cast("bigint").alias("span_from"), F.max("span_to").cast("bigint").alias("span_to"))
        .select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "span_from", "span_to")
    )


def shared_parts(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, n_chars, shared_chars, share: how much of each text is shared elsewhere."""
    sums = spans.groupBy(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc")).agg(F.sum(F.col("span_to") - F.col("span_from")).alias("s"))
    chars = F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint")
    shared = F.coalesce("s", F.lit(0)).cast("bigint")
    return _named(documents).join(sums, "doc", "left").select(
        F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), chars.alias("n_chars"), shared.alias("shared_chars"),
        F.coalesce(shared / F.nullif(chars, F.lit(0)), F.lit(0.0)).alias("share"),
    )
