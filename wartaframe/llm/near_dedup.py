"""Near-duplicate documents by chosen-path set similarity join.

A document is its set of distinct word shingles; two are linked when the Jaccard
similarity of their sets reaches the threshold. The join finds the linked pairs
with independent trees: the path of a document through a tree branches on minwise
tokens that the tree chooses, so similar sets share many paths and others part
quickly. A node with few documents is compared exhaustively on its sketches; a
larger one branches further. Candidates are confirmed on the full sets.

The two upper levels of a tree are taken in one step. A node chooses one
coordinate, every fourth two, so paths of similarity 0.8 neither die out nor
multiply. A pair at the threshold follows one of the paths of the upper levels
with a chance of 0.64; a tree with one path misses it with a chance of 0.36, with
two 0.23, with three 0.084. TREES = 12 trees with 21 paths together miss it with a chance
of 1.6e-8, 5.3e-7 where all common nodes branch once more and 5.5e-6 where they
branch twice; large nodes are followed on all of them. The sketch filter
(two bits of 1024 minwise values, cut-off four standard deviations below the
threshold) adds about 3e-5. Members of full sets are 64-bit hashes: two of n different
shingles of a pair have the same one with a chance of n * n / 2^65.

Skew. Equal sets collapse to one representative with an aggregate first, so exact
copies never meet. In a large node every document is compared with one pivot (a
medoid of a sample), which ties a large group of near copies together in linear
time; after that only documents of different components are compared, confirmed
inside their unit, and no more links written than tie these together. Where few
documents of a large node are outside its largest component, they are compared
with all of it in blocks, otherwise the node branches. Nothing is capped: nodes
that stay large after DEPTH levels go through the blocks, too.

Defined results. Null, empty or wordless texts have no set: n_shingles 0, linked
with nothing, kept. Rows with a null doc_id are counted but never linked, their
component is null and they are kept. Rows that repeat a doc_id are one node.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wartaframe.llm.words import mix, pieces, shingle_sets, words
from wartaframe.session import checkpointed

SHINGLE_WORDS = 5
THRESHOLD_PERCENT = 80
TREES = 12
#: Paths whose large nodes have a pivot in the first round. It only ties components together
#: early; the second round follows the large nodes of all paths that still hold several.
LARGE_PATHS = 10
#: Levels below the two upper ones.
DEPTH = 2
#: Documents of a node that are compared exhaustively.
SMALL_NODE = 256
#: Members of a large node among which its pivot is chosen (expected number).
PIVOT_SAMPLE = 64
#: Members of one side of a block in which a large node's components are compared.
BLOCK = 1024
#: Documents outside the largest component of a node up to which it is not branched.
FEW = 1024
COORDINATES = 1024
#: Coordinates that nodes below the upper levels choose from; their values are kept as bytes.
BRANCHING = 64
SKETCH_CUT = 0.74
SURE = 0.88
#: Rows up to which a list of ids is copied to all executors (16 bytes each).
BROADCAST_IDS = 1_000_000

_random = np.random.default_rng(20240101)
_A = _random.integers(0, 1 << 32, COORDINATES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _random.integers(0, 1 << 32, COORDINATES, dtype=np.uint64).astype(np.uint32)
#: (tree, coordinate, coordinate): paths through the two upper levels; every fourth node has two branches.
_ROOTS = [
    (tree, int(upper), int(lower))
    for tree in range(TREES)
    for place, upper in enumerate(_random.choice(COORDINATES, 2 if tree % 4 == 0 else 1, replace=False))
    for lower in _random.choice(COORDINATES, 2 if (tree + place) % 4 == 1 else 1, replace=False)
]


def _sketch(row: np.ndarray, value: np.ndarray, texts: int) -> np.ndarray:
    """Minwise values of every set with members; rows of empty sets stay zero."""
    out = np.zeros((texts, COORDINATES), np.uint32)
    if len(row):
        starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        x = (value >> np.uint64(32)).astype(np.uint32)
        for i in range(COORDINATES):
            out[row[starts], i] = np.minimum.reduceat(x * _A[i] + _B[i], starts)
    return out


#: Number of two-bit fields of a byte that are zero.
_ZERO_FIELDS = sum(((np.arange(256) >> shift) & 3 == 0) for shift in (0, 2, 4, 6)).astype(np.uint8)


def _packed(values: np.ndarray) -> np.ndarray:
    """Bytes of a sketch: two bits of every minwise value, then whole bytes for branching."""
    fields = ((values >> np.uint32(3)) ^ (values >> np.uint32(17))).astype(np.uint8) & 3
    fields = fields.reshape(len(values), -1, 4) << np.array([0, 2, 4, 6], np.uint8)
    branch = ((values[:, :BRANCHING] >> np.uint32(5)) ^ (values[:, :BRANCHING] >> np.uint32(13))).astype(np.uint8)
    return np.concatenate((np.bitwise_or.reduce(fields, axis=2), branch), axis=1)


def _binary(matrix: np.ndarray) -> pa.Array:
    """One binary value per row of a byte matrix."""
    flat = np.ascontiguousarray(matrix)
    offsets = np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]
    return pa.BinaryArray.from_buffers(
        pa.binary(), len(flat), [None, pa.py_buffer(offsets), pa.py_buffer(flat)]
    )


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def sketched(docs: DataFrame, shingle_words: int) -> DataFrame:
    """Size, fingerprint, root branches and sketch of each document's set."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                row, value = shingle_sets(words(piece.column("text"), lower=True), shingle_words)
                size = np.bincount(row, minlength=len(piece))
                sums = []
                for salt in (1, 2):
                    total = np.concatenate(
                        (np.zeros(1, np.uint64), np.cumsum(mix(value + np.uint64(salt)), dtype=np.uint64))
                    )
                    ends = np.cumsum(size)
                    sums.append(total[ends] - total[ends - size])
                sketch = _sketch(row, value, len(piece))
                keys = np.stack(
                    [
                        mix(
                            mix(sketch[:, upper].astype(np.uint64) + (np.uint64(tree * COORDINATES + upper) << np.uint64(32)))
                            + sketch[:, lower].astype(np.uint64)
                            + (np.uint64(lower) << np.uint64(32))
                        )
                        for tree, upper, lower in _ROOTS
                    ],
                    axis=1,
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id").cast(pa.int64()),
                        pa.array(size.astype(np.int64)),
                        _longs(sums[0]),
                        _longs(sums[1]),
                        _binary(keys.view(np.uint8).reshape(len(piece), -1)),
                        _binary(_packed(sketch)),
                    ],
                    ["doc_id", "n_shingles", "fp_a", "fp_b", "branches", "sketch"],
                )

    schema = "doc_id long, n_shingles long, fp_a long, fp_b long, branches binary, sketch binary"
    return docs.select("doc_id", "text").mapInArrow(rows, schema)


def _root_rows(classes: DataFrame) -> DataFrame:
    """(node, path, rep): one row per path of each representative through the upper levels."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep = batch.column("rep").to_numpy(zero_copy_only=False)
            node = np.frombuffer(b"".join(batch.column("branches").to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(node),
                    pa.array(np.tile(np.arange(len(_ROOTS), dtype=np.int32), len(rep))),
                    pa.array(np.repeat(rep, len(_ROOTS))),
                ],
                ["node", "path", "rep"],
            )

    return classes.select("rep", "branches").mapInArrow(rows, "node long, path int, rep long")


def _shared(rows: DataFrame) -> DataFrame:
    """Rows of nodes with two documents or more, and the node's size."""
    size = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rows.join(size, "node")


def _branched(rows: DataFrame, sketches: DataFrame) -> DataFrame:
    """Children of large nodes: the node itself chooses the coordinates."""

    def child(salt: int):
        at = F.pmod(F.xxhash64("node", F.lit(salt)), F.lit(BRANCHING)).cast("int")
        at = at + COORDINATES // 4 + 1
        return F.xxhash64("node", at, F.substring("sketch", at, F.lit(1)))

    second = F.when(F.pmod(F.xxhash64("node", F.lit(0)), F.lit(4)) == 0, child(2))
    return (
        rows.join(sketches, "rep")
        .select("rep", F.explode(F.array_compact(F.array(child(1), second))).alias("node"))
        .distinct()
    )


def _estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from two-bit minwise values, corrected for chance equality."""
    equal = _ZERO_FIELDS[a ^ b].sum(axis=1, dtype=np.int32) / COORDINATES
    return (equal - 1 / 4) / (1 - 1 / 4)


def _matrix(column: pa.Array) -> np.ndarray:
    """The two-bit parts of sketches."""
    rows = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return rows[:, : COORDINATES // 4]


def _pivot_pairs(large: DataFrame, sketches: DataFrame) -> DataFrame:
    """Candidates between each member of a large node and the node's pivot."""
    sample = large.filter(
        F.pmod(F.xxhash64("node", "rep", F.lit(7)), F.col("n")) < PIVOT_SAMPLE
    ).join(sketches, "rep")

    def medoid(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rep").reset_index(drop=True)
        sketches = np.frombuffer(b"".join(group["sketch"]), np.uint8).reshape(len(group), -1)
        sketches = sketches[:, : COORDINATES // 4]
        close = np.array([_estimate(sketches, one).mean() for one in sketches])
        return group.iloc[[int(close.argmax())]][["node", "rep", "sketch"]]

    pivots = sample.groupBy("node").applyInPandas(medoid, "node long, rep long, sketch binary")
    pivots = pivots.select("node", F.col("rep").alias("pivot"), F.col("sketch").alias("pivot_sketch"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                close = _estimate(_matrix(batch.column("sketch")), _matrix(batch.column("pivot_sketch")))
                kept = batch.filter(pa.array(close >= SKETCH_CUT))
                yield kept.select(["rep", "pivot"])

    pairs = large.select("node", "rep").join(pivots, "node").filter("rep <> pivot").join(sketches, "rep")
    return pairs.select("rep", "pivot", "sketch", "pivot_sketch").mapInArrow(near, "rep long, pivot long")


def _labelled(units: DataFrame, sketches: DataFrame, labels: DataFrame) -> DataFrame:
    rows = units.join(sketches, "rep").join(labels, "rep", "left")
    return rows.withColumn("label", F.coalesce("label", "rep"))


def _by_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole units of a stream sorted by unit, some of them at a time."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
        if not table.num_rows:
            continue
        unit = table.column("unit").to_numpy()
        whole = 0 if unit[0] == unit[-1] else int(len(unit) - np.argmax(unit[::-1] != unit[-1]))
        rest = table.slice(whole).combine_chunks()
        if whole:
            yield table.slice(0, whole)
    if rest is not None and rest.num_rows:
        yield rest


def _close_pairs(
    unit: np.ndarray, side: np.ndarray, sketch: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and estimated similarity of the pairs of each unit that differ in ``side`` and pass the cut."""
    sizes = np.diff(np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1], [True]))))
    after = np.concatenate([np.arange(s - 1, -1, -1) for s in sizes])
    lows, highs, likes = [], [], []
    bounds = np.searchsorted(np.cumsum(after), np.arange(0, after.sum() + 1, 1 << 16))
    cuts = np.unique(np.concatenate((bounds, [len(after)])))
    for start, stop in zip(cuts[:-1], cuts[1:]):
        span = after[start:stop]
        low = np.repeat(np.arange(start, stop), span)
        high = low + 1 + np.arange(len(low)) - np.repeat(np.cumsum(span) - span, span)
        apart = side[low] != side[high]
        low, high = low[apart], high[apart]
        like = _estimate(sketch[low], sketch[high])
        close = like >= SKETCH_CUT
        lows.append(low[close]), highs.append(high[close]), likes.append(like[close])
    return np.concatenate(lows), np.concatenate(highs), np.concatenate(likes)


def _unit_pairs(units: DataFrame, sketches: DataFrame) -> DataFrame:
    """Candidate pairs inside small units, compared exhaustively on sketches.

    Each document names one partner that is surely similar, or its best partner
    when none is sure: enough to tie components together.
    """

    def chosen(rep, low, high, like):
        sure = like >= SURE
        tied = np.zeros(len(rep), bool)
        tied[low[sure]] = tied[high[sure]] = True
        by_high = np.lexsort((low, high))
        by_high = by_high[sure[by_high]]
        leads = by_high[np.concatenate(([True], high[by_high][1:] != high[by_high][:-1]))] if len(by_high) else by_high
        near = np.flatnonzero(~sure)
        both = np.concatenate((near, near))
        end = np.concatenate((low[near], high[near]))
        both, end = both[~tied[end]], end[~tied[end]]
        order = np.lexsort((both, -like[both], end))
        best = both[order][np.concatenate(([True], end[order][1:] != end[order][:-1]))] if len(order) else both
        return np.unique(np.concatenate((leads, best)))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_unit(batches):
            rep = table.column("rep").to_numpy()
            low, high, like = _close_pairs(table.column("unit").to_numpy(), rep, _matrix(table.column("sketch")))
            if len(low):
                kept = chosen(rep, low, high, like)
                low, high = low[kept], high[kept]
            out = pd.DataFrame({"a": rep[low], "b": rep[high]}).drop_duplicates()
            yield pa.RecordBatch.from_pandas(out.astype("int64"), preserve_index=False)

    rows = units.join(sketches, "rep").select("unit", "rep", "sketch")
    return rows.repartition("unit").sortWithinPartitions("unit", "rep").mapInArrow(pairs, "a long, b long")


def _unit_links(
    units: DataFrame, sketches: DataFrame, labels: DataFrame, docs: DataFrame, shingle_words: int, percent: int
) -> DataFrame:
    """(a, b): confirmed links that tie the components inside each unit together.

    First the members of units with a close document of another component are
    named, then their full sets come to the unit. Close pairs are confirmed there,
    the most similar first, and only where their components are still apart. So a
    unit gives fewer links than it has documents, however many pairs are close.
    """

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_unit(batches):
            sides = table.column("label").to_numpy()
            low, high, _ = _close_pairs(table.column("unit").to_numpy(), sides, _matrix(table.column("sketch")))
            kept = pa.array(np.unique(np.concatenate((low, high))))
            yield from table.select(["unit", "rep"]).take(kept).combine_chunks().to_batches()

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_unit(batches):
            rep, side = table.column("rep").to_numpy(), table.column("label").to_numpy()
            members = table.column("members").combine_chunks()
            unit = table.column("unit").to_numpy()
            low, high, like = _close_pairs(unit, side, _matrix(table.column("sketch")))
            root: dict[tuple[int, int], tuple[int, int]] = {}

            def find(x):
                while x in root:
                    x = root[x]
                return x

            links = []
            for k in np.argsort(-like, kind="stable"):
                i, j = low[k], high[k]
                x, y = find((unit[i], side[i])), find((unit[j], side[j]))
                if x != y:
                    left, right = members[int(i)].values.to_numpy(), members[int(j)].values.to_numpy()
                    shared = len(np.intersect1d(left, right, assume_unique=True))
                    if 100 * shared >= percent * (len(left) + len(right) - shared):
                        root[x] = y
                        links.append((rep[i], rep[j]))
            found = np.array(links, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    rows = _labelled(units, sketches, labels).select("unit", "rep", "label", "sketch")
    rows = rows.repartition("unit").sortWithinPartitions("unit", "rep")
    close = checkpointed(rows.mapInArrow(near, "unit long, rep long"))
    members = _members(docs, close.select("rep").distinct(), shingle_words)
    rows = _labelled(close, sketches, labels).join(members, "rep").select("unit", "rep", "label", "sketch", "members")
    return rows.repartition("unit").sortWithinPartitions("unit", "rep").mapInArrow(confirm, "a long, b long")


def _oriented(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    return pairs.filter(F.col(a) != F.col(b)).select(
        F.least(a, b).alias("a"), F.greatest(a, b).alias("b")
    ).distinct()


def _members(docs: DataFrame, ids: DataFrame, shingle_words: int) -> DataFrame:
    """rep and its full set (64-bit hashes of its shingles) for the documents named in ``ids``."""
    ids = checkpointed(ids)
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    wanted = docs.select(F.col("doc_id").alias("rep"), "text").join(ids, "rep", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                row, value = shingle_sets(words(piece.column("text"), lower=True), shingle_words)
                offsets = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(piece)))))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), _longs(value))
                yield pa.RecordBatch.from_arrays([piece.column("rep"), lists], ["rep", "members"])

    return checkpointed(wanted.mapInArrow(sets, "rep long, members array<long>"))


def _confirmed(pairs: DataFrame, docs: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """Those candidate pairs whose full sets reach the threshold."""
    ids = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
    members = _members(docs, ids, shingle_words)
    left = members.select(F.col("rep").alias("a"), F.col("members").alias("left"))
    right = members.select(F.col("rep").alias("b"), F.col("members").alias("right"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("left", "right"))
    tested = both.select("a", "b", shared.alias("shared"), (F.size("left") + F.size("right")).alias("total"))
    ok = 100 * F.col("shared") >= percent * (F.col("total") - F.col("shared"))
    return checkpointed(tested.filter(ok).select("a", "b").distinct())


def _is_stars(edges: DataFrame) -> bool:
    """Whether each node that hangs on another hangs on one only, which hangs on none."""
    ends = edges.select(
        F.inline(
            F.array(
                F.struct(F.col("u").alias("end"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")),
                F.struct(F.col("v").alias("end"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")),
            )
        )
    )
    counts = ends.groupBy("end").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return counts.filter((F.col("hangs") > 1) | ((F.col("hangs") > 0) & (F.col("holds") > 0))).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(rep, label): smallest id reachable, for every id in a link.

    Alternates stars around large and small neighbours until every node hangs on
    its smallest one; the rounds grow with the logarithm of the longest path.
    """
    edges = checkpointed(_oriented(links).select(F.col("b").alias("u"), F.col("a").alias("v")))
    while not _is_stars(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        up = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        up = up.distinct()
        least = up.groupBy("u").agg(F.min("v").alias("m"))
        down = up.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpointed(down.union(least.select("u", F.col("m").alias("v"))).distinct())
    roots = edges.select(F.col("v").alias("u"), "v").distinct()
    return checkpointed(edges.union(roots).select(F.col("u").alias("rep"), F.col("v").alias("label")))


def near_duplicates(
    docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = THRESHOLD_PERCENT
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = checkpointed(sketched(docs, shingle_words))
    classes = (
        sets.filter("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("fp_a", "fp_b")
        .agg(F.min("doc_id").alias("rep"), F.first("branches").alias("branches"), F.first("sketch").alias("sketch"))
    )
    classes = checkpointed(classes)
    sketches = classes.select("rep", "sketch")

    nodes = checkpointed(_shared(_root_rows(classes)))
    large = nodes.filter(F.col("n") > SMALL_NODE)
    units = checkpointed(_units(nodes.filter(F.col("n") <= SMALL_NODE)))

    # first round: one link for each document is enough to tie components together
    tied = large.filter(F.col("path") < LARGE_PATHS)
    pivots = _pivot_pairs(tied, sketches).select(F.col("rep").alias("a"), F.col("pivot").alias("b"))
    pairs = checkpointed(_oriented(_unit_pairs(units, sketches).union(pivots)))
    links = _confirmed(pairs, docs, shingle_words, percent)
    labels = components(links)

    # second round: whatever is still apart, exhaustively
    left = _mixed(units, "unit", labels).select("unit", "rep")
    for level in range(1, DEPTH + 2):
        if large.isEmpty():
            break
        large = checkpointed(_parted(_mixed(large.select("node", "rep"), "node", labels)))
        settled = F.lit(True) if level > DEPTH else F.col("others") <= FEW
        left = left.union(_blocks(large.filter(settled)))
        rest = large.filter(~settled).select("node", "rep")
        if rest.isEmpty():
            break
        shared = checkpointed(_shared(_branched(rest, sketches)))
        left = left.union(_mixed(_units(shared.filter(F.col("n") <= SMALL_NODE)), "unit", labels).select("unit", "rep"))
        large = shared.filter(F.col("n") > SMALL_NODE)
    more = checkpointed(_oriented(_unit_links(left, sketches, labels, docs, shingle_words, percent)))
    if not more.isEmpty():
        labels = components(links.union(more))

    found = classes.select("fp_a", "fp_b", "rep").join(labels, "rep", "left")
    found = found.select("fp_a", "fp_b", F.coalesce("label", "rep").alias("component"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return (
        sets.select("doc_id", "n_shingles", "fp_a", "fp_b")
        .join(found, ["fp_a", "fp_b"], "left")
        .select("doc_id", "n_shingles", component.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def _units(small: DataFrame) -> DataFrame:
    """(unit, rep): sets of documents that meet in small nodes, each of them once.

    Trees often arrive at the same set of documents: one list stands for all of them.
    """
    lists = small.groupBy("node").agg(F.array_sort(F.collect_set("rep")).alias("reps")).select("reps").distinct()
    return lists.select(F.xxhash64("reps").alias("unit"), F.explode("reps").alias("rep"))


def _mixed(rows: DataFrame, key: str, labels: DataFrame) -> DataFrame:
    """Rows whose unit or node holds more than one component, with their ``label``."""
    rows = rows.join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    mixed = rows.groupBy(key).agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    return rows.join(mixed.filter("lo < hi").select(key), key, "left_semi")


def _parted(rows: DataFrame) -> DataFrame:
    """Adds the largest component of each node, its size and the number of other documents."""
    size = rows.groupBy("node", "label").agg(F.count(F.lit(1)).alias("n"))
    main = size.groupBy("node").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("total"))
    main = main.select(
        "node",
        F.col("most.label").alias("main"),
        F.col("most.n").alias("most"),
        (F.col("total") - F.col("most.n")).alias("others"),
    )
    return rows.join(main, "node")


def _blocks(rows: DataFrame) -> DataFrame:
    """(unit, rep): blocks in which all pairs of a node across its components meet.

    The largest component is compared with the others, and the others with
    themselves, BLOCK against BLOCK documents at a time.
    """
    is_main = F.col("label") == F.col("main")
    main_blocks = F.ceil(F.col("most") / BLOCK).cast("int")
    other_blocks = F.ceil(F.col("others") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep", F.lit(3)), F.when(is_main, main_blocks).otherwise(other_blocks)).cast("int")

    def block(x, y, kind: int):
        return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), F.lit(kind).alias("kind"))

    mine = F.col("own")
    with_others = F.transform(F.sequence(F.lit(0), other_blocks - 1), lambda i: block(mine, i, 1))
    with_main = F.transform(F.sequence(F.lit(0), main_blocks - 1), lambda i: block(i, mine, 1))
    among = F.transform(
        F.sequence(F.lit(0), other_blocks - 1), lambda i: block(F.least(i, mine), F.greatest(i, mine), 2)
    )
    keys = F.when(is_main, with_others).otherwise(F.concat(with_main, among))
    return (
        rows.withColumn("own", own)
        .select("node", "rep", F.explode(keys).alias("b"))
        .select(F.xxhash64("node", "b.x", "b.y", "b.kind").alias("unit"), "rep")
    )


def one_of_each(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """Rows of ``docs`` without later members of a group, with all their columns.

    One document of each group stays: the one with the smallest doc_id, and one of
    its rows when that id repeats.
    """
    verdict = checkpointed(near_duplicates(docs, shingle_words, percent))
    gone = verdict.filter(~F.col("kept")).select("doc_id").distinct()
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    twice = verdict.filter("doc_id IS NOT NULL AND kept AND n_shingles > 0").groupBy("doc_id").count().filter("count > 1")
    twice = twice.select("doc_id")
    if twice.isEmpty():
        return kept
    twice = F.broadcast(twice) if twice.count() <= BROADCAST_IDS else twice
    single = kept.join(twice, "doc_id", "left_anti").select(*docs.columns)
    return single.union(kept.join(twice, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"]))
