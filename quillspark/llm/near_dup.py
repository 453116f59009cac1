"""Operator 10: MinHash near-duplicate detection with an LSH forest.

Every distinct shingle set gets a signature of TREES * DEPTH MinHash values; each run of DEPTH values is the set's key in
one tree. Spark sorts the keys of all trees. Sets that follow each other in a tree and share a prefix of at least
``least_depth`` values are candidates of the first round. Components of confirmed links are formed. In the second round
every region, the sets of a tree that share such a prefix, is looked at again if it holds several components: sets that are
similar to one of another component are linked, at the same depth in regions of every size. Links are decided on full sets
of 64-bit hashes, so they are exact; a pair at the threshold of 0.8 is missed by all 28 trees with a probability of 1.5e-5, if
no other path joins it.

Defined results: texts that are null, empty or blank have no shingles and are linked with nothing; texts may be of any
length; repeated rows are in one component; texts that share an id, or have none, are looked at one by one; the component_id
is null if only rows with a null id are in the component; an empty table gives an empty table; only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.cluster import discard, map_arrow, staged, texts_of
from quillspark.llm.components import components
from quillspark.llm.shingles import WordHashes, shingle_set

TREES, DEPTH, LEAST_DEPTH = 28, 8, 5
#: Trees whose neighbours are the candidates of the first round.
FIRST_TREES = 3
#: Shingles of a cell's members and of its probes, and what a set counts for besides its shingles.
CELL, SET_COST = 1 << 19, 256
#: Sets to be looked up in the documents up to which their list is broadcast (24 bytes each); beyond, the join shuffles.
BROADCAST_ROWS = 500_000

_FACTORS = np.random.default_rng(20).integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray) -> bytes:
    """The lower halves of the MinHash values, in 16 bits each."""
    least = np.full(TREES * DEPTH, 0xFFFFFFFF, np.uint64)
    for i in range(0, len(shingles), 256):
        least = np.minimum(least, ((shingles[i : i + 256, None] * _FACTORS) >> np.uint64(32)).min(axis=0))
    return least.astype(">u2").tobytes()


def features(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, node (a hash of the set) and sig; node is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            counts, nodes, signatures = [], [], []
            for text in texts_of(batch.column(1)):
                s = shingle_set(text, words, known)
                counts.append(len(s))
                nodes.append(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None)
                signatures.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(nodes, pa.int64()), pa.array(signatures, pa.binary())], ["doc_id", "text_hash", "n_shingles", "node", "sig"])

    kind = dict(docs.dtypes)["doc_id"]
    return map_arrow(docs.select("doc_id", "text", F.xxhash64("text")), run, f"doc_id {kind}, text_hash long, n_shingles long, node long, sig binary")


def tree_rows(sets: DataFrame, trees: int, *more: str) -> DataFrame:
    """A row for each set and tree: tree, key, node."""
    width = 2 * DEPTH
    rows = sets.select("node", "sig", *more, F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    return rows.select("tree", F.expr(f"substring(sig, tree * {width} + 1, {width})").alias("key"), "node", *more)


def _keys(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u2").reshape(-1, DEPTH)


def neighbours(rows: DataFrame, least_depth: int) -> DataFrame:
    """a, b of rows that follow each other in a tree's order and share ``least_depth`` values or more.

    Rows are range-partitioned, with the node as the last key, so equal keys may lie in several partitions. The first and
    the last row of each partition are compared in a second pass over two rows a partition.
    """

    def scan(tree: np.ndarray, key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = (tree[1:] == tree[:-1]) & (key[1:, :least_depth] == key[:-1, :least_depth]).all(axis=1) & (node[1:] != node[:-1])
        return np.minimum(node[1:], node[:-1])[near], np.maximum(node[1:], node[:-1])[near]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, last = ["a", "b", "tree", "key"], None

        def edge(row: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([int(row[2])]), pa.array([None], pa.int64()), pa.array([int(row[0])], pa.int32()), pa.array([row[1].tobytes()], pa.binary())], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            tree, key, node = batch.column(0).to_numpy(), _keys(batch.column(1)), batch.column(2).to_numpy()
            if last is None:
                yield edge((tree[0], key[0], node[0]))
            else:
                tree, key, node = np.r_[last[0], tree], np.vstack([last[1][None], key]), np.r_[last[2], node]
            last = (tree[-1], key[-1], node[-1])
            a, b = scan(tree, key, node)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.binary())], names)
        if last is not None:
            yield edge(last)

    schema = "a long, b long, tree int, key binary"
    found = staged(rows.select("tree", "key", "node").repartitionByRange("tree", "key", "node").sortWithinPartitions("tree", "key", "node").mapInArrow(run, schema), "neighbours")
    ends = found.where("b is null").select("tree", "key", F.col("a").alias("node")).coalesce(1).sortWithinPartitions("tree", "key", "node")
    pairs = staged(found.where("b is not null").select("a", "b").unionByName(ends.mapInArrow(run, schema).where("b is not null").select("a", "b")).distinct(), "pairs")
    discard(found)
    return pairs


def dealt(found: DataFrame, sets: DataFrame) -> DataFrame:
    """The cells that compare the sets of each region: cell, node, component, member, probe and main.

    ``found`` has region and node. ``main`` is the component with the most in the region. Members, which are all sets, are
    dealt over chunks; probes, the sets outside ``main``, over blocks. A cell holds one chunk and one block, CELL of each,
    so each probe meets all members and no task holds a region.
    """
    rows = found.join(sets.select("node", "component", (F.col("n_shingles") + SET_COST).alias("held")), "node")
    sums = rows.groupBy("region", "component").agg(F.sum("held").alias("held"))
    regions = sums.groupBy("region").agg(F.max(F.struct("held", "component")).alias("most"), F.sum("held").alias("all"))
    regions = regions.select("region", F.col("most.component").alias("main"), F.ceil(F.col("all") / CELL).alias("chunks"), F.ceil((F.col("all") - F.col("most.held")) / CELL).alias("blocks"))
    rows = rows.join(regions, "region").withColumn("chunk", F.expr("pmod(xxhash64(node, 1), chunks)")).withColumn("block", F.expr("pmod(xxhash64(node, 2), blocks)"))
    # a probe in its own chunk and block is one row
    as_member = F.expr("transform(sequence(0L, blocks - 1), b -> struct(chunk as chunk, b as block, true as member, component != main and b = block as probe))")
    as_probe = F.expr("transform(filter(sequence(0L, chunks - 1), c -> component != main and c != chunk), c -> struct(c as chunk, block as block, false as member, true as probe))")
    rows = rows.select("region", "node", "component", "main", F.explode(F.concat(as_member, as_probe)).alias("at"))
    return rows.select(F.xxhash64("region", "at.chunk", "at.block").alias("cell"), "node", "component", "at.member", "at.probe", "main")


def linked_components(docs: DataFrame, sets: DataFrame, words: int, least_depth: int, num: int, den: int) -> DataFrame:
    """a, b of similar sets in different components that share ``least_depth`` values or more in a tree: in each cell of a
    region, one pair for components that become one.

    ``sets`` has node, doc_id, text_hash, sig, n_shingles and component. Regions are found by numbers alone; the sets themselves follow
    only to regions with several components. There a set outside the largest component is compared with all others, those of
    a cell at once, in one gather over their hashes, and no pairs are listed. Links are exact: only similar sets make
    components one.
    """
    rows = tree_rows(sets, TREES, "component").withColumn("region", F.xxhash64("tree", F.expr(f"substring(key, 1, {2 * least_depth})")))
    mixed = rows.groupBy("region").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("region")
    found = staged(rows.select("region", "node").join(mixed, "region"), "regions")
    shingles = _sets_for(docs, sets, found.select("node").distinct(), words)
    rows = dealt(found, sets).join(shingles, "node").select("cell", "node", "component", "member", "probe", "main", "shingles")
    rows = rows.repartition("cell").sortWithinPartitions("cell", F.desc("member"), "node")

    def links(node: np.ndarray, group: np.ndarray, member: np.ndarray, probe: np.ndarray, main: int, held: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        """Of one cell, whose members come first."""
        sizes = np.array([len(h) for h in held])
        ends = np.cumsum(sizes)
        n = int(member.sum())
        known, flat = np.unique(np.concatenate(held), return_inverse=True)
        mark = np.zeros(len(known), bool)
        for i in np.flatnonzero(probe):
            # what is linked to the main component meets the others where they are the probes
            if group[i] == main or not n:
                continue
            own = flat[ends[i] - sizes[i] : ends[i]]
            mark[own] = True
            shared = np.add.reduceat(mark[flat[: ends[n - 1]]], ends[:n] - sizes[:n], dtype=np.int64)
            mark[own] = False
            similar = np.flatnonzero((den * shared >= num * (sizes[:n] + sizes[i] - shared)) & (group[:n] != group[i]))
            others, first = np.unique(group[similar], return_index=True)
            for j in similar[first]:
                yield min(node[i], node[j]), max(node[i], node[j])
            if len(others):
                group[np.isin(group, others) | (group == group[i])] = main if main in others else group[i]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            one = [np.frombuffer(x, np.uint64) for x in t["shingles"].to_pylist()]
            found = list(links(t["node"].to_numpy(), t["component"].to_numpy().copy(), t["member"].to_numpy(), t["probe"].to_numpy(), t["main"][0].as_py(), one))
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            cell = batch.column(0).to_numpy()
            cuts = np.r_[0, np.flatnonzero(cell[1:] != cell[:-1]) + 1, len(cell)]
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if held and held[0].column(0)[0].as_py() != cell[i]:
                    yield flush()
                    held = []
                if j > i:
                    held.append(batch.slice(i, j - i))
        if held:
            yield flush()

    out = staged(map_arrow(rows, run, "a long, b long").distinct(), "links")
    discard(found, shingles)
    return out


def confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs with den * (size of intersection) >= num * (size of union). ``sets``: node, shingles (binary)."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = 0
                if den * min(len(x), len(y)) >= num * max(len(x), len(y)):
                    both = np.sort(np.concatenate([x, y]), kind="stable")
                    shared = int((both[1:] == both[:-1]).sum())
                ok.append(shared > 0 and den * shared >= num * (len(x) + len(y) - shared))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return map_arrow(both, run, "a long, b long")


def sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node, shingles of the wanted sets. ``wanted`` has node, and doc_id and text_hash of a row that has the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            found = [shingle_set(t, words, known).tobytes() for t in texts_of(batch.column(1))]
            # of texts that share a hash, the one with the set that was asked for
            own = [xxhash.xxh3_64_intdigest(s) - (1 << 63) == n for s, n in zip(found, batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["node", "shingles"]).filter(pa.array(own, pa.bool_()))

    wanted = staged(wanted.select("node", F.col("doc_id").alias("i"), F.col("text_hash").alias("h")), "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    rows = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("i")) & (F.xxhash64("text") == F.col("h"))).select("node", "text")
    return map_arrow(rows, run, "node long, shingles binary").dropDuplicates(["node"])


def _labelled(docs: DataFrame, words: int, num: int, den: int, least_depth: int) -> tuple[DataFrame, DataFrame]:
    """The features of all rows, and node, doc_id (the smallest with the set) and component of each set."""
    found = staged(features(docs, words), "features")
    sets = staged(found.where("node is not null").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("o"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles")).select("node", "o.doc_id", "o.text_hash", "sig", "n_shingles"), "sets")
    first = neighbours(tree_rows(sets, FIRST_TREES), least_depth)
    shingles = _sets_for(docs, sets, _nodes(first), words)
    links = staged(confirmed(first, shingles, num, den), "links")
    discard(first, shingles)
    joined = components(links)
    labelled = staged(sets.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node")), "labelled")
    discard(joined)
    more = linked_components(docs, labelled, words, least_depth, num, den)
    joined = components(links.unionByName(more))
    discard(labelled, links, more)
    return found, sets.select("node", "doc_id").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, least_depth: int = LEAST_DEPTH) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach) and kept (it is the row's own)."""
    found, labels = _labelled(docs, words, num, den, least_depth)
    smallest = labels.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    labels = staged(labels.join(smallest, "component").select("node", "component_id"), "labels")
    out = found.select("doc_id", "n_shingles", "node").join(labels, "node", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def without_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, least_depth: int = LEAST_DEPTH) -> DataFrame:
    """``docs`` with one row of each component: of those with the smallest id (null is the largest) one text, and of rows
    with the same id and text the least by their other columns (but for maps, which have no order). Rows are told apart by id and text, so none goes for another
    text of its id. Texts without words are duplicates only of rows with the same id and text."""
    found, labels = _labelled(docs, words, num, den, least_depth)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node")).alias("o")
    chosen = staged(labels.groupBy("component").agg(first).select(F.col("o.node").alias("n"), F.col("o.doc_id").alias("i")), "chosen")
    texts = found.where("node is not null").groupBy("node", "doc_id").agg(F.min("text_hash").alias("text_hash"))
    texts = texts.join(chosen, (F.col("node") == F.col("n")) & F.col("doc_id").eqNullSafe(F.col("i")), "left_semi").select("doc_id", "text_hash")
    kept = texts.unionByName(found.where("node is null").select("doc_id", "text_hash").distinct())
    i, h, row = ("_" * max(map(len, docs.columns)) + x for x in ("id", "hash", "row"))  # longer than any column's name
    kept = staged(kept.select(F.col("doc_id").alias(i), F.col("text_hash").alias(h)), "kept")
    rows = docs.join(kept, F.col("doc_id").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(h)), "left_semi")
    ordered = F.struct(*(c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind))  # maps have no order
    return rows.groupBy("doc_id", F.xxhash64("text").alias(h)).agg(F.min_by(F.struct(*docs.columns), ordered).alias(row)).select(f"{row}.*")


def _nodes(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def _sets_for(docs: DataFrame, sets: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    return staged(sets_of(docs, sets.select("node", "doc_id", "text_hash").join(nodes, "node", "left_semi"), words), "shingles")
