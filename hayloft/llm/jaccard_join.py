"""N-gram Jaccard join: a MinHash LSH forest with exact verification.

Documents are sets of shingles of five words.  Equal sets are one class and
travel as one representative.  A signature of min-hashes is cut into trees, and
a representative's label in a tree is its run of ``DEPTH`` min-hashes.

The forest: all labels are sorted (by ranges, so that no task holds a tree or a
group of equal labels), which lays every tree out as a prefix trie: a node is a
stretch of labels with a common prefix.  Longest common prefixes with the
neighbours and the lengths of the stretches tell, for each representative and
tree, which nodes it shares and how crowded they are.  Matched prefixes are
then shortened from ``DEPTH`` to ``LEAST_DEPTH`` in every tree, except that each
representative leaves out its most crowded nodes while the others still find a
partner at the threshold with the target recall (``TARGET_RECALL``): so dense
regions are matched by long prefixes, sparse ones by short prefixes.  A node
that one of its members asks for gives candidates among all its members.

Within a node, candidates are compared by signature, which leaves out pairs
far below the threshold, and the rest connects representatives to clusters.
Clusters are then verified exactly on whole shingle sets.  Members of a large
cluster are banded by their exact distance to its first set; as distances add
up, two bands that both lie near it are linked as a whole and two that are far
apart not at all, and only the other bands are compared, dealt out as pairs of
small blocks, so that no task holds a group.  Tasks return counts per
representative and a spanning forest, never the pairs.  Sets are sent as
differences to the cluster's first set.

Result: one row per document with ``class_id`` (the least doc_id of its class:
documents connected by links), ``n_links`` (other documents with a similarity
of at least the threshold), ``n_shingles`` and ``class`` (a key of the class; null
without shingles).

Defined results: a text of one to four words is one shingle of all its words;
null and wordless texts have no shingles, link to nothing and are a class each
(class_id is their own doc_id); repeated rows count as copies of each other; a
null doc_id is carried as it is, and a class of null ids has a null class_id;
other columns are not looked at.  Equality of sets rests on 128 bits of hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import PIECE_BYTES, Block, Scratch, blocks, mix, pieces, sequence_hash, small_batches, string_buffers, words
from .components import components, split_join
from .decontaminate import CAPITALS, SMALL, WORD_PATTERN

SHINGLE_WORDS = 5
THRESHOLD = 0.8
TREES, DEPTH, LEAST_DEPTH = 20, 6, 3
TARGET_RECALL = 0.9999
#: Bytes of one tree's label.
LABEL = 2 * DEPTH
#: Rows of a block of candidates; tasks hold two.  A node or cluster of more is crowded.
BLOCK = 128
#: Signatures that agree less than this far below the threshold are left out (over 5 standard deviations).
SLACK = 0.2
#: Members of a large node that agree with its leader in this share of min-hashes are tied to it.
LEADER = 0.35
#: Width of a band of distances to a large cluster's first set.
BAND = 0.02


def missed(depth: int, threshold: float) -> float:
    """Log of the chance that a pair at the threshold doesn't share a tree's node at this depth."""
    return math.log1p(-(threshold**depth))


def shingles(block: Block, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first hash of each row) of the shingles of every row, repeated ones included."""
    found = words(block)
    full = sequence_hash(found.hash, k)
    count = np.diff(found.first)
    n = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    first = np.concatenate([[0], np.cumsum(n)])
    row = np.repeat(np.arange(block.rows), n)
    at = found.first[row] + np.arange(first[-1]) - first[row]
    out = np.zeros(first[-1], np.uint64)
    long = count[row] >= k
    out[long] = full[at[long]]
    for r in np.flatnonzero((count > 0) & (count < k)):
        own = found.hash[found.first[r] : found.first[r + 1]]
        out[first[r]] = sequence_hash(own, len(own))[0]
    return out, first


def shingle_sets(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every row, sorted in each row, and where rows begin."""
    if block.rows == 1 and len(block.data) > PIECE_BYTES:
        each, total, found = [], 0, None
        for number, found in pieces(block, SHINGLE_WORDS - 1):
            total = number + len(found.hash)
            each.append(np.unique(sequence_hash(found.hash, SHINGLE_WORDS)))
        # a text of few, huge words: the last piece has them all
        hashes = sequence_hash(found.hash, total) if 0 < total < SHINGLE_WORDS else np.unique(np.concatenate(each))
        return hashes, np.array([0, len(hashes)])
    hashes, first = shingles(block)
    row = np.repeat(np.arange(block.rows), np.diff(first))
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    hashes, row = hashes[new], row[new]
    return hashes, np.searchsorted(row, np.arange(block.rows + 1))


def set_keys(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of every row's set: sums over its members, differently mixed."""
    n = np.diff(first).astype(np.uint64)
    out = []
    for seed in (np.uint64(0), np.uint64(0xC2B2AE3D27D4EB4F)):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes ^ seed))])
        out.append(mix((total[first[1:]] - total[first[:-1]]) ^ n).view(np.int64))
    return out[0], out[1]


def signatures(hashes: np.ndarray, first: np.ndarray, size: int = TREES * DEPTH, seed: int = 3) -> np.ndarray:
    """Min-hashes (rows x size), each cut to 16 bits; rows without shingles get zeros."""
    rng = np.random.default_rng(seed)
    factor = rng.integers(0, 1 << 32, size, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    flip = rng.integers(0, 1 << 32, size, dtype=np.uint64).astype(np.uint32)
    some = np.flatnonzero(np.diff(first))
    out = np.zeros((len(first) - 1, size), np.uint16)
    if len(some):
        short = (hashes >> np.uint64(32)).astype(np.uint32)
        for k in range(size):
            least = np.minimum.reduceat((short ^ flip[k]) * factor[k], first[some])
            out[some, k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def document_signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id, hashes of row, text and set, n (distinct shingles), signature (two bytes a min-hash)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    given = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    given = given.select("id", "text", *row_keys(F.col("id"), F.col("text")), F.xxhash64("text").alias("text_hash"))
    carried = ["id", "row_hash", "row_check", "text_hash"]
    made = ["set_hash", "set_check", "n"]
    schema = T.StructType([*(given.schema[c] for c in carried), *(T.StructField(c, T.LongType()) for c in made), T.StructField("signature", T.BinaryType())])

    def run(batches):
        for batch in batches:
            for block in blocks(batch.column("text")):
                hashes, first = shingle_sets(block)
                part = batch.slice(block.first, block.rows)
                own = [*map(pa.array, set_keys(hashes, first)), pa.array(np.diff(first), pa.int64()), fixed(signatures(hashes, first))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), *own], names=schema.names)

    return given.mapInArrow(run, schema)


def row_keys(row_id: F.Column, text: F.Column) -> list[F.Column]:
    """128 bits that stand for a row's id and text."""
    return [F.xxhash64(text, row_id).alias("row_hash"), F.xxhash64(F.lit(7), text, row_id).alias("row_check")]


def fixed(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values of one size."""
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of ``fixed`` again, as 16-bit numbers."""
    return np.frombuffer(string_buffers(column)[0].tobytes(), np.uint16).reshape(-1, width)


SET = ["set_hash", "set_check", "n"]


def representatives(signed: DataFrame) -> DataFrame:
    """One row per distinct shingle set: number (unique), a text hash, copies, first_doc, signature."""
    sets = signed.where(F.col("n") > 0).groupBy(*SET)
    found = sets.agg(F.min("text_hash").alias("text_hash"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("first_doc"), F.first("signature").alias("signature"))
    return found.withColumn("rep", F.monotonically_increasing_id())


def blocks_of(members: F.Column) -> F.Column:
    """How many blocks a group is cut into: powers of two, so that the same rows share blocks in the nodes of most trees."""
    return F.when(members <= BLOCK, 1).otherwise(F.pow(F.lit(2), F.ceil(F.log2(members / BLOCK)))).cast("int")


def block_pairs(block, count) -> F.Column:
    """All unordered pairs (i, j) of blocks that ``block`` belongs to."""
    other = F.sequence(F.lit(0), count - 1)
    return F.explode(F.transform(other, lambda o: F.struct(F.least(o, block).alias("i"), F.greatest(o, block).alias("j"))))


def runs(batches, keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The stretches of equal keys of sorted batches, one at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [*np.flatnonzero(change).tolist(), batch.num_rows]
        at = 0
        for cut in cuts:
            key = tuple(c[at] for c in columns)
            if held and key != last:
                yield _joined(held)
                held = []
            held.append(batch.slice(at, cut - at))
            last, at = key, cut
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def forest_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least member of each item's component, for a few hundred items."""
    root = np.arange(n)
    while len(left):
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def pair_roots(n: int, left: np.ndarray, right: np.ndarray, block: np.ndarray, inner: bool) -> np.ndarray:
    """Roots to report for a block pair.

    A block with itself reports each member's root.  Two different blocks report
    only how the components of one meet those of the other, at one member each:
    their own members are connected by the report of their own block.
    """
    if inner:
        return forest_roots(n, left, right)
    same = block[left] == block[right]
    own = forest_roots(n, left[same], right[same])
    return forest_roots(n, own[left[~same]], own[right[~same]])


def _flush(rows: list[list[np.ndarray]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in rows], names=names)


TRIE = "rep long, tree int, depth int, node long, size long, open boolean, head boolean"


def trie_stretches(tree: np.ndarray, label: np.ndarray, crowded: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The nodes in a stretch of sorted labels, as (depth, rows, node hash, size here, open).

    A node is open if it reaches the first or the last row, as it may go on
    beyond.  A node whose parent is not crowded is left out, as the parent has all
    its members; so are nodes of one row that aren't open.
    """
    n = len(tree)
    same = np.cumprod(label[1:] == label[:-1], axis=1, dtype=np.uint8).sum(axis=1) * (tree[1:] == tree[:-1])
    key = mix(tree.astype(np.uint64) + np.uint64(1))
    parent = np.ones(n, bool)
    for depth in range(1, DEPTH + 1):
        key = mix(key ^ label[:, depth - 1].astype(np.uint64))
        if depth < LEAST_DEPTH:
            continue
        run = np.concatenate([[0], np.cumsum(same < depth)])
        size = np.bincount(run)[run]
        open_ = (run == 0) | (run == run[-1])
        rows = np.flatnonzero(parent & ((size > 1) | open_))
        yield depth, rows, key[rows], size[rows], open_[rows]
        parent = (size > crowded) | open_


def sorted_tries(reps: DataFrame, scratch: Scratch) -> DataFrame:
    """rep, tree, depth, node and size: the nodes that a representative shares with another, by tree and depth."""
    crowded = BLOCK
    trees = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    labels = reps.select("rep", "signature", trees).select("tree", F.col("signature").substr(F.col("tree") * LABEL + 1, F.lit(LABEL)).alias("label"), "rep")

    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        whole = _joined(parts)
        rep, tree = whole.column("rep").to_numpy(), whole.column("tree").to_numpy()
        for depth, rows, node, size, open_ in trie_stretches(tree, matrix(whole.column("label"), DEPTH), crowded):
            head = np.concatenate([[True], node[1:] != node[:-1]])[: len(rows)] & open_
            columns = [rep[rows], tree[rows], np.full(len(rows), depth, np.int32), node.view(np.int64), size, open_, head]
            for a in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 50_000]) for c in columns], names=["rep", "tree", "depth", "node", "size", "open", "head"])

    laid = scratch.write(labels.repartitionByRange("tree", "label", "rep").sortWithinPartitions("tree", "label", "rep").mapInArrow(run, TRIE), "trie")
    # a partition has at most two open nodes at each depth: a few rows per partition, whatever the data
    cut = laid.where("head").groupBy("node").agg(F.sum("size").alias("whole"))
    closed = laid.where(~F.col("open"))
    joined = laid.where("open").join(F.broadcast(cut), "node").withColumn("size", F.col("whole")).where(F.col("size") > 1)
    columns = ["rep", "tree", "depth", "node", "size"]
    return closed.select(*columns).unionByName(joined.select(*columns))


def asked_nodes(tries: DataFrame, threshold: float, target: float) -> DataFrame:
    """The crowded nodes (node, size) that some member needs.

    Without any node left out a pair at the threshold is missed with chance
    (1 - threshold^LEAST_DEPTH)^TREES.  A representative leaves out its most
    crowded nodes, each adding to that chance what its depth had taken off, as
    long as the recall stays at the target.
    """
    # what matching a tree at this depth takes off, beyond the next longer prefix
    gain = {d: missed(d, threshold) - (missed(d + 1, threshold) if d < DEPTH else 0.0) for d in range(LEAST_DEPTH, DEPTH + 1)}
    table = F.create_map(*(F.lit(x) for d, g in gain.items() for x in (d, g)))
    crowded_first = Window.partitionBy("rep").orderBy(F.desc("size"), "depth", "tree", "node").rowsBetween(Window.unboundedPreceding, 0)
    left = F.lit(TREES * missed(LEAST_DEPTH, threshold)) - F.sum(table[F.col("depth")]).over(crowded_first)
    return tries.withColumn("left", left).where(F.col("left") > math.log(1 - target)).select("node", "size").distinct()


def parts_of(size: F.Column) -> F.Column:
    """How many parts the rows of a node of this size are dealt to in a join."""
    return F.ceil(size / (64 * BLOCK)).cast("int")


def node_members(tries: DataFrame, threshold: float, target: float) -> DataFrame:
    """rep, node, size and low (the least member) for the members of every node that gives candidates.

    Nodes with the same members are one.  Members and node meet by (node, size)
    and a part, so that a large node's rows are dealt over tasks.
    """
    part = F.pmod(F.xxhash64("rep", F.lit(5)), parts_of(F.col("size"))).cast("int").alias("part")
    every = F.explode(F.sequence(F.lit(0), parts_of(F.col("size")) - 1)).alias("part")
    crowded = F.col("size") > BLOCK
    asked = asked_nodes(tries.where(crowded), threshold, target).select("node", "size", every)
    wide = tries.where(crowded).select("rep", "node", "size", part).join(asked, ["node", "size", "part"], "left_semi")
    members = tries.where(~crowded).select("rep", "node", "size", part).unionByName(wide.select("rep", "node", "size", "part"))
    nodes = members.groupBy("node", "size").agg(F.sum(F.xxhash64("rep").bitwiseAND(F.lit((1 << 40) - 1))).alias("all"), F.min("rep").alias("low"))
    chosen = nodes.groupBy("size", "all", "low").agg(F.min("node").alias("node"))
    return members.join(chosen.select("node", "size", "low", every), ["node", "size", "part"]).select("rep", "node", "size", "low")


def near_leaders(nodes: DataFrame, reps: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows of large nodes with ``agree``: in how many min-hashes a member agrees with its node's least representative."""
    crowded = nodes.where(F.col("size") > BLOCK)
    part = F.pmod(F.xxhash64("rep", F.lit(5)), parts_of(F.col("size"))).cast("int").alias("part")
    every = F.explode(F.sequence(F.lit(0), parts_of(F.col("size")) - 1)).alias("part")
    lead = crowded.where(F.col("rep") == F.col("low")).select("node", "size", "low").join(reps.select(F.col("rep").alias("low"), F.col("signature").alias("lead")), "low")
    large = crowded.select("rep", "node", "size", "low", part).join(reps.select("rep", "signature"), "rep")
    both = large.join(lead.select("node", "size", "lead", every), ["node", "size", "part"]).select("node", "size", "low", "rep", "signature", "lead")

    def run(batches):
        for batch in batches:
            own, lead = (matrix(batch.column(c), TREES * DEPTH) for c in ("signature", "lead"))
            kept = ("node", "size", "low", "rep", "signature")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array((own == lead).sum(axis=1), pa.int64())], names=[*kept, "agree"])

    return scratch.write(both.mapInArrow(run, "node long, size long, low long, rep long, signature binary, agree long"), "leaders")


def candidate_edges(nodes: DataFrame, reps: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """Edges a, b between representatives of a node whose signatures may reach the threshold.

    In a large node every member is first compared with one leader and tied to
    it if it is at all near.  Members as near to the leader as the threshold need
    no further comparison there: whatever is within the threshold of them is
    near the leader too (distances add up), and so already tied.  All other
    members are compared pairwise, by pairs of blocks, each giving a spanning forest.
    """
    size = TREES * DEPTH
    led = near_leaders(nodes, reps, scratch)
    ties = led.where((F.col("agree") >= int(LEADER * size)) & (F.col("rep") != F.col("low"))).select(F.col("rep").alias("a"), F.col("low").alias("b"))
    rest = led.where(F.col("agree") < int(threshold * size)).select("node", "rep", "signature")
    left = split_join(rest, rest.groupBy("node").agg(F.count(F.lit(1)).alias("size")), ["node"], "rep")
    small = nodes.where(F.col("size") <= BLOCK).join(reps.select("rep", "signature"), "rep").select("node", "rep", "signature", "size")
    count = blocks_of(F.col("size"))
    block = F.pmod(F.xxhash64("rep", F.lit(7)), count).cast("int")
    own = small.unionByName(left.select("node", "rep", "signature", "size")).select("node", "rep", "signature", block.alias("block"), count.alias("count"))
    pairs = own.select("node", "rep", "signature", "block", block_pairs(F.col("block"), F.col("count")).alias("p")).select("node", "p.i", "p.j", "rep", "signature", "block")
    least = (threshold - SLACK) * size

    def run(batches):
        out: list[list[np.ndarray]] = [[], []]
        held = 0
        for group in runs(batches, ["node", "i", "j"]):
            if group.num_rows < 2:
                continue
            rep = group.column("rep").to_numpy()
            signature = matrix(group.column("signature"), size)
            block = group.column("block").to_numpy()
            inner = group.column("i")[0].as_py() == group.column("j")[0].as_py()
            left, right = [], []
            for a in range(len(rep) - 1):
                near = np.flatnonzero((signature[a + 1 :] == signature[a]).sum(axis=1) >= least) + a + 1
                left.append(np.full(len(near), a))
                right.append(near)
            root = pair_roots(len(rep), np.concatenate(left), np.concatenate(right), block, inner)
            moved = np.flatnonzero(root != np.arange(len(rep)))
            if len(moved):
                out[0].append(rep[moved])
                out[1].append(rep[root[moved]])
                held += len(moved)
            if held > 50_000:
                yield _flush(out, ["a", "b"])
                out, held = [[], []], 0
        if held:
            yield _flush(out, ["a", "b"])

    return pairs.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j", "rep").mapInArrow(run, "a long, b long").unionByName(ties)


def sieve_bits(members: int) -> int:
    """Bits of a sieve with sixteen places a member, two megabytes to sixteen: beyond 8 million it lets more through, and loses nothing."""
    return min(27, max(24, math.ceil(math.log2(16 * max(members, 1)))))


def member_filter(members: DataFrame, column: str, width: int) -> np.ndarray:
    """A bitmap of fixed size over the hashes in ``column``: a first sieve, without false negatives."""

    def run(batches):
        bits = np.zeros(1 << width, bool)
        for batch in batches:
            bits[(batch.column(column).to_numpy().view(np.uint64) >> np.uint64(64 - width)).astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    out = np.zeros(1 << (width - 3), np.uint8)
    for r in members.select(column).repartition(8).mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(r.bits, np.uint8)
    return out


def cluster_sets(docs: DataFrame, clustered: DataFrame, text_col: str = "text") -> DataFrame:
    """rep, cluster, members, copies and the full sorted shingle set of every clustered representative, from the texts again.

    ``clustered`` has those columns, the set's keys and the hash of a text that has the set.
    """
    spark = docs.sparkSession
    width = sieve_bits(clustered.count())
    shared = spark.sparkContext.broadcast(member_filter(clustered, "text_hash", width))

    def run(batches):
        member = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            h = batch.column("text_hash").to_numpy()
            keep = np.flatnonzero(member[(h.view(np.uint64) >> np.uint64(64 - width)).astype(np.int64)])
            # further copies in the same batch say nothing new
            keep = keep[np.sort(np.unique(h[keep], return_index=True)[1])] if len(keep) else keep
            if not len(keep):
                continue
            part = batch.take(pa.array(keep))
            for block in blocks(part.column("text")):
                hashes, first = shingle_sets(block)
                sets = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*map(pa.array, set_keys(hashes, first)), pa.array(np.diff(first), pa.int64()), sets], names=[*SET, "shingles"])

    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).select(F.xxhash64("text").alias("text_hash"), "text")
    found = texts.mapInArrow(run, "set_hash long, set_check long, n long, shingles array<long>")
    # copies are dropped where they are found, before anything is sent
    once = found.groupBy(*SET).agg(F.first("shingles").alias("shingles"))
    return once.join(clustered.drop("text_hash"), SET).select("rep", "cluster", "members", "copies", "shingles")


def to_first_set(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Sets as differences to their cluster's first set (that of the least representative), with the similarity to it."""
    lead = sets.where(F.col("rep") == F.col("cluster")).select("cluster", F.col("shingles").alias("lead"))
    apart = split_join(sets, lead, ["cluster"], "rep", hot_rows=2 * BLOCK).select(
        "cluster", "rep", "members", "copies", F.size("shingles").alias("n"), F.size("lead").alias("n_lead"),
        F.array_except("lead", "shingles").alias("lacks"), F.array_except("shingles", "lead").alias("adds"),
    )
    return scratch.write(apart.withColumn("both", F.col("n_lead") - F.size("lacks")).withColumn("either", F.col("n_lead") + F.size("adds")), "differences")


def banded(apart: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(rows with their blocks to compare, sure links) of the large clusters.

    Rows: own block and the pairs (i, j) to compare, each numbered by band and
    place in the band.  Sure links, one row each: members of bands that are linked
    as a whole, and the tie to the cluster's first set.
    """
    reach = (1 - threshold) / BAND
    wide = apart.where(F.col("members") > BLOCK).withColumn("band", F.floor((1 - F.col("both") / F.col("either")) / BAND).cast("int"))
    bands = wide.groupBy("cluster", "band").agg(F.count(F.lit(1)).alias("rows"), F.sum("copies").alias("weight"))
    # at most one entry per band: 1 / BAND of them
    bands = bands.groupBy("cluster").agg(F.collect_list(F.struct("band", blocks_of(F.col("rows")).alias("blocks"), "weight")).alias("bands"))
    placed = split_join(wide, bands, ["cluster"], "rep", hot_rows=2 * BLOCK)
    sure = lambda b: b["band"] + F.col("band") + 2 <= reach + 1e-9
    open_ = lambda b: ~sure(b) & (F.abs(b["band"] - F.col("band")) - 1 <= reach + 1e-9)
    weight = F.aggregate(F.filter("bands", sure), F.lit(0).cast("long"), lambda s, b: s + b["weight"])
    own_sure = F.when(2 * F.col("band") + 2 <= reach + 1e-9, F.col("copies")).otherwise(0)
    near = F.col("both") >= threshold * F.col("either") - 1e-6
    ties = placed.select("rep", (weight - own_sure).alias("links"), F.when(near, F.col("cluster")).otherwise(F.col("rep")).alias("root")).where((F.col("links") > 0) | (F.col("root") != F.col("rep")))
    number = lambda band, place: band.cast("long") * (1 << 32) + place
    mine = F.filter("bands", lambda b: b["band"] == F.col("band"))[0]["blocks"]
    block = number(F.col("band"), F.pmod(F.xxhash64("rep", F.lit(7)), mine))
    others = F.flatten(F.transform(F.filter("bands", open_), lambda b: F.transform(F.sequence(F.lit(0), b["blocks"] - 1), lambda k: number(b["band"], k))))
    rows = placed.withColumn("block", block).withColumn("others", others)
    pair = F.explode(F.transform("others", lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j"))))
    return rows.withColumn("p", pair), ties


def verified_links(sets: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """rep, links (documents), root, large: what each comparison of blocks says of a representative."""
    apart = to_first_set(sets, scratch)
    small = apart.where(F.col("members") <= BLOCK).withColumn("block", F.lit(0).cast("long"))
    small = small.withColumn("p", F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j")))
    compared, ties = banded(apart, threshold)
    columns = ["cluster", "p", "rep", "copies", "n", "n_lead", "lacks", "adds", "block", (F.col("members") > BLOCK).alias("large")]
    pairs = small.select(*columns).unionByName(compared.select(*columns)).select("cluster", "p.i", "p.j", "rep", "copies", "n", "n_lead", "lacks", "adds", "block", "large")
    names = ["rep", "links", "root", "large"]

    def lists(group, name):
        c = group.column(name)
        return np.repeat(np.arange(len(c)), np.diff(c.offsets.to_numpy())), c.flatten().to_numpy(zero_copy_only=False)

    def overlaps(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """How many values each two rows share."""
        out = np.zeros((n, n), np.float32)
        keys, code, times = np.unique(value, return_inverse=True, return_counts=True)
        often = times > 1
        number = np.cumsum(often) - 1
        keep = often[code]
        row, code, width = row[keep], number[code[keep]], int(often.sum())
        order = np.argsort(code, kind="stable")
        row, code = row[order], code[order]
        step = 4096
        for a in range(0, width, step):
            x, y = np.searchsorted(code, [a, a + step])
            m = np.zeros((n, min(step, width - a)), np.float32)
            m[row[x:y], code[x:y] - a] = 1
            out += m @ m.T
        return out

    def run(batches):
        out: list[list[np.ndarray]] = [[], [], [], []]
        held = 0
        for group in runs(batches, ["cluster", "i", "j"]):
            m = group.num_rows
            if m < 2:
                continue
            rep, copies, n, block = (group.column(c).to_numpy() for c in ("rep", "copies", "n", "block"))
            lacking, lacked = lists(group, "lacks")
            adding, added = lists(group, "adds")
            few = np.bincount(lacking, minlength=m)
            both = group.column("n_lead")[0].as_py() - few[:, None] - few[None, :] + overlaps(lacking, lacked, m) + overlaps(adding, added, m)
            either = n[:, None] + n[None, :] - both
            linked = both >= threshold * either - 1e-6
            np.fill_diagonal(linked, False)
            inner = group.column("i")[0].as_py() == group.column("j")[0].as_py()
            root = pair_roots(m, *np.nonzero(np.triu(linked)), block, inner)
            if not inner:
                linked &= block[:, None] != block[None, :]
            has = np.flatnonzero(linked.any(axis=1) | (root != np.arange(m)))
            if len(has):
                for column, x in zip(out, (rep[has], (linked @ copies)[has].astype(np.int64), rep[root[has]], np.full(len(has), group.column("large")[0].as_py())), strict=True):
                    column.append(x)
                held += len(has)
            if held > 50_000:
                yield _flush(out, names)
                out, held = [[], [], [], []], 0
        if held:
            yield _flush(out, names)

    found = pairs.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "rep").mapInArrow(run, "rep long, links long, root long, large boolean")
    return found.unionByName(ties.withColumn("large", F.lit(True)))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, row_hash, row_check, class_id, n_links, n_shingles, class of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    signed = scratch.write(document_signatures(docs, id_col, text_col), "signed")
    reps = scratch.write(representatives(signed), "representatives")
    nodes = scratch.write(node_members(sorted_tries(reps, scratch), threshold, target), "nodes")
    edges = scratch.write(candidate_edges(nodes, reps, threshold, scratch), "candidates")
    scratch.drop("trie", "nodes", "leaders")
    clusters = components(spark, edges).select(F.col("node").alias("rep"), F.col("label").alias("cluster"))
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"))
    clustered = scratch.write(split_join(clusters, sizes, ["cluster"], "rep").join(reps.select("rep", "copies", "text_hash", *SET), "rep"), "clustered")
    sets = scratch.write(cluster_sets(docs, clustered, text_col), "sets")
    links = scratch.write(verified_links(sets, threshold, scratch), "links")
    scratch.drop("candidates", "clustered", "sets", "differences")
    several = links.where("large")
    classes = links.where(~F.col("large")).select("rep", F.col("root").alias("class"))
    if not several.isEmpty():
        # a block pair's root stands for its other members: edges connect the pairs of a cluster
        classes = classes.unionByName(components(spark, several.select(F.col("rep").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("rep"), F.col("label").alias("class")))
    linked = links.groupBy("rep").agg(F.sum("links").alias("links")).join(classes, "rep", "left")
    known = scratch.write(reps.select(*SET, "rep", "copies", "first_doc").join(linked, "rep", "left").withColumn("class", F.coalesce("class", "rep")), "known")
    scratch.drop("representatives", "links")
    least = known.groupBy("class").agg(F.min("first_doc").alias("class_id"))
    known = split_join(known, least, ["class"], "rep").select(*SET, "class", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    result = split_join(signed.select("id", "row_hash", "row_check", *SET), known, SET, "row_check", "left")
    return result.select(
        F.col("id").alias(id_col),
        "row_hash",
        "row_check",
        F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.col("n").alias("n_shingles"),
        "class",
    )


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class: that of the least id (then row hash); wordless rows stay.  Columns are those of ``docs``."""
    found = near_duplicates(docs, threshold, id_col=id_col, text_col=text_col)
    pick = F.min(F.struct(F.col(id_col).alias("id"), "row_hash", "row_check")).alias("first")
    first = found.where(F.col("class").isNotNull()).groupBy("class").agg(pick).select("first.row_hash", "first.row_check")
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = docs.select(*row_keys(F.col(id_col), text), F.struct("*").alias("row"))
    chosen = whole.join(first, ["row_hash", "row_check"], "left_semi").dropDuplicates(["row_hash", "row_check"])
    wordless = docs.where(~F.translate(text, CAPITALS, SMALL).rlike(WORD_PATTERN))
    return chosen.select("row.*").unionByName(wordless)


def op1_jaccard_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).drop("row_hash", "row_check", "class")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 10 * c >= 8 * (nx.n + ny.n - c)),
r AS (SELECT doc_id AS x, doc_id AS root FROM d UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.x),
k AS (SELECT x, min(root) AS class_id FROM r GROUP BY x), c AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
SELECT d.doc_id, class_id, coalesce(n_links, 0) AS n_links, coalesce(n, 0) AS n_shingles
FROM d JOIN k ON k.x = d.doc_id LEFT JOIN c ON c.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
