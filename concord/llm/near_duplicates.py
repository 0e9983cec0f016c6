"""MinHash near-duplicates by an LSH forest (operator 4).

1. Each text's set of word shingles is hashed; equal sets become one node, named by their smallest doc_id.
   A node has TREES labels, each of DEPTH 16-bit MinHash values, and a sketch of one bit for each value.
2. Forest: all (tree, label, node) rows are sorted by range, so each tree is one sorted order over many
   partitions, whatever labels are frequent. Nodes with the first LEAST_DEPTH values of a label in common are
   a region. In a region of up to SMALL nodes all are candidates for each other; in a larger one a node's
   candidates are its neighbours by longest common prefix, the next NEAR in sorted order.
   Sketches drop candidates whose similarity is far below the threshold.
3. Candidates are confirmed on full sets of shingle hashes: first each node's BEST by sketch, then what
   still would join two components.
4. Larger regions, and those cut by a partition's end, are gone through again wherever components still
   differ. Nodes outside a region's largest component are compared in full with all of that component, and with each
   other, in blocks whose number grows with the square of theirs, so a region loses no pair by its size. In a
   block, sets whose rarest shingles can't belong to similar sets are passed over (prefix and place
   filters, which are exact), so texts of one template that are not near-duplicates cost little.

Two sets of similarity s share a region in some tree with probability 1 - (1 - s ** LEAST_DEPTH) ** TREES:
0.99997 at 0.8. Of such pairs 0.0000025 differ in more than MOST_BITS bits, in all trees alike; at 0.8 the
two losses together are 0.00003.

Defined cases: null and empty texts and texts without words have no set and no links; rows that repeat a
doc_id get one result each; a null doc_id is linked with nothing and kept; an empty table gives no rows;
other columns are carried along by keep_one() and ignored otherwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm import common, graph

WORDS = 4
THRESHOLD = 80
TREES, DEPTH, LEAST_DEPTH = 20, 8, 4
VALUES = 192
SMALL, NEAR, BEST = 8, 2, 4
#: Bits of a sketch that may differ: at similarity 0.8 a tenth differs on average, 5 deviations more are let through.
MOST_BITS = 40
#: Nodes of one region that are compared as rows of pairs; of more, they are compared in blocks.
PAIRED = 16
#: Shingles and sets of a block: 2 MB.
BLOCK, BLOCK_SETS = 1 << 18, 256
#: Ids that are sent to all executors at most, 16 MB.
FEW_IDS = 1_000_000

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = [int(x) | 1 for x in _RNG.integers(1, 1 << 62, 8, dtype=np.uint64)]
_FACTOR = _RNG.integers(0, 1 << 32, VALUES, dtype=np.uint32) | np.uint32(1)
_SHIFT = _RNG.integers(0, 1 << 32, VALUES, dtype=np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values: every input bit changes about half of the output's."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _positions(n: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word: a sum of its bytes' numbers times their places' numbers, spread."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    starts = np.cumsum(sizes) - sizes
    within = np.arange(len(data)) - np.repeat(starts, sizes)
    terms = _BYTE[data] * _positions(int(sizes.max()))[within]
    return _mix(np.add.reduceat(terms, starts) + sizes.astype(np.uint64))


def shingle_sets(texts: list[str], n: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; memory for a few MB of text at a time."""
    out: list[np.ndarray] = []
    held: list[list[bytes]] = []
    size = 0
    for i, t in enumerate(texts):
        raw = t.encode()
        held.append(raw.lower().split())
        size += len(raw)
        if size >= 1 << 21 or i + 1 == len(texts):
            out += _sets(held, n)
            held, size = [], 0
    return out


def _sets(docs: list[list[bytes]], n: int) -> list[np.ndarray]:
    words = [w for d in docs for w in d]
    if not words:
        return [np.zeros(0, dtype=np.uint64) for _ in docs]
    h = word_hashes(words)
    powers = np.array([pow(_BASE[0], k, 1 << 64) for k in range(n)], dtype=np.uint64)
    rolled = np.zeros(max(len(h) - n + 1, 0), dtype=np.uint64)
    for k in range(n if len(rolled) else 0):
        rolled += h[k : k + len(rolled)] * powers[k]
    rolled = _mix(rolled)
    out, at = [], 0
    for d in docs:
        if len(d) >= n:
            out.append(np.unique(rolled[at : at + len(d) - n + 1]))
        elif d:
            whole = (h[at : at + len(d)] * powers[: len(d)]).sum() ^ np.uint64(_BASE[len(d)])
            out.append(_mix(np.array([whole], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        at += len(d)
    return out


def signature(shingles: np.ndarray) -> tuple[list[bytes], list[int]]:
    """(labels of all trees, sketch as 64-bit integers)."""
    x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    least = np.full(VALUES, 0xFFFFFFFF, dtype=np.uint32)
    for lo in range(0, len(x), 2048):
        np.minimum(least, (x[None, lo : lo + 2048] * _FACTOR[:, None] + _SHIFT[:, None]).min(axis=1), out=least)
    labels = (least[: TREES * DEPTH] * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(">u2").reshape(TREES, DEPTH)
    bits = np.packbits((least * np.uint32(0x85EBCA6B) >> np.uint32(31)).astype(np.uint8))
    return [row.tobytes() for row in labels], bits.view(np.int64).tolist()


SKETCH = [f"s{i}" for i in range(VALUES // 64)]
SIGNED = "doc_id long, text_hash long, set_hash binary, n_shingles long, labels array<binary>, " + ", ".join(f"{s} long" for s in SKETCH)


def _ids_and_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.whole_text(F.col("text")).alias("text"), F.xxhash64(common.whole_text(F.col("text"))).alias("text_hash"))


def sign(docs: DataFrame, words: int) -> DataFrame:
    """SIGNED for every row; set_hash and labels are null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("set_hash", pa.binary()), ("n_shingles", pa.int64()), ("labels", pa.list_(pa.binary()))] + [(s, pa.int64()) for s in SKETCH])
        for batch in batches:
            sets = shingle_sets(batch.column("text").to_pylist(), words)
            hashes = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            signed = [signature(s) if len(s) else (None, [None] * len(SKETCH)) for s in sets]
            columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(hashes, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([x[0] for x in signed], pa.list_(pa.binary()))]
            columns += [pa.array([x[1][k] for x in signed], pa.int64()) for k in range(len(SKETCH))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return _ids_and_texts(docs).mapInArrow(run, SIGNED)


CANDIDATES = "a long, b long, bits int, tree int, label binary, " + ", ".join(f"{s} long" for s in SKETCH)


def forest(nodes: DataFrame) -> DataFrame:
    """Candidate pairs (a, b, bits), and rows (a, tree, label, sketch) of regions to be gone through again (b null). nodes: node, labels, sketch."""
    rows = nodes.select("node", *SKETCH, F.posexplode("labels").alias("tree", "label"))
    ordered = rows.repartitionByRange(common.partitions_for(rows), "tree", "label", "node").sortWithinPartitions("tree", "label", "node")

    def regions(table: pa.Table, first: bool, last: bool) -> pa.Table:
        """Output for rows that hold whole regions, except that the first or the last may have been cut."""
        node, tree = table.column("node").to_numpy(), table.column("tree").to_numpy()
        label = np.frombuffer(b"".join(table.column("label").to_pylist()), dtype=">u8").reshape(len(node), -1)
        sketch = np.column_stack([table.column(s).to_numpy() for s in SKETCH])
        new = np.ones(len(node), dtype=bool)
        new[1:] = (tree[1:] != tree[:-1]) | (label[1:, 0] != label[:-1, 0])
        region = np.cumsum(new) - 1
        n = np.bincount(region)
        large = n[region] > SMALL
        left, right = [], []
        for d in range(1, SMALL):
            i = np.flatnonzero((region[d:] == region[:-d]) & ((d <= NEAR) | ~large[d:])) if len(node) > d else np.zeros(0, dtype=int)
            left.append(i)
            right.append(i + d)
        i, j = np.concatenate(left), np.concatenate(right)
        bits = np.bitwise_count((sketch[i] ^ sketch[j]).view(np.uint64)).sum(axis=1).astype(np.int32)
        good = bits <= MOST_BITS
        i, j, bits = i[good], j[good], bits[good]
        again = large.copy()
        if first:
            again |= region == 0
        if last:
            again |= region == region[-1]
        k = np.flatnonzero(again)
        pairs = pa.table({"a": np.minimum(node[i], node[j]), "b": np.maximum(node[i], node[j]), "bits": bits})
        members = table.take(pa.array(k)).select(["node", "tree", "label", *SKETCH]).rename_columns(["a", "tree", "label", *SKETCH])
        return pa.concat_tables([pairs, members], promote_options="default").select(["a", "b", "bits", "tree", "label", *SKETCH])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, first = 0, True
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < 20_000:
                continue
            table = pa.Table.from_batches(held)
            tree, label = table.column("tree").to_numpy(), table.column("label")
            lo, prefix = table.num_rows - 1, label[-1].as_py()[: 2 * LEAST_DEPTH]
            while lo > 0 and tree[lo - 1] == tree[-1] and label[lo - 1].as_py()[: 2 * LEAST_DEPTH] == prefix:
                lo -= 1
            if lo:  # the last region may go on in the next batch
                yield from regions(table.slice(0, lo), first, False).to_batches()
                first = False
            held, size = table.slice(lo).to_batches(), table.num_rows - lo
        if size:
            yield from regions(pa.Table.from_batches(held), first, True).to_batches()

    return ordered.mapInArrow(scan, CANDIDATES)


def sets_of(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """node, shingles of the documents whose ids are asked for."""
    wanted = ids.select("node").distinct()
    if wanted.count() <= FEW_IDS:
        wanted = F.broadcast(wanted)
    rows = _ids_and_texts(docs)
    rows = rows.join(wanted, rows["doc_id"] == wanted["node"], "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column("text").to_pylist(), words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "shingles"])

    return common.materialize(rows.mapInArrow(run, "node long, shingles array<long>"), "shingle-sets")


def confirm(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold, a percentage."""
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.select("a", "b").join(a, "a").join(b, "b")
    common_size = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - common_size
    return common.materialize(both.where(100 * common_size >= threshold * union).select("a", "b"), "confirmed", "uncompressed")


def _best(pairs: DataFrame) -> DataFrame:
    """Each node's BEST candidates by sketch. A node has at most TREES * SMALL of them."""
    both = pairs.select("a", "b", "bits").union(pairs.select("b", "a", "bits"))
    best = both.groupBy("a").agg(F.slice(F.array_sort(F.collect_list(F.struct("bits", "b"))), 1, BEST).alias("best"))
    return best.select("a", F.explode("best.b").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _across(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    fa, fb = found.select(F.col("node").alias("a"), F.col("component").alias("ca")), found.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    return pairs.join(fa, "a", "left").join(fb, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select(*pairs.columns)


def _bits(x: str, y: str) -> Column:
    total = None
    for s in SKETCH:
        here = F.bit_count(F.col(f"{x}.{s}").bitwiseXOR(F.col(f"{y}.{s}")))
        total = here if total is None else total + here
    return total


def _again(members: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What regions leave to be compared: (a, b) of nodes outside their region's largest component, as sketches
    allow, (node, component) of such nodes with that component, and (tree, region, node, own) of such nodes, with the
    component that each is in, where they are too many for pairs."""
    keyed = members.join(found, members["a"] == found["node"], "left")
    keyed = common.materialize(keyed.select(members["a"], "tree", F.substring("label", 1, 2 * LEAST_DEPTH).alias("region"), *SKETCH, F.coalesce("component", "a").alias("component")), "region-rows")
    sizes = keyed.groupBy("tree", "region", "component").agg(F.count("*").alias("n"))
    regions = sizes.groupBy("tree", "region").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("most"))
    mixed = regions.select("tree", "region", (F.col("n") - F.col("most.n")).alias("others"), F.col("most.component").alias("main")).where("others > 0")
    mixed = _small(common.materialize(mixed.withColumn("few", F.col("others") <= PAIRED), "mixed-regions"))
    others = common.materialize(keyed.join(mixed, ["tree", "region"]).where(F.col("component") != F.col("main")), "region-others")
    x, y = others.where("few").alias("x"), others.where("few").alias("y")
    apart = (F.col("x.component") < F.col("y.component")) & (_bits("x", "y") <= MOST_BITS)
    pairs = x.join(y, (F.col("x.tree") == F.col("y.tree")) & (F.col("x.region") == F.col("y.region")) & apart)
    pairs = pairs.select(F.least("x.a", "y.a").alias("a"), F.greatest("x.a", "y.a").alias("b"))
    mains = others.select(F.col("a").alias("node"), F.col("main").alias("component"))
    many = others.where(~F.col("few")).select("tree", "region", F.col("a").alias("node"), F.col("component").alias("own"))
    return pairs.distinct(), mains.distinct(), many


class Block:
    """Sets that are compared in one task, their members in one order from rare to frequent."""

    def __init__(self, sets: list[np.ndarray], threshold: int) -> None:
        self.threshold = threshold
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        _, place, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(n), dtype=np.int64)
        rank[np.argsort(n, kind="stable")] = np.arange(len(n))
        rank = rank[place]
        self.rank = rank[np.lexsort((rank, owner))]
        self.at = np.arange(len(owner)) - self.starts[owner]
        # Similar sets have a member in common among the first of both, as those after it are too few.
        self.first = self.sizes - -(-threshold * self.sizes // 100) + 1
        self.owner = owner

    def hold(self, lo: int) -> None:
        """Let candidates() look among the sets from lo on."""
        k = np.flatnonzero((self.owner >= lo) & (self.at < self.first[self.owner]))
        k = k[np.argsort(self.rank[k], kind="stable")]
        self.held, self.held_rank = k, self.rank[k]

    def candidates(self, i: int) -> np.ndarray:
        """Held sets whose first common member with set i stands early enough in both."""
        mine = self.rank[self.starts[i] : self.starts[i] + self.first[i]]
        lo, hi = np.searchsorted(self.held_rank, mine, side="left"), np.searchsorted(self.held_rank, mine, side="right")
        n = hi - lo
        k = self.held[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
        sets, earliest = np.unique(self.owner[k], return_index=True)
        left = np.minimum(self.sizes[i] - np.repeat(np.arange(len(mine)), n)[earliest], self.sizes[sets] - self.at[k[earliest]])
        return sets[left * (100 + self.threshold) >= self.threshold * (self.sizes[i] + self.sizes[sets])]

    def similar(self, i: int, sets: np.ndarray) -> np.ndarray:
        """Those of sets that reach the threshold with set i."""
        mine = self.rank[self.starts[i] : self.starts[i] + self.sizes[i]]
        n = self.sizes[sets]
        theirs = self.rank[np.repeat(self.starts[sets] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        hit = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
        both = np.add.reduceat(hit.astype(np.int64), np.cumsum(n) - n)
        return sets[100 * both >= self.threshold * (self.sizes[i] + n - both)]


#: Rows of regions or components that are sent to all executors at most, about 10 MB.
FEW_REGIONS = 100_000


def _small(written: DataFrame) -> DataFrame:
    """A written table, sent to all executors in joins if it has few rows."""
    return F.broadcast(written) if written.count() <= FEW_REGIONS else written


def _parts(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys and the number of blocks that their rows (shingles) make."""
    total = rows.groupBy(*keys).agg(F.sum(F.size("shingles").cast("long")).alias("total"), F.count("*").alias("n"))
    return total.select(*keys, F.ceil(F.greatest(F.col("total") / BLOCK, F.col("n") / BLOCK_SETS)).cast("int").alias(name))


def _within_regions(many: DataFrame, nodes: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) that join all nodes of many (tree, region, node, own) that a chain of similar sets joins within a region.

    A region is dealt into blocks; a task holds two blocks, or one, and keeps one link for each two groups
    that it joins, so no pair of texts is a row. A pair is compared in the first tree that has it in one region; the
    forest or _again() have seen to it if that region is smaller.
    """
    if many.isEmpty():
        return sets.sparkSession.createDataFrame([], "a long, b long")
    roots = F.transform("labels", lambda x: F.substring(x, 1, 2 * LEAST_DEPTH))
    rows = many.join(nodes.select("node", roots.alias("roots")), "node").join(sets, "node")
    rows = rows.join(_small(common.materialize(_parts(rows, ["tree", "region"], "parts"), "region-blocks")), ["tree", "region"]).withColumn("own_part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumns({"p": F.least("own_part", "other_part"), "q": F.greatest("own_part", "other_part")})

    def links(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["own_part", "node"], kind="stable")
        tree, nodes, component = int(group["tree"].iloc[0]), group["node"].to_numpy(), group["own"].to_numpy().copy()
        label = np.frombuffer(b"".join(x for labels in group["roots"] for x in labels), dtype=">u8").reshape(len(nodes), TREES)
        n_left = int((group["own_part"] == group["p"]).sum())
        one = bool(group["p"].iloc[0] == group["q"].iloc[0])
        block = Block(list(group["shingles"]), threshold)
        block.hold(0 if one else n_left)
        out = []
        for i in range(n_left):
            at = block.candidates(i)
            at = at[(component[at] != component[i]) & ~(label[at, :tree] == label[i, :tree]).any(axis=1)]
            for lo in range(0, len(at), 64):
                some = at[lo : lo + 64]
                some = some[component[some] != component[i]]
                for j in block.similar(i, some) if len(some) else ():
                    if component[j] != component[i]:
                        out.append((min(nodes[i], nodes[j]), max(nodes[i], nodes[j])))
                        component[component == component[j]] = component[i]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return common.materialize(rows.groupBy("tree", "region", "p", "q").applyInPandas(links, "a long, b long"), "confirmed", "uncompressed")


def _into_components(wanted: DataFrame, found: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """One link (a, b) for each node of wanted (node, component) and block of the component that holds a similar set.

    Components and the nodes that ask are dealt into blocks; a task holds one block of either, so no pair of texts is a row.
    """
    asking = wanted.join(sets, "node").select("component", "node", "shingles")
    # A component of one node is in no link, so found lacks it: its only member is the node that it is named by.
    members = wanted.select("component").distinct().join(found.select("component", "node"), "component", "left").select("component", F.coalesce("node", "component").alias("node"))
    held = members.join(sets, "node").select("component", "node", "shingles")
    dealt = _small(common.materialize(_parts(asking, ["component"], "asking_parts").join(_parts(held, ["component"], "held_parts"), "component"), "component-blocks"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    left = asking.join(dealt, "component").withColumn("p", own("asking_parts")).withColumn("q", every("held_parts")).select("component", "p", "q", "node", "shingles")
    right = held.join(dealt, "component").withColumn("q", own("held_parts")).withColumn("p", every("asking_parts"))
    right = right.select(F.col("component").alias("c2"), F.col("p").alias("p2"), F.col("q").alias("q2"), F.col("node").alias("member"), F.col("shingles").alias("member_set"))

    def links(asked: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(there):
            nodes = np.concatenate([asked["node"].to_numpy(), there["member"].to_numpy()])
            block = Block([*asked["shingles"], *there["member_set"]], threshold)
            block.hold(len(asked))
            for i in range(len(asked)):
                at = block.candidates(i)
                at = at[nodes[at] != nodes[i]]
                for lo in range(0, len(at), 16):
                    good = block.similar(i, at[lo : lo + 16])
                    if len(good):
                        out.append((min(nodes[i], nodes[good[0]]), max(nodes[i], nodes[good[0]])))
                        break
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    found_links = left.groupBy("component", "p", "q").cogroup(right.groupBy("c2", "p2", "q2")).applyInPandas(links, "a long, b long")
    return common.materialize(found_links, "confirmed", "uncompressed")


@common.finished
def near_duplicates(docs: DataFrame, words: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept for every row of docs."""
    signed = common.materialize(sign(docs, words), "signed")
    sets = signed.where(F.col("set_hash").isNotNull() & F.col("doc_id").isNotNull()).groupBy("set_hash").agg(F.min("doc_id").alias("node"))
    sets = common.materialize(sets, "sets")
    own = signed.join(sets, (signed["set_hash"] == sets["set_hash"]) & (signed["doc_id"] == sets["node"])).select("node", "labels", *SKETCH)
    nodes = common.materialize(own, "nodes")
    candidates = common.materialize(forest(nodes), "candidates")
    pairs = common.materialize(candidates.where(F.col("b").isNotNull() & (F.col("a") != F.col("b"))).groupBy("a", "b").agg(F.min("bits").alias("bits")), "pairs", "uncompressed")
    members = candidates.where(F.col("b").isNull()).drop("b", "bits")
    involved = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(members.select("a"))
    shingles = sets_of(docs, involved, words)
    found = graph.components(confirm(_best(pairs), shingles, threshold))
    found = graph.components(confirm(_across(pairs, found), shingles, threshold), found)
    others, mains, many = _again(members, found)
    links = confirm(others, shingles, threshold).union(_into_components(mains, found, shingles, threshold)).union(_within_regions(many, nodes, shingles, threshold))
    found = graph.components(links, found)
    of_set = sets.join(found, "node", "left").select("set_hash", F.coalesce("component", "node").alias("component_id"))
    rows = signed.select("doc_id", "text_hash", "set_hash", "n_shingles").join(of_set, "set_hash", "left")
    component = F.coalesce("component_id", "doc_id")
    return rows.select("doc_id", "text_hash", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, words: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of docs without those that have a near-duplicate of a smaller doc_id. Rows equal in doc_id and text are one document."""
    return common.without(docs, near_duplicates(docs, words, threshold).where(~F.col("kept")).select("doc_id", "text_hash"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir), WORDS).drop("text_hash")
