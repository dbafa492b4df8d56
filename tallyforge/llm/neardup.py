"""Near-duplicate documents by a chosen-path set similarity join.

1. Each text becomes the set of its word shingles. Equal sets form a class, represented by its smallest id; only representatives go on,
   so copies cost nothing further, however many there are.
2. Independent trees branch the representatives: at each level a document goes to the child of the shingle that the level's hash function
   makes the smallest ("minwise token"). Two sets of similarity J share a child with probability J, so they stay together for d levels with J**d.
   A node of at most `leaf` documents, twice as many with every level, is compared exhaustively by sketches and ends there; larger nodes branch on. Which of the sketch's hash functions a
   tree takes, and in which order, is drawn for each tree.
3. Trees are repeated until the target recall is met: documents whose nodes went d levels deep take part in as many trees as make
   1 - (1 - J**d)**trees reach `recall` at the threshold, at least `trees` of them.
4. Sketch-similar pairs, as a spanning forest of each node, are joined to clusters. These are looser than the links: the sketches' margin
   of four standard deviations lets nearly every link through. A node still large at the deepest level is a cluster as a whole.
5. In each cluster the full sets are compared, pairs already known to be connected excepted, and a link counts if
   100 * |intersection| >= percent * |union|. A cluster of more than `cluster` documents or `block` shingles is first dealt by minwise token under each tree, and what
   is then still too large at random beside the document most like the cluster: this connects most of it cheaply. Every two documents that it
   leaves in different components then meet in a pair of blocks: blocks hold sets of like size and at most `block` shingles, each pair of
   blocks is a task of its own, and sets are met by their rarest shingles and counted exactly. No link inside a cluster is missed.
6. Confirmed links are joined to components.

Defined results: a text with words but fewer than a shingle has its whole word sequence as one shingle; null texts and texts without words are linked with
nothing; rows with a null id are dropped; repeated rows are one vertex; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.components import components
from tallyforge.llm.textcore import binary_views, document_words, lean, mix, ngram_hashes, seeds, written


@dataclass(frozen=True)
class NearParams:
    """shingle: words of a shingle. percent: least similarity. slots: hash functions of a sketch. trees: least number of them. levels: most of a tree.
    recall: of pairs at the threshold, at the depth their nodes reach. leaf, cluster: documents compared exhaustively.

    block: shingles of a small cluster, and of a block when what is left of a large cluster is compared exactly.
    broadcast_ids: most cluster members whose ids are broadcast to pick their texts; beyond it they are joined by a shuffle.
    """

    shingle: int = 5
    percent: int = 80
    slots: int = 64
    trees: int = 8
    levels: int = 8
    recall: float = 0.99
    leaf: int = 32
    cluster: int = 1024
    block: int = 1_000_000
    broadcast_ids: int = 1_000_000

    @property
    def sketch_floor(self) -> float:
        j = self.percent / 100
        return j - 4 * (j * (1 - j) / self.slots) ** 0.5

    def trees_for(self, depth: int) -> int:
        """Trees that bring pairs at the threshold together, in nodes that deep, with the target recall."""
        together = (self.percent / 100) ** depth
        return max(self.trees, int(np.ceil(np.log(1 - self.recall) / np.log1p(-together)))) if together < 1 else self.trees

    def leaf_at(self, level: int) -> int:
        """Documents of a node that is not branched further."""
        return min(self.leaf << (level - 1), max(self.leaf, self.cluster))

    def path(self, tree: int) -> list[int]:
        """The hash functions of a tree's levels: no two alike."""
        return np.argsort(mix(seeds(self.slots, 100 + tree)), kind="stable")[: self.levels].tolist()


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    for at, to, words, bounds in document_words(True, column):
        grams = ngram_hashes(words, size)
        for r in range(to - at):
            a, b = int(bounds[r]), int(bounds[r + 1])
            if b - a >= size:
                yield np.unique(grams[a : b - size + 1])
            elif b > a:
                yield ngram_hashes(words[a:b], b - a) ^ np.uint64(b - a)
            else:
                yield np.zeros(0, dtype=np.uint64)


def sketched(documents: DataFrame, params: NearParams) -> DataFrame:
    """doc_id, n_shingles, key (a 128-bit hash of the set), sketch (32 bits for each hash function)."""
    salts = seeds(params.slots, 31)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, sketches = [], [], []
            for s in shingle_sets(batch.column(1), params.shingle):
                sizes.append(len(s))
                if not len(s):
                    keys.append(None)
                    sketches.append(None)
                    continue
                keys.append(np.array([mix(s).sum(dtype=np.uint64), mix(s ^ salts[0]).sum(dtype=np.uint64)]).tobytes())
                low = np.empty(len(salts), dtype="<u4")
                for k, salt in enumerate(salts):
                    low[k] = (((s ^ salt) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).min()
                sketches.append(low.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary())],
                names=["doc_id", "n_shingles", "key", "sketch"],
            )

    rows = documents.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(lean(run), "doc_id long, n_shingles long, key binary, sketch binary")


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by their first columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        new = np.zeros(batch.num_rows, dtype=bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        if held:
            last = [held[-1].column(k)[-1].as_py() for k in range(keys)]
            new[0] = any(c[0] != x for c, x in zip(cols, last))
        cuts = np.flatnonzero(new)
        if not len(cuts):
            held.append(batch)
            continue
        cut = int(cuts[-1])
        if cut:
            held.append(batch.slice(0, cut))
        if held:
            yield pa.Table.from_batches(held)
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """Union-find over what it is asked about."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (r := self.up.get(root, root)) != root:
            root = r
        while (r := self.up.get(x, x)) != root:
            self.up[x], x = root, r
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

    def stars(self) -> pa.RecordBatch:
        """Edges (a, b) from every member of a tree to its smallest."""
        below = list(self.up)
        return pa.RecordBatch.from_arrays([pa.array(below, pa.int64()), pa.array([self.find(x) for x in below], pa.int64())], names=["a", "b"])


def _sketch_edges(params: NearParams):
    """Over rows sorted by node: edges from the documents of a node that pairs of like sketches connect to the smallest of them."""
    width = params.slots
    need = int(np.floor(params.sketch_floor * width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, 2):
            n = table.num_rows
            tree, node = table.column(0).to_numpy(), table.column(1).to_numpy()
            docs = table.column(2).to_numpy()
            sketch = np.stack([s for chunk in table.column(3).chunks for s in binary_views(chunk, "<u4")]).reshape(n, width)
            forest, end = Forest(), np.flatnonzero(np.concatenate([(tree[1:] != tree[:-1]) | (node[1:] != node[:-1]), [True]])) + 1
            group = np.searchsorted(end, np.arange(n), side="right")
            k = 1
            while k < n:
                at = np.flatnonzero(group[:-k] == group[k:])
                if not len(at):
                    break
                for a in range(0, len(at), 1 << 15):
                    part = at[a : a + (1 << 15)]
                    part = part[(sketch[part] == sketch[part + k]).sum(axis=1) >= need]
                    for x, y in zip(docs[part].tolist(), docs[part + k].tolist()):
                        if x != y:
                            forest.join(x, y)
                k += 1
            yield forest.stars()

    return run


def _token(slot: int) -> Column:
    return F.substring("sketch", 4 * slot + 1, 4)


def _leaves(rows: DataFrame, first: int, last: int, params: NearParams) -> tuple[list[DataFrame], DataFrame | None]:
    """The leaves (tree, node, doc_id, depth) of the trees first to last - 1 over rows (doc_id, sketch, most), by level, and edges (a, b) of nodes too large to the end.

    A document takes part in the trees below its `most`. Each level is one write: the nodes of two and more documents with their sizes.
    """
    size = 4
    paths = F.array(*[F.concat(*[_token(slot) for slot in params.path(t)]) for t in range(first, last)])
    trees = rows.select("doc_id", "most", F.posexplode(paths).alias("tree", "tokens")).withColumn("tree", F.col("tree") + first).where(F.col("tree") < F.col("most"))
    now = trees.select("tree", F.xxhash64("tree", F.substring("tokens", 1, size)).alias("node"), "doc_id", "tokens")
    leaves = []
    for level in range(1, params.levels + 1):
        sizes = now.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("hub")).where(F.col("n") > 1)
        nodes = written(now.join(sizes, ["tree", "node"]), "nodes")
        most = params.leaf_at(level)
        leaves.append(nodes.where(F.col("n") <= most).select("tree", "node", "doc_id", F.lit(level).alias("depth")))
        large = nodes.where(F.col("n") > most)
        if level == params.levels:
            return leaves, large.where(F.col("doc_id") != F.col("hub")).select(F.col("doc_id").alias("a"), F.col("hub").alias("b"))
        if large.isEmpty():
            return leaves, None
        now = large.select("tree", F.xxhash64("node", F.substring("tokens", level * size + 1, size)).alias("node"), "doc_id", "tokens")
    return leaves, None


def candidate_edges(reps: DataFrame, params: NearParams) -> DataFrame:
    """Edges (a, b) between representatives (doc_id, sketch) that some node of some tree brought together."""
    start = reps.select("doc_id", "sketch")
    first, last, edges = 0, params.trees, None
    rows = start.withColumn("most", F.lit(params.trees))
    while True:
        leaves, whole = _leaves(rows, first, last, params)
        nodes = leaves[0]
        for more in leaves[1:]:
            nodes = nodes.unionByName(more)
        dealt = nodes.join(start, "doc_id").select("tree", "node", "doc_id", "sketch").repartition("tree", "node").sortWithinPartitions("tree", "node", "doc_id")
        here = dealt.mapInArrow(lean(_sketch_edges(params)), "a long, b long")
        here = here if whole is None else here.unionByName(whole)
        edges = here if edges is None else edges.unionByName(here)
        # Documents that went deep take part in more trees: once more, as many as they need.
        needs = [params.trees_for(level + 1) for level in range(len(leaves))]
        if first or max(needs) <= last:
            return edges
        deep = nodes.where(F.col("depth") > sum(n <= last for n in needs)).groupBy("doc_id").agg(F.max("depth").alias("depth"))
        most = F.element_at(F.array(*[F.lit(n) for n in needs]), F.col("depth"))
        rows = deep.join(start, "doc_id").select("doc_id", "sketch", most.alias("most"))
        first, last = last, max(needs)


def _confirm(params: NearParams):
    """Over rows sorted by part: edges from the documents of a part that links between full sets connect to the smallest of them."""

    def linked(x: np.ndarray, y: np.ndarray) -> bool:
        low, high = min(len(x), len(y)), max(len(x), len(y))
        if 100 * low < params.percent * high:
            return False
        both = np.concatenate([x, y])
        both.sort()
        common = int((both[1:] == both[:-1]).sum())
        return 100 * common >= params.percent * (low + high - common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, 2):
            part = np.stack([table.column(0).to_numpy(), table.column(1).to_numpy()], axis=1)
            docs, sets = table.column(2).to_numpy(), [s for chunk in table.column(3).chunks for s in binary_views(chunk, "<u8")]
            cuts = np.flatnonzero((part[1:] != part[:-1]).any(axis=1)) + 1
            forest = Forest()
            for group in np.split(np.arange(len(docs)), cuts):
                known: list[list[int]] = []  # components so far, as lists of rows
                for i in group.tolist():
                    mine = []
                    for k, members in enumerate(known):
                        hit = next((j for j in members if linked(sets[i], sets[j])), None)
                        if hit is not None:
                            mine.append(k)
                            forest.join(int(docs[i]), int(docs[hit]))
                    merged = [i]
                    for k in reversed(mine):
                        merged = known.pop(k) + merged
                    known.append(merged)
            yield forest.stars()

    return run


def block_pairs(members: DataFrame, bound: int) -> DataFrame:
    """Of members (grp, doc_id, label, size_class, weight) the rows (pair, side, doc_id, label) of pairs of blocks.

    Any two members of a group with different labels, whose classes are at most one apart, meet in a pair; a block alone meets itself. The members of the
    commonest label are not met with one another. A block weighs about `bound`, whatever the group's size.
    """
    labels = members.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("n"))
    most = labels.groupBy("grp").agg(F.max_by("label", F.struct("n", "label")).alias("most"), F.count(F.lit(1)).alias("k")).where(F.col("k") > 1)
    rows = written(members.join(most, "grp").withColumn("rest", F.col("label") != F.col("most")), "blocks")
    key = ["grp", "rest", "size_class"]
    parts = rows.groupBy(*key).agg(F.ceil(F.sum("weight") / bound).cast("int").alias("parts"))
    rows = rows.join(parts, key).withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(9)), F.col("parts")).cast("int"))
    blocks = parts.select(*key, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block"))
    x = blocks.where("rest").select("grp", F.struct("rest", "size_class", "block").alias("x"))
    y = blocks.select("grp", F.struct("rest", "size_class", "block").alias("y"))
    near = F.abs(F.col("x.size_class") - F.col("y.size_class")) <= 1
    pairs = x.join(y, "grp").where(near & (~F.col("y.rest") | (F.col("x") <= F.col("y"))))
    sides = pairs.select("grp", F.xxhash64("grp", "x", "y").alias("pair"), F.posexplode(F.array_distinct(F.array("x", "y"))).alias("side", "own"))
    return rows.join(sides.select("grp", "pair", "side", "own.*"), [*key, "block"]).select("pair", "side", "doc_id", "label")


def _met(docs: np.ndarray, lab: np.ndarray, a: np.ndarray, b: np.ndarray, hits) -> Iterator[tuple[int, int]]:
    """The pairs of rows of a and b that hits(row of a, labels of all rows) finds, as far as they connect labels; lab is changed."""
    for i in a.tolist():
        found = hits(i, lab)
        found = found[lab[found] != lab[i]]
        for j in found[np.unique(lab[found], return_index=True)[1]].tolist():
            yield int(docs[i]), int(docs[j])
            lab[lab == lab[j]] = lab[i]


def _set_hits(sets: list[np.ndarray], b: np.ndarray, percent: int):
    """hits(i, lab): the rows of b with another label whose sets are linked with the i-th."""
    sizes = np.array([len(sets[j]) for j in b.tolist()])
    flat = np.concatenate([sets[j] for j in b.tolist()])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], np.repeat(np.arange(len(b)), sizes)[order]

    def owners(low: np.ndarray, n: np.ndarray) -> np.ndarray:
        return owner[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]

    def hits(i: int, lab: np.ndarray) -> np.ndarray:
        own = sets[i]
        low = np.searchsorted(flat, own, "left")
        n = np.searchsorted(flat, own, "right") - low
        # a linked set has at least percent of this one's shingles, so it holds one of any others and one more: take the rarest
        rare = np.argsort(n, kind="stable")[: len(own) - -(-percent * len(own) // 100) + 1]
        some = np.unique(owners(low[rare], n[rare]))
        some = some[(lab[b[some]] != lab[i]) & (100 * np.minimum(sizes[some], len(own)) >= percent * np.maximum(sizes[some], len(own)))]
        if 4096 * len(some) < n.sum():
            common = np.array([np.isin(sets[j], own, assume_unique=True).sum() for j in b[some].tolist()], dtype=np.int64)
        elif len(some):
            common = np.bincount(owners(low, n), minlength=len(b))[some]
        else:
            return some
        return b[some[100 * common >= percent * (len(own) + sizes[some] - common)]]

    return hits


def _confirm_blocks(params: NearParams):
    """Over rows (pair, side, doc_id, label, shingles) sorted by pair: links that connect different labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, 1):
            pair, side, docs, label = (table.column(k).to_numpy() for k in range(4))
            sets = [s for chunk in table.column(4).chunks for s in binary_views(chunk, "<u8")]
            left, right = [], []
            for group in np.split(np.arange(len(docs)), np.flatnonzero(pair[1:] != pair[:-1]) + 1):
                a, b = group[side[group] == 0], group[side[group] == 1]
                b = b if len(b) else a
                if len(a):
                    for x, y in _met(docs, label.copy(), a, b, _set_hits(sets, b, params.percent)):
                        left.append(x)
                        right.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def _most_alike(rows: DataFrame, params: NearParams) -> DataFrame:
    """doc_id, cluster, fit of rows (doc_id, cluster, sketch): how many of its tokens are the commonest ones of the cluster."""
    slots = F.array(*[_token(k) for k in range(params.slots)])
    tokens = rows.select("doc_id", "cluster", F.posexplode(slots).alias("slot", "token"))
    held = tokens.groupBy("cluster", "slot", "token").agg(F.count(F.lit(1)).alias("n"))
    common = held.groupBy("cluster", "slot").agg(F.max_by("token", F.struct("n", "token")).alias("token"))
    return tokens.join(F.broadcast(common), ["cluster", "slot", "token"]).groupBy("cluster", "doc_id").agg(F.count(F.lit(1)).alias("fit"))


def confirmed_links(documents: DataFrame, reps: DataFrame, clusters: DataFrame, params: NearParams) -> DataFrame:
    """Edges (a, b) that connect what links, confirmed on full sets, connect in each cluster (vertex, component)."""
    members = clusters.select(F.col("vertex").alias("doc_id"), F.col("component").alias("cluster"))
    members = members.unionByName(members.select(F.col("cluster").alias("doc_id"), "cluster").distinct()).join(reps.select("doc_id", "n_shingles"), "doc_id")
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("weight"))
    members = written(members.join(sizes, "cluster"), "clusters")
    is_small = (F.col("n") <= params.cluster) & (F.col("weight") <= params.block)
    small = members.where(is_small).select("doc_id", "cluster", F.lit(0).cast("long").alias("part"), F.lit(1).alias("turn"))
    big = members.where(~is_small)
    parts = small
    if not big.isEmpty():
        in_big = reps.select("doc_id", "sketch").join(big, "doc_id")
        tokens = in_big.select("doc_id", "cluster", "n_shingles", F.posexplode(F.array(*[_token(t) for t in range(params.trees)])).alias("tree", "token"))
        held = tokens.groupBy("cluster", "tree", "token").agg(F.count(F.lit(1)).alias("k"), F.sum("n_shingles").alias("w"))
        split = F.pmod(F.xxhash64("doc_id", "tree"), F.ceil(F.greatest(F.col("k") / params.cluster, F.col("w") / params.block)))
        dealt = tokens.join(held.where(F.col("k") > 1), ["cluster", "tree", "token"]).select("doc_id", "cluster", F.xxhash64("tree", "token", split).alias("part"))
        hubs = _most_alike(in_big, params).groupBy("cluster").agg(F.max_by("doc_id", F.struct("fit", "doc_id")).alias("doc_id"))
        beside = dealt.select("cluster", "part").distinct().join(F.broadcast(hubs), "cluster").withColumn("turn", F.lit(0))
        parts = parts.unionByName(dealt.withColumn("turn", F.lit(1)).unionByName(beside).groupBy("doc_id", "cluster", "part").agg(F.min("turn").alias("turn")))
    wanted = parts
    texts = documents.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    few = members.count() <= params.broadcast_ids
    picked = texts.join(F.broadcast(members.select("doc_id")) if few else members.select("doc_id"), "doc_id", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                own = [s.astype("<u8").tobytes() for s in shingle_sets(some.column(1), params.shingle)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(own, pa.binary())], names=["doc_id", "shingles"])

    full = picked.mapInArrow(lean(sets), "doc_id long, shingles binary")
    dealt = full.join(wanted, "doc_id").select("cluster", "part", "doc_id", "shingles", "turn")
    dealt = dealt.repartition("cluster", "part").sortWithinPartitions("cluster", "part", "turn", "doc_id")
    links = dealt.mapInArrow(lean(_confirm(params)), "a long, b long")
    if big.isEmpty():
        return links
    size = big.select("doc_id", F.col("cluster").alias("grp"), "n_shingles")
    # sets that are linked are in one class of sizes or in neighbouring ones: a class is a little wider than the least ratio of their sizes
    size_class = F.floor(F.log("n_shingles") / float(np.log(100 / params.percent) + 1e-6)).cast("int")
    stars = components(links)
    links = stars.select(F.col("vertex").alias("a"), F.col("component").alias("b"))
    known = stars.select(F.col("vertex").alias("doc_id"), "component")
    rest = size.join(known, "doc_id", "left").select(
        "grp", "doc_id", F.coalesce("component", "doc_id").alias("label"), size_class.alias("size_class"), F.col("n_shingles").alias("weight")
    )
    met = written(block_pairs(rest, params.block), "pairs")
    if met.isEmpty():
        return links
    left = F.broadcast(met.select("doc_id").distinct()) if few else met.select("doc_id")
    across = picked.join(left, "doc_id", "left_semi").mapInArrow(lean(sets), "doc_id long, shingles binary").join(met, "doc_id")
    across = across.select("pair", "side", "doc_id", "label", "shingles").repartition("pair").sortWithinPartitions("pair", "side", "doc_id")
    return links.unionByName(across.mapInArrow(lean(_confirm_blocks(params)), "a long, b long"))


def near_duplicates(documents: DataFrame, params: NearParams = NearParams()) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable over links), kept (whether that is its own)."""
    rows = written(sketched(documents, params), "sketches")
    sound = rows.where(F.col("key").isNotNull())
    classes = sound.groupBy("key").agg(F.min_by(F.struct("doc_id", "sketch", "n_shingles"), "doc_id").alias("r"))
    reps = written(classes.select("r.*", "key"), "classes")
    clusters = components(candidate_edges(reps, params))
    links = confirmed_links(documents, reps, clusters, params)
    found = components(links)
    label = reps.join(found, F.col("doc_id") == F.col("vertex"), "left").select("key", F.coalesce("component", "doc_id").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "key").join(label, "key", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def deduplicated(documents: DataFrame, params: NearParams = NearParams()) -> DataFrame:
    """One document of each component, with the columns they came with: that of the smallest id. Rows with a null id are kept.

    Of rows of one kept id the one with the least text stays, a null text first.
    """
    gone = near_duplicates(documents, params).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    kept = documents.join(gone, documents["doc_id"] == gone["_gone"], "left_anti")
    repeated = documents.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    if repeated.isEmpty():
        return kept
    named = kept.where(F.col("doc_id").isNotNull())
    whole = F.struct(*[F.col(c) for c in kept.columns])
    least = named.groupBy(F.col("doc_id").alias("_id")).agg(F.min_by(whole, F.struct("text", F.xxhash64(F.to_json(whole)))).alias("_row"))
    return least.select("_row.*").unionByName(kept.where(F.col("doc_id").isNull()))
