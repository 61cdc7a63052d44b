"""SimHash near-duplicates: fingerprints, shards by exact keys, a BK-tree for each shard, components of the links."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.bktree import BKTree, local_components
from millrace.llm.common import blocks, bucketed, join_spread, list_views, parallelism, row_key, runs, slices, spool
from millrace.llm.components import components

_MASK = (1 << 64) - 1
#: 64-bit words of the fingerprints that stand for a Jaccard similarity.
WIDE = 4


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``width`` words, A-Z lower-cased, joined by a space, repeats included.

    bytes.lower changes A-Z alone, and bytes.split parts at x20 and x09-x0D alone. A text of fewer words gives one
    hash, of all its words; one without words none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    whole, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(whole, 42)], np.uint64)
    ends = list(itertools.accumulate(map(len, words)))
    starts = [0, *(e + i for i, e in enumerate(ends[:-1], 1))]
    stops = [e + i for i, e in enumerate(ends)]
    spans = zip(starts, stops[width - 1 :])  # the last starts have no full run
    return np.fromiter((digest(whole[a:b], 42) for a, b in spans), np.uint64, len(words) - width + 1)


def bit_counts(words: np.ndarray) -> np.ndarray:
    """How many rows of 64-bit words have each bit set."""
    counts = np.zeros(64 * words.shape[1], np.int64)
    for start in range(0, len(words), 255 * 16):
        bits = np.unpackbits(np.ascontiguousarray(words[start : start + 255 * 16]).view(np.uint8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255  # 255 ones are the most that a byte holds
        counts += bits[:whole].reshape(-1, 255, len(counts)).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += bits[whole:].sum(axis=0, dtype=np.uint8)
    return counts


def over_half(counts: np.ndarray, n: int) -> np.ndarray:
    """Words of the bits that are set in over half of ``n`` rows."""
    return np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)


def mixed(hashes: np.ndarray, salt: int) -> np.ndarray:
    """Another hash of each hash."""
    x = hashes ^ np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def block_keys(fingerprint: Column, radius: int = 2) -> Column:
    """Keys of which fingerprints of 64 bits within ``radius`` share at least one.

    The bits are cut into radius + 2 blocks; ``radius`` differing bits leave two blocks untouched, so each pair of
    blocks is a key. Pairs keep the groups of unlike fingerprints small where one block would not.
    """
    blocks = radius + 2
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in itertools.pairwise(edges)]
    pairs = itertools.combinations(parts, 2)
    return F.array(*(F.xxhash64(F.lit(n), x, y) for n, (x, y) in enumerate(pairs)))


def exact_fingerprints(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the 64-bit fingerprint (as a signed long) of each row; a text without words has zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2048):
            hashes = [shingle_hashes(t, width) for t in b.column(1).to_pylist()]
            made = [over_half(bit_counts(h.reshape(-1, 1)), len(h)) for h in hashes]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate([*made, np.empty(0, np.uint64)]).view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, fp bigint"
    )


def word_hashes(text: str | None, known: dict) -> np.ndarray:
    """A 64-bit hash of each word; ``known`` keeps those of short words and is emptied when it grows large."""
    if len(known) > 500_000:
        known.clear()
    words = (text or "").encode().lower().split()
    out = []
    for w in words:
        h = known.get(w)
        if h is None:
            h = xxhash.xxh64_intdigest(w)
            if len(w) < 40:
                known[w] = h
        out.append(h)
    return np.array(out, np.uint64)


def rolled(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` word hashes; of all of them if they are fewer."""
    if not len(words):
        return words
    n = max(1, len(words) - width + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(width, len(words))):
        out = out * np.uint64(0x100000001B3) + words[i : i + n]
    return mixed(out, 0)


def shingle_set(text: str | None, width: int, known: dict) -> np.ndarray:
    """The distinct hashes of the text's shingles, sorted."""
    return np.unique(rolled(word_hashes(text, known), width))


class SetHashes:
    """Fingerprint, keys and name of a set of shingle hashes. A key joins ``rows`` min-hashes of ``bands * rows``."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        draws = mixed(np.arange(1, 1 + WIDE + 2 * bands * rows, dtype=np.uint64), 7)
        self.salts = draws[:WIDE]
        self.xor, self.times = draws[WIDE:].reshape(2, -1, 1)
        self.times = self.times | np.uint64(1)

    def fingerprint(self, shingles: np.ndarray) -> bytes:
        counts = np.zeros(64 * WIDE, np.int64)
        for start in range(0, len(shingles), 1 << 16):
            counts += bit_counts(mixed(shingles[start : start + (1 << 16), None] ^ self.salts, 0))
        return over_half(counts, len(shingles)).tobytes()

    def keys(self, shingles: np.ndarray) -> list[int]:
        least = np.full(self.bands * self.rows, _MASK, np.uint64)
        for start in range(0, len(shingles), 4096):  # hashes are mixed already: a multiplication deals them anew
            part = (shingles[start : start + 4096] ^ self.xor) * self.times
            least = np.minimum(least, part.min(axis=1))
        joined = least.reshape(self.bands, self.rows)
        out = np.arange(self.bands, dtype=np.uint64)
        for r in range(self.rows):
            out = mixed(out ^ joined[:, r], r)
        return out.view(np.int64).tolist()


def similarity_marks(texts: DataFrame, width: int = 5, bands: int = 16, rows: int = 3) -> DataFrame:
    """row, id, node, fp, keys of each row of ``texts`` (row, id, text).

    node names the set of ``width``-word shingles, fp is the SimHash of ``WIDE`` 64-bit words of that set. Sets of
    Jaccard similarity s share one of the ``bands`` keys with probability 1 - (1 - s ** rows) ** bands: all but one in
    100,000 at 0.8 with the defaults. All texts without words are one node.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        of = SetHashes(bands, rows)
        for b in blocks(batches, 2, 8 << 20):
            sets = [shingle_set(t, width, known) for t in b.column(2).to_pylist()]
            nodes = [hashlib.md5(s.tobytes()).digest() for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), b.column(1), pa.array(nodes, pa.binary()), pa.array(list(map(of.fingerprint, sets)), pa.binary()),
                    pa.array(list(map(of.keys, sets)), pa.list_(pa.int64())),
                ],
                ["row", "id", "node", "fp", "keys"],
            )

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("row", "id", "text").mapInArrow(run, f"row binary, id {kind}, node binary, fp binary, keys array<bigint>")


def _fingerprints(column: pa.Array) -> np.ndarray:
    """One row of 64-bit words for each fingerprint."""
    if pa.types.is_integer(column.type):
        return column.to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, 1)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _members(prints: DataFrame) -> DataFrame:
    """key, n, node: the nodes of each key that ``n`` nodes share, two at least; a written table."""
    keyed = spool(prints.select("node", F.explode("keys").alias("key")), "keyed")
    shards = spool(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shards")
    return spool(join_spread(keyed, shards, ["key"], "n", ["node"]).select("key", "n", "node"), "members")


def _dealt(rows: DataFrame, by: str) -> DataFrame:
    """Runs of ``by``, over a fixed number of tasks: the work in them is not in proportion to their bytes."""
    return rows.repartition(parallelism(rows.sparkSession), by).sortWithinPartitions(by)


def near_links(prints: DataFrame, radius: int, unit: int = 1000) -> DataFrame:
    """Links (a, b) between distinct fingerprints that join all within ``radius`` that share a key.

    ``prints`` has distinct fp (long) and their keys. Fingerprints of one key make a shard. A shard of over ``unit`` of
    them is split into trees of about that many, and each tree is searched by its own fingerprints and, one tree's at
    a time, by those of the earlier trees; no task holds a whole shard, and each gives a spanning star of what it
    links, never all the pairs.
    """
    sharded = (
        _members(prints.select(F.col("fp").alias("node"), "keys"))
        .withColumn("trees", F.ceil(F.col("n") / unit).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("trees")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)))
        .withColumn("tree", F.greatest("own", "other"))
        .withColumn("asks", F.least("own", "other"))
        .select(F.xxhash64("key", "tree", "asks").alias("unit"), (F.col("tree") == F.col("own")).alias("in_tree"), "node")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, "unit"):
            nodes = rows.column("node").to_numpy(zero_copy_only=False)
            in_tree = rows.column("in_tree").to_numpy(zero_copy_only=False)
            tree = np.unique(nodes[in_tree])  # two keys of one hash may bring a fingerprint twice
            nodes = np.concatenate([tree, np.setdiff1d(nodes, tree)])
            root = local_components(len(nodes), BKTree(nodes[: len(tree)].view(np.uint64).reshape(-1, 1)).near(nodes.view(np.uint64).reshape(-1, 1), radius))
            linked = np.flatnonzero(root != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(nodes[root[linked]])], ["a", "b"])

    return _dealt(sharded, "unit").mapInArrow(run, "a bigint, b bigint")


def simhash_components(docs: DataFrame, width: int = 3, radius: int = 2, **columns) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row, by 64-bit fingerprints of ``width`` words.

    component_id is the smallest id reachable over fingerprints within ``radius``; null ids are reached but never
    named, so it is null only where every id is. Equal fingerprints are one node, however many rows have them, and
    a fingerprint that many rows have is dealt over many tasks where they learn its component. Null and empty texts
    have fingerprint zero and link like any other. Rows that repeat are returned as often as they stand. Other
    columns are left out, so their names do not matter; an empty table gives an empty one.
    """
    marked = spool(exact_fingerprints(docs, width, **columns), "fingerprints")
    prints = spool(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "prints")
    roots = spool(components(near_links(prints.select("fp", block_keys(F.col("fp"), radius).alias("keys")), radius)), "roots")
    named = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    sizes = spool(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("of_root")), "component-ids")
    final = spool(join_spread(named, sizes, ["root"], "of_root", ["fp"]).select("fp", "n", "component_id"), "named")
    return join_spread(marked, final, ["fp"], "n", ["doc_id"]).select("doc_id", _hex(F.col("fp")).alias("fingerprint"), "component_id")


def _hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def nearest_edges(members: DataFrame, prints: DataFrame, radius: int, unit: int) -> DataFrame:
    """Edges (a, b): for each node the nearest within ``radius`` and one other of those that its keys' trees find.

    A key's nodes are split into trees of about ``unit``, differently for each key. In its tree each node finds the
    nearest of those that stand before it; so the edges are at most two for each node, and hold large groups together.
    """
    trees = F.ceil(F.col("n") / unit).cast("int")
    dealt = members.select(F.xxhash64("key", F.pmod(F.xxhash64("key", "node"), trees)).alias("unit"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, "unit"):
            words, nodes = _fingerprints(rows.column("fp")), rows.column("node")
            found = [np.empty((0, 3), np.int64)]
            for q, at in BKTree(words).near(words, radius):
                q, at = q[at < q], at[at < q]
                d = np.bitwise_count(words[q] ^ words[at]).sum(axis=1, dtype=np.int64)
                order = np.lexsort((at, d, q))
                q, at, d = q[order], at[order], d[order]
                first = np.flatnonzero(np.diff(q, prepend=-1))
                found.append(np.stack([q[first], at[first], d[first]], axis=1))
            q, at, d = np.concatenate(found).T
            yield pa.RecordBatch.from_arrays([nodes.take(pa.array(q)), nodes.take(pa.array(at)), pa.array(d)], ["a", "b", "d"])

    found = _dealt(dealt.join(prints.select("node", "fp"), "node"), "unit").mapInArrow(run, "a binary, b binary, d bigint").where("a <> b")
    best = found.groupBy("a").agg(F.min(F.struct("d", "b"))["b"].alias("near"), F.min(F.struct(F.xxhash64("a", "b").alias("h"), "b"))["b"].alias("other"))
    return best.select("a", F.explode(F.array_distinct(F.array("near", "other"))).alias("b"))


def similar_edges(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``edges`` (a, b) whose ``sets`` (node, shingles) have a Jaccard similarity of ``similarity`` or more."""
    edges = spool(edges, "edges")
    sizes = edges.groupBy("b").agg(F.count("*").alias("n"))
    ends = spool(sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")).join(sizes, "b"), "edge-ends")
    both = join_spread(edges, ends, ["b"], "n", ["a"]).join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return both.where(shared / (F.size("of_a") + F.size("of_b") - shared) >= similarity).select("a", "b")  # unlike sets: not both empty


def other_groups(members: DataFrame, prints: DataFrame, roots: DataFrame, radius: int, unit: int) -> DataFrame:
    """Groups (component, node) in which all pairs of one key within ``radius`` stand whose ``roots`` differ.

    Of a key's nodes those of its commonest root are not compared among themselves: they are in its trees of about
    ``unit`` nodes, which only the others search, ``unit`` of them at a time. A group has at most two units of nodes;
    the same group found by several keys is given once.
    """
    rooted = spool(members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    counts = rooted.groupBy("key", "root").agg(F.count("*").alias("c"))
    parts = counts.groupBy("key").agg(F.max(F.struct("c", "root")).alias("most"), F.sum("c").alias("n"))
    parts = spool(parts.where("most.c < n").select("key", "n", F.col("most.root").alias("major"), (F.col("n") - F.col("most.c")).alias("minors")), "several-roots")
    rows = (
        join_spread(rooted.select("key", "node", "root"), parts, ["key"], "n", ["node"])
        .withColumn("trees", F.ceil(F.col("n") / unit).cast("int"))
        .withColumn("blocks", F.ceil(F.col("minors") / unit).cast("int"))
    )
    own, block = F.pmod(F.xxhash64("node"), F.col("trees")).cast("int"), F.pmod(F.xxhash64(F.lit(1), "node"), F.col("blocks")).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    in_trees = rows.select("key", "node", "root", F.lit(True).alias("in_tree"), own.alias("tree"), upto("blocks").alias("block"))
    askers = rows.where("root <> major").select("key", "node", "root", F.lit(False).alias("in_tree"), upto("trees").alias("tree"), block.alias("block"))
    units = in_trees.unionByName(askers).select(F.xxhash64("key", "tree", "block").alias("unit"), "in_tree", "node", "root")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, "unit"):
            in_tree = rows.column("in_tree").to_numpy(zero_copy_only=False)
            tree, asks = np.flatnonzero(in_tree), np.flatnonzero(~in_tree)
            words, nodes = _fingerprints(rows.column("fp")), rows.column("node").to_pylist()
            root = np.unique(rows.column("root").to_numpy(zero_copy_only=False), return_inverse=True)[1].reshape(-1)
            hits = ((asks[q], tree[at]) for q, at in BKTree(words[tree]).near(words[asks], radius))
            unlike = ((a[root[a] != root[b]], b[root[a] != root[b]]) for a, b in hits)
            inside: dict[int, set[bytes]] = {}
            for node, r in zip(nodes, local_components(len(nodes), unlike).tolist(), strict=True):
                inside.setdefault(r, set()).add(node)
            groups = [sorted(g) for g in inside.values() if len(g) > 1]
            names = [hashlib.md5(b"".join(g)).digest() for g in groups for _ in g]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.binary()), pa.array([n for g in groups for n in g], pa.binary())], ["component", "node"]
            )

    return _dealt(units.join(prints.select("node", "fp"), "node"), "unit").mapInArrow(run, "component binary, node binary").distinct()


def exact_roots(prints: np.ndarray, sets: list[np.ndarray], root: np.ndarray, radius: int, similarity: float) -> np.ndarray:
    """The first row of each row's component over pairs whose sets have a Jaccard similarity of ``similarity`` or more.

    ``root`` says what is joined before. Pairs beyond ``radius`` are left aside, and those that are joined already;
    the nearest are compared first.
    """
    size = np.array([len(s) for s in sets])
    root = root.copy()
    for i in range(1, len(sets)):
        d = np.bitwise_count(prints[:i] ^ prints[i]).sum(axis=1, dtype=np.int64)
        fits = np.minimum(size[:i], size[i]) >= similarity * np.maximum(size[:i], size[i]) - 1e-6
        left = ((d <= radius) & fits & (root[:i] != root[i])).nonzero()[0]
        left = left[np.argsort(d[left], kind="stable")]
        while len(left):
            j, left = left[0], left[1:]
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both / (size[i] + size[j] - both) >= similarity:
                low, high = sorted((root[i], root[j]))
                root[root == high] = low
                left = left[root[left] != root[i]]
    return root


def exact_links(groups: DataFrame, sets: DataFrame, radius: int, similarity: float) -> DataFrame:
    """Links (a, b) that join the nodes of each group (component, node) whose ``sets`` (node, fp, root, shingles) are near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(slices(batches), "component"):
            nodes = rows.column("node")
            _, first, root = np.unique(rows.column("root").to_numpy(zero_copy_only=False), return_index=True, return_inverse=True)
            before = first[root.reshape(-1)]
            sets = list_views(rows.column("shingles"))
            after = exact_roots(_fingerprints(rows.column("fp")), sets, before, radius, similarity)
            a = np.flatnonzero(after != before)
            yield pa.RecordBatch.from_arrays([nodes.take(pa.array(a)), nodes.take(pa.array(after[a]))], ["a", "b"])

    return _dealt(groups.join(sets, "node").select("component", "node", "fp", "root", "shingles"), "component").mapInArrow(run, "a binary, b binary")


def keep_one_of_each(
    docs: DataFrame, radius: int = 80, width: int = 5, similarity: float = 0.8, unit: int = 300, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with one row for each group of near copies: the one with the smallest id.

    Near copies are texts whose sets of ``width``-word shingles have a Jaccard similarity of ``similarity`` or more,
    and what these link. Candidates share a key of min-hashes and are found in BK-trees within ``radius`` of the 256
    bits; their sets are then compared. At 0.8, 39 differing bits are expected with a standard deviation of 6, and 48
    and 6 at worst, for sets of 4 and 5 shingles; the radius lies five deviations beyond. Equal sets are one node,
    however many rows have them. Near neighbours are compared first; then only pairs that these have not joined, so a
    large group costs what its size does. Rows with a null id stay only where their whole group has none, one of each;
    of rows with equal id and text one stays. All columns of ``docs`` come back as they are, whatever their names. An
    empty table gives an empty one.
    """
    key = row_key(F.col(id_col), F.col(text_col))
    whole = bucketed(docs.select(key.alias("row"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")), "near_texts", "row")
    texts = whole.select("row", F.col("doc").getField(id_col).alias("id"), F.col("doc").getField(text_col).alias("text"))
    marked = spool(similarity_marks(texts, width), "marked")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    prints = marked.groupBy("node").agg(F.min(order).alias("best"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    prints = spool(prints, "prints")  # fp and keys follow from the set that node names
    members = _members(prints)

    asked = prints.select("node", F.col("best.row").alias("row")).join(members.select("node").distinct(), "node")
    texts = texts.select("row", "text").join(asked.hint("merge"), "row").dropDuplicates(["row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in blocks(batches, 1, 4 << 20):
            made = [shingle_set(t, width, known).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.list_(pa.int64()))], ["node", "shingles"])

    sets = spool(texts.select("node", "text").mapInArrow(run, "node binary, shingles array<bigint>"), "candidate-sets")
    links = spool(similar_edges(nearest_edges(members, prints, radius, unit), sets, similarity), "near-links")
    roots = spool(components(links), "near-roots")
    groups = spool(other_groups(members, prints, roots, radius, unit), "groups")
    rooted = sets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(prints.select("node", "fp"), "node")
    links = links.unionByName(exact_links(groups, rooted, radius, similarity))
    # links join the first nodes of two roots, which the near links have joined to the rest
    final = spool(components(links), "roots")
    best = prints.select("node", "best").join(final, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best"))
    best = best.select(F.col("best.row").alias("row"))
    return whole.join(best.hint("merge"), "row", "left_semi").dropDuplicates(["row"]).select(*(F.col("doc").getField(c).alias(c) for c in docs.columns))
