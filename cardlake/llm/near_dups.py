"""Near duplicates: SetSketch registers, bands of them as candidates, likelihood estimates, exact confirmation.

A document is its set of distinct word shingles, with A-Z in lower case. Documents are linked when the Jaccard
similarity of their full sets reaches the threshold; groups are the connected components of all links.

1. Every text gets its registers and the digest of its set in one pass. Equal sets are one node, so a group of exact
   copies costs one row from here on, whatever its size.
2. Bands of registers are hashed into buckets. There are so many bands that a pair at the threshold shares none with a
   probability of at most 1e-8. Each node of a bucket is paired with the bucket's smallest node only.
3. A pair goes on unless the joint likelihood of both registers rules the threshold out (about one true pair in 10^8),
   and is confirmed on the full shingle sets, which are made for the nodes of such pairs only, from texts that are
   stored for the nodes that share a bucket.
4. Links give components. Nodes that share buckets, directly or through others, are a cluster; a cluster whose nodes all
   have one component is done, and a large group of near copies ends here. In the others, nodes of different components
   are compared in blocks of bounded size: registers first, then, where these leave the threshold possible, the full
   shingle sets. A block gives only as many links as join its components.

So no group's pairs are listed, and there is no cap on partners or candidates. Empty texts have no shingles
and link with nothing. Rows that repeat an id are one document with the links of all its texts. Rows without an id take
part, but name a group only if nobody else does. Other columns than doc_id and text are not read.
"""

from __future__ import annotations

from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cardlake.llm import sketches
from cardlake.llm.common import ship, stored, text_of

BAND = 4
MISSED = 1e-8
# Nodes without an id have numbers from here on.
UNNAMED = 2**62
# Nodes, and shingles, of a cluster that one task compares with as many others.
BLOCK, BLOCK_SHINGLES = 2048, 2_000_000
TEXT_CHARS = 250_000
SKETCHED = "doc_id bigint, text_key bigint, n_shingles bigint, digest binary, registers binary"


def bands(threshold: float) -> int:
    """Bands of which a pair at the threshold shares at least one, but for a chance of ``MISSED``."""
    return ceil(log(MISSED) / log(1 - threshold**BAND))


def _groups(texts: list[str]):
    """Ranges of texts with a bounded number of characters each."""
    start, size = 0, 0
    for end, text in enumerate(texts, 1):
        size += len(text)
        if size >= TEXT_CHARS or end == len(texts):
            yield start, end
            start, size = end, 0


def sketched(docs: DataFrame, width: int, threshold: float) -> DataFrame:
    """doc_id, text_key, n_shingles, digest and registers of every row; no registers without shingles."""
    ship(docs.sparkSession)
    size = BAND * bands(threshold)
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("registers", pa.binary())])

    def run(batches):
        for batch in batches:
            ids, keys, texts = batch.column("doc_id"), batch.column("text_key"), batch.column("text").to_pylist()
            for start, end in _groups(texts):
                sets = sketches.shingles(texts[start:end], width)
                full = [s for s in sets if len(s)]
                rows = iter(sketches.registers(full, size)) if full else iter(())
                yield pa.RecordBatch.from_arrays([
                    ids.slice(start, end - start), keys.slice(start, end - start),
                    pa.array([len(s) for s in sets], pa.int64()), pa.array([sketches.digest(s) for s in sets], pa.binary()),
                    pa.array([next(rows).tobytes() if len(s) else None for s in sets], pa.binary()),
                ], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text_of("text")).alias("text_key"), text_of("text").alias("text"))
    return rows.mapInArrow(run, SKETCHED)


def _node(doc_id: Column, digest: Column) -> Column:
    return F.coalesce(doc_id, F.shiftrightunsigned(F.xxhash64(digest), 2) + F.lit(UNNAMED))


def _plausible(size: int, threshold: float):
    """Whether the registers of a pair leave the threshold possible."""

    @F.pandas_udf("boolean")
    def plausible(a, b, n_a, n_b):
        import pandas as pd

        if not len(a):
            return pd.Series([], dtype=bool)
        left = np.frombuffer(b"".join(a), np.uint16).reshape(len(a), size)
        right = np.frombuffer(b"".join(b), np.uint16).reshape(len(a), size)
        more, less = (left > right).sum(1), (left < right).sum(1)
        return pd.Series(sketches.estimates(more, less, size, n_a.to_numpy(), n_b.to_numpy(), threshold)[1])

    return plausible


def _near_sizes(n_a: str, n_b: str, percent: int) -> Column:
    return F.lit(100) * F.least(n_a, n_b) >= F.lit(percent) * F.greatest(n_a, n_b)


def _shingle_sets(rows: DataFrame, width: int) -> DataFrame:
    """node, hubs and the sorted shingle hashes of each text of ``rows``."""
    schema = pa.schema([("node", pa.int64()), ("hubs", pa.list_(pa.int64())), ("shingles", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for start, end in _groups(texts):
                sets = sketches.shingles(texts[start:end], width)
                offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(start, end - start), batch.column("hubs").slice(start, end - start).cast(schema.field("hubs").type), lists], schema=schema)

    return rows.select("node", "hubs", "text").mapInArrow(run, "node bigint, hubs array<bigint>, shingles array<bigint>")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (node, hub) whose full shingle sets reach the threshold.

    ``texts`` has the text of every node. A text is read once for all its pairs and goes to the tasks of its hubs;
    a hub with many nodes is split by the adaptive join.
    """
    routes = pairs.select("node", "hub").unionByName(pairs.select(F.col("hub").alias("node"), "hub"))
    hubs = routes.groupBy("node").agg(F.collect_set("hub").alias("hubs"))
    sets = stored(_shingle_sets(texts.join(hubs, "node"), width), "shingle-sets")
    sent = sets.select("node", F.explode("hubs").alias("hub"), "shingles")
    centres = sets.filter(F.array_contains("hubs", F.col("node"))).select(F.col("node").alias("hub"), F.col("shingles").alias("hub_shingles"))
    # Equal shingles make the stored sets small on disk, so few tasks would read them; the work is spread by pair.
    both = sent.filter("node <> hub").repartition("node", "hub").join(centres, "hub")
    shared = F.size(F.array_intersect("shingles", "hub_shingles"))
    union = F.size("shingles") + F.size("hub_shingles") - shared
    return both.filter(F.lit(100) * shared >= F.lit(percent) * union).select("node", "hub").distinct()


def _marked(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, stored, with their number and a sum over them, both taken while they are written."""
    seen = Observation("edges")
    counted = edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum"))
    rows = stored(counted, "edges")
    return rows, (seen.get["n"], seen.get["sum"])


def components(links: DataFrame) -> DataFrame:
    """node and root, the smallest node of its component, for every node that has a link.

    Large-star and small-star steps in turn: each hooks neighbours to the smallest one, so that paths shorten by half.
    """
    edges, mark = _marked(links.select(F.col("node").alias("a"), F.col("hub").alias("b")).filter("a <> b"))
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lowest = down.groupBy("a").agg(F.min("b").alias("least"))
        small = (
            down.join(lowest, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
            .unionByName(lowest.select("a", F.col("least").alias("b"))).filter("a <> b").distinct()
        )
        before, (edges, mark) = mark, _marked(small)
        if mark == before:
            break
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return stored(roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), "roots")


class _Sets:
    """Union and find over the components of a block."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        while x in self.parent:
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)


def _between_components(width: int, size: int, percent: int):
    """Per block of a cluster: confirmed links between nodes of different components, as few as join them."""
    schema = pa.schema([("node", pa.int64()), ("hub", pa.int64())])
    threshold = percent / 100
    fewest = sketches.fewest_equal(size, threshold)

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by([("root", "ascending"), ("node", "ascending")]).combine_chunks()
        node, root, chunk, low, high = (group.column(c).to_numpy() for c in ("node", "root", "chunk", "low", "high"))
        table = np.frombuffer(b"".join(group.column("registers").to_pylist()), np.uint16).reshape(len(node), size)
        sets = sketches.shingles(group.column("text").to_pylist(), width)
        n = np.fromiter(map(len, sets), np.int64, len(sets))
        starts = np.cumsum(n) - n
        vocabulary, flat = np.unique(np.concatenate(sets), return_inverse=True)
        inside = np.zeros(len(vocabulary), bool)
        joined, links = _Sets(), []
        cuts = np.append(np.flatnonzero(np.append(True, root[1:] != root[:-1])), len(node))
        for start, end in zip(cuts[:-1], cuts[1:]):
            ours, theirs = np.arange(start, end), np.arange(end, len(node))
            # The smaller side goes row by row against the other.
            rows, others = (ours, theirs) if len(ours) <= len(theirs) else (theirs, ours)
            if not len(others):
                continue
            for i in rows:
                near = others[(table[others] == table[i]).sum(1) >= fewest]
                if low[0] != high[0]:
                    near = near[chunk[near] != chunk[i]]
                near = near[100 * np.minimum(n[near], n[i]) >= percent * np.maximum(n[near], n[i])]
                near = np.array([j for j in near if joined.find(root[j]) != joined.find(root[i])], np.int64)
                if not len(near):
                    continue
                more, less = (table[near] < table[i]).sum(1), (table[near] > table[i]).sum(1)
                near = near[sketches.estimates(more, less, size, np.full(len(near), n[i]), n[near], threshold)[1]]
                inside[flat[starts[i] : starts[i] + n[i]]] = True
                for j in near:
                    if joined.find(root[j]) == joined.find(root[i]):
                        continue
                    shared = int(inside[flat[starts[j] : starts[j] + n[j]]].sum())
                    if 100 * shared >= percent * (n[i] + n[j] - shared):
                        links.append((max(node[i], node[j]), min(node[i], node[j])))
                        joined.join(root[i], root[j])
                inside[flat[starts[i] : starts[i] + n[i]]] = False
        return pa.Table.from_arrays([pa.array([link[k] for link in links], pa.int64()) for k in (0, 1)], schema=schema)

    return compare


def links_between(star: DataFrame, nodes: DataFrame, texts: DataFrame, roots: DataFrame, width: int, size: int, percent: int) -> DataFrame:
    """Links between components whose nodes are joined by shared buckets.

    A cluster is a component of the pairs of bucket and node, confirmed or not: it holds every pair that shares a
    bucket. Nodes of clusters with several components are compared in blocks.
    """
    ship(nodes.sparkSession)
    root_of = lambda key: roots.select(F.col("node").alias(key), F.col("root").alias(f"{key}_root"))
    between = star.join(root_of("node"), "node", "left").join(root_of("hub"), "hub", "left").select(
        F.coalesce("node_root", "node").alias("node"), F.coalesce("hub_root", "hub").alias("hub")
    )
    # Components stand for their nodes, so clusters of one component take no part.
    clusters = components(between.filter("node <> hub").distinct()).select(F.col("node").alias("root"), F.col("root").alias("cluster"))
    named = stored(
        nodes.join(root_of("node"), "node", "left").withColumn("root", F.coalesce("node_root", "node")).join(clusters, "root")
        .select("cluster", "node", "root", "n_shingles", "registers"),
        "clusters",
    )
    mixed = named.groupBy("cluster").agg(F.count(F.lit(1)).alias("nodes"), F.sum("n_shingles").alias("shingles"))
    parts = F.greatest(F.ceil(F.col("nodes") / F.lit(BLOCK)), F.ceil(F.col("shingles") / F.lit(BLOCK_SHINGLES))).cast("long")
    chunked = named.join(mixed.select("cluster", parts.alias("chunks")), "cluster")
    chunked = chunked.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks"))).join(texts, "node")
    # Every pair of chunks of a cluster is a block; a node goes to the blocks of its chunk.
    dealt = chunked.withColumn("partner", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).select(
        "cluster", F.least("chunk", "partner").alias("low"), F.greatest("chunk", "partner").alias("high"),
        "chunk", "node", "root", "registers", "text",
    )
    found = dealt.groupBy("cluster", "low", "high").applyInArrow(_between_components(width, size, percent), "node bigint, hub bigint")
    return found.distinct()


def grouped(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id and kept of every row of ``docs``.

    Links need ``percent`` hundredths of similarity between the sets of ``width``-word shingles.
    """
    threshold, size = percent / 100, BAND * bands(percent / 100)
    rows = sketched(docs, width, threshold).withColumn("node_id", _node(F.col("doc_id"), F.col("digest")))
    rows = stored(rows, "sketches")
    full = rows.filter("n_shingles > 0")
    heads = full.groupBy("digest").agg(F.min("node_id").alias("node"))
    nodes = stored(
        full.join(heads, "digest").filter("node_id = node").dropDuplicates(["node", "digest"])
        .select("node", "digest", "text_key", "n_shingles", "registers"),
        "nodes",
    )
    band = lambda i: F.xxhash64(i, F.substring("registers", i * 2 * BAND + 1, F.lit(2 * BAND)))
    numbers = F.sequence(F.lit(0), F.lit(bands(threshold) - 1))
    keys = nodes.select("node", F.explode(F.transform(numbers, band)).alias("key"))
    buckets = keys.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).filter("hub <> last")
    members = stored(keys.join(buckets.select("key", "hub"), "key"), "members")
    # Only nodes that share a bucket are ever paired; their texts are stored once for all rounds. The text of a node
    # is that of the row with its id and text key.
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text")).withColumn("row_key", F.xxhash64("text"))
    paired = nodes.join(members.select("node").distinct(), "node", "left_semi")
    sources = paired.select("node", "text_key", F.when(F.col("node") < UNNAMED, F.col("node")).alias("source_id"))
    same_row = (F.col("row_key") == F.col("text_key")) & F.col("doc_id").eqNullSafe(F.col("source_id"))
    texts = stored(named.join(sources, same_row).select("node", "text"), "texts")

    star = stored(members.filter("node <> hub").select("node", "hub").distinct(), "star")
    facts = nodes.select("node", "n_shingles", "registers")
    hub_facts = facts.select(F.col("node").alias("hub"), F.col("n_shingles").alias("hub_shingles"), F.col("registers").alias("hub_registers"))
    candidates = star.join(facts, "node").join(hub_facts, "hub").filter(_near_sizes("n_shingles", "hub_shingles", percent))
    pairs = stored(
        candidates.filter(_plausible(size, threshold)("registers", "hub_registers", "n_shingles", "hub_shingles")).select("node", "hub").distinct(), "pairs"
    )
    links = stored(confirmed(pairs, texts, width, percent), "links")
    roots = components(links)
    more = stored(links_between(star, nodes, texts, roots, width, size, percent), "links")
    if not more.isEmpty():
        # The groups so far are stars, so only what joins them takes further steps.
        roots = components(roots.select("node", F.col("root").alias("hub")).unionByName(more))
    of_digest = heads.join(roots, "node", "left").select(F.col("digest").alias("of_digest"), F.coalesce("root", "node").alias("root"))
    joined = rows.join(of_digest, F.col("digest") == F.col("of_digest"), "left")
    component = F.coalesce(F.when(F.col("n_shingles") > 0, F.col("root")), F.col("node_id"))
    return joined.select(
        "doc_id", "text_key", "n_shingles", F.when(component < UNNAMED, component).alias("component_id"),
        (F.col("node_id") == component).alias("kept"),
    )


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group, that with the smallest id.

    Documents without shingles stay, as they are near nothing.
    """
    kept = grouped(docs, width, percent).filter("kept").select(F.col("doc_id").alias("__llm_id"), F.col("text_key").alias("__llm_key"))
    named = docs.select(*docs.columns, F.xxhash64(text_of("text")).alias("__llm_row_key"))
    rows = named.join(kept.distinct(), F.col("doc_id").cast("long").eqNullSafe(F.col("__llm_id")) & (F.col("__llm_row_key") == F.col("__llm_key")), "left_semi")
    return rows.select(*docs.columns)
