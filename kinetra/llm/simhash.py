"""SimHash near-duplicates with covering locality-sensitive hashing.

A fingerprint is one or more words of 64 bits. For a radius r, bit i of a word is given a vector m(i) of r + 1 bits, and
table v (a non-zero vector of r + 1 bits) keeps the bits with <m(i), v> odd. The at most r bits in which two words differ set
r linear conditions on v, which leave a non-zero v: in that table none of the differing bits is kept, so the pair collides.
Nothing within the radius is missed, and each table keeps about half of a word's bits, so far pairs rarely meet. Of
fingerprints of n words, some word differs in r bits at most if all differ in (r + 1) n - 1 at most; so those pairs are sure to
collide too, and farther ones often do. Fingerprints that collide are linked if they differ in at most `within` bits.

Documents of equal fingerprints are one node. Collisions are found with one shuffle of (bucket, node): a batch sends one
node for each of its buckets, and gives the others' edges to that node directly, so a bucket that holds a third of all nodes
reaches a task as one row a batch. The nodes of a bucket are compared with the smallest first. Only buckets whose nodes are not
yet one component are compared in full, in blocks: a task compares at most two blocks of `block` nodes and returns the
edges of a spanning forest, never all pairs.

Edge cases: null, empty and wordless texts have fingerprint zero; a null doc_id takes part, and its component is the
smallest id that is not null (null if there is none); repeated rows come back repeated; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, map_arrow, materialize, read, text_key
from .components import connected_components

CHUNK = 1 << 12
_ROWS = 1 << 11


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all."""
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def fingerprint(text: str | None, size: int = 4, words: int = 1, repeats: bool = True) -> np.ndarray:
    """Words of 64 bits; a bit is 1 if it is set in over half of the shingles' hashes, XXH64 (seed 42) in the first word.

    repeats: a shingle counts as often as it occurs, not once.
    """
    split = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not split:
        return np.zeros(words, np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    shingles = zip(*(split[i:] for i in range(size)), strict=False) if len(split) >= size else [split]
    hashes = np.fromiter((digest(join(s), 42) for s in shingles), np.uint64)
    if not repeats:
        hashes = np.unique(hashes)
    ones, others = np.zeros(64 * words, np.int64), np.arange(1, words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK, None]
        part = np.ascontiguousarray(np.hstack([part, _mixed(part + others)])) if words > 1 else part
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
        for i in range(0, len(bits), 255):  # counts that fit a byte
            ones += bits[i : i + 255].sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4, words: int = 1, repeats: bool = True) -> DataFrame:
    """(key, fp): the words of each row's fingerprint as signed longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py(), size, words, repeats) for t in b.column(1)]
            values = pa.array(np.concatenate([*fps, np.empty(0, np.uint64)]).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(fps) + 1, dtype=np.int32) * words), values)], names=["key", "fp"])

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).transform(map_arrow, run, f"key {kind}, fp array<long>")


def covering_masks(radius: int = 4, bits: int = 64) -> list[int]:
    """2^(radius+1) - 1 masks; every two words within the radius agree under one of them."""
    n = (1 << radius + 1) - 1
    return [sum(1 << i for i in range(bits) if ((i % n + 1) & v).bit_count() & 1) for v in range(1, n + 1)]


def _fps(column: pa.Array, words: int) -> np.ndarray:
    """The fingerprints of a column, one in a row."""
    return np.asarray(column.flatten()).view(np.uint64).reshape(-1, words)


def _buckets(words: int, radius: int):
    """From (node, fp): (g, u, v) with u = v for a node in bucket g, and edges u < v of a bucket dealt out by v."""
    masks = np.array(covering_masks(radius), np.uint64)
    salt = _mixed(np.arange(1, words * len(masks) + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, _ROWS):
                part = b.slice(at, _ROWS)
                node, fp = np.asarray(part.column(0)), _fps(part.column(1), words)
                k = _mixed((fp[:, :, None] & masks).reshape(len(fp), -1) ^ salt).view(np.int64).ravel()
                v = np.repeat(node, len(salt))
                order = np.lexsort((v, k))
                k, v = k[order], v[order]
                first = np.append(True, k[1:] != k[:-1])
                u = v[np.flatnonzero(first)[np.cumsum(first) - 1]]
                keep = first | (u != v)
                yield pa.RecordBatch.from_arrays([pa.array(np.where(first, k, _mixed(v.view(np.uint64)).view(np.int64))[keep]), pa.array(k[keep]), pa.array(u[keep]), pa.array(v[keep])], names=["g", "k", "u", "v"])

    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (k, u, v) from the rows of _buckets, sorted by g: those that are edges, and of each bucket's nodes to its first."""
    last_k = head = None
    for b in batches:
        k, u, v = (np.asarray(b.column(i)) for i in (1, 2, 3))
        if not len(k):
            continue
        single = np.flatnonzero(u == v)
        ks, heads = k[single], v[single]
        if len(ks):
            first = np.append(last_k is None or ks[0] != last_k, ks[1:] != ks[:-1])
            starts = np.flatnonzero(first)
            run = np.cumsum(first) - 1
            near = heads[starts[np.maximum(run, 0)]] if len(starts) else heads
            near = np.where(run < 0, head, near) if head is not None else near
            last_k, head = ks[-1], near[-1]
            u = u.copy()
            u[single] = near
        edge = u != v
        yield pa.RecordBatch.from_arrays([pa.array(x[edge]) for x in (k, u, v)], names=["k", "u", "v"])


def _forest(words: int, within: int):
    """Within each group of the sorted rows (g, node, root, fp), edges that join nodes of different roots, at most a forest."""

    def edges(g: np.ndarray, node: np.ndarray, root: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        nodes, at, index = np.unique(node, return_index=True, return_inverse=True)
        _, up = np.unique(root[at], return_inverse=True)  # each node's component, numbered
        fp, us, vs = fp[at], [], []
        links = np.arange(up.max(initial=-1) + 1)
        same = np.arange(len(g))
        for d in range(1, len(g)):  # pairs d places apart; groups are runs of g
            same = same[same + d < len(g)]
            same = same[g[same + d] == g[same]]
            if not len(same):
                break
            a, b = index[same], index[same + d]
            apart = links[up[a]] != links[up[b]]
            a, b = a[apart], b[apart]
            near = np.bitwise_count(fp[a] ^ fp[b]).sum(1, dtype=np.int64) <= within
            merged = False
            for x, y in zip(a[near].tolist(), b[near].tolist(), strict=True):
                rx, ry = up[x], up[y]
                while links[rx] != rx:
                    rx = links[rx]
                while links[ry] != ry:
                    ry = links[ry]
                if rx != ry:
                    links[max(rx, ry)] = min(rx, ry)
                    merged = True
                    us.append(x)
                    vs.append(y)
            while merged:
                flat = links[links]
                merged = bool((flat != links).any())
                links = flat
        return nodes[us], nodes[vs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, words), np.uint64)
        for b in (*batches, None):
            if b is None:
                rows, cut = rest, len(rest[0])
            else:
                now = (*(np.asarray(b.column(i)) for i in range(3)), _fps(b.column(3), words))
                rows = tuple(np.concatenate(x) for x in zip(rest, now, strict=True))
                cut = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0  # the last group may go on
            u, v = edges(*(x[:cut] for x in rows))
            rest = tuple(x[cut:] for x in rows)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def near_components(nodes: DataFrame, words: int = 1, radius: int = 4, within: int = 4, block: int = 2048) -> DataFrame:
    """(node, root) of every linked node of nodes (node long, fp): root is the smallest node that it reaches."""
    rows = nodes.select("node", "fp").transform(map_arrow, _buckets(words, radius), "g long, k long, u long, v long")
    met = materialize(rows.repartition("g").sortWithinPartitions("g", "u", "v").transform(map_arrow, _stars, "k long, u long, v long"))
    apart = sum((F.bit_count(F.col("a")[i].bitwiseXOR(F.col("b")[i])) for i in range(words)), F.lit(0))
    stars = met.select("u", "v").distinct()
    both = stars.join(nodes.select(F.col("node").alias("u"), F.col("fp").alias("a")), "u").join(nodes.select(F.col("node").alias("v"), F.col("fp").alias("b")), "v")
    links = materialize(both.where(apart <= within).select("u", "v"))
    roots = connected_components(links)
    # Buckets whose nodes are not yet one component: their nodes against each other, in pairs of blocks.
    members = met.select("k", F.col("u").alias("node")).union(met.select("k", "v")).distinct()
    mine = materialize(members.join(roots, "node", "left").select("k", "node", F.coalesce("root", "node").alias("root")))
    mixed = materialize(mine.groupBy("k").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low <> high").select("k", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    discard(met)
    if mixed.take(1):
        own = F.pmod(F.xxhash64(F.lit("block"), "node"), F.col("blocks")).cast("int")
        other = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("own")))
        dealt = mine.join(mixed, "k").withColumn("own", own).withColumn("other", F.explode(other))
        dealt = dealt.select(F.xxhash64("k", F.least("own", "other"), F.greatest("own", "other")).alias("g"), "node", "root")
        dealt = dealt.join(nodes.select("node", "fp"), "node").select("g", "node", "root", "fp")
        more = materialize(dealt.repartition("g").sortWithinPartitions("g", "node").transform(map_arrow, _forest(words, within), "u long, v long"))
        discard(roots)
        roots = connected_components(links.union(more))
        discard(more)
    discard(links, mine, mixed)
    return roots


def simhash_groups(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 4, size: int = 4, words: int = 1, within: int | None = None, repeats: bool = True) -> DataFrame:
    """(key, fp, component): component is the smallest key among the documents reachable by links; within: radius if None.

    Nodes are fingerprints; those of several words are told apart by a hash of 64 bits.
    """
    prints = fingerprints(df, key, text, size, words, repeats)
    prints = materialize(prints.select("key", "fp", (F.col("fp")[0] if words == 1 else F.xxhash64("fp")).alias("node")))
    nodes = materialize(prints.groupBy("node").agg(F.min("key").alias("least"), F.first("fp").alias("fp")))
    roots = near_components(nodes, words, radius, radius if within is None else within)
    parts = materialize(nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")))
    # Written before they are joined, so that adaptive execution can split a large group's rows.
    heads = materialize(parts.groupBy("root").agg(F.min("least").alias("component")))
    named = materialize(parts.join(heads, "root").select("node", "component"))
    discard(nodes, roots, parts, heads)
    return prints.join(named, "node").select(F.col("key").alias(key), "fp", "component")


def bits_within(similarity: float, bits: int) -> int:
    """The bits in which fingerprints of two sets of equal size differ on average, at this Jaccard similarity."""
    return int(bits * np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def near_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = 0.8, size: int = 5, words: int = 8, radius: int = 4) -> DataFrame:
    """The rows of df of which one stays for each group: the one of the smallest key. All columns of df come back.

    Linked are texts whose sets of shingles are alike by their fingerprints, at this Jaccard similarity or more: at 0.8, 77 of
    8 * 64 bits or fewer differ, which stands for 0.80 with a deviation of 0.02. Pairs within 39 bits (0.94) are sure to be
    compared; see README for how many of the others are. A row without a key goes by its text, and stays only if its group
    has no row with one; of repeated rows one stays.
    """
    named = df.withColumn("_kx_key", F.struct(F.col(key).isNull().alias("no_key"), F.col(key).alias("key"), text_key(F.col(text)).alias("tk")))
    groups = simhash_groups(named, "_kx_key", text, radius, size, words, bits_within(similarity, 64 * words), repeats=False)
    heads = groups.where(F.col("_kx_key") == F.col("component")).groupBy("_kx_key").agg(F.count("*").alias("_kx_rows"))
    kept = named.join(heads, "_kx_key")
    # Only keys of several rows are numbered, so that most texts are shuffled once.
    one = Window.partitionBy("_kx_key").orderBy(F.col(text).asc_nulls_first())
    several = kept.where("_kx_rows > 1").withColumn("_kx_n", F.row_number().over(one)).where("_kx_n = 1")
    return kept.where("_kx_rows = 1").select(*df.columns).union(several.select(*df.columns))


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    g = simhash_groups(read(spark, sf_dir, "documents"))
    return g.select("doc_id", F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
