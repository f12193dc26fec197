"""Sharding by a hierarchical weighted hash tree.

A tree has regions, racks in regions and shards in racks. Each shard has a capacity and a weight from 0 to its capacity; an
absent one has weight 0. For a key, every region draws an exponential variate with its capacity as rate, from a hash of (key,
region). It is the least of the variates of its racks: a weighted hash draw says which rack has it, and the other racks have
it plus a variate of their own; racks hand theirs to shards alike. So every shard's variate is exponential with its capacity
as rate and independent of the others', and depends on the key and the shard's place alone. Divided by weight / capacity it is
the shard's score; the smallest score wins, so a shard wins in proportion to its weight, and a change of one weight moves rows
into or out of that shard only, within the subtrees whose weights change.

The descent looks into a region or rack before it has won only where some weight below is not the capacity: elsewhere the
least score below is the node's own. So a key costs a draw for each region, and those on the way down.

One tree belongs to each shard count: shards fill racks, and racks regions, in order; regular_tree(n) is the same as
regular_tree(n - 1) grown by one, so for law `key` doc_id and shard count decide.

Edge cases: a null key is one key of its own; a null text has size 8 and CRC 0, as an empty one; repeated keys share a shard
and have slots of their own; an empty table gives an empty result; extra columns are ignored by assign_shards, which returns
the columns that it makes and the key only.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import read

SHARDS_PER_RACK, RACKS_PER_REGION = 4, 2


class Leaf(NamedTuple):
    region: str
    rack: str
    shard: int
    weight: float = 1.0
    capacity: float = 1.0


def _region(number: int) -> list[Leaf]:
    """A region of absent shards."""
    racks = range(number * RACKS_PER_REGION, (number + 1) * RACKS_PER_REGION)
    return [Leaf(f"region{number}", f"rack{r}", r * SHARDS_PER_RACK + i, 0.0) for r in racks for i in range(SHARDS_PER_RACK)]


def grow(tree: list[Leaf]) -> list[Leaf]:
    """The tree with its first absent shard present; a new region opens when all are."""
    tree = sorted(tree, key=lambda x: x.shard)
    if all(x.weight for x in tree):
        tree += _region(len(tree) // (SHARDS_PER_RACK * RACKS_PER_REGION))
    at = next(i for i, x in enumerate(tree) if not x.weight)
    tree[at] = tree[at]._replace(weight=tree[at].capacity)
    return tree


def regular_tree(n_shards: int) -> list[Leaf]:
    """The tree of n_shards equal shards."""
    tree: list[Leaf] = []
    for _ in range(n_shards):
        tree = grow(tree)
    return tree


def _uniform(key: Column, *name: Column | str) -> Column:
    """A number in (0, 1) from 48 bits of a hash."""
    parts = [F.lit(x) if isinstance(x, str) else x for x in name]
    return (F.conv(F.substring(F.md5(F.concat(key, F.lit("|"), *parts)), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(16**12))


def _once(value: Column, f) -> Column:
    """f(value), with the value computed once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


class _Node(NamedTuple):
    name: str
    below: list  # of nodes, or one Leaf
    capacity: float
    weight: float
    full: bool


def _nodes(tree: list[Leaf]) -> list[_Node]:
    """The regions, with racks and shards below."""

    def node(name: str, below: list[_Node]) -> _Node:
        return _Node(name, below, sum(x.capacity for x in below), sum(x.weight for x in below), all(x.full for x in below))

    regions: dict[str, dict[str, list[_Node]]] = {}
    for x in tree:
        if not 0 <= x.weight <= x.capacity:
            raise ValueError(f"the weight of shard {x.shard} is not between 0 and its capacity")
        leaf = _Node(f"{x.region}/{x.rack}/{x.shard}", [x], x.capacity, x.weight, x.weight == x.capacity)
        regions.setdefault(x.region, {}).setdefault(x.rack, []).append(leaf)
    return [node(r, [node(f"{r}/{k}", leaves) for k, leaves in racks.items()]) for r, racks in regions.items()]


def _runners(key: Column, node: _Node, score: Column) -> list[tuple[Column, _Node]]:
    """(score, node) of what may win below a node: full nodes as they are, others by what is in them."""
    if not node.weight:
        return []
    if isinstance(node.below[0], Leaf):
        return [(score / (node.weight / node.capacity), node)]
    if node.full:
        return [(score, node)]
    which, out, low = _uniform(key, f"{node.name}?") * node.capacity, [], 0.0
    for kid in node.below:
        own = score - F.log(_uniform(key, kid.name)) / kid.capacity
        out += _runners(key, kid, F.when((which >= low) & (which < low + kid.capacity), score).otherwise(own))
        low += kid.capacity
    return out


def shard_of(key: Column, tree: list[Leaf]) -> Column:
    """Shard of a key: the region of the least score, then the rack and the shard that it comes from."""
    key = F.coalesce(key.cast("string"), F.lit("null"))
    runners = [x for r in _nodes(tree) for x in _runners(key, r, -F.log(_uniform(key, r.name)) / r.capacity)]
    if not runners:
        raise ValueError("no shard has a weight")
    won = F.array_min(F.array(*[F.struct(s.alias("s"), F.lit(i).alias("i")) for i, (s, _) in enumerate(runners)]))["i"]
    # Two more levels below every runner; a shard, or a rack, stands for itself where there is none.
    tops, racks = [], []
    for _, node in runners:
        kids = [node] if isinstance(node.below[0], Leaf) or isinstance(node.below[0].below[0], Leaf) else node.below
        tops.append((node.name, node.capacity, [(k.capacity, len(racks) + i) for i, k in enumerate(kids)]))
        racks += [(k.name, k.capacity, [(x.capacity, x.below[0].shard) for x in ([k] if isinstance(k.below[0], Leaf) else k.below)]) for k in kids]

    def table(rows: list) -> Column:
        def upto(kids: list) -> list[float]:
            return [sum(c for c, _ in kids[: i + 1]) for i in range(len(kids))]

        return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(c)).alias("of"), F.array(*[F.struct(F.lit(u).alias("upto"), F.lit(to).alias("to")) for u, (_, to) in zip(upto(kids), kids, strict=True)]).alias("kids")) for n, c, kids in rows])

    def down(node: Column) -> Column:
        """Of a node's parts the one that has the node's variate; the last one if rounding leaves none."""

        def part(n: Column) -> Column:
            pick = lambda u: F.coalesce(F.get(F.filter(n["kids"], lambda x: u < x["upto"]), F.lit(0)), F.element_at(n["kids"], -1))["to"]
            return _once(_uniform(key, n["name"], F.lit("?")) * n["of"], pick)

        return _once(node, part)

    return down(table(racks)[down(table(tops)[won])]).cast("int")


def assign_shards(df: DataFrame, tree: list[Leaf], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, shard, slot (gapless from 0 in each shard) and grown_shard.

    Slots: rows are dealt to 4096 hash buckets a shard, numbered inside a bucket, and shifted by the rows of the buckets
    before; so no task holds a whole shard, and only the small key column is read twice.
    """
    bytes_ = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    bucket = F.substring(F.md5(F.concat(F.lit("slot|"), F.coalesce(F.col(key).cast("string"), F.lit("null")))), 1, 3)
    rows = df.select(
        F.col(key).alias("key"),
        (F.length(bytes_).cast("long") + 8).alias("size"),
        F.crc32(bytes_).cast("long").alias("crc"),
        shard_of(F.col(key), tree).alias("shard"),
        shard_of(F.col(key), grow(tree)).alias("grown"),
        bucket.alias("bucket"),
    )
    counts = df.select(shard_of(F.col(key), tree).alias("shard"), bucket.alias("bucket")).groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "bucket").orderBy("key", "crc", "size")
    return (
        rows.withColumn("rank", F.row_number().over(inside))
        .join(starts, ["shard", "bucket"])
        .select(
            F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard",
            (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"), F.col("grown").alias("grown_shard"),
        )
    )


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents on 24 shards: 3 regions of 2 racks of 4; the 25th opens a fourth region."""
    return assign_shards(read(spark, sf_dir, "documents"), regular_tree(24))


#: The draws of the same tree in SQL, and the CRC-32 of the polynomial 0xEDB88320, bit by bit.
OP1_SQL = """
WITH ids AS (SELECT DISTINCT doc_id, doc_id::VARCHAR AS k FROM documents),
draws AS (SELECT doc_id, k, n, (('0x' || substr(md5(k || '|' || n), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656 AS u
          FROM ids, (SELECT unnest(['region3', 'region3?', 'region3/rack6', 'region3/rack6?', 'region3/rack6/24']) AS n UNION ALL SELECT 'region' || r FROM range(3) t(r)
                     UNION ALL SELECT 'region' || r || '?' FROM range(3) t(r) UNION ALL SELECT 'region' || (k // 2) || '/rack' || k || '?' FROM range(6) t(k))),
tops AS (SELECT doc_id, arg_min(n, -ln(u) / 8) AS region, min(-ln(u) / 8) AS s FROM draws WHERE n IN ('region0', 'region1', 'region2') GROUP BY 1),
racks AS (SELECT t.doc_id, region, s, substr(region, 7)::INT * 2 + CASE WHEN u * 8 < 4 THEN 0 ELSE 1 END AS rack FROM tops t JOIN draws d ON t.doc_id = d.doc_id AND n = region || '?'),
leaves AS (SELECT r.doc_id, s, rack * 4 + CASE WHEN u * 4 < 1 THEN 0 WHEN u * 4 < 2 THEN 1 WHEN u * 4 < 3 THEN 2 ELSE 3 END AS shard
           FROM racks r JOIN draws d ON r.doc_id = d.doc_id AND n = region || '/rack' || rack || '?'),
news AS (SELECT doc_id, max(-ln(u) / 8) FILTER (n = 'region3')
           + CASE WHEN max(u * 8) FILTER (n = 'region3?') < 4 THEN 0 ELSE max(-ln(u) / 4) FILTER (n = 'region3/rack6') END
           + CASE WHEN max(u * 4) FILTER (n = 'region3/rack6?') < 1 THEN 0 ELSE max(-ln(u)) FILTER (n = 'region3/rack6/24') END AS s FROM draws GROUP BY 1),
placed AS (SELECT l.doc_id, l.shard, CASE WHEN w.s < l.s THEN 24 ELSE l.shard END AS grown FROM leaves l JOIN news w USING (doc_id)),
slices AS (SELECT doc_id, unnest(string_split(trim(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\\1 ', 'g')), ' ')) AS h,
                  generate_subscripts(string_split(trim(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\\1 ', 'g')), ' '), 1) AS i FROM documents),
bytes AS (SELECT doc_id, list(('0x' || h)::BIGINT ORDER BY i) AS b FROM slices WHERE h <> '' GROUP BY 1),
crcs AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x:
           list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) AS crc FROM bytes)
SELECT d.doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, coalesce(crc, 0) AS text_crc32, 'key' AS law, p.shard::INT AS shard,
       row_number() OVER (PARTITION BY p.shard ORDER BY substr(md5('slot|' || d.doc_id), 1, 3), d.doc_id, crc) - 1 AS slot,
       p.grown::INT AS grown_shard
FROM documents d JOIN placed p USING (doc_id) LEFT JOIN crcs USING (doc_id)
"""
