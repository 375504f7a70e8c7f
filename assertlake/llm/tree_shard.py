"""Sharding by a hierarchical weighted hash tree, all of it Spark SQL functions. The law is `key`.

A tree is {region: {rack: {shard: weight}}}. Each shard draws -ln(u) / weight for a document, u a hash of the document's
id and the shard in (0, 1). The draw of a rack or region is the least draw below it: such a minimum is itself a weighted draw
with the sum of the weights, so a subtree gets its share. A document descends from the region with the least draw to the rack and to
the shard. A changed weight changes draws of its own subtree only: if it grows, rows move into it, and within
it into the shard that grew; others stay.

slot numbers a shard's rows without gaps, in the order of a hash of id and text: equal rows are counted first, ranges of that hash are summed up
in windows of bounded size, and the counts of the ranges before are added. Then each row of a count takes its own slot, COPIES at a time.

Null doc_id: the key is the text `null`. Null text: size 1, crc32 of nothing. Repeated rows or ids: in one shard, each with its own slot. Texts of
any length. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from assertlake.llm.common import parts, saved

TREE = {region: {rack: {4 * (2 * region + rack) + i: 1.0 for i in range(4)} for rack in (0, 1)} for region in (0, 1)}
GROWN = {region: {rack: dict(TREE[region][rack]) for rack in (0, 1)} for region in (0, 1)}
GROWN[1][1][16] = 1.0
LEVELS = ("region", "rack", "shard")
#: Rows that a numbering window is to hold.
BUCKET_ROWS = 50_000
#: Equal rows that one task numbers.
COPIES = 50_000


def fraction(digits: Column, n_digits: int) -> Column:
    """Hexadecimal digits as a number in (0, 1)."""
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 4 * n_digits)


def draws(tree: dict) -> Column:
    """The shards' draws in the order of the tree, so that a node's shards are a slice. A digest of 64 digits serves 8 shards."""
    shards = [(s, w) for _, racks in sorted(tree.items()) for _, own in sorted(racks.items()) for s, w in sorted(own.items())]
    return F.array(*(-F.log(fraction(F.substring(F.col(f"__digest_{s // 8}"), s % 8 * 8 + 1, 8), 8)) / float(w) for s, w in shards))


def descend(rows: DataFrame, tree: dict, prefix: str = "") -> DataFrame:
    """Adds region, rack and shard: at each level the child with the least draw below the child taken before; ties go to the smaller number."""
    rows = rows.withColumn("__draws", draws(tree))
    at = 0
    nodes: dict[tuple, list[tuple[int, int, int]]] = {}  # path -> (first, number of shards, child)
    for region, racks in sorted(tree.items()):
        begin = at
        for rack, shards in sorted(racks.items()):
            nodes[region, rack] = [(at + i, 1, s) for i, s in enumerate(sorted(shards))]
            nodes.setdefault((region,), []).append((at, len(shards), rack))
            at += len(shards)
        nodes.setdefault((), []).append((begin, at - begin, region))
    pick = lambda children: F.array_min(F.array(*(F.struct(F.array_min(F.slice("__draws", first + 1, n)).alias("draw"), F.lit(child).alias("child")) for first, n, child in children)))["child"]
    for depth, level in enumerate(LEVELS):
        choice = F.lit(None).cast("int")
        for path, children in nodes.items():
            if len(path) == depth:
                here = F.lit(True)
                for k, v in zip(LEVELS, path):
                    here = here & (F.col(prefix + k) == v)
                choice = F.when(here, pick(children)).otherwise(choice)
        rows = rows.withColumn(prefix + level, choice)
    return rows.drop("__draws")


def placed(docs: DataFrame, tree: dict = TREE, grown: dict | None = GROWN) -> DataFrame:
    """doc_id, size, text_crc32, law, region, rack, shard, grown_shard; a row for each row of docs."""
    text, key = F.coalesce("text", F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    most = max(s for t in (tree, grown or tree) for racks in t.values() for shards in racks.values() for s in shards)
    rows = rows.select("*", *(F.sha2(F.concat_ws("|", key, F.lit(str(i))), 256).alias(f"__digest_{i}") for i in range(most // 8 + 1)))
    rows = descend(rows, tree)
    rows = descend(rows, grown, "grown_") if grown else rows.withColumn("grown_shard", F.lit(None).cast("int"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), *LEVELS, "grown_shard")


def sharded(docs: DataFrame, tree: dict = TREE, grown: dict | None = GROWN, bucket_rows: int = BUCKET_ROWS, copies: int = COPIES) -> DataFrame:
    """placed() and slot."""
    n = max(parts(docs.sparkSession, docs), -(-docs.select(F.lit(1)).count() // bucket_rows))
    own = F.concat_ws("|", F.lit("slot"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text_crc32", "size")
    rows = placed(docs, tree, grown)
    rows = saved(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("__n")).withColumn("__at", fraction(F.substring(F.md5(own), 1, 13), 13)), "shard-places")
    rows = rows.withColumn("__bucket", F.floor(F.col("__at") * n).cast("int"))
    before = W.partitionBy("shard").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    sizes = rows.groupBy("shard", "__bucket").agg(F.sum("__n").alias("__rows"))
    sizes = sizes.select("shard", "__bucket", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    inside = W.partitionBy("shard", "__bucket").orderBy("__at", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    first = F.coalesce(F.sum("__n").over(inside), F.lit(0))
    rows = rows.withColumn("__in_bucket", first).join(sizes, ["shard", "__bucket"]).withColumn("__first", F.col("__in_bucket") + F.col("__before"))
    # a row for each run of copies slots; long runs are dealt to several tasks
    runs = F.sequence(F.col("__first"), F.col("__first") + F.col("__n") - 1, F.lit(copies).cast("long"))
    rows = rows.select("*", F.explode(runs).alias("__run"), (F.col("__first") + F.col("__n")).alias("__end"))
    short = rows.where(F.col("__n") <= copies).unionByName(rows.where(F.col("__n") > copies).repartition(n, "__run"))
    slots = F.sequence(F.col("__run"), F.least(F.col("__run") + copies, F.col("__end")) - 1)
    return short.select("doc_id", "size", "text_crc32", "law", "region", "rack", "shard", F.explode(slots).alias("slot"), "grown_shard")


def oracle(tree: dict = TREE, grown: dict = GROWN) -> str:
    """The same in DuckDB's SQL; crc32 goes byte by byte over a table made from its polynomial."""
    values = lambda t: ", ".join(f"({a}, {b}, {s}, {float(w)})" for a, racks in t.items() for b, shards in racks.items() for s, w in shards.items())
    unit = lambda text: f"(('0x' || substr(md5({text}), 1, 13))::BIGINT + 0.5) / 4503599627370496.0"
    leaf = "(('0x' || substr(sha256(k || '|' || (shard // 8)), shard % 8 * 8 + 1, 8))::BIGINT + 0.5) / 4294967296.0"
    return f"""
WITH poly AS (SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b::BIGINT) ORDER BY b) AS t FROM range(0, 256) AS x(b)),
tree(region, rack, shard, weight) AS (VALUES {values(tree)}),
grown(region, rack, shard, weight) AS (VALUES {values(grown)}),
d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(doc_id::VARCHAR, 'null') AS k, coalesce(text, '') AS text FROM documents),
e AS (SELECT row_id, doc_id, k, strlen(text) + 1 AS size,
  xor(list_reduce(list_transform(range(0, strlen(text)), lambda i: ('0x' || substr(hex(encode(text)), 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295), 4294967295) AS text_crc32 FROM d, poly),
s AS (SELECT row_id, arg_min(struct_pack(region := region, rack := rack, shard := shard), -ln({leaf}) / weight) AS node FROM d, tree GROUP BY row_id),
g AS (SELECT row_id, arg_min(shard, -ln({leaf}) / weight) AS grown_shard FROM d, grown GROUP BY row_id)
SELECT doc_id, size, text_crc32, 'key' AS law, node.region, node.rack, node.shard,
  row_number() OVER (PARTITION BY node.shard ORDER BY {unit("'slot|' || k || '|' || text_crc32 || '|' || size")}, doc_id) - 1 AS slot, grown_shard
FROM e JOIN s USING (row_id) JOIN g USING (row_id)
"""
