"""K-d tree sharding: recursive splits at distributed weighted medians of metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, rank_within

#: Bits of a metadata code, of the text's checksum and of the id's hash in a split key.
CODE = 20
KEY_BITS = 3 * CODE


def hashed_code(col: Column) -> Column:
    """A category as a point of the code range; null is a category."""
    return F.shiftright(F.crc32(F.coalesce(col.cast("string"), F.lit("\x00")).cast("binary")), 32 - CODE)


def size_code(size: Column) -> Column:
    """Sizes on a logarithmic scale, so that no long tail makes a dimension wide."""
    return F.least(F.lit((1 << CODE) - 1), F.floor(F.log2(size.cast("double")) * ((1 << CODE) / 48))).cast("long")


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, categories: tuple[str, ...] = ("lang",), slack: float = 0.001, bins: int = 15) -> DataFrame:
    """Deals rows into shards of near equal bytes (UTF-8 bytes of the text plus 16 a row).

    Either ``shards`` or ``target_bytes`` says how many leaves there are. A node takes its widest
    dimension (size, checksum of the text, ``categories``; width against the whole table's) and
    splits at the weighted median, in proportion to the leaves on each side. The median is found by
    histograms of 2**``bins`` bins over all rows, refined within the bin that the target falls
    into until that bin weighs under ``slack`` of a leaf or holds one key; then the nearer side of it is cut. Rows alike in the dimension go by their
    text's checksum, so equal texts stay together where a cut doesn't fall on them, and then by the
    id's hash, so any group can be cut. A level is a few aggregations over a narrow table,
    which is written anew for the next one; the driver sees a row per node. Only built-in functions are used.

    Returns doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard). Null texts are
    empty; null ids and repeated rows are rows like others; an empty table gives no rows.
    """
    if (shards is None) == (target_bytes is None):
        raise ValueError("give either shards or target_bytes")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    meta = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), *[hashed_code(F.col(c)).alias(f"_c{k}") for k, c in enumerate(categories)])
    meta = materialize(meta, "shard-meta")
    content = F.shiftright("text_crc32", 32 - CODE)
    dims = [size_code(F.col("size")), content, *[F.col(f"_c{k}") for k in range(len(categories))]]
    tie = F.shiftleft(content, CODE) + F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(0)), F.lit("shard")), 64 - CODE)
    rows = meta.select("doc_id", "size", "text_crc32", *[d.cast("long").alias(f"_d{k}") for k, d in enumerate(dims)], tie.alias("_tie"), F.lit(0).alias("_node"))
    if target_bytes is not None:
        total = meta.agg(F.sum("size")).head()[0] or 0
        shards = max(1, -(-total // target_bytes))

    def extents(at: DataFrame) -> dict[int, dict]:
        stats = [F.sum("size").alias("w")]
        for d in range(len(dims)):
            stats += [F.min(f"_d{d}").alias(f"lo{d}"), F.max(f"_d{d}").alias(f"hi{d}")]
        return {r["_node"]: r.asDict() for r in at.groupBy("_node").agg(*stats).collect()}  # a row per node

    # A node is (first shard, shards); its id is the first shard.
    nodes, whole = {0: shards}, None
    while any(n > 1 for n in nodes.values()):
        found = extents(rows)
        whole = whole or found.get(0)
        if whole is None:
            break
        width = lambda node, d: (found[node][f"hi{d}"] - found[node][f"lo{d}"]) / max(1, whole[f"hi{d}"] - whole[f"lo{d}"])
        split = {n: max(range(len(dims)), key=lambda d, n=n: width(n, d)) for n, leaves in nodes.items() if leaves > 1 and n in found}
        goal = {n: found[n]["w"] * (nodes[n] // 2) // nodes[n] for n in split}
        leaf = {n: found[n]["w"] / nodes[n] for n in split}
        chosen = F.lit(0).cast("long")
        for d in range(len(dims)):
            chosen = F.when(F.col("_node").isin([n for n in split if split[n] == d]), F.col(f"_d{d}")).otherwise(chosen)
        key = F.shiftleft(chosen, 2 * CODE) + F.col("_tie")
        rows = rows.withColumn("_key", key)
        keyed = rows.where(F.col("_node").isin(list(split))).select("_node", "size", "_key")
        # From each node's lower bound, so many bits are still open, with so much weight below the bound.
        low, below, bits = dict.fromkeys(split, 0), dict.fromkeys(split, 0), KEY_BITS
        active = set(split)
        while bits and active:
            step = min(bins, bits)
            bits -= step
            bound = F.element_at(F.array(*[F.lit(low.get(n, 0) if n in active else -1).cast("long") for n in range(shards)]), F.col("_node") + 1)
            inside = keyed.select("_node", "size", "_key", (F.shiftright("_key", bits) - F.shiftright(bound, bits)).alias("_bin"), bound.alias("_bound")).where(f"_bound >= 0 and _bin >= 0 and _bin < {1 << step}")
            histogram = inside.groupBy("_node", "_bin").agg(F.sum("size").alias("_w"), (F.min("_key") == F.max("_key")).alias("_one"))
            run = Window.partitionBy("_node").orderBy("_bin")
            base = F.element_at(F.array(*[F.lit(below.get(n, 0)).cast("long") for n in range(shards)]), F.col("_node") + 1)
            aim = F.element_at(F.array(*[F.lit(goal.get(n, 0)).cast("long") for n in range(shards)]), F.col("_node") + 1)
            crossing = histogram.withColumn("_to", F.sum("_w").over(run) + base).where((F.col("_to") > aim) & (F.col("_to") - F.col("_w") <= aim))
            for r in crossing.collect():  # a row per node
                n = r["_node"]
                low[n] += r["_bin"] << bits
                below[n] = r["_to"] - r["_w"]
                if r["_w"] <= slack * leaf[n] or r["_one"] or not bits:
                    active.discard(n)
                    if r["_to"] - goal[n] < goal[n] - below[n]:  # the whole bin goes left
                        low[n] += 1 << bits
        cut = F.element_at(F.array(*[F.lit(low.get(n, 1 << 62)).cast("long") for n in range(shards)]), F.col("_node") + 1)
        right = F.element_at(F.array(*[F.lit(nodes[n] // 2 if n in split else 0) for n in range(shards)]), F.col("_node") + 1)
        rows = materialize(rows.withColumn("_node", F.when(F.col("_key") >= cut, F.col("_node") + right).otherwise(F.col("_node")).cast("int")).drop("_key"), "shard-level")
        nodes = {m: k for n, leaves in nodes.items() for m, k in (((n, leaves // 2), (n + leaves // 2, leaves - leaves // 2)) if leaves > 1 else ((n, leaves),))}
    placed = rows.select("doc_id", "size", "text_crc32", F.col("_node").alias("shard"))
    ranked = rank_within(placed, "shard", ["text_crc32", "doc_id"])
    return ranked.select("doc_id", "size", "text_crc32", "shard", F.col("rank").alias("slot"))
