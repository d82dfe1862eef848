"""A Merkle manifest of a table: every row a leaf, one binary tree per group, one tree over the groups' roots.

Every level is a table of nodes. Its self-join on (group, number XOR 1) gives each node its sibling; the rows with an
even number then emit the parents, numbered by half. All groups climb together, each until one node is left. Proofs come
back down the same levels: a node's proof is its sibling followed by its parent's proof, so a level costs one equijoin on
the parent's number, and the texts are read once, for the leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridledger.session import new_work_path

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
DIGEST = 32
#: Proofs are cut from their lineage after this many levels; between, each level is read once.
LEVELS_PER_WRITE = 8


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(fields: list[Column]) -> Column:
    """SHA-256 of the fields, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[field(f) for f in fields]), 256))


def parent_hash(first: Column, second: Column) -> Column:
    """SHA-256 of one or two digests written as lower-case hex."""
    return F.unhex(F.sha2(F.lower(F.concat(F.hex(first), F.coalesce(F.hex(second), F.lit("")))), 256))


def written(rows: DataFrame, label: str) -> DataFrame:
    """The rows, in shared storage from now on."""
    path = new_work_path(rows.sparkSession, f"merkle-{label}")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Adds ``idx``, the row's place in its group by ``order`` from 0, and ``n``, the group's size.

    Rows are ranged over group and order, ties at random, so a hot group is spread over partitions; a partition's places
    are moved by what earlier partitions hold of the group. The partition sizes have one row per partition and per group.
    Rows that tie on all of ``order`` must be equal, or else the caller must not mind which comes first.
    """
    keys = [F.col(c).asc_nulls_first() for c in group + order]
    placed = written(
        rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys, "tie")
        .sortWithinPartitions(*keys, "tie").drop("tie").withColumn("place", F.monotonically_increasing_id()), "order",
    ).withColumn("part", F.shiftright("place", 33))
    sizes = placed.groupBy("part", *group).agg(F.count("*").alias("here"), F.min("place").alias("first"))
    of_group = Window.partitionBy(*group)
    sizes = sizes.select(
        F.col("part").alias("at"), *[F.col(c).alias(f"of_{c}") for c in group], "first",
        (F.sum("here").over(of_group.orderBy("part")) - F.col("here")).alias("before"),
        F.sum("here").over(of_group).alias("n"))
    same = F.col("part") == F.col("at")
    for c in group:
        same &= F.col(c).eqNullSafe(F.col(f"of_{c}"))
    return placed.join(sizes, same).select(
        *rows.columns, (F.col("before") + F.col("place") - F.col("first")).alias("idx"), "n")


def build(nodes: DataFrame) -> list[DataFrame]:
    """The levels of all groups' trees, lowest first, from ``g, idx, n, digest``; each adds ``sibling``, null if alone.

    A group has its last node, ``n`` of 1, in the level where it ends. More columns of the leaves stay in the first level.
    """
    levels, height = [], 0
    while len(levels) <= height:
        shifted = nodes.select("g", F.col("idx").bitwiseXOR(F.lit(1)).alias("idx"), F.col("digest").alias("sibling"))
        levels.append(written(nodes.join(shifted, ["g", "idx"], "left"), f"level-{len(levels)}"))
        if len(levels) == 1:
            height = ((levels[0].agg(F.max("n")).first()[0] or 1) - 1).bit_length()
        nodes = levels[-1].filter((F.col("n") > 1) & (F.col("idx").bitwiseAND(F.lit(1)) == 0)).select(
            "g", F.shiftright("idx", 1).alias("idx"), F.shiftright(F.col("n") + 1, 1).alias("n"),
            parent_hash(F.col("digest"), F.col("sibling")).alias("digest"))
    return levels


def with_proofs(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The first level's rows with ``proof``, the digests of all siblings up to the root end to end, and ``subroot``.

    ``tops``: ``g, level, proof, subroot`` of each group's last node, ``level`` being the one it ends in.
    """
    rows = None
    for k in range(len(levels) - 1, -1, -1):
        above = tops.filter(F.col("level") == k).select("g", F.lit(0).cast("long").alias("parent"), "proof", "subroot")
        if rows is not None:
            above = above.unionByName(rows.select("g", F.col("idx").alias("parent"), "proof", "subroot"))
        rows = levels[k].withColumn("parent", F.shiftright("idx", 1)).join(above, ["g", "parent"]).withColumn(
            "proof", F.concat(F.coalesce("sibling", F.lit(b"")), "proof")).drop("parent")
        if k and k % LEVELS_PER_WRITE == 0:
            rows = written(rows, f"proofs-{k}")
    return rows


def last_nodes(levels: list[DataFrame]) -> DataFrame:
    """``g, level, digest`` of the node each group ends in."""
    out = None
    for k, level in enumerate(levels):
        ends = level.filter("n = 1").select("g", F.lit(k).alias("level"), "digest")
        out = ends if out is None else out.unionByName(ends)
    return out


def climb(digest: bytes, proof: bytes, places: list[tuple[int, int]]) -> bytes:
    """The root that a leaf and its siblings give; ``places`` are (number, size) in the group, then of the group."""
    at = 0
    for idx, n in places:
        while n > 1:
            pair = digest.hex()
            if idx ^ 1 < n:
                sibling, at = proof[at:at + DIGEST].hex(), at + DIGEST
                pair = sibling + pair if idx & 1 else pair + sibling
            digest = hashlib.sha256(pair.encode()).digest()
            idx, n = idx >> 1, (n + 1) >> 1
    return digest


def fold(n_groups: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["digest", "tampered", "proof", "idx", "n", "g"]
    for batch in batches:
        proofs, roots = [], []
        for digest, tampered, proof, idx, n, g in zip(*(batch.column(c).to_pylist() for c in names)):
            proofs.append(hashlib.sha256(proof.hex().encode()).hexdigest())
            roots.append(climb(tampered or digest, proof, [(idx, n), (g, n_groups)]).hex())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("digest"), batch.column("subroot"), pa.array(proofs, pa.string()),
             pa.array(roots, pa.string())], ["doc_id", "digest", "subroot", "proof_sha256", "folded_root"])


def manifest(leaves: DataFrame) -> tuple[DataFrame, bytes | None, int]:
    """The leaves with their place and proof, the root of all, and the number of groups.

    ``leaves``: ``doc_id, lang, digest`` and more. Groups are the values of ``lang``, null being one, in bytewise order
    with null first. Leaves ascend by id, null first; rows with equal ids by digest. Without leaves the root is None.
    """
    placed = numbered(leaves, ["lang"], ["doc_id", "digest"])
    langs = numbered(placed.select("lang").distinct(), [], ["lang"])
    n_groups = langs.count()
    groups = langs.select(F.col("lang").alias("of_lang"), F.col("idx").alias("g"))
    first = placed.join(groups, F.col("lang").eqNullSafe(F.col("of_lang"))).drop("of_lang")
    levels = build(first)
    ends = last_nodes(levels)
    over = build(ends.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("idx"),
                             F.lit(n_groups).cast("long").alias("n"), "digest"))
    top = last_nodes(over)
    root = top.first()
    above = with_proofs(over, top.select("g", "level", F.lit(b"").alias("proof"), F.col("digest").alias("subroot")))
    tops = written(ends.join(above.select(F.col("idx").alias("g"), "proof"), "g").select(
        "g", "level", "proof", F.col("digest").alias("subroot")), "tops")
    return with_proofs(levels, tops), root and bytes(root["digest"]), n_groups


def manifest_digest(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` per row of ``doc_id, text, lang, source, n_chars``.

    Every 7th row by CRC-32 of its id is checked with 1 added to ``n_chars``; where that is null, or the id is, nothing
    is changed and the row verifies. A null field counts as ``-``, unlike an empty text. Repeated rows are leaves of
    their own, side by side. Very long texts are hashed in the JVM without being copied. An empty table has no rows.
    Other columns of the table are not read.
    """
    whole = [F.col(c) for c in FIELDS]
    more = [F.col(c) + F.lit(1) if c == "n_chars" else F.col(c) for c in FIELDS]
    hit = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    leaves = docs.select(*FIELDS).withColumn("n_chars", F.col("n_chars").cast("decimal(20,0)")).select(
        "doc_id", "lang", leaf_hash(whole).alias("digest"), F.when(hit, leaf_hash(more)).alias("tampered"))
    rows, root, n_groups = manifest(leaves)
    kind = docs.schema["doc_id"].dataType.simpleString()
    root_hex = F.lit(root.hex() if root else None).cast("string")
    return rows.select("doc_id", "digest", "tampered", "proof", "subroot", "idx", "n", "g").mapInArrow(
        lambda batches: fold(n_groups, batches),
        f"doc_id {kind}, digest binary, subroot binary, proof_sha256 string, folded_root string",
    ).select(
        "doc_id", F.lower(F.hex("digest")).alias("leaf"), F.lower(F.hex("subroot")).alias("subroot"),
        root_hex.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root_hex).alias("verified"))
