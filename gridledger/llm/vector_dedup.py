"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, rerank with the original vectors.

Rotations are learned on a bounded sample so that signs of the rotated vectors lose little. The bits of
several rotations are cut into substrings, one table each; vectors that agree in a substring meet. Entries hold a few
hundred vectors, as comparing 16 bytes of code is cheap and a table more is not. The Hamming distance of these bytes tells
which vectors of an entry have a near one there; these alone bring their components to that entry, where cosines in double
precision decide, block against block. Members of entries are shuffled packed, 28 bytes each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridledger.llm.components import components
from gridledger.llm.textbytes import mix
from gridledger.session import ensure_checkpoint_dir

COSINE = 0.9
SAMPLE = 8192          # vectors that the rotations are fitted on
ROUNDS = 30
RECALL = 0.985         # of pairs exactly at the threshold; closer pairs are found more surely
OCCUPANCY = 512        # vectors per table entry that the substring length aims at
LEAST_BITS, MOST_BITS = 8, 24
CODE_BITS = 128        # of the code that travel with a member
DEVIATIONS = 4.0       # by which a pair's Hamming distance may exceed the mean at the threshold
BLOCK = 4096           # vectors of an entry that a task compares with as many others
MOST_SPLIT = 100_000   # entries that are split; blocks grow where more would have to be
COUNTED = 16           # one in so many vectors is counted to size the blocks
SLICE = 4096
BUCKETS = 1024         # at least; a bucket aims at these many members, and bytes of components
BUCKET_MEMBERS, BUCKET_BYTES = 250_000, 16 << 20


def substring_bits(vectors: int) -> int:
    """Length of a substring, so that a table entry holds a few vectors."""
    return int(min(MOST_BITS, max(LEAST_BITS, round(math.log2(max(vectors, 1) / OCCUPANCY)))))


def table_count(bits: int) -> int:
    """Tables to begin with: enough for a pair at the threshold if a bit agrees with probability 1 - angle / pi."""
    agree = (1 - math.acos(COSINE) / math.pi) ** bits
    return math.ceil(math.log(1 - RECALL) / math.log(1 - agree))


def rotations(sample: np.ndarray, total_bits: int) -> list[np.ndarray]:
    """Projections that give ``total_bits`` bits together; each starts from another random rotation.

    Alternates between the nearest binary codes and the rotation that fits them best (Procrustes). Vectors are not
    centred: that would widen the angle of a pair whenever the vectors share a direction.
    """
    wide = sample.shape[1]
    width = min(wide, 64)
    _, axes = np.linalg.eigh(sample.T @ sample)
    axes = axes[:, ::-1][:, :width]
    flat = sample @ axes
    out = []
    for nth in range(math.ceil(total_bits / width)):
        turn = np.linalg.qr(np.random.default_rng(nth).normal(size=(width, width)))[0]
        for _ in range(ROUNDS if len(sample) >= 2 * width else 0):
            left, _, right = np.linalg.svd(np.where(flat @ turn >= 0, 1.0, -1.0).T @ flat)
            turn = right.T @ left.T
        out.append(axes @ turn)
    return out


def threshold_pairs(sample: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sample vectors, each with a partner at cosine ``COSINE``: off in any direction, and towards another vector."""
    draw = np.random.default_rng(0)
    out = []
    for off in (draw.normal(size=sample.shape), sample[draw.permutation(len(sample))]):
        off = off - (off * sample).sum(1)[:, None] * sample
        size = np.sqrt((off * off).sum(1))
        some = size > 1e-6
        out.append((sample[some], COSINE * sample[some] + math.sqrt(1 - COSINE ** 2) * off[some] / size[some, None]))
    return [pair for pair in out if len(pair[0])]


def index_plan(sample: np.ndarray, width: int) -> tuple[list[np.ndarray], int, int]:
    """Projections, number of tables, and the Hamming distance of short codes that a pair at the threshold stays below.

    Tables are added until both kinds of pairs at the threshold meet with probability ``RECALL``. The learned ones may
    separate a pair in one table like in another, so those added project on random rotations of the whole space.
    """
    pairs = threshold_pairs(sample)
    tables = table_count(width)
    turns = rotations(sample, width * tables)
    wide, more = sample.shape[1], np.random.default_rng(1)

    def apart() -> list[np.ndarray]:
        return [encode(x, turns) != encode(y, turns) for x, y in pairs]

    def recall(bits: np.ndarray) -> float:
        return float((~bits[:, :width * tables].reshape(len(bits), tables, width).any(2)).any(1).mean())

    differ = apart()
    while any(recall(bits) < RECALL for bits in differ):
        while sum(turn.shape[1] for turn in turns) < width * (tables + 1):
            turn = np.linalg.qr(more.normal(size=(wide, wide)))[0]
            turns.append(turn)
            differ = [np.concatenate([bits, encode(x, [turn]) != encode(y, [turn])], 1) for bits, (x, y) in zip(differ, pairs)]
        tables += 1
    total = min(CODE_BITS, sum(turn.shape[1] for turn in turns))
    share = math.acos(COSINE) / math.pi
    most = total * share + DEVIATIONS * math.sqrt(total * share * (1 - share))
    for bits in differ:
        away = bits[:, :CODE_BITS].sum(1)
        most = max(most, away.mean() + DEVIATIONS * away.std(), away.max())
    return turns, tables, int(most) + 1


def unit_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the column's most common length there, as unit rows in double precision, and their row numbers.

    Null, zero, and vectors with null or non-finite components are left out, as are those of any other length.
    """
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    if not len(lengths) or not lengths.any():
        return np.zeros((0, 1)), np.zeros(0, np.int64)
    wide = int(np.bincount(lengths[lengths > 0]).argmax())
    rows = np.flatnonzero(lengths == wide)
    taken = column.take(pa.array(rows))
    values = pc.fill_null(taken.flatten().cast(pa.float64()), math.nan).to_numpy(zero_copy_only=False).reshape(-1, wide)
    with np.errstate(all="ignore"):
        largest = np.abs(values).max(1)
        usable = np.isfinite(largest) & (largest > 0)
        scaled = values[usable] / largest[usable, None]
    return scaled / np.sqrt((scaled * scaled).sum(1))[:, None], rows[usable]


def encode(units: np.ndarray, turns: list[np.ndarray]) -> np.ndarray:
    """A bit per projection, as 0 and 1."""
    return np.concatenate([units @ turn >= 0 for turn in turns], 1).astype(np.uint8)


def table_keys(bits: np.ndarray, width: int, tables: int) -> np.ndarray:
    """The substring of each table as a number."""
    weights = (1 << np.arange(width)).astype(np.int64)
    return (bits[:, :width * tables].reshape(len(bits), tables, width) * weights).sum(2)


def usable_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the rows of ``wide`` components that have a direction."""
    for batch in batches:
        _, rows = unit_rows(batch.column("embedding"))
        yield batch.take(pa.array(rows))


def member_type(width: int, tables: int) -> np.dtype:
    """A member of a table entry: table number and substring in one, the vector's class, and its short code."""
    entry = "<u4" if tables << width <= 1 << 32 else "<u8"
    return np.dtype([("entry", entry), ("v", "<i8"), ("code", "<u8", (CODE_BITS // 64,))])


def short_codes(bits: np.ndarray) -> np.ndarray:
    """The first ``CODE_BITS`` bits of each code as 64-bit words; bits that a shorter code lacks are 0."""
    out = np.zeros((len(bits), CODE_BITS), np.uint8)
    out[:, :bits.shape[1]] = bits[:, :CODE_BITS]
    return np.packbits(out, axis=1, bitorder="little").view("<u8")


def entries_of(turns: list, width: int, tables: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The table entries of every vector."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            keys = table_keys(encode(unit_rows(batch.column("embedding").slice(at, SLICE))[0], turns), width, tables)
            yield pa.RecordBatch.from_arrays([pa.array((keys + (np.arange(tables) << width)).ravel())], ["entry"])


def split_entries(classes: DataFrame, turns: list, width: int, tables: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries that hold more than ``block`` vectors, in order, and the number of blocks each is cut into.

    Counts one in ``COUNTED`` vectors. This sizes blocks and nothing else: every pair of an entry meets, however it is
    cut. At most about ``MOST_SPLIT`` entries are so large, as ``block`` grows with the number of members.
    """
    counted = classes.filter(F.pmod(F.xxhash64("v"), F.lit(COUNTED)) == 0).select("v", "embedding").mapInArrow(
        lambda batches: entries_of(turns, width, tables, batches), "entry long")
    large = counted.groupBy("entry").agg((F.count("*") * COUNTED).alias("n")).filter(F.col("n") > block).orderBy("entry").collect()
    return np.array([r.entry for r in large], np.int64), np.array([-(-r.n // block) for r in large], np.int64)


def packed_members(turns: list, width: int, tables: int, split: tuple[np.ndarray, np.ndarray], buckets: int,
                   batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of table entries by bucket. Those of a split entry go to every pair of blocks that theirs is in."""
    kind, (large, cuts_of) = member_type(width, tables), split
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            bits = encode(unit_rows(part.column("embedding"))[0], turns)
            rows = np.empty((part.num_rows, tables), kind)
            rows["entry"] = table_keys(bits, width, tables) + (np.arange(tables) << width)
            rows["v"] = part.column("v").to_numpy()[:, None]
            rows["code"] = short_codes(bits)[:, None, :]
            rows = rows.ravel()
            cuts = np.ones(len(rows), np.int64)
            if len(large):
                spot = np.minimum(np.searchsorted(large, rows["entry"]), len(large) - 1)
                cuts = np.where(large[spot] == rows["entry"], cuts_of[spot], 1)
            block = (rows["v"].view(np.uint64) % cuts.astype(np.uint64)).astype(np.int64)
            each = np.repeat(np.arange(len(rows)), cuts)
            other = np.arange(len(each)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            low, high = np.minimum(block[each], other), np.maximum(block[each], other)
            bucket = tile_buckets(rows["entry"][each], low, high, buckets)
            order = np.lexsort((block[each], high, low, bucket))
            columns = [x[order] for x in (bucket, low, high, block[each])]
            new = np.ones(len(order), bool)
            new[1:] = False
            for column in columns:
                new[1:] |= column[1:] != column[:-1]
            first = np.flatnonzero(new)
            raw, size = rows[each[order]].tobytes(), kind.itemsize
            ends = np.append(first[1:], len(order))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c[first].astype(np.int32)) for c in columns]
                + [pa.array([raw[lo * size:hi * size] for lo, hi in zip(first.tolist(), ends.tolist())], pa.binary())],
                ["bucket", "low", "high", "block", "members"])


def tile_buckets(entry: np.ndarray, low: np.ndarray, high: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a pair of blocks of an entry."""
    mixed = mix(mix(mix(entry.astype(np.uint64)) + low.astype(np.uint64)) + high.astype(np.uint64))
    return (mixed % np.uint64(buckets)).astype(np.int64)


def each_tile(entry: np.ndarray, low: np.ndarray, high: np.ndarray, block: np.ndarray,
              ) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """Entry, rows of either side, and whether both sides are the same, of every tile with a pair."""
    columns = (entry, low, high)
    order = np.lexsort((block, high, low, entry))
    new = np.ones(len(order), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    first = np.flatnonzero(new)
    of, a_side, b_side = (c[order[first]] for c in columns)
    for lo, n, e, a, b in zip(first.tolist(), np.diff(first, append=len(order)).tolist(), of.tolist(), a_side.tolist(), b_side.tolist()):
        rows = order[lo:lo + n]
        if a == b:
            if n > 1:
                yield e, rows, rows, True
        else:
            side = block[rows] == a
            if side.any() and not side.all():
                yield e, rows[side], rows[~side], False


def near_members(most: int, width: int, tables: int, table: pa.Table) -> pa.Table:
    """The members of a bucket's tiles that have another within ``most`` bits there, whom no table before has shown.

    Only the tables whose substrings lie in the short code are looked at for that, so a pair may be shown again.
    """
    kind = member_type(width, tables)
    packed = table.column("members").to_pylist()
    count = np.array([len(x) // kind.itemsize for x in packed], np.int64)
    rows = np.frombuffer(b"".join(packed), kind)
    low, high, block = (np.repeat(table.column(c).to_numpy(), count) for c in ("low", "high", "block"))
    code = np.ascontiguousarray(rows["code"])
    known = min(tables, CODE_BITS // width)
    bits = np.unpackbits(code.view(np.uint8), axis=1, bitorder="little")
    keys = table_keys(bits[:, :width * known], width, known)
    near = np.zeros(len(rows), bool)
    for entry, left, right, same in each_tile(rows["entry"].astype(np.int64), low, high, block):
        nth = min(entry >> width, known)
        step = max(1, (1 << 20) // len(right))
        for at in range(0, len(left), step):
            one, others = left[at:at + step], right[at:] if same else right
            away = np.bitwise_count(code[one, 0][:, None] ^ code[others, 0][None, :])
            for word in range(1, code.shape[1]):
                away += np.bitwise_count(code[one, word][:, None] ^ code[others, word][None, :])
            i, j = np.nonzero(away <= most)
            if same:
                i, j = i[j > i], j[j > i]
            i, j = one[i], others[j]
            for t in range(nth):
                fresh = keys[i, t] != keys[j, t]
                i, j = i[fresh], j[fresh]
            near[i] = near[j] = True
    return pa.table([pa.array(rows["entry"][near].astype(np.int64)), pa.array(low[near]), pa.array(high[near]),
                     pa.array(block[near]), pa.array(rows["v"][near])], ["entry", "low", "high", "block", "v"])


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that edges reach from each of ``n`` nodes."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        to = label.copy()
        np.minimum.at(to, a, least)
        np.minimum.at(to, b, least)
        to = to[to]
        if (to == label).all():
            return label
        label = to


def link_tiles(turns: list, width: int, tables: int, table: pa.Table) -> pa.Table:
    """Per vector and tile: vectors linked to it that no earlier table has shown, and a linked vector of its group.

    A pair may meet in many tables; it counts in the first whose substrings agree, which both codes tell.
    """
    units, rows = unit_rows(table.column("embedding").combine_chunks())
    assert len(rows) == table.num_rows
    keys = table_keys(encode(units, turns), width, tables)
    v, copies = table.column("v").to_numpy(), table.column("copies").to_numpy()
    out = []
    for entry, left, right, same in each_tile(*(table.column(c).to_numpy() for c in ("entry", "low", "high", "block"))):
        nth = entry >> width
        found = []
        for at in range(0, len(left), 512):
            close = units[left[at:at + 512]] @ units[right].T >= COSINE
            if same:
                close &= np.arange(len(right))[None, :] > (at + np.arange(close.shape[0]))[:, None]
            i, j = np.nonzero(close)
            found.append(np.stack([left[at + i], right[j]], 1))
        pairs = np.concatenate(found)
        if not len(pairs):
            continue
        fresh = np.ones(len(pairs), bool)
        for t in range(nth):
            fresh &= keys[pairs[:, 0], t] != keys[pairs[:, 1], t]
        nodes, at = np.unique(pairs, return_inverse=True)
        at = at.reshape(pairs.shape)
        count = np.zeros(len(nodes), np.int64)
        np.add.at(count, at[fresh, 0], copies[pairs[fresh, 1]])
        np.add.at(count, at[fresh, 1], copies[pairs[fresh, 0]])
        label = least_labels(len(nodes), at[:, 0], at[:, 1])
        out.append(np.stack([v[nodes], v[nodes[label]], count], 1))
    cells = np.concatenate(out) if out else np.zeros((0, 3), np.int64)
    return pa.table([pa.array(cells[:, i]) for i in range(3)], ["v", "root", "n"])


def vector_links(vectors: DataFrame) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row of ``vec_id, embedding``.

    Two vectors link if they have equal length and their cosine in double precision is ``COSINE`` or more. Every length
    that the table holds is searched on its own; lengths are those of the models in use, so few. Equal vectors form a
    class that goes through the search once; its size counts for its neighbours, and its members link with each other.
    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing. Every usable vector is
    indexed. Repeated ids with equal vectors count as rows of their own. Other columns of the table are not read.

    A table entry with more than ``BLOCK`` vectors is split into pairs of blocks, so none is capped. Pairs are never
    written: a task returns counts and one linked vector per vector. A vector shuffles 28 bytes for each table, and its
    components once for each entry where it first meets a near one.
    """
    ensure_checkpoint_dir(vectors.sparkSession)
    rows = vectors.select("vec_id", "embedding", F.xxhash64("embedding").alias("v"), F.size("embedding").alias("wide"))
    lengths = [r.wide for r in rows.select("wide").filter("wide > 0").distinct().orderBy("wide").collect()]
    answers = None
    for wide in lengths:
        mine = links_of_length(rows.filter(F.col("wide") == wide), wide).withColumn("wide", F.lit(wide))
        answers = mine if answers is None else answers.unionByName(mine)
    if answers is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"),
                           F.lit(True).alias("kept"))
    return rows.select("vec_id", "v", "wide").join(answers, ["v", "wide"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("vec_id")).cast("long").alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def links_of_length(rows: DataFrame, wide: int) -> DataFrame:
    """``v, n_links, component_id, usable`` per class of equal usable vectors of ``wide`` components."""
    kind = rows.schema["embedding"].dataType.simpleString()
    classes = (
        rows.groupBy("v", "embedding")
        .agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
        .select("v", "embedding", "copies", "least")
        .mapInArrow(usable_rows, f"v long, embedding {kind}, copies long, least long").checkpoint()
    )
    vectors_in = classes.count()
    width = substring_bits(vectors_in)
    sample = classes.orderBy(F.xxhash64("v")).limit(SAMPLE).select("embedding").collect()
    units = np.array([r.embedding for r in sample], float).reshape(-1, wide)
    units /= np.abs(units).max(1, initial=1e-300)[:, None]
    units /= np.maximum(np.sqrt((units * units).sum(1)), 1e-300)[:, None]
    if not len(units):
        return classes.select("v", F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("component_id"),
                              F.lit(True).alias("usable"))
    turns, tables, most = index_plan(units, width)

    split = split_entries(classes, turns, width, tables, max(BLOCK, vectors_in * tables // MOST_SPLIT))
    buckets = max(BUCKETS, vectors_in * tables // BUCKET_MEMBERS)
    members = classes.select("v", "embedding").mapInArrow(
        lambda batches: packed_members(turns, width, tables, split, buckets, batches),
        "bucket int, low int, high int, block int, members binary")
    near = members.groupBy("bucket").applyInArrow(
        lambda table: near_members(most, width, tables, table), "entry long, low int, high int, block int, v long").checkpoint()
    parts = max(BUCKETS, near.count() * wide * 8 // BUCKET_BYTES)
    close = near.join(classes.select("v", "embedding", "copies"), "v").withColumn(
        "bucket", F.pmod(F.xxhash64("entry", "low", "high"), F.lit(parts)).cast("int"))
    shown = close.groupBy("bucket").applyInArrow(
        lambda table: link_tiles(turns, width, tables, table), "v long, root long, n long")
    shown = shown.groupBy("v", "root").agg(F.sum("n").alias("n")).checkpoint()
    counted = shown.groupBy("v").agg(F.sum("n").alias("n"))
    groups = components(shown.select(F.col("v").alias("a"), F.col("root").alias("b")))
    labelled = (
        classes.select("v", "copies", "least").join(counted, "v", "left")
        .join(groups.withColumnRenamed("id", "v"), "v", "left")
        .select("v", "least", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
                F.coalesce("component", "v").alias("component"))
    )
    ids = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    return labelled.join(ids, "component").select("v", "n_links", "component_id", F.lit(True).alias("usable"))
