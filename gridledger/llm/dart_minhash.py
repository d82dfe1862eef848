"""Near copies by DartMinHash sketches of weighted shingles, banded joining, and an exact check.

A document is a set of five-word shingles, each with its count as weight. Every element owns a region of the plane, as
wide as its weight and endless in rank; darts fall on the regions at a rate of one per unit of area, placed by hashes
of element, unit of width, and unit of rank, so that equal regions of two documents catch equal darts. Each dart names
one of ``DARTS`` coordinates, and a coordinate keeps its earliest dart. Two sketches agree at a coordinate with the
weighted Jaccard similarity of the documents as probability. About ``k ln k + 2k`` darts fill all coordinates, however
many elements there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridledger.llm.components import components
from gridledger.llm.textbytes import (
    alnum_bytes, chunks, flat, lower_ascii, mix, prefix_hashes, row_starts, rows_with_text, spans, stretch_hashes,
    text_of, window_starts, word_hashes,
)
from gridledger.session import ensure_checkpoint_dir

SHINGLE = 5
SIMILARITY = 0.8
DARTS = 128
BANDS, BAND_ROWS = 25, 5     # a pair at the threshold shares a band with probability 0.99995
LOOSE = 0.65                 # estimate from which a pair is checked exactly; four deviations below the threshold
SKETCH_ROWS = 256            # short texts need as many darts as long ones, so slices are held to this
BLOCK_MEMBERS = 512
BUCKETS = 1024               # at least; a bucket holds about BUCKET_ROWS members
BUCKET_ROWS = 250_000
THROWN = math.ceil(DARTS * math.log(DARTS) + 2 * DARTS)
POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(14)])
UNIT, RANK, DART, SECOND = (np.uint64(x) for x in (
    0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


def shingles(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of the distinct shingles of each text, by row; and a hash of each text's word sequence.

    A text with fewer words than a shingle, but not none, is one shingle; its hash of no words is 0.
    """
    data, bounds = flat(text_of(part))
    data = lower_ascii(data)
    starts, ends, rows = spans(data, bounds, alnum_bytes())
    first = row_starts(rows, part.num_rows)
    hashed = prefix_hashes(word_hashes(data, starts, ends))
    count = np.diff(first)
    whole = np.where(count > 0, stretch_hashes(hashed, first[:-1], first[1:]), np.uint64(0))
    at = window_starts(first, SHINGLE)
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    lo = np.concatenate([at, first[:-1][short]])
    hi = np.concatenate([at + SHINGLE, first[1:][short]])
    of = np.searchsorted(first, lo, "right") - 1
    value = stretch_hashes(hashed, lo, hi)
    order = np.lexsort((value, of))
    of, value = of[order], value[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (value[1:] != value[:-1])
    spot = np.flatnonzero(new)
    return of[spot], value[spot], np.diff(spot, append=len(of)), whole


def throw(rows: np.ndarray, elements: np.ndarray, weights: np.ndarray, low: np.ndarray, high: np.ndarray,
          ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and coordinate (as one number), rank, and identity of the darts on regions of these weights and ranks.

    Regions are cut into unit squares. A square catches a Poisson number of darts; each lies at a hashed width, and
    counts only if that is below what the weight covers of the square, and at a hashed rank.
    """
    squares = np.ceil(weights).astype(np.int64)
    nth = np.arange(squares.sum()) - np.repeat(np.cumsum(squares) - squares, squares)
    rows, elements, low, high = (np.repeat(x, squares) for x in (rows, elements, low, high))
    share = np.repeat(weights, squares) - nth
    cells = mix(elements + UNIT * nth.astype(np.uint64))
    tall = high - low
    level = np.repeat(low, tall) + np.arange(tall.sum()) - np.repeat(np.cumsum(tall) - tall, tall)
    rows, cells, share = (np.repeat(x, tall) for x in (rows, cells, share))
    cells = mix(cells + RANK * (level.astype(np.uint64) + np.uint64(1)))
    caught = np.searchsorted(POISSON, (cells >> np.uint64(11)).astype(float) / float(1 << 53), "right")
    nth = np.arange(caught.sum()) - np.repeat(np.cumsum(caught) - caught, caught)
    rows, level, share = (np.repeat(x, caught) for x in (rows, level, share))
    dart = mix(np.repeat(cells, caught) + DART * (nth.astype(np.uint64) + np.uint64(1)))
    place = mix(dart + SECOND)
    inside = (place >> np.uint64(32)).astype(float) / float(1 << 32) < share
    rank = level + (place & np.uint64(0xFFFFFFFF)).astype(float) / float(1 << 32)
    target = rows * DARTS + (dart % np.uint64(DARTS)).astype(np.int64)
    return target[inside], rank[inside], dart[inside]


def sketch(rows: np.ndarray, elements: np.ndarray, weights: np.ndarray, n_rows: int) -> np.ndarray:
    """The earliest dart of each coordinate, for every row; rows without elements stay 0.

    Ranks are used up to what throws ``THROWN`` darts on the whole row, and doubled for rows with a coordinate missing.
    """
    out = np.zeros(n_rows * DARTS, np.uint64)
    filled = np.zeros(n_rows * DARTS, bool)
    total = np.bincount(rows, weights, n_rows)
    low = np.zeros(n_rows, np.int64)
    high = np.maximum(np.ceil(THROWN / np.maximum(total, 1e-9)), 1).astype(np.int64)
    active = total > 0
    while active.any():
        on = active[rows]
        r = rows[on]
        target, rank, dart = throw(r, elements[on], weights[on], low[r], high[r])
        order = np.lexsort((dart, rank, target))
        target, dart = target[order], dart[order]
        new = np.ones(len(target), bool)
        new[1:] = target[1:] != target[:-1]
        target, dart = target[new], dart[new]
        empty = ~filled[target]
        out[target[empty]] = dart[empty]
        filled[target] = True
        active &= ~filled.reshape(n_rows, DARTS).all(1)
        low, high = high, high * 2
    return out.reshape(n_rows, DARTS)


def sketch_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, most=SKETCH_ROWS):
            rows, elements, weights, whole = shingles(part)
            darts = sketch(rows, elements, weights.astype(float), part.num_rows)
            few = (darts >> np.uint64(56)).astype(np.uint8)
            bands = np.zeros((part.num_rows, BANDS), np.uint64)
            for at in range(BAND_ROWS):
                bands = mix(bands + darts[:, at:BANDS * BAND_ROWS:BAND_ROWS])
            bands = mix(bands + np.arange(BANDS, dtype=np.uint64))
            text = pa.array(whole.view(np.int64), mask=whole == 0)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), text, pa.array([x.tobytes() for x in few], pa.binary()),
                 pa.array([x.tobytes() for x in bands], pa.binary())], ["doc_id", "v", "few", "bands"])


def unpack_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        v = batch.column("v").to_numpy()
        bands = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(bands), pa.array(np.repeat(v, BANDS))], ["band", "v"])


def best_tree(few: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a tree of greatest estimated similarity, without those below ``LOOSE`` (Prim)."""
    n = len(few)
    best = (few == few[0]).sum(1)
    via = np.zeros(n, np.int64)
    out = np.ones(n, bool)
    out[0] = False
    edges = []
    for _ in range(n - 1):
        at = int(np.argmax(np.where(out, best, -1)))
        if best[at] >= LOOSE * few.shape[1]:
            edges.append((at, int(via[at])))
        out[at] = False
        closer = (few == few[at]).sum(1)
        better = out & (closer > best)
        best = np.where(better, closer, best)
        via[better] = at
    return edges


def pairs_in_bucket(table: pa.Table) -> pa.Table:
    """Tree edges of every band group in a bucket; and, with ``b`` null, the members of groups with pairs besides.

    A tree is of estimates, so it connects what exact similarity does not, and the reverse. It only spares checks; the
    members are looked at again, against what the check of the trees has linked.
    """
    v = table.column("v").to_numpy()
    few = np.frombuffer(b"".join(table.column("few").to_pylist()), np.uint8).reshape(len(v), DARTS)
    band, tile, block = (table.column(c).to_numpy() for c in ("band", "tile", "block"))
    order = np.lexsort((v, tile, band))
    new = np.ones(len(order), bool)
    new[1:] = (band[order][1:] != band[order][:-1]) | (tile[order][1:] != tile[order][:-1])
    first = np.flatnonzero(new)
    size = np.diff(first, append=len(order))
    two = first[size == 2]
    a, b = order[two], order[two + 1]
    alike = (few[a] == few[b]).sum(1) >= LOOSE * DARTS
    pairs, again = [np.stack([v[a[alike]], v[b[alike]]], 1)], [np.zeros(0, np.int64)]
    for lo, n in zip(first[size > 2].tolist(), size[size > 2].tolist()):
        members = order[lo:lo + n]
        edges = best_tree(few[members])
        pairs.append(np.array([(v[members[x]], v[members[y]]) for x, y in edges], np.int64).reshape(-1, 2))
        partners = np.array([(few[members] == one).sum(1) >= LOOSE * DARTS for one in few[members]]).sum(1) - 1
        if partners.sum() > 2 * len(edges):
            again.append(members[partners > 0])
    found = np.sort(np.concatenate(pairs), 1)
    found = np.unique(found[found[:, 0] != found[:, 1]], axis=0)
    again = np.concatenate(again)
    nothing, none = pa.nulls(len(found), pa.int64()), pa.nulls(len(found), pa.int32())
    return pa.table([
        pa.chunked_array([found[:, 0], v[again]], pa.int64()),
        pa.chunked_array([pa.array(found[:, 1]), pa.nulls(len(again), pa.int64())]),
        pa.chunked_array([nothing, pa.array(band[again])]),
        pa.chunked_array([nothing, pa.array(tile[again].astype(np.int64))]),
        pa.chunked_array([none, pa.array(block[again].astype(np.int32))]),
        pa.chunked_array([pa.nulls(len(found), pa.binary()), pa.array([x.tobytes() for x in few[again]], pa.binary())])],
        ["a", "b", "band", "tile", "block", "few"])


def band_members(classes: DataFrame) -> DataFrame:
    """``band, v, n``: texts that agree in a band, and how many do; groups with the same members are named once."""
    bands = classes.select("v", "bands").mapInArrow(unpack_bands, "band long, v long")
    groups = bands.groupBy("band").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("v")).alias("x"),
                                       F.bit_xor(F.xxhash64("v", F.lit(1))).alias("y"))
    groups = groups.filter("n > 1").groupBy("n", "x", "y").agg(F.min("band").alias("band")).select("band", "n")
    return bands.join(groups, "band")


def candidates(members: DataFrame, classes: DataFrame) -> DataFrame:
    """``a, b``: pairs of texts worth an exact check, from ``band, v, n`` and the sketches, one row per distinct text.

    A group of up to ``BLOCK_MEMBERS`` is a tile. Larger ones are dealt into blocks, by another hash in every band, and a
    block is a tile (numbered below 0), so work grows with the members. Near copies share many bands, so the blocks of one
    connect those of another; what blocks leave apart meets in ``cross_tiles``. Rows without ``b`` are members ``a`` of tiles (``band``, ``tile``, ``block``, ``few``) whose pairs
    are more than those named.
    """
    cuts = F.ceil(F.col("n") / BLOCK_MEMBERS).cast("int")
    tile = F.when(cuts > 1, -1 - F.pmod(F.hash("v", "band"), cuts)).otherwise(0)
    tiles = members.select("band", "v", F.lit(0).alias("block"), tile.cast("long").alias("tile"))
    buckets = max(BUCKETS, classes.count() * BANDS // BUCKET_ROWS)
    sketched = tiles.join(classes.select("v", "few"), "v").withColumn(
        "bucket", F.pmod(F.xxhash64("band", "tile"), F.lit(buckets)).cast("int"))
    return sketched.groupBy("bucket").applyInArrow(
        pairs_in_bucket, "a long, b long, band long, tile long, block int, few binary")


def cross_tiles(members: DataFrame, groups: DataFrame, classes: DataFrame) -> DataFrame:
    """``v, component, band, tile, block, few``: tiles that hold every pair of a large group's members not linked yet.

    Components (``groups``) of more than ``BLOCK_MEMBERS`` members of a band group get blocks of their own, the rest
    share blocks. Every pair of blocks is a tile but those of one component. So a group of near copies that is linked
    already costs nothing, and each of its members meets a text outside once.
    """
    held = members.filter(F.col("n") > BLOCK_MEMBERS).select("band", "v").join(groups, "v", "left")
    held = held.withColumn("component", F.coalesce("component", "v"))
    cuts = F.ceil(F.col("n") / BLOCK_MEMBERS).cast("int")
    sizes = held.groupBy("band", "component").agg(F.count("*").alias("n")).withColumn(
        "own", F.when(F.col("n") > BLOCK_MEMBERS, cuts))
    bands = sizes.groupBy("band").agg(
        F.count("*").alias("parts"), F.coalesce(F.sum("own"), F.lit(0)).cast("int").alias("wide"),
        F.ceil(F.coalesce(F.sum(F.when(F.col("own").isNull(), F.col("n"))), F.lit(0)) / BLOCK_MEMBERS).cast("int").alias("shared"))
    bands = bands.filter("parts > 1").drop("parts")
    before = Window.partitionBy("band").orderBy("component").rowsBetween(Window.unboundedPreceding, -1)
    wide = sizes.filter("own IS NOT NULL").select(
        "band", "component", "own", F.coalesce(F.sum("own").over(before), F.lit(0)).cast("int").alias("past"))
    placed = held.join(bands, "band").join(wide, ["band", "component"], "left").withColumn("from", F.col("shared") + F.col("past"))
    placed = placed.withColumn("block", F.when(F.col("own").isNull(), F.pmod(F.hash("v"), "shared")).otherwise(
        F.col("from") + F.pmod(F.hash("v"), "own")))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shared") + F.col("wide") - 1)))
    dealt = dealt.filter("own IS NULL OR other < `from` OR other >= `from` + own")
    tile = (F.least("block", "other").cast("long") * (F.col("shared") + F.col("wide")) + F.greatest("block", "other"))
    return dealt.withColumn("tile", tile).join(classes.select("v", "few"), "v").select(
        "v", "component", "band", "tile", "block", "few")


def shingle_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's hashed shingles with their counts, once per slice for texts of equal words."""
    for batch in batches:
        for part in chunks(batch):
            rows, elements, weights, whole = shingles(part)
            first = row_starts(rows, part.num_rows)
            _, once = np.unique(whole, return_index=True)
            once = once[whole[once] != 0]
            short = np.repeat((elements >> np.uint64(32)).astype(np.uint32), weights)
            to = np.concatenate([[0], np.cumsum(weights)])
            cut = [short[to[first[i]]:to[first[i + 1]]].tobytes() for i in once.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(whole[once].view(np.int64)), pa.array(cut, pa.binary())], ["v", "shingles"])


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the smaller over sum of the larger counts."""
    (x, m), (y, n) = (np.unique(s, return_counts=True) for s in (a, b))
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    shared = int(np.minimum(m[i], n[j]).sum())
    return shared / (len(a) + len(b) - shared) if len(a) + len(b) else 0.0


def check_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        similar = [weighted_jaccard(np.frombuffer(x.as_py(), np.uint32), np.frombuffer(y.as_py(), np.uint32)) >= SIMILARITY
                   for x, y in zip(batch.column("left"), batch.column("right"))]
        yield batch.select(["a", "b"]).filter(pa.array(similar, pa.bool_()))


def open_members(table: pa.Table) -> pa.Table:
    """The members of a tile that have a pair worth an exact check in another component."""
    component, block = table.column("component").to_numpy(), table.column("block").to_numpy()
    few = np.frombuffer(b"".join(table.column("few").to_pylist()), np.uint8).reshape(len(component), DARTS)
    across = len(np.unique(block)) > 1
    apart = np.array([((few == few[i]).sum(1) >= LOOSE * DARTS) & (component != component[i])
                      & ((block != block[i]) | (not across)) for i in range(len(component))])
    return table.filter(pa.array(apart.any(1)))


def check_tile(table: pa.Table) -> pa.Table:
    """Links between the components of a tile's members, from exact checks of every pair that none connects yet.

    A tile of two blocks takes pairs across them only, as each block has a tile of its own.
    """
    component, block = table.column("component").to_numpy(), table.column("block").to_numpy()
    few = np.frombuffer(b"".join(table.column("few").to_pylist()), np.uint8).reshape(len(component), DARTS)
    texts = [np.unique(np.frombuffer(x, np.uint32), return_counts=True) for x in table.column("shingles").to_pylist()]
    known, spot = np.unique(np.concatenate([x for x, _ in texts]), return_inverse=True)
    spots = np.split(spot, np.cumsum([len(x) for x, _ in texts])[:-1])
    total = [int(n.sum()) for _, n in texts]
    across = len(np.unique(block)) > 1
    label, here, found = component.copy(), np.zeros(len(known), np.int64), []
    for i in range(len(component) - 1):
        open_pairs = (label[i + 1:] != label[i]) & ((block[i + 1:] != block[i]) | (not across))
        others = i + 1 + np.flatnonzero(open_pairs)
        others = others[(few[others] == few[i]).sum(1) >= LOOSE * DARTS]
        here[spots[i]] = texts[i][1]
        for j in others.tolist():
            if label[j] == label[i]:
                continue
            shared = int(np.minimum(here[spots[j]], texts[j][1]).sum())
            if shared / (total[i] + total[j] - shared) >= SIMILARITY:
                found.append((component[i], component[j]))
                label[label == label[j]] = label[i]
        here[spots[i]] = 0
    found = np.array(found, np.int64).reshape(-1, 2)
    return pa.table([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])


def similar_groups(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``v, component`` of the texts that chains of pairs with weighted Jaccard similarity ``SIMILARITY`` connect.

    Only texts on a candidate pair or in a large band group send their shingles to the check. Four bytes stand for a
    shingle there. First the trees' edges are checked; a tile whose members these leave in several components then checks
    all pairs between them, with each member's shingles sent once. Tiles of large groups are made after the first check,
    so members that it has linked do not meet again.
    """
    in_bands = band_members(classes).checkpoint()
    shown = candidates(in_bands, classes).checkpoint()
    pairs = shown.filter("b IS NOT NULL").select("a", "b").distinct().checkpoint()
    ends = pairs.select(F.col("a").alias("v")).union(pairs.select("b"))
    ends = ends.union(in_bands.filter(F.col("n") > BLOCK_MEMBERS).select("v")).distinct()
    texts = docs.select("text").mapInArrow(shingle_texts, "v long, shingles binary")
    texts = texts.join(ends, "v", "left_semi").dropDuplicates(["v"]).checkpoint()
    linked = (
        pairs.join(texts.select(F.col("v").alias("a"), F.col("shingles").alias("left")), "a")
        .join(texts.select(F.col("v").alias("b"), F.col("shingles").alias("right")), "b")
        .mapInArrow(check_pairs, "a long, b long")
    )
    groups = components(linked).withColumnRenamed("id", "v").checkpoint()
    members = shown.filter("b IS NULL AND tile >= 0").select(F.col("a").alias("v"), "band", "tile", "block", "few")
    members = members.join(groups, "v", "left").withColumn("component", F.coalesce("component", "v"))
    members = members.unionByName(cross_tiles(in_bands, groups, classes))
    apart = members.groupBy("band", "tile").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    members = members.join(apart.filter("lo <> hi").select("band", "tile"), ["band", "tile"])
    members = members.select("v", "component", "band", "tile", "block", "few").groupBy("band", "tile").applyInArrow(
        open_members, "v long, component long, band long, tile long, block int, few binary").checkpoint()
    if members.isEmpty():
        return groups
    more = components(members.join(texts, "v").groupBy("band", "tile").applyInArrow(check_tile, "a long, b long"))
    ends = groups.unionByName(more.select(F.col("id").alias("v"), F.col("id").alias("component"))).groupBy("v").agg(
        F.min("component").alias("component"))
    return ends.join(more.select(F.col("id").alias("component"), F.col("component").alias("least")), "component", "left").select(
        "v", F.coalesce("least", "component").alias("component"))


def text_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``doc_id, v`` per row (v null for texts without words), and ``v, component, class_id`` per distinct text.

    ``v`` is a hash of the word sequence, ``class_id`` the least id among all documents that links connect.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    rows = docs.select("doc_id", "text").mapInArrow(sketch_texts, "doc_id long, v long, few binary, bands binary").checkpoint()
    found = rows.filter("v IS NOT NULL")
    classes = found.groupBy("v", "few", "bands").agg(F.min("doc_id").alias("least")).checkpoint()
    groups = similar_groups(docs, classes)
    labelled = (
        classes.select("v", "least").join(groups, "v", "left")
        .withColumn("component", F.coalesce("component", "v"))
    )
    ids = labelled.groupBy("component").agg(F.min("least").alias("class_id"))
    return rows.select("doc_id", "v"), labelled.join(ids, "component").select("v", "component", "class_id")


def near_copies_digest(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id, kept`` per row: the least id of its group of near copies, and whether that is its own.

    Texts that are null, empty or without words are their own class. Equal texts share a class; texts of one id share
    it only if they are similar.
    """
    rows, labels = text_classes(docs)
    return rows.join(labels, "v", "left").select(
        "doc_id", F.when(F.col("v").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def mark_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            whole = shingles(part)[3]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc"), pa.array(whole.view(np.int64), mask=whole == 0)], ["doc", "v"])


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies: the one with the least id; columns unchanged.

    Rows without words all stay. If several rows of a group carry its least id (repeated rows, or null ids only), one
    of them stays; that costs a shuffle of the kept rows, made only when there are such.
    """
    rows, labels = text_classes(docs)
    labels = labels.checkpoint()
    marked = rows_with_text(docs, docs.columns)
    marked = marked.mapInArrow(mark_texts, f"doc {marked.schema['doc'].dataType.simpleString()}, v long")
    kept = marked.join(labels, "v", "left").filter(
        F.col("v").isNull() | F.col("doc.doc_id").eqNullSafe(F.col("class_id")))
    winners = rows.join(labels, "v").filter(F.col("doc_id").eqNullSafe(F.col("class_id")))
    if not winners.groupBy("component").count().filter("count > 1").isEmpty():
        kept = kept.filter("v IS NULL").unionByName(kept.filter("v IS NOT NULL").dropDuplicates(["component"]))
    return kept.select("doc.*")
