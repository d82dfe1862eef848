"""From the zipped XML export to typed, de-duplicated, partitioned Parquet."""

from __future__ import annotations

import codecs
import fnmatch
import hashlib
import os
import re
import uuid
import zipfile
from collections.abc import Generator, Iterator, Sequence
from typing import BinaryIO, NamedTuple

import pandas as pd
from pyarrow import fs as storage
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridledger.catalog import Entity
from gridledger.functions.convert import to_iso_date, to_number

CORRUPT = "_corrupt_record"


def at_storage(path: str) -> tuple[storage.FileSystem, str]:
    """The file system of a plain path or a URI (file, hdfs, s3, gs), and the path on it."""
    return storage.FileSystem.from_uri(path if "://" in path else os.path.abspath(path.removeprefix("file:")))


def list_members(archive: str, pattern: str) -> list[str]:
    """Archive members matching a glob; only the central directory is read."""
    store, path = at_storage(archive)
    with store.open_input_file(path) as data, zipfile.ZipFile(data) as zf:
        return sorted(m for m in zf.namelist() if fnmatch.fnmatch(m, pattern))


def part_name(member: str, part: int) -> str:
    """Unique per member, also where folders of the archive, or several archives, hold members of one name."""
    stem = os.path.splitext(os.path.basename(member))[0]
    return f"{stem}-{hashlib.sha256(member.encode()).hexdigest()[:12]}-{part:05d}.xml"


def _utf8_chunks(source: BinaryIO, size: int = 1 << 20) -> Iterator[bytes]:
    """Stream bytes, turning UTF-16 text with a byte-order mark into UTF-8."""
    head = source.read(size)
    if head[:2] in (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE):
        decoder = codecs.getincrementaldecoder("utf-16")()
        while head:
            yield decoder.decode(head).encode("utf-8")
            head = source.read(size)
        yield decoder.decode(b"", final=True).encode("utf-8")
        return
    while head:
        yield head
        head = source.read(size)


def split_records(chunks: Iterator[bytes], tag: str, part_bytes: int) -> Generator[bytes, None, int]:
    """Cut an XML byte stream behind closing record tags into documents of about ``part_bytes``.

    Returns how many records the stream leaves open at its end: one where it was cut short, else none.
    """
    # the root is often the plural of the tag, so the name has to end where the tag's name ends
    opening, closing = re.compile(rf"<{tag}[\s/>]".encode()), f"</{tag}>".encode()
    started, kept = False, b""
    for chunk in chunks:
        kept += chunk
        if not started:
            first = opening.search(kept)
            if first is None:
                continue
            started, kept = True, kept[first.start():]
        if len(kept) >= part_bytes:
            cut = kept.rfind(closing)
            if cut > 0:
                cut += len(closing)
                yield b"<part>" + kept[:cut] + b"</part>"
                kept = kept[cut:]
    end = kept.rfind(closing)
    if started and end > 0:
        yield b"<part>" + kept[: end + len(closing)] + b"</part>"
        kept = kept[end + len(closing):]
    return int(opening.search(kept) is not None)


class Staged(NamedTuple):
    """What staging found: parts written per member, every child tag, records cut short per member."""

    parts: dict[str, int]
    columns: list[str]
    truncated: dict[str, int]


def _child_tags(part: bytes, tag: str) -> set[str]:
    names = {name.decode() for name in re.findall(rb"<([A-Za-z_][\w.\-]*)[\s/>]", part)}
    return names - {tag, "part"}


def stage_members(spark: SparkSession, archive: str, entity: Entity, out_dir: str,
                  part_bytes: int = 64 << 20) -> Staged:
    """Unpack an entity's members of one archive to ``out_dir``; see ``stage_archives``."""
    return stage_archives(spark, [archive], entity, out_dir, part_bytes)


def stage_archives(spark: SparkSession, archives: Sequence[str], entity: Entity, out_dir: str,
                   part_bytes: int = 64 << 20) -> Staged:
    """Unpack an entity's members to ``out_dir``, one task per member of any archive, as files of moderate size.

    Members are listed by tasks too, one per archive; all are unpacked by one job. A compressed member can only be read
    front to back, so it is cut into parts here, which later tasks parse in parallel; a task holds one part in memory.
    The tags seen on the way spare the reader a pass of its own to discover columns. Archives and target are paths or
    URIs on storage every executor reaches. Parts are written under a temporary name and renamed, and the cuts do
    not depend on the attempt, so a retried or duplicated task leaves the same whole files. A
    record that a member leaves open at its end is counted and dropped. Members of several archives are reported as
    ``archive!member``.
    """
    tag, pattern, alone = entity.tag, entity.members, len(archives) == 1

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for archive in (a for batch in batches for a in batch["archive"]):
            members = list_members(archive, pattern)
            if members:
                yield pd.DataFrame({"archive": [archive] * len(members), "member": members})

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, target = at_storage(out_dir)
        store.create_dir(target, recursive=True)
        for archive, member in (pair for batch in batches for pair in zip(batch["archive"], batch["member"])):
            label = member if alone else f"{archive}!{member}"
            shelf, path = at_storage(archive)
            tags: set[str] = set()
            count = open_at_end = 0
            with shelf.open_input_file(path) as data, zipfile.ZipFile(data) as zf, zf.open(member) as source:
                pieces = split_records(_utf8_chunks(source), tag, part_bytes)
                while True:
                    try:
                        part = next(pieces)
                    except StopIteration as end:
                        open_at_end = end.value
                        break
                    draft = f"{target}/.{uuid.uuid4().hex}"
                    with store.open_output_stream(draft) as sink:
                        sink.write(part)
                    store.move(draft, f"{target}/{part_name(label, count)}")
                    tags |= _child_tags(part, tag)
                    count += 1
            yield pd.DataFrame({"member": [label], "parts": [count], "tags": [sorted(tags)], "truncated": [open_at_end]})

    listed = spark.createDataFrame([(a,) for a in archives], "archive string").repartitionByRange(max(len(archives), 1), "archive")
    members = [tuple(row) for row in listed.mapInPandas(find, "archive string, member string").collect()]
    if not members:
        return Staged({}, [], {})
    names = spark.createDataFrame(members, "archive string, member string")
    one_each = names.repartitionByRange(len(members), "archive", "member")
    done = one_each.mapInPandas(unpack, "member string, parts long, tags array<string>, truncated long").collect()
    # the reader's columns ignore case, so of two spellings the first is kept
    columns = {tag.lower(): tag for tag in sorted({t for r in done for t in r.tags}, reverse=True)}
    return Staged({r.member: r.parts for r in done}, sorted(columns.values()),
                  {r.member: r.truncated for r in done if r.truncated})


def read_entity(spark: SparkSession, path: str, entity: Entity,
                columns: Sequence[str] | None = None) -> tuple[DataFrame, Observation]:
    """All records of one entity as text columns; damaged records are counted and dropped.

    Give the ``columns`` that staging found; without them one extra pass over the files discovers
    the tags. A file is one task, which is why staging cuts large members. The observation yields ``records``, ``damaged`` and
    ``identified`` (records with an id) once the data has been written or counted.
    """
    options = {"rowTag": entity.tag, "nullValue": "", "mode": "PERMISSIVE",
               "columnNameOfCorruptRecord": CORRUPT, "ignoreNamespace": "true"}
    if columns is None:
        found = spark.read.format("xml").options(**options, inferSchema="false").load(path)
        columns = [c for c in found.columns if c != CORRUPT and not c.startswith("_")]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    schema.add(CORRUPT, T.StringType())
    raw = spark.read.format("xml").options(**options).schema(schema).load(path)
    counts = Observation()
    damaged = F.col(CORRUPT).isNotNull()
    # counting ids also keeps a data column in every plan: the reader refuses the damage column alone
    id_col = next((c for c in entity.ids if c in columns), columns[0])
    seen = raw.observe(counts, F.count("*").alias("records"), F.count_if(damaged).alias("damaged"),
                       F.count(id_col).alias("identified"))
    return seen.filter(~damaged).drop(CORRUPT), counts


def typed(df: DataFrame, entity: Entity) -> DataFrame:
    """Declared numbers and dates cast, everything else left as text."""
    numbers = {c.lower() for c in entity.numbers}
    dates = {c.lower() for c in entity.dates}

    def convert(name: str):
        col = F.col(name)
        if name.lower() in numbers:
            return to_number(col).alias(name)
        if name.lower() in dates:
            return to_iso_date(col).alias(name)
        return F.nullif(F.trim(col), F.lit("")).alias(name)

    return df.select(*[convert(c) for c in df.columns])


def dedup(df: DataFrame, ids: Sequence[str], order: str | None = None) -> DataFrame:
    """One row per id, the last updated; on equal dates the greatest row, so the pick is stable.

    A maximum over structs combines before the shuffle: copies of one id cost one row per task.
    """
    rest = [c for c in df.columns if c not in (*ids, order)]
    fields = [order, *rest] if order else rest
    if not fields:
        return df.distinct()
    best = df.groupBy(*ids).agg(F.max(F.struct(*fields)).alias("_row"))
    return best.select(*ids, "_row.*").select(*df.columns)


def write_entity(df: DataFrame, entity: Entity, out_dir: str, rows_per_file: int = 5_000_000) -> str:
    """Snappy Parquet below ``out_dir``, hive-partitioned when the entity declares it.

    Adaptive rebalancing by partition column gives few, even files and splits a state that holds
    most of the rows over several writers.
    """
    target = f"{out_dir}/{entity.key}.parquet"
    parts = [c for c in entity.partition_by if c in df.columns]
    shaped = df.hint("rebalance", *parts) if parts else df
    writer = (shaped.write.mode("overwrite").option("compression", "snappy")
              .option("maxRecordsPerFile", rows_per_file))
    if parts:
        writer = writer.partitionBy(*parts)
    writer.parquet(target)
    return target
