"""Sets of files that become visible together: data is written beside what is there, then one manifest names it all.

A manifest is a small JSON file from names to paths below the root. It is written under a hidden name and renamed, so it
is there as a whole or not at all, and readers go by the newest one. What no kept manifest names is garbage: the remains
of a run that died, or versions past their time. One writer at a time; any number of readers.
"""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger(__name__)

FOLDER, DATA = "manifests", "data"


def _store(spark: SparkSession, path: str):
    """The file system of a path, and a function to name paths on it."""
    jvm = spark._jvm
    make = jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def numbers(spark: SparkSession, root: str) -> list[int]:
    """Numbers of all manifests, oldest first."""
    fs, make = _store(spark, root)
    folder = make(f"{root}/{FOLDER}")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json") and not n.startswith("."))


def read(spark: SparkSession, root: str, number: int | None = None) -> tuple[int, dict[str, str]] | None:
    """Number and entries of a manifest, the newest by default; None if there is none."""
    found = numbers(spark, root)
    if not found:
        return None
    number = found[-1] if number is None else number
    fs, make = _store(spark, root)
    stream = fs.open(make(f"{root}/{FOLDER}/{number:012d}.json"))
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return number, json.loads(text)


def commit(spark: SparkSession, root: str, number: int, entries: Mapping[str, str]) -> None:
    """Makes the entries the current set. A number is committed once."""
    fs, make = _store(spark, root)
    target = make(f"{root}/{FOLDER}/{number:012d}.json")
    if fs.exists(target):
        raise FileExistsError(f"manifest {number} of {root} is there already")
    draft = make(f"{root}/{FOLDER}/.{uuid.uuid4().hex}")
    stream = fs.create(draft, True)
    try:
        stream.write(bytearray(json.dumps(dict(entries), sort_keys=True).encode()))
    finally:
        stream.close()
    if not fs.rename(draft, target):
        raise OSError(f"manifest {number} of {root} could not be renamed into place")


def expire(spark: SparkSession, root: str, keep: int) -> list[str]:
    """Drops all but the newest ``keep`` manifests, and every data folder that none of those names. Returns the folders.

    Not to be run beside a writer, whose folders no manifest names yet.
    """
    if keep < 1:
        raise ValueError("at least the current set must be kept")
    fs, make = _store(spark, root)
    found = numbers(spark, root)
    named = {path for n in found[-keep:] for path in read(spark, root, n)[1].values()}
    gone = []
    if fs.exists(make(f"{root}/{DATA}")):
        for version in fs.listStatus(make(f"{root}/{DATA}")):
            children = [f"{DATA}/{version.getPath().getName()}/{s.getPath().getName()}" for s in fs.listStatus(version.getPath())]
            dead = [c for c in children if c not in named]
            gone += dead
            if len(dead) == len(children):
                fs.delete(version.getPath(), True)
            else:
                for child in dead:
                    fs.delete(make(f"{root}/{child}"), True)
    for n in found[:-keep]:
        fs.delete(make(f"{root}/{FOLDER}/{n:012d}.json"), False)
    return gone


def next_folder(spark: SparkSession, root: str) -> tuple[int, str]:
    """Number of the next version, and a fresh folder for its data, as a path below the root."""
    number = (numbers(spark, root) or [0])[-1] + 1
    return number, f"{DATA}/{number:012d}-{uuid.uuid4().hex[:8]}"


def land(df: DataFrame, root: str, name: str) -> str:
    """Writes an output of the next version, which ``publish`` is to name, and returns its path below the root."""
    path = f"{next_folder(df.sparkSession, root)[1]}/{name}.parquet"
    df.write.parquet(f"{root}/{path}")
    return path


def publish(spark: SparkSession, root: str, plans: Mapping[str, Callable[[], DataFrame | None]],
            required: Sequence[str] | None = None, keep: int = 14, landed: Mapping[str, str] | None = None) -> dict[str, str]:
    """Writes all outputs as the next version and makes them current together; one status per output.

    Outputs are written side by side. If a required one (all by default) fails or has nothing, no manifest is written, so
    readers go on with the version before, whole. An output that is not required and fails is absent from the new set.
    Outputs that are there already, see ``land``, become current with the others.
    """
    number, folder = next_folder(spark, root)

    def write(name: str) -> str:
        try:
            df = plans[name]()
            if df is None:
                return "skipped"
            df.write.option("compression", "zstd").parquet(f"{root}/{folder}/{name}.parquet")
            return "written"
        except Exception as err:
            log.error("output %s failed: %s", name, str(err).splitlines()[0])
            return "failed"

    with ThreadPoolExecutor(max(len(plans), 1)) as pool:
        done = dict(zip(plans, pool.map(write, plans), strict=True))
    missing = [name for name in (plans if required is None else required) if done.get(name) != "written"]
    if missing:
        log.error("version %d is not published, it lacks %s", number, ", ".join(missing))
        return {name: "withheld" if status == "written" else status for name, status in done.items()}
    written = {name: f"{folder}/{name}.parquet" for name, status in done.items() if status == "written"}
    commit(spark, root, number, {**(landed or {}), **written})
    expire(spark, root, keep)
    return done


def published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """An output of the current version."""
    found = read(spark, root)
    if found is None or name not in found[1]:
        raise FileNotFoundError(f"{name} is not published below {root}")
    return spark.read.parquet(f"{root}/{found[1][name]}")
