"""An audit log of many appends: parts, packing of small ones, and what of it is read.

A log is a folder. An append adds parts whose names begin with the time, so names are the order of the log.
`compact_audit` packs runs of small parts into files below `_packed` and then publishes a list, a numbered
folder below `_list`, that names the packed files and the parts they cover. The newest list decides: readers
take the parts that no packed file covers and the packed files that no other covers. A list appears by one
rename that fails if its number is taken, so of two compactions one wins, and a reader sees each line once
before, during and after. A packed file's name begins with that of its first part, so the order and the
place of every line stay. Covered parts stay until `vacuum_audit` removes them after a grace.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecloak.operators.prefix import running_total
from tablecloak.session import cut_lineage, local_rows
from tablecloak.sources.store import delete_path, exists, filesystem, publish_atomically

TARGET_BYTES = 128 << 20
#: Seconds after which no writer may still publish a part under an older name.
SETTLED = 3600
#: Seconds for which a reader may still hold files of an older list.
GRACE = 24 * 3600
LIST, PACKED, STAGING = "_list", "_packed", "_staging"
LISTED = "name string, role string"
#: Names of parts are at most about 100 bytes long.
BROADCAST_PARTS = 400_000
THREADS = 16


def append_audit(events: DataFrame, path: str) -> None:
    """Append one JSON line per event. Parts get their name when they are complete."""
    spark, run = events.sparkSession, uuid.uuid4().hex
    staging = f"{path}/{STAGING}/{run}"
    events.write.json(staging)
    fs, folder = filesystem(spark, staging)
    stamp = f"{time.time_ns() // 1000:020d}-{run[:12]}"
    parts = sorted(s.getPath().getName() for s in fs.listStatus(folder)
                   if s.getPath().getName().startswith("part-") and s.getLen() > 0)
    for k, name in enumerate(parts):
        _rename(spark, f"{staging}/{name}", f"{path}/{stamp}-{k:05d}.json")
    delete_path(spark, staging)


def _rename(spark: SparkSession, source: str, target: str) -> None:
    fs, a = filesystem(spark, source)
    if not fs.rename(a, filesystem(spark, target)[1]):
        raise OSError(f"could not rename {source} to {target}")


def _shown(spark: SparkSession, folder: str) -> list:
    """Files of a folder that are not hidden."""
    fs, p = filesystem(spark, folder)
    if not fs.exists(p):
        return []
    return [s for s in fs.listStatus(p) if not s.isDirectory() and s.getPath().getName()[0] not in "._"]


def _versions(spark: SparkSession, path: str) -> list[int]:
    fs, p = filesystem(spark, f"{path}/{LIST}")
    if not fs.exists(p):
        return []
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit())


def _listed(spark: SparkSession, path: str, version: int) -> dict[str, set[str]]:
    out = {"packed": set(), "covered": set()}
    if version:
        for r in spark.read.schema(LISTED).parquet(f"{path}/{LIST}/{version:09d}").collect():
            out[r.role].add(r.name)
    return out


def live_files(spark: SparkSession, path: str) -> list[str] | None:
    """Files of a compacted log that hold its lines, in order; None for a log that was never compacted.
    The list is read before the folder, so a part that is covered meanwhile is still there."""
    versions = _versions(spark, path)
    if not versions:
        return None
    listed = _listed(spark, path, versions[-1])
    parts = {s.getPath().getName() for s in _shown(spark, path)} - listed["covered"]
    packed = listed["packed"] - listed["covered"]
    return [f"{path}/{PACKED}/{n}" if n in packed else f"{path}/{n}" for n in sorted(parts | packed)]


def pack_plan(parts: DataFrame, target: int) -> DataFrame:
    """`name, bin` of the parts to pack, from `name, length, small`: runs of small neighbours in the order
    of names, of about `target` bytes, from two parts on. A part that is not small ends a run."""
    sized = parts.select("name", F.when(F.col("small"), F.col("length")).otherwise(0).alias("bytes"),
                         (~F.col("small")).cast("bigint").alias("wall"))
    placed = running_total(running_total(sized, ["name"], "bytes", "at"), ["name"], "wall", "run")
    bins = placed.filter("wall = 0").withColumn("cell", F.floor(F.col("at") / target))
    first = bins.groupBy("run", "cell").agg(F.min("name").alias("bin"), F.count("*").alias("n")).filter("n > 1")
    return bins.join(first, ["run", "cell"]).select("name", "bin")


def compact_audit(spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES, settled: float = SETTLED) -> int:
    """Pack small parts that are older than `settled` seconds; returns how many parts were covered. Another
    compaction that publishes first wins, and nothing is covered by this one."""
    version = (_versions(spark, path) or [0])[-1]
    listed = _listed(spark, path, version)
    limit = (time.time() - settled) * 1000
    found = []
    for folder, wanted in ((path, None), (f"{path}/{PACKED}", listed["packed"])):
        for s in _shown(spark, folder):
            name = s.getPath().getName()
            if name not in listed["covered"] and (wanted is None or name in wanted):
                found.append((name, s.getPath().toString(), s.getLen(),
                              s.getLen() < target_bytes / 2 and s.getModificationTime() <= limit))
    if not found:
        return 0
    parts = local_rows(spark, found, "name string, path string, length bigint, small boolean")
    plan = cut_lineage(pack_plan(parts, target_bytes).join(parts.select("name", "path"), "name"))
    chosen = plan.collect()
    if not chosen:
        return 0
    run = uuid.uuid4().hex
    staging = f"{path}/{STAGING}/{run}"
    _write_packed(spark, [r.path for r in chosen], plan.select("name", "bin"), len({r.bin for r in chosen}), staging)
    packed = []
    fs, folder = filesystem(spark, staging)
    for s in fs.listStatus(folder):
        if s.isDirectory():
            (file,) = [f.getPath() for f in fs.listStatus(s.getPath()) if f.getPath().getName().startswith("part-")]
            name = f"{_value(s.getPath().getName()).split('~')[0]}~{run[:12]}"
            fs.mkdirs(filesystem(spark, f"{path}/{PACKED}")[1])
            _rename(spark, file.toString(), f"{path}/{PACKED}/{name}")
            packed.append(name)
    covered = listed["covered"] | {r.name for r in chosen}
    live = (listed["packed"] - covered) | set(packed)
    if not _publish(spark, path, version + 1, live, covered, run):
        for name in packed:
            delete_path(spark, f"{path}/{PACKED}/{name}")
        return 0
    delete_path(spark, staging)
    return len(chosen)


def _value(folder: str) -> str:
    """The value in a folder name `bin=<value>` of Spark's, whose odd characters are `%XX`."""
    from urllib.parse import unquote

    return unquote(folder.split("=", 1)[1])


def _write_packed(spark: SparkSession, paths: Sequence[str], plan: DataFrame, bins: int, staging: str) -> None:
    """One file for each bin, its lines in the order of parts and of their places. A bin has a bounded size."""
    lines = (spark.read.option("lineSep", "\n").text(list(paths))
             .select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("name"),
                     F.col("_metadata.file_block_start").alias("block"), "value")
             .withColumn("pos", F.monotonically_increasing_id()))
    few = len(paths) <= BROADCAST_PARTS
    (lines.join(F.broadcast(plan) if few else plan, "name")
     .repartition(bins, "bin").sortWithinPartitions("bin", "name", "block", "pos")
     .select("value", "bin").write.partitionBy("bin").option("lineSep", "\n").text(staging))


def _publish(spark: SparkSession, path: str, version: int, packed: set[str], covered: set[str], run: str) -> bool:
    rows = [(n, "packed") for n in sorted(packed)] + [(n, "covered") for n in sorted(covered)]
    staging = f"{path}/{STAGING}/{run}-list"
    local_rows(spark, rows, LISTED).coalesce(1).write.parquet(staging)
    try:
        publish_atomically(spark, staging, f"{path}/{LIST}/{version:09d}")
    except FileExistsError:
        delete_path(spark, staging)
        return False
    return True


def vacuum_audit(spark: SparkSession, path: str, grace: float = GRACE) -> int:
    """Remove covered files that no list younger than `grace` seconds was the first to cover, packed files that
    nothing names, and older lists; returns how many files went. A run that stops half-way is finished by the next."""
    limit = (time.time() - grace) * 1000
    versions = _versions(spark, path)
    fs, folder = filesystem(spark, f"{path}/{LIST}")
    old = [v for v in versions if fs.getFileStatus(filesystem(spark, f"{folder}/{v:09d}")[1]).getModificationTime() <= limit]
    if not old:
        return 0
    newest, gone = _listed(spark, path, versions[-1]), _listed(spark, path, old[-1])["covered"]
    known = newest["packed"] | newest["covered"]
    there = {f"{path}/{s.getPath().getName()}": s for s in _shown(spark, path)}
    there |= {f"{path}/{PACKED}/{s.getPath().getName()}": s for s in _shown(spark, f"{path}/{PACKED}")}
    doomed = [full for full, s in there.items() if s.getPath().getName() in gone or (
        f"/{PACKED}/" in full and s.getPath().getName() not in known and s.getModificationTime() <= limit)]
    with ThreadPoolExecutor(THREADS) as pool:
        list(pool.map(lambda p: delete_path(spark, p), doomed))
    if gone and versions[-1] == old[-1]:  # names that are gone need no longer be listed
        _publish(spark, path, versions[-1] + 1, newest["packed"] - newest["covered"], newest["covered"] - gone, uuid.uuid4().hex)
    for v in versions[:-1]:
        if v in old and v != old[-1]:
            delete_path(spark, f"{path}/{LIST}/{v:09d}")
    return len(doomed)


def log_files(spark: SparkSession, path: str) -> int:
    """How many files a reader of the log opens."""
    live = live_files(spark, path) if exists(spark, path) else []
    return len(_shown(spark, path)) if live is None else len(live)
