"""Publishing folders: several outputs replaced as one, behind a lock and a confirmation.

Names and folders are handled here, on the driver; rows never are. Everything goes through Hadoop's
file systems, so that outputs may lie wherever Spark writes.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable, Iterable, Mapping
from contextlib import contextmanager
from datetime import UTC, datetime, timedelta

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexmill.sources.files import tree_hash
from lexmill.sources.sinks import _fs

#: Fixed values of the contract: how long a confirmation holds, what it says, and who may give it.
CONFIRMED_FOR = timedelta(hours=24)
CONFIRMED_AS = "automatic-summary-confirmation"
CONFIRMED_BY = "human:"

BEFORE, PLAN, LOCK = ".before", "plan.json", ".publish.lock"


@contextmanager
def locked(spark: SparkSession, folder: str):
    """Hold the folder's lock, a file that only one writer can create; raises BlockingIOError if another
    holds it. A writer that died leaves the file, which names its process, to be deleted by hand."""
    fs, at = _fs(spark, f"{folder.rstrip('/')}/{LOCK}")
    fs.mkdirs(at.getParent())
    try:
        if fs.getUri().getScheme() == "file":  # Hadoop's local files have no exclusive creation
            with os.fdopen(os.open(at.toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY), "w") as f:
                f.write(str(os.getpid()))
        else:
            fs.create(at, False).close()
    except Exception as error:
        if fs.exists(at):
            raise BlockingIOError(f"another writer holds {at}") from error
        raise
    try:
        yield
    finally:
        fs.delete(at, False)


def _move(fs, a, b) -> None:
    fs.mkdirs(b.getParent())
    if not fs.rename(a, b):
        raise OSError(f"cannot move {a} to {b}")


def _read(spark: SparkSession, path) -> str:
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = fs.open(path)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _write(fs, path, text: str) -> None:
    stream = fs.create(path, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def publish(spark: SparkSession, stage: str, output: str, names: Iterable[str], *, check: Callable[[], None] | None = None, move: Callable = _move) -> None:
    """Replace ``names`` below ``output`` by those below ``stage``; a name that the stage lacks goes.

    What is to be done is written down first, old folders are moved aside, new ones moved in, and ``check``
    may raise. Whatever fails, the old state comes back (``recover``), also after the driver's death, by the
    next call. Deleting the plan is the moment from which the new state holds."""
    recover(spark, stage, output)
    fs, _ = _fs(spark, output)
    at = lambda *parts: _fs(spark, "/".join(parts))[1]
    plan = {n: [fs.exists(at(output, n)), fs.exists(at(stage, n))] for n in dict.fromkeys(names)}
    if bad := [n for n in plan if n.startswith((".", "/")) or ".." in n.split("/")]:
        raise ValueError(f"no names of outputs: {bad}")
    _write(fs, at(stage, BEFORE, f"{PLAN}.new"), json.dumps(plan))
    _move(fs, at(stage, BEFORE, f"{PLAN}.new"), at(stage, BEFORE, PLAN))
    try:
        for name, (old, new) in plan.items():
            if old:
                move(fs, at(output, name), at(stage, BEFORE, "old", name))
            if new:
                move(fs, at(stage, name), at(output, name))
        if check:
            check()
    except BaseException:
        recover(spark, stage, output)
        raise
    fs.delete(at(stage, BEFORE, PLAN), False)
    fs.delete(at(stage, BEFORE), True)


def recover(spark: SparkSession, stage: str, output: str) -> bool:
    """Undo a publication that did not end: old outputs go back in place, new ones back into the stage.
    Returns whether there was one. Running it again, or after an interruption of itself, changes nothing more."""
    fs, plan = _fs(spark, f"{stage}/{BEFORE}/{PLAN}")
    at = lambda *parts: _fs(spark, "/".join(parts))[1]
    if not fs.exists(plan):
        fs.delete(at(stage, BEFORE), True)
        return False
    for name, (old, new) in reversed(json.loads(_read(spark, plan)).items()):
        kept = fs.exists(at(stage, BEFORE, "old", name))
        if new and not fs.exists(at(stage, name)) and (kept or not old):
            _move(fs, at(output, name), at(stage, name))
        if kept:
            _move(fs, at(stage, BEFORE, "old", name), at(output, name))
    fs.delete(plan, False)
    fs.delete(at(stage, BEFORE), True)
    return True


def folder_hash(spark: SparkSession, path: str) -> str | None:
    """Hash over the paths and contents of all files of a folder that are not hidden; null if there is none."""
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return None
    root = fs.makeQualified(at).toUri().getPath().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    relative = F.substring_index("path", f"{root}/", -1)
    return tree_hash(files.select(relative.alias("path"), F.sha2("content", 256).alias("content_hash"))).first()["tree_hash"]


def confirmed(confirmation: Mapping[str, object] | None, *, run_id: str, summary_sha256: str, now: datetime | None = None) -> bool:
    """Whether a person confirmed exactly this summary of this run within the last 24 hours."""
    now = now or datetime.now(UTC)
    if not confirmation or "human_reviewed" in confirmation or confirmation.get("meaning") != CONFIRMED_AS:
        return False
    if not str(confirmation.get("actor") or "").startswith(CONFIRMED_BY):
        return False
    try:
        when = datetime.fromisoformat(str(confirmation.get("confirmed_at")))
    except ValueError:
        return False
    if when.tzinfo is None or not now - CONFIRMED_FOR <= when <= now:
        return False
    return (confirmation.get("run_id"), confirmation.get("summary_sha256")) == (run_id, summary_sha256) and bool(re.fullmatch("[0-9a-f]{64}", summary_sha256))


def release(
    spark: SparkSession,
    candidate: str,
    formal: str,
    confirmation: Mapping[str, object] | None,
    *,
    run_id: str,
    summary_sha256: str,
    candidate_hash: str,
    formal_hash: str | None,
    now: datetime | None = None,
    move: Callable = _move,
) -> str:
    """Copy a confirmed candidate folder over the formal one: 'released', or 'not_released' and nothing changed.

    Hashes are those that the confirmation was given for (``formal_hash`` null: there was no formal
    folder). They are compared under the lock of the formal folder's parent, and once more for the
    copy, and for what stands in place at the end. If even the way back fails, the error is raised and the
    stage beside the formal folder keeps the old one for ``recover``."""
    if not confirmed(confirmation, run_id=run_id, summary_sha256=summary_sha256, now=now) or candidate.rstrip("/") == formal.rstrip("/"):
        return "not_released"
    parent, name = formal.rstrip("/").rsplit("/", 1)
    stage = f"{parent}/.release-{uuid.uuid4().hex}"
    fs = _fs(spark, formal)[0]
    source, copy = _fs(spark, candidate)[1], _fs(spark, f"{stage}/{name}")[1]

    def expect(path: str, want: str | None) -> None:
        if folder_hash(spark, path) != want:
            raise OSError(f"{path} is not what was confirmed")

    unfinished = False
    try:
        with locked(spark, parent):
            try:
                expect(formal, formal_hash)
                expect(candidate, candidate_hash)
                conf = spark.sparkContext._jsc.hadoopConfiguration()
                fs.mkdirs(copy.getParent())
                spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(source.getFileSystem(conf), source, fs, copy, False, conf)
                expect(f"{stage}/{name}", candidate_hash)
                publish(spark, stage, parent, [name], check=lambda: expect(formal, candidate_hash), move=move)
            finally:
                unfinished = fs.exists(_fs(spark, f"{stage}/{BEFORE}/{PLAN}")[1])
                if not unfinished:  # else it holds the old folder still
                    fs.delete(_fs(spark, stage)[1], True)
    except (OSError, Py4JJavaError):
        if not unfinished:
            return "not_released"
        raise
    return "released"
