"""Driver-side control: settings, backend choice, batches with resume, staged commits.

Nothing here touches rows; it decides which DataFrame plans run, and records what ran.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections import defaultdict
from collections.abc import Callable, Iterable, Mapping
from dataclasses import asdict, dataclass, field, fields
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    """Thresholds and limits; out-of-range values raise."""

    top_k: int = 5
    high: float = 0.90
    medium: float = 0.80
    page_match: float = 0.15
    max_lines: int = 300
    batch_size: int = 20

    def __post_init__(self):
        for f in fields(self):
            v = getattr(self, f.name)
            if isinstance(v, bool) or not isinstance(v, (int, float)):
                raise ValueError(f"{f.name} must be a number")
        if not 0 <= self.medium <= self.high <= 1 or not 0 <= self.page_match <= 1:
            raise ValueError("thresholds must satisfy 0 <= medium <= high <= 1 and 0 <= page_match <= 1")
        if min(self.top_k, self.max_lines, self.batch_size) < 1:
            raise ValueError("counts must be positive")


def resolve_settings(*layers: Mapping[str, object]) -> Settings:
    """Defaults, then each layer's values over the ones before; unknown names raise."""
    merged: dict[str, object] = {}
    for layer in layers:
        merged.update({k: v for k, v in layer.items() if v is not None})
    return Settings(**merged)  # type: ignore[arg-type]


def identity(value: object) -> str:
    """SHA-256 of canonical JSON: a configuration's identity."""
    plain = asdict(value) if isinstance(value, Settings) else value
    return hashlib.sha256(json.dumps(plain, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def endpoint_identity(url: str) -> str:
    """Scheme, host and path of a service address in one spelling; no credentials, query or fragment."""
    p = urlsplit(url.strip())
    if p.scheme not in ("http", "https") or not p.hostname or p.username or p.query or p.fragment:
        raise ValueError("an endpoint is http(s)://host[:port][/path]")
    port = f":{p.port}" if p.port and p.port != {"http": 80, "https": 443}[p.scheme] else ""
    return f"{p.scheme}://{p.hostname.lower()}{port}{p.path.rstrip('/')}"


def resolve_backend(requested: str, *, endpoint: str | None, model: str | None, dimension: int | None, cached_dimension: int | None) -> tuple[str, str]:
    """(backend, reason). Whatever is missing or does not fit falls back to token sets."""
    if requested != "embedding":
        return "jaccard", "not_requested"
    for value, reason in ((endpoint, "endpoint_missing"), (model, "model_missing"), (dimension, "dimension_missing"), (cached_dimension, "cache_missing")):
        if value is None:
            return "jaccard", reason
    try:
        endpoint_identity(endpoint or "")
    except ValueError:
        return "jaccard", "endpoint_invalid"
    return ("embedding", "ready") if dimension == cached_dimension else ("jaccard", "dimension_mismatch")


def with_fallback(first: Callable[[], DataFrame], second: Callable[[], DataFrame], probe: Callable[[DataFrame], object] = DataFrame.count) -> tuple[DataFrame, str]:
    """The first plan if it runs, else the second one, whole."""
    try:
        df = first()
        probe(df)
        return df, "first"
    except Exception as error:  # any failure of the first backend restarts on the second
        return second(), f"fallback: {type(error).__name__}"


#: Fixed values of the contract: the two splits, in the order in which a lineage's hash chooses by its
#: parity; lineages of more strata come first, then by hash, then by name.
SPLITS = ("calibration", "holdout")


def _hash(lineage: str) -> str:
    return hashlib.sha256(lineage.encode()).hexdigest()


def split_lineages(strata: Iterable[tuple[str, str]]) -> dict[str, str]:
    """lineage -> calibration or holdout, so that every stratum that at least two lineages cover has
    both: of all such assignments the one in which the first lineages get what their hash prefers.

    Two-colouring by propagation: a stratum that has one colour so far and one lineage open fixes
    that lineage. A free choice that ends in a contradiction is undone on a trail and turned over."""
    of, members = defaultdict(set), defaultdict(set)
    for lineage, stratum in strata:
        of[lineage].add(stratum)
        members[stratum].add(lineage)
    order = sorted(of, key=lambda x: (-len(of[x]), _hash(x), x))
    shared = {s for s, own in members.items() if len(own) > 1}
    # of each shared stratum: how many lineages have each colour, and how many are open
    tally = {s: [0, 0, len(members[s])] for s in shared}
    colour: dict[str, int] = {}
    trail: list[tuple[str, bool]] = []

    def fix(lineage: str, c: int, free: bool) -> bool:
        """Colour a lineage and all that follows; False if a stratum is left with one colour."""
        todo = [(lineage, c, free)]
        while todo:
            x, c, choice = todo.pop()
            if x in colour:
                if colour[x] != c:
                    return False
                continue
            colour[x] = c
            trail.append((x, choice))
            sound = True
            for s in of[x] & shared:
                tally[s][c] += 1
                tally[s][2] -= 1
                sound = sound and (tally[s][2] > 0 or min(tally[s][:2]) > 0)
                if tally[s][2] == 1 and min(tally[s][:2]) == 0:
                    missing = 0 if tally[s][0] == 0 else 1
                    todo += [(y, missing, False) for y in members[s] if y not in colour]
            if not sound:
                return False
        return True

    at = 0
    while at < len(order):
        if order[at] in colour:
            at += 1
            continue
        sound = fix(order[at], int(_hash(order[at]), 16) % 2, True)
        while not sound:
            while trail:
                x, choice = trail.pop()
                c = colour.pop(x)
                for s in of[x] & shared:
                    tally[s][c] -= 1
                    tally[s][2] += 1
                if choice:
                    break
            else:
                raise ValueError("no split covers every stratum twice")
            at = 0
            sound = fix(x, 1 - c, False)
    return {x: SPLITS[colour[x]] for x in order}


class BudgetExceeded(RuntimeError):
    """A run stops before the batch that would go beyond a budget; its state says where."""


@dataclass
class BatchState:
    """What ran: batch number -> status, row number -> status for the rows of split batches, and what
    was spent over all calls; kept as JSON beside the results."""

    manifest: str
    done: dict[int, str]
    single: dict[int, str] = field(default_factory=dict)
    spent: dict[str, float] = field(default_factory=dict)

    def save(self, spark: SparkSession, path: str) -> None:
        from lexmill.sources.sinks import replace_jsonl

        rows = [("batch", int(k), v, None) for k, v in sorted(self.done.items())] + [("row", int(k), v, None) for k, v in sorted(self.single.items())]
        rows += [("spent", None, k, float(v)) for k, v in sorted(self.spent.items())]
        replace_jsonl(spark.createDataFrame([(self.manifest, *r) for r in rows], _STATE).coalesce(1), path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, manifest: str) -> BatchState:
        from lexmill.sources.sinks import _fs

        fs, p = _fs(spark, path)
        if not fs.exists(p):
            return cls(manifest, {})
        rows = spark.read.schema(_STATE).json(path).collect()
        if any(r["manifest"] != manifest for r in rows):
            raise ValueError("the inputs changed since the last run")
        of = lambda kind: {r["n"]: r["status"] for r in rows if r["kind"] == kind}
        return cls(manifest, of("batch"), of("row"), {r["status"]: r["amount"] for r in rows if r["kind"] == "spent"})


_STATE = "manifest string, kind string, n long, status string, amount double"


def run_batches(
    spark: SparkSession,
    rows: DataFrame,
    work: Callable[[DataFrame], None],
    *,
    key: str,
    size: int,
    state_path: str,
    most_failures: int = 3,
    split: bool = False,
    most_calls: int | None = None,
    most_replays: int | None = None,
    most_seconds: float | None = None,
    clock: Callable[[], float] = time.monotonic,
) -> BatchState:
    """Rows in batches of ``size`` by key order; finished batches are skipped on the next call, so a run
    that was cut off goes on where it stopped. A failed batch is recorded and the next one runs, until
    ``most_failures`` failed in this call. With ``split`` the rows of a failed batch then run one by one,
    and only those that fail by themselves stay open.

    Budgets hold over all calls on one state: ``most_calls`` of ``work``, ``most_replays`` of them for
    what failed before, ``most_seconds``. A call is counted and saved before it is made; the one that
    would go beyond raises BudgetExceeded instead."""
    from lexmill.sources.files import numbered

    cut = numbered(rows, key).withColumn("batch", F.floor((F.col("n") - 1) / size).cast("int")).persist()
    try:
        manifest = cut.agg(F.count("*").alias("n"), F.sum(F.crc32(F.col(key).cast("string").cast("binary"))).alias("h")).first()
        state = BatchState.load(spark, state_path, f"{manifest['n']}:{manifest['h']}:{size}")
        before, began, failures = state.spent.get("seconds", 0.0), clock(), 0

        def attempt(part: DataFrame, book: dict[int, str], n: int) -> bool:
            replay = n in book
            want = {"calls": state.spent.get("calls", 0) + 1, "replays": state.spent.get("replays", 0) + replay, "seconds": before + clock() - began}
            for name, most in (("calls", most_calls), ("replays", most_replays), ("seconds", most_seconds)):
                if most is not None and want[name] > most:
                    state.spent["seconds"] = want["seconds"]
                    state.save(spark, state_path)
                    raise BudgetExceeded(f"more than {most} {name}")
            state.spent.update(want)
            book[n] = "running"
            state.save(spark, state_path)
            try:
                work(part.drop("n", "batch"))
                book[n] = "done"
            except Exception as error:  # recorded, and retried by the next call
                book[n] = f"failed: {type(error).__name__}"
            state.spent["seconds"] = before + clock() - began
            state.save(spark, state_path)
            return book[n] == "done"

        for b in range(-(-manifest["n"] // size)):
            if state.done.get(b) == "done":
                continue
            if state.done.get(b) != "split":
                if attempt(cut.where(F.col("batch") == b), state.done, b):
                    continue
                failures += 1
                last = min((b + 1) * size, manifest["n"])
                if split and last - b * size > 1:
                    state.done[b] = "split"
            if state.done[b] == "split":
                of = range(b * size + 1, min((b + 1) * size, manifest["n"]) + 1)
                for n in of:
                    if state.single.get(n) != "done" and failures < most_failures:
                        failures += not attempt(cut.where(F.col("n") == n), state.single, n)
                if all(state.single.get(n) == "done" for n in of):
                    state.done[b] = "done"
                state.save(spark, state_path)
            if failures >= most_failures:
                break
        return state
    finally:
        cut.unpersist()


def preflight(plans: Mapping[str, DataFrame]) -> dict[str, dict[str, object]]:
    """What each plan would do, without running it: its schema and the optimizer's size estimate."""
    out = {}
    for name, df in plans.items():
        stats = df._jdf.queryExecution().optimizedPlan().stats()
        out[name] = {"columns": df.columns, "bytes": int(str(stats.sizeInBytes()))}
    return out


def generate(rows: DataFrame, schema: str, generator: Callable[[dict], dict] | None = None) -> DataFrame:
    """Rows through a generator (identity by default), in Arrow batches on the executors."""
    if generator is None:
        return rows

    def run(frames):
        import pandas as pd

        for pdf in frames:
            yield pd.DataFrame([generator(r) for r in pdf.to_dict("records")])

    return rows.mapInPandas(run, schema)


def embed(texts: DataFrame, client: Callable[[list[str]], list[list[float]]], *, most_texts: int = 8, most_chars: int = 70_000) -> DataFrame:
    """input_hash, vector for distinct (input_hash, text), in requests of bounded size; a reply of another length,
    or with a vector that is not finite or all noughts, raises."""

    def run(frames):
        import numpy as np
        import pandas as pd

        for pdf in frames:
            batch, size, out = [], 0, []

            def send(batch, out):
                vectors = client([t for _, t in batch])
                if len(vectors) != len(batch) or not all(np.isfinite(v).all() and np.any(v) for v in vectors):
                    raise ValueError("a reply does not fit its request")
                out += [(h, list(map(float, v))) for (h, _), v in zip(batch, vectors, strict=True)]

            for h, t in zip(pdf.input_hash, pdf.text, strict=True):
                if batch and (len(batch) == most_texts or size + len(t) > most_chars):
                    send(batch, out)
                    batch, size = [], 0
                batch.append((h, t))
                size += len(t)
            if batch:
                send(batch, out)
            yield pd.DataFrame(out, columns=["input_hash", "vector"])

    return texts.select("input_hash", "text").mapInPandas(run, "input_hash string, vector array<double>")
