"""Publication of several outputs, locks, confirmations, releases, batches with budgets: with interruptions."""

import hashlib
from datetime import UTC, datetime, timedelta

import pytest

from lexmill.plans import runner
from lexmill.sources import publish as P

NOW = datetime(2024, 5, 1, 12, tzinfo=UTC)
SUMMARY = hashlib.sha256(b"summary").hexdigest()
SAID = {"meaning": P.CONFIRMED_AS, "actor": "human:a", "confirmed_at": (NOW - timedelta(hours=1)).isoformat(), "run_id": "r1", "summary_sha256": SUMMARY}


def put(root, **files):
    for name, text in files.items():
        (root / name).mkdir(parents=True, exist_ok=True)
        (root / name / "page.md").write_text(text)


def state(root):
    return {p.relative_to(root).as_posix(): p.read_text() for p in sorted(root.rglob("*.md"))}


def setting(tmp_path):
    put(tmp_path / "out", a="old a", b="old b", gone="old")
    put(tmp_path / "stage", a="new a", b="new b", c="new c")
    return str(tmp_path / "stage"), str(tmp_path / "out")


def failing(after):
    """Moves of which the one after ``after`` others fails."""
    left = [after]

    def move(fs, a, b):
        if left[0] == 0:
            raise OSError("disk")
        left[0] -= 1
        P._move(fs, a, b)

    return move


def test_publish_replaces_adds_and_removes(spark, tmp_path):
    stage, out = setting(tmp_path)
    P.publish(spark, stage, out, ["a", "b", "c", "gone"])
    assert state(tmp_path / "out") == {"a/page.md": "new a", "b/page.md": "new b", "c/page.md": "new c"}
    assert not (tmp_path / "stage" / P.BEFORE).exists()
    assert not P.recover(spark, stage, out)
    with pytest.raises(ValueError, match="no names"):
        P.publish(spark, stage, out, ["../x"])


@pytest.mark.parametrize("after", range(6))
def test_whatever_move_fails_the_old_state_comes_back(spark, tmp_path, after):
    stage, out = setting(tmp_path)
    old, new = state(tmp_path / "out"), state(tmp_path / "stage")
    with pytest.raises(OSError, match="disk"):
        P.publish(spark, stage, out, ["a", "b", "c", "gone"], move=failing(after))
    assert (state(tmp_path / "out"), state(tmp_path / "stage")) == (old, new)
    P.publish(spark, stage, out, ["a", "b", "c"])
    assert state(tmp_path / "out") == {**old, **new}


def test_a_check_that_fails_undoes_all(spark, tmp_path):
    stage, out = setting(tmp_path)
    old = state(tmp_path / "out")

    def check():
        assert state(tmp_path / "out")["a/page.md"] == "new a"
        raise RuntimeError("not readable")

    with pytest.raises(RuntimeError, match="readable"):
        P.publish(spark, stage, out, ["a", "gone"], check=check)
    assert state(tmp_path / "out") == old


def test_a_dead_driver_is_undone_by_the_next_call(spark, tmp_path, monkeypatch):
    stage, out = setting(tmp_path)
    old = state(tmp_path / "out")
    recover = P.recover
    with monkeypatch.context() as m:
        m.setattr(P, "recover", lambda *a: False)  # nobody is left to undo it
        with pytest.raises(OSError):
            P.publish(spark, stage, out, ["a", "b", "c"], move=failing(3))
    assert state(tmp_path / "out") != old
    assert recover(spark, stage, out) and state(tmp_path / "out") == old
    assert not recover(spark, stage, out) and state(tmp_path / "out") == old


def test_one_holder_of_a_lock(spark, tmp_path):
    with P.locked(spark, str(tmp_path)):
        with pytest.raises(BlockingIOError), P.locked(spark, str(tmp_path)):
            pass
    with P.locked(spark, str(tmp_path)):
        pass


@pytest.mark.parametrize(
    "change",
    [{"meaning": "x"}, {"actor": "agent:a"}, {"run_id": "r2"}, {"summary_sha256": "0" * 64}, {"human_reviewed": True}, {"confirmed_at": "soon"}]
    + [{"confirmed_at": (NOW + timedelta(hours=h)).isoformat()} for h in (-25, 1)]
    + [{"confirmed_at": "2024-05-01T11:00:00"}],
)
def test_confirmations_that_do_not_hold(change):
    assert P.confirmed(SAID, run_id="r1", summary_sha256=SUMMARY, now=NOW)
    assert not P.confirmed({**SAID, **change}, run_id="r1", summary_sha256=SUMMARY, now=NOW)
    assert not P.confirmed(None, run_id="r1", summary_sha256=SUMMARY, now=NOW)


def released(spark, tmp_path, **change):
    candidate, formal = str(tmp_path / "candidate"), str(tmp_path / "kb" / "formal")
    args = {"confirmation": SAID, "candidate_hash": P.folder_hash(spark, candidate), "formal_hash": P.folder_hash(spark, formal)} | change
    return P.release(spark, candidate, formal, args.pop("confirmation"), run_id="r1", summary_sha256=SUMMARY, now=NOW, **args)


def test_release_swaps_what_was_confirmed(spark, tmp_path):
    put(tmp_path / "candidate", x="new")
    assert released(spark, tmp_path) == "released"  # no formal folder before
    put(tmp_path / "candidate", x="newer", y="more")
    for change in ({"confirmation": None}, {"candidate_hash": "0"}, {"formal_hash": None}, {"move": failing(0)}, {"move": failing(1)}):
        assert released(spark, tmp_path, **change) == "not_released"
        assert state(tmp_path / "kb" / "formal") == {"x/page.md": "new"}
    with P.locked(spark, str(tmp_path / "kb")):
        assert released(spark, tmp_path) == "not_released"
    assert released(spark, tmp_path) == "released"
    assert state(tmp_path / "kb" / "formal") == {"x/page.md": "newer", "y/page.md": "more"}
    assert [p.name for p in (tmp_path / "kb").iterdir()] == ["formal"]


def batches(spark, tmp_path, work, **kw):
    data = spark.createDataFrame([(i,) for i in range(6)], "k long")
    return runner.run_batches(spark, data, work, key="k", size=3, state_path=str(tmp_path / "state"), **kw)


def keys(df):
    return [r["k"] for r in df.orderBy("k").collect()]


def test_failed_batches_split_into_single_rows(spark, tmp_path):
    seen, broken = [], {1}

    def work(df):
        k = keys(df)
        seen.append(k)
        if broken & set(k):
            raise RuntimeError("x")

    s = batches(spark, tmp_path, work, split=True)
    assert s.done == {0: "split", 1: "done"} and s.single == {1: "done", 2: "failed: RuntimeError", 3: "done"}
    assert seen == [[0, 1, 2], [0], [1], [2], [3, 4, 5]]
    broken.clear()
    s = batches(spark, tmp_path, work, split=True)
    assert s.done == {0: "done", 1: "done"} and seen[5:] == [[1]]
    assert (s.spent["calls"], s.spent["replays"]) == (6, 1)


def test_budgets_stop_before_the_call_that_breaks_them(spark, tmp_path):
    seen = []
    with pytest.raises(runner.BudgetExceeded, match="1 calls"):
        batches(spark, tmp_path, lambda df: seen.append(keys(df)), most_calls=1)
    with pytest.raises(runner.BudgetExceeded, match="1 calls"):  # over all calls, not each
        batches(spark, tmp_path, lambda df: seen.append(keys(df)), most_calls=1)
    assert seen == [[0, 1, 2]]
    assert batches(spark, tmp_path, lambda df: seen.append(keys(df)), most_calls=2).done == {0: "done", 1: "done"}


def test_replays_and_seconds_are_bounded(spark, tmp_path):
    def broken(df):
        raise RuntimeError("x")

    assert set(batches(spark, tmp_path, broken).done.values()) == {"failed: RuntimeError"}
    with pytest.raises(runner.BudgetExceeded, match="1 replays"):
        batches(spark, tmp_path, broken, most_replays=1)
    ticks = iter(range(0, 1000, 50))
    with pytest.raises(runner.BudgetExceeded, match="60 seconds"):
        batches(spark, tmp_path, keys, most_seconds=60, clock=lambda: next(ticks))
