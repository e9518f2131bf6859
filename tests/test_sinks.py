"""Ledgers whose last writer died: what stays, what is cut, and what readers see at each step."""

import json
import os

import pyarrow.fs as pafs
import pytest

from lexmill.sources import sinks


def ledger(tmp_path, tail='{"k": 3'):
    folder = tmp_path / "ledger"
    folder.mkdir()
    (folder / "part-0.json").write_text('{"k": 1}\n{"k": 2}\n' + tail)
    return str(folder)


def keys(spark, path):
    return sorted(r["k"] for r in spark.read.schema("k long").option("mode", "DROPMALFORMED").json(path).collect())


class Dies(Exception):
    pass




@pytest.mark.parametrize("step", ["write", "delete", "move"])
def test_an_interruption_leaves_the_old_rows_or_the_new(spark, tmp_path, step):
    path = ledger(tmp_path)
    name = f"{path}/part-0.json"
    (tmp_path / "ledger" / ".part-0.json.crc").write_bytes(b"old")
    plain = pafs.LocalFileSystem()

    class Fs:
        def open_input_file(self, p):
            return plain.open_input_file(p)

        def open_output_stream(self, p):
            out = plain.open_output_stream(p)
            if step == "write":
                out.write(b'{"k": 1}\n')
                out.close()
                raise Dies
            return out

        def get_file_info(self, p):
            return plain.get_file_info(p)

        def delete_file(self, p):
            if step == "delete":
                raise Dies
            plain.delete_file(p)

        def move(self, a, b):
            if step == "move":
                raise Dies
            plain.move(a, b)

    with pytest.raises(Dies):
        sinks._cut_file(Fs(), name, 18)
    # the ledger reads as before, through Spark's own reader, and the next call mends it
    if os.path.exists(f"{path}/.part-0.json.crc"):
        os.remove(f"{path}/.part-0.json.crc")
    assert keys(spark, path) == [1, 2]
    assert sinks.cut_torn_tails(spark, path) == 1 and sinks.cut_torn_tails(spark, path) == 0
    assert spark.read.schema("k long").json(path).count() == 2
    assert not [x for x in os.listdir(path) if x.endswith(".cut")]


def test_append_cuts_first(spark, tmp_path):
    path = ledger(tmp_path)
    sinks.append_jsonl(spark.createDataFrame([(5,)], "k long"), path)
    assert spark.read.schema("k long").option("mode", "FAILFAST").json(path).count() == 3
    fresh = str(tmp_path / "fresh")
    sinks.append_jsonl(spark.createDataFrame([(1,)], "k long"), fresh)
    assert keys(spark, fresh) == [1]


def test_files_that_spark_wrote_can_be_cut_and_read(spark, tmp_path):
    path = str(tmp_path / "own")
    sinks.append_jsonl(spark.range(100).withColumnRenamed("id", "k").coalesce(1), path)
    part = next(x for x in os.listdir(path) if x.startswith("part-"))
    assert os.path.exists(f"{path}/.{part}.crc")
    with open(f"{path}/{part}", "ab") as f:
        f.write(b'{"k": 10')
    os.remove(f"{path}/.{part}.crc")
    assert sinks.cut_torn_tails(spark, path) == 1
    sinks.append_jsonl(spark.createDataFrame([(100,)], "k long"), path)
    assert keys(spark, path) == list(range(101))


def test_compressed_files_are_refused(spark, tmp_path):
    path = str(tmp_path / "packed")
    spark.range(5000).withColumnRenamed("id", "k").write.option("compression", "gzip").json(path)
    before = {x: os.path.getsize(f"{path}/{x}") for x in os.listdir(path)}
    with pytest.raises(ValueError, match="compressed"):
        sinks.cut_torn_tails(spark, path)
    assert before == {x: os.path.getsize(f"{path}/{x}") for x in os.listdir(path)} and len(keys(spark, path)) == 5000


def test_tails_of_any_length(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "COPY_BYTES", 7)
    for i, (body, want) in enumerate([("", 0), ("no line feed", 0), ("a\n" + "x" * 200_000, 2), ("a\nb\n", 4)]):
        file = tmp_path / f"f{i}.json"
        file.write_text(body)
        with pafs.LocalFileSystem().open_input_file(str(file)) as f:
            assert sinks._whole_lines(f, len(body)) == want
    rows = [{"k": i} for i in range(40)]
    path = ledger(tmp_path, "\n".join(map(json.dumps, rows)) + "\n{")
    assert sinks.cut_torn_tails(spark, path) == 1 and len(keys(spark, path)) == 42
