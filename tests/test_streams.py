import os
import random

import pytest
from pyspark.sql import functions as F

from metaveil.functions.bytes import stripped, utf8
from metaveil.operators import binary, relations
from metaveil.sources import files, folder, pieces
from metaveil.streaming import jobs


def test_stream_of_answers_gives_what_the_table_gives(spark, tmp_path):
    rng = random.Random(3)
    answers = [(job, rng.randrange(12), f"r{rng.randrange(3)}") for job in range(6) for _ in range(15)]
    answers += answers[:20] + [(1, None, "x"), (None, 1, "x"), (2, 99, None)]
    rng.shuffle(answers)
    schema = "job long, request long, response string"
    for k in range(4):  # late and repeated ones come in any batch
        spark.createDataFrame(answers[k::4], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    told = jobs.last_operation(stream)
    query = told.writeStream.foreachBatch(lambda df, k: df.write.mode("append").parquet(f"file://{tmp_path}/out")).option("checkpointLocation", f"file://{tmp_path}/state")
    query = query.outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination(300)
    rows = spark.read.parquet(f"file://{tmp_path}/out").collect()
    last = {}
    for r in rows:
        assert (r.request, r.response) not in [(a.request, a.response) for a in rows if a is not r and a.job == r.job]  # told once
        last[r.job] = max(last.get(r.job, (-1, "")), (r.request, r.response))
    table = spark.createDataFrame([a for a in answers if None not in a], schema)
    assert {job: response for job, (_, response) in last.items()} == dict(relations.last_operation(table).collect())


def copies(spark, rows, parts=3):
    return spark.createDataFrame(rows, "name string, content binary").repartition(parts)


def test_copies_as_files_and_back(spark, tmp_path):
    folder.register(spark)
    rows = [(f"sub{k % 2}/{k}.bin", bytes([k]) * k) for k in range(9)] + [("empty", None)]
    path = f"file://{tmp_path}/out"
    copies(spark, rows).write.format("files").mode("append").save(path)
    back = {os.path.relpath(r.path.removeprefix("file:"), f"{tmp_path}/out"): bytes(r.content) for r in files.read(spark, path).collect()}
    assert back == {n: c for n, c in rows if c} and (tmp_path / "out/empty").read_bytes() == b""
    assert sorted(os.listdir(tmp_path / "out")) == ["empty", "sub0", "sub1"]
    copies(spark, [("empty", b"now")]).write.format("files").mode("overwrite").save(path)
    assert (tmp_path / "out/empty").read_bytes() == b"now" and (tmp_path / "out/sub1/1.bin").exists()


@pytest.mark.parametrize("rows", [[("a", b"1"), ("../b", b"2")], [("a", b"1"), ("a", b"2")], [("there", b"2"), ("c", b"1")]])
def test_a_failed_job_leaves_no_file(spark, tmp_path, rows):
    folder.register(spark)
    (tmp_path / "there").write_bytes(b"old")
    with pytest.raises(Exception):
        copies(spark, rows, 2).write.format("files").mode("append").save(f"file://{tmp_path}")
    assert os.listdir(tmp_path) == ["there"] and (tmp_path / "there").read_bytes() == b"old"


def test_a_format_of_ones_own(spark):
    def lines(data):
        if not data.startswith(b"#notes\n"):
            raise pieces.Broken("start")
        found, at = [], 0
        for line in data.splitlines(True):
            found.append(("author" if line.startswith(b"by ") else "line", 0, at, at, at + len(line)))
            at += len(line)
        return found

    told = lambda p: F.when(p["kind"] == "author", binary.found("author", "NOTES:by", "Author", stripped(utf8(F.substring(p["head"], 4, 99))), "high"))
    binary.register("notes", lines, binary.Format(told, lambda c, p: binary.cut(c, p, lambda x: x["kind"] != "author")))
    try:
        rows = spark.createDataFrame([(1, b"#notes\nby Ann\ntext\n"), (2, b"text")], "file_id int, content binary")
        got = {r.file_id: r for r in binary.clean_and_verify(rows, "notes").collect()}
        assert (got[1].clean, got[1].passed, got[1].raw) == (b"#notes\ntext\n", True, ["Ann"]) and got[2].status == "error"
        with pytest.raises(ValueError):
            binary.register("png", lines, binary.FORMATS["png"])
    finally:
        del binary.FORMATS["notes"], pieces.LISTERS["notes"]
