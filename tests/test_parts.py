import io
import zipfile

import pyarrow as pa
import pytest

from metaveil.sources.archives import entries, rebuilt
from metaveil.sources.pieces import PART, with_pieces

BODY = bytes(PART // 4)
SAMPLES = {
    "tiff": bytes.fromhex("49492A0008000000") + (1).to_bytes(2, "little") + bytes.fromhex("0001030001000000") + (1).to_bytes(4, "little") + bytes(4) + BODY,
    "png": bytes.fromhex("89504E470D0A1A0A") + len(BODY).to_bytes(4, "big") + b"IDAT" + BODY + bytes(8) + b"IEND" + bytes(4),
    "mkv": bytes.fromhex("1A45DFA380") + bytes.fromhex("1853806701") + (12 + len(BODY)).to_bytes(7, "big") + bytes.fromhex("1F43B67501") + len(BODY).to_bytes(7, "big") + BODY,
}


@pytest.fixture
def task(monkeypatch):
    """What a task runs over its batches, for a step over some rows."""

    def of(step, rows):
        with monkeypatch.context() as m:
            m.setattr(type(rows), "mapInArrow", lambda self, run, out: run)
            return step(rows)

    return of


@pytest.mark.parametrize("kind", SAMPLES)
def test_large_batches_are_listed_in_parts(spark, task, kind):
    run = task(lambda rows: with_pieces(rows, kind), spark.createDataFrame([], "content binary"))
    contents = [SAMPLES[kind]] * 40 + [None]
    made = list(run(iter([pa.RecordBatch.from_pydict({"content": pa.array(contents, pa.binary())})])))
    assert max(b.num_rows for b in made) <= 4 and sum(b.num_rows for b in made) == 41
    found = [p for b in made for p in b.column(1).to_pylist()]
    alone, empty = (next(run(iter([pa.RecordBatch.from_pydict({"content": pa.array([c], pa.binary())})]))).column(1).to_pylist()[0] for c in (contents[0], None))
    assert alone and found == [alone] * 40 + [empty]


ROW = "file_id long, entry_pos int, path string, is_folder boolean, stored boolean, content binary"


def test_archives_that_go_on_in_the_next_batch_are_whole(spark, task):
    run = task(rebuilt, spark.createDataFrame([], ROW))
    rows = [dict(file_id=k // 3, entry_pos=k % 3, path=f"{k % 3}.txt", is_folder=False, stored=True, content=b"%d" % k, dropped=False, status="ok", _place=k % 3 + 1) for k in range(3000)]
    batches = [pa.RecordBatch.from_pylist(rows[k : k + 700]) for k in range(0, 3000, 700)]
    made = list(run(iter(batches)))
    got = [r for b in made for r in b.to_pylist()]
    assert len(made) <= 5 and [r["file_id"] for r in got] == list(range(1000))
    for k, row in enumerate(got):
        with zipfile.ZipFile(io.BytesIO(row["content"])) as z:
            assert [z.read(i) for i in z.infolist()] == [b"%d" % (3 * k + n) for n in range(3)]


def test_entries_of_many_archives_make_one_batch(spark, task):
    run = task(entries, spark.createDataFrame([], "file_id long, content binary, mark int"))
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        z.writestr("a", b"x" * 100)
        z.writestr("b", b"y" * 100)
    files = {"file_id": list(range(500)), "content": pa.array([made.getvalue(), b"none"] * 250, pa.binary()), "mark": pa.array(range(500), pa.int32())}
    (batch,) = run(iter([pa.RecordBatch.from_pydict(files)]))
    got = [(r["file_id"], r["mark"], r["path"], r["status"]) for r in batch.to_pylist()]
    assert got == [x for k in range(500) for x in ([(k, k, "a", "ok"), (k, k, "b", "ok")] if k % 2 == 0 else [(k, k, None, "malformed")])]


def test_unpacked_contents_are_bounded(spark, task):
    run = task(entries, spark.createDataFrame([], "file_id long, content binary"))
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", bytes(PART // 2))
    files = {"file_id": list(range(20)), "content": pa.array([made.getvalue()] * 20, pa.binary())}
    assert [b.num_rows for b in run(iter([pa.RecordBatch.from_pydict(files)]))] == [2] * 10
