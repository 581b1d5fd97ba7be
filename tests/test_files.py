from metaveil.functions import formats
from metaveil.operators import archive, findings, svg
from metaveil.sources import files
from metaveil.streaming import ingest

SAMPLES = {
    "a.jpg": (bytes.fromhex("FFD8FFE000104A464946"), "jpeg", "ok"),
    "b.png": (bytes.fromhex("89504E470D0A1A0A") + b"x" * 20, "png", "ok"),
    "c.bmp": (b"BM" + bytes(12) + (40).to_bytes(4, "little"), "bmp", "ok"),
    "d.svg": (b"<?xml version='1.0'?>\n<svg width='1'></svg>", "svg", "ok"),
    "e.eml": (b"From: a@b.c\r\nTo: d@e.f\r\nSubject: x\r\n\r\nbody", "eml", "ok"),
    "f.txt": (b"plain text", None, "unsupported-format"),
    "h.mp3": (bytes.fromhex("FFFB900000"), "mp3", "ok"),
    "i.ico": (bytes.fromhex("000001000100") + bytes(8) + b"\1\0\0\0\x16\0\0\0x", "ico", "ok"),
}


def written(folder):
    for name, (content, _, _) in SAMPLES.items():
        (folder / name).write_bytes(content)
    return f"file://{folder}"


def test_files_are_detected_and_gated(spark, tmp_path):
    rows = files.read(spark, written(tmp_path)).collect()
    assert {r.file_name: (r.format, r.status) for r in rows} == {n: (f, s) for n, (_, f, s) in SAMPLES.items()}


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    (tmp_path / "in").mkdir()
    query = ingest.start(spark, written(tmp_path / "in"), f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    query.awaitTermination(120)
    got = {r.path.rpartition("/")[2]: (r.format, r.status) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert got == {n: (f, s) for n, (_, f, s) in SAMPLES.items()}


def test_active_images_are_refused(spark):
    texts = ["<svg onload='x()'/>", "<svg><script/></svg>", "<svg><a href='https://x'/></svg>", "<svg><!-- me --><title>T</title></svg>", "no image"]
    rows = spark.createDataFrame(list(enumerate(texts)), "file_id int, text string")
    got = {r.file_id: r for r in svg.clean_and_verify(rows).collect()}
    assert [got[i].passed for i in range(5)] == [False, False, False, True, False]
    assert got[3].clean == "<svg></svg>" and got[3].found_before == 2


def test_archive_gates(spark):
    entries = [(1, 0, "a/b.txt", 5, 5), (2, 0, "ok", 1, 1), (2, 1, "../up", 1, 1), (3, 0, "A//x", 1, 1), (3, 1, "a/./X", 1, 1), (4, 0, "big", 900, 1), (5, 0, "C:\\x", 1, 1), (6, 0, "x", 251 << 20, 251 << 20)]
    rows = spark.createDataFrame(entries, "file_id int, entry_pos int, path string, size long, file_length long")
    assert dict(archive.gates(rows).collect()) == {1: None, 2: "path-traversal", 3: "duplicate-path", 4: "zip-bomb", 5: "path-traversal", 6: "too-large"}


def test_leaks(spark):
    values = spark.createDataFrame([(1, "secret"), (1, "abc"), (1, "gone"), (2, "secret")], "file_id int, value string")
    copies = spark.createDataFrame([(1, "a secret abc"), (2, "clean")], "file_id int, clean string")
    assert findings.leaks(values, copies).collect() == [(1, 1)]


def test_every_format_has_a_limit(spark):
    rows = spark.createDataFrame([(n, m) for n, m, _ in formats.FORMATS], "format string, mib long")
    assert rows.where(formats.size_limit(rows["format"]) != rows["mib"] * formats.MIB).count() == 0
