"""The streaming compactor: every record once, retries replace, new files only."""

import os

import pytest
from pyspark.sql import functions as F

from skylattice.operators.tile_paths import tile_of
from skylattice.sources.tile_tree import tile_files, tile_index
from skylattice.streaming.compaction import _put_batch, compact_tile_tree, compact_tiles, copies

SCHEMA = "file_id long, scheme string, rel_path string, data binary, z int, digest string"
PATHS = [
    ("18/5/7.png", "xyz", (18, 5, 7)), ("./18/5/7.JPG", None, (18, 5, 7)), ("tiles/18//5/7.jpeg ", " XYZ", (18, 5, 7)), ("18\\5\\7.png", "xyz", (18, 5, 7)),
    ("18%2F5/7.png", "xyz", (18, 5, 7)), ("18/./9/../5/7.png", "xyz", (18, 5, 7)), ("018/005/0007.png", "xyz", (18, 5, 7)), ("2/1/0.png", "TMS ", (2, 1, 3)),
    ("18/x5/7.png", "xyz", None), ("18/5/7_old.png", "xyz", None), ("18/5/7.png.tmp", "xyz", None), ("18/5/._7.png", "xyz", None), ("5/7.png", "xyz", None),
    ("18/5/index.json", "xyz", None), ("", "xyz", None), (None, "xyz", None), ("../18/5/7.png", "weird", (18, 5, 7)), ("18/5/99999999999999999999.png", "xyz", None), ("18/5/٧.png", "xyz", None),
]


def test_paths(spark):
    df = spark.createDataFrame([(i, p, s) for i, (p, s, _) in enumerate(PATHS)], "i int, p string, s string")
    got = {r.i: r.t and tuple(r.t) for r in df.select("i", tile_of(F.col("p"), F.col("s")).alias("t")).collect()}
    assert got == {i: t for i, (_, _, t) in enumerate(PATHS)}


def rows(n, first=0):
    return [(first + i, None if i % 5 else "xyz", f"10/{i % 40}/{i % 7}.png", [b"", b"a", b"b" * 50, None][i % 4], None, "d") for i in range(n)]


def expected(all_rows):
    from collections import defaultdict

    g = defaultdict(list)
    for r in all_rows:
        if r[3] is not None:
            g[(r[2], r[3])].append(r[0])
    return g


def test_records_once_and_incremental(spark, tmp_path):
    src, out = f"file://{tmp_path}/src", f"file://{tmp_path}/out"
    a, b = rows(300), rows(300, 1000) + rows(5, 1000)  # the second delivery repeats rows
    spark.createDataFrame(a, SCHEMA).repartition(5).write.parquet(src)
    rec, mem = compact_tiles(spark, src, out, max_bytes_per_batch=6000)
    want = expected(a)
    assert rec.count() == len(want) and rec.select("z", "x", "y", "digest").distinct().count() == len(want)
    spark.createDataFrame(b, SCHEMA).repartition(3).write.mode("append").parquet(src)
    rec, mem = compact_tiles(spark, src, out, max_bytes_per_batch=6000)
    want = expected(a + b)
    assert rec.count() == len(want)
    assert mem.count() == sum(map(len, want.values()))
    pairs = {tuple(r) for r in copies(mem, rec).collect()}
    assert pairs == {(x, y) for v in want.values() for x in set(v) for y in set(v) if x < y}
    again, _ = compact_tiles(spark, src, out)
    assert again.count() == len(want)  # nothing new


def test_files_with_old_times_are_taken_up_too(spark, tmp_path):
    src, out = f"file://{tmp_path}/src", f"file://{tmp_path}/out"
    all_rows = []
    for run, days in enumerate((0, 30, 4000, 0)):
        before = set(os.listdir(tmp_path / "src")) if run else set()
        some = [(1000 * run + i, "xyz", f"9/{run}/{i}.png", b"%d" % i, None, "") for i in range(30)]
        spark.createDataFrame(some, SCHEMA).repartition(2).write.mode("append").parquet(src)
        for f in set(os.listdir(tmp_path / "src")) - before:
            t = os.stat(tmp_path / "src" / f).st_mtime - days * 86400
            os.utime(tmp_path / "src" / f, (t, t))
        all_rows += some
        rec, mem = compact_tiles(spark, src, out)
        assert rec.count() == mem.count() == len(all_rows)


def test_a_retried_batch_replaces(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    df = spark.createDataFrame(rows(100), SCHEMA)
    for _ in range(2):
        _put_batch(df, 0, out, 1 << 20)
    later = spark.createDataFrame(rows(120, 500), SCHEMA)
    for _ in range(3):
        _put_batch(later, 1, out, 1 << 20)
    got = spark.read.parquet(f"{out}/records")
    assert got.count() == len(expected(rows(100) + rows(120, 500)))
    assert got.groupBy("z", "x", "y", "digest").count().where("count > 1").count() == 0


def test_sizes_and_empty(spark, tmp_path):
    src, out = f"file://{tmp_path}/src", f"file://{tmp_path}/out"
    big = [(i, "xyz", f"9/{i}/1.png", bytes([i % 256]) * 4000, None, "") for i in range(64)]
    spark.createDataFrame(big, SCHEMA).repartition(32).write.parquet(src)
    compact_tiles(spark, src, out, target_bytes=64_000)
    files = [f for _, _, fs in os.walk(f"{tmp_path}/out/records") for f in fs if f.endswith(".parquet")]
    assert 2 <= len(files) <= 5
    none = f"file://{tmp_path}/none"
    spark.createDataFrame([], SCHEMA).write.parquet(none)
    rec, mem = compact_tiles(spark, none, f"file://{tmp_path}/out2")
    assert rec.count() == 0 and mem.count() == 0 and copies(mem, rec).count() == 0


@pytest.mark.parametrize("column", ["file_id", "scheme", "rel_path", "data"])
def test_null_columns(spark, tmp_path, column):
    src = f"file://{tmp_path}/src"
    df = spark.createDataFrame(rows(20), SCHEMA)
    df.withColumn(column, F.lit(None).cast(df.schema[column].dataType)).write.parquet(src)
    rec, _ = compact_tiles(spark, src, f"file://{tmp_path}/out")
    assert rec.count() == (0 if column != "scheme" else len(expected(rows(20))))


def test_a_batch_reads_only_the_strips_it_touches(spark, tmp_path):
    """Twelve batches over a tree walked column by column: the index read by the last is no larger than that of the first."""
    out, read = f"file://{tmp_path}/out", []
    for n in range(12):
        part = [(10 * n + i, "xyz", f"12/{n * 300}/{i}.png", b"%d" % n, None, "") for i in range(10)] + [(5, "xyz", "12/0/0.png", b"0", None, "")] * (n % 4 == 3)
        _put_batch(spark.createDataFrame(part, SCHEMA), n, out, 1 << 20)
        strip = 12 * 64 + n * 300 // 64
        read.append(len(list((tmp_path / "out" / "index" / f"strip={strip}").rglob("*.parquet"))))
    assert max(read) <= 4
    got = spark.read.parquet(f"{out}/records")
    assert got.count() == got.select("z", "x", "y", "digest").distinct().count() == 120


def test_a_tree_of_files(spark, tmp_path):
    root = tmp_path / "tree of +tiles %20"
    bodies = {"12/5/7.png": b"a", "12/5/8.JPG": b"b", "x/12/5/7.jpeg": b"a", "12/5/9.txt": b"c", "12/6/0.png": b"", "12/6/1 .png": b"d"}
    for name, body in bodies.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(body)
    files = tile_files(spark, str(root))
    assert {r.rel_path: r.n_bytes for r in files.drop("data").collect()} == {k: len(v) for k, v in bodies.items() if v}
    index = {r.rel_path: (r.tile_id, r.top_left_lon) for r in tile_index(files).collect()}
    assert set(index) == {"12/5/7.png", "12/5/8.JPG", "x/12/5/7.jpeg"} and index["12/5/8.JPG"] == ("12/5/8", 5 / 4096 * 360 - 180)
    rec, mem = compact_tile_tree(spark, str(root), f"file://{tmp_path}/out")
    assert {(r.x, r.y, bytes(r.data)) for r in rec.collect()} == {(5, 7, b"a"), (5, 8, b"b")} and mem.count() == 3
    (root / "12/7").mkdir()
    (root / "12/7/1.png").write_bytes(b"new")
    os.utime(root / "12/7/1.png", (1e9, 1e9))
    rec, mem = compact_tile_tree(spark, str(root), f"file://{tmp_path}/out")
    assert rec.count() == 3 and mem.count() == 4
    (tmp_path / "none").mkdir()
    assert tile_files(spark, str(tmp_path / "none")).count() == 0
