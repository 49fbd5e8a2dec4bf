"""Row ranges of archives, tar shards and broken examples."""

import gzip
import io
import os
import struct
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.sources import archives, seeking, shards


class Counting(io.BytesIO):
    """A file that counts what is read of it."""

    read_bytes = 0

    def read(self, n=-1):
        data = super().read(n)
        self.read_bytes += len(data)
        return data


def matrix(key, values, kind="FM"):
    data = np.asarray(values, {"F": "<f4", "D": "<f8"}[kind[0]])
    sizes = b"".join(b"\4" + struct.pack("<i", n) for n in data.shape)
    return key.encode() + b" \0B" + kind.encode() + b" " + sizes + data.tobytes()


def packed(key, codes, marks, low, span):
    n, width = codes.shape
    return key.encode() + b" \0BCM " + struct.pack("<ffii", low, span, n, width) + marks.astype("<u2").tobytes() + codes.T.astype(np.uint8).tobytes()


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    """Two archives of all kinds of entries, with their values."""
    rng = np.random.default_rng(1)
    values = {"long": rng.normal(size=(5000, 8)).astype(np.float32), "wide": rng.normal(size=(3, 40)), "none": np.zeros((0, 4), np.float32), "vec": rng.normal(size=7).astype(np.float32)}
    codes, marks = rng.integers(0, 256, (300, 5)), np.sort(rng.integers(0, 65536, (5, 4)), axis=1)
    one = matrix("long", values["long"]) + matrix("wide", values["wide"], "DM") + matrix("none", values["none"]) + matrix("vec", values["vec"], "FV")
    two = packed("packed", codes, marks, -1.0, 4.0) + b"text  [\n 1 2 3\n 4 5 6\n 7 8 9 ]\n" + matrix("last", [[1.0, 2.0]])
    folder = tmp_path_factory.mktemp("archives")
    (folder / "a.ark").write_bytes(one)
    (folder / "b.ark").write_bytes(two)
    return folder, {k: np.atleast_2d(v) for k, _, _, v in archives.entries(one + two)}


def table_of(df):
    out = {}
    for r in df.collect():
        out[r["key"], r["row"]] = r["feat"]
    return out


def expected(values, keep=lambda key, row: True):
    return {(k, i): list(row) for k, v in values.items() for i, row in enumerate(v) if keep(k, i)}


def test_ranges_read_only_their_bytes(archive):
    folder, values = archive
    data = (folder / "a.ark").read_bytes()
    sizes = []
    for count in (1, 100, 5000):
        f = Counting(data)
        assert seeking.read_key(f) == "long"
        before = f.read_bytes
        first, found = seeking.read_entry(f, seeking.Span(3, 2 + count))
        assert first == 3 and np.array_equal(found, values["long"][3 : 3 + count])
        sizes.append(f.read_bytes - before)
        assert seeking.read_key(f) == "wide"  # the file is behind the entry
    assert sizes[0] == 15 + 32 and sizes[1] == 15 + 3200 and sizes[2] == 15 + 4997 * 32
    f = Counting((folder / "b.ark").read_bytes())
    seeking.read_key(f)
    before = f.read_bytes
    _, found = seeking.read_entry(f, seeking.Span(10, 19), seeking.Span(1, 2))
    assert found == pytest.approx(values["packed"][10:20, 1:3]) and f.read_bytes - before == 21 + 16 + 20
    f = Counting(data)
    assert [(k, r, c) for k, _, r, c in seeking.skim(f)] == [("long", 5000, 8), ("wide", 3, 40), ("none", 0, 4), ("vec", 1, 7)] and f.read_bytes < 150


def test_addresses():
    parse = seeking.Address.parse
    assert parse("ark:/x/a.ark:12[0:9,3:4]") == seeking.Address("/x/a.ark", 12, seeking.Span(0, 9), seeking.Span(3, 4))
    assert parse("scp,p:a.ark") == seeking.Address("a.ark") and parse("a:b.ark:7[,1:2]").cols == seeking.Span(1, 2)
    for bad in ("gunzip -c x |", "| x", "a.gz:5"):
        with pytest.raises(ValueError):
            parse(bad)
    assert seeking.Span(2, 5).inside(seeking.Span(10, 13)) == seeking.Span(12, 13) and seeking.Span(2).inside(seeking.Span(10)) == seeking.Span(12)


def test_source_without_index(spark, archive):
    folder, values = archive
    spark.dataSource.register(seeking.MatrixRows)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    rows = spark.read.format("matrix-rows").load(str(folder))
    got = table_of(rows)
    want = expected(values)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    for condition, keep in (("row = 2", lambda k, i: i == 2), ("row > 1 AND row <= 4", lambda k, i: 1 < i <= 4), ("key IN ('text', 'vec') AND row < 2", lambda k, i: k in ("text", "vec") and i < 2), ("key = 'packed' AND row >= 298", lambda k, i: k == "packed" and i >= 298), ("row BETWEEN 5 AND 3", lambda k, i: False), ("row IN (1, 3)", lambda k, i: i in (1, 3))):
        assert table_of(rows.where(condition)).keys() == expected(values, keep).keys(), condition


def test_source_with_index(spark, archive, tmp_path):
    """Splits of an index cover each entry once, wherever they are cut."""
    folder, values = archive
    index = {r["key"]: r for r in seeking.index_of(spark, str(folder)).collect()}
    assert {k: (r["rows"], r["cols"]) for k, r in index.items() if k != "text"} == {k: (len(v) if v.size else 0, v.shape[1] if v.size else 4) for k, v in values.items() if k != "text"}
    lines = [f"{k} {r['address']}" for k, r in index.items()] + [f"cut {index['long']['address']}[10:12,2:3]"]
    (tmp_path / "scp").write_text("\n".join(lines) + "\n")
    spark.dataSource.register(seeking.MatrixRows)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    want = expected(values | {"cut": values["long"][10:13, 2:4]})
    for split in (7, 60, 10_000):
        rows = spark.read.format("matrix-rows").option("index", True).option("split", split).load(str(tmp_path / "scp"))
        assert split > 1000 or rows.rdd.getNumPartitions() > 5
        got = rows.collect()
        assert len(got) == len(want) and all(r["feat"] == pytest.approx(want[r["key"], r["row"]]) for r in got)
    assert table_of(rows.where("key = 'cut' AND row >= 1")).keys() == {("cut", 1), ("cut", 2)}


def test_compressed_archives_are_streams(spark, archive, tmp_path):
    folder, values = archive
    with gzip.open(tmp_path / "a.ark.gz", "wb") as f:
        f.write((folder / "a.ark").read_bytes())
    spark.dataSource.register(seeking.MatrixRows)
    rows = spark.read.format("matrix-rows").load(str(tmp_path / "a.ark.gz")).where("row < 2")
    assert table_of(rows).keys() == expected({k: values[k] for k in ("long", "wide", "vec")}, lambda k, i: i < 2).keys()
    with pytest.raises(Exception, match="nothing-here"):
        spark.read.format("matrix-rows").load(str(tmp_path / "nothing-here")).count()


def test_shards_round_trip(spark, tmp_path):
    rows = spark.range(1000).select(F.format_string("utt.%04d", "id").alias("k"), (F.col("id") % 7).cast("string").alias("label"), F.when(F.col("id") % 5 != 0, F.repeat(F.lit("x"), (F.col("id") * 13 % 3000).cast("int")).cast("binary")).alias("wav"))
    table = shards.write_shards(rows, str(tmp_path / "s"), "k", {"txt": "label", "wav": "wav"}, 64)
    made = table.orderBy("path").collect()
    assert [r["examples"] for r in made] == [64] * 15 + [40] and sorted(os.listdir(tmp_path / "s")) == ["_shards", *[r["path"].rsplit("/", 1)[1] for r in made]]
    parsers = {"txt": ("int", lambda b: int(b)), "wav": ("bigint", len)}
    want = {r["k"]: (int(r["label"]), None if r["wav"] is None else len(r["wav"])) for r in rows.collect()}
    for source in (table, str(tmp_path / "s")):
        got = shards.examples(spark, source, parsers).collect()
        assert {r["key"]: (r["txt"], r["wav"]) for r in got} == want and len(got) == 1000 and not any(r["error"] for r in got)
    assert [r["key"] for r in shards.examples(spark, table.where(F.col("path").endswith("000000.tar")), parsers).collect()] != sorted(want)[:64]
    assert shards.write_shards(rows.where("false"), str(tmp_path / "t"), "k", {"txt": "label"}, 64).count() == 0


def test_broken_examples_are_listed(spark, tmp_path):
    def tar(name, members):
        with tarfile.open(tmp_path / name, "w") as t:
            for member, data in members:
                info = tarfile.TarInfo(member)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))

    tar("a.tar", [("x.1.txt", b"5"), ("x.1.wav", b"abc"), ("x.2.txt", b"five"), ("x.2.wav", b"abc"), ("odd", b"1"), ("x.3.wav", b""), ("x.1.txt", b"6")])
    tar("b.tar", [("y.txt", b"1"), ("z.txt", b"2" * 5000), ("w.txt", b"3")])
    (tmp_path / "b.tar").write_bytes((tmp_path / "b.tar").read_bytes()[:4000])
    (tmp_path / "c.tar").write_bytes(b"this is no archive" * 100)
    paths = spark.createDataFrame([(str(tmp_path / n),) for n in ("a.tar", "b.tar", "c.tar", "d.tar")], "path string")
    rows = shards.examples(spark, paths, {"txt": ("int", lambda b: int(b)), "wav": ("bigint", len)})
    good, failed, counts = shards.parted(rows, str(tmp_path / "out"))
    assert {(r["key"], r["txt"], r["wav"]) for r in good.collect()} == {("x.1", 5, 3), ("x.3", None, 0), ("x.1", 6, None), ("y", 1, None)} and good.count() == 4
    bad = {(os.path.basename(r["shard"]), r["key"]): r["error"] for r in failed.collect()}
    assert bad.keys() == {("a.tar", "x.2"), ("a.tar", "odd"), ("b.tar", "z"), ("c.tar", None), ("d.tar", None)} and "ValueError" in bad["a.tar", "x.2"]
    assert counts == {"good": 4, "failed": 5}
