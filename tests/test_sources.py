import io
import tarfile
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tracewright.sources import archives, documents, sinks
from tracewright.streaming import heartbeats

DOCS = [("1", '{"a": 1, "s": ["x", 2, "y"]}'), ("2", "{bad"), ("3", "[1]"), ("4", None)]


def test_four_policies(spark):
    df = spark.createDataFrame(DOCS, "id string, json string")
    assert [r.id for r in documents.lenient(df, "json", "a int").collect()] == ["1"]
    got = {r.id: (r.load_status, r.load_error) for r in documents.marked(df, "json", "a int").collect()}
    assert got == {"1": ("ok", None), "2": ("unreadable", "invalid JSON"), "3": ("unreadable", "not an object"), "4": ("unreadable", "invalid JSON")}
    with pytest.raises(Exception, match="MALFORMED|Malformed|FAILFAST"):
        documents.strict(df, "json", "a int").select("doc").collect()
    lists = spark.createDataFrame([('["a", 1, null, "b"]',), ("{}",), (None,)], "j string")
    assert [r[0] for r in lists.select(documents.string_list(F.col("j"))).collect()] == [["a", "b"], [], []]


def pack(kind, files):
    out = io.BytesIO()
    if kind == "zip":
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in files:
                z.writestr(name, data)
    else:
        with tarfile.open(fileobj=out, mode="w:gz" if kind == "tgz" else "w") as t:
            for name, data in files:
                info = tarfile.TarInfo(name)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def test_archives(spark):
    rows = [
        ("a.zip", pack("zip", [("x/./a.js", b"1"), ("b.css", b"22")])),
        ("b.tgz", pack("tgz", [("c.html", b"333")])),
        ("c.zip", pack("zip", [("ok.js", b"1"), ("../up.js", b"2")])),
        ("d.zip", pack("zip", [("bomb", b"\0" * 1_000_000)])),
        ("e.tar", b"junk"),
    ]
    df = spark.createDataFrame([(n, bytearray(d)) for n, d in rows], "path string, content binary")
    got = sorted((r.archive, r.path or "", r.size, r.error) for r in archives.members(df).collect())
    assert got == [("a.zip", "b.css", 2, None), ("a.zip", "x/a.js", 1, None), ("b.tgz", "c.html", 3, None), ("c.zip", "../up.js", 1, "unsafe path"), ("c.zip", "ok.js", 1, None), ("d.zip", "bomb", 1_000_000, "compression ratio"), ("e.tar", "", None, "unreadable: ReadError")]


def test_sinks(spark):
    data = [("1", "j", "build_log", None, None, None), ("2", "j", "source_input", "project", None, datetime(2024, 1, 1))]
    df = spark.createDataFrame(data, "id string, job_id string, kind string, retention_class string, expires_at timestamp, created_at timestamp")
    got = {r.id: r for r in sinks.with_artifact_defaults(df, F.lit(datetime(2024, 2, 1))).collect()}
    assert (got["1"].retention_class, got["1"].expires_at) == ("ephemeral", datetime(2024, 2, 8)) and (got["2"].retention_class, got["2"].expires_at) == ("project", None)
    assert '"kind":"build_log","ids":["1"]' in sinks.evidence_index(df).first()["index"]


def test_heartbeats_run_out(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    beat = lambda rows: spark.createDataFrame(rows, heartbeats.SCHEMA).coalesce(1).write.mode("append").parquet(source)
    beat([("w", "a", "ok", datetime(2024, 1, 1, 0, 0)), ("w", "b", "ok", datetime(2024, 1, 1, 0, 0))])
    beat([("w", "b", "ok", datetime(2024, 1, 1, 1, 0))])
    stream = spark.readStream.schema(heartbeats.SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    found = []
    query = heartbeats.expiring(stream, 60).writeStream.outputMode("update").foreachBatch(lambda df, n: found.extend(df.collect())).option("checkpointLocation", out).trigger(availableNow=True).start()
    query.awaitTermination(120)
    query.stop()
    states = [(r.instance_id, r.state) for r in found]
    assert ("a", "active") in states and ("b", "active") in states and ("a", "stale") in states


def png(pixels, kind=6, modes=None):
    import struct
    import zlib

    import numpy as np

    height, width, n = pixels.shape
    lines = b""
    for y in range(height):
        mode, row = (modes or [0])[y % len(modes or [0])], pixels[y].astype(int)
        left = np.vstack([np.zeros((1, n), int), row[:-1]])
        up = pixels[y - 1].astype(int) if y else np.zeros((width, n), int)
        corner = np.vstack([np.zeros((1, n), int), up[:-1]])
        a, b, c = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        guess = [0 * row, left, up, (left + up) // 2, paeth][mode]
        lines += bytes([mode]) + ((row - guess) & 255).astype("u1").tobytes()
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_screenshots(spark):
    import numpy as np

    from tracewright.sources import images

    rng = np.random.default_rng(1)
    for kind, n in images.CHANNELS.items():
        pixels = rng.integers(0, 256, (7, 5, n)).astype(np.uint8)
        got = images.decode_png(png(pixels, kind, [0, 1, 2, 3, 4]))
        assert (got[..., :3] == (pixels[..., :3] if n >= 3 else pixels[..., :1])).all() and (got[..., 3] == (pixels[..., -1] if n in (2, 4) else 255)).all()
    one = np.zeros((4, 4, 4), np.uint8)
    two = one.copy()
    two[0, 0, 1], two[1, 1, 2] = 10, 11
    pairs = [("same", png(one), png(one)), ("two", png(one), png(two)), ("size", png(one), png(one[:2])), ("bad", png(one), b"x"), ("none", None, None)]
    df = spark.createDataFrame([(i, a and bytearray(a), b and bytearray(b)) for i, a, b in pairs], "id string, left binary, right binary")
    got = {r.id: (r.status, r.changed, r.ratio) for r in images.pixel_differences(df, 10).collect()}
    assert got == {"same": ("compared", 0, 0.0), "two": ("compared", 1, 1 / 16), "size": ("size_mismatch", None, None), "bad": ("unavailable", None, None), "none": ("unavailable", None, None)}
