"""Fingerprints of files by seeking."""

import hashlib
import os

from veilframe.jobs.uploads import content_fingerprint
from veilframe.sources.files import fingerprint_files


def test_same_digests_as_of_whole_columns(spark, tmp_path):
    rnd = os.urandom
    for name, n in (("a.bin", 0), ("b.bin", 5), ("c.bin", 64), ("sub/d e.bin", 128), ("sub/é.bin", 129), ("f.bin", 1000), ("g.txt", 3)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(rnd(n))
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path))
    want = {r.path: r.fp for r in whole.select("path", content_fingerprint(whole, chunk=64).alias("fp")).collect()}
    got = {r.path: r.fp for r in fingerprint_files(spark, str(tmp_path), chunk=64).collect()}
    assert got == want and len(got) == 6  # Spark does not list empty files
    assert fingerprint_files(spark, str(tmp_path), chunk=64, glob="*.txt").count() == 1


def test_a_file_beyond_two_gigabytes(spark, tmp_path):
    """Sparse, with marks where the chunks that count begin: at the head, in the middle, at the end."""
    size, chunk = 3 * (1 << 30) + 7, 1 << 20
    with open(tmp_path / "long.mp4", "wb") as f:
        f.truncate(size)
        for at, mark in ((0, b"head"), (size // 2, b"middle"), (size - 4, b"tail"), (1 << 31, b"not looked at")):
            f.seek(at)
            f.write(mark)
    head, middle, tail = b"head".ljust(chunk, b"\0"), b"middle".ljust(chunk, b"\0"), b"tail".rjust(chunk, b"\0")
    row = fingerprint_files(spark, str(tmp_path)).first()
    assert row["size"] == size and row.fp == hashlib.sha256(str(size).encode() + head + middle + tail).hexdigest()


def test_a_reader_of_ones_own(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")

    def reader(uri):
        import io

        return io.BytesIO(b"xyz")

    assert fingerprint_files(spark, str(tmp_path), reader=reader).first().fp == hashlib.sha256(b"3xyz").hexdigest()
