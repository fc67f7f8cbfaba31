"""ZIP archives whose members are packed by tasks; bytes depend on names and contents only."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the format: the date 1980-01-01, deflate, names in UTF-8 flagged where they are not ASCII, files of one owner.
DATE, DEFLATED, VERSION, UTF8, MODE = (1 << 5) | 1, 8, 20, 0x800, 0o600


def _head(name: bytes, crc: int, packed: int, size: int) -> bytes:
    flags = 0 if name.isascii() else UTF8
    return struct.pack("<5H3I2H", VERSION, flags, DEFLATED, 0, DATE, crc, packed, size, len(name), 0)


def packed_members(files: DataFrame) -> DataFrame:
    """(name, member, entry): each file's local header with its deflated bytes, and its entry of the directory without the place.

    files: name, content.  A member has less than 4 GiB.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members, entries = [], []
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                content, raw = content or b"", name.encode()
                deflate = zlib.compressobj(zlib.Z_DEFAULT_COMPRESSION, zlib.DEFLATED, -15)
                body = deflate.compress(content) + deflate.flush()
                head = _head(raw, zlib.crc32(content), len(body), len(content))
                members.append(b"PK\x03\x04" + head + raw + body)
                entries.append(b"PK\x01\x02" + struct.pack("<H", VERSION | 3 << 8) + head + struct.pack("<3HI", 0, 0, 0, MODE << 16))
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(members, pa.binary()), pa.array(entries, pa.binary())], names=["name", "member", "entry"])

    return files.select("name", "content").mapInArrow(pack, "name string, member binary, entry binary")


def zip_chunks(files: DataFrame, keep) -> tuple[DataFrame, bytes]:
    """(name, place, member) of all members in order of names, and the directory that ends the archive.

    keep writes a table and reads it again, so members are packed once.  Places are
    sums of sizes: within ranges of names, and over the ranges; the directory, about a
    hundred bytes a member, is put together in one place.
    """
    packed = keep(packed_members(files))
    sizes = packed.select("name", F.length("member").cast("long").alias("size"), "entry").repartitionByRange("name")
    sizes = keep(sizes.withColumn("range", F.spark_partition_id()))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.groupBy("range").agg(F.sum("size").alias("n")).select("range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("range").orderBy("name").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = sizes.withColumn("inside", inside).join(shift, "range").select("name", "size", "entry", (F.col("inside") + F.col("shift")).alias("place"))
    end, count, directory = 0, 0, []
    for r in places.orderBy("name").toLocalIterator():  # sizes and entries, no contents
        raw = r.name.encode()
        if r.place >= 1 << 32:
            raise ValueError("an archive of 4 GiB or more needs another format")
        directory.append(bytes(r.entry) + struct.pack("<I", r.place) + raw)
        end, count = r.place + r["size"], count + 1
    if count >= 1 << 16:
        raise ValueError("an archive of 65,536 members or more needs another format")
    listed = b"".join(directory)
    return packed.join(places.select("name", "place"), "name").select("name", "place", "member"), listed + struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, count, count, len(listed), end, 0)


def write_zip(files: DataFrame, path: str, keep) -> int:
    """Writes an archive to one file of the store and returns its bytes; members pass through the driver one after another."""
    spark = files.sparkSession
    chunks, directory = zip_chunks(files, keep)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, False)
    size = 0
    try:
        for r in chunks.orderBy("name").select("member").toLocalIterator():
            stream.write(bytearray(r.member))
            size += len(r.member)
        stream.write(bytearray(directory))
    finally:
        stream.close()
    return size + len(directory)
