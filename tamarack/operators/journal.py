"""Write-ahead log as a table: append, checkpoint, replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INSERT, DELETE, CHECKPOINT = 1, 2, 255


def _little_endian(v: Column, size: int) -> Column:
    full = F.hex(v)  # big-endian, without leading zeros
    full = F.lpad(full, 16, "0")
    return F.unhex(F.concat(*(F.substring(full, 15 - 2 * i, 2) for i in range(size))))


def entry_crc(op: Column, doc_id: Column, payload: Column) -> Column:
    """OP-L2: CRC-32 of op byte, id in eight bytes little-endian, payload."""
    byte = F.unhex(F.lpad(F.hex(op.cast("long")), 2, "0"))
    return F.crc32(F.concat(byte, _little_endian(doc_id.cast("long"), 8), F.coalesce(payload, F.unhex(F.lit("")))))


def appended(entries: DataFrame) -> DataFrame:
    """OP-L2, OP-L5: entries (seq, op, rec_id, payload) with crc and the byte offset after each in its log.

    An entry takes a header of eight bytes, op, id and payload.
    """
    from tamarack.operators.index import running_offsets

    e = entries.withColumn("crc", entry_crc(F.col("op"), F.col("rec_id"), F.col("payload")))
    size = F.lit(17) + F.coalesce(F.octet_length("payload"), F.lit(0))
    e = running_offsets(e.withColumn("_k", F.lit(0)), "_k", ["seq"], size, "_at")
    return e.withColumn("offset", F.col("_at") + size).drop("_k", "_at")


def checkpoint_entry(spark, seq: int, segment_id: int) -> DataFrame:
    """OP-L3: op 255, id 0, the segment's id as payload in eight bytes little-endian."""
    row = spark.createDataFrame([(seq, segment_id)], "seq bigint, s bigint")
    return row.select("seq", F.lit(CHECKPOINT).alias("op"), F.lit(0).cast("bigint").alias("rec_id"), _little_endian(F.col("s"), 8).alias("payload"))


def checked(wal: DataFrame) -> DataFrame:
    """Adds ``good``: whether the stored crc is that of the entry; a null crc, op or id is not good."""
    return wal.withColumn("good", F.coalesce(F.col("crc") == entry_crc(F.col("op"), F.col("rec_id"), F.col("payload")), F.lit(False)))


def replay(wal: DataFrame) -> DataFrame:
    """OP-L4: entries of the log after the last checkpoint, up to the first damaged one, in the order of seq.

    Rows may stand in any order and twice: equal rows count once; a seq with both a good and a damaged row counts as good.
    The three marks (first damaged seq, last checkpoint) are single rows.
    """
    w = checked(wal).groupBy("seq", "op", "rec_id", "payload").agg(F.max("good").alias("good"))
    bad = w.groupBy("seq").agg(F.max("good").alias("g")).where(~F.col("g")).agg(F.min("seq")).first()[0]
    if bad is not None:
        w = w.where(F.col("seq") < bad)
    w = w.where("good")
    last = w.where(F.col("op") == CHECKPOINT).agg(F.max("seq")).first()[0]
    if last is not None:
        w = w.where(F.col("seq") > last)
    return w.select("seq", "op", "rec_id", "payload")


def salvage(wal: DataFrame) -> DataFrame:
    """All good entries in the order of seq, each once, whatever is damaged between them."""
    return checked(wal).where("good").select("seq", "op", "rec_id", "payload").distinct()


def applied(docs: DataFrame, entries: DataFrame, key: str = "doc_id") -> DataFrame:
    """OP-L6: documents without those whose last entry is a deletion."""
    last = entries.where(F.col("op").isin(INSERT, DELETE)).groupBy("rec_id").agg(F.max(F.struct("seq", "op")).alias("m"))
    gone = last.where(F.col("m.op") == DELETE).select(F.col("rec_id").alias(key))
    return docs.join(gone, key, "left_anti")


class Log:
    """OP-L1, OP-L5: a write-ahead log of files in a folder: one file for each append, whole or not there.

    An entry is op (1 byte), id (8), length of the payload (4), CRC-32 (4), all little-endian, then the payload.
    """

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self._path(self.folder).getFileSystem(self.conf)
        self.fs.mkdirs(self._path(self.folder))

    def _path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def _files(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(self.folder)) if s.getPath().getName().endswith(".log"))

    def append(self, entries: list[tuple[int, int, bytes]]) -> int:
        """Appends (op, id, payload) entries; the number of the file. They are synced to the file before it gets its name."""
        files = self._files()
        n = int(files[-1].removesuffix(".log")) + 1 if files else 0
        made, place = self._path(f"{self.folder}/.{n}.tmp"), self._path(f"{self.folder}/{n:012d}.log")
        out = self.fs.create(made, True)
        out.write(bytearray(b"".join(_packed(*e) for e in entries)))
        out.hsync()
        out.close()
        if self.fs.exists(place) or not self.fs.rename(made, place):
            raise FileExistsError(f"another writer made {place}")
        return n

    def checkpoint(self, segment_id: int) -> int:
        """OP-L3: from here on replay begins."""
        return self.append([(CHECKPOINT, 0, segment_id.to_bytes(8, "little"))])

    def entries(self) -> DataFrame:
        """(seq, op, rec_id, payload, crc) of all files; seq rises by file and place. What cannot be cut into entries ends its file
        with an entry without crc, so that replay stops there."""
        files = [f"{self.folder}/{n}" for n in self._files()]
        schema = "seq bigint, op int, rec_id bigint, payload binary, crc bigint"
        if not files:
            return self.spark.createDataFrame([], schema)

        def cut(batches):
            import pandas as pd

            for pdf in batches:
                rows = []
                for path, raw in zip(pdf["path"], pdf["content"]):
                    first = int(path.rsplit("/", 1)[1].removesuffix(".log")) << 32
                    rows += [(first + i, *e) for i, e in enumerate(_unpacked(bytes(raw)))]
                yield pd.DataFrame(rows, columns=["seq", "op", "rec_id", "payload", "crc"]).astype({"crc": "Int64"})

        return self.spark.read.format("binaryFile").load(files).select("path", "content").mapInPandas(cut, schema)

    def replay(self) -> DataFrame:
        """OP-L4: what was appended after the last checkpoint, up to the first damage."""
        return replay(self.entries())

    def truncate(self) -> int:
        """Deletes the files before that of the last checkpoint; how many."""
        last = self.entries().where(F.col("op") == CHECKPOINT).agg(F.max("seq")).first()[0]
        gone = [n for n in self._files() if last is not None and int(n.removesuffix(".log")) < last >> 32]
        for n in gone:
            self.fs.delete(self._path(f"{self.folder}/{n}"), False)
        return len(gone)


def _packed(op: int, rec_id: int, payload: bytes) -> bytes:
    import struct
    import zlib

    crc = zlib.crc32(bytes([op]) + rec_id.to_bytes(8, "little") + payload)
    return struct.pack("<BqII", op, rec_id, len(payload), crc) + payload


def _unpacked(raw: bytes) -> list[tuple[int, int, bytes, int | None]]:
    import struct

    out, at, head = [], 0, struct.calcsize("<BqII")
    while at < len(raw):
        if at + head > len(raw):
            return [*out, (0, 0, raw[at:], None)]
        op, rec_id, size, crc = struct.unpack_from("<BqII", raw, at)
        if at + head + size > len(raw):
            return [*out, (op, rec_id, raw[at + head :], None)]
        out.append((op, rec_id, raw[at + head : at + head + size], crc))
        at += head + size
    return out
