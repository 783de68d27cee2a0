"""Crawl text files (WET): reading, writing, and what surrounds a download, on any file system Hadoop knows."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.functions.text import epoch_seconds, strip

SCHEMA = "file string, rec_no int, url string, ts string, body string"
COLUMNS = ["file", "rec_no", "url", "ts", "body"]
MIN_CHARS = 100


def records(stream) -> Iterator[dict[str, str]]:
    """OP-S4: conversion records of an open binary stream: url, ts, body.

    The body is read by Content-Length in bytes, so neither CRLF nor multi-byte characters nor a line that looks like a
    record header can move its end. Header names are matched without regard to case; a record without a readable length is
    skipped up to the next record's first line, a body cut short at the end of the file is kept as far as it goes.
    """
    line = stream.readline()
    while line:
        if not line.startswith(b"WARC/"):
            line = stream.readline()
            continue
        head: dict[str, str] = {}
        line = stream.readline()
        while line and line.strip():
            name, _, value = line.partition(b":")
            head[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
            line = stream.readline()
        try:
            size = int(head.get("content-length", ""))
        except ValueError:
            line = stream.readline()
            continue
        body = stream.read(size)
        if head.get("warc-type") == "conversion":
            text = "\n".join(body.decode("utf-8", "replace").replace("\r\n", "\n").rstrip("\r\n").split("\n"))
            yield {"url": head.get("warc-target-uri", ""), "ts": head.get("warc-date", ""), "body": text}
        line = stream.readline()


def discover(spark: SparkSession, path: str) -> list[str]:
    """OP-S3: sorted ``*.warc.wet.gz`` of a folder on any file system, or ``*.wet.gz``, or ``*.wet`` if there are none; a file as it is."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    if fs.getFileStatus(p).isFile():
        return [path]
    known = sorted(s.getPath().toString() for s in fs.listStatus(p) if s.isFile())
    for end in (".warc.wet.gz", ".wet.gz", ".wet"):
        if found := [k for k in known if k.endswith(end)]:
            return found
    return []


def _parsed(batches):
    import pandas as pd

    for pdf in batches:
        for path, raw in zip(pdf["path"], pdf["content"]):
            stream = io.BytesIO(raw)
            rows = []
            for i, r in enumerate(records(gzip.GzipFile(fileobj=stream) if path.endswith(".gz") else stream)):
                rows.append((path, i, r["url"], r["ts"], r["body"]))
                if len(rows) == 500:
                    yield pd.DataFrame(rows, columns=COLUMNS)
                    rows = []
            yield pd.DataFrame(rows, columns=COLUMNS)


def read_wet(spark: SparkSession, path: str) -> DataFrame:
    """OP-S4: raw records (file, rec_no, url, ts, body). A file is the unit of parallel work, as gzip cannot be split; its bytes come
    through Spark's file source, so any file system will do. Records leave in batches, the packed file alone is held whole."""
    files = discover(spark, path)
    if not files:
        return spark.createDataFrame([], SCHEMA)
    # One task for each file, as its work is far more than its size.
    raw = spark.read.format("binaryFile").load(files).select("path", "content").repartition(len(files), "path")
    return raw.mapInPandas(_parsed, SCHEMA)


def to_documents(raw: DataFrame, now: int, lang: str = "en") -> DataFrame:
    """OP-S5, OP-F1, OP-F2, OP-T1: (file, rec_no, url, text, crawl_ts, lang) of web pages with enough text."""
    d = raw.where(F.col("url").startswith("http")).withColumn("text", strip(F.col("body"))).where(F.length("text") >= MIN_CHARS)
    return d.select("file", "rec_no", "url", "text", epoch_seconds(F.col("ts"), now).alias("crawl_ts"), F.lit(lang).alias("lang"))


def manifest(spark: SparkSession, path: str, n_files: int) -> DataFrame:
    """OP-S1: the first n paths of a manifest file, in its order, with the name of each; packed or not.

    ``manifest_path`` names that of a crawl.
    """
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("at", F.monotonically_increasing_id())
    return lines.orderBy("at").limit(n_files).select(F.trim("value").alias("path"), F.substring_index(F.trim("value"), "/", -1).alias("name"))


def manifest_path(base: str, crawl: str) -> str:
    """Where a crawl keeps the list of its text files."""
    return f"{base.rstrip('/')}/crawl-data/{crawl}/wet.paths.gz"


def fetch(spark: SparkSession, wanted: DataFrame, base: str, folder: str, threads: int = 8) -> list[str]:
    """OP-S2: copies the files of a manifest (path, name) below ``base`` that the folder lacks; names of those copied.

    Both sides are any file systems that Hadoop knows, http among them. A file is copied beside its place and then renamed, so
    one cut short is copied again. Files are few and large; copies run side by side in threads.
    """
    from concurrent.futures import ThreadPoolExecutor

    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(folder)
    fs = place.getFileSystem(conf)
    fs.mkdirs(place)
    have = {s.getPath().getName() for s in fs.listStatus(place)}

    def one(row):
        if row["name"] in have:
            return None
        src, made = jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{row['path']}"), jvm.org.apache.hadoop.fs.Path(f"{folder}/.{row['name']}.part")
        jvm.org.apache.hadoop.fs.FileUtil.copy(src.getFileSystem(conf), src, fs, made, False, True, conf)
        fs.rename(made, jvm.org.apache.hadoop.fs.Path(f"{folder}/{row['name']}"))
        return row["name"]

    with ThreadPoolExecutor(threads) as pool:
        return [n for n in pool.map(one, wanted.toLocalIterator()) if n]


def missing(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """OP-S2: manifest rows whose file is not there yet."""
    return wanted.join(present.select("name"), "name", "left_anti")


def wet_bytes(docs: list[dict]) -> bytes:
    """A file of records for tests and round trips: url, ts, text each."""
    out = [b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\ninfo\r\n\r\n"]
    for d in docs:
        body = d["text"].encode()
        out.append(
            f"WARC/1.0\r\nWARC-Type: conversion\r\nWARC-Target-URI: {d['url']}\r\nWARC-Date: {d['ts']}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
        )
    return b"".join(out)


def write_wet(df: DataFrame, folder: str) -> None:
    """Writes (file_no, rec_no, url, ts, text) as one gzipped file of records for each file_no, in the tasks, on any file system."""
    spark = df.sparkSession
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: conversion\r\nWARC-Target-URI: "), "url", F.lit("\r\nWARC-Date: "), "ts",
        F.lit("\r\nContent-Length: "), F.octet_length("text").cast("string"), F.lit("\r\n\r\n"), "text",
    )
    out = df.repartition("file_no").sortWithinPartitions("file_no", "rec_no").select("file_no", head.alias("value"))
    out.write.mode("errorifexists").partitionBy("file_no").option("compression", "gzip").option("lineSep", "\r\n\r\n").text(f"{folder}/_made")
    jvm = spark._jvm
    made = jvm.org.apache.hadoop.fs.Path(f"{folder}/_made")
    fs = made.getFileSystem(spark._jsc.hadoopConfiguration())
    for d in fs.listStatus(made):
        name = d.getPath().getName()
        for i, f in enumerate(fs.listStatus(d.getPath()) if name.startswith("file_no=") else []):
            no = int(name.split("=")[1])
            fs.rename(f.getPath(), jvm.org.apache.hadoop.fs.Path(f"{folder}/part-{no:05d}{f'-{i}' if i else ''}.warc.wet.gz"))
    fs.delete(made, True)
