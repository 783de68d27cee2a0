"""The streaming query's batches can be read in several tasks each."""

import glob
import random

import pyarrow.parquet as pq

from tamarack import queries
from tamarack.plans.stage import shared_dir


def test_batches_split(spark, tmp_path):
    r = random.Random(1)
    words = [f"word{i}" for i in range(500)]
    rows = [(i, f"http://{i}", " ".join(r.choices(words, k=3000)), 0, "en", 0) for i in range(400)] + [(900, "http://900", "a text of its own " * 9, 0, "en", 1)]
    spark.createDataFrame(rows, "rec_id bigint, url string, text string, crawl_ts bigint, lang string, batch_id int").write.parquet(f"{tmp_path}/wet_documents.parquet")
    place = f"{shared_dir(spark).removeprefix('file://').removeprefix('file:')}/stream-in-*/part-*.parquet"
    before = set(glob.glob(place))
    got = queries.QUERIES["stream_ingest"](spark, str(tmp_path)).orderBy("segment_id").collect()
    assert [(x["segment_id"], x["num_docs"]) for x in got][0][0] == 0 and got[1]["num_docs"] == 1
    files = sorted(set(glob.glob(place)) - before, key=lambda f: -pq.ParquetFile(f).metadata.num_rows)
    assert len(files) == 2 and pq.ParquetFile(files[0]).num_row_groups > 1
