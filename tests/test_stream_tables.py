"""Tables as streams: one file, or a folder of files."""

from veil.catalog.streams import stream_of
from veil.sources.tables import TABLES
from veil.streaming.jobs import run_available


def test_streams_of_files_and_folders(spark, tmp_path):
    for name in TABLES:
        spark.range(3).withColumnRenamed("id", "doc_id").repartition(2).write.parquet(f"{tmp_path}/a/{name}.parquet")
        part = next((tmp_path / "a" / f"{name}.parquet").glob("part-*"))
        (tmp_path / "b").mkdir(exist_ok=True)
        (tmp_path / "b" / f"{name}.parquet").write_bytes(part.read_bytes())
    one = spark.read.parquet(f"{tmp_path}/b/documents.parquet").count()
    assert run_available(stream_of(spark, f"{tmp_path}/a", "documents"), "folder").count() == 3
    assert run_available(stream_of(spark, f"{tmp_path}/b", "documents"), "file").count() == one > 0
