"""A paged source: each partition is one list, followed page by page until no token is left."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: fetch(list id, page token or None) -> a page: items, nextPageToken, or error.
Fetch = Callable[[str, str | None], dict]


def file_pages(folder: str) -> Fetch:
    """Pages as files ``<list id>.<token>.json`` (first token: ``first``)."""

    def fetch(list_id: str, token: str | None) -> dict:
        with open(f"{folder}/{list_id}.{token or 'first'}.json", encoding="utf-8") as f:
            return json.load(f)

    return fetch


def paged_source(fetch: Fetch, name: str = "paged") -> type[DataSource]:
    """A data source named ``name`` with option ``lists`` (ids parted by commas)."""

    class Reader(DataSourceReader):
        def __init__(self, lists: list[str]):
            self.lists = lists

        def partitions(self) -> list[InputPartition]:
            return [InputPartition(x) for x in self.lists]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            token, place = None, 0
            while True:
                page = fetch(partition.value, token)
                if "error" in page:
                    raise RuntimeError(f"list {partition.value}: {page['error']}")
                for item in page.get("items", []):
                    yield partition.value, place, json.dumps(item, ensure_ascii=False)
                    place += 1
                token = page.get("nextPageToken")
                if not token:
                    return

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "list_id string, place int, item string"

        def reader(self, schema) -> DataSourceReader:
            return Reader([x for x in self.options.get("lists", "").split(",") if x])

    return Paged


def playlist_videos(spark: SparkSession, fetch: Fetch, lists: list[str]) -> DataFrame:
    """``(video_id, title, playlist_id, published_at, place)``: videos only, once each, the last
    values at the first place."""
    spark.dataSource.register(paged_source(fetch))
    raw = spark.read.format("paged").option("lists", ",".join(lists)).load()
    item = F.from_json("item", "struct<snippet:struct<title:string,publishedAt:string,resourceId:struct<kind:string,videoId:string>>>")["snippet"]
    v = raw.select("list_id", "place", item.alias("s")).where(F.col("s.resourceId.kind") == "youtube#video")
    order = F.struct("list_id", "place")
    return v.groupBy(F.col("s.resourceId.videoId").alias("video_id")).agg(F.max_by("s.title", order).alias("title"), F.max_by("list_id", order).alias("playlist_id"), F.max_by("s.publishedAt", order).alias("published_at"), F.min("place").alias("place"))


def pick_track(tracks: DataFrame, prefix: str = "en", least_segments: int = 50) -> DataFrame:
    """The track of each video in a language: one made by hand before a generated one;
    ``status`` tells videos without one or with too few segments. ``tracks`` has (video_id,
    language, is_generated, segments array)."""
    ok = F.coalesce(F.startswith("language", F.lit(prefix)), F.lit(False))
    rank = F.when(ok, F.struct(F.col("is_generated").cast("int").alias("g"), F.col("language").alias("l")))
    out = tracks.groupBy("video_id").agg(F.min_by(F.struct("language", "is_generated", "segments"), rank).alias("t"), F.max(ok).alias("any"))
    n: Column = F.coalesce(F.size("t.segments"), F.lit(0))
    status = F.when(~F.col("any"), "no_en").when(n < least_segments, "too_short").otherwise("success")
    return out.select("video_id", status.alias("status"), F.when(F.col("any"), F.col("t.language")).alias("language"), F.when(F.col("any"), n).otherwise(0).alias("segment_count"))
