"""A versioned store of vectors: points in buckets by ranges of their ids, of which a load rewrites only those that change."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.sources.sinks import Rejected, changes, current, publish

#: Buckets of a new store: the manifest has a row for each, and a load's smallest unit is one. Points of a page.
BUCKETS, PAGE = 64, 256
POINT, BUCKET = "point_id", "bucket"


def _identified(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """With the point's id, which follows from the key, and its bucket: the range of ids that it lies in. Null keys are left out, of repeated ones the row that sorts first stays."""
    rest = [c for c in df.columns if c != key]
    one = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*rest)).alias("_row")).select(key, "_row.*") if rest else df.where(F.col(key).isNotNull()).distinct()
    one = one.withColumn(POINT, F.sha2(F.col(key).cast("string"), 256))
    return one.withColumn(BUCKET, _bucket(F.col(POINT), buckets))


def _bucket(point, buckets: int):
    return F.floor(F.conv(F.substr(point, F.lit(1), F.lit(4)), 16, 10).cast("long") * buckets / 65536).cast("int")


class VectorStore:
    """Points of one folder. Each load writes the buckets that it changes to new files, then publishes a manifest that names every
    bucket's files; readers see the last manifest or the one before, never a part. A load that fails leaves files that no manifest names."""

    def __init__(self, spark: SparkSession, folder: str, key: str):
        self.spark, self.folder, self.key = spark, folder, key

    def _manifest(self) -> list:
        return sorted(self.spark.read.parquet(f"{current(self.spark, self.folder)}/manifest.parquet").collect(), key=lambda r: r["bucket"])

    def _write(self, df: DataFrame, kept: list, buckets: int) -> None:
        """A new version: the buckets of `df` (with POINT and BUCKET) and those kept."""
        path = f"{self.folder}/data/{uuid.uuid4().hex}"
        df.repartition(BUCKET).sortWithinPartitions(BUCKET, POINT).write.partitionBy(BUCKET).parquet(path)
        counts = self.spark.read.schema(df.schema).parquet(path).groupBy(BUCKET).count().collect()  # a row a bucket
        rows = [(r["bucket"], r["path"], r["rows"], buckets) for r in kept] + [(r[BUCKET], f"{path}/{BUCKET}={r[BUCKET]}", r["count"], buckets) for r in counts]
        publish({"manifest": self.spark.createDataFrame(rows, "bucket int, path string, rows long, buckets int")}, self.folder)

    def _read(self, parts: list) -> DataFrame:
        return self.spark.read.parquet(*[r["path"] for r in parts])

    def create(self, points: DataFrame, buckets: int = BUCKETS) -> None:
        """The store anew, of these points."""
        self._write(_identified(points, self.key, buckets), [], buckets)

    def points(self) -> DataFrame:
        """All points, with their ids."""
        return self._read(self._manifest())

    def upsert(self, points: DataFrame) -> list[int]:
        """Puts points in place of those of the same key. Points that are there as they are change nothing; the buckets rewritten are returned."""
        parts = self._manifest()
        new = _identified(points, self.key, parts[0]["buckets"])
        columns = [c for c in points.columns if c != self.key]
        old = self._read(parts)
        different = changes(old.join(new.select(POINT), POINT, "left_semi"), new, POINT, columns).where("change <> 'same'").select(POINT)
        touched = [r[0] for r in new.join(different, POINT, "left_semi").select(BUCKET).distinct().collect()]
        if touched:
            inside = [r for r in parts if r["bucket"] in touched]
            part = new.where(F.col(BUCKET).isin(touched))
            if inside:
                before = self._read(inside)
                part = part.unionByName(before.join(part.select(POINT), POINT, "left_anti").withColumn(BUCKET, _bucket(F.col(POINT), parts[0]["buckets"])).select(*part.columns))
            self._write(part, [r for r in parts if r["bucket"] not in touched], parts[0]["buckets"])
        return sorted(touched)

    def add_missing(self, points: DataFrame, content: Sequence[str], flags: Sequence[str] = ()) -> list[int]:
        """Adds the points that aren't there and takes over flags; vectors that are there stay as they are.

        A known point whose content changed, or one that `points` lacks, stops the load (Rejected): that needs a store anew.
        A second run changes nothing. The buckets rewritten are returned.
        """
        old = self.points()
        found = changes(old, _identified(points, self.key, self._manifest()[0]["buckets"]), POINT, content, flags)
        wrong = {r["change"]: r["n"] for r in found.groupBy("change").agg(F.count("*").alias("n")).where("change IN ('changed', 'gone')").collect()}
        if wrong:
            raise Rejected(wrong)
        known = old.select(self.key, *[c for c in points.columns if c not in flags and c != self.key])
        fresh = points.join(known.select(self.key), self.key, "left_anti")
        flagged = known.join(points.select(self.key, *flags), self.key).select(*points.columns)
        return self.upsert(fresh.select(*points.columns).unionByName(flagged))

    def scroll(self, after: str | None = None, limit: int = PAGE) -> tuple[DataFrame, str | None]:
        """The `limit` points after an id, in order of id, and the id to go on from (None at the end). Only buckets from there on that hold enough are read."""
        parts = self._manifest()
        start = 0 if after is None else int(after[:4], 16) * parts[0]["buckets"] // 65536
        need, read = limit, []
        for r in (r for r in parts if r["bucket"] >= start):
            read.append(r)
            need -= 0 if after is not None and r["bucket"] == start else r["rows"]  # of the first bucket, some may lie before
            if need < 0:
                break
        if not read:
            return self.points().limit(0), None
        rows = self._read(read).where(F.col(POINT) > after) if after is not None else self._read(read)
        page = rows.orderBy(POINT).limit(limit)
        last = page.agg(F.count("*").alias("n"), F.max(POINT).alias("last")).first()
        more = last["n"] == limit and (need < 0 or rows.where(F.col(POINT) > last["last"]).limit(1).count() > 0)
        return page, last["last"] if more else None


def pages(df: DataFrame, key: str, limit: int = PAGE, buckets: int = 1024) -> DataFrame:
    """key and page of every point as a scroll by `limit` gives it. Buckets are counted first, so that only a bucket's points are ordered together; null keys have no page."""
    points = _identified(df.select(key), key, buckets)
    sums = points.groupBy(BUCKET).agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy(BUCKET)) - F.col("_n"))  # a row a bucket
    place = F.row_number().over(Window.partitionBy(BUCKET).orderBy(POINT)) + F.col("_before") - 1
    return points.join(F.broadcast(sums), BUCKET).select(key, F.floor(place / limit).cast("long").alias("page"))
