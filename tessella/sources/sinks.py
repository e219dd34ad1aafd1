"""Sinks: a catalog published whole or not at all, tables as Markdown, and rows upserted under stable ids."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "CURRENT"


class Rejected(Exception):
    """The tables break a rule; `found` has the rules and their numbers of violations."""

    def __init__(self, found: Mapping[str, int]):
        super().__init__("; ".join(f"{k}: {n}" for k, n in sorted(found.items())))
        self.found = dict(found)


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def publish(tables: Mapping[str, DataFrame], folder: str, rules: Mapping[str, DataFrame] | None = None) -> str:
    """Writes all tables to a new version under `folder`, counts them back, then lets the pointer name that version.

    `rules` gives the rows that break each rule; if any has one, nothing is published. Readers follow the pointer, which is
    replaced by one rename: they see the last version or this one, never a part of it. Returns the version's folder.
    """
    broken = {k: n for k, df in (rules or {}).items() if (n := df.count())}
    if broken:
        raise Rejected(broken)
    spark = next(iter(tables.values())).sparkSession
    version = f"v-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{version}/{name}.parquet")
    differ = {name: abs(n) for name, df in tables.items() if (n := df.count() - spark.read.parquet(f"{folder}/{version}/{name}.parquet").count())}
    if differ:
        raise Rejected(differ)
    draft, fs = _path(spark, f"{folder}/{POINTER}.{version}")
    out = fs.create(draft, True)
    out.write(bytearray(version, "ascii"))
    out.close()
    target, _ = _path(spark, f"{folder}/{POINTER}")
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, target, _options(spark, rename.OVERWRITE))
    return f"{folder}/{version}"


def _options(spark: SparkSession, *values):
    array = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, len(values))
    for i, v in enumerate(values):
        array[i] = v
    return array


def current(spark: SparkSession, folder: str) -> str:
    """The folder of the version that was published last."""
    name = spark.read.text(f"{folder}/{POINTER}").first()[0]
    return f"{folder}/{name}"


def markdown_lines(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One `line` a row, cells between bars; bars and line ends within cells are escaped, nulls are empty."""
    cell = lambda c: F.regexp_replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"\R", " ")
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |")).alias("line"))


def changes(old: DataFrame, new: DataFrame, key: str, content: Sequence[str], flags: Sequence[str] = ()) -> DataFrame:
    """key and change: new, gone, changed (content differs), flag_flip (only flags differ) or same. One shuffle of hashes, not of texts."""
    digest = lambda cs: F.sha2(F.to_json(F.struct(*cs), {"ignoreNullFields": "false"}), 256) if cs else F.lit("")
    side = lambda df, p: df.select(F.col(key), digest(content).alias(p + "c"), digest(flags).alias(p + "f"))
    both = side(new, "n").join(side(old, "o"), key, "full_outer")
    kind = F.when(F.col("oc").isNull(), "new").when(F.col("nc").isNull(), "gone").when(F.col("nc") != F.col("oc"), "changed").when(F.col("nf") != F.col("of"), "flag_flip").otherwise("same")
    return both.select(key, kind.alias("change"))


def add_missing(old: DataFrame, new: DataFrame, key: str, content: Sequence[str], flags: Sequence[str] = ()) -> DataFrame:
    """The table after an incremental load: old rows stay, flags are those of `new`, unknown keys are added.

    A known key whose content changed or that vanished stops the load (Rejected): such a change needs a full rebuild. Running it
    twice changes nothing.
    """
    found = {r["change"]: r["n"] for r in changes(old, new, key, content, flags).groupBy("change").agg(F.count("*").alias("n")).where("change IN ('changed', 'gone')").collect()}
    if found:
        raise Rejected(found)
    return new.select(*old.columns)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; nulls are empty cells, quotes within cells are doubled."""
    df.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """A JSON object a line, null fields included."""
    df.write.option("ignoreNullFields", False).json(path)


def upserted(old: DataFrame, new: DataFrame, key: str, id_column: str = "point_id") -> DataFrame:
    """`old` with the rows of `new` in place of those of the same key; ids follow from the key, so that a second run changes nothing.
    Of repeated keys in `new` the row that sorts first stays. Null keys are left out."""
    one = new.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*[c for c in new.columns if c != key])).alias("row")).select(key, "row.*")
    one = one.withColumn(id_column, F.sha2(F.col(key).cast("string"), 256))
    return old.join(one.select(key), key, "left_anti").unionByName(one.select(*old.columns))
