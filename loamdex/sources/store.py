"""The document store: a Parquet table of (doc_id, text), and the readers of crawl folders, TSV graphs and dictionaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def latest(versions: DataFrame, order: str = "batch") -> DataFrame:
    """The last version of each doc_id by `order`; versions has (doc_id, text, order)."""
    newest = F.max_by(F.struct(*(c for c in versions.columns if c not in ("doc_id", order))), order)
    return versions.groupBy("doc_id").agg(newest.alias("row")).select("doc_id", "row.*")


@dataclass
class DocumentStore:
    """Documents in a folder: each write is a batch, and of a doc_id the last batch counts."""

    spark: SparkSession
    path: str

    @classmethod
    def create_or_open(cls, spark: SparkSession, path: str) -> DocumentStore:
        store = cls(spark, path)
        spark.createDataFrame([], "doc_id long, text string, batch long").write.mode("ignore").parquet(path)
        return store

    def versions(self) -> DataFrame:
        return self.spark.read.schema("doc_id long, text string, batch long").parquet(self.path)

    def add(self, docs: DataFrame) -> None:
        """Insert or overwrite; within docs the greatest text of an id counts."""
        batch = (self.versions().agg(F.max("batch")).first()[0] or 0) + 1
        rows = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("text").alias("text"))
        rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("append").parquet(self.path)

    def bulk_load(self, docs: DataFrame) -> None:
        """A first load, in files of ascending ids, so that a look-up skips row groups."""
        rows = docs.select(F.col("doc_id").cast("long"), "text", F.lit(0).cast("long").alias("batch"))
        rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.mode("append").parquet(self.path)

    def scan(self) -> DataFrame:
        return latest(self.versions()).orderBy("doc_id")

    def keys(self) -> DataFrame:
        return self.versions().select("doc_id").distinct().orderBy("doc_id")

    def get(self, doc_id: int) -> str | None:
        row = latest(self.versions().where(F.col("doc_id") == doc_id)).first()
        return row.text if row else None

    def size(self) -> int:
        return self.versions().select("doc_id").distinct().count()


#: Rows that are numbered in one task (about), and ranges at most (a square).
SPAN_ROWS, MOST_SPANS = 1 << 17, 1 << 14


def number_rows(df: DataFrame, key: str, name: str = "rn") -> DataFrame:
    """df with the row's number in the order of an integer key, from 1; rows without a key come last.

    Rows are numbered inside ranges of the key that hold about as many rows each,
    by sampled bounds, however the keys lie; ranges add the counts of all before,
    and only these counts, a bounded number, meet in one task.
    """
    count = df.select(key).count()
    spans = min(MOST_SPANS, -(-count // SPAN_ROWS))
    if spans <= 1:
        return df.withColumn(name, F.row_number().over(Window.orderBy(F.col(key).asc_nulls_last())).cast("long"))
    wanted = [i / spans for i in range(1, spans)]
    bounds = sorted({int(b) for b in df.select(F.col(key).cast("double").alias("k")).approxQuantile("k", wanted, 1 / (4 * spans))})
    # Two steps of about the square root each, instead of one along all bounds.
    step = max(1, int(len(bounds) ** 0.5))
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    below = lambda values: F.size(F.filter(values, lambda b: b < F.col(key)))
    longs = lambda xs: F.array(*(F.lit(x).cast("bigint") for x in xs))
    part = F.greatest(below(longs(p[0] for p in parts)) - 1, F.lit(0))
    span = F.when(F.col(key).isNull(), F.lit(len(bounds) + 1)).otherwise(part * step + below(F.get(F.array(*map(longs, parts)), part)))
    ranged = df.withColumn("span", span)
    before = ranged.groupBy("span").count().select("span", (F.sum("count").over(Window.orderBy("span")) - F.col("count")).alias("before"))
    inner = F.row_number().over(Window.partitionBy("span").orderBy(key))
    numbered = ranged.withColumn("inner", inner).join(before, "span").withColumn(name, (F.col("inner") + F.col("before")).cast("long"))
    return numbered.drop("span", "inner", "before")


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of the files in <folder>/cleaned, a document each, by path; one trailing newline goes, CRLF becomes LF."""
    place = f"{folder.rstrip('/')}/cleaned"
    files = spark.read.text(place, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    # Spark's readers leave out empty files; a document each all the same.
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    listed = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)
    empty = [(f.getPath().toString(), "") for f in listed if f.isFile() and f.getLen() == 0]
    if empty:
        files = files.unionByName(spark.createDataFrame(empty, "path string, value string"))
    return files.select("path", F.regexp_replace(F.regexp_replace("value", "\r\n", "\n"), "\n\\z", "").alias("text")).orderBy("path")


def _fields(value: Column) -> Column:
    return F.split(value, r"\s")


def read_nodes(lines: DataFrame) -> DataFrame:
    """(id, url) of lines `id<blank>url`."""
    return lines.select(_fields(F.col("value"))[0].cast("int").alias("id"), F.get(_fields(F.col("value")), F.lit(1)).alias("url"))


def read_edges(lines: DataFrame) -> DataFrame:
    """(src, dst) of lines `src<blank>dst`; parallel edges stay."""
    return lines.select(_fields(F.col("value"))[0].cast("int").alias("src"), F.get(_fields(F.col("value")), F.lit(1)).cast("int").alias("dst"))
