"""Layer building: pages, statistics, coverage, merging of corridors and measures."""

from __future__ import annotations

import gzip
import os
import sys
from functools import reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def read_pages(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """Features of paged JSON answers: one row for each feature, with ``fields`` (a DDL string) and its paths."""
    schema = f"features array<struct<attributes:struct<{fields}>,geometry:struct<paths:array<array<array<double>>>>>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f")).select("f.attributes.*", "f.geometry.paths")


def lines(features: DataFrame) -> DataFrame:
    """One row for each path of a feature, as an array of struct(lon, lat)."""
    path = F.transform("path", lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat")))
    return features.withColumn("path", F.explode("paths")).withColumn("line", path).drop("path", "paths")


def read_geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features of GeoJSON files, plain or gzip by their extension: properties (a DDL string), geometry type and coordinates as JSON text."""
    schema = f"features array<struct<properties:struct<{properties}>,geometry:struct<type:string,coordinates:string>>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f")).select("f.properties.*", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"))


def feature_line(properties: list[str]) -> Column:
    """A row as one line of JSON, without null properties."""
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), F.struct(F.col("geometry_type").alias("type"), F.col("coordinates").alias("coordinates")).alias("geometry"))
    return F.to_json(feature, {"ignoreNullFields": "true"})


def write_features(df: DataFrame, path: str, *, rows_per_file: int = 200_000, codec: str = "gzip") -> None:
    """One JSON feature a line without null properties, in files of bounded size."""
    properties = [c for c in df.columns if c not in ("geometry_type", "coordinates")]
    df.select(feature_line(properties).alias("value")).write.option("maxRecordsPerFile", rows_per_file).option("compression", codec).text(path)


def dealt(lines: DataFrame, order: list[str], max_bytes: int) -> DataFrame:
    """Lines (value, order) dealt to files of at most max_bytes with their line feeds: adds ``file``.

    Lines in order are laid end to end; those that begin in the same half of max_bytes go to one file, and a line longer than such a half
    has a file of its own, as it cannot push another over the limit then. Only a line longer than max_bytes makes a
    longer file. Running bytes are summed within ranges of the order; one row a range carries what lies before it, so files do not depend
    on how the ranges fall. Equal lines are told apart by nothing and may swap places.
    """
    half = max_bytes // 2
    size = F.octet_length("value") + 1
    parts = stored(lines.select(*order, "value", size.cast("long").alias("bytes")).repartitionByRange(*order, "value").withColumn("part", F.spark_partition_id()), "lines")
    small = F.when(F.col("bytes") <= half, F.col("bytes")).otherwise(0)
    large = (F.col("bytes") > half).cast("long")
    sums = parts.groupBy("part").agg(F.sum(small).alias("s"), F.sum(large).alias("l"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("part", F.coalesce(F.sum("s").over(upto), F.lit(0)).alias("s0"), F.coalesce(F.sum("l").over(upto), F.lit(0)).alias("l0"))
    w = Window.partitionBy("part").orderBy(*order, "value").rowsBetween(Window.unboundedPreceding, 0)
    placed = parts.join(F.broadcast(offsets), "part")  # a row for each partition of the shuffle
    start = F.col("s0") + F.sum(small).over(w) - small
    alone = F.when(large == 1, F.col("l0") + F.sum(large).over(w)).otherwise(0)
    return placed.select(*order, "value", F.concat_ws("-", F.floor(start / half).cast("string"), alone.cast("string")).alias("file"))


#: Groups of folders: so many tasks write files of bounded size, and list them.
GROUPS = 128


def _local(spark: SparkSession, path: str) -> str | None:
    """The folder that a path names in a file system that tasks see as theirs (file:), else nothing."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    name = there.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(there).toUri()
    return name.getPath() if name.getScheme() == "file" else None


def _file_writer(root: str, codec: str):
    """mapInArrow over rows (folder, value) sorted by folder: a file for each folder, under another name until it is complete. A task that
    runs again writes the same bytes under the same names."""

    def run(batches):
        from pyspark import TaskContext

        task, folder, out, raw = TaskContext.get(), None, None, None
        name = f"part-{task.partitionId():05d}.txt" + (".gz" if codec == "gzip" else "")
        draft = f".{name}.{task.taskAttemptId()}"

        def close():
            if out is not None:
                out.close()
                raw.close()
                os.replace(f"{root}/{folder}/{draft}", f"{root}/{folder}/{name}")

        for batch in batches:
            folders, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            starts = [i for i, f in enumerate(folders) if not i or f != folders[i - 1]]
            for i, j in zip(starts, [*starts[1:], len(folders)]):
                if folders[i] != folder:
                    close()
                    folder = folders[i]
                    os.makedirs(f"{root}/{folder}", exist_ok=True)
                    raw = open(f"{root}/{folder}/{draft}", "wb")
                    out = gzip.GzipFile("", "wb", 6, raw, 0) if codec == "gzip" else raw
                out.write(("\n".join(values[i:j]) + "\n").encode())
        close()
        return iter(())

    return run


def _file_reader(root: str):
    """mapInArrow over numbers of groups: the lines of their files, with the names of the folders."""

    def run(batches):
        values, files, size = [], [], 0
        for batch in batches:
            for group in batch.column(0).to_pylist():
                at = f"{root}/group={group}"
                for folder in sorted(os.listdir(at)) if os.path.isdir(at) else []:
                    for name in os.listdir(f"{at}/{folder}"):
                        if name[0] in "._":
                            continue
                        with (gzip.open if name.endswith(".gz") else open)(f"{at}/{folder}/{name}", "rb") as f:
                            for line in f:
                                values.append(line.decode().removesuffix("\n"))
                                files.append(folder.removeprefix("file="))
                                size += len(line)
                                if size > 1 << 22:
                                    yield pa.RecordBatch.from_arrays([pa.array(values, pa.string()), pa.array(files, pa.string())], ["value", "file"])
                                    values, files, size = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(values, pa.string()), pa.array(files, pa.string())], ["value", "file"])

    return run


def write_bounded(df: DataFrame, path: str, order: list[str], *, max_bytes: int = 55_000_000, codec: str = "gzip", grouped: bool = False) -> None:
    """Features (see write_features) in files of at most max_bytes before compression, each in order and in a folder ``file=<name>``.

    Files cost more than their bytes, so they are dealt to tasks by number, and each task puts its own in place. Many files should be ``grouped``
    in folders ``group=<number>``: each can be listed by a task of its own (see read_bounded). In folders that tasks see as files (file:) they
    write by themselves: there Hadoop starts a process for every file and folder.
    """
    spark = df.sparkSession
    properties = [c for c in df.columns if c not in ("geometry_type", "coordinates")]
    lines = df.select(*order, feature_line(properties).alias("value"))
    files = dealt(lines, order, max_bytes).withColumn("group", F.pmod(F.xxhash64("file"), F.lit(GROUPS)).cast("int"))
    folders = ["group", "file"] if grouped else ["file"]
    files = files.repartition(GROUPS, "group").sortWithinPartitions(*folders, *order)
    root = _local(spark, path) if codec in ("gzip", "none") else None
    if root is None:
        files.select(*folders, "value").write.partitionBy(*folders).option("compression", codec).option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)
        return
    df.limit(0).select(F.lit("").alias("value")).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").text(path)  # an error if it is there
    folder = F.concat_ws("/", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in folders])
    files.select(folder.alias("folder"), "value").mapInArrow(_file_writer(root, codec), "done long").write.format("noop").mode("overwrite").save()
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    done.getFileSystem(spark._jsc.hadoopConfiguration()).create(done).close()


def read_bounded(spark: SparkSession, path: str) -> DataFrame:
    """(value, file): the lines of grouped files of write_bounded. Tasks list the groups and read their files, so the driver holds none of
    their names."""
    root = _local(spark, path)
    if root is None:
        return spark.read.schema("value string, file string").text(path).select("value", "file")
    groups = spark.range(0, GROUPS, 1, GROUPS).select(F.col("id").cast("int").alias("group"))
    return groups.mapInArrow(_file_reader(root), "value string, file string")


def version_stamp(df: DataFrame, columns: list[str]) -> DataFrame:
    """A content hash that does not depend on the order of rows: the digest of the sum and count of row digests."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]).cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.sum(h).alias("s"), F.count("*").alias("n")).select(F.substring(F.sha2(F.concat_ws(":", F.col("s").cast("string"), F.col("n").cast("string")).cast("binary"), 256), 1, 12).alias("version"))


def signature(settings: Column) -> Column:
    """One text for equal settings (a map), whatever the order of their names."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(settings)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")


def statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, rows) for each of several columns, from one pass."""
    pair = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("p")
    return df.select(pair).groupBy("p.field", "p.value").agg(F.count("*").alias("rows"))


def coverage(edges: DataFrame, by: str, **tests: Column) -> DataFrame:
    """Metres, and metres for which each test holds, by class, with a total row (class null)."""
    return edges.rollup(by).agg(F.sum("len_m").alias("metres"), *[F.sum(F.when(t, F.col("len_m")).otherwise(0)).alias(n) for n, t in tests.items()])


def resolve(base: DataFrame, key: str, layers: list[DataFrame], values: list[str]) -> DataFrame:
    """Values of the first layer that knows them, in order of precedence."""
    out = base
    for i, layer in enumerate(layers):
        out = out.join(layer.select(key, *[F.col(v).alias(f"__{v}{i}") for v in values]), key, "left")
    return out.select(*base.columns, *[F.coalesce(*[F.col(f"__{v}{i}") for i in range(len(layers))]).alias(v) for v in values])


def corridors(ways: DataFrame, key: Column, sets: list[str]) -> DataFrame:
    """Ways of one geometry merge: sorted distinct values of each set; then the ways of equal sets are gathered."""
    merged = ways.withColumn("geometry_key", key).groupBy("geometry_key").agg(*[F.array_join(F.array_sort(F.collect_set(s)), ";").alias(s) for s in sets])
    return merged.groupBy(*sets).agg(F.count("*").alias("lines"), F.min("geometry_key").alias("first_key"))


def updated(base: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with the changed columns of matching keys; other rows as they are."""
    j = base.join(changes.select(key, F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in columns]), key, "left")
    return reduce(lambda d, c: d.withColumn(c, F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c))), columns, j).select(base.columns)
