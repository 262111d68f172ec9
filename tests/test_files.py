"""Pages, files of bounded size, merges of sequences, previews."""

import os
import random
import shutil

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import GreaterThan, In, IsNotNull, StringContains

from roadlattice.operators import etl, sequences
from roadlattice.sources import pages

RECORDS = "attributes struct<id:long,kind:string>, geometry struct<paths:array<array<array<double>>>>"


def written(spark, path, n, page_rows=10):
    rows = [((i, None if i % 7 == 3 else f"k{i % 3}"), ([[[float(i), 0.0], [float(i), 1.0]]],)) for i in range(n)]
    pages.write_pages(spark.createDataFrame(rows, RECORDS), path, F.floor(F.col("attributes.id") / page_rows))
    return pages.paged(spark, path, "id long, kind string, other int", page_rows=page_rows, pages_per_task=2)


def test_pages_are_read_checked_and_filtered(spark, tmp_path):
    df = written(spark, f"{tmp_path}/p", 45)
    assert df.rdd.getNumPartitions() == 3
    got = df.orderBy("id").collect()
    assert [r.id for r in got] == list(range(45)) and got[4].paths == [[[4.0, 0.0], [4.0, 1.0]]] and got[3].kind is None and got[0].other is None
    some = df.where("id >= 8 and id < 31 and kind = 'k1' and id in (10, 13, 16, 22, 28, 40)")
    assert sorted(r.id for r in some.collect()) == [13, 16, 22, 28]
    reader = pages.PagedReader(pages.Folder(f"{tmp_path}/p", 10, df.schema), 2)
    left = StringContains(("kind",), "k")
    assert list(reader.pushFilters([GreaterThan(("id",), 8), left, In(("kind",), ("k1",)), IsNotNull(("kind",)), IsNotNull(("paths",))])) == [left, IsNotNull(("paths",))]
    assert [i for b in reader.read(reader.partitions()[0]) for i in b.column("id").to_pylist()] == [13, 16, 19]
    assert written(spark, f"{tmp_path}/none", 0).count() == 0


def test_a_lost_page_or_record_is_an_error(spark, tmp_path):
    df = written(spark, f"{tmp_path}/p", 45)
    shutil.rmtree(f"{tmp_path}/p/page=2")
    with pytest.raises(Exception, match="page 2 .* holds 0 records instead of 10"):
        df.where("id < 5").collect()
    short = written(spark, f"{tmp_path}/q", 45)
    with open(f"{tmp_path}/q/_total/{[f for f in os.listdir(f'{tmp_path}/q/_total') if f.startswith('part')][0]}", "w") as f:
        f.write("46\n")
    for f in os.listdir(f"{tmp_path}/q/_total"):
        if f.startswith("."):
            os.remove(f"{tmp_path}/q/_total/{f}")
    again = pages.paged(spark, f"{tmp_path}/q", "id long", page_rows=10)
    assert short is not None
    with pytest.raises(Exception, match="page 4 .* holds 5 records instead of 6"):
        again.count()


def test_pages_as_a_stream(spark, tmp_path):
    path = f"{tmp_path}/p"
    written(spark, path, 40)
    shutil.move(f"{path}/page=3", f"{tmp_path}/later")

    def run():
        q = pages.paged_stream(spark, path, "id long", page_rows=10).select("id").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run() == list(range(30))
    shutil.move(f"{tmp_path}/later", f"{path}/page=3")
    assert run() == list(range(40))


def test_files_stay_under_their_bytes(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, "x" * (2500 if i in (17, 40) else 900 if i % 31 == 5 else r.randrange(60)), "Point", "[0,0]") for i in range(400)]
    df = spark.createDataFrame(rows, "id long, name string, geometry_type string, coordinates string")
    for k, parts in enumerate((3, 9)):
        etl.write_bounded(df.repartition(parts), f"{tmp_path}/{k}", ["id"], max_bytes=2000, codec="none")
    seen = []
    for k in range(2):
        files = {}
        for folder in sorted(f for f in os.listdir(f"{tmp_path}/{k}") if f.startswith("file=")):
            (name,) = [f for f in os.listdir(f"{tmp_path}/{k}/{folder}") if f.startswith("part")]
            files[folder] = open(f"{tmp_path}/{k}/{folder}/{name}").read()
        assert all(len(t) <= 2000 or t.count("\n") == 1 for t in files.values())
        assert sum(len(t) > 2000 for t in files.values()) == 2 and sum(t.count("\n") for t in files.values()) == 400
        seen.append(files)
    assert seen[0] == seen[1]
    etl.write_bounded(df.where("false"), f"{tmp_path}/empty", ["id"])
    assert spark.read.text(f"{tmp_path}/empty").count() == 0


def test_many_files_are_grouped_and_written_by_many_tasks(spark, tmp_path):
    df = spark.range(300).selectExpr("id", "repeat('x', 150) AS name", "'Point' AS geometry_type", "'[0,0]' AS coordinates")
    etl.write_bounded(df, f"{tmp_path}/many", ["id"], max_bytes=1000, grouped=True)
    groups = [g for g in os.listdir(f"{tmp_path}/many") if g.startswith("group=")]
    names = [f for g in groups for f in os.listdir(f"{tmp_path}/many/{g}")]
    assert len(groups) > 20 and len(names) == len(set(names)) > 60 and all(f.startswith("file=") for f in names)
    back = spark.read.schema("value string, file string").text(f"{tmp_path}/many")
    assert sorted(x[0] for x in back.selectExpr("CAST(get_json_object(value, '$.properties.id') AS LONG)").collect()) == list(range(300))
    tasks = {p.split("part-")[1][:5] for g in groups for f in os.listdir(f"{tmp_path}/many/{g}") for p in os.listdir(f"{tmp_path}/many/{g}/{f}") if p.startswith("part-")}
    assert len(tasks) > 20


def test_files_are_written_and_listed_by_tasks(spark, tmp_path):
    """No file is written or listed by Hadoop, whose local files cost a process each; lines come back as they were, old files are not overwritten."""
    df = spark.range(60).selectExpr("id", "CASE WHEN id = 7 THEN repeat('\u00fc', 900) WHEN id > 3 THEN concat('a\\r\\n', id) END AS name", "'Point' AS geometry_type", "'[0,0]' AS coordinates")
    for codec in ("gzip", "none"):
        path = f"{tmp_path}/{codec}"
        etl.write_bounded(df, path, ["id"], max_bytes=400, codec=codec, grouped=True)
        names = [(d, f) for d, _, fs in os.walk(path) for f in fs if "file=" in d]
        assert names and all(f.startswith("part-") and f.endswith(".gz" if codec == "gzip" else ".txt") for _, f in names) and os.path.exists(f"{path}/_SUCCESS")
        by_spark = sorted(tuple(r) for r in spark.read.schema("value string, file string").text(path).select("value", "file").collect())
        back = etl.read_bounded(spark, path)
        assert sorted(tuple(r) for r in back.collect()) == by_spark and len(by_spark) == 60 and not back.inputFiles()
        with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
            etl.write_bounded(df, path, ["id"], max_bytes=400, codec=codec, grouped=True)


def test_features_are_read_as_they_were_written(spark, tmp_path):
    (tmp_path / "a.geojson").write_text('{"type": "FeatureCollection", "features": [{"properties": {"id": 1}, "geometry": {"type": "Point", "coordinates": [1, 2]}},\n {"properties": {"id": 2, "name": "b"}, "geometry": null}]}')
    got = sorted(map(tuple, etl.read_geojson(spark, f"{tmp_path}/a.geojson", "id long, name string").collect()))
    assert got == [(1, None, "Point", "[1, 2]"), (2, "b", None, None)]  # coordinates as the file has them


def test_as_of_merge(spark):
    r = random.Random(4)
    spans = [(k, r.randrange(40), i) for k in range(4) for i in range(r.randrange(12))]
    points = [(k, r.randrange(-5, 45), i) for k in range(5) for i in range(15)]
    df = sequences.as_of(spark.createDataFrame(points, "k long, at long, p long"), spark.createDataFrame(spans, "k long, begin long, s long"), ["k"], "at", "begin", "s")
    want = [(k, at, p, *max((b, s) for q, b, s in spans if q == k and b <= at)) for k, at, p in points if any(q == k and b <= at for q, b, _ in spans)]
    assert sorted(tuple(x) for x in df.collect()) == sorted(want)
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()


def plain_preview(ends, points):
    """The segment under each edge: a cursor that only goes forward."""
    longest = max([1, *[c for c in ends if c is not None]])
    at = [longest * i / max(1, len(points) - 1) if p is None else p for i, p in enumerate(points)]
    out, cursor = [], 0
    for a, b in zip(at, at[1:]):
        while cursor + 1 < len(ends) and ends[cursor] is not None and (a + b) / 2 >= ends[cursor]:
            cursor += 1
        out.append(cursor)
    return out


def test_previews_follow_a_cursor(spark):
    r = random.Random(9)
    segments, points, want = [], [], {}
    for route in range(40):
        ends = sorted(r.randrange(1, 30) for _ in range(r.randint(1, 8)))
        if route % 5 == 4:
            ends[r.randrange(len(ends))] = None
        at = [None if r.random() < 0.2 else r.randrange(35) for _ in range(r.randint(0, 12))]
        if route % 2:
            at = sorted(at, key=lambda x: -1 if x is None else x)
        segments += [(route, i, c) for i, c in enumerate(ends)]
        points += [(route, i, p) for i, p in enumerate(at)]
        want |= {(route, i): s for i, s in enumerate(plain_preview(ends, at))}
    got = sequences.previewed(spark.createDataFrame(segments, "route_id long, seq long, c1 long"), spark.createDataFrame(points, "route_id long, pos long, route_index long")).collect()
    assert {(r.route_id, r.pos): r.seq for r in got} == want and len(got) == len(want)


def test_distances_beyond_and_before_a_route(spark):
    seg = spark.createDataFrame([(1, 0, 10), (1, 1, 0), (1, 2, 5)], "route_id long, seq long, len_m long")
    at = spark.createDataFrame([(1, x) for x in (-1, 0, 9, 10, 14, 15, 99)] + [(2, 0)], "route_id long, at_m long")
    assert sorted((r.at_m, r.seq, r.into_m) for r in sequences.at_distance(seg, at).collect()) == [(0, 0, 0), (9, 0, 9), (10, 2, 0), (14, 2, 4), (15, 2, 5), (99, 2, 89)]
