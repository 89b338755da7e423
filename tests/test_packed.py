import os

import pytest
from pyspark.sql import functions as F

from kinetrail.catalog import files
from kinetrail.catalog.base import CATALOG, samples
from kinetrail.sources import logs, packed, track_files

SF = "/root/testdata/sf0.001"


def texts(place):
    return [f for f in os.listdir(place) if f.endswith((".txt", ".csv"))] + [
        d for d in os.listdir(place) if os.path.isdir(f"{place}/{d}")]


@pytest.mark.parametrize("name", ["s1_mixed_headers", "s1_csv_round_trip", "s3_track_text"])
def test_no_file_per_recording(spark, tmp_path, monkeypatch, name):
    """files go by the parts that rows lie in, not by recordings."""
    from kinetrail.catalog import load

    load()
    places = []
    monkeypatch.setattr(files, "scratch", lambda s, n: places.append(f"{tmp_path}/{n}") or places[-1])
    CATALOG[name].run(spark, SF)
    s = samples(spark, SF)
    assert s.select("capture_id").distinct().count() > s.rdd.getNumPartitions()
    assert 0 < len(texts(places[0])) <= s.rdd.getNumPartitions()


def test_packed_equals_a_file_each(small_blocks, tmp_path):
    """Four kinds of header, recordings over several blocks and parts: the same rows as from a file per recording."""
    spark = small_blocks
    files.mixed_files(spark, SF, f"{tmp_path}/each")
    packed.pack(files.mixed_lines(spark, SF).repartition(5), f"{tmp_path}/packed")
    a = logs.load_logs(logs.read_logs(spark, f"{tmp_path}/each", F.expr(files._OWN_FOLDER)))
    b = logs.load_logs(logs.read_packed(spark, f"{tmp_path}/packed"))
    cols = ["capture_id", "i", "t", "dt", "ax", "gz", "phase", "rgt"]
    a, b = (sorted(map(tuple, x.select(*cols).collect()), key=lambda r: (r[0], r[1])) for x in (a, b))
    assert a == b and {r[6] for r in a} == {None, 0, 1, 2}


def test_packed_lines_come_back_as_they_were(spark, tmp_path):
    lines = [("a", 0, "x\ty,\"z\"\\"), ("a", 1, ""), ("b", 0, "# fps = 30"), ("b", 1, "t,x,height"), ("b", 2, "0.5,1,2\tq")]
    packed.pack(spark.createDataFrame(lines, "file string, number long, text string"), f"{tmp_path}/p")
    assert sorted(map(tuple, packed.unpack(spark, f"{tmp_path}/p").collect())) == lines
    clips, frames = track_files.read_packed(spark, f"{tmp_path}/p")
    assert [(r.clip_id, r.fps) for r in clips.collect()] == [("b", 30.0)]
    assert [(r.clip_id, r.t, r.x, r.height) for r in frames.collect()] == [("b", 0.5, 1.0, None)]


def test_the_landing_of_a_stream_goes_by_parts(spark, tmp_path, monkeypatch):
    """no file per recording lands, and the landing is still several batches that count once."""
    from kinetrail.catalog import load
    from kinetrail.streaming import jobs

    load()
    places = []
    monkeypatch.setattr(files, "scratch", lambda s, n: places.append(f"{tmp_path}/{n}") or places[-1])
    got = CATALOG["x1_stream_ingest"].run(spark, SF)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    landed = [f for f in texts(f"{places[0]}/in")]
    assert samples(spark, SF).select("capture_id").distinct().count() > parts >= len(landed) > 1
    manifest = spark.read.parquet(f"{places[0]}/table/manifest")
    assert manifest.count() == len(landed) and manifest.select("part").distinct().count() == min(8, len(landed))
    assert got.count() == jobs.committed(spark, f"{places[0]}/table").count() == samples(spark, SF).count()


def test_packed_files_are_ingested_once_and_names_belong_to_their_file(spark, tmp_path):
    """A name that two landed files share is a recording in each, with its own header; a file that lands later is taken then."""
    from kinetrail.streaming import jobs

    core, turned = ",".join(logs.CORE), "t," + ",".join(logs.CORE[:0:-1])
    row = ",".join(str(float(k)) for k in range(len(logs.CORE)))
    for k, names in enumerate([core, turned, core]):
        lines = [("a", -1, names), ("a", 0, row), ("a", 1, row), ("b", -1, core + ",phase"), ("b", 0, row + f",{k}")]
        packed.pack(spark.createDataFrame(lines, "file string, number long, text string").coalesce(1), f"{tmp_path}/in/{k}")
        if k:
            jobs.ingest_files(spark, f"{tmp_path}/in", f"{tmp_path}/table", f"{tmp_path}/{k % 2}", files_per_batch=1, packed=True).awaitTermination()
    got = jobs.committed(spark, f"{tmp_path}/table").collect()
    last = float(len(logs.CORE) - 1)
    assert sorted((r.capture_id, r.qw, r.gz, r.phase) for r in got if r.capture_id == "a") == [("a", 1.0, last, None)] * 4 + [("a", last, 1.0, None)] * 2
    assert sorted((r.qw, r.gz, r.phase) for r in got if r.capture_id == "b") == [(1.0, last, float(k)) for k in range(3)]
    assert len(got) == 9 and spark.read.parquet(f"{tmp_path}/table/manifest").count() == 3
