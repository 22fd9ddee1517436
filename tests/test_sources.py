"""Files read by many tasks, and broken ones."""

import pytest

from cuetrail import catalog
from cuetrail.plans import source_queries
from cuetrail.sources import artifacts, subtitles


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def cue(i, mark):
    at = f"00:{i // 60:02d}:{i % 60:02d}{mark}000"
    return f"{at} --> {at[:-3]}500", f"line {i} é\nof two"


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_one_file_in_many_splits(spark, tmp_path, small_splits, end):
    """Cues come whole and in order wherever the splits fall; files with other line ends are read as one record."""
    n = 400
    srt = "\n\n".join(f"{i + 1}\n{t}\n{x}" for i in range(n) for t, x in [cue(i, ",")])
    vtt = "WEBVTT\n\nNOTE x\ny\n\n" + "\n\n".join(f"{i + 1}\n{t} align:start\n{x}" for i in range(n) for t, x in [cue(i, ".")])
    (tmp_path / "a.srt").write_bytes(("\n \n\n" + srt + "\n\n").replace("\n", end).encode())
    (tmp_path / "a.vtt").write_bytes(vtt.replace("\n", end).encode())
    want = [(i, i + 1, float(i), i + 0.5, cue(i, ",")[1]) for i in range(n)]
    for read, name in ((subtitles.read_srt, "a.srt"), (subtitles.read_vtt, "a.vtt")):
        rows = read(spark, str(tmp_path / name))
        assert [tuple(r)[1:] for r in rows.orderBy("pos").collect()] == want
    assert end == "\r\n" or spark.read.option("lineSep", "\n\n").text(str(tmp_path / "a.srt")).rdd.getNumPartitions() > 10
    assert subtitles.rejected_srt(spark, str(tmp_path / "a.srt")).count() == 0


def test_broken_blocks_and_empty_files(spark, tmp_path):
    (tmp_path / "a.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\n one \n\nx\n00:00:01,000 --> 00:00:02,000\nno number\n\n3\n00:00:01,000\nno end\n\n4\n00:00:05,000 --> 00:00:06,000\n\n5\n0:0:7 --> 8\nlast\n")
    (tmp_path / "b.srt").write_text("")
    got = [tuple(r)[1:] for r in subtitles.read_srt(spark, str(tmp_path)).orderBy("pos").collect()]
    assert got == [(0, 1, 1.0, 2.0, "one"), (1, 5, 7.0, 8.0, "last")]
    assert subtitles.rejected_srt(spark, str(tmp_path)).count() == 3
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.vtt").write_text("WEBVTT\n\n00:01.000 --> 00:02.000\n\n00:03.000 --> x\nbad\n\n00:04.000 --> 00:05.000\na\nNOTE b\nc\n")
    got = [tuple(r)[1:] for r in subtitles.read_vtt(spark, str(tmp_path / "c")).orderBy("pos").collect()]
    assert got == [(0, 1, 1.0, 2.0, ""), (1, 2, 4.0, 5.0, "a")]
    assert [r.text for r in subtitles.rejected_vtt(spark, str(tmp_path / "c")).collect()] == ["00:03.000 --> x"]


def test_a_pack_reads_as_its_files(spark, tmp_path):
    """Projects, broken files, jobs, packages and digests are the same from files and from a pack of them."""
    from pyspark.sql import functions as F

    files = {
        "p/a/project.json": '{"project_id": "a",\n "state": "NEW", "more": {"x": [1]}}\n', "p/b/project.json": '{"project_id": "b", "title":', "p/c/project.json": " \n", "p/d/other.json": '{"project_id": "d"}',
        "j/new/x/job.json": '{"movie_title": "X"}', "j/new/x/metadata.json": '{"title": "no", "duration": 3.5}', "j/old/y/metadata.json": '{"title": "Y"}', "j/old/y/z.json": '{"title": "Z"}', "j/old/w/job.json": "{",
        "i/f1/m.MP4": "abc", "i/f1/done.csv": "x", "i/f2/m.mkv": "ab", "i/f2/note.txt": "", "i/f3/_done.csv": "x", "i/f3/m.mp4": "a",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    root, packs = str(tmp_path), {k: str(tmp_path / f"pack_{k}") for k in "pji"}
    for k, pack in packs.items():
        rows = [(f"file:{tmp_path}/{name}", text.encode()) for name, text in files.items() if name.startswith(f"{k}/")]
        artifacts.pack(spark.createDataFrame(rows, "path string, content binary"), pack)
    tail = F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("path")
    sets = {
        "projects": lambda at, packed: artifacts.read_projects(spark, at("p"), packed=packed),
        "broken": lambda at, packed: artifacts.quarantine(spark, at("p") + ("" if packed else "/*/*"), artifacts.PROJECT, packed=packed).select(tail, "record"),
        "jobs": lambda at, packed: artifacts.read_jobs(spark, at("j"), packed=packed),
        "digests": lambda at, packed: artifacts.fingerprints(spark, at("p") + ("" if packed else "/*/*"), packed=packed).select(tail, "length", "sha256"),
    }
    for name, of in sets.items():
        rows = [sorted(map(str, of(at, packed).collect())) for at, packed in ((lambda k: f"{root}/{k}", False), (packs.get, True))]
        assert rows[0] == rows[1] and rows[0], name
    assert [(r.folder[-2:], r.length) for r in artifacts.incoming(spark, packs["i"], "done.csv", packed=True).collect()] == [("f2", 2)]
    direct = {r.folder[-2:] for r in artifacts.incoming(spark, f"{root}/i", "done.csv").collect()}
    assert direct - {"f3"} == {"f2"}  # Spark lists no names that begin with _


@pytest.mark.parametrize("name", ["incoming_packages", "job_files", "project_files", "quarantined_projects", "file_fingerprints"])
def test_files_do_not_grow_with_rows(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(source_queries, "scratch_dir", lambda spark: f"file://{tmp_path}/made")
    catalog.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    assert 0 < len(list(tmp_path.rglob("*.parquet"))) <= 4 and not list(tmp_path.rglob("*.txt"))
