import json

from pyspark.sql import functions as F

from partloom.sources import kernel, readers, sinks
from partloom.streaming import candidates as streaming


def test_part_files(spark, tmp_path):
    for name in ("a/x.STEP", "a/b/y.brp", "z.stpz", "note.txt"):
        p = tmp_path / "root" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("FILE_SCHEMA(('AP203'));")
    files = readers.part_files(spark, str(tmp_path / "root"))
    assert [r["ext"] for r in files.collect()] == [".brp", ".step", ".stpz"]
    assert readers.part_files(spark, str(tmp_path / "root"), fraction=0.1).count() == 1
    assert readers.part_files(spark, str(tmp_path / "root"), count=2).count() == 2
    c = readers.file_contents(spark, str(tmp_path / "root")).collect()
    assert len({r["content_hash"] for r in c}) == 1 and sum(r["text"] is None for r in c) == 1
    done = files.limit(2)
    assert readers.changed_only(files, done).count() == 1


def test_work_per_file(spark, tmp_path):
    for i, body in enumerate(("one two", " ", "bad", "slow")):
        (tmp_path / f"{i}.stp").write_text(body)

    def worker(path, content):
        import time

        if content == b"bad":
            raise ValueError("cannot read file: error")
        if content == b"slow":
            time.sleep(30)
        return [{"word": w} for w in content.decode().split()]

    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = kernel.run_files(files, worker, "word string", seconds=1).collect()
    by = {}
    for r in got:
        by.setdefault(r["path"][-5], []).append((r["status"], r["word"], r["error"]))
    assert sorted(by["0"]) == [("written", "one", None), ("written", "two", None)]
    assert by["1"] == [("no_cand", None, None)] and by["2"] == [("failed", None, "read_fail")] and by["3"] == [("failed", None, "timeout")]


def test_tables_round_trip(spark, tmp_path):
    rows = [("p,1", "a/b", "d", "h", True, [0.5, 0.25], None, [1.0], [], None)]
    df = spark.createDataFrame(rows, readers.SIGNATURES)
    sinks.write_csv(df, str(tmp_path / "s"))
    back = readers.signatures_csv(spark, str(tmp_path / "s")).first()
    assert back["part_id"] == "p,1" and back["has_points"] is True and back["d2_hist"] == [0.5, 0.25] and back["bbox_ratio"] is None
    m = spark.createDataFrame([("lodo", 0, "train", "a/b"), ("lodo", 0, "test", "c"), ("lodo", 1, "calib", None)], "protocol string, split_id int, subset string, part_id string")
    sinks.write_splits(m, str(tmp_path / "splits"))
    for k in ("lodo/split_0", "lodo/split_x"):
        (tmp_path / "lists" / k).mkdir(parents=True)
        (tmp_path / "lists" / k / "train.txt").write_text(" a \n\n b\n")
    got = readers.id_lists(spark, str(tmp_path / "lists"))
    assert sorted((r["protocol"], r["split_id"], r["part_id"]) for r in got.collect()) == [("lodo", 0, "a"), ("lodo", 0, "b")]
    assert "| part_id |" in sinks.markdown("x", m.select("part_id"))


def test_json_lines_count_bad_ones(spark, tmp_path):
    good = {"hole_id": "h", "primitives": [{"kind": "cylinder", "params": {"radius": 1.0}}], "D0": 1.0, "H0": None, "alpha0": None, "q": 0.5, "flags": {"has_entry_ring": True, "coax_dot": 0.1}}
    p = tmp_path / "c.jsonl"
    p.write_text(json.dumps(good) + "\n{broken\n\n")
    rows, bad = readers.json_lines(spark, str(p), readers.CANDIDATES)
    assert rows.count() == 1 and bad.count() == 1 and rows.first()["flags"]["has_entry_ring"] is True
    df = rows.select("hole_id", F.col("hole_id").alias("part_id"), "q")
    assert sinks.write_new(df, str(tmp_path / "out")) == 1 and sinks.write_new(df, str(tmp_path / "out")) == 0
    stream = tmp_path / "in"
    stream.mkdir()
    (stream / "a.json").write_text(json.dumps(good) + "\n" + json.dumps(good | {"q": 7}) + "\n")
    q = streaming.keep_sound(streaming.arriving(spark, str(stream)), str(tmp_path / "sound"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "sound")).count() == 1


def test_maps_reports_and_names(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"a": "c", "b": "c"}')
    assert {tuple(r) for r in readers.json_map(spark, str(tmp_path / "m.json"), "string").collect()} == {("a", "c"), ("b", "c")}
    (tmp_path / "log.txt").write_text("x\nrecall: 0.3833 of 600\n")
    r = readers.report_metrics(spark, str(tmp_path / "log.txt"), {"recall": r"recall: ([0-9.]+)", "none": r"latency ([0-9]+)"}).first()
    assert r["recall"] == 0.3833 and r["none"] is None
    df = spark.createDataFrame([("p", "r/x/y", 1)], "Part_ID string, rel_path string, Units int")
    assert readers.resolve_columns(df, ["part_id", "unit", "family"]) == {"part_id": "Part_ID", "unit": "Units", "family": None}
    parts = spark.createDataFrame([("p", "r/x/y"), ("q", "none")], "part_id string, rel_path string")
    listing = spark.createDataFrame([("/base/r/x/y",), ("/root/x/y",)], "path string")
    got = {r["part_id"]: r["file"] for r in readers.resolve_paths(parts, listing, {"r": "/root"}, ["/base"]).collect()}
    assert got == {"p": "/root/x/y", "q": None}
    assert readers.keyed_last(spark.createDataFrame([("k", "a", 1), ("k", "b", 2), ("k", "", 3), ("l", None, 1)], "k string, v string, n int"), "k", "n").first()["v"] == "b"
    assert readers.seeded_sample(spark.range(50), "id", 7).count() == 7


def test_text_keeps_accents_and_drops_what_is_no_utf8(spark, tmp_path):
    (tmp_path / "a.stp").write_bytes("FILE_NAME('Müller \xff".encode("latin-1").replace("Müller".encode("latin-1"), "Müller".encode()) + b"')")
    assert readers.file_contents(spark, str(tmp_path)).first()["text"] == "FILE_NAME('Müller ')"


def test_files_per_part_failures_maps_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([("a/b", 1), ("a/b", 2), ("c", 3)], "part_id string, n int")
    also = spark.createDataFrame([("none",), ("c",)], "part_id string")
    for _ in range(2):
        sinks.write_per_part(rows, str(tmp_path / "p"), also=also)
    back = {(r["file"], r["value"]) for r in spark.read.text(str(tmp_path / "p")).collect()}
    assert back == {("a__b", '{"part_id":"a/b","n":1}'), ("a__b", '{"part_id":"a/b","n":2}'), ("c", '{"part_id":"c","n":3}'), ("none", "")}
    done = spark.createDataFrame([("x", "failed", "timeout", "too\tlong"), ("y", "written", None, None)], "path string, status string, error string, message string")
    sinks.write_failures(done, str(tmp_path / "f"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "f")).collect()] == ["x\ttimeout\ttoo long"]
    sinks.write_json_map(rows, "n", "part_id", str(tmp_path / "m"), pieces=2)
    assert {tuple(r) for r in readers.json_map(spark, str(tmp_path / "m"), "string", whole=False).collect()} == {("1", "a/b"), ("2", "a/b"), ("3", "c")}
    text = sinks.report("run", {"recall": 0.5, "eval_tolerances": {"axis": 5.73}}, {"rows": rows})
    (tmp_path / "r.md").write_text(text)
    assert readers.report_metrics(spark, str(tmp_path / "r.md"), {"recall": r"recall:\s*([0-9.]+)"}).first()["recall"] == 0.5
    assert [(r["key"], r["value"]) for r in readers.report_json(spark, str(tmp_path / "r.md"), "eval_tolerances", "double").collect()] == [("axis", 5.73)]


def test_cached_and_new_results_are_united(spark):
    listing = spark.createDataFrame([("a", 1, "t"), ("b", 2, "t"), ("c", 3, "u")], "path string, size int, modified string")
    cache = spark.createDataFrame([("a", 1, "t", "old"), ("c", 3, "t", "old"), ("gone", 1, "t", "old")], "path string, size int, modified string, result string")
    got = readers.refreshed(listing, cache, lambda df: df.withColumn("result", F.lit("new")))
    assert {(r["path"], r["result"]) for r in got.collect()} == {("a", "old"), ("b", "new"), ("c", "new")}


def test_rebuild_skips_what_is_there_or_unknown(spark):
    lines = spark.createDataFrame([("a",), ("a",), ("b",), ("gone",), (None,)], "part_id string")
    files = spark.createDataFrame([("a", "/a", 1, bytearray(b"x y")), ("b", "/b", 9, bytearray(b"z")), ("other", "/o", 1, bytearray(b"z"))], "part_id string, path string, length long, content binary")
    got = kernel.rebuild(lines, files, spark.createDataFrame([("b",)], "part_id string"), lambda path, content: [{"word": w} for w in content.decode().split()], "word string").collect()
    assert sorted((r["part_id"], r["status"], r["word"]) for r in got if r["word"]) == [("a", "written", "x"), ("a", "written", "y")]
    assert {(r["part_id"], r["status"]) for r in got if not r["word"]} == {("b", "skip_exists"), ("gone", "skip_unresolved")}
