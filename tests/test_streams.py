"""Streaming forms give what their batch forms give, also over several runs from one checkpoint."""

import pytest
from pyspark.sql import functions as F

from cuemill.operators import tables
from cuemill.streaming import streams


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def read(spark, df, path, files=1):
    df.repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def events(spark, low, high):
    return spark.range(low, high).selectExpr(
        "id as item_id", "id % 7 as video_id", "timestamp_seconds(1700000000 + id * 60) as ts", "element_at(array('queued','running','completed'), cast(id % 3 + 1 as int)) as state", "cast(id % 120 as int) as progress"
    )


def test_latest_state_over_two_runs(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for low, high in ((0, 50), (50, 90)):
        stream = read(spark, events(spark, low, high), source, 2)
        streams.merge_available(streams.latest_state(stream, "10 days"), out + f"/{low}", check, ["video_id"])
    merged = streams.read_merged(spark, out + "/50", ["video_id"])
    want = {tuple(r) for r in tables.latest_state(events(spark, 0, 90)).collect()}
    assert {(r.video_id, r.state, r.progress) for r in merged.collect()} == want


def test_cues_wait_for_their_end(spark, tmp_path):
    schema = "video_id long, line_no long, line string"
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    first = [(1, 0, "1"), (1, 1, "00:00:01,000 --> 00:00:02,000"), (1, 2, "hello"), (1, 3, ""), (1, 4, "2"), (1, 5, "00:00:03 --> 00:00:04")]
    second = [(1, 6, "late text"), (1, 7, ""), (2, 0, "00:05 --> 00:05"), (2, 1, "b"), (2, 2, " ")]
    for rows, want in ((first, {(1, 0, 1000, 2000, "hello")}), (second, {(1, 0, 1000, 2000, "hello"), (1, 1, 3000, 4000, "late text"), (2, 0, 5000, 5050, "b")})):
        stream = read(spark, spark.createDataFrame(rows, schema), source)
        streams.run_available(streams.cue_stream(stream), out, check)
        assert {tuple(r) for r in spark.read.parquet(out).select("video_id", "cue", "start_ms", "end_ms", "text").collect()} == want


def test_stitching_drops_repeats(spark, tmp_path):
    rows = [(1, 0, 0, 1000, "one two"), (1, 1, 1200, 1500, "two"), (1, 2, 900, 2500, "three"), (1, 3, 9000, 9500, "two"), (2, 0, 5, 10, "x")]
    stream = read(spark, spark.createDataFrame(rows, streams.CUES), str(tmp_path / "in"))
    streams.run_available(streams.stitch_stream(stream), str(tmp_path / "out"), str(tmp_path / "check"))
    got = {(r.video_id, r.cue, r.start_ms, r.text) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, 0, 0, "one two"), (1, 2, 900, "three"), (1, 3, 9000, "two"), (2, 0, 5, "x")}


def test_retries_are_dropped_and_only_final_windows_appear(spark, tmp_path):
    cues = spark.range(20).selectExpr("id % 3 as video_id", "id % 5 as cue", "timestamp_seconds(1700000000 + id) as ts")
    stream = read(spark, cues, str(tmp_path / "a"))
    streams.run_available(streams.unique_cues(stream), str(tmp_path / "b"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "b")).select("video_id", "cue").distinct().count() == spark.read.parquet(str(tmp_path / "b")).count() == 15
    spans = spark.range(200).selectExpr("id % 2 as video_id", "timestamp_seconds(1700000040 + id * 2) as ts", "id * 100 as start_ms", "id * 100 + 50 as end_ms")
    stream = read(spark, spans, str(tmp_path / "d"))
    streams.run_available(streams.stable_spans(stream), str(tmp_path / "e"), str(tmp_path / "f"))
    got = {(r.video_id, r.from_ts): (r.spans, r.speech_ms) for r in spark.read.parquet(str(tmp_path / "e")).collect()}
    want = {(r.video_id, r.w.start): (r.n, r.s) for r in spans.groupBy("video_id", F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("n"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("s")).collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(got) < len(want)


def test_running_language(spark, tmp_path):
    rows = [(1, "plain english words here"), (1, "这是一个很长的中文句子用来测试语言判断"), (2, "hello there friend")]
    df = spark.createDataFrame(rows, "video_id long, text string")
    stream = read(spark, df, str(tmp_path / "in"), 2)
    streams.merge_available(streams.script_counts(stream), str(tmp_path / "out"), str(tmp_path / "check"), ["video_id"])
    got = {r.video_id: (r.segments, r.language) for r in streams.read_merged(spark, str(tmp_path / "out"), ["video_id"]).collect()}
    assert got == {1: (2, "Chinese"), 2: (1, "English")}


def test_the_next_number_ends_a_cue_in_any_cut(spark, tmp_path):
    """Cues without blank lines between, numbers as text, and a tail; whatever the cut, the stream gives what the batch reader does."""
    from cuemill.sources import formats

    body = "1\n00:00:01,000 --> 00:00:04,500\nHello world!\n\n2\n00:00:05,200 --> 00:00:08,100\nThis is line 2.\n3\n00:00:08,500 --> 00:00:10,000\n42\nis the answer\n7\n\n00:00:11 --> 00:00:12\nno number\n9\n"
    want = {(r.start_ms, r.end_ms, r.text) for r in formats.parse_srt(spark.createDataFrame([("a", body)], "file string, body string")).collect()}
    assert {w[2] for w in want} == {"Hello world!", "This is line 2.", "42\nis the answer\n7", "no number\n9"}
    lines = [*body.split("\n")[:-1], None]
    schema = "video_id long, line_no long, line string"
    runs = [[(v, k, line) for v, cut in enumerate(cuts) for k, line in enumerate(lines) if (k >= cut) == late] for cuts in [tuple(range(1, len(lines)))] for late in (False, True)]
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for rows in runs:
        streams.run_available(streams.cue_stream(read(spark, spark.createDataFrame(rows, schema), source)), out, check)
    got = {}
    for r in spark.read.parquet(out).collect():
        got.setdefault(r.video_id, set()).add((r.start_ms, r.end_ms, r.text))
    assert len(got) == len(lines) - 1 and all(g == want for g in got.values())


def test_an_idle_tail_ends_with_the_watermark(spark, tmp_path):
    rows = [(1, 0, "5", 0), (1, 1, "00:01 --> 00:02", 0), (1, 2, "tail", 1), (1, 3, "8", 1), (2, 0, "x", 400)]
    frame = spark.createDataFrame(rows, "video_id long, line_no long, line string, s long").selectExpr("video_id", "line_no", "line", "timestamp_seconds(1700000000 + s) AS ts")
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    streams.run_available(streams.cue_stream(read(spark, frame, str(tmp_path / "in")), "30 seconds"), out, check)
    assert [(r.video_id, r.start_ms, r.text) for r in spark.read.parquet(out).collect()] == [(1, 1000, "tail\n8")]


def test_stable_pairs_are_those_of_the_batch(spark, tmp_path):
    """Shuffled input in small files over two runs: each pause comes out once, and only stable ones before the end."""
    from cuemill.operators import sequence

    spans = spark.range(300).selectExpr(
        "id % 3 AS video_id", "id DIV 3 AS seg_idx", "timestamp_seconds(1700000000 + (id DIV 3) * 2) AS ts", "(id DIV 3) * 2000 + id * 37 % 500 AS start_ms", "(id DIV 3) * 2000 + 900 + id * 91 % 1000 AS end_ms",
    ).cache()
    want = {tuple(r) for r in sequence.pauses(spans).collect()}
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for low, high in ((0, 50), (50, 100)):
        part = spans.where(f"seg_idx >= {low} and seg_idx < {high}")
        for lo in range(low, high, 10):  # within ten spans any order
            part.where(f"seg_idx >= {lo} and seg_idx < {lo + 10}").orderBy(F.rand(lo)).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(spans.schema).option("maxFilesPerTrigger", 1).parquet(source)
        streams.run_available(streams.stable_pauses(stream, "40 seconds"), out, check)
        got = [tuple(r) for r in spark.read.parquet(out).select("video_id", "seg_idx", "from_ms", "gap_ms", "mid_ms").collect()]
        assert len(set(got)) == len(got) and set(got) <= want
        assert set(got) == {w for w in want if w[1] < high - 21}
    end = spark.createDataFrame([(9, 0, 0, 0)], "video_id long, seg_idx long, start_ms long, end_ms long").selectExpr("video_id", "seg_idx", "timestamp_seconds(1800000000) AS ts", "start_ms", "end_ms")
    end.write.mode("append").parquet(source)
    streams.run_available(streams.stable_pauses(spark.readStream.schema(spans.schema).parquet(source), "40 seconds"), out, check)
    got = [tuple(r) for r in spark.read.parquet(out).select("video_id", "seg_idx", "from_ms", "gap_ms", "mid_ms").collect()]
    assert sorted(got) == sorted(want) and len(want) > 100
    spans.unpersist()
