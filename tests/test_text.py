"""Rules on literal rows: what the supplied tables cannot trigger."""

import pytest
from pyspark.sql import functions as F

from cuemill.functions import text as X
from cuemill.operators import joins, repair, segments, sequence, tables
from cuemill.sources import formats


def values(spark, expr, texts, kind="string"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i long, t {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("t"))).collect()]


def test_source_keys(spark):
    cases = [
        ("bilibili", "https://www.bilibili.com/video/BV1xx411c7mD?p=2", "bilibili:bv1xx411c7md"), ("bilibili", "BV1xx411c7mDextra", "bilibili:bv1xx411c7md"),
        ("youtube", "https://www.youtube.com/watch?v=AbC123&t=9", "youtube:abc123"), ("video", "https://youtu.be/AbC123?x=1", "youtube:abc123"),
        ("video", " HTTPS://Example.com/A/?q=1#f ", "https://example.com/a"), ("local", "C:\\Films\\A.MP4", "local:c:/films/a.mp4"), ("video", "not a url", "not a url"),
    ]
    df = spark.createDataFrame([(i, p, s) for i, (p, s, _) in enumerate(cases)], "i int, platform string, source_url string")
    got = [r.source_key for r in joins.with_source_key(df).orderBy("i").collect()]
    assert got == [c[2] for c in cases]


def test_display_and_clocks(spark):
    assert values(spark, X.play_count, [9999, 10000, 12345, 110250, 100_000_000, 0], "long") == ["9999", "1.0万", "1.2万", "11.0万", "1.0亿", "0"]
    assert values(spark, X.china_date, [0, -1, 1_700_000_000, 57_599, 57_600], "long") == ["", "", "2023-11-15", "1970-01-01", "1970-01-02"]
    assert values(spark, X.short_clock, [0.4, 59.6, 3600.0, -5.0], "double") == ["00:00", "01:00", "01:00:00", "00:00"]
    assert values(spark, tables.sort_key_seconds, ["1:02:03", "02:03", "7", "x"]) == [3723.0, 123.0, 7.0, None]
    assert values(spark, tables.sort_key_count, ["1.5万", "2亿", "17", ""]) == [15000.0, 2e8, 17.0, None]


def test_languages_and_tokens(spark):
    assert values(spark, X.language, ["これはテスト", "한국어 테스트", "这是一个测试", "plain english words", "中", "abc 中文字符串 def ghi", ""]) == [
        "Japanese", "Korean", "Chinese", "English", "Chinese", "Chinese", "English",
    ]
    assert values(spark, X.language_profile, ["zh-CN", "cmn", "EN-us", "ja", "korean", "mixed", "fr", None]) == ["Zh", "Zh", "En", "Ja", "Ko", "Mixed", "Auto", "Auto"]
    assert values(spark, X.tokens, ["ＡＢＣ１ foo_bar，你好!", ""]) == [["abc1", "foo_bar", "你", "好"], []]
    assert values(spark, X.platform_of, ["https://B23.tv/x", "https://m.x.com/", "https://max.com/", "nothing"]) == ["bilibili", "twitter", "video", "video"]


@pytest.mark.parametrize(
    "text,want",
    [("三点一四", "3.14"), ("百分之三十五", "35%"), ("百分之十二点五", "12.5%"), ("二百五", "二百五"), ("一百零五点二", "105.2"), ("3 . 5 版", "3.5 版"), ("百分之二百五", "百分之二百五"), ("两万点五", "20000.5"), ("一点", "一点"), ("", "")],
)
def test_spoken_numbers(text, want):
    assert repair.spoken_numbers(text) == want


def test_cleaning(spark):
    assert values(spark, X.clean_asr, ["<|zh|>[S01] [0.00] hello  you [3.5]", "[12.50]"]) == ["hello you", ""]
    assert values(spark, X.collapse_marks, ["好，。！", "吗？！", "嗯、，", "啊。，", "a。"]) == ["好！", "吗？", "嗯、", "啊。", "a。"]
    once = values(spark, X.clean_translation, ["<|im_start|>assistant\nTranslation: Hallo\n\n```\nWelt</s>", "Hallo"])
    assert once == ["Hallo\nWelt", "Hallo"] and values(spark, X.clean_translation, once) == once
    assert values(spark, X.strip_html, ["<em class=k>A</em> &amp; B&quot;", "a < b"]) == ['A & B"', "a < b"]


def test_srt_blocks(spark):
    body = "1\r\n00:00:01,000 --> 00:00:02.500\r\n<|en|>Hello\r\nyou\r\n\r\n\r\n01:02 --> 01:02\nno index\n\n3\nbroken --> line\nx\n\n4\n5 --> 6.25\n"
    got = formats.parse_srt(spark.createDataFrame([("f", body)], "file string, body string")).orderBy("start_ms").collect()
    assert [(r.start_ms, r.end_ms, r.text) for r in got] == [(1000, 2500, "Hello\nyou"), (62000, 62050, "no index")]
    windows = spark.createDataFrame([("f", 0, 1750), ("f", 1750, 10_000)], "file string, from_ms long, to_ms long")
    held = formats.parse_srt(spark.createDataFrame([("f", body)], "file string, body string"), windows).collect()
    assert [(r.start_ms, r.from_ms) for r in held] == [(1000, 1750)]


def test_recogniser_bodies(spark):
    bodies = [
        ("a", '{"segments":[{"start":0.5,"end":9,"text":"[S01] one"},{"start":2,"end":3,"text":"..."}]}'), ("b", '{"result":{"utterances":[{"start_time":1,"end_time":2,"transcript":"two"}]}}'),
        ("c", '{"text":"whole"}'), ("d", "[0.00] tagged text [1.50] rest"), ("e", '{"segments":[]}'), ("f", "nothing here"), ("g", None),
    ]
    df = spark.createDataFrame([(*b, 5.0) for b in bodies], "id string, body string, duration double")
    got = {r.id: (r.start_s, r.end_s, r.text) for r in formats.parse_asr_json(df).collect()}
    assert got == {"a": (0.5, 5.0, "one"), "b": (1.0, 2.0, "two"), "c": (0.0, 5.0, "whole"), "d": (0.0, 1.5, "tagged text"), "f": (0.0, 5.0, "nothing here")}


def test_silence_log(spark):
    lines = ["silence_start: 1.5", "noise", "silence_end: 2.5 | x", "silence_end: 3", "silence_start: -0.2", "silence_end: 4", "silence_start: 9", "silence_end: 8"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no int, line string")
    assert [(r.start_s, r.end_s) for r in formats.parse_silence_log(df).collect()] == [(1.5, 2.5)]


def test_media_catalog_and_texts(spark, tmp_path):
    for name in ("a.MP4", "b.mp3", "c.txt", "sub/d.flac"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * 10)
    got = {r.path.rsplit("/", 1)[1]: r.audio_only for r in formats.media_catalog(spark, str(tmp_path)).collect()}
    assert got == {"a.MP4": False, "b.mp3": True, "d.flac": True}
    formats.write_texts(spark.createDataFrame([(7, "1\n00:00:01,000 --> 00:00:02,000\nhi\n")], "video_id long, body string"), str(tmp_path / "out"))
    back = formats.parse_srt(formats.read_texts(spark, str(tmp_path / "out/srt/video_id=7")))
    assert [(r.start_ms, r.text) for r in back.collect()] == [(1000, "hi")]


def test_noisy_json(spark):
    raws = ['echo {"a": 1} then {"b": {"c": "}"}} tail', "none", '{"cut": ', '{"s": "a\\"}"}', None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    assert [r.json for r in repair.extract_json(df, "raw").orderBy("i").collect()] == ['{"b": {"c": "}"}}', None, None, '{"s": "a\\"}"}', None]


def test_entities(spark):
    rows = [
        (1, 0, "Mrs. Stingy met Mister Bond and NASA."), (1, 1, "missus Stingy saw OpenData"), (1, 2, "Mrs. Stingy, OpenData and NASA again with Mr. Bond"),
        (1, 3, "THIS IS ALL CAPS PROSE WITH NASA IN IT"),
    ]
    seg = spark.createDataFrame(rows, "video_id long, seg_idx long, text string")
    got = {r.normalized: (r.canonical, r.occurrences) for r in repair.entity_memory(seg).collect()}
    assert got == {"mrs stingy": ("Mrs. Stingy", 3), "mr bond": ("Mr. Bond", 2), "nasa": ("NASA", 2), "opendata": ("OpenData", 2)}
    memory = repair.entity_memory(seg)
    names = spark.createDataFrame([(1, "mrs stinky"), (1, "opendata"), (1, "zzzz")], "video_id long, name string")
    assert [(r.name, r.entity) for r in joins.entity_variants(names, memory).collect()] == [("mrs stinky", "mrs stingy")]
    variants = spark.createDataFrame([(1, "nasa", 0), (1, "New", 1)], "video_id long, word string, pos int")
    assert [r.word for r in repair.hotwords(variants, memory).orderBy("rank").collect()][:2] == ["nasa", "New"]


def test_integrity_tags(spark):
    rows = [(1, 0, "哈哈哈哈哈哈哈哈哈", "Zh"), (1, 1, "abab abab abab", "En"), (1, 2, "嗯。", "Zh"), (1, 3, "ok", "Zh"), (1, 4, "fine words here", "En"), (1, 5, "  ", "En")]
    seg = spark.createDataFrame(rows, "video_id long, seg_idx long, text string, profile string")
    confidence = spark.createDataFrame([(1, 3, 0.2), (1, 1, 0.9)], "video_id long, seg_idx long, avg_confidence double")
    got = {r.seg_idx: r.rule_id for r in segments.tag_integrity(seg, confidence).collect()}
    assert got == {0: "probable_decode_loop", 1: None, 2: "filler_only_segment_preserved", 3: "low_confidence_script_outlier", 4: None}


def test_sentences_and_plan(spark):
    rows = [(1, 0, "Dr. A. Smith paid 3.5 dollars. \"Really?\" Yes! End", 0, 5000)]
    seg = spark.createDataFrame(rows, "video_id long, seg_idx long, text string, start_ms long, end_ms long")
    assert [r.sentence for r in sequence.split_sentences(seg).orderBy("part").collect()] == ["Dr. A. Smith paid 3.5 dollars.", '"Really?"', "Yes!", "End"]
    totals = spark.createDataFrame([(1, 100_000), (2, 5_000)], "video_id long, total_ms long")
    gaps = spark.createDataFrame([(1, 29_000, 1_000), (1, 55_000, 100)], "video_id long, from_ms long, gap_ms long")
    got = [(r.video_id, r.start_s, r.end_s, r.is_soft_cut) for r in sequence.plan_chunks(totals, gaps).orderBy("video_id", "chunk").collect()]
    assert got == [(1, 0.0, 29.5, False), (1, 29.5, 59.5, True), (1, 58.5, 88.5, True), (1, 87.5, 100.0, False), (2, 0.0, 5.0, False)]


def test_migration(spark):
    jobs = spark.createDataFrame([("demo-1", "t", "completed", 5, 1), ("a", "t", "completed", 50, 2), ("b", "t", "running", 100, 3), ("c", "t", "error", 7, 4)], "id string, title string, status string, progress int, updated_at long")
    videos, queue = tables.migrate_jobs(jobs, spark.createDataFrame([("c",)], "id string"))
    assert {r.id: r.library_available_at for r in videos.collect()} == {"a": 2, "b": None}
    assert {r.id: (r.state, r.progress) for r in queue.collect()} == {"a": ("completed", 100), "b": ("queued", 99)}


def test_deep_pages_follow_key_sets(spark):
    videos = spark.range(50).selectExpr("id as video_id", "id div 3 as updated_at")
    first = videos.orderBy(F.desc("updated_at"), F.desc("video_id")).limit(40).collect()
    page = [r.video_id for r in tables.library_after(videos, first[19].updated_at, first[19].video_id, 20).collect()]
    assert page == [r.video_id for r in first[20:40]]


def test_recogniser_lists_at_any_depth(spark):
    """Lists one to six objects deep, several in one body, beside text; entries without a time or a text do not count."""
    import json

    from cuemill.sources import formats

    item = lambda k, t: {"start": k, "end": k + 1, "text": t}
    deep = {"segments": [item(9, "deep")]}
    for _ in range(5):
        deep = {"x": deep, "n": 1}
    bodies = {
        "deep": (deep, [(9.0, 10.0, "deep")]),
        "top": ([item(1, "a"), {"start": 2, "end": 3}, item(4, "b")], [(1.0, 2.0, "a"), (4.0, 5.0, "b")]),
        "order": ({"z": {"results": [item(5, "z")]}, "b": [item(4, "b")], "chunks": [item(3, "chunks")], "utterances": [{"start_time": 2, "end_time": 3.5, "transcript": "<|en|> said [1.0]"}], "segments": [item(1, "one"), item(1, " ... ")]},
                  [(1.0, 2.0, "one"), (2.0, 3.5, "said"), (3.0, 4.0, "chunks"), (4.0, 5.0, "b"), (5.0, 6.0, "z")]),
        "strings": ({"segments": [{"start": "1", "end": 2, "text": "x"}], "output": {"text": "whole text"}}, [(0.0, 20.0, "whole text")]),
        "text": ({"a": {"transcript": ""}, "b": ["one", {"text": "two"}]}, [(0.0, 20.0, "one two")]),
        "tagged": ({"text": "[0.5] [S01] hello there [1.5] [2] again [99]"}, [(0.5, 1.5, "hello there"), (2.0, 20.0, "again")]),
        "silent": ({"segments": [], "text": " "}, []), "number": (5, []), "clamped": ([item(-3, "early"), item(30, "late")], [(0.0, 0.05, "early"), (20.0, 20.0, "late")]),
    }
    rows = [(k, json.dumps(b), 20.0) for k, (b, _) in bodies.items()] + [("plain", "just words", 20.0), ("marks", "[1.0] said so [2.0]", 20.0), ("null", None, 20.0), ("top", json.dumps(bodies["top"][0]), 20.0), ("bad", '{"text": "cut', 20.0)]
    got = {}
    for r in formats.parse_asr_json(spark.createDataFrame(rows, "id string, body string, duration double")).orderBy("id", "cue").collect():
        got.setdefault(r.id, []).append((r.start_s, r.end_s, r.text))
    want = {k: w for k, (_, w) in bodies.items() if w} | {"plain": [(0.0, 20.0, "just words")], "marks": [(1.0, 2.0, "said so")], "bad": [(0.0, 20.0, '{"text": "cut')]}
    want["top"] = [x for x in want["top"] for _ in (0, 1)]  # two rows of one name and body
    assert got == want
