"""The segment and queue jobs as Structured Streaming queries; each equals its batch form once all input is in."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from cuemill.functions import text as X
from cuemill.operators.verify import stitch_onto

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CUES = "video_id long, cue long, start_ms long, end_ms long, text string"


def latest_state(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Latest state per video of an event stream (video_id, ts, item_id, state, progress), in update mode."""
    best = events.withWatermark("ts", delay).groupBy("video_id").agg(F.max(F.struct("ts", "item_id", "state", "progress")).alias("e"))
    return best.select("video_id", "e.state", F.when(F.col("e.state") == "completed", 100).otherwise(F.least("e.progress", F.lit(99))).cast("int").alias("progress"))


def script_counts(seg: DataFrame) -> DataFrame:
    """Running script counts and language per video: the counts add up, so the state is one row a video."""
    t = F.col("text")
    sums = seg.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("segments"), F.sum(X.latin_words(t)).alias("latin_words"), *(F.sum(X.count_matches(t, p)).alias(k) for k, p in (("han", X.HAN), ("kana", X.KANA), ("hangul", X.HANGUL)))
    )
    han, kana, hangul, latin = (F.col(c) for c in ("han", "kana", "hangul", "latin_words"))
    language = (
        F.when((kana > 0) & (kana >= hangul) & (kana >= han), "Japanese").when((hangul > 0) & (hangul >= han), "Korean")
        .when((kana == 0) & (hangul == 0) & (((han > 0) & (latin == 0)) | (han >= 15) | ((han >= 4) & (han >= latin))), "Chinese").otherwise("English")
    )
    return sums.withColumn("language", language)


def unique_cues(cues: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Cues (video_id, cue, ts, …) without those that a retry sent again within the watermark."""
    return cues.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["video_id", "cue"])


def stable_spans(spans: DataFrame, delay: str = "30 seconds", window: str = "1 minute") -> DataFrame:
    """Per video and window the speech that has ended before the watermark; append mode emits only what is final; pairs of neighbours come from ``stable_pauses``."""
    timed = spans.withWatermark("ts", delay).groupBy("video_id", F.window("ts", window).alias("w"))
    return timed.agg(F.count(F.lit(1)).alias("spans"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("speech_ms")).select("video_id", F.col("w.start").alias("from_ts"), "spans", "speech_ms")


def _clock(text: str) -> int | None:
    try:
        total = 0.0
        for part in text.strip().replace(",", ".").split(":"):
            total = total * 60 + float(part)
        return round(total * 1000)
    except ValueError:
        return None


class CueProcessor(StatefulProcessor):
    """Subtitle lines of a video to cues (X1): a blank line ends a cue, and so does the number line of the next one.

    A line that is a whole number may be spoken text or the next cue's number, which only the line after it tells: it waits in
    state, with what is incomplete. A null line ends the input. Where lines have event times, a tail to which nothing was
    added for ``idle_ms`` of them ends too.
    """

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", "cue long, body string, number string, due long")

    def _open(self) -> tuple[int, str, str | None, int]:
        return tuple(self.state.get()) if self.state.exists() else (0, "", None, 0)

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        cue, body, number, due = self._open()
        got = pd.concat(list(rows)).sort_values("line_no", kind="stable")
        out = []

        def end() -> None:
            nonlocal cue, body
            found = self._cue(body)
            if found:
                out.append((key[0], cue, *found))
                cue += 1
            body = ""

        for line in got["line"]:
            over = line is None or line != line
            if number is not None:
                if not over and "-->" in line:
                    end()
                body, number = body + number + "\n", None
            if over or not line.strip():
                end()
            elif "-->" in body and line.strip().isdecimal():
                number = line
            else:
                body += line + "\n"
        if self.idle_ms is not None:
            if due:
                self.handle.deleteTimer(due)
            due = int(got["ts"].max().timestamp() * 1000) + self.idle_ms if body or number is not None else 0
            if due:
                self.handle.registerTimer(due)
        self.state.update((cue, body, number, due))
        yield pd.DataFrame(out, columns=["video_id", "cue", "start_ms", "end_ms", "text"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        cue, body, number, _ = self._open()
        found = self._cue(body + (number or ""))
        self.state.update((cue + bool(found), "", None, 0))
        yield pd.DataFrame([(key[0], cue, *found)] if found else [], columns=["video_id", "cue", "start_ms", "end_ms", "text"])

    @staticmethod
    def _cue(body: str):
        head, arrow, rest = body.partition("-->")
        start, end = _clock(head.strip().rpartition("\n")[2]), _clock(rest.partition("\n")[0])
        text = rest.partition("\n")[2].strip()
        return (start, max(end, start + 50), text) if arrow and start is not None and end is not None and text else None

    def close(self) -> None:
        pass


def cue_stream(lines: DataFrame, idle: str | None = None, delay: str = "10 seconds") -> DataFrame:
    """Cues of a stream of lines (video_id, line_no, line and, with ``idle``, ts); needs the RocksDB state store.

    Lines of a video come in order, in any cuts. With ``idle``, an interval such as ``30 seconds``, a tail ends once the watermark
    is that far behind its last line.
    """
    if idle is None:
        return lines.groupBy("video_id").transformWithStateInPandas(CueProcessor(), CUES, "Append", "None")
    timed = lines.withWatermark("ts", delay)
    return timed.groupBy("video_id").transformWithStateInPandas(CueProcessor(int(pd.Timedelta(idle).total_seconds() * 1000)), CUES, "Append", "EventTime")


class PairProcessor(StatefulProcessor):
    """Neighbouring spans of speech once both are stable (X3): spans wait in state until the watermark has passed their event time.

    A timer for each waiting event time hands on, in order, what is stable by then; the last stable span stays as the left side of
    the next pair. So each pair comes out once, in the range between the watermark before and the one that has passed it.
    """

    def __init__(self, least_ms: int, most_ms: int):
        self.least_ms, self.most_ms = least_ms, most_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "due long, seg_idx long", "start_ms long, end_ms long")
        self.last = handle.getValueState("last", "seg_idx long, end_ms long")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        for part in rows:
            for r in part.itertuples(index=False):
                due = int(r.ts.timestamp() * 1000)
                self.waiting.updateValue((due, int(r.seg_idx)), (int(r.start_ms), int(r.end_ms)))
                self.handle.registerTimer(due)
        yield pd.DataFrame({c: [] for c in ("video_id", "seg_idx", "from_ms", "gap_ms", "mid_ms")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs()
        stable = sorted(k for k in self.waiting.keys() if k[0] <= now)
        before = tuple(self.last.get()) if self.last.exists() else None
        out = []
        for k in stable:
            start, end = self.waiting.getValue(k)
            self.waiting.removeKey(k)
            if before is not None and self.least_ms <= start - before[1] <= self.most_ms:
                gap = start - before[1]
                out.append((key[0], before[0], before[1], gap, before[1] + gap // 2))
            before = (k[1], end)
        if before is not None:
            self.last.update(before)
        yield pd.DataFrame(out, columns=["video_id", "seg_idx", "from_ms", "gap_ms", "mid_ms"])

    def close(self) -> None:
        pass


def stable_pauses(spans: DataFrame, delay: str = "30 seconds", least_ms: int = 200, most_ms: int = 3000) -> DataFrame:
    """Pauses between neighbouring spans (video_id, seg_idx, ts, start_ms, end_ms), as ``sequence.pauses`` gives them.

    Event times rise with ``seg_idx``; rows may come in any order within ``delay``, later ones are lost as the watermark says. A span that is sent again counts once.
    """
    timed = spans.withWatermark("ts", delay).select("video_id", "seg_idx", "ts", "start_ms", "end_ms")
    kind = "video_id long, seg_idx long, from_ms long, gap_ms long, mid_ms long"
    return timed.groupBy("video_id").transformWithStateInPandas(PairProcessor(least_ms, most_ms), kind, "Append", "EventTime")


class StitchProcessor(StatefulProcessor):
    """Cues stitched onto the last six of their video, which are the state: the step of ``verify.stitch_chunks``."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("tail", "starts array<double>, ends array<double>, texts array<string>")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        starts, ends, texts = self.state.get() if self.state.exists() else ([], [], [])
        tail, out = list(zip(starts, ends, texts, strict=True)), []
        for r in pd.concat(list(rows)).sort_values("cue").itertuples(index=False):
            for start, end, text in stitch_onto(tail, [(r.start_ms / 1000, r.end_ms / 1000, r.text or "")]):
                tail = [*tail, (start, end, text)][-6:]
                out.append((key[0], int(r.cue), round(start * 1000), round(end * 1000), text))
        self.state.update(([x[0] for x in tail], [x[1] for x in tail], [x[2] for x in tail]))
        yield pd.DataFrame(out, columns=["video_id", "cue", "start_ms", "end_ms", "text"])

    def close(self) -> None:
        pass


def stitch_stream(cues: DataFrame) -> DataFrame:
    return cues.groupBy("video_id").transformWithStateInPandas(StitchProcessor(), CUES, "Append", "None")


def run_available(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Everything that is there now into a Parquet folder; the checkpoint lets a later run go on without repeats."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def merge_available(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> None:
    """An update-mode stream into numbered Parquet batches; ``read_merged`` takes each key's latest row."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_merged(spark, path: str, keys: list[str]) -> DataFrame:
    rows = spark.read.parquet(path).drop("batch")
    others = [c for c in rows.columns if c not in [*keys, "_batch"]]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "_batch").alias("r"))
    return best.select(*keys, "r.*")
