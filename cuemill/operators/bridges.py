"""Texts on both sides of a chunk boundary repaired from a bridge that has heard across it."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tokens of a side and of the bridge that are looked at, places that an anchor may be away from the boundary,
# tokens of an anchor (of mostly ideographs, of others), tokens between two anchors, and what a mark between them is worth.
SIDE_TOKENS, BRIDGE_TOKENS, LEFT_AWAY, RIGHT_AWAY = 96, 192, 8, 6
IDEOGRAPH_ANCHOR, ANCHOR, BETWEEN, END_MARK, INNER_MARK = 5, 3, 48, 10, 8
_IDEOGRAPH = re.compile("[\u3400-\u4dbf\u4e00-\u9fff\u3040-\u30ff\u31f0-\u31ff\uac00-\ud7af\u1100-\u11ff]")
_PIECE = re.compile(r"[0-9A-Za-z']+|[^\x00-\x7f]")
_END, _INNER = (re.compile(rf"[{marks}](?:\r\n|[\n\r\x85\u2028\u2029])?\Z") for marks in ("。？！.?!", "，；：,;:"))
_AROUND = r"[ \t\n.,?!:;，。？！：；、]"


def _tokens(text: str) -> list[tuple[str, int, int]]:
    """(token, start, end): the words and single letters of a text, counted from the left."""
    return [(m[0].lower(), *m.span()) for m in _PIECE.finditer(text) if m[0].isascii() or unicodedata.category(m[0])[0] in "LN"]


def _anchors(side: list, bridge: list, first: int) -> list[tuple[int, int, int]]:
    """Maximal runs of tokens that a side, from its ``first`` place on, and the bridge share: (place, place in the bridge, tokens)."""
    places: dict[str, list[int]] = {}
    for j, (token, *_) in enumerate(bridge):
        places.setdefault(token, []).append(j)
    open_runs: dict[int, int] = {}  # tokens of the run that ends before the place looked at, by its next place in the bridge
    found = []
    for i in range(first, len(side) + 1):
        now = {j: open_runs.pop(j, 0) + 1 for j in (places.get(side[i][0], ()) if i < len(side) else ())}
        found += [(i - n, j - n, n) for j, n in open_runs.items()]
        open_runs = {j + 1: n for j, n in now.items()}
    return found


def _least(run: list) -> int:
    """Tokens that an anchor needs."""
    return IDEOGRAPH_ANCHOR if 2 * sum(bool(_IDEOGRAPH.search(token)) for token, *_ in run) >= len(run) else ANCHOR


def bridge_places(left: str, right: str, bridge: str) -> tuple[int, int, int, int, int] | None:
    """(end of the left side, start of the right one, what lies between in the bridge, tokens matched), None without anchors."""
    a, b, over = _tokens(left), _tokens(right)[:SIDE_TOKENS], _tokens(bridge)[:BRIDGE_TOKENS]
    last, short = len(a) - 1, len(b) <= RIGHT_AWAY
    lefts = [x for x in _anchors(a, over, max(0, len(a) - SIDE_TOKENS)) if last - (x[0] + x[2] - 1) <= LEFT_AWAY and x[2] >= _least(a[x[0] : x[0] + x[2]])]
    best = None
    for i, j, n in _anchors(b, over, 0) if lefts else ():
        for late in range(min(max(n - ANCHOR, 0), RIGHT_AWAY) + 1):
            at, size = i + late, n - late
            least = _least(b[at : i + n])
            if at > RIGHT_AWAY or size < (min(least, ANCHOR) if short and at <= 1 else least):
                continue
            for l_at, l_bridge, l_n in lefts:
                l_end = l_bridge + l_n - 1
                if not 0 <= j + late - l_end - 1 <= BETWEEN:
                    continue
                low, high = over[l_end][2], over[j + late][1]
                middle = bridge[low:high].strip(" ")
                worth = END_MARK if _END.search(middle) else INNER_MARK if _INNER.search(middle) else 0
                rank = (l_n + size + worth, -l_at, -l_bridge, -i, -j, -late)
                if best is None or rank > best[0]:
                    best = rank, (a[l_at + l_n - 1][2], b[at][1], low, high, l_n + size)
    return best and best[1]


def bridge_rewrite(pairs: DataFrame) -> DataFrame:
    """(left, right, bridge) -> ``new_left``, ``new_right``, ``matched``; the sides as they were and 0 without anchors.

    An anchor of the left side ends at most eight tokens before its end, one of the right side begins at most six after its start;
    a right anchor may begin up to six tokens late while it stays long enough, and two-token sides of up to six tokens count too.
    Between the two the bridge has 48 tokens at most. The pair with the most tokens wins, marks before the right anchor counted
    in; of equals the one with the leftmost left anchor, then the leftmost in the bridge, then the right anchor likewise.
    Null texts are empty; equal rows get equal answers. A row is looked at by itself: its tokens are few, and nothing is shuffled.
    """

    @F.pandas_udf("struct<cut:int,from:int,low:int,high:int,matched:int>")
    def places(left: pd.Series, right: pd.Series, bridge: pd.Series) -> pd.DataFrame:
        found = [bridge_places(*x) or (None,) * 5 for x in zip(left, right, bridge, strict=True)]
        return pd.DataFrame(found, columns=["cut", "from", "low", "high", "matched"], dtype="Int32")

    out = pairs.withColumn("c", places(*(F.coalesce(c, F.lit("")) for c in ("left", "right", "bridge"))))
    middle = F.trim(F.substring("bridge", F.col("c.low") + 1, F.col("c.high") - F.col("c.low")))
    head = F.rtrim(F.substring("left", F.lit(1), F.col("c.cut")))
    blank = F.when(head.rlike("[0-9A-Za-z]$") & middle.rlike("^[0-9A-Za-z]"), " ").otherwise("")
    new_left = F.trim(F.concat(head, blank, middle))
    new_right = F.regexp_replace(F.substring("right", F.col("c.from") + 1, F.length("right")), f"^{_AROUND}+", "")
    fits = F.col("c.cut").isNotNull() & (new_left != "") & (new_right != "")
    return out.select(
        *pairs.columns, F.when(fits, new_left).otherwise(F.coalesce("left", F.lit(""))).alias("new_left"),
        F.when(fits, new_right).otherwise(F.coalesce("right", F.lit(""))).alias("new_right"), F.when(fits, F.col("c.matched")).otherwise(0).cast("long").alias("matched"),
    )
