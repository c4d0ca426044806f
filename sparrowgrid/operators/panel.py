"""Small rules of the panel and its replies: hit tests, paging, calibration, reading runs, JSON rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tf
from .ordered import fold_rows


def quotient(a: Column, b: Column) -> Column:
    """Whole quotient toward zero, of whole numbers."""
    return F.when(b != 0, (a - (a % b)) / b).cast("long")


def fit_frame(bx: Column, by: Column, bw: Column, bh: Column, sw: Column, sh: Column) -> Column:
    """Where a frame lands in a pane: whole, never cropped, centred."""
    wide = bw * sh < bh * sw
    w = F.greatest(F.when(wide, bw).otherwise(quotient(bh * sw, sh)), F.lit(1))
    h = F.greatest(F.when(wide, quotient(bw * sh, sw)).otherwise(bh), F.lit(1))
    return F.struct((bx + quotient(bw - w, F.lit(2))).alias("x"), (by + quotient(bh - h, F.lit(2))).alias("y"), w.cast("long").alias("w"), h.cast("long").alias("h"))


def hit(taps: DataFrame, rects: DataFrame, rows: int = 1000) -> DataFrame:
    """``taps`` (tap, px, py) on ``rects`` (rect, x, y, w, h), a page's few targets: the first that holds the tap, or null."""
    small = F.broadcast(rects) if rects.limit(rows + 1).count() <= rows else rects
    inside = (F.col("px") >= F.col("x")) & (F.col("px") < F.col("x") + F.col("w")) & (F.col("py") >= F.col("y")) & (F.col("py") < F.col("y") + F.col("h"))
    return taps.join(small, inside, "left").groupBy("tap").agg(F.min("rect").alias("rect"))


def calibrated(raw: Column, low: Column, high: Column, size: int) -> Column:
    """A sample mapped from low..high to the screen and held inside it."""
    return tf.clamp(quotient((raw - low) * size, high - low), 0, size - 1)


def pressure(x: Column, z1: Column, z2: Column, plate: int, full: int, floor: int) -> Column:
    """Contact resistance; null where there is no contact."""
    r = (z2 / z1 - 1.0) * x * plate / full
    return F.when((z1 >= floor) & (z2 > z1), F.greatest(F.floor(r), F.lit(0)))


def last_page(items: DataFrame, budget: int) -> DataFrame:
    """``items`` (key, item, height) -> the first item from which all to the end fit the budget (the last item at least)."""
    back = Window.partitionBy("key").orderBy(F.desc("item")).rowsBetween(Window.unboundedPreceding, 0)
    used = items.withColumn("used", F.sum("height").over(back))
    return used.groupBy("key").agg(F.coalesce(F.min(F.when(F.col("used") <= budget, F.col("item"))), F.max("item")).alias("top"))


def row_peaks(rows: DataFrame, reach: int) -> DataFrame:
    """``rows`` (frame, y, peak) -> the greatest peak within ``reach`` rows, at least a quarter of the frame's."""
    near = Window.partitionBy("frame").orderBy("y").rangeBetween(-reach, reach)
    return rows.select("frame", "y", F.greatest(F.max("peak").over(near), F.floor(F.max("peak").over(Window.partitionBy("frame")) / 4)).cast("int").alias("reference"))


def rolling(members: DataFrame) -> DataFrame:
    """``members`` (line, n, v, h) -> after each: the median of its last five v and of its last nine heights."""
    at = lambda k: Window.partitionBy("line").orderBy("n").rowsBetween(1 - k, 0)
    return members.select("line", "n", _median(F.collect_list("v").over(at(5))).alias("v"), _median(F.collect_list("h").over(at(9))).alias("h"))


def _median(values: Column) -> Column:
    s, n = F.sort_array(values), F.size(values)
    return (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2 + 1).cast("int"))) / 2


def read_all(boxes: DataFrame, stops: DataFrame) -> DataFrame:
    """``boxes`` (frame, box, recognizable, state), ``stops`` (frame, after) -> the states after reading all.

    Unread recognizable boxes are read in order until as many as ``after`` are done;
    a frame without a stop is read to the end.
    """
    todo = F.col("recognizable") & (F.col("state") == 0)
    n = F.sum(todo.cast("int")).over(Window.partitionBy("frame").orderBy("box"))
    first = stops.groupBy("frame").agg(F.min("after").alias("after"))
    out = boxes.withColumn("__n", n).join(first, "frame", "left")
    return out.select("frame", "box", F.when(todo & (F.col("after").isNull() | (F.col("__n") <= F.col("after"))), 2).otherwise(F.col("state")).cast("int").alias("state"))


def sessions(events: DataFrame) -> DataFrame:
    """``events`` (key, seq, kind, session) -> the session current at each event and whether a request is fresh; ``frame`` events begin one."""
    current = F.sum((F.col("kind") == "frame").cast("int")).over(Window.partitionBy("key").orderBy("seq"))
    return events.withColumn("current", current.cast("long")).select("key", "seq", "kind", "current", F.when(F.col("kind") != "frame", F.col("session") == F.col("current")).alias("fresh"))


def translations(rows: DataFrame, most: int = 8) -> DataFrame:
    """``rows`` (qid, pos, text): distinct Bengali texts in the order of arrival, at most ``most`` for each query."""
    t = rows.select("qid", "pos", tf.trim_space(F.col("text")).alias("text")).where(tf.has_bengali(F.col("text")))
    first = t.groupBy("qid", "text").agg(F.min("pos").alias("pos"))
    order = Window.partitionBy("qid").orderBy("pos")
    return first.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= most).select("qid", "rk", "text")


def search_row(en: Column, bn: Column, src: Column, via: Column, fuzzy: Column, bm25: Column, score: Column) -> Column:
    """A search result as JSON text: four decimals, bm25 left out when it is zero. (Glyph counts need tables that are not published.)"""
    four = lambda x: F.format_string("%.4f", x)
    return F.concat(
        F.lit('{"en":"'), tf.json_escape_plain(en), F.lit('","bn":"'), tf.json_escape_plain(bn), F.lit('","src":"'), src, F.lit('","via":"'), via, F.lit('","fuzzy":'), four(fuzzy),
        F.when(bm25 != 0.0, F.concat(F.lit(',"bm25":'), four(bm25))).otherwise(""), F.lit(',"score":'), four(score), F.lit("}"),
    )


def commands(lines: DataFrame) -> DataFrame:
    """``lines`` (key, seq, action) -> the page and scroll place after each action of a device's panel.

    Pages: home, hist, search. "up" and "down" scroll by four, not above the top;
    "hist", "back", "search", "srhome", "h" change the page; others leave all as it is.
    """
    def step(state: dict, r: tuple) -> tuple:
        key, seq, act = r
        page, top = state.get("page", "home"), state.get("top", 0)
        page = {"hist": "hist", "back": "home", "srhome": "home", "search": "search", "h": "home" if page == "hist" else "hist"}.get(act, page)
        top = max(top - 4, 0) if act == "up" else top + 4 if act == "down" else 0 if act in ("search", "clearhist") else top
        state |= {"page": page, "top": top}
        return key, seq, page, top

    return fold_rows(lines.select("key", "seq", "action"), ["seq"], dict, step, "key long, seq long, page string, top int")


#: What an action sets, as the pages of the panel read it; what stands in no entry stays. "bottom": the list follows its end; a number: it moves by so many rows.
ACTIONS: dict[str, dict] = {
    "capture": {"shot": True, "top": "bottom"},
    "search": {"img": False, "hist": False, "search": True, "kb": True},
    "srhome": {"search": False, "kb": True},
    "kb": {"kb": True},
    "clear": {"shot": False, "fresh": -1, "top": "bottom"},
    "cl": {"shot": False, "fresh": -1, "top": "bottom"},
    "hist": {"img": False, "hist": True, "top": "bottom"},
    "back": {"img": False, "hist": False, "top": "bottom"},
    "h": {"img": False, "hist": "toggle", "top": "bottom"},
    "clearhist": {"shot": False, "fresh": -1, "n": 0, "last": None, "top": 0},
    "up": {"top": -4},
    "down": {"top": 4},
    "new": {"top": "bottom"},
    "snap": {"hist": False},
    "img": {"hist": False, "img": True},
    "readall": {"hist": False, "img": True},
}
START = {"img": False, "hist": False, "search": False, "kb": False, "shot": False, "n": 0, "fresh": -1, "top": 0, "last": None}
#: Entries that a history holds.
MOST_HELD = 48


def reduced(lines: DataFrame, fit: int = 8) -> DataFrame:
    """``lines`` (key, seq, action, word) -> the state of each device's panel after every action: known, img, hist, search, kb, shot, n, fresh, top.

    ``capture`` adds the word to the history, unless it is the last one there. The
    list shows a band over the entries (of one day), of which ``fit`` rows are seen at
    once; after each known action its place is brought back between top and bottom.
    An unknown action changes nothing, a failed snap is not modelled.
    """

    def step(state: dict, r: tuple) -> tuple:
        key, seq, act, word = r
        s, known = state or dict(START), act in ACTIONS
        if known:
            change = dict(ACTIONS[act])
            move = change.pop("top", None)
            if act == "capture":
                change |= {"n": s["n"] if s["n"] and s["last"] == word else min(s["n"] + 1, MOST_HELD), "last": word}
                change["fresh"] = change["n"] - 1
            if change.get("hist") == "toggle":
                change["hist"] = not s["hist"]
            s |= change
            most = max(0, s["n"] + (s["n"] > 0) - fit)
            top = most if move == "bottom" else 0 if act == "clearhist" else s["top"] + (move or 0)
            s["top"] = min(max(top, 0), most)
        state |= s
        return (key, seq, known, *(s[k] for k in ("img", "hist", "search", "kb", "shot", "n", "fresh", "top")))

    schema = "key long, seq long, known boolean, img boolean, hist boolean, search boolean, kb boolean, shot boolean, n int, fresh int, top int"
    return fold_rows(lines.select("key", "seq", "action", "word"), ["seq"], dict, step, schema)


def error_json(message: Column) -> Column:
    """The reply to a failed request."""
    return F.concat(F.lit('{"ok":false,"error":"'), tf.json_escape_plain(message), F.lit('"}'))


def candidate_line(place: Column, word: Column, gloss: Column, score: Column) -> Column:
    """A report's line for one answer of a word."""
    return F.concat(F.lit("CAND "), place.cast("string"), F.lit(" "), word, F.lit(" -> "), gloss, F.lit(" score="), F.format_string("%.3f", score.cast("double")))


def run_line(letters: Column, unread: Column) -> Column:
    """A report's line for a run of letters that was not read."""
    return F.concat(F.lit("URUN chars="), letters.cast("string"), F.lit(" unread="), unread.cast("string"))
