r"""Chat formatting in budgeted windows, by DataFrame functions only.

A turn is rendered as ``### role: text</turn>`` and a line feed.  In texts and
roles ``\`` is written ``\b``, ``###`` is written ``\h``, ``</turn>`` is written ``\t``, and in
roles ``:`` is written ``\c``; each backslash of an escaped text thus starts one of
these codes, so that they can be undone by plain replacement, ``\b`` last.

Prefix sums of the turns' tokens cut a conversation into blocks of ``room`` tokens,
the budget less the system turn and the share for history.  The turns that lie in
one block form a window; a turn across a border forms one by itself.  No
turn is cut, and a window passes the budget only if a single turn, with those
repeated before it, does, which ``over_budget`` tells.  Each window after the first begins with the system turn (a first turn
with role ``system``) and up to ``history_turns`` turns before it that fit into
``history_budget``.  The loss mask covers the texts of assistant turns, in the window
where they are new; repeated ones are masked out.

A token is a run of ASCII letters, digits and ``_``, or any other character but
white space; other counters can be passed.

Nulls and edge cases: null text and null role are empty.  Turns are ordered by
turn (null first), role and text; equal rows are turns of their own.  A null
conv_id is a conversation.  An empty table gives an empty result.  Input columns
besides the four are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, END = "### ", "</turn>\n"
SYSTEM, HISTORY, NEW = 0, 1, 2


def escape(text: Column) -> Column:
    for raw, code in (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for code, raw in (("\\t", "</turn>"), ("\\h", "###"), ("\\b", "\\")):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\c"), F.lit(":")))


def simple_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\w+|[^\w\s]"))


def format_windows(turns: DataFrame, budget: int = 1024, history_budget: int = 192, history_turns: int = 2, tokens: Callable[[Column], Column] = simple_tokens, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id``, ``window``, ``text``, ``loss_spans`` (start from 0 and length, by code points), ``n_repeated`` (leading turns that are repeats), ``n_tokens``, ``over_budget``."""
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    head = F.concat(F.lit(HEAD), escape_role(F.col("role")), F.lit(": "))
    rows = rows.withColumn("head", F.char_length(head)).withColumn("block", F.concat(head, escape(F.col("text")), F.lit(END)))
    rows = rows.withColumn("n_tokens", tokens(F.col("block")).cast("long"))

    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    whole = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("n", F.row_number().over(order))
    rows = rows.withColumn("is_system", (F.col("n") == 1) & (F.col("role") == "system"))
    own = F.when(F.col("is_system"), F.lit(0)).otherwise(F.col("n_tokens"))
    rows = rows.withColumn("upto", F.sum(own).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("system_tokens", F.max(F.when(F.col("is_system"), F.col("n_tokens")).otherwise(0)).over(whole))
    room = F.greatest(F.lit(budget - history_budget) - F.col("system_tokens"), F.lit(max(1, budget // 4)))
    start = F.col("upto") - own
    rows = rows.withColumn("start", start).withColumn("first", F.floor(start / room)).withColumn("last", F.floor((F.greatest(F.col("upto"), start + 1) - 1) / room))
    fresh = (F.col("n") > 1) & ((F.col("first") != F.lag("first").over(order)) | (F.col("last") != F.lag("last").over(order))) & ~F.lag("is_system").over(order)
    rows = rows.withColumn("opens", F.coalesce(fresh, F.lit(False)))
    rows = rows.withColumn("window", F.sum(F.col("opens").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ahead = [
        F.when(F.lead("opens", j).over(order) & ~F.col("is_system") & (F.lead("start", j).over(order) - F.col("start") <= history_budget), F.struct(F.lead("window", j).over(order).alias("window"), F.lit(HISTORY).alias("kind")))
        for j in range(1, history_turns + 1)
    ]
    rows = rows.withColumn("ahead", F.array_compact(F.array(*ahead)) if ahead else F.array().cast("array<struct<window:bigint,kind:int>>"))
    rows = rows.withColumn("windows", F.max("window").over(whole))
    repeats = F.when(F.col("is_system") & (F.col("windows") > 0), F.transform(F.sequence(F.lit(1).cast("long"), F.col("windows")), lambda w: F.struct(w.alias("window"), F.lit(SYSTEM).alias("kind"))))
    places = F.concat(F.array(F.struct(F.col("window").alias("window"), F.lit(NEW).alias("kind"))), F.col("ahead"), F.coalesce(repeats, F.array().cast("array<struct<window:bigint,kind:int>>")))
    placed = rows.select("conv_id", "n", "role", "head", "block", "n_tokens", F.explode(places).alias("place"))

    item = F.struct("n", F.col("place.kind").alias("kind"), "role", "head", "block", "n_tokens")
    windows = placed.groupBy("conv_id", F.col("place.window").alias("window")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    offset = lambda i: F.aggregate(F.slice("items", F.lit(1), i), F.lit(0), lambda a, x: a + F.char_length(x.block))
    spans = F.transform("items", lambda x, i: F.struct((offset(i) + x.head).alias("start"), (F.char_length(x.block) - x.head - len(END)).alias("length"), ((x.kind == NEW) & (x.role == "assistant")).alias("on")))
    spans = F.transform(F.filter(spans, lambda s: s.on), lambda s: F.struct(s.start.alias("start"), s.length.alias("length")))
    total = F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + x.n_tokens)
    return windows.select(
        "conv_id",
        "window",
        F.array_join(F.transform("items", lambda x: x.block), "").alias("text"),
        spans.alias("loss_spans"),
        F.size(F.filter("items", lambda x: x.kind != NEW)).alias("n_repeated"),
        total.alias("n_tokens"),
        (total > budget).alias("over_budget"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """``conv_id``, ``window``, ``turns`` (role and text of the new turns, from the formatted text), ``loss`` (the texts under the mask)."""
    blocks = F.split("text", END, -1)
    blocks = F.slice(blocks, F.col("n_repeated") + 1, F.size(blocks) - 1 - F.col("n_repeated"))
    body = F.transform(blocks, lambda b: F.substring(b, len(HEAD) + 1, 1 << 30))
    turns = F.transform(body, lambda b: F.struct(unescape_role(F.substring_index(b, ": ", 1)).alias("role"), unescape(b.substr(F.instr(b, ": ") + 2, F.lit(1 << 30))).alias("text")))
    loss = F.transform("loss_spans", lambda s: unescape(F.col("text").substr(s.start + 1, s.length)))
    return windows.select("conv_id", "window", turns.alias("turns"), loss.alias("loss"), F.char_length("text").alias("chars"))


def digests(windows: DataFrame) -> DataFrame:
    """One row a conversation: digests of what the formatted windows give back."""
    back = read_back(windows).select(
        "conv_id",
        F.struct("window", F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "").alias("turns"), F.array_join("loss", "").alias("loss")).alias("part"),
        F.size("turns").alias("n"),
        "chars",
    )
    whole = back.groupBy("conv_id").agg(F.array_sort(F.collect_list("part")).alias("parts"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    turns = F.array_join(F.transform("parts", lambda p: p.turns), "")
    loss = F.array_join(F.transform("parts", lambda p: p.loss), "")
    return whole.select("conv_id", "n_turns", F.sha2(turns, 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
