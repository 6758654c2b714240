"""Chat formatting in budgeted windows, with DataFrame functions only.

A turn is written as ``### role:``, a line feed, the text, ``</turn>`` and a line feed. Inside texts and roles a backslash,
``#`` and ``<`` (in roles also ``:`` and the line feed) are written as a backslash and a digit, so no text can form a mark;
reading the pairs back gives the text.

Each conversation is cut into windows of at most ``budget`` tokens where turns allow it: prefix sums of the turns' token
counts choose how many turns a window takes. Every window begins with the conversation's leading system turn and repeats
up to ``history`` earlier turns within ``history_tokens``, but only as many as leave room for the turn that opens the
window; loss spans cover each assistant text once, in the window that brings it first. A single turn that is over the
budget with the system turn gets a window of its own, whole, so no other window is over the budget.

A conversation is one row of arrays: its length is bounded by what one chat can hold, and sha2 needs its text at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, COLON, CLOSE = "### ", ":\n", "</turn>\n"
TOKEN = r"[\p{L}\p{M}]+|\p{N}{1,3}|[^\x20\x09-\x0D\p{L}\p{M}\p{N}]"


# What stands for a character that could form a mark. The backslash comes first and is read back last.
ESCAPES = (("\\", "\\0"), ("#", "\\1"), ("<", "\\2"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\3"), ("\n", "\\4"))


def _replace(text: Column, pairs) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape(text: Column) -> Column:
    return _replace(text, ESCAPES)


def escape_role(role: Column) -> Column:
    return _replace(role, ROLE_ESCAPES)


def unescape(text: Column) -> Column:
    return _replace(text, [(new, old) for old, new in reversed(ROLE_ESCAPES)])


def conversations_of(rows: DataFrame) -> DataFrame:
    """conv_id, its turns in order (role, text as written, tokens) and sums, the prefix sums of their tokens from 0.

    Turns are ordered by turn, rows with equal or null turn by role and text; nulls come first. Null role or text: empty.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    tokens = (F.regexp_count(text, F.lit(TOKEN)) + 4).cast("long")
    flat = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), escape(text).alias("text"), tokens.alias("tokens"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    flat = flat.withColumns({"pos": F.row_number().over(order), "sum": F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    convs = flat.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "role", "text", "tokens", "sum"))).alias("turns"))
    return convs.withColumn("sums", F.concat(F.array(F.lit(0).cast("long")), F.transform("turns", lambda t: t["sum"])))


def windows_of(convs: DataFrame, budget: int, history: int, history_tokens: int) -> DataFrame:
    """A row for each window: conv_id, window, shown (its turns) and new_from (how many of them are repeated)."""
    n = F.size("turns")
    convs = convs.withColumn("system", F.get("turns", F.lit(0))["role"] == "system")
    lead = F.when(F.col("system"), F.lit(1)).otherwise(F.lit(0))
    convs = convs.withColumns({"lead": lead, "head": F.get("sums", lead)})

    def back_of(i: Column) -> Column:
        """The earliest turn within history and history_tokens before turn i with which turn i still fits; else i."""
        room = lambda j: (F.get("sums", i) - F.get("sums", j) <= history_tokens) & (F.col("head") + F.get("sums", i + 1) - F.get("sums", j) <= budget)
        return F.array_min(F.filter(F.sequence(F.greatest(F.col("lead"), i - history), i), lambda j: (j == i) | room(j)))

    # turn i opens a window when it doesn't fit the one begun last
    start = F.struct(F.col("lead").alias("first"), F.lit(0).cast("long").alias("base"), F.array("lead").alias("firsts"))

    def step(a: Column, i: Column) -> Column:
        fits = F.col("head") + F.get("sums", i + 1) - F.when(i == a["first"], F.get("sums", i)).otherwise(a["base"]) <= budget
        opened = F.struct(i.alias("first"), F.get("sums", back_of(i)).alias("base"), F.concat(a["firsts"], F.array(i)).alias("firsts"))
        return F.when(i == F.col("lead"), F.struct(i.alias("first"), F.get("sums", i).alias("base"), a["firsts"].alias("firsts"))).when(fits, a).otherwise(opened)

    firsts = F.aggregate(F.when(n > F.col("lead"), F.sequence(F.col("lead"), n - 1)).otherwise(F.array().cast("array<int>")), start, step)["firsts"]
    convs = convs.withColumn("firsts", firsts)

    def window(w: Column) -> Column:
        """Only the turns that the window shows go on from here."""
        first, after = F.get("firsts", w), F.coalesce(F.get("firsts", w + 1), n)
        back = back_of(first)
        shown = F.concat(F.slice("turns", F.lit(1), F.col("lead")), F.slice("turns", back + 1, after - back))
        return F.struct(w.alias("window"), (F.col("lead") + first - back).alias("new_from"), shown.alias("shown"))

    every = F.transform(F.sequence(F.lit(0), F.size("firsts") - 1), window)
    return convs.select("conv_id", F.explode(every).alias("w")).select("conv_id", "w.window", "w.new_from", "w.shown")


def format_windows(rows: DataFrame, budget: int = 512, history: int = 2, history_tokens: int = 128) -> DataFrame:
    """conv_id, window, text, new_from (number of turns in the text before the new ones), loss (spans of the text, in
    code points, from and length, that carry loss), tokens, over_budget.

    ``rows``: conv_id, turn, role, text; other columns are not read. A null conv_id is a conversation like others. An
    empty table gives no rows; a conversation that is only a system turn gives one window.
    """
    w = windows_of(conversations_of(rows), budget, history, history_tokens)
    head = lambda t: F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit(COLON))
    # written turn by turn, with the length before each, so that spans come from the text itself
    nothing = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast("array<struct<from:int,length:int>>").alias("loss"))

    def span(a: Column, t: Column) -> Column:
        begin = a["at"] + F.length(head(t))
        here = F.array(F.struct(begin.cast("int").alias("from"), F.length(t["text"]).cast("int").alias("length")))
        mine = (a["i"] >= F.col("new_from")) & (t["role"] == "assistant")
        return F.struct((begin + F.length(t["text"]) + len(CLOSE)).cast("int").alias("at"), (a["i"] + 1).alias("i"), F.when(mine, F.concat(a["loss"], here)).otherwise(a["loss"]).alias("loss"))

    text = F.concat_ws("", F.transform("shown", lambda t: F.concat(head(t), t["text"], F.lit(CLOSE))))
    tokens = F.aggregate("shown", F.lit(0).cast("long"), lambda a, t: a + t["tokens"])
    out = w.select("conv_id", "window", text.alias("text"), "new_from", F.aggregate("shown", nothing, span)["loss"].alias("loss"), tokens.alias("tokens"))
    return out.withColumn("over_budget", F.col("tokens") > budget)


def turns_of(formatted: DataFrame) -> DataFrame:
    """Read windows back: conv_id, window, turns (role, text; unescaped), and loss_text, the unescaped text under the loss spans."""
    parts = F.split(F.col("text"), CLOSE)
    parts = F.slice(parts, 1, F.size(parts) - 1)  # what follows the last close is empty
    role = lambda p: F.substring_index(p, COLON, 1)
    turns = F.transform(parts, lambda p: F.struct(unescape(F.substring(role(p), F.lit(len(OPEN) + 1), F.length(p))).alias("role"), unescape(F.substring(p, F.length(role(p)) + len(COLON) + 1, F.length(p))).alias("text")))
    under = F.concat_ws("", F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["from"] + 1, s["length"]))))
    return formatted.select("conv_id", "window", "new_from", turns.alias("turns"), under.alias("loss_text"), F.length("text").cast("long").alias("chars"))


def format_digest(rows: DataFrame, budget: int = 512, history: int = 2, history_tokens: int = 128) -> DataFrame:
    """Per conversation, read back from its windows: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars, n_windows. Repeated turns count once. A very long text is one turn and fills a window by itself, whole."""
    back = turns_of(format_windows(rows, budget, history, history_tokens))
    # the first window brings the leading system turn, later ones only repeat it
    fresh = F.when(F.col("window") == 0, F.col("turns")).otherwise(F.slice("turns", F.col("new_from") + 1, F.greatest(F.lit(0), F.size("turns") - F.col("new_from"))))
    lines = F.concat_ws("", F.transform(fresh, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    kept = back.select("conv_id", F.struct("window", F.size(fresh).cast("long").alias("n"), lines.alias("lines"), "loss_text", "chars").alias("w"))
    whole = kept.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("ws"))
    loss = F.concat_ws("", F.transform("ws", lambda w: w["loss_text"]))
    return whole.select(
        "conv_id",
        F.aggregate("ws", F.lit(0).cast("long"), lambda a, w: a + w["n"]).alias("n_turns"),
        F.sha2(F.concat_ws("", F.transform("ws", lambda w: w["lines"])).cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.aggregate("ws", F.lit(0).cast("long"), lambda a, w: a + w["chars"]).alias("formatted_chars"),
        F.size("ws").cast("long").alias("n_windows"),
    )
