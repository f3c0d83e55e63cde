r"""Chat formatting in budgeted, turn-aligned windows, with built-in functions only.

Running sums of turn tokens choose the spans: a window takes turns while they fit what the budget leaves beside the system turn and
the history. Every window after the first repeats the system turn and then the last turns before it, up to ``history`` tokens and
``history_turns`` turns; the loss mask covers the assistant texts of the window's own turns, so each is a target once.

Template. A window is ``<s>`` and its turns: ``text</s>`` for the assistant, ``[INST]role\ntext[/INST]`` for any other role. Inside texts
a backslash is put into every control string after its first character (and one more where there are some), which reading back removes.

Defined cases. A null text or role is the empty string. Turns stand in the order of (turn, role, text), nulls first; repeated rows are turns of
their own. A null ``conv_id`` is a conversation. A turn over the budget has a window of its own and stays whole. Only a first turn with role
``system`` counts as the system turn. Extra columns are ignored. No rows give no rows. A window is one string, so a conversation's turns meet in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The control strings of the template.
BEGIN, END, OPEN, CLOSE = "<s>", "</s>", "[INST]", "[/INST]"
_TURN = r"(?s)\[INST\].*?\[/INST\]|.*?</s>"


def escape(text: Column) -> Column:
    text = F.regexp_replace(text, r"(<\\*)(/?s>)", r"$1\\$2")
    return F.regexp_replace(text, r"(\[\\*)(/?INST\])", r"$1\\$2")


def unescape(text: Column) -> Column:
    text = F.regexp_replace(text, r"(<\\*)\\(/?s>)", "$1$2")
    return F.regexp_replace(text, r"(\[\\*)\\(/?INST\])", "$1$2")


def _role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_back(role: Column) -> Column:
    held = F.replace(unescape(role), F.lit("\\\\"), F.lit("\\\0"))
    return F.replace(F.replace(held, F.lit("\\n"), F.lit("\n")), F.lit("\\\0"), F.lit("\\"))


def turn_tokens(text: Column) -> Column:
    """Words and single marks of a text, and four for the template: any integer column will do."""
    return F.regexp_count(text, F.lit(r"\w+|[^\w\s]")) + 4


def windows(turns: DataFrame, budget: int = 2048, history: int = 256, history_turns: int = 4, tokens=turn_tokens) -> DataFrame:
    """(conv_id, window, formatted, n_repeated, loss_spans array<struct<start, length>>); spans count code points from 0."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    own = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("i", F.row_number().over(own)).withColumn("n", tokens(F.col("text")).cast("long"))
    rows = rows.withColumn("upto", F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.col("role") == "assistant"
    piece = F.when(target, F.concat(escape(F.col("text")), F.lit(END))).otherwise(F.concat(F.lit(OPEN), _role(F.col("role")), F.lit("\n"), escape(F.col("text")), F.lit(CLOSE)))
    rows = rows.withColumn("is_system", (F.col("i") == 1) & (F.col("role") == "system"))
    rows = rows.select("conv_id", F.struct("i", "upto", (F.col("upto") - F.col("n")).alias("before"), "is_system", target.alias("target"), piece.alias("piece")).alias("t"))
    conv = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    conv = conv.withColumn("system", F.when(F.col("turns")[0]["is_system"], F.col("turns")[0]["upto"]).otherwise(F.lit(0).cast("long")))
    room = F.greatest(F.lit(1).cast("long"), F.lit(budget - history) - F.col("system"))

    def place(acc: Column, t: Column) -> Column:
        """Keeps where the window began and the beginnings of all windows so far."""
        full = (t["upto"] - acc["base"] > acc["room"]) & (t["before"] > acc["base"]) & ~t["is_system"]
        return F.struct(
            F.when(full, t["before"]).otherwise(acc["base"]).alias("base"),
            acc["room"].alias("room"),
            F.when(full, F.concat(acc["bases"], F.array(t["before"]))).otherwise(acc["bases"]).alias("bases"),
        )

    begin = F.struct(F.col("system").alias("base"), room.alias("room"), F.array(F.col("system")).alias("bases"))
    conv = conv.select("conv_id", "turns", F.aggregate("turns", begin, place)["bases"].alias("bases"))
    each = conv.select("conv_id", "bases", F.explode("turns").alias("t"))
    # The window a turn belongs to: how many windows begin at or before it, less one.
    k = F.greatest(F.lit(0), F.size(F.filter("bases", lambda b: b <= F.col("t")["before"])) - 1)
    each = each.withColumn("k", k)
    later = F.slice("bases", F.col("k") + 2, history_turns)
    again = F.transform(later, lambda b, j: F.when(b - F.col("t")["before"] <= history, F.col("k") + 1 + j))
    everywhere = F.when(F.size("bases") > 1, F.sequence(F.lit(1), F.size("bases") - 1)).otherwise(F.array().cast("array<int>"))
    shown = F.when(F.col("t")["is_system"], everywhere).otherwise(F.filter(again, lambda w: w.isNotNull()))
    each = each.select("conv_id", F.col("t.i").alias("i"), F.col("t.target").alias("target"), F.col("t.is_system").alias("is_system"), F.col("t.piece").alias("piece"), F.explode(F.concat(F.array(F.struct(F.col("k").alias("window"), F.lit(False).alias("repeated"))), F.transform(shown, lambda w: F.struct(w.alias("window"), F.lit(True).alias("repeated"))))).alias("w"))
    each = each.select("conv_id", "w.window", "w.repeated", "i", "target", "is_system", "piece")
    back = Window.partitionBy("conv_id", "window").orderBy(F.desc("i"))
    # At most history_turns turns before the window's own.
    old = F.sum(F.when(F.col("repeated") & ~F.col("is_system"), 1).otherwise(0)).over(back.rowsBetween(Window.unboundedPreceding, 0))
    each = each.withColumn("old", old).where(~F.col("repeated") | F.col("is_system") | (F.col("old") <= history_turns))
    at = F.sum(F.length("piece")).over(Window.partitionBy("conv_id", "window").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    each = each.withColumn("start", (F.coalesce(at, F.lit(0)) + len(BEGIN)).cast("long"))
    span = F.when(F.col("target") & ~F.col("repeated"), F.struct("start", (F.length("piece") - len(END)).cast("long").alias("length")))
    out = each.groupBy("conv_id", "window").agg(
        F.array_sort(F.collect_list(F.struct("i", "piece"))).alias("pieces"),
        F.sum(F.col("repeated").cast("int")).cast("int").alias("n_repeated"),
        F.array_sort(F.collect_list(span)).alias("loss_spans"),
    )
    return out.select("conv_id", "window", F.concat(F.lit(BEGIN), F.array_join("pieces.piece", "")).alias("formatted"), "n_repeated", "loss_spans")


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>, loss_text, formatted_chars), from the windows alone."""
    found = F.regexp_extract_all(F.substring("formatted", len(BEGIN) + 1, 2**31 - 1), F.lit(_TURN), F.lit(0))
    inner = lambda t: F.substring(t, F.lit(len(OPEN) + 1), F.length(t) - len(OPEN) - len(CLOSE))

    def turn(t: Column) -> Column:
        other = t.startswith(F.lit(OPEN))
        role, text = F.substring_index(inner(t), "\n", 1), F.substring(inner(t), F.instr(inner(t), "\n") + 1, F.length(t))
        return F.struct(
            F.when(other, _role_back(role)).otherwise(F.lit("assistant")).alias("role"),
            unescape(F.when(other, text).otherwise(F.substring(t, F.lit(1), F.length(t) - len(END)))).alias("text"),
        )

    own = F.transform(F.slice(found, F.col("n_repeated") + 1, F.greatest(F.size(found), F.lit(1))), turn)
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    rows = formatted.select("conv_id", F.struct("window", own.alias("turns"), loss.alias("loss"), F.length("formatted").alias("chars")).alias("w"))
    conv = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("ws"), F.sum("w.chars").alias("formatted_chars"))
    return conv.select("conv_id", F.flatten("ws.turns").alias("turns"), F.array_join("ws.loss", "").alias("loss_text"), "formatted_chars")


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and hashes of what ``read_back`` finds."""
    back = read_back(formatted)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.col("formatted_chars").cast("long"),
    )
