"""Chat formatting in budgeted windows, with DataFrame functions only.

Template. A turn is ``<|turn|>ROLE<|text|>TEXT<|end|>`` and a line end. Inside role and text every ``<``, any number of
backslashes, ``|`` gets one more backslash, and reading takes it off again; so ``<|`` occurs in markers alone.

Windows. Prefix sums of the turns' tokens cut a conversation into spans: a new span starts with the turn in front of
which the sum enters the next stride, and a turn longer than a stride has a span of its own. The stride is half of
what budget, system turn and history leave, so spans of turns that fit a stride fit the budget; only a single
longer turn can exceed it, as turns are never cut. A system turn that leaves nothing of the budget is kept whole too: every window then
holds it, exceeds the budget by it, and has one turn besides. Each window holds the system turn (the first, if its role is system),
then as many earlier turns as ``history`` tokens allow, then its span. Loss is on the assistant's texts of the
span; repeated turns are masked, so each text is a target once.

Tokens. Tokenizers need Python, which has no place on this path: their counts may come with the rows (``tokens_col``, say from
the token counts' operator), else a turn counts as a token for every four bytes and four for its template.

Spans and repeats come from window functions over one shuffle by conversation (range frames instead of joins).

Defined results: turns are ordered by turn (null first), role, text; null role or text is empty; rows repeated in full
are turns of their own; rows of a null conv_id make one conversation; an empty table gives no rows; other columns
aren't read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 2048
HISTORY = 256
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"


def escape(column: Column) -> Column:
    return F.regexp_replace(column, r"<(\\*)\|", r"<\\$1|")


def unescape(column: Column) -> Column:
    return F.regexp_replace(column, r"<\\(\\*)\|", r"<$1|")


def estimated_tokens(text: Column) -> Column:
    """Four bytes a token, and four tokens for the template."""
    return F.ceil(F.octet_length(text) / 4) + 4


def format_windows(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", budget: int = BUDGET, history: int = HISTORY, tokens: Callable[[Column], Column] = estimated_tokens, tokens_col: str | None = None) -> DataFrame:
    """One row per window: conv_id, window (from 1), text, n_tokens, repeated (turns at its start that are not new) and
    ``loss``, an array of (start from 1, length) in characters of ``text``."""
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), (F.lit(None).cast("long") if tokens_col is None else F.col(tokens_col).cast("long")).alias("tokens"))
    whole = Window.partitionBy("conv_id")
    order = whole.orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn("system", (F.col("n") == 1) & (F.col("role") == "system"))
    rows = rows.withColumn("tokens", F.coalesce("tokens", tokens(F.col("text")).cast("long")))
    own = F.when(F.col("system"), 0).otherwise(F.col("tokens"))
    by_n = whole.orderBy("n")
    before = by_n.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(own).over(before), F.lit(0)))
    rows = rows.withColumn("fixed", F.coalesce(F.max(F.when(F.col("system"), F.col("tokens"))).over(whole), F.lit(0)))
    rows = rows.withColumn("stride", F.greatest(F.lit(1), F.floor((F.lit(budget - history) - F.col("fixed")) / 2)))
    rows = rows.withColumn("long", ~F.col("system") & (F.col("tokens") > F.col("stride")))
    step = F.floor(F.col("start") / F.col("stride"))
    opens = (F.col("n") == 1) | (~F.lag("system").over(by_n) & ((step != F.lag(step).over(by_n)) | F.col("long") | F.lag("long").over(by_n)))
    rows = rows.withColumn("span", F.sum(opens.cast("long")).over(by_n.rowsBetween(Window.unboundedPreceding, 0)))
    in_span = Window.partitionBy("conv_id", "span")
    rows = rows.withColumns({"span_start": F.min("start").over(in_span), "span_tokens": F.sum(own).over(in_span)})
    rows = rows.withColumn("allowed", F.greatest(F.lit(0), F.least(F.lit(history), F.lit(budget) - F.col("fixed") - F.col("span_tokens"))))
    first = ~F.col("system") & (F.col("start") == F.col("span_start"))
    ahead = F.collect_list(F.when(first, F.struct("span", "span_start", "allowed"))).over(whole.orderBy("start").rangeBetween(0, history))
    rows = rows.withColumns({"ahead": ahead, "spans": F.max("span").over(whole)})
    later = F.transform(F.filter("ahead", lambda s: (s.span > F.col("span")) & (s.span_start - F.col("start") <= s.allowed)), lambda s: s.span)
    everywhere = F.sequence(F.lit(1).cast("long"), F.col("spans"))
    rows = rows.withColumn("window", F.explode(F.when(F.col("system"), everywhere).otherwise(F.concat(F.array("span"), later))))
    again = F.col("window") != F.col("span")
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    body = escape(F.col("text"))
    rows = rows.select("conv_id", "window", "n", "tokens", "role", again.alias("again"), head.alias("head"), body.alias("body"))
    chars = F.length("head") + F.length("body") + len(END)
    at = F.coalesce(F.sum(chars).over(Window.partitionBy("conv_id", "window").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.length("head") + 1
    target = ~F.col("again") & (F.col("role") == "assistant")
    mask = F.when(target, F.struct(at.cast("int").alias("start"), F.length("body").alias("length")))
    rows = rows.select("conv_id", "window", "tokens", "again", F.struct("n", F.concat("head", "body", F.lit(END)).alias("text"), mask.alias("loss")).alias("turn"))
    grouped = rows.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list("turn")).alias("turns"), F.count_if("again").cast("int").alias("repeated"), F.sum("tokens").alias("n_tokens"))
    losses = F.array_compact(F.transform("turns", lambda t: t.loss))
    return grouped.select("conv_id", "window", F.array_join(F.transform("turns", lambda t: t.text), "").alias("text"), "n_tokens", "repeated", losses.alias("loss"))


def read_windows(windows: DataFrame) -> DataFrame:
    """Per window, read back from its text: conv_id, window, ``turns`` (role, text) that are new in it, ``losses`` (texts)."""
    parts = F.slice(F.split("text", r"<\|turn\|>", -1), F.col("repeated") + 2, F.greatest(F.lit(0), F.size(F.split("text", r"<\|turn\|>", -1)) - 1 - F.col("repeated")))

    def turn(part: Column) -> Column:
        role = F.substring_index(part, TEXT, 1)
        text = F.substring(part, F.length(role) + len(TEXT) + 1, F.length(part) - F.length(role) - len(TEXT) - len(END))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    losses = F.transform("loss", lambda m: unescape(F.substring(F.col("text"), m.start, m.length)))
    return windows.select("conv_id", "window", F.transform(parts, turn).alias("turns"), losses.alias("losses"), F.length("text").cast("long").alias("chars"))


def digest_windows(windows: DataFrame) -> DataFrame:
    """One row per conversation, from what its windows say: counts and digests of its turns and of what is under loss."""
    read = read_windows(windows)
    written = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    rows = read.select("conv_id", F.size("turns").cast("long").alias("n"), "chars", F.struct("window", written.alias("turns"), F.array_join("losses", "").alias("loss")).alias("part"))
    whole = rows.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list("part")).alias("parts"))
    all_turns, all_loss = F.array_join(F.transform("parts", lambda p: p.turns), ""), F.array_join(F.transform("parts", lambda p: p.loss), "")
    return whole.select("conv_id", "n_turns", F.sha2(all_turns, 256).alias("turns_sha256"), F.length(all_loss).cast("long").alias("loss_chars"), F.sha2(all_loss, 256).alias("loss_sha256"), "formatted_chars")
