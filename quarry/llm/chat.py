"""Chat formatting into budgeted training windows.

Turns are dealt over tasks by range of (conversation, turn), so that a very long conversation spans many of them, and
written once; prefix sums of turn tokens are taken in two levels, within each part of a conversation and over its parts.
They choose turn-aligned spans: with T the budget less the system turn, a turn whose preceding turns hold t tokens is a
target of span t div (T / 2), and one of more than T / 2 tokens ends its span and is a span of its own. So a span holds
T tokens at most, unless it is one turn that is larger. Every later window repeats the system turn, and of the last
`history` turns before its targets as many, from the nearest on, as the budget has room for. Repeated turns are marked
and are never under the loss mask, so each assistant turn is a target once. A window exceeds the budget only where one
turn and the system turn alone do.

A window's text is a row of turns, `<|turn|>role\\ntext<|end|>\\n` (`<|again|>` for repeated ones). `&`, `<` and `[`
in texts are written `&amp;`, `&lt;` and `&#91;` (a newline in a role `&#10;`), so no control string of this or of a
bracket-style template can come from a text, and reading back restores it.

Turns are ordered by (turn, role, text), null turns first; repeated rows are turns of their own. A null text is empty,
a null role is `user`, and rows without conv_id form one conversation. A very long text is one turn, kept whole. An empty
table gives an empty table; columns beyond these four, whatever their names, are left out. Only DataFrame functions run.
A conversation's text meets in one row only where `report` makes digests of all of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import Workspace

TURN, AGAIN, END = "<|turn|>", "<|again|>", "<|end|>\n"
NO_ID = -(2**63)


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("["), F.lit("&#91;"))


def unescape(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("&#10;"), F.lit("\n")), F.lit("&#91;"), F.lit("["))
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def tokens(text: Column) -> Column:
    """An estimate that needs no tokenizer: four characters a token, and four tokens for the marks of a turn."""
    return F.floor((F.length(text) + 3) / 4) + 4


def placed(turns: DataFrame, budget: int, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """Turns with key, part, pos (their order), place (from 0), role, text, tokens, window and the system turn's pos and
    tokens; and for each part of a conversation the system turn's text. Both written once."""
    key = F.coalesce("conv_id", F.lit(NO_ID)).alias("key")
    rows = turns.select(key, "turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["key", "turn", "role", "text", "mix"]  # mix deals out repeated rows, which are alike
    dealt = rows.withColumn("mix", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = ws.save(dealt.select("key", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos"), "role", "text", tokens(F.col("text")).alias("tokens")), "dealt")
    sums = rows.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"))
    earlier = W.partitionBy("key").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    system = rows.filter("role = 'system'").groupBy("key").agg(F.min(F.struct("pos", "tokens", "text")).alias("s"))
    parts = sums.select("key", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("t0"))
    parts = ws.save(parts.join(system, "key", "left").select("key", "part", "n0", "t0", F.col("s.pos").alias("s_pos"), F.coalesce("s.tokens", F.lit(0)).alias("s_tokens"), F.col("s.text").alias("s_text")), "parts")
    own = W.partitionBy("key", "part").orderBy("pos")
    before = F.col("t0") + F.coalesce(F.sum("tokens").over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    half = F.greatest(F.lit(1), F.floor((budget - F.col("s_tokens")) / 2))
    window = 2 * F.floor(before / half) + (F.col("tokens") > half).cast("bigint")
    numbered = rows.join(parts.drop("s_text"), ["key", "part"])
    shown = numbered.select("key", "part", "pos", (F.col("n0") + F.row_number().over(own) - 1).alias("place"), "role", "text", "tokens", window.alias("window"), "s_pos", "s_tokens")
    made = ws.save(shown, "turns")
    ws.drop("dealt")
    return made, parts


def windows(turns: DataFrame, budget: int = 1024, history: int = 2) -> DataFrame:
    """conv_id, window, tokens (of all its turns), formatted, loss_spans (character offsets, end exclusive)."""
    rows, by_part = placed(turns, budget, Workspace(turns.sparkSession, "chat"))
    starts = rows.groupBy("key", "window").agg(F.min(F.struct("place", "part", "pos")).alias("f"), F.sum("tokens").alias("used"), F.min("s_pos").alias("s_pos"), F.min("s_tokens").alias("s_tokens"))
    later = F.coalesce(F.col("s_pos") < F.col("f.pos"), F.lit(False))
    room = budget - F.col("used") - F.when(later, F.col("s_tokens")).otherwise(0)
    starts = starts.select("key", "window", F.col("f.place").alias("first"), F.col("f.part").alias("part"), later.alias("later"), room.alias("room"))
    wanted = starts.filter("first > 0").select("key", "window", "room", F.explode(F.sequence(F.greatest(F.col("first") - history, F.lit(0)), F.col("first") - 1)).alias("place"))
    near = rows.drop("window").join(wanted, ["key", "place"]).filter("s_pos is null or pos != s_pos")
    upto = F.sum("tokens").over(W.partitionBy("key", "window").orderBy(F.desc("place")))
    told = near.withColumn("upto", upto).filter("upto <= room")
    kept = starts.filter("later").join(by_part.select("key", "part", "s_tokens", "s_text"), ["key", "part"])
    part = lambda again, place, role, text, size: F.struct(place.cast("bigint").alias("place"), F.lit(again).alias("again"), role.alias("role"), text.alias("text"), size.cast("bigint").alias("tokens"))
    c = F.col
    parts = rows.select("key", "window", part(False, c("place"), c("role"), c("text"), c("tokens")).alias("p"))
    parts = parts.unionByName(told.select("key", "window", part(True, c("place"), c("role"), c("text"), c("tokens")).alias("p")))
    parts = parts.unionByName(kept.select("key", "window", part(True, F.lit(-1), F.lit("system"), c("s_text"), c("s_tokens")).alias("p")))
    grouped = parts.groupBy("key", "window").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    head = lambda p: F.concat(F.when(p.again, AGAIN).otherwise(TURN), F.replace(escape(p.role), F.lit("\n"), F.lit("&#10;")), F.lit("\n"))
    piece = F.transform("ps", lambda p: F.struct(head(p).alias("head"), escape(p.text).alias("body"), (~p.again & (p.role == "assistant")).alias("loss")))
    span = "struct<start:bigint,end:bigint>"
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{span}>").alias("spans"))

    def grow(a, p):
        start = a.at + F.length(p.head)
        stop = start + F.length(p.body)
        own = F.struct(start.cast("bigint").alias("start"), stop.cast("bigint").alias("end"))
        return F.struct((stop + len(END)).cast("bigint").alias("at"), F.when(p.loss, F.concat(a.spans, F.array(own))).otherwise(a.spans).alias("spans"))

    made = grouped.withColumn("pieces", piece)
    return made.select(
        F.nullif("key", F.lit(NO_ID)).alias("conv_id"), "window", F.aggregate("ps", F.lit(0).cast("bigint"), lambda n, p: n + p.tokens).alias("tokens"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p.head, p.body, F.lit(END))), "").alias("formatted"),
        F.aggregate("pieces", zero, grow, lambda a: a.spans).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """For each window, what its text and mask say: target turns (role, text) and the loss text."""
    pieces = F.filter(F.split("formatted", r"<\|end\|>\n"), lambda x: x.startswith(TURN))
    body = lambda x: F.substr(x, F.lit(len(TURN) + 1))
    cut = lambda x: F.instr(x, "\n")
    turn = lambda x: F.struct(unescape(F.substring_index(x, "\n", 1)).alias("role"), unescape(F.substr(x, cut(x) + 1)).alias("text"))
    loss = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s.start + 1).cast("int"), (s.end - s.start).cast("int"))))
    return formatted.select("conv_id", "window", F.length("formatted").cast("bigint").alias("chars"), F.transform(pieces, lambda x: turn(body(x))).alias("turns"), F.array_join(loss, "").alias("loss"))


def report(turns: DataFrame) -> DataFrame:
    back = read_back(windows(turns))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    rows = back.select("conv_id", F.struct("window", text.alias("text"), "loss").alias("w"), F.size("turns").alias("n"), "chars")
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("ws"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    said = F.array_join(F.transform("ws", lambda w: w.loss), "")
    return whole.select(
        "conv_id", F.col("n_turns").cast("bigint").alias("n_turns"), F.sha2(F.array_join(F.transform("ws", lambda w: w.text), ""), 256).alias("turns_sha256"),
        F.length(said).cast("bigint").alias("loss_chars"), F.sha2(said, 256).alias("loss_sha256"), "formatted_chars",
    )
