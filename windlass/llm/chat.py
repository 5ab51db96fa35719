"""Chat formatting with a verified round trip (native: DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windlass.llm.arrays import let, running_sums

START, END = "<|im_start|>", "<|im_end|>"
_START = r"<\|im_start\|>"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    """One backslash more in each ``<|``, ``<\\|``, ``<\\\\|`` ...: no ``<|`` is left."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _role_in(role: Column) -> Column:
    for plain, coded in (("%", "%25"), ("\n", "%0A"), ("|", "%7C")):
        role = F.replace(role, F.lit(plain), F.lit(coded))
    return role


def _role_out(role: Column) -> Column:
    for plain, coded in (("|", "%7C"), ("\n", "%0A"), ("%", "%25")):
        role = F.replace(role, F.lit(coded), F.lit(plain))
    return role


def render(role: Column, body: Column) -> Column:
    return F.concat(F.lit(START), _role_in(role), F.lit("\n"), body, F.lit(END + "\n"))


def parse(formatted: Column) -> Column:
    """array<struct<role, text, at, size>> of a formatted text; at and size place the raw body,
    in code points. A part that breaks the grammar is a null.

    The grammar is read left to right without a choice: ``conversation = turn*``,
    ``turn = START role "\\n" body END "\\n"``, where neither role nor body holds START or END.
    """
    tail = END + "\n"

    def turn(part: Column, end: Column) -> Column:
        inner = F.substring(part, F.lit(1), F.length(part) - len(tail))
        role = F.substring_index(inner, "\n", 1)
        body = F.substring(inner, F.length(role) + 2, F.length(inner))
        good = part.endswith(tail) & ~inner.contains(END) & inner.contains("\n")
        return F.when(good, F.struct(_role_out(role).alias("role"), unescape(body).alias("text"),
                                     (end - len(tail) - F.length(body)).alias("at"), F.length(body).alias("size")))

    return let(
        F.split(formatted, _START, -1),
        lambda parts: let(
            running_sums(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.length(p) + len(START))),
            lambda ends: F.concat(
                F.when(F.get(parts, 0) == "", F.array()).otherwise(F.array(F.lit(None))).cast("array<struct<role:string,text:string,at:int,size:int>>"),
                F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p, k: turn(p, F.get(ends, k))),
            ),
        ),
    )


def _same(parsed: Column, turns: Column) -> Column:
    plain = lambda a: F.transform(a, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return plain(parsed).eqNullSafe(plain(turns))


def render_turns(rows: DataFrame) -> DataFrame:
    """``rows`` with ``rendered``: each turn as it stands if reparsing it gives the turn back,
    escaped if not. Row by row, no shuffle. Null roles and texts are empty."""
    clean = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    as_is = render(F.col("role"), F.col("text"))
    one = F.array(F.struct("role", "text"))
    return clean.withColumn("rendered", F.when(_same(parse(as_is), one), as_is).otherwise(render(F.col("role"), escape(F.col("text")))))


def format_conversations(rows: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """(conv_id, formatted, turns, loss_spans) per conversation of ``rows`` (conv_id, turn, role,
    text).

    Turns go by ``turn`` (null first), then role and text; each row without a conv_id is a
    conversation of its own; repeated rows are turns of their own; other columns are not read. The text is
    parsed again and compared with the source; if turns that were fine alone do not return
    together, all of that conversation is escaped, which holds no START or END in any body.
    ``loss_spans`` are (start, end) in code points of ``formatted`` over each ``loss_role`` body.
    A conversation is one training sample and so one value; its turns meet in one row.
    """
    turn = F.struct("turn", "role", "text", "rendered")
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    grouped = render_turns(rows).withColumn("_alone", alone).groupBy("conv_id", "_alone").agg(F.array_sort(F.collect_list(turn)).alias("source"))
    first = F.array_join(F.transform("source", lambda t: t["rendered"]), "")
    again = F.array_join(F.transform("source", lambda t: render(t["role"], escape(t["text"]))), "")
    tried = grouped.withColumn("_try", F.struct(first.alias("formatted"), parse(first).alias("turns")))
    fixed = tried.withColumn("_fit", F.when(_same(F.col("_try.turns"), F.col("source")), F.col("_try")).otherwise(F.struct(again.alias("formatted"), parse(again).alias("turns"))))
    spans = F.transform(F.filter("turns", lambda t: t["role"] == loss_role), lambda t: F.struct(t["at"].alias("start"), (t["at"] + t["size"]).alias("end")))
    return fixed.select("conv_id", "_fit.formatted", "_fit.turns").withColumn("loss_spans", spans)


def digest(formatted: DataFrame) -> DataFrame:
    """The query's columns, read back from the formatted text: the turns through its parse, the
    text under the loss mask cut out of it by ``loss_spans``."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    under = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    lost = F.array_join(under, "")
    return formatted.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(lost).cast("long").alias("loss_chars"),
        F.sha2(lost, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
