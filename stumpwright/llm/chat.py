"""Operator 10: chat formatting as Spark expressions.

A conversation's turns are collected as structs, sorted by (turn, role, text), and adjacent turns
of one role merged into a block by array functions:

    <|im_start|>role\\ntext<|im_sep|>text<|im_end|>\\n

Texts and roles are escaped so that no control string can occur inside them: a backslash becomes
two, "<|" becomes "<\\|", and a role's line break gets a backslash. loss_runs marks the code points
under the loss: pairs (skip, take), a pair per assistant text, then the rest as (skip, 0).

Nulls: a null text or role is empty, a null turn sorts first, rows with null conv_id are one
conversation. Ties in turn go by role, then text; repeated rows are repeated turns. An empty table
gives no rows. Extra columns are ignored. A conversation is one string, so it must fit one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stumpwright.llm.common import only

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
LEARNED_ROLE = "assistant"


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def _unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def formatted(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, formatted, loss_runs array<struct<skip,take>>: one row per conversation."""
    t = only(turns, conv_id=conv_id, turn=turn, role=role, text=text).select(
        "conv_id",
        F.struct(
            "turn",
            F.replace(_escaped(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("\\\n")).alias("role"),
            _escaped(F.coalesce("text", F.lit(""))).alias("text"),
        ).alias("t"),
    )
    ts = t.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    starts = F.filter(
        F.sequence(F.lit(0), F.size("ts") - 1),
        lambda i: (i == 0) | (F.get("ts", i)["role"] != F.get("ts", i - 1)["role"]),
    )
    at = ts.withColumn("starts", starts)
    blocks = F.transform(
        "starts",
        lambda s, j: F.slice("ts", s + 1, F.coalesce(F.get("starts", j + 1), F.size("ts")) - s),
    )
    b = at.withColumn("blocks", blocks)
    body = lambda x: F.array_join(F.transform(x, lambda t: t["text"]), SEP)
    head = lambda x: F.concat(F.lit(START), F.get(x, F.lit(0))["role"], F.lit("\n"))
    pieces = F.transform("blocks", lambda x: F.concat(head(x), body(x), F.lit(END)))
    run = lambda skip, take: F.struct(skip.cast("int").alias("skip"), take.cast("int").alias("take"))
    learned = lambda x: F.concat(
        F.transform(x, lambda t, i: run(F.when(i == 0, F.length(head(x))).otherwise(len(SEP)), F.length(t["text"]))),
        F.array(run(F.lit(len(END)), F.lit(0))),
    )
    other = lambda x: F.array(run(F.length(head(x)) + F.length(body(x)) + len(END), F.lit(0)))
    runs = F.flatten(
        F.transform("blocks", lambda x: F.when(F.get(x, F.lit(0))["role"] == LEARNED_ROLE, learned(x)).otherwise(other(x)))
    )
    return b.select("conv_id", F.array_join(pieces, "").alias("formatted"), runs.alias("loss_runs"))


def turns_of(c: Column) -> Column:
    """The turns of a formatted string: array of (role, text), unescaped, as they were put in."""
    inner = F.regexp_extract_all(c, F.lit(r"(?s)<\|im_start\|>(.*?)<\|im_end\|>\n"), F.lit(1))
    head = r"(?s)^((?:[^\\\n]|\\.)*)\n"
    return F.flatten(
        F.transform(
            inner,
            lambda x: F.transform(
                F.split(F.regexp_replace(x, head, ""), r"<\|im_sep\|>", -1),
                lambda t: F.struct(_unescaped(F.regexp_extract(x, head, 1)).alias("role"), _unescaped(t).alias("text")),
            ),
        )
    )


#: Code points of a piece of the formatted string, and runs of a group, so that a long conversation is read in
#: time that grows with its length: no text is sought from the string's start.
_PIECE, _GROUP = 1024, 256


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _places(runs: Column) -> Column:
    """(at, take) of each run: code points before what it takes, by sums within groups of runs."""
    last = F.floor((F.size(runs) - 1) / _GROUP).cast("int")
    groups = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda g: F.slice(runs, g * _GROUP + 1, F.lit(_GROUP)))
    ends = lambda own, at: F.aggregate(own, F.array(at), lambda a, r: F.concat(a, F.array(F.element_at(a, -1) + r["skip"] + r["take"])))
    total = lambda own: F.aggregate(own, F.lit(0), lambda a, r: a + r["skip"] + r["take"])
    starts = lambda gs: F.aggregate(gs, F.array(F.lit(0)), lambda a, own: F.concat(a, F.array(F.element_at(a, -1) + total(own))))
    placed = lambda own, at: F.zip_with(own, F.slice(ends(own, at), F.lit(1), F.size(own)), lambda r, x: F.struct((x + r["skip"]).alias("at"), r["take"].alias("take")))
    return _let(groups, lambda gs: _let(starts(gs), lambda at: F.flatten(F.transform(gs, lambda own, g: placed(own, F.get(at, g))))))


def learned_texts(formatted: Column, runs: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    piece = lambda at: F.floor(at / _PIECE).cast("int")

    def text(pieces: Column, p: Column) -> Column:
        first = piece(p["at"])
        own = F.array_join(F.slice(pieces, first + 1, piece(p["at"] + p["take"] - 1) - first + 1), "")
        return _unescaped(F.substr(own, p["at"] % _PIECE + 1, p["take"]))

    taken = F.filter(_places(runs), lambda p: p["take"] > 0)
    pieces = F.regexp_extract_all(formatted, F.lit(rf"(?s).{{1,{_PIECE}}}"), F.lit(0))
    return _let(pieces, lambda x: F.transform(taken, lambda p: text(x, p)))


def digest(out: DataFrame) -> DataFrame:
    """Per conversation, read back from its formatted string and mask."""
    d = out.select("conv_id", "formatted", turns_of(F.col("formatted")).alias("turns"), F.array_join(learned_texts(F.col("formatted"), F.col("loss_runs")), "").alias("learned"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return d.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
