"""Relational chat formatting, in Spark expressions only.

A conversation's turns are collected and sorted as structs; adjacent turns of
one role are merged over the sorted array and concatenated.

A conversation becomes one string: for each run of adjacent turns of one role
`<|im_start|>role`, a line feed, the turns' texts with `<|im_sep|>` between them,
`<|im_end|>` and a line feed.  Inside texts and roles a backslash is doubled and
`<|` becomes `<\\|`, in roles a line feed becomes `\\l`; so no text can hold a
marker, and everything can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def _unescaped(c: Column, mark: str, meant: str) -> Column:
    """Doubled backslashes are taken apart first, so that each escape is read once, from the left."""
    return F.array_join(F.transform(F.split(c, r"\\\\"), lambda x: F.replace(x, F.lit(mark), F.lit(meant))), "\\")


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans (start, end in code points of formatted; one for each text of trained_role), n_turns.

    Turns go by turn, then role and text where turns tie; equal rows are all
    kept.  Null text and null role count as empty, null turns come first, rows
    with a null conv_id are one conversation.  An empty table gives an empty
    result; other columns aren't read.
    """
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
        F.replace(_escaped(F.coalesce(F.col(role_col), F.lit(""))), F.lit("\n"), F.lit("\\l")).alias("role"), _escaped(F.coalesce(F.col(text_col), F.lit(""))).alias("text"),
    )
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    begins = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (i == 1) | (F.element_at("turns", i)["role"] != F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"]))
    turns = turns.withColumn("begins", begins).withColumn("ends", F.concat(F.transform(F.slice("begins", 2, F.size("begins")), lambda i: i - 1), F.array(F.size("turns"))))
    merged = turns.withColumn("runs", F.transform(F.arrays_zip("begins", "ends"), lambda r: F.slice("turns", r["begins"], r["ends"] - r["begins"] + 1))).withColumn(
        "messages", F.transform("runs", lambda run: F.concat(F.lit(START), run[0]["role"], F.lit("\n"), F.array_join(F.transform(run, lambda t: t["text"]), SEPARATOR), F.lit(f"{END}\n")))
    )
    sizes = F.transform("runs", lambda run: F.transform(run, lambda t, i: F.length(t["text"]) + F.when(i == 0, F.lit(len(START) + 1) + F.length(t["role"])).otherwise(F.lit(len(SEPARATOR)))))
    over = F.flatten(F.transform(sizes, lambda run: F.transform(run, lambda n, i: (n + F.when(i == F.size(run) - 1, F.lit(len(END) + 1)).otherwise(F.lit(0))).cast("long"))))
    merged = _running(merged.withColumn("lengths", over), "lengths", "places")
    last = F.transform("turns", lambda t, i: (i == F.size("turns") - 1) | (F.element_at("turns", F.least(i + 2, F.size("turns")))["role"] != t["role"]))
    ended = F.transform(F.arrays_zip("turns", "places", last.alias("last")), lambda x: F.struct(x["turns"].alias("turn"), (x["places"] - F.when(x["last"], F.lit(len(END) + 1)).otherwise(F.lit(0))).alias("end")))
    return merged.select(
        "conv_id", F.array_join("messages", "").alias("formatted"),
        F.transform(F.filter(ended, lambda x: x["turn"]["role"] == F.lit(trained_role)), lambda x: F.struct((x["end"] - F.length(x["turn"]["text"])).alias("start"), x["end"].alias("end"))).alias("loss_spans"),
        F.size("turns").cast("long").alias("n_turns"),
    )


#: Numbers that are summed one behind the other; an accumulated array is copied for every element, so it stays short.
CHUNK = 256


def _running(rows: DataFrame, numbers: str, name: str) -> DataFrame:
    """rows with the running sums of an array of longs: within chunks, then over the chunks' totals."""
    add = lambda sums, n: F.concat(sums, F.array(F.element_at(sums, -1) + n))
    none = F.array(F.lit(0).cast("long"))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / CHUNK).cast("int")), lambda c: F.aggregate(F.slice(numbers, c * CHUNK + 1, CHUNK), none, add))
    rows = rows.withColumn("chunks", chunks)
    rows = rows.withColumn("before", F.aggregate(F.transform("chunks", lambda c: F.element_at(c, -1)), none, add))
    return rows.withColumn(name, F.flatten(F.transform("chunks", lambda c, i: F.transform(F.slice(c, 2, CHUNK), lambda n: n + F.element_at("before", i + 1)))))


def read_turns(formatted: Column) -> Column:
    """An array of (role, text), one for each turn, from a formatted conversation."""
    messages = F.filter(F.split(formatted, f"{_quoted(START)}"), lambda m: m != "")
    body = F.transform(messages, lambda m: F.struct(F.substring_index(m, "\n", 1).alias("role"), m.alias("m")))
    return F.flatten(
        F.transform(
            body,
            lambda m: F.transform(
                F.split(F.substring(m["m"], F.length(m["role"]) + 2, F.length(m["m"]) - F.length(m["role"]) - 1 - len(END) - 1), _quoted(SEPARATOR)),
                lambda t: F.struct(_unescaped(m["role"], "\\l", "\n").alias("role"), _unescaped(t, "<\\|", "<|").alias("text")),
            ),
        )
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: _unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")), "<\\|", "<|")), "")


def _quoted(marker: str) -> str:
    return marker.replace("|", r"\|")
