"""Chat formatting by prefix-target expansion: every assistant turn becomes an example, only that reply trainable.

Built from DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A turn is  <turn ROLE>\nTEXT</turn>\n  with role and text escaped: no unescaped "<" or ">" is left in them, so neither
# these marks nor those of any other template inside a text can be taken for a mark. A line feed inside a role is escaped as
# well, so the first ">\n" of a turn ends its role.
OPEN, BODY, CLOSE = "<turn ", ">\n", "</turn>\n"
TARGET = "assistant"


def escape(column: Column) -> Column:
    for mark in ("\\", "<", ">"):
        column = F.replace(column, F.lit(mark), F.lit("\\" + mark))
    return column


def escape_role(column: Column) -> Column:
    return F.replace(escape(column), F.lit("\n"), F.lit(r"\n"))


def unescape(column: Column) -> Column:
    return F.regexp_replace(column, r"\\([\\<>])", "$1")


def unescape_role(column: Column) -> Column:
    """Pairs of backslashes are set aside first: any other backslash then starts an escape."""
    return F.array_join(F.transform(F.split(column, r"\\\\"), lambda x: unescape(F.replace(x, F.lit(r"\n"), F.lit("\n")))), "\\")


def format_examples(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, last_turn, formatted, loss_start, loss_length): an example for each assistant turn, with all turns before it.

    ``last_turn`` is the 1-based position of the example's last turn, loss_start (0-based) and loss_length count code points of
    ``formatted`` and cover that reply alone, escapes included. Turns after the last reply, or all turns where there is none,
    give one more example with nothing trainable, so that no turn is lost.

    Turns are ordered by turn, then role and text; null texts and roles are empty, null turn numbers come first; repeated rows
    are turns of their own, and rows with a null conversation are one conversation. Column names may clash with nothing here.
    Empty input gives an empty result. Work and size grow with the square of a conversation's turns, as the method asks.
    """
    rows = turns.select(
        F.col(f"`{conv_col}`").cast("long").alias("conv_id"),
        F.struct(
            F.col(f"`{turn_col}`").cast("long").alias("turn"),
            F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    ordered = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    formatted = F.transform("turns", lambda t: F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit(BODY), escape(t["text"]), F.lit(CLOSE)))
    places = F.filter(
        F.sequence(F.lit(1), F.size("turns")), lambda i: (F.element_at("turns", i)["role"] == TARGET) | (i == F.size("turns"))
    )
    examples = ordered.select("conv_id", "turns", formatted.alias("parts"), F.explode(places).alias("last_turn"))
    last = F.element_at("turns", F.col("last_turn"))
    length = F.when(last["role"] == TARGET, F.char_length(escape(last["text"]))).otherwise(0)
    text = F.array_join(F.slice("parts", F.lit(1), F.col("last_turn")), "")
    return examples.select("conv_id", F.col("last_turn").cast("long").alias("last_turn"), text.alias("formatted"), length.cast("long").alias("loss_length")).select(
        "conv_id", "last_turn", "formatted", (F.char_length("formatted") - F.col("loss_length") - len(CLOSE)).cast("long").alias("loss_start"), "loss_length"
    )


def parse_turns(formatted: Column) -> Column:
    """The (role, text) turns of a formatted example: the inverse of the template."""
    parts = F.split(formatted, r"</turn>\n")
    return F.transform(
        F.slice(parts, F.lit(1), F.size(parts) - 1),
        lambda p: F.struct(
            unescape_role(F.substring(p, F.lit(len(OPEN) + 1), F.instr(p, F.lit(BODY)) - len(OPEN) - 1)).alias("role"),
            unescape(F.substring(p, F.instr(p, F.lit(BODY)) + len(BODY), F.char_length(p))).alias("text"),
        ),
    )


def loss_text(formatted: Column, start: Column, length: Column) -> Column:
    return unescape(F.substring(formatted, (start + 1).cast("int"), length.cast("int")))


def summarize(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from the examples alone: its turns, and all text under the loss masks."""
    longest = F.max_by("formatted", "last_turn")
    losses = F.array_sort(F.collect_list(F.struct("last_turn", loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_length")).alias("text"))))
    read = examples.groupBy("conv_id").agg(
        parse_turns(longest).alias("turns"), F.array_join(F.transform(losses, lambda x: x["text"]), "").alias("loss"), F.sum(F.char_length("formatted")).alias("formatted_chars")
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
