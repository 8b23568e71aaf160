"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs and sorted, adjacent turns of one role merged by
an array aggregation, and the result concatenated. Control strings inside texts are escaped
reversibly, and merged turns stay apart by a separator, so that the output can be read back.

One conversation is one array, as the formatted text is one value; conversations are spread by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template; fixed values.
START, END, SEPARATOR = "<|im_start|>", "<|im_end|>", "<|im_sep|>"


def escape(text: Column) -> Column:
    """No ``<|`` is left: it becomes ``<\\|``, and backslashes are doubled."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """The inverse. Backslashes of the text come in pairs, so a single one after ``<`` is ours."""
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    """As a text, and on one line."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n"), F.lit("\n")))


TURN = "struct<role:string,texts:array<string>>"


def format_chats(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per ``conv_id``: ``formatted`` and ``loss_spans``, the code-point spans [start, end)
    of the trained role's texts in it (escaped, without the strings between).

    Rows are ordered by turn (nulls first), then role and text, so repeated turns have a defined
    place. Null texts and roles count as empty; rows without ``conv_id`` form one conversation. An
    empty table gives no rows; other columns are not read.
    """
    empty = F.lit("")
    turn = F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def absorb(done: Column, turn: Column) -> Column:
        last = F.element_at(done, -1)
        merged = F.struct(last["role"].alias("role"), F.array_append(last["texts"], turn["text"]).alias("texts")).cast(TURN)
        single = F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts")).cast(TURN)
        same = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["role"] == turn["role"])
        return F.when(same, F.array_append(F.slice(done, 1, F.size(done) - 1), merged)).otherwise(F.array_append(done, single))

    merged = grouped.withColumn("turns", F.aggregate("turns", F.array().cast(f"array<{TURN}>"), absorb))

    # Pieces in order: what stands around texts, and texts with a flag.
    def pieces(turn: Column) -> Column:
        head = F.struct(F.concat(F.lit(START), escape_role(turn["role"]), F.lit("\n")).alias("piece"), F.lit(False).alias("trained"))
        tail = F.struct(F.lit(END + "\n").alias("piece"), F.lit(False).alias("trained"))
        texts = F.transform(
            turn["texts"],
            lambda text, i: F.array(
                F.struct(F.when(i > 0, F.lit(SEPARATOR)).otherwise(F.lit("")).alias("piece"), F.lit(False).alias("trained")),
                F.struct(escape(text).alias("piece"), (turn["role"] == trained_role).alias("trained")),
            ),
        )
        return F.concat(F.array(head), F.flatten(texts), F.array(tail))

    laid = merged.withColumn("pieces", F.flatten(F.transform("turns", pieces))).drop("turns")

    def walk(state: Column, piece: Column) -> Column:
        end = state["at"] + F.char_length(piece["piece"]).cast("long")
        span = F.struct(state["at"].alias("start"), end.alias("end"))
        spans = F.when(piece["trained"], F.array_append(state["spans"], span)).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans")).cast("struct<at:bigint,spans:array<struct<start:bigint,end:bigint>>>")

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))
    return laid.select(
        "conv_id",
        F.array_join(F.col("pieces.piece"), "").alias("formatted"),
        F.aggregate("pieces", start, walk, lambda state: state["spans"]).alias("loss_spans"),
    )


def read_chats(formatted: DataFrame) -> DataFrame:
    """The turns of each formatted conversation (``turns``: role and text structs in order) and the
    texts under the loss mask (``loss_texts``), unescaped."""

    def read(block: Column) -> Column:
        line_end = F.instr(block, "\n")
        role = unescape_role(F.substring(block, F.lit(len(START) + 1), line_end - len(START) - 1))
        body = F.substring(block, line_end + 1, F.char_length(block))
        return F.transform(F.split(body, _quoted(SEPARATOR), -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    # Every block ends with the end mark and a line break: what follows the last one is empty.
    blocks = F.split("formatted", _quoted(END) + "\n", -1)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)
    trained = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.withColumns({"turns": F.flatten(F.transform(blocks, read)), "loss_texts": trained})


def _quoted(text: str) -> str:
    return text.replace("|", "\\|")
