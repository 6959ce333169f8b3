"""Chat formatting with Spark expressions only.

Turns are collected as structs, sorted, folded so that adjacent turns of one role
share a block, and concatenated:

    <|im_start|>role NEWLINE text [<|im_sep|> text ...] <|im_end|> NEWLINE ...

A control string starts with ``<|``.  In roles and texts every ``<``, any number
of backslashes and ``|`` gets one backslash more, which one less undoes, so texts
can hold any string and still no control string.  A newline within a role is
written ``<|nl|>``.  The loss mask covers the texts of the assistant, without
separators; it is given as runs of (masked in, length) over the formatted string.

Conversations are put together in two steps, first blocks of ``BLOCK`` turn
numbers, then whole conversations, so that a very long one is sorted, folded and
escaped in many tasks and only its pieces meet.  Turns that share a turn number, or
have none, are one block; like all blocks it is folded ``BLOCK`` turns at a time.

Null texts and roles are empty.  Turns are ordered by turn (nulls first), then
role and text, so that ties and repeated rows have one order and all stay.  Rows
with a null conversation id form one conversation with that id.  An empty table
has no conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEPARATOR, END, NEWLINE_IN_ROLE = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n", "<|nl|>"
BLOCK = 64
_RUNS = "array<struct<role:string,texts:array<string>>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(NEWLINE_IN_ROLE))


def _fold(turns: Column) -> Column:
    """Sorted turns to runs of one role each."""

    def add(runs: Column, turn: Column) -> Column:
        last = F.try_element_at(runs, F.lit(-1))
        longer = F.struct(turn["role"].alias("role"), F.concat(last["texts"], F.array(turn["text"])).alias("texts"))
        new = F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts"))
        same = (F.size(runs) > 0) & (last["role"] == turn["role"])
        return F.when(same, F.concat(F.slice(runs, F.lit(1), F.greatest(F.size(runs) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(runs, F.array(new))).cast(_RUNS)

    return F.aggregate(turns, F.array().cast(_RUNS), add)


def _runs_of(turns: Column) -> Column:
    """Runs of sorted turns, folded ``BLOCK`` at a time; a role may go on from one fold to the next."""
    starts = F.sequence(F.lit(0), F.floor((F.size(turns) - 1) / BLOCK).cast("int"))
    return F.flatten(F.transform(starts, lambda k: _fold(F.slice(turns, k * BLOCK + 1, F.lit(BLOCK)))))


def formatted(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, formatted, loss_runs (array of struct masked, length)."""
    turns = conversations.select(
        conversations[conv_col].alias("conv_id"),
        conversations[turn_col].cast("long").alias("turn"),
        F.coalesce(conversations[role_col].cast("string"), F.lit("")).alias("role"),
        F.coalesce(conversations[text_col].cast("string"), F.lit("")).alias("text"),
    )
    block = F.floor(F.col("turn") / BLOCK)
    blocks = turns.groupBy("conv_id", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    blocks = blocks.select("conv_id", "block", _runs_of(F.col("turns")).alias("runs"))
    whole = blocks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "runs"))).alias("blocks"))
    whole = whole.select("conv_id", F.flatten(F.transform("blocks", lambda b: b["runs"])).alias("runs"))

    def opening(run: Column, i: Column) -> Column:
        """What comes before a run: nothing but a separator where blocks of turns met within one role."""
        goes_on = (i > 0) & (F.get(F.col("runs"), i - 1)["role"] == run["role"])
        header = F.concat(F.when(i > 0, F.lit(END)).otherwise(F.lit("")), F.lit(START), _role(run["role"]), F.lit("\n"))
        return F.when(goes_on, F.lit(SEPARATOR)).otherwise(header)

    pieces = whole.select("conv_id", F.transform("runs", lambda run, i: F.struct(opening(run, i).alias("opening"), F.transform(run["texts"], escape).alias("texts"), (run["role"] == "assistant").alias("loss"))).alias("pieces"))
    text = F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["opening"], F.array_join(p["texts"], SEPARATOR))), ""), F.lit(END))

    def masked(p: Column) -> Column:
        """Runs of one piece: each text after what precedes it."""
        return F.flatten(F.transform(p["texts"], lambda t, j: F.array(F.struct(F.lit(False).alias("masked"), F.when(j == 0, F.length(p["opening"])).otherwise(F.lit(len(SEPARATOR))).alias("length")), F.struct(p["loss"].alias("masked"), F.length(t).alias("length")))))

    closing = F.array(F.struct(F.lit(False).alias("masked"), F.lit(len(END)).alias("length")))
    return pieces.select("conv_id", text.alias("formatted"), F.concat(F.flatten(F.transform("pieces", masked)), closing).alias("loss_runs"))


def parsed(formatted_rows: DataFrame) -> DataFrame:
    """Reads the formatted strings back: their columns and turns (array of struct role, text)."""
    blocks = F.filter(F.split("formatted", r"<\|im_end\|>\n", -1), lambda b: b != "")

    def turns(block: Column) -> Column:
        inner = F.substring(block, F.lit(len(START) + 1), F.length(block))
        at = F.instr(inner, "\n")
        role = unescape(F.replace(F.substring(inner, F.lit(1), at - 1), F.lit(NEWLINE_IN_ROLE), F.lit("\n")))
        return F.transform(F.split(F.substring(inner, at + 1, F.length(inner)), r"<\|im_sep\|>", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return formatted_rows.withColumn("turns", F.flatten(F.transform(blocks, turns)))


def under_mask(text: Column, runs: Column) -> Column:
    """The unescaped slices of ``text`` that ``runs`` mask in, joined by blocks of runs.

    Cut from four bytes a character, where a slice costs its own length wherever
    it is; runs are folded in blocks, so that no long array is built by appending.
    """
    state = "struct<at:bigint,slices:array<string>>"

    def start(at: Column) -> Column:
        return F.struct(at.alias("at"), F.array().cast("array<string>").alias("slices")).cast(state)

    def of(wide: Column) -> Column:
        def cut(so_far: Column, run: Column) -> Column:
            one = unescape(F.decode(F.substring(wide, (so_far["at"] * 4 + 1).cast("int"), run["length"] * 4), "UTF-32"))
            return F.struct((so_far["at"] + run["length"]).alias("at"), F.when(run["masked"], F.concat(so_far["slices"], F.array(one))).otherwise(so_far["slices"]).alias("slices")).cast(state)

        def block(so_far: Column, number: Column) -> Column:
            done = F.aggregate(F.slice(runs, number * BLOCK + 1, F.lit(BLOCK)), start(so_far["at"]), cut)
            return F.transform(F.array(done), lambda d: F.struct(d["at"].alias("at"), F.concat(so_far["slices"], F.array(F.array_join(d["slices"], ""))).alias("slices")).cast(state))[0]

        return F.aggregate(F.sequence(F.lit(0), F.floor(F.size(runs) / BLOCK).cast("int")), start(F.lit(0).cast("long")), block)["slices"]

    # bound once, not encoded anew for each run
    return F.transform(F.array(F.encode(text, "UTF-32")), of)[0]


def digests(formatted_rows: DataFrame) -> DataFrame:
    """The contract's columns, from what is read back; the loss columns from the text under the mask."""
    rows = parsed(formatted_rows)
    loss = F.array_join(under_mask(F.col("formatted"), F.col("loss_runs")), "")
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
