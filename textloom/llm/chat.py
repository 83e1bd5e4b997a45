"""Chat formatting in budgeted windows (operator 10). DataFrame functions only.

A turn is formatted as ``<|role|>text<|end|>`` and a line break. Within role
and text, ``\\`` is written ``\\b`` and ``<`` is written ``\\l`` (in roles also
``|`` as ``\\p``), so no text can contain a marker, and the escapes are undone
by plain replacement. A turn costs a quarter of its formatted UTF-8 bytes,
rounded up, in tokens.

Prefix sums of these costs choose windows of whole turns: a window closes
before the turn whose sum, less the sum at which the window began, exceeds the
room (budget less the conversation's first system turn less the history's
share). Each window repeats that system turn and, of the turns before, the
latest within ``history_turns`` turn numbers and ``history`` tokens. Only
assistant texts of a window's own turns are under the loss mask; what is
repeated is masked. A turn that alone exceeds the room gets a window of its
own, marked over_budget; no text is ever cut.

Long conversations are handled in blocks of ``block`` turn numbers, and blocks
in which more rows than that share turn numbers in parts of ``block`` rows. At
the borders of both windows close as well, so that no task holds more of a
conversation than a part of a block and the turns before it that may be repeated.

Results: null roles and texts are empty ones. Rows are ordered by turn, then
role, then text; repeated rows are turns of their own, and ties don't matter. A
null turn is ordered first, and null conversation ids make up a conversation. A
very long text is a window of its own, whole. An empty table gives no windows.
Other input columns are dropped; the result has the columns named in
:func:`format_windows`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "<|end|>\n"
BUDGET, HISTORY, HISTORY_TURNS, BLOCK = 2048, 256, 4, 256


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("|"), F.lit("\\p"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\p"), F.lit("|")))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _turns(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    rows = df.select(
        F.col(conv).alias("conv_id"), F.coalesce(F.col(turn).cast("long"), F.lit(-1)).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    head = F.concat(F.lit("<|"), escape_role(F.col("role")), F.lit("|>"))
    rows = rows.withColumn("head", F.length(head)).withColumn("body", escape(F.col("text"))).withColumn("segment", F.concat(head, F.col("body"), F.lit(END)))
    return rows.select("conv_id", "turn", "role", "text", "segment", "head", F.length("body").alias("size"), F.ceil(F.octet_length("segment") / 4).cast("long").alias("cost"))


def _window(items: Column, n_before: Column, first: Column, last: Column, system: Column, history: int, history_turns: int, room: Column) -> Column:
    """One window of the block's own turns first to last (from 0), as a struct."""
    own = F.slice(items, n_before + first + 1, last - first + 1)
    at = F.element_at(items, n_before + first + 1)["turn"]
    earlier = F.filter(F.slice(items, 1, n_before + first), lambda x: x["turn"] >= at - history_turns)
    cost = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x["cost"])
    segments = lambda xs: F.array_join(F.transform(xs, lambda x: x["segment"]), "")

    def with_history(repeated: Column) -> Column:
        begins = F.coalesce(F.get(repeated, F.lit(0))["turn"], at)
        keeps = system.isNotNull() & (system["turn"] < begins)

        def with_prefix(p: Column) -> Column:
            def mark(state: Column, x: Column) -> Column:
                start = state["at"] + x["head"]
                span = F.struct(start.cast("int").alias("start"), (start + x["size"]).cast("int").alias("end"))
                found = F.when(x["role"] == "assistant", F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
                return F.struct((state["at"] + F.length(x["segment"])).cast("int").alias("at"), found.alias("spans"))

            nothing = F.struct(F.length(p["text"]).cast("int").alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
            return F.struct(
                at.alias("first_turn"), F.element_at(own, -1)["turn"].alias("last_turn"), F.size(own).alias("n_new"), F.length(p["text"]).alias("new_from"),
                F.concat(p["text"], segments(own)).alias("text"), F.aggregate(own, nothing, mark, lambda s: s["spans"]).alias("loss_spans"),
                (p["cost"] + cost(own)).alias("n_tokens"), (cost(own) > room).alias("over_budget"),
            )

        prefix = F.struct(F.concat(F.when(keeps, system["segment"]).otherwise(""), segments(repeated)).alias("text"), (F.when(keeps, system["cost"]).otherwise(0) + cost(repeated)).alias("cost"))
        return let(prefix, with_prefix)

    def latest(xs: Column) -> Column:
        return F.filter(xs, lambda _, j: cost(F.slice(xs, j + 1, F.size(xs))) <= history)

    return let(let(earlier, latest), with_history)


def _parts(turns: DataFrame, block: int) -> DataFrame:
    """Adds part, last_part and how many rows of the part come after each, in parts of ``block`` rows; a block of so many rows at most is one part."""
    crowded = turns.groupBy("conv_id", "block").count().where(F.col("count") > block)
    if crowded.isEmpty():
        zero = F.lit(0).cast("long")
        return turns.withColumn("part", zero).withColumn("last_part", zero).withColumn("left", zero)
    whole = Window.partitionBy("conv_id", "block")
    numbered = turns.withColumn("n", F.row_number().over(whole.orderBy("turn", "role", "text"))).withColumn("n_rows", F.count("*").over(whole))
    place = lambda n: F.floor((n - 1) / block).cast("long")
    parts = numbered.withColumn("part", place(F.col("n"))).withColumn("last_part", place(F.col("n_rows")))
    return parts.withColumn("left", F.least((F.col("part") + 1) * block, F.col("n_rows").cast("long")) - F.col("n")).drop("n", "n_rows")


def format_windows(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", budget: int = BUDGET, history: int = HISTORY, history_turns: int = HISTORY_TURNS, block: int = BLOCK
) -> DataFrame:
    """One row for each window: conv_id, block, part, window, first_turn, last_turn, n_new, new_from, text, loss_spans, n_tokens, over_budget.

    ``new_from`` is the code point at which the window's own turns begin;
    loss_spans are [start, end) in code points of ``text``.
    """
    if block < history_turns:
        raise ValueError("a block must be as long as the history that may be repeated: block >= history_turns")
    turns = _turns(df, conv, turn, role, text)
    system = turns.where("role = 'system'").groupBy("conv_id").agg(F.min(F.struct("turn", "segment", "cost")).alias("system")).withColumnRenamed("conv_id", "of")
    here = F.expr(f"(turn - pmod(turn, {block}L)) div {block}L")
    turns = _parts(turns.withColumn("block", here), block)
    # the last turns of a block, or part of one, are also what the next one may repeat: not more than the history's tokens, of which each turn costs some
    kept = history // 4 + 1
    in_block = F.when((F.col("part") < F.col("last_part")) & (F.col("left") < kept), F.struct(F.lit(True).alias("before"), F.col("block").alias("block"), (F.col("part") + 1).alias("part")))
    in_next = F.when((F.col("part") == F.col("last_part")) & (F.col("left") < kept) & (F.pmod("turn", F.lit(block)) >= block - history_turns), F.struct(F.lit(True).alias("before"), (F.col("block") + 1).alias("block"), F.lit(0).cast("long").alias("part")))
    places = F.array_compact(F.array(F.struct(F.lit(False).alias("before"), F.col("block").alias("block"), F.col("part").alias("part")), in_block, in_next))
    dealt = turns.withColumn("place", F.explode(places)).drop("block", "part").select("*", "place.*")
    item = F.struct("before", "turn", "role", "text", "segment", "head", "size", "cost")
    blocks = dealt.groupBy("conv_id", "block", "part").agg(F.collect_list(item).alias("items"), F.count_if("before").cast("int").alias("n_before"), F.count_if(~F.col("before")).cast("int").alias("n_own"))
    blocks = blocks.where("n_own > 0").withColumn("items", F.transform(F.array_sort(F.transform("items", lambda x: F.struct(x["turn"].alias("t"), (~x["before"]).alias("own"), x.alias("x")))), lambda s: s["x"]))
    joined = blocks.join(system, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    room = F.greatest(F.lit(1), F.lit(budget - history) - F.coalesce(F.col("system.cost"), F.lit(0)))

    def open_window(state: Column, x: Column) -> Column:
        total = state["total"] + x["cost"]
        opens = (state["i"] == 0) | ((total - state["from"] > state["room"]) & (state["from"] < state["total"]))
        return F.struct(
            (state["i"] + 1).alias("i"), total.alias("total"), F.when(opens, state["total"]).otherwise(state["from"]).alias("from"), state["room"].alias("room"),
            F.when(opens, F.concat(state["starts"], F.array(state["i"]))).otherwise(state["starts"]).alias("starts"),
        )

    zero = F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("from"), room.cast("long").alias("room"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate(F.slice(F.col("items"), F.col("n_before") + 1, F.col("n_own")), zero, open_window, lambda s: s["starts"])

    def windows(own: Column) -> Column:
        end = lambda k: F.coalesce(F.get(own, k + 1), F.col("n_own")) - 1
        return F.transform(own, lambda s, k: _window(F.col("items"), F.col("n_before"), s, end(k), F.col("system"), history, history_turns, room))

    out = joined.select("conv_id", "block", "part", F.posexplode(let(starts, windows)).alias("window", "w"))
    return out.select("conv_id", "block", "part", "window", "w.*")


def read_turns(text: Column) -> Column:
    """array<struct<role, text>> of formatted turns, unescaped."""
    parts = F.slice(F.split(text, "<\\|end\\|>\n"), 1, F.size(F.split(text, "<\\|end\\|>\n")) - 1)

    def read(part: Column) -> Column:
        mid = F.instr(part, "|>")
        return F.struct(unescape_role(F.substr(part, F.lit(3), mid - 3)).alias("role"), unescape(F.substr(part, mid + 2, F.length(part))).alias("text"))

    return F.transform(parts, read)


def read_loss(text: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(text, s["start"] + 1, s["end"] - s["start"]))), "")
