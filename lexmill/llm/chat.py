"""Chat formatting in budgeted windows, as DataFrame expressions.

Prefix sums of the turns' tokens cut a conversation into spans of whole turns: a turn that does not
fit in what the budget leaves opens the next span. Every span becomes one training text. A later
span repeats the conversation's leading system turn and as many of the last few turns before it as
the budget still holds, for context only: what is repeated carries no loss. Loss falls on the
assistant turns that are new. Part of the budget of later spans is reserved for that history.

Tokens are estimated: bytes of the text by bytes_per_token, and a fixed number for a turn's marks.

Control strings inside a role or a text are broken by a backslash (and backslashes doubled), so
that only the template's own marks stand in the output and unescape() gives the text back.

Defined results: a null role or text is empty; null turns come first; rows of the same turn are
ordered by role and text, and repeated rows are turns of their own; a null conv_id is a
conversation like others; an empty table has no spans. A turn over the budget stays whole, in a span
without other new turns; a system turn over half the budget leaves half of it to the others. Only
such spans are over the budget. Other columns, whatever their names, are ignored. A conversation's
digests need its whole text in one row, so the text of one conversation must fit in a row (2 GB).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: The openings of control strings, of this template and of others in common use.
CONTROLS = ["<|", "[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>"]


@dataclass(frozen=True)
class ChatParams:
    budget: int = 1024  #: estimated tokens of a span, with all that it repeats
    history: int = 2  #: turns repeated before a later span, at most
    reserve: int = 256  #: of a later span's budget, what new turns leave to history
    bytes_per_token: int = 4
    turn_tokens: int = 4  #: what the marks of a turn cost


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def chat_windows(convs: DataFrame, params: ChatParams = ChatParams()) -> DataFrame:
    """conv_id, span, formatted, n_repeated (pieces at the head that are context), tokens (estimated), loss (start and length of each target, in code points)."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    turns = convs.select("conv_id", "turn", empty("role").alias("role"), empty("text").alias("text"))
    conv = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    cost = F.ceil(F.octet_length("text") / params.bytes_per_token) + params.turn_tokens
    turns = turns.withColumn("rn", F.row_number().over(conv)).withColumn("head", F.length(head))
    turns = turns.withColumn("piece", F.concat(head, escape(F.col("text")), F.lit(END))).withColumn("cost", cost)
    turns = turns.withColumn("size", F.length("piece")).withColumn("lead_in", (F.col("rn") == 1) & (F.col("role") == "system"))
    turns = turns.withColumn("step", F.when(F.col("lead_in"), F.lit(0).cast("bigint")).otherwise(F.col("cost")))
    so_far = conv.rowsBetween(Window.unboundedPreceding, 0)
    turns = turns.withColumns({"ends": F.sum("step").over(so_far), "chars": F.sum("size").over(so_far), "target": F.col("role") == "assistant"})
    turns = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("rn", "ends", "chars", "step", "cost", "head", "size", "lead_in", "target", "piece"))).alias("t"))
    turns = turns.withColumns({"lead": F.expr("if(t[0].lead_in, 1, 0)"), "system": F.expr("if(t[0].lead_in, t[0].cost, 0L)")})
    turns = turns.withColumn("room", F.greatest(F.lit(params.budget) - F.col("system"), F.lit(params.budget // 2).cast("bigint")))
    turns = turns.withColumn("later", F.greatest(F.col("room") - params.reserve, F.lit(1).cast("bigint")))
    opened = "named_struct('starts', array_append(s.starts, s.at), 'base', x.ends - x.step, 'at', s.at + 1)"
    fits = "x.ends - s.base <= if(size(s.starts) = 1, room, later) OR x.ends - x.step = s.base"
    turns = turns.withColumn("starts", F.expr(f"aggregate(t, named_struct('starts', array(0), 'base', 0L, 'at', 0), (s, x) -> if({fits}, named_struct('starts', s.starts, 'base', s.base, 'at', s.at + 1), {opened}), s -> s.starts)"))
    turns = turns.withColumn("s", F.expr("transform(starts, (a, k) -> named_struct('span', k, 'first', a, 'last', coalesce(get(starts, k + 1), size(t)) - 1))"))
    begins = lambda at: f"(get(t, {at}).ends - get(t, {at}).step)"
    held = f"size(filter(sequence(1, {max(params.history, 1)}), j -> s.first - j >= lead AND get(t, s.last).ends - {begins('s.first - j')} <= room))"
    turns = turns.withColumn("s", F.expr(f"transform(s, s -> named_struct('span', s.span, 'first', s.first, 'last', s.last, 'back', if(s.span = 0 OR {params.history} = 0, 0, {held}), 'again', s.span > 0 AND lead = 1))"))
    shift = "if(s.again, t[0].size, 0) - (get(t, s.first - s.back).chars - get(t, s.first - s.back).size)"
    out = {
        "span": "cast(s.span as bigint)",
        "formatted": "concat(if(s.again, t[0].piece, ''), array_join(transform(slice(t, s.first - s.back + 1, s.last - s.first + s.back + 1), x -> x.piece), ''))",
        "n_repeated": "cast(s.back + if(s.again, 1, 0) as bigint)",
        "tokens": f"system + get(t, s.last).ends - {begins('s.first - s.back')}",
        "loss": f"transform(filter(slice(t, s.first + 1, s.last - s.first + 1), x -> x.target), x -> named_struct('start', {shift} + x.chars - x.size + x.head, 'length', x.size - x.head - {len(END)}))",
    }
    made = ", ".join(f"'{name}', {value}" for name, value in out.items())
    return turns.select("conv_id", F.explode(F.expr(f"transform(s, s -> named_struct({made}))")).alias("s")).select("conv_id", *[f"s.{name}" for name in out])


def read_back(spans: DataFrame) -> DataFrame:
    """conv_id with its digests, all taken from the formatted texts and their loss marks."""
    pieces = F.split(F.col("formatted"), r"<\|end\|>")
    new = F.slice(pieces, F.col("n_repeated").cast("int") + 1, F.size(pieces) - 1 - F.col("n_repeated").cast("int"))
    turn = lambda p: F.concat(unescape(F.substring_index(F.substr(p, F.lit(len(TURN) + 1)), TEXT, 1)), F.lit("\n"), unescape(F.substring_index(p, TEXT, -1)), F.lit("\n"))
    lost = F.transform("loss", lambda m: unescape(F.substr("formatted", m["start"].cast("int") + 1, m["length"].cast("int"))))
    read = spans.select("conv_id", "span", F.transform(new, turn).alias("turns"), F.array_join(lost, "").alias("lost"), F.length("formatted").cast("bigint").alias("chars"))
    whole = read.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("span", "turns", "lost"))).alias("all"), F.sum("chars").alias("formatted_chars"))
    turns = F.flatten(F.transform("all", lambda s: s["turns"]))
    loss = F.array_join(F.transform("all", lambda s: s["lost"]), "")
    whole = whole.withColumn("turns", turns).withColumn("loss", loss)
    return whole.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
