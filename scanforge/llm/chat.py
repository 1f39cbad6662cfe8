"""Chat formatting with a grammar round trip, in DataFrame operations only.

A conversation is rendered, read back by a deterministic parser and compared with its
source. One that does not come back identical is rendered again with its content escaped,
which is announced in a header and undone by the parser.

Grammar: ``[<|escaped|>\\n]`` then for each turn ``<|im_start|>role\\ntext<|im_end|>\\n``.
Texts and roles never hold ``<|``. Under the header, one backslash is put after the ``<`` of
every ``<``, backslashes, ``|``; in roles, backslashes and line feeds are escaped before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, HEADER = "<|im_start|>", "<|im_end|>", "<|escaped|>\n"


def escape(x: Column) -> Column:
    return F.regexp_replace(x, r"<(\\*)\|", r"<\\$1|")


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"<\\(\\*)\|", r"<$1|")


def _escape_role(x: Column) -> Column:
    return escape(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(x: Column) -> Column:
    parts = F.transform(F.split(unescape(x), r"\\\\"), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return F.array_join(parts, "\\")


def render(turns: Column, escaped: bool) -> Column:
    def one(t):
        role, text = t["role"], t["text"]
        if escaped:
            role, text = _escape_role(role), escape(text)
        return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))

    body = F.array_join(F.transform(turns, one), "")
    return F.concat(F.lit(HEADER), body) if escaped else body


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation, or null where the grammar is not met."""
    is_escaped = formatted.startswith(HEADER)
    body = F.when(is_escaped, F.substring(formatted, F.lit(len(HEADER) + 1), F.length(formatted))).otherwise(formatted)
    pieces = F.split(body, r"<\|im_start\|>")

    def turn(p):
        role = F.substring_index(p, "\n", 1)
        text = F.substring(p, F.length(role) + 2, F.length(p) - F.length(role) - 2 - len(END))
        return F.struct(F.when(is_escaped, _unescape_role(role)).otherwise(role).alias("role"), F.when(is_escaped, unescape(text)).otherwise(text).alias("text"))

    def good(p):
        inside = F.substring(p, F.lit(1), F.length(p) - len(END) - 1)
        return p.endswith(END + "\n") & p.contains("\n") & ~inside.contains("<|") & inside.contains("\n")

    rest = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
    fits = (F.get(pieces, F.lit(0)) == "") & F.forall(rest, good)
    return F.when(fits, F.transform(rest, turn))


def format_chat(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: id, ``formatted``, ``escaped``, ``n_turns``, ``loss_spans``, ``round_trip``.

    Turns are in order of turn, then role, then text (null turns first); null roles and
    texts are empty. ``loss_spans`` holds the start (from 0) and length, in code points of
    ``formatted``, of each assistant turn's text. ``round_trip`` tells that what the parser
    recovers from ``formatted`` is the source. Repeated rows are repeated turns. Rows of a
    null id are one conversation. Other columns are ignored. A conversation is one training
    example and so one row, however long.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    grouped = df.groupBy(F.col(conv_col).alias("_conv")).agg(F.array_sort(F.collect_list(turn)).alias("_sorted"))
    grouped = grouped.withColumn("_turns", F.transform("_sorted", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    plain = grouped.withColumn("_plain", render(F.col("_turns"), False))
    plain = plain.withColumn("escaped", ~F.coalesce(parse(F.col("_plain")) == F.col("_turns"), F.lit(False)))
    out = plain.withColumn("formatted", F.when(F.col("escaped"), render(F.col("_turns"), True)).otherwise(F.col("_plain")))
    out = out.withColumn("round_trip", F.coalesce(parse(F.col("formatted")) == F.col("_turns"), F.lit(False)))
    return out.select(F.col("_conv").alias(conv_col), "formatted", "escaped", F.size("_turns").cast("long").alias("n_turns"), loss_spans(F.col("formatted")).alias("loss_spans"), "round_trip")


def loss_spans(formatted: Column) -> Column:
    """Start and length of each assistant text in a rendered conversation."""
    pieces = F.split(formatted, r"<\|im_start\|>")
    start = F.struct(F.length(F.get(pieces, F.lit(0))).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc, p):
        role = F.substring_index(p, "\n", 1)
        at = acc["at"] + len(START)
        span = F.struct((at + F.length(role) + 1).cast("bigint").alias("start"), (F.length(p) - F.length(role) - 2 - len(END)).cast("bigint").alias("length"))
        spans = F.when(role == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((at + F.length(p)).cast("bigint").alias("at"), spans.alias("spans"))

    return F.aggregate(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), start, step, lambda acc: acc["spans"])


def read_back(chats: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Digests of what the output of :func:`format_chat` holds, read from the output alone."""
    masked = F.transform("loss_spans", lambda s: F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))
    is_escaped = F.col("formatted").startswith(HEADER)
    # Texts are unescaped one by one: escapes never reach over the end of a text.
    masked = F.array_join(F.transform(masked, lambda x: F.when(is_escaped, unescape(x)).otherwise(x)), "")
    read = chats.withColumn("_turns", parse(F.col("formatted"))).withColumn("_loss", masked)
    turns = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        conv_col,
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "escaped",
    )
