"""Chat formatting by prefix-target expansion, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<s>", "</s>\n"
#: Every character that could begin a control string, and what stands for it inside a text. The backslash comes first.
ESCAPES = (("\\", "\\0"), ("<", "\\1"), ("[", "\\2"))


def escape(column: Column) -> Column:
    """Reversible: afterwards the text has no '<' or '[', hence no marker of this or a similar template."""
    for plain, coded in ESCAPES:
        column = F.replace(column, F.lit(plain), F.lit(coded))
    return column


def unescape(column: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        column = F.replace(column, F.lit(coded), F.lit(plain))
    return column


def _role(column: Column) -> Column:
    return F.replace(escape(column), F.lit("\n"), F.lit("\\3"))


def expand(df: DataFrame, target_role: str = "assistant") -> DataFrame:
    """One training example per assistant turn of (conv_id, turn, role, text): all turns before it as context, only its
    own text trainable.

    Returns conv_id, example (1, 2, ... in turn order), formatted, loss_start, loss_end (code points of `formatted`, end
    exclusive; null where nothing is trainable). Turns after the last assistant turn, or a conversation without one,
    make a last example that trains nothing, so that no turn is lost.

    Rows sort by turn (nulls first), then role and text; repeated rows stay repeated turns; null role or text counts as
    ''. Rows with a null conv_id form one conversation. An empty table gives no rows. Other columns are left out. An
    example holds its whole context by definition, so a row is as long as the conversation up to its target.
    """
    rows = df.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"),
                                         F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    talks = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    piece = lambda t: F.concat(F.lit(OPEN), _role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(CLOSE))
    talks = talks.select("conv_id", F.transform("turns", piece).alias("pieces"),
                         F.transform("turns", lambda t: t["role"] == target_role).alias("hits"))
    ends = F.filter(F.transform("hits", lambda hit, i: F.when(hit, i + 1)), lambda i: i.isNotNull())
    open_end = F.filter(F.array(F.size("pieces")), lambda n: ~F.element_at("hits", n))
    spots = talks.select("conv_id", "pieces", "hits", F.posexplode(F.concat(ends, open_end)).alias("k", "n"))
    head = len(OPEN) + len(target_role) + 1
    parts = spots.select(
        "conv_id", (F.col("k") + 1).cast("long").alias("example"), F.element_at("hits", F.col("n")).alias("hit"),
        F.array_join(F.slice("pieces", F.lit(1), F.col("n") - 1), "").alias("context"),
        F.element_at("pieces", F.col("n")).alias("last"))
    return parts.select(
        "conv_id", "example", F.concat("context", "last").alias("formatted"),
        F.when(F.col("hit"), F.length("context") + head).cast("long").alias("loss_start"),
        F.when(F.col("hit"), F.length("context") + F.length("last") - len(CLOSE)).cast("long").alias("loss_end"))


def read_back(examples: DataFrame) -> DataFrame:
    """What the examples say, parsed from `formatted` and the loss spans: one row per conversation."""
    target = F.substring(F.col("formatted"), F.col("loss_start").cast("int") + 1,
                         (F.col("loss_end") - F.col("loss_start")).cast("int"))
    found = examples.select("conv_id", "example", "formatted", unescape(target).alias("target"))
    per = found.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", F.coalesce("target", F.lit("")).alias("x")))),
                                 lambda s: s["x"]), "").alias("loss"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"))
    turns = F.filter(F.split("whole", CLOSE, -1), lambda x: x != "")
    body = lambda x: F.substring(x, len(OPEN) + 1, 2147483647)
    role = lambda x: unescape(F.replace(F.substring_index(x, "\n", 1), F.lit("\\3"), F.lit("\n")))
    text = lambda x: unescape(F.substring(x, F.locate("\n", x) + 1, F.lit(2147483647)))
    per = per.select("conv_id", "loss", "formatted_chars", F.transform(turns, body).alias("turns"))
    said = F.array_join(F.transform("turns", lambda x: F.concat(role(x), F.lit("\n"), text(x), F.lit("\n"))), "")
    return per.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                      F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
