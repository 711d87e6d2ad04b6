r"""Chat formatting by prefix-target expansion.

Every assistant turn of a conversation becomes an example of its own: all turns before it as context, and only that
turn's text trainable. A conversation that does not end with an assistant turn also gives one example without a
trainable part, so that all turns can be read back.

The template writes a turn as ``<|im_start|>role<|im_sep|>text<|im_end|>`` and a newline. Inside roles and texts a
backslash becomes two and ``<|`` becomes ``<\|``, so no control string can occur there, and the change is undone by
dropping the first of every backslash pair.

Null texts and roles are empty. Turns with equal numbers are ordered by role and text, null numbers come first, and
repeated rows are turns of their own. An empty table gives no examples. Only the four named columns are read. A very long
text is kept whole; a conversation is one row before it is expanded, and n turns give up to n prefixes of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
SCHEMA = "conv_id long, example int, n_turns int, formatted string, loss_start long, loss_end long"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def expand(turns: DataFrame) -> DataFrame:
    """Examples of conversations: ``conv_id``, ``example`` (from 1), ``n_turns`` (of the context and the target),
    ``formatted`` and the trainable characters from ``loss_start`` to before ``loss_end`` (null: none)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    body = escape(text)
    turn = F.struct(
        "turn", role.alias("role"), text.alias("text"),
        F.concat(F.lit(START), escape(role), F.lit(SEP), body, F.lit(END)).alias("written"),
        F.char_length(body).alias("size"),
    )
    convs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    targets = F.filter(F.transform("t", lambda x, i: F.when((x["role"] == "assistant") | (i == F.size("t") - 1), i + 1)), lambda i: i.isNotNull())
    each = convs.select("conv_id", "t", F.posexplode(targets).alias("p", "n"))
    last = F.element_at("t", F.col("n"))
    written = F.array_join(F.transform(F.slice("t", 1, F.col("n")), lambda x: x["written"]), "")
    trained = last["role"] == "assistant"
    each = each.select("conv_id", (F.col("p") + 1).alias("example"), F.col("n").alias("n_turns"), written.alias("formatted"), last["size"].alias("size"), trained.alias("trained"))
    end = F.char_length("formatted") - len(END)
    return each.select(
        "conv_id", "example", "n_turns", "formatted",
        F.when(F.col("trained"), (end - F.col("size")).cast("long")).alias("loss_start"),
        F.when(F.col("trained"), end.cast("long")).alias("loss_end"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted text, as an array of structs of role and text."""
    parts = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, F.greatest(F.size(F.split(formatted, r"<\|im_start\|>")) - 1, F.lit(0)))

    def turn(part: Column) -> Column:
        role = F.substring_index(part, SEP, 1)
        begin = F.char_length(role) + len(SEP) + 1
        text = F.substring(part, begin, F.char_length(part) - begin + 1 - len(END))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, turn)


def trained_text(df: DataFrame) -> Column:
    """The text under an example's loss mask; null where nothing is trained."""
    return unescape(F.substring(df["formatted"], (df["loss_start"] + 1).cast("int"), (df["loss_end"] - df["loss_start"]).cast("int")))


def contract(examples: DataFrame) -> DataFrame:
    """Digests of each conversation, from its examples as read back."""
    rows = examples.select("conv_id", "example", "n_turns", "formatted", trained_text(examples).alias("trained"))
    learned = F.transform(F.sort_array(F.collect_list(F.when(F.col("trained").isNotNull(), F.struct("example", "trained")))), lambda x: x["trained"])
    convs = rows.groupBy("conv_id").agg(
        F.max_by("formatted", "n_turns").alias("longest"),
        F.array_join(learned, "").alias("learned"),
        F.sum(F.char_length("formatted")).cast("long").alias("formatted_chars"),
    )
    convs = convs.withColumn("turns", parse(F.col("longest")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return convs.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars",
    )
