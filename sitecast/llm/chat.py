"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: the formatted turns before it are context,
its text alone is trainable. The span of the trainable text is kept in characters, so a loss
mask can be laid over the formatted string without parsing it.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    """No control string survives: every `<|` and every backslash becomes an escape."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\b"))
    return F.replace(doubled, F.lit("<|"), F.lit("<\\p"))


def unescape(text: Column) -> Column:
    """Inverse of `escape`; every backslash of an escaped text starts an escape."""
    opened = F.replace(text, F.lit("<\\p"), F.lit("<|"))
    return F.replace(opened, F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    """As `escape`, without line ends: the role is the first line of a turn."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def _header(turn: Column) -> Column:
    return F.concat(F.lit(START), escape_role(turn["role"]), F.lit("\n"))


def _formatted(turn: Column) -> Column:
    return F.concat(_header(turn), escape(turn["text"]), F.lit(END))


def expand_replies(conversations: DataFrame) -> DataFrame:
    """One row per example: conv_id, example, formatted, target_start, target_end.

    `conversations` holds conv_id, turn, role and text; other columns are left out. Turns are
    ordered by turn (NULL first), then role and text, so ties and repeated rows have one
    defined order; repeated rows are turns of their own. NULL roles and texts are empty; rows
    whose conv_id is NULL form one conversation. The target span counts characters from 0 and
    its end is exclusive. Turns after the last reply belong to no reply: they end a last
    example whose span is empty, so that every turn can be read back. An empty table gives no
    examples. A conversation has to fit into a row, as its longest example does anyway.
    """
    turn = F.struct(
        F.col("turn").isNotNull().alias("known"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    gathered = conversations.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(turn)).alias("turns")
    )
    pieces = gathered.withColumn("pieces", F.transform("turns", _formatted))
    last = F.size("turns") - 1
    ends = F.filter(
        F.sequence(F.lit(0), last),
        lambda i: (F.get("turns", i)["role"] == TRAINED_ROLE) | (i == last),
    )
    examples = pieces.select(
        "conv_id", "turns", "pieces", F.posexplode(ends).alias("example", "at")
    )
    target = F.get("turns", F.col("at"))
    before = F.array_join(F.slice("pieces", F.lit(1), F.col("at")), "")
    trained = target["role"] == TRAINED_ROLE
    text_start = F.length(before) + F.length(_header(target))
    formatted = F.array_join(F.slice("pieces", F.lit(1), F.col("at") + 1), "")
    start = F.when(trained, text_start).otherwise(F.length(formatted))
    length = F.when(trained, F.length(escape(target["text"]))).otherwise(0)
    return examples.select(
        "conv_id",
        "example",
        formatted.alias("formatted"),
        start.cast("long").alias("target_start"),
        (start + length).cast("long").alias("target_end"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted string as an array of (role, text)."""
    pieces = F.split(formatted, END.replace("|", r"\|"))
    turns = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def parsed(piece: Column) -> Column:
        body = F.substring(piece, F.lit(len(START) + 1), F.length(piece))
        role = F.substring_index(body, "\n", 1)
        text = F.substring(body, F.length(role) + 2, F.length(body))
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    return F.transform(turns, parsed)


def target_text(formatted: Column, start: Column, end: Column) -> Column:
    """The unescaped text under the loss mask of an example."""
    return unescape(F.substring(formatted, start.cast("int") + 1, (end - start).cast("int")))


def conversation_digests(examples: DataFrame) -> DataFrame:
    """Per conversation, from its examples alone: turns, trainable text, formatted characters."""
    loss = F.struct("example", target_text(F.col("formatted"), F.col("target_start"), F.col("target_end")).alias("text"))
    read = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"),
        F.sort_array(F.collect_list(loss)).alias("losses"),
        F.sum(F.length("formatted").cast("long")).alias("formatted_chars"),
    )
    turns = read.select(
        "conv_id",
        read_turns(F.col("longest")).alias("turns"),
        F.array_join("losses.text", "").alias("loss"),
        "formatted_chars",
    )
    line = F.transform(
        "turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    )
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
