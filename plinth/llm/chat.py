"""Chat formatting with Spark expressions only.

Template: `<|im_start|>role\ntext<|im_end|>\n` for each turn. Adjacent rows of
one role are merged into one turn whose rows are parted by `<|im_row|>`, so
the rows can be read back. Inside roles and texts, each `<`, run of `\\`, `|`
gets one more backslash; reading back takes it away, so control strings in a
text never look like markup and the round trip is exact.

Rows are ordered by (turn, role, text); a null turn sorts first, a null text
or role is empty, repeated rows are all kept, and a null conv_id is a
conversation of its own. An empty table gives an empty result. Rows are first
merged in runs of `span` turns, and no more than `span` rows whatever their
turns, and the runs are then joined; so one very long conversation is built in
parallel and no string is copied once for each turn. Other columns than the
four are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, ROW = "<|im_start|>", "<|im_end|>\n", "<|im_row|>"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    """As `escape`; a line break in a role, which would end the role's line, becomes `<\\n|`."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<n|"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<n|"), F.lit("\n")))


def _merge(turns: Column, struct: str) -> Column:
    """Merge neighbours of one role in a sorted array of struct(role, text)."""

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        same = (F.size(acc) > 0) & (last["role"] == x["role"])
        joined = F.struct(x["role"].alias("role"), F.concat(last["text"], F.lit(ROW), x["text"]).alias("text"))
        return F.when(same, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(turns, F.array().cast(struct), step)


def format_chats(rows: DataFrame, span: int = 64) -> DataFrame:
    """conv_id and `formatted`; `rows` has conv_id, turn, role, text."""
    kind = "array<struct<role:string,text:string>>"
    clean = rows.select(
        "conv_id",
        F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / span).alias("_span"),
        F.struct(
            F.col("turn").alias("turn"),
            escape_role(F.coalesce(F.col("role"), F.lit(""))).alias("role"),
            escape(F.coalesce(F.col("text"), F.lit(""))).alias("text"),
        ).alias("_row"),
    )
    runs = clean.groupBy("conv_id", "_span").agg(F.array_sort(F.collect_list("_row")).alias("_rows"))
    plain = F.transform("_rows", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    runs = runs.select("conv_id", "_span", plain.alias("_plain"))
    few = F.transform(F.sequence(F.lit(1), F.size("_plain"), F.lit(span)), lambda i: F.struct(_merge(F.slice("_plain", i, span), kind).alias("turns")))
    runs = runs.select("conv_id", F.struct("_span", few.alias("runs")).alias("_run"))
    whole = runs.groupBy("conv_id").agg(F.array_sort(F.collect_list("_run")).alias("_all"))
    whole = whole.select("conv_id", F.flatten(F.transform("_all", lambda x: x["runs"])).alias("_runs"))

    def piece(x: Column) -> Column:
        return F.concat(F.lit(START), x["role"], F.lit("\n"), x["text"], F.lit(END))

    # Where a run goes on with the role the last one ended with, the two turns are one.
    def link(x: Column, i: Column) -> Column:
        first, before = F.element_at(x["turns"], 1), F.element_at(F.get("_runs", i - 1)["turns"], -1)
        body = F.array_join(F.transform(x["turns"], piece), "")
        head = F.length(F.concat(F.lit(START), first["role"], F.lit("\n")))
        follows = (i > 0) & (before["role"] == first["role"])
        return F.struct(
            F.when(follows, F.concat(F.lit(ROW), F.substring(body, head + 1, F.length(body)))).otherwise(body).alias("body"),
            follows.alias("follows"),
        )

    linked = F.transform("_runs", link)
    with_links = whole.select("conv_id", linked.alias("_bodies"))
    trimmed = F.transform(
        "_bodies",
        lambda x, i: F.when(
            F.coalesce(F.get("_bodies", i + 1)["follows"], F.lit(False)),
            F.substring(x["body"], F.lit(1), F.length(x["body"]) - len(END)),
        ).otherwise(x["body"]),
    )
    return with_links.select("conv_id", F.array_join(trimmed, "").alias("formatted"))


def loss_segments(formatted: Column) -> Column:
    """The output cut into array<struct<text, is_loss>>; the texts concatenate to the output.

    The loss mask covers each assistant text, still escaped, and nothing else.
    Markup can't occur inside escaped text, so the cuts are exact.
    """
    turns = F.filter(F.split(formatted, r"(?<=<\|im_end\|>\n)"), lambda x: x != "")

    def parts(turn: Column) -> Column:
        head = F.instr(turn, "\n")
        is_loss = F.substring(turn, F.lit(1), head) == START + ASSISTANT + "\n"
        rows = F.split(F.substring(turn, head + 1, F.length(turn) - head - len(END)), r"((?<=<\|im_row\|>)|(?=<\|im_row\|>))")
        body = F.transform(rows, lambda x: F.struct(x.alias("text"), (is_loss & (x != ROW)).alias("is_loss")))
        mark = lambda x: F.array(F.struct(x.alias("text"), F.lit(False).alias("is_loss")))
        return F.concat(mark(F.substring(turn, F.lit(1), head)), body, mark(F.lit(END)))

    return F.flatten(F.transform(turns, parts))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of the rows in the output, unescaped."""
    turns = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda x: x != "")

    def rows(turn: Column) -> Column:
        head = F.instr(turn, "\n")
        role = unescape_role(F.substring(turn, F.lit(len(START) + 1), head - len(START) - 1))
        texts = F.split(F.substring(turn, head + 1, F.length(turn)), r"<\|im_row\|>", -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(turns, rows))


def digest(formatted: DataFrame) -> DataFrame:
    """Row counts, digests and loss figures, read back from `formatted` alone."""
    rows = formatted.select("conv_id", "formatted", read_back(F.col("formatted")).alias("_rows"), loss_segments(F.col("formatted")).alias("_segments"))
    said = F.array_join(F.transform("_rows", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    masked = F.transform(F.filter("_segments", lambda x: x["is_loss"]), lambda x: unescape(x["text"]))
    out = rows.select("conv_id", F.size("_rows").cast("long").alias("n_turns"), said.alias("_said"), F.array_join(masked, "").alias("_loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return out.select(
        "conv_id",
        "n_turns",
        F.sha2("_said", 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
