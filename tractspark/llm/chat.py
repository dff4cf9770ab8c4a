r"""Chat formatting with Spark expressions only.

Turns are collected per conversation as structs, sorted, adjacent turns of one role are merged by array aggregation, and blocks are
concatenated. Template: `<s>role[TXT]text[CONT]text</s>` for each block, one text per turn. Control strings inside roles and texts are
escaped reversibly: backslashes are doubled, then a backslash is put after the first character of each control string. The loss mask is
an array of (start, length) spans over the formatted text, one for each assistant text.

Long conversations are collected in two steps, by chunks of turn numbers and then by conversation, with equal rows counted before.

Defined cases: null texts and roles are empty; turns sort by turn (null first), then role and text; repeated rows are turns of their
own; a null conv_id is a conversation of its own; an empty table gives no rows; further columns are ignored, whatever their names. Steps
are linear in a conversation's turns but for the positions, which go by the square root.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running_sums

#: Control strings of the template, and those of common templates that must not appear in a text either.
CONTROLS = ("<s>", "</s>", "[TXT]", "[CONT]", "[INST]", "[/INST]")
BEGIN, END, TEXT, MORE = CONTROLS[0], CONTROLS[1], CONTROLS[2], CONTROLS[3]
#: Turn numbers per chunk of the first collecting step.
CHUNK = 256


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    """Takes one backslash of a pair, and each that stands alone."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _merged(turns: Column, text_list: Callable[[Column], Column]) -> Column:
    """Array of blocks (role, texts): neighbours of one role become one; text_list gives the texts of such a run of turns."""
    places = F.sequence(F.lit(1), F.size(turns))
    role = lambda i: F.element_at(turns, i)["role"]
    firsts = F.filter(places, lambda i: (i == 1) | F.when(i > 1, role(i) != role(i - 1)))
    stops = F.concat(F.slice(firsts, F.lit(2), F.size(firsts)), F.array(F.size(turns) + 1))
    return F.zip_with(firsts, stops, lambda a, b: F.struct(role(a).alias("role"), text_list(F.slice(turns, a, b - a)).alias("texts")))


def collect_blocks(turns: DataFrame) -> DataFrame:
    """conv_id and blocks, an array of (role, texts) in order."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").cast("int").alias("copies"))
    part = rows.groupBy("conv_id", F.floor(F.col("turn") / CHUNK).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "copies"))).alias("own"))
    part = part.select("conv_id", "chunk", _merged(F.col("own"), lambda run: F.flatten(F.transform(run, lambda s: F.array_repeat(s["text"], s["copies"])))).alias("blocks"))
    whole = part.groupBy("conv_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "blocks"))), lambda p: p["blocks"])).alias("own"))
    return whole.select("conv_id", _merged(F.col("own"), lambda run: F.flatten(F.transform(run, lambda s: s["texts"]))).alias("blocks"))


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss (array of start, length in code points) for each conversation."""
    shown = F.transform("blocks", lambda b: F.struct(b["role"].alias("role"), escape(b["role"]).alias("shown"), F.transform(b["texts"], escape).alias("texts")))
    blocks = collect_blocks(turns).select("conv_id", shown.alias("blocks"))
    piece = lambda b: F.concat(F.lit(BEGIN), b["shown"], F.lit(TEXT), F.array_join(b["texts"], MORE), F.lit(END))
    # Each text with what stands before it: its block's head, or the mark between two texts; and the block's end behind its last one.
    head = lambda b: len(BEGIN) + F.length(b["shown"]) + len(TEXT)
    texts = F.flatten(F.transform("blocks", lambda b: F.transform(b["texts"], lambda t, i: F.struct(
        F.when(i == 0, head(b)).otherwise(len(MORE)).alias("before"), F.length(t).alias("length"), F.when(i == F.size(b["texts"]) - 1, len(END)).otherwise(0).alias("behind"), (b["role"] == loss_role).alias("counts")
    ))))
    placed = blocks.select("conv_id", "blocks", texts.alias("texts"))
    at = running_sums(F.transform("texts", lambda t: t["before"] + t["length"] + t["behind"]))
    spans = F.filter(F.zip_with(at, "texts", lambda a, t: F.struct((a + t["before"]).alias("start"), t["length"].alias("length"), t["counts"].alias("counts"))), lambda s: s["counts"])
    spans = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))
    return placed.select("conv_id", F.array_join(F.transform("blocks", piece), "").alias("formatted"), spans.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """From conv_id, formatted and loss: turns (array of role, text) and loss_text (unescaped text under the mask)."""
    blocks = F.filter(F.split("formatted", r"</s>", -1), lambda b: b.startswith(BEGIN))
    body = lambda b: F.substring(b, len(BEGIN) + 1, F.length(b))
    parts = lambda b: F.split(body(b), r"\[TXT\]", -1)
    turns = F.flatten(F.transform(blocks, lambda b: F.transform(F.split(parts(b)[1], r"\[CONT\]", -1), lambda t: F.struct(unescape(parts(b)[0]).alias("role"), unescape(t).alias("text")))))
    masked = F.array_join(F.transform("loss", lambda s: unescape(F.substring("formatted", s["start"] + 1, s["length"]))), "")
    return formatted.select("conv_id", "formatted", turns.alias("turns"), masked.alias("loss_text"))


def summary(turns: DataFrame) -> DataFrame:
    """Digests of what the formatted text gives back."""
    back = read_back(format_conversations(turns))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
