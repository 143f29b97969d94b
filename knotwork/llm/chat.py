"""Chat formatting of turns with typed content parts, as column expressions.

A turn is a role and an array of parts ``struct<kind, text, ref, units>``. Text parts are escaped
and written out; image, audio and document parts become numbered placeholders. The output keeps
the references of the attachments, the tokens they expand to, and a loss mask over the assistant's
texts. ``read_back`` undoes all of it from the formatted text alone.

    <|im_start|>role NEWLINE content <|im_end|> NEWLINE

Escaping is reversible: every ``<`` that stands before any number of backslashes and a bar gets one
backslash more, so no marker can begin inside a text; a role also has its line breaks and
backslashes escaped. Reading takes one backslash away again.

A conversation is one value of the result (its digest covers all turns), so its turns meet in one
row; they are gathered by one shuffle on the conversation.

Defined results: null texts, roles and parts are empty; an unknown kind of part is written as text;
turns that tie go by role and parts; repeated rows are repeated turns; a null conversation id is a
conversation; extra columns are left aside; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"
# Tokens that a placeholder stands for: one tile of an image, one second of audio, one page of a document.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 768}
PART = "struct<kind:string,text:string,ref:string,units:int>"


def text_part(text: Column) -> Column:
    """A turn's parts where all of its content is one text."""
    return F.array(
        F.struct(
            F.lit("text").alias("kind"),
            F.coalesce(text, F.lit("")).alias("text"),
            F.lit(None).cast("string").alias("ref"),
            F.lit(None).cast("int").alias("units"),
        )
    )


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # Pairs of backslashes are set aside as a character that escaping leaves alone only in front of 'b'.
    marked = F.replace(F.replace(role, F.lit("\x01"), F.lit("\x01a")), F.lit("\\\\"), F.lit("\x01b"))
    lines = F.replace(marked, F.lit("\\n"), F.lit("\n"))
    return unescape(F.replace(F.replace(lines, F.lit("\x01b"), F.lit("\\")), F.lit("\x01a"), F.lit("\x01")))


def _is_attachment(part: Column) -> Column:
    return F.coalesce(part["kind"].isin(*UNIT_TOKENS), F.lit(False))


def _unit_tokens(part: Column) -> Column:
    tokens = F.lit(0)
    for kind, each in UNIT_TOKENS.items():
        tokens = F.when(part["kind"] == kind, F.coalesce(part["units"], F.lit(1)) * each).otherwise(tokens)
    return tokens


def visit_part(turn: Column, place: Column, part: Column) -> Column:
    """What a part contributes to the formatted text."""
    holder = F.concat(F.lit("<|"), part["kind"], F.lit("_"), turn.cast("string"), F.lit("_"), place.cast("string"), F.lit("|>"))
    return F.when(_is_attachment(part), holder).otherwise(escape(F.coalesce(part["text"], F.lit(""))))


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, formatted, loss_mask, attachments, expanded_tokens from conv_id, turn, role, parts.

    ``loss_mask`` has (turn, start, length) for each assistant turn, in code points of that turn's
    own stretch of the formatted text.
    """
    kept = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.filter(F.coalesce("parts", F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull()).alias("parts"),
        ).alias("entry"),
    )
    gathered = kept.groupBy("conv_id").agg(F.sort_array(F.collect_list("entry")).alias("entries"))

    def content(entry: Column, i: Column) -> Column:
        return F.array_join(F.transform(entry["parts"], lambda p, j: visit_part(i, j, p)), "")

    def header(entry: Column) -> Column:
        return F.concat(F.lit(START), escape_role(entry["role"]), F.lit("\n"))

    pieces = gathered.withColumn(
        "pieces",
        F.transform(
            "entries",
            lambda e, i: F.struct(i.alias("turn"), (e["role"] == LOSS_ROLE).alias("loss"), header(e).alias("head"), content(e, i).alias("body")),
        ),
    )
    attachments = F.flatten(
        F.transform(
            "entries",
            lambda e, i: F.filter(
                F.transform(
                    e["parts"],
                    lambda p, j: F.struct(
                        i.alias("turn"), j.alias("place"), p["kind"].alias("kind"), p["ref"].alias("ref"), _unit_tokens(p).alias("tokens")
                    ),
                ),
                lambda a: F.coalesce(a["kind"].isin(*UNIT_TOKENS), F.lit(False)),
            ),
        )
    )
    mask = F.transform(
        F.filter("pieces", lambda p: p["loss"]),
        lambda p: F.struct(
            p["turn"].alias("turn"), F.char_length(p["head"]).alias("start"), F.char_length(p["body"]).alias("length")
        ),
    )
    return pieces.select(
        "conv_id",
        F.size("entries").cast("long").alias("n_turns"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END + "\n"))), "").alias("formatted"),
        mask.alias("loss_mask"),
        attachments.alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` with ``turns`` (role, text) and ``loss_text``, both taken from the formatted text."""
    stretches = F.filter(F.split("formatted", r"(?=<\|im_start\|>)"), lambda s: F.char_length(s) > 0)
    split = formatted.withColumn("_stretches", stretches)

    def turn(stretch: Column) -> Column:
        line = F.instr(stretch, F.lit("\n"))
        role = F.substring(stretch, F.lit(len(START) + 1), line - len(START) - 1)
        text = F.substring(stretch, line + 1, F.char_length(stretch) - line - len(END) - 1)
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    masked = F.transform(
        "loss_mask",
        lambda m: unescape(F.substring(F.get("_stretches", m["turn"]), m["start"] + 1, m["length"])),
    )
    return split.withColumn("turns", F.transform("_stretches", turn)).withColumn("loss_text", F.array_join(masked, "")).drop("_stretches")


def digest(formatted: DataFrame) -> DataFrame:
    """What the checked query returns for each conversation, read back from the formatted text."""
    told = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return read_back(formatted).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
