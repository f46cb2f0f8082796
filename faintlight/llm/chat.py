"""Chat formatting by multi-party perspective rotation (operator 5), with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faintlight.llm.mixing import running_totals

PER_PART = 128
TURN_BUCKET = 1024
SYSTEM = ("system",)
END = "<|end|>\n"


def clean(text: Column) -> Column:
    """The text without strings that could be taken for the start of a marker."""
    return F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("<|"), F.lit("< |"))


def clean_name(name: Column) -> Column:
    """The name without line breaks and without strings that could be taken for either end of a marker."""
    return F.replace(F.replace(F.regexp_replace(name.cast("string"), r"[\r\n]+", " "), F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))


def perspectives(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    system_roles: tuple[str, ...] = SYSTEM, per_part: int = PER_PART,
) -> DataFrame:
    """Every dialogue as seen by each of its participants: (conv_id, speaker, part, n_turns, text, mask_start, mask_length).

    In a speaker's rendering its own turns are the assistant's, all others are users with their names; system turns
    stay system turns and are nobody's perspective. The masks hold start and length in characters of what is to be
    learned: the assistant's texts with their end markers. Dialogues come in parts of at most `per_part` turns, part 0,
    1, 2 ...; together they hold every turn, so that no group is larger than a part.

    Turns stand in order of turn (null first), role and text; repeated turns are all kept. A null text is empty, a null
    role is the unnamed user "?", which has no perspective. Turns without a conversation belong to no dialogue and
    are left out, as are dialogues in which nobody but the system speaks. "<|" in texts and names becomes "< |", and in
    names "|>" becomes "| >" and a line break a blank, so that nothing can pose as a marker. Other columns are ignored.
    """
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.col(role_col).cast("string").alias("role"),
        clean(F.col(text_col)).alias("text"),
    )
    rows = rows.withColumn("bucket", F.floor(F.col("turn") / TURN_BUCKET)).withColumn("one", F.lit(1).cast("long"))
    rows = running_totals(rows, ["conv_id"], "bucket", ["turn", "role", "text"], "one", "place")
    parts = (
        rows.withColumn("part", F.floor((F.col("place") - 1) / per_part).cast("int"))
        .groupBy("conv_id", "part")
        .agg(F.sort_array(F.collect_list(F.struct("place", "role", "text"))).alias("turns"))
    )
    speakers = (
        rows.where(F.col("role").isNotNull() & ~F.col("role").isin(*system_roles))
        .select(F.col("conv_id").alias("__conv"), F.col("role").alias("speaker"))
        .distinct()
    )
    seen = parts.join(speakers, F.col("conv_id") == F.col("__conv")).drop("__conv")

    def one(t: Column) -> Column:
        own = F.coalesce(t["role"] == F.col("speaker"), F.lit(False))
        head = (
            F.when(own, F.lit("<|assistant|>\n"))
            .when(t["role"].isin(*system_roles), F.lit("<|system|>\n"))
            .otherwise(F.concat(F.lit("<|user:"), F.coalesce(clean_name(t["role"]), F.lit("?")), F.lit("|>\n")))
        )
        body = F.concat(t["text"], F.lit(END))
        return F.struct(own.alias("own"), head.alias("head"), body.alias("body"))

    seen = seen.withColumn("pieces", F.transform("turns", one))
    spans = F.aggregate(
        "pieces",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["head"]) + F.length(p["body"])).alias("at"),
            F.when(
                p["own"],
                F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length")))),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return seen.select(
        "conv_id",
        "speaker",
        "part",
        F.size("turns").alias("n_turns"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "").alias("text"),
        F.transform(spans, lambda x: x["start"]).alias("mask_start"),
        F.transform(spans, lambda x: x["length"]).alias("mask_length"),
    )
