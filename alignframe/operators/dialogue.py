"""Transcripts with ``Human:`` and ``Assistant:`` markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alignframe.functions.text import let, strip
from alignframe.operators.prompts import chat_text

_MESSAGES = "array<struct<role:string,content:string>>"


def _all_messages(text: Column) -> Column:
    """``struct(lead, messages)``: text before the first marker, then every non-blank turn."""
    turn = lambda t: F.struct(
        F.when(t.startswith("Human:"), "user").otherwise("assistant").alias("role"),
        strip(F.regexp_replace(t, r"^(?:Human:|Assistant:)", "")).alias("content"),
    )
    marked = lambda t: t.startswith("Human:") | t.startswith("Assistant:")
    return let(
        F.split(text, "(?=Human:|Assistant:)"),
        lambda pieces: F.struct(
            F.when(~marked(F.get(pieces, F.lit(0))), strip(F.get(pieces, F.lit(0)))).otherwise("").alias("lead"),
            F.filter(
                F.transform(F.filter(pieces, marked), turn), lambda m: m["content"] != F.lit("")
            ).cast(_MESSAGES).alias("messages"),
        ),
    )


def _without_last(messages: Column) -> Column:
    return F.slice(messages, F.lit(1), F.greatest(F.size(messages) - 1, F.lit(0)))


def parse_transcript(df: DataFrame, column: str, with_label: bool = False) -> DataFrame:
    """Adds ``messages`` and ``malformed`` (text before the first marker, or no turn at all).

    Unless ``with_label``, a closing assistant turn is dropped: it is what a model is to produce.
    """
    parsed = df.withColumn("_parsed", _all_messages(F.col(column)))
    found = F.col("_parsed.messages")
    if not with_label:
        last = F.get(found, F.size(found) - 1)["role"]
        found = F.when(last == "assistant", _without_last(found)).otherwise(found)
    bad = (F.col("_parsed.lead") != "") | (F.size("_parsed.messages") == 0)
    return parsed.withColumns({"messages": found, "malformed": bad}).drop("_parsed")


def split_last_turn(df: DataFrame, column: str) -> DataFrame:
    """Adds ``instruction`` and ``target``, split at the last marker; without one the target is empty."""
    text = strip(column)
    target = F.substring_index(text, "Assistant:", -1)
    head = F.substring(text, F.lit(1), F.length(text) - F.length(target) - F.lit(len("Assistant:")))
    marked = F.contains(text, F.lit("Assistant:"))
    return df.withColumns(
        {
            "instruction": F.when(marked, strip(head)).otherwise(text),
            "target": F.when(marked, strip(target)).otherwise(F.lit("")),
        }
    )


def instruction_column(text: Column) -> Column:
    """Text before the last of at least two assistant markers, otherwise the whole text."""
    several = F.regexp_count(text, F.lit(r"(?U)\bAssistant:")) >= 2
    head = F.regexp_extract(text, r"(?Us)^(.*)\bAssistant:", 1)
    return strip(F.when(several, head).otherwise(text))


def last_answer_column(text: Column) -> Column:
    """The last assistant span, up to a line that opens with the human marker or to the end."""
    spans = F.regexp_extract_all(text, F.lit(r"(?Us)Assistant:\s*(.*?)(?=\nHuman:|$)"), F.lit(1))
    return strip(F.coalesce(F.try_element_at(spans, F.lit(-1)), F.lit("")))


def extract_instruction(df: DataFrame, column: str, out: str = "instruction") -> DataFrame:
    return df.withColumn(out, instruction_column(F.col(column)))


def extract_last_answer(df: DataFrame, column: str, out: str = "answer") -> DataFrame:
    return df.withColumn(out, last_answer_column(F.col(column)))


def preference_triples(df: DataFrame) -> DataFrame:
    """``prompt, chosen, rejected`` from paired transcripts; other columns stay."""
    return df.withColumns(
        {
            "prompt": instruction_column(F.col("chosen")),
            "chosen": last_answer_column(F.col("chosen")),
            "rejected": last_answer_column(F.col("rejected")),
        }
    )


def paired_messages(df: DataFrame) -> DataFrame:
    """Adds ``message_instruction, message_chosen, message_rejected`` and ``malformed``."""
    parsed = df.withColumns(
        {"_c": _all_messages(F.col("chosen")), "_r": _all_messages(F.col("rejected"))}
    )
    bad = lambda c: (F.col(f"{c}.lead") != "") | (F.size(f"{c}.messages") == 0)
    return parsed.withColumns(
        {
            "message_instruction": _without_last(F.col("_c.messages")),
            "message_chosen": F.col("_c.messages"),
            "message_rejected": F.col("_r.messages"),
            "malformed": bad("_c") | bad("_r"),
        }
    ).drop("_c", "_r")


def label_pairs(df: DataFrame) -> DataFrame:
    """Adds ``prompt`` (all but the last message, as chat text) and ``better_answer`` (the last message)."""
    parsed = df.withColumn("_c", _all_messages(F.col("chosen")))
    messages = F.col("_c.messages")
    return parsed.withColumns(
        {
            "prompt": chat_text(_without_last(messages), add_generation_prompt=True),
            "better_answer": F.get(messages, F.size(messages) - 1)["content"],
            "malformed": (F.col("_c.lead") != "") | (F.size(messages) == 0),
        }
    ).drop("_c")
