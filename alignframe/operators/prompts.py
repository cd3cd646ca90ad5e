"""Prompt rendering and choice of the preferred response."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Prompt texts that a scored model was trained on.
NL_TO_FORMULA = (
    "### Instruction:\nTranslate the following natural language (NL) statement to a first-order logic (FOL)."
    "\n\n### NL:\n{NL}\n\n### FOL:\n"
)
CLAIM_TO_FORMULA = NL_TO_FORMULA.replace("{NL}", "{claim}")
PASSAGE_TO_FORMULA = (
    "### Instruction:\nPlease describe the core meaning of the passage using first-order logic (FOL)."
    "\n\n### Paragraph:\n{document}\n\n### FOL:\n"
)
ENGLISH_TO_GERMAN = "Translate the following English into German: {src}\n"
GERMAN_TO_ENGLISH = "Bitte übersetzen Sie das folgende Deutsche ins Englische: {src}\n"

CHAT_MARKUP = "<|{role}|>\n{content}\n"


def template_column(template: str, values: dict[str, Column]) -> Column:
    """A ``{name}`` template as one ``concat``; the template is split here, values are never expanded again."""
    parts: list[Column] = []
    for text, field, spec, conversion in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if field is None:
            continue
        if spec or conversion or field not in values:
            raise ValueError(f"unknown placeholder: {field!r}")
        parts.append(values[field].cast("string"))
    return F.concat(*parts) if parts else F.lit("")


def render_prompt(df: DataFrame, template: str, out: str = "prompt") -> DataFrame:
    return df.withColumn(out, template_column(template, {c: F.col(c) for c in df.columns}))


def pick_preferred(df: DataFrame) -> DataFrame:
    """Adds ``better_answer``, ``chosen`` and ``rejected``."""
    responses = F.array("response_0", "response_1")
    better = F.get(responses, F.col("better_response_id"))
    other = F.get(responses, F.lit(1) - F.col("better_response_id"))
    return df.withColumns({"better_answer": better, "chosen": better, "rejected": other})


def chat_text(messages: Column, add_generation_prompt: bool = True, markup: str = CHAT_MARKUP) -> Column:
    """One model-ready string. ``markup`` shapes a message; its part before the content opens the answer."""
    body = F.array_join(
        F.transform(
            messages, lambda m: template_column(markup, {"role": m["role"], "content": F.coalesce(m["content"], F.lit(""))})
        ),
        "",
    )
    if not add_generation_prompt:
        return body
    return F.concat(body, F.lit(markup.split("{content}")[0].replace("{role}", "assistant")))


def render_chat(df: DataFrame, messages: str, add_generation_prompt: bool = True, out: str = "prompt",
                markup: str = CHAT_MARKUP) -> DataFrame:
    return df.withColumn(out, chat_text(F.col(messages), add_generation_prompt, markup))


def user_message(content: Column) -> Column:
    """A conversation that consists of one user message."""
    return F.array(F.struct(F.lit("user").alias("role"), content.alias("content")))


def strip_known_suffix(df: DataFrame, text: str, suffix: str, out: str = "instruction") -> DataFrame:
    """The text without its last ``length(suffix)`` characters; an empty suffix leaves it whole."""
    kept = F.greatest(F.length(text) - F.length(suffix), F.lit(0))
    return df.withColumn(out, F.substring(F.col(text), F.lit(1), kept))
