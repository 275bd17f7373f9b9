"""Prompt texts. The wording is fixed: trained models depend on it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prompt wording.
INSTRUCTION = (
    "Below is a situation you are in, paired with an input that provides current emotion "
    "and further context. Write an emotional and appropriate response.\n"
)
TOPIC_QUESTION = (
    "Analyze this conversation and describe in ONE CONCISE SENTENCE the topic being discussed.\n\n"
    "Examples:\n"
    "1. User won $200 on a lottery ticket.\n"
    "2. User got a nice haircut and shaved their beard.\n"
    "3. User's mom got them a new husky dog.\n\n"
    "Conversation:\n"
)
TOPIC_ANSWER = "\n\nSituation:"
END_OF_SEQUENCE = "</s>"


def section(title: str, body: Column) -> Column:
    return F.concat(F.lit(f"### {title}:\n"), body, F.lit("\n"))


def build_prompt(
    situation: Column,
    user: Column,
    emotion: Column | None = None,
    answer_type: Column | None = None,
    agent: Column | None = None,
    extra_turns: Column | None = None,
) -> Column:
    """The dialogue prompt.

    ``extra_turns`` is an array of ``struct<actor, message>``, oldest first. A
    null or empty emotion leaves its section out; the answer type is ``long``
    unless given.
    """
    nothing = F.lit("")
    parts = [F.lit(INSTRUCTION), section("Situation", F.coalesce(situation, nothing))]
    if emotion is not None:
        parts.append(F.when(F.length(emotion) > 0, section("Emotion", emotion)).otherwise(nothing))
    if extra_turns is not None:
        lines = F.transform(
            extra_turns,
            lambda t: F.concat(F.lit("### "), t["actor"], F.lit(":\n"), t["message"], F.lit("\n")),
        )
        parts.append(F.coalesce(F.array_join(lines, ""), nothing))
    kind = F.lit("long") if answer_type is None else answer_type
    parts += [section("User", user), section("Answer Type", kind), F.lit("### You:\n")]
    if agent is not None:
        parts.append(F.coalesce(agent, nothing))
    return F.concat(*parts)


def training_text(
    situation: Column,
    user: Column,
    emotion: Column,
    answer_type: Column,
    agent: Column,
    end_of_sequence: str = END_OF_SEQUENCE,
) -> Column:
    """Prompt, answer and end mark: one training example."""
    prompt = build_prompt(situation, user, emotion, answer_type, agent)
    return F.concat(prompt, F.lit(end_of_sequence))


def eval_prompt(situation: Column, user: Column, emotion: Column) -> Column:
    """The prompt models are scored on: no answer, always answer type ``long``."""
    return build_prompt(situation, user, emotion)


def render_messages(messages: Column) -> Column:
    """``ACTOR: message`` lines from an ordered array of ``struct<actor, message>``."""
    lines = F.transform(messages, lambda m: F.concat(F.upper(m["actor"]), F.lit(": "), m["message"]))
    return F.array_join(lines, "\n")


def topic_prompt(conversation: Column) -> Column:
    return F.concat(F.lit(TOPIC_QUESTION), conversation, F.lit(TOPIC_ANSWER))
