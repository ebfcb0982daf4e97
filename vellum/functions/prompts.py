"""Prompts for the model boundary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X


def answer(context: Column, question: Column) -> Column:
    return F.concat(
        F.lit("Answer the question from the notes below. Say so if they do not hold the answer.\n\nNotes:\n"), context, F.lit("\n\nQuestion: "), question
    )


def plain(question: Column) -> Column:
    return F.concat(F.lit("Answer the question.\n\nQuestion: "), question)


def polish(text: Column) -> Column:
    return F.concat(F.lit("Improve the wording of this text and keep its meaning and Markdown.\n\n"), text)


def extend(text: Column) -> Column:
    return F.concat(F.lit("Continue this text in its own style.\n\n"), text)


def complete(prefix: Column, suffix: Column) -> Column:
    """Fill-in prompt: of the kept context, the last 500 and the first 200 characters."""
    before, after = X.tail(X.tail(prefix, 1000), 500), X.head(X.head(suffix, 200), 200)
    return F.concat(F.lit("Fill the gap with a short phrase.\nBefore: "), before, F.lit("\nAfter: "), after)
