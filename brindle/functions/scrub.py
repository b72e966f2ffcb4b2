"""Personal data in passages on their way into a store: typed placeholders by patterns, names and places by a plug-in.

Patterns are applied in a fixed order, each to what the ones before have left.
A model for names and places is a callable (texts -> texts and types) that runs
in batches; without one those two types are not looked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import header_line, without_header

#: Type, placeholder, pattern; in the order of application.
PATTERNS = [
    ("URL", "[URL]", r"https?://[^\s<>\"]+"),
    ("EMAIL_ADDRESS", "[EMAIL]", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("IBAN_CODE", "[IBAN]", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("CREDIT_CARD", "[CREDIT_CARD]", r"\b\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{3,4}\b"),
    ("US_SSN", "[SSN]", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("IP_ADDRESS", "[IP_ADDRESS]", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"),
    ("PHONE_NUMBER", "[PHONE]", r"\+\d{1,3}[ .(-]{0,2}\d{1,4}[ .)-]{0,2}\d{2,4}(?:[ .-]?\d{2,4}){1,3}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\b\d{3}[.-]\d{3}[.-]\d{4}\b"),
]


def scrubbed(text: Column | str) -> Column:
    """Struct of the text with placeholders and the sorted types found; a null text stays null and has no types."""
    t = F.col(text) if isinstance(text, str) else text
    found = []
    for kind, sign, pattern in PATTERNS:
        found.append(F.when(t.rlike(pattern), F.lit(kind)))
        t = F.regexp_replace(t, pattern, sign)
    return F.struct(t.alias("text"), F.array_sort(F.array_compact(F.array(*found))).alias("types"))


def named(text: Column | str, make: Callable[[], Callable[[list[str]], list[tuple[str, list[str]]]]]) -> Column:
    """As scrubbed, by a model that is made once per task."""

    @F.pandas_udf("text string, types array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = make()
        for texts in batches:
            out = model([t if isinstance(t, str) else "" for t in texts])
            yield pd.DataFrame({"text": [a if isinstance(t, str) else None for (a, _), t in zip(out, texts)], "types": [sorted(set(b)) for _, b in out]})

    return run(text)


def scrubbed_passage(text: Column | str, chunk_type: Column | str) -> list[Column]:
    """text, pii_detected, pii_types_found, image_may_contain_pii of a passage; its bracketed first line stays, and what a figure's image holds can't be told."""
    body = scrubbed(without_header(text))
    kind = F.col(chunk_type) if isinstance(chunk_type, str) else chunk_type
    return [F.concat(header_line(text), body["text"]).alias("text"), (F.size(body["types"]) > 0).alias("pii_detected"), F.array_join(body["types"], ", ").alias("pii_types_found"), F.coalesce(kind == "figure", F.lit(False)).alias("image_may_contain_pii")]
