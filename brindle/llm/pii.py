"""Problem 1: personal information in free text.

Method: a linear-chain conditional random field over word shapes (crf.py),
trained from a small labelled table (pii_table.py, about 11,000 rows made by a
rule, with carriers and names written for it alone), decoded by Viterbi's
algorithm in numpy batches. Names of a directory of staff are a feature, not a
condition: names that are not in it are found by shape and surroundings. Of the
marked parts those are dropped that can't be of their type (a mail address
without any sign for "at", a phone number of under seven digits, a number of
papers that are not named before it, and so on).

Defined results: null and blank texts have no part; texts are handled whole, of
any length; a bracketed first line of a chunk and typed placeholders are left as
they are; equal rows each count; adjoining parts of one type are one part.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import crf, pii_table

TYPES = ["EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "PERSON"]
#: The project's own names of the types, as in chunks.pii_types_found.
PROJECT_NAMES = {"EMAIL": "EMAIL_ADDRESS", "PHONE": "PHONE_NUMBER", "ID_NUMBER": "US_SSN", "ADDRESS": "LOCATION", "PERSON": "PERSON"}
#: The staff directory is a fixed table; up to this many names go to the tasks as a feature.
MOST_NAMES = 100_000

_AT = re.compile(r"@|[(\[{]\s*at\s*[)\]}]|\bat\b", re.I)
_DOT = re.compile(r"[\w-]\s*(?:\.|[(\[{]\s*dot\s*[)\]}]|\bdot\b)\s*[\w-]", re.I)
_PAPER = re.compile(r"(?i)(?<![^\W_])(?:" + "|".join(re.escape(w) for words in pii_table.ID_WORDS.values() for w in words) + r"|identity|personal number|insurance)(?![^\W_])")
_NAMED = re.compile(_PAPER.pattern + r"(?i:\s*(?:no|number|nr|card|is|was|:|=|#|\.))*\s*$")
_SSN = re.compile(r"\d{3}-\d{2}-\d{4}")
_PLACEHOLDER = re.compile(r"\[(?:EMAIL|PHONE|ID_NUMBER|ADDRESS|PERSON|EMAIL_ADDRESS|PHONE_NUMBER|US_SSN|LOCATION|IP_ADDRESS|CREDIT_CARD|NAME)\]")
_PARTICLES = {"de", "da", "di", "del", "la", "le", "van", "von", "der", "den", "zu", "y", "e", "dos", "bin", "al"}
_HEADER = r"\A\[[^\]\n]*\]\n"


def plausible(kind: str, text: str, names: frozenset = frozenset()) -> bool:
    digits = sum(c.isdigit() for c in text)
    if kind == "EMAIL":
        return bool(_AT.search(text)) and bool(_DOT.search(text))
    if kind == "PHONE":
        return digits >= 7
    if kind == "ID_NUMBER":
        return digits >= 5
    if kind == "ADDRESS":
        return digits >= 1 and any(len(w) > 2 for w in re.findall(r"[^\W\d_]+", text))
    words = re.findall(r"[^\W\d_]+", text)
    if digits or len(words) < 2 or not any(len(w) > 2 for w in words):
        return False
    long = [w for w in words if len(w) > 1]
    small = [w for w in long if w.islower() and w not in _PARTICLES]
    if small and (len(small) < len(long) or not all(w in names or len(w) < 3 or w in crf.TITLES for w in small)):
        return False  # a name without capitals is taken for one only where the directory has it
    # of one-letter words a name has initials alone: with a stop, or capital
    return all(len(w) > 1 or w.isupper() or f"{w}." in text for w in words) and (len(words) > 2 or all(len(w) > 1 or f"{w}." in text for w in words))


@functools.lru_cache(maxsize=4)
def trained(given: frozenset, family: frozenset) -> crf.Crf:
    """The model for a directory of names; the same for the same names."""
    listed = [frozenset(x for n in names for x in re.findall(r"[^\W\d_]+", n.lower())) for names in pii_table.LISTED]
    model = crf.Crf(["O", *TYPES])
    rows = []
    for parts in pii_table.labelled_table():
        toks: list[str] = []
        labels: list[int] = []
        text = "".join(p for p, _ in parts)
        spans = crf.spans_of(text)
        ends, at = [], 0
        for p, kind in parts:
            ends.append((at, at + len(p), TYPES.index(kind) + 1 if kind else 0))
            at += len(p)
        i = 0
        for a, z in spans:
            while i + 1 < len(ends) and a >= ends[i][1]:
                i += 1
            labels.append(ends[i][2])
        toks = crf.tokens(text)
        rows.append((toks, labels))
    model.fit(rows, *listed, frozenset(pii_table.ODD))
    return model


def parts_of(texts: list[str], tagger: crf.Tagger) -> Iterator[tuple[int, list[tuple[str, int, int]]]]:
    """(index, [(type, start, end)]) of the texts with any part."""
    names = tagger.given | tagger.family
    for i, labels in tagger.tag(texts):
        text = texts[i]
        spans = crf.spans_of(text)
        masked = [m.span() for m in _PLACEHOLDER.finditer(text)] if "[" in text else []
        out, k = [], 0
        while k < len(labels):
            kind = labels[k]
            if not kind:
                k += 1
                continue
            j = k
            while j + 1 < len(labels) and labels[j + 1] == kind:
                j += 1
            a, z = spans[k][0], spans[j][1]
            k = j + 1
            if TYPES[kind - 1] == "EMAIL" and "@" in text[a:z]:  # an address with its sign is one word
                while a > 0 and (text[a - 1].isalnum() or text[a - 1] in "._%+-"):
                    a -= 1
                while z < len(text) and (text[z].isalnum() or text[z] in "-_" or text[z] == "." and text[z + 1 : z + 2].isalnum()):
                    z += 1
            if TYPES[kind - 1] == "PHONE" and _NAMED.search(text[max(0, a - 40) : a]):
                kind = TYPES.index("ID_NUMBER") + 1  # the paper is named right before it
            if TYPES[kind - 1] == "ID_NUMBER" and not _PAPER.search(text, max(0, a - 40), z) and not _SSN.fullmatch(text[a:z].strip()):
                continue  # what paper it is the number of must be said
            if not any(a < y and x < z for x, y in masked) and plausible(TYPES[kind - 1], text[a:z], names):
                out.append((TYPES[kind - 1], a, z))
        if out:
            yield i, out


def names_of(staff: DataFrame, given: str = "given_name", family: str = "family_name") -> tuple[frozenset, frozenset]:
    rows = staff.select(F.lower(given).alias("g"), F.lower(family).alias("f")).distinct().limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"the directory has over {MOST_NAMES} names")
    split = lambda xs: frozenset(w for x in xs if x for w in re.findall(r"[^\W\d_]+", x))
    return split(r["g"] for r in rows), split(r["f"] for r in rows)


class Finder:
    """What the tasks get: the model and the directory."""

    def __init__(self, staff: DataFrame):
        self.given, self.family = names_of(staff)
        self.model = trained(self.given, self.family)

    def types(self, df: DataFrame, keys: list[str], text: Column) -> DataFrame:
        """keys and pii_type: one row per type in each row's text."""
        kinds = dict(df.dtypes)
        model, given, family = self.model, self.given, self.family

        def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tagger = crf.Tagger(model, given, family)
            for pdf in batches:
                where, types = [], []
                for i, parts in parts_of(pdf["__text"].tolist(), tagger):
                    for kind in {k for k, _, _ in parts}:
                        where.append(i)
                        types.append(kind)
                if where:
                    yield pdf[keys].iloc[where].reset_index(drop=True).assign(pii_type=types)

        rows = df.select(*keys, text.alias("__text")).where(F.col("__text").isNotNull() & (F.col("__text") != ""))
        return rows.mapInPandas(find, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", pii_type string")

    def redacted(self, text: Column) -> Column:
        """Struct of the text with typed placeholders and the sorted types found."""
        model, given, family = self.model, self.given, self.family

        @F.pandas_udf("text string, types array<string>")
        def redact(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            tagger = crf.Tagger(model, given, family)
            for texts in batches:
                whole = texts.tolist()
                filled = [t if isinstance(t, str) else "" for t in whole]
                types: list = [[] for _ in whole]
                for i, parts in parts_of(filled, tagger):
                    out, at = [], 0
                    for kind, a, z in parts:
                        out += [filled[i][at:a], f"[{kind}]"]
                        at = z
                    whole[i] = "".join(out) + filled[i][at:]
                    types[i] = sorted({k for k, _, _ in parts})
                yield pd.DataFrame({"text": whole, "types": types})

        return redact(text)


def body(text: str) -> Column:
    """A chunk's text without its bracketed first line."""
    return F.regexp_replace(text, _HEADER, "")


def header(text: str) -> Column:
    return F.regexp_extract(text, rf"({_HEADER})", 1)
