"""Guards and intents: predicates and redactions over queries, answers and passages."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.config import DEFAULT, Config

from .text import error_numbers, truncate_words

# Patterns and word lists that the checks are defined by.
INJECTION = [r"ignore\s+.*instructions", r"disregard\s+(previous|prior|above|all)\s+instructions", r"you\s+are\s+now\s+a", r"act\s+as\s+(if\s+you\s+are|a)", r"forget\s+(everything|all|prior|previous)", r"new\s+instructions\s*:", r"system\s*:\s*you", r"<\s*system\s*>", r"\[system\]"]
ABUSE = ["fuck", "shit", "bastard", "asshole", "idiot", "stupid", "moron"]
FIGURE_INTENT = r"\b(diagrams?|figures?|flow\s?charts?|screenshots?|screen\s?shots?|charts?|graphics?|illustrations?|pictures?|images?|visuals?)\b"
AGGREGATE_INTENT = r"\b(how many|how much|number of|count of|total number|list all|list every|all the (incidents?|defects?|bugs?|rows?|records?)|what columns|which columns|how many (incidents?|defects?|rows?|records?))\b"
TRANSCRIPT_INTENT = r"\b(video|recording|audio|clip|transcript|transcription|(what|who).{0,20}(said|say|talk|speak|mention)|summar(y|ise|ize).{0,20}(video|recording|clip|call|meeting))\b"
ESCALATION_INTENT = [r"escalate", r"raise\s+(a\s+)?(ticket|incident|issue)", r"create\s+(a\s+)?(ticket|incident|service\s*now)", r"log\s+(a\s+)?(ticket|incident|issue)", r"open\s+(a\s+)?(ticket|incident)", r"submit\s+(a\s+)?(ticket|incident)", r"need\s+(a\s+)?ticket", r"create\s+servicenow", r"raise\s+(a\s+)?concern", r"report\s+(this|the|an)\s+issue", r"file\s+(a\s+)?(ticket|complaint|incident)"]
DEFINITION = [r"(?:full form|full name|expand|abbreviation|acronym)\s+(?:of|for)?\s+([A-Z]{2,6})", r"what\s+(?:does|is)\s+([A-Z]{2,6})\s+(?:stand for|mean|refer to)", r"what\s+is\s+(?:the\s+)?(?:meaning\s+of\s+)?([A-Z]{2,6})\??$", r"define\s+([A-Z]{2,6})"]
YES_WORDS = ["yes", "yeah", "sure", "ok", "okay", "please", "yep", "proceed"]
NO_WORDS = ["no", "nope", "cancel", "never mind", "nevermind", "don't"]
ANSWER_PII = [(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL]"), (r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b", "[PHONE]"), (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "[IP_ADDRESS]"), (r"\b\d{3}-\d{2}-\d{4}\b", "[SSN]")]
INTERNAL_TERMS = ["chroma_db", "chromadb", "vectorstore", "bm25_index", "bm25", "pdf_chunks", "excel_errors", "servicenow_tickets", "doc_id", "chunk_id", "./data/", "./vectorstore/"]
HINT_STOP_WORDS = ["what", "is", "the", "how", "does", "do", "are", "can", "tell", "me", "about", "explain", "describe", "give", "show", "find", "get", "a", "an", "of", "for", "resolution", "answer", "information", "details"]


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _any(text: Column, words: list[str] | tuple[str, ...]) -> Column:
    return text.rlike("|".join(re.escape(w) for w in words)) if words else F.lit(False)


def rejection(query: Column | str, config: Config = DEFAULT) -> Column:
    """First failing check of a query: empty_query, query_too_long, prompt_injection, abusive_language; null when valid."""
    q = F.trim(F.regexp_replace(F.coalesce(_c(query), F.lit("")), r"(?U)^\s+|\s+$", ""))
    low = F.lower(q)
    return F.when(q == "", "empty_query").when(F.length(q) > config.query_chars, "query_too_long").when(low.rlike("|".join(f"(?:{p})" for p in INJECTION)), "prompt_injection").when(_any(low, ABUSE), "abusive_language")


def rejection_message(reason: Column | str, config: Config = DEFAULT) -> Column:
    r = _c(reason)
    return (
        F.when(r == "empty_query", "Please enter a question.")
        .when(r == "query_too_long", f"The question is too long; {config.query_chars} characters are the limit.")
        .when(r == "prompt_injection", "This request can't be processed. Please ask a question about the documents.")
        .when(r == "abusive_language", "Please keep the conversation respectful.")
        .when(r.isNotNull(), "This request can't be processed.")
    )


def figure_intent(query: Column | str) -> Column:
    return _c(query).rlike("(?i)" + FIGURE_INTENT)


def aggregate_intent(query: Column | str) -> Column:
    return _c(query).rlike("(?i)" + AGGREGATE_INTENT)


def transcript_intent(query: Column | str) -> Column:
    return _c(query).rlike("(?i)" + TRANSCRIPT_INTENT)


def escalation_intent(query: Column | str) -> Column:
    return F.lower(_c(query)).rlike("|".join(f"(?:{p})" for p in ESCALATION_INTENT))


def acronym(query: Column | str) -> Column:
    """The acronym a query asks to define, upper case; null where it asks for none."""
    q = _c(query)
    return F.upper(F.coalesce(*[F.nullif(F.regexp_extract(q, "(?i)" + p, 1), F.lit("")) for p in DEFINITION]))


def answer_class(reply: Column | str) -> Column:
    """yes, no or unclear, by words contained; yes is looked for first."""
    low = F.lower(F.trim(_c(reply)))
    return F.when(_any(low, YES_WORDS), "yes").when(_any(low, NO_WORDS), "no").otherwise("unclear")


def redact_answer(text: Column | str) -> tuple[Column, Column]:
    """Text with placeholders for mail, phone, address and number patterns, in this order, and the placeholders set."""
    t = _c(text)
    flags = []
    for pattern, sign in ANSWER_PII:
        flags.append(F.when(t.rlike(pattern), F.lit(sign)))
        t = F.regexp_replace(t, pattern, sign.replace("$", r"\$"))
    return t, F.array_compact(F.array(*flags))


def redact_internal(text: Column | str, terms: list[str] | None = None) -> tuple[Column, Column]:
    """Internal terms replaced one after the other, without case, and the terms met in the text as it came."""
    t, whole = _c(text), F.lower(_c(text))
    flags = []
    for term in INTERNAL_TERMS if terms is None else terms:
        flags.append(F.when(F.instr(whole, term.lower()) > 0, F.lit(term)))
        t = F.regexp_replace(t, "(?i)" + re.escape(term), "[internal]")
    return t, F.array_compact(F.array(*flags))


def invented_errors(answer: Column | str, context: Column | str, known: Column | None = None) -> Column:
    """Error numbers of the answer that neither the context's text nor its metadata has."""
    have = error_numbers(F.coalesce(_c(context), F.lit("")))
    if known is not None:
        have = F.array_union(have, F.coalesce(known, F.array().cast("array<string>")))
    return F.array_except(error_numbers(_c(answer)), have)


def answer_check(answer: Column | str, context: Column | str, known: Column | None = None, config: Config = DEFAULT) -> Column:
    """Struct of the answer's text after redaction and cutting, and its flags: pii, leaked, invented, truncated, safe."""
    redacted, pii = redact_answer(answer)
    plain, leaked = redact_internal(redacted)
    invented = invented_errors(plain, context, known)
    most = int(config.answer_tokens * 0.75)
    text = truncate_words(plain, most)
    cut = F.size(F.filter(F.split(plain, r"(?U)\s+"), lambda w: w != "")) > most
    return F.struct(text.alias("text"), pii.alias("pii_found"), leaked.alias("leaked"), invented.alias("invented"), cut.alias("truncated"), ((F.size(leaked) == 0) & (F.size(invented) == 0)).alias("safe"))


def sensitivity(text: Column | str, config: Config = DEFAULT) -> Column:
    """high, medium or low by keywords contained; high comes first."""
    low = F.lower(F.coalesce(_c(text), F.lit("")))
    return F.when(_any(low, [k.lower() for k in config.high_keywords]), "high").when(_any(low, [k.lower() for k in config.medium_keywords]), "medium").otherwise("low")


def confidence_band(score: Column | str, config: Config = DEFAULT) -> Column:
    s = _c(score)
    return F.when(s >= config.high, "high").when(s >= config.low, "medium").otherwise("low")
