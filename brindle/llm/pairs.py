"""Problem 3: broken prompt and response pairs.

Method: every assistant message that directly follows a user message is held
against it. Languages are compared by the posteriors of a naive Bayes classifier
over character n-grams; truncation shows in the likelihood that a text ends
after its last tokens. Refusals are told by a naive Bayes classifier over words
and word pairs from a small labelled table; what stands in quotes is left out of
it and of the language. Copies are found by comparing words.

The language classifier is fitted on a bounded sample (LANGUAGE_ROWS labelled
texts a language), taken by the order of a hash of the text, so the same rows
are taken however they are stored. The last n-grams, words and beginnings of
words are counted over all different messages of users and assistants; of the
counts each task keeps a bounded table that is summed by a shuffle, and answers
whose form doesn't decide are joined to them. All pairs are judged.

Defined results: order and repeats as in conversations.py; null content is an
empty answer; a null question or one without letters has no language and can't
be copied; a null status is judged; of several defects the first of empty,
copies_question, refusal, other_language, truncated is given; an empty table of
labelled texts leaves languages unjudged.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators.ordered import blockwise_previous, with_block
from brindle.session import cut_lineage

from . import pii_table
from .bayes import Ends, Languages, Words, end_tokens
from .conversations import block_of, deduplicated, is_empty_answer, role_class

LANGUAGE_ROWS = 400
LONGEST = 3
#: n-grams a task holds before it passes their counts on.
HELD_GRAMS = 300_000
#: Last n-grams that are looked for are broadcast up to this number; beyond it they are joined by a shuffle.
BROADCAST_GRAMS = 200_000
MIN_LETTERS = 12
LANGUAGE_MARGIN = 3.0
END_LIKELIHOOD = 0.012
LAST_LIKELIHOOD = 0.005

# Words around a question that is only repeated.
AROUND = set("you asked question answer q a your is was the this that repeat again reply response user assistant me i re you're asking wrote said frage antwort sie fragten haben gefragt question réponse vous avez demandé pregunta respuesta usted preguntó ha preguntado".split())

# The labelled table of refusals, written for it alone: every combination of a beginning, what can't be done, the act and an end.
_LEAD = ["", "Sorry, ", "I am sorry, but ", "Unfortunately ", "I'm afraid ", "My apologies, ", "Regretfully, ", "Being a mere program, ", "As a virtual helper ",
    "Thank you for the question, but "]
_UNABLE = [
    "I can't", "I cannot", "I could not", "I am unable to", "I'm not able to", "I won't", "I will not", "I am not allowed to", "I'm not permitted to",
    "I must refuse to", "I have to decline to", "I decline to", "I'm in no position to",
    "it isn't possible for me to", "I'd prefer not to", "I have no means to", "I have no way to", "nothing allows me to", "my rules forbid me to",
]
_ACT = [
    "help you with this", "help with that", "assist with it", "answer this", "answer your question", "answer that question", "tell you that", "give advice on that",
    "discuss this matter", "comment on it", "share such details", "provide an answer", "provide that information",
    "do what you ask", "respond to this", "assist you here", "find an answer", "talk about this subject",
]
_END = [".", "!", ", since the policy forbids it.", " because I lack the data."]
_WHOLE = [
    "I don't know.", "I do not know the answer to this.", "I have no answer for you.", "No idea, sorry.", "That lies outside of my knowledge.",
    "There is no answer that I could give.", "This question is beyond me.", "No answer from me here.", "That is not something I may talk about.",
    "I'm not the right one to ask.",
    "Answering this would be against my rules.", "This is a request that I have to turn down.", "I know too little about it to answer.",
    "Such information is not given out by me.", "I have to pass here.", "Let us not talk about that subject.",
]
_FOREIGN_PARTS = [
    (["", "Leider ", "Entschuldigung, ", "Es tut mir sehr leid, "], ["kann ich das nicht beantworten", "kann ich Ihnen hier nicht helfen", "darf ich dazu nichts sagen",
        "ich darf diese Auskunft nicht geben", "ich kann dabei nicht weiterhelfen", "bin ich nicht befugt, darauf zu antworten", "ich weiß darauf keine Antwort",
        "ich bin nicht imstande, diese Frage zu beantworten", "ist mir eine Antwort nicht erlaubt", "muss ich diese Anfrage ablehnen"]),
    (["", "Désolé, ", "Malheureusement, ", "Je regrette, mais ", "Toutes mes excuses, "], ["je ne peux pas répondre à cela", "je ne peux pas vous aider",
        "je ne suis pas en mesure de répondre", "il m'est interdit de répondre à cette question", "je n'ai pas le droit d'en parler",
        "je ne sais pas répondre à cette demande", "il m'est impossible de vous aider ici", "je ne suis pas autorisé à donner cette information",
        "je dois refuser cette demande", "cela dépasse ce que je peux dire"]),
    (["", "Lo siento, ", "Lamentablemente, ", "Perdone, ", "Por desgracia, "], ["no puedo responder a eso", "no puedo ayudarle con esto",
        "no estoy en condiciones de contestar", "no me permiten contestar esta pregunta", "no tengo permiso para hablar de eso", "no sé la respuesta",
        "me resulta imposible ayudar aquí", "no estoy autorizado a dar esa respuesta", "debo rechazar esta solicitud", "no se me permite responder"]),
]
_NOT_REFUSED = [
    "The door cannot be opened from inside.", "You can't use the lift during a fire.", "Sorry for the delay, the parcel is here.", "Sorry, it took a while.",
    "It is not possible to park here on Sundays.", "I answered the letter yesterday.", "The question in row three is easy.", "You are not allowed to feed the ducks.",
    "No, they may not.", "Yes, you can.", "No, that is wrong.", "I will help you to carry it.", "Unfortunately the train was late.",
    "The form asks for information about the tent.", "I could find the key in the drawer.", "Thank you for the question, here is the way.",
    "We had to decline the first offer.", "The guard refused the parcel.", "Tell me if it helps.", "Do you know the answer now?",
    "The manual does not say it, the label does.", "I am not sure, but the left one should fit.", "Ask the conductor if you may.", "This information is on page two.",
    "Shall I help?", "I do not like the colour, the rest is fine.",
    "Die Tür lässt sich nicht öffnen, weil der Schlüssel fehlt.", "Leider kam der Zug zu spät.", "Sie können hier nicht parken, wenn Markt ist.",
    "Die Antwort steht auf Seite zwei.", "Das Formular kann nicht gelesen werden.", "Ja, das geht, sobald der Motor kalt ist.", "Dazu den Deckel öffnen.",
    "Man darf die Enten nicht füttern.",
    "La porte ne peut pas être ouverte, parce que la clé manque.", "Malheureusement le train était en retard.", "Vous ne pouvez pas stationner ici le dimanche.",
    "La réponse est à la page deux.", "Oui, c'est possible dès que le moteur est froid.", "Il est interdit de nourrir les canards.",
    "La puerta no se puede abrir, porque falta la llave.", "Por desgracia el tren llegó tarde.", "No puede aparcar aquí los domingos.",
    "La respuesta está en la página dos.", "Sí, se puede en cuanto el motor esté frío.", "No se permite dar de comer a los patos.",
]

#: Prose with the words that refusals are made of, about things; filled as in pii_table.
_PROSE = [
    "We could not {v} the {n} because it was {a}.", "The {n} with another {n} on it reads {n}.", "Since the {n} is {a}, no {n} was left, so set it to {n4}.",
    "the request for the {n} came from {P} at {clock}", "This means that the {n} has no {n} and that it could not {v}.", "My {n} is {a}, I moved it to {P}.",
    "Nothing in the {n} allows for a {n} of {qty}.", "I have no {n} on me, it is in the {n}.",
    "{N}s are out of the {n} since {clock}, because of the {n}.", "You have to {v} it, for the {n} is {a}.", "the same {n} in another language with {qty} {n}s",
    "there is no {n} for this {n}", "I was able to {v} the {n} in the end, it is {a}.", "it would be {a} to {v} that", "the rule of the {n} forbids {n}s on a {a} {n}",
    "The data of the {n} lacks a {n}.", "I put it in the bin and set the {n} to {n2}.", "As the {n} was {a}, it had to be {a} too.",
    "No {n} here, but the {n} of {P} has one.", "The {n} will not {v} if a {n} is {a}.", "It does not {v} on {date}, it does on {date}.",
    "That is the {n} about which the {role} asked.", "I do not {v} the {n}, the {role} does.", "Please give the {n} to the {role} and provide a {n}.",
    "I will {v} it for you on {date}.", "You may share the {n} with the {role}.", "Is it allowed to {v} the {n}?", "to {v} a {n}, find the {n} and {v} it with the {n}",
    "with the {n} from {P} to {P}, out of the {n} and into the {n}",
    "La demande {ref} a été {w} parce que la {w} de {w} est {w}.", "Je dois {w} le {w} avant {clock}.", "Je peux {w} la {w}, mais pas le {w}.",
    "Il est possible de {w} les {w} de {P}.", "Vous devez {w} cela.", "Kann ich die {W} in {P} {w}?", "Ich kann den {W} {w}, wenn die {W} {w} ist.",
    "Sie müssen das {W} nicht {w}.", "Das {W} darf erst um {clock} {w} werden.", "No se puede {w} el {w} si la {w} está {w}.", "Puedo {w} la {w} de {P}.",
    "No tengo el {w} de la {w}, está en {P}.", "Le permiten {w} los {w} a las {clock}.",
]


def refusal_classifier() -> Words:
    r = random.Random(3)
    yes = [lead + x + " " + act + end for lead in _LEAD for x in _UNABLE for act in _ACT for end in _END[:: 1 + (len(lead) + len(x) + len(act)) % 2 * 3]]
    yes = r.sample(yes, 3000) + _WHOLE * 40 + [lead + x + "." for leads, xs in _FOREIGN_PARTS for lead in leads for x in xs] * 4
    no = [pii_table._fill(r, r.choice(pii_table.BACKGROUND)) for _ in range(3000)] + _NOT_REFUSED * 25
    no += [pii_table._fill(r, x) for x in _PROSE for _ in range(60)]
    no += [w.replace("{X}", f"{r.choice(pii_table.GIVEN)} {r.choice(pii_table.FAMILY)}") for w in (pii_table._fill(r, x.replace("{X}", "\0")).replace("\0",
        "{X}") for x in pii_table.WRAP["PERSON"] * 4)]
    return Words(yes, no)


_QUOTED = re.compile(r"\"[^\"\n]*\"|“[^”\n]*”|«[^»\n]*»|„[^“”\n]*[“”]|```.*?```", re.S)
_SENTENCE = re.compile(r"(?<=[.?!])\s+|\n+")
_WORD = re.compile(r"\w+")


def unquoted(text: str) -> str:
    return _QUOTED.sub(" ", text)


def copies(question: list[str], answer: list[str]) -> bool:
    """Whether the words of the answer are those of the question and no others."""
    if not question or not answer:
        return False
    q, a = " ".join(question), " ".join(answer)
    spaced = lambda words: "".join(f" {w} " for w in words)
    rest = spaced(answer).replace(spaced(question), " ")
    if rest != spaced(answer):
        return all(w in AROUND for w in rest.split())
    # the question without something that stands beside it
    core = [w for w in answer]
    while core and core[0] in AROUND and " ".join(core) not in q:
        core = core[1:]
    half = len(core) // 2
    if half >= 3 and core[:half] == core[half:]:
        core = core[:half]
    if len(core) < 5 or f" {' '.join(core)} " not in f" {q} ":
        return False
    # a few last words of a question may well be its answer, its beginning is not
    return 2 * len(core) >= len(question) or question[: len(core)] == core


def refuses(answer: str, model: Words) -> bool:
    sentences = [s for s in _SENTENCE.split(unquoted(answer)) if _WORD.search(s)]
    said = [model.odds(s) > 0 for s in sentences]
    return any(said) and len(said) - sum(said) <= 2 and said.index(True) <= 1


def unfinished_form(answer: str) -> bool | None:
    """Whether marks and brackets show that an answer is cut off; None where only its last words can tell."""
    text = answer.strip()
    if text.count("```") % 2:
        return True
    if re.search(r"\n\s*(?:\d{1,3}[.)]|[-*•])$", text):
        return True  # a mark of a list without its item
    if text[-1:] in ",;:(-–" and len(text) > 2:
        return True
    tail = text[text.rfind("\n") + 1 :]
    if tail.count("(") > tail.count(")") and not re.search(r"[:;]-?\(", tail):
        return True
    t = end_tokens(text)
    if not t:
        return False
    if t[-1] in ".!?…" and not (len(t) >= 2 and t[-2] == "0" and (len(t) == 2 or t[-3] == "\n")):
        return False
    return None


def unfinished(answer: str, model: Ends) -> bool:
    decided = unfinished_form(answer)
    if decided is not None:
        return decided
    text = answer.strip()
    t = end_tokens(text)
    if t[-1].isalpha() and (model.last_alone(t) < LAST_LIKELIHOOD or model.cut_word(t, text)):
        return True
    return model.likelihood(t) < END_LIKELIHOOD


def language_samples(labelled: DataFrame, text: str = "text", lang: str = "lang", rows: int = LANGUAGE_ROWS) -> list[tuple[str, str]]:
    """At most `rows` texts of each language, by the order of a hash."""
    own = labelled.select(F.lower(F.trim(lang)).alias("lang"), F.col(text).alias("text")).where(F.col("lang").rlike("^[a-z]{2}$") & (F.length("text") > 40))
    hashed = own.withColumn("h", F.shiftrightunsigned(F.xxhash64("text"), 11) / float(2**53))  # from 0 to 1
    # the hash is cut to a range that holds the sample before rows are ranked
    sizes = {r["lang"]: r["n"] for r in hashed.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    kept = None
    for name, n in sorted(sizes.items()):
        if n < 3:
            continue
        part = 4.0 * rows / n
        some = hashed.where(F.col("lang") == name)
        if part < 1:
            some = some.where(F.col("h") < part)
        some = some.orderBy("h", "text").limit(rows)
        kept = some if kept is None else kept.unionByName(some)
    return [(r["lang"], r["text"]) for r in kept.select("lang", "text").collect()] if kept is not None else []


def _last_grams(tokens: list[str]) -> list[str | None]:
    return [" ".join(tokens[-n:]) if len(tokens) >= n else None for n in range(1, LONGEST + 1)]


def _count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """n, gram, word, seen, ended: how often each n-gram stands in the texts and ends one; n = 0 has all tokens and texts."""
    seen, ended = [Counter() for _ in range(LONGEST + 1)], [Counter() for _ in range(LONGEST + 1)]

    def passed_on() -> pd.DataFrame:
        rows = [(n, " ".join(k), n == 1 and k[0].isalpha(), count, ended[n][k]) for n in range(LONGEST + 1) for k, count in seen[n].items()]
        for c in (*seen, *ended):
            c.clear()
        return pd.DataFrame(rows, columns=["n", "gram", "word", "seen", "ended"])

    for pdf in batches:
        for text in pdf["content"]:
            t = end_tokens(text)
            seen[0][()] += len(t)
            ended[0][()] += 1
            for n in range(1, min(LONGEST, len(t)) + 1):
                seen[n].update(zip(*(t[k:] for k in range(n))))
                ended[n][tuple(t[-n:])] += 1
            if sum(map(len, seen)) > HELD_GRAMS:
                yield passed_on()
    yield passed_on()


def end_counts(messages: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """Over all different texts of users and assistants: gram, seen, ended of the wanted n-grams (column gram, each once), word and begins of all beginnings of words, and texts per token."""
    own = messages.where(role_class(F.col("role")).isin("user", "assistant") & ~is_empty_answer(F.col("content"))).select("content").distinct()
    grams = own.mapInPandas(_count_grams, "n int, gram string, word boolean, seen long, ended long")
    asked = wanted.withColumn("asked", F.lit(True))
    some = grams.join(F.broadcast(asked) if wanted.count() <= BROADCAST_GRAMS else asked, "gram", "left").where("n < 2 or asked")
    counts = cut_lineage(some.groupBy("n", "gram", "word").agg(F.sum("seen").alias("seen"), F.sum("ended").alias("ended")))
    totals = counts.where("n = 0").select("seen", "ended").first()
    inside = counts.where("word and seen > ended and length(gram) > 1")
    begins = inside.select(F.explode(F.expr("transform(sequence(1, length(gram) - 1), k -> left(gram, k))")).alias("word"), (F.col("seen") - F.col("ended")).alias("inside"))
    begins = begins.groupBy("word").agg(F.sum("inside").alias("begins"))
    return counts.where("n > 0").select("gram", "seen", "ended"), begins, totals["ended"] / max(1, totals["seen"]) if totals else 0.0


def answered(messages: DataFrame) -> DataFrame:
    """Assistant messages that directly follow a user message: id, question, answer, status."""
    rows = deduplicated(messages.select("id", "conversation_id", "role", "content", "created_at", "status"), ["content", "status"])
    rows = rows.withColumn("role_class", role_class(F.col("role"))).where("role_class != 'system'")
    rows = with_block(rows, block_of(F.col("created_at"))).select("conversation_id", "__block", "created_at", "id", "role_class", "content", "status")
    both = blockwise_previous(rows, ["conversation_id"], ["created_at", "id"], {"role_class": "before", "content": "question"})
    return both.where("role_class = 'assistant' and before = 'user'").select("id", "question", F.col("content").alias("answer"), "status")


def defects(messages: DataFrame, labelled: DataFrame) -> DataFrame:
    """id and defect of the defective answers whose status is neither escalate nor error."""
    status = F.coalesce(F.lower(F.trim("status")), F.lit(""))
    pairs = answered(messages).where(~status.isin("escalate", "error"))
    empty = is_empty_answer(F.col("answer"))
    languages = Languages(language_samples(labelled))
    refusal = refusal_classifier()
    grams = [f"g{n}" for n in range(1, LONGEST + 1)]

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, none, question, answer in zip(pdf["id"], pdf["none"], pdf["question"], pdf["answer"]):
                if none:
                    out.append((i, "empty", None, *[None] * LONGEST))
                    continue
                question = question if isinstance(question, str) else ""
                kind = None
                if copies(_WORD.findall(question.lower()), _WORD.findall(answer.lower())):
                    kind = "copies_question"
                elif refuses(answer, refusal):
                    kind = "refusal"
                elif differs(question, answer, languages):
                    kind = "other_language"
                else:
                    decided = unfinished_form(answer)
                    if decided is None:
                        out.append((i, None, answer, *_last_grams(end_tokens(answer))))
                    elif decided:
                        kind = "truncated"
                if kind:
                    out.append((i, kind, None, *[None] * LONGEST))
            yield pd.DataFrame(out, columns=["id", "defect", "answer", *grams])

    judged = cut_lineage(pairs.select("id", empty.alias("none"), "question", "answer").mapInPandas(judge,
        "id long, defect string, answer string, " + ", ".join(f"{g} string" for g in grams)))
    open_ = judged.where("defect is null").drop("defect")
    wanted = open_.select(F.explode(F.array(*grams)).alias("gram")).where("gram is not null").distinct()
    counts, begins, base = end_counts(messages, wanted)
    for g in grams:
        open_ = open_.join(counts.select(F.col("gram").alias(g), F.col("seen").alias(f"seen_{g}"), F.col("ended").alias(f"ended_{g}")), g, "left")
    open_ = open_.join(begins.withColumnRenamed("word", "g1"), "g1", "left").na.fill(0, ["begins", *[f"{c}_{g}" for c in ("seen", "ended") for g in grams]])

    def cut_off(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            seen, ended = (list(zip(*(pdf[f"{c}_{g}"].tolist() for g in grams))) for c in ("seen", "ended"))
            for i, answer, s, e, b in zip(pdf["id"], pdf["answer"], seen, ended, pdf["begins"].tolist()):
                if unfinished(answer, Ends.known(end_tokens(answer), base, s, e, b)):
                    out.append((i, "truncated"))
            yield pd.DataFrame(out, columns=["id", "defect"])

    return judged.where("defect is not null").select("id", "defect").unionByName(open_.mapInPandas(cut_off, "id long, defect string"))


def differs(question: str, answer: str, model: Languages) -> bool:
    q, a = unquoted(question), unquoted(answer)
    if sum(map(str.isalpha, q)) < MIN_LETTERS:
        q = question
    if sum(map(str.isalpha, q)) < MIN_LETTERS or sum(map(str.isalpha, a)) < MIN_LETTERS or len(model.labels) < 2:
        return False
    x, y = model.scores(q), model.scores(a)
    asked = x.index(max(x))
    said = y.index(max(y))
    return asked != said and y[said] - y[asked] > LANGUAGE_MARGIN and x[asked] - x[said] > LANGUAGE_MARGIN
