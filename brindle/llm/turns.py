"""Problem 4: clean speaker turns from the raw segments of recordings.

Method: labels are taken out of the segments and normalised. Numbers and
functions have one key in any spelling. Names are parsed by their shape into
given name, initial and family name; a name that is not in the directory of staff
counts as a label where it is met again, in its recording or in another. Who is
meant is decided per recording by optimal assignment: full names against a
roster (the directory, and full names met in two recordings or more) whose
candidates come from blocks of initial and phonetic code of the family name, then
initials with a family name, then given names and family names alone, each
against the people found so far, the roster and "somebody else", at costs of
spelling, sound and shared initial. Labels of one form stay different people
unless they are spellings of one name. Times, sounds and hesitations are stripped
from the words. The ordered pieces give the turns.

Order, carried labels and turn starts are worked out per block of time of a
recording (brindle.operators.ordered), so one long recording is spread over many
tasks. turns() gives one row a turn with its begin and end; its words are put
together from parts, one for each block it lasts.

Defined results: null and blank texts have no words; equal rows count once; a
null start sorts first; missing and reversed ends are taken as the start; words
before the first label belong to a turn without a name; a label in a segment
without words holds for the words that follow; a name that turns out to be no
label is words; an empty table gives no turn.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators.ordered import BLOCK, blockwise_fill, blockwise_previous, with_block
from brindle.session import cut_lineage, fanout

BLOCK_SECONDS = 1800
#: Labels are broadcast up to this number of rows; beyond it they are joined by a shuffle, every label in SALTS copies so that a long recording is spread.
BROADCAST_LABELS = 100_000
SALTS = 32

# Words for numbered speakers, for numbers, for functions; words before a colon that are no speaker; hesitations.
NUMBERED = "speaker|spk|spkr|sprecher|sprecherin|spr|s|locuteur|locutrice|intervenant|loc|hablante|orador|interlocutor|participant|person|voice|stimme|voix|voz|teilnehmer"
NUMBERS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5}
FUNCTIONS = set("trainer trainee operator observer host cohost moderator presenter instructor interviewer interviewee narrator agent customer caller supervisor guest analyst consultant student teacher facilitator expert technician manager lead chair assistant coach mentor engineer planner buyer user client tester admin administrator reviewer auditor coordinator support attendee listener leiter schulungsleiter teilnehmerin beobachter moderatorin formateur formatrice stagiaire opérateur observateur formador aprendiz operador observador instructora".split())
NO_SPEAKERS = set("note warning option step error reminder caution tip hint question answer example important summary action remark status code screen page title chapter section item result path see also figure table message attention hinweis warnung schritt fehler achtung frage antwort remarque avertissement étape erreur nota aviso paso ejemplo".split())
FILLERS = ["you know", "sort of", "kind of", "i mean", "um", "umm", "uh", "uhh", "uhm", "uh-huh", "er", "erm", "err", "ah", "ahh", "eh", "ehm", "hm", "hmm", "hmmm", "mhm", "mm", "mmm", "mm-hm", "mm-hmm", "oh", "äh", "ähm", "öh", "öhm", "hä", "tja", "euh", "heu", "bah", "ben", "este", "pues eh"]

_NAME = r"[^\W\d_][\w.'’-]*"
_AHEAD = r"(?=\s|$|[\[(<*♪])"
#: What may end a label: a bracket, a colon, a dash between blanks.
_MARK = re.compile(r"\[(?P<square>[^\])>\n]{1,48})\]:?|\((?P<round>[^\])>\n]{1,48})\):?|<(?P<angle>[^\])>\n]{1,48})>:?|:" + _AHEAD + r"|\s[-–—]" + _AHEAD)
_AFTER_ROLE = re.compile(r"\s*(:|\s[-–—])" + _AHEAD)
_BEGIN = re.compile(r"(?:^|(?<=[.?!…♪\])>*;\n]))\s*(?:>>\s*|[-–*]\s+)?(?=[^\W\d_])")
_PLAIN = re.compile(_NAME + r"(?:[ _,.]+(?:" + _NAME + r"|\d{1,2})){0,3}")
_TAIL = re.compile(r"(?<=[.?!] )\S")
_TIME = re.compile(r"[\[(<{]\s*\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d+)?(?:\s*(?:-->|[-–])\s*\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d+)?)?\s*[\])>}]")
_LEADING_TIME = re.compile(r"^\s*\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d+)?(?=\s|$)")
_SOUND = re.compile(r"\[[^\]\n]*\]|<[^>\n]*>|\*[^*\n]{1,40}\*|♪[^♪\n]*♪|♪|\((?![^)\n]*\d)[^)\n]{1,40}\)|\{[^}\n]*\}")
_SPACED = re.compile(r"\s([,.;:?!])")
_LEAD = re.compile(r"^(?:>>|[-–—,.;:…\s>])+")
_FILLER = re.compile(r"(?<![\w-])(?:" + "|".join(re.escape(x) for x in sorted(FILLERS, key=len, reverse=True)) + r")(?![\w-])(?:\s*[,.…!?]+(?=\s|$))?", re.I)
_WORDS = re.compile(r"\w")
_NUMBERED = re.compile(rf"(?:{NUMBERED})[\s._#-]*(?:no\.?\s*)?0*(\d{{1,3}}|{'|'.join(NUMBERS)})", re.I)


def clean(text: str) -> str:
    """The spoken words alone."""
    t = _LEADING_TIME.sub(" ", _TIME.sub(" ", text))
    t = _LEADING_TIME.sub(" ", _SOUND.sub(" ", t))
    t = " ".join(_FILLER.sub(" ", t).split())
    t = _LEAD.sub("", _SPACED.sub(r"\1", t)).strip()
    return t if _WORDS.search(t) else ""


def parse_name(label: str, given: frozenset, family: frozenset) -> tuple[str, str, bool] | None:
    """(given name or initial, family name), lower case, either possibly empty, and whether the directory has any of it; None where it has not the shape of a name."""
    bare = " ".join(label.split()).strip(" .:").replace("’", "'")
    if "," in bare:
        last, _, first = bare.partition(",")
        bare = f"{first.strip()} {last.strip()}"
    words = [w for w in re.split(r"[ _]+", bare) if w]
    while words and words[0].lower().strip(".") in TITLES:
        words = words[1:]
    if not words or len(words) > 3 or any(any(c.isdigit() for c in w) for w in words):
        return None
    low = [w.lower().strip(".") for w in words]
    if any(w in NO_SPEAKERS or w in FUNCTIONS or not w for w in low):
        return None
    capital = all(w[0].isupper() for w in words)
    if len(low) == 1:
        if low[0] in given:
            return low[0], "", True
        if not capital or len(low[0]) < 2 or "_" in label:
            return None
        return ("", low[0], True) if low[0] in family else (low[0], "", False)
    known = low[0] in given or low[-1] in family
    if len(low[0]) == 1 and not words[0][0].isupper() or len(low[-1]) < 2:
        return None
    if known and (capital or low[0] in given and low[-1] in family):
        return low[0], low[-1], True
    return (low[0], low[-1], False) if capital and len(low) == 2 and "_" not in label else None


TITLES = set("mr mrs ms dr prof herr frau señor señora sr sra mme monsieur madame".split())


def label_key(label: str, given: frozenset, family: frozenset) -> str | None:
    """Key of a speaker: n<number>, f<function>, p|<given>|<family>, u|<given>|<family> for names by their shape alone; None where it is no label."""
    bare = re.sub(r"\s*\([^)]*\)\s*$", "", label).strip(" \t.:>-–")
    m = _NUMBERED.fullmatch(bare)
    if m:
        n = m.group(1).lower()
        return f"n{NUMBERS.get(n) or int(n)}"
    if bare.lower() in FUNCTIONS:
        return "f" + bare.lower()
    name = parse_name(bare, given, family)
    return f"{'p' if name[2] else 'u'}|{name[0]}|{name[1]}" if name else None


class Labels(dict):
    """Keys of labels met so far."""

    def __init__(self, given: frozenset, family: frozenset):
        super().__init__()
        self.given, self.family = given, family

    def __missing__(self, label: str) -> str | None:
        if len(self) > 200_000:
            self.clear()
        self[label] = key = label_key(label, self.given, self.family)
        return key


def _label_before(text: str, at: int, end: int, labels: Labels) -> tuple[int, str] | None:
    """Begin and key of a label that runs from the beginning of a sentence up to `end`."""
    begins = [m.end() for m in _BEGIN.finditer(text, at, end)]
    if at == 0 and (time := _LEADING_TIME.match(text)):
        begins.append(time.end() + len(text[time.end() :]) - len(text[time.end() :].lstrip(" \t>-–*")))
    for a in sorted(begins):
        stop = end
        while stop > a and text[stop - 1].isspace():
            stop -= 1
        if (m := _PLAIN.fullmatch(text, a, stop)) is None:
            continue
        plain = m.group()
        if (key := labels[plain]) is not None:
            return a, key
        # a sentence's stop may have been taken for that of an initial
        for x in _TAIL.finditer(plain):
            if (key := labels[plain[x.start() :]]) is not None:
                return a + x.start(), key
        return None
    return None


def pieces(text: str, labels: Labels) -> list[tuple[str | None, str, str | None]]:
    """(label key or None, words, words with the label where it is one by its shape alone) in order; the first has no key where the text begins without a label."""
    cuts: list[tuple[int, int, str]] = []
    at = 0
    for m in _MARK.finditer(text):
        if m.start() < at:
            continue
        found = m.group("square") or m.group("round") or m.group("angle")
        a, z = m.start(), m.end()
        if found is None:
            cut = _label_before(text, at, a, labels)
            if cut and m.group() != ":" and not text[cut[0] : a].isupper():
                cut = None
        else:
            cut = None
            if m.group("round"):  # a function behind a name, or a label itself
                if text[z - 1] == ":":
                    cut = _label_before(text, at, a, labels)
                elif (after := _AFTER_ROLE.match(text, z)) and (cut := _label_before(text, at, a, labels)):
                    z = after.end()
            key = labels[found]
            if cut is None and key is not None and (key[0] != "u" or text[z - 1] == ":"):  # sounds stand in brackets too
                cut = a, key
            at = z
        if cut:
            cuts.append((cut[0], z, cut[1]))
            at = z
    out: list[tuple[str | None, str, str | None]] = []
    first = clean(text[: cuts[0][0]] if cuts else text)
    if first or not cuts:
        out.append((None, first, None))
    for i, (a, z, key) in enumerate(cuts):
        end = cuts[i + 1][0] if i + 1 < len(cuts) else len(text)
        out.append((key, clean(text[z:end]), clean(text[a:end]) if key[0] == "u" else None))
    return out


@functools.lru_cache(maxsize=100_000)
def phonetic(name: str) -> str:
    """A code that spellings of one sound share."""
    s = "".join(c for c in unicodedata.normalize("NFKD", name.lower()) if c.isalpha())
    for a, b in (("sch", "s"), ("ph", "f"), ("th", "t"), ("ch", "k"), ("ck", "k"), ("gh", "g"), ("qu", "kw"), ("wh", "w"), ("sh", "s"), ("x", "ks"), ("z", "s"), ("c", "k"), ("v", "f"), ("y", "i"), ("j", "i")):
        s = s.replace(a, b)
    if not s:
        return ""
    head, rest = s[0], re.sub(r"[aeiouhw]", "", s[1:])
    return (head + re.sub(r"(.)\1+", r"\1", rest))[:6]


def assign(cost: list[list[float]]) -> list[int]:
    """Column of each row in an assignment of least cost; rows <= columns."""
    n, m = len(cost), len(cost[0]) if cost else 0
    u, v, match, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = [float("inf")] * (m + 1), [False] * (m + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    cur = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if cur < least[j]:
                        least[j], way[j] = cur, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            j1 = way[j0]
            match[j0], j0 = match[j1], j1
    out = [-1] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def _within_one_edit(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 4:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def _apart(a: str, b: str) -> float:
    """How far two spellings of a name are apart; 2 is another name."""
    return 0.0 if a == b else 0.25 if phonetic(a) == phonetic(b) else 0.5 if _within_one_edit(a, b) else 2.0


def _misfit(label: tuple[str, str], name: tuple[str, str]) -> float:
    """Cost of calling somebody of this name by this label."""
    total, shared = 0.0, False
    if label[0] and name[0]:
        shared = True
        if min(len(label[0]), len(name[0])) == 1:
            total += 0.1 if label[0][0] == name[0][0] else 2.0
        else:
            total += _apart(label[0], name[0])
    if label[1] and name[1]:
        shared = True
        total += _apart(label[1], name[1])
    return total if shared else 2.0


#: Costs of naming somebody from the roster whom no other label of the recording names, and of somebody of whom no more is known than the label.
_FROM_ROSTER, _SUPPORTED, _SOMEBODY = 0.3, 0.1, 0.9


def resolve(keys: list[str], roster: set[tuple[str, str]]) -> dict[str, str]:
    """Speaker of each label key of one recording."""
    out: dict[str, str] = {}
    forms: dict[int, list[tuple[str, tuple[str, str]]]] = defaultdict(list)
    for k in sorted(keys):
        if k[0] == "n":
            out[k] = f"Speaker {k[1:]}"
        elif k[0] == "f":
            out[k] = k[1:].capitalize()
        else:
            _, given, family = k.split("|")
            if k[0] == "u" and not family and any(x.endswith(f"|{given}") for x in keys):
                given, family = "", given  # by its shape one name may be either
            forms[0 if len(given) > 1 and family else 1 if given and family else 2 if given else 3].append((k, (given, family)))
    people: list[tuple[tuple[str, str], list[str]]] = []  # name as far as it is known, label keys
    for form in range(4):
        groups: list[list[tuple[str, tuple[str, str]]]] = []  # spellings of one name
        for k, label in forms[form]:
            own = next((g for g in groups if all(x[:1] == y[:1] and _apart(x, y) <= 0.5 for x, y in zip(label, g[0][1]))), None)
            if own is None:
                groups.append(own := [])
            own.append((k, label))
        taken = {name for name, _ in people}
        others = [label for f in range(4) if f != form for _, label in forms[f]]
        mean = lambda g, name: sum(_misfit(label, name) for _, label in g) / len(g)
        names = sorted(n for n in roster - taken if any(mean(g, n) + _SUPPORTED < _SOMEBODY for g in groups))
        extra = [_SUPPORTED if any(_misfit(x, n) < 0.5 for x in others) else _FROM_ROSTER for n in names]
        cost = [[mean(g, name) for name, _ in people] + [mean(g, n) + e for n, e in zip(names, extra)] + [_SOMEBODY if i == j else 9.0 for j in range(len(groups))] for i, g in enumerate(groups)]
        known = len(people)
        for g, c in zip(groups, assign(cost)):
            mine = [k for k, _ in g]
            if c < known:
                name, had = people[c]
                label = g[0][1]
                # an initial gives way to the given name, a missing part to what the label has
                people[c] = ((label[0] if len(label[0]) > len(name[0]) and len(name[0]) < 2 else name[0], name[1] or label[1]), had + mine)
            elif c < known + len(names):
                people.append((names[c - known], mine))
            else:
                people.append((max((label for _, label in g), key=lambda x: (len(x[0]) + len(x[1]), x)), mine))
    for name, mine in people:
        for k in mine:
            out[k] = " ".join(x.title() for x in name if x)
    return out


def spoken_pieces(segments: DataFrame, staff: DataFrame, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """Rows once each, cut at labels: doc_id, seg_no, start_sec, end_sec, piece_no, key, words, whole (the words where the label is none), __block."""
    from .pii import names_of

    given, family = names_of(staff)
    family = family | frozenset(r["f"] for r in staff.select(F.lower("family_name").alias("f")).distinct().collect() if r["f"])  # names with a hyphen, whole

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labels = Labels(given, family)
        for pdf in batches:
            out = []
            for doc, seg, start, end, text in zip(pdf["doc_id"], pdf["seg_no"], pdf["start_sec"], pdf["end_sec"], pdf["text"]):
                if not isinstance(text, str):
                    continue
                for n, (key, words, whole) in enumerate(pieces(text, labels)):
                    if key or words:
                        out.append((doc, seg, start, end if end is not None and end >= start else start, n, key, words, whole))
            yield pd.DataFrame(out, columns=["doc_id", "seg_no", "start_sec", "end_sec", "piece_no", "key", "words", "whole"])

    rows = segments.select("doc_id", "seg_no", "start_sec", "end_sec", "text").mapInPandas(cut, "doc_id string, seg_no int, start_sec double, end_sec double, piece_no int, key string, words string, whole string")
    return with_block(rows.distinct(), F.coalesce(F.floor(F.col("start_sec") / block_seconds), F.lit(-(2**40))))


def speakers(pieces_: DataFrame, staff: DataFrame) -> DataFrame:
    """doc_id, key, speaker (null where it is no label) of all labels. One row per label of a recording is looked at, and the names of the roster in its block."""
    labels = cut_lineage(pieces_.where("key is not null").groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n")))
    p = lambda i: F.get(F.split("key", r"\|"), F.lit(i))
    split = labels.select("doc_id", "key", "n", F.substring("key", 1, 1).alias("kind"), p(1).alias("given"), p(2).alias("family"))
    full = split.where("kind in ('p', 'u') and length(given) > 1 and length(family) > 1")
    met = full.groupBy("given", "family").agg(F.count(F.lit(1)).alias("recordings"), F.max("n").alias("most"))

    @F.pandas_udf("string")
    def code(names: pd.Series) -> pd.Series:
        return names.map(lambda x: phonetic(x) if isinstance(x, str) else None)

    block = lambda given, family: F.concat_ws("|", F.substring(given, 1, 1), code(family))
    own = staff.select(F.lower("given_name").alias("given"), F.lower("family_name").alias("family")).where("given is not null and family is not null")
    roster = met.where("recordings > 1").select("given", "family").unionByName(own).distinct()
    # a given name alone has a candidate where the roster has one person of that name
    single = roster.groupBy("given").agg(F.count(F.lit(1)).alias("c"), F.first("family").alias("family")).where("c = 1").select(F.concat(F.lit("g|"), "given").alias("block"), "given", "family")
    blocks = roster.select(block("given", "family").alias("block"), "given", "family").unionByName(single)
    wanted = split.where("kind in ('p', 'u') and length(family) > 1 and given <> ''").select("doc_id", "key", block("given", "family").alias("block"))
    wanted = wanted.unionByName(split.where("kind in ('p', 'u') and family = ''").select("doc_id", "key", F.concat(F.lit("g|"), "given").alias("block")))
    wanted = wanted.join(blocks, "block").groupBy("doc_id", "key").agg(F.collect_set(F.struct("given", "family")).alias("names"))
    # a name by its shape alone is a label if it is met again, in its recording or in another one
    again = met.where("recordings > 1 or most > 1").select("given", "family", F.lit(True).alias("again"))
    both = split.join(wanted, ["doc_id", "key"], "left").join(again, ["given", "family"], "left").select("doc_id", "key", "kind", "n", "names", F.coalesce("again", F.lit(False)).alias("again"))

    def of_recording(doc: str, rows: list[tuple]) -> list[tuple]:
        """rows: key, kind, n, names, again."""
        names = {(x["given"], x["family"]) for row in rows if row[3] is not None for x in row[3]}
        sure = {k for k, kind, _, _, again in rows if kind != "u" or again}
        people = {part for k in sure if k[1] == "|" for part in k.split("|")[1:] if len(part) > 1}
        # by shape alone: an initial with a family name that is met again; one name that a label of the recording has
        sure |= {k for k, kind, n, _, _ in rows if kind == "u" and ((parts := k.split("|"))[2] and len(parts[1]) == 1 and n > 1 or parts[2] in people or parts[1] in people)}
        found = resolve(sorted(sure), names)
        return [(doc, row[0], found.get(row[0])) for row in rows]

    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        doc = None
        for pdf in batches:
            out: list[tuple] = []
            for d, *row in zip(*(pdf[c].tolist() for c in ("doc_id", "key", "kind", "n", "names", "again"))):
                if d != doc and held:
                    out += of_recording(doc, held)
                    held = []
                doc = d
                held.append(tuple(row))
            yield pd.DataFrame(out, columns=["doc_id", "key", "speaker"]).astype(object)
        if held:
            yield pd.DataFrame(of_recording(doc, held), columns=["doc_id", "key", "speaker"]).astype(object)

    own_order = both.repartition(fanout(both.sparkSession), "doc_id").sortWithinPartitions("doc_id", "key")
    return own_order.mapInPandas(name, "doc_id string, key string, speaker string")


def turn_pieces(segments: DataFrame, staff: DataFrame, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """Spoken pieces in order with speaker and `new`, whether a turn begins."""
    rows = cut_lineage(spoken_pieces(segments, staff, block_seconds))
    named = cut_lineage(speakers(rows, staff))
    if named.count() <= BROADCAST_LABELS:
        rows = rows.join(F.broadcast(named), ["doc_id", "key"], "left")
    else:
        salted = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("seg_no"), F.lit(SALTS)).cast("int")).join(salted, ["doc_id", "key", "salt"], "left").drop("salt")
    rows = rows.withColumn("words", F.when(F.col("speaker").isNull() & F.col("whole").isNotNull(), F.col("whole")).otherwise(F.col("words")))
    order = ["start_sec", "seg_no", "piece_no"]
    rows = blockwise_fill(rows.select("doc_id", BLOCK, *order, "end_sec", "speaker", "words"), ["doc_id"], order, "speaker", "who")
    said = rows.where("words <> ''").select("doc_id", BLOCK, *order, "end_sec", "who", "words", F.lit(True).alias("is_row"))
    said = blockwise_previous(said, ["doc_id"], order, {"who": "who_before", "is_row": "any_before"})
    return said.withColumn("new", F.col("any_before").isNull() | ~F.col("who").eqNullSafe(F.col("who_before"))).drop("is_row", "any_before", "who_before")


def turn_starts(segments: DataFrame, staff: DataFrame) -> DataFrame:
    """doc_id, seg_no of the segments in which a turn begins."""
    return turn_pieces(segments, staff).where("new").select("doc_id", "seg_no").distinct()


def turns(segments: DataFrame, staff: DataFrame, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """One row a turn: doc_id, turn_seg, turn_piece, speaker, start_sec, end_sec, n_pieces, text.

    The words of a turn are put together per block of time first, so that what
    meets in one row is a part for each block.
    """
    rows = turn_pieces(segments, staff, block_seconds)
    order = ["start_sec", "seg_no", "piece_no"]
    rows = rows.withColumn("mine", F.when(F.col("new"), F.struct(*order)))
    rows = blockwise_fill(rows, ["doc_id"], order, "mine", "turn")
    joined = lambda place, words: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*place, words))), lambda x: x[words]), " ")
    parts = rows.groupBy("doc_id", "turn", BLOCK).agg(F.first("who").alias("speaker"), F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"), F.count(F.lit(1)).alias("n_pieces"), joined(order, "words").alias("part"))
    whole = parts.groupBy("doc_id", "turn").agg(F.first("speaker").alias("speaker"), F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"), F.sum("n_pieces").alias("n_pieces"), joined([BLOCK], "part").alias("text"))
    return whole.select("doc_id", F.col("turn.seg_no").alias("turn_seg"), F.col("turn.piece_no").alias("turn_piece"), "speaker", "start_sec", "end_sec", "n_pieces", "text")
