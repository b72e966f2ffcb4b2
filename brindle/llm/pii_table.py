"""The labelled table of problem 1: marked sentences, made by a rule.

A row is a text with its marked parts: [(part, type or None), ...]. The sentences
around the marked parts (carriers) are about offices, schools, clubs, trains and
gardens and were written for this table alone; names, places and odd words are
put together from syllables. Some words of every text give way to such odd
words, so that the model can't lean on a vocabulary.

Every fifth carrier and every fifth name is kept for rows with held=True, which
no training sees: what is measured on them is told by no carrier and no name
that the model knows.
"""

from __future__ import annotations

import random
import re

GIVEN = "Arlo Benita Cyrus Delphine Edda Fabrizio Greta Hamza Ingrid Jasper Katya Leander Maribel Nikolai Orla Priya Quentin Rosalind Stellan Tamsin Umberto Viola Winston Xenia Yusuf Zelda Anna Peter Maria Thomas Julie Henrik Carmen Pablo Heike Noah Chloe Ahmed Mei Olga Ruth Simon Laura Felix Nadia Oscar Irene Hugo Paula Erik Sofia Martin Claire Diego Ursula Kofi Aiko Ravi Elena Jonas Marta Louis Amira Bruno".split()
NOUNS = "garden heater library umbrella engine lesson museum recipe violin bridge turbine kettle notebook planet parcel river orchestra bakery pension lantern meadow harbour telescope curtain saddle piano chimney pottery festival ladder compass blanket sculpture fountain cinema barrel helmet window carpet mirror candle basket hammer journal pocket ticket winter summer bicycle tunnel island castle picnic drawer poster teapot balcony cellar magnet feather pillow rocket anchor cabin dinner button pencil folder printer server keyboard backup network password calendar meeting budget report contract project account ledger payment price stock carrier depot yard shelf pallet truck forklift counter desk badge locker canteen shift team branch client order item batch label quote claim refund voucher survey form screen menu tab field table chart page list queue rule filter export update release".split()
ADJECTIVES = "green quiet broken late heavy northern spare wooden shiny narrow early cheap modern hollow gentle daily second missing empty open final local regional temporary double wrong blank".split()
VERBS = "repair open close paint count weigh copy water print move test clean borrow return lock publish sort label charge cancel refresh replace update print review merge delete approve block archive".split()
ROLES = "gardener librarian conductor caretaker lifeguard baker plumber referee translator surveyor archivist janitor cashier tutor usher steward foreman clerk planner operator supervisor controller crew".split()
BACKGROUND = [
    "The {a} {n} beneath the {n} has been {a} since Tuesday.", "Please {v} the {n} and {v} the {n} twice.",
    "{Qty} visitors came to the {n} {n}, {qty} of them with a {n}.", "Why is the {n} {a} when nobody wants to {v} it?",
    "1. {V} the {n}.\n2. {V} the {n}.\n3. {V} the {n} in {Prod}.", "- {n} {n}\n- {a} {n}\n- {Prod}", "| {n} | {n} | {n} |\n| --- | --- | --- |\n| {n4} | {a} | {qty} |",
    "{N} {n}: {a}", "{N}: {ref}", "{N} {n}: {ref}\n{N}: {a}", "{Prod} > {N} > {n}", "{Prod} | {n} {n} | {ref}", "# {Prod}\n\nThe {n} is {a}.",
    "The {role} told us that the {n} cannot be opened before {clock}.", "Ask the {role} for a {n}.", "Thanks to the {role} of the {n}.",
    "the {role} has to {v} {qty} {n}s by {clock}", "A {n} with {qty} {n}s was {a}, and the {role} needed to {v} it.", "Every {n} needs a {n}; the {a} one stays {a}.",
    "In {Prod} you can {v} a {n}, {v} a {n} or {v} both.", "Open {Prod}, choose {N} and {v} the {a} {n}.", "How can I {v} a {n} in {Prod}?",
    "{Prod} shows a {n} where {Prod} shows none.", "The new version of {Prod} cannot {v} {n}s.", "{Prod} and {Prod} were both {a} at {clock}.",
    "Does {Prod} {v} the {n} by itself?", "I would like to {v} the {n} of {Prod}, what is missing?",
    "Problem {n5}: the {n} did not {v}.", "Code {n4} stands for a {a} {n}, code {n5} for none.", "Case {ref} has been open since the {a} {n}.",
    "{ref} is a {n} for {qty} {n}s.", "We measured {qty} at {clock} and {qty} at {clock}.", "Between {clock} and {clock} the {n} of {P} was closed.",
    "On {date} the {n} went to {P} and came back on {date}.", "{P} has a {n}, {P} has two.",
    "um now we {v} the {n} and then uh we {v} the {n}, right", "okay so here you see the {n}, and now I {v} it", "[00:{n2}] and this {n} is {a}",
    "well it was {a} in {P}, everybody saw the {n}", "you simply {v} it. then the {n} is {a}.",
    "NOTICE: THE {NN} OF THE {NN} IS CLOSED", "WHO WILL {VV} THE {NN}", "{Prod} Guide, Chapter {n1}", "{N} {N} {n1}", "Chapter {n2}: {N} and {N}",
    "Table {n1}-{n1}: {N} by {n}", "<b>{N}</b> {a} &amp; {a}", "SELECT {n}, {n} FROM {n} WHERE {n} > {n3}", "`{n}_{n}` = {n4}", "```\n{v} {n} --{n} {n2}\n```",
    "https://{w}.example/{n}/{n}?id={n5}",
    "Der {W} ist seit gestern {w}, deshalb wird das {W} morgen {w}.", "Bitte den {W} {w} und die {W} nochmals {w}.",
    "Warum lässt sich {Prod} nicht {w}, obwohl {ref} {w} ist?", "In {P} wurden um {clock} Uhr {qty} {W} {w}.", "Die {W} von {P} hat {qty} {W}, das {W} keine.",
    "Unter {N} steht {ref}, danach folgt die {W}.", "Wer kann mir die {W} erklären?", "Nein, das {W} gehört in {Prod}.",
    "Le {w} est {w} depuis hier et la {w} reste fermée.", "Veuillez {w} le {w} avant {clock}, puis {w} la {w}.",
    "Comment se fait-il que {Prod} ne puisse pas {w} les {w} ?", "À {P}, {qty} {w} attendaient devant le {w}.", "Le dossier {ref} contient {qty} {w}.",
    "Dans {Prod}, on choisit le {w} puis la {w}.", "Qui doit {w} cette {w} ?",
    "El {w} está {w} desde ayer y la {w} sigue cerrada.", "Hay que {w} el {w} antes de las {clock} y luego {w} la {w}.", "¿Por qué no puede {Prod} {w} los {w}?",
    "En {P} esperaban {qty} {w} delante del {w}.", "El expediente {ref} contiene {qty} {w}.", "En {Prod} se elige el {w} y después la {w}.", "¿Quién debe {w} esta {w}?",
    "yes", "No.", "ok, done", "Any other ideas?", "See above.", "n/a", "{n} {n} {n}", "{a} {n}", "{N}", "{N} {n}", "{Prod}", "{Prod}.", "{W} {w} {w} {W}.",
    "{w} {w} {w} {w} {w}", "{w}, {w} and {w}", "{ref} {ref}", "{qty} {n}s", "{N} {qty}", "The {W} {w} {w} {w} the {w}.", "{W} {w} {w} in {W}, {w} {w} {clock}.",
]
#: Things that look alike.
DECOYS = [
    "model {n3}-{n3}-{n4} of the {n}", "Model {n3}-{n2}-{n4} comes in {a}.", "catalogue no. {n3}-{n2}-{n4}", "Catalogue no. {n9} is out of print.",
    "receipt {n9} over {qty}", "receipt number {n10}", "Lot {n10}, {qty} kg", "bar code {n10}{n3}", "SKU {n3} {n2} {n4} in {a}", "Series {n4}-{n4}-{n4} ended.",
    "edition {n1}.{n1}.{n1} of {Prod}", "build {n5}, edition {n1}.{n2}", "server 10.{n2}.{n1}.{n2} answers", "host 192.168.{n1}.{n2}", "{date} {clock}",
    "{n4}-{n2}-{n2}T{clock}:00", "{n2}° {n2}' north",
    "the {n} {code} is {a}", "The {a} {n} {code} {w} {w}.", "{N} {code} {w} {w}", "{w} {code} {w}", "{W} {w} {code} {w}", "({code})", "{code}", "{code}: {n}",
    "{n} {code}?", "{w} {w} ({n} {code}).", "for {code}, the {n} {w}", "{Prod} | {n} | {code}", "{N}: {code}", "El {w} {code} {w}", "Der {W} {code} {w}",
    "Le {w} {code} {w}", "{code} {w} in {Prod}", "{v} {code} and {v} {code}", "{code}, {code} and {code}", "{a} {n} {code}",
    "{N} {n3}-{n3}-{n4} is {a}.", "the {n} {n3}-{n3}-{n4} {w}", "{n} no. {n3}-{n3}-{n4}", "{N} {n3} {n3} {n4} {w} {w}", "{n} {n3}-{n4} and {n} {n4}-{n4}", "{n10} {n}s",
    "{N} {n10} {w}.", "{n} {n7} {w} {w}", "{N} {n2} {n3} {n2} {w}",
    "{v} it in {Prod}", "{Prod} is {a}", "{Prod} by {Prod}", "work with {Prod}.", "the {n} of {Prod}", "from {Prod} to {Prod}", "{w} {Prod} {w}", "{W} {Prod} {w} {w}.",
    "{v} {Prod}, then {Prod}", "ask {Prod} for it", "{N} by {Prod}: {n}", "{Prod} {w} {w} {w}", "for {Prod} only", "Then {Prod} {w}.", "{N}: {Prod}",
    "{N} of {Prod}: {ref}", "{n} in {Prod}.", "{Prod} has no {n}", "does {Prod} {w}",
    "bus {n2} stops at gate {n1}", "line {n2} along the north road", "row {n2}, seat {n1}", "shelf {n2}, box {n2}", "aisle {n1}, level {n2}", "Hall {n1}, stand {n2}",
    "room {n3} of the south wing", "the street lamps of {P}", "street music until {clock}", "a road without pavement", "the square in front of the {n}",
    "gate {n1}, dock {n2}, {P}", "exit {n2} of the ring road", "Platform {n1} in {P}", "platform {n2}, track {n1}",
    "tell @all and @here", "@{n} please look", "a mail without a sender", "already hidden: [EMAIL], [PHONE]",
    "[PERSON] wrote to [PERSON] from [ADDRESS] with [ID_NUMBER]", "phone the front desk", "ring the bell at {clock}", "text me later", "the hotline is busy",
    "call before {clock}", "a passport photo", "the identity of the {n}", "tax of {qty} on the {n}", "social events of {P}",
    "the {fam} method", "The {fam} prize goes to {P}.", "the {W} {fam} project", "{W} {fam} is a {n}, not a person", "The {N} {fam} initiative ends in {P}.",
    "{fam} Ltd", "{fam} & {fam} Inc.", "{fam} Street is being paved.", "the {fam} building", "a {fam} report on {n}s", "{N} {fam} {n} guide",
    "In the {fam} Hall at {clock}", "The {N} {fam} plan was late.", "open {N} {fam} and {v} it",
    "the {role} from {P}", "Dear {role},", "Regards, the {role}", "our {a} {role}s", "{N} by: {role}", "from: {role}\nto: {role}", "Thanks, everybody", "Hello team,",
    "cc: {role}s", "Written by the {role} of {P}.", "the {a} {role} on duty", "signed: the {role}",
]
#: Marks and lines around a marked part.
_AROUND = [("", ""), ("", "."), ("(", ")"), ("[ ", " ]"), ("\"", "\""), ("/ ", " /"), ("| ", " |"), ("- ", ""), ("– ", ""), ("— ", ""), ("* ", ""), ("• ", ""), ("→ ",
    ""), ("=> ", "."), ("# ", ""), ("@ ", ""), ("☎ ", ""), ("✉ ", ""), (": ", ""), ("= ", ";"), ("<", ">"), ("; ", ";"), (", ", ",")]
WRAP = {
    "PERSON": [
        "Could {X} take a look?", "{X} wrote back this morning.", "I had {X} on the line.", "According to {X}, nothing is lost.", "Forwarded by {X}", "signed, {X}",
        "Yours sincerely,\n{X}", "Best,\n{X}", "Greetings from {X}", "Requested for {X}", "Attendees: {X}", "Hello {X},", "Dear {X},", "Hi {X}, any news?",
        "on the desk of {X}", "let {X} know", "handed to {X} at noon", "as {X} said,", "{X} and some others", "together with {X}", "We met {X} in the hall.",
        "made by {X} in spring", "Employee: {X}", "full name: {X}", "Approver - {X}", "{X} has no rights", "{X} reports a leak", "{X}: thanks a lot", "{X} is ill",
        "{X} moved to {P}.", "{X} from {P}", "for {X} only", "it belongs to {X}.", "{X}'s {n}", "Has {X} been told?", "did {X} answer", "{X} cannot come",
        "the manager is {X}.", "Meet {X}, our new {role}.", "{role} {X}", "{X} ({role})", "{X}, {role}", "{N}: {X}", "{N} by: {X}", "{N} {n}: {X}", "{v} it with {X}",
        "{w} {w} {X} {w} {w}.", "{w} {X}.", "{W} {X}", "{X} {w} {w}", "as seen by {X}, {w}", "Thank you {X}!", "sent to {X} on {date}", "{clock} {X}",
        "Viele Grüße\n{X}", "Hallo {X},", "Bitte an {X} wenden.", "{X} ist krank.", "laut {X}", "Bonjour {X},", "Merci, {X}", "selon {X},", "{X} est absent",
        "Hola {X},", "Gracias, {X}", "según {X}", "{X} no vino", "Un saludo\n{X}", "signed by {X}", "thanks to {X}", "ask {X} first", "with {X}", "by {X}, {date}",
        "from {X}", "to: {X}", "call {X}, please", "a letter by {X}", "regards,\n{X}", "thank you, {X}", "{X} told me so", "{X} said no", "{X} has left", "{X} is away",
        "{X} will be there", "ask for {X}", "a note from {X}", "the {n} of {X}", "I am {X}.", "this is {X} speaking", "Mit Gruß\n{X}", "von {X}", "de {X}", "por {X}",
        "chair: {X}", "author: {X}", "author {X}", "reviewed by {X}", "approved: {X}", "who is {X}?", "tell {X} the news", "sent by {X}", "{X} wants to {v} it",
    ],
    "EMAIL": ["write to {X}", "mail {X} first", "My mailbox is {X}.", "no reply from {X} yet", "sent from {X} at {clock}", "e-mail: {X}", "From: {X}", "To: {X}",
        "bcc {X}", "mailto:{X}", "{X} is full", "{X} bounced", "forward it to {X}, thanks", "use {X} instead of the form", "{N}: {X}", "{w} {X} {w}", "{w}={X}",
        "{w}:{X}", "questions? {X}", "schreiben Sie an {X}", "écrivez à {X}", "escriba a {X}", "{X} or the front desk", "login {X}", "ask {X} for a copy", "{w} <{X}>",
        "subscribe {X} to {Prod}", "and also {X}"],
    "PHONE": ["ring me on {X}", "phone: {X}", "Tel {X}", "tel. {X}", "tel:{X}", "mobile {X}", "Mobile: {X}", "fax {X}", "call {X} before {clock}", "my number is {X}.",
        "dial {X}", "reach us at {X}", "text to {X}", "{X} is engaged", "nobody answers {X}", "{N}: {X}", "{w}:{X}", "Telefon {X}", "unter {X} erreichbar",
        "appelez le {X}", "llame al {X}", "WhatsApp {X}", "on {X}, after six", "{X} (office)", "my private phone is {X}", "the switchboard, {X}, is closed",
        "emergency: {X}", "and also {X}", "at {X} please", "the phone there is {X}", "phone number {X}", "please call {X}", "call back at {X}", "number: {X}",
        "mobile number {X}", "home phone {X}", "fax number: {X}", "her mobile is {X}", "you may phone {X}", "ring {X} twice", "hotline: {X}", "the hotline is {X}",
        "telephone {X}", "Telefon: {X}", "dial {X} and wait", "text {X} first", "they dialled {X} twice", "a call to {X}", "that number, {X}, is wrong",
        "phone {X} or write", "no one picks up at {X}", "fax: {X}", "Telephone: {X}", "mobile: {X}, office closed", "call me, {X}"],
    "ID_NUMBER": ["{K} {X}", "{K}: {X}", "{K}={X}", "{K} #{X}", "{K}#{X}", "({K} {X})", "{K} = {X};", "her {K} was {X}.", "{K}, {X},", "{K} no. {X}", "{K} number {X}",
        "{K} is {X}", "with {K} {X} at the border", "{w} {K} {X} {w}", "{N}: {K} {X}", "{K} of the applicant: {X}", "please note {K} {X}.", "valid {K} {X}", "{K} - {X}"],
    "ADDRESS": ["we moved to {X}.", "lives at {X}", "residence: {X}", "Address {X}", "mail it to {X}", "the new flat is {X}", "born at {X}, raised elsewhere",
        "pick me up at {X}", "the parcel went to {X} again", "near {X}", "taxi to {X} at {clock}", "{N}: {X}", "{w} {X} {w}", "{w} at {X}.", "wohnt in {X}",
        "habite {X}", "vive en {X}", "from {X} to the {n}", "{X} has no lift", "the keys of {X}", "visit us: {X}", "bill for {X}", "{X} was sold", "I grew up in {X}.",
        "{n} delivery: {X}", "and also {X}"],
}
TITLES = ["Mr", "Mrs", "Ms", "Dr", "Mr.", "Mrs.", "Ms.", "Dr.", "Herr", "Frau", "Señora", "Señor", "Sra.", "Sr.", "Mme", "M.", "Monsieur", "Madame", "Prof."]
ID_WORDS = {"ssn": ["SSN", "social security number", "social security"], "ni": ["NI number", "national insurance number", "national insurance"], "pass": ["passport",
    "passport no.", "Reisepass"], "tax": ["tax ID", "tax number", "Steuer-ID", "TIN"], "card": ["identity card no.", "identity card", "ID card", "Ausweis", "DNI", "NIF"]}
_ONSETS = "b bl br c ch cl d dr f fl g gl gr h j k kl kr l m n p pl pr qu r s sch sh sl sp st t th tr v w z".split()
_NUCLEI = "a e i o u a e i o ai ea ee ie oo ou ü é".split()
_CODAS = ["", "", "n", "r", "l", "m", "s", "t", "nd", "rk", "ss", "ck", "ng", "st"]


def _pick(r: random.Random, xs: list, held: bool):
    """Every fifth entry belongs to the held-out rows."""
    own = [x for i, x in enumerate(xs) if (i % 5 == 4) == held]
    return r.choice(own or xs)


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _made_up(r: random.Random, most: int) -> str:
    return "".join(r.choice(_ONSETS) + r.choice(_NUCLEI) + r.choice(_CODAS) for _ in range(r.randint(1, most)))


#: Words of no meaning; the model is not told one from another.
ODD = sorted({_made_up(random.Random(i), 3) for i in range(2500)})


def odd_word(r: random.Random) -> str:
    return r.choice(ODD)


def _families() -> list[str]:
    r = random.Random(71)
    ends = ["", "", "son", "berg", "ez", "ini", "ov", "ski", "wood", "ley", "ton", "mann", "eau", "ström", "field"]
    made = [(_made_up(r, 2) + r.choice(ends)).capitalize() for _ in range(150)]
    made += [f"{a}-{b}" for a, b in zip(made[:12], made[20:32])] + ["O'" + x for x in made[40:46]] + [x.capitalize() for x in NOUNS[::4]]
    return sorted({x for x in made if len(x) > 2})


FAMILY = _families()


def directory() -> tuple[list[str], list[str]]:
    """The given and family names that stand in the directory while the model is trained: all but every fourth, and all that are common words."""
    common = {x.capitalize() for x in NOUNS}
    return tuple([x for i, x in enumerate(names) if i % 4 != 3 or x in common] for names in (GIVEN, FAMILY))


LISTED = directory()


def _fill(r: random.Random, text: str, held: bool = False) -> str:
    noun = lambda: r.choice(NOUNS)

    def product() -> str:
        word = lambda: (r.choice(NOUNS[::4]) if r.random() < 0.35 else noun() if r.random() < 0.7 else odd_word(r)).capitalize()
        return f"{word()} {word()}" if r.random() < 0.85 else r.choice([word(), f"{word()} {word()} {word()}"])

    def one(key: str) -> str:
        if key[0] == "n" and key[1:].isdigit():
            return r.choice("123456789") + _digits(r, int(key[1:]) - 1)
        number = lambda: r.choice([_digits(r, r.randint(1, 4)), f"{_digits(r, 2)},{_digits(r, 3)}", f"{_digits(r, r.randint(1, 4))}.{_digits(r, 2)}"])
        return {
            "n": noun, "N": lambda: noun().capitalize(), "NN": lambda: noun().upper(), "a": lambda: r.choice(ADJECTIVES), "v": lambda: r.choice(VERBS), "V": lambda: r.choice(VERBS).capitalize(), "VV": lambda: r.choice(VERBS).upper(), "w": lambda: odd_word(r), "W": lambda: odd_word(r).capitalize(),
            "Prod": product, "P": lambda: odd_word(r).capitalize() + r.choice(["", "stad", "ville", "ham", "burg", "by"]), "role": lambda: r.choice([r.choice(ROLES),
                f"{noun()} {r.choice(ROLES)}"]), "fam": lambda: _pick(r, FAMILY, held), "qty": number, "Qty": number,
            "code": lambda: r.choice([lambda: _identity(r)[1], lambda: f"{odd_word(r).upper()[:3]}{_digits(r, r.randint(5, 9))}", lambda: f"{odd_word(r).upper()[:2]}{_digits(r, r.randint(6, 7))}"])(),
            "ref": lambda: r.choice([f"{odd_word(r).upper()[:3]}{_digits(r, r.randint(4, 8))}", f"{odd_word(r).upper()[:3]}-{_digits(r, r.randint(3, 6))}", _digits(r, r.randint(6, 10)), f"{_digits(r, 5)}/{_digits(r, 4)}", f"{r.choice('ABCDEFGHKRSTX')}{_digits(r, 6)}"]),
            "clock": lambda: f"{r.randint(0, 23)}:{r.randint(0, 59):02d}", "date": lambda: r.choice([f"20{_digits(r, 2)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}",
                f"{r.randint(1, 28)}.{r.randint(1, 12)}.20{_digits(r, 2)}", f"{r.randint(1, 28)}/{r.randint(1, 12)}/{_digits(r, 2)}"]),
        }[key]()

    out, rest = [], text
    while "{" in rest:
        a = rest.index("{")
        z = rest.index("}", a)
        out += [rest[:a], one(rest[a + 1 : z])]
        rest = rest[z + 1 :]
    return "".join(out) + rest


def _loosened(r: random.Random, text: str, part: float = 0.12) -> str:
    """Some small words give way to odd ones."""
    return re.sub(r"(?<![\w@./:-])[a-z]{4,}(?![\w@./:-])", lambda m: odd_word(r) if r.random() < part else m.group(), text)


def _person(r: random.Random, held: bool, told: bool) -> str:
    """told: the carrier tells that it is a person, so it may be somebody whom no list has."""
    listed = r.random() < 0.6
    g, f = _pick(r, LISTED[0] if listed or not told else GIVEN, held), _pick(r, LISTED[1] if listed else FAMILY, held)
    odd = told and not listed and r.random() < 0.3
    if odd:
        g, f = r.choice([(odd_word(r).capitalize(), f), (g, odd_word(r).capitalize())])
    middle = r.choice("ABCDEFGHIJKLMNOPQRSTUVWZ")
    name = r.choice([f"{g} {f}"] * 5 + [f"{g} {middle}. {f}", f"{f}, {g}", f"{f}, {g}", f"{g[0]}. {f}", f"{g[0]}. {f}", f"{r.choice(TITLES)} {f}", f"{r.choice(TITLES)} {f}", f"{r.choice(TITLES)} {g} {f}", f"{f}, {g[0]}."])
    # a name without capitals can be told where the directory has it
    return r.choice([name] * 5 + [name.upper(), name.lower() if listed else name])


def _email(r: random.Random, held: bool) -> str:
    g, f = _pick(r, GIVEN, held).lower(), _pick(r, FAMILY, held).lower().replace("'", "")
    word = lambda: r.choice(NOUNS) if r.random() < 0.6 else odd_word(r).replace("ü", "u").replace("é", "e")
    box = r.choice([word(), f"{word()}{r.choice('._+-')}{word()}", f"{word()}{_digits(r, r.randint(1, 4))}", f"{word()}{r.choice('_-')}{_digits(r, 1)}"])
    local = r.choice([f"{g}.{f}", f"{g[0]}{f}", f"{f}_{g}", f"{g}{_digits(r, r.randint(1, 2))}", f"{g}.{f}+{word()}", f"{g}-{f}", box, box, f"{f}.{g}", f"{g}"])
    host = r.choice([word(), f"{word()}-{word()}", f"{word()}.{word()}", f"{word()}{_digits(r, 1)}", "example", "post.example"])
    domain = host + "." + r.choice("com org net example test invalid de fr es eu co.uk io".split())
    way = r.random()
    if way < 0.55:
        mail = f"{local}@{domain}"
    else:
        at = r.choice([" (at) ", " [at] ", " {at} ", "(at)", "[at]", " at ", " AT "])
        dot = r.choice([" (dot) ", " [dot] ", " dot ", "."]) if at.strip(" ").lower() != "at" else " dot "
        mail = local + at + domain.replace(".", dot)
        if r.random() < 0.3:
            mail = local.replace(".", dot) + at + domain.replace(".", dot)
    return r.choice([mail] * 7 + [mail.upper()])


def _phone(r: random.Random, held: bool, told: bool) -> str:
    """told: the carrier tells that it is a phone number, so it may have any form."""
    d = lambda n: _digits(r, n)
    short = r.choice([f"{d(3)}-{d(4)}", f"{d(3)} {d(4)}", f"{d(2)} {d(2)} {d(2)} {d(2)}", f"{d(4)} {d(4)}", f"{d(5)} {d(3)}", f"{d(7)}", f"{d(6)}", f"{d(3)}.{d(3)}.{d(2)}"])
    area = r.choice([f"({d(3)}) ", f"0{d(2)}/", f"0{d(3)} ", f"{d(3)}-", f"{d(3)}.", f"0{d(2)}-", f"({d(2)}) "])
    whole = r.choice([
        area + short, area + short, f"+{d(2)} {d(2)} {short}", f"+{d(2)} {d(3)} {short}", f"+{d(2)} (0){d(2)} {short}", f"+1 ({d(3)}) {d(3)}-{d(4)}", f"+1 {d(3)} {d(3)} {d(4)}", f"+1-{d(3)}-{d(3)}-{d(4)}", f"+1 {d(3)}.{d(3)}.{d(4)}", f"00{d(2)} {d(3)} {short}", f"00{d(r.randint(10, 12))}", f"+{d(r.randint(10, 12))}",
        f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)} {d(3)} {d(4)}", f"0{d(3)} {d(7)}", f"0{d(4)} {d(6)}", f"0{d(3)} {d(3)} {d(4)}", f"0{d(2)} {d(4)} {d(4)}", f"+{d(2)} {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}",
    ])
    if not told and whole[0] not in "+(0":
        whole = "+" + whole
    return whole + (f" {r.choice(['ext.', 'ext', 'x'])} {d(r.randint(2, 4))}" if r.random() < 0.07 else "")


def _identity(r: random.Random) -> tuple[str, str]:
    kind = r.choice(list(ID_WORDS))
    d = lambda n: _digits(r, n)
    letter = lambda: r.choice("ABCDEFGHJKLMNPQRSTXYZ")
    mixed = "".join(r.choice([letter(), d(1), d(1)]) for _ in range(r.randint(7, 9))) + d(2)
    number = {
        "ssn": [f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", d(9)],
        "ni": [f"{letter()}{letter()} {d(2)} {d(2)} {d(2)} {letter()}", f"{letter()}{letter()}{d(6)}{letter()}", f"{letter()}{letter()}-{d(2)}-{d(2)}-{d(2)}-{letter()}"],
        "pass": [f"{letter()}{letter()}{d(7)}", f"{letter()}{d(8)}", d(9), mixed],
        "tax": [f"{d(2)}/{d(3)}/{d(5)}", d(11), f"{d(2)} {d(3)} {d(3)} {d(3)}", f"{d(3)}-{d(3)}-{d(3)}", f"{d(2)}-{d(7)}"],
        "card": [mixed, f"{d(8)}{letter()}", f"{letter()}{d(2)}{letter()}{d(5)}{letter()}{d(1)}", f"{d(8)}-{letter()}"],
    }[kind]
    return r.choice(ID_WORDS[kind]), r.choice(number)


def _address(r: random.Random, held: bool) -> str:
    noun = lambda: (r.choice(NOUNS) if r.random() < 0.5 else odd_word(r)).capitalize()
    stem = r.choice([noun(), f"{noun()} {noun()}", f"Saint {_pick(r, GIVEN, held)}", f"{r.choice('NESW')}. {noun()}", _pick(r, FAMILY, held), f"Old {noun()}", f"{r.randint(1, 9)}th"])
    kind = r.choice(["Street", "Road", "Rd.", "Rd", "Ave", "Ave.", "Avenue", "Blvd", "Boulevard", "Lane", "Close", "Drive", "Way", "St.", "St", "Court", "Terrace",
        "Quay", "Square", "Row", "Hill", "Place", "Crescent", "Gardens", "Parade"])
    german = odd_word(r).capitalize() + r.choice(["gasse", "allee", "weg", "str.", "straße", "platz", "ufer", "ring", "damm", "steig"])
    plain = r.choice(["Am", "An der", "Auf dem", "Hinter der", "Unter den", "Im", "Zum", "Beim"]) + " " + r.choice(["", "Alten ", "Neuen "]) + odd_word(r).capitalize()
    french = r.choice(["rue", "chemin", "allée", "avenue", "boulevard", "quai", "impasse", "place", "cours", "route", "passage"]) + " " + r.choice(["de la ", "du ",
        "des ", "de l'", "Saint-", ""]) + r.choice([noun(), f"{noun()} {noun()}"])
    spanish = r.choice(["Calle", "Avda.", "Avenida", "Camino", "Plaza", "Paseo", "C/", "Ronda", "Travesía"]) + " " + r.choice(["de la ", "del ", "de los ", "de las ",
        "San ", ""]) + r.choice([noun(), f"{noun()} {noun()}"])
    n, zipcode, p = str(r.randint(1, 2999)), _digits(r, 5), odd_word(r).capitalize()
    unit = r.choice(["", "", "", f" #{r.randint(1, 99)}", f", Suite {r.randint(1, 499)}", f", Apt {r.randint(1, 40)}", f", Unit {r.randint(1, 40)}",
        f" No. {r.randint(1, 40)}"])
    town = r.choice(["", f", {p}", f", {p} {zipcode}", f", {zipcode} {p}", f", {p}, {zipcode}"])
    letter, floor = r.choice(["", "", "", "a", "b", " c"]), r.choice(["", "", f", piso {r.randint(1, 9)}", f", {r.randint(1, 9)}º {r.choice('ABCD')}",
        f", {r.randint(1, 9)}.º"])
    return r.choice([
        f"{n}{letter} {stem} {kind}{unit}{town}", f"{n} {stem} {kind}{unit}{town}",
            f"{r.choice(['Flat', 'Apt', 'Unit', 'Apartment'])} {r.randint(1, 40)}, {n} {stem} {kind}{town}", f"{german} {n[:3]}{letter}{town}",
            f"{german} {n[:2]}{letter}, {zipcode} {p}", f"{plain} {n[:3]}{letter}{town}",
        f"{n[:3]}{r.choice(['', ',', ' bis', ' ter', ' bis,'])} {french}{town}", f"{n[:3]}, {french}, {zipcode} {p}", f"{spanish}, {n[:2]}{floor}{town}",
            f"{spanish} {n[:2]}{floor}{town}",
    ])


def labelled_table(rows: int = 11000, seed: int = 11, held: bool = False) -> list[list[tuple[str, str | None]]]:
    """Marked texts; the same for the same arguments. held: rows of the carriers and names that are kept apart."""
    r = random.Random(seed)
    table = []

    def plain() -> str:
        return _loosened(r, _fill(r, _pick(r, BACKGROUND if r.random() < 0.7 else DECOYS, held), held))

    def told(wrap: str) -> bool:
        return bool(re.search(r"[^\W\d_]{2}", re.sub(r"\{\w+\}", " ", wrap)))

    def marked() -> list[tuple[str, str | None]]:
        kind = r.choice(["PERSON", "PERSON", "EMAIL", "PHONE", "ID_NUMBER", "ADDRESS"])
        if r.random() < 0.25 and kind != "ID_NUMBER":
            wrap = ""
            a, z = _pick(r, _AROUND, held)
            if r.random() < 0.3:
                a = _fill(r, "{N}") + a
        else:
            wrap = _pick(r, WRAP[kind], held)
            if kind == "ID_NUMBER":
                word, value = _identity(r)
                wrap = wrap.replace("{K}", word)
            a, z = (_fill(r, x, held) for x in wrap.split("{X}"))
            if kind != "ID_NUMBER":
                a, z = _loosened(r, a), _loosened(r, z)
        if kind != "ID_NUMBER":
            value = {"PERSON": _person, "PHONE": _phone}[kind](r, held, told(wrap)) if kind in ("PERSON", "PHONE") else {"EMAIL": _email, "ADDRESS": _address}[kind](r,
                held)
        return [(a, None), (value, kind), (z, None)]

    for _ in range(rows):
        parts: list[tuple[str, str | None]] = []
        for _ in range(r.choice([1, 2, 2, 3, 3])):
            if parts:
                parts.append((r.choice([" ", " ", " ", "\n", " | ", ". "]), None))
            if r.random() < 0.42:
                parts += marked()
            else:
                text = plain()
                parts.append((r.choice([text] * 12 + [text.upper(), text.lower(), text.rstrip(".?")]), None))
        table.append(parts)
    return table
