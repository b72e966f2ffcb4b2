"""Personal information, conversations, answer defects and speaker turns."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from brindle.llm import conversations, crf, pairs, pii, pii_table, turns
from brindle.llm.bayes import Ends, Languages, end_tokens


@pytest.fixture(scope="module")
def tagger():
    given, family = (frozenset(w for x in names for w in x.lower().replace("'", "-").split("-")) for names in pii_table.LISTED)
    given, family = given | {"selvi", "rufio"}, family | {"yard", "tollerud"}
    return crf.Tagger(pii.trained(given, family), given, family)


def types(tagger, text):
    return sorted({k for _, parts in pii.parts_of([text], tagger) for k, _, _ in parts})


def test_held_out_rows(tagger):
    """Types found in rows whose carriers and names the training has none of."""
    right = wrong = missed = 0
    texts, gold = [], []
    for parts in pii_table.labelled_table(1000, seed=99, held=True):
        texts.append("".join(p for p, _ in parts))
        gold.append({k for _, k in parts if k})
    found = {i: {k for k, _, _ in p} for i, p in pii.parts_of(texts, tagger)}
    for i, want in enumerate(gold):
        have = found.get(i, set())
        right, wrong, missed = right + len(have & want), wrong + len(have - want), missed + len(want - have)
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.92


def test_held_out_carriers_and_names_are_in_no_training_row():
    r = random.Random(1)
    carriers = [{pii_table._pick(r, xs, held) for _ in range(3000)} for held in (False, True) for xs in [pii_table.WRAP["PERSON"] + pii_table.BACKGROUND]]
    assert not carriers[0] & carriers[1]
    for names in (pii_table.GIVEN, pii_table.FAMILY):
        assert not {pii_table._pick(r, names, False) for _ in range(3000)} & {pii_table._pick(r, names, True) for _ in range(3000)}


@pytest.mark.parametrize(
    "text,kinds",
    [
        ("Write to no-reply (at) mail (dot) example (dot) net please.", ["EMAIL"]), ("Hotline +44 20 7946 0138 did not pick up.", ["PHONE"]), ("SSN: 906-32-4037", ["ID_NUMBER"]), ("I now live at 2373 Larkmoor Street, Vesterlund.", ["ADDRESS"]),
        ("The badge of SELVI YARD no longer opens the cage.", ["PERSON"]), ("Thanks Rufio Tollerud", ["PERSON"]), ("Please ask Dr. Tollerud about it.", ["PERSON"]), ("Material 555-123-3553 is on hold.", []), ("Use the @mention in the channel, not mail.", []),
        ("Already masked: [EMAIL] and [PHONE].", []), ("Route 76 uses gate 3 on the north road.", []), ("Look in aisle 13, bay 82.", []), ("The Juniper Yard project starts in May.", []), ("Open the worklist of Yard Board.", []), ("", []), ("Part no. 998-57-7194 fits both racks.", []),
    ],
)
def test_types(tagger, text, kinds):
    assert types(tagger, text) == kinds


def test_pruned_decoding_equals_whole_chains(tagger):
    texts = ["".join(p for p, _ in parts) for parts in pii_table.labelled_table(150, seed=5, held=True)]
    pruned = {i: x.tolist() for i, x in tagger.tag(texts)}
    bound, tagger.bound = tagger.bound, 1e9
    whole = {i: x.tolist() for i, x in tagger.tag(texts)}
    tagger.bound = bound
    assert pruned == whole


def test_redaction_keeps_the_rest(spark):
    staff = spark.createDataFrame([("Selvi", "Yard"), (None, None)], "given_name string, family_name string")
    finder = pii.Finder(staff)
    long = "The kit list was posted twice. " * 3000 + "Reply to a.b@example.org before noon."
    df = spark.createDataFrame([(1, "Call me back on +44 20 7946 0138. Regards, Selvi Yard"), (2, None), (3, " "), (4, long), (4, long)], "id int, content string")
    got = sorted(((r["id"], r["r"]["text"], r["r"]["types"]) for r in df.select("id", finder.redacted(F.col("content")).alias("r")).collect()), key=lambda x: x[0])
    assert got[0][1:] == ("Call me back on [PHONE]. Regards, [PERSON]", ["PERSON", "PHONE"])
    assert got[1][1] is None and got[2][1] == " " and got[1][2] == got[2][2] == []
    assert got[3] == got[4] and got[3][1] == long.replace("a.b@example.org", "[EMAIL]")
    assert finder.types(df.limit(0), ["id"], F.col("content")).count() == 0
    assert finder.types(df.withColumn("__extra", F.lit(1)), ["id"], F.col("content")).count() == 4
    empty = pii.Finder(staff.limit(0))
    assert empty.types(df, ["id"], F.col("content")).where("pii_type = 'EMAIL'").count() == 2


MESSAGES = "id long, conversation_id string, role string, content string, created_at timestamp_ntz, status string"
T0 = datetime(2024, 1, 1)


def chat(spark, rows, extra=""):
    """rows: (conversation, role, content, minute)."""
    return spark.createDataFrame([(i, c, r, t, T0 + timedelta(minutes=m) if m is not None else None, "answered") for i, (c, r, t, m) in enumerate(rows)], MESSAGES)


def test_kahn():
    nodes = [(3, "c"), (1, "a"), (2, "b"), (2, "d"), (5, "x"), (6, "y"), (7, "z")]
    order, left = conversations.kahn(nodes, {"b": "a", "c": "a", "d": "c", "x": "y", "y": "x", "z": "x"})
    assert [i for _, i in order] == ["a", "b", "c", "d"] and [i for _, i in left] == ["x", "y", "z"]


def test_reasons(spark):
    rows = [
        ("ok", "User", "q", 0), ("ok", " bot", "a", 1), ("ok", "system", None, 2), ("ok", "user", "q", 3), ("ok", "user", "q", 3), ("ok", "AI", "a", 900),
        ("empty", "user", " ", 0), ("empty", "assistant", None, 1), ("empty", "system", "hello", 2), ("system only", "system", "x", 0), ("role", "user", "q", 0), ("role", "???", "a", 1), ("null role", None, "q", 0), ("null role", "user", "q", 1),
        ("unknown id", "user", "q", 0), ("unknown id", "assistant", "a", 1), ("answer first", "assistant", "a", 0), ("two answers", "user", "q", 0), ("two answers", "assistant", "a", 1), ("two answers", "assistant", "b", 1),
        ("no reply", "user", "q", 0), ("stand-in", "user", "q", 0), ("stand-in", "assistant", "N/A", 1), ("two questions", "user", "q", 0), ("two questions", "user", "r", 1), ("two questions", "assistant", "a", 2), (None, "user", "q", 0),
        ("late", "assistant", "a", None), ("tie", "user", "q", 5), ("tie", "assistant", "a", 5),
    ]
    m = chat(spark, rows)
    c = spark.createDataFrame([(x,) for x in {r[0] for r in rows} - {"unknown id", None} | {"bare"}] + [("ok",)], "conversation_id string")
    want = {"empty": "empty", "system only": "empty", "bare": "empty", "role": "broken", "null role": "broken", "unknown id": "broken", "answer first": "broken", "two answers": "broken", "no reply": "missing_reply", "stand-in": "missing_reply", "two questions": "missing_reply", None: "broken", "late": "broken"}
    for seconds in (30, 6 * 3600):
        got = conversations.conversation_reasons(c, m, block_seconds=seconds).collect()
        assert {r["conversation_id"]: r["reason"] for r in got} == want and len(got) == len(want)
        kept = conversations.rebuilt(c, m, block_seconds=seconds).orderBy("conversation_id", "turn_no").collect()
        assert [(r["conversation_id"], r["turn_no"], r["role"]) for r in kept] == [("ok", 1, "user"), ("ok", 2, "assistant"), ("ok", 3, "user"), ("ok", 4, "assistant"), ("tie", 1, "user"), ("tie", 2, "assistant")]
    assert {r["reason"] for r in conversations.conversation_reasons(c, m.limit(0)).collect()} == {"empty"}
    assert conversations.conversation_reasons(c.limit(0), m.limit(0)).count() == 0
    clash = m.withColumn("block", F.lit(1)).withColumn("parent", F.lit("x")).withColumn("kept", F.lit(2)).withColumn("says", F.lit(2))
    assert conversations.conversation_reasons(c, clash).count() == len(want)


def test_explicit_replies_with_a_cycle(spark):
    m = chat(spark, [("a", "user", "q", 0), ("a", "assistant", "a", 1), ("b", "user", "q", 0), ("b", "assistant", "a", 1)]).withColumn("re", F.expr("CASE id WHEN 1 THEN 0 WHEN 2 THEN 3 WHEN 3 THEN 2 END"))
    c = spark.createDataFrame([("a",), ("b",)], "conversation_id string")
    assert [(r["conversation_id"], r["reason"]) for r in conversations.conversation_reasons(c, m, reply_to="re").collect()] == [("b", "broken")]


def test_replies_across_blocks(spark):
    """The order and what is left over do not depend on blocks: a parent in a later one, a cycle over two, a parent that is nowhere."""
    r = random.Random(9)
    rows, replies = [], {}
    for c in range(12):
        first = len(rows)
        n = r.randint(2, 25)
        for k in range(n):
            rows.append((f"c{c}", r.choice(["user", "assistant"]), f"m{len(rows)}", r.choice([None, *range(0, 3000, 100)])))
            if k and r.random() < 0.7:
                replies[len(rows) - 1] = r.randint(first, first + n - 1) if c % 3 == 0 else r.randint(first, len(rows) - 2)
    replies[5] = 10**6
    m = chat(spark, rows)
    m = m.join(spark.createDataFrame(sorted(replies.items()), "id long, re long"), "id", "left")
    time = {i: (-(2**62) if t is None else t, i) for i, (_, _, _, t) in enumerate(rows)}
    want = {}
    for c in {x[0] for x in rows}:
        ids = [i for i, x in enumerate(rows) if x[0] == c]
        order, left = conversations.kahn([time[i] for i in ids], {i: replies.get(i) for i in ids})
        want[c] = ([i for _, i in order], {i for _, i in left})
    assert any(left for _, left in want.values())
    for seconds in (60, 6 * 3600, 10**7):
        got = conversations.ordered_messages(m, "re", seconds).orderBy("conversation_id", "__block", "place").collect()
        for c, (order, left) in want.items():
            assert [x["id"] for x in got if x["conversation_id"] == c and not x["cyclic"]] == order
            assert {x["id"] for x in got if x["conversation_id"] == c and x["cyclic"]} == left


ENGLISH = ["The purchase order was blocked by a tolerance check after the update.", "Open the worklist, look for the entry and change the document type.", "How do I move stock between two plants without changing the order?"] * 4
GERMAN = ["Die Rechnung wurde doppelt gebucht, weil der Vertrag abgelaufen war.", "Sie können den Nummernkreis erweitern, sobald der Beleg nicht mehr bearbeitet wird.", "Warum erscheint die Meldung, wenn ich den Vorgang speichern möchte?"] * 4


def test_defects(spark):
    q = "How do I move stock between two plants?"
    good = "Open the worklist, look for the entry and change the document type."
    rows = [("c", "user", q, 0), ("c", "assistant", good, 1), ("c", "user", q, 2), ("c", "assistant", "<br/>", 3), ("c", "user", q, 4), ("c", "assistant", None, 5), ("c", "user", q, 6), ("c", "assistant", "I'm sorry, but I cannot assist with this request.", 7)]
    rows += [("c", "user", q, 8), ("c", "assistant", f"You asked: {q}", 9), ("c", "user", q, 10), ("c", "assistant", q.upper(), 11), ("c", "user", q, 12), ("c", "assistant", GERMAN[0], 13), ("c", "user", q, 14), ("c", "assistant", "Open the worklist, look for the entry and the", 15)]
    rows += [("c", "user", q, 16), ("c", "assistant", good + ' The screen then shows "I cannot process this request".', 17), ("c", "user", q, 18), ("c", "assistant", f"{q} {good}", 19), ("c", "assistant", "", 20), ("d", "user", None, 0), ("d", "assistant", good, 1), ("d", "system", "x", 2), ("d", "user", q, 3), ("d", "system", "x", 4), ("d", "assistant", good + "\n```\nSELECT 1", 5)]
    fill = [(f"f{i}", role, t, i) for i, t in enumerate(f"{x} {t}" for x in (a + b for a in "abcdefghij" for b in "klmnopqrst") for t in ENGLISH[:3]) for role in ("user", "assistant")]
    m = chat(spark, rows + fill)
    docs = spark.createDataFrame([("en", t) for t in ENGLISH] + [("DE ", t) for t in GERMAN] + [(None, "x"), ("en", None)], "lang string, text string")
    got = {r["id"]: r["defect"] for r in pairs.defects(m, docs).where(f"id < {len(rows)}").collect()}
    assert got == {3: "empty", 5: "empty", 7: "refusal", 9: "copies_question", 11: "copies_question", 13: "other_language", 15: "truncated", 26: "truncated"}
    assert pairs.defects(m.withColumn("status", F.lit("escalate")), docs).count() == 0
    assert pairs.defects(m.limit(0), docs.limit(0)).count() == 0


def test_language_posteriors():
    model = Languages([("en", t) for t in ENGLISH] + [("de", t) for t in GERMAN])
    assert pairs.differs("Where can I change the document type of an order?", "Die Bestellung wurde gesperrt, weil der Beleg fehlt.", model)
    assert not pairs.differs("Where can I change it?", 'The message reads "Die Rechnung wurde doppelt gebucht" on the screen.', model)
    assert not pairs.differs("", "x", model) and not pairs.differs("abc", "def", Languages([]))


def test_copies():
    q = "how do i move stock between two plants".split()
    assert pairs.copies(q, q + q) and pairs.copies(q, ["you", "asked", *q]) and pairs.copies(q + ["my", "name", "is", "x"], q)
    assert not pairs.copies(q, q + ["open", "the", "list"]) and not pairs.copies(q, ["two", "plants"]) and not pairs.copies([], [])


def test_ends():
    model = Ends([t for t in ENGLISH for _ in range(20)])
    assert not pairs.unfinished("We change the document type.", model)
    assert pairs.unfinished("To change the type:\n1. Open the worklist\n2.", model) and pairs.unfinished("Look for (see the order", model) and pairs.unfinished("Open the", model)


def test_ends_are_counted_over_all_messages(spark):
    """The counts are those of one pass over every text, and a word that few of very many messages have keeps its answer whole."""
    said = [f"Note {a}{b}{c} says: {t}" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst" for c in "abcdefghijklmnopqrst" for t in ENGLISH[:3]]
    said += [f"The zorbel of dock {a}{b} was moved." for a in "abcd" for b in "abc"] + ["It went to the zorbels"] * 3 + ["We moved the zorbel"]
    rows = [(f"f{i}", role, t, 0) for i, t in enumerate(said) for role in (["user", "system"] if i % 2 else ["assistant"])] + [("f", "user", None, 0)]
    m = chat(spark, rows)
    texts = sorted({t for _, r, t, _ in rows if t and r != "system"})
    model = Ends(texts)
    tails = ["We moved the zorbel", "It went to the zorbels", "Open the", "of the dock", "zor", "unheard of"]
    for few in (pairs.BROADCAST_GRAMS, 0):
        was, pairs.BROADCAST_GRAMS = pairs.BROADCAST_GRAMS, few
        grams = {g for x in tails for g in pairs._last_grams(end_tokens(x)) if g}
        counts, begins, base = pairs.end_counts(m, spark.createDataFrame([(g,) for g in grams], "gram string"))
        pairs.BROADCAST_GRAMS = was
        counts, begins = {r["gram"]: (r["seen"], r["ended"]) for r in counts.collect()}, {r["word"]: r["begins"] for r in begins.collect()}
        assert base == model.base and begins == model.begins
        for g in grams:
            k = tuple(g.split(" "))
            assert counts.get(g, (0, 0)) == (model.seen[len(k)][k], model.ended[len(k)][k])
        for x in tails:
            t = end_tokens(x)
            s, e = zip(*(counts.get(g, (0, 0)) for g in pairs._last_grams(t)))
            known = Ends.known(t, base, s, e, begins.get(t[-1], 0))
            assert known.likelihood(t) == model.likelihood(t) and known.last_alone(t) == model.last_alone(t) and known.cut_word(t, x) == model.cut_word(t, x)


def test_last_words_that_few_of_many_messages_have(spark):
    """An answer is judged by all messages, however many there are."""
    rare = [f"{a}{b}orbel" for a in "bdfghjkl" for b in "aeiou"]
    said = [f"Note {a}{b}{c} says: {t}" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst" for c in "abcdefghijklmnopqrst" for t in ENGLISH[:3]] + [f"The {w} of the dock was moved." for w in rare]
    rows = [("f", "user", t, 0) for t in said]
    for k, w in enumerate(rare):
        rows += [(f"p{k}", "user", "What did the night shift find at the gate?", 1), (f"p{k}", "assistant", f"They found the {w}", 2)]
    docs = spark.createDataFrame([("en", t) for t in ENGLISH], "lang string, text string")
    model = Ends(sorted({t for _, _, t, _ in rows}))
    want = {i for i, (_, role, t, _) in enumerate(rows) if role == "assistant" and pairs.unfinished(t, model)}
    got = {r["id"] for r in pairs.defects(chat(spark, rows), docs).where("defect = 'truncated'").collect()}
    assert got == want and len(want) < len(rare)


SEGMENTS = "doc_id string, source_file string, seg_no int, start_sec double, end_sec double, text string, lang string"


def recording(spark, texts, doc="d"):
    return spark.createDataFrame([(doc, "f", i, float(i * 10), float(i * 10 + 5), t, "en") for i, t in enumerate(texts)], SEGMENTS)


@pytest.fixture(scope="module")
def staff(spark):
    return spark.createDataFrame([("Pelle", "Brenthwaite"), ("Vesna", "Abendroth-Kole"), ("Rufio", "Carrier"), (None, None)], "given_name string, family_name string")


def test_labels_of_all_kinds(spark, staff):
    texts = ["00:01:10 Pelle Brenthwaite (host): hello there.", "[0:13] P. Brenthwaite: still me.", ">> PELLE: [BLANK_AUDIO]", "ABENDROTH-KOLE, Vesna: now I. <Pelle Brenthwaite> and him again.", "um, uh", "[Vesna] [inaudible] so now.", "Note: no label here.", None, "  ", "Vesna: <noise>", "more from her.", ">> Rufio: *coughs*", "[Vesna] back."]
    df = recording(spark, texts)
    got = {r["seg_no"] for r in turns.turn_starts(df.unionAll(df), staff).collect()}
    assert got == {0, 3, 5}
    t = sorted(turns.turns(df, staff).collect(), key=lambda r: (r["turn_seg"], r["turn_piece"]))
    assert [(r["speaker"], r["text"]) for r in t] == [("Pelle Brenthwaite", "hello there. still me."), ("Vesna Abendroth-Kole", "now I."), ("Pelle Brenthwaite", "and him again."), ("Vesna Abendroth-Kole", "so now. Note: no label here. more from her. back.")]


def test_numbers_and_functions_and_none(spark, staff):
    assert [r["seg_no"] for r in turns.turn_starts(recording(spark, ["SPEAKER_01: a b.", "Speaker 1: c.", "(S2) d.", "speaker two: e.", "Spk 2: f. S1: g."]), staff).orderBy("seg_no").collect()] == [0, 2, 4]
    assert [r["seg_no"] for r in turns.turn_starts(recording(spark, ["TRAINER - hi there.", "[trainer] x y.", "Option B: z.", "Observer: w."]), staff).orderBy("seg_no").collect()] == [0, 3]
    assert [r["seg_no"] for r in turns.turn_starts(recording(spark, ["um", "one two.", "three."]), staff).collect()] == [1]
    assert turns.turn_starts(recording(spark, ["um", None]), staff).count() == 0
    assert turns.turn_starts(recording(spark, ["a"]).limit(0), staff).count() == 0
    extra = recording(spark, ["Pelle: a b.", "Rufio: c d."]).withColumn("key", F.lit(1)).withColumn("who", F.lit(2)).withColumn("speaker", F.lit("x"))
    assert turns.turn_starts(extra, staff.limit(0)).count() == 1  # without a directory a name met once is no label
    again = recording(spark, ["Pelle: a b.", "Zoltan Quimby: c d.", "Rufio: e.", "[Door Slams] f.", "Zoltan Quimby: g h.", "[Door Slams] i.", "Zoltan: j.", "Q. Other: k.", "Quimby: l."])
    got = turns.turns(again, staff).orderBy("start_sec").collect()
    assert [(r["speaker"], r["text"]) for r in got] == [("Pelle Brenthwaite", "a b."), ("Zoltan Quimby", "c d."), ("Rufio Carrier", "e. f."), ("Zoltan Quimby", "g h. i. j. Q. Other: k. l.")]


def test_blocks_do_not_change_turns(spark, staff):
    r = random.Random(4)
    texts = [r.choice(["Pelle: ", "[Vesna] ", "R. Carrier: ", "", "", ""]) + r.choice(["we go on.", "um", "<noise>", "so it is. Rufio: yes it is."]) for _ in range(400)]
    df = recording(spark, texts)
    got = {x["seg_no"] for x in turns.turn_pieces(df, staff, block_seconds=60).where("new").collect()}
    who = said = None
    want = set()
    labels = turns.Labels(frozenset({"pelle", "vesna", "rufio"}), frozenset({"carrier"}))
    first = True
    for i, t in enumerate(texts):
        for key, words, _ in turns.pieces(t, labels):
            if key:
                who = key.split("|")[1][0]
            if words:
                if first or who != said:
                    want.add(i)
                first, said = False, who
    assert got == want


def test_assignment_is_optimal():
    r = random.Random(2)
    from itertools import permutations

    for _ in range(30):
        n, m = r.randint(1, 4), 5
        cost = [[r.random() for _ in range(m)] for _ in range(n)]
        got = turns.assign(cost)
        assert abs(sum(cost[i][j] for i, j in enumerate(got)) - min(sum(cost[i][j] for i, j in enumerate(p)) for p in permutations(range(m), n))) < 1e-9


def test_resolve_names_by_roster():
    roster = {("pelle", "brenthwaite"), ("vesna", "yard")}
    got = turns.resolve(["p|p|brentwaite", "p|pele|", "p||brenthwaite", "p|vesna|", "n2", "ftrainer"], roster)
    assert got["p|p|brentwaite"] == got["p|pele|"] == got["p||brenthwaite"] == "Pelle Brenthwaite" and got["p|vesna|"] == "Vesna Yard" and got["n2"] == "Speaker 2" and got["ftrainer"] == "Trainer"


def test_one_initial_does_not_make_one_speaker(spark, monkeypatch):
    got = turns.resolve(["p|anna|meyer", "p|adam|brown", "p|a|brown", "p|anna|", "u|ada|"], {("anna", "meyer"), ("adam", "brown")})
    assert got == {"p|anna|meyer": "Anna Meyer", "p|anna|": "Anna Meyer", "p|adam|brown": "Adam Brown", "p|a|brown": "Adam Brown", "u|ada|": "Ada"}
    # forms that leave out a part are one speaker with what they can stand for
    assert len(set(turns.resolve(["p|anna|", "p|a|meyer"], set()).values())) == 1
    assert len(set(turns.resolve(["p|anna|", "p|a|meyer"], {("arno", "meyer"), ("anna", "meyer")}).values())) == 1
    df = recording(spark, ["Anna Meyer: one two.", "Adam Brown: three.", "A. Meyer: four.", "Anna: five."])
    staff = spark.createDataFrame([("Anna", "Meyer"), ("Adam", "Brown")], "given_name string, family_name string")
    assert sorted(r["seg_no"] for r in turns.turn_starts(df, staff).collect()) == [0, 1, 2]
    # the assignment decides: sent elsewhere, labels are other people
    monkeypatch.setattr(turns, "assign", lambda cost: [len(row) - len(cost) + i for i, row in enumerate(cost)])
    assert len(set(turns.resolve(["p|anna|meyer", "p|a|meyer", "p|anna|"], set()).values())) == 3


def test_many_labels_are_joined_in_salted_copies(spark, staff, monkeypatch):
    df = recording(spark, ["Pelle: a.", "b.", "[Vesna] c.", "d."] * 20)
    few = sorted(map(tuple, turns.turns(df, staff).collect()))
    monkeypatch.setattr(turns, "BROADCAST_LABELS", 0)
    assert sorted(map(tuple, turns.turns(df, staff).collect())) == few and len(few) == 40
