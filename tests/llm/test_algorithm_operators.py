"""Runs, pieces, containers, mixtures and shared spans."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.llm import mixing, packing, pieces, runs, spans


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@given(st.text("abc", max_size=30), st.text("abc", max_size=30))
@settings(max_examples=200, deadline=None)
def test_common_length(a, b):
    assert runs.common_length(a, b) == lcs(a, b)
    assert runs.alike(a, b) == (2 * lcs(a, b) >= 0.9 * (len(a) + len(b)) - 1e-9)


EVENTS = "e string, n int, t double, text string"


def brute_runs(data, gap):
    out, run = [], None
    for e, n, t, text in sorted(set(data)):
        ok = run and run[0] == e and t is not None and run[3] is not None and t - run[3] <= gap and runs.alike(runs.squeeze(run[4]), runs.squeeze(text))
        if ok:
            run = (e, run[1], n, t, text, run[5] + 1)
        else:
            if run and run[5] > 1:
                out.append((run[0], run[1], run[2], run[5]))
            run = (e, n, n, t, text, 1)
    if run and run[5] > 1:
        out.append((run[0], run[1], run[2], run[5]))
    return sorted(out)


@pytest.mark.parametrize("block", [1, 2, 3, 7, 512])
def test_runs_equal_brute_force_for_any_block(spark, block):
    r = random.Random(block)
    screens = ["Order 4576844360  Plant 1043 vendor", "ORDER 4576844360 plant 1O43 vendor", "another screen altogether 99", "", " "]
    data = [(f"r{i % 3}", i // 3, float(i * 20 + r.choice([0, 0, 0, 500])), r.choice(screens)) for i in range(240)]
    data = [(e, n, t + 1000 * (n // 30), x) for e, n, t, x in data]
    df = spark.createDataFrame(data + data[:40], EVENTS)
    got = sorted((x["entity"], x["first_seq"], x["last_seq"], x["n_events"]) for x in runs.collapse_runs(df, "e", "n", "t", "text", 120.0, block_rows=block).collect())
    assert got == brute_runs(data, 120.0)
    every = runs.collapse_runs(df, "e", "n", "t", "text", 120.0, single=True, block_rows=block).collect()
    assert sorted((x["entity"], x["first_seq"], x["last_seq"], x["n_events"]) for x in every if x["n_events"] > 1) == got
    assert sum(x["n_events"] for x in every) == len(set(data)) and sorted(n for x in every for n in range(x["first_seq"], x["last_seq"] + 1) if x["entity"] == "r0") == sorted(n for e, n, _, _ in data if e == "r0")


def test_runs_of_nulls_and_edges(spark):
    df = spark.createDataFrame([("a", 1, 0.0, None), ("a", 2, 1.0, None), ("b", 1, None, "x"), ("b", 2, 1.0, "x"), ("c", 1, 0.0, "x"), ("c", 2, 120.0, "X "), ("c", 3, 241.0, "x"), (None, 1, 0.0, "y"), (None, 2, 1.0, "y"), ("d", None, 0.0, "z")], EVENTS)
    clash = df.withColumn("block", F.lit(1)).withColumn("seq", F.lit(0)).withColumn("start", F.lit("s"))
    got = sorted(((x["entity"] or "", x["first_seq"], x["last_seq"], x["duration"]) for x in runs.collapse_runs(clash, "e", "n", "t", "text", 120.0).collect()))
    assert got == [("", 1, 2, 1.0), ("c", 1, 2, 120.0)]
    assert runs.collapse_runs(df.limit(0), "e", "n", "t", "text", 120.0).count() == 0


TEXTS = st.one_of(st.text(st.sampled_from("ab ,.\n!"), max_size=400), st.text(st.sampled_from("xyz"), max_size=400), st.text(max_size=200))


@given(TEXTS, st.integers(20, 60), st.integers(0, 12))
@settings(max_examples=300, deadline=None)
def test_pieces_cover_and_fit(text, limit, overlap):
    parts = pieces.split_text(text, limit, overlap)
    assert parts[0][0] == 0 and parts[-1][2] == len(text)
    for (a, new, z), before in zip(parts, [None, *parts]):
        assert z - a <= limit and a <= new <= z and (z > new or not text)
        if before:
            assert new == before[2] and new - a <= overlap and a >= before[1] - 0 or a >= before[0]
    assert "".join(text[n:z] for _, n, z in parts) == text
    if len(text) <= limit:
        assert len(parts) == 1


def test_pieces_prefer_natural_places():
    text = " ".join(f"Sentence number {i} has a few words." for i in range(60))
    parts = pieces.split_text(text, 300, 40)
    assert all(text[:z].rstrip().endswith(".") for _, _, z in parts)
    assert all(a == 0 or text[a - 1].isspace() for a, _, _ in parts)


def test_any_character_may_be_cut_where_there_is_no_boundary():
    assert pieces.cut_positions("x" * 1500, 700, 80) == [500, 1000, 1500]
    marked = ("x\u0301" + "x" * 7) * 200
    assert all(marked[i] != "\u0301" for i in pieces.cut_positions(marked, 700, 80)[:-1])


def test_split_rows(spark):
    rows = [("d", 1, 0.0, 100.0, "word " * 300), ("d", 1, 0.0, 100.0, "word " * 300), ("d", 2, 5.0, 1.0, "x" * 1500), ("d", 3, 0.0, None, " " * 900), ("d", 4, 0.0, 1.0, None), ("d", 5, 0.0, 1.0, "short"), ("d", 6, None, None, "é" * 701), ("d", 7, 0.0, 9.0, "  " + "y" * 700 + "\n")]
    df = spark.createDataFrame(rows, "doc_id string, seg_no int, start_sec double, end_sec double, text string").withColumn("piece", F.lit(1))
    got = pieces.split_oversized(df, ["doc_id", "seg_no"], "text", 700, 80, "start_sec", "end_sec").orderBy("seg_no", "piece_no").collect()
    assert {r["seg_no"] for r in got} == {1, 2, 6}
    first = [r for r in got if r["seg_no"] == 1]
    assert len(first) == first[0]["n_pieces"] == 3 and first[0]["piece_start"] == 0.0 and first[-1]["piece_end"] == 100.0 and all(a["piece_end"] == b["piece_start"] for a, b in zip(first, first[1:]))
    assert all(r["piece_start"] is None for r in got if r["seg_no"] != 1)
    assert pieces.split_oversized(df.limit(0), ["doc_id", "seg_no"], "text", 700, 80).count() == 0
    with pytest.raises(ValueError):
        pieces.split_oversized(df, ["doc_id"], "text", 80, 80)


def brute_tokens(text):
    return len(re.findall(r"\w+|[^\w\s]+", text or ""))


@pytest.mark.parametrize("part_tokens", [2_000_000, 3000])
def test_packing(spark, part_tokens):
    r = random.Random(3)
    docs = [(i, " ".join("w" for _ in range(r.choice([1, 5, 20, 60, 90, 100, 101, 350]))), r.choice(["Pdf ", "chat", None, "x"])) for i in range(400)] + [(900, None, "pdf"), (901, " ", "pdf"), (902, "ünï_1, --- a b", "pdf")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("size", F.lit("x")).withColumn("part", F.lit(0))
    got = packing.pack(df, {"pdf": 0.7, "chat": 0.3}, 100, part_tokens=part_tokens).toPandas()
    assert got.groupby("container_id").n_tokens.sum().max() <= 100
    tokens = {i: brute_tokens(t) for i, t, _ in docs}
    assert got.groupby("doc_id").n_tokens.sum().to_dict() == {i: n for i, n in tokens.items() if n}
    assert set(got[got.n_pieces > 1].doc_id) == {i for i, n in tokens.items() if n > 100}
    assert got.container_id.nunique() <= 1.1 * -(-sum(tokens.values()) // 100)
    assert packing.pack(df.limit(0), {}, 100).count() == 0


def test_windows_follow_the_shares():
    """While both sources last, each window has them by their shares."""
    items = [("a", 10, i, 1, 0) for i in range(20_000)] + [("b", 10, i, 1, 0) for i in range(20_000)]
    first: dict = {}
    for number, item in packing._pack(items, {"a": 0.8, "b": 0.2}, {}, 1000, False):
        first.setdefault(number, []).append(item[0])
    head = [x for n in sorted(first)[:128] for x in first[n]]
    assert abs(head.count("a") / len(head) - 0.8) < 0.02


def test_items_that_fill_no_container_together_are_laid_a_bounded_number_of_times(monkeypatch):
    """No two of them fit into one container, so none gets nearly full."""
    items = [("a", 600, i, 1, 0) for i in range(4000)]
    laid = []
    put = packing.BestFit.put
    monkeypatch.setattr(packing.BestFit, "put", lambda self, size, item: laid.append(size) or put(self, size, item))
    got = list(packing._pack(items, {"a": 1.0}, {}, 1000, True))
    assert sorted(item[2] for _, item in got) == list(range(4000))
    most = packing.AGAIN_WINDOWS * packing.WINDOW_CONTAINERS * 1000
    assert sum(item[1] for number, item in got if number < 0) <= most
    assert len(laid) <= 4000 * (2 * packing.AGAIN_WINDOWS + 1)


@pytest.mark.parametrize("part_tokens", [2_000_000, 40_000])
def test_full_pieces_are_charged_to_their_source(spark, part_tokens):
    """A source of long documents is never more than a window from its share, full pieces included."""
    docs = [(i, "w " * 350, "a") for i in range(300)] + [(1000 + i, "w " * 10, "b") for i in range(10_500)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = packing.pack(df, {"a": 0.5, "b": 0.5}, 100, part_tokens=part_tokens).toPandas()
    assert got.n_tokens.sum() == 210_000 and len(got) == 1200 + 10_500 and not got.container_id.str.startswith("full").any()
    assert got.groupby("container_id").n_tokens.sum().max() <= 100
    named = got.container_id.str.split("-", expand=True).astype(int)
    own = got.assign(round=named[0], part=named[1], number=named[2], a=(got.doc_id < 1000) * got.n_tokens)
    for _, part in own[own["round"] == 0].groupby("part"):
        sums = part.groupby("number")[["a", "n_tokens"]].sum().cumsum()
        assert (abs(sums.a - sums.n_tokens / 2) <= packing.WINDOW_CONTAINERS * 100).all()


def test_rests_start_with_what_is_owed(spark, monkeypatch):
    starts = []
    packed = packing._packed
    monkeypatch.setattr(packing, "_packed", lambda items, credits, *rest: starts.append(credits.collect()) or packed(items, credits, *rest))
    df = spark.createDataFrame([(i, "w " * (40 + i % 37), "ab"[i % 3 == 0]) for i in range(600)], "doc_id long, text string, source string")
    got = packing.pack(df, {"a": 0.5, "b": 0.5}, 100, part_tokens=3000).toPandas()
    assert len(got) == 600 and len(starts) > 1
    laid = got[got.container_id.str.startswith("0-")]
    a = laid.doc_id % 3 != 0
    gap = laid.n_tokens.sum() / 2 - laid.n_tokens[a].sum()
    credit = {(r["part"], r["source"]): r["credit"] for r in starts[1]}
    assert gap != 0 and any(abs(credit[p, "a"] - gap) < 1e-6 and abs(credit[p, "b"] + gap) < 1e-6 for p, s in credit if s == "a" and (p, "b") in credit)


def test_credits_do_not_depend_on_blocks_of_parts(spark):
    r = random.Random(6)
    rows = [(p, s, r.randint(1, 50)) for p in range(-1, 40) for s in ("a", "b", "c") if r.random() < 0.8]
    shares = {"a": 0.5, "b": 0.3}
    owed, want = {}, {}
    for p in range(-1, 40):
        mine = [(s, n) for q, s, n in rows if q == p]
        total, weight = sum(n for _, n in mine), sum(shares.get(s, 0) for s, _ in mine)
        for s, n in mine:
            want[p, s] = owed.get(s, 0.0)
        for s, n in mine:
            owed[s] = owed.get(s, 0.0) + total * shares.get(s, 0) / max(weight, 1e-9) - n
    df = spark.createDataFrame(rows, "part long, source string, size long")
    for block in (1, 7, 4096):
        got = {(x["part"], x["source"]): x["credit"] for x in packing.carried(df, shares, block).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_divided_documents_come_from_the_packing(spark, monkeypatch):
    """Without the round-robin's containers the query has no rows."""
    df = spark.createDataFrame([(1, "w " * 250, "a"), (2, "w " * 100, "a"), (3, "w " * 101, None)], "doc_id long, text string, source string")
    assert sorted(r["doc_id"] for r in packing.divided(packing.pack(df, {"a": 1.0}, 100)).collect()) == [1, 3]
    monkeypatch.setattr(packing, "_packed", lambda items, *rest: items.withColumn("number", F.lit(0).cast("long")).where("piece_no = 1"))
    assert packing.divided(packing.pack(df, {"a": 1.0}, 100)).count() == 0


TARGETS = [mixing.Target("Pdf", "pdf", 0.5, 1), mixing.Target("chat", "chat", 0.3, 3), mixing.Target("mail", "mail", 0.2, 2), mixing.Target("none", "none", 0.0, 1)]


def test_mixture(spark):
    docs = [(i, "w " * (10 + i % 7), "PDF " if i % 10 < 6 else "chat") for i in range(3000)] + [(5000, "one two three", " mail"), (5001, None, "mail"), (5002, "x y", None), (5003, "z", "other")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("key", F.lit(1)).withColumn("p", F.lit(1)).withColumn("tokens", F.lit(0))
    got = {r["source"]: r for r in mixing.shares(df, TARGETS).collect()}
    assert not got["mail"]["reachable"] and got["Pdf"]["reachable"] and got["chat"]["reachable"] and got["none"]["reachable"]
    assert abs(got["Pdf"]["mixed_tokens"] / got["Pdf"]["target_tokens"] - 1) < 0.05 and abs(got["chat"]["mixed_tokens"] / got["chat"]["target_tokens"] - 1) < 0.05
    assert got["mail"]["rate"] == 2.0 and got["mail"]["mixed_tokens"] == 6.0
    rows, _ = mixing.mixture(df, TARGETS)
    assert rows.where("copies > cap").count() == 0 and rows.count() == 3002
    assert all(r["rate"] == 0 for r in mixing.shares(df.limit(0), TARGETS).collect())


def test_more_targets_than_the_bound_are_an_error(spark):
    df = spark.range(mixing.MOST_TARGETS + 1).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("source"), F.lit(0.001).alias("target_share"), F.lit(1).alias("max_repeat"))
    assert len(mixing.read_targets(df.limit(mixing.MOST_TARGETS))) == mixing.MOST_TARGETS
    with pytest.raises(ValueError):
        mixing.read_targets(df)


def test_soft_memberships(spark):
    docs = [(i, "alpha beta gamma " * 5, "pdf") for i in range(40)] + [(100 + i, "delta epsilon zeta " * 5, "chat") for i in range(40)] + [(500, "alpha beta", None), (501, "zeta delta", "unknown"), (502, "alpha gamma " * 9, "chat")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    p = {r["doc_id"]: r["p"] for r in mixing.memberships(df, TARGETS[:2], True).where("doc_id >= 500 or doc_id = 100").collect()}
    assert p[500][0] > 0.8 and p[501][1] > 0.8
    assert p[100] == [0.0, 1.0] and p[502][0] == pytest.approx(1 - mixing.LABEL_TRUST, abs=0.011)  # a recorded source is trusted, the text has its say
    targets = [mixing.Target("pdf", "pdf", 0.4, 3), mixing.Target("chat", "chat", 0.6, 3)]
    fit = mixing.fit_rates(mixing.memberships(df, targets, True), targets, True)
    assert abs(fit.mass.sum() - fit.total) < 1e-6 * fit.total + 1 and len(fit.steps) > 1 and all(soft for soft, _ in fit.steps)
    got = mixing.shares(df, targets, True).collect()
    assert all(abs(r["rate"] * r["own_tokens"] / r["target_tokens"] - 1) < 0.01 for r in got)
    assert mixing.held_out_accuracy(df, targets) > 0.9


def test_documents_that_look_like_another_source_get_other_rates(spark):
    """The recorded sources' totals match exactly, and the classifier's posteriors still tell the documents of a source apart."""
    docs = [(i, "alpha beta gamma " * 10, "pdf") for i in range(60)] + [(100 + i, "delta epsilon zeta " * 10, "chat") for i in range(60)] + [(200 + i, "alpha beta gamma " * 10, "chat") for i in range(4)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    targets = [mixing.Target("pdf", "pdf", 0.3, 1), mixing.Target("chat", "chat", 0.7, 3)]
    rows = mixing.mixture(df, targets)[0].toPandas()
    total = rows.tokens.sum()
    used = (rows.rate * rows.tokens).groupby(rows.key).sum()
    assert abs(used["pdf"] / total - 0.3) < 1e-4 and abs(used["chat"] / total - 0.7) < 1e-4
    chat_rows = rows[rows.key == "chat"]
    assert chat_rows[chat_rows.doc_id >= 200].rate.max() < chat_rows[chat_rows.doc_id < 200].rate.min()


def test_found_depends_on_the_fit(spark, monkeypatch):
    docs = [(i, f"alpha beta w{i % 7} " * 10, "pdf") for i in range(90)] + [(100 + i, "delta epsilon zeta " * 10, "chat") for i in range(10)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    targets = [mixing.Target("pdf", "pdf", 0.4, 1), mixing.Target("chat", "chat", 0.6, 3)]
    lost = lambda: [r["source"] for r in mixing.shares(df, targets).where("not reachable").collect()]
    assert lost() == ["chat"]
    monkeypatch.setattr(mixing, "_rates", lambda p, home, cap, steps: cap * 0.0)
    assert lost() == []


def brute_pairs(texts, n):
    grams = {}
    for i, t in texts.items():
        for j in range(len(t or "") - n + 1):
            grams.setdefault(t[j : j + n], set()).add(i)
    return sorted({(a, b) for ids in grams.values() for a in ids for b in ids if a < b})


def _corpus(seed):
    r = random.Random(seed)
    word = lambda k: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, k)))
    some = lambda n: " ".join(word(r.choice([3, 6, 12, 40])) + r.choice(["", ",", ".", " --"]) for _ in range(n))
    shared = [some(60) for _ in range(4)] + ["-" * 300, "ab" * 200, "x" * 700, "Zeile für Zeile, " * 20]
    texts = {}
    for i in range(120):
        parts = [some(r.randint(0, 50))]
        for _ in range(r.choice([0, 1, 1, 2])):
            s = r.choice(shared)
            a = r.randint(0, max(0, len(s) - 150))
            parts += [s[a : a + r.choice([200, 239, 240, 241, 260, 400])], r.choice(["", " ", "q"]), some(r.randint(0, 40))]
        texts[i] = "".join(parts)
    texts[200] = texts[3]
    texts[201] = texts[3]
    texts[202], texts[203], texts[204] = None, "", "short"
    return texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_shared_spans_equal_brute_force(spark, seed):
    texts = _corpus(seed)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("rep", F.lit(1)).withColumn("name", F.lit(2))
    got = sorted((r["doc_id_a"], r["doc_id_b"]) for r in spans.sharing_pairs(df, 240).collect())
    assert got == brute_pairs(texts, 240)


def test_unequal_periodic_stretches_before_the_same_text(spark):
    r = random.Random(11)
    some = lambda n: "".join(r.choice("abcdefgh klmnop.") for _ in range(n))
    texts, i = {}, 0
    for root in ("-", "=-", "| --- ", "0123456789abcdefghijk "):
        for tail in (some(5000), some(230), some(150)):
            for lead in (0, 90):
                for n in (160, 120, 100):
                    texts[i] = some(lead) + (root * n)[:n] + tail
                    texts[i + 1] = tail[::-1] + (root * n)[:n] + some(lead)
                    i += 2
        for n in (239, 240, 260, 500):
            texts[i], i = some(50) + (root * n)[3 : n + 3] + some(50), i + 1
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = sorted((r["doc_id_a"], r["doc_id_b"]) for r in spans.sharing_pairs(df, 240).collect())
    assert got == brute_pairs(texts, 240)
    two = spark.createDataFrame([(1, "-" * 160 + texts[0][160:]), (2, "-" * 120 + texts[0][160:])], "doc_id long, text string")
    assert [tuple(r) for r in spans.shared_spans(two, 240)[0].collect()] == [(1, 2, 40, 0, 5120)]


def test_shared_parts(spark):
    common = "".join(random.Random(8).choice("abcdefghij klmnop") for _ in range(300))
    texts = [(1, "A" + common + "B" * 99), (2, common), (3, "no"), (4, None), (5, "same text " * 40), (6, "same text " * 40)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_chars"], r["shared_chars"]) for r in spans.shared_parts(df, 240).collect()}
    assert got == {1: (400, 300), 2: (300, 300), 3: (2, 0), 4: (0, 0), 5: (400, 400), 6: (400, 400)}
    assert spans.sharing_pairs(df.limit(0), 240).count() == 0
    with pytest.raises(ValueError):
        spans.sharing_pairs(df, 50)


def test_rounds_name_runs_and_pairs_over_all_records(spark):
    """A long passage of three records ends in fewer symbols, equal in all of them, and what one record alone has stays as it is."""
    r = random.Random(5)
    some = lambda n: "".join(r.choice("abcdefgh klmnop. ") for _ in range(n))
    passage = some(6000)
    texts = [(1, some(500) + passage + some(300)), (2, some(120) + passage), (3, passage[:3000] + some(90)), (4, some(5000)), (5, (some(70) * 1)[:70] * 20)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    found = spans.shared_symbols(df, 240).toPandas()
    assert set(found.doc_id) == {1, 2, 3}
    top = found[found.parent.isna()]
    assert (found.before.isna() & found.parent.notna()).any() and 2 * len(top[top.doc_id == 1]) < len(found[(found.doc_id == 1) & found.before.notna()])
    # symbols at one place of one parent are in one text
    whole = dict(texts)
    reach = spans.lengths(240)[1]
    for _, g in found[found.before.notna()].groupby("name"):
        assert len({whole[d][p : p + reach] for d, p in zip(g.doc_id, g.pos)}) == 1
    got = sorted(tuple(x)[:2] + (x["n_chars"],) for x in spans.shared_spans(df, 240)[0].collect())
    assert [x[:2] for x in got] == [(1, 2), (1, 3), (2, 3)] and got[0][2] >= 6000 and got[1][2] >= 3000


def test_runs_of_one_symbol_are_one_symbol(spark):
    rows = [(d, at + 60 * k, at + 60 * k + 92, 7, 1, 1) for d, at, n in ((1, 0, 5), (2, 40, 5), (3, 10, 4)) for k in range(n)]
    level = spark.createDataFrame(rows, "doc_id long, pos int, end int, name long, before int, after int")
    after, parts, n = spans.name_round(level, 0)
    got = {x["doc_id"]: (x["pos"], x["end"]) for x in after.where("before is null").collect()}
    assert n == parts.count() == 10 and got == {1: (0, 332), 2: (40, 372)} and after.where("doc_id = 3").count() == 4
    assert {(x["offset"]) for x in parts.where("doc_id = 2").collect()} == {0, 60, 120, 180, 240}
