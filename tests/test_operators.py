import random

import pytest
from pyspark.sql import functions as F

from brindle.operators import bm25, chat, dense, fusion, ordered, pages, sheets, store, timeline


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def test_blockwise_previous_and_fill_equal_plain_scan(spark):
    r = random.Random(1)
    data = [(r.choice(["a", "b", None]), i, r.choice([None, f"v{i}"])) for i in range(300)]
    df = spark.createDataFrame(data, "k string, t int, v string")
    blocked = ordered.with_block(df, F.floor(F.col("t") / 7))
    before = {(x["k"], x["t"]): x["p"] for x in ordered.blockwise_previous(blocked, ["k"], ["t"], {"t": "p"}).collect()}
    fill = {(x["k"], x["t"]): x["w"] for x in ordered.blockwise_fill(blocked, ["k"], ["t"], "v", "w").collect()}
    last, value = {}, {}
    for k, t, v in data:
        assert before[(k, t)] == last.get(k)
        value[k] = v if v is not None else value.get(k)
        assert fill[(k, t)] == value[k]
        last[k] = t
    assert len(before) == len(fill) == 300


def test_bm25_fills_with_zero_scores(spark):
    docs = spark.createDataFrame([(i, "alpha beta" if i == 3 else f"word{i}") for i in range(30)], "id int, text string")
    q = spark.createDataFrame([(1, "beta"), (2, "nothing"), (3, "")], "query_id int, query string")
    hits = bm25.search(bm25.build(docs, "id", "text"), q, "query_id", "query", 20)
    assert hits.groupBy("query_id").count().where("count = 20").count() == 3
    assert hits.where("query_id = 1 and rank = 1").first()["id"] == 3
    assert [r["id"] for r in hits.where("query_id = 2").orderBy("rank").collect()] == list(range(20))


def test_bm25_index_is_written_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c")], "id int, text string")
    index = bm25.build(docs, "id", "text")
    assert index.write(str(tmp_path / "i")) and not index.write(str(tmp_path / "i")) and index.write(str(tmp_path / "i"), force=True)
    again = bm25.Index.read(spark, str(tmp_path / "i"))
    assert again.n_docs == 2 and again.terms.count() == 3
    assert not bm25.build(docs.limit(0), "id", "text").write(str(tmp_path / "e"))


def test_dense_handles_nulls_and_ties(spark):
    v = spark.createDataFrame([(2, [1.0, 0.0]), (1, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None)], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.0]), (8, None)], "query_id long, embedding array<float>")
    assert rows(dense.search(v, q, 2), "query_id", "rank", "id") == [(9, 1, 1), (9, 2, 2)]
    assert dense.search(v.limit(0), q, 2).count() == 0
    assert dense.search(v, q.limit(0), 2).count() == 0


def _lists(spark, data):
    return spark.createDataFrame(data, "query_id int, list_no int, rank int, text string, m string").withColumn("meta", F.struct("m")).drop("m")


def test_fusion_order_and_meta(spark):
    lists = _lists(spark, [(1, 0, 1, "A", "a0"), (1, 0, 2, "B", "b0"), (1, 1, 1, "B", "b1"), (1, 1, 2, "C", "c1")])
    got = [(r["text"], r["meta"]["m"]) for r in fusion.fuse(lists).orderBy("rrf_rank").collect()]
    assert got == [("B", "b0"), ("A", "a0"), ("C", "c1")]


@pytest.mark.parametrize("scores,expected", [([3.0, 1.0, 2.0], [1.0, 0.0, 0.5]), ([-11.0, -12.0], [0.35, 0.0]), ([-10.5, -12.0], [1.0, 0.0]), ([5.0], [0.5]), ([-11.0], [0.175])])
def test_confidence(spark, scores, expected):
    df = spark.createDataFrame([(1, i, s, False) for i, s in enumerate(scores)], "query_id int, i int, rerank_score double, pinned boolean")
    assert [r["confidence"] for r in fusion.with_confidence(df).orderBy("i").collect()] == expected


def _ranked(spark, n=5):
    data = [(1, f"t{i}", "text", 0.0, i, float(10 - i), i, False) for i in range(1, n + 1)]
    return spark.createDataFrame(data, "query_id int, text string, kind string, rrf double, place int, rerank_score double, rank int, pinned boolean").withColumn("meta", F.struct("kind")).drop("kind").select("query_id", "text", "meta", "rrf", "place", "rerank_score", "rank", "pinned")


def test_pin_and_promote(spark):
    ranked = _ranked(spark).drop("pinned")
    exact = spark.createDataFrame([(1, "t3", "row")], "query_id int, text string, kind string").withColumn("meta", F.struct("kind")).drop("kind")
    pinned = fusion.pin(ranked, exact)
    assert [r["text"] for r in pinned.orderBy("rank").collect()] == ["t3", "t1", "t2", "t4", "t5"]
    figure = spark.createDataFrame([(1, "fig", "figure", 0.0, 9, 1.0)], "query_id int, text string, kind string, rrf double, place int, rerank_score double").withColumn("meta", F.struct("kind")).drop("kind")
    asked = spark.createDataFrame([(1,)], "query_id int")
    out = fusion.promote(pinned, figure.select("query_id", "text", "meta", "rrf", "place", "rerank_score"), F.col("meta.kind") == "figure", asked)
    assert [r["text"] for r in out.orderBy("rank").collect()] == ["t3", "t1", "t2", "t4", "fig"]


def test_known_sources_keep_all_unknown(spark):
    df = spark.createDataFrame([(1, "a"), (1, "unknown"), (2, "unknown"), (2, None)], "query_id int, f string")
    assert rows(fusion.known_sources(df, F.col("f")).groupBy("query_id").count(), "query_id", "count") == [(1, 1), (2, 2)]


def test_short_queries_do_not_escalate(spark):
    q = spark.createDataFrame([(1, "purple elephant dancing"), (2, "a b c d e f g h i")], "id int, q string")
    ranked = spark.createDataFrame([(1, 1, 0.1)], "query_id int, rank int, confidence double")
    assert rows(fusion.assessment(q, ranked, "id", "q"), "query_id", "band", "escalate") == [(1, "medium", False), (2, "low", True)]


def test_enrich_falls_back(spark):
    p = spark.createDataFrame([("c1", "t1", 1, "pdf", "f1", "text"), ("c2", "t2", 2, "pdf", "f2", "text"), ("c3", "t2", 3, "pdf", "f3", "text")], "chunk_id string, text string, ord int, source_type string, source_file string, chunk_type string")
    h = spark.createDataFrame([(1, "pdf", "c1", "t1"), (1, "pdf", "x", "t2"), (1, "defect", "y", "t9")], "query_id int, collection string, id string, text string")
    got = {r["id"]: r["meta"]["source_file"] for r in fusion.enrich(h, p, {"pdf": "pdf", "defect": "defect"}).collect()}
    assert got == {"c1": "f1", "x": "f3", "y": "unknown"}


def test_sections_follow_the_order_of_the_contents(spark):
    toc = spark.createDataFrame([("d", 0, "A", 1), ("d", 1, "B", 5), ("d", 2, "C", 3), ("d", 3, "D", 9)], "doc_id string, pos int, title string, page int")
    got = rows(pages.with_section(spark.createDataFrame([("d", 4), ("d", 0), ("d", 7), ("e", 1)], "doc_id string, page int"), toc), "doc_id", "page", "section")
    assert got == [("d", 0, "Unknown Section"), ("d", 4, "A"), ("d", 7, "C"), ("e", 1, "Unknown Section")]


def test_text_passages(spark):
    data = [("d", p, 0.0, y, 10.0, y + 5, 100.0, t) for p in (1, 2, 3) for y, t in ((2.0, "Handbook"), (50.0, f"A block of more than thirty characters, number {p}"), (60.0, "short"))]
    blocks = spark.createDataFrame(data, "doc_id string, page int, x0 double, y0 double, x1 double, y1 double, height double, text string")
    toc = spark.createDataFrame([("d", 0, "One", 2)], "doc_id string, pos int, title string, page int")
    assert rows(pages.repeating_texts(blocks), "doc_id", "text") == [("d", "Handbook")]
    assert rows(pages.text_passages(blocks, toc), "page", "section") == [(2, "One"), (3, "One")]


def test_figures_captions_contexts(spark):
    img = "doc_id string, page int, image_no int, xref int, px_w int, px_h int, x0 double, y0 double, x1 double, y1 double, width double, height double"
    base = (100.0, 200.0, 300.0, 400.0, 600.0, 800.0)
    data = [("d", 1, 1, 7, 200, 200, *base), ("d", 1, 2, 8, 200, 200, 101.0, 201.0, 301.0, 401.0, 600.0, 800.0), ("d", 1, 3, 9, 80, 200, *base)] + [("d", p, 9, 5, 200, 200, *base) for p in (2, 3, 4, 5)]
    images = spark.createDataFrame(data, img)
    text = spark.createDataFrame([("d", 1, "page text")], "doc_id string, page int, text string")
    kept = pages.figure_images(images, text)
    assert rows(kept, "page", "image_no") == [(1, 1)]
    blocks = spark.createDataFrame([("d", 1, 100.0, 410.0, 300.0, 420.0, "Figure 1: a lock"), ("d", 1, 100.0, 180.0, 300.0, 195.0, "Above the image there is a text of some length"), ("d", 1, 500.0, 405.0, 590.0, 415.0, "beside")], "doc_id string, page int, x0 double, y0 double, x1 double, y1 double, text string")
    assert pages.captions(kept, blocks).first()["caption"] == "Figure 1: a lock"
    assert pages.contexts(kept, blocks, text).first()["context"].startswith("Above the image")


def test_table_markdown(spark):
    df = spark.createDataFrame([(1, [["a", "b"], ["1", " 2\n3"], ["", None]]), (2, [["a"]]), (3, [["", ""], ["x", "y"]])], "i int, cells array<array<string>>")
    got = {r["i"]: r["m"] for r in df.select("i", pages.table_markdown(F.col("cells")).alias("m")).collect()}
    assert got == {1: "| a | b |\n| --- | --- |\n| 1 | 2 3 |", 2: None, 3: None}


def test_speech_windows(spark):
    s = "doc_id string, seg_no int, start_sec double, end_sec double, text string"
    got = timeline.speech_windows(spark.createDataFrame([("d", i, i * 5.0, i * 5.0 + 1, "x" * n) for i, n in enumerate((300, 300, 99))], s)).collect()
    assert [len(r["text"]) for r in got] == [701]
    got = rows(timeline.speech_windows(spark.createDataFrame([("d", 1, 0.0, 30.0, "a"), ("d", 2, 30.0, 60.0, "b"), ("d", 3, 61.0, 62.0, " "), ("e", 1, 0.0, None, "c")], s)), "doc_id", "start", "end", "text")
    assert got == [("d", 0.0, 60.0, "a b"), ("e", 0.0, 0.0, "c")]


def test_screens_attach_carry_and_stay_orphans(spark):
    w = spark.createDataFrame([("d", 1, 0.0, 30.0), ("d", 2, 60.0, 90.0), ("d", 3, 400.0, 430.0)], "doc_id string, window_no long, start double, end double")
    v = spark.createDataFrame([("d", 0.0, "a"), ("d", 40.0, "b"), ("d", 130.0, "c")], "doc_id string, start_sec double, text string")
    homes = timeline.screen_homes(w, v)
    assert {r["text"]: r["window_no"] for r in homes.collect()} == {"a": 1, "b": None, "c": None}
    assert rows(timeline.carried_screens(w, homes), "window_no", "text") == [(2, "b")]
    o = spark.createDataFrame([("d", t, "x") for t in (0.0, 60.0, 121.0)], "doc_id string, start_sec double, text string")
    assert rows(timeline.orphan_windows(o), "session_no", "start", "end") == [(1, 0.0, 60.0), (2, 121.0, 121.0)]
    assert rows(timeline.gap_sessions(o, "doc_id", "start_sec", 60.0), "session_no", "n") == [(1, 2), (2, 1)]


def test_joined_lines(spark):
    df = spark.createDataFrame([(["File\nFile Menu", "menu"],)], "t array<string>")
    assert df.select(timeline.joined_lines(F.col("t")).alias("x")).first()["x"] == "File | File Menu"


def test_distinct_figures(spark):
    df = spark.createDataFrame([("d", float(i), f"screen text number {i % 2} " + ("abc" if i % 2 else "xyz") * 9) for i in range(6)] + [("d", 9.0, None)], "doc_id string, start_sec double, text string")
    assert timeline.distinct_figures(df).count() == 2


def test_sampled_frames(spark):
    df = spark.createDataFrame([("d", t, s) for t, s in ((0.0, 0.0), (1.0, 0.5), (2.0, 0.1), (31.0, 0.0), (32.0, 0.0))], "doc_id string, t double, scene double")
    assert rows(timeline.sampled_frames(df), "t") == [(0.0,), (1.0,), (31.0,)]


def test_sheet(spark):
    df = spark.createDataFrame([(2, "INC1", "<b>x</b>", ""), (3, None, " ", "nan"), (4, "INC2", "y", "z")], "_row_number int, Number string, `Short text` string, c string")
    p = sheets.passages(df, "f.xlsx", "S", "d", "incident").orderBy("row_number").collect()
    assert [r["text"] for r in p] == ["[f.xlsx · S · row 2]\nNumber: INC1\nShort text: x", "[f.xlsx · S · row 4]\nNumber: INC2\nShort text: y\nc: z"]
    assert p[1]["attrs"] == {"col_number": "INC2", "col_short_text": "y", "col_c": "z"} and p[0]["row_key"] == "INC1"
    assert "contains 2 incident records" in sheets.overview(df, "f.xlsx", "S", "incident").first()["text"]
    wide = spark.createDataFrame([(i, f"v{i:02d}", f"w{i % 12}") for i in range(13)], "_row_number int, a string, b string")
    assert rows(sheets.column_values(wide), "column_name", "n_values") == [("b", 12)]
    files = spark.createDataFrame([("/x/Incident defects.xlsx",), ("bug list.xlsx",), ("other.xlsx",)], "p string")
    assert [r[0] for r in files.select(sheets.target_collection("p")).collect()] == ["incident", "defect", None]


def test_store(spark):
    c = spark.createDataFrame([("c1", "t", 1, 1), ("c2", "t", 1, 1)], "conversation_id string, title string, created_at int, updated_at int")
    m = spark.createDataFrame([(1, "c1", "user", "a", 5)], "id int, conversation_id string, role string, content string, created_at int")
    changed, more = store.appended(c, m, spark.createDataFrame([(2, "c1", "assistant", "b", 9)], m.schema))
    assert rows(changed, "conversation_id", "updated_at") == [("c1", 9), ("c2", 1)] and more.count() == 2
    assert rows(store.conversation_list(c, m), "conversation_id", "n_messages") == [("c1", 1), ("c2", 0)]
    assert rows(store.renamed(c, F.lit("c2"), F.lit("  "), F.lit(7)), "title", "updated_at") == [("New chat", 7), ("t", 1)]
    kept, left = store.deleted(c, m, c.where("conversation_id = 'c1'"))
    assert kept.count() == 1 and left.count() == 0
    assert store.created(c, c).count() == 2
    reg = spark.createDataFrame([("d1", "f", 1, "ready", 3, None), ("d2", "f", 2, "failed", 0, None)], "doc_id string, filename string, version int, status string, chunk_count int, notes string")
    assert store.latest_versions(reg).first()["doc_id"] == "d2"
    assert rows(store.marked_failed(reg, F.lit("d1"), "why"), "doc_id", "status", "notes")[0] == ("d1", "failed", "why")
    assert store.delete_where(reg, F.col("notes") == "x").count() == 2


def test_followups_and_expansions(spark):
    df = spark.createDataFrame([("what is affected", "What about error 944?", 2), ("is 944 fixed", "What is the resolution for error 944?", 2), ("a b c d e f g h i", "error 944", 2), ("how does it work", "", 2), ("x", "error 944", 0)], "q string, u string, n int")
    got = [r[0] for r in df.select(chat.followed_up(F.col("q"), F.col("u"), F.col("n"))).collect()]
    assert got == ["what is affected for error 944", "is 944 fixed error 944?", "a b c d e f g h i", "how does it work", "x"]
    hits = spark.createDataFrame([(1, "WMS", 1, "none"), (1, "WMS", 2, "the Warehouse Management System (WMS) does"), (2, "PO", 1, "PO (purchase order)")], "query_id int, acronym string, rank int, text string")
    assert rows(chat.first_expansions(hits), "query_id", "expansion") == [(1, "the Warehouse Management System"), (2, "purchase order")]


def test_prompt_and_context(spark):
    r = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "query_id int, rank int, text string")
    ctx = chat.context_blocks(r, F.lit("f.pdf"))
    assert ctx.first()["context"] == "[Source 1 — f.pdf]\na\n\n[Source 2 — f.pdf]\nb"
    q = spark.createDataFrame([(1, "q1"), (2, "q2")], "query_id int, query string")
    h = spark.createDataFrame([(1, 2, "assistant", "y"), (1, 1, "user", "x")], "query_id int, place int, role string, content string")
    p = {x["query_id"]: [(m["role"], m["content"]) for m in x["prompt"]] for x in chat.prompts(q, ctx, h, F.lit("S")).collect()}
    assert [m[0] for m in p[1]] == ["system", "user", "assistant", "user"] and p[1][1][1] == "x" and "No relevant context" in p[2][0][1]


def test_promotion_keeps_the_order_of_equal_scores(spark):
    ranked = _ranked(spark).withColumn("rerank_score", F.lit(1.0))
    new = spark.createDataFrame([(1, "fig", "figure", 2, 1.0), (1, "other", "figure", 1, 0.5)], "query_id int, text string, kind string, place int, rerank_score double").withColumn("meta", F.struct("kind")).drop("kind")
    out = fusion.promote(ranked, new, F.col("meta.kind") == "figure", spark.createDataFrame([(1,), (2,)], "query_id int"))
    assert [r["text"] for r in out.orderBy("rank").collect()] == ["t1", "t2", "t3", "t4", "fig"]
    assert fusion.promote(ranked, new.limit(0), F.col("meta.kind") == "figure", spark.createDataFrame([(1,)], "query_id int")).count() == 5


def test_bm25_blocks_of_queries_and_rows_do_not_change_results(spark, monkeypatch):
    import random

    r = random.Random(4)
    word = lambda: r.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split())
    docs = spark.createDataFrame([(i, " ".join(word() for _ in range(r.randint(0, 12)))) for i in range(300)], "id int, text string")
    asked = spark.createDataFrame([(i, " ".join(word() for _ in range(3))) for i in range(20)] + [(99, "nothing known"), (98, "")], "q int, t string")
    index = bm25.build(docs, "id", "text")
    whole = sorted(map(tuple, bm25.search(index, asked, "q", "t", 7).collect()))
    assert len(whole) == 22 * 7
    monkeypatch.setattr(bm25, "BLOCK_QUERIES", 3)
    assert sorted(map(tuple, bm25.search(index, asked, "q", "t", 7).collect())) == whole
    monkeypatch.setattr(bm25, "BLOCK_WORDS", 2)
    assert sorted(map(tuple, bm25.search(index, asked, "q", "t", 7).collect())) == whole
    assert bm25.search(index, asked.limit(0), "q", "t", 7).count() == 0


def test_dense_with_text_ids_breaks_ties_by_them(spark):
    v = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("c", [0.0, 1.0])], "vec_id string, embedding array<float>")
    q = spark.createDataFrame([("x", [1.0, 0.0])], "query_id string, embedding array<float>")
    assert rows(dense.search(v, q, 2), "query_id", "rank", "id") == [("x", 1, "a"), ("x", 2, "b")]


def test_changes_of_many_documents(spark):
    reg = spark.createDataFrame([("d1", "new", 3, None), ("d2", "ready", 0, "n")], "doc_id string, status string, chunk_count int, notes string")
    out = store.with_changes(reg, spark.createDataFrame([("d1", "failed", None, "why"), ("zz", "ready", 1, None)], "doc_id string, status string, chunk_count int, notes string"))
    assert rows(out, "doc_id", "status", "chunk_count", "notes") == [("d1", "failed", 3, "why"), ("d2", "ready", 0, "n")]
    kept, counts = store.without(reg, spark.createDataFrame([("d1",), ("none",)], "doc_id string"), "doc_id")
    assert rows(kept, "doc_id") == [("d2",)] and rows(counts, "doc_id", "n") == [("d1", 1), ("none", 0)]
    safe, blocked = store.split_by_sensitivity(spark.createDataFrame([("a", "text", "high"), ("a", "text", None), ("a", "table", "low")], "doc_id string, chunk_type string, sensitivity_level string"))
    assert rows(store.ingestion_summary(safe, blocked), "doc_id", "chunk_type", "n_stored", "n_blocked") == [("a", "table", 1, 0), ("a", "text", 1, 1)]


def test_reset_removes_tables(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/a")
    store.reset(spark, [f"{tmp_path}/a", f"{tmp_path}/never"])
    assert not (tmp_path / "a").exists()


def test_documents_of_the_branches(spark):
    t = spark.createDataFrame([("d", 1, None, 1, "x")], "doc_id string, page int, section string, place int, text string")
    got = pages.passage_metadata(pages.document_passages(t, t.limit(0), t), F.lit("f.pdf"), F.lit(None).cast("string"), F.lit("")).orderBy("branch").collect()
    assert [(r["chunk_type"], r["branch"], r["section"], r["image_path"], r["has_image_text"]) for r in got] == [("text", 0, "Unknown Section", "", False), ("figure", 2, "Unknown Section", "", False)]


def test_greedy_figures_equal_brute_force(spark):
    import random

    r = random.Random(8)
    data = [(f"d{i % 3}", float(i), " ".join(r.choice(["order", "plant", "stock", "lock"]) for _ in range(r.randint(1, 6)))) for i in range(90)]
    want = set()
    for d in ("d0", "d1", "d2"):
        chosen = []
        for t, x in sorted(((t, x) for e, t, x in data if e == d), key=lambda y: (-len(y[1]), y[0], y[1])):
            if len(chosen) < 6 and all(timeline.similarity(x, c) < 0.9 for _, c in chosen):
                chosen.append((t, x))
        want |= {(d, t) for t, _ in chosen}
    got = timeline.distinct_figures(spark.createDataFrame(data, "doc_id string, start_sec double, text string")).collect()
    assert {(x["doc_id"], x["start_sec"]) for x in got} == want


def test_screenshots_as_passages(spark):
    f = spark.createDataFrame([("d", 65.0, "b"), ("d", 5.0, "a")], "doc_id string, start_sec double, text string")
    got = timeline.figure_passages(f, F.lit("r.mp4"), F.lit("d/1.png")).orderBy("segment_index").collect()
    assert [(r["segment_index"], r["start_time"]) for r in got] == [(0, "0:05"), (1, "1:05")] and got[0]["text"].startswith("[r.mp4 · screen at 0:05]\n")


def test_handover_payload(spark):
    m = spark.createDataFrame([(1, "c", "user", "q" * 200), (2, "c", "assistant", None)], "id int, conversation_id string, role string, content string")
    got = chat.handover_payloads(m, F.lit("2024-01-02 03:04:05").cast("timestamp_ntz")).first()
    assert got["ticket"] == "REQ20240102030405" and got["short_description"] == "q" * 100 and got["description"].endswith("User: " + "q" * 200 + "\nAssistant: ")


@pytest.mark.parametrize("seconds", [20, 100, 1800, 10**6])
def test_windows_do_not_depend_on_blocks(spark, seconds):
    r = random.Random(3)
    data = [(f"d{i % 2}", i, float(t), float(t + r.choice([2, 9, 70])) if r.random() < 0.9 else None, "x" * r.choice([3, 40, 200, 720])) for i, t in enumerate(sorted(r.randint(0, 4000) for _ in range(300)))]
    want = []
    for d in ("d0", "d1"):
        texts, start = [], 0.0
        for _, _, a, z, text in sorted(x for x in data if x[0] == d):
            start = start if texts else a
            texts.append(text)
            end = a if z is None else z
            if len(" ".join(texts)) >= 700 or end - start >= 60:
                want.append((d, start, end, len(texts)))
                texts = []
        if texts:
            want.append((d, start, end, len(texts)))
    got = timeline.speech_windows(spark.createDataFrame(data, "doc_id string, seg_no int, start_sec double, end_sec double, text string"), block_seconds=seconds)
    assert rows(got, "doc_id", "start", "end", "n_segments") == sorted(want)
    assert [x[1] for x in rows(got, "doc_id", "window_no") if x[0] == "d0"] == list(range(1, 1 + sum(x[0] == "d0" for x in want)))
    screens = spark.createDataFrame([(d, a, t) for d, _, a, _, t in data], "doc_id string, start_sec double, text string")
    sessions = rows(timeline.orphan_windows(screens, block_seconds=seconds), "doc_id", "session_no", "start", "end", "n_screens")
    assert sessions == rows(timeline.orphan_windows(screens, block_seconds=10**7), "doc_id", "session_no", "start", "end", "n_screens") and sum(x[4] for x in sessions) == 300
    gaps = rows(timeline.gap_sessions(screens, "doc_id", "start_sec", 30.0, seconds), "doc_id", "session_no", "start", "end", "n")
    assert gaps == rows(timeline.gap_sessions(screens, "doc_id", "start_sec", 30.0, 10**7), "doc_id", "session_no", "start", "end", "n")


def test_folds_of_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id string, seg_no int, start_sec double, end_sec double, text string")
    assert timeline.speech_windows(empty).count() == timeline.orphan_windows(empty).count() == 0


def test_windows_of_scattered_rows(spark, tmp_path):
    r = random.Random(5)
    data = [(f"d{d:03}", i, i * 5.0, i * 5.0 + 4, "y" * r.randint(20, 200)) for d in range(60) for i in range(5000 if d == 1 else 700)]
    want = {}
    for d, _, a, z, text in data:
        done, start, size, n = want.get(d) or ([], None, -1, 0)
        start, size, n = a if start is None else start, size + len(text) + 1, n + 1
        full = size >= 700 or z - start >= 60
        want[d] = (done + [(start, z, n)], None, -1, 0) if full else (done, start, size, n)
    whole = {d: len(done) + (n > 0) for d, (done, _, _, n) in want.items()}
    segments = spark.createDataFrame(data, "doc_id string, seg_no int, start_sec double, end_sec double, text string")
    segments.repartition(12).write.parquet(str(tmp_path / "segments"))
    segments = spark.read.parquet(str(tmp_path / "segments")).distinct()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.sparkContext.setJobGroup(str(tmp_path), "windows")
    try:
        windows = timeline.speech_windows(segments)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(str(tmp_path)))
        got = windows.collect()
    finally:
        spark.sparkContext.setJobGroup("", "")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {d: sum(x["doc_id"] == d for x in got) for d in whole} == whole
    found = {(x["doc_id"], x["window_no"]): (x["start"], x["end"], x["n_segments"]) for x in got}
    assert all(found[d, i + 1] == x for d, (done, *_) in want.items() for i, x in enumerate(done))
    assert jobs <= 26


def test_timeline_works_out_homes_once(spark):
    s = spark.createDataFrame([("d", i, i * 5.0, i * 5.0 + 1, "x" * 300) for i in range(20)], "doc_id string, seg_no int, start_sec double, end_sec double, text string")
    v = spark.createDataFrame([("d", t, "on screen") for t in (1.0, 70.0, 5000.0)], "doc_id string, start_sec double, text string")
    out = timeline.composed_timeline(s, v)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("sequence(") == 0
    assert out.where("has_screen_text").count() >= 3


def test_bm25_counts_words_once_for_all_blocks(spark, monkeypatch):
    r = random.Random(6)
    say = lambda n: " ".join(r.choice("alpha beta gamma delta eps zeta eta theta".split()) for _ in range(n))
    docs = spark.createDataFrame([(i, say(r.randint(0, 12))) for i in range(300)], "id int, text string")
    asked = spark.createDataFrame([(i, say(3)) for i in range(20)], "q int, t string")
    index = bm25.build(docs, "id", "text")
    want = sorted(map(tuple, bm25.search(index, asked, "q", "t", 7).collect()))
    monkeypatch.setattr(bm25, "BLOCK_QUERIES", 3)
    hits = bm25.search(index, asked, "q", "t", 7)
    assert hits._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    assert sorted(map(tuple, hits.collect())) == want
    monkeypatch.setattr(bm25, "PASS_BLOCKS", 2)
    assert sorted(map(tuple, bm25.search(index, asked, "q", "t", 7).collect())) == want


def test_bm25_looks_at_no_words_but_the_querys_own(spark, monkeypatch):
    """Words of other queries cost a query nothing, and scores are those of the formula."""
    import math

    r = random.Random(8)
    data = [(i, [f"w{int(r.paretovariate(0.7)) % 60}" for _ in range(r.randint(0, 15))]) for i in range(200)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in data], "id int, text string")
    asked = [(i, [f"w{r.randint(0, 60)}" for _ in range(4)]) for i in range(30)]
    q = spark.createDataFrame([(i, " ".join(w)) for i, w in asked], "q int, t string")
    index = bm25.build(docs, "id", "text")
    idf = {x["term"]: x["idf"] for x in index.terms.collect()}
    part = lambda n, dl: n * 2.5 / (n + 1.5 * (0.25 + 0.75 * dl / index.avgdl))
    score = lambda words, own: round(math.fsum(idf.get(t, 0.0) * part(own.count(t), len(own)) for t in words if t in own), 9)
    want = {(i, n + 1): x for i, words in asked for n, (_, x) in enumerate(sorted((-score(words, own), j) for j, own in data)[:7])}
    monkeypatch.setattr(bm25, "_ROWS", 32)
    assert {(h["query_id"], h["rank"]): h["id"] for h in bm25.search(index, q, "q", "t", 7).collect()} == want
    added = []
    monkeypatch.setattr(bm25._Rows, "add", lambda self, term, value: added.append(term))
    import numpy as np
    import pandas as pd

    rows = bm25._Rows(pd.DataFrame({"id": [1, 2], "ord": [1, 2], "words": ["w1 w2 w1", "w3"], "dl": [3, 1]}), {"w1": 0, "w2": 1, "w3": 2}, 2.0)
    rows.best(None, np.array([1]), np.array([0.5]), 5)
    assert added == [1]


def test_dense_looks_at_few_queries_and_rows_at_once(spark, monkeypatch):
    import numpy as np

    r = random.Random(7)
    data = [(f"v{i:03}", [float(r.randint(0, 2)) for _ in range(3)]) for i in range(200)]
    v = spark.createDataFrame(data, "vec_id string, embedding array<float>").coalesce(1)
    q = v.select(F.col("vec_id").alias("query_id"), "embedding")
    whole = sorted(map(tuple, dense.search(v, q, 5).collect()))
    unit = np.array([x for _, x in data])
    unit = unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-30)
    far = np.round(1 - unit @ unit.T, 9)
    want = {data[i][0]: [n for _, n in sorted(zip(far[i], (x for x, _ in data)))[:5]] for i in range(200)}
    monkeypatch.setattr(dense, "_ROWS", 16)
    monkeypatch.setattr(dense, "_QUERIES", 7)
    got = dense.search(v, q, 5).collect()
    assert sorted(map(tuple, got)) == whole
    assert {x: [h["id"] for h in sorted((h for h in got if h["query_id"] == x), key=lambda h: h["rank"])] for x in want} == want


def test_overviews_of_recordings_of_several_runs(spark):
    data = [(f"d{d}", i, i * 50.0, i * 50.0 + 4, f"word{i:05} " + "z" * 60) for d in range(3) for i in range(1500)]
    segments = spark.createDataFrame(data, "doc_id string, seg_no int, start_sec double, end_sec double, text string").repartition(9)
    got = rows(timeline.transcript_overview(segments), "doc_id", "n_windows", "duration", "overview")
    whole = " ".join(x[4] for x in data[:1500])[:1500].rsplit(" ", 1)[0] + " …"
    assert got == [(f"d{d}", 500, 1499 * 50.0 + 4, whole) for d in range(3)]


def test_windows_that_never_meet_take_few_rounds(spark, monkeypatch):
    """Segments at even distances: a run that begins at another place in its window never comes to the same windows."""
    from brindle.operators import ordered

    data = [(f"d{d}", i, i * 50.0, i * 50.0 + 4, "ab" * 20) for d in range(2) for i in range(1501)] + [("e", i, i * 50.0, i * 50.0, "word") for i in range(7)]
    segments = spark.createDataFrame(data, "doc_id string, seg_no int, start_sec double, end_sec double, text string").repartition(5)
    cuts = []
    cut = ordered.cut_lineage
    monkeypatch.setattr(ordered, "cut_lineage", lambda df: cuts.append(1) or cut(df))
    monkeypatch.setattr(ordered, "RUN", 1)
    got = timeline.speech_windows(segments, block_seconds=2500)
    want = []
    for doc in ("d0", "d1", "e"):
        begun, n, no = None, 0, 0
        own = [x for x in data if x[0] == doc]
        for _, i, a, z, t in own:
            begun, n = (a if begun is None else begun), n + 1
            if z - begun >= 60 or n * (len(t) + 1) >= 700 or i == len(own) - 1:
                no += 1
                want.append((doc, no, begun, z, n))
                begun, n = None, 0
    assert rows(got, "doc_id", "window_no", "start", "end", "n_segments") == want
    assert len(cuts) <= 2 * (ordered.ROUNDS + 1) + 1


def test_lines_of_thousands_of_screens_are_compared_as_far_as_they_show(spark):
    import time

    lines = [f"Line {i}" for i in range(9, 30_000)]
    kept = []
    for x in lines[:2000]:
        if not any(x.lower() in y.lower() for y in kept):
            kept.append(x)
    want = " | ".join(kept)[:1400].rsplit(" | ", 1)[0] + " | …"
    one = spark.createDataFrame([(lines,), (["a\nB", "b", "ab"],)], "t array<string>")
    began = time.time()
    assert [r[0] for r in one.select(timeline.joined_lines(F.col("t"))).collect()] == [want, "a | B | ab"]
    assert time.time() - began < 20


def test_bm25_scores_few_rows_by_the_formula(monkeypatch):
    """Bounds of many queries at once leave few rows to the formula, and lists are those of scoring every row by every word."""
    import numpy as np
    import pandas as pd

    r = random.Random(11)
    words = [[f"w{int(r.paretovariate(0.6)) % 80}" for _ in range(r.randint(0, 25))] for _ in range(6000)]
    words[4000:4100] = words[:100]  # ties
    data = pd.DataFrame({"id": range(6000), "ord": [-i for i in range(6000)], "words": [" ".join(w) for w in words], "dl": [len(w) for w in words]})
    terms = {f"w{i}": i for i in range(81)}
    own = [np.array(sorted(r.sample(range(40), 6) + [80])) for _ in range(200)] + [np.array([], dtype=np.int64)]
    values = [np.array([r.choice([-0.3, 0.5, 2.74, 9.1]) for _ in t]) for t in own]
    parts = [bm25._Rows(data.iloc[a:z], terms, 12.0) for a, z in ((0, 5000), (5000, 5003), (5003, 6000))]
    want = [None] * len(own)
    for rows in parts:
        want = [rows.best(x, t, v, 7) for x, t, v in zip(want, own, values)]
    added = []
    monkeypatch.setattr(bm25._Rows, "add", lambda self, term, value: added.append(term))
    got: list = [None] * len(own)
    for rows in parts:
        for some in bm25._grouped(own, np.diff(rows.at), len(rows.ids)):
            rows.best_of(got, some, own, values, 7)
    assert [[x.tolist() for x in y] for y in got] == [[x.tolist() for x in y] for y in want]
    assert not added


def test_bm25_takes_many_queries_in_one_pass(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, " ")], "id int, text string")
    index = bm25.build(docs, "id", "text")
    assert (index.n_docs, index.avgdl, index.terms.count()) == (3, 2 / 3, 2)
    hits = bm25.search(index, spark.range(20_000).select("id", F.lit("beta").alias("t")), "id", "t", 1)
    assert hits._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
