import json
import random

import pytest
from pyspark.sql import functions as F

from textmill import schema, sources, streaming
from textmill.config import Settings
from textmill.functions import geometry as G
from textmill.functions import jsonio
from textmill.operators import batching, cache, context, glossary, layout, markdown, segment, spatial, translate, validate, vision


def span(text, bbox, size=10.0, font="Body", color=0, flags=0):
    return {"text": text, "bbox": [float(v) for v in bbox], "size": float(size), "font": font, "color": color, "flags": flags, "ascender": None, "descender": None}


def block(*lines):
    def box(bs):
        return [min(b[0] for b in bs), min(b[1] for b in bs), max(b[2] for b in bs), max(b[3] for b in bs)]

    made = [{"bbox": box([s["bbox"] for s in ln]), "dir": [1.0, 0.0], "wmode": 0, "spans": list(ln)} for ln in lines]
    return {"type": 0, "bbox": box([m["bbox"] for m in made]), "number": 0, "lines": made}


def page(blocks, cells=()):
    tables = []
    if cells:
        tables = [{"bbox": [0.0, 0.0, 100.0, 20.0], "method": "x", "row_count": 1, "col_count": len(cells), "cells": [{"index": i, "bbox": [float(v) for v in c], "row": 0, "col": i} for i, c in enumerate(cells)]}]
    return ("d", 0, [0.0, 0.0, 595.0, 842.0], blocks, [], 0, tables)


def segments(spark, *pages, toc=None, **settings):
    df = spark.createDataFrame(list(pages), schema.PAGE)
    return segment.segments(df, toc, Settings(**settings)).orderBy("id").collect()


CELLS = ([0, 0, 50, 20], [50, 0, 100, 20])


def test_dominant_style(spark):
    b = block([span("", [0, 0, 1, 1], 5), span("●", [1, 0, 2, 1], 6), span(" body", [2, 0, 9, 1], 12, "Body", 123, 20)])
    r = segments(spark, page([b]))[0]
    assert (r.font, r["size"], r.color, r.flags) == ("Body", 12.0, 123, 20)


def test_two_blocks_in_two_cells(spark):
    rows = segments(spark, page([block([span("Left", [40, 5, 50, 15])]), block([span("Right", [51, 5, 60, 15])])], CELLS))
    assert [r.type for r in rows] == ["cell", "cell"]
    assert [r.layout_bbox for r in rows] == [[2, 1, 48, 19], [52, 1, 98, 19]]
    assert [(r.table_idx, r.cell_idx, r.row, r.col) for r in rows] == [(0, 0, 0, 0), (0, 1, 0, 1)]


def test_block_split_between_cells(spark):
    rows = segments(spark, page([block([span("Left", [5, 5, 40, 15])], [span("Right", [55, 5, 90, 15])])], CELLS))
    assert [(r.text, r.cell_idx, r.bbox) for r in rows] == [("Left", 0, [5, 5, 40, 15]), ("Right", 1, [55, 5, 90, 15])]


def test_blocks_of_one_cell_merge(spark):
    rows = segments(spark, page([block([span("b", [5, 10, 40, 16])]), block([span("a", [5, 2, 30, 8])])], CELLS))
    assert [(r.text, r.bbox) for r in rows] == [("a\nb", [5, 2, 40, 16])]


def test_close_blocks_merge_and_sections(spark):
    blocks = [block([span("第2章 总则", [0, 0, 50, 10])]), block([span("one", [0, 20, 20, 30])]), block([span(" two", [21, 20, 40, 30])]), block([span("three", [60, 20, 80, 30])])]
    rows = segments(spark, page(blocks))
    assert [(r.type, r.text, r.section_id) for r in rows] == [("heading", "第2章 总则", "ch2"), ("paragraph", "one\n two", "ch2"), ("paragraph", "three", "ch2")]


def test_toc_title_makes_a_heading(spark):
    toc = spark.createDataFrame([("d", 0, 1, "Some  Title", 1)], "doc_id string, pos int, lvl int, title string, page int")
    assert segments(spark, page([block([span("Some Title", [0, 0, 9, 9])])]), toc=toc)[0].type == "heading"


def test_parse_json(spark):
    doc = {"meta": {}, "toc": [[1, "T", 1]], "pages": [{"page": 0, "rect": [0, 0, 10, 10], "blocks": [block([span("x", [0, 0, 1, 1])])]}]}
    df = spark.createDataFrame([("d", json.dumps(doc))], "doc_id string, parse string")
    pages, toc = sources.parse_json_column(df)
    assert toc.first()["title"] == "T"
    assert segment.segments(pages, toc).count() == 1


def test_grid(spark):
    flat = spark.createDataFrame([("t", i, [float(x), float(y), x + 1.0, y + 1.0]) for i, (x, y) in enumerate([(0, 0), (0, 1), (1, 0), (1, 1)])], "t string, index int, bbox array<double>")
    slots = spark.createDataFrame([("t", y, x, [float(x), float(y), x + 1.0, y + 1.0]) for y in (0, 1) for x in (0, 1)] + [("t", 2, 0, [9.0, 9.0, 10.0, 10.0])], "t string, row int, col int, bbox array<double>")
    got = {r["index"]: (r["row"], r["col"]) for r in spatial.assign_grid(flat, slots, ["t"]).collect()}
    assert got == {0: (0, 0), 1: (1, 0), 2: (0, 1), 3: (1, 1), 4: (2, 0)}


def test_glossary(spark):
    terms = [("图", "a"), ("图像", "b")]
    df = spark.createDataFrame([("图像",), ("图像和图",)], "t string")
    got = [[p["source"] for p in r[0]] for r in df.select(glossary.relevant(F.array("t"), terms)).collect()]
    assert got == [["图像"], ["图像", "图"]]
    assert sources.parse_glossary('﻿zh,ru\n"甲","a, b"\n乙,c\n') == [("甲", "a, b"), ("乙", "c")]
    assert sources.parse_glossary("甲,a\n乙,c,d\n甲,z") == [("甲", "z"), ("乙", "c,d")]


def test_glossary_against_positions(spark):
    random.seed(2)
    terms = [("aa", "1"), ("ab", "2"), ("aab", "3"), ("b", "4")]
    texts = ["".join(random.choice("ab") for _ in range(random.randint(0, 12))) for _ in range(200)]

    def plain(text):
        taken, out = [False] * len(text), []
        for s in sorted((s for s, _ in terms), key=lambda s: -len(s)):
            hit = False
            for i in range(len(text) - len(s) + 1):
                if text[i : i + len(s)] == s and not any(taken[i : i + len(s)]):
                    taken[i : i + len(s)] = [True] * len(s)
                    hit = True
            out += [s] if hit else []
        return out

    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string")
    got = [[p["source"] for p in r[0]] for r in df.orderBy("i").select(glossary.relevant(F.array("t"), terms)).collect()]
    assert got == [plain(x) for x in texts]


def test_greedy_batches(spark):
    random.seed(1)
    sizes = [random.randint(0, 60) for _ in range(700)]
    want, batch, items, chars = [], 0, 0, 0
    for n in sizes:
        if items and (items >= 5 or chars + n > 100):
            batch, items, chars = batch + 1, 0, 0
        items, chars = items + 1, chars + n
        want.append(batch)
    df = spark.createDataFrame([("d", i, n) for i, n in enumerate(sizes)], "doc_id string, id int, n int")
    got = batching.greedy_batches(df, "doc_id", "id", F.col("n"), 5, 100).orderBy("id").collect()
    assert [r.batch for r in got] == want


def test_numbered_and_chunks(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    rows = batching.chunks(df, ["k"], 64).collect()
    assert all(r.chunk == r.k // 64 for r in rows)


def test_gap_clusters_and_rows(spark):
    df = spark.createDataFrame([("p", i, a, b) for i, (a, b) in enumerate([(0.0, 10.0), (5.0, 100.0), (150.0, 160.0), (221.0, 230.0)])], "page string, id int, a double, b double")
    assert [r["cluster"] for r in batching.gap_clusters(df, ["page"], "a", "b").orderBy("id").collect()] == [0, 0, 0, 1]
    cells = spark.createDataFrame([("p", 1, 0, 0, 10.0), ("p", 2, 0, 0, 11.0), ("p", 3, None, None, 12.0), ("p", 4, None, None, 30.0), ("p", 5, None, None, 32.0)], "page string, id int, table_idx int, row int, y0 double")
    assert [r.cell_row for r in batching.cell_rows(cells, ["page"]).orderBy("id").collect()] == [0, 0, 0, 1, 1]


def test_context(spark):
    rows = [("d", 1, "heading", "2", "Title"), ("d", 2, "paragraph", "2", "first"), ("d", 3, "paragraph", "2", "first"), ("d", 4, "paragraph", "2", ""), ("d", 5, "paragraph", "2", "second"), ("d", 6, "paragraph", "3", "third"), ("d", 7, "paragraph", None, "fourth")]
    df = spark.createDataFrame(rows, "doc_id string, id int, type string, section_id string, text string")
    got = {r.id: (r.document_title, r.section_title, r.previous_text, r.next_text) for r in context.contexts(df).collect()}
    assert got[3] == ("Title", "Title", "Title", "second")
    assert got[5] == ("Title", "Title", "first", None)
    assert got[6] == ("Title", "Title", None, "fourth")
    assert got[7][2] == "third"
    assert got[1][1] is None


def test_context_against_search(spark):
    random.seed(4)
    rows = [(d, i, random.choice(["heading", "paragraph"]), random.choice([None, "", "1", "2"]), random.choice(["", "a", "b", "c"])) for d in ("x", "y") for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id string, id int, type string, section_id string, text string")
    got = {(r.doc_id, r.id): (r.previous_text, r.next_text) for r in context.contexts(df).collect()}

    def look(doc, i, step):
        own = doc[i]
        j = i + step
        while 0 <= j < len(doc):
            if own[3] and doc[j][3] and own[3] != doc[j][3]:
                return None
            if doc[j][4] and doc[j][4] != own[4]:
                return doc[j][4]
            j += step
        return None

    for name in ("x", "y"):
        doc = [r for r in rows if r[0] == name]
        assert all(got[name, i] == (look(doc, i, -1), look(doc, i, 1)) for i in range(len(doc)))


def test_cache(spark):
    log = spark.createDataFrame([("k", "s", "old", "1", "m", "h", 1), ("k", "s", "new", "2", "m", "h", 1), ("r", "s", "x", "1", "m", "h", 1), ("r", "s", "x", "2", "m", "h", 0)], schema.CACHE)
    assert [(r.key, r.dst) for r in cache.current(log).collect()] == [("k", "new")]
    assert cache.upgraded(log.drop("accepts_review")).first()["accepts_review"] == 1


SEGMENT = "doc_id string, id int, page int, type string, section_id string, text string, bbox array<double>, layout_bbox array<double>"


def seg(i, text, kind="paragraph"):
    return ("d", i, 0, kind, None, text, None, None)


def answer(request, texts):
    return json.dumps({"items": [{"id": x["id"], "translation": texts(x, request)} for x in request["items"]]}, ensure_ascii=False)


def test_translate_retries_only_what_failed(spark, tmp_path):
    log = tmp_path / "calls"

    def reply(request):
        with open(log, "a") as f:
            f.write(json.dumps([[x["id"] for x in request["items"]], request.get("violations")]) + "\n")
        return answer(request, lambda x, r: "Первый" if x["id"] == "1" else "Второй" if r.get("violations") else "Второй 中")

    df = spark.createDataFrame([seg(1, "第一"), seg(2, "第二")], SEGMENT)
    s = Settings(workers=1)
    done = translate.translate(df, translate.Scripted(reply), s)
    got = done.orderBy("id").collect()
    assert [(r.dst, r.ok, r.cached) for r in got] == [("Первый", True, False), ("Второй", True, False)]
    calls = [json.loads(x) for x in open(log)]
    assert [c[0] for c in calls] == [["1", "2"], ["2"]]
    assert "residual_han" in json.dumps(calls[1][1])
    saved = translate.cache_rows(done, s)
    again = translate.translate(df, translate.Scripted(lambda r: 1 / 0), s, log=saved).collect()
    assert all(r.cached and r.ok for r in again)


def test_translate_keeps_source_in_the_end(spark):
    df = spark.createDataFrame([seg(1, "型号 XG-200"), seg(2, " ")], SEGMENT)
    done = translate.translate(df, translate.Scripted(lambda r: answer(r, lambda x, _: "Модель")), Settings(max_attempts=2))
    got = {r.id: r for r in done.collect()}
    assert (got[1].ok, got[1].dst, got[1].reasons) == (False, "型号 XG-200", ["critical_tokens_mismatch"])
    assert got[2].ok and got[2].cached
    stats = translate.statistics(done, ["doc_id"]).first()
    assert (stats.ok, stats.cached, stats.fail, stats.failed_ids) == (1, 1, 1, [1])


def test_translate_repairs_fragments(spark):
    def reply(request):
        if "fragments" in request:
            return json.dumps({"replacements": [{"source": x, "target": "лес"} for x in request["fragments"]]}, ensure_ascii=False)
        return answer(request, lambda x, _: "Тёмный 林")

    df = spark.createDataFrame([seg(1, "黑林")], SEGMENT)
    got = translate.translate(df, translate.Scripted(reply), Settings()).first()
    assert (got.ok, got.dst) == (True, "Тёмный лес")


def test_stale_cache_is_translated_again(spark):
    s = Settings()
    df = spark.createDataFrame([seg(1, "型号 XG-200")], SEGMENT)
    record = translate.prepare(df, s).first()
    log = spark.createDataFrame([(record.cache_key, "x", "Модель", "1", s.model, record.prompt_hash, 1)], schema.CACHE)
    got = translate.translate(df, translate.Scripted(lambda r: answer(r, lambda x, _: "Модель XG-200")), s, log=log).first()
    assert (got.ok, got.cached, got.dst, got.stale) == (True, False, "Модель XG-200", True)


def test_too_long_draft_stands(spark):
    df = spark.createDataFrame([("d", 1, 0, "paragraph", None, "短", [0.0, 0.0, 10.0, 10.0], None)], SEGMENT)
    got = translate.translate(df, translate.Scripted(lambda r: answer(r, lambda x, _: "очень длинный перевод слова")), Settings(max_attempts=1)).first()
    assert (got.ok, got.review) == (True, 2)


def test_validation(spark):
    def side(text, size=9.0, y=400.0):
        pages = spark.createDataFrame([("d", 0, text)], "doc_id string, page int, text string")
        spans = spark.createDataFrame([("d", 0, "s", text, size, [50.0, y, 300.0, y + 10], 842.0)], "doc_id string, page int, id string, text string, size double, bbox array<double>, page_height double")
        docs = spark.createDataFrame([("d", 1, 0, 0, 0)], "doc_id string, pages int, images int, toc_len int, max_level int")
        return {"pages": pages, "spans": spans, "docs": docs}

    def checks(src, out, **more):
        return {r.check for r in validate.validate(src, out, Settings(), **more).collect()}

    good = "Достаточно длинный русский текст"
    assert checks(side("原文文本内容"), side(good)) == set()
    assert checks(side("原文"), side(good, 6.0)) == {"too_small"}
    assert checks(side("12", 6.0, 820.0), side("Стр", 6.0, 820.0)) == set()
    assert "residual_script" in checks(side("原文"), side(good + " 文"))
    assert "invalid_characters" in checks(side("原文"), side(good + "�"))
    assert "anchors" in checks(side("图1-1 图1-1"), side("Рис. 1-1 " + good))
    assert checks(side("图1-1"), side("Рис. 1­1 " + good)) == set()
    long = "原文" * 30
    assert "thinned_pages" in checks(side(long), side("Кор"))
    report = spark.createDataFrame([("d", json.dumps({"appendix_pages": 1, "notfit": 0, "overflow": [{"page": 0}]}))], "doc_id string, report string")
    assert "thinned_pages" not in checks(side(long), side("Корот"), reports=report)
    bad = spark.createDataFrame([("d", json.dumps({"a": [{"notfit": 1}], "source_retained_blocks": "1"}))], "doc_id string, report string")
    assert "layout_report" in checks(side("原文"), side(good), reports=bad)
    docs = side("x")["docs"]
    assert validate.exit_codes(docs, docs, spark.createDataFrame([("d", "x")], "doc_id string, check string")).first().code == 1


def test_bag_difference(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",)], "k string")
    b = spark.createDataFrame([("x",), ("z",)], "k string")
    assert {(r.k, r.missing, r.extra) for r in validate.bag_difference(a, b, ["k"]).collect()} == {("x", 1, 0), ("y", 1, 0), ("z", 0, 1)}


def test_layout(spark):
    rows = [("d", 0, 1, "paragraph", [50.0, 50.0, 300.0, 62.0], None, 10.0, "Body", None, None, "x", "Короткий текст"), ("d", 0, 2, "paragraph", [50.0, 100.0, 80.0, 105.0], None, 10.0, "Body", None, None, "x", "Слово " * 40), ("d", 0, 3, "paragraph", [50.0, 110.0, 300.0, 122.0], None, 10.0, "Body", None, None, "x", "文"), ("d", 0, 4, "paragraph", [50.0, 140.0, 300.0, 152.0], None, 10.0, "Body", None, None, "x", "")]
    df = spark.createDataFrame(rows, "doc_id string, page int, id int, type string, bbox array<double>, layout_bbox array<double>, size double, font string, table_idx int, row int, text string, ru string")
    planned = layout.plan(df, Settings())
    got = {r.id: r for r in planned.collect()}
    assert {i: r.route for i, r in got.items()} == {1: "placed", 2: "appendix", 3: "retained", 4: "skipped"}
    assert got[1]["size"] == 10.0 and "[T2]" in got[2].marker
    total = layout.report(planned).first()
    assert (total.total_blocks, total.overflow_blocks, total.source_retained_blocks) == (1, 1, 1)
    assert "[T2]" in layout.appendix_html(planned).first().html


def test_budget(spark):
    df = spark.createDataFrame([("d", 0, 1, "cell", [0.0, 0.0, 100.0, 20.0], None, None)], "doc_id string, page int, id int, type string, bbox array<double>, layout_bbox array<double>, size double")
    assert spatial.budgets(df, Settings(), ["doc_id", "page"]).first().max_chars == int(100 / (7.5 * 0.56) * 2 * 0.9)


def test_geometry(spark):
    r = spark.range(1).select(
        G.expanded_rect(G.pixel_rect(F.array(F.lit(210), F.lit(311), F.lit(787), F.lit(563)), F.lit(1200), F.lit(360)), F.lit(1200), F.lit(360), 3).alias("a"),
        G.foreground(F.array(F.lit(200), F.lit(200), F.lit(200))).alias("f"),
        G.rgb(F.lit(0xFF0000)).alias("c"),
    ).first()
    assert r.a == [224, 107, 973, 207] or r.a == [224, 108, 973, 207] or r.a == [224, 107, 972, 207]
    assert r.f == [0, 0, 0] and r.c == [1.0, 0.0, 0.0]


def test_regions(spark):
    ok = {"bbox": [10, 20, 30, 40], "source_text": "设置 A1", "translation": "Настройки A1", "confidence": 1.4}
    bad = [ok | {"bbox": [0, 0, 2000, 5]}, ok | {"translation": "Настройки"}, ok | {"bbox": [5, 5, 5, 9]}, ok | {"source_text": "A1"}, ok | {"translation": "Settings A1"}]
    second = {"bbox_2d": [1, 1, 9, 9], "source_text": "文", "translation": "Текст", "confidence": "0.5"}
    raw = ["<think>x</think> Here:\n```json\n" + json.dumps({"regions": [ok, ok, *bad, second]}) + "\n```", "words {\"regions\": []} more", "nothing", json.dumps({"regions": [ok]})]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, raw string")
    got = [r[0] for r in jsonio.with_regions(df, "raw", "zh", "ru").orderBy("i").select("regions").collect()]
    assert [(x.translation, x.confidence) for x in got[0]] == [("Текст", 0.5), ("Настройки A1", 1.0)]
    assert [len(x) for x in got[1:]] == [0, 0, 1]
    assert got[3][0].confidence == 1.0


def test_json_array(spark):
    df = spark.createDataFrame([('```json\n["a"]\n```',), ('so: ["b", "c"] ok',), ("none",)], "t string")
    assert [r[0] for r in df.select(jsonio.json_array(F.col("t"))).collect()] == ['["a"]', '["b", "c"]', None]


def test_vision(spark):
    pages = spark.createDataFrame([("d", p, [0.0] * 4, [], [{"xref": 7, "bbox": [0.0] * 4, "width": 100, "height": 50}], 0, []) for p in (0, 1)], schema.PAGE)
    images, extra = vision.unique_images(pages)
    assert (images.count(), extra.first().duplicate_xrefs) == (1, 1)
    reply = json.dumps({"regions": [{"bbox": [100, 100, 900, 900], "source_text": "文", "translation": "Текст", "confidence": 0.9}]})
    read = vision.read_images(images.withColumn("content", F.lit(b"x")), vision.Fixed(reply), "zh", "ru")
    planned = vision.overlay_plan(read.select("doc_id", "xref", "width", "height", F.explode("regions").alias("region")))
    total = vision.report(read, planned).first()
    assert (total.outcome, total.processed, total.regions_processed) == ("success", 1, 1)
    failed = vision.report(*[vision.read_images(images.withColumn("content", F.lit(b"x")), vision.Fixed("no"), "zh", "ru"), planned]).first()
    assert (failed.outcome, failed.attempts) == ("failed", 3)


def test_markdown_pages(spark):
    pages = spark.createDataFrame([("d", 0, "a"), ("d", 1, ""), ("d", 2, "c")], "doc_id string, page int, text string")

    class Echo:
        def complete(self, messages):
            text = json.loads(messages[-1]["content"])["document_page"]
            if text == "c":
                raise ValueError("down")
            return "```md\n" + text + "!\n```"

    done = markdown.translate_pages(pages, Echo())
    assert [r.markdown for r in done.orderBy("page").collect()] == ["a!", "", ""]
    again = markdown.translate_pages(pages, translate.Scripted(lambda r: "new"), done=done)
    assert [r.markdown for r in again.orderBy("page").collect()] == ["a!", "", "new"]


def test_csv(spark, tmp_path):
    assert sources.parse_csv('﻿a,"b,""c"""\r\n\n"x\ny",z') == [["a", 'b,"c"'], [""], ["x\ny", "z"]]
    (tmp_path / "in.csv").write_bytes('甲,x\r\n"乙,1",y'.encode("gb18030"))
    grid = sources.read_grid(spark, str(tmp_path / "in.csv"))
    assert {(r.line, r.col, r.value) for r in sources.han_cells(grid).collect()} == {(0, 0, "甲"), (1, 0, "乙,1")}
    assert sources.promote(grid, str(tmp_path / "tmp.csv"), str(tmp_path / "out.csv")) == 2
    assert not (tmp_path / "out.csv").exists()
    clean = grid.withColumn("value", F.regexp_replace("value", "[甲乙]", "я"))
    assert sources.promote(clean, str(tmp_path / "tmp.csv"), str(tmp_path / "out.csv")) == 0
    assert (tmp_path / "out.csv").read_bytes() == '﻿я,x\r\n"я,1",y'.encode()


def test_all_leftovers(spark, tmp_path):
    grid = spark.range(10_050).select(F.lit("f").alias("file"), F.col("id").alias("line"), F.lit(0).alias("col"), F.lit("甲").alias("value"))
    assert sources.promote(grid, str(tmp_path / "tmp.csv"), str(tmp_path / "out.csv")) == 10_050
    text = (tmp_path / "tmp.csv.leftovers.json").read_text(encoding="utf-8")
    want = [{"line": i + 1, "col": 1, "value": "甲"} for i in range(10_050)]
    assert text == json.dumps(want, ensure_ascii=False, indent=2)


def test_progress(spark):
    lines = ["=== ЭТАП: PARSE ===", "parse page 3/9", "=== ЭТАП: TRANSLATE ===", "Сегментов: 40", " 50%|#####     | 20/40", "ok=19 cached=2 fail=1"]
    df = spark.createDataFrame([("j", i, x) for i, x in enumerate(lines)], "job string, seq int, line string")
    r = streaming.job_states(df).first()
    assert (r.stage, r.progress, r.total, r.ok, r.cached, r.fail) == ("translate", 20, 40, 19, 2, 1)
    lines = ['@@VISION@@ {"event": "progress", "phase": "done", "current": 1, "total": 5, "cached": 1, "failed": -2}', "image 2/5"]
    df = spark.createDataFrame([("j", i, x) for i, x in enumerate(lines)], "job string, seq int, line string")
    r = streaming.image_states(df).first()
    assert (r.phase, r.progress, r.total, r.cached, r.failed) == ("done", 2, 5, 1, 0)


def test_progress_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"job":"j","seq":1,"line":"=== ЭТАП: PARSE ==="}\n{"job":"j","seq":2,"line":"parse page 3/9"}\n')
    lines = spark.readStream.schema("job string, seq int, line string").json(str(tmp_path / "in"))
    q = streaming.job_states(lines).writeStream.outputMode("complete").format("memory").queryName("states").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    assert spark.table("states").first().progress == 3


def test_grid_translation(spark):
    from textmill.operators import grid

    class Model:
        def complete(self, messages):
            text = messages[-1]["content"]
            if text.startswith("["):
                return json.dumps([{"甲": "А", "乙": "乙"}.get(x, "") for x in json.loads(text)], ensure_ascii=False)
            return "Б"

    cells = spark.createDataFrame([("f", 0, 0, "甲"), ("f", 0, 1, "x"), ("f", 1, 0, "乙"), ("f", 1, 1, "甲")], "file string, line long, col int, value string")
    got = {(r.line, r.col): r.value for r in grid.translate_cells(cells, Model()).collect()}
    assert got == {(0, 0): "А", (0, 1): "x", (1, 0): "Б", (1, 1): "А"}
    assert grid.max_tokens(10) == 732 and grid.max_tokens(10, batch=False) == 280
    assert grid.translate_stem("0123456789ab_Имя V2", Model(), "ru") == "Б"
    r = spark.range(1).select(grid.progress(F.lit(50), F.lit(100), F.lit(10.0)).alias("p")).first().p
    assert (r.rate, r.eta) == (5.0, 10)


def test_document_job(spark, tmp_path):
    from textmill.plans.document import compare, document_job

    blocks = [block([span("第1章 总则", [50, 50, 300, 62])]), block([span("型号 XG-200", [50, 80, 300, 92])])]
    pages = spark.createDataFrame([page(blocks)], schema.PAGE)
    toc = spark.createDataFrame([("d", 0, 1, "第1章 总则 ..... 1", 0)], "doc_id string, pos int, lvl int, title string, page int")
    model = translate.Dictionary({"第1章": "Глава 1", "总则": "Общее", "型号": "Модель"})
    job = document_job(spark, pages, toc, model, {"source_lang": "zh", "target_lang": "ru"}, "h", str(tmp_path))
    assert job.run() == ["segment", "translate", "layout"]
    assert job.run(resume=True) == []
    planned = spark.read.parquet(str(tmp_path / "layout.parquet"))
    assert sorted(r.layout_text for r in planned.collect()) == ["Глава 1 Общее", "Модель XG-200"]
    assert spark.read.parquet(str(tmp_path / "toc.parquet")).first().target == "Глава 1 Общее"
    assert compare(pages, planned).collect() == []


def test_border_median_and_boxes(spark):
    pixels = bytearray(bytes([10, 20, 30]) * 25)
    for y in range(1, 4):
        for x in range(1, 4):
            pixels[(y * 5 + x) * 3 : (y * 5 + x) * 3 + 3] = bytes([200, 200, 200])
    df = spark.createDataFrame([(pixels, 5, 5, [1, 1, 4, 4])], "px binary, w int, h int, r array<int>")
    assert df.select(vision.border_median(F.col("px"), F.col("w"), F.col("h"), F.col("r"))).first()[0] == [10, 20, 30]
    whole = df.withColumn("r", F.array(*map(F.lit, (0, 0, 5, 5))))
    assert whole.select(vision.border_median(F.col("px"), F.col("w"), F.col("h"), F.col("r"))).first()[0] == [10, 20, 30]
    boxes = spark.createDataFrame([([1.0, 9.0, 20.0, 30.0],), ([5.0, 2.0, 50.0, 12.0],)], "b array<double>")
    page_box = F.array(*[F.lit(float(v)) for v in (0, 0, 51, 90)])
    assert boxes.agg(G.page_text_box("b", page_box)).first()[0] == [0.0, 0.0, 51.0, 32.0]


def test_html_and_names(spark):
    r = spark.createDataFrame([("a<b>&",)], "t string").select(markdown.to_html(F.col("t")).alias("h"), markdown.font_family(F.lit("x/y/Deja Vu.ttf")).alias("f"), markdown.page_text(F.lit(" "), F.col("t")).alias("p")).first()
    assert "<pre>a&lt;b&gt;&amp;</pre>" in r.h and r.f == "Deja Vu" and r.p == "a<b>&"
    assert "15.0pt" in markdown.css("X", 10.0)
    pages = spark.createDataFrame([("d", 1, "b"), ("d", 0, "a")], "doc_id string, page int, markdown string")
    assert markdown.pages_map(pages).first().pages == {0: "a", 1: "b"}


def test_reports_and_errors(spark, tmp_path):
    assert validate.load_report(inline={"a": 1}) == ({"a": 1}, None)
    assert validate.load_report(path=str(tmp_path / "none"))[1] and validate.load_report(output=str(tmp_path / "none")) == (None, None)
    (tmp_path / "x.layout.json").write_text("{")
    assert validate.load_report(output=str(tmp_path / "x"))[1]
    told = lambda report: spark.createDataFrame([(json.dumps(report),)], "r string").select(validate.layout_failures(F.col("r"))).first()[0]
    assert told({"notfit": {"count": 0}, "items": [{"status": "Not-Fit"}], "lost": "2"}) == ["report.items[0].status=Not-Fit", "report.lost"]
    quiet = [None, False, 0, -1, "", " OK ", "none", "0", "0.0", "-3", "nan", [], {}, {"count": 0}, {"total": {"value": "false"}}, {"items": []}]
    loud = [True, 1, 0.5, "2", "yes", "inf", [0], {"x": 0}, {"count": 1}, {"blocks": ["a"]}, {"count": {"segments": [1]}}]
    assert [x for x in quiet if told({"Not Fit": x})] == [] and [x for x in loud if told({"Not Fit": x}) != ["report.Not Fit"]] == []
    assert told([{"state": "dropped"}, {"lost": {"lost": 1}}]) == ["report[0].state=dropped", "report[1].lost", "report[1].lost.lost"]
    reports = spark.createDataFrame([("d", json.dumps({"appendix_pages": "2", "overflow": [{"page": 3}, {"page": "x"}]})), ("e", json.dumps({"appendix_pages": 1, "lost": 1, "overflow": [{"page": 0}]}))], "doc_id string, report string")
    assert [tuple(r) for r in validate.overflow_pages(reports).collect()] == [("d", 3)]
    fonts = sources.font_table(spark, [("a", "A", True), ("a", "B", True), ("b", "B", False)])
    assert fonts.count() == 2
    (tmp_path / "f.ttf").write_text("")
    assert sources.find_font(["", str(tmp_path / "no"), str(tmp_path / "f.ttf")], lambda p: True).endswith("f.ttf")


def test_prompts_and_instructions(spark):
    assert "Рис." in translate.system_prompt(Settings())
    df = spark.createDataFrame([("图1-1 XG-200 中文",)], "t string")
    reasons = F.array(*map(F.lit, ("residual_han", "anchor_numbers_mismatch", "critical_tokens_mismatch", "other")))
    told = df.select(translate.instructions(F.col("t"), reasons, F.lit(None).cast("int"))).first()[0]
    assert "中文" in told[0] and "1-1" in told[1] and "code:xg-200" in told[2] and told[3] == "other"
    bad = df.select(translate.violations(F.col("t"), F.lit("Рис. 1-1 XG-200 中"), F.lit(5))).first()[0]
    assert bad == ["residual_han", "translation_too_long"]
    assert df.select(translate.violations(F.col("t"), F.lit(" "), F.lit(5))).first()[0] == ["empty_translation"]


def test_uploads_stream(spark, tmp_path):
    from textmill.sources import intake

    folder = tmp_path / "in"
    folder.mkdir()
    for name, content in (("0123456789ab_a.pdf", b"%PDF"), ("0123456789ab_b.txt", b"x"), ("0123456789ab_c.pdf", b""), ("free.pdf", b"%PDF")):
        (folder / name).write_bytes(content)
    query = intake.uploads(spark, str(folder)).writeStream.format("memory").queryName("uploads_seen").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "at")).start()
    query.awaitTermination()
    got = spark.table("uploads_seen").collect()
    assert [(r.job_id, r.name, bytes(r.content)) for r in got] == [("0123456789ab", "a.pdf", b"%PDF")]


def test_translation_keeps_any_key(spark):
    """String ids and a key of any name go through retries and come back."""

    class Late:
        def complete(self, messages):
            items = json.loads(messages[-1]["content"])["items"]
            return json.dumps({"items": [{"id": x["id"], "translation": x["source"]} for x in items[: len(items) - (len(items) > 1)]]})

    rows = spark.createDataFrame([("f", i, "paragraph", f"text {i}") for i in ("a", "b", "9999999999999")], "file string, id string, type string, text string")
    got = translate.translate(rows, Late(), Settings(source_lang="en", target_lang="de"), key="file").collect()
    assert sorted((r.file, r.id, r.dst, r.ok) for r in got) == [("f", "9999999999999", "text 9999999999999", True), ("f", "a", "text a", True), ("f", "b", "text b", True)]


def _plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_boxes_and_cells_are_never_paired_as_rows(spark):
    boxes = spark.range(3).selectExpr("0 AS page", "id AS box_id", "array(id * 10.0D, 0D, id * 10.0D + 5, 5D) AS bbox")
    cells = spark.range(2).selectExpr("0 AS page", "0 AS table_idx", "array(0D, 0D, 20D, 10D) AS table_bbox", "id AS cell_pos", "id AS cell_idx", "0 AS row", "id AS col", "array(id * 10.0D, 0D, id * 10.0D + 8, 8D) AS cell_bbox")
    got = spatial.locate(boxes, cells, ["page"])
    assert [r[:] for r in got.orderBy("box_id").select("table_idx", "cell_idx").collect()] == [(0, 0), (0, 1), (None, None)]
    assert "SortAggregate" not in _plan_of(got) and _plan_of(got).count("Join") == 1


def test_segments_hold_no_table_in_the_driver(spark, tmp_path):
    from textmill import sources

    page = '{"toc": [["1", "a", "1"]], "pages": [{"page": 0, "rect": [0, 0, 9, 9], "blocks": []}]}'
    spark.createDataFrame([(1, page)], "doc_id long, parse string").write.parquet(str(tmp_path / "t"))
    pages, toc = sources.parse_json_column(spark.read.parquet(str(tmp_path / "t")))
    told = _plan_of(segment.segments(pages, toc))
    assert "Broadcast" not in told and told.count("FileScan") == 2


def test_images_are_painted_without_a_table_for_each(spark):
    from textmill.operators import paint

    rows = spark.sql("SELECT 1 AS key, unhex(repeat('000000', 16)) AS raw, 4 AS width, 4 AS height, named_struct('translation', '') AS region, array(1, 1, 3, 3) AS pixels, id = 0 AS painted FROM range(2)")
    got = paint.paint_regions(rows, paint.Bars())
    assert got.select("processed", "skipped", "modified").collect()[0][:] == (1, 1, True)
    assert "FlatMapGroups" not in _plan_of(got)


@pytest.mark.parametrize("name", ["painted_images", "region_answers", "layout_counts", "layout_report", "segment_tables"])
def test_rows_of_a_small_file_are_dealt_out(spark, monkeypatch, name):
    from textmill import plans

    dealt = []
    monkeypatch.setattr(batching, "spread", lambda rows, *keys, f=batching.spread: dealt.append(f(rows, *keys)) or dealt[-1])
    plans.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(dealt) == 1
    assert batching.spread(spark.range(20000), "id").rdd.getNumPartitions() == 3


def test_texts_are_fitted_once_however_often_sizes_are_drawn_together(spark):
    from textmill.plans import reports

    rows = reports._laid(spark, "/root/testdata/sf0.001")
    told = _plan_of(layout.plan(rows, Settings(source_lang="en", target_lang="de")))
    assert "planned-" in told and "part.parquet" not in told


def test_tasks_grow_slower_than_quick_requests():
    assert [translate.tasks(n) for n in (0, 1, 32, 33, 64 * 32)] == [1, 1, 1, 2, 64]
    assert 64 <= translate.tasks(64 * 32 + 1) and translate.tasks(1_200_000) < 2_000
    assert translate.tasks(7_200_000) > 2 * translate.tasks(1_200_000)
