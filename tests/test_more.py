"""Headings, contents, scores, line sets, files, books and display order, most of them without SQL."""

import io
import itertools
import random
import xml.dom.minidom
import zipfile

import pytest
from pyspark.sql import functions as F

from folianth.functions import bidi as D
from folianth.functions import text as T
from folianth.operators import evaluate as E
from folianth.operators import headings as H
from folianth.operators import joins as J
from folianth.operators import lineset as L
from folianth.operators import scorecard as R
from folianth.operators import sequence as S
from folianth.sources import files as X
from folianth.sources import sinks as K

Z = "‌"
LINE = "امروز صبح زود پدرم به باغ رفت و درختان سیب را آب داد"


def each(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r.x for r in rows.select("i", f(F.col("s")).alias("x")).orderBy("i").collect()]


def test_headings(spark):
    asked = ["فصل دوازدهم", "نصل اآول", "فصل ۳", "فصل دو از دهم:", "بخش سی ام", "نخش دوم", "فصل", "فصل دوم!", "فصل یک روز بارانی", "قسمت بیست و یکم", None]
    want = ["فصل دوازدهم", "فصل اول", "فصل ۳", "فصل دوازدهم", "بخش سی‌ام", None, None, None, None, "قسمت بیست و یکم", None]
    assert each(spark, H.match_heading, asked) == want
    titles = ["۲ـ غلام", "3: طرح یک بیماری", "ا-مهدی", "0- غلام", "۲ غلام آمد.", "12", "۱۳ ab cd"]
    assert each(spark, T.numbered_title, titles) == ["۲- غلام", "۳- طرح یک بیماری", "۱- مهدی", None, None, None, None]


def test_contents(spark):
    names = ["راه شکستن طلسم", "خانه پدری", "باغ سیب", "شب زمستان"]
    rows = [("b", i, f"{i + 1}- {t} .... {9 * i}", False, True, 90.0) for i, t in enumerate(names)]
    rows += [("b", 10, "راه شکست. ما", True, False, 60.0), ("b", 11, "خانه پدری", False, False, 80.0), ("b", 12, "این یک جمله دیگر از متن است", False, False, 80.0), ("c", 0, "۱- باغ سیب", False, True, 90.0), ("c", 1, "باغ سیب", False, False, 50.0)]
    paras = spark.createDataFrame(rows, "book string, para_no int, text string, heading boolean, sparse boolean, conf double")
    assert sorted((r.book, r.entry) for r in H.contents_entries(paras).collect()) == sorted(("b", t) for t in names)
    got = {(r.book, r.para_no): (r.text, r.heading) for r in H.apply_contents(paras).collect() if not r.sparse}
    assert got == {("b", 10): ("راه شکستن طلسم", True), ("b", 11): ("خانه پدری", True), ("b", 12): ("این یک جمله دیگر از متن است", False), ("c", 1): ("باغ سیب", False)}


def test_full_scores(spark):
    assert R.full_score("به خانه رفت", "بخانه رفت")["char_errors"] == 1 and R.full_score("به خانه رفت", "بخانه رفت")["word_errors"] == 2
    ref, ocr = "یک دو سه چهار\nپنج شش هفت هشت\nنه ده یازده", "نه ده یازده\nپنج شش هفت هشت\nیادداشت پایین صفحه\nیک دو سه چهار"
    r = R.full_score(ref, ocr)
    assert (r["line_char_errors"], r["extra_lines"], r["line_pairs"], r["line_pairs_in_order"], r["unordered_hits"]) == (0, 1, 2, 0, 11)
    before = "این جمله فقط در متن مرجع آمده است و در صفحه نیست " * 5
    r = R.full_score(before + LINE, LINE)
    assert r["trim_from"] is not None and r["ref_words"] < 5 * 11 and R.full_score(LINE, " ".join(LINE.split()[3:]))["trim_from"] is None
    pairs = spark.createDataFrame([(1, LINE, LINE.replace("پدرم", "بدرم")), (2, None, "")], "id int, reference string, other string")
    one = R.rates_in_full(R.compare_in_full(pairs)).first()
    assert one.cer == 1 / 40 and one.wer == 1 / 13 and one.recall == 12 / 13
    s = [tuple(r.s) for r in spark.createDataFrame([("می رود خانه", f"می{Z}رود خانه"), ("یک دو", "یکدو")], "a string, b string").select(R.spacing(F.col("a"), F.col("b")).alias("s")).collect()]
    assert s == [(1, 2), (1, 1)]
    assert 'fill="#2f6fb0"' in R.bar_chart("t", [("a", 1.0), ("b", 2.0)]) and "#2f6fb0" not in R.bar_chart("t", [("a", 1.0), ("b", 1.0)])


def test_half_spaces_against_a_plain_walk():
    import re

    def walk(s):
        out, n = [], 0
        for tok in s.split(" "):
            if out:
                w, a = re.sub(r"^\W+", "", out[-1]), re.sub(r"\W+$", "", tok)
                parts = [E.bare(x) for x in w.split(Z)]
                first = E.bare(a.split(Z)[0])
                fits = first in E.PLURAL + E.COMPARATIVE or (first in E.AFTER_SILENT_H and parts[-1].endswith("ه")) or Z.join(parts) in E.PREFIXES
                if w.replace(Z, "").isalpha() and a.replace(Z, "").isalpha() and not re.search(r"\W$", w) and not re.match(r"\W", a) and any(parts) and first and fits:
                    out[-1], n = out[-1] + Z + tok, n + 1
                    continue
            out.append(tok)
        return " ".join(out), n

    rng = random.Random(2)
    some = ["کتاب", "ها", "می", "رود", "خانه", "ای", "تر", "«می", "ها،", f"خانه{Z}ها", "بی", "", "12", "هایی", f"بی{Z}"]
    for _ in range(1500):
        s = " ".join(rng.choice(some) for _ in range(rng.randint(1, 7)))
        assert E.half_spaced(s) == walk(s), s


def test_known_words_and_suggestions(spark):
    words = lambda *x: spark.createDataFrame([(w,) for w in x], "word string")
    lexicon = spark.createDataFrame([("کار", 9, True), ("خط", 5, True), ("بر", 4, True), ("گار", 9, True), ("کارد", 9, False)], "word string, n long, common boolean")
    got = {r.word: r.known for r in J.known_words(words("وکار", "برخط", "نکار", "کار", "کارخط"), lexicon).collect()}
    assert got == {"وکار": True, "برخط": True, "نکار": False, "کار": True, "کارخط": True}
    found = [(r.rank, r.suggestion) for r in J.suggestions(words("کاز"), lexicon).orderBy("rank").collect()]
    assert found == [(1, "کار"), (2, "گار"), (3, "کارد")]


def test_display_order(spark):
    shown = lambda t: D.display_map(t.replace(Z, "¦"), "R")[0]
    for line in ("من به خانه رفتم", "سال ۱۳۱۱ بود", "این کتاب خوب (Hedayat) را دیدم", f"می{Z}رفتم"):
        assert " ".join(w for w, _ in D.reading_words(shown(line), [1.0] * len(line))) == line
    assert D.reading_words("Page 12", [1.0] * 7) == [("Page", 100.0), ("12", 100.0)]
    assert D.reading_words(shown("از در"), [0.5, 1, 1, 1, 1]) == [("از", 100.0), ("در", 75.0)]
    assert D.reading_words("  ", [1.0, 1.0]) == []
    # examples of the algorithm's text: capital letters there are right-to-left here
    hebrew = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "".join(map(chr, range(0x5D0, 0x5EA))))
    for s, base, want in (
        ("car means CAR.", "L", "car means RAC."), ("car MEANS CAR.", "R", ".RAC SNAEM car"), ("he said “car MEANS CAR.”", "L", "he said “car RAC SNAEM.”"),
        ("DID YOU SAY ’\u202ahe said “\u202bcar MEANS CAR\u202c”\u202c‘?", "R", "?‘he said “RAC SNAEM car”’ YAS UOY DID"), ("ABC (de) F", "R", "F (de) CBA"), ("A 12,5 B", "R", "B 12,5 A"),
    ):
        assert D.display_map(s.translate(hebrew), base)[0] == want.translate(hebrew), s
    assert D.display_map("a‮bc‬d", "L")[0] == "acbd" and D.levels_of("⁧אa⁩b", "L")[0][-1] == 0
    assert [D.canonical(x) for x in ("كتاب علي", "سال ١٣١١", f"  خانه{Z} ", "ﻼ", "a – b…")] == ["کتاب علی", "سال ۱۳۱۱", "خانه", "لا", "a - b..."]
    assert spark.createDataFrame([(None,)], "s string").select(D.display(F.col("s")).alias("s")).first().s is None


def test_reading_order_against_a_plain_sweep(spark):
    rng = random.Random(8)
    rows = []
    for p in range(40):
        for i in range(rng.randint(1, 9)):
            x, y = rng.randrange(0, 900, 100), rng.randrange(0, 200, 20)
            rows.append(("b", p, i, x, y, x + rng.randint(1, 4) * 100, y + rng.choice([20, 40])))
    got = {(r.page, r.line_no): (r.row, r.place) for r in S.reading_order(spark.createDataFrame(rows, "book string, page long, line_no int, x0 int, y0 int, x1 int, y1 int")).collect()}
    for p, page in itertools.groupby(rows, key=lambda r: r[1]):
        groups = []
        for r in sorted(page, key=lambda r: (r[4], -r[5])):
            near = [g for g in groups[-3:] if all(2 * (min(r[6], o[6]) - max(r[4], o[4])) >= min(r[6] - r[4], o[6] - o[4]) and min(r[5], o[5]) <= max(r[3], o[3]) for o in g)]
            near[-1].append(r) if near else groups.append([r])
        groups.sort(key=lambda g: min(o[4] for o in g))
        flat = [(n, o) for n, g in enumerate(groups) for o in sorted(g, key=lambda o: -o[5])]
        assert {(p, o[2]): (n, k) for k, (n, o) in enumerate(flat)} == {k: v for k, v in got.items() if k[0] == p}


def book(spark):
    names = "book string, page int, line_no int, clean string, marked boolean, short_title boolean, sparse boolean, x0 int, y0 int, x1 int, y1 int, width int, conf int, title string"
    texts = [(1, "فصل اول", True), (1, "او نمی-", False), (1, "رود و «", False), (1, "گفت»", False), (3, "پایان.", False), (3, "فصل دوم", True), (5, "سه & چهار (با هم(", False)]
    rows = [("b", p, i, t, h, False, False, 100, 60 * i, 900, 60 * i + 40, 1000, 90, None) for i, (p, t, h) in enumerate(texts)]
    stats = spark.createDataFrame([("b", 0.1, 0.8, 60.0, 40.0)], "book string, left double, text_width double, pitch double, line_h double")
    pages = spark.createDataFrame([("b", p) for p in range(1, 7)], "book string, page int")
    return S.paragraphs(spark.createDataFrame(rows, names), stats, pages, ocr_fixes=True)


def test_paragraphs_and_books(spark):
    paras = book(spark).orderBy("para_no").collect()
    assert [r.para_id for r in paras] == ["p001-01", "p001-02", "p003-06", "p005-07"] and [r.heading for r in paras] == [True, False, True, False]
    assert paras[1].text == f"او نمی{Z}رود و «گفت» پایان." and paras[3].text == "سه & چهار (با هم)"
    mark = lambda *n: "".join(f"{S.PAGE_OPEN}{x}{S.PAGE_CLOSE}" for x in n)
    assert paras[0].marked == mark(1) + "فصل اول" and mark(2, 3) in paras[1].marked and paras[3].marked == mark(4, 5) + "سه & چهار (با هم)" + mark(6)
    members = K.book_members(book(spark))
    out = {r.path: r.content for r in members.collect()}
    for path, content in out.items():
        if not path.endswith(".css"):
            xml.dom.minidom.parseString(content.encode())
    assert out["OEBPS/toc.ncx"].count("<navPoint") == 2 and out["OEBPS/nav.xhtml"].count("#page") == 6 and "dc:creator" not in out["OEBPS/content.opf"]
    assert 'id="page3"' in out["OEBPS/text/sec001.xhtml"] and "&amp;" in out["OEBPS/text/sec002.xhtml"] and 'id="p005-07"' in out["OEBPS/text/sec002.xhtml"]
    z = zipfile.ZipFile(io.BytesIO(K.archives(members).first().archive))
    assert z.namelist()[0] == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED and set(z.namelist()[1:]) == set(out)
    assert K.persian_paragraphs(book(spark)).where("para_no = 1").first().marked == paras[0].marked
    assert [(r.title, r.n_paragraphs) for r in S.sections_by_heading(book(spark)).orderBy("section_no").collect()] == [("فصل اول", 2), ("فصل دوم", 2)]


def test_line_sets(spark):
    lines = spark.createDataFrame([(1, 0, "کتاب خوپ"), (1, 1, "xyz")], "page int, line_no int, text string")
    checked = spark.createDataFrame([(1, "کتاب خوب"), (1, "هیچ")], "page int, text string")
    assert [r.start for r in L.prefilled(lines, checked).orderBy("line_no").collect()] == ["کتاب خوب", None]
    r = spark.createDataFrame([("a1b22",)], "s string").select(L.replaced(F.col("s"), [("[0-9]+", "#"), ("#b", "")]).alias("r")).first().r
    assert tuple(r) == ("a#", 3)
    answers = [("a", i, s) for i, s in enumerate(["x", "x", "y", "y"])] + [("b", i, s) for i, s in enumerate([None, "x", "y", "y", "y"])] + [("c", 0, None)]
    got = {r.book: (r.asked, r.found) for r in L.script_check(spark.createDataFrame(answers, "book string, nth int, script string")).collect()}
    assert got == {"a": (2, "x"), "b": (4, "y"), "c": (1, None)}
    assert sorted(L.sample_pages(list(range(1, 21)), "s")) == sorted(set(L.sample_pages(list(range(1, 21)), "s"))) and set(L.sample_pages(list(range(1, 21)), "s")) <= set(range(3, 19))
    assert L.outcome_counts(spark.createDataFrame([("kept",), ("lost",), ("kept",)], "outcome string")).first()[:] == (2, 0, 1)
    assert [tuple(r) for r in L.set_counts(spark.createDataFrame([(1, [True, False]), (1, [True])], "page int, flags array<boolean>")).collect()] == [(1, 2, 2)]
    import numpy as np

    assert L.prepared(np.arange(100, dtype=np.uint8).reshape(10, 10), 0.1, 50).tolist()[0] == [0] * 8 and L.prepared(np.zeros((4, 4), np.uint8)).shape == (4, 4)


def test_readers(spark):
    class Length:
        name = "length"

        def read(self, image):
            return "x" * len(image), 50.0

    L.register("length", Length)
    images = spark.createDataFrame([(1, 0, b"abc"), (1, 1, b"")], "page long, line_no int, image binary")
    assert [tuple(r) for r in L.read_images(images, "length").collect()] == [(1, 0, "xxx", 50.0)]
    with pytest.raises(ValueError):
        L.read_images(images, "none")


def test_files(spark, tmp_path):
    page = {"number": 1, "route": "ocr", "width": 10, "height": 20, "lines": [{"text": "یک دو", "bbox": [1, 2, 3, 4], "conf": 9.5}], "settings": {"dpi": "300", "lang": "fas"}, "seconds": 1.0, "new": 1}
    import json

    (tmp_path / "0001.json").write_text(json.dumps(page), encoding="utf-8")
    saved = X.saved_pages(spark, str(tmp_path / "0001.json"))
    wanted = spark.createDataFrame([(1, {"lang": "fas", "dpi": "300"}), (2, {"dpi": "300"})], "number int, settings map<string,string>")
    hits, todo = X.split_hits(wanted, saved)
    assert [r.number for r in hits.collect()] == [1] and [r.number for r in todo.collect()] == [2]
    assert sorted(r.word for r in X.book_words(saved).collect()) == ["دو", "یک"]
    X.save_pages(saved, str(tmp_path / "cache"))
    X.save_pages(saved.withColumn("number", F.lit(2)), str(tmp_path / "cache"))
    assert X.saved_pages(spark, str(tmp_path / "cache")).count() == 2
    (tmp_path / "words.txt").write_text("یک  دو\nسه یک", encoding="utf-8")
    assert X.word_list(spark, str(tmp_path / "words.txt")).count() == 3 and X.word_list(spark, str(tmp_path / "none.txt"), True).count() == 0
    review = spark.createDataFrame([('{"p1-01": {"status": "done", "text": "x"}, "p1-02": {"status": "skip"}}',)], "value string")
    assert sorted((r.id, r.status, r.text) for r in X.decisions(review).collect()) == [("p1-01", "done", "x"), ("p1-02", "skip", None)]
    (tmp_path / "lines.json").write_text(json.dumps({"book": "b", "lines": [{"id": "p1-01", "page": 1, "box": [0, 0, 1, 1], "words": [{"t": "x", "sugg": ["y"]}], "more": 1}]}))
    assert X.set_lines(spark, str(tmp_path / "lines.json")).first().words[0].sugg == ["y"]
    e = X.edition(spark.createDataFrame([('{"drop": ["p1-*"], "replace": [{"pattern": "a", "with": "b"}], "quotes": "paired"}',)], "value string")).first()
    assert e["drop"] == ["p1-*"] and e["replace"][0]["with"] == "b" and e.chapters is None
    runs = X.runs(spark.createDataFrame([('{"reader": "r", "lines": {"data": "d", "exact": 3}}',), ("  ",)], "value string"))
    assert [(r.reader, r.lines.exact, r.pages) for r in runs.collect()] == [("r", 3, None)]
    X.append_runs(runs, str(tmp_path / "log"))
    X.append_runs(runs, str(tmp_path / "log"))
    assert X.runs(spark.read.text(str(tmp_path / "log"))).count() == 2
    digest = X.book_digests(spark.createDataFrame([("a", b"x")], "path string, content binary")).first()
    assert digest.digest[:8] == "2d711642" and len(digest.book_id) == 36
    images = spark.createDataFrame([("b", 1, 0.0, 0.0, 5.0, 10.0, 300, 10.0, 10.0, "سلام a"), ("b", 1, 0.0, 0.0, 10.0, 9.0, 200, 10.0, 10.0, "سلام a")], "book string, page int, x0 double, y0 double, x1 double, y1 double, dpi int, page_width double, page_height double, text string")
    assert X.page_info(images).first()[2:] == (1.0, 4, 200)
    assert [r.number for r in X.in_order(wanted.select("number"), spark.createDataFrame([(0, 2), (1, 1)], "pos int, number int")).collect()] == [2, 1]
