import difflib
import itertools
import random

from pyspark.sql import functions as F

from folianth.functions import text as T
from folianth.operators import book as B
from folianth.operators import checks as C
from folianth.operators import evaluate as E
from folianth.operators import front as R
from folianth.operators import joins as J
from folianth.operators import sequence as S
from folianth.plans import queries as Q


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_commas_and_marks(spark):
    assert one(spark, T.latin_commas(F.col("s")), s="سلام, دنیا ۱,۰۰۰ و 1,000,") == "سلام، دنیا ۱,۰۰۰ و 1,000,"
    assert one(spark, T.clean_line(F.col("s")), s=" « سلام ،، دنیا ! ") == "«سلام، دنیا!"


def test_numbered_titles(spark):
    assert one(spark, T.numbered_title(F.col("s")), s="2ـ غلام") == "۲- غلام"
    assert one(spark, T.numbered_title(F.col("s")), s="2- غلام آمد.") is None
    assert one(spark, T.numbered_title(F.col("s")), s="0- غلام") is None


def test_half_spaces(spark):
    z = "‌"
    assert tuple(one(spark, E.half_spaces(F.col("s")), s="کتاب ها را می خواند")) == (f"کتاب{z}ها را می{z}خواند", 2)
    assert tuple(one(spark, E.half_spaces(F.col("s")), s="کتاب، ها")) == ("کتاب، ها", 0)


def test_split_joined(spark):
    vocabulary = spark.createDataFrame([("کار", 9), ("خوب", 5), ("بود", 7)], "word string, n long")
    words = spark.createDataFrame([("کارخوب",), ("خوببود",), ("کار",)], "word string")
    assert {(r.word, tuple(r.parts)) for r in E.split_joined(words, vocabulary).collect()} == {("کارخوب", ("کار", "خوب"))}


def test_scores():
    assert E.score_pair("یک دو سه", "یک دو سه")[:4] == (8, 0, 3, 0)
    assert E.score_pair("كتاب خوب", "کتاب خوپ")[1:4] == (1, 2, 1)
    assert E.paired_quotes("«a» b» «c") == "«a» b c"


def test_similarity(spark):
    assert one(spark, E.similarity(F.col("a"), F.col("b")), a="abcd", b="bcde") == difflib.SequenceMatcher(None, "abcd", "bcde", autojunk=False).ratio()


def test_heading_recurrence(spark):
    """Headings go on over short titles only; against a plain loop."""
    rng = random.Random(3)
    rows, want = [], []
    for b in range(30):
        h = False
        for i in range(rng.randint(1, 25)):
            marked, short, ended = rng.random() < 0.2, rng.random() < 0.5, rng.random() < 0.3
            text = f"w{i}" + "." * ended
            rows.append((f"b{b}", 1, i, text, marked, short and not marked, False, 100, 60 * i, 900, 60 * i + 40, 1000))
            broken = i == 0 or rows[-2][3].endswith(".")
            h = marked or (short and not marked and (broken or h))
            want.append((f"b{b}", i, h))
    names = "book string, page int, line_no int, clean string, marked boolean, short_title boolean, sparse boolean, x0 int, y0 int, x1 int, y1 int, width int"
    stats = spark.createDataFrame([(f"b{b}", 0.1, 0.8, 60.0, 40.0) for b in range(30)], "book string, left double, text_width double, pitch double, line_h double")
    got = S.paragraph_starts(spark.createDataFrame(rows, names), stats).select("book", "line_no", "h").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_reading_order(spark):
    rows = [("b", 1, 0, 100, 0, 400, 40), ("b", 1, 1, 500, 5, 900, 45), ("b", 1, 2, 100, 60, 900, 100)]
    out = S.reading_order(spark.createDataFrame(rows, "book string, page long, line_no int, x0 int, y0 int, x1 int, y1 int")).orderBy("place").collect()
    assert [(r.line_no, r.row) for r in out] == [(1, 0), (0, 0), (2, 1)]


def test_guillemets_without_an_opening(spark):
    rng = random.Random(5)
    for _ in range(200):
        s, open_, want = "".join(rng.choice("ab«»") for _ in range(12)), 0, []
        for c in s:
            want.append("،" if c == "»" and not open_ else c)
            open_ = open_ + 1 if c == "«" else max(0, open_ - 1) if c == "»" else open_
        assert C.unopened_as_commas(s).replace(" ", "") == "".join(want)
    assert C.unopened_as_commas("سلام »دنیا «a»") == "سلام، دنیا «a»"


def test_mirrored_parentheses(spark):
    for s, want in (("(a( b", "(a) b"), ("(a(b(c) (d(", "(a)b(c) (d)"), ("(a) b", "(a) b"), ("a) (b(", "a) (b)")):
        assert one(spark, C.mirrored_parentheses(F.col("s")), s=s) == want


def test_comparison_text():
    assert E.normalized("أب\u200cها ۀ 12 a1 كَ") == "ابها ه ۱۲ a1 ک"
    assert E.normalized("كَ", keep_marks=True) == "کَ"


def test_carried_over(spark):
    names = "page long, line_no int, x0 int, y0 int, x1 int, y1 int"
    new = spark.createDataFrame([(1, 0, 0, 0, 100, 40), (1, 1, 0, 12, 100, 52), (1, 2, 0, 100, 100, 140)], names)
    old = spark.createDataFrame([(1, 0, 0, 10, 100, 50), (1, 1, 0, 101, 100, 141), (1, 2, 0, 300, 100, 340)], names)
    got = {(r.new_line, r.old_line, r.outcome) for r in J.carried_over(new, old).collect()}
    assert got == {(0, 0, "recheck"), (2, 1, "kept"), (None, 2, "lost")}


def test_matched_lines(spark):
    a = spark.createDataFrame([(1, 0, "abcdef"), (1, 1, "uvwxyz"), (2, 0, "abc")], "id long, i int, text string")
    b = spark.createDataFrame([(1, 0, "uvwxy"), (1, 1, "abcdef"), (1, 2, "abcde"), (3, 0, "abc")], "id long, j int, text string")
    assert {(r.id, r.i, r.j) for r in E.matched_lines(a, b).collect()} == {(1, 0, 1), (1, 1, 0)}


def book_lines(spark, books):
    """Title pages (text, height, y0, conf) before three pages of ten lines."""
    names = "book string, page int, line_no int, text string, x0 int, y0 int, x1 int, y1 int, width int, height int, conf int"
    rows = []
    for book, front in books.items():
        rows += [(book, 1, i, t, 100, y, 900, y + h, 1000, 1400, c) for i, (t, h, y, c) in enumerate(front)]
        rows += [(book, p, i, "این یک خط کامل از متن کتاب است", 100, 300 + 60 * i, 900, 340 + 60 * i, 1000, 1400, 90) for p in (2, 3, 4) for i in range(10)]
    return spark.createDataFrame(rows, names)


def test_title_and_author(spark):
    books = {
        "marked": [("نام کتاب : گندم", 40, 100, 90), ("نویسنده : م. مودب پور", 40, 200, 90)],
        "above": [("گندم", 40, 100, 90), ("نویسنده: علی", 40, 200, 90)],
        "large": [("گندم ۱۳۸۱", 80, 100, 90), ("علی رضایی", 40, 300, 90)],
        "pen": [("م. مودب", 80, 100, 90), ("رکسانا", 90, 300, 90)],
        "credit": [("نشر گندم", 80, 100, 90), ("رکسانا", 90, 300, 30)],
    }
    got = {r.book: (r.title, r.author) for r in R.title_and_author(book_lines(spark, books)).collect()}
    assert got == {"marked": ("گندم", "م. مودب پور"), "above": ("گندم", "علی"), "large": ("گندم", "علی رضایی"), "pen": ("رکسانا", "م. مودب"), "credit": (None, None)}


def test_header_keys(spark):
    names = "book string, page int, line_no int, text string, y0 int, y1 int, height int"
    texts = ["رکسانا کتابخانه"] * 4 + ["رکسائنا کتابخانه", "رکسانا کتاب", "سلام به همه", "رکسانا"]
    rows = [("b", p, 0, t, 10, 50, 1400) for p, t in enumerate(texts, 1)]
    got = {r.key for r in R.header_keys(spark.createDataFrame(rows, names)).collect()}
    assert got == {"رکساناکتابخانه", "رکسائناکتابخانه", "رکساناکتاب"}


def test_words_behind_the_twelfth(spark, tmp_path):
    text = "\n".join(" ".join(f"w{i}" for i in range(n)) for n in (40, 30, 30, 5))
    spark.createDataFrame([(1, text, "b")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    parts = Q.QUERIES["w12_gap_split"](spark, str(tmp_path)).collect()
    assert len(parts) == 105 and min(r.x0 for r in parts) >= 0 and max(r.part for r in parts) == 9
    gaps = Q.QUERIES["j14_column_gaps"](spark, str(tmp_path)).collect()
    assert {line: sum(r.line_no == line for r in gaps) for line in range(4)} == {0: 7, 1: 7, 2: 7, 3: 1}


def test_split_joined_takes_every_word(spark):
    """Rare words are pieces too, endings are none."""
    letters = "بپتثجچحخسشصض"
    rows = [("".join(x) + "د", 9) for x in itertools.islice(itertools.product(letters, repeat=5), 50_000)]
    rows += [("گلزار", 3), ("ترین", 9)]
    words = spark.createDataFrame([("گلزار" + rows[0][0],), (rows[0][0] + "ترین",)], "word string")
    got = {(r.word, tuple(r.parts)) for r in E.split_joined(words, spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got == {("گلزار" + rows[0][0], ("گلزار", rows[0][0]))}


def test_split_texts(spark):
    """Against a plain loop over the words of each text."""
    rng = random.Random(8)
    letters, some = "ادربتيك", ["کار", "خوب", "بود", "ترین", "دار", "بار", "ردا"]
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 8))) for _ in range(200)] + [a + b for a in some for b in some] + ["کار\u200cدار", "", "«کارخوب»", "کار:خوب", "(داربار"]
    texts = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(60)] + [(60, None), (None, "کارخوب")]
    known = {"باردار"}

    def cuts(w):
        form = E.bare(w)
        if form in E.SHORT or (form in some and form not in E.ENDINGS):
            yield [w]
        for i in range(1, len(w)):
            head = E.bare(w[:i])
            if w[i - 1] in E.NONJOIN and w[i].isalpha() and (head in E.SHORT or (head in some and head not in E.ENDINGS)):
                yield from ([w[:i], *p] for p in cuts(w[i:]))

    def fixed(token):
        core = token.strip(E.AROUND)
        if "\u200c" in token or E.bare(core) in {*some, *known} or not core or not any(c in E.NONJOIN for c in token[:-1]):
            return token
        found = list(cuts(core))
        best = min(found, key=lambda p: (len(p), sum(len(E.bare(x)) < 3 for x in p), -sum(E.bare(x) in some for x in p), [len(x) for x in p]), default=[core])
        return token.replace(core, " ".join(best))

    want = {}
    for i, t in texts:
        if t is None or i is None:
            want[i] = (t, 0)
        else:
            new = [fixed(x) for x in t.split(" ")]
            want[i] = (" ".join(new), sum(a != b for a, b in zip(t.split(" "), new, strict=True)))
    vocabulary = spark.createDataFrame([(w, 5) for w in some], "word string, n long")
    more = spark.createDataFrame([(w,) for w in known], "word string")
    got = {r.id: (r.text, r.n_split) for r in E.split_texts(spark.createDataFrame(texts, "id long, text string"), "id", vocabulary, more).collect()}
    assert got == want and sum(n for _, n in want.values()) > 50


def test_margin_lines(spark):
    """Variants of headers and lines of low confidence go from margins; headings and the page's middle stay."""
    rows = [("b", p, 0, "The Long Header", 10, 50, 90, None) for p in range(1, 7)]
    rows += [("b", 7, 0, "The Lang Header", 10, 50, 90, False), ("b", 8, 0, "Long Header", 10, 50, 90, False), ("b", 9, 0, "quite another", 10, 50, 30, False)]
    rows += [("b", 9, 1, "The Lang Header", 500, 540, 20, False), ("b", 10, 0, "The Lang Header", 10, 50, 20, True), ("b", 11, 0, "quite another", 10, 50, None, False)]
    lines = spark.createDataFrame([(*r, 1000) for r in rows], "book string, page int, line_no int, text string, y0 int, y1 int, conf int, heading boolean, height int")
    kept = lambda **o: {(r.page, r.line_no) for r in B.without_headers(lines, **o).collect()}
    assert kept(variants=True, least_conf=50) == {(9, 1), (10, 0), (11, 0)}
    assert kept(least_conf=50) == {(7, 0), (8, 0), (9, 1), (10, 0), (11, 0)}


def test_fewest_pieces():
    rng = random.Random(4)

    def cuts(w, known):
        return [[w]] * (w in known) + [[w[:i], *p] for i in range(1, len(w)) if w[i - 1] in E.NONJOIN and w[:i] in known for p in cuts(w[i:], known)]

    for _ in range(300):
        word = "".join(rng.choice("ادربت") for _ in range(rng.randint(1, 10)))
        some = {word[i : i + rng.randint(3, 5)] for i in range(len(word)) if rng.random() < 0.6} - set(E.ENDINGS)
        pieces = {x for x in some if len(x) > 2}
        want = cuts(word, pieces | set(E.SHORT))
        got = E._fewest_pieces(word, pieces & set(E._possible_pieces(word, 5)))
        key = lambda p: (len(p), sum(len(x) < 3 for x in p), -sum(x in pieces for x in p))  # noqa: B023, E731
        assert (got is None) == (not want) and (got is None or key(got) == min(map(key, want)))


def test_confusions_of_characters(spark):
    pairs = spark.createDataFrame([(1, "alpha beta gamma", "alpha bata gamma"), (2, "one two three", "onetwo thre"), (3, "same", "same")], "id long, reference string, other string")
    got = {(r.ref, r.hyp): r.n for r in E.confusions(E.compare(pairs)).collect()}
    assert got == {("e", "a"): 1, ("e", ""): 1}
    assert E.character_edits("abc", "xbcd") == [("", "d"), ("a", "x")] and E.character_edits("", "") == []


def test_words_are_counted_before_they_are_formed(spark):
    """A word's form is made once for each different word, whatever is asked of the vocabulary behind it."""
    rows = spark.createDataFrame([(0, "كار کار کَار، کار. خط خط"), (1, "x 1 خط -"), (2, None)], "id int, text string").repartition(2)
    assert {tuple(r) for r in B.vocabulary(rows).collect()} == {("کار", 4), ("خط", 3)}
    assert {tuple(r) for r in B.word_counts(rows).collect()} == {("کار", 4), ("خط", 3), ("", 3)}
    plan = B.vocabulary(rows).where("length(word) > 2 and word <> 'x'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("translate(") < plan.index("Generate explode") and plan.count("Aggregate") == 2
    assert plan.rindex("translate(") < plan.rindex("Aggregate")


def test_forms_letter_by_letter(spark):
    import unicodedata

    chars = [chr(c) for c in [*range(1, 0x700), *range(0x2000, 0x2070), *range(0xFB50, 0xFE00, 7), 0x10A00, 0x1F600]]
    keep = set(map(chr, [*range(0x621, 0x63B), *range(0x641, 0x64B)])) | set("پچژکگیۀ")
    rows = spark.createDataFrame([(c, f"{c}ب{c}") for c in chars], "c string, s string")
    for r in rows.select("c", T.comparison_form(F.col("s")).alias("f"), T.clean_line(F.concat(F.lit("ب  "), "s")).alias("k")).collect():
        c = {"ي": "ی", "ى": "ی", "ك": "ک"}.get(r.c, r.c)
        c = c if c in keep else ""
        assert r.f == f"{c}ب{c}", unicodedata.name(r.c, r.c)


def test_normalized_takes_no_table_walk():
    import time
    import unicodedata

    text = "سلام دنیا این متن است ۱۲ 34 " * 60_000
    began = time.process_time()
    unicodedata.normalize("NFKC", text).translate({1: 2})
    plain, began = time.process_time() - began, time.process_time()
    assert E.normalized(text) == text.replace("34", "۳۴") and time.process_time() - began < plain


def test_lines_sharing_a_gap_against_all_pairs(spark):
    """Gaps of any width, overlapping ones of a line and empty pages, against a comparison of all pairs; long lines of a
    page with many lines take no time that grows with the square."""
    import time

    import numpy as np

    rng = np.random.default_rng(5)
    for _ in range(60):
        n, top = int(rng.integers(1, 60)), int(rng.choice([12, 60, 500]))
        line = np.sort(rng.integers(0, 12, n))
        page = line // 4
        s = rng.integers(-20, top, n)
        e = s + rng.integers(1, 30, n)
        want = [len({line[j] for j in range(n) if page[j] == page[i] and s[j] < e[i] and s[i] < e[j]}) for i in range(n)]
        assert J.lines_sharing(page, line, s, e).tolist() == want
    line = np.repeat(np.arange(1500), 60)
    s = np.tile(np.arange(60) * 90, 1500) + rng.integers(0, 60, 90_000)
    began = time.process_time()
    assert J.lines_sharing(line * 0, line, s, s + 25).max() <= 1500 and time.process_time() - began < 10


def test_gaps_of_random_words(spark, monkeypatch):
    """Pages in several slices, lines of one word, against plain loops."""
    monkeypatch.setattr(J, "WORDS_AT_ONCE", 30)
    rng = random.Random(9)
    rows = []
    for p in range(12):
        for line in range(rng.randint(1, 7)):
            x = 1500
            for _ in range(rng.randint(1, 9)):
                w = rng.randint(20, 60)
                rows.append((p, line, x - w, x, 60 * line, 60 * line + rng.choice([20, 30, 40])))
                x -= w + rng.choice([10, 10, 15, 120, 200])
    words = spark.createDataFrame(rows, "page long, line_no int, x0 int, x1 int, y0 int, y1 int")
    parts, wide, count = set(), [], {}
    for (p, line), own in itertools.groupby(rows, key=lambda r: r[:2]):
        own = sorted(own, key=lambda r: -r[3])
        count[p] = count.get(p, 0) + 1
        heights, part = sorted(r[5] - r[4] for r in own), 0
        gaps = [(b[3], a[2], a[5] - a[4]) for a, b in itertools.pairwise(own)]
        sizes = sorted(e - s for s, e, _ in gaps)
        wide += [(p, line, s, e) for s, e, h in gaps if (e - s > 2 * h if len(gaps) == 1 else e - s > max(20, 2.5 * sizes[len(sizes) // 2]))]
        for i, r in enumerate(own):
            part += i > 0 and own[i - 1][2] - r[3] > 2.5 * heights[len(heights) // 2]
            parts.add((p, line, r[2], r[3], part))
    assert {tuple(r) for r in S.split_at_gaps(words).collect()} == parts
    shared = [(*g, len({h[1] for h in wide if h[0] == g[0] and h[2] < g[3] and g[2] < h[3]})) for g in wide]
    assert sorted(map(tuple, J.column_gaps(words).collect())) == sorted(g for g in shared if g[4] >= max(3, 0.2 * count[g[0]])) != []


def test_reading_order_of_a_long_row():
    """One row of many boxes, of several heights: time in proportion, the same as all boxes of the row say."""
    import time

    rng = random.Random(4)
    boxes = [(40 * i, rng.randint(0, 3), 40 * i + rng.randint(5, 40), 40 + rng.randint(0, 9)) for i in range(20_000)]
    began = time.process_time()
    assert S.swept(boxes) == [list(range(19_999, -1, -1))] and time.process_time() - began < 5


def test_headings_and_headers_are_cheap_for_other_lines(spark):
    """A line meets the ordinals once, and lines aren't dealt by their header keys."""
    from folianth.operators import headings as H

    rows = spark.createDataFrame([("b", 1, 0, "فصل دوم", 10, 50, 1000, 90)], "book string, page int, line_no int, text string, y0 int, y1 int, height int, conf int")
    plan = rows.select(H.match_heading(F.col("text")).alias("h"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("levenshtein(") <= 3
    physical = S.kept_lines(rows, 0.02)._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in physical.split("\n") if "LeftAnti" in x]
    assert joins and all("BroadcastHashJoin" in x for x in joins)
