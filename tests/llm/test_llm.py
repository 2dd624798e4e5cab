import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folianth.llm import decontaminate, jaccard_join, language, nearest, packing, pii, quality, queries, store, substring_dedup, token_counts, url_filter

DOCS = "doc_id long, text string, item_id string, words string, key string, n long"


@pytest.fixture(scope="module")
def rows():
    """Nulls, empty and long texts, repeated rows, copies, near copies and shared passages."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdeéE.", k=rng.randint(1, 5))) for _ in range(60)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    out = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One"), (6, "a b c"), (7, text(3000))]
    base, passage = text(120), text(30)
    for i in range(10, 40):
        w = base.split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = "x" * rng.randint(1, 3)
        out.append((i, " ".join(w)))
    out += [(i, f"{text(rng.randint(0, 40))} {passage}\n{text(rng.randint(0, 40))}") for i in range(40, 70)]
    out += [(i, passage) for i in range(70, 75)] + [(80 + i, text(rng.randint(1, 60))) for i in range(40)]
    return out + [out[12], out[-1]]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", "y", "z", 1) for d, t in rows], DOCS).repartition(3)


def test_jaccard(spark, rows):
    got = jaccard_join.jaccard_join(frame(spark, rows), 4, 85).collect()
    assert sorted(map(tuple, got)) == sorted(jaccard_join.brute_force(rows, 4, 85))


def test_jaccard_large_groups(spark, rows, monkeypatch):
    """Small units and ranges, hot keys from two rows on, compressed texts."""
    for name, value in (("BROADCAST_IDS", 0), ("UNIT_TOKENS", 500), ("RANGE_TOKENS", 200), ("HOT_ROWS", 2)):
        monkeypatch.setattr(jaccard_join, name, value)
    monkeypatch.setattr(store, "HOT_ROWS", 2)
    got = jaccard_join.jaccard_join(frame(spark, rows), 3, 80).collect()
    assert sorted(map(tuple, got)) == sorted(jaccard_join.brute_force(rows, 3, 80))


def test_jaccard_keys_before_a_key(spark, monkeypatch):
    """Long prefixes of shared tokens: what a key's row holds of the keys before it doesn't grow with the prefix, and pairs
    that are made at every key that both have give the same."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(1200)]
    edited = lambda words, n: [f"x{rng.randrange(10**6)}" if i in at else w for at in [set(rng.sample(range(len(words)), n))] for i, w in enumerate(words)]
    versions = [edited(base, 150) for _ in range(4)]
    rows = [(10 * i + j, " ".join(edited(w, 30 * j))) for i, w in enumerate(versions) for j in range(4)]
    held, write = [], jaccard_join.materialize

    def watched(df, name):
        out = write(df, name)
        if name == "tokens":
            held.append(out.select(F.count("*"), F.sum(F.size("before"))).first())
        return out

    monkeypatch.setattr(jaccard_join, "materialize", watched)
    want = sorted(jaccard_join.brute_force(rows, 3, 80))
    assert 1 < len({c for _, _, c in want}) < len(rows)
    assert sorted(map(tuple, jaccard_join.jaccard_join(frame(spark, rows), 3, 80).collect())) == want
    assert held[0][0] > 1000 and held[0][1] <= 8 * held[0][0]
    monkeypatch.setattr(jaccard_join, "KEYS_BEFORE", 0)
    assert sorted(map(tuple, jaccard_join.jaccard_join(frame(spark, rows), 3, 80).collect())) == want


def test_substrings(spark, rows):
    got = substring_dedup.substring_dedup(frame(spark, rows)).collect()
    assert sorted(map(tuple, got)) == sorted(substring_dedup.brute_force(rows))


def test_suffix_automaton():
    rng = random.Random(1)
    seqs = [[rng.randrange(3) for _ in range(rng.randint(0, 12))] for _ in range(40)]
    a = substring_dedup.SuffixAutomaton()
    for d, s in enumerate(seqs):
        a.add(s, d)
    for s in seqs + [[rng.randrange(4) for _ in range(9)] for _ in range(20)]:
        want = [next((d for d, t in enumerate(seqs) if any(t[j : j + 4] == s[i : i + 4] for j in range(len(t) - 3))), -1) for i in range(len(s) - 3)]
        assert a.first_documents(s, 4) == want


def test_decontamination(spark, rows):
    items = [(1, rows[40][1]), (2, "one"), (3, None), (4, ""), (5, rows[-4][1]), (6, rows[40][1]), (7, "a b c")]
    got = decontaminate.decontaminate(frame(spark, rows), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")).drop("items").collect()
    assert sorted(map(tuple, got)) == sorted(decontaminate.brute_force(rows, items))
    none = decontaminate.decontaminate(frame(spark, rows), spark.createDataFrame([], "item_id long, text string")).drop("items").collect()
    assert sorted(map(tuple, none)) == sorted(decontaminate.brute_force(rows, []))


def test_urls(spark):
    urls = ["http://A.Example.com/en/77?x", "https://example.com/en/8", "x.com/en/1", None, "", "http://example.net/de/8#a", "http://net/de/", "http://notnet/de/", "https://m.spam-farm.org/", "http://a.org/es/1/login", "http://com", "http://a.b/login"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [got[i][2:] for i in range(len(urls))] == [("example.com/en/7", "allow"), ("com/en/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), ("example.net/de/8", "block"), ("net/de/", "block"), (None, "allow"), (None, "block"), ("org/es/", "block"), (None, "allow"), (None, "block")]
    assert got[0][:2] == ("a.example.com", "/en/77")


def test_token_counts(spark, rows):
    path = queries.tokenizer_path("word_bpe_49k.json")
    inner, final = token_counts.read_vocabulary(path)
    got = token_counts.token_counts(frame(spark, rows), path).collect()
    assert sorted(map(tuple, got)) == sorted((d, *token_counts.brute_force(t, inner, final)) for d, t in rows)
    rng = random.Random(1)
    for _ in range(40):
        inner, final = ({"".join(rng.choices("abcd", k=rng.randint(1, 4))).encode() for _ in range(rng.randint(0, 9))} for _ in range(2))
        a = token_counts.Automaton(inner, final)
        for w in ("".join(rng.choices("abcde", k=rng.randint(1, 12))) for _ in range(60)):
            n = a.count(w.encode())
            assert token_counts.brute_force(w, inner, final)[1:] == (1 if n < 0 else n, int(n < 0))


def test_packing(spark, rows):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    rows = [*rows, (900, "It's a TEST<|endoftext|> don't 12 x́ " * 40)]
    out = packing.pack(frame(spark, rows), path, limit=64).collect()
    small = packing.token_pieces(frame(spark, rows), path, limit=64, cache_words=16).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in small) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in out)
    tokenizer, want = Tokenizer.from_file(path), []
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(d, i, a, len(ids[a : a + 64]), zlib.crc32(np.array(ids[a : a + 64], "<u4").tobytes())) for i, a in enumerate(range(0, len(ids), 64))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    places = {}
    for r in out:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        p.sort()
        assert [a for a, _ in p] == [0, *np.cumsum([n for _, n in p])[:-1]] and sum(n for _, n in p) <= 64
    assert len(places) <= 1.1 * sum(r.length for r in out) / 64 + 1


def test_packing_by_a_tokenizer_without_word_units(spark):
    from tokenizers import Tokenizer

    assert packing.WordIds.of(queries.tokenizer_path("word_bpe_49k.json")).word_wise
    path = queries.tokenizer_path("byte_bpe_50k.json")
    assert not packing.WordIds.of(path).word_wise
    texts = ["Two  words,\n and\tMORE", "", None, "don't stop", "a" * 300 + " b"]
    out = packing.token_pieces(frame(spark, list(enumerate(texts))), path, limit=8, with_ids=True).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.doc_id, r.piece)):
        got.setdefault(r.doc_id, []).extend(r.ids)
    tokenizer = Tokenizer.from_file(path)
    assert got == {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}


def test_bins_stay_bounded():
    bins = packing.OpenBins(100, 3)
    for n in [60, 70, 80, 90, 55, 40, 30]:
        bins.place(n)
        assert bins.open <= 3


def plain_base(text):
    """The contract's spans by its own patterns."""
    digits = lambda x: [c for c in x if "0" <= c <= "9"]
    out = [(m.start(), 0, m.end()) for m in pii.EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in pii.IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in pii.CARD.finditer(text) if 14 <= len(d := digits(m[0])) <= 19 and pii.luhn("".join(d))]
    return sorted(out + [(m.start(), 3, m.end()) for m in pii.PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15])


CORPUS = ["a.b@c.de is from x@y.org", "call +1 (743) 555-3824 or +1 (743) 555-3824 now", "card 4111 1111 1111 1111 here", "no 4111111111111112 card", "at 1.2.3.4 host"] * 40


def test_personal_data(spark):
    text = "a.b@c.de or A.B (at) c.de, 256.1.1.1 1.2.3.4.5, 4111 1111 1111 1111, 4111111111111112, +1 (743) 555-3824 and 743 555 3824"
    rows = [(1, text), (2, None), (3, ""), (4, "clean 12345678901 text"), (1, text), (5, "4111111111111112 4111111111111111")]
    rows += [(100 + i, t) for i, t in enumerate(CORPUS)]
    got = pii.personal_data(frame(spark, rows), with_text=True).collect()
    first = next(r for r in got if r.doc_id == 1)
    assert (first.n_email, first.n_ip, first.n_card, first.n_phone) == (1, 1, 1, 1) and all(r.settled for r in got)
    assert first.redacted == "<email> or <email>, 256.1.1.1 <ip>.5, <card>, 4111111111111112, <phone> and <phone>"
    assert len(got) == len(rows) and next(r for r in got if r.doc_id == 4).spans == ""
    # two numbers in a row are one failing match of the pattern; the field finds the one that checks
    assert next(r for r in got if r.doc_id == 5).spans == "card:17:33"
    rng = random.Random(3)
    for letters in ("a.@-+b 1", "12.3 ", "0145 -+()."):
        for _ in range(700):
            s = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
            assert plain_base(s) == pii.base_spans(s), s
    assert list(pii._emails("a" * 700 + "@b.c"))[0] == (0, 704)


def test_long_runs_take_time_in_proportion():
    import time

    field = pii.Field.fit(CORPUS[:5])
    n, start = 1 << 20, time.time()
    for s in ("a" * n, "1" * n, "1." * (n // 2), "a (at) " * (n // 7), "a@" * (n // 2), "+1" + "-" * n, "1 " * (n // 2), "." * n + "@"):
        pii.added_spans(s, field)
        pii.base_spans(s)
    assert time.time() - start < 60


def test_field_is_fitted_on_whole_texts(spark):
    rows = [(i, CORPUS[i % 5]) for i in range(300)] + [(5000, None), (5001, "")]
    got, want = pii.fit_field(frame(spark, rows)), pii.Field.fit([t for _, t in rows if t])
    assert set(got.shapes) == set(want.shapes) and all(np.allclose(got.shapes[s], want.shapes[s]) for s in got.shapes)
    assert np.allclose(got.chain, want.chain) and np.isclose(got.agree, want.agree)
    best = {s: int(w.argmax()) for s, w in got.shapes.items()}
    assert (best["address"], best["four parts"], best["16 digits checked"], best["16 digits"], best["word"]) == (0, 1, 2, pii.NONE, pii.NONE)
    assert pii.fit_field(frame(spark, rows[-2:])).agree == pii.AGREE


def test_messages_against_enumeration():
    """Exact on trees; the most likely labels on small graphs with loops."""
    import itertools

    rng = np.random.default_rng(4)
    for trial in range(30):
        n, labels = 5, 3
        edges = [(int(rng.integers(i)), i) for i in range(1, n)] + ([(0, 4), (1, 3)] if trial % 2 else [])
        edges = sorted(set(edges))
        local, weights = rng.normal(size=(n, labels)), [rng.normal(size=(labels, labels)) * (0.4 if trial % 2 else 1) for _ in edges]
        exact = np.zeros((n, labels))
        for ys in itertools.product(range(labels), repeat=n):
            p = np.exp(sum(local[i, y] for i, y in enumerate(ys)) + sum(w[ys[a], ys[b]] for (a, b), w in zip(edges, weights, strict=True)))
            for i, y in enumerate(ys):
                exact[i, y] += p
        exact /= exact.sum(axis=1, keepdims=True)
        got, settled = pii.beliefs(local, edges, weights)
        assert settled and np.abs(np.exp(got) - exact).max() < (0.06 if trial % 2 else 1e-4)


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((1500, 16)).astype(np.float32)
    v[100:400] = v[99]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] + [1.0] * 15), (5150, [None] + [1.0] * 15), (5200, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got: dict = {}
    for r in nearest.nearest_neighbours(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = nearest.brute_force(np.arange(1500), v, np.arange(0, 1500, 50))
    assert set(got) == set(want)
    assert np.mean([len({a for a, _ in got[q]} & {a for a, _ in w}) / 5 for q, w in want.items()]) >= 0.9
    assert [i for i, _ in got[150]] == [99, 100, 101, 102, 103]
    assert nearest.nearest_neighbours(df.where("vec_id < 0"), df.where("vec_id < 0")).count() == 0
    assert nearest.nearest_neighbours(df.where("vec_id < 3"), df.where("vec_id = 0")).count() == 2


def test_quality(spark):
    rows = [(i, ("good plain words here " if i % 3 else "BAD!! ### $$$ ") * (1 + i % 4)) for i in range(400)] + [(1000, None), (1001, "")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    out = quality.quality(frame(spark, rows), labels).collect()
    assert len(out) == 402 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    held = [r for r in out if r.held_out and r.doc_id < 400]
    assert np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in held]) > 0.95
    assert {r.score for r in quality.quality(frame(spark, rows), labels.limit(0)).collect()} == {0.5}


def test_language(spark):
    rows = [(i, "the cat and the dog are in the house", "en", "s1", 0) if i % 2 else (i, "der hund und die katze sind im haus", "de", "s2", 0) for i in range(40)]
    rows += [(100, None, "en", None, 0), (101, "", None, "s1", 0), (102, "das haus und der hund", "en", "s2", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    r = language.document_rows(docs)
    got = {x.id: x for x in language.identify(r, language.fit_text_model(r)).collect()}
    assert all(got[i].language == ("en" if i % 2 else "de") and got[i].accepted for i in range(40))
    assert not got[100].accepted and not got[101].accepted and got[102].language == "de"
    assert language.identify(r, ([], np.zeros((0, language.FEATURES)))).where("accepted").count() == 0
    pages = spark.createDataFrame([(1, "http://a.b.de/x", '<html lang="de"><p>der hund</p></html>'), (2, None, None)], "page_id long, url string, html string")
    got = {x.id: x.language for x in language.identify(language.page_rows(pages), language.fit_text_model(r)).collect()}
    assert got[1] == "de"


def test_language_models_every_declared_one(spark):
    rng = random.Random(6)
    names = [f"l{i:03}" for i in range(90)]
    words = [["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(12)] for _ in names]
    rows = [(100 * i + j, " ".join(rng.choices(words[i], k=30)), x if j else None, "s") for i, x in enumerate(names) for j in range(4)]
    r = language.document_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    model = language.fit_text_model(r)
    assert sorted(model[0]) == names and model[1].shape == (90, language.FEATURES)
    got = {x.id: x for x in language.identify(r, model).collect()}
    assert all(got[i].language == names[i // 100] and got[i].accepted for i, *_ in rows)


def test_empty_tables(spark):
    none = frame(spark, [(1, "a")]).where("doc_id < 0")
    path = queries.tokenizer_path("word_bpe_49k.json")
    for f in (jaccard_join.jaccard_join, substring_dedup.substring_dedup, lambda d: packing.pack(d, path), lambda d: token_counts.token_counts(d, path), pii.personal_data):
        assert f(none).count() == 0
    assert decontaminate.decontaminate(none, none.select("item_id", F.col("text"))).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    sf, docs = "/root/testdata/sf0.001", None
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = []
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == pipeline.COLUMNS
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[0] > counts[2] > 100
    assert pipeline.run(spark, sf).select("doc_id").distinct().count() == counts[-1]


def test_listed_rules_have_the_verdicts_of_the_contract(spark):
    want = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    assert {r.name: r.verdict for r in url_filter.LISTED} == want
    pages = spark.createDataFrame(list(enumerate(f"http://www.{rule}" for rule in want)), "page_id long, url string")
    assert {r.rule: r.verdict for r in url_filter.url_filter(pages).collect()} == want
