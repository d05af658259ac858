"""Classifier, language, main text, decontamination and similarity join against brute force, and odd rows."""

import itertools
import math
import random
import re
import time
from collections import Counter, defaultdict
from html.parser import HTMLParser

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from llm_data import DOCS, LONG, SCHEMA, SF_DIR, documents, empty

import corpus_pipeline
from callscope.llm import decontam, htmltext, langid, near, perfecthash, quality, textops
from callscope.llm.components import connected_components
from callscope.llm.htmlpages import training_pages


def words_of(text):
    return re.findall(rb"[a-z0-9\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def shingles_of(text, n=5):
    w = words_of(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def random_texts(seed, count):
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdeé", k=r.randint(1, 5))) for _ in range(60)]
    texts = []
    for _ in range(count):
        if texts and r.random() < 0.6:
            w = r.choice(texts).split(" ")
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            texts.append(" ".join(w))
        else:
            texts.append(" ".join(r.choices(vocabulary, k=r.choice([1, 3, 30, 80, 200]))))
    return texts


def test_words_and_shingles_equal_plain_code():
    texts = random_texts(1, 40) + ["", None, "A,b;C", "x" * 10_000 + " y", "x" * 10_000 + "z y", "é É"]
    hashes, sets = {}, []
    for first, data, offsets in textops.chunks(pa.array(texts), 500):
        h, start = textops.words(data, offsets)
        s, at = textops.shingles(h, start)
        for i in range(len(offsets) - 1):
            own = words_of(texts[first + i])
            assert start[i + 1] - start[i] == len(own)
            for w, x in zip(own, h[start[i] : start[i + 1]].tolist()):
                assert hashes.setdefault(w, x) == x
            sets.append(set(s[at[i] : at[i + 1]].tolist()))
    assert len(set(hashes.values())) == len(hashes)
    plain = [shingles_of(t) for t in texts]
    assert [len(s) for s in sets] == [len(s) for s in plain]
    for i, j in itertools.combinations(range(len(texts)), 2):
        assert len(sets[i] & sets[j]) == len(plain[i] & plain[j])


def brute_classes(rows):
    """doc index -> (class, links, group) over all pairs."""
    sets = [frozenset(shingles_of(t)) for _, t in rows]
    links = defaultdict(set)
    for a, b in itertools.combinations(set(sets), 2):
        if a and b and len(a & b) / len(a | b) >= 0.8:
            links[a].add(b)
            links[b].add(a)
    group = {}
    for s in set(sets):
        if s not in group:
            todo, seen = [s], {s}
            while todo:
                for x in links[todo.pop()] - seen:
                    seen.add(x)
                    todo.append(x)
            for x in seen:
                group[x] = seen

    def order(i):
        return (rows[i][0] is None, rows[i][0] or 0)

    out = []
    for i, s in enumerate(sets):
        own = min((j for j in range(len(rows)) if sets[j] == s), key=order)
        top = min((j for j in range(len(rows)) if sets[j] in group[s]), key=order)
        out.append((rows[i][0], rows[own][0], rows[top][0], sets.count(s), len(links[s])))
    return out


@pytest.mark.parametrize("tile", [256, 3])
def test_jaccard_join_equals_all_pairs(spark, tile):
    rows = list(enumerate(random_texts(3, 150))) + [(i, t) for i, t, _, _ in DOCS]
    docs = spark.createDataFrame([(i, t, "en", "a") for i, t in rows], SCHEMA)
    got = near.jaccard_classes(docs, tile=tile).collect()
    got = sorted(((r["doc_id"], r["class_id"], r["group_id"], r["class_size"], r["n_links"]) for r in got), key=str)
    assert got == sorted(brute_classes(rows), key=str)


def test_one_document_of_each_group_stays(spark):
    docs = documents(spark, extra=True)
    kept = near.keep_one(docs)
    assert kept.columns == docs.columns
    rows = [(i, t) for i, t, _, _ in DOCS]
    assert kept.count() == len({g for _, _, g, _, _ in brute_classes(rows)})


def test_bands_reach_the_recall():
    b = near.bands_for(0.8, 0.9999, 4)
    assert 1 - (1 - 0.8**4) ** b >= 0.9999 > 1 - (1 - 0.8**4) ** (b - 1)


def test_components_of_chains_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(201, 200), (201, 202), (202, 200), (5, 5), (None, 1)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200, 202: 200}
    assert connected_components(empty(spark, "a long, b long")).collect() == []


def test_perfect_hash_is_minimal_and_perfect():
    r = np.random.default_rng(0)
    for n in (0, 1, 2, 1000):
        hi, lo = (r.integers(0, 2**63, n, dtype=np.uint64) for _ in range(2))
        if n > 2:
            hi[:500] = hi[0]  # halves may repeat
        found = perfecthash.PerfectHash(*perfecthash.build(hi, lo)).index(hi, lo)
        assert sorted(found.tolist()) == list(range(n))


def test_bands_and_rows_follow_from_the_recall():
    bands, rows = near.choose_bands()
    assert (bands, rows) == (51, 8) and 1 - (1 - near.THRESHOLD**rows) ** bands >= near.RECALL
    assert bands * rows <= near.HASHES < (rows + 1) * near.bands_for(near.THRESHOLD, near.RECALL, rows + 1)
    assert 1 - (1 - 0.3**rows) ** bands < 0.004


def test_a_shared_template_does_not_tie_texts_together(spark):
    """Texts of one template, of similarity 0.24 to each other, meet rarely; their copies are found all the same."""
    r = random.Random(9)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    template = [word() for _ in range(60)]
    texts = [" ".join(template + [word() for _ in range(94)]) for _ in range(600)]
    texts += [t + " " + word() for t in texts[:40]]
    docs = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], SCHEMA)
    signed = docs.selectExpr("doc_id", "0L AS mark", "text").mapInArrow(
        near._signatures(near.WORDS, *near.choose_bands()[::-1]), "doc_id long, mark long, node long, size long, bands array<long>"
    )
    met = defaultdict(list)
    for x in signed.collect():
        for band in x["bands"]:
            met[band].append(x["doc_id"])
    ties = {(a, b) for own in met.values() for a, b in itertools.combinations(sorted(own), 2)}
    copies = {(i, 600 + i) for i in range(40)}
    assert copies <= ties
    assert len(ties - copies) < 0.002 * 640 * 639 / 2
    got = near.jaccard_classes(docs).where("n_links > 0").select("group_id").distinct().count()
    assert got == 40


def held(x, t):
    """How much of the shingles of one text another one holds; one of few words as one shingle."""
    n = len(re.findall(r"[a-z0-9\x80-\U0010ffff]+", (x or "").lower()))
    if n >= 5:
        return len(shingles_of(x) & shingles_of(t)), len(shingles_of(x))
    words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
    mine = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (x or "").lower())
    return int(bool(n) and any(words[i : i + n] == mine for i in range(len(words)))), int(n > 0)


def brute_leaks(texts, items):
    """Question and answer, as one text or each for itself, anywhere in the document."""
    out = set()
    for item, x in items:
        question, _, answer = (x or "").rpartition("\n")
        if not question.strip():
            question, answer = answer, ""
        for i, t in enumerate(texts):
            (w, n), (q, nq), (a, na) = held(f"{question} {answer}", t), held(question, t), held(answer, t)
            if n and (w >= 0.8 * n - 1e-9 or q + a >= 0.8 * (nq + na) - 1e-9):
                out.add((i, item))
    return out


def test_answers_apart_from_their_questions(spark):
    """Question and answer any number of words apart, in either order, with words changed."""
    r = random.Random(6)
    make = lambda n: ["".join(r.choices("abcdefgh", k=7)) for _ in range(n)]
    items = [(k, " ".join(make(r.randint(8, 70))) + "\n" + " ".join(make(r.randint(1, 70)))) for k in range(40)]
    texts = []
    for k, x in items:
        question, answer = (part.split() for part in x.split("\n"))
        for gap in (0, 60, 100, 300, 2000):
            own = [list(question), list(answer)]
            if gap % 100 and len(question) > 30:
                own[0][len(question) // 2] = "changed"
            first, second = own[:: r.choice([1, -1])]
            texts.append(" ".join(make(150) + first + make(gap) + second + make(90)))
    docs = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], SCHEMA)
    rows = decontam.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(x["doc_id"], leak["item_id"]) for x in rows for leak in x["leaks"]}
    want = brute_leaks(texts, items)
    assert got == want and len(want) >= 0.9 * len(texts)


def test_leaks_equal_brute_force(spark):
    given = [r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("text").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    r = random.Random(2)
    vocabulary = [w for _, t in items for w in t.split()]
    items += [(1000, " ".join(r.choices(vocabulary, k=300))), (1001, "two words"), (1002, None), (1003, "")]
    texts = given + [None, ""]
    for item, text in items:
        if text and len(text.split()) > 20:
            w = text.split()
            for changes in (0, 1, 2):
                v = list(w)
                for _ in range(changes):
                    v[r.randrange(len(v))] = "changed"
                texts.append(" ".join(r.choices(vocabulary, k=r.randint(0, 300))) + " " + " ".join(v) + " " + " ".join(r.choices(vocabulary, k=200)))
    docs = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for shard in (8_000_000, 3_000):
        rows = decontam.find_leaks(docs.withColumn("leaks", docs.doc_id), bench, shard_bytes=shard).collect()
        got = {(x["doc_id"], leak["item_id"]) for x in rows for leak in x["leaks"]}
        want = {p for p in brute_leaks(texts, items) if p[1] != 1001}
        assert {p for p in got if p[1] != 1001} == want
    short = spark.createDataFrame([(1, "so many words and two words more", None, None), (2, "two", None, None)], SCHEMA)
    assert [x["doc_id"] for x in decontam.query(short, bench).where("not kept").collect()] == [1]
    docs = documents(spark, extra=True)
    assert decontam.decontaminate(docs, bench).columns == docs.columns
    assert decontam.decontaminate(docs, bench.where("false")).count() == len(DOCS)


def brute_phrases(text, reference):
    count, at = 0, 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at : end + 1] in reference:
            end += 1
        count, at = count + 1, end
    return count


def test_phrases_equal_plain_parsing():
    r = random.Random(4)
    references = {x: bytes(r.choices(b"abcd e", k=400)) for x in ("aa", "bb")}
    parser = langid.Parser(references)
    texts = [bytes(r.choices(b"abcd ez", k=r.randint(0, 300))) for _ in range(50)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    got = parser.phrases(data, offsets)
    assert got.tolist() == [[brute_phrases(t, references[x]) for x in ("aa", "bb")] for t in texts]


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = docs.select("doc_id", "lang").join(langid.query(docs), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows) > 0


def test_languages_of_odd_rows(spark):
    got = langid.query(documents(spark, extra=True)).collect()
    assert len(got) == len(DOCS)
    by_id = defaultdict(list)
    for r in got:
        by_id[r["doc_id"]].append(r)
        assert 0 <= r["score"] <= 1
    assert all(by_id[i][0]["lang_pred"] == "und" for i in (3, 4, 5, 12))
    assert by_id[9][0]["lang_pred"] in ("de", "en", "fr")
    assert all(not r["held_out"] for r in by_id[None])
    assert langid.query(empty(spark)).collect() == []
    none = langid.query(spark.createDataFrame([(1, "text", None, None)], SCHEMA)).first()
    assert (none["lang_pred"], none["score"]) == ("und", 0.0)


def test_main_text_of_unseen_layouts():
    field, wrong, total = htmltext.default_field(), 0, 0
    for page, labels in training_pages(150, seed=77):
        found = field.decode(htmltext.blocks(page))
        wrong += sum(a != b for a, b in zip(found, labels))
        total += len(labels)
    assert wrong <= 0.01 * total


def test_viterbi_equals_the_best_of_all_labellings():
    field = htmltext.default_field()
    for page, _ in training_pages(40, seed=3):
        found = htmltext.blocks(page)[:9]
        score = [[sum(x) for x in zip(field._sum(p), field._sum(htmltext._text_features(t, s)))] for t, p, s in found]

        def total(labels, score=score):
            return sum(score[i][x] for i, x in enumerate(labels)) + sum(field.moves[a][b] for a, b in zip(labels, labels[1:]))

        best = max(total(x) for x in itertools.product((0, 1), repeat=len(found)))
        assert math.isclose(total(field.decode(found)), best, abs_tol=1e-9)


def test_pages(spark):
    field = htmltext.default_field()
    article = "<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>T&eacute;st  &lt;1&gt;</h1><p>First\n line &amp; more. <b>Bold</b>text<script>var x='</p>';</script><p>Second<br>line.</article><footer>&copy; me</footer>"
    assert htmltext.main_text(article, field) == "Tést <1>\nFirst line & more. Boldtext\nSecond line."
    rows = [(1, "u", article), (2, None, None), (3, "u", ""), (4, "u", "<p"), (5, "u", "<!-- open"), (None, "u", article), (6, "u", "<a b='>" * 1000),
            (7, "u", "<div>" * 5000 + "x"), (8, "u", "<article>" + "<p>A sentence, of some words.</p>" * 5000 + "</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = {r["page_id"]: r for r in htmltext.query(pages).collect()}
    assert len(got) == len(rows) and got[None]["text"] == got[1]["text"]
    assert [got[i]["text"] for i in (2, 3, 4, 5)][:2] == ["", ""] and got[8]["n_chars"] == len(got[8]["text"]) == 5000 * 27 - 1
    assert htmltext.query(empty(spark, "page_id long, url string, html string")).collect() == []


def test_pages_without_the_end_of_their_head():
    field = htmltext.default_field()
    rest = "<article><h1>News of today</h1><p>First line, and more of it.<p>Second line.</article>"
    whole = "<html><head><meta charset=utf-8><title>x</title><style>p {}</style><link href=a>%s" + rest + "</body></html>"
    want = htmltext.main_text(whole % "</head><body>", field)
    assert want == "News of today\nFirst line, and more of it.\nSecond line."
    assert all(htmltext.main_text(whole % end, field) == want for end in ("<body>", "", "<textarea>a</textarea>", "\n<script>b</script>\n"))
    assert [t for t, _, _ in htmltext.blocks("<head><title>x</title> Text <b>of</b> a page")] == ["Text of a page"]


def test_punctuation_is_counted_over_the_whole_block():
    for before, points in itertools.product((1, 399, 5000), range(6)):
        assert f"points={min(3, points)}" in htmltext._text_features("a" * before + ", b" * points, 0.0)


def test_blocks_of_deep_and_broken_pages():
    """A hundred thousand open elements, or ends of elements that are not open, take seconds."""
    began = time.time()
    deep = "".join(f"<div class='{'abc'[i % 3]}'>t{i}" for i in range(100_000))
    assert len(htmltext.blocks(deep)) == 100_000
    assert len(htmltext.blocks("<b>" * 100_000 + "<li>x" * 100_000)) == 100_000
    assert len(htmltext.blocks("<b><div>" * 50_000 + "x</b></i></p>" * 50_000)) >= 1
    assert time.time() - began < 60


class Texts(HTMLParser):
    """Text of the standard library's parser, without what stands in scripts and the like."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "title")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "title")

    def handle_data(self, data):
        if not self.skip:
            self.found.append(data)


def test_blocks_hold_the_text_of_a_plain_parser(spark):
    pages = [r["html"] for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").select("html").collect()]
    for page in [p for p in pages if p] + [page for page, _ in htmltext.training_pages(40, seed=8)]:
        plain = Texts()
        plain.feed(page)
        want = "".join("".join(plain.found).split())
        got = "".join("".join(t.split()) for t, _, _ in htmltext.blocks(page))
        if not re.search("<(?:textarea|select|option|button|iframe|noscript|template)", page):
            assert got == want


def test_main_text_by_contract():
    field = htmltext.default_field()
    page = (
        "<html><body><nav><a href='/'>Home page</a></nav><article><h1>A title of some words</h1><p>The first paragraph has foo<script>var x;</script>bar "
        "and <math><mi>x</mi><mo>=</mo><mn>1</mn></math> in it. It is long enough.</p><p>Another paragraph follows, with more than a few words.</p></article>"
        "<section id='discussion'><article class='comment-body'><p>Nice article, thanks for it!</p></article>"
        "<article class='comment-body'><p>I do not agree with this.</p></article></section></body></html>"
    )
    text = htmltext.main_text(page, field)
    assert "foobar" in text and "x=1" in text and "Another paragraph" in text
    assert "Nice article" not in text and "agree" not in text and "Home" not in text


def brute_model(texts, order=quality.ORDER):
    """Interpolated modified Kneser-Ney as in the papers, with plain dictionaries."""
    counts = {order: Counter()}
    for t in texts:
        data = b" " * (order - 1) + t
        counts[order].update(data[i : i + order] for i in range(len(t)))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cuts, contexts = {}, {}
    for k in counts:
        t = Counter(counts[k].values())
        y = t[1] / (t[1] + 2 * t[2]) if t[1] + 2 * t[2] else 0.5
        cuts[k] = [0.0] + [
            min(max(i - (i + 1) * y * t[i + 1] / t[i] if t[i] else 0.5 * i, 0.1), i - 0.1 if i > 1 else 0.9) for i in (1, 2, 3)
        ]
        contexts[k] = defaultdict(lambda: [0, 0, 0, 0])
        for g, c in counts[k].items():
            contexts[k][g[:-1]][0] += c
            contexts[k][g[:-1]][min(c, 3)] += 1

    def p(g):
        k = len(g)
        shorter = p(g[1:]) if k > 1 else 1 / 256
        if g[:-1] not in contexts[k]:
            return shorter
        total, *n = contexts[k][g[:-1]]
        c = counts[k].get(g, 0)
        return (max(c - cuts[k][min(c, 3)], 0) + sum(cuts[k][i] * n[i - 1] for i in (1, 2, 3)) * shorter) / total

    return p


def test_perplexities_equal_plain_dictionaries(spark):
    texts = random_texts(9, 40)
    rows = [(i, t, "x" if i % 3 else None, None) for i, t in enumerate(texts)] + [(100, None, "x", None), (101, "", "x", None), (None, "abc d", "x", None), (5, "again", "x", None)]
    labels = [(i, 1, 0) for i in range(0, 40, 2)] + [(1, 0, 0), (3, 1, 1), (None, 1, 0), (0, 1, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    trusted = {i for i, good, bad in labels if good and not bad and i is not None}
    models = {
        lang: brute_model([t.encode() for i, t, own, _ in rows if i in trusted and own == lang]) for lang in ("x", None)
    }
    got = {(r["doc_id"], r["n_grams"]): r["perplexity"] for r in quality.query(docs, marks).collect()}
    assert len(got) == len(rows)
    for i, t, lang, _ in rows:
        data = (t or "").encode()
        if not data:
            assert got[i, 0] is None
            continue
        full = b" " * (quality.ORDER - 1) + data
        loss = -sum(math.log(models[lang](full[j : j + quality.ORDER])) for j in range(len(data))) / len(data)
        assert math.isclose(got[i, len(data)], math.exp(loss), rel_tol=1e-9)


def test_an_id_of_all_rows_is_dealt_over_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(7 if i % 4 else i, t, "x", None) for i, t in enumerate(random_texts(11, 80))], SCHEMA)
    labels = spark.createDataFrame([(7, 1, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.dealt_out(docs, 8).where("doc_id = 7").select("block").distinct().count() > 8
    rows = lambda: sorted(quality.query(docs, labels).collect(), key=str)
    few = rows()
    monkeypatch.setattr(quality, "BLOCK_BYTES", 200)
    many = rows()
    assert len(few) == 80 and any(r["threshold"] is not None for r in few)
    for a, b in zip(few, many):
        assert (a["doc_id"], a["n_grams"], a["kept"]) == (b["doc_id"], b["n_grams"], b["kept"])
        assert a["perplexity"] is b["perplexity"] is None or math.isclose(a["perplexity"], b["perplexity"], rel_tol=1e-9)


def test_probabilities_sum_to_one():
    p = brute_model([b"abracadabra", b"banana bandana"])
    assert math.isclose(sum(p((b"  ab" + bytes([c]))[-quality.ORDER :]) for c in range(256)), 1.0)


def test_quality_of_odd_rows(spark):
    docs = documents(spark, extra=True)
    labels = spark.createDataFrame([(1, 1, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.query(docs, labels).count() == len(DOCS)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert quality.keep_good(docs, labels.where("false")).count() == len(DOCS)
    assert quality.query(empty(spark), labels).collect() == []


def test_quality_keeps_clean_documents_and_finds_junk(spark):
    path = SF_DIR.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.query(docs, labels).join(labels, "doc_id").collect()
    clean = [r["kept"] for r in rows if r["quality"] == 1 and not r["toxic"]]
    junk = [r["kept"] for r in rows if r["quality"] == 0]
    assert all(clean) and sum(junk) < 0.3 * len(junk)


def prose(seed, count, words, letters="abcdefgh"):
    r = random.Random(seed)
    vocabulary = ["".join(r.choices(letters, k=r.randint(2, 7))) for _ in range(300)]
    return [" ".join(r.choices(vocabulary, k=words)) for _ in range(count)]


def brute_losses(spark, texts):
    """Of each text the nats a byte under the model of the texts in the other fold."""
    folds = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("pmod(xxhash64(t), 2)").collect()]
    models = [brute_model([t.encode() for t, f in zip(texts, folds) if f != fold]) for fold in (0, 1)]
    losses = []
    for t, f in zip(texts, folds):
        full = b" " * (quality.ORDER - 1) + t.encode()
        losses.append(-sum(math.log(models[f](full[j : j + quality.ORDER])) for j in range(len(t))) / len(t))
    return losses


def brute_limit(losses):
    rank = lambda q: sorted(losses)[math.ceil(q * len(losses)) - 1]
    return math.exp(rank(0.5) + quality.SPREAD * (rank(quality.HIGH) - rank(0.5)))


def test_quality_limits_come_from_documents_out_of_training(spark):
    r = random.Random(5)
    texts = prose(1, 60, 80) + prose(1, 6, 20)
    # a tenth of the letters changed: above the limit by less than the 0.75 nats that once were let through
    junk = "".join(r.choice("abcdefgh") if c != " " and r.random() < 0.1 else c for c in prose(1, 61, 80)[-1])
    rows = [(i, t, "x", None) for i, t in enumerate([*texts, junk])]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.query(docs, labels).collect()}
    losses = brute_losses(spark, texts)
    size = lambda t: int(math.log2(len(t) + 1) // 2)
    large = [x for t, x in zip(texts, losses) if size(t) == size(texts[0])]
    assert len(large) == 60 and size(junk) == size(texts[0])
    assert math.isclose(got[0]["threshold"], brute_limit(large), rel_tol=1e-9)
    assert math.isclose(got[60]["threshold"], brute_limit(losses), rel_tol=1e-9)  # too few of its length
    middle = sorted(math.log(got[i]["perplexity"]) for i in range(60))[29]
    assert not got[66]["kept"] and math.log(got[66]["perplexity"]) < middle + 0.75


def test_quality_judges_languages_without_labels(spark):
    r = random.Random(6)
    texts = prose(1, 60, 80)
    noise = lambda n: "".join(r.choices("zyxwvuts ", k=n))
    odd = [("y", noise(900)), (None, noise(900)), ("z", noise(900)), ("x", noise(5)), ("x", noise(70_000)), ("y", ""), ("y", prose(1, 61, 80)[-1])]
    rows = [(i, t, "z" if i < 2 else "x", None) for i, t in enumerate(texts)] + [(60 + i, t, lang, None) for i, (lang, t) in enumerate(odd)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.query(docs, labels).collect()}
    assert [got[60 + i]["kept"] for i in range(len(odd))] == [False] * 5 + [True] * 2
    assert got[65]["perplexity"] is None and len(got) == len(rows)
    want = brute_limit(brute_losses(spark, texts))
    assert all(math.isclose(got[i]["threshold"], want, rel_tol=1e-9) for i in (0, 60, 61, 62, 66))  # of all trusted text
    assert not math.isclose(got[2]["threshold"], want, rel_tol=1e-9)


def test_pipeline_equals_its_stages_by_brute_force(spark, tmp_path):
    """Every stage on all its predecessor kept, with decisions recomputed without the operators' own methods."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    rows = {r["doc_id"]: r for r in docs.collect()}
    bad = {r["doc_id"] for r in quality.query(docs, labels).where("not kept").collect()}
    left = [i for i in rows if i not in bad]
    best = {}
    for i in sorted(left, key=lambda i: (-len(rows[i]["text"]), i)):
        best.setdefault(re.sub(r"[ \t-\r]", "", rows[i]["text"]), i)
    left = sorted(best.values())
    left = [i for i, _, g, _, _ in brute_classes([(i, rows[i]["text"]) for i in left]) if i == g]
    leaked = {left[i] for i, _ in brute_leaks([rows[i]["text"] for i in left], items)}
    left = [i for i in left if i not in leaked]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT * FROM read_parquet(?) WHERE list_contains(?, doc_id)", [f"{SF_DIR}/documents.parquet", left])
    from callscope.llm import mixing

    want = {i: (t, s) for i, s, _, _, t in con.execute(mixing.ORACLE).fetchall()}
    got = corpus_pipeline.run(spark, SF_DIR).collect()
    taken = Counter()
    for r in got:
        taken[r["doc_id"]] += r["size"]
        assert r["text"] == rows[r["doc_id"]]["text"]
    assert {i: n for i, n in taken.items()} == {i: t for i, (t, s) in want.items() if t}


def test_pipeline_of_odd_rows(spark, tmp_path):
    path = str(tmp_path)
    for rows, name in ((DOCS, "odd"), ([], "none")):
        spark.createDataFrame(rows, SCHEMA).selectExpr("*", "length(text) AS n_chars", "1 AS `mark`", "2 AS copies").write.parquet(f"{path}/{name}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (8, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/{name}/labels.parquet")
        spark.createDataFrame([(1, "Some other passage of a test with words")], "item_id long, text string").write.parquet(f"{path}/{name}/benchmark.parquet")
        out = corpus_pipeline.run(spark, f"{path}/{name}")
        assert {"doc_id", "text", "copy"} <= set(out.columns)
        assert (out.count() > 0) == bool(rows)
    assert len(LONG) > 100_000
