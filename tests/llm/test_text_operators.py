"""Main text, importance resampling and the filter audit against brute force, and on odd tables."""

from __future__ import annotations

import hashlib
import html
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from driftline.llm import filter_audit, main_text, resampling
from driftline.llm.radix import RadixTrie, cut_points, range_of
from tests.llm.test_operators import DOCS, SF, clashing, docs, none, odd  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# main text

def brute_main(page):
    """The article of the synthetic pages by their fixed frame, without a tree."""
    start = (page or "").find("<article>")
    if start < 0:
        return ""
    body = re.sub(r"<[^>]*$", "", page[start + 9:].split("</article>")[0])
    out = [" ".join(html.unescape(re.sub(r"</?b>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", body)]
    return " ".join(t for t in out if t)


def test_main_text_of_all_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {(r["page_id"], r["url"], brute_main(r["html"]), len(brute_main(r["html"]))) for r in pages.collect()}
    assert {tuple(r) for r in main_text.extract(pages).collect()} == want


BODY = "".join(f"<p>Paragraph {i} of the story, with commas, and enough words to count as prose of its own.</p>" for i in range(4))
PROSE = " ".join(f"Paragraph {i} of the story, with commas, and enough words to count as prose of its own." for i in range(4))
LINKS = "<ul>" + "".join(f'<li><a href="/{i}">Link number {i}, with a long, long title</a></li>' for i in range(12)) + "</ul>"


@pytest.mark.parametrize("around, inside", [
    (LINKS, ""), (f"<nav>{LINKS}</nav>", ""), (f"<div class='sidebar-left'><p>{'aside, ' * 60}</p></div>", ""),
    ("<header><h1>Site, name</h1></header>", ""), (f"<footer><p>{'legal, ' * 50}</p></footer>", ""),
    (f"<div id='cookieNotice'><p>{'We use cookies, ' * 30}</p></div>", ""), (f"<section class=comments><p>{'I, too, think so. ' * 80}</p></section>", ""),
    ("", f"<div class='ad'>{'Buy, now! ' * 40}</div>"), ("", f"<form><label>Mail, please</label><input name=x>{'send, ' * 30}</form>"),
    ("", "<script>if (a < b) document.write('</p>, ');</script>"), ("", "<style>p > b {color: red}</style>"), ("", "<!-- <p>not, shown</p> -->"),
    ("", f"<aside><p>{'See, also, ' * 50}</p></aside>"), ("", LINKS), ("", f"<article class='comment'><p>{'First, ' * 60}</p></article>"),
    ("", "<div style='display: none'>hidden, text</div>"), ("", "<div role=navigation>up, down</div>"),
    (f"<div class='related-posts'><p>{'More, like, this. ' * 60}</p></div>", "<button>Share, this</button>"),
])
@pytest.mark.parametrize("frame", ["<article>{}</article>", "<div class='post-content'>{}</div>", "<div><div>{}</div></div>", "{}"])
def test_main_text_leaves_the_rest_out(frame, around, inside):
    page = f"<!DOCTYPE html><html><head><title>T, t</title></head><body>{around}{frame.format(BODY[:400] + BODY[400:] + inside)}{around}</body></html>"
    assert main_text.main_text(page) == PROSE


def test_main_text_keeps_headings_siblings_and_inline_links():
    page = (f"<body><div id=main><h1>The title</h1><div class=entry-header><h2>By line</h2></div><section>{BODY}</section><section>{BODY}</section>"
            "<p>One <a href=x>inline link</a> stays, here.</p></div></body>")
    text = main_text.main_text(page)
    assert text.startswith("The title") and text.count(PROSE) == 2 and text.endswith("One inline link stays, here.")


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), (" \n ", ""), ("<", "<"), ("a < b &lt; c", "a < b < c"), ("<p>a<p>b", "a b"), ("<p>a<b>b</p>c", "ab c"),
    ("x<br>y", "x y"), ("<p>cut &am", "cut &am"), ("<p>cut <a hre", "cut"), ("<p>a<!-- no end <p>b", "a"), ("<!-->a", "a"),
    ("&#x41;&#66;&eacute;&nbsp;&notit;&unknown;", "ABé ¬it;&unknown;"), ("<title>t</title><p>x", "x"), ("</p></div>x", "x"),
    ("<ul><li>a<li>b</ul>", "a b"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"), ("<p title='a>b'>x", "x"), ("<p\n class=x\t>y</p\n>z", "y z"),
    ("<script>never closed <p>x", ""), ("<h1>only a heading</h1>", "only a heading"), ("日本語、\U0001f642<p>é", "日本語、\U0001f642 é"),
])
def test_main_text_of_broken_pages(page, want):
    assert main_text.main_text(page) == want


def test_main_text_of_deep_and_long_pages():
    assert main_text.main_text("<div>" * 50_000 + "deep" + "<b>" * 50_000 + "er</div>") == "deeper"
    page = "<article>" + "<p>" + "word, " * 10 + "</p>" * 3 + "<p>tail" * 30_000
    assert main_text.main_text(page).count("tail") == 30_000


def test_main_text_odd_tables(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    assert main_text.extract(spark.createDataFrame([], schema)).count() == 0
    rows = main_text.extract(spark.createDataFrame([(1, None, None, "own", "x"), (None, "u", "<p>a", None, None), (1, None, None, "own", "x")], schema))
    assert rows.columns == ["page_id", "url", "text", "n_chars", "_text", "_n_chars"]
    assert sorted(map(tuple, rows.collect()), key=str) == sorted([(1, None, "own", "x", "", 0)] * 2 + [(None, "u", None, None, "a", 1)], key=str)


# importance resampling

GRAM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_grams(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = GRAM_WORD.findall(low)
    return w, w + [" ".join(p) for p in zip(w, w[1:])]


def brute_scores(rows, target):
    """{(id, text): (features, weight, score)}"""
    s, t = Counter(), Counter()
    for counts, texts in ((s, [x for _, x in rows]), (t, target)):
        for text in texts:
            counts.update(zlib.crc32(g.encode()) % 10_000 for g in brute_grams(text)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in range(10_000)]
    out = {}
    for i, text in rows:
        grams = brute_grams(text)[1]
        weight = sum(gain[zlib.crc32(g.encode()) % 10_000] for g in grams) // len(grams) if grams else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out[i, text] = len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
    return out


def check_resampling(d, target):
    rows = [(r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect()]
    want = brute_scores(rows, [r["text"] for r in target.collect()])
    got = resampling.score(d, target, carry=["text"]).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows)
    assert all((r["n_features"], r["weight"], r["score"]) == want[r["doc_id"], r["text"]] for r in got)
    able = sorted((-want[i, x][2], i is None, i or 0) for i, x in rows if len(brute_grams(x)[0]) >= 20)
    drawn = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, 25 * len(able) // 100 + 1))
    assert [(-r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in drawn] == able[:len(drawn)]
    return got


@pytest.fixture(scope="module")
def target(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")


def test_resampling(docs, odd, none, target, spark):  # noqa: F811
    check_resampling(docs, target)
    check_resampling(odd, target)
    check_resampling(odd, spark.createDataFrame([(1, None), (2, "")], "item_id long, text string"))
    assert resampling.score(none, target).count() == 0 and resampling.resample(none, target).count() == 0


def test_resampling_splits_equal_scores(spark, target):
    # one id and text holds most rows: equal scores all the way
    rows = [(5, "alpha beta gamma " * 10)] * 400 + [(i, f"w{i} " * 30) for i in range(200)]
    got = check_resampling(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), target)
    assert len(got) == 600


def test_resampling_pieces_and_offsets(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aB9é日 .,\n-Z\x00\x7f") for _ in range(rng.randrange(200))) for _ in range(200)] + ["a" * 500, "x y " * 200]
    whole = [resampling.bucket_ids(t) for t in texts]
    monkeypatch.setattr(resampling, "PIECE", 3)
    for text, (n, ids) in zip(texts, whole):
        words, grams = brute_grams(text)
        n2, ids2 = resampling.bucket_ids(text)
        assert n == n2 == len(words)
        assert sorted(ids) == sorted(ids2) == sorted(zlib.crc32(g.encode()) % 10_000 for g in grams)
        spans = list(resampling.features(text, max_n=3))
        assert [b for _, b in spans[:len(grams)]] == [zlib.crc32(g.encode()) % 10_000 for g in grams]
        low = resampling.ascii_lower(text)
        assert [" ".join(GRAM_WORD.findall(low[a:b])) for (a, b), _ in spans[:len(grams)]] == grams


def test_resampled_rows_are_the_ranked_ones(docs, odd, clashing, target):  # noqa: F811
    for d in (docs, odd, clashing):
        drawn = resampling.resample(d, target, min_words=3, percent=40)
        assert drawn.columns == d.columns
        want = resampling.score(d, target, min_words=3, percent=40).where("rank IS NOT NULL")
        assert Counter(r["doc_id"] for r in drawn.collect()) == Counter(r["doc_id"] for r in want.collect())


def test_resampling_prefers_the_target(spark):
    rng = random.Random(1)
    near, far = [f"n{k}" for k in range(50)], [f"f{k}" for k in range(50)]
    rows = [(i, " ".join(rng.choices(near if i % 4 == 0 else far, k=60))) for i in range(400)]
    aim = spark.createDataFrame([(0, " ".join(rng.choices(near, k=3000)))], "item_id long, text string")
    drawn = resampling.resample(spark.createDataFrame(rows, "doc_id long, text string"), aim).collect()
    assert len(drawn) == 100 and sum(r["doc_id"] % 4 == 0 for r in drawn) > 60  # 25 without weights


# filter audit

def brute_audit(rows, labels):
    """rows: (id, text, part); labels: (id, quality, toxic)"""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    bad = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    fails = []
    for i, text, part in rows:
        text = text or ""
        w = WORD.findall(text)
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
             "D": any(c in text for c in "#$%&*|"), "E": i is not None and first[text] < i}
        fails.append((part or "", {k for k, v in f.items() if v}, i in good, i in bad))
    out = {}
    for part in {p for p, *_ in fails}:
        mine, shapley = [f for f in fails if f[0] == part], Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, k in enumerate(order, 1):
                gone = [f for f in left if k in f[1]]
                left = [f for f in left if k not in f[1]]
                shapley[k] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(k in f[1] for f in mine) - len(gone), sum(f[1] == {k} for f in mine),
                    sum(f[2] for f in gone), sum(f[3] for f in gone)]
        for (p, order, step), figures in out.items():
            if p == part:
                figures.append(shapley[order[step - 1]])
    return out


FIGURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def check_audit(d, labels):
    want = brute_audit([(r["doc_id"], r["text"], r["lang"]) for r in d.select("doc_id", "text", "lang").collect()],
                       [(r["doc_id"], r["quality"], r["toxic"]) for r in labels.collect()])
    got = filter_audit.audit(d, labels).collect()
    assert len(got) == len(want)
    assert {(r["part"], r["filter_order"], r["step"]): [r[f] for f in FIGURES] for r in got} == want


LABELS = "doc_id long, quality int, toxic int"


def test_audit(spark, docs, odd, none, clashing):  # noqa: F811
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    check_audit(docs, labels)
    some = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, None), (4, None, 1), (None, 1, 1)], LABELS)
    check_audit(odd, some)
    check_audit(clashing, some)
    check_audit(docs, spark.createDataFrame([], LABELS))
    assert filter_audit.audit(none, labels).count() == 0


def test_audit_copies_over_many_ranges(spark, monkeypatch):
    rng = random.Random(5)
    head = "the same passage " * 40
    texts = [head + f"tail {i}" for i in range(150)] + [f"{rng.random()} other" for _ in range(150)] + ["", "hot text", head, head[:50], "é" * 9]
    rows = [(rng.randrange(400), rng.choice(texts), rng.choice(["a", "b", None, ""])) for _ in range(900)]
    rows += [(rng.randrange(1000), "hot text", "a") for _ in range(500)] + [(7, "hot text", "b")] * 60 + [(None, "hot text", "a")] * 5
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(0, 400, 5)], LABELS)
    check_audit(d, labels)
    monkeypatch.setattr(filter_audit, "CHUNK_BYTES", 4000)  # tries are cleared, ranges sliced
    monkeypatch.setattr(filter_audit, "HOT_BYTES", 500)
    monkeypatch.setattr(filter_audit, "SLICES_AT_ONCE", 2)
    monkeypatch.setattr(filter_audit, "SAMPLE_TEXTS", 16)
    check_audit(d, labels)


def test_trie_against_a_dictionary():
    rng = random.Random(2)
    texts = [bytes(rng.choices(b"ab", k=rng.randrange(12))) for _ in range(600)]
    trie, beaten, rows = RadixTrie(), [], defaultdict(list)
    for i, text in enumerate(texts):
        doc_id = rng.randrange(50)
        rows[text].append(doc_id)
        beaten += [(text, j) for j, _, n in trie.offer(text, doc_id, "g") for _ in range(n)]
    want = {text: Counter(i for i in ids if i > min(ids)) for text, ids in rows.items()}
    got = defaultdict(Counter)
    for text, j in beaten:
        got[text][j] += 1
    assert {t: c for t, c in want.items() if c} == got
    assert {t: (n.smallest, n.holders) for t, n in trie.ends()} == {t: (min(i), {"g": i.count(min(i))}) for t, i in rows.items()}


def test_cuts_lie_behind_shared_passages():
    texts = sorted([(b"passage " * 50 + str(i).encode(), 10) for i in range(64)] + [(b"other", 10), (b"x", 10)])
    cuts = cut_points(texts, 8)
    assert len(cuts) == 7 and cuts == sorted(cuts)
    shares = Counter(range_of(cuts, t) for t, _ in texts)
    assert max(shares.values()) <= 12 and all(range_of(cuts, a) <= range_of(cuts, b) for (a, _), (b, _) in zip(texts, texts[1:]))
    assert cut_points([], 4) == [] and cut_points([(b"a", 1)] , 4) == []


def test_orders():
    steps = filter_audit.orders()
    assert len(steps) == 600 and len({o for o, *_ in steps}) == 120 and all(before & bit == 0 for _, _, before, bit in steps)
