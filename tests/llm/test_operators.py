"""The training-data operators against brute force, and on nulls, ties, repeats, empty tables and clashing names."""

from __future__ import annotations

import hashlib
import re
import textwrap
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from driftline.llm import (
    licenses, mixing, quality_rules, sampled_pieces, simhash, token_counts, token_output, toxicity, url_filters, winnowing)

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"

ODD = [
    (1, None, "en", "a", None),
    (2, "", "en", "a", 0),
    (3, " \t\n ", None, "a", 4),
    (4, "one", "en", None, 3),
    (4, "one", "en", None, 3),  # a repeated row
    (None, "two words", None, None, 9),
    (6, "x y z " * 20_000, "en", "b", 120_000),
    (7, "# * $ | <> &\n" * 40, "de", "b", 520),
    (8, "Same line here.\nSame line here.\nother \U0001f642 日本語 é", "fr", "c", 50),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def clashing(spark):
    """Columns that carry the names of an operator's own working and result columns."""
    names = ("size draw chunk part tie rid fp score pieces n_words kept base_failed body source_size target cut_source "
             "cut_copies print guest copy licence n_tokens rank").split()
    rows = [(i, f"words {i} " + "alpha beta gamma delta epsilon " * (20 + i), "en", "s", i, *["own"] * len(names), "dot") for i in range(6)]
    return spark.createDataFrame(rows, DOCS + "".join(f", {n} string" for n in names) + ", `a.b` string")


def windows(text, n):
    w = WORD.findall(text or "")
    return [tuple(w[i:i + n]) for i in range(len(w) - n + 1)]


# quality rules

def brute_counts(text):
    text = text or ""
    w, tri = WORD.findall(text), windows(text, 3)
    seen = {t for t in tri if tri.count(t) > 1} if len(tri) < 3000 else {t for t in set(tri)}
    covered = {i + k for i, t in enumerate(tri) if t in seen for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_quality_figures(docs, odd):
    for d in (docs.limit(60), odd):
        want = {(r["doc_id"], brute_counts(r["text"])) for r in d.select("doc_id", "text").collect()}
        got = quality_rules.judge(d).collect()
        assert {(r["doc_id"], (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])) for r in got} == want
        assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in got)
        assert not any(r["kept"] and r["base_failed"] for r in got)


def test_quality_limits_adapt_and_merge(spark):
    # a source full of markup keeps its own kind; the same text fails among prose
    text = lambda i, s: " ".join(f"w{i}x{k}{s}" for k in range(60))
    rows = [(i, text(i, "#"), "en", "code", 0) for i in range(300)] + [(1000 + i, text(i, ""), "en", "prose", 0) for i in range(300)]
    rows += [(5000, text(9000, "#"), "en", "prose", 0), (5001, text(9001, "#"), "en", "tiny", 0)]
    d = spark.createDataFrame(rows, DOCS)
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(d).collect()}
    assert kept[0] and kept[1000] and not kept[5000]
    assert all(kept[i] for i in range(300))
    counts = quality_rules.figures(d)
    whole = quality_rules.sketches(counts, ["lang"])
    merged = quality_rules.merge(quality_rules.sketches(counts, ["lang", "source"]), ["lang"])
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, merged.collect()))


def test_quality_junk_that_fills_a_source_is_bounded_by_the_wider_sketch(spark):
    text = lambda i, s: " ".join(f"w{i}x{k}{s}" for k in range(60))
    rows = [(i, text(i, ""), "en", "prose", 0) for i in range(1200)]
    rows += [(2000 + i, text(2000 + i, "#$" if i % 5 < 2 else ""), "en", "dump", 0) for i in range(300)]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(kept[i] for i in range(1200)) and all(kept[2000 + i] == (i % 5 >= 2) for i in range(300))


def test_quality_bucket_error(spark):
    values = [0, 1, 999, 2047, 2048, 4095, 4096, 10**6, 10**12 + 12345]
    d = spark.createDataFrame([(v,) for v in values], "x long")
    rows = d.select("x", quality_rules.bucket(d.x).alias("b")).withColumn("f", quality_rules.bucket_floor(F.col("b"))).collect()
    assert all(r["f"] <= r["x"] <= r["f"] * (1 + 2 ** -10) for r in rows)
    assert [r["b"] for r in sorted(rows)] == sorted(r["b"] for r in rows)


def test_quality_odd_tables(none, clashing):
    assert quality_rules.judge(none).count() == 0
    kept = quality_rules.keep(clashing)
    assert kept.columns == clashing.columns and kept.schema == clashing.schema


# mixing

def test_mix_targets(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 10), (None, 500)], "src string, size long")
    got = {r["src"]: r["target"] for r in mixing.targets(sizes).collect()}
    budget, weight = 1.5 * 1610, {"a": 3, "b": 1, "c": 2, None: 3}
    size = {"a": 100, "b": 1000, "c": 10, None: 500}
    level = 0.0  # by bisection
    lo, hi = 0.0, 1e6
    for _ in range(200):
        level = (lo + hi) / 2
        lo, hi = (level, hi) if sum(min(2 * size[s], level * weight[s]) for s in size) < budget else (lo, level)
    assert all(got[s] == pytest.approx(min(2 * size[s], level * weight[s])) for s in size)


def test_mix_near_targets(docs):
    rows = mixing.mix(docs).documents.collect()
    by = {}
    for r in rows:
        by.setdefault(r["source"], [0, r["target"], 0])
        by[r["source"]][0] += r["size"] * r["copies"]
        by[r["source"]][2] = max(by[r["source"]][2], r["size"])
        assert 0 <= r["copies"] <= 2
    assert all(abs(taken - target) <= 2 * largest for taken, target, largest in by.values())
    assert sum(t for t, _, _ in by.values()) <= 1.5 * sum(r["size"] for r in rows)


def test_mix_copies_match_rows(docs, odd, clashing):
    for d in (docs, odd, clashing):
        want = sorted((str(r["doc_id"]), r["size"]) for r in mixing.mix(d).documents.collect() for _ in range(r["copies"]))
        taken = mixing.take(d)
        assert taken.columns == d.columns
        assert sorted((str(r["doc_id"]), len(WORD.findall(r["text"]))) for r in taken.collect()) == want


@pytest.mark.parametrize("ids", [7777, None])
@pytest.mark.parametrize("least", [10**9, 16])
def test_mix_takes_part_of_a_group_of_equal_rows(spark, monkeypatch, ids, least):
    monkeypatch.setattr(mixing, "REPEAT_ROWS", least)
    rows = [(i, f"w{i} " * 10, "en", "a", 0) for i in range(600)] + [(ids, "same text of just ten words in all, is it", "en", "b", k) for k in range(400)]
    rows += [(5000 + i, f"v{i} " * 10, "en", "b", 0) for i in range(200)] + [(9000 + i, f"u{i} " * 10, "en", "c", 0) for i in range(600)]
    d = spark.createDataFrame(rows, DOCS).repartition(5)
    mixed = mixing.mix(d).documents.collect()
    taken = {}
    for r in mixed:
        taken.setdefault(r["source"], [0, r["target"]])[0] += r["size"] * r["copies"]
    assert len(mixed) == len(rows) and all(abs(t - target) <= 10 for t, target in taken.values())
    assert sum(t for t, _ in taken.values()) > 1.5 * 10 * len(rows) - 10
    out = mixing.take(d).collect()
    words = {}
    for r in out:
        words[r["source"]] = words.get(r["source"], 0) + len(WORD.findall(r["text"]))
    assert words == {s: t for s, (t, _) in taken.items()}
    copies = {}
    for r in out:
        copies[r["doc_id"], r["n_chars"]] = copies.get((r["doc_id"], r["n_chars"]), 0) + 1
    want = sorted(r["copies"] for r in mixed if r["doc_id"] == ids)
    assert sorted(copies.get((ids, k), 0) for k in range(400)) == want and max(want) <= 2


def test_mix_odd_tables(none, odd, spark):
    assert mixing.mix(none).documents.count() == 0 and mixing.take(none).count() == 0
    rows = mixing.mix(odd).documents.collect()
    assert len(rows) == len(ODD) and all(r["copies"] == 0 for r in rows if not r["size"])
    blank = spark.createDataFrame([(1, None, "en", "a", 0), (2, " ", "en", "b", 0)], DOCS)
    assert [r["copies"] for r in mixing.mix(blank).documents.collect()] == [0, 0] and mixing.take(blank).count() == 0


# token output

@pytest.mark.parametrize("size", [1, 2, 3, 17, 64, 1000, 4097])
def test_feistel_is_a_permutation(size):
    got = token_output.feistel(np.arange(size), size)
    assert sorted(got.tolist()) == list(range(size))
    if size >= 64:
        assert (got != np.arange(size)).mean() > 0.9


def test_token_output_round_trip(spark, docs, odd, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = token_output.encoder(path)
    for k, d in enumerate((docs, odd)):
        out = f"{tmp_path}/{k}"
        shards = token_output.write(d, path, out, length=64, shard_bytes=1 << 15)
        rows = sorted(token_output.read(spark, out, 64).collect())
        assert [r["slot"] for r in rows] == list(range(len(rows))) and (shards > 1)
        assert [r["place"] for r in rows] == sorted(r["place"] for r in rows)
        parts = {}
        for r in rows:
            parts.setdefault((r["doc_id"], ), []).append((r["part"], r["ids"]))
        want = {}
        for r in d.select("doc_id", "text").collect():
            ids = own.encode_ordinary(r["text"] or "")
            want.setdefault((r["doc_id"], ), []).extend((i, ids[i * 64:(i + 1) * 64]) for i in range(max(1, -(-len(ids) // 64))))
        assert {k: sorted(v) for k, v in parts.items()} == {k: sorted(v) for k, v in want.items()}
        rest = sorted(token_output.read(spark, out, 64, start=len(rows) // 2).collect())
        assert rest == rows[len(rows) // 2:]


def test_token_output_takes_small_batches(spark, tmp_path, monkeypatch):
    """Batches of thousands of documents, with ids and records beside them, filled the executors."""
    plain = type(spark.range(1)).mapInArrow
    rows, size = token_output.BATCH_ROWS, token_output.BATCH_BYTES

    def held(self, func, schema, *more):
        def run(batches):
            def checked():
                for b in batches:
                    assert b.num_rows <= rows and (b.num_rows == 1 or b.nbytes <= 2 * size), (b.num_rows, b.nbytes)
                    yield b
            return func(checked())
        return plain(self, run, schema, *more)

    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", held)
    d = spark.range(0, 2000, 1, 1).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 100 == 0, F.repeat(F.lit("wide "), 60000)).otherwise("a few words").alias("text"))
    token_output.write(d, public_tokenizers.path("byte_bpe_50k.tiktoken"), f"{tmp_path}/small")
    assert token_output.read(spark, f"{tmp_path}/small").select("doc_id").distinct().count() == 2000


def test_token_output_empty(spark, none, tmp_path):
    token_output.write(none, public_tokenizers.path("byte_bpe_50k.tiktoken"), f"{tmp_path}/e")


# URL filters

def brute_url(url):
    m = re.search(r"(?s)://([^/?#]*)([^?#]*)", url or "")
    host, path = (m.group(1).translate(str.maketrans(url_filters.UPPER, url_filters.LOWER)), m.group(2)) if m else ("", "")
    fits = [(h + p, v) for h, p, v in url_filters.ADDRESS_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, *max(fits, key=lambda x: len(x[0]))
    blocked = re.search(rf"(^|[.-])({'|'.join(url_filters.BLOCKED_WORDS)})([.-]|$)", host) or any(
        re.search(rf"(^|[.-]){a}-{b}([.-]|$)", host) for t in url_filters.TOPICS for x in url_filters.LURES for a, b in ((t, x), (x, t)))
    return host, path, None, "block" if blocked else "allow"


def test_url_verdicts(spark):
    urls = [None, "", "no scheme", "http://", "http://org", "http://org/", "https://A.ORG/x?y#z", "http://notorg/", "http://x.org:80/",
            "http://example.org/es/1", "http://m.example.org/es/", "http://example.org/es", "http://example.org/en/12", "http://example.org/en/2",
            "http://a.com/fr/", "http://a.com/de/x", "http://a.com/", "http://free-bets.example.com/en/1", "http://casino.net", "http://roads.net/",
            "ftp://a://b.org/c", "http://poker-win.net/", "http://a.win-poker.b-c.com/x", "http://poker.win.net/", "http://xpoker-win.net", "http://poker-cheap-loans.net/",
            "http://b.com?u=/de/", "http://b.com#/de/", "http://b.com/de/\n1", "http://x.org/" + "a" * 100_000]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(None, urls[5], "c"), (5, urls[5], "c")],
                                  "page_id long, url string, verdict string")
    got = sorted(map(tuple, url_filters.judge(pages).collect()), key=str)
    assert got == sorted([(p, *brute_url(u)) for p, u, _ in pages.collect()], key=str)
    assert url_filters.judge(pages.limit(0)).count() == 0


def test_url_path_ends_at_a_second_scheme_in_query_or_fragment(spark):
    urls = ["http://x.com?u=http://y.com/de/1", "http://x.com#http://y.com/de/1", "http://x.com/fr/1?u=http://y.com/de/1", "a://b://c/d"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = sorted(map(tuple, url_filters.judge(pages).collect()))
    assert got == [(0, "x.com", "", None, "allow"), (1, "x.com", "", None, "allow"), (2, "x.com", "/fr/1", "com/fr/", "allow"), (3, "b:", "//c/d", None, "allow")]


def test_url_index_files_rules_under_rare_tokens(spark):
    rules = url_filters.rule_table(spark, url_filters.default_rules())
    tokens = spark.createDataFrame([("h:org",)] * 5 + [("h:example",)] * 9 + [("p:es",)] * 2, "token string")
    got = {r["name"]: r["token"] for r in url_filters.index_rules(rules, tokens).collect()}
    assert got["example.org/es/"] == "p:es" and got["example.org/en/1"] == "p:en" and got["org/"] == "h:org"


# winnowing

def brute_print(text):
    if not WORD.search(text):
        return []

    def runs(tokens, n):
        out = []
        for i in range(max(len(tokens) - n + 1, 1)):  # Spark hashes the tokens one after the other, each seeded by the hash before it
            h = 42
            for x in tokens[i:i + n]:
                h = xxhash.xxh64_intdigest(x.encode(), h)
            out.append((h >> 25) << 24 | (1 << 24) - 1 - (i & (1 << 24) - 1))
        return out

    def winnowed(g):
        return list(dict.fromkeys(g if len(g) < 16 else [min(g[i:i + 8]) for i in range(len(g) - 7)]))

    out = list(dict.fromkeys(runs(text, 3))) if len(text) <= 96 else []
    if 65 <= len(text) <= 1024:
        out += winnowed(runs(text, 8))
    return out + winnowed(runs(re.findall(r"[^\x20\x09-\x0D]{1,16}", text), 5))


def alike(a, b):
    a, b = {x >> 24 for x in a}, {x >> 24 for x in b}
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("range_bytes", [1 << 30, 3000])
def test_winnowing(spark, docs, odd, range_bytes):
    for d in (docs.limit(80), odd.where("doc_id <> 6 or doc_id is null")):
        d = d.selectExpr("doc_id", "coalesce(text, '') text")
        rows = sorted(((r["doc_id"], r["text"]) for r in d.collect()), key=lambda r: (r[0] is None, -(r[0] or 0)))
        want = []
        for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
            c = len(t) // 3
            e = t[:len(t) - c] + n[:c]
            p, q = brute_print(t), brute_print(e)
            want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), p, q, alike(p, q), alike(p, brute_print(n))))
        assert sorted(map(tuple, winnowing.edited(d, range_bytes).collect()), key=str) == sorted(want, key=str)


def test_winnowing_guarantee(spark):
    shared = " ".join(f"s{i}" for i in range(12))
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(7 * i)) + " " + shared + " tail" * i) for i in range(6)]
    got = winnowing.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets = [{x >> 24 for x in r["print"]} for r in got]
    assert all(a & b for a in sets for b in sets)
    assert all(len(r["positions"]) == len(r["print"]) for r in got)


def test_winnowing_sees_the_unchanged_two_thirds(spark):
    import random

    rng = random.Random(8)
    rows = []
    for n in [4, 5, 9, 30, 64, 65, 90, 96, 97, 140, 256, 257, 300, 500, 1024, 1025, 1300, 1540, 3000]:
        for alphabet in ("abc  d", "日本語中文字", "x", "ab\n c"):
            rows.append("".join(rng.choice(alphabet) for _ in range(n - 1)) + "e")
    rng.shuffle(rows)
    got = winnowing.edited(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    assert len(got) == len(rows) and all(r["near_edited"] > 0 for r in got)


def test_winnowing_odd_tables(none, clashing):
    assert winnowing.edited(none).count() == 0
    assert winnowing.edited(clashing.select("doc_id", "text")).count() == 6 and winnowing.fingerprints(clashing).count() == 6


# licences

def found_licences(spark, texts):
    rows = list(enumerate(texts))
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return {r["doc_id"]: (r["licence"], round(r["dice"], 3)) for r in got}


def test_licences(spark, odd, none, clashing):
    mit, header = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["GPL-3.0-header"]
    texts = ["", f"some prose here\n{mit.upper()}\nmore", "\n".join(header.split(". ")), "prose\n\n" + header.replace(" it ", "\n") + "\n\nx",
             "nothing to see", "Licensed under the Apache License, Version 2.0", None, "All  rights -- reserved", "rights", "Reserved. All rights"]
    got = found_licences(spark, texts)
    assert got[1] == ("MIT", 1.0) and got[2][0] == "GPL-3.0-header" and got[3][0] == "GPL-3.0-header" and got[5] == ("Apache-2.0", 1.0)
    assert got[7] == ("Proprietary", 1.0) and set(got) == {1, 2, 3, 5, 7}
    assert licenses.scan(odd).count() == 0 and licenses.scan(none).count() == 0 and licenses.scan(clashing).count() == 0


def test_licences_inside_other_text(spark):
    t = licenses.TEMPLATES
    wrapped = "\n".join("# " + line for line in textwrap.wrap(t["Apache-2.0-header"], 60))
    texts = ["This tool parses tables. Released under the MIT License. See the docs.", "Licensed under the Apache License, Version 2.0; see LICENSE.",
             "MIT License Copyright (c) 2020 Foo " + t["MIT-text"], "// " + t["MPL-2.0-header"].replace(". ", ".\n// ") + "\nint main() {}",
             "# Copyright 2020 Foo\n" + wrapped + "\nimport os\nprint(os.name)", "x " * 5000 + t["BSD-3-Clause"] + " y" * 5000, t["BSD-2-Clause"], t["Unlicense"], t["ISC"],
             "Copyright 2020 Foo. All rights reserved.", " ".join(w for k, w in enumerate(t["MIT-text"].split()) if k % 12)]
    got = found_licences(spark, texts)
    assert {k: v[0] for k, v in got.items()} == {0: "MIT", 1: "Apache-2.0", 2: "MIT-text", 3: "MPL-2.0-header", 4: "Apache-2.0", 5: "BSD-3-Clause",
                                                6: "BSD-2-Clause", 7: "Unlicense", 8: "ISC", 9: "Proprietary", 10: "MIT-text"}
    header = spark.createDataFrame([(0, texts[4]), (1, texts[1])], "doc_id long, text string")  # the header holds the short notice
    assert {r["doc_id"]: r["n_licences"] for r in licenses.scan(header).collect()} == {0: 2, 1: 1}


def brute_licence(text):
    """Every window of every template's length, wherever it begins."""
    w = licenses.plain(text)
    grams, best = [f"{a} {b}" for a, b in zip(w, w[1:])], {}
    for t in licenses.prepared(licenses.TEMPLATES):
        own = set(t.grams)
        for s in range(1 - t.length, len(grams)):
            window = set(grams[max(s, 0):s + t.length])
            best[t.name] = max(best.get(t.name, 0.0), 2 * len(window & own) / (len(window) + len(own)))
    return {k: v for k, v in best.items() if v >= licenses.THRESHOLD}


def test_licence_windows_lose_little_to_all_windows(spark):
    import random

    rng, texts = random.Random(4), []
    for name, text in sorted(licenses.TEMPLATES.items()):
        for change in (0, 0.02, 0.05):
            words = [("changed" if rng.random() < change else w) for w in text.split()]
            texts.append(" ".join(["intro"] * rng.randrange(30) + words + ["outro"] * rng.randrange(30)))
    got, want = found_licences(spark, texts), [brute_licence(t) for t in texts]
    assert all(got[k][1] <= round(max(want[k].values()), 3) for k in got) and {k for k in got} <= {k for k, v in enumerate(want) if v}
    assert len(got) >= 0.95 * sum(bool(v) for v in want)


def test_anchors_cannot_all_be_missed():
    for t in licenses.prepared(licenses.TEMPLATES):
        need = -(-len(t.grams) * 4 // 6)  # b t / (2 - t) for t = 0.8
        assert len(t.grams) - len(t.anchors) < need and set(t.anchors) <= set(t.grams)


def test_licence_bounds_drop_nothing():
    for n in range(1, 60):
        low, high = licenses.bounds(n)
        for m in range(1, 200):
            assert (low <= m <= high) or 2 * min(m, n) / (m + n) < licenses.THRESHOLD


def oracle_rows(spark, name, **tables):
    """The oracle's rows over small tables."""
    import duckdb

    from driftline.llm import queries
    con = duckdb.connect()
    for t, df in tables.items():
        con.register(t, df.toPandas())
    return con.execute(queries.ORACLES[name]).fetchall()


def test_oracles_on_cases_that_the_tables_lack(spark):
    urls = ["http://x.com?u=http://y.com/de/1", "http://x.com#http://y.com/de/1", "a://b://c/d", "http://win-poker.com", "http://slots-free.x.org", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert sorted(oracle_rows(spark, "op3_url_filters", pages=pages)) == sorted(map(tuple, url_filters.judge(pages).collect()))
    # a source that is a third junk: the wider sketch binds
    text = lambda i, s: " ".join(f"w{i}x{k}{s}" for k in range(60))
    rows = [(i, text(i, ""), "en", "prose", 0) for i in range(1200)] + [(2000 + i, text(2000 + i, "#$" if i % 5 < 2 else ""), "en", "dump", 0) for i in range(300)]
    d = spark.createDataFrame(rows, DOCS)
    own = quality_rules.judge(d, carry=["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert sorted(oracle_rows(spark, "op10_quality_rules", documents=d)) == sorted(map(tuple, own.collect()))
    assert own.where("not kept").count() == 120


# SimHash

def brute_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    sh = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(fps, max_bits=2):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= max_bits:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_simhash(docs, odd):
    for d in (docs, odd):
        rows = [(r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect()]
        fps = [brute_fingerprint(t) for _, t in rows]
        roots = brute_components(fps)
        least = {}
        for (i, _), r in zip(rows, roots):
            least[r] = min((x for x in (i, least.get(r)) if x is not None), default=None)
        want = sorted(((i, f"{f:016x}", least[r]) for (i, _), f, r in zip(rows, fps, roots)), key=str)
        for node_rows in (simhash.NODE_ROWS, 8):
            got = simhash.near_duplicates(d, rows=node_rows).collect()
            assert sorted(map(tuple, got), key=str) == want
        kept = simhash.deduplicate(d)
        assert kept.columns == d.columns and kept.count() == len(set(roots))
        assert {r["doc_id"] for r in kept.collect()} == {least[r] for r in roots}


def test_simhash_chains_and_upper_nodes(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 300, dtype=np.uint64)
    chain = [base]
    for _ in range(4):  # chains of links across all bits, so across all nodes
        chain.append(chain[-1] ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)))
    dense = (np.uint64(5) << np.uint64(60)) + np.arange(700, dtype=np.uint64) * np.uint64(9)  # a crowded node
    fps = np.unique(np.concatenate([*chain, dense]))
    d = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    want = brute_components([int(x) for x in fps])
    got = {r["fp"]: r["root"] for r in simhash.rooted(d, rows=20).collect()}
    mine = [got[int(x)] for x in fps.view(np.int64)]
    assert len(got) == len(fps)
    assert len(set(zip(want, mine))) == len(set(want)) == len(set(mine))


def test_simhash_odd_tables(none, clashing):
    assert simhash.near_duplicates(none).count() == 0 and simhash.deduplicate(none).count() == 0
    kept = simhash.deduplicate(clashing)
    assert kept.columns == clashing.columns and 1 <= kept.count() <= 6


# token counts

TEXTS = ["", "a\tb\x0bc <|endoftext|> x<|startoftext|>y  z\n\n!!..!! 'S it's ́e \x1c!\x1c\x85   ! !", "é" * 100, "x" * 3000, "日本語" * 900,
         "many words here, " * 900, "!?" * 1500, "\n", " ", "ς Σ İ ǅ"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts(docs, name):
    path = public_tokenizers.path(name)
    whole, pieces = token_counts.TokenCounter(path), token_counts.TokenCounter(path, huge=1500, chunk=700, overlap=50)
    texts = TEXTS + [r["text"] for r in docs.limit(60).collect()]
    want = [len(whole.encode(t)) if t else 0 for t in texts]
    assert whole.count_all(texts) == want and pieces.count_all(texts) == want and pieces.count_all([None]) == [0]


def test_token_count_rows(odd, none, clashing):
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = token_counts.TokenCounter(path, huge=10**9)
    got = sorted(map(tuple, token_counts.count_tokens(odd, path).collect()), key=str)
    want = [(i, len((t or "").encode()), n, n > 2048) for (i, t, *_), n in zip(ODD, whole.count_all([r[1] for r in ODD]))]
    assert got == sorted(want, key=str)
    assert token_counts.count_tokens(none, path).count() == 0 and token_counts.count_tokens(clashing, path).count() == 6


# sampled pieces

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_sampled_pieces_distribution():
    own = sampled_pieces.Lattices(PIECES)

    def segmentations(u):
        if not u:
            return [((), 1.0)]
        return [((own.ids[u[:n]], *s), np.exp(own.weight[own.ids[u[:n]]]) * w) for n in range(1, len(u) + 1) if u[:n] in own.ids
                for s, w in segmentations(u[n:])]

    n = 40_000
    for word in ("there", "ab  c"[:2], "Über"):
        every = segmentations(" " + word)
        total = sum(w for _, w in every)
        ids, at = own.sample([word] * n, sampled_pieces.row_keys(range(n), [word] * n))
        got = {}
        for a, z in zip(at, at[1:]):
            got[tuple(ids[a:z].tolist())] = got.get(tuple(ids[a:z].tolist()), 0) + 1
        assert set(got) <= {s for s, _ in every}
        assert all(abs(got.get(s, 0) / n - w / total) < 0.01 for s, w in every)


def test_sampled_pieces_lossless_and_reproducible():
    texts = [*TEXTS, None, "  two  blanks ", "\x00\ud7ff\U0010ffff", "a" * 3000, "🙂" * 200]
    keys = sampled_pieces.row_keys(range(len(texts)), texts)
    own, other = sampled_pieces.Lattices(PIECES), sampled_pieces.Lattices(PIECES)
    ids, at = own.sample(texts, keys)
    assert [own.decode(ids[a:z].tolist()) for a, z in zip(at, at[1:])] == [t or "" for t in texts]
    for k in reversed(range(len(texts))):  # other batches, another order of sight
        one, _ = other.sample([texts[k]], keys[k:k + 1])
        assert one.tolist() == ids[at[k]:at[k + 1]].tolist()


def test_sampled_pieces_rows(spark, docs, odd, none, clashing):
    for d in (docs, odd):
        rows = sampled_pieces.encode(d, PIECES, lossless="ok").collect()
        assert len(rows) == d.count() and all(r["ok"] for r in rows)
        back = sampled_pieces.decode(sampled_pieces.encode(d, PIECES, keep=["doc_id"]), PIECES).collect()
        assert sorted(((r["doc_id"], r["text"]) for r in back), key=str) == sorted(((r["doc_id"], r["text"] or "") for r in d.collect()), key=str)
    assert sampled_pieces.encode(none, PIECES).count() == 0
    assert sampled_pieces.encode(clashing, PIECES, out="sampled").columns == [*clashing.columns, "sampled"]


# toxicity

def test_grammar():
    fst = toxicity.grammar()

    def score(text):
        return toxicity.score_clause([(w, 5.0 if w == "idiot" else 0.0) for w in text.split()], fst)

    assert score("an idiot") == 5 and score("you idiot") == pytest.approx(6.5) and score("not an idiot") == pytest.approx(3)
    assert score("he said so the man was idiot") == pytest.approx(3.5) and score("i will kill you") == 3 and score("i will kill time") == 0
    assert score("you will not be such idiot") == pytest.approx(5 * 0.6) and score("plain words") == 0


def test_toxicity_learns_and_holds_out(spark):
    bad = ["zorgu", "blekh"]
    rows, labels = [], []
    for i in range(1200):
        toxic = i % 6 == 0
        words = [f"{'qwertzuiop'[(i + k) % 10]}{'asdfghj'[(i * k) % 7]}{k}x" for k in range(40)]
        if toxic:
            words[i % 30] = bad[i % 2] + "abc"[i % 3]
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    d = spark.createDataFrame(rows, DOCS)
    lab = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.predictions(d, lab).collect()}
    held = {i for i in range(1200) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert {i for i, r in got.items() if r["held_out"]} == held
    assert all(got[i]["predicted"] == t for i, _, t in labels if i in held)
    flipped = spark.createDataFrame([(i, q, 1 - t if i in held else t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    assert {r["doc_id"]: r["score"] for r in toxicity.predictions(d, flipped).collect()} == {i: r["score"] for i, r in got.items()}
    assert toxicity.filter_toxic(d, lab).count() == 1000


def plain_stems(rows):
    """{stem: log odds} from (text, toxic), by sets and counts of whole documents."""
    clean, toxic = sum(not t for _, t in rows), sum(bool(t) for _, t in rows)
    held = {}
    for text, t in rows:
        low = (text or "").lower()
        for stem in {s for w in re.findall(r"[^\W\d_]+", low) for s in ([w[:4], w[:6]] if len(w) >= 6 else [w[:4], w + " "] if len(w) >= 4 else [w + " "])}:
            a, b, texts = held.setdefault(stem, ([], [], set()))
            (b if t else a).append(1)
            if t:
                texts.add(zlib.crc32(low.encode()) % 60)
    odds = {s: float(np.log((len(b) + 0.5) / (toxic + 1)) - np.log((len(a) + 0.5) / (clean + 1)))
            for s, (a, b, texts) in held.items() if len(b) >= 5 and len(texts) >= 5 and len(b) > len(a)}
    return {s: v for s, v in odds.items() if v >= toxicity.MIN_LOG_ODDS}


def plain_figures(text, stems):
    """A document's figures by looking back from every word of every clause, without automaton and transducers."""
    scores = []
    for clause in re.split(r"[.!?;:\n]", (text or "").lower()):
        kinds = []
        for w in re.findall(r"[^\W\d_]+", clause):
            known = [w[:4], w[:6]] if len(w) >= 6 else [w[:4], w + " "] if len(w) >= 4 else [w + " "]
            weight = max([stems.get(s, 0.0) for s in known])
            kinds.append(("insult" if weight else "threat" if w in toxicity.THREATS else "aim" if w in toxicity.TARGETS else
                          "not" if w in toxicity.NEGATIONS else "report" if w in toxicity.REPORTS else "", weight))
        score = 0.0
        for i, (kind, weight) in enumerate(kinds):
            before = [k for k, _ in kinds[:i]]
            worth = weight if kind == "insult" else 0.0
            if kind == "aim":
                near = before[-3:]
                if "threat" in near and "aim" not in near[len(near) - near[::-1].index("threat"):]:
                    worth = toxicity.THREAT
            worth *= (0.6 if "not" in before[-3:] else 1) * (1.3 if kind != "aim" and "aim" in before[-4:] else 1) * (0.7 if "report" in before else 1)
            score += worth
        if score > 0:
            scores.append(score)
    return np.log1p(sum(scores)), max(scores, default=0.0), np.log1p(len(scores))


def test_toxicity_against_plain_counts_and_clauses(spark):
    """Stems, figures, curve and scores over all documents of a table, by a second, plain version."""
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    flags = {r["doc_id"]: r["toxic"] for r in lab.collect() if r["toxic"] is not None}
    rows = [(r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect()]
    known = [(i, t, flags[i]) for i, t in rows if i in flags and zlib.crc32(str(i).encode()) % 4 != 2]
    stems = plain_stems([(t, y) for _, t, y in known])
    model = toxicity.learn(d, lab)
    assert len(stems) > 5 and set(model.stems) == set(stems) and all(model.stems[s] == pytest.approx(v) for s, v in stems.items())
    extra = ["You will not kill time, you idiot. They said he is no idiot! kill them; never hurt you you", "not never you said IDIOTS", ""]
    words = sorted(s.strip() for s in stems)[:6]
    extra += [f"you {w}s are not {w} he wrote {w}; kill a b you, kill you a b c d {w}" for w in words]
    for text in [t for _, t in rows] + extra:
        assert model.figures(text) == pytest.approx(plain_figures(text, stems)), text
    x = np.array([plain_figures(t, stems) for _, t, _ in known])
    y = np.array([f for *_, f in known], float)
    shift = x.mean(axis=0)
    w = np.zeros(4)  # ridge logistic regression by plain gradient steps
    a = np.column_stack([np.ones(len(x)), x - shift])
    for _ in range(400):
        p = 1 / (1 + np.exp(-a @ w))
        w += np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + np.diag([1e-9, 1, 1, 1]), a.T @ (y - p) - np.array([0, 1, 1, 1]) * w) * 0.5
    want = {i: 1 / (1 + np.exp(-np.clip(w[0] + (np.array(plain_figures(t, stems)) - shift) @ w[1:], -30, 30))) for i, t in rows}
    got = {r["doc_id"]: r["score"] for r in toxicity.predictions(d, lab).collect()}
    assert set(got) == set(want) and all(got[i] == pytest.approx(want[i], abs=1e-6) for i in want)


def test_toxicity_stems_pass_the_odds_whatever_the_header(spark):
    # labels in balance: 20 common words are in 30 toxic and 29 clean texts, the insult in 8 toxic ones; all begin alike
    head = "The same long header line stands above every document of this source. "
    rows = [(head + f"{i} " + " ".join(f"com{c}" for c in "abcdefghijklmnopqrst") + (" zorgu" if i < 8 else ""), 1, i) for i in range(30)]
    rows += [(head + f"start {i} " + " ".join(f"com{c}" for c in "abcdefghijklmnopqrst"), 0, 100 + i) for i in range(29)] + [("plain", 0, 200)]
    rows += [(head + "copied qwert", 1, 300)] * 9  # copies of one text are one text
    stems, clean, toxic = toxicity.learn_stems(spark.createDataFrame(rows, "text string, toxic int, l_id long"))
    assert (clean, toxic) == (30, 39) and {"zorg", "zorgu "} <= set(stems) and not any(s.startswith(("com", "qwer")) for s in stems)


def test_toxicity_collects_one_row_of_each_labelled_id(spark):
    d = spark.createDataFrame([(1 + i % 3, f"You idiot number {i}.") for i in range(600)] + [(4, None)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, 1, int(i < 3)) for i in range(1, 5)], "doc_id long, quality int, toxic int")
    examples = toxicity.learnable(d, lab, "doc_id", "text")
    model = toxicity.Model({"idio": 3.0}, constant=None)
    assert toxicity.figures_by_id(examples, model).count() == examples.select("l_id").distinct().count() <= 4
    assert toxicity.predictions(d, lab).count() == 601


def test_toxicity_odd_tables(spark, odd, none, clashing):
    lab = spark.read.parquet(f"{SF}/labels.parquet")
    rows = toxicity.predictions(odd, lab).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.predictions(none, lab).count() == 0 and toxicity.predictions(odd, lab.limit(0)).count() == len(ODD)
    kept = toxicity.filter_toxic(clashing, lab)
    assert kept.columns == clashing.columns


# pipeline

def test_pipeline_with_clashing_names(spark, docs):
    """Every working and result name of all stages as a column of the documents, some in upper case."""
    import corpus_pipeline

    lab = spark.read.parquet(f"{SF}/labels.parquet")
    names = ("g_lang g_source limit_symbols limit_dup_lines limit_repeats limit_word_length n_words word_chars n_symbols n_lines n_dup_lines "
             "n_repeat_words base_failed kept body of_lines by_word rule limit docs fence b n Score held_out predicted l_id toxic rid fp kept_rid "
             "dropped_rid root o cut_source cut_copies cut_draw cut_size cut_there cut_of cut_row cut_upto copy draw size chunk source_size target "
             "bound_source PIECES own_pieces text_").split()
    wide = docs.select("*", *[F.lit(n).alias(n) for n in names])
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        plain, after = stage(spark, docs, SF), stage(spark, wide, SF)
        got, want = ([(r["doc_id"], r["text"]) for r in x.select("doc_id", "text").collect()] for x in (after, plain))
        assert sorted(got) == sorted(want), name
        if k < 4:
            assert after.columns == wide.columns
        else:
            assert [c for c in after.columns if c.lower() != "pieces"][:5] == docs.columns and {"pieces", "_own_PIECES"} <= set(after.columns)
        assert all(after.where(F.col(f"`{n}`") != n).limit(1).count() == 0 for n in ("kept_rid", "g_lang", "cut_row"))
        docs, wide = spark.createDataFrame(plain.collect(), plain.schema), spark.createDataFrame(after.collect(), after.schema)


def test_pipeline_stages(spark, docs):
    import corpus_pipeline

    lab = spark.read.parquet(f"{SF}/labels.parquet")
    before = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, SF)
        rows, old = after.collect(), before.collect()
        if k < 4:
            assert after.schema.names == docs.schema.names and {r["doc_id"] for r in rows} <= {r["doc_id"] for r in old}
        if k == 0:
            judged = {r["doc_id"] for r in quality_rules.judge(before).collect() if r["kept"]}
            assert {r["doc_id"] for r in rows} == judged
        elif k == 1:
            assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in toxicity.predictions(before, lab).collect() if not r["predicted"]}
        elif k == 2:
            roots = brute_components([brute_fingerprint(r["text"]) for r in old])
            assert len(rows) == len(set(roots))
        elif k == 4:
            own = sampled_pieces.Lattices(PIECES)
            assert len(rows) == len(old) and all(own.decode(r["pieces"]) == r["text"] for r in rows)
        before = spark.createDataFrame(rows, after.schema)
