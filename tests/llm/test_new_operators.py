"""Ranked search, whitening and weak supervision against brute force, and their odd inputs."""

import math
import random
import re
import sys
from collections import Counter
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tallyweave.llm import embedding_whitening, media_columns, quality_rules, queries, ranked_search, url_filters  # noqa: E402

SF = "/root/testdata/sf0.01"


def _terms(text):
    fold = lambda c: c.lower() if c.isascii() else c
    return re.findall(ranked_search.TERM, "".join(map(fold, text or "")))


def _ranked(docs, queries_, k):
    """All scores of all documents, sorted."""
    held = [(d, Counter(_terms(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n, every, df = len(held), sum(sum(c.values()) for _, c in held), Counter(t for _, c in held for t in c)
    out = []
    for item, text in queries_:
        scores = []
        for d, c in held:
            m = 100 - 25 + 25 * sum(c.values()) * n // every
            gain = lambda t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))  # noqa: B023, E731
            scores.append((-sum(gain(t) for t in _terms(text) if t in c), d is None, d or 0))
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(s for s in scores if s[0] < 0)[:k])]
    return out


def _corpus(seed, size):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = [(i // 2 if i % 9 == 0 else i, " ".join(rng.choices(words, weights, k=rng.choice([1, 3, 8, 40])))) for i in range(size)]
    docs += docs[:20] + [(None, "w1 w2 w59 w3"), (None, None), (9001, None), (9002, ""), (9003, "... !"), (9004, "W1 É é w59")]
    asked = [(i, " ".join(rng.choices(words, weights, k=rng.choice([1, 2, 12])))) for i in range(25)] + [(3, "w59 w59 w58"), (30, None), (31, ""), (32, "zz"), (33, "É w59"), (None, "w59 w57"), (34, "w1 w2"), (35, "w1 w2")]
    return docs, asked


def _searched(spark, docs, asked, k):
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, score int, item_id string").repartition(3)
    asked = spark.createDataFrame([(i, t, 7) for i, t in asked], "item_id long, text string, rank int")
    return [tuple(r) for r in ranked_search.search(docs, asked, k=k).collect()]


@pytest.mark.parametrize(("k", "block", "groups"), [(20, 1_000_000, 256), (3, 200, 2), (1, 1, 1)])
def test_search_equals_all_scores(spark, monkeypatch, k, block, groups):
    docs, asked = _corpus(k, 300)
    monkeypatch.setattr(ranked_search, "FIRST_GROUPS", groups)
    for name, value in (("BLOCK_POSTINGS", block), ("MAX_QUERY_BYTES", 500)):
        monkeypatch.setattr(ranked_search, name, value)
    order = lambda rows: sorted(rows, key=str)
    assert order(_searched(spark, docs, asked, k)) == order(_ranked(docs, asked, k))


def test_search_stops_before_the_end_and_stays_exact():
    rng = np.random.default_rng(5)
    docs, n_terms = 4000, 6
    rows = np.arange(docs + 1) * n_terms
    terms = np.tile(np.arange(n_terms), docs)
    impacts = np.floor(rng.pareto(1.2, docs * n_terms) * 100).astype(np.int64)
    block = ranked_search.grouped(list(range(docs)), rows, terms, impacts, n_terms)
    asked, repeats = np.arange(n_terms), np.array([1, 2, 1, 1, 3, 1])
    whole = (impacts.reshape(docs, n_terms) * repeats).sum(axis=1)
    found, scores = ranked_search.best_of_block(block, asked, repeats, 10, 1)
    assert len(found) < docs / 2  # the walk ended early
    assert dict(zip(found.tolist(), scores.tolist())) == {d: whole[d] for d in found}
    edge = np.sort(whole)[-10]
    assert set(np.flatnonzero(whole >= edge)) <= set(found.tolist())
    for least in (int(edge), int(whole.max()), int(whole.max()) + 1):
        found, scores = ranked_search.best_of_block(block, asked, repeats, 10, least)
        assert set(np.flatnonzero(whole >= least)) >= set(found.tolist()) >= set(np.flatnonzero(whole >= max(least, edge)))


def test_search_of_empty_tables(spark):
    assert _searched(spark, [], [(1, "a")], 5) == [] == _searched(spark, [(1, "a b")], [], 5) == _searched(spark, [(1, None)], [(1, "a")], 5)
    assert _searched(spark, [(1, "a " * 200_000 + "b"), (2, "a"), (3, "c")], [(1, "b")], 5)[0][2] == 1


def _whole(vectors):
    return [tuple(math.floor(64 * c) + 1_000_000 for c in v) for v in vectors]


def test_whitening_is_exact_and_white(spark):
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(6, 6))
    vectors = [v.tolist() for v in (rng.normal(size=(150, 6)) @ mix).astype(np.float32).astype(float)]
    odd = [None, [], [1.0, None, 1.0, 1.0, 1.0, 1.0], [float("nan")] * 6, [float("inf"), 1.0, 1.0, 1.0, 1.0, 1.0], [1e300] * 6, [1.0, 2.0]]
    rows = [(i, v, 1) for i, v in enumerate([*vectors, *vectors[:40], *odd])] + [(None, vectors[0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int").repartition(5)
    found = embedding_whitening.whiten(df, components=4).collect()
    keep = {**{i: vectors[i % 150] for i in range(190)}, None: vectors[0]}
    assert Counter((r["vec_id"], r["component"]) for r in found) == Counter((i, c) for i in keep for c in range(1, 5))
    fit = sorted(set(_whole(vectors)))
    n, sums = len(fit), [sum(x) for x in zip(*fit)]
    y = [[n * a - s for a, s in zip(x, sums)] for x in fit]
    exact = [[sum(a[i] * a[j] for a in y) for j in range(6)] for i in range(6)]
    values, axes = np.linalg.eigh(np.array([[float(Fraction(v, n**3)) for v in row] for row in exact]))
    for r in found:
        own = [n * a - s for a, s in zip(_whole([keep[r["vec_id"]]])[0], sums)]
        k = -r["component"]
        assert r["n"] == n and r["deviation"] == sum(v * v for v in own)
        assert abs(abs(r["whitened"]) - abs(np.array(own) / n @ axes[:, k]) / math.sqrt(values[k])) < 1e-9
        assert abs(r["explained"] - values[k] / values.sum()) < 1e-12 and r["identity_error"] < 1e-9


def test_scatter_from_residues_is_exact_for_large_numbers(spark):
    rng = random.Random(8)
    vectors = [[rng.choice([-1, 1]) * 2.0 ** rng.randrange(50) for _ in range(3)] for _ in range(40)]
    df = spark.createDataFrame([(v,) for v in vectors], "v array<double>")
    fitted = embedding_whitening.fit_list(df, "v", 3)
    facts = embedding_whitening.dimension_sums(fitted, 3)
    fit = sorted(set(_whole(vectors)))
    n, sums = len(fit), [sum(x) for x in zip(*fit)]
    assert [(f[0], f[1]) for f in facts] == [(n, s) for s in sums] and [f[2] for f in facts] == [min(x) for x in zip(*fit)]
    reach = max(abs(n * a - s) for x in fit for a, s in zip(x, sums))
    cells = embedding_whitening.exact_scatter(fitted, n, sums, n * reach * reach)
    y = [[n * a - s for a, s in zip(x, sums)] for x in fit]
    assert cells == {3 * i + j: sum(a[i] * a[j] for a in y) for i in range(3) for j in range(i, 3)}
    found = {r["vec_id"]: r["deviation"] for r in embedding_whitening.whiten(spark.createDataFrame(list(enumerate(vectors)), "vec_id int, embedding array<double>")).collect()}
    exact = [sum((n * a - s) ** 2 for a, s in zip(x, sums)) for x in _whole(vectors)]
    assert found == {i: d if d < 1 << 63 else None for i, d in enumerate(exact)}


def test_whitening_without_variance(spark):
    schema = "vec_id int, embedding array<float>"
    assert embedding_whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert embedding_whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    one = embedding_whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0])], schema)).collect()
    assert len(one) == 4 and all(r["n"] == 1 and r["deviation"] == 0 and r["whitened"] is None and r["explained"] == 0 and r["identity_error"] is None for r in one)
    flat = embedding_whitening.whiten(spark.createDataFrame([(i, [float(i), 5.0]) for i in range(4)], schema)).collect()
    assert {(r["component"], r["whitened"] is None) for r in flat} == {(1, False), (2, True)} and flat[0]["identity_error"] < 1e-12


def _facts(text):
    words = re.findall(quality_rules.WORD, text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    again = Counter(windows)
    hit = {i + j for i, w in enumerate(windows) if again[w] > 1 for j in range(5)}
    lines = [s for s in text.split("\n") if re.search(quality_rules.WORD, s)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(s in lines[:i] for i, s in enumerate(lines)), len(hit)


def test_text_facts_equal_plain_counts(spark):
    rng = random.Random(2)
    odd = [None, "", " \n\t", "a\na\n\n \na", "x " * 9, "a b c d e a b c d e", "\x1ca b\x85c d", "É#é|\n" * 3, "w " * 100_000]
    texts = odd + [" ".join(rng.choices("ab", k=n)) for n in range(4, 40)] + ["\n".join(rng.choices(["a b", "c", " ", ""], k=12)) for _ in range(20)]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id int, text string, n_words int")
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    found = {r["doc_id"]: tuple(r[c] for c in columns) for r in quality_rules.text_facts(docs).collect()}
    assert found == {i: _facts(t or "") for i, t in enumerate(texts)}


def test_expectation_maximisation_finds_planted_accuracies():
    rng = np.random.default_rng(1)
    size, accuracies, speaks = 60_000, [0.95, 0.9, 0.8, 0.85, 0.7], [0.9, 0.5, 0.7, 0.4, 0.8]
    truth = np.where(rng.random(size) < 0.7, 1, -1)
    cast = np.stack([np.where(rng.random(size) < s, np.where(rng.random(size) < a, truth, -truth), 0) for a, s in zip(accuracies, speaks)], axis=1)
    patterns, number, counts = np.unique(cast, axis=0, return_inverse=True, return_counts=True)
    fitted = quality_rules.expectation_maximisation(patterns, counts.astype(float))
    assert np.abs(fitted.accuracies - accuracies).max() < 0.03 and abs(fitted.good - 0.7) < 0.02
    good = quality_rules.posterior(fitted, patterns)[number] >= 0.5
    assert (good == (truth == 1)).mean() > max((cast[:, i] == truth)[cast[:, i] != 0].mean() * speaks[i] for i in range(5))
    # plain products of rates give the same probabilities
    for pattern in patterns[::7]:
        rates = [(a if v == 1 else 1 - a, 1 - a if v == 1 else a) for v, a in zip(pattern, fitted.accuracies) if v]
        yes, no = fitted.good * math.prod(r[0] for r in rates), (1 - fitted.good) * math.prod(r[1] for r in rates)
        assert abs(quality_rules.posterior(fitted, pattern[None])[0] - yes / (yes + no)) < 1e-9


def test_quality_query_holds_the_base_and_labels(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    right = bad = kept_good = good = 0
    for r in queries.op13_quality_rules(spark, SF).collect():
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == _facts(texts[r["doc_id"]])
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and not (r["base_failed"] and r["kept"])
        if not r["base_failed"] and r["doc_id"] in labels:
            bad, right = bad + (labels[r["doc_id"]] == 0), right + (labels[r["doc_id"]] == 0 and not r["kept"])
            good, kept_good = good + labels[r["doc_id"]], kept_good + (labels[r["doc_id"]] == 1 and r["kept"])
    assert right >= 0.9 * bad and kept_good >= 0.99 * good


def test_keep_good_of_odd_tables(spark):
    schema = "doc_id int, text string, votes string, n_words int"
    assert quality_rules.keep_good(spark.createDataFrame([], schema)).count() == 0
    clean = "The old house by the river stood empty for many years before anyone came. " * 1
    rows = [(i, clean + f"Then guest number{chr(97 + i % 20)} moved in.", "v", 3) for i in range(60)] + [(100, "BUY!! NOW!! CHEAP!! $$$ ### !!! " * 9, "v", 3)] * 2 + [(101, None, "v", 3), (None, "", "v", 3)]
    kept = quality_rules.keep_good(spark.createDataFrame(rows, schema))
    assert kept.columns == ["doc_id", "text", "votes", "n_words"]
    assert Counter(map(tuple, kept.collect())) == Counter(r for r in rows if r[0] != 100)


def test_fingerprints_are_stored_and_equal_a_plain_transform(spark, monkeypatch):
    texts = [None, "", "plain", "the quick brown fox jumps over the lazy dog " * 20, "é漢" * 400, "the quick brown fox jumps over the lazy dog " * 20]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id int, text string, times string")
    for held in (10, media_columns.HELD):
        monkeypatch.setattr(media_columns, "HELD", held)
        found = {r["doc_id"]: r for r in media_columns.media_facts(docs).collect()}
        assert sorted(found) == list(range(len(texts)))
        assert found[3]["times"] == found[5]["times"] and found[3]["feature"] == found[5]["feature"] and found[0]["codes"] == found[1]["codes"] == []
        for i, text in enumerate(texts):
            samples = np.frombuffer(media_columns.payload(text), np.uint8).astype(float)
            short = max(0, 256 - len(samples)) or -(len(samples) - 256) % 128
            samples = np.r_[samples, np.full(short, 128)] - 128
            bins = []
            for at in range(0, len(samples) - 255, 128):
                power = np.rint(np.abs(np.fft.rfft((samples[at : at + 256] * media_columns._SHAPE).astype(np.float32)))[1:-1]).astype(int)
                around = np.r_[0, power, 0]
                tops = [b for b in range(len(power)) if power[b] > max(around[b], around[b + 2])]
                bins.append(sorted(tops, key=lambda b: (-power[b], b))[:3])
            want = sorted((t, (a << 16) + (b << 8) + gap) for gap in (1, 2) for t in range(len(bins) - gap) for a in bins[t] for b in bins[t + gap])
            assert list(zip(found[i]["times"], found[i]["codes"])) == want
            assert found[i]["feature"].startswith(f"{len(want)}|")
    made = {r["doc_id"]: r["media"] for r in media_columns.add_media(docs).collect()}
    assert all(media_columns.from_wav(bytes(made[i]["wav"])) == media_columns.payload(t) and made[i]["time"] == found[i]["times"] and made[i]["code"] == found[i]["codes"] for i, t in enumerate(texts))
    assert media_columns.media_facts(docs.filter("false")).count() == 0


def test_thousands_of_rules_run_few_patterns(spark, monkeypatch):
    rules = [url_filters.prefix_rule(f"host{i}.example", f"/p{i}/", ("allow", "block")[i % 2]) for i in range(10_000)]
    index = url_filters.rarest_token(rules)
    shared = Counter(t for r in rules for t in set(r.tokens))
    assert all(shared[t] == min(shared[x] for x in r.tokens) for r, t in index.items())
    urls = [(i, f"http://a.host{i}.example/p{i}/x") for i in range(0, 10_000, 97)] + [(-1, "http://host5.example/p6/"), (-2, None), (-3, "http://host7.example/p7/"), (-3, "http://host7.example/p7/")]
    pages = spark.createDataFrame(urls, "page_id int, url string")
    found = Counter((r["page_id"], r["rule"], r["verdict"]) for r in url_filters.filter_urls(pages, rules).collect())
    want = [(i, f"host{i}.example/p{i}/", ("allow", "block")[i % 2]) for i in range(0, 10_000, 97)] + [(-1, None, "allow"), (-2, None, "allow")] + [(-3, "host7.example/p7/", "block")] * 2
    assert found == Counter(want)
    ran = []
    monkeypatch.setattr(url_filters.re, "compile", lambda pattern, flags=0, real=re.compile: ran.append(pattern) or real(pattern, flags))
    judged = list(url_filters._judge(rules)(iter([url_filters.pd.Series(["a.host4.example/p4/x", "host9.example/p8/", "none.example/"])])))
    assert judged[0]["name"].tolist()[0] == "host4.example/p4/" and len(ran) <= 4
    assert url_filters.filter_urls(pages.filter("false"), rules).count() == 0
