"""The other operators against brute force, SQL, round trips and held-out labels."""

import hashlib
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from oracle import assert_same  # noqa: E402

from tallyweave.llm import decontamination, html_extraction, language_id, media_columns, queries, secret_scans, sharding, source_mixing, url_filters  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf, name):
    assert_same(queries.QUERIES[name](spark, sf), queries.ORACLES[name], sf)


def test_joined_url_rules_judge_like_sent_ones(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    odd = spark.createDataFrame([(-1, None), (-2, "no scheme"), (-3, "http://A.Example.ORG/es/x?y"), (-4, "http://casino.example.net")], pages.schema)
    pages = pages.union(odd)
    judge = lambda k: sorted(map(tuple, url_filters.filter_urls(pages, url_filters.default_rules(), max_sent_rules=k).select("page_id", "host", "path", "rule", "verdict").collect()))
    assert judge(0) == judge(1000)
    by_id = {r[0]: r[1:] for r in judge(1000)}
    assert by_id[-1] == ("", "", None, "allow") and by_id[-3] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert by_id[-4] == ("casino.example.net", "", None, "block")


def test_base_secrets_equal_plain_patterns(spark, sf):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    assign = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for r in queries.op2_secret_scans(spark, sf).collect():
        text, spans = docs[r["doc_id"]], []
        for order, (kind, pattern, least) in enumerate((("assign", assign, 12), ("access", re.compile("AKIA[A-Z0-9]+"), 18), ("hex", re.compile("[0-9a-f]+"), 16))):
            spans += [(m.start(), order, f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(text) if len(m[2] if order == 0 else m[0]) >= least]
        joined = ",".join(s for _, _, s in sorted(spans))
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))


def test_guess_costs():
    cost = secret_scans.guess_cost
    assert cost("") == 0 and cost("password") < 1.5 and cost("password123456") < 3 and cost("aaaaaaaaaaaa") < 3.5
    assert cost("qwertyuiop") < 3.5 and cost("2024-01-01") < 5 and cost("x9$Kq2!vLm7@") > secret_scans.MIN_COST
    assert secret_scans.redact("pwd: abc", [(5, 8, "guess")]) == "pwd: [SECRET]"


def _cheapest(value, ranks, memo):
    """All segmentations tried, segment costs worked out anew."""
    import math

    if value not in memo:
        low, plain = value.lower(), value.lower().translate(secret_scans.LEET)
        symbol = lambda c: math.log10(10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33)
        costs = [0.0] if not value else []
        for j in range(1, len(value) + 1):
            part, options = low[:j], [symbol(value[0])] if j == 1 else []
            upper = 0.5 * (value[:j] != part)
            if j >= 3:
                if part in ranks:
                    options.append(math.log10(ranks[part]) + 0.3 + upper)
                elif plain[:j] in ranks:
                    options.append(math.log10(ranks[plain[:j]]) + 0.8 + upper)
                if all(p in secret_scans.NEXT for p in zip(part, part[1:])):
                    options.append(1.4 + math.log10(j))
                if len(set(part)) == 1:
                    options.append(symbol(value[0]) + math.log10(j))
            if j in (4, 8, 10) and secret_scans.DATE.fullmatch(part):
                options.append(math.log10(36525) if j > 4 else 2.0)
            for unit in range(2, 7):
                if j >= 2 * unit and j % unit == 0 and part == part[:unit] * (j // unit):
                    options.append(sum(map(symbol, value[:unit])) + math.log10(j // unit))
            if options:
                costs.append(min(options) + _cheapest(value[j:], ranks, memo))
        memo[value] = min(costs)
    return memo[value]


def test_guess_cost_is_the_least_over_all_segmentations():
    import random

    rng, memo = random.Random(11), {}
    values = ["zxcvbnmonkey", "aaaadmin", "aaabaaab", "20240101", "Passw0rd", "abcabcabc", "qwerty12"]
    values += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(9))) for alphabet in ("ab", "abc1", "qwe12", "asdmin", "paswordA0") for _ in range(150)]
    for value in values:
        assert abs(secret_scans.guess_cost(value) - _cheapest(value, secret_scans.RANK, memo)) < 1e-9, value
    assert secret_scans.guess_cost("a" * 20_000 + "admin") < 10


def test_guesses_in_prose_and_short_values(spark):
    prose = "An understanding of what is required comes from reading what others wrote."
    texts = [prose, "the password is required", "token: understanding", "pwd: aB3$xY9", "pwd: qmzjxvkwpdhr", "pwd: qmzjxvkwpdhr", "secret: abc", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = {r["doc_id"]: [(s["kind"], texts[r["doc_id"]][s["start"] : s["end"]]) for s in r["secrets"] if s["kind"] == "guess"] for r in secret_scans.scan_secrets(docs).collect()}
    assert found == {i: [] for i in range(8)} | {3: [("guess", "aB3$xY9")], 4: [("guess", "qmzjxvkwpdhr")], 5: [("guess", "qmzjxvkwpdhr")]}
    ranks = secret_scans.corpus_ranks(docs, most=5)
    assert ranks["what"] == 1 and ranks["password"] == 1 and "understanding" not in ranks and "qmzjxvkwpdhr" not in ranks


def test_mix_comes_near_targets(spark):
    rows = queries.op3_source_mixing(spark, SF).collect()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    total, goals = sum(r["size"] for r in rows), {}
    taken = defaultdict(int)
    for r in rows:
        goals[(r["source_size"], r["target"])] = r["target"]
        taken[(r["source_size"], r["target"])] += r["taken"]
    assert abs(sum(goals.values()) - 1.5 * total) < 1
    assert abs(sum(taken.values()) / sum(goals.values()) - 1) < 0.1


def test_shards(spark):
    rows = queries.op5_sharding(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    sizes, slots = Counter(), defaultdict(list)
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == (0 if texts[r["doc_id"]] is None else len(data)) + 1 and r["text_crc32"] == zlib.crc32(data)
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert sorted(sizes) == list(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in rows)
    order = [r["shard"] for r in sorted(rows, key=lambda r: r["doc_id"])]
    assert order == sorted(order)


def test_language_and_quality_on_held_out_rows(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = [r for r in queries.op6_language_id(spark, SF).collect() if r["held_out"] and docs[r["doc_id"]]["lang"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in found) >= 0.97 * len(found)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    found = [r for r in queries.op8_quality_classifier(spark, SF).collect() if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in found) >= 0.93 * len(found)
    assert all(0 <= r["score"] <= 1 for r in found)


@pytest.mark.parametrize("text", [None, "", "a", "é" * 32, "word " * 5000])
def test_wav_round_trip(text):
    want = media_columns.payload(text)
    assert len(want) % 64 == 0 and len(want) > 0
    assert media_columns.from_wav(media_columns.to_wav(want)) == want
    times, codes = media_columns.fingerprints(want)
    assert len(times) == len(codes) and sorted(times) == list(times)


def test_main_text(spark):
    page = "<html><body><nav><a>Home</a></nav><div class='main'><h1>T &amp; {i}</h1><p>Body  text {i}\n here.</p></div><footer>F</footer><script>x</script></body></html>"
    rows = [(i, f"http://h.example/{i}", page.replace("{i}", str(i)), "clash") for i in range(6)] + [(9, "http://h.example/9", None, "clash"), (10, None, "", "clash")]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string, host string")
    found = {r["page_id"]: r["text"] for r in html_extraction.extract(pages).collect()}
    assert found == {i: f"T & {i}\nBody text {i} here." for i in range(6)} | {9: "", 10: ""}


def _main_texts(spark, pages):
    rows = [(i, f"http://h.example/{i}", f"<html><body>{page}</body></html>") for i, page in enumerate(pages)]
    found = html_extraction.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()
    return [r["text"] for r in sorted(found, key=lambda r: r["page_id"])]


def test_whole_classes_choose_the_text_beside_and_inside_articles(spark):
    lead = "<div class='zone'>{i} leads</div>"
    pages = [f"{lead.replace('{i}', str(i))}<p>House style</p><article><h1>Title {i}</h1><p>Story {i}</p><p>Tell a friend</p></article>" for i in range(12)]
    assert _main_texts(spark, pages) == [f"{i} leads\nTitle {i}\nStory {i}" for i in range(12)]
    # a text of half of the pages is template only where elements come and go with it
    loose = [f"<div class='a'>Story {i}</div><div class='b'>{'Even' if i % 2 == 0 else f'Odd {i}'}</div>" for i in range(12)]
    assert _main_texts(spark, loose)[:2] == ["Story 0\nEven", "Story 1\nOdd 1"]
    tied = [f"<div class='a'>Story {i}</div>" + "<div class='c'>Even</div>" * (i % 2 == 0) for i in range(12)]
    assert _main_texts(spark, tied)[:2] == ["Story 0", "Story 1"]
    # out of order or across two slots of a larger class, a class is not valid
    counts = html_extraction.read_page("<div class='a'>x</div><div class='b'>y</div>")[0]
    tokens = lambda *names: [{"token": t, "seat": i, "chars": 1, "marked": 0} for i, t in enumerate(names)]
    made = lambda pages, *names: {"pages": pages, "once": True, "tokens": tokens(*names)}
    assert html_extraction.valid_classes(counts, [made(4, "div.a", "div.b")]) and not html_extraction.valid_classes(counts, [made(4, "div.b", "div.a")])
    three = html_extraction.read_page("<div class='b'>y</div><div class='a'>x</div><div class='c'>z</div>")[0]
    assert [c["pages"] for c in html_extraction.valid_classes(three, [made(9, "div.a"), made(4, "div.b", "div.c")])] == [9]


def test_main_text_of_copies_sections_and_closed_graphics(spark):
    page = "<div class='lead'>A lead.</div><div class='story'>A longer story.</div>"
    assert _main_texts(spark, [page, page, "<div class='lead'>Other</div>"])[:2] == ["A lead.\nA longer story."] * 2
    near = [f"<div class='story'><p>One long common part.</p><p>{i}</p></div>" for i in range(3)]
    assert _main_texts(spark, near) == [f"One long common part.\n{i}" for i in range(3)]
    drawn = "<p>Before</p><svg viewBox='0 0 1 1'/><p>Between</p><math a='>'/><p>After</p><svg><text>no</text></svg><p>End</p>"
    assert html_extraction.main_text(drawn, None) == "Before\nBetween\nAfter\nEnd"


def test_shards_equal_one_running_sum(spark):
    rows = spark.createDataFrame([(k if k % 9 else None, 1 + (k * 37) % 50, k % 4) for k in range(400)] * 2, "doc_id long, size long, text_crc32 long")
    order = sorted(((k is None, k or 0, c, n) for k, n, c in rows.collect()))
    total, before, want, slots = sum(r[3] for r in order), 0, [], Counter()
    for none, k, c, n in order:
        shard = min(6, (2 * before + n) * 7 // (2 * total))
        want.append((none, k, c, n, shard, slots[shard]))
        slots[shard] += 1
        before += n
    found = [(r["doc_id"] is None, r["doc_id"] or 0, r["text_crc32"], r["size"], r["shard"], r["slot"]) for r in sharding.shard_by_bytes(rows, 7).collect()]
    assert sorted(found) == sorted(want)


def test_mixed_documents_keep_all_columns(spark):
    rows = [(i, "w " * (i % 5), "ab"[i % 2], "t", i, 1) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string, target string, copies int, source_size int")
    mixed = source_mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    taken = Counter(map(tuple, mixed.collect()))
    assert set(taken) <= set(rows) and max(taken.values()) <= 2 and sum(r[1].count("w") * n for r, n in taken.items()) > sum(r[1].count("w") for r in rows)


def test_languages_with_short_texts_only_are_learnt(spark):
    long = "the house of the rising sun is a song about a house in a town far away from here"
    rows = [(i, f"{long} {i}", "en") for i in range(40)] + [(100 + i, ("bonjour le monde", "salut les amis", "merci beaucoup")[i % 3], "fr") for i in range(30)] + [(200, None, "de"), (201, "", "de")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    content = language_id.dictionaries(language_id.sample_texts(docs))
    assert set(content) == {"en", "fr"} and all(w in content["fr"] for w in (b"bonjour", b"salut", b"merci"))
    judge = language_id.Classifier(content)
    assert judge.predict("bonjour les amis")[0] == "fr" and judge.predict("a song about the sun")[0] == "en"
    parts = language_id._equal_parts(["a" * 100] * 10 + ["b"], 111)
    assert len(parts) == 11 and parts[-1] == "b" and {len(p) for p in parts[:-1]} <= {9, 10}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, size long, text_crc32 long, target string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert source_mixing.mix(docs).count() == 0
    assert sharding.shard_by_bytes(docs, 4).count() == 0
    assert decontamination.leak_report(docs, bench).count() == 0
    assert secret_scans.scan_secrets(docs).count() == 0
    assert language_id.identify(docs.select("doc_id", "text"), {}).count() == 0
    some = spark.createDataFrame([(1, "a b c"), (2, None), (2, None)], "doc_id long, text string")
    report = decontamination.leak_report(some, bench).collect()
    assert len(report) == 3 and not any(r["contaminated"] for r in report)


def test_pipeline_keeps_clean_rows_and_shards_gaplessly(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.keep_clean(spark, docs, sf)
    dirty = {r["doc_id"] for r in queries.op4_decontamination(spark, sf).filter("contaminated").collect()}
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()} - dirty
    rows = corpus_pipeline.run(spark, sf).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert rows and all(sorted(s) == list(range(len(s))) for s in slots.values())
