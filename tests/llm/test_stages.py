"""Every stage of the pipeline, and operators 8 and 9, on empty tables and on odd rows; two stages against brute force."""

import sys
from collections import Counter, defaultdict
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import corpus_pipeline  # noqa: E402

from tallyweave.llm import html_extraction, quality_classifier, source_mixing  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, shard string, target string, _score string"
CLEAN = "The committee met on Tuesday and agreed that the bridge should be repaired before winter comes to the valley."
NOISE = "BUY!! NOW!! $$$ ### CLICK!! | | | %%% &&& FREE!! *** WIN!! $$$ ### !!! ||| BUY!! NOW!! $$$ CLICK!!"
LEAK = "what is the name of the river that flows through the old town"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(40)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, LEAK), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def _odd(spark):
    rows = [(i, f"{CLEAN} Note {i} says that street {chr(97 + i % 26)} {i * 7} stays open." if i % 2 == 0 else f"{NOISE} {i}", "en", "ab"[i % 2], 5) for i in range(40)]
    rows += [(40, None, None, None, None), (41, "", "en", "a", 0), (42, f"{CLEAN} {LEAK} indeed", "en", "a", 1), (43, CLEAN + " More words follow here " * 30_000, "en", "b", 9), (44, rows[2][1], "fr", "b", 5), (None, f"{CLEAN} No name.", "en", "a", 5)]
    rows += [rows[4], rows[4]]
    return spark.createDataFrame([(*r, "s", "t", "u", "v") for r in rows], DOCS), rows


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_on_empty_tables_and_odd_rows(spark, folder, name, stage):
    docs, rows = _odd(spark)
    assert stage(spark, docs.filter("false"), folder).count() == 0
    found = stage(spark, docs, folder)
    got = Counter((r["doc_id"]) for r in found.collect())
    every = Counter(r[0] for r in rows)
    if name != "sharding":
        assert found.columns == docs.columns
        assert {tuple(r) for r in found.collect()} <= {tuple(r) for r in docs.collect()}
    if name == "quality_classifier":
        assert all(got[i] == every[i] for i in (*range(0, 40, 2), 42, 44)) and not any(got[i] for i in range(1, 40, 2))
    elif name == "jaccard_join":
        assert 40 in got and 41 in got and got[4] == 1 and got[2] == 1 and got[44] == 0
    elif name == "decontamination":
        assert got == every - Counter([42])
    elif name == "source_mixing":
        assert set(got) <= set(every) and max(got[i] for i in range(40) if i != 4) <= 2
    else:
        assert got == every


def test_quality_stage_keeps_what_plain_scores_keep(spark, folder):
    docs, rows = _odd(spark)
    sample = quality_classifier.labelled_sample(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scored = {r["doc_id"]: r["p"] for r in quality_classifier.score(docs, quality_classifier.fit(sample), into="p").collect()}
    kept = Counter(r["doc_id"] for r in corpus_pipeline.keep_quality(spark, docs, folder).collect())
    assert kept == Counter(r[0] for r in rows if scored[r[0]] >= quality_classifier.CUT_SCORE)


def test_mixing_stage_equals_rates_worked_out_plainly(spark, folder):
    import hashlib

    docs, rows = _odd(spark)
    words = lambda t: len((t or "").split())
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += words(r[1])
    sources = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    aim, open_, left = {}, set(sources), 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if 2 * sizes[s] < level * weight[s]]
        for s in full or open_:
            aim[s] = min(2 * sizes[s], level * weight[s])
        left -= sum(aim[s] for s in full or open_)
        open_ -= set(full or open_)
    want = Counter()
    for r in rows:
        rate = aim[r[3]] / sizes[r[3]] if sizes[r[3]] else 0
        place = int(hashlib.md5(f"mix:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16) / 4294967296
        want[r[0]] += int(rate) + (place < rate - int(rate))
    assert Counter(r["doc_id"] for r in corpus_pipeline.mix_sources(spark, docs, folder).collect()) == +want
    assert source_mixing.mixed_documents(docs.filter("false")).count() == 0


def test_extraction_of_empty_repeated_and_long_pages(spark):
    schema = "page_id int, url string, html string, text string, _host string"
    assert html_extraction.extract(spark.createDataFrame([], schema)).count() == 0
    long = "<p>" + "word " * 50_000 + "</p>"
    rows = [(1, "http://a.x/1", long, "t", "h"), (2, None, None, "t", "h"), (3, "http://a.x/1", "", "t", "h"), (4, "http://b.x/", "<p>A &amp; B</p><script>x", "t", "h"), (4, "http://b.x/", "<p>A &amp; B</p><script>x", "t", "h")]
    found = sorted((r["page_id"], r["text"]) for r in html_extraction.extract(spark.createDataFrame(rows, schema)).collect())
    assert found == [(1, ("word " * 50_000).strip()), (2, ""), (3, ""), (4, "A & B"), (4, "A & B")]
