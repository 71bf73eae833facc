"""Ranked lexical search: impact-ordered postings, worked off score at a time.

``search`` ranks all documents for each query text. One pass reads every whole text once and keeps, for a
document, its number of terms and the frequencies of those terms that a query holds; Spark adds up the
documents with a term, all terms, and each query term's documents. A second pass is map-only: a task
takes its documents in blocks of at most BLOCK_POSTINGS postings, groups a block's postings by term and
exact impact, and for each query walks the groups in descending order of what they add to a score. It
stops once the bound of what is left proves that no document outside the candidates can be among the
task's best, and then adds up whole scores for the candidates. The task's k-th best score so far goes
along from block to block, so later blocks stop early. Tasks give k rows a query; a window picks the k
best of all.

A null or termless document is in no result and counts for nothing. Rows that repeat a doc_id are
documents of their own; equal scores are ordered by ascending doc_id, a null one last. Queries of equal
text are searched once. A null or termless query, and a query none of whose terms adds to a score, has no
rows; nor has an empty table on either side. Query terms weigh as often as they repeat. What is sent to
tasks is counted first: a pass over the documents takes distinct query texts of some MAX_QUERY_BYTES
bytes, and there are as many passes as that needs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from math import floor, log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm.common import LOWER, UPPER, checkpointed

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Query text sent to a task in one pass.
MAX_QUERY_BYTES = 64_000_000
#: Postings of a block: some 100 MB with their order.
BLOCK_POSTINGS = 1_000_000
#: Groups taken before the first look at the bounds; each look doubles them.
FIRST_GROUPS = 256

_FOLD = str.maketrans(UPPER, LOWER)


def terms_of(text: str | None) -> Counter[str]:
    """The terms of a text, A-Z in lower case, with their numbers."""
    found: Counter[str] = Counter()
    for term, times in Counter(re.findall(TERM, text or "")).items():
        found[term.translate(_FOLD)] += times
    return found


class Postings(NamedTuple):
    """A block: its documents, and postings by term and descending impact, in groups of one term and impact."""

    doc_ids: list[object]
    docs: np.ndarray  # local number of the document, by group
    starts: np.ndarray  # of each group, and the end
    impacts: np.ndarray  # of each group
    first_group: np.ndarray  # of each term, and the end
    rows: np.ndarray  # where each document's postings start, in the order they came in, and the end
    row_terms: np.ndarray
    row_impacts: np.ndarray


def term_counts(docs: DataFrame, ids: dict[str, int], doc_id: str, text: str) -> DataFrame:
    """A row for each document with terms: its id, ``n_terms``, the ``terms`` that queries hold (as numbers, ascending) and their ``times``."""
    sent = docs.sparkSession.sparkContext.broadcast(ids)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = sent.value
        for batch in batches:
            keep, sizes, terms, times = [], [], [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                if found := terms_of(value):
                    known = sorted((numbers[t], n) for t, n in found.items() if t in numbers)
                    keep.append(i)
                    sizes.append(sum(found.values()))
                    terms.append([t for t, _ in known])
                    times.append([n for _, n in known])
            columns = [batch.column(0).take(pa.array(keep, pa.int32())), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_terms", "terms", "times"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(count, f"doc_id {kind}, n_terms long, terms array<int>, times array<int>")


def impacts_of(weights: np.ndarray, terms: np.ndarray, times: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """What one occurrence of a query term adds to a document's score; ``lengths`` is m."""
    return weights[terms] * (1_000_000_000 * times // (1000 * times + 12 * lengths))


def grouped(doc_ids: list[object], rows: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_terms: int) -> Postings:
    """Postings without those of impact 0, grouped by term and exact impact, the highest first."""
    owner = np.repeat(np.arange(len(doc_ids)), np.diff(rows))
    order = np.lexsort((-impacts, terms))
    order = order[impacts[order] > 0]
    by_term, by_impact = terms[order], impacts[order]
    new = np.flatnonzero(np.r_[True, (by_term[1:] != by_term[:-1]) | (by_impact[1:] != by_impact[:-1])]) if len(order) else np.zeros(0, np.int64)
    first = np.searchsorted(by_term[new], np.arange(n_terms + 1))
    return Postings(doc_ids, owner[order], np.r_[new, len(order)], by_impact[new], first, rows, terms, impacts)


def best_of_block(block: Postings, terms: np.ndarray, repeats: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents (local numbers) and whole scores: all that can be among the k best and reach ``least``.

    Groups of postings go in descending order of impact times repeats. A document not seen yet in a term
    gains at most that term's next group, so ``left`` (the sum of the terms' next groups) bounds
    what any document can still gain.
    """
    ends = block.first_group[terms + 1]
    sizes = ends - block.first_group[terms]
    groups = np.concatenate([np.arange(s, e) for s, e in zip(block.first_group[terms], ends, strict=True)]) if len(terms) else np.zeros(0, np.int64)
    of_term = np.repeat(np.arange(len(terms)), sizes)
    gains = block.impacts[groups] * repeats[of_term]
    order = np.argsort(-gains, kind="stable")
    groups, of_term, gains = groups[order], of_term[order], gains[order]
    # a term's next group is its first one after a place; place by place that is what the term may still add
    following = np.zeros(len(gains), np.int64)
    last = np.lexsort((np.arange(len(gains)), of_term))
    same = of_term[last][1:] == of_term[last][:-1]
    following[last[:-1][same]] = gains[last[1:][same]]
    top = np.zeros(len(terms), np.int64)
    np.maximum.at(top, of_term, gains)
    left = top.sum() - np.cumsum(gains - following)  # after each place
    scores = np.zeros(len(block.doc_ids), np.int64)
    counts = block.starts[groups + 1] - block.starts[groups]
    done, step = 0, FIRST_GROUPS
    candidates = np.arange(len(scores))
    while done < len(groups):
        upto = min(len(groups), done + step)
        n, begin = counts[done:upto], block.starts[groups[done:upto]]
        places = np.arange(n.sum()) + np.repeat(begin - np.r_[0, np.cumsum(n)[:-1]], n)
        np.add.at(scores, block.docs[places], np.repeat(gains[done:upto], n))
        done, step = upto, step * 2
        bar = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k])) if len(scores) > k else least
        if left[done - 1] < bar:  # unseen documents are out, and so are all that cannot reach the bar
            candidates = np.flatnonzero(scores + left[done - 1] >= bar)
            break
    if done < len(groups):
        weight = np.zeros(len(block.first_group), np.int64)
        weight[terms] = repeats
        begin, n = block.rows[candidates], block.rows[candidates + 1] - block.rows[candidates]
        places = np.arange(n.sum()) + np.repeat(begin - np.r_[0, np.cumsum(n)[:-1]], n)
        whole = np.zeros(len(candidates), np.int64)
        np.add.at(whole, np.repeat(np.arange(len(candidates)), n), weight[block.row_terms[places]] * block.row_impacts[places])
    else:
        whole = scores[candidates]
    keep = (whole > 0) & (whole >= least)
    return candidates[keep], whole[keep]


class Best:
    """A query's k best so far, equal scores by ascending id, nulls last."""

    def __init__(self, k: int) -> None:
        self.k, self.rows = k, []

    @property
    def least(self) -> int:
        """What a document must reach to matter."""
        return self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, ids: list[object], docs: np.ndarray, scores: np.ndarray) -> None:
        if len(scores) > self.k:  # ties at the edge stay
            at_least = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            docs, scores = docs[scores >= at_least], scores[scores >= at_least]
        self.rows += zip(scores.tolist(), (ids[d] for d in docs), strict=True)
        self.rows.sort(key=lambda r: (-r[0], r[1] is None, r[1] if r[1] is not None else 0))
        del self.rows[self.k :]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, postings = [], 0
    for batch in batches:
        start, ends = 0, np.cumsum(np.diff(batch.column(2).offsets.to_numpy()))
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + BLOCK_POSTINGS - postings, side="right")))
            held.append(batch.slice(start, stop - start))
            postings += int(ends[stop - 1] - before)
            start = stop
            if postings >= BLOCK_POSTINGS or start < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, postings = [], 0
    if held:
        yield pa.Table.from_batches(held)


def searcher(queries: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, documents: int, all_terms: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The task: batches of ``term_counts`` in, (query number, doc_id, score) out."""

    def search_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, kind = [Best(k) for _ in queries], None
        for table in _blocks(batches):
            block_of = table.combine_chunks()
            kind = block_of.column("doc_id").type
            terms, times = block_of.column("terms").chunk(0), block_of.column("times").chunk(0)
            rows = np.r_[0, np.cumsum(np.diff(terms.offsets.to_numpy()))]
            flat, often = terms.flatten().to_numpy().astype(np.int64), times.flatten().to_numpy().astype(np.int64)
            m = 75 + 25 * block_of.column("n_terms").to_numpy() * documents // all_terms
            impacts = impacts_of(weights, flat, often, np.repeat(m, np.diff(rows)))
            block = grouped(block_of.column("doc_id").to_pylist(), rows, flat, impacts, len(weights))
            for (query_terms, repeats), found in zip(queries, best, strict=True):
                found.add(block.doc_ids, *best_of_block(block, query_terms, repeats, k, found.least))
        if kind is not None:
            rows = [(q, d, s) for q, found in enumerate(best) for s, d in found.rows]
            q, d, s = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(d, kind), pa.array(s, pa.int64())], ["query", "doc_id", "score"])

    return search_task


def _passes(texts: DataFrame) -> int:
    size = texts.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    return -(-size // MAX_QUERY_BYTES)


def search(docs: DataFrame, queries: DataFrame, query_id: str = "item_id", query_text: str = "text", doc_id: str = "doc_id", text: str = "text", k: int = 20) -> DataFrame:
    """Each query's k best documents: query id, ``rank``, doc_id, ``score``; only scores above 0."""
    asked = queries.select(F.col(query_id).alias("_query_id"), F.col(query_text).alias("text"), F.sha2(F.col(query_text), 256).alias("_key"))
    texts = checkpointed(asked.select("_key", "text").filter(F.col("text").isNotNull()).distinct())
    passes = _passes(texts)
    found = None
    for turn in range(passes):
        mine = texts.filter(F.pmod(F.xxhash64("_key"), F.lit(passes)) == turn).orderBy("_key").collect()
        part = _search_texts(docs, [(r["_key"], terms_of(r["text"])) for r in mine], doc_id, text, k)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = _search_texts(docs, [], doc_id, text, k)
    place = F.row_number().over(Window.partitionBy("_key").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    ranked = found.withColumn("rank", place).filter(F.col("rank") <= k)
    named = ranked.join(asked.select("_query_id", "_key"), "_key")
    return named.select(F.col("_query_id").alias(query_id), "rank", F.col("doc_id").alias(doc_id), "score")


def _search_texts(docs: DataFrame, texts: list[tuple[str, Counter[str]]], doc_id: str, text: str, k: int) -> DataFrame:
    """(_key, doc_id, score): each task's k best for each text."""
    spark = docs.sparkSession
    ids = {t: i for i, t in enumerate(sorted({t for _, terms in texts for t in terms}))}
    counts = checkpointed(term_counts(docs, ids, doc_id, text))
    total = counts.agg(F.count("*"), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    held = {r["term"]: r["count"] for r in counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}
    weights = np.array([floor(1000 * log((2 * total[0] + 2) / (2 * held[i] + 1))) if i in held else 0 for i in range(len(ids))], np.int64)
    asked = [tuple(np.array(x, np.int64) for x in (sorted(ids[t] for t in terms), [n for _, n in sorted((ids[t], n) for t, n in terms.items())])) for _, terms in texts]
    kind = counts.schema["doc_id"].dataType.simpleString()
    found = counts.mapInArrow(searcher(asked, weights, total[0], max(total[1], 1), k), f"query int, doc_id {kind}, score long")
    keys = spark.createDataFrame([(i, key) for i, (key, _) in enumerate(texts)], "query int, _key string")
    return found.join(F.broadcast(keys), "query").select("_key", "doc_id", "score")
