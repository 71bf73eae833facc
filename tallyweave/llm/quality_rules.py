"""Quality rules as weak supervision: rules vote, their accuracies are estimated, a probability decides.

``text_facts`` counts in whole texts. Each of RULES, a pair of conditions on these counts, votes good or
bad or abstains. ``estimate`` groups the documents by how all rules voted (at most 3 ** rules patterns,
the only thing that reaches the driver) and fits, by expectation-maximisation over all documents, the
share of good documents and each rule's accuracy, how often it is right where it votes; no labels are
used. ``judged`` gives every document the posterior probability of being good, as one built-in
expression, and keeps it from THRESHOLD on. No single rule decides: a document may fail several and stay.

A null, empty or blank text has no words; all rules abstain on it, so it gets the prior probability
(``base_failed`` marks it in the query). Repeated rows are judged alike and count each in the estimate. An empty table
gives no rows and no estimate is needed. New columns replace input columns of the same names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
THRESHOLD = 0.5
#: 3 ** 12 patterns, half a million, are the most that ``estimate`` gathers.
MAX_RULES = 12
FACTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper", "n_shouts", "n_stops", "n_plain")

_WORD, _LETTERS, _STOP = re.compile(WORD), re.compile(r"[^\W\d_]+"), re.compile(r"""[.!?…:;。！？]["'»”’)\]]*\s*$""")
_EDGES = ".,;:!?…'\"()[]«»“”‘’"


def _plain(word: str) -> bool:
    """Letters, none but the first a capital, between marks of a sentence."""
    core = word.strip(_EDGES)
    return core.isalpha() and core[1:] == core[1:].lower()


#: name: (votes good, votes bad); bad goes first, neither abstains. No rule votes on a document without words.
#: A long text, or one free of a defect, is not thereby good, so most rules vote bad or abstain.
RULES: dict[str, tuple[Column | str, Column | str]] = {
    "length": ("false", "n_words < 10"),
    "word_length": ("false", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    "plain_words": ("100 * n_plain >= 90 * n_words", "100 * n_plain < 60 * n_words"),
    "symbols": ("false", "10 * n_symbols > n_words"),
    "letters": ("false", "100 * n_letters < 70 * word_chars"),
    "capitals": ("false", "100 * n_upper > 30 * n_letters"),
    "shouts": ("false", "10 * n_shouts > n_words"),
    "repeated_lines": ("false", "10 * n_dup_lines > 3 * n_lines"),
    "repeated_words": ("false", "100 * n_repeat_words > 20 * n_words"),
    "stops": ("false", "n_lines >= 3 and 10 * n_stops < 3 * n_lines"),
}


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words inside any window of so many consecutive words that is found twice or more."""
    if len(words) < window:
        return 0
    numbers: dict[str, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    at, size = ids, 1
    while size < window:  # windows of one size, numbered, joined to those of twice that size or less
        step = min(size, window - size)
        at = np.unique(at[: len(at) - step] * len(words) + at[step:], return_inverse=True)[1]
        size += step
    again = np.bincount(at)[at] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, np.flatnonzero(again), 1)
    np.add.at(edges, np.flatnonzero(again) + window, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def facts_of(text: str) -> tuple[int, ...]:
    """FACTS of one whole text."""
    words = _WORD.findall(text)
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    return (
        len(words),
        sum(map(len, words)),
        sum(text.count(c) for c in SYMBOLS),
        len(lines),
        len(lines) - len(Counter(lines)),
        repeated_words(words),
        len(text) - len(_LETTERS.sub("", text)),
        sum(map(str.isupper, text)),
        text.count("!"),
        sum(bool(_STOP.search(line)) for line in lines),
        sum(map(_plain, words)),
    )


def text_facts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id and FACTS."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            facts = [facts_of(value or "") for value in batch.column(1).to_pylist()]
            columns = [pa.array([f[i] for f in facts], pa.int64()) for i in range(len(FACTS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["_id", *FACTS])

    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    found = rows.mapInArrow(count, ", ".join([f"_id {kind}", *(f"{f} long" for f in FACTS)]))
    return found.select(F.col("_id").alias(doc_id), *FACTS)


def votes(rules: dict[str, tuple[Column | str, Column | str]]) -> Column:
    """An array of one vote a rule, in order: 1 good, -1 bad, 0 abstains."""
    said = lambda c: F.expr(c) if isinstance(c, str) else c
    cast = [F.when(F.coalesce(F.col("n_words"), F.lit(0)) == 0, 0).when(said(bad), -1).when(said(good), 1).otherwise(0) for good, bad in rules.values()]
    return F.array(*(v.cast("byte") for v in cast))


class Estimate(NamedTuple):
    """The share of good documents, and of each rule how often it is right where it votes."""

    good: float
    accuracies: np.ndarray


#: Right and wrong votes that each rule and the share of good documents start with, before any data.
BELIEF = (8.0, 2.0)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, most_rounds: int = 1000, still: float = 1e-9) -> Estimate:
    """From vote patterns (a row each, entries -1, 0, 1) and how many documents have each.

    Given the class, rules vote independently and are right at rates of their own; whether a rule votes says nothing.
    Starts from the share of good votes and ends when no probability moves by more than ``still``. A rule
    is never taken to be worse than chance, so the classes cannot change places.
    """
    right, wrong = BELIEF
    good = 0.5 + 0.4 * patterns.sum(axis=1) / np.maximum((patterns != 0).sum(axis=1), 1)
    for _ in range(most_rounds):
        agree = counts @ (np.where(patterns == 1, good[:, None], 0) + np.where(patterns == -1, 1 - good[:, None], 0))
        accuracies = np.maximum((agree + right) / (counts @ (patterns != 0) + right + wrong), 0.5)
        estimate = Estimate(float((counts @ good + right) / (counts.sum() + right + wrong)), accuracies)
        before, good = good, posterior(estimate, patterns)
        if np.abs(good - before).max(initial=0) <= still:
            break
    return estimate


def _odds(rate: np.ndarray | float) -> np.ndarray | float:
    return np.log(rate / (1 - rate))


def posterior(estimate: Estimate, patterns: np.ndarray) -> np.ndarray:
    """Of each pattern, the probability of being good."""
    return 1 / (1 + np.exp(-_odds(estimate.good) - patterns @ _odds(estimate.accuracies)))


def estimate(facts: DataFrame, rules: dict[str, tuple[Column | str, Column | str]] = RULES) -> Estimate:
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    # rows come back in no order, and sums of doubles depend on it
    rows = sorted((r["votes"], r["count"]) for r in facts.groupBy(votes(rules).alias("votes")).count().collect())
    patterns = np.array([v for v, _ in rows], np.int64).reshape(-1, len(rules))
    return expectation_maximisation(patterns, np.array([n for _, n in rows], float))


def judged(facts: DataFrame, fitted: Estimate, rules: dict[str, tuple[Column | str, Column | str]] = RULES) -> DataFrame:
    """``facts`` with ``votes`` and ``probability``, that of being good."""
    total = F.lit(float(_odds(fitted.good)))
    for i, weight in enumerate(_odds(fitted.accuracies).tolist()):
        total = total + F.get("votes", F.lit(i)) * F.lit(weight)
    return facts.withColumn("votes", votes(rules)).withColumn("probability", 1 / (1 + F.exp(-total)))


def keep_good(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are good with the threshold's probability; all columns pass through."""
    facts = text_facts(docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_text")), "_row", "_text")
    kept = judged(facts, estimate(facts)).filter(F.col("probability") >= threshold)
    return kept.select("_row.*")
