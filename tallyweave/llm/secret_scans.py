"""Secret scans: fixed patterns, and guess costs of values in credential contexts.

The base patterns find assignments to secret-like names, access key ids and long hexadecimal
runs. The method then looks at every value that follows a credential word (``pwd:``,
``passphrase is`` and so on) and computes the cheapest way to guess it: dynamic programming
over its positions, where each segment is a common word, a date, a repetition, a walk along
a keyboard row or alphabet, or brute force, and costs add up as decimal logarithms. A value
of any length whose cheapest segmentation still costs ``min_cost`` or more is a secret;
``password123`` and ``2024-01-01`` are not. Words are ranked by how often the documents use
them outside such values, so that ordinary prose after a credential word is cheap; a fixed
list of common passwords comes on top.

The ranked words are those used so often that at most ``MAX_WORDS`` are, counted before they
are sent; rarer ones are priced by their parts.

A null text counts as empty and has no spans. Texts of any length are scanned whole; repeated
rows get equal results; other columns pass through.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import checkpointed

KINDS = ("assign", "access", "hex", "guess")
#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16

CONTEXT = re.compile(
    r"""(?:(?<![a-z])|(?<=_))(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|(?:api|access|private|auth)[_-]?key)(?![a-z])["']?\x20{0,3}(?:[:=]>?|\x20is\x20)\x20{0,3}["']?([^\s"'<>,;]+)""",
    re.IGNORECASE | re.ASCII,
)
CONTEXT_WORDS = ("pass", "pwd", "secret", "token", "credential", "key")
MIN_COST = 8.0
MAX_WORDS, LONGEST = 50_000, 32

#: Common passwords and their words, commonest first; the cost of a word is its place.
WORDS = (
    "password 123456 qwerty letmein admin welcome monkey dragon master login abc123 football baseball shadow sunshine princess "
    "iloveyou trustno1 superman batman hello freedom whatever starwars computer michelle jordan hunter soccer harley ranger "
    "secret summer winter spring autumn flower purple orange yellow silver golden cookie banana cheese coffee chocolate test "
    "user guest root demo sample example default changeme change me your my the here value token key pass word none null true "
    "false todo dummy fake foo bar baz temp public private access account server client service database backup system"
).split()
RANK = {w: i + 1 for i, w in reversed(list(enumerate(WORDS)))}
LEET = str.maketrans("@4301$57!", "aaeoissti"[:9])
ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "abcdefghijklmnopqrstuvwxyz")
NEXT = {(a, b) for row in ROWS for a, b in zip(row, row[1:], strict=False)}
NEXT |= {(b, a) for a, b in NEXT}
DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d")


def _symbol_cost(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33)


def corpus_ranks(docs: DataFrame, text: str = "text", most: int = MAX_WORDS) -> dict[str, int]:
    """Places of the words of all texts, commonest first, and of ``WORDS``; the lower place counts.

    A word is a run of 3 to ``LONGEST`` letters that no digit touches. Values in credential
    contexts are left out, lest a secret that is repeated passes for a word.
    """
    said = F.lower(F.when(F.lower(text).rlike("|".join(CONTEXT_WORDS)), F.regexp_replace(text, "(?i)" + CONTEXT.pattern, " ")).otherwise(F.col(text)))
    words = docs.select(F.explode(F.split(said, r"[^\p{L}\p{N}_]+")).alias("word")).filter(F.col("word").rlike(rf"^\p{{L}}{{3,{LONGEST}}}$"))
    counts = checkpointed(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    # the smallest count at which no more than ``most`` words are left
    least, held = None, 0
    for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.col("n").desc()).limit(most).collect():
        held += r["words"]
        if held > most:
            break
        least = r["n"]
    common = [] if least is None else counts.filter(F.col("n") >= least).collect()
    ranks = {r["word"]: i + 1 for i, r in enumerate(sorted(common, key=lambda r: (-r["n"], r["word"])))}
    return ranks | {w: min(i, ranks.get(w, i)) for w, i in RANK.items()}


def _lengths(least: int, most: int) -> Iterable[int]:
    """All lengths, or those near both ends: in the middle of a longer run going on costs less than whatever else could start there."""
    if most - least < 2 * LONGEST:
        return range(least, most + 1)
    return chain(range(least, least + LONGEST), range(most - LONGEST + 1, most + 1))


def guess_cost(value: str, ranks: dict[str, int] = RANK) -> float:
    """The decimal logarithm of the guesses that the cheapest segmentation needs; 0 for ''.

    A walk along a row costs its start and its length, a repetition of one character (three
    times or more) or of a unit of up to six (twice or more) the unit and its number.
    """
    n, low = len(value), value.lower()
    if len(low) != n:  # a letter whose lower case is longer
        low = value
    plain = low.translate(LEET)
    best = [0.0] + [math.inf] * n
    dates: dict[int, list[int]] = {}
    for i in range(n):
        if low[i].isdigit():
            for size in (10, 8, 4):
                if DATE.fullmatch(low, i, i + size) and i + size <= n:
                    dates.setdefault(i, []).append(i + size)
    # how far a walk goes on, and how far the text equals itself ``size`` places later
    walks = [0] * (n + 1)
    for i in range(n - 2, -1, -1):
        walks[i] = walks[i + 1] + 1 if (low[i], low[i + 1]) in NEXT else 0
    repeats = {size: [0] * (n + 1) for size in range(1, 7)}
    for size, same in repeats.items():
        for i in range(n - size - 1, -1, -1):
            same[i] = same[i + 1] + 1 if low[i] == low[i + size] else 0
    for i in range(n):
        here = best[i]
        best[i + 1] = min(best[i + 1], here + _symbol_cost(value[i]))
        for j in range(i + 3, min(n, i + LONGEST) + 1):
            cost = math.inf
            if (rank := ranks.get(low[i:j])) is not None:
                cost = math.log10(rank)
            elif (rank := ranks.get(plain[i:j])) is not None:
                cost = math.log10(rank) + 0.5
            if cost < math.inf:
                cost += 0.3 + (0.5 if value[i:j] != low[i:j] else 0)
                best[j] = min(best[j], here + cost)
        for j in dates.get(i, ()):
            best[j] = min(best[j], here + (math.log10(36525) if j - i > 4 else 2.0))
        for length in _lengths(3, walks[i] + 1):
            best[i + length] = min(best[i + length], here + 1.4 + math.log10(length))
        for size, same in repeats.items():
            if same[i] < size * (2 if size == 1 else 1):
                continue
            unit = sum(map(_symbol_cost, value[i : i + size]))
            for times in _lengths(3 if size == 1 else 2, same[i] // size + 1):
                j = i + size * times
                best[j] = min(best[j], here + unit + math.log10(times))
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, leftmost and non-overlapping within a kind."""
    spans = []
    low = text.lower()
    if any(w in low for w in ("passw", "secret", "token", "api")):
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(spans, key=_order)


def guess_spans(text: str, min_cost: float = MIN_COST, ranks: dict[str, int] = RANK) -> list[tuple[int, int, str]]:
    low = text.lower()
    if not any(w in low for w in CONTEXT_WORDS):
        return []
    return [(m.start(1), m.end(1), "guess") for m in CONTEXT.finditer(text) if guess_cost(m[1], ranks) >= min_cost]


def _order(span: tuple[int, int, str]) -> tuple[int, int]:
    return span[0], KINDS.index(span[2])


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan_secrets(docs: DataFrame, text: str = "text", min_cost: float = MIN_COST) -> DataFrame:
    """``docs`` with ``secrets``: an array of (kind, start, end), by start and then by kind.

    Positions count code points; ``end`` is exclusive. A ``secrets`` column of the input is
    replaced. Words are ranked over all of ``docs``.
    """
    ranks = corpus_ranks(docs, text)

    def find(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            t = t or ""
            spans = sorted(base_spans(t) + guess_spans(t, min_cost, ranks), key=_order)
            out.append([{"kind": k, "start": a, "end": b} for a, b, k in spans])
        return pd.Series(out, dtype=object)

    finder = F.pandas_udf(find, "array<struct<kind:string,start:int,end:int>>")
    return docs.withColumn("secrets", finder(F.col(text)))


def redact(text: str, spans: list[tuple[int, int, str]], mask: str = "[SECRET]") -> str:
    """``text`` with every span, overlapping ones as one, replaced by ``mask``."""
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def digest(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(_joined(spans).encode()).hexdigest()
