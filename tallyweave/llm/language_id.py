"""Language identification by compression.

For each language a bounded sample of labelled texts becomes a raw-content zstandard
dictionary. A text is lower-cased, runs of anything but letters become blanks, and it is cut
into blocks of ``BLOCK`` bytes, short enough that the dictionary matters in each. Every block
is compressed with every dictionary, and the language with the smallest sum wins. A narrow
margin between the two smallest sums is reported as a rejection, beside the best guess.

The sample (``docs_per_lang`` texts of ``chars_per_doc`` characters, picked by hash order, those
of ``LONG_ENOUGH`` characters first) is a documented bound on what the driver gathers. A
dictionary holds at most ``DICT_BYTES``, equal parts of all texts of the sample; predictions
cover whole texts. Rows may repeat; a column ``language`` is replaced. A null text or
one without a letter is ``und`` with score 0, as is everything when nothing is labelled. Equal
sums go to the language with more labelled rows, then to the smaller name. The label
columns are never read for a prediction.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
#: What is no letter says nothing about the language.
NO_LETTERS = re.compile(r"[\W\d_]+")
BLOCK, LEVEL, DICT_BYTES = 256, 9, 48_000
DOCS_PER_LANG, CHARS_PER_DOC, BUCKETS = 256, 1500, 32
#: Characters of a text that is preferred in the sample.
LONG_ENOUGH = 40
#: Bytes of lead that make the winner e times as likely; margin below which a text is rejected.
SCALE, MIN_MARGIN = 4.0, 0.01


def sample_texts(labelled: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", docs_per_lang: int = DOCS_PER_LANG, chars_per_doc: int = CHARS_PER_DOC) -> list:
    """At most ``docs_per_lang`` rows (lang, text, rows) a language, the first by hash of the key.

    The hash also deals each language into buckets that are cut separately, so no task holds
    all rows of one language; Spark cuts each task's share before the shuffle. ``rows``
    counts all labelled rows of the language.
    """
    each = max(1, docs_per_lang // BUCKETS)
    rows = labelled.filter(F.col(lang).isNotNull() & (F.length(text) > 0))
    rows = rows.select(F.col(lang).alias("lang"), F.substring(text, 1, chars_per_doc).alias("text"), F.xxhash64(key, F.lit("sample")).alias("_place"))
    bucket = F.pmod(F.col("_place"), F.lit(BUCKETS))
    # texts of some length teach more; shorter ones fill up where a language has too few of them
    first = Window.partitionBy("lang", bucket).orderBy(F.length("text") < LONG_ENOUGH, "_place", "text")
    kept = rows.withColumn("_nth", F.row_number().over(first)).filter(F.col("_nth") <= each)
    counts = labelled.groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("rows"))
    return kept.join(counts, "lang").orderBy("lang", "_place", "text").select("lang", "text", "rows").collect()


def dictionaries(rows: list, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """One raw-content dictionary per language, of equal size bounds, commonest languages first."""
    texts: dict[str, list[str]] = {}
    for r in rows:
        texts.setdefault(r["lang"], []).append(letters(r["text"]))
    common = {r["lang"]: r["rows"] for r in rows}
    order = sorted(texts, key=lambda k: (-common[k], k))
    return {k: " ".join(_equal_parts(texts[k], dict_bytes)).encode("utf-8", "surrogatepass")[:dict_bytes] for k in order}


def _equal_parts(texts: list[str], most: int) -> list[str]:
    """All texts, cut to equal lengths so that together they fill ``most`` bytes; what short ones leave goes to the others."""
    sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
    left, share = most, {}
    for nth, i in enumerate(sorted(range(len(texts)), key=sizes.__getitem__)):
        share[i] = min(sizes[i], left // (len(texts) - nth))
        left -= share[i] + 1  # and the blank between two texts
    return [t[: max(1, len(t) * share[i] // max(1, sizes[i]))] for i, t in enumerate(texts)]


def letters(text: str) -> str:
    return NO_LETTERS.sub(" ", text.lower())


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class Classifier:
    """Compressed sizes of a text under each dictionary; built once in each worker."""

    def __init__(self, content: dict[str, bytes]):
        self.langs = list(content)
        self.packers = []
        for data in content.values():
            held = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            self.packers.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: str) -> list[int]:
        data = letters(text).encode("utf-8", "surrogatepass")
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        return [sum(len(p.compress(b)) for b in blocks) for p in self.packers]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the margin is too narrow."""
        if not self.langs or text is None or not has_letter(text):
            return UNKNOWN, 0.0, True
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        score = 1 / sum(math.exp(max(-50.0, (sizes[best] - s) / SCALE)) for s in sizes)
        second = min((s for i, s in enumerate(sizes) if i != best), default=2 * sizes[best])
        return self.langs[best], score, second - sizes[best] < MIN_MARGIN * second


def identify(docs: DataFrame, content: dict[str, bytes], text: str = "text") -> DataFrame:
    """``docs`` with ``language``: a struct of lang, score and rejected."""

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        judge = Classifier(content)
        for texts in batches:
            yield pd.DataFrame([judge.predict(t) for t in texts], columns=["lang", "score", "rejected"])

    return docs.withColumn("language", F.pandas_udf(predict, "lang string, score double, rejected boolean")(F.col(text)))


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; null keys as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(folds))
