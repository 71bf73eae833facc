"""Folding, cutting and comparing account names and codes."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tallyweave.functions import vocabulary as V

#: Full-width forms and their plain ones, by rule: U+FF01 to U+FF5E lie 0xFEE0 above ASCII.
WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)) + "　"
NARROW = "".join(map(chr, range(0x21, 0x7F))) + " "


@F.pandas_udf(StringType())
def nfkc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode compatibility folding, which has no built-in; only non-ASCII texts do any work."""
    for batch in texts:
        yield batch.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def fold_width(text: Column) -> Column:
    """The part of compatibility folding that built-ins can do: full-width letters, digits and signs."""
    return F.translate(text, WIDE, NARROW)


def normalize_name(name: Column, folded: bool = False) -> Column:
    """Lower case without white space and punctuation; null is ''. ``folded``: NFKC was applied before."""
    text = F.coalesce(name, F.lit(""))
    text = F.lower(F.trim(text if folded else fold_width(text)))
    return F.translate(F.regexp_replace(text, r"[\s 　]+", ""), V.NAME_PUNCTUATION, "")


def normalize_code(code: Column) -> Column:
    """Digits of a whole number, or the text without separators in lower case; null is ''."""
    text = F.regexp_replace(fold_width(F.coalesce(code.cast("string"), F.lit(""))), r"\s+", "")
    number = F.translate(text, ",，", "")
    digits = F.regexp_extract(number, r"^\+?(\d+)(?:\.0+)?$", 1)
    return F.when(digits != "", digits).otherwise(F.lower(F.regexp_replace(text, r"[\s_\-—–./\\:：;；,，|·．、]+", "")))


def without_display_prefix(folded: Column) -> Column:
    """A normalised name without the chart's display prefixes."""
    return F.regexp_replace(folded, f"^({'|'.join(V.DISPLAY_PREFIXES)})+", "")


def canonical_name(name: Column) -> Column:
    return without_display_prefix(normalize_name(name))


def node_text(text: Column) -> Column:
    """Trimmed, inner white space as one blank, upper case; null is ''."""
    return F.upper(F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s　]+", " ")), " +", " "))


def tokens(name: Column) -> Column:
    """The parts of a name between separators."""
    return F.filter(F.split(fold_width(F.coalesce(name, F.lit(""))), V.TOKEN_SEPARATORS), lambda t: t != "")


def _any_in(words: tuple[str, ...], text: Column) -> Column:
    return F.coalesce(text.rlike("|".join(words)), F.lit(False)) if words else F.lit(False)


def contains_any(text: Column, words: tuple[str, ...] | list[str]) -> Column:
    """Whether any of the words, none of which has regular-expression signs, is in the text."""
    return _any_in(tuple(words), text)


def _words(words: tuple[str, ...] | list[str]) -> str:
    """An array of texts without quotes, as SQL: one call for a whole table, where a column each takes thousands."""
    return f"array({', '.join(f"'{w}'" for w in words)})"


def _table(rows: list[dict[str, str]]) -> Column:
    return F.expr(f"array({', '.join('struct(' + ', '.join(f'{v} as `{k}`' for k, v in r.items()) + ')' for r in rows)})")


def _first(found: Column) -> Column:
    return F.get(found, F.lit(0))


def name_anchor(name: Column) -> Column:
    """The first anchor, in order of precedence, that is part of the name."""
    return _first(F.filter(F.expr(_words(V.NAME_ANCHORS)), lambda a: F.contains(name, a)))


def is_reserve(name: Column) -> Column:
    return contains_any(canonical_name(name), V.RESERVE_WORDS)


def semantic_group(whole: Column, words: Column) -> Column:
    """The semantic group of a client name, or null: research direction, then root, then spellings.

    ``whole`` is the normalised name and ``words`` are its normalised parts; both are used many
    times, so they should be columns and not expressions.
    """
    first = F.coalesce(F.get(words, F.lit(0)), F.lit(""))
    found = F.when(whole == "", F.lit(None).cast("string"))
    found = found.when((first == "研发支出") & F.contains(whole, F.lit("费用化支出")), "rd_expensed_development")
    found = found.when((first == "研发支出") & F.contains(whole, F.lit("资本化支出")), "rd_capitalized_development")
    found = found.when(first == "投资收益", "investment_income").when(first == "其他收益", "other_income")
    for group, root in V.ROOT_GROUPS:
        found = found.when(F.contains(first, F.lit(root)), group)
    # a table walked in order: as one CASE the spellings outgrow what Spark can compile
    spelled = _table([{"group": f"'{g}'", "of": _words(s)} for g, s, _, _ in V.SEMANTIC_GROUPS])
    hit = F.filter(spelled, lambda g: F.arrays_overlap(words, g["of"]) | F.exists(g["of"], lambda s: F.startswith(whole, s)))
    return found.otherwise(_first(hit)["group"])


def groups_of_standard(canonical: Column) -> Column:
    """The groups of which a chart name has a spelling and nothing that conflicts."""
    table = _table([{"group": f"'{g}'", "of": _words(own), "against": _words(against or [""])} for g, _, own, against in V.SEMANTIC_GROUPS])
    has = lambda words: F.exists(words, lambda w: (w != "") & F.contains(canonical, w))
    return F.filter(table, lambda g: has(g["of"]) & ~has(g["against"]))["group"]


def groups_against_standard(canonical: Column) -> Column:
    """The groups that a chart name conflicts with."""
    table = _table([{"group": f"'{g}'", "against": _words(against)} for g, _, _, against in V.SEMANTIC_GROUPS if against])
    return F.filter(table, lambda g: F.exists(g["against"], lambda w: F.contains(canonical, w)))["group"]


def class_anchor(folded_code: Column) -> Column:
    """The name that stands for the class of a code, by the longest known prefix; the code is worked out once."""
    table = F.expr(f"map({', '.join(f"'{p}', '{a}'" for p, a in V.CODE_ANCHORS.items())})")
    sizes = sorted({len(p) for p in V.CODE_ANCHORS}, reverse=True)
    longest = lambda code: F.coalesce(*(F.try_element_at(table, F.substring(code, F.lit(1), F.lit(n))) for n in sizes))
    return _first(F.transform(F.array(folded_code), longest))


def opposite(one: Column, other: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    """Whether the names hold the two words of a pair, in either order."""
    found = F.lit(False)
    for a, b in pairs:
        found = found | (F.contains(one, F.lit(a)) & F.contains(other, F.lit(b))) | (F.contains(one, F.lit(b)) & F.contains(other, F.lit(a)))
    return F.coalesce(found, F.lit(False))


def category_of_name(name: Column) -> Column:
    found = F.lit(None).cast("string")
    for category, words in reversed(V.CATEGORY_WORDS):
        found = F.when(contains_any(name, words), category).otherwise(found)
    return found


def category_of_code(code: Column) -> Column:
    """Category by the longest known prefix; contra accounts by their first digit."""
    contra = F.when(code.rlike("^[15]"), "contra_asset").when(code.startswith("2"), "contra_liability").when(code.startswith("4"), "contra_equity")
    found = F.when(code.isin(*V.CONTRA_CODES), contra.otherwise("unknown"))
    for prefix in sorted(V.CODE_CATEGORIES, key=lambda p: (-len(p), p)):
        found = found.when(code.startswith(prefix), V.CODE_CATEGORIES[prefix])
    return found.otherwise("unknown")


def is_auxiliary(name: Column, strict: bool = True) -> Column:
    """Names of auxiliary objects: bracketed, or led by an object type and a colon."""
    kinds = V.AUXILIARY_PREFIXES if strict else tuple(p for p in V.AUXILIARY_PREFIXES if p != "员工")
    colon = "[:：]"
    led = "|".join(f"{p}{colon}" if strict or p != "银行账户" else f"{p}:" for p in kinds)
    brackets = r"[\[\]【】]" if strict else r"[\[【]"
    return F.coalesce(name.rlike(brackets) | name.rlike(rf"^[\s　]*({led})"), F.lit(False))


def ratio(a: str, b: str, least: float = 0.0) -> float:
    """Ratcliff-Obershelp similarity; 0 as soon as an upper bound falls below ``least``."""
    if not a or not b:
        return 0.0
    matcher = SequenceMatcher(None, a, b)
    if matcher.real_quick_ratio() < least or matcher.quick_ratio() < least:
        return 0.0
    return matcher.ratio()
