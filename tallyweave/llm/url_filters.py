"""URL filters: pattern rules behind an index on their rarest literal token.

A rule names a pattern over ``host + path`` and the literal tokens (maximal runs of ASCII
letters and digits) that every match must contain whole. Each rule is filed under the one of
its tokens that the fewest rules share; a URL looks up its own tokens and only the rules
found there run their regular expression. Rules without tokens are tried on every URL.

Null URLs and URLs without ``://`` have an empty host and path and only token-free rules can
match them. Repeated rows are judged alike; columns beside the URL pass through untouched.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import LOWER, UPPER

#: Above this many rules the index is joined instead of being sent to the workers.
MAX_SENT_RULES = 50_000
TOKEN = re.compile("[A-Za-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """tier: rules of a higher tier win; within a tier the longer ``name`` wins, then the smaller."""

    name: str
    action: str
    pattern: str
    tokens: tuple[str, ...] = ()
    tier: int = 0


def prefix_rule(host: str, path: str, action: str, tier: int = 1) -> Rule:
    """A rule for a host, all its subdomains and the paths that start with ``path``."""
    whole = TOKEN.findall(host) + [t for t in re.findall("[A-Za-z0-9]+(?=[^A-Za-z0-9])", path)]
    return Rule(host + path, action, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(dict.fromkeys(whole)), tier)


def label_rule(token: str, action: str = "block") -> Rule:
    """A rule for hosts with ``token`` as a whole word between dots and hyphens."""
    return Rule(token, action, rf"^(?:[^/]*[.-])?{re.escape(token)}(?:[.-][^/]*)?(?:/|$)", (token,), 0)


#: The allow and block rules of the pages query, as (host, path, action).
PAGE_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Host words that decide where no listed rule does.
SPAM_WORDS = ("adult", "bets", "casino", "escort", "gambling", "poker", "porn", "spam", "viagra", "xxx")


def default_rules() -> list[Rule]:
    return [prefix_rule(h, p, a) for h, p, a in PAGE_RULES] + [label_rule(w) for w in SPAM_WORDS]


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rarest_token(rules: Iterable[Rule]) -> dict[Rule, str | None]:
    """For each rule the token that the fewest rules share; ties go to the longer, then the smaller."""
    rules = list(rules)
    shared = Counter(t for r in rules for t in set(r.tokens))
    return {r: min(r.tokens, key=lambda t: (shared[t], -len(t), t), default=None) for r in rules}


def _better(a: Rule | None, b: Rule) -> Rule:
    key = lambda r: (-r.tier, -len(r.name), r.name)
    return b if a is None or key(b) < key(a) else a


def _judge(rules: list[Rule]):
    """A pandas function from host+path to the winning rule's name, action and tier; a task builds the index once, and a pattern is compiled when a token first asks for it."""
    filed = list(rarest_token(rules).items())

    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index: dict[str | None, list[Rule]] = defaultdict(list)
        for rule, token in filed:
            index[token].append(rule)
        compiled = cache(lambda pattern: re.compile(pattern, re.DOTALL))
        for addresses in batches:
            found = []
            for address in addresses:
                best = None
                for token in {None, *TOKEN.findall(address)}:
                    for rule in index.get(token, ()):
                        if compiled(rule.pattern).search(address):
                            best = _better(best, rule)
                found.append((best.name, best.action, best.tier) if best else (None, None, None))
            yield pd.DataFrame(found, columns=["name", "action", "tier"]).astype({"tier": "Int32"})

    return judge


def _joined(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """The same through a join on the token, for rule sets too large to send."""
    spark = urls.sparkSession
    filed = spark.createDataFrame(
        [(t, r.name, r.action, r.tier, r.pattern) for r, t in rarest_token(rules).items()],
        "token string, name string, action string, tier int, pattern string",
    )
    distinct = urls.select("address").distinct()
    tokens = distinct.select("address", F.explode(F.array_distinct(F.expr("regexp_extract_all(address, '[A-Za-z0-9]+', 0)"))).alias("token"))
    tried = tokens.join(filed.filter("token is not null"), "token").drop("token")
    if loose := [r for r in rules if not r.tokens]:
        fixed = F.array(*(F.struct(F.lit(r.name).alias("name"), F.lit(r.action).alias("action"), F.lit(r.tier).alias("tier"), F.lit(r.pattern).alias("pattern")) for r in loose))
        tried = tried.unionByName(distinct.select("address", F.inline(fixed)))
    hits = tried.filter(F.expr("rlike(address, concat('(?s)', pattern))"))
    order = F.struct(-F.col("tier"), -F.length("name"), F.col("name"))
    best = hits.groupBy("address").agg(F.min_by(F.struct("name", "action", "tier"), order).alias("hit"))
    return urls.join(best, "address", "left")


def filter_urls(pages: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow", max_sent_rules: int = MAX_SENT_RULES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``pattern`` and ``verdict``.

    ``rule`` is the name of the winning rule of tier 1 or more, ``pattern`` that of a winning
    tier-0 rule, ``verdict`` the winner's action or ``default``. Input columns with one of
    these names are replaced.
    """
    made = ("host", "path", "rule", "pattern", "verdict", "address", "hit")
    kept = pages.select(*(c for c in pages.columns if c == url or c not in made))
    urls = kept.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))}).withColumn("address", F.concat("host", "path"))
    if len(rules) > max_sent_rules:
        judged = _joined(urls, rules)
    else:
        judge = F.pandas_udf(_judge(rules), "name string, action string, tier int")
        judged = urls.withColumn("hit", judge("address"))
    listed = F.col("hit.tier") >= 1
    return judged.withColumns(
        {
            "rule": F.when(listed, F.col("hit.name")),
            "pattern": F.when(~listed, F.col("hit.name")),
            "verdict": F.coalesce(F.col("hit.action"), F.lit(default)),
        }
    ).drop("hit", "address")
