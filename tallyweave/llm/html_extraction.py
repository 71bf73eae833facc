"""Main text of pages by template deduction from equivalence classes.

Markup is read as tokens: each element is named by the path of elements it lies in, with class,
id and role, and each text by its path and a hash. The occurrence vector of a token holds its
count on each page of a host. Tokens of a host with equal vectors form an equivalence class;
vectors are compared by their number of pages, their sum and a hash summed over pages, so no
page list is ever gathered. Pages with the same text outside menus and the like count once.

A class can be valid if it covers ``MIN_SHARE`` of the host's pages (two at least) and its
elements occur once a page. On a page it is valid if its elements are all there, in the order
they have on the host, and between the same two elements of every valid class of more pages, so
that classes nest. Elements of valid classes make up the template of the page; the places
between them are its slots. Texts of a valid class are template too where enough pages agree:
``MIN_TEXT_PAGES``, or ``CONTENT_TEXT_PAGES`` where an article or main element lies around
them. Slots are ranked by the text that such elements mark, then by all text on the host; the
first keeps texts of the template when they are most of it, as then the pages are copies of
each other. Everything else is main text, in page order, unless an element around it is a menu,
header, footer, sidebar, notice, advert, form, comment list or the like by tag or class.

Counts per host, token and page and then per host and token have partial aggregation, so a host
with a third of all pages burdens no single task. A template has at most a page's tokens divided
by MIN_SHARE; templates join their pages by broadcast up to MAX_BROADCAST_HOSTS and by shuffle
beyond (Spark splits a hot host). A page of a host without a template is its own template.

Null and empty html give an empty text, as do pages without main text. Unclosed elements end
with their parent; an unclosed script, style or comment runs to the end of the page.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import checkpointed
from tallyweave.llm.url_filters import host_of

MIN_SHARE, MIN_PAGES = 0.5, 2
#: Pages that must agree on a text of the template, and on one inside an article or main element.
MIN_TEXT_PAGES, CONTENT_TEXT_PAGES = 3, 10
MAX_BROADCAST_HOSTS = 20_000
TOKENS = re.compile(
    r"""<!--.*?(?:-->|\Z)
      | <(?:svg|math)(?=[\s/>])(?:[^>"']|"[^"]*"|'[^']*')*?/>
      | <(?P<raw>script|style|title|textarea|noscript|template|svg|math|iframe|object|select|canvas|video|audio)(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)
      | <(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?:(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>|(?P<rest>[^>]*)(?:>|\Z))
      | <[!?/][^>]*(?:>|\Z)""",
    re.VERBOSE | re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag of the first kind ends open elements of the second, up to one of the third.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
FURNITURE_TAGS = frozenset("aside button dialog footer form head header menu nav".split())
FURNITURE_WORDS = frozenset(
    "ad ads adsense advert advertisement advertising adverts aside banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer "
    "disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion reaction reactions "
    "recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
FURNITURE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Blocks that hold text or parts of a list or table rather than a section.
TEXT_TAGS = frozenset("blockquote caption dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup li ol p pre summary table tbody td tfoot th thead tr ul".split())
CONTENT_TAGS = frozenset(("article", "main"))
WORDS = re.compile("[a-z0-9]+")


def _element(tag: str, attrs: str) -> tuple[str, bool, bool]:
    """(token, furniture, content) of an opening tag."""
    name, furniture, content = tag, tag in FURNITURE_TAGS, tag in CONTENT_TAGS
    if attrs and attrs.strip("/ \n\t\r"):
        found = {k.lower(): next((x for x in (a, b, c) if x), "") for k, a, b, c in reversed(ATTRIBUTE.findall(attrs))}
        label = " ".join(found.get(k, "") for k in ("class", "id")).lower()
        role = found.get("role", "").lower()
        words = WORDS.findall(label)
        if words or role:
            name = ".".join([tag, *words, *WORDS.findall(role)])
        content |= role in ("main", "article")
        hidden = "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower()
        if tag not in ("html", "body"):
            furniture |= hidden or role in FURNITURE_ROLES or (not content and bool(FURNITURE_WORDS.intersection(words)))
    return name, furniture, content


def read_page(page: str) -> tuple[Counter, list[tuple[str, bool, bool, str]]]:
    """Counts of the element tokens, and the text blocks (path, furniture, inside content, text) in page order."""
    counts: Counter = Counter()
    blocks: list[tuple[str, bool, bool, str]] = []
    stack: list[tuple[str, str, bool, bool]] = []  # tag, path, furniture, content
    parts: list[str] = []
    here = ("", False, False)

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                blocks.append((*here, text))
            parts.clear()

    def close(to: int) -> None:
        del stack[to:]

    def place() -> tuple[str, bool, bool]:
        return (stack[-1][1], stack[-1][2], stack[-1][3]) if stack else ("", False, False)

    at = 0
    for m in TOKENS.finditer(page):
        if m.start() > at:
            parts.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        block = tag in BLOCKS
        if block:
            flush()
        if m["end"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if not block and stack[i][2] != place()[1]:
                        flush()
                    close(i)
                    break
        elif tag in VOID:
            if tag == "br":
                parts.append(" ")
        else:
            if block:
                kinds, stops = IMPLIED.get(tag, (frozenset(), frozenset()))
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in stops:
                        break
                    if stack[i][0] in kinds or stack[i][0] == "p":
                        close(i)
                        break
                    if stack[i][0] in BLOCKS and not kinds:
                        break
            name, furniture, content = _element(tag, m["attrs"] or m["rest"] or "")
            _, f, c = place()
            if furniture and not f:
                flush()
            path = f"{stack[-1][1]}>{name}" if stack and block else name if block else stack[-1][1] if stack else ""
            if block:
                counts[path] += 1
            stack.append((tag, path, f or furniture, c or content))
        if not parts:
            here = place()
    if at < len(page):
        parts.append(entities.unescape(page[at:]))
    flush()
    return counts, blocks


def _slot(path: str, template: frozenset) -> str:
    """The innermost template token around a path that can hold several blocks."""
    while path and (path not in template or path.rpartition(">")[2].partition(".")[0] in TEXT_TAGS):
        path = path.rpartition(">")[0]
    return path


def _text_token(path: str, text: str) -> str:
    return "text:" + xxhash.xxh64_hexdigest(f"{path} {text}".encode("utf-8", "surrogatepass"))


def _page_key(counts: Counter, blocks: list) -> int:
    """Equal for pages with the same text outside menus and the like; pages without any are told apart by their elements."""
    said = [text for _, furniture, _, text in blocks if not furniture] or [f"{n} {t}" for t, n in counts.items()]
    return int.from_bytes(xxhash.xxh64_digest("\n".join(said).encode("utf-8", "surrogatepass")), "big", signed=True)


def page_tokens(pages: DataFrame, html: str = "html") -> DataFrame:
    """(host, key, token, n, seat, chars, marked) rows: per page one for each element path and each text, and one with an empty token.

    ``seat`` is the place of an element among the page's, ``chars`` the text right inside it
    and ``marked`` the part of that inside an article or main element.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for host, page in zip(batch["host"], batch["page"], strict=True):
                counts, blocks = read_page(page or "")
                if not counts and not blocks:
                    continue
                key = _page_key(counts, blocks)
                chars: Counter = Counter()
                marked: Counter = Counter()
                texts: Counter = Counter()
                for path, furniture, content, text in blocks:
                    if not furniture:
                        chars[path] += len(text)
                        marked[path] += len(text) * content
                        token = _text_token(path, text)
                        texts[token] += 1
                        chars[token] += len(text)
                rows.append((host, key, "", 1, 0, 0, 0))
                rows += [(host, key, t, n, i, chars[t], marked[t]) for i, (t, n) in enumerate(counts.items())]
                rows += [(host, key, t, n, 0, chars[t], 0) for t, n in texts.items()]
            yield pd.DataFrame(rows, columns=["host", "key", "token", "n", "seat", "chars", "marked"])

    return pages.select("host", F.col(html).alias("page")).mapInPandas(read, "host string, key long, token string, n long, seat long, chars long, marked long")


def templates(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per host with ``template``: its classes, each with its number of pages, whether its tokens occur once a page, and the tokens.

    ``pages`` has ``host`` and the html. Hosts without a valid class have no row.
    """
    tokens = page_tokens(pages, html).groupBy("host", "token", "key").agg(*(F.max(c).alias(c) for c in ("n", "seat", "chars", "marked")))
    vectors = tokens.groupBy("host", "token").agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum("n").alias("total"),
        F.bit_xor(F.xxhash64("key", "n")).alias("vector"),
        *(F.sum(c).alias(c) for c in ("seat", "chars", "marked")),
    )
    vectors = checkpointed(vectors.filter(F.col("pages") >= MIN_PAGES))
    sizes = vectors.filter("token = ''").select("host", F.col("pages").alias("host_pages"))
    valid = vectors.filter("token <> ''").join(sizes, "host").filter(F.col("pages") >= F.col("host_pages") * F.lit(MIN_SHARE))
    classes = valid.groupBy("host", "pages", "total", "vector").agg(F.collect_list(F.struct("token", "seat", "chars", "marked")).alias("tokens"))
    once = (F.col("pages") == F.col("total")).alias("once")
    return classes.groupBy("host").agg(F.collect_list(F.struct("pages", once, "tokens")).alias("template"))


def _is_text(token: str) -> bool:
    return token.startswith("text:")


def valid_classes(counts: Counter, template: list | None) -> list:
    """The classes of the host that are valid on a page: whole, in order and nested."""
    place = {t: i for i, t in enumerate(counts)}
    found, outer = [], []
    for c in sorted(template or (), key=lambda c: (-c["pages"], min(t["token"] for t in c["tokens"]))):
        elements = [t["token"] for t in sorted(c["tokens"], key=lambda t: (t["seat"], t["token"])) if not _is_text(t["token"])]
        if not c["once"] or not elements or any(counts[t] != 1 for t in elements):
            continue
        seats = [place[t] for t in elements]
        if seats == sorted(seats) and all(bisect(o, seats[0]) == bisect(o, seats[-1]) for o in outer):
            found.append(c)
            outer.append(seats)
    return found


def main_text(page: str | None, template: list | None) -> str:
    """The main text of one page, its blocks joined by line feeds."""
    counts, blocks = read_page(page or "")
    valid = valid_classes(counts, template)
    nested = frozenset(t["token"] for c in valid for t in c["tokens"] if not _is_text(t["token"])) or frozenset(p for p, n in counts.items() if n == 1)
    agreed = {t["token"]: (c["pages"], t["chars"]) for c in valid for t in c["tokens"] if _is_text(t["token"])}
    kept = [(_slot(path, nested), agreed.get(_text_token(path, text), (0, 0)) if agreed else (0, 0), content, text) for path, furniture, content, text in blocks if not furniture]
    held: Counter = Counter()
    marked: Counter = Counter()
    for c in template or ():
        for t in c["tokens"]:
            if t["chars"] and not _is_text(t["token"]):
                slot = _slot(t["token"], nested)
                held[slot] += t["chars"]
                marked[slot] += t["marked"]
    fixed: Counter = Counter()
    for slot, (pages, chars), content, _ in kept:
        if pages >= (CONTENT_TEXT_PAGES if content else MIN_TEXT_PAGES):
            fixed[slot] += chars
    main = max((k[0] for k in kept), key=lambda s: (marked[s], held[s], s), default="")
    return "\n".join(
        text
        for slot, (pages, _), content, text in kept
        if pages < (CONTENT_TEXT_PAGES if content else MIN_TEXT_PAGES) or (slot == main and 2 * fixed[slot] > held[slot])
    )


def extract(pages: DataFrame, url: str = "url", html: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with their main text; an input column of that name is replaced."""
    hosted = pages.withColumn("_host", host_of(F.col(url)))
    found = checkpointed(templates(hosted.select(F.col("_host").alias("host"), F.col(html).alias("html"))))
    if found.count() <= MAX_BROADCAST_HOSTS:
        found = F.broadcast(found)
    joined = hosted.join(found.withColumnRenamed("host", "_template_host").withColumnRenamed("template", "_template"), F.col("_host") == F.col("_template_host"), "left")

    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for html_batch, template_batch in batches:
            yield pd.Series([main_text(h, None if t is None else list(t)) for h, t in zip(html_batch, template_batch, strict=True)], dtype=object)

    text = F.pandas_udf(read, "string")(F.col(html), F.col("_template"))
    return joined.withColumn(into, text).drop("_host", "_template_host", "_template")
