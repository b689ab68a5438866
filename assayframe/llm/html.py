"""Main text of web pages by equivalence classes of tokens over the pages of a host.

Tokens are structural tags and blocks of text, told apart by the containers they stand in. Over
all pages of a host, a token has an occurrence vector (how often it occurs on each
page); vectors are compared by a 64-bit sum of page hashes, with the number of pages and
occurrences, so that one aggregate finds them at any number of pages and a hot host is added up by all tasks.
Tokens with the same vector form an equivalence class. A class is valid if it is found on at least
``least_pages`` pages and holds the tag of a container; it nests in the class of the container around
it. A text run in the class of its own container, there every time the container is, belongs to the template
if the pages it is found on differ otherwise: of their main text, what such runs leave must be as much as the runs
(in a marked article) or a quarter of it (elsewhere). Else the pages are copies of one text, up to a date or a
counter, and the runs are that text.

What the template leaves are slots. Slots in containers of a fixed role (menus, headers, footers,
side bars, notices, adverts, forms, comments, scripts, styles) are dropped, and if the page
marks its article, so is all outside of it; of the rest, the slots hold the main text. A page of
which the template would leave nothing (all pages of the host alike) keeps its text.

Defined cases: null or empty html gives an empty text; a page without a host is its own host; unclosed
tags end with what they stand in; repeated rows are pages of their own; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.llm.common import per_row
from assayframe.sources.session import settle

LEAST_PAGES = 5
#: What constant text leaves of the pages it is found on, against its own length: in a marked article, elsewhere.
LEAST_DIFFERENT = (1.0, 0.25)
MASK = (1 << 64) - 1

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select|title|object|canvas|math)\b.*?(?:</\1\s*>|\Z)"
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*>""",
    re.DOTALL | re.IGNORECASE,
)
# Element names by their part in a page.
CONTAINERS = set("html body div section article main nav header footer aside form fieldset table ul ol dl menu dialog figure details search head".split())
BLOCKS = CONTAINERS | set("p h1 h2 h3 h4 h5 h6 li dt dd tr td th caption thead tbody tfoot blockquote pre hr address figcaption summary hgroup option legend".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
DROPPED = set("nav header footer aside form fieldset menu dialog button head search label".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
ROLE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|banner|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|"
    r"sidebar|side-bar|footer|header|masthead|cookie|cookies|consent|gdpr|notice|notices|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|"
    r"comment|comments|commentlist|respond|replies|reply|discussion|disqus|related|recommended|recommendations|share|sharing|social|pagination|pager|toolbar|widget|form)(?:$|[\s_-])"
)
NAMES = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
SPACE = re.compile(r"\s+")


def marks(attributes: str) -> dict[str, str]:
    if not attributes or attributes.isspace():
        return {}
    return {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in NAMES.finditer(attributes)}


def dropped(name: str, own: dict[str, str], in_article: bool) -> bool:
    if name in DROPPED:
        return not (name == "header" and in_article)
    if own.get("role") in ROLES or "hidden" in own or own.get("aria-hidden") == "true":
        return True
    if name in ("html", "body", "main"):
        return False
    return bool(ROLE_WORDS.search(own.get("class", "")) or ROLE_WORDS.search(own.get("id", "")))


def parsed(page: str) -> Iterator[tuple[str, object, int, bool, bool]]:
    """Events in page order: ("open", container, ...) and ("text", run, ...) with the hash of the containers
    around it, whether these are dropped, whether they hold an article; ("break",) between blocks."""
    stack: list[tuple[str, int, bool, bool]] = []
    here, out, inside = 0, False, False
    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            yield "text", page[at : m.start()], here, out, inside
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if name in BLOCKS:
            yield "break", None, here, out, inside
        elif name == "br":
            yield "text", " ", here, out, inside
        if name not in CONTAINERS and name not in DROPPED:
            continue
        if m[2]:
            if any(s[0] == name for s in stack):
                while True:
                    top = stack.pop()
                    if top[0] == name:
                        break
                here, out, inside = stack[-1][1:] if stack else (0, False, False)
        elif name not in VOID and not m[4].endswith("/"):
            own = marks(m[4])
            here = xxhash.xxh3_64_intdigest(f"{here}<{name} {own.get('class', '')}#{own.get('id', '')}")
            out = out or dropped(name, own, inside)
            inside = inside or (not out and (name in ("article", "main") or own.get("role") in ("main", "article")))
            stack.append((name, here, out, inside))
            yield "open", name, here, out, inside
    if at < len(page):
        yield "text", page[at:], here, out, inside


def clean(run: str) -> str:
    return SPACE.sub(" ", html.unescape(run)).strip()


def blocks(page: str) -> Iterator[tuple[bool, str, int, bool]]:
    """In page order: (True, "", container, in an article) for a container that opens, (False, text, container around it,
    in an article) for a block of text; what stands in dropped containers is left out."""
    part: list[str] = []
    place = (0, False)
    for kind, value, here, out, inside in parsed(page):
        if kind == "text":
            if not out:
                place = place if part else (here, inside)
                part.append(value)
            continue
        if part and (text := clean("".join(part))):
            yield False, text, *place
        part = []
        if kind == "open":
            yield True, "", here, inside
    if part and (text := clean("".join(part))):
        yield False, text, *place


def text_token(text: str, here: int) -> int:
    return xxhash.xxh3_64_intdigest(text, here & MASK)


def tokens(page: str) -> dict[tuple, list[int]]:
    """Occurrences and characters of (token, container around it, whether it is a tag, in an article). The characters of a
    tag are those of the main text of the page, with what the template takes of it."""
    found: dict[tuple, list[int]] = {}
    chars = [0, 0]
    for tag, text, here, inside in blocks(page):
        own = found.setdefault((here if tag else text_token(text, here), here, tag, inside), [0, 0])
        own[0] += 1
        own[1] += len(text)
        chars[inside] += len(text)
    for (_, _, tag, _), own in found.items():
        if tag:
            own[1] = chars[True] or chars[False]
    return found


def main_text(page: str, template: frozenset[int]) -> str:
    found = [(text, here, inside) for tag, text, here, inside in blocks(page) if not tag]
    if any(inside for *_, inside in found):
        found = [f for f in found if f[2]]
    left = [text for text, here, _ in found if text_token(text, here) not in template] if template else []
    return "\n\n".join(left or [text for text, _, _ in found])


def _signed(values) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def _vectors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        sums: dict[tuple, list[int]] = {}
        for host, mark, page in zip(frame["host"], frame["mark"], frame["html"]):
            for key, (n, chars) in tokens(page or "").items():
                own = sums.setdefault((host, *key), [0, 0, 0, 0, 0])
                own[0] += 1
                own[1] += n
                own[2] = (own[2] + n * (mark & MASK)) & MASK
                own[3] = (own[3] + (mark & MASK)) & MASK
                own[4] += chars
        if sums:
            keys, values = list(sums), list(sums.values())
            yield pd.DataFrame(
                {
                    "host": [k[0] for k in keys],
                    "token": _signed([k[1] for k in keys]),
                    "around": _signed([k[2] for k in keys]),
                    "tag": [k[3] for k in keys],
                    "inside": [k[4] for k in keys],
                    "pages": [v[0] for v in values],
                    "n": [v[1] for v in values],
                    "vector": _signed([v[2] for v in values]),
                    "marks": _signed([v[3] for v in values]),
                    "chars": [v[4] for v in values],
                }
            )


def host() -> Column:
    """Host of the url; a page without one is alone."""
    named = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(F.coalesce(named, F.lit("")) != "", named).otherwise(F.concat(F.lit("page:"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))


def templates(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """host, constant: the text tokens of the host's template, no more than one page has."""
    marked = pages.select(host().alias("host"), F.xxhash64("page_id", "url").alias("mark"), "html")
    schema = "host string, token long, around long, tag boolean, inside boolean, pages long, n long, vector long, marks long, chars long"
    partial = marked.mapInPandas(_vectors, schema)
    # 64-bit sums wrap; the decimal sum of two halves does not
    halves = [F.sum(F.expr(e)).alias(f"{c}{i}") for c in ("vector", "marks") for i, e in enumerate((f"{c} & 4294967295", f"shiftrightunsigned({c}, 32)"))]
    found = partial.groupBy("host", "token", "around", "tag", "inside").agg(*[F.sum(c).alias(c) for c in ("pages", "n", "chars")], *halves)
    # the two halves as one number below 2^64; v is that of the occurrences, s that of the set of pages
    whole = [x for c, v in (("vector", "v"), ("marks", "s")) for x in (f"{c}0 & 4294967295 AS {v}0", f"({c}1 + shiftright({c}0, 32)) & 4294967295 AS {v}1")]
    found = found.where(F.col("pages") >= least_pages).selectExpr("host", "token", "around", "tag", "inside", "pages", "n", "chars", *whole)
    found = settle(found, "html-vectors")
    classes = found.where("tag").select("host", F.col("token").alias("around"), "pages", "n", "v0", "v1", F.col("chars").alias("page_chars"))
    classes = classes.groupBy("host", "around", "pages", "n", "v0", "v1").agg(F.max("page_chars").alias("page_chars"))
    constant = found.where("not tag").join(classes, ["host", "around", "pages", "n", "v0", "v1"])
    # all constant text of a set of pages, against what these have besides
    same = constant.groupBy("host", "inside", "pages", "s0", "s1").agg(
        F.sum("chars").alias("own"), F.max("page_chars").alias("all"), F.collect_set("token").alias("tokens")
    )
    in_article, elsewhere = LEAST_DIFFERENT
    differ = F.col("all") - F.col("own") >= F.when(F.col("inside"), F.lit(in_article)).otherwise(F.lit(elsewhere)) * F.col("own")
    return same.where(differ).groupBy("host").agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("constant"))


def _extract(pages: list, constants: list) -> tuple[list, list]:
    known = [frozenset() if c is None else frozenset(x & MASK for x in c) for c in constants]
    texts = [main_text(p or "", c) for p, c in zip(pages, known)]
    return texts, [len(t) for t in texts]


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    slim = pages.select("page_id", "url", "html")
    constant = settle(templates(slim, least_pages), "html-templates")
    known = slim.withColumn("host", host()).join(constant, "host", "left")
    return per_row(known, ["page_id", "url"], ["html", "constant"], lambda: _extract, {"text": "string", "n_chars": "long"})
