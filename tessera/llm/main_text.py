"""HTML extraction (operator 8): the maximum-scoring subsequence of words and tags.

A page is a sequence of words, which score positive, and tags, which score negative by their kind; one linear scan finds
the contiguous region of the highest sum, which is made whole to the blocks at its ends. All weights come from labelled
pages: what a kind of tag costs, and how much an element's tag and names (parts of class, id and role) speak for or
against the article. Words under an element that speaks against it score nothing, and are left out of the region's text;
words under one that speaks for it score more.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

# HTML's elements by how they are laid out.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas", "xmp")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
#: Elements that say what they hold; of others only the names are features.
TELLING = frozenset("nav aside footer form menu dialog button select fieldset head label input audio video search datalist article main header".split())
#: Names in the labelled pages' other parts and in their articles.
NOISE_NAMES = tuple("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer foot cookie cookies consent notice notices gdpr alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist disqus reply replies respond pagination pager toolbar widget skip masthead topbar complementary contentinfo search header".split())
BODY_NAMES = tuple("article post entry content story main body text page".split())
_PARTS = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>",
    re.DOTALL | re.IGNORECASE,
)
_ATTR = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_UNSEEN = re.compile(r"(?:^|\s)hidden(?=$|[\s=])|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.IGNORECASE)
# Elements whose end tag may be missing, and the start tags that end them.
_CLOSED_BY = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}


@lru_cache(maxsize=4096)
def names(attrs: str) -> tuple[str, ...]:
    """The parts of an element's class, id and role, in lower case; "!" where it is hidden."""
    found = {"!"} if _UNSEEN.search(attrs) else set()
    for m in _ATTR.finditer(attrs):
        found |= {x.lower() for x in _PARTS.findall(_CAMEL.sub(" ", m[1] or m[2] or m[3] or ""))}
    return tuple(sorted(found))


def features(tag: str, attrs: str, within: bool) -> list[str]:
    """What an element says of what it holds; within: it stands in one that speaks for the article."""
    out = [f"{tag}@in" if within and tag == "header" else tag] if tag in TELLING else []
    return out + [f".{x}" for x in names(attrs)] if attrs else out


def labelled_pages(count: int = 300) -> list[list[tuple[str, bool]]]:
    """Labelled pages: pieces of HTML in order, and whether each is the article's. Made by a fixed rule, each page anew."""
    pages, n = [], 0
    frames = ("nav", "header", "footer", "aside", "form", "menu", "dialog", "div", "section", "ul")
    for k in range(count):
        rng = random.Random(k)
        some = lambda low, high: " ".join("word" for _ in range(rng.randint(low, high)))  # noqa: B023, E731
        link = lambda: f"<a href='#'>{some(1, 3)}</a>"  # noqa: B023, E731

        def other(inside: bool = False) -> str:
            """A part that is not the article's; the names take turns."""
            nonlocal n
            n += 1
            links = ["".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 8))), f"<span>{some(1, 6)}</span> {link()} {link()}", f"<b>{link()}</b> {link()}"]  # noqa: B023
            if not inside and rng.random() < 0.25:  # nothing tells but what it holds  # noqa: B023
                return f"<{rng.choice(('div', 'ul', 'table'))}>{rng.choice(links)}</div>"  # noqa: B023
            tag = "div" if inside else rng.choice(frames)  # noqa: B023
            name = NOISE_NAMES[n % len(NOISE_NAMES)]
            attr = rng.choice([f" class='{name}'", f" id={name}", f' class="x-{name} wide"', f' role="{name}"', f' class="{rng.choice(BODY_NAMES)}-{name}"' if n % 9 == 0 else f" class={name}"]) if tag in ("div", "section", "ul") or n % 2 else ""  # noqa: B023
            held = rng.choice([*links, f"<p>{some(2, 25)}</p>", f"<h3>{some(1, 3)}</h3><ul><li>{link()}</li><li>{link()}</li></ul>", f"<label>{some(1, 2)}</label><input><button>{some(1, 2)}</button>", f"<div><b>{some(1, 2)}</b><p>{some(3, 30)}</p></div>"])  # noqa: B023
            return f"<{tag}{attr}>{held}</{tag}>"

        def block() -> str:
            """A part of the article."""
            return rng.choice([f"<p>{some(8, 60)}</p>"] * 4 + [f"<p><b>{some(1, 9)}</b> {some(5, 40)} <a href='#'>{some(1, 4)}</a> {some(3, 20)}</p>", f"<p>{some(5, 20)}<br>{some(5, 20)}<p>{some(5, 20)}", f"<h2>{some(2, 6)}</h2>", f"<ul>{''.join(f'<li>{some(2, 15)}</li>' for _ in range(rng.randint(2, 5)))}</ul>", f"<blockquote>{some(8, 30)}</blockquote>", f"<table><tr><td>{some(1, 4)}</td><td>{some(1, 4)}</td></tr></table>", f"<pre>{some(5, 20)}</pre>", f"<figure><img><figcaption>{some(3, 9)}</figcaption></figure>"])  # noqa: B023

        opening, closing = rng.choice([("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), (f"<div class='{rng.choice(('', 'x-'))}{rng.choice(BODY_NAMES)}{rng.choice(('', ' wide'))}'>", "</div>"), (f"<div id=x-{rng.choice(BODY_NAMES)}>", "</div>"), (f"<section class='{rng.choice(BODY_NAMES)} wide'>", "</section>"), ("<div>", "</div>"), ("", "")])
        head = rng.choice([f"<h1>{some(2, 10)}</h1>", f"<header><h1>{some(2, 10)}</h1></header>" if "article" in opening else f"<h1>{some(2, 10)}</h1>"])
        page = [(other(), False) for _ in range(rng.randint(1, 4))] + [(f"{opening}{head}{''.join(block() for _ in range(rng.randint(1, 6)))}", True)]
        if rng.random() < 0.4:
            page += [(other(True), False), ("".join(block() for _ in range(rng.randint(1, 4))), True)]
        pages.append([*page, (closing, True), *[(other(), False) for _ in range(rng.randint(1, 4))]])
    return pages


#: Odds below which an element is none of the article's, the cost of its tags, and the cost of any tag at least.
AGAINST, NOISE_COST, LEAST = -1.0, 1.0, 0.02


def kind(tag: str, within: bool) -> str:
    """A tag's kind: where an element around it speaks for the article, its own."""
    return f"{tag}@in" if within else tag


class Weights:
    """What the labelled pages teach: odds of features, costs of kinds of tags, the gain of a word."""

    def __init__(self, pages: list[list[tuple[str, bool]]]) -> None:
        speaks: tuple[Counter, Counter] = Counter(), Counter()
        opened = [[(good, [((m["tag"] or m["tag2"] or "").lower(), m["attrs"] or m["attrs2"] or "") for m in _TOKEN.finditer(piece) if not (m["end"] or m["end2"])], len(_TOKEN.sub(" ", piece).split())) for piece, good in page] for page in pages]
        for page in opened:
            for good, tags, _ in page:
                for tag, attrs in tags:
                    speaks[good].update(features(tag, attrs, good))
        odds = lambda side, x, most: max(-most, min(most, math.log((side[1][x] + 0.5) / (side[0][x] + 0.5))))
        self.odds = {x: odds(speaks, x, 4.0) for x in speaks[0].keys() | speaks[1].keys()}
        self.odds[".!"] = -12.0  # hidden, whatever its names
        kinds: tuple[Counter, Counter] = Counter(), Counter()
        words = 0
        for page in opened:
            first = next((tags[0] for good, tags, _ in page if good and tags), ("", ""))
            within = self.speaks(*first, False) > 0
            for good, tags, n in page:
                if good or not tags or self.speaks(*tags[0], False) >= AGAINST:  # what an element tells, its tags need not
                    kinds[good].update(kind(tag, good and within) for tag, _ in tags)
                words += n if good else 0
        self.cost = {x: LEAST + max(0.0, 0.5 - odds(kinds, x, 1.5)) / 2 for x in kinds[0].keys() | kinds[1].keys()}
        # So that an article's words pay for its own tags twice.
        self.word = max(0.3, 2 * sum(self.cost[x] * n for x, n in kinds[1].items()) / max(1, words))

    def speaks(self, tag: str, attrs: str, within: bool) -> float:
        """How much an element speaks for the article (above 0) or against it."""
        return sum(self.odds.get(x, 0.0) for x in features(tag, attrs, within))


@cache
def weights() -> Weights:
    return Weights(labelled_pages())


def scored(page: str) -> tuple[list[float], list[tuple[str, str, bool, bool]]]:
    """Of a page's words and tags in order: the scores, and (kind, text, a block starts here, none of the article's).

    Each open element knows what the elements around it say, so a token costs the same at any depth.
    """
    w = weights()
    scores: list[float] = []
    notes: list[tuple[str, str, bool, bool]] = []
    # tag, whether it or one around it is noise, best odds so far, blocks so far, index of the innermost block
    stack: list[tuple[str, bool, float, int, int]] = []
    where: dict[str, list[int]] = {}
    last = 0

    def close(at: int) -> None:
        while len(stack) > at:
            where[stack.pop()[0]].pop()

    def text(piece: str) -> None:
        if piece:
            clean = html.unescape(piece)
            n = max(len(clean.split()), len(clean.strip()) // 12)
            noise, best = (stack[-1][1], stack[-1][2]) if stack else (False, 0.0)
            scores.append(0.0 if noise else w.word * n * (1 + best))
            notes.append(("word", clean, False, noise))

    def mark(tag: str, noise: bool, block: bool, best: float = 0.0) -> None:
        scores.append(-w.cost.get(kind(tag, best > 0), LEAST if best > 0 else 0.25) if best > 0 or not noise else -NOISE_COST)
        notes.append((tag, "", block, noise))

    for m in _TOKEN.finditer(page):
        text(page[last : m.start()])
        last = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            mark((m["raw"] or "comment").lower(), True, False)
            continue
        block = tag in BLOCK
        if m["end"] or m["end2"]:
            at = where[tag][-1] if where.get(tag) else None
            mark(tag, at is not None and stack[at][1], block, stack[at][2] if at is not None else 0.0)
            if at is not None and (block or stack[-1][3] == stack[at][3]):
                close(at)
            continue
        attrs = m["attrs"] or m["attrs2"] or ""
        while stack and tag in _CLOSED_BY.get(stack[-1][0], ()):
            close(len(stack) - 1)
        if block and stack and stack[-1][0] not in BLOCK:  # an inline element left open ends with its paragraph
            at = stack[-1][4]
            if at >= 0 and stack[at][0] == "p":
                close(at)
        noise, best, blocks, inner = stack[-1][1:] if stack else (False, 0.0, 0, -1)
        says = w.speaks(tag, attrs, best > 0)
        noise = noise or (says < AGAINST and tag not in ("html", "body"))
        mark(tag, noise, block, best)
        if tag not in VOID and not attrs.endswith("/"):
            where.setdefault(tag, []).append(len(stack))
            stack.append((tag, noise, max(best, says), blocks + block, len(stack) if block else inner))
    text(page[last:])
    return scores, notes


def best_region(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous run of the highest sum, the first of equals; empty where nothing is positive."""
    best, start, end, total, begin = 0.0, 0, 0, 0.0, 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, k
        total += s
        if total > best:
            best, start, end = total, begin, k + 1
    return start, end


def main_text(page: str | None) -> str:
    """The article's blocks, white space made single, joined by empty lines; "" where there is none."""
    if not page:
        return ""
    scores, notes = scored(page)
    start, end = best_region(scores)
    if end <= start:
        return ""
    while start > 0 and not notes[start][2] and not notes[start - 1][2]:  # whole blocks at both ends
        start -= 1
    while end < len(notes) and not notes[end][2]:
        end += 1
    blocks, parts = [], []
    for kind, text, block, noise in notes[start:end]:
        if block:
            blocks.append("".join(parts))
            parts = []
        if kind == "br":
            parts.append(" ")
        elif text and not noise:
            parts.append(text)
    blocks.append("".join(parts))
    return "\n\n".join(x for x in (" ".join(b.split()) for b in blocks) if x)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """One row per row of `pages`: page_id, url, text, n_chars (code points).

    Null or empty html gives empty text; so does a page without a word outside noise. Repeated rows are alike; an empty
    table gives no rows; other columns are left out. Whole pages are read; of regions that tie, the first is taken.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(column).alias("html"))
    return rows.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))


QUERIES = {"op8_main_text": op8_main_text}
ORACLES: dict[str, str] = {}
