"""HTML extraction by template deduction from equivalence classes.

Tokens of a page are its tags and text runs, each in its role: the path of containers around it. Pages of one
host with the same text outside boilerplate parts are one body, and one of them stands for it. Over the
bodies of one host, tokens with equal occurrence vectors (how often in which body) form a class; a class is
taken if it is large and frequent. Vectors are never built: each is the sum of hashes of (body, count), so
equal sums mean equal vectors, and sums are pre-aggregated before the shuffle however many bodies a host has.

On a page, a class is valid if its tokens come in the class's order, time after time, and each time inside one
gap of the class that encloses it; valid classes, the most frequent outermost, are a tree of gaps. Classes are
deduced twice: tokens of one role that stand in different gaps of the first tree are different tokens to the
second, so like containers of a page part. The gaps of the second tree are the slots.

How much text a slot has on all bodies of the host is known from its class: the text before each token, summed
over bodies, is part of what is added up, and the differences of neighbouring tokens are the slots' sums. Text
counts more in articles and less in parts whose tags or class names speak of boilerplate. The main slot of a page
is the one whose class has most text for each body, so a short article is found by its place, not by its size;
the main text is that of the container around the main slot, without menus, forms and the like in it, without
parts whose class name says boilerplate and that the template has too, and without template text: text runs of
classes that most bodies have; in an article only those in no heading, paragraph or the like that nearly all of
many bodies have, so passages that some pages share stay.

A page without a template (its host has fewer than ``LEAST_PAGES`` bodies, or none of their classes is valid on
it with enough text) goes by roles alone: its article or main part, or else the role with the most text.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, mix64, small_batches
from .url_filter import split_url

#: A class needs so many tokens, and each of them so many bodies and such a share of the host's bodies.
LEAST_TOKENS, LEAST_PAGES, LEAST_SHARE = 3, 3, 0.2
#: In an article, a constant text run outside PROSE is boilerplate with so many bodies and such a share of them.
CONSTANT_PAGES, CONSTANT_SHARE = 20, 0.95
#: Elsewhere, a text run of a class counts as template with such a share of the host's bodies; tags need less.
TEXT_SHARE = 0.8
#: What a character counts in a slot: in an article or main element, in a part named so, elsewhere, in a part
#: with a boilerplate name, in a boilerplate element.
IN_MAIN, IN_NAMED, PLAIN, IN_WORDS, IN_TAGS = 20, 15, 10, 2, 1
#: A page's main slot has such a share of the text that the template's largest slot has for each body.
SLOT_SHARE = 0.2
#: Templates of hosts with such a share of all pages are sent to every task; other pages meet theirs by a join,
HOT_SHARE = 0.002
#: on several keys for hosts with such a share and number of pages.
WARM_SHARE, WARM_PAGES, SALTS = 1e-5, 20_000, 256
#: Templates that a task keeps unpacked.
MOST_TEMPLATES = 2000

_MARKUP = re.compile(
    r"(?s)<!--(?:.*?-->|.*)"
    r"|<(?P<raw>script|style|noscript|template|iframe|textarea|svg|math|object|select|title)\b(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/)?(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)",
    re.IGNORECASE,
)
_ATTR = re.compile(r"(?i)\b(class|id|role|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")
_SPACE = re.compile(r"\s+")
#: Elements that make up a token's role; others (paragraphs, inline markup) are too often left open.
CONTAINERS = frozenset("html head body header footer nav main article section aside div form ul ol dl table figure details dialog menu fieldset".split())
#: Elements that begin and end a block of text.
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th caption thead tbody tfoot blockquote pre hr figcaption address summary legend center".split())
#: Elements that carry an article's own text.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th caption figcaption blockquote pre".split())
_BOILERPLATE_TAGS = frozenset("head header footer nav aside form dialog menu fieldset button label select option".split())
_BOILERPLATE_WORDS = re.compile(
    r"(?i)(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|notices?|alert|sidebar|side|comments?|disqus|replies|respond|share|sharing|social|related|recommend\w*|breadcrumbs?|menu|nav|navbar|navigation|footer|header|masthead|newsletter|subscribe|signup|login|popup|modal|overlay|widget|toolbar|pagination|pager|search|skip|copyright|legal|disclaimer|trending|popular|tags?|meta|byline)(?:$|[\s_-])"
)
_MAIN_WORDS = re.compile(r"(?i)(?:^|[\s_-])(?:main|article|article-body|post-content|entry-content|post-body|story|story-body)(?:$|[\s_-])")


@dataclass(slots=True)
class Element:
    """A container of a page: where it is, its role as a hash, and what its tag and names say."""

    parent: int
    tag: str
    role: int
    main: bool  # it is or is in an article or main part
    by_tag: bool  # its own tag is that of boilerplate
    by_word: bool  # its own names are
    opening: int  # its opening tag's token
    weight: int


@dataclass(slots=True)
class Page:
    """A page's tokens in order, the containers before and after each, and the containers; container 0 is the page."""

    tags: list[str] = field(default_factory=list)  # the empty string for a text run
    texts: list[str] = field(default_factory=list)
    keys: list[int] = field(default_factory=list)
    before: list[int] = field(default_factory=list)
    after: list[int] = field(default_factory=list)
    prose: list[bool] = field(default_factory=list)
    elements: list[Element] = field(default_factory=list)

    def weights(self) -> list[int]:
        """Each token's text length by the weight of its container."""
        elements = self.elements
        return [len(t.strip()) * elements[e].weight if t else 0 for t, e in zip(self.texts, self.before)]


_KEYS: dict[tuple[int, str], int] = {}


def _key(role: int, word: str) -> int:
    """A token's key: its word in its role; odd, as 0 stands for a host's bodies."""
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), seed=role) | 1


def _tag_key(role: int, word: str) -> int:
    if (key := _KEYS.get((role, word))) is None:
        if len(_KEYS) > 100_000:
            _KEYS.clear()
        key = _KEYS[role, word] = _key(role, word)
    return key


def parse(page: str) -> Page:
    """A page's tags and text runs; comments and raw elements (scripts, styles) have no text.

    Anything counts as HTML: unclosed elements, stray ends and cut-off tails are taken as they come. A quotation
    mark only begins an attribute's value right after an equals sign.
    """
    out = Page(elements=[Element(-1, "", 0, False, False, False, -1, PLAIN)])
    elements, stack = out.elements, [0]
    at, prose = 0, False

    def put(tag: str, text: str, key: int, before: int, after: int) -> None:
        out.tags.append(tag)
        out.texts.append(text)
        out.keys.append(key)
        out.before.append(before)
        out.after.append(after)
        out.prose.append(prose)

    def put_text(text: str) -> None:
        top = stack[-1]
        put("", text, _key(elements[top].role, " ".join(text.split())), top, top)

    for m in _MARKUP.finditer(page):
        if m.start() > at:
            put_text(page[at : m.start()])
        at = m.end()
        top = stack[-1]
        tag = (m["tag"] or "").lower()
        if not tag:
            if m["raw"]:
                raw = m["raw"].lower()
                put(raw, "", _tag_key(elements[top].role, raw), top, top)
            continue
        if tag in BLOCKS:  # a block of text lasts until another block begins or ends
            prose = tag in PROSE and not m["close"]
        if tag not in CONTAINERS:
            word = "/" + tag if m["close"] else tag
            put(word, "", _tag_key(elements[top].role, word), top, top)
        elif m["close"]:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if elements[stack[k]].tag == tag), None)
            if depth is None:
                put("/" + tag, "", _tag_key(elements[top].role, "/" + tag), top, top)
            else:
                closed = stack[depth]
                del stack[depth:]
                put("/" + tag, "", _tag_key(elements[closed].role, "/" + tag), closed, stack[-1])
        else:
            found = _ATTR.findall(m["attrs"]) if m["attrs"] else ()
            attrs = {k.lower(): v.strip("\"'") for k, v in found}
            names = " ".join(attrs.values()).strip()
            of = elements[top]
            is_main = tag in ("article", "main")
            main = of.main or is_main or bool(names and _MAIN_WORDS.search(names))
            by_tag = tag in _BOILERPLATE_TAGS
            by_word = bool(names and not is_main and tag not in ("body", "html") and _BOILERPLATE_WORDS.search(names))
            own = IN_TAGS if by_tag else IN_WORDS if by_word else IN_MAIN if is_main else IN_NAMED if main else PLAIN
            weight = min(of.weight, own) if min(of.weight, own) < PLAIN else max(of.weight, own)
            role = _tag_key(of.role, f"<{tag}.{attrs.get('class', '')}")
            elements.append(Element(top, tag, role, main, by_tag, by_word, len(out.tags), weight))
            put(tag, "", _tag_key(role, "<"), top, len(elements) - 1)
            stack.append(len(elements) - 1)
    if at < len(page):
        put_text(page[at:])
    return out


def body_of(page: Page) -> int:
    """A hash of a page's text outside boilerplate parts, of the main part alone if there is one.

    Where that is less than half of the page's text, names may mislead, and all text counts.
    """
    main = any(e.main for e in page.elements)
    own, held, every = [], 0, 0
    for text, key, e in zip(page.texts, page.keys, page.before):
        if n := len(text.strip()):
            every += n
            if page.elements[e].weight > (PLAIN if main else IN_WORDS):
                own.append(key)
                held += n
    if 2 * held < every:
        own = [key for text, key in zip(page.texts, page.keys) if text.strip()]
    return _signed(xxhash.xxh64_intdigest(np.array(own, "<u8").tobytes()))


_MASK = (1 << 64) - 1


def _signed(x: int) -> int:
    x &= _MASK
    return x - (1 << 64) if x >> 63 else x


@dataclass(frozen=True)
class Classes:
    """A host's classes: token key -> (class, place in the class), bodies and size of each, text in each gap."""

    tokens: dict[int, tuple[int, int]]
    support: tuple[int, ...]
    size: tuple[int, ...]
    masses: tuple[tuple[int, ...], ...] = ()

    @staticmethod
    def of(rows: Sequence[dict]) -> Classes:
        """From a template's rows: bodies, keys and masses."""
        tokens = {key & _MASK: (c, place) for c, x in enumerate(rows) for place, key in enumerate(x["keys"])}
        return Classes(tokens, tuple(x["support"] for x in rows), tuple(len(x["keys"]) for x in rows), tuple(tuple(x["masses"]) for x in rows))

    def largest(self) -> float:
        """Text for each body in the slot that has most of it."""
        return max((max(m, default=0) / s for m, s, n in zip(self.masses, self.support, self.size) if n >= LEAST_TOKENS), default=0.0)


@dataclass(frozen=True)
class Template:
    """Classes of tokens, classes of tokens told apart by the gaps of the first ones, and the host's bodies."""

    first: Classes
    second: Classes
    bodies: int


@dataclass(slots=True)
class Gap:
    """A gap of a valid class on a page: its own number is that of its class's place in a gap, on any page."""

    parent: int
    number: int
    of: int
    place: int
    spans: list[tuple[int, int]]  # the tokens that enclose it, each time


def nest(keys: Sequence[int], classes: Classes, least_tokens: int = LEAST_TOKENS) -> tuple[list[int], list[Gap], set[int]]:
    """(innermost gap of each token, gaps, valid classes) of a page of these tokens; gap 0 is the whole page.

    A class is valid if its tokens are in order, time after time, and each time inside one gap.
    """
    places: dict[int, list[tuple[int, int]]] = {}
    known = classes.tokens
    for at, key in enumerate(keys):
        if (found := known.get(key)) is not None and classes.size[found[0]] >= least_tokens:
            places.setdefault(found[0], []).append((at, found[1]))
    inner, gaps, valid = [0] * len(keys), [Gap(-1, 0, -1, 0, [])], set()
    for c in sorted(places, key=lambda c: (-classes.support[c], -classes.size[c], c)):
        here, size = places[c], classes.size[c]
        if len(here) % size or any(place != k % size for k, (_, place) in enumerate(here)):
            continue
        if any(inner[here[k][0]] != inner[here[k - k % size][0]] for k in range(len(here))):
            continue
        valid.add(c)
        numbers: dict[tuple[int, int], int] = {}
        for k in range(0, len(here), size):
            around = inner[here[k][0]]
            for j in range(size - 1):
                lo, hi = here[k + j][0], here[k + j + 1][0]
                if (g := numbers.get((around, j))) is None:
                    g = numbers[around, j] = len(gaps)
                    gaps.append(Gap(around, ((gaps[around].number ^ (c << 20 | j + 1)) * 0x9E3779B97F4A7C15) & _MASK, c, j, []))
                gaps[g].spans.append((lo, hi))
                for at in range(lo + 1, hi):
                    if inner[at] == around:
                        inner[at] = g
    return inner, gaps, valid


def told_apart(keys: Sequence[int], first: Classes) -> np.ndarray:
    """Keys of tokens in the gaps of the first classes; odd, too."""
    own = np.array(keys, np.uint64)
    if first.tokens:
        inner, gaps, _ = nest(keys, first)
        own ^= np.array([g.number for g in gaps], np.uint64)[inner]
    return mix64(own) | np.uint64(1)


def _region(page: Page, gaps: list[Gap], inner: list[int], classes: Classes) -> int | None:
    """The container of the page's main text, by its slots; None if none of them has enough text."""
    children: dict[int, list[int]] = {}
    text = [classes.masses[g.of][g.place] / classes.support[g.of] if g.of >= 0 else 0.0 for g in gaps]
    for k, g in enumerate(gaps):
        children.setdefault(g.parent, []).append(k)
    slot = 0
    while mine := children.get(slot):
        best = max(mine, key=lambda k: (text[k], -k))
        if text[best] < text[slot] / 2 or not text[best]:
            break
        slot = best
    if not slot or text[slot] < SLOT_SHARE * classes.largest():
        return None
    elements = page.elements

    def chain(e: int) -> list[int]:
        out = [e]
        while (e := elements[e].parent) >= 0:
            out.append(e)
        return out[::-1]

    around = [chain(e) for lo, hi in gaps[slot].spans for e in (page.after[lo], page.before[hi])]
    depth = 0
    while all(len(c) > depth + 1 for c in around) and len({c[depth + 1] for c in around}) == 1:
        depth += 1
    path = around[0][: depth + 1]
    for tag in ("article", "main"):
        if tag in (tags := [elements[e].tag for e in path]):
            return path[len(tags) - 1 - tags[::-1].index(tag)]
    region = path[-1]
    headings = [e for k, e in enumerate(page.before) if page.tags[k] in ("h1", "h2")]
    if elements[region].tag in ("", "html", "body"):  # the slot is in several containers: the one with half its text
        size: Counter[int] = Counter()
        for at, t in enumerate(page.texts):
            if t and inner[at] == slot:
                own = chain(page.before[at])
                if region in own:
                    size[own[min(own.index(region) + 1, len(own) - 1)]] += len(t.strip()) * elements[own[-1]].weight
        best = max(size, key=lambda e: (size[e], -e), default=region)
        return best if 2 * size[best] >= size.total() else region
    up = elements[region].parent
    if up > 0 and elements[up].tag not in ("html", "body") and up in headings and region not in headings:
        return up
    return region


def _by_slots(page: Page, template: Template) -> set[int] | None:
    """The text runs of the main text by the template; None if it doesn't fit the page."""
    keys = told_apart(page.keys, template.first).tolist()
    inner, gaps, valid = nest(keys, template.second)
    region = _region(page, gaps, inner, template.second)
    if region is None:
        return None
    elements, tokens, support = page.elements, template.second.tokens, template.second.support
    dropped: list[bool | None] = []  # None: outside the region
    for k, e in enumerate(elements):
        up = dropped[e.parent] if e.parent >= 0 else None
        if k == region:
            dropped.append(False)
        elif up is None:
            dropped.append(None)
        else:  # a name alone says nothing where the template has no such part
            dropped.append(up or e.by_tag or (e.by_word and keys[e.opening] in tokens))

    def is_template(k: int, share: float) -> bool:
        place = tokens.get(keys[k])
        return place is not None and place[0] in valid and support[place[0]] >= share * template.bodies

    chosen = {k for k, t in enumerate(page.texts) if t and dropped[page.before[k]] is False}
    if elements[region].main:
        many = template.bodies >= CONSTANT_PAGES
        return {k for k in chosen if page.prose[k] or not (many and is_template(k, CONSTANT_SHARE))}
    return {k for k in chosen if not is_template(k, TEXT_SHARE)}


def _by_roles(page: Page) -> set[int]:
    """The text runs of the main text by tags and names alone."""
    elements = page.elements
    boilerplate: list[bool] = []
    for e in elements:
        boilerplate.append(e.by_tag or e.by_word or (e.parent >= 0 and boilerplate[e.parent]))
    slots = [k for k, t in enumerate(page.texts) if t and not boilerplate[page.before[k]]]
    if any(e.main for e in elements):
        return {k for k in slots if elements[page.before[k]].main}
    size: Counter[int] = Counter()
    for k in slots:
        size[elements[page.before[k]].role] += len(page.texts[k].strip())
    if not size:
        return set()
    best = max(size, key=lambda r: (size[r], r))
    inside = [False] * len(elements)
    for k, e in enumerate(elements):
        inside[k] = e.role == best or (e.parent >= 0 and inside[e.parent])
    return {k for k in slots if inside[page.before[k]]}


def main_text(page: str, template: Template | None = None) -> str:
    """The main text's blocks, one a line; empty if there is none."""
    found = parse(page)
    chosen = _by_slots(found, template) if template is not None and template.second.tokens else None
    if chosen is None:
        chosen = _by_roles(found)
    blocks: list[list[str]] = [[]]
    for k, tag in enumerate(found.tags):
        if tag:
            if tag.lstrip("/") in BLOCKS:
                blocks.append([])
            elif tag == "br":
                blocks[-1].append(" ")
        elif k in chosen:
            blocks[-1].append(found.texts[k])
    lines = (_SPACE.sub(" ", html_lib.unescape("".join(b))).strip() for b in blocks if b)
    return "\n".join(x for x in lines if x)


#: A token of a page: its key and its text's weighted length.
_TOKEN = np.dtype([("key", "<u8"), ("n", "<i4")])
_SUMS = "host string, key long, low long, high long, bodies long, times long, place long, before long, own long"


def _grouped(order: np.ndarray, *by: np.ndarray) -> np.ndarray:
    """First places, in this order, of runs of equal values."""
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in by])
    return np.flatnonzero(new)


def _sums(hosts: list[str], bodies: list[int], copies: list[int], pages: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """What a batch's bodies add to the sums of their hosts' tokens; the key 0 has the bodies, and its times the pages."""
    names = sorted(set(hosts))
    number = {h: k for k, h in enumerate(names)}
    host = np.array([number[h] for h in hosts], np.int64)
    sizes = np.array([len(k) for k, _ in pages], np.int64)
    keys = np.concatenate([k for k, _ in pages])
    own = np.concatenate([n for _, n in pages]).astype(np.int64)
    page = np.repeat(np.arange(len(pages)), sizes)
    ends = np.cumsum(sizes)
    at = np.arange(len(keys)) - (ends - sizes)[page]
    before = np.cumsum(own) - own
    before -= np.append(before, 0)[np.minimum(ends - sizes, len(keys))][page] if len(keys) else 0
    order = np.lexsort((at, keys, page))
    first = _grouped(order, page, keys) if len(keys) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(order)))
    lead = order[first]
    of = page[lead]
    hashes = mix64(np.array(bodies, np.int64).view(np.uint64)[of] ^ mix64(times.astype(np.uint64)))
    columns = [
        (hashes & np.uint64(0xFFFFFFFF)).astype(np.int64), (hashes >> np.uint64(32)).astype(np.int64), np.ones(len(of), np.int64), times,
        (at[lead] << 20) // np.maximum(sizes[of], 1), np.add.reduceat(before[order], first) if len(first) else before, np.add.reduceat(own[order], first) if len(first) else own,
    ]
    none = np.zeros(len(hosts), np.int64)
    columns = [np.concatenate((c, x)) for c, x in zip(columns, (none, none, none + 1, np.array(copies, np.int64), none, none, none))]
    key, host = np.concatenate((keys[lead], none.view(np.uint64))), np.concatenate((host[of], host))
    order = np.lexsort((key, host))
    first = _grouped(order, host, key)
    out = [np.add.reduceat(c[order], first) for c in columns]
    lead = order[first]
    return pa.RecordBatch.from_arrays([pa.array([names[k] for k in host[lead]], pa.string()), pa.array(key[lead].view(np.int64)), *(pa.array(c, pa.int64()) for c in out)], names=[f.split()[0] for f in _SUMS.split(", ")])


def _classes(counted: DataFrame, least_pages: int, least_share: float) -> DataFrame:
    """host, pages, bodies, classes: each class's support, keys in order and text in the gaps after them."""
    low = F.sum("low")
    # sums of 32 bits each, so that adding them up can't overflow
    tokens = counted.groupBy("host", "key").agg(F.pmod(low, F.lit(1 << 32)).alias("low"), F.sum("high").alias("high"), *(F.sum(c).alias(c) for c in ("bodies", "times", "place", "before", "own")))
    tokens = cut(tokens.where((F.col("key") == 0) | (F.col("bodies") >= least_pages)))  # read twice
    hosts = tokens.where("key = 0").select("host", F.col("bodies").alias("all_bodies"), F.col("times").alias("all_pages"))
    frequent = tokens.where((F.col("key") != 0) & (F.col("bodies") >= least_pages)).join(hosts, "host").where(F.col("bodies") >= least_share * F.col("all_bodies"))
    member = F.struct("place", "key", "before", "own")
    classes = frequent.groupBy("host", "low", "high", "bodies", "times").agg(F.first("all_pages").alias("all_pages"), F.first("all_bodies").alias("all_bodies"), F.sort_array(F.collect_list(member)).alias("m"))
    # the text before the next token but after this one; the last has no gap
    masses = F.transform(F.slice("m", F.lit(2), F.size("m") - 1), lambda x, k: x["before"] - F.get("m", k)["before"] - F.get("m", k)["own"])
    of_class = F.struct(F.col("bodies").alias("support"), "low", "high", "times", F.col("m.key").alias("keys"), masses.alias("masses"))
    return classes.groupBy("host").agg(F.first("all_pages").alias("pages"), F.first("all_bodies").alias("bodies"), F.sort_array(F.collect_list(of_class), asc=False).alias("classes"))


def large_of(pages_col: str, total: int) -> F.Column:
    """Hosts with so many of all pages that there are only ``1 / HOT_SHARE`` of them at most."""
    return F.col(pages_col) >= HOT_SHARE * total


def with_templates(rows: DataFrame, templates: DataFrame, salt: F.Column) -> DataFrame:
    """``rows`` with their host's template, or nulls; ``templates`` has host, pages and other columns.

    Templates of the few hosts with most pages are broadcast. Pages of other large hosts, ``1 / WARM_SHARE`` of
    them at most, are dealt over ``SALTS`` keys each, and so are copies of their templates.
    """
    total = templates.agg(F.sum("pages")).first()[0] or 0
    hot = F.broadcast(templates.where(large_of("pages", total)))
    cold = templates.where(~large_of("pages", total))
    warm = (F.col("pages") >= WARM_PAGES) & (F.col("pages") >= WARM_SHARE * total)
    salts = F.when(warm, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = F.broadcast(cold.where(warm).select("host", F.lit(SALTS).alias("__salts")))
    others = rows.join(hot.select("host"), "host", "left_anti").join(dealt, "host", "left").withColumn("__salt", F.pmod(salt, F.coalesce("__salts", F.lit(1))).cast("int")).drop("__salts")
    found = others.join(cold.select("*", F.explode(salts).alias("__salt")), ["host", "__salt"], "left").drop("__salt")
    return rows.join(hot, "host").unionByName(found)


def deduce_templates(pages: DataFrame, url_col: str = "url", html_col: str = "html", id_col: str = "page_id", least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """host, pages, bodies, first and second: the host's frequent classes, before and after roles are told apart.

    Hosts with no frequent token have no row; rows without a host share one template under the empty host.
    Supports are bodies. A host's template is bounded by ``1 / least_share`` bodies' worth of tokens, whatever
    the number of pages. Pages are parsed once; their packed tokens are read again for the second classes.
    """
    small_batches(pages.sparkSession)
    src = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, bodies, packed = [], [], []
            for url, page in zip(*(batch.column(c).to_pylist() for c in ("url", "html"))):
                found = parse(page or "")
                tokens = np.zeros(len(found.keys), _TOKEN)
                tokens["key"], tokens["n"] = np.array(found.keys, np.uint64), found.weights()
                hosts.append(split_url(url)[0])
                bodies.append(body_of(found))
                packed.append(tokens.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(bodies, pa.int64()), pa.array(packed, pa.binary())], names=["host", "body", "tokens"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Classes] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            hosts, bodies, packed, copies = (batch.column(c).to_pylist() for c in ("host", "body", "tokens", "copies"))
            found = []
            for k, data in enumerate(packed):
                tokens = np.frombuffer(data, _TOKEN)
                keys = tokens["key"]
                if "classes" in batch.schema.names:
                    if hosts[k] not in known:
                        if len(known) >= MOST_TEMPLATES:
                            known.clear()
                        known[hosts[k]] = Classes.of(batch.column("classes")[k].as_py() or ())
                    keys = told_apart(keys.tolist(), known[hosts[k]])
                found.append((keys, tokens["n"]))
            yield _sums(hosts, bodies, copies, found)

    parsed = src.mapInArrow(read, "host string, body long, tokens binary")
    distinct = cut(parsed.groupBy("host", "body").agg(F.min("tokens").alias("tokens"), F.count(F.lit(1)).alias("copies")))
    first = cut(_classes(distinct.mapInArrow(count, _SUMS), least_pages, least_share))
    joined = with_templates(distinct, first.select("host", "pages", "classes"), F.col("body")).select("host", "body", "tokens", "copies", "classes")
    second = _classes(joined.mapInArrow(count, _SUMS), least_pages, least_share)
    return first.select("host", "pages", "bodies", F.col("classes").alias("first")).join(second.select("host", F.col("classes").alias("second")), "host")


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", id_col: str = "page_id", keep: Sequence[str] | None = None) -> DataFrame:
    """``keep`` columns (all but the HTML, if None), text and n_chars (code points) of every page.

    Null HTML is an empty page; pages without main text have an empty one. Character references are
    decoded, white space inside a block is one space, blocks are joined by one newline in page order.
    Repeated rows stay; an empty table gives no rows; columns of ``pages`` named text or n_chars are replaced.
    """
    small_batches(pages.sparkSession)
    templates = cut(deduce_templates(pages, url_col, html_col, id_col))
    keep = [c for c in (pages.columns if keep is None else keep) if c not in (html_col, "text", "n_chars")]
    own = [f"__c{k}" for k in range(len(keep))]  # no name of theirs clashes with the template's
    host = F.coalesce(F.translate(F.regexp_extract(F.col(url_col), "(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))
    src = pages.select(*[F.col(c).alias(x) for c, x in zip(keep, own)], F.col(html_col).alias("__html"), host.alias("host"))
    src = with_templates(src, templates, F.xxhash64("__html")).select(*own, "__html", "host", "bodies", "first", "second")
    schema = T.StructType([*pages.select(*keep).schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Template] = {}
        for batch in batches:
            texts = []
            bodies, first, second = (batch.column(c) for c in ("bodies", "first", "second"))
            for k, (page, host) in enumerate(zip(batch.column("__html").to_pylist(), batch.column("host").to_pylist())):
                if not bodies[k].is_valid:
                    texts.append(main_text(page or ""))
                    continue
                if host not in known:
                    if len(known) >= MOST_TEMPLATES:
                        known.clear()
                    known[host] = Template(Classes.of(first[k].as_py()), Classes.of(second[k].as_py()), bodies[k].as_py())
                texts.append(main_text(page or "", known[host]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return src.mapInArrow(work, schema)
