"""Main text of web pages by a tree-structured graphical model.

Block elements of a page form a tree; each has a hidden label, content or not. The joint probability
is a product of a potential per element (its tag, the amount of its own text, how much of that is
links, how it ends) and one per parent and child. Content is closed upwards: below an element that is
not content nothing is. Messages go up the tree (for each element, the likelihood of its subtree under
either label) and down again (which turn likelihoods into marginals); an element whose marginal
reaches a half gives its text.

Potentials are trained by counting on labelled pages: where a page marks its article, elements inside
are content, marked boilerplate and everything else is not. A marked article is evidence, in training and
afterwards. So are known markers of menus, notices, adverts, forms, comments and the like, but not on an
element that holds the page's main article or, without one, most of its text (nor on html and body): there
a marker is one more feature with a learned potential, and the marginals decide. Pages are independent.

The parser reads a page once from front to back, whatever its markup: no quote, comment or missing end
tag makes it look at a stretch twice, and open elements are found by name.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled pages the potentials are counted on (those of smallest hash).
TRAINING_PAGES = 2_000

#: Kinds of HTML elements.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
#: Boilerplate that stands inside a line of text, and the part of it that ends where a block begins.
_OBJECTS = frozenset("button select option optgroup datalist noscript template svg math object canvas audio video".split())
_NO_BLOCKS = frozenset("select option optgroup datalist canvas".split())
_BOILERPLATE_TAGS = frozenset("nav header footer aside form menu dialog head fieldset".split()) | _OBJECTS
_ARTICLE_TAGS = frozenset(("article", "main"))
_KNOWN_TAGS = frozenset(
    "html body div section article main p li ul ol dl dt dd h1 h2 h3 h4 h5 h6 blockquote pre table tr td th tbody figure figcaption".split()
)
_CLOSES_P = _KNOWN_TAGS - {"html", "body", "td", "th", "tr", "tbody"} | _BOILERPLATE_TAGS - _OBJECTS | {"hr", "address", "details"}
_KEEPS_P = ("td", "th", "table", *_OBJECTS)
_SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Words in class, id or role that mark boilerplate.
_MARKERS = frozenset(
    "ad ads advert advertisement advertising adverts banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe subscription paywall sidebar side menu nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead topbar toolbar comment comments commentlist disqus reply replies respond share sharing social related "
    "recommended widget login signin signup search pagination pager skip copyright disclaimer complementary contentinfo".split()
)

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*+)")
_QUOTED = re.compile(r"=\s*+([\"'])|>")
_COMMENT_END = re.compile(r"--!?>")
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
_WORD = re.compile(r"[A-Za-z]+")
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.IGNORECASE)


class Element:
    __slots__ = ("tag", "parent", "marked", "soft", "texts", "chars", "linked", "last", "children", "inside", "dead")

    def __init__(self, tag: str, parent: int, marked: bool):
        self.tag, self.parent, self.marked = tag, parent, marked
        self.soft = False  # its marker is a feature, not evidence
        self.texts: list[int] = []  # numbers of its text blocks
        self.chars = self.linked = 0
        self.last = ""
        self.children: list[int] = []
        self.inside = False  # of an article
        self.dead = marked  # it, or an element around it, is marked


def _marked(tag: str, attributes: str) -> bool:
    if tag in _BOILERPLATE_TAGS:
        return True
    if not attributes:
        return False
    for _, value in _ATTRIBUTE.findall(attributes):
        for name in value.strip("\"'").replace("_", "-").lower().split():
            parts = _WORD.findall(name)
            if any(part in _MARKERS for part in parts):
                return True
    return bool(_HIDDEN.search(attributes))


class _Tags:
    """Where the tags of a page end; every stretch is searched once."""

    def __init__(self, page: str):
        self.page = page
        self.gone: set[str] = set()  # characters, and ends of raw elements, that do not come any more
        self.plain = False  # quotes no longer count

    def end(self, at: int) -> int:
        """The place of the ``>`` that ends a tag, outside quoted values where that can be; else -1."""
        start = at
        while not self.plain:
            found = _QUOTED.search(self.page, at)
            if found is None:
                self.plain = True
            elif found.group(1) is None:
                return found.start()
            else:
                at = found.end()
                shut = -1 if found.group(1) in self.gone else self.page.find(found.group(1), at)
                if shut < 0:
                    self.gone.add(found.group(1))
                else:
                    at = shut + 1
        return self.find(">", start)

    def find(self, text: str, at: int) -> int:
        found = -1 if text in self.gone else self.page.find(text, at)
        if found < 0:
            self.gone.add(text)
        return found

    def raw_end(self, tag: str, at: int) -> int:
        """Behind the end tag of a raw element, or -1."""
        if f"</{tag}" in self.gone:
            return -1
        found = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.IGNORECASE).search(self.page, at)
        if found is None:
            self.gone.add(f"</{tag}")
            return -1
        shut = self.find(">", found.end())
        return len(self.page) if shut < 0 else shut + 1


class _Builder:
    """Elements, the open ones among them (innermost last, and by tag), and the text of the line at hand."""

    def __init__(self) -> None:
        self.elements = [Element("html", -1, False)]
        self.blocks: list[tuple[int, str]] = []
        self.stack = [0]
        self.places: dict[str, list[int]] = {}
        self.pieces: list[str] = []
        self.links = self.linked = 0
        self.held: dict[int, tuple[list[str], int]] = {}  # lines that go on behind an object in them

    def add(self, raw: str) -> None:
        if raw:
            text = html.unescape(raw)
            self.pieces.append(text)
            if self.links:
                self.linked += len(text)

    def flush(self) -> None:
        """The line ends, and is a block of the innermost element."""
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            self.pieces = []
            if text:
                owner = self.elements[self.stack[-1]]
                owner.texts.append(len(self.blocks))
                owner.chars += len(text)
                owner.linked += min(self.linked, len(text))
                owner.last = text[-1]
                self.blocks.append((self.stack[-1], text))
        self.linked = 0

    def open(self, tag: str, marked: bool, in_line: bool, closed: bool) -> None:
        number = len(self.elements)
        if in_line:
            self.held[number] = self.pieces, self.linked
            self.pieces, self.linked = [], 0
        self.elements.append(Element(tag, self.stack[-1], marked))
        self.elements[self.stack[-1]].children.append(number)
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append(number)
        if closed:
            self._close_to(len(self.stack) - 1)

    def is_open(self, tag: str) -> bool:
        return bool(self.places.get(tag))

    def close(self, tags: Iterable[str], stop: Iterable[str] = ()) -> None:
        """Close the innermost open element of ``tags`` with all inside it, unless one of ``stop`` is open
        further in."""
        innermost = max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)
        if innermost and not any(self.places[t][-1] > innermost for t in stop if self.places.get(t)):
            self._close_to(innermost)

    def _close_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.flush()
            number = self.stack.pop()
            self.places[self.elements[number].tag].pop()
            if number in self.held:
                self.pieces, self.linked = self.held.pop(number)

    def end(self) -> None:
        self._close_to(1)
        self.flush()


def parse(page: str) -> tuple[list[Element], list[tuple[int, str]]]:
    """Block elements in page order, the first being the root, and text blocks ``(element, text)``
    with character references decoded and white space settled."""
    tags, built = _Tags(page), _Builder()
    at = text_from = 0
    n = len(page)
    while at < n:
        start = page.find("<", at)
        if start < 0 or start + 1 >= n:
            break
        after = page[start + 1]
        if after == "!" or after == "?":
            built.add(page[text_from:start])
            if page.startswith("<!--", start):
                found = None if "-->" in tags.gone else _COMMENT_END.search(page, start + 4)
                at = n if found is None else found.end()
            elif page.startswith("<![CDATA[", start):
                shut = tags.find("]]>", start + 9)
                at = n if shut < 0 else shut + 3
                built.add(html.escape(page[start + 9:n if shut < 0 else shut]))
            else:
                shut = tags.find(">", start)
                at = n if shut < 0 else shut + 1
            text_from = at
            continue
        found = _NAME.match(page, start + 1)
        if found is None:
            at = start + 1  # a bare "<" is text
            continue
        end = tags.end(found.end())
        if end < 0:
            break  # no tag ends any more: the rest is text
        built.add(page[text_from:start])
        at = text_from = end + 1
        tag, attributes = found.group(1).lower(), page[found.end():end]
        if after == "/":
            if tag == "a":
                built.links = max(0, built.links - 1)
            if tag in _INLINE or tag in _OBJECTS:
                built.close((tag,))
            elif tag not in _VOID:
                built.flush()
                built.close((tag,))
            continue
        closed = attributes.endswith("/") and (tag in _OBJECTS or tag == "iframe")
        if tag in _RAW:
            behind = -1 if closed else tags.raw_end(tag, at)
            if behind >= 0 or tag in ("script", "style"):
                at = text_from = n if behind < 0 else behind
            continue
        if tag == "a":
            built.links += 1
        if tag in _VOID:
            if tag == "br":
                built.pieces.append(" ")
            elif tag == "hr":
                built.flush()
            continue
        marked = _marked(tag, attributes)
        in_line = tag in _INLINE or tag in _OBJECTS
        if tag in _INLINE and not marked and not built.is_open(tag):
            continue
        if not in_line:
            built.flush()
        if tag == "html":
            continue
        if tag == "body":
            built.close(("head",))
        if tag in _CLOSES_P:
            built.close(("p",), _KEEPS_P)
        while tag in _KNOWN_TAGS and any(map(built.is_open, _NO_BLOCKS)):
            built.close(_NO_BLOCKS)
        if tag in _SAME_CLOSES:
            built.close(_SAME_CLOSES[tag], ("ul", "ol", "dl", "table"))
        built.open(tag, marked, in_line, closed)
    built.add(page[text_from:])
    built.end()
    return built.elements, built.blocks


def _features(e: Element) -> list[str]:
    size = 0 if not e.chars else 1 + min(6, int(math.log2(e.chars) / 1.5))
    share = 0 if not e.linked else 1 + int(2.99 * e.linked / max(e.chars, 1))
    ends = "none" if not e.last else "stop" if e.last in ".!?:;\"'”»…" else "open"
    known = e.tag in _KNOWN_TAGS or e.tag in _BOILERPLATE_TAGS
    return [f"tag={e.tag if known else 'other'}", f"size={size}", f"links={share}", f"ends={ends}", f"marker={int(e.marked)}"]


def _group(e: Element) -> str:
    return "article" if e.tag in _ARTICLE_TAGS else "inner" if e.inside else "outer"


def _soften(elements: list[Element]) -> None:
    """Find the marked elements whose markers are no evidence: html and body, and those that hold the main
    article, or most of the text of a page whose articles are all marked."""
    within = [e.chars for e in elements]  # text in the whole subtree
    for i in range(len(elements) - 1, 0, -1):
        within[elements[i].parent] += within[i]
    clear = [True] * len(elements)  # no marker on it or around it
    for i, e in enumerate(elements):
        e.soft = e.tag in ("html", "body")
        clear[i] = (i == 0 or clear[e.parent]) and (not e.marked or e.soft)
    articles = [i for i, e in enumerate(elements) if e.tag in _ARTICLE_TAGS]
    if any(clear[i] and within[i] for i in articles):
        return
    at = max(articles, key=lambda i: within[i], default=0)
    if not at or 2 * within[at] < within[0]:
        at = max(i for i in range(len(elements)) if 2 * within[i] >= within[0])  # the innermost with most text
    while at > 0:
        elements[at].soft = True
        at = elements[at].parent


def _settle(elements: list[Element]) -> None:
    _soften(elements)
    for e in elements[1:]:
        up = elements[e.parent]
        e.inside = up.inside or up.tag in _ARTICLE_TAGS
        e.dead = e.marked and not e.soft or up.dead


def _is_article(e: Element) -> bool:
    return e.tag in _ARTICLE_TAGS and not e.dead


def training_counts(page: str) -> Counter:
    """What a labelled page adds to the counts; nothing for a page without a marked article."""
    elements, _ = parse(page)
    _settle(elements)
    label = [False] * len(elements)
    found = False
    for i, e in enumerate(elements):
        if not e.dead and (e.inside or e.tag in _ARTICLE_TAGS):
            label[i] = found = True
            up = e.parent
            while up >= 0 and not label[up]:
                label[up] = True
                up = elements[up].parent
    counts: Counter = Counter()
    if not found:
        return counts
    for i, e in enumerate(elements):
        y = int(label[i])
        counts[f"n|{y}"] += 1
        for f in _features(e):
            counts[f"{f}|{y}"] += 1
        if e.parent >= 0 and label[e.parent] and (e.soft or not e.marked):
            counts[f"edge={_group(elements[e.parent])}|{y}"] += 1
    return counts


class Model:
    """Log potentials from counts."""

    #: Parent and child before any count: within an article nearly all is content.
    PRIOR = {"article": (0.05, 20.0), "inner": (0.05, 20.0), "outer": (1.0, 1.0)}

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        names = {k.split("=")[0] for k in counts if "=" in k and not k.startswith("edge=")} or {"tag", "size", "links", "ends", "marker"}
        self.values = {n: max(1, len({k.split("|")[0] for k in counts if k.startswith(f"{n}=")})) for n in names}
        self.memory: dict[tuple, tuple[float, float]] = {}

    def own(self, e: Element) -> tuple[float, float]:
        """Log potentials of (not content, content)."""
        features = tuple(_features(e))
        if features not in self.memory:
            out = []
            for y in (0, 1):
                n = self.counts.get(f"n|{y}", 0)
                out.append(sum(math.log((self.counts.get(f"{f}|{y}", 0) + 1) / (n + self.values.get(f.split("=")[0], 1) + 1)) for f in features))
            self.memory[features] = (out[0], out[1])
        return self.memory[features]

    def edge(self, parent: Element) -> tuple[float, float]:
        group = _group(parent)
        off, on = (self.counts.get(f"edge={group}|{y}", 0) + self.PRIOR[group][y] for y in (0, 1))
        return math.log(off / (off + on)), math.log(on / (off + on))

    def marginals(self, elements: list[Element]) -> list[float]:
        """The probability of content for every element."""
        off, on = [0.0] * len(elements), [0.0] * len(elements)
        for i in range(len(elements) - 1, -1, -1):  # up: children stand behind their parents
            e = elements[i]
            a, b = self.own(e)
            off[i] = -math.inf if _is_article(e) else off[i] + a
            evidence = e.marked and not e.soft
            on[i] = -math.inf if evidence else on[i] + b
            if i and evidence:  # evidence, which tells nothing of the parent
                off[e.parent] += off[i]
                on[e.parent] += off[i]
            elif i:
                no, yes = self.edge(elements[e.parent])
                x, y = no + off[i], yes + on[i]
                top = max(x, y)
                off[e.parent] += off[i]
                on[e.parent] += top if top == -math.inf else top + math.log(math.exp(x - top) + math.exp(y - top))
        out = [1.0] * len(elements)
        for i, e in enumerate(elements[1:], 1):  # down
            no, yes = self.edge(elements[e.parent])
            if e.dead:
                out[i] = 0.0
            elif off[i] == -math.inf:
                out[i] = out[e.parent]
            else:
                out[i] = out[e.parent] / (1 + math.exp(min((no + off[i]) - (yes + on[i]), 700.0)))
        return out

    def text(self, page: str) -> str:
        elements, blocks = parse(page)
        _settle(elements)
        content = self.marginals(elements)
        return "\n\n".join(text for owner, text in blocks if content[owner] >= 0.5)


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", bound: int = TRAINING_PAGES) -> dict[str, int]:
    """Counts over ``bound`` labelled pages at most (more only where rows repeat)."""
    page = F.col(f"`{html_col}`").cast("string")
    keyed = pages.select(page.alias("html"), F.xxhash64(F.col(f"`{id_col}`"), F.length(page)).alias("h"))
    labelled = keyed.where(F.lower("html").rlike(r"<(article|main)[\s>]"))
    last = labelled.select("h").orderBy("h").limit(bound).agg(F.max("h")).first()[0]
    if last is None:
        return {}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for page in batch.column(0):
                total.update(training_counts(page.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["name", "n"])

    counted = labelled.where(F.col("h") <= last).select("html").mapInArrow(count, "name string, n long")
    return dict(map(tuple, counted.groupBy("name").agg(F.sum("n")).collect()))  # a fixed set of names


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``pages`` without ``html_col``, with ``text``: the main text, blocks joined by an empty line.

    Null and empty pages, and pages without content, give an empty text. All rows and other columns
    stay (a column ``text`` is replaced); repeated rows come out alike; an empty table stays empty.
    """
    counts = train(pages, id_col, html_col)
    own = [F.col(f"`{f.name}`") for f in pages.schema.fields if f.name not in (html_col, "text")]
    # Other columns travel in one struct, so that their names meet none of these.
    rows = pages.select(F.struct(*own).alias("row") if own else F.lit(None).alias("row"), F.col(f"`{html_col}`").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(counts)
        for batch in batches:
            texts = [model.text(p.as_py() or "") for p in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "text"])

    found = rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("text", T.StringType())]))
    return found.select("row.*", "text") if own else found.select("text")
