"""Main text of web pages by consensus of a host's pages on a container path.

Each page is read into blocks of text and the elements around them; each container
(article, div, section, ...) is named by its generalised path: tags from the root,
with class names whose digits become "#". A page scores its containers by the share
of its text that they cover, link text and boilerplate left out, and votes for the
deepest one that covers ``cover`` of it. Votes are summed per host and path in
Spark; then every page is read again and yields the text under its host's winning
path. A page that lacks this path, or has no text under it, yields its own choice.

Boilerplate is what its tag, role, class or id calls a menu, header, footer,
sidebar, notice, advert, form, script, style or reader comment; hidden elements too.
A class counts if all its parts are such names or words of place (``site-header``,
``comment-list``), so ``has-sidebar`` and ``social-science`` do not. A header inside
an article belongs to it. Where boilerplate has an article, a main or a top heading
inside and most of the page's text, or where nothing else has text, it is taken for
the page's frame (a form around the whole page) and forgiven; so is what only its
class or id calls boilerplate, other than comments, where what else the page has is
next to nothing (a page on cookies in a box of that name). A header beside
paragraphs is their headline; a button inside a sentence is part of it.

Blocks keep page order and are joined by a line feed; character references are
decoded, white space (no-break spaces included) becomes one blank, <br> is a blank.
Nothing else is dropped and nothing is cut off. Reading takes time in proportion to
the page, whatever its markup: tags whose quotes never end are read without them.

Edge cases: a null or empty page has an empty text; a null url, or one without a
host, shares the votes of the empty host; unclosed and stray tags are mended as
browsers do for paragraphs, list items and table parts; repeated rows each vote.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import durable
from .urlgraph import parts

COVER = 0.8

#: Element names of HTML by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINER = frozenset("article body center div main section td".split())
SKIPPED = frozenset("script style noscript template head title svg math iframe object audio video canvas textarea select button".split())
BOILERPLATE_TAGS = frozenset("nav header footer aside form menu dialog fieldset".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form note status".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar rail menu nav navbar navigation "
    "breadcrumb breadcrumbs header masthead topbar footer bottombar colophon cookie cookies consent gdpr notice notices notification alert popup modal "
    "overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist disqus reply "
    "replies discussion respond pagination pager toolbar widget widgets form search paywall disclaimer copyright".split()
)
#: Words of place and kind that may stand beside such a name in a class or id.
BESIDE_NAMES = frozenset(
    "site page main global top bottom left right primary secondary wrapper wrap container box area section block inner outer list item items bar button buttons "
    "link links icons icon content slot unit google user reader the sticky fixed mobile desktop left-hand right-hand col column group panel message posts".split()
)
#: An open element of the first name ends where one of the others begins.
ENDED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]),
    "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]),
}
#: Elements whose content is no markup.
RAW = frozenset("script style noscript template textarea svg math title iframe".split())
#: Names of boilerplate that are never forgiven by size.
COMMENT_NAMES = frozenset("comment comments commentlist disqus reply replies respond".split())
FRAME = 0.5
#: Next to nothing: so small a share of a page's text, without a block of so many words, a heading, an article or a main.
SCRAP, SENTENCE = 0.2, 8

#: A tag whose quoted values hold no angle brackets; others are read by ``_end_of_tag``.
_PLAIN_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"<>]*"|'[^'<>]*')*)>""")
_TAG_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_STEP = re.compile(r"""[^"'>]*""")
_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(r"\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def tags(source: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(begin, end, name, closes, attributes) of every tag; comments, declarations and raw elements have an empty name. Linear in the source."""
    at, n, quoted = 0, len(source), True
    while (begin := source.find("<", at)) >= 0:
        m = _PLAIN_TAG.match(source, begin)
        if m is None:
            if source.startswith("<!--", begin):
                if source.startswith((">", "->"), begin + 4):  # ends at once
                    at = source.index(">", begin) + 1
                else:
                    end = source.find("-->", begin + 4)
                    at = n if end < 0 else end + 3
                yield begin, at, "", False, ""
                continue
            if source.startswith(("<!", "<?"), begin):
                end = source.find(">", begin)
                at = n if end < 0 else end + 1
                yield begin, at, "", False, ""
                continue
            if (named := _TAG_NAME.match(source, begin)) is None:
                at = begin + 1
                continue
            end = _end_of_tag(source, named.end()) if quoted else -1
            if end < 0:  # a quote that never ends: from here on quotes mean nothing
                quoted, end = False, source.find(">", begin)
            at = n if end < 0 else end + 1
            closes, name, attributes = source[begin + 1] == "/", named[1].lower(), source[named.end() : at - 1]
        else:
            at, closes, name, attributes = m.end(), m[1] == "/", m[2].lower(), m[3]
        if name in RAW and not closes and not (name in ("svg", "math") and attributes.endswith("/")):
            ended = _ENDS[name].search(source, at)
            at = ended.end() if ended else n
            yield begin, at, "", False, ""
        else:
            yield begin, at, name, closes, attributes


def _end_of_tag(source: str, at: int) -> int:
    """Where the tag ends whose attributes begin at ``at``, quoted values skipped; -1 if it does not."""
    while (at := _STEP.match(source, at).end()) < len(source) and source[at] != ">":
        at = source.find(source[at], at + 1) + 1
        if not at:
            return -1
    return at if at < len(source) else -1


def step_of(name: str, attributes: str) -> str:
    """An element's part of a path: its name and its classes, digits as "#"."""
    out = name
    for a in _ATTRIBUTE.finditer(attributes) if "=" in attributes else ():
        if a[1].lower() == "class":
            out += "".join("." + c for c in sorted(_DIGITS.sub("#", (a[2] or a[3] or a[4] or "").replace("/", "_")).split()))
    return out


def _called_boilerplate(value: str) -> str:
    """Whether one of the names in a class or id is boilerplate's: "", "named", or "comment"."""
    for token in value.split():
        parts = [x.lower() for x in _NAME.findall(token)]
        if any(x in BOILERPLATE_NAMES for x in parts) and all(x in BOILERPLATE_NAMES or x in BESIDE_NAMES for x in parts):
            return "comment" if any(x in COMMENT_NAMES for x in parts) else "named"
    return ""


class Page:
    """Blocks of text, each with its element, whether it is boilerplate, and its length in links."""

    def __init__(self, source: str):
        self.tag, self.parent, self.step, self.path_key = [""], [-1], [""], [hash(())]
        self.own_noise, self.noise, self.by_name = [False], [False], [False]
        self.blocks: list[tuple[str, int, int]] = []
        self._parts: list[str] = []
        self._linked, self._bare = 0, True
        self._read(source)
        self._settle_noise()

    def _read(self, source: str) -> None:
        stack, at = [0], 0
        open_, held = defaultdict(int), defaultdict(int)  # how many of each name are open: blocks, and elements inside the block
        inline: list[str] = []
        links = skipped = pressed = 0
        for begin, end, name, closes, attributes in tags(source):
            if begin > at and not skipped:
                self._text(source[at:begin], links, pressed)
            at = end
            if not name:
                continue
            if name in BLOCK:
                if closes and not open_[name]:
                    continue
                self._flush(stack[-1])
                if inline:
                    inline, held, links, skipped, pressed = [], defaultdict(int), 0, 0, 0
                if closes:
                    while (last := self.tag[stack.pop()]) != name:
                        open_[last] -= 1
                    open_[name] -= 1
                    continue
                while (last := self.tag[stack[-1]]) == "p" or (last in ENDED_BY and name in ENDED_BY[last]):
                    open_[last] -= 1
                    stack.pop()
                if name not in VOID:
                    stack.append(self._open(stack[-1], name, attributes))
                    open_[name] += 1
            elif not closes:
                if name == "br":
                    self._parts.append(" ")
                elif name not in VOID and not (name in SKIPPED and attributes.rstrip().endswith("/")):
                    held[name] += 1
                    links += name == "a"
                    pressed += name == "button"
                    skipped += self._hides(name, stack[-1])
                    inline.append(name)
            elif held[name]:
                while True:
                    last = inline.pop()
                    held[last] -= 1
                    links -= last == "a"
                    pressed -= last == "button"
                    skipped -= self._hides(last, stack[-1])
                    if last == name:
                        break
        if at < len(source) and not skipped:
            self._text(source[at:], links, pressed)
        self._flush(stack[-1])

    def _hides(self, name: str, element: int) -> bool:
        """Whether an inline element's content is left out; a paragraph may name a button."""
        return name in SKIPPED and not (name == "button" and self.tag[element] == "p")

    def _text(self, raw: str, links: int, pressed: int) -> None:
        text = unescape(raw) if "&" in raw else raw
        self._parts.append(text)
        if links:
            self._linked += len(text)
        if self._bare and not pressed and not text.isspace():
            self._bare = False

    def _flush(self, element: int) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            if text and not self._bare:  # a block of buttons only is none
                self.blocks.append((text, element, self._linked))
            self._parts, self._linked, self._bare = [], 0, True

    def _open(self, parent: int, name: str, attributes: str) -> int:
        noise, step, called = name in BOILERPLATE_TAGS, name, ""
        if "=" in attributes or "hidden" in attributes:
            step = step_of(name, attributes)
            for a in _ATTRIBUTE.finditer(attributes):
                key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                if key in ("class", "id"):
                    if name not in ("article", "main"):
                        called = max(called, _called_boilerplate(value), key=("", "named", "comment").index)
                elif key == "role":
                    noise = noise or value.lower() in BOILERPLATE_ROLES
                elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and _HIDDEN.search(value)):
                    noise = True
        self.tag.append(name)
        self.parent.append(parent)
        self.step.append(step if name != "html" else "")
        self.path_key.append(self.path_key[parent] if name == "html" else hash((self.path_key[parent], step)))
        self.own_noise.append((noise or called != "") and name not in ("html", "body"))
        self.by_name.append(called == "named" and not noise)
        return len(self.tag) - 1

    def _settle_noise(self) -> None:
        """Which elements are boilerplate, all told."""
        if not any(self.own_noise):
            self.noise = self.own_noise
            return
        n, tag, parent = len(self.tag), self.tag, self.parent
        size, frames, inside = [0] * n, [x in ("article", "main", "h1") for x in tag], [x == "article" for x in tag]  # inside: in an article
        for text, element, _ in self.blocks:
            size[element] += len(text)
        for k in range(n - 1, 0, -1):
            size[parent[k]] += size[k]
            if frames[k]:
                frames[parent[k]] = True
        for k in range(1, n):
            if inside[parent[k]]:
                inside[k] = True
        holds = [False] * n  # whether one stands below the element itself
        for k in range(1, n):
            if frames[k]:
                holds[parent[k]] = True
        self.noise = list(self.own_noise)
        said = [False] * n  # whether a paragraph stands right below
        for _, element, _ in self.blocks:
            if tag[element] == "p":
                said[parent[element]] = True
        headed = {parent[element] for _, element, _ in self.blocks if tag[element] in ("h1", "h2")}
        for k in range(1, n):
            headline = tag[k] == "header" and (inside[k] or (k in headed and said[parent[k]] and tag[parent[k]] not in ("", "html", "body")))
            if self.own_noise[k] and ((holds[k] and size[k] >= FRAME * size[0]) or headline):
                self.own_noise[k] = self.noise[k] = False
            if self.noise[parent[k]]:
                self.noise[k] = True
        clean = [(text, element) for text, element, _ in self.blocks if not self.noise[element]]
        if self.blocks and not clean:
            # All is boilerplate: a form or a notice that has the most of it frames the page.
            self._forgive([self.own_noise[k] and tag[k] not in ("nav", "menu", "footer") and size[k] >= FRAME * size[0] for k in range(n)])
        elif sum(len(text) for text, _ in clean) < SCRAP * size[0] and not any(text.count(" ") + 1 >= SENTENCE or tag[k] in HEADINGS or self._framed(k) for text, k in clean):
            self._forgive([self.by_name[k] and said[k] and size[k] >= FRAME * size[0] for k in range(n)])

    def _framed(self, k: int) -> bool:
        """Whether an article or main is around an element."""
        return any(self.tag[x] in ("article", "main") for x in (k, *self._ancestors(k)))

    def _forgive(self, frames: list[bool]) -> None:
        """Boilerplate anew, but for what is taken for the page's frame."""
        for k in range(1, len(self.tag)):
            self.noise[k] = (self.own_noise[k] and not frames[k]) or self.noise[self.parent[k]]

    def path_of(self, k: int) -> str:
        """The generalised path of an element."""
        steps = [self.step[x] for x in (k, *self._ancestors(k)) if x > 0 and self.step[x]]
        return "".join("/" + x for x in reversed(steps))

    def best(self) -> int:
        """The deepest container that covers enough of the text, or the article around it; 0 (the whole page) if none does."""
        own, heads = [0] * len(self.tag), [0] * len(self.tag)
        for text, element, linked in self.blocks:
            if not self.noise[element]:
                own[element] += max(0, len(text) - linked)
                heads[element] += max(0, len(text) - linked) * (self.tag[element] in HEADINGS)
        for k in range(len(own) - 1, 0, -1):
            own[self.parent[k]] += own[k]
            heads[self.parent[k]] += heads[k]
        out = 0
        for k in range(1, len(own)):  # a child comes after its parent
            if own[k] and own[k] >= COVER * own[0] and self.tag[k] in CONTAINER:
                out = k
        above = [k for k in self._ancestors(out) if self.tag[k] == "article"]
        if above:
            return above[-1]
        for k in self._ancestors(out):  # a headline beside the container belongs to it
            more = own[k] - own[out]
            if k == 0 or self.tag[k] == "body" or more != heads[k] - heads[out]:
                break
            if more:
                out = k
        return out

    def _ancestors(self, k: int) -> Iterator[int]:
        while k > 0:
            k = self.parent[k]
            yield k

    def under(self, wanted: set[int]) -> str:
        inside = [False] * len(self.tag)
        for k in range(len(inside)):
            inside[k] = k in wanted or (k > 0 and inside[self.parent[k]])
        return "\n".join(text for text, element, _ in self.blocks if inside[element] and not self.noise[element])

    def main_text(self, path: str | None) -> str:
        """The text under ``path``, or under the page's own choice."""
        key = self.path_key[0]
        for step in path.split("/")[1:] if path else ():
            key = hash((key, step))
        wanted = {k for k in range(1, len(self.tag)) if self.path_key[k] == key} if path else set()
        return (self.under(wanted) if wanted else "") or self.under({self.best()})

    def visible_text(self) -> str:
        """All blocks, boilerplate included."""
        return "\n".join(b[0] for b in self.blocks)


def vote(pages: DataFrame) -> DataFrame:
    """(host, path): the path that most pages of each host choose; ties go to the longer, then the greater."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = []
            for source in b.column(1).to_pylist():
                page = Page(source or "")
                paths.append(page.path_of(page.best()) or None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(paths, pa.string())], ["host", "path"])

    votes = pages.select(parts(F.col("url"))[0].alias("host"), "html").mapInArrow(run, "host string, path string")
    counted = votes.where("path is not null").groupBy("host", "path").count()
    return counted.groupBy("host").agg(F.max_by("path", F.struct("count", F.length("path"), "path")).alias("path"))


def extract(pages: DataFrame, most_bytes: int = 32 << 20) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    winners = durable(vote(pages))
    size = winners.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + 16), F.lit(0))).first()[0]
    if size <= most_bytes:  # else pages are dealt by host, and adaptive execution splits large ones
        winners = F.broadcast(winners)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [Page(source or "").main_text(path) for source, path in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    some = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", parts(F.col("url"))[0].alias("host"))
    joined = some.join(winners, "host", "left").select("page_id", "url", "html", "path")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every row of ``pages``."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
