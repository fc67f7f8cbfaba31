"""Main text of web pages by consensus paths of their hosts.

First pass: each page's containers are scored by the text they hold, and the
best one's generalised path (tags and classes, digits made equal) is its page's
vote.  Votes are added per batch, then per host, so a host with a third of all
pages sends few rows.  Second pass: each page is extracted again from the
containers on its host's winning path; a page without such a container uses its
own best one.
"""

from __future__ import annotations

import functools
import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import Scratch

#: What an opening angle bracket starts: a comment, a section of characters, a declaration, or a tag's name.
START = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)", re.S)
PLAIN = re.compile(r"[^>\"']*+")
#: One attribute: its name, and a value after an equals sign; attributes are read one after another, values never searched.
ATTRIBUTE = re.compile(r"([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>]++)))?+")
SPACE = re.compile(r"\s+")

# Element names of the HTML standard by their part in the page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript template svg math select".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: An opening element ends open ones of these names, up to the names that hold them.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
DROPPED = set("head nav footer aside button dialog menu object canvas audio video map".split())
CONTAINERS = set("body main article section div td".split())
#: Words in classes and ids of what is not the article.
ASIDE = set(
    "ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion banner sidebar sidenav nav navbar navigation menu "
    "breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
    "signup login share sharing social comment comments disqus reply replies respond related recommended recommendations pagination pager toolbar "
    "copyright disclaimer widget".split()
)
ROLES_ASIDE = set("navigation banner contentinfo complementary search form dialog alert menu".split())
MAIN_WORDS = set("article content post entry story main body text".split())
NAMES = re.compile(r"[a-z]+")
#: Words that say nothing about what a container holds; with words of ASIDE alone they name no part of an article.
NEUTRAL = set(
    "area articles bar block blocks body bottom box boxes btn button buttons card cards col container content div form group holder icon icons inner item items left "
    "link links list main module outer page panel post posts right row section site slot stories strip thread threads tile tiles top unit wrap wrapper zone".split()
)
#: Elements that hold prose themselves.
PROSE = set("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption".split())


@functools.cache
def raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I)


def host_of(url: str = "url"):
    """Lower-case host of a URL column without user and port; empty if there is none."""
    authority = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", ""))


class Open:
    """The open elements, with the depths of each name and of a few kinds, so that no question walks the stack."""

    def __init__(self) -> None:
        self.elements: list[tuple[str, int, bool, int]] = []  # name, container, whether it is left out, form
        self.depths: dict[str, list[int]] = defaultdict(list)

    def kinds(self, name: str) -> tuple[str, ...]:
        out = [name]
        if name not in INLINE:
            out.append("*block")
        if name in ("button", "td", "th", "table"):
            out.append("*cell")
        if name in ("article", "main"):
            out.append("*article")
        if name in PROSE:
            out.append("*prose")
        return tuple(out)

    def push(self, name: str, container: int, out: bool, form: int) -> None:
        for kind in self.kinds(name):
            self.depths[kind].append(len(self.elements))
        self.elements.append((name, container, out, form))

    def top(self, *names: str) -> int:
        """The depth of the innermost open element of these names or kinds; -1 if there is none."""
        return max((d[-1] for d in (self.depths.get(n) for n in names) if d), default=-1)

    def cut(self, depth: int) -> None:
        while len(self.elements) > depth:
            for kind in self.kinds(self.elements.pop()[0]):
                self.depths[kind].pop()

    def state(self) -> tuple[int, bool, int]:
        return self.elements[-1][1:] if self.elements else (0, False, 0)


class Tags:
    """Where tags of a page end, in time that grows with the page.

    A tag ends at the first > outside quotation marks, or, if a mark stays open up to
    the page's end, at the first > there is.  Where a search has failed, every later
    one that meets it at the same mark fails too, so no stretch is searched twice in
    the same state.
    """

    def __init__(self, source: str):
        self.source = source
        self.last = source.rfind(">")
        self.failed: set[int] = set()  # marks met outside others by searches that found no end
        self.none_from = {'"': len(source), "'": len(source)}  # from there on no such mark

    def end(self, at: int) -> int:
        """The place of the > that ends a tag whose name ends at a place; -1 if there is none."""
        if at > self.last:
            return -1
        source, met = self.source, []
        here = at
        while True:
            here = PLAIN.match(source, here).end()
            if here < len(source) and source[here] == ">":
                return here
            if here >= len(source) or here in self.failed:
                break
            met.append(here)
            mark = source[here]
            close = source.find(mark, here + 1) if here + 1 < self.none_from[mark] else -1
            if close < 0:
                self.none_from[mark] = min(self.none_from[mark], here + 1)
                break
            here = close + 1
        self.failed.update(met)
        return source.find(">", at)


class Page:
    """Blocks of text of a page, with the containers around each."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, int, int]] = []  # text, characters in links, container
        self.forms: list[int] = []  # of each block, the form around it, 0 for none
        self.prose: list[bool] = []  # of each block, whether a paragraph, heading or the like holds it
        self.articles: set[int] = set()  # forms with an article inside
        self.parent: list[int] = [-1]
        self.label: list[str] = [""]
        self.tag: list[str] = [""]
        self.strong: list[bool] = [False]
        self.parse(source)
        self.drop_forms()
        self.paths: list[str] = [""]
        for c in range(1, len(self.parent)):
            before = self.paths[self.parent[c]]
            path = f"{before}>{self.label[c]}" if before else self.label[c]
            self.paths.append(path if len(path) <= 1_000 else "#" + xxhash.xxh3_128_hexdigest(path))  # very deep: by digest

    def drop_forms(self) -> None:
        """Blocks in forms go, unless a form is a wrapper of the page.

        A wrapper holds half of the text or more, and an article, or more text in
        paragraphs and headings than besides; how long the text is does not matter.
        """
        whole = sum(len(t) for t, _, _ in self.blocks)
        inside: dict[int, list[int]] = defaultdict(lambda: [0, 0])
        for (text, _, _), form, prose in zip(self.blocks, self.forms, self.prose, strict=True):
            inside[form][prose] += len(text)
        keep = {form for form, (other, prose) in inside.items() if not form or 2 * (other + prose) >= whole and (form in self.articles or prose > other)}
        self.blocks = [b for b, form in zip(self.blocks, self.forms, strict=True) if form in keep]

    def flush(self, pieces: list[str], links: int, container: int, form: int, prose: bool) -> None:
        if pieces:
            text = SPACE.sub(" ", html.unescape("".join(pieces))).strip()
            if text:
                self.blocks.append((text, min(links, len(text)), container))
                self.forms.append(form)
                self.prose.append(prose)

    def parse(self, source: str) -> None:
        stack, tags = Open(), Tags(source)
        pieces: list[str] = []
        links, container, out, form, forms, at = 0, 0, False, 0, 0, 0

        def settle() -> None:
            nonlocal pieces, links
            self.flush(pieces, links, container, form, stack.top("*prose") >= 0)
            pieces, links = [], 0

        def end(depth: int) -> None:
            """Closes all elements from this depth on."""
            nonlocal container, out, form
            if stack.top("*block") >= depth:
                settle()
            stack.cut(depth)
            container, out, form = stack.state()

        def add(text: str) -> None:
            nonlocal links
            if text and not out:
                pieces.append(text)
                if stack.top("a") >= 0:
                    links += len(text)

        while (bracket := source.find("<", at)) >= 0:
            if bracket > tags.last:  # no tag ends any more; an open comment goes up to the end
                close = min((x for x in (source.find(c, at) for c in ("<!--", "<![CDATA[")) if x >= 0), default=len(source))
                add(source[at:close])
                at = len(source)
                break
            m = START.match(source, bracket)
            stop = m.end() if m and not m[2] else tags.end(m.end()) + 1 if m else 0
            if not stop:  # a bracket that starts nothing is text
                add(source[at : bracket + 1])
                at = bracket + 1
                continue
            add(source[at:bracket])
            at = stop
            name = (m[2] or "").lower()
            if not name:
                continue
            if name == "br":
                if not out:
                    pieces.append(" ")
                continue
            if m[1]:  # an end tag; one of an inline element does not reach beyond a block
                depth = stack.top(name)
                if depth >= 0 and not (name in INLINE and stack.top("*block") > depth):
                    end(depth)
                continue
            attributes = source[m.end() : stop - 1]
            if name in RAW:
                if not attributes.endswith("/"):
                    close = raw_end(name).search(source, at)
                    at = close.end() if close else len(source)
                    at = source.find(">", at) + 1 or len(source) if close else at
                if not out and name in ("iframe", "template"):
                    settle()
                continue
            if name in CLOSES_P:
                depth = stack.top("p")
                if depth >= 0 and stack.top("*cell") < depth:
                    end(depth)
            if name in ENDS:
                closes, within = ENDS[name]
                limit = stack.top(*within)
                while (depth := stack.top(*closes)) > limit:
                    end(depth)
            if name not in INLINE:
                settle()
            if name in VOID or attributes.endswith("/") and name not in CLOSES_P:
                continue
            if name in INLINE and "class" not in attributes and "hidden" not in attributes and "id" not in attributes:
                stack.push(name, container, out, form)
                continue
            left_out, label, strong = self.kind(name, attributes, stack.top("*article") >= 0, form > 0)
            if name in CONTAINERS and not out and not left_out:
                self.parent.append(container)
                self.label.append(label)
                self.tag.append(name)
                self.strong.append(strong)
                container = len(self.parent) - 1
            if name == "form":
                forms += 1
                form = forms
            if strong and name in ("article", "main"):
                self.articles.add(form)
            out = out or left_out
            stack.push(name, container, out, form)
        add(source[at:])
        settle()

    def kind(self, name: str, attributes: str, in_article: bool, in_form: bool) -> tuple[bool, str, bool]:
        """Whether an element is left out, its generalised label, and whether it names itself the article."""
        found: dict[str, str] = {}
        if attributes:
            for a in ATTRIBUTE.finditer(attributes):
                found.setdefault(a[1].lower(), a[2] or a[3] or a[4] or "")  # of equal names the first counts
        classes = found.get("class", "").lower().split()
        label = ".".join([name, *sorted({re.sub(r"\d+", "#", c) for c in classes})])
        role = found.get("role", "").lower()
        strong = name in ("article", "main") or role in ("main", "article") or "articlebody" in found.get("itemprop", "").lower()
        words = [NAMES.findall(c) for c in [*classes, found.get("id", "").lower()] if c]
        if name in ("article", "main", "body", "html") or strong:
            return False, label, True if name != "body" and name != "html" else False
        left = name in DROPPED or name == "header" and not in_article or role in ROLES_ASIDE and name != "form"
        left |= in_form and name in ("label", "legend")
        left |= "hidden" in found and name != "html" or found.get("aria-hidden", "").lower() == "true"
        left |= "display:none" in found.get("style", "").replace(" ", "").lower()
        # classes tell containers from the article; a paragraph or heading inside it stays, whatever its class
        for w in words if not (in_article and name in PROSE) else ():
            if w and not {"with", "has", "no", "without"} & set(w):
                if in_article:  # there, one word of several says little: a part on social policy is no list of links
                    left |= bool(ASIDE.intersection(w) - {"header"}) and ASIDE.union(NEUTRAL).issuperset(w)
                else:
                    left |= bool(ASIDE & {w[0], w[-1]})
        return left, label, bool(words) and any(w and w[-1] in MAIN_WORDS for w in words)

    def path(self, container: int) -> str:
        return self.paths[container]

    def best(self) -> int:
        """The container of the main text: one that names itself so, or the deepest with most of the text."""
        mass = [0] * len(self.parent)
        for text, links, container in self.blocks:
            mass[container] += max(0, len(text) - 2 * links)
        for c in range(len(mass) - 1, 0, -1):  # containers come before those inside them
            mass[self.parent[c]] += mass[c]
        whole = mass[0]
        named = [c for c in range(1, len(mass)) if self.strong[c] and self.tag[c] in ("article", "main") and mass[c] >= 0.3 * whole]
        if not named:
            named = [c for c in range(1, len(mass)) if self.strong[c] and mass[c] >= 0.5 * whole]
        if named:
            # the one with most text; among equals the innermost
            return max(named, key=lambda c: (mass[c], c))
        return max((c for c in range(len(mass)) if mass[c] >= 0.7 * whole), default=0)

    def text(self, path: str | None) -> str:
        """Blocks in the containers on a path; without such, or if they hold no text, in the best container."""
        if path:
            on = [False] * len(self.parent)
            for c in range(1, len(self.parent)):
                on[c] = on[self.parent[c]] or self.paths[c] == path
            found = [t for t, _, c in self.blocks if on[c]]
            if found:
                return "\n\n".join(found)
        best = self.best()
        inside = [c == best for c in range(len(self.parent))]
        for c in range(best + 1, len(self.parent)):
            inside[c] = inside[c] or self.parent[c] >= 0 and inside[self.parent[c]]
        return "\n\n".join(t for t, _, c in self.blocks if inside[c])


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, n, mass): pages whose best container lies on a path, and their text."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, str], list[int]] = defaultdict(lambda: [0, 0])
            for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                page = Page(source)
                best = page.best()
                if best:
                    got = found[host, page.path(best)]
                    got[0] += 1
                    got[1] += sum(len(t) for t, _, _ in page.blocks)
            keys = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([found[k][0] for k in keys], pa.int64()), pa.array([found[k][1] for k in keys], pa.int64())], names=["host", "path", "n", "mass"])

    each = pages.select("host", "html").mapInArrow(vote, "host string, path string, n long, mass long")
    return each.groupBy("host", "path").agg(F.sum("n").alias("n"), F.sum("mass").alias("mass"))


def extract(pages: DataFrame, broadcast_bytes: int = 8 << 20) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages.

    Null and empty html give an empty text; a null or odd url belongs to the
    nameless host.  Ties between paths go to the one with more text, then the
    smaller name.  Repeated rows vote and are extracted each; no rows give no
    rows; other columns are not read.  Whole pages are read, however long and however
    their tags are left open, in time that grows with the page.
    """
    source = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of().alias("host"))
    scratch = Scratch(pages.sparkSession, "html")
    ranked = votes(source).groupBy("host").agg(F.min_by("path", F.struct(-F.col("n"), -F.col("mass"), F.col("path"))).alias("path"))
    winners = scratch.keep(ranked, "paths")
    size = winners.agg(F.coalesce(F.sum(F.length("host") + F.length("path") + 32), F.lit(0))).first()[0]
    joined = source.join(F.broadcast(winners) if size <= broadcast_bytes else winners, "host", "left")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(h).text(p) if h else "" for h, p in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "html", "path").mapInArrow(take, f"page_id {kind}, url string, text string, n_chars long")
