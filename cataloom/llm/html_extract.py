"""Main text of web pages by consensus host paths.

First pass: every page scores its containers (text in their blocks, less link text, with half of it passed to the parent) and votes for
the generalised tag-class path of the best one. Votes are summed per host and path in Spark. Second pass: a page is
extracted from the elements at its host's winning path, the most voted one that it has, else from its own best container.

Votes are counts by (host, path), combined before the shuffle, so a hot host costs no more than another. The table of winners
is broadcast while it is small (``SMALL_TABLE`` rows, counted); beyond, pages meet it in a join over (host, salt).

Edge cases: null or empty html gives an empty text and n_chars 0. A null url, or one without ``://``, has the host ''. Markup that
isn't closed is closed by what follows it; a page without markup is one block. Repeated rows give repeated results; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cataloom.llm.url_filter import host_and_path

#: Winning paths kept for a host; rows of winners that are broadcast; salts of the join beyond.
WINNERS, SMALL_TABLE, SALTS = 8, 100_000, 32
#: Share of the page's own best container that a winning path must hold.
THIN = 0.2
#: Characters that are shown of a path's last step; the digest before them holds them all.
STEP = 120

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2
    h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td
    tfoot th thead tr ul""".split()
)
#: Elements that are never text (an unclosed one of those in _TO_THE_END takes the rest of the page), and those that hold page furniture.
_RAW = "script|style|noscript|template|iframe|svg|canvas|object|audio|video|title|textarea|select"
_TO_THE_END = frozenset("script style textarea title iframe".split())
_FURNITURE = frozenset("nav aside footer form menu dialog button search head".split())
_ROLES = frozenset("navigation banner complementary contentinfo search form menu menubar dialog alert alertdialog".split())
#: Words of a class or id that mark furniture.
_MARKS = frozenset(
    """ad ads adv advert adverts advertisement adsense adslot banner banners sponsor sponsored promo promos promotion promoted nav navbar
    navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside rail footer foot masthead topbar toolbar header pageheader siteheader
    cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe signup login signin comment
    comments disqus replies discussion respond share sharing social related recommended recommendations widget widgets pagination pager
    search skip hidden outbrain taboola tracking""".split()
)
#: Marks that most of a page's text doesn't excuse, and first words of a class that say what an element has or lacks.
_TALK = frozenset("comment comments disqus replies discussion respond".split())
#: Inside an article a class or id marks furniture only if all its words are marks or these; headings and paragraphs are never marked there.
_BESIDE = frozenset("area bar block bottom box button buttons content container form icon icons inner left link links list module panel post posts article articles right section slot thread top unit widget wrap wrapper".split())
_SAID = frozenset("h1 h2 h3 h4 h5 h6 p blockquote figure figcaption table li".split())
_STATES = frozenset("no has with without".split())
_CONTAINER = frozenset("article main section div td body blockquote center html".split())
_GOOD = frozenset("article main content post entry story text body page".split())
#: Start tags that close an open paragraph, and those that close an open element of their own kind.
_CLOSES_P = _BLOCK - {"body", "html", "head"}
_CLOSES_OWN = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
# a quote opens a value only behind "="; the last way to end a tag is at the first ">" whatever stands before it
_STRINGS = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+"
_TOKEN, _PLAIN_TOKEN = (
    re.compile(r"<!--.*?(?:-->|\Z)|<(" + _RAW + r")(?=[\s/>])[^>]*>|<(/?)([a-zA-Z][^\s/>]*)(?:(" + inside + r")>|([^>]*)>)|<[!?/][^>]*>", re.S | re.I)
    for inside in (_STRINGS, "[^>]*+")
)
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in _RAW.split("|")}
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_COMMENTS = re.compile(r"comments?(list|form|area|section|thread|body|box|wrap|wrapper)?")
_WORDS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
_POST = re.compile(r"\b(article|post|entry|story)\b")
_DIGITS = re.compile(r"\d+")


class Page:
    """Elements of a page and its blocks of text. A path is a digest of all its steps and the last of them, so its length is bounded; time is linear in the page."""

    __slots__ = ("article", "blocks", "container", "dropped", "marks", "parent", "path", "tag")

    def __init__(self, html: str):
        self.tag, self.parent, self.path, self.dropped, self.container, self.article = ["#"], [-1], ["/"], [False], [0], [False]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        self.marks: dict[int, bool] = {}  # elements dropped by a class or id, and if the marks are all about talk
        open_, pieces, links = [0], [], 0
        within, opened = [0], Counter({"#": 1})  # open blocks, and how many elements of each kind are open
        found: list[tuple[int, list[tuple[int, str, bool]]]] = []  # block, its pieces: element, text, in a link
        unclosed: set[str] = set()
        at, last, token = 0, html.rfind(">") + 1, _TOKEN  # no tag ends behind the last ">", so nothing there is looked at again and again

        def flush() -> None:
            nonlocal pieces
            if pieces:
                found.append((within[-1], pieces))
                pieces = []

        def push(e: int) -> None:
            open_.append(e)
            opened[self.tag[e]] += 1
            if self.tag[e] in _BLOCK:
                within.append(e)

        def pop() -> str:
            e = open_.pop()
            opened[self.tag[e]] -= 1
            if within[-1] == e:
                within.pop()
            return self.tag[e]

        def put(raw: str) -> None:
            if raw and not self.dropped[open_[-1]]:
                pieces.append((open_[-1], entities.unescape(raw) if "&" in raw else raw, links > 0))

        while m := token.search(html, at, last):
            put(html[at : m.start()])
            at = m.end()
            name = m[3]
            if m[5] is not None:  # a quote that nothing closes: from here on quotes count for nothing
                token = _PLAIN_TOKEN
            if at == last and m[0].startswith("<!--") and not m[0].endswith("-->"):
                at = len(html)
            if name is None:
                if m[1]:
                    pieces.append((open_[-1], " ", False))
                    raw = m[1].lower()
                    if html[at - 2] != "/":
                        end = None if raw in unclosed else _RAW_END[raw].search(html, at)
                        if end:
                            at = end.end()
                        elif raw in _TO_THE_END:
                            at = len(html)
                        else:
                            unclosed.add(raw)
                continue
            name = name.lower()
            if m[2]:
                if name == "a":
                    links = max(0, links - 1)
                if name in _BLOCK:
                    flush()
                if name == "br":
                    pieces.append((open_[-1], " ", False))
                elif opened[name]:
                    while pop() != name:
                        pass
                continue
            if name in _BLOCK:
                flush()
                links = 0
            elif name == "br":
                pieces.append((open_[-1], " ", False))
            closes = _CLOSES_OWN.get(name, frozenset()) | ({"p"} if name in _CLOSES_P else frozenset())
            if any(opened[t] for t in closes):
                for k in range(len(open_) - 1, 0, -1):
                    t = self.tag[open_[k]]
                    if t in closes:
                        while len(open_) > k:
                            pop()
                        break
                    if t in _CONTAINER or t in ("ul", "ol", "dl", "table"):
                        break
            if name in _VOID:
                continue
            if name == "a":
                links += 1
            attributes = m[4] if m[5] is None else m[5]
            if name in _BLOCK or attributes.strip(" /\n"):
                self._add(name, attributes, open_[-1])
                if not attributes.endswith("/") or name in _BLOCK:
                    push(len(self.tag) - 1)
            else:
                self._plain(name, open_[-1])
                push(len(self.tag) - 1)
        put(html[at:])
        flush()
        self._excuse(found)
        self._settle(found)

    def _excuse(self, found: list[tuple[int, list[tuple[int, str, bool]]]]) -> None:
        """Drops the marked elements, save those around a main or article or, on pages without these, around most of the text outside links."""
        if not self.marks:
            return
        n = len(self.tag)
        weight, holds = [0] * n, [False] * n
        for _, pieces in found:
            for e, text, linked in pieces:
                if not linked:
                    weight[e] += len(text.strip())
        inside = [False] * n
        for e in range(1, n):
            own = self.tag[e] in ("article", "main")
            inside[e] = inside[self.parent[e]] or own
            holds[e] = own and not self.dropped[e] and e not in self.marks
        for e in range(n - 1, 0, -1):
            weight[self.parent[e]] += weight[e]
            holds[self.parent[e]] |= holds[e]
        for e, talk in self.marks.items():
            if self.tag[e] in ("article", "main") or (holds[e] and not inside[e]) or (not holds[0] and not talk and 2 * weight[e] > weight[0]):
                continue
            self.dropped[e] = True
        for e in range(1, n):
            self.dropped[e] |= self.dropped[self.parent[e]]

    def _settle(self, found: list[tuple[int, list[tuple[int, str, bool]]]]) -> None:
        """Blocks of the text that isn't dropped."""
        for block, pieces in found:
            kept = [p for p in pieces if not self.dropped[p[0]]]
            text = " ".join("".join(t for _, t, _ in kept).split())
            if text:
                self.blocks.append((block, text, sum(len(t.strip()) for _, t, linked in kept if linked)))

    def _element(self, name: str, parent: int, path: str, dropped: bool) -> None:
        e = len(self.tag)
        self.tag.append(name)
        self.parent.append(parent)
        self.path.append(path)
        self.dropped.append(dropped)
        self.container.append(e if name in _CONTAINER else self.container[parent])
        self.article.append(self.article[parent] or name in ("article", "main") or (name in _CONTAINER and bool(_POST.search(path.rpartition("/")[2]))))

    def _plain(self, name: str, parent: int) -> None:
        self._element(name, parent, self.path[parent], self.dropped[parent] or name in _FURNITURE)

    def _add(self, name: str, attributes: str, parent: int) -> None:
        named: dict[str, str] = {}
        if attributes:
            for k, a, b, c in _ATTRIBUTE.findall(attributes):
                named.setdefault(k.lower(), a or b or c)
        names = [_WORDS.findall(x) for x in f"{named.get('class', '')} {named.get('id', '')}".split()]
        kind = ".".join(sorted(_DIGITS.sub("N", x) for x in named.get("class", "").split()))
        path = self.path[parent]
        if name in _BLOCK:
            step = f"{name}.{kind}" if kind else name
            path = f"{xxhash.xxh3_128_hexdigest(path + '/' + step)}/{step[:STEP]}"
        drop = self.dropped[parent]
        if not drop and name not in ("html", "body", "main", "article"):
            drop = (
                name in _FURNITURE
                or (name == "header" and not self.article[parent])
                or named.get("role", "").lower() in _ROLES
                or "hidden" in named
                or named.get("aria-hidden") == "true"
                or "display:none" in named.get("style", "").replace(" ", "").lower()
            )
        self._element(name, parent, path, drop)
        if not drop and name not in ("html", "body", "main"):
            said = [[("comments" if _COMMENTS.fullmatch(w.lower()) else w.lower()) for w in words] for words in names if words and words[0].lower() not in _STATES]
            if self.article[parent]:
                said = [] if name in _SAID and not any("comments" in words for words in said) else [w for w in said if set(w) <= _MARKS | _BESIDE and "header" not in w]
            marks = {w for words in said for w in words} & _MARKS
            if marks:
                self.marks[len(self.tag) - 1] = marks <= _TALK

    def scores(self) -> dict[int, float]:
        """Score of every container that has text."""
        out: Counter[int] = Counter()
        for element, text, linked in self.blocks:
            worth = max(0, len(text) - 2 * linked) * (1 + min(text.count(","), 10) / 10)
            e, share = self.container[element], 1.0
            while share > 0.2:
                out[e] += worth * share
                if e <= 0:
                    break
                e, share = self.container[self.parent[e]], share / 2
        for e in out:
            if any(w.lower() in _GOOD for w in _WORDS.findall(self.path[e].rpartition("/")[2])):
                out[e] *= 1.25
        return out

    def best(self) -> int:
        """The best container, or the article or main element that it stands in."""
        scores = self.scores()
        if not scores:
            return 0
        e = min(scores, key=lambda k: (-scores[k], k))
        up, found = e, {}
        while up > 0:
            found[self.tag[up]] = up  # the outermost of each kind
            up = self.parent[up]
        return found.get("article", found.get("main", e))

    def text(self, inside: set[int]) -> str:
        """Blocks that stand in one of the elements, in page order."""
        return "\n".join(t for t, _ in self._blocks_in(inside))

    def weight(self, inside: set[int]) -> int:
        """Characters outside links of the blocks in one of the elements."""
        return sum(max(0, len(t) - linked) for t, linked in self._blocks_in(inside))

    def _blocks_in(self, inside: set[int]) -> list[tuple[str, int]]:
        known: dict[int, bool] = {e: True for e in inside}
        known.setdefault(-1, False)

        def within(e: int) -> bool:
            way = []
            while e not in known:
                way.append(e)
                e = self.parent[e]
            known.update(dict.fromkeys(way, known[e]))
            return known[e]

        return [(t, linked) for e, t, linked in self.blocks if within(e)]


def extract(html: str | None, winners: list[str]) -> str:
    """Main text of one page, by the first of its host's winning paths that it has.

    A path that holds little on this page, less than ``THIN`` of what the page's own best container has outside links, is passed over.
    """
    if not html:
        return ""
    page = Page(html)
    best = page.best()
    own = page.weight({best})
    for path in winners:
        elements = {e for e, p in enumerate(page.path) if p == path and page.tag[e] in _CONTAINER and not page.dropped[e]}
        if elements and page.weight(elements) >= THIN * own and (text := page.text(elements)):
            return text
    return page.text({best})


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, votes) over all pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count: Counter[tuple[str, str]] = Counter()
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                if html:
                    page = Page(html)
                    if page.blocks:
                        count[host, page.path[page.best()]] += 1
            rows = list(count.items())
            columns = [[k[0] for k, _ in rows], [k[1] for k, _ in rows], [n for _, n in rows]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["host", "path", "votes"])

    return pages.select("host", "html").mapInArrow(run, "host string, path string, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"))


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, winners): each host's most voted paths, best first."""
    order = Window.partitionBy("host").orderBy(F.desc("votes"), "path")
    ranked = votes(pages).withColumn("place", F.row_number().over(order)).where(F.col("place") <= WINNERS)
    return ranked.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "path"))), lambda s: s["path"]).alias("winners"))


_RESULT = "page_id long, url string, text string, n_chars long"


def _results(batch: pa.RecordBatch, winners: list[list[str]]) -> pa.RecordBatch:
    texts = [extract(h, w) for h, w in zip(batch.column("html").to_pylist(), winners, strict=True)]
    return pa.RecordBatch.from_arrays(
        [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
        names=["page_id", "url", "text", "n_chars"],
    )


def main_text(pages: DataFrame, small_table: int = SMALL_TABLE) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    host, _ = host_and_path(F.col("url"))
    hosted = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").cast("string").alias("html"), host.alias("host"))
    table = winning_paths(hosted)
    head = table.limit(small_table + 1).collect()
    if len(head) <= small_table:
        shared = pages.sparkSession.sparkContext.broadcast({r["host"]: list(r["winners"]) for r in head})

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _results(batch, [shared.value.get(h, []) for h in batch.column("host").to_pylist()])

        return hosted.mapInArrow(look_up, _RESULT)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _results(batch, [w or [] for w in batch.column("winners").to_pylist()])

    salted = hosted.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)))
    every = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(every, ["host", "salt"], "left").mapInArrow(joined, _RESULT)
