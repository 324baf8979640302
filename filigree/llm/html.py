"""HTML extraction by consensus host paths.

Every page is scanned once into containers (elements that hold blocks of text),
each with a generalised path of tags and classes (digits in class names become
``0``).  A container scores by its text outside links, less what is linked and
what its tag or class marks as page furniture; a page votes for its best path,
widened to the nearest article or main around it.  Paths are kept as steps that
name the path around them, so a page's paths take room in proportion to the page
however deep it nests.  A class or id marks furniture only if all parts of one of its
names are such words (``related-posts`` does, ``related-work`` doesn't).
Spark sums the votes per host, the winning path is joined back, and each page's
blocks are read again by its host's path (its own best one where that is
missing or covers less than COVERED of its own one's unlinked text).  Pages are
parsed once; what is written between the passes is their blocks of text.  The
winners, one row a host, are broadcast up to BROADCAST_BYTES; more of them are
joined by a shuffle, whose hot hosts are split at run time.

Defined cases: a null or empty html gives an empty text; broken markup (missing
end tags, cut tags) is read as far as it goes, a quote that is not closed reaching to the next one; repeated rows are pages of their
own; ties in votes go to the path that sorts first; an empty table gives no
rows.  Pages without a host vote together.  Whole pages are read.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .urls import host_of

_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SKIPPED = frozenset("script style noscript template svg math canvas iframe object select option button form nav footer aside head dialog textarea input label fieldset menu audio video map datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINERS = frozenset("article main section div body td".split())
BROADCAST_BYTES = 32 << 20
#: Share of the page's own best text that the host's path must cover.
COVERED = 0.7
#: Parts of names that mark page furniture, and parts that may stand beside them in such a name.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsors sponsored promo promos promotion banner banners cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login nav navbar navigation menu menus breadcrumb breadcrumbs sidebar side aside widget widgets related recommend recommended recommendations share sharing social comment comments replies reply respond disqus footer foot masthead toolbar pagination pager tags hidden skip".split()
)
BESIDE = frozenset(
    "box block list wrapper wrap container area section item items link links top bottom left right inner outer panel module bar site page global primary secondary post posts article articles content button buttons icon icons slot form group row col main text title label close story stories more count media thread header head to the us on by for".split()
)
#: Marks furniture only outside of an article or main, where it is the page's own head.
PAGE_HEAD = frozenset("header head".split())
_PARTS = re.compile(r"[-_:]+|(?<=[a-z])(?=[A-Z])|(?<=\D)(?=\d)")
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
P_ENDERS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SPACE = re.compile(r"\s+")


def marks_furniture(names: str, inside: bool) -> bool:
    """Does one of the names of a class or id attribute mark page furniture?"""
    for name in names.split():
        parts = [x.lower() for x in _PARTS.split(name) if x and not x.isdigit()]
        own = FURNITURE if inside else FURNITURE | PAGE_HEAD
        if any(x in own for x in parts) and all(x in own or x in BESIDE for x in parts):
            return True
    return False


def under(steps: list[tuple[int, str]], path: str) -> list[bool]:
    """Which of a page's paths are ``path`` or lie under it; a step follows the one it names."""
    want = path.split("/")[1:]
    met = [0] * len(steps)
    for i, (parent, step) in enumerate(steps):
        if i:
            k = met[parent]
            met[i] = k if k == len(want) else k + 1 if k >= 0 and want[k] == step else -1
    return [k == len(want) for k in met]


def widened(path: str) -> str:
    """The path up to its innermost article or main, if it has one, so that heading and intro beside a body stay."""
    steps = path.split("/")
    last = max((i for i, x in enumerate(steps) if x.split(".")[0] in ("article", "main")), default=len(steps) - 1)
    return "/".join(steps[: last + 1])


class Scan:
    """Blocks of a page: (text, path number, furniture, linked length), and its paths as ``steps`` (path around, step)."""

    def __init__(self, page: str):
        self.blocks: list[tuple[str, int, bool, int]] = []
        self.steps: list[tuple[int, str]] = [(-1, "")]
        self._path_of: dict[tuple[int, str], int] = {}
        self._parts: list[str] = []
        self._linked = 0
        #: Elements marked as furniture by class or id: the marked one around each (-1: none) and the article and main
        #: tags in it; the mark around each block; the tags on the page.
        self._around: list[int] = []
        self._holds: list[set[str]] = []
        self._marks: list[int] = []
        self._whole: set[str] = set()
        #: tag, path number, furniture, mark around, inside an article or main, inside a link; how many of a tag are open
        self._stack: list[tuple[str, int, bool, int, bool, bool]] = [("", 0, False, -1, False, False)]
        self._opened: Counter[str] = Counter()
        self._read(page)
        self._settle()

    def _settle(self) -> None:
        """A name doesn't mark a layout wrapper: what holds the main, an article and half of the text, or nearly all of a page without either."""
        size, total = [0] * len(self._around), 0
        for (text, _, furniture, _), mark in zip(self.blocks, self._marks):
            if not furniture:
                total += len(text)
                if mark >= 0:
                    size[mark] += len(text)
        # What is marked further in comes later, so sums and tags go outwards in one pass.
        for k in range(len(size) - 1, -1, -1):
            if (out := self._around[k]) >= 0:
                size[out] += size[k]
                self._holds[out] |= self._holds[k]
        hidden = [False] * len(size)
        for k, held in enumerate(size):
            wraps = "main" in self._holds[k] or held > (0.5 * total if "article" in self._holds[k] else total if self._whole else 0.8 * total)
            hidden[k] = not wraps or self._around[k] >= 0 and hidden[self._around[k]]
        self.blocks = [(text, path, furniture or mark >= 0 and hidden[mark], linked) for (text, path, furniture, linked), mark in zip(self.blocks, self._marks)]

    def path(self, number: int) -> str:
        steps = []
        while number > 0:
            number, step = self.steps[number]
            steps.append(step)
        return "".join(f"/{x}" for x in reversed(steps))

    def _flush(self) -> None:
        if self._parts:
            # A character reference may be a line end or space of its own; all white space is one space.
            text = _SPACE.sub(" ", html.unescape("".join(self._parts))).strip()
            if text:
                _, path, furniture, mark, _, _ = self._stack[-1]
                self.blocks.append((text, path, furniture, self._linked))
                self._marks.append(mark)
            self._parts, self._linked = [], 0

    def _open(self, tag: str, attrs: str) -> None:
        if tag not in INLINE:
            self._flush()
            if tag in P_ENDERS:
                self._close_to({"p"}, {"td", "th", "table", "button", "div", "article", "section", "main", "body", "li"})
            if tag in CLOSES:
                self._close_to(CLOSES[tag], {"ul", "ol", "dl", "table", "tbody", "select", "div", "article"})
        if tag in VOID:
            return
        _, path, furniture, mark, inside, linked = self._stack[-1]
        if tag in ("article", "main"):
            self._whole.add(tag)
            if mark >= 0:
                self._holds[mark].add(tag)
        named = ""
        if attrs.strip():
            found = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(attrs)}
            named = found.get("class", "").replace("/", "|")
            if tag not in ("html", "body", "article", "main") and marks_furniture(f"{named} {found.get('id', '')}", inside):
                self._around.append(mark)
                self._holds.append(set())
                mark = len(self._holds) - 1
            if "hidden" in found or found.get("role", "").lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert"):
                furniture = True
            if "display:none" in found.get("style", "").replace(" ", "").lower():
                furniture = True
        if tag in SKIPPED or tag == "header" and not inside:
            furniture = True
        if tag in CONTAINERS:
            step = path, tag + ("." + ".".join(sorted(re.sub(r"\d+", "0", named).split())) if named else "")
            if step not in self._path_of:
                self._path_of[step] = len(self.steps)
                self.steps.append(step)
            path = self._path_of[step]
        self._stack.append((tag, path, furniture, mark, inside or tag in ("article", "main"), linked or tag == "a"))
        self._opened[tag] += 1

    def _cut_stack(self, k: int) -> None:
        for tag, *_ in self._stack[k:]:
            self._opened[tag] -= 1
        del self._stack[k:]

    def _close_to(self, tags: set[str], fences: set[str]) -> None:
        if not any(self._opened[t] for t in tags):
            return
        for k in range(len(self._stack) - 1, 0, -1):
            tag = self._stack[k][0]
            if tag in tags:
                self._cut_stack(k)
                return
            if tag in fences:
                return

    def _close(self, tag: str) -> None:
        if tag not in INLINE:
            self._flush()
        if not self._opened[tag]:
            return
        for k in range(len(self._stack) - 1, 0, -1):
            if self._stack[k][0] == tag:
                self._cut_stack(k)
                return
            # An inline end tag doesn't end the block around it.
            if tag in INLINE and self._stack[k][0] not in INLINE:
                return

    def _text(self, text: str) -> None:
        if text:
            self._parts.append(text)
            if self._stack[-1][5]:
                self._linked += len(text)

    def _read(self, page: str) -> None:
        at, n = 0, len(page)
        while at < n:
            m = _TAG.search(page, at)
            if m is None:
                self._text(page[at:])
                break
            self._text(page[at : m.start()])
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                self._close(tag)
                continue
            if tag == "br":
                self._parts.append("\n")
                continue
            self._open(tag, m[3])
            if tag in RAW:
                end = re.compile(rf"</{tag}\b[^>]*(?:>|$)", re.I).search(page, at)
                at = end.end() if end else n
                self._close(tag)
        self._flush()

    def scores(self) -> dict[int, float]:
        """Score of each path with text in it: its own and inner blocks' unlinked text, less what is linked;
        a path owns its text, each one further out gets less of it."""
        out: dict[int, float] = defaultdict(float)
        for text, path, furniture, linked in self.blocks:
            if not furniture:
                out[path] += len(text) - 2 * linked
        for path in range(len(self.steps) - 1, 0, -1):
            if path in out and (around := self.steps[path][0]) > 0:
                out[around] += 0.9 * out[path]
        out.pop(0, None)
        return out

    def best(self) -> str:
        scores = self.scores()
        if not scores:
            return ""
        top = max(scores.values())
        return widened(min(self.path(p) for p, score in scores.items() if score == top))

    def text(self, path: str) -> str:
        """Blocks under a path, in page order."""
        inside = under(self.steps, path)
        return " ".join(text for text, at, furniture, _ in self.blocks if not furniture and inside[at])


SCANNED = "page_key {kind}, url string, host string, own string, steps array<struct<around:int,step:string>>, blocks array<struct<text:string,path:int,plain:long>>"
_STEPS = pa.list_(pa.struct([("around", pa.int32()), ("step", pa.string())]))
_BLOCKS = pa.list_(pa.struct([("text", pa.string()), ("path", pa.int32()), ("plain", pa.int64())]))


def scanned(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """SCANNED rows: each page's own best path, its paths' steps and its blocks outside page furniture."""
    kind = pages.schema[key].dataType.simpleString()
    src = pages.select(F.col(f"`{key}`").alias("page_key"), F.col(f"`{url}`").alias("url"), host_of(F.col(f"`{url}`")).alias("host"), F.col(f"`{page}`").alias("html"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, steps, blocks = [], [], []
            for x in batch.column(3):
                found = Scan(x.as_py() or "")
                own.append(found.best())
                steps.append([{"around": a, "step": step} for a, step in found.steps])
                blocks.append([{"text": t, "path": p, "plain": len(t) - linked} for t, p, furniture, linked in found.blocks if not furniture])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(own, pa.string()), pa.array(steps, _STEPS), pa.array(blocks, _BLOCKS)], ["page_key", "url", "host", "own", "steps", "blocks"])

    return src.mapInArrow(scan, SCANNED.format(kind=kind))


def winners(pages: DataFrame) -> DataFrame:
    """(host, path) with the most votes of pages(host, own)."""
    votes = pages.where("own <> ''").groupBy("host", F.col("own").alias("path")).agg(F.count("*").alias("n"))
    return votes.groupBy("host").agg(F.min(F.struct(F.negative("n"), "path")).alias("w")).select("host", F.col("w.path").alias("path"))


def chosen(own: str, winner: str | None, steps: list[dict], blocks: list[dict]) -> tuple[str, str]:
    """(text, path) of a page: by its host's path, or by its own one where that is missing or covers too little."""
    kept = [(x["around"], x["step"]) for x in steps]

    def read(path: str) -> list[dict]:
        inside = under(kept, path)
        return [b for b in blocks if inside[b["path"]]]

    plain = lambda found: sum(b["plain"] for b in found)
    mine, path = read(own), own
    if winner is not None and winner != own:
        theirs = read(winner)
        if theirs and plain(theirs) >= COVERED * plain(mine):
            mine, path = theirs, winner
    return " ".join(b["text"] for b in mine), path


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """pages -> (key, url, text, path)."""
    seen = written(scanned(pages, key, url, page), "page-blocks")
    winner = written(winners(seen), "host-paths")
    size = winner.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 64)).first()[0] or 0
    joined = seen.join(F.broadcast(winner) if size <= BROADCAST_BYTES else winner, "host", "left")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [chosen(*(c.as_py() for c in row)) for row in zip(*batch.columns[2:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([t for t, _ in found], pa.string()), pa.array([p for _, p in found], pa.string())], ["page_key", "url", "text", "path"])

    kind = pages.schema[key].dataType.simpleString()
    out = joined.select("page_key", "url", "own", "path", "steps", "blocks").mapInArrow(choose, f"page_key {kind}, url string, text string, path string")
    return out.withColumnRenamed("page_key", key)
