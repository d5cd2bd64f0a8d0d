"""HTML extraction by consensus host paths.

Every page is read by a tolerant tokeniser into blocks and containers. A page scores its containers
by the prose that they hold and names the best one by its generalised path (tags and classes,
digits stripped). Spark counts those votes for each host; each page is then extracted again from
the container at its host's winning path, or from its own best one where no winning path is there.
"""

from __future__ import annotations

import html as htmllib
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship_package, stored, table, with_key

# Tags by their part in a page.
BLOCKS = frozenset((
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul").split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIP = frozenset("script style template noscript textarea select iframe svg math canvas object title button".split())
#: Elements whose own text is an article's; text right in a div, a cell or the body is not taken for it.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd figcaption section article main".split())
CONTAINERS = frozenset("article main section div td body".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog head".split())
#: A header is the page's own unless one of these holds it: then it has the article's headline.
HEADED = frozenset("article main".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert".split())
BOILER_WORDS = frozenset((
    "nav navbar navigation menu header masthead footer sidebar aside ad ads advert adverts advertisement adbox promo promotion sponsor sponsored "
    "banner cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe signup login share sharing social related "
    "recommended comment comments respond replies discussion disqus breadcrumb breadcrumbs pagination pager widget toolbar").split())
#: In a class of several words, those after which a word says what else is there, and those that make a header the article's.
LINKING = frozenset("with has no without and is in".split())
STORY = frozenset("article post story entry content page".split())
READERS = frozenset("comment comments respond replies discussion disqus related recommended".split())
#: Opening one of these ends an open element of the second group, if no element of the third stands between.
_CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)),
           "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table"))}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""(?i)\b(class|role|id|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"\s+")
_SPLIT = re.compile(r"[^a-z]+")


class Page:
    """Blocks of a page in order, and the elements that hold them.

    nodes: (parent, tag, token, boilerplate); blocks: (node, text, characters in links, heading).
    """

    def __init__(self, html: str | None):
        self.nodes: list[tuple[int, str, str, bool]] = [(-1, "", "", False)]
        self.blocks: list[tuple[int, str, int]] = []
        self._read(html or "")

    def _read(self, html: str) -> None:
        stack, hard, soft = [0], [False], [None]  # boilerplate by tag, role or attribute; the words of a class that say so
        nodes, parts, at = self.nodes, [], 0
        links, in_link, size = 0, 0, len(html)

        def flush():
            nonlocal links
            text = _SPACE.sub(" ", htmllib.unescape("".join(parts))).strip()
            if text:
                self.blocks.append((stack[-1], text, links))
            parts.clear()
            links = 0

        pos = 0
        while pos < size:
            m = _TAG.search(html, pos)
            end = m.start() if m else size
            if end > pos:
                parts.append(html[pos:end])
                if in_link:
                    links += end - pos
            if not m:
                break
            pos = m.end() if m.end() > m.start() else m.end() + 1
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if m[1]:
                if name == "a":
                    in_link = 0
                elif name in BLOCKS:
                    flush()
                    for k in range(len(stack) - 1, 0, -1):
                        if nodes[stack[k]][1] == name:
                            del stack[k:]
                            break
                continue
            if name in SKIP:
                close = re.compile(f"</{re.escape(name)}\\s*>", re.I).search(html, pos)
                if not m[3].endswith("/"):
                    pos = close.end() if close else (size if name in ("script", "style", "textarea", "title") else pos)
                parts.append(" ")
            elif name == "a":
                in_link = 1
            elif name == "br":
                parts.append(" ")
            elif name in BLOCKS or name == "head":
                flush()
                if nodes[stack[-1]][1] == "p" and name != "head":
                    stack.pop()  # an open paragraph ends where a block begins
                if name in _CLOSES:
                    ends, walls = _CLOSES[name]
                    for k in range(len(stack) - 1, 0, -1):
                        tag = nodes[stack[k]][1]
                        if tag in walls:
                            break
                        if tag in ends.split():
                            del stack[k:]
                            break
                if name == "body":
                    del stack[1:]
                if name in VOID:
                    continue
                token, boiler, by_word = self._token(name, m[3])
                if name == "header" and not any(nodes[k][1] in HEADED for k in stack):
                    boiler = True
                if name in HEADED and not boiler:
                    self._clear(stack, hard, soft, name)
                hard.append(boiler)
                soft.append(by_word)
                nodes.append((stack[-1], name, token, boiler or bool(by_word) or nodes[stack[-1]][3]))
                stack.append(len(nodes) - 1)
        flush()

    def _clear(self, stack: list[int], hard: list[bool], soft: list, name: str) -> None:
        """What holds the article and is boilerplate by the words of its class alone is not."""
        held = [k for k in stack if self.nodes[k][3]]
        if any(hard[k] for k in held) or (name != "main" and any(soft[k] and soft[k] & READERS for k in held)):
            return
        for k in held:
            self.nodes[k] = (*self.nodes[k][:3], False)

    @staticmethod
    def _token(name: str, attrs: str) -> tuple[str, bool, frozenset | None]:
        """(token, boilerplate by tag, role or attribute, the words of its classes and id that name boilerplate)."""
        boiler, told = name in BOILER_TAGS, set()
        if not attrs:
            return name, boiler, None
        classes: list[str] = []
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "class":
                classes = sorted({re.sub(r"\d+", "", c) for c in value.split()} - {""})
            if key == "role":
                boiler = boiler or value in BOILER_ROLES
            elif key == "hidden":
                boiler = boiler or not value
            elif name not in ("body", "html", "article", "main"):
                for c in value.split():
                    words = _SPLIT.split(c)
                    cut = next((i for i, w in enumerate(words) if w in LINKING), len(words))
                    found = BOILER_WORDS.intersection(words[:cut])
                    told |= found - {"header"} if found and not STORY.isdisjoint(words) else found
        return ".".join([name, *classes]), boiler, frozenset(told) or None

    def path(self, node: int) -> str:
        out = []
        while node > 0:
            out.append(self.nodes[node][2])
            node = self.nodes[node][0]
        return ">".join(reversed(out))

    def scores(self) -> dict[int, float]:
        """Prose in each container: its own blocks whole, those of containers inside it in part."""
        out: dict[int, float] = {}
        for node, text, links in self.blocks:
            if self.nodes[node][3] or links > 0.4 * len(text):
                continue
            gain, share, tag = len(text) + 20.0 * sum(text.count(c) for c in ".!?,;"), 1.0, self.nodes[node][1]
            gain *= 0.3 if tag == "li" else 1.0
            k = node
            while k > 0:
                if self.nodes[k][1] in CONTAINERS:
                    bonus = 1.3 if self.nodes[k][1] in ("article", "main") else 1.0
                    out[k] = out.get(k, 0.0) + gain * share * bonus
                    share *= 0.6
                k = self.nodes[k][0]
        return out

    def best(self) -> tuple[int, float]:
        got = self.scores()
        if not got:
            return 0, 0.0
        node = max(got, key=lambda k: (got[k], -k))
        return self.whole(node), got[node]

    def whole(self, node: int) -> int:
        """The outermost container that adds to a node nothing but text of an article: headings, paragraphs and the like of few links."""
        best, at, inner = node, node, self._inside(node)
        while True:
            at = self.nodes[at][0]
            if at <= 0 or self.nodes[at][3]:
                return best
            if self.nodes[at][1] not in CONTAINERS:
                continue
            outer = self._inside(at)
            added = [(n, text, links) for n, text, links in self.blocks if outer[n] and not inner[n] and not self.nodes[n][3]]
            if not all(self.nodes[n][1] in PROSE and links <= 0.4 * len(text) for n, text, links in added):
                return best
            if added:
                best, inner = at, outer

    def _inside(self, root: int) -> list[bool]:
        inside = [False] * len(self.nodes)
        for k in range(root, len(self.nodes)):
            inside[k] = k == root or (self.nodes[k][0] >= 0 and inside[self.nodes[k][0]])
        return inside

    def text(self, roots: set[int]) -> str:
        inside = [False] * len(self.nodes)
        for k in range(len(self.nodes)):
            parent = self.nodes[k][0]
            inside[k] = k in roots or (parent >= 0 and inside[parent])
        return "\n".join(text for node, text, _ in self.blocks if inside[node] and not self.nodes[node][3])

    def extract(self, paths) -> str:
        """The text at the first of paths that is in the page, else at the page's own best container."""
        where: dict[str, set[int]] = {}
        for k in range(1, len(self.nodes)):
            if self.nodes[k][1] in CONTAINERS and not self.nodes[k][3]:
                where.setdefault(self.path(k), set()).add(k)
        for p in paths if paths is not None else ():
            if p in where and (got := self.text(where[p])):
                return got
        return self.text({self.best()[0]})


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def vote(pages: DataFrame, least_share: float = 0.1) -> DataFrame:
    """(host, paths): each host's winning container paths, most voted first: those with least_share of its votes, which
    are 1 / least_share at most. Votes are summed before they move, so a host that holds a third of all pages is a few
    rows from each task; a page that has none of the paths is extracted by its own best container."""
    def run(batches):
        for pdf in batches:
            rows = []
            for host, html in zip(pdf["host"], pdf["html"], strict=True):
                page = Page(html)
                node, score = page.best()
                if node:
                    rows.append((host, page.path(node), score))
            yield pd.DataFrame(rows, columns=["host", "path", "score"])
    votes = pages.select(host_of(F.col("url")).alias("host"), "html").mapInPandas(run, "host string, path string, score double")
    counted = votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("s"))
    counted, _ = stored(pages.sparkSession, counted, "host-votes")
    totals = counted.groupBy("host").agg(F.sum("n").alias("total"))
    won = counted.join(totals, "host").where(F.col("n") >= F.col("total") * least_share)
    return won.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("n", "s", "path")), False).alias("all")).select(
        "host", F.transform("all", lambda x: x["path"]).alias("paths"))


#: Hosts whose paths are broadcast; with more of them pages meet their host's paths in a shuffle, a host's pages dealt over SALTS.
BROADCAST_HOSTS, SALTS = 200_000, 16


def _with_paths(pages: DataFrame, winners: DataFrame) -> DataFrame:
    if winners.count() <= BROADCAST_HOSTS:
        return pages.join(F.broadcast(winners), "host", "left")
    dealt = winners.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pages.withColumn("salt_", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(dealt, ["host", "salt_"], "left")


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    pages needs page_id, url and html; other columns are ignored. Null and empty html give an empty
    text; pages without a url vote together as one host. Blocks are white-space-normalised, trimmed
    and joined by line breaks. Repeated rows are extracted each; an empty table gives no rows.
    """
    spark = pages.sparkSession
    ship_package(spark)
    winners, _ = stored(spark, vote(pages), "host-paths")

    def run(batches):
        for pdf in batches:
            text = [Page(h).extract(p) for h, p in zip(pdf["html"], pdf["paths"], strict=True)]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": text, "n_chars": [len(t) for t in text]})
    joined = _with_paths(pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")), winners)
    return with_key(joined.select("page_id", "url", "html", "paths"), "page_id", run, "page_id long, url string, text string, n_chars long")


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
