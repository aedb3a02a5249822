"""HTML main text (7) by consensus host paths.

Every page scores its containers: a block of running text gives points for its length, punctuation and lack of links to the
container it stands in, and less to those further out. From the best container a page goes outwards as long as what it gains
is more of the article (the headline, paragraphs beside it), and votes once for that container's generalised path (tags with
classes, numbers blanked). Spark sums the votes per host, and all pages of a host are read again at its winning path.

What is left out inside that path rests on elements first (nav, footer, forms, lists of links, hidden ones). Words in classes,
ids and roles are a weak prior: they don't hold against an element with most of the page's running text or with its article.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowkin.llm import _markup
from rowkin.llm._io import join_counted, pieces

# Elements that never hold the article's text, and those that mostly don't
NEVER = {"head", "nav", "footer", "button", "select", "option", "dialog", "menu", "search"}
SELDOM = {"aside", "form", "fieldset", "label", "legend", "header"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
TEXTUAL = HEADINGS | {"p", "li", "pre", "dd", "dt", "td", "th", "blockquote", "figcaption", "address", "header", "hgroup"}
# Words in classes, ids and roles that speak against an element (comments by readers more strongly)
COMMENTS = set("comment comments commentlist reply replies disqus respond".split())
BOILERPLATE = set("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar aside footer masthead topbar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations toolbar pagination pager complementary contentinfo search skip".split())
ARTICLE = set("article content main post entry story text body".split())
PUNCTUATION = re.compile(r"[.,;:!?…。、，；！？؟،।]")
#: Longest path that is kept as it is; longer ones go by their digest.
LONGEST_PATH = 1024


def general(element: _markup.Element) -> str:
    return ".".join([element.tag, *element.classes])


class Page:
    """Elements with what speaks for and against them, and the blocks that are kept."""

    def __init__(self, text: str):
        tree = _markup.read(text)
        self.elements, self.blocks = tree.elements, tree.blocks
        n = len(self.elements)
        self.running = [max(0, len(b.text) - 2 * b.linked) for b in self.blocks]
        never = [False] * n
        for i, e in enumerate(self.elements[1:], 1):
            never[i] = never[e.parent] or e.hidden or e.tag in NEVER
        held, length, linked, links, articles, paragraphs = ([0] * n for _ in range(6))  # of each element and all in it
        for b, run in zip(self.blocks, self.running, strict=True):
            paragraphs[b.at] += self.elements[b.at].tag in ("p", "pre", "blockquote", *HEADINGS)
            if not never[b.at]:
                held[b.at] += run
            length[b.at] += len(b.text)
            linked[b.at] += b.linked
            links[b.at] += b.links
        for i in range(n - 1, 0, -1):
            e = self.elements[i]
            articles[i] += e.tag in ("article", "main") and not e.words & (COMMENTS | BOILERPLATE)
            for sums in (held, length, linked, links, articles, paragraphs):
                sums[e.parent] += sums[i]
        self.held, self.linked, self.length = held, linked, length
        self.dropped = [False] * n
        inside = [False] * n  # an article or main element
        for i, e in enumerate(self.elements[1:], 1):
            inside[i] = inside[e.parent] or e.tag in ("article", "main")
            wraps = articles[i] > (e.tag in ("article", "main")) or 2 * held[i] > held[0] and (paragraphs[i] > 0 or held[i] >= 200)
            suspect = e.tag in SELDOM and not (e.tag == "header" and inside[i]) or bool(e.words & BOILERPLATE)
            menu = e.tag in ("ul", "ol") and links[i] >= 3 and linked[i] >= 0.8 * length[i]
            comments = e.words & COMMENTS and not articles[i] and held[i] < held[0] and e.tag not in ("html", "body")
            self.dropped[i] = never[i] or self.dropped[e.parent] or menu or bool(comments) or suspect and not wraps and e.tag not in ("html", "body", "main")
        self.kept = [not self.dropped[b.at] for b in self.blocks]
        self._container = list(range(n))
        for i, e in enumerate(self.elements):
            if i and (e.tag not in _markup.CONTAINERS or self.dropped[i]):
                self._container[i] = self._container[e.parent]

    def path(self, at: int) -> str:
        """Generalised path of a container: the containers from the page to it."""
        names = []
        while at > 0:
            if self.elements[at].tag in _markup.CONTAINERS:
                names.append(general(self.elements[at]))
            at = self.elements[at].parent
        path = "".join(f"/{name}" for name in reversed(names))
        return path if len(path) <= LONGEST_PATH else hashlib.sha256(path.encode("utf-8", "replace")).hexdigest()

    def scores(self) -> dict[int, float]:
        """Points of the containers that hold running text."""
        points: dict[int, float] = {}
        for b, run, kept in zip(self.blocks, self.running, self.kept, strict=True):
            if not kept or not run or self.elements[b.at].tag in HEADINGS:
                continue
            worth = (1 + len(PUNCTUATION.findall(b.text)) + min(run / 100, 3)) * (1 - b.linked / len(b.text))
            at, level = self._container[b.at], 0
            while at >= 0 and level < 5:
                points[at] = points.get(at, 0) + worth / (1, 2, 6, 9, 12)[level]
                at, level = self._container[self.elements[at].parent] if at else -1, level + 1
        for at in points:
            e = self.elements[at]
            prior = 1.25 if e.tag in ("article", "main") or e.words & ARTICLE else 1.0
            points[at] *= prior * (0.5 if e.words & (BOILERPLATE | COMMENTS) else 1) * (1 - min(1, self.linked[at] / max(self.length[at], 1)))
        return points

    def _below(self, at: int) -> list[bool]:
        """Which elements are ``at`` or stand in it."""
        out = [False] * len(self.elements)
        out[at] = True
        for i in range(at + 1, len(out)):
            out[i] = out[self.elements[i].parent]
        return out

    def _more_of_it(self, outer: int, inner: list[bool]) -> bool | None:
        """Whether all that ``outer`` holds beside the inner container is more of the article; None if it holds nothing more."""
        below = self._below(outer)
        more = [i for i, b in enumerate(self.blocks) if self.kept[i] and below[b.at] and not inner[b.at]]
        if not more:
            return None
        wide = self.elements[outer].tag in ("", "html", "body")
        headline = any(self.elements[self.blocks[i].at].tag == "h1" for i in more)
        if headline and not wide and 2 * sum(self.running[i] for i in more) <= self.held[outer] and 3 * self.linked[outer] <= self.length[outer]:
            return True
        names = {general(self.elements[i]) for i, e in enumerate(self.elements) if inner[i] and not inner[e.parent]}
        for i in more:
            b = self.blocks[i]
            beside = self._container[b.at]
            alike = beside == outer or general(self.elements[beside]) in names or self.elements[beside].tag in ("ul", "ol", "dl", "table", "tbody", "tr", "td", "blockquote", "figure")
            if not alike or 2 * b.linked > len(b.text) or self.elements[b.at].tag not in TEXTUAL and not (len(b.text) >= 40 and PUNCTUATION.search(b.text)):
                return False
        return True

    def best_container(self) -> int | None:
        points = self.scores()
        if not points:
            return None
        best = max(points, key=lambda at: (points[at], at))
        at, inner = best, self._below(best)
        while at and self.elements[at].tag not in ("article", "main"):
            at = self._container[self.elements[at].parent]
            more = self._more_of_it(at, inner)
            if more is False:
                break
            if more:
                best, inner = at, self._below(at)
        return best

    def best(self) -> str | None:
        """The path this page votes for; None without running text."""
        at = self.best_container()
        return None if at is None else self.path(at)

    def _held_by(self, inside: list[bool]) -> list[str]:
        return [b.text for b, kept in zip(self.blocks, self.kept, strict=True) if kept and inside[b.at]]

    def extract(self, path: str | None) -> str:
        """Kept blocks below ``path``; where the page has no text there, below its own best container."""
        inside = [False] * len(self.elements)
        if path is not None:
            last = path.rsplit("/", 1)[-1] if "/" in path else None
            for i, e in enumerate(self.elements):
                own = not self.dropped[i] and (not i or e.tag in _markup.CONTAINERS and last in (None, general(e))) and self.path(i) == path
                inside[i] = own or i > 0 and inside[e.parent]
        out = self._held_by(inside)
        if not out:
            at = self.best_container()
            out = self._held_by(self._below(at or 0))
        return "\n".join(out)


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b for whole in batches for b in pieces(whole, "html")):
        votes: dict[tuple[str, str | None], int] = {}
        for host, text in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            path = Page(text or "").best()
            path = path and path.encode("utf-8", "replace").decode()
            votes[host, path] = votes.get((host, path), 0) + 1
        hosts, paths = zip(*votes, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(votes.values(), pa.int64())], ["host", "path", "votes"])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b for whole in batches for b in pieces(whole, "html")):
        texts = [Page(h or "").extract(p) for h, p in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist(), strict=True)]
        sizes = pa.array(map(len, texts), pa.int64())
        texts = pa.array([t.encode("utf-8", "replace").decode() for t in texts], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), texts, sizes], ["page_id", "url", "text", "n_chars"])


def host_of(url):
    """Lower-case host of a URL column, without user and port; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def host_paths(pages: DataFrame) -> DataFrame:
    """host, path, n: the path with most votes on each host (ties to the deeper, then to the greater; null without votes), and its pages."""
    votes = pages.select(host_of(F.col("url").cast("string")).alias("host"), F.col("html").cast("string").alias("html"))
    votes = votes.mapInArrow(_votes, "host string, path string, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    depth = F.length(F.regexp_replace("path", "[^/]", ""))
    best = F.max(F.when(F.col("path").isNotNull(), F.struct("votes", depth.alias("depth"), "path"))).alias("best")
    return votes.groupBy("host").agg(best, F.sum("votes").alias("n")).select("host", "best.path", "n")


def extract(pages: DataFrame) -> DataFrame:
    """Main text of every page (page_id, url, html): page_id, url, text, n_chars.

    Null or empty html gives an empty text; pages without a host form one group; repeated rows give a row each; other columns
    are ignored. Text outside the winning path is dropped only where the page has text at that path. Hosts with a large share
    of all pages get their path by broadcast (at most 4,096 short paths), so their pages don't travel.
    """
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    )
    hosted = own.withColumn("host", host_of(F.col("url")))
    joined = join_counted(hosted, host_paths(own), ["host"], own.count()).select("page_id", "url", "html", "path")
    return joined.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
