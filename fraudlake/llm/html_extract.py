"""Main text of web pages by differencing each page with its nearest URLs.

Pages are ordered by (host, URL path, id); in that order the pages with the
longest common path stand side by side. A page is reduced to text lines (one
per block element, with the kind of region it stands in), its lines are aligned
with those of the page before and after it on the same host by a longest
common subsequence, and shared lines are deleted as template text.

Where the markup names the article (article or main element) the lines outside it
go and those inside it are differenced with the ten nearest URLs of the host.
Articles quote common passages, so there a line is template text only if at least
eight of these pages hold it at the same tag path and in the same order; it must
stand once in each. Headings, list items and table cells belong to the text behind
them and go only at the article's end. A page that shares more than half of the
text with the page compared, or with one that has voted, is a copy of that article
and does not vote; on other pages a copy deletes nothing. Regions that the markup
itself declares to be something else (menus, sidebars, forms, scripts, notices,
adverts, comments ...) never count as lines of the article. A form and an element
judged by its class or id only are no such region if they are a wrapper: if the
only article of the page or most of its text stands in them.

The order is dealt into range buckets of the sort key; each bucket gets copies
of the rows of its hosts before and after it, as many as a page is compared with,
so a host of any size is spread over tasks and no page depends on where a bucket
ends.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraudlake.llm.common import at_most_count, shuffle_partitions

VOID = set("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = set("""address article aside blockquote body br caption center dd details dialog dir div dl dt
fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol
option p pre section summary table tbody td tfoot th thead title tr ul""".split())
DROPPED = set("""head script style noscript template svg math canvas iframe object audio video
button select textarea input nav aside footer menu dialog""".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
MAIN_TAGS, MAIN_ROLES = {"article", "main"}, {"main", "article"}
MAIN_WORDS = {"articlebody", "article-body", "post-content", "entry-content", "article-content"}
DROPPED_ROLES = set("navigation banner contentinfo complementary search dialog alert menu menubar".split())
DROPPED_WORDS = set("""ad ads advert adverts advertisement advertising sponsor sponsored promo banner
nav navbar navigation menu breadcrumb breadcrumbs sidebar widget cookie cookies consent gdpr notice
notices popup modal overlay newsletter subscribe signup share sharing social related recommended
comment comments reply replies respond disqus footer header masthead copyright login search
pagination pager toolbar""".split())
# "has-sidebar", "category-social" or "search-page" say something of a whole page or post
STATES = set("has no not with without is hide show category tag type format status".split())
WHOLES = set("page pages layout view site open closed enabled disabled".split())
COMMENTS = set("comment comments reply replies respond disqus".split())
MOST = 0.75                                   # share of a text that makes its element a wrapper
NEAREST, ENOUGH = 10, 8                       # pages compared inside an article, votes that make a line template
# lines that belong to the text behind them
LABELS = HEADINGS | set("li dt dd th td caption figcaption legend summary option".split())
_PART = re.compile(r"[a-z]+")


def listed_words(names: str) -> set[str]:
    """The listed words that classes or ids name as the element's own kind: whole tokens,
    or parts of compound ones ("cookie-banner") that are not a state of a page or post."""
    found = set()
    for token in names.split():
        parts = _PART.findall(token)
        if len(parts) == 1 or parts and parts[0] not in STATES and parts[-1] not in WHOLES:
            found.update(DROPPED_WORDS.intersection(parts))
    return found


class _Lines(HTMLParser):
    """Collects (text, tag path inside an article or main element, standing) per block.

    Forms and elements with listed words are "soft": their lines are collected
    too, and ``kept`` decides at the end which of them are wrappers."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str]] = []     # tag, kind: "", main, dropped, header, soft
        self.dropped = self.main = self.header = 0
        self.soft: list[int] = []                 # open soft elements
        self.words: list[set[str]] = []           # per soft element
        self.mains: list[int] = []                # open main elements
        self.around: list[tuple[int, ...]] = []   # per main element: soft elements around it
        # text, mains, in heading, softs, path
        self.found: list[tuple[str, tuple[int, ...], bool, tuple[int, ...], str]] = []
        self.buffer: list[str] = []

    def _kind(self, tag: str, attrs: dict) -> tuple[str, set[str]]:
        names = f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower()
        role = (attrs.get("role") or "").lower()
        style = (attrs.get("style") or "").replace(" ", "").lower()
        if tag in DROPPED or role in DROPPED_ROLES or "hidden" in attrs \
                or attrs.get("aria-hidden") == "true" or "display:none" in style:
            return "dropped", set()
        if tag == "header":
            return "header", set()
        listed = listed_words(names) if names != " " else set()
        if (tag in MAIN_TAGS or role in MAIN_ROLES or MAIN_WORDS.intersection(names.split())
                or (attrs.get("itemprop") or "").lower() == "articlebody") \
                and not (tag != "main" and listed and (self.mains or {"comment", "reply"} & listed)):
            return "main", set()
        if tag not in ("html", "body", "main") and (listed or tag == "form"):
            return "soft", listed
        return "", set()

    def _flush(self) -> None:
        text = " ".join("".join(self.buffer).split())
        self.buffer.clear()
        if text and not self.dropped:
            in_heading = any(t in HEADINGS for t, _ in self.open)
            if not self.header or (self.main and in_heading):
                self.found.append((text, tuple(self.mains), in_heading, tuple(self.soft), self._path()))

    def _path(self) -> str:
        """Tags from the outermost open main element to the innermost block."""
        if not self.mains:
            return ""
        first = next(i for i, (_, kind) in enumerate(self.open) if kind == "main")
        return "/".join([self.open[first][0], *(t for t, _ in self.open[first + 1:] if t in BLOCKS)])

    def kept(self) -> list[tuple[str, str]]:
        if not self.words:
            return [(t, path) for t, _, _, _, path in self.found]
        whole: set[int] = set()                   # soft elements that are wrappers
        size: dict[int, int] = {}                 # text of a main element outside soft elements in it
        for text, mains, _, soft, _ in self.found:
            for m in mains:
                if len(soft) == len(self.around[m]):
                    size[m] = size.get(m, 0) + len(text)
        if size and all(self.around[m] for m in size):
            whole.update(self.around[max(size, key=lambda m: (not any(
                COMMENTS & self.words[e] for e in self.around[m]), size[m]))])
        clear = {m for m, soft in enumerate(self.around) if whole.issuperset(soft)}
        area = [x for x in self.found if clear.intersection(x[1])] or self.found
        held: dict[int, int] = {}
        for text, _, _, soft, _ in area:
            for e in soft:
                held[e] = held.get(e, 0) + len(text)
        total = sum(len(x[0]) for x in area)
        whole.update(e for e, n in held.items() if n > MOST * total and not COMMENTS & self.words[e])
        return [(t, path) for t, mains, heading, soft, path in self.found if all(
            e in whole or "header" in self.words[e] and mains and heading for e in soft)]

    def _pop(self, count: int) -> None:
        self._flush()
        for _ in range(count):
            self._leave(self.open.pop()[1])

    def _enter(self, tag: str, kind: str, listed: set[str]) -> None:
        self.open.append((tag, kind))
        if kind == "soft":
            self.soft.append(len(self.words))
            self.words.append(listed)
        elif kind:
            setattr(self, kind, getattr(self, kind) + 1)
        if kind == "main":
            self.mains.append(len(self.around))
            self.around.append(tuple(self.soft))

    def _leave(self, kind: str) -> None:
        if kind == "soft":
            self.soft.pop()
        elif kind:
            setattr(self, kind, getattr(self, kind) - 1)
        if kind == "main":
            self.mains.pop()

    def _close_open(self, tags: set[str], stop: set[str]) -> None:
        for depth, (t, _) in enumerate(reversed(self.open), 1):
            if t in tags:
                self._pop(depth)
                return
            if t in stop:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS or tag in DROPPED:
            self._flush()
        if tag in VOID:
            return
        if tag in BLOCKS:
            self._close_open({"p"}, {"article", "aside", "section", "div", "td", "li", "blockquote", "main", "form"})
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            same = {"dt", "dd"} if tag in ("dt", "dd") else {"td", "th"} if tag in ("td", "th") else {tag}
            self._close_open(same, {"ul", "ol", "dl", "table", "select", "div", "article"})
        kind, listed = self._kind(tag, dict(attrs))
        if kind == "main":
            # an article does not start inside a menu, header or sidebar: their end tag is missing
            lost = [i for i, (t, _) in enumerate(self.open) if t in ("head", "nav", "header", "aside", "menu")]
            if lost:
                self._pop(len(self.open) - lost[0])
        elif tag == "body":
            self._close_open({"head"}, set())
        elif kind and tag not in BLOCKS:
            self._flush()
        self._enter(tag, kind, listed)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        for depth, (t, _) in enumerate(reversed(self.open), 1):
            if t == tag:
                if tag in BLOCKS or tag in DROPPED:
                    self._pop(depth)
                elif depth == 1:
                    _, kind = self.open[-1]
                    if kind:
                        self._pop(1)
                    else:
                        self.open.pop()
                return
            if t in ("body", "article", "main", "table", "div", "section") and tag not in (
                    "body", "html", "article", "main", "table", "div", "section", "nav", "footer", "header", "aside"):
                return

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            self.buffer.append(data)

    def close(self) -> None:
        super().close()
        self._flush()


def page_lines(html: str | None) -> list[tuple[str, str]]:
    """(line, its tag path from the article or main element on, empty outside) in page
    order, without the regions whose markup declares them as something else."""
    parser = _Lines()
    parser.feed(re.sub(r"<!\[[^>]*>", "", html or ""))
    parser.close()
    return parser.kept()


def shared_lines(a: list, b: list) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b``: common ends first,
    then the longest rising run of match places (b's places tried from behind)."""
    n = min(len(a), len(b))
    head = 0
    while head < n and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < n - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    found = {*range(head), *range(len(a) - tail, len(a))}
    places: dict = {}
    for j in range(head, len(b) - tail):
        places.setdefault(b[j], []).append(j)
    ends: list[int] = []                     # smallest last place of a run of each length
    links: list[tuple] = []
    for i in range(head, len(a) - tail):
        for j in reversed(places.get(a[i], ())):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    link = links[-1] if links else None
    while link:
        found.add(link[0])
        link = link[1]
    return found


def _single(lines: list) -> set:
    return {x for x, n in Counter(lines).items() if n == 1}


def _copied(a: list[tuple[str, str]], b: list[tuple[str, str]]) -> bool:
    """More than half of the text of ``a`` stands in ``b`` too."""
    texts = {t for t, _ in b}
    return 2 * sum(len(t) for t, _ in a if t in texts) > sum(len(t) for t, _ in a)


def template_lines(lines: list[tuple[str, str]], nearest: list) -> set[int]:
    """Places in an article's ``lines`` of those that the nearest pages show to be template text."""
    mine, held = _single(lines), Counter()
    for other in nearest:
        held.update(mine.intersection(other))
    if max(held.values(), default=0) < ENOUGH:
        return set()
    voters: list = []
    for other in nearest:
        theirs = [x for x in other if x[1]]
        if theirs and not _copied(lines, theirs) and not any(_copied(theirs, v) for v in voters):
            voters.append(theirs)
    votes: Counter = Counter()
    for theirs in voters:
        both = mine & _single(theirs)
        places = [i for i, x in enumerate(lines) if x in both]
        votes.update(places[k] for k in shared_lines([lines[i] for i in places], [x for x in theirs if x in both]))
    found = {i for i, n in votes.items() if n >= ENOUGH}
    last = max((i for i in range(len(lines)) if i not in found), default=-1)
    return {i for i in found if i > last or not LABELS.intersection(lines[i][1].split("/"))}


def main_text(lines: list[tuple[str, str]], before: list | None, after: list | None, nearest: list = ()) -> str:
    """The lines that stay, joined by a space: where the markup names the article, those
    inside it that are no template text by the ``nearest`` pages; else those not shared
    with the page before or after."""
    inside = [x for x in lines if x[1]]
    if inside:
        deleted = template_lines(inside, nearest)
        return " ".join(t for i, (t, _) in enumerate(inside) if i not in deleted)
    texts = [t for t, _ in lines]
    size = sum(map(len, texts))
    deleted = set()
    for other in (before, after):
        if other is not None:
            same = shared_lines(texts, [t for t, _ in other])
            if 2 * sum(len(texts[i]) for i in same) <= size:      # else two copies of one article
                deleted |= same
    return " ".join(t for i, t in enumerate(texts) if i not in deleted)


def _ordered(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    url = F.coalesce(F.col(url_col), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1)
    number = F.lpad(F.coalesce(F.col(id_col).cast("string"), F.lit("")), 20, "0")
    return pages.withColumn("_host", host).withColumn("_key", F.concat(host, F.lit("\x01"), path, F.lit("\x01"), number))


def _edges(rows: DataFrame, order: Column) -> dict[int, list[str]]:
    """The first keys of every bucket in that order, as many as a page is compared with."""
    nth = F.row_number().over(Window.partitionBy("_bucket").orderBy(order))
    found: dict[int, list[str]] = {}
    for r in rows.select("_bucket", "_key", nth.alias("_nth")).where(F.col("_nth") <= NEAREST).orderBy("_nth").collect():
        found.setdefault(r["_bucket"], []).append(r["_key"])
    return found


def _moves(firsts: dict[int, list[str]], lasts: dict[int, list[str]]) -> list[tuple[str, int]]:
    """(key, bucket that gets a copy of its rows): the nearest keys on the same host
    before and after each bucket, over as many buckets as hold them."""
    order, moves = sorted(firsts), set()
    for keys, edges, buckets in ((lasts, firsts, order), (firsts, lasts, order[::-1])):
        passed: list[str] = []                  # nearest keys before the bucket, nearest first
        for bucket in buckets:
            host = edges[bucket][0].split("\x01")[0]
            moves.update((key, bucket) for key in passed if key.split("\x01")[0] == host)
            passed = (keys[bucket] + passed)[:NEAREST]
    return sorted(moves)


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
              html_col: str = "html") -> DataFrame:
    """(id, url, text) of every page. Null or empty html gives an empty text; a null or
    odd url counts as host ''; a page alone on its host is judged by its markup.
    Repeated rows stand side by side and count as copies. An empty table gives no rows."""
    spark = pages.sparkSession
    rows = _ordered(pages.select(id_col, url_col, html_col), id_col, url_col)
    # bucket starts: one key per range partition (their number follows the shuffle partitions)
    keys = rows.select("_key").repartitionByRange(4 * shuffle_partitions(spark), "_key")
    firsts = keys.groupBy(F.spark_partition_id()).agg(F.min("_key").alias("first"))
    bounds = sorted(r["first"] for r in firsts.collect())[1:]
    bucket = at_most_count(F.col("_key"), bounds)
    rows = rows.withColumn("_bucket", bucket)
    moves = _moves(_edges(rows, F.col("_key")), _edges(rows, F.col("_key").desc()))
    rows = rows.withColumn("_copy", F.lit(False))
    if moves:
        to = F.broadcast(spark.createDataFrame(moves, "_key string, _to int"))     # 2 * NEAREST rows per bucket
        copies = rows.join(to, "_key").withColumn("_bucket", F.col("_to")).withColumn("_copy", F.lit(True)).drop("_to")
        rows = rows.unionByName(copies)

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["_key", html_col], kind="stable", ignore_index=True)
        lines = [page_lines(h) for h in df[html_col]]
        hosts, copy = df["_host"].tolist(), df["_copy"].tolist()
        text, first, last = [], 0, -1                       # places of the host's pages
        for i in range(len(df)):
            if i > last:
                first = last = i
                while last + 1 < len(df) and hosts[last + 1] == hosts[i]:
                    last += 1
            if copy[i]:
                text.append("")
                continue
            near = [lines[j] if first <= j <= last else None for j in (i - 1, i + 1)]
            start = max(first, min(i - NEAREST // 2, last - NEAREST))
            text.append(main_text(lines[i], *near, lines[start:i] + lines[i + 1:min(last, start + NEAREST) + 1]))
        out = df[[id_col, url_col]].assign(text=text)
        return out[~df["_copy"]]

    kinds = dict(pages.dtypes)
    return rows.groupBy("_bucket").applyInPandas(
        run, f"{id_col} {kinds[id_col]}, {url_col} {kinds[url_col]}, text string")
