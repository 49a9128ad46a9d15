"""Operator 6: main text of web pages by consensus host paths.

1. Each page is scanned once. Containers (article, main, section, div, td, body ...) are known
   by their path of tags and classes, generalised: digits in classes count alike. Menus, page
   headers, footers, sidebars, notices, adverts, forms or comments by tag or whole class name
   count nothing, unless the page has next to no text without them.
2. A path holds a page's text if nothing is left outside but labels: no paragraph or heading
   that is not a link, and less than a tenth of the score (length of text less that of links).
3. In Spark, the pages of a host vote for all paths that hold their text; of the paths with
   nearly all votes the deepest one wins. A hot host is summed where its pages are first.
4. Every page is scanned again with its host's winning path. Where that path does not hold the page's
   text, what is outside stays, but for blocks that other pages of the host have as well; a page of
   which the path holds no more than half falls back to its own deepest path.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobtrail.llm.common import bounded_batches, map_batches, store, texts_of

#: Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
CONTAINERS = frozenset("article main section div td body blockquote".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object canvas xmp noembed noframes".split())
DROPPED = frozenset("nav header footer aside form button select dialog menu head".split())
CLOSES_P = BLOCKS - {"body", "html", "title"}
#: Words of classes, ids and roles that mark what is not the article.
NOISE = re.compile(
    r"nav|navbar|navigation|menus?|breadcrumbs?|header|masthead|banner|footer|sidebar|side|aside|ads?|advert\w*|sponsor\w*|promo\w*|cookies?|consent|"
    r"notices?|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*|comments?|commentlist|replies|respond|disqus|widget|pager|pagination|toolbar|search"
)
#: Of these, the heads of an article too; and what readers write, which may be longer than the article.
HEADS = frozenset("header masthead banner".split())
REPLIES = re.compile(r"comments?|commentlist|replies|respond|disqus|cookies?|consent|ads?|advert\w*|sponsor\w*")
#: Words that may follow a word of noise, words that make a name one of layout or state, and words of articles.
FILL = frozenset("box bar list slot wrap wrapper container block item items link links button buttons icon icons unit panel form posts articles stories section inner top bottom left right main primary secondary area thread".split())
LAYOUT = frozenset("has with no without not hide hidden layout show is one two both single open closed".split())
ARTICLE = frozenset("article post entry story content".split())
#: A quote counts after "=" only; what is not closed goes on to the end of the page. Nothing is tried twice, so time grows with length.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?)*+)(?:>|\Z)", re.S)
#: Longer paths are written by a hash of what they begin with.
LONG_PATH = 1000
NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
DIGITS = re.compile(r"\d+")
WHITE = re.compile(r"\s+")
WORD = re.compile(r"[^a-z]+")
#: Kinds of noise: by class, id, role or form; what readers or advertisers write; a page's or an article's head; by tag.
SOFT, REPLY, HEAD, HARD = 1, 2, 3, 4
#: Text in these is the page's own; bare text of a container may be a label.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote dd dt td th figcaption caption summary address".split())
ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """('text', raw text, ''), ('open', tag, attributes) and ('close', tag, '') in page order, without what RAW elements hold."""
    at, find = 0, TOKEN.search
    while m := find(page, at):
        if m.start() > at:
            yield "text", page[at : m.start()], ""
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            yield "close", tag, ""
        elif tag in RAW:
            if not m[3].endswith("/"):
                end = ENDS[tag].search(page, at)
                at = end.end() if end else len(page)
        else:
            yield "open", tag, m[3]
    if at < len(page):
        yield "text", page[at:], ""


@lru_cache(maxsize=10_000)
def named_noise(name: str) -> int:
    """Of one whole class, id or role: 0 content, or the kind of noise.

    Its last word names the thing ("post-comments"), or its first with words of FILL after it
    ("share-buttons"); "has-sidebar", "comments-open" and "search-result" are names of other things.
    """
    words = [w for w in WORD.split(name) if w]
    if not words or not LAYOUT.isdisjoint(words):
        return 0
    last, first = words[-1], words[0]
    if not NOISE.fullmatch(last):
        if not NOISE.fullmatch(first) or any(w not in FILL and not NOISE.fullmatch(w) for w in words):
            return 0
        last = first
    if last in HEADS:
        return 0 if not ARTICLE.isdisjoint(words) else HEAD
    return REPLY if any(REPLIES.fullmatch(w) for w in words) else SOFT


def step(tag: str, attributes: str) -> tuple[str, int]:
    """The generalised name of an element, and the kind of noise it is by tag, class, id or role."""
    noise = (SOFT if tag == "form" else HEAD if tag == "header" else HARD) if tag in DROPPED else 0
    if not attributes:
        return tag, noise
    named = {k.lower(): (a or b or c or "").lower() for k, a, b, c in NAMED.findall(attributes)}
    if not named:
        return tag, noise
    classes = sorted(DIGITS.sub("0", c) for c in named.get("class", "").split())
    if not noise and tag not in ("body", "html", "main", "article"):
        noise = max((named_noise(n) for v in named.values() for n in v.split()), default=0)
        if noise == HEAD and tag in HEADINGS:
            noise = 0
    return ".".join([tag, *classes]), noise


class Scan:
    """One pass over a page: blocks of text with the containers they are in.

    A part of a sentence is noise only by the name of adverts or replies; under any other name it goes
    with its sentence, and is left out where it is a link or all of its block.
    What is noise by class, id, role or form is a zone. A zone without which the page would
    have next to no text is none: its text counts (of replies and adverts, only if there is no other).
    """

    def __init__(self, page: str):
        blocks: list[tuple[str, int, int, int, bool]] = []  # text, innermost container, zone, score, paragraph or heading
        self.paths: list[tuple[str, int]] = [("", -1)]  # path, parent
        self.depth: dict[str, int] = {"": 0}
        opened: Counter = Counter()  # elements of each name on the stack
        block_at = [0]  # where the stack has blocks
        self.zones: list[tuple[int, int]] = [(-1, 0)]  # parent, kind
        stack: list[tuple[str, int, int, int]] = [("", 0, 0, 0)]  # tag, container, zone, kind if its text is dropped
        parts: list[tuple[str, bool]] = []  # text, whether it is named as noise within its block
        links = linked = 0

        def flush() -> None:
            nonlocal linked
            if parts and not any(t.strip() for t, weak in parts if not weak):
                parts.clear()  # no sentence around it
            text = WHITE.sub(" ", entities.unescape("".join(t for t, _ in parts))).strip() if parts else ""
            parts.clear()
            if text:
                tag, inside, zone, _ = stack[block_at[-1]]
                score = max(0, len(text) - 2 * linked)
                blocks.append((text, inside, zone, score, score > 0 and tag in PARAGRAPHS))
            linked = 0

        def push(*element) -> None:
            if element[0] in BLOCKS:
                block_at.append(len(stack))
            stack.append(element)
            opened[element[0]] += 1

        def leave(k: int) -> None:
            opened.subtract(x[0] for x in stack[k:])
            del stack[k:]
            while block_at[-1] >= k > 0:
                block_at.pop()

        for kind, a, b in events(page):
            if kind == "text":
                dropped = stack[-1][3]
                if not dropped or dropped == SOFT and not links:
                    parts.append((a, dropped == SOFT))
                    if links:
                        linked += len(a)
            elif kind == "open":
                if a == "a":
                    links = 1
                if a == "br":
                    parts.append((" ", False))
                if a in BLOCKS:
                    flush()
                    near = block_at[-1]
                    if a in CLOSES_P and stack[near][0] == "p" or a == "li" and stack[near][0] == "li":
                        leave(near)
                    name, noise = step(a, b)
                    _, inside, zone, dropped = stack[-1]
                    if dropped in (SOFT, REPLY):  # an inline element around blocks is a zone
                        dropped, noise = 0, max(noise, dropped)
                    if noise == HEAD and opened["article"] > 0:
                        noise = 0
                    elif noise == HEAD:
                        noise = HARD if a == "header" else SOFT
                    if not dropped and noise == HARD:
                        dropped = HARD
                    elif not dropped and noise:
                        self.zones.append((zone, noise))
                        zone = len(self.zones) - 1
                    if a in CONTAINERS and not dropped:
                        above = self.paths[inside][0]
                        start = above if len(above) < LONG_PATH else f"#{xxhash.xxh3_64_hexdigest(above)}"
                        self.paths.append((f"{start}/{name}", inside))
                        self.depth[f"{start}/{name}"] = self.depth[above] + 1
                        inside = len(self.paths) - 1
                    if a not in VOID:
                        push(a, inside, zone, dropped)
                elif a not in VOID:
                    _, inside, zone, dropped = stack[-1]
                    noise = dropped or step(a, b)[1]
                    if noise == HEAD and stack[block_at[-1]][0] in HEADINGS:
                        noise = 0
                    if noise:
                        push(a, inside, zone, SOFT if noise == HEAD else noise)
            else:
                if a == "a":
                    links = 0
                if a in BLOCKS:
                    flush()
                    if opened[a] > 0:
                        leave(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == a))
                elif opened[a] > 0:
                    k = next((k for k in range(len(stack) - 1, block_at[-1], -1) if stack[k][0] == a), 0)
                    if k:
                        leave(k)
        flush()
        seen = self.seen(blocks)
        self.blocks = [(t, c, s, p) for t, c, z, s, p in blocks if seen[z]]

    def seen(self, blocks: list) -> list[bool]:
        """Of each zone whether its text counts."""
        whole, own = [0] * len(self.zones), [0] * len(self.zones)
        for _, _, zone, score, _ in blocks:
            own[zone] += score
        for k in range(len(whole) - 1, -1, -1):
            whole[k] += own[k]
            if k:
                whole[self.zones[k][0]] += whole[k]
        out = [True] + [False] * (len(whole) - 1)
        within: dict[int, list[int]] = {}
        for k in range(1, len(out)):
            within.setdefault(self.zones[k][0], []).append(k)
        level, text = [0], 0
        while level:  # zones within those that count, level by level
            text += sum(own[k] for k in level)
            level = [k for above in level for k in within.get(above, ()) if whole[k] and (not text if self.zones[k][1] == REPLY else 10 * text < whole[k])]
            if text == 0 and any(self.zones[k][1] != REPLY for k in level):
                level = [k for k in level if self.zones[k][1] != REPLY]
            for k in level:
                out[k] = True
        return out

    def totals(self) -> dict[str, tuple[int, int]]:
        """Of each path the score and the number of paragraphs and headings within."""
        score, many = [0] * len(self.paths), [0] * len(self.paths)
        for _, k, s, paragraph in self.blocks:
            score[k] += s
            many[k] += paragraph
        out: dict[str, tuple[int, int]] = {}
        for k in range(len(score) - 1, -1, -1):
            path, parent = self.paths[k]
            if k:
                score[parent] += score[k]
                many[parent] += many[k]
            s, n = out.get(path, (0, 0))
            out[path] = s + score[k], n + many[k]
        return out

    def whole(self) -> list[str]:
        """Paths with all paragraphs and headings of the page and nearly all of its text."""
        total = self.totals()
        score, many = total[""]
        return [p for p, (s, n) in total.items() if n == many and s * 10 >= score * 9]

    def split(self, path: str) -> list[tuple[str, str]]:
        """(block, "") of what is within containers of that path, and (block, its place) of doubtful text outside.

        If the path does not hold most of the page, the page's own deepest whole one is taken. Text outside
        a path that is whole is a label; outside another one it may be the page's own.
        """
        total, own = self.totals(), self.whole()
        if 2 * total.get(path, (0, 0))[0] <= total[""][0]:
            path = min(own, key=lambda p: (-self.depth[p], p))
        doubtful = path not in own
        inside = []
        for p, parent in self.paths:
            inside.append(p == path or parent >= 0 and inside[parent])
        return [(t, "" if inside[k] else self.paths[k][0] or "/") for t, k, s, _ in self.blocks if inside[k] or doubtful and s]

    def text(self, path: str) -> str:
        """The text of a page that no other page of its host is like."""
        return "\n\n".join(t for t, _ in self.split(path))


def vote():
    """f(batch of host, html) -> host, votes: path and depth of each that holds the page's text."""
    kind = pa.list_(pa.struct([("path", pa.string()), ("depth", pa.int32())]))

    def run(batch: pa.RecordBatch) -> list:
        out = []
        for page in texts_of(batch.column(1)):
            scan = Scan(page.decode())
            out.append([{"path": p, "depth": scan.depth[p]} for p in scan.whole()] if scan.blocks else [])
        return [batch.column(0), pa.array(out, kind)]

    return run


def extract():
    """f(batch of page_id, url, html, host, path) -> page_id, url, host, text, and blocks with hashes if some are doubtful (text is then what is sure)."""
    kind = pa.list_(pa.struct([("block", pa.string()), ("mark", pa.int64())]))

    def run(batch: pa.RecordBatch) -> list:
        ids, urls, pages, hosts, paths = batch.columns
        texts, blocks = [], []
        for h, p in zip(texts_of(pages), paths.to_pylist()):
            split = Scan(h.decode()).split(p or "")
            texts.append("\n\n".join(t for t, place in split if not place))
            marks = [xxhash.xxh3_64_intdigest(f"{place}\n{t}") - (1 << 63) if place else None for t, place in split]
            blocks.append([{"block": t, "mark": m} for (t, _), m in zip(split, marks)] if any(m is not None for m in marks) else None)
        return [ids, urls, hosts, texts, pa.array(blocks, kind)]

    return run


def extract_agreed():
    """f(batch of page_id, url, html, path) -> page_id, url, text: pages of hosts of which no page is doubtful."""

    def run(batch: pa.RecordBatch) -> list:
        ids, urls, pages, paths = batch.columns
        return [ids, urls, [Scan(h.decode()).text(p or "") for h, p in zip(texts_of(pages), paths.to_pylist())]]

    return run


def without_repeats(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of pages with doubtful blocks: those that another page of the host has at the same place are left out.

    Pages count as different by the text that is sure, so copies of a page don't witness against it.
    A block that all pages of a hot host have is one key: counted where its pages are first, joined salted.
    """
    rows = pages.withColumn("row", F.expr("uuid()"))
    rows = store(rows, "doubtful-pages")
    marks = rows.select("row", "host", F.xxhash64("text").alias("page"), F.explode("blocks").alias("b")).where("b.mark is not null").select("row", "host", "page", F.col("b.mark").alias("mark"))
    repeated = marks.groupBy("host", "mark").agg(F.min("page").alias("a"), F.max("page").alias("b")).where("a < b").select("host", "mark")
    salted = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    bad = marks.select("row", "host", "mark").distinct().withColumn("salt", F.pmod(F.hash("row"), F.lit(SALTS))).join(salted, ["host", "mark", "salt"])
    known = bad.groupBy("row").agg(F.collect_set("mark").alias("bad"))
    kept = F.expr("filter(blocks, b -> b.mark is null or not array_contains(coalesce(bad, array()), b.mark))")
    return rows.join(known, "row", "left").select("page_id", "url", F.array_join(F.transform(kept, lambda b: b["block"]), "\n\n").alias("text"))


def main_text(pages: DataFrame) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, url, text, n_chars.

    The host is what the url names, in lower case; pages without one vote together. Null and
    empty html give an empty text. Repeated pages are extracted each, though their votes add up.
    Ties of paths go to the deeper, then to the first by name. Pages of any length are read whole, in
    time that grows with their length. Of blocks outside a host's path those stay that no other page of the
    host has there, pages with equal main text being one. An empty table gives no rows.
    """
    bounded_batches(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    votes = map_batches(rows.select("host", "html"), "host string, votes array<struct<path:string,depth:int>>", vote)
    sums = votes.select("host", F.explode("votes").alias("v")).select("host", "v.*").groupBy("host", "path", "depth").agg(F.count("*").alias("n"))
    # the deepest path that holds the text of nearly all of the host's pages: the root has the votes of all
    pages_of = F.max("n").over(Window.partitionBy("host"))
    good = sums.withColumn("pages", pages_of).where(F.col("n") * 10 >= F.col("pages") * 9)
    best = F.struct(-F.col("depth"), -F.col("n"), "path")
    winners = store(good.groupBy("host").agg(F.min_by("path", best).alias("path"), F.min_by(F.col("n") == F.col("pages"), best).alias("agreed")), "host-paths")
    size, agreed = winners.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 33), F.bool_and("agreed")).first()
    chosen = rows.join(F.broadcast(winners) if (size or 0) <= BROADCAST_BYTES else winners, "host", "left").withColumn("agreed", F.coalesce("agreed", F.lit(True)))
    sure = map_batches(chosen.where("agreed").select("page_id", "url", "html", "path"), "page_id long, url string, text string", extract_agreed)
    if agreed is False:  # a path that holds the text of all pages of its host leaves no page in doubt
        sure = sure.unionByName(of_split_hosts(chosen.where("not agreed")))
    return sure.withColumn("n_chars", F.char_length("text").cast("long"))


def of_split_hosts(chosen: DataFrame) -> DataFrame:
    """(page_id, url, text) of pages with their host and its path, of hosts where that path does not hold every page's text."""
    split = map_batches(chosen.select("page_id", "url", "html", "host", "path"), "page_id long, url string, host string, text string, blocks array<struct<block:string,mark:long>>", extract)
    split = store(split, "split-pages")
    sure = split.where("blocks is null").select("page_id", "url", "text")
    return sure.unionByName(without_repeats(split.where("blocks is not null")))


#: Paths of hosts are broadcast up to so many bytes, else joined by shuffle.
BROADCAST_BYTES = 16 << 20
#: Parts that a block repeated on a host is joined in.
SALTS = 16
