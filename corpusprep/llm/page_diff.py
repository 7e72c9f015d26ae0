"""Main text of web pages by nearest-URL page differencing.

1. each page is read into block lines, each with a flag: inside a marked article, inside a marked main part,
   or open. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and readers' comments
   (by element, role or class name) give no lines. A form, or a class name of the page's layout, is no proof against what stands inside: an
   element that holds over half of the page's words outside links is a wrapper, and one named like a list of links that
   holds ``PROSE`` words or more outside links, and fewer in links, is none; both count as not named. Time follows the length of the page, however it is nested;
2. every page, as 128 bits of each of its lines, is dealt out in ranges of (host, path) and sorted, so neighbours meet in one task and a
   host with a third of all pages is spread over many; adjacent pages of a host with equal lines are one run;
3. each run is aligned with the runs before and after it, the nearest pages of the host on both sides whose lines
   differ, by longest common subsequence; the lines shared with one of them are the template. A task finishes the runs
   inside its range; the first and last run of each range are finished by a join with the runs at the other ranges' edges, so
   the result doesn't depend on where ranges end;
4. what differencing found is joined to the pages, and the template is deleted. A check by the page's own marks follows: on a page
   with a marked article (else, a marked main part) the template lines inside it are put back (``n_restored`` of
   ``n_shared``), and the lines outside it go.

The check is needed because two articles of a host may hold the same line, and one article may stand at two URLs, so
differencing alone would take true text for template; and menus that differ on every page would pass
for text. Where a page does not say what its article is, differencing decides.

Defined results: a null html is empty and has an empty text; null or odd URLs are of host and path as far as they
can be read (null: one host of their own); repeated rows each get a row; a page without a differing neighbour
of its host shares no lines; empty in, empty out. Other columns do not take part and can't clash.
"""

from __future__ import annotations

import hashlib
import html as references
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprep.llm.common import bounded_batches, materialize, row_key

HELD = 1000  # pages of a run, or finished ones, that a task holds; further pages of the run get its template by a join
DIGEST = 16  # bytes that stand for a line: of 10^10 different lines no two meet but by a chance of 10^-19
DENSE = 64  # equal pairs for each line from which two pages are aligned by bits
#: Elements whose content is never text, and whose content is chrome; elements that begin a block or have no end.
DROPPED = frozenset("script style noscript template svg head iframe object select textarea button canvas video audio math".split())
CHROME = frozenset("nav header footer aside form menu dialog fieldset".split())
BLOCKS = frozenset(("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
                    " h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul").split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Roles, and words in class and id names, that mark chrome or the article.
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
WORDS = frozenset(("ad ads adsense adbox adslot advert advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent"
                   " disclaimer disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification popup promo promos"
                   " promoted related replies respond share sharing sidebar social sponsor sponsored subscribe toolbar widget").split())
#: Those of them that the page's layout uses, too, and those that name lists of links.
LAYOUT = frozenset("banner footer header masthead sidebar toolbar widget".split())
LINKS = frozenset("breadcrumb breadcrumbs menu nav navbar navigation related share sharing social".split())
PROSE = 25
NEUTRAL = frozenset("has with no without is not".split())
BODIES = frozenset("article-body article-content article-text post-body post-content entry-content story-body".split())
#: An open element of the kind on the left ends when one of those on the right begins.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "p": BLOCKS, "option": {"option"}}
TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)
    |<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>[^>"'=]+|=\s*"[^"]*"|=\s*'[^']*'|[="'])*+)(?:>|$)""", re.S | re.X)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
SPACE = re.compile(r"\s+")
GONE, OPEN, MAIN, ARTICLE = range(4)


def name_words(attributes: dict[str, str]) -> set[str]:
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split()
    return {w for n in names if (part := re.split(r"[-_]+", n))[0] not in NEUTRAL for w in part}


def read_attributes(attributes: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if "=" in attributes else {}


@lru_cache(maxsize=4096)
def flag_inside(tag: str, attributes: str, flag: int, spared: bool = False) -> int:
    """The flag of what stands in an element that begins where ``flag`` holds; ``spared``: forms and names of layout or links tell nothing."""
    if flag == GONE:
        return GONE
    found = read_attributes(attributes)
    role = found.get("role", "").lower()
    in_article = flag == ARTICLE  # an article has a header of its own
    if tag in CHROME and not (in_article and tag == "header") and not (spared and tag in ("form", "fieldset")):
        return GONE
    if tag not in ("html", "body"):
        told = WORDS - ({"header"} if in_article else set()) - (LAYOUT | LINKS if spared else set())
        if role in ROLES or found.get("aria-hidden") == "true" or "hidden" in attributes.lower().split() or name_words(found) & told:
            return GONE
        if tag == "article" or found.get("itemprop") == "articleBody" or BODIES & set(f"{found.get('class', '')} {found.get('id', '')}".lower().split()):
            return ARTICLE
        if tag == "main" or role == "main":
            return max(flag, MAIN)
    return flag


def parse(page: str, spared: frozenset[int], count: bool) -> tuple[list[tuple[str, int]], list[tuple[int, bool, int, int]], int]:
    """(line, flag) of each block that has text, in page order, without what is GONE; (place, whether named like links, words outside
    links, words in links) of each element that only a form or a name of layout or links makes GONE, but those at places ``spared``; the page's words
    outside links. Words are counted if ``count``."""
    out: list[tuple[str, int]] = []
    doubtful: list[tuple[int, bool, int, int]] = []
    parts: list[str] = []
    stack: list[tuple] = []  # open elements: tag, the flag around it; of doubtful ones the place and the words before
    places: dict[str, list[int]] = {}  # of the open elements of each tag, and of all blocks, in the stack
    blocks: list[int] = []
    flag, at, end = OPEN, 0, len(page)
    words = [0, 0]

    def close() -> None:
        if parts:
            line = SPACE.sub(" ", references.unescape("".join(parts))).strip()
            parts.clear()
            if line:
                out.append((line, flag))

    def pop() -> int:
        tag, around, doubt = stack.pop()
        places[tag].pop()
        if tag in BLOCKS:
            blocks.pop()
        if doubt:
            start, links, *before = doubt
            doubtful.append((start, links, words[0] - before[0], words[1] - before[1]))
        return around

    while at < end:
        m = TOKEN.search(page, at)
        if flag:
            parts.append(page[at:m.start() if m else end])
        if count:
            words[bool(places.get("a"))] += len(page[at:m.start() if m else end].split())
        if not m:
            break
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA[") and flag:
                parts.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag = m[2].lower()
        if tag == "br":
            if flag:
                parts.append(" ")
        elif m[1]:  # an end tag ends its element and those inside; one of an inline element stays inside its block
            if tag in BLOCKS:
                close()
            if places.get(tag) and (tag in BLOCKS or not blocks or blocks[-1] < places[tag][-1]):
                for _ in range(len(stack) - places[tag][-1]):
                    flag = pop()
        else:
            if tag in BLOCKS:
                close()
            while stack and tag in ENDED_BY.get(stack[-1][0], ()):
                flag = pop()
            if tag in VOID or m[3].rstrip().endswith("/"):
                continue
            if tag in DROPPED:
                # raw text up to the end tag; a page that breaks off inside has no more text
                stop = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = stop.end() if stop else end
                continue
            inner, doubt = flag_inside(tag, m[3], flag, m.start() in spared), None
            known = flag or OPEN  # inside what is gone, names are read all the same
            if flag_inside(tag, m[3], known) == GONE != flag_inside(tag, m[3], known, True):
                doubt = (m.start(), bool(name_words(read_attributes(m[3])) & LINKS), *words)
            if inner > flag:
                close()
            places.setdefault(tag, []).append(len(stack))
            if tag in BLOCKS:
                blocks.append(len(stack))
            stack.append((tag, flag, doubt))
            flag = inner
    close()
    while stack:
        pop()
    return out, doubtful, words[0]


def block_lines(page: str) -> list[tuple[str, int]]:
    """(line, flag) of each block that has text, in page order, without what is GONE."""
    lines, doubtful, _ = parse(page, frozenset(), False)
    if not doubtful:
        return lines
    _, doubtful, total = parse(page, frozenset(), True)
    spared = frozenset(at for at, links, outside, inside in doubtful if 2 * outside > total or links and outside >= PROSE and outside > inside)
    return parse(page, spared, False)[0] if spared else lines


def common_lines(a: list, b: list, dense: int = DENSE) -> set[int]:
    """The indices in ``a`` of one longest common subsequence with ``b``: by chains over the equal pairs, in
    time by their number; by bits, in halves of ``a``, where lines repeat so often that there are over ``dense`` for each line."""
    out: set[int] = set()
    todo = [(0, a, b)]
    while todo:
        at, x, y = todo.pop()
        places: dict = {}
        for j in range(len(y) - 1, -1, -1):
            places.setdefault(y[j], []).append(j)
        if len(x) < 2 or sum(len(places.get(line, ())) for line in x) <= dense * (len(x) + len(y)):
            out.update(at + i for i in chained(x, places))
            continue
        if head := equal_lines(x, y):
            out.update(range(at, at + head))
            todo.append((at + head, x[head:], y[head:]))
            continue
        if tail := equal_lines(x[::-1], y[::-1]):
            out.update(range(at + len(x) - tail, at + len(x)))
            todo.append((at, x[:-tail], y[:-tail]))
            continue
        half = len(x) // 2
        fits = prefix_fits(x[:half], y) + prefix_fits(x[half:][::-1], y[::-1])[::-1]
        cut = int(fits.argmax())
        todo += [(at, x[:half], y[:cut]), (at + half, x[half:], y[cut:])]
    return out


def equal_lines(a: list, b: list) -> int:
    """How many lines at the beginning are equal."""
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def chained(a: list, places: dict) -> list[int]:
    """The indices in ``a`` of one longest common subsequence with the lines at ``places``, which are listed from the last."""
    ends: list[int] = []
    chain: list[tuple] = []
    for i, x in enumerate(a):
        for j in places.get(x, ()):
            k = bisect_left(ends, j)
            link = (i, chain[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chain.append(link)
            else:
                ends[k], chain[k] = j, link
    out, node = [], chain[-1] if chain else None
    while node:
        out.append(node[0])
        node = node[1]
    return out


def prefix_fits(a: list, b: list) -> np.ndarray:
    """The length of the longest common subsequence of ``a`` with each prefix of ``b``, the empty one first: bit
    j of a whole number tells whether prefix j + 1 has no more than prefix j."""
    size = -(-len(b) // 8)
    at: dict = {}
    for j, x in enumerate(b):
        at.setdefault(x, []).append(j)

    def bits(x) -> int:
        marks = bytearray(size)
        for j in at[x]:
            marks[j >> 3] |= 1 << (j & 7)
        return int.from_bytes(marks, "little")

    often = {x: bits(x) for x, js in at.items() if len(js) > 64}  # the others' are made when they come, to hold few
    full = (1 << len(b)) - 1
    same = full
    for x in a:
        if x in at:
            met = same & (often.get(x) or bits(x))
            same = (same + met | same - met) & full
    flat = np.unpackbits(np.frombuffer(same.to_bytes(size, "little"), np.uint8), count=len(b), bitorder="little")
    return np.concatenate([[0], np.cumsum(flat == 0)])


def template(lines: list, others: list[list | None]) -> list[bool] | None:
    """Of each line, whether it is shared with one of the neighbours there are; None if none is."""
    shared: set[int] = set()
    for other in others:
        if other is not None:
            shared |= common_lines(lines, other)
    return [i in shared for i in range(len(lines))] if shared else None


def main_text(pages: list[list[tuple[str, int]]], k: int) -> str:
    """The text of page ``k`` among neighbours of its host in path order."""
    lines = [x for x, _ in pages[k]]
    others = []
    for side in (range(k - 1, -1, -1), range(k + 1, len(pages))):
        # the same page at another URL tells nothing
        others.append(next((o for j in side if (o := [x for x, _ in pages[j]]) != lines), None))
    shared = template(lines, others) or [False] * len(lines)
    best = max((f for _, f in pages[k]), default=OPEN)
    return "\n\n".join(x for (x, f), gone in zip(pages[k], shared) if f == best and (best > OPEN or not gone))


#: A page (kind 0; without ``shared``, if its run's is not known yet) or a run (kind 1): ``part`` is the range, ``run`` counts in it,
#: ``shared`` tells of each line whether it is template. Pages that are known to share nothing are not written, and
#: runs only if they stand at an edge (the first two and the last two of a range), or share lines and pages wait for that.
FOUND = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("run", pa.int64()), ("edge", pa.bool_()), ("key", pa.binary()),
                   ("shared", pa.list_(pa.bool_())), ("host", pa.string()), ("digest", pa.string()), ("lines", pa.binary())])


def split_lines(lines: bytes) -> list[bytes]:
    return [lines[i:i + DIGEST] for i in range(0, len(lines), DIGEST)]


class Run:
    """Adjacent pages of one host with equal lines, and those of them that wait for what they share."""

    def __init__(self, at: int, host: str, lines: bytes):
        self.at, self.host, self.lines, self.pages, self.sent = at, host, lines, [], False

    def same(self, host: str, lines: bytes) -> bool:
        return self.host == host and self.lines == lines


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (host, path). One run and the one before it are held."""
    part = TaskContext.get().partitionId()
    out: list[tuple] = []
    size = 0
    before: Run | None = None
    now: Run | None = None

    def put(*row) -> None:
        nonlocal size
        out.append(row)
        size += len(row[5] or ()) + len(row[8] or ())

    def written() -> pa.RecordBatch:
        nonlocal size
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), FOUND)], schema=FOUND)
        out.clear()
        size = 0
        return batch

    def put_run(r: Run, edge: bool, shared: list[bool] | None) -> None:
        put(1, part, r.at, edge, None, shared, hashlib.md5(r.host.encode("utf-8", "surrogatepass")).hexdigest(), hashlib.md5(r.lines).hexdigest(), r.lines if edge else None)

    def send(r: Run) -> None:
        """The pages that wait go out without what they share."""
        for key in r.pages:
            put(0, part, r.at, False, key, None, None, None, None)
        r.pages, r.sent = [], r.sent or bool(r.pages)

    def finish(r: Run, left: Run, right: Run) -> None:
        """A run inside the range: both runs beside it are known."""
        if r.pages or r.sent:
            shared = template(split_lines(r.lines), [split_lines(o.lines) if o.host == r.host else None for o in (left, right)])
            if shared:
                for key in r.pages:
                    put(0, part, r.at, False, key, shared, None, None, None)
            if r.sent and r.at == 1:
                second[0] = shared
            elif r.sent and shared:
                put_run(r, False, shared)
            r.pages = []

    second: list[list[bool] | None] = [None]  # what the run that has the number 1 shares, if pages wait for it
    for batch in batches:
        for host, key, lines in zip(*(batch.column(c).to_pylist() for c in ("host", "key", "lines"))):
            if now is None or not now.same(host, lines):
                new = Run(now.at + 1 if now else 0, host, lines)
                if before:
                    finish(now, before, new)
                    if now.at == 1:
                        put_run(now, True, second[0])
                elif now:
                    send(now)
                    put_run(now, True, None)
                before, now = now, new
            if lines:
                now.pages.append(key)
                if len(now.pages) >= HELD:
                    send(now)
            if len(out) >= HELD or size > 4 << 20:
                yield written()
    if now:
        send(now)
        put_run(now, True, None)
        if before and before.at > 1:
            put_run(before, True, None)
    if out:
        yield written()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pages' lines by ``DIGEST`` bytes each, end to end."""
    for batch in batches:
        lines = [b"".join(hashlib.md5(line.encode("utf-8", "surrogatepass")).digest() for line, _ in block_lines(x or "")) for x in batch.column("html").to_pylist()]
        kept = ["host", "path", "page_id", "h", "key"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(lines, pa.binary())], [*kept, "lines"])


def _flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pages' lines with their flags."""
    for batch in batches:
        pages = [block_lines(x or "") for x in batch.column("html").to_pylist()]
        kept = ["page_id", "url", "key"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array([[x for x, _ in p] for p in pages], pa.list_(pa.string())),
                                          pa.array([[f for _, f in p] for p in pages], pa.list_(pa.int32()))], [*kept, "lines", "flags"])


def edge_neighbours(edges: list[tuple[int, int, str, str]]) -> list[tuple]:
    """(part, run, part and run of the nearest other run of the host before it, and after it; None if there is none)
    of the first and last run of each range. ``edges``: (part, run, host, digest) of the first two and last two runs."""
    edges = sorted(edges)
    n = len(edges)
    beside: list[list[int | None]] = [[None] * n, [None] * n]
    for side, order, step in ((0, range(1, n), -1), (1, range(n - 2, -1, -1), 1)):
        for i in order:
            # equal runs on both sides of a cut are one
            beside[side][i] = beside[side][i + step] if edges[i][2:] == edges[i + step][2:] else i + step
    out = []
    for i, (part, run, host, _) in enumerate(edges):
        if 0 < i < n - 1 and edges[i - 1][0] == part == edges[i + 1][0]:
            continue
        found = [edges[j][:2] if j is not None and edges[j][2] == host else (None, None) for j in (beside[0][i], beside[1][i])]
        out.append((part, run, *found[0], *found[1]))
    return out


def shared_lines(d: DataFrame) -> DataFrame:
    """(key, shared): of each line of a page, whether it is template, for the keys of the rows of ``d``
    (host, path, page_id, h, key, html) that share any."""
    spark = d.sparkSession
    order = ["host", "path", "page_id", "h"]
    read = materialize(d.mapInArrow(_digests, "host string, path string, page_id bigint, h bigint, key binary, lines binary"), "page-lines")
    sorted_pages = read.repartitionByRange(*order).sortWithinPartitions(*order).select("host", "key", "lines")
    found = materialize(sorted_pages.mapInArrow(_difference, "kind int, part int, run bigint, edge boolean, key binary, shared array<boolean>,"
                                                             " host string, digest string, lines binary"), "page-runs")
    done = found.where("kind = 0 and shared is not null").select("key", "shared")
    waiting = found.where("kind = 0 and shared is null").select("part", "run", "key")
    runs = found.where("kind = 1")
    # four small rows of each range at most
    edges = edge_neighbours([tuple(r) for r in runs.where("edge").select("part", "run", "host", "digest").collect()])
    beside = spark.createDataFrame(edges, "part int, run bigint, part0 int, run0 bigint, part1 int, run1 bigint")

    @F.arrow_udf("array<boolean>")
    def aligned(own: pa.Array, left: pa.Array, right: pa.Array) -> pa.Array:
        rows = zip(own.to_pylist(), left.to_pylist(), right.to_pylist())
        return pa.array([template(split_lines(x), [None if o is None else split_lines(o) for o in beside]) for x, *beside in rows], pa.list_(pa.bool_()))

    at_edge = runs.where("edge").select("part", "run", "lines")
    side = [at_edge.select(F.col("part").alias(f"part{k}"), F.col("run").alias(f"run{k}"), F.col("lines").alias(f"lines{k}")) for k in (0, 1)]
    at_edge = at_edge.join(beside, ["part", "run"]).join(side[0], ["part0", "run0"], "left").join(side[1], ["part1", "run1"], "left")
    known = at_edge.select("part", "run", aligned("lines", "lines0", "lines1").alias("shared"))
    known = known.unionByName(runs.where("shared is not null").select("part", "run", "shared"))
    late = waiting.join(known, ["part", "run"]).select("key", "shared")
    # rows with one key are one page, in one run
    return materialize(done.unionByName(late).dropDuplicates(["key"]), "page-template")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_shared, n_restored) for each row of ``pages`` (page_id, url, html): the lines that differencing
    took for template, and those of them that the check by the page's marks put back."""
    bounded_batches(pages.sparkSession)
    url = F.coalesce("url", F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    d = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    d = d.select("*", host.alias("host"), F.regexp_replace(path, r"(?:/|\.html?)+$", "").alias("path"), F.xxhash64("html").alias("h"), F.unhex(row_key(d)).alias("key"))
    shared = shared_lines(d.select("host", "path", "page_id", "h", "key", "html"))
    # reading a page twice costs less than writing its text
    read = d.select("page_id", "url", "key", "html").mapInArrow(_flagged, "page_id bigint, url string, key binary, lines array<string>, flags array<int>")
    gone = lambda i: F.coalesce(F.get("shared", i), F.lit(False))
    marked = lambda i: (F.col("best") > OPEN) & (F.get("flags", i) == F.col("best"))
    n = lambda c: F.size(c).cast("long")
    return read.join(shared, "key", "left").withColumn("best", F.coalesce(F.array_max("flags"), F.lit(OPEN))).select(
        "page_id", "url", F.array_join(F.filter("lines", lambda _, i: marked(i) | (F.col("best") == OPEN) & ~gone(i)), "\n\n").alias("text"),
        n(F.filter("lines", lambda _, i: gone(i))).alias("n_shared"), n(F.filter("lines", lambda _, i: gone(i) & marked(i))).alias("n_restored"))
