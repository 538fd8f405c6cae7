"""Main text of web pages: markup to blocks, and lines shared with the page of the nearest address removed."""

from __future__ import annotations

import hashlib
import html as entities
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlewise.llm.common import frozen, map_arrow, ready, table

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|itemprop|aria-hidden|aria-label)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
SPACES = re.compile(r"\s+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "textarea", "title", "noframes", "math", "canvas", "object"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that never hold main text; a header or footer inside the article is one too unless it holds its heading.
CHROME = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "head", "fieldset", "option", "input", "label"}
CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu", "menubar"}
#: Words a class or id is made of if it names boilerplate; articles inside a list of this kind are its items.
CHROME_WORDS = set(
    "ad ads advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices notification alert popup modal overlay paywall newsletter subscribe subscription signup login menu menus nav navbar "
    "navigation breadcrumb breadcrumbs sidebar side aside widget widgets footer foot header masthead topbar share sharing social "
    "pagination pager toolbar skip hidden".split()
)
LIST_WORDS = set("comment comments commentlist disqus respond replies reply related recommended recommendations trending".split())
#: Words beside them that do not change what is named; with any other word (has-, no-, -wrap, -open, -effects) it is not boilerplate.
PLAIN_WORDS = set(
    "a the site page main top bottom left right primary secondary global mobile sticky fixed google box bar list item items link links block "
    "section area container inner form button buttons btn icon icons text title unit slot region group post posts entry article articles "
    "stories policy message".split()
)
#: What follows the name of such a list where it names the list itself, whatever comes after.
LIST_PARTS = {"area", "list", "thread", "section", "feed", "container", "block"}
#: First and last words of a token that say something of the page, not what the element is.
STATE_FIRST = set("has have no not with without is allow allows enable show hide category tag type format status".split())
STATE_LAST = set("open closed wrap enabled disabled off on allowed count number effects".split())
#: Classes of an element that holds the columns of a page, its own side column beside the text.
LAYOUTS = {"layout", "wrap", "wrapper"}
MAIN = {"article", "main"}
MAIN_ROLES = {"main", "article"}


def names_list(parts: list[str]) -> bool:
    if not parts or parts[0] in STATE_FIRST or parts[-1] in STATE_LAST:
        return False
    return parts[-1] in LIST_WORDS or (parts[0] in LIST_WORDS and len(parts) > 1 and parts[1] in LIST_PARTS)


def chrome_of(value: str, inside: bool) -> int:
    """What a class or id says: 0 no boilerplate, 1 boilerplate, 2 a list whose articles are its items.

    A token counts as a whole: each of its parts must be a word for boilerplate or a plain one. Only lists (of comments,
    say) are named by the last word, whatever stands before it, or by the first and a word for a list. `inside` an
    article, and in names of its parts, a header holds the heading.
    """
    tokens = CAMEL.sub("-", value).lower().split()
    if LAYOUTS & set(tokens):
        return 0
    found = 0
    for token in tokens:
        named = [x for x in re.split(r"[_-]+", token) if x and not re.fullmatch(r"\d+(x\d+)?", x)]
        if names_list(named):
            found = 2
            continue
        parts = set(named)
        said = parts & (CHROME_WORDS | LIST_WORDS)
        if parts - said - PLAIN_WORDS:
            continue
        if inside or parts & {"post", "entry", "article"}:
            said = said - {"header"}
        if said:
            found = max(found, 2 if said & LIST_WORDS else 1)
    return found


def blocks(page: str) -> list[tuple[str, bool, bool]]:
    """Text blocks of a page in order: (text, inside boilerplate markup, inside the article).

    Unclosed elements are closed by the end of an outer one, paragraphs by the next block.
    """
    out: list[tuple[str, bool, bool]] = []
    # element, boilerplate (1: by a class or id, which an article inside resets), article: both inherited
    stack: list[tuple[str, int, bool]] = []
    buffer: list[str] = []
    chrome, main = 0, False
    at, n = 0, len(page)

    def flush():
        if buffer:
            text = SPACES.sub(" ", entities.unescape("".join(buffer))).strip()
            buffer.clear()
            if text:
                out.append((text, chrome > 0, main))

    while at < n:
        m = TAG.search(page, at)
        if m is None:
            buffer.append(page[at:])
            break
        if m.start() > at:
            buffer.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:  # closing
            if name in BLOCK:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if any(x[0] in BLOCK for x in stack[k:]):
                        flush()
                    del stack[k:]
                    chrome, main = stack[-1][1:] if stack else (0, False)
                    break
                if stack[k][0] in MAIN | {"body", "html", "table"} and name not in MAIN | {"body", "html", "table"} and name not in BLOCK:
                    break  # a stray inline end does not close the article
            continue
        if name in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name in ("br", "wbr", "img", "hr"):
            if name == "hr":
                flush()
            elif name == "br":
                buffer.append(" ")
            continue
        if name in VOID:
            continue
        if name in BLOCK:
            flush()
            if name == "p" or name in HEADINGS or name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                # an open paragraph ends here, an open item of the same kind too
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p" or stack[k][0] == name:
                        del stack[k:]
                        chrome, main = stack[-1][1:] if stack else (0, False)
                        break
                    if stack[k][0] in BLOCK:
                        break
            elif stack and any(x[0] == "p" for x in stack):
                k = max(i for i, x in enumerate(stack) if x[0] == "p")
                if not any(x[0] in BLOCK for x in stack[k + 1 :]):
                    del stack[k:]
                    chrome, main = stack[-1][1:] if stack else (0, False)
        if m[3].endswith("/") and name not in BLOCK:
            continue
        own_main, marked = main or name in MAIN, name in MAIN
        own_chrome = 2 if name in CHROME or (name == "header" and not main) else 0
        said = 0
        if m[3]:
            for a in ATTRIBUTE.finditer(m[3]):
                key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                if key == "role":
                    marked = marked or value.lower() in MAIN_ROLES
                    own_chrome = 2 if value.lower() in CHROME_ROLES else own_chrome
                elif key in ("class", "id"):
                    if name not in ("body", "html"):
                        said = max(said, chrome_of(value, main))
                elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
                    own_chrome = 2
                elif key == "itemprop":
                    marked = marked or value.lower() == "articlebody"
                    own_chrome = 2 if value.lower() in ("comment", "comments") else own_chrome
        own_main = own_main or marked
        if name in MAIN:
            # its own class marks no article, but one that says what its container says is no main text there
            own_chrome = max(own_chrome, 0 if chrome == 1 and not said else chrome)
        else:
            own_chrome = max(own_chrome, said, 0 if chrome == 1 and marked and not said else chrome)
        stack.append((name, own_chrome, own_main))
        chrome, main = own_chrome, own_main
    flush()
    return out


def line_key(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def shared_lines(a: list[int], b: list[int]) -> set[int]:
    """Positions of `a` on a longest common subsequence with `b` (Hunt and Szymanski: an increasing run of matches)."""
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    ha, hb = len(a), len(b)
    while ha > lo and hb > lo and a[ha - 1] == b[hb - 1]:
        ha, hb = ha - 1, hb - 1
    found = {*range(lo), *range(ha, len(a))}
    where: dict[int, list[int]] = {}
    for j in range(hb - 1, lo - 1, -1):
        where.setdefault(b[j], []).append(j)  # falling, so that a position of `a` is used once
    ends: list[int] = []
    chains: list[tuple[int, object]] = []  # last match of the best run of each length, linked backwards
    for i in range(lo, ha):
        for j in where.get(a[i], ()):
            k = bisect_left(ends, j)
            link = (i, chains[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chains.append(link)
            else:
                ends[k], chains[k] = j, link
    link = chains[-1] if chains else None
    while link is not None:
        found.add(link[0])
        link = link[1]
    return found


def main_text(found: list[tuple[str, bool, bool]], shared: set[int]) -> str:
    """Lines outside boilerplate markup that stand in a marked article or that no neighbour shares."""
    return "\n".join(t for k, (t, chrome, main) in enumerate(found) if not chrome and (main or k not in shared))


def _neighbours(pages: DataFrame, id_: str, url: str, html: str) -> DataFrame:
    """(row_key, shared): positions of lines each distinct page shares with the nearest page of another address of its host.

    Pages are sorted by host and address (path and query), where the address with the longest common beginning is next to
    a page, before or after it; pages of the same address are passed over, however many. Only hashes of lines travel; the
    sort deals out ranges, so a host may span many tasks, and of each task the outermost pages of two addresses at either
    end are handed to the others. One scan carries the page before, one over the same rows in reverse the page after.
    """

    def make():
        def step(texts):
            return ([[line_key(t) for t, _, _ in blocks(x or "")] for x in texts.to_pylist()],)

        return step

    key = row_key(pages, id_, url, html)
    address = F.regexp_replace(F.coalesce(pages[url], F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(address, r"^([^/?#]*)", 1))
    path = F.regexp_extract(address, r"^[^/?#]*([^#]*)", 1)
    lines = map_arrow(pages.select(key.alias("k"), host.alias("host"), path.alias("path"), pages[html].alias("h")), {"h": F.col("h")}, "lines array<bigint>", make, keep=["k", "host", "path"])
    narrow = lines.select("row.*", "lines").dropDuplicates(["k"])
    ranged = narrow.repartitionByRange("host", "path", "k").sortWithinPartitions("host", "path", "k")
    fixed = frozen(ranged.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()))
    spot = F.struct("place", "host", "path")
    edge = fixed.groupBy("part").agg(F.min(spot).alias("lo"), F.max(spot).alias("hi"))
    # where the first address of a task ends and its last one begins
    other = lambda end: (F.col("host") != F.col(f"{end}.host")) | (F.col("path") != F.col(f"{end}.path"))
    inner = fixed.select("part", "place", "host", "path").join(F.broadcast(edge), "part").groupBy("part").agg(
        F.min("lo.place").alias("a"), F.min(F.when(other("lo"), F.col("place"))).alias("b"),
        F.max(F.when(other("hi"), F.col("place"))).alias("c"), F.max("hi.place").alias("d"),
    )
    # at most four pages of each task: as many rows as partitions
    ends = fixed.join(F.broadcast(inner), "part").where("place in (a, b, c, d)").select("place", "part", "host", "path", "lines").orderBy("place")
    tips = [(r["part"], r["host"], r["path"], r["lines"]) for r in ends.collect()]

    def nearest(row, other, best):
        """(common beginning, shared positions) of the better partner."""
        _, host, path, lines = row
        if other is None or other[1] != host:
            return best
        common = 0
        for x, y in zip(path, other[2]):
            if x != y:
                break
            common += 1
        hit = sorted(shared_lines(lines, other[3]))
        return (common, hit) if common > best[0] or common == best[0] and len(hit) > len(best[1]) else best

    def scan(back):
        def run(batches):
            held = last = None  # the page of the address passed last, and the row passed last
            for batch in batches:
                names = ("k", "host", "path", "lines", "part", "place", "best", "shared")
                out: list[list] = [[], []]
                for k, host, path, lines, part, _, best, drop in zip(*[batch.column(c).to_pylist() for c in names]):
                    row = (k, host, path, lines)
                    if last is None:
                        beyond = [t for t in (tips if back else reversed(tips)) if (t[0] > part if back else t[0] < part)]
                        held = next((t for t in beyond if t[1:3] != row[1:3]), None)
                    elif last[1:3] != row[1:3]:
                        held = last
                    last = row
                    found = nearest(row, held, (best, drop))
                    for c, v in zip(out, found):
                        c.append(v)
                made = [pa.array(out[0], pa.int32()), pa.array(out[1], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names[:6]], *made], names=list(names))

        return run

    schema = "k binary, host string, path string, lines array<bigint>, part int, place bigint, best int, shared array<int>"
    start = fixed.select("k", "host", "path", "lines", "part", "place", F.lit(-1).alias("best"), F.expr("cast(array() as array<int>)").alias("shared"))
    ahead = start.mapInArrow(scan(False), schema).sortWithinPartitions(F.desc("place"))
    return ahead.mapInArrow(scan(True), schema).select("k", "shared")


def row_key(pages: DataFrame, id_: str, url: str, html: str):
    """128-bit key of a page row; equal rows are one page."""
    said = [F.coalesce(pages[c].cast("string"), F.lit("\x00")) for c in (id_, url, html)]
    return F.unhex(F.md5(F.concat_ws("\x01", *said)))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Main text of each page.

    Each page is cut into text blocks. Pages of a host are paired by nearest URL path and query, their lines aligned by longest
    common subsequence, and shared lines deleted. Two rules go before that verdict, because alignment alone is wrong
    there: lines of a marked article stay although a copy of the article stands under a neighbouring address, and lines
    in menus, adverts, forms and the like go although they differ from page to page.

    Result: page_id, url, text. Null or empty html, or a page of boilerplate only: empty text. Null url: host and path
    are empty. Repeated rows are one page for the pairing and each gets its text. A page alone on its host shares nothing.
    An empty table gives an empty result.
    """
    given = pages.select(pages[page_id].alias("page_id"), pages[url].alias("url"), pages[html].alias("html"))
    shared = _neighbours(given, "page_id", "url", "html")
    joined = given.withColumn("k", row_key(given, "page_id", "url", "html")).join(shared, "k", "left")

    def make():
        def step(texts, drops):
            return ([main_text(blocks(h or ""), set(d or ())) for h, d in zip(texts.to_pylist(), drops.to_pylist())],)

        return step

    done = map_arrow(joined, {"h": joined["html"], "s": joined["shared"]}, "text string", make, keep=["page_id", "url"])
    return done.select("row.page_id", "row.url", "text")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    done = extract(table(spark, sf_dir, "pages"))
    return done.withColumn("n_chars", F.char_length("text").cast("bigint"))
