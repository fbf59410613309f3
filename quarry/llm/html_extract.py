"""Main text of web pages by nearest-URL page differencing, with page structure as its guard.

A page is cut into blocks (text lines) with the role of the element they stand in:
``main`` (inside article or main), ``chrome`` (inside navigation, headers,
footers, asides, forms, comment sections and elements whose class or id
says so; inside the main element only where a whole name of a fixed list does, or a role) or ``open`` (anything else).  Every page is compared with the page that has the nearest URL
path on the same host: both lists of lines are aligned by longest common
subsequence and the shared lines, which belong to the site rather than to the page,
are deleted.

Structure guards the result on both sides, as differencing alone would keep boilerplate that is drawn anew for
each page and delete articles that are copied between pages (README has the figures): lines of the
main element are never deleted, and chrome goes even where no neighbour shares it.  On a page with a
main element, what stands outside of it goes too; on a page without one, the open lines
that differencing leaves are the text.

Nearest pages: pages of one host and directory, in order of (path, hash of the lines), are
neighbours; the nearest is the one of the two neighbours that shares the longer path
prefix, the one before on ties; pages with the same lines count as one.  Pages alone in their directory meet all such pages of
their host.  Pages are numbered in that order over the whole table, dealt by ranges, and meet the numbers
before and after theirs by joins, so that a hot host or directory never is one task and neighbours are
the true ones at every size.
Pages are parsed twice: once for the hashes of their lines, which find the neighbours, and once for the
lines, which are exchanged once, to meet the neighbour's hashes.

Defined results: null html is an empty page; a page without text gives an empty string;
null urls have an empty host and path; repeated rows are pages each; a page that is
alone on its host shares nothing.  Among broken pages: a quote that is never closed ends with its word; a ``main``
element ends whatever chrome is open before it; an article inside chrome is the
main text only if the page has no other; an article that its class calls a comment or advert is chrome.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import text as tx
from quarry.llm.common import join_grouped, written
from quarry.operators.lineage import numbered

#: Elements of HTML by what they do to the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul title".split()
)
HIDDEN = frozenset("script style template noscript iframe object svg canvas head title select textarea button datalist audio video".split())
RAW = frozenset("script style textarea title iframe noscript".split())
CHROME = frozenset("nav footer aside form menu dialog".split())
MAIN = frozenset(("article", "main"))
#: Elements that end an open paragraph.
CLOSES_P = BLOCK - frozenset("body html td th tr tbody thead tfoot option".split())
#: Words of class, id and role values that mark what is not the article.
CHROME_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar banner footer sidebar aside rail widget ad ads adv advert adverts advertisement "
    "advertising sponsor sponsored promo promotion notice notices alert cookie cookies consent gdpr popup modal overlay comment comments disqus respond replies reply "
    "share sharing social related recommended newsletter subscribe signup login search form pagination pager toolbar skip contentinfo complementary".split()
)
MAIN_WORDS = frozenset(("main", "article"))
#: Whole class names and ids that drop an element inside the main one, where an article's own names (share-price, form-factor, related-work) share words with those of chrome.
INSIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising ad-slot ad-unit ad-banner ad-box ad-container adsbygoogle sponsor sponsored promo promotion navbar nav navigation menu menubar breadcrumb breadcrumbs "
    "sidebar widget masthead footer site-footer page-footer site-header notice notices cookie-notice cookie-banner cookie-consent cookies gdpr popup modal overlay comment comments comment-list comment-form "
    "comments-area comments-section comment-section disqus disqus_thread respond replies share sharing share-bar share-box share-buttons share-links social social-share social-links social-buttons social-icons "
    "related related-posts related-articles related-links related-content related-stories recommended recommended-posts recommendations newsletter newsletter-signup newsletter-form subscribe subscribe-form signup "
    "signup-form login-form search-form search-box pagination pager toolbar skip-link".split()
)
#: Roles of elements that drop them anywhere.
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar".split())
#: Names of an article element that is no main text: a comment or an advert.
ASIDE = re.compile(r"(?:comment|reply)(?:s|[-_]?\d+|[-_](?:body|item|list|entry))?|replies|respond|disqus|ad|ads|adv|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?")

#: Comments, CDATA, declarations, or a tag with its attributes; a quote counts only as the first character of a value, and only if it is closed.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=\s*[^\s>]+|=)*+)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_SPACE = re.compile(r"\s+")


def _attribute_words(attributes: str) -> set[str]:
    found: set[str] = set()
    for _, value in _ATTRIBUTE.findall(attributes):
        value = htmllib.unescape(value.strip("\"'"))
        value = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower()
        found.update(_SPLIT.split(value))
    return found


def _names(attributes: str) -> tuple[set[str], set[str]]:
    """Whole class names and ids, and roles, in lower case."""
    names: set[str] = set()
    roles: set[str] = set()
    for kind, value in _ATTRIBUTE.findall(attributes):
        (roles if kind.lower() == "role" else names).update(htmllib.unescape(value.strip("\"'")).lower().split())
    return names, roles


def _outcome(here: str, mine: str) -> str:
    """Role of a place, from that of its surroundings and of its own element."""
    if "hidden" in (here, mine):
        return "hidden"
    if mine == "reset":
        return "main"
    if mine == "chrome" or (here == "chrome" and not mine):
        return "chrome"
    if mine == "main":
        return "main" if here in ("open", "main") else "boxed"
    return here


def blocks(page: str | None) -> list[tuple[str, str]]:
    """(role, text) of each block, in page order; blocks without text are left out."""
    if not page:
        return []
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str, str]] = []  # element, its own role, role of what stands in it
    open_names: Counter = Counter()
    parts: list[str] = []
    now = here = "open"  # role of the block so far, and of the place

    def flush() -> None:
        if parts:
            if now != "hidden":
                text = _SPACE.sub(" ", htmllib.unescape("".join(parts))).strip()
                if text:
                    out.append((now, text))
            parts.clear()

    def add(text: str) -> None:
        # an inline advert or button inside a block leaves the block's text whole
        nonlocal now
        if parts and here != now:
            if here in ("chrome", "hidden"):
                return
            if now in ("chrome", "hidden"):
                parts.clear()
        if not parts:
            now = here
        parts.append(text)

    def cut_to(depth: int) -> None:
        for name, _, _ in stack[depth:]:
            open_names[name] -= 1
        del stack[depth:]

    def drop_one(depth: int) -> None:
        # roles above are worked out again only if this element had one
        name, mine, _ = stack.pop(depth)
        open_names[name] -= 1
        if mine:
            for i in range(depth, len(stack)):
                stack[i] = (*stack[i][:2], _outcome(stack[i - 1][2] if i else "open", stack[i][1]))

    def highest(names: tuple[str, ...], until) -> int | None:
        """Place of the innermost open element of these names, unless one for which ``until`` holds stands above it."""
        if not any(open_names[n] for n in names):
            return None
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                return i
            if until(stack[i][0]):
                return None
        return None

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            if page.startswith("<![CDATA[", m.start()):
                add(page[m.start() + 9 : m.end() - 3])
            continue
        name = name.lower()
        if name == "br":
            add(" ")
            continue
        if m[1]:  # an end tag
            depth = highest((name,), lambda _: False)
            if depth is None:
                if name in BLOCK:
                    flush()
                continue
            # inline ends never close blocks
            above_blocks = any(e in BLOCK for e, _, _ in stack[depth + 1 :])
            if name not in BLOCK and above_blocks:
                drop_one(depth)
            else:
                if name in BLOCK or above_blocks:
                    flush()
                cut_to(depth)
            here = stack[-1][2] if stack else "open"
            continue
        if name in BLOCK:
            if name in CLOSES_P and (depth := highest(("p",), BLOCK.__contains__)) is not None:
                flush()
                drop_one(depth)
            if name in ("li", "dd", "dt", "option", "tr", "td", "th"):
                ends = ("ul", "ol", "dl", "table", "select", "menu", *(("tr",) if name in ("td", "th") else ()))
                if (depth := highest((name,), ends.__contains__)) is not None:
                    flush()
                    cut_to(depth)
            flush()
        if name == "body":
            flush()
            while (depth := highest(("head",), lambda _: False)) is not None:
                drop_one(depth)
        here = stack[-1][2] if stack else "open"
        words = _attribute_words(m[3]) if "=" in m[3] else set()
        names, roles = _names(m[3]) if words else (set(), set())
        if name == "article":
            marked = any(map(ASIDE.fullmatch, names)) or roles & ROLES
        elif here == "main":
            marked = names & INSIDE or roles & ROLES
        else:
            marked = name not in ("body", "html") and words & CHROME_WORDS
        mine = ""
        if name in HIDDEN:
            mine = "hidden"
        elif name == "main":
            mine = "reset"
        elif name in CHROME or marked:
            mine = "chrome"
        elif name == "header" and here != "main":
            mine = "chrome"
        elif name == "article" or (words & MAIN_WORDS and name not in ("body", "html")):
            mine = "main"
        if name in VOID:
            continue
        stack.append((name, mine, _outcome(here, mine)))
        open_names[name] += 1
        here = stack[-1][2]
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else size
            cut_to(len(stack) - 1)
            here = stack[-1][2] if stack else "open"
    flush()
    boxed = "chrome" if any(r == "main" for r, _ in out) else "main"
    return [(boxed if r == "boxed" else r, t) for r, t in out]


def split_url(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it has no ://."""
    u = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.substring(u, F.instr(u, "://") + 3, F.char_length(u))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def common_lines(mine: list[int], other: list[int]) -> list[bool]:
    """Which of my lines belong to one longest common subsequence with the other list."""
    shared = [False] * len(mine)
    a, b = 0, len(mine)
    c, d = 0, len(other)
    while a < b and c < d and mine[a] == other[c]:
        shared[a] = True
        a, c = a + 1, c + 1
    while a < b and c < d and mine[b - 1] == other[d - 1]:
        shared[b - 1] = True
        b, d = b - 1, d - 1
    # lines that the other list lacks cannot be shared
    have = set(other[c:d])
    rows = [i for i in range(a, b) if mine[i] in have]
    want = {mine[i] for i in rows}
    cols = [x for x in other[c:d] if x in want]
    for i in _aligned(np.array([mine[i] for i in rows], np.int64), np.array(cols, np.int64)):
        shared[rows[i]] = True
    return shared


#: Cells of the table that aligns two lists; longer lists are halved first.
CELLS = 1 << 24


def _lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of x with each beginning of y."""
    row = np.zeros(len(y) + 1, np.int32)
    for v in x.tolist():
        row[1:] = np.maximum.accumulate(np.where(y == v, row[:-1] + 1, row[1:]))
    return row


def _aligned(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Places in x of one longest common subsequence with y, in memory of CELLS numbers at most and a few rows."""
    if not len(x) or not len(y):
        return []
    if len(x) > 1 and len(x) * len(y) > CELLS:
        half = len(x) // 2
        cut = int((_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]).argmax())
        return _aligned(x[:half], y[:cut]) + [half + i for i in _aligned(x[half:], y[cut:])]
    table = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    for i in range(len(x) - 1, -1, -1):
        hit = np.where(y == x[i], table[i + 1, 1:] + 1, table[i + 1, :-1])
        # best of skipping other lines: running maximum from the right
        table[i, :-1] = np.maximum.accumulate(hit[::-1])[::-1]
    out, i, j = [], 0, 0
    while i < len(x) and j < len(y):
        if x[i] == y[j] and table[i, j] == table[i + 1, j + 1] + 1:
            out.append(i)
            i, j = i + 1, j + 1
        elif table[i + 1, j] >= table[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


#: Roles as they travel: what differencing may not delete, what it decides, what goes in any case.
GUARDED, DECIDED, DROPPED = 0, 1, 2


def _guards(roles: list[str]) -> list[int]:
    has_main = "main" in roles
    return [GUARDED if r == "main" else DROPPED if r == "chrome" or has_main else DECIDED for r in roles]


def _hash(line: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(line) - (1 << 63)


def _line_hashes(batches):
    for batch in tx.chunks(batches, "html"):
        hashes = [[_hash(t) for _, t in blocks(page)] for page in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _PLACE), pa.array(hashes, pa.list_(pa.int64()))], [*_PLACE, "hashes"])


def _lines(structure: bool):
    """Hashes and guards of all lines, the guarded text as one string, and the lines that differencing decides; others need not travel."""

    def run(batches):
        for batch in tx.chunks(batches, "html"):
            found = [blocks(page) for page in batch.column("html").to_pylist()]
            guards = [_guards([r for r, _ in f]) if structure else [DECIDED] * len(f) for f in found]
            main = ["\n\n".join(t for (_, t), g in zip(f, gs, strict=True) if g == GUARDED) for f, gs in zip(found, guards, strict=True)]
            lines = [[t for (_, t), g in zip(f, gs, strict=True) if g == DECIDED] for f, gs in zip(found, guards, strict=True)]
            hashes = [[_hash(t) for _, t in f] for f in found]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("page_id", "url", "dir_key")), pa.array(hashes, pa.list_(pa.int64())), pa.array(guards, pa.list_(pa.int8())), pa.array(main, pa.string()), pa.array(lines, pa.list_(pa.string()))],
                ["page_id", "url", "dir_key", "hashes", "guards", "main", "lines"],
            )

    return run


def _subtract(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            text, counts, gone = [], [], []
            for hashes, guards, mate, main, lines in zip(*(part.column(c).to_pylist() for c in ("hashes", "guards", "mate", "main", "lines")), strict=True):
                shared = common_lines(hashes, mate or [])
                decided = [s for s, g in zip(shared, guards, strict=True) if g == DECIDED]
                # a page has guarded lines or decided ones, never both
                text.append(main or "\n\n".join(x for x, s in zip(lines, decided, strict=True) if not s))
                counts.append(len(hashes))
                gone.append(sum(s and g != GUARDED for s, g in zip(shared, guards, strict=True)))
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(text, pa.string()), pa.array(counts, pa.int32()), pa.array(gone, pa.int32())], ["page_id", "url", "text", "n_lines", "n_shared"]
            )


def _prefix(a: F.Column, b: F.Column) -> F.Column:
    """Length of the common prefix of two paths, in whole segments."""
    x, y = F.split(a, "/", -1), F.split(b, "/", -1)
    same = F.zip_with(x, y, lambda p, q: p.eqNullSafe(q))
    return F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda acc, s: F.when(acc["go"] & s, F.struct((acc["n"] + 1).alias("n"), F.lit(True).alias("go"))).otherwise(F.struct(acc["n"].alias("n"), F.lit(False).alias("go"))), lambda acc: acc["n"])


#: Where a page stands: hashes of its host and of its host and directory, and its path.
_PLACE = ("host_key", "dir_key", "path")


def _neighbours(light: DataFrame) -> DataFrame:
    """(dir_key, line_key, mate): for each directory and list of lines, the line hashes of the nearest page; pages without one are left out."""
    # pages with the same lines are one node: a copy is no neighbour to compare with
    light = light.withColumn("line_key", F.xxhash64("hashes"))
    nodes = written(light.groupBy("host_key", "dir_key", "line_key").agg(F.min("path").alias("path"), F.any_value("hashes").alias("hashes"), F.count(F.lit(1)).alias("pages")), "nodes")
    # pages alone in their directory make up a group of their host
    alone = nodes.groupBy("dir_key").agg(F.sum("pages").alias("pages")).where("pages = 1").select(F.col("dir_key").alias("a_key"))
    nodes = nodes.drop("pages").join(alone, F.col("dir_key") == F.col("a_key"), "left").withColumn("place", F.when(F.col("a_key").isNull(), F.col("dir_key")).otherwise(F.xxhash64("host_key", F.lit("alone"))))
    single = nodes.where("a_key is not null").groupBy("place", "line_key").agg(F.min("path").alias("path"), F.any_value("hashes").alias("hashes"))
    placed = numbered(nodes.where("a_key is null").select("place", "line_key", "path", "hashes").unionByName(single), ["place", "path", "line_key"])
    beside = lambda step, name: placed.select("place", (F.col("pos") + step).alias("pos"), F.col("path").alias(name))
    near = placed.drop("hashes").join(beside(1, "before"), ["place", "pos"], "left").join(beside(-1, "after"), ["place", "pos"], "left")
    chosen = F.when(
        F.col("after").isNotNull() & (F.col("before").isNull() | (_prefix(F.col("path"), F.col("after")) > _prefix(F.col("path"), F.col("before")))), F.col("pos") + 1
    ).otherwise(F.when(F.col("before").isNotNull(), F.col("pos") - 1))
    near = near.select("place", "line_key", chosen.alias("chosen")).where("chosen is not null")
    near = join_grouped(nodes.select("dir_key", "line_key", "place"), near, ["place", "line_key"]).select("dir_key", "line_key", "chosen")
    return near.join(placed.select(F.col("pos").alias("chosen"), F.col("hashes").alias("mate")), "chosen").drop("chosen")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", structure: bool = True) -> DataFrame:
    """page_id, url, text, n_lines, n_shared: the main text of each page, its lines, and those of them that differencing deletes.

    Without ``structure`` differencing alone decides on every line.
    """
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    host, path = split_url(F.col("url"))
    base = base.select("page_id", "url", host.alias("host"), path.alias("path"), "html")
    base = base.select("page_id", "url", F.xxhash64("host").alias("host_key"), F.xxhash64("host", F.regexp_replace("path", r"[^/]*/?$", "")).alias("dir_key"), "path", "html")
    id_type = base.schema["page_id"].dataType.simpleString()
    light = base.select(*_PLACE, "html").mapInArrow(_line_hashes, "host_key long, dir_key long, path string, hashes array<bigint>")
    near = _neighbours(light).withColumnsRenamed({"dir_key": "r_dir", "line_key": "r_line"})
    lines = base.select("page_id", "url", "dir_key", "html").mapInArrow(
        _lines(structure), f"page_id {id_type}, url string, dir_key long, hashes array<bigint>, guards array<tinyint>, main string, lines array<string>"
    ).withColumn("line_key", F.xxhash64("hashes"))
    both = lines.join(near, (F.col("dir_key") == F.col("r_dir")) & (F.col("line_key") == F.col("r_line")), "left")
    return both.select("page_id", "url", "hashes", "guards", "mate", "main", "lines").mapInArrow(_subtract, f"page_id {id_type}, url string, text string, n_lines int, n_shared int")


def op9_html_extract(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_lines", "n_shared")
