"""Main text of web pages: page structure first, then a suffix array by host.

A page is read as blocks with the elements that enclose them. Elements that
never hold main text (menus, headers, footers, asides, forms, scripts, styles,
adverts, notices and reader comments, by tag, role or class) are left out. On a
page that marks its article, the blocks inside it are the main text, all of
them, even where other pages repeat them: a quoted passage is still content.

Where a page marks no article, the host's pages decide. The token streams of
the undecided pages of a host are joined, a suffix array over them finds every
stretch of ``LONG`` tokens or more that also occurs on another page; these
stretches are boilerplate and go, and the unique runs between them stay. A block
of fewer tokens goes if another page has the very same one. A host of any size
is cut into groups of bounded tokens by a hash of the pages' blocks. What recurs
across groups is found by hashes of all windows of ``LONG`` tokens and of the
short blocks, so that results do not depend on the groups.

Defined results: a null, empty or markup-free page gives the text left after
the same steps (empty if none); broken markup never fails: unclosed elements end
with their parent; pages of the same blocks are one row each but count as one
page, not as two that share boilerplate; a page all of whose tokens other pages
have keeps its blocks; a null URL is a host of its own; very
long pages are read whole.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import mix64, written

LONG, GROUP_PAGES, GROUP_TOKENS = 8, 2000, 2_000_000
_SALT = np.uint64(0x9E3779B97F4A7C15)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*>|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>|<[a-zA-Z/!?][^>]*\Z|(?P<text>[^<]+|<)", re.S)
_ATTR = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Elements whose content is no markup; each ends at its own end tag only.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
NEVER = {"nav", "footer", "aside", "form", "button", "select", "option", "dialog", "menu", "head", "template", "svg", "canvas", "object", "video", "audio", "map", "search"} | RAW
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
_BAD_NAMES = re.compile(r"^(?:ads?|advert\w*|banners?|sponsor\w*|promo\w*|nav|navbar|navigation|menus?|sidebar\w*|side|breadcrumbs?|cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscribe|signup|social|share|sharing|related|recommended|comments?|commentlist|respond|replies|disqus\w*|footer|masthead|header|site-header|page-header|skip-link|pagination|pager|widgets?|toolbar)$", re.I)
_BAD_PREFIX = re.compile(r"^(?:ads?|advert|nav|navbar|menu|sidebar|cookie|consent|gdpr|newsletter|social|share|related|comments?|comment-list|footer|breadcrumbs?|promo|sponsor|popup|modal)[-_]|[-_](?:ads?|advert|nav|navbar|menu|sidebar|cookies?|consent|newsletter|comments|footer|breadcrumbs?|promo|popup|modal|banner)$", re.I)
#: An end tag closes these only up to the nearest such ancestor.
_SCOPE = {"html", "body", "article", "main", "section", "div", "table", "td", "th", "ul", "ol", "dl", "aside", "nav", "header", "footer", "form"}
_IMPLIED = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)} if raw else {}


def _excluded(tag: str, attrs: dict[str, str], inside_article: bool) -> bool:
    """Whether an element is furniture. An article's own header holds its title and stays."""
    if tag in NEVER or attrs.get("role", "").lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return True
    if tag == "header":
        return not inside_article
    if re.search(r"display\s*:\s*none", attrs.get("style", ""), re.I):
        return True
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}".split()
    if tag in ("html", "body", "article", "main"):
        return tag == "article" and any(re.match(r"comment\b|comment[-_]", n, re.I) for n in names)
    return any(_BAD_NAMES.match(n) or _BAD_PREFIX.search(n) for n in names)


def blocks(page: str | None) -> tuple[list[str], bool]:
    """Text blocks outside of furniture, and whether they are those of a marked article."""
    if not page:
        return [], False
    stack: list[tuple[str, bool, int]] = []  # tag, excluded, 2 in an article, 1 in the main part, else 0
    all_blocks: list[tuple[str, int]] = []
    current: list[str] = []

    def flush():
        text = " ".join("".join(current).split())
        current.clear()
        if text:
            all_blocks.append((text, stack[-1][2] if stack else 0))

    def closed(down_to):
        while len(stack) > down_to:
            if stack[-1][0] in BLOCK:
                flush()
            stack.pop()

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.match(page, at)
        if m is None:  # an unclosed tag at the end of the page
            break
        at = m.end()
        tag = m["tag"]
        if tag is None:
            text = m["text"] if m["text"] is not None else m["cdata"]
            if text and not (stack and stack[-1][1]):
                current.append(entities.unescape(text))
            continue
        tag = tag.lower()
        if m["close"]:
            if tag == "p" and not any(t == "p" for t, _, _ in stack):
                flush()
                continue
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if tag in BLOCK:
                        flush()
                    closed(i)
                    break
                if stack[i][0] in _SCOPE and tag not in _SCOPE:
                    break
            continue
        if tag == "br":
            current.append(" ")
            continue
        if tag in BLOCK:
            flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in _IMPLIED.get(tag, {"p"}):
                    closed(i)
                    break
                if stack[i][0] in _SCOPE:
                    break
        if tag in VOID:
            continue
        excluded, article = stack[-1][1:] if stack else (False, 0)
        attrs = _attributes(m["attrs"])
        excluded = excluded or _excluded(tag, attrs, bool(article))
        role = attrs.get("role", "").lower()
        own = 2 if tag == "article" or role == "article" or attrs.get("itemprop", "") == "articleBody" else int(tag == "main" or role == "main")
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if m["attrs"].endswith("/") and tag not in BLOCK:
            continue
        stack.append((tag, excluded, 0 if excluded else max(article, own)))
    closed(0)
    flush()
    most = max((level for _, level in all_blocks), default=0)
    return [t for t, level in all_blocks if level == most], most > 0


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Start positions in the order of their suffixes, by doubling of ranks."""
    n = len(codes)
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    width, order = 1, np.argsort(rank, kind="stable")
    while n:
        after = np.full(n, -1, np.int64)
        after[: n - width if width < n else 0] = rank[width:] if width < n else []
        order = np.lexsort((after, rank))
        step = (np.diff(rank[order]) != 0) | (np.diff(after[order]) != 0)
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(step)])
        if rank[order[-1]] == n - 1 or width > n:
            break
        width *= 2
    return order


def agreeing(codes: np.ndarray, order: np.ndarray, long: int) -> np.ndarray:
    """Whether each suffix has its first ``long`` codes in common with the one before it in the order."""
    out = np.zeros(len(order), bool)
    fits = np.flatnonzero(np.maximum(order[1:], order[:-1]) + long <= len(codes))
    same = np.ones(len(fits), bool)
    for k in range(long):
        same &= codes[order[1:][fits] + k] == codes[order[:-1][fits] + k]
    out[1:][fits] = same
    return out


def shared_tokens(streams: list[list[str]], long: int = LONG) -> list[np.ndarray]:
    """For each page's tokens, which lie in a stretch of ``long`` or more that another page has too."""
    vocabulary: dict[str, int] = {}
    codes, owner = [], []
    for page, stream in enumerate(streams):
        codes += [vocabulary.setdefault(t, len(vocabulary)) for t in stream]
        codes.append(-1 - page)  # no stretch crosses two pages
        owner += [page] * (len(stream) + 1)
    codes, owner = np.array(codes, np.int64), np.array(owner, np.int64)
    if not len(codes):
        return []
    order = suffix_array(codes)
    # Runs of suffixes that agree on ``long`` tokens; a run is shared if it has two pages.
    run = np.cumsum(~agreeing(codes, order, long)) - 1
    pages = owner[order]
    low, high = np.full(run[-1] + 1, len(streams)), np.full(run[-1] + 1, -1)
    np.minimum.at(low, run, pages)
    np.maximum.at(high, run, pages)
    starts = order[(low < high)[run]]
    edge = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + long, len(codes)), -1)
    covered = np.cumsum(edge[:-1]) > 0
    ends = np.cumsum([len(s) + 1 for s in streams])
    return [covered[e - len(s) - 1 : e - 1] for e, s in zip(ends, streams)]


def window_hashes(page: list[str], long: int = LONG) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a page's windows of ``long`` tokens, and one for each block: its own if it is short, else 0."""
    tokens = np.array([xxhash.xxh64_intdigest(t) for b in page for t in b.split()], np.uint64)
    n = max(len(tokens) - long + 1, 0)
    windows = np.zeros(n, np.uint64)
    for k in range(long):
        windows = mix64(windows * _SALT + tokens[k : k + n])
    short = np.array([xxhash.xxh64_intdigest(b, 1) if len(b.split()) < long else 0 for b in page], np.uint64)
    return windows.view(np.int64), short.view(np.int64)


def unique_runs(pages: list[list[str]], elsewhere: np.ndarray | None = None, long: int = LONG) -> list[str]:
    """Each page's text without the stretches it shares with other pages.

    ``elsewhere`` are sorted hashes that pages beyond this list share with these.
    """
    streams = [[t for b in page for t in b.split()] for page in pages]
    holders: dict[str, int] = {}
    for page in pages:
        for b in set(page):
            holders[b] = holders.get(b, 0) + 1
    out = []
    for page, stream, covered in zip(pages, streams, shared_tokens(streams, long)):
        gone = [len(b.split()) < long and holders[b] > 1 for b in page]
        if elsewhere is not None and len(elsewhere):
            windows, short = window_hashes(page, long)
            for at in np.flatnonzero(np.isin(windows, elsewhere)).tolist():
                covered[at : at + long] = True
            gone = [g or bool(h) for g, h in zip(gone, np.isin(short, elsewhere) & (short != 0))]
        kept, at = [], 0
        for b, drop in zip(page, gone):
            n = len(b.split())
            if not drop:
                kept += [t for t, c in zip(stream[at : at + n], covered[at : at + n]) if not c]
            at += n
        out.append(" ".join(kept or stream))
    return out


def _host(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def extract(pages: DataFrame, group_pages: int = GROUP_PAGES, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    kind = pages.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, text string, blocks array<string>"

    def structure(batches):
        for batch in batches:
            text, undecided = [], []
            for page in batch.column("html"):
                found, marked = blocks(page.as_py())
                text.append(" ".join(found) if marked or not found else None)
                undecided.append(None if marked or not found else found)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array(undecided, pa.list_(pa.string()))], ["page_id", "url", "text", "blocks"])

    parsed = written(pages.select("page_id", "url", "html").mapInArrow(structure, schema), "html-blocks")
    decided = parsed.where(F.col("text").isNotNull()).select("page_id", "url", "text")
    rest = parsed.where(F.col("text").isNull()).withColumn("host", F.when(F.col("url").isNull(), F.concat(F.lit("?"), F.col("page_id").cast("string"))).otherwise(_host(F.col("url"))))
    joined = F.array_join("blocks", "\n")
    rest = rest.withColumn("key", F.md5(joined.cast("binary")))
    distinct = rest.groupBy("host", "key").agg(F.first("blocks").alias("blocks"))
    counted = distinct.withColumn("tokens", F.regexp_count(F.array_join("blocks", " "), F.lit(r"\s+")) + 1)
    sizes = counted.groupBy("host").agg(F.greatest(F.ceil(F.count("*") / group_pages), F.ceil(F.sum("tokens") / group_tokens)).alias("groups"))
    grouped = written(distinct.join(sizes, "host").withColumn("part", F.pmod(F.xxhash64("key"), F.col("groups"))), "html-hosts")

    def hashed(batches):
        for batch in batches:
            for host, part, page in zip(*(batch.column(c).to_pylist() for c in ("host", "part", "blocks"))):
                found = np.unique(np.concatenate(window_hashes(page)))
                found = found[found != 0]
                yield pa.RecordBatch.from_pydict({"host": pa.array([host] * len(found), pa.string()), "part": np.full(len(found), part, np.int64), "hash": found})

    windows = grouped.where("groups > 1").select("host", "part", "blocks").mapInArrow(hashed, "host string, part long, hash long")
    across = windows.groupBy("host", "hash").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high")
    elsewhere = windows.join(across.select("host", "hash"), ["host", "hash"], "left_semi").distinct()

    def unrepeated(table, hashes):
        if not table.num_rows:
            return pa.table({"host": pa.array([], pa.string()), "key": pa.array([], pa.string()), "text": pa.array([], pa.string())})
        text = unique_runs(table.column("blocks").to_pylist(), np.sort(hashes.column("hash").to_numpy()))
        return pa.table({"host": table.column("host"), "key": table.column("key"), "text": pa.array(text, pa.string())})

    texts = grouped.select("host", "part", "key", "blocks").groupBy("host", "part").cogroup(elsewhere.groupBy("host", "part")).applyInArrow(unrepeated, "host string, key string, text string")
    from_hosts = rest.select("page_id", "url", "host", "key").join(texts, ["host", "key"]).select("page_id", "url", "text")
    return decided.unionByName(from_hosts).withColumn("n_chars", F.length("text").cast("long"))
