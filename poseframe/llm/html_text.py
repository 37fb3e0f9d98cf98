"""Main text of web pages with a site style tree.

Pages are read into blocks, each under the path of the elements it stands in. The trees of one host are merged: for each
path the importance of a node is the entropy of what it holds over the host's different pages, and of the shapes in which
its content is laid out; nodes that hold the same thing on page after page are low, and their branches are removed from
every page. Elements that are never the article (menus, forms, scripts and so on, and hidden ones) are left out while
reading. Words of a class, id or role that speak against the article, and the article and main elements, are read with
the blocks and decided after the merge, by the share of the text that such an element holds on average over the host's
pages: a marked element with most of the text is kept, and only articles with most of the text leave out the rest.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poseframe.llm.common import stored

#: Elements by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe".split())
NOT_ARTICLE = frozenset("head nav header footer aside form script style noscript template textarea title iframe button select svg canvas dialog menu object audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCK - frozenset("body html".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table article section div body".split())
#: Words of a class, id or role that mark what isn't the article.
MARKS = frozenset(
    "ad ads adv advert advertisement adverts advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs header masthead footer comment comments commentlist disqus replies share sharing social related recommended recommendations widget widgets pagination pager toolbar skip login search form complementary contentinfo".split()
)
#: A path counts for removal if this many different pages of the host have it, and its importance is at most LOW.
LEAST_PAGES, LOW = 8, 0.2
#: Share of its pages' text up to which a marked element is left out, and above which an article leaves out the rest.
MOST = 0.5
#: Paths to remove that are broadcast at most; more are joined by shuffling.
BROADCAST_ROWS = 20_000

#: A tag; where a quote has no end, the tag ends at the next >.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?:(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|(?P<loose>[^>]*)(?:>|\Z))", re.S)
_MARK = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
_WORD = re.compile(r"[a-z]+")
_QUOTES = "\"'"
#: Beside one of these words a header is that of the text.
_OWN = frozenset("article post entry story content main".split())


def _apart(name: str, attrs: str) -> tuple[bool, bool, str]:
    """Whether an element isn't the article, whether its words speak against it, and its key in the style tree."""
    if not attrs.strip():
        return name in NOT_ARTICLE, False, name
    marks = {k.lower(): v.strip("\"'") for k, v in _MARK.findall(attrs)}
    words = set(_WORD.findall(" ".join(re.sub("([a-z])([A-Z])", r"\1 \2", v) for v in marks.values()).lower()))
    kind = ".".join(sorted(marks.get("class", "").split()))
    found = words & MARKS
    if words & _OWN:
        found -= {"header", "masthead"}
    # an inline element is part of its sentence, whatever its class
    return name in NOT_ARTICLE or bool(_HIDDEN.search(attrs)), bool(found) and (name in BLOCK or "-" in name), f"{name}.{kind}" if kind else name


def blocks(page: str) -> list[tuple[str, str, tuple[str, ...], str]]:
    """(path, text, paths of its marked elements, path of its article or main) of the blocks of a page, in order."""
    out: list[tuple[str, str, tuple[str, ...], str]] = []
    stack: list[tuple[str, str, bool, tuple[str, ...], str, bool]] = []  # name, path, left out, marked, article, ends a block
    buffer: list[str] = []
    opened: Counter[str] = Counter()  # names on the stack, so that no stray tag searches it

    def flush() -> None:
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                out.append((stack[-1][1], text, stack[-1][3], stack[-1][4]) if stack else ("", text, (), ""))

    def pop(to: int) -> None:
        if any(s[5] or s[2] for s in stack[to:]):
            flush()
        opened.subtract(s[0] for s in stack[to:])
        del stack[to:]

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        start = m.start() if m else n
        if start > at and not (stack and stack[-1][2]):
            buffer.append(page[at:start])
        if not m:
            break
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        attrs = m["attrs"] if m["attrs"] is not None else m["loose"]
        if m["end"]:
            if opened[name] > 0:
                pop(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            elif name in BLOCK:
                flush()
            continue
        if name in ("br", "hr", "img"):
            if not (stack and stack[-1][2]):
                buffer.append(" ")
            if name == "hr":
                flush()
            continue
        if name in VOID:
            continue
        if name in ENDS_P and opened["p"] > 0:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    pop(i)
                    break
                if stack[i][0] in SCOPES:
                    break
        if name in CLOSES and any(opened[x] > 0 for x in CLOSES[name]):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in CLOSES[name]:
                    pop(i)
                    break
                if stack[i][0] in SCOPES:
                    break
        apart, marked, key = _apart(name, attrs)
        ends = name in BLOCK or marked
        if ends or apart:
            flush()
        above = stack[-1] if stack else ("", "", False, (), "", False)
        if attrs.endswith("/") and name in ("svg", "iframe"):
            continue
        path = f"{above[1]}>{key}" if ends else above[1]
        mark = f"{path} {' '.join(sorted(v.strip(_QUOTES) for _, v in _MARK.findall(attrs)))}"  # ids and roles tell marked elements apart
        article = above[4] or (path if name in ("article", "main") else "")
        opened[name] += 1
        stack.append((name, path, above[2] or apart, (*above[3], mark) if marked else above[3], article, ends))
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            stack.pop()
            opened[name] -= 1
    flush()
    return out


def host_of(url: str | None) -> str:
    at = (url or "").find("://")
    return re.split("[/?#]", url[at + 3 :], maxsplit=1)[0].lower() if at >= 0 else ""


def _digest(*texts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\n".join(texts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") >> 1


_READ = "page_id long, url string, host string, page long, blocks array<struct<path:string,text:string,marks:array<string>,article:string>>, nodes array<struct<path:string,held:long,shape:long>>, shares array<struct<kind:string,path:string,share:double>>"
_BLOCKS = pa.list_(pa.struct([("path", pa.string()), ("text", pa.string()), ("marks", pa.list_(pa.string())), ("article", pa.string())]))
_SHARES = pa.list_(pa.struct([("kind", pa.string()), ("path", pa.string()), ("share", pa.float64())]))
_NODES = pa.list_(pa.struct([("path", pa.string()), ("held", pa.int64()), ("shape", pa.int64())]))


def _shares(found: list[tuple[str, str, tuple[str, ...], str]]) -> list[dict]:
    """What share of a page's text its marked elements hold, and its articles of what small marked elements leave."""
    total = sum(len(t) for _, t, _, _ in found)
    marks: dict[str, int] = {}
    for _, text, above, _ in found:
        for m in set(above):
            marks[m] = marks.get(m, 0) + len(text)
    small = {m for m, n in marks.items() if n <= MOST * total}
    rest = [(len(text), article) for _, text, above, article in found if not small & set(above)]
    left = sum(n for n, _ in rest)
    articles: dict[str, int] = {}
    for n, article in rest:
        if article:
            articles[article] = articles.get(article, 0) + n
    return [{"kind": "mark", "path": m, "share": n / total} for m, n in marks.items()] + [{"kind": "article", "path": a, "share": n / left} for a, n in articles.items()]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, 200):
            part = b.slice(lo, 200)
            hosts, pages, every, nodes, shares = [], [], [], [], []
            for url, page in zip(part.column(1), part.column(2), strict=True):
                found = blocks(page.as_py() or "")
                own = [x for x in found if x[3] and not x[2]] or [x for x in found if not x[2]] or found
                held: dict[str, list[str]] = {}
                for path, text, _, _ in found:
                    held.setdefault(path, []).append(text)
                hosts.append(host_of(url.as_py()))
                pages.append(_digest(*(x[1] for x in own)))
                every.append([{"path": p, "text": t, "marks": list(m), "article": a} for p, t, m, a in found])
                shares.append(_shares(found))
                nodes.append([{"path": p, "held": _digest(*t), "shape": len(t)} for p, t in held.items()])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(hosts, pa.string()), pa.array(pages, pa.int64()), pa.array(every, _BLOCKS), pa.array(nodes, _NODES), pa.array(shares, _SHARES)],
                ["page_id", "url", "host", "page", "blocks", "nodes", "shares"],
            )


def style_tree(read: DataFrame) -> DataFrame:
    """Rows (host, path, n_pages, importance) of the merged trees: 1 where content or layout always differs, 0 where never.

    Pages that hold the same text count once, so copies of an article don't make it look like boilerplate.
    """
    nodes = read.select("host", "page", F.explode("nodes").alias("n")).select("host", "page", "n.path", "n.held", "n.shape").distinct()

    def entropy(of: str) -> DataFrame:
        per = nodes.groupBy("host", "path", of).agg(F.count("*").alias("c")).groupBy("host", "path")
        part = per.agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log(F.col("c").cast("double"))).alias("s"))
        spread = F.log(F.col("n").cast("double")) - F.col("s") / F.col("n")
        return part.select("host", "path", "n", F.when(F.col("n") > 1, spread / F.log(F.col("n").cast("double"))).otherwise(1.0).alias(of))

    both = entropy("held").join(entropy("shape").drop("n"), ["host", "path"])
    return both.select("host", "path", F.col("n").alias("n_pages"), F.greatest("held", "shape").alias("importance"))


def main_texts(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars.

    Character references are decoded, white space inside a block is one space, blocks are joined by two line feeds. A null
    or empty html, and one without an article's text, gives an empty text. Rows that repeat a page_id are rows of their
    own. Other columns are ignored; an empty table gives an empty result.
    """
    read = stored(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(_read, _READ), "html-blocks")
    low = style_tree(read).where((F.col("n_pages") >= LEAST_PAGES) & (F.col("importance") <= LOW))
    held = read.select("host", F.inline("shares")).groupBy("host", "kind", "path").agg(F.avg("share").alias("share"))
    held = held.where(((F.col("kind") == "mark") & (F.col("share") <= MOST)) | ((F.col("kind") == "article") & (F.col("share") > MOST)))
    low = low.select("host", F.lit("low").alias("kind"), "path").unionByName(held.select("host", "kind", "path"))
    low = stored(low.withColumnRenamed("host", "l_host"), "html-low")
    few = low.count()
    of = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.col("path")))
    gone = low.groupBy("l_host").agg(of("low").alias("gone"), of("mark").alias("marked"), of("article").alias("articles"))
    rows = read.select("page_id", "url", "host", "blocks")
    joined = rows.join(F.broadcast(gone) if few <= BROADCAST_ROWS else gone, F.col("host") == F.col("l_host"), "left")
    holds = lambda c: F.coalesce(c, F.lit(False))
    left = F.filter("blocks", lambda b: ~holds(F.array_contains("gone", b["path"])) & ~holds(F.arrays_overlap("marked", b["marks"])))
    joined = joined.select("page_id", "url", "articles", left.alias("left"))
    inside = F.filter("left", lambda b: holds(F.array_contains("articles", b["article"])))
    left = F.when(F.size(inside) > 0, inside).otherwise(F.col("left"))
    text = F.array_join(F.transform(left, lambda b: b["text"]), "\n\n")
    return joined.select("page_id", "url", text.alias("text")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
