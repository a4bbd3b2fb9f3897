"""Main text of web pages by a site style tree.

The element trees of a host's pages are merged by path (block elements with their classes). Each node of the merged tree has a
presentation importance, the entropy of its child sequences over the host's pages (one style everywhere is 0), and a content
importance, which falls with the number of pages on which a branch has the same content: 1 - log_m(k) for k of m pages, so
a branch of one page is 1 and one that every page has is 0. Content is compared for whole branches, so a node's figures
cover all below it. A branch whose composite importance is low and which enough of the host's pages share is removed from
each page, the highest such branch first. Pages of a host that are copies of each other count once, so copies of one
article do not take each other for boilerplate.

Evidence joins the score: a branch whose element, role or class says that it is never main text (menus, page headers,
footers, sidebars, notices, adverts, forms, scripts, styles, reader comments) has no importance, and where a page marks its
article or main part, what stands outside has none. A branch of an article needs more of the host's pages than others.

Scale: pages send 64-bit hashes of paths and branches; of the counts only branches of two pages or more go on. What a host
keeps is bounded: branches under the threshold stand on m^(1 - LOW) pages or more, so a host has few of them. Pages join their
host's list; Spark broadcasts it when it is small by size, else merges and splits a hot host. Reading a page takes time
and memory in proportion to its length, however deep its elements are nested.
"""

from __future__ import annotations

import html as _html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .byte_bpe import slices
from .shared import Work, map_batches, read_table

#: Composite importance under which a branch goes, the weight of content, and the least share of pages and pages of a host.
LOW, GAMMA = 0.2, 0.9
SHARE, PAGES, SHARE_IN_ARTICLE, PAGES_IN_ARTICLE = 0.5, 5, 0.75, 20

# Fixed values of HTML: elements by what they mean.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("body caption dd dt html legend li optgroup option summary tbody td tfoot th thead tr".split())
NEVER_TEXT = frozenset("aside audio button canvas datalist dialog footer form head iframe input menu nav noscript object script search select style svg template textarea title video".split())
MAIN = frozenset(["article", "main"])
#: An opening element ends an open one of its kind, unless one of the others stands between them.
ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select datalist")}

#: Bytes of html worked on at once.
SLICE_BYTES = 2_000_000
#: Roles, and words of a class or id, of branches that are never main text.
BAD_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
BAD_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising advertorial banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright "
    "footer masthead menu nav navbar navigation notice notices notification pager pagination sidebar sponsor sponsored toolbar".split()
)
#: These mark a page's head, but an article's own head is text.
HEAD_WORDS = frozenset(["header", "banner", "masthead"])

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|title|iframe|xmp)\b[^>]*+(?:>.*?(?:</(?P=raw)\s*+>|\Z)|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
_SPACE = re.compile(r"\s+")


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): _html.unescape(v.strip("\"'")) for k, v in _ATTR.findall(raw)} if raw.strip(" /") else {}


def _never(tag: str, attrs: dict[str, str], in_main: bool) -> bool:
    if tag in NEVER_TEXT or (tag == "header" and not in_main):
        return True
    if not attrs or tag in ("html", "body", "main"):
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style", "")):
        return True
    if attrs.get("role", "").lower() in BAD_ROLES and not (in_main and attrs["role"].lower() == "banner"):
        return True
    words = set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{attrs.get('class', '')} {attrs.get('id', '')}").lower()))
    if "header" in words and not in_main and not words & {"article", "entry", "post", "content", "title"}:
        return True
    return bool(words & (BAD_WORDS - HEAD_WORDS if in_main else BAD_WORDS))


class Page:
    """A page as a tree of block elements. Node k has ``paths[k]`` (a hash of its names from the root), ``parents[k]``, ``items[k]``
    (its texts and child nodes in order), ``styles[k]`` (its child names), and says whether it may have main text."""

    def __init__(self, source: str):
        self.paths, self.parents, self.items, self.styles = [0], [-1], [[]], [[]]
        self.mains, self.has_main = [False], False
        # open elements: tag, node of the nearest block, never text, in an article or main part, blocks opened up to here
        stack: list[tuple[str, int, bool, bool, int]] = [("", 0, False, False, 0)]
        opened: dict[str, list[int]] = {}
        text: list[str] = []

        def flush() -> None:
            if text:
                joined = _SPACE.sub(" ", _html.unescape("".join(text))).strip()
                text.clear()
                if joined:
                    self.items[stack[-1][1]].append(joined)

        def close(depth: int) -> None:
            if stack[-1][4] > stack[depth - 1][4]:
                flush()
            while len(stack) > depth:
                opened[stack.pop()[0]].pop()

        def last(tags: str) -> int:
            return max((opened[t][-1] for t in tags.split() if opened.get(t)), default=0)

        at = 0
        for m in _TOKEN.finditer(source):
            if m.start() > at and not stack[-1][2]:
                text.append(source[at : m.start()])
            at = m.end()
            tag = (m["tag"] or m["tag2"] or "").lower()
            if not tag:
                continue
            if m["end"] or m["end2"]:
                if tag == "br":
                    text.append(" ")
                    continue
                depth = last(tag)
                # an inline end tag doesn't close blocks
                if depth and (tag in BLOCKS or tag in NEVER_TEXT or stack[-1][4] == stack[depth][4]):
                    close(depth)
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                elif tag == "br":
                    text.append(" ")
                continue
            kinds, between = ("p", "button table") if tag in CLOSES_P else ENDS.get(tag, ("", ""))
            if kinds and (depth := last(kinds)) > last(between):
                flush()
                close(depth)
            block = tag in BLOCKS
            if block:
                flush()
            attrs = _attributes(m["attrs"] or m["attrs2"] or "")
            _, node, never, main, blocks = stack[-1]
            gone = never or _never(tag, attrs, main)
            is_main = not gone and (tag in MAIN or attrs.get("role", "").lower() == "main")
            self.has_main |= is_main
            if block and not gone:
                name = tag + "." + attrs["class"] if attrs.get("class") else tag
                if self.styles[node][-1:] != [name]:
                    self.styles[node].append(name)
                self.paths.append(_hash(str(self.paths[node]), name))
                self.parents.append(node)
                self.items.append([])
                self.styles.append([])
                self.mains.append(main or is_main)
                self.items[node].append(len(self.paths) - 1)
                node = len(self.paths) - 1
            opened.setdefault(tag, []).append(len(stack))
            stack.append((tag, node, gone, main or is_main, blocks + block))
        if not stack[-1][2]:
            text.append(source[at:])
        flush()

    def branches(self) -> list[int]:
        """A hash of each node's whole content; 0 where there is no text."""
        out = [0] * len(self.paths)
        for k in range(len(self.paths) - 1, -1, -1):
            parts = [x if isinstance(x, str) else out[x] for x in self.items[k]]
            if any(parts):
                out[k] = _hash(str(self.paths[k]), *("t" + x if isinstance(x, str) else str(x) for x in parts)) or 1
        return out

    def blocks(self, low: set[int]) -> tuple[list[str], int]:
        """The texts that may be main text in page order, without the branches in ``low``, and how many texts these have."""
        branches, texts, removed = self.branches() if low else [], [], 0
        todo: list[tuple[object, int, bool]] = [(0, 0, False)]
        while todo:
            x, node, out = todo.pop()
            if isinstance(x, str):
                if self.mains[node] or not self.has_main:
                    removed += out
                    if not out:
                        texts.append(x)
            else:
                out = out or bool(low and branches[x] in low)
                todo.extend((y, x, out) for y in reversed(self.items[x]))
        return texts, removed


def _hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


def host_of(url):
    """Lower-case host of a url; the empty text where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit("")))


def style_tree(spark: SparkSession, pages: DataFrame, work: Work) -> DataFrame:
    """(t_host, low): per host the hashes of branches that are shared and of low composite importance."""

    def run(batches):
        for batch in slices(batches, limit=SLICE_BYTES):
            out: dict[str, list] = {"host": [], "page": [], "node": [], "kind": [], "feature": []}
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = Page(source)
                branches = page.branches()
                rows = {(0, 2, 0)}
                for path, main, branch, style in zip(page.paths, page.mains, branches, page.styles, strict=True):
                    rows.add((path, 3, _hash(*style)))
                    if branch:
                        rows.add((path, 1 if main else 0, branch))
                for node, kind, feature in rows:
                    for k, v in zip(out, (host, branches[0], node, kind, feature), strict=True):
                        out[k].append(v)
            types = {"host": pa.string(), "kind": pa.int32()}
            yield pa.RecordBatch.from_arrays([pa.array(v, types.get(k, pa.int64())) for k, v in out.items()], names=list(out))

    found = map_batches(pages.select("host", "html"), "html", run, "host string, page long, node long, kind int, feature long")
    # pages with the same content count once
    counts = found.groupBy("host", "node", "kind", "feature").agg(F.count_distinct("page").alias("k"))
    counts, _ = work.table(counts.filter("k > 1 OR kind > 1"), "counts")
    hosts = counts.filter("kind = 2").select(F.col("host").alias("h_host"), F.col("k").alias("m"))
    counts = counts.join(hosts, F.col("host") == F.col("h_host")).filter(F.col("m") >= PAGES)
    log_m = F.log(F.col("m").cast("double"))
    styles = counts.filter("kind = 3").groupBy("host", "node").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.log("k")).alias("klogk"), F.max("m").alias("m"))
    styles = styles.select(F.col("host").alias("s_host"), F.col("node").alias("s_node"), ((F.log("n") - F.col("klogk") / F.col("n")) / log_m).alias("presentation"))
    blocks = counts.filter("kind < 2").withColumn("content", 1 - F.log("k") / log_m)
    enough = F.when(F.col("kind") == 1, (F.col("m") >= PAGES_IN_ARTICLE) & (F.col("k") >= SHARE_IN_ARTICLE * F.col("m"))).otherwise(F.col("k") >= SHARE * F.col("m"))
    joined = blocks.filter(enough).join(styles, (F.col("host") == F.col("s_host")) & (F.col("node") == F.col("s_node")), "left")
    composite = (1 - GAMMA) * F.coalesce("presentation", F.lit(0.0)) + GAMMA * F.col("content")
    return joined.filter(composite < LOW).groupBy(F.col("host").alias("t_host")).agg(F.collect_list("feature").alias("low"))


def extract(spark: SparkSession, df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``df``: page_id, url, text, n_chars, n_removed (texts of the branches that the site's tree took out).

    A null or empty page has the empty text. Pages without a host in their url are one site. Null ids and urls are
    carried; repeated rows count as pages each and get the same text. An empty table gives no rows. Damaged markup
    is read as far as it goes. Columns not named here are ignored.
    """
    work, id_type = Work(spark, "style-tree"), df.schema[id_col].dataType.simpleString()
    pages = df.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"))
    pages = pages.withColumn("host", host_of(F.col("url")))
    tree, _ = work.table(style_tree(spark, pages, work), "tree")
    joined = pages.join(tree, pages.host == tree.t_host, "left").select("page_id", "html", "url", "low")

    def run(batches):
        for batch in slices(batches, limit=SLICE_BYTES):
            texts, removed = [], []
            for source, low in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                kept, gone = Page(source).blocks(set(low or ()))
                texts.append("\n".join(kept))
                removed.append(gone)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(removed, pa.int64())], names=["page_id", "url", "text", "n_chars", "n_removed"])

    return map_batches(joined, "html", run, f"page_id {id_type}, url string, text string, n_chars long, n_removed long")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark, read_table(spark, sf_dir, "pages"))
