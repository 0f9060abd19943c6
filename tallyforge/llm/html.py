"""Main text of web pages: markup roles, and a sparse suffix array per host for what its pages repeat.

Each page is cut into blocks. Markup settles most of them: menus, page headers and footers, sidebars, adverts, forms and
comments go. The tokens of the blocks that are left form the page's stream. A host's suffix array holds the suffixes of
its streams at block starts and at window minima, each with its head (HEAD tokens) and its page; sorting them by host and
head brings the suffixes together that go on alike. A head on enough distinct pages opens a repeat; around it every
suffix of the stream is compared, so that a repeat is known to the token. Runs that repeats cover are cut out, whatever
their tags and names, and the unique runs stay.

A repeat counts by the distinct contents that hold it, so exact copies of a page are no evidence. Three pages are enough
outside an article. Inside one, articles that quote a passage, a licence or each other are no boilerplate: there half of
the host's pages must hold the repeat, and an article whose tokens repeats cover by 0.8 or more is a near copy, by the
similarity that near-duplicate operators take, and stays whole.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

HEAD, WINDOW = 8, 16
#: A run of so many tokens always has a sampled suffix; shorter ones are cut only as whole blocks.
RUN = HEAD + WINDOW - 1
#: Elements by what they mean for the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg math canvas audio video".split())
DROPPED = frozenset("nav footer aside form button select option menu dialog".split())
BREAKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BREAKS - {"br", "body", "html"}
#: Words of class and id names, and roles, of what is not the article. One such word in a name is enough.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies gdpr newsletter subscribe signup popup "
    "modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs comments commentlist disqus footer masthead toolbar pagination pager".split()
)
#: Words that mean the same only beside words like these (related-posts, but not related-work).
UNSURE = frozenset("notice notices share sharing social related recommended comment respond reply login search widget promotion consent subscription".split())
BESIDE = frozenset("box bar list links link posts post articles article items item button buttons icons icon area section container wrapper wrap block panel form site page top bottom left right inner outer content news stories media thread".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][\w:-]*)[^>]*>?|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([\w:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
ARTICLE, MAIN, OTHER = 1, 2, 3


def _tells(name: str) -> bool:
    parts = {p for p in re.split(r"[^a-z0-9]+", name) if p and not p.isdigit()}
    return not NAMES.isdisjoint(parts) or not UNSURE.isdisjoint(parts) and parts <= UNSURE | BESIDE


def _named(tag: str, attributes: str) -> bool:
    """Whether the attributes say that the element is not part of the article."""
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "").lower()
        if name in ("class", "id") and any(_tells(word) for word in value.split()):
            return True
        if name == "role" and value.strip() in ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


def blocks(page: str) -> list[tuple[int, str, float]]:
    """Kind (ARTICLE, MAIN or OTHER), text and share of link text of each block that markup doesn't rule out."""
    out: list[tuple[int, str, float]] = []
    stack: list[tuple[str, bool, int]] = []  # tag, ruled out, kind
    held: list[str] = []
    linked = total = 0

    def flush() -> None:
        nonlocal linked, total
        if held:
            text = " ".join(markup.unescape("".join(held)).split())
            if text:
                out.append((stack[-1][2] if stack else OTHER, text, linked / max(total, 1)))
            held.clear()
        linked = total = 0

    at, links = 0, 0
    while at < len(page):
        found = TOKEN.match(page, at)
        at = found.end()
        tag = found[2] or found[5]
        if tag is None:
            if not found[0].startswith(("<!", "<?")) and not (stack and stack[-1][1]):
                held.append(found[0])
                total += len(found[0])
                linked += len(found[0]) * (links > 0)
            continue
        tag, ends = tag.lower(), bool(found[1] or found[4])
        if tag in RAW and not ends:
            if tag in ("svg", "math", "object", "video", "audio", "canvas", "template", "noscript", "iframe", "textarea") and (found[3] or "").rstrip().endswith("/"):
                continue
            end = re.compile(f"</{tag}\\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in BREAKS:
            flush()
        if ends:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    links -= sum(x[0] == "a" for x in stack[k:])
                    del stack[k:]
                    break
            continue
        if tag in VOID:
            continue
        if tag in CLOSES_P and any(x[0] == "p" for x in stack[-4:]):
            k = max(i for i, x in enumerate(stack) if x[0] == "p")
            if all(x[0] not in BREAKS for x in stack[k + 1 :]):
                links -= sum(x[0] == "a" for x in stack[k:])
                del stack[k:]
        out_of, kind = (stack[-1][1], stack[-1][2]) if stack else (False, OTHER)
        attributes = found[3] or ""
        if tag in ("article", "main") or re.search(r"role\s*=\s*[\"']?main\b", attributes):
            # an advert or a menu that was never closed does not hold the article; comments and sidebars may
            if out_of and not any(x[1] and x[0] in ("aside", "section", "ol", "ul", "footer") for x in stack):
                out_of = False
            kind = ARTICLE if tag == "article" else min(kind, MAIN)
        if tag in DROPPED or _named(tag, attributes) or tag == "header" and kind != ARTICLE:
            out_of = True
        stack.append((tag, out_of, kind))
        links += tag == "a"
    flush()
    return out


def chosen(found: list[tuple[int, str, float]]) -> list[tuple[int, str]]:
    """The blocks of the article, failing that of the main part, failing that all that are not lists of links."""
    best = min((kind for kind, _, _ in found), default=OTHER)
    return [(kind, text) for kind, text, linked in found if kind == best and (kind != OTHER or linked <= 0.6)]


def host(url: str | None) -> str:
    found = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", url or "")
    return found[1].lower() if found else ""


def token_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each token of a page's stream, and the token number at which each block ends."""
    words = [t.split(" ") for t in texts]
    ends = np.cumsum([len(w) for w in words], dtype=np.int64) if words else np.zeros(0, dtype=np.int64)
    return np.array([xxhash.xxh3_64_intdigest(w) for own in words for w in own], dtype=np.uint64), ends


def suffix_heads(tokens: np.ndarray) -> np.ndarray:
    """A hash of the first HEAD tokens of every suffix that has so many."""
    n = max(0, len(tokens) - HEAD + 1)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(HEAD if n else 0):
        out = out * np.uint64(0x100000001B3) + tokens[j : j + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out


def sampled(heads: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the sparse suffix array has a suffix: block starts, and the least head of each window."""
    pick = np.zeros(len(heads), dtype=bool)
    starts = np.concatenate((np.zeros(1, dtype=np.int64), ends[:-1]))
    pick[starts[starts < len(heads)]] = True
    if len(heads) >= WINDOW:
        runs = np.lib.stride_tricks.sliding_window_view(heads, WINDOW)
        pick[np.arange(len(runs)) + runs.argmin(axis=1)] = True
    return np.nonzero(pick)[0]


def member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array `known`."""
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def cut_runs(texts: list[str], repeat: np.ndarray, ends: np.ndarray) -> tuple[list[str], int]:
    """The blocks without the runs that repeats cover, and how many tokens those had.

    `repeat` says of each suffix whether its head is a repeat. A covered run is cut if it has RUN tokens, else only the
    whole blocks in it.
    """
    n = int(ends[-1]) if len(ends) else 0
    edges = np.zeros(n + 1, dtype=np.int64)
    hit = np.nonzero(repeat)[0]
    np.add.at(edges, hit, 1)
    np.add.at(edges, hit + HEAD, -1)
    covered = np.cumsum(edges[:n]) > 0
    change = np.flatnonzero(np.diff(np.concatenate(([False], covered, [False])).astype(np.int8)))
    cut = np.zeros(n, dtype=bool)
    starts = np.concatenate((np.zeros(1, dtype=np.int64), ends[:-1]))
    for a, b in zip(change[::2], change[1::2]):
        if b - a >= RUN:
            cut[a:b] = True
        else:
            for i in np.nonzero((starts >= a) & (ends <= b))[0]:
                cut[starts[i] : ends[i]] = True
    out = []
    for text, a, b in zip(texts, starts, ends):
        if not cut[a:b].any():
            out.append(text)
        elif not cut[a:b].all():
            out.append(" ".join(w for w, gone in zip(text.split(" "), cut[a:b]) if not gone))
    return out, int(cut.sum())


KEY = ["k1", "k2"]


def _repeats(found: DataFrame, least_pages: int, share: float, hosts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """KEY and the sorted heads that are repeats, for the pages of found(KEY, host, content, article, heads) that have
    any; and how many distinct contents each host has (counted here if not given)."""
    # copies of a page count once; equal contents have equal heads
    contents = found.groupBy("host", "content").agg(F.first("heads").alias("heads"))
    if hosts is None:
        hosts, _ = materialise(contents.groupBy("host").agg(F.count("*").alias("contents")), "html-hosts")
    often = contents.select("host", F.explode("heads").alias("h")).groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    often, _ = materialise(often.join(hosts, "host").select("host", "h", (F.col("n") >= share * F.col("contents")).alias("most")), "html-often")
    held = found.select(*KEY, "host", "article", F.explode("heads").alias("h")).join(often, ["host", "h"]).where("most or not article")
    return materialise(held.groupBy(*KEY).agg(F.sort_array(F.collect_set("h")).alias("known")), "html-known")[0], hosts


def extract(pages: DataFrame, least_pages: int = 3, share: float = 0.5, alike: float = 0.8) -> DataFrame:
    """page_id, url, text (the main text, '' if none) and n_cut (tokens cut as repeats of the host) for every row of `pages`.

    Blocks are joined by a line feed; white space inside a block is one space. Null html is empty; pages with a null url
    share one nameless host; a null page_id is carried along; a repeated row has the same content and is no repeat of
    itself; an empty table gives no rows; other columns are ignored. Broken markup is read as far as it goes, and pages
    of any length are read whole. Inside articles a repeat must be on `share` of the host's distinct pages, and an
    article of which repeats cover `alike` or more is a near copy of others, not boilerplate, and is left whole.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumns({"k1": F.xxhash64("url", "html"), "k2": F.crc32(F.coalesce("html", F.lit("")).cast("binary"))})
    fields = ["host", "content", "article", "heads"]

    def packed(batch: pa.RecordBatch, out: list[tuple[str, int, bool, np.ndarray]]) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(o[3]) for o in out)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *(o[3].view(np.int64) for o in out)])))
        columns = [pa.array([o[i] for o in out], kind) for i, kind in ((0, pa.string()), (1, pa.int64()), (2, pa.bool_()))]
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in KEY), *columns, lists], [*KEY, *fields])

    def stream(page: str | None) -> tuple[list[tuple[int, str]], np.ndarray, np.ndarray, np.ndarray]:
        kept = chosen(blocks(page or ""))
        tokens, ends = token_hashes([t for _, t in kept])
        return kept, tokens, ends, suffix_heads(tokens)

    def signature(tokens: np.ndarray) -> int:
        return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
                kept, tokens, ends, heads = stream(page)
                out.append((host(url), signature(tokens), bool(kept) and kept[0][0] == ARTICLE, np.unique(heads[sampled(heads, ends)])))
            yield packed(batch, out)

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every suffix within a window of a sampled one that is a repeat."""
        for batch in batches:
            out = []
            for url, page, known in zip(*(batch.column(c).to_pylist() for c in ("url", "html", "known"))):
                kept, tokens, ends, heads = stream(page)
                at = sampled(heads, ends)
                hit = at[member(heads[at].view(np.int64), np.array(known, dtype=np.int64))]
                near = np.zeros(len(heads) + 1, dtype=np.int64)
                np.add.at(near, np.maximum(hit - WINDOW, 0), 1)
                np.add.at(near, np.minimum(hit + WINDOW + 1, len(heads)), -1)
                out.append((host(url), signature(tokens), kept[0][0] == ARTICLE, np.unique(heads[np.cumsum(near[:-1]) > 0])))
            yield packed(batch, out)

    kind = "k1 long, k2 long, host string, content long, article boolean, heads array<long>"
    found, _ = materialise(rows.select(*KEY, "url", "html").mapInArrow(index, kind), "html-suffixes")
    near, hosts = _repeats(found, least_pages, share)
    dense, _ = materialise(rows.join(near, KEY).select(*KEY, "url", "html", "known").mapInArrow(around, kind), "html-around")
    known, _ = _repeats(dense, least_pages, share, hosts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone = [], []
            for page, own in zip(batch.column("html").to_pylist(), batch.column("known").to_pylist()):
                kept = chosen(blocks(page or ""))
                blocks_left, n = [t for _, t in kept], 0
                if own:
                    tokens, ends = token_hashes(blocks_left)
                    less, n = cut_runs(blocks_left, member(suffix_heads(tokens).view(np.int64), np.array(own, dtype=np.int64)), ends)
                    if kept[0][0] == ARTICLE and n >= alike * len(tokens):
                        n = 0
                    else:
                        blocks_left = less
                texts.append("\n".join(blocks_left))
                gone.append(n)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(gone, pa.int64())], ["page_id", "url", "text", "n_cut"])

    joined = rows.join(known, KEY, "left").select("page_id", "url", "html", "known")
    return joined.mapInArrow(cut, f"page_id {dict(rows.dtypes)['page_id']}, url string, text string, n_cut long")


def op10_html(spark, sf_dir: str) -> DataFrame:
    found = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_cut")
