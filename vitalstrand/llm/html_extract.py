"""Main text of web pages, with repeated runs of a host found by suffix arrays.

Structure decides what it can: markup, scripts, styles, forms and elements that name a page part (menu, header,
footer, sidebar, notice, advert, comments) are never main text, and where a page marks its article that is the main
text, less the blocks that are boilerplate. What lies outside is the page's loose text. Article blocks, loose blocks and the furniture's text of a host's pages are concatenated
into one token stream, and token runs that ``LEAST`` of the host's distinct texts or more hold, and a share ``SHARE`` of them, are boilerplate: a block
of the article goes if such runs cover it whole; where a page has no marked
article its main text is the loose blocks, less the tokens that such runs cover.

Pages with the same article and loose blocks, whatever their id and url, are one text: copies of a page don't make its text boilerplate,
and of copies one stands for all (the furniture of that one counts). A host's distinct texts are dealt to shards of about
``SHARD_TOKENS`` tokens, or ``SHARD_TEXTS`` texts if those are longer. A run that a share of all texts hold is held by that share of the texts of
one shard at least, so a suffix array of each shard (prefix doubling, so suffixes that share their first ``RUN`` tokens have one rank) gives
the candidates: the runs that reach the share there. Tokens are two bytes of their hash for this, which may propose too much but misses nothing.
Candidates are then counted in all shards by whole hashes, and only runs that reach the share of the whole host are marked in the pages. The outcome doesn't depend on the shards, no host has to fit a task, and no row is
written for a token. Hosts and runs are 64-bit hashes.

Inside an article a class or id removes an element only if one of its names is a page part as a whole (``related``, ``share-buttons``), not if it
merely holds such a word (``related-work``); outside, any word of a name counts.

Defined cases: null or empty html gives empty text; a page without a host in its url shares runs with no other; repeated rows are
extracted each; a page that runs would empty keeps its text; very long pages are read whole; an unclosed element ends with
its parent or the page; a quoted attribute without an end is cut at the next ``>``; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalstrand.llm.common import WordHashes, mix
from vitalstrand.session import fresh_path, stage

#: Tokens of the shortest run that counts as boilerplate.
RUN = 10
#: Distinct texts of a host that hold a boilerplate run: their least number and their share.
LEAST, SHARE = 3, 0.25
#: Tokens of one shard of a host, and its texts on average where those are more.
SHARD_TOKENS, SHARD_TEXTS = 200_000, 16

# Elements whose content is never text of the page.
RAW = ("script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "textarea", "select", "head", "title")
# Those whose content is plain text, up to the first end tag.
PLAIN = ("script", "style", "textarea", "iframe", "title")
# Elements, roles and name parts of page furniture.
FURNITURE = ("nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "datalist", "option", "optgroup")
ROLES = ("navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu")
NAMES = (
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie",
    "cookies", "disqus", "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification",
    "popup", "promo", "recommended", "related", "replies", "reply", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored",
    "subscribe", "toolbar", "widget",
)
# Words of a name that only say what kind of box a page part is.
BOXES = ("area", "bar", "block", "box", "button", "buttons", "container", "content", "form", "inner", "item", "items", "links", "list", "outer", "panel", "section", "slot", "unit", "wrap", "wrapper")
# Elements that end a block of text, elements without content, and elements closed by the next of their kind.
BLOCKS = (
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav",
    "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
)
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
# Inline elements, which a block's end closes and which never hold page furniture open.
INLINE = ("a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var")

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attr>(?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')?+)*+)(?:>|\Z)", re.S)
ATTR = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|aria-hidden|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORD = re.compile(r"[^\W_]+")
_BLOCKS, _VOID, _INLINE, _FURNITURE, _NAMES, _ROLES, _BOXES = map(frozenset, (BLOCKS, VOID, INLINE, FURNITURE, NAMES, ROLES, BOXES))
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in RAW}


#: Class and id of an article that is a reader's comment or a teaser: whole names, or the first part of one.
_NOTE = re.compile(r"(?:div-)?(?:comment|reply)(?:[-_].*)?", re.S)


def page_part(name: str) -> bool:
    """Whether a class or id is the name of a page part as a whole: listed words, numbers and kinds of box, no other word."""
    words = [w for w in WORD.findall(name) if not w.isdecimal()]
    return any(w in _NAMES for w in words) and all(w in _NAMES or w in _BOXES for w in words)


def furniture(name: str, attributes: str, inside: bool = False) -> bool:
    """Whether an element, ``inside`` an article or not, is a part of the page other than its text, by its name, role, class or id."""
    if name in _FURNITURE:
        return True
    if not attributes:
        return False
    for key, *values in ATTR.findall(attributes):
        value = "".join(values).lower()
        key = key.lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "role" and value in _ROLES):
            return True
        if key not in ("class", "id") or name in ("html", "body", "main"):
            continue
        # Names of an article tell more than its part of the page ("has-sidebar"); whole ones count.
        if name == "article":
            if any(v in _NAMES or _NOTE.fullmatch(v) for v in value.split()):
                return True
        elif inside:
            if any(page_part(v) or _NOTE.fullmatch(v) for v in value.split()):
                return True
        elif not _NAMES.isdisjoint(WORD.findall(value)):
            return True
    return False


def raw_end(page: str, name: str, at: int, parents: dict[str, list[int]], absent: set[str]) -> int:
    """Place after the raw element whose start tag ends at ``at``; an unclosed one ends before the end tag of its parent.

    Unclosed script and style reach to the end of the page; unclosed svg and math end before the next block too.
    ``absent`` remembers names without a further end tag.
    """
    end = None if name in absent else _RAW_END[name].search(page, at)
    if end is None:
        absent.add(name)
    if end and name in PLAIN:
        return end.end()
    if name in ("script", "style"):
        return len(page)
    inner: list[str] = []
    depth: Counter = Counter()
    block = None
    place = at
    while m := TAG.search(page, place):
        place = m.end()
        if not m["name"]:
            continue
        tag = m["name"].lower()
        if m["close"]:
            if depth[tag]:
                while (gone := inner.pop()) != tag:
                    depth[gone] -= 1
                depth[tag] -= 1
            elif tag == name:
                return m.end()
            elif parents.get(tag):
                break
        elif tag in ("script", "style"):
            close = _RAW_END[tag].search(page, place)
            place = close.end() if close else len(page)
        else:
            block = m.start() if block is None and tag in _BLOCKS else block
            if not end and block is not None and name in ("svg", "math"):
                break
            if tag not in _VOID and not (m["attr"] or "").rstrip().endswith("/"):
                inner.append(tag)
                depth[tag] += 1
    if name in ("svg", "math") and block is not None:
        return block
    return m.start() if m else len(page)


def blocks(page: str | None) -> tuple[list[str], list[str], list[str], bool]:
    """Blocks of the article, loose blocks, blocks of page furniture, and whether there is an article.

    ``header`` inside an article holds its headline and is kept; other furniture is dropped there too.
    """
    page = page or ""
    inside: list[str] = []
    loose: list[str] = []
    around: list[str] = []
    open_: list[tuple[str, bool, bool]] = []  # name, in furniture, in article
    # Places in open_ by name, and those of elements that aren't inline: an end tag costs what it closes.
    where: dict[str, list[int]] = defaultdict(list)
    solid: list[int] = []
    absent: set[str] = set()
    parts: list[str] = []
    bad = article = marked = False

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                (around if bad else inside if article else loose).append(text)

    def drop(place: int) -> tuple[bool, bool]:
        while len(open_) > place:
            name, *state = open_.pop()
            where[name].pop()
            if name not in _INLINE:
                solid.pop()
        return tuple(state)

    at = 0
    while True:
        m = TAG.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            parts.append(text)
        if not m:
            break
        at = m.end()
        if m["cdata"] is not None:
            parts.append(m["cdata"].replace("&", "&amp;"))
        if not m["name"]:
            continue
        name = m["name"].lower()
        if name in _BLOCKS and name != "br" or name in _FURNITURE:
            flush()
        elif name == "br":
            parts.append(" ")
        if m["close"]:
            if where.get(name):
                # The end of an inline element doesn't close blocks around it.
                place = where[name][-1]
                if name not in _INLINE or not solid or solid[-1] < place:
                    flush() if open_[place][1:] != (bad, article) else None
                    bad, article = drop(place)
        elif name in _RAW_END:
            if name == "head":
                end = _RAW_END[name].search(page, at)
                at = end.end() if end else at
            elif name not in ("svg", "math") or not (m["attr"] or "").rstrip().endswith("/"):
                at = raw_end(page, name, at, where, absent)
        elif name not in _VOID and not (m["attr"] or "").rstrip().endswith("/"):
            if name in ("p", "li", "option") and open_ and open_[-1][0] == name:
                bad, article = drop(len(open_) - 1)
            where[name].append(len(open_))
            if name not in _INLINE:
                solid.append(len(open_))
            open_.append((name, bad, article))
            now_bad = bad or ((name != "header" or not article) and furniture(name, m["attr"], article))
            starts = name in ("article", "main") and not now_bad
            if (now_bad, article or starts) != (bad, article):
                flush()
                bad, article = now_bad, article or starts
                marked = marked or starts
    flush()
    return inside, loose, around, marked


def host_of(url: str | None) -> str:
    m = re.match(r"[^:]*://([^/?#]*)", url or "")
    return m[1].lower() if m else ""


def signed(text: str) -> int:
    """64-bit hash as a signed number."""
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - 2**64 if h >= 2**63 else h


def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            hosts = [host_of(u) for u in part.column(1).to_pylist()]
            found = [blocks(x) for x in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(1),
                    pa.array([signed(h) if h else None for h in hosts], pa.int64()),
                    pa.array([signed(" ".join(a) + "\0" + " ".join(b)) for a, b, _, _ in found], pa.int64()),
                    pa.array([signed(" ".join(c)) for _, _, c, _ in found], pa.int64()),
                    pa.array([sum(len(x.split()) for group in f[:3] for x in group) for f in found], pa.int64()),
                    pa.array([a if marked else None for a, _, _, marked in found], pa.list_(pa.string())),
                    pa.array([b for _, b, _, _ in found], pa.list_(pa.string())),
                    pa.array([c for _, _, c, _ in found], pa.list_(pa.string())),
                ],
                names=["page_id", "url", "host", "page", "rest", "total", "article", "loose", "around"],
            )


PARSED = "page_id long, url string, host long, page long, rest long, total long, article array<string>, loose array<string>, around array<string>"


def suffix_ranks(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Rank of every suffix by its first ``depth`` tokens, by prefix doubling: equal rank, equal run.

    A suffix that is shorter is ranked by what it has. ``depth`` is rounded up to a power of two steps and the last
    step is cut to it.
    """
    _, rank = np.unique(tokens, return_inverse=True)
    have = 1
    n = len(tokens)
    while have < depth:
        step = min(have, depth - have)
        second = np.full(n, -1, dtype=np.int64)
        second[: n - step] = rank[step:]
        order = np.lexsort((second, rank))
        new = np.ones(n, dtype=np.int64)
        new[0] = 0
        a, b = order[1:], order[:-1]
        new[1:] = (rank[a] != rank[b]) | (second[a] != second[b])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(new)
        have += step
    return rank


def joined_streams(streams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of the texts in one array, the text of each, and the places that begin a run inside their text."""
    lengths = np.array([len(s) for s in streams])
    # A mark of its own ends each text, so no run spans two.
    joined = np.concatenate([x for i, s in enumerate(streams) for x in (s.view(np.int64) >> 2, np.array([-(2**62) - i]))])
    owner = np.repeat(np.arange(len(streams)), lengths + 1)
    place = np.arange(len(joined)) - np.repeat(np.cumsum(lengths + 1) - lengths - 1, lengths + 1)
    return joined, owner, np.flatnonzero(place + RUN <= lengths[owner])


def run_keys(joined: np.ndarray, start: np.ndarray) -> np.ndarray:
    """64-bit hash of the run that begins at each of the places."""
    run = np.zeros(len(start), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(RUN):
            run = mix(run * np.uint64(0x9E3779B97F4A7C15) + joined[start + i].view(np.uint64))
    return run.view(np.int64)


def coarse(stream: np.ndarray) -> np.ndarray:
    """Tokens told apart by 16 bits of their hash, enough to propose runs: equal runs stay equal."""
    return (stream & np.uint64(0xFFFF)) << np.uint64(2)


def hashes_of(texts: pd.Series) -> list[np.ndarray]:
    memo = WordHashes()
    return [memo.of(t.split()) for t in texts]


@F.pandas_udf(T.BinaryType())
def codes(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Two bytes for a token."""
    memo = WordHashes()
    for batch in texts:
        yield batch.map(lambda t: memo.of(t.split()).astype("<u2").tobytes())


def _candidates(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Coarse runs of a shard as (host, run) that reach their share of its texts; ``need`` is the host's number."""
    joined, owner, start = joined_streams([coarse(np.frombuffer(c, "<u2").astype(np.uint64)) for c in rows["codes"]])
    if not len(start):
        return pd.DataFrame({"host": [], "run": []}, dtype="int64")
    rank = suffix_ranks(joined, RUN)[start]
    order = np.lexsort((owner[start], rank))
    r, p = rank[order], owner[start][order]
    new = np.append(True, r[1:] != r[:-1])
    first = np.flatnonzero(new)
    held = np.add.reduceat((new | np.append(True, p[1:] != p[:-1])).astype(np.int64), first)
    # A rounding error may only let a run through, which is counted again.
    good = held >= rows["need"].iloc[0] * len(rows) / rows["texts"].iloc[0] - 1e-6
    return pd.DataFrame({"host": key[0], "run": run_keys(joined, start[order][first[good]])})


def _holders(key: tuple, rows: pd.DataFrame, sought: pd.DataFrame) -> pd.DataFrame:
    """Texts of a shard that hold each run behind the sought coarse ones, as (host, run, held)."""
    if not len(rows) or not len(sought):
        return pd.DataFrame({"host": [], "run": [], "held": []}, dtype="int64")
    streams = hashes_of(rows["text"])
    joined, owner, start = joined_streams(streams)
    start = start[np.isin(run_keys(joined_streams([coarse(s) for s in streams])[0], start), sought["run"].to_numpy())]
    held = pd.DataFrame({"run": run_keys(joined, start), "owner": owner[start]}).drop_duplicates().groupby("run").size()
    return pd.DataFrame({"host": key[0], "run": held.index.to_numpy(), "held": held.to_numpy()})


def _marks(key: tuple, rows: pd.DataFrame, sought: pd.DataFrame) -> pd.DataFrame:
    """Rows with the places at which boilerplate runs begin, as (row, starts)."""
    if not len(rows) or not len(sought):
        return pd.DataFrame({"row": np.zeros(0, np.int64), "starts": np.zeros(0, object)})
    joined, owner, start = joined_streams(hashes_of(rows["text"]))
    found = start[np.isin(run_keys(joined, start), sought["run"].to_numpy())]
    begins = np.searchsorted(owner, np.arange(len(rows)))
    at = pd.Series(found - begins[owner[found]]).groupby(rows["row"].to_numpy()[owner[found]]).agg(list)
    return pd.DataFrame({"row": at.index.to_numpy(), "starts": at.to_numpy(object)})


def repeated_runs(parsed: DataFrame, shard_tokens: int = SHARD_TOKENS) -> DataFrame | None:
    """(row, starts) of the rows of ``parsed`` that hold boilerplate runs; None if no host has any."""
    whole = F.concat(F.coalesce("article", F.array().cast("array<string>")), "loose", "around")
    hosted = parsed.filter("host is not null")
    first = F.min(F.struct("rest", "row", "total")).alias("first")
    texts = stage(hosted.groupBy("host", "page").agg(first, F.sum("total").alias("all_total"), F.count("*").alias("n")), "page_texts")
    sizes = texts.groupBy("host").agg(F.sum("first.total").alias("total"), F.sum("all_total").alias("all_total"), F.count("*").alias("texts"))
    shards = F.greatest(F.lit(1), F.least(F.ceil(F.col("total") / shard_tokens), F.floor(F.col("texts") / SHARD_TEXTS)))
    pieces = F.greatest(F.lit(1), F.ceil(F.col("all_total") / shard_tokens))
    need = F.greatest(F.lit(float(LEAST)), F.col("texts") * SHARE)
    # A host of fewer texts has no boilerplate.
    hosts = sizes.filter(F.col("texts") >= LEAST).select("host", "texts", need.alias("need"), shards.alias("shards"), pieces.alias("pieces"))
    hosts = stage(hosts, "page_hosts")
    copies = hosted.select("host", "page", "row").join(texts.filter("n > 1").select("host", "page", "first"), ["host", "page"])
    copies = stage(copies.filter("row <> first.row").select("row"), "page_copies")
    text = F.array_join(whole, " ").alias("text")
    dealt = hosted.join(hosts, "host").join(copies, "row", "left_anti")
    dealt = dealt.select("host", F.pmod("page", "shards").alias("shard"), text, "need", "texts")
    local = dealt.select("host", "shard", codes("text").alias("codes"), "need", "texts").groupBy("host", "shard")
    sought = stage(local.applyInPandas(_candidates, "host long, run long"), "page_candidates").distinct()
    if sought.isEmpty():
        return None
    each = sought.join(hosts, "host").select("host", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "run")
    mine = dealt.join(sought.select("host").distinct(), "host", "left_semi").groupBy("host", "shard")
    held = mine.cogroup(each.groupBy("host", "shard")).applyInPandas(_holders, "host long, run long, held long")
    runs = held.groupBy("host", "run").agg(F.sum("held").alias("held")).join(hosts, "host").filter("held >= need").select("host", "run")
    runs = stage(runs, "page_runs")
    if runs.isEmpty():
        return None
    each = runs.join(hosts, "host").select("host", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), "run")
    mine = hosted.join(hosts, "host").join(runs.select("host").distinct(), "host", "left_semi")
    mine = mine.select("host", F.pmod(F.xxhash64("row"), "pieces").alias("piece"), "row", text)
    return mine.groupBy("host", "piece").cogroup(each.groupBy("host", "piece")).applyInPandas(_marks, "row long, starts array<long>")


def extract(pages: DataFrame, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """page_id, url, text, n_chars, n_repeated (tokens that boilerplate runs cover) of every row of ``pages``."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    parsed = rows.mapInArrow(parse, PARSED).withColumn("row", F.monotonically_increasing_id())
    path = fresh_path(pages.sparkSession, "pages_parsed")
    parsed.write.option("compression", "zstd").parquet(path)
    parsed = pages.sparkSession.read.schema(parsed.schema).parquet(path)

    starts = repeated_runs(parsed, shard_tokens)

    @F.pandas_udf("struct<text string, n_repeated long>")
    def finish(article: pd.Series, loose: pd.Series, around: pd.Series, starts: pd.Series) -> pd.DataFrame:
        out = []
        for inside, parts, rest, at in zip(article, loose, around, starts, strict=True):
            main = [x.split() for x in (inside if inside is not None else ())]
            words = [w for x in parts for w in x.split()]
            first = sum(map(len, main))
            total = first + len(words) + sum(len(x.split()) for x in rest)
            covered = np.zeros(total + 1, dtype=np.int64)
            if at is not None and len(at):
                np.add.at(covered, np.asarray(at), 1)
                np.add.at(covered, np.asarray(at) + RUN, -1)
            covered = covered.cumsum()[:total] > 0
            if inside is not None:
                ends = np.cumsum([0, *map(len, main)])
                kept = [x for x, lo, hi in zip(inside, ends, ends[1:]) if not covered[lo:hi].all()]
                text = " ".join(kept or inside)
            else:
                text = " ".join(w for w, c in zip(words, covered, strict=False) if not c) or " ".join(words)
            out.append((text, int(covered.sum())))
        return pd.DataFrame(out, columns=["text", "n_repeated"])

    marked = parsed.withColumn("starts", F.lit(None).cast("array<long>")) if starts is None else parsed.join(stage(starts, "page_marks"), "row", "left")
    done = marked.select("page_id", "url", finish("article", "loose", "around", "starts").alias("x"))
    return done.select("page_id", "url", "x.text", F.length("x.text").cast("long").alias("n_chars"), "x.n_repeated")
