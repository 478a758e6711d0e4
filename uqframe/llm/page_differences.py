"""Main text of pages by differences between pages of nearest URL.

A page is read as lines: the text of each block, with the place of the block (the names and classes
of the elements around it) and its zone. Pages are ranked by host and URL path, so that pages of
near paths are neighbours, in blocks that share a few rows at their edges. Each page is aligned
with the ``2 * reach`` pages nearest to it on its host: the longest common subsequence of their lines,
where the k-th occurrence of a line only matches the k-th one on the other page. A pair that
shares most of its text is a pair of copies and says nothing about the host's frame. Lines that an
alignment shares are deleted; and where most lines of a place are shared, over all pages of the
host, all lines of that place are.

Zones say how far that rule goes. Menus, headers, footers, asides, forms, adverts, notices and
comments, which elements, roles or class names mark as such, are deleted without it: the ones of a host may differ
from page to page (the README has figures). Inside ``article`` and ``main`` a line is deleted only
by its place, as a passage that many articles hold is part of them; and on a page with such an
element, nothing outside it belongs to the article.

Defined results: one row per row of the table; null and empty pages, and pages without text, have
an empty text; a null URL is a host of its own; a tag, comment or script that the page's end cuts
off is markup; repeated rows get equal texts; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uqframe.llm.common import arrow_schema, hash64, map_rows, slices
from uqframe.operators.skew import attach, fits
from uqframe.operators.splits import ranked
from uqframe.sources.session import cut_lineage

OPEN, MAIN, FRAME = 0, 1, 2


@dataclass(frozen=True)
class Settings:
    reach: int = 8  # pages on either side
    copy_share: float = 0.6  # of the shorter page's text
    open_share: float = 0.5  # shared lines of a place outside article and main
    main_share: float = 0.9  # and inside
    least_lines: int = 20
    block_rows: int = 512


# fixed values: names of the markup language, and class names that pages use for their frames
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav "
    "ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split())
RAW = "script style title textarea xmp iframe noembed noframes"
UNSEEN = frozenset("template svg math object canvas audio video select datalist noscript button head".split())
FRAME_ELEMENTS = frozenset("nav footer aside form dialog menu search header".split()) | UNSEEN
FRAME_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog".split())
FRAME_CLASSES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login "
    "sidebar aside widget nav navbar navigation menu breadcrumb breadcrumbs pager pagination toolbar "
    "footer header masthead topbar copyright comment comments commentlist respond replies disqus "
    "share sharing social related recommended popup modal overlay form search skip".split())
ENDS = {"li": "ul ol menu dir", "tr": "table", "dt": "dl", "dd": "dl", "option": "select datalist"}

_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)
    |<(?P<raw>{RAW.replace(' ', '|')})(?=[\s/>]).*?(?:</(?P=raw)\s*>|\Z)
    |<(?P<close>/?)(?P<name>[a-z][^\s/>]*)
      (?P<rest>(?:[^<>"']|"(?:[^"<]|<(?![a-z/!]))*"|'(?:[^'<]|<(?![a-z/!]))*')*+)>
    |<(?P<close2>/?)(?P<name2>[a-z][^\s/>]*)(?P<rest2>[^<>]*)>
    |<[!?/][^>]*(?:>|\Z)
    |<[a-z][^>]*\Z""", re.S | re.I | re.X)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")


def _zone(name: str, rest: str, zone: int) -> tuple[int, str]:
    """Zone of an element inside a zone, and its class without digits."""
    values = {}
    if "=" in rest or "hidden" in rest:
        for key, value in _ATTRIBUTE.findall(rest):
            values[key.lower()] = value.strip("\"'").lower()
    own = _DIGITS.sub("0", values.get("class", ""))
    if zone == FRAME:
        return FRAME, own
    if "hidden" in values or values.get("aria-hidden") == "true":
        return FRAME, own
    if name in ("article", "main") or values.get("role") in ("main", "article"):
        return MAIN, own
    if name in ("html", "body"):
        return zone, own
    named = set(_WORD.findall(own)) | set(_WORD.findall(values.get("id", "")))
    if zone == MAIN:  # an article's own header holds its title
        named.discard("header")
    if (name in FRAME_ELEMENTS and not (name == "header" and zone == MAIN)
            or values.get("role") in FRAME_ROLES or named & FRAME_CLASSES):
        return FRAME, own
    return zone, own


def page_lines(html: str) -> tuple[list[str], list[int], list[int]]:
    """Text, place (a hash) and zone of every block of a page that holds text, in order."""
    texts, places, zones = [], [], []
    held: list[str] = []
    stack: list[tuple[str, int, int]] = [("", 0, OPEN)]
    opened: dict[str, int] = {}

    def close(k: int):
        for name, _, _ in stack[k:]:
            opened[name] -= 1
        del stack[k:]

    def flush():
        text = " ".join("".join(held).split()) if held else ""
        held.clear()
        if text:
            texts.append(text)
            places.append(stack[-1][1])
            zones.append(stack[-1][2])

    def hold(text: str):
        if stack[-1][2] != FRAME or not text.isspace():
            held.append(unescape(text) if "&" in text else text)

    at = 0
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            hold(html[at:m.start()])
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if name == "br":
            held.append(" ")
        if name in ("td", "th"):
            held.append(" ")
        if name not in BLOCKS and name not in UNSEEN:
            continue
        flush()
        if m["close"] or m["close2"]:
            if opened.get(name):
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name))
            continue
        if name == "hr":
            continue
        if stack[-1][0] == "p":
            close(len(stack) - 1)
        same = {"dt", "dd"} if name in ("dt", "dd") else {name}
        if name in ENDS and any(opened.get(n) for n in same):  # an item ends the one before it
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ENDS[name].split():
                    break
                if stack[k][0] in same:
                    close(k)
                    break
        rest = m["rest"] or m["rest2"] or ""
        if rest.endswith("/") and name in UNSEEN:
            continue
        zone, own = _zone(name, rest, stack[-1][2])
        place = xxhash.xxh3_64_intdigest(f"{name}.{own}".encode(), stack[-1][1])
        stack.append((name, place, zone))
        opened[name] = opened.get(name, 0) + 1
    if at < len(html):
        hold(html[at:])
    flush()
    return texts, places, zones


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def numbered(hashes: list[int]) -> dict[tuple[int, int], int]:
    """(line, which occurrence of it) -> place in the page."""
    seen: dict[int, int] = {}
    out = {}
    for at, h in enumerate(hashes):
        k = seen.get(h, 0)
        seen[h] = k + 1
        out[h, k] = at
    return out


def common_lines(a: dict[tuple[int, int], int], b: dict[tuple[int, int], int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``: as no element repeats, it is the
    longest rising run of places in ``b``."""
    if len(b) < len(a):
        met = sorted((a[key], place) for key, place in b.items() if key in a)
    else:
        met = [(place, b[key]) for key, place in a.items() if key in b]
    tails, last, before = [], [], []
    for k, (_, there) in enumerate(met):
        at = bisect_left(tails, there)
        before.append(last[at - 1] if at else -1)
        tails[at:at + 1] = [there]
        last[at:at + 1] = [k]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(met[k][0])
        k = before[k]
    return out[::-1]


PARSED = ("page_key long, host string, path string, lines array<long>, sizes array<int>, "
          "places array<long>, zones array<int>")
ALIGNED = ("page_key long, host string, shared array<int>, places array<long>, zones array<int>, "
           "n array<long>, n_shared array<long>")


def _key(html: Column, url: Column) -> Column:
    """A number of a page's contents: rows with the same URL and page get the same result."""
    return F.xxhash64(url, html)


def _parse(part: pa.RecordBatch) -> dict:
    out = {c: [] for c in ("page_key", "host", "path", "lines", "sizes", "places", "zones")}
    for key, host, path, html in zip(*(part[c].to_pylist() for c in ("page_key", "host", "path", "html"))):
        texts, places, zones = page_lines(html)
        out["page_key"].append(key)
        out["host"].append(host)
        out["path"].append(path)
        out["lines"].append([_signed(hash64(t.encode("utf-8", "surrogatepass"))) for t in texts])
        out["sizes"].append([len(t) for t in texts])
        out["places"].append([_signed(p) for p in places])
        out["zones"].append(zones)
    return out


def _align(s: Settings, kind: pa.Schema):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["rank"])
        for r in rows:
            r["at"] = numbered(r["lines"])
            r["size"] = sum(r["sizes"])
        out = {c: [] for c in kind.names}
        for k, page in enumerate(rows):
            if page["rank"] // s.block_rows != page["block"]:
                continue  # a row from over the edge
            shared, alone = set(), True
            for other in rows[max(0, k - s.reach):k + s.reach + 1]:
                if other is page or other["host"] != page["host"]:
                    continue
                met = common_lines(page["at"], other["at"])
                if sum(page["sizes"][at] for at in met) >= s.copy_share * min(page["size"], other["size"]):
                    continue
                alone = False
                shared.update(met)
            facts: dict[tuple[int, int], list[int]] = {}
            if not alone:
                for at, slot in enumerate(zip(page["places"], page["zones"])):
                    n = facts.setdefault(slot, [0, 0])
                    n[0] += 1
                    n[1] += at in shared
            main = MAIN in page["zones"]
            wanted = {slot: n for slot, n in facts.items() if slot[1] == (MAIN if main else OPEN)}
            out["page_key"].append(page["page_key"])
            out["host"].append(page["host"])
            out["shared"].append(sorted(at for at in shared if not main and page["zones"][at] == OPEN))
            out["places"].append([slot[0] for slot in wanted])
            out["zones"].append([slot[1] for slot in wanted])
            out["n"].append([n[0] for n in wanted.values()])
            out["n_shared"].append([n[1] for n in wanted.values()])
        return pa.Table.from_pydict(out, schema=kind)

    return run


def _marks(read: DataFrame, s: Settings) -> DataFrame:
    """(page_key, shared, frame): the lines of a page that an alignment shares and that are not
    protected, and the places whose lines are deleted; pages that lose nothing have no row."""
    pages = map_rows(read.select("page_key", "host", "path", "html"), _parse, PARSED).dropDuplicates(["page_key"])
    pages = ranked(pages, F.col("host"), F.col("path"), F.col("page_key"))
    block = F.floor(F.col("rank") / s.block_rows)
    near = F.array_distinct(F.array(
        block, F.greatest(F.floor((F.col("rank") - s.reach) / s.block_rows), F.lit(0).cast("bigint")),
        F.floor((F.col("rank") + s.reach) / s.block_rows)))
    blocks = pages.withColumn("block", F.explode(near))
    aligned = blocks.groupBy("block").applyInArrow(_align(s, arrow_schema(ALIGNED)), ALIGNED)
    aligned = cut_lineage(aligned, "aligned")
    slots = F.explode(F.arrays_zip("places", "zones", "n", "n_shared")).alias("slot")
    slots = aligned.select("page_key", "host", slots).select("page_key", "host", "slot.*")
    share = F.when(F.col("zones") == MAIN, F.lit(s.main_share)).otherwise(F.lit(s.open_share))
    frames = slots.groupBy("host", "places").agg(F.sum("n").alias("n"), F.sum("n_shared").alias("n_shared"),
                                                 F.min(share).alias("share"))
    frames = frames.where((F.col("n") >= s.least_lines) & (F.col("n_shared") >= F.col("share") * F.col("n")))
    frames = frames.select("host", "places")
    framed = attach(slots.select("page_key", "host", "places"), frames, ["host", "places"], "inner",
                    bounded=fits(frames))
    own = framed.select("page_key", F.lit(None).cast("array<int>").alias("shared"),
                        F.array("places").alias("places"))
    lines = aligned.where(F.size("shared") > 0).select(
        "page_key", "shared", F.array().cast("array<bigint>").alias("places"))
    return own.unionByName(lines).groupBy("page_key").agg(  # the places of one page
        F.max("shared").alias("shared"), F.flatten(F.collect_list("places")).alias("frame"))


TEXTS = "page_id long, url string, text string, n_chars long"


def main_text(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(page_id, url, text, n_chars): the article of every page, blocks joined by two ``\\n``."""
    s = settings
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rest = F.regexp_replace(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://|#.*$", "")
    read = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        html.alias("html"), F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)).alias("host"),
        F.regexp_replace(rest, r"^[^/?]*", "").alias("path"), _key(html, F.col("url")).alias("page_key"))
    marks = cut_lineage(_marks(read, s), "marks")
    marked = attach(read.select("page_id", "url", "html", "page_key"), marks, ["page_key"],
                    bounded=fits(marks), salted=False)
    kind = arrow_schema(TEXTS)

    def finish(batches):
        for part in slices(batches):
            out = []
            for html, shared, frame in zip(*(part[c].to_pylist() for c in ("html", "shared", "frame"))):
                out.append("\n\n".join(kept_lines(html, set(shared or ()), set(frame or ()))))
            yield pa.RecordBatch.from_arrays(
                [part["page_id"], part["url"].cast(kind.field("url").type), pa.array(out, kind.field("text").type),
                 pa.array([len(t) for t in out], pa.int64())], schema=kind)

    return marked.mapInArrow(finish, TEXTS)


def kept_lines(html: str, shared: set[int], frame: set[int]) -> list[str]:
    texts, places, zones = page_lines(html)
    wanted = MAIN if MAIN in zones else OPEN
    return [t for at, (t, place, zone) in enumerate(zip(texts, places, zones))
            if zone == wanted and at not in shared and _signed(place) not in frame]

