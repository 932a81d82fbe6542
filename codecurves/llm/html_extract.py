"""Main text of web pages by nearest-URL page differencing.

A page's blocks are its text lines. Pages are put in order of host and URL path; each is aligned with its nearest different neighbour on the
same host by the longest common subsequence of their lines, and lines that both have are deleted as the site's furniture. Two rules of
HTML guard the comparison. Lines inside an article or main element are the page's own even where a neighbour repeats them: deleting them
would lose text from copies and from passages that pages share. Lines inside an element that says itself that it is furniture (menus,
forms, adverts ...) go even where no neighbour has them. All other lines are decided by the comparison alone.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_ROWS, stored
from .url_filters import host_of, path_of

_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_FURNITURE = re.compile(
    r"(?:^|[\s_]|(?<!with)(?<!has)(?<!no)-)(ad|ads|advert|adverts|advertisement|adsense|sponsor|sponsored|promo|banner|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|aside|"
    r"complementary|footer|contentinfo|header|masthead|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|signup|"
    r"login|search|form|share|social|related|recommended|comments?|disqus|replies|reply|widget|toolbar|pagination|pager|skip)(?:$|[\s_-])",
    re.I,
)
_COMMENTS = re.compile(r"comment|disqus|repl(?:y|ies)", re.I)
#: Inside an article only a block whose class, id or role is one of these words is furniture. Fixed values.
INNER_FURNITURE = frozenset("ad ads advert adverts advertisement adsense sponsored nav navbar navigation menu breadcrumb breadcrumbs sidebar footer contentinfo newsletter cookie-notice comments comment-list comments-area disqus_thread replies".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
#: Elements without text of the page, and elements that are furniture.
MUTE = frozenset("head script style noscript template iframe svg math canvas object select textarea title audio video map datalist".split())
DROPPED = frozenset("nav footer aside form button dialog menu fieldset".split())
#: Of those, the ones that some sites put around the whole page: an article inside them is the page's.
WRAPPERS = frozenset("form fieldset".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
#: An open element of the first kind is closed by the start of one of the second.
CLOSES = {"p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}


#: Kinds of lines: inside furniture by its own element, free, inside an article or main element.
NAMED, FREE, OWN = range(3)


def _attributes(text: str) -> dict[str, str]:
    return {name.lower(): a or b or c for name, a, b, c in _ATTRIBUTE.findall(text)}


def _why_gone(name: str, attributes: dict[str, str], within: bool) -> str:
    """Why an element's text is not the page's: "mute" (no text at all), "element", "wrapper", "comments" or "name" (furniture); or ''.
    within: it stands inside an article or main element."""
    if name in MUTE or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or _HIDDEN_STYLE.search(attributes.get("style", "")):
        return "mute"
    if name in DROPPED or (name == "header" and not within):
        return "wrapper" if name in WRAPPERS and not within else "element"
    if name in ("article", "main", "html", "body"):
        return ""
    named = " ".join(attributes.get(k, "") for k in ("class", "id", "role", "aria-label")).strip()
    if not named:
        return ""
    if within:
        why = name not in INLINE and INNER_FURNITURE.intersection(named.lower().split())
    else:
        why = _FURNITURE.search(named)
    return ("comments" if _COMMENTS.search(named) else "name") if why else ""


def lines(page: str | None, holders: tuple[str, ...] = ("name", "wrapper")) -> list[tuple[str, int]]:
    """(line, kind) of each block, in page order. An article or main element is the page's own also inside furniture that is so for one of
    the reasons in `holders`; where a page has none but inside other furniture (an aside, say), that one is."""
    page = page or ""
    out: list[tuple[str, int]] = []
    hidden = False
    stack: list[tuple[str, str, bool]] = []  # name, why its text is not the page's, whether inside article or main
    text: list[str] = []
    state = ("", False)

    def end():
        if text:
            line = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if line:
                out.append((line, NAMED if state[0] else OWN if state[1] else FREE))

    at = 0
    while True:
        m = _MARK.search(page, at)
        stop = m.start() if m else len(page)
        if stop > at and state[0] != "mute":
            text.append(page[at:stop])
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in INLINE:
            if name in ("br", "wbr", "img"):
                text.append(" " if name == "br" else "")
                continue
        else:
            end()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if name not in INLINE or all(s[0] in INLINE for s in stack[k:]):
                        if any(s[1] for s in stack[k:]):
                            end()
                        del stack[k:]
                    break
        elif name not in VOID and not m[3].endswith("/"):
            while stack and name in CLOSES.get(stack[-1][0] if stack[-1][0] not in INLINE else "", ()):
                stack.pop()
            if name not in INLINE:
                while stack and stack[-1][0] in INLINE:  # an inline element left open ends with its block
                    stack.pop()
                while stack and name in CLOSES.get(stack[-1][0], ()):
                    stack.pop()
            outer, within = stack[-1][1:] if stack else ("", False)
            attributes = _attributes(m[3]) if m[3].strip() else {}
            main = name in ("article", "main") or "main" in attributes.get("role", "").lower().split()
            hidden |= main and outer == "element"
            gone = "" if main and outer in holders else outer  # a wrapper named after the site's furniture may hold the article
            gone = gone or _why_gone(name, attributes, within)
            if gone and not outer:
                end()
            stack.append((name, gone, within or main))
            if name in RAW:
                closing = RAW[name].search(page, at)
                at = closing.start() if closing else len(page)
        state = stack[-1][1:] if stack else ("", False)
    end()
    if hidden and "element" not in holders and not any(kind == OWN for _, kind in out):
        return lines(page, (*holders, "element"))
    return out


def common_lines(a: list[int], b: list[int]) -> list[bool]:
    """Which of a's lines stand in one longest common subsequence with b (bit-parallel rows, walked back)."""
    n, m, head = len(a), len(b), 0
    while head < n and head < m and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < n - head and tail < m - head and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    shared = [True] * head + [False] * (n - head - tail) + [True] * tail
    own, other = a[head : n - tail], b[head : m - tail]
    if own and other:
        width, where = len(other), {}
        for j, x in enumerate(other):
            where[x] = where.get(x, 0) | 1 << j
        full, row, rows = (1 << width) - 1, (1 << width) - 1, []
        for x in own:
            both = row & where.get(x, 0)
            row = ((row + both) | (row - both)) & full
            rows.append(row)
        j = width - 1
        for i in range(len(own) - 1, -1, -1):
            # zeros of a row up to j count the subsequence's length; it is shorter a row above only where own[i] is matched
            above = rows[i - 1] if i else full
            upto = (1 << (j + 1)) - 1
            if j >= 0 and (~rows[i] & upto).bit_count() > (~above & upto).bit_count():
                while j >= 0 and other[j] != own[i]:
                    j -= 1
                shared[head + i] = True
                j -= 1
    return shared


def furniture(own: list[int], kinds: list[int], other: list[int]) -> list[int]:
    """Indexes of free lines that the neighbour has too; none if the page would be left without any text."""
    free = [i for i, k in enumerate(kinds) if k == FREE]
    if not free:
        return []
    shared = common_lines(own, other)
    gone = [i for i in free if shared[i]]
    return gone if len(gone) < len(free) or OWN in kinds else []


def _shared_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _with_lines(pages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                got = [lines(t.as_py()) for t in part.column(4)]
                hashes = [[np.uint64(xxhash.xxh64_intdigest(x)).view(np.int64).item() for x, _ in g] for g in got]
                whole = [np.uint64(xxhash.xxh64_intdigest(np.array(h, np.int64).tobytes())).view(np.int64).item() for h in hashes]
                made = [pa.array(hashes, pa.list_(pa.int64())), pa.array([[k for _, k in g] for g in got], pa.list_(pa.int8())), pa.array(whole, pa.int64())]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(4)), *made], names=["key", "host", "path", "url", "hashes", "kinds", "whole"])

    return pages.select("key", "host", "path", "url", "html").mapInArrow(run, "key long, host string, path string, url string, hashes array<long>, kinds array<byte>, whole long")


class _Around:
    """The nearest rows of other content before the first row and behind the last row of a range: what is known at its ends."""

    def __init__(self, ends: dict[int, list]):
        # ends: by range, its rows in order that stand at an end or next to a row of other content (first, second kind, ..., last)
        self.before: dict[int, list] = {}
        self.after: dict[int, list] = {}
        parts = sorted(ends)
        held: list = []
        for p in parts:
            self.before[p] = held
            held = self._two([*held, *ends[p]][::-1])[::-1]
        held = []
        for p in reversed(parts):
            self.after[p] = held
            held = self._two([*ends[p], *held])

    @staticmethod
    def _two(rows: list) -> list:
        """The first row, and the first of other content than its."""
        out: list = []
        for r in rows:
            if not out or (len(out) == 1 and r["whole"] != out[0]["whole"]):
                out.append(r)
        return out


def deletions(pages: DataFrame) -> DataFrame:
    """(key, gone): the lines of each page that its nearest neighbour of other content shares. pages: key, host, path, url, html.

    Rows of line hashes, without any text, are dealt out by range of host and path, so a host of any size spreads over tasks; of each range
    two rows at either end come to the driver, so that neighbours across a border, and past a run of copies, are seen as any others."""
    order = ["host", "path", "url", "key"]
    ranged = stored(_with_lines(pages).dropDuplicates(["key"]).repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "lines")
    place, row = F.struct(*order), F.struct("host", "path", "hashes", "whole")
    ends = ranged.groupBy("part").agg(F.min_by(row, place).alias("a"), F.max_by(row, place).alias("z"))
    inner = ranged.join(F.broadcast(ends.select("part", "a.whole", "z.whole").toDF("part", "wa", "wz")), "part")  # one row a range
    inner = inner.groupBy("part").agg(F.min_by(row, F.when(F.col("whole") != F.col("wa"), place)).alias("b"), F.max_by(row, F.when(F.col("whole") != F.col("wz"), place)).alias("y"))
    known = {r["part"]: [x for x in (r["a"], r["b"], r["y"], r["z"]) if x] for r in ends.join(inner, "part").collect()}
    around = _Around(known)

    def pair(got: pd.DataFrame) -> pd.DataFrame:
        got = got.sort_values(order, na_position="first")
        part = int(got["part"].iloc[0])
        rows = [{"host": h, "path": p, "hashes": x, "whole": w} for h, p, x, w in zip(got["host"], got["path"], got["hashes"], got["whole"], strict=True)]

        def nearest(rows: list, held: list) -> list:
            """For each row the nearest before it of other content; held: rows before the first, nearest first."""
            out, one, two = [], *[*held, None, None][:2]
            for r in rows:
                out.append(one if one is None or one["whole"] != r["whole"] else two)
                if one is None or one["whole"] != r["whole"]:
                    two = one
                one = r
            return out

        before = nearest(rows, around.before[part][::-1])
        after = nearest(rows[::-1], around.after[part])[::-1]
        gone = []
        for r, kinds, *near in zip(rows, got["kinds"], before, after, strict=True):
            near = [x for x in near if x is not None and x["host"] == r["host"]]
            best = max(near, key=lambda x: _shared_prefix(r["path"], x["path"]), default=None)  # of equals the one before
            gone.append(furniture(list(r["hashes"]), list(kinds), list(best["hashes"])) if best is not None else [])
        out = pd.DataFrame({"key": got["key"], "gone": gone})
        return out[out["gone"].str.len() > 0]

    return ranged.groupBy("part").applyInPandas(pair, "key long, gone array<int>")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (blocks joined by newlines, empty if none), n_chars (code points), one row for each row of pages.

    Null html is empty. A null or odd URL counts as host and path ''. Repeated rows are one page for the pairing; copies are passed over
    when a neighbour is sought. A page without article or main that shares all its lines with its neighbour, or has no neighbour of other
    content on its host, keeps those outside furniture. Other columns are ignored; an empty table gives no rows. Deletions reach the pages
    by a broadcast if they are few (checked), else by a join on the page's key."""
    keyed = pages.select("page_id", "url", "html", F.xxhash64("page_id", "url", "html").alias("key"))
    gone = stored(deletions(keyed.select("key", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.coalesce("url", F.lit("")).alias("url"), "html")), "deletions")
    few = gone.select(F.count("*").alias("n"), F.coalesce(F.sum(F.size("gone")), F.lit(0)).alias("m")).first()
    own = keyed.join(F.broadcast(gone) if few["n"] + few["m"] <= MAX_BROADCAST_ROWS else gone, "key", "left")
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                texts = []
                for page, drop in zip(part.column(2), part.column(3), strict=True):
                    skip = set(drop.as_py() or ())
                    texts.append("\n".join(x for i, (x, k) in enumerate(lines(page.as_py())) if i not in skip and k != NAMED))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    out = own.select("page_id", "url", "html", "gone").mapInArrow(run, f"page_id {kind}, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
