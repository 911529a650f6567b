"""Main text of web pages by wrappers: union-free regular expressions that are
inferred from the token streams of pages of the same host.

1. A page becomes a tree (comments, scripts, styles and the like gone, implied
   end tags added) and its *outline*: the token stream of block elements and
   text slots in which repeated neighbouring groups are folded to ``(...)+``.
   On pages without an article or main element a text that most such pages of
   the host hold at the same place is a token of its own, no slot.
2. Distinct outlines of a host are aligned one after the other: equal tokens
   stay; where one stream has a group that the other repeats, the group becomes
   a repetition; tokens that only one stream has become optional ``(...)?``.
   The result, the host's wrapper, accepts all outlines it was made from.
   Pages are reduced to distinct outlines with their text masses before the
   shuffle, and a host's outlines are aligned in groups of about ``FAN``, the
   groups' wrappers in groups again and so on, so a host that holds a third of
   all pages is neither gathered nor aligned in one task.
3. Text slots hang below *regions* (the elements around them that hold
   several blocks).  Regions whose tags or class names say menu, header,
   footer, sidebar, notice, advert, form or comments are left out, unless such
   a name or form is around the article or most of the page.
4. Each page is read by its host's wrapper.  With an article or main element:
   all blocks below the host's region, in page order - the article or main
   element with most text outside links over the host; a page without that
   region is read by its own best one.  Without one: the texts of all slots,
   that is of every block that is no constant of the wrapper, but for regions
   that are links for the most part.

Elements left open before the main text (buttons, icons, objects) lose their
tag only; scripts, styles, titles, text areas and frames run to the end.

Character references are decoded and white space inside a block becomes one
space; blocks are joined by an empty line.  Line breaks inside a block are
white space.

Defined results: null or empty html, and pages of excluded parts alone, give
empty text; a null or unreadable url is a host of its own (the empty one);
repeated rows are read alike; other columns pass through untouched.
"""

from __future__ import annotations

import bisect
import difflib
import hashlib
import html as html_lib
import re
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketframe.llm.common import materialise

# Kinds of HTML elements.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i",
          "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong",
          "sub", "sup", "time", "tt", "u", "var"}
#: Elements of plain text, which run to the end of the page if left open.
RAW = ("script", "style", "textarea", "title", "iframe")
#: Elements left out with what they hold; left open, only their tag goes.
INERT = ("noscript", "template", "select", "svg", "math", "object", "canvas", "audio", "video", "button")
NESTING = {"template", "svg", "math", "object"}
LEFT_OUT_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset"}
LEFT_OUT_NAMES = re.compile(
    r"(?:^|[-_\s])(?<!\bhas[-_])(?<!\bwith[-_])(?<!\bno[-_])(?<!\bwithout[-_])(?:ads?|adverts?|advertisement|advertising|banner|sponsor(?:ed)?|promo(?:tion)?|cookies?|consent|"
    r"gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|signup|login|sidebar|side|widget|nav|navbar|"
    r"navigation|menu|breadcrumbs?|pagination|pager|header|masthead|footer|foot|comments?|replies|reply|respond|"
    r"disqus|share|sharing|social|related|recommended|tags|search|toolbar|skip)(?:$|[-_\s])", re.I)
#: What readers wrote is left out even if it is most of a page.
READERS = re.compile(r"(?:^|[-_\s])(?:comments?|replies|reply|respond|disqus)(?:$|[-_\s])", re.I)
PARTS_OF_HEAD = {"html", "body"}
#: An open element of the first kind ends where one of the second opens.
CLOSED_BY = {"p": None, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"},
             "th": {"td", "th", "tr"}, "option": {"option"}}
LISTS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}

_ATTRIBUTES = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*"
_RAW = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(" + "|".join(RAW) +
                  r")(?=[\s/>])" + _ATTRIBUTES + r">.*?(?:</\1\s*>|\Z)", re.S | re.I)
_INERT = re.compile(r"<(/?)(" + "|".join(INERT) + r")(?=[\s/>])(" + _ATTRIBUTES + r")>", re.I)
_MAIN = re.compile(r"<(?:article|main)(?=[\s/>])", re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Outlines, or wrappers of the level below, that one task aligns (about).
FAN = 64
#: Least pages that hold a constant of a wrapper; also more than half of the host's.
CONSTANT = 3


def _without_inert(page: str) -> str:
    """``page`` without inert elements.  One that is left open, or that would
    take an article or main element along, loses its tags only."""
    mains = [m.start() for m in _MAIN.finditer(page)]
    stack: list[tuple[str, int]] = []
    held: Counter = Counter()
    cuts = []
    for m in _INERT.finditer(page):
        tag = m[2].lower()
        cuts.append((m.start(), m.end()))
        if not m[1]:
            if tag in ("svg", "math") and m[3].endswith("/"):
                continue
            stack.append((tag, m.start()))
            held[tag] = held[tag] + 1 if tag in NESTING else 1  # the earlier one stays open
        elif held[tag]:
            while True:
                name, start = stack.pop()
                held[name] = held[name] - 1 if name in NESTING else 0
                if name == tag:
                    break
            if tag in ("noscript", "template") or bisect.bisect(mains, start) == bisect.bisect(mains, m.end()):
                cuts.append((start, m.end()))
    out, at = [], 0
    for start, end in sorted(cuts):
        if start >= at:
            out += [page[at:start], " "]
        at = max(at, end)
    return "".join(out) + page[at:] if cuts else page


@dataclass
class LeftOut:
    """An element to leave out: whether for its tag alone or as readers' words
    (``always``), whether other containers lie in it, its text outside links."""
    always: bool
    holds: bool = False
    chars: int = 0


class Blocks:
    """A page's text blocks and outline."""

    def __init__(self, page: str | None):
        self.blocks: list[tuple[tuple[str, ...], bool, str, int]] = []  # path, left out, text, link characters
        self.outline: list[str] = []
        self.keys: list[int] = []  # place and text of each block
        self._slots: list[int] = []  # where it is in the outline
        self._stack: list[tuple[str, str, LeftOut | None]] = []  # tag, token, left out
        self._found: list[tuple[tuple[str, ...], list[LeftOut], str, int]] = []
        self._mains: list[tuple[list[LeftOut], list[int]]] = []  # left out around it, its text outside links
        self._open_mains: list[tuple[int, list[int]]] = []  # depth, text
        self._text: list[str] = []
        self._links, self._in_link = 0, 0
        if isinstance(page, str) and page:
            self._read(_without_inert(_RAW.sub(" ", page)))
            self._leave_out()

    def _flush(self) -> None:
        text = " ".join(html_lib.unescape("".join(self._text)).split())
        if text:
            path = tuple(t for _, t, _ in self._stack)
            out = self._around()
            links = min(self._links, len(text))
            for o in out:
                o.chars += len(text) - links
            for _, chars in self._open_mains:
                chars[0] += len(text) - links
            self._found.append((path, out, text, links))
            key = hashlib.blake2b("/".join((*path, "", text)).encode("utf-8", "surrogatepass"), digest_size=8)
            self.keys.append(int.from_bytes(key.digest(), "big", signed=True))
            self._slots.append(len(self.outline))
            self.outline.append("#")
        self._text, self._links = [], 0

    def _around(self) -> list[LeftOut]:
        return [o for _, _, o in self._stack if o is not None]

    def _leave_out(self) -> None:
        """Blocks, with those left out marked.  Where no article or main
        element can be read otherwise, a name or form around the longest one
        does not count; without any, nor does one around other containers that
        holds most of the page's text."""
        ignored: list[LeftOut] = []
        if not any(chars[0] and not out for out, chars in self._mains):
            inside = [(chars[0], out) for out, chars in self._mains if chars[0] and not any(o.always for o in out)]
            if inside:
                ignored = max(inside, key=lambda x: x[0])[1]
            else:
                total = sum(len(text) - links for _, _, text, links in self._found)
                ignored = [o for _, out, _, _ in self._found for o in out
                           if not o.always and o.holds and 2 * o.chars > total]
        ids = {id(o) for o in ignored}
        self.blocks = [(path, any(id(o) not in ids for o in out), text, links) for path, out, text, links in self._found]

    def _open(self, tag: str, rest: str) -> None:
        names = " ".join(x for m in _NAMES.findall(rest) for x in m if x) if rest else ""
        token = tag + "".join("." + n for n in sorted(set(re.sub(r"\d+", "", names).split())))
        out = None
        if tag in LEFT_OUT_TAGS or (names and LEFT_OUT_NAMES.search(names) and tag not in PARTS_OF_HEAD):
            out = LeftOut((tag in LEFT_OUT_TAGS and tag != "form") or bool(READERS.search(names)))
        if not _LEAF.match(tag):
            for o in self._around():
                o.holds = True
        if tag in ("article", "main"):
            self._mains.append((self._around() + ([out] if out else []), [0]))
            self._open_mains.append((len(self._stack), self._mains[-1][1]))
        self._stack.append((tag, token, out))
        self.outline.append("<" + token)

    def _close_to(self, depth: int) -> None:
        while len(self._stack) > depth:
            self.outline.append("/" + self._stack.pop()[1])
        while self._open_mains and self._open_mains[-1][0] >= depth:
            self._open_mains.pop()

    def _read(self, page: str) -> None:
        at = 0
        for m in _TAG.finditer(page):
            if m.start() > at:
                self._add(page[at:m.start()])
            at = m.end()
            closing, tag, rest = m[1], m[2].lower(), m[3]
            if tag in INLINE:
                if tag == "a":
                    self._in_link = 0 if closing else 1
                continue
            if tag in VOID:
                self._text.append(" ")
                continue
            self._flush()
            tags = [t for t, _, _ in self._stack]
            if closing:
                if tag in tags:
                    self._close_to(len(tags) - 1 - tags[::-1].index(tag))
                continue
            if tags and tags[-1] == "p":  # any block ends a paragraph
                self._close_to(len(tags) - 1)
                tags.pop()
            for i in range(len(tags) - 1, -1, -1):
                if tags[i] in LISTS.get(tag, ()):
                    break
                if tag in (CLOSED_BY.get(tags[i]) or ()):
                    self._close_to(i)
                    break
            self._open(tag, rest)
        if at < len(page):
            rest = page[at:]
            cut = re.search(r"<[/a-zA-Z!][^>]*\Z", rest)  # a tag that the page breaks off in
            self._add(rest[:cut.start()] if cut else rest)
        self._flush()
        self._close_to(0)

    def _add(self, text: str) -> None:
        self._text.append(text)
        if self._in_link:
            self._links += len(text)

    def regions(self) -> dict[str, tuple[int, int]]:
        """Region: (characters outside links, blocks) of blocks not left out."""
        found: dict[str, list[int]] = {}
        for path, out, text, links in self.blocks:
            if not out:
                r = found.setdefault(region_of(path), [0, 0])
                r[0] += len(text) - links
                r[1] += 1
        return {k: (v[0], v[1]) for k, v in found.items()}

    def tokens(self, constants: frozenset[int]) -> list[str]:
        """The outline with constants as tokens of their own."""
        out = list(self.outline)
        for at, key in zip(self._slots, self.keys):
            if key in constants:
                out[at] = f'"{key & (1 << 64) - 1:016x}'
        return out

    def slots(self, constants: frozenset[int]) -> str:
        """The texts of all slots in regions that are not mostly links; the best
        region's if there is none."""
        links: Counter = Counter()
        for path, _, text, n in self.blocks:
            links[region_of(path)] += 2 * n - len(text)
        return "\n\n".join(text for (path, out, text, _), key in zip(self.blocks, self.keys)
                           if not out and key not in constants and links[region_of(path)] <= 0) \
            or self.text(best_region(self.regions()))

    def text(self, region: str | None) -> str:
        return "\n\n".join(t for path, out, t, _ in self.blocks
                           if not out and region is not None and below(path, region))


_LEAF = re.compile(r"^(?:p|h[1-6]|li|ul|ol|dl|dt|dd|blockquote|pre|table|tbody|thead|tfoot|tr|td|th|figure|"
                   r"figcaption|caption|center|address|details|summary|hgroup)(?:\.|$)")


def region_of(path: tuple[str, ...]) -> str:
    """The element around a block that is no paragraph, heading or list; an
    article or main element if there is one."""
    for i, t in enumerate(path):
        if t.split(".")[0] in ("article", "main"):
            return "/".join(path[:i + 1])
    end = len(path)
    while end and _LEAF.match(path[end - 1]):
        end -= 1
    return "/".join(path[:end])


def below(path: tuple[str, ...], region: str) -> bool:
    own = "/".join(path)
    return region == "" or own == region or own.startswith(region + "/")


def best_region(regions: dict[str, tuple[int, int]]) -> str | None:
    """Article or main first, then text outside links."""
    def rank(item):
        region, (chars, _) = item
        last = region.rpartition("/")[2].split(".")[0]
        return (last in ("article", "main") and chars > 0, chars, region)
    return max(regions.items(), key=rank)[0] if regions else None


# ---- outlines and wrappers: token lists whose groups are single tokens "(...)+" and "(...)?" ----
def fold(tokens: list[str]) -> list[str]:
    """Repeated neighbouring elements become one repetition, innermost first."""
    out: list[str] = []
    starts: list[int] = []
    for t in tokens:
        if t[0] == "<":
            starts.append(len(out))
        out.append(t)
        if t[0] == "/" and starts:
            at = starts.pop()
            unit = " ".join(out[at:])
            group = f"({unit})+"
            if at and out[at - 1] == group:
                del out[at:]
            elif at and "".join(out[max(0, at - (len(out) - at)):at]) == "".join(out[at:]):
                n = len(out) - at
                out[at - n:] = [group]
    return out


def align(a: list[str], b: list[str]) -> list[str]:
    """The wrapper that accepts what either accepts."""
    out: list[str] = []
    match = difflib.SequenceMatcher(None, [_bare(t) for t in a], [_bare(t) for t in b], autojunk=False)
    for kind, i, j, k, m in match.get_opcodes():
        if kind == "equal":
            out += [x if x == y else _both(x, y) for x, y in zip(a[i:j], b[k:m])]
            continue
        left, right = a[i:j], b[k:m]
        # a group on one side that the other side repeats
        if left and right and _unit(left) == _unit(right):
            out.append(f"({_unit(left)})+")
        else:
            out += [f"({' '.join(part)})?" for part in (left, right) if part]
    return out


def _bare(token: str) -> str:
    return token[1:-2] if token.endswith(")?") else token


def _both(x: str, y: str) -> str:
    return x if x.endswith(")?") else y


def _unit(tokens: list[str]) -> str:
    text = " ".join(tokens)
    return text[1:-2] if len(tokens) == 1 and text.endswith(")+") else text


def _constant_candidates(batches):
    """(host, place and text, pages) of a task's pages; null stands for all pages."""
    for pdf in batches:
        seen: Counter = Counter()
        for host, page in zip(pdf["host"], pdf["html"]):
            seen[host, None] += 1
            seen.update((host, key) for key in set(Blocks(page).keys))
        yield pd.DataFrame({"host": [h for h, _ in seen], "slot": pd.array([k for _, k in seen], dtype="Int64"),
                            "pages": list(seen.values())})


def _outlines(batches):
    """Distinct outlines of each host among a task's pages, with the text
    masses of their regions."""
    for pdf in batches:
        seen: dict[tuple[str, str], Counter] = {}
        for host, page, constants in zip(pdf["host"], pdf["html"], pdf["constants"]):
            b = Blocks(page)
            tokens = b.tokens(frozenset(() if constants is None else constants.tolist()))
            mass = seen.setdefault((host, "\n".join(fold(tokens))), Counter())
            for region, (chars, _) in b.regions().items():
                mass[region] += chars
        yield pd.DataFrame([(h, o, list(m.keys()), list(m.values())) for (h, o), m in seen.items()],
                           columns=["host", "wrapper", "region", "chars"])


def _merge(key, pdf):
    wrapper: list[str] | None = None
    for o in sorted(set(pdf["wrapper"]), key=lambda o: (len(o), o)):
        tokens = o.split("\n") if o else []
        wrapper = tokens if wrapper is None else align(wrapper, tokens)
    return pd.DataFrame({"host": [key[0]], "wrapper": ["\n".join(wrapper or [])]})


def _merged(outlines: DataFrame) -> DataFrame:
    """One wrapper a host, by a tree of groups of about ``FAN``."""
    level = outlines.select("host", "wrapper").distinct()
    while True:
        count = level.groupBy("host").agg(F.count("*").alias("n"))
        part = F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("n") / FAN))
        level = materialise(level.join(count, "host").select("host", "wrapper", part.alias("part"))
                            .groupBy("host", "part").applyInPandas(_merge, "host string, wrapper string"))
        if level.groupBy("host").count().where("count > 1").isEmpty():
            return level


def has_main(html) -> F.Column:
    return F.coalesce(F.col(html).rlike(f"(?i){_MAIN.pattern}"), F.lit(False))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, region, constants) from ``pages`` (host, html)."""
    pages = pages.select("host", "html")
    plain = pages.where(~has_main("html")).dropDuplicates()  # a page that comes often is no template
    held = (plain.mapInPandas(_constant_candidates, "host string, slot long, pages long")
            .groupBy("host", "slot").agg(F.sum("pages").alias("pages")))
    total = held.where("slot IS NULL").select("host", F.col("pages").alias("total"))
    # fewer than two pages' blocks a host, as each is on more than half of its pages
    constants = (held.where(F.col("slot").isNotNull() & (F.col("pages") >= CONSTANT)).join(total, "host")
                 .where(2 * F.col("pages") > F.col("total"))
                 .groupBy("host").agg(F.collect_list("slot").alias("constants")))
    marked = pages.where(has_main("html")).withColumn("constants", F.lit(None).cast("array<bigint>")).unionByName(
        plain.join(constants, "host", "left"))
    rows = materialise(marked.mapInPandas(
        _outlines, "host string, wrapper string, region array<string>, chars array<long>"))
    # the region of hosts whose pages have an article or main element
    mass = (rows.select("host", F.explode(F.arrays_zip("region", "chars")).alias("r"))
            .groupBy("host", "r.region").agg(F.sum("r.chars").alias("chars")))
    main = F.regexp_extract("region", r"([^/.]*)(?:\.[^/]*)?$", 1).isin("article", "main") & (F.col("chars") > 0)
    best = mass.groupBy("host").agg(F.max(F.struct(main, "chars", "region"))["region"].alias("region"))
    found = F.regexp_extract_all("wrapper", F.lit('"([0-9a-f]{16})'))
    return _merged(rows).join(best, "host", "left").select("host", "wrapper", "region", found.alias("constants"))


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep_html: bool = False) -> DataFrame:
    """``pages`` with text (and without the html unless asked for)."""
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    chosen = materialise(wrappers(pages.select(host.alias("host"), F.col(html_col).alias("html"))))
    keep = [c for c in pages.columns if c not in ("text", "n_chars") and (keep_html or c != html_col)]
    rows = pages.select(F.struct(*keep).alias("page"), F.col(html_col).alias("html"), host.alias("host")).join(
        chosen.select("host", "region", "constants"), "host", "left").withColumn("main", has_main("html"))

    def read(html, main, region, constants):
        out = []
        for page, article, r, texts in zip(html, main, region, constants):
            b = Blocks(page)
            if article:
                text = b.text(r) if isinstance(r, str) else ""
                out.append(text or b.text(best_region(b.regions())))
            else:
                keys = (int(x, 16) for x in (() if texts is None else texts))
                out.append(b.slots(frozenset(k - (1 << 64) if k >> 63 else k for k in keys)))
        return pd.Series(out, dtype=object)
    udf = F.pandas_udf(read, T.StringType(), F.PandasUDFType.SCALAR)
    rows = rows.select("page", udf("html", "main", "region", "constants").alias("text"))
    return rows.select(*[F.col("page")[c].alias(c) for c in keep], "text",
                       F.length("text").cast("long").alias("n_chars"))
