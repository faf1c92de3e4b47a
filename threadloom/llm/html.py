"""Main text of web pages: nearest-URL page differencing beside markup that names its role.

Pages of one host come from few templates. Each page is put beside the nearest pages of its host in URL path order, one on
either side, that have another text; all visible text lines are aligned by a longest common subsequence with each, and lines
that stand on all of them are template and go. Lines align only if they stand in like elements. A page that marks its
article tells most of that itself: there only lines in boxes with a class of their own go, and only if no line that is the
page's own, or the neighbours' own, stands in such a box; plain paragraphs, headings and lists of an article stay, though
other pages may begin alike. Lines of elements that say what they are (nav, footer, class "ad", ...) go in any case, since
menus and notices that differ from page to page are no difference of templates.

Only hashes of lines travel. The html itself is read twice and shuffled only if lines go on very many pages.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.ordered import nearest_others
from threadloom.llm.storage import materialize

#: Elements whose text is never the article's, and words in class, id or role that say so.
DROPPED = frozenset("nav footer aside form script style noscript template head title button select option textarea iframe svg object canvas dialog menu audio video datalist".split())
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements adsense banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies "
    "disclaimer disqus footer gdpr masthead menu menubar modal nav navbar navigation newsletter notice notices paywall popup "
    "promo promotion related replies search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Words beside those that only say where or what kind of box it is.
_LAYOUT = frozenset("area articles bar block box buttons container content inner items left links list main panel posts right section stories top bottom wrapper wrap".split())
#: Elements that begin and end a block of text, and those without an end tag.
BLOCKS = frozenset("address article blockquote body br caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose boxes say where a line stands.
BOXES = frozenset("address article blockquote details div dl fieldset figure footer header main ol section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Lines to drop that are sent to all tasks; more are joined.
SENT_LINES = 500_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.S)
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg")}
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_CLASS = re.compile(r"""\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:\s|^)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)


#: Words of the above that also stand for content inside an article, unless the whole name is of such words.
SECTION_NAMES = frozenset("comment comments notice notices related replies search share sharing social".split())
#: Elements that end where the end tag may be left out: by which start tags, and in which elements they live.
OMITTED = {
    "p": (BLOCKS | {"nav", "footer", "aside", "form"}, frozenset()), "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})), "td": (frozenset({"td", "th", "tr"}), frozenset({"table", "tr"})),
    "th": (frozenset({"td", "th", "tr"}), frozenset({"table", "tr"})), "tr": (frozenset({"tr", "tbody", "tfoot"}), frozenset({"table", "tbody", "thead", "tfoot"})), "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})), "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "option": (frozenset({"option", "optgroup"}), frozenset({"select"})),
}
#: Elements that nobody sees.
UNSEEN = frozenset("head script style noscript template title svg iframe object canvas audio video datalist".split())


class Line(NamedTuple):
    text: str
    article: bool  # inside article or main
    marked: bool  # in an element that says it is no article
    box: str = ""  # the boxes around it, with their classes, and its element

    @property
    def named(self) -> bool:
        """In an element that has a class, inside the article."""
        return "." in self.box.rpartition("article")[2].rpartition("main")[2]


def _names(attributes: str) -> list[set[str]]:
    """The words of each name in class, id and role."""
    return [set(re.split(r"[_-]+", name)) for m in _NAMES.findall(attributes) for name in "".join(m).lower().split()]


def _says_dropped(tag: str, attributes: str, depth: int) -> bool:
    if tag in DROPPED or (tag == "header" and not depth):
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    names = _names(attributes)
    found = set().union(*names)
    if tag == "article":
        return bool(found & {"comment", "comments", "ad", "advert", "sponsored", "promo", "related"})
    if tag in ("p", "span", "b", "i", "em", "strong", "a", "h1", "h2", "h3", "h4", "h5", "h6") and not found & {"ad", "ads", "advert", "advertisement", "notice", "cookie", "comment", "sponsored", "promo"}:
        return bool(_HIDDEN.search(attributes))
    if depth:  # in an article, "related-work" is a section of it, "related" or "related-posts" aren't
        own = [n & DROPPED_NAMES for n in names]
        return bool(any(n - SECTION_NAMES for n in own) or any(n and full <= n | _LAYOUT for n, full in zip(own, names, strict=True)) or _HIDDEN.search(attributes))
    return bool(found & DROPPED_NAMES or _HIDDEN.search(attributes))


def lines_of(page: str) -> list[Line]:
    """The page's visible blocks of text in order; white space is single. Scripts, styles and hidden elements are left out.

    In an element that says it is no article, lines are marked; it ends with its end tag, where another start tag or the
    end of what holds it implies that, and with an article around it.
    """
    out: list[Line] = []
    words: dict[bool, list[str]] = {False: [], True: []}
    at = depth = 0
    dropping, unseen = "", False
    inner: dict[str, int] = {}  # elements open inside the one that is dropped
    boxes: list[tuple[str, str]] = []
    leaf = ""

    def flush(marked: bool) -> None:
        text = " ".join(html.unescape("".join(words[marked])).split())
        words[marked] = []
        if text:
            out.append(Line(text, depth > 0, marked, "" if marked else "/".join([*(b for _, b in boxes), leaf])))

    def enter(tag: str, attributes: str) -> None:
        nonlocal leaf
        said = _CLASS.search(attributes) if attributes else None
        name = tag + ("." + ".".join("".join(x or "" for x in said.groups()).lower().split()) if said else "")
        if tag in BOXES:
            boxes.append((tag, name))
            leaf = ""
        elif tag not in ("br", "hr"):
            leaf = name

    def leave(tag: str) -> None:
        nonlocal leaf
        leaf = ""
        if tag in BOXES and any(t == tag for t, _ in boxes):
            while boxes.pop()[0] != tag:
                pass

    while at < len(page):
        m = _TOKEN.search(page, at)
        end = m.start() if m else len(page)
        if end > at and not unseen:
            words[bool(dropping)].append(page[at:end])
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        closes = bool(m[1])
        if dropping:
            starts, homes = OMITTED.get(dropping, (frozenset(), frozenset()))
            holds = closes and not inner.get(tag) and (tag in ("article", "main", "body", "html") or tag in homes or (dropping == "p" and tag in BLOCKS and tag != "p"))
            implied = holds or (not closes and tag in starts and not any(inner.get(x) for x in homes))
            if implied or (closes and tag == dropping and not inner.get(tag)):
                flush(True)
                dropping, unseen = "", False
                inner.clear()
                if not implied:
                    continue
            else:
                if tag in BLOCKS and not unseen:
                    flush(True)
                if closes:
                    inner[tag] = max(0, inner.get(tag, 0) - 1)
                elif tag in _RAW:
                    stop = _RAW[tag].search(page, at)
                    at = stop.end() if stop else len(page)
                elif tag not in VOID and not m[3].rstrip().endswith("/"):
                    inner[tag] = inner.get(tag, 0) + 1
                continue
        if tag in BLOCKS or tag in DROPPED:
            flush(False)
        if closes:
            depth -= tag in ("article", "main") and depth > 0
            if tag in BLOCKS:
                leave(tag)
            continue
        if tag in _RAW:
            stop = _RAW[tag].search(page, at)
            at = stop.end() if stop else len(page)
        elif tag not in VOID and _says_dropped(tag, m[3], depth):
            dropping, unseen = tag, tag in UNSEEN or bool(_HIDDEN.search(m[3]))
        else:
            depth += tag in ("article", "main")
            if tag in BLOCKS:
                enter(tag, m[3])
    flush(True)
    flush(False)
    return out


def common_lines(a: list, b: list) -> list[int]:
    """Indices of ``a`` in a longest common subsequence with ``b`` (Hunt and Szymanski)."""
    where: dict[object, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        where.setdefault(b[j], []).append(j)
    tails: list[int] = []
    links: list[tuple] = []
    for i, x in enumerate(a):
        for j in where.get(x, ()):
            k = bisect_left(tails, j)
            link = (i, links[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                links.append(link)
            elif j < tails[k]:
                tails[k], links[k] = j, link
    out, link = [], links[-1] if links else None
    while link:
        out.append(link[0])
        link = link[1]
    return out[::-1]


class Sketch(NamedTuple):
    """A page's lines without their text."""

    keys: list[int]  # hashes of text and box
    kinds: list[int]  # MARKED, ARTICLE, NAMED and HEADING
    boxes: list[int]  # hashes of boxes


MARKED, ARTICLE, NAMED, HEADING = 1, 2, 4, 8


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def sketch_of(lines: list[Line]) -> Sketch:
    kinds = [MARKED * x.marked + ARTICLE * x.article + NAMED * x.named + HEADING * (x.box.rpartition("/")[2].partition(".")[0] in HEADINGS) for x in lines]
    return Sketch([_hash(f"{x.marked:d}{x.box}\n{x.text}") for x in lines], kinds, [_hash(x.box) for x in lines])


def _body(kinds: list[int]) -> list[int]:
    """Lines that may be the page's text: those of its article, or all where it marks none."""
    has_article = any(k & ARTICLE and not k & MARKED for k in kinds)
    return [i for i, k in enumerate(kinds) if not k & MARKED and (k & ARTICLE or not has_article)]


def shared_lines(own: Sketch, others: list[Sketch]) -> list[int]:
    """Lines of the page's body that are template by what it shares with all of ``others``.

    In an article they are lines of named boxes, and of at least two pages beside this one that differ from each other;
    a page without own lines is a copy and keeps all.
    """
    body = _body(own.kinds)
    found = [set(common_lines(own.keys, other.keys)) for other in others]
    if not found:
        return []
    every, some = set.intersection(*found), set.union(*found)
    single = [i for i in body if i not in some]
    if not body or not own.kinds[body[0]] & ARTICLE:
        return [i for i in body if i in every] if any(i not in every for i in body) else []
    if not single or len(others) < 2 or others[0].keys == others[1].keys:
        return []
    known = set(own.keys)
    content = {own.boxes[i] for i in single} | {b for other in others for k, kind, b in zip(other.keys, other.kinds, other.boxes, strict=True) if kind & ARTICLE and k not in known}
    return [i for i in body if i in every and own.kinds[i] & NAMED and not own.kinds[i] & HEADING and own.boxes[i] not in content]


def text_of(lines: list[Line], gone: list[int]) -> str:
    """The page's body without the lines that are gone."""
    drop = set(gone)
    return " ".join(lines[i].text for i in _body(sketch_of(lines).kinds) if i not in drop)


def main_text(own: list[Line], others: list[list[Line]]) -> str:
    """The page's text without what is template by its neighbours ``others``."""
    return text_of(own, shared_lines(sketch_of(own), [sketch_of(x) for x in others]))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


#: Rows of results that leave a task at once.
_ROWS = 200
_SKETCH = pa.struct([("keys", pa.list_(pa.int64())), ("kinds", pa.list_(pa.int8())), ("boxes", pa.list_(pa.int64()))])
_KEYS = {"_id": pa.int64(), "_h1": pa.int64(), "_h2": pa.int64()}


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == _ROWS:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([*_KEYS.items(), ("_host", pa.string()), ("_path", pa.string()), ("_digest", pa.binary()), ("_sketch", _SKETCH)])

    def rows() -> Iterator[dict]:
        for r in _rows(batches):
            lines = lines_of(r["html"] or "")
            text = "\n".join(x.text for x in lines if not x.marked)  # what tells pages apart
            digest = xxhash.xxh128_digest(text.encode("utf-8", "surrogatepass"))
            yield {**{k: r[k] for k in (*_KEYS, "_host", "_path")}, "_digest": digest, "_sketch": sketch_of(lines)._asdict()}

    yield from _batches(rows(), schema)


def _gone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[dict]:
        for r in _rows(batches):
            gone = shared_lines(Sketch(**r["_sketch"]), [Sketch(**r[side]) for side in ("before", "after") if r[side]])
            if gone:
                yield {**{k: r[k] for k in _KEYS}, "_gone": gone}

    yield from _batches(rows(), pa.schema([*_KEYS.items(), ("_gone", pa.list_(pa.int32()))]))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[dict]:
        for r in _rows(batches):
            text = text_of(lines_of(r["html"] or ""), r["_gone"] or [])
            yield {"page_id": r["page_id"], "url": r["url"], "text": text, "n_chars": len(text)}

    yield from _batches(rows(), pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())]))


def template_lines(pages: DataFrame) -> DataFrame:
    """(_id, _h1, _h2, _gone): which lines of which of ``pages`` (as ``_keyed`` gives them) are template by differencing."""
    url = F.coalesce("url", F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1), r"/+$", "")
    long = "array<long>"
    schema = f"_id long, _h1 long, _h2 long, _host string, _path string, _digest binary, _sketch struct<keys:{long}, kinds:array<byte>, boxes:{long}>"
    sketches = pages.select(*_KEYS, host.alias("_host"), path.alias("_path"), "html").mapInArrow(_sketches, schema)
    order = [F.col(c) for c in ("_host", "_path", *_KEYS)]
    near = nearest_others(sketches, order, ["_host"], ["_digest"], "_sketch", lambda df: materialize(df, "sketches"))
    beside = near.where("before is not null or after is not null").select(*_KEYS, "_sketch", "before", "after")
    # rows that are equal in all keys stand in one run and lose the same lines
    return beside.mapInArrow(_gone, "_id long, _h1 long, _h2 long, _gone array<int>").dropDuplicates(list(_KEYS))


def _keyed(pages: DataFrame) -> DataFrame:
    identity = {"_id": F.coalesce(F.col("page_id").cast("long"), F.lit(-(1 << 63))), "_h1": F.xxhash64("url", "html"), "_h2": F.xxhash64(F.lit(2), "html", "url")}
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", *[v.alias(k) for k, v in identity.items()])


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html).

    Pages are ordered by host and path, so a host with very many pages is spread over tasks; neighbours are found by a scan
    of that order, over ends of ranges and over runs of pages with equal text. A page alone on its host is compared with
    none, one at its end with one. A null url is of the host "", null or empty html has the text "". Repeated rows are
    repeated pages; other columns don't matter.
    """
    rows = _keyed(pages)
    gone = materialize(template_lines(rows), "template_lines")
    lines = gone.agg(F.coalesce(F.sum(F.size("_gone")), F.lit(0))).first()[0]
    joined = rows.join(F.broadcast(gone) if lines <= SENT_LINES else gone, list(_KEYS), "left")
    return joined.select("page_id", "url", "html", "_gone").mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
