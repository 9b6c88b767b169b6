"""Main-text extraction by tag-path ratios.

Each page becomes a sequence of text blocks, each with its root-to-leaf tag path. Text length and punctuation are
aggregated per path, the per-block ratios are smoothed along the page, the features are fused, and paths above a
threshold relative to the page's own spread are content. Their blocks are kept wherever they stand. Blocks of other
paths are kept where they belong to content: headings, list items and short paragraphs beside a selected block or inside
the element that holds nearly all of them; other elements' blocks there need a lower score.

Elements that by their tag, role or hiding attributes are menus, notices, forms or comments never take part. Those
that are comments, side columns, consent notices and the like by class or id words alone (whole names, such as
``comment-list``, not ``has-sidebar``) do take part when they hold nearly all of the page's text. Other names of
furniture (adverts, menus, legal notes, headers) only are a hint: such elements have paths of their own, and whether they are
content their paths' scores decide, without the smoothing that lends them their neighbours' length. Inline elements
with such names go. Tags and attributes are read as the HTML standard does; nesting of any depth takes linear time.

Null or empty html gives the empty text. Pages are processed one by one and whole. Repeated rows give repeated
results; extra columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from skein.llm.common import map_batches, read

#: Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
FORMATTING = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
NEVER = frozenset(
    "head script style noscript template title nav aside footer button select option textarea input iframe object embed "
    "svg canvas audio video map dialog menu datalist fieldset legend xmp noembed noframes applet".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre section summary table ul".split()
)
SELF_CLOSING = {
    "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}),
    "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"}),
}
SCOPES = frozenset("table ul ol dl body html article section div td th blockquote main aside nav footer header".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th caption figcaption summary address".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Names of page furniture in classes and ids, and words that such names are put together with. What is named by the first
#: group may read like the text itself; of the second, path scores tell.
PROSE = frozenset(
    "sidebar aside comment comments disqus reply replies respond cookie cookies consent gdpr popup modal overlay newsletter "
    "subscribe subscription signup login related recommended recommendations skip hidden".split()
)
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner nav navbar navigation "
    "menu menus breadcrumb breadcrumbs widget widgets rail footer header masthead topbar toolbar notice notices notification "
    "share sharing social popular trending pagination pager copyright legal disclaimer tags".split()
)
FURNITURE = PROSE | HINTS
BESIDE = frozenset(
    "list lists box bar wrap wrapper container block area section item items link links button buttons left right top bottom inner "
    "outer slot unit text panel form message posts post articles stories thread body title icon icons count meta holder row col "
    "column module region zone group label".split()
)
STATES = frozenset("has no not with without is".split())
#: What a header of these is, belongs to the text.
HEADED = frozenset("page post entry article content story section title".split())
#: Characters of a hinted path that can overrule its name.
PROSE_CHARS = 200
#: Named furniture that holds this share of a page's text is none.
MOST = 0.85
PUNCTUATION = frozenset(".,;:!?…。，、；：！？¿¡\"'“”‘’«»()-–—")

TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
    r"<(/?)([a-zA-Z][^\s/>]*+)"
    r"((?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)?+|=)*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)))?")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HEADING = re.compile(r"h[1-6]\Z")
NONE, HINTED, NAMED, ALWAYS = 0, 1, 2, 3


def _named(name: str) -> int:
    """Whether a class or id is a name of page furniture: NAMED, HINTED or NONE."""
    words = [w.lower() for w in NAME_WORD.findall(name)]
    words = [w for w in words if len(w) > 1]
    if not words or not STATES.isdisjoint(words):
        return NONE
    if words[-1] in FURNITURE:
        if words[-1] == "header" and words[0] in HEADED:
            return NONE
    elif words[0] not in FURNITURE or not all(w in BESIDE or w in FURNITURE for w in words[1:]):
        return NONE
    return HINTED if PROSE.isdisjoint(words) else NAMED


def _furniture(tag: str, attributes: str, inside_content: bool) -> int:
    """Whether an element is page furniture: ALWAYS by tag, role or hiding, NAMED or HINTED by class or id, or NONE."""
    if tag in NEVER or (tag == "header" and not inside_content):
        return ALWAYS
    if tag in ("html", "body", "main"):
        return NONE
    found = NAMED if tag == "form" else NONE
    for name, *values in ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), "".join(values).strip()
        if name == "hidden" or (name == "role" and value.lower() in ROLES) or (name == "aria-hidden" and value.lower() == "true"):
            return ALWAYS
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return ALWAYS
        if name in ("class", "id"):
            found = max([found, *map(_named, value.split())])
    return found


class Page:
    """A page's elements (parent, tag, kind of furniture, number of the tag path; parents come first) and runs of text."""

    def __init__(self) -> None:
        self.parent, self.tag, self.kind, self.path = [0], [""], [NONE], [0]
        self.paths: dict[tuple[int, str], int] = {}
        self.runs: list[tuple[int, int, str, bool]] = []  # block, element, text, whether in a link

    def add(self, parent: int, tag: str, kind: int, inline: bool = False) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.kind.append(kind)
        above = self.path[parent]
        step = f"{tag} hinted" if kind == HINTED else tag
        self.path.append(above if inline else self.paths.setdefault((above, step), len(self.paths) + 1))
        return len(self.tag) - 1


def read_page(page: str) -> Page:
    """Elements and runs of text; those inside furniture by tag, role or hiding are left out."""
    out = Page()
    stack = [0]  # open block elements
    marks: list[int] = []  # places in the stack that end searches for open elements
    opened: dict[str, int] = {}
    inline_open: dict[str, int] = {}
    inline: list[tuple[str, int, int]] = []  # inline furniture and what is open in it: tag, element, stack's height
    block = blocked = content = 0
    link = False

    def close_inline() -> str:
        nonlocal blocked
        tag, e, _ = inline.pop()
        inline_open[tag] -= 1
        blocked -= out.kind[e] == ALWAYS
        return tag

    def push(tag: str, kind: int) -> None:
        nonlocal blocked, content
        if tag == "p" or tag in SELF_CLOSING or tag in SCOPES:
            marks.append(len(stack))
        stack.append(out.add(stack[-1], tag, kind))
        opened[tag] = opened.get(tag, 0) + 1
        blocked += kind == ALWAYS
        content += tag in ("article", "main")

    def pop(height: int) -> None:
        nonlocal blocked, content
        while len(stack) > height:
            e = stack.pop()
            tag = out.tag[e]
            opened[tag] -= 1
            blocked -= out.kind[e] == ALWAYS
            content -= tag in ("article", "main")
        while marks and marks[-1] >= height:
            marks.pop()
        while inline and inline[-1][2] > height:
            close_inline()

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else end]
        if text and not blocked:
            out.runs.append((block, inline[-1][1] if inline else stack[-1], text, link))
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            if not blocked:
                out.runs.append((block, inline[-1][1] if inline else stack[-1], " ", link))
            continue
        if m[1]:
            if tag in FORMATTING:
                if tag == "a":
                    link = False
                while inline_open.get(tag) and close_inline() != tag:
                    pass
            elif opened.get(tag):
                block += 1
                link = False
                height = len(stack) - 1
                while out.tag[stack[height]] != tag:
                    height -= 1
                pop(height)
            continue
        attributes = m[3]
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = close.start() if close else end
            if close:
                gt = page.find(">", close.end())
                at = gt + 1 if gt >= 0 else end
            continue
        if tag in FORMATTING:
            link = link or tag == "a"
            kind = _furniture(tag, attributes, True) if attributes else NONE
            if kind or inline:
                inline_open[tag] = inline_open.get(tag, 0) + 1
                kind = NAMED if kind == HINTED else kind
                inline.append((tag, out.add(inline[-1][1] if inline else stack[-1], tag, kind, inline=True), len(stack)))
                blocked += kind == ALWAYS
            continue
        if tag in VOID:
            block += tag == "hr"
            continue
        block += 1
        link = False
        if tag in CLOSES_P:
            for k in reversed(marks):
                if out.tag[stack[k]] == "p":
                    pop(k)
                    break
                if out.tag[stack[k]] in SCOPES:
                    break
        for k in reversed(marks) if tag in SELF_CLOSING else ():
            there = out.tag[stack[k]]
            if there in SELF_CLOSING[tag]:
                pop(k)
                break
            if there in SCOPES and not (tag in ("td", "th", "tr") and there in ("td", "th")):
                break
        if attributes.endswith("/") and tag not in ("p", "div", "li"):
            continue
        push(tag, _furniture(tag, attributes, content > 0))
    return out


def blocks(page: str) -> tuple[Page, list[tuple[str, int, int]]]:
    """The page and its blocks: text, element, characters inside links; furniture left out."""
    out = read_page(page)
    inside = [0] * len(out.tag)
    for _, e, text, _ in out.runs:
        inside[e] += len(text) if not text.isspace() else 0
    for e in range(len(inside) - 1, 0, -1):
        inside[out.parent[e]] += inside[e]
    gone = [False] * len(out.tag)
    for e in range(1, len(gone)):
        gone[e] = gone[out.parent[e]] or out.kind[e] == ALWAYS or (out.kind[e] == NAMED and inside[e] < MOST * inside[0])
        if out.kind[e] == HINTED and inside[e] >= MOST * inside[0]:
            out.kind[e] = NONE
    found: list[tuple[str, int, int]] = []
    held: list[tuple[int, int, str, bool]] = []

    def flush() -> None:
        text = " ".join(html_lib.unescape("".join([x[2] for x in held])).split())
        if text:
            e = held[0][1]
            while e and out.path[out.parent[e]] == out.path[e]:  # inline elements have their parents' paths
                e = out.parent[e]
            found.append((text, e, min(len(text), sum([len(x[2]) for x in held if x[3]]))))
        held.clear()

    for run in out.runs:
        if held and held[0][0] != run[0]:
            flush()
        if not gone[run[1]]:
            held.append(run)
    flush()
    return out, found


def _smooth(values: list[float]) -> list[float]:
    """Gaussian smoothing over two neighbours on either side."""
    kernel = [math.exp(-(d * d) / 2.0) for d in range(3)]
    n, out = len(values), []
    for i in range(n):
        num = den = 0.0
        for j in range(max(0, i - 2), min(n, i + 3)):
            w = kernel[abs(i - j)]
            num += w * values[j]
            den += w
        out.append(num / den)
    return out


def extract(page: str | None, strength: float = 0.5) -> str:
    """The main text of one page; blocks in page order, one per line."""
    tree, found = blocks(page) if page else (None, [])
    if not found:
        return ""
    path = [tree.path[e] for _, e, _ in found]
    hinted = [False] * len(tree.tag)
    for e in range(1, len(hinted)):
        hinted[e] = tree.kind[e] == HINTED or hinted[tree.parent[e]]
    ratios: dict[int, list[float]] = {}
    for (text, _, linked), number in zip(found, path, strict=True):
        r = ratios.setdefault(number, [0.0, 0.0, 0.0])
        r[0] += len(text) - linked
        r[1] += sum(map(text.count, PUNCTUATION)) if linked < len(text) else 0
        r[2] += 1
    length = _smooth([ratios[n][0] / ratios[n][2] for n in path])
    marks = _smooth([ratios[n][1] / ratios[n][2] for n in path])
    fused = [a * (1.0 + b) for a, b in zip(length, marks, strict=True)]
    per_path: dict[int, list[float]] = {}
    for n, score in zip(path, fused, strict=True):
        per_path.setdefault(n, []).append(score)
    means = {n: sum(v) / len(v) for n, v in per_path.items()}
    mean = sum(fused) / len(fused)
    spread = math.sqrt(sum((x - mean) ** 2 for x in fused) / len(fused))
    bar = min(strength * spread, max(means.values()))
    # Hinted paths must come near the page's strongest path, without smoothing, and have text enough to tell.
    raw = {n: length / count * (1.0 + marks / count) for n, (length, marks, count) in ratios.items()}
    level = raw[max(raw, key=lambda n: raw[n] * ratios[n][2])]
    for n in {n for n, (_, e, _) in zip(path, found, strict=True) if hinted[e]}:
        means[n] = means[n] if raw[n] >= strength * level and ratios[n][0] >= 2 * strength * PROSE_CHARS else -1.0
    plain = [linked * 2 <= len(text) for text, _, linked in found]
    hit = [means[n] >= bar and ok for n, ok in zip(path, plain, strict=True)]
    if not any(hit):
        hit = [means[n] >= bar for n in path]

    # The innermost element that holds nearly all of the selected text, and whether it is the page's own article.
    weight = [0] * len(tree.tag)
    beside = set()
    for (text, e, _), ok in zip(found, hit, strict=True):
        if ok:
            weight[e] += len(text)
            beside.add(tree.parent[e])
    for e in range(len(weight) - 1, 0, -1):
        weight[tree.parent[e]] += weight[e]
    box = max((e for e, w in enumerate(weight) if w >= 0.8 * weight[0]), default=0)
    while box and tree.tag[box] in TEXTUAL:
        box = tree.parent[box]
    above = [box]
    while above[-1]:
        above.append(tree.parent[above[-1]])
    own = next((e for e in above if tree.tag[e] in ("article", "main")), 0)
    box = own or box
    held = [False] * len(tree.tag)
    for e in range(len(held)):
        held[e] = e == box or (e > 0 and held[tree.parent[e]])
    titled = any(tree.tag[e] == "h1" and held[e] for _, e, _ in found)
    keep = []
    for (text, e, _), ok, open_ in zip(found, hit, plain, strict=True):
        leaf = tree.tag[e]
        if leaf == "h1" and not titled and (tree.parent[e] in above or tree.parent[tree.parent[e]] in above):
            keep.append(text)
            continue
        near = held[e] or tree.parent[e] in beside
        if hinted[e]:
            near = tree.parent[e] in beside
        if ok or (near and leaf in TEXTUAL and (open_ or own or leaf == "p" or HEADING.match(leaf))) or (near and open_ and means[tree.path[e]] >= 0.2 * bar):
            keep.append(text)
    return "\n".join(keep)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = [extract(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    return map_batches(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")


def op1_html_extract(spark, sf_dir):
    return extract_pages(read(spark, sf_dir, "pages"))
