"""Main text of web pages by tree scoring."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names with a meaning of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset(
    """nav aside footer button select option optgroup datalist textarea input label fieldset legend iframe noscript
    noframes template svg canvas math object applet embed audio video map dialog menu head title script style""".split()
)
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead
    tr ul br""".split()
)
CLOSES_P = BLOCKS - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "html", "body"}
PARAGRAPHS = frozenset("p pre td blockquote li dd dt h1 h2 h3 h4 h5 h6 figcaption summary".split())
CONTAINERS = frozenset("article main section div body td blockquote".split())
SHUT_ROLES = frozenset("navigation banner complementary contentinfo search form alert alertdialog dialog menu menubar".split())
# Words in class and id of what is not the article.
OUTSIDE = frozenset(
    """ad ads adsense advert adverts advertisement advertising adbox sponsor sponsored promo promotion comment comments
    commentlist disqus respond reply replies sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs footer
    cookie cookies consent gdpr popup modal overlay share sharing social related recommended recommendations newsletter
    subscribe subscription signup login pagination pager toolbar skip tags""".split()
)
OUTSIDE_UNLESS_TEXT = frozenset("header masthead banner notice notices notification alert widget widgets teaser toc hidden".split())
# Lists of links whose texts are shorter than this on average are menus.
MENU_LINK_CHARS = 16
TEXT_WORDS = frozenset("article content main body post entry story text page column".split())
# Words that stand beside those above in names of page parts.
FURNITURE = frozenset(
    """area bar bars block bottom box btn button buttons card cards container form inline inner item items js left link links
    list module panel right row section slot space target thread title top unit wrap wrapper wp""".split()
)
READERS = frozenset("comment comments commentlist disqus respond reply replies".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 summary legend".split())
# Which open elements an opening tag ends, and at which element the search for them stops.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
_P_SCOPE = frozenset("table td th button caption object html body".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)
      | <(script|style|noscript|template|iframe|textarea|title|noframes|xmp)\b[^>]*+>.*?(?:</\1\b[^>]*+>|\Z)
      | <(/?)([a-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
      | <(/?)([a-z][^\s/>]*+)([^>]*+)>
      | <[!?/][^>]*+(?:>|\Z)
      | <[a-z][^>]*+\Z""",
    re.S | re.I | re.X,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""")
_WORD = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_COMMA = re.compile("[,،、，]")
_SENTENCE = re.compile(r"[.!?…。！？](?!\w)")
_LEGAL = re.compile(r"©|\(c\)\s|copyright|all rights reserved", re.I)
_DATE = re.compile(
    r"""\b\d{4}-\d\d?-\d\d?\b | \b\d\d?[./]\d\d?[./]\d{2,4}\b | \b\d+\s(?:second|minute|hour|day|week|month|year)s?\sago\b
      | \b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]{0,6}\.?\s\d\d?\b
      | \b\d\d?\.?\s(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec) | \b(?:today|yesterday)\sat\b""",
    re.I | re.X,
)
_COMMENTS_HEADING = re.compile(
    r"""\W*(?: \d+\s+(?:reader\s+)?(?:comments?|repl(?:y|ies)|responses?|thoughts?\b.*)
      | (?:reader\s+)?(?:comments|replies)(?:\W*\d+)? | (?:discussion|responses)\W*\d+
      | (?:leave|post|add|write)\s+a\s+(?:comment|reply) | join\s+the\s+(?:discussion|conversation) )\W*""",
    re.I | re.X,
)


SHUT, DOUBTFUL, WEAK = 1, 2, 3


def _outside(tag: str, raw: str, in_article: bool) -> int:
    """Whether an element is no part of an article.

    ``SHUT`` by name, role or visibility, ``DOUBTFUL`` by class, id or as a form. Paragraphs, and all that stands in an
    article, are ``DOUBTFUL`` only by a name that says nothing else (``ad-slot``, not ``ad-hoc``), and otherwise ``WEAK``.
    """
    if tag in DROPPED or (tag == "header" and not in_article):
        return SHUT
    doubt = DOUBTFUL if tag == "form" else 0
    if not raw or raw.isspace() or tag in ("html", "body", "main"):
        return doubt
    values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)}
    role = values.get("role", "").strip().lower()
    if role in SHUT_ROLES and (tag, role) != ("form", "form") or "hidden" in values:
        return SHUT
    if values.get("aria-hidden", "").strip().lower() == "true":
        return SHUT
    if "display:none" in re.sub(r"\s", "", values.get("style", "")).lower():
        return SHUT
    given = [set(_WORD.findall(_CAMEL.sub(" ", name).lower())) for name in f"{values.get('class', '')} {values.get('id', '')}".split()]
    words = set().union(*given)
    if words & OUTSIDE or (words & OUTSIDE_UNLESS_TEXT and not words & TEXT_WORDS):
        paragraph = tag in PARAGRAPHS and tag not in ("li", "td")
        if not (paragraph or in_article) or words & READERS and not paragraph:
            return DOUBTFUL
        parts = OUTSIDE | OUTSIDE_UNLESS_TEXT
        alone = any(name & parts and all(w in parts or w in FURNITURE or w.isdigit() for w in name) for name in given)
        return DOUBTFUL if alone else doubt or WEAK
    return doubt


class Tree:
    """Elements in page order: name, parent, end (first element after it), whether it is shut out, and the kind of doubt."""

    def __init__(self, page: str):
        self.names, self.parents, self.ends, self.out, self.doubt = ["#"], [-1], [0], [False], [0]
        self.texts: list[tuple[int, str]] = []
        """Pieces of text with the element they stand in; ``None`` elements never occur."""
        self._read(page)

    def _read(self, page: str) -> None:
        names, parents, ends, out, texts = self.names, self.parents, self.ends, self.out, self.texts
        stack, place, counts = [0], 0, {}

        def close(depth: int) -> None:
            for i in stack[depth:]:
                ends[i] = len(names)
                counts[names[i]] -= 1
            del stack[depth:]

        def open_since(wanted: set | frozenset, stop: set | frozenset) -> int:
            for depth in range(len(stack) - 1, 0, -1):
                name = names[stack[depth]]
                if name in wanted:
                    return depth
                if name in stop:
                    break
            return 0

        for token in _TOKEN.finditer(page):
            if token.start() > place and not out[stack[-1]]:
                texts.append((stack[-1], page[place : token.start()]))
            place = token.end()
            name = (token[3] or token[6] or "").lower()
            if not name:
                continue
            if token[2] or token[5]:
                if counts.get(name):
                    depth = next(d for d in range(len(stack) - 1, 0, -1) if names[stack[d]] == name)
                    close(depth)
                elif name == "p":
                    texts.append((stack[-1], " "))
                continue
            if name in CLOSES_P and counts.get("p") and (depth := open_since({"p"}, _P_SCOPE)):
                close(depth)
            if name in _ENDS:
                ended, stop = _ENDS[name]
                # the outermost of those that end, so that a row takes its cell along
                while any(counts.get(e) for e in ended) and (depth := open_since(ended, stop)):
                    close(depth)
            if name == "a" and counts.get("a") and (depth := open_since({"a"}, BLOCKS - {"p", "br"})):
                close(depth)
            node, parent = len(names), stack[-1]
            names.append(name)
            parents.append(parent)
            in_article = bool(counts.get("article") or counts.get("main"))
            outside = _outside(name, token[4] or token[7] or "", in_article)
            out.append(out[parent] or outside == SHUT)
            self.doubt.append(outside if outside in (DOUBTFUL, WEAK) else 0)
            ends.append(node + 1)
            if name in VOID or (token[4] or token[7] or "").endswith("/") and name not in BLOCKS:
                texts.append((node, " " if name in ("br", "hr") else ""))
            else:
                stack.append(node)
                counts[name] = counts.get(name, 0) + 1
        if place < len(page) and not out[stack[-1]]:
            texts.append((stack[-1], page[place:]))
        close(1)
        ends[0] = len(names)


def _left_out(tree: Tree) -> list[bool]:
    """Which elements are left out: those that are shut, and those in doubt that do not hold the article.

    The article is the ``article`` or ``main`` with most text outside links, if that is more than all text
    outside elements in doubt; on pages without one, whatever holds more than half of the text is spared.
    Elements in weak doubt go if a third of their text is links or none of it ends a sentence.
    """
    names, parents, out = tree.names, tree.parents, tree.out
    n = len(names)
    if not any(tree.doubt):
        return out
    doubt = [d == DOUBTFUL for d in tree.doubt]
    if WEAK in tree.doubt:
        linked, chars, said, below = [0] * n, [0] * n, [False] * n, [False] * n
        for i in range(1, n):
            below[i] = names[i] == "a" or below[parents[i]]
        for i, t in tree.texts:
            if size := 0 if out[i] else len(t.strip()):
                chars[i] += size
                linked[i] += size if below[i] else 0
                said[i] = said[i] or bool(_SENTENCE.search(t))
        for i in range(n - 1, 0, -1):
            up = parents[i]
            chars[up], linked[up], said[up] = chars[up] + chars[i], linked[up] + linked[i], said[up] or said[i]
        for i in range(1, n):
            doubt[i] = doubt[i] or tree.doubt[i] == WEAK and (3 * linked[i] >= chars[i] or not said[i])
    in_link, in_doubt, size = [False] * n, [False] * n, [0] * n
    for i in range(1, n):
        in_link[i] = names[i] == "a" or in_link[parents[i]]
        in_doubt[i] = doubt[i] or in_doubt[parents[i]]
    clear = 0
    for i, t in tree.texts:
        if not out[i] and not in_link[i] and (chars := len(t.strip())):
            size[i] += chars
            clear += 0 if in_doubt[i] else chars
    for i in range(n - 1, 0, -1):
        size[parents[i]] += size[i]
    marked = [i for i in range(1, n) if names[i] in ("article", "main") and not out[i]]
    spared = [False] * n
    held = max(marked, key=lambda i: (size[i], -i), default=0)
    if held and size[held] > (0 if not in_doubt[held] else clear):
        while held > 0:
            spared[held] = True
            held = parents[held]
    elif not any(not in_doubt[i] for i in marked):
        spared = [2 * s > size[0] for s in size]
    left = out[:]
    for i in range(1, n):
        left[i] = left[parents[i]] or out[i] or (doubt[i] and not spared[i])
    return left


def _without_comments(tree: Tree, out: list[bool]) -> list[bool]:
    """``out`` and the comments of readers, found by what they look like; what holds half of the text is never taken for them.

    They are the part under a heading that counts or asks for comments, and two or more like elements in a row that each begin
    with a short name and a date.
    """
    names, parents, ends = tree.names, tree.parents, tree.ends
    n = len(names)
    pieces = [(i, t) for i, raw in tree.texts if not out[i] and (t := unescape(raw).strip())]
    total, first, last = [0] * n, [len(pieces)] * n, [-1] * n
    for place, (i, t) in enumerate(pieces):
        total[i] += len(t)
        first[i], last[i] = min(first[i], place), place
    for i in range(n - 1, 0, -1):
        up = parents[i]
        total[up] += total[i]
        first[up], last[up] = min(first[up], first[i]), max(last[up], last[i])
    shut: list[tuple[int, int]] = []

    before = [0]
    for _, t in pieces:
        before.append(before[-1] + len(t))

    def signed(i: int) -> bool:
        """Whether an element begins with a name and a date, and has text after them."""
        begin = [t for _, t in pieces[first[i] : min(first[i] + 4, last[i] + 1)]]
        for at, t in enumerate(begin[:3]):
            if len(t) > 60 or not (dated := _DATE.search(t)):
                continue
            rest = t[: dated.start()] + t[dated.end() :]
            others = [o for o in begin[: at + 2] if o is not t and len(o) <= 40 and len(o.split()) <= 4 and not _SENTENCE.search(o)]
            named = any(c.isalpha() for c in rest) and not _SENTENCE.search(rest) or bool(others)
            return named and last[i] - first[i] >= (1 if not others else 2)
        return False

    for i in range(1, n):
        if out[i] or not total[i]:
            continue
        if names[i] in HEADINGS and total[i] <= 60 and _COMMENTS_HEADING.fullmatch(" ".join(t for _, t in pieces[first[i] : last[i] + 1])):
            top = i
            while parents[top] > 0 and total[parents[top]] == total[top]:
                top = parents[top]
            part = parents[top]
            if part > 0 and first[part] == first[top] and 2 * total[part] < total[0]:
                shut.append((part, ends[part]))
            elif 2 * (before[last[part] + 1] - before[first[top]]) < total[0]:
                shut.append((top, ends[part]))
    seen = [False] * n
    for i in range(1, n):
        if seen[i] or out[i] or names[i] not in ("li", "div", "article", "section", "dd", "tr", "blockquote") or not total[i]:
            continue
        # like elements in a row, with this one as the first
        row, j = [i], ends[i]
        while j < ends[parents[i]]:
            if total[j] and not out[j]:
                if names[j] != names[i]:
                    break
                row.append(j)
            j = ends[j]
        for j in row:
            seen[j] = True
        comments = [j for j in row if signed(j)] if len(row) > 1 else []
        if len(comments) > 1 and 2 * sum(total[j] for j in comments) < total[0]:
            shut += [(j, ends[j]) for j in comments]
    if shut:
        out = out[:]
        for begin, end in shut:
            out[begin:end] = [True] * (end - begin)
    return out


def main_text(page: str | None) -> str:
    """The article of a page: white space single, blocks joined by one space."""
    if not page:
        return ""
    tree = Tree(page)
    text = _article(tree, _without_comments(tree, _left_out(tree)))
    # nothing left: again with all that was left out by class or id
    return text if text or not any(tree.doubt) else _article(tree, tree.out)


def _article(tree: Tree, out: list[bool]) -> str:
    names, parents, ends = tree.names, tree.parents, tree.ends
    n = len(names)
    pieces = [(i, unescape(t) if "&" in t else t) for i, t in tree.texts if t and not out[i]]
    own, commas, link = [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = names[i] == "a" or in_link[parents[i]]
    for i, t in pieces:
        size = len(t) if not t.isspace() else 0
        if size:
            own[i] += size
            commas[i] += len(_COMMA.findall(t))
            link[i] += size if in_link[i] else 0
    total, total_commas, total_link = own[:], commas[:], link[:]
    links = [int(names[i] == "a") for i in range(n)]
    for i in range(n - 1, 0, -1):
        p = parents[i]
        total[p] += total[i]
        total_link[p] += total_link[i]
        links[p] += links[i]
        if names[i] not in BLOCKS:
            # text of inline elements is their block's
            own[p] += own[i]
            commas[p] += commas[i]
    density = [total_link[i] / total[i] if total[i] else 0.0 for i in range(n)]

    # paragraphs pass points to the elements above
    points = [0.0] * n
    for i in range(1, n):
        if out[i] or not own[i] or names[i] not in BLOCKS:
            continue
        given = min(own[i] / 100, 3.0) + commas[i] + (own[i] >= 25)
        given *= 1 - density[i]
        # text that stands in a container itself is a paragraph of that container
        up = parents[i] if names[i] in PARAGRAPHS else i
        for share in (1.0, 0.5, 1 / 6, 1 / 9):
            if up <= 0:
                break
            points[up] += given * share
            up = parents[up]
    best, best_score = 0, 0.0
    score = [0.0] * n
    for i in range(1, n):
        if out[i] or names[i] not in CONTAINERS or not total[i]:
            continue
        score[i] = (points[i] + (25.0 if names[i] in ("article", "main") else 0.0)) * (1 - density[i])
        if score[i] > best_score:
            best, best_score = i, score[i]

    kept = [False] * n
    if best:
        chosen = _beside(tree, out, pieces, best, score, total, density, total_link)
    else:
        chosen = [0]
    chosen = set(chosen)
    for c in chosen:
        kept[c : ends[c]] = [True] * (ends[c] - c)
    for i in range(1, n):
        # lists of nothing but short links inside the article are menus
        menu = names[i] in ("ul", "ol") and i not in chosen and links[i] >= 3 and density[i] > 0.95
        if kept[i] and (not kept[parents[i]] and i not in chosen or menu and total_link[i] < MENU_LINK_CHARS * links[i]):
            for j in range(i, ends[i]):
                kept[j] = False

    # runs of text between block borders
    words: list[str] = []
    last, run = -1, []
    for i, t in pieces:
        if not kept[i]:
            continue
        block = i
        while block > 0 and names[block] not in BLOCKS:
            block = parents[block]
        if block != last and run:
            words.append("".join(run))
            run = []
        last = block
        run.append(t)
    words.append("".join(run))
    return " ".join(" ".join(words).split())


def _beside(tree, out, pieces, best, score, total, density, total_link) -> list[int]:
    """The best container, or what holds nothing else, and the parts of the article beside it.

    Beside an ``article`` or ``main``: containers with a fifth of its points. Otherwise also every container with sentences and
    few links, and on the levels above, up to the body, containers with a fifth of the points again. Paragraphs of text anywhere.
    """
    names, parents, ends = tree.names, tree.parents, tree.ends
    n = len(names)
    said, legal = [False] * n, [False] * n
    for i, t in pieces:
        said[i] = said[i] or bool(_SENTENCE.search(t))
        legal[i] = legal[i] or bool(_LEGAL.search(t))
    for i in range(n - 1, 0, -1):
        said[parents[i]] = said[parents[i]] or said[i]
        legal[parents[i]] = legal[parents[i]] or legal[i]
    inner = {"article", "main", "body", "html", "#"}
    floor = score[best] * 0.2
    chosen, top, marked, level = [], best, names[best] in ("article", "main"), 0
    while True:
        while not marked and names[parents[top]] not in inner and total[parents[top]] == total[top]:
            top = parents[top]
        if not level:
            chosen.append(top)
        for i in _children(parents[top], ends):
            if i == top or out[i] or not total[i]:
                continue
            good = score[i] >= floor if names[i] in CONTAINERS else False
            if names[i] in CONTAINERS and not marked and not level:
                good = good or density[i] < 0.25 and said[i] and not (legal[i] and total[i] < 300)
            if names[i] in PARAGRAPHS and names[i] not in ("li", "td"):
                good = density[i] < 0.25 and (total[i] > 80 or not total_link[i])
            if good:
                chosen.append(i)
        if marked or names[parents[top]] in inner:
            return chosen
        top, level = parents[top], level + 1


def _children(parent: int, ends: list[int]) -> Iterator[int]:
    i = parent + 1
    while i < ends[parent]:
        yield i
        i = ends[i]


def extract_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The main text of every page.

    Elements that are never an article (by name, role, visibility) are left out, and those that class or id
    puts in doubt unless they hold the article or nothing would be left; inside an article a name leaves
    out only what it names outright, or what is a third links or no sentences. Comments are also known by
    their heading or by repeated names and dates. Each paragraph passes points for its length and commas
    to the elements above it, less its share of link text; the container with most points after the same
    discount is kept, with siblings that have a fifth of its points, have sentences and few links (unless
    the best is an ``article`` or ``main``), or are paragraphs of text.

    Returns ``page_id``, ``url``, ``text`` (empty if there is none) and ``n_chars`` (code points), one row
    per row. Null and empty pages have an empty text; pages cut off anywhere are read as far as they
    go; nesting may be of any depth. Repeated rows stay; an empty table gives no rows; other columns
    are not read.
    """
    kind = pages.schema[page_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    chosen = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return chosen.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
