"""Main text of web pages by tag-path ratios.

A page is read into blocks, the runs of text between block-level tags. Each block has a root-to-leaf path of
tags with their class and id names. For each path the text lengths (without links) and the punctuation of its
blocks are aggregated; the mean length and the mean punctuation a block of a path are smoothed over
neighbouring blocks in page order and multiplied, and the paths whose fused ratio reaches a share of the
ratios' standard deviation are content. All that follows rests on these paths:

* the container is the smallest element that holds the content; elements of one kind that hold content side
  by side (several articles) stay together in theirs,
* in it all blocks stay, headings and short paragraphs as well, but what is marked as something else and
  named elements whose own ratio is far under the limit,
* a page without a content path has no main text.

What HTML's tags and an author's names say is a prior: <article> and <main> raise a path's ratio, a form, a
header and names such as "comments" lower it. A name removes an element from the container only if the
ratios don't show that nearly all content is in it.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import with_text_columns

#: What HTML calls block-level, void, formatting, and not text of the page.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template svg math iframe noframes noembed xmp object canvas audio video".split())
NOISE = frozenset("head nav aside footer menu dialog button select datalist".split())
FORM = frozenset("form fieldset".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar".split())
ADVERTS = frozenset("ad ads adv advert adverts advertisement promo promoted sponsor sponsored".split())
NOISE_NAMES = ADVERTS | frozenset("banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice pager pagination popup related replies reply share sharing sidebar signup social subscribe teaser toolbar widget".split())
#: Words that make a name say something of the page's layout or of what a text is about, as in has-sidebar,
#: comments-open and notice-of-death; words for a part of what the word before them names, as in ad-wrapper; and
#: those that count before any other word.
LAYOUT_FIRST, LAYOUT_LAST, PHRASE = frozenset("has no with without".split()), frozenset("open closed".split()), frozenset("about and at by for from in of on the to".split())
PARTS = frozenset("area block body bottom box btn button buttons col column container count form group icons inner item items label left link links list main outer panel right row section text title top widgets wrap wrapper zone".split())
QUALIFIERS = frozenset("promoted related sponsored".split())
#: Elements that are text themselves, on which only an advert's whole name counts; other lists and tables.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li td th tr dd dt figcaption caption address summary".split())
LISTS = frozenset("ul ol dl table tbody thead tfoot figure hgroup".split())
CLOSED_BY_BLOCK = frozenset(["p"])
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("table ul ol dl menu select body html article section div main".split())

#: A path is content if its fused ratio is this share of the standard deviation of all paths' at least.
THRESHOLD = 0.8
#: Weights of a block and its neighbours in smoothing.
KERNEL = (0.25, 0.5, 0.25)
#: Prior factors of a ratio: in <article> or <main>, and under a name, role or form that speaks against content.
MAIN_PRIOR, MARK_PRIOR = 2.0, 0.25
#: A container is gone down into as long as one child holds this share of the content.
INNER_SHARE = 0.6
#: In the container a named element that isn't textual goes if its own ratio is under this share of the limit.
LOW_SHARE = 0.25
LINK_SHARE = 0.6
#: A mark can fall if elements marked alike hold this share of the content and so much at most is unmarked.
MARKED_SHARE, UNMARKED_SHARE = 0.5, 0.25
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？；：]")

_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)|<!--(?:.*?-->|.*\Z)|<[!?/][^>]*(?:>|\Z)""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style|itemprop)(?![\w-])(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_DIGITS = re.compile(r"[0-9]+")


class Element:
    """An open or closed element; ``path`` numbers its root-to-leaf path, ``kind`` its own part of that."""

    __slots__ = ("cause", "dropped", "kind", "main", "mark", "named", "noise", "parent", "path", "tag", "whole_mark")

    def __init__(self, tag: str, parent: int, path: int, kind: str):
        self.tag, self.parent, self.path, self.kind = tag, parent, path, kind
        #: Not shown or no text by its tag or role; what its names, role or form say, and whether that is all they say.
        self.dropped, self.mark, self.whole_mark, self.named, self.main = False, "", False, False, False
        #: Set by ``_settle``: in something else than the main text, and the outermost mark that makes it so.
        self.noise, self.cause = False, -1


class Block:
    __slots__ = ("at", "linked", "mere", "path", "punctuation", "text")

    def __init__(self, at: int, path: int, text: str, linked: int):
        self.at, self.path, self.text, self.linked = at, path, text, linked
        self.punctuation = len(PUNCTUATION.findall(text))
        self.mere = linked > 0 and linked >= LINK_SHARE * len(text)


def _says_noise(words: list[str]) -> bool:
    if any(w in LAYOUT_FIRST or w in PHRASE for w in words) or words[-1] in LAYOUT_LAST:
        return False
    heads = [w for w in words if w not in PARTS]
    return bool(heads) and (heads[-1] in NOISE_NAMES or any(w in QUALIFIERS for w in words))


def _read_attributes(tag: str, attributes: str) -> tuple[bool, str, bool, str, bool]:
    """Whether the element isn't shown or is no text by its role, its mark, whether the mark has no other
    part, its names, and whether it says that it is the main text."""
    dropped, marks, whole, names, main = False, [tag] if tag in FORM else [], False, [], False
    for m in _ATTRIBUTE.finditer(attributes) if attributes.strip() else ():
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key == "hidden":
            dropped = dropped or value.lower() != "until-found"
        elif key == "aria-hidden":
            dropped = dropped or value.lower() == "true"
        elif key == "style":
            dropped = dropped or _UNSEEN.search(value) is not None
        elif key == "itemprop":
            main = main or "articleBody" in value
        elif key == "role":
            main = main or value.lower() == "main"
            dropped = dropped or value.lower() in NOISE_ROLES - FORM
            marks += [tag] if value.lower() in FORM else []
        else:
            for name in value.split():
                names.append(_DIGITS.sub("", name))
                words = [w.lower() for w in _NAME.findall(name) if not w.isdecimal()]
                if not words or not _says_noise(words):
                    continue
                if all(w in (ADVERTS if tag in TEXTUAL else NOISE_NAMES) for w in words):
                    marks.append(name)
                    whole = True
                elif tag not in TEXTUAL and tag not in LISTS:
                    marks.append(name)
    if tag in ("html", "body", "main"):
        return False, "", False, "", main
    return dropped, " ".join(marks), whole, " ".join(sorted(names)), main


def _plain(parts: list[str]) -> str:
    return " ".join(html.unescape("".join(parts)).split())


def read_page(page: str) -> tuple[list[Element], list[Block]]:
    """The page's elements, parents first, and its blocks with text in page order."""
    elements, blocks, paths = [Element("", -1, 0, "")], [], {}
    stack, open_, links, pos, n = [0], Counter(), 0, 0, len(page)
    parts: list[str] = []
    linked: list[str] = []
    unseen, depth = "", 0  # an inline element that isn't shown, and how many of its name are open in it

    def end_block() -> None:
        nonlocal parts, linked
        if parts:
            text = _plain(parts)
            if text:
                e = elements[stack[-1]]
                blocks.append(Block(stack[-1], e.path, text, len(_plain(linked)) if linked else 0))
            parts, linked = [], []

    def push(tag: str, attributes: str) -> None:
        dropped, mark, whole, names, main = _read_attributes(tag, attributes)
        kind = f"{tag} {names}" if names else tag
        up = stack[-1]
        path = paths.setdefault((elements[up].path, kind), len(paths) + 1)
        e = Element(tag, up, path, kind)
        e.dropped, e.mark, e.whole_mark, e.named = dropped or tag in NOISE, mark, whole, bool(names)
        e.main = main or tag in ("article", "main")
        elements.append(e)
        stack.append(len(elements) - 1)
        open_[tag] += 1

    def pop_to(k: int) -> None:
        for i in stack[k:]:
            open_[elements[i].tag] -= 1
        del stack[k:]

    while pos < n:
        m = _TAG.search(page, pos)
        text = page[pos : m.start()] if m else page[pos:]
        if text and not unseen:
            parts.append(text)
            if links:
                linked.append(text)
        if m is None:
            break
        pos = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        tag, closing, attributes = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if not closing and tag in RAW and not attributes.endswith("/"):
            end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, pos)
            pos = end.end() if end else n
            continue
        if tag == "br" and not unseen:
            parts.append(" ")
        if tag == "a":
            links = 0 if closing else 1
        if tag not in BLOCK:
            if tag in NOISE:
                if not closing:
                    end_block()
                    push(tag, attributes)
                elif open_[tag]:
                    end_block()
                    pop_to(max(k for k in range(len(stack)) if elements[stack[k]].tag == tag))
            elif unseen:
                depth += (-1 if closing else 1) * (tag == unseen and tag not in VOID)
                unseen = unseen if depth else ""
            elif not closing and tag not in VOID and attributes.strip() and not attributes.endswith("/"):
                dropped, mark, whole, _, _ = _read_attributes("p", attributes)
                if dropped or mark and whole:
                    unseen, depth = tag, 1
            continue
        end_block()
        links, unseen = 0, ""
        if closing:
            if open_[tag]:
                k = len(stack) - 1
                while elements[stack[k]].tag != tag:
                    k -= 1
                pop_to(k)
            continue
        if elements[stack[-1]].tag in CLOSED_BY_BLOCK:
            pop_to(len(stack) - 1)
        if tag in SIBLINGS and any(open_[t] for t in SIBLINGS[tag]):
            for k in range(len(stack) - 1, 0, -1):
                if elements[stack[k]].tag in SIBLINGS[tag]:
                    pop_to(k)
                    break
                if elements[stack[k]].tag in SCOPES:
                    break
        if tag == "body" and elements[stack[-1]].tag == "head":
            pop_to(len(stack) - 1)
        if tag not in VOID and not attributes.endswith("/"):
            push(tag, attributes)
    end_block()
    return elements, blocks


def _settle(elements: list[Element], fallen: set[int] | None) -> None:
    """Set what is noise and what is in <article> or <main>, when the marks in ``fallen`` (None: all) don't count."""
    for i, e in enumerate(elements):
        if e.parent < 0:
            continue
        up = elements[e.parent]
        e.cause = up.cause if up.cause >= 0 else i if e.mark and fallen is not None and i not in fallen else -1
        e.noise = up.noise or e.dropped or e.cause >= 0


def _within_main(elements: list[Element]) -> list[bool]:
    """Which elements are in <article> or <main>, or are one."""
    out = [False] * len(elements)
    for i, e in enumerate(elements[1:], 1):
        out[i] = out[e.parent] or e.main
    return out


def _priors(elements: list[Element], marks: bool) -> list[float]:
    """What multiplies the ratios of an element's blocks: 0 where nothing is shown or is text."""
    out, main, marked = [1.0] * len(elements), _within_main(elements), [False] * len(elements)
    for i, e in enumerate(elements[1:], 1):
        marked[i] = marked[e.parent] or bool(e.mark) or e.tag == "header" and not main[i]
        out[i] = 0.0 if e.dropped or not out[e.parent] else (MAIN_PRIOR if main[i] else 1.0) * (MARK_PRIOR if marks and marked[i] else 1.0)
    return out


def path_ratios(elements: list[Element], blocks: list[Block], marks: bool = True) -> tuple[dict[int, float], dict[int, float], float]:
    """Of each path its fused ratio and the same unsmoothed, and the limit that content paths reach."""
    prior = _priors(elements, marks)
    sums: dict[int, list[float]] = {}
    for b in blocks:
        s = sums.setdefault(b.path, [0.0, 0.0, 0.0])
        s[0] += (len(b.text) - min(b.linked, len(b.text))) * prior[b.at]
        s[1] += b.punctuation * prior[b.at]
        s[2] += 1
    ratio = {p: (length / k, marks / k) for p, (length, marks, k) in sums.items()}
    fused: dict[int, list[float]] = {}
    for i, b in enumerate(blocks):
        length = marks_ = total = 0.0
        for j, w in zip((i - 1, i, i + 1), KERNEL, strict=True):
            if 0 <= j < len(blocks):
                x, y = ratio[blocks[j].path]
                length, marks_, total = length + w * x, marks_ + w * y, total + w
        fused.setdefault(b.path, []).append(length / total * (1 + marks_ / total) if prior[b.at] else 0.0)
    means = {p: sum(v) / len(v) for p, v in fused.items()}
    middle = sum(means.values()) / len(means)
    limit = THRESHOLD * math.sqrt(sum((x - middle) ** 2 for x in means.values()) / len(means))
    return means, {p: x * (1 + y) for p, (x, y) in ratio.items()}, limit


def _content(means: dict[int, float], limit: float) -> set[int]:
    return {p for p, x in means.items() if x > 0 and x >= limit}


def _fallen_marks(elements: list[Element], blocks: list[Block]) -> set[int]:
    """Marks under which nearly all content is, from the outermost inwards.

    Content is measured with no mark counted. A mark of listed words alone (class="comments") falls only if no
    content is left beside it, others (form, post-comments) if ``UNMARKED_SHARE`` is at most; none does
    while an unmarked <article> or <main> holds content.
    """
    _settle(elements, None)
    means, _, limit = path_ratios(elements, blocks, marks=False)
    content = _content(means, limit)
    heavy = [b for b in blocks if b.path in content and not elements[b.at].noise]
    main = _within_main(elements)
    total, fallen = sum(len(b.text) for b in heavy), set()
    while True:
        _settle(elements, fallen)
        rest, alike, causes = 0, Counter(), {}
        for b in heavy:
            cause = elements[b.at].cause
            if cause < 0:
                if main[b.at]:
                    return fallen
                rest += len(b.text)
            else:
                c = elements[cause]
                alike[c.path, c.mark, c.whole_mark] += len(b.text)
                causes.setdefault((c.path, c.mark, c.whole_mark), set()).add(cause)
        best = max(alike, key=alike.get, default=None)
        if best is None or alike[best] < MARKED_SHARE * total or rest > (0 if best[2] else UNMARKED_SHARE * total):
            return fallen
        fallen |= causes[best]


def _container(elements: list[Element], mass: list[int]) -> int:
    """The smallest element that holds the content, going down while one child has ``INNER_SHARE`` of it and
    no sibling of the same kind has any."""
    children: dict[int, list[int]] = {}
    for i, e in enumerate(elements[1:], 1):
        if mass[i]:
            children.setdefault(e.parent, []).append(i)
    top = 0
    while kids := children.get(top):
        best = max(kids, key=mass.__getitem__)
        e = elements[best]
        if e.tag in TEXTUAL or e.tag in LISTS or mass[best] < INNER_SHARE * mass[top] or sum(elements[k].kind == e.kind for k in kids) > 1:
            break
        top = best
    return top


def extract(page: str) -> str:
    """The page's main text: blocks in page order, one line each."""
    elements, blocks = read_page(page)
    if not blocks:
        return ""
    fallen = _fallen_marks(elements, blocks)
    for i in fallen:
        elements[i].mark = ""
    _settle(elements, set())
    means, raw, limit = path_ratios(elements, blocks)
    content = _content(means, limit)

    mass, seen = [0] * len(elements), [0] * len(elements)
    for b in blocks:
        if b.path in content and not elements[b.at].noise:
            mass[b.at] += 0 if b.mere else len(b.text)
            seen[b.at] += len(b.text)
    if not any(mass):
        mass = seen
    for i in range(len(elements) - 1, 0, -1):
        mass[elements[i].parent] += mass[i]
    if not mass[0]:
        return ""
    top = _container(elements, mass)
    whole = elements[top].tag in ("", "html", "body")

    held = [False] * len(elements)
    held[top] = True
    for i, e in enumerate(elements):
        if e.parent < 0 or not held[e.parent] or e.noise or i == top:
            continue
        # the page itself is no container: of what stands in it side by side, only what holds content or is text
        beside = whole and e.tag not in TEXTUAL and e.tag not in LISTS and elements[e.parent].tag in ("", "html", "body") and e.tag != "body"
        held[i] = not beside or mass[i] > 0
    main, out = _within_main(elements), []
    for b in blocks:
        e = elements[b.at]
        if not held[b.at] or e.noise or whole and b.mere and not main[b.at]:
            continue
        if b.at == top or not e.named or e.tag in TEXTUAL or raw[b.path] >= LOW_SHARE * limit:
            out.append(b.text)
    return "\n".join(out)


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of each row of ``pages`` (page_id, url, html).

    A null or empty page, or one without main text, gives an empty text. Character references are
    decoded, white space inside a block becomes one space, blocks are joined by one newline; nothing else
    is dropped or capped. Other columns are ignored; rows are treated one by one.
    """

    def make():
        def call(pages):
            texts = [extract(p.decode()) if p else "" for p in pages]
            return {"text": texts, "n_chars": [len(t) for t in texts]}

        return call

    slim = pages.select("page_id", "url", F.col("html").alias("_html"))
    return with_text_columns(slim, make, "text string, n_chars long", "_html", drop_text=True)
