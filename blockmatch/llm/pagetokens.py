"""HTML pages as streams of block tokens, tolerant of missing end tags.

A stream alternates tags that shape the page and texts.  Inline tags (``b``,
``a``, ``span`` ...) are part of the text they stand in; ``br`` is white space
there.  Start tags of elements whose end tag may be left out (``p``, ``li`` ...)
stand for the whole element.  Every text carries a label from its surroundings:
``a`` inside an article, ``c`` inside another content landmark, ``u`` outside of
any, ``b`` in menus, headers, footers, sidebars, notices, adverts, forms,
comments and other elements that are not the page's text.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import Counter, defaultdict
from html import unescape

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(?P<raw>script|style|title|textarea|iframe|xmp|noembed|noframes)(?=[\s/>]).*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>|[^<>]*>)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORD = re.compile(r"[A-Za-z]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Start tags that end an open element of the same row, up to the elements after the bar.
_IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    **dict.fromkeys(("dt", "dd"), (frozenset(["dt", "dd"]), frozenset(["dl"]))),
    **dict.fromkeys(("td", "th"), (frozenset(["td", "th"]), frozenset(["tr", "table"]))),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table", "tbody", "thead", "tfoot"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
_SHORT = frozenset("p li dt dd td th tr option thead tbody tfoot".split())
_SECTION = frozenset("article main section header footer nav aside h1".split())
_SKIPPED = frozenset("nav header footer aside form head noscript template svg math object canvas audio video button select option label fieldset dialog menu".split())
_SKIP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
_SKIP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs "
    "sidebar footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login comment comments disqus "
    "respond replies related recommended share sharing social widget toolbar pagination pager".split()
)
_COMMENT_WORDS = frozenset("comment comments disqus respond replies".split())
_CONTENT = frozenset("entry-content post-content article-content article-body post-body story-body main-content page-content content main article post story articlebody".split())


def _attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(rest)} if "=" in rest else {}


def _role(name: str, rest: str) -> tuple[str, str]:
    """What an element is (``b``, ``a``, ``c`` or nothing of note), and its name for alignment."""
    found = _attributes(rest)
    named = f"{found.get('class', '')} {found.get('id', '')}".lower()
    symbol = name + re.sub(r"\d+", "0", "".join(f".{c}" for c in sorted(found.get("class", "").split())))
    words = set(_WORD.findall(named))
    if name in ("html", "body"):
        return "", symbol
    if name in ("article", "main"):
        return ("b" if words & _COMMENT_WORDS else "a" if name == "article" else "c"), symbol
    role = found.get("role", "").lower()
    hidden = re.search(r"(?:^|\s)hidden(?:[\s/>]|$)", rest) or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I)
    if name in _SKIPPED or role in _SKIP_ROLES or words & _SKIP_WORDS or hidden:
        return "b", symbol
    if role == "article" or found.get("itemprop") == "articleBody":
        return "a", symbol
    if role == "main" or not _CONTENT.isdisjoint(named.split()):
        return "c", symbol
    return "", symbol


def tokens(html: str | None) -> list[tuple[str, str | None]]:
    """(symbol, text) of a page; the symbol of a text is ``#`` and its label, tags have no text."""
    html = html or ""
    out: list[tuple[str, str | None]] = []
    stack: list[tuple[str, str, str]] = []  # name, role, symbol
    depth = Counter()
    ends = Counter(m["name"].lower() for m in _TOKEN.finditer(html) if m["end"])
    kept: list[str] = []
    dropped = False
    # Places in the stack: of each name, of all that aren't inline, of skipped elements whose end tag never comes.
    places: dict[str, list[int]] = defaultdict(list)
    blocks: list[int] = []
    loose: list[int] = []

    def label() -> str:
        return "b" if depth["b"] else "a" if depth["a"] else "c" if depth["c"] else "u"

    def flush() -> None:
        nonlocal kept, dropped
        text = " ".join("".join(kept).split())
        if text:
            out.append((f"#{label()}", text))
        elif dropped:
            out.append(("#b", ""))
        kept, dropped = [], False

    def close(k: int) -> None:
        """End all elements from the k-th open one on."""
        while len(stack) > k:
            name, role, symbol = stack.pop()
            places[name].pop()
            for marked in (blocks, loose):
                if marked and marked[-1] == len(stack):
                    marked.pop()
            if name not in _INLINE and name not in _SHORT:
                flush_under(symbol)
            if role:
                depth[role] -= 1

    def flush_under(symbol: str) -> None:
        flush()
        out.append((f"/{symbol}", None))

    def text(piece: str) -> None:
        nonlocal dropped
        if not piece:
            return
        if depth["b"]:
            dropped = dropped or not piece.isspace()
            if not kept and dropped:
                return
            kept.append(" ")
        else:
            kept.append(unescape(piece))

    at = 0
    for m in _TOKEN.finditer(html):
        text(html[at : m.start()])
        at = m.end()
        name = m["name"] and m["name"].lower()
        if not name:
            continue
        if m["end"]:
            ends[name] -= 1
            if places[name]:
                k = places[name][-1]
                if blocks and blocks[-1] >= k:
                    flush()
                close(k)
            elif name not in _INLINE:
                flush()
            continue
        inline = name in _INLINE
        if not inline:
            flush()
            if name in _SECTION and loose:
                close(loose[0])
            if blocks and stack[blocks[-1]][0] == "p":
                close(blocks[-1])
            if name in _IMPLIED:
                same, limit = _IMPLIED[name]
                low = max((places[x][-1] for x in limit if places[x]), default=-1)
                first = [places[x][bisect(places[x], low)] for x in same if places[x] and places[x][-1] > low]
                if first:
                    close(min(first))
        elif name == "br":
            text(" ")
        role, symbol = _role(name, m["rest"])
        if name in _VOID or m["rest"].endswith("/>") and name not in _SECTION:
            if not inline and name != "hr":
                continue
            if name == "hr":
                out.append(("hr", None))
            continue
        if not inline:
            out.append((symbol, None))
        if role:
            depth[role] += 1
        places[name].append(len(stack))
        if not inline:
            blocks.append(len(stack))
        if role == "b" and ends[name] <= 0:
            loose.append(len(stack))
        stack.append((name, role, symbol))
    text(html[at:])
    flush()
    return out
