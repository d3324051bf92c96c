"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides blocks by
their length, the density of stop words and the density of link text; blocks that
this leaves open, most of them short, inherit in the second pass the label of the
nearest decided neighbours. A letter of a script without spaces counts as three.
Where no list of stop words fits an element, length and links decide alone; a block
of hardly any known word (code, names, another language) is left open.

Elements that can't belong to an article (menus, adverts, reader comments and so on)
are left out before by their names, roles and classes. Most classes, and forms, are
hints that are weighed against what they would drop: an element that holds most of
the page's prose stays. If a page has no good block but in what hints leave out,
none of them counts.

Markup is scanned once, in time that grows with the page, by the rules of HTML for
tags and attributes. A quote that never ends is part of the value, which then ends at
white space or ``>``; a ``<`` that no ``>`` follows is text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent function words of English, French, German, Spanish.
STOP_WORDS = frozenset(
    """a an and are as at be been but by can for from had has have he her his i if in is it its no not of on or our she so that the their them then there they this to was we were what when which who will with you
    au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui mais ne nous on ou par pas pour que qui sa se ses son sont sur un une vous
    aber als am auch auf aus bei bin bis das dass dem den der die du durch ein eine einem einen einer er es für hat ich ihr im ist mit nach nicht noch nur oder sich sie sind so über um und uns von vor war wie wir zu zum zur
    al como con del el ella entre era es esa ese esta este ha hay las lo los más me mi muy no para pero por se ser si sin sobre su sus también te tu ya y""".split()
)
# Element names.
BLOCK_TAGS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre
    section select summary table tbody td tfoot th thead tr ul""".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LITERAL_TAGS = frozenset("script style textarea title xmp noembed noframes".split())
RAW_TAGS = frozenset("script style textarea title noscript iframe svg math template object canvas noembed noframes xmp audio video".split())
DROPPED_TAGS = frozenset("nav footer aside form select button dialog head menu".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form tablist".split())
# Words in class and id that mark what isn't the article.
DROPPED_WORDS = frozenset(
    """ad adbox ads adslot advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs captcha comment comments commentlist consent cookie cookies copyright disqus footer gdpr header login mainmenu masthead menu modal
    nav navbar navigation newsletter notice overlay pager pagination popup promo promoted promotion readercomments recommended related replies respond share sharing sidebar signup skip social sponsor sponsored subscribe
    submenu subscription toolbar topbar usercomments widget""".split()
)
HEADERS = frozenset("header banner masthead".split())
COMMENTS = frozenset("comment comments commentlist disqus readercomments replies respond usercomments".split())

# Words that hold even for an element with most of the prose, if no word of another kind stands beside them.
FIRM_WORDS = COMMENTS | frozenset(
    """ad adbox ads adslot advert adverts advertisement advertising adsense breadcrumb breadcrumbs captcha consent cookie cookies gdpr mainmenu menu modal nav navbar navigation newsletter pager pagination popup
    promo promoted promotion sponsor sponsored submenu topbar""".split()
)
NEUTRAL_WORDS = frozenset("area author bar block body bottom box container content feed form holder inner item items list main meta module outer panel post root section text thread top unit wrap wrapper".split())

# Words beside one of these tell of a page's state, not of what an element holds.
STATE_WORDS = frozenset("active allowed closed disabled enabled has is layout left no open page right show template with without".split())
HEAD_TAGS = frozenset("base basefont bgsound link meta noframes noscript script style template title head html".split())

#: Elements that hold one block, so that what holds them is what the block belongs to.
LEAF_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre blockquote caption figcaption figure legend summary".split())
LIST_TAGS = frozenset("li dt dd td th option".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

NEXT = re.compile(r">|=\s*([\"']?)")
UNQUOTED = re.compile(r"[^\s>]*")
NAME = re.compile(r"[^\s/>]*")
ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORD_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
EDGES = re.compile(r"^[\W_]+|[\W_]+$")

ANCHOR = re.compile(r"<(/?)a[\s/>]", re.I)
#: Letters of scripts that don't part words by spaces, from Thai to Chinese, Japanese and Korean.
DENSE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff]+")

SHORT = 70
LONG = 200
#: Density of stop words: below the first no list knows the language, from the second on a long block is good, from the third on any.
STOP_NONE, STOP_LOW, STOP_HIGH = 0.05, 0.15, 0.30
LINKS_LOW, LINKS_HIGH = 0.2, 0.5
#: How much of the page's prose an element holds in two blocks or more, or in one, that isn't dropped by a hint.
MOST, NEARLY_ALL = 1 / 2, 2 / 3
CERTAIN, FIRM, HINT = 3, 2, 1


@dataclass
class Block:
    text: str
    root: int
    links: int  # letters of it that are links
    name: str  # its element
    group: int  # the element that it lies in with its like
    label: bool | None = None

    def size(self) -> int:
        """Letters, those of dense scripts counted three times."""
        return len(self.text) + 2 * sum(map(len, DENSE.findall(self.text)))


@dataclass
class _Open:
    name: str
    serial: int
    depth: int  # its place on the stack
    block: bool
    nearest: int  # the depth of the innermost block element, this one included, or -1
    holder: int  # the innermost element that drops, this one included, or 0
    root: int
    group: int
    nested: int = 0  # open elements of this name inside an inline one


def _drops(name: str, attributes: dict[str, str], inside: bool) -> int:
    """Whether an element can't belong to the article: CERTAIN, FIRM (whatever it holds), HINT (to be weighed) or 0; ``inside``: it lies in an article."""
    if name in DROPPED_TAGS:
        return HINT if name == "form" else CERTAIN
    if "hidden" in attributes or (name == "header" and not inside):
        return CERTAIN
    if "style" in attributes and re.search(r"display\s*:\s*none", attributes["style"], re.I):
        return CERTAIN
    role = attributes.get("role", "").lower()
    if role in DROPPED_ROLES:
        return 0 if inside and role == "banner" else CERTAIN
    if name in ("html", "body", "h1"):
        return 0
    most = 0
    for token in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = {w.lower() for w in WORD_PARTS.findall(token)}
        hints = words & DROPPED_WORDS
        if inside:
            hints -= HEADERS
        if name in ("article", "main"):
            hints &= COMMENTS
        if hints and not words & STATE_WORDS:
            alone = all(w in DROPPED_WORDS or w in NEUTRAL_WORDS or w.isdigit() for w in words)
            most = max(most, FIRM if alone and hints & FIRM_WORDS else HINT)
    return most


class _Scanner:
    """Where tags end. What was looked for in vain is not looked for again, so that a page is read once."""

    def __init__(self, html: str):
        self.html, self.missing, self.sound = html, set(), True

    def find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        found = self.html.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def end(self, at: int) -> int:
        """Where the tag ends whose attributes begin at ``at``; -1 if it doesn't."""
        begin = at
        while self.sound:
            found = NEXT.search(self.html, at)
            if not found:
                self.sound = False  # from here on quotes don't count
            elif found[0] == ">":
                return found.start()
            elif found[1] and (close := self.find(found[1], found.end())) >= 0:
                at = close + 1
            else:
                at = UNQUOTED.match(self.html, found.start(1)).end()
        return self.find(">", begin)


def blocks_of(html: str, hints: bool = True) -> list[Block]:
    """The blocks of a page that no dropped element holds, in page order, without labels. ``root``: the outermost article or main element, or 0; ``hints``: whether elements are dropped by hints too."""
    blocks: list[Block] = []
    marks: list[int] = []  # for each block the innermost dropped element that holds it
    holders: dict[int, int] = {0: 0}  # for each dropped element the next outer one
    levels: dict[int, int] = {}
    cancelled: set[int] = set()  # dropped, but they hold the article
    fixed: set[int] = set()  # dropped by their names, even if they hold one
    walked: set[int] = {0}
    stack: list[_Open] = []
    by_name: dict[str, list[_Open]] = {}
    parts: list[str] = []
    link_parts: list[str] = []
    link = -1  # depth at which a link is open
    whole = False  # that link has an end, so that blocks may lie in it
    scan = _Scanner(html)
    serial = at = 0

    def flush() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                links = " ".join(unescape("".join(link_parts)).split()) if link_parts else ""
                inner = stack[-1] if stack else None
                blocks.append(Block(text, inner.root, len(links), stack[inner.nearest].name if inner.nearest >= 0 else "", inner.group) if inner else Block(text, 0, len(links), "", 0))
                marks.append(inner.holder if inner else 0)
            parts.clear()
            link_parts.clear()

    def say(text: str) -> None:
        if text:
            parts.append(text)
            if link >= 0:
                link_parts.append(text)

    def close(depth: int) -> None:
        nonlocal link
        for x in stack[depth:]:
            by_name[x.name].pop()
        del stack[depth:]
        if link > len(stack):
            link = -1

    size = len(html)
    while at < size:
        begin = html.find("<", at)
        if begin < 0:
            say(html[at:])
            break
        say(html[at:begin])
        after = html[begin + 1 : begin + 2]
        if html.startswith("<!--", begin):
            end = scan.find("-->", begin + 2)
            at = size if end < 0 else end + 3
            continue
        if html.startswith("<![CDATA[", begin):
            end = scan.find("]]>", begin)
            say(html[begin + 9 : size if end < 0 else end])
            at = size if end < 0 else end + 3
            continue
        closing = after == "/"
        named = begin + 2 if closing else begin + 1
        letter = html[named : named + 1]
        if after in "!?" and after or closing and not (letter.isascii() and letter.isalpha()):
            end = scan.find(">", begin)
            if end < 0:
                say("&lt;")
            at = begin + 1 if end < 0 else end + 1
            continue
        end = scan.end(named) if letter.isascii() and letter.isalpha() else -1
        if end < 0:
            say("&lt;")
            at = begin + 1
            continue
        at = end + 1
        name_end = NAME.match(html, named).end()
        name, rest = html[named:name_end].lower(), html[name_end:end].strip()
        if name == "br":
            parts.append(" ")
            continue
        block = name in BLOCK_TAGS
        if block:
            flush()
            if link >= 0 and not closing and not whole:
                link = -1
        if closing:
            if name == "a":
                link = -1
            elif by_name.get(name):
                last = by_name[name][-1]
                if not block and last.nested:
                    last.nested -= 1
                else:
                    flush()
                    close(last.depth)
            continue
        if by_name.get("head") and name not in HEAD_TAGS:  # its end tag may be left out
            flush()
            close(by_name["head"][0].depth)
        if name in RAW_TAGS:
            if not rest.endswith("/") and f"</{name}" not in scan.missing:
                found = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
                if found:
                    at = found.end()
                elif name in LITERAL_TAGS:
                    at = size
                else:
                    scan.missing.add(f"</{name}")
            continue
        if name in VOID_TAGS:
            continue
        if block:  # a paragraph ends at the next block
            depth = stack[-1].nearest if stack else -1
            if depth >= 0 and stack[depth].name == "p":
                close(depth)
        attributes = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(rest)} if rest else {}
        if name == "a":
            goes = "href" in attributes and not attributes["href"].startswith("#")
            link = len(stack) if goes else -1
            if goes:
                after_it = ANCHOR.search(html, at) if "<a" not in scan.missing else None
                if after_it is None:
                    scan.missing.add("<a")
                whole = after_it is not None and after_it[1] == "/"
        outer = stack[-1] if stack else None
        root = outer.root if outer else 0
        drops = _drops(name, attributes, root > 0)
        drops = drops if hints or drops == CERTAIN else 0
        serial += 1
        if name in ("article", "main") and not drops:
            holder = outer.holder if outer else 0
            while holder not in walked:
                walked.add(holder)
                if holder not in fixed:
                    cancelled.add(holder)
                holder = holders[holder]
            root = root or serial
        if rest.endswith("/"):
            continue
        if not block and not drops:
            if by_name.get(name):
                by_name[name][-1].nested += 1
            continue
        if not block:
            flush()
        if drops:
            holders[serial] = outer.holder if outer else 0
            levels[serial] = drops
            if name in DROPPED_TAGS and name != "form":
                fixed.add(serial)
        depth = len(stack)
        nearest = depth if block else outer.nearest if outer else -1
        group = outer.group if outer and (name in LEAF_TAGS or not block) else serial
        stack.append(_Open(name, serial, depth, block, nearest, serial if drops else (outer.holder if outer else 0), root, group))
        by_name.setdefault(name, []).append(stack[-1])
    flush()
    if levels:
        cancelled |= _outweighed(blocks, marks, holders, levels, cancelled)
    kept = {0: True}
    for x in sorted(levels):  # outer elements come first
        kept[x] = x in cancelled and kept[holders[x]]
    return [b for b, mark in zip(blocks, marks, strict=True) if kept[mark]]


def _outweighed(blocks: list[Block], marks: list[int], holders: dict[int, int], levels: dict[int, int], cancelled: set[int]) -> set[int]:
    """Elements dropped by a hint that hold most of the prose that nothing firmer drops."""
    prose, number = dict.fromkeys(holders, 0), dict.fromkeys(holders, 0)
    barred = {0: False}
    for x in sorted(levels):
        barred[x] = barred[holders[x]] or levels[x] >= FIRM and x not in cancelled
    for b, mark in zip(blocks, marks, strict=True):
        if not barred[mark] and (n := b.size()) >= SHORT and b.links <= LINKS_HIGH * len(b.text):
            prose[mark] += n
            number[mark] += 1
    for x in sorted(levels, reverse=True):  # inner elements first
        prose[holders[x]] += prose[x]
        number[holders[x]] += number[x]
    return {x for x, level in levels.items() if level == HINT and prose[x] > (MOST if number[x] > 1 else NEARLY_ALL) * prose[0]}


def _stops(text: str) -> float:
    words = text.lower().split()
    return sum(w in STOP_WORDS or EDGES.sub("", w) in STOP_WORDS for w in words) / len(words)


def _first_pass(blocks: list[Block]) -> None:
    """Label the blocks that length, links and stop words decide."""
    linked = [b.links > LINKS_HIGH * len(b.text) for b in blocks]
    decided = []
    for k, b in enumerate(blocks):
        if linked[k]:
            beside = any(0 <= j < len(blocks) and linked[j] and blocks[j].root == b.root for j in (k - 1, k + 1))
            alone = not beside and (b.name in HEADINGS or b.root and b.name not in LIST_TAGS)
            b.label = None if alone else False
        elif (n := b.size()) >= SHORT:
            decided.append((b, n, _stops(b.text)))
    fits = {b.group for b, _, stops in decided if stops >= STOP_LOW}  # some list of stop words is of the element's language
    for b, n, stops in decided:
        if b.group not in fits:
            b.label = True if n >= LONG and b.links <= LINKS_LOW * len(b.text) else None
        elif stops >= STOP_HIGH or (stops >= STOP_LOW and n >= LONG):
            b.label = True
        elif STOP_NONE <= stops < STOP_LOW and not b.root:
            b.label = False


def main_text(html: str | None) -> str:
    """The article's blocks, joined by line feeds.

    Neighbours are looked for in the same article or main element. If the nearest
    decided blocks on either side differ, the nearer one counts, and the good one
    if they are as near. Without any decided neighbour a block is good, unless the
    page has an article elsewhere. Where an article or main element holds good
    blocks, blocks outside are bad. If nothing is good, hints don't count.
    """
    for hints in (True, False):
        blocks = _labelled(blocks_of(html or "", hints))
        if blocks:
            break
    return "\n".join(b.text for b in blocks)


def _labelled(blocks: list[Block]) -> list[Block]:
    """The good blocks."""
    _first_pass(blocks)
    by_root: dict[int, list[Block]] = {}
    for b in blocks:
        by_root.setdefault(b.root, []).append(b)
    for root, own in by_root.items():
        decided = [k for k, b in enumerate(own) if b.label is not None]
        labels = {k: own[k].label for k in decided}
        place = 0
        for k, b in enumerate(own):
            if b.label is not None:
                place += 1
                continue
            before = decided[place - 1] if place else None
            after = decided[place] if place < len(decided) else None
            if before is None and after is None:
                b.label = bool(root) or not any(by_root)
            elif before is None or after is None:
                b.label = labels[after if before is None else before]
            elif labels[before] == labels[after]:
                b.label = labels[before]
            else:
                b.label = labels[before] if k - before < after - k else labels[after] if after - k < k - before else True
    if any(b.label and b.root for b in blocks):
        blocks = [b for b in blocks if b.root]
    return [b for b in blocks if b.label]


def extract(pages: DataFrame, html: str = "html", carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``carry``, ``text`` and ``n_chars`` of every page, from its whole html.

    A null or empty html gives an empty text; broken markup and very long pages
    take time that grows with their length. Repeated rows give repeated rows, an
    empty table an empty result; columns that aren't named aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [main_text(x.as_py()) for x in part.column(0)]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*part.schema.names[1:], "text", "n_chars"])

    chosen = pages.select(F.col(html).alias("__html"), *carry)
    return chosen.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[1:]] + ["text string", "n_chars long"]))
