"""Main text of web pages: flat text blocks, described by their word counts and link densities, those of two neighbours on
either side, and the regions they stand in, kept or dropped by a decision tree that is trained on a small labelled table.

Regions come from elements (nav, footer, article) and from words in class, id or role that name one clearly. Words such as
`banner` or `share` only give a hint: text and links around a block decide there, and on pages without any markup.

The table is the blocks of a few short pages below, each with its label; the tree is fitted on the driver in milliseconds
and sent with the tasks. Pages are read one by one where they lie: nothing is shuffled.

Defined results: a null page is empty and gives the text '' with 0 characters; unclosed tags end with their container;
unclosed comments, scripts, styles, titles, text areas and frames reach to the end of the page; of buttons, lists to select from,
drawings and the like only closed ones are dropped, so that an unclosed one takes no text along; rows with the same id stay rows of their own; an empty
table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_rows

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<svg(?![\w:-])(?:[^>"']++|"[^"]*+"|'[^']*+')*+(?<=/)>|<(script|style|textarea|title|iframe)(?![\w:-])[^>]*+>.*?(?:</\1\s*>|\Z)|<(noscript|template|svg|select|button|object)(?![\w:-])[^>]*+>[^<]*+(?:<(?!/?\2(?![\w:-]))[^<]*+)*+</\2\s*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?/][^>]*+>|<[a-zA-Z][^>]*+>|[^<]++|<""", re.S | re.I)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)\s*+(?:=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
#: Elements that end the text block before and after them.
BREAKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose region holds until their end tag.
REGIONS = frozenset("article aside body center dialog div fieldset figure footer form header main menu nav ol section table td ul".split())
SIDE = frozenset("nav footer aside form menu dialog fieldset".split())
#: Elements that are never beside the article by a word alone, nor is what holds one of them.
CORE = frozenset("article main h1".split())
#: Elements whose articles are teasers: these neither end the side region nor speak for what is around it.
TEASERS = frozenset("aside footer".split())
#: Words in class, id or role that name a region beside the article.
_SIDE_WORD = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adv|sponsor\w*|cookies?|consent|notice|gdpr|side-?bar|nav|navbar|navigation|navigation-?bar|breadcrumbs?|footer|foot|site-?header|masthead|comments?|comment-?list|replies|disqus|related|recommended|newsletter|subscribe|subscription|pagination|pager|copyright|complementary|contentinfo)(?:$|[\s_-])", re.I)
#: Words that may name such a region or a kind of story.
_HINT_WORD = re.compile(r"(?:^|[\s_-])(?:alert|banner|login|menu|modal|overlay|popup|promo\w*|search|share|sharing|signup|social|toolbar|topbar|widget)(?:$|[\s_-])", re.I)
_MAIN_WORD = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|content|main|body-?text|article-?body|post-?content)(?:$|[\s_-])", re.I)
#: Words that tell how a page is laid out, not what an element is.
_STATE = re.compile(r"(?:^|(?<=\s))(?:(?:has|no|not|with|without)[_-]\S+|\S+[_-](?:open|opened|closed|enabled|disabled))(?=\s|$)", re.I)
_REPLY = re.compile(r"(?:^|\s)(?:comment|comment-?body|reply)(?:$|\s)", re.I)


def _names(attrs: str) -> str:
    """The values of class, id and role, without words of layout."""
    found = " ".join(a or b or c for n, a, b, c in _ATTRIBUTE.findall(attrs) if n.lower() in ("class", "id", "role")) if attrs else ""
    return _STATE.sub("", found) if found else ""


def _reply(name: str, names: str) -> bool:
    """Whether an article is one reader's comment."""
    return name == "article" and bool(_REPLY.search(names)) and not _MAIN_WORD.search(names)


def _beside(name: str, names: str, words: re.Pattern = _SIDE_WORD) -> bool:
    """Whether the words of an element name something beside the article."""
    if name in ("html", "body") or name in CORE and not _reply(name, names):
        return False
    return bool(names and words.search(names))


def _holders(page: str) -> set[int]:
    """Where the regions start that hold an article, a main element or an h1. Readers' comments don't count, nor do articles
    in a region named as beside the article when an article came before it."""
    out: set[int] = set()
    stack: list[list] = [["", -1, True, False, False]]  # element, start, named as beside, an article before it, one in it
    named_, open_, with_article = [stack[0]], Counter(), 0  # open elements that are named, all by name, and those with an article
    full: set[int] = set()  # marked by a main element or an h1, whose walk goes as far as any
    for m in _TOKEN.finditer(page):
        if m[4] is None:
            continue
        name = m[4].lower()
        if m[3]:
            while name in REGIONS and open_[name]:
                top = stack.pop()
                open_[top[0]] -= 1
                if top[2]:
                    named_.pop()
                    with_article -= top[4]
                if top[0] == name:
                    break
            continue
        if name not in REGIONS and name not in CORE:
            continue
        names = _names(m[5])
        if name in CORE and not _reply(name, names):
            for above in reversed(stack):
                # What a walk from here has marked, it has marked all that lies above.
                if above[0] in TEASERS or name == "article" and above[3] or above[1] in full or name == "article" and above[1] in out:
                    break
                out.add(above[1])
                if name != "article":
                    full.add(above[1])
            if name != "h1" and not named_[-1][4]:
                named_[-1][4] = True
                with_article += 1
        if name in REGIONS and not m[5].rstrip().endswith("/"):
            named = _beside(name, names)
            stack.append([name, m.start(), named, named and with_article > 0, False])
            open_[name] += 1
            if named:
                named_.append(stack[-1])
    return out


@dataclass
class Block:
    text: str
    words: int
    linked: int
    side: int
    inside: int
    heading: int
    hint: int


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order."""
    out: list[Block] = []
    stack: list[tuple[str, int, int, bool, int]] = []  # element, what it adds to the side regions, whether an article, beside by its words, by a hint
    holders: set[int] | None = None
    side = inside = links = own = heading = hint = own_hint = shut = 0  # shut: open teasers and regions beside the article
    open_: Counter = Counter()
    parts: list[str] = []
    linked: list[str] = []

    def flush() -> None:
        nonlocal own, heading, own_hint
        if parts:
            words = html.unescape("".join(parts)).split()
            if words:
                n = len(html.unescape("".join(linked)).split()) if linked else 0
                out.append(Block(" ".join(words), len(words), min(n, len(words)), int(side > 0 or own > 0), int(inside > 0), heading, int(hint > 0 or own_hint > 0)))
            parts.clear()
            linked.clear()
        own = heading = own_hint = 0

    for m in _TOKEN.finditer(page):
        name = m[4]
        if name is None:
            s = m[0]
            if s[0] != "<" or s == "<":
                parts.append(s)
                if links:
                    linked.append(s)
            continue
        name, ends, attrs = name.lower(), bool(m[3]), m[5]
        if name == "a":
            links = 0 if ends else 1
            continue
        if name not in BREAKS:
            continue
        flush()
        if ends:
            if name in REGIONS and open_[name]:
                while True:
                    top, a, b, away, c = stack.pop()
                    open_[top] -= 1
                    side -= a
                    inside -= b
                    hint -= c
                    shut -= top in TEASERS or away
                    if top == name:
                        break
                links = 0
            continue
        names = _names(attrs)
        beside, hinted = _beside(name, names), _beside(name, names, _HINT_WORD)
        if name in REGIONS:
            if beside or hinted or name == "form":
                holders = _holders(page) if holders is None else holders
                beside, hinted = beside and m.start() not in holders, hinted and m.start() not in holders
            a = int(beside or name in SIDE and not (name == "form" and m.start() in holders) or name == "header" and not inside)
            if name == "main" or name == "article" and not beside and not shut:
                a = -side  # the article starts anew, whatever is open around it
            b = int(name in ("article", "main") or bool(names and not beside and _MAIN_WORD.search(names)))
            if not attrs.rstrip().endswith("/"):
                stack.append((name, a, b, beside, int(hinted)))
                open_[name] += 1
                shut += name in TEASERS or beside
                side += a
                inside += b
                hint += hinted
        else:
            own, own_hint = int(beside), int(hinted)
            heading = int(len(name) == 2 and name[0] == "h" and name[1] in "123456")
    flush()
    return out


NEIGHBOURS = (-1, 1, -2, 2)


def features(found: list[Block]) -> list[tuple[float, ...]]:
    """Words and link density of the block and of its neighbours, whether a heading, then whether hinted at as beside the
    article, in a region beside it, in a region of it. Beyond the ends of a page stand blocks of no words and no links."""
    own = [(float(b.words), b.linked / b.words) for b in found]
    near = lambda i: own[i] if 0 <= i < len(own) else (0.0, 0.0)
    return [(*own[i], *(x for d in NEIGHBOURS for x in near(i + d)), float(b.heading), float(b.hint), float(b.side), float(b.inside)) for i, b in enumerate(found)]


# The labelled table: pages and the labels of their blocks in order, 1 for main text.
_LONG = "The council met on Tuesday to hear the plans for the new bridge over the river and to weigh what it would cost. "
LABELLED: tuple[tuple[str, str], ...] = (
    ("<nav><ul><li><a>Home</a><li><a>News</a><li><a>About us</a></ul></nav><article><h1>A new bridge</h1><p>" + _LONG * 3 + "<p>Yes.<p>" + _LONG + "</article><footer>All rights kept, " + _LONG + "</footer>", "000" "1111" "0"),
    ("<div class=ad>Buy this now and save more than ever before today</div><article><h1>Short</h1><p>One.<p><a>A linked line</a><p>Two words.</article><div class='comments'><p>" + _LONG + "<p>I agree with this.</div>", "0" "1111" "00"),
    ("<header><h1>The Daily Paper</h1><p>News for all of the town since 1901</header><main><h2>Weather</h2><p>" + _LONG + "<ul><li>Rain<li>Wind</ul></main><aside><h3>Most read</h3><p>" + _LONG * 2 + "</aside>", "00" "1111" "00"),
    ("<div><a>Home</a> <a>Shop</a> <a>Contact</a></div><h1>How bread is made</h1><p>" + _LONG * 2 + "</p><p>" + _LONG * 4 + "</p><p>" + _LONG * 2 + "</p><div><a>Older posts</a> <a>Newer posts</a></div>", "0" "1111" "0"),
    ("<div><a>One</a></div><div><a>Two</a></div><p>" + _LONG * 5 + "</p><p>" + _LONG * 2 + "See <a>this page</a> too.</p><div><a>Terms</a></div><div>c 2020</div>", "00" "11" "00"),
    ("<form><p>Sign up to our letter and get all the news first each day</p></form><article><p>" + _LONG * 2 + "<p>Ten of <a>these</a><p><a>All</a> of it</article><form>Send</form>", "0" "111" "0"),
    ("<div id=cookie-notice><p>" + _LONG + "</p><p>Accept</p></div><section class=post-content><h2>Part one</h2><p>" + _LONG * 2 + "<p>End.</section><div class=related><a>More of this</a><p>" + _LONG + "</div>", "00" "111" "00"),
    ("<main><p>Start.<nav><a>Up</a></nav><p>" + _LONG + "<footer>By the desk, " + _LONG + "</footer><p>Last.</main>", "1" "0" "1" "0" "1"),
    ("<p>Menu</p><p><a>a</a> <a>b</a></p><p>" + _LONG * 3 + "</p><p>" + _LONG * 3 + "</p><p><a>Back</a></p>", "00" "11" "0"),
    # Pages without any region.
    ("<body><p>" + _LONG * 2 + "</p></body>", "1"),
    ("<p>" + _LONG * 4 + "</p><p>" + _LONG + "</p><p>" + _LONG * 2 + "</p>", "111"),
    ("<h1>On the river</h1><p>" + _LONG + "</p><p>So they said.</p><p>" + _LONG * 2 + "</p><p>" + _LONG + "</p>", "11111"),
    ("<p>Home News Sport</p><p>" + _LONG * 2 + "</p><p>No.</p><p>" + _LONG + "</p><p>c 2021 The Paper</p>", "0" "111" "0"),
    ("<p><a>Home</a></p><p><a>News</a></p><h2>Rain again</h2><p>" + _LONG + "</p><p>" + _LONG + "</p><p><a>" + _LONG + "</a></p><p><a>More</a></p>", "00" "111" "00"),
    ("<p>" + _LONG + "</p><p>By <a>the desk</a> in town</p><p>" + _LONG * 3 + "</p><p><a>Up</a> <a>Down</a></p>", "111" "0"),
    # Regions that are only hinted at.
    ("<div class=banner><p>Save more than ever today</p></div><article><p>" + _LONG + "<p>Well.</article><div class=share><p><a>Mail</a> <a>Print</a></p></div>", "0" "11" "0"),
    ("<div class='promo-story'><h2>A bridge</h2><p>" + _LONG * 2 + "</p><p>" + _LONG + "</p></div><div class=toolbar>Bigger Smaller</div>", "111" "0"),
    ("<div class=menu><a>Soup</a> <a>Bread</a></div><div class=search>Find</div><p>" + _LONG * 2 + "</p><p>" + _LONG * 2 + "</p><div class=widget>Hits 4711</div>", "00" "11" "0"),
    ("<div class='menu-of-the-week'><p>" + _LONG + "</p><p>" + _LONG * 3 + "</p><p>" + _LONG + "</p></div>", "111"),
    ("<div class=popup><p>Join us now</p><p><a>Yes</a></p></div><p>" + _LONG * 2 + "</p>", "00" "1"),
)


def labelled_table() -> list[tuple[tuple[float, ...], int]]:
    rows = []
    for page, labels in LABELLED:
        found = features(blocks(page))
        if len(found) != len(labels):
            raise ValueError("a label for each block")
        rows += list(zip(found, map(int, labels), strict=True))
    return rows


Tree = tuple  # (feature, threshold, left, right) or (share of main text,)


def grow(rows: list[tuple[tuple[float, ...], int]], depth: int = 8) -> Tree:
    """A decision tree by Gini impurity; the first feature and lowest threshold win ties."""
    ones = sum(y for _, y in rows)
    if not depth or ones in (0, len(rows)):
        return (ones / len(rows),)
    best = None
    for f in range(len(rows[0][0])):
        order = sorted(rows, key=lambda r: r[0][f])
        left = 0
        for i in range(1, len(order)):
            left += order[i - 1][1]
            if order[i][0][f] == order[i - 1][0][f]:
                continue
            right, n, m = ones - left, i, len(order) - i
            impurity = left * (n - left) / n + right * (m - right) / m
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, (order[i][0][f] + order[i - 1][0][f]) / 2)
    if best is None:
        return (ones / len(rows),)
    _, f, t = best
    return (f, t, grow([r for r in rows if r[0][f] <= t], depth - 1), grow([r for r in rows if r[0][f] > t], depth - 1))


def share(tree: Tree, x: tuple[float, ...]) -> float:
    while len(tree) > 1:
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree[0]


def main_text(page: str | None, tree: Tree) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, x in zip(found, features(found), strict=True) if share(tree, x) >= 0.5)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", tree: Tree | None = None) -> DataFrame:
    """One row per page: its columns without the html, then text and n_chars (code points)."""
    arrow_rows(pages.sparkSession)
    model = tree or grow(labelled_table())
    kept = [c for c in dict.fromkeys([id_col, "url"]) if c in pages.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p, model) for p in b.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*kept, "text", "n_chars"])

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept)
    return pages.select(*kept, html_col).mapInArrow(run, f"{kinds}, text string, n_chars bigint")
