"""Main text of web pages by wrappers inferred per host.

A wrapper is a union-free regular expression over a host's elements: elements
and text slots in sequence, of which some are optional or repeated. Each page
is folded (adjacent alike runs become a repeated group); the distinct forms of
a host are aligned one by one, and what only one side has becomes optional, or
makes its neighbour a repeated group if it is like it.

Then every page is matched against its host's wrapper, and each slot of the
wrapper gets, over all pages of the host, its number of pages, of different
values and of characters in links. From these the wrapper's elements get their
roles: the container with the varying text is the article, text that is
constant over a host's pages is furniture, repeated groups of links are menus.
Element names and, last, words of class names decide where that says nothing,
as on hosts of few pages. Pages are read by their host's wrapper and roles."""

from __future__ import annotations

import functools
import html as entities
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapewright.llm.common import each, materialise

# Element names by what they mean for extraction.
VOID = "area base basefont bgsound br col embed frame hr img input link meta param source track wbr".split()
RAW = "script style title textarea iframe noembed noframes xmp".split()
INLINE = """a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math nobr q s samp small span strike strong sub sup time tt u var
menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder
munderover""".split()
FURNITURE = "head nav footer aside form menu dialog fieldset template noscript svg select option optgroup datalist button".split()
CONTENT = "article main".split()
#: Elements that end where an article begins.
BARS = "nav header menu form button noscript svg select option datalist".split()
#: Elements of running text: a list of them is one repeated slot, and a constant one inside an article belongs to it.
FLOW = "p li dt dd td th tr h1 h2 h3 h4 h5 h6 blockquote pre figcaption caption summary address".split()
#: Elements that end where another of the second kind begins.
ENDS = {"p": (), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th", "tr"), "th": ("td", "th", "tr"), "tr": ("tr",), "option": ("option", "optgroup")}
#: Words of class, id or role that mark furniture, those that do so as the last word only, and those that mark the main content.
FURNITURE_WORDS = """ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments complementary
consent contentinfo cookie cookies copyright disqus footer masthead menu nav navbar navigation newsletter popup promo
promoted promotion related replies reply share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar
widget widgets""".split()
LAST_WORDS = "banner form header notice notices skip".split()
CONTENT_WORDS = "article articlebody content entry entrycontent main maincontent mainbody post postbody postcontent story".split()
#: Forms that are aligned in one group, on average: a host's forms are folded in rounds, so that no task folds them all.
FORMS = 64
#: Items of a sequence beyond which it becomes a repeated group of optional items, and items of that beyond which marks are left out.
LONG, LOOSE = 64, 256
#: Nesting beyond which an element is a block boundary only.
DEEP = 60
#: Different pages that a slot must be on to count as constant, the share of different values that is still constant,
#: and the share of a host's text that must vary for its statistics to say anything.
SEEN, CONSTANT, VARYING = 4, 0.1, 0.3

OPTIONAL, REPEATED = 1, 2

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SETS = {k: frozenset(v) for k, v in dict(void=VOID, raw=RAW, inline=INLINE, furniture=FURNITURE, content=CONTENT, flow=FLOW, fwords=FURNITURE_WORDS, lwords=LAST_WORDS, cwords=CONTENT_WORDS).items()}
_HEADINGS = frozenset(f"h{i}" for i in range(1, 7))


@functools.lru_cache(4096)
def _mark(attributes: str) -> str:
    """The class, id and role of a tag, lower-case, digits dropped."""
    found = [a or b or c for _, a, b, c in _ATTRIBUTE.findall(attributes)] if attributes else []
    return " ".join(re.sub(r"\d+", "", " ".join(found).lower()).split())


def tokens(page: str):
    """("open", name, mark) / ("close", name, "") / ("text", text, "") of a page.

    Contents of raw elements are skipped to their end tag; an end tag in a
    script's string doesn't end anything else."""
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            yield "text", page[at:], ""
            return
        if m.start() > at:
            yield "text", page[at : m.start()], ""
        at = m.end() if m.end() > m.start() else m.start() + 1
        name = (m[2] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                yield "text", entities.escape(m[0][9:].removesuffix("]]>")), ""
            continue
        if m[1]:
            yield "close", name, ""
            continue
        if name in _SETS["raw"] and not m[3].rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        yield "open", name, _mark(m[3])


def tree(page: str) -> list:
    """The page's elements: an element is [key, children, name], a text slot
    ["#", parts, characters in links]. Inline elements without a mark are part
    of the text; marked ones are elements. A part None is a block boundary."""
    root: list = []
    stack = [["", root, ""]]
    links = 0

    def text(part, in_link):
        held = stack[-1][1]
        if not held or held[-1][0] != "#":
            held.append(["#", [], 0])
        held[-1][1].append(part)
        held[-1][2] += in_link

    def innermost(names, until=()):
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][2] in names:
                return i
            if stack[i][2] in until:
                return 0
        return 0

    for kind, name, mark in tokens(page):
        if kind == "text":
            text(name, len(name) if links else 0)
            continue
        inline = name in _SETS["inline"]
        if kind == "open":
            if name in _SETS["void"]:
                if name in ("br", "hr"):
                    text(None if name == "hr" else " ", 0)
                continue
            if name == "a":
                links = 1
            if inline and not mark:
                continue
            if not inline:
                if name in _SETS["content"]:  # what can't hold an article was left open
                    i = innermost(BARS, ("article", "main", "section", "div"))
                    if i:
                        del stack[i:]
                if (i := innermost(ENDS.get(name, ()), ("ul", "ol", "dl", "table", "select", "datalist"))) or (i := innermost(("p",), ("div", "td", "li", "article", "section", "table"))):
                    del stack[i:]
            if len(stack) > DEEP:
                text(None, 0)
                stack.append(["", stack[-1][1], name])
                continue
            node = [f"<{name} {mark}>" if mark else f"<{name}>", [], name]
            stack[-1][1].append(node)
            stack.append(node)
        else:
            if name == "a":
                links = 0
            if inline:
                i = len(stack) - 1
                while i > 0 and stack[i][2] in _SETS["inline"] and stack[i][2] != name:
                    i -= 1
                if i > 0 and stack[i][2] == name:
                    del stack[i:]
                continue
            i = innermost((name,))
            if i:
                if not stack[-1][0]:
                    text(None, 0)
                del stack[i:]
    return root


def _blank(slot) -> bool:
    return not any(x and not x.isspace() for x in slot[1])


# --- expressions ---

# An expression is a tuple of items (key, flags, items): an element, a text slot (key "#") or a group (key "").


def _shape(nodes: list):
    """The folded expression of a tree's nodes."""
    return fold([("#", 0, ()) if x[0] == "#" else (x[0], 0, _shape(x[1])) for x in nodes if x[0] != "#" or not _blank(x)])


def stream(page: str):
    """The page's folded expression."""
    return _shape(tree(page))


def _name(key: str) -> str:
    return key[1:].partition(" ")[0].rstrip(">")


def _alike(a, b) -> bool:
    """Whether two neighbours are one repeated item: running text by name, marked
    elements by their children's keys, others only if they are equal."""
    if a[0] != b[0] or a[0] == "#":
        return False
    if a[0] == "":
        return [x[0] for x in a[2]] == [x[0] for x in b[2]]
    if _name(a[0]) in _SETS["flow"] or a[2] == b[2]:
        return True
    return " " in a[0] and {x[0] for x in a[2]} == {x[0] for x in b[2]}


def _merged(a, b, flags: int = 0):
    return a[0], a[1] | b[1] | flags, a[2] if a[2] == b[2] else align(a[2], b[2])


def _loose(items):
    """A sequence as one repeated group of optional items, one for each key."""
    held: dict = {}
    stack = list(reversed(items))
    while stack:
        x = stack.pop()
        if x[0] == "":
            stack.extend(reversed(x[2]))
        else:
            held[x[0]] = _merged(held[x[0]], x) if x[0] in held else x
    if len(held) > LOOSE:
        bare: dict = {}
        for key, x in held.items():
            key = key if key == "#" else f"<{_name(key)}>"
            bare[key] = _merged(bare[key], (key, *x[1:])) if key in bare else (key, *x[1:])
        held = bare
    return (("", REPEATED, tuple((k, OPTIONAL, held[k][2]) for k in sorted(held))),)


def _is_loose(items) -> bool:
    return len(items) == 1 and items[0][0] == "" and bool(items[0][2]) and all(x[1] & OPTIONAL for x in items[0][2])


def fold(items):
    """Adjacent alike runs as one repeated item or group, short runs first."""
    out: list = []
    for item in items:
        out.append(item)
        again = True
        while again:
            again = False
            for w in range(1, len(out)):
                last = out[-w - 1]
                if w > 1 and last[0] == "" and last[1] & REPEATED and len(last[2]) == w and all(x[0] == y[0] for x, y in zip(last[2], out[-w:])):
                    out[-w - 1 :] = [("", last[1], tuple(_merged(x, y) for x, y in zip(last[2], out[-w:])))]
                    again = True
                    break
                if 2 * w > len(out) or out[-1][0] != last[0]:
                    continue
                pairs = list(zip(out[-2 * w : -w], out[-w:]))
                if w == 1 and _alike(*pairs[0]):
                    out[-2:] = [_merged(*pairs[0], REPEATED)]
                elif w > 1 and all(x[0] == y[0] and (x[0] == "#" or _alike(x, y)) for x, y in pairs):
                    out[-2 * w :] = [("", REPEATED, tuple(_merged(x, y) for x, y in pairs))]
                else:
                    continue
                again = True
                break
        if len(out) > LONG:
            out = list(_loose(out))
    return _loose(out) if len(out) > 1 and any(_is_loose((x,)) for x in out) and len(out) > LONG // 2 else tuple(out)


def _key(item) -> str:
    return item[0] or "+".join(x[0] for x in item[2])


def align(a, b):
    """An expression that covers both: equal keys stay, what only one side has is
    optional or, next to its like, makes that a repeated item."""
    import difflib

    if a == b:
        return a
    if _is_loose(a) or _is_loose(b):
        return _loose((*a, *b))
    keys = [_key(x) for x in a], [_key(x) for x in b]
    out: list = []
    if keys[0] == keys[1]:
        ops = [("equal", 0, len(a), 0, len(b))]
    else:
        ops = difflib.SequenceMatcher(None, *keys, autojunk=False).get_opcodes()
    for op, i1, i2, j1, j2 in ops:
        made = [_merged(x, y) for x, y in zip(a[i1:i2], b[j1:j2])] if op == "equal" else [(x[0], x[1] | OPTIONAL, x[2]) for x in (*a[i1:i2], *b[j1:j2])]
        for x in made:
            if out and out[-1][0] == x[0] and x[0] and _name(x[0]) in _SETS["flow"]:
                both = _merged(out[-1], x, REPEATED)
                out[-1] = (both[0], both[1] & ~OPTIONAL | (out[-1][1] & x[1] & OPTIONAL), both[2])
            else:
                out.append(x)
    return _loose(out) if len(out) > LONG else tuple(out)


def spell(items) -> str:
    """The expression as text: ( )+ repeats, ( )? is optional, ( )* both, # is a slot."""
    out = []
    for key, flags, inner in items:
        one = "#" if key == "#" else f"{key}{spell(inner)}</{_name(key)}>" if key else spell(inner)
        out.append(f"({one}){' ?+*'[flags]}" if flags else one)
    return "".join(out)


class Wrapper:
    """An expression with its items numbered in order, and how pages match it."""

    def __init__(self, items):
        self.keys, self.parent, self.repeated = [""], [-1], [False]
        self.lists: list = [None]
        self._number(items, 0)

    def _number(self, items, parent: int) -> None:
        places: dict = {}
        order: list = []  # (node, first and last place of its repeated group or None)
        self.lists[parent] = places, order

        def put(items, group):
            for key, flags, inner in items:
                if key == "":
                    begin = len(order)
                    put(inner, None)
                    if flags & REPEATED:
                        for i in range(begin, len(order)):
                            order[i] = order[i][0], (begin, len(order))
                    continue
                node = len(self.keys)
                self.keys.append(key), self.parent.append(parent), self.repeated.append(bool(flags & REPEATED)), self.lists.append(None)
                places.setdefault(key, []).append(len(order))
                order.append((node, None))
                if key != "#":
                    self._number(inner, node)

        put(items, None)

    def match(self, parent: int, nodes: list):
        """The wrapper's node for each of the page's ``nodes`` under ``parent``
        (-1: none, for a page that the wrapper wasn't made of)."""
        places, order = self.lists[parent] if parent >= 0 else ({}, [])
        at, out = 0, []
        for x in nodes:
            key = x[0]
            if key == "#" and _blank(x):
                out.append(-1)
                continue
            found = places.get(key) or (places.get(f"<{_name(key)}>") if key != "#" else None)
            if not found:
                out.append(-1)
                continue
            place = found[0]
            if len(found) > 1:
                group = order[min(at, len(order) - 1)][1] or (order[at - 1][1] if at else None)
                low, high = group or (at, at)
                # on in the repeated group, from its start again, further on, anywhere; first of these one that has the children
                tries = sorted(found, key=lambda p: (0 if at <= p < high else 1 if low <= p < high else 2 if p >= at else 3, p))
                place = next((p for p in tries if self._fits(order[p][0], x)), tries[0])
            node = order[place][0]
            at = place if self.repeated[node] else place + 1
            out.append(node)
        return out

    def _fits(self, node: int, x) -> bool:
        places = self.lists[node][0] if self.lists[node] else {}
        return x[0] == "#" or all(c[0] in places or (c[0] == "#" and _blank(c)) for c in x[1])


@functools.lru_cache(512)
def wrapper_of(form: str) -> Wrapper:
    return Wrapper(_tuples(json.loads(form)))


def _tuples(items):
    return tuple((k, f, _tuples(c)) for k, f, c in items)


# --- roles ---


@functools.lru_cache(4096)
def role(name: str, mark: str) -> str:
    """What an element's name (capital) and marks (small) say: F or f furniture,
    C or c main content, h a header, else nothing."""
    said = {_word_role(w) for w in mark.split()}
    if name in _SETS["furniture"]:
        return "F"
    if name in _SETS["content"] and "f" not in said:
        return "C"
    if name == "header":
        return "h"
    return "f" if "f" in said else "c" if "c" in said else ""


def _word_role(word: str) -> str:
    """What a word of a mark says. ``article-header`` says nothing: it may hold
    the headline."""
    parts = [x for x in re.split(r"[^a-z]+", word) if x]
    if not parts or set(parts) & _SETS["fwords"]:
        return "f" if parts else ""
    content = bool(set(parts) & _SETS["cwords"])
    if parts[-1] in _SETS["lwords"]:
        return "" if content else "f"
    return "c" if content else ""


def roles(wrapper: Wrapper, stats: dict | None = None) -> str:
    """A letter for each item of the wrapper: M the host's main container, C
    other main content, F furniture, H a headline outside M, else a dot.

    ``stats`` has (pages, values, characters, characters in links, slots) by text
    slot; without it, or where too little of the host's text varies over too few
    pages, only names and words decide."""
    n = len(wrapper.keys)
    said = ["" if k in ("", "#") else role(_name(k), k[1:-1].partition(" ")[2]) for k in wrapper.keys]
    chars, linked, mass, slots, fixed = ([0.0] * n for _ in range(5))
    still: list = [None] * n  # whether all text of a node is constant
    seen = 0
    for i, (pages, values, size, links, many) in (stats or {}).items():
        chars[i], linked[i], slots[i] = size, links, many / max(1, pages)
        mass[i] = max(0, size - links) * values / pages
        heading = _name(wrapper.keys[wrapper.parent[i]]) in _HEADINGS if wrapper.parent[i] > 0 else False
        still[i] = pages >= SEEN and (values <= 1 or (not heading and values <= CONSTANT * pages))
        fixed[i] = size if still[i] else 0
        seen = max(seen, pages)
    for i in range(n - 1, 0, -1):  # children come after their parent
        up = wrapper.parent[i]
        for x in (chars, linked, mass, slots, fixed):
            x[up] += x[i]
        if still[i] is not None:
            still[up] = still[i] and still[up] is not False
    sure = seen >= SEEN and mass[0] >= VARYING * chars[0]
    below: list = [[] for _ in range(n)]
    for i in range(1, n):
        below[wrapper.parent[i]].append(i)
    path, main = [0], 0
    if sure:
        worth = {"F": 0.1, "f": 0.25, "C": 4.0, "c": 2.0}
        while True:
            x = path[-1]
            weights = sorted(((mass[c] * worth.get(said[c], 1.0), c) for c in below[x]), reverse=True)
            if not weights or weights[0][0] <= 0:
                break
            best, c = weights[0]
            holds = wrapper.keys[c] != "#" and _name(wrapper.keys[c]) not in _SETS["flow"] and _name(wrapper.keys[c]) not in _SETS["inline"]
            if not holds or best < 0.5 * sum(w for w, _ in weights) or (wrapper.repeated[c] and said[c] != "C"):
                break
            path.append(c)
        marked = [c for c in path if said[c] == "C" and _name(wrapper.keys[c]) == "article"][:1] or [c for c in path if said[c] in ("C", "c")][-1:] or path[-1:]
        main = marked[0] if _name(wrapper.keys[marked[0]]) not in ("html", "body") else 0
    on_path = set(path)
    out = ["."] * n
    inside = [False] * n  # of M or C
    for i in range(1, n):
        up, key = wrapper.parent[i], wrapper.keys[i]
        if out[up] == "F":
            out[i] = "F"
            continue
        inside[i] = inside[up] or out[up] in "MC"
        if i == main:
            out[i] = "M"
            continue
        if i in on_path and not inside[i]:
            out[i] = "C" if said[i] in ("C", "c") and not main else "."
            continue
        name = "" if key == "#" else _name(key)
        if sure and still[i] and chars[i] and i not in on_path:
            # constant text is furniture; running text without a mark inside the article is the article's
            if not (inside[i] and (key == "#" or name in _SETS["flow"] | _SETS["inline"] and " " not in key)):
                out[i] = "F"
                continue
        if sure and not inside[i] and name not in _SETS["flow"] and name not in _SETS["inline"] and key != "#" and chars[i] and linked[i] >= 0.8 * chars[i] and slots[i] >= 3:
            out[i] = "F"  # a menu
        elif i not in on_path and (said[i] in ("F", "f") or (said[i] == "h" and not inside[i])):
            out[i] = "F"
        elif said[i] in ("C", "c") and not inside[i]:
            out[i] = "C"
        elif main and name in ("h1", "h2") and not inside[i] and up in on_path and i < main and not still[i]:
            out[i] = "H"
    return "".join(out)


# --- extraction ---


def extract(page: str | None, wrapper: Wrapper | None = None, known: str | None = None) -> str:
    """The main text of a page, read by its host's wrapper and ``roles``: the
    text of the main container, or where the page has none (or one without
    text) of other content, or else all text outside furniture. Without a
    wrapper the page's own expression and names decide."""
    if not page:
        return ""
    nodes = tree(page)
    if wrapper is None:
        wrapper = Wrapper(_shape(nodes))
    known = roles(wrapper) if known is None else known
    parts: dict = {"M": [], "C": [], ".": []}
    whole = _holds(nodes, wrapper, known)

    def gap():
        for x in parts.values():
            x.append(None)

    def visit(nodes, parent, where):
        for x, i in zip(nodes, wrapper.match(parent, nodes)):
            if x[0] == "#":
                if i < 0 or known[i] != "F":
                    for to in where:
                        parts[to].extend(x[1])
                continue
            own = known[i] if i >= 0 else {"F": "F", "f": "F", "C": "C", "c": "C"}.get(role(x[2], x[0][1:-1].partition(" ")[2]), ".")
            if x[2] not in _SETS["inline"]:
                gap()
            if own != "F":
                visit(x[1], i, "M" if own == "M" or where == "M" else "C" if own == "C" or where == "C" else "M." if own == "H" or where == "M." else ".")
                if x[2] not in _SETS["inline"]:
                    gap()

    visit(nodes, 0, ".")
    return (whole and _join(parts["M"])) or _join(parts["C"]) or _join(parts["."])


def _holds(nodes, wrapper: Wrapper, known: str) -> bool:
    """Whether the page has the main container with text in it."""
    if "M" not in known:
        return False
    stack = [(nodes, 0, False)]
    while stack:
        nodes, parent, inside = stack.pop()
        for x, i in zip(nodes, wrapper.match(parent, nodes)):
            if x[0] == "#":
                if inside and not _blank(x):
                    return True
            elif i >= 0 and known[i] != "F":
                stack.append((x[1], i, inside or known[i] == "M"))
    return False


def _join(parts: list) -> str:
    blocks, now = [], []
    for x in [*parts, None]:
        if x is not None:
            now.append(x)
        elif now:
            # white space may be written as a reference
            if block := " ".join(entities.unescape("".join(now)).split()):
                blocks.append(block)
            now = []
    return " ".join(blocks)


# --- over tables ---


def _host(url) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1))


def wrappers(pages: DataFrame, most: int = FORMS) -> DataFrame:
    """(host, form: the wrapper as JSON, n: its pages) of ``pages(url, html)``.

    All pages count: each page's folded expression goes into a count by (host,
    form), and the distinct forms of a host are aligned in groups of about
    ``most``, what these give again, until each host has one: as many rounds as
    the logarithm of the forms. Pages without a host share the empty one."""

    def streams(batches):
        import pyarrow as pa

        for batch in batches:
            folded = [json.dumps(stream(x or ""), separators=(",", ":")) for x in each(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(folded, pa.string())], names=["host", "form"])

    def join(table):
        import pyarrow as pa

        rows = sorted(zip(table["n"].to_pylist(), table["form"].to_pylist()), key=lambda x: (-x[0], x[1]))
        made = functools.reduce(align, (_tuples(json.loads(f)) for _, f in rows))
        return pa.table({"host": [table["host"][0].as_py()], "form": [json.dumps(made, separators=(",", ":"))], "n": [sum(n for n, _ in rows)]}, schema=pa.schema([("host", pa.string()), ("form", pa.string()), ("n", pa.int64())]))

    forms = pages.select(_host(F.col("url")).alias("host"), F.col("html")).mapInArrow(streams, "host string, form string")
    forms = materialise(forms.groupBy("host", "form").agg(F.count("*").alias("n")), "forms")
    while True:
        groups = forms.groupBy("host").agg(F.ceil(F.count("*") / most).alias("groups"), F.count("*").alias("forms"))
        if groups.where("forms > 1").isEmpty():
            return forms
        # both sides exchanged, or the small one broadcast by its size: AQE splits a frequent host
        part = forms.join(groups.select("host", "groups"), "host").withColumn("g", F.pmod(F.xxhash64("form"), F.col("groups")))
        part = part.groupBy("host", "g").applyInArrow(lambda t: join(t.select(["host", "form", "n"])), "host string, form string, n long")
        forms = materialise(part, "wrappers")


def slot_values(page: str, wrapper: Wrapper) -> dict:
    """{slot: [its text on this page, characters in links, number of texts]}."""
    out: dict = {}
    stack = [(tree(page), 0)]
    while stack:
        nodes, parent = stack.pop()
        for x, i in zip(nodes, wrapper.match(parent, nodes)):
            if i < 0:
                continue
            if x[0] != "#":
                stack.append((x[1], i))
                continue
            text = " ".join("".join(p or " " for p in x[1]).split())
            held = out.setdefault(i, ["", 0, 0])
            held[0] += f" {text}" if held[0] else text
            held[1] += min(x[2], len(text))
            held[2] += 1
    return out


def slot_statistics(pages: DataFrame, made: DataFrame) -> DataFrame:
    """(host, slots): of each text slot of a host's wrapper the number of
    different pages it is on, of different values (both by a fixed-size sketch of
    all of them), of characters, of characters in links and of texts.

    Grouped by (host, slot) with partial sketches, so a frequent host is a row
    for each of its slots and task."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        names = ["host", "slot", "page", "value", "size", "links", "many"]
        for batch in batches:
            rows: list = []
            for host, form, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), each(batch.column(2))):
                if page:
                    own = xxhash.xxh64_intdigest(page, 5) >> 1
                    rows += [(host, i, own, xxhash.xxh64_intdigest(text, 6) >> 1, len(text), links, many) for i, (text, links, many) in slot_values(page, wrapper_of(form)).items()]
            columns = list(zip(*rows)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), *(pa.array(x, pa.int64()) for x in columns[2:])], names=names)

    rows = _with_wrapper(pages.select(_host(F.col("url")).alias("host"), "html"), made).select("host", "form", "html")
    rows = rows.mapInArrow(run, "host string, slot int, page long, value long, size long, links long, many long")
    found = rows.groupBy("host", "slot").agg(F.approx_count_distinct("page").alias("pages"), F.approx_count_distinct("value").alias("values"), F.sum("size").alias("size"), F.sum("links").alias("links"), F.sum("many").alias("many"))
    # a row for each slot of a wrapper
    return found.groupBy("host").agg(F.collect_list(F.struct("slot", "pages", "values", "size", "links", "many")).alias("slots"))


def _with_wrapper(rows: DataFrame, made: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``made`` for their host: some kilobytes a
    host, which Spark broadcasts if they are small enough in all; else AQE splits
    a frequent host."""
    return rows.join(made.withColumnRenamed("host", "h"), F.col("host") == F.col("h"), "left").drop("h")


def host_roles(pages: DataFrame, infer: bool = True) -> DataFrame:
    """(host, form, roles) of each host of ``pages``. Without ``infer`` the
    statistics of slots are left out: names and words alone decide."""
    import pyarrow as pa

    made = wrappers(pages).select("host", "form")
    none = F.lit(None).cast("array<struct<slot:int,pages:bigint,values:bigint,size:bigint,links:bigint,many:bigint>>")
    joined = made.join(slot_statistics(pages, made), "host", "left") if infer else made.withColumn("slots", none)

    def run(batches):
        for batch in batches:
            found = []
            for form, slots in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                stats = {s["slot"]: (s["pages"], s["values"], s["size"], s["links"], s["many"]) for s in slots or []}
                found.append(roles(wrapper_of(form), stats))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], names=["host", "form", "roles"])

    return materialise(joined.select("host", "form", "slots").mapInArrow(run, "host string, form string, roles string"), "roles")


def main_text(pages: DataFrame, infer: bool = True) -> DataFrame:
    """Per row of ``pages(page_id, url, html)``: page_id, url, text and n_chars.

    Null and empty html have an empty text. Null urls and urls without a host
    share a wrapper. Null and repeated page_ids give a row each, and repeated
    rows count once in a slot's numbers of pages and values; other columns,
    whatever their names, are not read. An empty table gives an empty result.
    Whole pages are read, however long; elements nested deeper than DEEP are
    block boundaries only."""
    import pyarrow as pa

    known = host_roles(pages, infer)

    def run(batches):
        for batch in batches:
            texts = [extract(p, wrapper_of(f), r) if p else "" for p, f, r in zip(each(batch.column(2)), batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = _with_wrapper(pages.select("page_id", "url", "html", _host(F.col("url")).alias("host")), known)
    kind = dict(pages.dtypes)["page_id"]
    return rows.select("page_id", "url", "html", "form", "roles").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
