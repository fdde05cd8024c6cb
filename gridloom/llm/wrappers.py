"""HTML main text by wrappers inferred for each host.

Each page becomes a stream of tokens: element opens (tag and class), element
closes and text slots, with runs of alike siblings folded into repeated groups.
The distinct streams of a host are aligned one after another, level by level: what
both have stays, what only one has becomes optional, and neighbours of one name
become a repeated group, which gives one union-free regular expression for the host,
its wrapper.  Each page is matched with its host's wrapper, which gives every text of
it a slot.  A slot is fixed if it stands on every page of the host with the same
text, on pages that differ elsewhere; such a text is the host's, not the page's.
A page gives all text outside of boilerplate elements, but for fixed slots outside
the deepest container that holds all other text of this page, or in a container
of their own.  Nothing else is left out: a page without other text, one that its
host's wrapper does not match, and pages of the empty host are given whole.

Streams and slots are counted by host before anything is gathered.  A host's
distinct streams are aligned as a tree: groups of about ``GROUP`` in tasks of their
own, then the groups' wrappers in the same way, until one is left.  A null or empty
html gives an empty text; a null url belongs to the host with the empty name; a very
long page is read whole; each row of ``pages`` gives one row, repeated ones too; an
empty table gives an empty result.  Other columns of ``pages``, whatever their
names, are not read.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import sys
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce
from itertools import count

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.urlfilter import host_and_path
from gridloom.operators.joins import lookup
from gridloom.session import cut

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_USED = frozenset("class id role hidden style".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article main section div td body html".split())
#: Elements, roles and class or id words that are never part of an article.
BOILERPLATE_TAGS = frozenset("head nav header footer aside form script style noscript template iframe svg button select option textarea title menu dialog object canvas".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog".split())
#: ``STRONG`` ones mark an element wherever they stand in a name; the others if all words beside them
#: are ``GENERIC``, so that "share-box" is boilerplate and "share-price" is not.
STRONG = frozenset(
    "adbox adslot advert adverts advertisement advertisements advertising breadcrumb breadcrumbs comments commentlist cookies disqus footer gdpr masthead "
    "navbar newsletter pagination popup promoted sidebar signup sponsored toolbar topbar bottombar".split()
)
BOILERPLATE_WORDS = STRONG | frozenset(
    "ad ads banner comment consent cookie disclaimer header login menu modal nav navigation notice notices promo promotion related respond reply replies "
    "search share sharing skip social sponsor subscribe subscription widget".split()
)
GENERIC = frozenset(
    "alert area articles aside bar bars big block bottom box btn button buttons center col column container count desktop embed fixed float form global "
    "google grid group icon icons inner item items large layout left leaderboard level link links list lists media menu mini mobile more outer page pane panel "
    "policy popular posts primary rail reader region right row secondary section site slot small space stack sticky stories sub text thread to tools top "
    "unit user users view wide wrap wrapper".split()
)
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = frozenset("ul ol dl table article section div body main td th".split())


def _attributes(text: str) -> dict[str, str]:
    """Values of the attributes in use; of repeated ones the first counts."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text) if text.strip() else ():
        if (name := m[1].lower()) in _USED:
            found.setdefault(name, m[2] or m[3] or m[4] or "")
    return found


def _marked(name: str) -> bool:
    """Whether a class or id name says boilerplate: its last word beside generic ones does, or all of them."""
    words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if w]
    heads = list(words)
    while len(heads) > 1 and heads[-1] in GENERIC:
        heads.pop()
    return bool(heads) and heads[-1] in STRONG or any(w in BOILERPLATE_WORDS for w in words) and all(w in BOILERPLATE_WORDS or w in GENERIC for w in words)


def boilerplate(tag: str, a: dict[str, str], inside: list[str] | tuple = (), page: str = "", at: int = 0) -> bool:
    """Whether an element's tag, role, class or id marks it as no part of an article.

    ``inside``: tags of the elements around it; a header of an article is a part of it.  A form or
    a marked element around a headline or main part of the ``page``, from ``at`` on, is a layout.
    """
    if a.get("role", "").lower() in BOILERPLATE_ROLES - {"form"} or "hidden" in a or "display:none" in a.get("style", "").replace(" ", "").lower():
        return True
    if tag in ("body", "html", "article", "main") or tag == "header" and ("article" in inside or "main" in inside):
        return False
    if tag in BOILERPLATE_TAGS - {"form"}:
        return True
    marked = tag == "form" or a.get("role", "").lower() == "form" or any(_marked(x) for x in f"{a.get('class', '')} {a.get('id', '')}".split())
    return marked and not _around_main(tag, page, at)


def _around_main(tag: str, page: str, at: int) -> bool:
    """Whether a headline or main part comes before the element's end."""
    depth = 1
    for m in _TOKEN.finditer(page, at):
        name = (m[2] or "").lower()
        if name == tag and tag not in VOID:
            depth += -1 if m[1] else 1
            if not depth:
                return False
        elif name in ("h1", "main") and not m[1]:
            return True
    return False


def symbol(tag: str, a: dict[str, str]) -> str:
    """Tag and class, digits generalised."""
    c = a.get("class", "").split()
    return f"{tag}.{re.sub('[0-9]+', 'N', c[0].lower())}" if c else tag


def walk(page: str) -> Iterator[tuple[str, str, bool]]:
    """``(kind, value, boiler)``: ``open`` with a symbol, ``close`` with a symbol, ``text`` with raw text.

    End tags without a start are ignored, missing ones are supplied; ``boiler`` tells of text or an
    element inside boilerplate.
    """
    stack: list[tuple[str, str, bool]] = []
    at, boiler = 0, False
    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None or m.start() > at:
            yield "text", page[at : m.start() if m else len(page)], boiler
            if m is None:
                break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if any(t == tag for t, _, _ in stack):
                while True:
                    t, s, b = stack.pop()
                    boiler = stack[-1][2] if stack else False
                    yield "close", s, b
                    if t == tag:
                        break
            continue
        a = _attributes(m[3])
        if tag in VOID or m[3].endswith("/"):
            yield "void", tag, boiler
            continue
        if closes := CLOSES.get(tag) or ({"p"} if tag in BLOCKS else None):
            depth = len(stack) - 1
            while depth >= 0 and stack[depth][0] not in closes and (stack[depth][0] not in STOPS or stack[depth][0] in closes):
                depth -= 1
            if depth >= 0 and stack[depth][0] in closes:
                while len(stack) > depth:
                    _, s, b = stack.pop()
                    yield "close", s, b
                boiler = stack[-1][2] if stack else False
        boiler = boiler or boilerplate(tag, a, [t for t, _, _ in stack], page, at)
        stack.append((tag, symbol(tag, a), boiler))
        yield "open", stack[-1][1], boiler
        if tag in RAW:
            end = re.compile(f"</{tag}", re.I).search(page, at)
            at = end.start() if end else len(page)
    for t, s, b in reversed(stack):
        yield "close", s, b


def _tag(s: str) -> str:
    return s.partition(".")[0]


class Group(tuple):
    """A repeated group of siblings."""

    def __str__(self) -> str:
        return f"( {' '.join(map(str, self))} )+"


def _core(item):
    return item[0] if isinstance(item, Group) and len(item) == 1 else item


def _merged(a: list, b: list) -> Group:
    return Group(x if isinstance(x, Group) else y for x, y in zip(a, b))


def _add(level: list, piece: str, longest: int = 4) -> None:
    """Append a sibling; runs that repeat the siblings before them become groups."""
    last = level[-1] if level else None
    if isinstance(last, Group) and isinstance(last[-1], Group) and _core(last[-1]) == piece:
        return
    level.append(piece)
    n = 1
    while n <= longest:
        tail = level[-n:]
        before = level[-n - 1] if len(level) > n else None
        if isinstance(before, Group) and len(before) == n and [*map(_core, before)] == [*map(_core, tail)]:
            level[-n - 1 :] = [_merged(before, tail)]
            n = 0
        elif len(level) >= 2 * n and [*map(_core, level[-2 * n : -n])] == [*map(_core, tail)]:
            level[-2 * n :] = [_merged(level[-2 * n : -n], tail)]
            n = 0
        n += 1


def skeleton(page: str) -> str:
    """The folded token stream."""
    levels: list[list] = [[]]
    for kind, value, boiler in walk(page):
        if kind == "open":
            levels.append([])
        elif kind == "close":
            inside = [] if boiler else levels[-1]
            levels.pop()
            _add(levels[-1], " ".join([f"<{value}>", *map(str, inside), f"</{_tag(value)}>"]))
        elif kind == "text" and not value.isspace():
            _add(levels[-1], "#text")
    return " ".join(map(str, levels[0]))


class Node:
    """A part of an expression: an element, a text slot or a group; it may be optional and repeated."""

    __slots__ = ("key", "children", "optional", "repeated")

    def __init__(self, key: str | None, children: list[Node], optional: bool = False, repeated: bool = False):
        self.key, self.children, self.optional, self.repeated = key, children, optional, repeated

    def name(self) -> str:
        """What aligns with what: the symbol of an element, or those of a group's parts."""
        return self.key or " ".join(c.name() for c in self.children)

    def tokens(self, out: list[str]) -> None:
        out += ["("] * (self.optional + self.repeated)
        if self.key and self.key != "#text":
            out.append(self.key)
        elif self.key:
            out.append("#text")
        for c in self.children:
            c.tokens(out)
        if self.key and self.key != "#text":
            out.append(f"</{_tag(self.key[1:].rstrip('>'))}>")
        out += [")+"] * self.repeated + [")?"] * self.optional


def parsed(expression: str) -> list[Node]:
    """The parts of an expression, neighbours of one name folded."""
    levels: list[tuple[str, list[Node]]] = [("", [])]
    for t in expression.split():
        if t == "(" or t.startswith("<") and not t.startswith("</"):
            levels.append((t, []))
        elif t == "#text":
            levels[-1][1].append(Node(t, []))
        else:
            opened, inner = levels.pop()
            inner = _folded(inner)
            if opened != "(":
                node = Node(opened, inner)
            else:
                node = inner[0] if len(inner) == 1 else Node(None, inner)
                node.repeated |= t == ")+"
                node.optional |= t == ")?"
            levels[-1][1].append(node)
    return _folded(levels[0][1])


def _folded(nodes: list[Node]) -> list[Node]:
    """Neighbours of one name as one repeated part."""
    out: list[Node] = []
    for n in nodes:
        if out and out[-1].name() == n.name():
            optional = out[-1].optional and n.optional
            out[-1] = _merge(out[-1], n)
            out[-1].optional, out[-1].repeated = optional, True
        else:
            out.append(n)
    return out


def _merge(a: Node, b: Node) -> Node:
    """What both parts of one name fit."""
    return Node(a.key, _together(a.children, b.children), a.optional or b.optional, a.repeated or b.repeated)


def _together(x: list[Node], y: list[Node]) -> list[Node]:
    """Parts that both have stay, those that only one has become optional."""
    out: list[Node] = []
    for op, i, j, k, m in SequenceMatcher(None, [n.name() for n in x], [n.name() for n in y], autojunk=False).get_opcodes():
        if op == "equal":
            out += [_merge(u, v) for u, v in zip(x[i:j], y[k:m])]
        else:
            out += [Node(n.key, n.children, True, n.repeated) for n in (*x[i:j], *y[k:m])]
    return _folded(out)


def align(a: str, b: str) -> str:
    """The union-free expression that both streams or expressions fit."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))  # as deep as pages are nested
    out: list[str] = []
    for n in _together(parsed(a), parsed(b)):
        n.tokens(out)
    return " ".join(out)


class Matcher:
    """A wrapper as a program: symbols to read, and where to go on after each."""

    def __init__(self, wrapper: str):
        self.symbols: list[str | None] = []
        self.goto: list[tuple[int, ...]] = []
        begun: list[int] = []
        for t in wrapper.split():
            at = len(self.symbols)
            if t == "(":
                begun.append(at)
            self.symbols.append(None if t == "(" or t in (")+", ")?") else t)
            self.goto.append((at + 1,))
            if t == ")?":
                self.goto[begun.pop()] += (at + 1,)
            elif t == ")+":
                self.goto[at] = (begun.pop() + 1, at + 1)
        self.reached: dict[int, list[int]] = {}

    def _from(self, at: int) -> list[int]:
        """Places of symbols, or the end, that follow ``at`` without reading; the first choice first."""
        if at not in self.reached:
            out, seen, todo = [], set(), [at]
            while todo:
                k = todo.pop()
                if k in seen:
                    continue
                seen.add(k)
                if k == len(self.symbols) or self.symbols[k] is not None:
                    out.append(k)
                else:
                    todo += reversed(self.goto[k])
            self.reached[at] = out
        return self.reached[at]

    def slots(self, stream: list[str]) -> list[int] | None:
        """The place in the wrapper of each token, or None if the stream does not fit."""
        threads: list[tuple[int, tuple | None]] = [(k, None) for k in self._from(0)]
        for token in stream:
            after, seen = [], set()
            for k, past in threads:
                if k < len(self.symbols) and self.symbols[k] == token:
                    for q in self._from(k + 1):
                        if q not in seen:
                            seen.add(q)
                            after.append((q, (k, past)))
            if not after:
                return None
            threads = after
        for k, past in threads:
            if k == len(self.symbols):
                out = []
                while past:
                    out.append(past[0])
                    past = past[1]
                return out[::-1]
        return None


def _stream(steps: list[tuple[str, str, bool]]) -> list[str]:
    """The page's own token stream, not folded, without the insides of boilerplate."""
    out, deep = [], 0
    for kind, value, boiler in steps:
        if kind == "open":
            if not deep:
                out.append(f"<{value}>")
            deep += boiler
        elif kind == "close":
            deep -= boiler
            if not deep:
                out.append(f"</{_tag(value)}>")
        elif kind == "text" and not deep and not value.isspace():
            out.append("#text")
    return out


def _plain(text: str) -> str:
    return " ".join(entities.unescape(text).split())


def _texts(steps: list[tuple[str, str, bool]]) -> list[str]:
    return [value for kind, value, boiler in steps if kind == "text" and not boiler and not value.isspace()]


def slot_texts(page: str, matcher: Matcher) -> dict[int, str] | None:
    """Text of each slot of the wrapper, or None if the page does not fit it."""
    steps = list(walk(page))
    stream = _stream(steps)
    if (places := matcher.slots(stream)) is None:
        return None
    out: dict[int, str] = {}
    for k, value in zip((k for k, t in zip(places, stream) if t == "#text"), _texts(steps)):
        out[k] = f"{out[k]}\n{_plain(value)}" if k in out else _plain(value)
    return out


def main_text(page: str, matcher: Matcher | None = None, fixed: frozenset = frozenset()) -> str:
    """Blocks outside of boilerplate, one a line, without the host's ``fixed`` slots around or between the page's own text."""
    steps = list(walk(page))
    stream = _stream(steps) if fixed else []
    places = matcher.slots(stream) if fixed else None
    own = iter([k not in fixed for k, t in zip(places, stream) if t == "#text"] if places else [True] * len(steps))
    path: list[tuple[int, str]] = []
    around: list | None = None
    filled = set()
    blocks: list[tuple[str, tuple]] = []
    held: list[str] = []
    where: tuple = ()

    def flush() -> None:
        if held:
            if text := _plain("".join(held)):
                blocks.append((text, where))
            held.clear()

    for n, (kind, value, boiler) in enumerate(steps):
        tag = _tag(value) if kind in ("open", "close") else ""
        if kind == "text":
            if not boiler:
                if not held:
                    where = tuple(path)
                held.append(value)
                if not value.isspace() and next(own):
                    filled.update(path)
                    around = list(path) if around is None else [x for x, y in zip(around, path) if x == y]
        elif kind == "void":
            if value == "hr":
                flush()
            elif value == "br" and not boiler and held:
                held.append(" ")
        else:
            if tag in BLOCKS:
                flush()
            if tag in CONTAINERS:
                if kind == "open":
                    path.append((n, tag))
                else:
                    path.pop()
    flush()
    if around is None or not places:
        return "\n".join(text for text, _ in blocks)

    def kept(at: tuple) -> bool:
        nearest = next((c for c in reversed(at) if c[1] != "td"), None)  # cells belong to their table
        return list(at[: len(around)]) == around and (nearest is None or nearest in filled)

    return "\n".join(text for text, at in blocks if kept(at))


GROUP = 32


def wrappers(pages: DataFrame) -> DataFrame:
    """``(host, wrapper, pages)``: the expression of each host."""
    host, _ = host_and_path(F.col("url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[tuple[str, str], int] = {}
            for h, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                key = h, skeleton(page or "")
                found[key] = found.get(key, 0) + 1
            rows = [(*k, n) for k, n in found.items()]
            columns = zip(*rows) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))], ["host", "value", "n"])

    counted = pages.select(host.alias("host"), "html").where("host <> ''").mapInArrow(run, "host string, value string, n long")
    counted = cut(counted.groupBy("host", "value").agg(F.sum("n").alias("n")))

    def together(rows: pd.DataFrame) -> str:
        values = rows.sort_values(["n", "value"], ascending=[False, True]).value.tolist()
        return reduce(align, values[1:], align(values[0], values[0]))

    def part(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [key[0]], "value": [together(rows)], "n": [rows.n.sum()]})

    for turn in count():
        sizes = cut(counted.groupBy("host").agg(F.count("*").alias("members")))
        if turn and (sizes.agg(F.max("members")).first()[0] or 0) <= 1:
            return counted.select("host", F.col("value").alias("wrapper"), F.col("n").alias("pages"))
        groups = F.ceil(F.col("members") / GROUP)
        dealt = lookup(counted, sizes, ["host"], size="members").withColumn("salt", F.pmod(F.xxhash64("value"), groups)).drop("members")
        counted = cut(dealt.groupBy("host", "salt").applyInPandas(part, "host string, value string, n long"))


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def fixed_slots(pages: DataFrame, found: DataFrame) -> DataFrame:
    """``(host, fixed)``: slots with one text on every page of the host; ``pages`` have ``wrapper`` and ``host``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers: dict[str, Matcher] = {}
        for b in batches:
            seen: dict[tuple[str, int], list[int]] = {}
            for h, w, page in zip(*(b.column(k).to_pylist() for k in range(3))):
                if w not in matchers:
                    if len(matchers) >= 1000:
                        matchers.clear()
                    matchers[w] = Matcher(w)
                texts = slot_texts(page or "", matchers[w]) or {}
                whole = _hash("\n".join(texts.values()))
                for k, text in texts.items():
                    x = _hash(text)
                    if (r := seen.get((h, k))) is None:
                        seen[h, k] = [x, x, whole, whole, 1]
                    else:
                        r[:] = min(r[0], x), max(r[1], x), min(r[2], whole), max(r[3], whole), r[4] + 1
            rows = [(*k, *r) for k, r in seen.items()]
            columns = zip(*rows) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64() if n else pa.string()) for n, c in enumerate(columns)], ["host", "slot", "lo", "hi", "first", "last", "n"])

    slots = pages.where("wrapper is not null").select("host", "wrapper", "html").mapInArrow(run, "host string, slot long, lo long, hi long, first long, last long, n long")
    slots = slots.groupBy("host", "slot").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    return slots.where("lo = hi and first < last").join(found.select("host", "pages"), "host").where("n = pages").groupBy("host").agg(F.sort_array(F.collect_list("slot")).alias("fixed"))  # at most a wrapper's slots


def extract(pages: DataFrame, broadcast_hosts: int = 100_000, broadcast_chars: int = 32_000_000) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row."""
    found = cut(wrappers(pages))
    host, _ = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"))

    def joined(hosts: DataFrame) -> DataFrame:
        size = hosts.agg(F.coalesce(F.sum(F.length("wrapper")), F.lit(0)).alias("chars")).first()
        return lookup(rows, hosts, ["host"], few=broadcast_hosts if size.chars <= broadcast_chars else 0)

    fixed = fixed_slots(joined(found.select("host", "wrapper")), found)
    rows = joined(cut(found.join(fixed, "host").select("host", "wrapper", "fixed"))).select("page_id", "url", "html", "wrapper", "fixed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers: dict[str, Matcher] = {}
        for b in batches:
            texts = []
            for page, w, slots in zip(*(b.column(k).to_pylist() for k in (2, 3, 4))):
                if w is not None and w not in matchers:
                    if len(matchers) >= 1000:
                        matchers.clear()
                    matchers[w] = Matcher(w)
                texts.append(main_text(page or "", matchers.get(w), frozenset(slots or ())))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
