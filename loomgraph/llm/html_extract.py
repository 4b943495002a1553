"""Main text of web pages by wrappers: union-free regular expressions over the block structure of pages of the same host.

A page is a stream of block tags and text slots (inline tags belong to the slots; missing end tags are supplied). Pages of a
host are aligned one after another with the wrapper so far: adjacent equal groups of tokens become one repeated group, what
one side lacks becomes optional, and texts become slots. A wrapper holds no alternatives, so it is a regular expression of
sequence, optional and repeated groups only.

A page is matched against its host's wrapper, which gives each slot a place: the slot of the wrapper that it fills (all rounds
of a repeated group fill one). A page that the wrapper does not cover is aligned with it, and slots that it lacks are placed by
the blocks they stand in. Main text are the slots inside an article or main element, or without any, those of the body, in
neither case inside menus, headers, footers, sidebars, notices, adverts, forms or comments. Of these, those go that are
static: whose place holds one and the same text on all pages of the host that have it, several different pages at least (more
inside an article, whose markup vouches for it). That is counted over all pages; a page that has nothing else keeps them.

Wrappers are inferred from all pages of each host: every page's collapsed stream counts, and those that differ are aligned in
groups dealt by a hash, then the wrappers of the groups, until each host has one. Every page is extracted, whole.

Defined results: null and empty html, and pages without main text, give the empty string; very long pages are ordinary;
repeated rows give equal texts; a null or odd url counts as a host of its own kind; an empty table gives an empty result; other columns are not
looked at.
"""

from __future__ import annotations

import json
import re
from bisect import bisect
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher
from hashlib import blake2b
from html import unescape
from itertools import accumulate, groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import arrow_batches, lean, settled

#: Different structures of a host, or wrappers of some of them, that one task aligns: about so many in each group.
MERGED = 16
#: The earlier name of that. All pages of a host count.
SAMPLE_PAGES = MERGED
#: Optional groups in a row beyond which their tokens, each optional, become one repeated group: a part of the page that has no order.
LOOSE = 16
#: Token streams that a task remembers having collapsed; beyond that it forgets them, and may hand a structure on twice.
KNOWN_STREAMS = 500_000
#: Different pages of a host that have to agree on a slot's text before it counts as static, by region.
STATIC_PAGES = {"body": 3, "doubt": 3, "main": 8}
#: Places that a task counts before it hands them on.
COUNT_PLACES = 100_000
#: Bytes of wrappers and static places that are broadcast at most; beyond that the join shuffles.
BROADCAST_BYTES = 32 << 20

# Elements of HTML by their part in a page.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav noscript ol p pre search section select summary table tbody td template tfoot th thead tr ul".split()
)
SPACED = frozenset("br wbr td th img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title iframe object svg math canvas audio video textarea select option datalist".split())
NOT_MAIN = frozenset("nav aside footer form dialog menu search button fieldset".split())
MAIN = frozenset("article main".split())
# Start tags that end an open element of the given kinds.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
P_ENDERS = BLOCK - frozenset("button dd dt li body html td th tr tbody thead tfoot caption legend summary".split())
# Words that tell what an element is for, if a whole token of its class, id or role consists of them: the words alone, or after
# a place on the page and before a kind of box. ADS name what no text of a page's own stands in; some others name that only
# outside of an article.
ADS = "ad|ads|advert|adverts|advertisement|advertising|adsense|sponsor|sponsored|promo|promotion|cookie|cookies|consent|gdpr|popup|disqus|newsletter|subscribe|breadcrumb|breadcrumbs"
OTHERS = (
    "banner|notice|notices|alert|modal|overlay|menu|menubar|nav|navbar|navigation|sidebar|side|aside|complementary|header|masthead|footer|contentinfo|copyright|comment|comments|"
    "respond|replies|reply|related|recommended|share|sharing|social|signup|login|search|form|widget|pagination|pager|tags|toolbar|skip"
)
#: Words that an article's own blocks go by as well: titles, call-outs, columns.
OF_ARTICLES = frozenset("alert banner form header menu modal overlay reply search side skip toolbar widget".split())
_BOX = "area|bar|box|block|list|section|links|buttons|icons|items|posts|articles|[0-9]+"


def _roles(others: str) -> re.Pattern:
    return re.compile(
        f"(?:(?:site|page|main|top|bottom|primary|secondary|global|sub)[_-])?(?:(?:{ADS})(?:[_-](?:{ADS}|{others}|{_BOX}|notice|message|slot|unit|container|wrapper))*|(?:{others})(?:[_-](?:{others}|{_BOX}))?)",
        re.I,
    )


ROLES = _roles(OTHERS)
ROLES_IN_ARTICLE = _roles("|".join(w for w in OTHERS.split("|") if w not in OF_ARTICLES))

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|iframe|textarea|title|svg|math)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*>|(?P<text>[^<]++|<)",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WHITE = re.compile(r"\s+")


@dataclass
class Slot:
    kind: str  # where the text stands: main, doubt (an article in what a class alone calls off), body or off, and the block it is in
    text: str


def _named_off(attrs: list[tuple[str, str, str, str]], here: str) -> str:
    """How an element in region ``here`` says that it is no main text: "role", "class" (or id), or not at all."""
    for name, *values in attrs:
        role = name.lower() == "role"
        for token in next((v for v in values if v), "").split():
            if (ROLES if role or here not in ("main", "doubt") else ROLES_IN_ARTICLE).fullmatch(token):
                return "role" if role else "class"
    return ""


def read_page(html: str) -> tuple[list[str], list[Slot]]:
    """The page's block tokens (``+p``, ``-p``, and ``#`` with the slot's kind), and its slots in order. A slot is the text
    between two block tags, character references decoded, white space joined."""
    tokens: list[str] = []
    slots: list[Slot] = []
    opened: Counter[str] = Counter()  # how many of each name are open
    stack: list[tuple[str, str, bool]] = []  # open block elements, the region inside each, and whether classes alone made it off
    parts: list[str] = []

    def region() -> str:
        return stack[-1][1] if stack else "body"

    def flush() -> None:
        text = _WHITE.sub(" ", "".join(parts)).strip()
        parts.clear()
        if text:
            kind = f"{region()}|{stack[-1][0] if stack else ''}"
            if tokens and tokens[-1] == "#" + kind:  # inline and hidden elements only lie between
                slots[-1].text += " " + text
            else:
                tokens.append("#" + kind)
                slots.append(Slot(kind, text))

    def close(name: str) -> None:
        while stack:
            top = stack.pop()[0]
            opened[top] -= 1
            tokens.append("-" + top)
            if top == name:
                return

    for m in _TOKEN.finditer(html):
        if (text := m["text"]) is not None:
            parts.append(unescape(text) if "&" in text else text)
            continue
        name = (m["name"] or "").lower()
        if not name or name not in BLOCK:
            if name in SPACED:
                parts.append(" ")
            continue
        flush()
        if m["end"]:
            if opened[name]:
                close(name)
            continue
        if name in P_ENDERS and opened["p"]:
            close("p")
        elif name in ENDS:
            for n, *_ in reversed(stack):
                if n in ("ul", "ol", "dl", "table"):
                    break
                if n in ENDS[name]:
                    close(n)
                    break
        if name in VOID:
            continue
        here, by_class = region(), bool(stack) and stack[-1][2]
        attrs = _ATTR.findall(m["attrs"]) if m["attrs"] and (here != "off" or by_class) else []
        if here != "off" or by_class:
            said = "" if name in ("html", "body") or name in MAIN and here != "off" else _named_off(attrs, here)
            if name in NOT_MAIN or name in HIDDEN or (name == "header" and here != "main") or said == "role":
                here, by_class = "off", False
            elif here == "off":
                if name in MAIN and not said:
                    here, by_class = "doubt" if name == "article" else "main", False
            elif said:
                here, by_class = "off", here != "main"
            elif name in MAIN or here != "doubt" and any(re.search(r"\bmain\b", v) for _, *values in attrs for v in values):
                here = "doubt" if here == "doubt" else "main"
        tokens.append("+" + name)
        stack.append((name, here, by_class))
        opened[name] += 1
    flush()
    while stack:
        tokens.append("-" + stack.pop()[0])
    return tokens, slots


# A wrapper's expression is a tuple of nodes: a token, ("+", nodes) for a repeated group, ("?", nodes) for an optional one.
Node = str | tuple
Nodes = tuple


#: Hashes of runs of tokens: a prime and a base. Equal hashes only suggest a repeat, which is then compared.
_PRIME, _BASE = (1 << 61) - 1, 1_000_003_579


class _Runs:
    """How far the runs of codes at two places agree, forwards and backwards, in logarithmic time."""

    def __init__(self, codes: list[int]):
        self.codes, self.sums, self.powers = codes, [0], [1]
        for c in codes:
            self.sums.append((self.sums[-1] * _BASE + c + 1) % _PRIME)
            self.powers.append(self.powers[-1] * _BASE % _PRIME)

    def _same(self, i: int, j: int, n: int) -> bool:
        of = lambda k: (self.sums[k + n] - self.sums[k] * self.powers[n]) % _PRIME
        return of(i) == of(j)

    def _longest(self, most: int, same: Callable[[int], bool]) -> int:
        low, step = 0, 1
        while low + step <= most and same(low + step):
            low += step
            step *= 2
        high = min(most, low + step)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if same(middle) else (low, middle - 1)
        return low

    def repeats(self, i: int, gap: int) -> bool:
        """Whether a group of ``gap`` codes that reaches over place ``i`` is followed by itself."""
        j = i + gap
        ahead = self._longest(min(gap, len(self.codes) - j), lambda n: self._same(i, j, n))
        back = self._longest(min(gap, i), lambda n: self._same(i - n, j - n, n))
        return ahead + back >= gap


def collapse(nodes: Nodes) -> Nodes:
    """Adjacent equal groups become one repeated group, from short groups to long ones, until nothing repeats. A pass is made for
    each length of group that does repeat; as a pass of length k takes away k nodes at least, there are few."""
    known: dict[object, int] = {}
    made: list[Node] = []  # the node of each code
    inner: list[tuple[int, ...] | None] = []  # of repeated groups their codes

    def code(key: object, node: Node, codes: tuple[int, ...] | None) -> int:
        if key not in known:
            known[key] = len(made)
            made.append(node)
            inner.append(codes)
        return known[key]

    def of(n: Node) -> int:
        return code(("+", tuple(of(x) for x in n[1])), n, tuple(of(x) for x in n[1])) if isinstance(n, tuple) and n[0] == "+" else code(n, n, None)

    out = [of(n) for n in nodes]
    size = 0
    while True:
        # A group of k codes that repeats reaches over one place divisible by k: n/1 + n/2 + ... places to look at.
        runs = _Runs(out)
        size = next((k for k in range(size + 1, len(out) // 2 + 1) if any(out[i] == out[i + k] and runs.repeats(i, k) for i in range(0, len(out) - k, k))), 0)
        if not size:
            return tuple(made[c] for c in out)
        # How many codes from each place on equal those ``size`` places later.
        equal = [0] * (len(out) + 1)
        for i in range(len(out) - size - 1, -1, -1):
            equal[i] = equal[i + 1] + 1 if out[i] == out[i + size] else 0
        done: list[int] = []
        i = 0
        while i < len(out):
            if equal[i] >= size:
                group = tuple(out[i : i + size])
                single = size == 1 and inner[group[0]] is not None
                done.append(group[0] if single else code(("+", group), ("+", tuple(made[c] for c in group)), group))
                i += (equal[i] // size + 1) * size
            elif done and (before := inner[done[-1]]) is not None and tuple(out[i : i + len(before)]) == before:
                i += len(before)
            else:
                done.append(out[i])
                i += 1
        out = done


def _fold(nodes: Nodes, groups: set[Nodes]) -> Nodes:
    """Single occurrences of groups that repeat elsewhere become repeated groups as well."""
    out: list[Node] = []
    i = 0
    beginning: dict[Node, list[Nodes]] = {}
    for g in sorted(groups, key=lambda g: (-len(g), repr(g))):
        beginning.setdefault(g[0], []).append(g)
    while i < len(nodes):
        hit = next((g for g in beginning.get(nodes[i], ()) if nodes[i : i + len(g)] == g), None)
        if hit:
            if not (out and out[-1] == ("+", hit)):
                out.append(("+", hit))
            i += len(hit)
        else:
            if not (out and isinstance(nodes[i], tuple) and out[-1] == nodes[i]):
                out.append(nodes[i])
            i += 1
    return tuple(out)


def _groups(nodes: Nodes) -> set[Nodes]:
    return {n[1] for n in nodes if isinstance(n, tuple) and n[0] == "+"}


def _bare(nodes: Nodes) -> list[Node]:
    """Optional groups taken apart: what alignment compares."""
    return [x for n in nodes for x in (_bare(n[1]) if isinstance(n, tuple) and n[0] == "?" else [n])]


def _options(nodes: Nodes) -> list[int]:
    """Of each bare node the number of the optional group that it is in, 0 for none."""
    out: list[int] = []
    for k, n in enumerate(nodes, 1):
        out += [k if isinstance(n, tuple) and n[0] == "?" else 0] * len(_bare((n,)))
    return out


def _free(n: Node) -> bool:
    """Whether a node is a repeated group of single optional tokens, which takes these tokens in any order."""
    return isinstance(n, tuple) and n[0] == "+" and all(isinstance(x, tuple) and x[0] == "?" and len(x[1]) == 1 and isinstance(x[1][0], str) for x in n[1])


def _loosened(nodes: list[Node]) -> Nodes:
    """Many optional groups in a row, or some with a free part among them, become one free part. So a wrapper stays as small as its
    fixed nodes and the kinds of tokens between them, however many pages without a common order it is made of."""
    out: list[Node] = []
    for optional, run in groupby(nodes, key=lambda n: isinstance(n, tuple) and n[0] == "?"):
        run = list(run)
        if optional and (len(run) > LOOSE or len(run) > 1 and any(_free(x) for n in run for x in n[1])):
            run = [("?", (("+", tuple(("?", (t,)) for t in sorted(set(_tokens(run))))),))]
        out += run
    return tuple(out)


def align(a: Nodes, b: Nodes) -> Nodes:
    """The wrapper of both: what only one has becomes optional, what is optional in one stays so, in groups as before."""
    groups = _groups(a) | _groups(b)
    a, b = _fold(a, groups), _fold(b, groups)
    if a == b:
        return a
    x, y = _bare(a), _bare(b)
    of_x, of_y = _options(a), _options(b)
    out: list[Node] = []

    def option(run: list[Node]) -> None:
        if run:
            out.append(("?", tuple(run)))

    i = j = 0
    for p, q, n in _matching_blocks(x, y):
        option(x[i:p])
        option(y[j:q])
        for within, run in groupby(range(n), key=lambda k: (of_x[p + k], of_y[q + k])):
            nodes = [x[p + k] for k in run]
            if any(within):
                option(nodes)
            else:
                out += nodes
        i, j = p + n, q + n
    return _loosened(out)


def _leaves(nodes: Nodes) -> int:
    return sum(_leaves(n[1]) if isinstance(n, tuple) else 1 for n in nodes)


def _match(nodes: Nodes, tokens: list[str]) -> list[int] | None:
    """Which leaf of ``nodes``, counted in order, each token fills; none if they do not match. Groups are possessive."""
    out: list[int] = []

    def walk(nodes: Nodes, leaf: int) -> bool:
        for n in nodes:
            if not isinstance(n, tuple):
                if len(out) == len(tokens) or tokens[len(out)] != n:
                    return False
                out.append(leaf)
                leaf += 1
                continue
            if _free(n):
                at = {x[1][0]: leaf + k for k, x in enumerate(n[1])}
                while len(out) < len(tokens) and tokens[len(out)] in at:
                    out.append(at[tokens[len(out)]])
                leaf += len(at)
                continue
            rounds = 0
            while True:
                before = len(out)
                if not walk(n[1], leaf):
                    del out[before:]
                    break
                rounds += 1
                if n[0] == "?" or len(out) == before:
                    break
            if n[0] == "+" and not rounds:
                return False
            leaf += _leaves(n[1])
        return True

    return out if walk(nodes, 0) and len(out) == len(tokens) else None


#: Tokens of both sides, multiplied, up to which the longest common run is looked for by the standard library; runs are the same.
SMALL = 4096


def _longest_run(x: list[int], y: list[int]) -> tuple[int, int, int]:
    """(place in x, place in y, length) of the longest run that both have; of several the first in x, then in y. By an automaton of
    all runs of y, in linear time."""
    step: list[dict[int, int]] = [{}]
    link, length, ends = [-1], [0], [-1]
    tip = 0
    for k, c in enumerate(y):
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[tip] + 1)
        ends.append(k)
        p = tip
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] != length[p] + 1:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                ends.append(ends[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = copy
                q = copy
            link[new] = q
        tip = new
    best = (0, 0, 0)
    at = n = 0
    for k, c in enumerate(x):
        while at and c not in step[at]:
            at = link[at]
            n = length[at]
        if c in step[at]:
            at, n = step[at][c], n + 1
            if n > best[2]:
                best = (k - n + 1, ends[at] - n + 1, n)
    return best


def _matching_blocks(x: list[Node], y: list[Node]) -> list[tuple[int, int, int]]:
    """Runs that both have: the longest, then the longest before and after it, and so on; at the end an empty one. The same at
    every length."""
    known: dict[Node, int] = {}
    a, b = ([known.setdefault(n, len(known)) for n in z] for z in (x, y))
    open_, blocks = [(0, len(a), 0, len(b))], []
    while open_:
        a0, a1, b0, b1 = open_.pop()
        if a0 == a1 or b0 == b1:
            continue
        if (a1 - a0) * (b1 - b0) <= SMALL:
            blocks += [(a0 + p, b0 + q, n) for p, q, n in SequenceMatcher(None, a[a0:a1], b[b0:b1], autojunk=False).get_matching_blocks() if n]
            continue
        p, q, n = _longest_run(a[a0:a1], b[b0:b1])
        if n:
            blocks.append((a0 + p, b0 + q, n))
            open_ += [(a0, a0 + p, b0, b0 + q), (a0 + p + n, a1, b0 + q + n, b1)]
    out: list[tuple[int, int, int]] = []
    for p, q, n in sorted(blocks):
        if out and out[-1][0] + out[-1][2] == p and out[-1][1] + out[-1][2] == q:
            out[-1] = (out[-1][0], out[-1][1], out[-1][2] + n)
        else:
            out.append((p, q, n))
    return [*out, (len(a), len(b), 0)]


def _tokens(nodes: Iterable[Node], rounds: int = 1) -> list[str]:
    """The tokens of ``nodes``, of groups so many times: a page of such a structure."""
    return [t for n in nodes for t in (_tokens(n[1], rounds) * rounds if isinstance(n, tuple) else [n])]


def _packed(nodes: Nodes) -> str:
    return json.dumps(nodes, ensure_ascii=False, separators=(",", ":"))


def _unpacked(text: str) -> Nodes:
    of = lambda x: tuple(map(of, x)) if isinstance(x, list) else x
    return of(json.loads(text))


@dataclass
class Wrapper:
    nodes: Nodes | None = None
    pages: int = 0  # different structures of pages that it is made of
    _regex: re.Pattern | None = None
    _codes: dict[str, str] = field(default_factory=dict)

    def learn(self, nodes: Nodes, pages: int = 1) -> Wrapper:
        """The wrapper of what this one and ``nodes``, a page's structure or a wrapper of several ``pages``, are made of."""
        if self.nodes is None:
            return Wrapper(nodes, pages)
        if pages == 1 and self.covers(_tokens(nodes, 2)):
            return Wrapper(self.nodes, self.pages + 1, self._regex, self._codes)
        return Wrapper(align(self.nodes, nodes), self.pages + pages)

    def covers(self, tokens: list[str]) -> bool:
        if self.nodes is None:
            return False
        if self._regex is None:
            self._regex = re.compile(self._expression(self.nodes))
        codes = self._codes
        return all(t in codes for t in tokens) and self._regex.fullmatch("".join([codes[t] for t in tokens])) is not None

    def _expression(self, nodes: Nodes) -> str:
        # Groups are possessive, so that matching takes linear time.
        out = []
        for n in nodes:
            if _free(n):
                out.append(f"[{self._expression([x[1][0] for x in n[1]])}]*+")
            elif isinstance(n, tuple):
                out.append(f"(?:{self._expression(n[1])}){n[0]}+")
            else:
                out.append(self._codes.setdefault(n, chr(0xE000 + len(self._codes))))
        return "".join(out)

    def places(self, tokens: list[str]) -> list[str]:
        """The place of each slot of the page, led by the slot's region."""
        leaf: list[int | None] = [None] * len(tokens)
        if self.covers(tokens):
            leaf = _match(self.nodes, tokens) or leaf
        elif self.nodes is not None:
            page = _fold(collapse(tuple(tokens)), _groups(self.nodes))
            if (own := _match(page, tokens)) is not None:
                x, y = _bare(self.nodes), _bare(page)
                at_x, at_y = ([0, *accumulate(_leaves((n,)) for n in z)] for z in (x, y))
                of = {at_y[q + k]: at_x[p + k] for p, q, n in _matching_blocks(x, y) for k in range(n)}
                alike: dict[int, int] = {first + k: there + k for first, there in of.items() for k in range(at_y[bisect(at_y, first)] - first)}
                leaf = [alike.get(k) for k in own]
        out, stack = [], []
        for t, k in zip(tokens, leaf, strict=True):
            if t[0] == "+":
                stack.append(t[1:])
            elif t[0] == "-":
                stack.pop()
            else:
                out.append(f"{t[1:].split('|')[0]}:{'/' + '/'.join(stack) if k is None else k}")
        return out


def merged(parts: Iterable[tuple[str, int]]) -> Wrapper:
    """The wrapper of structures or wrappers (packed, with the number of structures in each), in an order of their own."""
    w = Wrapper()
    for text, pages in sorted(parts, key=lambda p: (-len(p[0]), p)):
        w = w.learn(_unpacked(text), pages)
    return w


def infer(pages: list[str]) -> Wrapper:
    """The wrapper of pages of one host."""
    return merged((text, 1) for text in {_packed(collapse(tuple(read_page(html)[0]))) for html in pages})


def candidates(slots: list[Slot]) -> list[int]:
    """Which slots may be main text: those in an article or main element, or without any, those of the body and of articles
    that only a class around them calls off."""
    regions = [s.kind.split("|")[0] for s in slots]
    wanted = ("main",) if "main" in regions else ("body", "doubt")
    return [k for k, r in enumerate(regions) if r in wanted]


def main_text(html: str | None, wrapper: Wrapper, static: frozenset[str] = frozenset()) -> str:
    """The page's main text, without the slots whose places are ``static`` on its host."""
    tokens, slots = read_page(html or "")
    found = candidates(slots)
    if static and found:
        places = wrapper.places(tokens)
        found = [k for k in found if places[k] not in static] or found
    return "\n".join(slots[k].text for k in found)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def structures(pages: DataFrame) -> DataFrame:
    """(host, structure): the different collapsed streams of all pages of each host, packed; pages without blocks and text have none."""
    arrow_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[bytes] = set()
        for batch in batches:
            found: dict[tuple[str, str], None] = {}
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                tokens = tuple(read_page(html)[0])
                stream = blake2b("\0".join((host, *tokens)).encode("utf-8", "replace"), digest_size=16).digest()
                if not tokens or stream in known:
                    continue
                if len(known) >= KNOWN_STREAMS:
                    known.clear()
                known.add(stream)
                found[host, _packed(collapse(tokens))] = None
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*found)], names=["host", "structure"])

    rows = pages.where(F.col("html").isNotNull()).select(host_of(F.col("url")).alias("host"), "html")
    return rows.mapInArrow(lean(run), "host string, structure string").distinct()


def infer_wrappers(pages: DataFrame, group: int = MERGED) -> DataFrame:
    """(host, wrapper): a pickled wrapper for each host, from all of its pages. Structures that differ are merged in groups of
    about ``group``, dealt by a hash, then what the groups made, and so on: no task meets all structures of a host that has many."""
    rows = settled(structures(pages).select("host", "structure", F.xxhash64("structure").alias("part"), F.lit(1).cast("long").alias("pages")))
    most = rows.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    level = 0
    while group ** (level + 1) < most:
        level += 1

    def merging(last: bool):
        def work(pdf: pd.DataFrame) -> pd.DataFrame:
            import pickle

            w = merged(zip(pdf["structure"], pdf["pages"].tolist(), strict=True))
            made = {"wrapper": [pickle.dumps((w.nodes, w.pages))]} if last else {"structure": [_packed(w.nodes)], "part": [pdf["part"].iloc[0]], "pages": [w.pages]}
            return pd.DataFrame({"host": [pdf["host"].iloc[0]]} | made)

        return work

    for k in range(level, -1, -1):
        parts = rows.withColumn("part", F.pmod(F.col("part"), F.lit(group**k))).groupBy("host", "part")
        rows = settled(parts.applyInPandas(merging(False), "host string, structure string, part long, pages long")) if k else parts.applyInPandas(merging(True), "host string, wrapper binary")
    return rows


def _by_wrapper(pages: DataFrame, wrappers: DataFrame, keep: list[str], schema: str, make: Callable) -> DataFrame:
    """``make()`` gives, once in each task, the function from a batch's pages (html, host, wrapper, its static places) and the
    batch itself to a batch of ``schema``; called with nothing, it gives what is left at the end."""
    arrow_batches(pages.sparkSession)
    wrappers = wrappers.select(F.col("host").alias("_llm_host"), F.col("wrapper").alias("_llm_wrapper"), F.col("static").alias("_llm_static"))
    size = F.octet_length("_llm_wrapper") + F.length(F.array_join(F.coalesce("_llm_static", F.array().cast("array<string>")), "")) + 100
    if (wrappers.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES:
        wrappers = F.broadcast(wrappers)
    source = pages.select(*keep, F.col("html").alias("_llm_html"), host_of(F.col("url")).alias("_llm_host"))
    joined = source.join(wrappers, "_llm_host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        work = make()
        known: dict[str, tuple[Wrapper, frozenset[str]]] = {}
        for batch in batches:
            rows = []
            packed = batch.column("_llm_wrapper").dictionary_encode()
            wrapper_of = packed.dictionary.to_pylist()
            static = batch.column("_llm_static")
            for k, (html, host, code) in enumerate(zip(batch.column("_llm_html").to_pylist(), batch.column("_llm_host").to_pylist(), packed.indices.to_pylist(), strict=True)):
                if host not in known:
                    if len(known) > 2000:
                        known.clear()
                    known[host] = (Wrapper(*pickle.loads(wrapper_of[code])) if code is not None else Wrapper(), frozenset(static[k].as_py() or ()))
                rows.append((html, host, *known[host]))
            if (out := work(rows, batch)) is not None:
                yield out
        if (out := work([], None)) is not None:
            yield out

    return joined.mapInArrow(lean(run), schema)


def _hash(*texts: str) -> int:
    """64 bits of the texts."""
    return int.from_bytes(blake2b("\0".join(texts).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def with_static(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """``wrappers`` (host, wrapper) with the ``static`` places of each host, counted over all its pages. A task hands on the
    least and the greatest hash of each place's texts, and hashes of as many different pages as have to agree."""
    most = max(STATIC_PAGES.values())

    def make():
        seen: dict[tuple[str, str], list] = {}

        def work(rows: list, batch: pa.RecordBatch | None) -> pa.RecordBatch | None:
            for html, host, wrapper, _ in rows:
                tokens, slots = read_page(html or "")
                found = [k for k in candidates(slots) if slots[k].kind.split("|")[0] in STATIC_PAGES]
                if not found:
                    continue
                places = wrapper.places(tokens)
                page = _hash(*(slots[k].text for k in found))
                for k in found:
                    h = _hash(slots[k].text)
                    s = seen.setdefault((host, places[k]), [h, h, set()])
                    s[0], s[1] = min(s[0], h), max(s[1], h)
                    if len(s[2]) < most:
                        s[2].add(page)
            if not seen or (batch is not None and len(seen) < COUNT_PLACES):
                return None
            out = [(host, place, lo, hi, page) for (host, place), (lo, hi, own) in seen.items() for page in own]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["host", "place", "lo", "hi", "page"])

        return work

    counts = _by_wrapper(pages, wrappers.withColumn("static", F.lit(None).cast("array<string>")), [], "host string, place string, lo long, hi long, page long", make)
    each = counts.groupBy("host", "place", "page").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    places = each.groupBy("host", "place").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("pages"))
    enough = F.create_map(*(F.lit(x) for pair in STATIC_PAGES.items() for x in pair))[F.substring_index("place", ":", 1)]
    static = places.where((F.col("lo") == F.col("hi")) & (F.col("pages") >= enough)).groupBy("host").agg(F.collect_list("place").alias("static"))
    return wrappers.select("host", "wrapper").join(static, "host", "full")


def extract(pages: DataFrame, wrappers: DataFrame, keep: list[str] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` of each page, and its main ``text``."""
    schema = pages.select(*keep).schema.simpleString()[7:-1] + ",text string"

    def make():
        def work(rows: list, batch: pa.RecordBatch | None) -> pa.RecordBatch | None:
            if batch is None:
                return None
            texts = [main_text(html, wrapper, static) for html, _, wrapper, static in rows]
            return pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(texts, pa.string())], names=[*keep, "text"])

        return work

    wrappers = settled(wrappers)
    return _by_wrapper(pages, settled(with_static(pages, wrappers)), list(keep), schema, make)
