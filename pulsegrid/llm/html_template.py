"""Main-text extraction by equivalence classes of page structure.

The tokens of a page are its containers (div, nav, article, ... with their class, id and role), each told apart
by the path of containers above it, and its blocks of text, told apart by path and text. A token's occurrence
vector says how often each page of its host has it; tokens with equal vectors are an equivalence class, and the
classes that at least half of a host's pages hold are its template, nested as their paths are. A block of text repeats
with the template if its class has a container around it, so that it is wherever that container is, or if nearly
all pages have it. A container whose text is nothing else is template text as a whole; headings and phrases that repeat among
text of a page's own stay, as they are part of it. Slots are what lies between template tokens; the best ones of each host
are the main text: those of an article or main element, else those with the most text outside links. What a
page holds there or anywhere below, less menus, forms and other boilerplate, is its text. Containers that few
pages have are no template tokens; their text belongs to the template token they lie in.

Vectors are never written out: a class is told by the XOR of hash(page, count) over its pages, by the number of
pages and by the total, all of them sums that are made before the shuffle, so a host with a third of all pages
costs a row for each token and task. Pages meet their host's template in a join; pages of one host need not be
in one task.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Element names by what they do to text.
CONTAINERS = frozenset("html head body div section article main nav header footer aside form fieldset dialog table button select textarea object title menu noscript figure".split())
BOILERPLATE = frozenset("head title nav footer aside form fieldset dialog button select textarea object menu noscript".split())
BREAKS = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd pre blockquote tr td th caption hr address figcaption details summary option".split())
MAIN = frozenset("article main".split())
#: Never the text of a page, whatever they hold.
NO_TEXT = frozenset("head title button select textarea".split())
#: Lists and paragraphs, which are containers where they are marked.
LISTS = frozenset("ul ol dl li dt dd blockquote address details pre".split())
ITEMS, PARAGRAPHS = frozenset("li dt dd".split()), frozenset("p h1 h2 h3 h4 h5 h6".split())
#: Words that mark boilerplate. A class, id or role is a mark if it has one of them and else only FILL.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "footer header masthead sidebar aside widget widgets cookie cookies consent notice notices alert popup modal overlay share sharing social "
    "comment comments disqus respond reply replies related recommended newsletter subscribe subscription signup login search form complementary contentinfo "
    "advertorial adsense taboola outbrain".split())
FILL = frozenset("list item items box bar area section block link links button buttons text title top bottom left right wrapper wrap container site page main post posts entry article articles story stories inner outer global primary secondary slot tool tools unit zone "
    "placement panel module group row column label message icons feed more".split())

#: Fixed value: elements whose contents are no markup and never text.
SKIPPED = "script style template svg iframe".split()

_START = re.compile(r"<(?:!--|(/?)([a-z][a-z0-9:-]*)|[!?/])", re.I)
_REST = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+>""")
_OVER = {name: re.compile(rf"</{name}\s*>", re.I) for name in SKIPPED}
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_ROOT = 0
SLOT = ("path", "times", "boilerplate", "main", "above", "chars", "linked", "said")
#: Hosts of fewer pages have no template text, as nothing tells it from theirs; NEARLY is the share that is nearly all.
FEWEST, NEARLY = 4, (9, 10)
#: Parts that a host's template tokens are gathered in.
PARTS = 32


def tags(source: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of each tag, comment and skipped element; the last two have no name.

    The text is passed over once. A tag that nothing ends runs to the end of the page, as do comments and skipped
    elements. Once quotes in a tag are never closed, a tag ends at the next > from there on, whatever quotes say.
    """
    at, last, quotes = 0, source.rfind(">"), True
    while found := _START.search(source, at):
        start, name = found.start(), (found[2] or "").lower()
        if found[0] == "<!--":
            end = source.find("-->", found.end())
            at = end + 3 if end >= 0 else len(source)
        elif start > last:
            at = len(source)
            name = ""
        elif not name:
            at = source.find(">", start) + 1
        else:
            rest = _REST.match(source, found.end()) if quotes else None
            quotes = rest is not None
            at = rest.end() if rest else source.find(">", found.end()) + 1
            if name in _OVER and not found[1]:
                over = _OVER[name].search(source, at)
                at, name = over.end() if over else len(source), ""
        yield start, at, name, bool(found[1]), source[found.end() : at - 1] if name else ""


def marked(named: list[str]) -> bool:
    """Whether one of the blank-separated names marks boilerplate: menu and comment-list do, has-sidebar does not."""
    for token in " ".join(named).split():
        words = _WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token).lower())
        if not MARKS.isdisjoint(words) and all(w in MARKS or w in FILL for w in words):
            return True
    return False


class Page:
    """The blocks of a page and the containers it has, by path."""

    def __init__(self, source: str | None):
        #: (path, text, characters in links) in page order
        self.blocks: list[tuple[int, str, int]] = []
        #: path -> [times, characters, of which in links, boilerplate, main]
        self.paths: dict[int, list[int]] = {_ROOT: [1, 0, 0, 0, 0]}
        #: path -> the path around it; paths come after the one around them
        self.above: dict[int, int] = {_ROOT: _ROOT}
        #: path -> element name of those that a name or word marks as boilerplate
        self.marks: dict[int, str] = {}
        self._stack: list[tuple[str, int, bool]] = [("", _ROOT, False)]
        #: how many elements of each name, lists and marked ones the stack holds
        self._names: Counter = Counter()
        self._lists = self._marked = 0
        self._parts: list[str] = []
        self._links = self._linked = 0
        source, at = source or "", 0
        for start, end, name, closing, attributes in tags(source):
            self._say(source[at:start])
            at = end
            if name:
                self._tag(name, closing, attributes)
        self._say(source[at:])
        self._flush()
        self._judge()

    def _say(self, text: str) -> None:
        if text:
            self._parts.append(text)
            if self._links:
                self._linked += len(text)

    def _flush(self) -> None:
        text = " ".join(entities.unescape("".join(self._parts)).split()) if self._parts else ""
        if text:
            path = self._stack[-1][1]
            linked = min(self._linked, len(text))
            self.blocks.append((path, text, linked))
            self.paths[path][1] += len(text)
            self.paths[path][2] += linked
        self._parts, self._linked = [], 0

    def _tag(self, name: str, closing: bool, attributes: str) -> None:
        if name == "a":
            self._links = 0 if closing else 1
        elif name == "br":
            self._parts.append(" ")
        elif name in BREAKS:
            self._flush()
            self._soft(name, closing, attributes)
        elif name in CONTAINERS:
            self._flush()
            self._links = 0
            if closing:
                self._close(name)
                return
            if name == "body":
                while self._names["head"]:
                    self._pop()
            if attributes.endswith("/"):
                return
            self._paragraph_ends()
            self._open(name, attributes)

    def _push(self, name: str, path: int) -> None:
        by_mark = path in self.marks
        self._stack.append((name, path, by_mark))
        self._names[name] += 1
        self._lists += name in LISTS
        self._marked += by_mark

    def _pop(self) -> str:
        name, _, by_mark = self._stack.pop()
        self._names[name] -= 1
        self._lists -= name in LISTS
        self._marked -= by_mark
        return name

    def _close(self, name: str) -> None:
        """End the innermost element of the name and all in it; nothing, if none is open."""
        if self._names[name]:
            while self._pop() != name:
                pass

    def _open(self, name: str, attributes: str) -> None:
        named = [" ".join(x or "" for x in m.groups()) for m in _NAMED.finditer(attributes)]
        words = sorted({w for x in named for w in _WORD.findall(x.lower())})
        around, by_word = self._stack[-1][1], name not in ("html", "body") and marked(named)
        path = xxhash.xxh3_64_intdigest(f"{around} {name} {' '.join(named if by_word else words)}") - (1 << 63)
        self.above.setdefault(path, around)
        own = self.paths.setdefault(path, [0, 0, 0, 0, 0])
        own[0] += 1
        by_name = name in BOILERPLATE or name == "header" and not self.paths[around][4]  # an article's own header holds its title
        if by_name or by_word and name not in MAIN:
            self.marks[path] = name
        if name in MAIN:  # an article of the comments is none of the page
            is_main = not (by_word and self._marked)
        else:
            is_main = "main" in words and not by_word and name != "body"
        own[4] |= self.paths[around][4] or is_main
        self._push(name, path)

    def _paragraph_ends(self) -> None:
        if self._stack[-1][0] in PARAGRAPHS:
            self._pop()

    def _soft(self, name: str, closing: bool, attributes: str) -> None:
        """Lists and paragraphs with a mark are containers up to their end; so are lists and items inside them."""
        if closing:
            self._close(name)
            return
        self._paragraph_ends()
        if name in ITEMS and self._stack[-1][0] in ITEMS:
            self._pop()
        if name not in LISTS and name not in PARAGRAPHS:
            return
        if name in LISTS and self._lists or marked([" ".join(x or "" for x in m.groups()) for m in _NAMED.finditer(attributes)]):
            self._open(name, attributes)

    def _judge(self) -> None:
        """Set boilerplate: what is marked and all below it. Marks do not count around an article or main, nor on a
        page without them, where they would take most of the text outside links."""
        heavy: dict[int, int] = {}
        never: set[int] = set()
        for path, above in self.above.items():
            if above in never or self.marks.get(path) in NO_TEXT:
                never.add(path)
            v = self.paths[path]
            heavy[path] = 0 if path in never else max(0, v[1] - v[2])
        if any(heavy[path] for path in heavy if self.paths[path][4]):
            heavy = {path: n if self.paths[path][4] else 0 for path, n in heavy.items()}
        for path in reversed(self.above):
            if path != _ROOT:
                heavy[self.above[path]] += heavy[path]
        for path, above in self.above.items():
            if path != _ROOT:
                v, around = self.paths[path], self.paths[above]
                most = heavy[path] * 2 > heavy[_ROOT] and not around[4]
                v[3] = int(around[3] or path in self.marks and (path in never or not most))

    def rows(self) -> list[tuple[int, ...]]:
        """SLOT of each path, with all free text in it or below, and of each free block of text (said = 1)."""
        within = {path: [0, 0] if v[3] else [v[1], v[2]] for path, v in self.paths.items()}
        for path in reversed(self.above):
            if path != _ROOT:
                for k in range(2):
                    within[self.above[path]][k] += within[path][k]
        said: dict[int, list[int]] = {}
        for path, text, linked in self.blocks:
            if not self.paths[path][3]:
                own = said.setdefault(spoken(path, text), [0, path, 0, 0])
                for k, n in ((0, 1), (2, len(text)), (3, linked)):
                    own[k] += n
        containers = [(path, v[0], int(v[3]), int(v[4]), self.above[path], *within[path], 0) for path, v in self.paths.items()]
        return containers + [(token, n, 0, 0, path, chars, linked, 1) for token, (n, path, chars, linked) in said.items()]

    def text(self, kept: set[int] | frozenset[int], links: set[int] | frozenset[int] = frozenset(), template: set[int] | frozenset[int] = frozenset()) -> str:
        """Blocks in the kept paths or below them, without boilerplate, link lists and template text; those of the
        page's own articles too. By the page's own slots if there are none; a page that has template text only,
        as the copies of one page have, keeps it."""
        found = self._in(kept | {path for path, v in self.paths.items() if v[4]}, links, template)
        if not found:
            own = main_slots([r for r in self.rows() if not r[7]])
            found = self._in(*own, template) or self._in(*own)
        return "\n".join(found)

    def _in(self, kept, links, template=()) -> list[str]:
        inside: dict[int, bool] = {}
        for path, above in self.above.items():
            inside[path] = path in kept or path not in links and inside.get(above, False)
        free = [(path, text) for path, text, _ in self.blocks if inside[path] and not self.paths[path][3]]
        return [text for path, text in free if not template or spoken(path, text) not in template]


def spoken(path: int, text: str) -> int:
    """The token of a block of text."""
    return xxhash.xxh3_64_intdigest(f"{path} {text}") - (1 << 63)


def nested_order(containers: dict[int, dict]) -> Iterator[tuple[dict, bool]]:
    """Each container when it opens (True) and when it closes (False), those inside in between."""
    inside: dict[int | None, list[dict]] = {}
    for t in containers.values():
        top = t["path"] == _ROOT or t["above"] not in containers
        inside.setdefault(None if top else t["above"], []).append(t)
    todo = [(t, True) for t in inside.get(None, [])]
    while todo:
        t, opens = todo.pop()
        yield t, opens
        if opens:
            todo.append((t, False))
            todo.extend((c, True) for c in inside.get(t["path"], []))


def repeated_text(tokens: list[dict], pages: int) -> list[dict]:
    """Which blocks of a host's template tokens repeat with it: those in the equivalence class of a container
    around them, and those that nearly all pages have."""
    if pages < FEWEST:
        return []
    said: dict[int, list[dict]] = {}
    for t in tokens:
        if t["said"]:
            said.setdefault(t["above"], []).append(t)
    around: Counter = Counter()
    found = []
    for c, opens in nested_order({t["path"]: t for t in tokens if not t["said"]}):
        around[c["class"]] += 1 if opens else -1
        if opens:
            found += [t for t in said.pop(c["path"], []) if around[t["class"]] > 0 or t["support"] * NEARLY[1] >= pages * NEARLY[0]]
    return found + [t for alone in said.values() for t in alone if t["support"] * NEARLY[1] >= pages * NEARLY[0]]


def choose_slots(tokens: list[dict]) -> tuple[set[int], set[int], set[int]]:
    """The paths of main text, link lists and template text of a host's template tokens."""
    pages = max((t["support"] for t in tokens), default=0)
    repeated = repeated_text(tokens, pages)
    containers = {t["path"]: t for t in tokens if not t["said"]}

    def within(blocks: list[dict]) -> dict[int, list[int]]:
        """Characters, and of those the ones in links, of the blocks in each container or below."""
        held = {path: [0, 0] for path in containers}
        for t in blocks:
            for k, name in enumerate(("chars", "linked")):
                if t["above"] in held:
                    held[t["above"]][k] += t[name]
        for c, opens in nested_order(containers):
            if not opens and c["path"] != _ROOT and c["above"] in held:
                for k in range(2):
                    held[c["above"]][k] += held[c["path"]][k]
        return held

    def whole(c: dict, chars: int) -> bool:
        """Whether a container's text is template text: all of it inside an article, nearly all of it elsewhere."""
        if c["main"]:
            return containers.get(c["above"], {}).get("main") == 1 and chars == c["chars"] > 0
        return c["path"] != _ROOT and 0 < c["chars"] * NEARLY[0] <= chars * NEARLY[1]

    held = within(repeated)
    only = {path for path, c in containers.items() if whole(c, held[path][0])}
    template = [t for t in repeated if t["above"] in only]
    less = within(template)  # template text is no text of its own
    at = {name: k for k, name in enumerate(SLOT)}
    rows = [[t[k] for k in SLOT] for t in containers.values()]
    for row in rows:
        row[at["chars"]] -= less[row[0]][0]
        row[at["linked"]] -= less[row[0]][1]
    return *main_slots(rows), {t["path"] for t in template}


def main_slots(paths: list[tuple[int, ...]]) -> tuple[set[int], set[int]]:
    """Which of the paths (SLOT) hold the main text, and which are lists of
    links that do not. A path's own text is all in it less what lies in others of the paths."""
    own = {p[0]: [p[5], p[6]] for p in paths}
    for p in paths:
        if p[0] != _ROOT and p[4] in own:
            own[p[4]][0] -= p[5]
            own[p[4]][1] -= p[6]
    free = [p for p in paths if not p[2]]
    main = {p[0] for p in free if p[3]}
    if any(own[path][0] for path in main):
        return main, set()
    score = {p[0]: own[p[0]][0] - 2 * own[p[0]][1] for p in free}
    best = max(score, key=lambda path: (score[path], -path), default=_ROOT)
    if not own.get(best, [0])[0]:
        return set(), set()
    slots = {path for path in score if own[path][0] and score[path] >= 0.25 * score[best]}
    return slots, {p[0] for p in free if p[5] and p[5] <= 2 * p[6]} - slots


def host(url) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def _tokens(pages: DataFrame) -> DataFrame:
    """A row for each page and token: _host, page and SLOT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *r) for i, source in enumerate(batch.column("html")) for r in Page(source.as_py()).rows()]
            at = pa.array([r[0] for r in rows], pa.int32())
            numbers = [pa.array([r[k] for r in rows], pa.int64()) for k in range(1, len(SLOT) + 1)]
            yield pa.RecordBatch.from_arrays([batch.column("_host").take(at), batch.column("page_id").take(at), *numbers], ["_host", "page", *SLOT])

    return pages.select(host(F.col("url")).alias("_host"), F.col("page_id").cast("long"), "html").mapInArrow(
        run, f"_host string, page long, {', '.join(f'{k} long' for k in SLOT)}")


def templates(pages: DataFrame) -> DataFrame:
    """_host and slots, the template's tokens as structs of their class, support and SLOT.

    A template token lies in an equivalence class that at least half of the host's pages hold, so there are at
    most twice as many as a page has on average.
    """
    found = _tokens(pages).groupBy("_host", "path").agg(
        F.bit_xor(F.xxhash64("page", "times")).alias("vector"), F.count("*").alias("support"), F.sum("times").alias("times"),
        F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.min("boilerplate").alias("boilerplate"), F.max("main").alias("main"), F.max("above").alias("above"), F.max("said").alias("said"))
    found = materialize(found.where(F.col("support") >= F.when(F.col("said") == 1, FEWEST // 2).otherwise(1)))
    held = found.where(F.col("path") == _ROOT).select("_host", F.col("support").alias("pages"))
    common = found.join(held, "_host").where("support * 2 >= pages")
    slot = F.struct(F.xxhash64("vector", "support", "times").alias("class"), "support", *SLOT)
    # tokens are gathered in parts first, so that those of a host with many don't meet as single rows
    parts = common.groupBy("_host", F.pmod("path", F.lit(PARTS)).alias("_part")).agg(F.collect_list(slot).alias("_slots"))
    return parts.groupBy("_host").agg(F.sort_array(F.flatten(F.collect_list("_slots"))).alias("slots"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of (page_id, url, html).

    Null html has no text; null and odd urls are of the host "". Blocks are joined by one line end; inside a
    block, white space is one blank. Pages of hosts with a single page are their own template. Repeated rows
    give repeated results, and other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for source, *slots in zip(*map(batch.column, ("html", "kept", "links", "template"))):
                texts.append(Page(source.as_py()).text(*[set(s.as_py() or ()) for s in slots]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [choose_slots(slots.as_py()) for slots in batch.column("slots")]
            parts = [pa.array([sorted(f[k]) for f in found], pa.list_(pa.int64())) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("_host"), *parts], ["_host", "kept", "links", "template"])

    chosen = materialize(templates(pages).mapInArrow(choose, "_host string, kept array<long>, links array<long>, template array<long>"))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", host(F.col("url")).alias("_host"))
    return own.join(chosen, "_host", "left").select("page_id", "url", "html", "kept", "links", "template").mapInArrow(run, "page_id long, url string, text string, n_chars long")
