"""Elements of HTML pages: inventory of tags and classes, and selection by CSS selectors or classes.

A page becomes flat lists: elements in document order, each with its parent and with the ranges of elements, strings and
events that it holds, so that its text or its inner HTML is a slice. Tags that nothing closes stay open up to the end tag
of an element around them; an end tag that closes nothing is ignored. Pages are independent rows: no exchange is needed.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from html import escape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import absolute_url

#: Elements that hold nothing, and those whose strings are no text of the elements around them.
VOID = frozenset("area base basefont bgsound br col command embed frame hr image img input isindex keygen link menuitem meta nextid param source spacer track wbr".split())
ASIDE = frozenset(("script", "style", "template", "rt", "rp"))
#: Most classes and tags of a page's inventory, characters of a sample, and rows of a selection from one page.
TOP_CLASSES, TOP_TAGS, SAMPLE, LIMIT = 500, 80, 140, 5000
ROWS_AT_ONCE = 10_000


class Page(HTMLParser):
    """The elements of a page: ``names``, ``attributes``, ``parents`` and the ranges ``held`` (elements), ``said`` (strings)
    and ``made`` (events)."""

    def __init__(self, text: str | None):
        super().__init__(convert_charrefs=True)
        self.names: list[str] = []
        self.attributes: list[dict[str, str]] = []
        self.parents: list[int] = []
        self.held, self.said, self.made = [], [], []
        self.strings: list[tuple[str, str]] = []  # (the element around it whose strings are no text, or '', the string)
        self.events: list[tuple[str, int | str]] = []
        self.open: list[int] = []
        try:
            self.feed(text or "")
            self.close()
        except AssertionError:  # what can't be read further
            pass
        while self.open:
            self.shut()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        i = len(self.names)
        self.names.append(tag)
        self.attributes.append({k: v or "" for k, v in attrs})
        self.parents.append(self.open[-1] if self.open else -1)
        self.events.append(("open", i))
        for ranges, now in ((self.held, i + 1), (self.said, len(self.strings)), (self.made, len(self.events))):
            ranges.append([now, now])
        self.open.append(i)
        if tag in VOID:
            self.shut()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.shut()

    def shut(self) -> None:
        i = self.open.pop()
        self.held[i][1], self.said[i][1], self.made[i][1] = len(self.names), len(self.strings), len(self.events)
        self.events.append(("close", i))

    def handle_endtag(self, tag: str) -> None:
        if any(self.names[i] == tag for i in self.open):
            while self.names[self.open[-1]] != tag:
                self.shut()
            self.shut()

    def handle_data(self, data: str) -> None:
        if self.events and self.events[-1][0] == "string":  # one string, in several pieces
            self.strings[-1] = (self.strings[-1][0], self.strings[-1][1] + data)
            return
        aside = next((self.names[i] for i in reversed(self.open) if self.names[i] in ASIDE), "")
        self.events.append(("string", len(self.strings)))
        self.strings.append((aside, data))

    def handle_comment(self, data: str) -> None:
        self.events.append(("raw", f"<!--{data}-->"))

    def handle_decl(self, decl: str) -> None:
        self.events.append(("raw", f"<!{decl}>"))

    def handle_pi(self, data: str) -> None:
        self.events.append(("raw", f"<?{data}>"))

    def unknown_decl(self, data: str) -> None:
        self.events.append(("raw", f"<![{data}]>"))

    def texts(self, i: int) -> Iterator[str]:
        """The stripped strings of an element, without scripts, styles and comments unless it is one itself."""
        own = self.names[i] if self.names[i] in ASIDE else ""
        for aside, string in self.strings[slice(*self.said[i])]:
            if aside == own and (string := string.strip()):
                yield string

    def text(self, i: int) -> str:
        return " ".join(self.texts(i))

    def classes(self, i: int) -> list[str]:
        return self.attributes[i].get("class", "").split()

    def title(self) -> str:
        """The text of the first title, if that is all it holds."""
        i = next((i for i, n in enumerate(self.names) if n == "title"), None)
        while i is not None:
            inner = self.events[slice(*self.made[i])]
            if len(inner) == 1 and inner[0][0] == "string":
                return self.strings[inner[0][1]][1].strip()
            i = i + 1 if inner and inner[0] == ("open", i + 1) and inner[-1] == ("close", i + 1) else None
        return ""

    def inner_html(self, i: int) -> str:
        out, kept = [], sum(self.names[k] in ("pre", "textarea") for k in self.path(i))
        for kind, x in self.events[slice(*self.made[i])]:
            if kind == "raw":
                out.append(x)
            elif kind == "string":
                aside, string = self.strings[x]
                if not kept and string and not string.strip(" \t\n\r\f"):
                    string = "\n" if "\n" in string else " "
                out.append(string if aside in ("script", "style") else escape(string, quote=False))
            else:
                name = self.names[x]
                kept += (name in ("pre", "textarea")) * (1 if kind == "open" else -1)
                if kind == "open":
                    given = (f" {k}={quoted(' '.join(v.split()) if k == 'class' else v)}" for k, v in self.attributes[x].items())
                    out.append(f"<{name}{''.join(given)}{'/' * (name in VOID)}>")
                elif name not in VOID:
                    out.append(f"</{name}>")
        return "".join(out)

    def path(self, i: int) -> Iterator[int]:
        """An element and those around it."""
        while i >= 0:
            yield i
            i = self.parents[i]

    def siblings(self, i: int) -> list[int]:
        p = self.parents[i]
        inside = range(*self.held[p]) if p >= 0 else range(len(self.names))
        return [k for k in inside if self.parents[k] == p]


def quoted(value: str) -> str:
    value = escape(value, quote=False)
    if '"' not in value:
        return f'"{value}"'
    return f"'{value}'" if "'" not in value else '"' + value.replace('"', "&quot;") + '"'


IDENT = r"(?:\\.|[\w\-]|[^\x00-\x7f])+"
PART = re.compile(
    rf"""(?P<join>\s*[>+~]\s*|\s+)|(?P<tag>\*|{IDENT})|\#(?P<id>{IDENT})|\.(?P<cls>{IDENT})
    |\[\s*(?P<attr>{IDENT})\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<v1>[^"]*)"|'(?P<v2>[^']*)'|(?P<v3>[^\]\s]+))\s*(?P<flag>[iI])?\s*)?\]
    |:(?P<pseudo>[\w\-]+)(?:\((?P<arg>(?:[^()]|\([^()]*\))*)\))?""",
    re.X,
)
Test = Callable[[Page, int], bool]


def plain(name: str) -> str:
    return re.sub(r"\\(.)", r"\1", name)


def attribute_test(name: str, op: str | None, value: str, fold: bool) -> Test:
    low = (lambda x: x.lower()) if fold else (lambda x: x)
    name, value = plain(name).lower(), low(value)
    compare = {
        "=": lambda have: have == value, "~=": lambda have: value in have.split() and bool(value), "|=": lambda have: have == value or have.startswith(value + "-"),
        "^=": lambda have: bool(value) and have.startswith(value), "$=": lambda have: bool(value) and have.endswith(value), "*=": lambda have: bool(value) and value in have,
        None: lambda have: True,
    }[op]
    return lambda page, i: name in page.attributes[i] and compare(low(page.attributes[i][name]))


def nth(arg: str) -> tuple[int, int]:
    """a and b of ``an+b``."""
    arg = {"odd": "2n+1", "even": "2n"}.get(arg.strip().lower(), re.sub(r"\s", "", arg.lower()))
    m = re.fullmatch(r"(?:([+-]?\d*)n)?([+-]?\d+)?", arg)
    if not m or not arg:
        raise ValueError(f"no such place: {arg}")
    a = 0 if m[1] is None else int(m[1] + "1" if m[1] in ("", "+", "-") else m[1])
    return a, int(m[2] or 0)


def place_test(a: int, b: int, last: bool, of_type: bool) -> Test:
    def holds(page: Page, i: int) -> bool:
        family = [k for k in page.siblings(i) if not of_type or page.names[k] == page.names[i]]
        k = (len(family) - family.index(i) if last else family.index(i) + 1) - b
        return k == 0 if a == 0 else k % a == 0 and k // a >= 0

    return holds


def pseudo_test(name: str, arg: str | None) -> Test:
    if name in ("not", "is", "where") and arg:
        inner = selector(arg)
        return (lambda page, i: not inner(page, i)) if name == "not" else inner
    m = re.fullmatch(r"(first|last|only|nth|nth-last)-(child|of-type)", name)
    if m and (arg is not None) == m[1].startswith("nth"):
        of_type = m[2] == "of-type"
        if m[1] == "only":
            first, last = (place_test(0, 1, end, of_type) for end in (False, True))
            return lambda page, i: first(page, i) and last(page, i)
        return place_test(*(nth(arg) if arg is not None else (0, 1)), m[1] in ("last", "nth-last"), of_type)
    if name == "empty":
        return lambda page, i: page.held[i][0] == page.held[i][1] and not any(s.strip() for _, s in page.strings[slice(*page.said[i])])
    if name == "root":
        return lambda page, i: page.parents[i] < 0
    raise ValueError(f"the selector's :{name} is not known")


def compound(text: str) -> list[tuple[str, list[Test]]]:
    """Joins and tests of one selector without commas, from left to right."""
    out, at, join = [("", [])], 0, ""
    text = text.strip()
    while at < len(text):
        m = PART.match(text, at)
        if not m:
            raise ValueError(f"the selector can't be read from here: {text[at:]}")
        at = m.end()
        if m["join"]:
            join = m["join"].strip() or " "
            out.append((join, []))
            continue
        tests = out[-1][1]
        if m["tag"]:
            name = plain(m["tag"]).lower()
            tests.append((lambda page, i: True) if name == "*" else (lambda page, i, n=name: page.names[i] == n))
        elif m["id"]:
            tests.append(attribute_test("id", "=", plain(m["id"]), False))
        elif m["cls"]:
            tests.append(lambda page, i, c=plain(m["cls"]): c in page.classes(i))
        elif m["attr"]:
            tests.append(attribute_test(m["attr"], m["op"], next((v for v in (m["v1"], m["v2"], m["v3"]) if v is not None), ""), bool(m["flag"])))
        else:
            tests.append(pseudo_test(m["pseudo"].lower(), m["arg"]))
    if not all(tests for _, tests in out):
        raise ValueError(f"a part of the selector is empty: {text}")
    return out


def split_commas(text: str) -> list[str]:
    """Selectors of a list; commas in brackets and quotes don't divide."""
    return [x for x in re.findall(r"""((?:"[^"]*"|'[^']*'|\((?:[^()]|\([^()]*\))*\)|\\.|[^,"'(\\])+)""", text)] if text.strip() else []


def selector(text: str) -> Test:
    """Whether an element is matched by a list of CSS selectors: tag, ``*``, ``#id``, ``.class``, attributes, places among
    siblings, ``:not``, ``:is``, ``:empty``, ``:root``, joined by blanks, ``>``, ``+`` and ``~``. ValueError for another."""
    ways = [compound(x) for x in split_commas(text)]
    if not ways:
        raise ValueError("the selector is empty")

    def matches(page: Page, i: int, way: list, k: int) -> bool:
        join, tests = way[k]
        if not all(t(page, i) for t in tests):
            return False
        if k == 0:
            return True
        if join in " >":
            around = list(page.path(i))[1:]
        else:
            before = page.siblings(i)
            around = before[: before.index(i)][::-1]
        return any(matches(page, p, way, k - 1) for p in (around if join in " ~" else around[:1]))

    return lambda page, i: any(matches(page, i, way, len(way) - 1) for way in ways)


# ---- table functions ----


def page_rows(df: DataFrame, html: str, fields: T.StructType, rows: Callable[[Page], Iterator[tuple]]) -> DataFrame:
    """The other columns of ``df`` and ``fields``, a row for each tuple that ``rows`` gives of a page. Null pages give none.
    An own column of ``df`` with a field's name goes."""
    new = {f.name.lower() for f in fields}
    keep = [c for c in df.columns if c != html and c.lower() not in new]
    schema = T.StructType([*(df.schema[c] for c in keep), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(fields)

        def made(b: pa.RecordBatch, at: list[int], out: list[tuple]) -> pa.RecordBatch:
            cols = [pa.array(c, k.type) for c, k in zip(zip(*out) if out else [[]] * len(kinds), kinds)]
            return pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in b.columns[:-1]), *cols], schema.names)

        for b in batches:
            at, out = [], []
            for i, text in enumerate(b.column(len(keep)).to_pylist()):
                for row in () if text is None else rows(Page(text)):
                    at.append(i)
                    out.append(row)
                if len(out) >= ROWS_AT_ONCE:
                    yield made(b, at, out)
                    at, out = [], []
            yield made(b, at, out)

    return df.select(*keep, html).mapInArrow(run, schema)


def inventory(df: DataFrame, html: str = "html", top: int = TOP_CLASSES) -> DataFrame:
    """What a page consists of, to choose from: rows (kind, name, n, tags, sample) of kind ``title`` (its text in ``sample``),
    ``tag`` and ``class``. The most frequent come first, at most ``top`` classes and 80 tags a page; ``place`` counts from 1
    within a kind; ``tags`` are the elements with the class, and ``sample`` is the first text of one of them."""
    fields = T.StructType().add("kind", "string").add("place", "long").add("name", "string").add("n", "long").add("tags", "string").add("sample", "string")

    def rows(page: Page) -> Iterator[tuple]:
        yield "title", 1, "title", 1, "title", page.title()
        for k, (name, n) in enumerate(Counter(page.names).most_common(TOP_TAGS), 1):
            yield "tag", k, name, n, name, None
        count, tags, sample = Counter(), {}, {}
        for i in range(len(page.names)):
            for c in page.classes(i):
                count[c] += 1
                tags.setdefault(c, set()).add(page.names[i])
                if not sample.get(c):
                    sample[c] = page.text(i)[:SAMPLE]
        for k, (name, n) in enumerate(count.most_common(top), 1):
            yield "class", k, name, n, ", ".join(sorted(tags[name])), sample[name]

    return page_rows(df, html, fields, rows)


def chosen(df: DataFrame, test: Test, mode: str, html: str, limit: int, root: str | None) -> DataFrame:
    modes = {"text": (), "links": ("href", "src"), "html": ("html",)}
    if mode not in modes:
        raise ValueError(f"mode is one of {', '.join(modes)}")
    fields = T.StructType().add("place", "long").add("tag", "string").add("text", "string")
    for name in modes[mode]:
        fields = fields.add(name, "string")

    def target(page: Page, i: int, attribute: str, tag: str) -> str:
        """An element's own attribute, or that of the first such tag in it that has one."""
        inside = (k for k in range(*page.held[i]) if page.names[k] == tag and attribute in page.attributes[k])
        return page.attributes[i].get(attribute, "") or next((page.attributes[k][attribute] for k in inside), "")

    def rows(page: Page) -> Iterator[tuple]:
        found = 0
        for i in range(len(page.names)):
            if test(page, i):
                found += 1
                more = {"text": lambda: (), "links": lambda i=i: (target(page, i, "href", "a"), target(page, i, "src", "img")), "html": lambda i=i: (page.inner_html(i),)}[mode]()
                yield found, page.names[i], page.text(i), *more
                if found == limit:
                    return

    out = page_rows(df, html, fields, rows)
    return out.withColumn("href", absolute_url(F.col("href"), root)) if mode == "links" and root else out


def select(df: DataFrame, css: str, mode: str = "text", html: str = "html", limit: int = LIMIT, root: str | None = None) -> DataFrame:
    """Rows (place, tag, text) of the elements that a CSS selector matches, in document order, ``limit`` a page at most; with
    mode ``links`` also href and src (the element's own, or the first in it; ``root`` makes hrefs absolute), with ``html``
    the inner HTML."""
    return chosen(df, selector(css), mode, html, limit, root)


def select_classes(df: DataFrame, classes: Sequence[str], mode: str = "text", html: str = "html", limit: int = LIMIT, root: str | None = None) -> DataFrame:
    """As :func:`select`, of the elements with any of some classes, whatever characters their names hold."""
    want = frozenset(classes)
    return chosen(df, lambda page, i: not want.isdisjoint(page.classes(i)), mode, html, limit, root)
