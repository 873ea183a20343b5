"""Parts of HTML and Markdown documents by structure, with the standard library's parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

# Elements without content, and headings.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_CLOSED_BY = {"p": {"p", "div", "ul", "ol", "table", "section", *HEADINGS}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}


class Element:
    def __init__(self, tag: str, attributes: dict[str, str], parent: Element | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.parts: list[Element | str] = []

    def elements(self) -> Iterator[Element]:
        for part in self.parts:
            if isinstance(part, Element):
                yield part
                yield from part.elements()

    def text(self, leave_out: frozenset[Element] = frozenset()) -> str:
        return "".join(p if isinstance(p, str) else "" if p in leave_out else p.text(leave_out) for p in self.parts)

    def after(self) -> list[Element | str]:
        """What follows in the same parent, text included."""
        own = self.parent.parts
        return own[next(i for i, p in enumerate(own) if p is self) + 1 :]

    def following(self) -> list[Element]:
        return [p for p in self.after() if isinstance(p, Element)]

    def tail(self) -> str:
        """Text between this element and the next one."""
        out = []
        for part in self.after():
            if isinstance(part, Element):
                break
            out.append(part)
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        while self.at.tag in _CLOSED_BY and tag in _CLOSED_BY[self.at.tag]:
            self.at = self.at.parent
        made = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.parts.append(made)
        if tag not in VOID:
            self.at = made

    def handle_startendtag(self, tag, attrs):
        self.at.parts.append(Element(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        found = self.at
        while found is not None and found.tag != tag:
            found = found.parent
        if found is not None and found.parent is not None:
            self.at = found.parent

    def handle_data(self, data):
        self.at.parts.append(data)


def parse(html: str) -> Element:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def tidy(text: str) -> str:
    """No blanks at line ends, one blank line at most in a row, trimmed."""
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x.rstrip() for x in text.split("\n"))).strip()


def _one(root: Element, id_: str, tag: str | None = None) -> Element:
    found = [e for e in root.elements() if e.attributes.get("id") == id_ and tag in (None, e.tag)]
    if len(found) != 1:
        raise ValueError(f"{id_}: {len(found)} matches, expected 1")
    return found[0]


def by_id(root: Element, id_: str) -> str:
    """An element's text; a heading's with all that follows up to a heading of its level or above."""
    element = _one(root, id_)
    out = [element.text() + element.tail()]
    if element.tag in HEADINGS:
        out += under(element)
    return "\n".join(out).strip()


def under(heading: Element) -> list[str]:
    """Texts of the elements after a heading, up to one of its level or above, each with the text that follows it."""
    out = []
    for sibling in heading.following():
        if sibling.tag in HEADINGS and sibling.tag <= heading.tag:
            break
        out.append(sibling.text() + sibling.tail())
    return out


def section(root: Element, id_: str) -> str:
    """A section element's text; with ``!`` after the id, without the sections inside it."""
    element = _one(root, id_.rstrip("!"), "section")
    inner = frozenset(e for e in element.elements() if e.tag == "section") if id_.endswith("!") else frozenset()
    return (element.text(inner) + element.tail()).strip()


def definition(root: Element, id_: str) -> str:
    """Term and definition of a dt element and the dd after it."""
    term = _one(root, id_)
    after = term.following()
    if term.tag != "dt" or not after or after[0].tag != "dd" or not after[0].text().strip():
        raise ValueError(f"{id_}: not a term with a definition after it")
    return term.text().replace("¶", "").strip() + "\n" + after[0].text().strip()


def clause(root: Element, id_: str) -> str:
    """An element's tidied text without the parts whose ids follow its own after commas."""
    own, *out = id_.split(",")
    element = _one(root, own)
    text = tidy(element.text(frozenset(_one(element, x) for x in out)) + element.tail())
    if not text:
        raise ValueError(f"{id_}: nothing is left")
    return text


def anchored(root: Element, id_: str | None = None) -> dict[str, str] | str:
    """Texts from each anchor named section-... to the next; page furniture is left out."""
    furniture = frozenset(e for e in root.elements() if e.attributes.get("class") in ("grey", "invisible", "noprint"))
    found: dict[str, list[str]] = {}
    now = None

    def visit(element: Element) -> None:
        nonlocal now
        for part in element.parts:
            if isinstance(part, str):
                if now is not None:
                    found[now].append(part)
            elif part not in furniture:
                if part.tag == "a" and part.attributes.get("id", "").startswith("section-"):
                    now = part.attributes["id"]
                    if now in found:
                        raise ValueError(f"{now}: the anchor occurs twice")
                    found[now] = []
                visit(part)

    visit(root)
    texts = {k: "".join(v).strip("\n") for k, v in found.items()}
    return texts if id_ is None else texts[id_]


MODES = {"id": by_id, "section": section, "definition": definition, "clause": clause, "anchor": anchored}


def extract(df: DataFrame, key: str, html: str, mode: str, ids: list[str]) -> DataFrame:
    """(key, id, text, error) of each id in each document; an id must match exactly once."""
    take = MODES[mode]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, source in enumerate(batch.column(html).to_pylist()):
                root = parse(source or "")
                for id_ in ids:
                    try:
                        rows.append((i, id_, take(root, id_), None))
                    except (ValueError, KeyError) as error:
                        rows.append((i, id_, None, str(error)))
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(key).take(at), *[pa.array([r[k] for r in rows], pa.string()) for k in (1, 2, 3)]], [key, "id", "text", "error"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, html).mapInArrow(run, f"`{key}` {kind}, id string, text string, error string")


def headings(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, n, level, heading, text): each heading with the text up to the next of its level or above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, source in enumerate(batch.column(html).to_pylist()):
                for n, e in enumerate(e for e in parse(source or "").elements() if e.tag in HEADINGS):
                    rows.append((i, n, int(e.tag[1]), e.text().strip(), tidy("\n".join([e.tail(), *under(e)]))))
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(key).take(at), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.string()), pa.array([r[4] for r in rows], pa.string())], [key, "n", "level", "heading", "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, html).mapInArrow(run, f"`{key}` {kind}, n long, level long, heading string, text string")


def markdown_sections(text: str) -> list[tuple[str, int, int, int, str]]:
    """(heading, level, first line, line after, text) by headings outside fences; a heading must not occur twice."""
    lines, heads, fenced = text.splitlines(), [], False
    for n, line in enumerate(lines):
        if line.startswith("```"):
            fenced ^= line.count("```") < 2  # one that opens and closes on its line changes nothing
        elif line.startswith("#") and not fenced:
            marks = re.match("#+", line)[0]
            heads.append((n, len(marks), line[len(marks) :].strip()))
    names = [h for _, _, h in heads]
    if len(set(names)) < len(names):
        raise ValueError(f"heading {next(h for h in names if names.count(h) > 1)!r} occurs twice")
    out = []
    for i, (n, level, name) in enumerate(heads):
        end = next((m for m, other, _ in heads[i + 1 :] if other <= level), len(lines))
        out.append((name, level, n, end, "\n".join(lines[n:end]).strip()))
    return out


def markdown(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, heading, level, first_line, end_line, body)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *s) for i, t in enumerate(batch.column(text).to_pylist()) for s in markdown_sections(t or "")]
            at = pa.array([r[0] for r in rows], pa.int64())
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(key).take(at), *[pa.array([r[k + 1] for r in rows], t) for k, t in enumerate(kinds)]], [key, "heading", "level", "first_line", "end_line", "body"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, heading string, level long, first_line long, end_line long, body string")
