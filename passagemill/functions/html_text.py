"""Annotated HTML to plain text, with the spans of elements that have an id.

One pass of the standard parser writes the raw text and, for each element with an id, the interval of raw text it holds.
Folding then works on the raw text alone: runs of blanks and tabs become one blank, line ends and block tags separate lines, empty
lines go. An id's span is the hull of what is left of its intervals, the folded blanks they touch included.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from html.parser import HTMLParser

#: Tags before and after which a new line begins.
BLOCK_TAGS = frozenset(
    "address article aside blockquote br div footer h1 h2 h3 h4 h5 h6 header li main nav ol p pre section table td th tr ul".split()
)
#: Tags that never hold text, so an id on them marks nothing.
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())

_TOKEN = re.compile(r"[^ \t\r\n]+")


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.raw: list[str] = []
        self.length = 0
        self.open: list[tuple[str, str | None, int]] = []
        self.intervals: list[tuple[str, int, int]] = []

    def write(self, text: str) -> None:
        self.raw.append(text)
        self.length += len(text)

    handle_data = write

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK_TAGS:
            self.write("\n")
        if tag not in VOID_TAGS:
            self.open.append((tag, next((v for n, v in attrs if n == "id" and v), None), self.length))

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCK_TAGS:
            self.write("\n")

    def handle_endtag(self, tag):
        if tag in BLOCK_TAGS:
            self.write("\n")
        if any(t == tag for t, _, _ in self.open):
            while self.shut() != tag:
                pass

    def shut(self) -> str:
        tag, name, start = self.open.pop()
        if name and start < self.length:  # an empty element holds no character
            self.intervals.append((name, start, self.length))
        return tag


def html_to_text(html: str) -> tuple[str, dict[str, tuple[int, int]]]:
    """Text, and (start, end) of each id that still has text, in code points."""
    reader = _Reader()
    reader.feed(html)
    reader.close()
    while reader.open:
        reader.shut()
    raw = "".join(reader.raw)
    begins, ends, places, out, length = [], [], [], [], 0
    for token in _TOKEN.finditer(raw):
        if ends:
            gap = raw[ends[-1] : token.start()]
            out.append("\n" if "\n" in gap or "\r" in gap else " ")
            length += 1
        begins.append(token.start()), ends.append(token.end()), places.append(length)
        out.append(token[0])
        length += len(token[0])
    text = "".join(out)

    def blank_touched(gap: int, start: int, end: int) -> bool:
        """Whether the interval reaches into the gap before token ``gap`` and that gap became a blank."""
        if not 0 < gap < len(begins) or text[places[gap] - 1] != " ":
            return False
        return max(start, ends[gap - 1]) < min(end, begins[gap])

    spans: dict[str, tuple[int, int]] = {}
    for name, start, end in reader.intervals:
        first, last = bisect_right(ends, start), bisect_left(begins, end) - 1  # tokens the interval may touch
        edges = []
        if first <= last:
            edges = [places[first] + max(0, start - begins[first]), places[last] + min(end, ends[last]) - begins[last]]
        for gap in {first, last + 1}:
            if blank_touched(gap, start, end):
                edges += [places[gap] - 1, places[gap]]
        if edges:
            old = spans.get(name, (edges[0], edges[0]))
            spans[name] = (min(old[0], *edges), max(old[1], *edges))
    return text, spans
