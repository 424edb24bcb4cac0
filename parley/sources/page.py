"""An HTML page as one list of events with pre-order intervals; no tree of objects."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class Page(HTMLParser):
    """``events``: (node, text) in document order, text None at a node's start; node i spans events[begin[i]:end[i]]."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tag, self.attrs, self.parent = ["document"], [{}], [-1]
        self.events: list[tuple[int, str | None]] = [(0, None)]
        self.begin, self.end = [0], [0]
        self._open = [0]
        self.feed(html)
        self.close()
        for i in self._open:
            self.end[i] = len(self.events)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        i = len(self.tag)
        self.tag.append(tag.lower())
        self.attrs.append({k.lower(): v or "" for k, v in attrs})
        self.parent.append(self._open[-1])
        self.begin.append(len(self.events))
        self.events.append((i, None))
        self.end.append(len(self.events))
        if self.tag[i] not in VOID:
            self._open.append(i)

    def handle_endtag(self, tag: str) -> None:
        name = tag.lower()
        at = next((k for k in range(len(self._open) - 1, 0, -1) if self.tag[self._open[k]] == name), None)
        if at is not None:
            for i in self._open[at:]:
                self.end[i] = len(self.events)
            del self._open[at:]

    def handle_data(self, data: str) -> None:
        if data:
            self.events.append((self._open[-1], data))

    def nodes(self, top: int = 0) -> Iterator[int]:
        """``top`` and what lies in it, in document order."""
        return (i for i, text in self.events[self.begin[top] : self.end[top]] if text is None)

    def within(self, inner: int, outer: int) -> bool:
        return self.begin[outer] <= self.begin[inner] < self.end[outer]

    def text(self, top: int, separator: str = " ") -> str:
        """Stripped pieces of text; a line break counts as one."""
        parts = []
        for i, text in self.events[self.begin[top] : self.end[top]]:
            if text is None:
                if self.tag[i] == "br":
                    parts.append("\n")
            elif piece := text.strip():
                parts.append(piece)
        return separator.join(parts)
