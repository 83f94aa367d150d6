"""A small element tree over html.parser, for pages whose layout is known."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Element:
    """An element with its attributes, parent, and children: elements and strings in page order."""

    __slots__ = ("tag", "attributes", "parent", "children")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Element | None) -> None:
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Element | str] = []

    def __getitem__(self, name: str) -> str:
        return self.attributes.get(name, "")

    @property
    def classes(self) -> list[str]:
        return self["class"].split()

    def walk(self) -> Iterator[Element | str]:
        """All that lies within, in page order."""
        stack = list(reversed(self.children))
        while stack:
            x = stack.pop()
            yield x
            if isinstance(x, Element):
                stack += reversed(x.children)

    def all(self, *tags: str) -> Iterator[Element]:
        return (x for x in self.walk() if isinstance(x, Element) and (not tags or x.tag in tags))

    def lines(self) -> list[str]:
        """Its strings, stripped; empty ones are left out."""
        return [t for x in self.walk() if isinstance(x, str) and (t := x.strip())]

    def text(self, between: str = " ") -> str:
        return between.join(self.lines())

    def ancestors(self) -> Iterator[Element]:
        x = self.parent
        while x is not None:
            yield x
            x = x.parent

    def within(self, *tags: str) -> Element | None:
        """The nearest ancestor with the first of the tags that any has."""
        return next((a for t in tags for a in self.ancestors() if a.tag == t), None)

    def after(self) -> Element | None:
        """The next element of the same parent."""
        if self.parent is None:
            return None
        rest = iter(self.parent.children)
        for x in rest:
            if x is self:
                break
        return next((x for x in rest if isinstance(x, Element)), None)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.here = Element("", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        made = Element(tag, {k: v or "" for k, v in attrs}, self.here)
        self.here.children.append(made)
        if tag not in VOID:
            self.here = made

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.here.children.append(Element(tag, {k: v or "" for k, v in attrs}, self.here))

    def handle_endtag(self, tag: str) -> None:
        # Closes all that is open within; an end without a beginning closes nothing.
        x = self.here
        while x.parent is not None:
            if x.tag == tag:
                self.here = x.parent
                return
            x = x.parent

    def handle_data(self, data: str) -> None:
        own = self.here.children
        if self.here.tag in ("script", "style"):
            return
        if own and isinstance(own[-1], str):
            own[-1] += data  # the parser may hand over one text in parts
        else:
            own.append(data)


def parse(page: str | None) -> Element:
    builder = _Builder()
    builder.feed(page or "")
    builder.close()
    return builder.root
