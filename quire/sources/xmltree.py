"""XML parts as small trees with local names."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator


class _Names(dict):
    """Local names by tag; comments and the like have none."""

    def __missing__(self, tag: object) -> str:
        if len(self) > 4096:
            self.clear()
        self[tag] = name = tag.rpartition("}")[2] if isinstance(tag, str) else ""
        return name


local = _Names().__getitem__


class Node:
    """An element by its local name; attributes by local name (the plain one wins over a prefixed).

    Attributes and children are made when they are asked for, so a large part costs its elements only.
    """

    __slots__ = ("_attrs", "_kids", "el", "name")

    def __init__(self, el: ET.Element) -> None:
        self.el, self.name = el, local(el.tag)
        self._attrs: dict[str, str] | None = None
        self._kids: list[Node] | None = None

    @property
    def attrs(self) -> dict[str, str]:
        if self._attrs is None:
            own = self.el.attrib
            if "}" not in "".join(own):
                self._attrs = own
                return own
            self._attrs = {}
            for k, v in own.items():
                if "}" in k:
                    self._attrs.setdefault(local(k), v)
                else:
                    self._attrs[k] = v
        return self._attrs

    @property
    def kids(self) -> list[Node]:
        if self._kids is None:
            self._kids = [Node(c) for c in self.el]
        return self._kids

    @kids.setter
    def kids(self, kids: list[Node]) -> None:
        self._kids = kids

    def stream(self, *names: str) -> Iterator[Node]:
        """Children by name, one at a time; each is emptied when the next is asked for."""
        for el in self.el:
            if local(el.tag) in names:
                yield Node(el)
                el.clear()

    def get(self, name: str, default: str | None = None) -> str | None:
        return self.attrs.get(name, default)

    def full(self, ends: str) -> str | None:
        """An attribute by the end of its namespaced name, for names that stand twice (r:id, id)."""
        return next((v for k, v in self.el.attrib.items() if k.endswith(ends)), None)

    def child(self, *path: str) -> Node | None:
        at: Node | None = self
        for name in path:
            for c in at.el if at._kids is None else at._kids:
                if (c.name if isinstance(c, Node) else local(c.tag)) == name:
                    at = c if isinstance(c, Node) else Node(c)
                    break
            else:
                return None
        return at

    def children(self, *names: str) -> list[Node]:
        if self._kids is None:
            return [Node(c) for c in self.el if local(c.tag) in names]
        return [c for c in self._kids if c.name in names]

    def walk(self) -> Iterator[Node]:
        for el in self.el.iter():
            yield Node(el)

    def find(self, name: str) -> Node | None:
        return next((Node(el) for el in self.el.iter() if local(el.tag) == name), None)

    def text(self) -> str:
        return "".join(self.el.itertext()) if len(self.el) else self.el.text or ""

    def val(self, name: str, default: str | None = None) -> str | None:
        """The ``val`` attribute of a child."""
        c = self.child(name)
        return default if c is None else c.get("val", default)


def parse(data: bytes) -> Node:
    """The tree of a UTF-8 part; entity declarations are refused."""
    raw = data.removeprefix(b"\xef\xbb\xbf")
    if b"<!ENTITY" in raw[:65536]:
        raise ValueError("entity declarations are not read")
    return Node(ET.fromstring(raw))


def number(text: str | None) -> float | None:
    try:
        return None if text is None else float(text)
    except ValueError:
        return None


def whole(text: str | None, default: int | None = None) -> int | None:
    got = number(text)
    return default if got is None or got != got or abs(got) > 2**53 else int(got)


def on(text: str | None, absent: bool | None = None) -> bool | None:
    """A switch attribute: absent, or anything but 0, false, off, none."""
    return absent if text is None else text.lower() not in ("0", "false", "off", "none")
