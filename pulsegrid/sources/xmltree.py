"""XML as a plain tree, for untrusted files: documents with a DTD or entities are refused before any parser sees them."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pulsegrid.sources.schema import CorruptFile


def parse(data: bytes) -> ET.Element:
    """The root element, without name spaces in tags and attributes."""
    head = data if b"\0" not in data[:64] else data.replace(b"\0", b"")
    if re.search(rb"<!\s*(?:DOCTYPE|ENTITY)", head, re.IGNORECASE):
        raise CorruptFile("a document type or entity declaration is not accepted")
    try:
        root = ET.fromstring(data)
    except (ET.ParseError, ValueError, LookupError) as e:
        raise CorruptFile(f"XML: {e}") from e
    for node in root.iter():
        node.tag = node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""
        node.attrib = {k.rpartition("}")[2]: v for k, v in node.attrib.items()}
    return root


def find_all(node: ET.Element | None, *tags: str) -> Iterator[ET.Element]:
    """Descendants with one of the tags, whatever their case; what lies inside a match is not searched."""
    wanted = {t.lower() for t in tags}
    todo = list(reversed(node)) if node is not None else []
    while todo:
        child = todo.pop()
        if child.tag.lower() in wanted:
            yield child
        else:
            todo.extend(reversed(child))


def find(node: ET.Element | None, *tags: str) -> ET.Element | None:
    """The first match of the first tag that has one."""
    return next((m for t in tags for m in find_all(node, t)), None)


def text(node: ET.Element | None, *tags: str) -> str:
    """Text of the first of the tags that has any; without tags, the node's own."""
    if node is None:
        return ""
    if not tags:
        return (node.text or "").strip()
    for t in tags:
        if (m := find(node, t)) is not None and (s := (m.text or "").strip()):
            return s
    return ""


def path(node: ET.Element | None, *steps: str) -> ET.Element | None:
    """Children by name, step by step; the first of each name."""
    for s in steps:
        node = None if node is None else next((c for c in node if c.tag == s), None)
    return node


def attr(node: ET.Element | None, *names: str) -> str:
    """The first of the attributes that is there, whatever its case."""
    if node is not None:
        low = {k.lower(): v for k, v in node.attrib.items()}
        for n in names:
            if low.get(n.lower()):
                return low[n.lower()]
    return ""
