"""Reading one EPUB container from bytes: its title and its items, in order.

This is the per-row helper of the Python stage.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from urllib.parse import unquote
from xml.etree import ElementTree

# Names defined by the EPUB and Dublin Core standards.
CONTAINER = "META-INF/container.xml"
ROOTFILE = "{urn:oasis:names:tc:opendocument:xmlns:container}rootfile"
OPF = "{http://www.idpf.org/2007/opf}"
TITLE = "{http://purl.org/dc/elements/1.1/}title"
DOCUMENT_TYPE = "application/xhtml+xml"

KINDS = ("document", "image", "other")


def read_epub(
    content: bytes, order: str = "manifest", kinds: tuple[str, ...] = KINDS
) -> tuple[str | None, list[tuple]]:
    """``(title, [(name, kind, body)])`` with kind ``document``, ``image`` or ``other``.

    Names are relative to the package file. ``order`` is ``"manifest"`` or ``"spine"``;
    in spine order the items that the spine does not list come last. Items of other kinds
    than ``kinds`` are left out and not unpacked.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        rootfile = ElementTree.fromstring(archive.read(CONTAINER)).find(f".//{ROOTFILE}")
        if rootfile is None:
            raise ValueError("no package file in container")
        package_path = unquote(rootfile.attrib["full-path"])
        package = ElementTree.fromstring(archive.read(package_path))
        folder = posixpath.dirname(package_path)
        items = []
        for entry in _entries(package, order):
            kind = _kind(entry.attrib.get("media-type", ""))
            if kind not in kinds:
                continue
            name = unquote(entry.attrib["href"])
            body = archive.read(posixpath.normpath(posixpath.join(folder, name)))
            items.append((name, kind, body))
        title = package.find(f".//{TITLE}")
        return (None if title is None else title.text), items


def _entries(package, order: str) -> list:
    entries = package.findall(f"{OPF}manifest/{OPF}item")
    if order == "spine":
        refs = package.findall(f"{OPF}spine/{OPF}itemref")
        place = {ref.attrib["idref"]: i for i, ref in enumerate(refs)}
        entries.sort(key=lambda entry: place.get(entry.attrib.get("id"), len(place)))
    return entries


def _kind(media_type: str) -> str:
    if media_type == DOCUMENT_TYPE:
        return "document"
    return "image" if media_type.startswith("image/") else "other"


def saved_names(names: list[str]) -> list[str]:
    """A file name per image: its base name, with ``_1``, ``_2``… where that is taken."""
    taken: set[str] = set()
    tried: dict[str, int] = {}
    result = []
    for name in names:
        base = posixpath.basename(name)
        stem, ending = posixpath.splitext(base)
        candidate, n = base, tried.get(base, 0)
        while candidate in taken:
            n += 1
            candidate = f"{stem}_{n}{ending}"
        tried[base] = n
        taken.add(candidate)
        result.append(candidate)
    return result
