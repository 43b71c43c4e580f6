"""EPUB containers made from the ``pages`` table, so that EPUB queries grow with it."""

from __future__ import annotations

import html
import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.batches import batches
from quire.functions.names import format_of
from quire.session import spread

COVER_LINK = '<p><img src="../images/cover.png" alt="Cover"></p>'
SOURCE_CHAPTER = "<html><body><h2>Source</h2><p>{}</p></body></html>"
NAV = ('<html><body><nav><ol><li><a href="text/chap_01.xhtml">Page</a></li>'
       '<li><a href="text/chap_02.xhtml">Source</a></li></ol></nav></body></html>')

_CONTAINER = (
    '<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container">'
    '<rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>')
_PACKAGE = (
    '<package xmlns="http://www.idpf.org/2007/opf" version="3.0">'
    '<metadata xmlns:dc="http://purl.org/dc/elements/1.1/">{title}</metadata>'
    "<manifest>{items}</manifest><spine>{spine}</spine></package>")


def build_epub(
    title: str | None, items: list[tuple[str, str, bytes]], spine: list[int] = ()
) -> bytes:
    """An EPUB of ``(name, media type, body)`` items; the same input gives the same bytes."""
    entries = "".join(
        f'<item id="i{n}" href="{escape(name)}" media-type="{media}"/>'
        for n, (name, media, _) in enumerate(items))
    package = _PACKAGE.format(
        title="" if title is None else f"<dc:title>{escape(title)}</dc:title>",
        items=entries, spine="".join(f'<itemref idref="i{n}"/>' for n in spine))
    files = [("mimetype", b"application/epub+zip"), ("META-INF/container.xml", _CONTAINER.encode()),
             ("OEBPS/content.opf", package.encode())]
    files += [(f"OEBPS/{name}", body) for name, _, body in items]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, body in files:
            archive.writestr(zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0)), body)
    return out.getvalue()


def page_items(url: str, markup: str) -> list[tuple[str, str, bytes]]:
    xhtml, png = "application/xhtml+xml", "image/png"
    picture = b"\x89PNG\r\n\x1a\n" + url.encode()
    return [
        ("nav.xhtml", xhtml, NAV.encode()),
        ("text/chap_01.xhtml", xhtml, (markup + COVER_LINK).encode()),
        ("images/cover.png", png, picture),
        ("text/chap_02.xhtml", xhtml, SOURCE_CHAPTER.format(escape(url)).encode()),
        ("style.css", "text/css", b"p{margin:0}"),
    ]


def epubs_from_pages(pages: DataFrame) -> DataFrame:
    """``(page_id, url, path, content)``: one EPUB per page, named by its id."""
    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("path", pa.string()),
        ("content", pa.binary())])

    def rows(incoming: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in incoming:
            for page_id, url, title, markup in zip(*(c.to_pylist() for c in batch.columns)):
                content = build_epub(html.unescape(title), page_items(url, markup), [0, 1, 3])
                yield {"page_id": page_id, "url": url, "path": f"inbox/{page_id}.epub",
                       "content": content}

    def stage(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches(rows(incoming), schema, size_of=lambda row: len(row["content"]))

    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    source = spread(pages, "page_id").select("page_id", "url", title.alias("title"), "html")
    made = source.mapInArrow(stage, "page_id long, url string, path string, content binary")
    return made.withColumns({
        "format": format_of(F.col("path")), "file_hash": F.sha2("content", 256),
        "length": F.length("content").cast("long")})
