"""Small inputs for the tests."""

from catalog.epubs import build_epub

XHTML, PNG = "application/xhtml+xml", "image/png"
PICTURE = b"\x89PNG\r\n\x1a\n" + b"fake" * 100


def book(title="Test Book", spine=(0, 1), extra=()):
    """A section with text and one image, as `(title, items)`."""
    chapter = (b"<html><head><title/></head><body><h1>Chapter 1</h1><p>Hello world.</p>"
               b'<p><img src="../images/cover.png" alt="Cover"/></p></body></html>')
    items = [("text/chap_01.xhtml", XHTML, chapter), ("images/cover.png", PNG, PICTURE), *extra]
    return build_epub(title, items, list(spine))


def text_only():
    return build_epub("Text Only", [("only.xhtml", XHTML, b"<html><body><p>Just text.</p></body></html>")])


def docs(spark, files):
    """`docs(path, length, content, source_filename, format, file_hash)` of `{path: bytes}`."""
    from pyspark.sql import functions as F

    from quire.sources.inbox import with_format

    rows = [(path, len(content), bytearray(content)) for path, content in files.items()]
    frame = spark.createDataFrame(rows, "path string, length long, content binary")
    return with_format(frame).withColumn("file_hash", F.sha2("content", 256))


def values(frame, *columns):
    rows = frame.select(*columns).collect()
    return sorted((tuple(row) for row in rows), key=repr)
