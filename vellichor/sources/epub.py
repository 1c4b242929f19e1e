"""EPUB files as tables: metadata, manifest, spine, contents and documents, joined to chapters.

A file is opened once and gives entries, rows of one of KINDS; everything after that is joins. Files come as rows
(path, content) of binaryFile, so from any storage that Spark reads, or through the data source `book_epub`, a partition
a file, which opens paths that the Python workers reach themselves, and reads only the kinds of an option: filters are
not pushed down, since a reader that took the filters of one query would keep them for the next one on the same table.

Names of tags count without their prefix and in small letters, and markup that is not well-formed is read as far as it
goes. Of several titles for one place in the table of contents the first counts, of several items with one id the last.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from vellichor.sources import pages

KINDS = ("metadata", "manifest", "spine", "contents", "document", "error")
ENTRY = "path string, kind string, place long, id string, href string, type string, properties string, name string, value string"
COLUMNS = [x.split()[0] for x in ENTRY.split(", ")]
#: Names of the metadata, and the tags that hold them.
METADATA = {"title": "title", "author": "creator", "language": "language", "publisher": "publisher", "date": "date"}


class Node:
    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs, self.children = name, attrs, []

    def all(self, name: str) -> Iterator[Node]:
        for child in self.children:
            if isinstance(child, Node):
                if child.name == name:
                    yield child
                yield from child.all(name)

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)


class Tree(HTMLParser):
    """Markup as nodes; a tag that is never closed ends with the one around it."""

    def __init__(self, markup: str):
        super().__init__(convert_charrefs=True)
        self.open = [Node("", {})]
        self.feed(markup)
        self.close()

    @property
    def root(self) -> Node:
        return self.open[0]

    def handle_starttag(self, tag, attrs):
        node = Node(tag.rpartition(":")[2], {k.rpartition(":")[2]: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.open.pop()

    def handle_endtag(self, tag):
        name = tag.rpartition(":")[2]
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].name == name:
                del self.open[k:]
                break

    def handle_data(self, data):
        self.open[-1].children.append(data)

    def unknown_decl(self, data):
        if data.startswith("CDATA["):
            self.handle_data(data[6:])


def joined(base: str, href: str) -> str:
    """href as seen from the file `base`, without . and .., fragment and escapes."""
    out: list[str] = []
    for part in [*base.split("/")[:-1], *unquote(href.split("#")[0]).split("/")]:
        if part == "..":
            del out[-1:]
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out)


def _contents(box: zipfile.ZipFile) -> Iterator[tuple[str, str]]:
    """(href, title) of every table of contents in the archive."""
    for name in box.namelist():
        if name.lower().endswith("toc.ncx"):
            for point in Tree(box.read(name).decode("utf-8", "replace")).root.all("navpoint"):
                label = next(point.all("text"), None)
                source = next((c.attrs.get("src") for c in point.children if isinstance(c, Node) and c.name == "content"), None)
                if label is not None and source:
                    yield joined(name, source), label.text().strip()
        elif name.lower().endswith("nav.xhtml"):
            for link in Tree(box.read(name).decode("utf-8", "replace")).root.all("a"):
                if link.attrs.get("href"):
                    yield joined(name, link.attrs["href"]), link.text().strip()


def entries(content: bytes, kinds: tuple[str, ...] = KINDS) -> Iterator[dict]:
    """The entries of one file; a file that is no EPUB gives one of kind error."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as box:
            names = {joined("", n): n for n in reversed(box.namelist())}
            if "META-INF/container.xml" not in names:
                raise ValueError("no container")
            at = next((n.attrs.get("full-path") for n in Tree(box.read(names["META-INF/container.xml"]).decode("utf-8", "replace")).root.all("rootfile")), None)
            if not at or joined("", at) not in names:
                raise ValueError("no package")
            package = Tree(box.read(names[joined("", at)]).decode("utf-8", "replace")).root
            if "metadata" in kinds and (about := next(package.all("metadata"), None)) is not None:
                for name, tag in METADATA.items():
                    if (found := next(about.all(tag), None)) is not None and (value := found.text().strip()):
                        yield {"kind": "metadata", "name": name, "value": value}
            items = [n.attrs for n in package.all("item")]
            if "manifest" in kinds:
                for place, item in enumerate(items, 1):
                    yield {"kind": "manifest", "place": place, "id": item.get("id", ""), "href": joined(at, item.get("href", "")), "type": item.get("media-type", ""), "properties": item.get("properties", "")}
            spine = [n.attrs.get("idref", "") for n in package.all("itemref")]
            if "spine" in kinds:
                for place, idref in enumerate(spine, 1):
                    yield {"kind": "spine", "place": place, "id": idref}
            if "contents" in kinds:
                for place, (href, title) in enumerate(_contents(box), 1):
                    if title:
                        yield {"kind": "contents", "place": place, "href": href, "value": title}
            if "document" in kinds:
                used = set(spine)
                for href in {joined(at, i.get("href", "")): None for i in items if i.get("id", "") in used and "html" in (i.get("media-type") or "html")}:
                    if href in names:
                        yield {"kind": "document", "href": href, "value": box.read(names[href]).decode("utf-8", "replace")}
    except (zipfile.BadZipFile, ValueError, NotImplementedError, RuntimeError, EOFError, OSError, zlib.error) as failed:
        if "error" in kinds:
            yield {"kind": "error", "value": f"{type(failed).__name__}: {failed}"}


def opened(files: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """ENTRY rows of files (path, content), for instance of binaryFile."""
    schema = pa.schema([(c, pa.int64() if c == "place" else pa.string()) for c in COLUMNS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                yield pa.RecordBatch.from_pylist([e | {"path": path} for e in entries(content.as_py() or b"", kinds)], schema)

    return files.select("path", "content").mapInArrow(run, ENTRY)


def metadata(found: DataFrame) -> DataFrame:
    """One row a book: path, title (else the file's name), author, language, publisher, date."""
    rows = found.groupBy("path").agg(*(F.max(F.when((F.col("kind") == "metadata") & (F.col("name") == n), F.col("value"))).alias(n) for n in METADATA), F.bool_and(F.col("kind") == "error").alias("broken"))
    name = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]+$", "")
    return rows.filter("not broken").select("path", F.coalesce("title", name).alias("title"), *[n for n in METADATA if n != "title"])


def documents(found: DataFrame) -> DataFrame:
    """(path, place, href, contents, html) of the spine: place counts all of it, so what is passed over (navigation, pictures, missing files) leaves gaps; contents is the title in the table of contents."""
    kind = lambda k: found.filter(F.col("kind") == k)
    items = kind("manifest").groupBy("path", "id").agg(F.max_by(F.struct("href", "type", "properties"), "place").alias("x")).select("path", "id", "x.*")
    rows = kind("spine").select("path", "place", "id").join(items, ["path", "id"])
    rows = rows.filter(~F.array_contains(F.split("properties", r"\s+"), "nav") & ((F.col("type") == "") | F.contains("type", F.lit("html"))))
    titles = kind("contents").groupBy("path", "href").agg(F.min_by("value", "place").alias("contents"))
    held = kind("document").select("path", "href", F.col("value").alias("html"))
    return rows.join(held, ["path", "href"]).join(titles, ["path", "href"], "left").select("path", "place", "href", "contents", "html")


BLOCKS = "path string, place long, href string, contents string, ix long, type string, text string, marks array<struct<s:long,e:long,kind:string>>"


def blocks(found: DataFrame) -> DataFrame:
    """BLOCKS: every block of every document in the spine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                held = pages.blocks_of(row.pop("html"))
                yield pa.RecordBatch.from_pylist([row | {"ix": i, "type": kind, "text": text, "marks": marks} for i, (kind, text, marks) in enumerate(held)], BLOCK)

    return documents(found).mapInArrow(run, BLOCKS)


BLOCK = pa.schema([("path", pa.string()), ("place", pa.int64()), ("href", pa.string()), ("contents", pa.string()), ("ix", pa.int64()), ("type", pa.string()), ("text", pa.string()), ("marks", pages.MARK)])


def chapters(read: DataFrame) -> DataFrame:
    """(path, place, id, href, title, n_blocks, n_chars) of blocks(): documents without blocks are none. The title is that of the headings among the first three blocks, joined, else of the contents, else the place."""
    heads = F.array_sort(F.collect_list(F.when((F.col("ix") < 3) & F.col("type").isin("h1", "h2"), F.struct("ix", "text"))))
    rows = read.groupBy("path", "place", "href", "contents").agg(F.array_join(F.array_distinct(F.transform(heads, lambda h: h.text)), " – ").alias("heads"), F.count("*").alias("n_blocks"), F.sum(F.length("text")).alias("n_chars"))
    title = F.coalesce(F.when(F.col("heads") != "", F.col("heads")), "contents", F.concat(F.lit("Kapitel "), F.col("place").cast("string")))
    return rows.select("path", "place", F.concat(F.lit("ch"), F.lpad(F.col("place").cast("string"), 3, "0")).alias("id"), "href", title.alias("title"), "n_blocks", "n_chars")


def packed(title: str | None, language: str | None, parts: list[tuple[str | None, str]]) -> bytes:
    """An EPUB of (title in the table of contents or null, body) parts, after a navigation document."""
    from xml.sax.saxutils import escape

    names = [f"text/k{i}.xhtml" for i in range(len(parts))]
    items = "".join(f'<item id="k{i}" href="{n}" media-type="application/xhtml+xml"/>' for i, n in enumerate(names))
    spine = '<itemref idref="nav"/>' + "".join(f'<itemref idref="k{i}"/>' for i in range(len(parts)))
    about = "".join(f"<dc:{tag}>{escape(value)}</dc:{tag}>" for tag, value in (("title", title), ("language", language)) if value is not None)
    links = "".join(f'<li><a href="{n}">{escape(t)}</a></li>' for n, (t, _) in zip(names, parts) if t is not None)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as box:
        box.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip", zipfile.ZIP_STORED)
        box.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OEBPS/book.opf"/></rootfiles></container>')
        box.writestr("OEBPS/book.opf", f'<package><metadata>{about}</metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>{items}</manifest><spine>{spine}</spine></package>')
        box.writestr("OEBPS/nav.xhtml", f"<html><body><nav><ol>{links}</ol></nav></body></html>")
        for name, (_, body) in zip(names, parts):
            box.writestr(f"OEBPS/{name}", f"<html><body>{body}</body></html>")
    return out.getvalue()


class OneFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class EpubReader(DataSourceReader):
    def __init__(self, path: str, kinds: tuple[str, ...]):
        self.path, self.kinds = path, kinds

    def partitions(self):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        info = store.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        paths = sorted(x.path for x in found if x.type == fs.FileType.File and x.path.lower().endswith(".epub"))
        return [OneFile(self.path[: len(self.path) - len(root)] + p) for p in paths]

    def read(self, partition):
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(partition.path) if "://" in partition.path else (fs.LocalFileSystem(), partition.path)
        with store.open_input_file(at) as file:
            content = file.read()
        for entry in entries(content, self.kinds):
            yield tuple((entry | {"path": partition.path}).get(c) for c in COLUMNS)


class EpubSource(DataSource):
    """spark.dataSource.register(EpubSource); spark.read.format("book_epub").load(path): the entries of every .epub file under path; option kinds: those to read, with commas between."""

    @classmethod
    def name(cls):
        return "book_epub"

    def schema(self):
        return ENTRY

    def reader(self, schema):
        return EpubReader(self.options["path"], tuple(self.options.get("kinds", ",".join(KINDS)).split(",")))
