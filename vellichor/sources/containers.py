"""EPUB files and packaged books: one file is one row of binaryFile; archives are opened in the tasks."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellichor.sources import epub as epub_tables

BOOK_TYPE = "application/x-vellichor-book"


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modificationTime, content, sha256)."""
    return spark.read.format("binaryFile").load(path).withColumn("sha256", F.sha2("content", 256))


def format_of(content: Column, path: Column) -> Column:
    """epub, pdf, docx, html or txt by the first bytes, else by the name; null for others."""
    head = F.substring(content, 1, 4)
    text = F.decode(F.substring(content, 1, 4096), "ISO-8859-1")
    zipped = F.hex(F.substring(head, 1, 2)) == "504B"
    name = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return (
        F.when(F.hex(head) == "25504446", "pdf")
        .when(zipped & (F.contains(text, F.lit("application/epub+zip")) | F.contains(text, F.lit("META-INF/container.xml"))), "epub")
        .when(zipped & F.contains(text, F.lit("word/")), "docx").when(zipped, F.lit(None))
        .when(name.isin("html", "htm", "xhtml"), "html").when(name == "txt", "txt")
    )


def epub(books: DataFrame) -> DataFrame:
    """(path, place, href, html, toc_title) of books (path, content): the spine without navigation and pictures."""
    return epub_tables.documents(epub_tables.opened(books)).withColumnRenamed("contents", "toc_title").select("path", "place", "href", "html", "toc_title")


def packed_book(book: str, source: bytes | None = None, source_name: str = "source", handed_over: str | None = None) -> bytes:
    """A packaged book: its type first and stored, then the book as JSON, its source, and the changes since."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as box:
        box.writestr(zipfile.ZipInfo("mimetype"), BOOK_TYPE, zipfile.ZIP_STORED)
        box.writestr("book.json", book, zipfile.ZIP_DEFLATED, 6)
        if source is not None:
            box.writestr(f"source/{source_name}", source, zipfile.ZIP_STORED)
        if handed_over is not None:
            box.writestr("changes.json", handed_over, zipfile.ZIP_STORED)
    return out.getvalue()


def unpacked(books: DataFrame) -> DataFrame:
    """(path, book, changes, error): a damaged change log is null, a damaged book an error."""

    def read(content: bytes) -> tuple[str | None, str | None, str | None]:
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as box:
                book = box.read("book.json").decode()
                json.loads(book)
                changes = box.read("changes.json").decode() if "changes.json" in box.namelist() else None
        except (zipfile.BadZipFile, KeyError, ValueError) as failed:
            return None, None, type(failed).__name__
        try:
            json.loads(changes or "null")
        except ValueError:
            changes = None
        return book, changes, None

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(p, *read(c)) for p, c in zip(batch["path"], batch["content"])], columns=["path", "book", "changes", "error"])

    return books.select("path", "content").mapInPandas(opened, "path string, book string, changes string, error string")


def write_books(books: DataFrame, folder: str) -> DataFrame:
    """Packages of books (name, book) under a folder of shared storage, written in the tasks: (name, sha256). A file appears whole or not at all."""
    import hashlib

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os
        import tempfile

        for batch in batches:
            out = []
            for name, book in zip(batch["name"], batch["book"]):
                content = packed_book(book)
                handle, part = tempfile.mkstemp(dir=folder)
                with os.fdopen(handle, "wb") as f:
                    f.write(content)
                os.replace(part, os.path.join(folder, name))
                out.append((name, hashlib.sha256(content).hexdigest()))
            yield pd.DataFrame(out, columns=["name", "sha256"])

    return books.select("name", "book").mapInPandas(written, "name string, sha256 string")


#: Explicit schema of a persisted book; unknown fields stay in the variant column.
BOOK_SCHEMA = """
schemaVersion int, meta struct<title:string,author:string,language:string,source:struct<fileName:string,format:string,size:long,sha256:string,embedded:boolean>>,
cast array<struct<id:string,name:string,aliases:array<string>,gender:string,color:int,badge:string,kind:string,origin:string>>,
chapters array<struct<id:string,title:string,blocks:array<struct<id:string,type:string,text:string,sentences:array<array<int>>>>>>,
annotations array<struct<id:string,type:string,block:string,start:int,end:int,at:int,speaker:string,origin:string,confidence:double,via:string>>
"""


def parsed(books: DataFrame) -> DataFrame:
    """Adds the typed book and, as a variant, all of it."""
    return books.withColumn("typed", F.from_json("book", BOOK_SCHEMA)).withColumn("extras", F.expr("try_parse_json(book)"))
