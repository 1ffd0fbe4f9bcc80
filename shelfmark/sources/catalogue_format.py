"""Catalogues as a data source: ``spark.read.format("catalogue").load(folder)``.

XML and text catalogues, plain or in zip archives, come as rows alike, a partition for each file or for several small ones. A file's
form is told by its first bytes. Name, version and description of its header stand in every row, and ``ord`` counts its rows
in file order. Files are read through Arrow's file systems (local, hdfs, s3, gcs), as a stream where they are XML.

Options: ``sets``: ``auto`` (text catalogues name each row's set by its name without extension), ``name`` (all do), ``game`` (a
game is a set) or ``none``; ``glob``: the names that are read (all).
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .catalogs import _block, _tokens

COLUMNS = ["file", "dat", "version", "description", "ord", "name", "size", "crc", "md5", "sha1", "game", "set_name", "category"]
SCHEMA = ", ".join(f"{c} {'long' if c in ('ord', 'size') else 'string'}" for c in COLUMNS)
ARROW = pa.schema([(c, pa.int64() if c in ("ord", "size") else pa.string()) for c in COLUMNS])
HEAD, BATCH = 4096, 20_000
#: Bytes of files that one partition reads, unless a single file has more.
PART_BYTES = 4 << 20
#: Words a text catalogue begins with; those of its header; lengths of checksums.
TEXT_BEGINS, HEADERS, GAMES = ("clrmamepro", "emulator", "game", "machine"), ("clrmamepro", "emulator"), ("game", "machine")
WIDTHS = {"crc": 8, "md5": 32, "sha1": 40}


@dataclass
class Part(InputPartition):
    """Files, each with a member's name if it is an archive."""

    files: list[tuple[str, str | None]]


def form_of(head: bytes) -> str | None:
    """xml, text, zip or None by a file's first bytes."""
    if head[:2] == b"PK":
        return "zip"
    text = head[:HEAD].decode("utf-8", "replace").lstrip("﻿ \t\r\n")
    if text.startswith("<"):
        return "xml"
    word = re.match(r"\w*", text)[0].lower()
    return "text" if word in TEXT_BEGINS else None


def _open(uri: str):
    store, path = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
    return store, path


def _stem(name: str) -> str:
    return re.sub(r"\.[A-Za-z0-9]{1,5}$", "", name)


def _name_of_file(uri: str) -> str:
    name = uri.rpartition("/")[2]
    return re.sub(r"\.dat$", "", name, flags=re.I).partition(" (TOSEC-v")[0].strip()


def _digest(value: str | None, width: int) -> str:
    text = (value or "").strip().lower().removeprefix("0x")
    return text and text.zfill(width)


def _size(value: str | None) -> int:
    try:
        return int(value or 0)
    except ValueError:
        return 0


def _xml(stream, file: str) -> Iterator[tuple[dict, list]]:
    """The header as known so far, and (game, category, rom attributes) of each rom; done elements are let go."""
    header, root, inside = {}, None, False
    for event, element in ElementTree.iterparse(stream, ("start", "end")):
        if event == "start":
            root = element if root is None else root
            inside = inside or element.tag == "header"
        elif element.tag == "header":
            header, inside = {x.tag: (x.text or "").strip() for x in element}, False
            root.clear()
        elif element.tag in GAMES and not inside:
            category = (element.findtext("category") or "").strip()
            yield header, [(element.get("name", ""), category, rom.attrib) for rom in element.iter("rom")]
            root.clear()
    yield header, []


def _text(stream, file: str) -> Iterator[tuple[dict, list]]:
    content = stream.read()
    try:
        text = content.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = content.decode("cp1252", "replace")
    tokens, header = _tokens(text), {}
    for _, word in tokens:
        if next(tokens, ("", ""))[0] != "(":
            raise ValueError(f"{file}: a block is expected after {word}")
        block = _block(tokens)
        first = dict(reversed([(k, v) for k, v in block if isinstance(v, str)]))
        if word in HEADERS:
            header = first
        elif word in GAMES:
            roms = [dict(reversed(v)) for k, v in block if k == "rom" and isinstance(v, list)]
            yield header, [(first.get("name", ""), "", rom) for rom in roms]
    yield header, []


class CatalogueReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.sets, self.glob = options.get("path", ""), options.get("sets", "auto"), options.get("glob", "*")

    def partitions(self) -> list[InputPartition]:
        store, path = _open(self.path)
        info = store.get_file_info(path)
        files = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
        prefix = self.path[: len(self.path) - len(path)] if self.path.endswith(path) else ""
        parts, held = [Part([])], 0

        def add(uri: str, member: str | None, size: int) -> None:
            nonlocal held
            if parts[-1].files and held + size > PART_BYTES:
                parts.append(Part([]))
                held = 0
            parts[-1].files.append((uri, member))
            held += size

        for f in sorted(files, key=lambda f: f.path):
            name = f.path.rpartition("/")[2]
            if f.type != fs.FileType.File or name[:1] in "._" or not fnmatch(name, self.glob):
                continue
            with store.open_input_file(f.path) as file:
                if form_of(file.read(HEAD)) != "zip":
                    add(prefix + f.path, None, f.size)
                    continue
                file.seek(0)
                with zipfile.ZipFile(file) as archive:
                    for x in archive.infolist():
                        if not x.is_dir():
                            add(prefix + f.path, x.filename, x.file_size)
        return parts

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        for uri, member in partition.files:
            store, path = _open(uri)
            with store.open_input_file(path) as file:
                if member is None:
                    yield from self._rows(file, uri, uri)
                else:
                    with zipfile.ZipFile(file) as archive, archive.open(member) as inside:
                        yield from self._rows(inside, f"{uri}::{member}", member)

    def _rows(self, file, label: str, name: str) -> Iterator[pa.RecordBatch]:
        stream = io.BufferedReader(file, HEAD) if not isinstance(file, io.BufferedReader) else file
        form = form_of(stream.peek(HEAD)[:HEAD])
        if form not in ("xml", "text"):
            raise ValueError(f"{label}: no catalogue")
        sets = {"auto": "name" if form == "text" else "none"}.get(self.sets, self.sets)
        rows, n = [], 0
        for header, roms in (_xml if form == "xml" else _text)(stream, label):
            dat = header.get("name") or _name_of_file(name)
            for game, category, rom in roms:
                own = rom.get("name") or ""
                set_name = _stem(own) if sets == "name" else game if sets == "game" else None
                rows.append((label, dat, header.get("version", ""), header.get("description", ""), n, own, _size(rom.get("size")), *[_digest(rom.get(k), w) for k, w in WIDTHS.items()], game, set_name, category))
                n += 1
            if len(rows) >= BATCH:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


class CatalogueSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "catalogue"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return CatalogueReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CatalogueSource)
