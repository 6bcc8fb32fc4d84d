"""XLSX workbooks as a data source: a reader with a partition for each file, and a writer that shows its files only when all are done.

A workbook has one sheet: a line of column names, then a row for each row of the table. All values are text. Columns are locked unless they
are named in the option unlocked; a cell that reads n/a is locked and grey whatever its column; a column in the option choices has
a list to choose from. Null is a missing cell, an empty text an empty one. Characters that XML can't hold are written as
spreadsheets do, as _xHHHH_.

    df.write.format("workbook").option("unlocked", "PC,WD").option("choices", '{"PC": ["yes", "no"]}').mode("append").save(folder)
    spark.read.format("workbook").schema(schema).load(folder)
    spark.read.format("workbook").option("cells", "true").load(folder)     file, row, name, value, locked

A task streams its rows into files of at most `rows` rows, so that neither side ever holds a sheet. Files are written under another
name and moved when the job commits; a task that is run again leaves nothing behind but what the commit names.
"""

from __future__ import annotations

import json
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Names of XML spaces and kinds of parts that make up a workbook.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
PARTS = {
    "[Content_Types].xml": f'{HEAD}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    f'<Override PartName="/xl/workbook.xml" ContentType="{KIND}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{KIND}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{KIND}.styles+xml"/></Types>',
    "_rels/.rels": f'{HEAD}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{LINKS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'{HEAD}<workbook xmlns="{MAIN}" xmlns:r="{LINKS}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": f'{HEAD}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{LINKS}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{LINKS}/styles" Target="styles.xml"/></Relationships>',
    # Styles by number: locked, unlocked, and grey and locked.
    "xl/styles.xml": f'{HEAD}<styleSheet xmlns="{MAIN}"><fonts count="1"><font/></fonts><fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FFD0D0D0"/></patternFill></fill></fills>'
    '<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf/><xf applyProtection="1"><protection locked="0"/></xf><xf fillId="2" applyFill="1"/></cellXfs></styleSheet>',
}
LOCKED, OPEN, GREY = 0, 1, 2
NOT_APPLICABLE = "n/a"
CELLS = "file string, row int, name string, value string, locked boolean"
_ODD = re.compile(r"[\x00-\x08\x0B\x0C\x0E-\x1F￾￿\r]|_x(?=[0-9A-Fa-f]{4}_)")
_ESCAPED = re.compile(r"_x([0-9A-Fa-f]{4})_")


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else Path(uri).absolute().as_uri())


def _column(n: int) -> str:
    """A, B, ..., Z, AA, ... for 0, 1, ..."""
    out = ""
    while n >= 0:
        out, n = chr(65 + n % 26) + out, n // 26 - 1
    return out


def _number(reference: str) -> int:
    n = 0
    for c in reference:
        if c.isalpha():
            n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _text(value: str) -> str:
    return escape(_ODD.sub(lambda m: "_x005F_x" if m[0] == "_x" else f"_x{ord(m[0]):04X}_", value))


def _cell(value: str | None, column: int, row: int, style: int) -> str:
    at = f'{_column(column)}{row}'
    if value is None:
        return f'<c r="{at}" s="{style}"/>' if style == OPEN else ""
    return f'<c r="{at}" s="{GREY if value == NOT_APPLICABLE else style}" t="inlineStr"><is><t xml:space="preserve">{_text(value)}</t></is></c>'


class Sheet:
    """Writes one workbook row by row to a stream."""

    def __init__(self, out, names: list[str], unlocked: set[str], choices: dict[str, list[str]]):
        self.zip = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
        for name, text in PARTS.items():
            self.zip.writestr(name, text)
        self.names, self.choices, self.rows = names, choices, 1
        self.styles = [OPEN if n in unlocked else LOCKED for n in names]
        self.sheet = self.zip.open("xl/worksheets/sheet1.xml", "w", force_zip64=True)
        self._put(f'{HEAD}<worksheet xmlns="{MAIN}"><sheetData>')
        self._row(names, [LOCKED] * len(names))

    def _put(self, text: str) -> None:
        self.sheet.write(text.encode())

    def _row(self, values, styles) -> None:
        self._put(f'<row r="{self.rows}">' + "".join(_cell(v, i, self.rows, s) for i, (v, s) in enumerate(zip(values, styles, strict=True))) + "</row>")

    def add(self, values) -> None:
        self.rows += 1
        self._row(values, self.styles)

    def close(self) -> None:
        self._put('</sheetData><sheetProtection sheet="1"/>')
        lists = [(i, self.choices[n]) for i, n in enumerate(self.names) if n in self.choices]
        if lists and self.rows > 1:
            self._put(f'<dataValidations count="{len(lists)}">')
            for i, given in lists:
                quoted = '"' + ",".join(given) + '"'
                self._put(f'<dataValidation type="list" allowBlank="1" sqref="{_column(i)}2:{_column(i)}{self.rows}"><formula1>{escape(quoted)}</formula1></dataValidation>')
            self._put("</dataValidations>")
        self._put("</worksheet>")
        self.sheet.close()
        self.zip.close()


def _said(element) -> str:
    """The text of a string, which may be in runs."""
    text = "".join(t.text or "" for t in element.iter(f"{{{MAIN}}}t"))
    return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), text)


def cells(file) -> Iterator[tuple[int, int, str, bool]]:
    """(row, column, value, locked) of a workbook's first sheet, rows from 1, columns from 0."""
    with zipfile.ZipFile(file) as z:
        shared, locked = [], [True]
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as f:
                shared = [_said(e) for e in ElementTree.parse(f).getroot().iter(f"{{{MAIN}}}si")]
        if "xl/styles.xml" in z.namelist():
            with z.open("xl/styles.xml") as f:
                held = ElementTree.parse(f).getroot().find(f"{{{MAIN}}}cellXfs")
                marks = [x.find(f"{{{MAIN}}}protection") for x in held] if held is not None else []
                locked = [m is None or m.get("locked", "1") not in ("0", "false") for m in marks] or locked
        name = min((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)), key=lambda n: (len(n), n))
        with z.open(name) as f:
            number = 0
            for _, e in ElementTree.iterparse(f):
                if e.tag != f"{{{MAIN}}}row":
                    continue
                number, column = int(e.get("r", number + 1)), -1
                for c in e.iter(f"{{{MAIN}}}c"):
                    column = _number(c.get("r")) if c.get("r") else column + 1
                    kind, value = c.get("t", "n"), c.find(f"{{{MAIN}}}v")
                    if kind == "inlineStr":
                        text = _said(c)
                    elif value is None or value.text is None:
                        text = None
                    else:
                        text = shared[int(value.text)] if kind == "s" else _ESCAPED.sub(lambda m: chr(int(m[1], 16)), value.text)
                    yield number, column, text, locked[int(c.get("s", 0))]
                e.clear()


def _by_row(file) -> Iterator[tuple[int, dict[int, tuple[str | None, bool]]]]:
    now, held = 0, {}
    for row, column, value, locked in cells(file):
        if row != now and held:
            yield now, held
            held = {}
        now, held[column] = row, (value, locked)
    if held:
        yield now, held


@dataclass
class _File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.path, self.names = options["path"], schema.names
        self.cells = options.get("cells", "false").lower() == "true"

    def partitions(self):
        system, root = _place(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True)) if system.get_file_info(root).type == fs.FileType.Directory else system.get_file_info([root])
        files = [f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".xlsx") and not any(p.startswith((".", "_")) for p in f.path[len(root) :].split("/"))]
        return [_File(f) for f in sorted(files)] or [_File("")]

    def read(self, partition):
        if not partition.path:
            return
        system, _ = _place(self.path)
        with system.open_input_file(partition.path) as f:
            rows = _by_row(f)
            _, head = next(rows, (0, {}))
            at = {v: c for c, (v, _) in head.items()}
            if not self.cells:
                missing = [n for n in self.names if n not in at]
                if missing and head:
                    raise ValueError(f"{partition.path} has no column {missing[0]}")
            for number, row in rows:
                if self.cells:
                    yield from ((partition.path, number, name, *row[c]) for name, c in sorted(at.items(), key=lambda x: x[1]) if c in row)
                else:
                    yield tuple(row.get(at[n], (None, True))[0] for n in self.names)


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        self.path, self.names, self.overwrite = options["path"], schema.names, overwrite
        self.unlocked = set(filter(None, options.get("unlocked", "").split(",")))
        self.choices = json.loads(options.get("choices", "{}"))
        self.rows, self.job = int(options.get("rows", 100_000)), uuid.uuid4().hex
        unknown = (self.unlocked | self.choices.keys()) - set(self.names)
        if unknown:
            raise ValueError(f"no column {min(unknown)}")

    def _hidden(self) -> tuple[fs.FileSystem, str, str]:
        system, root = _place(self.path)
        return system, root, f"{root}/_{self.job}"

    def write(self, iterator):
        system, _, hidden = self._hidden()
        system.create_dir(hidden, recursive=True)
        files, sheet, out = [], None, None
        for row in iterator:
            if sheet is None:
                files.append(f"{uuid.uuid4().hex}.xlsx")
                out = system.open_output_stream(f"{hidden}/{files[-1]}")
                sheet = Sheet(out, self.names, self.unlocked, self.choices)
            sheet.add([None if v is None else str(v) for v in row])
            if sheet.rows > self.rows:
                sheet.close()
                out.close()
                sheet = None
        if sheet is not None:
            sheet.close()
            out.close()
        return _Written(files)

    def commit(self, messages):
        system, root, hidden = self._hidden()
        system.create_dir(root, recursive=True)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(root)):
                if f.type == fs.FileType.File and f.path.endswith(".xlsx"):
                    system.delete_file(f.path)
        for m in messages:
            for name in m.files if m else []:
                system.move(f"{hidden}/{name}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages):
        system, _, hidden = self._hidden()
        if system.get_file_info(hidden).type == fs.FileType.Directory:
            system.delete_dir(hidden)


class Workbook(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        if self.options.get("cells", "false").lower() != "true":
            raise ValueError("name the columns: .schema(...), or read single cells with the option cells")
        return CELLS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(schema, self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Workbook)
