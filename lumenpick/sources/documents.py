"""One JSON document from rows, written where the data is.

A Python data source writer: tasks write the records of their partition into part files beside the target,
and the commit strings the parts together between the document's brackets, in the order of partitions,
copying file to file.  The document appears under its name by one rename; an aborted write leaves no parts.
It is meant for documents that one file can hold; reports beyond that stay folders of lines.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .files import place

#: Kinds of sections: one record, a list of records, or records under their keys.
ONE, LIST, KEYED = "one", "list", "keyed"
_BRACKETS = {LIST: ("[", "]"), KEYED: ("{", "}")}


@dataclass
class Written(WriterCommitMessage):
    partition: int
    #: Part files by section.
    parts: dict[str, str]


class DocumentWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.sections: list[list[str]] = json.loads(options["sections"])
        self.beside = f"{self.path}.{options['run']}"

    def write(self, iterator: Iterator) -> Written:
        partition = TaskContext.get().partitionId()
        kinds, handles, parts = dict(self.sections), {}, {}
        os.makedirs(self.beside, exist_ok=True)
        try:
            for section, key, record in iterator:
                if section not in handles:
                    parts[section] = f"{self.beside}/{uuid.uuid4().hex}"
                    handles[section] = open(parts[section], "w", encoding="utf-8")  # noqa: SIM115
                else:
                    handles[section].write(",\n")
                handles[section].write((json.dumps(key, ensure_ascii=False) + ": " if kinds[section] == KEYED else "") + record)
        finally:
            for handle in handles.values():
                handle.close()
        return Written(partition, parts)

    def commit(self, messages: list) -> None:
        written = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
        whole = f"{self.beside}.whole"
        with open(whole, "wb") as out:
            rooted = [s for s in self.sections if s[0]]  # a nameless section is the document itself
            out.write(b"{" if rooted else b"")
            for n, (section, kind) in enumerate(self.sections):
                out.write((",\n" if n else "").encode() + (f"{json.dumps(section)}: " if section else "").encode())
                opening, closing = _BRACKETS.get(kind, ("", ""))
                out.write(opening.encode())
                parts = [m.parts[section] for m in written if section in m.parts]
                for i, part in enumerate(parts):
                    out.write(b",\n" if i else b"")
                    with open(part, "rb") as handle:
                        shutil.copyfileobj(handle, out, 1 << 20)
                out.write(b"null" if kind == ONE and not parts else b"")
                out.write(closing.encode())
            out.write(b"}\n" if rooted else b"\n")
        os.replace(whole, self.path)
        shutil.rmtree(self.beside, ignore_errors=True)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.beside, ignore_errors=True)


class JsonDocument(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_document"

    def schema(self) -> str:
        return "section string, key string, record string"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options)


def write_document(rows: DataFrame, path: str, sections: list[tuple[str, str]], *order) -> str:
    """rows: section, key, record (JSON text) and the columns to order a section by; sections: name and kind, in their order.

    A section named "" makes up the whole document.
    """
    rows.sparkSession.dataSource.register(JsonDocument)
    number = F.coalesce(*[F.when(F.col("section") == name, F.lit(i)) for i, (name, _) in enumerate(sections)])
    placed = rows.withColumn("_no", number).repartitionByRange("_no", *order).sortWithinPartitions("_no", *order)
    target = place(path)[1]
    out = placed.select("section", "key", "record").write.format("json_document").mode("append")
    out.option("sections", json.dumps(sections)).option("run", uuid.uuid4().hex).save(target)
    return target
