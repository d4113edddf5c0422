"""Ports as Spark takes them: parsers as data sources, structure processors as table functions.

    spark.dataSource.register(parser_source("notes", parse))
    blocks = spark.read.format("notes").option("suffix", "txt").load("file:///shared/notes")

    spark.udtf.register("to_chunks", structure_function(chunk, "chunk_order int, text string"))
    spark.sql("select * from to_chunks(table(blocks))")
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

#: Columns of a block, as parsers give them.
BLOCK = "page_number int, block_id string, block_type string, text string, reading_order int, level int"


class Files(InputPartition):
    """Files that one task reads: full path and path below the root."""

    def __init__(self, files: list[tuple[str, str]]) -> None:
        super().__init__(None)
        self.files = files


def _dealt(sizes: list[tuple[str, str, int]], most: int) -> list[list[tuple[str, str]]]:
    """Files packed in order up to so many bytes a task; a larger file has a task of its own."""
    out: list[list[tuple[str, str]]] = []
    room = 0
    for path, name, size in sizes:
        if not out or size > room:
            out.append([])
            room = most
        out[-1].append((path, name))
        room -= size
    return out


class _Reader(DataSourceReader):
    def __init__(self, parser: Callable[[bytes], Iterable[tuple]], options: dict[str, str], width: int) -> None:
        self.parser, self.width = parser, width
        self.root, self.suffix = options.get("path"), options.get("suffix", "")
        self.most = int(options.get("bytesPerTask", 128 << 20))
        if not self.root:
            raise ValueError("a parser's source needs a path")

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root if "://" in self.root else self.root.replace("file:", "file://", 1) if self.root.startswith("file:") else "file://" + self.root)

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, root = self._open()
        found = system.get_file_info(fs.FileSelector(root, recursive=True)) if system.get_file_info(root).type == fs.FileType.Directory else [system.get_file_info(root)]
        if any(f.type == fs.FileType.NotFound for f in found):
            raise FileNotFoundError(self.root)
        name = lambda f: f.path[len(root) :].lstrip("/") or f.base_name
        kept = [(f.path, name(f), f.size) for f in found if f.type == fs.FileType.File and f.base_name.lower().endswith(self.suffix.lower()) and not any(p.startswith((".", "_")) for p in name(f).split("/"))]
        # Spark asks for a part even where there is no file
        return [Files(files) for files in _dealt(sorted(kept, key=lambda f: f[1]), self.most) or [[]]]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = self._open()
        for path, name in partition.files:
            try:
                with system.open_input_stream(path) as f:
                    blocks = [tuple(b) for b in self.parser(f.read())]
                if any(len(b) != self.width for b in blocks):
                    raise ValueError(f"the parser's blocks need {self.width} fields")
                told = [(name, *b, None) for b in blocks]
            except Exception as e:  # noqa: BLE001 - a file's failure is a row, and the run goes on
                told = [(name, *(None,) * self.width, f"{type(e).__name__}: {e}")]
            yield from told


def parser_source(name: str, parser: Callable[[bytes], Iterable[tuple]], block_schema: str = BLOCK) -> type[DataSource]:
    """A data source that reads files below a path by a parser, a function from bytes to block tuples.

    Rows: relative_path, the block's columns, error. A file that can't be opened or parsed is one row with its error
    and no block; one without blocks gives none. Hidden files are left out. Options: suffix, bytesPerTask (files are
    packed into tasks up to so many bytes, and a file is never split, as parsers read it whole). Whatever file system
    pyarrow opens will do, if every executor reaches it. An empty folder gives no rows, a missing one is an error.
    """
    width = len(StructType.fromDDL(block_schema))
    label = name

    class ParserSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return label

        def schema(self) -> str:
            return f"relative_path string, {block_schema}, error string"

        def reader(self, schema: StructType) -> DataSourceReader:
            return _Reader(parser, self.options, width)

    return ParserSource


def structure_function(process: Callable[[list[dict]], Iterable[tuple]], produced: str, key: str = "version_id", order: tuple[str, ...] = ("page_number", "reading_order", "block_id")):
    """A table function that gives each document's blocks, in order, to a structure processor.

    `process` takes a document's rows as dicts and gives tuples of `produced`; the document's key is put before them.
    The plan that calls it needs neither PARTITION BY nor ORDER BY, as the function asks for them: it is bound to the
    table it is called with, and a table without the key or a column of the order is an error before anything runs. One
    document is held at a time; rows with a null key are one document; an empty table gives no rows.
    """
    made = StructType.fromDDL(produced)

    class Structure:
        def __init__(self) -> None:
            self.rows: list[dict] = []

        @staticmethod
        def analyze(table: AnalyzeArgument) -> AnalyzeResult:
            if not table.isTable:
                raise ValueError("a structure function takes a table")
            types = {f.name: f.dataType for f in table.dataType.fields}
            lacking = [c for c in (key, *order) if c not in types]
            if lacking:
                raise ValueError(f"the table of blocks lacks {', '.join(lacking)}")
            schema = StructType().add(key, types[key])
            for f in made.fields:
                schema = schema.add(f)
            return AnalyzeResult(schema, partitionBy=[PartitioningColumn(key)], orderBy=[OrderingColumn(c) for c in order])

        def eval(self, row) -> None:
            self.rows.append(row.asDict())

        def terminate(self):
            if self.rows:
                for told in process(self.rows):
                    yield (self.rows[0][key], *told)

    return udtf(Structure)
