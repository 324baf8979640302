"""``run_log``: JSONL files tailed by byte offset, as a stream source.

An offset holds, for every file of a folder, how many bytes are done; it always
stands at a line's end, so a line that is still being written waits for the
rest.  A batch reads what lies between two offsets, in ranges of at most ``RANGE`` bytes; a
line belongs to the range in which it begins.  Offsets are kept in the query's
checkpoint, so a restart neither repeats nor loses a line; files that appear
later are read from their start, files that have shrunk or gone are refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pfs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources.network_format import file_system
from .progress import parsed

FORMAT = "run_log"
RANGE, BLOCK = 8 << 20, 1 << 16
LINES = "file string, at long, value string"


def whole_lines(fs: pfs.FileSystem, path: str, begin: int, size: int) -> int:
    """Where the last whole line between two places ends; ``begin`` if there is none."""
    with fs.open_input_file(path) as f:
        end = size
        while end > begin:
            start = max(begin, end - BLOCK)
            found = f.read_at(end - start, start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            end = start
    return begin


@dataclass
class Range(InputPartition):
    file: str
    begin: int
    end: int
    #: Where the file's part of the batch begins and ends.
    first: int
    last: int


class LogReader(DataSourceStreamReader):
    def __init__(self, folder: str, suffix: str):
        self.folder, self.suffix = folder, suffix

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        fs, base = file_system(self.folder)
        found = fs.get_file_info(pfs.FileSelector(base, recursive=True, allow_not_found=True))
        files = {x.path[len(base) + 1 :]: x.size for x in found if x.is_file and x.path.endswith(self.suffix) and "/_" not in x.path[len(base) :] and not x.base_name.startswith(".")}
        # Only what has grown since the last look is opened.
        known = getattr(self, "known", {})
        self.known = {f: known[f] if known.get(f, (None,))[0] == n else (n, whole_lines(fs, f"{base}/{f}", known.get(f, (0, 0))[1] if known.get(f, (0, 0))[0] <= n else 0, n)) for f, n in files.items()}
        return {f: end for f, (_, end) in sorted(self.known.items())}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if odd := [f for f, at in start.items() if end.get(f, -1) < at]:
            raise ValueError(f"{self.folder}/{odd[0]} is shorter than what was read of it")
        out = []
        for f, last in end.items():
            first = start.get(f, 0)
            out += [Range(f, at, min(at + RANGE, last), first, last) for at in range(first, last, RANGE)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(self.folder)
        with fs.open_input_file(f"{base}/{partition.file}") as f:
            at = partition.begin
            if at > partition.first:
                # The line around this place belongs to the range before.
                at -= 1
                f.seek(at)
                at += len(_line(f))
            f.seek(at)
            rows: list[tuple[int, str]] = []
            while at < partition.end:
                line = _line(f)
                rows.append((at, line.rstrip(b"\r\n").decode(errors="replace")))
                at += len(line)
                if len(rows) == 8192 or at >= partition.end:
                    yield pa.RecordBatch.from_arrays([pa.array([partition.file] * len(rows)), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows])], ["file", "at", "value"])
                    rows = []

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


def _line(f) -> bytes:
    """The next line, its end included."""
    out = b""
    while not out.endswith(b"\n"):
        place = f.tell()
        block = f.read(BLOCK)
        if not block:
            return out
        cut = block.find(b"\n")
        if cut >= 0:
            block = block[: cut + 1]
            f.seek(place + len(block))
        out += block
    return out


class RunLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> LogReader:
        return LogReader(self.options["path"], self.options.get("suffix", ".jsonl"))


def log_lines(spark: SparkSession, folder: str, suffix: str = ".jsonl") -> DataFrame:
    """A stream of (file, at, value): the whole lines of a folder's logs as they grow."""
    spark.dataSource.register(RunLog)
    return spark.readStream.format(FORMAT).option("suffix", suffix).load(folder)


def tailed(spark: SparkSession, folder: str) -> DataFrame:
    """The log as progress.log_stream has it, by byte offset."""
    return parsed(log_lines(spark, folder))
