"""Readers by byte ranges of what Spark's own readers cannot split or leave out: JSON arrays, and files of any size, empty ones too.

Files are listed once and opened by tasks through Arrow's file systems (local, HDFS, object stores). A JSON array is
read element by element: a large file is cut into byte ranges, a pass sums up what each range does to the place in the
syntax (inside a text or not, depth, elements begun), the sums are added up along the file, and each range is then read
from a known place. Nothing holds a whole file, and an element is held once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: Bytes of a JSON array that a task reads at once; larger files are read in several ranges.
RANGE = 16 << 20
#: Bytes read on at a time for an element that reaches over the end of its range.
MORE = 1 << 16
#: Elements of a batch.
ROWS = 4096
QUOTE, BACKSLASH, COMMA, OPEN, CLOSE = 0x22, 0x5C, 0x2C, b"[{", b"]}"
STEP = np.zeros(256, np.int8)
STEP[list(OPEN)], STEP[list(CLOSE)] = 1, -1
MATTERS = STEP != 0
MATTERS[COMMA] = True


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def listed(folder: str, suffix: str = "") -> list[tuple[str, int]]:
    """Path within its file system and size of the files in a folder, or of the one file; hidden ones are left out."""
    files, inside = opened(folder)
    info = files.get_file_info(inside)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(folder)
    found = [info] if info.is_file else files.get_file_info(pafs.FileSelector(inside))
    return sorted((f.path, f.size or 0) for f in found if f.is_file and f.base_name.endswith(suffix) and f.base_name[0] not in "._")


@dataclass(frozen=True)
class Place:
    """Where in the syntax a byte stands: inside a text, how deep, and how many elements have begun before it."""

    inside: bool = False
    depth: int = 0
    begun: int = 0


@dataclass(frozen=True)
class Marks:
    """Brackets and commas outside of texts: where, which, and how deep it is after each; and the place after all bytes."""

    at: np.ndarray
    kind: np.ndarray
    depth: np.ndarray
    inside: bool

    @property
    def begins(self) -> np.ndarray:
        """Marks after which an element begins: the bracket that opens the array, and commas right inside it."""
        return ((self.kind == COMMA) & (self.depth == 1)) | ((self.kind == OPEN[0]) & (self.depth == 1))


def marks(data: np.ndarray, place: Place, escaped: bool) -> Marks:
    """escaped: the byte before is a backslash that takes the first byte with it."""
    quotes = np.flatnonzero(data == QUOTE)
    slashes = np.flatnonzero(data == BACKSLASH)
    if len(slashes) or escaped:
        first = np.append(True, np.diff(slashes) > 1)[: len(slashes)]
        starts = slashes[first]  # of runs of backslashes
        run = np.searchsorted(starts, quotes, "left") - 1
        before = np.searchsorted(slashes, quotes, "left")
        touching = (before > 0) & (slashes[np.maximum(before - 1, 0)] == quotes - 1) if len(slashes) else np.zeros(len(quotes), bool)
        length = np.where(touching, quotes - starts[np.maximum(run, 0)], 0) if len(starts) else np.zeros(len(quotes), np.int64)
        if escaped:
            reaches = (quotes - length) == 0
            length = length + reaches
        quotes = quotes[length % 2 == 0]
    at = np.flatnonzero(MATTERS[data])
    at = at[(np.searchsorted(quotes, at) + place.inside) % 2 == 0]
    kind = data[at]
    return Marks(at, kind, place.depth + np.cumsum(STEP[kind], dtype=np.int64), (len(quotes) + place.inside) % 2 == 1)


@dataclass(frozen=True)
class Effect:
    """What a range does to a place outside and to one inside a text: changes of depth, and elements begun by depth."""

    odd: bool  # texts begun and not ended, or the other way
    change: tuple[int, int]
    begun: tuple[dict[int, int], dict[int, int]]  # depth before, of which marks of that kind begin elements -> how many

    @classmethod
    def of(cls, data: np.ndarray, escaped: bool) -> Effect:
        change, begun, odd = [], [], False
        for inside in (False, True):
            m = marks(data, Place(inside), escaped)
            change.append(int(m.depth[-1]) if len(m.depth) else 0)
            counts: dict[int, int] = {}
            for some in (m.kind == COMMA, m.kind == OPEN[0]):
                for depth, n in zip(*np.unique(m.depth[some], return_counts=True), strict=True):
                    counts[1 - int(depth)] = counts.get(1 - int(depth), 0) + int(n)
            begun.append(counts)
            odd = m.inside != inside
        return cls(odd, tuple(change), tuple(begun))

    def on(self, place: Place) -> Place:
        k = int(place.inside)
        return Place(place.inside != self.odd, place.depth + self.change[k], place.begun + self.begun[k].get(place.depth, 0))


def _escaped(file: pa.NativeFile, start: int) -> bool:
    """Whether the byte before start is a backslash that is not itself taken by one before it."""
    n, at = 0, start
    while at:
        low = max(0, at - MORE)
        file.seek(low)
        part = file.read(at - low)
        kept = len(part.rstrip(b"\\"))
        n += len(part) - kept
        if kept:
            break
        at = low
    return n % 2 == 1


def _read(file: pa.NativeFile, start: int, end: int) -> np.ndarray:
    file.seek(start)
    return np.frombuffer(file.read(end - start), np.uint8)


def elements(file: pa.NativeFile, size: int, start: int, end: int, place: Place) -> Iterator[str]:
    """Text of each element that begins in a range of bytes, in order, from the place at the start of the range."""
    data = _read(file, start, end)
    m, text = marks(data, place, _escaped(file, start)), data.tobytes()
    begins, closes = np.flatnonzero(m.begins), (m.kind == CLOSE[0]) & (m.depth == 0)
    arrays, after = (m.kind[begins] == OPEN[0]).sum(), text[int(m.at[closes][0]) + 1 :] if closes.any() else b""
    outside = text.lstrip()[:1] != b"[" if not start else not place.depth and text.strip() != b""
    if outside or arrays > (not start) or after.strip() or end == size and (m.inside or (m.depth[-1] if len(m.depth) else place.depth)):
        raise ValueError("not an array of records")
    stops = np.flatnonzero(m.begins | closes)
    for i in begins.tolist():
        begin, k = int(m.at[i]) + 1, int(np.searchsorted(stops, i, "right"))
        if k < len(stops):
            raw, last = text[begin : int(m.at[stops[k]])].strip(), m.kind[stops[k]]
        else:
            raw, last = _rest(file, size, end, Place(m.inside, int(m.depth[-1])), text[begin:])
        if raw or m.kind[i] == COMMA or last == COMMA:  # blanks within [] are no element
            yield raw.decode()


def _rest(file: pa.NativeFile, size: int, low: int, place: Place, begun: bytes) -> tuple[bytes, int]:
    """An element that reaches over the end of its range, and the mark after it."""
    parts = [begun]
    while low < size:
        data = _read(file, low, min(size, low + MORE))
        m = marks(data, place, _escaped(file, low))
        stops = np.flatnonzero(m.begins | (m.depth == 0))
        if len(stops):
            parts.append(data.tobytes()[: int(m.at[stops[0]])])
            return b"".join(parts).strip(), int(m.kind[stops[0]])
        parts.append(data.tobytes())
        place, low = Place(m.inside, int(m.depth[-1]) if len(m.depth) else place.depth), low + len(data)
    raise ValueError("not an array of records")


def _ranges(files: list[tuple[str, int]]) -> list[tuple[str, int, int, int]]:
    return [(path, size, start, min(size, start + RANGE)) for path, size in files for start in range(0, max(size, 1), RANGE)]


def _spread(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A row for each range, dealt over tasks; there is one for each RANGE bytes at most and one for each file."""
    return spark.createDataFrame(rows, schema).repartition(max(1, min(len(rows), 4 * spark.sparkContext.defaultParallelism + sum(r[3] - r[2] for r in rows) // RANGE)))


def _places(spark: SparkSession, folder: str, ranges: list[tuple[str, int, int, int]]) -> dict[tuple[str, int], Place]:
    """The place at the start of each range of files of several; sums of ranges, a few numbers each, are added up in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = opened(folder)
        for batch in batches:
            out = []
            for path, _, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with files.open_input_file(path) as file:
                    e = Effect.of(_read(file, start, end), _escaped(file, start))
                out.append((path, start, e.odd, list(e.change), [list(map(list, x.items())) for x in e.begun]))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.string(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "start", "odd", "change", "begun"])

    found = _spread(spark, ranges, "path string, size long, start long, end long").mapInArrow(run, "path string, start long, odd boolean, change array<long>, begun array<array<array<long>>>")
    out, place, last = {}, Place(), None
    for r in sorted(found.collect(), key=lambda r: (r.path, r.start)):
        if r.path != last:
            _ended(last, place)
            place, last = Place(), r.path
        out[r.path, r.start] = place
        place = Effect(r.odd, tuple(r.change), tuple({k: v for k, v in x} for x in r.begun)).on(place)
    _ended(last, place)
    return out


def _ended(path: str | None, place: Place) -> None:
    if path and (place.inside or place.depth):
        raise ValueError(f"not a whole array of records: {path}")


def _begun_and_ended(spark: SparkSession, folder: str, found: list[tuple[str, int]]) -> None:
    """An error that names files that do not begin and end with the brackets of an array: a look at both ends of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = opened(folder)
        for batch in batches:
            bad = []
            for path, size in zip(*(c.to_pylist() for c in batch.columns[:2]), strict=True):
                with files.open_input_file(path) as file:
                    first, last = (_read(file, *ends).tobytes() for ends in ((0, min(size, MORE)), (max(0, size - MORE), size)))
                if first.lstrip()[:1] != b"[" or last.rstrip()[-1:] != b"]":
                    bad.append(path)
            yield pa.RecordBatch.from_arrays([pa.array(bad, pa.string())], ["path"])

    rows = [(path, size, 0, min(size, 2 * MORE)) for path, size in found]
    if bad := _spread(spark, rows, "path string, size long, start long, end long").mapInArrow(run, "path string").limit(3).collect() if rows else []:
        raise ValueError(f"no array of records: {', '.join(r.path for r in bad)}")


def json_arrays(spark: SparkSession, folder: str) -> DataFrame:
    """file, ordinal, raw: the elements of JSON arrays, one array for each file of a folder (or one file).

    ordinal: the number of the element in its array, from 0. raw: its text. A file that does not begin and end as
    an array is an error at once, and so is one of several ranges whose brackets do not match; of smaller ones that is
    found when they are read. Elements need not be objects, nor valid within their brackets.
    Files of no bytes have no elements.
    """
    found = [(path, size) for path, size in listed(folder) if size]  # as writers leave for empty partitions
    _begun_and_ended(spark, folder, found)
    ranges = _ranges(found)
    many = [r for r in ranges if r[1] > RANGE]
    places = _places(spark, folder, many) if many else {}
    rows = [(*r, p.inside, p.depth, p.begun) for r in ranges for p in [places.get((r[0], r[2]), Place())]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = opened(folder)
        for batch in batches:
            for path, size, start, end, inside, depth, begun in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name, out = path.rpartition("/")[2], []
                with files.open_input_file(path) as file:
                    for k, raw in enumerate(elements(file, size, start, end, Place(inside, depth, begun))):
                        out.append((name, begun + k, raw))
                        if len(out) == ROWS:
                            yield _batch(out)
                            out = []
                yield _batch(out)

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string()), strict=True)], ["file", "ordinal", "raw"])

    if not rows:
        return spark.createDataFrame([], "file string, ordinal long, raw string")
    return _spread(spark, rows, "path string, size long, start long, end long, inside boolean, depth long, begun long").mapInArrow(run, "file string, ordinal long, raw string")


def whole_files(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """source, text of every file with the suffix, empty ones too, which Spark's readers leave out; line ends as newlines."""
    rows = [(path, size, 0, size) for path, size in listed(folder, suffix)]
    if not rows:
        raise FileNotFoundError(f"no *{suffix} in {folder}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = opened(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with files.open_input_stream(path) as file:
                    text = file.read().decode().replace("\r\n", "\n").replace("\r", "\n")
                yield pa.RecordBatch.from_arrays([pa.array([path.rpartition("/")[2]]), pa.array([text])], ["source", "text"])

    return _spread(spark, rows, "path string, size long, start long, end long").mapInArrow(run, "source string, text string")
