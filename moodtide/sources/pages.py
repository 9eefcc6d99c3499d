"""A cursor-paged source of posts as a Python data source, batch and streaming.

``path`` names a folder, of any file system that Arrow reads, of JSON-lines pages ``page-<cursor>.jsonl`` (the offline form of the API; a
client may be put in its place by subclassing ``read_page``). The cursor is the offset. ``write_pages`` also writes a zone map: for each ``GROUP`` pages a
small file below ``_index`` with the rows, the oldest and the newest time of each page, whose name has those of the group. Readers plan from the names alone:
a group is a partition, and its pages are read by executors, those only that filters leave. In a folder without a zone map the driver looks at each page.

Pages end at the first whose oldest row precedes the option ``cutoff`` (ISO 8601; that page is read as a whole), at ``maxPages`` (100 pages of 100 posts
unless given), or where the next page is missing. A batch read that ends at ``maxPages`` before a page that is there warns. With ``pushFilters`` comparisons of ``created_at`` and ``seq`` with constants
are filtered in the source, and skip groups and pages whose zone excludes them. Load such a DataFrame anew for each query: Spark plans a Python source once for each DataFrame, and a
second query on it would see the filters of the first. ``skipLabels`` (names, comma-separated) drops posts that carry one of them.

The stream admits at most ``maxPages`` a batch, and ends for good at the cutoff, or once it has run for ``budgetSeconds`` and has more than ``budgetRows`` (14 minutes and 1,000 unless given; 0 seconds:
no budget). What it has admitted is kept in the folder ``state`` next to its checkpoint, so that a new start goes on from there.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import time
import uuid
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from moodtide.schemas import MAX_PAGES, PAGE_SIZE

SCHEMA = "uri string, cid string, text string, author string, likes bigint, reposts bigint, replies bigint, created_at string, seq bigint"
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
_TEXTS = ("uri", "cid", "text", "author", "created_at")
_ARROW = pa.schema([(c, pa.string() if c in _TEXTS else pa.int64()) for c in _COLUMNS])
#: Pages of a group, a file of the zone map.
GROUP = 100
BUDGET_SECONDS, BUDGET_ROWS = 14 * 60, 1000
_CANONICAL = re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}Z")
_NAME = re.compile(r"group-(\d+)-(\d+)-(\d+)-(-?\d+)-(-?\d+)-([01])\.json")
_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.UTC)
_MICRO = dt.timedelta(microseconds=1)


def read_page(folder: str, cursor: int) -> list[dict] | None:
    io, path = _opened(folder)
    path = f"{path}/page-{cursor:09d}.jsonl"
    if io.get_file_info(path).type != fs.FileType.File:
        return None
    rows = []
    with io.open_input_stream(path) as f:
        for line in f.read().decode().split("\n"):
            try:
                rows.append(json.loads(line))
            except ValueError:
                continue
    return rows


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri("file://" + folder[5:] if folder.startswith("file:/") and not folder.startswith("file://") else folder)


# -- pages and their zone map ----------------------------------------------------------------------------------------


def _time(text: str | None) -> dt.datetime | None:
    """A point in time, UTC where no zone is given; None where it can't be read."""
    try:
        t = dt.datetime.fromisoformat(text or "")
    except (TypeError, ValueError):
        return None
    return t if t.tzinfo else t.replace(tzinfo=dt.UTC)


@dataclass
class Zone:
    """A page or a group of them: cursors [first, last), rows, times in microseconds, and whether texts of times order as times do."""

    first: int
    last: int
    rows: int
    low: int
    high: int
    ordered: bool


def _zone(cursor: int, rows: list[dict]) -> Zone:
    texts = [r.get("created_at") for r in rows]
    times = [(t - _EPOCH) // _MICRO for x in texts if (t := _time(x)) is not None]
    return Zone(cursor, cursor + PAGE_SIZE, len(rows), min(times, default=0), max(times, default=-1), all(_CANONICAL.fullmatch(x or "") for x in texts))


def _united(zones: list[Zone]) -> Zone:
    timed = [z for z in zones if z.low <= z.high]
    return Zone(zones[0].first, zones[-1].last, sum(z.rows for z in zones), min((z.low for z in timed), default=0), max((z.high for z in timed), default=-1), all(z.ordered for z in zones))


def _put(io: fs.FileSystem, path: str, raw: bytes) -> None:
    """Writes a file under another name and moves it: attempts at one task leave one whole file."""
    with io.open_output_stream(temporary := f"{path}.{uuid.uuid4().hex}") as f:
        f.write(raw)
    io.move(temporary, path)


def write_pages(posts: DataFrame, folder: str) -> int:
    """Writes posts as pages in the order of their column seq, which counts from 0, and the zone map; the number of pages. A column ``labels`` (array of strings) is kept."""
    names = [*_COLUMNS, *(["labels"] if "labels" in posts.columns else [])]

    def pages(batches):
        io, path = _opened(folder)
        page, rows, zones = None, [], []

        def put_page():
            _put(io, f"{path}/page-{page * PAGE_SIZE:09d}.jsonl", "\n".join(json.dumps(r) for r in rows).encode())
            zones.append(_zone(page * PAGE_SIZE, rows))

        def put_group():
            z = _united(zones)
            name = f"group-{zones[0].first // (GROUP * PAGE_SIZE):09d}-{len(zones)}-{z.rows}-{z.low}-{z.high}-{int(z.ordered)}.json"
            _put(io, f"{path}/_index/{name}", json.dumps([vars(x) for x in zones]).encode())
            return pa.record_batch([pa.array([len(zones)], pa.int64())], names=["pages"])

        for b in batches:
            for r in b.to_pylist():
                at = r.pop("page")
                if at != page:
                    if rows:
                        put_page()
                        if at // GROUP != page // GROUP:
                            yield put_group()
                            zones.clear()
                    page, rows = at, []
                rows.append(r)
        if rows:
            put_page()
            yield put_group()

    io, path = _opened(folder)
    io.create_dir(f"{path}/_index", recursive=True)
    paged = posts.select(*names, F.floor(F.col("seq") / PAGE_SIZE).alias("page"))
    dealt = paged.repartition(F.floor(F.col("page") / GROUP)).sortWithinPartitions("page", "seq")
    return dealt.mapInArrow(pages, "pages long").agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]


def zone_map(folder: str) -> list[tuple[str, Zone]] | None:
    """(name, zone) of each group in order, from the names of the files alone; None without a zone map."""
    io, path = _opened(folder)
    if io.get_file_info(f"{path}/_index").type != fs.FileType.Directory:
        return None
    found = []
    for f in io.get_file_info(fs.FileSelector(f"{path}/_index")):
        if m := _NAME.fullmatch(f.base_name):
            group, pages, rows, low, high, ordered = map(int, m.groups())
            first = group * GROUP * PAGE_SIZE
            found.append((f.base_name, Zone(first, first + pages * PAGE_SIZE, rows, low, high, bool(ordered))))
    return sorted(found, key=lambda x: x[1].first)


def _pages_of(folder: str, name: str) -> list[Zone]:
    io, path = _opened(folder)
    with io.open_input_stream(f"{path}/_index/{name}") as f:
        return [Zone(**x) for x in json.loads(f.read())]


# -- filters ---------------------------------------------------------------------------------------------------------

_TESTS = {
    D.EqualTo: lambda v, x: v == x, D.GreaterThan: lambda v, x: v > x, D.GreaterThanOrEqual: lambda v, x: v >= x, D.LessThan: lambda v, x: v < x, D.LessThanOrEqual: lambda v, x: v <= x,
    D.In: lambda v, x: v in x,
}


def _text(micros: int) -> str:
    return (_EPOCH + micros * _MICRO).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


def _may_hold(z: Zone, filters: list) -> bool:
    """Whether rows of a zone may pass all filters."""
    for kind, column, value in filters:
        if column == "created_at" and not z.ordered:
            continue
        low, high = (z.first, z.last - 1) if column == "seq" else (_text(z.low), _text(z.high))
        if z.low > z.high and column == "created_at":
            continue
        values = value if kind is D.In else [value]
        if kind in (D.EqualTo, D.In) and not any(low <= x <= high for x in values):
            return False
        if kind in (D.GreaterThan, D.GreaterThanOrEqual) and not _TESTS[kind](high, value) or kind in (D.LessThan, D.LessThanOrEqual) and not _TESTS[kind](low, value):
            return False
    return True


def _batch(rows: list[dict], filters: list, skip: frozenset) -> pa.RecordBatch:
    columns = {c: [r.get(c) if c in _TEXTS else int(r.get(c) or 0) for r in rows if isinstance(r, dict) and not (skip and skip.intersection(r.get("labels") or ()))] for c in _COLUMNS}
    if filters and columns["seq"]:
        keep = [all(v is not None and _TESTS[k](v, x) for k, v, x in zip([f[0] for f in filters], at, [f[2] for f in filters], strict=True)) for at in zip(*(columns[f[1]] for f in filters), strict=True)]
        columns = {c: [x for x, on in zip(v, keep, strict=True) if on] for c, v in columns.items()}
    return pa.record_batch([pa.array(columns[c], _ARROW.field(c).type) for c in _COLUMNS], schema=_ARROW)


# -- readers ---------------------------------------------------------------------------------------------------------


@dataclass
class Pages(InputPartition):
    """Pages from one cursor up to another, of a group of the zone map if it has one."""

    first: int
    last: int
    group: str | None

    def __init__(self, first: int, last: int, group: str | None):
        super().__init__(first)
        self.first, self.last, self.group = first, last, group


class _Options:
    def __init__(self, options: dict):
        self.folder, self.pages, self.start = options["path"], int(options.get("maxPages", MAX_PAGES)), int(options.get("cursor") or 0)
        self.skip = frozenset(x for x in (options.get("skipLabels") or "").split(",") if x)
        text = options.get("cutoff")
        if text and _time(text) is None:
            raise ValueError(f"cutoff is no ISO 8601 time: {text}")
        self.cutoff = (_time(text) - _EPOCH) // _MICRO if text else None

    def precedes(self, z: Zone) -> bool:
        """Whether the oldest row is before the cutoff."""
        return self.cutoff is not None and z.low <= z.high and z.low < self.cutoff

    def admitted(self, start: int, most: int) -> tuple[list[tuple[str | None, Zone]], bool, bool]:
        """Groups (or pages) of up to ``most`` pages from start, whether the cutoff ends them, and whether ``most`` does."""
        known, out, end = zone_map(self.folder), [], start + most * PAGE_SIZE
        if known is None:
            cursor = start
            while (page := read_page(self.folder, cursor)) is not None:
                if cursor >= end:
                    return out, False, True
                out.append((None, _zone(cursor, page)))
                if self.precedes(out[-1][1]):
                    return out, True, False
                cursor += PAGE_SIZE
            return out, False, False
        at = start
        for name, z in known:
            if z.last <= start:
                continue
            if z.first > at:
                break  # a page is missing
            if at >= end:
                return out, False, True
            last = min(z.last, end)
            out.append((name, Zone(at, last, z.rows, z.low, z.high, z.ordered)))
            if self.precedes(z):
                for page in _pages_of(self.folder, name):  # which of its pages it is
                    if at <= page.first < last and self.precedes(page):
                        out[-1][1].last = page.last
                        return out, True, False
            at = last
            if z.last > end:
                return out, False, True
        return out, False, False

    def rows(self, p: Pages, filters: list = ()) -> Iterator[pa.RecordBatch]:
        pages = [z for z in _pages_of(self.folder, p.group) if p.first <= z.first < p.last] if p.group else [Zone(c, c + PAGE_SIZE, 0, 0, -1, False) for c in range(p.first, p.last, PAGE_SIZE)]
        for z in pages:
            if _may_hold(z, filters):
                yield _batch(read_page(self.folder, z.first) or [], filters, self.skip)


class PagesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.filters = _Options(options), []

    def partitions(self) -> list[InputPartition]:
        o = self.options
        found, _, more = o.admitted(o.start, o.pages)
        if more:
            warnings.warn(f"paged_posts ends at maxPages = {o.pages}; more pages follow", stacklevel=2)
        return [Pages(z.first, z.last, name) for name, z in found if _may_hold(z, self.filters)]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        return self.options.rows(partition, self.filters)


class PushingReader(PagesReader):
    """Takes the comparisons of created_at and seq that the source can do itself; all others stay with Spark."""

    def pushFilters(self, filters: list) -> Iterator:
        self.filters = []
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            values = list(f.value) if isinstance(f, D.In) else [getattr(f, "value", None)]
            if type(f) in _TESTS and name in ("created_at", "seq") and all(isinstance(v, str if name == "created_at" else int) for v in values):
                self.filters.append((type(f), name, values if isinstance(f, D.In) else values[0]))
            else:
                yield f


class PagesStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options, self.state = _Options(options), options.get("state")
        if not self.state:
            raise ValueError("a stream of paged_posts needs the option state, a folder of its own")
        self.budget = float(options.get("budgetSeconds", BUDGET_SECONDS)), int(options.get("budgetRows", BUDGET_ROWS))
        io, path = _opened(self.state)
        self.at = {"cursor": self.options.start, "rows": 0, "done": False, "since": None}
        if io.get_file_info(f"{path}/cursor.json").type == fs.FileType.File:
            with io.open_input_stream(f"{path}/cursor.json") as f:
                self.at = json.loads(f.read())

    def initialOffset(self) -> dict:
        return {"cursor": self.options.start, "rows": 0, "done": False, "since": None}

    def latestOffset(self) -> dict:
        """What is admitted now: pages after the last batch, until the cutoff, the budget or maxPages of them."""
        at, now = dict(self.at), time.time()
        seconds, rows = self.budget
        if seconds and at["since"] is not None and now - at["since"] >= seconds and at["rows"] > rows:
            at["done"] = True
        if at["done"]:
            return at
        found, ended, _ = self.options.admitted(at["cursor"], self.options.pages)
        if found:
            at |= {"cursor": found[-1][1].last, "rows": at["rows"] + sum((z.last - z.first) // PAGE_SIZE * PAGE_SIZE for _, z in found), "done": ended, "since": at["since"] or now}
        return at

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        io, path = _opened(self.state)
        io.create_dir(path, recursive=True)
        _put(io, f"{path}/cursor.json", json.dumps(end).encode())  # a batch that is planned is done, now or when it is tried again
        self.at = dict(end)
        if end["cursor"] <= start["cursor"]:
            return []
        found, _, _ = self.options.admitted(start["cursor"], (end["cursor"] - start["cursor"]) // PAGE_SIZE)
        return [Pages(z.first, min(z.last, end["cursor"]), name) for name, z in found if z.first < end["cursor"]]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        return self.options.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class PagedPosts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_posts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagesReader:
        return (PushingReader if self.options.get("pushFilters", "false").lower() == "true" else PagesReader)(self.options)

    def streamReader(self, schema) -> PagesStream:
        return PagesStream(self.options)


def register(spark) -> None:
    """Makes the format ``paged_posts`` known, and lets Spark hand filters to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedPosts)
