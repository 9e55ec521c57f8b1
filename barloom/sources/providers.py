"""Market data providers as Spark data sources: ``spark.read.format("vendor_bars")`` and ``"vendor_news"``.

A read is planned as one partition for each symbol and slice of dates, so that a long history of many symbols is fetched
by many tasks. ``fetch`` asks for symbols and days; what it doesn't ask for is not requested. (Spark 4.1 would push filters
to the reader too, but keeps what was pushed with the DataFrame: a second use of it, with another filter, would lack
rows. So days and symbols are options.) Payloads come through a transport: HTTP with a token, retries and growing pauses, or files that any
executor can open, ``<location>/symbol=<s>/slice=<year>/*``. A slice that can't be had doesn't fail the job: it is a row of
its own with ``error_kind`` and ``error``, which ``good_rows`` and ``quarantined`` tell apart.

Options: ``transport`` (http or files), ``location``, ``symbols`` (separated by commas), ``start`` and ``end`` (ISO dates,
inclusive), ``slice_years``, ``token``, ``path`` (of the request, with ``{symbol}``), ``retries``, ``pause`` and ``timeout`` (seconds).
"""

from __future__ import annotations

import json
import math
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .bars import OHLCV, PROVIDER_EXTRA, SourceError, _safe_symbol
from .news import NEWS_COLUMNS

ERRORS = "error_kind string, error string"
#: What a vendor's status codes mean.
KINDS = {401: "auth", 403: "auth", 404: "unknown_symbol", 429: "rate_limited"}
PASSING = ("rate_limited", "unavailable")  # worth another attempt


class FetchError(Exception):
    """A slice that couldn't be had, and of what kind the trouble is."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


@dataclass
class Slice(InputPartition):
    """One request: a symbol and days, both ends included."""

    symbol: str
    start: date
    end: date


def slices(symbol: str, start: date, end: date, years: int) -> list[Slice]:
    out, first = [], start
    while first <= end:
        stop = date(first.year - first.year % years + years, 1, 1)
        last = min(end, date.fromordinal(stop.toordinal() - 1))
        out.append(Slice(symbol, first, last))
        first = stop
    return out


class HttpTransport:
    """GET with the token in a header; passing trouble is tried again after growing pauses, not beyond ``retries``."""

    def __init__(self, options: dict[str, str]):
        self.base = options["location"].rstrip("/")
        self.path = options.get("path", "/daily/{symbol}")
        self.token = options.get("token", "")
        self.retries, self.pause = int(options.get("retries", "3")), float(options.get("pause", "1"))
        self.timeout = float(options.get("timeout", "30"))

    def _once(self, url: str) -> bytes:
        request = urllib.request.Request(url, headers={"Accept": "application/json"} | ({"Authorization": f"Token {self.token}"} if self.token else {}))
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as response:
                return response.read()
        except urllib.error.HTTPError as e:
            kind = KINDS.get(e.code, "unavailable" if e.code >= 500 else "refused")
            raise FetchError(kind, f"status {e.code}") from e
        except OSError as e:
            raise FetchError("unavailable", type(e).__name__) from e

    def payloads(self, part: Slice) -> Iterator[bytes]:
        query = urllib.parse.urlencode({"startDate": part.start.isoformat(), "endDate": part.end.isoformat()})
        url = self.base + self.path.format(symbol=urllib.parse.quote(part.symbol, safe="")) + "?" + query
        for attempt in range(self.retries + 1):
            try:
                yield self._once(url)
                return
            except FetchError as e:
                if e.kind not in PASSING or attempt == self.retries:
                    raise
                time.sleep(self.pause * 2**attempt)


class FileTransport:
    """Payload files of a slice's years; ``location`` is a folder or address that Arrow's file systems know."""

    def __init__(self, options: dict[str, str]):
        self.location = options["location"].rstrip("/")

    def payloads(self, part: Slice) -> Iterator[bytes]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(self.location) if "://" in self.location else (fs.LocalFileSystem(), self.location.removeprefix("file:"))
        if files.get_file_info(f"{root}/symbol={part.symbol}").type == fs.FileType.NotFound:
            raise FetchError("unknown_symbol", "no such folder")
        for year in range(part.start.year, part.end.year + 1):
            chosen = fs.FileSelector(f"{root}/symbol={part.symbol}/slice={year}", allow_not_found=True)
            for info in sorted(files.get_file_info(chosen), key=lambda i: i.path):
                if info.is_file and not info.base_name.startswith(("_", ".")):
                    with files.open_input_stream(info.path) as stream:
                        yield stream.read()


TRANSPORTS = {"http": HttpTransport, "files": FileTransport}


def _number(value: object) -> float | None:
    return None if value is None else float(value)  # "1.5" is a number to some vendors


def _instant(value: str) -> datetime:
    when = datetime.fromisoformat(value)
    return when.replace(tzinfo=UTC) if when.tzinfo is None else when


def bar_row(symbol: str, item: dict) -> tuple:
    """A vendor's bar. A missing adjusted close is the close, missing dividends and splits are none."""
    values = [_number(item[c]) for c in OHLCV]
    if any(v is None or not math.isfinite(v) for v in values):
        raise ValueError("a bar has no finite price or volume")
    close = values[3]
    extra = (_number(item.get("adjClose", close)), _number(item.get("divCash", 0.0)), _number(item.get("splitFactor", 1.0)))
    return (symbol, datetime.fromisoformat(item["date"][:10]), *values, *extra)


def news_row(symbol: str, item: dict) -> tuple:
    """A vendor's news item; when it was crawled is when it was first seen."""
    name, published = str(item["id"]).strip(), _instant(item["publishedDate"])
    if not name:
        raise ValueError("a news item has no id")
    seen = _instant(item["crawlDate"]) if item.get("crawlDate") else published
    return (name, symbol, published, seen, *[item.get(k) or "" for k in ("title", "description", "source", "url")])


class _Reader(DataSourceReader):
    def __init__(self, source: type[_Vendor], options: dict[str, str]):
        self.source, self.options = source, dict(options)
        kind = self.options.get("transport", "files")
        if kind not in TRANSPORTS or "location" not in self.options:
            raise SourceError(f"transport and location are needed: {sorted(TRANSPORTS)}")
        self.symbols = sorted({_safe_symbol(s.strip()) for s in self.options.get("symbols", "").split(",") if s.strip()})
        self.start = date.fromisoformat(self.options.get("start", "1990-01-01"))
        self.end = date.fromisoformat(self.options["end"]) if "end" in self.options else datetime.now(UTC).date()

    def partitions(self) -> list[Slice]:
        years = max(1, int(self.options.get("slice_years", "1")))
        return [p for s in self.symbols for p in slices(s, self.start, self.end, years)]

    def read(self, part: Slice) -> Iterator[tuple]:
        try:
            rows = [
                self.source.row(part.symbol, item)
                for payload in TRANSPORTS[self.options.get("transport", "files")](self.options).payloads(part)
                for line in self._documents(payload) for item in line
            ]
        except FetchError as e:
            yield self.source.failed(part) + (e.kind, str(e))
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            yield self.source.failed(part) + ("malformed", f"{type(e).__name__}: {e}"[:200])
        else:
            at = self.source.columns.index(self.source.when)
            inside = [r for r in rows if part.start <= r[at].date() <= part.end]
            for row in sorted(inside, key=lambda r: (r[at], r[0])):
                yield row + (None, None)

    @staticmethod
    def _documents(payload: bytes) -> Iterator[list]:
        """JSON lists: one, or one a line."""
        text = payload.decode("utf-8").strip()
        for line in text.splitlines() if text.startswith("[") and "\n[" in text else [text] if text else []:
            found = json.loads(line)
            if not isinstance(found, list):
                raise ValueError("not a list")
            yield found


class _Vendor(DataSource):
    columns: list[str]
    when: str

    def reader(self, schema) -> _Reader:
        return _Reader(type(self), self.options)

    @classmethod
    def failed(cls, part: Slice) -> tuple:
        """A row that only names what was asked for."""
        return tuple(part.symbol if c == "symbol" else datetime.combine(part.start, datetime.min.time(), cls.zone) if c == cls.when else None for c in cls.columns)


class VendorBars(_Vendor):
    """Daily bars with adjusted closes, dividends and splits."""

    columns, when, zone = ["symbol", "ts", *OHLCV, *PROVIDER_EXTRA], "ts", None
    row = staticmethod(bar_row)

    @classmethod
    def name(cls) -> str:
        return "vendor_bars"

    def schema(self) -> str:
        return "symbol string, ts timestamp_ntz, " + ", ".join(f"{c} double" for c in (*OHLCV, *PROVIDER_EXTRA)) + f", {ERRORS}"


class VendorNews(_Vendor):
    """News items with the instants of publishing and of first sight."""

    columns, when, zone = NEWS_COLUMNS, "published_at", UTC
    row = staticmethod(news_row)

    @classmethod
    def name(cls) -> str:
        return "vendor_news"

    def schema(self) -> str:
        return "item_id string, symbol string, published_at timestamp, first_seen_at timestamp, headline string, body string, source string, url string, " + ERRORS


def register(spark: SparkSession) -> None:
    """Make both formats known to the session."""
    for source in (VendorBars, VendorNews):
        spark.dataSource.register(source)


def fetch(spark: SparkSession, kind: type[_Vendor], options: dict[str, str], symbols: Iterable[str], start: date, end: date) -> DataFrame:
    """Rows of the symbols from ``start`` to ``end``, both included, and a row for each slice that couldn't be had."""
    asked = {"symbols": ",".join(symbols), "start": start.isoformat(), "end": end.isoformat()}
    return spark.read.format(kind.name()).options(**options | asked).load()


def good_rows(fetched: DataFrame) -> DataFrame:
    return fetched.where("error_kind is null").drop("error_kind", "error")


def quarantined(fetched: DataFrame) -> DataFrame:
    """``(symbol, start, error_kind, error)`` of slices that couldn't be had."""
    when = "ts" if "ts" in fetched.columns else "published_at"
    return fetched.where("error_kind is not null").select("symbol", F.col(when).alias("start"), "error_kind", "error")


def select_provider(location: str, token: str | None = None, **options: str) -> dict[str, str]:
    """Options for a read: HTTP with a token where one is given, else files. The token is in no message."""
    chosen = {"transport": "http" if token else "files", "location": location}
    return chosen | ({"token": token} if token else {}) | options
