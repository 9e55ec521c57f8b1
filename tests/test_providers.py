"""The vendor data sources: slices, pushed conditions, HTTP with retries, and quarantined slices."""

import json
import threading
from collections import Counter
from datetime import date, datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from barloom.sources import providers
from barloom.sources.bars import SourceError


def bar(day, close=2.0, **more):
    return {"date": f"{day}T00:00:00.000Z", "open": 1.0, "high": 3.0, "low": 0.5, "close": close, "volume": 10} | more


class Vendor(BaseHTTPRequestHandler):
    asked: list = []
    failures: Counter = Counter()

    def do_GET(self):  # noqa: N802
        url = urlparse(self.path)
        symbol, query = url.path.rsplit("/", 1)[1], parse_qs(url.query)
        Vendor.asked.append((symbol, query["startDate"][0], query["endDate"][0]))
        status, body = 200, b"[]"
        if self.headers.get("Authorization") != "Token secret":
            status = 401
        elif symbol == "GONE":
            status = 404
        elif symbol == "BUSY":
            status = 429
        elif symbol == "ODD":
            body = b'{"detail": "not a list"}'
        elif symbol == "HOLE":
            body = json.dumps([bar("2020-01-02", None)]).encode()
        elif symbol == "SLOW" and Vendor.failures[self.path] < 2:
            Vendor.failures[self.path] += 1
            status = 503
        else:
            body = json.dumps([bar(query["startDate"][0], adjClose="1.5"), bar("1999-01-01")]).encode()
        self.send_response(status)
        self.end_headers()
        self.wfile.write(body if status == 200 else b"")

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def server():
    with ThreadingHTTPServer(("127.0.0.1", 0), Vendor) as http:
        threading.Thread(target=http.serve_forever, daemon=True).start()
        yield f"http://127.0.0.1:{http.server_address[1]}"
        http.shutdown()


@pytest.fixture(scope="module")
def registered(spark):
    providers.register(spark)
    return spark


def bars(spark, location, symbols, token="secret", start=date(2019, 6, 1), end=date(2021, 3, 31), **more):
    options = providers.select_provider(location, token, retries="2", pause="0.01", **more)
    return providers.fetch(spark, providers.VendorBars, options, symbols, start, end)


def test_slices():
    found = providers.slices("A", date(2019, 6, 1), date(2021, 3, 31), 1)
    assert [(p.start, p.end) for p in found] == [
        (date(2019, 6, 1), date(2019, 12, 31)), (date(2020, 1, 1), date(2020, 12, 31)), (date(2021, 1, 1), date(2021, 3, 31)),
    ]
    assert len(providers.slices("A", date(2019, 6, 1), date(2021, 3, 31), 5)) == 2
    assert providers.slices("A", date(2020, 1, 2), date(2020, 1, 1), 1) == []


def test_http_rows_and_quarantine(registered, server):
    got = bars(registered, server, ["OK", "SLOW", "GONE", "BUSY", "ODD", "HOLE"]).cache()
    rows = sorted((r["symbol"], r["ts"], r["adj_close"], r["split_factor"]) for r in providers.good_rows(got).collect())
    days = [datetime(2019, 6, 1), datetime(2020, 1, 1), datetime(2021, 1, 1)]
    assert rows == [(s, d, 1.5, 1.0) for s in ("OK", "SLOW") for d in days]  # 1999 is outside of what was asked
    wrong = Counter((r["symbol"], r["error_kind"]) for r in providers.quarantined(got).collect())
    assert wrong == {("GONE", "unknown_symbol"): 3, ("BUSY", "rate_limited"): 3, ("ODD", "malformed"): 3, ("HOLE", "malformed"): 3}
    assert not any("secret" in (r["error"] or "") for r in got.collect())
    refused = providers.quarantined(bars(registered, server, ["OK"], token="other")).collect()
    assert {r["error_kind"] for r in refused} == {"auth"}
    gone = providers.quarantined(bars(registered, "http://127.0.0.1:9", ["OK"])).collect()
    assert {r["error_kind"] for r in gone} == {"unavailable"}


def test_only_what_is_asked_is_requested(registered, server):
    Vendor.asked.clear()
    frame = bars(registered, server, ["OK", "OTHER"], start=date(2020, 2, 3), end=date(2021, 1, 5))
    assert frame.rdd.getNumPartitions() == 4
    assert frame.where("symbol = 'OK' and ts < timestamp_ntz'2020-12-31'").count() == 1
    assert set(Vendor.asked) == {(s, *d) for s in ("OK", "OTHER") for d in (("2020-02-03", "2020-12-31"), ("2021-01-01", "2021-01-05"))}
    assert frame.count() == 4  # the filter before isn't kept


def test_files(registered, tmp_path):
    folder = tmp_path / "symbol=A" / "slice=2020"
    folder.mkdir(parents=True)
    (folder / "part-1").write_text(json.dumps([bar("2020-05-01"), bar("2020-04-01")]) + "\n" + json.dumps([bar("2020-06-01")]))
    (folder / "_SUCCESS").write_text("")
    got = bars(registered, str(tmp_path), ["A", "B"], token=None)
    assert [r["ts"].month for r in providers.good_rows(got).collect()] == [4, 5, 6]
    assert {(r["symbol"], r["error_kind"]) for r in providers.quarantined(got).collect()} == {("B", "unknown_symbol")}
    (folder / "part-2").write_text("[{")
    assert {r["error_kind"] for r in providers.quarantined(bars(registered, str(tmp_path), ["A"], token=None)).collect()} == {"malformed"}


def test_news(registered, tmp_path):
    folder = tmp_path / "symbol=A" / "slice=2020"
    folder.mkdir(parents=True)
    items = [
        {"id": 7, "publishedDate": "2020-05-01T10:00:00+02:00", "crawlDate": "2020-05-01T09:00:00Z", "title": "t", "url": None},
        {"id": "8", "publishedDate": "2020-05-02T10:00:00"},
    ]
    (folder / "x.json").write_text(json.dumps(items))
    found = providers.fetch(registered, providers.VendorNews, providers.select_provider(str(tmp_path)), ["A"], date(2020, 1, 1), date(2020, 12, 31))
    rows = found.selectExpr("item_id", "unix_seconds(published_at) p", "unix_seconds(first_seen_at) f", "headline", "url", "error_kind").collect()
    at = lambda h: int(datetime.fromisoformat(h).timestamp())
    assert [tuple(r) for r in rows] == [
        ("7", at("2020-05-01T08:00:00+00:00"), at("2020-05-01T09:00:00+00:00"), "t", "", None),
        ("8", at("2020-05-02T10:00:00+00:00"), at("2020-05-02T10:00:00+00:00"), "", "", None),
    ]


def test_wrong_options(registered):
    for options in ({"transport": "carrier"}, {"transport": "http"}, {"transport": "files", "location": "/x", "symbols": "../a"}):
        with pytest.raises(Exception, match="needed|not a symbol"):
            registered.read.format("vendor_bars").options(**options).load().collect()
    assert issubclass(SourceError, ValueError)
