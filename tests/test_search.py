"""The search source against a local stub: every document once, in order; anything partial fails."""

from __future__ import annotations

import datetime
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from siftline.sources import logs, search

DAY = datetime.date(2024, 3, 31)  # of 23 hours in London


class Stub:
    """An engine with documents by time; ``odd`` makes its searches partial in one way."""

    def __init__(self, docs, odd=""):
        self.docs, self.odd, self.open, self.opened, self.headers = sorted(docs, key=lambda d: d["@timestamp"]), odd, set(), 0, set()
        stub = self

        class Handler(BaseHTTPRequestHandler):
            def answer(self, reply, code=200):
                body = json.dumps(reply).encode()
                self.send_response(code)
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)

            def body(self):
                return json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")

            def log_message(self, *args):
                pass

            def do_DELETE(self):
                stub.open.discard(self.body()["id"])
                self.answer({})

            def do_POST(self):
                asked = self.body()
                stub.headers.add(self.headers.get("Authorization"))
                if "_pit" in self.path:
                    stub.opened += 1
                    stub.open.add(f"p{stub.opened}")
                    return self.answer({"id": f"p{stub.opened}", "_shards": {"total": 2, "successful": 2, "failed": 0}})
                if asked["pit"]["id"] not in stub.open:
                    return self.answer({}, 404)
                ends = asked["query"]["range"]["@timestamp"]
                mine = [(k, d) for k, d in enumerate(stub.docs) if ends["gte"] <= d["@timestamp"] < ends["lt"]]
                at = asked.get("search_after", [None, -1])[1]
                page = [{"_source": d, "sort": [d["@timestamp"], k]} for k, d in mine if k > at][: asked["size"]]
                if stub.odd == "short" and len(mine) > 3 and at >= 0:
                    page = []
                shards = {"total": 2, "successful": 1 if stub.odd == "shards" else 2, "failed": 0}
                self.answer({"timed_out": stub.odd == "slow", "_shards": shards, "pit_id": asked["pit"]["id"], "hits": {"total": {"value": len(mine)}, "hits": page}})

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}"


def made():
    first = datetime.datetime(2024, 3, 30, 23, 0)
    at = [first + datetime.timedelta(minutes=7 * k) for k in range(260)] + [datetime.datetime(2024, 3, 31)] * 9
    return [{"@timestamp": t.isoformat() + "Z", "message": f"m{k} <é>", "host": {"name": "h"}} for k, t in enumerate(at)]


def test_slices_cover_a_day():
    slices = search.day_slices("2024-03-31", "Europe/London", 5)
    assert slices[0][0] == "2024-03-31T00:00:00Z" and slices[-1][1] == "2024-03-31T23:00:00Z" and all(a[1] == b[0] for a, b in zip(slices, slices[1:]))
    assert search.day_slices("2024-10-27", "Europe/London", 1) == [("2024-10-26T23:00:00Z", "2024-10-28T00:00:00Z")]


def test_every_document_once(spark):
    stub = Stub(made())
    rows = search.read_day(spark, stub.url, "logs-*", DAY, zone="Europe/London", slices=7, page=4, apikey="k").orderBy("line_no").collect()
    want = [d for d in stub.docs if "2024-03-31T00:00:00Z" <= d["@timestamp"] < "2024-03-31T23:00:00Z"]
    assert [json.loads(r.raw) for r in rows] == want and len(rows) > 150 and len({r.line_no for r in rows}) == len(rows)
    assert not stub.open and stub.headers == {"ApiKey k"}
    flat = logs.flattened(search.read_day(spark, stub.url, "logs-*", DAY, slices=2)).first().flat
    assert list(json.loads(flat)) == ["@timestamp", "host.name", "message"]
    assert search.read_day(spark, stub.url, "logs-*", datetime.date(2020, 1, 1)).count() == 0


@pytest.mark.parametrize("odd", ["short", "shards", "slow"])
def test_what_is_partial_fails(spark, odd):
    stub = Stub(made(), odd)
    with pytest.raises(Exception, match="Incomplete"):
        search.read_day(spark, stub.url, "logs-*", DAY, slices=3, page=4).collect()
    assert not stub.open
