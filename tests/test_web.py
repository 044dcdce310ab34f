"""The web sources against a server on this machine."""

import base64
import json
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer, ThreadingHTTPServer

import pytest

from quillmill.operators.generate import HttpGenerator
from quillmill.sources import web

HOW = {"rate": 0, "retries": 2, "robots": False}
calls: dict[str, int] = {}


class Replies(BaseHTTPRequestHandler):
    def log_message(self, *_):
        pass

    def do_POST(self):
        said = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps({"content": None if said["prompt"] == "none" else f" {said['prompt']} {said['n_predict']} "}).encode())

    def do_GET(self):
        path = self.path.split("?")[0]
        key = self.path
        calls[key] = calls.get(key, 0) + 1
        page = "page=2" in self.path
        q = lambda i, **k: {"question_id": i, "title": f"How {i}?", "body": "<p>Use <code>x</code></p>", "score": 5, "accepted_answer_id": i + 100, "tags": ["a"], "link": "l", "owner": {"display_name": "n"}} | k
        link, code = "", 200
        if path == "/questions":
            body = {"items": [q(3)], "has_more": False} if page else {"items": [q(1), q(2, score=1), {"question_id": 9, "score": 9}], "has_more": True}
        elif path == "/answers/101":
            body = {"items": [{"body": "<b>Yes</b>", "score": 2}]}
        elif path == "/answers/103":
            code, body = 404, {}
        elif path == "/repos/o/r/issues":
            issue = {"number": 4, "title": "T", "body": None, "comments": 1, "comments_url": f"http://127.0.0.1:{self.server.server_port}/c/4", "labels": [{"name": "bug"}], "user": {"login": "u"}}
            body = [] if page else [issue, issue | {"pull_request": {"url": "u"}}, issue | {"comments": 0}]
            link = '<x>; rel="next"'
        elif path == "/c/4":
            code, body = (500, {}) if calls[key] == 1 else (200, [{"body": "first"}, {"body": "second"}])
        elif path == "/repos/o/r/readme":
            body = {"content": base64.b64encode("Läs".encode()).decode()}
        elif path == "/health":
            body = {"status": "ok"}
        elif path == "/props":
            body = {"n_ctx": 4096}
        elif path == "/robots.txt":
            body = None
        else:
            code, body = 404, {}
        self.send_response(code)
        if link:
            self.send_header("Link", link)
        self.end_headers()
        self.wfile.write(b"User-agent: *\nDisallow: /secret" if body is None else json.dumps(body).encode())


@pytest.fixture(scope="module")
def api():
    server = HTTPServer(("127.0.0.1", 0), Replies)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_questions(spark, api):
    got = web.questions(spark, api, ["a", "b"], min_score=3, **HOW).collect()
    assert [(r.id, r.instruction, r.response, r.score, r.answer_score) for r in got] == [("stackoverflow_1", "How 1?\n\nUse ```\nx\n```", "Yes", 5, 2)]


def test_issues_and_readmes(spark, api):
    got = web.issues(spark, api, ["o/r", "no/one"], **HOW).collect()
    assert [(r.id, r.instruction, r.response, r.tags) for r in got] == [("github_o_r_4", "T", "first", ["bug"])]
    got = web.readmes(spark, api, ["o/r", "no/one"], **HOW).collect()
    assert [(r.id, r.response, r.author) for r in got] == [("github_o_r_readme", "Läs", "o")]


def test_robots_and_failures(api):
    get = web.Fetcher(rate=0, retries=1)
    assert get(f"{api}/secret/x") is None and get(f"{api}/answers/101")[0] and get(f"{api}/nothing") is None
    assert web.Fetcher(rate=0, retries=1, robots=False)("http://127.0.0.1:9/x") is None


def test_completion_server(api):
    model = HttpGenerator(api, max_tokens=9)
    assert model.healthy() and model.generate("say") == "say 9" and model.generate("none") is None
    gone = HttpGenerator("http://127.0.0.1:9", timeout=2)
    assert not gone.healthy() and gone.generate("say") is None


def test_hosts_are_asked_one_at_a_time(spark):
    """Rows of two hosts over many tasks: a host's requests lie the rate apart, and hosts don't wait for each other."""
    times: dict[str, list[float]] = {}

    class Clock(BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def do_GET(self):
            times.setdefault(self.headers["Host"].split(":")[0], []).append(time.monotonic())
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b'{"items": [1], "has_more": false}')

    server = ThreadingHTTPServer(("127.0.0.1", 0), Clock)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    port, hosts = server.server_port, ("127.0.0.1", "localhost")
    rows = [(k, f"http://{hosts[k % 2]}:{port}/{k}") for k in range(16)] + [(99, None)]
    df = spark.createDataFrame(rows, "k int, address string").repartition(8)
    got = web.fetched(df, "address", rate=0.5, robots=False).collect()
    assert len(got) == 17 and sum(r.reply is None for r in got) == 1
    for h in hosts:
        at = sorted(times[h])
        assert len(at) == 8 and min(b - a for a, b in zip(at, at[1:])) > 0.3
    times.clear()
    urls = [f"http://{h}:{port}/p{k}?page={{page}}" for k in range(4) for h in hosts]
    assert web.pages(spark, urls, rate=0.5, robots=False).count() == 8
    for h in hosts:
        at = sorted(times[h])
        assert len(at) == 4 and min(b - a for a, b in zip(at, at[1:])) > 0.3
    server.shutdown()
    assert web.in_turn(["http://a/1", "http://a/2", None, "http://b/1", "http://a/3", "http://b/2"]) == [0, 2, 3, 1, 5, 4]


def test_a_model_server_is_waited_for(api):
    model = HttpGenerator(api, timeout=5)
    assert model.properties() == {"n_ctx": 4096} and model.wait_ready(1)
    absent = HttpGenerator("http://127.0.0.1:9", timeout=1)
    assert absent.properties() == {} and not absent.wait_ready(0.2, 0.05)
