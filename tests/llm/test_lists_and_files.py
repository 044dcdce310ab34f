"""The URL filter without broadcasts and with hosts of other alphabets; archive files of attempts that meet."""

import random

import pytest

from quillmill.llm import url_filter, warc


def brute(url, listed):
    if not url or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    low = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x)
    host, tail = low(rest[:cut]), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    hits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in ((low(h), p, v) for h, p, v in listed) if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(hits, default=None)
    return host, path, best[2] if best else None, best[3] if best else "allow"


def test_without_broadcasts(spark, monkeypatch):
    """A long list whose filter is shuffled to, and pages that share one host and path."""
    rng = random.Random(2)
    listed = [(f"h{k}.com", rng.choice(["", "/", "/a/", "/a/b"]), "block") for k in range(3000)] + [("com", "/hot/", "allow"), ("É.org", "/", "block"), ("Ω.net", "", "block")]
    urls = ["https://x.com/hot/1"] * 3000 + [f"http://{rng.choice(['', 'www.'])}h{rng.randrange(4000)}.COM{rng.choice(['', '/', '/a/b/c', '/a?b', '/hot/x#y'])}" for _ in range(3000)]
    urls += ["http://É.org/x", "http://é.org/x", "http://a.Ω.NET", "http://ω.net", None, "no", "://", "http://É.ORG/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = spark.createDataFrame(listed, "host string, path string, verdict string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(url_filter, "BROADCAST_BYTES", 0)
    try:
        out = url_filter.judge(pages, rules)
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    by_host = {}
    for h, p, v in listed:
        by_host.setdefault(h.split(".")[0], []).append((h, p, v))
    for k, u in enumerate(urls):
        name = (u or "").split("://")[-1].replace("www.", "").split(".")[0]
        assert got[k] == brute(u, by_host.get(name, []) + by_host["com"] + by_host["É"] + by_host["Ω"]), u
    assert got[len(urls) - 8][2] == "É.org/" and got[len(urls) - 7][2] is None and got[len(urls) - 6][2] == "Ω.net"


def roller(folder, data):
    r = warc._Roller(f"file://{folder}", 3, 10**9)
    list(r.add(data))
    return r


class Watched:
    """A file system that fails at a call, as a killed task would stop there."""

    def __init__(self, fs, dies_at=None):
        self.fs, self.dies_at, self.gone = fs, dies_at, []

    def __getattr__(self, name):
        if name == self.dies_at:
            raise KeyboardInterrupt
        return getattr(self.fs, name)

    def delete_file(self, path):
        self.gone.append(path)
        if self.dies_at == "delete_file":
            raise KeyboardInterrupt
        self.fs.delete_file(path)


@pytest.mark.parametrize("dies_at", [None, "delete_file", "move"])
def test_a_later_attempt_leaves_the_file(tmp_path, dies_at):
    first = roller(tmp_path, b"the same bytes").close()
    at = tmp_path / first[0]
    kept = at.stat().st_ino
    again = roller(tmp_path, b"the same bytes")
    again.fs = Watched(again.fs, dies_at)
    try:
        assert again.close() == first
    except KeyboardInterrupt:
        assert dies_at == "delete_file"
    assert at.stat().st_ino == kept and at.read_bytes() == b"the same bytes" and str(at) not in again.fs.gone


def test_a_torn_file_is_replaced(tmp_path):
    whole = roller(tmp_path, b"all of it")
    at = tmp_path / whole.name
    at.write_bytes(b"all")
    assert whole.close()[4] == 9 and at.read_bytes() == b"all of it"
    other = roller(tmp_path, b"new bytes")

    class NeverOver(Watched):
        def move(self, source, target):
            if self.fs.get_file_info(target).is_file:
                raise OSError("the target is there")
            self.fs.move(source, target)

    other.fs = NeverOver(other.fs)
    other.close()
    assert at.read_bytes() == b"new bytes" and [p.name for p in tmp_path.iterdir()] == [at.name]
