"""WARC archives and URL filters."""

import base64
import gzip
import hashlib
import io
import random

import pytest
from lectern.llm import url_filters, warc
from lectern.llm.common import fresh_path

from .cases import clashing

PAGES = "page_id long, url string, html string"


def pages():
    rng = random.Random(6)
    big = "".join(chr(rng.randrange(32, 0x2FF)) for _ in range(300_000))
    rows = [(k, f"http://h{k % 3}.example.com/{k}", rng.choice(["", None, "same", "é" * 10, f"<p>{k}</p>"])) for k in range(200)]
    return rows + [(500, None, big), (501, "http://x/\r\nInjected: 1", big), (502, "u", "a\r\n\r\nb\x00"), (503, "u", "tail\r\n\r\n"), (None, "u", "nobody"), (None, "u", "same")]


def expected(rows):
    first, out = {}, []
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        data = (h or "").encode()
        revisit = data in first
        to = first.setdefault(data, i)
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [64 << 20, 4096])
def test_round_trip(spark, monkeypatch, size):
    monkeypatch.setattr(warc, "ARCHIVE", size)
    rows = pages()
    manifest = warc.write_archives(spark.createDataFrame(rows, PAGES), fresh_path(spark, "warc"))
    got = warc.resolved(warc.read_archives(spark, manifest)).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(rows)
    full = warc.read_archives(spark, manifest, payloads=True).where("record_type = 'response'").collect()
    by = {r.page_id: r for r in full}
    assert by[502].payload == b"a\r\n\r\nb\x00" and by[500].payload == dict((r[0], r[2]) for r in rows)[500].encode()
    for r in manifest.collect():
        data = open(r.path.removeprefix("file://"), "rb").read()
        assert len(data) == r.bytes and gzip.decompress(data).count(b"WARC/1.1\r\nWARC-Type") == r.records


def test_empty_and_repeated(spark):
    none = warc.write_archives(spark.createDataFrame([], PAGES), fresh_path(spark, "warc"))
    assert none.count() == 0 and warc.resolved(warc.read_archives(spark, none)).count() == 0
    rows = [(1, "u", "x"), (1, "u", "x"), (2, "u", "x"), (None, None, "y"), (None, None, "y")]
    found = warc.read_archives(spark, warc.write_archives(clashing(spark.createDataFrame(rows, PAGES)), fresh_path(spark, "warc")))
    got = warc.resolved(found).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or -1) for r in got) == [(0, "response", -1), (0, "revisit", -1), (1, "response", -1), (1, "revisit", 1), (2, "revisit", 1)]
    assert len({r.record_id for r in found.collect()}) == len(rows)


def test_file_systems():
    store, path = warc.filesystem("/tmp/a")
    assert store.type_name == "local" and path == "/tmp/a"
    assert warc.filesystem("file:///tmp/a")[1] == warc.filesystem("file:/tmp/a")[1] == "/tmp/a"
    with pytest.raises(Exception):
        warc.filesystem("nosuch://x/a")


def one(payload=b"hello", **change):
    fields = {"WARC-Type": "response", "WARC-Record-ID": "<x>", "Content-Type": "application/http;msgtype=response", "WARC-Payload-Digest": f"sha1:{warc.base32_sha1(payload)}"} | change
    return warc.record(list(fields.items()), b"HTTP/1.1 200 OK\r\n\r\n" + payload)


class Slow(io.BytesIO):
    def read(self, n=-1):
        return super().read(3)


def test_reader():
    data = one() + one(b"") + one(b"x" * 300_000)
    for raw in (io.BytesIO(data), Slow(data)):
        got = list(warc.records(raw, payloads=True))
        assert [r["payload"] for r in got] == [b"hello", b"", b"x" * 300_000]
    assert list(warc.records(io.BytesIO(b""))) == []


@pytest.mark.parametrize(
    "data",
    [
        one()[:-9],
        one()[:40],
        one(**{"WARC-Payload-Digest": "sha1:AAAA"}),
        gzip.compress(gzip.decompress(one()).replace(b"hello", b"hellO")),
        gzip.compress(gzip.decompress(one()) + b"more"),
        gzip.compress(gzip.decompress(one()) * 2),
        gzip.compress(gzip.decompress(one())[:-6]),
        gzip.compress(b"nothing of the kind\r\n\r\n"),
    ],
)
def test_reader_refuses(data):
    with pytest.raises((ValueError, Exception)):
        list(warc.records(io.BytesIO(data)))


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    path = rest[end:]
    stop = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), path[:stop]


URLS = [
    None, "", "nope", "http://", "https://Example.COM/en/7?x=/de/", "http://a.example.com/en/71", "x://com/en/", "http://com/en", "http://example.net/de/8", "http://w.net/de/9#a://b", "http://o.org/es/",
    "http://notcom/en/1", "ftp://É.com/en/é?q", "http://a.net?/de/", "http://a.net#x", "http://b.org/es/a://c", "http://h\nx.com/en/\ny",
]


@pytest.mark.parametrize("chain", [200, 0])
def test_rules(spark, monkeypatch, chain):
    monkeypatch.setattr(url_filters, "CHAIN", chain)
    got = url_filters.judged(spark.createDataFrame([(k, u, None) for k, u in enumerate(URLS)], PAGES)).collect()
    for r in got:
        host, path = split(URLS[r.id])
        fits = [x for x in url_filters.RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fits, key=lambda x: len(x.name), default=None)
        assert (r.host, r.path, r.rule) == (host, path, best.name if best else None)
        if best:
            assert r.verdict == best.verdict
    assert len(got) == len(URLS)


def test_propagation_goes_on_to_the_end(spark, monkeypatch):
    """A chain of more steps than a few, and ranks that are not done in time."""
    links = spark.createDataFrame([(f"h{k:02}", f"h{(k + 1) % 24:02}", 1) for k in range(24)], "src string, dst string, n long")
    seeds = spark.createDataFrame([("trust", "h00", 1.0)], "kind string, host string, share double")
    got = {r.host: r.score for r in url_filters.propagated(links, seeds, damping=0.6, tolerance=1e-6).collect() if r.kind == "trust"}
    total = sum(0.6**k for k in range(24))
    assert len(got) == 24 and all(abs(got[f"h{k:02}"] - 0.6**k / total) < 1e-5 for k in range(24))
    monkeypatch.setattr(url_filters, "MOST_STEPS", 3)
    with pytest.raises(RuntimeError):
        url_filters.propagated(links, seeds)


def test_propagation(spark):
    rng = random.Random(8)
    hosts = [f"h{k}.site{k % 4}.info" for k in range(14)] + ["good.example", "bad.example"]
    links = {(s, d): rng.randrange(1, 4) for s in hosts for d in rng.sample(hosts, 3) if s != d and s != "h3.site3.info"}
    links.update({(f"h{k}.site{k % 4}.info", "bad.example"): 30 for k in (5, 6)})
    rows = []
    for k, h in enumerate(hosts):
        html = "".join(f'<a href="{rng.choice(["http:", "https:", ""])}//{d.upper()}/p?{i}">x</a><a href=/local>y</a>' for (s, d), n in links.items() if s == h for i in range(n))
        rows.append((k, f"http://{h}/a", html))
    rows.append((99, None, '<a href="http://bad.example/">'))
    rules = (url_filters.UrlRule("allow", "good.example"), url_filters.UrlRule("block", "bad.example"))

    def rank(seed, out):
        score = {seed: 1.0}
        for _ in range(150):
            new, kept = {}, 0.0
            for u, x in score.items():
                total = sum(n for (a, _), n in out.items() if a == u)
                for (a, b), n in out.items():
                    if a == u:
                        new[b] = new.get(b, 0) + 0.85 * x * n / total
                        kept += 0.85 * x * n / total
            new[seed] = new.get(seed, 0) + 1 - kept
            score = new
        return score

    trust, distrust = rank("good.example", links), rank("bad.example", {(b, a): n for (a, b), n in links.items()})
    want = {h: distrust.get(h, 0) > 0.8 * (trust.get(h, 0) + 1 / 16) for h in hosts}
    assert want["h5.site1.info"] and not all(want.values())
    got = {r.host: r for r in url_filters.judged(spark.createDataFrame(rows, PAGES), rules, ratio=0.8).collect()}
    for h in hosts[:-2]:
        assert (got[h].verdict == "block") == want[h], h
    assert got["good.example"].verdict == "allow" and got["bad.example"].verdict == "block" and got[""].verdict == "allow"
    assert url_filters.judged(spark.createDataFrame([], PAGES)).count() == 0
