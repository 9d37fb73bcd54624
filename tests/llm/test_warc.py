import gzip
import hashlib
import random

import pytest

from lodestrata.llm import warc as W


@pytest.fixture(scope="module")
def pages(spark, make):
    rng = random.Random(4)
    big = "<html>" + make(rng, 400)
    rows = [(i, f"http://{rng.choice(['www.a.org', 'b.example.com', 'c.net:8080'])}/p{i % 40}?q={i}#f", f"<p>{make(rng, rng.randint(0, 300))}</p>") for i in range(120)]
    rows += [(200, "http://a.org/x", big), (201, "http://a.org/x", big), (150, "https://z.org", big), (202, "http://a.org/small", "tiny"), (203, "http://a.org/small2", "tiny")]
    rows += [(204, None, None), (205, "", ""), (206, "not a url at all", "é" * 700), (207, "http://[bad", "x"), (208, "http://a.org/ü y", "é" * 700), (201, "http://a.org/x", big), (None, "http://n.org/", big)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def brute(pages):
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    out = []
    for i, p in rows:
        top = max(j for j, q in rows if q == p and j is not None) if len(p) >= 1000 else None
        revisit = top is not None and i is not None and i != top
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("lines", [3000, 7])
def test_round_trip_matches_brute_force(pages, lines):
    found = W.read_archive(W.write_archive(pages, lines)).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=str) == brute(pages)


@pytest.mark.parametrize(("lines", "fences"), [(3000, 100_000), (7, 100_000), (7, 6), (1, 4)])
def test_search_for_every_url_matches_brute_force(pages, lines, fences, monkeypatch):
    """With all first keys as fences, and with a few of them and a join."""
    monkeypatch.setattr(W, "FENCES", fences)
    found = W.search(W.write_archive(pages, lines), pages).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=str) == brute(pages)
    assert W.search(W.write_archive(pages, lines), pages.select("url").limit(0)).count() == 0


def test_lookup_finds_all_captures_of_a_url(pages):
    archive = W.write_archive(pages, 7)
    assert archive.directory.count() > 10
    for url in ("http://a.org/x", "http://www.a.org/p3?q=3", "https://z.org", "http://a.org/small"):
        want = sorted(str(r.page_id) for r in pages.collect() if W.surt(r.url) == W.surt(url))
        got = W.lookup(archive, url)
        assert sorted(str(c.page_id) for c in got) == want
    assert W.lookup(archive, "http://nowhere.org/") == []
    capture = next(c for c in W.lookup(archive, "http://a.org/x") if c.kind == "response")
    assert hashlib.sha1(capture.payload).hexdigest() == capture.digest


def test_records_are_standard(pages):
    raw = gzip.decompress(W.record(5, "http://a.org/", b"hello", hashlib.sha1(b"hello").hexdigest(), None))
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response") and rest.endswith(b"hello\r\n\r\n")
    assert int(fields["Content-Length"]) == len(rest) - 4
    assert W.parse(W.record(5, "http://a.org/", b"hello", "d", 9)).refers_to == 9


def test_keys():
    assert W.surt("http://WWW.a.org:80/x?y#z") == "org,a,www)/x?y"
    assert W.surt("https://a.org:8443") == "org,a:8443)/"
    assert W.surt(None) == ")/"


def test_empty_table(pages):
    assert W.read_archive(W.write_archive(pages.limit(0))).count() == 0
