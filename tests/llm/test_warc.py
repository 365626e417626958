"""Archives and their capture index, against plain Python."""

import base64
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from wayfold.llm import warc
from wayfold.llm.shared import shared_folder

SCHEMA = "page_id long, url string, html string, file string, key string, first string"


def told(rows, least=0):
    """What ``archived`` has to return, row by row."""
    first, made = {}, []
    for page, _, html in rows:
        own = (html or "").encode()
        if page is not None:
            first[own] = min(first.get(own, page), page)
    for page, url, html in rows:
        own = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(own).digest()).decode()
        least_id = first.get(own)
        revisit = len(own) >= least and least_id is not None and page != least_id
        made.append((page, "revisit" if revisit else "response", least_id if revisit else None, len(own), digest))
    return sorted(made, key=repr)


def rows():
    r = random.Random(3)
    hosts = ["a.example.com", "www.a.example.com", "b.example.org", "Ünï.example"]
    made = [(i, f"https://{r.choice(hosts)}/{r.randrange(9)}?q={r.randrange(3)}#f", r.choice(["<p>x", "<p>é\r\n\r\n", "", "y" * 3000, f"own {i}"])) for i in range(300)]
    made += [(1000 + i, "http://hot.example.com/", "same") for i in range(200)]
    made += [(None, "http://n.example/", "same"), (None, "http://n.example/", "only null"), (None, None, "only null"), (7, None, None)]
    made += [made[3]] * 3 + [(-5, "http://u@h.example:80", "z\r\n\r\nWARC/1.1\r\n"), (2, "no host at all\r\nX: 1", "q"), (3, "http://long.example/" + "é" * 900, "q")]
    return made + [(4000 + i, "http://long.example/" + "é" * 900 + str(i), f"l{i}") for i in range(20)]


@pytest.mark.parametrize("least", [0, 10])
def test_every_page_comes_back(spark, monkeypatch, least):
    monkeypatch.setattr(warc, "LINES", 7)
    made = rows()
    pages = spark.createDataFrame([(*x, "e", "e", "e") for x in made], SCHEMA).repartition(3)
    got = warc.archived(pages, least).select("page_id", "record_type", "refers_to", "payload_bytes", "payload_digest")
    assert sorted(map(tuple, got.collect()), key=repr) == told(made, least)


def test_searches_by_url_and_site(spark):
    made = rows()
    folder = shared_folder(spark)
    pages = spark.createDataFrame([(*x, "e", "e", "e") for x in made], SCHEMA)
    captures = warc.write_archives(pages, folder)
    for lines in (5, 40):
        index = warc.build_index(captures, f"{folder}/{lines}", lines)
        keys = [x["k"] for x in spark.createDataFrame([(x[1],) for x in made], "url string").select(warc.url_key(F.col("url")).alias("k")).collect()]
        for search in ("com,example,hot)/ ", "com,", "com,example,a)/3", "nothing", "example,long)/" + "é" * 900, "example,long)/" + "é" * 900 + "1 "):
            got = warc.find(index, spark.createDataFrame([(search,), (search,), (None,)], "search string"))
            assert got.count() == sum((k + " ").startswith(search) for k in keys), search
    # Few blocks at most: lines grow instead.
    assert len(warc.build_index(captures, f"{folder}/few", 5, blocks=4).directory.value) <= 4 + spark.sparkContext.defaultParallelism


def test_keys(spark):
    urls = {"https://www.A.example.com:443/x?y#z": "com,example,a)/x?y", "//u:p@b.org": "org,b)/", "http://b.org?x": "org,b)/?x", "mailto:me": "mailto:me", None: "", "http://c.d/a b": "d,c)/a%20b"}
    found = spark.createDataFrame([(u,) for u in urls], "url string").select("url", warc.url_key(F.col("url")).alias("key")).collect()
    assert {r["url"]: r["key"] for r in found} == urls


def test_records_are_warc(spark):
    sha1 = hashlib.sha1(b"<p>").hexdigest()
    lines = gzip.decompress(warc.record(5, "http://x/", b"<p>", sha1, None)).split(b"\r\n")
    assert lines[0] == b"WARC/1.1" and b"WARC-Type: response" in lines and lines[-3:] == [b"<p>", b"", b""]
    back = warc.parsed(warc.record(6, "http://x/", None, sha1, 5))
    assert back.payload == b"" and warc.page_of(back.fields["WARC-Refers-To"]) == 5 and back.fields["WARC-Profile"] == warc.PROFILE
    with pytest.raises(ValueError, match="broken"):
        warc.parsed(gzip.compress(gzip.decompress(warc.record(5, "u", b"<p>", sha1, None))[:-5]))


def test_no_pages(spark):
    assert warc.archived(spark.createDataFrame([], SCHEMA)).collect() == []
