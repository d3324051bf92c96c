"""The vendor's search: pages, retries, failures, and a stream that is cut off and resumed."""

import json
import os

import pytest

from driftline.session import scratch_path
from driftline.sources.adsource import AdSearch
from driftline.streaming.streams import drained


def record(folder, number, domain, pages):
    """``pages``: token to what each attempt gets."""
    for token, told in pages.items():
        at = f"{folder}/request={number}-{domain}/page={token}"
        os.makedirs(at)
        with open(f"{at}/part-0.txt", "w") as f:
            json.dump([{"status": s, "body": b} for s, b in told], f)


def ok(following=None, ads=()):
    return (200, json.dumps({"ad_creatives": list(ads), "next": following}))


@pytest.fixture
def reader(spark, tmp_path):
    spark.dataSource.register(AdSearch)
    os.makedirs(f"{tmp_path}/in")

    def read(**options):
        r = spark.read.format("ad_search").option("path", f"{tmp_path}/in").option("backoffMs", "1")
        for k, v in options.items():
            r = r.option(k, str(v))
        return sorted((r.request, r.page, r.outcome, r.reason, r.attempts) for r in r.load().collect())

    return f"{tmp_path}/in", read


def test_pages_retries_and_failures(reader):
    folder, read = reader
    assert read() == []
    record(folder, 1, "a.example", {"first": [ok("x")], "x": [(503, None), (429, None), ok("y")], "y": [ok()]})
    record(folder, 2, "b.example", {"first": [ok("x")], "x": [(503, None)], "y": [ok()]})
    record(folder, 3, "c.example", {"first": [(403, None), ok()]})
    record(folder, 4, "d.example", {"first": [(200, "broken")]})
    record(folder, 5, "e-f.example", {"first": [ok("gone")]})
    assert read(retries=2, perPartition=2) == [
        (1, 0, "OK", None, 1),
        (1, 1, "OK", None, 3),
        (1, 2, "OK", None, 1),
        (2, 0, "OK", None, 1),
        (2, 1, "UNAVAILABLE", "status 503", 3),
        (3, 0, "UNAVAILABLE", "status 403", 1),
        (4, 0, "UNAVAILABLE", "unreadable answer", 1),
        (5, 0, "OK", None, 1),
        (5, 1, "UNAVAILABLE", "status 404", 1),
    ]
    assert [r for r in read(retries=2, maxPages=2) if r[0] == 1] == [(1, 0, "OK", None, 1), (1, 1, "CUT", None, 3)]


def test_a_stream_resumes_after_the_last_answer(spark, reader, tmp_path):
    folder, _ = reader
    stream = spark.readStream.format("ad_search").option("path", folder).option("backoffMs", "1").option("perBatch", "2").load().select("request", "domain", "page")
    out = f"file://{tmp_path}/out"
    got = lambda: sorted((r.request, r.page) for r in drained(stream, "ads", path=out).collect())
    for n in range(5):
        record(folder, n, f"s{n}.example", {"first": [ok("x")], "x": [ok()]})
    first = got()
    for _ in range(4):  # a run may end before it has read all that there is
        first = got()
    assert first == [(n, p) for n in range(5) for p in (0, 1)]
    record(folder, 9, "s9.example", {"first": [ok()]})
    for _ in range(2):
        again = got()
    assert again == [*first, (9, 0)]


def test_vendor_search_keeps_many_requests_in_few_files(spark, small, monkeypatch):
    """A folder for each page of a request was written before: a file for two rows."""
    import pyarrow.fs

    from driftline.plans import QUERIES, storefronts

    paths = []
    monkeypatch.setattr(storefronts, "scratch_path", lambda s, name: paths.append(scratch_path(s, name)) or paths[-1])
    stores = QUERIES["vendor_search"](spark, small).count()
    store, root = pyarrow.fs.FileSystem.from_uri(paths[0])
    files = [f for f in store.get_file_info(pyarrow.fs.FileSelector(root, recursive=True)) if f.is_file and f.base_name.startswith("part-")]
    assert stores == 10 and len(files) <= 4  # shuffle partitions of the tests


def test_filed_answers_are_those_of_recorded_ones(spark, tmp_path):
    pages = {"first": [ok("x")], "x": [(503, None), ok("gone")]}
    told = {t: [{"status": s, "body": b} for s, b in answers] for t, answers in pages.items()}
    for name in ("a", "b"):
        with open(f"{tmp_path}/{name}.txt", "w") as f:
            f.writelines(json.dumps({"request": n, "domain": f"{name}{n}.example", "pages": told}) + "\n" for n in range(3))
    read = spark.read.format("ad_search").option("path", str(tmp_path)).option("client", "driftline.sources.adsource:FiledSearch").option("backoffMs", "1").load()
    assert read.rdd.getNumPartitions() == 2
    assert sorted((r.domain, r.request, r.page, r.outcome, r.reason, r.attempts) for r in read.collect()) == sorted(
        (f"{name}{n}.example", n, *page) for name in ("a", "b") for n in range(3) for page in [(0, "OK", None, 1), (1, "OK", None, 2), (2, "UNAVAILABLE", "status 404", 1)]
    )
