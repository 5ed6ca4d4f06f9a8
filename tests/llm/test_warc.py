import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from wirefold.llm.warc import base32_sha1, read_warc, sort_key, write_warc


@pytest.fixture
def pages(spark):
    def make(rows):
        return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows],
                                     "page_id long, url string, html string, shard string, sha1 int")
    return make


ROWS = [(i, f"http://h.example/{i}", f"<p>page {i % 7} é</p>" * (i % 5 + 1)) for i in range(60)] + [
    (100, None, None), (101, "http://x/%0A%", ""), (102, "http://x/a\r\nb", "big " * 60000),
    (5, "http://again/", "<p>page 5 é</p>"), (200, "u", "twice"), (200, "u", "twice"), (None, "n", "nameless"), (None, "n", "nameless"),
    (None, "n", "twice"), (-7, "neg", "\r\n\r\nWARC/1.1\r\n")]


def brute(rows, least):
    groups = {}
    for i, _, h in rows:
        groups.setdefault(h or "", []).append(i)
    out, used = [], set()
    for i, _, h in rows:
        data = (h or "").encode()
        ids = groups[h or ""]
        low = min((x for x in ids if x is not None), default=None)
        first = i == low and (h or "") not in used
        if first:
            used.add(h or "")
        revisit = len(data) >= least and len(ids) > 1 and not first
        out.append((i, len(data), base32_sha1(data), "revisit" if revisit else "response", low if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("least", "shard_bytes", "roll"), [(0, 20_000, 400), (10, 1 << 24, 1 << 28)])
def test_round_trip(spark, pages, tmp_path, least, shard_bytes, roll):
    folder = f"file://{tmp_path}/w"
    manifest = write_warc(pages(ROWS).repartition(4), folder, least_bytes=least, shard_bytes=shard_bytes, roll_bytes=roll)
    back = read_warc(manifest, folder).collect()
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in back), key=repr)
    assert got == brute(ROWS, least)
    assert all(r["digest_ok"] for r in back) and len({r["record_id"] for r in back}) == len(back)
    urls = sorted((r["page_id"], r["url"]) for r in back if r["page_id"] is not None and r["url"] is not None)
    assert urls == sorted((i, u) for i, u, _ in ROWS if i is not None and u is not None)
    files = {r["file"]: r for r in manifest.collect()}
    for name, r in files.items():
        data = (tmp_path / "w" / name).read_bytes()
        assert len(data) == r["bytes"] and hashlib.sha1(data).hexdigest() == r["sha1"]
        assert gzip.decompress(data).count(b"WARC-Record-ID: <urn") == r["records"]
    assert not any((tmp_path / "w" / "_temporary").iterdir())
    assert len(files) > (1 if roll == 400 else 0)


def test_archives_do_not_depend_on_the_partitions(spark, pages, tmp_path):
    rows = [r for r in ROWS if r[0] != 200]
    sums = []
    for n in (1, 5):
        folder = f"file://{tmp_path}/p{n}"
        m = write_warc(pages(rows).repartition(n), folder, shard_bytes=20_000, roll_bytes=900)
        sums.append(sorted((r["file"], r["sha1"]) for r in m.collect()))
    assert sums[0] == sums[1]


def test_shards_follow_bytes_and_files_the_roll_size(spark, pages, tmp_path):
    rnd = random.Random(2)
    text = lambda: "".join(rnd.choices("abcdefghijklmnop <>/", k=2000))
    rows = [(i, "u", text()) for i in range(150)] + [(None, "n", text()) for _ in range(150)] + [(9, "m", text()) for _ in range(150)]
    rows += [(2 ** 62, "far", text()), (-2 ** 63, "low", text()), (2 ** 63 - 1, "high", "")]
    folder = f"{tmp_path}/plain"  # no scheme: the cluster's default file system
    manifest = write_warc(pages(rows).repartition(3), folder, shard_bytes=100_000, roll_bytes=20_000)
    files = manifest.collect()
    shards = {}
    for r in files:
        shards.setdefault(r["shard"], []).append(r)
    assert sorted(shards) == list(range(len(shards))) and len(shards) >= 11
    assert all(sum(r["records"] for r in x) <= 41 for x in shards.values())  # 2,512 bytes each
    for x in shards.values():
        x.sort(key=lambda r: r["seq"])
        assert len(x) > 1 or x[0]["shard"] == len(shards) - 1
        assert all(20_000 <= r["bytes"] < 24_000 for r in x[:-1])
    back = read_warc(manifest, folder)
    assert back.rdd.getNumPartitions() == len(files)
    got = [(r["page_id"], r["payload"].decode(), r["digest_ok"]) for r in back.collect()]
    assert sorted(got, key=repr) == sorted(((i, t, True) for i, _, t in rows), key=repr)


def test_sort_key_sorts_as_ids_and_digests(spark):
    rows = [(i, bytes([b]) * 20) for i in (None, -2 ** 63, -1, 0, 1, 2 ** 62, 2 ** 63 - 1) for b in (0, 9, 160, 255)]
    df = spark.createDataFrame(rows, "page_id long, sha1 binary")
    keys = [r[0] for r in df.select(sort_key(F.col("page_id"), F.col("sha1"))).collect()]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)


def test_empty_table(spark, pages, tmp_path):
    folder = f"file://{tmp_path}/e"
    manifest = write_warc(pages([]), folder)
    assert manifest.count() == 0 and read_warc(manifest, folder).count() == 0
