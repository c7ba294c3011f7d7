"""The paged source in batch and stream, partition overwrite, and the order of Chinese names."""

import json
import os

import pytest
from pyspark.sql import functions as F

from brightledger.operators import overview, upsert
from brightledger.sources import paged


def save(folder, source, page, ids):
    os.makedirs(f"{folder}/{source}", exist_ok=True)
    rows = [{"bulletinId": i, "securityCode": "600000", "securityName": "浦发银行", "title": f"<em>年报</em>{i}", "sseDate": "2025-03-01", "url": "u"} for i in ids]
    if source == "bse":
        rows = [{"disclosureId": i, "companyCd": "830000", "companyName": "某", "disclosureTitle": i, "publishDate": "2025-03-01", "destFilePath": "u"} for i in ids]
    with open(f"{folder}/{source}/{page}.json", "w") as f:
        json.dump({"list" if source == "bse" else "result": rows}, f)


def read(spark, folder, sources, **options):
    paged.register(spark)
    return spark.read.format("announcement_pages").options(url=f"file://{folder}/{{source}}/{{page}}.json", sources=sources, **options).load()


@pytest.mark.parametrize(
    ("pages", "cap", "want", "ids"),
    [
        ([["a", "b"], ["c"], []], 8, (3, True, None), "abc"), ([["a", "b"], ["b", "a"], ["c"]], 8, (2, False, "repeated page"), "ab"), ([["a"], ["b"], ["c"]], 2, (2, False, "page cap"), "ab"),
        ([["a"]], 8, (1, False, "page 2 failed"), "a"), ([[]], 8, (0, True, None), ""), ([["a"], ["a", "b"], []], 8, (2, True, None), "ab"), ([], 8, (0, False, "page 1 failed"), ""),
    ],
)
def test_paging(spark, tmp_path, pages, cap, want, ids):
    for n, own in enumerate(pages):
        save(tmp_path, "sse", n + 1, own)
    found = read(spark, tmp_path, "sse", max_pages=str(cap))
    assert [tuple(r)[1:] for r in paged.coverage(found).collect()] == [want]
    rows = paged.announcements(found).collect()
    assert sorted(r["source_id"] for r in rows) == sorted(ids) and all(r["title"] == f"年报{r['source_id']}" and r["published_at"] is not None for r in rows)


def test_sources_and_bad_pages(spark, tmp_path):
    save(tmp_path, "sse", 1, ["a"])
    save(tmp_path, "sse", 2, [])
    save(tmp_path, "bse", 1, ["x"])
    (tmp_path / "bse" / "2.json").write_text("{broken")
    found = read(spark, tmp_path, "sse,bse")
    assert {tuple(r) for r in paged.coverage(found).collect()} == {("sse", 1, True, None), ("bse", 1, False, "page 2 failed")}
    assert {(r["source"], r["source_id"], r["code"]) for r in paged.announcements(found).collect()} == {("sse", "a", "600000"), ("bse", "x", "830000")}
    with pytest.raises(Exception, match="unknown sources"):
        read(spark, tmp_path, "nyse").collect()


def test_stream_goes_on_after_a_stop(spark, tmp_path):
    paged.register(spark)
    out, at = f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint"

    def run():
        pages = spark.readStream.format("announcement_pages").options(url=f"file://{tmp_path}/in/{{source}}/{{page}}.json", sources="sse,bse").load()
        rows = paged.parsed(pages, ["sse", "bse"])
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
        return sorted(r["source_id"] for r in spark.read.parquet(out).collect())

    save(tmp_path / "in", "sse", 1, ["a", "b"])
    save(tmp_path / "in", "bse", 1, ["x"])
    assert run() == ["a", "b", "x"]
    save(tmp_path / "in", "sse", 2, ["c"])
    assert run() == ["a", "b", "c", "x"] and run() == ["a", "b", "c", "x"]


def test_only_touched_parts_are_written(spark, tmp_path):
    path = f"file://{tmp_path}/chunks"
    rows = spark.range(40).select((F.col("id") % 20).cast("string").alias("report"), F.col("id").cast("int").alias("page"), F.lit("old").alias("content"))
    upsert.store_children(rows, path, "report", parts=8)
    files = lambda: {f: (os.stat(f).st_mtime_ns, os.stat(f).st_ino) for d, _, names in os.walk(tmp_path / "chunks") for n in names if n.endswith(".parquet") for f in [f"{d}/{n}"]}
    before = files()
    new = spark.createDataFrame([("3", 1, "new"), ("99", 1, "new")], "report string, page int, content string")
    upsert.store_children(new, path, "report", parts=8)
    want = sorted(tuple(r) for r in upsert.replace_children(rows, new, "report").collect())
    got = sorted(tuple(r) for r in spark.read.parquet(path).select("report", "page", "content").collect())
    after = files()
    kept = [f for f in before if after.get(f) == before[f]]
    assert got == want and kept and len({os.path.dirname(f) for f in before} - {os.path.dirname(f) for f in kept}) <= 2
    assert not os.path.exists(tmp_path / "chunks.new")


def test_chinese_order(spark):
    names = ["中国平安", "招商银行", "阿里", "贵州茅台", "比亚迪", None, "平安银行", "平安"]
    cards = spark.createDataFrame([(str(i), n) for i, n in enumerate(names)], "code string, name string")
    assert [r["name"] for r in overview.by_name(cards).collect()] == ["阿里", "比亚迪", "贵州茅台", "平安", "平安银行", "招商银行", "中国平安", None]
