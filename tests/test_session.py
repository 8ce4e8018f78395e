import pytest

from kgloom.operators.session import DatasetPin, ResultCache, with_retries
from kgloom.sources import crawlers
from kgloom.streaming.pipelines import run_once


def test_cache_expires_and_drops_the_first_inserted():
    now = [0.0]
    c = ResultCache(ttl=10, most=2, clock=lambda: now[0])
    c.put("a", 1)
    c.put("b", 2)
    assert c.get("a") == 1
    c.put("c", 3)
    assert c.get("a") is None and c.get("b") == 2
    now[0] = 11
    assert c.get("b") is None


def test_retries_only_what_is_transient():
    waits, left = [], [2]

    def call():
        left[0] -= 1
        if left[0] >= 0:
            raise TimeoutError
        return "ok"

    assert with_retries(call, (TimeoutError,), sleep=waits.append) == "ok" and waits == [0.5, 1.0]
    with pytest.raises(KeyError):
        with_retries(lambda: {}["x"], (TimeoutError,))


def test_a_pin_lasts_three_turns():
    p = DatasetPin()
    p.choose("sales")
    assert [p.current() for _ in range(4)] == ["sales"] * 3 + [None]


def test_a_crawl_continues_where_it_stopped(spark, tmp_path):
    crawlers.register(spark)
    root, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    root.mkdir()
    (root / "a.txt").write_text("1")
    stream = lambda: spark.readStream.format("folder_crawl").option("root", str(root)).load()
    w = lambda: stream().writeStream.option("checkpointLocation", ck).format("parquet").option("path", out).trigger(once=True).start().awaitTermination()
    w()
    (root / "b.txt").write_text("22")
    w()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["a.txt", "b.txt"]
    assert callable(run_once)


def put_page(root, folder, token, names, **more):
    import json

    (root / folder).mkdir(exist_ok=True)
    (root / folder / f"{token}.json").write_text(json.dumps({"value": [{"id": f"{folder}/{n}", "name": n, "size": 1} for n in names], **more}))


def test_a_listing_in_pages_goes_on_where_each_folder_stopped(spark, tmp_path):
    crawlers.register(spark)
    root, out, ck = tmp_path / "pages", str(tmp_path / "out"), str(tmp_path / "ck")
    root.mkdir()
    run = lambda: run_once(spark.readStream.format("paged_listing").option("root", str(root)).load(), out, ck)
    found = lambda: sorted(r.id for r in spark.read.parquet(out).collect())
    put_page(root, "a", 0, ["1", "2"], next="1")
    put_page(root, "a", 1, ["3"], delta="2")
    put_page(root, "b", 0, ["1"], next="1")
    (root / "b" / "1.json").write_text('{"error": 503}')
    run()
    assert found() == ["a/1", "a/2", "a/3", "b/1"]
    run()  # nothing new
    put_page(root, "b", 1, ["2"], next="2")  # the failed page can be read now
    put_page(root, "b", 2, ["3"], delta="3")
    put_page(root, "a", 2, ["4"], delta="3")  # a change after the delta token
    put_page(root, "c", 0, ["1"])
    run()
    run()
    assert found() == ["a/1", "a/2", "a/3", "a/4", "b/1", "b/2", "b/3", "c/1"]


def test_pages_without_a_token_are_left_for_later(tmp_path):
    put_page(tmp_path, "a", 0, ["1"], next="1")
    r = crawlers.PageStreamReader({"root": str(tmp_path)})
    end = r.latestOffset()
    assert end == {"next": {"a": "1"}}
    (part,) = r.partitions(r.initialOffset(), end)
    assert [x[0] for x in r.read(part)] == ["a/1"] and r.partitions(end, end) == []
