"""Readers, writers, retrieval and streams."""

import json

import pytest
from pyspark.sql import functions as F

from quillmart.operators import leads, retrieval
from quillmart.operators.checks import InputError
from quillmart.sources import readers, writers
from quillmart.sources.snapshots import Snapshots
from quillmart.streaming import windows


def test_csv_in_mixed_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("역,수\n서울,1\n".encode())
    (tmp_path / "b.csv").write_bytes("역,수\n부산,2\n".encode("cp949"))
    (tmp_path / "c.csv").write_bytes("역,수\n대전,3\n".encode("utf-8-sig"))
    got = readers.csv_any_encoding(spark, f"{tmp_path}/*.csv", "station string, n int")
    assert sorted((r.station, r.n) for r in got.collect()) == [("대전", 3), ("부산", 2), ("서울", 1)]


def test_registry_and_csv_sink(spark, tmp_path):
    df = spark.createDataFrame([("가게", "127.1", "x")], "`상호명` string, lon string, `기타` string")
    writers.csv_with_mark(df, f"{tmp_path}/out")
    data = next(p for p in (tmp_path / "out").iterdir() if p.suffix == ".csv").read_bytes()
    assert data.startswith(b"\xef\xbb\xbf")
    (tmp_path / "r.csv").write_text("상호명,경도,버림\n가게,127.1,1\n둘,동경,1\n")
    got = readers.registry(spark, f"{tmp_path}/r.csv", {"상호명": "name", "경도": "lon"}).collect()
    assert [(r.name, r.lon) for r in got] == [("가게", 127.1), ("둘", None)]
    with pytest.raises(InputError):
        readers.registry(spark, f"{tmp_path}/r.csv", {"없음": "x"})


def test_weather(spark, tmp_path):
    rows = [("1", "2024-01-02T03:00:00", "+0105,1", "+9999,1", "010,1,N,0030,1", "016000,1", "10132,9", "01,0050,9,1", "06,0100,9,1", None), ("1", "2024-01-02T10:00:00", "+0205,2", "-0010,1", "010,1,N,9999,1", "999999,1", "10132,1", None, None, None), ("2", "2024-01-02T10:00:00", *["+0001,1"] * 8)]
    df = spark.createDataFrame(rows, "STATION string, DATE string, TMP string, DEW string, WND string, VIS string, SLP string, AA1 string, AA2 string, AA3 string")
    got = {str(r.day): r for r in readers.daily_weather(df, 1, "2024-01-01", "2024-01-31").collect()}
    assert got["2024-01-01"].temperature == 10.5
    assert (got["2024-01-01"].rain, got["2024-01-01"].wind, got["2024-01-01"].pressure) == (5.0, 3.0, None)
    assert (got["2024-01-02"].temperature, got["2024-01-02"].dew_point, got["2024-01-02"].rain) == (None, -1.0, None)
    (tmp_path / "w.txt").write_text("# head\n20240101,108,-9.0,3.5\n\n")
    r = readers.station_lines(spark, f"{tmp_path}/w.txt", {"day": 0, "station": 1, "rain": 2, "wind": 3}).first()
    assert (r.day, r.station, r.rain, r.wind) == ("20240101", "108", None, 3.5)


def test_rows_in_nested_answers():
    assert readers.find_rows({"response": {"body": {"items": {"item": [{"a": 1}]}}}}) == [{"a": 1}]
    assert readers.find_rows({"response": {"items": {"item": {"a": 1}}}}) == [{"a": 1}]
    assert readers.find_rows({"status": "none"}) == []


def test_paged_service(spark, tmp_path):
    for q, pages in {"20241": [2, 1], "20242": [0]}.items():
        for i, n in enumerate(pages, 1):
            (tmp_path / f"{q}-{i}.json").write_text(json.dumps({"row": [{"A": i * 10 + k, "B": None} for k in range(n)]}))
    spark.dataSource.register(readers.Paged)
    df = spark.read.format("paged").schema("A string, B string").option("url", f"file://{tmp_path}/{{quarter}}-{{page}}.json").option("pagesize", "2").option("quarters", "20241,20242").load()
    assert df.rdd.getNumPartitions() == 2
    assert sorted((r.A, r.B) for r in df.collect()) == [("10", None), ("11", None), ("20", None)]
    one = spark.read.format("paged").schema("A string").option("url", f"file://{tmp_path}/{{quarter}}-{{page}}.json").option("pagesize", "2").option("quarters", "20241,20242").option("parallel", "1").load()
    assert one.rdd.getNumPartitions() == 1
    assert one.count() == 3


def test_newest_quarter_is_always_fetched(spark, tmp_path):
    asked = []

    def fetch(quarters):
        asked.append(quarters)
        return spark.createDataFrame([(q, len(asked)) for q in quarters if q != 20242], "quarter int, v int")

    read = lambda *quarters: sorted(tuple(r) for r in readers.cached_quarters(spark, f"{tmp_path}/cache", list(quarters), fetch).collect())
    assert read(20241, 20242, 20243) == [(20241, 1), (20243, 1)]
    assert read(20241, 20242, 20243) == [(20241, 1), (20243, 2)]
    assert read(20241, 20243, 20244) == [(20241, 1), (20243, 3), (20244, 3)]
    assert asked == [[20241, 20242, 20243], [20243], [20243, 20244]]


def test_services_have_types(spark):
    raw = spark.createDataFrame([("20241", " 7 ", "12.5", "x")], "STDR_YYQU_CD string, TRDAR_CD string, TOT_FLPOP_CO string, more string")
    assert [tuple(r) for r in readers.service_rows(raw, "foot_traffic").collect()] == [(20241, 7, 12.5)]
    raw = spark.createDataFrame([("2024-03-01 00:00:00.0", "20240302", "a"), (None, "soon", None)], "strtdate string, END_DATE string, TITLE string")
    got = readers.service_rows(raw, "events").collect()
    assert [(str(r.start), str(r.end), r.name, r.lat) for r in got] == [("2024-03-01", "2024-03-02", "a", None), ("None", "None", None, None)]
    for service in readers.SERVICES:
        assert readers.service_rows(spark.createDataFrame([], readers.service_schema(service)), service).count() == 0


def test_xml_rows(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<answer><n>2</n><row><A>1</A><B>x</B></row><row><A>2</A></row></answer>")
    got = readers.xml_rows(spark, f"{tmp_path}/a.xml", "row", "A int, B string").collect()
    assert sorted((r.A, r.B) for r in got) == [(1, "x"), (2, None)]


def test_passages_need_their_vectors(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "id long, text string")
    rows.write.json(f"{tmp_path}/c")
    spark.createDataFrame([(1, [1.0])], "id long, v array<float>").write.parquet(f"{tmp_path}/v")
    with pytest.raises(InputError):
        readers.passages(spark, f"{tmp_path}/c", f"{tmp_path}/v", "id")


def test_receipts_get_running_ids(spark, tmp_path):
    heads = spark.createDataFrame([("i1", 2.0), ("i2", 1.0)], "image string, total double")
    items = spark.createDataFrame([("i1", "a"), ("i2", "b"), ("i2", "c")], "image string, item string")
    store = Snapshots(spark, f"{tmp_path}/s")
    for _ in range(2):
        writers.append_receipts(heads, items, store, ["total"])
    got = store.read("receipts").orderBy("receipt").collect()
    assert [(r.receipt, r.image) for r in got] == [(1, "i2"), (2, "i1"), (3, "i2"), (4, "i1")]
    assert store.read("items").where("receipt = 3").count() == 2 and store.version().number == 2


def test_idempotent_inserts_and_upserts(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    store = Snapshots(spark, f"{tmp_path}/s")
    assert [writers.insert_new(rows, store, "t", ["k"]) for _ in range(2)] == [2, 0]
    newer = spark.createDataFrame([(2, "z")], "k int, v string")
    assert sorted((r.k, r.v) for r in writers.upsert_into(newer, store, "t", ["k"]).collect()) == [(1, "a"), (2, "z")]
    v = spark.createDataFrame([("m", 1, "promoted"), ("m", 2, "promoted"), ("m", 3, "rolled_back")], "model string, version int, status string")
    assert writers.promoted(v).first().version == 2


def test_writers_take_turns(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    heads = spark.createDataFrame([("i1", 2.0), ("i2", 1.0)], "image string, total double")
    items = spark.createDataFrame([("i1", "a")], "image string, item string")
    own = lambda: Snapshots(spark, f"{tmp_path}/s")
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda _: writers.append_receipts(heads, items, own(), ["total"]), range(3)))
    assert sorted(r.receipt for r in own().read("receipts").collect()) == [1, 2, 3, 4, 5, 6]
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda k: writers.upsert_into(spark.createDataFrame([(k, "x"), (9, str(k))], "k int, v string"), own(), "t", ["k"]), range(3)))
    assert sorted(r.k for r in own().read("t").collect()) == [0, 1, 2, 9]
    assert own().version().number == 6


def test_grounding(spark):
    out = spark.createDataFrame([("a", "매출 12% 증가 [d1]. 요약 끝. 안내"), ("b", "매출 13% [d9]. 요약"), ("c", "요약 없음안내")], "k string, text string")
    allowed = spark.createDataFrame([("a", "12 %", "d1"), ("b", "12%", "d1")], "k string, value string, doc string")
    got = {r.k: r for r in retrieval.grounded(out, allowed, "k", "text", ["요약"], ("안내", "없음안내")).collect()}
    assert got["a"].ok
    assert (got["b"].wrong_figures, got["b"].wrong_sources, got["b"].ok) == (["13%"], ["d9"], False)
    assert got["c"].ok


def test_figures_keep_their_context(spark):
    p = spark.createDataFrame([(1, "앞 문장. 매출이 12% 늘었다. 뒤 문장! 끝.")], "k int, text string")
    r = retrieval.figure_contexts(p, "k", "text").first()
    assert (r.value, r.focus, r.context) == ("12%", "매출이 12% 늘었다.", "앞 문장. 매출이 12% 늘었다. 뒤 문장!")


def test_trades_and_cities(spark):
    df = spark.createDataFrame([("커피점/카페",), (" 서점 ",), ("",), (None,)], "t string")
    assert [r.g for r in df.select(leads.industry_group(F.col("t")).alias("g")).collect()] == ["카페/베이커리", "서점", "__unknown__", "__unknown__"]
    assert spark.range(1).select(leads.city_part(F.lit("서울 마포구 양화로")).alias("c")).first().c == "마포구"


def test_arm_statistics_take_a_batch_once(spark):
    keep = windows.ArmStatistics(spark, ["x"])
    batch = spark.createDataFrame([("a", 1.0, 0.5)], "arm string, reward double, x double")
    for number in (0, 0, 1):
        keep(batch, number)
    assert keep.total().first().n == 2
