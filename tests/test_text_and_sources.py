from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.functions.listing import is_usable, listing_id, unit_price
from marlstone.operators import gold, series
from marlstone.sources import listings as src


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_numbers(spark):
    values = ["12", " 3,5 tỷ", "1.234.5", "-7", "nan", "Không xác định", "n/a", "abc", "", None, "5.2m"]
    assert column(spark, values, tx.to_number) == [12, 3.5, 1234.5, -7, None, None, None, None, None, None, 5.2]
    assert column(spark, ["2mm", "về 10,5 m", "không"], tx.first_number) == [2.0, 10.5, None]


def test_names(spark):
    values = ["Thành phố Hồ Chí Minh", "TP.HCM", "Q. 1", "Quận Bình Thạnh", "Đắk Lắk", "Huế", "TT. Củ Chi"]
    assert column(spark, values, tx.norm_text) == ["thanh pho ho chi minh", "ho chi minh", "quan 1", "quan binh thanh", "dak lak", "hue", "thi tran cu chi"]
    short = {"Q7": "quan 7", "q.7": "quan 7", "Saigon": "ho chi minh", "tpvinh": "thanh pho vinh", "Q. Bình Thạnh": "quan binh thanh", "H. Nhà Bè": "huyen nha be", "P. Đa Kao": "phuong da kao", "P.1": "phuong 1", "p 12": "phuong 12", "X. Tân Nhựt": "xa tan nhut", "T.P. Vinh": "thanh pho vinh", "TP-HCM": "ho chi minh", "hn": "ha noi"}
    assert column(spark, list(short), tx.norm_text) == list(short.values())
    assert column(spark, ["Quận Bình Thạnh", "Thị xã Thuận An", "Xã Tân Nhựt"], tx.core_name) == ["binh thanh", "thuan an", "tan nhut"]
    assert column(spark, ["Phường Đa Kao"], tx.key_name) == ["phuongdakao"]
    assert column(spark, [" a ", "NaN", "", None], tx.to_text) == ["a", None, None, None]
    assert column(spark, ["---", "n/a", "_", " x "], tx.clean) == [None, None, None, "x"]
    assert column(spark, ["12 A, B; C / D,, "], tx.tokens) == [["D", "C", "B", "12 A"]]
    assert column(spark, ["<b>a</b>&nbsp;&amp;&lt;\n x"], tx.html_text) == ["a &< x"]


def test_ids_and_unit_prices(spark):
    rows = spark.createDataFrame([(2.0, 50.0), (None, 50.0), (2.0, 0.0), (0.0, 5.0)], "price double, area double")
    assert [r[0] for r in rows.select(unit_price(F.col("price"), F.col("area"))).collect()] == [40.0, None, None, None]
    ids = [r[0] for r in rows.select(listing_id("s", F.col("price"), F.col("area"))).collect()]
    assert len(set(ids)) == 4 and all(i.startswith("s_") and len(i) == 18 for i in ids)
    some = spark.createDataFrame([(50.0, 2.0, "x", None), (50.0, 2.0, None, None), (4.0, 2.0, "x", None), (50.0, None, "x", None)], "area double, price double, address_raw string, district_raw string")
    assert [r[0] for r in some.select(is_usable()).collect()] == [True, False, False, False]


def test_columns_are_found_by_alias(spark):
    df = spark.createDataFrame([("12 A, Q1", "45,5", "3.2", "3")], ["Địa chỉ", "Diện tích", "Giá", "Bedrooms"])
    assert src.resolve_columns(df.columns) == {"address_raw": "Địa chỉ", "area": "Diện tích", "price": "Giá", "bedrooms": "Bedrooms"}
    row = src.from_tabular(df.union(df)).collect()
    assert [n for n, _ in src.CANONICAL] == list(row[0].asDict()) and row[0].listing_id != row[1].listing_id
    assert (row[0].area, row[0].price, row[0].price_per_m2, row[0].crawled_at) == (45.5, 3.2, round(3200 / 45.5, 4), None)
    r = src.profile(src.canonical_select(df)).where("field = 'area'").first()
    assert (r.n_null, r.min, r.max) == (0, 45.5, 45.5)


def test_api_records(spark):
    fields = "list_id long, price long, size double, property_width double, property_road_width double, floors int, rooms int, toilets int, direction string, property_legal_document string, furnishing_status string, region_name string, area_name string, ward_name string, address string"
    df = spark.createDataFrame([(7, 3_500_000_000, 50.0, None, None, 2, 3, 2, None, None, None, "HCM", "Quận 1", None, "x")], fields)
    r = src.from_api(df, "2025-01-01").first()
    assert (r.listing_id, r.price, r.address_raw, r.price_per_m2, r.crawled_at) == ("api_7", 3.5, "Quận 1, HCM", 70.0, "2025-01-01")


def log_rows(spark, values, first=0):
    rows = [("t", 0, first + i, datetime(2025, 1, 1), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "topic string, partition int, offset long, timestamp timestamp, value string")


def test_good_and_bad_records(spark):
    log = log_rows(spark, ['{"listing_id":"a","price":2.5}', "broken", '{"price":1}', '{"listing_id":"b"}'])
    good, bad = src.decode_events(log)
    assert [r.listing_id for r in good.orderBy("offset").collect()] == ["a", "b"] and bad.count() == 2
    stamped = src.stamp(good, datetime(2025, 1, 2, 3))
    assert {(str(r.ingest_date), str(r.ingested_at)) for r in stamped.collect()} == {("2025-01-02", "2025-01-02 03:00:00")}


LIST_PAGE = """<div><a itemprop="url" href="/ban-nha-123456.html"><span itemprop="price" content="7000000000">7 ty</span>
<span itemprop="floorSize">28 m2</span><span itemprop="numberOfBedrooms">5</span><span itemprop="streetWidth">2mm</span>
<time itemprop="datePosted" datetime="2025-08-14">x</time><span itemprop="address">12 A, <b>Q1</b></span></a>
<a itemprop="url" href="/ban-nha-abc.html"><span itemprop="price" content="9900000000"></span><span itemprop="floorSize">46</span>
<span class="ct_date">Ngay: 02/09/2025</span></a><a itemprop="url" href="/none.html">no price</a></div>"""
DETAIL = "<table><tr><td>Pháp lý:</td><td>Sổ hồng/ Sổ đỏ</td></tr><tr><td>Chiều ngang</td><td>7m</td></tr><tr><td>Hướng</td><td>---</td></tr></table>"


def test_pages(spark):
    pages = spark.createDataFrame([(1, LIST_PAGE), (2, "<html>error</html>"), (3, LIST_PAGE), (4, None)], "page_id long, html string")
    rows = src.first_seen(src.listing_fields(src.explode_blocks(pages))).orderBy("pos").collect()
    a, b = rows
    assert (a.price, a.area, a.bedrooms, a.access_road, a.price_per_m2, a.posted_on, a.address_raw, a.page_id) == (7.0, 28.0, 5.0, 2.0, 250.0, date(2025, 8, 14), "12 A, Q1", 1)
    assert (b.price, b.area, b.bedrooms, b.posted_on) == (9.9, 46.0, None, date(2025, 9, 2))
    d = src.detail_fields(spark.createDataFrame([(1, DETAIL)], "page_id long, html string")).first()
    assert (d.legal_status, d.frontage, d.house_direction) == ("Sổ hồng/ Sổ đỏ", 7.0, None)


def test_series_files(spark, tmp_path):
    (tmp_path / "wide.csv").write_text("Date,District 1,Quan 2\n" + "".join(f"{m}/15/2020,{100 + m},{50 + m}\n" for m in range(1, 13)))
    (tmp_path / "long.csv").write_text("date,district,price\n" + "".join(f"2021-0{m}-01,District 7,\"{m},5\"\n" for m in range(1, 5)))
    (tmp_path / "sample_x.csv").write_text("Date,District 1,Quan 2\n1/1/1999,1,2\n1/2/1999,1,2\n1/3/1999,1,2\n")
    (tmp_path / "other.csv").write_text("a,b\n1,2\n")
    rows = series.read_series_dir(spark, str(tmp_path)).collect()
    assert len(rows) == 28 and {r.area_code for r in rows} == {"760", "769_Q2", "HCM_District7"}
    assert next(r.price_m2 for r in rows if r.ds == date(2021, 2, 1)) == 2.5
    day_first = spark.createDataFrame([(f"{d}/3/2020",) for d in (13, 14, 15)], "d string")
    assert [r.ds for r in series.parse_dates(day_first, "d").orderBy("ds").collect()] == [date(2020, 3, d) for d in (13, 14, 15)]
    assert series.is_series(day_first, "d") and not series.is_series(spark.createDataFrame([("x",)], "d string"), "d")
    (tmp_path / "index.csv").write_text("area_code,area_name,ds,price_m2\nVN,x,2020-01-01,5\n")
    assert series.read_index(spark, f"{tmp_path}/index.csv").first().source == "bds_index"
    assert series.read_index(spark, f"{tmp_path}/other.csv") is None
    with pytest.raises(ValueError):
        series.wide_to_long(day_first, "d", "x")


def test_series_files_of_all_kinds_in_one_plan(spark, tmp_path):
    """500 files with four headers: columns match by what they contain, and the number of jobs does not grow with the files."""
    heads = ["Report_Date,Quận 1,Q.3,quan 12", "date,price_m2,area_name", "Thang,Gia,Region", "x,Month of report,Index value"]
    for i in range(500):
        k = i % 4
        body = [f"{m}/15/{1900 + i % 100},{i + m},{m},7" if k == 0 else f"{1900 + i % 100}-{m:02d}-01,\"{i + m} tr\",Khu {i}" if k == 1 else f"1/{m}/{1900 + i % 100},{i + m},Bến {i}" if k == 2 else f"a,{1900 + i % 100}/{m}/1,{i}" for m in range(1, 6)]
        (tmp_path / f"f{i}.csv").write_text("\n".join([heads[k], *body]) + "\n", encoding="utf-8-sig" if i % 3 == 0 else "utf-8")
    (tmp_path / "no_dates.csv").write_text("update,price\nx,1\ny,2\nz,3\n")
    (tmp_path / "no_price.csv").write_text("date,words\n2020-01-01,1\n2020-02-01,2\n2020-03-01,3\n")
    (tmp_path / "empty.csv").write_text("")
    sc = spark.sparkContext
    jobs = {}
    for many in (20, 502):
        glob = f"{tmp_path}/f1*.csv" if many == 20 else str(tmp_path)
        sc.setJobGroup(f"series-{many}", "")
        rows = series.read_series_dir(spark, glob).collect()
        jobs[many] = len(sc.statusTracker().getJobIdsForGroup(f"series-{many}"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[502] <= jobs[20] + 3
    assert {r.area_code for r in rows if r.area_code.startswith("7")} == {"760", "770"} and {r.area_name for r in rows if r.area_code == "HCM_D12"} == {"Quận 12"}
    of = lambda code: sorted((r.ds, r.price_m2) for r in rows if r.area_code == code)
    assert of("HCM_Khu5") == [(date(1905, m, 1), 5.0 + m) for m in range(1, 6)]
    assert of("HCM_Bến6") == [(date(1906, 1, m), 6.0 + m) for m in range(1, 6)]  # as many dates either way: months first
    assert {r.area_name for r in rows if r.area_code == "HCM_TPHồChíMinh"} == {"TP. Hồ Chí Minh"}
    told = {r.file.rsplit("/", 1)[1]: r.kind for r in series.series_files(series.series_rows(spark, str(tmp_path))).collect()}
    assert (told["f0.csv"], told["f1.csv"], told["no_dates.csv"], told["no_price.csv"]) == ("wide", "long", "no dates", "no price") and len(told) == 502


def test_titles_in_any_spelling(spark):
    states = ["Sổ đỏ", "Sổ hồng", "Sổ hồng/ Sổ đỏ", "sodo", "SỔ HỒNG", "Have certificate", "pink book", "Chưa sổ", "No certificate", "x", "", " ", None]
    rows = spark.createDataFrame([(x,) for x in states], "legal_status string")
    assert [r[0] for r in rows.select(gold.red_book()).collect()] == [1.0] * 7 + [0.0] * 3 + [None] * 3


def test_units_before_a_full_stop(spark):
    rows = spark.createDataFrame([("TT.Nhà Bè, TP.HCM",), ("TT Nhà Bè",), ("TT. Nhà Bè",), ("TX.Thuận An",), ("tx Thuận An",), ("att. x",)], "a string")
    assert [r[0] for r in rows.select(tx.norm_text(F.col("a"))).collect()] == ["thi tran nha be ho chi minh", "thi tran nha be", "thi tran nha be", "thi xa thuan an", "thi xa thuan an", "att x"]


def test_blocks_without_a_field(spark):
    """What is not in a block is neither searched by expressions nor parsed."""
    block = '<a itemprop="url" href="/x-1234567.html"><span itemprop="price" content="2000000000"></span><i itemprop="floorSize">50 m2</i>'
    dates = ["", '<i itemprop="datePosted">no day</i>', '<b class="ct_date">3/2/2024</b>', '<i itemprop="datePosted">Ngay: 04/02/2024</i>']
    rows = spark.createDataFrame([("p", i, block + d + "</a>") for i, d in enumerate(dates)], "page_id string, pos int, block string")
    found = src.listing_fields(rows)
    assert "CASE WHEN Contains" in found._jdf.queryExecution().optimizedPlan().toString()
    got = [(r.price, r.area, r.floors, r.address_raw, str(r.posted_on)) for r in found.orderBy("pos").collect()]
    assert got == [(2.0, 50.0, None, None, d) for d in ("None", "None", "2024-02-03", "2024-02-04")]
