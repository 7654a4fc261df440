import pytest
from pyspark.sql import functions as F

from marlstone.operators import geo

TREE = [
    ("79", "Thành phố Hồ Chí Minh", [
        ("760", "Quận 1", [("26734", "Phường Tân Định"), ("26740", "Phường Bến Nghé")]), ("771", "Quận 10", [("27163", "Phường 15")]), ("772", "Quận 11", [("27208", "Phường 5")]),
        ("761", "Quận 12", [("26764", "Phường Thạnh Xuân")]), ("765", "Quận Bình Thạnh", [("26905", "Phường 13")]), ("769", "Thành phố Thủ Đức", [("26794", "Phường Linh Xuân")]),
    ]),
    ("01", "Thành phố Hà Nội", [("001", "Quận Ba Đình", [("00001", "Phường Phúc Xá")]), ("017", "Huyện Đông Anh", [("00454", "Xã Xuân Nộn")])]),
    ("74", "Tỉnh Bình Dương", [("725", "Thành phố Thuận An", [("25963", "Phường An Thạnh")])]),
]
SCHEMA = "code string, name string, districts array<struct<code: string, name: string, wards: array<struct<code: string, name: string>>>>"


@pytest.fixture(scope="module")
def dims(spark):
    return geo.flatten_units(spark.createDataFrame(TREE, SCHEMA))


def resolve(spark, dims, addresses, bridge=None, **hints):
    rows = [(i, a, hints.get("province"), None, None) for i, a in enumerate(addresses)]
    df = spark.createDataFrame(rows, "i int, address_raw string, province_raw string, district_raw string, ward_raw string")
    return geo.resolve_addresses(df, dims, bridge).orderBy("i").collect()


def test_spellings_of_one_district(spark, dims):
    rows = resolve(spark, dims, ["12 Lê Lợi, Phường Bến Nghé, Quận 1, TP.HCM", "quan 1, ho chi minh", "Q1; Quận 1; Hồ Chí Minh", "Quận 1 / Sài Gòn", "q 1, tphcm"])
    assert {(r.province_code, r.district_code, r.geo_source) for r in rows} == {("79", "760", "old")}
    assert (rows[0].ward_code, rows[0].geo_match_score) == ("26740", 100.0)


def test_abbreviated_units(spark, dims):
    rows = resolve(spark, dims, ["Q10, TP.HCM", "P.1, TP.HCM", "p 10, tphcm", "Q. Bình Thạnh, saigon", "H. Đông Anh, hn", "P. Bến Nghé, Q.1, SG"])
    assert [r.district_code for r in rows] == ["771", None, None, "765", "017", "760"]
    assert [r.province_code for r in rows] == ["79", "79", "79", "79", "01", "79"] and rows[5].ward_code == "26740"


def test_names_of_eight_letters_and_of_many_words(spark):
    long = "Khu Bao Ton Thien Nhien Vung Nui Cao"
    tree = [("01", "Tỉnh A Bê", [("001", "Quận Binhthanh", [("00001", "Phường " + long)])])]
    small = geo.flatten_units(spark.createDataFrame(tree, SCHEMA))
    rows = resolve(spark, small, ["Quận Binhtanh, A Bê", f"{long}, Binhthanh, A Bê"])
    assert [r.district_code for r in rows] == ["001", "001"] and rows[1].ward_code == "00001"
    assert small.most_words == 8


def test_units_in_either_layout(spark, tmp_path):
    import json

    first = [{"code": c, "name": n, "districts": [{"code": d, "name": m, "wards": [{"code": w, "name": x} for w, x in ws]} for d, m, ws in ds]} for c, n, ds in TREE]
    second = [{"Id": c, "Name": n, "Districts": [{"Id": d, "Name": m, "Wards": [{"Id": w, "Name": x} for w, x in ws]} for d, m, ws in ds]} for c, n, ds in TREE]
    first[1]["code"], second[1]["Id"] = "1", "1"  # a code without its zero
    found = []
    for k, units in enumerate((first, second)):
        (tmp_path / f"{k}.json").write_text(json.dumps(units, ensure_ascii=False, indent=1))
        read = geo.read_units(spark, f"{tmp_path}/{k}.json")
        found.append([sorted(map(tuple, d.select("code", "name").collect())) for d in (read.provinces, read.districts, read.wards)])
    assert found[0] == found[1] and ("01", "Thành phố Hà Nội") in found[0][0] and len(found[0][2]) == 10


def test_numbers_are_whole_words(spark, dims):
    rows = resolve(spark, dims, ["Quận 1, TP.HCM", "Quận 10, TP.HCM", "Quận 11, TP.HCM", "Quận 12, TP.HCM"])
    assert [r.district_code for r in rows] == ["760", "771", "772", "761"]


def test_dissolved_unique_and_alike(spark, dims):
    rows = resolve(spark, dims, ["Quận 2, TP.HCM", "Quận 9, TP.HCM", "đường X, Quận Ba Đình", "Thuận Anh, Bình Dươnng", "P. 13, Q. Bình Thạnh, TP.HCM", "Phường 1, TP.HCM"])
    assert [(r.district_code, r.geo_source) for r in rows[:3]] == [("769", "dissolved"), ("769", "dissolved"), ("001", "unique")]
    assert (rows[2].province_code, rows[2].geo_match_score) == ("01", 90.0)
    assert rows[4].district_code == "765"
    assert (rows[5].province_code, rows[5].district_code) == ("79", None)  # a ward's number is no district


def test_near_spelling(spark, dims):
    r = resolve(spark, dims, ["Quận Binh Thanhh, Ho Chi Minh"])[0]
    assert r.district_code == "765" and 88 <= r.geo_match_score < 100


def test_bridge(spark, dims):
    bridge = spark.createDataFrame([("tphcm", "saigon", "79", "x", "760", "Quận 1", 0.75, 2), ("hanoi", "hoangmai", "01", "y", "001", "Quận Ba Đình", 1.0, 1)], "new_province_key string, new_ward_key string, province_code string, province string, district_code string, district string, confidence double, n_candidates int")
    rows = resolve(spark, dims, ["Phường Sài Gòn, Hồ Chí Minh", "Phường Hoàng Mai"], bridge)
    assert (rows[0].district_code, rows[0].geo_source, rows[0].geo_match_score) == ("760", "bridge2025", 75.0)
    assert (rows[1].province_code, rows[1].district_code) == ("01", "001")


def test_junk(spark, dims):
    rows = resolve(spark, dims, [None, "", "   ", "abc xyz 123", ",,,"])
    assert {(r.province_code, r.district_code, r.geo_match_score, r.geo_source) for r in rows} == {(None, None, 0.0, "none")}


def test_build_bridge_takes_the_majority(spark):
    moves = spark.createDataFrame([("p", "w", c) for c in ("1", "2", "3", "3", "9")], "new_province_key string, new_ward_key string, old_ward_code string")
    units = spark.createDataFrame([("1", "a", "A", "79", "X"), ("2", "a", "A", "79", "X"), ("3", "b", "B", "79", "X")], "ward_code string, district_code string, district string, province_code string, province string")
    r = geo.build_bridge(moves, units).first()
    assert (r.district_code, r.confidence, r.n_candidates) == ("a", 0.667, 2)


def test_no_python_on_the_path(spark, dims):
    plan = geo.resolve_addresses(spark.createDataFrame([("x",)], "address_raw string"), dims)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_near_spellings_of_short_names(spark):
    names = ["Quận 1", "Quận 11", "Quận 12", "Huyện Nhà Bè", "Huyện Củ Chi", "Huyện Hóc Môn", "Huyện Cần Giờ", "Thị xã Lái Thiêu", "Quận Bình Thạnh"]
    tree = [("79", "Thành phố Hồ Chí Minh", [(f"{700 + i}", n, []) for i, n in enumerate(names)])]
    dims = geo.flatten_units(spark.createDataFrame(tree, SCHEMA))
    asked = {"Huyện Nhà Bee": "703", "Hóc Monn": "705", "Củ Chii": "704", "Cn Giờ": "706", "Huyện Nhà B": "703", "Bình Thạch": "708", "Quận 1": "700", "Quận 11": "701", "Quận 13": None, "Quận 111": None, "Củ Khi": None, "Nhà": None}
    rows = spark.createDataFrame([(f"{a}, TP.HCM",) for a in asked], "address_raw string")
    got = {r.address_raw: (r.district_code, r.geo_match_score) for r in geo.resolve_addresses(rows, dims).collect()}
    assert {a: got[f"{a}, TP.HCM"][0] for a in asked} == asked
    ratio = lambda m, t: 200 * m / t
    assert got["Hóc Monn, TP.HCM"][1] == pytest.approx(ratio(7, 15)) and got["Huyện Nhà Bee, TP.HCM"][1] == pytest.approx(ratio(6, 13))


def test_letters_left_out_give_the_ratio(spark):
    """What two names share when up to one letter of each is left out is their longest common subsequence, if that is so long."""
    import random

    r = random.Random(3)
    names = ["".join(r.choice("abc ") for _ in range(r.randrange(4, 11))).strip() or "abcd" for _ in range(60)]
    pairs = [(a, b) for a in names for b in names]
    rows = spark.createDataFrame(pairs, "a string, b string").withColumns({"x": geo.spellings(F.col("a")), "y": geo.spellings(F.col("b"))})
    shared = rows.select("a", "b", F.array_max(F.transform(F.array_intersect("x", "y"), F.length)).alias("m")).collect()

    def common(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    for a, b, m in shared:
        near = common(a, b) >= max(len(a), len(b)) - 1 and min(len(a), len(b)) >= 4
        assert m == (common(a, b) if near else None), (a, b)


def test_bridge_is_dealt_out_once(spark, monkeypatch):
    """In parts of bounded size, without a window over a ward's votes."""
    monkeypatch.setattr(geo, "MOVES", 10)
    moves = spark.range(95).select(F.lit("p").alias("new_province_key"), (F.col("id") % 7).alias("new_ward_key"), (F.col("id") % 19).alias("old_ward_code"))
    units = spark.range(19).select(F.col("id").alias("ward_code"), (F.col("id") % 4).alias("district_code"), F.lit("d").alias("district"), F.lit("1").alias("province_code"), F.lit("p").alias("province"))
    found = geo.build_bridge(moves, units)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "new_ward_key" in plan and ", 10" in plan
    votes = {(r.new_ward_key, r.old_ward_code) for r in moves.collect()}
    for r in found.collect():
        n = [sum(1 for w, o in votes if w == r.new_ward_key and o % 4 == d) for d in range(4)]
        assert (r.district_code, r.n_candidates, r.confidence) == (n.index(max(n)), sum(map(bool, n)), round(max(n) / sum(n), 3))


def test_rows_meet_their_results_by_raw_columns_where_they_are(spark, monkeypatch):
    """Few characters of addresses are broadcast, more are shuffled: the same rows, whichever raw columns are null."""
    dims = geo.dimensions(
        spark.createDataFrame([("01", "Tỉnh Alpha")], "code string, name string"), spark.createDataFrame([("001", "Quận Bravo", "01")], "code string, name string, province_code string"),
        spark.createDataFrame([("00001", "Phường Charlie", "001")], "code string, name string, district_code string"),
    )
    raw = [("Phường Charlie, Quận Bravo, Alpha", None), (None, "Alpha"), (None, None), ("", "Alpha"), ("", None), ("Quận Bravo", "Alpha")]
    rows = spark.createDataFrame([(i, *raw[i % 6]) for i in range(60)], "n long, address_raw string, province_raw string")
    found = {}
    for most in (geo.SENT, -1):
        monkeypatch.setattr(geo, "SENT", most)
        out = geo.resolve_addresses(rows, dims)
        found[most] = sorted((r.n, r.province_code or "", r.district_code or "", r.ward_code or "", r.geo_source) for r in out.collect())
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert ("strategy=broadcast" in plan) == (most > 0)
    a, b = found.values()
    assert a == b and len(a) == 60
    places = [("01", "001", "00001", "old"), ("01", "", "", "none"), ("", "", "", "none"), ("01", "", "", "none"), ("", "", "", "none"), ("01", "001", "", "old")]
    assert a == [(i, *places[i % 6]) for i in range(60)]
