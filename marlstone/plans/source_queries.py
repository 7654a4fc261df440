"""Queries over raw text, logs and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.fixtures import listings, table, with_listings
from marlstone.functions import text as tx
from marlstone.functions.listing import is_usable, listing_id, unit_price
from marlstone.operators.lake import with_unit_price
from marlstone.sources import listings as src

ACC, PLAIN = "".join(tx.ACCENTS.values()), "".join(k * len(v) for k, v in tx.ACCENTS.items())
STRIP = f"regexp_replace(translate(%s, '{ACC}{ACC.upper()}', '{PLAIN}{PLAIN.upper()}'), '\\p{{Mn}}', '', 'g')"
WORDS = f"trim(regexp_replace(lower({STRIP}), '[^a-z0-9]+', ' ', 'g'))"


def events_log(spark, sf):
    """The events as a log of listings: every seventh value is not JSON."""
    fields = F.struct(F.col("event_id").cast("string").alias("listing_id"), F.get_json_object("props", "$.k").cast("double").alias("floors"))
    value = F.when(F.col("event_id") % 7 == 0, "broken").otherwise(F.to_json(fields))
    position = [F.lit("t").alias("topic"), (F.col("event_id") % 4).cast("int").alias("partition"), F.col("event_id").alias("offset"), F.col("ts").cast("timestamp").alias("timestamp")]
    return table(spark, sf, "events").select(value.alias("value"), *position)


def decoded(spark, sf):
    good, bad = src.decode_events(events_log(spark, sf))
    counts = good.groupBy("partition").agg(F.count("*").alias("good"), F.sum("floors").cast("long").alias("total"))
    counts = counts.join(bad.groupBy("partition").agg(F.count("*").alias("bad")), "partition", "full")
    return counts.select("partition", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("bad", F.lit(0)).alias("bad"), "total")


def normalised(spark, sf):
    """Names and keys as the geo matcher makes them, of whole texts: digests, as the rows are wide."""
    text = F.col("text")
    forms = {"plain": tx.strip_accents(text), "words": tx.norm_text(text), "key": tx.key_name(text)}
    return table(spark, sf, "documents").select("doc_id", *(F.sha2(c, 256).alias(name) for name, c in forms.items()))


def normalised_whole(spark, sf):
    """As normalise_text, over whole texts: digests, as the rows are wide."""
    text = F.col("text")
    forms = {"plain": tx.strip_accents(text), "words": F.trim(F.regexp_replace(F.lower(tx.strip_accents(text)), "[^a-z0-9]+", " ")), "key": tx.key_name(text)}
    return table(spark, sf, "documents").select("doc_id", *(F.sha2(c, 256).alias(name) for name, c in forms.items()))


# Addresses with each abbreviation, and what they are written out.
SHORTENED = {
    "Quận 7, TP. HCM": "quan 7 ho chi minh", "Quận 7 TPHCM": "quan 7 ho chi minh", "Số 2, HCM": "so 2 ho chi minh", "Q 7, Sài Gòn": "quan 7 ho chi minh", "Q7 SG": "quan 7 ho chi minh",
    "Ba Đình, HàNội": "ba dinh ha noi", "Ba Đình, HN": "ba dinh ha noi", "T.P Thủ Đức": "thanh pho thu duc", "TP.Thủ Đức": "thanh pho thu duc", "TT.Nhà Bè": "thi tran nha be", "TT Nhà Bè": "thi tran nha be",
    "TX.Thuận An": "thi xa thuan an", "tx. Thuận An": "thi xa thuan an", "Q.3": "quan 3", "Q. Bình Thạnh": "quan binh thanh", "H.Củ Chi": "huyen cu chi", "P.Bến Nghé": "phuong ben nghe", "X. Xuân Nộn": "xa xuan non", "P5, Q10": "phuong 5 quan 10",
}


def normalised_addresses(spark, sf):
    """Each order's address, one of those with abbreviations and its number, normalised."""
    forms = F.array(*map(F.lit, SHORTENED))
    at = (F.col("o_orderkey") % len(SHORTENED) + 1).cast("int")
    rows = table(spark, sf, "orders").select("o_orderkey", F.concat_ws(" / ", F.element_at(forms, at), F.col("o_custkey").cast("string")).alias("address"))
    return rows.select("o_orderkey", tx.norm_text(F.col("address")).alias("words"))


def numbers(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", tx.first_number(F.col("text")).alias("first_number"), tx.to_text(F.col("source")).alias("source_text"), F.size(tx.tokens(F.col("text"))).alias("n_parts"))


def page_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha2(tx.html_text(F.col("html")), 256).alias("digest"), F.length(tx.html_text(F.col("html"))).alias("n"))


def page_links(spark, sf):
    blocks = src.explode_blocks(table(spark, sf, "pages"), anchor=r'<a href="[^"]*">')
    return blocks.select("page_id", "pos", F.regexp_extract("block", 'href="([^"]*)"', 1).alias("href"))


def unit_prices(spark, sf):
    """Unit prices filled in from price and area where the source has none."""
    some = listings(spark, sf).withColumn("price_per_m2", F.when(F.col("floors") > 1, F.col("price_per_m2")))
    return with_unit_price(some).select("listing_id", "part_key", "ingested_at", "price_per_m2")


def usable(spark, sf):
    """Usable listings; those of three floors have no place."""
    placed = {"address_raw": F.when(F.col("floors") < 3, F.col("ward")), "district_raw": F.when(F.col("floors") > 3, F.col("district"))}
    return listings(spark, sf).withColumns(placed).groupBy("province_code").agg(F.count_if(is_usable()).alias("n_usable"), F.count("*").alias("n"))


def csv_rows(spark, sf):
    """Line items as a CSV file of another source has them: other names, commas, units and words for what is missing."""
    quantity, price = F.col("l_quantity").cast("int").cast("string"), F.col("l_partkey").cast("string")
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit(" Lô "), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("Địa chỉ"), F.concat(quantity, F.lit(",5 m2")).alias("Diện tích"),
        F.when(F.col("l_linenumber") == 7, "Không xác định").when(F.col("l_linenumber") == 6, F.concat(F.lit("1."), price, F.lit(".5 tỷ"))).otherwise(F.concat(price, F.lit(" tỷ"))).alias("Giá"),
        F.when(F.col("l_linenumber") == 1, "NaN").otherwise(F.col("l_returnflag")).alias("Pháp lý"),
    )


def tabular(spark, sf):
    rows = src.from_tabular(csv_rows(spark, sf))
    return rows.select("address_raw", "area", "price", "price_per_m2", "legal_status", "source", F.col("crawled_at").isNull().alias("no_crawl"), F.col("listing_id").rlike("^kaggle_[0-9a-f]{16}$").alias("has_id"))


def coverage(spark, sf):
    return src.alias_coverage(csv_rows(spark, sf))


def stable_ids(spark, sf):
    """Ids of listings; a ward of three floors is missing, which counts as a word."""
    ward = F.when(F.col("floors") != 3, F.col("ward"))
    return listings(spark, sf).select("listing_id", "part_key", "ingested_at", listing_id("s", ward, F.col("part_key"), F.col("district_code")).alias("id"))


def made_prices(spark, sf):
    """Unit prices by price and area, with some that are missing or 0."""
    price = F.when(F.col("l_linenumber") == 1, 0.0).when(F.col("l_linenumber") > 2, (F.col("l_partkey") % 90 + 1) / 10)
    area = F.when(F.col("l_linenumber") == 3, 0.0).when(F.col("l_linenumber") != 4, F.col("l_quantity").cast("double"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", price.alias("p"), area.alias("a"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", unit_price(F.col("p"), F.col("a")).alias("unit_price"))


def api_rows(spark, sf):
    """Line items as records of an API, in VND, as canonical listings."""
    name = lambda c, keep: F.when(keep, F.col(c))
    n = F.col("floors")
    records = listings(spark, sf).select(
        F.col("part_key").alias("list_id"), (F.col("part_key") * 1_000_000).alias("price"), F.col("area").alias("size"), F.lit(None).cast("double").alias("property_width"), F.col("access_road").alias("property_road_width"),
        F.lit(None).cast("string").alias("direction"), n.alias("floors"), n.alias("rooms"), n.alias("toilets"), F.col("legal_status").alias("property_legal_document"), F.col("furniture_state").alias("furnishing_status"),
        name("province", n < 6).alias("region_name"), name("district", n < 5).alias("area_name"), name("ward", n < 4).alias("ward_name"), F.col("listing_id").alias("address"),
    )
    return src.from_api(records, "2025-01-01").select("listing_id", "address_raw", "province_raw", "district_raw", "ward_raw", "area", "floors", "bedrooms", F.round("price", 6).alias("price"), "price_per_m2", "legal_status", "crawled_at")


def market_pages(spark, sf):
    """Each order as a page: its line items as blocks of microdata, the date given in three ways or not at all, some without a price."""
    n, day = F.col("l_linenumber"), F.col("l_shipdate")
    date = F.when(n % 4 == 1, F.concat(F.lit('<time itemprop="datePosted" datetime="'), F.date_format(day, "yyyy-MM-dd"), F.lit('">x</time>')))
    date = date.when(n % 4 == 2, F.concat(F.lit('<i itemprop="datePosted">Ngày: '), F.date_format(day, "dd/MM/yyyy"), F.lit("</i>"))).when(n % 4 == 3, F.concat(F.lit('<b class="ct_date">'), F.date_format(day, "d/M/yyyy"), F.lit("</b>"))).otherwise(F.lit(""))
    block = F.concat(
        F.lit('<a itemprop="url" href="/ban-nha'), F.when(n % 2 == 0, F.concat(F.lit("-"), (F.col("l_partkey") + 100000).cast("string"))).otherwise(F.lit("")), F.lit('.html">'),
        F.when(n < 6, F.concat(F.lit('<span itemprop="price" content="'), (F.col("l_partkey") * 1_000_000).cast("string"), F.lit('">'))).otherwise(F.lit("<span>")),
        F.lit('7 ty</span><span itemprop="floorSize">'), F.col("l_quantity").cast("int").cast("string"), F.lit(' m2</span><i itemprop="numberOfFloors" content="'), n.cast("string"), F.lit('"></i>'), date, F.lit("</a>"),
    )
    pages = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("page_id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "l_shipdate", block.alias("b")))).alias("blocks"))
    return pages.select("page_id", F.concat(F.lit("<html><div>"), F.array_join("blocks.b", "\n"), F.lit("</div></html>")).alias("html"))


def microdata(spark, sf):
    rows = src.listing_fields(src.explode_blocks(market_pages(spark, sf)))
    return rows.select("page_id", "pos", "url", "listing_id", "price", "area", "floors", "posted_on", "price_per_m2")


def details(spark, sf):
    """Each supplier as a detail page: a table of labels and values, some of them marks of an empty field."""
    cell = lambda label, value: F.concat(F.lit(f"<tr><td>{label}:</td><td class='v'>"), value, F.lit("</td></tr>"))
    key = F.col("s_suppkey")
    html = F.concat(cell("Pháp lý", F.when(key % 3 == 0, "---").otherwise("Sổ hồng/ <b>Sổ đỏ</b>")), cell("Chiều ngang", F.concat((key % 9).cast("string"), F.lit(",5m"))), cell("Hướng", F.when(key % 2 == 0, "Đông&nbsp;Nam").otherwise("_")), cell("Số lầu", F.lit("không")))
    found = src.detail_fields(table(spark, sf, "supplier").select(key.alias("page_id"), html.alias("html")))
    return found.select("page_id", "legal_status", "frontage", "house_direction", "floors")


def first_links(spark, sf):
    found = page_links(spark, sf).withColumn("listing_id", F.col("href"))
    return src.first_seen(found).select("listing_id", "page_id", "pos")


QUERIES = {
    "decode_events": decoded,
    "normalise_text": normalised,
    "normalise_whole_text": normalised_whole,
    "normalise_addresses": normalised_addresses,
    "tolerant_fields": numbers,
    "page_text": page_text,
    "page_links": page_links,
    "first_seen": first_links,
    "unit_price": unit_prices,
    "usable": usable,
    "from_tabular": tabular,
    "alias_coverage": coverage,
    "listing_ids": stable_ids,
    "unit_price_rule": made_prices,
    "from_api": api_rows,
    "listing_fields": microdata,
    "detail_fields": details,
    "profile": lambda s, d: src.profile(listings(s, d)),
}
HTML = "regexp_replace(html, '<[^>]*>', ' ', 'g')"
for _name, _plain in tx.ENTITIES.items():
    HTML = f"replace({HTML}, '&{_name};', '{_plain.replace(chr(39), chr(39) * 2)}')"
HTML = f"trim(regexp_replace({HTML}, '\\s+', ' ', 'g'))"
LINKS = """links AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">', 1), 1) AS pos FROM pages)"""
NORM = f"regexp_replace(lower({STRIP}), '[^a-z0-9.]+', ' ', 'g')"
for _pattern, _full in (*tx.ABBREVIATIONS, tx.NUMBERED_WARD):
    NORM = f"regexp_replace({NORM}, '{_pattern}', '{_full.replace('$1', chr(92) + '1')}', 'g')"
NORM = f"trim(regexp_replace(trim(regexp_replace({NORM}, '[^a-z0-9]+', ' ', 'g')), ' +', ' ', 'g'))"
SQL = {
    "decode_events": """SELECT (event_id % 4)::INTEGER AS partition, count(*) FILTER (event_id % 7 <> 0) AS good, count(*) FILTER (event_id % 7 = 0) AS bad,
        sum(json_extract(props, '$.k')::BIGINT) FILTER (event_id % 7 <> 0)::BIGINT AS total FROM events GROUP BY 1""",
    "normalise_text": f"""SELECT doc_id, sha256({STRIP % "text"}) AS plain, sha256({NORM % "text"}) AS words,
        sha256(regexp_replace(lower({STRIP % "text"}), '[^a-z0-9]', '', 'g')) AS key FROM documents""",
    "normalise_whole_text": f"""SELECT doc_id, sha256({STRIP % "text"}) AS plain, sha256({WORDS % "text"}) AS words,
        sha256(regexp_replace(lower({STRIP % "text"}), '[^a-z0-9]', '', 'g')) AS key FROM documents""",
    "normalise_addresses": f"""SELECT o_orderkey, [{", ".join(f"'{x}'" for x in SHORTENED.values())}][o_orderkey % {len(SHORTENED)} + 1] || ' ' || o_custkey AS words FROM orders""",
    "tolerant_fields": r"""SELECT doc_id, try_cast(nullif(replace(regexp_extract(text, '(-?\d+(?:[.,]\d+)?)', 1), ',', '.'), '') AS DOUBLE) AS first_number,
        CASE WHEN trim(source) <> '' AND lower(trim(source)) NOT IN ('nan', 'none', 'null') THEN trim(source) END AS source_text,
        len(list_filter(regexp_split_to_array(coalesce(text, ''), '[,;/]'), lambda x: trim(x, ' ') <> ''))::INTEGER AS n_parts FROM documents""",
    "page_text": f"SELECT page_id, sha256({HTML}) AS digest, length({HTML})::INTEGER AS n FROM pages",
    "page_links": f"WITH {LINKS} SELECT page_id, pos::INTEGER AS pos, href FROM links",
    "first_seen": f"WITH {LINKS} SELECT href AS listing_id, page_id, pos::INTEGER AS pos FROM links QUALIFY row_number() OVER (PARTITION BY href ORDER BY page_id, pos) = 1",
    "unit_price": with_listings("SELECT listing_id, part_key, ingested_at, CASE WHEN floors > 1 THEN price_per_m2 ELSE price * 1000.0 / area END AS price_per_m2 FROM listings"),
    "usable": with_listings("SELECT province_code, count(*) FILTER (area BETWEEN 5 AND 10000 AND price BETWEEN 0.05 AND 1000 AND floors <> 3) AS n_usable, count(*) AS n FROM listings GROUP BY 1"),
    "from_tabular": """SELECT 'Lô ' || l_orderkey || '-' || l_linenumber AS address_raw, l_quantity::INTEGER + 0.5::DOUBLE AS area, price, CASE WHEN price <> 0 THEN round(price * 1000 / (l_quantity::INTEGER + 0.5), 4) END AS price_per_m2,
          CASE WHEN l_linenumber <> 1 THEN l_returnflag END AS legal_status, 'kaggle' AS source, true AS no_crawl, true AS has_id
        FROM (SELECT *, CASE l_linenumber WHEN 7 THEN NULL WHEN 6 THEN ('1' || l_partkey || '.5')::DOUBLE ELSE l_partkey::DOUBLE END AS price FROM lineitem)""",
    "alias_coverage": """SELECT f AS field, CASE f WHEN 'address_raw' THEN 'Địa chỉ' WHEN 'area' THEN 'Diện tích' WHEN 'price' THEN 'Giá' WHEN 'legal_status' THEN 'Pháp lý' END AS "column",
          CASE f WHEN 'address_raw' THEN 0 WHEN 'area' THEN 0 WHEN 'price' THEN (SELECT count(*) FROM lineitem WHERE l_linenumber = 7) WHEN 'legal_status' THEN (SELECT count(*) FROM lineitem WHERE l_linenumber = 1) ELSE (SELECT count(*) FROM lineitem) END AS n_null
        FROM (SELECT unnest(['address_raw', 'area', 'frontage', 'access_road', 'house_direction', 'balcony_direction', 'floors', 'bedrooms', 'bathrooms', 'legal_status', 'furniture_state', 'property_type', 'price']) AS f)""",
    "listing_ids": with_listings("SELECT listing_id, part_key, ingested_at, 's_' || substr(sha1(CASE WHEN floors <> 3 THEN ward ELSE 'None' END || '|' || part_key || '|' || district_code), 1, 16) AS id FROM listings"),
    "unit_price_rule": """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber > 4 THEN round((l_partkey % 90 + 1) / 10 * 1000 / l_quantity, 4) END AS unit_price FROM lineitem""",
    "from_api": with_listings("""SELECT 'api_' || part_key AS listing_id, CASE WHEN floors < 4 THEN ward || ', ' || district || ', ' || province WHEN floors < 5 THEN district || ', ' || province WHEN floors < 6 THEN province ELSE listing_id END AS address_raw,
          CASE WHEN floors < 6 THEN province END AS province_raw, CASE WHEN floors < 5 THEN district END AS district_raw, CASE WHEN floors < 4 THEN ward END AS ward_raw, area, floors, floors AS bedrooms,
          round(part_key / 1000, 6) AS price, CASE WHEN part_key > 0 THEN round(part_key / 1000 * 1000 / area, 4) END AS price_per_m2, legal_status, '2025-01-01' AS crawled_at FROM listings"""),
    "listing_fields": """SELECT l_orderkey AS page_id, pos, '/ban-nha' || CASE WHEN l_linenumber % 2 = 0 THEN '-' || (l_partkey + 100000) ELSE '' END || '.html' AS url,
          'site_' || substr(sha1(CASE WHEN l_linenumber % 2 = 0 THEN (l_partkey + 100000)::VARCHAR ELSE '/ban-nha.html' END), 1, 16) AS listing_id, round(l_partkey / 1000, 6) AS price, l_quantity::INTEGER::DOUBLE AS area, l_linenumber::DOUBLE AS floors,
          CASE WHEN l_linenumber % 4 > 0 THEN l_shipdate::DATE END AS posted_on, CASE WHEN l_partkey > 0 THEN round(l_partkey / 1000 * 1000 / l_quantity::INTEGER, 4) END AS price_per_m2
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_shipdate)::INTEGER AS pos FROM lineitem) WHERE l_linenumber < 6""",
    "detail_fields": """SELECT s_suppkey AS page_id, CASE WHEN s_suppkey % 3 <> 0 THEN 'Sổ hồng/ Sổ đỏ' END AS legal_status, s_suppkey % 9 + 0.5::DOUBLE AS frontage, CASE WHEN s_suppkey % 2 = 0 THEN 'Đông Nam' END AS house_direction,
          NULL::DOUBLE AS floors FROM supplier""",
    "profile": with_listings("""SELECT 'area' AS field, count(*) FILTER (area IS NULL) AS n_null, min(area) AS min, quantile_cont(area, 0.5) AS median, max(area) AS max FROM listings
        UNION ALL SELECT 'price', count(*) FILTER (price IS NULL), min(price), quantile_cont(price, 0.5), max(price) FROM listings"""),
}
