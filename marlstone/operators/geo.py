"""Free-text addresses to codes of the administrative hierarchy, as tiers of equi-joins.

A token meets the names of a level by its word sequences (exact names and names that it
contains). A token without such a match meets near spellings, at least 88 % alike: by what is left
of both when up to one letter is left out (2M/T of the letters M that they share in order and
those T of both: names of four letters or more with a letter too many or too few, of nine or more with another
letter), and from eight letters on by shared runs of four letters (1 less the edit distance over
the longer one). Each address is resolved once, however many rows have it. What wins is the
least of (tier, token, kind of match, likeness), taken by a grouped minimum.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.session import cut

EXACT, CONTAINED, ALIKE = 100.0, 97.0, 88.0
DISSOLVED_SCORE, UNIQUE_SCORE = 95.0, 90.0
RUN = 4
#: Rows of moved wards in a part.
MOVES = 1_000_000
#: Characters of all distinct addresses up to which these are sent to every task that holds rows.
SENT = 1 << 26
RAW = ("address_raw", "province_raw", "district_raw", "ward_raw")
# Districts that were merged into another one: province, old core name, successor.
DISSOLVED = [("79", "2", "769", "Thành phố Thủ Đức"), ("79", "9", "769", "Thành phố Thủ Đức")]


@dataclass
class Dimensions:
    """Three flat levels: code, name, core and the parent's code; districts also have n, their namesakes nationwide."""

    provinces: DataFrame
    districts: DataFrame
    wards: DataFrame
    #: Words of the longest name.
    most_words: int


def pad_codes(df: DataFrame, province: str = "province_code", district: str = "district_code", ward: str = "ward_code") -> DataFrame:
    pads = {province: 2, district: 3, ward: 5}
    return df.withColumns({c: F.lpad(F.col(c).cast("string"), n, "0") for c, n in pads.items() if c in df.columns})


def with_core(df: DataFrame) -> DataFrame:
    return df.withColumn("core", tx.core_name(F.col("name")))


def dimensions(provinces: DataFrame, districts: DataFrame, wards: DataFrame) -> Dimensions:
    """From flat tables: (code, name), (code, name, province_code), (code, name, district_code)."""
    districts = with_core(districts)
    same = districts.groupBy("core").agg(F.count("*").alias("n"))
    # each level is read by several tiers; names are normalised once
    levels = [cut(with_core(provinces)), cut(districts.join(same, "core")), cut(with_core(wards))]
    longest = [d.agg(F.max(F.size(F.split("core", " ")))).first()[0] or 1 for d in levels]
    return Dimensions(*levels, max(longest))


def flatten_units(tree: DataFrame) -> Dimensions:
    """From code, name, districts array<struct<code, name, wards array<struct<code, name>>>>."""
    d = tree.select(F.col("code").alias("province_code"), F.inline("districts"))
    w = d.select(F.col("code").alias("district_code"), F.inline("wards"))
    return dimensions(tree.select("code", "name"), d.select("code", "name", "province_code"), w.select("code", "name", "district_code"))


def word_runs(core: Column, most: int) -> Column:
    words = F.split(core, " ")
    runs = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.size(words) - i)), lambda n: F.array_join(F.slice(words, i + 1, n), " "))
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.size(words) - 1), runs)))


def letter_runs(core: Column) -> Column:
    """Runs of four letters of names long enough to have near spellings."""
    starts = F.sequence(F.lit(1), F.length(core) - RUN + 1)
    return F.when(F.length(core) >= 2 * RUN, F.array_distinct(F.transform(starts, lambda i: F.substring(core, i, F.lit(RUN))))).otherwise(F.array().cast("array<string>"))


def spellings(core: Column) -> Column:
    """A name of four letters or more, and all that is left of it when one letter is left out."""
    one_less = F.transform(F.sequence(F.lit(1), F.length(core)), lambda i: F.concat(F.substring(core, F.lit(1), i - 1), F.substring(core, i + 1, F.length(core))))
    return F.when(F.length(core) >= RUN, F.array_distinct(F.concat(F.array(core), one_less))).otherwise(F.array().cast("array<string>"))


def match_tokens(tokens: DataFrame, dim: DataFrame, most_words: int, scope: str | None = None) -> DataFrame:
    """key, code, name and score of the best match of each key.

    tokens: key, prio, core and, with a scope, the code of the parent to look in. most_words: of
    the longest name.
    """
    on = [scope] if scope else []
    tokens = tokens.where("core <> ''").select("key", "prio", "core", *on)
    names = dim.where("core <> ''").select("code", "name", F.col("core").alias("known"), *on)
    runs = tokens.withColumn("run", F.explode(word_runs(F.col("core"), most_words)))
    held = runs.join(names.withColumnRenamed("known", "run"), ["run", *on])
    held = held.select("key", "prio", (F.col("run") != F.col("core")).cast("int").alias("kind"), F.when(F.col("run") == F.col("core"), EXACT).otherwise(CONTAINED).alias("score"), F.length("run").alias("size"), "code", "name")
    unmet = tokens.join(held.select("key", "prio").distinct(), ["key", "prio"], "left_anti")
    met_by = lambda parts: unmet.withColumn("run", F.explode(parts(F.col("core")))).join(names.withColumn("run", F.explode(parts(F.col("known")))), ["run", *on])
    one = ["key", "prio", "core", "known", "code", "name"]
    by_letter = met_by(spellings).groupBy(*one).agg((F.max(F.length("run")) * 2).alias("_shared"))
    by_letter = by_letter.withColumn("score", F.col("_shared") / (F.length("core") + F.length("known")) * 100).drop("_shared")
    distance = F.levenshtein("core", "known") / F.greatest(F.length("core"), F.length("known"))
    by_runs = met_by(letter_runs).select(*one).distinct().withColumn("score", (1 - distance) * 100)
    alike = by_letter.unionByName(by_runs).where(F.col("score").between(ALIKE, EXACT - 1e-9)).select("key", "prio", F.lit(2).alias("kind"), "score", F.length("known").alias("size"), "code", "name")
    order = F.struct("prio", "kind", -F.col("score"), -F.col("size"), "code")
    best = held.unionByName(alike).groupBy("key").agg(F.min_by(F.struct("code", "name", "score"), order).alias("b"))
    return best.select("key", "b.code", "b.name", "b.score")


def address_key() -> Column:
    return F.to_json(F.struct(*(F.col(c) for c in RAW)))


def resolve_addresses(df: DataFrame, dims: Dimensions, bridge: DataFrame | None = None, dissolved: Sequence[tuple] = tuple(DISSOLVED)) -> DataFrame:
    """df with province, district and ward and their codes, geo_match_score and geo_source.

    Between tiers one row per distinct address is written to the shared folder, so that the
    plan of a tier does not hold those before it. Tiers of the district: the old hierarchy, merged districts, the bridge from new wards, a
    name that is unique nationwide. A token that names a ward by its unit matches no district.
    Rows meet their address's result by the raw columns; up to SENT characters of addresses are
    broadcast, so that rows stay where they are.
    """
    spark = df.sparkSession
    given = [c for c in RAW if c in df.columns] or list(RAW)
    for c in RAW:
        df = df if c in df.columns else df.withColumn(c, F.lit(None).cast("string"))
    # rows without any address are not joined
    anywhere = F.coalesce(*given)
    nowhere, keyed = df.where(anywhere.isNull()), df.where(anywhere.isNotNull())
    tuples = cut(keyed.select(*RAW).distinct().select(address_key().alias("key"), *RAW))
    parts = tuples.select("key", F.posexplode(tx.tokens(F.col("address_raw"))).alias("pos", "token"))
    parts = parts.select("key", (F.col("pos") + 1).alias("prio"), tx.core_name(F.col("token")).alias("core"), tx.key_name(F.col("token")).alias("name_key"), tx.norm_text(F.col("token")).rlike(tx.WARD_PREFIX).alias("is_ward"))
    parts = cut(parts)

    def hint(column: str) -> DataFrame:
        return tuples.where(F.col(column).isNotNull()).select("key", F.lit(0).alias("prio"), tx.core_name(F.col(column)).alias("core"))

    some = parts.select("key", "prio", "core")
    whole = tuples.select("key", F.lit(100).alias("prio"), tx.core_name(tx.text(F.col("address_raw"))).alias("core"))
    province = match_tokens(hint("province_raw").unionByName(some.where("prio <= 3")).unionByName(whole), dims.provinces, dims.most_words)
    province = cut(province.select("key", F.col("code").alias("province_code"), F.col("name").alias("province"), F.col("score").alias("p_score")))

    for_district = hint("district_raw").unionByName(parts.where(~F.col("is_ward")).select("key", "prio", "core"))
    within = for_district.join(province.select("key", "province_code"), "key")
    tier = lambda d, n, source: d.select("key", F.lit(n).alias("tier"), F.lit(source).alias("geo_source"), F.col("code").alias("district_code"), F.col("name").alias("district"), F.col("score").alias("d_score"))
    first = lambda d, order: d.groupBy("key").agg(F.min_by(F.struct("code", "name", "score"), F.struct(*order)).alias("b")).select("key", "b.*")
    found = tier(match_tokens(within, dims.districts, dims.most_words, "province_code"), 1, "old")
    merged = spark.createDataFrame(list(dissolved), "province_code string, core string, code string, name string").withColumn("score", F.lit(DISSOLVED_SCORE))
    found = found.unionByName(tier(first(within.join(merged, ["province_code", "core"]), ["prio", "code"]), 2, "dissolved"))
    if bridge is not None:
        by_name = F.count("*").over(Window.partitionBy("new_ward_key"))  # a ward's name has a few namesakes
        wide = bridge.select(F.col("new_ward_key").alias("name_key"), F.col("province_code").alias("in_province"), F.col("district_code").alias("code"), F.col("district").alias("name"), (F.col("confidence") * 100).alias("score"), by_name.alias("n"))
        key_of_unit = F.regexp_replace("name_key", "^(phuong|xa|thitran|dackhu)", "")
        named = parts.withColumn("name_key", F.explode(F.array_distinct(F.array("name_key", key_of_unit))))
        met = named.join(wide, "name_key").join(province.select("key", "province_code"), "key", "left")
        met = met.withColumn("here", F.coalesce(F.col("in_province") == F.col("province_code"), F.lit(False))).where("here or n = 1")
        found = found.unionByName(tier(first(met, [~F.col("here"), "prio", "code"]), 3, "bridge2025"))
    lone = for_district.join(province, "key", "left_anti").join(dims.districts.where("n = 1").select("core", "code", "name"), "core").withColumn("score", F.lit(UNIQUE_SCORE))
    found = found.unionByName(tier(first(lone, ["prio", "code"]), 4, "unique"))
    district = cut(found.groupBy("key").agg(F.min_by(F.struct("geo_source", "district_code", "district", "d_score"), F.struct("tier")).alias("b")).select("key", "b.*"))

    for_ward = hint("ward_raw").unionByName(some).join(district.select("key", "district_code"), "key")
    ward = match_tokens(for_ward, dims.wards, dims.most_words, "district_code")
    ward = ward.select("key", F.col("code").alias("ward_code"), F.col("name").alias("ward"), F.col("score").alias("w_score"))

    parents = dims.districts.select(F.col("code").alias("district_code"), F.col("province_code").alias("its_province"))
    of_province = dims.provinces.select(F.col("code").alias("its_province"), F.col("name").alias("its_name"))
    out = tuples.select("key", *(F.col(c).alias(f"_{c}") for c in given)).join(province, "key", "left").join(district, "key", "left").join(ward, "key", "left")
    out = out.join(parents, "district_code", "left").join(of_province, "its_province", "left")
    out = out.select(
        *(f"_{c}" for c in given), F.coalesce("its_province", "province_code").alias("province_code"), F.coalesce("its_name", "province").alias("province"), "district_code", "district", "ward_code", "ward",
        F.coalesce("w_score", "d_score", "p_score", F.lit(0.0)).alias("geo_match_score"), F.coalesce("geo_source", F.lit("none")).alias("geo_source"),
    )
    own = [c for c in df.columns if c not in out.columns]
    if (tuples.agg(F.sum(F.length("key"))).first()[0] or 0) <= SENT:
        out = F.broadcast(out)
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in given]
    found = keyed.select(*own).join(out, same).drop(*(f"_{c}" for c in given))
    blank = {"geo_match_score": F.lit(0.0), "geo_source": F.lit("none")}
    return found.unionByName(nowhere.select(*own, *(blank.get(c, F.lit(None).cast("string")).alias(c) for c in out.columns if c not in {f"_{g}" for g in given})))


def build_bridge(moves: DataFrame, units: DataFrame) -> DataFrame:
    """From new wards to the old district that most of their old wards were in.

    moves: new_province_key, new_ward_key, old_ward_code; units: ward_code, district_code,
    district, province_code, province. confidence is that district's share of the old wards.
    """
    ward, area = ["new_province_key", "new_ward_key"], ["district_code", "district", "province_code", "province"]
    # dealt out once, by new ward, in parts of about MOVES rows: a task holds no more when there are more rows
    dealt = moves.repartition(-(-max(1, moves.count()) // MOVES), *ward)
    votes = dealt.distinct().join(units, F.col("old_ward_code") == F.col("ward_code"))
    counts = votes.groupBy(*ward, *area).agg(F.count("*").alias("n"))
    first = F.min_by(F.struct(*area, "n"), F.struct(-F.col("n"), "district_code")).alias("b")
    best = counts.groupBy(*ward).agg(first, F.sum("n").alias("all"), F.count("*").cast("int").alias("n_candidates"))
    return best.select(*ward, "b.province_code", "b.province", "b.district_code", "b.district", F.round(F.col("b.n") / F.col("all"), 3).alias("confidence"), "n_candidates")


UNITS = "code string, name string, districts array<struct<code string, name string, wards array<struct<code string, name string>>>>"
# The second layout of the hierarchy, with names of its own.
UNITS_2 = "Id string, Name string, Districts array<struct<Id string, Name string, Wards array<struct<Id string, Name string>>>>"


def read_units(spark: SparkSession, path: str) -> Dimensions:
    """The hierarchy from nested JSON in either layout, with codes of any width."""
    lines = spark.read.text(path, wholetext=True)
    whole = lambda layout: F.from_json("value", f"array<struct<{layout}>>")
    # the second layout's fields are read in the order of the first one's
    second = F.transform(whole(UNITS_2), lambda p: F.struct(p["Id"], p["Name"], F.transform(p["Districts"], lambda d: F.struct(d["Id"], d["Name"], F.transform(d["Wards"], lambda w: F.struct(w["Id"], w["Name"]))))))
    either = F.when(F.exists(whole(UNITS), lambda p: p["code"].isNotNull()), whole(UNITS)).otherwise(second.cast(f"array<struct<{UNITS}>>"))
    padded = lines.select(F.inline(either)).select(F.lpad("code", 2, "0").alias("code"), "name", F.transform("districts", lambda d: F.struct(
        F.lpad(d["code"], 3, "0").alias("code"), d["name"].alias("name"), F.transform(d["wards"], lambda w: F.struct(F.lpad(w["code"], 5, "0").alias("code"), w["name"].alias("name"))).alias("wards"),
    )).alias("districts"))
    return flatten_units(padded)
