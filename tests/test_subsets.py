import itertools

import pytest
from conftest import CATALOG_SCHEMA, NAMES, TEXT_ID

from facetry.errors import CatalogError, FacetryError
from facetry.operators.crossfilter import CrossFilter
from facetry.operators.crossmatch import MOST_LITERALS, crossmatch_condition
from facetry.operators.quickflags import flag_condition
from facetry.operators.search import glossary_search, hit_counts, require_known, unknown_names
from facetry.operators.targeting import byte_masks, carries_bits, selected_bits, target_condition
from facetry.plans.subset import SubsetCollection, SubsetSpec
from facetry.profile import SURVEY, SURVEY_ONLY, TARGET_FLAGS_COLUMN, TEXT_IDENTIFIER, CatalogProfile
from facetry.sources.identifiers import parse_identifiers, read_identifiers
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROFILE = CatalogProfile()
FLAGGED, UNFLAGGED = "purely non-flagged", "no bad flags"


def ids(df):
    return sorted(r[0] for r in df.select("gaia_dr3_source_id").collect())


def ids_of(rows, keep):
    return sorted(r["gaia_dr3_source_id"] for r in rows if keep(r))


# Quick flags ------------------------------------------------------------------------------------


def test_flags_are_joined(stars, rows):
    test = flag_condition(stars, ["snr > 50", "gmag < 17"], "aspcap", PROFILE)
    assert ids(stars.where(test)) == ids_of(rows, lambda r: r["snr"] >= 50 and r["g_mag"] <= 17)


def test_flags_are_inverted_as_a_block(stars, rows):
    test = flag_condition(stars, ["snr > 50", "gmag < 17"], "aspcap", PROFILE, invert=True)
    assert ids(stars.where(test)) == ids_of(rows, lambda r: not (r["snr"] >= 50 and r["g_mag"] <= 17))


def test_flag_skipped_on_dataset(stars):
    assert flag_condition(stars, [FLAGGED], "mwmlite", PROFILE) is None
    assert flag_condition(stars, [FLAGGED], "best", PROFILE) is None
    assert flag_condition(stars, [], "aspcap", PROFILE) is None


def test_flag_replaced_on_dataset(stars, rows):
    clean = flag_condition(stars, [FLAGGED], "spall", PROFILE)
    warned = flag_condition(stars, [FLAGGED], "spall", PROFILE.with_warning_rows())
    assert ids(stars.where(clean)) == ids_of(rows, lambda r: r["zwarning_flags"] == 0)
    assert ids(stars.where(warned)) == ids_of(rows, lambda r: r["zwarning_flags"] != 0)


def test_unknown_flag(stars):
    with pytest.raises(FacetryError, match="no quick flag"):
        flag_condition(stars, ["shiny"], "aspcap", PROFILE)


# Targeting --------------------------------------------------------------------------------------


def bits_of(mapping_rows, cartons, mappers, combine):
    chosen = []
    for bit, mapper, carton in mapping_rows:
        a, b = mapper in mappers, carton in cartons
        hit = b if not mappers else a if not cartons else {"AND": a and b, "OR": a or b, "XOR": a != b}[combine]
        if hit and bit < 456:
            chosen.append(bit)
    return chosen


@pytest.mark.parametrize("mode", ["bitwise", "bytewise"])
@pytest.mark.parametrize("combine", ["AND", "OR", "XOR"])
@pytest.mark.parametrize(
    ("cartons", "mappers"), [(["carton_3"], []), ([], ["mwm"]), (["carton_3", "carton_9"], ["bhm"])]
)
def test_targeting(stars, rows, mapping, mapping_rows, cartons, mappers, combine, mode):
    bits = bits_of(mapping_rows, cartons, mappers, combine)

    def hit(row):
        flags = row[TARGET_FLAGS_COLUMN]
        if mode == "bytewise":
            return any(flags[b // 8] for b in bits)
        return any(flags[b // 8] >> (b % 8) & 1 for b in bits)

    test = target_condition(mapping, cartons, mappers, combine, flags=TARGET_FLAGS_COLUMN, mode=mode)
    assert ids(stars.where(test)) == ids_of(rows, hit)
    inverse = target_condition(mapping, cartons, mappers, combine, True, TARGET_FLAGS_COLUMN, mode=mode)
    assert ids(stars.where(inverse)) == ids_of(rows, lambda r: not hit(r))


def test_bits_past_the_last_byte_match_nothing(stars, mapping):
    late = mapping.where("bit >= 456").withColumn("alt_name", F.lit("late"))
    assert stars.where(target_condition(late, ["late"], flags=TARGET_FLAGS_COLUMN)).count() == 0
    assert stars.where(target_condition(late, ["late"], invert=True, flags=TARGET_FLAGS_COLUMN)).count() == 30


def test_set_algebra_of_masks(mapping):
    def bits(combine):
        return {r["bit"] for r in selected_bits(mapping, ["carton_3"], ["mwm"], combine).collect()}

    assert bits("AND") <= bits("OR")
    assert bits("XOR") | bits("AND") == bits("OR")
    assert not bits("XOR") & bits("AND")


def test_masks_are_bounded(mapping):
    masks = byte_masks(mapping, 57).collect()
    assert len(masks) == 57 and all(r["mask"] == 255 for r in masks)


def test_short_or_missing_flag_arrays(spark):
    df = spark.createDataFrame([(1, [0, 4]), (2, [255]), (3, None)], "i int, flags array<smallint>")
    assert [r["i"] for r in df.where(carries_bits(F.col("flags"), {1: 4})).collect()] == [1]


def test_nothing_selected_is_no_filter(mapping):
    assert target_condition(mapping) is None
    with pytest.raises(FacetryError):
        target_condition(mapping, ["carton_3"], ["mwm"], "NAND")
    with pytest.raises(FacetryError):
        target_condition(mapping, ["carton_3"], mode="nibble")


def test_signed_bytes(spark):
    df = spark.createDataFrame([(1, [-128]), (2, [127])], "i int, flags array<tinyint>")
    assert [r["i"] for r in df.where(carries_bits(F.col("flags"), {0: 128})).collect()] == [1]


# Identifier lists -------------------------------------------------------------------------------


def test_crossmatch_text(stars, rows):
    wanted = [rows[3]["gaia_dr3_source_id"], rows[8]["gaia_dr3_source_id"]]
    text = f"\n {wanted[0]} \n\n{wanted[1]}\n{wanted[1]}\n12\n"
    assert ids(stars.where(crossmatch_condition(stars, text, "gaia_dr3", "aspcap", PROFILE))) == wanted
    names = crossmatch_condition(stars, "2M00000004\n2M00000005", TEXT_IDENTIFIER, "aspcap", PROFILE)
    assert ids(stars.where(names)) == ids_of(rows, lambda r: r[TEXT_ID] in ("2M00000004", "2M00000005"))


def test_long_list_equals_short_list(stars, rows):
    wanted = [r["gaia_dr3_source_id"] for r in rows[::2]]
    text = "\n".join(map(str, [*wanted, *range(MOST_LITERALS)]))
    assert ids(stars.where(crossmatch_condition(stars, text, "gaia_dr3", "aspcap", PROFILE))) == sorted(wanted)


def test_list_from_files(spark, stars, rows, tmp_path):
    (tmp_path / "a.txt").write_text(f"{rows[1]['gaia_dr3_source_id']}\n\n")
    (tmp_path / "b.txt").write_text(f"  {rows[2]['gaia_dr3_source_id']}\r\n5")
    lines = read_identifiers(spark, str(tmp_path))
    found = stars.where(crossmatch_condition(stars, lines, "gaia_dr3", "aspcap", PROFILE))
    assert ids(found) == sorted(r["gaia_dr3_source_id"] for r in rows[1:3])


def test_bad_identifiers(spark, stars):
    with pytest.raises(FacetryError, match="failed to convert"):
        crossmatch_condition(stars, "1\n12a", "gaia_dr3", "aspcap", PROFILE)
    lines = spark.createDataFrame([("1",), ("12a",)], "value string")
    with pytest.raises(PySparkException, match="failed to convert"):
        parse_identifiers(lines, T.LongType()).collect()


def test_refused_identifiers(stars):
    assert crossmatch_condition(stars, " \n ", "gaia_dr3", "aspcap", PROFILE) is None
    with pytest.raises(FacetryError, match="not supported"):
        crossmatch_condition(stars, "1", "tic_v8", "spall", PROFILE)
    with pytest.raises(FacetryError, match="no identifier type"):
        crossmatch_condition(stars, "1", "hipparcos", "spall", PROFILE)


# Whole subsets ----------------------------------------------------------------------------------

EXPRESSIONS = {
    "": lambda r: True,
    "g_mag < 17": lambda r: r["g_mag"] < 17,
    "teff < 9e3 &  logg < 2": lambda r: r["teff"] is not None and r["teff"] < 9000 and r["logg"] < 2,
    "teff < 12e3 & logg > 4": lambda r: r["teff"] is not None and r["teff"] < 12000 and r["logg"] > 4,
}
CARTONS = ([], ["carton_3"], ["carton_1", "carton_16"])
MAPPERS = ([], ["mwm"], ["mwm", "bhm"])
FLAGS = ((), (FLAGGED,), (FLAGGED, SURVEY_ONLY))
GRID = list(itertools.product(["spall", "aspcap", "best"], EXPRESSIONS, CARTONS, MAPPERS, FLAGS))


def flag_holds(row, flag, dataset):
    if flag == SURVEY_ONLY:
        return row["release"] == SURVEY
    if dataset == "mwmlite":
        return True
    return (row["zwarning_flags"] if dataset == "spall" else row["result_flags"]) == 0


@pytest.mark.parametrize("spec", GRID[::5])
def test_grid(catalog, rows, mapping_rows, spec):
    dataset, expression, cartons, mappers, flags = spec
    name = "mwmlite" if dataset == "best" else dataset
    bits = bits_of(mapping_rows, cartons, mappers, "AND")

    def keep(row):
        targeted = not (cartons or mappers) or any(row[TARGET_FLAGS_COLUMN][b // 8] >> (b % 8) & 1 for b in bits)
        return (
            row["pipeline"] == name
            and EXPRESSIONS[expression](row)
            and targeted
            and all(flag_holds(row, f, name) for f in flags)
        )

    params = {
        "dataset": dataset,
        "expression": expression,
        "carton": ",".join(cartons),
        "mapper": ", ".join(mappers),
        "flags": ",".join(flags),
        "unused": "x",
    }
    assert ids(SubsetSpec.from_params(params).compile(catalog)) == ids_of(rows, keep)


def test_inversion_of_each_part(catalog, rows):
    listed = [r["gaia_dr3_source_id"] for r in rows[:20]]
    spec = SubsetSpec(
        dataset="aspcap", expression="snr >= 50", flags=(FLAGGED,), crossmatch="\n".join(map(str, listed)), invert=True
    )
    expected = ids_of(
        rows,
        lambda r: r["pipeline"] == "aspcap"
        and not r["snr"] >= 50
        and not r["result_flags"] == 0
        and r["gaia_dr3_source_id"] in listed,
    )
    assert ids(spec.compile(catalog)) == expected


def test_defaults(catalog):
    spec = SubsetSpec().with_defaults(catalog.profile, "star")
    assert (spec.dataset, spec.flags, spec.crossmatch_type) == ("mwmlite", (FLAGGED,), "gaia_dr3")
    assert SubsetSpec().with_defaults(catalog.profile, "visit").dataset == "thepayne"
    assert SubsetSpec.from_params({}).flags == ()
    assert SubsetSpec.from_params({"invert": "true"}).invert


def test_spec_survives_json(catalog):
    spec = SubsetSpec(
        name="B",
        dataset="aspcap",
        expression="unit > 1",
        flags=("snr > 50",),
        cartons=("carton_3",),
        mappers=("mwm",),
        combine="OR",
        crossmatch="1\n2",
        crossmatch_type=SURVEY,
        computed=(("unit", "ra / 10"),),
        invert=True,
        target_mode="bytewise",
    )
    again = SubsetSpec.from_json(spec.to_json())
    assert again == spec
    assert ids(again.compile(catalog)) == ids(spec.compile(catalog))
    assert SubsetSpec.from_json(SubsetSpec().to_json()) == SubsetSpec()


def test_computed_columns_in_subset(catalog):
    spec = SubsetSpec(dataset="aspcap", expression="double_ra > 200", flags=(), computed=(("double_ra", "ra * 2"),))
    found = spec.compile(catalog)
    assert "double_ra" in found.columns and {r["ra"] > 100 for r in found.collect()} == {True}


def test_check_of_names(catalog):
    SubsetSpec(dataset="best", cartons=("carton_3",), mappers=("mwm",)).check(catalog)
    for wrong in (
        SubsetSpec(dataset="nope"),
        SubsetSpec(flags=("nope",)),
        SubsetSpec(cartons=("nope",)),
        SubsetSpec(mappers=("mwm", "nope")),
    ):
        with pytest.raises(FacetryError, match="nope"):
            wrong.check(catalog)


def test_targeting_needs_a_mapping(stars):
    from facetry.sources.catalog import Catalog

    with pytest.raises(FacetryError, match="mapping"):
        SubsetSpec(dataset="aspcap", cartons=("carton_3",)).compile(Catalog(stars))


def test_collection():
    some = SubsetCollection().add("s0", SubsetSpec()).clone("s0", "s1").clone("s0", "s2")
    assert some.names == ["A", "copy of A", "copy of copy of A"]
    assert some.rename("s1", "B").get("s1").name == "B"
    assert some.update("s0", expression="ra > 1").get("s0").expression == "ra > 1"
    assert SubsetCollection.from_json(some.to_json()) == some
    assert some.remove("s1").names == ["A", "copy of copy of A"]
    for wrong in (lambda: some.add("s3", SubsetSpec()), lambda: some.rename("s1", ""), lambda: some.rename("s1", "A")):
        with pytest.raises(FacetryError):
            wrong()


# Cross-filter and names -------------------------------------------------------------------------


def test_crossfilter(stars):
    views = CrossFilter()
    assert views.condition_for("a") is None and views.frame_for(stars, "a").count() == 30
    views.set("a", F.col("ra") > 100)
    views.set("b", F.col("dec") < 0)
    assert views.frame_for(stars, "a").count() == stars.where("dec < 0").count()
    assert views.frame_for(stars, "c").count() == stars.where("dec < 0 and ra > 100").count()
    assert views.frame_for(stars).count() == stars.where("dec < 0 and ra > 100").count()
    assert views.frame_for(stars, "c", lambda p, q: p | q).count() == stars.where("dec < 0 or ra > 100").count()
    views.set("b", None)
    views.clear("unknown")
    assert views.keys == ["a"] and views.condition_for("a") is None


def test_unknown_names(stars):
    assert [r[0] for r in unknown_names(stars, "pipeline", ["spall", "x", "x"]).collect()] == ["x"]
    require_known(stars, "pipeline", [], "dataset")
    require_known(stars, "pipeline", ["spall"], "dataset")


def test_glossary(spark):
    df = spark.createDataFrame([("teff", "how hot"), ("logg", "gravity"), ("hot", "x")], "name string, description string")
    assert glossary_search(df, " ").count() == 3
    assert {r["name"] for r in glossary_search(df, "HOT").collect()} == {"teff", "hot"}
    assert hit_counts(df, "hot").first() == (2, 2)


def test_missing_dataset_columns(catalog):
    with pytest.raises((CatalogError, FacetryError)):
        SubsetSpec(dataset="aspcap", flags=(), expression="nothing > 2").compile(catalog)
    assert len(NAMES) == CATALOG_SCHEMA.count(", ") + 1
