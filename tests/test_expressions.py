import math
import operator
import random
from decimal import Decimal

from random import Random

import pytest
from conftest import close

from facetry.errors import ExpressionError, FacetryError
from facetry.functions.expressions import condition, expand_spellings, formula, formula_names
from facetry.functions.text import has_words, text_has_words
from facetry.operators.search import matching_names
from facetry.operators.computed import ComputedColumns
from facetry.profile import TARGET_ID
from pyspark.sql import functions as F


def selected(df, test):
    return sorted(r[0] for r in df.where(test).select("gaia_dr3_source_id").collect())


def expected(rows, keep):
    """Rows the test keeps; a comparison with a missing value raises and selects nothing."""
    found = []
    for row in rows:
        try:
            if keep(row):
                found.append(row["gaia_dr3_source_id"])
        except TypeError:
            pass
    return sorted(found)


@pytest.mark.parametrize(
    ("text", "keep"),
    [
        ("teff > 4000", lambda r: r["teff"] > 4000),
        ("teff >= 4000", lambda r: r["teff"] >= 4000),
        ("teff < 9e3", lambda r: r["teff"] < 9000),
        ("teff <= 9e3 & logg < 2", lambda r: r["teff"] <= 9000 and r["logg"] < 2),
        ("teff != 4000", lambda r: r["teff"] is not None and r["teff"] != 4000),
        ("9000 > teff", lambda r: 9000 > r["teff"]),
        ("-1 < plx <= 1.25", lambda r: -1 < r["plx"] <= 1.25),
        ("plx == -0.5", lambda r: r["plx"] == -0.5),
        ("snr >= 50 & (g_mag <= 17 | result_flags == 0)", lambda r: r["snr"] >= 50 and (r["g_mag"] <= 17 or r["result_flags"] == 0)),
        ("snr >= 50 & g_mag <= 17 | result_flags == 0", lambda r: r["snr"] >= 50 and r["g_mag"] <= 17 or r["result_flags"] == 0),
        ("release == 'old one'", lambda r: r["release"] == "old one"),
        ("release != 'a & b' & telescope=='apo25m'", lambda r: r["telescope"] == "apo25m"),
        ("good == True", lambda r: r["good"] is True),
        ("ra > dec", lambda r: r["ra"] > r["dec"]),
        ("teff < logg", lambda r: r["teff"] < r["logg"]),
        ("logg == logg", lambda r: r["logg"] == r["logg"]),
        ("teff >= logg", lambda r: r["teff"] >= r["logg"]),
        ("result_flags < 0.5", lambda r: r["result_flags"] < 0.5),
        ("gaia_dr3_source_id == 4611686018427387907", lambda r: r["gaia_dr3_source_id"] == 4611686018427387907),
    ],
)
def test_condition(stars, rows, text, keep):
    assert selected(stars, condition(stars, text)) == expected(rows, keep)


NUMBERS = {"teff": (3500.5, 4000, 5770, 9000), "logg": (0, 1.25, 4.75), "plx": (-0.5, 0, 2.5), "result_flags": (0, 1)}
COMPARE = {
    ">": operator.gt,
    ">=": operator.ge,
    "<": operator.lt,
    "<=": operator.le,
    "==": operator.eq,
    "!=": operator.ne,
}


def all_of(values):
    return False if False in values else None if None in values else True


def any_of(values):
    return True if True in values else None if None in values else False


def random_text(numbers, depth):
    """A random filter text and the function that evaluates it on a row, with NULL as ``None``."""
    kind = numbers.random()
    if depth and kind < 0.6:
        sign = numbers.choice("&|")
        parts = [random_text(numbers, depth - 1) for _ in range(numbers.choice((2, 3)))]
        join = all_of if sign == "&" else any_of
        text = f" {sign} ".join(f"({t})" for t, _ in parts)
        return text, lambda row: join([f(row) for _, f in parts])
    name = numbers.choice(list(NUMBERS))
    op = numbers.choice(list(COMPARE))
    value = numbers.choice(NUMBERS[name])
    if kind < 0.7:
        low, high = sorted(numbers.sample(NUMBERS[name], 2))
        a, b = numbers.choice(("<", "<=")), numbers.choice(("<", "<="))

        def inside(row):
            found = row[name]
            return None if found is None else COMPARE[a](low, found) and COMPARE[b](found, high)

        return f"{low} {a} {name} {b} {high}", inside
    if kind < 0.85:
        return f"{name}{op}{value}", lambda row: None if row[name] is None else COMPARE[op](row[name], value)
    return f"{value} {op} {name}", lambda row: None if row[name] is None else COMPARE[op](value, row[name])


@pytest.mark.parametrize("seed", range(4))
def test_random_conditions(stars, rows, seed):
    """Random texts, also inverted, against a row-by-row evaluation with missing values."""
    numbers = random.Random(seed)
    cases = [random_text(numbers, 3) for _ in range(25)]
    tests = [condition(stars, text, invert).alias(f"t{i}_{int(invert)}") for i, (text, _) in enumerate(cases) for invert in (False, True)]
    found = {r["gaia_dr3_source_id"]: r for r in stars.select("gaia_dr3_source_id", *tests).collect()}
    for row in rows:
        for i, (text, evaluate) in enumerate(cases):
            expected = evaluate(row)
            result = found[row["gaia_dr3_source_id"]]
            assert result[f"t{i}_0"] == expected, (text, row)
            assert result[f"t{i}_1"] == (None if expected is None else not expected), (text, row)


@pytest.mark.parametrize("text", ["teff > 4000", "4000 <= teff", "teff == 4000", "teff < 4000 | logg > 1"])
def test_inverse_is_complement_without_null(stars, text):
    known = stars.where("teff is not null")
    test, inverse = condition(known, text), condition(known, text, invert=True)
    assert known.where(test).count() + known.where(inverse).count() == known.count()
    assert known.where(test & inverse).count() == 0


def test_null_is_in_neither(stars):
    test, inverse = condition(stars, "teff > 4000"), condition(stars, "teff > 4000", invert=True)
    assert stars.where("teff is null").where(test | inverse).count() == 0


@pytest.mark.parametrize("text", ["", "   ", None])
def test_empty_text_is_no_filter(stars, text):
    assert condition(stars, text) is None


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("teff", "no comparator"),
        ("teff > 5 & logg", "comparison 2 is invalid: no comparator"),
        ("1 > teff > 0", "not a proper range"),
        ("1 < nothing < 3", "middle of a range must be a column"),
        ("9 < teff < 3", "range is empty"),
        ("nothing > 5", "one side must be a column"),
        ("1 < 2 < teff < 4", "too many comparators"),
        ("teff > .5", "compared with a number"),
        ("teff > 1E3", "compared with a number"),
        ("teff > 1e+3", "compared with a number"),
        ("teff > 'hot'", "compared with a number"),
        ("release == 5", "quoted text"),
        ("good == 1", "True or False"),
        ("teff == release", "different kinds"),
        ("teff in (1, 2)", "not a comparator"),
        ("teff > 5 &", "cannot read"),
        ("teff = 5", "cannot read"),
        ("__import__('os').system('x') > 1", "not allowed"),
        ("eval > 1", "not allowed"),
    ],
)
def test_condition_errors(stars, text, message):
    with pytest.raises(ExpressionError, match=message):
        condition(stars, text)


def test_spellings():
    assert expand_spellings("a<1.and.b.eq.2.or.c>3") == "a<1 & b==2 | c>3"


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("snr / g_mag**2", lambda r: r["snr"] / r["g_mag"] ** 2),
        ("-(ra + 2) * 3 - dec", lambda r: -(r["ra"] + 2) * 3 - r["dec"]),
        ("1e-3 * ra", lambda r: 1e-3 * r["ra"]),
        ("log10(plx)", lambda r: math.log10(r["plx"]) if r["plx"] > 0 else None),
        ("ra / plx", lambda r: r["ra"] / r["plx"] if r["plx"] else None),
        ("sqrt(ra) + arctan2(ra, 2)", lambda r: math.sqrt(r["ra"]) + math.atan2(r["ra"], 2)),
        ("where(ra > 100, ra, dec)", lambda r: r["ra"] if r["ra"] > 100 else r["dec"]),
        ("clip(ra, 50, 100)", lambda r: min(max(r["ra"], 50), 100)),
        ("round(ra / 8)", lambda r: round(r["ra"] / 8)),
        ("floor(dec)", lambda r: math.floor(r["dec"])),
        ("minimum(logg, 1)", lambda r: r["logg"] if math.isnan(r["logg"]) else min(r["logg"], 1)),
        ("floor(logg)", lambda r: r["logg"] if math.isnan(r["logg"]) else math.floor(r["logg"])),
    ],
)
def test_formula(stars, rows, text, value):
    found = {r[0]: r[1] for r in stars.select("gaia_dr3_source_id", formula(stars, text)).collect()}
    for row in rows:
        assert close(found[row["gaia_dr3_source_id"]], value(row), 5), row


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("", "no formula"),
        ("ra ^ 2", r"write '\*\*'"),
        ("ra > 5", "not a comparison"),
        ("nothing + 1", "no column 'nothing'"),
        ("release + 1", "not numeric"),
        ("system(ra)", "no function"),
        ("log10(ra, dec)", "takes 1"),
        ("ra.x", "not allowed"),
        ("[ra for ra in dec]", "not allowed"),
        ("exec(ra)", "not allowed"),
    ],
)
def test_formula_errors(stars, text, message):
    with pytest.raises(ExpressionError, match=message):
        formula(stars, text)


def test_bit_operator_warns(stars, rows):
    with pytest.warns(UserWarning, match="power"):
        value = formula(stars, "zwarning_flags ^ 5")
    found = {r[0]: r[1] for r in stars.select("gaia_dr3_source_id", value).collect()}
    assert found == {r["gaia_dr3_source_id"]: r["zwarning_flags"] ^ 5 for r in rows}


def test_integer_overflow_gives_null(spark):
    df = spark.createDataFrame([(2**62,)], "n bigint")
    assert df.select(formula(df, "n + n + n")).first()[0] is None


def test_formula_names():
    assert formula_names("log10(a) + b*where(c > 1, a, 2)") == {"a", "b", "c"}


def test_computed_columns_cascade(stars):
    columns = ComputedColumns().add(stars, "unit", "ra / snr").add(stars, "square", "unit ** 2")
    columns = columns.add(stars, "third", "square + 1").add(stars, "other", "dec * 2")
    assert columns.dependents("unit") == {"square", "third"}
    assert columns.drop("unit").names == ["other"]
    assert columns.drop("third").names == ["unit", "square", "other"]
    first = columns.apply(stars).where("snr > 0").select("ra", "snr", "unit", "square", "third", "other", "dec").first()
    assert first["square"] == first["unit"] ** 2 and first["third"] == first["square"] + 1


@pytest.mark.parametrize(("name", "text"), [("", "ra"), ("ra", "dec"), ("new", ""), ("new", "ra > 1"), ("new", "x + 1")])
def test_computed_column_errors(stars, name, text):
    with pytest.raises(ExpressionError):
        ComputedColumns().add(stars, name, text)


def test_dropping_unknown_column(stars):
    with pytest.raises(ExpressionError):
        ComputedColumns().drop("nothing")


# Search -----------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("query", "hits"),
    [
        ("foo bar", {1, 2}),
        ("BAR foo", {1, 2}),
        ("a.c", {4}),
        ("ab bc", set()),
        ("a b", {1, 2, 3, 7}),
        ("", set()),
        ("ÉTOILE", {5}),
        ("one two three four five six", {6}),
    ],
)
def test_fuzzy(spark, query, hits):
    texts = ["", "foo and bar", "xbarxfoox", "foo\nbar", "a.c", "une étoile", "six five four three two one", "abc"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert {r["i"] for r in df.where(has_words(F.col("t"), query)).collect()} == hits
    assert set(map(texts.index, matching_names(texts, query))) == hits


def apart(line, words):
    """Brute force: every way to place the words, one after the other."""
    if not words:
        return True
    word, *rest = words
    places = [i for i in range(len(line)) if line.startswith(word, i)]
    return any(apart(line[:i] + "\0" * len(word) + line[i + len(word) :], rest) for i in places)


@pytest.mark.parametrize("n", range(1, 9))
def test_words_apart_as_brute_force(spark, n):
    random = Random(n)
    texts = ["".join(random.choice("ab c\n") for _ in range(random.randint(0, 16 + n))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for _ in range(4):
        words = ["".join(random.choice("abc") for _ in range(random.choice((1, 1, 2, 3)))) for _ in range(n)]
        query = " ".join(words)
        hits = {i for i, t in enumerate(texts) if any(apart(line, words) for line in t.split("\n"))}
        assert {r["i"] for r in df.where(has_words(F.col("t"), query)).collect()} == hits
        assert {i for i, t in enumerate(texts) if text_has_words(t, query)} == hits


def test_seven_words_of_which_two_overlap(spark):
    df = spark.createDataFrame([("abcde f",), ("abc bcd cde a e f",)], "t string")
    assert [r.t for r in df.where(has_words(F.col("t"), "abc bcd")).collect()] == ["abc bcd cde a e f"]
    assert [r.t for r in df.where(has_words(F.col("t"), "abc bcd cde a e f")).collect()] == ["abc bcd cde a e f"]


def test_whole_numbers_are_counted_in_64_bits(spark):
    least, most = -(2**63), 2**63 - 1
    df = spark.createDataFrame([(2_000_000, 3_000, -(2**31), least), (-(2**31), 2, 5, most)], "a int, b int, c int, d bigint")
    def got(text):
        return [r.x for r in df.select(formula(df, text).alias("x")).collect()]

    assert got("a * b") == [6_000_000_000, -(2**32)]
    assert got("a * 10000") == [20_000_000_000, -(2**31) * 10000]
    assert got("-a") == [-2_000_000, 2**31]
    assert got("abs(c)") == [2**31, 5]
    assert got("-d") == [None, -most]
    assert got("abs(d)") == [None, most]


def test_decimals_keep_their_digits(spark):
    df = spark.sql("select cast(x as decimal(10,2)) as d from values (0.05), (0.06), (null) as t(x)")
    def got(text):
        return [str(r.d) for r in df.where(condition(df, text)).collect()]

    assert got("d > 0.055") == ["0.06"]
    assert got("d == 0.05") == ["0.05"]
    assert got("d < 1e12") == ["0.05", "0.06"]
    assert got("d < 1e60") == ["0.05", "0.06"]


def test_quoted_names(spark):
    df = spark.createDataFrame([(1, 2), (3, 4)], ["class", "two words"])
    assert [r[0] for r in df.where(condition(df, "`class` > 1 & `two words` == 4")).collect()] == [3]
    assert [r.x for r in df.select(formula(df, "`class` + `two words`").alias("x")).collect()] == [3, 7]
    assert formula_names("`class` + 1") == {"class"}


def test_identifier_columns_exist(stars):
    assert TARGET_ID in stars.columns
    assert issubclass(ExpressionError, FacetryError)


@pytest.mark.parametrize(
    ("text", "ids"),
    [
        ("a < 1e30", {1, 2}),
        ("a > 1e30", set()),
        ("a > -100000000000000000000", {1, 2}),
        ("a < 9223372036854775808", {1, 2}),
        ("a == 9223372036854775807", {2}),
        ("a < 1e400", {1, 2}),
        ("-1e400 < a <= 1e19", {1, 2}),
        ("x < 1e400", {1, 2}),
        ("c < 1e19", {1, 2}),
        ("c > -1e400", {1, 2}),
        ("c < 1e-400", {1}),
    ],
)
def test_numbers_past_the_range_of_a_column(spark, text, ids):
    rows = [(1, 5, 1.5, Decimal("-1.25")), (2, 2**63 - 1, 2.5, Decimal("7.00")), (3, None, None, None)]
    df = spark.createDataFrame(rows, "id int, a bigint, x double, c decimal(10,2)")
    assert {r["id"] for r in df.where(condition(df, text)).collect()} == ids
    assert {r["id"] for r in df.where(condition(df, text, invert=True)).collect()} == {1, 2} - ids


def test_many_words_in_a_list_of_names():
    words = [f"w{chr(97 + i)}x" for i in range(30)]
    name = " ".join(reversed(words))
    assert matching_names([name, name[3:]], " ".join(words)) == [name]
    assert matching_names(["aa a", "aaa"], "a aa") == ["aa a", "aaa"]
    assert matching_names(["ab ab", "ab"], "ab ab") == ["ab ab"]


def test_too_many_overlapping_words_are_refused(spark):
    words = " ".join("a" * n for n in range(1, 15))
    df = spark.createDataFrame([("a",)], "t string")
    with pytest.raises(FacetryError):
        df.where(has_words(F.col("t"), words))
    with pytest.raises(FacetryError):
        matching_names(["a" * 200], words)
