from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from factloom.functions import names, periods, text, units


# Readings that are required of these strings, here and below; the queries draw others from every vocabulary entry.
@pytest.mark.parametrize(
    ("value", "raw", "expected", "unit"),
    [(3.2, "lakh tonnes", 3.2e5, "t"), (1234.5, "Rs crore", 1.2345e10, "inr"), (2.5, "M.Cum", 2.5e6, "m3"), (9.8, "TPD", 9.8 * 365, "t/yr"), (193, "Figs in Mill Te", 193e6, "t"), (45, "%", 0.45, "fraction"), (1, "kcal/kg", 1, "kcal/kg"), (2, "tonnes per month", 24, "t/yr"), (7, "Depth in m", 7, "m"), (5, "Mm³", 5e6, "m3"), (1, "km²", 100, "ha")],
)
def test_units(value, raw, expected, unit):
    got = units.read(raw)
    assert value * got.factor == pytest.approx(expected) and got.unit == unit


@pytest.mark.parametrize("raw", ["", "zzz", "wibbles", "tonnes/hectare", "Figs in Miil Te", "Rs per year"])
def test_refused_units(raw):
    with pytest.raises(units.UnknownUnit):
        units.read(raw)


def test_bare_mt():
    assert units.read("MT") == ("t", "mass", 1e6, True) and units.read("MT", metric_tonne=True).factor == 1.0


@pytest.mark.parametrize(
    ("raw", "label", "kind", "start", "end"),
    [
        ("FY2024-25", "FY2024-25", "fiscal_year", date(2024, 4, 1), date(2025, 3, 31)), ("2024-25", "FY2024-25", "fiscal_year", date(2024, 4, 1), date(2025, 3, 31)), ("F.Y. 24-25", "FY2024-25", "fiscal_year", date(2024, 4, 1), date(2025, 3, 31)),
        ("Q3 FY24-25", "Q3 FY2024-25", "fiscal_quarter", date(2024, 10, 1), date(2024, 12, 31)), ("H2 2024-25", "H2 FY2024-25", "fiscal_half", date(2024, 10, 1), date(2025, 3, 31)), ("APR'24 - SEP'24", "H1 FY2024-25", "fiscal_half", date(2024, 4, 1), date(2024, 9, 30)),
        ("Apr 2024 to Mar 2025", "FY2024-25", "fiscal_year", date(2024, 4, 1), date(2025, 3, 31)), ("APR'23 - AUG'23", "Apr 2023 - Aug 2023", "month_range", date(2023, 4, 1), date(2023, 8, 31)), ("AUG'23", "Aug 2023", "month", date(2023, 8, 1), date(2023, 8, 31)),
        ("as on 31.03.2025", "as on 2025-03-31", "as_on", date(2025, 3, 31), date(2025, 3, 31)), ("2024", "2024", "calendar_year", date(2024, 1, 1), date(2024, 12, 31)), ("FY2025", "FY2024-25", "fiscal_year", date(2024, 4, 1), date(2025, 3, 31)), ("fy25", "FY2024-25", "fiscal_year", date(2024, 4, 1), date(2025, 3, 31)), ("1999-00", "FY1999-00", "fiscal_year", date(1999, 4, 1), date(2000, 3, 31)),
    ],
)
def test_periods(raw, label, kind, start, end):
    got = periods.read(raw)
    assert (got.label, got.kind, got.start, got.end) == (label, kind, start, end)
    assert (got.fiscal_year is None) == (kind == "calendar_year")


@pytest.mark.parametrize("raw", ["", "no year", "2024-27", "AUG'23 - APR'23", "Jan 2023 - Jun 2023", "as on 31.02.2025"])
def test_refused_periods(raw):
    assert periods.attempt(raw) is None


def test_comparable():
    p = periods.read
    assert periods.comparable(p("FY2023-24"), p("FY2024-25"))[0]
    assert not any(periods.comparable(p(a), p(b))[0] for a, b in (("2024", "FY2024-25"), ("Q1 2024-25", "FY2024-25"), ("as on 1.4.2024", "as on 1.4.2025")))


def test_runs_of_months():
    runs, rest = periods.month_runs("APR'23 - AUG'23 and Aug 2023, then apr-22 to sep-22")
    assert [(a.label, b.label) for a, b in runs] == [("Apr 2023", "Aug 2023"), ("Apr 2022", "Sep 2022")] and periods.attempt(rest).label == "Aug 2023"
    assert periods.month_runs("no run in Aug 2023") == ([], "no run in aug 2023")


def named(spark, raws, what="entity"):
    """Readings of names, by name."""
    df = spark.createDataFrame([(r,) for r in raws], "raw string")
    return {r.raw: (r.id, r.score) for r in names.lookup(df, "raw", what).collect()}


def test_entities(spark):
    # every spelling of every organisation, also in capitals, without spaces and with a legal form
    want = {form: e.entity_id for e in names.ENTITIES for form in (e.code, e.name, *e.aliases)}
    want |= {form.upper(): i for form, i in want.items()} | {form.replace(" ", ""): i for form, i in want.items() if not {"&", *names.LEGAL} & set(form.lower().split())} | {f"The {form} Pvt. Ltd.": i for form, i in want.items()}
    want |= {"S.E.C.L.": "secl", "n-l-c india": "nlcil"}
    assert named(spark, want) == {form: (i, 1.0) for form, i in want.items()}


def test_fuzzy_entities(spark):
    got = named(spark, ["Mahanadi Coalfeilds Limited", "Atlantis Coal Corp", "", "Ltd", "bharat cokng coal"])
    assert got["Mahanadi Coalfeilds Limited"][0] == "mcl" and 0.87 <= got["Mahanadi Coalfeilds Limited"][1] < 1 and got["bharat cokng coal"][0] == "bccl"
    assert got["Atlantis Coal Corp"] == got[""] == got["Ltd"] == (None, None)
    rows = column(spark, ["secl", "cil", "sccl", "x"], names.group_of)
    assert rows == ["cil", "cil", None, None] and column(spark, ["secl", "moc"], names.code_of) == ["SECL", "MoC"]


def test_metrics(spark):
    plain = {alias: next(n.key for n in names.METRICS if alias in n.aliases) for m in names.METRICS for alias in m.aliases if alias.replace(" ", "").isalnum()}
    want = plain | {f"  {alias.upper()} (Million Tonnes) ": key for alias, key in plain.items()} | {f"Total {alias} during the year": key for alias, key in plain.items()}
    want |= {"Total off-take": None, "production cost": None, "Gross Sales (Rs crore)": "revenue", "": None, "(stock)": None, "Réserves géologiques": None, "Côal stóck": "coal_stock", "share of geological reserves left": "geological_reserves"}
    assert {r: i for r, (i, _) in named(spark, want, "metric").items()} == want
    assert column(spark, ["coal_stock", "revenue"], names.dimension) == ["mass", "money"]


def test_lookups(spark):
    df = spark.createDataFrame([(2.0, "MT"), (3.0, "zzz"), (4.0, None)], "raw_value double, raw_unit string")
    got = {r.raw_unit: (r.value, r.unit, r.unit_ambiguous) for r in units.normalize(df).collect()}
    assert got == {"MT": (2e6, "t", True), "zzz": (None, None, None), None: (None, None, None)}
    odd = units.normalize(spark.createDataFrame([(float("nan"), "t"), (float("-inf"), "t"), (1e305, "MT"), (1.0, None), (2.0, "t")], "raw_value double, raw_unit string"))
    assert sorted((r.fault or "", r.value or 0.0) for r in odd.collect()) == [("", 2.0), ("not_finite", 0.0), ("not_finite", 0.0), ("overflow", 0.0), ("unknown_unit", 0.0)]
    labels = spark.createDataFrame([("FY2024-25",), ("x",)], "p string")
    assert {r.raw: r.label for r in periods.lookup(labels, "p").collect()} == {"FY2024-25": "FY2024-25", "x": None}
    assert {r.raw: r.id for r in names.lookup(labels, "p").collect()} == {"FY2024-25": None, "x": None}


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_numbers(spark):
    got = column(spark, ["1,23,456.78", "(1,234)", "45%", "63 5", "-", "n.a.", "12.5*", "28't.5", "", None, "-3", ".5"], text.parse_number)
    assert got == [123456.78, -1234.0, 45.0, None, None, None, 12.5, None, None, None, -3.0, 0.5]
    assert column(spark, ["Production (MT)", "A (12) (Rs crore)", "none"], text.unit_in) == ["MT", "Rs crore", None]
    assert column(spark, [1234567.891, -0.001, 999.995, None, 100.0, -12345.5], lambda c: text.indian(c, 2), "double") == ["12,34,567.89", "0.00", "1,000.00", None, "100.00", "-12,345.50"]


def test_display(spark):
    assert column(spark, ["coal_stock"], text.humanize) == ["Coal stock"] and column(spark, ["secl", "long_name"], text.entity_label) == ["SECL", "Long name"]
    assert column(spark, [193e6, 250000.0, 12.0, -1.5e6, 1234.567], text.tonnes, "double") == ["193 MT", "2.5 lakh t", "12 t", "-1.5 MT", "1,234.57 t"]
    assert column(spark, [2.5e7, 3.4e6, 2e5, 4200.0, 12.0], text.tick, "double") == ["2.5 cr", "3M", "2 L", "4k", "12"]
    assert column(spark, [2.5e7, 3.4e5, 12.5], lambda c: text.shown(c, F.lit("inr")), "double") == ["\u20b92.5 crore", "\u20b93.4 lakh", "\u20b912.5"]
    assert column(spark, [2e6], lambda c: text.shown(c, F.lit("t/yr")), "double") == ["2 MT/yr"] and column(spark, [0.4567], lambda c: text.shown(c, F.lit("fraction")), "double") == ["45.67%"] and column(spark, [1500.0], lambda c: text.shown(c, F.lit("m3")), "double") == ["1,500 m3"]
    assert column(spark, [0.256], text.percent, "double") == ["26%"] and column(spark, [500, 2048, 3 << 20], text.bytes_size, "long") == ["500 B", "2 KB", "3.0 MB"] and column(spark, [47, 240, 7200, 259200, -3], text.duration, "long") == ["47 s", "4 min", "2 h", "3 d", "0 s"]
    assert column(spark, [datetime(2025, 3, 31, 20, 0)], text.india_stamp, "timestamp") == ["2025-04-01T01:30:00+05:30"]
    assert column(spark, ["A cat sat."], lambda c: text.fill("<{{x}}>", x=c)) == ["<A cat sat.>"]


def test_verified(spark):
    prose = "Output was 193 in 2024. It rose by 7%. It fell by 8%."
    assert column(spark, [prose], lambda c: text.verified(c, F.array(F.lit(193.0), F.lit(7.0)))) == ["Output was 193 in 2024. It rose by 7%."]


def test_html(spark):
    page = "<html><script>x<y</script><p>A &amp; B</p> <a class=z href='/c'>c</a><a href=\"d?e#f\">d</a></html>"
    assert column(spark, [page], text.strip_html) == ["A & B c d"]
    assert column(spark, [page], text.links) == [["/c", "d?e"]]
    assert column(spark, ["/c", "d", "//h/x", "http://o/"], lambda c: text.absolute(F.lit("http://a.b.co.in/p/q?r"), c)) == ["http://a.b.co.in/c", "http://a.b.co.in/p/d", "http://h/x", "http://o/"]
    assert column(spark, ["http://a.b.co.in/p", "https://www.x.org"], text.site) == ["b.co.in", "x.org"]
    assert column(spark, [bytearray(b"%PDF-1.7"), bytearray(b"PK\x03\x04.."), bytearray(b"??")], text.sniff, "binary") == ["pdf", "zip", None]


def test_layers(spark):
    pages = ["TI-IE TI-IE mine", "1 2 3\n4 .5\n6 7", "a clean page 12 345", "", None]
    assert column(spark, pages, text.recognised_layer) == [True, True, False, False, False]
