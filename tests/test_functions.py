import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pulsegrid import vocab
from pulsegrid.functions import classify, clean, geo
from pulsegrid.functions import text as txt


def one(spark, column, **values):
    ddl = ", ".join(f"{k} {t}" for k, (_, t) in values.items())
    df = spark.createDataFrame([tuple(v for v, _ in values.values())], ddl)
    return df.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "text, expected",
    [("Ja", True), ("yes", True), ("NEIN", False), ("no", False), ("unbekannt", None), ("", None), (None, None)],
)
def test_yes_no(spark, text, expected):
    assert one(spark, clean.yes_no(F.col("a")), a=(text, "string")) is expected


@pytest.mark.parametrize(
    "text, expected",
    [("12", 12.0), (" 3.5 ", 3.5), ("-1e2", -100.0), (".5", 0.5), ("n/a", None), ("12d", None), ("", None), (None, None)],
)
def test_to_number(spark, text, expected):
    assert one(spark, clean.to_number(F.col("a")), a=(text, "string")) == expected


@pytest.mark.parametrize(
    "day, clock, expected",
    [
        ("2025-02-01", "10:11:12", dt.datetime(2025, 2, 1, 10, 11, 12)),
        ("01.02.2025", "10:11", dt.datetime(2025, 2, 1, 10, 11)),
        (" 1.2.2025 ", " 07:00:00 ", dt.datetime(2025, 2, 1, 7)),
        ("01.02.2025", "", None),
        ("01.02.2025", "  ", None),
        ("2025-02-01", " ", None),
        ("", "10:11", None),
        (None, "10:11", None),
        ("31.02.2025", "10:11", None),
        ("2025-02-01", "k.A.", None),
    ],
)
def test_to_status_time(spark, day, clock, expected):
    got = one(spark, clean.to_status_time(F.col("d"), F.col("t")), d=(day, "string"), t=(clock, "string"))
    assert got == expected


def test_durations_keep_microseconds(spark):
    a, b = dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 1, 1, 0, 0, 1)
    values = {"a": (a, "timestamp_ntz"), "b": (b, "timestamp_ntz")}
    assert one(spark, clean.micros_between(F.col("a"), F.col("b")), **values) == 3_600_000_001
    assert one(spark, clean.hours_between(F.col("a"), F.col("b")), **values) == pytest.approx(1)


@pytest.mark.parametrize(
    "ts, name, group, week",
    [
        (dt.datetime(2025, 6, 1, 23, 59), "Sunday", "Sun", dt.datetime(2025, 5, 26)),
        (dt.datetime(2025, 6, 2, 0, 0), "Monday", "Mon-Thu", dt.datetime(2025, 6, 2)),
        (dt.datetime(2025, 6, 5), "Thursday", "Mon-Thu", dt.datetime(2025, 6, 2)),
        (dt.datetime(2025, 6, 6), "Friday", "Fri", dt.datetime(2025, 6, 2)),
        (dt.datetime(2025, 6, 7), "Saturday", "Sat", dt.datetime(2025, 6, 2)),
    ],
)
def test_weekdays(spark, ts, name, group, week):
    value = {"t": (ts, "timestamp_ntz")}
    assert one(spark, clean.weekday_name(F.col("t")), **value) == name
    assert one(spark, clean.weekday_group(F.col("t")), **value) == group
    assert one(spark, clean.week_start(F.col("t")), **value) == week
    assert one(spark, clean.month_start(F.col("t")), **value) == dt.datetime(2025, 6, 1)
    assert one(spark, clean.month_label(F.col("t")), **value) == "2025-06"


def test_within_days_includes_the_last_day(spark):
    inside = clean.within_days(F.col("t"), "2025-01-01", "2025-12-31")
    assert one(spark, inside, t=(dt.datetime(2025, 12, 31, 23, 59, 59), "timestamp_ntz")) is True
    assert one(spark, inside, t=(dt.datetime(2026, 1, 1), "timestamp_ntz")) is False


@pytest.mark.parametrize(
    "text, kind", [
        ("01.01.2023", "date"), ("1.2.25", "date"), ("am 1.12.2024 früh", "date"), ("00:50:00", "time"), ("1.1.", "other"),
        ("bald", "other"), ("v1.2.3456", "date"), ("  ", None), (None, None),
    ],
)
def test_onset_kind(spark, text, kind):
    assert one(spark, clean.onset_kind(F.col("a")), a=(text, "string")) == kind


def test_strip_takes_every_whitespace(spark):
    assert one(spark, clean.strip(F.col("a")), a=(" \t a b \r\n ", "string")) == "a b"
    assert one(spark, clean.fold(F.col("a")), a=("  NordKlinik\n", "string")) == "nordklinik"


@pytest.mark.parametrize(
    "sign, kind",
    [("12-83-1", "RTW"), ("12-85-1", "S-KTW"), ("12-85-14", "S-KTW"), ("12-85-2", "12-85-2"), (None, "Unbekannt")],
)
def test_vehicle_type(spark, sign, kind):
    assert one(spark, classify.vehicle_type(F.col("a")), a=(sign, "string")) == kind


@pytest.mark.parametrize(
    "text, category",
    [
        ("S-KTW - Transport", 0), ("s-ktw - kein transport", 1), ("KTW Kein-Transport", 1), ("S-KTW Sonder", 2),
    ],
)
def test_mission_category(spark, text, category):
    got = one(spark, classify.mission_category(F.col("a")), a=(text, "string"))
    assert got == vocab.MISSION_CATEGORIES[category]


@pytest.mark.parametrize(
    "text, hit",
    [("KTW", True), ("ktw - Transport", True), ("S-KTW - Transport", False), ("RTW / KTW", False), ("KTWs", False), (None, False)],
)
def test_word_match(spark, text, hit):
    rule = classify.word_match(F.col("a"), "ktw", no_words=["rtw"], no_parts=["s-ktw"])
    assert one(spark, rule, a=(text, "string")) is hit


@pytest.mark.parametrize("text, hit", [("STEMI", True), ("nSTEMI", False), (None, False), ("Infarkt", False)])
def test_term_match_with_exclusion(spark, text, hit):
    assert one(spark, classify.term_match(F.col("a"), ["stemi"], ["nstemi"]), a=(text, "string")) is hit


@pytest.mark.parametrize(
    "text, category",
    [
        ("unklare Initialdiagnose", vocab.CAP_STROKE),  # holds "tia" inside a word
        ("NSTEMI", vocab.CAP_CARDIAC),
        ("Herz-Kreislauf-Stillstand", vocab.CAP_ARREST),
        ("Schwerverletzt nach Schlaganfall", vocab.CAP_STROKE),
        ("Fraktur", None),
        (None, None),
    ],
)
def test_first_category(spark, text, category):
    got = one(spark, classify.first_category(F.col("a"), vocab.TRAUMA_KEYWORDS), a=(text, "string"))
    assert got == category


def labels(spark, text):
    df = spark.createDataFrame([(text,)], "a string").withColumn("f", F.lower("a"))
    return df.select(*[c.alias(n) for n, c in classify.requirement_columns(F.col("f")).items()]).first().asDict()


def test_requirement_classifier_first_group_wins(spark):
    got = labels(
        spark,
        "Es ist keine medizinische Betreuung notwendig geworden, sondern lediglich eine logistische Betreuung. "
        "Keine besondere Ausstattung KTW. Isolierung notwendig, Krankenfahrt.",
    )
    assert got == {
        "medical_care": "nicht_indiziert",
        "ktw_equipment": "nicht_indiziert",
        "infectious_disease": "indiziert",
        "crew_assessment": None,
        "krankenfahrt_mentioned": True,
    }


def test_requirement_classifier_null_text(spark):
    got = labels(spark, None)
    assert got.pop("krankenfahrt_mentioned") is False
    assert set(got.values()) == {None}


def test_requirement_classifier_declared_labels_only(spark):
    texts = [p for rules in vocab.REQUIREMENT_RULES.values() for _, ps in rules for p in ps]
    df = spark.createDataFrame([(t,) for t in texts], "f string")
    got = df.select(*[c.alias(n) for n, c in classify.requirement_columns(F.col("f")).items()]).collect()
    for name, rules in vocab.REQUIREMENT_RULES.items():
        assert {r[name] for r in got} <= {None, *[label for label, _ in rules]}


def test_basic_classifier_is_case_sensitive(spark):
    rules = vocab.BASIC_REQUIREMENT_RULES["infectious_disease"]
    phrase = rules[2][1][0]
    df = spark.createDataFrame([(phrase,), (phrase.upper(),), (None,)], "a string")
    got = [r[0] for r in df.select(classify.basic_requirement_columns(F.col("a"))["infectious_disease"]).collect()]
    assert got == ["local_protection", None, None]


@pytest.mark.parametrize(
    "text, bucket",
    [
        ("NEF keine Versorgung", "nef (no transport)"), ("S-KTW kein Transport", "ktw (no transport)"),
        ("S-KTW - Transport", "s-ktw"), ("RTW - Transport", "rtw"), ("Dienstfahrt", "other"), (None, "other"),
    ],
)
def test_display_bucket(spark, text, bucket):
    assert one(spark, classify.display_bucket(F.col("a")), a=(text, "string")) == bucket


def test_legend_order(spark):
    types = ["KTW kein Transport", "S-KTW B", "S-KTW - kein A", "RTW", "RTW ohne", "NEF kein", "NEF", "Dienstfahrt", "KTW"]
    df = spark.createDataFrame([(t,) for t in types], "a string")
    key = classify.mission_sort_key(F.col("a"))
    got = [r["a"] for r in df.orderBy(key).collect()]
    assert got == ["NEF", "NEF kein", "RTW", "RTW ohne", "S-KTW - kein A", "S-KTW B", "KTW", "KTW kein Transport", "Dienstfahrt"]


def test_utm_round_trip(spark):
    """Against a forward series of the same projection."""
    import math

    n = geo.FLATTENING / (2 - geo.FLATTENING)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]

    def forward(lat, lon):
        phi, lam = math.radians(lat), math.radians(lon - geo.CENTRAL_MERIDIAN)
        e = 2 * math.sqrt(n) / (1 + n)
        t = math.sinh(math.atanh(math.sin(phi)) - e * math.atanh(e * math.sin(phi)))
        xi, eta = math.atan2(t, math.cos(lam)), math.atanh(math.sin(lam) / math.sqrt(1 + t * t))
        k = geo.SCALE * geo.RECTIFYING_RADIUS
        north = k * (xi + sum(a * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, a in enumerate(alpha, 1)))
        east = k * (eta + sum(a * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, a in enumerate(alpha, 1)))
        return east + geo.FALSE_EASTING, north

    points = [(lat, lon) for lat in (47.0, 50.5, 54.5, 55.0) for lon in (6.0, 9.0, 9.55, 12.0)]
    df = spark.createDataFrame([(*forward(*p), *p) for p in points], "x double, y double, lat double, lon double")
    lat, lon = geo.utm32_to_wgs84(F.col("x"), F.col("y"))
    for r in df.select(lat.alias("a"), lon.alias("b"), "lat", "lon").collect():
        assert r["a"] == pytest.approx(r["lat"], abs=2e-8)
        assert r["b"] == pytest.approx(r["lon"], abs=2e-8)


def test_labels_are_those_of_the_first_rule_that_holds(spark):
    """Texts of whole phrases, cut phrases and phrases within others, against a plain search rule by rule."""
    rng = random.Random(4)
    for rules in [*vocab.REQUIREMENT_RULES.values(), *vocab.BASIC_REQUIREMENT_RULES.values()]:
        phrases = [p for _, own in rules for p in own]
        assert all(any(w in p for w in classify.covering_words(phrases)) for p in phrases)
        texts = [None, "", "nichts davon", *phrases]
        texts += [" und ".join(rng.sample(phrases, 2)) if len(phrases) > 1 else phrases[0][1:] for _ in range(20)]
        texts += [p[: len(p) // 2] for p in phrases] + ["vor " + p + " nach" for p in phrases]
        want = [t and next((name for name, own in rules if any(p in t for p in own)), None) or None for t in texts]
        df = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
        got = df.select("n", classify.first_label(F.col("t"), rules).alias("label")).orderBy("n").collect()
        assert [r.label for r in got] == want


def parsed(spark, answer):
    df = spark.createDataFrame([(answer,)], "answer string").withColumn("p", F.reverse(txt.answer_pairs(F.col("answer"))))
    return df.select(*[c.alias(n) for n, c in txt.answer_columns(F.col("p.key"), F.col("p.value")).items()]).first().asDict()


def test_answer_parse(spark):
    got = parsed(
        spark,
        "\n```text\n```\nUEBERGRIF_VORHANDEN: [ja]\nuebergrif_art : verbal: laut\r\nohne Trenner\n"
        "HILFEBEDARF_TYP: a\nHILFEBEDARF_TYP: [ b ]\nVERWEIGERUNG_MASSNAHME: - Liste\n"
        "VERWEIGERUNG_BEGRUENDUNG: **fett**\nAUFFAELLIGKEITEN_VORHANDEN: [\n```\nUEBERGRIF_VORHANDEN: nein",
    )
    assert got["übergriff_vorhanden"] == "ja"
    assert got["übergriff_art"] == "verbal: laut"
    assert got["hilfebedarf_typ"] == "b"
    assert got["verweigerung_massnahme"] == "" and got["verweigerung_begruendung"] == ""
    assert got["auffaelligkeiten_vorhanden"] == "["
    assert got["medizinisches_problem_kategorie"] == ""
    assert len(got) == 12


@pytest.mark.parametrize("answer", [None, "", "```", "```\n```", "kein Format"])
def test_answer_parse_without_fields(spark, answer):
    assert set(parsed(spark, answer).values()) == {""}


def test_pick_text_and_preview(spark):
    pick = txt.pick_text([F.col("a"), F.col("b")], [F.col("c")])
    values = {"a": ("", "string"), "b": (None, "string"), "c": ("  länger als zehn  ", "string")}
    assert one(spark, pick, **values) == "länger als zehn"
    assert one(spark, pick, a=("Sturz", "string"), b=("langer Text", "string"), c=("länger als zehn", "string")) == "Sturz"
    assert one(spark, pick, a=(" \n", "string"), b=("kurz", "string"), c=("länger als zehn", "string")) == "kurz"
    assert one(spark, pick, a=(" ", "string"), b=(None, "string"), c=("", "string")) is None
    assert one(spark, txt.preview(F.col("a")), a=("x" * 101, "string")) == "x" * 100 + "..."
    assert one(spark, txt.preview(F.col("a")), a=("x" * 100, "string")) == "x" * 100


def test_prompt_holds_the_whole_text(spark):
    got = one(spark, txt.prompt(F.col("a")), a=("Text mit {text} und $1", "string"))
    head, tail = vocab.PROMPT.split("{text}")
    assert got == head + "Text mit {text} und $1" + tail


def test_status_texts_are_read_alike_in_and_out_of_large_projections(spark):
    """Odd texts against the split into parts, and a plan that keeps the parsing out of the one method of a stage."""
    days = ["2025-06-01", " 01.06.2025 ", "1.6.2025", "01.06", "01.06.2025.9", ".06.2025", "1..2025", "2020-01-01 10:00:00.5", "01.06.2025\n", "", "x", None]
    times = ["10:00", " 10:00:07\t", "+10:00", "25:00", "", "  ", None]
    df = spark.createDataFrame([(d, t) for d in days for t in times], "d string, t string")
    day, time = F.trim("d"), clean.strip(F.col("t"))
    parts = [F.split_part(day, F.lit("."), F.lit(k)) for k in (3, 2, 1)]
    iso = F.when(F.contains(day, F.lit(".")), F.concat_ws("-", *parts)).otherwise(day)
    plain = F.when(time != "", F.concat(iso, F.lit(" "), time).try_cast("timestamp_ntz"))
    read = df.select(clean.to_status_time(F.col("d"), F.col("t")).alias("read"), plain.alias("plain")).collect()
    assert [r["read"] for r in read] == [r["plain"] for r in read] and sum(r["read"] is not None for r in read) >= 8
    many = df.select(*[clean.to_status_time(F.concat("d", F.lit(k)), F.col("t")).alias(k) for k in ("", " ", "  ")])
    parsing = [line for line in many._jdf.queryExecution().executedPlan().toString().splitlines() if "try_cast" in line]
    assert parsing and not any("*(" in line for line in parsing)
