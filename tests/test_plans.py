import datetime as dt

import pytest
from pyspark.sql import functions as F

from pulsegrid import schemas, vocab
from pulsegrid.plans import anamnesis, coverage, destination, fleet, intervals, linkage, located, mission_mix, requirements
from pulsegrid.sources import collections, items, reference

DAY = dt.datetime(2025, 3, 3, 8)  # a Monday


def at(minutes):
    return DAY + dt.timedelta(minutes=minutes)


def index(frame, rows, columns):
    return collections.conform(frame(rows, columns), "index")


def details(frame, protocols):
    """Protocol id to minutes of alarm, status 4, 7, 8; None leaves the texts blank."""
    out = []
    for protocol, stops in protocols:
        content = {f"{p}Status{c}": None for c in schemas.STATUS_CODES for p in ("date", "time")}
        for code, minutes in zip(("Alarm", "4", "7", "8"), stops):
            if minutes is not None:
                content[f"dateStatus{code}"] = at(minutes).strftime("%d.%m.%Y")
                content[f"timeStatus{code}"] = at(minutes).strftime("%H:%M:%S")
        out.append((protocol, (*content.values(), None, None, None)))
    return frame(out, schemas.DETAILS)


@pytest.fixture()
def polytrauma(frame):
    types = "protocolId string, missionType string, leadingDiagnosis string, missionDate timestamp_ntz"
    missions = index(
        frame,
        [
            ("a", "Pauschale RTW", "Polytrauma", DAY), ("b", "RTW - Transport", "polytrauma links", DAY),
            ("c", "Pauschale RTW", "Polytrauma", DAY), ("d", "KTW", "Polytrauma", DAY),
            ("e", "Pauschale RTW", "Sepsis", DAY), ("f", "Pauschale RTW", "Polytrauma", DAY),
            ("g", "Pauschale RTW", "Polytrauma", dt.datetime(2020, 1, 1)), ("h", None, None, dt.datetime(2024, 1, 1)),
        ],
        types,
    )
    stops = [
        ("a", (0, 10, 30, 50)), ("b", (0, None, 40, 70)), ("c", (0, 10, 5, 60)), ("d", (0, 1, 2, 3)),
        ("e", (0, 1, 2, 3)), ("f", (0, 10, 20, None)), ("g", (0, 1, 2, 3)), ("x", (0, 1, 2, 3)),
    ]
    return intervals.cohort_intervals(missions, details(frame, stops), vocab.COHORT_TERMS["polytrauma"])


def test_interval_report(polytrauma, rows):
    # c has a reversed status and goes; f keeps its null interval; d, e, g, x are no cohort members.
    assert rows(polytrauma, "protocolId") == [("a",), ("b",), ("f",)]
    table = {r["interval"]: r for r in intervals.percentile_table(polytrauma).collect()}
    assert table["PraehospitalIntervall"]["n"] == 2
    assert table["PraehospitalIntervall"]["p50"] == pytest.approx(60)
    assert table["ReaktionsIntervall"]["n"] == 1
    share = intervals.target_share(polytrauma).first()
    assert (share["n"], share["median_delta"], share["share_within"]) == (2, pytest.approx(0), 50.0)
    parts = {r["interval"]: (r["mean_minutes"], r["share"]) for r in intervals.process_shares(polytrauma).collect()}
    assert parts == {
        "ReaktionsIntervall": (10, pytest.approx(20)), "VersorgungsIntervall": (20, pytest.approx(40)),
        "TransportIntervall": (20, pytest.approx(40)),
    }
    month = intervals.monthly_trend(polytrauma).first()
    assert (month["month"], month["n"], month["p25"]) == (dt.datetime(2025, 3, 1), 2, pytest.approx(55))
    assert intervals.long_form(polytrauma, ["protocolId"]).count() == 6
    report = {r["statistic"]: r["PraehospitalIntervall"] for r in intervals.percentile_report(polytrauma).collect()}
    assert report["p50"] == 60.0 and set(report) == set(intervals.PERCENTILE_NAMES)


def test_interval_report_of_nothing(polytrauma):
    none = polytrauma.where("false")
    assert intervals.percentile_table(none).count() == 0
    assert intervals.process_shares(none).count() == 0


def test_head_injury_cohort_needs_the_score(frame, rows):
    missions = index(
        frame,
        [(p, "Pauschale RTW", "Schädel-Hirn-Trauma", DAY) for p in "abcd"],
        "protocolId string, missionType string, leadingDiagnosis string, missionDate timestamp_ntz",
    )
    scores = {"a": ("8", "eb_neuro"), "b": ("9", "eb_neuro"), "c": ("8", "ue_neuro"), "d": ("x", "eb_neuro")}
    findings = frame(
        [(p, p, None, [("GCS", v, None, kind, None, None)]) for p, (v, kind) in scores.items()], schemas.FINDINGS
    )
    stops = details(frame, [(p, (0, 1, 2, 3)) for p in "abcd"])
    assert rows(intervals.head_injury_intervals(missions, stops, findings), "protocolId") == [("a",)]


def test_monitoring_coverage(frame):
    missions = index(
        frame, [("a", "RTW-Transport"), ("a", "Pauschale RTW"), ("b", "Pauschale RTW"), ("c", "KTW")],
        "protocolId string, missionType string",
    )
    twice = frame([("a",), ("a",), ("b",), (None,), ("c",), ("c",)], "protocolId string")
    got = coverage.monitoring_coverage(missions, {"gcs": twice, "bd": twice.limit(0)})
    assert {r["kind"]: r["percent"] for r in got.collect()} == {"gcs": 50.0, "bd": 0.0, "all": 0.0}


def test_glucose_when_unconscious(frame, rows):
    scores = frame(
        [("a", 14.0, "eb_neuro"), ("a", 3.0, "eb_neuro"), ("b", 0.0, "eb_neuro"), ("c", 15.0, "eb_neuro"),
         ("d", 8.0, "ue_neuro"), ("e", 9.0, "eb_neuro")],
        "protocolId string, value_num double, type string",
    )
    glucose = frame([("a", 90.0), ("a", 95.0), ("e", 0.0), ("c", 100.0)], "protocolId string, value double")
    assert rows(coverage.glucose_when_unconscious(scores, glucose)) == [(2, 1, 50.0)]
    detail = rows(coverage.glucose_detail(scores, glucose), "protocolId", "value_num", "bz_count", "bz_min", "bz_max")
    assert detail == [("a", 14.0, 2, 90.0, 95.0), ("a", 3.0, 2, 90.0, 95.0), ("e", 9.0, 0, None, None)]
    assert rows(coverage.glucose_when_unconscious(scores.where("false"), glucose)) == [(0, 0, 0.0)]


def test_cohort_share_denominators(frame, rows):
    cases = index(
        frame, [("a", "V.a. ACS", "Pauschale NEF"), ("a", "ACS", "Pauschale RTW"), ("b", "Angina", "Pauschale RTW"),
                ("c", "ACS", "KTW"), ("d", None, "Pauschale RTW")],
        "protocolId string, leadingDiagnosis string, missionType string",
    )
    ecgs = frame([("a", True), ("a", True), ("c", True)], "protocolId string, performed boolean")
    assert [tuple(r)[:2] for r in coverage.ecg_in_chest_pain(cases, ecgs).collect()] == [(3, 1)]
    assert [tuple(r) for r in coverage.ecg_in_chest_pain(cases, ecgs, "distinct").collect()] == [(2, 1, 50.0)]
    flags = coverage.cohort_flags(coverage.chest_pain_cases(cases), ecgs)
    assert rows(coverage.flag_summary(flags)) == [("Ja", 1), ("Nein", 1)]
    assert coverage.cohort_detail(coverage.chest_pain_cases(cases), ecgs).count() == 3
    with pytest.raises(ValueError):
        coverage.ecg_in_chest_pain(cases, ecgs, "x")


def test_pain_relief(frame, rows):
    pain = frame(
        [("a", 8.0, at(0)), ("a", 4.0, at(9)), ("b", 9.0, at(0)), ("b", 7.0, at(1)), ("c", 6.0, at(0)), ("c", 5.0, at(1)),
         ("d", 4.0, at(0)), ("e", None, at(0))],
        "protocolId string, value_num double, timestamp timestamp_ntz",
    )
    assert rows(coverage.pain_relief(pain), "cases", "with_measure") == [(3, 2)]


def test_destination(spark, frame, rows):
    hospitals = frame(
        [(0, ["Nordklinik", "ZNA Nord"], False, True, False, True), (1, ["Westklinik", "nordklinik"], True, False, True, False)],
        "row bigint, names array<string>, " + ", ".join(f"`{c}` boolean" for c in vocab.CAPABILITIES),
    )
    variants = reference.name_variants(hospitals)
    missions = index(
        frame,
        [("a", "NORDKLINIK Haus 3", "Schlaganfall"), ("b", "nord", "STEMI"), ("c", "  ", "STEMI"), ("d", "Westklinik", "STEMI"),
         ("e", None, "STEMI"), ("f", "Westklinik", "Fraktur"), ("g", "Praxis", "TIA"), ("h", "zna nord", "Polytrauma")],
        "protocolId string, targetDestination string, leadingDiagnosis string",
    )
    got = destination.mark_eligible(missions, variants, vocab.TRAUMA_KEYWORDS)
    # "nordklinik" keeps its first place and takes the capabilities of its last mention.
    assert rows(got.where("hospital_eligible"), "protocolId") == [("a",), ("h",)]
    assert got.count() == 8
    assert rows(destination.eligibility_share(got)) == [(8, 2, 25.0, -75.0)]
    rea = frame([("a", True, "Westklinik"), ("b", False, "Westklinik"), ("c", True, None)], "protocolId string, rea_status boolean, targetDestination string")
    assert rows(destination.resuscitation_cases(rea, variants), "protocolId", "hospital_eligible") == [("a", True), ("c", False)]


def test_mission_mix(frame, rows):
    missions = index(
        frame,
        [("a", "X", "1", "2", at(0), "Krankentransport"), ("b", "X", "1", "3", at(24 * 60), "Krankentransport RTW"), ("c", "Y", "9", "2", at(0), None)],
        "protocolId string, patientCity string, patientStreet string, patientHouseNumber string, alarmTime timestamp_ntz, staticMissionType string",
    )
    assert rows(mission_mix.missions_at(missions, city="X", first_day="2025-03-03", last_day="2025-03-03"), "protocolId") == [("a",)]
    assert rows(mission_mix.patient_transports(missions), "protocolId") == [("a",)]
    assert rows(mission_mix.address_options(missions, city="X")) == [
        ("patientCity", "X"), ("patientCity", "Y"), ("patientHouseNumber", "2"), ("patientHouseNumber", "3"), ("patientStreet", "1"),
    ]


def linked_tables(frame):
    missions = index(
        frame, [("a", "1", "D1"), ("b", "1", "D2"), ("c", "2", "D1"), ("d", None, "D1"), ("e", "9", None)],
        "protocolId string, missionNumber string, leadingDiagnosis string",
    )
    dispatch = collections.conform(
        frame([("1", "C1"), ("1", "C1"), ("2", None), ("3", "C2"), (None, "C2")], "EINSATZ_NR string, CEDUS_CODE string"),
        "dispatch",
    )
    return missions, dispatch


def test_linkage(frame, rows):
    missions, dispatch = linked_tables(frame)
    assert rows(linkage.mission_match_quality(missions, dispatch)) == [(5, 5, 2, 3)]
    joined = linkage.link_protocols(dispatch, missions)
    total, matched = joined.count(), joined.where("protocolId is not null").count()
    assert rows(linkage.dispatch_match_quality(dispatch, missions), "total", "matched") == [(total, matched)]
    assert rows(linkage.diagnosis_flow(missions, dispatch)) == [("C1", "D1", 2), ("C1", "D2", 2)]
    pairs = linkage.link_dispatch(missions, dispatch).where("CEDUS_CODE is not null and leadingDiagnosis is not null")
    assert pairs.count() == 4


def test_utilization(frame, rows):
    missions = frame(
        [("v1", at(0), at(120)), ("v1", at(24 * 60), at(24 * 60 + 60)), ("v1", at(0), at(-5)), ("v1", at(4 * 1440), at(4 * 1440 + 30)),
         ("v2", at(0), at(0)), (None, at(0), at(60))],
        "vehicle string, b timestamp_ntz, e timestamp_ntz",
    )
    schedule = frame([("v1", 84)], "vehicle string, weekly_hours int")
    got = fleet.utilization(missions, "vehicle", "b", "e", schedule, "2025-03-03", "2025-03-09")
    table = {(r["vehicle"], r["weekday_group"]): (r["missions"], r["actual_hours"], r["available_hours"]) for r in got.collect()}
    assert len(table) == 8
    assert table["v1", "Mon-Thu"] == (2, 3.0, 48.0)
    assert table["v1", "Fri"] == (1, 0.5, 12.0)
    assert table["v2", "Mon-Thu"] == (0, 0.0, 96.0)
    total = {r["vehicle"]: (r["missions"], r["actual_hours"], r["available_hours"]) for r in fleet.total_utilization(got).collect()}
    assert total == {"v1": (3, 3.5, 84.0)}
    profile = fleet.hour_profile(missions, "vehicle", "b", "e")
    assert profile.count() == 24 and profile.agg(F.sum("missions")).first()[0] == 3


def test_durations(frame):
    timed = fleet.durations(
        frame([(1, at(0), at(60)), (2, at(0), at(30 * 60)), (3, at(0), at(-1)), (4, None, at(0)), (5, at(0), at(120))],
              "id int, b timestamp_ntz, e timestamp_ntz"), "b", "e",
    )
    row = fleet.duration_statistics(timed).first()
    assert tuple(row) == (3, 11.0, 2.0, 30.0, 1.0, 1)
    assert [r["id"] for r in fleet.longest_missions(timed, ["id"], 2).collect()] == [2, 5]


def test_extended_measures(frame, rows):
    missions = index(
        frame,
        [("a", "1-83-1", 1, DAY), ("b", "1-83-2", 0, DAY), ("c", "1-85-1", 2, DAY), ("d", "1-85-2", 5, DAY), ("e", None, 1, DAY)],
        "protocolId string, callSign string, evmCount int, missionDate timestamp_ntz",
    )
    evm = lambda p, d: (p, p, None, [(None, d, None, None, None, None, None, None, None, "EVM", None, None)])
    measures = frame([evm("a", "x"), evm("a", "x"), evm("a", "y"), evm("b", "x"), evm("c", "z"), evm("d", "z")], schemas.MEASURES)
    got = fleet.measures_by_vehicle_type(missions, measures)
    assert rows(got) == [("RTW", "x", 1, 2, 100.0), ("RTW", "y", 2, 1, 50.0), ("S-KTW", "z", 1, 1, 100.0)]
    rate = fleet.monthly_measure_rate(missions)
    assert rows(rate, "year_month", "month_name", "vehicle_type", "evm_count", "total_missions") == [
        ("2025-03", "März", "1-85-2", 1, 5), ("2025-03", "März", "RTW", 1, 5), ("2025-03", "März", "S-KTW", 1, 5),
        ("2025-03", "März", "Unbekannt", 1, 5),
    ]


def freetexts(frame, texts):
    return frame(
        [(str(i), p, [(None, "Übergabe", "egal", *[None] * 4), (None, d, t, *[None] * 4)]) for i, (p, d, t) in enumerate(texts)], schemas.FREETEXTS
    )


def test_requirement_analysis(frame, rows):
    docs = freetexts(frame, [
        ("a", "Anamnese", "Medizinische Betreuung notwendig, Quarantäne"), ("b", "Eigenanamnese", "nichts"),
        ("c", "Anamnese", None), ("d", "Anamnese", "Soziale Betreuung"), ("e", "Befund", "Quarantäne"),
    ])
    missions = index(frame, [(p, "KTW") for p in "abcde"] + [("d", "S-KTW")], "protocolId string, missionType string")
    labelled = requirements.classify_texts(requirements.anamnesis_texts(docs, requirements.plain_transports(missions)))
    assert rows(labelled, "protocolId") == [("a",), ("b",), ("c",), ("d",)]
    assert rows(requirements.undocumented_share(labelled)) == [(4, 2, 50.0)]
    assert rows(requirements.needs_per_text(labelled)) == [(0, 3), (2, 1)]
    assert dict(rows(requirements.documentation_rates(labelled))) == {"medical_care": 50.0, "ktw_equipment": 0.0, "infectious_disease": 25.0}
    assert dict(rows(requirements.indicated_totals(labelled))) == {"medical_care": 1, "ktw_equipment": 0, "infectious_disease": 1}
    counts = requirements.label_counts(labelled, ["medical_care"])
    assert [r[0] for r in rows(counts, "label")] == ["indiziert (1)", "keine Angaben (2)", "logistisch/sozial/pädagogisch (1)"]


def test_anamnesis_batch(frame, rows):
    long = "Langer Anfang " * 10
    docs = freetexts(frame, [
        ("a", "Anamnese", f" {long}eins "), ("b", "Anamnese", f"{long}eins"), ("c", "Anamnese", f"{long}zwei"),
        ("a", "Anamnese", "zweiter Text des Protokolls"), ("d", "Anamnese", "kurz"), ("e", "Eigenanamnese", f"{long}drei"),
        ("", "Anamnese", f"{long}vier"),
    ])
    texts = anamnesis.protocol_texts(docs)
    assert rows(texts, "protocolId") == [("a",), ("b",), ("c",), ("d",)]
    asked = anamnesis.prompts(texts)
    assert rows(asked, "protocolId") == [("a",), ("c",), ("d",)]  # texts sharing a prefix stay apart
    answers = asked.select("text_key", F.concat(F.lit("UEBERGRIF_VORHANDEN: "), F.when(F.col("protocolId") == "a", "ja").otherwise("nein")).alias("answer"))
    results = anamnesis.fan_out(texts, anamnesis.parse_answers(answers))
    assert rows(results, "einsatz_id", "übergriff_vorhanden") == [("a", "ja"), ("b", "ja"), ("c", "nein"), ("d", "nein")]
    assert rows(anamnesis.case_counts(results)) == [(4, 2, 0, 0)]
    summary = {r["category"]: (r["yes"], r["no"], r["total"]) for r in anamnesis.yes_no_summary(results).collect()}
    assert summary["Übergriffe"] == (2, 2, 4) and summary["Auffälligkeiten"] == (0, 0, 0)
    assert rows(anamnesis.field_counts(results, "übergriff_vorhanden")) == [("ja", 2), ("nein", 2)]
    linked = frame([("c",)], "protocolId string")
    assert rows(anamnesis.protocol_texts(docs, linked), "protocolId") == [("c",)]


def test_located(frame, rows):
    dispatch = collections.conform(
        frame(
            [("1", 500000.0, 6000000.0, vocab.STATUS_ON_RADIO, "A"), ("2", None, 6000000.0, None, "A"), ("3", 500000.0, 6000000.0, "x", "B")],
            "EINSATZ_NR string, EO_X_KOORD double, EO_Y_KOORD double, STATUS_BEI_ALARMIERUNG string, CEDUS_CODE string",
        ),
        "dispatch",
    )
    got = located.locate(dispatch)
    assert rows(got, "EINSATZ_NR", "status_group", F.round("longitude", 9)) == [("1", "on_radio", 9.0), ("3", "other", 9.0)]
    assert located.locate(dispatch, codes=["B"]).count() == 1
    assert located.centre(got).first()["points"] == 2
    assert located.coordinates_in_degrees(dispatch).first()[0] is False
    degrees = located.locate(dispatch.withColumn("EO_Y_KOORD", F.lit(54.5)).withColumn("EO_X_KOORD", F.lit(9.5)), in_degrees=True)
    assert degrees.first()["latitude"] == 54.5


def test_interval_selections(frame, rows):
    missions = index(
        frame,
        [("a", "RTW - Transport", "Polytrauma", dt.datetime(2021, 1, 1)), ("b", "KTW", "Polytrauma", dt.datetime(2023, 1, 1)),
         ("c", "RTW - Transport", "Polytrauma", dt.datetime(2024, 1, 1)), ("d", "RTW - Transport", "Sepsis", dt.datetime(2023, 5, 1)),
         ("e", None, None, None)],
        "protocolId string, missionType string, leadingDiagnosis string, missionDate timestamp_ntz",
    )
    chosen = lambda **choices: [r[0] for r in rows(intervals.selection(missions, ["polytrauma"], **choices), "protocolId")]
    assert chosen() == ["c"]
    assert chosen(years=None) == ["a", "c"]
    assert chosen(years=None, mission_types=None) == ["a", "b", "c"]
    assert chosen(years=None, mission_types=None, diagnoses=None) == ["a", "b", "c", "d", "e"]
    assert chosen(years=[2023], mission_types=["KTW"], diagnoses=["Polytrauma"]) == ["b"]
    assert chosen(diagnoses=["Sepsis"]) == ["d"]


def test_sums_beyond_64_bits(frame, rows):
    big = 6 * 10**18
    part = frame([(big, big, big, 3 * big)] * 2 if 3 * big < 2**63 else [(big, big, big, big)] * 3,
                 ", ".join(f"{p} bigint" for p in [*intervals.PARTS, intervals.PREHOSPITAL]))
    shares = intervals.process_shares(part).collect()
    assert [round(r["share"], 6) for r in shares] == [33.333333] * 3
    start = dt.datetime(1, 1, 1)
    long = frame([("v", start, dt.datetime(9999, 12, 31))] * 40, "callSign string, a timestamp_ntz, b timestamp_ntz")
    schedule = frame([], "vehicle string, weekly_hours int")
    used = fleet.utilization(long, "callSign", "a", "b", schedule, "2024-01-01", "2024-01-07")
    assert max(r["actual_hours"] for r in used.collect()) > 2**63 / 3.6e9


def test_empty_tables(frame, rows):
    empty = lambda name: frame([], schemas.COLLECTIONS[name])
    labelled = requirements.classify_texts(requirements.anamnesis_texts(empty("freetexts")))
    assert dict(rows(requirements.overview(labelled)))["texts"] == 0.0
    assert all(r["percent"] == 0.0 for r in requirements.documentation_rates(labelled).collect())
    assert intervals.percentile_table(intervals.cohort_intervals(empty("index"), empty("details"), ["x"])).count() == 0
    assert intervals.process_shares(intervals.cohort_intervals(empty("index"), empty("details"), ["x"], years=None)).count() == 0
    assert coverage.stroke_bundle(empty("index"), empty("findings"), empty("results"), empty("measures"),
                                  items.vitals(empty("vitals_bz"), "bz"), items.vitals(empty("vitals_temp"), "temp")).count() == 0
    assert linkage.link_dispatch(empty("index"), empty("dispatch")).count() == 0
    assert rows(linkage.dispatch_match_quality(empty("dispatch"), empty("index"))) == [(0, 0, 0.0)]


def test_null_link_keys_take_no_part(spark, frame, rows):
    missions = index(frame, [(str(k), str(k) if k % 2 else None) for k in range(200)], "protocolId string, missionNumber string")
    dispatch = frame([("1", "x"), ("1", "y"), (None, "z")], "EINSATZ_NR string, CEDUS_CODE string")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        linked = linkage.link_dispatch(missions, dispatch)
        assert linked.count() == 201 and linked.where("CEDUS_CODE is not null").count() == 2
        assert "isnotnull(missionNumber" in linked._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_hot_and_blank_destinations(frame, rows):
    table = frame([("nordklinik", 1, {vocab.CAP_TRAUMA: True})], "variant string, rank int, granted map<string,boolean>")
    cases = [(str(k), "Nordklinik ZNA" if k % 3 else " ", "Polytrauma") for k in range(300)]
    missions = frame(cases, "protocolId string, targetDestination string, leadingDiagnosis string")
    marked = destination.mark_eligible(missions, table, vocab.TRAUMA_KEYWORDS)
    assert marked.count() == 300 and marked.where("hospital_eligible").count() == 200


def test_anamnesis_text_fields(frame, rows):
    item = lambda **v: tuple(v.get(n) for n in ("protocolId", "description", "content", "text", "value", "data", "comment"))
    docs = frame(
        [(str(k), str(k), [item(description="Anamnese", **fields)]) for k, fields in enumerate(
            [{"text": "Sturz", "content": "lang"}, {"text": " ", "content": "Dyspnoe!"}, {"value": "v"}, {"data": "d"}, {"comment": "c"}, {"text": ""}])],
        schemas.FREETEXTS,
    )
    assert [r[1] for r in rows(anamnesis.protocol_texts(docs), "protocolId", "text")] == ["Sturz", "Dyspnoe!", "v", "d", "c"]
