import contextlib
import datetime as dt
import uuid

import pytest

from pulsegrid import schemas, vocab
from pulsegrid.sources import collections, items, metrics, reference, scans

T1, T2, T3 = (dt.datetime(2025, 1, d, 8) for d in (1, 2, 3))


def finding(description, value=None, text=None, kind=None, ts=None, source=None):
    return (description, value, text, kind, ts, source)


def test_scores(frame, rows):
    docs = frame(
        [
            ("1", "p1", None, [finding("GCS", "14", kind="eb_neuro", ts=T1, source="i"), finding("Haut"), finding("GCS", "x")]),
            ("2", "p2", "doc", [finding("GCS", " 3 ", source="i")]),
            ("3", "p3", None, []),
            ("4", "p4", None, None),
            ("5", None, None, [finding("GCS", "15")]),
        ],
        schemas.FINDINGS,
    )
    got = items.scores(docs, "GCS")
    assert got.columns == ["protocolId", "metric", "value_num", "type", "timestamp", "source", "collection"]
    assert rows(got, "protocolId", "value_num", "type", "timestamp", "source") == sorted(
        [
            ("p1", 14.0, "eb_neuro", T1, "i"),
            ("p1", None, None, None, None),
            ("p2", 3.0, None, None, "doc"),
            (None, 15.0, None, None, None),
        ],
        key=repr,
    )


def test_pupil_status_takes_first_of_each_side(frame, rows):
    left, right = vocab.ITEM_PUPIL_LEFT, vocab.ITEM_PUPIL_RIGHT
    docs = frame(
        [
            ("2", "p1", None, [finding(left, text="late", ts=T2)]),
            ("1", "p1", None, [finding("Haut"), finding(left, text=None, ts=T1, source="s"), finding(left, text="second")]),
            ("3", "p1", None, [finding(right, text="r1"), finding(right, text="r2")]),
            ("4", "p2", None, [finding(right, text="only", ts=T3, source="x")]),
        ],
        schemas.FINDINGS,
    )
    got = items.pupil_status(docs)
    assert rows(got, "protocolId", "left_reaction", "right_reaction", "timestamp", "source") == [
        ("p1", None, "r1", T1, "s"),
        ("p2", None, "only", None, None),
    ]


def result(name, value, ts=None, source=None):
    return (name, value, ts, source)


def test_symptom_onset(frame, rows):
    onset, spec = vocab.ITEM_ONSET, vocab.ITEM_ONSET_SPEC
    docs = frame(
        [
            ("1", "p1", "d", [result(onset, "01.01.2023"), result(onset, "00:50:00", T1, "i"), result(onset, "")]),
            ("2", "p1", "d", [result(onset, "02.01.2023"), result(spec, "plötzlich", T2)]),
            ("3", "p2", "d", [result(spec, "a", T1, "x"), result(spec, "", T3, "y"), result("NACA", "3")]),
            ("4", "p3", None, [result(onset, "bald")]),
            ("5", "p4", None, [result(spec, "")]),
        ],
        schemas.RESULTS,
    )
    got = items.symptom_onset(docs)
    assert rows(got, "protocolId", "onset_time", "date", "time", "specification", "timestamp", "source") == [
        ("p1", "02.01.2023 00:50:00", "02.01.2023", "00:50:00", "plötzlich", T1, "d"),
        ("p2", None, None, None, "a", T1, "x"),
        ("p3", "bald", None, None, None, None, None),
    ]


def resuscitation_docs(frame):
    return frame(
        [
            ("1", "p1", None, [result("NACA", "6", T1), result("NACA", "5"), result("Rea durchgeführt", "ja", T3)]),
            ("2", "p2", None, [result("Rea durchgeführt", "Ja"), result("Rea durchgeführt", None)]),
            ("3", "p3", None, [result("NACA", "6")]),
            ("4", None, None, [result("NACA", "6")]),
        ],
        schemas.RESULTS,
    )


def test_resuscitations_keep_every_item(frame, rows):
    got = items.resuscitations(resuscitation_docs(frame))
    assert rows(got, "protocolId", "rea_status", "source_metric") == sorted(
        [
            ("p1", True, "NACA 6"),
            ("p1", True, "Reanimation field"),
            ("p2", False, "Reanimation field"),
            ("p2", False, "Reanimation field"),
            ("p3", True, "NACA 6"),
            (None, True, "NACA 6"),
        ],
        key=repr,
    )


def test_resuscitations_with_destination_is_one_row_per_protocol(frame, rows):
    index = collections.conform(
        frame(
            [("p1", T1, "old"), ("p1", T2, "new"), ("p2", T1, "x"), (None, T1, "null")],
            "protocolId string, missionDate timestamp_ntz, targetDestination string",
        ),
        "index",
    )
    got = items.resuscitations_with_destination(resuscitation_docs(frame), index)
    assert rows(got, "protocolId", "source_metric", "timestamp", "targetDestination") == [
        ("p1", "Reanimation field", T3, "new"),
        ("p3", "NACA 6", None, None),
    ]


def measure(**v):
    names = ["value_1", "value_2", "value_3", "value_4", "value_5", "value_6", "value_7", "value_8", "value_10", "value_11"]
    return tuple(v.get(n) for n in names) + (None, None)


def test_medications(frame, rows):
    docs = frame(
        [
            ("1", "p1", None, [
                measure(value_1="Medikamente", value_2="ACETYLSALICYLSÄURE", value_4="500", value_5="mg"),
                measure(value_1="Medikamente", value_2="Aspirin", value_4="viel", value_6="Acetylsalicylsäure"),
                measure(value_1="Medikamente", value_2="Fentanyl"),
                measure(value_1="Atemweg", value_2="Acetylsalicylsäure"),
            ]),
        ],
        schemas.MEASURES,
    )
    assert rows(items.medications(docs, vocab.ASPIRIN), "med_name", "dose") == [("ACETYLSALICYLSÄURE", 500.0), ("Aspirin", None)]
    assert items.medications(docs).count() == 3


def test_intubations_need_an_airway_item_in_the_document(frame, rows):
    docs = frame(
        [
            ("1", "p1", None, [measure(value_1="Atemweg"), measure(value_1="x", value_2="Intubation", value_3="Tubus", value_8="selbst")]),
            ("2", "p2", None, [measure(value_1="x", value_2="Intubation", value_3="Tubus")]),
            ("3", "p3", None, [measure(value_1="Atemweg", value_2="Intubation")]),
            ("4", "p4", None, None),
        ],
        schemas.MEASURES,
    )
    assert rows(items.intubations(docs), "protocolId", "type", "applicant") == [("p1", "Tubus", "selbst")]


def test_ecg_and_extended_measures(frame, rows):
    docs = frame(
        [
            ("1", "p1", None, [
                measure(value_1="Monitoring", value_2="12-Kanal-EKG", value_3="SR"),
                measure(value_1="Monitoring", value_2="EKG"),
                measure(value_1="Zugang", value_2="i.v.", value_10="77", value_11="EVM"),
            ]),
        ],
        schemas.MEASURES,
    )
    assert rows(items.twelve_lead_ecgs(docs), "protocolId", "performed", "result") == [("p1", True, "SR")]
    assert rows(items.extended_measures(docs), "type", "description", "applicant") == [("Zugang", "i.v.", "77")]


def test_vitals_read_both_shapes(frame, rows):
    docs = frame(
        [
            ("p1", [(5.5, None, "mg/dl", None, None, T1, "i"), (None, "u", None, None, None, None, None)]) + (None,) * 7,
            ("p2", None, 7.0, "mmol", None, "ja", "d", T2, "s"),
            ("p3", []) + (None,) * 7,
        ],
        schemas.VITALS,
    )
    got = items.vitals(docs, "bz")
    assert rows(got, "protocolId", "value", "unit", "o2Administration", "timestamp", "source") == sorted(
        [
            ("p1", 5.5, "mg/dl", None, T1, "i"),
            ("p1", None, "u", None, None, None),
            ("p2", 7.0, "mmol", "ja", T2, "s"),
            ("p3", None, None, None, None, None),
        ],
        key=repr,
    )


def test_protocol_details(frame):
    content = {f"{p}Status{c}": None for c in schemas.STATUS_CODES for p in ("date", "time")}
    content.update(dateStatusAlarm="01.02.2025", timeStatusAlarm="10:00:00", dateStatus4="2025-02-01", timeStatus4=" ")
    content.update(flashingLights="Ja", transportFlashingLights="unbekannt", nachforderungNA="NEIN")
    got = scans.protocol_details(frame([("p1", tuple(content.values()))], schemas.DETAILS)).first()
    assert got["StatusAlarm"] == dt.datetime(2025, 2, 1, 10) and got["Status4"] is None and got["StatusEnd"] is None
    assert got["content_flashingLights"] is True
    assert got["content_transportFlashingLights"] is None and got["content_nachforderungNA"] is False


def index(frame):
    return collections.conform(
        frame(
            [("a", dt.datetime(2023, 12, 31, 23, 59, 59)), ("b", dt.datetime(2024, 1, 1)), ("c", None), ("d", dt.datetime(2025, 1, 1))],
            "protocolId string, missionDate timestamp_ntz",
        ),
        "index",
    )


def test_mission_index(frame, rows):
    table = index(frame)
    assert rows(scans.mission_index(table, years=(2023, 2024)), "protocolId") == [("a",), ("b",)]
    assert [r[0] for r in scans.mission_index(table, limit=2).select("protocolId").collect()] == ["d", "b"]
    ids = frame([("a",), ("a",), (None,)], "protocolId string")
    assert rows(scans.mission_index(table, ids=ids), "protocolId") == [("a",)]


def test_load_metric(frame, rows):
    docs = frame([("1", "a", None, [finding("GCS", "3")]), ("2", "d", None, [finding("GCS", "4")])], schemas.FINDINGS)
    tables = {"index": index(frame), "findings": docs}
    assert rows(metrics.load_metric(tables, "GCS", years=(2025, 2025)), "protocolId", "value_num") == [("d", 4.0)]
    assert metrics.load_metric(tables, "GCS", limit=1).count() == 1
    assert [r[0] for r in metrics.load_metric(tables, "Index", years=(2023, 2024), limit=1).collect()] == ["b"]
    with pytest.raises(ValueError):
        metrics.load_metric(tables, "unbekannt")
    assert len(metrics.METRICS) == 27


def test_materialised_metric(frame, rows, tmp_path):
    docs = frame([("1", "a", None, [finding("GCS", "3")])], schemas.FINDINGS)
    got = metrics.materialised_metric({"findings": docs}, "GCS", str(tmp_path / "gcs"))
    assert rows(got, "protocolId", "value_num") == [("a", 3.0)]
    assert got.inputFiles()


def test_stored_metrics(spark, frame, rows):
    """Tables by year and protocol: joined without a shuffle, one year replaced, the others' files untouched."""
    docs = [("1", "a", None, [finding("GCS", "3")]), ("2", "d", None, [finding("GCS", "4"), finding("Schmerzen", "1")]), ("3", "none", None, [finding("GCS", "5")])]
    tables = {"index": index(frame), "findings": frame(docs, schemas.FINDINGS)}
    with table_names(spark) as (first, second):
        gcs = metrics.store_metric(tables, "GCS", first, buckets=4)
        pain = metrics.store_metric(tables, "Schmerzen", second, buckets=4)
        assert rows(gcs, "protocolId", "value_num", metrics.YEAR) == [("a", 3.0, 2023), ("d", 4.0, 2025), ("none", 5.0, None)]
        both = gcs.select("protocolId", "value_num").hint("merge").join(pain.select("protocolId"), "protocolId")
        assert rows(both) == [("d", 4.0)]
        assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
        before = {f for f in gcs.inputFiles() if "mission_year=2025" not in f}
        changed = {**tables, "findings": frame([("1", "a", None, [finding("GCS", "9")]), ("2", "d", None, [finding("GCS", "7")])], schemas.FINDINGS)}
        again = metrics.replace_year(changed, "GCS", first, 2025)
        assert rows(again, "protocolId", "value_num", metrics.YEAR) == [("a", 3.0, 2023), ("d", 7.0, 2025), ("none", 5.0, None)]
        assert before == {f for f in again.inputFiles() if "mission_year=2025" not in f}
        emptied = metrics.replace_year({**tables, "findings": frame([], schemas.FINDINGS)}, "GCS", first, 2025)
        assert rows(emptied, "protocolId") == [("a",), ("none",)]
        assert "PartitionFilters: [isnotnull(mission_year" in emptied.where("mission_year = 2023")._jdf.queryExecution().executedPlan().toString()


@contextlib.contextmanager
def table_names(spark):
    """Two unused table names; their tables are dropped afterwards."""
    names = [f"stored_{uuid.uuid4().hex}" for _ in range(2)]
    yield names
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_dispatch_records(frame, rows):
    table = collections.conform(
        frame(
            [("1", "Schleswig-Flensburg", T1), ("2", "Kiel", T2), ("3", "Schleswig-Flensburg", T3), ("4", None, T3)],
            "EINSATZ_NR string, EO_LANDKREIS string, EINSATZBEGINN timestamp_ntz",
        ),
        "dispatch",
    )
    assert rows(scans.dispatch_records(table), "EINSATZ_NR") == [("1",), ("2",), ("3",), ("4",)]
    assert rows(scans.dispatch_records(table, vocab.DISTRICT), "EINSATZ_NR") == [("1",), ("3",)]
    assert rows(scans.dispatch_records(table, vocab.DISTRICT, limit=1), "EINSATZ_NR") == [("3",)]


def test_read_collection_fills_absent_columns(spark, tmp_path, rows):
    spark.createDataFrame([("p1", 4)], "protocolId string, evmCount int").write.parquet(str(tmp_path / "index"))
    got = collections.read_collection(spark, str(tmp_path), "index")
    assert rows(got, "protocolId", "evmCount", "callSign") == [("p1", 4, None)]
    (tmp_path / "freetexts").mkdir()
    (tmp_path / "freetexts" / "a.json").write_text('{"_id": "1", "protocolId": "p", "data": [{"description": "Anamnese", "text": "t"}]}\n')
    docs = collections.read_collection(spark, str(tmp_path), "freetexts", "json")
    assert rows(items.texts(docs), "protocolId", "description", "content", "text") == [("p", "Anamnese", None, "t")]


def test_hospital_file(spark, tmp_path, rows):
    path = tmp_path / "hospitals.csv"
    path.write_text(
        "Name;" + ";".join(vocab.CAPABILITIES) + "\n"
        '["Nordklinik","Nord", "Nord"];True;False;True;False\n'
        '["Westklinik", "NORD"];False;True;False;True\n',
        encoding="utf-8",
    )
    variants = reference.name_variants(reference.read_hospitals(spark, str(path)))
    got = {r["variant"]: (r["rank"]["pos"], r["granted"]) for r in variants.collect()}
    assert set(got) == {"nordklinik", "nord", "westklinik"}
    assert got["nord"][0] == 1  # first mention decides the place
    assert got["nord"][1] == dict(zip(vocab.CAPABILITIES, (False, True, False, True)))  # last one the capabilities


def test_schedule_and_holidays(frame, rows):
    texts = frame([(" SL 85-1 : 84,ohne, b:x",)], "config string")
    assert rows(reference.schedule_table(texts, "config", "Ret ")) == [("Ret SL 85-1", 84), ("Ret b", None)]
    days = frame([("2025-01-01", "Neujahr")], "date string, name string")
    marked = reference.mark_holidays(frame([(T1,), (T2,)], "ts timestamp_ntz"), "ts", days)
    assert rows(marked) == [(T1, "Neujahr"), (T2, None)]
