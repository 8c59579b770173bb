"""Document flattening on hand-written market documents."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from wattlake.operators.series import gap_minutes
from wattlake.sources import documents as docs
from wattlake.sources import tables

AT, DE = "10YAT-APG------L", "10Y1001A1001A82H"


def series(points, *, area=AT, start="2024-02-01T00:00Z", end="2024-02-01T04:00Z", step="PT60M", curve="A03",
           position=None, currency="EUR", tag="price.amount", extra=""):
    pts = "".join(f"<Point><position>{p}</position><{tag}>{v}</{tag}></Point>" for p, v in points)
    cls = f"<{docs.POSITION}>{position}</{docs.POSITION}>" if position else ""
    return (f'<TimeSeries>{cls}{extra}<in_Domain.mRID codingScheme="A01">{area}</in_Domain.mRID>'
            f"<currency_Unit.name>{currency}</currency_Unit.name><price_Measure_Unit.name>MWH</price_Measure_Unit.name>"
            f"<curveType>{curve}</curveType><Period><timeInterval><start>{start}</start><end>{end}</end></timeInterval>"
            f"<resolution>{step}</resolution>{pts}</Period></TimeSeries>")


def document(*parts, root="Publication_MarketDocument"):
    return f'<{root} xmlns="urn:iec62325.351:tc57wg16:451-3:publicationdocument:7:3">{"".join(parts)}</{root}>'


def frame(spark, *xml):
    return spark.createDataFrame(list(enumerate(xml)), "id int, xml string")


def test_omitted_positions_are_carried_forward(spark):
    rows = docs.flatten_points(frame(spark, document(series([(1, 40.0), (3, 45.0)]))), "id", "xml").orderBy("ts_utc").collect()
    assert [r.value for r in rows] == [40.0, 40.0, 45.0, 45.0]
    assert [r.ts_utc for r in rows] == [datetime(2024, 2, 1, h) for h in range(4)]
    assert rows[0].n_filled == 2 and rows[0].zone == "AT"


def test_missing_seed_is_reported(spark):
    parsed = docs.describe_series(docs.parse_market_documents(frame(spark, document(series([(2, 1.0)]))), "id", "xml"))
    bad = docs.unseeded_periods(docs.explode_periods(parsed))
    with pytest.raises(tables.ContractError, match="no seed"):
        docs.reject(bad, "no seed")


def test_unusable_documents_fail_or_are_listed(spark):
    good = document(series([(1, 40.0)]))
    bad = {
        "unreadable document": good[:-60],
        "not a number": document(series([(1, "40,5")])),
        "missing time interval": good.replace("<start>2024-02-01T00:00Z</start>", ""),
        "neither series nor acknowledgement": document(),
    }
    empty = document("<Reason><code>999</code><text>nothing</text></Reason>", root="Acknowledgement_MarketDocument")
    for reason, xml in bad.items():
        rows = frame(spark, good, xml, empty)
        assert [tuple(r) for r in docs.rejected_documents(rows, "id", "xml").collect()] == [(1, reason)]
        with pytest.raises(Exception, match=f"document 1: {reason}"):
            docs.flatten_points(rows, "id", "xml").collect()
        kept = docs.parse_market_documents(rows, "id", "xml", on_problem="skip")
        assert [r.doc_id for r in kept.collect()] == [0]
    assert docs.rejected_documents(frame(spark, None), "id", "xml").first()["reason"] == "unreadable document"


def test_repeated_position_keeps_the_last_value(spark):
    for curve, n in (("A03", 4), ("A01", 2)):
        xml = document(series([(3, 1.0), (1, 5.0), (3, 2.0)], curve=curve))
        rows = docs.flatten_points(frame(spark, xml), "id", "xml").orderBy("ts_utc").collect()
        assert len(rows) == n and rows[-1].value == 2.0 and rows[0].value == 5.0


def test_long_periods_fill_in_one_pass(spark):
    xml = document(series([(1, 1.0), (9_000, 2.0)], step="PT15M", end="2024-05-31T00:00Z"))
    rows = docs.flatten_points(frame(spark, xml), "id", "xml")
    assert rows.count() == 120 * 96 and rows.where("value = 1").count() == 8_999


def test_other_curves_keep_their_gaps(spark):
    xml = document(series([(1, 1.0), (4, 2.0)], step="PT15M", end="2024-02-01T01:00Z", curve="A01"))
    rows = docs.flatten_points(frame(spark, xml), "id", "xml").collect()
    assert {r.ts_utc for r in rows} == {datetime(2024, 2, 1, 0, 0), datetime(2024, 2, 1, 0, 45)}


def test_unknown_resolution_fails(spark):
    xml = document(series([(1, 1.0)], step="P1D"))
    with pytest.raises(Exception, match="unsupported resolution"):
        docs.flatten_points(frame(spark, xml), "id", "xml").collect()


def test_series_classification_and_conflicts(spark):
    xml = document(series([(1, 1.0)], position=1), series([(1, 9.0)], position=2),
                   series([(1, 3.0)], area=DE), series([(1, 4.0)], area=DE))
    points = docs.flatten_points(frame(spark, xml), "id", "xml")
    assert docs.price_rows(points).where("zone = 'AT'").agg(F.max("price_eur_mwh")).first()[0] == 1.0
    assert docs.conflicting_series(points).count() == 4
    agreeing = document(series([(1, 3.0)]), series([(1, 3.0)]))
    assert docs.conflicting_series(docs.flatten_points(frame(spark, agreeing), "id", "xml")).count() == 0


def test_currency_violation_only_for_kept_series(spark):
    xml = document(series([(1, 1.0)], currency="USD"), series([(1, 1.0)], currency="USD", position=2))
    parsed = docs.describe_series(docs.parse_market_documents(frame(spark, xml), "id", "xml"))
    assert [r.series_no for r in docs.unit_violations(parsed).collect()] == [0]


def test_generation_rows(spark):
    one = "<businessType>A01</businessType><MktPSRType><psrType>B16</psrType></MktPSRType>"
    two = "<businessType>A04</businessType><MktPSRType><psrType>B77</psrType></MktPSRType>"
    xml = document(series([(1, 120.5)], tag="quantity", curve="A01", extra=one),
                   series([(1, 15.0)], tag="quantity", curve="A01", extra=two), root="GL_MarketDocument")
    got = {(r.psr_type, r.psr_name, r.kind, r.value_mw) for r in docs.generation_rows(docs.flatten_points(frame(spark, xml), "id", "xml")).collect()}
    assert got == {("B16", "Solar", "aggregated", 120.5), ("B77", "UNKNOWN(B77)", "consumption", 15.0)}


def test_acknowledgement(spark):
    xml = "<Acknowledgement_MarketDocument><Reason><code>999</code><text>No data</text></Reason></Acknowledgement_MarketDocument>"
    got = docs.acknowledgements(frame(spark, xml, document(series([(1, 1.0)]))), "id", "xml").collect()
    assert [(r.doc_id, r.reason) for r in got] == [(0, "No data")]
    assert docs.flatten_points(frame(spark, xml), "id", "xml").count() == 0


def weather(stamps, data):
    return '{"timestamps": %s, "features": [{"properties": {"parameters": {"tl_mittel": {"data": %s}}}}]}' % (stamps, data)


def test_weather_arrays(spark):
    good = weather('["2019-01-01T00:00+00:00", "2019-01-02T00:00+00:00"]', "[1.5, null]")
    empty = '{"timestamps": [], "features": []}'
    df = spark.createDataFrame([("30", good), ("31", empty)], "station string, json string")
    rows = docs.flatten_weather(df, "station", "json").orderBy("date").collect()
    assert [(r.tl_mittel_c, r.parameter_raw) for r in rows] == [(1.5, "1.5"), (None, "null")]
    short = spark.createDataFrame([("30", weather('["2019-01-01T00:00+00:00"]', "[]"))], "station string, json string")
    with pytest.raises(Exception, match="differ in length"):
        docs.flatten_weather(short, "station", "json").collect()


def test_longest_record(spark):
    json = ('{"stations": [{"id": 3, "name": "Graz B", "valid_from": "1950-01-01T00:00"}, {"id": 2, "name": "Graz Uni", "valid_from": "1950-01-01"},'
            '{"id": 1, "name": "Wien", "valid_from": "1900-01-01"}]}')
    stations = docs.parse_stations(spark.createDataFrame([(json,)], "j string"), "j")
    assert docs.longest_record(stations, "Graz", "Uni").first().id == 2


def test_resolution_inference(spark):
    rows = [("q", datetime(2024, 1, 1, h, m)) for h in range(6) for m in (0, 15, 30, 45)] + [("h", datetime(2024, 1, 1, h)) for h in range(6)]
    rows += [("d", datetime(2024, 1, d)) for d in range(1, 5)]
    df = spark.createDataFrame(rows, "k string, ts timestamp")
    got = {r.k: r.resolution for r in docs.infer_resolution(gap_minutes(df, ["k"], "ts"), ["k"]).collect()}
    assert got == {"q": "PT15M", "h": "PT60M", "d": "unsupported"}


HEADER = "month,oespi_base,oespi_peak,source_url,retrieved_at\n"


@pytest.mark.parametrize(("body", "message"), [
    ("2020-01,1.0,2.0,u,r\n2020-02,1.0,,u,r\n", "peak blank for 1"),
    ("2020-01,x,2.0,u,r\n", "1 bad base"),
    ("2020-13,1.0,2.0,u,r\n", "1 bad month"),
    ("2020-01,1.0,2.0,u,r\n2020-02,1.0,2.0,w,r\n", "mixes 2 sources"),
    ("2020-01,1.0,z,u,r\n", "1 bad peak"),
    ("", "no rows"),
])
def test_index_contract_rejects(spark, tmp_path, body, message):
    (tmp_path / "i.csv").write_text(HEADER + body)
    with pytest.raises(tables.ContractError, match=message):
        tables.load_index(tables.read_index_text(spark, str(tmp_path / "i.csv")))


def test_index_contract_accepts_base_only(spark, tmp_path):
    (tmp_path / "i.csv").write_text(HEADER + "2020-01,1.5,,u,r\n2020-02,2.5,,u,r\n")
    df, peak = tables.load_index(tables.read_index_text(spark, str(tmp_path / "i.csv")))
    assert peak is False and [r.oespi_base for r in df.orderBy("month_local").collect()] == [1.5, 2.5]
    (tmp_path / "j.csv").write_text("month,base\n2020-01,1\n")
    with pytest.raises(tables.ContractError, match="expected columns"):
        tables.read_index_text(spark, str(tmp_path / "j.csv"))
