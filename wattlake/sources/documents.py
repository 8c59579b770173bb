"""Flattening of XML and JSON documents held in a table, one document per row.

Every step is a generator or a projection on the document's own row, so the
job scales with the number of documents and never gathers them. Gates return
failing rows; ``reject`` turns them into an error. A document that cannot be
read completely is an error by default and never a loss.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattlake.config import PLANT_TYPE_NAMES, ZONE_BY_AREA_CODE
from wattlake.functions.exprs import code_name, code_or_self
from wattlake.functions.timecols import resolution_minutes
from wattlake.sources.schemas import CORRUPT, MARKET_DOCUMENT, STATION_DOCUMENT, WEATHER_DOCUMENT
from wattlake.sources.tables import ContractError

#: Interval bounds come as ``2024-02-01T00:00Z``, sometimes with seconds.
INSTANT = "yyyy-MM-dd'T'HH:mm[:ss]X"
POSITION = "classificationSequence_AttributeInstanceComponent.position"


def _parsed(docs: DataFrame, doc_id: str, xml: str) -> DataFrame:
    """``doc_id, d, problem``: each document with the first reason why it cannot be used, or NULL."""
    options = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(xml).alias("xml"), F.from_xml(F.col(xml), MARKET_DOCUMENT, options).alias("d")
    )
    number = lambda text, kind: text.isNotNull() & F.trim(text).try_cast(kind).isNull()
    in_points = lambda p: F.exists(p["Point"], lambda q: number(q["position"], "int") | number(q["price.amount"], "double") | number(q["quantity"], "double"))  # noqa: E731, E501
    moment = lambda text: F.try_to_timestamp(text, F.lit(INSTANT))
    no_interval = lambda p: moment(p["timeInterval"]["start"]).isNull() | moment(p["timeInterval"]["end"]).isNull()  # noqa: E731, E501
    any_period = lambda test: F.exists("d.TimeSeries", lambda s: F.exists(s["Period"], test))
    series, acknowledged = F.size("d.TimeSeries"), F.contains(F.col("xml"), F.lit("Acknowledgement_MarketDocument"))
    true = lambda c: F.coalesce(c, F.lit(False))
    problem = (
        F.when(F.col("d").isNull() | F.col(f"d.{CORRUPT}").isNotNull(), "unreadable document")
        .when(true(series > 0) & true(any_period(no_interval)), "missing time interval")
        .when(true(any_period(in_points)) | true(F.exists("d.TimeSeries", lambda s: number(s[POSITION], "int"))), "not a number")
        .when(~true(series > 0) & ~true(acknowledged), "neither series nor acknowledgement")
    )
    return rows.select("doc_id", "d", problem.alias("problem"))


def rejected_documents(docs: DataFrame, doc_id: str, xml: str) -> DataFrame:
    """``doc_id, reason`` of every document that cannot be flattened completely."""
    return _parsed(docs, doc_id, xml).where("problem IS NOT NULL").select("doc_id", F.col("problem").alias("reason"))


def parse_market_documents(docs: DataFrame, doc_id: str, xml: str, on_problem: str = "raise") -> DataFrame:
    """One row per ``TimeSeries``: ``doc_id, series_no, s`` (the series struct).

    A document that is cut off, holds a bad number, lacks a time interval or
    is neither series nor acknowledgement fails the job. ``on_problem="skip"`` leaves such documents out
    as a whole; ``rejected_documents`` lists them with their reason.
    """
    if on_problem not in ("raise", "skip"):
        raise ValueError(f"on_problem is raise or skip, found {on_problem}")
    parsed = _parsed(docs, doc_id, xml)
    message = F.concat(F.lit("document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("without id")), F.lit(": "), F.col("problem"))
    otherwise = F.raise_error(message) if on_problem == "raise" else F.lit(None)
    series = F.when(F.col("problem").isNull(), F.col("d.TimeSeries")).otherwise(otherwise)
    return parsed.select("doc_id", F.posexplode(series).alias("series_no", "s"))


def acknowledgements(docs: DataFrame, doc_id: str, xml: str) -> DataFrame:
    """Documents that answer 'no data', with the stated reason."""
    d = F.from_xml(F.col(xml), MARKET_DOCUMENT, {"ignoreNamespace": "true"})
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(d["Reason"]["text"], F.lit("no reason text given")).alias("reason"),
        F.contains(F.col(xml), F.lit("Acknowledgement_MarketDocument")).alias("ack"),
    ).where("ack").drop("ack")


def series_zone(s: Column) -> Column:
    """First area code present, mapped to its zone; unknown codes pass through."""
    area = F.coalesce(
        s["in_Domain.mRID"]["_VALUE"], s["out_Domain.mRID"]["_VALUE"], s["outBiddingZone_Domain.mRID"]["_VALUE"]
    )
    return F.coalesce(code_or_self(area, ZONE_BY_AREA_CODE), F.lit("UNKNOWN"))


def describe_series(series: DataFrame) -> DataFrame:
    """Flat attributes of each series next to its periods."""
    s = F.col("s")
    return series.select(
        "doc_id", "series_no",
        F.trim(s[POSITION]).cast("int").alias("class_position"),
        s["currency_Unit.name"].alias("currency"),
        s["price_Measure_Unit.name"].alias("unit"),
        s["businessType"].alias("business_type"),
        s["curveType"].alias("curve_type"),
        s["MktPSRType"]["psrType"].alias("psr_type"),
        series_zone(s).alias("zone"),
        s["Period"].alias("periods"),
    )


def explode_periods(series: DataFrame) -> DataFrame:
    """One row per period with its start, step and number of positions."""
    rows = series.select("*", F.posexplode("periods").alias("period_no", "p")).drop("periods")
    start = F.to_timestamp(F.col("p.timeInterval.start"), INSTANT)
    end = F.to_timestamp(F.col("p.timeInterval.end"), INSTANT)
    minutes = resolution_minutes(F.col("p.resolution"))
    span = (F.unix_seconds(end) - F.unix_seconds(start)) / F.lit(60)
    return rows.select(
        *[c for c in rows.columns if c != "p"],
        start.alias("start_utc"),
        F.col("p.resolution").alias("resolution"),
        minutes.alias("minutes"),
        F.round(span / minutes).cast("int").alias("n_positions"),
        F.array_sort(F.filter(
            F.transform("p.Point", lambda q, i: F.struct(
                F.trim(q["position"]).cast("int").alias("position"), i.alias("place"),
                F.trim(F.coalesce(q["price.amount"], q["quantity"])).cast("double").alias("value"))),
            lambda q: q["position"].isNotNull() & q["value"].isNotNull(),
        )).alias("sorted"),
    ).select("*", _last_of_each("sorted").alias("points")).drop("sorted")


def _last_of_each(points: str) -> Column:
    """Points in position order; of a repeated position the one that comes last in the document."""
    following = lambda i: F.get(F.col(points), i + 1)["position"]
    kept = F.filter(points, lambda q, i: ~q["position"].eqNullSafe(following(i)))
    return F.transform(kept, lambda q: F.struct(q["position"].alias("position"), q["value"].alias("value")))


def fill_positions(periods: DataFrame) -> DataFrame:
    """Forward-fill omitted positions of curve A03 inside each period.

    Each point is repeated up to the next one's position, on the row itself and in
    one pass over its sorted points: no exploded spine, no window, no shuffle, and
    linear in the length of the period. ``n_filled`` counts the points added; a
    period without a seed at position 1 keeps NULL up to its first point.
    """
    inside = F.filter("points", lambda q: (q["position"] >= 1) & (q["position"] <= F.col("n_positions")))
    rows = periods.withColumn("inside", inside)
    until = lambda i: F.coalesce(F.get(F.col("inside"), i + 1)["position"], F.col("n_positions") + 1)
    span = lambda first, last, value: F.when(
        last > first,
        F.transform(F.sequence(first, last - 1), lambda k: F.struct(k.alias("position"), value.alias("value"))),
    ).otherwise(F.array().cast("array<struct<position:int,value:double>>"))
    first = F.coalesce(F.get(F.col("inside"), F.lit(0))["position"], F.col("n_positions") + 1)
    dense = F.concat(
        span(F.lit(1), first, F.lit(None).cast("double")),
        F.flatten(F.transform("inside", lambda q, i: span(q["position"], until(i), q["value"]))),
    )
    is_a03 = F.coalesce(F.col("curve_type") == "A03", F.lit(False))
    return rows.withColumn(
        "n_filled", F.when(is_a03, F.col("n_positions") - F.size("inside")).otherwise(F.lit(0))
    ).withColumn("points", F.when(is_a03, dense).otherwise(F.col("points"))).drop("inside")


def unseeded_periods(periods: DataFrame) -> DataFrame:
    """Gate: A03 periods whose first position is missing."""
    seeded = F.exists("points", lambda q: q["position"] == 1)
    return periods.where((F.col("curve_type") == "A03") & ~seeded).select(
        "doc_id", "series_no", "period_no", "n_positions"
    )


def explode_points(periods: DataFrame) -> DataFrame:
    """One row per point: ``ts_utc = start + step * (position - 1)``."""
    rows = periods.select("*", F.explode("points").alias("q"))
    offset = F.make_dt_interval(mins=F.col("minutes") * (F.col("q.position") - 1))
    return rows.select(
        *[c for c in periods.columns if c != "points"],
        F.col("q.position").alias("position"),
        (F.col("start_utc") + offset).alias("ts_utc"),
        F.col("q.value").alias("value"),
    )


def flatten_points(docs: DataFrame, doc_id: str, xml: str) -> DataFrame:
    """Documents to points with all series attributes attached."""
    series = describe_series(parse_market_documents(docs, doc_id, xml))
    return explode_points(fill_positions(explode_periods(series)))


def keep_auction_series(points: DataFrame) -> DataFrame:
    """Keep series classified 1 or not classified at all."""
    return points.where(F.col("class_position").isNull() | (F.col("class_position") == 1))


def conflicting_series(points: DataFrame) -> DataFrame:
    """Gate: unclassified series that disagree on a price for the same zone and time."""
    free = points.where(F.col("class_position").isNull())
    return free.groupBy("doc_id", "zone", "ts_utc").agg(
        F.count_distinct("series_no").alias("n_series"), F.count_distinct("value").alias("n_prices")
    ).where("n_series > 1 and n_prices > 1")


def unit_violations(series: DataFrame) -> DataFrame:
    """Gate: price series that are not quoted in EUR per MWh."""
    good = F.col("currency").eqNullSafe("EUR") & F.col("unit").eqNullSafe("MWH")
    kept = F.col("class_position").isNull() | (F.col("class_position") == 1)
    return series.where(kept & ~good).select("doc_id", "series_no", "currency", "unit")


def price_rows(points: DataFrame) -> DataFrame:
    return keep_auction_series(points).select(
        "ts_utc", F.col("value").alias("price_eur_mwh"), "resolution", "zone"
    )


def load_rows(points: DataFrame) -> DataFrame:
    return points.select("ts_utc", F.col("value").alias("load_mw"), "resolution", "zone")


def generation_rows(points: DataFrame) -> DataFrame:
    psr = F.coalesce("psr_type", F.lit("UNKNOWN"))
    kind = F.when(F.col("business_type") == "A04", "consumption").otherwise("aggregated")
    return points.select(
        "ts_utc", psr.alias("psr_type"), code_name(psr, PLANT_TYPE_NAMES).alias("psr_name"),
        kind.alias("kind"), F.col("value").alias("value_mw"), "resolution", "zone",
    )


def flatten_weather(docs: DataFrame, station: str, json: str) -> DataFrame:
    """Daily rows out of parallel ``timestamps`` / ``data`` arrays.

    A document whose arrays differ in length fails the job instead of losing
    days; an empty window yields no rows.
    """
    d = docs.select(F.col(station).alias("station_id"), F.from_json(json, WEATHER_DOCUMENT).alias("d"))
    data = F.get("d.features", 0)["properties"]["parameters"]["tl_mittel"]["data"]
    zipped = F.arrays_zip(F.col("d.timestamps").alias("t"), data.alias("v"))
    # The empty case is a branch, not a filter: the optimiser may evaluate the
    # array ahead of any filter when it explodes it.
    empty = F.coalesce((F.size("d.timestamps") == 0) & (F.size("d.features") == 0), F.lit(False))
    checked = d.select(
        "station_id",
        F.when(empty, F.lit(None))
        .when(F.size("d.timestamps") == F.size(data), zipped)
        .otherwise(F.raise_error(F.lit("timestamps and data differ in length"))).alias("z"),
    )
    return checked.select("station_id", F.explode("z").alias("r")).select(
        F.to_date(F.substring("r.t", 1, 10)).alias("date"),
        "station_id",
        F.col("r.v").alias("tl_mittel_c"),
        F.coalesce(F.col("r.v").cast("string"), F.lit("null")).alias("parameter_raw"),
    )


def longest_record(stations: DataFrame, name_part: str, preferred: str, keys: Sequence[str] = ()) -> DataFrame:
    """Station with the earliest ``valid_from`` among names containing ``name_part``.

    Ties prefer a name containing ``preferred``, then the smallest id.
    """
    found = stations.where(F.contains(F.col("name"), F.lit(name_part)))
    order = F.struct(
        F.to_date(F.substring("valid_from", 1, 10)).alias("since"),
        (~F.contains(F.col("name"), F.lit(preferred))).alias("other"),
        F.col("id"),
    )
    rest = [c for c in stations.columns if c not in keys]
    best = F.min_by(F.struct(*rest), order).alias("s")
    grouped = found.groupBy(*keys) if keys else found.groupBy()
    return grouped.agg(best).select(*keys, "s.*")


def parse_stations(docs: DataFrame, json: str) -> DataFrame:
    return docs.select(F.inline(F.from_json(F.col(json), STATION_DOCUMENT)["stations"]))


def infer_resolution(gaps: DataFrame, keys: Sequence[str], column: str = "gap_minutes") -> DataFrame:
    """``PT60M`` / ``PT15M`` from the median spacing, counted by whole minutes.

    Gaps are first collapsed to (group, minutes) counts, so the median is read
    from a short distribution and not from the rows.
    """
    minutes = F.round(F.col(column)).cast("int").alias("m")
    counts = gaps.where(F.col(column).isNotNull()).groupBy(*keys, minutes).agg(F.count("*").alias("c"))
    median = F.percentile(F.col("m"), 0.5, F.col("c"))
    return counts.groupBy(*keys).agg(median.alias("median_minutes")).withColumn(
        "resolution",
        F.when(F.round("median_minutes") == 60, "PT60M")
        .when(F.round("median_minutes") == 15, "PT15M")
        .otherwise("unsupported"),
    )


def reject(violations: DataFrame, what: str, shown: int = 5) -> None:
    """Raise with a few examples when a gate returned rows."""
    sample = violations.limit(shown).collect()
    if sample:
        raise ContractError(f"{what}: {[r.asDict() for r in sample]}")
