"""The assembled feature job over the flight option schema.

Row expressions come first, then all session statistics as windows over one exchange, then the statistics of past choices
(one aggregation of the stored history for all keys), then lookups. The options are scanned three times: for a narrow copy of
a few columns, for the history, and by whoever reads the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from choicerank.functions import calendar, numbers, text
from choicerank.operators import enrich, history, session, tables
from choicerank.operators.groups import ROWS, largest_group, measured, note, scratch
from choicerank.settings import checkpointed

LEGS = (0, 1)
SEGMENTS = (0, 1, 2, 3)
ENDS = ("departureAt", "arrivalAt")

# Fixed values.
POPULAR_ROUTES = ["MOWLED/LEDMOW", "LEDMOW/MOWLED", "MOWLED", "LEDMOW"]
CAPITALS = "MOW|LED"
POPULAR_FLIGHTS = ["208"]
MAJOR_CARRIERS = ["SU", "S7"]


def column_names(pattern: str, segments: Sequence[int] = SEGMENTS) -> list[str]:
    return [pattern.format(leg=leg, segment=s) for leg in LEGS for s in segments]


def duration_columns() -> list[str]:
    return [*(f"legs{leg}_duration" for leg in LEGS), *column_names("legs{leg}_segments{segment}_duration")]


def parse_durations(df: DataFrame) -> DataFrame:
    """Durations from text to minutes, missing ones 0."""
    return df.withColumns({c: text.duration_to_minutes(c) for c in duration_columns() if c in df.columns})


def initial_features(df: DataFrame) -> DataFrame:
    """Price, tax, fee, trip, membership and route features of one row."""
    carrier = "legs{}_segments0_{}Carrier_code"
    corporate = numbers.conditional_flags("corporateTariffCode", "pricingInfo_isAccessTP", "isVip",
                                          text.list_count("frequentFlyer"))
    rules = {}
    for rule, free in enumerate(("free_cancel", "free_exchange")):
        amount, status = f"miniRules{rule}_monetaryAmount", f"miniRules{rule}_statusInfos"
        ratio = numbers.fee_ratio(amount, "totalPrice")
        rules |= {f"fee_ratio_rule{rule}": ratio, f"fee_ratio_rule{rule}_is_missing": numbers.is_missing(ratio),
                  free: numbers.is_free(amount, status), status: F.coalesce(F.col(status), F.lit(-1)).cast("int")}
    return df.withColumns({
        **numbers.price_ratios("totalPrice", "taxes"),
        **numbers.leg_totals("legs0_duration", "legs1_duration", "totalPrice"),
        "is_one_way": numbers.is_one_way("legs1_duration", "legs1_segments0_departureFrom_airport_iata"),
        "l0_seg": numbers.count_present(column_names("legs{leg}_segments{segment}_marketingCarrier_code")),
        "n_ff_programs": text.list_count("frequentFlyer"),
        "has_ff_program": text.has_text("frequentFlyer"),
        "has_corporate_tariff": corporate["has_code"],
        "corporate_policy_compliant": corporate["code_and_policy"],
        "corporate_vip_flag": corporate["code_and_vip"],
        "is_vip_freq": corporate["vip_or_member"],
        **rules,
        "is_popular_route": text.in_set("searchRoute", POPULAR_ROUTES),
        "contains_capitials": text.matches("searchRoute", CAPITALS),
        "is_popular_flight": text.in_set("legs0_segments0_flightNumber", POPULAR_FLIGHTS),
        **{f"is_codeshare_leg{leg}_seg0": numbers.columns_differ(
            carrier.format(leg, "marketing"), carrier.format(leg, "operating")) for leg in LEGS},
    })


def segment_features(df: DataFrame) -> DataFrame:
    """Segments per leg and direct flags; baggage of the first segment without nulls."""
    df = df.withColumns({f"n_segments_leg{leg}": numbers.count_present(
        [f"legs{leg}_segments{s}_flightNumber" for s in SEGMENTS]) for leg in LEGS})
    baggage = "legs0_segments0_baggageAllowance_{}"
    filled = [baggage.format(x) for x in ("weightMeasurementType", "quantity")]
    return df.withColumns({
        **numbers.direct_flags("n_segments_leg0", "n_segments_leg1", "is_one_way"),
        **{c: F.coalesce(F.col(c), F.lit(-1)) for c in filled},
    })


def time_features(df: DataFrame) -> DataFrame:
    """Hours, weekdays, day parts, stay, lead time, overnight flights."""
    times = {f"legs{leg}_{end}": scratch("time") for leg in LEGS for end in ENDS}
    df = df.withColumns({name: calendar.as_time(c) for c, name in times.items()})
    out: dict[str, Column] = {}
    for c, time in times.items():
        out |= calendar.calendar_features(time, c)
    for leg in LEGS:
        start, end = (times[f"legs{leg}_{e}"] for e in ENDS)
        out |= calendar.calendar_combos(start, end, f"legs{leg}")
        out |= calendar.overnight_and_duration_bin(start, end, f"legs{leg}_duration", f"legs{leg}")
    out |= calendar.gap_features(times["legs0_arrivalAt"], times["legs1_departureAt"])
    out |= calendar.lead_time("requestDate", times["legs0_departureAt"])
    return df.withColumns(out).drop(*times.values(), "requestDate")


def cabin_features(df: DataFrame) -> DataFrame:
    """Cabin levels without nulls and their summary over all segments."""
    cabins = column_names("legs{leg}_segments{segment}_cabinClass")
    df = df.withColumns({c: F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in cabins})
    return df.withColumns(numbers.cabin_features(cabins, "isVip"))


def flyer_features(df: DataFrame) -> DataFrame:
    """Whether the carrier is among the traveller's programmes, and whether it is a major one."""
    carrier = "legs0_segments0_marketingCarrier_code"
    found = text.list_membership("frequentFlyer", carrier, "legs0_segments0_cabinClass", MAJOR_CARRIERS)
    return df.withColumns({f"{carrier}_in_frequentFlyer": found["in_list"],
                           f"{carrier}_is_only_frequentFlyer": found["is_only"],
                           "is_major_carrier_0_0": found["in_major"],
                           f"{carrier}_ff_and_economic": found["member_low_cabin"]})


def itinerary_keys(df: DataFrame) -> DataFrame:
    """Keys of each leg's flights and of both legs together."""
    legs = {f"legs{leg}_segment_id": text.composite_key(
        [f"legs{leg}_departureAt", f"legs{leg}_arrivalAt", f"legs{leg}_segments0_flightNumber",
         f"legs{leg}_segments1_flightNumber"]) for leg in LEGS}
    return df.withColumns(legs).withColumn("leg_combo", F.concat_ws("_", *legs))


def position_features(df: DataFrame, group: str, row: str) -> DataFrame:
    """Place in the session and price place among equal itineraries."""
    df = session.group_position(df, group, [F.col(row)])
    return session.ordinal_rank_ratio(df, [group, "leg_combo"], "totalPrice", [row], "group_option_price_rank_ratio")


def count_features(df: DataFrame, group: str, source: DataFrame) -> DataFrame:
    """Options of the session with the same carrier and with the same flights, per leg."""
    for leg in LEGS:
        df = session.count_in_group(df, group, f"legs{leg}_segments0_marketingCarrier_code",
                                    f"legs{leg}_carrier_count_in_group", source)
        df = session.count_in_group(df, group, f"legs{leg}_segment_id", f"legs{leg}_segment_count_in_group",
                                    source)
    return df


LOGGED = ["legs0_duration", "legs1_duration", *column_names("legs{leg}_segments{segment}_duration", (0, 1)),
          "total_duration", "hours_to_departure"]


def session_features(df: DataFrame, group: str, row: str, source: DataFrame) -> DataFrame:
    """All statistics of the session in one pass. Durations leave it as ``log1p`` of minutes.

    Scaled ranks and shortest flags use minutes, the group's duration statistics use logs.
    """
    logged_total = scratch("log_duration")
    direct = F.col("is_direct_leg0") == 1
    one_way = F.col("is_one_way") == 1
    df, source = (x.withColumn(logged_total, F.log1p("total_duration")) for x in (df, source))
    out = session.with_group(
        df, group,
        session.size(row, "group_size"),
        session.minimum_flags({"legs0_duration": "is_shortest_duration", "l0_seg": "is_min_segments",
                               "n_segments_leg0": "is_min_segments_leg0",
                               "n_segments_leg1": "is_min_segments_leg1"},
                              zero_when={"is_min_segments_leg1": one_way}),
        session.filtered_minimum(direct, {"total_duration": "is_direct_shortest",
                                          "totalPrice": "is_direct_cheapest"}),
        session.minmax({"totalPrice": "price_quantile_rank", "total_duration": "duration_quantile_rank",
                        "legs0_duration": "leg0_duration_quantile_rank",
                        "legs1_duration": "leg1_duration_quantile_rank"}),
        session.relative_price("totalPrice", {
            "cheapest": "is_top3_cheapest", "z": "price_zscore_from_median",
            "above_min": "price_relative_to_min", "below_q25": "is_cheaper_than_avg",
            "outlier": "is_expensive_outlier"}),
        session.moments({"log_price": "group_price", logged_total: "group_dur"}),
        session.nunique({"legs0_segment_id": "group_legs0_n_segments",
                         "legs1_segment_id": "group_legs1_n_segments",
                         "leg_combo": "group_n_leg_combos"}), null_keys=False, source=source)
    helpers = ["legs0_segment_id", "legs1_segment_id", "leg_combo", logged_total]
    return out.drop(*helpers).withColumns({
        "group_size_log": F.log1p("group_size"),
        "group_total_options": F.col("group_size"),
        **numbers.rank_interactions("price_quantile_rank", "duration_quantile_rank"),
        **{n: e for n, e in numbers.rank_interactions(
            "leg0_duration_quantile_rank", "leg1_duration_quantile_rank", "leg_dur_interaction").items()
           if not n.endswith("_sum")},
        **numbers.log_transform(LOGGED),
    })


HISTORY_COLUMNS = [
    "companyID", "profileId", "corporateTariffCode", "searchRoute", "legs0_segments0_marketingCarrier_code",
    "legs1_segments0_marketingCarrier_code", "legs0_segments0_aircraft_code", "log_price", "totalPrice",
    "is_direct_leg0", "is_direct_leg1", "both_direct", "legs0_departureAt_hour", "legs1_departureAt_hour",
    "price_quantile_rank", "duration_quantile_rank", "corporate_policy_compliant", "has_corporate_tariff",
    "legs0_segments0_cabinClass", "legs1_segments0_cabinClass", "total_duration", "outbound_route",
    "return_route",
]


def history_features(df: DataFrame, past: DataFrame, offered: DataFrame) -> DataFrame:
    """Statistics of past choices by company, carrier, user, tariff code and route.

    ``past`` holds the chosen training rows, ``offered`` all training rows (carrier and label).
    """
    ranks = {"price_rank": "price_quantile_rank", "duration_rank": "duration_quantile_rank"}
    cabin = "legs0_segments0_cabinClass"
    specs = [history.company(
        "companyID", "totalPrice", "log_price", history=past,
        shares={"selected_legs0_direct_ratio": F.col("is_direct_leg0"),
                "selected_legs1_direct_ratio": F.col("is_direct_leg1"),
                "selected_direct_ratio": F.col("both_direct"),
                "selected_legs0_night_ratio": (F.col("legs0_departureAt_hour") < 6).cast("int"),
                "selected_legs1_night_ratio": (F.col("legs1_departureAt_hour") < 6).cast("int")},
        means={"company_avg_pct": "price_quantile_rank", "company_avg_dct": "duration_quantile_rank",
               "company_policy_rate": "corporate_policy_compliant"})]
    for leg in LEGS:
        carrier, prefix = f"legs{leg}_segments0_marketingCarrier_code", f"legs{leg}_Carrier_code"
        specs += [history.selection_rate(carrier, prefix, train=offered),
                  history.behaviour(carrier, prefix, **ranks, hour=f"legs{leg}_departureAt_hour",
                                    company="companyID", user="profileId", history=past),
                  history.cabin_shares(carrier, f"legs{leg}_segments0_cabinClass", prefix, history=past)]
    modes = history.density_modes(past, [*ranks.values(), cabin])
    specs.append(history.profile("profileId", **ranks, cabin=cabin, fallbacks=modes, history=past))
    specs.append(history.tariff_code("corporateTariffCode", **ranks, history=past))
    for route, leg in (("outbound_route", 0), ("return_route", 1)):
        specs.append(history.route(route, log_price="log_price", duration="total_duration",
                                   policy="has_corporate_tariff", direct=f"is_direct_leg{leg}", history=past))
    return history.with_history(df, *specs).withColumns({
        "carrier_pop_prod": numbers.log_sum(*[f"legs{leg}_Carrier_code_log_total_count" for leg in LEGS]),
        "user_avg_cabinClass_leg0_seg0": F.col("user_avg_cabin"),
    }).drop("user_avg_cabin")


def airport_features(df: DataFrame, airports: DataFrame) -> DataFrame:
    """Country and time-zone change per leg; both legs take the stop count of the first leg."""
    return enrich.leg_enrichment(df, airports, {f"legs{leg}": (
        f"legs{leg}_segments0_departureFrom_airport_iata",
        enrich.last_stop([f"legs{leg}_segments{s}_arrivalTo_airport_iata" for s in SEGMENTS], "n_segments_leg0"))
        for leg in LEGS})


def summary_features(df: DataFrame, summary: DataFrame, group: str) -> DataFrame:
    """Traveller attributes of the session: age and its bin, search type, assistant."""
    df = enrich.summary_enrichment(df, summary, group)
    age = numbers.age_features("yearOfBirth")
    return df.withColumns({"age": age["age"], "age_bin_fixed": age["age_bin"]}).drop("yearOfBirth")


def offer_key(df: DataFrame, output: str) -> DataFrame:
    """Key of the flights of an option, null where a part is."""
    parts = [f"legs{leg}_{what}" for what in (*ENDS, "segments0_flightNumber") for leg in LEGS]
    return df.withColumn(output, text.composite_key(parts, null_as=None))


def option_features(df: DataFrame, group: str, source: DataFrame) -> DataFrame:
    """Offers of the same flights in the session."""
    key = scratch("flight")
    return session.same_offer_features(offer_key(df, key), group, key, "totalPrice",
                                       offer_key(source, key)).drop(key)


def build_features(df: DataFrame, airports: DataFrame, labels: DataFrame, *, group: str = "ranker_id",
                   row: str = "Id", train: Column | None = None, label: str = "selected",
                   summary: DataFrame | None = None, aircraft: bool = False,
                   options: bool = False, counts: bool = False) -> DataFrame:
    """All features of labelled and unlabelled options together.

    ``row`` orders the options of a session and must be unique in it. ``train`` marks the rows whose
    choices count as history, by default ``split = 'train'``. ``summary``, ``aircraft`` and ``options``
    switch on the families that are off by default; ``counts`` adds the counts of equal carriers and
    legs in the session, which no family selects.
    """
    train = F.col("split") == "train" if train is None else train
    past_rows, seats = scratch("train"), "legs0_segments0_seatsAvailable"
    carriers = [f"legs{leg}_segments0_marketingCarrier_code" for leg in LEGS]
    # One narrow copy serves what is needed of all rows before a frame can be given: sizes, mean, quantiles, offers.
    narrow = checkpointed(df.select(group, label, "totalPrice", "taxes", seats, *carriers, train.alias(past_rows)))
    ratios = numbers.price_ratios("totalPrice", "taxes")
    df = note(df, [group], ROWS, largest_group(measured(narrow, group), group))
    df = tables.impute(initial_features(parse_durations(df)), means=[seats], source=narrow)
    df = tables.winsorize(df, "price_per_tax", source=narrow.select(ratios["price_per_tax"].alias("price_per_tax")))
    df = segment_features(df)
    df = tables.prune_columns(df, [
        "legs?_segments1_baggageAllowance_*", "legs?_segments[23]_aircraft_code",
        "legs?_segments[23]_arrivalTo_airport_city_iata", "legs?_segments[23]_baggageAllowance_*",
        "legs?_segments[23]_departureFrom_airport_iata", "legs?_segments[23]_duration",
        "legs?_segments[23]_flightNumber", "legs?_segments[23]_*Carrier_code",
        "legs?_segments[23]_seatsAvailable"])
    df = time_features(df)
    df = flyer_features(cabin_features(df))
    df = df.withColumns(text.split_route("searchRoute"))
    # All statistics are read from the same rows, so the plan grows by one branch a join.
    rows = itinerary_keys(df)
    df = position_features(rows, group, row)
    if options:
        df = option_features(df, group, rows)
    if counts:
        df = count_features(df, group, rows)
    df = session_features(df, group, row, rows)
    past = checkpointed(df.where(train & (F.col(label) == 1)).select(*HISTORY_COLUMNS))
    df = enrich.label_join(df, labels, group, "group_position")  # while the rows of a session lie together
    df = history_features(df, past, narrow.where(past_rows))
    df = airport_features(df, airports)
    if summary is not None:
        df = summary_features(df, summary, group)
    if aircraft:
        df = history.route_aircraft_stats(df, "searchRoute", "legs0_segments0_aircraft_code",
                                          price_rank="price_quantile_rank",
                                          duration_rank="duration_quantile_rank", history=past)
    return df
