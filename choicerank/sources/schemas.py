"""Declared input schemas.

Fixed values: the column and field names below are those of the published data.
"""

from __future__ import annotations

from pyspark.sql import types as T

LEGS = (0, 1)
SEGMENTS = (0, 1, 2, 3)

_TEXT_ATTRIBUTES = ["aircraft_code", "arrivalTo_airport_city_iata", "arrivalTo_airport_iata",
                    "departureFrom_airport_iata", "duration", "flightNumber", "marketingCarrier_code",
                    "operatingCarrier_code"]
_NUMBER_ATTRIBUTES = ["baggageAllowance_quantity", "baggageAllowance_weightMeasurementType",
                      "cabinClass", "seatsAvailable"]


def options_schema(labelled: bool = True) -> T.StructType:
    """One row per option of a search session."""
    fields = [("Id", T.LongType()), ("ranker_id", T.StringType()), ("profileId", T.LongType()),
              ("companyID", T.LongType()), ("sex", T.BooleanType()), ("nationality", T.LongType()),
              ("bySelf", T.BooleanType()), ("isAccess3D", T.BooleanType()), ("isVip", T.BooleanType()),
              ("frequentFlyer", T.StringType()), ("corporateTariffCode", T.LongType()),
              ("pricingInfo_isAccessTP", T.DoubleType()),
              ("pricingInfo_passengerCount", T.DoubleType()), ("searchRoute", T.StringType()),
              ("requestDate", T.TimestampNTZType()), ("totalPrice", T.DoubleType()),
              ("taxes", T.DoubleType())]
    for leg in LEGS:
        fields += [(f"miniRules{leg}_{x}", T.DoubleType())
                   for x in ("monetaryAmount", "percentage", "statusInfos")]
        fields += [(f"legs{leg}_{x}", T.StringType()) for x in ("departureAt", "arrivalAt", "duration")]
        for segment in SEGMENTS:
            fields += [(f"legs{leg}_segments{segment}_{a}", T.StringType()) for a in _TEXT_ATTRIBUTES]
            fields += [(f"legs{leg}_segments{segment}_{a}", T.DoubleType()) for a in _NUMBER_ATTRIBUTES]
    if labelled:
        fields.append(("selected", T.LongType()))
    return T.StructType([T.StructField(n, t) for n, t in fields])


AIRPORTS = T.StructType([
    T.StructField("IATA", T.StringType()),
    T.StructField("UTC_Offset_Hours", T.DoubleType()),
    T.StructField("Country_CodeA2", T.StringType()),
])

PRICING = T.StructType([
    T.StructField("ordinal", T.LongType()),
    T.StructField("totalPrice", T.DoubleType()),
    T.StructField("category", T.StringType()),
    T.StructField("labels", T.ArrayType(T.StringType())),
])

SESSION_DOCUMENT = T.StructType([
    T.StructField("data", T.StructType([
        T.StructField("$values", T.ArrayType(T.StructType([
            T.StructField("pricings", T.ArrayType(PRICING)),
        ]))),
    ])),
])
