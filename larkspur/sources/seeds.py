"""Inline dimension rows and the deterministic booking generator."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The dimension rows of the airline example.
AIRPORTS = [
    ("SFO", "San Francisco", "USA", "AMER"),
    ("JFK", "New York", "USA", "AMER"),
    ("LHR", "London", "UK", "EMEA"),
    ("DXB", "Dubai", "UAE", "EMEA"),
    ("NRT", "Tokyo", "Japan", "APAC"),
    ("SIN", "Singapore", "Singapore", "APAC"),
]
FLIGHTS = [
    ("FL001", "SFO-JFK", "SFO", "JFK", "A320", 2586, "2025-03-02 08:00:00", 12),
    ("FL002", "JFK-LHR", "JFK", "LHR", "B77W", 3451, "2025-03-02 21:30:00", 45),
    ("FL003", "LHR-DXB", "LHR", "DXB", "A388", 3414, "2025-03-03 10:15:00", 0),
    ("FL004", "DXB-SIN", "DXB", "SIN", "B77W", 3630, "2025-03-03 23:05:00", 8),
    ("FL005", "SIN-NRT", "SIN", "NRT", "A359", 3312, "2025-03-04 07:40:00", 22),
    ("FL006", "NRT-SFO", "NRT", "SFO", "B789", 5150, "2025-03-04 17:20:00", 5),
    ("FL007", "SFO-LHR", "SFO", "LHR", "A359", 5367, "2025-03-05 13:10:00", 63),
    ("FL008", "JFK-DXB", "JFK", "DXB", "B77W", 6842, "2025-03-05 19:55:00", 0),
]
CUSTOMERS = [
    ("CUST01", "Platinum", "USA", "Business", "2019-05-11"),
    ("CUST02", "Gold", "UK", "Leisure", "2020-02-03"),
    ("CUST03", "Silver", "Japan", "Business", "2021-08-19"),
    ("CUST04", "Blue", "Singapore", "Leisure", "2023-01-27"),
    ("CUST05", "Gold", "UAE", "Business", "2020-11-30"),
    ("CUST06", "Blue", "USA", "Leisure", "2022-06-14"),
    ("CUST07", "Platinum", "UK", "Business", "2018-09-02"),
    ("CUST08", "Silver", "USA", "Leisure", "2021-03-22"),
    ("CUST09", "Gold", "Japan", "Leisure", "2022-12-05"),
    ("CUST10", "Blue", "Singapore", "Business", "2023-07-18"),
]
# The categories of the booking fact.
FARE_CLASSES = ["Economy", "Premium", "Business", "First"]
CHANNELS = ["Direct", "OTA", "Agent", "Mobile"]


def dim_airports(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(AIRPORTS, "airport_code string, city string, country string, region string")


def dim_flights(spark: SparkSession) -> DataFrame:
    raw = spark.createDataFrame(
        FLIGHTS,
        "flight_id string, route_id string, origin_airport string, dest_airport string, "
        "aircraft_type string, distance_miles int, scheduled_dep string, delay_minutes int",
    )
    return raw.withColumn("scheduled_dep", F.col("scheduled_dep").cast("timestamp_ntz"))


def dim_customers(spark: SparkSession) -> DataFrame:
    raw = spark.createDataFrame(
        CUSTOMERS, "customer_id string, loyalty_tier string, home_country string, segment string, signup_date string"
    )
    return raw.withColumn("signup_date", F.col("signup_date").cast("date"))


@dataclass(frozen=True)
class Cycle:
    """Values taken in turn: row ``id`` gets the value at ``step * id`` modulo their number."""

    values: tuple
    step: int = 1

    def of(self, key: Column) -> Column:
        place = F.pmod(key * self.step, F.lit(len(self.values))) + 1
        return F.element_at(F.array(*[F.lit(v) for v in self.values]), place.cast("int"))


@dataclass(frozen=True)
class Ladder:
    """``size`` numbers from ``first`` in equal strides, taken in steps."""

    first: float
    stride: float
    size: int
    step: int = 1

    def of(self, key: Column) -> Column:
        return F.lit(self.first) + F.pmod(key * self.step, F.lit(self.size)) * self.stride


@dataclass(frozen=True)
class Days:
    """Days from ``first``, ``size`` of them, taken in steps."""

    first: str
    size: int
    step: int = 1

    def of(self, key: Column) -> Column:
        return F.date_add(F.lit(self.first).cast("date"), F.pmod(key * self.step, F.lit(self.size)).cast("int"))


def generate(ids: DataFrame, key: str, columns: dict[str, Cycle | Ladder | Days], id_column: str = "id") -> DataFrame:
    """One row per id: ``key`` and the given columns, each a function of the id alone.

    ``ids`` may be ``spark.range(n)`` or the key column of any table, so the
    rows can be made again, in any order and on any number of tasks.
    """
    own = F.col(id_column).cast("bigint")
    return ids.select(own.alias(key), *[rule.of(own).alias(name) for name, rule in columns.items()])


#: One booking per id over the given flights and customers.
BOOKING_COLUMNS = {
    "flight_id": Cycle(tuple(row[0] for row in FLIGHTS), 5),
    "customer_id": Cycle(tuple(row[0] for row in CUSTOMERS), 3),
    "fare_class": Cycle(tuple(FARE_CLASSES), 7),
    "channel": Cycle(tuple(CHANNELS), 3),
    "booking_date": Days("2025-01-01", 365, 17),
    "base_fare_usd": Ladder(80.0, 12.5, 64, 19),
    "ancillary_usd": Ladder(0.0, 7.5, 13, 4),
    "seats": Ladder(1, 1, 5, 2),
    "status": Cycle(("flown", "flown", "booked", "flown", "cancelled", "flown", "booked"), 2),
}


def bookings(ids: DataFrame, flights: DataFrame, id_column: str = "id") -> DataFrame:
    """Bookings with the route of their flight; travel starts 10 to 49 days later."""
    rows = generate(ids, "booking_id", BOOKING_COLUMNS, id_column)
    lead = (F.lit(10) + F.pmod(F.col("booking_id") * 9, F.lit(40))).cast("int")
    return rows.join(flights.select("flight_id", "route_id"), "flight_id").withColumn(
        "travel_date", F.date_add("booking_date", lead)
    )
