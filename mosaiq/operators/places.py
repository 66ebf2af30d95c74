"""Places of a group: which locations count, what line to show, and what may be published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.functions.text import title_case

#: Labels of addresses that are on file but may be someone's home.
MAILING = ("Mailing address (IRS)", "Contact address (City list)")


def _has(x: Column) -> Column:
    return F.coalesce(x != "", F.lit(False))


def is_mailing(location: Column) -> Column:
    return F.coalesce(location["label"].isin(*MAILING), F.lit(False))


def has_place(location: Column) -> Column:
    return _has(location["address"]) | _has(location["neighborhood"]) | _has(location["planning_district"])


def place_locations(locations: Column) -> Column:
    """The meeting places if any of them says where, else all locations."""
    meeting = F.filter(locations, lambda x: ~is_mailing(x))
    return F.when(F.exists(meeting, has_place), meeting).otherwise(locations)


def has_meeting_place(locations: Column) -> Column:
    return F.coalesce(F.exists(locations, lambda x: ~is_mailing(x) & (_has(x["address"]) | _has(x["neighborhood"]))), F.lit(False))


def place_line(locations: Column, online_ok: Column, labels: Column, online: str = "Online") -> Column:
    """The first place in the city: its neighborhood, else its district, by label (a map) or in title case; else online, if all is in the city."""
    in_city = lambda x: F.coalesce(x["in_city"], F.lit(False))
    here = F.get(F.filter(place_locations(locations), lambda x: in_city(x) & (_has(x["neighborhood"]) | _has(x["planning_district"]))), 0)
    name = F.when(_has(here["neighborhood"]), here["neighborhood"]).otherwise(here["planning_district"])
    label = F.coalesce(F.try_element_at(labels, name), title_case(name))
    outside = F.exists(locations, lambda x: ~in_city(x))
    return F.when(here.isNotNull(), label).when(F.coalesce(outside, F.lit(False)), F.lit(None)).when(F.coalesce(online_ok, F.lit(False)), F.lit(online))


def publish_zip_only(locations: Column) -> Column:
    """Mailing locations without address, point and neighborhood."""
    def one(x: Column) -> Column:
        bare = x.withField("address", F.lit(None).cast("string")).withField("lat", F.lit(None).cast("double")).withField("lng", F.lit(None).cast("double")).withField("neighborhood", F.lit(None).cast("string"))
        return F.when(is_mailing(x), bare).otherwise(x)

    return F.transform(locations, one)


#: Regions of the city, in order.
REGIONS = {"center-city": "Center City", "north": "North", "northeast": "Northeast", "northwest": "Northwest", "west-southwest": "West and Southwest", "south": "South"}
#: District to region.
DISTRICT_REGION = {
    "central": "center-city",
    "lower-north": "north", "north": "north", "upper-north": "north", "river-wards": "north",
    "north-delaware": "northeast", "lower-northeast": "northeast", "central-northeast": "northeast", "lower-far-northeast": "northeast", "upper-far-northeast": "northeast",
    "lower-northwest": "northwest", "upper-northwest": "northwest",
    "west": "west-southwest", "west-park": "west-southwest", "university-southwest": "west-southwest", "lower-southwest": "west-southwest",
    "south": "south", "lower-south": "south",
}


def _map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in d.items() for x in pair])


def region_of(district: Column) -> Column:
    """Region id of a district id in snake or kebab case; null if unknown."""
    return F.try_element_at(_map(DISTRICT_REGION), F.translate(district, "_", "-"))


def region_label(region: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(REGIONS), F.translate(region, "_", "-")), F.lit("Other"))


def districts_by_zip(rows: DataFrame, zips: DataFrame, neighborhoods: DataFrame) -> DataFrame:
    """rows(neighborhood, zip) with planning_district: the neighborhood's, else the ZIP's.  The dimensions are small and Spark sees it."""
    n = neighborhoods.select(F.col("id").alias("neighborhood"), F.col("district").alias("by_neighborhood"))
    z = zips.select("zip", F.col("district").alias("by_zip"))
    return rows.join(n, "neighborhood", "left").join(z, "zip", "left").withColumn("planning_district", F.coalesce("by_neighborhood", "by_zip")).drop("by_neighborhood", "by_zip")


def distance_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in a straight line."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * 6371.0088 * F.asin(F.sqrt(F.least(a, F.lit(1.0))))
