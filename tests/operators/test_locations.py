from ledgerlake.operators import locations

CITIES = [("York", "PA"), ("New York", "NY"), ("York", "NY"), ("North Little Rock", "AR"), ("Little Rock", "AR"), ("St. John's", "NL"), ("London", "GBR"), ("new  york", "ny"), (None, "NY"), ("", "NY")]


def located(spark, texts, cities=CITIES):
    rows = spark.createDataFrame([(t, 1) for t in texts], "description string, city int")
    out = locations.locate(rows, spark.createDataFrame(cities, "city string, state string"))
    return {r.description: (r.merchant, r.city, r.state) for r in out.collect()}


def test_the_longest_known_city_counts(spark, tmp_path):
    got = located(spark, ["Cafe New York NY", "NEW YORK PIZZA york NY", "Shop North Little Rock AR", "Shop Little Rock AR", "Deli  St. John's   NL", "Pub London GBR", "Diner Springfield IL", "New York NY", "York NY", "Just A Name", "", "Cafe New York NY"])
    assert got == {
        "Cafe New York NY": ("Cafe", "New York", "NY"),
        "NEW YORK PIZZA york NY": ("NEW YORK PIZZA", "york", "NY"),
        "Shop North Little Rock AR": ("Shop", "North Little Rock", "AR"),
        "Shop Little Rock AR": ("Shop", "Little Rock", "AR"),
        "Deli  St. John's   NL": ("Deli", "St. John's", "NL"),
        "Pub London GBR": ("Pub", "London", "GBR"),
        "Diner Springfield IL": ("Diner", "Springfield", "IL"),
        "New York NY": ("New", "York", "NY"),
        "York NY": ("York NY", None, None),
        "Just A Name": ("Just A Name", None, None),
        "": ("", None, None),
    }
    (tmp_path / "g.csv").write_text('city,state\n"Winston Salem",NC\n')
    gazetteer = locations.read_gazetteer(spark, str(tmp_path / "g.csv"))
    assert [tuple(r) for r in locations.locate(spark.createDataFrame([("Bar Winston Salem NC",)], "description string"), gazetteer).collect()] == [("Bar Winston Salem NC", "Bar", "Winston Salem", "NC")]


def test_no_gazetteer_and_nulls(spark):
    assert located(spark, ["Diner Springfield IL", "Cafe New York NY"], []) == {"Diner Springfield IL": ("Diner", "Springfield", "IL"), "Cafe New York NY": ("Cafe New", "York", "NY")}
    rows = spark.createDataFrame([(None,)], "description string")
    out = locations.locate(rows, spark.createDataFrame(CITIES, "city string, state string")).first()
    assert (out.merchant, out.city, out.state) == (None, None, None)
