import random
import re
import time

import pytest
from pyspark.sql import functions as F

import digitscope as ds
from digitscope.functions.labels import domain_of_type, year_or_generic
from digitscope.rules.categories import CATEGORIES
from digitscope.rules.declared_rules import DECLARED_RULES
from digitscope.rules.number_rules import OBSERVED_RULES, TRIGGERS

# Number, context, category by the default rules.
CASES = [
    ("2", "December 2nd, 1999", "date_full"),
    ("2", "2nd place in the competition", "ranking"),
    ("1999", "born in 1999", "year"),
    ("1999", "altitude 1999 meters", "distance"),
    ("100", "$100", "money"),
    ("5", "$5 million", "money_magnitude"),
    ("100", "100 people", "population"),
    ("100", "100%", "percentage"),
    ("100", "just 100", "generic"),
    ("4", "4.2 light-years away", "distance_astro"),
    ("4", "4 km from here", "distance"),
    ("100", "100 feet tall", "distance"),
    ("25", "25°C today", "temperature"),
    ("77", "77°F outside", "temperature"),
    ("37", "37.7749° N latitude", "coordinates"),
    ("3", "3:45 PM", "time"),
    ("14", "14:30:00", "generic"),
    ("9", "9.58 seconds world record", "duration"),
    ("19", "19th century", "century_decade"),
    ("1", "1st place", "ranking"),
    ("2", "2nd edition of the book", "ranking"),
    ("500", "500 kWh of energy", "power"),
    ("100", "100 MW power plant", "power"),
    ("220", "220V electrical", "generic"),
    ("85", "85 dB noise level", "decibel"),
    ("7", "pH 7 neutral", "ph"),
    ("1", "1.5 solar masses", "mass_astro"),
    ("4", "magnitude 4.5 star", "richter"),
    ("6", "magnitude 6.5 earthquake", "richter"),
    ("3", "3-2 victory", "generic"),
    (".300", ".300 batting average", "generic"),
    ("23", "wore #23 jersey", "chart_position"),
    ("58", "58 goals scored", "record_stat"),
    ("5", "Episode 5 of the series", "episode_chapter"),
    ("3", "3 children in family", "generic"),
    ("8848", "8848 m above sea level", "elevation"),
    ("100", "100 m deep ocean", "depth"),
    ("50", "50 km² area", "area"),
    ("100", "100 acres of land", "area"),
    ("2", "2 liters of water", "volume"),
    ("1234567", "population of 1,234,567", "generic"),
    ("5000", "5,000 killed in battle", "generic"),
    ("1000", "won by 1000 votes", "votes"),
    ("500", "500 MB file", "file_size"),
    ("100", "100 Mbps speed", "file_size"),
    ("1920", "1920x1080 resolution", "resolution"),
    ("3", "3.5 GHz processor", "frequency"),
    ("2", "v2.0.1 software", "generic"),
    ("25", "25 years old", "duration"),
    ("30", "aged 30", "age"),
    ("2", "2 hours long", "duration"),
    ("30", "30 minutes", "duration"),
    ("75", "75% approval", "percentage"),
    ("4", "4 out of 5 rating", "rating"),
    ("1", "#1 on Billboard", "chart_position"),
    ("2000", "2000 km away", "distance"),
    ("1500", "1500 kg weight", "mass_weight"),
    ("1984", "published in 1984", "year"),
    ("1990", "1990s music", "year"),
    ("555", "(555) 123-4567 phone", "generic"),
    ("192", "192.168.1.1 IP address", "generic"),
    ("90210", "ZIP code 90210", "generic"),
    ("5", "5 x 1999 q", "generic"),
    ("5", "5 x 1999 today", "year"),
    ("5", "5 m³ of sand metre", "generic"),
    ("5", "5 km away", "distance"),
]


# Cases above whose declared category differs from the default one.
DECLARED = {
    "14:30:00": "time", "9.58 seconds world record": "time_record", "500 kWh of energy": "energy",
    "220V electrical": "electric", "magnitude 4.5 star": "magnitude_astro", "3-2 victory": "score_sports",
    ".300 batting average": "batting_avg", "wore #23 jersey": "jersey_number", "3 children in family": "small_count",
    "population of 1,234,567": "population", "5,000 killed in battle": "casualties", "100 Mbps speed": "bit_rate",
    "3.5 GHz processor": "clock_speed", "v2.0.1 software": "version", "25 years old": "age",
    "1990s music": "century_decade", "(555) 123-4567 phone": "phone", "192.168.1.1 IP address": "ip_address",
    "ZIP code 90210": "postal_code",
}


def test_declared_rules(spark):
    cases = [(n, c, DECLARED.get(c, k)) for n, c, k in CASES[:62]]
    got = label(spark, [(n, c) for n, c, _ in cases], category=ds.declared_category)
    wrong = [(case, k) for case, k in zip(cases, got) if k != case[2]]
    assert not wrong
    more = [("550", "550 nm laser", "wavelength"), ("10", "10 kN load", "force"), ("5", "5 mSv dose", "radiation"),
            ("1000", "1000 gauss field", "magnetic"), ("5", "5 ppm of lead", "concentration"), ("1", "ISBN 1-2345", "isbn"),
            ("1.2", "1.2 g/cm³ rock", "density"), ("456", "flight UA 456", "flight_number"), ("5", "5 pages", "small_count")]
    assert label(spark, [(n, c) for n, c, _ in more], category=ds.declared_category) == [k for _, _, k in more]


def test_every_declared_category_has_a_rule():
    assert {c for c, _ in DECLARED_RULES} | {"generic"} == {row[0] for row in CATEGORIES}


def label(spark, rows, category=ds.number_category):
    df = spark.createDataFrame([(i, n, c) for i, (n, c) in enumerate(rows)], "i int, n string, c string")
    out = df.select("i", category(F.col("n"), F.col("c")).alias("k")).collect()
    return [r.k for r in sorted(out, key=lambda r: r.i)]


def test_known_contexts(spark):
    got = label(spark, [(n, c) for n, c, _ in CASES])
    wrong = [(case, k) for case, k in zip(CASES, got) if k != case[2]]
    assert not wrong


def by_search(number, context):
    low = context.lower()
    try:
        fallback = "year" if 1000 <= int(float(number.replace(",", ""))) <= 2100 else "generic"
    except ValueError:
        fallback = "generic"
    if number.replace(",", "") not in context or not any(t in low for t in TRIGGERS):
        return fallback
    for category, pattern, words in OBSERVED_RULES:
        if (not words or any(w in low for w in words)) and re.search(pattern, context, re.I):
            return category
    return fallback


def test_random_contexts_agree_with_a_plain_search(spark):
    rng = random.Random(11)
    words = ("km km² m³ kg lbs ft in mph kWh MW °C Hz GHz V A Ω pages bar MB Mbps dB people killed votes years hours "
             "goals % stars place nd th million $ € # Episode aged magnitude pH wore number Jan January 1999 1984 am PM "
             ": / × x 1080p 4k century 1990s parsecs ly au deep below m acres ha ml l yd k knots m/s hp ev mAh psi "
             "latitude N ° of out the family é ñ ß").split()
    rows = []
    for _ in range(8000):
        number = rng.choice(["5", "12", "1999", "1500", "2050", "100", "3.5", "23"])
        parts = ([rng.choice(words) for _ in range(rng.randint(0, 4))] + [number]
                 + [rng.choice(words) for _ in range(rng.randint(0, 4))])
        rows.append((number, "".join(p + rng.choice(["", " ", " ", " "]) for p in parts)))
    got = label(spark, rows)
    wrong = [(row, k, by_search(*row)) for row, k in zip(rows, got) if k != by_search(*row)]
    assert not wrong, wrong[:5]


def test_year_heuristic_truncates(spark):
    df = spark.createDataFrame([("999.9",), ("1000",), ("2100.9",), ("2101",), ("1,999",), ("abc",)], "n string")
    got = [r.k for r in df.select(year_or_generic(F.col("n")).alias("k")).collect()]
    assert got == ["generic", "year", "year", "generic", "year", "generic"]


@pytest.mark.parametrize("kind, domain", [
    ("settlement", "Geography"), ("person", "People"), ("chemical compound", "Science"), ("football club", "Sports"),
    ("company", "Business"), ("film", "Media"), ("military conflict", "Military"), ("speciesbox", "Biology"),
    ("bridge", "Infrastructure"), ("election", "Events"), ("something random", "Uncategorized"),
    ("military person", "People"), ("radio station", "Media"), ("power station", "Infrastructure"),
    ("football biography", "People"), ("_person", "Uncategorized"), ("", "Uncategorized"), ("an NGO", "Business"),
])
def test_domain_of_type(spark, kind, domain):
    assert spark.range(1).select(domain_of_type(F.lit(kind)).alias("d")).first().d == domain


def test_first_match_label_is_ordered_and_null_safe(spark):
    df = spark.createDataFrame([("a b",), ("b",), (None,)], "x string")
    out = df.select(ds.first_match_label(F.col("x"), [("A", "a"), ("B", "b")], "none").alias("k")).collect()
    assert [r.k for r in out] == ["A", "B", "none"]


def test_long_digit_runs_take_linear_time(spark):
    digits = "3." + "14159265" * 50000
    started = time.time()
    context = f"about {digits} km, or $ 5 million people in May"
    assert label(spark, [(digits, context)]) == ["distance"]
    assert label(spark, [(digits, context.replace("km", "zz"))]) == ["money_magnitude"]
    assert time.time() - started < 30
