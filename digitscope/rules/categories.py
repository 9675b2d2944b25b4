"""Number-category dimension: group and declared conformity band of each category."""

LOW, MID, HIGH, UNKNOWN = "< 0.03", "0.03-0.08", "> 0.08", "unknown"

# Bounds of each declared band.
BAND_BOUNDS = {
    LOW: (0.0, 0.03),
    MID: (0.03, 0.08),
    HIGH: (0.08, None),
    UNKNOWN: (None, None),
}

# Category, group, declared band, description, examples, notes.
CATEGORIES = (
    ("date_full", "temporal", HIGH, "Complete dates (month/day/year)", ("December 25, 2025", "12/25/2025", "2025-12-25"), None),
    ("year", "temporal", HIGH, "Standalone years (1000-2100)", ("1999", "in 2024"), "Heavily biased toward 1 and 2 as first digits"),
    ("time", "temporal", HIGH, "Clock times", ("3:45 PM", "14:30:00"), "Hours 0-23, constrained range"),
    ("duration", "temporal", MID, "Time durations", ("2 hours", "30 minutes", "5 days"), None),
    ("age", "temporal", MID, "Human ages", ("25 years old", "aged 30"), "Most common 20-80, moderate violation"),
    ("century_decade", "temporal", HIGH, "Centuries and decades", ("19th century", "1990s"), None),
    ("phone", "identifier", HIGH, "Phone numbers", ("(555) 123-4567", "+1-800-555-0100"), "Assigned, not natural"),
    ("postal_code", "identifier", HIGH, "Postal codes", ("90210", "SW1A 1AA", "M5V 3L9"), None),
    ("isbn", "identifier", HIGH, "ISBN numbers", ("ISBN 978-3-16-148410-0",), None),
    ("ip_address", "identifier", HIGH, "IP addresses", ("192.168.1.1",), None),
    ("coordinates", "identifier", HIGH, "Geographic coordinates", ("37.7749° N", "122.4194° W"), "Constrained range (-90 to 90, -180 to 180)"),
    ("version", "identifier", MID, "Software version numbers", ("v2.0.1", "version 3.5"), None),
    ("flight_number", "identifier", HIGH, "Flight numbers", ("AA123", "UA 456"), None),
    ("ranking", "ranking", MID, "Rankings and ordinals", ("1st place", "2nd largest", "3rd edition"), "Weighted toward 1st, 2nd"),
    ("score_sports", "ranking", MID, "Sports scores", ("3-2", "won 4-1"), "Typical 0-10 range"),
    ("rating", "ranking", HIGH, "Rating scales", ("4 out of 5", "8/10", "3.5 stars"), None),
    ("percentage", "ranking", HIGH, "Percentages", ("75%", "0.5 percent"), "Constrained 0-100"),
    ("chart_position", "ranking", MID, "Chart positions", ("#1", "number 5 on Billboard"), None),
    ("distance", "measurement", LOW, "Linear distances", ("5 km", "100 miles", "2.5 meters"), "Scale-invariant, should conform"),
    ("distance_astro", "measurement", LOW, "Astronomical distances", ("4.2 light-years", "10 parsecs", "5 AU"), "Many orders of magnitude, should conform"),
    ("area", "measurement", LOW, "Areas", ("50 km²", "100 acres", "2.5 hectares"), "Wide range, should conform"),
    ("volume", "measurement", LOW, "Volumes", ("2 liters", "5 gallons", "100 mL"), None),
    ("mass_weight", "measurement", LOW, "Mass and weight", ("70 kg", "150 lbs", "500 grams"), "Wide range, should conform"),
    ("mass_astro", "measurement", LOW, "Astronomical masses", ("1.5 solar masses", "10 Earth masses"), None),
    ("elevation", "measurement", LOW, "Elevation above sea level", ("8848 m above sea level", "altitude 500 ft"), "Wide range, should conform"),
    ("depth", "measurement", LOW, "Depth below surface", ("100 m deep", "depth of 50 ft"), None),
    ("temperature", "measurement", MID, "Temperature", ("25°C", "77°F", "300 K"), "Often clustered around common temps (0-40°C)"),
    ("speed", "measurement", LOW, "Velocities", ("100 km/h", "60 mph", "5 m/s"), None),
    ("time_record", "measurement", UNKNOWN, "Sports/race times", ("9.58 seconds", "2:01:39"), None),
    ("energy", "scientific", LOW, "Energy", ("500 kWh", "2000 calories", "5 MeV"), "Industrial scale, wide range"),
    ("power", "scientific", LOW, "Power", ("100 MW", "5 kW", "200 horsepower"), None),
    ("force", "scientific", LOW, "Force", ("10 kN", "500 N"), None),
    ("pressure", "scientific", LOW, "Pressure", ("101.3 kPa", "14.7 psi", "1 atm"), None),
    ("frequency", "scientific", LOW, "Frequency", ("2.4 GHz", "440 Hz"), None),
    ("wavelength", "scientific", LOW, "Wavelength", ("550 nm", "1.5 μm"), None),
    ("electric", "scientific", LOW, "Electrical measurements", ("220V", "10A", "100Ω", "500mAh"), None),
    ("magnetic", "scientific", LOW, "Magnetic field strength", ("1.5 T", "1000 gauss"), None),
    ("radiation", "scientific", LOW, "Radiation dosage", ("5 mSv", "100 Bq"), None),
    ("concentration", "scientific", LOW, "Chemical concentration", ("5 ppm", "0.1 M", "50 mg/dL"), None),
    ("density", "scientific", LOW, "Density", ("1.2 g/cm³", "800 kg/m³"), None),
    ("money", "financial", LOW, "Currency amounts", ("$100", "€50", "£25"), "Wide range, should conform"),
    ("money_magnitude", "financial", LOW, "Large currency amounts with magnitude", ("$5 million", "€2 billion", "$100 thousand"), "Many orders of magnitude, should conform"),
    ("population", "demographic", LOW, "Population counts", ("population of 1 million", "5,000 people"), "Many orders of magnitude, should conform well"),
    ("casualties", "demographic", LOW, "Casualty counts", ("5,000 killed", "100 wounded"), "Historical battles vary widely"),
    ("votes", "demographic", LOW, "Vote counts", ("won by 1000 votes", "50,000 ballots"), None),
    ("file_size", "computing", UNKNOWN, "Data file sizes", ("500 MB", "2 GB", "1.5 TB"), "May be constrained by storage conventions"),
    ("bit_rate", "computing", UNKNOWN, "Data transfer rates", ("128 kbps", "10 Mbps", "1 Gbps"), None),
    ("resolution", "computing", HIGH, "Display resolutions", ("1920x1080", "4K", "720p"), "Standard resolutions dominate"),
    ("clock_speed", "computing", UNKNOWN, "Processor clock speeds", ("3.5 GHz", "2.4 MHz"), None),
    ("richter", "logarithmic", HIGH, "Earthquake magnitude", ("magnitude 6.5", "Richter scale 7.2"), "Logarithmic scale, typical range 2-9"),
    ("decibel", "logarithmic", MID, "Sound level", ("85 dB", "100 decibels"), "Logarithmic, but wider practical range"),
    ("ph", "logarithmic", HIGH, "pH levels", ("pH 7.4", "pH of 5"), "Constrained 0-14, logarithmic"),
    ("magnitude_astro", "logarithmic", MID, "Stellar magnitude", ("apparent magnitude 4.5", "magnitude -26"), "Logarithmic, negative to positive"),
    ("batting_avg", "sports", HIGH, "Baseball batting averages", (".300", ".256"), "Typical range .200-.400"),
    ("jersey_number", "sports", HIGH, "Jersey/uniform numbers", ("number 23", "wore #10"), "Typically 1-99, favorites like 7, 10, 23"),
    ("record_stat", "sports", UNKNOWN, "Sports statistics", ("58 goals", "102 RBIs"), None),
    ("small_count", "count", HIGH, "Small counting numbers (1-20)", ("3 children", "5 albums"), "Constrained range 1-20"),
    ("episode_chapter", "count", UNKNOWN, "Episode/chapter/season numbers", ("Episode 5", "Chapter 12", "Season 3"), None),
    ("generic", "fallback", UNKNOWN, "Numbers not matching any specific pattern", ("standalone numbers without clear context",), "Mixed content, behavior unpredictable"),
)

# Expected conformity of each group.
GROUPS = (
    ("temporal", "non-conforming"),
    ("identifier", "non-conforming"),
    ("ranking", "non-conforming"),
    ("measurement", "mostly conforming"),
    ("scientific", "conforming"),
    ("financial", "conforming"),
    ("demographic", "strongly conforming"),
    ("computing", "mixed"),
    ("logarithmic", "non-conforming"),
    ("sports", "mixed"),
    ("count", "mixed"),
    ("fallback", "unknown"),
)

# What the categories of each group are.
GROUP_DESCRIPTIONS = {
    "temporal": "Time-related numbers",
    "identifier": "Assigned identifiers and codes",
    "ranking": "Rankings, scores, ratings",
    "measurement": "Physical measurements",
    "scientific": "Scientific/technical measurements",
    "financial": "Money and financial data",
    "demographic": "Population and people counts",
    "computing": "Computer/digital measurements",
    "logarithmic": "Logarithmic scales",
    "sports": "Sports-related numbers",
    "count": "Counting numbers",
    "fallback": "Unclassified numbers",
}
