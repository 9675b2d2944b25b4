"""Inputs that the queries derive from the given tables, as Spark columns and as SQL text.

The tables hold hardly any measurements, infoboxes or index lines, so these are composed from
their columns; every row of the table takes part.
"""

# Sentences around a quantity; "{}" is replaced by the row's own number.
SENTENCES = (
    "the load of {} kg was shipped", "a road of {} km was built", "sold for ${} in all",
    "about {} million people live there", "some {} people came by", "it took {} hours to load",
    "a share of {}% was kept", "heated to {} °C for a while", "moving at {} mph on average",
    "a tank of {} liters in the yard", "rated at {} kW of power", "tuned to {} MHz again",
    "a file of {} MB was sent", "the line ran at {} Mbps then", "noise of {} dB was heard",
    "won by {} votes in the end", "scored {} goals that year", "see Episode {} of the show",
    "the player aged {} was hired", "the {}th century was long", "about {} pages were read",
    "rated {} out of 50 by all", "box {} of the series", "it was just {} then",
    "a field of {} acres in size", "a peak of {} m above sea level", "an area of {} km² was sold",
    "some {} killed in the fire", "magnitude {} earthquake struck", "number {} on the list",
    "{} nautical miles out at sea", "bought {} square meters of land", "weighs {} pounds, or so",
    "for {} light-years around", "powered by {} V and more", "wore number {} for the club",
)

KINDS = (
    "settlement", "person", "chemical compound", "football club", "company", "film",
    "military conflict", "virus", "bridge", "election", "something random", "military person",
    "radio station", "power station", "football biography", "book_series", "National Park",
)

WIKITEXT = (
    "<!-- {{Infobox planet}} from 1066 -->{{Infobox ", "KIND", "\n| name = Doc ", "ID",
    "\n| size = {{convert|", "SIZE", "|m}}\n}}\n'''Doc''' is a [[", "LANG", " text|text of ", "SOURCE",
    "]] with ", "SIZE", " characters,<ref name=\"r7\">seen 3 times</ref> see [http://example.org/5 page 12].\n",
    "== Text ==\n", "TEXT", "\n* item 8\n[[Category:", "SOURCE", "]]\n",
)

# Leading digits of numbers that are filled up with nines.
DIGIT_HEADS = ("9.", "1.", "2.", "9.9", "1.09", "4.4", "99.", "0.9")

# Text before and after a number, and what its unit is.
UNIT_PHRASES = (
    ("it has ", " grams per cubic centimeter of it", "grams per cubic centimeter", "density"),
    ("it has ", " kilograms per cubic meter, or", "kilograms per cubic meter", "density"),
    ("it has ", " pounds per cubic foot.", "pounds per cubic foot", "density"),
    ("pumped to ", " pounds per square inch now", "pounds per square inch", "pressure"),
    ("it gave ", " tonnes of oil equivalent.", "tonnes of oil equivalent", "energy"),
    ("it gave ", " tonne of oil equivalent a day", "tonne of oil equivalent", "energy"),
    ("it has ", " grams per cup", "grams", "mass"),
    ("sold for US$", " each", "US$", "currency"),
    ("sold for € ", " each", "€", "currency"),
    ("sold for $", " pounds of it", "pounds", "currency,mass"),
    ("about ", " of them", None, None),
    ("a road of ", " square  miles", None, None),
)
