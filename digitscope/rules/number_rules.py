r"""Context rules that label a number by what is measured around it.

A rule is ``(category, pattern, triggers)``. It applies when its pattern is found in the
context and, if it lists triggers, at least one of them occurs in the lower-cased context.
Patterns use ``\b``, ``\d``, ``\s`` and ``.`` in their Unicode sense; ``functions.labels``
turns them into the engine's regex dialect. Order is meaning: the first rule that applies wins.
"""

from __future__ import annotations

# Words of which at least one must occur before any rule is tried.
TRIGGERS = (
    "$", "€", "£", "¥", "₹", "₩", "dollar", "euro", "pound", "yen", "yuan",
    "usd", "eur", "gbp", "million", "billion", "trillion",
    "km", "mi", "meter", "metre", "feet", "foot", "inch", "yard", "mile",
    "kg", "lb", "gram", "ton", "ounce",
    "km²", "m²", "acre", "hectare", "square",
    "liter", "litre", "gallon", "ml",
    "°c", "°f", "celsius", "fahrenheit", "kelvin",
    "km/h", "mph", "m/s", "knot",
    "kw", "mw", "gw", "watt", "horsepower",
    "hz", "mhz", "ghz", "khz",
    "volt", "amp", "ohm",
    "ev", "joule", "calorie", "kwh",
    "pa", "bar", "psi", "atm",
    "db", "decibel",
    "light-year", "parsec", "au ", "astronomical",
    "solar mass", "earth mass",
    "%", "percent",
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
    "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "oct", "nov", "dec",
    "am", "pm", "hour", "minute", "second", "day", "week", "month", "year",
    "century", "decade",
    "population", "people", "inhabitants", "residents",
    "killed", "dead", "death", "casualties", "wounded",
    "vote", "votes", "ballot",
    "1st", "2nd", "3rd", "4th", "5th", "th ", "nd ", "rd ", "st ",
    "place", "rank", "position", "largest", "edition",
    "out of", "stars", "rating",
    "#", "number",
    "goal", "point", "run", "yard", "rbi", "assist", "rebound",
    "batting", "average", "jersey", "wore",
    "mb", "gb", "tb", "kb", "byte", "mbps", "gbps",
    "1080", "720", "4k", "8k", "resolution",
    "magnitude", "richter", "earthquake",
    "ph ", "ph=", "ph:",
    "elevation", "altitude", "above sea level", "below sea level", "depth", "deep",
    "age", "aged", "years old",
    "episode", "chapter", "season", "volume",
    "version", "v1", "v2", "v3",
    "isbn", "phone", "tel", "fax",
    "° n", "° s", "° e", "° w", "latitude", "longitude",
)

_MONTHS = (
    "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "oct", "nov", "dec",
    "january", "february", "march", "april", "june", "july", "august", "september",
    "october", "november", "december",
)

# Rules in matching order. Triggers that are not in TRIGGERS never fire and are
# left out, and with them the slash-date and score rules, whose triggers are all of that kind.
OBSERVED_RULES = (
    ("date_full", r"\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{1,2}(?:st|nd|rd|th)?,?\s+\d{4}\b",
     _MONTHS),
    ("time", r"\b\d{1,2}:\d{2}(?::\d{2})?\s?(?:am|pm)?\b",
     ("am", "pm")),
    ("coordinates", r"\b\d+\.?\d*\s?°\s?[nsew]\b",
     ("latitude", "longitude", "° n", "° s", "° e", "° w")),
    ("resolution", r"\b\d{3,5}\s?[x×]\s?\d{3,5}\b|(?:4k|8k|1080[pi]|720[pi])",
     ("1080", "720", "4k", "8k", "resolution")),
    ("distance_astro", r"\b\d[\d,]*\.?\d*\s?(?:light-years?|ly|parsecs?|pc|kpc|mpc|au)\b",
     ("light-year", "parsec", "au ", "astronomical")),
    ("mass_astro", r"\b\d[\d,]*\.?\d*\s?(?:solar mass|earth mass|jupiter mass|m☉|m⊕)",
     ("solar mass", "earth mass")),
    ("elevation", r"\b\d[\d,]*\.?\d*\s?(?:m|meters?|ft|feet)\s+(?:above sea level|asl)",
     ("above sea level", "elevation", "altitude")),
    ("depth", r"\b\d[\d,]*\.?\d*\s?(?:m|meters?|ft|feet)\s+(?:deep|below|depth)",
     ("deep", "depth", "below sea level")),
    ("area", r"\b\d[\d,]*\.?\d*\s?(?:km²|km2|m²|mi²|ft²|hectares?|ha\b|acres?|sq\s+(?:km|mi|ft|m))",
     ("km²", "m²", "acre", "hectare", "square")),
    ("volume", r"\b\d[\d,]*\.?\d*\s?(?:liters?|litres?|l\b|ml|gallons?|gal\b)",
     ("liter", "litre", "gallon", "ml")),
    ("mass_weight", r"\b\d[\d,]*\.?\d*\s?(?:kg|kilograms?|g\b|grams?|lbs?|pounds?|tons?|tonnes?|oz|ounces?)",
     ("kg", "lb", "gram", "pound", "ton", "ounce")),
    ("distance", r"\b\d[\d,]*\.?\d*\s?(?:km|kilometers?|kilometres?|m\b|meters?|metres?|mi\b|miles?|ft|feet|foot|in\b|inches?|yd|yards?)",
     ("km", "mi", "meter", "metre", "feet", "foot", "inch", "yard", "mile")),
    ("temperature", r"\b\d[\d,]*\.?\d*\s?(?:°[cf]|degrees?\s+(?:celsius|fahrenheit)|kelvin|k\b)",
     ("°c", "°f", "celsius", "fahrenheit", "kelvin")),
    ("speed", r"\b\d[\d,]*\.?\d*\s?(?:km/h|kph|mph|m/s|knots?)",
     ("km/h", "mph", "m/s", "knot")),
    ("power", r"\b\d[\d,]*\.?\d*\s?(?:kw|mw|gw|watts?|horsepower|hp\b)",
     ("kw", "mw", "gw", "watt", "horsepower")),
    ("energy", r"\b\d[\d,]*\.?\d*\s?(?:kwh|mwh|joules?|calories?|kcal|ev\b|kev|mev|gev)",
     ("kwh", "joule", "calorie", "ev")),
    ("frequency", r"\b\d[\d,]*\.?\d*\s?(?:hz|khz|mhz|ghz|thz)",
     ("hz", "khz", "mhz", "ghz")),
    ("electric", r"\b\d[\d,]*\.?\d*\s?(?:volts?|v\b|amps?|amperes?|a\b|ohms?|Ω|mah)",
     ("volt", "amp", "ohm")),
    ("pressure", r"\b\d[\d,]*\.?\d*\s?(?:pa|kpa|mpa|bar|psi|atm)",
     ("pa", "bar", "psi", "atm")),
    ("file_size", r"\b\d[\d,]*\.?\d*\s?(?:kb|mb|gb|tb|pb|bytes?)",
     ("kb", "mb", "gb", "tb", "byte")),
    ("bit_rate", r"\b\d[\d,]*\.?\d*\s?(?:kbps|mbps|gbps|bit/s)",
     ("mbps", "gbps")),
    ("decibel", r"\b\d[\d,]*\.?\d*\s?(?:db|decibels?)",
     ("db", "decibel")),
    ("ph", r"\bph\s+(?:of\s+)?(\d+\.?\d*)",
     ("ph ",)),
    ("money_magnitude", r"[$€£¥₹]\s?\d[\d,]*\.?\d*\s+(?:thousand|million|billion|trillion)",
     ("$", "€", "£", "¥", "₹", "million", "billion", "trillion")),
    ("money", r"[$€£¥₹]\s?\d[\d,]*\.?\d*",
     ("$", "€", "£", "¥", "₹", "dollar", "euro", "pound", "usd", "eur", "gbp")),
    ("population", r"\b\d[\d,]*\.?\d*\s+(?:people|inhabitants|residents|population)",
     ("population", "people", "inhabitants", "residents")),
    ("casualties", r"\b\d[\d,]*\.?\d*\s+(?:killed|dead|deaths?|casualties|wounded|injured)",
     ("killed", "dead", "death", "casualties", "wounded")),
    ("votes", r"\b\d[\d,]*\.?\d*\s+(?:votes?|ballots?)",
     ("vote", "ballot")),
    ("duration", r"\b\d[\d,]*\.?\d*\s+(?:hours?|minutes?|seconds?|days?|weeks?|months?|years?)\b",
     ("hour", "minute", "second", "day", "week", "month", "year")),
    ("age", r"\b\d[\d,]*\.?\d*\s+years?\s+old|aged\s+\d+",
     ("years old", "aged")),
    ("record_stat", r"\b\d[\d,]*\.?\d*\s+(?:goals?|points?|runs?|yards?|rbis?|assists?|rebounds?)",
     ("goal", "point", "run", "yard", "rbi", "assist", "rebound")),
    ("percentage", r"\b\d[\d,]*\.?\d*\s?%|\b\d[\d,]*\.?\d*\s+percent",
     ("%", "percent")),
    ("rating", r"\b\d+\.?\d*\s+(?:out of|/)\s+\d+|\b\d+\.?\d*\s+stars?",
     ("out of", "stars")),
    ("ranking", r"\b\d+(?:st|nd|rd|th)\s+(?:place|position|largest|biggest|smallest|edition|best|worst)",
     ("place", "position", "largest", "edition", "1st", "2nd", "3rd", "th ")),
    ("chart_position", r"#\s?\d+|number\s+\d+\s+(?:on|in).*(?:chart|billboard)",
     ("#", "number")),
    ("richter", r"(?:magnitude|richter)\s+\d+\.?\d*|\d+\.?\d*\s+(?:on the\s+)?richter",
     ("magnitude", "richter", "earthquake")),
    ("episode_chapter", r"(?:episode|chapter|season|volume)\s+\d+",
     ("episode", "chapter", "season", "volume")),
    ("century_decade", r"\b\d{1,2}(?:st|nd|rd|th)\s+century|\b(?:19|20)\d{2}s\b",
     ("century", "decade")),
    ("jersey_number", r"(?:wore|number|#)\s*\d{1,2}\b.*(?:jersey|shirt|uniform)?",
     ("wore", "jersey")),
    ("year", r"\b(1[0-9]{3}|20[0-2][0-9])\b",
     ()),
)

# Bounds of the year heuristic, the label it gives, and the label of the rest.
YEAR_RANGE = (1000, 2100)
YEAR_LABEL = "year"
GENERIC_LABEL = "generic"
