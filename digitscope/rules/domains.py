"""Subject domains recognised from infobox types."""

DEFAULT_DOMAIN = "Uncategorized"

# Domains in matching order, each with its whole-word keywords.
DOMAIN_KEYWORDS = (
    ("Geography", (
        "settlement", "country", "city", "region", "body of water", "mountain", "island",
        "river", "lake", "sea", "ocean", "valley", "desert", "forest", "park",
        "protected area", "place", "location", "administrative division", "municipality",
        "province", "state", "territory", "continent",
    )),
    ("People", (
        "person", "officeholder", "scientist", "artist", "writer", "musician", "athlete",
        "actor", "politician", "military person", "biography", "sportsperson",
        "football biography", "basketball biography", "baseball biography",
        "ice hockey player", "cricketer", "tennis biography", "royalty", "noble",
        "philosopher", "economist", "engineer",
    )),
    ("Science", (
        "element", "planet", "star", "chemical compound", "mineral", "disease", "drug",
        "medication", "medical condition", "anatomy", "constellation", "galaxy", "nebula",
        "astronomical object", "particle", "molecule", "isotope", "ion",
    )),
    ("Sports", (
        "sports team", "stadium", "tournament", "football club", "basketball team",
        "baseball team", "ice hockey team", "sports season", "sports league",
        "racing driver", "cyclist", "olympian", "sports competition",
        "football club season",
    )),
    ("Business", (
        "company", "organization", "university", "college", "school", "corporation",
        "airline", "bank", "brand", "product", "software", "website", "nonprofit", "NGO",
    )),
    ("Media", (
        "film", "television", "album", "single", "song", "video game", "book", "magazine",
        "newspaper", "TV channel", "radio station", "musical artist", "band", "podcast",
        "television episode", "television season", "anime", "manga",
    )),
    ("Military", (
        "military conflict", "weapon", "aircraft", "ship", "military unit", "battle",
        "war", "military structure", "military vehicle", "submarine", "warship", "tank",
        "gun", "missile", "military operation",
    )),
    ("Biology", (
        "taxobox", "speciesbox", "automatic taxobox", "subspeciesbox", "virus",
        "bacteria", "fungus", "plant", "animal", "insect", "bird", "fish", "mammal",
        "reptile", "amphibian",
    )),
    ("Infrastructure", (
        "bridge", "building", "station", "airport", "road", "highway", "railway",
        "tunnel", "dam", "power station", "lighthouse", "skyscraper", "tower",
        "shopping mall", "hotel",
    )),
    ("Events", (
        "election", "event", "disaster", "earthquake", "hurricane", "tornado", "flood",
        "fire", "accident", "festival", "ceremony", "conference", "summit",
    )),
)
