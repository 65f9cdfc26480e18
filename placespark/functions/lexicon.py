"""Word tables of the description language."""

# Cardinal words and what they stand for.
CARDINALS = {
    "north": "N", "north - central": "N", "north central": "N", "central - north": "N", "central north": "N",
    "south": "S", "south - central": "S", "south central": "S", "central - south": "S", "central south": "S",
    "east": "E", "east - central": "E", "east central": "E", "central - east": "E", "central east": "E",
    "west": "W", "west - central": "W", "west central": "W", "central - west": "W", "central west": "W",
    "northeast": "NE", "north - east": "NE", "north east": "NE", "north - northeast": "NE", "north northeast": "NE",
    "northwest": "NW", "north - west": "NW", "north west": "NW", "north - northwest": "NW", "north northwest": "NW",
    "southeast": "SE", "south - east": "SE", "south east": "SE", "south - southeast": "SE", "south southeast": "SE",
    "southwest": "SW", "south - west": "SW", "south west": "SW", "south - southwest": "SW", "south southwest": "SW",
    "northern": "N", "southern": "S", "eastern": "E", "western": "W",
    "northeastern": "NE", "northwestern": "NW", "southeastern": "SE", "southwestern": "SW",
    "north eastern": "NE", "north western": "NW", "south eastern": "SE", "south western": "SW",
    "center": "C", "central": "C", "left": "E", "right": "W",
}

# Region words, which say nothing about the place.
REGIONS = (
    "region part coast mountain slope slopes city town towns suburb district municipality province village commune"
    " state seat school river area areas capital"
).split() + ["recreation center", "central business district"]

# Distance units, metres per unit.
UNITS = {
    "km": "KM", "kilometer": "KM", "kilometre": "KM", "kilometers": "KM", "kilometres": "KM",
    "ml": "MI", "mile": "MI", "miles": "MI", "nautical mile": "NMI", "nautical miles": "NMI", "minute": "KM",
}
UNIT_METERS = {"KM": 1000.0, "MI": 1609.344, "NMI": 1852.0}

# Words that may be passed over; a region or a number, also an ordinal, may be too.
SKIPPED = "a is located situated the in at of on by to with which that , - ( ) and".split()
ORDINALS = ["st", "nd", "rd", "th"]

# Azimuth of each cardinal in degrees, and its opposite; the center has neither.
AZIMUTHS = {"N": 0.0, "NE": 45.0, "E": 90.0, "SE": 135.0, "S": 180.0, "SW": 225.0, "W": 270.0, "NW": 315.0, "C": -1.0}
OPPOSITES = {"N": "S", "S": "N", "E": "W", "W": "E", "NE": "SW", "NW": "SE", "SE": "NW", "SW": "NE"}

# Words of the phrases that introduce a relation.
PHRASE_WORDS = (
    "SHP part of capital in on at within located is a an the belongs to from between and links with linking connects"
    " connecting border surroundings opposite near close adjacent next shore shores by borders bordered neighboring are"
    " situated over which that ;"
).split()

# Link targets too general to stand for a place.
GENERIC_PLACES = ("Europe", "Africa", "Asia", "Oceania", "Americas", "South_America", "North_America")
GENERIC_PART = "road_network"

# Annotation states.
STATUSES = ("5", "4", "3", "2", "1")


def words() -> list[str]:
    """Every token the description language knows."""
    phrases = [*CARDINALS, *REGIONS, *UNITS, *SKIPPED, *ORDINALS, *PHRASE_WORDS]
    return sorted({word for phrase in phrases for word in phrase.split()})


def entries() -> list[tuple[str, str, str]]:
    """(phrase, kind, value) of all word tables."""
    found = [(p, "Cardinal", v) for p, v in CARDINALS.items()]
    found += [(p, "Region", "") for p in REGIONS]
    found += [(p, "Unit", v) for p, v in UNITS.items()]
    found += [(p, "Skip", "") for p in SKIPPED]
    return found
