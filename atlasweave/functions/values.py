"""Fixed values of the directory's conventions: results must equal those of other tools, so tables, patterns and their order are given."""

US_STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT",
    "delaware": "DE", "florida": "FL", "georgia": "GA", "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA",
    "kansas": "KS", "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD", "massachusetts": "MA", "michigan": "MI",
    "minnesota": "MN", "mississippi": "MS", "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV", "new hampshire": "NH",
    "new jersey": "NJ", "new mexico": "NM", "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH",
    "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA", "rhode island": "RI", "south carolina": "SC", "south dakota": "SD",
    "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT", "virginia": "VA", "washington": "WA", "west virginia": "WV",
    "wisconsin": "WI", "wyoming": "WY",
    "district of columbia": "DC", "puerto rico": "PR", "guam": "GU", "us virgin islands": "VI", "american samoa": "AS", "northern mariana islands": "MP",
}

CA_PROVINCES = {
    "alberta": "AB", "british columbia": "BC", "manitoba": "MB", "new brunswick": "NB", "newfoundland and labrador": "NL",
    "newfoundland & labrador": "NL", "newfoundland": "NL", "nova scotia": "NS", "northwest territories": "NT", "nunavut": "NU",
    "ontario": "ON", "prince edward island": "PE", "quebec": "QC", "quebec province": "QC", "saskatchewan": "SK", "yukon": "YT",
    "yukon territory": "YT",
}

COUNTRIES = {
    "united states": "USA", "united states of america": "USA", "us": "USA", "usa": "USA", "u.s.a.": "USA", "u.s.": "USA",
    "canada": "Canada", "haiti": "Haiti", "dominican republic": "Dominican Republic", "jamaica": "Jamaica",
    "trinidad and tobago": "Trinidad and Tobago", "nicaragua": "Nicaragua", "dominica": "Dominica", "costa rica": "Costa Rica",
    "grenada": "Grenada", "mexico": "Mexico",
}

#: Words that a title keeps in lower case unless they begin it.
SMALL_WORDS = ("a", "an", "the", "and", "but", "or", "for", "nor", "at", "by", "in", "of", "on", "to", "up", "as")

#: Where relative links of a source lead.
BASE_URLS = {
    "chicago-rocor": "https://chicagodiocese.org", "ea-diocese": "https://eadiocese.org", "goarch": "https://www.goarch.org",
    "antiochian": "https://www.antiochian.org", "serbian": "https://www.easterndiocese.org", "romanian": "https://www.roea.org",
    "acrod": "https://www.acrod.org", "bulgarian": "https://www.bulgariandiocese.org",
}

#: How far a source is trusted when records merge.
SOURCE_PRIORITY = {
    "ea-diocese": 5, "goarch": 4, "antiochian": 4, "serbian": 4, "romanian": 4, "acrod": 4, "bulgarian": 4,
    "assembly-of-bishops": 3, "chicago-rocor": 2, "oca": 2, "uoc-usa": 2, "orthodox-world": 0,
}

#: A jurisdiction's name by a source's key, for records that carry none.
SOURCE_JURISDICTIONS = {
    "chicago-rocor": "Russian Orthodox Church Outside of Russia (ROCOR)",
    "ea-diocese": "Russian Orthodox Church Outside of Russia (ROCOR)",
    "oca": "Orthodox Church in America (OCA)",
    "uoc-usa": "Ukrainian Orthodox Church of the USA (UOC-USA)",
    "goarch": "Greek Orthodox Archdiocese of America",
    "antiochian": "Antiochian Orthodox Christian Archdiocese of North America",
    "serbian": "Serbian Orthodox Church in North and South America",
    "romanian": "Romanian Orthodox Archdiocese in the Americas",
    "acrod": "American Carpatho-Russian Orthodox Diocese",
    "bulgarian": "Bulgarian Eastern Orthodox Diocese of the USA, Canada, and Australia",
}

#: ... and for records of the European sources; others get the last value.
EUROPEAN_JURISDICTIONS = {
    "romanian-europe": "Romanian Orthodox Church", "serbian-europe": "Serbian Orthodox Church", "ukrainian-europe": "Ukrainian Orthodox Church",
    "russian-europe": "Russian Orthodox Church", "church-of-greece": "Church of Greece", "warsaw-orthodox": "Polish Orthodox Church",
    "georgian-orthodox": "Georgian Orthodox Church",
}
OTHER_EUROPEAN = "European Orthodox"

#: Usual names of jurisdictions by other names that records use for them, in lower case.
JURISDICTION_ALIASES = {
    "rocor": "Russian Orthodox Church Outside of Russia (ROCOR)",
    "russian orthodox church outside of russia": "Russian Orthodox Church Outside of Russia (ROCOR)",
    "russian orthodox church outside russia": "Russian Orthodox Church Outside of Russia (ROCOR)",
    "roca": "Russian Orthodox Church Outside of Russia (ROCOR)",
    "rocor western american diocese": "Russian Orthodox Church Outside of Russia (ROCOR)",
    "diocese of western america rocor": "Russian Orthodox Church Outside of Russia (ROCOR)",
    "oca": "Orthodox Church in America (OCA)",
    "orthodox church in america": "Orthodox Church in America (OCA)",
    "uoc-usa": "Ukrainian Orthodox Church of the USA (UOC-USA)",
    "uoc": "Ukrainian Orthodox Church of the USA (UOC-USA)",
    "ukrainian orthodox church of the usa": "Ukrainian Orthodox Church of the USA (UOC-USA)",
    "ukrainian orthodox church": "Ukrainian Orthodox Church of the USA (UOC-USA)",
    "antiochian orthodox christian archdiocese of north america": "Antiochian Orthodox Christian Archdiocese of North America",
    "greek orthodox archdiocese of america": "Greek Orthodox Archdiocese of America",
    "serbian orthodox church in north and south america": "Serbian Orthodox Church in North and South America",
    "new gracanica": "Serbian Orthodox Church in North and South America",
    "new gracanica metropolitanate": "Serbian Orthodox Church in North and South America",
    "romanian orthodox archdiocese in the americas": "Romanian Orthodox Archdiocese in the Americas",
    "romanian orthodox metropolia": "Romanian Orthodox Archdiocese in the Americas",
    "roea": "Romanian Orthodox Archdiocese in the Americas",
    "romanian episcopate": "Orthodox Church in America (OCA)",
    "romanian orthodox episcopate of america": "Orthodox Church in America (OCA)",
    "bulgarian eastern orthodox diocese of the usa, canada, and australia": "Bulgarian Eastern Orthodox Diocese of the USA, Canada, and Australia",
    "georgian orthodox church": "Georgian Orthodox Church",
    "georgian patriarchal parishes": "Georgian Orthodox Church",
    "romanian orthodox metropolia of the americas": "Romanian Orthodox Archdiocese in the Americas",
    "american carpatho-russian orthodox diocese": "American Carpatho-Russian Orthodox Diocese",
    "albanian orthodox diocese of america": "Albanian Orthodox Diocese of America",
    "orthodox church of the genuinely orthodox christians of greece": "Orthodox Church of the Genuinely Orthodox Christians of Greece",
    "goarch": "Greek Orthodox Archdiocese of America",
    "goa": "Greek Orthodox Archdiocese of America",
    "greek orthodox": "Greek Orthodox Archdiocese of America",
    "aoca": "Antiochian Orthodox Christian Archdiocese of North America",
    "antiochian": "Antiochian Orthodox Christian Archdiocese of North America",
    "acrod": "American Carpatho-Russian Orthodox Diocese",
    "carpatho-russian": "American Carpatho-Russian Orthodox Diocese",
    "serbian": "Serbian Orthodox Church in North and South America",
    "serbian orthodox": "Serbian Orthodox Church in North and South America",
    "romanian": "Romanian Orthodox Archdiocese in the Americas",
    "romanian orthodox": "Romanian Orthodox Archdiocese in the Americas",
    "bulgarian": "Bulgarian Eastern Orthodox Diocese of the USA, Canada, and Australia",
    "bulgarian orthodox": "Bulgarian Eastern Orthodox Diocese of the USA, Canada, and Australia",
    "bulgarian diocese": "Bulgarian Eastern Orthodox Diocese of the USA, Canada, and Australia",
    "bulgarian eastern orthodox diocese": "Bulgarian Eastern Orthodox Diocese of the USA, Canada, and Australia",
    "albanian": "Albanian Orthodox Diocese of America",
    "albanian orthodox": "Albanian Orthodox Diocese of America",
    "albanian archdiocese": "Albanian Orthodox Diocese of America",
    "mp": "Patriarchal Parishes of the Russian Orthodox Church in the USA",
    "moscow patriarchate": "Patriarchal Parishes of the Russian Orthodox Church in the USA",
    "patriarchal parishes": "Patriarchal Parishes of the Russian Orthodox Church in the USA",
    "georgian": "Georgian Orthodox Church",
}

#: Colours of jurisdictions on maps: red, green, blue, opacity.
COLOURS = {
    "Russian Orthodox Church Outside of Russia (ROCOR)": (30, 100, 200, 100),
    "Orthodox Church in America (OCA)": (200, 40, 40, 100),
    "Greek Orthodox Archdiocese of America": (200, 170, 30, 100),
    "Antiochian Orthodox Christian Archdiocese of North America": (40, 160, 60, 100),
    "Serbian Orthodox Church in North and South America": (0, 180, 180, 100),
    "Romanian Orthodox Archdiocese in the Americas": (140, 50, 180, 100),
    "Bulgarian Eastern Orthodox Diocese of the USA, Canada, and Australia": (200, 120, 40, 100),
    "American Carpatho-Russian Orthodox Diocese": (100, 60, 30, 100),
    "Ukrainian Orthodox Church of the USA (UOC-USA)": (60, 120, 200, 100),
    "Albanian Orthodox Diocese of America": (180, 80, 100, 100),
    "Georgian Orthodox Church": (80, 140, 80, 100),
    "Patriarchal Parishes of the Russian Orthodox Church in the USA": (100, 100, 180, 100),
    "Romanian Orthodox Church": (140, 50, 180, 100),
    "Serbian Orthodox Church": (0, 180, 180, 100),
    "Ukrainian Orthodox Church": (60, 120, 200, 100),
    "Russian Orthodox Church": (30, 100, 200, 100),
    "Church of Greece": (200, 170, 30, 100),
    "Polish Orthodox Church": (180, 140, 60, 100),
}
DEFAULT_COLOUR = (128, 128, 128, 100)

#: Files of raw records in the order in which they are read; the name is the source's.
SOURCE_FILES = (
    "chicago-rocor", "assembly-of-bishops", "oca", "uoc-usa", "ea-diocese", "goarch", "antiochian", "serbian", "romanian", "acrod", "bulgarian", "orthodox-world",
)

#: What tells rows of one source apart, the first row of equals staying: fields that are joined, or alternatives of which the first filled one counts.
LOCAL_KEYS = {
    "oca": ("detailUrl or name",), "antiochian": ("name",), "serbian": ("name letters",), "uoc-usa": ("name", "city"), "orthodox-world": ("name", "country", "city"),
    "romanian-europe": ("name", "city"), "serbian-europe": ("name",), "ukrainian-europe": ("name",), "russian-europe": ("name",),
    "church-of-greece": ("name", "city"), "warsaw-orthodox": ("name", "city"), "georgian-orthodox": ("name",),
}

#: Fields of records with the names that interfaces use for them, best first.
FIELD_ALIASES = {
    "name": ("name", "title", "parishName", "parish_name", "parish"),
    "diocese": ("metropolis", "diocese", "district"),
    "city": ("city",),
    "state": ("state", "stateProvince"),
    "country": ("country",),
    "phone": ("phone", "telephone", "phoneNumber"),
    "lat": ("latitude", "lat"),
    "lng": ("longitude", "lng"),
    "website": ("website", "url", "webUrl", "detailUrl"),
    "address": ("address1", "address"),
    "clergy": ("clergy", "pastor", "priest"),
}

#: Titles of clergy as regular expressions, longer before shorter.
TITLES = (
    r"The\s+(?:Very\s+)?Most\s+Reverend", r"The\s+Right\s+Reverend", r"The\s+Reverend", r"Protopresb(?:yter|\.)", "Archimandrite", "Archmandrite",
    "Archpriest", "Protodeacon", r"Protodn\.", "Archdeacon", r"Archdn\.", "Hierodeacon", "Sub-Deacon", r"Sbdn\.", "Subdeacon", r"Rassophore\s+Monk",
    "Monk-Subdeacon", "Schemamonk-Reader", "Schemamonk", "Hieromonk", "Hiermonk", "Igumen", "Novice-Reader", r"V\.\s*Rev\.", r"Very\s+Rev(?:erend|\.)",
    r"Rev\.", "Reverend", r"Rev\b", r"Fr\.", "Father", "Priest", "Deacon", r"Dn\.", "Abb(?:ot|ess)", "Archbishop", "Metropolitan", "Bishop",
    "Rassophore", "Monk", "Nun", "Novice", "Reader", "Postulant",
)
#: Titles that are parted from a name written right after them.
JAMMED_TITLES = (
    "Priest", "Deacon", "Protodeacon", "Archdeacon", "Archpriest", "Hieromonk", "Hiermonk", "Igumen", "Archimandrite", "Archmandrite", "Bishop", "Archbishop",
    "Metropolitan", "Abbot", "Abbess", "Monk", "Nun", "Novice", "Reader", "Postulant", "Father", "Rassophore", "Subdeacon",
)
#: Words after which a title is a role of the person before.
ROLES = ("acting", "senior", "junior", "assistant", "associate", "deputy", "former", "convent", "cathedral")
#: Matter in lists of clergy that names nobody: prefixes, phones, addresses, wardens, places of services.
CLERGY_NOISE = (
    r"(?i)^served\s+by\s*:?\s*", r"\(?\d{3}\)?[\s.-]+\d{3}[\s.-]+\d{4}", r"[\w.-]+@[\w.-]+\.\w+", r"(?i);?\s*(?:mission\s+|church\s+)?ward(?:en|er)(?:[ns])?:?\s*[^;]*",
    r"(?i);?\s*mailing\s+address\s*:.*$", r"(?i)currently\s+services?\s+held\s+at\s*[-–]?\s*[^;]*",
)

#: Where coordinates stand in pages, best first: latitude, then longitude.
_N = r"([-\d.]+)"
COORDINATES = (
    rf"new_latitude\s*=\s*'([^']+)'(?s:.*?)new_longitude\s*=\s*'([^']+)'", rf"parishLocation\s*=\s*\{{[^}}]*lat:\s*{_N}[^}}]*lng:\s*{_N}", rf"LatLng\(\s*{_N}\s*,\s*{_N}\s*\)",
    rf"maps\?ll={_N},{_N}", rf"@{_N},{_N}", rf'data-lat="{_N}"[^>]*data-lng="{_N}"',
)

#: Classes of the blocks that list places, in the order in which they are tried.
BLOCK_CLASSES = ("parish-listing", "parish-item", "parish-result", "directory-item", "views-row", "card", "parish", "church-item", "location-item")
#: Names that are navigation and not places, and what runs of other matter hold.
NAVIGATION = r"(?i)^(home|about|contact|news|events|calendar|links|history)"
#: Labels and targets of links that lead to lists and not to places.
NAVIGATION_LABELS = (r"(?i)^(parishes|search|diocese|state|select|list)", r"(?i)deanery")
NAVIGATION_TARGET = "/parishes"
NAVIGATION_PARTS = ("/search", "/diocese/", "/state/", "/deanery/")
FOOTERS = r"(?i)powered by|orthodox web solutions|\.shape_div_|SECTION_TITLE"
