"""Cleaning of strings, as column expressions. Missing is the empty string, as in the records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import BASE_URLS, CA_PROVINCES, COLOURS, COUNTRIES, DEFAULT_COLOUR, EUROPEAN_JURISDICTIONS, JURISDICTION_ALIASES, OTHER_EUROPEAN, SMALL_WORDS, SOURCE_JURISDICTIONS, US_STATES

#: White space including no-break and other Unicode spaces, which Java's \s leaves out.
SPACE = r"[\s   -     　﻿]"


#: ... one by one, with line ends; and control characters other than those.
_SPACES = "\n\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
_CONTROLS = "".join(map(chr, [*range(10), 11, 12, *range(14, 32), 127]))


def lookup(table: dict[str, str], key: Column) -> Column:
    """The value of a key in a small fixed table, null if absent."""
    return F.element_at(fixed_map(table), key)


def fixed_map(table: dict[str, str | bool]) -> Column:
    """A small table as one map, which is parsed once and not made a literal at a time."""
    shown = lambda x: str(x).lower() if isinstance(x, bool) else "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.expr(f"map({', '.join(shown(x) for item in table.items() for x in item)})")


def collapse(c: Column) -> Column:
    """White space to single spaces, none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, f"{SPACE}+", " "), "^ | $", "")


def trimmed(c: Column) -> Column:
    """No white space of any kind at the ends; null stays."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def blank(c: Column) -> Column:
    """Whether a value is missing: null, empty or white space."""
    return F.coalesce(trimmed(c), F.lit("")) == ""


def clean(c: Column) -> Column:
    """Control characters and entities out, line ends and white space to single spaces; null gives ''.

    Single characters are translated in one pass; patterns run only where a text has something for them.
    """
    c = F.translate(F.coalesce(c.cast("string"), F.lit("")), _SPACES + _CONTROLS, " " * len(_SPACES))
    plain = F.regexp_replace(F.regexp_replace(c, "(?i)&amp;", "&"), "(?i)&nbsp;", " ")
    c = F.when(c.contains("&"), F.regexp_replace(plain, r"&#?\w+;", "")).otherwise(c)
    return F.trim(F.when(c.contains("  "), F.regexp_replace(c, " {2,}", " ")).otherwise(c))


def title_case(c: Column) -> Column:
    """First letters in upper case; small words inside in lower case, two- and three-letter capitals kept."""

    def word(w: Column, i: Column) -> Column:
        low = F.lower(w)
        return F.when((i > 0) & low.isin(*SMALL_WORDS), low).when(w.rlike("^[A-Z]{2,3}$"), w).otherwise(F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, 2, 1 << 20)))

    return F.array_join(F.transform(F.split(c, f"{SPACE}+"), word), " ")


def place_name(c: Column) -> Column:
    """A cleaned name without '(www)' and outer quotes, with 'St.' and 'Sts.' in usual case at its start."""
    return clean(unquoted(clean(c)))


def unquoted(s: Column) -> Column:
    """place_name() of a cleaned value, but for a last clean()."""
    c = F.regexp_replace(s, rf"(?i){SPACE}*\(www\){SPACE}*", "")
    c = F.regexp_replace(F.regexp_replace(c, '^"(.*)"$', "$1"), "^'(.*)'$", "$1")
    return F.regexp_replace(F.regexp_replace(c, rf"^[sS][tT]\.{SPACE}*", "St. "), rf"^[sS][tT][sS]\.{SPACE}*", "Sts. ")


def state_code(c: Column) -> Column:
    """The code of a US state or Canadian province by code, dotted code or name; else the name in title case."""
    return state_of(clean(c))


def state_of(s: Column) -> Column:
    """state_code() of a cleaned value."""
    codes = sorted({*US_STATES.values(), *CA_PROVINCES.values()})
    upper = F.upper(s)
    bare = F.regexp_replace(upper, "[^A-Z]", "")
    named = F.coalesce(lookup(US_STATES, F.lower(s)), lookup(CA_PROVINCES, F.lower(s)))
    return F.when(s == "", "").when(upper.isin(*codes), upper).when(bare.isin(*codes), bare).when(named.isNotNull(), named).otherwise(title_case(s))


def country_name(c: Column, state: Column) -> Column:
    """The usual name of a country; from a state's code if blank."""
    return country_of(clean(c), state)


def country_of(s: Column, state: Column) -> Column:
    """country_name() of a cleaned value."""
    code = F.upper(F.coalesce(state, F.lit("")))
    inferred = F.when(code.isin(*sorted(US_STATES.values())), "USA").when(code.isin(*sorted(set(CA_PROVINCES.values()))), "Canada").otherwise("")
    return F.coalesce(lookup(COUNTRIES, F.lower(s)), F.when(s == "", inferred).otherwise(s))


def jurisdiction_name(c: Column, source: Column, aliases: dict[str, str] | None = None) -> Column:
    """A jurisdiction by its aliases, from the source if blank, else as cleaned."""
    return jurisdiction_of(clean(c), source, aliases)


def jurisdiction_of(s: Column, source: Column, aliases: dict[str, str] | None = None) -> Column:
    """jurisdiction_name() of a cleaned value."""
    named = lookup(JURISDICTION_ALIASES if aliases is None else aliases, F.lower(s)) if aliases != {} else F.lit(None).cast("string")
    return F.coalesce(named, F.when(s == "", F.coalesce(lookup(SOURCE_JURISDICTIONS, source), F.lit(""))).otherwise(s))


def european_jurisdiction(source: Column) -> Column:
    """The jurisdiction of a European source."""
    return F.coalesce(lookup(EUROPEAN_JURISDICTIONS, source), F.lit(OTHER_EUROPEAN))


def colour(jurisdiction: Column) -> Column:
    """A jurisdiction's colour on maps, as four numbers."""
    numbers = lambda x: F.array(*[F.lit(v) for v in x])
    return F.coalesce(F.element_at(F.create_map(*[v for k, x in COLOURS.items() for v in (F.lit(k), numbers(x))]), jurisdiction), numbers(DEFAULT_COLOUR))


def phone(c: Column) -> Column:
    """(AAA) MMM-LLLL for North American numbers; + and digits for longer ones; else the characters a number may have."""
    return phone_of(clean(c))


def phone_of(s: Column) -> Column:
    """phone() of a cleaned value."""
    digits = F.regexp_replace(s, r"\D", "")
    local = F.regexp_extract(digits, r"^(?:011)?1?(\d{10})$", 1)
    shown = F.concat(F.lit("("), F.substring(local, 1, 3), F.lit(") "), F.substring(local, 4, 3), F.lit("-"), F.substring(local, 7, 4))
    # 11 digits without a leading 1 and 13 with 011 are covered by the pattern; 12 digits and others are not local.
    rest = collapse(F.regexp_replace(s, rf"[^\d()\-+\s ]", ""))
    return F.when(digits == "", "").when(local != "", shown).when(s.startswith("+") | (F.length(digits) > 10), F.concat(F.lit("+"), digits)).otherwise(rest)


def zip_code(c: Column) -> Column:
    """US ZIP or ZIP+4 as is, Canadian codes as 'A1A 1A1', anything else as cleaned."""
    return zip_of(clean(c))


def zip_of(s: Column) -> Column:
    """zip_code() of a cleaned value."""
    bare = F.upper(F.regexp_replace(s, SPACE, ""))
    return F.when(s.rlike(r"^\d{5}(-\d{4})?$"), s).when(bare.rlike(r"^[A-Z]\d[A-Z]\d[A-Z]\d$"), F.concat_ws(" ", F.substring(bare, 1, 3), F.substring(bare, 4, 3))).otherwise(s)


def website(c: Column, source: Column) -> Column:
    """An absolute address: relative ones get the source's base, a scheme is added, then as absolute() has it; '' if it has no base."""
    return absolute(with_scheme(clean(c), source))


def with_scheme(s: Column, source: Column) -> Column:
    """A cleaned address with the source's base if relative, and with a scheme; '' without a base."""
    base = lookup(BASE_URLS, source)
    based = F.when(~s.startswith("/"), s).otherwise(F.coalesce(F.concat(base, s), F.lit("")))
    return F.regexp_replace(based, "^(?!(?i:https?://)|$)", "https://")


def absolute(url: Column) -> Column:
    """An address as browsers write it: host in lower case, no usual port, blanks escaped, no dot segments, no lone root slash.

    What has no host stays as it is.
    """
    return rebuilt(url, url_parts(url))


def url_parts(url: Column) -> Column:
    """array(scheme, host, path, rest) of an address with a scheme, '' for what is missing: names in lower case, no usual port, slashes forward, blanks escaped."""
    part = lambda k: F.regexp_extract(url, r"^([a-zA-Z]+)://([^/?#\\]*)([^?#]*)(.*)$", k)
    origin = F.regexp_replace(F.lower(F.concat(part(1), F.lit("://"), part(2))), "^(https://.*):443$|^(http://.*):80$", "$1$2")
    named = F.split(origin, "://", 2)
    return F.concat(named, F.array(F.regexp_replace(F.translate(part(3), "\\", "/"), " ", "%20"), F.regexp_replace(part(4), " ", "%20")))


def rebuilt(url: Column, parts: Column) -> Column:
    """The address of url_parts(), its dot segments resolved; url itself where it has no host."""
    host, rest = F.try_element_at(parts, F.lit(2)), F.try_element_at(parts, F.lit(4))
    path = F.regexp_replace(stepped(F.try_element_at(parts, F.lit(3))), "^$", "/")
    tail = F.regexp_replace(F.concat(path, rest), "^/$", "")
    return F.when(host == "", url).otherwise(F.concat(F.try_element_at(parts, F.lit(1)), F.lit("://"), host, tail))


def stepped(path: Column) -> Column:
    """A path without dot segments, however many: '.' goes, '..' goes with the segment before it, at an end they leave a slash."""
    there = lambda x, k: x.rlike((r"(?i)^(?:\.|%2e)$", r"(?i)^(?:\.|%2e){2}$")[k])
    go = lambda acc, x: F.when(there(x, 1), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(there(x, 0), acc).otherwise(F.concat(acc, F.array(x)))
    shown = lambda acc: F.array_join(F.concat(F.array(F.lit("")), acc), "/")
    closed = F.regexp_replace(path, r"(?i)(/(?:\.|%2e){1,2})$", "$1/")
    walked = F.aggregate(F.slice(F.split(closed, "/"), 2, 1 << 20), F.array().cast("array<string>"), go, shown)
    return F.when(path.rlike(r"(?i)/(?:\.|%2e){1,2}(?:/|$)"), walked).otherwise(path)


def resolved(href: Column, base: str) -> Column:
    """A link made absolute by a page's site."""
    return F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(base.rstrip("/")), F.when(href.startswith("/"), href).otherwise(F.concat(F.lit("/"), href))))


def same_site(url: Column, site: str) -> Column:
    """Whether an address leads to a site or a part of it."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#:]*)", 1))
    return (host == site) | host.endswith(f".{site}")


def city_state(c: Column) -> Column:
    """struct(city, state) of 'City, ST 12345' or the first such pair in a longer text; '' where missing."""
    s = clean(c)
    parts = F.split(s, r"\s*,\s*")
    found = lambda k: F.regexp_extract(s, r"([A-Z][a-z]+(?:\s[A-Z][a-z]+)*),\s*([A-Z]{2})(?![A-Za-z])", k)
    listed = F.size(parts) <= 3
    second = F.coalesce(trimmed(F.regexp_replace(F.try_element_at(parts, F.lit(2)), r"\d{5}.*", "")), F.lit(""))
    return F.struct(F.when(listed, F.coalesce(parts[0], F.lit(""))).otherwise(found(1)).alias("city"), F.when(listed, second).otherwise(found(2)).alias("state"))


def number(c: Column) -> Column:
    """The number that a string begins with, null if none."""
    return F.regexp_extract(c.cast("string"), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")


def coordinate(c: Column, limit: float) -> Column:
    """A number between -limit and limit, to 7 decimals; null otherwise."""
    n = number(c)
    return F.when(n.between(-limit, limit), F.round(n, 7))


def city_parts(city: Column, state: Column, country: Column) -> Column:
    """struct(city, state, country) with a state and country that a comma-separated city holds split off."""
    s = clean(city)
    return places_of(s, comma_parts(s), state, country)


def comma_parts(s: Column) -> Column:
    """The filled parts of a list with commas."""
    return F.filter(F.transform(F.split(s, ","), collapse), lambda x: x != "")


def places_of(s: Column, parts: Column, state: Column, country: Column) -> Column:
    """city_parts() of a cleaned city and its comma_parts()."""
    known = {x.lower() for table in (US_STATES, CA_PROVINCES) for item in table.items() for x in item}
    is_state = lambda x: F.coalesce(F.lower(x).isin(*sorted(known)), F.lit(False))
    n, last = F.size(parts), F.try_element_at(parts, F.lit(-1))
    ends_country = (n >= 2) & F.coalesce(lookup(COUNTRIES, F.lower(last)).isNotNull(), F.lit(False))
    place = F.when(ends_country & (n >= 3), F.try_element_at(parts, F.lit(-2))).when(~ends_country & (n == 2), last)
    found = F.when(is_state(place), place).otherwise("")
    given = F.coalesce(state, F.lit(""))
    split = s.contains(",")
    return F.struct(
        F.when(split, F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit(""))).otherwise(s).alias("city"),
        F.when(split & (given == ""), found).otherwise(given).alias("state"),
        F.when(split & ends_country, last).otherwise(F.coalesce(country, F.lit(""))).alias("country"),
    )


def norm(c: Column) -> Column:
    """ASCII letters and digits in lower case."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


def norm_name(c: Column) -> Column:
    """norm() without one closing affiliation word."""
    return F.regexp_replace(norm(c), "(orthodox|russian|rocor|oca|www)$", "")


def dedup_key(name: Column, city: Column, state: Column) -> Column:
    """name|city, or name||state without a city; '' without a name."""
    n, c = norm_name(name), norm(city)
    return F.when(n == "", "").when(c != "", F.concat_ws("|", n, c)).otherwise(F.concat(n, F.lit("||"), norm(state)))


def coord_key(lat: Column, lng: Column) -> Column:
    """Coordinates to 4 decimals; '' if either is missing or zero."""
    return F.when((F.coalesce(lat, F.lit(0.0)) == 0) | (F.coalesce(lng, F.lit(0.0)) == 0), "").otherwise(F.concat_ws("|", F.format_string("%.4f", lat), F.format_string("%.4f", lng)))


def importance(name: Column) -> Column:
    """cathedral, monastery, seminary or notable by the words of a name; null for others."""
    edge, end = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
    low = F.lower(name)
    return (
        F.when(low.rlike(f"{edge}cathedral{end}"), "cathedral")
        .when(low.rlike(f"{edge}(monaster(y|ies)|lavra|skete){end}"), "monastery")
        .when(low.rlike(f"{edge}seminar(y|ies){end}"), "seminary")
        .when(low.rlike(f"{edge}stavropeg|{edge}metochion{end}|{edge}basili[ck]a{end}"), "notable")
    )


def jittered(rgb: Column, key: Column) -> Column:
    """A colour moved by -30 to 29 by the sum of a key's character codes, within 0 and 255; further channels as they are."""
    codes = F.transform(F.filter(F.split(key, ""), lambda x: x != ""), F.ascii)
    move = F.aggregate(codes, F.lit(0), lambda a, x: a + x) % 60 - 30
    return F.transform(rgb, lambda x, i: F.when(i < 3, F.greatest(F.lit(0), F.least(F.lit(255), x + move))).otherwise(x))
