"""Contact details in free text: e-mail, phone, profile links, name and place."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vacantia.functions.text import any_of, let, quoted, sql_text, squeeze

# Patterns and lists that decide what counts as a detail.
EMAIL = r"[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}"
PHONE = r"(?:\+972[- ()]?|0)5\d(?:[- ()]?\d){7}"
LINK = r"(?i)https?://[^\s<>)\]}]+"
LINKEDIN = r"(?i)(?:https?://)?(?:www\.)?linkedin\.com/in/[^\s<>)]+"
GITHUB = r"(?i)(?:https?://)?(?:www\.)?github\.com/[^\s<>)]+"
SOCIAL_HOSTS = ("linkedin.com", "github.com", "facebook.com", "instagram.com", "x.com", "twitter.com")
LETTER = "A-Za-zÀ-ÖØ-öø-ÿא-ת"
NAME = rf"^[{LETTER}][{LETTER}'’.-]*(?:\s+[{LETTER}][{LETTER}'’.-]*){{1,4}}$"
NAME_BLOCKLIST = (
    "resume", "curriculum", "vitae", "cv", "engineer", "developer", "manager", "analyst", "scientist", "student",
    "specialist", "director", "lead", "software", "industrial", "data", "project", "product", "operations", "summary",
    "profile", "experience", "skills", "tel", "aviv", "haifa", "jerusalem", "israel", "הרצליה", "חיפה", "ירושלים",
    "ישראל",
)
PLACE_LABEL = r"(?i)^(?:location|address|מיקום|כתובת)\s*[:\-–]\s*(.+)$"
KNOWN_PLACES = (
    "Tel Aviv", "Haifa", "Jerusalem", "Herzliya", "Ramat Gan", "Petah Tikva", "Beer Sheva", "Be'er Sheva", "Raanana",
    "Ra'anana", "Rehovot", "Netanya", "Kfar Saba", "Yokneam", "תל אביב", "חיפה", "ירושלים", "הרצליה", "רמת גן",
    "פתח תקווה", "פתח תקוה", "באר שבע", "רעננה", "רחובות", "נתניה", "כפר סבא", "יקנעם",
)
NAME_LINES, PLACE_LINES = 18, 45


def email(text: Column) -> Column:
    return F.rtrim(F.regexp_extract(text, EMAIL, 0), F.lit(".,;:"))


def phone(text: Column) -> Column:
    return F.regexp_extract(text, PHONE, 0)


def profile_link(text: Column, pattern: str) -> Column:
    found = F.rtrim(F.regexp_extract(text, pattern, 0), F.lit(".,;:"))
    return F.when((found == "") | found.rlike("(?i)^https?://"), found).otherwise(F.concat(F.lit("https://"), found))


def portfolio(text: Column) -> Column:
    """First link that is not a social profile."""
    links = F.transform(F.regexp_extract_all(text, F.lit(f"({LINK})"), F.lit(1)), lambda u: F.rtrim(u, F.lit(".,;:")))
    own = F.filter(links, lambda u: ~any_of(F.lower(u).contains(h) for h in SOCIAL_HOSTS))
    return F.coalesce(F.get(own, 0), F.lit(""))


def _lines(text: Column, count: int) -> Column:
    """The first lines, squeezed; what follows them stays one piece that nobody searches."""
    return F.transform(F.slice(F.split(text, "\\r\\n|[\\n\\r]", count + 1), 1, count), squeeze)


def full_name(text: Column) -> Column:
    """First line (or half of a divided line) near the top that reads like a person's name."""
    return F.coalesce(let(_lines(text, NAME_LINES), _name_in), F.lit(""))


def name_and_place(text: Column) -> Column:
    """struct(full_name, location) of :func:`full_name` and :func:`place`, from lines cut out once."""
    both = lambda lines: F.struct(F.coalesce(_name_in(F.slice(lines, 1, NAME_LINES)), F.lit("")).alias("full_name"),
                                  F.coalesce(_place_in(lines), F.lit("")).alias("location"))
    return let(_lines(text, PLACE_LINES), both)


def _name_in(lines: Column) -> Column:
    blocked = F.array(*[F.lit(w) for w in NAME_BLOCKLIST])
    divided = lambda l: F.when(l.rlike("[|•·]"), F.slice(F.split(l, r"\s*[|•·]\s*"), 1, 2)).otherwise(F.array(l))
    halves = F.flatten(F.transform(lines, divided))

    def plausible(c: Column) -> Column:
        words = F.transform(F.split(F.lower(c), r"\s+"), lambda w: F.btrim(w, F.lit(".'’-_")))
        return ((F.length(c) <= 80) & ~c.contains("@") & ~F.lower(c).contains("http") & ~c.rlike(r"\d") & c.rlike(NAME)
                & ~F.arrays_overlap(words, blocked))

    return F.coalesce(F.get(F.filter(halves, plausible), 0), F.lit(""))


def place(text: Column) -> Column:
    """A labelled place, else the first known city in the first lines."""
    return F.coalesce(let(_lines(text, PLACE_LINES), _place_in), F.lit(""))


def _place_in(lines: Column) -> Column:
    places = F.expr("array(" + ", ".join(
        f"named_struct('name', {sql_text(p)}, 'low', {sql_text(p.lower())}, 'pattern', {sql_text(rf'(?i)(?<![\p{{L}}\p{{N}}_]){quoted(p)}(?![\p{{L}}\p{{N}}_])')})"
        for p in KNOWN_PLACES) + ")")

    def label(line: Column) -> Column:
        return F.trim(F.regexp_extract(line, PLACE_LABEL, 1))

    def city_in(pair: Column) -> Column:
        line, low = pair["line"], pair["low"]
        # A literal test on the lower-case line is the cheap guard of the border test.
        name = F.get(F.filter(places, lambda p: F.contains(low, p["low"]) & F.regexp_like(line, p["pattern"])), 0)["name"]
        named = F.contains(low, F.lit("israel")) | F.contains(line, F.lit("ישראל"))
        return F.when(named, name).otherwise(F.concat(name, F.lit(", Israel")))

    labelled = F.filter(F.transform(F.filter(lines, lambda l: l.rlike(PLACE_LABEL)), label), lambda v: F.length(v).between(2, 80))
    cities = F.array_compact(F.transform(F.transform(lines, lambda l: F.struct(l.alias("line"), F.lower(l).alias("low"))), city_in))
    return F.coalesce(F.btrim(F.get(labelled, 0), F.lit(" ,.;")), F.get(cities, 0), F.lit(""))


def phone_norm(text: Column) -> Column:
    """Digits; the country prefix becomes a national 0 when nine digits follow."""
    digits = F.regexp_replace(F.coalesce(text, F.lit("")), r"\D", "")
    digits = F.when(digits.startswith("00972"), F.substr(digits, F.lit(3))).otherwise(digits)
    return F.when(digits.rlike("^9720?[0-9]{9}$"), F.concat(F.lit("0"), F.right(digits, F.lit(9)))).otherwise(digits)


def split_name(name: Column) -> Column:
    """struct(first_name, last_name)."""
    parts = F.filter(F.split(squeeze(name), " "), lambda p: p != "")
    return F.struct(F.coalesce(F.get(parts, 0), F.lit("")).alias("first_name"),
                    F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(0))), " ").alias("last_name"))
