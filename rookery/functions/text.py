"""Names, labels and lists in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ascii_fold(x: Column) -> Column:
    """Latin letters without their marks, and ``&`` as ``and``."""
    # Accented letters and their plain forms.
    folded = F.translate(x, "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ", "aaaaaaceeeeiiiinoooooouuuuyyAAAAAACEEEEIIIINOOOOOOUUUUY")
    return F.replace(folded, F.lit("&"), F.lit("and"))


def slug(x: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one dash."""
    return F.regexp_replace(F.regexp_replace(F.lower(ascii_fold(x)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def without_parentheses(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"\([^)]*\)", " "), " +", " "))


def name_tokens(x: Column, stop: tuple[str, ...] = ("the", "of", "university", "college")) -> Column:
    """Distinct tokens of a normalised name without stop words."""
    words = F.array_distinct(F.filter(F.split(slug(without_parentheses(x)), "-"), lambda w: w != ""))
    return F.array_except(words, F.array(*map(F.lit, stop)))


def jaccard(a: Column, b: Column) -> Column:
    return F.when(F.size(F.array_union(a, b)) > 0, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


# Names of books and what they are called.
BOOKS = {
    "LowVig": ("lowvig.ag", "lowvig"),
    "BetOnline": ("betonline.ag", "betonline"),
    "BetMGM": ("betmgm", "mgm"),
    "DraftKings": ("draftkings", "dk"),
    "FanDuel": ("fanduel", "fd"),
    "Caesars": ("caesars", "caesars sportsbook"),
    "BetRivers": ("betrivers",),
    "PointsBet": ("pointsbet",),
    "Unibet": ("unibet",),
    "WynnBet": ("wynnbet", "wynn"),
    "Barstool": ("barstool", "barstool sportsbook"),
    "SugarHouse": ("sugarhouse", "sugar house"),
    "FoxBet": ("fox bet", "foxbet"),
    "TwinSpires": ("twinspires", "twin spires"),
    "Betfair": ("betfair",),
    "Pinnacle": ("pinnacle", "pinny"),
    "5Dimes": ("5dimes", "5d"),
    "Bovada": ("bovada",),
    "MyBookie": ("mybookie", "mybookie.ag"),
    "Bookmaker": ("bookmaker", "bookmaker.eu"),
    "Intertops": ("intertops",),
    "GTBets": ("gtbets", "gt bets"),
    "Heritage": ("heritage", "heritage sports"),
    "YouWager": ("youwager", "you wager"),
    "SportsBetting": ("sportsbetting.ag", "sportsbetting"),
    "XBet": ("xbet", "x bet"),
    "BetUS": ("betus", "bet us"),
    "BetNow": ("betnow", "bet now"),
    "BetAnySports": ("betanysports", "bet any sports"),
}


def book_name(x: Column) -> Column:
    """A bookmaker's display name: alias, alias without domain and suffix, else that in title case; Unknown for nothing."""
    aliases = F.create_map(*[F.lit(v) for name, known in BOOKS.items() for k in known for v in (k, name)])
    plain = F.lower(F.trim(x))
    bare = plain
    for ending in (r"\.ag$", r"\.com$", r"\.net$", r"\.eu$", r"\s+sportsbook$", r"\s+book$"):
        bare = F.regexp_replace(bare, ending, "")
    titled = F.initcap(F.regexp_replace(bare, r"\s+", " "))
    return F.coalesce(aliases[plain], aliases[bare], F.when(titled != "", titled), F.lit("Unknown"))


def source_badge(x: Column) -> Column:
    """A source's short form, else the source with a capital first letter; empty for nothing."""
    # Short forms.
    short = F.create_map(*[F.lit(v) for v in ("sgo", "SGO", "sportsgameodds", "SGO", "vegasinsider", "VI", "the-odds-api", "ODDS", "draftkings", "DK", "fanduel", "FD", "pinnacle", "PIN", "consensus", "CONS", "mock", "MOCK")])
    return F.coalesce(short[F.lower(x)], F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 20)), F.lit(""))


def guarded_team(x: Column) -> Column:
    """The team id of names that similarity would map wrongly, in order of precedence; null for others."""
    n = F.lower(x)
    ohio = n.contains("oh")
    return (
        F.when(n.contains("texas a&m"), "texas-a-m")
        .when(n == "miami", "miami")
        .when(n.contains("miami") & ohio, "miami-oh")
        .when(n == "georgia state", "georgia-state")
        .when(n == "georgia southern", "georgia-southern")
        .when(n.contains("san josé") | n.contains("san jose"), "san-jos-state")
        .when(n.contains("san diego"), "san-diego-state")
    )


def breaks_parity(name: Column, team: Column) -> Column:
    """Whether just one of a name and a candidate is a State or a Tech, or the name alone an A&M."""
    n, t = F.lower(name), F.lower(team)
    one = lambda word: n.rlike(rf"\b{word}\b") != t.contains(word)
    return one("state") | one("tech") | (n.rlike(r"\ba&m\b|\bam\b") & ~t.rlike("a-m|a&m|am"))


def field_name(x: Column) -> Column:
    """A statistic's name as an identifier."""
    return F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]+", "_")


def safe_number(x: Column) -> Column:
    """A double, or null for anything that is no finite number."""
    v = x.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def denied(x: Column, names: tuple[str, ...], kept: tuple[str, ...] = ()) -> Column:
    """On a list, or a slug that ends in -college and is not excepted."""
    s = slug(x)
    return s.isin(*names) | (s.rlike("-college$") & ~s.isin(*kept)) if kept else s.isin(*names) | s.rlike("-college$")


def matchup(away: Column, home: Column) -> Column:
    return F.concat_ws(" @ ", away, home)


def week_list(text: str) -> list[int]:
    """``1,2`` and ``1-5`` as sorted numbers."""
    found: set[int] = set()
    for part in filter(None, (p.strip() for p in text.split(","))):
        lo, _, hi = part.partition("-")
        found.update(range(int(lo), int(hi or lo) + 1))
    return sorted(found)


# Words that say nothing of which team is meant ("state" does), names that stand for another team's slug, and mascots of two words.
FILLER = ("university", "univ", "college", "the", "football")
EXCEPTIONS = {"sam houston state": "sam-houston", "sam houston": "sam-houston", "louisiana ragin cajuns": "louisiana", "louisiana ragincajuns": "louisiana", "louisiana ragin": "louisiana"}
MASCOTS = ("crimson tide", "blue devils", "fighting irish", "nittany lions", "fighting illini", "sun devils", "golden hurricane", "demon deacons", "scarlet knights", "red wolves", "golden eagles", "black knights")


def provider_name(x: Column) -> Column:
    """A provider's team name as it is compared: lower case, letters, digits, blanks and dashes only (so A&M is am), without filler words."""
    plain = F.regexp_replace(F.lower(x), r"[^a-z0-9\s-]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, rf"\b({'|'.join(FILLER)})\b", ""), r"\s+", " "))


def excepted(x: Column) -> Column:
    """The slug of the team that a name stands for by exception, or null; the longest exception it holds counts."""
    name, low, found = provider_name(x), F.lower(x), F.lit(None).cast("string")
    for key in sorted(EXCEPTIONS, key=len):
        found = F.when(name.contains(key) | low.contains(key), EXCEPTIONS[key]).otherwise(found)
    return found


def without_mascot(x: Column) -> list[Column]:
    """A normalised name without a mascot of two words at its end, and without its last word; null where there is none."""
    two = F.when(x.rlike(rf" ({'|'.join(MASCOTS)})$"), F.regexp_replace(x, rf" ({'|'.join(MASCOTS)})$", ""))
    return [two, F.when(x.contains(" "), F.regexp_replace(x, r" \S+$", ""))]
