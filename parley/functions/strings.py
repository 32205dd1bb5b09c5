"""String column functions: slugs, URLs, labels and normalisation for comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that trimming removes: the Unicode spaces, line ends and the byte order mark.
_BLANK = "[\\s\\u000B\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]+"
# fixed values: names given to unidentified speakers, two passes through the alphabet
ANONYMOUS = (
    "Aardvark", "Beaver", "Crocodile", "Dolphin", "Elephant", "Falcon", "Gazelle", "Heron", "Ibex", "Jaguar", "Kestrel", "Lynx", "Mongoose",
    "Narwhal", "Otter", "Pelican", "Quail", "Raccoon", "Salamander", "Tortoise", "Urchin", "Viper", "Walrus", "Xerus", "Yak", "Zebra",
    "Albatross", "Bison", "Cheetah", "Dormouse", "Egret", "Ferret", "Gibbon", "Hedgehog", "Impala", "Jackal", "Kingfisher", "Lemur", "Marmot",
    "Nightingale", "Ocelot", "Porcupine", "Quokka", "Reindeer", "Starling", "Tapir", "Umbrellabird", "Vulture", "Wombat", "Xenops", "Yabby", "Zebu",
)
COLORS = 8


def slug(name_short: Column) -> Column:
    return F.lower(name_short)


def _site_url(x: Column, prefix: str) -> Column:
    return F.when(x.contains("youtube.com"), x).otherwise(F.concat(F.lit(f"https://www.youtube.com/{prefix}"), x))


def channel_url(x: Column) -> Column:
    """As it is if it names the site already, else the id's URL."""
    return _site_url(x, "channel/")


def playlist_url(x: Column) -> Column:
    return _site_url(x, "playlist?list=")


def video_url(x: Column) -> Column:
    return _site_url(x, "watch?v=")


def trim_all(x: Column) -> Column:
    """Trim every kind of white space, not spaces alone."""
    return F.regexp_replace(x, f"^{_BLANK}|{_BLANK}$", "")


def blank_to_null(x: Column) -> Column:
    return F.nullif(trim_all(x), F.lit(""))


def label_or(x: Column, fallback: str) -> Column:
    """The label, or the fallback where it is null or empty."""
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(fallback))


def normalised_words(x: Column) -> Column:
    """Lower-case words of letters, digits and apostrophes; everything else separates."""
    return F.filter(F.split(F.regexp_replace(F.lower(x), "[^\\p{L}\\p{N}\\s']", " "), "\\s+"), lambda w: w != "")


def normalised_token(x: Column) -> Column:
    """One token with everything but letters, digits, spaces and apostrophes deleted."""
    return F.regexp_replace(F.lower(x), "[^\\p{L}\\p{N}\\s']", "")


def ends_sentence(x: Column) -> Column:
    return x.rlike("[.?!][\"')\\]]?$")


def is_voiced(x: Column) -> Column:
    """Whether a token is audible: it has a letter or digit."""
    return x.rlike("[\\p{L}\\p{N}]")


def starts_word(x: Column) -> Column:
    return x.startswith(" ") | x.startswith("▁")


def strip_marker(x: Column) -> Column:
    return F.regexp_replace(x, "^[ \\u2581]+", "")


def anonymous_name(index: Column) -> Column:
    """Name of the unidentified speaker with this 0-based place; numbered beyond the list."""
    names = F.array(*[F.lit(f"Anonymous {n}") for n in ANONYMOUS])
    return F.coalesce(F.get(names, index.cast("int")), F.concat(F.lit("Anonymous Speaker "), (index + 1).cast("string")))


def speaker_key(person: Column, number: Column) -> Column:
    return F.when(person.isNotNull(), F.concat(F.lit("person:"), person.cast("string"))).when(number.isNotNull(), F.concat(F.lit("number:"), number.cast("string"))).otherwise("unattributed")


def color_slot(place: Column) -> Column:
    return (F.pmod(place, F.lit(COLORS)) + 1).cast("int")


def plural(n: Column, one: str, many: str | None = None) -> Column:
    return F.when(n == 1, one).otherwise(many or one + "s")


def attendance_label(meetings: Column, body: Column, first: Column, last: Column) -> Column:
    """"5 GBOS meetings, Apr 2023–Feb 2026"; ``first`` and ``last`` are month labels, or null if unknown."""
    count = F.concat_ws(" ", meetings.cast("string"), body, plural(meetings, "meeting"))
    span = F.when(first == last, first).otherwise(F.concat(first, F.lit("–"), last))
    return F.when(first.isNull() | last.isNull(), count).otherwise(F.concat(count, F.lit(", "), span))


def place_label(name: Column, state: Column) -> Column:
    return F.concat_ws(", ", name, F.nullif(state, F.lit("")))


def pad_end(x: Column, width: Column) -> Column:
    """Pad with spaces to the width; longer values stay whole."""
    return F.rpad(x, F.greatest(width, F.length(x)), F.lit(" "))


def work_folder(body_slug: Column, video: Column) -> Column:
    return F.concat_ws("_", body_slug, video)


def speaker_label(number: Column) -> Column:
    return F.when(number.isNull(), "unlabeled").otherwise(F.concat(F.lit("segmented:spk-"), number.cast("string")))


def parse_speaker_label(label: Column) -> Column:
    """Speaker number of a label, null for unlabeled; any other label is an error."""
    number = F.regexp_extract(label, "^segmented:spk-(\\d+)$", 1)
    return F.when(label == "unlabeled", F.lit(None).cast("int")).when(number != "", F.try_to_number(number, F.lit("9999999999")).cast("int")).otherwise(F.raise_error(F.concat(F.lit("unknown speaker label: "), F.coalesce(label, F.lit("null")))).cast("int"))


def like_pattern(query: str, *, escape: bool = False) -> str:
    """Pattern for a substring search.

    By default ``%``, ``_`` and ``\\`` of the query act as in LIKE, a backslash
    taking the next character literally; ``escape=True`` makes them ordinary.
    """
    if escape:
        return "%" + "".join("\\" + c if c in "%_\\" else c for c in query) + "%"
    out, k = [], 0
    while k < len(query):
        c = query[k]
        if c == "\\" and k + 1 < len(query):
            k += 1
            out.append("\\" + query[k] if query[k] in "%_\\" else query[k])
        else:
            out.append("\\\\" if c == "\\" else c)
        k += 1
    return "%" + "".join(out) + "%"


def contains_text(x: Column, query: str, *, escape: bool = False) -> Column:
    """Case-insensitive substring test."""
    return x.ilike(like_pattern(query, escape=escape))


def redact_url(url: Column) -> Column:
    """Mask the password of a URL; anything else is unchanged."""
    return F.regexp_replace(url, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^:/?#@]*):[^@/?#]*@", "$1:***@")
