"""What the wording of a promise tells of it: whether its amount is spent once or each year, whether it is a price for a unit, whether it reports instead of promising. All are column functions; a null
text is empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import bounded
from .text import BLANKS, INVISIBLE, filled, verbatim_form

#: The edge of a word of ASCII letters, digits and underscores; other letters do not count as parts of words.
EDGE = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"

# The expressions by which promises are read (\b is EDGE).
ONE_OFF = r"(?iu)\b(?:engångs\w*|en\s+gång|inlösen|återköp|skänk\w*|gåv(?:a|or))\b|under\s+(?:nästa\s+)?mandatperiod"
RECURRING = r"(?iu)(?<![a-zåäöéèü])(?:årlig|per\s+år|om\s+året|varje\s+år)|/\s*år(?![a-zåäöéèü])"
UNIT_PRICE = r"(?iu)\b(?:per|/)\s*(?:barn|person|elev|anställd|capita|hushåll|familj|pensionär|student|patient|brukare|medlem|månad|vecka|dag|dygn|timme|mil)\b|\bi\s+(?:månaden|veckan|timmen)\b"
COMPLETED = (
    r"(?i)\b(har|hade)\s+(?:[a-zà-öø-ÿ]+\s+){0,2}[a-zà-öø-ÿ]{2,}(at|it|tt|et|kt|rt|ft|gt|dd|ått)\b",
    r"(?i)\bvi\s+(införde|sänkte|höjde|gav|byggde|skapade|genomförde|tog|lade)\b",
    r"(?i)\bsedan\s+vi\b",
    r"(?i)\b(halverades|sänktes|höjdes|infördes|avskaffades|genomfördes|byggdes|togs bort)\b",
    r"(?i)\bden\s+(moderatledda\s+)?regeringen\s+(avsätter|har|inför|införde|satsar)\b",
    r"(?i)(?:^|[\s(])än\s+någonsin|\baldrig\s+(förr|tidigare)\b|\bhögsta\s+någonsin",
)
COMMITMENT = (
    r"(?i)\b(vill|ska|bör|kommer att|kommer vi|lovar|tänker|avser|föreslår|vi ämnar)\b",
    r"(?i)(?:^|[^a-zà-öø-ÿ])(återinföra|återkomma|återställa)(?![a-zà-öø-ÿ])",
    r"(?i)\bnästa mandatperiod\b",
    r"(?i)\bska (bli|få|kunna|vara)\b",
)
REJECTION = r"(?iu)^Riksdagen avslår motion(?:erna)?\b"
PARLIAMENT = r"(?iu)(Riksdagen ställer sig bakom det som anförs|tillkännager detta för regeringen|detta tillkännager riksdagen|Riksdagen (avslår|antar|anvisar|bifaller)\b)"
#: With what a match of each expression begins, so that most places in a text are passed by after one look. COMMITMENT's second one begins with anything.
FIRST = {
    ONE_OFF: "eiåsgu", RECURRING: "åpov/", UNIT_PRICE: "p/i", COMPLETED[0]: "h", COMPLETED[1]: "v", COMPLETED[2]: "s", COMPLETED[3]: "hsiagbt", COMPLETED[4]: "d", COMPLETED[5]: "\\s(äah",
    COMMITMENT[0]: "vsbkltaf", COMMITMENT[2]: "n", COMMITMENT[3]: "s", PARLIAMENT: "rtd",
}
#: Other characters that are letters of these in either case, by Unicode's rules.
_ALIKE = "\u0130\u0131\u017f\u212a\u212b"
SPOKEN_HOSTS = ("svtplay.se", "svt.se/video", "youtube.com", "youtu.be", "tv4play.se", "play.tv4.se", "sverigesradio.se", "podcasts.apple.com", "open.spotify.com", "vimeo.com", "facebook.com/watch")
TYPES, PERIODS = ("utgift", "intäktsminskning", "besparing", "intäktsökning"), ("per_ar", "engang")
NO_NOTE, SET_ONCE = "LLM-estimat utan angivet belopp i källtext.", " [period satt till engang: engångssignal i löftet]"
NOTE_CHARS, SET_NOTE_CHARS, CALCULATION_CHARS = 200, 240, 800
_BLANKS = " \n\r\t"


def _said(text: Column, *patterns: str) -> Column:
    look = lambda p: f"(?=[{FIRST[p]}{FIRST[p].replace(chr(92) + 's', '').upper()}{_ALIKE}])" if p in FIRST else ""
    found = [filled(text).rlike(f"{look(p)}(?:{p})".replace(r"\b", EDGE)) for p in patterns]
    out = found[0]
    for other in found[1:]:
        out = out | other
    return out


def one_off(text: Column) -> Column:
    """Whether the text says that its amount is spent once."""
    return _said(text, ONE_OFF)


def recurring(text: Column) -> Column:
    """Whether the text itself says that its amount comes back each year."""
    return _said(text, RECURRING)


def unit_price(quote: Column) -> Column:
    """Whether an amount is a price for a person, a month and the like, so no total."""
    return _said(quote, UNIT_PRICE)


def completed_policy(quote: Column) -> Column:
    """Whether a quote reports what was done, and commits to nothing."""
    return _said(quote, *COMPLETED) & ~_said(quote, *COMMITMENT)


def only_rejects(quote: Column) -> Column:
    """Whether a decision says only that motions fall."""
    begins = quote.rlike(f"^{BLANKS[:-1]}*(?:{INVISIBLE}{BLANKS[:-1]}*)*[Rr]")  # no form of another text begins so
    return F.coalesce(begins, F.lit(False)) & verbatim_form(quote).rlike(REJECTION.replace(r"\b", EDGE))


def parliament_phrased(quote: Column) -> Column:
    """Whether a promise's quote is in parliament's own wording."""
    return _said(quote, PARLIAMENT)


def signals(quote: Column) -> Column:
    """The names of all that a quote tells, in a fixed order."""
    rules = {"one-off": one_off, "recurring": recurring, "unit price": unit_price, "completed": completed_policy, "rejection": only_rejects, "parliament": parliament_phrased}
    return F.array_compact(F.array(*[F.when(rule(quote), name) for name, rule in rules.items()]))


def spoken_source(url: Column) -> Column:
    """Whether an address is of a broadcast, moving pictures or sound."""
    return F.exists(F.array(*map(F.lit, SPOKEN_HOSTS)), lambda host: F.contains(F.lower(filled(url)), host))


def film_address(url: Column) -> Column:
    """A film's own address, without the place in it; of other addresses what stands before the first `&`."""
    video = F.coalesce(*[F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in ("[?&]v=([A-Za-z0-9_-]{6,})", "youtu[.]be/([A-Za-z0-9_-]{6,})")])
    return F.when(video.isNotNull(), F.concat(F.lit("https://www.youtube.com/watch?v="), video)).otherwise(F.substring_index(url, "&", 1))


def cut_note(text: Column, most: int) -> Column:
    """A note of at most `most` characters, cut at its last blank unless that would leave less than three fifths, with an ellipsis."""
    whole = F.btrim(filled(text), F.lit(_BLANKS))
    cut = F.left(whole, F.lit(most - 1))
    blank = F.char_length(cut) - F.instr(F.reverse(cut), " ")
    head = F.when((F.instr(cut, " ") > 0) & (blank > most * 0.6), F.left(cut, blank)).otherwise(cut)
    return F.when(F.char_length(whole) <= most, whole).otherwise(F.concat(F.regexp_replace(head, "[\\s,;:.–-]+$", ""), F.lit("…")))


def estimate(low: Column, base: Column, high: Column, confidence: Column, kind: Column, period: Column, note: Column, calculation: Column, said: Column) -> Column:
    """struct<low, base, high, confidence, type, period, note, calculation> of an estimate, within its bounds; null if a number is missing.

    Unknown types are expenses, unknown periods a year each. A yearly amount is set to one spent once where what the promise says (`said`: quote and title) is so, and its note says
    that it was set. Calculations are cut, and null where nothing is said."""
    known = F.when(period.isin(*PERIODS), period).otherwise(F.lit(PERIODS[0]))
    once_only = (known == PERIODS[0]) & one_off(said)
    plain = F.when(F.btrim(filled(note), F.lit(_BLANKS)) != "", cut_note(note, NOTE_CHARS)).otherwise(F.lit(NO_NOTE))
    told = F.when(once_only, cut_note(F.concat(plain, F.lit(SET_ONCE)), SET_NOTE_CHARS)).otherwise(plain)
    span = bounded(low, base, high, confidence)
    fields = [span[c].alias(c) for c in ("low", "base", "high", "confidence")]
    kind = F.when(kind.isin(*TYPES), kind).otherwise(F.lit(TYPES[0]))
    worked = F.nullif(F.left(F.btrim(filled(calculation), F.lit(_BLANKS)), F.lit(CALCULATION_CHARS)), F.lit(""))
    whole = F.struct(*fields, kind.alias("type"), F.when(once_only, F.lit(PERIODS[1])).otherwise(known).alias("period"), told.alias("note"), worked.alias("calculation"))
    return F.when(span.isNotNull(), whole)
