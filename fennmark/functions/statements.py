"""What the text of a calculation says of its amount, and what it can be faulted for. All are column functions; amounts are in millions.

A calculation's sentences are read from the last to the first, as sums come last. Of those that draw a conclusion and do not report a discarded
amount, the first that names a base amount decides; if none does, the first whose only amount is no range.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import NUMBER, amounts, read_number
from .text import filled, once, sentences

# The expressions by which calculations and quotes are read.
CONCLUSION = r"(?i)\b(bas|basen|basbelopp|basbeloppet|basfall|basfallet|basantagand|basnivå|sammantaget|sammanlagt|totalt|totalkostnad|summan|summa|avrundat|avrundas)\b"
REJECTED = r"(?i)\b(avvisad|avvisades|förkastad|förkastades|tidigare uppskattning|tidigare belopp|tidigare beloppet|det tidigare|efterhandsberäkning|låg dessutom|stod på)\b"
BASES = (
    rf"\bbas(?:belopp|fall|nivå|antagande)?(?:et|en|t)?\s*(?::|är|blir|sätts till|läggs på|sätts)?\s*({NUMBER})(?!\s*(?:%|procent))",
    rf"({NUMBER})\s+som\s+bas",
    rf"\bmed\s+({NUMBER})\s+som\s+basbelopp",
    rf"\b(?:sammanlagt|sammantaget|totalt|summan blir)\s+({NUMBER})\s*(miljoner|miljarder)",
)
UNIT_PRICE = r"(?i)^\s*(kr|kronor)\s*(/|per\b)"
OPERAND = r"^[^.=×*]{0,15}?[×*=]|^[^.]{0,15}?\sà\s"
RANGE = r"[0-9]\s*[–—-]\s*(?:[a-zà-öø-ÿ]+\s+)?[0-9]"
OWN_UNIT = "miljarder kronor|miljoner kronor|mdkr|mkr"
EXPLAINED_ZERO = r"(?i)(beloppet är noll|sätts till noll|prissätts inte|prissätts till noll|räknas inte här|ingen ny (statlig )?(kostnad|utgift|nettokostnad)|ingen mätbar|redan beslutad|redan besluta|försumbar|utanför statens budget|omfördelning|räknas på (partiets|sina) egna|ligger på (partiets|sina) egna|på sina egna löften|dubbelräkn)"
VALUE_WORDS = r"(?iu)\b(rejäl\w*|historisk\w*|kraftig\w*|markant\w*|betydand\w*|ordentlig\w*|massiv\w*|stor satsning|kraftfull\w*|omfattande)\b"
LEVEL = r"(?iu)[0-9]|\b(procent|dubbl\w*|halver\w*|avskaff\w*|slopa\w*|ta bort|avgiftsfri|gratis|kostnadsfri)\b"
ZERO_REASONS = {
    "law or rule": r"lagändring|lagstift|förbud|förbjud|avreglering|regeländring|regelförändring|regeljusterin|reglering|förordningsändring|villkor för mottagare|hålls av lagen|administrativa skyldigheter",
    "inquiry or plan": r"utredning|utreda|handlingsplan|tillsätta|kartlägg|översyn|planarbete|nationell plan|förhandlingsarbete",
    "no new cost": r"omfördel\w*|nettokostnad|netto 0|redan betalas|redan finansier|redan beslutad|redan bestämt|inom befintlig|inryms i befintlig|ordinarie (?:anslag|budget|förvaltningsanslag)|behålls|står kvar|redan gäller|åtagande, inte en utbetalning",
    "broad list": r"uppräkning|önskelista|inriktning|flera politikområden|utan konkret|räknar upp|önskat utfall|mål(?:et)? (?:i sig|har ing)",
    "priced elsewhere": r"dubbelräkn|räkna samma politik|prissätts (?:en gång|på ett annat|som egna|som eget|var för sig|på de löftena)|ligger på (?:ett annat|partiets)|eget(?:s|na)? löfte|egna löften|egna specifika|konkreta \w+löften|reformens egna delar|jämförbart med p-[0-9]",
    "neither measure nor level": r"ing(?:en|et) (?:nivå|belopp|åtgärd)|anger (?:varken|ingen|inget)|utan (?:att ange|angiven)|utan specificerad|saknar angiven|värdeord|inte en åtgärd|går inte att (?:veta|räkna|prissätta)|ingenting att räkna på|inte specificeras|pekar inte ut (?:någon|något)|prissätts (?:därför )?inte\b",
    "negligible": r"försumbar\w*|marginell\w*|obetydlig\w*|bärs av|betalar inte|kostar (?:staten|statskassan)? ?(?:ingenting|inget)|ing(?:en|a) nya? (?:statlig|offentlig|myndighets)\w*|inga nya (?:anslag|utgifter|investeringar)|inga löpande statliga utgifter",
}
#: Reasons that do not hold where the quote names a measure that exists.
OVERRULED = ("broad list", "neither measure nor level")
ACTION = r"(?iu)\b(höja|höjer|höjs|höjning|införa|inför|införs|bygga ut|bygger ut|utöka|utökar|förstärka|stärka|återinföra|återinför|avskaffa|avskaffar|slopa|slopar|dubblera|fördubbla)\b"
NAMED_SUPPORT = r"(?iu)\b\p{L}{3,}(?:bidraget|bidragen|bidrag|ersättningen|avdraget|tillägget|pensionen|garantin|tjänsterna|lyftet|anslaget|premien|checken|pengen|stödet)\b"
EXPLAINS = r"(?iu)utanför statsbudgeten|går in i och ut ur|avser åtgärden, inte|inte dess följder|prissätts inte här|den delen kostar|kostar noll|ingår inte i beloppet|räknas på ett annat|bara den marginella"
TAX = r"(?iu)\b(skattefri\w*|skatteavdrag\w*|skattekredit\w*|skattereduktion\w*|jobbskatteavdrag\w*|arbetsgivaravgift\w*|moms\w*)\b|\b(?:sänk\w*|slopa\w*|avskaffa\w*|höj\w*)\s+(?:\w+\s+){0,2}(?:skatt\w*|moms\w*)\b|\bavdrag för\b"
SPENDING = ("utgift", "besparing")
RECONSTRUCTED = r"(?iu)rekonstruerad i efterhand|ursprungliga resonemanget sparades inte"
#: How far a field may be from what its text says.
TOLERANCE = 1.35


def conclusions(calculation: Column) -> Column:
    """The sentences that draw a conclusion and report no discarded amount, the last one first."""
    return F.reverse(F.filter(sentences(calculation), lambda s: s.rlike(CONCLUSION) & ~s.rlike(REJECTED)))


def _scale(sentence: Column) -> Column:
    """What a bare number of a sentence counts: thousands where only milliards are named."""
    return F.when(sentence.rlike(r"(?i)miljarder\b|mdkr") & ~sentence.rlike(r"(?i)miljoner\b|mkr"), 1000.0).otherwise(1.0)


def _first(values: Column) -> Column:
    return F.get(F.filter(values, lambda x: x.isNotNull()), 0)


def _named_base(sentence: Column, pattern: str) -> Column:
    """The base amount that one expression names in a sentence. A price for a unit is none; where the number is an operand, the sentence's last amount is meant; a unit
    of the expression, else one right behind the same number, else the sentence's, scales it."""
    unit_group = 2 if "miljoner|miljarder)" in pattern else None
    parts = F.struct(
        F.regexp_extract(sentence, f"(?i){pattern}", 1).alias("raw"), F.regexp_extract(sentence, f"(?is){pattern}(.*)$", 3 if unit_group else 2).alias("tail"),
        (F.lower(F.regexp_extract(sentence, f"(?i){pattern}", 2)) if unit_group else F.lit("")).alias("unit"),
    )

    def value(x: Column) -> Column:
        number = read_number(x["raw"])
        own = F.lower(F.call_function("regexp_extract", sentence, F.concat(F.lit("(?i)\\Q"), x["raw"], F.lit(f"\\E\\s*({OWN_UNIT})")), F.lit(1)))
        thousand = x["unit"].eqNullSafe("miljarder") | ((x["unit"] == "") & own.rlike("^(miljarder|mdkr)"))
        scaled = number * F.when(thousand, 1000.0).when((x["unit"] != "") | (own != ""), 1.0).otherwise(_scale(sentence))
        return F.when((x["raw"] == "") | number.isNull() | x["tail"].rlike(UNIT_PRICE), None).when(x["tail"].rlike(OPERAND), F.try_element_at(amounts(sentence), F.lit(-1))).otherwise(scaled)

    return once(parts, value)


def stated_base(calculation: Column) -> Column:
    """The base amount that a calculation arrives at; null where it names none, or more than one."""
    last = conclusions(calculation)
    named = _first(F.transform(last, lambda s: F.coalesce(*[_named_base(s, p) for p in BASES])))
    only = _first(F.transform(last, lambda s: F.when(~s.rlike(RANGE), once(amounts(s), lambda a: F.when(F.size(a) == 1, F.get(a, 0))))))
    return F.coalesce(named, only)


def mismatch(calculation: Column, base: Column, withdrawn: Column) -> Column:
    """stated and direction where a field is too high or too low for its own calculation; null where it is not, or where either is nought or the row is withdrawn."""

    def held(stated: Column) -> Column:
        apart = F.when(base / stated > TOLERANCE, "too high").when(base / stated < 1 / TOLERANCE, "too low")
        return F.when(~withdrawn & (base != 0) & (stated != 0) & apart.isNotNull(), F.struct(stated.alias("stated"), apart.alias("direction")))

    return once(stated_base(calculation), held)


def sum_behind_zero(calculation: Column, base: Column, withdrawn: Column) -> Column:
    """The highest amount that the conclusions behind a nought come to, if nothing in the text explains the nought; else null."""
    most = F.array_max(F.flatten(F.transform(conclusions(calculation), lambda s: F.transform(amounts(s), lambda a: a * _scale(s)))))
    unexplained = ~filled(calculation).rlike(EXPLAINED_ZERO) & ~F.coalesce(stated_base(calculation) == 0, F.lit(False))
    return F.when(~withdrawn & (base == 0) & unexplained & (most > 0), most)


def zero_reasons(text: Column) -> Column:
    """The names of all reasons for a nought that a text gives."""
    return F.array_compact(F.array(*[F.when(filled(text).rlike(f"(?iu){p}"), name) for name, p in ZERO_REASONS.items()]))


def named_measure(quote: Column) -> Column:
    """The word by which a quote names a measure that exists, if it also says what is to be done with it; else null."""
    return F.when(filled(quote).rlike(ACTION), F.nullif(F.regexp_extract(quote, NAMED_SUPPORT, 0), F.lit("")))


def own_numbers(quote: Column) -> Column:
    """The amounts that a quote states itself."""
    return amounts(quote)


def is_reconstructed(calculation: Column) -> Column:
    return filled(calculation).rlike(RECONSTRUCTED)


@dataclass
class Costing:
    """The columns of a priced promise."""

    quote: Column
    calculation: Column
    note: Column
    base: Column
    low: Column
    high: Column
    basis: Column
    kind: Column


def objections(x: Costing) -> Column:
    """The names of the checks that a costing fails, in the order of the checks. Without a calculation only the first two can fail."""
    text = F.btrim(filled(x.calculation))
    there, base = text != "", F.coalesce(x.base, F.lit(0.0))
    whole = F.btrim(F.concat_ws(" ", text, F.btrim(filled(x.note))))
    by_text = F.struct(amounts(text).alias("stated"), own_numbers(x.quote).alias("own"))

    def found(a: Column) -> Column:
        bypassed = F.filter(a["own"], lambda n: ~F.array_contains(a["stated"], n) & (n != base))
        bounds = x.low.isNotNull() & x.high.isNotNull()
        surrounded = (x.low <= base) & (base <= x.high)
        explained = text.rlike(EXPLAINS)
        checks = {
            "zero without anchor": (base == 0) & named_measure(x.quote).isNotNull() & (F.size(F.array_except(zero_reasons(whole), F.array(*map(F.lit, OVERRULED)))) == 0),
            "no calculation": ~there,
            "amount not named": there & (base > 0) & (F.size(a["stated"]) == 0) & stated_base(text).isNull(),
            "own number bypassed": there & (F.size(bypassed) > 0) & ~explained,
            "value word as level": there & (base > 0) & (x.basis == "parti") & filled(x.quote).rlike(VALUE_WORDS) & ~filled(x.quote).rlike(LEVEL),
            "zero without reason": there & (base == 0) & (F.size(zero_reasons(text)) == 0),
            "span without base": there & bounds & ~surrounded,
            "span without width": there & bounds & surrounded & (x.low == x.high) & (base > 0) & (x.basis == "llm_estimat"),
            "kind against quote": there & filled(x.quote).rlike(TAX) & x.kind.isin(*SPENDING) & (base > 0) & ~explained,
        }
        return F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), name) for name, rule in checks.items()]))

    return once(by_text, found)
