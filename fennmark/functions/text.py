"""Forms of text that comparisons rest on, keys made of it, and the pieces it falls into. All are column functions; a null text is empty."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that are dropped, unified or count as white space when texts are held against each other.
INVISIBLE = "[­᠎​-‏‪-‮⁠-⁤⁦-⁩﻿]"
UNIFIED = {"[‘’‚‛′]": "'", "[“”„‟″«»]": '"', "[‐-―−]": "-", "…": "..."}
BLANKS = "[\t\n\u000b\u000c\r    -     　]+"
#: Any character that `verbatim_form` composes, drops or unifies; ASCII is told apart first.
_MARKED = "[\u00ab-\uffff&&[\u0300-\u036f" + INVISIBLE + "".join(UNIFIED) + "]]"
#: Runs of white space but for a blank alone, which stays as it is.
_RUNS = " " + BLANKS + "|[\t-\r]" + BLANKS[:-1] + "*|[\u00a0-\u3000&&" + BLANKS[:-1] + "]" + BLANKS[:-1] + "*"
NOT_KEPT = "[^a-z0-9åäöéèü]"
#: The same, letter by letter: Java looks such a set up at once, where it tries ranges one after the other; over whole texts that takes a fifth of the time.
_DROPPED = "[^abcdefghijklmnopqrstuvwxyz0123456789åäöéèü]"
NOT_A_WORD = "[^A-Za-z0-9ÅÄÖÉÜåäöéü-]+"
LIGHT_ENDINGS = ("erna", "arna", "orna", "en", "et", "er", "ar", "or", "na")
ENTITIES = {"&nbsp;": "\u00a0", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}
#: What stands in the words that `cut_stems` cuts.
STEM_LETTERS = "[a-zà-öø-ÿ0-9-]"
INLINE_TAGS = "a|abbr|b|em|i|small|span|strong|sub|sup|u"


def _compositions() -> list[tuple[str, str]]:
    """Latin letters followed by one combining mark, and the single character for both, by Unicode's own rule."""
    marks = [chr(c) for c in range(0x300, 0x370)]
    letters = [chr(c) for c in (*range(65, 91), *range(97, 123))]
    pairs = ((x + m, unicodedata.normalize("NFC", x + m)) for m in marks for x in letters)
    return [(a, b) for a, b in pairs if len(b) == 1]


def once(value: Column, use) -> Column:
    """`use(value)` with the value computed once, also where `use` names it within a lambda."""
    return F.transform(F.array(value), use)[0]


def composed(text: Column) -> Column:
    """Latin letters and the combining mark after them as one character. Texts without such marks are left as they are."""
    single = F.create_map(*[F.lit(x) for pair in _compositions() for x in pair])
    found = F.array_distinct(F.regexp_extract_all(text, F.lit("([A-Za-z][\u0300-\u036f])"), F.lit(1)))
    return F.when(text.rlike("[\u0300-\u036f]"), F.aggregate(found, text, lambda t, p: F.replace(t, p, F.coalesce(F.try_element_at(single, p), p)))).otherwise(text)


def filled(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def single_blanks(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, _RUNS, " "))


def verbatim_form(text: Column) -> Column:
    """The form in which a quote must stand in its source: composed, without invisible characters, one kind of quotation mark and dash, single blanks. Case is kept."""
    bare = F.regexp_replace(composed(filled(text)), INVISIBLE, "")
    unified = reduce(lambda t, p: F.regexp_replace(t, *p), UNIFIED.items(), bare)
    return single_blanks(F.when(text.rlike(_MARKED), unified).otherwise(filled(text)))


def word_count(form: Column) -> Column:
    """The words of a text in its verbatim form."""
    return F.when(form == "", 0).otherwise(F.size(F.split(form, " ")))


def quote_key(text: Column) -> Column:
    """Lower-case letters, Swedish ones among them, and digits."""
    return F.regexp_replace(F.lower(composed(filled(text))), _DROPPED, "")


def loose_form(text: Column) -> Column:
    """Lower case, anything but letters and digits as blanks."""
    return F.btrim(F.regexp_replace(F.lower(filled(text)), "[^\\p{L}\\p{N}]+", " "))


def all_tokens(text: Column, least: int = 3) -> Column:
    """The words of at least so many letters or digits, lower-case, in order, repeated ones kept."""
    return F.regexp_extract_all(F.lower(composed(filled(text))), F.lit(f"({NOT_KEPT.replace('^', '')}{{{least},}})"), F.lit(1))


def tokens(text: Column) -> Column:
    """The distinct words of more than two letters or digits, in order of occurrence."""
    return F.array_distinct(all_tokens(text))


def terms(text: Column, short_words: tuple[str, ...] = ()) -> Column:
    """Words of four characters or more, and shorter ones that are written in capitals and are none of `short_words`; lower-case, in order, repeated ones kept."""
    words = F.transform(F.split(filled(text), NOT_A_WORD), lambda w: F.regexp_replace(w, "^-+|-+$", ""))

    def taken(w: Column) -> Column:
        capitals = (F.char_length(w) >= 2) & (w == F.upper(w)) & w.rlike("[A-ZÅÄÖÉÜ]")
        return (F.char_length(w) >= 4) | (capitals & ~F.lower(w).isin(*short_words) if short_words else capitals)

    return F.transform(F.filter(words, taken), F.lower)


def without_stop_words(words: Column, *lists: Column) -> Column:
    """Words that are in none of the lists and not digits only."""
    return F.filter(reduce(F.array_except, lists, words), lambda w: ~w.rlike("^[0-9]+$"))


def light_stem(word: Column) -> Column:
    """The word without the first ending that leaves four letters or more."""
    out = word
    for ending in reversed(LIGHT_ENDINGS):
        out = F.when(word.endswith(ending) & (F.char_length(word) >= 4 + len(ending)), F.left(word, F.char_length(word) - len(ending))).otherwise(out)
    return out


def cut_stems(text: Column, length: int, stop_words: tuple[str, ...] = ()) -> Column:
    """(stem, word): for each distinct beginning of `length` letters of the longer words, the first word that has it."""
    words = F.filter(F.split(F.regexp_replace(F.lower(filled(text)), "[^a-zà-öø-ÿ0-9\\s-]", " "), "\\s+"), lambda w: (F.char_length(w) >= length) & (~w.isin(*stop_words) if stop_words else F.lit(True)))
    placed = F.array_sort(F.transform(words, lambda w, k: F.struct(F.left(w, F.lit(length)).alias("stem"), k.alias("k"), w.alias("word"))))
    firsts = lambda x: F.filter(x, lambda w, k: (k == 0) | (w["stem"] != F.get(x, k - 1)["stem"]))
    return F.transform(once(placed, firsts), lambda w: F.struct(w["stem"].alias("stem"), w["word"].alias("word")))


def distinct_stems(text: Column, length: int) -> Column:
    """The stems of `cut_stems` alone, in order of occurrence, by one pattern."""
    return F.array_distinct(F.regexp_extract_all(F.lower(filled(text)), F.lit(f"({STEM_LETTERS}{{{length}}}){STEM_LETTERS}*"), F.lit(1)))


def slug(text: Column) -> Column:
    """Lower case without Swedish letters, everything else than a-z and digits as one hyphen."""
    return F.regexp_replace(F.regexp_replace(F.translate(F.lower(filled(text)), "åäö", "aao"), "[^a-z0-9]+", "-"), "^-|-$", "")


def sentences(text: Column) -> Column:
    """Pieces that end with . ! or ? before white space; none is blank."""
    return F.filter(F.split(F.btrim(filled(text), F.lit(" \n\r\t")), "(?<=[.!?])[ \n\r\t]+"), lambda s: s != "")


def trimmed_quote(text: Column, most: int, least: int = 5) -> Column:
    """The first `most` words, up to the last end of a sentence among them if that leaves `least`; a text of no more words as it is."""
    words = F.split(single_blanks(filled(text)), " ")
    cut = F.array_join(F.slice(words, 1, most), " ")
    sentence = F.regexp_extract(cut, "^(.*[.!?])", 1)
    return F.when(F.size(words) <= most, text).when(F.size(F.split(sentence, " ")) >= least, sentence).otherwise(cut)


def cut_at_word(text: Column, most: int, least: int = 20) -> Column:
    """At most `most` characters, cut at a blank behind the first `least`, with an ellipsis."""
    cut = F.left(text, F.lit(most - 1))
    last = F.char_length(cut) - F.instr(F.reverse(cut), " ")
    head = F.when((F.instr(cut, " ") > 0) & (last > least), F.left(cut, last)).otherwise(cut)
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.regexp_replace(head, "[\\s,.;:!?–—-]+$", ""), F.lit("…")))


def inline_text(html: Column) -> Column:
    """A page's text: inline tags vanish, other tags are blanks, entities are read, white space is single."""
    bare = F.regexp_replace(filled(html), "(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, f"(?i)</?({INLINE_TAGS})(\\s[^>]*)?>", ""), "<[^>]*>", " ")
    return single_blanks(reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), ENTITIES.items(), bare))


def escaped(text: Column) -> Column:
    """Safe inside HTML."""
    return reduce(lambda t, p: F.replace(t, F.lit(p[1]), F.lit(p[0])), [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")], filled(text))


def masked(text: Column, pattern: str) -> Column:
    """Safe inside HTML, with what the pattern finds in a marked span."""
    return F.regexp_replace(escaped(text), f"({pattern})", '<span class="mask">$1</span>')


def between(text: Column, begin: str, end: str) -> Column:
    """What stands between two headings, trimmed; null if the first is missing; to the end if the second is."""
    at = F.instr(text, begin)
    rest = F.substring(text, at + len(begin), F.char_length(text))
    return F.when(at > 0, F.btrim(F.substring_index(rest, end, 1), F.lit(" \n\r\t")))


def questions(text: Column, lead: str, least: int) -> Column:
    """The sentences of `least` characters or more that end with a question mark, behind the last match of `lead` (or in the whole text)."""
    rest = F.element_at(F.split(filled(text), lead), -1)
    return F.filter(sentences(F.regexp_replace(rest, "\\s+", " ")), lambda s: s.endswith("?") & (F.char_length(s) >= least))


def without_note(text: Column, marker: str) -> Column:
    """The text before an appended note."""
    return F.rtrim(F.substring_index(filled(text), marker, 1))


def page_with(pages: Column, quote: Column, first_page: int = 1) -> Column:
    """The number of the first page whose verbatim form holds that of the quote; null if none does."""
    at = once(verbatim_form(quote), lambda form: F.when(form != "", F.array_position(F.transform(pages, lambda p: F.contains(verbatim_form(p), form)), True)))
    return F.when(at > 0, at + (first_page - 1))


def longest_run(text: Column, quote: Column, least: int = 5) -> Column:
    """The longest run of words of the quote that the text still holds, of `least` words or more, the earliest of equal ones; null if there is none.

    A window moves over the quote's words: it takes in the next word while the text holds it, else lets go of its first. Part of what a text holds it holds too, so no longer run is
    missed; there are two steps a word at most, and nothing but the window and the best run so far is kept."""

    def longest(form: Column, words: Column) -> Column:
        def step(at: Column, _: Column) -> Column:
            size = at["end"] - at["start"]
            held = (at["end"] < F.size(words)) & F.contains(form, F.array_join(F.slice(words, at["start"] + 1, size + 1), " "))
            better = held & (size + 1 > at["size"])
            return F.struct(
                F.when(held, at["start"]).otherwise(at["start"] + 1).alias("start"), F.when(held | (size == 0), at["end"] + 1).otherwise(at["end"]).alias("end"),
                F.when(better, at["start"]).otherwise(at["best"]).alias("best"), F.when(better, size + 1).otherwise(at["size"]).alias("size"),
            )

        zero = F.lit(0)
        begin = F.struct(zero.alias("start"), zero.alias("end"), zero.alias("best"), zero.alias("size"))
        return F.aggregate(F.sequence(F.lit(1), 2 * F.size(words)), begin, step, lambda x: F.when(x["size"] >= least, F.array_join(F.slice(words, x["best"] + 1, x["size"]), " ")))

    return once(verbatim_form(text), lambda form: once(F.split(verbatim_form(quote), " "), lambda words: longest(form, words)))


def umbrella(title: Column, quote: Column) -> Column:
    """Whether a title lists several commitments: three parts of two words, or two and five in the quote."""
    parts = lambda t: F.size(F.filter(F.split(filled(t), ",|(?i)\\s+och\\s+"), lambda x: F.size(F.split(F.btrim(x), "\\s+")) >= 2))
    return (parts(title) >= 3) | ((parts(title) >= 2) & (parts(quote) >= 5))
