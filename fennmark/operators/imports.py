"""The import of an older catalogue: each record is published, with its group, or goes to review with its reasons; counts are of both.

Records are gated on the texts that are kept of their sources: pages of the same base domain, where the quote must stand as it is, or the transcript of a video, where case and punctuation
do not count. Of what passes, records with one quote are one group if several parties said it; if one party did, the first is published. What the
published rows say already goes to review as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import CAP
from ..functions.text import loose_form, slug, tokens, verbatim_form, word_count
from ..stored import stored
from .matching import quote_duplicates
from .quotes import held
from .search import best_match

# The words of a quote, the days around today that a source may be from, the likeness of titles that say the same.
LEAST_WORDS, MOST_WORDS, WINDOW_DAYS, TITLE_LIKENESS = 5, 40, 548, 0.5


def video_id(url: Column) -> Column:
    """The video that an address names; null for other addresses."""
    query = F.regexp_extract(url, "^(?i)https?://(?:www\\.|m\\.)?youtube\\.com/[^#]*[?&]v=([^&#]+)", 1)
    path = F.regexp_extract(url, "^(?i)https?://(?:www\\.)?youtu\\.be/([^?#]+)", 1)
    return F.coalesce(F.nullif(query, F.lit("")), F.nullif(path, F.lit("")))


def base_domain(url: Column) -> Column:
    """The last two parts of an address's host; null without a host."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, "^(?i)https?://([^/:?#]+)", 1)), "\\.$", "")
    return F.nullif(F.regexp_extract(host, "([^.]+\\.[^.]+)$", 1), F.lit(""))


def gated(records: DataFrame, texts: DataFrame, allowed: list[str], parties: dict[str, str], today: Column) -> DataFrame:
    """The records with party, form (the quote in its verbatim form), spoken and faults. `records`: rec, party_name, quote, url, title, category, day (string), amount (in millions, or
    null). `texts`: source (a base domain, or the id of a video), text; of several texts of a source one must hold the quote."""
    codes = F.create_map(*[F.lit(x) for name, code in parties.items() for x in (name.lower(), code)])
    rows = records.withColumns({"party": F.try_element_at(codes, F.lower(F.btrim("party_name"))), "video": video_id(F.col("url")), "form": verbatim_form(F.col("quote"))})
    rows = rows.withColumns({"source": F.coalesce("video", base_domain(F.col("url"))), "spoken": F.col("video").isNotNull(), "looked_for": F.when(F.col("video").isNotNull(), loose_form(F.col("quote"))).otherwise(F.col("form"))})
    rows = stored(rows, "records")
    asked = rows.select("source", "spoken").distinct()
    kept = texts.join(asked, "source").select(F.struct("source", F.monotonically_increasing_id().alias("n")).alias("doc"), F.when(F.col("spoken"), loose_form(F.col("text"))).otherwise(verbatim_form(F.col("text"))).alias("form"))
    found = held(rows.select(F.struct("rec", "source").alias("quote"), F.col("looked_for").alias("form")), stored(kept, "source-texts"))
    here = found.where("quote.source = doc.source").select(F.col("quote.rec").alias("rec"), F.lit(True).alias("held")).distinct()
    there = texts.where(F.btrim(F.coalesce("text", F.lit(""))) != "").select("source", F.lit(True).alias("has_text")).distinct()
    rows = rows.join(here, "rec", "left").join(there, "source", "left")
    words = word_count(F.col("form"))
    published = F.col("day").try_cast("date")
    checks = {
        "party": F.col("party").isNull(), "domain": ~F.col("spoken") & ~F.coalesce(F.col("source").isin(*allowed), F.lit(False)), "short": words < LEAST_WORDS, "long": words > MOST_WORDS,
        "no transcript": F.col("spoken") & F.col("has_text").isNull(), "not verbatim": ~(F.col("spoken") & F.col("has_text").isNull()) & F.col("held").isNull(),
        "amount": F.coalesce(F.col("amount") > CAP, F.lit(False)), "no date": published.isNull(), "date": F.coalesce(F.abs(F.datediff(today, published)) > WINDOW_DAYS, F.lit(False)),
    }
    faults = F.array_compact(F.array(*[F.when(rule, name) for name, rule in checks.items()]))
    # without a party nothing else is asked
    return rows.withColumn("faults", F.when(F.col("party").isNull(), F.array(F.lit("party"))).otherwise(faults)).drop("video", "looked_for", "held", "has_text", "source")


def imported(records: DataFrame, texts: DataFrame, existing: DataFrame, allowed: list[str], parties: dict[str, str], today: Column) -> dict[str, DataFrame]:
    """published (rec, party, group_id), review (rec, reasons, duplicate_of) and counts (outcome, n); each record is in one of the first two. `existing`: id, title, category, quote."""
    rows = stored(gated(records, texts, allowed, parties, today), "gated")
    passed = rows.where(F.size("faults") == 0)
    first = passed.groupBy("form", "party").agg(F.min("rec").alias("first"), F.min_by("title", "rec").alias("title"))
    clusters = first.groupBy("form").agg(F.count("*").alias("n_parties"), F.min_by("title", "first").alias("first_title"))
    placed = passed.join(first.select("form", "party", "first"), ["form", "party"]).join(clusters, "form")
    placed = stored(placed.withColumns({"group_id": F.when(F.col("n_parties") > 1, F.concat(F.lit("g-"), slug(F.col("first_title")))), "repeated": (F.col("n_parties") == 1) & (F.col("rec") != F.col("first"))}), "placed")
    fresh = placed.where("NOT repeated")
    quoted = quote_duplicates(fresh.select(F.col("rec").alias("left"), F.col("quote").alias("text")), existing.select(F.col("id").alias("right"), F.col("quote").alias("text")))
    titled = best_match(fresh.select("rec", "category", tokens(F.col("title")).alias("words")), existing.select("id", "category", tokens(F.col("title")).alias("words")), ["category"], "rec", "id", "words", TITLE_LIKENESS)
    same = fresh.select("rec").join(quoted.select(F.col("left").alias("rec"), F.col("right").alias("by_quote")), "rec", "left").join(titled.select("rec", F.col("id").alias("by_title")), "rec", "left")
    same = stored(same.select("rec", F.coalesce("by_quote", "by_title").alias("duplicate_of")), "same")
    of = F.lit(None).cast(existing.schema["id"].dataType)
    review = rows.where(F.size("faults") > 0).select("rec", F.col("faults").alias("reasons"), of.alias("duplicate_of"))
    review = review.unionByName(placed.where("repeated").select("rec", F.array(F.lit("repeated")).alias("reasons"), of.alias("duplicate_of")))
    review = review.unionByName(same.where("duplicate_of IS NOT NULL").select("rec", F.array(F.lit("duplicate")).alias("reasons"), "duplicate_of"))
    published = fresh.join(same.where("duplicate_of IS NULL").select("rec"), "rec").select("rec", "party", "group_id")
    counts = review.select(F.explode("reasons").alias("outcome")).unionByName(published.select(F.lit("published").alias("outcome"))).groupBy("outcome").agg(F.count("*").alias("n"))
    return {"published": published, "review": review, "counts": counts}
