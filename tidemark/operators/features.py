"""Language features of claims, and their aggregates by company and year."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import Lexicon
from ..functions.numbers import py_round
from ..functions.text import has_prefix, lexicon_ratio, prefix_hits, reading_ease, squeeze, words

# ---- fixed patterns
PASSIVE = r"(?iu)\b(?:is|are|was|were|be|been|being|has been|have been|had been)\s+(?:\w+ly\s+)?\w+(?:ed|en)\b"
FIRM_MODAL, SOFT_MODAL = r"(?iu)\b(?:will|shall|must)\b", r"(?iu)\b(?:may|might|could|should|would)\b"
BY_YEAR = r"(?iu)\bby\s+(?:19|20)\d{2}\b"
ASSURANCE = r"(?iu)\b((?:limited|reasonable)\s+assurance|independently\s+assured|independent\s+(?:assurance|audit|verification)|third-party\s+(?:assurance|verification|audit))\b"
AUDITOR = r"(?iu)\b(Deloitte|EY|Ernst\s*&\s*Young|KPMG|PwC|Pricewaterhouse|Bureau Veritas|SGS|DNV|T[UÜ]V|Intertek|ERM)\b"


def _there(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def with_features(claims: DataFrame, lexicon: Lexicon = Lexicon(), highlights: bool = False) -> DataFrame:
    """``claims`` (sentence and slots) with their features.

    Ratios are rounded before what is derived from them.  Null slots are
    absent ones; a null sentence has no words and null readability.
    """
    s = F.col("sentence")
    low = F.lower(F.coalesce(s, F.lit("")))
    out = claims.withColumn("n_words", F.size(words(F.coalesce(s, F.lit("")))))
    n = F.col("n_words")
    out = out.withColumns({
        "vague_ratio": lexicon_ratio(low, lexicon.vague, n),
        "hedging_ratio": lexicon_ratio(low, lexicon.hedging, n),
        "future_ratio": py_round(lexicon_ratio(low, lexicon.future, n) + F.when(s.rlike(BY_YEAR), 0.02).otherwise(0.0), 4),
        "_positive": lexicon_ratio(low, lexicon.positive, n),
        "_negative": lexicon_ratio(low, lexicon.negative, n),
        "quantification_present": _there(F.col("quantity")),
        "baseline_present": _there(F.col("baseline")),
        "date_present": _there(F.col("deadline")),
        "scope_present": _there(F.col("scope")),
        "verification_present": has_prefix(low, lexicon.verification),
    })
    present = sum((F.col(c).cast("int") for c in ("quantification_present", "baseline_present", "date_present", "scope_present", "verification_present")), F.lit(0))
    soft = F.least(F.lit(0.3), (F.col("vague_ratio") + F.col("hedging_ratio")) * 4)
    out = out.withColumns({
        "sentiment": py_round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_positive") - F.col("_negative"))), 4),
        "specificity_score": py_round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), present / 5 - soft)), 3),
        "readability": reading_ease(s),
        "passive_voice": F.coalesce(s.rlike(PASSIVE), F.lit(False)),
        "modal_firm": F.coalesce(s.rlike(FIRM_MODAL), F.lit(False)),
        "modal_soft": F.coalesce(s.rlike(SOFT_MODAL), F.lit(False)),
        "positive_tone_words": prefix_hits(low, lexicon.positive),
    }).drop("_positive", "_negative")
    return with_highlights(out, lexicon) if highlights else out


def _mean(c: Column, digits: int, of: int) -> Column:
    """Mean of values with ``of`` digits, from their sum in whole units, so the order of rows cannot change it."""
    scale = 10**of
    return py_round(F.sum(F.round(c * scale).cast("long")) / F.lit(float(scale)) / F.count(c), digits)


def _share(c: Column) -> Column:
    return py_round(F.count_if(c) / F.count("*"), 3)


def year_series(features: DataFrame, by: tuple[str, ...] = ("company", "publish_year")) -> DataFrame:
    """One row for each company and year: means, shares and counts; null where nothing can be measured.

    Negated claims are no commitments: they don't count as firm or hedged.
    """
    c = F.col
    quantified, tone = F.count_if("quantification_present"), F.sum("positive_tone_words")
    firm, hedged = (F.count_if((c("strength") == tier) & ~c("negated")) for tier in ("firm", "hedged"))
    n = F.count("*")
    return features.groupBy(*by).agg(
        n.alias("n_claims"),
        _mean(c("specificity_score"), 4, 3).alias("mean_specificity"),
        *(_mean(c(r), 4, 4).alias(r) for r in ("vague_ratio", "hedging_ratio", "future_ratio")),
        _share(c("quantification_present")).alias("quantified_share"),
        _share(c("verification_present")).alias("verified_share"),
        _share(c("scope_present")).alias("scope_share"),
        _share(c("passive_voice")).alias("passive_share"),
        _share(c("negated")).alias("negated_share"),
        _share(c("conditional")).alias("conditional_share"),
        _mean(c("readability"), 1, 1).alias("readability"),
        _mean(c("sentiment"), 4, 4).alias("mean_sentiment"),
        py_round(F.when(quantified > 0, tone / quantified), 2).alias("say_more_prove_less"),
        py_round(firm / n, 3).alias("firm_share"),
        py_round(hedged / n, 3).alias("hedged_share"),
        py_round(F.when(hedged > 0, firm / hedged), 2).alias("commitment_ratio"),
    )


def trend(series: DataFrame, measure: str) -> DataFrame:
    """company, first, last, delta of a measure over a company's years."""
    out = series.groupBy("company").agg(F.min_by(measure, "publish_year").alias("first"), F.max_by(measure, "publish_year").alias("last"))
    return out.withColumn("delta", F.col("last") - F.col("first"))


def breakdown(claims: DataFrame) -> DataFrame:
    """Claims by kind and strength, and how often each slot is filled."""
    filled = [py_round(F.avg(_there(F.col(s)).cast("int")), 3).alias(f"{s}_rate") for s in ("quantity", "baseline", "deadline", "scope")]
    return claims.groupBy("claim_type", "strength").agg(F.count("*").alias("n"), *filled)


SPANS = "array<struct<start:int,end:int,kind:string,term:string>>"


def with_highlights(claims: DataFrame, lexicon: Lexicon = Lexicon()) -> DataFrame:
    """``claims`` with highlights: the words behind the scores, none overlapping, the earlier and then the longer first.

    All places of a term are wanted, which no built-in function gives: Arrow
    batches of sentences go through one compiled pattern for each term.
    """
    lists = (("vague", lexicon.vague), ("hedge", lexicon.hedging), ("verify", lexicon.verification), ("positive", lexicon.positive), ("negative", lexicon.negative))
    patterns = [(kind, [rf"\b{re.escape(t)}\b" for t in terms]) for kind, terms in lists]

    @F.pandas_udf(SPANS)
    def spans(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        compiled = [(kind, re.compile(p)) for kind, ps in patterns for p in ps]
        for texts, *slots in batches:
            rows = []
            for text, *values in zip(texts, *slots, strict=True):
                low, found = (text or "").lower(), []
                for kind, p in compiled:
                    found += [(m.start(), m.end(), kind) for m in p.finditer(low)]
                for kind, value in zip(("qty", "baseline", "deadline"), values, strict=True):
                    at = low.find(value.lower()) if value else -1
                    if at >= 0:
                        found.append((at, at + len(value), kind))
                kept, free = [], -1
                for a, b, kind in sorted(found, key=lambda f: (f[0], -f[1])):
                    if a >= free and b <= len(text):
                        kept.append({"start": a, "end": b, "kind": kind, "term": text[a:b]})
                        free = b
                rows.append(kept)
            yield pd.Series(rows)

    return claims.withColumn("highlights", spans("sentence", "quantity", "baseline", "deadline"))


def assurance(pages: DataFrame) -> DataFrame:
    """doc, assured, quote, page, auditor, level, from (doc, page, page_text).

    The quote is the first page's first mention with what is around it; the
    level is limited where that is mentioned on any page, else reasonable,
    else unspecified; all null without a mention.
    """
    t = F.col("page_text")
    at = F.regexp_instr(t, F.lit(ASSURANCE))
    length = F.length(F.regexp_extract(t, ASSURANCE, 1))
    begin = F.greatest(F.lit(1), at - 40)
    quote = squeeze(F.substring(t, begin, at - begin + length + 80))
    auditor = F.nullif(F.regexp_extract(t, AUDITOR, 1), F.lit(""))
    first = F.min_by(F.when(at > 0, F.struct(quote.alias("quote"), F.col("page"), auditor.alias("auditor"))), F.when(at > 0, F.col("page")))
    out = pages.groupBy("doc").agg(first.alias("first"), F.bool_or(t.rlike(r"(?iu)\blimited\s+assurance\b")).alias("limited"), F.bool_or(t.rlike(r"(?iu)\breasonable\s+assurance\b")).alias("reasonable"))
    assured = F.col("first").isNotNull()
    level = F.when(assured, F.when(F.col("limited"), "limited").when(F.col("reasonable"), "reasonable").otherwise("unspecified"))
    return out.select("doc", assured.alias("assured"), "first.quote", "first.page", "first.auditor", level.alias("level"))
