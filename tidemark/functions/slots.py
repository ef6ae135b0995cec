"""What a sentence pins down: quantity, baseline, deadline, scope, strength, negation, kind."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import Lexicon
from .numbers import py_round
from .text import BEGIN, END, has_anywhere, has_prefix, has_whole, java, looks_like_sentence, navigational, squeeze

# ---- fixed patterns
YEAR = r"(?:19|20)\d{2}"
UNITS = r"(?:%|per ?cent|tCO2e|tCO₂e|tonnes?|metric tons?|MMT|MtCO2e|kg|GWh|MWh|kWh|million|billion|litres?|liters?|gallons?|m³|acres?|hectares?)"
QUANTITY = rf"(?iu)(?<![\p{{L}}\p{{N}}_.])(\d[\d,]*(?:\.\d+)?)\s*{UNITS}"
BARE = r"(?<![\p{L}\p{N}_.])(\d[\d,]*(?:\.\d+)?)(?![\p{L}\p{N}_.])"
PERCENT = r"(?iu)%|\bper ?cent\b"
LABELLED_BASELINE = rf"(?iu)({YEAR})\s+base\s?(?:line|year)"
BASELINE = rf"(?iu)(?:versus|vs\.?|compared (?:with|to)|against|from(?: a| our)?|relative to|on)\s+(?:an?\s+|our\s+|the\s+)?(?:\w+\s+){{0,2}}?({YEAR})(?:\s+(?:base ?line|base ?year))?"
DEADLINE = rf"(?iu)\b(?:by|before|no later than|ahead of|through(?:out)?|until)\s+(?:the\s+end\s+of\s+)?({YEAR})"
LEADING_YEAR = rf"^\s*({YEAR})\s*[:–-]"
NEGATION = r"(?iu)\bnot\b(?!\s+(?:only|just)\b)|\bn't\b|\bnever\b|\bno longer\b|\bunable to\b|\bfails?\s+to\b|\bfailed\s+to\b"
CONDITION = r"(?iu)\b(?:if|unless|provided that|subject to|contingent (?:on|upon)|conditional (?:on|upon)|assuming|as long as)\b"
NOT_A_CLAIM = r"(?iu)\b(?:sales|revenue|profit|profitability|shareholder|dividend|pandemic|dow jones|fashion transparency index|customer focus|cash flow|stores? per segment)\b"
PURPOSE_WORDS = ("target", "goal", "ambition", "commit", "pledge")
TIERS = ("firm", "hedged", "achievement")
#: Slots that count for each kind of claim.
APPLICABLE = {"target": ("quantity", "baseline", "deadline", "scope"), "achievement": ("quantity", "baseline", "scope"), "attribute": ("quantity", "scope"), "other": ("quantity", "scope")}


def _filled(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def quantity(s: Column) -> Column:
    """The first number with a unit that is no year; else the first number that is neither a year nor a scope's index; else ''."""
    with_unit = F.filter(
        F.arrays_zip(F.regexp_extract_all(s, F.lit(QUANTITY), 0).alias("all"), F.regexp_extract_all(s, F.lit(QUANTITY), 1).alias("n")),
        lambda m: ~F.replace(m["n"], F.lit(","), F.lit("")).rlike(rf"^{YEAR}$"),
    )
    scoped = s.rlike(r"(?iu)\bscope\s*[123]\b")
    bare = F.filter(F.regexp_extract_all(s, F.lit(BARE), 1), lambda n: ~n.rlike(rf"^{YEAR}$") & ~(F.replace(n, F.lit(","), F.lit("")).isin("1", "2", "3") & scoped))
    return F.coalesce(squeeze(F.get(with_unit, F.lit(0))["all"]), F.get(bare, F.lit(0)), F.lit(""))


def baseline(s: Column) -> Column:
    labelled = F.regexp_extract(s, LABELLED_BASELINE, 1)
    return F.when(labelled != "", labelled).otherwise(F.regexp_extract(s, BASELINE, 1))


def deadline(s: Column) -> Column:
    return F.regexp_extract(s, DEADLINE, 1)


def deadline_or_leading(deadline: Column, s: Column) -> Column:
    """A deadline, or the year that heads the sentence ("2030: ..."), or ''."""
    return F.when(_filled(deadline), deadline).otherwise(F.regexp_extract(s, LEADING_YEAR, 1))


def scope(s: Column, lexicon: Lexicon) -> Column:
    low = F.lower(s)
    labels = F.array(*(F.when(F.contains(low, F.lit(k)), F.lit(v)) for k, v in lexicon.scope_markers))
    return F.array_join(F.array_distinct(F.array_compact(labels)), "; ")


def strength(s: Column, lexicon: Lexicon) -> Column:
    """struct(tier, begin, end): the first term, in the lists' order, of the first tier with one; begin and end count from 0; null if none.

    One pattern for each tier finds the terms there are; only the winner's
    place is looked up.
    """
    low, found = F.lower(s), []
    for tier in TIERS:
        terms = lexicon.strength.get(tier, ())
        if not terms:
            continue
        patterns = F.array(*(F.lit(BEGIN + java(t) + END) for t in terms))
        names = F.array(*map(F.lit, terms))
        hits = F.regexp_extract_all(low, F.lit(BEGIN + "(?:" + "|".join(map(java, sorted(terms, key=len, reverse=True))) + ")" + END), 0)
        first = F.array_min(F.transform(hits, lambda h: F.array_position(names, h)))
        at = lambda k: F.regexp_instr(low, F.element_at(patterns, k)) - 1  # noqa: B023, E731
        best = F.transform(F.array(first.cast("int")), lambda k: F.struct(F.lit(tier).alias("tier"), at(k).alias("begin"), (at(k) + F.length(F.element_at(names, k))).alias("end")))  # noqa: B023
        found.append(F.when(F.size(hits) > 0, F.get(best, F.lit(0))))
    return F.coalesce(*found) if found else F.lit(None).cast("struct<tier:string,begin:int,end:int>")


def clause(s: Column, begin: Column, end: Column) -> Column:
    """The part of s between the marks , ; : . ! ? nearest to the span."""
    before = F.regexp_extract(F.substring(s, F.lit(1), begin), r"[^,;:.!?]*$", 0)
    after = F.regexp_extract(F.substring(s, end + 1, F.length(s)), r"^[^,;:.!?]*", 0)
    return F.concat(before, F.substring(s, begin + 1, end - begin), after)


def negated(s: Column, span: Column) -> Column:
    return F.coalesce(clause(s, span["begin"], span["end"]).rlike(NEGATION), F.lit(False))


def conditional(s: Column, span: Column) -> Column:
    """A condition in the span's clause or anywhere after the span."""
    rest = F.substring(s, span["end"] + 1, F.length(s))
    return F.coalesce(clause(s, span["begin"], span["end"]).rlike(CONDITION) | rest.rlike(CONDITION), F.lit(False))


def kind(s: Column, lexicon: Lexicon, deadline: Column, tier: Column, quantity: Column) -> Column:
    low = F.lower(s)
    target = _filled(deadline) | (tier.isin("firm", "hedged") & has_whole(low, PURPOSE_WORDS))
    return (
        F.when(F.coalesce(target, F.lit(False)), "target")
        .when((tier == "achievement") & _filled(quantity), "achievement")
        .when(has_anywhere(low, lexicon.attribute), "attribute")
        .otherwise("other")
    )


def slot_fill(kind: Column, **slots: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, applicable in APPLICABLE.items():
        n = sum((_filled(slots[a]).cast("int") for a in applicable), F.lit(0))
        out = F.when(kind == name, py_round(n / len(applicable), 2)).otherwise(out)
    return out


def candidate(s: Column, lexicon: Lexicon) -> Column:
    """An attribute; or a core topic with any digit or percent; or a weak topic with a number and unit or percent."""
    low = F.lower(s)
    measured = s.rlike(QUANTITY) | s.rlike(PERCENT)
    return has_prefix(low, lexicon.attribute) | (has_prefix(low, lexicon.core) & (measured | s.rlike(r"\d"))) | (has_prefix(low, lexicon.weak) & measured)


def material(s: Column, kind: Column, quantity: Column, lexicon: Lexicon) -> Column:
    other = _filled(quantity) & s.rlike(QUANTITY) & has_prefix(F.lower(s), lexicon.core) & ~s.rlike(NOT_A_CLAIM)
    return kind.isin("target", "achievement", "attribute") | other


def drop_reason(s: Column, lexicon: Lexicon, min_words: int = 5, max_chars: int = 400) -> Column:
    """Why a sentence is no candidate for a claim, cheap tests first; null if it is one."""
    n = F.size(F.filter(F.split(s, r"(?U)\s+", -1), lambda w: w != ""))
    return (
        F.when((n < min_words) | (F.length(s) > max_chars), "length")
        .when(~looks_like_sentence(s), "shape")
        .when(navigational(s), "navigational")
        .when(~candidate(s, lexicon), "no candidate")
    )


def with_slots(df, lexicon: Lexicon, sentence: str = "sentence"):
    """``df`` with quantity, baseline, deadline, scope, strength, negated, conditional, claim_type, slot_fill_score."""
    s = F.col(sentence)
    df = df.withColumn("_span", strength(s, lexicon))
    df = df.withColumns({"quantity": quantity(s), "baseline": baseline(s), "deadline": deadline(s), "scope": scope(s, lexicon), "strength": F.coalesce("_span.tier", F.lit("")), "negated": negated(s, F.col("_span")), "conditional": conditional(s, F.col("_span"))})
    df = df.withColumn("claim_type", kind(s, lexicon, F.col("deadline"), F.col("strength"), F.col("quantity")))
    return df.withColumn("slot_fill_score", slot_fill(F.col("claim_type"), **{n: F.col(n) for n in ("quantity", "baseline", "deadline", "scope")})).drop("_span")
