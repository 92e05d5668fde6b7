"""Quantities in different units into common ones (problem 2).

The sources of a quantity are the notations it arrives in: a unit word (``lb``, ``kilos``, ``mVolt``), a bare number under
a site's measure system, a count of steps per unit. Two notations are linked wherever one entity has values in both: one
patient's weights and heights, one device's lead amplitudes. From the links of a pair of notations comes a robust scale
(the median of log ratios over entities) and a robust offset (the median of what that scale leaves over); a scale whose
offset is not small beside the values themselves is not that of two units of one ratio scale, and its link is not used. The
scale is snapped to the nearest known conversion and carried from an anchor notation through the graph of links, best-supported
link first. A notation the graph does not reach, or whose scale fits no known conversion, falls back on the meaning its own text
declares; one that has neither is left out and reported.

Per entity and notation one value (the median) goes into the links, so a hot patient or device never yields all pairs of
its rows. The scales are as many as there are notations.

A bare number takes the unit that a note in its row names for it (``weight in pounds``), and only without one that of the
site's measure system.

Defined results: nulls, words and blank values give no amount; a lead whose unit appears nowhere in its row gives none;
repeated rows count once.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.common import blank, cut, local_if_small, need, settle

# Unit words and what they stand for, in grams, millimetres and nanovolts.
DECLARED = {
    "weight": {
        "kg": 1000.0, "kgs": 1000.0, "kilo": 1000.0, "kilos": 1000.0, "kilogram": 1000.0, "kilograms": 1000.0, "kilogramm": 1000.0, "кг": 1000.0,
        "g": 1.0, "gr": 1.0, "gm": 1.0, "gram": 1.0, "grams": 1.0, "gramm": 1.0, "lb": 453.59237, "lbs": 453.59237, "pound": 453.59237, "pounds": 453.59237,
        "#": 453.59237, "libras": 453.59237, "st": 6350.29318, "stone": 6350.29318, "stones": 6350.29318, "oz": 28.349523125,
        "bare:metric": 1000.0, "bare:imperial": 453.59237,
    },
    "height": {
        "cm": 10.0, "cms": 10.0, "centimetre": 10.0, "centimetres": 10.0, "centimeter": 10.0, "centimeters": 10.0, "см": 10.0, "mm": 1.0, "m": 1000.0,
        "mt": 1000.0, "mtr": 1000.0, "metre": 1000.0, "metres": 1000.0, "meter": 1000.0, "meters": 1000.0, "in": 25.4, "inch": 25.4, "inches": 25.4,
        '"': 25.4, "″": 25.4, "''": 25.4, "”": 25.4, "zoll": 25.4, "ft": 304.8, "feet": 304.8, "foot": 304.8, "'": 304.8, "′": 304.8, "’": 304.8,
        "bare:metric": 10.0, "bare:imperial": 25.4,
    },
    "sample_step": {
        "v": 1e9, "volt": 1e9, "volts": 1e9, "mv": 1e6, "mvolt": 1e6, "mvolts": 1e6, "millivolt": 1e6, "millivolts": 1e6, "uv": 1e3, "µv": 1e3, "μv": 1e3,
        "microv": 1e3, "microvolt": 1e3, "microvolts": 1e3, "uvolt": 1e3, "uvolts": 1e3, "nv": 1.0, "nvolt": 1.0, "nanov": 1.0, "nanovolt": 1.0, "nanovolts": 1.0, "pv": 1e-3,
    },
}
# The conversions a measured scale may be snapped to.
KNOWN = {
    "weight": [1.0, 28.349523125, 453.59237, 1000.0, 6350.29318],
    "height": [1.0, 10.0, 25.4, 304.8, 1000.0],
    "sample_step": [1.0, 1e3, 1e6, 1e9],
}
ANCHOR = {"weight": "kg", "height": "cm", "sample_step": "mv"}
#: How far a measured scale may lie from a known one, as a factor.
TOLERANCE = {"weight": 1.12, "height": 1.08, "sample_step": 4.0}
#: How large a link's offset may be, as a share of the usual value.
OFFSET_SHARE = 0.25
#: Entities that must link two notations before their scale is trusted.
MIN_LINKS = 5
#: Notations up to which the scales are broadcast.
NOTATION_BOUND = 10_000

_COUNT_WORDS = "units?|counts?|lsbs?|adus?|bits?|steps?|digits?|1"


def _number(c: Column) -> Column:
    return F.when(c != "", F.regexp_replace(c, ",", ".").cast("double"))


def split_quantity(text: Column, system: Column) -> tuple[Column, Column]:
    """(number, notation) of a typed weight or height; compound notations count in their larger unit."""
    s = F.lower(F.trim(F.regexp_replace(text, "[\\u00a0\\s]+", " ")))
    double = r"^(\d{1,3}) ?(st|stones?|ft|feet|foot|'|′|’)\.? ?(\d{1,2}(?:[.,]\d+)?) ?(lbs?|pounds?|in|inch|inches|\"|″|”|'')?\.?$"
    single = r"^(\d+(?:[.,]\d+)?) ?([^\d\s]*)$"
    parts = F.when(F.regexp_extract(s, double, 2).rlike("^st"), 14.0).otherwise(12.0)
    two = s.rlike(double)
    value = F.when(two, _number(F.regexp_extract(s, double, 1)) + _number(F.regexp_extract(s, double, 3)) / parts).otherwise(_number(F.regexp_extract(s, single, 1)))
    word = F.when(two, F.regexp_extract(s, double, 2)).otherwise(F.regexp_replace(F.regexp_extract(s, single, 2), r"\.$", ""))
    return value, F.when(value.isNotNull(), F.when(word == "", F.concat(F.lit("bare:"), system)).otherwise(word))


#: Unit words that a note may hold, and how the last of them stands in one of its parts.
NOTED = {q: sorted(w for w in DECLARED[q] if re.fullmatch(r"[^\W\d_]{2,}", w) and w != "in") for q in ("weight", "height")}
NOTED_PATTERN = r"^(?:.*[^\p{L}])?(" + "|".join(sorted({w for ws in NOTED.values() for w in ws}, key=lambda w: (-len(w), w))) + r")(?:[^\p{L}].*)?$"

NOTED_INCHES = r"[^\p{L}]in\s*$"


def noted_unit(annotations: Column, quantity: Column) -> Column:
    """The unit word that the notes of a row name for a quantity, or null: of each part of a note the last unit word counts.

    ``in`` is a unit only at the end of a part.
    """
    parts = F.split(F.lower(F.array_join(F.map_values(annotations), " ; ")), "[;|]")
    words = F.transform(parts, lambda x: F.regexp_extract(F.regexp_replace(x, NOTED_INCHES, " inches"), NOTED_PATTERN, 1))
    own = F.when(quantity == "weight", F.array(*map(F.lit, NOTED["weight"]))).otherwise(F.array(*map(F.lit, NOTED["height"])))
    return F.get(F.filter(words, lambda w: F.array_contains(own, w)), F.lit(0))


def body_values(records: DataFrame, sites: DataFrame) -> DataFrame:
    """record_id, entity (patient), quantity, notation and number x of each weight and height."""
    notes = ["annotations"] if "annotations" in records.columns else []
    r = need(records, "record_id", "site_id", "patient", *notes).select(
        "record_id", "site_id", *notes, F.col("patient.patient_id").alias("entity"),
        F.inline(F.array(*[F.struct(F.lit(q).alias("quantity"), F.col(f"patient.{q}").alias("text")) for q in ("weight", "height")])),
    ).where(~blank(F.col("text")))
    s = local_if_small(need(sites, "site_id", "measure_system").dropDuplicates(["site_id"]), 100_000)
    df = r.join(s, "site_id", "left")
    x, notation = split_quantity(F.col("text"), F.col("measure_system"))
    noted = noted_unit(F.col("annotations"), F.col("quantity")) if notes else F.lit(None).cast("string")
    bare = F.col("text").rlike(r"^[\u00a0\s]*\d+(?:[.,]\d+)?[\u00a0\s]*$")
    notation = F.when(bare, F.coalesce(noted, notation)).otherwise(notation)
    return settle(df.select("record_id", "entity", "quantity", x.alias("x"), notation.alias("notation"))).where("notation IS NOT NULL AND x > 0")


def _unit_text(c: Column) -> Column:
    """Unit text without case, blanks, dashes and a trailing ``per count``."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), r"[\s\-_.\u00a0]+", ""), "[µμ]", "u")
    return F.regexp_replace(s, rf"(/|per)({_COUNT_WORDS})$", "")


def _unit_word(c: Column) -> Column:
    """A cleaned unit text if it is one word that can name a unit, else null."""
    return F.when(c.rlike(r"^(?!(?:na|arb|none|null|unknown|au)$)\p{L}{1,12}$"), c)


def lead_values(leads: DataFrame, amplitude: bool = False, extra: tuple[str, ...] = (), unknown: bool = False) -> DataFrame:
    """record_id, lead_no, entity (device), notation, and x so that one sample step is x times the notation's scale.

    ``inverse`` notations (counts per millivolt) have x as the inverse of the resolution. With ``amplitude``, also the
    lead's span of samples. ``extra`` columns are passed through; with ``unknown``, leads without any unit stay, with a
    null notation.
    """
    cols = ["record_id", "lead_no", "serial_number", "is_raw", "resolution", "resolution_unit", "units", "adc_resolution", "adc_resolution_unit", "annotations"]
    df = need(leads, *cols, *(["samples"] if amplitude and "samples" not in extra else []), *extra)
    notes = F.lower(F.array_join(F.map_values("annotations"), " | "))
    noted = F.regexp_extract(notes, r"(?<!\p{L})((?:nano|micro|milli)?[ -]?volts?|[nuµμm]v)(?!\p{L})", 1)
    df = settle(df.withColumns({
        "_raw": F.coalesce(F.col("is_raw"), blank(F.col("units"))), "_res": _unit_text(F.col("resolution_unit")), "_unit": _unit_text(F.col("units")),
        "_adc": _unit_text(F.col("adc_resolution_unit")), "_note": _unit_text(noted),
        "_r": F.when(F.col("resolution") > 0, F.col("resolution")), "_a": F.when(F.col("adc_resolution") > 0, F.col("adc_resolution")),
    }))
    per = F.regexp_extract("_res", rf"^(?:{_COUNT_WORDS})(?:/|per)(\p{{L}}+)$", 1)
    df = settle(df.withColumns({"_per": F.when(per != "", per), **{w: _unit_word(F.col(w)) for w in ("_res", "_unit", "_adc", "_note")}}))
    pair = lambda x, w, inv=False: F.when(F.col(w).isNotNull() & x.isNotNull(), F.struct(x.alias("x"), F.col(w).alias("notation"), F.lit(inv).alias("inverse")))
    one = F.lit(1.0)
    r, a = F.col("_r"), F.col("_a")
    choice = F.when(
        F.col("_raw"), F.coalesce(pair(1 / r, "_per", True), pair(r, "_res"), pair(a, "_adc"), pair(r, "_note"), pair(r, "_unit"))
    ).otherwise(F.coalesce(pair(one, "_unit"), pair(one, "_res"), pair(one, "_note")))
    keep = ["record_id", "lead_no", F.col("serial_number").alias("entity"), F.lit("sample_step").alias("quantity")]
    if amplitude:
        keep.append((F.array_max("samples") - F.array_min("samples")).alias("span"))
    if unknown:
        choice = F.coalesce(choice, F.struct(F.when(F.col("_raw"), F.coalesce(r, one)).otherwise(one).alias("x"), F.lit(None).cast("string").alias("notation"), F.lit(False).alias("inverse")))
    df = settle(df.withColumn("_choice", choice)).where("_choice IS NOT NULL")
    return df.select(*keep, *extra, "_choice.x", "_choice.notation", "_choice.inverse")


def lead_scales(leads: DataFrame) -> DataFrame:
    """(notation, scale) of the notations of lead samples, linked through the devices."""
    spans = lead_values(leads, amplitude=True).where("span > 0 AND span < double('Infinity')")
    scales = notation_scales(spans.select("quantity", "entity", "notation", (F.col("x") * F.col("span")).alias("x")))
    return local_if_small(scales.select("notation", "scale"), NOTATION_BOUND)


def representatives(values: DataFrame) -> DataFrame:
    """(quantity, entity, notation, v, n): the median log value and the number of values of an entity in a notation."""
    return values.groupBy("quantity", "entity", "notation").agg(F.percentile_approx(F.log("x"), 0.5, 200).alias("v"), F.count("*").alias("n"))


def pairwise_links(rep: DataFrame) -> DataFrame:
    """(quantity, a, b, links, log_ratio, offset): the robust scale and offset between two notations, over the entities with both.

    Medians are taken twice: within entity and notation, and over entities. The offset is the median of x_a less what the
    line of slope exp(log_ratio) through the middle of the values makes of x_b, as a share of the usual x_a: nil for two units
    of one ratio scale, and not for such as degrees of different zero. Its slope is that between the entities' lower and upper
    quartiles. Notations of an entity are few (they are a vocabulary), so its pairs are few whatever the number of its rows.
    """
    per = rep.where("entity IS NOT NULL").groupBy("quantity", "entity").agg(F.array_sort(F.collect_list(F.struct("notation", "v"))).alias("all")).where(F.size("all") > 1)
    pairs = per.select("quantity", F.explode("all").alias("p"), "all").select("quantity", "p", F.explode("all").alias("q")).where("p.notation < q.notation")
    quart = lambda c: F.percentile_approx(F.exp(c), [0.25, 0.5, 0.75], 1000)
    links = pairs.groupBy("quantity", F.col("p.notation").alias("a"), F.col("q.notation").alias("b")).agg(
        F.count("*").alias("links"), F.percentile_approx(F.col("p.v") - F.col("q.v"), 0.5, 1000).alias("log_ratio"), quart(F.col("p.v")).alias("_a"), quart(F.col("q.v")).alias("_b")
    )
    # a line through the quartiles cuts the axis at the offset; where the values hardly differ there is none to be seen
    spread_b, spread_a = F.col("_b")[2] - F.col("_b")[0], F.col("_a")[2] - F.col("_a")[0]
    cut_at = (F.col("_a")[1] - F.try_divide(spread_a, spread_b) * F.col("_b")[1]) / F.col("_a")[1]
    return links.select("quantity", "a", "b", "links", "log_ratio", F.when((spread_b > 0.2 * F.col("_b")[1]) & (spread_a > 0.2 * F.col("_a")[1]), cut_at).otherwise(0.0).alias("offset"))


def propagate(links: pd.DataFrame, quantity: str) -> dict[str, float]:
    """Scales of the notations of one quantity, from its anchor along the best-supported links, each snapped."""
    known = KNOWN[quantity]
    scale = {ANCHOR[quantity]: DECLARED[quantity][ANCHOR[quantity]]}
    rows = links[["a", "b", "links", "log_ratio", "offset"]].itertuples(index=False)
    # a scale of few links may look set off by chance: the bound is wider by what quartiles of so few values vary
    edges = sorted(((int(n), a, b, float(x)) for a, b, n, x, o in rows if n >= MIN_LINKS and x == x and not abs(o) > OFFSET_SHARE + 3 / math.sqrt(n)), reverse=True)
    grown = True
    while grown:
        grown = False
        for _, a, b, x in edges:
            # an entity has x_a * scale_a = x_b * scale_b, so log scale_b = log scale_a + (log x_a - log x_b)
            for here, there, step in ((a, b, x), (b, a, -x)):
                if here in scale and there not in scale:
                    rough = math.log(scale[here]) + step
                    best = min(known, key=lambda k: abs(math.log(k) - rough))
                    if abs(math.log(best) - rough) <= math.log(TOLERANCE[quantity]):
                        scale[there] = best
                        grown = True
            if grown:
                break
    return scale


def notation_scales(values: DataFrame) -> DataFrame:
    """(quantity, notation, scale, measured, declared): what one of each notation is in grams, millimetres or nanovolts.

    ``values``: quantity, entity, notation, x. Every notation is listed, also one without a scale.
    """
    rep = cut(representatives(values))  # the one pass over the values; what follows is as small as entities times notations
    seen = rep.groupBy("quantity", "notation").agg(F.sum("n").alias("n"))

    def run(key: tuple, links: pd.DataFrame) -> pd.DataFrame:
        found = propagate(links, key[0])
        return pd.DataFrame({"quantity": key[0], "notation": list(found), "measured": list(found.values())})

    measured = pairwise_links(rep).groupBy("quantity").applyInPandas(lambda key, g: run(key, g), "quantity string, notation string, measured double")
    declared = values.sparkSession.createDataFrame([(q, w.replace("µ", "u").replace("μ", "u") if q == "sample_step" else w, v) for q, ws in DECLARED.items() for w, v in ws.items()], "quantity string, notation string, declared double").dropDuplicates(["quantity", "notation"])
    out = seen.join(measured, ["quantity", "notation"], "left").join(declared, ["quantity", "notation"], "left")
    return out.withColumn("scale", F.coalesce("measured", "declared"))


def common_units(records: DataFrame, leads: DataFrame, sites: DataFrame) -> DataFrame:
    """(record_id, lead_no, quantity, amount): grams, millimetres and nanovolts per sample step, rounded half up."""
    body = body_values(records, sites)
    spans = lead_values(leads, amplitude=True).where("span > 0 AND span < double('Infinity')")
    links = body.select("quantity", "entity", "notation", "x").unionByName(spans.select("quantity", "entity", "notation", (F.col("x") * F.col("span")).alias("x")))
    scales = local_if_small(notation_scales(links).select("quantity", "notation", "scale"), NOTATION_BOUND)
    # a notation met only in rows without an entity has no link and no entry; its own text declares it
    declared = F.lit(None).cast("double")
    for q, words in DECLARED.items():
        entries = [y for w, v in words.items() for y in (F.lit(w.replace("µ", "u").replace("μ", "u") if q == "sample_step" else w), F.lit(v))]
        keys = dict(zip([w.replace("µ", "u").replace("μ", "u") if q == "sample_step" else w for w in words], words.values(), strict=True))
        entries = [y for w, v in keys.items() for y in (F.lit(w), F.lit(v))]
        declared = F.when(F.col("quantity") == q, F.try_element_at(F.create_map(*entries), F.col("notation"))).otherwise(declared)
    steps = lead_values(leads).select("record_id", "lead_no", "quantity", "notation", "x")
    both = body.select("record_id", F.lit(-1).alias("lead_no"), "quantity", "notation", "x").unionByName(steps)
    amount = F.round(F.round(F.col("x") * F.coalesce("scale", declared), 6)).cast("long")
    return (
        both.join(scales, ["quantity", "notation"], "left")
        .select("record_id", F.col("lead_no").cast("long").alias("lead_no"), "quantity", amount.alias("amount"))
        .where("amount IS NOT NULL")
        .distinct()
    )
