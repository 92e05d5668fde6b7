"""Variant spellings of one person or institution (problem 4).

Names become points of a metric space, and one exact radius join in it (:func:`pulsegrid.llm.metrics.radius_join`: pivots,
border names copied by the triangle inequality, cells split by size) finds what may belong together; then the pairs are
checked exactly and entities are connected components.

A person's point is the bag of the name's two words as they sound, with a number: D = edits between the words in either order
+ days between the birth dates. So a birth date is evidence within the metric, not a key: a patient lies near those of like
name born about the same day. A patient without one has a second kind of point, the name at each site it was met at, with
the year of birth by the age at recording as its number, and is joined there with all patients of the site, dated or not. Of a name
that is not whole (an initial, a part missing) the one whole part is the point. An institution's point is the bag of all its
words, in several forms: as written, with short forms in full, shortened, with two words run together, and as an acronym
with its town.

Checks: swapped neighbours count as one slip, a lost letter (``?``) as any, nicknames equal their full names, an initial
equals a name it begins. A partial name never joins two entities: it goes to the one it fits, to the one met at most of its
sites if several fit, and to none if that is a tie; partial names that fit none but each other form an entity.

Defined results: null and blank names are no keys; one key is linked at most to one entity; an entity of one key gives no
pair; a patient without a birth date is linked only within a site, by an age that agrees, and by a name of two parts; one
without either is linked to none; repeated rows count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.common import blank, cut, need, plain_letters
from pulsegrid.llm.metrics import BAGS, Memo, components, radius_join, unmatched

# Nicknames and the names they stand for.
NICKNAMES = {
    w: full
    for full, words in {
        "margaret": "maggie peggy meg marge madge greta", "elizabeth": "liz lizzie beth betty eliza bess", "katherine": "kate kathy katie kat catherine", "james": "jim jimmy jamie",
        "andrew": "andy drew", "william": "bill billy will willy", "richard": "dick rick rich ricky", "edward": "ted ed eddie ned", "robert": "bob rob bobby robbie", "michael": "mike mick mickey",
        "joseph": "joe joey", "thomas": "tom tommy", "samuel": "sam sammy", "susan": "sue susie suzy", "patricia": "pat patty tricia trish", "victoria": "vicky vicki tori", "john": "jack johnny",
        "charles": "charlie chuck", "francisco": "paco pancho curro", "jose": "pepe", "concepcion": "concha conchi", "dolores": "lola", "maria": "mary", "ignacio": "nacho", "johannes": "hans hannes", "friedrich": "fritz fiete",
        "matthias": "matze", "wolfgang": "wolf wolfi", "alexander": "alex sasha", "benjamin": "ben", "christopher": "chris", "daniel": "dan danny", "david": "dave", "deborah": "deb debbie", "dorothy": "dot dottie",
        "eleanor": "nell ellie", "frederick": "fred freddy", "george": "georgie", "gerald": "gerry", "henry": "harry hank", "helen": "nellie", "jennifer": "jen jenny", "jessica": "jess", "judith": "judy",
        "lawrence": "larry", "leonard": "len lenny", "matthew": "matt", "nicholas": "nick", "peter": "pete", "philip": "phil", "rebecca": "becky", "ronald": "ron", "stephen": "steve", "theodore": "theo",
        "timothy": "tim", "walter": "walt", "zachary": "zach", "jesus": "chus chuy", "monica": "moni", "nicolas": "nico", "sofia": "sofi", "lucia": "luci", "ramon": "moncho", "begona": "bego", "angel": "angelito",
        "malgorzata": "gosia malgosia", "stanislaw": "staszek stas", "elzbieta": "ela elka", "bozena": "bozenka", "danuta": "danka danusia", "jedrzej": "jedrek", "pawel": "pawelek", "grazyna": "grazynka", "lukasz": "lukaszek",
        "miroslaw": "mirek", "wojciech": "wojtek", "katarzyna": "kasia", "barbara": "basia", "krzysztof": "krzysiek", "tomasz": "tomek", "ursula": "uschi ulla", "jurgen": "jogi", "annegret": "anne", "gerard": "gege", "etienne": "tienne",
        "benoit": "benny", "francoise": "fanfan", "natalya": "natasha nata", "fedor": "fedya", "anna": "anya", "olga": "olya", "sergei": "seryozha serezha", "petr": "petya", "dmitrii": "dima mitya", "yurii": "yura", "galina": "galya",
        "irina": "ira", "lev": "leva lyova",
    }.items()
    for w in words.split()
}
# Titles and what else is no part of a name.
TITLES = set("dr med prof professor doctor md phd dipl msc bsc frcp mr mrs ms miss herr frau sr sra dra mme mlle pan pani".split())
# Cyrillic letters and the Latin ones for them.
CYRILLIC = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e e zh z i y k l m n o p r s t u f kh ts ch sh shch  y  e yu ya".split(" "), strict=True))
# Short forms in names of institutions.
SHORT = {
    w: full
    for full, words in {
        "hospital": "hosp hospitl", "regional": "reg regl", "centre": "ctr center cntr cent", "medical": "med", "clinic": "clin", "institute": "inst institut", "community": "comm commun", "university": "uni univ",
        "department": "dept", "general": "gen", "saint": "st ste", "cardiology": "cardiol card", "heart": "hrt", "memorial": "mem", "national": "natl", "children": "child childrens", "laboratory": "lab labs",
    }.items()
    for w in words.split()
}
SHORTENED: dict[str, list[str]] = {}
for _short, _full in SHORT.items():
    SHORTENED.setdefault(_full, []).append(_short)
#: Words of an institution's name that do not tell it from others.
DROPPED = set("the of and de la le du del der die das for at in saint laboratory ecg ekg".split())

PATIENT, INTERPRETER, INSTITUTION = "patient", "interpreter", "institution"
#: Edits within which points are compared. A slip may be a swap of neighbours, which is two edits; both spellings may have one.
RADIUS = {PATIENT: 4, INTERPRETER: 2, INSTITUTION: 2}
#: Years by which the time of birth taken from an age in whole years may be off.
AGE_YEARS = 0.6
SEP = "\u0001"
SITE = "site" + SEP


def repaired(text: str) -> str:
    """The text with a plain wrong decoding undone, so that spoilt names still meet their own kind."""
    for _ in range(2):
        for wrong in ("cp1252", "latin-1", "mac_roman", "cp437"):
            try:
                better = text.encode(wrong).decode("utf-8")
            except UnicodeError:
                continue
            if better != text:
                text = better
                break
        else:
            break
    return text


def fold(text: str) -> str:
    """Lower-case plain letters; Cyrillic becomes Latin, lost letters question marks."""
    t = plain_letters(" ".join(repaired(w) for w in text.split(" "))).lower().replace("\ufffd", "?")
    return "".join(CYRILLIC.get(c, c) for c in t)


# Spellings that sound alike, in order of replacement.
SOUNDS = [(re.compile(a), b) for a, b in (("ck|c", "k"), ("ph", "f"), ("th", "t"), ("w", "v"), ("y", "i"), (r"([a-z])\1+", r"\1"))]


@Memo
def forms(part: str) -> tuple[str, str, str]:
    """A part as it stands; with the two-letter spellings of umlauts shortened; and as it sounds."""
    short = heard = re.sub(r"([aou])e", r"\1", part)
    for pattern, by in SOUNDS:
        heard = pattern.sub(by, heard)
    return part, short, heard


@Memo
def person_parts(text: str) -> list[str]:
    """Folded name parts without titles, nicknames in full; a hyphenated name is one part. Of three parts or more the ends."""
    parts = [re.sub(r"[^a-z?]", "", p) for p in re.split(r"[\s,.;/]+", fold(text))]
    parts = [NICKNAMES.get(p, p) for p in parts if p and p not in TITLES]
    return parts if len(parts) < 3 else [parts[0], parts[-1]]


def whole(part: str) -> bool:
    """More than an initial, and not mostly lost."""
    return len(part) > 2 and 2 * part.count("?") < len(part)


@Memo
def slips(a: str, b: str, most: int) -> int:
    """Edits between two parts, swapped neighbours as one, lost letters as none; beyond ``most`` any larger number."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    prev2, prev = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (x != y and "?" not in (x, y)))
            if prev2 is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, prev2[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        prev2, prev = prev, row
    return prev[-1]


@Memo
def near(a: str, b: str, each: int) -> bool:
    """Whether two parts are one in one of their forms: so many slips at most, and one where a part is short."""
    most = min(each, 1 if min(len(a), len(b)) <= 6 else each)
    return any(slips(x, y, most) <= most for x, y in zip(forms(a), forms(b), strict=True))


def same_full(p: list[str], q: list[str], each: int) -> bool:
    """Two whole names (two parts, in any order) of one person."""
    return (near(p[0], q[0], each) and near(p[1], q[1], each)) or (near(p[0], q[1], each) and near(p[1], q[0], each))


def fits_partial(partial: list[str], full: list[str], each: int) -> bool:
    """Whether a partial name (one whole part, with an initial or nothing) fits one of two parts."""
    long, rest = [x for x in partial if whole(x)], [x for x in partial if not whole(x)]
    if len(long) != 1 or len(full) != 2:
        return False
    starts = lambda x: not rest or "?" in rest[0] or x[:1] == rest[0][0] or forms(x)[2][:1] == forms(rest[0])[2][:1]
    return any(near(long[0], s, each) and starts(g) for s, g in ((full[0], full[1]), (full[1], full[0])))


def same_partial(p: list[str], q: list[str], each: int) -> bool:
    """Two partial names that may stand for one: their whole parts are one, and no initials contradict each other."""
    (x, i), (y, j) = (([w for w in n if whole(w)], [w for w in n if not whole(w)]) for n in (p, q))
    return len(x) == len(y) == 1 and near(x[0], y[0], each) and (not i or not j or "?" in i[0] + j[0] or i[0][0] == j[0][0])


def _keyed(names: DataFrame) -> DataFrame:
    """(field, id, parts, full, day, born, sites, names) of (field, id, text, ..) whose names have a whole part; ``names`` are its forms."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = [person_parts(t) for t in b.text]
            full = [len(p) == 2 and whole(p[0]) and whole(p[1]) for p in parts]
            names = [[list(x) for x in dict.fromkeys(zip(*map(forms, p), strict=True))] for p in parts]
            b = b.drop(columns="text").assign(parts=parts, full=full, names=names)
            yield b[[any(map(whole, p)) for p in parts]]

    return names.mapInPandas(run, "field string, id string, day int, born double, sites array<struct<site:string,n:long>>, parts array<string>, full boolean, names array<array<string>>")


def person_points(keyed: DataFrame) -> DataFrame:
    """Points of the radius join, and with each the person (field and id) as payload.

    Spaces: whole names, and parts of names, each among the dated patients, at one site, and among the interpreters. Whole
    names ask for whole names; partial ones ask for parts.
    """
    k = keyed.withColumn("who", F.concat_ws(SEP, "field", "id"))
    dated = F.col("day").isNotNull()
    at_site = F.transform("sites", lambda s: F.struct(F.concat(F.lit(SITE), s["site"]).alias("space"), F.round("born").cast("int").alias("num"), (~dated).alias("asks")))
    at_site = F.when(F.col("born").isNotNull(), at_site).otherwise(F.array())
    spaces = (
        F.when(F.col("field") == INTERPRETER, F.array(F.struct(F.lit("readers").alias("space"), F.lit(0).alias("num"), F.lit(True).alias("asks"))))
        .when(dated, F.concat(F.array(F.struct(F.lit("born").alias("space"), F.col("day").alias("num"), F.lit(True).alias("asks"))), at_site))
        .otherwise(at_site)
    )
    k = k.select("field", "names", "full", "who", F.inline(spaces))
    point = lambda a, b: F.struct(a.alias("p1"), b.alias("p2"), F.col("num").alias("num"))
    names = k.where("full").select(F.concat(F.lit("name" + SEP), "space").alias("space"), "field", "num", F.explode("names").alias("w"), "asks", "who")
    names = names.select("space", "field", point(F.col("w")[0], F.col("w")[1]).alias("point"), "asks", "who")
    parts = k.select(F.concat(F.lit("part" + SEP), "space").alias("space"), "field", "num", F.explode(F.array_distinct(F.flatten("names"))).alias("part"), (F.col("asks") & ~F.col("full")).alias("asks"), "who")
    parts = parts.where("length(part) > 2").select("space", "field", point(F.col("part"), F.lit("")).alias("point"), "asks", "who")
    # two ages in whole years that agree give years of birth at most two apart
    radius = F.when(F.col("field") == INTERPRETER, RADIUS[INTERPRETER]).otherwise(RADIUS[PATIENT] + F.when(F.col("space").contains(SITE), 2).otherwise(0))
    return names.union(parts).select("space", radius.alias("radius"), "point", F.col("asks").alias("home"), "who")


def checked_edges(pairs: DataFrame, keyed: DataFrame) -> DataFrame:
    """(kind, a, b, weight) of the pairs (who_a, who_b) of the persons in ``keyed`` that pass the exact test; kind is ``same`` or ``part`` (a is partial or undated, and b is not).

    ``weight`` counts how often both were met at the same sites.
    """

    def edge(x: dict, y: dict) -> str | None:
        each, less = 1, False
        if x["field"] == PATIENT:
            less = x["day"] is None and y["day"] is not None
            if not less and x["day"] != y["day"]:
                return None
            if x["day"] is not None:
                each = 2
            elif x["born"] is None or y["born"] is None or abs(x["born"] - y["born"]) > AGE_YEARS * (1 if less else 2) or len(x["parts"]) < 2 or len(y["parts"]) < 2:
                return None
        p, q = x["parts"], y["parts"]
        if x["full"] and y["full"]:
            return ("part" if less else "same") if same_full(p, q, each) else None
        if not x["full"] and not y["full"]:
            return "same" if not less and same_partial(p, q, each) else None
        return "part" if not x["full"] and fits_partial(p, q, each) else None

    def met(x: dict, y: dict) -> int:
        there = {s["site"]: s["n"] for s in y["sites"]}
        return int(sum(s["n"] * there.get(s["site"], 0) for s in x["sites"]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for x, y in zip(b.who_a, b.who_b, strict=True):
                x, y = ({**w, "day": None if pd.isna(w["day"]) else w["day"], "born": None if pd.isna(w["born"]) else w["born"], "parts": list(w["parts"])} for w in (x, y))
                weight = met(x, y)
                # a given name alone, even with a birth date, is shared by many
                if x["field"] == PATIENT and not weight and len(x["parts"]) + len(y["parts"]) < 4:
                    continue
                if kind := edge(x, y):
                    rows.append((kind, x["field"] + SEP + x["id"], y["field"] + SEP + y["id"], weight))
            yield pd.DataFrame(rows, columns=["kind", "a", "b", "weight"])

    person = keyed.select(F.concat_ws(SEP, "field", "id").alias("who"), F.struct("field", "id", "parts", "full", "day", "born", "sites").alias("p"))
    pairs = pairs.select("who_a", "who_b").distinct()
    pairs = pairs.join(person.select(F.col("who").alias("who_a"), F.col("p").alias("a")), "who_a").join(person.select(F.col("who").alias("who_b"), F.col("p").alias("b")), "who_b")
    return pairs.select(F.col("a").alias("who_a"), F.col("b").alias("who_b")).mapInPandas(run, "kind string, a string, b string, weight long")


def _bare(text: str) -> str:
    """An institution's name without what follows a spaced dash (a department)."""
    return re.sub(r" [-\u2013] .*$", "", text)


def _raw_words(text: str) -> list[str]:
    """Words of an institution's name as typed, folded; acronyms with a tilde."""
    t = _bare(text)
    acronyms = {fold(a) for a in re.findall(r"(?<!\w)[^\W\d_]{3,8}(?!\w)", t) if a.isupper()} if any(c.islower() for c in t) else set()
    return [w + "~" if w in acronyms else w for w in re.findall(r"[a-z?]+", re.sub(r"['\u2019]", "", fold(t)))]


def institution_forms(text: str) -> tuple[list[str], list[str], bool]:
    """(forms it asks with, forms it answers to, whether it holds an acronym), each a bag of words in one text.

    It asks as typed and in full; it also answers to each way of shortening its words, to two words run together and to its
    acronym with the one or two words that may be its town.
    """
    raw = _raw_words(text)
    kept = [w for w in raw if SHORT.get(w, w) not in DROPPED]
    full = [SHORT.get(w, w) for w in kept]
    bag = lambda ws: " ".join(sorted(ws))
    if any("~" in w for w in raw):
        return [bag(kept)], [bag(kept)], True
    asks = {bag(kept), bag(full)}
    ways = [[""]]
    for w in full:
        ways = [[*way, x] for way in ways for x in (w, *SHORTENED.get(w, ()))]
    answers = asks | {bag(way) for way in ways}
    for words in {tuple(kept), tuple(full)}:
        answers |= {bag((*words[:k], words[k] + words[k + 1], *words[k + 2 :])) for k in range(len(words) - 1)}
    letters = "".join(w[0] for w in raw if w not in {"the", "of"})
    if len(letters) > 2:
        towns = {tuple(full[:1]), tuple(full[:2]), tuple(full[-1:]), tuple(full[-2:])}
        answers |= {bag((letters + "~", *town)) for town in towns}
    return sorted(x.strip() for x in asks), sorted(x.strip() for x in answers), False


def one_word_off(a: str, b: str) -> bool:
    """Two bags of words that are equal but for one slip in one word; acronyms must be equal."""
    x, y = unmatched(a.split(), b.split())
    if not x and not y:
        return True
    return len(x) == len(y) == 1 and "~" not in x[0] + y[0] and slips(x[0], y[0], 1) <= 1 and max(len(x[0]), len(y[0])) > 2


def institution_edges(spellings: DataFrame) -> DataFrame:
    """(kind, a, b, weight) of the institutions' spellings (id, sites), as :func:`checked_edges` gives them for persons.

    The points are the distinct forms, so one shared by many spellings is one point.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i in b.id:
                asks, answers, acronym = institution_forms(i)
                rows += [(i, f, True, acronym) for f in asks] + [(i, f, False, acronym) for f in answers if f not in asks]
            yield pd.DataFrame(rows, columns=["id", "form", "asks", "acronym"])

    forms = cut(spellings.select("id").mapInPandas(run, "id string, form string, asks boolean, acronym boolean"))
    points = forms.groupBy("form").agg(F.max("asks").alias("home")).select(F.lit(INSTITUTION).alias("space"), F.lit(RADIUS[INSTITUTION]).alias("radius"), F.col("form").alias("point"), "home", F.col("form").alias("who"))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[[one_word_off(x, y) for x, y in zip(b.a, b.b, strict=True)]]

    close = radius_join(points, BAGS).select("a", "b").mapInPandas(check, "a string, b string")
    close = close.union(points.where("home").select(F.col("point").alias("a"), F.col("point").alias("b")))
    own = forms.join(spellings, "id")
    a = own.where("asks").select(F.col("form").alias("a"), F.col("id").alias("id_a"), F.col("acronym").alias("short_a"), F.col("sites").alias("sites_a"))
    b = own.select(F.col("form").alias("b"), F.col("id").alias("id_b"), F.col("acronym").alias("short_b"), F.col("sites").alias("sites_b"))
    met = F.aggregate(
        F.transform("sites_a", lambda s: F.coalesce(F.filter("sites_b", lambda t: t["site"] == s["site"])[0]["n"] * s["n"], F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda x, y: x + y
    )
    pairs = close.join(a, "a").join(b, "b").where("id_a <> id_b AND (short_a OR NOT short_b)")
    kind = F.when(F.col("short_a") & ~F.col("short_b"), "part").otherwise("same")
    name = lambda c: F.concat(F.lit(INSTITUTION + SEP), c)
    return pairs.select(kind.alias("kind"), name(F.col("id_a")).alias("a"), name(F.col("id_b")).alias("b"), met.alias("weight")).groupBy("kind", "a", "b").agg(F.max("weight").alias("weight"))


def _sites(df: DataFrame, *keys: str) -> DataFrame:
    """The keys with the sites they were met at and how often; as many entries as there are such sites."""
    counts = df.groupBy(*keys, "site").agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("site").isNotNull(), F.struct("site", "n")))).alias("sites"))


def _tidy(c: str) -> Column:
    """How little a name looks spoilt: 2 for letters only, 1 for anything else that is not blank, 0."""
    return F.when(blank(F.col(c)), 0).when(F.col(c).rlike(r"^[\p{L} .'\u2019\-]+$") & ~F.col(c).rlike("[\u00c2\u00c3\u00d0\u00d1][^a-z ]"), 2).otherwise(1)


def patient_names(records: DataFrame, moments: DataFrame) -> DataFrame:
    """(field, id, text, day, born, sites) of the patients: what each id is called at its tidiest, and when it was born.

    ``records``: record_id, patient_id, first_name, last_name, age, site. ``moments``: record_id, field_name, epoch_s. ``born``
    is the time of birth in years since 1970, by the birth date or else the ages at recording, the median of what its records say.
    """
    at = moments.where("field_name IN ('birth_date', 'date')").groupBy("record_id").agg(
        F.min(F.when(F.col("field_name") == "birth_date", F.expr("epoch_s div 86400"))).cast("int").alias("day"), F.min(F.when(F.col("field_name") == "date", F.col("epoch_s"))).alias("at")
    )
    r = records.join(at, "record_id", "left").withColumn("born", F.when(F.col("age").between(0, 130), F.col("at") / 31556952 - F.col("age") - 0.5))
    # one row for each spelling and site first, so that a patient with very many records is no hot group
    parts = r.groupBy("patient_id", "first_name", "last_name", "day", "site").agg(F.count("*").alias("n"), F.percentile_approx("born", 0.5).alias("born"))
    best = lambda c: F.max_by(c, F.struct(_tidy(c).alias("t"), F.col("n"), F.col(c).alias("c")))
    own = parts.groupBy("patient_id").agg(
        best("first_name").alias("first"), best("last_name").alias("last"), F.mode("day", True).alias("day"), F.percentile_approx("born", 0.5).alias("born"),
        F.collect_set("site").alias("at"),
    )
    joined = lambda c: F.regexp_replace(F.trim(F.coalesce(F.col(c), F.lit(""))), r"\s+", "-")
    sites = F.transform(F.array_sort("at"), lambda s: F.struct(s.alias("site"), F.lit(1).cast("long").alias("n")))
    return own.select(F.lit(PATIENT).alias("field"), F.col("patient_id").alias("id"), "day", F.coalesce(F.col("day") / 365.2425, "born").alias("born"), sites.alias("sites"), F.concat_ws(" ", joined("first"), joined("last")).alias("text"))


def variant_classes(records: DataFrame, moments: DataFrame) -> DataFrame:
    """(field_name, key, entity, links): the entity of every key that has another, and the number of other keys of it.

    ``moments`` (record_id, field_name, epoch_s) are the records' dates, as :func:`pulsegrid.operators.timestamps.moments`
    gives them. Patients that have neither a birth date nor an age at a recording are linked to none.
    """
    r = need(records, "record_id", "site_id", "patient", "recording", "interpretation").select(
        "record_id", F.col("site_id").alias("site"), F.col("recording.device.institution").alias("institution"), F.col("interpretation.interpreter").alias("interpreter"),
        "patient.patient_id", "patient.first_name", "patient.last_name", "patient.age",
    )
    r = cut(r.dropDuplicates(["record_id"]))
    readers = _sites(r.where(~blank(F.col("interpreter"))).withColumnRenamed("interpreter", "id"), "id")
    readers = readers.select(F.lit(INTERPRETER).alias("field"), "id", F.lit(None).cast("int").alias("day"), F.lit(None).cast("double").alias("born"), "sites", F.col("id").alias("text"))
    keyed = cut(_keyed(patient_names(r.where(~blank(F.col("patient_id"))), moments).unionByName(readers)))
    places = cut(_sites(r.where(~blank(F.col("institution"))).withColumnRenamed("institution", "id"), "id"))
    edges = cut(checked_edges(radius_join(person_points(keyed)), keyed).union(institution_edges(places)))

    entity = cut(components(edges.where("kind = 'same'")))
    # a partial name takes the most weighty of the entities it fits, unless another has the same weight
    part = edges.where("kind = 'part'").select("a", "b", "weight").distinct().join(entity, F.col("b") == F.col("node"), "left")
    options = part.groupBy("a", F.coalesce("component", "b").alias("entity")).agg(F.sum("weight").alias("w"))
    ranked = options.groupBy("a").agg(F.max(F.struct("w", "entity")).alias("top"), F.count_if(F.lit(True)).alias("n"), F.max_by("entity", "w").alias("e"), F.collect_list("w").alias("ws"))
    chosen = ranked.where(F.size(F.filter("ws", lambda w: w == F.col("top.w"))) == 1).select(F.col("a").alias("node"), F.col("top.entity").alias("chosen"))
    member = entity.join(chosen, "node", "full").select("node", F.coalesce("chosen", "component").alias("entity"))
    # a chosen whole name without variants of its own is an entity too
    alone = chosen.select(F.col("chosen").alias("node")).distinct().join(entity.select("node"), "node", "left_anti").select("node", F.col("node").alias("entity"))
    member = cut(member.union(alone).distinct())
    size = member.groupBy("entity").agg((F.count("*") - 1).alias("links"))
    name = F.split("node", SEP, 2)
    return member.join(size.where("links > 0"), "entity").select(name[0].alias("field_name"), name[1].alias("key"), "entity", "links")


def variant_pairs(classes: DataFrame) -> DataFrame:
    """(field_name, key_a, key_b), key_a < key_b by code point: all pairs of keys of one entity, of :func:`variant_classes`.

    TESTDATA defines the result as all pairs; an entity has as many keys as it has different spellings or identifiers.
    """
    a, b = classes.select("field_name", "entity", F.col("key").alias("key_a")), classes.select("field_name", "entity", F.col("key").alias("key_b"))
    return a.join(b, ["field_name", "entity"]).where("key_a < key_b").select("field_name", "key_a", "key_b").distinct()
