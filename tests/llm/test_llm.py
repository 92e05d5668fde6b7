import datetime as dt
import itertools
import random
import string
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulsegrid.llm import canonical, encoding, leakage, metrics, mixing, quality, variants

word = st.text("abc", max_size=6)


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(word, word, word)
def test_damerau_is_a_metric(a, b, c):
    d = metrics.damerau
    assert (d(a, b) == 0) == (a == b) and d(a, b) == d(b, a) and d(a, c) <= d(a, b) + d(b, c)


def test_bag_distance_is_the_best_assignment():
    rng = random.Random(2)
    for _ in range(300):
        a, b = (["".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 5))] for _ in range(2))
        n = max(len(a), len(b))
        x, y = a + [""] * (n - len(a)), b + [""] * (n - len(b))
        assert metrics.bag_distance(" ".join(a), " ".join(b)) == min((sum(lev(v, w) for v, w in zip(x, o, strict=True)) for o in itertools.permutations(y)), default=0)
    assert metrics.bag_distance(" ".join(f"w{k}" for k in range(12)), " ".join(f"v{k}" for k in range(12))) == 12


@pytest.mark.parametrize("work", [5, 1 << 20])
def test_radius_join_against_brute_force(spark, monkeypatch, work):
    monkeypatch.setattr(metrics, "WORK", work)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(0, 8)))
    points = sorted({("dense", word(), word(), 0) for _ in range(150)} | {("spread", word(), word(), rng.randint(0, 2000)) for _ in range(200)} | {("spread", "aab", "c", 7 + k % 3) for k in range(3)} | {("small", word(), "", 0) for _ in range(5)})
    d = lambda p, q: min(lev(p[1], q[1]) + lev(p[2], q[2]), lev(p[1], q[2]) + lev(p[2], q[1])) + abs(p[3] - q[3])
    rows = [(s, 4, (x, y, n), k % 3 > 0, k) for k, (s, x, y, n) in enumerate(points)]
    df = spark.createDataFrame(rows, "space string, radius int, point struct<p1:string,p2:string,num:int>, home boolean, who int")
    got = [(r.who_a, r.who_b) for r in metrics.radius_join(df).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(i, j) for i, p in enumerate(points) for j, q in enumerate(points) if i != j and i % 3 and p[0] == q[0] and d(p, q) <= 4}
    bags = [" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(120)]
    df = spark.createDataFrame([("all", 2, x, True, k) for k, x in enumerate(bags)], "space string, radius int, point string, home boolean, who int")
    assert {(r.who_a, r.who_b) for r in metrics.radius_join(df, metrics.BAGS).collect()} == {(i, j) for i, x in enumerate(bags) for j, y in enumerate(bags) if i != j and metrics.bag_distance(x, y) <= 2}
    assert metrics.radius_join(df.limit(0), metrics.BAGS).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(f"n{rng.randint(0, 400)}", f"n{rng.randint(0, 400)}") for _ in range(300)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[root(a)] = root(b)
    got = {r.node: r.component for r in metrics.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert set(got) == {x for e in edges for x in e if e[0] != e[1]}
    assert all((got[a] == got[b]) == (root(a) == root(b)) for a, b in itertools.combinations(list(got)[::7], 2))


REFS = [("label", c, f"Lead {c}") for c in "I II III aVR aVL aVF V1 V2 V3 V4 V5 V6 V4R X Y Z".split()] + [("sex", "M", "Male"), ("sex", "F", "Female"), ("sex", "U", "Unknown"), ("race", "BLK", "Black or African American"), ("race", "UNK", "Unknown or declined")]
TYPED = {
    ("label", "Laed II"): "II", ("label", "V1 "): "V1", ("label", "aVVL"): "aVL", ("label", "C4R"): "V4R", ("label", "precord. 3"): "V3", ("label", "MDC_ECG_LEAD_AVR"): "aVR", ("label", "D2"): "II", ("label", "lead-3"): "III", ("label", "Frnk Y"): "Y", ("label", "augmented F"): "aVF",
    ("label", "ART"): "UNMATCHED", ("label", "   "): "UNMATCHED", ("label", "x" * 5000): "UNMATCHED", ("sex", "femlae"): "F", ("sex", "mężczyzna"): "M", ("sex", "#REF!"): "UNMATCHED", ("sex", "жен."): "F", ("race", "Blck"): "BLK", ("race", "refused"): "UNK", ("race", "Tuesday"): "UNMATCHED",
}


def test_canonical(spark, monkeypatch):
    refs = spark.createDataFrame([*REFS, (None, "M", None), ("sex", None, None)], "field_name string, code string, display string")
    typed = spark.createDataFrame([*TYPED, *TYPED, ("sex", "M"), ("sex", ""), ("sex", None), (None, "M")], "field_name string, raw_value string").withColumn("code", F.lit("clash"))
    got = {(r.field_name, r.raw_value): r.code for r in canonical.match_values(typed, refs).where("field_name IS NOT NULL").collect()}
    assert got == TYPED
    monkeypatch.setattr(canonical, "SHARD", 100)
    sharded = {(r.field_name, r.raw_value): r.code for r in canonical.match_values(typed, refs).where("field_name IS NOT NULL").collect()}
    assert sharded == TYPED
    assert canonical.match_values(typed.limit(0), refs).count() == 0 and canonical.match_values(typed, refs.limit(0)).where("code <> 'UNMATCHED'").count() == 0


def test_canonical_on_other_wordings(spark):
    """38 wordings made up for this test that do not stand in the test tables; CO2, a letter off a chest lead, goes wrong."""
    refs = [*REFS, ("race", "AIA", "American Indian or Alaska Native"), ("race", "MEN", "Middle Eastern or North African"), ("race", "HIS", "Hispanic or Latino"), ("race", "WHT", "White"), ("race", "ASI", "Asian"), ("race", "MUL", "Two or more races")]
    held_out = {
        "label": {"Ableitung V4": "V4", "ekg lead avf": "aVF", "derivacion II": "II", "einthoven 3": "III", "Goldberger L": "aVL", "precordial 5": "V5", "Chest V6": "V6", "lead: V-1": "V1", "LEAD_aVR": "aVR", "limb lead 1": "I", "wilson 2": "V2", "EKG:III": "III", "Leed V3": "V3", "CO2": "UNMATCHED", "Pressure 2": "UNMATCHED", "EOG left": "UNMATCHED"},
        "sex": {"Mascul.": "M", "Femenina": "F", "Frau ": "F", "not recrded": "U", "undeterm.": "U", "wieblich": "F", "Mister": "M", "yes": "UNMATCHED", "12": "UNMATCHED"},
        "race": {"Afr.-American": "BLK", "black american": "BLK", "Caucas": "WHT", "white, non-specific": "WHT", "Alaska Nat.": "AIA", "M. Eastern": "MEN", "Latino/Hispanic": "HIS", "southeast asian": "ASI", "two races or more": "MUL", "not stated": "UNK", "declned": "UNK", "ward 7": "UNMATCHED", "left handed": "UNMATCHED"},
    }
    typed = [(f, v) for f, vs in held_out.items() for v in vs]
    rows = canonical.match_values(spark.createDataFrame(typed, "field_name string, raw_value string"), spark.createDataFrame(refs, "field_name string, code string, display string")).collect()
    wrong = [(r.field_name, r.raw_value, r.code) for r in rows if held_out[r.field_name][r.raw_value] != r.code]
    assert len(rows) == len(typed) and len(wrong) <= 0.12 * len(typed), wrong
    assert all(r.distance is not None and r.entry for r in rows if r.code == "UNMATCHED")


def test_bk_tree_finds_all():
    rng = random.Random(2)
    words = {"".join(rng.choice("abcd") for _ in range(rng.randint(1, 7))): "x" for _ in range(400)}
    tree = canonical.BKTree(words)
    for q in list(words)[:40] + ["zzz", "abcdabcd"]:
        for r in (0, 1, 2):
            assert {f[1] for f in tree.within(q, r)} == {w for w in words if metrics.damerau(q, w) <= r}
        assert tree.nearest(q)[0] == min(metrics.damerau(q, w) for w in words)
    assert canonical.BKTree({}).within("a", 2) == [] and canonical.BKTree({}).nearest("a") is None


PEOPLE = "patient_id string, first_name string, last_name string, age int, clinical_history string"


def records(spark, rows):
    """(record_id, patient, institution, interpreter, site)"""
    schema = f"record_id string, patient struct<{PEOPLE}>, recording struct<device struct<institution string>>, interpretation struct<interpreter string>, site_id string, entity string"
    return spark.createDataFrame([(r, p, ((i,),), (w,), s, "clash") for r, p, i, w, s in rows], schema)


def patient_row(pid, first, last, age=None):
    return (pid, first, last, age, None)


def test_variants(spark):
    person = [
        ("p1", "Joseph", "Ockeringmere", 1), ("p2", "Ockeringmree", "JOSEPH", 1), ("p3", "J.", "Okeringmere", 1), ("p4", "Maëlle", "Previl", 1), ("p5", "Loïc", "Previl", 1), ("p6", "Joseph", "Ockeringmere", 2),
        ("p7", "Jürgen", "Krämer", 3), ("p8", "J", "Kraemer", 3), ("p9", "Peggy", "Duntombeby", 4), ("p10", "Margaret", "Duntmmbeby", 4), ("p11", "Joseph", "Ockeringmere", None), ("p12", None, None, 1), ("p13", "Zoë", "", 1),
        ("p14", "Анна", "Дубовенко", 5), ("p15", "Дубтвнеко", "Анна", 5), ("p16", "Helen", "Halinworthy", 6), ("p17", "Helen", "Halinvorti", 6), ("p18", "J?rg", "M\ufffdlig", 8), ("p19", "Jörg", "Mölig", 8), ("p20", "Inés", "", 9), ("p21", "Inés", "Arrolado", 9),
    ]
    inst = ["Fjordvik Regional Hospital"] * 9 + ["Fordvik Reg. Hosp.", "Hospital, Regional (Fjordvik)", "FRH Fjordvik", "Fjordvik Heart Centre", "Fjordvik Heart Ctr", "Fjordvik Day Clinic", "Fjordvik Dayclinic", "", None]
    who = ["Dr. Käthe Mölliggast", "Moelliggast, Kaethe", "MÖLLIGGAST KÄTHE", "K. Mölligast", "Dr. Helen Fenowewick", "Helmn Fenowewick", "Fenowewick, H.", "Dr. Harold Fenowewick", "Peggy Wexomb", "Wexomb Margaret", None, " "]
    rows = [(f"a{k}", patient_row(pid, first, last), None, None, "S1") for k, (pid, first, last, _) in enumerate(person)]
    rows += [(f"i{k}", patient_row(None, None, None), x, None, "S1") for k, x in enumerate(inst)]
    rows += [(f"w{k}", patient_row(None, None, None), None, x, "S2" if x and "Harold" in x else "S1") for k, x in enumerate(who)]
    dates = spark.createDataFrame([(f"a{k}", "birth_date", day * 86400) for k, (*_, day) in enumerate(person) if day is not None], "record_id string, field_name string, epoch_s long")
    r = records(spark, rows)
    classes = variants.variant_classes(r.union(r), dates)
    out = variants.variant_pairs(classes).collect()
    got = {(x.field_name, x.key_a, x.key_b) for x in out}
    assert len(out) == len(got) and all(a < b for _, a, b in got)
    groups = {
        "patient": [["p1", "p2", "p3"], ["p7", "p8"], ["p10", "p9"], ["p14", "p15"], ["p16", "p17"], ["p18", "p19"], ["p20", "p21"]],
        "institution": [["Fjordvik Regional Hospital", "Fordvik Reg. Hosp.", "Hospital, Regional (Fjordvik)", "FRH Fjordvik"], ["Fjordvik Heart Centre", "Fjordvik Heart Ctr"], ["Fjordvik Day Clinic", "Fjordvik Dayclinic"]],
        "interpreter": [who[:4], ["Dr. Helen Fenowewick", "Helmn Fenowewick", "Fenowewick, H."], ["Peggy Wexomb", "Wexomb Margaret"]],
    }
    assert got == {(f, *sorted(pair)) for f, gs in groups.items() for g in gs for pair in itertools.combinations(g, 2)}
    links = {(x.field_name, x.key): x.links for x in classes.collect()}
    assert links == {(f, k): len(g) - 1 for f, gs in groups.items() for g in gs for k in g}
    assert variants.variant_pairs(variants.variant_classes(r.limit(0), dates.limit(0))).count() == 0


def test_patients_without_birth_dates(spark):
    year = 31556952
    # id, name, site, day of birth, age, year of recording since 1970
    people = [
        ("a", "Angel", "Urandino", "S1", 7300, None, 50), ("b", "Ángel", "Urandinno", "S1", None, 30, 50.5), ("c", "Angel", "Urandino", "S1", None, 50, 50.5), ("d", "Angel", "Urandino", "S2", None, 30, 50.5), ("e", "Angel", "Urandino", "S1", None, None, 50.5),
        ("f", "Susan", "Fenadale", "S1", 3650, None, 50), ("g", "Susan", "Fenadale", "S1", 3660, None, 50), ("h", "Susan", "Fenadale", "S1", None, 40, 50.2), ("i", "Eva", "Lindqvist", "S3", None, 20, 50.2), ("j", "Lindqvist", "Eva", "S3", None, 21, 51.0),
    ]
    r = records(spark, [(p, patient_row(p, f, n, age), None, None, s) for p, f, n, s, _, age, _ in people])
    dates = [(p, "birth_date", d * 86400) for p, *_, d, _, _ in people if d is not None] + [(p, "date", int(at * year)) for p, *_, at in people]
    got = {(x.key_a, x.key_b) for x in variants.variant_pairs(variants.variant_classes(r, spark.createDataFrame(dates, "record_id string, field_name string, epoch_s long"))).collect()}
    # the age must fit, the site must be shared, and of two that fit equally none is chosen
    assert got == {("a", "b"), ("i", "j")}


TEXTS = ["Größe und Gewicht unverändert, Blutdruck erhöht.", "Müdigkeit, gelegentlich Schwindel beim Aufstehen.", "Refiere palpitaciones después del ejercicio físico.", "Kontrola po zabiegu, pacjentka czuje się dobrze, ciśnienie w normie.", "Жалобы на боль в груди при нагрузке.", "Перебои в работе сердца, чаще вечером.", "Le patient a été opéré en 2023, aucun événement depuis.", "Temp 38.4 °C on arrival, β-blocker paused."]


def spoil(text, wrong, right="utf-8"):
    return "".join(encoding._chars_of(wrong)[b] for b in text.encode(right))


def test_encoding(spark):
    rows, expected = [], {}

    def add(text, fixed=None):
        rid = f"r{len(rows)}"
        rows.append((rid, ("p", None, None, None, text), ((None,),), (None,), "S"))
        if fixed is not None:
            expected[rid, "clinical_history"] = fixed if isinstance(fixed, int) else zlib.crc32(fixed.encode())

    for _ in range(30):
        for t in TEXTS:
            add(t)
    for t in TEXTS:
        add(spoil(t, "cp1252"), t)
        add(spoil(spoil(t, "cp1252"), "cp1252"), t)
        add(spoil(t, "mac_roman"), t)
    add(TEXTS[0] + " " + spoil(TEXTS[1], "cp437"), TEXTS[0] + " " + TEXTS[1])
    add(spoil(TEXTS[4], "cp1252", "cp1251"), TEXTS[4])
    add(spoil(TEXTS[0], "mac_roman", "cp1252"), TEXTS[0])
    add("M�digkeit", -1)
    add("M?digkeit, gelegentlich", -1)
    add("Any chest pain? No.")
    add("")
    add(None)
    add("a b " * 3000)
    df = spark.createDataFrame(rows, f"record_id string, patient struct<{PEOPLE}>, recording struct<device struct<institution string>>, interpretation struct<interpreter string>, site_id string")
    out = encoding.spoilt_fields(df.union(df)).collect()
    assert {(r.record_id, r.field_name): r.restored_crc32 for r in out} == expected and len(out) == len(expected)
    assert encoding.spoilt_fields(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(string.ascii_letters + "äöüßéèñłśж", min_size=1, max_size=12), st.sampled_from(encoding.MISREAD_UTF8))
def test_undo_is_exact(text, wrong):
    assert encoding.undo(spoil(text, wrong), ((wrong, "utf-8"),)) == text


def test_character_model_is_a_distribution():
    counts = {}
    for w in ("abab", "abba", "cab"):
        for g in encoding.grams(w):
            counts[g] = counts.get(g, 0) + 1
    m = encoding.CharModel(counts)
    for context in ("", "a", "ba", "zz"):
        known = sum(m._p(context + c) for c in "abc\x03")
        assert 0.7 < known <= 1.0000001


def model_of(words):
    counts = {}
    for w, n in words.items():
        for g in encoding.grams(w):
            counts[g] = counts.get(g, 0) + encoding.weight(n)
    return encoding.CharModel(counts)


def test_margin_is_validated_on_every_word_without_it(spark):
    rng = random.Random(1)
    # many words of one alphabet, met up to three times, and a few short ones of another
    words = {"".join(rng.choice("aeiorlnéñí") for _ in range(rng.randint(2, 6))): 1 for _ in range(60)}
    words |= {"".join(rng.choice("аеиорлнв") for _ in range(rng.randint(1, 4))): 1 for _ in range(30)}
    words |= {"rené": 2, "león": 3}
    df = spark.createDataFrame([(f"r{n}", "last_name", w) for w, k in words.items() for n in range(k)], "record_id string, field_name string, text string")
    kept = {r.word: r.n for r in encoding._without_spoilt(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    made = dict.fromkeys(encoding.MARGINS, 0)
    whole, without = model_of(kept), encoding.Without(model_of(kept))
    for w, n in kept.items():
        if w.isascii():
            continue
        rest = model_of({v: k for v, k in kept.items() if v != w})
        without.leave(w, n)
        assert without.score(w) == pytest.approx(rest.score(w)) and without.score("Íéн") == pytest.approx(rest.score("Íéн"))
        good = max((g for g, _ in encoding.gains(w, rest).values()), default=-1)
        bad = [max(g for g, new in encoding.gains(spoil(w, m), rest).values() if new == w) for m in encoding.MISREAD_UTF8[:4]]
        for m in made:
            made[m] += (good > m) + sum(g <= m for g in bad)
    model, margin = encoding.train(df)
    assert model.n == pytest.approx(whole.n)
    assert margin == min(made, key=lambda m: (made[m], abs(m - 3))) != 3


ITEM = " ".join(f"word{k} of item" for k in range(20))


def test_leakage(spark):
    words = ITEM.split()
    changed = words[5:35]
    changed[7], changed[15] = "other", "things"
    dropped = words[10:40]
    del dropped[9]
    half = len(words) // 2
    cells = "intro " + " ".join(words[:half]) + "\n# %% [markdown]\n" + " ".join(words[half:])
    mark = cells.index("\n# %%")
    docs = [
        (1, "before " + ITEM.upper().replace(" ", ",\n_ ") + " after", None), (2, "x " + " ".join(changed), None), (3, " ".join(dropped), None), (4, " ".join(words[3:15]) + " and no more", None), (5, " ".join(words[::2]), None),
        (6, "", None), (7, None, None), (8, cells, [(0, mark), (mark + 17, len(cells))]), (9, "filler " * 50_000 + " ".join(words[20:45]), []), (10, " ".join(w + " no" for w in words), None),
    ]
    df = spark.createDataFrame([(i, t, c, 99) for i, t, c in docs], "doc_id long, text string, cells array<struct<start_char long, end_char long>>, item_id long")
    items = spark.createDataFrame([(7, ITEM, "short"), (8, None, ""), (9, "x", ITEM)], "item_id long, prompt string, answer string")
    out = leakage.leaked_items(df.union(df), items.union(items)).collect()
    got = {(r.doc_id, r.item_id) for r in out}
    assert got == {(d, i) for d in (1, 2, 3, 8, 9) for i in (7, 9)} and len(out) == len(got)
    assert leakage.leaked_items(df.drop("cells").where("doc_id = 1"), items).count() == 2
    spans = {r.doc_id: docs[r.doc_id - 1][1][r.start_char : r.end_char] for r in leakage.leaked_passages(df, items).where("item_id = 7").collect()}
    assert spans[1] == ITEM.upper().replace(" ", ",\n_ ").rstrip(".,") and spans[2] == " ".join(changed).rstrip(".,") and spans[9] == " ".join(words[20:45]).rstrip(".,") and spans[8].startswith(words[0]) and spans[8].endswith(words[-1].rstrip(".,"))
    assert leakage.leaked_items(df, items.limit(0)).count() == 0 and leakage.leaked_items(df.limit(0), items).count() == 0


def test_leakage_seeds_lose_no_passage():
    rng = random.Random(7)
    item = [f"w{k}" for k in range(60)]
    automaton, parts = leakage.build_automaton([(1, " ".join(item), None)])
    for _ in range(200):
        n = rng.randint(24, 50)
        at = rng.randint(0, 60 - n)
        piece = item[at : at + n]
        for _ in range(n // 9):
            k = rng.randrange(2, len(piece) - 2)
            op = rng.randint(0, 2)
            piece[k : k + (op < 2)] = ["zz"] if op != 1 else []
        text = " ".join(["a"] * 30 + piece + ["b"] * 30)
        held = leakage.held_passages(leakage.document_words(text, []), automaton, parts)
        assert {i for i, _, _ in held} == {1} and all(a >= 30 and b < 30 + len(piece) for _, a, b in held)
    assert leakage.held_passages(leakage.document_words(" ".join(item[:15]), []), automaton, parts) == []


@pytest.mark.parametrize(("mean", "cap"), [(0.3, 1), (1.7, 4), (3.9, 4), (4.0, 4), (0.01, 6), (2.5, 3)])
def test_poisson_steps(mean, cap):
    steps = mixing.poisson_steps(mean, cap)
    u = (np.arange(200_000) + 0.5) / 200_000
    counts = (np.array(steps)[None] <= u[:, None]).sum(1)
    assert abs(counts.mean() - mean) < 0.01 and counts.max() <= cap and (np.diff(steps) >= 0).all()


def test_mixing(spark):
    text = lambda k, n: " ".join(f"word{(k * j) % 97}" for j in range(n))
    docs = [(k, "big", text(k, 50)) for k in range(3000)] + [(3000 + k, "small", text(k, 60)) for k in range(400)] + [(5000, None, "a b"), (5001, "none", "a"), (5002, "big", None), (5003, "big", ""), (0, "big", text(0, 50))]
    df = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, source string, text string, n_tokens long")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 3), ("absent", 0.1, 9), (None, 0.1, 1), ("none", 0.0, 2), ("zero", 0.2, 0)], "source string, target_share double, max_repeats int")
    a = mixing.mixed_documents(df, targets).collect()
    assert sorted(a) == sorted(mixing.mixed_documents(df, targets).collect()) and len({(r.doc_id, r.copy_no) for r in a}) == len(a)
    assert max(r.copy_no for r in a if r.source == "small") <= 3 and all(r.copy_no == 1 for r in a if r.source == "big") and {r.source for r in a} == {"big", "small"}
    assert [r.doc_id for r in a] != sorted(r.doc_id for r in a)
    s = {r.source: r for r in mixing.share_report(df, targets).where("source IS NOT NULL").collect()}
    assert abs(s["big"].actual_share - 2 / 3) < 0.03 and abs(s["small"].actual_share - 1 / 3) < 0.03 and s["absent"].actual_share == 0 and abs(sum(r.actual_share for r in s.values()) - 1) < 1e-9
    assert mixing.mixed_documents(df.limit(0), targets).count() == 0 and mixing.mixed_documents(df, targets.limit(0)).count() == 0


def test_token_counts_round_trip(spark):
    with open(f"{mixing.TOKENIZERS}/{mixing.VOCABULARY}", "rb") as f:
        enc = mixing._encoding(f.read())
    t = "Größe: 5 µg\n  x = [1, 2]\t'don't' " + "A" * 3000
    assert enc.decode(enc.encode_ordinary(t)) == t


BLOCKS = {
    "prose": ["The idea behind filters is simple: mark what you know and clean what is left. There are 5 rows in the peak, and most of them are useful.", "Wenn das Ergebnis nicht stimmt, dann ist der Filter noch zu schwach."],
    "code": ["def f(x):\n    return x[::2]\nfor i in range(5):\n    acc.append(x[i] * 2)", "TypeError                 Traceback (most recent call last)\n<ipython-input-1> in <module>\n----> 5 x()", "import numpy as np\nout = np.zeros((4, 2))"],
    "list": ["- one thing\n- two things\n- three", "1. sort it\n2. load it now\n3. drop", "alpha.csv\nbeta_gamma.ipynb\ndelta/\nmore.txt", "numpy==1.2.3\nlong-name==4.5.6\nother==7.8.9", "- [x] done\n- [ ] open task\n- [x] more"],
    "table": ["a,b,c\nx,1,2\ny,3,NaN\nz,4,5", "| a | b |\n|---|---|\n| x | 1 |", "<tr><th>a</th></tr>\n<tr><td>1</td></tr>", "a & b \\\\\nc & 1 \\\\", "name   score   x\n1      2.5     y\n2      3.5     z", "a\tb\nc\t1\nd\t2", "a;b\nc;1,5\nd;2,5"],
    "junk": ["data:image/png;base64," + "iVBORw0KGgo" * 20, "00000010  32 9e 01 77 fe 73 c6 4f\n00000020  c1 5c a6 9c 90 89 73 a1", "[0.538472, 0.113153, -0.508448, -0.758892],\n[0.1, 0.2, 0.3, -0.44444],", "WARN a.b: c 0xcb deprecated\nWARN a.b: c 0xcb deprecated\nWARN a.b: c 0xcb deprecated", " 5%|█     | 1/42 [00:01<00:56, 33.5it/s]\n 10%|██   | 2/57 [00:02<00:40]", "(r]ol_u^vqac)&u+\nfj]lrx~k~[_)if&w~i%%+(#&~vp)pr^[#*vsoeszx#"],
}


def test_block_kinds():
    wrong = [(k, b[:40], quality.block_kind(b)) for k, bs in BLOCKS.items() for b in bs if quality.block_kind(b) != k]
    assert not wrong


def test_quality(spark):
    prose = BLOCKS["prose"][0]
    docs = [(1, prose), (2, prose + "\n\n" + "\n".join(f"- item {k}" for k in range(90))), (3, ""), (4, None), (5, BLOCKS["junk"][0] * 300), (6, prose + "\n\n" + BLOCKS["table"][0] * 1 + "\n\n" + prose), (7, "same line here.\n" * 30), (8, "\n".join(f"r{k},{k},x" for k in range(40)))]
    df = spark.createDataFrame([(i, t, "f") for i, t in docs], "doc_id long, text string, form string")
    got = {tuple(r) for r in quality.document_forms(df.union(df)).collect()}
    assert got >= {(2, "list"), (5, "junk"), (8, "table")} and not {1, 3, 4, 6} & {g[0] for g in got}
    common = spark.createDataFrame([("en", "the"), ("en", None), (None, "is")], "lang string, word string")
    s = {r.doc_id: r for r in quality.document_statistics(df.union(df), common).collect()}
    assert len(s) == 8 and s[4].n_chars is None and s[3].n_words == 0 and s[1].n_chars == len(prose) and s[1].prose_share == 1 and s[7].duplicate_lines > 0.9
    w = [x for x in prose.replace(":", " ").replace(".", " ").replace(",", " ").split() if x.isalpha()]
    assert s[1].n_words == len(w) and abs(s[1].mean_word_length - sum(map(len, w)) / len(w)) < 1e-9 and abs(s[1].common_words - sum(x.lower() in ("the", "is") for x in w) / len(w)) < 1e-9
    assert quality.document_forms(df.limit(0)).count() == 0 and quality.document_statistics(df.limit(0), common.limit(0)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.text(st.sampled_from("ab \n-*|,;\t1.0=(){}#>%é"), max_size=200))
def test_kinds_cover_every_character(text):
    assert sum(quality.kind_sizes(text).values()) == len(text)


def test_queries_are_registered():
    from pulsegrid.llm import queries

    assert {"p3_found", "p3_matches", "p4_found", "p4_classes", "p5_found", "p8_found", "p8_passages", "p9_mix", "p9_shares", "p10_found", "p10_stats"} == set(queries.QUERIES) and dt.date(2024, 1, 1)


def test_block_kinds_do_not_depend_on_place_or_number_of_lines():
    bars = [f"{k * 5}%|████      | {k}/20 [00:0{k % 10}<00:10, 3.1it/s]" for k in range(20)]
    for before in ("", "words of a caption " * 30):
        assert quality.block_kind("\n".join(before + x for x in bars)) == "junk"
    for frames in (10, 60, 600):
        assert quality.block_kind("Traceback (most recent call last):\n" + "\n".join(f"  frame number {k} of something" for k in range(frames))) == "code"
    for before in ("", "image shown as text: " + "word " * 200):
        assert quality.block_kind(before + "\ndata:image/png;base64," + "iVBORw0KGgo" * 200) == "junk"
    code = [f"result_{k} = compute(value_{k}, {k})" for k in range(10)]
    assert quality.block_kind("\n".join(code)) == quality.block_kind("\n".join("[first, " + "second, " * 80 + x for x in code)) == "code"


def test_repetition_counts_each_word_once():
    assert quality.top_cover("a b " * 50) == pytest.approx(1.0)
    assert quality.top_cover("x1 x2 x3 x4 " * 2 + " ".join(f"w{k}" for k in range(92))) == pytest.approx(16 / (16 + sum(len(f"w{k}") for k in range(92))))
    assert quality.top_cover("") == 0.0
    boiler = "\n\n".join(["loading the shared module now\nplease wait for it\nthen go on"] * 30)
    r = quality.Repetition(boiler)
    assert r.duplicate_lines > 0.9 and r.duplicate_paragraphs > 0.9 and r.cover > 0.3
    sizes = quality.kind_sizes(boiler)
    assert 2 * sizes["junk"] > len(boiler)
    for hostile in ("1" * 200_000, "a(" * 100_000, "[" * 200_000, " " * 200_000 + "x", "=" * 200_000):
        assert sum(quality.kind_sizes(hostile).values()) == len(hostile)


def test_common_words_beyond_the_bound_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(quality, "COMMON_BOUND", 2)
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    with pytest.raises(ValueError, match="common words"):
        quality.document_statistics(docs, spark.createDataFrame([(w,) for w in "abc"], "word string"))
