import random
import re

import pytest

import corpus_pipeline
from graphlift.llm import decontaminate, jaccard, queries, secrets, toxicity
from graphlift.llm.common import stored, table as read

from helpers import SF, docs, table

ITEM = "Maria Lopez bought exactly 12 red apples for 30 dollars and then gave 12 apples to her neighbour Boris before walking 5 miles home again."


def items(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "item_id long, text string, h string, begin string")


def found(spark, texts, benchmark=((1, ITEM),)):
    rows = decontaminate.contaminations(docs(spark, texts), items(spark, benchmark)).collect()
    return {(r.doc_id, r.item_id): r for r in rows}


def test_verbatim_and_asked_anew(spark):
    anew = ITEM.replace("12", "40").replace("30", "99").replace("Boris", "Karla").replace("Maria Lopez", "Ivan Petrov").replace("5 miles", "8 miles")
    uneven = ITEM.replace("12 red", "40 red").replace("gave 12", "gave 41")
    texts = [
        (1, "Some words before. " + ITEM + " Some words after."), (2, "intro, " + anew + " outro"), (3, uneven), (4, ITEM.upper()), (5, "Maria Lopez bought exactly 12 red apples."),
        (6, ITEM.replace("apples", "pears")), (7, None), (8, ""), (None, ITEM), (1, "Some words before. " + ITEM + " Some words after."), (9, "w " * 20_000 + ITEM), (10, "quite another text of no interest at all for any test here"),
    ]
    got = found(spark, texts)
    assert {d for d, _ in got} == {1, 2, 4, 9}
    assert got[1, 1].n_changed == 0 and got[2, 1].n_changed >= 3 and got[9, 1].begin == 20_000


@pytest.mark.parametrize("n", range(3, 13))
def test_short_items_in_any_case_and_sentence(spark, n):
    short = " ".join("Carla Jones asked Boris how many Roman coins were found near Paris today".split()[:n])
    sums = " ".join("What is 12 times 7 plus 3 days and 4 hours less 5".split()[:n])
    copies = [f(t) for t in (short, sums) for f in (str, str.lower, str.upper, str.title)]
    texts = [(i, f"and so,{gap}{t} (then more)") for i, (t, gap) in enumerate((t, g) for t in copies for g in (" ", "\n", ' "'))]
    got = found(spark, texts, [(1, short), (2, sums)])
    assert set(got) == {(i, 1 if i < 12 else 2) for i in range(24)} and all(r.begin == 2 and r.n_windows == r.windows for r in got.values())


def test_long_item_in_any_case_with_other_numbers(spark):
    anew = ITEM.replace("12", "40").replace("30", "99")
    assert set(found(spark, [(i, f"so, {f(t)}") for i, (t, f) in enumerate((t, f) for t in (ITEM, anew) for f in (str.lower, str.upper, str.title))])) == {(i, 1) for i in range(6)}


def test_long_item_with_one_of_two_equal_values_changed(spark):
    words = [f"w{chr(97 + i // 10)}{chr(97 + i % 10)}" for i in range(100)]
    words[20] = words[70] = "12"
    words[40] = words[85] = "Boris"
    item = " ".join(words)
    put = lambda changes: " ".join(changes.get(i, w) for i, w in enumerate(words))
    texts = [put({20: "13"}), put({70: "13"}), put({40: "Karla"}), put({85: "Karla", 20: "7"}), put({20: "13", 70: "14"}), put({20: "13", 70: "13"})]
    got = found(spark, list(enumerate(texts)), [(1, item)])
    assert set(got) == {(i, 1) for i in range(6)}
    assert all(got[i, 1].n_windows == 85 and got[i, 1].n_changed == 0 for i in (0, 1, 2)) and got[3, 1].n_windows == 77
    assert got[5, 1].n_windows == got[5, 1].windows and got[5, 1].n_changed == 1
    roles = "Pack 2 boxes of the red apples into one large basket and carry it home within 2 days of the harvest"
    assert set(found(spark, [(1, roles.replace("2 boxes", "3 boxes")), (2, roles.replace("2 days", "3 days"))], [(1, roles)])) == {(1, 1), (2, 1)}


def test_odd_benchmarks(spark):
    texts = [(1, "alpha beta gamma"), (2, ITEM), (3, "1 2 3 4 5 6 7 8 9 10 11 12")]
    assert set(found(spark, texts, [(1, "Alpha beta, gamma!"), (2, None), (3, ""), (None, ITEM), (4, "1 2 3 4 5 6 7 8 9 10 11 12")])) == {(1, 1)}
    assert found(spark, texts, []) == {} and found(spark, [], [(1, ITEM)]) == {}
    assert set(found(spark, texts, [(5, ITEM), (5, ITEM), (6, ITEM)])) == {(2, 5), (2, 6)}


def test_windows_everywhere_find_the_same(spark, monkeypatch):
    texts = [(i, t) for i, t in zip(table("documents").doc_id.tolist()[:60], table("documents").text.tolist()[:60], strict=True)] + [(900, "so " + ITEM)]
    benchmark = [(1, ITEM), *[(10 + i, t) for i, t in enumerate(table("benchmark").text[:10])]]
    some = set(found(spark, texts, benchmark))
    monkeypatch.setattr(decontaminate, "MOST_ANCHORS", 0)
    assert set(found(spark, texts, benchmark)) == some >= {(900, 1)}


def held_items(d, b):
    plain = lambda t: " " + " ".join(re.findall(r"[^\W_]+", (t or "").lower())) + " "
    whole = {i: plain(t) for i, t in zip(d.doc_id, d.text, strict=True)}
    return {(x, i) for i, t in zip(b.item_id, b.text, strict=True) for x, w in whole.items() if plain(t) in w}


def test_op7_whole_table(spark):
    got = {(r.doc_id, r.item_id) for r in queries.op7_benchmark_decontamination(spark, SF).collect()}
    assert got == held_items(table("documents"), table("benchmark"))


def test_drop_contaminated_keeps_rows_and_columns(spark):
    d = docs(spark, [(1, ITEM), (2, "clean"), (2, "clean"), (None, ITEM), (3, None)])
    kept = decontaminate.drop_contaminated(d, items(spark, [(1, ITEM)]))
    assert kept.columns == d.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "2", "3", "None"]


def test_pipeline_stage_by_stage(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "packing"]
    steps = dict(corpus_pipeline.STAGES)
    d = read(spark, SF, "documents")
    model = queries.toxicity_model(spark, SF)
    a = stored(steps["toxicity"](spark, d, SF), "a")
    assert {r.doc_id for r in a.collect()} == {r.doc_id for r in toxicity.toxicity(d, model).collect() if not r.predicted}
    b = stored(steps["n-gram Jaccard join"](spark, a, SF), "b")
    assert {r.doc_id for r in b.collect()} == {r.component_id for r in jaccard.jaccard_components(a).collect()}
    c = stored(steps["benchmark decontamination"](spark, b, SF), "c")
    left = b.toPandas()
    assert {r.doc_id for r in c.collect()} == set(left.doc_id) - {x for x, _ in held_items(left, table("benchmark"))}
    e = stored(steps["secret scans"](spark, c, SF), "e")
    scan = secrets.Scanner()
    assert {r.doc_id: r.text for r in e.collect()} == {r.doc_id: secrets.redact(r.text, scan(r.text)) for r in c.collect()}
    assert all(x.columns == d.columns for x in (a, b, c, e))
    pieces = steps["packing"](spark, e, SF).collect()
    whole = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(str, pieces)) == sorted(map(str, whole)) and {r.doc_id for r in pieces} == {r.doc_id for r in e.collect()}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_empty_and_odd_documents(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert stage(spark, docs(spark, []).select(columns), SF).count() == 0
    r = random.Random(1)
    clean = " ".join("".join(r.choice("abcdef") for _ in range(5)) for _ in range(30))
    odd = docs(spark, [(1, None), (2, ""), (None, clean), (3, clean, None, "s")]).select(columns)
    out = stage(spark, odd, SF)
    assert {1, 2, 3} <= {r.doc_id for r in out.collect()} and (name == "packing" or out.columns == columns)


def test_words_of_a_document_are_made_once(spark):
    docs = spark.createDataFrame([(1, "The Quick brown fox jumps over 3 lazy dogs, 1.5 Élan ٣x 3rd")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "quick brown fox jumps over 7 lazy dogs")], "item_id long, text string")
    made = decontaminate.document_windows(docs, decontaminate.item_windows(items))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(lower") == 1
    words = docs.select(decontaminate.lower_words(docs["text"]).alias("low"), decontaminate.marked_words(docs["text"]).alias("marked"))
    row = words.select("low", decontaminate._kinds("low", "marked").alias("kinds")).first()
    assert row.low == "the quick brown fox jumps over 3 lazy dogs 1.5 élan ٣ x 3 rd".split()
    n = decontaminate.NUMBER
    assert row.kinds == ["the", decontaminate.NAME, *"brown fox jumps over".split(), n, "lazy", "dogs", n, decontaminate.NAME, n, "x", n, "rd"]
