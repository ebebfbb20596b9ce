"""Trigram lists of an index: against a loop, and how many rows they take."""

from collections import defaultdict

from cuadrante.operators import review
from cuadrante.review_index import trigram_lists


def generated(df):
    """Rows that explodes make, and what lies between the explode and the next exchange above it."""
    df._jdf.queryExecution().toRdd().count()
    waiting, found = [(df._jdf.queryExecution().executedPlan(), [])], []
    while waiting:
        p, above = waiting.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            waiting.append((p.finalPhysicalPlan(), above))
        elif kind.endswith("QueryStageExec"):
            waiting.append((p.plan(), above))
        else:
            if kind == "GenerateExec":
                found.append((int(p.metrics().get("numOutputRows").get().value()), above))
            children = p.children()
            waiting += [(children.apply(i), [] if kind == "ShuffleExchangeExec" else [*above, kind]) for i in range(children.size())]
    return found


def test_trigrams_of_equal_texts_are_made_once(spark):
    names = ["Redes", "Señales", "ab", "a", "", "Redes", "Redes", "x y z"]
    data = [(i, i // 50, names[i * 7 % 8] + (" 12" if i % 3 else ""), "f.pdf") for i in range(230)]
    none = {c: "cast(null as string)" for c in ("subject_code", "classroom", "grp", "subgroup", "raw_text", "degree_name", "degree_code")}
    rows = spark.createDataFrame(data, "number long, chunk long, name string, file string").selectExpr("*", *[f"{v} as {c}" for c, v in none.items()])
    want, different = defaultdict(list), set()
    for number, chunk, name, file in data:
        text = f"{name} {file}".lower()
        grams = {text[i : i + 3] for i in range(len(text) - 2)}
        different |= {(chunk, text, g) for g in grams}
        for g in grams:
            want[g, chunk].append(number % 50)
    lists = trigram_lists(rows, 50, 3)
    assert {(r["gram"], r["chunk"]): r["places"] for r in lists.collect()} == want
    assert {r["text"] for r in rows.select(review.searched_text().alias("text")).collect()} == {t for _, t, _ in different}
    (made, above), = generated(lists)
    # One row for each trigram of a different text, not for each of an item's; they are put together before they move.
    assert made == len(different) < len(data) * 8 and any("Aggregate" in x for x in above)
