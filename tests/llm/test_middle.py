import hashlib
import random

import pytest
from pyspark.sql import functions as F

from graphloom.llm import middle
from tests.llm.cases import ROWS, documents, empty

MORE = [(30, "has a <P> inside", "en", "a"), (31, "<M>", "en", "a"), (None, "no id at all", "en", "a"), (32, "🙂é́ß" * 300, "en", "a"), (33, "ends <", "en", "a"), (34, "P>S>M><<P<S", "en", "a")]


def by_hand(doc_id, text, seed=1):
    t = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return n, "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


def test_every_case(spark):
    rows = ROWS + MORE + [(k, "".join(random.Random(k).choice("ab é\n🙂<>PSM") for _ in range(k % 70)), "en", "a") for k in range(100, 400)]
    made = middle.transformed(documents(spark, rows))
    got = made.withColumn("again", middle.restored(F.col("form"), F.col("output"))).collect()
    want = sorted(((i, *by_hand(i, t), t or "") for i, t, *_ in rows), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_an_empty_table(spark):
    assert middle.transformed(empty(spark)).collect() == []


def test_no_shuffle(spark):
    plan = middle.transformed(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize("unit", ["char", "word"])
def test_units(unit):
    rng = random.Random(7)
    for size in [0, 1, 2, 3, 17, 256, 5000]:
        text = "".join(rng.choice("ab \n\té🙂") for _ in range(size))
        data = text.encode()
        if unit == "char":
            units = list(text)
        else:
            units, inside = [], False
            for k, c in enumerate(text):
                if k == 0 or (inside and c not in " \n\t"):
                    units.append("")
                units[-1] += c
                inside = c in " \n\t"
        ends = middle.unit_ends(data, unit)
        assert ends.bit_count() == len(units)
        for k in range(0, len(units) + 1, max(1, len(units) // 50)):
            assert middle.place_after(ends, k, len(data)) == len("".join(units[:k]).encode())


def test_words_are_kept_whole(spark):
    made = middle.transformed(documents(spark), unit="word", share=100)
    got = made.withColumn("again", middle.restored(F.col("form"), F.col("output"))).collect()
    assert sorted((r.again for r in got)) == sorted(t or "" for _, t, *_ in ROWS)


@pytest.mark.parametrize("marks", [("<P>", "<P>x", "<M>"), ("", "<S>", "<M>"), ("<<", "<S>", "<M>")])
def test_marks_that_could_be_mixed_up(spark, marks):
    with pytest.raises(ValueError):
        middle.transformed(documents(spark), marks=middle.Marks(*marks))
