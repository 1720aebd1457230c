import random

import numpy as np
import pytest

from ledgerloom.llm import leaks
from ledgerloom.llm.leaks import find_leaks, leaked_span, words_of

rng = random.Random(4)
VOCABULARY = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(4)) for _ in range(3000)]
COMMON = [f"the{c}" for c in "abcdefghij"]


def passage(n, r):
    return [r.choice(COMMON) if r.random() < 0.6 else r.choice(VOCABULARY) for _ in range(n)]


def found(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id bigint, text string, key string")
    e = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    return {(r.key, r.item): r.span for r in find_leaks(d, "doc_id", "text", e, "item_id", "text").collect()}


def test_words():
    assert words_of("Ex-\nample, NAÏVE\r\n\r\n[2001] ORC 5 – Page 1 of 3\r\nsoft­ware ﬁne ██ 3") == ["example", "naive", "software", "fine", "██", "3"]


@pytest.mark.parametrize("edits,span", [(0, 60), (3, 60), (4, None)])
def test_span(edits, span):
    item = np.arange(1, 61)
    doc = np.concatenate([[900] * 7, item, [901] * 5])
    doc[[17, 30, 43, 52][:edits]] = 0
    got = leaked_span(doc, item)
    assert got == span if span else 40 <= got < 60


def test_span_with_words_added_and_dropped():
    item = np.arange(1, 51)
    assert leaked_span(np.concatenate([item[:20], [777], item[20:35], item[36:]]), item) == 50
    assert leaked_span(item[:39], item) == 0 or leaked_span(item[:39], item) == 39


@pytest.mark.parametrize("group,windows,parts", [(100_000, 40_000, 64), (500, 7, 2)])
def test_leaks_are_found_and_near_misses_are_not(spark, monkeypatch, group, windows, parts):
    """With few large groups of items and tasks, and with several small ones."""
    for name, value in (("GROUP_WORDS", group), ("TASK_WINDOWS", windows), ("PARTS", parts)):
        monkeypatch.setattr(leaks, name, value)
    r = random.Random(9)
    items = [" ".join(passage(120, r)) for _ in range(12)]
    docs, want = [], set()
    for i in range(120):
        doc = passage(300, r)
        if i % 3 == 0:
            k = i // 3 % 12
            part = items[k].split()[20:75] if i % 2 else items[k].split()
            part[10], part[25] = "█████", part[25][::-1].upper()
            doc[100:100] = [w.upper() if r.random() < 0.1 else w for w in part] if i % 4 else [*part[:30], "\n\n[2001] ORC 5 – Page 1 of 3\n\n", *part[30:]]
            want.add((i, k))
        elif i % 3 == 1:
            doc[50:50] = items[i % 12].split()[:32]  # too short
        docs.append(" ".join(doc))
    docs += [None, "", "   ", docs[0], "word " * 50_000]
    want |= {(123, k) for i, k in want if i == 0}
    assert set(found(spark, docs, items)) == want


def test_a_passage_that_a_third_of_all_documents_hold(spark):
    r = random.Random(10)
    items = [" ".join(passage(100, r)) for _ in range(8)]
    docs = [" ".join(passage(80, r) + (items[3].split()[10:80] if i % 3 == 0 else []) + passage(80, r)) for i in range(1500)]
    assert set(found(spark, docs, items)) == {(i, 3) for i in range(0, 1500, 3)}


def test_empty_tables(spark):
    assert found(spark, [], ["a b c"]) == {}
    assert found(spark, ["a b c"], []) == {}
    assert found(spark, ["a b c", None], ["a b c", None]) == {}


def test_spans_whose_rare_words_are_altered_are_found_at_every_offset(spark):
    r = random.Random(11)
    everyday = [f"say{a}{b}" for a in "abcdefghijklmn" for b in "opqrstuvwxyz"]
    items = []
    for _ in range(3):
        w = [r.choice(everyday) for _ in range(100)]
        w[7::13] = r.sample(VOCABULARY, len(w[7::13]))
        items.append(w)
    docs, want = [], set()
    for k, item in enumerate(items):
        for a in range(61):
            part = item[a : a + 40]
            for i in [i for i in range(1, 39) if part[i] in VOCABULARY][:3]:
                part[i] = "█████"
            want.add((len(docs), k))
            docs.append(" ".join([*r.choices(everyday, k=60), *part, *r.choices(everyday, k=60)]))
    for k, item in enumerate(items):  # four altered: too many
        part = item[20:60]
        for i in (8, 16, 24, 32):
            part[i] = "█████"
        docs.append(" ".join([*r.choices(everyday, k=60), *part, *r.choices(everyday, k=60)]))
    assert set(found(spark, docs, [" ".join(w) for w in items])) == want
