"""Resolution and numbering of spans, by worked examples and properties."""

import random

import pytest
from pyspark.sql import functions as F

from maskframe import catalog as C
from maskframe.operators import detect, mask, spans

PRIORITY = {"p1": 1, "p3": 3, "q1": 1}


def catalog():
    return C.Catalog(tuple(C.Entity(i, i, priority=p) for i, p in PRIORITY.items()))


def span(name, start, end, confidence, entity="p1", source="pattern", seq=0):
    return {"text": name, "start": start, "end": end, "entity_id": entity, "display_name": entity, "confidence": confidence, "source": source, "seq": seq}


CASES = [
    ([span("A", 0, 5, 0.5), span("B", 3, 9, 0.9), span("C", 8, 12, 0.6)], "B"),
    ([span("A", 0, 5, 0.9), span("B", 3, 9, 0.5), span("C", 8, 12, 0.6)], "AC"),
    ([span("A", 0, 5, 0.6), span("B", 3, 9, 0.7), span("C", 8, 12, 0.8)], "C"),
    ([span("A", 0, 5, 0.5), span("B", 5, 9, 0.5)], "AB"),
    ([span("A", 0, 20, 1.0, "p3"), span("B", 4, 9, 1.0, "p1")], "B"),
    ([span("A", 0, 20, 1.0), span("B", 0, 9, 1.0)], "A"),
    ([span("A", 0, 9, 0.93, "p1", "llm"), span("B", 0, 9, 0.93, "q1", "ner")], "B"),
    ([span("A", 0, 9, 0.9, "p1"), span("B", 0, 9, 0.9, "q1")], "A"),
    ([span("A", 0, 9, 0.8), span("B", 0, 9, 0.9)], "B"),
    ([], ""),
]


@pytest.mark.parametrize(("given", "want"), CASES)
def test_fold(given, want):
    given = [s | {"seq": k} for k, s in enumerate(given)]
    assert "".join(s["text"] for s in spans.fold(given, PRIORITY)) == want


def test_both_forms_agree(spark):
    rng = random.Random(5)
    rows = [([span(str(k), a := rng.randint(0, 40), a + rng.randint(1, 15), rng.choice((0.5, 0.7, 1.0)), rng.choice(("p1", "p3", "q1")), rng.choice(("pattern", "ner", "llm")), k) for k in range(rng.randint(0, 12))],) for _ in range(60)]
    rows += [([s | {"seq": k} for k, s in enumerate(g)],) for g, _ in CASES]
    df = spark.createDataFrame(rows, f"s {detect.SPANS}")
    got = df.select(spans.merge_all(F.col("s"), catalog()).alias("a"), spans.dedupe(F.col("s")).alias("d")).select("a", spans.resolve_overlaps(F.col("d"), catalog()).alias("b")).collect()
    for r in got:
        assert r.a == r.b
        assert all(x.end <= y.start for x, y in zip(r.a, r.a[1:], strict=False))


def test_trim(spark):
    rows = [([span("Ann Lee\nDOB", 4, 15, 1.0, "person_name")],), ([span("\nAnn", 0, 4, 1.0, "person_name")],), ([span("A \nB", 0, 4, 1.0, "person_name")],), ([span("A \nB", 0, 4, 1.0, "zipcode")],)]
    got = spark.createDataFrame(rows, f"s {detect.SPANS}").select(spans.trim_multiline(F.col("s"), tuple(C.NO_MULTILINE)).alias("t")).collect()
    assert [[(x.text, x.start, x.end) for x in r.t] for r in got] == [[("Ann Lee", 4, 11)], [], [], [("A \nB", 0, 4)]]


def test_numbers(spark):
    names = ["Bob", "Ann", "Bob", "bob"]
    row = [span(n, 10 * k, 10 * k + 3, 1.0, "person_name") for k, n in enumerate(names)] + [span("a@b.c", 90, 95, 1.0, "email_address")]
    got = spark.createDataFrame([(row,)], f"s {detect.SPANS}").select(mask.number_spans(F.col("s")).alias("n")).first().n
    assert [x.n for x in got] == [1, 2, 1, 3, 1]


def test_threshold(spark):
    own = C.Catalog((C.Entity("p1", "p1", confidence_threshold=0.4), C.Entity("p3", "p3")), default_threshold=0.85)
    df = spark.createDataFrame([([span("a", 0, 2, 0.5, "p1"), span("b", 3, 5, 0.5, "p3"), span("c", 6, 8, 0.9, "zz")],)], f"spans {detect.SPANS}")
    r = spans.merge(df, own).first()
    assert [x.text for x in r.high] == ["a", "c"] and [x.text for x in r.low] == ["b"]


def test_many_spans_in_one_document(spark):
    """20,000 findings are merged, numbered, masked and put together in linear time."""
    import time

    text = " ".join(f"u{k % 15000}@example.com" for k in range(20_000))
    began = time.time()
    row = mask.mask_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), C.load_catalog()).first()
    assert time.time() - began < 60
    assert row.masked_text == " ".join(f"[EMAIL {k % 15000 + 1}]" for k in range(20_000))
    assert len(row.masked_spans) == 20_000 and row.stats.spans_total == 20_000
