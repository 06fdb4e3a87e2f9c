"""Detection, masks and whole jobs."""

import hashlib
import hmac
import json
import re

import pytest
from pyspark.sql import functions as F

from maskframe import catalog as C
from maskframe.functions import masking as M
from maskframe.operators import detect as D
from maskframe.operators import mask, report
from maskframe.plans.forms import FORMS
from maskframe.sources import files
from maskframe.streaming import stream


def found(text, *ids):
    c = C.load_catalog()
    return {(s["entity_id"], s["text"]) for s in D.Rules(c.only(*ids) if ids else c).scan(text)}


@pytest.mark.parametrize(
    ("text", "entity", "value"),
    [
        ("SSN: 219-09-9999", "ssn", "219-09-9999"),
        ("card 4111 1111 1111 1111 ok", "credit_card_number", "4111 1111 1111 1111"),
        ("IBAN GB82 WEST 1234 5698 7654 32", "iban", "GB82 WEST 1234 5698 7654 32"),
        ("host 192.0.2.17 up", "ip_address", "192.0.2.17"),
        ("host 2001:db8::1 up", "ip_address", "2001:db8::1"),
        ("DOB: 01/02/1990", "date_of_birth", "01/02/1990"),
        ("admission date 03/04/2024", "clinical_date", "03/04/2024"),
        ("MRN: A1B2C3", "medical_record_number", "A1B2C3"),
        ("Claim No: 88771", "claim_number", "88771"),
        ("😀 a@b.example", "email_address", "a@b.example"),
        ("seen at Mercy General Hospital today", "hospital_name", "Mercy General Hospital"),
        ("account 12345678901", "bank_account_number", "12345678901"),
        ("password: hunter22", "password", "hunter22"),
        ("mac 00:1A:2B:3C:4D:5E", "device_identifier", "00:1A:2B:3C:4D:5E"),
    ],
)
def test_rules(text, entity, value):
    assert (entity, value) in found(text)
    assert all(text[s["start"] : s["end"]] == s["text"] for s in D.Rules(C.load_catalog()).scan(text))


def test_checksums():
    assert D.luhn("4111111111111111") and not D.luhn("4111111111111112")
    assert D.iban("GB82 WEST 1234 5698 7654 32") and not D.iban("GB83 WEST 1234 5698 7654 32")


def test_rules_of_a_file_with_digits_that_may_be_absent(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"entities": [{"id": "a", "display_name": "A", "patterns": [r"ID-[A-Z]+\d*"]}, {"id": "b", "display_name": "B", "patterns": [r"[^\d\s]{8,}"]}]}))
    got = [(s["entity_id"], s["text"]) for s in D.Rules(C.load_catalog(str(path))).scan("the ID-ABC of somebodyelse")]
    assert got == [("a", "ID-ABC"), ("b", "somebodyelse")]


def test_bad_rule_is_left_out():
    c = C.Catalog((C.Entity("x", "x", patterns=("(", "a+")),))
    assert [s["text"] for s in D.Rules(c).scan("caat")] == ["aa"]


@pytest.mark.parametrize(
    ("raw", "ok", "n"),
    [('[{"e":"ssn","t":"1"},', True, 1), ('[{"e":"a","t":"b"},{"e":"c","t":"d', True, 1), ("no array", False, 0), ("", True, 0), (None, True, 0), ('```json\n[{"e":"a","t":"b"}]\n```', True, 1), ('[1,{"e":"a","t":"b"}]', True, 1), ("[", True, 0)],
)
def test_responses(raw, ok, n):
    got = D.parse_response(raw)
    assert (got[0], len(got[1])) == (ok, n)


def test_find_all():
    assert D.find_all("aaaa", "aa") == [(0, 2), (1, 3), (2, 4)]
    assert D.find_all("bob Bob", "BOB") == [(0, 3), (4, 7)]
    assert D.find_all("bob Bob", "Bob") == [(4, 7)]
    assert D.find_all("abc", "") == []


def test_budget(spark):
    rows = spark.createDataFrame([(0,), (10,), (100,)], "n int")
    assert [r.b for r in rows.select(D.token_budget(F.col("n"), 1024).alias("b")).collect()] == [256, 370, 1024]
    assert rows.where("n = 100").select(D.token_budget(F.col("n"), 0).alias("b")).first().b == 1536


def test_render_and_hmac(spark):
    df = spark.createDataFrame([("abc",), ("{n}é",)], "v string")
    got = df.select(M.mask_value("ssn", "hash", "[{label}:{hash8}:{zzz}:{{x}}:{encrypted}]", F.col("v"), F.lit(1)).alias("m"), M.hmac_sha256(F.col("v"), "k" * 80).alias("h"), M.mask_value("ssn", "partial_redact", "{last4}", F.col("v"), F.lit(1)).alias("l")).collect()
    for r, v in zip(got, ("abc", "{n}é"), strict=True):
        assert r.m == f"[SSN:{hashlib.sha256(v.encode()).hexdigest()[:8]}:{{zzz}}:{{x}}:{{encrypted}}]"
        assert r.h == hmac.new(b"k" * 80, v.encode(), "sha256").hexdigest()
    assert got[0].l == "abc"
    with pytest.raises(ValueError):
        M.mask_value("ssn", "encrypt", "{encrypted}", F.col("v"), F.lit(1))


def test_catalog(tmp_path):
    c = C.load_catalog()
    assert len(c.entities) == 103 and len(C.builtin_entities()) == 104
    assert len(C.load_catalog(enabled_policies=("transportation",)).entities) == 4
    assert c.threshold("religion") == 0.95 and c.threshold("nothing") == 0.85
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"entities": [{"id": "a", "display_name": "A", "masking": {"strategy": "hash", "format": "{hash8}"}}, {"id": "b", "display_name": "B", "enabled": False}]}))
    assert [e.id for e in C.load_catalog(str(path)).entities] == ["a"]
    path.write_text(json.dumps({"entities": [{"id": "a", "display_name": "A", "masking": {"strategy": "rot13"}}]}))
    with pytest.raises(C.CatalogError):
        C.load_catalog(str(path))
    with pytest.raises(C.CatalogError):
        C.load_catalog(str(tmp_path / "none.yaml"))


def test_masking_job(spark):
    rows = [(1, "Mail a@b.example or a@b.example, or c@d.example; SSN 219-09-9999."), (2, " \n"), (3, None), (4, "x" * 500_001), (5, "x" * 500_000), (6, "nothing here")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r.doc_id: r for r in mask.mask_documents(df, C.load_catalog()).collect()}
    assert set(got) == {1, 5, 6}
    assert got[1].masked_text == "Mail [EMAIL 1] or [EMAIL 1], or [EMAIL 2]; SSN [SSN 1]."
    assert [m.start for m in got[1].masked_spans] == sorted((m.start for m in got[1].masked_spans), reverse=True)
    assert got[6].masked_text == "nothing here" and got[1].stats.spans_total == 4
    assert {r.doc_id: r.reject_reason for r in mask.rejects(df).collect()} == {2: "empty", 3: "empty", 4: "too_long"}
    assert mask.mask_documents(df.where("doc_id < 0"), C.load_catalog()).count() == 0


def plain_spans(text, c):
    """start, end, entity, score of all rules and recognisers, one after another and without any quick test."""
    out = []
    for name, entity in c.recognizers().items():
        pattern, check, score, words = D.RECOGNIZERS.get(name, (re.compile("(?!)"), None, 0.0, ""))
        for m in pattern.finditer(text):
            near = words and re.search(words, text[max(0, m.start() - 40) : m.start()], re.I)
            score_here = 0.85 if near else score
            if (check is None or check(m[0])) and score_here >= D.MIN_SCORE:
                out.append((m.start(), m.end(), entity, score_here))
    for e in c.entities:
        for p in e.patterns:
            for m in re.finditer(p, text, re.I | re.M):
                at = 1 if m.lastindex else 0
                if m.end(at) > m.start(at):
                    out.append((m.start(at), m.end(at), e.id, 1.0))
    return out


def plain_merge(spans, c):
    """What is left of the spans of a document: compared pair by pair."""
    priority = {e.id: e.priority for e in c.entities}
    once = [s for k, s in enumerate(spans) if not any(o[:3] == s[:3] and (o[3] > s[3] or o[3] == s[3] and j < k) for j, o in enumerate(spans))]
    kept = []
    for s in sorted(once, key=lambda s: s[0]):
        rank = lambda x: (-x[3], priority[x[2]], x[0] - x[1])
        if not kept or s[0] >= kept[-1][1]:
            kept.append(s)
        elif rank(s) < rank(kept[-1]):
            kept[-1] = s
    return kept


def test_whole_catalogue_by_brute_force(spark, tiny):
    c = C.load_catalog()
    planted = [(-k, f"{before}{value or ''}{after}".replace("{}", "4821")) for k, (_, before, value, after) in enumerate(FORMS, 1)]
    planted.append((0, "\n".join(t for _, t in planted) + "\nA\nMRN: A1-4821 and MRN: A1-4822, MRN: A1-4821"))
    df = spark.read.parquet(f"{tiny}/documents.parquet").select(F.col("doc_id").cast("int").alias("doc_id"), "text").unionByName(spark.createDataFrame(planted, "doc_id int, text string"))
    found = {r.doc_id: r for r in D.detect_rules(df, c, "text").collect()}
    assert all(sorted((s.start, s.end, s.entity_id, s.confidence) for s in r.spans) == sorted(plain_spans(r.text or "", c)) for r in found.values())
    done = mask.mask_documents(df, c).collect()
    assert sum(len(r.detected_spans) for r in done) > len(FORMS) // 2
    for r in done:
        text, want = r.text_clean, []
        for a, b, entity, score in plain_merge(plain_spans(r.text_clean, c), c):
            if entity in c.no_multiline and "\n" in text[a:b]:
                b = a + len(text[a:b].split("\n")[0].rstrip())
                if b - a < 2:
                    continue
            want.append((a, b, entity, score))
        assert [(s.start, s.end, s.entity_id, s.confidence) for s in r.detected_spans] == want
        values = {e: list(dict.fromkeys(text[a:b] for a, b, x, _ in want if x == e)) for e in {w[2] for w in want}}
        masks = {m.start: m for m in r.masked_spans}
        for a, b, entity, _ in reversed(want):
            e = c.by_id()[entity]
            n = values[entity].index(text[a:b]) + 1
            if e.strategy == "redact" and "{label}" not in e.format:
                assert masks[a].masked == e.format.replace("{n}", str(n))
            assert (masks[a].entity_id, masks[a].original) == (entity, text[a:b])
            text = text[:a] + masks[a].masked + text[b:]
        assert r.masked_text == text


def test_masking_needs_no_shuffle(spark, tiny):
    df = mask.mask_documents(spark.read.parquet(f"{tiny}/documents.parquet"), C.load_catalog())
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_copies_masked_once_give_the_same(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(["a@b.example x", "a@b.example x", "y", "z 192.0.2.1"])], "doc_id int, text string")
    get = lambda d: {r.doc_id: r.masked_text for r in d.collect()}
    assert get(mask.mask_distinct(df, C.load_catalog())) == get(mask.mask_documents(df, C.load_catalog()))


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(k, f"user{k % 3}@example.com at 192.0.2.{k}") for k in range(20)], "doc_id int, text string")
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("doc_id int, text string").parquet(f"{tmp_path}/in")
    stream.mask_stream(source, C.load_catalog(), f"{tmp_path}/out", f"{tmp_path}/state", once=True).awaitTermination()
    get = lambda d: {r.doc_id: r.masked_text for r in d.collect()}
    assert get(spark.read.parquet(f"{tmp_path}/out")) == get(mask.mask_documents(df, C.load_catalog()))


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one\ntwo a@b.example")
    (tmp_path / "in" / "b.json").write_text('{"k": "a@b.example"}')
    (tmp_path / "in" / "c.pdf").write_text("no")
    df = files.read_files(spark, f"{tmp_path}/in")
    assert {r.file_name: r.text for r in df.collect()} == {"a.txt": "one\ntwo a@b.example", "b.json": '{"k": "a@b.example"}'}
    files.write_masked(mask.mask_documents(df, C.load_catalog()), f"{tmp_path}/out")
    got = {r.file_name: r.masked_text for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {"a.txt": "one\ntwo [EMAIL 1]", "b.json": '{"k": "[EMAIL 1]"}'}
    df.write.json(f"{tmp_path}/j")
    assert files.read_records(spark, f"{tmp_path}/j", "json", key=None).count() == 2
    files.write_results(mask.mask_documents(df, C.load_catalog()), f"{tmp_path}/r")
    assert spark.read.json(f"{tmp_path}/r").count() == 2


def test_model_layer_and_report(spark):
    c = C.load_catalog()
    label = {v: k for k, v in c.labels().items()}["person_name"]
    df = spark.createDataFrame([("d1", "Ann Lee met Bob. " * 200), ("d2", "no one")], "doc_id string, text string")
    got = mask.mask_with_model(df, c, D.gazetteer({label: ["Ann Lee", "Bob"]}))
    r = {x.doc_id: x for x in got.collect()}
    assert r["d1"].masked_text.startswith("[PERSON 1] met [PERSON 2]. [PERSON 1]") and r["d1"].stats.spans_ner == 400
    assert r["d2"].masked_text == "no one"
    counts = report.entity_counts(report.explode_spans(got)).collect()
    assert [(x.entity_id, x.n) for x in counts] == [("person_name", 400)]


def test_review(spark):
    c = C.load_catalog()
    df = spark.createDataFrame([("a", "Bob is here"), ("b", "Bob is here"), ("c", "")], "doc_id string, text_clean string")
    answers = spark.createDataFrame([("a", 0, '[{"e":"person_name","t":"Bob"},{"e":"nope","t":"here"}]', True), ("b", 0, "[]", False)], "doc_id string, chunk_idx int, raw string, call_ok boolean")
    good, bad = D.ingest_responses(df, answers, c)
    assert {r.doc_id: [(s.text, s.start, s.confidence) for s in r.llm_spans] for r in good.collect()} == {"a": [("Bob", 0, 0.93)], "c": []}
    assert [r.doc_id for r in bad.collect()] == ["b"]
