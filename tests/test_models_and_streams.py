"""Tagger, interval joins, reviewed values, stand-ins, JSON and streams against brute force and after failures."""

import itertools
import json
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskframe import catalog as cat
from maskframe.functions import masking, text
from maskframe.operators import detect, mask, tagger
from maskframe.plans import queries as Q
from maskframe.streaming import stream

MAIL = cat.load_catalog().only("email_address", "ssn")


def rows(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string")


@pytest.fixture(scope="module")
def names(spark, tiny):
    return Q.name_tagger(spark, tiny)


def test_best_tags_by_brute_force():
    rng = np.random.default_rng(5)
    tags = ["B-x", "I-x", "O"]
    words = [f"a{k}" for k in range(6)]
    for _ in range(60):
        seen = {f: rng.normal(size=3) for own in tagger.features(words) for f in own if rng.random() < 0.7}
        model = tagger.Tagger(tags, rng.normal(size=3), rng.normal(size=(3, 3)), seen, dict.fromkeys(tagger.KINDS, np.zeros(3)))
        shown = model.emissions(words)
        score = lambda row: model.opens[row[0]] + sum(shown[k, t] for k, t in enumerate(row)) + sum(model.steps[a, b] for a, b in itertools.pairwise(row))  # noqa: B023, E731
        every = list(itertools.product(range(3), repeat=len(words)))
        best = max(every, key=score)
        assert score(model.decode(words)) == pytest.approx(score(best))
        weights = np.exp([score(r) for r in every])
        sure = [[weights[[r[k] == t for r in every]].sum() / weights.sum() for t in range(3)] for k in range(len(words))]
        assert np.allclose(model.certainty(words), sure)


def test_counts_don_t_depend_on_partitions(spark, tiny):
    few = Q.sentences(spark, tiny).where("doc_id < 200")
    counts = [sorted(map(tuple, tagger.count_features(few.repartition(n)).collect())) for n in (1, 7)]
    assert counts[0] == counts[1] and len(counts[0]) > 100


def test_held_out_names(spark, tiny, names):
    """Recall and precision of words in names that the tagger has not seen in these sentences."""
    hit = found = wanted = 0
    for r in Q.sentences(spark, tiny).where("NOT train").collect():
        want = {k for s in r.spans for k in range(s.start, s.end)}
        got = {k for a, b, _, _ in names.spans(r.text) for k in range(a, b)}
        hit, found, wanted = hit + len(want & got), found + len(got), wanted + len(want)
    assert hit >= 0.97 * wanted and hit >= 0.97 * found
    assert names.spans("") == [] and names([None or "", "x"], [], 0.1) == [[], []]


def test_tagger_as_recognizer(spark):
    label = lambda a, b, name: {"start": a, "end": b, "label": name}
    data = [(f"we met {n} at {o} today", [label(7, 7 + len(n), "PERSON"), label(11 + len(n), 11 + len(n) + len(o), "ORG")]) for n in ("Ada Miller", "Bo Lee", "Cy Stone") for o in ("Delta Works", "Iron Supply")]
    model = tagger.train_tagger(spark.createDataFrame(data * 3 + [(None, []), ("nothing here", None)], "text string, spans array<struct<start:int,end:int,label:string>>"))
    c = cat.load_catalog().only("person_name", "organization_name")
    got = mask.mask_documents(rows(spark, [(1, "we met Al Berg at North Mill today")]), c, mask.MaskOptions(tagger=model)).first()
    assert got.masked_text == "we met [PERSON 1] at [COMPANY 1] today" and got.stats.spans_ner == 0


def test_model_spans_of_null_and_repeated_ids(spark):
    c = cat.load_catalog().only("person_name")
    find = detect.gazetteer({c.entities[0].label or c.entities[0].display_name: ["Ann Smith"]})
    data = [(1, "My friend Ann Smith lives here now"), (1, "Other text of Ann Smith, quite longer, with a tail"), (None, "Ann Smith here"), (None, None), (2, "")]
    got = {(r.doc_id, r.masked_text) for r in mask.mask_with_model(rows(spark, data), c, find).collect()}
    assert got == {(1, "My friend [PERSON 1] lives here now"), (1, "Other text of [PERSON 1], quite longer, with a tail"), (None, "[PERSON 1] here")}


def test_answers_of_numbered_rows(spark, tmp_path):
    docs = rows(spark, [(1, "call Ann"), (1, "call Bob"), (None, "call Cy"), (None, "no answer"), (2, "  ")]).withColumnRenamed("text", "text_clean")
    numbered = detect.numbered_rows(docs, f"file://{tmp_path}/rows")
    c = cat.load_catalog().only("person_name")
    ready = numbered.withColumn("spans", F.array().cast(detect.SPANS))
    prompts = detect.build_review_prompts(ready, c, key="row_id")
    assert prompts.count() == 5
    answer = F.when(F.col("prompt").contains("no answer"), "sorry").otherwise(F.concat(F.lit('[{"e":"person_name","t":"'), F.regexp_extract("prompt", "call (\\w+)", 1), F.lit('"}]')))
    good, bad = detect.ingest_responses(numbered, prompts.select("row_id", "chunk_idx", answer.alias("raw"), F.lit(True).alias("call_ok")), c, key="row_id")
    got = {(r.doc_id, r.text_clean, *[s.text for s in r.llm_spans]) for r in good.collect()}
    assert got == {(1, "call Ann", "Ann"), (1, "call Bob", "Bob"), (None, "call Cy", "Cy"), (2, "  ")}
    assert [r.reject_reason for r in bad.collect()] == ["review_failed"]


def test_overlaps_in_one_long_document(spark):
    """20,000 spans over 500,000 characters: equal to a comparison of all, and not all are compared."""
    rng = random.Random(2)
    spans = [(7, "e", "t", a := rng.randrange(500_000), a + rng.randint(1, 40)) for _ in range(20_000)] + [(7, "e", "long", 100, 400_000)]
    chunks = [(7, k, o, "x" * 3500) for k, o in enumerate(range(0, 500_000, 3300))] + [(None, 0, 5, "abc"), (8, 0, 0, "")]
    c = spark.createDataFrame(chunks, "doc_id long, chunk_idx int, offset int, chunk string")
    s = spark.createDataFrame(spans, "doc_id long, entity_id string, text string, start int, end int")
    met = detect.candidates_of_chunks(c, s)
    got = sorted((r.chunk_idx, r.start, r.end) for r in met.where("doc_id = 7").collect())
    want = sorted((k, a, b) for _, k, o, p in chunks[:-2] for *_, a, b in spans if a < o + len(p) and b > o)
    assert got == want
    assert met.where("doc_id IS NULL OR doc_id = 8").where("start IS NULL").count() == 2
    parts = [(o, p) for _, _, o, p in chunks[:-2]]
    listed = [{"start": a, "end": b, "seq": k} for k, (*_, a, b) in enumerate(spans)]
    began = time.time()
    assert [len(x) for x in detect.inside(parts, listed)] == [sum(k == j for j, _, _ in want) for k in range(len(parts))]
    assert time.time() - began < 5


def test_values_by_brute_force():
    def brute(t, value):
        out, at = [], t.find(value)
        while at >= 0 and value:
            out.append((at, at + len(value)))
            at = t.find(value, at + 1)
        return out or [m.span() for m in re.finditer(re.escape(value), t, re.I) if value]

    rng = random.Random(4)
    for _ in range(2000):
        t = "".join(rng.choice("aAbBßſsSéÉµμ ") for _ in range(rng.randint(0, 20)))
        values = ["".join(rng.choice("aAbBßſsSéÉµμ ") for _ in range(rng.randint(0, 3))) for _ in range(4)]
        got = detect.find_values(t, values)
        assert all(got.get(v, []) == brute(t, v) for v in values)
    words = [f"value{k:05d}" for k in range(5000)]
    long = " ".join(words * 10)
    began = time.time()
    assert sum(map(len, detect.find_values(long, [w.upper() for w in words]).values())) == 50_000
    assert time.time() - began < 10


def test_review_goes_on_where_it_stopped(spark, tmp_path):
    prompts = spark.createDataFrame([(1, 0, 300), (1, 1, 300), (None, 0, 1000)], "doc_id long, chunk_idx int, max_tokens int")
    asked = []

    def ask(todo):
        got = todo.collect()
        asked.append(sorted((r.chunk_idx, r.attempt, r.max_tokens) for r in got))
        if len(asked) == 2:
            raise RuntimeError("stopped")
        return spark.createDataFrame([(r.doc_id, r.chunk_idx, "[]" if r.chunk_idx else '[{"e":"x"', r.chunk_idx != 1 or r.attempt > 1) for r in got], "doc_id long, chunk_idx int, raw string, call_ok boolean")

    path = f"file://{tmp_path}/ledger"
    with pytest.raises(RuntimeError):
        detect.review(prompts, ask, path)
    got = {(r.doc_id, r.chunk_idx): (r.attempt, r.ok, r.max_tokens) for r in detect.review(prompts, ask, path).collect()}
    assert asked[0] == [(0, 1, 300), (0, 1, 1000), (1, 1, 300)]
    assert asked[1] == asked[2] == [(0, 2, 600), (0, 2, 1536), (1, 2, 300)]
    assert asked[3] == [(0, 3, 1200), (0, 3, 1536)]
    assert got == {(1, 0): (3, False, 1200), (1, 1): (2, True, 300), (None, 0): (3, False, 1536)}


def test_stand_ins_differ(spark):
    values = spark.range(100_000).select(F.concat(F.lit("value "), F.col("id").cast("string")).alias("v"))
    made = masking.stand_ins(masking.permuted(F.col("v"), "a key"))
    counts = values.select(*[c.alias(n) for n, c in made.items()]).agg(*[F.count_distinct(n).alias(n) for n in made]).first().asDict()
    assert counts == dict.fromkeys(made, 100_000)
    one = lambda key: spark.range(1).select(masking.stand_ins(masking.permuted(F.lit("Ann"), key))["fake_name"].alias("x")).first().x
    assert one("k") == one("k") != one("other") and re.fullmatch("([A-Z][a-z]+ ?){3}", one("k"))


def test_json_leaves_in_place(spark):
    odd = '{ "mail" :\t"x\\u0041 a@b.example \\"q\\"" , "n":[1.50,-0,1e5,null,"caf\\u00e9"],"mail":"A@b.example\\ud800 a@b.example"}'
    deep = "[" * 100_000 + '"write a@b.example"' + "]" * 100_000
    data = [(1, odd), (2, deep), (3, "{bad"), (4, None), (5, ""), (6, '"a@b.example"'), (7, '{"k":"a@b.example",}')]
    got = {r.doc_id: r.masked_text for r in mask.mask_json(rows(spark, data), MAIL).collect()}
    assert got[1] == '{ "mail" :\t"xA [EMAIL 1] \\"q\\"" , "n":[1.50,-0,1e5,null,"caf\\u00e9"],"mail":"[EMAIL 2]\\ud800 [EMAIL 1]"}'
    assert got[2] == deep.replace("a@b.example", "[EMAIL 1]")
    assert [got[k] for k in (3, 4, 5, 6, 7)] == [None, None, None, '"[EMAIL 1]"', None]
    quote = cat.Catalog((cat.Entity("email_address", "Email", recognizer="EMAIL_ADDRESS", format='"{n}\\'),))
    assert json.loads(mask.mask_json(rows(spark, [(1, '["a@b.example"]')]), quote).first().masked_text) == ['"1\\']


def test_json_strings_by_the_parser():
    rng = random.Random(6)

    def make(depth=0):
        r = rng.random()
        if depth > 4 or r < 0.4:
            return rng.choice(["abcd", 'é\n"x\\', "", 1, -2.5e10, True, None, "\U0001f600 okay"])
        if r < 0.7:
            return [make(depth + 1) for _ in range(rng.randint(0, 4))]
        return {rng.choice("abc") + str(k): make(depth + 1) for k in range(rng.randint(0, 4))}

    def leaves(v, path=""):
        if isinstance(v, dict):
            return [x for k, w in v.items() for x in leaves(w, f"{path}.{k}" if path else k)]
        if isinstance(v, list):
            return [x for k, w in enumerate(v) for x in leaves(w, f"{path}[{k}]")]
        return [(path, v)] if isinstance(v, str) and len(v) > 3 else []

    for _ in range(1500):
        v = make()
        s = json.dumps(v, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        assert text.walk_json(s) == leaves(v)
        k = rng.randrange(len(s))
        broken = s[:k] + rng.choice('{}[],:"x1 -\\') + s[k + rng.randint(0, 1) :]
        try:
            json.loads(broken)
            parses = True
        except ValueError:
            parses = False
        assert (text.json_strings(broken) is not None) == parses


def test_stream_that_stops_between_its_writes(spark, tmp_path):
    """The job stops after rejects were written and before masked rows were; started again, nothing is lost or doubled."""
    at = f"file://{tmp_path}"
    data = [(k, " " if k % 4 == 0 else f"mail u{k}@x.example") for k in range(40)] + [(None, "mail n@x.example"), (None, None)]
    rows(spark, data).repartition(4).write.parquet(f"{at}/in")
    source = lambda: spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(f"{at}/in")

    def stop(batch_id):
        if batch_id == 1:
            raise RuntimeError("stopped here")

    with pytest.raises(Exception, match="stopped here"):
        stream.mask_with_rejects(source(), MAIL, f"{at}/out", f"{at}/state", once=True, between=stop).awaitTermination()
    assert {r.batch_id for r in spark.read.parquet(f"{at}/out/rejects").collect()} >= {0}
    stream.mask_with_rejects(source(), MAIL, f"{at}/out", f"{at}/state", once=True).awaitTermination()
    masked = sorted(str(r.doc_id) for r in spark.read.parquet(f"{at}/out/masked").collect())
    bad = sorted(str(r.doc_id) for r in spark.read.parquet(f"{at}/out/rejects").collect())
    assert masked == sorted(str(k) for k, t in data if t and t.strip()) and bad == sorted(str(k) for k, t in data if not t or not t.strip())


def test_progress_keeps_the_last_batches():
    heard = stream.Progress(most=3)
    for k in range(10):
        event = type("E", (), {"progress": type("P", (), {"id": "q", "batchId": k, "observedMetrics": {"masking": Counts(documents=2, spans_found=3, spans_kept=2, spans_masked=1)}})})
        heard.onQueryProgress(event)
    assert [r[0] for r in heard.rows()] == [7, 7, 8, 8, 9, 9] and heard.rows()[0] == (7, "merge", 3, 2, 1)


class Counts(dict):
    def asDict(self):  # noqa: N802
        return dict(self)


def test_names_of_one_s_own():
    c = cat.load_catalog(names={"bank_name": ("Moon Bank of Io",)}).only("bank_name")
    found = lambda t: [s["text"] for s in detect.Rules(c).scan(t)]
    assert found("at Moon Bank of Io now")[0] == "Moon Bank" and "Moon Bank of Io" in found("at Moon Bank of Io now") and found("at Wells Fargo now") == []


def test_tagger_takes_texts_together(spark, tiny, names):
    """Many texts at once give what each gives alone, long ones beside empty ones, in far less time than word by word."""
    texts = [r.text for r in Q.sentences(spark, tiny).where("doc_id < 300").collect()] + ["", " \n", "Ada"]
    texts.append(" ".join(texts) * 20)
    texts *= 3
    together = names.spans_of(texts)
    assert together == [own for t in texts for own in [names.spans(t)]] and sum(map(len, together)) > 1000
    began = time.time()
    names.spans_of(texts[:300] * 100)
    assert time.time() - began < 12


def test_made_sentences_go_to_all_cores(spark, tiny):
    assert Q.sentences(spark, tiny).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["mask_json_leaves", "rule_forms_merged", "locate_detections", "masked_inventory", "mask_names"])
def test_made_texts_go_to_all_cores(spark, tiny, name):
    """A table of keys is one split, however many rows it has; its texts are scanned by as many tasks as there are cores, and more."""
    assert f"RoundRobinPartitioning({max(4 * spark.sparkContext.defaultParallelism, 4)})" in Q.QUERIES[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["masked_inventory", "model_spans", "tagger_spans", "rule_forms_merged", "locate_detections", "rule_spans_documents", "span_detail"])
def test_texts_are_scanned_once(spark, tiny, name):
    """No helper's call stands twice in a plan: an explode's filter would repeat it."""
    plan = Q.QUERIES[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    nodes = re.findall(r"ArrowEvalPython \[(\w+)\(", plan)
    assert nodes and len(nodes) == len(set(nodes)), nodes


def test_totals_of_chunks_without_pairs(spark):
    """Counts and sums by brute force, and for 300,000 spans under each of 20,000 equal chunks, whose pairs nobody could go through."""
    rng = random.Random(3)
    spans = [(rng.choice([None, 1, 2]), a := rng.randrange(9000), a + rng.choice([1, 5, 40, 5000])) for _ in range(400)]
    chunks = [(rng.choice([None, 1, 2, 3]), k, rng.randrange(9000), "x" * rng.choice([0, 1, 700, 3500])) for k in range(200)]
    c = spark.createDataFrame(chunks, "doc_id long, chunk_idx int, offset int, chunk string")
    s = spark.createDataFrame(spans, "doc_id long, start int, end int")
    got = {(r.chunk_idx, r.n, r.total) for r in detect.totals_of_chunks(c, s, F.col("start") + 3 * F.col("end")).collect()}
    met = [(k, [a + 3 * b for d, a, b in spans if d == doc and a < o + len(t) and b > o]) for doc, k, o, t in chunks]
    assert got == {(k, len(x), sum(x)) for k, x in met}
    many = spark.range(300_000).select(F.lit(1).cast("long").alias("doc_id"), (F.col("id") % 100).alias("start"), (F.col("id") % 100 + 1).alias("end"))
    wide = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("chunk_idx"), F.lit(0).alias("offset"), F.lit("x" * 100).alias("chunk"))
    assert detect.totals_of_chunks(wide, many, F.lit(1)).where("n = 300000 AND total = 300000").count() == 20_000


def test_words_are_those_of_an_expression():
    """Words and signs by the classes of characters, over all kinds of these."""
    rng = random.Random(8)
    texts = ["".join(rng.choice(["a", "Z", "_", "7", " ", "\n", "\x1c", "\x85", "\u00a0", "-", "'", "é", "\u0301", "ß", "漢", "٣", "²", "😀", "\u200b", "\ufeff", chr(rng.randrange(0xD800)), chr(rng.randrange(0xE000, 0x110000))]) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    begin, end, words, first, begins = tagger.words_of(texts)
    for k, t in enumerate(texts):
        own = range(first[k], first[k + 1])
        assert [(begin[j] - begins[k], end[j] - begins[k], words[j]) for j in own] == [(*m.span(), m[0]) for m in re.finditer(r"\w+|[^\w\s]", t)]


def test_tagger_keeps_what_words_show(names, monkeypatch):
    """A word that comes again in a later batch costs no more than a look for it, and tags and scores stay those of sums word by word."""
    made = []
    plain = getattr(tagger.shape, "__wrapped__", tagger.shape)
    monkeypatch.setattr(tagger, "shape", lambda w: made.append(w) or plain(w))
    texts = [f"{k % 50} we met Alba Bardale of North Works Inc at {k % 70} noon" for k in range(2000)]
    once = names.spans_of(texts)
    assert len(set(made)) == len(made)
    assert names.spans_of(texts[::-1]) == once[::-1] and len(set(made)) == len(made)
    words = texts[3].split()
    shown, ahead = names.emissions(words), []
    for k in range(len(words)):
        ahead.append(shown[k] + (np.logaddexp.reduce(ahead[-1][:, None] + names.steps, axis=0) if k else names.opens))
    later = [np.zeros(len(names.tags))]
    for k in range(len(words) - 1, 0, -1):
        later.insert(0, np.logaddexp.reduce(names.steps + (shown[k] + later[0])[None, :], axis=1))
    both = np.array(ahead) + np.array(later)
    assert (names.certainty(words) == np.exp(both - np.logaddexp.reduce(both, axis=1)[:, None])).all()


def test_spans_go_to_arrow_by_field(spark):
    span = {"text": "é", "start": 1, "end": 2, "entity_id": "ssn", "display_name": "SSN", "confidence": 0.5, "source": "ner", "seq": 0}
    rows_of = [[], [span, span | {"seq": 1, "display_name": None}], None, [span]]
    assert detect.span_arrays(rows_of).to_pylist() == rows_of
    got = spark.createDataFrame([(1, "Ann"), (2, None)], "doc_id long, text string").repartition(1)
    c = cat.load_catalog().only("person_name")
    plan = mask.mask_with_model(got, c, detect.gazetteer({next(iter(c.labels())): ["Ann"]}))
    assert plan.first().detected_spans[0].asDict() == {"text": "Ann", "start": 0, "end": 3, "entity_id": "person_name", "display_name": c.entities[0].display_name, "confidence": 0.9, "source": "ner", "seq": 0}
    assert mask.mask_with_model(got.where("doc_id > 9"), c, detect.gazetteer({})).collect() == []


def test_spans_of_some_texts_at_once(spark, monkeypatch):
    """A batch goes to the model in runs of texts of a bounded size; rows and their order stay, also of one text beyond that size and of empty batches."""
    c = cat.load_catalog().only("person_name")
    label, most = next(iter(c.labels())), mask.SCANNED
    size = spark.sparkContext.accumulator(0)

    def find(texts, labels, threshold):
        size.add(max(0, sum(map(len, texts)) - most - 200_000 - len(texts) * 200))
        return [[(t.index("Ann"), t.index("Ann") + 3, label, 0.9)] if "Ann" in t else [] for t in texts]

    docs = spark.range(60).select("id", F.concat(F.lit("Ann "), F.expr("repeat(concat('x', id, ' '), 40000)")).alias("text")).coalesce(1)
    got = {r.id: r for r in mask.mask_with_model(docs, c, find).select("id", "masked_text", "text_clean").collect()}
    assert sorted(got) == list(range(60)) and size.value == 0
    assert all(r.masked_text == "[PERSON 1] " + r.text_clean[4:] and r.text_clean.endswith(f"x{k}") for k, r in got.items())


def failing_scorer(label, short=False):
    """Finds Ann, and fails on texts with the word bad: it throws, or answers for no chunk."""

    def find(texts, labels, threshold):
        if any("bad" in t for t in texts):
            if short:
                return []
            raise ValueError("unreadable")
        return [[(t.index("Ann"), t.index("Ann") + 3, label, 0.9)] if "Ann" in t else [] for t in texts]

    return find


@pytest.mark.parametrize("short", [False, True])
def test_failure_of_a_model_is_no_masked_text(spark, short):
    """A document that the model fails on, in its second chunk only, has an error and no text; the others are masked."""
    c = cat.load_catalog().only("person_name", "email_address")
    data = [(1, "hello Ann"), (2, "Ann a@b.example " + "x " * 1000 + "bad"), (3, "no one")]
    got = {r.doc_id: (r.masked_text, r.layer_error, len(r.masked_spans)) for r in mask.mask_with_model(rows(spark, data).coalesce(1), c, failing_scorer({v: k for k, v in c.labels().items()}["person_name"], short)).collect()}
    assert got == {1: ("hello [PERSON 1]", None, 1), 2: (None, "ValueError", 0), 3: ("no one", None, 0)}
    assert "layer_error" in Q.QUERIES["mask_with_model"](spark, "/root/testdata/sf0.001").columns


@pytest.mark.parametrize("short", [False, True])
def test_failure_of_a_model_ends_the_job_or_is_named(spark, short):
    """Spans of chunks that weren't scored are no empty result: the job ends, or a column has the error."""
    c = cat.load_catalog().only("person_name")
    docs = rows(spark, [(1, "hello Ann"), (2, "Ann " + "x " * 1000 + "bad"), (3, "no one"), (4, None)]).coalesce(1)
    find = failing_scorer(*c.labels(), short)
    with pytest.raises(Exception, match="0 of 6 chunks|0 of 2 chunks" if short else "unreadable"):
        detect.score_chunks(docs, c, find, text="text").collect()
    got = {r.doc_id: (r.spans if r.spans is None else [s.text for s in r.spans], r.wrong) for r in detect.score_chunks(docs, c, find, text="text", error="wrong").collect()}
    assert got == {1: (["Ann"], None), 2: (None, "ValueError"), 3: ([], None), 4: ([], None)}


@pytest.mark.parametrize("name", ["model_spans", "tagger_spans"])
def test_queries_end_where_their_model_fails(spark, tiny, monkeypatch, name):
    def fails(texts, labels, threshold):
        raise ValueError("unreadable")

    monkeypatch.setattr(detect, "gazetteer", lambda phrases: fails)
    monkeypatch.setattr(Q, "name_tagger", lambda spark, sf_dir: fails)
    with pytest.raises(Exception, match="unreadable"):
        Q.QUERIES[name](spark, tiny).collect()
