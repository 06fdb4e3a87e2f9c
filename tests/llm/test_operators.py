"""The training-data operators against brute force, on small fixtures with awkward rows."""

import hashlib
import math
import random
import re
import textwrap
import zlib

import numpy as np
import pytest
from oracle import compare
from pyspark.sql import functions as F

from maskframe.llm import bpe, chat, decontam, lexical, licenses, linededup, manifest, neardup, pii, quality, secretscan, tokenfile, toxicity
from maskframe.llm import queries as Q

ODD = [None, "", " \n\t ", "word", "é ñ 日本 \U0001f600", "a" * 30_000, "same words here again " * 50, "tie one two three four five", "tie one two three four five"]


def docs(spark, texts, start=0):
    rows = [(start + k, t, "odd", 7) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, w int")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_query_equals_sql(spark, tiny, name):
    compare(spark, tiny, Q.QUERIES[name], Q.ORACLE[name])


@pytest.mark.parametrize("run", [lambda d: pii.digest_pii(d), lambda d: quality.score_quality(d.drop("n_words")), lambda d: neardup.near_duplicates(d), lambda d: bpe.encode_digests(d, Q.tokenizer()), lambda d: secretscan.scan_secrets(d), lambda d: decontam.decontaminate(d, d.select(F.col("doc_id").alias("item_id"), "text"))])
def test_empty_tables(spark, run):
    assert run(docs(spark, ["x"]).where("doc_id < 0")).count() == 0


# 1 PII


def brute_pii(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c in "0123456789"]
        total = sum(sum(divmod(2 * x, 10)) if k % 2 else x for k, x in enumerate(reversed(d)))
        if 16 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_spans_by_brute_force():
    rng = random.Random(3)
    for _ in range(5000):
        t = "".join(rng.choice("ab@@..--11234 +()9é0 \n") for _ in range(rng.randint(0, 40)))
        assert brute_pii(t) == pii.base_spans(t)


def test_pii_digests(spark):
    texts = [*ODD, "x a.b@c.example y 192.168.0.1 z 999.1.1.1", "4111 1111 1111 1111 and +1 (269) 555-3296", "\U0001f600 q@r.st"]
    for r in pii.digest_pii(docs(spark, texts)).collect():
        base = brute_pii(texts[r.doc_id] or "")
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert (r.base_sha256, r.spans) == (sha(listed), listed)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in pii.KINDS]


def luhn_number(k):
    body = f"4{k:014d}"
    return next(body + str(c) for c in range(10) if pii.luhn(body + str(c)))


def test_contexts_find_unseen_identifiers(spark):
    seeds = [f"please charge card number {luhn_number(1000 + k)} today" for k in range(12)]
    bad = luhn_number(77)[:-1] + str((int(luhn_number(77)[-1]) + 1) % 10)
    texts = [*seeds, f"please charge card number {bad} today", "the year number 20240101 is here", "token number AKIA1234567890ABCD9 too"]
    got = {r.doc_id: r.spans for r in pii.digest_pii(docs(spark, texts)).collect()}
    assert got[12] == f"card:26:{26 + len(bad)}"
    assert got[13] == "" and got[14] == ""
    masked = {r.doc_id: r.text for r in pii.mask_pii(docs(spark, texts)).collect()}
    assert masked[0] == "please charge card number [CARD] today" and masked[13] == texts[13]


def test_contexts_find_identifiers_of_several_groups(spark):
    cards = [f"please charge card number {' '.join(re.findall('....', luhn_number(1000 + k)))} today" for k in range(12)]
    phones = [f"then call +1 (269) 555-{3000 + k} today" for k in range(12)]
    texts = [*cards, *phones, "please charge card number 4111 1111 1111 1112 today", "then call (017) 555-7713 today", "at 10.0.0.1 please charge card number 4111-1111-1111-1113, ok", "the year number 2024 01 01 here", "tel: then call tel:555-7713 today"]
    got = {r.doc_id: r.spans for r in pii.digest_pii(docs(spark, texts)).collect()}
    assert [got[k] for k in (24, 25, 27)] == ["card:26:45", "phone:10:24", ""]
    assert got[26] == "ip:3:11,card:38:57"
    assert pii.candidates("tel:555-7713 550e8400-e29b-41d4-a716-446655440000", []) == [(4, 12), (13, 49)]
    assert pii.candidates("4111 1111 1111 1112 3pm", []) == [(0, 19)]
    assert pii.candidates("10.0.0.1 4111 1111 1111 1112", [("ip", 0, 8)]) == [(9, 28)]


def brute_scores(texts):
    """kind of each accepted value, by dictionaries over all texts."""
    seeds, others = set(), set()
    for t in texts:
        base = brute_pii(t or "")
        more = pii.candidates(t or "", base)
        for (k, a, b), ps in zip(base, pii.patterns(t or "", [x[1:] for x in base]), strict=True):
            seeds |= {(k, p, t[a:b]) for p in ps}
        for (a, b), ps in zip(more, pii.patterns(t or "", more), strict=True):
            others |= {(p, t[a:b]) for p in ps}
    own = {v for _, _, v in seeds}
    edges = {(p, v) for p, v in others if v not in own}
    drawn = {}
    for p, v in {(p, v) for _, p, v in seeds} | edges:
        drawn.setdefault(p, set()).add(v)
    good, values = set(), {}
    while True:
        new = {}
        for kind in pii.KINDS:
            for p, all_ in drawn.items():
                held = weight = 0
                for v in all_:
                    if (kind, p, v) in seeds:
                        held, weight = held + 1, weight + 1
                    elif (kind, v) in values:
                        held, weight = held + 1, weight + pii.SUPPORT
                    elif kind == "card" and v not in own and pii.fails_check(v):
                        weight -= 1
                if (kind, p) not in good and held >= pii.MIN_SEEDS and round(weight, 6) / len(all_) >= pii.MIN_SCORE:
                    new[kind, p] = weight / len(all_)
        fresh = {}
        for (kind, p), s in new.items():
            for v in drawn[p] - own:
                if (kind == "email") == ("@" in v) and (kind, v) not in values:
                    fresh[kind, v] = max(fresh.get((kind, v), 0), s)
        if not fresh:
            break
        good |= set(new)
        values |= fresh
    out = {}
    for (kind, v), _ in sorted(values.items(), key=lambda x: (-round(x[1], 6), x[0][0])):
        out.setdefault(v, kind)
    return out


def test_no_circular_evidence(spark):
    """Of one pattern's values 45 are seeds and 55 aren't: none of these is found, at whatever round."""
    texts = [f"charge number {luhn_number(k)}" for k in range(45)] + [f"charge number {20240000 + k}" for k in range(55)]
    got = {r.doc_id: r.n_added for r in pii.digest_pii(docs(spark, texts)).collect()}
    assert sum(got.values()) == 0
    # nine in ten are seeds: the tenth is found
    more = [f"charge number {luhn_number(k)}" for k in range(45)] + [f"charge number {20240000 + k}" for k in range(5)]
    assert sum(r.n_added for r in pii.digest_pii(docs(spark, more)).collect()) == 5


def test_no_card_by_its_shape(spark):
    """Numbers of sixteen digits that fail their check are no cards where words around them don't say so."""
    rng = random.Random(8)
    words = [f"w{k:c}{j:c}" for k in range(97, 117) for j in range(97, 117)]
    wrong = lambda k: (n := luhn_number(k))[:-1] + str((int(n[-1]) + 3) % 10)
    texts = [f"{rng.choice(words)} {rng.choice(words)} {(luhn_number if k % 2 else wrong)(k)} {rng.choice(words)}" for k in range(200)]
    assert sum(r.n_added for r in pii.digest_pii(docs(spark, texts)).collect()) == 0


def test_scores_by_brute_force(spark):
    rng = random.Random(21)
    texts = []
    for k in range(160):
        kind = rng.choice(("card", "card", "card", "bad", "phone", "mail", "mail", "mail", "host", "year", "code"))
        value = {"card": luhn_number(k), "bad": luhn_number(k)[:-1] + "x", "phone": f"+1 (269) 555-{3000 + k}", "mail": f"u{k}@m.example", "host": f"u{k}@m", "year": f"2024{k:04d}", "code": f"AB-{k}77-X"}[kind]
        own = {"card": "pay with card", "bad": "pay with card", "phone": "please call", "mail": "write to", "host": "write to"}.get(kind, "")
        left = own if rng.random() < 0.9 else rng.choice(("card number", "please call", "", "year"))
        texts.append(f"{left} {value} {rng.choice(('today', 'now please', '', 'or later'))}".strip())
    want = brute_scores(texts)
    assert 0 < len(want)
    got = {r.doc_id: r.spans for r in pii.digest_pii(docs(spark, texts)).collect()}
    for k, t in enumerate(texts):
        base = brute_pii(t)
        added = [(want[t[a:b]], a, b) for a, b in pii.candidates(t, base) if t[a:b] in want]
        spans = sorted(base + added, key=lambda s: (pii.KINDS.index(s[0]), s[1]))
        assert got[k] == ",".join(f"{x}:{a}:{b}" for x, a, b in spans)


def test_accepted_values_induce_patterns(spark):
    """Values that one pattern accepts carry another pattern, which then finds what no seed stands beside."""
    first = [f"charge card {luhn_number(1000 + k)} at once" for k in range(40)]
    bad = [f"77-{k:02d}-AB-{k * 37:05d}" for k in range(8)]
    linked = [f"charge card {v} x" for v in bad[:7]]
    second = [f"{'abcdefgh'[k]} under ticket reference {v}" for k, v in enumerate(bad)]
    texts = [*first, *linked, *second, "nothing here 12345-AB"]
    got = {r.doc_id: r.spans for r in pii.digest_pii(docs(spark, texts)).collect()}
    assert got[len(texts) - 2] == f"card:25:{25 + len(bad[7])}"
    assert got[len(texts) - 1] == ""


def test_long_contexts_and_candidates_are_whole(spark):
    word, token = "w" * 500, "Q" + "7" * 300
    texts = [f"{word} number {luhn_number(k)}" for k in range(8)] + [f"{word} number {token}", f"number {token}z"]
    got = {r.doc_id: r.spans for r in pii.digest_pii(docs(spark, texts)).collect()}
    assert got[8] == f"card:508:{508 + len(token)}" and got[9] == ""


def test_masks_of_repeated_and_null_ids(spark):
    d = spark.createDataFrame([(1, "mail a@b.example now", 5), (1, "other text with longer tail c@d.example", 6), (None, "x@y.example", 7), (None, None, 8), (2, "", 9)], "doc_id long, text string, _spans int")
    got = sorted((r._spans, r.text) for r in pii.mask_pii(d.withColumn("row", F.lit(3))).collect())
    assert got == [(5, "mail [EMAIL] now"), (6, "other text with longer tail [EMAIL]"), (7, "[EMAIL]"), (8, None), (9, "")]


# 2 quality


def test_quality_odd_rows(spark):
    got = {r.doc_id: r for r in quality.score_quality(docs(spark, ODD).drop("n_words")).collect()}
    assert [got[k].n_words for k in range(9)] == [0, 0, 0, 1, 4, 1, 200, 6, 6]
    assert got[6].n_repeat_words == 200 and got[6].base_failed and not got[6].kept
    prose = "the cat and the dog went to a house that was on the hill for it is with many trees as seen from town"
    junk = " ".join(w + "###" for w in prose.split())
    d = docs(spark, [prose, junk, None]).drop("n_words")
    assert [r.text for r in quality.keep_good(d).collect()] == [prose]
    assert quality.keep_good(d).columns == d.columns


# 3 near duplicates


def brute_components(texts, words, percent=80):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    label = list(range(len(texts)))
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a and b and 100 * len(a & b) >= percent * len(a | b)]
    for _ in texts:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    return [len(s) for s in sets], label


def near_texts(rng, groups, copies):
    out = []
    for _ in range(groups):
        base = [f"w{rng.randint(0, 400)}" for _ in range(80)]
        for _ in range(copies):
            out.append(" ".join(w if rng.random() > rng.choice((0.005, 0.02, 0.05)) else f"z{rng.randint(0, 9999)}" for w in base))
    return out


@pytest.mark.parametrize("words", [4, 5])
def test_near_duplicates_by_brute_force(spark, words):
    rng = random.Random(words)
    texts = [*ODD, *near_texts(rng, 6, 6), "Tie ONE two three four five", "a b", "a b", "A B c"]
    sizes, label = brute_components(texts, words)
    got = {r.doc_id: r for r in neardup.near_duplicates(docs(spark, texts), words).collect()}
    assert [got[k].component_id for k in range(len(texts))] == label
    assert [got[k].n_shingles for k in range(len(texts))] == sizes
    assert all(got[k].kept == (label[k] == k) for k in got)


def test_near_duplicates_over_several_blocks(spark):
    texts = near_texts(random.Random(1), 2, 40)
    _, label = brute_components(texts, 4)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(spark, texts), 4, block_docs=7).collect()}
    assert [got[k] for k in range(len(texts))] == label


def test_pairs_far_apart_in_a_region_larger_than_a_run(spark):
    """1,400 signatures share the region of one tree only; each pair differs where the order begins, so no run holds both."""
    rng, n = np.random.default_rng(5), 700
    left = rng.integers(0, 256, (n, neardup.SIZE), np.uint8)
    right = left.copy()
    left[:, 3:9], right[:, 3:9] = left[:, 3:9] & 0x7F, right[:, 3:9] | 0x80
    values = np.concatenate([left, right])
    values[:, :3] = 1
    rows = [(k, [0, *(int(x) for x in rng.integers(1, 1 << 60, neardup.TREES - 1))], bytearray(v.tobytes())) for k, v in enumerate(values)]
    got = {r.node: r.component for r in neardup._candidates(spark.createDataFrame(rows, "doc_id long, regions array<long>, values binary")).collect()}
    assert got == {k: k % n for k in range(2 * n)}


@pytest.mark.parametrize("hub", [2, 1000])
def test_components_with_hubs(spark, monkeypatch, hub):
    from maskframe.llm import components as K

    monkeypatch.setattr(K, "HUB_LINKS", hub)
    rng = random.Random(hub)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(150)] + [(7, k) for k in range(400, 440)] + [(k, k + 1) for k in range(500, 540)]
    label = {x: x for e in links for x in e}
    for _ in range(60):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in K.components(spark.createDataFrame(links, "a long, b long")).collect()}
    alone = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
    assert got == {k: v for k, v in label.items() if k not in alone}


def test_components_take_few_rounds_and_tasks(spark, monkeypatch):
    """A chain out of order: no more tasks than its links fill, whatever the number of partitions, and no round where one task holds it."""
    from maskframe.llm import common
    from maskframe.llm import components as K

    files = []

    def stored(df):
        files.append(len((out := common.stored(df)).inputFiles()))
        return out

    monkeypatch.setattr(K, "stored", stored)
    nodes = list(range(300))
    random.Random(4).shuffle(nodes)
    links = spark.createDataFrame(list(zip(nodes[1:], nodes[:-1], strict=True)), "a long, b long")
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "61")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for parts in (4, 1):
            files.clear()
            assert sorted(map(tuple, K.components(links.repartition(parts)).collect())) == [(k, 0) for k in range(300)]
            assert max(files) <= spark.sparkContext.defaultParallelism
        assert len(files) == 2
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_forests_of_links_by_brute_force(monkeypatch):
    import pyarrow as pa

    from maskframe.llm import components as K

    monkeypatch.setattr(K, "FOREST_LINKS", 50)
    rng = random.Random(6)
    for _ in range(200):
        links = [(rng.randint(0, 40), rng.randint(0, 40)) for _ in range(rng.randint(0, 70))]

        def label(links, nodes):
            out = {x: x for x in nodes}
            for _ in range(len(nodes)):
                for a, b in links:
                    out[a] = out[b] = min(out[a], out[b])
            return out

        batches = [pa.RecordBatch.from_pydict({"u": [a for a, _ in some], "v": [b for _, b in some]}, schema=pa.schema([("u", pa.int64()), ("v", pa.int64())])) for some in (links[k : k + 20] for k in range(0, len(links), 20))]
        made = [list(zip(*b.to_pydict().values(), strict=True)) for b in K._forests(iter(batches))]
        nodes = {x for e in links for x in e}
        assert label([e for m in made for e in m], nodes) == label(links, nodes)
        assert all(len({u for u, _ in m}) == len(m) and not {u for u, _ in m} & {v for _, v in m} for m in made)


# 4 decontamination


def brute_hits(text, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        size = min(window, len(v))
        wins = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)} if size else set()
        for i in range(len(w) - size + 1 if size else 0):
            if tuple(w[i : i + size]) in wins:
                hit |= set(range(i, i + size))
                found.add(str(item))
    return len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_decontamination_by_brute_force(spark, block_bytes):
    rng = random.Random(9)
    items = [(k, " ".join(rng.choice("abcde") for _ in range(rng.randint(0, 25)))) for k in range(40)] + [(40, None), (41, "É"), (2, "a b c d e a b c d e a"), (100, "word")]
    texts = [*ODD, *[" ".join(rng.choice("abcdefgh, X.") for _ in range(60)) for _ in range(30)], "é É", "A-b c.d e A b c D e A"]
    bench = spark.createDataFrame([(k, t, "x") for k, t in items], "item_id long, text string, doc_id string")
    for r in decontam.decontaminate(docs(spark, texts), bench, block_bytes=block_bytes).collect():
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute_hits(texts[r.doc_id], items)


# 5 and 9 tokens


TEXTS = [*ODD, "Don't STOP, we're 42 x²!", "a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|>", "ΑΣ ΟΔΟΣ İstanbul ﬁ", "a b\x1cc\x85d", "한국어 क़ é", "...,,, word. word, 3."]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(Q.tokenizer())


def test_bpe_equals_the_library(spark):
    t = library()
    got = {r.doc_id: r for r in bpe.encode_digests(docs(spark, TEXTS), Q.tokenizer()).collect()}
    for k, text in enumerate(TEXTS):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[k].n_tokens == len(ids)
        assert got[k].ids_sha256 == sha(np.array(ids, "<u4").tobytes())
        assert got[k].decoded_sha256 == sha(t.decode(ids, skip_special_tokens=False))


def test_backtracking_equals_merging():
    t, e = library(), bpe.Encoder(bpe.Vocabulary(Q.tokenizer()))
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdethinges'éß9") for _ in range(rng.randint(1, 30))) for _ in range(3000)] + ["x" * 2000, "ab" * 900]
    assert [e.piece(w.encode()) for w in words] == [x.ids for x in t.encode_batch(words, add_special_tokens=False)]


def test_full_table_of_pieces_changes_nothing():
    e = bpe.Encoder(bpe.Vocabulary(Q.tokenizer()))
    encode = lambda pieces: [np.array(e.piece(p), "<u2").tobytes() for p in pieces]
    assert bpe.Pieces(encode, "<u2", 3).texts(TEXTS, 2) == bpe.Pieces(encode, "<u2").texts(TEXTS)


def test_variable_length_codes():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        v = rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)
        assert (tokenfile.unpack(*tokenfile.pack(v), n) == v).all()


def test_token_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "BLOCK_IDS", 40)
    t, out = library(), f"{tmp_path}/tokens"
    tokenfile.write_tokens(docs(spark, TEXTS, start=5).orderBy(F.rand(3)), Q.tokenizer(), out)
    got = sorted(tokenfile.read_tokens(spark, out, "ids_crc32 long").collect(), key=lambda r: r.doc_id)
    start = 0
    for r, text in zip(got, TEXTS, strict=True):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    ids = {r.doc_id: r.ids for r in tokenfile.read_tokens(spark, out).collect()}
    assert ids[8] == [*t.encode("word", add_special_tokens=False).ids, 2]


def test_starts_of_repeated_and_null_ids_agree_with_the_files(spark, tmp_path):
    t, out = library(), f"{tmp_path}/tokens"
    texts = ["one", "two words", "seven words make a text of some length", "x", None, "two words", "end"]
    rows = list(zip([5, 5, 5, None, None, 5, 9], texts, strict=True))
    tokenfile.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), Q.tokenizer(), out)
    got = sorted(tokenfile.read_tokens(spark, out).collect(), key=lambda r: r.start)
    stream = [i for r in got for i in r.ids]
    assert [r.doc_id for r in got] == [None, None, 5, 5, 5, 5, 9]
    assert all(stream[r.start : r.start + r.n_tokens] == r.ids and r.ids[-1] == 2 for r in got)
    assert sorted(r.ids for r in got) == sorted([*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts)


def test_library_encoder_by_pieces():
    t, e = library(), tokenfile.LibraryEncoder(Q.tokenizer())
    rng = random.Random(12)
    parts = ["a", "Q", "é", "É", "ß", "ÿ", "×", "÷", "Ü", "'s", "'", ".", ",", "%%%", "...", "…", "9", "x²", "e\u0301", "\u0338", "<|endoftext|>", "<|", "|>", "\u00a0", "日", "İ", "Σ", "-", "the", "ing", '"', "\\", "@", "_", "~", "\x1c", " ", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(6000)]
    want = [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, e.dtype).tolist() for x in bpe.Pieces(e, e.dtype).texts(texts)] == want
    own = bpe.Encoder(bpe.Vocabulary(Q.tokenizer()))
    assert [np.frombuffer(x, "<u2").tolist() for x in bpe.Pieces(lambda ps: [np.array(own.piece(p), "<u2").tobytes() for p in ps], "<u2").texts(texts)] == want


def test_token_files_of_nothing(spark, tmp_path):
    tokenfile.write_tokens(docs(spark, ["x"]).where("doc_id < 0"), Q.tokenizer(), f"{tmp_path}/tokens")
    assert tokenfile.read_tokens(spark, f"{tmp_path}/tokens").count() == 0


# 6 toxicity


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(2)
    texts, labels = [], []
    for k in range(1500):
        bad = rng.random() < 0.3
        words = [rng.choice(("tree", "house", "river", "stone", "cloud", "you", "walk", "green")) for _ in range(40)]
        for _ in range(3 * bad):
            words[rng.randrange(40)] = rng.choice(("grobnik", "snarkle", "Snarkle!!", "sn4rkle"))
        texts.append(" ".join(words))
        labels.append((k, int(bad), 1))
    d = docs(spark, [*texts, *ODD])
    got = toxicity.score_toxicity(d, spark.createDataFrame([*labels, (3, None, 0)], "doc_id long, toxic int, quality int")).collect()
    assert len(got) == len(texts) + len(ODD)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < len(texts)]
    assert sum(r.predicted == labels[r.doc_id][1] for r in held) >= 0.95 * len(held)


def brute_features(text, words, beginnings):
    edge = "\"'()[]{}<>,;:!?.*#$%&|-_"
    ws = [w.strip(edge) for w in text.lower().split() if w.strip(edge)]
    leet = dict(zip("013457@$!", "oieastasi", strict=True))
    hits, partly, weight, hidden = [], 0, 0.0, 0
    for k, w in enumerate(ws):
        bare = re.sub(r"(.)\1{2,}", r"\1", "".join(c for c in (w if w.isalpha() else "".join(leet.get(c, c) for c in w)) if c.isalnum()))
        if w in words or (not w.isalpha() and bare in words):
            hidden += w not in words
            hits.append(k)
            weight += words.get(w, words.get(bare, 0))
        if w[:4] in beginnings:
            partly += 1
            weight += beginnings[w[:4]]
    you = [k for k, w in enumerate(ws) if w in toxicity.YOU]
    near = sum(any(abs(k - y) <= 5 for y in you) for k in hits)
    odd = sum(any(c.isdigit() for c in w) and any(c.isalpha() for c in w) for w in ws)
    n, chars = max(1, len(ws)), max(1, len(text))
    same = sum(ws[k] == ws[k + 1] for k in range(len(ws) - 1))
    return [len(hits) / n, partly / n, weight / n, near / n, sum(c.isupper() for c in text) / chars, text.count("!") / chars, text.count("?") / chars, sum(c in "#*$%&|<>" for c in text) / chars, (hidden + odd) / n, same / n, np.log(1 + len(ws))]


def test_toxicity_features_by_brute_force():
    rng = random.Random(31)
    words, beginnings = {"idiot": 4.0, "stupid": 3.5, "fool": 3.1}, {"idio": 3.2, "hate": 3.3}
    parts = ["idiot", "1d10t", "stuuuupid", "STUPID!", "st-upid", "fool,", "f0ol", "you", "Your", "hateful", "a1b", "###", "é", "ÑO", "tree", "tree", "?", "du"]
    for _ in range(2000):
        t = " ".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert np.allclose(toxicity.features(t, words, beginnings), brute_features(t, words, beginnings))


def test_toxicity_lexicons_by_brute_force(spark):
    rng = random.Random(32)
    rows = [(int(k % 4 == 0), " ".join(rng.choice(("tree", "house", "river", "stone", "walking")) for _ in range(9)) + (f" grob{k % 3}nik snarkle" if k % 4 == 0 and k % 7 else "")) for k in range(400)]
    pos = sum(y for y, _ in rows)
    count = {}
    for y, t in rows:
        for term in {("w", w) for w in t.split()} | {("b", w[:4]) for w in t.split() if len(w) >= 4}:
            n, hit = count.get(term, (0, 0))
            count[term] = (n + 1, hit + y)
    want = [{}, {}]
    for (kind, term), (n, hit) in count.items():
        odds = np.log((hit + 0.5) / (pos + 1)) - np.log((n - hit + 0.5) / (len(rows) - pos + 1))
        if hit >= toxicity.SUPPORT and odds > 3:
            want["wb".index(kind)][term] = odds
    counted = toxicity._terms(spark.createDataFrame([(k % 3, *row) for k, row in enumerate(rows)], "fold int, toxic int, text string"))
    got = toxicity._lexicons(counted, pos, len(rows) - pos)
    assert all(want) and [set(g) for g in got] == [set(w) for w in want]
    assert all(np.isclose(g[t], w[t]) for g, w in zip(got, want, strict=True) for t in w)


def test_toxicity_of_clashing_rows_is_settled(spark):
    rng = random.Random(33)
    rows = [(k, " ".join(rng.choice(("tree", "house", "river")) for _ in range(12)) + " snarkle grobnik" * (k % 3 == 0)) for k in range(240)]
    clash = [(k, f"other text {k}") for k in range(0, 240, 5)]
    labels = [(k, int(k % 3 == 0)) for k in range(240)] + [(k, 0) for k in range(0, 240, 6)]
    runs = []
    for order in (1, -1):
        d = spark.createDataFrame((rows + clash)[::order], "doc_id long, text string")
        y = spark.createDataFrame(labels[::order], "doc_id long, toxic int")
        runs.append(sorted((r.doc_id, round(r.score, 12)) for r in toxicity.score_toxicity(d, y).collect()))
    assert runs[0] == runs[1] and len(runs[0]) == len(rows) + len(clash)


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {(r.score, r.predicted) for r in toxicity.score_toxicity(docs(spark, ODD), none).collect()} == {(0.0, 0)}


# 7 chat


def test_reply_trees(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good \\h ### </turn>\n", 0.9), (1, 4, 3, "user", "thanks", 0.5), (1, 5, 2, "user", "hm", 0.2), (2, 1, 99, "u:x", None, None), (3, 1, 2, "user", "loop", 1.0), (3, 2, 1, "user", "loop", 1.0), (4, 1, None, "user", "a", 1.0), (4, 1, None, "user", "b", 1.0), (4, 2, 1, "assistant", "c", 1.0)]
    nodes = spark.createDataFrame(rows, "tree int, node int, parent int, role string, text string, score double")
    best = chat.read_chats(chat.format_trees(nodes)).collect()
    got = {r.tree: [(t.role, t.text) for t in r.turns] for r in best}
    assert got == {1: [("user", "q"), ("assistant", "good \\h ### </turn>\n"), ("user", "thanks")], 2: [("u:x", "")], 4: [("user", "a"), ("assistant", "c")]}
    assert next(r.trained for r in best if r.tree == 1) == ["good \\h ### </turn>\n"]
    assert sorted(r.chat for r in chat.format_paths(chat.best_paths(nodes)).collect()) == sorted(r.chat for r in best)
    everything = chat.best_paths(nodes, per_tree=None).groupBy("tree", "leaf", "leaf_copy").count()
    assert sorted((r.tree, r.leaf) for r in everything.collect()) == [(1, 4), (1, 5), (2, 1), (4, 1), (4, 2)]


def test_chat_texts_come_back(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(("\\", "#", "###", "</turn>", "\n", "h", "e", ": ", "é", "### user: ")) for _ in range(rng.randint(0, 12))) for _ in range(200)]
    rows = [(k // 3, k % 3, "assistant" if k % 3 else "user", t) for k, t in enumerate(texts)]
    got = {r.tree: r for r in chat.read_chats(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    for c, r in got.items():
        own = [t for k, t in enumerate(texts) if k // 3 == c]
        assert [t.text for t in r.turns] == own and r.trained == own[1:]


# 8 licences


def test_licences_are_inherited(spark):
    rows = [(1, "a/LICENSE", "This project is\nReleased under the MIT License.\nand more words follow in this long file here"), (2, "a/b/x.py", "code"), (3, "a/c/y.py", "# Licensed under the Apache License, Version 2.0.\ncode code code code code code code code code"), (4, "z/q.py", "code"), (5, None, None), (6, "top.py", ""), (7, "a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."), (7, "a/b/deep/er/w.py", "x")]
    files = spark.createDataFrame(rows, "id int, path string, text string")
    got = sorted((r.id, r.license, r.via, r.from_dir) for r in licenses.scan_licenses(files).collect() if r.id != 5)
    assert got == [(1, "MIT", "own", None), (2, "GPL-3.0", "inherited", "a/b"), (3, "Apache-2.0", "own", None), (4, None, "none", None), (6, None, "none", None), (7, "GPL-3.0", "inherited", "a/b"), (7, "GPL-3.0", "own", None)]
    assert licenses.scan_licenses(files.where("id < 0")).count() == 0


def test_real_licence_files_and_headers(spark):
    quoted = lambda t: t.replace("(the Software)", '(the "Software")').replace("AS IS", '"AS IS"')
    comment = lambda t, mark: "\n".join(f"{mark} {x}".rstrip() for x in t.split("\n"))
    wrap = lambda t: "\n\n".join("\n".join(textwrap.wrap(x, 70)) for x in quoted(t).split("\n"))
    code = "\ndef f(x):\n    return x + 1\n" * 30
    mit, bsd2, bsd3 = licenses._MIT, licenses._BSD.format(third=""), licenses._BSD.format(third=licenses._THIRD)
    gpl = licenses._GNU.format(thing="program", name="General Public License", version=3)
    rows = [
        ("m/LICENSE", "MIT License\n\nCopyright (c) 2021 Some Body\n\n" + wrap(mit), "MIT"),
        ("n/LICENSE", "Copyright (c) 2021 Some Body\n\n" + wrap(mit), "MIT"),
        ("b2/LICENSE.txt", "Copyright 2020, Some Body\n\n" + wrap(bsd2), "BSD-2-Clause"),
        ("b3/COPYING", "Copyright 2020, Some Body\nAll the rest.\n\n" + wrap(bsd3), "BSD-3-Clause"),
        ("isc/LICENSE", "Copyright (c) 2019 A. Person\n\n" + wrap(licenses._ISC), "ISC"),
        ("g/x.c", comment("x.c does things\n\n" + wrap(gpl), " *") + code, "GPL-3.0"),
        ("g2/x.py", comment(wrap(gpl.replace("version 3", "version 2")), "#") + code, "GPL-2.0"),
        ("a/x.java", comment("Copyright 2018 The Authors\n\n" + wrap(licenses._APACHE), "//") + code, "Apache-2.0"),
        ("g3/COPYING", "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\n Preamble\n\n" + "Many other words follow here in long sections. " * 400, "GPL-3.0"),
        ("s/x.rs", "// SPDX-License-Identifier: MIT\n" + code, "MIT"),
        ("s2/x.rs", "// SPDX-License-Identifier: GPL-3.0-or-later\n" + code, "GPL-3.0"),
        ("s3/x.rs", "// SPDX-License-Identifier: Own-1.0\n" + code, None),
        ("no/a.txt", "The permission of the owner is needed, free of charge, for any copy of the key to this house.\nCopyright is a right that the law gives to authors of books, and it ends some decades later.", None),
        ("no/b.txt", "You need a driving license to drive in this country. " * 20, None),
    ]
    files = spark.createDataFrame([(k, p, t) for k, (p, t, _) in enumerate(rows)], "id int, path string, text string")
    got = {r.id: r for r in licenses.scan_licenses(files).collect()}
    assert {k: got[k].license for k in got} == {k: x for k, (_, _, x) in enumerate(rows)}


# 10 secrets


def brute_secrets(text):
    out = [(m.start(), m.end(), "assign") for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[0], secretscan.KINDS.index(s[2])))


def test_secrets_by_brute_force():
    rng, automaton = random.Random(6), secretscan.keyword_automaton()
    parts = ["password", "Passwd", "secret", "TOKEN", "api_key", "apikey", "=", ":", " ", '"', "'", "abc", "AKIA", "AKIAABCDEFGH", "0123456789abcdef", "ff00ff00", "é", "İ", "ſecret", "x_", "tok"]
    for _ in range(5000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert brute_secrets(t) == secretscan.find_secrets(t, automaton)


def test_checksummed_tokens():
    body = "A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5"
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, d = divmod(value, 62)
        digits = secretscan.BASE62[d] + digits
    automaton = secretscan.keyword_automaton()
    good, bad = f"x ghp_{body}{digits} y", f"x ghp_{body}{digits[:-1]}{'0' if digits[-1] != '0' else '1'} y"
    assert [s[2] for s in secretscan.find_secrets(good, automaton)] == ["crc"]
    assert secretscan.find_secrets(bad, automaton) == []
    assert secretscan.bech32_is_right("a", "2uel5l") and not secretscan.bech32_is_right("a", "2uel5m")


def test_secret_rows(spark):
    texts = [*ODD, 'say token = "0641917ea4e9feb9cda83477b57ac2654884f485" now']
    got = {r.doc_id: r for r in secretscan.scan_secrets(docs(spark, texts)).collect()}
    assert got[9].spans == "assign:4:53,hex:13:53" and got[9].base_sha256 == sha(got[9].spans)
    assert (got[0].spans, got[0].n_hex) == ("", 0)


# Null and repeated ids


def test_null_ids(spark, tiny, tmp_path):
    import corpus_pipeline as C

    text, other = " ".join(f"w{k}" for k in range(40)), " ".join(f"v{k}" for k in range(40))
    d = spark.createDataFrame([(None, text), (4, text), (None, other), (None, other), (7, "x"), (None, None), (5, "")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in neardup.near_duplicates(d).collect())
    assert got == [(0, 0, False), (0, 0, True), (0, 0, True), (0, 4, False), (4, 4, True), (5, 5, True), (7, 7, True)]
    stage = sorted((r.doc_id or 0, r.text or "") for r in C.keep_one_of_each(spark, d, tiny).collect())
    assert stage == [(0, ""), (0, other), (4, text), (5, ""), (7, "x")]

    bench = spark.createDataFrame([(None, "w3 w4 w5"), (1, "zz")], "item_id long, text string")
    for size in (1 << 20, 3):
        got = sorted((r.doc_id or 0, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.decontaminate(d, bench, block_bytes=size).collect())
        assert got == [(0, 0, 0, sha(""), False)] * 3 + [(0, 3, 1, sha(""), True), (4, 3, 1, sha(""), True), (5, 0, 0, sha(""), False), (7, 0, 0, sha(""), False)]
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted((r.doc_id or 0, r.text or "") for r in C.keep_clean(spark, d, str(tmp_path)).collect()) == [(0, ""), (0, other), (0, other), (5, ""), (7, "x")]
    m = spark.createDataFrame([(None, "mail a.b@c.example now"), (None, "x"), (1, "at 10.0.0.1 ok")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in C.mask(spark, m, tiny).collect()) == [(0, "mail [EMAIL] now"), (0, "x"), (1, "at [IP] ok")]

    turns = spark.createDataFrame([(None, 0, "user", "q"), (None, 1, "assistant", "a"), (1, 0, "user", "z")], "conv_id long, turn long, role string, text string")
    assert {(r.conv_id, r.n_turns, r.loss_sha256) for r in chat.digest_conversations(spark, turns).collect() if r.conv_id != -7} == {(None, 2, sha("a")), (1, 1, sha(""))}


def test_repeated_ids_through_the_stages(spark, tiny, tmp_path):
    import corpus_pipeline as C

    text, other = " ".join(f"w{k}" for k in range(40)), " ".join(f"v{k}" for k in range(40))
    d = spark.createDataFrame([(1, text), (1, text), (2, text), (3, other), (3, "mail a.b@c.example now"), (4, "x")], "doc_id long, text string")
    assert sorted(map(tuple, C.keep_one_of_each(spark, d, tiny).collect())) == [(1, text), (3, "mail a.b@c.example now"), (3, other), (4, "x")]
    spark.createDataFrame([(1, "v3 v4 v5")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = C.keep_clean(spark, d, str(tmp_path))
    assert sorted(map(tuple, clean.where("doc_id = 3").collect())) == [(3, "mail a.b@c.example now")]
    assert sorted(r.text for r in C.mask(spark, d, tiny).where("doc_id = 3").collect()) == ["mail [EMAIL] now", other]


# Pipeline


def test_pipeline_by_brute_force(spark, tiny):
    import corpus_pipeline as C

    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    good = sorted(r.doc_id for r in Q.op2_quality(spark, tiny).where("kept").collect())
    assert 0 < len(good) < len(rows)
    _, label = brute_components([rows[k] for k in good], 5)
    one = [k for i, k in enumerate(good) if label[i] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    clean = {k for k in one if not brute_hits(rows[k], items)[4]}
    t = library()
    got = C.run(spark, tiny).collect()
    assert {r.doc_id for r in got} == clean and len(got) == len(clean)
    for r in got:
        text, at, out = rows[r.doc_id], 0, ""
        for kind, a, b in sorted(brute_pii(text), key=lambda s: (s[1], s[2], s[0])):
            if a >= at:
                out, at = out + text[at:a] + f"[{kind.upper()}]", b
        ids = t.encode(out + text[at:], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()))
    assert [name for name, _ in C.STAGES] == ["quality", "near_duplicates", "decontamination", "pii", "bpe"] and C.ORACLE_SQL is None


# 8 licences: near misses


def test_near_misses_of_licenses(spark):
    wrong = [
        "Licensed under CC BY-SA 4.0.", "Licensed under CC BY-ND 4.0.", "Licensed under CC BY 3.0.", "Licensed under the Apache License, Version 1.1.", "Subject to the terms of the Mozilla Public License, v. 1.1.",
        "This program is licensed under the GNU General Public License, version 4.", "Licensed under the GNU Lesser General Public License, version 2.1.", "Released under the Eclipse Public License 2.0.", "Released under the Boost License.",
        "This is not released under the MIT License.", "# SPDX-License-Identifier: MIT AND Foo-1.0", "# SPDX-License-Identifier: (MIT OR",
    ]
    right = [("MIT OR Apache-2.0", "// SPDX-License-Identifier: MIT OR apache-2.0"), ("MIT OR GPL-2.0", "# SPDX-License-Identifier: (MIT OR GPL-2.0-only)"), ("GPL-2.0 WITH Classpath-exception-2.0", "/* SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 */"), *licenses.TEMPLATES]
    rows = [(k, f"d{k}/x.py", t) for k, t in enumerate(wrong + [t for _, t in right])]
    got = {r.id: r.license for r in licenses.scan_licenses(spark.createDataFrame(rows, "id int, path string, text string")).collect()}
    assert [got[k] for k in range(len(wrong))] == [None] * len(wrong)
    assert [got[len(wrong) + k] for k in range(len(right))] == [name for name, _ in right]


# 11 ranked lexical search


def brute_ranks(documents, items, k=lexical.TOP):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(d, terms(t)) for d, t in documents]
    held = [(d, w, {x: w.count(x) for x in set(w)}) for d, w in held if w]
    n_docs, n_words = len(held), sum(len(w) for _, w, _ in held)
    out = []
    for item, text in items:
        found = []
        for d, w, tf in held:
            m = 100 - 50 + (50 * len(w) * n_docs) // n_words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in x for _, _, x in held) + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 20 * m)) for t in set(terms(text)) if t in tf)
            if score > 0:
                found.append((-score, d))
        out += [(item, place + 1, d, -s) for place, (s, d) in enumerate(sorted(found)[:k])]
    return out


def test_ranks_by_brute_force(spark, monkeypatch):
    """Small blocks and shards, so that lists are clustered and blocks and lists are skipped."""
    monkeypatch.setattr(lexical, "BLOCK", 4)
    monkeypatch.setattr(lexical, "SHARD_DOCS", 40)
    monkeypatch.setattr(lexical, "ITEM_TERMS", 12)
    monkeypatch.setattr(lexical, "VOCABULARY", 1500)
    rng = random.Random(11)
    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(rng.choices(words, [1 / (k + 1) for k in range(40)], k=rng.randint(1, 60))) for _ in range(150)] + ODD[:-1] + ["W1 w2", "w1 w2", "É w3", "é w3"]
    documents = [(k, t) for k, t in enumerate(texts)]
    items = [(k, " ".join(rng.sample(words, 6))) for k in range(12)] + [(20, None), (21, "nothing of it"), (22, "word É w1 w1"), (23, "é")]
    got = lexical.rank_documents(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"), k=7)
    assert sorted(map(tuple, got.collect())) == sorted(brute_ranks(documents, items, 7))
    got = lexical.rank_documents(docs(spark, texts).repartition(1), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(brute_ranks(documents, items))


def test_blocks_are_skipped_only_below_their_bounds(monkeypatch):
    """Every shard's best are those of scoring all its documents, with and without the table of parts, and some documents are skipped."""
    rng = np.random.default_rng(3)
    # documents of ten topics, so that blocks of similar ones differ
    rows = [np.unique(np.concatenate([rng.integers(0, 20, 6), 100 * rng.integers(0, 10) + 20 + rng.integers(0, 40, 12)])) for _ in range(1500)]
    starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    terms, parts = np.concatenate(rows).astype(np.int32), rng.integers(1000, 900_000, int(starts[-1]))
    made = lexical.block_index(starts, terms, parts)
    monkeypatch.setattr(lexical, "DENSE", 0)
    assert all(np.array_equal(a, made[c]) for c, a in lexical.block_index(starts, terms, parts).items())
    made |= {"keys": np.arange(1500, dtype=np.int64), "starts": starts, "terms": terms, "parts": parts.astype(np.int32)}
    shard = lexical.Shard({c: lexical._packed(made[c]) for c in lexical._INDEX.names})
    skipped = 0
    for _ in range(40):
        item = [(int(t), int(rng.integers(1, 9000))) for t in rng.choice(np.unique(terms), 12, replace=False)]
        weights = dict(item)
        scores = [-sum(weights.get(t, 0) * p for t, p in zip(terms[a:b].tolist(), parts[a:b].tolist(), strict=True)) for a, b in zip(starts, starts[1:], strict=False)]
        want = sorted((s, d) for d, s in enumerate(scores) if s < 0)[:10]
        got, scored = shard.search(item, [], 10)
        assert got == want
        better = [(want[0][0] - 1, -1)] * 10
        again, rescored = shard.search(item, better, 10)
        assert again == better and rescored <= scored
        skipped += sum(s < 0 for s in scores) - scored
    assert skipped > 0


def test_ranks_of_odd_rows(spark):
    documents = spark.createDataFrame([(5, "cat dog", 1), (5, "cat dog", 2), (None, "cat dog", 3), (7, "cat", 4), (1, None, 5), (2, "", 6), (3, "bird", 7)], "doc_id long, text string, score int")
    items = spark.createDataFrame([(1, "dog", "x"), (1, "cat", "y"), (None, "dog", "z")], "item_id long, text string, doc_id string")
    got = [tuple(r)[:3] for r in lexical.rank_documents(documents, items).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, 1, 5), (1, 2, 5), (1, 3, None), (1, 1, 7), (1, 2, 5), (1, 3, 5), (1, 4, None), (None, 1, 5), (None, 2, 5), (None, 3, None)]))
    assert lexical.rank_documents(documents.where("false"), items).count() == 0 and lexical.rank_documents(documents, items.where("false")).count() == 0


# 12 manifest


def brute_manifest(rows):
    """(doc_id, source, leaf, subroot, proof, folded) in order, and the root; ``rows`` of doc_id, source, lang, n_chars, text."""
    h = lambda *parts: sha("".join(parts))
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: h(*map(field, r))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h(*out[-1][k : k + 16]) for k in range(0, len(out[-1]), 16)])
        return out

    def path(tree, at):
        for nodes in tree[:-1]:
            run = nodes[at // 16 * 16 : at // 16 * 16 + 16]
            yield run[: at % 16], run[at % 16 + 1 :]
            at //= 16

    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources}
    trees = {s: levels([leaf(r) for r in own[s]]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for j, r in enumerate(own[s]):
            steps = [*path(trees[s], j), *path(top, k)]
            picked = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            fold = leaf((*r[:4], re.sub("[A-Z]", lambda m: m[0].lower(), r[4]) if r[4] is not None else None)) if picked else leaf(r)
            for before, after in steps:
                fold = h(*before, fold, *after)
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], h(*[x for b, a in steps for x in b + a]), fold, fold == top[-1][0]))
    return out


@pytest.mark.parametrize("sizes", [[1], [17, 1, 300], [2] * 40, [0]])
def test_manifest_by_brute_force(spark, sizes):
    rng = random.Random(sum(sizes))
    rows = [(rng.randrange(10_000), None if k == 0 else f"é{k}" if k % 3 else f"s{k}", rng.choice(["en", None]), rng.choice([None, 7]), rng.choice(ODD[:5] + ["Some Text", "lower text"])) for k, n in enumerate(sizes) for _ in range(n)]
    rows += rows[:3] + [(None, *r[1:]) for r in rows[:2]]
    d = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string")
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    got = manifest.digest_manifest(d).select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_manifest(rows)))


# 13 line dedup


def brute_lines(texts, least=linededup.MIN_DOCS, keep_first=False):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    lines = [(t or "").split("\n") for t in texts]
    found = {}
    for k, own in enumerate(lines):
        for x in own:
            found.setdefault(key(x), {}).setdefault(k)
    seen, out = set(), []
    for own in lines:
        kept = []
        for x in own:
            common = key(x) != "" and len(found[key(x)]) >= least
            if not common or (keep_first and key(x) not in seen):
                kept.append(x)
            seen.add(key(x))
        out.append((len(own), len(own) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("heavy", [False, True])
def test_lines_by_brute_force(spark, heavy, monkeypatch):
    if heavy:
        monkeypatch.setattr(linededup, "SHARE", 1_000)  # what is commonest is counted apart
    rng = random.Random(13)
    pool = ["Menu", " menu\t", "MENU\r", "É", "é", "", "  ", *[f"line {k}" for k in range(60)]]
    texts = ["\n".join(rng.choices(pool, [20] * 7 + [3] * 20 + [1] * 40, k=rng.choice([1, 3, 30, 200]))) for _ in range(60)] + ODD + ["menu\n" * 5000 + "x", "\n\n", "\n"]
    d = docs(spark, texts)
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in linededup.digest_lines(d).collect()}
    assert [got[k] for k in range(len(texts))] == [(n, m, sha(t)) for n, m, t in brute_lines(texts)]
    first = {r.doc_id: r.text for r in linededup.dedup_lines(d, 2, keep_first=True).collect()}
    assert [first[k] for k in range(len(texts))] == [None if x is None else t for x, (_, _, t) in zip(texts, brute_lines(texts, 2, True), strict=True)]


def test_lines_of_odd_rows(spark):
    rows = [(1, "a\nB"), (1, "b\nc"), (None, "B "), (None, None), (2, "")]
    d = spark.createDataFrame([(*r, 5, "k") for r in rows], "doc_id long, text string, n_chars long, keep string")
    got = sorted((str(r.doc_id), str(r.text), r.n_chars) for r in linededup.dedup_lines(d, 3).collect())
    assert got == [("1", "a", 1), ("1", "c", 1), ("2", "", 0), ("None", "", 0), ("None", "None", None)]
    assert linededup.dedup_lines(d.where("false")).count() == 0
    assert sorted((r.n_lines, r.n_dropped) for r in linededup.digest_lines(d, 3).collect()) == [(1, 0), (1, 0), (1, 1), (2, 1), (2, 1)]
    long = "\n".join(f"line {k}" if k % 100 else "again" for k in range(70_000))
    r = linededup.digest_lines(docs(spark, [long, "again", "again\nx"]), 3).where("doc_id = 0").first()
    assert (r.n_lines, r.n_dropped) == (70_000, 700) and r.kept_sha256 == sha("\n".join(x for x in long.split("\n") if x != "again"))


def test_recall_of_near_duplicates(spark):
    """Of the links of every document whose id is divisible by 50 to all others on the larger table, by brute force, at least nine in ten lie in one component."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").collect()]
    sets = {}
    for d, t in rows:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", w) if x]
        sets[d] = {hash(tuple(w[k : k + 4])) for k in range(max(1, len(w) - 3))} if w else set()
    asked = {}
    for d, s in sets.items():
        if d % 50 == 0:
            for x in s:
                asked.setdefault(x, []).append(d)
    links = set()
    for d, s in sets.items():
        shared = {}
        for x in s:
            for q in asked.get(x, ()):
                shared[q] = shared.get(q, 0) + 1
        links |= {(q, d) for q, k in shared.items() if q != d and 100 * k >= 80 * (len(s) + len(sets[q]) - k)}
    found = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), words=4).select("doc_id", "component_id").collect()}
    assert len(links) > 50
    assert sum(found[a] == found[b] for a, b in links) >= 0.9 * len(links)
