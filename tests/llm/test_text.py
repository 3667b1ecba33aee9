"""Ledger, tokenizer, mixing and languages against plain versions."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import bpe, langid, ledger, mixing

FIELDS = {"household_id": "identifier", "source_timestamp_text": "label", "consumption_raw_text": "amount"}
SAME = [
    ["HH0000042", "hh_0000042", "0000042/HH", " HH 0000042\t", " hh0000042 ", "HH000.0042", '"HH0000042"'],
    ["2014-09-23 13:00:00.0000000", "2014-09-23T13:00:00.0000000", "2014-09-23t13-00-00.0000000", "13:00:00.0000000, 2014/09/23", "20140923 130000.0000000", "2014‐09‐23 13:00:00.0000000", " 2014.09.23 13.00.00.0000000 "],
    ["0.50", " 0,50 ", '"0.50"', "[0.50]", "0.50;", "0.50 ", "'0.50'"],
]


def records(spark, data):
    return spark.createDataFrame(data, "source_record_no bigint, household_id string, source_timestamp_text string, consumption_raw_text string")


def pairs(spark, data, batches=1, **kw):
    df = records(spark, data)
    rows = ledger.keyed(df, FIELDS, "source_record_no")
    parts = [ledger.keyed(df.where(F.pmod("source_record_no", F.lit(batches)) == b), FIELDS, "source_record_no") for b in range(batches)]
    return {tuple(r) for r in ledger.copy_pairs(rows, ledger.ledger_of(spark, parts), **kw).collect()}


def test_writings_of_one_record_agree(spark):
    data = [(i, *w) for i, w in enumerate(zip(*SAME), 10)]
    assert pairs(spark, data) == {(10, i) for i in range(11, 17)}


def test_writings_that_differ(spark):
    base = ("HH0000042", "2014-09-23 13:00:00.0000000", "0.50")
    others = [("HH0000043", *base[1:]), (base[0], "2014-09-23 13:30:00.0000000", base[2]), (*base[:2], "0.5"), (*base[:2], "-0.50"), (*base[:2], ".50"), (*base[:2], "050"), (None, *base[1:]), (base[0], None, base[2]), (*base[:2], None), (*base[:2], "")]
    assert pairs(spark, [(i, *r) for i, r in enumerate([base, *others])]) == set()
    signed = [(1, "HH1", "2014-03-29 19:00:00 -05:00", "1"), (2, "HH1", "2014-03-29 19:00:00 +05:00", "1")]
    assert pairs(spark, signed) == set()


def test_batches_give_the_same_ledger_and_keep_the_earliest(spark):
    rng = random.Random(2)
    data = [(i, rng.choice(SAME[0] + ["HH2"]), rng.choice(SAME[1] + ["x"]), rng.choice(SAME[2] + ["1", None])) for i in range(400)]
    rng.shuffle(data)
    one = pairs(spark, data)
    assert one == pairs(spark, data, batches=3) == pairs(spark, data, hot_share=10)
    assert len({a for a, _ in one}) + len(one) <= 400


def test_a_later_session_adds_a_batch_and_reads_its_buckets_alone(spark, tmp_path):
    first = ledger.keyed(records(spark, [(i, f"HH{i:07d}", "x", "1") for i in range(50)]), FIELDS, "source_record_no")
    late = ledger.keyed(records(spark, [(100, "hh-0000007", "X", "1")]), FIELDS, "source_record_no")
    old = ledger.CopyLedger.open(spark, str(tmp_path), buckets=8).update(first)
    new = ledger.CopyLedger.open(spark, str(tmp_path)).update(late, small=True)
    changed = [b for b in range(8) if new.manifest["folders"].get(str(b)) != old.manifest["folders"].get(str(b))]
    assert len(changed) == 1 and new.manifest["version"] == 2 and new.manifest["keys"] == 50
    read = ledger.CopyLedger.open(spark, str(tmp_path)).entries(changed).select("h1")
    assert {f"bucket={changed[0]}" in f for f in read.inputFiles()} == {True} or read.count() < 50
    again = ledger.CopyLedger.open(spark, str(tmp_path))
    assert {(r.first_no, r.copies) for r in again.entries(repeated=True).collect()} == {(7, 2)}
    assert again.entries().count() == 50 and old.entries().count() == 50  # the old version still reads as it was
    with pytest.raises(RuntimeError):
        old.update(late)


def test_buckets_double_as_the_ledger_grows(spark, tmp_path):
    batch = lambda lo, hi: ledger.keyed(records(spark, [(i, f"HH{i:07d}", "x", "1") for i in range(lo, hi)]), FIELDS, "source_record_no")
    book = ledger.CopyLedger.open(spark, str(tmp_path), buckets=2, keys_per_bucket=10).update(batch(0, 100))
    book = book.update(batch(50, 120), small=True)
    assert book.buckets == 16 and book.manifest["keys"] == 120
    assert {(r.copies, r.first_no < 50) for r in book.entries().collect()} == {(1, True), (2, False), (1, False)}
    assert book.entries().where("bucket <> pmod(h1, 16)").count() == 0


def test_empty_ledger(spark):
    assert pairs(spark, []) == set()


@pytest.fixture(scope="module")
def encoder():
    with open(bpe.VOCABULARY, "rb") as f:
        return bpe.SpeculativeBpe(f.read())


@pytest.fixture(scope="module")
def reference():
    import base64

    import tiktoken

    with open(bpe.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [None, "", " ", "a", "  \n\n x  ", "don't I'll WE'RE", "12345 67,8", "éè 測定 \U0001f50c" * 5, "aaaa" * 2000, "=" * 999, "\u0000\u0001", "abcdefghij" * 5000, "<|endoftext|>", "﻿x‍", "'S 's"]


def test_encoding_equals_the_library(encoder, reference):
    rng = random.Random(1)
    alphabet = "abcdeiou \n.,'éßиあ\U0001f600 0123ABC_-" + "th"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(2000)]
    assert encoder.encode_batch(texts) == [reference.encode_ordinary(t) if t else [] for t in texts]


def test_compatibility_decides_exactly(encoder):
    rng = random.Random(7)
    tokens = list(encoder.rank)
    for _ in range(3000):
        word = b"".join(rng.choice(tokens) for _ in range(rng.randrange(1, 5)))
        g = np.array(encoder.greedy(word))
        assert bool(encoder.compatible(g[:-1], g[1:]).all()) == (g.tolist() == encoder.merge(word))


def test_token_ids_and_round_trip(spark, encoder):
    df = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(TEXTS)] + [(None, "x", None)], "doc_id bigint, text string, ids string")
    got = {r.doc_id: r.ids for r in bpe.token_ids(df, ["doc_id"]).collect()}
    back = {r: t for t, r in encoder.rank.items()}
    assert got[0] == got[1] == []
    assert all(b"".join(back[i] for i in got[k]).decode() == (t or "") for k, t in enumerate(TEXTS))
    counts = {r.doc_id: r.n_tokens for r in bpe.token_counts(df, ["doc_id"]).collect()}
    assert counts == {k: len(v) for k, v in got.items()}
    assert bpe.token_ids(df.where("false"), ["doc_id"]).count() == 0


def mix(spark, docs, targets, **kw):
    counts = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint")
    wanted = spark.createDataFrame(targets, "mix_name string, size_factor double, source string, target_share double, max_repeats int")
    return counts, wanted


def test_mixture_reaches_shares_and_caps(spark):
    rng = random.Random(3)
    docs = [(i, rng.choice(["a"] * 8 + ["b", "c", None]), rng.choice([rng.randrange(0, 300), 1, 900])) for i in range(3000)]
    targets = [("m", 0.5, "a", 0.5, 2), ("m", 0.5, "b", 0.3, 3), ("m", 0.5, "c", 0.1, 1), ("m", 0.5, "none", 0.1, 5), ("n", 0.01, "a", 1.0, 1), ("n", 0.01, "c", 0.0, 1)]
    counts, wanted = mix(spark, docs, targets)
    total = sum(n for _, _, n in docs)
    have, size = Counter(), {i: n for i, _, n in docs}
    for _, s, n in docs:
        have[s] += n
    report = {(r.mix_name, r.source): r for r in mixing.shares(counts, wanted, block_tokens=256).collect()}
    for m, f, s, share, reps in targets:
        r = report[m, s]
        assert abs(r.wanted_tokens - f * share * total) < 1e-6 and r.available_tokens == have[s] * reps
        assert r.is_short == (have[s] * reps < r.wanted_tokens)
        assert r.drawn_tokens == (r.available_tokens if r.is_short else math.ceil(r.wanted_tokens))
    rows = mixing.mixture(counts, wanted, block_tokens=256).collect()
    used, slots = defaultdict(set), defaultdict(Counter)
    for r in rows:
        for t in range(r.token_from, r.token_to):
            assert (r.repeat_no, t) not in used[r.mix_name, r.source, r.doc_id] and t < size[r.doc_id]
            used[r.mix_name, r.source, r.doc_id].add((r.repeat_no, t))
        slots[r.mix_name][r.slot, r.source] += r.token_to - r.token_from
    cap = {(m, s): reps for m, _, s, _, reps in targets}
    assert all(max(k for k, _ in v) < cap[m, s] for (m, s, _), v in used.items())
    for m, filled in slots.items():
        drawn = Counter()
        for (slot, s), n in sorted(filled.items()):
            assert n <= 256
            drawn[s] += n
        assert sorted(slot for slot, _ in filled) == list(range(len(filled)))  # no slot is empty or has two sources
        assert all(drawn[s] == report[m, s].drawn_tokens for s in drawn)
        assert sum(n < 256 for n in filled.values()) <= len(drawn)  # all blocks but each source's last are whole


def test_every_prefix_holds_the_shares_that_can_be_reached(spark):
    """A short source, and its repeats, are spread over the whole mix."""
    docs = [(i, "a", 100) for i in range(1000)] + [(5000 + i, "b", 100) for i in range(100)]
    targets = [("m", 1.0, "a", 0.5, 1), ("m", 1.0, "b", 0.5, 2)]
    rows = mixing.mixture(*mix(spark, docs, targets), block_tokens=100).collect()
    last = max(r.slot for r in rows)
    share = sum(r.source == "b" for r in rows) / (last + 1)
    seen = 0
    for r in sorted(rows, key=lambda r: r.slot):
        seen += r.source == "b"
        assert abs(seen - share * (r.slot + 1)) <= 3
    second = [r.slot for r in rows if r.source == "b" and r.repeat_no == 1]
    assert min(second) > last * 0.4 and max(second) > last * 0.9


def test_any_number_of_targets(spark):
    counts, wanted = mix(spark, [(i, f"s{i}", 10) for i in range(10_001)], [("m", 1.0, f"s{i}", 1 / 10_001, 1 + i % 2) for i in range(10_001)])
    report = mixing.shares(counts, wanted, block_tokens=64).groupBy().agg(F.count("*").alias("n"), F.sum("drawn_tokens").alias("t"), F.count_if("is_short").alias("short")).first()
    assert report.n == 10_001 and report.t == 100_010 and report.short <= 10_001


def test_schedule_keeps_shares_on_every_stretch(spark):
    counts, wanted = mix(spark, [(1, "a", 10000), (2, "b", 10000)], [("m", 1.0, "a", 0.7, 1), ("m", 1.0, "b", 0.3, 1)])
    slots = mixing.schedule(mixing.plan(counts, wanted, 10), "wanted_slots", chunk=128).orderBy("slot").collect()
    assert [r.slot for r in slots] == list(range(2000))
    seen = defaultdict(list)
    for r in slots:
        seen[r.source].append(r["rank"])
    assert {s: v == list(range(len(v))) and len(v) for s, v in seen.items()} == {"a": 1400, "b": 600}
    for start in range(0, 1900, 100):
        assert abs(sum(r.source == "a" for r in slots[start : start + 100]) - 70) <= 4


def test_mixture_of_nothing(spark):
    counts, wanted = mix(spark, [], [("m", 1.0, "a", 1.0, 1)])
    assert mixing.mixture(counts, wanted).count() == 0
    assert [r.is_short for r in mixing.shares(counts, wanted).collect()] == [False]
    counts, wanted = mix(spark, [(1, "a", 5)], [])
    assert mixing.shares(counts, wanted).count() == 0


PHRASES = {
    "en": ["the seal on the meter was intact and the terminals were dry", "nobody could explain why the usage rose while the house stood empty", "please do not add the charge until the owner has answered", "we would rather withhold a total than hide a conflict"],
    "de": ["die plombe am zähler war unversehrt und die klemmen waren trocken", "niemand konnte erklären warum der verbrauch im leeren haus stieg", "bitte rechnen sie den zeitpunkt erst ab wenn der mieter geantwortet hat", "wir halten eine summe lieber zurück als einen widerspruch zu verstecken"],
    "ja": ["計器の封印に異常はなく端子も乾いていました", "使用量が増えた理由はまだ誰にも分かっていません", "同じ値が二回書かれているので一回だけ数えてください"],
}


def corpus(n=300, wrong=0.1, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        true = rng.choice(["en", "en", "en", "de", "ja"])
        text = ". ".join(rng.choice(PHRASES[true]) for _ in range(rng.randrange(2, 6))) + "."
        label = true if rng.random() > wrong else rng.choice(["en", "de", "ja", "cy"])
        out.append((i, true, label, text))
    return out


def test_training_forgives_wrong_labels_and_drops_false_classes():
    data = corpus()
    p = langid.train([(label, text) for _, _, label, text in data])
    assert p.langs == ["de", "en", "ja"]
    held_out = corpus(n=200, seed=2)
    judged = langid.judge([t for *_, t in held_out], p)
    assert np.mean([j[0][1] == true for j, (_, true, _, _) in zip(judged, held_out)]) > 0.99


def test_mixed_lines_codes_and_wordless_texts():
    p = langid.train([(label, text) for _, _, label, text in corpus()])
    e, d = PHRASES["en"], PHRASES["de"]
    mixed = f"2016-01-01 00:00:01 INFO [loader] {e[0]}. {e[3]}.\n{d[0].upper()}. {e[1]}!\n\n| a | b |\nSELECT x FROM y;\n{{\"k\": \"v\"}}\ndef f(x):\n# HH0000042 / 17"
    rows = langid.judge([mixed], p)[0]
    assert {(n, lang) for n, lang, _ in rows} == {(0, "en"), (1, "en"), (2, "en"), (2, "de")}
    assert all(0 < c <= 1 for *_, c in rows)
    blank = [None, "", " \n ", "%%% ###", "12 0.5\n7", "\U0001f50c" * 9, "SELECT a FROM b;"]
    assert langid.judge(blank, p) == [[] for _ in blank]
    damaged = ". ".join(d).encode().decode("cp1252")
    assert langid.repaired(damaged) == ". ".join(d) and langid.judge([damaged], p)[0][0][1] == "de"
    assert langid.judge([e[0] + ". " + (e[1] + ". ") * 20000], p)[0][0][:2] == (0, "en")


def test_labels_in_any_spelling(spark):
    cases = {"en": "en", "EN": "en", "en_GB": "en", "English": "en", "deu": "de", "ger": "de", "Deutsch": "de", "fre": "fr", "Français": "fr", "日本語": "ja", "uk-UA": "uk", " ": None, "": None, "??": None, "und": None, None: None, "xx": "xx"}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "lang string, want string")
    assert all(r.got == r.want for r in df.select("want", langid.label_code(F.col("lang")).alias("got")).collect())


def test_languages_over_a_table(spark):
    data = corpus(n=120)
    df = spark.createDataFrame([(i, label, text, "clash") for i, _, label, text in data] + [(900, None, None, ""), (None, "de", PHRASES["en"][0], "")], "doc_id bigint, lang string, text string, line_no string")
    judged = langid.languages(df, langid.fit_profiles(df))
    got = {r.doc_id: r.lang for r in judged.where("line_no = 0").collect()}
    assert all(got[i] == true for i, true, _, _ in data) and 900 not in got
    wrong = {r.doc_id for r in langid.wrong_labels(judged).collect()}
    assert wrong == {i for i, true, label, _ in data if true != label} | {None}
    assert langid.languages(df.where("false"), langid.fit_profiles(df.where("false"))).count() == 0


def test_a_short_line_in_another_language_is_found():
    p = langid.train([(label, text) for _, _, label, text in corpus()])
    note = ". ".join(PHRASES["en"]) + "\nKlemmen trocken"
    assert {(n, lang) for n, lang, _ in langid.judge([note], p)[0]} == {(0, "en"), (1, "en"), (2, "de")}
    assert (langid.margins(np.array([6, 12, 24, 400])) == langid.MARGIN * np.array([4, 2, 1, 1])).all()


def test_more_than_two_hundred_label_codes(spark):
    """Every code that names documents of its own is a class, however many there are."""
    rng = random.Random(5)
    words = {c: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(6)] for c in range(201)}
    data = [(201 * k + c, f"l{c:03d}", " ".join(rng.choice(words[c]) for _ in range(12))) for c in range(201) for k in range(6)]
    df = spark.createDataFrame(data, "doc_id bigint, lang string, text string")
    p = langid.fit_profiles(df)
    assert len(p.langs) == 201
    judged = langid.judge([t for _, _, t in data], p)
    assert np.mean([j[0][1] == c for j, (_, c, _) in zip(judged, data)]) > 0.99


def test_languages_without_any_label(spark):
    """From the seeds alone; three phrases are too few to find Japanese by, so two languages are asked for."""
    data = [r for r in corpus(n=260) if r[1] != "ja"]
    df = spark.createDataFrame([(i, None, text) for i, _, _, text in data], "doc_id bigint, lang string, text string")
    got = {r.doc_id: r.lang for r in langid.languages(df, langid.fit_profiles(df)).where("line_no = 0").collect()}
    assert np.mean([got[i] == true for i, true, _, _ in data]) > 0.95


def test_pattern_is_the_published_one():
    public = pytest.importorskip("public_tokenizers")
    assert public.PATTERN == bpe.PATTERN
    assert re.compile("x")
