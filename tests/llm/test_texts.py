"""Operators on single texts and whole tables, against plain code."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartonscope.llm import decontamination as D
from cartonscope.llm import line_dedup as LD
from cartonscope.llm import lm, mixing, quality_classifier, quality_rules, toxicity
from cartonscope.llm.common import BLANKS, NOT_ALNUM, Words, packed, slices, texts_of, unpacked

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def crc(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())


def by_row(found, *names):
    return Counter(tuple(r[n] for n in names) for r in found.collect())


# ---- shared parts ----------------------------------------------------------------------------

@pytest.mark.parametrize("separators, pattern", [(BLANKS, WORD), (NOT_ALNUM, ALNUM)])
def test_word_hashes_follow_the_words(rows, separators, pattern):
    import pyarrow as pa
    texts = [r[1] for r in rows]
    words, number, back = Words(separators), {}, {}
    for at, end, data, bounds in slices(pa.array(texts, pa.string()), 5_000):
        hashes, starts, per_text = words(data, bounds)
        want = [pattern.findall(low(t or "")) for t in texts[at:end]]
        assert [len(w) for w in want] == per_text.tolist()
        flat = [w for ws in want for w in ws]
        last = words.last_bytes(data, bounds)
        assert [bytes(words.fold[data[a:b + 1]]).decode() for a, b in zip(starts, last)] == flat
        for h, w in zip(hashes.tolist(), flat):
            assert number.setdefault(w, h) == h and back.setdefault(h, w) == w


def test_integers_pack_and_unpack():
    for dtype in (np.uint8, np.int32, np.int64):
        for n in (0, 1, 1000):
            x = (np.arange(n) * 7919 % 251).astype(dtype)
            assert (unpacked(packed(x), n, dtype) == x).all()


def test_sliced_columns_keep_their_texts():
    import pyarrow as pa
    data, offsets = texts_of(pa.array(["ab", None, "", "cde", "f"]).slice(1, 3))
    assert bytes(data) == b"cde" and offsets.tolist() == [0, 0, 0, 3]


# ---- language model --------------------------------------------------------------------------

def test_lm_counts_and_base_scores(docs, rows):
    counts = Counter()
    for i, text, *_ in rows:
        if crc(i) % 7 != 2:
            counts.update([*WORD.findall(low(text or "")), None])
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, text, *_ in rows:
        words = [*WORD.findall(low(text or "")), None]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        want[i, crc(i) % 7 == 2, len(words), sum(counts[w] > 0 for w in words), n, round(base, 4)] += 1
    got = lm.score(docs).withColumn("base_score", F.round("base_score", 4)).cache()
    assert by_row(got, "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score") == want
    assert got.filter("score > 0 or score is null").isEmpty()


def test_lm_of_nothing(no_docs):
    assert lm.score(no_docs).collect() == []


def test_lm_beats_the_unigram_on_held_out_text(spark):
    from tests.llm.conftest import SF
    held = lm.score(spark.read.parquet(f"{SF}/documents.parquet")).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


def test_model_is_a_distribution_over_symbols():
    vocabulary = object.__new__(lm.Vocabulary)
    rng = np.random.default_rng(1)
    mass = rng.random((lm.CLASSES, lm.WITHIN)) + 0.1
    vocabulary.class_bias = np.log(mass.sum(1) / mass.sum()).astype(np.float32)
    vocabulary.symbol_bias = np.log(mass / mass.sum(1, keepdims=True)).astype(np.float32)
    model = lm.Model(vocabulary)
    model.classes[:] = rng.normal(size=model.classes.shape)
    model.within[:] = rng.normal(size=model.within.shape)
    slots = np.repeat(rng.integers(0, lm.SLOTS, (len(lm.TEMPLATES), 1)), lm.SYMBOLS, 1).astype(np.uint16)
    assert abs((10 ** model.log10(np.arange(lm.SYMBOLS), slots)).sum() - 1) < 1e-4


def test_gradient_steps_raise_the_likelihood():
    vocabulary = object.__new__(lm.Vocabulary)
    vocabulary.class_bias = np.full(lm.CLASSES, -np.log(lm.CLASSES), np.float32)
    vocabulary.symbol_bias = np.full((lm.CLASSES, lm.WITHIN), -np.log(lm.WITHIN), np.float32)
    symbols = np.tile([3, 40, 200, 40], 500).astype(np.int64)
    slots = lm.features(symbols, np.array([len(symbols)]), 0)
    model = lm.Model(vocabulary)
    before = model.log10(symbols, slots).sum()
    for _ in range(20):
        model.update(symbols, slots, 0.6)
    assert model.log10(symbols, slots).sum() > 0.2 * before


def test_features_do_not_cross_texts():
    symbols = np.array([5, 6, 9, 7, 9])
    apart = lm.features(symbols, np.array([3, 2]), 9)
    alone = lm.features(symbols[3:], np.array([2]), 9)
    assert (apart[:, 3:] == alone).all()


# ---- mixing ----------------------------------------------------------------------------------

def targets(sizes, weights=(3, 1, 2), share=1.5):
    """Repeats the rule as told: share by weight, cap at twice the size, reshare until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    goal, capped = {}, set()
    while True:
        left = share * sum(sizes.values()) - sum(2 * sizes[s] for s in capped)
        total = sum(weight[s] for s in names if s not in capped)
        goal = {s: 2 * sizes[s] if s in capped else left * weight[s] / total for s in names}
        above = {s for s in names if s not in capped and goal[s] > 2 * sizes[s]}
        if not above:
            return goal
        capped |= above


def test_mixing_targets_and_draws(docs, rows):
    sizes = Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len(WORD.findall(text or ""))
    goal = targets(sizes)
    mixed = mixing.mix(docs).cache()
    assert mixed.count() == len(rows) and set(docs.columns) <= set(mixed.columns)
    again = mixing.mix(docs.repartition(5))
    columns = ("doc_id", "mix_size", "mix_copies")
    assert by_row(mixed, *columns) == by_row(again, *columns)
    for r in mixed.groupBy("source").agg(F.first("mix_target"), F.first("mix_source_size"), F.sum(F.col("mix_size") * F.col("mix_copies")),
                                         F.max("mix_copies"), F.max("mix_size")).collect():
        assert r[2] == sizes[r[0]] and abs(r[1] - goal[r[0]]) < 1e-6 * max(1, goal[r[0]])
        assert abs(r[3] - goal[r[0]]) <= 2 * r[5] and r[4] <= 2
    assert mixing.emitted(mixed).count() == mixed.agg(F.sum("mix_copies")).first()[0]


def test_mixing_of_nothing_and_of_no_words(spark, no_docs):
    assert mixing.mix(no_docs).collect() == []
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert {(r.mix_target, r.mix_size) for r in mixing.mix(blank).collect()} == {(0.0, 0)}


# ---- line dedup ------------------------------------------------------------------------------

def test_common_lines_go_everywhere(docs, rows):
    key = lambda line: low(line.strip(" \t\n\x0b\x0c\r"))
    found = Counter(k for _, text, *_ in rows for k in {key(x) for x in (text or "").split("\n")})
    want = Counter()
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 1 and found[key(x)] >= 10)]
        want[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    for batches, fanout in ((4, 3), (5, 2)):
        got = LD.dedup_lines(docs, batches=batches, fanout=fanout)
        assert by_row(got, "doc_id", "line_n", "line_dropped", "line_kept") == want


def test_runs_compact_to_the_same_keys(spark):
    runs, total = LD.LineRuns(min_docs=6, fanout=2), Counter()
    for k in range(7):
        counts = {f"{x}".encode(): 1 + (x + k) % 2 for x in range(0, 40, k + 1)}
        total.update(counts)
        runs.add(spark.createDataFrame([(bytearray(a), b) for a, b in counts.items()], "line_key binary, n long"))
    assert {bytes(r.line_key) for r in runs.common().collect()} == {k for k, n in total.items() if n >= 6}
    assert all(len(level) < 2 for level in runs.levels)


def test_line_dedup_of_nothing(no_docs):
    assert LD.dedup_lines(no_docs).collect() == []


# ---- decontamination -------------------------------------------------------------------------

def test_phrases_equal_a_plain_search(spark, docs, rows):
    base = [r[1] for r in rows if r[1]]
    items = [(1, " ".join(base[0].split()[30:55])), (2, base[1][:400].upper()), (3, "one, TWO"), (4, None), (5, "... !"), (6, "one"),
             (7, " ".join(base[0].split()[30:55])), (None, "again and again again"), (8, "nothing here is anywhere at all in those texts we made")]
    windows = {}
    for item, text in items:
        words = ALNUM.findall(low(text or ""))
        size = min(10, len(words))
        for k in range(len(words) - size + 1 if size else 0):
            windows.setdefault(tuple(words[k:k + size]), set()).add(item)
    sizes = {len(w) for w in windows}
    want = Counter()
    for n, (i, text, *_) in enumerate(rows):
        words, hit, found = ALNUM.findall(low(text or "")), set(), set()
        for size in sizes:
            for k in range(len(words) - size + 1):
                if (w := tuple(words[k:k + size])) in windows:
                    hit |= set(range(k, k + size))
                    found |= windows[w]
        want[n, len(words), len(hit), tuple(sorted(map(str, found - {None}))), None in found] += 1
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    numbered = spark.createDataFrame([(n, r[1]) for n, r in enumerate(rows)], "bench_row long, text string").repartition(3)
    for chars in (D.BLOCK_CHARS, 200):
        got = Counter((r.bench_row, r.n_words, r.n_hit, tuple(sorted(x for x in r["items"] if x is not None)), None in r["items"])
                      for r in D.contamination(numbered, benchmark, block_chars=chars).collect())
        assert got == want
    clean = D.without_contaminated(docs, benchmark.filter("item_id <> 3 and item_id <> 6"))
    assert clean.columns == docs.columns and 0 < clean.count() < len(rows)


def test_proximity_takes_moved_terms(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    texts = [item, item.replace("delta epsilon", "epsilon delta"), item.replace("gamma", "gamma x y z v w"), "alpha kappa"]
    docs = spark.createDataFrame(list(enumerate(texts)), "bench_row long, text string")
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.bench_row: (r["items"], r.near_items, r.n_hit) for r in D.contamination(docs, benchmark, slop=1).collect()}
    assert got == {0: (["1"], [], 10), 1: ([], ["1"], 0), 2: ([], [], 0), 3: ([], [], 0)}


def plain_matches(words, window, slop):
    """Whether the window stands in words exactly, and whether with every term within slop of its place."""
    at = {}
    for k, w in enumerate(words):
        at.setdefault(w, []).append(k)
    exact = any(words[k:k + len(window)] == window for k in range(len(words)))
    near = any(all(any(abs(p - k - d) <= slop for p in at.get(w, ())) for d, w in enumerate(window))
               for k in range(-slop, len(words) + slop))
    return exact, near


@pytest.mark.parametrize("window, slop", [(4, 1), (5, 2), (10, 1)])
def test_proximity_equals_a_plain_search(spark, window, slop):
    import random
    rng = random.Random(window)
    vocabulary = [f"w{k}" for k in range(12)]
    weights = [2 ** -k for k in range(12)]
    items = {1: "alpha beta rare gamma delta eps zeta eta theta iota".split()[:window]}
    items |= {k: rng.choices(vocabulary, weights, k=rng.randrange(1, window + 3)) for k in range(2, 12)}
    middle = list(items[1])
    middle[1], middle[2] = middle[2], middle[1]  # the rarest term of the corpus is the moved one
    texts = [items[1], middle, *[items[1][:2]] * 3, *[items[1][3:]] * 3, []]
    for _ in range(60):
        words = list(rng.choice(list(items.values()))) + rng.choices(vocabulary, weights, k=rng.randrange(12))
        for _ in range(rng.randrange(4)):
            a = rng.randrange(len(words))
            b = min(len(words) - 1, a + rng.randrange(3))
            words[a], words[b] = words[b], words[a]
        texts.append(words)
    want = {}
    for n, words in enumerate(texts):
        found = {k: [plain_matches(words, item[j:j + min(window, len(item))], slop) for j in range(max(1, len(item) - window + 1))]
                 for k, item in items.items()}
        exact = {str(k) for k, f in found.items() if any(e for e, _ in f)}
        want[n] = (sorted(exact), sorted({str(k) for k, f in found.items() if any(x for _, x in f)} - exact))
    assert want[1] == ([], ["1"]) and sum(len(near) for _, near in want.values()) > 20
    docs = spark.createDataFrame([(n, " ".join(w)) for n, w in enumerate(texts)], "bench_row long, text string").repartition(3)
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    hits = {r.bench_row: r.n_hit for r in D.contamination(docs, benchmark, window).collect()}
    for chars in (D.BLOCK_CHARS, 100):
        got = D.contamination(docs, benchmark, window, slop, chars).collect()
        assert {r.bench_row: (sorted(r["items"]), sorted(r.near_items)) for r in got} == want
        assert {r.bench_row: r.n_hit for r in got} == hits


def test_proximity_query_keeps_the_exact_columns(spark):
    from cartonscope.llm.queries import op9_decontamination, op9_proximity
    from tests.llm.conftest import SF
    exact, near = op9_decontamination(spark, SF), op9_proximity(spark, SF)
    assert near.columns == [*exact.columns, "near_items"]
    assert by_row(near, *exact.columns) == by_row(exact, *exact.columns)


def test_repeated_and_null_ids_stay_rows_of_their_own_in_several_blocks(spark):
    leak, other, clean = "alpha beta gamma delta", "one two three four", "nothing to see here at all"
    rows = [(1, f"{leak} {other}"), (1, f"{leak} {other}"), (1, clean), (2, other), (2, leak), (None, leak), (None, clean), (None, None), (3, clean)]
    docs = spark.createDataFrame(rows, "bench_row long, text string").repartition(3)
    benchmark = spark.createDataFrame([(k, t) for k, t in enumerate([leak, other, "five six seven eight", "nine ten eleven twelve"])],
                                      "item_id long, text string")
    want = Counter((i, len((t or "").split()), 4 * sum(x in (t or "") for x in (leak, other)),
                    tuple(str(k) for k, x in enumerate((leak, other)) if x in (t or ""))) for i, t in rows)
    for chars in (D.BLOCK_CHARS, 10):
        got = D.contamination(docs, benchmark, block_chars=chars)
        assert Counter((r.bench_row, r.n_words, r.n_hit, tuple(sorted(r["items"]))) for r in got.collect()) == want


def test_decontamination_of_nothing(spark, no_docs):
    empty = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b"), (2, None)], "bench_row long, text string")
    assert D.contamination(no_docs.select(F.col("doc_id").alias("bench_row"), "text"), empty).collect() == []
    assert by_row(D.contamination(one, empty), "bench_row", "n_words", "n_hit") == {(1, 2, 0): 1, (2, 0, 0): 1}


# ---- quality rules ---------------------------------------------------------------------------

def test_base_statistics_and_order_of_rules(docs, rows):
    want = Counter()
    for i, text, *_ in rows:
        text = text or ""
        words = WORD.findall(text)
        grams = Counter(zip(words, words[1:], words[2:]))
        cover = {k + d for k in range(len(words) - 2) if grams[tuple(words[k:k + 3])] > 1 for d in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        n = len(words)
        want[i, n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover),
             n < 50 or 100 * len(cover) > 50 * n] += 1
    got = quality_rules.judge(docs).cache()
    assert by_row(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert got.filter("base_failed and kept").isEmpty() and not got.filter("kept").isEmpty()
    order = list(quality_rules.RULES)
    for turn in (order, order[::-1]):
        texts = quality_rules.Texts(*texts_of(__import__("pyarrow").array([r[1] for r in rows])))
        passed = quality_rules.cascade(texts, quality_rules.RULES, turn)
        plain = ~np.any([rule(texts) for rule in quality_rules.RULES.values()], axis=0)
        assert passed.tolist() == np.flatnonzero(plain).tolist()


def test_each_rule_alone_rejects_a_text_that_passes_the_base_rule(spark):
    words = [f"{a}{b}xyz" for a in "abcdefghij" for b in "klmnopqrst"]
    phrases = words[:22] * 2 + words[22:78]
    texts = {
        "symbols": "# ".join(words), "shouting": " ".join(words).upper(), "exclaiming": "!! ".join(words),
        "digits": " ".join(w + "123" for w in words), "word_length": " ".join(w * 4 for w in words),
        "repeated_lines": "\n".join(["same line here"] * 8 + [" ".join(words)]),
        "one_word": " ".join(f"{w} the" for w in words), "repeated_phrases": " ".join(phrases)}
    assert list(texts) == list(quality_rules.RULES)
    found = quality_rules.Texts(*texts_of(__import__("pyarrow").array(list(texts.values()))))
    rejects = {name: [t for t, bad in zip(texts, rule(found)) if bad] for name, rule in quality_rules.RULES.items()}
    assert rejects == {name: [name] for name in texts}
    docs = spark.createDataFrame([*enumerate(texts.values()), (99, " ".join(words))], "doc_id long, text string")
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality_rules.judge(docs).collect()}
    assert got == {**dict.fromkeys(range(len(texts)), (False, False)), 99: (False, True)}


def test_rules_are_ordered_on_rows_of_all_files_that_pass_the_base_rule(spark, tmp_path):
    words = [f"{a}{b}xyz" for a in "abcdefghij" for b in "klmnopqrst"]
    kinds = {"plain": " ".join(words), "marked": " ".join(words) + " late", "short": "too short"}
    for k, (name, n) in enumerate([("plain", 400), ("marked", 400), ("short", 400)]):
        rows = spark.createDataFrame([(1000 * k + i, kinds[name]) for i in range(n)], "doc_id long, text string")
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    # All at like cost: one rejects nothing, one only what fails the base rule, one a source.
    rules = {"nothing": lambda t: t.n_words < 0, "short": lambda t: t.n_words < 50, "late": lambda t: t.n_words > 100}
    assert quality_rules.order_rules(docs, rules, 300)[0] == "late"
    seen = Counter()
    for batch in quality_rules._measure(iter(docs.toArrow().to_batches()), rules):
        for row in batch.to_pylist():
            seen[row["rule"]] += row["rejected"]
            seen["texts"] += row["texts"]
    assert seen == {"nothing": 0, "short": 0, "late": 400, "texts": 2400}


def test_quality_rules_of_nothing(no_docs):
    assert quality_rules.judge(no_docs).collect() == []


# ---- learned labels --------------------------------------------------------------------------

@pytest.mark.parametrize("score, label, modulus, held", [
    (toxicity.score, "toxic", 4, 2), (quality_classifier.classify, "quality", 5, 0)])
def test_learned_labels(spark, docs, no_docs, score, label, modulus, held):
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
    labels = read("labels")
    got = score(read("documents"), labels).cache()
    assert all(r.held_out == (crc(r.doc_id) % modulus == held) and 0 <= r.score <= 1 for r in got.collect())
    checked = got.filter("held_out").join(labels, "doc_id").select(F.col(label).alias("y"), (F.col("score") >= 0.3).cast("int").alias("p"))
    assert checked.filter("y = p").count() >= 0.9 * checked.count()
    # awkward rows, no labels at all, labels of one kind, null labels
    for rows in ([], [(1, 1, 1), (2, 1, 1)], [(1, None, None), (None, 1, 1), (3, 0, 0), (3, 1, 1)]):
        few = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
        assert score(docs, few).filter("score between 0 and 1").count() == docs.count()
    assert score(no_docs, labels).collect() == []


def test_isotonic_pools_rise():
    count, good = np.array([5.0, 0, 5, 5, 5]), np.array([1.0, 0, 3, 1, 5])
    quality_classifier_bins = quality_classifier.isotonic(count, good)
    assert np.allclose(quality_classifier_bins[1], [0.2, 0.4, 0.4, 1.0])


def test_label_model_discounts_copied_voters():
    rng = np.random.default_rng(4)
    y = rng.random(20_000) < 0.2
    votes = np.zeros((len(y), toxicity.VOTERS), bool)
    votes[:, 0] = votes[:, 1] = votes[:, 2] = np.where(y, rng.random(len(y)) < 0.6, rng.random(len(y)) < 0.05)
    for k in (3, 4, 5):
        votes[:, k] = np.where(y, rng.random(len(y)) < 0.8, rng.random(len(y)) < 0.05)
    masks, counts = np.unique((votes << np.arange(toxicity.VOTERS)).sum(1), return_counts=True)
    model = toxicity.LabelModel(masks, counts.astype(float))
    assert model.weight[0] < 0.6 < model.weight[3]
    assert ((model.posterior((votes << np.arange(toxicity.VOTERS)).sum(1)) > 0.5) == y).mean() > 0.93


def test_digest_names_are_hex(spark):
    from cartonscope.llm.queries import op7_line_dedup
    from tests.llm.conftest import SF
    assert all(re.fullmatch("[0-9a-f]{64}", r.kept_sha256) for r in op7_line_dedup(spark, SF).collect())
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
