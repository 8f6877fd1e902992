"""Operators against brute force on small random inputs."""

import random
import re
from collections import defaultdict, deque

import numpy as np
from pyspark.sql import functions as F

from cartonscope.operators import admission as AD
from cartonscope.operators import anchors as A
from cartonscope.operators import layout as L


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    s = next((i for i, (x, y) in enumerate(zip(a[::-1], b[::-1])) if x != y), min(len(a), len(b)))
    return p + s >= max(len(a), len(b)) - 1


def fuzzy(text, term):
    low = text.lower()
    return any(within_one(low[i:i + w], term) and not (i and low[i - 1].isalpha())
               and not (i + w < len(low) and low[i + w].isalpha())
               for w in (len(term) - 1, len(term), len(term) + 1) for i in range(len(low) - w + 1))


TWO_LETTERS = r"[^\W\d_]{2}"


def stray(text, term):
    """The term stands somewhere without two letters right before it and without two right behind it."""
    return bool(re.search(f"(?<!{TWO_LETTERS}){re.escape(term)}(?!{TWO_LETTERS})", text.lower()))


def test_compiled_tiers_equal_brute_force(spark):
    rng = random.Random(7)
    terms = ["marketed by", "incl. of all taxes", "customer care", "सभी करों सहित", "મહત્તમ છૂટક કિંમત"]
    noise = "abt .,1कमગા"
    rows = []
    for _ in range(1500):
        t = list(rng.choice(terms))
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(t))
            t[i:i + rng.randint(0, 1)] = [rng.choice(noise)] * rng.randint(0, 1)
        pad = ["".join(rng.choice(noise) for _ in range(rng.randint(0, 3))) for _ in range(2)]
        rows.append((pad[0] + "".join(t) + pad[1],))
    df = spark.createDataFrame(rows, "text string")
    got = df.select("text", *[f(("text"), [t]).alias(f"{n}{i}") for i, t in enumerate(terms)
                              for n, f in (("f", A.is_fuzzy), ("s", A.is_stray))]).collect()
    for r in got:
        for i, t in enumerate(terms):
            assert r[f"f{i}"] == fuzzy(r.text, t), (r.text, t)
            assert r[f"s{i}"] == stray(r.text, t), (r.text, t)


def test_a_dictionary_table_of_any_size_finds_what_patterns_find(spark):
    rng = random.Random(9)
    rows = [(g, lang, t) for g, lang, t in A.default_rows()] + [(f"g{k % 50}", "eng", f"term {k} of many") for k in range(6_000)]
    words = [t for _, _, t in rows[:60:3]] + [f"term {rng.randrange(6_000)} of many" for _ in range(12)]
    texts = []
    for w in words * 2:
        t = list(w.upper() if rng.random() < 0.3 else w)
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(t) + 1)
            t[at:at + rng.randrange(2)] = [rng.choice("xé .1क")] * rng.randrange(2)
        texts.append(rng.choice(["", "a", "ab", "1", "x "]) + "".join(t) + rng.choice(["", "c", "cd", " y"]))
    regions = spark.createDataFrame([(k % 7, k, t) for k, t in enumerate([*texts, "", "ſK"])], "scan_id long, region_idx int, text string")
    # as patterns only the built-in terms and the made ones from which texts were made
    used = [r for r in rows if r[0] in A.GROUPS or r[2] in words]
    want = A.anchor_match(regions, A.compile_dictionary(spark.createDataFrame(used, "grp string, lang string, term string")))
    got = A.match_table(regions, spark.createDataFrame(rows, "grp string, lang string, term string"))
    columns = ["scan_id", "region_idx", "grp", "tier"]
    wanted = {tuple(r) for r in want.select(columns).collect()}
    found = {tuple(r) for r in got.select(columns).collect()}
    assert wanted <= found and all(r in wanted for r in found if r[2] in A.GROUPS)


def naive_limiter(times, window, limit):
    kept, out = [], []
    for t in times:
        kept = [k for k in kept if k > t - window]
        out.append(len(kept) < limit)
        if out[-1]:
            kept.append(t)
    return out


def test_limiter_equals_naive_log(spark):
    rng = random.Random(3)
    rows = [(i, f"{1_700_000_000 + rng.choice([0, 500]) + rng.random() * 400:.6f}", rng.choice(["a", "b", None]))
            for i in range(1200)]
    df = spark.createDataFrame(rows, "arrival_id bigint, s string, email string").select(
        "arrival_id", F.timestamp_micros((F.col("s").cast("decimal(20,6)") * 1_000_000).cast("bigint")).alias("ts"),
        "email", F.lit(None).cast("string").alias("host"))
    got = {r.arrival_id: r.admitted for r in AD.rate_limit(df, 20, 3).collect()}
    times = defaultdict(list)
    for r in df.select("arrival_id", AD.identity().alias("k"), F.unix_micros("ts").alias("t")).collect():
        times[r.k].append((r.t, r.arrival_id))
    for key, hits in times.items():
        hits.sort()
        want = naive_limiter([t for t, _ in hits], 20_000_000, 3)
        assert [got[i] for _, i in hits] == want, key


def test_decide_reports_whole_seconds_until_free():
    admitted, retry = AD.decide(np.array([0, 1_000_000, 59_999_999]), deque(), 60_000_000, 1)
    assert list(admitted) == [True, False, False] and list(retry) == [0, 59, 1]


def test_limiter_stream_equals_batch(spark, tmp_path):
    from cartonscope.streaming.limiter import rate_limit_stream
    rows = [(i, 1_700_000_000 + 11 * i, "u" if i % 3 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "arrival_id bigint, s bigint, email string").select(
        "arrival_id", F.timestamp_seconds("s").alias("ts"), "email", F.lit(None).cast("string").alias("host"))
    for k in range(3):  # three files, one after the other, a micro-batch each
        df.filter(f"arrival_id div 20 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = (rate_limit_stream(stream, 60, 2).writeStream.format("memory").queryName("gate").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r.arrival_id: (r.admitted, r.retry_after) for r in spark.table("gate").collect()}
    assert got == {r.arrival_id: (r.admitted, r.retry_after) for r in AD.rate_limit(df, 60, 2).collect()}


def near(word, head):
    return abs(word[0] - head[0]) <= max(8, 0.4 * max(word[2], head[2]))


def test_every_word_is_in_the_first_line_whose_head_is_near(spark):
    rng = random.Random(11)
    scans = {s: [(rng.randint(0, 200), i, rng.randint(5, 60)) for i in range(40)] for s in range(30)}
    df = spark.createDataFrame([(s, "p", i, y, h) for s, ws in scans.items() for y, i, h in ws],
                               "scan_id bigint, reader string, word_idx int, y int, height int")
    got = defaultdict(dict)
    for r in L.cluster_lines(df).collect():
        got[r.scan_id][r.word_idx] = r.line_no
    for s, words in scans.items():
        lines = defaultdict(list)
        for w in sorted(words):
            lines[got[s][w[1]]].append(w)
        heads = {n: ws[0] for n, ws in lines.items()}
        assert sorted(heads, key=heads.get) == list(range(len(heads)))
        for n, ws in lines.items():
            open_to = [[m for m, head in heads.items() if head < w and near(w, head)] for w in ws]
            # A head found no earlier line; all others are in the first of those that would take them.
            assert not open_to[0] and all(min(ms) == n for ms in open_to[1:])
