import random
import unicodedata

from pyspark.sql import functions as F

from cartonscope import constants as K
from cartonscope.functions import text as X


def script_of(text):
    if text is None:
        return "mixed"
    letters = [c for c in text if unicodedata.category(c).startswith("L")]
    latin = sum(c.isascii() and c.isalpha() for c in text)
    deva, guj = (sum(low <= c <= high for c in letters) for low, high in (("ऀ", "ॿ"), ("઀", "૿")))
    present = [(n, name) for n, name in ((latin, "eng"), (deva, "hin"), (guj, "guj")) if n]
    if len(present) == 1:
        return present[0][1]
    return "eng" if len(present) > 1 and latin > max(deva, guj, deva + guj) and deva + guj <= K.SCRIPT_NOISE_TOLERANCE else "mixed"


def test_scripts_and_routes_equal_plain_counts(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("aZé1 .-कि१ગે૨𝒜\n") for _ in range(rng.randint(0, 9))) for _ in range(800)]
    texts += [None, "", "..", "1-2", "1-2-3", "a" * 9 + "क", "a" * 9 + "कग", "a" * 9 + "कगम", "-" * 5000 + "ab"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(
        "text", X.dominant_script(F.col("text")).alias("s"), X.reread_route(F.col("text")).alias("r"))
    for row in df.collect():
        want = script_of(row.text)
        known = [c for c in row.text or "" if unicodedata.category(c)[0] in "LN"]
        assert row.s == want, row.text
        assert row.r == ("keep" if row.text is not None and len(known) < K.MIN_REREAD_ALNUM
                         else K.COMBINED_READER if want == "mixed" else want), row.text


def test_each_script_is_counted_once(spark):
    plan = spark.range(1).select(X.reread_route(F.col("id").cast("string")).alias("r"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace") <= 3
