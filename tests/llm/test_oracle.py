"""SQL of the training-data operators on planted rows that the check tables may lack."""

from collections import Counter

import duckdb

from cartonscope.llm import quality_rules, queries
from cartonscope.llm.oracle import ORACLE


def in_duckdb(key, rows, columns):
    con = duckdb.connect()
    con.execute(f"CREATE TABLE documents ({columns})")
    con.executemany(f"INSERT INTO documents VALUES ({', '.join('?' * len(rows[0]))})", rows)
    found = con.execute(ORACLE[key])
    names = [c[0] for c in found.description]
    return names, found.fetchall()


def word(k):
    return "".join(chr(97 + k // 26 ** d % 26) for d in range(3)) + "en"


def test_phrase_rule_alone_rejects_in_query_and_sql(spark):
    def text(repeated, others):
        """repeated words stand twice, one after the other, between single ones."""
        phrase = " ".join(word(k) for k in range(repeated))
        return " ".join([phrase, *[word(1000 + k) for k in range(others)], phrase])
    rows = [(1, text(21, 58)), (2, text(20, 60)), (3, text(25, 50)), (4, text(26, 48))]  # 42, 40, 50 and 52 of 100 words repeat
    got = {r.doc_id: (r.n_repeat_words, r.base_failed, r.kept) for r in
           quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (42, False, False), 2: (40, False, True), 3: (50, False, False), 4: (52, True, False)}
    names, found = in_duckdb("op6_quality_rules", rows, "doc_id BIGINT, text VARCHAR")
    sql = [dict(zip(names, r)) for r in found]
    assert {r["doc_id"]: (r["n_repeat_words"], r["base_failed"], r["kept"]) for r in sql} == got


def test_merkle_sql_equals_the_query(spark):
    rows = [(i if i != 5 else None, "" if i == 3 else None if i == 4 else f"é {i}", [None, "de", "en", "é"][i % 4], None if i == 7 else "s", None if i == 9 else i)
            for i in range(23)] + [(8, "é 8", "de", "s", 8)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    names, found = in_duckdb("op12_merkle_manifest", rows, "doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT")
    assert Counter(tuple(r) for r in queries.merkle_digests(df).select(names).collect()) == Counter(found)
